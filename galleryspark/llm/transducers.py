"""Small finite-state transducers over classes of words, their composition, and runs over many clauses at once."""

from __future__ import annotations

from collections.abc import Hashable, Iterable
from dataclasses import dataclass, field

import numpy as np


@dataclass
class Transducer:
    """A deterministic letter-to-letter transducer: (state, symbol read) -> (state, symbol written).

    A symbol without a rule leaves the state and is written as it was read.
    """

    start: Hashable
    rules: dict[tuple[Hashable, str], tuple[Hashable, str]] = field(default_factory=dict)

    def step(self, state: Hashable, symbol: str) -> tuple[Hashable, str]:
        return self.rules.get((state, symbol), (state, symbol))

    def run(self, symbols: Iterable[str]) -> list[str]:
        state, out = self.start, []
        for symbol in symbols:
            state, written = self.step(state, symbol)
            out.append(written)
        return out

    def then(self, other: Transducer, symbols: Iterable[str]) -> Transducer:
        """The composition: ``other`` reads what this one writes. Only states that can be reached are made."""
        symbols = list(symbols)
        made = Transducer((self.start, other.start))
        todo, seen = [made.start], {made.start}
        while todo:
            a, b = state = todo.pop()
            for symbol in symbols:
                a2, middle = self.step(a, symbol)
                b2, written = other.step(b, middle)
                made.rules[state, symbol] = (a2, b2), written
                if (a2, b2) not in seen:
                    seen.add((a2, b2))
                    todo.append((a2, b2))
        return made


class Machine:
    """A transducer as tables of numbers, for many clauses in step."""

    def __init__(self, transducer: Transducer, symbols: list[str], outputs: list[str]):
        states = list(dict.fromkeys([transducer.start, *(s for s, _ in transducer.rules)]))
        number = {s: i for i, s in enumerate(states)}
        self.next = np.zeros((len(states), len(symbols)), np.int32)
        self.written = np.zeros((len(states), len(symbols)), np.int8)
        for s in states:
            for j, symbol in enumerate(symbols):
                after, out = transducer.step(s, symbol)
                self.next[number[s], j] = number[after]
                self.written[number[s], j] = outputs.index(out) if out in outputs else -1

    def run(self, symbols: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """What is written for each of ``symbols`` of the clauses [first, end); -1 elsewhere. All clauses take one step at
        a time, the long ones last alone."""
        out = np.full(len(symbols), -1, np.int8)
        order = np.argsort(first - end, kind="stable")
        first, length = first[order], (end - first)[order]
        state = np.zeros(len(first), np.int32)
        for step in range(int(length.max(initial=0))):
            live = int(np.searchsorted(-length, -step, "left"))  # clauses longer than step
            at = first[:live] + step
            read = symbols[at]
            out[at] = self.written[state[:live], read]
            state[:live] = self.next[state[:live], read]
        return out
