"""Vectorised word and shingle hashing over blocks of UTF-8 text, for use inside Spark tasks.

A block is the concatenated bytes of some documents. Word hashes come from one running sum of byte codes
times powers of an odd number: the hash of a word is a difference of two sums, shifted back to the word's
own origin, so a block costs a handful of array operations whatever its words look like. All hashes are
64 bits wide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
BLOCK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_STEP = U(0xD1342543DE82EF95)


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit integers (xor-shift and multiply, one to one)."""
    x = np.asarray(x, U)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_CODES = mix(np.arange(1, 257, dtype=U) * U(_BASE))
_LOWER = np.arange(256)
_LOWER[65:91] += 32
LOWER_CODES = _CODES[_LOWER]
EXACT_CODES = _CODES

#: Bytes between words: white space only, or all ASCII characters but letters and digits.
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[:128] = [not chr(c).isalnum() for c in range(128)]
KINDS = NOT_ALNUM.astype(np.uint8)


class _Powers:
    up = np.ones(1, U)
    down = np.ones(1, U)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, BLOCK_BYTES + 1)
            inverse = pow(_BASE, -1, 1 << 64)
            for name, base in (("up", _BASE), ("down", inverse)):
                steps = np.full(size, base, U)
                steps[0] = 1
                setattr(cls, name, np.multiply.accumulate(steps))
        return cls.up, cls.down


def blocks(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, start of each row's bytes) for runs of rows of about ``limit`` bytes; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    _, at, data = texts.buffers()
    at = np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        end = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
        end = min(end, len(texts))
        yield first, end, data[at[first] : at[end]], at[first:end] - at[first]
        first = end


def words(
    data: np.ndarray,
    starts: np.ndarray,
    breaks: np.ndarray = SPACES,
    codes: np.ndarray = LOWER_CODES,
    kinds: np.ndarray | None = None,
):
    """Hash, row (relative to the block), first byte and end byte of every word.

    With ``kinds`` (a number per byte value) a word also ends where the kind of its bytes changes.
    """
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return np.zeros(0, U), none, none, none
    edge = np.zeros(n + 1, bool)
    edge[starts] = True
    edge[n] = True
    if kinds is not None:
        kind = kinds[data]
        edge[1:n] |= kind[1:] != kind[:-1]
    live = ~breaks[data]
    before = np.concatenate(([False], live[:-1]))
    after = np.concatenate((live[1:], [False]))
    first = np.flatnonzero(live & (edge[:-1] | ~before))
    end = np.flatnonzero(live & (edge[1:] | ~after)) + 1
    up, down = _Powers.upto(n + 1)
    total = np.zeros(n + 1, U)
    np.cumsum(codes[data] * up[:n], out=total[1:])
    hashes = mix((total[end] - total[first]) * down[first] + (end - first).astype(U) * _STEP)
    return hashes, np.searchsorted(starts, first, "right") - 1, first, end


def ngrams(hashes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``n`` consecutive words of one row, and the row."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    acc = np.full(m, n, U)
    for j in range(n):
        acc = mix(acc * _STEP + hashes[j : j + m])
    whole = rows[:m] == rows[n - 1 :]
    return acc[whole], rows[:m][whole]


def shingle_sets(texts: pa.Array, n: int, breaks: np.ndarray = SPACES) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct hashes of its ``n``-word shingles); a shorter text is one shingle, no words none."""
    for base, end, data, starts in blocks(texts):
        hashes, rows, _, _ = words(data, starts, breaks)
        grams, owner = ngrams(hashes, rows, n)
        count = end - base
        n_words = np.bincount(rows, minlength=count)
        word_at = np.concatenate(([0], np.cumsum(n_words)))
        gram_at = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=count))))
        for i in range(count):
            if n_words[i] >= n:
                yield base + i, np.unique(grams[gram_at[i] : gram_at[i + 1]])
            elif n_words[i]:
                acc = np.full(1, n_words[i], U)
                for h in hashes[word_at[i] : word_at[i + 1]]:
                    acc = mix(acc * _STEP + h)
                yield base + i, acc
            else:
                yield base + i, np.zeros(0, U)
