"""Runs of words that repeat with a period, and texts without the repeats.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) and at least
max(MIN_LENGTH, MIN_EXPONENT * q) words that no neighbouring word extends keeping the period. All words between white
space count, upper and lower case apart.

Every word of a run occurs at least MIN_EXPONENT times inside it. So a text is split at the words that occur more rarely
in it, and each piece again at those too rare in the piece, until nothing splits: what survives is little, and no run
crosses a split. The survivors are scanned lag by lag. A lag is scanned only if at four offsets three neighbouring words
one lag apart have an equal at the next lag, which every run of that period has; a scan of all lags of a piece of
m words looks up some m * log(m) words, not m * m.

Cases: null and empty texts have no words, no runs and an empty collapsed text; any number of rows may be equal; a
column of ``docs`` named like a result column is replaced. A text is one task's work; its memory is a small multiple of
its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from galleryspark.llm.hashing import BLOCK_BYTES

MIN_EXPONENT = 4
MIN_LENGTH = 6
SHORT_LAGS = 16
WHITE = r"[\x20\x09-\x0D]+"

_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_RUNS = T.ArrayType(
    T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")]), False
)


def split_rare(ids: np.ndarray, first: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """The pieces [first, end) of the given ones in which every word occurs MIN_EXPONENT times or more."""
    done = []
    width = int(ids.max(initial=0)) + 1
    while True:
        long = end - first >= MIN_LENGTH
        first, end = first[long], end[long]
        if not len(first):
            return done
        size = end - first
        before = np.cumsum(size) - size
        owner = np.repeat(np.arange(len(first)), size)
        at = np.arange(len(owner)) + np.repeat(first - before, size)
        _, word, count = np.unique(owner * width + ids[at], return_inverse=True, return_counts=True)
        often = count[word] >= MIN_EXPONENT
        stable = np.logical_and.reduceat(often, before)
        done += zip(first[stable].tolist(), end[stable].tolist())
        often &= ~stable[owner]
        left = often.copy()
        left[1:] &= ~often[:-1] | (owner[1:] != owner[:-1])
        right = often.copy()
        right[:-1] &= ~often[1:] | (owner[1:] != owner[:-1])
        first, end = at[left], at[right] + 1


def _lags(x: np.ndarray) -> Iterator[int]:
    """Lags in ascending order, among them the period of every run of ``x``."""
    n, low = len(x), SHORT_LAGS
    top = n // MIN_EXPONENT
    yield from range(1, min(low - 1, top) + 1)
    while low <= top:
        lags = np.arange(low, min(2 * low, top + 1))
        for quarter in range(4):
            at = (lags * quarter // 4)[:, None] + lags[:, None] * np.arange(n // low + 1)
            word = x[np.minimum(at, n - 1)]
            same = (word[:, 1:] == word[:, :-1]) & (at[:, 1:] < n)
            lags = lags[(same[:, 2:] & same[:, 1:-1] & same[:, :-2]).any(axis=1)]
            if not len(lags):
                break
        yield from lags.tolist()
        low *= 2


def lag_scan(x: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of ``x``."""
    runs: dict[tuple[int, int], int] = {}
    for lag in _lags(x):
        same = np.concatenate(([False], x[lag:] == x[:-lag], [False]))
        edge = np.flatnonzero(same[1:] != same[:-1])
        start, length = edge[::2], edge[1::2] - edge[::2] + lag
        whole = length >= max(MIN_LENGTH, MIN_EXPONENT * lag)
        for key in zip(start[whole].tolist(), length[whole].tolist()):
            runs.setdefault(key, lag)  # a multiple of the smallest period has the same stretch
    return [(s, n, q) for (s, n), q in runs.items()]


def find_runs(words: list[bytes], bounds: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """The runs of every text in the order of start and period; text i holds the words bounds[i] to bounds[i + 1]."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in range(len(bounds) - 1)]
    ids = pa.array(words, pa.large_binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
    for first, end in split_rare(ids, bounds[:-1], bounds[1:]):
        text = int(np.searchsorted(bounds, first, "right")) - 1
        found[text] += [(first - int(bounds[text]) + s, n, q) for s, n, q in lag_scan(ids[first:end])]
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in found]


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> str:
    """The words but those that stand in a run after its first period, joined by one space."""
    if runs:
        cover = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            cover[start + period] += 1
            cover[start + length] -= 1
        words = [words[i] for i in np.flatnonzero(np.cumsum(cover[:-1]) == 0)]
    return b" ".join(words).decode()


def _texts(column: pa.ChunkedArray | pa.Array) -> Iterator[list[list[bytes]]]:
    """Lists of the words of texts, some BLOCK_BYTES of text at a time."""
    block, size = [], 0
    for text in column:
        data = (text.as_py() or "").encode()
        block.append(data.split())
        size += len(data)
        if size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def periodic_runs(docs: DataFrame, text: str = "text", n_words: str = "n_words", runs: str = "runs", collapsed: str = "collapsed") -> DataFrame:
    """``docs`` with the number of words, the runs (start, length and period in words, by start, then period), and the
    text without the words that a run holds after its first period, joined by single spaces."""
    added = {n_words, runs, collapsed}
    keep = [c for c in docs.columns if c.lower() not in {a.lower() for a in added}]
    taken = keep.index(text) if text in keep else None
    columns = [F.col(f"`{c}`") for c in keep] + ([F.col(f"`{text}`").alias("_text")] if taken is None else [])
    source = docs.select(*columns)
    at = len(keep) if taken is None else taken

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, found, rest = [], [], []
            for block in _texts(batch.column(at)):
                bounds = np.cumsum([0, *map(len, block)])
                for words, own in zip(block, find_runs([w for ws in block for w in ws], bounds)):
                    sizes.append(len(words))
                    found.append([{"start": s, "length": n, "period": q} for s, n, q in own])
                    rest.append(_collapsed(words, own))
            arrays = batch.columns[: len(keep)] + [pa.array(sizes, pa.int64()), pa.array(found, pa.list_(_RUN)), pa.array(rest, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, n_words, runs, collapsed])

    schema = T.StructType(
        [source.schema[i] for i in range(len(keep))]
        + [T.StructField(n_words, T.LongType()), T.StructField(runs, _RUNS), T.StructField(collapsed, T.StringType())]
    )
    return source.mapInArrow(scan, schema)


def with_planted_tails(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` where a tenth of the texts, by crc32 of the id, end in a periodic stretch made of their own words.

    With h the crc32 of the decimal id, g = h div 10 and n words: if h % 10 = 0 and n > 0, each word from a = g % n on
    becomes the word a + (i - a) % p of the text, p = 1 + (n - a) div (3 + g % 8). Other texts, null ones and those of null ids stay.
    """
    h = F.crc32(F.col(doc_id).cast("string"))
    chosen: Column = h % 10 == 0
    words = F.array_remove(F.split(F.col(text), WHITE), "")
    docs = docs.withColumn("_h", h).withColumn("_w", F.when(chosen & F.col(text).isNotNull(), words))
    step = docs.withColumn("_a", F.when(F.size("_w") > 0, F.expr("cast((_h div 10) % size(_w) as int)")))
    step = step.withColumn("_p", F.expr("cast(1 + (size(_w) - _a) div (3 + (_h div 10) % 8) as int)"))
    tail = "slice(flatten(array_repeat(slice(_w, _a + 1, _p), cast(ceil((size(_w) - _a) / _p) as int))), 1, size(_w) - _a)"
    planted = F.expr(f"array_join(concat(slice(_w, 1, _a), {tail}), ' ')")
    return step.withColumn(text, F.when(F.col("_p").isNull(), F.col(text)).otherwise(planted)).drop("_h", "_w", "_a", "_p")


def run_digest(found: DataFrame) -> DataFrame:
    """One row per text: its number of runs, the run of the greatest exponent, and digests of the runs and the rest."""
    greater = "best is null or run.length * best.period > best.length * run.period"
    kind = "struct<start: bigint, length: bigint, period: bigint>"
    best = F.expr(f"aggregate(runs, cast(null as {kind}), (best, run) -> if({greater}, run, best))")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
