"""Quality scores by hashed word n-gram logistic regression, trained with follow-the-regularised-leader updates.

Words are runs of letters and digits or runs of other characters, so marks glued to words are words too; features
are distinct words and word pairs, hashed into BUCKETS cells, each worth one over the root of their number. Training
takes at most TRAIN_ROWS labelled documents (a share of them in hash order). Their features are stored once; in every
round SHARDS tasks run FTRL-proximal updates over their documents from the common state, and the states are averaged.
A score is one sparse dot product over the whole text.

Cases: null and empty texts have only the intercept; a null doc_id is scored but neither held out nor learned; labels
that are null are left out, and of several labels of one document the smallest counts; repeated rows are
scored as often as they occur; with no label every score is one half; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from galleryspark.llm.common import store
from galleryspark.llm.hashing import EXACT_CODES, KINDS, U, blocks, ngrams, words

BUCKETS = 1 << 18
TRAIN_ROWS = 40_000
SHARDS = 8
ROUNDS = 4
ALPHA, BETA, L1, L2 = 3.0, 1.0, 0.005, 0.001


def features(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct cells) of every text; cell 0 is the intercept."""
    for base, end, data, starts in blocks(texts):
        hashes, rows, _, _ = words(data, starts, codes=EXACT_CODES, kinds=KINDS)
        pairs, owner = ngrams(hashes, rows, 2)
        one = np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=end - base))))
        two = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=end - base))))
        cells = (hashes % U(BUCKETS - 1)).astype(np.int32) + 1
        pair_cells = (pairs % U(BUCKETS - 1)).astype(np.int32) + 1
        for i in range(end - base):
            own = np.concatenate(([0], cells[one[i] : one[i + 1]], pair_cells[two[i] : two[i + 1]])).astype(np.int32)
            yield base + i, np.unique(own)


def _weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    inner = np.maximum(np.abs(z) - L1, 0)
    return -np.sign(z) * inner / ((BETA + np.sqrt(n)) / ALPHA + L2)


def _value(k: int) -> float:
    return 1 / np.sqrt(max(k - 1, 1))


def _margin(w: np.ndarray) -> float:
    return float(w[0] + w[1:].sum() * _value(len(w)))


def _training_rows(labels):
    """(label, cells) of the labelled documents that were chosen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, marks = labels.value
        for batch in batches:
            docs = batch.column(0).to_numpy()
            at = np.minimum(np.searchsorted(ids, docs), max(len(ids) - 1, 0))
            keep = ids[at] == docs if len(ids) else np.zeros(len(docs), bool)
            if keep.any():
                own = [cells for _, cells in features(batch.column(1).filter(pa.array(keep)))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(marks[at[keep]].astype(np.int32)), pa.array(own, pa.list_(pa.int32()))], names=["label", "cells"]
                )

    return run


def _train(state):
    """One pass of FTRL over this task's rows from the common state; one row (rows, z, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z, n = (x.copy() for x in state.value)
        seen = 0
        for batch in batches:
            labels = batch.column(0).to_numpy()
            for label, cells in zip(labels, batch.column(1)):
                at = cells.values.to_numpy()
                w = _weights(z[at], n[at])
                g = np.full(len(at), (1 / (1 + np.exp(-np.clip(_margin(w), -30, 30))) - label) * _value(len(at)))
                g[0] /= _value(len(at))
                sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
                z[at] += g - sigma * w
                n[at] += g * g
                seen += 1
        if seen:
            yield pa.RecordBatch.from_arrays(
                [pa.array([seen]), pa.array([z.astype(np.float32).tobytes()]), pa.array([n.astype(np.float32).tobytes()])], names=["rows", "z", "n"]
            )

    return run


def _score(weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        for batch in batches:
            margins = np.array([_margin(w[cells]) for _, cells in features(batch.column(1))])
            scores = 1 / (1 + np.exp(-np.clip(margins, -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    return run


def score_quality(docs: DataFrame, labels: DataFrame, learn: Column, target: str = "quality", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted per row; learns from labels whose doc_id fulfils ``learn``."""
    share = docs.sparkSession.sparkContext.broadcast
    docs = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        (F.col("doc_id").isNotNull() & ~F.coalesce(learn, F.lit(False))).alias("held_out"),
    )
    known = labels.where(F.coalesce(learn, F.lit(False)) & F.col(target).isNotNull())
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(target).cast("int").alias("label"))
    total = max(known.count(), 1)
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(min(1.0, train_rows / total) * (1 << 30))
    chosen = known.where(part).limit(2 * train_rows).toPandas().sort_values("doc_id")  # the limit is never met: it states the bound
    marks = share((chosen["doc_id"].to_numpy(np.int64), chosen["label"].to_numpy(np.int64)))
    rows = docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(_training_rows(marks), "label int, cells array<int>")
    rows = store(rows, "training")
    z, n = np.zeros(BUCKETS, np.float32), np.zeros(BUCKETS, np.float32)
    for _ in range(ROUNDS):
        states = rows.coalesce(SHARDS).mapInArrow(_train(share((z, n))), "rows long, z binary, n binary").collect()  # SHARDS rows
        if states:
            seen = [r["rows"] for r in states]
            z, n = (np.average([np.frombuffer(r[k], np.float32) for r in states], axis=0, weights=seen).astype(np.float32) for k in ("z", "n"))
    weights = share(_weights(z, n).astype(np.float32))
    return docs.select("doc_id", "text", "held_out").mapInArrow(_score(weights), "doc_id long, held_out boolean, score double, predicted int")
