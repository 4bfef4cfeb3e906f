"""Language identification with string kernels.

Two texts are compared by the character n-grams (1 to 4) that both have: the blended-spectrum presence kernel, taken
on n-grams hashed into BUCKETS cells and normalised to length one. A bounded number of landmarks per language (taken
in hash order from the labelled documents) turns the kernel into Nystroem features; one-versus-rest kernel ridge
regression on all labelled documents is then a small linear system whose two matrices are sums over documents,
made by Spark in partial sums. Features are computed once, in batched matrix products, and stored; fitting
and scoring read them.

Cases: a text that is null or has no letter is ``und`` with score 0 and teaches nothing; a null lang teaches nothing; a null
doc_id is scored but neither held out nor learned; repeated rows count as often as they occur; with nothing to
learn from, everything is ``und``; equal scores go to the first language by name; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from galleryspark.llm.common import store

LONGEST = 4
BUCKETS = 1 << 14
LANDMARKS = 16  # per language
BATCH = 64
RIDGE = 1e-3
_PRIME = np.uint32(0x9E3779B1)


def presence(text: str, out: np.ndarray) -> None:
    """Mark the cells of the n-grams of ``text`` in ``out`` (BUCKETS numbers)."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint32)
    acc = np.zeros(len(codes), np.uint32)
    for n in range(1, LONGEST + 1):
        if len(codes) < n:
            return
        acc = (acc[: len(codes) - n + 1] * np.uint32(0x85EBCA6B)) + codes[n - 1 :] + np.uint32(n)
        cell = acc ^ (acc >> np.uint32(15))
        out[(cell * _PRIME) >> np.uint32(32 - 14)] = 1


def _landmark_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cells = []
        for text in batch.column(1):
            marks = np.zeros(BUCKETS, np.uint8)
            presence(text.as_py(), marks)
            cells.append(np.packbits(marks).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cells, pa.binary())], names=["id", "cells"])


def _features(landmarks):
    """The batch with ``text`` replaced by its Nystroem features (null where there is no letter)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, whiten = landmarks.value
        for batch in batches:
            at = batch.schema.get_field_index("text")
            letters = batch.column("has_letter").to_pylist()
            out: list[np.ndarray | None] = []
            for lo in range(0, batch.num_rows, BATCH):
                part = batch.column(at).slice(lo, BATCH)
                grid = np.zeros((len(part), BUCKETS), np.float32)
                for i, text in enumerate(part):
                    if letters[lo + i]:
                        presence(text.as_py(), grid[i])
                kernel = grid @ marks
                kernel /= np.maximum(np.sqrt(grid.sum(1)), 1)[:, None]
                out += [f if letters[lo + i] else None for i, f in enumerate((kernel @ whiten).astype(np.float32))]
            columns = [pa.array(out, pa.list_(pa.float32())) if i == at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return run


def _moments(languages: list[str], size: int):
    """Rows (i, values): row i of the feature products next to row i of the products with the targets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size + len(languages)))
        number = {lang: k for k, lang in enumerate(languages)}
        for batch in batches:
            phi = batch.column("text").flatten().to_numpy().reshape(-1, size).astype(np.float64)
            target = -np.ones((len(phi), len(languages)))
            target[np.arange(len(phi)), [number[x] for x in batch.column("lang").to_pylist()]] = 1
            total += phi.T @ np.hstack([phi, target])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "values"])

    return run


def _scores(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, weights = model.value
        for batch in batches:
            phi = batch.column("text")
            known = np.array(phi.is_valid())
            names, scores = np.full(len(phi), "und", object), np.zeros(len(phi))
            if known.any() and len(languages):
                margins = phi.drop_null().flatten().to_numpy().reshape(-1, len(weights)) @ weights
                best = margins.argmax(1)
                names[known] = np.array(languages, object)[best]
                scores[known] = np.clip((margins[np.arange(len(best)), best] + 1) / 2, 0, 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(list(names), pa.string()), pa.array(scores)],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    return run


def identify(docs: DataFrame, learn: Column, landmarks: int = LANDMARKS) -> DataFrame:
    """doc_id, held_out, lang_pred, score per row; learns where ``learn`` (over doc_id) is true."""
    spark = docs.sparkSession
    share = spark.sparkContext.broadcast
    docs = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        F.col("lang").cast("string").alias("lang"),
        F.coalesce(learn, F.lit(False)).alias("learn"),
        (F.col("doc_id").isNotNull() & ~F.coalesce(learn, F.lit(False))).alias("held_out"),
        F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("has_letter"),
    )
    taught = F.col("learn") & F.col("has_letter") & F.col("lang").isNotNull()
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = docs.where(taught).select("doc_id", "lang").withColumn("place", F.row_number().over(order)).where(F.col("place") <= landmarks)
    # at most `landmarks` rows a language
    chosen = store(chosen.select("doc_id", F.col("lang").alias("name")).distinct(), "landmarks")
    rows = (
        docs.where(taught)
        .join(F.broadcast(chosen), "doc_id")
        .where("lang = name")
        .select(F.col("doc_id").alias("id"), "text")
        .mapInArrow(_landmark_rows, "id long, cells binary")
        .collect()
    )
    languages = sorted(r["name"] for r in chosen.select("name").distinct().collect())
    marks = np.array([np.unpackbits(np.frombuffer(r["cells"], np.uint8)) for r in sorted(rows)], np.float32).reshape(-1, BUCKETS)
    marks /= np.maximum(np.sqrt(marks.sum(1)), 1)[:, None]
    values, vectors = np.linalg.eigh(marks @ marks.T + 1e-6 * np.eye(len(marks))) if len(marks) else (np.ones(0), np.zeros((0, 0)))
    whiten = (vectors / np.sqrt(np.maximum(values, 1e-6))) @ vectors.T
    shape = share((np.ascontiguousarray(marks.T), whiten.astype(np.float32)))
    schema = "doc_id long, text array<float>, lang string, learn boolean, held_out boolean, has_letter boolean"
    features = store(docs.mapInArrow(_features(shape), schema), "features")
    size = len(marks)
    weights = np.zeros((size, len(languages)))
    if size:
        parts = features.where(taught).select("text", "lang").mapInArrow(_moments(languages, size), "i int, values array<double>")
        sums = parts.groupBy("i").agg(F.array(*[F.sum(F.get("values", F.lit(j))) for j in range(size + len(languages))]).alias("values"))
        total = np.array([r["values"] for r in sorted(sums.collect())])  # one row a landmark
        scale = max(np.trace(total[:, :size]) / size, 1e-9)
        weights = np.linalg.solve(total[:, :size] + RIDGE * scale * np.eye(size), total[:, size:])
    model = share((languages, weights))
    return features.mapInArrow(_scores(model), "doc_id long, held_out boolean, lang_pred string, score double")
