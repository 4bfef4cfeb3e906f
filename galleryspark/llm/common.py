"""Helpers shared by the corpus operators: stored tables, fixed-size membership bits, connected components."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from weakref import WeakKeyDictionary

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from galleryspark.session import work_folder


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder of ``spark.checkpoint.dir`` and read it back: lineage ends here, and a
    lost executor costs no more than the tasks that it was running."""
    path = work_folder(df.sparkSession, name)
    df.write.parquet(path)
    made = _MADE.get()
    if made is not None:
        made.append(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    _FOLDERS[stored] = path
    return stored


#: The folder of every stored table that is still referred to, and the folders made since ``folders_made`` was entered.
_FOLDERS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)


@contextmanager
def folders_made() -> Iterator[list[str]]:
    """The list that gets the folder of every ``store`` inside the block."""
    token = _MADE.set([])
    try:
        yield _MADE.get()
    finally:
        _MADE.reset(token)


def delete_folders(spark: SparkSession, paths: list[str]) -> None:
    """Delete stored tables that no later job reads."""
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def discard(*stored: DataFrame | None) -> None:
    """Delete tables made by ``store`` that nothing reads any more (other frames and None are left alone)."""
    for df in stored:
        path = None if df is None else _FOLDERS.pop(df, None)
        if path:
            delete_folders(df.sparkSession, [path])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not use yet (names are compared without case, as Spark does)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def membership_bits(df: DataFrame, key: Column, log2_bits: int = 24) -> np.ndarray:
    """A bit set of ``2**log2_bits`` bits holding ``key``, a column of well mixed 64-bit integers.

    Its size is fixed, however many keys there are; a fuller set only lets more rows pass a later filter,
    which an exact join follows. Built by partial aggregation, one row per 64 bits at most.
    """
    rows = (
        df.select(key.bitwiseAND(F.lit((1 << log2_bits) - 1)).alias("slot"))
        .where("slot is not null")
        .selectExpr("shiftright(slot, 6) as word", "shiftleft(1L, cast(slot % 64 as int)) as bit")
        .groupBy("word")
        .agg(F.bit_or("bit").alias("bits"))
        .toArrow()
    )
    bits = np.zeros(max(1, (1 << log2_bits) // 64), np.int64)
    bits[rows["word"].to_numpy()] = rows["bits"].to_numpy()
    return bits.view(np.uint64)


def present(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which 64-bit ``keys`` may be in ``bits``."""
    slot = keys.view(np.uint64) & np.uint64(len(bits) * 64 - 1)
    return (bits[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, label): the smallest node reachable over ``edges``, for every node that has an edge.

    Large-star and small-star rounds in turn; each is a grouped minimum and a join, and is stored. A node
    with very many edges is a partial minimum on one side and a skewed join key on the other, which Spark splits.
    """
    links = edges.select(F.greatest(u, v).alias("a"), F.least(u, v).alias("b")).where("a <> b").distinct()
    links = store(links, "links")
    while True:
        both = links.union(links.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(low, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(lower, "a")
            .select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b")
            .where("a <> b")
            .distinct()
        )
        after = store(small, "links")
        mark = [F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))]
        if links.agg(*mark).first() == after.agg(*mark).first():
            discard(after)
            break
        discard(links)
        links = after
    labels = links.select(F.col("a").alias("node"), F.col("b").alias("label")).union(
        links.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    )
    labels = store(labels, "labels")
    discard(links)
    return labels
