"""Ranks, samples and running values over orders that may cover the whole table.

A plain window without (or with few) partition keys sorts a whole table in one task. Here every
order is first cut into buckets that follow the order itself; the window runs inside a bucket and
the buckets are joined with their offsets, which are an aggregate of one row per bucket.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from galleryspark.session import cut_lineage

HASH_DIGITS = 3
TASK_ROWS = 250_000  # rows that a task sorts or joins at once


def hash_key(seed: int | Column, key: Column) -> Column:
    """Deterministic order for sampling: md5 of ``seed:key``, the same on every engine."""
    seed_text = seed.cast("string") if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat(seed_text, F.lit(":"), key.cast("string")))


def by_key(df: DataFrame, *keys: str, n: int | None = None) -> DataFrame:
    """The rows dealt out by ``keys``, about TASK_ROWS to a task, where a large table is joined, ranked or grouped by them.

    Left to itself, Spark merges shuffled parts to one for each core, up to 64 MB as they are packed, and a task that sorts
    them several times holds gigabytes. A table that has fewer rows for each core stays as it is.
    """
    spark = df.sparkSession
    n = df.count() if n is None else n
    if n <= TASK_ROWS * spark.sparkContext.defaultParallelism:
        return df
    return df.repartition(max(math.ceil(n / TASK_ROWS), int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def bucketed_rank(
    df: DataFrame,
    by: Sequence[str],
    bucket: Column,
    order: Sequence[Column],
    rank: str = "rn",
    total: str | None = None,
) -> DataFrame:
    """1-based rank within ``by``; ``bucket`` must rise with ``order``.

    The join and the window share the partitioning (by, bucket), so each row is shuffled once.
    """
    # One struct key: equal also where a stratum is null, and shared by the join and the window.
    rows = df.withColumn("_cell", F.struct(*by, bucket.alias("_bucket")))
    strata = [F.col("_cell")[name] for name in by] or [F.lit(0)]
    upto = Window.partitionBy(*strata).orderBy(F.col("_cell._bucket"))
    sizes = rows.groupBy("_cell").agg(F.count(F.lit(1)).alias("_size"))
    offsets = sizes.withColumn("_offset", F.sum("_size").over(upto) - F.col("_size"))
    if total:
        offsets = offsets.withColumn(total, F.sum("_size").over(Window.partitionBy(*strata)))
    inside = Window.partitionBy("_cell").orderBy(*order)
    return (
        rows.join(offsets.drop("_size"), "_cell")
        .withColumn(rank, (F.row_number().over(inside) + F.col("_offset")).cast("long"))
        .drop("_cell", "_offset")
    )


def hash_rank(
    df: DataFrame,
    seed: int | Column,
    key: Column,
    by: Sequence[str] = (),
    rank: str = "rn",
    total: str | None = None,
) -> DataFrame:
    """Rank in hash order within ``by``. The md5 prefix is a uniform bucket, so a stratum holding
    a third of all rows is still spread over many tasks."""
    hashed = df.withColumn("_hash", hash_key(seed, key)).withColumn("_key", key)
    ranked = bucketed_rank(
        hashed, by, F.substring("_hash", 1, HASH_DIGITS), [F.col("_hash"), F.col("_key")], rank, total
    )
    return ranked.drop("_hash", "_key")


def sample_n(df: DataFrame, n: int, seed: int, key: Column) -> DataFrame:
    """The first ``n`` rows in hash order, all rows if there are fewer (a top-k, no full sort)."""
    return (
        df.withColumn("_hash", hash_key(seed, key))
        .withColumn("_key", key)
        .orderBy("_hash", "_key")
        .limit(n)
        .drop("_hash", "_key")
    )


def position_map(df: DataFrame, order: Sequence[str], position: str = "position") -> DataFrame:
    """Dense 0-based position of every row in the global order of ``order``.

    The rows are range-partitioned and sorted once and stored; positions are then the partition's
    offset (an aggregate of one row per partition) plus the place inside the partition.
    """
    spark = df.sparkSession
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    placed = cut_lineage(
        df.repartitionByRange(partitions, *order)
        .sortWithinPartitions(*order)
        .withColumn("_mid", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_mid", 33))
        .withColumn("_local", F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)))
    )
    upto = Window.orderBy("_part")
    offsets = (
        placed.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_size"))
        .select("_part", (F.sum("_size").over(upto) - F.col("_size")).alias("_offset"))
    )
    # One row per range partition, never more: the broadcast is bounded by the partition count.
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(position, F.col("_offset") + F.col("_local"))
        .select(*df.columns, position)
    )


def bucketed_running(
    df: DataFrame,
    by: Sequence[str],
    bucket: Column,
    order: str,
    value: str,
    how: str,
    out: str,
    inclusive: bool = True,
) -> DataFrame:
    """Running ``max``, ``sum`` or ``last`` non-null of ``value`` within ``by`` along ``order``.

    ``bucket`` must rise with ``order``. The carry of earlier buckets is computed on one row per
    bucket, so no task ever holds a whole ``by`` group.
    """
    rows = df.withColumn("_cell", F.struct(*by, bucket.alias("_bucket")))
    strata = [F.col("_cell")[name] for name in by] or [F.lit(0)]
    present = F.col(value).isNotNull()
    per_bucket = {
        "max": F.max(value),
        "sum": F.sum(value),
        "last": F.max_by(F.when(present, F.col(value)), F.when(present, F.col(order))),
    }[how]
    fold = {"max": F.max, "sum": F.sum, "last": lambda c: F.last(c, ignorenulls=True)}[how]
    before = Window.partitionBy(*strata).orderBy(F.col("_cell._bucket")).rowsBetween(Window.unboundedPreceding, -1)
    carries = (
        rows.groupBy("_cell").agg(per_bucket.alias("_part")).select("_cell", fold("_part").over(before).alias("_carry"))
    )
    end = Window.currentRow if inclusive else -1
    inside = Window.partitionBy("_cell").orderBy(order).rowsBetween(Window.unboundedPreceding, end)
    local = fold(value).over(inside)
    merged = {
        "max": F.greatest(local, F.col("_carry")),
        "sum": F.when(local.isNull() & F.col("_carry").isNull(), None).otherwise(
            F.coalesce(local, F.lit(0)) + F.coalesce(F.col("_carry"), F.lit(0))
        ),
        "last": F.coalesce(local, F.col("_carry")),
    }[how]
    return rows.join(carries, "_cell").withColumn(out, merged).drop("_cell", "_carry")
