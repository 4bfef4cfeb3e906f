"""Aggregates over vector columns."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from galleryspark.functions import vectors as V
from galleryspark.operators import blocks
from galleryspark.operators.ordering import sample_n


def _positions(df: DataFrame, by: Sequence[str], vector: Column) -> DataFrame:
    return df.select(*by, F.posexplode(vector).alias("pos", "x"))


def vector_mean(df: DataFrame, by: Sequence[str], vector: str = "embedding", out: str = "mean") -> DataFrame:
    """Element-wise mean; the partial sums per (group, position) are made before the shuffle."""
    means = _positions(df, by, V.as_double(F.col(vector))).groupBy(*by, "pos").agg(F.avg("x").alias("x"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "x")))  # one entry per dimension
    return means.groupBy(*by).agg(F.transform(ordered, lambda s: s["x"]).alias(out))


def centroid(df: DataFrame, by: Sequence[str], vector: str = "embedding") -> DataFrame:
    """Mean vector of the group, scaled back to unit length."""
    return vector_mean(df, by, vector).select(*by, V.l2_normalize(F.col("mean")).alias("centroid"))


def collapse_std(df: DataFrame, vectors: Sequence[str] = ("embedding",)) -> DataFrame:
    """Mean over dimensions of the sample std of the normalised rows, averaged over the views."""
    views = None
    for name in vectors:
        view = _positions(df, [], V.l2_normalize(F.col(name))).select(F.lit(name).alias("view"), "pos", "x")
        views = view if views is None else views.unionByName(view)
    per_dim = views.groupBy("view", "pos").agg(F.stddev_samp("x").alias("s"))
    per_view = per_dim.groupBy("view").agg(F.avg("s").alias("std"), F.count(F.lit(1)).alias("dim"))
    return per_view.agg(F.avg("std").alias("std"), F.max("dim").alias("dim"))


def pairwise_distance_stats(
    df: DataFrame, sample: int | None = None, seed: int = 42, id_col: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """Count, mean, sample std, min and max of the distance over unordered pairs of all rows, or of a sample of so many.

    Pairs are never written: each grid cell returns one row of partial sums. The variance is merged
    from per-cell means, so the parts do not cancel.
    """
    rows = df.select(F.col(id_col).alias("id"), blocks.stored(df, vector).alias("v"))
    if sample is not None:
        rows = sample_n(rows, sample, seed, F.col("id"))

    def kernel(lpdf: pd.DataFrame, rpdf: pd.DataFrame) -> pd.DataFrame:
        parts = []
        if not lpdf.empty and not rpdf.empty:
            left, right = blocks.matrix(lpdf["v"]), blocks.matrix(rpdf["other_v"])
            left_id, right_id = lpdf["id"].to_numpy(), rpdf["other"].to_numpy()
            for part in blocks.slices(len(left), len(right)):
                once = left_id[part][:, None] < right_id[None, :]
                value = (-blocks.scores(left[part], right, "l2"))[once]
                if len(value):
                    mean = value.mean()
                    parts.append((len(value), mean, ((value - mean) ** 2).sum(), value.min(), value.max()))
        return pd.DataFrame(parts, columns=["n", "mean", "m2", "lo", "hi"])

    others = rows.select(F.col("id").alias("other"), F.col("v").alias("other_v"))
    cells = blocks.grid(rows, others, ["id"], ["other"], kernel, "n long, mean double, m2 double, lo double, hi double")
    total = F.sum("n")
    mean = F.sum(F.col("n") * F.col("mean")) / total
    between = F.sum(F.col("n") * F.col("mean") * F.col("mean")) - total * mean * mean
    return cells.agg(
        total.alias("pairs"),
        mean.alias("mean_distance"),
        F.sqrt((F.sum("m2") + F.greatest(between, F.lit(0.0))) / (total - 1)).alias("std_distance"),
        F.min("lo").alias("min_distance"),
        F.max("hi").alias("max_distance"),
    )


# Fixed values of the collapse verdict.
COLLAPSED_BELOW = 0.1
PARTIAL_BELOW = 0.3
COLLAPSED_DISTANCE = 1e-2


def collapse_report(df: DataFrame, sample: int | None = None, seed: int = 42, vector: str = "embedding") -> DataFrame:
    """Spread of the embedding against the ideal 1/sqrt(d), with a verdict. One row."""
    spread = collapse_std(df, [vector])
    distances = pairwise_distance_stats(df, sample, seed, vector=vector)
    both = spread.select("std", "dim", F.lit(1).alias("_k")).join(distances.withColumn("_k", F.lit(1)), "_k").drop("_k")
    share = F.col("std") / F.col("ideal_std")
    return (
        both.withColumn("ideal_std", F.lit(1.0) / F.sqrt(F.col("dim").cast("double")))
        .withColumn("utilisation_pct", share * 100)
        .withColumn(
            "verdict",
            F.when((share < COLLAPSED_BELOW) | (F.col("mean_distance") < COLLAPSED_DISTANCE), "collapsed")
            .when(share < PARTIAL_BELOW, "partial")
            .otherwise("ok"),
        )
    )


Strategy = Callable[[Column, Column], Column]


def weighted_sum(weights: Mapping[str, float] | None = None) -> Strategy:
    """Sum of score times the weight of its component type (1.0 where none is given)."""
    table = weights or {}

    def build(score: Column, component_type: Column) -> Column:
        weight = F.lit(1.0)
        for name, value in table.items():
            weight = F.when(component_type == name, F.lit(float(value))).otherwise(weight)
        return F.sum(score * weight)

    return build


def max_pool() -> Strategy:
    """Best score, 0.0 when there is none."""
    return lambda score, component_type: F.coalesce(F.max(score), F.lit(0.0))
