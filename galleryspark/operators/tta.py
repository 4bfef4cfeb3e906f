"""Test-time-augmentation analysis over views: item, is_anchor, strategy, view_idx, embedding."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from galleryspark.functions import vectors as V
from galleryspark.operators.quantiles import summary
from galleryspark.operators.vector_stats import centroid


def used_views(views: DataFrame) -> DataFrame:
    """Augmented views; the untouched view 0 only where its strategy has no other."""
    augmented = views.where(~F.col("is_anchor"))
    others = augmented.groupBy("item", "strategy").agg(F.max("view_idx").alias("_last"))
    return augmented.join(others, ["item", "strategy"]).where((F.col("view_idx") > 0) | (F.col("_last") == 0)).drop("_last")


def _anchors(views: DataFrame) -> DataFrame:
    return views.where("is_anchor").select("item", F.col("embedding").alias("_anchor"))


def global_drift(views: DataFrame) -> DataFrame:
    """(item, strategy, view_idx, similarity): cosine of each used view to the anchor."""
    return used_views(views).join(_anchors(views), "item").select(
        "item", "strategy", "view_idx", V.cosine_similarity(F.col("_anchor"), F.col("embedding")).alias("similarity")
    )


def _centroids(views: DataFrame) -> DataFrame:
    kept = views.where("is_anchor").select("item", "embedding").unionByName(used_views(views).select("item", "embedding"))
    return centroid(kept, ["item"])


def centroid_gain(views: DataFrame) -> DataFrame:
    """(item, sim_gc, avg_sim_single, gain): anchor to centroid against anchor to single views."""
    gc = _centroids(views).join(_anchors(views), "item").select("item", V.cosine_similarity(F.col("_anchor"), F.col("centroid")).alias("sim_gc"))
    single = global_drift(views).groupBy("item").agg(F.avg("similarity").alias("avg_sim_single"))
    return gc.join(single, "item").withColumn("gain", F.col("sim_gc") - F.col("avg_sim_single"))


def strategy_ablation(views: DataFrame) -> DataFrame:
    """(item, strategy, similarity): mean cosine of the strategy's views to the anchor."""
    return global_drift(views).groupBy("item", "strategy").agg(F.avg("similarity").alias("similarity"))


def strategy_cohesion(views: DataFrame) -> DataFrame:
    """(item, strategy, similarity): mean cosine of the strategy's views to the centroid."""
    joined = used_views(views).join(_centroids(views), "item")
    return joined.groupBy("item", "strategy").agg(F.avg(V.cosine_similarity(F.col("centroid"), F.col("embedding"))).alias("similarity"))


def wide(per_strategy: DataFrame, strategies: list[str]) -> DataFrame:
    """One column per strategy."""
    return per_strategy.groupBy("item").pivot("strategy", strategies).agg(F.first("similarity"))


def drift_summary(wide_table: DataFrame, columns: list[str]) -> DataFrame:
    """Median, quartiles, IQR, min and max of each column."""
    out = summary(wide_table, {c: F.col(c) for c in columns}, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    return out.select("metric", "n", "median", "q1", "q3", (F.col("q3") - F.col("q1")).alias("iqr"), "min", "max")
