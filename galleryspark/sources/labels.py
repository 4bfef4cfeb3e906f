"""Label maps and tag lists as CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_label_map(spark: SparkSession, path: str) -> DataFrame:
    """(path, label) from a CSV with or without a header naming both; a row without a label is an error,
    and of several rows of one path the last one counts."""
    first = spark.read.text(path).first()
    line = first.value if first else ""
    has_header = "," in line and "path" in line and "label" in line
    if has_header:
        rows = spark.read.option("header", True).option("enforceSchema", False).csv(path).select("path", "label")
    else:
        rows = spark.read.schema("path string, label string").csv(path)
    message = F.concat(F.lit("label map row without a label: "), F.coalesce("path", F.lit("")))
    checked = F.when(F.col("label").isNull(), F.raise_error(message)).otherwise(F.col("label"))
    placed = rows.select("path", checked.alias("label"), F.monotonically_increasing_id().alias("line"))
    return placed.groupBy("path").agg(F.max_by("label", "line").alias("label"))


def export_tags(df: DataFrame, path: str = "path", tags: str = "tags") -> DataFrame:
    """(path, tags) of the tagged rows, tags joined by commas."""
    return df.where(F.size(tags) > 0).select(F.col(path).alias("path"), F.array_join(tags, ",").alias("tags"))


def quarantine_by_tag(tagged: DataFrame, existing: DataFrame, tag: str = "error") -> DataFrame:
    """(path, action) of the rows that carry the tag: ``move`` where the file exists, else ``not_found``."""
    parts = F.transform(F.split("tags", ","), lambda t: F.trim(t))
    wanted = tagged.where(F.array_contains(parts, tag)).select("path")
    found = existing.select("path").distinct().withColumn("_there", F.lit(True))
    return wanted.join(found, "path", "left").select("path", F.when(F.col("_there"), "move").otherwise("not_found").alias("action"))
