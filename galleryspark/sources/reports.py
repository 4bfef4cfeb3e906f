"""Reports, split manifests and logs as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def write_report(df: DataFrame, path: str, fmt: str) -> None:
    """json, csv (sorted columns, header) or parquet."""
    if fmt == "json":
        df.write.mode("overwrite").option("ignoreNullFields", False).json(path)
    elif fmt == "csv":
        df.select(*sorted(df.columns)).write.mode("overwrite").option("header", True).csv(path)
    elif fmt == "parquet":
        df.write.mode("overwrite").parquet(path)
    else:
        raise ValueError(f"unknown report format {fmt!r}")


def read_report(spark: SparkSession, path: str, fmt: str, schema) -> DataFrame:
    reader = spark.read.schema(schema) if fmt != "parquet" else spark.read
    return reader.option("header", True).csv(path) if fmt == "csv" else getattr(reader, fmt)(path)


def write_profile_summary(df: DataFrame, path: str, histogram: str = "histogram") -> None:
    """The summary without its histogram, and the full one, as two JSON reports."""
    write_report(df.drop(histogram), f"{path}/summary", "json")
    write_report(df, f"{path}/full", "json")


def write_split_manifest(sets: DataFrame, ground_truth: DataFrame, path: str, key: str = "path") -> None:
    """Curated split as JSON: one row per member of a set, and one row per seed with its (few) members.

    The sets may hold the whole archive, so they are never nested into one value.
    """
    sets.select("part", key).write.mode("overwrite").partitionBy("part").json(f"{path}/sets")
    nested = ground_truth.groupBy("seed").agg(F.array_sort(F.collect_list("member")).alias("members"))
    nested.write.mode("overwrite").json(f"{path}/gt_selections")


def read_split_manifest(spark: SparkSession, path: str, key: str = "path") -> tuple[DataFrame, DataFrame]:
    sets = spark.read.schema(f"{key} string, part string").json(f"{path}/sets")
    nested = spark.read.schema("seed string, members array<string>").json(f"{path}/gt_selections")
    return sets, nested.select("seed", F.explode("members").alias("member"))


def append_training_log(df: DataFrame, path: str) -> None:
    """Append epoch rows, one folder per run; columns may be added later."""
    df.write.mode("append").partitionBy("run").parquet(path)


def read_training_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", True).parquet(path)


def append_processing_log(rows: DataFrame, path: str) -> None:
    """Append batch-processing rows; the log is read back as one table."""
    rows.write.mode("append").parquet(path)


def flatten_config(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Nested struct columns as dotted columns of text, cut to ``limit`` characters if one is given."""

    def leaves(schema, prefix: str, quoted: str):
        for field in schema.fields:
            name, path = f"{prefix}{field.name}", f"{quoted}`{field.name}`"
            if hasattr(field.dataType, "fields"):
                yield from leaves(field.dataType, name + ".", path + ".")
            else:
                yield name, path

    cut = lambda text: text if limit is None else F.substring(text, 1, limit)
    return df.select(*[cut(F.col(path).cast("string")).alias(name) for name, path in leaves(df.schema, "", "")])


def config_map(flat: DataFrame) -> DataFrame:
    """The dotted columns as one map column ``params``."""
    entries = F.array(*[F.struct(F.lit(c).alias("key"), F.col(f"`{c}`").alias("value")) for c in flat.columns])
    return flat.select(F.map_from_entries(entries).alias("params"))
