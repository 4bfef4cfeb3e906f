"""Incremental variants on Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from galleryspark.sources.store import VectorStore


def read_parquet_stream(spark: SparkSession, folder: str, schema, glob: str = "*.parquet", files_per_batch: int = 1000) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return (
        spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    )


def stream_index(records: DataFrame, store: VectorStore, checkpoint: str, transform: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Upsert every new record into the store, then stop. Files already seen are skipped by the stream's
    checkpoint. A batch becomes the newest version when it is written, whichever other streams write to the store; run
    twice, it replaces itself in its old place."""

    def write(batch: DataFrame, batch_id: int) -> None:
        store.append_batch(transform(batch) if transform else batch, checkpoint, batch_id)

    return records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _with_watermark(rows: DataFrame, ts: str, late: str) -> DataFrame:
    """Event time as TIMESTAMP, which watermarks need, with rows later than ``late`` to be dropped."""
    return rows.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def monitor_windows(rows: DataFrame, width: str, value: Column, ts: str = "ts") -> DataFrame:
    """Mean of ``value`` per run and tumbling window."""
    windows = rows.groupBy("run", F.window(ts, width).alias("w")).agg(F.avg(value).alias("mean_std"), F.count(F.lit(1)).alias("n"))
    return windows.select("run", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "mean_std", "n")


def stream_training_monitor(rows: DataFrame, value: Column, threshold: float, width: str = "1 hour", late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Windows whose mean spread is under the threshold; rows later than ``late`` are dropped."""
    return monitor_windows(_with_watermark(rows, ts, late), width, value, ts).where(F.col("mean_std") < threshold)


def resource_windows(samples: DataFrame, width: str, slide: str | None = None, ts: str = "ts") -> DataFrame:
    """Count, mean and maximum of a metric per window; sliding where ``slide`` is given."""
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    out = samples.groupBy("host", window.alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.max("value").alias("max")
    )
    return out.select("host", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n", "mean", "max")


def activity_sessions(samples: DataFrame, gap: str, ts: str = "ts") -> DataFrame:
    """Busy spans per host: samples no further apart than ``gap``. The span ends one gap after its last sample.

    Spark does not merge sessions in a plan whose aggregates are all pruned away (a count of the sessions, or their
    ends alone); the filter on ``n``, which every session passes, keeps one.
    """
    out = samples.groupBy("host", F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("max"))
    out = out.where(F.col("n") > 0)
    return out.select("host", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n", "max")


def stream_resource_windows(samples: DataFrame, width: str, slide: str | None = None, late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    return resource_windows(_with_watermark(samples, ts, late), width, slide, ts)


def stream_activity_sessions(samples: DataFrame, gap: str, late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    return activity_sessions(_with_watermark(samples, ts, late), gap, ts)


def run_to_parquet(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process everything that is there and append the finished rows to a Parquet folder."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    query.outputMode("append").trigger(availableNow=True).start().awaitTermination()


def stream_partials(stream: DataFrame, partial: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> None:
    """Write the partial windows or sessions of each batch to a folder of its own, until everything that is there is done.

    Nothing waits for a watermark: windows still open at the end are written, late rows count, and a batch that is run
    again replaces its own folder. The ``whole_*`` functions merge what the folders hold, at any time.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        partial(batch).write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch_id}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    query.trigger(availableNow=True).start().awaitTermination()


def partial_windows(rows: DataFrame, by: str, value: Column, width: str, slide: str | None = None, ts: str = "ts") -> DataFrame:
    """Count, known values, sum and maximum per window: what adds up over batches."""
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    out = rows.withColumn("_v", value).groupBy(by, window.alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.count("_v").alias("known"), F.sum("_v").alias("total"), F.max("_v").alias("max")
    )
    return out.select(by, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n", "known", "total", "max")


def whole_windows(partials: DataFrame, by: str) -> DataFrame:
    """(by, window_start, window_end, n, mean, max) of all rows that went into the partial windows."""
    merged = partials.groupBy(by, "window_start", "window_end").agg(
        F.sum("n").alias("n"), F.sum("known").alias("known"), F.sum("total").alias("total"), F.max("max").alias("max")
    )
    mean = F.when(F.col("known") > 0, F.col("total") / F.col("known"))
    return merged.select(by, "window_start", "window_end", "n", mean.alias("mean"), "max")


def whole_sessions(partials: DataFrame) -> DataFrame:
    """Sessions of all rows from those of the batches (as ``activity_sessions`` gives them): a session reaches one gap
    beyond its last sample, so it is merged as one event whose gap is its own length."""
    length = F.col("session_end") - F.col("session_start")
    part = lambda unit: F.extract(F.lit(unit), length)
    gap = F.concat(
        (part("DAY").cast("long") * 24 + part("HOUR")).cast("string"), F.lit(" hours "), part("MINUTE").cast("string"), F.lit(" minutes "),
        part("SECOND").cast("string"), F.lit(" seconds"),
    )
    merged = partials.withColumn("_gap", gap).groupBy("host", F.session_window("session_start", F.col("_gap")).alias("w"))
    out = merged.agg(F.sum("n").alias("n"), F.max("max").alias("max")).where(F.col("n") > 0)  # as in ``activity_sessions``
    return out.select("host", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n", "max")
