"""Experiment and training-log analytics.

A run may hold a large share of the log, so running values go through buckets of epochs.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from galleryspark.operators.ordering import bucketed_running
from galleryspark.session import cut_lineage

EPOCH_BUCKET = 1_024
COLLAPSE_BELOW = 0.01  # fixed alert threshold of the embedding spread


def latest_per_epoch(log: DataFrame, arrival: str = "arrival") -> DataFrame:
    """The last arrived row of each (run, epoch): an evaluated epoch is logged again with its metrics."""
    rows = F.struct(*[c for c in log.columns if c not in ("run", "epoch")])
    latest = log.groupBy("run", "epoch").agg(F.max_by(rows, arrival).alias("_row"))
    return latest.select("run", "epoch", "_row.*").select(*log.columns)


def _bucket(epoch: str = "epoch") -> Column:
    return F.floor(F.col(epoch) / EPOCH_BUCKET)


def best_epochs(log: DataFrame, score: Column | None = None) -> DataFrame:
    """Add ``score`` (-val_loss by default, or a callback's expression) and ``is_best``: strictly above all
    earlier epochs of the run. One row per (run, epoch) is expected."""
    scored = log.withColumn("score", -F.col("val_loss") if score is None else score)
    seen = bucketed_running(scored, ["run"], _bucket(), "epoch", "score", "max", "_before", inclusive=False)
    better = F.col("score").isNotNull() & (F.col("_before").isNull() | (F.col("score") > F.col("_before")))
    return seen.withColumn("is_best", better).drop("_before")


def best_of_run(scored: DataFrame) -> DataFrame:
    """(run, best_epoch, best_score): the first epoch that reached the best score."""
    return scored.groupBy("run").agg(
        F.max_by("epoch", F.struct("score", -F.col("epoch"))).alias("best_epoch"), F.max("score").alias("best_score")
    )


def collapse_alerts(log: DataFrame, column: str = "train_z_std", threshold: float = COLLAPSE_BELOW) -> DataFrame:
    return log.where(F.col(column) < threshold)


def run_summary(results: DataFrame) -> DataFrame:
    """Rows, successes, failures, best score of the successes and last error text per run."""
    ok = F.col("status") == "success"
    return results.groupBy("run").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(ok.cast("bigint")).alias("succeeded"),
        F.sum((~ok).cast("bigint")).alias("failed"),
        F.max(F.when(ok, F.col("score"))).alias("best_score"),
        F.max_by(F.when(~ok, F.col("error")), F.when(~ok, F.col("arrival"))).alias("error"),
    )


def expand_grid(lists: DataFrame, params: Sequence[str], prefix: str = "run", max_runs: int | None = None) -> DataFrame:
    """All combinations of the array columns of a one-row table, the last parameter changing fastest.

    Combination i is read off the digits of i in mixed radix. The numbers are a range that many tasks share, and the one
    row of lists is sent to them; an empty list, or no row, makes no run.
    """
    lists = cut_lineage(lists.select(*params))
    sizes = [F.size(p).cast("bigint") for p in params]
    total = sizes[0]
    for size in sizes[1:]:
        total = total * size
    row = lists.select(*[s.alias(f"n{i}") for i, s in enumerate(sizes)], total.alias("total")).first()
    count = 0 if row is None or min(row[:-1]) < 1 else row["total"]
    if max_runs is not None:
        count = min(count, max_runs)
    numbers = lists.sparkSession.range(count).select(F.col("id").alias("_i"), F.lit(1).alias("_one"))
    numbered = numbers.join(F.broadcast(lists.withColumn("_one", F.lit(1))), "_one")
    columns, stride = [], F.lit(1).cast("bigint")
    for name, size in reversed(list(zip(params, sizes))):
        columns.append(F.get(name, F.pmod(F.floor(F.col("_i") / stride), size).cast("int")).alias(name))
        stride = stride * size
    run = F.format_string(prefix + "_%03d", F.col("_i") + 1)
    return numbered.select(run.alias("run_name"), *reversed(columns))


def sweep_summary(*tables: DataFrame) -> DataFrame:
    """Rows of all tables under the union of their columns: run_name first, the rest sorted."""
    merged = tables[0]
    for table in tables[1:]:
        merged = merged.unionByName(table, allowMissingColumns=True)
    return merged.select("run_name", *sorted(c for c in merged.columns if c != "run_name"))


def timing_report(events: DataFrame, timer: Sequence[str] = ("run", "timer_id"), ts: str = "ts", event: str = "timer_event") -> DataFrame:
    """Net and paused seconds, pauses and wall seconds of each timer from start/pause/resume/stop events.

    Running segments lie between start or resume and the next event, pauses between pause and the next
    event. An unfinished timer counts its finished segments and has no wall time.
    """
    order = Window.partitionBy(*timer).orderBy(ts, "arrival")
    at = F.unix_micros(F.col(ts).cast("timestamp"))  # whole microseconds add up exactly
    seconds = lambda c: c / F.lit(1e6)
    stepped = events.withColumn("_t", at).withColumn("_gap", F.lead("_t").over(order) - F.col("_t"))
    kind = F.col(event)
    stop, start = F.max(F.when(kind == "stop", F.col("_t"))), F.min(F.when(kind == "start", F.col("_t")))
    return stepped.groupBy(*timer).agg(
        seconds(F.coalesce(F.sum(F.when(kind.isin("start", "resume"), F.col("_gap"))), F.lit(0))).alias("net_elapsed_sec"),
        seconds(stop - start).alias("wall_elapsed_sec"),
        F.sum((kind == "pause").cast("bigint")).alias("pause_count"),
        seconds(F.coalesce(F.sum(F.when(kind == "pause", F.col("_gap"))), F.lit(0))).alias("total_paused_sec"),
    )


def batch_rollup(log: DataFrame) -> DataFrame:
    """count, ok, failed and skipped (ok in no time) of a batch-processing log."""
    ok = F.col("ok")
    return log.agg(
        F.count(F.lit(1)).alias("count"),
        F.sum(ok.cast("bigint")).alias("ok"),
        F.sum((~ok).cast("bigint")).alias("failed"),
        F.sum((ok & (F.col("duration_sec") == 0)).cast("bigint")).alias("skipped"),
    )


def processing_log(results: DataFrame, config: Mapping[str, Column]) -> DataFrame:
    """Per-file results as log rows: file name, OK or FAIL, saved files and configuration as JSON, time."""
    return results.select(
        F.element_at(F.split("path", "/"), -1).alias("file_name"),
        F.col("path").alias("original_path"),
        F.when(F.col("ok"), "OK").otherwise("FAIL").alias("status"),
        "duration_sec",
        F.col("error").alias("error_message"),
        F.to_json("saved_files").alias("saved_files_json"),
        F.to_json(F.struct(*[c.alias(n) for n, c in config.items()])).alias("config_json"),
        F.current_timestamp().alias("created_at"),
    )


def ablation_table(results: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """One row per experiment with one column per metric; failed ones stay, missing values become 0.0.

    ``results``: experiment, status, metric, value in long form.
    """
    wide = results.groupBy("experiment").pivot("metric", list(metrics)).agg(F.avg("value"))
    status = results.groupBy("experiment").agg(F.min("status").alias("status"))  # failed sorts before success
    return wide.fillna(0.0, list(metrics)).join(status, "experiment")


def curves(log: DataFrame, series: Sequence[str]) -> DataFrame:
    """(run, epoch, series, value) without the missing points."""
    columns = [F.col(c).cast("double").alias(c) for c in series]
    return log.select("run", "epoch", *columns).unpivot(["run", "epoch"], list(series), "series", "value").where("value is not null")


def checkpoint_retention(scored: DataFrame, freq: int) -> DataFrame:
    """(run, epoch, is_last, is_periodic, is_best) of the kept checkpoints: the last, every freq-th and the best."""
    best = best_of_run(scored).select("run", "best_epoch")
    last = scored.groupBy("run").agg(F.max("epoch").alias("last_epoch"))
    # One row per run: broadcast by Spark when its measured size allows.
    flagged = scored.select("run", "epoch").join(best.join(last, "run"), "run").select(
        "run",
        "epoch",
        (F.col("epoch") == F.col("last_epoch")).alias("is_last"),
        (F.col("epoch") % freq == 0).alias("is_periodic"),
        (F.col("epoch") == F.col("best_epoch")).alias("is_best"),
    )
    return flagged.where("is_last or is_periodic or is_best")


def latest_checkpoint(files: DataFrame, directory: Column, name: Column) -> DataFrame:
    """(directory, latest): checkpoint_last where it exists, else the highest epoch."""
    epoch = F.regexp_extract(name, r"^checkpoint_epoch_([0-9]+)\.pth$", 1)
    rank = F.when(name == "checkpoint_last.pth", F.lit(1 << 40)).otherwise(F.nullif(epoch, F.lit("")).cast("bigint"))
    picked = files.select(directory.alias("directory"), name.alias("name"), rank.alias("_r")).where("_r is not null")
    return picked.groupBy("directory").agg(F.max_by("name", "_r").alias("latest"))


def periodic_eval(log: DataFrame, freq: int, value: str = "val_loss", first: float = 0.0) -> DataFrame:
    """Evaluate on every freq-th and the final epoch of a run; between evaluations the last value is carried."""
    final = log.groupBy("run").agg(F.max("epoch").alias("_final"))
    due = (F.col("epoch") % freq == 0) | (F.col("epoch") == F.col("_final"))
    marked = log.join(final, "run").withColumn("evaluated", due).drop("_final")
    shown = marked.withColumn("_v", F.when(F.col("evaluated"), F.col(value)))
    carried = bucketed_running(shown, ["run"], _bucket(), "epoch", "_v", "last", "carried")
    return carried.withColumn("carried", F.coalesce("carried", F.lit(first))).drop("_v")
