"""Queries over training logs and test-time-augmentation views."""

from __future__ import annotations

from pyspark.sql import functions as F

from galleryspark.operators import experiments as X, tta as T
from galleryspark.plans.fixtures import log, rounded, sql, stage, table, tta
from galleryspark.session import work_folder
from galleryspark.sources.reports import append_processing_log


def _epochs(spark, sf):
    return X.latest_per_epoch(log(spark, sf))


def a10_processing_log(spark, sf):
    saved = F.when(F.col("ok"), F.array(F.concat(F.lit("/out/"), F.col("doc_id").cast("string"), F.lit(".png"))))
    results = stage(spark, sf).withColumn("saved_files", F.coalesce(saved, F.array().cast("array<string>")))
    rows = X.processing_log(results, {"top_n": F.lit(5), "skip_existing": F.lit(True)})
    path = work_folder(spark, "processing-log")
    append_processing_log(rows.where(F.col("status") == "OK"), path)
    append_processing_log(rows.where(F.col("status") == "FAIL"), path)
    return spark.read.parquet(path).drop("created_at")


def j1_best_epochs(spark, sf):
    return rounded(X.best_epochs(_epochs(spark, sf)).select("run", "epoch", "score", "is_best"), "score")


def j1_best_of_run(spark, sf):
    """Best by the default score, and by a callback that scores the spread of the embedding."""
    plain = X.best_of_run(X.best_epochs(_epochs(spark, sf))).withColumn("by", F.lit("loss"))
    spread = X.best_of_run(X.best_epochs(_epochs(spark, sf), F.col("train_z_std"))).withColumn("by", F.lit("spread"))
    return rounded(plain.unionByName(spread), "best_score")


def j2_collapse_alerts(spark, sf):
    return rounded(X.collapse_alerts(log(spark, sf)).select("run", "epoch", "arrival", "train_z_std"), "train_z_std")


def j3_latest_per_epoch(spark, sf):
    return rounded(_epochs(spark, sf).select("run", "epoch", "arrival", "val_loss", "status"), "val_loss")


def j4_run_summary(spark, sf):
    scored = log(spark, sf).withColumn("score", -F.col("val_loss")).withColumn("error", F.when(F.col("status") == "failed", F.concat(F.lit("failed at "), F.col("arrival").cast("string"))))
    return rounded(X.run_summary(scored), "best_score")


def j5_expand_grid(spark, sf):
    """Grid over the distinct market segments, order priorities and return flags of the tables."""
    pick = lambda name, column: table(spark, sf, name).agg(F.array_sort(F.collect_set(column)).alias(column), F.lit(1).alias("_k"))
    lists = pick("customer", "c_mktsegment").join(pick("orders", "o_orderpriority"), "_k").join(pick("lineitem", "l_returnflag"), "_k")
    return X.expand_grid(lists, ["c_mktsegment", "o_orderpriority", "l_returnflag"], "sweep")


def j6_sweep_summary(spark, sf):
    """Summaries of runs with different columns: loss rows and failure rows."""
    rows = log(spark, sf)
    good = rows.where("status = 'success'").groupBy(F.col("run").alias("run_name")).agg(F.min("val_loss").alias("val_loss"), F.max("epoch").alias("epochs"))
    bad = rows.where("status = 'failed'").groupBy(F.concat(F.col("run"), F.lit("_failed")).alias("run_name")).agg(F.count(F.lit(1)).alias("errors"))
    return rounded(X.sweep_summary(good, bad), "val_loss")


def j7_timing_report(spark, sf):
    return rounded(X.timing_report(log(spark, sf)), "net_elapsed_sec", "wall_elapsed_sec", "total_paused_sec")


def j8_batch_rollup(spark, sf):
    return X.batch_rollup(stage(spark, sf))


def j9_ablation_table(spark, sf):
    """Experiments: run and timer cycle modulo 3; the loss of failed rows is missing."""
    name = F.concat(F.col("run"), F.lit("_"), (F.col("timer_id") % 3).cast("string"), F.lit("_"), F.col("timer_event"))
    value = lambda c: F.when(F.col("status") == "success", F.col(c))
    rows = log(spark, sf).select(name.alias("experiment"), "status", value("train_loss").alias("train_loss"), value("val_loss").alias("val_loss"))
    long = rows.unpivot(["experiment", "status"], ["train_loss", "val_loss"], "metric", "value")
    return rounded(X.ablation_table(long, ["train_loss", "val_loss", "macro_map"]), "train_loss", "val_loss", "macro_map")


def j10_curves(spark, sf):
    """Loss and spread curves; the evaluation points exist on every fifth epoch only."""
    points = _epochs(spark, sf).withColumn("eval_loss", F.when(F.col("epoch") % 5 == 0, F.col("val_loss")))
    return rounded(X.curves(points, ["train_loss", "train_z_std", "eval_loss"]), "value")


def j11_checkpoint_retention(spark, sf):
    return X.checkpoint_retention(X.best_epochs(_epochs(spark, sf)), 10)


def j11_latest_checkpoint(spark, sf):
    """Checkpoint files of every run; runs with an even seed have a last file."""
    rows = log(spark, sf)
    name = F.format_string("checkpoint_epoch_%04d.pth", F.col("epoch"))
    files = rows.select("run", name.alias("name")).unionByName(rows.where(F.col("run").rlike("[02468]$")).select("run", F.lit("checkpoint_last.pth").alias("name")))
    return X.latest_checkpoint(files, F.col("run"), F.col("name"))


def j12_periodic_eval(spark, sf):
    out = X.periodic_eval(_epochs(spark, sf), 10).select("run", "epoch", "evaluated", "carried")
    return rounded(out, "carried")


def k1_global_drift(spark, sf):
    return rounded(T.global_drift(tta(spark, sf)), "similarity")


def k2_centroid_gain(spark, sf):
    return rounded(T.centroid_gain(tta(spark, sf)), "sim_gc", "avg_sim_single", "gain")


def k3_strategy_ablation(spark, sf):
    return rounded(T.wide(T.strategy_ablation(tta(spark, sf)), ["s1", "s2", "s3"]), "s1", "s2", "s3")


def k4_strategy_cohesion(spark, sf):
    return rounded(T.strategy_cohesion(tta(spark, sf)), "similarity")


def k5_drift_summary(spark, sf):
    table_ = T.wide(T.strategy_ablation(tta(spark, sf)), ["s1", "s2", "s3"])
    return rounded(T.drift_summary(table_, ["s1", "s2", "s3"]), "median", "q1", "q3", "iqr", "min", "max")


QUERIES = {
    "a10_processing_log": a10_processing_log,
    "j1_best_epochs": j1_best_epochs,
    "j1_best_of_run": j1_best_of_run,
    "j2_collapse_alerts": j2_collapse_alerts,
    "j3_latest_per_epoch": j3_latest_per_epoch,
    "j4_run_summary": j4_run_summary,
    "j5_expand_grid": j5_expand_grid,
    "j6_sweep_summary": j6_sweep_summary,
    "j7_timing_report": j7_timing_report,
    "j8_batch_rollup": j8_batch_rollup,
    "j9_ablation_table": j9_ablation_table,
    "j10_curves": j10_curves,
    "j11_checkpoint_retention": j11_checkpoint_retention,
    "j11_latest_checkpoint": j11_latest_checkpoint,
    "j12_periodic_eval": j12_periodic_eval,
    "k1_global_drift": k1_global_drift,
    "k2_centroid_gain": k2_centroid_gain,
    "k3_strategy_ablation": k3_strategy_ablation,
    "k4_strategy_cohesion": k4_strategy_cohesion,
    "k5_drift_summary": k5_drift_summary,
}

_LATEST = "ep as (select * exclude (p) from (select *, row_number() over (partition by run, epoch order by arrival desc) as p from log) where p = 1)"
_BEST = f"""{_LATEST}, best as (select run, epoch, -val_loss as score, coalesce(-val_loss > max(-val_loss) over (partition by run order by epoch rows between unbounded preceding and 1 preceding), true) as is_best,
 max(epoch) over (partition by run) as last_epoch from ep)"""
_COS = "list_dot_product({0}, {1}) / (greatest(sqrt(list_dot_product({0}, {0})), 1e-12) * greatest(sqrt(list_dot_product({1}, {1})), 1e-12))"
_VIEWS = f"""anchor as (select item, embedding::double[] as a from tta where is_anchor),
 used as (select item, strategy, view_idx, embedding::double[] as v from (select *, max(view_idx) over (partition by item, strategy) as last from tta where not is_anchor)
 where view_idx > 0 or last = 0),
 drift as (select item, strategy, view_idx, {_COS.format('a', 'v')} as s from used join anchor using (item)),
 parts as (select item, unnest(v) as x, unnest(range(0, len(v))) as pos from (select item, v from used union all select item, a from anchor)),
 means as (select item, pos, avg(x) as x from parts group by 1, 2),
 gc as (select item, list(x order by pos) as c from means group by item),
 per as (select item, strategy, avg(s) as s from drift group by 1, 2)"""

ORACLE = {
    "a10_processing_log": sql("stage")
    + """select split_part(path, '/', -1) as file_name, path as original_path, case when ok then 'OK' else 'FAIL' end as status, duration_sec, error as error_message,
 case when ok then '["/out/' || doc_id || '.png"]' else '[]' end as saved_files_json, '{"top_n":5,"skip_existing":true}' as config_json from stage""",
    "j1_best_epochs": sql("log", more=_BEST) + "select run, epoch, round(score, 6) as score, is_best from best",
    "j1_best_of_run": sql("log", more=_LATEST)
    + """select run, arg_min(epoch, (val_loss, epoch)) as best_epoch, round(max(-val_loss), 6) as best_score, 'loss' as by from ep group by run
 union all select run, arg_min(epoch, (-train_z_std, epoch)), round(max(train_z_std), 6), 'spread' from ep group by run""",
    "j2_collapse_alerts": sql("log") + "select run, epoch, arrival, round(train_z_std, 6) as train_z_std from log where train_z_std < 0.01",
    "j3_latest_per_epoch": sql("log", more=_LATEST) + "select run, epoch, arrival, round(val_loss, 6) as val_loss, status from ep",
    "j4_run_summary": sql("log")
    + """select run, count(*) as n, count(*) filter (status = 'success') as succeeded, count(*) filter (status = 'failed') as failed,
 round(max(-val_loss) filter (status = 'success'), 6) as best_score, 'failed at ' || max(arrival) filter (status = 'failed') as error from log group by run""",
    "j5_expand_grid": """with grid as (select c_mktsegment, o_orderpriority, l_returnflag, row_number() over (order by c_mktsegment, o_orderpriority, l_returnflag) as i
 from (select distinct c_mktsegment from customer), (select distinct o_orderpriority from orders), (select distinct l_returnflag from lineitem))
 select concat('sweep_', lpad(cast(i as varchar), 3, '0')) as run_name, c_mktsegment, o_orderpriority, l_returnflag from grid""",
    "j6_sweep_summary": sql("log")
    + """select run as run_name, max(epoch) as epochs, null::bigint as errors, round(min(val_loss), 6) as val_loss from log where status = 'success' group by run
 union all select run || '_failed', null, count(*), null from log where status = 'failed' group by run""",
    "j7_timing_report": sql("log", more="""steps as (select *, epoch_us(lead(ts) over w) - epoch_us(ts) as gap from log window w as (partition by run, timer_id order by ts, arrival))""")
    + """select run, timer_id, round(coalesce(sum(gap) filter (timer_event in ('start', 'resume')), 0) / 1e6, 6) as net_elapsed_sec,
 round((max(epoch_us(ts)) filter (timer_event = 'stop') - min(epoch_us(ts)) filter (timer_event = 'start')) / 1e6, 6) as wall_elapsed_sec,
 count(*) filter (timer_event = 'pause') as pause_count, round(coalesce(sum(gap) filter (timer_event = 'pause'), 0) / 1e6, 6) as total_paused_sec from steps group by run, timer_id""",
    "j8_batch_rollup": sql("stage")
    + "select count(*) as count, count(*) filter (ok) as ok, count(*) filter (not ok) as failed, count(*) filter (ok and duration_sec = 0) as skipped from stage",
    "j9_ablation_table": sql("log")
    + """select run || '_' || (timer_id % 3) || '_' || timer_event as experiment, round(coalesce(avg(train_loss) filter (status = 'success'), 0), 6) as train_loss,
 round(coalesce(avg(val_loss) filter (status = 'success'), 0), 6) as val_loss, 0.0::double as macro_map, min(status) as status from log group by 1""",
    "j10_curves": sql("log", more=_LATEST)
    + """select run, epoch, 'train_loss' as series, round(train_loss, 6) as value from ep where train_loss is not null
 union all select run, epoch, 'train_z_std', round(train_z_std, 6) from ep where train_z_std is not null
 union all select run, epoch, 'eval_loss', round(val_loss, 6) from ep where epoch % 5 = 0 and val_loss is not null""",
    "j11_checkpoint_retention": sql("log", more=_BEST + ", top as (select run, arg_min(epoch, (-score, epoch)) as best_epoch from best group by run)")
    + """select * from (select run, epoch, epoch = last_epoch as is_last, epoch % 10 = 0 as is_periodic, epoch = best_epoch as is_best from best join top using (run))
 where is_last or is_periodic or is_best""",
    "j11_latest_checkpoint": sql("log")
    + """select run as directory, case when regexp_matches(run, '[02468]$') then 'checkpoint_last.pth'
 else concat('checkpoint_epoch_', lpad(cast(max(epoch) as varchar), greatest(4, length(cast(max(epoch) as varchar)))::int, '0'), '.pth') end as latest from log group by run""",
    "j12_periodic_eval": sql("log", more=_LATEST + ", d as (select run, epoch, val_loss, epoch % 10 = 0 or epoch = max(epoch) over (partition by run) as evaluated from ep)")
    + """select run, epoch, evaluated, round(coalesce(last_value(case when evaluated then val_loss end ignore nulls) over (partition by run order by epoch rows unbounded preceding), 0), 6) as carried from d""",
    "k1_global_drift": sql("tta", more=_VIEWS) + "select item, strategy, view_idx, round(s, 6) as similarity from drift",
    "k2_centroid_gain": sql("tta", more=_VIEWS + f", g as (select item, {_COS.format('a', 'c')} as sim_gc from gc join anchor using (item)), m as (select item, avg(s) as m from drift group by item)")
    + "select item, round(sim_gc, 6) as sim_gc, round(m, 6) as avg_sim_single, round(sim_gc - m, 6) as gain from g join m using (item)",
    "k3_strategy_ablation": sql("tta", more=_VIEWS)
    + """select item, round(max(s) filter (strategy = 's1'), 6) as s1, round(max(s) filter (strategy = 's2'), 6) as s2, round(max(s) filter (strategy = 's3'), 6) as s3 from per group by item""",
    "k4_strategy_cohesion": sql("tta", more=_VIEWS)
    + f"select item, strategy, round(avg({_COS.format('c', 'v')}), 6) as similarity from used join gc using (item) group by 1, 2",
    "k5_drift_summary": sql("tta", more=_VIEWS)
    + """select strategy as metric, count(*) as n, round(quantile_cont(s, 0.5), 6) as median, round(quantile_cont(s, 0.25), 6) as q1, round(quantile_cont(s, 0.75), 6) as q3,
 round(quantile_cont(s, 0.75) - quantile_cont(s, 0.25), 6) as iqr, round(min(s), 6) as min, round(max(s), 6) as max from per group by strategy""",
}
