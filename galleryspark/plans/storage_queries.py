"""Queries over stores, reports, embedding jobs, extension points and streams.

Whatever they write goes to a new folder beside the session's checkpoints and is read back.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from galleryspark.operators import embedding as N, extensions as X, raster as R, retrieval as Q, evaluation as E
from galleryspark.operators.curation import build_validation_sets
from galleryspark.plans.curation_queries import CURATED_SQL, curated
from galleryspark.plans.evaluation_queries import ORACLE as EVALUATION_SQL
from galleryspark.plans.fixtures import emb, files, gal, gal_rows, log, ras, rounded, sql, table
from galleryspark.plans.raster_sql import THRESHOLDS, STATS, components
from galleryspark.sources import files as SF, labels as L, reports as P, store as S
from galleryspark.streaming import jobs as J
from galleryspark.session import work_folder


def a1_scan_files(spark, sf):
    """The paths of all drawings, written as text files below a folder per category and found again by a listing."""
    folder = work_folder(spark, "files")
    gal(spark, sf).select("category", "path").write.partitionBy("category").text(folder)
    found = SF.scan_files(spark, [folder], suffixes=(".txt",))
    folder_name = F.element_at(F.split("path", "/"), -2)
    return found.groupBy(folder_name.alias("folder")).agg(F.sum("length").alias("bytes"))


def a3_scan_archive(spark, sf):
    """Documents packed into archives of about a hundred and listed again."""
    docs = table(spark, sf, "documents")
    rows = docs.select(
        F.concat(F.lit("pack_"), F.floor(F.col("doc_id") / 100).cast("string"), F.lit(".zip")).alias("archive"),
        F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("member"),
        F.encode("text", "utf-8").alias("content"),
    )
    return SF.list_members(SF.pack_archives(rows)).select("archive", "member", "size", F.md5("content").alias("md5"))


def a5_read_label_map(spark, sf):
    """A label CSV with and one without a header."""
    rows = gal(spark, sf).select("path", F.col("category").alias("label"))
    plain, headed = work_folder(spark, "labels"), work_folder(spark, "labels")
    rows.write.csv(plain)
    rows.write.option("header", True).csv(headed)
    read = lambda path, kind: L.read_label_map(spark, path).withColumn("kind", F.lit(kind))
    return read(plain, "plain").unionByName(read(headed, "headed"))


def a6_write_report(spark, sf):
    """Per-class statistics through all three report formats."""
    report = emb(spark, sf).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.max("vec_id").alias("last"))
    out = None
    for fmt in ("json", "csv", "parquet"):
        path = work_folder(spark, "report")
        P.write_report(report, path, fmt)
        ordered = report.select(*sorted(report.columns)) if fmt == "csv" else report
        back = P.read_report(spark, path, fmt, ordered.schema).select("label", "n", "last").withColumn("fmt", F.lit(fmt))
        out = back if out is None else out.unionByName(back)
    return out


def _records(df, number):
    """Gallery rows with the metadata the store asks for."""
    return df.select(
        "id", "embedding", F.element_at(F.split("path", "/"), -1).alias("original_filename"), F.lit(number).alias("page_num"),
        "component_type", "parent_pdf_id", "category", "path",
    )


def a7_upsert_vectors(spark, sf):
    """All records, then every third again with another page number, then every fifth."""
    g = gal(spark, sf)
    store = S.VectorStore(spark, work_folder(spark, "store"))
    store.append(_records(g, 1), 0)
    store.append(_records(g.where("vec_id % 3 = 0"), 2), 1)
    store.append(_records(g.where("vec_id % 5 = 0"), 3), 2)
    return store.current().select("id", "version", "page_num", "parent_pdf_id", F.size("embedding").alias("dim"))


def a7_interleaved_streams(spark, sf):
    """Stream A, then B, then A again, then B's batch once more: the newest write of an id counts."""
    g = gal(spark, sf)
    store = S.VectorStore(spark, work_folder(spark, "store"))
    store.append_batch(_records(g, 1), "a", 0)
    store.append_batch(_records(g.where("vec_id % 3 = 0"), 2), "b", 0)
    store.append_batch(_records(g.where("vec_id % 2 = 0"), 3), "a", 1)
    store.append_batch(_records(g.where("vec_id % 3 = 0"), 2), "b", 0)
    return store.current().select("id", "version", "page_num")


def a11_tags(spark, sf):
    """Blank and unreadable rasters get tags; files with the tag error are set aside."""
    pixels = ras(spark, sf).where("image_id % 9 <> 0")
    status = R.quality_status(emb(spark, sf).select(F.col("vec_id").alias("image_id")), pixels)
    tags = F.when(F.col("status") == "corrupted", F.array(F.lit("error"), F.lit("corrupted"))).otherwise(F.array().cast("array<string>"))
    path = F.concat(F.lit("/img/"), F.col("image_id").cast("string"), F.lit(".png"))
    named = status.select(path.alias("path"), F.col("image_id"), tags.alias("tags"))
    return L.quarantine_by_tag(L.export_tags(named), named.where("image_id % 2 = 0"))


def a12_split_manifest(spark, sf):
    """The curated split written and read back: members of the sets and of the ground truth."""
    parts = curated(spark, sf)
    path = work_folder(spark, "split")
    P.write_split_manifest(build_validation_sets(*parts), parts[3], path)
    sets, truth = P.read_split_manifest(spark, path)
    return sets.select("part", F.lit(None).cast("string").alias("seed"), "path").unionByName(
        truth.select(F.lit("gt").alias("part"), "seed", F.col("member").alias("path"))
    )


def a13_append_training_log(spark, sf):
    """The log appended in two halves, the second with one more column."""
    rows = log(spark, sf).select("run", "epoch", "arrival", "train_loss", "val_loss")
    path = work_folder(spark, "training-log")
    P.append_training_log(rows.where("arrival % 2 = 0"), path)
    P.append_training_log(rows.where("arrival % 2 = 1").withColumn("macro_map", F.col("val_loss") / 2), path)
    return rounded(P.read_training_log(spark, path), "train_loss", "val_loss", "macro_map")


def b12_flatten_config(spark, sf):
    """One nested configuration per run, as dotted columns and as a map."""
    runs = log(spark, sf).groupBy("run").agg(F.max("epoch").alias("epochs"), F.count(F.lit(1)).alias("rows"))
    nested = runs.select("run", F.struct("epochs", F.struct("rows", F.repeat("run", 40).alias("note")).alias("log")).alias("training"))
    flat = P.flatten_config(nested, 250)
    return flat.select(F.col("run"), F.col("`training.epochs`").alias("epochs"), F.col("`training.log.rows`").alias("n"), F.col("`training.log.note`").alias("note"))


def b12_config_map(spark, sf):
    runs = log(spark, sf).groupBy("run").agg(F.max("epoch").alias("epochs"))
    nested = runs.select("run", F.struct("epochs").alias("training"))
    return P.config_map(P.flatten_config(nested)).select(F.explode("params").alias("key", "value"))


def e8_index_components(spark, sf):
    """Component gallery of all rasters; every ninth page is unreadable and skipped."""
    pages = emb(spark, sf).select(F.col("vec_id").alias("image_id"), F.concat(F.lit("/pages/c"), (F.col("vec_id") % 4).cast("string"), F.lit("/P"), F.col("vec_id").cast("string"), F.lit(".png")).alias("path"))
    gallery = N.index_components(pages, ras(spark, sf).where("image_id % 9 <> 0"), X.EMBEDDERS.get("cosine_projection", dim=4))
    store = S.VectorStore(spark, work_folder(spark, "store"))
    store.append(gallery, 0)
    out = store.current().select("id", "parent_pdf_id", "component_type", "category", "area", F.array_join("bbox", ",").alias("bbox"), F.element_at("embedding", 1).alias("e1"))
    return rounded(out, "e1")


def e8_indexing_report(spark, sf):
    pages = emb(spark, sf).select(F.col("vec_id").alias("image_id"), F.concat(F.lit("/pages/P"), F.col("vec_id").cast("string"), F.lit(".png")).alias("path"))
    gallery = N.index_components(pages, ras(spark, sf).where("image_id % 9 <> 0"), X.EMBEDDERS.get("cosine_projection", dim=4))
    return N.indexing_report(pages, gallery.select("path"))


def e9_embed(spark, sf):
    """Vectors of all rasters; every seventh image is damaged and becomes a zero vector."""
    images = N.images_from_pixels(ras(spark, sf)).withColumn("px", F.when(F.col("image_id") % 7 != 0, F.col("px")))
    vectors = N.embed(images, X.EMBEDDERS.get("cosine_projection", dim=8))
    return rounded(vectors.select("image_id", F.posexplode("embedding").alias("pos", "e")), "e")


def m1_python_strategy(spark, sf):
    """Documents scored by the mean of their two best matches, a rule in Python."""
    g = gal(spark, sf)
    components_ = g.select(F.col("parent_pdf_id").alias("query_doc"), F.col("id").alias("query_id"), "embedding")
    best_two = X.pandas_strategy(lambda scores, kinds: scores.sort_values(ascending=False).head(2).mean())
    found = Q.retrieve_documents(components_, g, 5, best_two, with_details=False)
    return rounded(found.select("query_doc", "parent_pdf_id", "score", "accumulated_matches", F.col("rank").cast("int").alias("rank")), "score")


def m2_evaluator(spark, sf):
    """Metrics by the evaluator registered as grouped, as metric rows."""
    df = emb(spark, sf).withColumn("label", F.when(F.col("label") == 9, F.lit(-1)).otherwise(F.col("label")))
    return rounded(E.unpivot_metrics(X.EVALUATORS.get("grouped", n_groups=9)(df)), "value")


def m4_filter_and_extract(spark, sf):
    steps = [X.FILTERS.get("suffixes"), X.FILTERS.get("artifacts"), X.EXTRACTORS.get("artifacts", category="sheet")]
    return X.apply(files(spark, sf), *steps).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def _table_stream(spark, sf, name):
    """A table as a stream, whether it is one file or a folder of files: as a pattern its path may name either."""
    return J.read_parquet_stream(spark, f"{sf}/{name}.parque[t]", table(spark, sf, name).schema)


def _event_stream(spark, sf):
    return _table_stream(spark, sf, "events")


def l1_stream_index(spark, sf):
    """All vectors streamed into a store as gallery records."""
    store = S.VectorStore(spark, work_folder(spark, "store"))
    stream = _table_stream(spark, sf, "embeddings")
    J.stream_index(stream, store, work_folder(spark, "stream"), lambda batch: _records(gal_rows(batch), 1)).awaitTermination()
    return store.current().select("id", "category", "component_type", "parent_pdf_id", F.size("embedding").alias("dim"))


def _monitor_rows(events):
    return events.select("ts", F.concat(F.lit("run_"), (F.col("user_id") % 6).cast("string")).alias("run"), (F.col("value") / 5000).alias("z_std"))


def _texts(df, *columns):
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in columns})


THRESHOLD = 0.009


def l2_stream_monitor(spark, sf):
    stream = J.stream_training_monitor(_monitor_rows(_event_stream(spark, sf)), F.col("z_std"), THRESHOLD, "3 hours")
    path = work_folder(spark, "monitor")
    J.run_to_parquet(stream, path, work_folder(spark, "stream"))
    return rounded(_texts(spark.read.schema(stream.schema).parquet(path), "window_start", "window_end"), "mean_std")


def l2_batch_monitor(spark, sf):
    windows = J.monitor_windows(_monitor_rows(table(spark, sf, "events")), "3 hours", F.col("z_std"))
    return rounded(_texts(windows.where(F.col("mean_std") < THRESHOLD), "window_start", "window_end"), "mean_std")


def _samples(events):
    return events.select("ts", (F.col("user_id") % 20).alias("host"), "value")


def l3_stream_windows(spark, sf):
    stream = J.stream_resource_windows(_samples(_event_stream(spark, sf)), "2 hours", "1 hour")
    path = work_folder(spark, "windows")
    J.run_to_parquet(stream, path, work_folder(spark, "stream"))
    return rounded(_texts(spark.read.schema(stream.schema).parquet(path), "window_start", "window_end"), "mean", "max")


def l3_batch_windows(spark, sf):
    return rounded(_texts(J.resource_windows(_samples(table(spark, sf, "events")), "2 hours", "1 hour"), "window_start", "window_end"), "mean", "max")


def l3_stream_sessions(spark, sf):
    stream = J.stream_activity_sessions(_samples(_event_stream(spark, sf)), "1 hour")
    path = work_folder(spark, "sessions")
    J.run_to_parquet(stream, path, work_folder(spark, "stream"))
    return rounded(_texts(spark.read.schema(stream.schema).parquet(path), "session_start", "session_end"), "max")


def l3_batch_sessions(spark, sf):
    return rounded(_texts(J.activity_sessions(_samples(table(spark, sf, "events")), "1 hour"), "session_start", "session_end"), "max")


def _in_batches(spark, sf, partial, keep):
    """Partial results of the events, streamed in four batches that each hold rows of all times."""
    events = keep(table(spark, sf, "events"))
    folder, path = work_folder(spark, "events"), work_folder(spark, "partials")
    events.repartition(4, F.xxhash64("ts", "value")).write.parquet(folder)
    files = len(spark.read.parquet(folder).inputFiles())  # the session may cut the rows into more files than asked for
    stream = J.read_parquet_stream(spark, folder, events.schema, files_per_batch=-(-files // 4))
    J.stream_partials(stream, partial, path, work_folder(spark, "stream"))
    return spark.read.parquet(path).drop("batch")


def l2_stream_monitor_whole(spark, sf):
    """The monitor with every window, those still open at the end included. Means of a few values often lie halfway
    between two numbers of 6 digits, so 12 are shown."""
    partials = _in_batches(spark, sf, lambda rows: J.partial_windows(rows, "run", F.col("z_std"), "3 hours"), _monitor_rows)
    whole = J.whole_windows(partials, "run").withColumnRenamed("mean", "mean_std").drop("max")
    return rounded(_texts(whole.where(F.col("mean_std") < THRESHOLD), "window_start", "window_end"), "mean_std", digits=12)


def l3_stream_windows_whole(spark, sf):
    partials = _in_batches(spark, sf, lambda rows: J.partial_windows(rows, "host", F.col("value"), "2 hours", "1 hour"), _samples)
    return rounded(_texts(J.whole_windows(partials, "host"), "window_start", "window_end"), "mean", "max")


def l3_stream_sessions_whole(spark, sf):
    partials = _in_batches(spark, sf, lambda rows: J.activity_sessions(rows, "1 hour"), _samples)
    return rounded(_texts(J.whole_sessions(partials), "session_start", "session_end"), "max")


QUERIES = {
    "a1_scan_files": a1_scan_files,
    "a3_scan_archive": a3_scan_archive,
    "a5_read_label_map": a5_read_label_map,
    "a6_write_report": a6_write_report,
    "a7_upsert_vectors": a7_upsert_vectors,
    "a7_interleaved_streams": a7_interleaved_streams,
    "a11_tags": a11_tags,
    "a12_split_manifest": a12_split_manifest,
    "a13_append_training_log": a13_append_training_log,
    "b12_flatten_config": b12_flatten_config,
    "b12_config_map": b12_config_map,
    "e8_index_components": e8_index_components,
    "e8_indexing_report": e8_indexing_report,
    "e9_embed": e9_embed,
    "m1_python_strategy": m1_python_strategy,
    "m2_evaluator": m2_evaluator,
    "m4_filter_and_extract": m4_filter_and_extract,
    "l1_stream_index": l1_stream_index,
    "l2_stream_monitor": l2_stream_monitor,
    "l2_batch_monitor": l2_batch_monitor,
    "l3_stream_windows": l3_stream_windows,
    "l3_batch_windows": l3_batch_windows,
    "l3_stream_sessions": l3_stream_sessions,
    "l3_batch_sessions": l3_batch_sessions,
    "l2_stream_monitor_whole": l2_stream_monitor_whole,
    "l3_stream_windows_whole": l3_stream_windows_whole,
    "l3_stream_sessions_whole": l3_stream_sessions_whole,
}

_FMT = "'%Y-%m-%d %H:%M:%S'"
_DONE = "(select max(ts) - interval 10 minutes from events)"
_MONITOR = f"""w as (select concat('run_', user_id % 6) as run, time_bucket(interval 3 hours, ts, timestamp '1970-01-01') as s, avg(value / 5000) as m, count(*) as n from events group by 1, 2)"""
_MONITOR_OUT = f"select run, strftime(s, {_FMT}) as window_start, strftime(s + interval 3 hours, {_FMT}) as window_end, round(m, 6) as mean_std, n from w where m < {THRESHOLD}"
_WINDOWS = """w as (select user_id % 20 as host, time_bucket(interval 1 hour, ts, timestamp '1970-01-01') - k * interval 1 hour as s, count(*) as n, avg(value) as mean, max(value) as max
 from events, range(0, 2) t(k) group by 1, 2)"""
_WINDOWS_OUT = f"select host, strftime(s, {_FMT}) as window_start, strftime(s + interval 2 hours, {_FMT}) as window_end, n, round(mean, 6) as mean, round(max, 6) as max from w"
_SESSIONS = """e as (select user_id % 20 as host, ts, value, coalesce(ts - lag(ts) over (partition by user_id % 20 order by ts) >= interval 1 hour, true) as fresh from events),
 n as (select *, sum(cast(fresh as int)) over (partition by host order by ts rows unbounded preceding) as no from e),
 s as (select host, min(ts) as a, max(ts) + interval 1 hour as b, count(*) as n, max(value) as m from n group by host, no)"""
_SESSIONS_OUT = f"select host, strftime(a, {_FMT}) as session_start, strftime(b, {_FMT}) as session_end, n, round(m, 6) as max from s"
_MINORITY = THRESHOLDS + """, side as (select image_id, count(*) - count(*) filter (fg) as w, count(*) filter (fg) as b, count(*) as n from bin group by 1),
 fgpx as (select image_id, y, x from bin join side using (image_id) where image_id % 9 <> 0
 and fg <> (w > 0 and w < n * 0.95 and (not (b > 0 and b < n * 0.95) or w < b))), """ + components("comp", "fgpx", 8)
_CROPS = """top as (select *, row_number() over (partition by image_id order by bbox_area desc, label) - 1 as i from stats),
 crops as (select t.image_id, i, t.x, t.y, w, h, bbox_area, r.v, row_number() over (partition by t.image_id, i order by r.y, r.x) as j from top t join ras r on r.image_id = t.image_id
 and r.x >= greatest(0, t.x - 2) and r.x < least(8, t.x + w + 2) and r.y >= greatest(0, t.y - 2) and r.y < least(8, t.y + h + 2) where i < 5),
 dims as (select image_id, i, x, y, w, h, bbox_area, d, sum(v / 255.0::double * cos(j * d)) as e from crops, range(1, 5) t(d) group by all),
 norms as (select image_id, i, sqrt(sum(e * e)) as len from dims group by 1, 2)"""
_COS = "list_dot_product(p.e, g.e) / (greatest(sqrt(list_dot_product(p.e, p.e)), 1e-12) * greatest(sqrt(list_dot_product(g.e, g.e)), 1e-12))"

ORACLE = {
    "a1_scan_files": sql("gal") + "select concat('category=', category) as folder, sum(strlen(path) + 1)::bigint as bytes from gal group by category",
    "a3_scan_archive": """select concat('pack_', cast(floor(doc_id / 100) as bigint), '.zip') as archive, concat(source, '/', doc_id, '.txt') as member,
 strlen(text) as size, md5(text) as md5 from documents""",
    "a5_read_label_map": sql("gal") + "select path, category as label, 'plain' as kind from gal union all select path, category, 'headed' from gal",
    "a6_write_report": """select label, count(*) as n, max(vec_id) as last, fmt from embeddings, (values ('json'), ('csv'), ('parquet')) f(fmt) group by label, fmt""",
    "a7_upsert_vectors": sql("gal")
    + """select id, case when vec_id % 5 = 0 then 2 when vec_id % 3 = 0 then 1 else 0 end as version, case when vec_id % 5 = 0 then 3 when vec_id % 3 = 0 then 2 else 1 end as page_num,
 parent_pdf_id, cast(len(embedding) as int) as dim from gal""",
    "a7_interleaved_streams": sql("gal")
    + """select id, case when vec_id % 2 = 0 then 2 when vec_id % 3 = 0 then 1 else 0 end as version,
 case when vec_id % 2 = 0 then 3 when vec_id % 3 = 0 then 2 else 1 end as page_num from gal""",
    "a11_tags": "select concat('/img/', vec_id, '.png') as path, case when vec_id % 2 = 0 then 'move' else 'not_found' end as action from embeddings where vec_id % 9 = 0",
    "a12_split_manifest": sql("gal", more=CURATED_SQL) + "select part, null::varchar as seed, path from sets union all select 'gt', seed, member from truth",
    "a13_append_training_log": sql("log")
    + """select run, epoch, arrival, round(train_loss, 6) as train_loss, round(val_loss, 6) as val_loss, case when arrival % 2 = 1 then round(val_loss / 2, 6) end as macro_map from log""",
    "b12_flatten_config": sql("log")
    + "select run, cast(max(epoch) as varchar) as epochs, cast(count(*) as varchar) as n, substr(repeat(run, 40), 1, 250) as note from log group by run",
    "b12_config_map": sql("log")
    + "select 'run' as key, run as value from log group by run union all select 'training.epochs', cast(max(epoch) as varchar) from log group by run",
    "e8_index_components": sql("ras", more=f"{_MINORITY}, {STATS}, {_CROPS}", recursive=True)
    + """select concat('P', image_id, '_roi_', i) as id, concat('P', image_id) as parent_pdf_id, concat('roi_', i) as component_type, concat('c', image_id % 4) as category,
 bbox_area as area, concat_ws(',', x, y, w, h) as bbox, round(e / greatest(len, 1e-12), 6) as e1 from dims join norms using (image_id, i) where d = 1""",
    "e8_indexing_report": sql("ras", more=f"{_MINORITY}, {STATS}", recursive=True)
    + """select count(*) as pages, count(*) filter (vec_id % 9 <> 0) as indexed, count(*) filter (vec_id % 9 = 0) as skipped,
 (select sum(least(n, 5))::bigint from (select count(*) as n from stats group by image_id)) as components from embeddings""",
    "e9_embed": sql("ras", more="""dims as (select image_id, d, sum(case when image_id % 7 = 0 then 0 else v / 255.0::double * cos((y * 8 + x + 1) * d) end) as e from ras, range(1, 9) t(d) group by 1, 2),
 norms as (select image_id, greatest(sqrt(sum(e * e)), 1e-12) as len from dims group by 1)""")
    + "select image_id, cast(d - 1 as int) as pos, round(e / len, 6) as e from dims join norms using (image_id)",
    "m1_python_strategy": sql("gal", more=f"""w as (select id, parent_pdf_id, embedding::double[] as e from gal),
 near as (select * from (select *, row_number() over (partition by query_id order by round(1 - s, 12), id) as place from (
 select p.parent_pdf_id as query_doc, p.id as query_id, g.id, g.parent_pdf_id, {_COS} as s from w p, w g)) where place <= 5),
 two as (select *, row_number() over (partition by query_doc, parent_pdf_id order by s desc) as t from near),
 scored as (select query_doc, parent_pdf_id, avg(s) filter (t <= 2) as score, count(*) as accumulated_matches from two group by 1, 2),
 ranked as (select *, row_number() over (partition by query_doc order by round(score, 9) desc, parent_pdf_id) as place from scored)""")
    + "select query_doc, parent_pdf_id, round(score, 6) as score, accumulated_matches, cast(place as int) as rank from ranked where place <= 5",
    "m2_evaluator": "select metric, value from (unpivot ("
    + EVALUATION_SQL["f8_group_metrics"].replace("sum(x) / 50", "sum(x) / 9")
    + ") on columns(*) into name metric value value)",
    "m4_filter_and_extract": sql("files")
    + """select case when contains(path, 'large_components') then 'large_component' when contains(path, '_merged') then 'merged' else 'random_sample' end as tag, count(*) as n
 from files where doc_id % 6 in (0, 1, 3) group by 1""",
    "l1_stream_index": sql("gal") + "select id, category, component_type, parent_pdf_id, cast(len(embedding) as int) as dim from gal",
    "l2_stream_monitor": sql(more=_MONITOR) + _MONITOR_OUT + f" and s + interval 3 hours <= {_DONE}",
    "l2_batch_monitor": sql(more=_MONITOR) + _MONITOR_OUT,
    "l3_stream_windows": sql(more=_WINDOWS) + _WINDOWS_OUT + f" where s + interval 2 hours <= {_DONE}",
    "l3_batch_windows": sql(more=_WINDOWS) + _WINDOWS_OUT,
    "l3_stream_sessions": sql(more=_SESSIONS) + _SESSIONS_OUT + f" where b <= {_DONE}",
    "l3_batch_sessions": sql(more=_SESSIONS) + _SESSIONS_OUT,
    "l2_stream_monitor_whole": sql(more=_MONITOR) + _MONITOR_OUT.replace("round(m, 6)", "round(m, 12)"),
    "l3_stream_windows_whole": sql(more=_WINDOWS) + _WINDOWS_OUT,
    "l3_stream_sessions_whole": sql(more=_SESSIONS) + _SESSIONS_OUT,
}
