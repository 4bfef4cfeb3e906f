"""Queries over the file inventory."""

from __future__ import annotations

from pyspark.sql import functions as F

from galleryspark.functions import text as T
from galleryspark.operators import inventory as I
from galleryspark.operators.ordering import position_map
from galleryspark.operators.retrieval import filter_candidates
from galleryspark.operators.knn import candidate_pool
from galleryspark.plans.fixtures import files, gal, log, rounded, sql

ROOT = "/workspace/data"


def a1_select_files(spark, sf):
    listing = files(spark, sf).select("path", "length")
    return I.select_files(listing.unionByName(listing.where(F.col("length") > 1000)))


def a2_path_columns(spark, sf):
    return I.with_path_columns(files(spark, sf).select("path"), ROOT)


def a4_manifest_first_page(spark, sf):
    return I.page_manifest(files(spark, sf), "first_page", ROOT, "/out")


def a4_manifest_all_pages(spark, sf):
    return I.page_manifest(files(spark, sf), "all_pages", ROOT, "/out", preserve_structure=False)


def a8_position_map(spark, sf):
    return position_map(files(spark, sf).select("path", "doc_id"), ["path", "doc_id"]).select("path", "doc_id", "position")


def a9_pending(spark, sf):
    """Two markers: merged images, and files whose text is longer than 2000 characters."""
    f = files(spark, sf).select("path", "length")
    return I.pending(f, f.where(F.col("path").endswith("_merged.png")), f.where(F.col("length") > 2000))


def a14_directory_rollup(spark, sf):
    return I.directory_rollup(files(spark, sf), ROOT)


def b1_filename_template(spark, sf):
    f = files(spark, sf)
    return f.groupBy(T.filename_template(F.col("path")).alias("template")).agg(F.count(F.lit(1)).alias("n"))


def b2_segment_count(spark, sf):
    return files(spark, sf).select("doc_id", T.segment_count(F.col("path")).alias("segments"))


def b3_class_from_prefix(spark, sf):
    return files(spark, sf).select("doc_id", T.class_from_prefix(T.stem(F.col("path"))).alias("prefix"))


def b4_artifact_filter(spark, sf):
    return files(spark, sf).where(T.is_artifact(F.col("path"))).select("path")


def b5_artifact_metadata(spark, sf):
    return I.artifacts(files(spark, sf), "sheet").drop("created_at")


def b6_paths(spark, sf):
    local = T.local_path(F.translate(F.col("path"), "/", "\\"), "/home/user/data")
    df = files(spark, sf).select("doc_id", local.alias("local"))
    return df.withColumn("canonical", T.canonical_path(F.col("local"), "/home/user/data"))


def b7_parse_run_names(spark, sf):
    """Run, experiment and checkpoint names of every log row, parsed and built again."""
    rows = log(spark, sf)
    named = rows.select(
        "arrival", "run", "epoch", F.concat(F.lit("simsiam_exp_"), F.date_format("ts", "yyyyMMdd_HHmmss")).alias("experiment")
    )
    parsed = T.parse_run_name(F.col("run"))
    return named.select(
        "arrival",
        parsed["run_no"].alias("run_no"),
        parsed["seed"].alias("seed"),
        T.run_name(parsed["run_no"], parsed["seed"]).alias("rebuilt"),
        F.date_format(T.experiment_timestamp(F.col("experiment")), "yyyy-MM-dd HH:mm:ss").alias("started"),
        T.checkpoint_name(F.col("epoch")).alias("checkpoint"),
        T.top_k_of(F.concat(F.lit("top"), F.col("epoch").cast("string"), F.lit("_precision"))).alias("k"),
    )


def b8_unique_target_names(spark, sf):
    """Files renamed to their templates, which collide within a class."""
    f = files(spark, sf).select("class", "path", F.concat(T.filename_template(F.col("path")), T.suffix(F.col("path"))).alias("name"))
    return I.flat_name(I.unique_target_names(f, "class", "name"), ROOT)


def b11_filter_candidates(spark, sf):
    """Candidates of each seed with a score and the same name template as the seed."""
    g = gal(spark, sf)
    pool = candidate_pool(g.select(F.col("id").alias("query_id"), "embedding"), g, 30)
    names = g.select("id", F.concat(F.col("category"), F.lit("-"), F.col("id")).alias("name"))
    seeds = names.select(F.col("id").alias("query_id"), F.col("name").alias("seed_name"))
    named = pool.join(names, "id").join(seeds, "query_id")
    kept = filter_candidates(named, 0.1, T.filename_template(F.col("name")), T.filename_template(F.col("seed_name")))
    by_segments = filter_candidates(named, 0.2, T.segment_count(F.col("name")), F.lit(2))
    tag = lambda df, mode: df.select(F.lit(mode).alias("mode"), "query_id", "id", "score")
    return rounded(tag(kept, "template").unionByName(tag(by_segments, "segments")), "score")


QUERIES = {
    "a1_select_files": a1_select_files,
    "a2_path_columns": a2_path_columns,
    "a4_manifest_first_page": a4_manifest_first_page,
    "a4_manifest_all_pages": a4_manifest_all_pages,
    "a8_position_map": a8_position_map,
    "a9_pending": a9_pending,
    "a14_directory_rollup": a14_directory_rollup,
    "b1_filename_template": b1_filename_template,
    "b2_segment_count": b2_segment_count,
    "b3_class_from_prefix": b3_class_from_prefix,
    "b4_artifact_filter": b4_artifact_filter,
    "b5_artifact_metadata": b5_artifact_metadata,
    "b6_paths": b6_paths,
    "b7_parse_run_names": b7_parse_run_names,
    "b8_unique_target_names": b8_unique_target_names,
    "b11_filter_candidates": b11_filter_candidates,
}

_NAME = "split_part(path, '/', -1)"
_STEM = f"regexp_replace({_NAME}, '\\.[^.]*$', '')"
_TEMPLATE = "regexp_replace(regexp_replace(split_part({0}, '.', 1), '\\p{{L}}', 'L', 'g'), '[0-9]', 'D', 'g')"
_PDF = f"""pdfs as (select path, split_part(path, '/', -2) as class_label, {_STEM} as stem, n_pages,
 regexp_extract(replace(path, '/workspace/data/', ''), '^(.*/)?[^/]*$', 1) as dir from files where lower(path) like '%.pdf')"""
_ARTIFACT = f"""(regexp_matches({_NAME}, '^.+_merged\\.png$') or regexp_matches({_NAME}, '^.+_random_(0[1-9]|1[0-9]|20)\\.png$')
 or (split_part(path, '/', -2) = 'large_components' and regexp_matches({_NAME}, '^.+_large_L[0-9]+_area[0-9]+_pad2\\.png$')))"""
_COS = "list_dot_product(p.e, g.e) / (greatest(sqrt(list_dot_product(p.e, p.e)), 1e-12) * greatest(sqrt(list_dot_product(g.e, g.e)), 1e-12))"

ORACLE = {
    "a1_select_files": sql("files") + "select path, length from files where regexp_matches(lower(path), '\\.(png|jpg|jpeg|bmp|tif|tiff|webp)$')",
    "a2_path_columns": sql("files")
    + f"""select path, {_NAME} as filename, {_STEM} as stem, lower(regexp_extract({_NAME}, '\\.[^.]*$')) as suffix,
 split_part(path, '/', -2) as parent, class as class_name from files""",
    "a4_manifest_first_page": sql("files", more=_PDF)
    + "select path as source_pdf, class_label, 0 as page_index, concat('/out/', dir, replace(stem, ' ', '_'), '.png') as image_path from pdfs",
    "a4_manifest_all_pages": sql("files", more=_PDF)
    + """select path as source_pdf, class_label, cast(i as int) as page_index,
 concat('/out/', stem, case when n_pages > 1 then concat('_p', lpad(cast(i as varchar), 3, '0')) else '' end, '.png') as image_path
 from pdfs, range(0, 3) r(i) where i < n_pages""",
    "a8_position_map": sql("files") + "select path, doc_id, row_number() over (order by path, doc_id) - 1 as position from files",
    "a9_pending": sql("files") + "select path, length from files where not (path like '%\\_merged.png' escape '\\') and length <= 2000",
    "a14_directory_rollup": sql("files", more=f"""parts as (select list_slice(string_split(path, '/'), 1, len(string_split(path, '/')) - 1) as p, length from files)""")
    + """select array_to_string(list_slice(p, 1, 3 + d), '/') as directory, cast(d as int) as depth, count(*) as files, sum(length)::bigint as bytes
 from parts, range(0, 9) r(d) where 3 + d <= len(p) group by 1, 2""",
    "b1_filename_template": sql("files") + f"select {_TEMPLATE.format(_NAME)} as template, count(*) as n from files group by 1",
    "b2_segment_count": sql("files") + f"select doc_id, cast(len(string_split({_STEM}, '-')) as int) as segments from files",
    "b3_class_from_prefix": sql("files") + f"select doc_id, split_part({_STEM}, '-', 1) as prefix from files",
    "b4_artifact_filter": sql("files") + f"select path from files where {_ARTIFACT}",
    "b5_artifact_metadata": sql("files")
    + f"""select regexp_replace({_NAME}, '(_merged|_random_[0-9]+|_large_L[0-9]+_area[0-9]+_pad2)\\.png$', '') as id,
 case when split_part(path, '/', -2) = 'large_components' then 'large_component' when contains({_NAME}, '_merged') then 'merged' else 'random_sample' end as tag,
 'sheet' as category, path as source_path from files where {_ARTIFACT}""",
    "b6_paths": sql("files") + "select doc_id, replace(path, '/workspace', '/home/user/data') as local, path as canonical from files",
    "b7_parse_run_names": sql("log")
    + """select arrival, cast(split_part(run, '_', 2) as int) as run_no, cast(split_part(run, '_', 4) as int) as seed, run as rebuilt,
 strftime(ts, '%Y-%m-%d %H:%M:%S') as started, concat('checkpoint_epoch_', lpad(cast(epoch as varchar), greatest(4, length(cast(epoch as varchar)))::int, '0')) as checkpoint, cast(epoch as int) as k from log""",
    "b8_unique_target_names": sql("files", more=f"""named as (select class, path, {_TEMPLATE.format(_NAME)} as t, lower(regexp_extract({_NAME}, '\\.[^.]*$')) as s from files),
 ranked as (select *, row_number() over (partition by class, concat(t, s) order by md5(concat('0:', path)), path) as c from named)""")
    + """select class, path, concat(t, s) as name, case when c = 1 then concat(t, s) else concat(t, '_', c - 1, s) end as target_name,
 replace(replace(path, '/workspace/data/', ''), '/', '_') as flat_name from ranked""",
    "b11_filter_candidates": sql("gal", more=f"""w as (select id, concat(category, '-', id) as name, embedding::double[] as e from gal),
 ranked as (select *, row_number() over (partition by query_id order by round(score, 12) desc, id) as r from (
 select p.id as query_id, g.id, p.name as seed_name, g.name as name, {_COS} as score from w p join w g on p.id <> g.id)),
 pool as (select * from ranked where r <= 30)""")
    + f"""select 'template' as mode, query_id, id, round(score, 6) as score from pool where score >= 0.1
 and {_TEMPLATE.format('name')} = {_TEMPLATE.format('seed_name')}
 union all select 'segments', query_id, id, round(score, 6) from pool where score >= 0.2 and len(string_split(name, '-')) = 2""",
}
