"""Queries over ranking metrics, retrieval reports and pair scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from galleryspark.operators import evaluation as E, knn as K, retrieval as R
from galleryspark.plans.fixtures import emb, gal, rounded, sql

K_LIST = 5
FLOOR = 0.25


def _near(spark, sf, k=K_LIST):
    g = gal(spark, sf)
    return g, K.drop_same_path(K.knn(g.select(F.col("id").alias("query_id"), "embedding"), g, k, metric="cosine"), g, k)


def _report_parts(spark, sf):
    g, near = _near(spark, sf)
    labels = _labelled(spark, sf).select("id", F.col("lookup_label").alias("label"))
    queries = labels.select(F.col("id").alias("query_id"), F.col("label").alias("query_label"))
    return queries, near, labels


def _labelled(spark, sf):
    """Even vectors are in the label map by resolved path, every third by raw path; the rest fall
    back to the parent directory."""
    g = gal(spark, sf).select("id", "vec_id", "path", "category")
    resolved = F.concat(F.lit("/resolved"), F.col("path"))
    first = g.where("vec_id % 2 = 0").select(resolved.alias("path"), F.concat(F.lit("map_"), F.col("category")).alias("label"))
    second = g.where("vec_id % 3 = 0").select("path", F.concat(F.lit("raw_"), F.col("category")).alias("label"))
    return R.with_lookup_label(g.withColumn("resolved_path", resolved), first.unionByName(second))


def f1_lookup_label(spark, sf):
    return _labelled(spark, sf).select("id", "lookup_label")


def f2_retrieval_metrics(spark, sf):
    queries, near, labels = _report_parts(spark, sf)
    out = R.retrieval_metrics(R.per_query_summary(queries, near, labels, K_LIST))
    return rounded(out, "top1_accuracy", "hit_rate_at_k", "mean_precision_at_k", "mean_top1_score")


def f3_per_query_summary(spark, sf):
    queries, near, labels = _report_parts(spark, sf)
    return rounded(R.per_query_summary(queries, near, labels, K_LIST), "top1_score", "precision_at_k")


def f3_per_query_details(spark, sf):
    queries, near, labels = _report_parts(spark, sf)
    flat = R.per_query_details(queries, near, labels).select("query_id", "query_label", F.explode("retrieved").alias("d"))
    return rounded(flat.select("query_id", "query_label", "d.rank", "d.id", "d.label", "d.match", "d.score"), "score")


def f4_precision_at_k(spark, sf):
    return rounded(E.precision_at_k(emb(spark, sf), [1, 5, 10]), "top1_precision", "top5_precision", "top10_precision")


def f5_average_precision(spark, sf):
    return rounded(E.average_precision(emb(spark, sf)), "ap")


def f5_average_precision_blocks(spark, sf):
    """The same over cells of 128 vectors, so that score bins of many blocks add up and mixed ones are refined."""
    return rounded(E.average_precision(emb(spark, sf), cell_rows=128), "ap")


def f6_macro_map(spark, sf):
    return rounded(E.macro_map(E.average_precision(emb(spark, sf))), "macro_map")


def f7_class_margin(spark, sf):
    return rounded(E.class_margin(emb(spark, sf)), "iacs", "inter", "margin")


def f7_loo_metrics(spark, sf):
    """All metrics of the per-item dialect in one row."""
    return rounded(E.loo_metrics(emb(spark, sf)), *METRIC_ORDER)


def _with_distractors(spark, sf):
    return emb(spark, sf).withColumn("label", F.when(F.col("label") == 9, F.lit(-1)).otherwise(F.col("label")))


def f8_group_metrics(spark, sf):
    out = E.group_metrics(_with_distractors(spark, sf))
    return rounded(out, "macro_map", "iacs", "inter", "margin", "top1_accuracy", "top5_accuracy")


def f9_export_pair_scores(spark, sf):
    return rounded(E.export_pair_scores(emb(spark, sf)), "similarity")


def f9_pairs_above(spark, sf):
    return rounded(E.export_pair_scores(emb(spark, sf), min_score=FLOOR), "similarity")


def f9_pair_score_counts(spark, sf):
    return E.pair_score_counts(emb(spark, sf))


def f10_score_distribution(spark, sf):
    return rounded(E.pair_score_distribution(emb(spark, sf)), "density")


def f10_score_summary(spark, sf):
    return rounded(E.pair_score_summary(emb(spark, sf)), "mean", "min", "max", "q1", "median", "q3")


def f10_score_margin(spark, sf):
    return rounded(E.pair_score_margin(emb(spark, sf)), "tp_mean", "fp_mean", "margin")


def _two_evaluations(spark, sf):
    """Raw: the vectors as given; preprocessed: their first half set to zero."""
    raw = emb(spark, sf)
    half = F.transform("embedding", lambda x, i: F.when(i < 32, F.lit(0.0)).otherwise(x.cast("double")))
    return E.loo_metrics(raw), E.loo_metrics(raw.withColumn("embedding", half))


METRIC_ORDER = ["macro_map", "iacs", "inter", "margin", "top1_precision", "top5_precision", "top10_precision"]


def f11_compare_metrics(spark, sf):
    out = E.compare_metrics(*_two_evaluations(spark, sf), METRIC_ORDER)
    return rounded(out.select("metric", "raw", "preprocessed", "delta", F.col("place").cast("int").alias("place")), "raw", "preprocessed", "delta")


def f12_precision_curve(spark, sf):
    return rounded(E.precision_curve(E.precision_at_k(emb(spark, sf), [1, 2, 5, 10, 20])), "value")


QUERIES = {
    "f1_lookup_label": f1_lookup_label,
    "f2_retrieval_metrics": f2_retrieval_metrics,
    "f3_per_query_summary": f3_per_query_summary,
    "f3_per_query_details": f3_per_query_details,
    "f4_precision_at_k": f4_precision_at_k,
    "f5_average_precision": f5_average_precision,
    "f5_average_precision_blocks": f5_average_precision_blocks,
    "f6_macro_map": f6_macro_map,
    "f7_class_margin": f7_class_margin,
    "f7_loo_metrics": f7_loo_metrics,
    "f8_group_metrics": f8_group_metrics,
    "f9_export_pair_scores": f9_export_pair_scores,
    "f9_pairs_above": f9_pairs_above,
    "f9_pair_score_counts": f9_pair_score_counts,
    "f10_score_distribution": f10_score_distribution,
    "f10_score_summary": f10_score_summary,
    "f10_score_margin": f10_score_margin,
    "f11_compare_metrics": f11_compare_metrics,
    "f12_precision_curve": f12_precision_curve,
}


def _loo(source="embeddings", vector="embedding::double[]", tag=""):
    """Every ordered pair with its similarity and its place in the ranking of the query."""
    return f"""v{tag} as (select vec_id, label, {vector} as e from {source}),
 sims{tag} as (select p.vec_id as q, p.label as ql, g.vec_id as g, g.label as gl, round(list_dot_product(p.e, g.e) /
 (greatest(sqrt(list_dot_product(p.e, p.e)), 1e-12) * greatest(sqrt(list_dot_product(g.e, g.e)), 1e-12)), 12) as s
 from v{tag} p join v{tag} g on p.vec_id <> g.vec_id),
 loo{tag} as (select *, row_number() over (partition by q order by s desc, g) as r from sims{tag}),
 rel{tag} as (select *, row_number() over (partition by q order by r) as c from loo{tag} where ql = gl),
 ap{tag} as (select p.vec_id as id, p.label, coalesce(avg(c::double / r), 0) as ap from v{tag} p left join rel{tag} on q = p.vec_id group by 1, 2)"""


def _margins(tag=""):
    return f"""m{tag} as (select avg(a) as iacs, avg(b) as inter from (select q, coalesce(avg(case when ql = gl then s end), 0) as a,
 coalesce(avg(case when ql <> gl then s end), 0) as b from sims{tag} group by q)),
 mm{tag} as (select avg(x) as macro_map from (select avg(ap) as x from ap{tag} group by label))"""


def _precision(ks, tag=""):
    cells = ", ".join(f"avg(m{k}) as top{k}_precision" for k in ks)
    inner = ", ".join(f"sum(case when r <= {k} and ql = gl then 1 else 0 end) / {k}::double as m{k}" for k in ks)
    return f"p{tag} as (select {cells} from (select q, {inner} from loo{tag} group by q))"


_LABELS = """labelled as (select id, case when vec_id % 2 = 0 then concat('map_', category)
 when vec_id % 3 = 0 then concat('raw_', category) else category end as lookup_label from gal)"""
_COSINE = "list_dot_product(p.e, g.e) / (greatest(sqrt(list_dot_product(p.e, p.e)), 1e-12) * greatest(sqrt(list_dot_product(g.e, g.e)), 1e-12))"
_REPORT = f"""{_LABELS}, w as (select id, path, embedding::double[] as e from gal),
 near as (select query_id, id, row_number() over (partition by query_id order by place) as rank, score from (
 select *, row_number() over (partition by query_id order by round(score, 12), id) as place from (
 select p.id as query_id, g.id, p.path = g.path as same, 1 - {_COSINE} as score from w p, w g)) where place <= {K_LIST} and not same),
 hits as (select n.query_id, n.id, n.rank, n.score, q.lookup_label as query_label, l.lookup_label as label,
 cast(q.lookup_label = l.lookup_label as int) as match from near n join labelled q on q.id = n.query_id join labelled l on l.id = n.id),
 per as (select q.id as query_id, q.lookup_label as query_label, max(case when rank = 1 then h.id end) as top1_id,
 max(case when rank = 1 then score end) as top1_score, coalesce(max(case when rank = 1 then match end), 0) as top1_match,
 coalesce(sum(match), 0)::bigint as matches_in_topk, count(h.id) as retrieved,
 coalesce(sum(match) / least({K_LIST}, count(h.id))::double, 0) as precision_at_k
 from labelled q left join hits h on h.query_id = q.id group by 1, 2)"""

_PAIRS = _loo() + ", pairs as (select q, g, s, ql = gl as is_tp from sims)"


def _bins(series, low, width, value):
    return f"""select '{series}' as series, is_tp, bin, n, round(n / (sum(n) over (partition by is_tp) * {width}), 6) as density from (
 select is_tp, cast(least(floor(({value} - ({low})) * {1.0 / width!r}), 98) as bigint) as bin, count(*) as n from nine
 where {value} between {low} and {low + 99 * width} group by 1, 2)"""


_DELTAS = ", ".join(f"('{m}', {i + 1})" for i, m in enumerate(METRIC_ORDER))
_ALL7 = "macro_map, iacs, inter, iacs - inter as margin, top1_precision, top5_precision, top10_precision"

ORACLE = {
    "f1_lookup_label": sql("gal", more=_LABELS) + "select id, lookup_label from labelled",
    "f2_retrieval_metrics": sql("gal", more=_REPORT)
    + """select count(*) as total_queries, sum(cast(retrieved = 0 as bigint))::bigint as queries_without_results, round(avg(top1_match), 6) as top1_accuracy,
 round(avg(case when matches_in_topk > 0 then 1.0 else 0.0 end), 6) as hit_rate_at_k, round(avg(precision_at_k), 6) as mean_precision_at_k,
 round(coalesce(avg(top1_score), 0), 6) as mean_top1_score from per""",
    "f3_per_query_summary": sql("gal", more=_REPORT)
    + """select query_id, query_label, top1_id, round(top1_score, 6) as top1_score, top1_match, matches_in_topk, retrieved,
 round(precision_at_k, 6) as precision_at_k from per""",
    "f3_per_query_details": sql("gal", more=_REPORT)
    + "select query_id, query_label, cast(rank as int) as rank, id, label, match, round(score, 6) as score from hits",
    "f4_precision_at_k": sql(more=_loo() + ", " + _precision([1, 5, 10]))
    + "select round(top1_precision, 6) as top1_precision, round(top5_precision, 6) as top5_precision, round(top10_precision, 6) as top10_precision from p",
    "f5_average_precision": sql(more=_loo()) + "select id, label, round(ap, 6) as ap from ap",
    "f5_average_precision_blocks": sql(more=_loo()) + "select id, label, round(ap, 6) as ap from ap",
    "f6_macro_map": sql(more=_loo() + ", " + _margins()) + "select round(macro_map, 6) as macro_map from mm",
    "f7_class_margin": sql(more=_loo() + ", " + _margins())
    + "select round(iacs, 6) as iacs, round(inter, 6) as inter, round(iacs - inter, 6) as margin from m",
    "f7_loo_metrics": sql(more=_loo() + ", " + _margins() + ", " + _precision([1, 5, 10]))
    + "select " + ", ".join(f"round({m if m != 'margin' else 'iacs - inter'}, 6) as {m}" for m in METRIC_ORDER) + " from m, mm, p",
    "f8_group_metrics": sql(more="e2 as (select vec_id, embedding, case when label = 9 then -1 else label end as label from embeddings), " + _loo("e2"))
    + """select round((select sum(x) / 50 from (select avg(ap) as x from ap where label >= 0 group by label)), 6) as macro_map,
 round(a, 6) as iacs, round(b, 6) as inter, round(a - b, 6) as margin, round(h1, 6) as top1_accuracy, round(h5, 6) as top5_accuracy
 from (select avg(case when ql = gl then s end) as a, avg(case when ql <> gl then s end) as b from sims where ql >= 0 and gl >= 0),
 (select avg(h1) as h1, avg(h5) as h5 from (select q, max(case when r = 1 and ql = gl then 1 else 0 end) as h1,
 max(case when r <= 5 and ql = gl then 1 else 0 end) as h5 from loo where ql >= 0 group by q))""",
    "f9_export_pair_scores": sql(more=_PAIRS) + "select q as query_id, g as id, round(s, 6) as similarity, is_tp from pairs",
    "f9_pairs_above": sql(more=_PAIRS) + f"select q as query_id, g as id, round(s, 6) as similarity, is_tp from pairs where s >= {FLOOR}",
    "f9_pair_score_counts": sql(more=_PAIRS)
    + f"""select q as query_id, is_tp, cast(least(floor((round(s, 9) + 1.0) * ({1.0 / (2.0 / 99)!r})), 98) as bigint) as bin, count(*) as n
 from pairs where round(s, 9) between -1 and 1 group by 1, 2, 3""",
    "f10_score_distribution": sql(more=_PAIRS + """, nine as (select is_tp, sim, sqrt(greatest(0, 2 - 2 * sim)) as dist
 from (select is_tp, round(s, 9) as sim from pairs))""")
    + _bins("similarity", -1.0, 2.0 / 99, "sim") + " union all " + _bins("distance", 0.0, 2.0 / 99, "dist"),
    "f10_score_summary": sql(more=_PAIRS)
    + """select is_tp, count(*) as n, round(avg(s), 6) as mean, round(min(s), 6) as min, round(max(s), 6) as max, round(quantile_cont(s, 0.25), 6) as q1,
 round(quantile_cont(s, 0.5), 6) as median, round(quantile_cont(s, 0.75), 6) as q3 from pairs group by is_tp""",
    "f10_score_margin": sql(more=_PAIRS)
    + """select round(a, 6) as tp_mean, round(b, 6) as fp_mean, round(abs(a - b), 6) as margin
 from (select avg(s) filter (is_tp) as a, avg(s) filter (not is_tp) as b from pairs)""",
    "f11_compare_metrics": sql(
        more=_loo() + ", " + _margins() + ", " + _precision([1, 5, 10]) + ", "
        + _loo(vector="list_concat(list_transform(range(1, 33), lambda i: 0::double), embedding[33:]::double[])", tag="2")
        + ", " + _margins("2") + ", " + _precision([1, 5, 10], "2")
        + f", a as (unpivot (select {_ALL7} from m, mm, p) on columns(*) into name metric value raw)"
        + f", b as (unpivot (select {_ALL7} from m2, mm2, p2) on columns(*) into name metric value preprocessed)"
        + f", o(metric, place) as (values {_DELTAS})"
    )
    + """select metric, round(raw, 6) as raw, round(preprocessed, 6) as preprocessed, round(preprocessed - raw, 6) as delta, place
 from a full join b using (metric) join o using (metric)""",
    "f12_precision_curve": sql(more=_loo())
    + """select cast(k as int) as k, concat('P@', k) as series, round(avg(m), 6) as value from (
 select k, q, sum(case when r <= k and ql = gl then 1 else 0 end) / k::double as m from loo, (values (1), (2), (5), (10), (20)) t(k) group by k, q) group by k""",
}
