"""Queries over vectors: scalar functions, aggregates, neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from galleryspark.functions import vectors as V
from galleryspark.operators import knn as K, retrieval as R, vector_stats as S
from galleryspark.plans.fixtures import emb, gal, rounded, sql, tta
from galleryspark.session import work_folder
from galleryspark.sources.cell_index import CellIndex


def _pairs(spark, sf):
    """Each vector beside its successor: an equi-join on the id."""
    a = emb(spark, sf).select("vec_id", F.col("embedding").alias("a"))
    b = emb(spark, sf).select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return a.join(b, "vec_id")


_PAIRS = """pairs as (select p.vec_id, p.embedding::double[] as a, q.embedding::double[] as b
 from embeddings p join embeddings q on q.vec_id = p.vec_id + 1)"""


def _pair_query(build):
    return lambda spark, sf: rounded(_pairs(spark, sf).select("vec_id", build().alias("value")), "value")


def _pair_sql(expression):
    return sql(more=_PAIRS) + f"select vec_id, round({expression}, 6) as value from pairs"


def c1_l2_normalize(spark, sf):
    unit = emb(spark, sf).select("vec_id", F.posexplode(V.l2_normalize(F.col("embedding"))).alias("pos", "x"))
    return rounded(unit, "x")


def c4_distance(spark, sf):
    df = _pairs(spark, sf).withColumn("distance", V.cosine_distance(F.col("a"), F.col("b")))
    return rounded(df.select("vec_id", "distance", V.similarity_from_distance(F.col("distance")).alias("similarity")), "distance", "similarity")


def c7_losses(spark, sf):
    """View pairs per item: views 0 and 1 as predictions, anchor and view 2 as targets."""
    views = tta(spark, sf)
    pick = lambda cond, name: views.where(cond).select("item", "strategy", F.col("embedding").alias(name))
    anchor = views.where("is_anchor").select("item", F.col("embedding").alias("z1"))
    four = (
        pick("view_idx = 0", "p1").join(pick("view_idx = 1", "p2"), ["item", "strategy"])
        .join(pick("view_idx = 2", "z2"), ["item", "strategy"]).join(anchor, "item")
    )
    c = {n: F.col(n) for n in ("p1", "p2", "z1", "z2")}
    out = four.groupBy("strategy").agg(
        V.negative_cosine(c["p1"], c["z2"]).alias("neg_cosine"),
        V.symmetric_loss(c["p1"], c["p2"], c["z1"], c["z2"]).alias("symmetric_loss"),
    )
    return rounded(out, "neg_cosine", "symmetric_loss")


def c8_require_dim(spark, sf):
    checked = V.require_dim(emb(spark, sf), "embedding", 64)
    return checked.groupBy(F.size("embedding").alias("dim")).agg(F.count(F.lit(1)).alias("n"))


def d1_centroid(spark, sf):
    c = S.centroid(emb(spark, sf), ["label"])
    return rounded(c.select("label", F.posexplode("centroid").alias("pos", "x")), "x")


def d2_collapse_std(spark, sf):
    return rounded(S.collapse_std(emb(spark, sf)), "std")


def d2_two_views(spark, sf):
    """Average over the vectors and a second view of them, the differences of neighbouring coordinates."""
    shifted = F.zip_with("embedding", F.slice("embedding", 2, 63), lambda x, y: x.cast("double") - F.coalesce(y, F.lit(0.0)).cast("double"))
    return rounded(S.collapse_std(emb(spark, sf).withColumn("view", shifted), ["embedding", "view"]), "std")


def d3_collapse_report(spark, sf):
    report = S.collapse_report(emb(spark, sf)).select("std", "ideal_std", "utilisation_pct", "mean_distance", "verdict")
    return rounded(report, "std", "ideal_std", "utilisation_pct", "mean_distance")


def d4_pairwise_distance_stats(spark, sf):
    stats = S.pairwise_distance_stats(emb(spark, sf))
    return rounded(stats, "mean_distance", "std_distance", "min_distance", "max_distance")


def d5_score_aggregation(spark, sf):
    """Both strategies over all components of a document, scored by their first coordinate."""
    scored = gal(spark, sf).withColumn("score", F.element_at("embedding", 1).cast("double"))
    weighted = S.weighted_sum({"roi_0": 2.0, "roi_1": 0.5})
    out = scored.groupBy("parent_pdf_id").agg(
        weighted(F.col("score"), F.col("component_type")).alias("weighted_sum"),
        S.max_pool()(F.col("score"), F.col("component_type")).alias("max_pool"),
    )
    return rounded(out, "weighted_sum", "max_pool")


def _as_queries(df, key="vec_id"):
    return df.select(F.col(key).alias("query_id"), "embedding")


def _neighbors(df):
    return rounded(df.select("query_id", "id", F.col("rank").cast("int").alias("rank"), "score"), "score")


def e1_knn_ip(spark, sf):
    e = emb(spark, sf)
    return _neighbors(K.knn(_as_queries(e), e, 10, gallery_id="vec_id"))


def e2_knn_cosine(spark, sf):
    e = emb(spark, sf)
    return _neighbors(K.knn(_as_queries(e), e, 5, metric="cosine", gallery_id="vec_id"))


def e2_knn_l2(spark, sf):
    e = emb(spark, sf)
    return _neighbors(K.knn(_as_queries(e), e, 5, metric="l2", gallery_id="vec_id", exclude_self=True))


def _in_blocks(metric):
    """Neighbours by the first three coordinates, in about 130 blocks that a query is sent to only where they can matter."""

    def query(spark, sf):
        e = emb(spark, sf).withColumn("embedding", F.slice("embedding", 1, 3))
        rows = max(64, e.count() // 32)
        found = K.knn(_as_queries(e), e, 5, metric=metric, gallery_id="vec_id", exclude_self=True, small_rows=0, cell_rows=rows)
        return _neighbors(found)

    return query


def e3_knn_where(spark, sf):
    g = gal(spark, sf)
    return _neighbors(K.knn(_as_queries(g, "id"), g, 5, metric="cosine", where=F.col("component_type") == "roi_0"))


def e4_candidate_pool(spark, sf):
    e = emb(spark, sf)
    return _neighbors(K.candidate_pool(_as_queries(e), e, 30, gallery_id="vec_id"))


def e5_skip_same_path(spark, sf):
    g = gal(spark, sf)
    return _neighbors(K.drop_same_path(K.knn(_as_queries(g, "id"), g, 5), g, 5))


def e6_ann_knn(spark, sf):
    e = emb(spark, sf)
    return _neighbors(K.ann_knn(_as_queries(e), e, 5, cells=16, probes=4, gallery_id="vec_id"))


def e6_ann_recall(spark, sf):
    e = emb(spark, sf)
    found = K.ann_knn(_as_queries(e), e, 5, cells=16, probes=4, gallery_id="vec_id")
    exact = K.knn(_as_queries(e), e, 5, metric="cosine", gallery_id="vec_id")
    return rounded(K.recall_at_k(found, exact), "recall")


def _filled_index(spark, sf):
    """Index of all vectors in three batches: two thirds of the rows, among them every sixth with its coordinates in
    reverse; then the missing third; then the reversed rows as they should be."""
    e = emb(spark, sf).select(F.col("vec_id").alias("id"), "embedding")
    turned = e.withColumn("embedding", F.when(F.col("id") % 6 == 0, F.reverse("embedding")).otherwise(F.col("embedding")))
    index = CellIndex.create(turned.where("id % 3 <> 1"), work_folder(spark, "cell-index"))
    index.add(e.where("id % 3 = 1"), 1)
    index.add(e.where("id % 6 = 0"), 2)
    return index


def _twentieth(spark, sf):
    return _as_queries(emb(spark, sf).where("vec_id % 20 = 0"))


def e6_index_search(spark, sf):
    """Every twentieth vector against an index that was filled in batches, three quarters of its cells probed."""
    index = _filled_index(spark, sf)
    cells = index.spark.read.parquet(f"{index.path}/pivots").count()
    return _neighbors(index.search(_twentieth(spark, sf), 5, probes=-(-3 * cells // 4), wide=cells))


def e6_index_recall(spark, sf):
    """Share of the exact neighbours within the first quarter, half, three quarters and all of the cells of a query."""
    index = _filled_index(spark, sf)
    cells = index.spark.read.parquet(f"{index.path}/pivots").count()
    asked = _twentieth(spark, sf)
    exact = K.knn(asked, emb(spark, sf), 5, metric="cosine", gallery_id="vec_id")
    curve = index.recall(asked, exact, [-(-n * cells // 4) for n in (1, 2, 3, 4)])
    return rounded(curve.select(F.col("probes").cast("long").alias("probes"), "recall"), "recall")


def e7_retrieve_documents(spark, sf):
    g = gal(spark, sf)
    components = g.select(F.col("parent_pdf_id").alias("query_doc"), F.col("id").alias("query_id"), "embedding")
    found = R.retrieve_documents(components, g, 10, S.weighted_sum({"roi_0": 2.0}), with_details=False)
    found = found.select("query_doc", "parent_pdf_id", "score", "accumulated_matches", F.col("rank").cast("int").alias("rank"))
    return rounded(found, "score")


def e7_retrieve_details(spark, sf):
    """The matched components behind each document, with the max-pool strategy."""
    g = gal(spark, sf)
    components = g.select(F.col("parent_pdf_id").alias("query_doc"), F.col("id").alias("query_id"), "embedding")
    found = R.retrieve_documents(components, g, 5)
    flat = found.select("query_doc", "parent_pdf_id", F.explode("details").alias("d"))
    flat = flat.select("query_doc", "parent_pdf_id", "d.query_id", "d.id", "d.component_type", "d.similarity")
    return rounded(flat, "similarity")


def e10_centroid_query(spark, sf):
    gallery = emb(spark, sf)
    return _neighbors(K.centroid_query(tta(spark, sf), gallery, 5, "item", metric="cosine", gallery_id="vec_id"))


QUERIES = {
    "c1_l2_normalize": c1_l2_normalize,
    "c2_dot": _pair_query(lambda: V.dot(F.col("a"), F.col("b"))),
    "c3_cosine_similarity": _pair_query(lambda: V.cosine_similarity(F.col("a"), F.col("b"))),
    "c4_distance": c4_distance,
    "c5_euclidean": _pair_query(lambda: V.euclidean(F.col("a"), F.col("b"))),
    "c6_sim_to_l2": _pair_query(lambda: V.sim_to_l2(V.cosine_similarity(F.col("a"), F.col("b")))),
    "c7_losses": c7_losses,
    "c8_require_dim": c8_require_dim,
    "d1_centroid": d1_centroid,
    "d2_collapse_std": d2_collapse_std,
    "d2_two_views": d2_two_views,
    "d3_collapse_report": d3_collapse_report,
    "d4_pairwise_distance_stats": d4_pairwise_distance_stats,
    "d5_score_aggregation": d5_score_aggregation,
    "e1_knn_ip": e1_knn_ip,
    "e2_knn_cosine": e2_knn_cosine,
    "e2_knn_l2": e2_knn_l2,
    "e2_knn_cosine_blocks": _in_blocks("cosine"),
    "e2_knn_l2_blocks": _in_blocks("l2"),
    "e3_knn_where": e3_knn_where,
    "e4_candidate_pool": e4_candidate_pool,
    "e5_skip_same_path": e5_skip_same_path,
    "e6_ann_knn": e6_ann_knn,
    "e6_ann_recall": e6_ann_recall,
    "e6_index_search": e6_index_search,
    "e6_index_recall": e6_index_recall,
    "e7_retrieve_documents": e7_retrieve_documents,
    "e7_retrieve_details": e7_retrieve_details,
    "e10_centroid_query": e10_centroid_query,
}

_NORM = "sqrt(list_dot_product(v, v))"
_UNIT = f"""unit as (select vec_id, label, list_transform(v, lambda x: x / greatest({_NORM}, 1e-12)) as u
 from (select vec_id, label, embedding::double[] as v from embeddings))"""
_COS = "list_dot_product(a, b) / (greatest(sqrt(list_dot_product(a, a)), 1e-12) * greatest(sqrt(list_dot_product(b, b)), 1e-12))"
_DISTANCES = """distances as (select sqrt(list_sum(list_transform(list_zip(p.v, q.v), lambda t: (t[1] - t[2]) * (t[1] - t[2])))) as d
 from sampled p join sampled q on p.vec_id < q.vec_id)"""
_SAMPLED = "sampled as (select vec_id, embedding::double[] as v from embeddings)"
_STD = """spread as (select avg(s) as std, count(*) as dim from (
 select pos, stddev_samp(x) as s from (select unnest(u) as x, unnest(range(1, len(u) + 1)) as pos from unit) group by pos))"""


def _knn_sql(score, k, source="pairs", order="desc"):
    return f"""select query_id, id, cast(rank as int) as rank, round(score, 6) as score from (
 select query_id, id, score, row_number() over (partition by query_id order by round(score, 12) {order}, id) as rank from (
  select query_id, id, {score} as score from {source})) where rank <= {k}"""


_ALL = """pairs as (select p.vec_id as query_id, q.vec_id as id, p.embedding::double[] as a, q.embedding::double[] as b
 from embeddings p, embeddings q)"""
_OTHER = _ALL.replace("embeddings q)", "embeddings q where p.vec_id <> q.vec_id)")
_SHORT = _OTHER.replace("embedding::", "embedding[1:3]::")
_L2 = "sqrt(list_sum(list_transform(list_zip(a, b), lambda t: (t[1] - t[2]) * (t[1] - t[2]))))"
_ANN = f"""v as (select vec_id, embedding::double[] as e from embeddings),
 centers as (select vec_id, e from v order by md5(concat('42:', cast(vec_id as varchar))), vec_id limit 16),
 near_center as (select v.vec_id, p.vec_id as cell, row_number() over (partition by v.vec_id order by round({_COS.replace('(a, a)', '(v.e, v.e)').replace('(b, b)', '(p.e, p.e)').replace('(a, b)', '(v.e, p.e)')}, 12) desc, p.vec_id) as r
 from v, centers p),
 cand as (select a.vec_id as query_id, b.vec_id as id, va.e as a, vb.e as b from near_center a join near_center b on a.cell = b.cell and a.r <= 4 and b.r = 1
 join v va on va.vec_id = a.vec_id join v vb on vb.vec_id = b.vec_id)"""
_SIM = lambda a, b: _COS.replace("(a, a)", f"({a}, {a})").replace("(b, b)", f"({b}, {b})").replace("(a, b)", f"({a}, {b})")
_INDEX = f"""v as (select vec_id, embedding::double[] as e from embeddings),
 first_batch as (select vec_id, case when vec_id % 6 = 0 then list_reverse(e) else e end as e from v where vec_id % 3 <> 1),
 drawn as (select *, row_number() over (order by md5(concat('42:', cast(vec_id as varchar))), vec_id) as cell from first_batch),
 pivots as (select e, min(cell) as cell from drawn where cell <= (select cast(round(sqrt(count(*))) as int) from first_batch) group by e),
 coarse_pivots as (select * from pivots order by cell limit (select cast(ceil(sqrt(count(*))) as int) from pivots)),
 pivot_home as (select cell, e, home from (select p.cell, p.e, c.cell as home, row_number() over (partition by p.cell order by round({_SIM('p.e', 'c.e')}, 12) desc, c.cell) as r
 from pivots p, coarse_pivots c) where r = 1),
 home as (select vec_id, e, home from (select v.vec_id, v.e, c.cell as home, row_number() over (partition by vec_id order by round({_SIM('v.e', 'c.e')}, 12) desc, c.cell) as r
 from v, coarse_pivots c) where r = 1),
 placed as (select vec_id, cell from (select h.vec_id, p.cell, row_number() over (partition by vec_id order by round({_SIM('h.e', 'p.e')}, 12) desc, p.cell) as r
 from home h join pivot_home p on h.home = p.home) where r = 1),
 visits as (select q.vec_id, p.cell, row_number() over (partition by q.vec_id order by round({_SIM('q.e', 'p.e')}, 12) desc, p.cell) as place
 from v q, pivots p where q.vec_id % 20 = 0),
 size as (select count(*) as cells from pivots),
 cand as (select n.vec_id as query_id, b.vec_id as id, va.e as a, vb.e as b from visits n join placed b on n.cell = b.cell
 join v va on va.vec_id = n.vec_id join v vb on vb.vec_id = b.vec_id where n.place <= (select cast(ceil(3 * cells / 4) as int) from size))"""
_GALPAIRS = """pairs as (select p.id as query_id, q.id as id, p.parent_pdf_id as query_doc, q.parent_pdf_id, q.component_type,
 p.path as query_path, q.path as path, p.embedding::double[] as a, q.embedding::double[] as b from gal p, gal q)"""
_NEAR = """near as (select * from (select *, row_number() over (partition by query_id order by round(1 - similarity, 12), id) as place
 from (select query_doc, query_id, id, parent_pdf_id, component_type, {cos} as similarity from pairs)) where place <= {k})"""

ORACLE = {
    "c1_l2_normalize": sql(more=_UNIT) + "select vec_id, cast(unnest(range(0, len(u))) as int) as pos, round(unnest(u), 6) as x from unit",
    "c2_dot": _pair_sql("list_dot_product(a, b)"),
    "c3_cosine_similarity": _pair_sql(_COS),
    "c4_distance": sql(more=_PAIRS) + f"select vec_id, round(1 - {_COS}, 6) as distance, round({_COS}, 6) as similarity from pairs",
    "c5_euclidean": _pair_sql("sqrt(list_sum(list_transform(list_zip(a, b), lambda t: (t[1] - t[2]) * (t[1] - t[2]))))"),
    "c6_sim_to_l2": _pair_sql(f"sqrt(greatest(0, 2 - 2 * ({_COS})))"),
    "c7_losses": sql("tta", more=f"""four as (select p1.strategy, p1.embedding::double[] as p1, p2.embedding::double[] as p2,
 z1.embedding::double[] as z1, z2.embedding::double[] as z2
 from tta p1 join tta p2 on p1.item = p2.item and p1.strategy = p2.strategy and p1.view_idx = 0 and p2.view_idx = 1
 join tta z2 on p1.item = z2.item and p1.strategy = z2.strategy and z2.view_idx = 2 join tta z1 on z1.item = p1.item and z1.is_anchor)""")
    + "select strategy, round(avg(-list_cosine_similarity(p1, z2)), 6) as neg_cosine, "
    "round(0.5 * (avg(-list_cosine_similarity(p1, z2)) + avg(-list_cosine_similarity(p2, z1))), 6) as symmetric_loss from four group by strategy",
    "c8_require_dim": "select cast(len(embedding) as int) as dim, count(*) as n from embeddings group by 1",
    "d1_centroid": sql(more="""m as (select label, pos, avg(x) as x from (select label, unnest(embedding)::double as x,
 unnest(range(0, len(embedding))) as pos from embeddings) group by label, pos),
 n as (select label, greatest(sqrt(sum(x * x)), 1e-12) as len from m group by label)""")
    + "select m.label, cast(pos as int) as pos, round(x / len, 6) as x from m join n using (label)",
    "d2_collapse_std": sql(more=f"{_UNIT}, {_STD}") + "select round(std, 6) as std, dim from spread",
    "d2_two_views": sql(more=f"""second as (select list_transform(range(1, 65), lambda i: v[i] - coalesce(v[i + 1], 0)) as v from (select embedding::double[] as v from embeddings)),
 unit2 as (select list_transform(v, lambda x: x / greatest({_NORM}, 1e-12)) as u from second), {_UNIT}, {_STD}, {_STD.replace('spread', 'spread2').replace('unit', 'unit2')}""")
    + "select round((a.std + b.std) / 2, 6) as std, a.dim from spread a, spread2 b",
    "d3_collapse_report": sql(more=f"{_UNIT}, {_STD}, {_SAMPLED}, {_DISTANCES}, m as (select avg(d) as mean_distance from distances)")
    + """select round(std, 6) as std, round(1 / sqrt(dim), 6) as ideal_std, round(std * sqrt(dim) * 100, 6) as utilisation_pct,
 round(mean_distance, 6) as mean_distance, case when std * sqrt(dim) < 0.1 or mean_distance < 0.01 then 'collapsed'
 when std * sqrt(dim) < 0.3 then 'partial' else 'ok' end as verdict from spread, m""",
    "d4_pairwise_distance_stats": sql(more=f"{_SAMPLED}, {_DISTANCES}")
    + """select count(*) as pairs, round(avg(d), 6) as mean_distance, round(stddev_samp(d), 6) as std_distance,
 round(min(d), 6) as min_distance, round(max(d), 6) as max_distance from distances""",
    "d5_score_aggregation": sql("gal")
    + """select parent_pdf_id, round(sum(embedding[1]::double * case component_type when 'roi_0' then 2.0 when 'roi_1' then 0.5 else 1.0 end::double), 6) as weighted_sum,
 round(max(embedding[1]::double), 6) as max_pool from gal group by parent_pdf_id""",
    "e1_knn_ip": sql(more=_ALL) + _knn_sql("list_dot_product(a, b)", 10),
    "e2_knn_cosine": sql(more=_ALL) + _knn_sql(f"1 - {_COS}", 5, order="asc"),
    "e2_knn_l2": sql(more=_OTHER)
    + _knn_sql(_L2, 5, order="asc"),
    "e2_knn_cosine_blocks": sql(more=_SHORT) + _knn_sql(f"1 - {_COS}", 5, order="asc"),
    "e2_knn_l2_blocks": sql(more=_SHORT) + _knn_sql(_L2, 5, order="asc"),
    "e3_knn_where": sql("gal", more=_GALPAIRS) + _knn_sql(f"1 - {_COS}", 5, "pairs where component_type = 'roi_0'", "asc"),
    "e4_candidate_pool": sql(more=_OTHER) + _knn_sql(_COS, 30),
    "e5_skip_same_path": sql("gal", more=_GALPAIRS + """, ranked as (select query_id, id, path, query_path, score,
 row_number() over (partition by query_id order by round(score, 12) desc, id) as place
 from (select query_id, id, path, query_path, list_dot_product(a, b) as score from pairs))""")
    + """select query_id, id, cast(row_number() over (partition by query_id order by place) as int) as rank, round(score, 6) as score
 from ranked where place <= 5 and path <> query_path""",
    "e6_ann_knn": sql(more=_ANN) + _knn_sql(_COS, 5, "cand"),
    "e6_ann_recall": sql(more=_ALL + ", " + _ANN + ", found as (" + _knn_sql(_COS, 5, "cand") + "), exact as (" + _knn_sql(f"1 - {_COS}", 5, order="asc") + ")")
    + """select count(distinct e.query_id) as queries, round(avg(case when f.id is null then 0.0 else 1.0 end), 6) as recall
 from exact e left join found f on e.query_id = f.query_id and e.id = f.id""",
    "e6_index_search": sql(more=_INDEX) + _knn_sql(_COS, 5, "cand"),
    "e6_index_recall": sql(more=f"{_ALL.replace('embeddings q)', 'embeddings q where p.vec_id % 20 = 0)')}, {_INDEX}, exact as (" + _knn_sql(f"1 - {_COS}", 5, order="asc") + """),
 levels as (select cast(ceil(n * cells / 4) as bigint) as probes from size, range(1, 5) t(n))""")
    + """select probes, round(avg(case when place <= probes then 1.0 else 0.0 end), 6) as recall
 from levels, exact x join placed p on x.id = p.vec_id left join visits n on n.vec_id = x.query_id and n.cell = p.cell group by probes""",
    "e7_retrieve_documents": sql("gal", more=_GALPAIRS + ", " + _NEAR.format(cos=_COS, k=10) + """,
 scored as (select query_doc, parent_pdf_id, sum(similarity * case component_type when 'roi_0' then 2 else 1 end) as score,
 count(*) as accumulated_matches from near group by query_doc, parent_pdf_id),
 ranked as (select *, row_number() over (partition by query_doc order by round(score, 9) desc, parent_pdf_id) as place from scored)""")
    + "select query_doc, parent_pdf_id, round(score, 6) as score, accumulated_matches, cast(place as int) as rank from ranked where place <= 10",
    "e7_retrieve_details": sql("gal", more=_GALPAIRS + ", " + _NEAR.format(cos=_COS, k=5) + """,
 scored as (select query_doc, parent_pdf_id, max(similarity) as score from near group by query_doc, parent_pdf_id),
 ranked as (select *, row_number() over (partition by query_doc order by round(score, 9) desc, parent_pdf_id) as place from scored)""")
    + """select n.query_doc, n.parent_pdf_id, query_id, id, component_type, round(similarity, 6) as similarity
 from near n join ranked r on n.query_doc = r.query_doc and n.parent_pdf_id = r.parent_pdf_id where r.place <= 5""",
    "e10_centroid_query": sql("tta", more="""m as (select item, pos, avg(x) as x from (select item, unnest(embedding)::double as x,
 unnest(range(0, len(embedding))) as pos from tta) group by item, pos),
 c as (select item as query_id, list(x order by pos) as a from m group by item),
 pairs as (select query_id, vec_id as id, a, embedding::double[] as b from c, embeddings)""")
    + _knn_sql(f"1 - {_COS}", 5, order="asc"),
}
