import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from galleryspark.functions import vectors as V
from galleryspark.operators import blocks, evaluation as E, extensions as X, knn as K, pruned, retrieval as R, vector_stats as S


def table(spark, values, ids=None, labels=None):
    ids = ids if ids is not None else list(range(len(values)))
    labels = labels if labels is not None else [0] * len(values)
    rows = [(i, [float(x) for x in v], int(l)) for i, v, l in zip(ids, values, labels)]
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")


def asked(df):
    return df.select(F.col("vec_id").alias("query_id"), "embedding")


def pairs(df):
    return {(r.query_id, r["rank"]): (r.id, round(r.score, 6)) for r in df.collect()}


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(3)
    values = rng.normal(size=(230, 6)).astype(np.float32)
    values[20:90] = values[20]  # a third of all rows are copies
    labels = np.where(np.arange(230) < 80, 0, np.arange(230) % 7)
    labels[229] = 99  # alone in its class
    return values, labels, table(spark, values, labels=labels).cache()


def brute_order(values, exclude_self=True):
    unit = values.astype(np.float64)
    unit /= np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-12)
    sims = np.round(unit @ unit.T, 12)
    if exclude_self:
        np.fill_diagonal(sims, -np.inf)
    return sims, np.argsort(-sims, axis=1, kind="stable")


@pytest.mark.parametrize("small_rows,cell_rows", [(2048, 1 << 14), (0, 1 << 14), (0, 50)])
def test_knn_paths_agree_with_brute_force(cloud, small_rows, cell_rows):
    values, _, df = cloud
    few = df.where("vec_id < 12")
    _, order = brute_order(values)
    got = pairs(K.knn(asked(few), df, 9, metric="cosine", exclude_self=True, gallery_id="vec_id", small_rows=small_rows, cell_rows=cell_rows))
    assert len(got) == 12 * 9
    for q in range(12):
        assert [got[q, r][0] for r in range(1, 10)] == list(order[q, :9])


def brute_knn(queries, values, k, metric, exclude_self):
    """(query, rank) -> id, by the score itself; values count as ties to 12 places."""
    q, v = queries.astype(np.float64), values.astype(np.float64)
    if metric == "l2":
        score = -np.sqrt(((q[:, None] - v[None, :]) ** 2).sum(2))
    elif metric == "cosine":
        unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        score = unit(q) @ unit(v).T
    else:
        score = q @ v.T
    score = np.round(score, 11)
    if exclude_self:
        np.fill_diagonal(score, -np.inf)
    order = np.argsort(-score, axis=1, kind="stable")[:, :k]
    return {(i, r + 1): int(c) for i in range(len(q)) for r, c in enumerate(order[i]) if np.isfinite(score[i, c])}


@pytest.mark.parametrize("metric", ["ip", "cosine", "l2"])
@pytest.mark.parametrize("k,exclude_self,cell_rows,share", [(5, True, 40, 1e9), (1, False, 17, 1e9), (90, True, 64, 1e9), (5, False, 64, 0)])
def test_block_search_is_exact(spark, monkeypatch, metric, k, exclude_self, cell_rows, share):
    """Lengths from tiny to large, a third of all rows copies of one vector (more than a cell), zero vectors, far clusters."""
    monkeypatch.setattr(pruned, "GRID_SHARE", share)
    rng = np.random.default_rng(k)
    values = (rng.integers(-4, 5, size=(8, 5))[rng.integers(0, 8, 240)] * 4 + rng.integers(-2, 3, size=(240, 5))).astype(np.float32)
    values *= rng.choice([0.25, 1.0, 8.0], size=(240, 1)).astype(np.float32)
    values[100:180] = values[7]
    values[[3, 200]] = 0
    df = table(spark, values)
    got = K.knn(asked(df), df, k, metric=metric, exclude_self=exclude_self, gallery_id="vec_id", small_rows=0, cell_rows=cell_rows)
    assert {key: i for key, (i, _) in pairs(got).items()} == brute_knn(values, values, k, metric, exclude_self)


def test_block_search_when_k_passes_the_gallery(spark):
    df = table(spark, np.arange(24).reshape(12, 2))
    got = pairs(K.knn(asked(df), df, 50, metric="l2", exclude_self=True, gallery_id="vec_id", small_rows=0, cell_rows=4))
    assert len(got) == 12 * 11


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_block_search_skips_blocks(spark, metric):
    """Forty tight, far clusters: a query is sent to a small share of the blocks; the counts add up to the full grid."""
    rng = np.random.default_rng(9)
    values = np.repeat(rng.normal(size=(40, 8)) * 10, 25, axis=0) + rng.normal(size=(1000, 8)) * 0.05
    df = table(spark, values)
    work = K.knn_work(asked(df), df, 5, metric=metric, exclude_self=True, gallery_id="vec_id", cell_rows=40).first()
    assert work.queries == 1000 and work.first_pass >= 1000
    assert work.first_pass + work.second_pass + work.skipped == 1000 * work.blocks
    assert work.by_blocks and work.skipped > 0.8 * 1000 * work.blocks
    got = K.knn(asked(df), df, 5, metric=metric, exclude_self=True, gallery_id="vec_id", small_rows=0, cell_rows=40)
    assert {key: i for key, (i, _) in pairs(got).items()} == brute_knn(values.astype(np.float32), values.astype(np.float32), 5, metric, True)


def test_knn_edges(spark):
    df = table(spark, [[1, 0], [0, 1], [0, 0], [1, 0]], ids=[4, 3, 2, 1])
    got = pairs(K.knn(asked(df), df, 10, gallery_id="vec_id"))
    assert [got[4, r][0] for r in range(1, 5)] == [1, 4, 2, 3]  # ties by id, k beyond the gallery
    zero = pairs(K.knn(asked(df.where("vec_id = 2")), df, 2, metric="cosine", gallery_id="vec_id"))
    assert zero == {(2, 1): (1, 1.0), (2, 2): (2, 1.0)}
    with pytest.raises(ValueError, match="empty"):
        K.knn(asked(df), df, 3, where=F.lit(False), gallery_id="vec_id")


def test_ann_is_exact_when_all_cells_are_probed(cloud):
    _, _, df = cloud
    exact = pairs(K.knn(asked(df), df, 5, metric="cosine", gallery_id="vec_id"))
    found = pairs(K.ann_knn(asked(df), df, 5, cells=6, probes=6, gallery_id="vec_id", cell_rows=64))
    assert {k: v[0] for k, v in found.items()} == {k: v[0] for k, v in exact.items()}


def test_ann_recall_floor(cloud):
    _, _, df = cloud
    found = K.ann_knn(asked(df), df, 5, cells=8, probes=4, gallery_id="vec_id")
    exact = K.knn(asked(df), df, 5, metric="cosine", gallery_id="vec_id")
    assert K.recall_at_k(found, exact).first().recall > 0.7


def test_skip_same_path_quirk_and_refill(spark):
    df = table(spark, [[1, 0], [0.9, 0.1], [0, 1]])
    paths = df.select(F.col("vec_id").alias("id"), F.concat(F.lit("/p"), F.col("vec_id").cast("string")).alias("path"))
    quirk = K.drop_same_path(K.knn(asked(df), df, 2, gallery_id="vec_id"), paths, 2)
    assert quirk.groupBy("query_id").count().where("count = 1").count() == 3
    refilled = K.drop_same_path(K.knn(asked(df), df, 3, gallery_id="vec_id"), paths, 2, refill=True)
    assert refilled.groupBy("query_id").count().where("count = 2").count() == 3


def brute_ap(values, labels, q):
    _, order = brute_order(values)
    hit = labels[order[q][: len(values) - 1]] == labels[q]
    if not hit.any():
        return 0.0
    return float((np.cumsum(hit) / np.arange(1, len(hit) + 1) * hit).sum() / hit.sum())


@pytest.mark.parametrize("cell_rows", [65_536, 60])
def test_average_precision_one_and_two_passes(cloud, cell_rows, monkeypatch):
    values, labels, df = cloud
    monkeypatch.setattr(E, "THRESHOLDS", 16)
    got = {r.id: r.ap for r in E.average_precision(df, cell_rows=cell_rows).collect()}
    assert len(got) == len(values)
    assert got[229] == 0.0
    for q in (0, 25, 60, 85, 150, 228):
        assert got[q] == pytest.approx(brute_ap(values, labels, q), abs=1e-9)


def test_matches_agree_within_and_beyond_a_cell(cloud):
    _, labels, df = cloud
    rows = lambda n: {r.id: (round(r.ap, 9), r.m1, r.m5) for r in E.item_ranking(df, (1, 5), cell_rows=n).collect()}
    assert rows(60) == rows(65_536)


def test_margins_match_pair_means(cloud):
    values, labels, df = cloud
    sims, _ = brute_order(values, exclude_self=False)
    same = labels[:, None] == labels[None, :]
    off = ~np.eye(len(values), dtype=bool)
    per_item = [(sims[i][same[i] & off[i]].mean() if (same[i] & off[i]).any() else 0.0, sims[i][~same[i]].mean()) for i in range(len(values))]
    row = E.class_margin(df).first()
    assert row.iacs == pytest.approx(np.mean([a for a, _ in per_item]), abs=1e-9)
    assert row.inter == pytest.approx(np.mean([b for _, b in per_item]), abs=1e-9)
    pair = E.pair_margin(df).first()
    assert pair.iacs == pytest.approx(sims[same & off].mean(), abs=1e-9)
    assert pair.inter == pytest.approx(sims[~same].mean(), abs=1e-9)


def test_group_metrics_counts_missing_groups_as_zero(spark):
    df = table(spark, [[1, 0], [0.99, 0.1], [0, 1], [0.1, 0.99], [-1, 0]], labels=[0, 0, 1, 1, -1])
    row = E.group_metrics(df, n_groups=4).first()
    assert row.macro_map == pytest.approx(0.5)
    assert row.top1_accuracy == 1.0 and row.top5_accuracy == 1.0


def test_pair_export_cap_and_content(cloud):
    values, labels, df = cloud
    out = E.export_pair_scores(df, max_fp=500).toPandas()
    same = labels[:, None] == labels[None, :]
    assert out.is_tp.sum() == same.sum() - len(values)
    assert (~out.is_tp).sum() == 500
    sims, _ = brute_order(values, exclude_self=False)
    assert np.allclose(out.similarity, sims[out.query_id, out.id], atol=1e-6)
    whole = E.export_pair_scores(df).toPandas()
    assert len(whole) == len(values) * (len(values) - 1) == len(whole[["query_id", "id"]].drop_duplicates())
    assert (whole.is_tp == same[whole.query_id, whole.id]).all()
    assert np.allclose(whole.similarity, sims[whole.query_id, whole.id], atol=1e-6)


def test_pairwise_stats_against_numpy(cloud):
    values, _, df = cloud
    d = np.linalg.norm(values[:, None].astype(float) - values[None, :].astype(float), axis=2)[np.triu_indices(len(values), 1)]
    row = S.pairwise_distance_stats(df, sample=None).first()
    assert row.pairs == len(d)
    assert row.mean_distance == pytest.approx(d.mean(), abs=1e-6)
    assert row.std_distance == pytest.approx(d.std(ddof=1), abs=1e-6)
    assert row.max_distance == pytest.approx(d.max(), abs=1e-6)


def test_collapse_verdicts(spark):
    same = table(spark, [[1, 1, 1]] * 5)
    assert S.collapse_report(same).first().verdict == "collapsed"
    spread = table(spark, np.eye(3))
    assert S.collapse_report(spread).first().verdict == "ok"


def test_require_dim(spark):
    df = table(spark, [[1, 2], [1, 2, 3]])
    with pytest.raises(PySparkException, match="vector dimension must be 2"):
        V.require_dim(df, "embedding", 2).collect()


def test_retrieval_metrics_with_empty_queries(spark):
    queries = spark.createDataFrame([(1, "a"), (2, "b")], "query_id bigint, query_label string")
    labels = spark.createDataFrame([(7, "a"), (8, "z")], "id bigint, label string")
    near = spark.createDataFrame([(1, 7, 1, 0.9), (1, 8, 2, 0.5)], "query_id bigint, id bigint, rank int, score double")
    row = R.retrieval_metrics(R.per_query_summary(queries, near, labels, 5)).first()
    assert (row.total_queries, row.queries_without_results) == (2, 1)
    assert (row.top1_accuracy, row.hit_rate_at_k, row.mean_precision_at_k, row.mean_top1_score) == (0.5, 0.5, 0.25, 0.9)
    details = {r.query_id: r.retrieved for r in R.per_query_details(queries, near, labels).collect()}
    assert details[2] == [] and [d.match for d in details[1]] == [1, 0]


def test_documents_without_parent_are_dropped(spark):
    gallery = spark.createDataFrame(
        [("a", [1.0, 0.0], "D1", "roi_0"), ("b", [0.9, 0.1], None, "roi_0"), ("c", [0.0, 1.0], "D2", "roi_1")],
        "id string, embedding array<double>, parent_pdf_id string, component_type string",
    )
    query = spark.createDataFrame([("Q", "q", [1.0, 0.0])], "query_doc string, query_id string, embedding array<double>")
    rows = R.retrieve_documents(query, gallery, 3, S.weighted_sum({"roi_1": 3.0})).orderBy("rank").collect()
    assert [(r.parent_pdf_id, r.accumulated_matches) for r in rows] == [("D1", 1), ("D2", 1)]
    assert rows[0].score == pytest.approx(1.0)


def test_flag_alias(spark):
    df = spark.createDataFrame([("True",), ("1",), ("true",), ("True Positive",), ("False Positive",)], "f string")
    assert [r[0] for r in df.select(E.flag_alias(F.col("f"))).collect()] == [True, True, True, True, False]


def test_registry(spark):
    X.EMBEDDERS.register("ones", lambda: lambda images: np.ones((len(images), 2)))
    assert X.EMBEDDERS.get("ones")(np.zeros((3, 1, 1))).shape == (3, 2)
    with pytest.raises(KeyError, match="known"):
        X.STRATEGIES.get("nothing")


def test_best_k_keeps_the_smaller_column_on_ties():
    value = np.array([[1.0, 2.0, 2.0, -np.inf], [5.0, 5.0, 5.0, 5.0]])
    row, col = blocks.best_k(value, 2)
    assert list(zip(row, col)) == [(0, 1), (0, 2), (1, 0), (1, 1)]


@pytest.mark.parametrize("cell_rows", [16_384, 60])
def test_pair_scores_counted_in_cells(cloud, cell_rows):
    """Counts, moments and quartiles over the pairs of the cells equal those of the written pairs."""
    _, labels, df = cloud
    pairs = E.export_pair_scores(df).cache()
    key = lambda rows: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows)
    columns = ["is_tp", "n", "mean", "min", "max", "q1", "median", "q3"]
    got = E.pair_score_summary(df, cell_rows=cell_rows).select(*columns)
    assert key(got.collect()) == key(E.score_summary(pairs).select(*columns).collect())
    assert key(E.pair_score_margin(df, cell_rows=cell_rows).collect()) == key(E.score_margin(pairs).collect())
    nine = pairs.withColumn("similarity", F.round("similarity", 9))
    columns = ["series", "is_tp", "bin", "n", "density"]
    got = E.pair_score_distribution(df, cell_rows=cell_rows).select(*columns)
    assert key(got.collect()) == key(E.score_distribution(nine).select(*columns).collect())
    per_query = E.pair_score_counts(df, cell_rows=cell_rows).groupBy("is_tp", "bin").agg(F.sum("n").alias("n"))
    assert key(per_query.collect()) == key(got.where("series = 'similarity'").select("is_tp", "bin", "n").collect())
    above = E.export_pair_scores(df, min_score=0.5)
    assert key(above.collect()) == key(pairs.where("similarity >= 0.5").collect())


def test_pair_scores_of_one_class(spark):
    rows = spark.createDataFrame([(i, 1, [1.0, float(i)]) for i in range(3)], "vec_id long, label long, embedding array<double>")
    (row,) = E.pair_score_summary(rows).collect()
    assert row.is_tp and row.n == 6 and row.max <= 1
    assert E.pair_score_margin(rows).first().fp_mean is None


def test_block_ranking_streams_pieces_with_ties(spark):
    """Copies that tie across pieces and classes: the ranking in blocks gives the rows of the whole one."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=(12, 4))
    rows = [(int(i), [float(x) for x in base[i % 12]], int(i * 7 % 3)) for i in rng.permutation(150)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    rank = lambda n: {r.id: (round(r.ap, 12), r.m1, r.m5) for r in E.item_ranking(df, (1, 5), cell_rows=n).collect()}
    assert rank(17) == rank(65_536)


def test_export_returns_all_pairs_from_short_cells(spark, monkeypatch):
    """No cell returns more than EXPORT_ROWS squared pairs, and all pairs come."""
    monkeypatch.setattr(E, "EXPORT_ROWS", 16)
    df = spark.createDataFrame([(i, [float(i % 5), 1.0], i % 2) for i in range(70)], "vec_id bigint, embedding array<double>, label int")
    pairs = E.export_pair_scores(df)
    assert pairs.select("query_id", "id").distinct().count() == pairs.count() == 70 * 69


def test_best_k_by_floor_of_the_head():
    """The k best found behind the columns that give the floor, ties to the smaller column, infinities left out."""
    rng = np.random.default_rng(5)
    value = np.round(rng.normal(size=(7, 3000)), 2)
    value[0, :1100] = -np.inf
    row, col = blocks.best_k(value, 9)
    for q in range(7):
        order = [c for c in np.lexsort((np.arange(3000), -value[q])) if np.isfinite(value[q, c])][:9]
        assert list(col[row == q]) == order


def test_pair_counts_with_null_labels(spark):
    """A null label is of no class; each cell merges its pieces."""
    df = spark.createDataFrame([(i, [float(i), 1.0, 2.0], None if i % 3 == 0 else i % 3) for i in range(12)], "vec_id bigint, embedding array<double>, label int")
    n = {r.is_tp: r.n for r in E.pair_score_counts(df, cell_rows=5).groupBy("is_tp").agg(F.sum("n").alias("n")).collect()}
    assert n == {True: 24, False: 108}
    margin = {r.is_tp: r.n for r in E.pair_score_summary(df, cell_rows=5).collect()}
    assert margin == n


def test_gallery_goes_to_few_blocks_of_queries(spark, monkeypatch):
    """Short pieces of the gallery do not make more blocks of queries; sent once or twice, the rows are those of the whole ranking."""
    blocks_made, each = [], blocks._each
    monkeypatch.setattr(blocks, "_each", lambda n: (blocks_made.append(str(n)), each(n))[1])
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(size=3).round(1) + 0.01], int(rng.integers(3))) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    rank = lambda n: {r.id: (round(r.ap, 12), r.m1, r.m5) for r in E.item_ranking(df, (1, 5), cell_rows=n).collect()}
    whole = rank(65_536)
    blocks_made.clear()
    assert rank(17) == whole
    monkeypatch.setattr(blocks, "CELL_BYTES", 0)  # too little room to keep the gallery
    assert rank(17) == whole
    assert blocks_made == ["Column<'3'>"] * 2


def _sent(monkeypatch) -> list[str]:
    """How often the rows of a side are sent, call by call."""
    sent, each = [], blocks._each
    monkeypatch.setattr(blocks, "_each", lambda n: (sent.append(str(n)), each(n))[1])
    return sent


def test_gallery_goes_once_to_each_core_whatever_the_groups(spark, monkeypatch):
    """Groups of four queries: the gallery is sent to the 8 cores, not to the 75 groups; rows of one id stay in one group."""
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(300, 3)).round(1) + 0.01
    frame = lambda ids: spark.createDataFrame(
        [(int(i), [float(x) for x in v], int(j % 3)) for j, (i, v) in enumerate(zip(ids, vectors))], "vec_id bigint, embedding array<double>, label int"
    )
    rank = lambda df, n: sorted((r.id, r.label, round(r.ap, 12), r.m1, r.m5) for r in E.item_ranking(df, (1, 5), cell_rows=n).collect())
    single, double = frame(range(300)), frame(np.arange(300) // 3)
    whole, merged = rank(single, 65_536), rank(double, 100)
    monkeypatch.setattr(E, "THRESHOLDS", 1)
    sent = _sent(monkeypatch)
    assert rank(single, 100) == whole
    assert rank(double, 100) == merged
    assert sent == ["Column<'8'>"] * 2


def test_export_sends_the_gallery_once_to_each_core(spark, monkeypatch):
    """Cells of 16 rows: all pairs of 300 items, with nothing sent more than 8 times; a null label is of no class."""
    monkeypatch.setattr(E, "EXPORT_ROWS", 16)
    sent = _sent(monkeypatch)
    rng = np.random.default_rng(6)
    values, labels = rng.normal(size=(300, 3)), [None if i % 50 == 0 else i % 3 for i in range(300)]
    df = spark.createDataFrame([(i, [float(x) for x in v], labels[i]) for i, v in enumerate(values)], "vec_id bigint, embedding array<double>, label int")
    sims, _ = brute_order(values, exclude_self=False)
    for floor in (None, 0.3):
        got = E.export_pair_scores(df, min_score=floor).toPandas()
        wanted = {(q, i) for q in range(300) for i in range(300) if q != i and (floor is None or round(sims[q, i], 12) >= floor)}
        assert set(zip(got["query_id"], got["id"])) == wanted and len(got) == len(wanted)
        assert all(t == (labels[q] is not None and labels[q] == labels[i]) for q, i, t in zip(got["query_id"], got["id"], got["is_tp"]))
    assert set(sent) == {"Column<'8'>"}


@pytest.mark.parametrize("with_details", [False, True])
def test_python_strategy_searches_once(spark, with_details):
    """No join runs the search again, no group is sent by itself; documents that lie across batches are whole."""
    df = spark.createDataFrame([(f"c{i}", f"d{i // 2}", "roi", [1.0, float(i)]) for i in range(12)], "id string, parent_pdf_id string, component_type string, embedding array<double>")
    asked = df.select(F.col("parent_pdf_id").alias("query_doc"), F.col("id").alias("query_id"), "embedding")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        found = R.retrieve_documents(asked, df, 3, X.pandas_strategy(lambda scores, kinds: scores.max()), with_details=with_details)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("CoGroups") <= 1 and "AggregateInPandas" not in plan and "PythonUDAF" not in plan
        plain = R.retrieve_documents(asked, df, 3, S.max_pool(), with_details=with_details)
        rows = lambda d: {(r.query_doc, r.parent_pdf_id, r["rank"], r.accumulated_matches, round(r.score, 9)) for r in d.collect()}
        assert rows(found) == rows(plain)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_half_grid_meets_each_two_blocks_once(spark):
    """Every unordered pair of rows lies in one cell, those of one key where a block meets itself."""
    df = spark.createDataFrame([(i // 2, i) for i in range(60)], "key int, row int")

    def kernel(one, other):
        if other is one:
            return pd.DataFrame([(a, b, True) for a in one["row"] for b in one["row"] if a <= b], columns=["a", "b", "own"])
        return pd.DataFrame([(min(a, b), max(a, b), False) for a in one["row"] for b in other["row"]], columns=["a", "b", "own"])

    met = blocks.half_grid(df, ["key"], kernel, "a int, b int, own boolean", cell_rows=7).collect()
    assert sorted((r.a, r.b) for r in met) == [(a, b) for a in range(60) for b in range(a, 60)]
    assert not all(r.own for r in met) and all(r.own for r in met if r.a // 2 == r.b // 2)


@pytest.mark.parametrize("cell_rows", [16_384, 40])
def test_pair_scores_take_each_pair_of_blocks_once(spark, monkeypatch, cell_rows):
    """Repeated and null ids, null labels, copies and scores on the edges of bins: the rows of brute force, from half of the cells and no more than two passes."""
    passes, half_grid = [], blocks.half_grid
    monkeypatch.setattr(blocks, "half_grid", lambda *a, **k: (passes.append(1), half_grid(*a, **k))[1])
    rng = np.random.default_rng(4)
    values = np.round(rng.normal(size=(150, 3)), 1)
    values[:30], values[30:34] = values[0], 0.0
    ids = [None if i % 50 == 7 else i // 2 if i < 20 else i for i in range(150)]
    labels = [None if i % 9 == 0 else i % 4 for i in range(150)]
    rows = [(i, [float(x) for x in v], l) for i, v, l in zip(ids, values, labels)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    unit = values / np.maximum(np.linalg.norm(values, axis=1, keepdims=True), 1e-12)
    score = np.round(unit @ unit.T, 12)
    pairs = [(score[a, b], labels[a] is not None and labels[a] == labels[b]) for a in range(150) for b in range(150) if ids[a] is None or ids[a] != ids[b]]
    summary = {r.is_tp: r for r in E.pair_score_summary(df, cell_rows=cell_rows).collect()}
    assert len(passes) == 2
    margin = E.pair_score_margin(df, cell_rows=cell_rows).first()
    counted = E.pair_score_distribution(df, cell_rows=cell_rows).collect()
    for is_tp in (True, False):
        own = np.array([s for s, flag in pairs if flag == is_tp])
        r = summary[is_tp]
        assert r.n == len(own)
        want = [own.mean(), own.min(), own.max(), *np.quantile(own, E.QUARTILES)]
        assert [r.mean, r.min, r.max, r.q1, r.median, r.q3] == pytest.approx(want, abs=1e-11)
        assert margin["tp_mean" if is_tp else "fp_mean"] == pytest.approx(own.mean(), abs=1e-11)
        nine = np.round(own, 9)
        for series, low, high, value in (("similarity", -1.0, 1.0, nine), ("distance", 0.0, 2.0, np.sqrt(np.maximum(2 - 2 * nine, 0.0)))):
            bins, n = np.unique(E._edge_bins(value, low, high, 100), return_counts=True)
            assert {(x.bin, x.n) for x in counted if (x.series, x.is_tp) == (series, is_tp)} == set(zip(bins[bins >= 0], n[bins >= 0]))
