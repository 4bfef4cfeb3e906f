import json
import zipfile
from collections import Counter

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from galleryspark.functions import geometry as G, text as T
from galleryspark.operators import components as C, curation as D, experiments as X, inventory as I, ordering, profile as P, tta
from galleryspark.operators.ordering import bucketed_rank, bucketed_running, hash_rank, position_map
from galleryspark.operators.quantiles import exact_quantiles, melt
from galleryspark.plans import fixtures
from galleryspark.sources import files as SF, labels as L, reports as R, store as S
from galleryspark.streaming import jobs as J


@pytest.mark.parametrize("options", [{}, {"direct_limit": 10, "accuracy": 200}, {"direct_limit": 10, "bracket_limit": 1}])
def test_quantiles_of_skewed_groups(spark, options):
    rng = np.random.default_rng(1)
    a = np.where(np.arange(3000) % 3 == 0, 0.5, rng.normal(size=3000))  # a third of the values are equal
    b = np.arange(7, dtype=float)
    rows = [("a", float(v)) for v in a] + [("b", float(v)) for v in b]
    long = melt(spark.createDataFrame(rows, "g string, x double"), {"x": F.col("x")}, ["g"])
    probs = [0.0, 0.25, 0.5, 0.75, 0.995, 1.0]
    got = {r.g: r.q for r in exact_quantiles(long, probs, ["g"], **options).collect()}
    assert np.allclose(got["a"], np.quantile(a, probs)) and np.allclose(got["b"], np.quantile(b, probs))


def test_rank_and_running_keep_null_strata(spark):
    rows = [(None if i % 3 == 0 else "x", i, None if i % 4 == 0 else (i * 7) % 11) for i in range(40)]
    df = spark.createDataFrame(rows, "g string, i int, v int")
    ranked = bucketed_rank(df, ["g"], F.floor(F.col("i") / 5), [F.col("i")], total="n").collect()
    assert len(ranked) == 40
    for g in (None, "x"):
        part = sorted((r.i, r.rn, r.n) for r in ranked if r.g == g)
        assert [p[1] for p in part] == list(range(1, len(part) + 1)) and {p[2] for p in part} == {len(part)}
    for how, fold in (("max", max), ("last", lambda s: s[-1]), ("sum", sum)):
        out = bucketed_running(df, ["g"], F.floor(F.col("i") / 5), "i", "v", how, "o").collect()
        for g in (None, "x"):
            seen = []
            for r in sorted((r for r in out if r.g == g), key=lambda r: r.i):
                seen += [r.v] if r.v is not None else []
                assert r.o == (fold(seen) if seen else None), (how, r)


def test_position_map_is_dense(spark):
    df = spark.range(500).select(F.md5(F.col("id").cast("string")).alias("path"))
    rows = position_map(df, ["path"]).orderBy("position").collect()
    assert [r.position for r in rows] == list(range(500)) and [r.path for r in rows] == sorted(r.path for r in rows)


def test_hash_rank_without_strata(spark):
    ranks = [r.rn for r in hash_rank(spark.range(100), 7, F.col("id")).collect()]
    assert sorted(ranks) == list(range(1, 101))


@pytest.fixture(scope="module")
def parts(spark):
    # Class a holds most rows; class c has a single group.
    rows = [("a", g, i) for g in range(60) for i in range(1 + g % 4)] + [("b", 100 + g, 0) for g in range(7)] + [("c", 900, 0)]
    return spark.createDataFrame(rows, "cls string, grp int, i int").cache()


@pytest.mark.parametrize("minimum", ["one", "bernoulli", "zero"])
def test_split_is_whole_and_does_not_leak(parts, minimum):
    out = D.stratified_split(parts, "cls", "grp", 0.8, 5, minimum)
    assert out.count() == parts.count()
    assert D.leakage(out, "grp").count() == 0
    trained = {r.cls: r.n for r in out.where("split = 'train'").groupBy("cls").agg(F.count_distinct("grp").alias("n")).collect()}
    assert trained["a"] == 48 and trained["b"] == 5
    assert trained.get("c", 0) in {"one": (1,), "bernoulli": (0, 1), "zero": (0,)}[minimum]


def test_component_split_may_leak(parts):
    out = D.component_split(parts, "cls", F.concat_ws("-", "grp", "i"))
    assert out.count() == parts.count() and D.leakage(out, "grp").count() > 0


def test_validation_sets(spark):
    da = spark.createDataFrame([(f"a{i}", "x" if i < 30 else "y") for i in range(40)], "path string, category string")
    db = spark.createDataFrame([(f"b{i}", "z") for i in range(20)], "path string, category string")
    seeds = D.sample_seeds(da, 6)
    truth = D.select_ground_truth(seeds, da, 4)
    known = {r.path: r.category for r in da.collect()}
    rows = truth.collect()
    assert len({(r.seed, r.member) for r in rows}) == len(rows) == 24
    assert all(r.seed != r.member and known[r.seed] == known[r.member] for r in rows)
    used = seeds.select("path").unionByName(truth.select(F.col("member").alias("path")))
    noise = D.sample_distractors(da.unionByName(db), used, 5)
    sets = {}
    for r in D.build_validation_sets(da, db, seeds, truth, noise).collect():
        sets.setdefault(r.part, set()).add(r.path)
    everything = {f"a{i}" for i in range(40)} | {f"b{i}" for i in range(20)}
    assert sets["T_large"] == everything - sets["V"]
    assert sets["T_small"] == {p for p in everything - sets["V"] if p[0] == "a"}
    groups = D.label_validation_groups(seeds, truth, noise).collect()
    assert {r.label for r in groups} == {-1, *range(6)}
    assert sum(r.label == -1 for r in groups) == 5
    one = D.select_ground_truth(da.limit(1), da.limit(1))
    assert one.count() == 0


def test_layouts(spark):
    at = lambda *paths: D.detect_layout(spark.createDataFrame([(p,) for p in paths], "path string"), "/r").first()
    assert at("/r/s1/a.png", "/r/c/s/a.png").layout == "flat"
    assert tuple(at("/r/c/s/a.png")) == ("classes", "nested")
    assert at("/r/a.png").layout == "loose"


def test_names(spark):
    df = spark.createDataFrame([("/r/x/082B40-HOH-000-11500.v2.png",), ("/r/plain",), ("/r/.hidden",)], "path string")
    rows = df.select(T.filename_template(F.col("path")), T.stem(F.col("path")), T.suffix(F.col("path")), T.class_under(F.col("path"), "/r")).collect()
    assert tuple(rows[0]) == ("DDDLDD-LLL-DDD-DDDDD", "082B40-HOH-000-11500.v2", ".png", "x")
    assert tuple(rows[1])[1:] == ("plain", "", "_flat") and tuple(rows[2])[1:3] == (".hidden", "")


def test_artifact_rules(spark):
    names = ["/d/a_merged.png", "/d/a_random_20.png", "/d/a_random_21.png", "/d/large_components/a_large_L1_area2_pad2.png", "/d/a_large_L1_area2_pad2.png"]
    df = spark.createDataFrame([(n,) for n in names], "path string")
    assert [r[0] for r in df.select(T.is_artifact(F.col("path"))).collect()] == [True, True, False, True, False]
    assert I.artifacts(df, "c").where("tag = 'large_component' and id = 'a'").count() == 1


def test_target_names_are_numbered(spark):
    df = spark.createDataFrame([("d", f"/s{i}", "n.png") for i in range(4)] + [("e", "/t", "n.png")], "d string, path string, name string")
    got = sorted((r.d, r.target_name) for r in I.unique_target_names(df, "d", "name").collect())
    assert got == [("d", "n.png"), ("d", "n_1.png"), ("d", "n_2.png"), ("d", "n_3.png"), ("e", "n.png")]


def test_rollup_ignores(spark):
    df = spark.createDataFrame([("/r/a/x", 3), ("/r/a/b/y", 4), ("/r/.git/z", 9), ("/r/w", 1)], "path string, length bigint")
    got = {r.directory: (r.files, r.bytes) for r in I.directory_rollup(df, "/r").collect()}
    assert got == {"/r": (3, 8), "/r/a": (2, 7), "/r/a/b": (1, 4)}


def test_geometry(spark):
    df = spark.createDataFrame([(300, 600), (800, 400), (5, 0)], "w int, h int")
    rows = df.select(G.letterbox_plan(F.col("w"), F.col("h"), 512).alias("p"), G.aspect_ratio(F.col("w"), F.col("h")).alias("r")).collect()
    assert tuple(rows[0].p) == (256, 512, 128, 0) and tuple(rows[1].p) == (512, 256, 0, 128)
    assert rows[2].r == 1.0


def test_component_rules(spark):
    schema = "image_id int, label int, x int, y int, w int, h int, page_w int, page_h int, n_holes int, is_complex boolean, pixel_area bigint"
    rows = [(1, 1, 0, 0, 100, 100, 100, 100, 0, False, 500), (1, 2, 10, 10, 50, 50, 100, 100, 1, True, 30), (1, 3, 12, 12, 5, 5, 100, 100, 0, False, 20), (1, 4, 90, 90, 5, 5, 100, 100, 0, False, 40)]
    df = spark.createDataFrame(rows, schema)
    assert {r.label for r in C.prune_simple(df, 40).collect()} == {1, 2, 4}
    assert {r.label for r in C.select_components(df, 0, 0.25).collect()} == {2, 3, 4}  # exactly at the ratio stays
    assert [tuple(r) for r in C.assign_by_box(df, 1).collect()] == [(1, 3, 2)]
    assert {(r.a, r.b) for r in C.bbox_overlaps(df, 0, tile=16).collect()} == {(1, 2), (1, 3), (1, 4), (2, 3)}
    boxes = spark.createDataFrame([(1, 0, 0, 35, 35)], "image_id int, x1 int, y1 int, x2 int, y2 int")
    assert {r.label for r in C.drop_logo_components(df, boxes).collect()} == {1, 4}


def test_outlier_tags_and_histogram(spark):
    df = spark.createDataFrame([(i, float(i), 1.0) for i in range(1000)], "id int, entropy double, aspect_ratio double")
    tagged = P.tag_outliers(df).where(F.size("tags") > 0)
    assert {r.id for r in tagged.collect()} == set(range(10))
    assert sum(r.n for r in P.histogram(df, F.col("entropy"), 7).collect()) == 1000
    assert P.histogram(df, F.col("aspect_ratio"), 5).count() == 1


def test_isolation_finds_the_far_point(spark):
    rng = np.random.default_rng(0)
    values = rng.normal(size=(300, 4))
    values[7] = 15.0
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(values)], "vec_id bigint, embedding array<double>")
    out = P.isolation_scores(df, trees=20).orderBy(F.desc("score")).collect()
    assert out[0].id == 7 and sum(r.is_outlier for r in out) == 15


@pytest.mark.parametrize("n", [0, 1, 2, 40])
def test_isolation_of_small_tables_and_partitions(spark, n):
    values = np.random.default_rng(n).integers(0, 3, size=(n, 3)) * 1.0
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got, again = ({r.id: (r.score, r.is_outlier) for r in P.isolation_scores(df.repartition(p), trees=9).collect()} for p in (1, 5))
    assert got == again and len(got) == n
    assert all(0 < score <= 1 for score, _ in got.values())


def test_projection_sign(spark):
    rng = np.random.default_rng(2)
    values = rng.normal(size=(200, 5)) * [1, 9, 2, 4, 1]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(values)], "vec_id bigint, embedding array<double>")
    axes = np.linalg.svd(values - values.mean(axis=0), full_matrices=False)[2][:2]
    axes *= np.sign(axes[np.arange(2), np.abs(axes).argmax(axis=1)])[:, None]
    for r in P.project_2d(df).collect():
        assert (r.px, r.py) == pytest.approx(tuple(values[r.vec_id] @ axes.T), abs=1e-8)


def test_best_epochs_and_carry(spark):
    rows = [("r", e, a, v) for e, a, v in [(1, 1, 0.5), (1, 2, 0.4), (2, 3, 0.4), (3, 4, 0.3), (4, 5, 0.9), (5, 6, 0.2)]]
    log = X.latest_per_epoch(spark.createDataFrame(rows, "run string, epoch int, arrival int, val_loss double"))
    assert log.count() == 5
    assert [r.is_best for r in X.best_epochs(log).orderBy("epoch").collect()] == [True, False, True, False, True]
    assert [r.carried for r in X.periodic_eval(log, 2).orderBy("epoch").collect()] == [0.0, 0.4, 0.4, 0.9, 0.2]
    kept = {r.epoch for r in X.checkpoint_retention(X.best_epochs(log), 4).collect()}
    assert kept == {4, 5}


def test_grid_order(spark):
    lists = spark.createDataFrame([([1, 2], ["a", "b", "c"])], "p array<int>, q array<string>")
    rows = X.expand_grid(lists, ["p", "q"], "s").orderBy("run_name").collect()
    assert [(r.run_name, r.p, r.q) for r in rows][:4] == [("s_001", 1, "a"), ("s_002", 1, "b"), ("s_003", 1, "c"), ("s_004", 2, "a")]
    assert X.expand_grid(lists, ["p", "q"], max_runs=2).count() == 2
    empty = lists.withColumn("q", F.slice("q", 1, 0))
    assert X.expand_grid(empty, ["p", "q"]).count() == 0 and X.expand_grid(lists.limit(0), ["p", "q"]).count() == 0
    many = spark.sql("select sequence(1, 300) as p, sequence(1, 200) as q")
    assert X.expand_grid(many, ["p", "q"]).select("p", "q").distinct().count() == 60_000


def test_views_fall_back_to_the_untouched_one(spark):
    rows = [(1, True, None, None, [1.0, 0.0]), (1, False, "s", 0, [0.0, 1.0]), (1, False, "t", 0, [1.0, 0.0]), (1, False, "t", 1, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "item int, is_anchor boolean, strategy string, view_idx int, embedding array<double>")
    assert {(r.strategy, r.view_idx) for r in tta.used_views(df).collect()} == {("s", 0), ("t", 1)}


def test_label_map_files(spark, tmp_path):
    (tmp_path / "h.csv").write_text("label,path\nx,/a\ny,/b\n")
    (tmp_path / "p.csv").write_text("/a,x\n/b,y\n")
    (tmp_path / "bad.csv").write_text("/a,x\n/b\n")
    read = lambda n: {(r.path, r.label) for r in L.read_label_map(spark, str(tmp_path / n)).collect()}
    assert read("h.csv") == read("p.csv") == {("/a", "x"), ("/b", "y")}
    with pytest.raises(PySparkException, match="without a label: /b"):
        read("bad.csv")


def test_scan_files_and_archives(spark, tmp_path):
    for name in ("c1/a.PNG", "c1/b.txt", "c2/d.jpg"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"12345")
    got = SF.scan_files(spark, [str(tmp_path)]).collect()
    assert sorted(r.path.rsplit("/", 1)[1] for r in got) == ["a.PNG", "d.jpg"] and {r.length for r in got} == {5}
    with pytest.raises(PySparkException):
        SF.scan_files(spark, [str(tmp_path / "missing")]).collect()
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("in/a.pdf", b"abc")
    rows = SF.scan_archive(spark, [str(tmp_path / "z.zip")]).collect()
    assert [(r.member, r.size, bytes(r.content)) for r in rows] == [("in/a.pdf", 3, b"abc")]
    with pytest.raises(PySparkException, match="unsupported archive"):
        SF.scan_archive(spark, [str(tmp_path / "c1" / "b.txt")]).collect()


def test_store(spark, tmp_path):
    schema = "id string, embedding array<double>, original_filename string, page_num int, component_type string, parent_pdf_id string"
    row = lambda i, page: (i, [1.0], "f", page, "roi_0", "D")
    store = S.VectorStore(spark, str(tmp_path / "s"))
    first = spark.createDataFrame([row("a", 1), row("a", 1), row("b", 1)], schema)
    store.append(first, 0)
    store.append(spark.createDataFrame([row("a", 2)], schema), 1)
    store.append(spark.createDataFrame([row("a", 2)], schema), 1)  # the same batch again
    state = lambda s: {(r.id, r.page_num) for r in s.current().collect()}
    assert state(store) == {("a", 2), ("b", 1)} and store.current().count() == 2
    merged = S.upsert(store.versions(), first.limit(1).withColumn("version", F.lit(7)))
    assert {(r.id, r.version) for r in merged.collect()} == {("a", 7), ("b", 0)}
    assert state(store.compact(str(tmp_path / "c"))) == {("a", 2), ("b", 1)}
    with pytest.raises(ValueError, match="page_num"):
        store.append(first.drop("page_num"), 2)
    with pytest.raises(PySparkException, match="metadata lacks page_num for id a"):
        store.append(spark.createDataFrame([("a", [1.0], "f", None, "roi_0", "D")], schema), 3)


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("m", 1.5, [1, 2])], "name string, value double, histogram array<int>")
    R.write_profile_summary(df, str(tmp_path / "eda"))
    lines = [p.read_text() for p in (tmp_path / "eda" / "summary").glob("part-*.json")]
    assert [json.loads(t) for t in lines if t] == [{"name": "m", "value": 1.5}]
    with pytest.raises(ValueError, match="unknown report format"):
        R.write_report(df, str(tmp_path / "x"), "xml")


def test_stream_equals_batch_and_resumes(spark, tmp_path):
    schema = "id string, embedding array<double>, original_filename string, page_num int, component_type string, parent_pdf_id string"
    rows = lambda a, b: spark.createDataFrame([(f"i{n}", [float(n)], "f", n, "roi_0", "D") for n in range(a, b)], schema)
    rows(0, 5).write.parquet(str(tmp_path / "in"))
    store = S.VectorStore(spark, str(tmp_path / "store"))
    go = lambda: J.stream_index(J.read_parquet_stream(spark, str(tmp_path / "in"), schema), store, str(tmp_path / "cp")).awaitTermination()
    go()
    rows(3, 9).write.mode("append").parquet(str(tmp_path / "in"))
    go()
    assert {r.id for r in store.current().collect()} == {f"i{n}" for n in range(9)}
    assert store.versions().count() == 11  # 5 and 6 rows: the first files were not read again


def test_config(spark):
    df = spark.sql("select named_struct('lr', 0.1, 'opt', named_struct('name', repeat('x', 300))) as train, 1 as seed")
    flat = R.flatten_config(df, limit=250)
    assert flat.columns == ["train.lr", "train.opt.name", "seed"] and len(flat.first()[1]) == 250
    assert R.config_map(flat).first().params["train.lr"] == "0.1"


def test_components_are_dealt_out_by_task_rows(spark, tmp_path, monkeypatch):
    """Rows of a large component table are not merged into a task for each core."""
    monkeypatch.setattr(ordering, "TASK_ROWS", 40)
    line = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double"
    spark.createDataFrame([(i // 4, i % 4, i * 7, i * 3, 5.0, 1.0, 0.0, 0.0) for i in range(2000)], line).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(i, f"p{i % 5}") for i in range(500)], "o_orderkey long, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    rows = fixtures.cmp(spark, str(tmp_path)).select("image_id", "label", F.spark_partition_id().alias("part")).collect()
    assert sorted((r.image_id, r.label) for r in rows) == [(i, k) for i in range(500) for k in range(1, 5)]
    assert max(Counter(r.part for r in rows).values()) <= 5 * 40
