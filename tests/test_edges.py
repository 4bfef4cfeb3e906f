"""Rows that earlier versions lost, doubled or ranked wrongly."""

import numpy as np
from pyspark.sql import Row, functions as F

from galleryspark.operators import blocks, components as C, curation, retrieval, vector_stats as S
from galleryspark.sources.labels import read_label_map
from galleryspark.sources.reports import flatten_config
from galleryspark.sources.store import VectorStore


def test_null_class_keeps_its_rows(spark):
    df = spark.createDataFrame([(None, "a", 1), (None, "b", 2), ("x", "c", 3), ("x", None, 4)], "c string, g string, id long")
    out = curation.stratified_split(df, "c", "g").collect()
    assert sorted(r["id"] for r in out) == [1, 2, 3, 4]
    assert {r["split"] for r in out} <= {"train", "test"}


def test_repeated_label_paths_and_bare_names(spark, tmp_path):
    (tmp_path / "labels.csv").write_text("path,label\na/x.png,old\na/x.png,new\n")
    labels = read_label_map(spark, str(tmp_path / "labels.csv"))
    assert [tuple(r) for r in labels.collect()] == [("a/x.png", "new")]
    rows = spark.createDataFrame([("a/x.png", "a/x.png"), ("y.png", "y.png")], "resolved_path string, path string")
    doubled = labels.union(labels)
    got = {r["path"]: r["lookup_label"] for r in retrieval.with_lookup_label(rows, doubled).collect()}
    assert got == {"a/x.png": "new", "y.png": None}
    assert retrieval.with_lookup_label(rows, doubled).count() == 2


def test_area_zero_ranks_last(spark):
    rows = [Row(image_id=1, label=k, x=0, y=0, w=w, h=w, n_holes=0, pixel_area=w * w) for k, w in ((1, 0), (2, 3), (3, 9))]
    df = spark.createDataFrame(rows)
    places = {r["label"]: r["place"] for r in C.order_by_topology(df).collect()}
    assert places == {3: 1, 2: 2, 1: 3}
    kinds = {r["label"]: r["size_class"] for r in C.large_and_small(df, 1, remove_largest=False).collect()}
    assert kinds == {3: "large", 2: "small", 1: "small"}


def test_near_copies_keep_their_distances(spark):
    base = np.linspace(1, 2, 64)
    rows = np.array([base, base + 1e-7, base + 2e-7, base + 3e-7])
    want = np.sqrt(((rows[:, None] - rows[None]) ** 2).sum(2))
    assert np.allclose(-blocks.scores(rows, rows, "l2"), want, rtol=1e-6, atol=0)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "vec_id long, embedding array<double>")
    stats = S.pairwise_distance_stats(df).first()
    assert np.isclose(stats["max_distance"], want.max(), rtol=1e-6) and stats["pairs"] == 6


def test_streams_add_versions(spark, tmp_path):
    """The newest write counts, whichever stream it comes from; a batch that is run again keeps its place."""
    store = VectorStore(spark, str(tmp_path / "store"))
    row = lambda page: spark.createDataFrame([("a", [1.0], "f", page, "roi_0", "D")], "id string, embedding array<double>, original_filename string, page_num int, component_type string, parent_pdf_id string")
    page = lambda: store.current().first().page_num
    assert [store.append_batch(row(1), "p", 0), store.append_batch(row(2), "q", 0)] == [0, 1] and page() == 2
    assert store.append_batch(row(3), "p", 1) == 2 and page() == 3
    assert store.append_batch(row(4), "q", 0) == 1 and page() == 3
    store.append(row(5), 3)
    assert page() == 5 and store.append_batch(row(6), "q", 1) == 4 and page() == 6
    assert "stream" not in store.current().columns and store.versions().count() == 5


def test_config_values_stay_whole(spark):
    df = spark.range(1).select(F.struct(F.repeat(F.lit("x"), 300).alias("b")).alias("a"))
    assert len(flatten_config(df).first()[0]) == 300
