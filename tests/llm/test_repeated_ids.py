"""Repeated doc_ids, odd rows and empty tables in the Jaccard join and in every stage of the pipeline."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from galleryspark.llm.common import discard, folders_made, store
from galleryspark.llm.jaccard_join import jaccard_components
from test_corpus import ODD, SCHEMA, SF, components_of, prose

STAGES = dict(corpus_pipeline.STAGES)


def got_and_want(spark, rows, n=3, percent=90):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(map(tuple, jaccard_components(df, n, percent).collect()), key=str), components_of(rows, n, percent)


def test_two_texts_of_one_document(spark):
    t1, t2 = prose(50, 121), prose(51, 121)
    rows = [(5, t1), (5, t2), (6, t1 + " more"), (7, t2 + " more")]  # equally many shingles
    got, want = got_and_want(spark, rows)
    assert got == want and {c for _, _, c in got} == {5}
    rows = [(5, t1), (7, t1), (7, t2), (8, t2 + " more"), (8, ""), (9, None), (9, prose(52, 40)), (10, ""), (10, None), (None, t1)]
    got, want = got_and_want(spark, rows)
    assert got == want and {c for d, _, c in got if d in (5, 7, 8)} == {5}


def test_random_repeated_ids(spark):
    rng = np.random.default_rng(8)
    bases = [prose(60 + k, 70).split() for k in range(12)]
    rows = []
    for k in range(120):
        words = list(bases[int(rng.integers(0, 12))])
        for at in rng.choice(70, int(rng.integers(0, 3)), replace=False):
            words[at] = f"own{k}"
        rows.append((int(rng.integers(0, 60)), " ".join(words)))
    for n, percent in ((3, 90), (5, 80)):
        got, want = got_and_want(spark, rows, n, percent)
        assert got == want


def stage(spark, tmp_path, name, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.mode("overwrite").parquet(str(tmp_path / "in"))
    docs = spark.read.parquet(str(tmp_path / "in"))
    out = STAGES[name](spark, docs, SF)
    if name != "best_fit_packing":
        assert out.columns == docs.columns
    return out.collect()


@pytest.mark.parametrize("name", list(STAGES))
def test_stage_takes_odd_rows_and_none(spark, tmp_path, name):
    assert stage(spark, tmp_path, name, []) == []
    out = stage(spark, tmp_path, name, ODD)
    if name == "quality_rules":
        assert sorted(r["doc_id"] or 0 for r in out) == [0, 6, 7, 8, 8, 9, 9]
    elif name in ("line_dedup", "benchmark_decontamination"):
        assert sorted(r["doc_id"] or 0 for r in out) == sorted(r[0] or 0 for r in ODD)
        assert {r["text"] for r in out if r["doc_id"] in (1, 2, 3)} == {None, "", " \n\t "}
    elif name == "ngram_jaccard_join":  # 7 is a near copy of 6, one of the equal rows of 9 goes, both texts of 8 stay
        assert sorted(r["doc_id"] or 0 for r in out) == [0, 1, 2, 3, 4, 5, 6, 8, 8, 9, 10]
    else:
        assert {r["doc_id"] for r in out} == {r[0] for r in ODD}


def test_texts_of_one_id_go_only_as_near_copies(spark, tmp_path):
    a, b = prose(70, 100), prose(71, 100)
    row = lambda d, t: (d, t, "en", "h", 1, None, None)
    rows = [row(1, a), row(1, a), row(1, a + " x"), row(1, b), row(2, b + " y"), row(3, prose(72, 100)), row(None, a), row(None, a)]
    out = stage(spark, tmp_path, "ngram_jaccard_join", rows)
    kept = [(r["doc_id"], r["text"]) for r in out]
    assert sum(t.startswith(a) for d, t in kept if d is not None) == 1 and sum(t.startswith(b) for _, t in kept) == 1
    assert (3, prose(72, 100)) in kept and sum(d is None for d, _ in kept) == 2 and len(kept) == 5


def test_folders_of_earlier_stages_go(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    made = []
    for k, (name, function) in enumerate(corpus_pipeline.STAGES[:3]):
        out = function(spark, docs, SF)
        here = list(corpus_pipeline._left)
        assert not set(made) & set(here) and not any(os.path.exists(p.removeprefix("file:")) for p in made)
        out.write.parquet(str(tmp_path / str(k)))
        made, docs = here, spark.read.parquet(str(tmp_path / str(k)))
    unwritten = STAGES["line_dedup"](spark, docs, SF)
    kept = STAGES["quality_rules"](spark, unwritten, SF)  # not written in between: what it reads stays
    assert kept.count() > 0


def test_discard(spark):
    with folders_made() as made:
        first = store(spark.range(3).toDF("x"), "first")
        second = store(first.where("x > 0"), "second")
    assert len(made) == 2
    discard(first, None, spark.range(1), second.select(F.col("x")))
    discard(first)
    assert not os.path.exists(made[0].removeprefix("file:")) and second.count() == 2
