import numpy as np
import pytest
from pyspark.sql import functions as F

from galleryspark.operators import knn as K
from galleryspark.operators.cells import Cells, draw_pivots
from galleryspark.operators.ordering import sample_n
from galleryspark.sources.cell_index import CellIndex


def table(spark, values, ids=None):
    ids = ids if ids is not None else range(len(values))
    return spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in zip(ids, values)], "id bigint, embedding array<float>")


def asked(df):
    return df.select(F.col("id").alias("query_id"), "embedding")


def ranked(df):
    return {(r.query_id, r["rank"]): (r.id, round(r.score, 6)) for r in df.collect()}


def clusters(seed=5, groups=30, each=20):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, 8)) * 10
    values = np.repeat(centres, each, axis=0) + rng.normal(size=(groups * each, 8)) * 0.3
    return values.astype(np.float32)


def unit(values):
    values = np.asarray(values, dtype=np.float64)
    return values / np.maximum(np.linalg.norm(values, axis=1, keepdims=True), 1e-12)


def first_best(value):
    return np.argmax(np.round(value, 12), axis=1)


@pytest.mark.parametrize("cells,cell_rows", [(5000, 16384), (300, 40)])
def test_cells_beyond_one_broadcast(spark, cells, cell_rows):
    """More cells than coarse pivots may be, and coarse cells that are cut on both sides, against plain assignment."""
    rng = np.random.default_rng(1)
    values = rng.normal(size=(5600 if cells > 4096 else 700, 3)).astype(np.float32)
    values[50:250] = values[7]  # many copies: one pivot at most
    values[[3, 9]] = 0
    rows = table(spark, values).select("id", F.col("embedding").alias("gv"))
    cut = Cells.over(draw_pivots(rows, cells), 4 if cells == 300 else None)
    got = {r.id: (r.coarse, r.cell) for r in cut.place(rows, "id", "gv", cell_rows=cell_rows).select("id", "coarse", "cell").collect()}

    order = [r.id for r in sample_n(rows, cells, 42, F.col("id")).select("id").collect()]
    number, vectors = [], []
    for place, i in enumerate(order, 1):
        if not any(np.array_equal(values[i], v) for v in vectors[-1:]) and values[i].tobytes() not in {v.tobytes() for v in vectors}:
            number.append(place)
            vectors.append(values[i])
        if cells > 4096 and len(vectors) > 400:
            break
    if cells > 4096:  # the numbers of the first pivots; all rows keep the rule below with the pivots themselves
        held = {r.cell: np.array(r.pv) for r in cut.pivots.collect()}
        assert sorted(held)[:400] == number[:400]
        number, pivots = sorted(held), np.array([held[c] for c in sorted(held)])
    else:
        pivots = unit(vectors)
    number = np.array(number)
    count = 4 if cells == 300 else int(np.ceil(np.sqrt(len(number))))
    home = first_best(pivots @ pivots[:count].T)
    mine = first_best(unit(values) @ pivots[:count].T)
    for i in range(len(values)):
        own = np.nonzero(home == mine[i])[0]
        best = own[first_best(unit(values[i : i + 1]) @ pivots[own].T)[0]]
        assert got[i] == (number[mine[i]], number[best])


def test_all_cells_are_exact_and_rows_are_replaced(spark, tmp_path):
    values = clusters()
    values[40:240] = values[3]  # a third of all rows are copies
    values[[1, 500]] = 0
    wrong = values.copy()
    wrong[::4] = wrong[::4, ::-1] * 3
    path = str(tmp_path / "index")
    index = CellIndex.create(table(spark, wrong[:450]), path, cells=25)
    index.add(table(spark, values[450:], range(450, 600)), 1)
    index.add(table(spark, values[:450:4], range(0, 450, 4)), 2)
    df = table(spark, values)
    few = asked(df.where("id % 11 = 0"))
    exact = ranked(K.knn(few, df, 5, metric="cosine", exclude_self=True).withColumn("score", 1 - F.col("score")))
    pivots = index.cells().pivots.count()
    assert ranked(index.search(few, 5, probes=pivots, wide=pivots, exclude_self=True)) == exact
    assert ranked(index.search(few, 5, probes=pivots, wide=pivots, exclude_self=True, cell_rows=30)) == exact
    index.add(table(spark, wrong), 2)  # that batch is there already
    assert index.rows().count() == 600
    assert ranked(index.search(few, 5, probes=pivots, wide=pivots, exclude_self=True)) == exact


def test_a_batch_without_commit_does_not_count(spark, tmp_path):
    values = clusters(groups=5)
    path = str(tmp_path / "index")
    index = CellIndex.create(table(spark, values), path, cells=6)
    index.add(table(spark, values[:30] + 1, range(30)), 1)
    (tmp_path / "index" / "commits" / "batch=1" / "_SUCCESS").unlink()  # as a run leaves it that was lost at the end
    held = {r.id: list(r.gv) for r in index.rows().collect()}
    assert len(held) == 100 and all(np.allclose(held[i], values[i]) for i in range(30))
    index.add(table(spark, values[:10] + 2, range(10)), 1)  # written over
    held = {r.id: list(r.gv) for r in index.rows().collect()}
    assert len(held) == 100
    assert all(np.allclose(held[i], values[i] + (2 if i < 10 else 0), atol=1e-5) for i in range(100))


def test_other_columns_filter_and_names(spark, tmp_path):
    values = clusters(groups=6)
    df = table(spark, values).withColumn("kind", F.concat(F.lit("k"), (F.col("id") % 3).cast("string")))
    index = CellIndex.create(df, str(tmp_path / "index"), cells=9)
    index.add(df.where("id < 12").withColumn("note", F.lit("late")), 1)
    pivots = index.cells().pivots.count()
    found = ranked(index.search(asked(df), 4, probes=pivots, wide=pivots, where=F.col("kind") == "k1"))
    exact = K.knn(asked(df), df, 4, metric="cosine", where=F.col("kind") == "k1").withColumn("score", 1 - F.col("score"))
    assert found == ranked(exact)
    assert index.rows().where("note = 'late'").count() == 12
    with pytest.raises(ValueError, match="cell"):
        index.add(df.withColumn("cell", F.lit(1)), 2)
    with pytest.raises(ValueError, match="empty"):
        CellIndex.create(df.where("false"), str(tmp_path / "none"))
    with pytest.raises(ValueError, match="at least 1"):
        index.search(asked(df), 0, probes=1)


def test_few_probes_find_clusters_and_read_few_folders(spark, tmp_path):
    values = clusters()
    df = table(spark, values)
    index = CellIndex.create(df, str(tmp_path / "index"), cells=60)
    few = asked(df.where("id % 10 = 0"))
    exact = K.knn(few, df, 5, metric="cosine")
    curve = {r.probes: r.recall for r in index.recall(few, exact, [4, 8, 60], wide=8).collect()}
    assert curve[4] <= curve[8] <= curve[60] and curve[8] >= 0.9
    found = K.recall_at_k(index.search(few, 5, probes=8, wide=8), exact).first()
    assert found.recall == pytest.approx(curve[8]) and found.queries == 60
    one = asked(df.where("id = 0"))
    wanted = index.cells().probes(one.select("query_id", F.col("embedding").alias("qv")), 3)
    plan = index._wanted_rows(wanted)._jdf.queryExecution().executedPlan().toString()
    scan = plan[plan.index("PartitionFilters") :]
    assert "coarse" in scan.split("PushedFilters")[0] and "cell" in scan.split("PushedFilters")[1].split("ReadSchema")[0]
    everything = index.rows().count()
    assert 0 < index._wanted_rows(wanted).count() < everything / 4
