"""Exact and approximate nearest neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from galleryspark.functions import vectors as V
from galleryspark.operators import blocks, pruned
from galleryspark.operators.ordering import sample_n

# A query side of at most this many rows is sent to the tasks; the gallery then stays in place.
SMALL_QUERY_ROWS = 2_048
MAX_CELLS = 4_096  # pivots of the approximate search


def knn(
    queries: DataFrame,
    gallery: DataFrame,
    k: int,
    metric: str = "ip",
    where: Column | None = None,
    exclude_self: bool = False,
    query_id: str = "query_id",
    gallery_id: str = "id",
    vector: str = "embedding",
    small_rows: int = SMALL_QUERY_ROWS,
    cell_rows: int = blocks.CELL_ROWS,
) -> DataFrame:
    """Exact top-k: (query_id, id, rank, score).

    ``ip`` ranks by descending inner product; ``cosine`` and ``l2`` by ascending distance, which is
    then the score. Ties are broken by gallery id; k is clamped to the gallery. ``where`` filters
    the gallery before ranking. Few queries travel to the gallery; a gallery of one cell meets the queries in a block grid; in
    a larger one a query is sent only to the blocks that may hold one of its neighbours (``pruned``).
    """
    left, right, n_left, n_right, rows = _sides(queries, gallery, k, where, query_id, gallery_id, vector, cell_rows)
    top = _TopK(k, metric, exclude_self)
    schema = _schema(left, right)
    if n_left <= min(small_rows, rows) and n_right >= 16 * n_left:
        partial = _queries_to_gallery(left, right, top, schema)
    elif n_right > rows:
        partial = pruned.search(left, right, k, metric, top.of_cell, schema, rows, n_left, n_right, int(exclude_self)).partial
    else:
        partial = blocks.grid(
            left, right, ["query_id"], ["id"], top.of_cell, schema, rows, n_left=n_left, n_right=n_right
        )
    return _best_of(partial, k, metric)


def knn_work(
    queries: DataFrame,
    gallery: DataFrame,
    k: int,
    metric: str = "ip",
    where: Column | None = None,
    exclude_self: bool = False,
    query_id: str = "query_id",
    gallery_id: str = "id",
    vector: str = "embedding",
    cell_rows: int = blocks.CELL_ROWS,
) -> DataFrame:
    """What the block search of ``knn`` takes: one row (queries, blocks, first_pass, second_pass, skipped, by_blocks)."""
    left, right, n_left, n_right, rows = _sides(queries, gallery, k, where, query_id, gallery_id, vector, cell_rows)
    top = _TopK(k, metric, exclude_self)
    work = pruned.search(left, right, k, metric, top.of_cell, _schema(left, right), rows, n_left, n_right, int(exclude_self))
    return work.counts()


def _sides(queries, gallery, k, where, query_id, gallery_id, vector, cell_rows):
    if k < 1:
        raise ValueError("k must be at least 1")
    if where is not None:
        gallery = gallery.where(where)
    left = queries.select(F.col(query_id).alias("query_id"), blocks.stored(queries, vector).alias("qv"))
    right = gallery.select(F.col(gallery_id).alias("id"), blocks.stored(gallery, vector).alias("gv"))
    n_left, n_right = left.count(), right.count()
    if not n_right:
        raise ValueError("the gallery is empty")
    return left, right, n_left, n_right, min(cell_rows, blocks.cell_rows_for(right, "gv"))


def _schema(left: DataFrame, right: DataFrame) -> str:
    return f"query_id {dict(left.dtypes)['query_id']}, id {dict(right.dtypes)['id']}, score double, place double"


def _best_of(partial: DataFrame, k: int, metric: str) -> DataFrame:
    """The k best of the candidates that the tasks returned, at most k per query and task."""
    best = Window.partitionBy("query_id").orderBy(F.desc("place"), "id")
    ranked = partial.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    shown = F.col("score") if metric == "ip" else -F.col("score")
    return ranked.select("query_id", "id", "rank", shown.alias("score"))


class _TopK:
    """The k best gallery rows of each query among the rows a task sees."""

    def __init__(self, k: int, metric: str, exclude_self: bool):
        self.k, self.metric, self.exclude_self = k, metric, exclude_self

    def of_cell(self, lpdf: pd.DataFrame, rpdf: pd.DataFrame) -> pd.DataFrame:
        if lpdf.empty or rpdf.empty:
            return pd.DataFrame({"query_id": [], "id": [], "score": [], "place": []})
        return self.of(lpdf["query_id"].to_numpy(), blocks.matrix(lpdf["qv"]), rpdf)

    def of(self, query_ids: np.ndarray, qv: np.ndarray, rpdf: pd.DataFrame) -> pd.DataFrame:
        gallery = rpdf.sort_values("id", kind="stable")
        ids, gv = gallery["id"].to_numpy(), blocks.matrix(gallery["gv"])
        if self.metric == "cosine":  # once, not per slice
            qv, gv = blocks.unit_rows(qv), blocks.unit_rows(gv)
        if self.exclude_self:  # compared as numbers
            both = np.concatenate([query_ids, ids])
            codes, _ = pd.factorize(both)
            asked, held = codes[: len(query_ids)], codes[len(query_ids) :]
            if both.dtype != object:
                held[held < 0] = -2  # a number that is missing equals no other
        found = []
        for part in blocks.slices(len(qv), len(gv)):
            value = qv[part] @ gv.T - 1.0 if self.metric == "cosine" else blocks.scores(qv[part], gv, self.metric)
            if self.exclude_self:
                value[asked[part][:, None] == held[None, :]] = -np.inf
            row, col = blocks.best_k(value, self.k)
            score = value[row, col]
            place = np.round(score, blocks.TIE_DECIMALS)  # what decides the rank
            found.append(pd.DataFrame({"query_id": query_ids[part][row], "id": ids[col], "score": score, "place": place}))
        return pd.concat(found, ignore_index=True)


def _queries_to_gallery(left: DataFrame, right: DataFrame, top: _TopK, schema: str) -> DataFrame:
    rows = left.collect()  # at most SMALL_QUERY_ROWS rows and CELL_BYTES, checked by the caller
    query_ids = np.array([r.query_id for r in rows], dtype=object if rows and isinstance(rows[0].query_id, str) else None)
    shared = left.sparkSession.sparkContext.broadcast((query_ids, np.array([r.qv for r in rows], dtype=np.float64)))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        query_ids, qv = shared.value
        held = None
        for pdf in batches:
            if pdf.empty or not len(query_ids):
                continue
            found = top.of(query_ids, qv, pdf)
            both = found if held is None else pd.concat([held, found], ignore_index=True)
            both = both.sort_values(["query_id", "place", "id"], ascending=[True, False, True], kind="stable")
            held = both.groupby("query_id", sort=False).head(top.k)
        if held is not None:
            yield held

    return right.mapInPandas(scan, schema)


def candidate_pool(seeds: DataFrame, universe: DataFrame, k: int, **names) -> DataFrame:
    """Top-k candidates of every seed, the seed itself excluded (clamped to N - 1)."""
    return knn(seeds, universe, k, metric="cosine", exclude_self=True, **names).withColumn(
        "score", V.similarity_from_distance(F.col("score"))
    )


def drop_same_path(neighbors: DataFrame, paths: DataFrame, k: int, refill: bool = False) -> DataFrame:
    """Remove neighbours whose path equals the query's path and close the ranks.

    Ranking happens before the removal, so k - 1 rows may remain. With ``refill`` the caller passes
    k + 1 neighbours per query and the list is cut back to k.
    """
    q = paths.select(F.col("id").alias("query_id"), F.col("path").alias("query_path"))
    g = paths.select("id", "path")
    kept = neighbors.join(q, "query_id").join(g, "id").where(F.col("path") != F.col("query_path"))
    ordered = Window.partitionBy("query_id").orderBy("rank")
    kept = kept.withColumn("rank", F.row_number().over(ordered))
    return kept.where(F.col("rank") <= k) if refill else kept


def centroid_query(views: DataFrame, gallery: DataFrame, k: int, by: str, vector: str = "embedding", **options) -> DataFrame:
    """Neighbours of the re-normalised mean of the views of each item."""
    from galleryspark.operators.vector_stats import centroid

    queries = centroid(views, [by], vector).select(F.col(by).alias("query_id"), F.col("centroid").alias(vector))
    return knn(queries, gallery, k, vector=vector, **options)


def ann_knn(
    queries: DataFrame,
    gallery: DataFrame,
    k: int,
    cells: int | None = None,
    probes: int = 8,
    seed: int = 42,
    exclude_self: bool = False,
    query_id: str = "query_id",
    gallery_id: str = "id",
    vector: str = "embedding",
    cell_rows: int = blocks.CELL_ROWS,
) -> DataFrame:
    """Approximate cosine top-k: each query searches only the ``probes`` cells nearest to it.

    The cells are the neighbourhoods of ``cells`` pivots (by default the square root of the gallery size, at
    most 4096), drawn from the gallery in hash order. A crowded cell is cut into a grid of its own, so no
    task grows with it and no pairs are written. With all cells probed the result is exact.
    """
    left = queries.select(F.col(query_id).alias("query_id"), blocks.stored(queries, vector).alias("qv"))
    right = gallery.select(F.col(gallery_id).alias("id"), blocks.stored(gallery, vector).alias("gv"))
    n_right = right.count()
    if not n_right:
        raise ValueError("the gallery is empty")
    cells = min(cells or max(1, round(n_right**0.5)), MAX_CELLS, n_right)
    pivots = sample_n(right, cells, seed, F.col("id")).orderBy("id").collect()  # at most MAX_CELLS vectors
    shared = left.sparkSession.sparkContext.broadcast(blocks.unit_rows(np.array([p.gv for p in pivots], dtype=np.float64)))

    def nearest(column: str, count: int):
        def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if pdf.empty:
                    continue
                row, cell = blocks.best_k(blocks.unit_rows(blocks.matrix(pdf[column])) @ shared.value.T, count)
                yield pdf.iloc[row].assign(cell=cell)

        return assign

    asked = left.mapInPandas(nearest("qv", probes), f"query_id {dict(left.dtypes)['query_id']}, qv {dict(left.dtypes)['qv']}, cell bigint")
    stored = right.mapInPandas(nearest("gv", 1), f"id {dict(right.dtypes)['id']}, gv {dict(right.dtypes)['gv']}, cell bigint")
    sizes = stored.groupBy("cell").agg(F.count(F.lit(1)).alias("n_right")).join(
        asked.groupBy("cell").agg(F.count(F.lit(1)).alias("n_left")), "cell"
    )
    known = left.sparkSession.createDataFrame(sizes.collect(), sizes.schema)  # at most MAX_CELLS rows
    top = _TopK(k, "cosine", exclude_self)
    rows = min(cell_rows, blocks.cell_rows_for(right, "gv"))
    partial = blocks.grouped_grid(asked, stored, "cell", ["query_id"], ["id"], top.of_cell, _schema(left, right), known, rows)
    return _best_of(partial, k, "cosine").withColumn("score", V.similarity_from_distance(F.col("score")))


def recall_at_k(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact neighbours that the approximate list holds."""
    hit = found.select("query_id", "id", F.lit(1).alias("hit"))
    return exact.join(hit, ["query_id", "id"], "left").agg(
        F.countDistinct("query_id").alias("queries"),
        F.avg(F.coalesce("hit", F.lit(0)).cast("double")).alias("recall"),
    )
