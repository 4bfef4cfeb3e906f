"""Exact neighbours in a gallery of many blocks: a block that cannot hold a neighbour is never sent a query.

Each gallery vector belongs to its nearest pivot, and the vectors of a pivot are cut into rings by their distance to
it. Pivot, smallest and largest distance and longest vector of a ring bound the score of anything inside. A query first
searches the blocks with the best bounds until they hold k rows; its k-th score there then rules out every block whose bound
lies below. The result does not depend on pivots or rings, only the amount of work does. Where the bounds rule out too little (vectors
of many independent dimensions are all about equally far), the plain grid of larger blocks sends less and takes over.

Pivots and rings are limited in number, so what the tasks know of them is too (``MAX_PIVOTS`` x ``RINGS`` rows of five
numbers); a block beyond the size of a cell, for example a large group of copies, is cut by id into a grid of its own.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from galleryspark.operators import blocks
from galleryspark.operators.ordering import sample_n
from galleryspark.session import cut_lineage

MAX_PIVOTS = 4_096
RINGS = 16  # blocks of one pivot at most
BLOCKS_PER_CELL = 4  # pivots for every full cell of the gallery: finer blocks are ruled out more often
SLACK = 1e-9  # share of the lengths that rounding may cost a bound
GRID_SHARE = 1.0  # beyond this share of the queries a plain grid would send, the grid is taken
TIE = 10.0**-blocks.TIE_DECIMALS  # scores this close may be ties


@dataclass
class Work:
    """Candidates of a search and what it took: (query_id, first, rest) blocks per query, ``total`` blocks in all.

    ``by_blocks`` is false where the plain grid was cheaper than the blocks that stayed open.
    """

    partial: DataFrame
    searched: DataFrame
    total: int
    by_blocks: bool

    def counts(self) -> DataFrame:
        """One row: queries, blocks, queries sent to blocks in the first and the second pass, those skipped, and ``by_blocks``."""
        sums = self.searched.agg(
            F.count(F.lit(1)).alias("queries"),
            F.coalesce(F.sum(F.size("first")), F.lit(0)).alias("first_pass"),
            F.coalesce(F.sum(F.size("rest")), F.lit(0)).alias("second_pass"),
        )
        total = F.lit(self.total).cast("long")
        skipped = F.col("queries") * total - F.col("first_pass") - F.col("second_pass")
        return sums.withColumn("blocks", total).withColumn("skipped", skipped).withColumn("by_blocks", F.lit(self.by_blocks))


class Bounds:
    """Upper bounds of the scores of queries inside blocks."""

    def __init__(self, metric: str, pivots: np.ndarray, stats: list):
        self.metric, self.pivots = metric, pivots
        self.cell = np.array([s.cell for s in stats], dtype=np.int64)
        self.pivot = self.cell // RINGS
        self.low = np.array([s.low for s in stats])
        self.high = np.array([s.high for s in stats])
        self.longest = np.array([s.longest for s in stats])
        self.rows = np.array([s.n for s in stats], dtype=np.int64)

    def of(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bound, what rounding may add to it, distance to the pivot) per query and block; ``queries`` in the space of the metric."""
        distance = np.sqrt(blocks.squared_distances(queries, self.pivots))[:, self.pivot]
        apart = np.maximum(np.maximum(distance - self.high, self.low - distance), 0.0)
        length = np.sqrt((queries**2).sum(1))[:, None]
        reach = length + self.longest + np.sqrt((self.pivots**2).sum(1))[self.pivot]
        if self.metric == "l2":
            return -apart, SLACK * reach + TIE, distance
        # q.v = (|q|^2 + |v|^2 - |q - v|^2) / 2, at most |q||v|, and q.v = q.p + q.(v - p)
        value = np.minimum((length**2 + self.longest**2 - apart**2) / 2, length * self.longest)
        value = np.minimum(value, (queries @ self.pivots.T)[:, self.pivot] + length * self.high)
        return value - (1.0 if self.metric == "cosine" else 0.0), SLACK * reach**2 + TIE, distance


def space(values: np.ndarray, metric: str) -> np.ndarray:
    """Vectors as the bounds see them: cosine is the inner product of unit vectors (a zero vector stays zero)."""
    return blocks.unit_rows(values) if metric == "cosine" else values


def search(
    left: DataFrame, right: DataFrame, k: int, metric: str, kernel: Callable, schema: str,
    cell_rows: int, n_left: int, n_right: int, spare: int = 0, seed: int = 42,
) -> Work:
    """The k best of every query in each block that may hold one of them.

    ``left``: (query_id, qv), ``right``: (id, gv); ``kernel`` returns (query_id, id, score, place) of a cell; ``spare``: rows
    of a block that may not count for a query (itself).
    """
    query_type, vector_type = dict(left.dtypes)["query_id"], dict(left.dtypes)["qv"]
    pivots = _pivots(right, metric, cell_rows, n_right, seed)
    placed, stats = _into_blocks(right, metric, pivots, cell_rows)
    shared = left.sparkSession.sparkContext.broadcast(Bounds(metric, pivots, stats))
    need = k + spare

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for pdf in batches:
            for part, bound, _, distance in _bounded(pdf, known):
                order = np.lexsort((distance, -np.round(bound, 9)))  # among equal bounds the nearest pivot first
                held = np.cumsum(known.rows[order], axis=1)
                wanted = held - known.rows[order] < need
                yield pdf.iloc[part].assign(first=[known.cell[o[w]] for o, w in zip(order, wanted)])

    asked = cut_lineage(left.mapInPandas(nearest, f"query_id {query_type}, qv {vector_type}, first array<long>"))
    first = cut_lineage(_compare(asked.withColumn("cell", F.explode("first")), placed, kernel, schema, stats, cell_rows))
    best = Window.partitionBy("query_id").orderBy(F.desc("place"), "id")
    kth = first.withColumn("_n", F.row_number().over(best)).where(F.col("_n") == k).select("query_id", F.col("place").alias("floor"))

    def remaining(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for pdf in batches:
            floor = pdf["floor"].to_numpy(dtype=np.float64, na_value=-np.inf)
            floor = np.where(np.isnan(floor), -np.inf, floor)  # fewer than k found: every block may hold more
            for part, bound, slack, _ in _bounded(pdf, known):
                open_to = bound + slack >= floor[part][:, None]
                rows = pdf.iloc[part]
                rest = [np.setdiff1d(known.cell[o], np.asarray(f)) for o, f in zip(open_to, rows["first"])]
                yield rows.assign(rest=rest)[["query_id", "qv", "first", "rest"]]

    searched = cut_lineage(
        asked.join(kth, "query_id", "left").mapInPandas(
            remaining, f"query_id {query_type}, qv {vector_type}, first array<long>, rest array<long>"
        )
    )
    sent = searched.agg(F.sum(F.size("rest")).alias("n")).first().n or 0
    if sent > GRID_SHARE * n_left * math.ceil(n_right / cell_rows):
        whole = blocks.grid(left, right, ["query_id"], ["id"], kernel, schema, cell_rows, n_left=n_left, n_right=n_right)
        return Work(whole, searched, len(stats), False)
    second = _compare(searched.withColumn("cell", F.explode("rest")), placed, kernel, schema, stats, cell_rows)
    return Work(first.unionByName(second), searched, len(stats), True)


def _bounded(pdf: pd.DataFrame, known: Bounds):
    if pdf.empty:
        return
    queries = space(blocks.matrix(pdf["qv"]), known.metric)
    for part in blocks.slices(len(queries), max(len(known.cell), len(known.pivots))):
        yield part, *known.of(queries[part])


def _pivots(right: DataFrame, metric: str, cell_rows: int, n_right: int, seed: int) -> np.ndarray:
    """Different vectors of the gallery in hash order, at most MAX_PIVOTS and CELL_BYTES."""
    wanted = max(2, min(MAX_PIVOTS, math.ceil(BLOCKS_PER_CELL * n_right / cell_rows), n_right))
    drawn = sample_n(right, min(wanted, blocks.cell_rows_for(right, "gv", MAX_PIVOTS)), seed, F.col("id")).select("gv").collect()
    return np.unique(space(np.array([r.gv for r in drawn], dtype=np.float64), metric), axis=0)


def _into_blocks(right: DataFrame, metric: str, pivots: np.ndarray, cell_rows: int) -> tuple[DataFrame, list]:
    """((id, gv, cell), one row of statistics per block)."""
    spark = right.sparkSession
    shared = spark.sparkContext.broadcast(pivots)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if pdf.empty:
                continue
            values = space(blocks.matrix(pdf["gv"]), metric)
            square = [blocks.squared_distances(values[part], shared.value) for part in blocks.slices(len(values), len(shared.value))]
            pivot = np.concatenate([s.argmin(axis=1) for s in square])
            away = np.concatenate([np.sqrt(s.min(axis=1)) for s in square])
            yield pdf.assign(pivot=pivot, away=away, length=np.sqrt((values**2).sum(1)))

    types = dict(right.dtypes)
    near = cut_lineage(
        right.mapInPandas(assign, f"id {types['id']}, gv {types['gv']}, pivot long, away double, length double")
    )
    cuts = [i / RINGS for i in range(1, RINGS)]
    per_pivot = near.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("away", cuts, 400).alias("cuts")).collect()
    edges = [(r.pivot, _ring_edges(r.cuts, r.n, cell_rows)) for r in per_pivot]  # at most MAX_PIVOTS rows
    edges = F.broadcast(spark.createDataFrame(edges, "pivot long, edges array<double>"))
    ring = F.size(F.filter("edges", lambda e: e < F.col("away")))
    placed = near.join(edges, "pivot").withColumn("cell", F.col("pivot") * RINGS + ring)
    stats = placed.groupBy("cell").agg(
        F.min("away").alias("low"), F.max("away").alias("high"), F.max("length").alias("longest"), F.count(F.lit(1)).alias("n")
    )
    return placed.select("id", "gv", "cell"), stats.collect()  # at most MAX_PIVOTS x RINGS rows


def _ring_edges(cuts: list[float], n: int, cell_rows: int) -> list[float]:
    """Every s-th of the quantiles, so that rings hold about half a cell."""
    rings = max(1, min(RINGS, math.ceil(2 * n / cell_rows)))
    step = math.ceil(RINGS / rings)
    return sorted(set(cuts[step - 1 :: step])) if rings > 1 else []


def _compare(left: DataFrame, placed: DataFrame, kernel: Callable, schema: str, stats: list, cell_rows: int) -> DataFrame:
    rows = {s.cell: s.n for s in stats}
    asked = left.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()  # at most one row per block
    sizes = left.sparkSession.createDataFrame(
        [(a.cell, a.n, rows[a.cell]) for a in asked], "cell long, n_left long, n_right long"
    )
    return blocks.grouped_grid(left.select("query_id", "qv", "cell"), placed, "cell", ["query_id"], ["id"], kernel, schema, sizes, cell_rows)
