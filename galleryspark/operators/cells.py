"""Two-level cells around pivots: as many as are asked for, without sending all pivots to every task.

Pivots are vectors of the gallery in hash order; the first of them (at most ``MAX_COARSE``) are the coarse ones, and every
pivot belongs to the coarse one nearest to it. A vector finds its coarse cell from a broadcast of the coarse pivots and its
cell in a block grid of vectors and pivots that share a coarse cell. So ``c`` cells cost a vector about ``2 sqrt(c)`` products.
Vectors count by direction (cosine); a zero vector scores 0 with every pivot and goes to the first. Ties go to the smaller number.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from galleryspark.operators import blocks
from galleryspark.operators.ordering import hash_key, hash_rank

MAX_COARSE = 4_096


def draw_pivots(rows: DataFrame, cells: int, seed: int = 42) -> DataFrame:
    """(cell, pv): unit vectors of the first ``cells`` rows (id, gv) in hash order; equal vectors among them are one pivot."""
    place = hash_key(seed, F.col("id"))
    last = hash_rank(rows.select("id"), seed, F.col("id"), rank="cell").where(F.col("cell") == cells).select(place.alias("h")).first()
    drawn = rows.where(place <= last.h) if last else rows  # the vectors themselves are not ranked, nor shuffled
    numbered = hash_rank(drawn, seed, F.col("id"), rank="cell").where(F.col("cell") <= cells)
    single = numbered.groupBy("gv").agg(F.min("cell").alias("cell"))

    def unit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"cell": pdf["cell"], "pv": list(blocks.unit_rows(blocks.matrix(pdf["gv"])))})

    return single.mapInPandas(unit, "cell bigint, pv array<double>")


@dataclass
class Cells:
    """Pivots (cell, coarse, pv) and the coarse ones among them, in the order of their numbers."""

    pivots: DataFrame
    numbers: np.ndarray
    coarse: np.ndarray

    @classmethod
    def over(cls, drawn: DataFrame, coarse: int | None = None) -> Cells:
        """``coarse``: how many of the pivots are coarse, by default the square root of their number."""
        count = drawn.count()
        if not count:
            raise ValueError("the gallery is empty")
        count = min(coarse or math.ceil(math.sqrt(count)), MAX_COARSE, count)
        cells = cls(drawn, *_vectors(drawn.orderBy("cell").limit(count)))
        return cls(cells.nearest_coarse(drawn, "pv", 1), cells.numbers, cells.coarse)

    @classmethod
    def stored(cls, pivots: DataFrame) -> Cells:
        """From a table (cell, coarse, pv, is_coarse)."""
        return cls(pivots.drop("is_coarse"), *_vectors(pivots.where("is_coarse").orderBy("cell")))

    def table(self) -> DataFrame:
        return self.pivots.withColumn("is_coarse", F.col("cell") <= int(self.numbers[-1]))

    def nearest_coarse(self, rows: DataFrame, vector: str, count: int) -> DataFrame:
        """Each row once for each of its ``count`` nearest coarse cells, with the column ``coarse``."""
        shared = rows.sparkSession.sparkContext.broadcast((self.numbers, self.coarse))

        def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            numbers, coarse = shared.value
            for pdf in batches:
                for part in blocks.slices(len(pdf), len(coarse)):
                    some = pdf.iloc[part]
                    row, col = blocks.best_k(blocks.unit_rows(blocks.matrix(some[vector])) @ coarse.T, count)
                    yield some.iloc[row].assign(coarse=numbers[col])

        return rows.mapInPandas(assign, f"{_types(rows)}, coarse bigint")

    def place(self, rows: DataFrame, key: str, vector: str, cell_rows: int = blocks.CELL_ROWS) -> DataFrame:
        """The rows with the columns ``coarse`` and ``cell``."""
        near = self.nearest_coarse(rows, vector, 1)
        columns = near.columns

        def of_cell(lpdf: pd.DataFrame, rpdf: pd.DataFrame) -> pd.DataFrame:
            found = [pd.DataFrame(columns=[*columns, "cell", "_near"])]
            pivots = rpdf.sort_values("cell")
            for part in blocks.slices(len(lpdf), len(pivots)) if len(pivots) else ():
                some = lpdf.iloc[part]
                value = blocks.unit_rows(blocks.matrix(some[vector])) @ blocks.matrix(pivots["pv"]).T
                row, col = blocks.best_k(value, 1)
                near = np.round(value[row, col], blocks.TIE_DECIMALS)
                found.append(some.iloc[row][columns].assign(cell=pivots["cell"].to_numpy()[col], _near=near))
            return pd.concat(found[1:] or found, ignore_index=True)

        sizes = self._sizes(near)
        placed = blocks.grouped_grid(
            near, self.pivots, "coarse", [key], ["cell"], of_cell, f"{_types(near)}, cell bigint, _near double", sizes, cell_rows
        )
        if sizes.where(F.col("n_right") > cell_rows).isEmpty():
            return placed.drop("_near")
        # A coarse cell of so many pivots was cut; the best of its parts counts.
        rest = [c for c in placed.columns if c not in (key, "_near")]
        best = placed.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct("_near", -F.col("cell"))).alias("_row"))
        return best.select(key, "_row.*").select(*columns, "cell")

    def probes(self, queries: DataFrame, probes: int, wide: int | None = None, cell_rows: int = blocks.CELL_ROWS) -> DataFrame:
        """(query_id, coarse, cell, place): the ``probes`` nearest cells of every query (query_id, qv), the nearest at place 1,
        out of the ``wide`` nearest coarse cells (by default as many as ``probes``)."""
        near = self.nearest_coarse(queries.select("query_id", "qv"), "qv", min(wide or probes, len(self.numbers)))
        kind = dict(queries.dtypes)["query_id"]

        def of_cell(lpdf: pd.DataFrame, rpdf: pd.DataFrame) -> pd.DataFrame:
            found = [pd.DataFrame({"query_id": [], "coarse": [], "cell": [], "near": []})]
            pivots = rpdf.sort_values("cell")
            for part in blocks.slices(len(lpdf), len(pivots)) if len(pivots) else ():
                some = lpdf.iloc[part]
                value = blocks.unit_rows(blocks.matrix(some["qv"])) @ blocks.matrix(pivots["pv"]).T
                row, col = blocks.best_k(value, probes)
                near = np.round(value[row, col], blocks.TIE_DECIMALS)
                ids, coarse = (some[name].to_numpy()[row] for name in ("query_id", "coarse"))
                found.append(pd.DataFrame({"query_id": ids, "coarse": coarse, "cell": pivots["cell"].to_numpy()[col], "near": near}))
            return pd.concat(found[1:] or found, ignore_index=True)

        schema = f"query_id {kind}, coarse bigint, cell bigint, near double"
        scored = blocks.grouped_grid(near, self.pivots, "coarse", ["query_id"], ["cell"], of_cell, schema, self._sizes(near), cell_rows)
        order = Window.partitionBy("query_id").orderBy(F.desc("near"), "cell")
        return scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= probes).drop("near")

    def _sizes(self, near: DataFrame) -> DataFrame:
        """Rows and pivots of each coarse cell, at most ``MAX_COARSE`` rows."""
        left = near.groupBy("coarse").agg(F.count(F.lit(1)).alias("n_left"))
        right = self.pivots.groupBy("coarse").agg(F.count(F.lit(1)).alias("n_right"))
        sizes = left.join(right, "coarse")
        return near.sparkSession.createDataFrame(sizes.collect(), sizes.schema)


def _vectors(pivots: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    rows = pivots.select("cell", "pv").collect()  # at most MAX_COARSE
    return np.array([r.cell for r in rows], dtype=np.int64), np.array([r.pv for r in rows], dtype=np.float64)


def _types(rows: DataFrame) -> str:
    return ", ".join(f"`{name}` {kind}" for name, kind in rows.dtypes)
