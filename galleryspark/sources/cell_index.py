"""Approximate index on disk: vectors in folders of two-level cells, filled batch by batch, pruned when it is searched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from galleryspark.functions import vectors as V
from galleryspark.operators import blocks, knn as K
from galleryspark.operators.cells import Cells, draw_pivots
from galleryspark.session import cut_lineage

LISTED_CELLS = 1_024  # so many cells are named in the filter of the scan; of more, only the coarse folders are


class CellIndex:
    """``rows/batch=N/coarse=C`` holds the vectors of a batch, sorted by cell; ``pivots`` does not change after ``create``.

    A row that a later batch writes again is listed in ``stale/by=N`` and no longer counts; only such rows cost a search
    anything. A batch counts once ``commits/batch=N`` is there, which is written last: what a lost run leaves is
    written over by the next one, and a batch that is there already is left alone. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def create(
        cls, gallery: DataFrame, path: str, cells: int | None = None, coarse: int | None = None, seed: int = 42,
        id_col: str = "id", vector: str = "embedding",
    ) -> CellIndex:
        """Draw ``cells`` pivots from the gallery (by default the square root of its size) and write it as batch 0.

        Columns other than id and vector are kept and may be filtered on; they must not be called batch, coarse or cell.
        """
        index = cls(gallery.sparkSession, path)
        rows = gallery.select(F.col(id_col).alias("id"), blocks.stored(gallery, vector).alias("gv"))
        n = rows.count()
        if not n:
            raise ValueError("the gallery is empty")
        drawn = cut_lineage(draw_pivots(rows, cells or max(1, round(n**0.5)), seed))
        Cells.over(drawn, coarse).table().write.mode("overwrite").parquet(f"{index.path}/pivots")
        index.add(gallery, 0, id_col, vector)
        return index

    def add(self, batch: DataFrame, number: int, id_col: str = "id", vector: str = "embedding") -> None:
        """Insert the batch, or replace rows by id. Batches are numbered upwards; one that is there is not written again.

        Of several rows of an id within the batch one is kept, by value.
        """
        last = self._last()
        if number <= last:
            return
        rest = [c for c in batch.columns if c not in (id_col, vector)]
        clash = {"batch", "coarse", "cell", "id", "gv"} & set(rest)
        if clash:
            raise ValueError(f"columns {sorted(clash)} have names that the index uses")
        rows = batch.select(F.col(id_col).alias("id"), blocks.stored(batch, vector).alias("gv"), *rest)
        values = [c for c in rows.columns if c != "id"]
        rows = rows.groupBy("id").agg(F.max_by(F.struct(*values), F.xxhash64(*values)).alias("_row")).select("id", "_row.*")
        placed = self.cells().place(cut_lineage(rows), "id", "gv")
        # A crowded folder is cut into several files by the rebalancing, small ones share a task.
        placed = placed.hint("rebalance", "coarse").sortWithinPartitions("coarse", "cell")
        placed.write.mode("overwrite").partitionBy("coarse").parquet(f"{self.path}/rows/batch={number}")
        written = self._read("rows")
        if last >= 0:
            new = written.where(F.col("batch") == number).select("id")
            old = written.where(F.col("batch") <= last).select("id", F.col("batch").alias("of"))
            old.join(new, "id", "left_semi").write.mode("overwrite").parquet(f"{self.path}/stale/by={number}")
        done = written.where(F.col("batch") == number).agg(F.count(F.lit(1)).alias("rows"))
        done.write.mode("overwrite").parquet(f"{self.path}/commits/batch={number}")

    def cells(self) -> Cells:
        return Cells.stored(self.spark.read.parquet(f"{self.path}/pivots"))

    def rows(self, coarse: list[int] | None = None, cells: list[int] | None = None) -> DataFrame:
        """The rows that count (id, gv, other columns, batch, coarse, cell), of all folders or of those named."""
        last = self._last()
        rows = self._read("rows").where(F.col("batch") <= last)
        if coarse is not None:
            rows = rows.where(F.col("coarse").isin(coarse))
        if cells is not None:
            rows = rows.where(F.col("cell").isin(cells))
        if last > 0 and self._numbers("stale/by"):
            stale = self._read("stale").where(F.col("by") <= last).select("id", F.col("of").alias("batch")).distinct()
            rows = rows.join(stale, ["id", "batch"], "left_anti")
        return rows

    def search(
        self, queries: DataFrame, k: int, probes: int, wide: int | None = None, where: Column | None = None, exclude_self: bool = False,
        query_id: str = "query_id", vector: str = "embedding", cell_rows: int = blocks.CELL_ROWS,
    ) -> DataFrame:
        """Approximate cosine top-k (query_id, id, rank, score) from the ``probes`` nearest cells of each query.

        The cells are looked for in the ``wide`` nearest coarse cells (by default as many as ``probes``). Only folders of
        cells that a query wants are read. With all cells probed the result is exact. Query ids must be unique.
        """
        if k < 1 or probes < 1:
            raise ValueError("k and probes must be at least 1")
        asked = queries.select(F.col(query_id).alias("query_id"), blocks.stored(queries, vector).alias("qv"))
        wanted = cut_lineage(self.cells().probes(asked, probes, wide).select("query_id", "coarse", "cell"))
        stored = self._wanted_rows(wanted)
        if where is not None:
            stored = stored.where(where)
        stored = stored.select("id", "gv", "cell")
        sizes = stored.groupBy("cell").agg(F.count(F.lit(1)).alias("n_right")).join(
            wanted.groupBy("cell").agg(F.count(F.lit(1)).alias("n_left")), "cell"
        )
        asked = asked.join(wanted.select("query_id", "cell"), "query_id")
        top = K._TopK(k, "cosine", exclude_self)
        rows = min(cell_rows, blocks.cell_rows_for(stored, "gv"))
        partial = blocks.grouped_grid(
            asked, stored, "cell", ["query_id"], ["id"], top.of_cell, K._schema(asked, stored), cut_lineage(sizes), rows, few=False
        )
        return K._best_of(partial, k, "cosine").withColumn("score", V.similarity_from_distance(F.col("score")))

    def recall(self, queries: DataFrame, exact: DataFrame, levels: list[int], wide: int | None = None, query_id: str = "query_id", vector: str = "embedding") -> DataFrame:
        """(probes, recall) for each level: the share of the exact neighbours (query_id, id) that lie in so many cells.

        One pass for all levels: a neighbour is found as soon as its cell's place in the query's order is reached.
        """
        asked = queries.select(F.col(query_id).alias("query_id"), blocks.stored(queries, vector).alias("qv"))
        cells = self.cells()
        order = cells.probes(asked, max(levels), wide or len(cells.numbers)).select("query_id", "cell", "place")
        held = exact.select("query_id", "id").join(self.rows().select("id", "cell"), "id")
        placed = held.join(order, ["query_id", "cell"], "left")
        share = [F.avg(F.when(F.col("place") <= level, 1.0).otherwise(0.0)).alias(f"r{level}") for level in levels]
        each = F.explode(F.array(*[F.struct(F.lit(level).alias("probes"), F.col(f"r{level}").alias("recall")) for level in levels]))
        return placed.agg(*share).select(each.alias("_l")).select("_l.*")

    def _wanted_rows(self, wanted: DataFrame) -> DataFrame:
        coarse = [r.coarse for r in wanted.select("coarse").distinct().collect()]  # at most MAX_COARSE
        cells = [r.cell for r in wanted.select("cell").distinct().limit(LISTED_CELLS + 1).collect()]
        return self.rows(coarse, cells if len(cells) <= LISTED_CELLS else None)

    def _read(self, name: str) -> DataFrame:
        kinds = {"rows": "batch int, coarse bigint", "stale": "by int"}
        found = self.spark.read.option("mergeSchema", True).parquet(f"{self.path}/{name}")
        for kind in kinds[name].split(", "):
            column, to = kind.split(" ")
            if dict(found.dtypes)[column] != to:  # folder names are read as the smallest fitting type
                found = found.withColumn(column, F.col(column).cast(to))
        return found

    def _last(self) -> int:
        return max(self._numbers("commits/batch"), default=-1)

    def _numbers(self, folder: str) -> list[int]:
        pattern = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}=*/_SUCCESS")
        found = pattern.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(pattern) or []
        return [int(status.getPath().getParent().getName().split("=")[1]) for status in found]
