"""Block grid: work over all (left, right) combinations without writing a row per combination.

Left rows are hashed into R blocks, right rows into C blocks; every left row is sent to the C cells
of its block row and every right row to the R cells of its block column. A task sees one bounded
cell, works on matrices and returns only what the operator needs of it (top-k, sums, counts). Blocks are cut by
row id, not by class or source, so a hot class cannot make a hot cell.
"""

from __future__ import annotations

import math
import os
import tempfile
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

CELL_ROWS = 16_384
CELL_BYTES = 64 << 20  # vectors of one side of a cell
MAX_PARTITIONS = 20_000
SLICE_CELLS = 1_000_000  # doubles per similarity slice inside a task (8 MB)
HEAD = 1_024  # columns whose k-th best is a floor for the rest of a slice
TIE_DECIMALS = 12  # scores equal to this many places are ties, broken by id


Kernel = Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]


def stored(df: DataFrame, vector: str) -> Column:
    """The vector column as it is kept, for the shuffle; ``matrix`` makes doubles of it inside the task."""
    kept = dict(df.dtypes)[vector]
    return F.col(vector) if kept in ("array<float>", "array<double>") else F.col(vector).cast("array<double>")


def cell_rows_for(df: DataFrame, vector: str, most: int = CELL_ROWS) -> int:
    """Rows of a cell side: at most ``most``, fewer where the vectors are long."""
    first = df.select(F.size(vector).alias("d")).first()
    return max(256, min(most, CELL_BYTES // (8 * max(first.d if first else 1, 1))))


def grid(
    left: DataFrame,
    right: DataFrame,
    left_key: Sequence[str],
    right_key: Sequence[str],
    kernel: Kernel,
    schema: str,
    cell_rows: int = CELL_ROWS,
    left_rows: int | None = None,
    n_left: int | None = None,
    n_right: int | None = None,
) -> DataFrame:
    """Run ``kernel`` once per cell of the block grid."""
    cores = left.sparkSession.sparkContext.defaultParallelism
    n_left = left.count() if n_left is None else n_left
    n_right = right.count() if n_right is None else n_right
    per_block = min(left_rows or cell_rows, cell_rows)
    rows = max(math.ceil(n_left / per_block), min(cores, math.ceil(n_left / 128)), 1)
    columns = max(math.ceil(n_right / cell_rows), 1)
    spread = left.withColumn("_r", F.pmod(F.xxhash64(*left_key), F.lit(rows))).withColumn("_c", _each(F.lit(columns)))
    replicated = right.withColumn("_c", F.pmod(F.xxhash64(*right_key), F.lit(columns))).withColumn("_r", _each(F.lit(rows)))
    return _run_cells(spread, replicated, ["_r", "_c"], kernel, schema, rows * columns)


def grouped_grid(
    left: DataFrame, right: DataFrame, group: str, left_key: Sequence[str], right_key: Sequence[str], kernel: Kernel, schema: str,
    sizes: DataFrame, cell_rows: int = CELL_ROWS, few: bool = True,
) -> DataFrame:
    """A grid of its own for every value of ``group``, so that a crowded group is cut into many cells.

    ``sizes``: (group, n_left, n_right), one row per group, few enough to be sent to every task; if not ``few``, only the
    groups that must be cut are joined, by whatever plan suits their number.
    """
    blocks_of = lambda n: F.greatest(F.lit(1).cast("bigint"), F.ceil(F.col(n) / cell_rows))
    cut = sizes.select(group, blocks_of("n_left").alias("_rows"), blocks_of("n_right").alias("_columns"))
    if few:
        left, right = (side.join(F.broadcast(cut), group) for side in (left, right))
    else:
        cut = cut.where((F.col("_rows") > 1) | (F.col("_columns") > 1))
        left, right = (side.join(cut, group, "left").fillna(1, ["_rows", "_columns"]) for side in (left, right))
    spread = left.withColumn("_r", F.pmod(F.xxhash64(*left_key), F.col("_rows"))).withColumn("_c", _each(F.col("_columns")))
    replicated = right.withColumn("_c", F.pmod(F.xxhash64(*right_key), F.col("_columns"))).withColumn("_r", _each(F.col("_rows")))
    drop = ("_rows", "_columns")
    cells = sizes.agg(F.sum(blocks_of("n_left") * blocks_of("n_right")).alias("n")).first().n or 1
    return _run_cells(spread.drop(*drop), replicated.drop(*drop), [group, "_r", "_c"], kernel, schema, cells)


def half_grid(items: DataFrame, key: Sequence[str], kernel: Kernel, schema: str, cell_rows: int = CELL_ROWS, n: int | None = None) -> DataFrame:
    """Run ``kernel(one block, other block)`` once for every unordered pair of blocks, for work that is the same from both sides.

    A block meets itself once, and is then given as both sides. Rows of one key lie in one block.
    """
    cores = items.sparkSession.sparkContext.defaultParallelism
    n = items.count() if n is None else n
    # About eight cells for each core where the table is not too small for that, so that none waits long for the last.
    many = max(math.ceil(n / cell_rows), min(math.ceil(math.sqrt(16 * cores)), math.ceil(n / 128)), 1)
    placed = items.withColumn("_own", F.pmod(F.xxhash64(*key), F.lit(many))).withColumn("_met", _each(F.lit(many)))
    placed = placed.withColumn("_r", F.least("_own", "_met")).withColumn("_c", F.greatest("_own", "_met")).drop("_met")
    columns = items.columns

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        one, other = (pdf.loc[pdf["_own"] == pdf[side].iloc[0], columns] for side in ("_r", "_c"))
        return kernel(one, one if pdf["_r"].iloc[0] == pdf["_c"].iloc[0] else other)

    cells = many * (many + 1) // 2
    return placed.repartition(min(cells, MAX_PARTITIONS), "_r", "_c").groupBy("_r", "_c").applyInPandas(run, schema)


def _run_cells(left: DataFrame, right: DataFrame, cell: list[str], kernel: Kernel, schema: str, cells: int) -> DataFrame:
    """Both sides get as many partitions as there are cells: a cell is small in bytes but long to compute, and
    must not be merged with others for its size."""
    partitions = min(cells, MAX_PARTITIONS)
    placed = [side.repartition(partitions, *cell).groupBy(*cell) for side in (left, right)]
    # Spark counts the arguments of the function it is given; a bound method would count one too many.
    return placed[0].cogroup(placed[1]).applyInPandas(lambda lpdf, rpdf: kernel(lpdf, rpdf), schema)


class Kept:
    """Rows that a task keeps in a local file, to read them again and again; the file is deleted when the task ends."""

    def __init__(self):
        folder = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
        self.file, self.writer = tempfile.NamedTemporaryFile(dir=folder if os.path.isdir(folder) else None), None
        self.numbers = np.empty(0, np.int64)

    def room(self, size: int) -> np.ndarray:
        """Room for whole numbers, the same at each call; it goes with the rows."""
        if len(self.numbers) < size:
            self.numbers = None  # two at once would be too many
            self.numbers = np.empty(size, np.int64)
        return self.numbers[:size]

    def add(self, batch: pa.RecordBatch) -> None:
        if self.writer is None:
            self.writer = pa.ipc.new_stream(self.file.name, batch.schema)
        self.writer.write_batch(batch)

    def batches(self) -> Iterator[pa.RecordBatch]:
        if self.writer is not None:
            self.writer.close()  # all rows are added before the first is read
            with pa.OSFile(self.file.name) as source:
                yield from pa.ipc.open_stream(source)


def against_all(
    asked: DataFrame, items: DataFrame, n_asked: int, rows: int, work: Callable[[list[pa.RecordBatch], Kept], Iterator[pa.RecordBatch]], schema: str
) -> DataFrame:
    """Run ``work(some rows of asked, all items)`` until all rows of ``asked`` had their turn, about ``rows`` at a time.

    Both sides are (id, v, label) and come in the order of id and label; rows of ``asked`` that share an id stay together. The items
    are sent once to each core: a task keeps them in a local file and takes its rows of ``asked`` piece by piece, so that what is
    shuffled grows with the items and not with the number of pieces.
    """
    tasks = max(min(math.ceil(n_asked / min(rows, 128)), asked.sparkSession.sparkContext.defaultParallelism), 1)
    columns = ["id", "v", "label"]
    placed = asked.select(F.lit(True).alias("_asks"), *columns, F.pmod(F.xxhash64("id"), F.lit(tasks)).alias("_task"))
    passing = items.select(F.lit(False).alias("_asks"), *columns, _each(F.lit(tasks)).alias("_task"))
    dealt = placed.unionByName(passing).repartitionById(tasks, F.col("_task").cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, parts, held, last = Kept(), [], 0, None
        for batch in batches:
            first = batch.num_rows - batch.column(0).true_count  # the items come first
            batch = batch.select(columns)
            if first:
                kept.add(batch.slice(0, first))
                batch = batch.slice(first)
            ids = batch.column(0).to_pandas().to_numpy()
            start = 0
            for at in np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1]))) if len(ids) else ():
                if held + at - start >= rows and (at or ids[0] != last):
                    if at > start:
                        parts.append(batch.slice(start, at - start))
                    yield from work(parts, kept)
                    parts, held, start = [], 0, at
            if len(ids):
                parts.append(batch.slice(start))
                held, last = held + len(ids) - start, ids[-1]
        if parts:
            yield from work(parts, kept)

    return dealt.drop("_task").sortWithinPartitions("_asks", "id", "label").mapInArrow(run, schema)


def vectors(column: pa.Array) -> np.ndarray:
    """``matrix`` of an Arrow column, without an object for each row where all rows are equally long."""
    length = np.diff(column.offsets.to_numpy()) if pa.types.is_list(column.type) and not column.null_count else np.empty(0)
    if not len(length) or (length != length[0]).any():
        return matrix(column.to_pandas())
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(length), length[0]).astype(np.float64, copy=False)


def _each(n: Column) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), (n - 1).cast("long")))


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64, copy=False)


def unit_rows(values: np.ndarray) -> np.ndarray:
    return values / np.maximum(np.linalg.norm(values, axis=1, keepdims=True), 1e-12)


def slices(rows: int, columns: int) -> Iterator[slice]:
    step = max(1, SLICE_CELLS // max(columns, 1))
    for start in range(0, rows, step):
        yield slice(start, min(rows, start + step))


#: Below this share of both squared lengths the expanded square has lost too many digits.
NEAR_COPY = 1e-4


def squared_distances(queries: np.ndarray, gallery: np.ndarray) -> np.ndarray:
    """Squared distances by one matrix product; those of near copies are summed again from the differences."""
    length = (queries**2).sum(1)[:, None] + (gallery**2).sum(1)[None, :]
    square = length - 2.0 * (queries @ gallery.T)
    row, col = np.nonzero(square < NEAR_COPY * length)
    for part in slices(len(row), queries.shape[1]):
        square[row[part], col[part]] = ((queries[row[part]] - gallery[col[part]]) ** 2).sum(1)
    return np.maximum(square, 0.0)


def scores(queries: np.ndarray, gallery: np.ndarray, metric: str) -> np.ndarray:
    """Score matrix where larger is better; distances are negated."""
    if metric == "ip":
        value = queries @ gallery.T
    elif metric == "cosine":
        value = unit_rows(queries) @ unit_rows(gallery).T - 1.0
    elif metric == "l2":
        value = -np.sqrt(squared_distances(queries, gallery))
    else:
        raise ValueError(f"unknown metric {metric!r}")
    return value


def best_k(value: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k largest finite entries per row; ties keep the smaller column."""
    k = min(k, value.shape[1])
    if k <= 0 or value.size == 0:
        return np.empty(0, int), np.empty(0, int)
    head = value[:, : max(HEAD, 8 * k)]
    # Entries that round to the same place differ by no more than one step.
    cut = -np.partition(-head, k - 1, axis=1)[:, k - 1] - 10.0**-TIE_DECIMALS
    row, col = np.nonzero(value >= cut[:, None])
    found = value[row, col]
    row, col, found = row[np.isfinite(found)], col[np.isfinite(found)], np.round(found[np.isfinite(found)], TIE_DECIMALS)
    order = np.lexsort((col, -found, row))
    row, col = row[order], col[order]
    place = np.arange(len(row)) - np.searchsorted(row, row, side="left")
    return row[place < k], col[place < k]
