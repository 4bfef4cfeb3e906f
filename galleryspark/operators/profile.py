"""Profiling reports."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F

from galleryspark.functions import vectors as V
from galleryspark.operators.ordering import hash_key, sample_n
from galleryspark.operators.quantiles import exact_quantiles, melt, summary
from galleryspark.session import cut_lineage

QUARTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75}


def class_balance(df: DataFrame, class_col: str) -> DataFrame:
    """Count and share per class, with the totals and the imbalance ratio on every row."""
    counts = df.groupBy(class_col).agg(F.count(F.lit(1)).alias("count"))
    whole = Window.partitionBy(F.lit(0))  # one row per class
    return counts.select(
        class_col,
        "count",
        F.round(F.col("count") / F.sum("count").over(whole), 4).alias("pct"),
        F.sum("count").over(whole).alias("total"),
        F.count(F.lit(1)).over(whole).alias("num_classes"),
        F.round(F.max("count").over(whole) / F.greatest(F.min("count").over(whole), F.lit(1)), 2).alias("imbalance_ratio"),
    )


def size_stats(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """n, mean, population std, min, quartiles and max per column."""
    return summary(df, columns, QUARTILES).drop("std_samp").withColumnRenamed("std_pop", "std")


def describe(df: DataFrame, columns: Mapping[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """As ``size_stats``, with the sample std and optional groups."""
    return summary(df, columns, QUARTILES, by).drop("std_pop").withColumnRenamed("std_samp", "std")


def histogram(df: DataFrame, column: Column, bins: int) -> DataFrame:
    """(bin, n): equal-width bins between the minimum and the maximum, the last one closed."""
    edges = df.agg(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi")).first()
    if edges.lo is None:
        index = F.lit(0)
    elif edges.lo == edges.hi:
        index = F.lit(bins // 2)
    else:
        index = F.least(F.floor((column - F.lit(edges.lo)) / F.lit((edges.hi - edges.lo) / bins)), F.lit(bins - 1))
    return df.where(column.isNotNull()).groupBy(index.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def value_counts(df: DataFrame, column: Column) -> DataFrame:
    return df.groupBy(column.alias("value")).agg(F.count(F.lit(1)).alias("n"))


# Fixed outlier rules: column, side, quantile, tag.
OUTLIER_RULES = (
    ("aspect_ratio", ">", 0.995, "extreme_aspect_ratio"),
    ("aspect_ratio", "<", 0.005, "extreme_aspect_ratio"),
    ("entropy", "<", 0.01, "low_entropy"),
    ("sparsity", ">", 0.99, "high_sparsity"),
    ("high_freq_energy", ">", 0.995, "high_freq_energy"),
    ("cc_count", ">", 0.995, "high_cc_count"),
)


def tag_outliers(df: DataFrame, outlier_flag: str | None = None, status: str | None = None) -> DataFrame:
    """Add ``tags``: the names of the rules a row breaks. Rules on absent columns are skipped.

    With ``status`` (a column of ``quality_status``) only rows that are ``ok`` are profiled and returned.
    """
    if status:
        df = df.where(F.col(status) == "ok")
    rules = [r for r in OUTLIER_RULES if r[0] in df.columns]
    probs = sorted({r[2] for r in rules})
    long = melt(df, {c: F.col(c) for c in {r[0] for r in rules}})
    # One row per profiled column.
    limits = {row.metric: dict(zip(probs, row.q)) for row in exact_quantiles(long, probs).collect()}
    tags = []
    for name in dict.fromkeys(r[3] for r in rules):
        broken = F.lit(False)
        for column, side, prob, tag in rules:
            if tag == name:
                limit = F.lit(limits.get(column, {}).get(prob))
                broken = broken | (F.col(column) > limit if side == ">" else F.col(column) < limit)
        tags.append(F.when(broken, F.lit(name)))
    if outlier_flag:
        tags.append(F.when(F.col(outlier_flag), F.lit("simsiam_outlier")))
    return df.withColumn("tags", F.filter(F.array(*tags), lambda t: t.isNotNull()))


def project_2d(df: DataFrame, vector: str = "embedding", sample: int | None = None, seed: int = 42, id_col: str = "vec_id") -> DataFrame:
    """(id, px, py): the two first principal components of all rows, or of a sample of so many.

    A component points to where its largest coordinate (of equal ones the first) is positive.
    """
    rows = df.select(id_col, array_to_vector(V.as_double(F.col(vector))).alias("features"))
    if sample is not None:
        rows = sample_n(rows, sample, seed, F.col(id_col))
    model = PCA(k=2, inputCol="features", outputCol="map").fit(rows)
    axes = model.pc.toArray()
    largest = np.argmax(np.round(np.abs(axes), 9), axis=0)
    sign = [float(np.sign(axes[at, axis]) or 1.0) for axis, at in enumerate(largest)]
    placed = model.transform(rows).withColumn("map", vector_to_array("map"))
    return placed.select(id_col, (F.col("map")[0] * sign[0]).alias("px"), (F.col("map")[1] * sign[1]).alias("py"))


# --- isolation forest ------------------------------------------------------------------------

TREE_ROWS = 256  # fixed size of a tree's sample
SCORE_DECIMALS = 12  # scores equal to this many places lie on the same side of the limit


def _expected_depth(n: int) -> float:
    if n > 2:
        return 2 * (math.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n
    return 1.0 if n == 2 else 0.0


def _grow(values: np.ndarray, seed: int, tree: int, limit: int) -> list[tuple]:
    """Nodes (node, feature, cut, path length) numbered as a heap from 1; leaves have feature -1.

    The md5 of ``seed:tree:node`` says at which coordinate the search for one that varies in the node starts, and
    where between its extremes the cut lies.
    """
    nodes, stack = [], [(1, 0, np.arange(len(values)))]
    while stack:
        node, depth, rows = stack.pop()
        low, high = (values[rows].min(axis=0), values[rows].max(axis=0)) if len(rows) else (np.zeros(1), np.zeros(1))
        wide = np.nonzero(high > low)[0]
        if depth >= limit or not len(wide):
            nodes.append((node, -1, 0.0, depth + _expected_depth(len(rows))))
            continue
        digest = hashlib.md5(f"{seed}:{tree}:{node}".encode()).hexdigest()
        start, share = int(digest[:13], 16) % values.shape[1], int(digest[13:26], 16) / 2.0**52
        feature = int(wide[np.argmin((wide - start) % values.shape[1])])
        cut = float(low[feature] + share * (high[feature] - low[feature]))
        nodes.append((node, feature, cut, 0.0))
        below = values[rows, feature] < cut
        stack += [(2 * node, depth + 1, rows[below]), (2 * node + 1, depth + 1, rows[~below])]
    return nodes


def isolation_scores(
    df: DataFrame, trees: int = 100, contamination: float = 0.05, seed: int = 42, id_col: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """(id, score, is_outlier): isolation-forest scores, the top ``contamination`` share flagged.

    The sample of a tree is 256 places of the hash order, taken on a ring of the first trees * 256 rows (of all rows, if
    they are fewer): tree t starts at place t * 256. Each tree is grown in its own task; the trees, a few hundred
    kilobytes, go to the scoring tasks. All choices come from md5, so the forest does not depend on partitions.
    """
    rows = df.select(F.col(id_col).alias("id"), V.as_double(F.col(vector)).alias("v"))
    kind = dict(rows.dtypes)["id"]
    ordered = Window.partitionBy(F.lit(0)).orderBy("_h", "id")  # over the trees * 256 rows of the ring at most
    head = rows.withColumn("_h", hash_key(seed, F.col("id"))).orderBy("_h", "id").limit(trees * TREE_ROWS)
    ring = cut_lineage(head.select("v", (F.row_number().over(ordered) - 1).alias("place")))
    n = ring.count()
    if not n:
        return rows.select("id", F.lit(None).cast("double").alias("score"), F.lit(None).cast("boolean").alias("is_outlier"))
    per = min(TREE_ROWS, n)
    limit = math.ceil(math.log2(max(per, 2)))
    taken = df.sparkSession.range(trees * per).select(F.expr(f"int(id div {per})").alias("tree"), (F.col("id") % per).alias("j"))
    samples = taken.withColumn("place", (F.col("tree") * TREE_ROWS + F.col("j")) % n).join(ring, "place")

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        nodes = _grow(np.stack(pdf["v"].to_numpy()), seed, tree, limit)
        return pd.DataFrame(nodes, columns=["node", "feature", "cut", "length"]).assign(tree=tree)

    grown = samples.select("v", "tree").groupBy("tree").applyInPandas(grow, "node int, feature int, cut double, length double, tree int")
    table = grown.toPandas()  # at most 2 * 256 nodes per tree
    feature = np.full((trees, 2 << limit), -1)
    cut, length = np.zeros(feature.shape), np.zeros(feature.shape)
    at = (table["tree"].to_numpy(), table["node"].to_numpy())
    feature[at], cut[at], length[at] = table["feature"], table["cut"], table["length"]
    forest = df.sparkSession.sparkContext.broadcast((feature, cut, length))
    normal = _expected_depth(per) or 1.0

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        feature, cut, length = forest.value
        for pdf in batches:
            if pdf.empty:
                continue
            values = np.stack(pdf["v"].to_numpy())
            each, total = np.arange(len(values)), np.zeros(len(values))
            for tree in range(trees):
                node = np.ones(len(values), dtype=int)
                for _ in range(limit):
                    inner = feature[tree, node] >= 0
                    right = values[each, np.maximum(feature[tree, node], 0)] >= cut[tree, node]
                    node = np.where(inner, 2 * node + right, node)
                total += length[tree, node]
            yield pd.DataFrame({"id": pdf["id"], "score": np.round(2.0 ** (-total / trees / normal), SCORE_DECIMALS)})

    scored = cut_lineage(rows.mapInPandas(score, f"id {kind}, score double"))  # read again for the limit
    top = exact_quantiles(melt(scored, {"score": F.col("score")}), [1.0 - contamination]).first().q[0]
    return scored.withColumn("is_outlier", F.col("score") > F.lit(top))
