"""From component neighbours to ranked documents, and retrieval reports."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from galleryspark.functions import text as T, vectors as V
from galleryspark.operators.knn import knn
from galleryspark.operators.vector_stats import Strategy, max_pool
from galleryspark.session import cut_lineage


def retrieve_documents(
    query_components: DataFrame,
    gallery: DataFrame,
    k: int = 20,
    strategy: Strategy | None = None,
    query_doc: str = "query_doc",
    with_details: bool = True,
) -> DataFrame:
    """Documents ranked by the aggregated similarity of their matching components.

    ``query_components``: query_doc, query_id, embedding. ``gallery``: id, embedding, parent_pdf_id,
    component_type. Each component asks for its k nearest; matches without a parent are dropped; a
    document's score comes from ``strategy``. ``details`` holds at most k matches per query component.
    """
    near = knn(query_components, gallery, k, metric="cosine")
    meta = gallery.select("id", "parent_pdf_id", "component_type")
    matches = (
        near.withColumn("similarity", V.similarity_from_distance(F.col("score")))
        .join(meta, "id")
        .where(F.col("parent_pdf_id").isNotNull() & (F.col("parent_pdf_id") != ""))
        .join(query_components.select(query_doc, "query_id"), "query_id")
    )
    strategy = strategy or max_pool()
    columns = [F.count(F.lit(1)).alias("accumulated_matches")]
    if with_details:
        detail = F.struct("query_id", "rank", "id", "component_type", "similarity")
        columns.append(F.array_sort(F.collect_list(detail)).alias("details"))
    keys = [query_doc, "parent_pdf_id"]
    if getattr(strategy, "function", None):
        matches = cut_lineage(matches) if with_details else matches  # stored, or the search ran for each side of the join
        scored = _scored_in_python(matches, keys, strategy.function)
        if with_details:
            scored = scored.join(matches.groupBy(*keys).agg(columns[1]), keys)
    else:
        scored = matches.groupBy(*keys).agg(strategy(F.col("similarity"), F.col("component_type")).alias("score"), *columns)
    best = Window.partitionBy(query_doc).orderBy(F.desc(F.round("score", 9)), "parent_pdf_id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _scored_in_python(matches: DataFrame, keys: list[str], function: Callable[[pd.Series, pd.Series], float]) -> DataFrame:
    """(keys, score, accumulated_matches): the matches of a document lie side by side in a task, so that many documents share
    a batch and only the function itself is called for each."""
    known = matches.where(F.col(keys[0]).isNotNull()).select(*keys, "similarity", "component_type")
    names = [*keys, "score", "accumulated_matches"]

    def documents(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        scores, kinds = pdf["similarity"].to_numpy(), pdf["component_type"].to_numpy()
        ends = [*starts[1:], len(pdf)]
        value = [float(function(pd.Series(scores[a:b]), pd.Series(kinds[a:b]))) for a, b in zip(starts, ends)]
        return pdf.iloc[starts][keys].assign(score=value, accumulated_matches=np.array(ends) - starts)[names]

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            if pdf.empty:
                continue
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            starts = np.flatnonzero((pdf[keys] != pdf[keys].shift()).any(axis=1).to_numpy())
            held = pdf.iloc[starts[-1] :]  # the last document may go on
            if len(starts) > 1:
                yield documents(pdf.iloc[: starts[-1]], starts[:-1])
        if held is not None:
            yield documents(held, np.zeros(1, int))

    types = dict(matches.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keys), "score double, accumulated_matches long"])
    return known.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(score, schema)


def with_lookup_label(df: DataFrame, label_map: DataFrame | None, resolved: str = "resolved_path", raw: str = "path") -> DataFrame:
    """Label of the resolved path, else of the raw path, else the parent directory name (null for a bare file name)."""
    parent = T.parent_name(F.col(raw))
    if label_map is None:
        return df.withColumn("lookup_label", parent)
    label_map = label_map.groupBy("path").agg(F.max("label").alias("label"))  # a path has one label
    first = label_map.select(F.col("path").alias(resolved), F.col("label").alias("_resolved_label"))
    second = label_map.select(F.col("path").alias(raw), F.col("label").alias("_raw_label"))
    return (
        df.join(first, resolved, "left")
        .join(second, raw, "left")
        .withColumn("lookup_label", F.coalesce("_resolved_label", "_raw_label", parent))
        .drop("_resolved_label", "_raw_label")
    )


def per_query_summary(queries: DataFrame, neighbors: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """One row per query, also for those without results.

    ``queries``: query_id, query_label. ``neighbors``: query_id, id, rank, score. ``labels``: id, label.
    """
    joined = neighbors.join(labels, "id").withColumnRenamed("label", "_label")
    hits = joined.join(queries, "query_id").withColumn("match", (F.col("_label") == F.col("query_label")).cast("int"))
    first = F.col("rank") == 1
    per = hits.groupBy("query_id").agg(
        F.max(F.when(first, F.col("id"))).alias("top1_id"),
        F.max(F.when(first, F.col("score"))).alias("top1_score"),
        F.max(F.when(first, F.col("match"))).alias("top1_match"),
        F.sum("match").alias("matches_in_topk"),
        F.count(F.lit(1)).alias("retrieved"),
    )
    precision = F.col("matches_in_topk") / F.least(F.lit(k), F.col("retrieved"))
    zero = {"top1_match": 0, "matches_in_topk": 0, "precision_at_k": 0.0, "retrieved": 0}
    return queries.join(per.withColumn("precision_at_k", precision), "query_id", "left").fillna(zero)


def retrieval_metrics(per_query: DataFrame) -> DataFrame:
    """One row of metrics; queries without results count as misses, but not in the mean top-1 score."""
    return per_query.agg(
        F.count(F.lit(1)).alias("total_queries"),
        F.sum((F.col("retrieved") == 0).cast("long")).alias("queries_without_results"),
        F.avg("top1_match").alias("top1_accuracy"),
        F.avg((F.col("matches_in_topk") > 0).cast("double")).alias("hit_rate_at_k"),
        F.avg("precision_at_k").alias("mean_precision_at_k"),
        F.coalesce(F.avg("top1_score"), F.lit(0.0)).alias("mean_top1_score"),
    )


def per_query_details(queries: DataFrame, neighbors: DataFrame, labels: DataFrame) -> DataFrame:
    """(query_id, query_label, retrieved): the ranked list, of at most k entries, as an array."""
    hits = neighbors.join(labels, "id").join(queries, "query_id")
    entry = F.struct("rank", "id", "score", "label", (F.col("label") == F.col("query_label")).cast("int").alias("match"))
    lists = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(entry)).alias("retrieved"))
    empty = F.array().cast(dict(lists.dtypes)["retrieved"])
    return queries.join(lists, "query_id", "left").withColumn("retrieved", F.coalesce("retrieved", empty))


def filter_candidates(candidates: DataFrame, min_score: float, template: Column | None = None, wanted: Column | None = None) -> DataFrame:
    """Candidates with score >= min_score and, where given, ``template`` equal to ``wanted``."""
    kept = candidates.where(F.col("score") >= min_score)
    return kept if template is None else kept.where(template == wanted)
