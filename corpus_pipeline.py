"""A cleaning pipeline over ``documents``: rules, line dedup, near-duplicate removal, decontamination, packing.

Every stage takes (spark, docs, sf_dir); all but the last return the columns of ``documents``. A stage's result is
written and read back before the next one begins; that one deletes the folders that the stages before it made
and that its documents are not read from. Cases (nulls, empty texts, repeated rows, clashing names) are those of the
operators that the stages call; a document is a row here: rows that share a doc_id go only if their texts are near copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from galleryspark.llm import decontaminate, jaccard_join, line_dedup, packing, quality_rules
from galleryspark.llm.common import delete_folders, discard, folders_made, fresh, store

_left: list[str] = []  # folders of stages whose result may not be written yet


def _delete_unread(spark: SparkSession, docs: DataFrame) -> None:
    """Delete the folders of earlier stages, but those that ``docs`` is read from."""
    read = docs.inputFiles()
    gone = [path for path in _left if not any(path.rsplit("/", 1)[-1] in file for file in read)]
    delete_folders(spark, gone)
    _left[:] = [path for path in _left if path not in gone]


def _stage(function):
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _delete_unread(spark, docs)
        with folders_made() as made:
            result = function(spark, docs, sf_dir)
        _left.extend(made)
        return result

    stage.__doc__ = function.__doc__
    return stage


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    return quality_rules.keep_good(docs)


@_stage
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without later repeated runs of lines; ``n_chars`` follows the text."""
    changed = line_dedup.drop_repeated_runs(docs)
    if "n_chars" not in changed.columns:
        return changed
    return changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies, the one of the smallest doc_id; null doc_ids stay."""
    node, own = fresh(docs, "_node"), fresh(docs, "_own")
    again = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    again = store(again.select(F.col("doc_id").alias(node)), "again")
    if again.isEmpty():
        return _first_of_components(docs, "doc_id", node)
    # Texts of one doc_id are documents of their own; equal rows of it are one.
    marked = docs.join(again, docs["doc_id"] == again[node], "left")
    marked = marked.withColumn(own, F.when(F.col(node).isNull(), F.col("doc_id")).otherwise(F.xxhash64("doc_id", "text")))
    kept = _first_of_components(marked, own, fresh(marked, "_later"))
    single = kept.where(F.col(node).isNull())
    several = kept.where(F.col(node).isNotNull()).dropDuplicates([own])
    return single.unionByName(several).drop(node, own)


def _first_of_components(docs: DataFrame, key: str, name: str) -> DataFrame:
    """``docs`` whose ``key`` is the smallest of its component of near copies, or null."""
    groups = jaccard_join.jaccard_components(docs.select(F.col(key).alias("doc_id"), "text"), n=5, percent=80)
    later = groups.where("component_id <> doc_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(later, docs[key] == later[name], "left_anti")


@_stage
def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their sequences."""
    return packing.packed(docs)


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontaminated),
    ("best_fit_packing", pack),
]

#: Tokenizer ids and hash-ordered fingerprints have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, store(stage(spark, docs, sf_dir), name)
        discard(before)
    _delete_unread(spark, docs)
    return docs
