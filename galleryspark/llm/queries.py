"""The registered queries of the corpus operators and their SQL twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from galleryspark.llm import (
    chat_format,
    decontaminate,
    jaccard_join,
    language_id,
    lexical_search,
    line_dedup,
    lm_score,
    packing,
    periodic_runs,
    quality_model,
    quality_rules,
    sharding,
    toxicity,
)
from galleryspark.llm.common import documents


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(documents(spark, sf_dir), n=3, percent=90)


def _fold(buckets: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % buckets


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(documents(spark, sf_dir), _fold(4) != 2)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(documents(spark, sf_dir))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_model.score_quality(documents(spark, sf_dir), labels, _fold(3) != 1)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_report(documents(spark, sf_dir))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_texts(documents(spark, sf_dir), _fold(5) != 1)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(documents(spark, sf_dir).select("doc_id"), F.col("doc_id"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.format_digest(chat_format.with_hard_case(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return line_dedup.drop_repeated_runs(docs, removed="n_removed")


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.score_toxicity(documents(spark, sf_dir), labels, _fold(5) != 0)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic_runs.with_planted_tails(documents(spark, sf_dir).select("doc_id", "text"))
    return periodic_runs.run_digest(periodic_runs.periodic_runs(docs.select("doc_id", "text")))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return lexical_search.ranked_search(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_language_id": op2_language_id,
    "op3_decontaminate": op3_decontaminate,
    "op4_packing": op4_packing,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_quality_rules": op6_quality_rules,
    "op7_lm_score": op7_lm_score,
    "op8_sharding": op8_sharding,
    "op9_chat_format": op9_chat_format,
    "op10_line_dedup": op10_line_dedup,
    "op11_toxicity": op11_toxicity,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_lexical_search": op13_lexical_search,
}

ORACLE = {
    "op3_decontaminate": decontaminate.CONTAINED_SQL,
    "op6_quality_rules": quality_rules.REPORT_SQL,
    "op8_sharding": sharding.placement_sql(),
    "op9_chat_format": chat_format.DIGEST_SQL,
    "op13_lexical_search": lexical_search.RANKED_SQL,
    "op1_jaccard_join": r"""
with recursive t as (select doc_id, list_transform(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), lambda w: translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as w from documents),
g as (select distinct doc_id, case when len(w) < 3 then array_to_string(w, ' ') else array_to_string(w[i : i + 2], ' ') end as g
      from (select doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) as i from t where len(w) > 0)),
n as (select doc_id, count(*) as n from g group by doc_id),
p as (select a.doc_id as x, b.doc_id as y, count(*) as shared from g a join g b on a.g = b.g and a.doc_id < b.doc_id group by all),
e as (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * shared >= 90 * (a.n + b.n - shared)),
s as (select x, y from e union select y, x from e),
r(x, y) as (select x, x from (select distinct x from s) union select r.x, s.y from r join s on r.y = s.x)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, coalesce(c.c, d.doc_id)::bigint as component_id
from documents d left join n using (doc_id) left join (select x as doc_id, min(y) as c from r group by x) c using (doc_id)
""",
}
