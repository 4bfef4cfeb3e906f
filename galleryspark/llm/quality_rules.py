"""Quality rules whose failures are judged per host (built-in functions only).

Every document is measured; a host (``source``) has a share of documents that fail any rule. Shares of small hosts
are noisy, so they are shrunk towards the mean of all hosts with a beta prior fitted to the hosts by moments. A
document goes if it fails a base rule or a severe rule, or if it fails a mild rule and its host's shrunken share is
above one half: a good host's odd page stays, a bad host's odd page goes, and a document that fails no rule stays
wherever it is.

Cases: null, empty and blank texts have zero words and fail the base rules. A null source is one host of its own.
Each row is judged alone with its host, so repeated rows and doc_ids (null too) get the same verdict as often as
they occur. Other columns pass through; no name can clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from galleryspark.llm.common import fresh, store

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
HOST_LIMIT = 0.5


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " "), "")


def measured(df: DataFrame, text: str = "text") -> tuple[DataFrame, str]:
    """``df`` with a struct of counts, and the name of the struct."""
    words, lines, triples, ranked, out = (fresh(df, f"_q_{x}") for x in ("words", "lines", "triples", "ranked", "out"))
    value = F.coalesce(F.col(text).cast("string"), F.lit(""))
    n = F.size(words)
    df = df.withColumn(words, _words(value)).withColumn(
        lines, F.filter(F.split(value, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    )
    triple = F.transform(
        F.slice(words, 1, F.greatest(n - 2, F.lit(0))),
        lambda w, i: F.xxhash64(w, F.get(F.col(words), i + 1), F.get(F.col(words), i + 2)),
    )
    df = df.withColumn(triples, triple)
    df = df.withColumn(
        ranked,
        F.when(
            F.size(F.array_distinct(triples)) < F.size(triples),
            F.sort_array(F.transform(triples, lambda h, i: F.struct(h.alias("h"), i.alias("at")))),
        ),
    )
    again = F.filter(
        ranked,
        lambda x, i: F.coalesce(F.get(F.col(ranked), i - 1)["h"] == x["h"], F.lit(False))
        | F.coalesce(F.get(F.col(ranked), i + 1)["h"] == x["h"], F.lit(False)),
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform(again, lambda x: F.array(x["at"], x["at"] + 1, x["at"] + 2)))))
    spaces = "".join(" \t\n\x0b\x0c\r")
    df = df.withColumn(
        out,
        F.struct(
            n.cast("long").alias("n_words"),
            F.length(F.translate(value, spaces, "")).cast("long").alias("word_chars"),
            (F.length(value) - F.length(F.translate(value, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            F.when(F.col(ranked).isNull(), F.lit(0)).otherwise(covered).cast("long").alias("n_repeat_words"),
        ),
    )
    return df.drop(words, lines, triples, ranked), out


def _flags(m: str) -> dict[str, Column]:
    c = lambda name: F.col(m)[name]
    return {
        "base": (c("n_words") < MIN_WORDS) | (100 * c("n_repeat_words") > MAX_REPEAT_PERCENT * c("n_words")),
        "severe": (2 * c("n_symbols") > c("n_words")) | (2 * c("n_dup_lines") > c("n_lines")),
        "mild": (10 * c("n_symbols") > c("n_words"))
        | (10 * c("n_dup_lines") > 3 * c("n_lines"))
        | (100 * c("n_repeat_words") > 25 * c("n_words"))
        | (c("word_chars") < 2 * c("n_words"))
        | (c("word_chars") > 12 * c("n_words")),
    }


def host_verdicts(rows: DataFrame, host: str, failed: Column) -> DataFrame:
    """(host, n_docs, n_failed, bad): the beta-shrunken failure share of each host against the limit."""
    hosts = rows.groupBy(F.struct(F.col(host)).alias("host")).agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(failed.cast("long")).alias("n_failed")
    )
    share = F.col("n_failed") / F.col("n_docs")
    prior = hosts.agg(F.avg(share).alias("m"), F.var_pop(share).alias("v"))
    # Moments: m (1 - m) / v - 1 pseudo-documents; one document where the hosts tell nothing about their spread.
    strength = F.when(F.col("v") > 0, F.greatest(F.col("m") * (1 - F.col("m")) / F.col("v") - 1, F.lit(1.0))).otherwise(1.0)
    prior = prior.select("m", strength.alias("k"))
    posterior = (F.col("n_failed") + F.col("m") * F.col("k")) / (F.col("n_docs") + F.col("k"))
    # prior is a single row
    return hosts.join(F.broadcast(prior)).select("host", "n_docs", "n_failed", (posterior > HOST_LIMIT).alias("bad"))


def judged(docs: DataFrame, text: str = "text") -> tuple[DataFrame, tuple[str, str]]:
    """``docs`` with a struct of counts and a struct of flags, and the names of both."""
    rows, m = measured(docs, text)
    flags = _flags(m)
    mark = fresh(rows, "_q_flags")
    return rows.withColumn(mark, F.struct(*[c.alias(k) for k, c in flags.items()])), (m, mark)


def _with_verdict(rows: DataFrame, host: str, mark: str) -> tuple[DataFrame, str]:
    """``rows``, stored because they are measured once and read twice, with a column that is true on bad hosts."""
    rows = store(rows, "quality")
    failed = F.col(mark)["base"] | F.col(mark)["severe"] | F.col(mark)["mild"]
    verdicts = host_verdicts(rows, host, failed).where("bad").select("host", "bad")
    key, bad = fresh(rows, "_q_host"), fresh(rows, "_q_bad")
    verdicts = verdicts.withColumnsRenamed({"host": key, "bad": bad})
    # Only documents whose fate depends on their host travel to its verdict.
    open_case = F.col(mark)["mild"] & ~F.col(mark)["base"] & ~F.col(mark)["severe"]
    clear = rows.where(~open_case).withColumn(bad, F.lit(False))
    asked = rows.where(open_case).withColumn(key, F.struct(F.col(host))).join(verdicts, key, "left").drop(key)
    return clear.unionByName(asked), bad


def quality_report(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """Per row: doc_id, counts, base_failed and kept."""
    rows, (m, mark) = judged(docs.select("doc_id", text, host), text)
    rows, bad = _with_verdict(rows.drop(text), host, mark)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    host_bad = F.coalesce(F.col(bad), F.lit(False))
    flag = F.col(mark)
    return rows.select(
        "doc_id",
        *[F.col(m)[x].alias(x) for x in names],
        flag["base"].alias("base_failed"),
        (~(flag["base"] | flag["severe"] | (flag["mild"] & host_bad))).alias("kept"),
    )


def keep_good(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their columns."""
    rows, (_, mark) = judged(docs, text)
    rows, bad = _with_verdict(rows, host, mark)
    flag = F.col(mark)
    keep = ~(flag["base"] | flag["severe"] | (flag["mild"] & F.coalesce(F.col(bad), F.lit(False))))
    return rows.where(keep).select(*[F.col(f"`{c}`") for c in docs.columns])


REPORT_SQL = r"""
with t as (select row_number() over () as r, doc_id, source, coalesce(text, '') as text from documents),
w as (select r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w from t),
p as (select r, unnest(w) as word, generate_subscripts(w, 1) as i from w),
g as (select r, i, lead(word, 0) over o as a, lead(word, 1) over o as b, lead(word, 2) over o as c from p window o as (partition by r order by i)),
d as (select r, i from (select r, i, c, count(*) over (partition by r, a, b, c) as n from g where c is not null) where n > 1),
e as (select r, count(distinct j) as n_repeat_words from (select r, unnest([i, i + 1, i + 2]) as j from d) group by r),
l as (select r, unnest(string_split(text, chr(10))) as line from t),
k as (select r, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines from l
      where regexp_matches(line, '[^\x20\x09-\x0D]') group by r),
m as (select t.r, doc_id, source, len(w.w) as n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) as word_chars,
        length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols,
        coalesce(n_lines, 0) as n_lines, coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words
      from t join w using (r) left join k using (r) left join e using (r)),
f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base,
        2 * n_symbols > n_words or 2 * n_dup_lines > n_lines as severe,
        10 * n_symbols > n_words or 10 * n_dup_lines > 3 * n_lines or 100 * n_repeat_words > 25 * n_words
          or word_chars < 2 * n_words or word_chars > 12 * n_words as mild from m),
h as (select source, count(*) as n_docs, sum((base or severe or mild)::int) as n_failed from f group by source),
q as (select avg(n_failed / n_docs) as m, var_pop(n_failed / n_docs) as v from h),
b as (select source, (n_failed + m * k) / (n_docs + k) > 0.5 as bad
      from h, (select m, case when v > 0 then greatest(m * (1 - m) / v - 1, 1.0) else 1.0 end as k from q))
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols,
  n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words, base as base_failed,
  not (base or severe or (mild and bad)) as kept
from f left join b on f.source is not distinct from b.source
"""
