"""Ranked lexical search of many items over all documents, by blocked dense products.

Terms are the stretches of letters, digits and non-ASCII characters of the whole text, A-Z in lower case. The rank score of
a document for an item is the sum of weight(term) * impact(term, document) over the item's distinct terms, with

    weight = floor(1000 * ln((2 N + 2) / (2 df + 1)))
    impact = 10**9 tf div (1000 tf + 20 (100 - 50 + (50 n N) div L))

N documents with a term, L terms in all, n terms in the document, df documents holding the term, tf its count there.

Items with equal term sets are one search. Searches are dealt to batches of about BATCH_TERMS terms, so that what a task is
sent (a batch: its vocabulary, and item tiles with the vocabulary compacted to their own terms) is bounded however many
items there are. A pass over the documents counts the terms of the batch (stored as numbers) and, with them, df. A second
one turns a block of documents and a tile's vocabulary into a dense impact matrix and multiplies it by the tile's weights.
All numbers are integers; a tile has at most TILE_TERMS terms, so that float64 sums stay below 2**53 and are exact; tiles
of one item add up in 64-bit integers. A task keeps the k best documents of every search, of equal scores those with the
smallest doc_id, so it never drops a row that a tie needs; the lists of the tasks merge in two steps.

Cases: null and empty texts have no terms and rank nowhere; an item without terms has no rows; items of one id are
searched each on its own; a null doc_id ranks behind all others of its score; rows of one doc_id are ranked each. Columns other than ids and
texts play no part. Word identity is a 64-bit hash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from galleryspark.llm.common import store
from galleryspark.llm.hashing import NOT_ALNUM, blocks, words

BATCH_TERMS = 1 << 18
TILE_ITEMS = 64
TILE_TERMS = 4096
BLOCK_DOCS = 512
MERGE_SALTS = 64
#: 10**9 tf div (1000 tf + 20 m) is below this, whatever m is.
MAX_IMPACT = 10**6
_LAST = np.iinfo(np.int64).max


def _search_sets(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item, search, terms): the distinct term hashes of every item; equal sets share the number ``search``."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = []
            for base, end, data, starts in blocks(batch.column(1)):
                hashes, rows, _, _ = words(data, starts, NOT_ALNUM)
                edges = np.searchsorted(rows, np.arange(end - base + 1))
                sets += [np.unique(hashes[a:b]).view(np.int64) for a, b in zip(edges[:-1], edges[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["item", "terms"])

    rows = items.select(F.col(item_id).cast("long").alias("item"), F.col(text).cast("string").alias("text"))
    rows = rows.mapInArrow(scan, "item long, terms array<long>").where(F.size("terms") > 0)
    return store(rows.withColumn("search", F.xxhash64("terms")), "searches")


def _term_counts(docs: DataFrame, doc_id: str, text: str, vocabulary: np.ndarray) -> DataFrame:
    """(doc, n, terms, counts): number of terms, and places in the sorted ``vocabulary`` with their counts."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for base, end, data, starts in blocks(batch.column(1)):
                hashes, rows, _, _ = words(data, starts, NOT_ALNUM)
                size = end - base
                place = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                hit = known[place] == hashes
                key, count = np.unique(rows[hit] * len(known) + place[hit], return_counts=True)
                offsets = pa.array(np.searchsorted(key, np.arange(size + 1) * len(known)), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(base, size),
                        pa.array(np.bincount(rows, minlength=size), pa.int64()),
                        pa.ListArray.from_arrays(offsets, pa.array(key % len(known), pa.int32())),
                        pa.ListArray.from_arrays(offsets, pa.array(count, pa.int64())),
                    ],
                    names=["doc", "n", "terms", "counts"],
                )

    rows = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).cast("string").alias("text"))
    return store(rows.mapInArrow(scan, "doc long, n long, terms array<int>, counts array<long>"), "term_counts")


def _document_frequencies(counted: DataFrame, size: int) -> np.ndarray:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(size, np.int64)
        for batch in batches:
            found += np.bincount(batch.column(0).flatten().to_numpy(), minlength=size)
        term = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(term, pa.int32()), pa.array(found[term], pa.int64())], names=["term", "df"])

    rows = counted.select("terms").mapInArrow(scan, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    found = np.zeros(size, np.int64)
    found[rows["term"].to_numpy()] = rows["df"].to_numpy()
    return found


def item_tiles(sets: list[np.ndarray], weights: np.ndarray) -> list[tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]]:
    """Per tile its searches and slices of its own vocabulary: the terms and a dense matrix of weights (term, search)."""
    tiles = []
    for first in range(0, len(sets), TILE_ITEMS):
        own = sets[first : first + TILE_ITEMS]
        terms = np.unique(np.concatenate(own))
        slices = []
        for at in range(0, len(terms), TILE_TERMS):
            part = terms[at : at + TILE_TERMS]
            dense = np.zeros((len(part), len(own)))
            for column, held in enumerate(own):
                dense[np.isin(part, held, assume_unique=True), column] = 1
            dense *= weights[part][:, None]
            if dense.sum(axis=0).max() * MAX_IMPACT >= 2.0**53:
                raise OverflowError("a tile's sums may leave the integers that float64 holds; lower TILE_TERMS")
            slices.append((part, dense))
        tiles.append((np.arange(first, first + len(own)), slices))
    return tiles


def impacts(n: np.ndarray, owner: np.ndarray, counts: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """The impact of every (document, term) pair; Python integers where 50 n N may leave 64 bits."""
    m = np.array([50 + 50 * int(x) * n_docs // n_terms for x in n], np.int64)
    return 10**9 * counts // (1000 * counts + 20 * m[owner])


class _Best:
    """The k best (score, doc) of every search so far; of equal scores the smallest doc."""

    def __init__(self, searches: int, k: int):
        self.k, self.floor = k, np.ones(searches, np.int64)
        self.kept = [np.zeros(0, np.int64)] * 3
        self.fresh, self.size = [], 0

    def add(self, first: int, scores: np.ndarray, docs: np.ndarray) -> None:
        """``scores`` of some documents (rows) for the searches from ``first`` on (columns)."""
        row, column = np.nonzero(scores >= self.floor[first : first + scores.shape[1]])
        self.fresh.append((column + first, scores[row, column], docs[row]))
        self.size += len(row)
        if self.size > 4 * self.k * len(self.floor):
            self.cut()

    def cut(self) -> None:
        search, score, doc = (np.concatenate(x) for x in zip(self.kept, *self.fresh))
        order = np.lexsort((doc, -score, search))
        search, score, doc = search[order], score[order], doc[order]
        rank = np.arange(len(search)) - np.searchsorted(search, search)
        full = rank == self.k - 1
        self.floor[search[full]] = score[full]  # an equal score with a smaller doc may still come
        best = rank < self.k
        self.kept, self.fresh, self.size = [search[best], score[best], doc[best]], [], 0


def _best_of_tasks(counted: DataFrame, searches: np.ndarray, tiles: list, n_docs: int, n_terms: int, size: int, k: int) -> DataFrame:
    shared = counted.sparkSession.sparkContext.broadcast((searches, tiles))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, tiles = shared.value
        best, local = _Best(len(names), k), np.full(size, -1, np.int32)
        for batch in batches:
            docs = batch.column(0).fill_null(_LAST).to_numpy()
            n = batch.column(1).to_numpy()
            edges = batch.column(2).offsets.to_numpy()
            terms, counts = (batch.column(c).values.to_numpy() for c in (2, 3))
            for first in range(0, len(docs), BLOCK_DOCS):
                end = min(first + BLOCK_DOCS, len(docs))
                pairs = slice(edges[first], edges[end])
                owner = np.repeat(np.arange(end - first), np.diff(edges[first : end + 1]))
                impact = impacts(n[first:end], owner, counts[pairs], n_docs, n_terms)
                for own, slices in tiles:
                    scores = np.zeros((end - first, len(own)), np.int64)
                    for vocabulary, weights in slices:
                        local[vocabulary] = np.arange(len(vocabulary), dtype=np.int32)
                        column = local[terms[pairs]]
                        held = column >= 0
                        dense = np.zeros((end - first, len(vocabulary)))
                        dense[owner[held], column[held]] = impact[held]
                        scores += (dense @ weights).astype(np.int64)
                        local[vocabulary] = -1
                    best.add(int(own[0]), scores, docs[first:end])
        best.cut()
        search, score, doc = best.kept
        yield pa.RecordBatch.from_arrays(
            [pa.array(names[search], pa.int64()), pa.array(doc, pa.int64(), mask=doc == _LAST), pa.array(score, pa.int64())],
            names=["search", "doc_id", "score"],
        )

    return counted.mapInArrow(scan, "search long, doc_id long, score long")


def _top(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def ranked_search(
    docs: DataFrame, items: DataFrame, k: int = 50, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents with a score above 0 of every item."""
    sets = _search_sets(items, item_id, item_text)
    distinct = sets.groupBy("search").agg(F.first("terms").alias("terms"))
    volume = distinct.agg(F.sum(F.size("terms"))).first()[0] or 0
    batches = math.ceil(volume / BATCH_TERMS)
    found = None
    for batch in range(batches):
        rows = distinct.where(F.pmod(F.xxhash64("search"), F.lit(batches)) == batch).orderBy("search").toArrow()
        if not len(rows):
            continue
        searches = rows["search"].to_numpy()
        terms = rows["terms"].combine_chunks()
        known, place = np.unique(terms.flatten().to_numpy().view(np.uint64), return_inverse=True)
        own = np.split(place, np.cumsum(terms.value_lengths().to_numpy())[:-1])
        counted = _term_counts(docs, doc_id, text, known)
        n_docs, n_terms = counted.agg(F.count(F.when(F.col("n") > 0, 1)), F.sum("n")).first()
        if not n_docs:
            break
        df = _document_frequencies(counted, len(known))
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.float64)
        some = counted.where(F.size("terms") > 0)
        part = _best_of_tasks(some, searches, item_tiles(own, weights), n_docs, n_terms, len(known), k)
        part = part.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(MERGE_SALTS)))
        part = _top(_top(part, ["search", "salt"], k), ["search"], k)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = docs.sparkSession.createDataFrame([], "search long, doc_id long, score long, rank int")
    return sets.select("search", F.col("item").alias("item_id")).join(found, "search").select("item_id", "rank", "doc_id", "score")


#: The contract in SQL: terms by a regular expression, integer arithmetic, one window per item.
RANKED_SQL = r"""
with d as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
i as (select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
s as (select count(*) as n_docs, sum(len(w))::bigint as n_terms from d where len(w) > 0),
c as (select doc_id, n, term, count(*) as tf from (select doc_id, len(w) as n, unnest(w) as term from d) where term in (select term from i) group by all),
w as (select term, floor(1000 * ln((2 * any_value(n_docs) + 2)::double / (2 * count(*) + 1)))::bigint as weight from c, s group by term),
p as (select item_id, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))))::bigint as score
      from i join c using (term) join w using (term), s group by item_id, doc_id),
r as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from p where score > 0)
select item_id, rank::int as rank, doc_id, score from r where rank <= 50
"""
