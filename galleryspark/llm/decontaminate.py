"""Size-partitioned MinHash containment search for short test items inside long documents.

Items fall into size classes by powers of two. For each class that has items, documents are cut into blocks of the
class's size (in 5-word shingles), and two neighbouring blocks make a window, so an occurrence of an item lies in one
window whose size is at most four times the item's: containment of 80 % then means a Jaccard similarity of
at least 0.19, and with HASHES signatures of one row each a window that holds the item is missed with a probability
below 0.81 ** 64, about one in a million. Candidates are verified by exact containment of the item's distinct
shingles in the whole document.

Window signatures never leave their task unless a bit set of fixed size, made of the items' signatures, may hold
them; what passes is joined with the items. A document that holds all items, or an item that sits in a third of
all documents, costs rows in proportion.

Words are runs of letters and digits, A-Z lower-cased; every other ASCII character separates. A text with fewer words
is one shingle. Cases: null or empty texts and items have no shingles and match nothing; rows that share a doc_id
(or item_id) are one document (item) with all their shingles; null ids are not searched, and `clean` keeps them;
other columns are ignored or passed through, no name can clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from galleryspark.llm.common import fresh, membership_bits, present, store
from galleryspark.llm.hashing import NOT_ALNUM, U, blocks, mix, ngrams, shingle_sets, words

SHINGLE = 5
PERCENT = 80
HASHES = 64
LOG2_BITS = 26
_FACTORS = mix(np.arange(1, HASHES + 1, dtype=U)) | U(1)


def size_class(n: int) -> int:
    return max(0, int(n - 1).bit_length())


def _keys(minima: np.ndarray, level: int) -> np.ndarray:
    """Signature keys of a (rows x HASHES) matrix of minima."""
    return (minima ^ (np.arange(HASHES, dtype=U) + U(level * HASHES))) * U(0x9E3779B97F4A7C15) ^ (minima >> U(17))


def _item_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, sets = batch.column(0).to_pylist(), [s.view(np.int64) for _, s in shingle_sets(batch.column(1), SHINGLE, NOT_ALNUM)]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["item_id", "tokens"])


def _item_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, keys, levels = [], [], []
        for item, tokens in zip(batch.column(0).to_pylist(), batch.column(1)):
            values = tokens.values.to_numpy().view(U)
            level = size_class(len(values))
            minima = np.array([[np.min(values * f) for f in _FACTORS]])
            keys.append(_keys(minima, level)[0].view(np.int64))
            ids += [item] * HASHES
            levels += [level] * HASHES
        flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(flat), pa.array(levels, pa.int32())], names=["item_id", "key", "level"])


def _grams(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of a block of texts in text order, and their rows; a shorter text is one shingle."""
    hashes, rows, _, _ = words(data, starts, NOT_ALNUM)
    grams, owner = ngrams(hashes, rows, SHINGLE)
    counts = np.bincount(rows, minlength=len(starts))
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    if len(short):
        at = np.concatenate(([0], np.cumsum(counts)))
        ends = [next(shingle_hash(hashes[at[r] : at[r + 1]])) for r in short]
        grams, owner = np.concatenate([grams, np.array(ends, U)]), np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        grams, owner = grams[order], owner[order]
    return grams, owner


def shingle_hash(hashes: np.ndarray) -> Iterator[int]:
    acc = np.full(1, len(hashes), U)
    for h in hashes:
        acc = mix(acc * U(0xD1342543DE82EF95) + h)
    yield acc[0]


def _windows(levels: list[int], bits):
    """(key, doc_id) of window signatures that may be an item's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for first, _, data, starts in blocks(batch.column(1)):
                grams, owner = _grams(data, starts)
                if not len(grams):
                    continue
                text_start = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
                inside = np.arange(len(grams)) - np.repeat(text_start, np.diff(np.append(text_start, len(grams))))
                size = 1 << levels[0]
                cut = np.flatnonzero(inside % size == 0)
                rows, place = owner[cut], inside[cut] // size
                minima = np.stack([np.minimum.reduceat(grams * f, cut) for f in _FACTORS], axis=1)
                level, found = levels[0], []
                while True:
                    if level in levels:
                        pair = rows[1:] == rows[:-1]
                        window = minima.copy()
                        window[:-1][pair] = np.minimum(minima[:-1][pair], minima[1:][pair])
                        keys = _keys(window, level)
                        hit = np.nonzero(present(bits.value, keys.ravel()).reshape(keys.shape))
                        found.append(np.stack([keys[hit], rows[hit[0]].astype(U)], axis=1))
                    if level == levels[-1]:
                        break
                    level += 1
                    cut = np.flatnonzero(place % 2 == 0)
                    minima = np.minimum.reduceat(minima, cut, axis=0)
                    rows, place = rows[cut], place[cut] // 2
                found = np.unique(np.concatenate(found), axis=0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found[:, 0].view(np.int64)), pa.array(ids[first + found[:, 1].astype(np.int64)])], names=["key", "doc_id"]
                )

    return run


def _shared_tokens(bits, wanted):
    """(doc_id, token) of the tokens of wanted documents that may be an item's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(present(wanted.value, batch.column(2).to_numpy())))
            ids = batch.column(0).to_numpy()
            for row, tokens in shingle_sets(batch.column(1), SHINGLE, NOT_ALNUM):
                tokens = tokens[present(bits.value, tokens)].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(tokens), ids[row])), pa.array(tokens)], names=["doc_id", "token"])

    return run


def contained_items(docs: DataFrame, items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared) of documents that hold at least ``percent`` of an item's shingles."""
    share = docs.sparkSession.sparkContext.broadcast
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null")
    sets = items.mapInArrow(_item_sets, "item_id long, tokens array<long>")
    tokens = store(sets.select("item_id", F.explode("tokens").alias("token")).distinct(), "items")
    sets = tokens.groupBy("item_id").agg(F.collect_list("token").alias("tokens"))  # of one item
    keys = store(sets.mapInArrow(_item_keys, "item_id long, key long, level int"), "item_keys")
    levels = sorted(r[0] for r in keys.select("level").distinct().collect())  # at most 64
    if not levels:
        return tokens.select(F.lit(0).cast("long").alias("doc_id"), "item_id", F.lit(0).cast("long").alias("n_item"), F.lit(0).cast("long").alias("n_shared")).limit(0)
    bits = share(membership_bits(keys, F.col("key"), LOG2_BITS))
    hits = docs.mapInArrow(_windows(levels, bits), "key long, doc_id long")
    pairs = store(hits.join(keys.select("key", "item_id"), "key").select("doc_id", "item_id").distinct(), "pairs")
    wanted = share(membership_bits(pairs, F.xxhash64("doc_id")))
    token_bits = share(membership_bits(tokens, F.col("token"), LOG2_BITS))
    held = docs.select("doc_id", "text", F.xxhash64("doc_id").alias("key")).mapInArrow(_shared_tokens(token_bits, wanted), "doc_id long, token long")
    shared = held.distinct().join(tokens, "token").groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("n_shared"))
    sizes = tokens.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_item"))
    return (
        shared.join(pairs, ["doc_id", "item_id"], "left_semi")
        .join(sizes, "item_id")
        .where(100 * F.col("n_shared") >= percent * F.col("n_item"))
        .select("doc_id", "item_id", "n_item", "n_shared")
    )


def clean(docs: DataFrame, items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` without the documents that hold an item."""
    key = fresh(docs, "_doc")
    bad = contained_items(docs, items, percent).select(F.col("doc_id").alias(key)).distinct()
    return docs.join(bad, docs["doc_id"].cast("long") == bad[key], "left_anti")


CONTAINED_SQL = r"""
with wd as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
wi as (select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w from benchmark),
gd as (select distinct doc_id, case when len(w) < 5 then array_to_string(w, ' ') else array_to_string(w[i : i + 4], ' ') end as g
       from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from wd where len(w) > 0)),
gi as (select distinct item_id, case when len(w) < 5 then array_to_string(w, ' ') else array_to_string(w[i : i + 4], ' ') end as g
       from (select item_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from wi where len(w) > 0)),
n as (select item_id, count(*) as n_item from gi group by 1)
select doc_id, item_id, any_value(n_item)::bigint as n_item, count(*)::bigint as n_shared
from gd join gi using (g) join n using (item_id) group by doc_id, item_id having 100 * count(*) >= 80 * any_value(n_item)
"""
