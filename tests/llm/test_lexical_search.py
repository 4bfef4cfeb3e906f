"""Ranked search against a plain sum over the terms of each pair."""

import math
import re
from collections import Counter

import numpy as np

from galleryspark.llm import lexical_search
from galleryspark.llm.lexical_search import ranked_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k):
    bags = [(d, Counter(terms(t))) for d, t in docs]
    n_docs, n_terms = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    rows = []
    for item, text in items:
        scored = []
        for d, bag in bags:
            m = 50 + 50 * sum(bag.values()) * n_docs // n_terms if n_terms else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 20 * m)) for t in set(terms(text)) & set(bag))
            if score > 0:
                scored.append((-score, d is None, d))
        scored.sort(key=lambda s: (s[0], s[1], s[2] or 0))
        rows += [(item, r + 1, d, -s) for r, (s, _, d) in enumerate(scored[:k])]
    return sorted(rows, key=str)


def tables(seed=0, n=300):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(200)] + ["É", "éa", "ñ9", "X1"]
    word = lambda m: " ".join(vocabulary[int(204 * x**3)] for x in rng.random(m))
    docs = [(d, word(int(rng.integers(0, 60)))) for d in range(n)]
    docs += [(900, None), (901, ""), (902, "-- ..."), (None, docs[5][1]), (None, "w1 w2"), (5, docs[5][1]), (5, "x1, X1; x1"), (903, "w3 " * 30_000)]
    docs += [(1000 + d, "w7 w8 tie") for d in range(40)]
    items = [(i, word(int(rng.integers(1, 40)))) for i in range(12)]
    items += [(50, None), (51, ""), (52, "!"), (53, "absent words only"), (54, "W7, w8 w7"), (54, "w7 w8"), (55, "w8 w7 w7"), (None, "w3"), (56, "É ñ9 x1"), (57, "tie")]
    return docs, items


def search(spark, docs, items, k):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "text", "1 as score", "'x' as search", "2 as n").repartition(5)
    i = spark.createDataFrame(items, "item_id long, text string").selectExpr("text", "'y' as terms", "item_id", "3 as rank")
    return sorted(map(tuple, ranked_search(d, i, k).collect()), key=str)


def test_against_all_pairs(spark):
    docs, items = tables()
    for k in (1, 7, 50):
        assert search(spark, docs, items, k) == brute(docs, items, k)


def test_many_tiles_and_batches(spark, monkeypatch):
    docs, items = tables(1, 120)
    for name, value in (("BATCH_TERMS", 40), ("TILE_ITEMS", 3), ("TILE_TERMS", 5), ("BLOCK_DOCS", 7), ("MERGE_SALTS", 3)):
        monkeypatch.setattr(lexical_search, name, value)
    assert search(spark, docs, items, 6) == brute(docs, items, 6)


def test_empty_tables(spark):
    docs, items = tables(2, 10)
    assert search(spark, [], items, 5) == search(spark, docs, [], 5) == search(spark, [(1, None)], items, 5) == []


def test_exact_beyond_single_products():
    """Sums of a tile are exact integers, and the bound is checked."""
    rng = np.random.default_rng(3)
    weights = rng.integers(20_000, 30_000, 9000).astype(float)
    sets = [np.arange(9000)]
    impact = rng.integers(900_000, 10**6, 9000)
    (own, slices), = lexical_search.item_tiles(sets, weights)
    got = sum(int((impact[t].astype(float) @ w)[0]) for t, w in slices)
    assert got == sum(int(a) * int(b) for a, b in zip(impact, weights)) and len(slices) == 3
    try:
        lexical_search.item_tiles([np.arange(4096)], np.full(4096, 2.0**32))
    except OverflowError:
        return
    raise AssertionError
