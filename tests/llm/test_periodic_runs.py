"""Periodic runs against the definition, checked for every stretch."""

import hashlib
import zlib

import numpy as np
import pytest

from galleryspark.llm import queries
from galleryspark.llm.periodic_runs import find_runs, lag_scan, periodic_runs, run_digest, with_planted_tails

SF = "/root/testdata/sf0.001"


def brute(w):
    """All maximal runs, period by period; one counts if no smaller period fits it."""
    runs = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j - i + q
            if j > i and n >= max(6, 4 * q) and not any(all(w[k] == w[k + r] for k in range(i, i + n - r)) for r in range(1, q)):
                runs.append((i, n, q))
            i = j + 1
    return sorted(runs, key=lambda r: (r[0], r[2]))


def digest(doc_id, text):
    w = (text or "").encode().split()
    if doc_id is not None and w and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    runs = brute(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = None
    for s, n, q in runs:
        if best is None or n * best[2] > best[1] * q:
            best = (s, n, q)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()
    rest = b" ".join(x for i, x in enumerate(w) if i not in gone)
    last = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    return (doc_id, len(runs), *last, hashlib.sha256(lines).hexdigest(), hashlib.sha256(rest).hexdigest())


def test_random_words():
    rng = np.random.default_rng(1)
    for k in range(400):
        parts = []
        for _ in range(int(rng.integers(1, 5))):
            unit = rng.integers(0, rng.integers(1, 6), rng.integers(1, 30)).tolist()
            parts += unit * int(rng.integers(1, 8)) if rng.random() < 0.6 else rng.integers(0, 8, 40).tolist()
        x = np.array(parts[: int(rng.integers(1, len(parts) + 1))])
        assert sorted(lag_scan(x), key=lambda r: (r[0], r[2])) == brute(x.tolist())
        words = [b"w%d" % i for i in x]
        assert find_runs(words + words, np.array([0, len(x), 2 * len(x)])) == [brute(x.tolist())] * 2


def test_long_periods():
    rng = np.random.default_rng(2)
    unit = [b"u%d" % i for i in rng.integers(0, 3000, 700)]
    words = [b"a"] * 5 + unit * 5 + unit[:13] + [b"z", b"a", b"b"] * 9
    (runs,) = find_runs(words, np.array([0, len(words)]))
    assert runs == brute(words) and (5, 3513, 700) in runs


def odd_rows():
    rng = np.random.default_rng(3)
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a a a a a a"), (4, "a a a a a a"), (None, "x y x y x y x y"), (None, None)]
    rows += [(5, "A a A a A a A a  a A"), (6, "b" + "\x0bab\x0c ab\rab\nab\tab ab"), (7, "\u0000 \u0000 \u0000 \u0000 \u0000 \u0000")]
    for d in range(10, 450):
        rows.append((d, " ".join(f"w{x}" for x in rng.integers(0, 4 + d % 60, rng.integers(0, 120)))))
    for d in range(500, 540):  # a stretch of four to eight periods between other words
        unit = [f"v{x}" for x in rng.integers(0, 9, 1 + d % 13)]
        rows.append((d, " ".join(["one"] * (d % 3) + unit * (4 + d % 5) + ["two", "two"])))
    return rows


def test_digest(spark):
    docs = spark.createDataFrame(odd_rows(), "doc_id long, text string")
    got = run_digest(periodic_runs(with_planted_tails(docs)))
    assert sorted(map(tuple, got.collect()), key=str) == sorted((digest(*r) for r in odd_rows()), key=str)
    assert sum(r["n_runs"] for r in got.collect()) > 30


def test_names_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b a b a b a b c", "x", 3)], "doc_id long, text string, Runs string, n_words int")
    row = periodic_runs(docs).first()
    assert row.asDict(True) == {"doc_id": 1, "text": "a b a b a b a b c", "n_words": 9, "runs": [{"start": 0, "length": 8, "period": 2}], "collapsed": "a b c"}
    assert periodic_runs(docs.limit(0)).count() == 0 and run_digest(periodic_runs(with_planted_tails(docs.limit(0)))).count() == 0


def test_very_long_text(spark):
    words = [f"p{i}" for i in range(40_000)] * 5
    row = periodic_runs(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")).first()
    assert [tuple(r) for r in row["runs"]] == [(0, 200_000, 40_000)] and row["collapsed"] == " ".join(words[:40_000])


@pytest.mark.parametrize("sf", [SF])
def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    short = [tuple(r) for r in docs if len(r["text"] or "") < 4000]
    got = {r["doc_id"]: tuple(r) for r in queries.op12_periodic_runs(spark, sf).collect()}
    assert len(got) == len(docs)
    assert all(got[d] == digest(d, t) for d, t in short)
