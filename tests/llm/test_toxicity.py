"""The toxicity grammar: composed machine against chained transducers, features against plain loops, held-out accuracy."""

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from galleryspark.llm import queries, toxicity
from galleryspark.llm.toxicity import FACTORS, INPUTS, ClauseScorer, grammar, negation_transducer, report_transducer, score_toxicity, target_transducer
from galleryspark.llm.transducers import Machine, Transducer

LEXICON = {"idiot": 4.0, "scum$": 3.0, "vequ": 5.0, "vequai$": 0.0}


def chained(symbols):
    for transducer in (target_transducer(), negation_transducer(), report_transducer()):
        symbols = transducer.run(symbols)
    return symbols


def test_composition_equals_chain():
    rng = np.random.default_rng(0)
    whole = grammar()
    clauses = [[INPUTS[k] for k in rng.integers(0, len(INPUTS), rng.integers(0, 25))] for _ in range(500)]
    assert all(whole.run(c) == chained(c) for c in clauses)
    numbers = np.array([INPUTS.index(s) for c in clauses for s in c], np.int32)
    end = np.cumsum([len(c) for c in clauses])
    first = end - [len(c) for c in clauses]
    got = Machine(whole, INPUTS, list(FACTORS)).run(numbers, first, end)
    names = list(FACTORS)
    assert got.tolist() == [names.index(s) if s in names else -1 for c in clauses for s in chained(c)]


def test_a_symbol_without_rule_passes():
    t = Transducer("a", {("a", "x"): ("b", "y"), ("b", "x"): ("a", "x")})
    assert t.run("xzxx") == ["y", "z", "x", "y"]
    assert t.then(t, ["x", "y", "z"]).run("xxxx") == t.run(t.run("xxxx"))


def brute(text):
    """The features by plain loops."""
    text = (text or "").lower()
    words = re.findall(r"[^\W\d_]+(?:['’][^\W\d_]+)?", text)
    weight = {}
    for w in words:
        for p in [w + "$"] + [w[:k] for k in range(min(12, len(w)), 2, -1)]:
            if p in LEXICON:
                weight[w] = LEXICON[p]
                break
    scores = []
    for clause in re.split(r"[.!?;\n]+", text):
        tokens = re.findall(r"[^\W\d_]+(?:['’][^\W\d_]+)?|[,“”„«»]", clause)
        symbols = ["insult" if weight.get(t) else INPUTS[toxicity._CLASS.get(t, 0)] for t in tokens]
        if "insult" in symbols or "threat" in symbols:
            scores.append(sum(FACTORS.get(s, 0) * (weight.get(t) or 4.0) for s, t in zip(chained(symbols), tokens)))
    row = [sum(scores), max(scores, default=0), sum(s > 0 for s in scores), sum(w > 0 for w in weight.values()), len(words)]
    return [1, *(math.log1p(max(v, 0)) for v in row)]


TEXTS = [
    None, "", " .!? ", "You are an idiot.", "You are not an idiot.", "She said: you are an idiot.", "idiot", "I will kill you! He wrote “kill you” and left.",
    "Scum, scums; SCUM\nvequai vequaix vequ VEQUE.", "No, you idiot", "nothing here at all, 123 _x_", "x" * 100_000 + " idiot " * 3000, "don't hurt you, hurt you",
]


def test_features():
    got = ClauseScorer(LEXICON).features(TEXTS)
    assert np.allclose(got, [brute(t) for t in TEXTS])
    total = dict(zip(TEXTS, got[:, 1]))
    assert total["You are an idiot."] > total["idiot"] > total["She said: you are an idiot."] > total["You are not an idiot."] > 0
    assert ClauseScorer(LEXICON).weight("vequai") == 0 and ClauseScorer(LEXICON).weight("vequaix") == 5


def labelled(n=400):
    """A third of the texts hold words that begin with qor; harmless words begin like them."""
    rng = np.random.default_rng(5)
    rows, labels = [], []
    for d in range(n):
        words = [f"w{''.join(chr(97 + int(c)) for c in rng.integers(0, 6, 3))}" for _ in range(40)] + ["qorhouse"] * (d % 2)
        toxic = int(d % 3 == 0)
        for _ in range(4 * toxic):
            words.insert(int(rng.integers(0, 40)), "qor" + "".join(chr(97 + int(c)) for c in rng.integers(0, 20, 3)))
        rows.append((d, " ".join(words) + ". End.", "x", 1.0))
        labels.append((d, toxic))
    return rows, labels


def test_learns_beginnings_of_words(spark):
    rows, labels = labelled()
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, predicted double")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in score_toxicity(docs, marks, F.col("doc_id") % 4 != 1).collect()}
    assert all(got[d]["held_out"] == (d % 4 == 1) for d, _ in labels)
    right = [got[d]["predicted"] == toxic for d, toxic in labels if d % 4 == 1]
    assert sum(right) >= 0.97 * len(right)


def test_odd_rows(spark):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(3, "You are an idiot."), (None, "You are an idiot."), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    learn = F.crc32(F.col("doc_id").cast("string")) % 5 != 0
    got = score_toxicity(docs, none, learn).collect()
    assert len(got) == len(rows) and {r["score"] for r in got} == {0.25}
    assert all(not r["held_out"] for r in got if r["doc_id"] is None)
    some = spark.createDataFrame([(3, 1), (3, 0), (5, None), (0, 0), (6, 1), (None, 1), (99, 1)], "doc_id long, toxic int")
    got = score_toxicity(docs, some, learn).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert score_toxicity(docs.limit(0), some, learn).count() == 0


def test_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    marks = spark.read.parquet(f"{sf}/labels.parquet").where("toxic is not null")
    got = queries.op11_toxicity(spark, sf).where("held_out").join(marks, "doc_id").toPandas()
    english = spark.read.parquet(f"{sf}/documents.parquet").where("lang = 'en'").select("doc_id").toPandas()["doc_id"]
    own = got[got["doc_id"].isin(english)]  # other languages have five toxic texts each to learn from
    assert ((own["predicted"] == 1) & (own["toxic"] == 1)).sum() >= 0.9 * (own["toxic"] == 1).sum()
    assert (got["predicted"] > got["toxic"]).sum() <= 0.03 * len(got)


def test_few_labels_still_rank_insults():
    """No learned path and a table of eight labels: the known insults and the expected signs decide."""
    texts = ["you are an idiot", "a valve of brass", "what a pathetic loser", "the pump and its seal", "ein Ventil", "one more line", "a b c", "text"]
    labels = np.array([1, 0, 1, 0, 0, 0, 0, 0], float)
    none = np.zeros(0)
    scorer = toxicity.ClauseScorer(toxicity.lexicon_of(pd.DataFrame({"path": np.zeros(0, object)}), (2, 6), none, none))
    w = toxicity.fit_logistic(scorer.features(texts), labels)
    high, low = scorer.features(["she met that idiot here", "she met that friend here"]) @ w
    assert high > low


def test_labels_overrule_known_insults():
    table = pd.DataFrame({"path": ["scum" + toxicity.END]})
    assert ("scum" + toxicity.END) not in toxicity.lexicon_of(table, (50, 50), np.array([4.0]), np.array([9.0]))


def test_fit_does_not_run_away():
    """Whole Newton steps leave the minimum on some small tables; the loss may not rise above that of the start."""
    for seed in range(40):
        rng = np.random.default_rng(seed)
        x = np.column_stack([np.ones(30), rng.normal(0, 6, (30, 5))])
        y = (x[:, 1] + x[:, 2] + rng.normal(0, 1, 30) > 6).astype(float)
        if not 0 < y.sum() < len(y):
            continue
        loss = lambda w: np.logaddexp(0, x @ w).sum() - y @ (x @ w) + ((w - np.array(toxicity.EXPECTED))[1:] ** 2).sum() / 2  # noqa: B023, E731
        w, step = toxicity.fit_logistic(x, y), 1e-3
        assert all(loss(w) <= loss(w + step * e) + 1e-9 for e in (*np.eye(6)[1:], *-np.eye(6)[1:]))
