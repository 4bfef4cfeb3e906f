"""Corpus operators against plain Python on small tables with odd rows."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from galleryspark.llm import chat_format, decontaminate, jaccard_join, language_id, lm_score, packing, quality_model, quality_rules, queries, sharding
from galleryspark.llm.jaccard_join import jaccard_components

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, component_id int"


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(f"w{x}" for x in rng.integers(0, 5000, n))


LONG = prose(9, 20_000)
ODD = [
    (1, None, None, None, None, None, None),
    (2, "", "en", "h", 0, None, None),
    (3, " \n\t ", "en", "h", 0, None, None),
    (4, "One", "en", None, 3, "x", 1),
    (5, "éÉ ñandú 12 ###", "es", None, 3, "x", 1),
    (6, LONG, "en", "h", 3, None, None),
    (7, LONG + " tail", "en", "g", 3, None, None),
    (8, prose(1, 120), "en", "g", 3, None, None),
    (8, prose(2, 120), None, "g", 3, None, None),
    (9, prose(3, 100), "de", "g", 3, None, None),
    (9, prose(3, 100), "de", "g", 3, None, None),
    (None, prose(3, 100), "de", "g", 3, None, None),
    (10, "<|endoftext|> a\u0000b", "en", "h", 3, None, None),
]


@pytest.fixture
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def components_of(rows, n, percent):
    sets = []
    for _, text in rows:
        w = WORD.findall((text or "").translate(LOWER))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set()))
    parent = {d: d for d, _ in rows if d is not None}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b, (x, _), (y, _) = sets[j], rows[i], rows[j]
            if a and b and x is not None and y is not None and 100 * len(a & b) >= percent * len(a | b):
                x, y = top(x), top(y)
                parent[max(x, y)] = min(x, y)
    return sorted(((d, len(s), None if d is None else top(d)) for (d, _), s in zip(rows, sets)), key=str)


def test_jaccard_join(spark, odd, none):
    rows = [(r[0], r[1]) for r in ODD]
    base = prose(5, 60).split()
    for k in range(30):  # near copies of one text, each with some words of its own
        own = list(base)
        for j in range(k % 5):
            own[(7 * k + 11 * j) % 60] = f"own{k}x{j}"
        rows.append((100 + k, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for n, percent in ((3, 90), (5, 80)):
        got = sorted(map(tuple, jaccard_components(df, n, percent).collect()), key=str)
        assert got == components_of(rows, n, percent)
    assert jaccard_components(none, 3, 90).count() == 0
    assert jaccard_components(odd, 3, 90).count() == len(ODD)


def test_jaccard_join_unites_buckets(spark, monkeypatch):
    """Versions of one text around the threshold meet in very many buckets; united buckets lose no link."""
    rng = np.random.default_rng(4)
    base, rows = prose(6, 400).split(), []
    for k in range(24):
        own = list(base)
        for at in rng.choice(400, 2 + k % 8, replace=False):
            own[at] = f"own{k}x{at}"
        rows.append((k, " ".join(own)))
    united, real = [], jaccard_join.store

    def store(df, name):
        stored = real(df, name)
        if name == "chosen":
            united.append(stored.count())
        return stored

    monkeypatch.setattr(jaccard_join, "store", store)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, jaccard_components(df, 3, 90).collect()), key=str) == components_of(rows, 3, 90)
    assert sum(united) > 0


def test_language_id(spark, odd, none):
    learn = F.crc32(F.col("doc_id").cast("string")) % 4 != 2
    got = language_id.identify(odd, learn).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    assert {r["doc_id"]: r["lang_pred"] for r in got}[1] == "und" and {r["doc_id"]: r["lang_pred"] for r in got}[3] == "und"
    assert language_id.identify(none, learn).count() == 0
    out = queries.op2_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert out.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.9


def test_decontaminate(spark, odd, none):
    items = spark.createDataFrame(
        [(1, " ".join(LONG.split()[9000:9020])), (2, "one"), (3, None), (4, ""), (None, "x y"), (5, prose(3, 100)), (6, prose(77, 30)), (7, "A, B; c d e f g h")],
        "item_id long, text string",
    )
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contained_items(odd, items).collect()}
    assert got == {(6, 1), (7, 1), (4, 2), (9, 5)}
    assert decontaminate.contained_items(none, items).count() == 0
    assert decontaminate.contained_items(odd, none.select(F.col("doc_id").alias("item_id"), "text")).count() == 0
    kept = decontaminate.clean(odd, items)
    assert kept.columns == odd.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 5, 8, 8, 10]


def test_packing(spark, odd, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.packed(odd).collect()
    want = []
    for doc, text, *_ in ODD:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        bounds = packing.piece_bounds(len(ids))
        assert sum(n for _, n in bounds) == len(ids) and all(n == 1024 for _, n in bounds[1:]) and 0 < bounds[0][1] <= 1024
        want += [(doc, k, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes())) for k, (s, n) in enumerate(bounds)]
    assert sorted([tuple(r)[:5] for r in got], key=str) == sorted(want, key=str)
    places = defaultdict(list)
    for r in got:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(places) <= -(-sum(n for *_, n, _ in want) // 1024) + 1
    assert packing.packed(none).count() == 0
    joined = packing.sequences(odd.where("doc_id = 6"), packing.packed(odd.where("doc_id = 6")))
    assert joined.agg(F.sum(F.size("ids"))).first()[0] == sum(n for d, _, _, n, _ in want if d == 6)


def test_best_fit_counts():
    rng = np.random.default_rng(0)
    counts = {int(k): int(v) for k, v in Counter(rng.integers(1, 1025, 5000)).items()}
    fill, ranks = defaultdict(list), defaultdict(list)
    for length, lo, hi, first, offset in packing.best_fit(counts):
        ranks[length] += range(lo, hi)
        for k in range(hi - lo):
            fill[first + k].append((offset, length))
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in counts.items()}
    for parts in fill.values():
        parts.sort()
        assert [p[0] for p in parts] == list(np.cumsum([0] + [p[1] for p in parts[:-1]])) and sum(p[1] for p in parts) <= 1024
    assert len(fill) <= 1.02 * sum(k * n for k, n in counts.items()) / 1024 + 1


def test_quality_model(spark, odd, none):
    labels = spark.createDataFrame([(8, 1), (9, 0), (9, 1), (4, None), (6, 1)], "doc_id long, quality int")
    learn = F.crc32(F.col("doc_id").cast("string")) % 3 != 1
    got = quality_model.score_quality(odd, labels, learn).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert quality_model.score_quality(none, labels.limit(0), learn).count() == 0
    assert {r["score"] for r in quality_model.score_quality(odd, labels.limit(0), learn).collect()} == {0.5}


def test_quality_rules(spark, odd, none):
    got = quality_rules.quality_report(odd).collect()
    assert len(got) == len(ODD)
    assert {r["doc_id"]: (r["n_words"], r["base_failed"], r["kept"]) for r in got}[1] == (0, True, False)
    assert quality_rules.quality_report(none).count() == 0
    kept = quality_rules.keep_good(odd.withColumnRenamed("score", "kept"))
    assert "kept" in kept.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 6, 7, 8, 8, 9, 9]
    bad = [(k, ("# " * 20) + prose(k, 150), "bad") for k in range(40)] + [(99, prose(99, 150), "bad"), (100, ("# " * 20) + prose(100, 150), "good")]
    bad += [(101 + k, prose(200 + k, 150), "good") for k in range(40)]
    out = {r["doc_id"]: r["kept"] for r in quality_rules.quality_report(spark.createDataFrame(bad, "doc_id long, text string, source string")).collect()}
    assert not out[0] and out[99] and out[100]  # a bad host's odd page goes; its sound page and a good host's odd page stay


def test_lm_score(spark, odd, none):
    learn = F.crc32(F.col("doc_id").cast("string")) % 5 != 1
    got = lm_score.score_texts(odd, learn).collect()
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1
    tokens = [WORD.findall((t or "").translate(LOWER)) + [None] for _, t, *_ in ODD]
    counts = Counter(w for (d, *_), ws in zip(ODD, tokens) if d is not None and not held(d) for w in ws)
    n, v = sum(counts.values()), len(counts)
    want = [(d, len(ws), sum(counts[w] > 0 for w in ws), n, sum(np.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)) for (d, *_), ws in zip(ODD, tokens)]
    key = lambda r: (str(r[0]), r[1], round(r[4], 3))
    mine = sorted([(r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got], key=key)
    for a, b in zip(mine, sorted(want, key=key)):
        assert a[:4] == b[:4] and abs(a[4] - b[4]) < 1e-6 * max(1, abs(b[4]))
    assert all(np.isfinite(r["score"]) for r in got)
    assert lm_score.score_texts(none, learn).count() == 0
    out = queries.op7_lm_score(spark, SF).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert out[0] > out[1]


def test_sharding(spark, odd, none):
    table = sharding.fill_table([f"s{i}" for i in range(7)], 701)
    assert max(Counter(table).values()) - min(Counter(table).values()) <= 1
    fewer = sharding.fill_table([f"s{i}" for i in range(6)], 701)
    assert sum(a != b for a, b in zip(table, fewer) if a != 6) < 701 * 0.25
    got = sharding.place(odd.withColumnRenamed("score", "Slot"), F.col("doc_id"))
    assert got.count() == len(ODD) and got.columns[-2:] == ["slot", "shard"]
    assert got.groupBy("doc_id").agg(F.countDistinct("shard").alias("n")).where("n > 1").count() == 0
    assert sharding.place(none, F.col("doc_id")).count() == 0
    with pytest.raises(ValueError):
        sharding.fill_table(["a"], 100)


def test_chat_round_trip(spark):
    hard = ["", "%", "%25", "<|", "%3C|", "<|im_end|>", "<|im_end|>\n", "<|im_start|>user\nx<|im_end|>\n", "a\nb", chat_format.HARD_TEXT, "<|im_start:e|>", "é\u0000"]
    rows = [(c, t, role, text) for c, role in enumerate(["user", "assistant", "a\nb", "<|x", "%0A", None]) for t, text in enumerate(hard)]
    rows += [(7, None, "user", None), (7, 1, "assistant", "x"), (7, 1, "assistant", "x"), (None, 1, "assistant", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    got = {r["conv_id"]: r for r in chat_format.format_conversations(df).collect()}
    for c in {r[0] for r in rows}:
        own = sorted([(r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == c])
        assert [(t["role"], t["text"]) for t in got[c]["turns"]] == [r[2:] for r in own]
        assert got[c]["loss_text"] == "".join(r[3] for r in own if r[2] == "assistant")
    assert chat_format.format_digest(df.limit(0)).count() == 0


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, SF)
        path = str(tmp_path / name)
        after.write.parquet(path)
        after = spark.read.parquet(path)
        if name != "best_fit_packing":
            assert after.columns == docs.columns
            assert after.count() <= before.count()
        if name == "ngram_jaccard_join":
            want = components_of([(r["doc_id"], r["text"]) for r in before.select("doc_id", "text").collect()], 5, 80)
            assert sorted(r["doc_id"] for r in after.select("doc_id").collect()) == sorted({c for _, _, c in want})
        before = after
    assert before.count() > 0


def test_jaccard_join_part_of_longer_text(spark):
    """Isolated pairs at the threshold, where one text is all of the other but a passage."""
    rng = np.random.default_rng(12)
    rows = []
    for k in range(600):
        n = int(rng.integers(8, 90))
        words = [f"p{k}x{i}" for i in range(100 * n // 80 + 4)]
        more = (n * 100) // 80 - n  # shingles of the longer text beside those of the shorter one
        cut = 0 if k % 2 else more
        rows += [(2 * k, " ".join(words[: n + more + 4])), (2 * k + 1, " ".join(words[cut : cut + n + 4]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, jaccard_components(df, 5, 80).collect()), key=str) == components_of(rows, 5, 80)
