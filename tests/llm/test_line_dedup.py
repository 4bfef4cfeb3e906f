"""Line dedup against a comparison of every unit with all earlier places of all texts."""

import re

import numpy as np
from pyspark.sql import functions as F

from galleryspark.llm.line_dedup import MIN_RUN_WORDS, drop_repeated_runs

WHITE = " \t\n\x0b\x0c\r"


def brute(keys):
    """New texts of the documents ``keys`` (doc_id, text), in their order: a unit goes if it lies in a run that equals an
    earlier one, of MIN_RUN_WORDS words or more."""
    units = [[u for u in re.split(r"(?<=\n)|(?<=[.!?] )", t) if u] for _, t in keys]
    bare = [[u.strip(WHITE) for u in us] for us in units]
    words = [[len(re.findall(r"[^\x20\x09-\x0D]+", u)) for u in us] for us in units]
    place, gone = {}, set()
    for d, us in enumerate(bare):
        for i, u in enumerate(us):
            for e, j in place.get(u, []):
                if i and j and us[i - 1] == bare[e][j - 1]:
                    continue  # part of a longer run that was seen from its start
                n = 0
                while i + n < len(us) and j + n < len(bare[e]) and us[i + n] == bare[e][j + n]:
                    n += 1
                if sum(words[d][i : i + n]) >= MIN_RUN_WORDS:
                    gone.update((d, i + k) for k in range(n))
            place.setdefault(u, []).append((d, i))
    return {k: "".join(u for i, u in enumerate(us) if (d, i) not in gone) for d, (k, us) in enumerate(zip(keys, units))}


def check(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string, runs int")
    got = drop_repeated_runs(docs, removed="n")
    assert got.columns == ["doc_id", "text", "key", "runs", "n"]
    texts = [(t,) for t in {t for _, t, _, _ in rows if t}]
    hashed = dict(spark.createDataFrame(texts or [("",)], "p string").select("p", F.xxhash64("p")).collect())
    keys = sorted({(-(1 << 63) if d is None else d, t) for d, t, _, _ in rows if t}, key=lambda k: (k[0], hashed[k[1]]))
    want = brute(keys)
    expect = sorted([(d, want[(-(1 << 63) if d is None else d, t)] if t else t) for d, t, _, _ in rows], key=str)
    assert sorted([(r["doc_id"], r["text"]) for r in got.collect()], key=str) == expect
    return {(d, t) for d, t in expect}


def sentence(k, n=8):
    return " ".join(f"w{k}x{i}" for i in range(n)) + "."


def test_passages_copies_and_odd_rows(spark):
    passage = " ".join(sentence(100 + i) for i in range(7))
    rows = [
        (1, "Alpha beta gamma delta. " + passage + "\nown line one here.", None, 0),
        (2, "Other words stand first. " + passage + " And then more of it follows.", "k", None),
        (3, None, None, None),
        (4, "", None, None),
        (5, " \n \n", None, None),
        (None, "A text without id. " + passage, None, None),
        (None, "A text without id. " + passage, None, None),
        (6, "\n".join([sentence(7, 12)] * 40), None, None),
        (7, "\n".join([sentence(8, 5), sentence(9, 6)] * 9), None, None),
        (8, sentence(3) + " " + sentence(4), None, None),
        (9, sentence(3) + " " + sentence(4), None, None),
        (9, "same id, another text. " + passage, None, None),
    ]
    got = check(spark, rows)
    assert (2, "Other words stand first. And then more of it follows.") in got  # the first copy has a null id
    assert (1, "Alpha beta gamma delta. \nown line one here.") in got or any(d == 1 and "w100x0" not in t for d, t in got if t)
    assert (9, sentence(3) + " " + sentence(4)) in got  # 16 words are too few


def test_empty(spark):
    check(spark, [])


def test_whole_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    check(spark, [(r["doc_id"], r["text"], None, None) for r in docs])


def without_repeats(spark, texts):
    """New texts by doc_id, held against a comparison with all earlier places of all texts."""
    got = drop_repeated_runs(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    got = {r["doc_id"]: r["text"] for r in got.collect()}
    want = brute(list(enumerate(texts)))
    assert got == {d: want[(d, t)] if t else t for d, t in enumerate(texts)}
    return got


def test_white_space_and_marks(spark):
    """Units between odd white space, and texts that hold the mark that is used for cutting."""
    words = " ".join(f"q{i}" for i in range(35))
    spaced = "  ".join(f"q{i}" for i in range(35))
    tabbed = "\t".join(f"q{i}" for i in range(35))
    got = without_repeats(spark, [words + ".\n", "\x01 first. " + words + ".\x0b\nlast", spaced + "\n\n", "a. " + spaced + " \r\n b", tabbed, tabbed + "\n" + words + "."])
    assert got[1] == "\x01 first. last" and got[3] == "a.  b" and got[5] == ""


def test_very_long_text(spark):
    """A long text of repeated and own lines in turn, most of it repeated."""
    line = lambda k: " ".join(f"k{k}w{i}" for i in range(12)) + "\n"
    shared = [line(i) for i in range(4)]
    parts = []
    for k in range(4000):
        parts += [line(10 + k), *shared]
    got = without_repeats(spark, ["".join(shared) + "end\n", "".join(parts), "x " * 120_000 + "\n" + "".join(shared)])
    assert got[1] == "".join(line(10 + k) for k in range(4000)) and got[2] == "x " * 120_000 + "\n"


def test_short_units(spark):
    """Passages of units of one to three words, and of lines and blank lines in turn."""
    verse = "".join(f"v{i} x\n" for i in range(40))
    shout = "".join(f"s{i}!! " for i in range(60))
    table = "".join(f"t{i}\n\n" for i in range(35))
    got = without_repeats(
        spark,
        ["First own line of text\n" + verse + shout, "Another line stands here\n" + verse + "End of it\n", "Third text, " + "so. " + shout + "end", table, "x\n" + table + "y"],
    )
    assert got[1] == "Another line stands here\nEnd of it\n" and got[2] == "Third text, so. end" and got[4] == "x\ny"


def test_parts_stand_alone_before(spark):
    """Every unit of a shared passage stands alone in an earlier text too, or earlier in the same one; and random mixtures."""
    passage = [sentence(300 + i) + " " for i in range(6)]
    alone = [f"Before number {i} there is this. {u}And after number {i} that." for i, u in enumerate(passage)]
    got = without_repeats(spark, alone + ["A first copy. " + "".join(passage) + "Its end.", passage[2] + "A second copy. " + "".join(passage) + "Another end."])
    assert got[7] == passage[2] + "A second copy. Another end."
    rng = np.random.default_rng(3)
    some = [sentence(400 + i, int(n)) + " " for i, n in enumerate(rng.integers(1, 25, 12))] + ["\n"]
    without_repeats(spark, ["".join(some[int(k)] for k in rng.integers(0, 13, rng.integers(1, 40))) for _ in range(60)])


def test_one_or_two_units(spark):
    """One long unit, or two, between other neighbours in every text."""
    for shared in (sentence(500, 55) + " ", sentence(501, 28) + " " + sentence(502, 27) + " "):
        own = [[sentence(1000 + 10 * d + i) + " " for i in range(6)] for d in range(12)]
        got = without_repeats(spark, ["".join(o[:3]) + shared + "".join(o[3:]) for o in own])
        assert all(got[d] == "".join(o) for d, o in enumerate(own) if d)
