"""Deletion of repeated runs of lines by winnowing over line hashes (built-in functions only).

A text is cut into lines, and lines after sentence ends, so that long one-line texts have units too; the units
joined again are the text. From every unit on, the shortest run of units that has MIN_RUN_WORDS words is a window, and
so is the shortest one up to every unit. A window depends on nothing but its own units: two texts, or two places of
one text, that share a run of at least MIN_RUN_WORDS words share windows that cover all of it, whatever surrounds the
run, however long its units are and wherever else parts of it stand.

The smallest unit hash of a window is its fingerprint, so equal windows have equal fingerprints, and neighbouring
windows mostly share theirs: a text is stored as stretches of windows of one fingerprint. Fingerprints are counted; only the
stretches of those that occur again are joined, window by window, with the window's first place. A match
extends both ways by the union of the windows that meet, and the units of every window that stands at an earlier place
too are deleted. Each deleted unit equals one at an earlier place, so the first copy of everything stays.

Every window is compared with its first place only, so matches grow with the input and not with the square of a group.

Order is (doc_id, hash of the text, position), null doc_ids first. Cases: null and empty texts stay as they are; rows
equal in doc_id and text are one document and get the same result as often as they occur; surrounding white
space does not count in comparisons; a text that is deleted whole becomes empty, its row stays. Other columns
pass through, no name can clash. The work on a text grows with its length, also where much of it is repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from galleryspark.llm.common import discard, fresh, store

MIN_RUN_WORDS = 30
_CUT = r"(?<=\n)|(?<=[.!?] )"
_ENDS = ("\n", ". ", "! ", "? ")
_SEAM = "\u0001"
_WHITE = " \t\n\x0b\x0c\r"
_PLACES = 1 << 32


def _units(text: Column) -> Column:
    """The units of a text: a mark is set after every end and the text split there, unless it has such a mark of its own."""
    marked = text
    for end in _ENDS:
        marked = F.replace(marked, F.lit(end), F.lit(end + _SEAM))
    cut = F.when(F.contains(text, F.lit(_SEAM)), F.split(text, _CUT)).otherwise(F.split(marked, _SEAM))
    return F.array_remove(cut, "")


def _word_counts(units: Column, text: Column) -> Column:
    """Words of every trimmed unit. In a text with no white space but single spaces and line ends, spaces tell the number."""
    odd = F.contains(text, F.lit("  "))
    for space in "\t\x0b\x0c\r":
        odd = odd | F.contains(text, F.lit(space))
    spaces = lambda u: F.octet_length(u) - F.octet_length(F.replace(u, F.lit(" "), F.lit("")))
    return F.when(odd, F.transform(units, lambda u: F.regexp_count(u, F.lit(r"[^\x20\x09-\x0D]+")))).otherwise(
        F.transform(units, lambda u: F.when(u == "", 0).otherwise(spaces(u) + 1))
    )


def _key(doc_id: str, text: str) -> Column:
    return F.struct(F.col(doc_id).cast("long").alias("d"), F.xxhash64(F.col(text)).alias("t"))


def _start(p: Column) -> Column:
    return F.shiftright(p, 32)


def _end(p: Column) -> Column:
    return p.bitwiseAND(F.lit(_PLACES - 1))


def _own(hashes: str, p: Column) -> Column:
    """The hashes of the units of a place."""
    return F.slice(hashes, (_start(p) + 1).cast("int"), (_end(p) - _start(p)).cast("int"))


def _stretches(units: DataFrame) -> DataFrame:
    """(d, t, f, part, ps, m) of every text of ``units`` (key, h, w): its windows by the order of their places.

    Neighbouring windows of one fingerprint are a stretch: f has its fingerprint, ps the places of its windows, s * _PLACES + e
    for the units [s, e), and part the hashes of the units from the first window's start to the last one's end. m has
    the fingerprints once for each stretch, twice where the unit stands in it twice, so that a window may repeat inside.

    An array that a lambda reads must be a column with several uses, or Spark makes it anew for every element. No
    filter on what is made here may follow: Spark would move it down to the texts and make it once more.
    """
    # For every unit -1, and its number for each of its words: the k-th -1 stands k places after the words before unit k.
    marks = F.flatten(F.transform("w", lambda n, i: F.concat(F.array(F.lit(-1)), F.array_repeat(i, n))))
    units = units.select("key", "h", "w", marks.alias("marks"))
    of_words = F.flatten(F.transform("w", lambda n, i: F.array_repeat(i, n)))
    heads = F.filter(F.transform("marks", lambda x, k: F.when(x < 0, k)), lambda k: k.isNotNull())
    units = units.select("key", "h", of_words.alias("u"), F.concat(heads, F.array(F.size("marks"))).alias("heads"))
    start = lambda i: F.get(F.col("heads"), i) - i  # noqa: E731  the words before unit i
    unit = lambda at: F.get(F.col("u"), at)
    # numbers, since array_distinct compares structs pair by pair
    ahead = F.transform("h", lambda _, i: i * F.lit(_PLACES) + unit(start(i) + (MIN_RUN_WORDS - 1)) + 1)
    back = F.transform("h", lambda _, i: unit(start(i + 1) - MIN_RUN_WORDS) * F.lit(_PLACES) + i + 1)
    places = F.sort_array(F.filter(F.array_distinct(F.concat(ahead, back)), lambda p: p.isNotNull()))
    units = units.select("key", "h", places.alias("places"))
    # Smallest hashes of two and of four units from each one on: two of them cover a window of up to eight units.
    ahead_of = lambda c, n: F.transform(c, lambda x, i: F.least(x, F.get(F.col(c), i + n)))
    units = units.select("key", "h", "places", ahead_of("h", 1).alias("two"))
    units = units.select("key", "h", "places", "two", ahead_of("two", 2).alias("four"))

    def smallest(p: Column) -> Column:
        s, e = _start(p).cast("int"), _end(p).cast("int")
        cover = lambda c, n: F.least(F.get(F.col(c), s), F.get(F.col(c), e - n))
        size = e - s
        return F.when(size > 8, F.array_min(_own("h", p))).when(size >= 4, cover("four", 4)).when(size >= 2, cover("two", 2)).otherwise(cover("h", 1))

    units = units.select("key", "h", "places", F.transform("places", smallest).alias("least"))
    at = lambda i: F.get(F.col("least"), i)
    every = F.when(F.size("least") > 0, F.sequence(F.lit(0), F.size("least") - 1)).otherwise(F.array().cast("array<int>"))
    heads = F.filter(every, lambda i: (i == 0) | (at(i) != at(i - 1)))
    units = units.select("key", "h", "places", "least", heads.alias("heads"))
    ps = F.transform("heads", lambda i, j: F.slice("places", i + 1, F.coalesce(F.get(F.col("heads"), j + 1), F.size("places")) - i))
    units = units.select("key", "h", F.transform("heads", at).alias("f"), ps.alias("ps"))
    part = lambda p: _own("h", _start(F.element_at(p, 1)) * F.lit(_PLACES) + _end(F.element_at(p, -1)))
    units = units.select("key", "f", "ps", F.transform("ps", part).alias("part"))
    twice = F.filter("f", lambda f, j: F.size(F.filter(F.get(F.col("part"), j), lambda x: x == f)) > 1)
    return units.select("key.d", "key.t", "f", "part", "ps", F.concat("f", twice).alias("m"))


def repeated_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, runs): per document the runs [s, e) of unit places that repeat an earlier place."""
    value = F.col(text).cast("string")
    units = docs.where(F.octet_length(value) > 0).select(_key(doc_id, text).alias("key"), value.alias("text"), _units(value).alias("u"))
    units = units.select("key", "text", F.transform("u", lambda u: F.btrim(u, F.lit(_WHITE))).alias("u"))
    units = units.select("key", F.transform("u", lambda u: F.xxhash64(u)).alias("h"), _word_counts(F.col("u"), F.col("text")).alias("w"))
    stretches = store(_stretches(units), "stretches")
    often = stretches.select(F.explode("m").alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("f")
    often = store(often, "often")
    each = stretches.select("d", "t", F.explode(F.arrays_zip("f", "part", "ps")).alias("x")).select("d", "t", "x.*")
    shared = store(each.join(often, "f").select("d", "t", "part", "ps"), "shared")
    discard(stretches, often)
    based = F.transform("ps", lambda p: p - F.lit(_PLACES + 1) * _start(F.element_at("ps", 1)))  # places inside the part
    shared = shared.select("d", "t", "part", "ps", based.alias("based"))
    shared = shared.select("d", "t", "ps", F.transform("based", lambda p: F.xxhash64(_own("part", p))).alias("hs"))
    windows = shared.select("d", "t", F.explode(F.arrays_zip("hs", "ps")).alias("x")).select("d", "t", F.col("x.hs").alias("h"), F.col("x.ps").alias("p"))
    place = F.struct("d", "t", "p")
    first = windows.groupBy("h").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    # Stored, so that both sides of the join are read anew and Spark can split the partition of a frequent window.
    later = windows.join(store(first, "first"), "h").where(place > F.col("first"))
    key = F.struct("d", "t").alias("key")
    # Windows in the order of their starts are in the order of their ends too: a run ends where the next window starts later.
    found = later.groupBy(key).agg(F.sort_array(F.collect_set("p")).alias("all"))
    at = lambda k: F.get(F.col("all"), k)
    heads = F.filter(F.sequence(F.lit(0), F.size("all") - 1), lambda k: (k == 0) | (_start(at(k)) > _end(at(k - 1))))
    found = found.select("key", "all", heads.alias("heads"))
    run = lambda k, j: F.struct(_start(at(k)).alias("s"), _end(at(F.coalesce(F.get(F.col("heads"), j + 1), F.size("all")) - 1)).alias("e"))
    return found.select("key", F.transform("heads", run).alias("runs"))


def drop_repeated_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", removed: str | None = None) -> DataFrame:
    """``docs`` with repeated runs deleted from ``text``; ``removed`` names a column for the number of deleted units."""
    key, runs, units, rest = (fresh(docs, x) for x in ("_key", "_runs", "_units", "_rest"))
    found = repeated_runs(docs, doc_id, text).withColumnsRenamed({"key": key, "runs": runs})
    joined = docs.withColumn(key, _key(doc_id, text)).join(found, key, "left")
    joined = joined.withColumn(units, F.when(F.col(runs).isNotNull(), _units(F.col(text).cast("string"))))
    # what stands before every run, and after the last one
    end = lambda k: F.coalesce(F.get(F.col(runs), k)["e"], F.lit(0))
    gaps = F.transform(runs, lambda r, k: F.slice(F.col(units), (end(k - 1) + 1).cast("int"), (r["s"] - end(k - 1)).cast("int")))
    last = F.element_at(F.col(runs), -1)["e"]
    tail = F.slice(F.col(units), (last + 1).cast("int"), (F.size(units) - last).cast("int"))
    joined = joined.withColumn(rest, F.concat(F.flatten(gaps), tail))
    new_text = F.when(F.col(runs).isNull(), F.col(text)).otherwise(F.array_join(rest, ""))
    columns = [new_text.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns]
    if removed:
        count = F.when(F.col(runs).isNull(), 0).otherwise(F.size(units) - F.size(rest))
        columns.append(count.cast("long").alias(removed))
    return joined.select(*columns)
