"""Near-duplicate components by an exact n-gram Jaccard join over token-combination prefixes.

A document is the set of its word n-grams (tokens). All tokens stand in one order, hot ones last. Two sets that
reach the threshold miss at most ``tau = floor((100 - percent) * size / 100)`` tokens of each other, so they must
share more and more of a longer and longer prefix. The prefix of a set is extended until

    (rare tokens) + sum over groups of (frequent tokens of the group - 1)  >=  tau + 1.

Then two similar sets share a rare token or, inside one group, a pair of frequent tokens: rare tokens are indexed
one by one and frequent tokens as pairs. Tokens that no other set has count in the prefix and are not indexed.

Links are looked for until the components are known, not until every pair of a group of copies has been seen:
copies of one set are one node from the start; every bucket of the index compares its members to one hub, which
then leaves it; only pairs of different components are left, and they meet through batches of hubs that grow until
each remaining pair has met. A pair is discarded only when its prefixes prove it too different, and is otherwise
checked on the whole texts. Buckets of one hub are united before that where their union has no more pairs than they
have apart, so texts that meet in very many buckets are compared in one.

Cases: null, empty or blank texts have an empty set, no links, and are their own component. A null doc_id has no
links and a null component. Rows that share a doc_id are one document with several texts, all of one component; a link
of any of them links it. Other columns are ignored, whatever their names. Ties do not occur: labels are minima.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from galleryspark.llm.common import components, discard, membership_bits, present, store
from galleryspark.llm.hashing import U, mix, ngrams, blocks, shingle_sets, words

HOT_SHARE = 4096  # a token in more than 1/4096 of the documents is hot: at most 4096 x the mean set size of them
CHUNK_TOKENS = 1 << 21
GROUP_TOKENS = 4
BATCH_GROWTH = 32
SKETCH = 8  # words of 64 bits


def _tau(size: int, percent: int) -> int:
    return size * (100 - percent) // 100


def _groups(size: int, percent: int) -> int:
    return -(-(_tau(size, percent) + 1) // (GROUP_TOKENS - 1))


def _band(size: np.ndarray, percent: int) -> np.ndarray:
    """Sizes of two linked sets are in the same band or in neighbouring ones."""
    return np.floor(np.log(np.maximum(size, 1)) / np.log(100 / percent) + 1e-9).astype(np.int64)


def _band_groups(band: int, percent: int) -> int:
    """Groups of frequent tokens for comparisons of sets of this band and the one below."""
    return _groups(int(np.exp((band + 1) * np.log(100 / percent))) + 1, percent)


def _local_repeats(n: int):
    """(token, count) of tokens that a run of documents holds at least twice, counted per run of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush():
            tokens, counts = np.unique(np.concatenate(held), return_counts=True)
            often = counts > 1
            return pa.RecordBatch.from_arrays(
                [pa.array(tokens[often].view(np.int64)), pa.array(counts[often].astype(np.int64))], names=["token", "n"]
            )

        for batch in batches:
            for _, _, data, starts in blocks(batch.column(0)):
                hashes, rows, _, _ = words(data, starts)
                grams, owner = ngrams(hashes, rows, n)
                # once per document
                order = np.lexsort((grams, owner))
                grams, owner = grams[order], owner[order]
                new = np.ones(len(grams), bool)
                new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
                held.append(grams[new])
                size += len(held[-1])
                if size >= CHUNK_TOKENS:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    return run


def hot_tokens(docs: DataFrame, n: int) -> np.ndarray:
    """Sorted rows (token, level) of the tokens seen in more than 1/HOT_SHARE of the documents.

    Each token's count is summed over runs of documents that hold it twice, a lower bound of its document
    frequency: it only orders tokens, so any bound gives the same links. The table is bounded by
    HOT_SHARE x (mean set size), not by the number of documents.
    """
    total = max(docs.count(), 1)
    counted = docs.select("text").mapInArrow(_local_repeats(n), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    rows = counted.where(F.col("n") * HOT_SHARE > total).where("n > 2").toArrow()
    tokens = rows["token"].to_numpy().view(U)
    level = np.log2(np.maximum(rows["n"].to_numpy(), 1)).astype(np.uint8)
    order = np.argsort(tokens)
    return np.stack([tokens[order], level[order].astype(U)])


def _kept(size: int, percent: int) -> int:
    """Length of the stored prefix."""
    return min(size, _tau(size, percent) + 1 + _band_groups(int(_band(np.array([size]), percent)[0]) + 1, percent))


@lru_cache(1 << 16)
def _least_met(size: int, percent: int) -> int:
    """So many tokens of a set of this size stand at least in the prefix of any set that it links to, if the other prefix ends first.

    Of the other prefix only what the sets do not share can be missing here; the least is taken over all sizes that can link.
    """
    sizes = np.arange(-(-percent * size // 100), 100 * size // percent + 1)
    needed = -(-percent * (size + sizes) // (100 + percent))
    bands = _band(sizes, percent) + 1
    groups = np.array([_band_groups(int(b), percent) for b in range(int(bands.min()), int(bands.max()) + 1)])[bands - bands.min()]
    kept = np.minimum(sizes, sizes * (100 - percent) // 100 + 1 + groups)
    return max(0, int((kept - (sizes - needed)).min()))


def _order_keys(tokens: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """One integer per token that sorts hot tokens last and others at random."""
    level = np.zeros(len(tokens), U)
    if hot.shape[1]:
        at = np.minimum(np.searchsorted(hot[0], tokens), hot.shape[1] - 1)
        level = np.where(hot[0][at] == tokens, hot[1][at] + U(1), U(0))
    return (level << U(58)) | (mix(tokens) >> U(6))


def _sets(n: int, percent: int, hot):
    """Per document: size, digest of its set, and its stored prefix in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, first, second, prefixes, sketches = [], [], [], [], []
            for _, tokens in shingle_sets(batch.column(1), n):
                size = len(tokens)
                sizes.append(size)
                first.append(np.bitwise_xor.reduce(mix(tokens + U(size))).view(np.int64) if size else 0)
                second.append(int(np.sum(mix(tokens ^ U(0x5851F42D4C957F2D)), dtype=U).view(np.int64)) if size else 0)
                marks = np.zeros(64 * SKETCH, np.uint8)
                marks[mix(tokens ^ U(0xA5A5)) % U(64 * SKETCH)] = 1
                sketches.append(np.packbits(marks).view(np.int64))
                keys = _order_keys(tokens, hot.value)
                prefixes.append(tokens[np.argsort(keys, kind="stable")[: _kept(size, percent)]].view(np.int64) if size > 1 else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.array(first, pa.int64()),
                    pa.array(second, pa.int64()),
                    pa.array(prefixes, pa.list_(pa.int64())),
                    *(pa.array([x[k] for x in sketches], pa.int64()) for k in range(SKETCH)),
                ],
                names=["doc_id", "n_shingles", "d1", "d2", "prefix", *(f"b{k}" for k in range(SKETCH))],
            )

    return run


def _postings(bits):
    """(token, rep, place, size, kept, d1) of prefix tokens that may be in another set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            flat = lists.flatten().to_numpy()
            lengths = np.diff(lists.offsets.to_numpy())
            row = np.repeat(np.arange(len(lists)), lengths)
            place = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            keep = present(bits.value, flat)
            rep, size, kept, d1 = (batch.column(i).to_numpy()[row[keep]] for i in (0, 1, 3, 4))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (flat[keep], rep, place[keep].astype(np.int32), size, kept, d1)],
                names=["token", "rep", "place", "size", "kept", "d1"],
            )

    return run


def _signatures(percent: int, rare_df: int):
    """(signature, band, rep, size, own) of sets from their shared prefix tokens; own: prefix tokens that no linked set has.

    A prefix token that no other prefix has may stand in another set, past the end of its prefix. It is certain to be
    missing there only before that end: all of them are if this prefix ends first, and else those before the token
    that is the least_met-th of this prefix in other prefixes, as so many stand in the other prefix.
    """

    def owned(kept: int, place: list, met: int) -> int:
        if not met:
            return 0
        return kept - len(place) if len(place) < met else place[met - 1] - (met - 1)

    def one(size: int, token: list, place: list, df: list, group) -> Iterator[tuple[int, int, int]]:
        need = _tau(size, percent) + 1
        below = int(_band(np.array([size]), percent)[0])
        for band in (below, below + 1):
            groups = _band_groups(band, percent)
            held: dict[int, list[int]] = {}
            lost = 0  # first frequent tokens of a group cover nothing by themselves
            for t, at, n, g in zip(token, place, df, group):
                if at - lost >= need:  # the tokens before this place cover enough
                    break
                if n <= rare_df:
                    yield t, 0, band
                    continue
                mates = held.setdefault(g % groups, [])
                lost += not mates
                for other in mates:
                    yield (t, other, band) if t < other else (other, t, band)
                mates.append(t)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rep, size, kept = (batch.column(i).to_numpy() for i in range(3))
            items = batch.column(3)
            flat = items.flatten()
            bounds = items.offsets.to_numpy()
            row = np.repeat(np.arange(len(rep)), np.diff(bounds))
            token, place, df = (flat.field(i).to_numpy() for i in range(3))
            order = np.lexsort((place, row))
            group = (mix(token.view(U) + U(1)) >> U(8)).astype(np.int64)[order].tolist()
            token, place, df = token[order].tolist(), place[order].tolist(), df[order].tolist()
            at = bounds - bounds[0]
            own = np.array([owned(int(kept[i]), place[at[i] : at[i + 1]], _least_met(int(size[i]), percent)) for i in range(len(rep))], np.int64)
            first, second, bands, rows = [], [], [], []
            for i in np.flatnonzero(100 * (size - own) >= percent * size).tolist():
                part = slice(at[i], at[i + 1])
                for x, y, band in one(int(size[i]), token[part], place[part], df[part], group[part]):
                    first.append(x)
                    second.append(y)
                    bands.append(band)
                    rows.append(i)
            sig = mix(mix(np.array(first, np.int64).view(U) + U(7)) * U(31) + np.array(second, np.int64).view(U))
            rows = np.array(rows, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (sig.view(np.int64), np.array(bands, np.int32), rep[rows], size[rows], own[rows])],
                names=["sig", "band", "rep", "size", "own"],
            )

    return run


def _may_link(percent: int, hot):
    """Keep pairs whose prefixes leave room for the needed overlap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, nx, ny = (batch.column(i).to_numpy() for i in range(4))
            px, py = batch.column(4), batch.column(5)
            keep = np.zeros(len(x), bool)
            for i in range(len(x)):
                a, b = px[i].values.to_numpy().view(U), py[i].values.to_numpy().view(U)
                need = -(-percent * (int(nx[i]) + int(ny[i])) // (100 + percent))
                ka, kb = _order_keys(a, hot.value), _order_keys(b, hot.value)
                upto = min(ka[-1], kb[-1])
                na, nb = int(np.searchsorted(ka, upto, "right")), int(np.searchsorted(kb, upto, "right"))
                shared = len(np.intersect1d(a[:na], b[:nb], assume_unique=True))
                keep[i] = shared + min(nx[i] - na, ny[i] - nb) >= need
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]), pa.array(y[keep])], names=["x", "y"])

    return run


def _holds(bits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = pa.array(present(bits.value, batch.column("key").to_numpy()))
            yield batch.filter(keep).select(["doc_id", "text"])

    return run


def _linked(n: int, percent: int):
    """Pairs of whole texts whose shingle sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            step, seen = 64, (None, None)  # bounded memory: a few dozen set pairs at a time
            hubs = batch.column(2)
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                others = [s for _, s in shingle_sets(part.column(3), n)]
                for i, other in enumerate(others):
                    text = hubs[lo + i].as_py()
                    if seen[0] != text:
                        seen = (text, next(shingle_sets(pa.array([text], pa.string()), n))[1])
                    shared = len(np.intersect1d(seen[1], other, assume_unique=True))
                    keep[lo + i] = 100 * shared >= percent * (len(seen[1]) + len(other) - shared)
            yield batch.filter(pa.array(keep)).select(["x", "y"])

    return run


def _merged_by_hub(live: DataFrame, band: int) -> DataFrame:
    """Buckets of one hub become a single bucket where this makes no more pairs than they do apart.

    Texts that share long parts meet in thousands of buckets of nearly the same members. All pairs of those buckets
    are pairs of the united one, so no link is lost. ``band`` tells united buckets of different rounds apart.
    """
    hub = ["hub", "hub_own", "hub_size"]
    apart = live.groupBy(*hub).agg(F.sum(F.col("members").cast("double")).alias("apart"))  # sum of squared bucket sizes
    united = live.select(*hub, "rep", "size", "own", "label").distinct()
    united = store(united, "united")
    together = united.groupBy(*hub).agg(F.count(F.lit(1)).alias("together"))
    chosen = store(apart.join(together, hub).where("1D * together * together <= apart").select(*hub, "together"), "chosen")
    merged = united.join(chosen, hub).select(
        F.xxhash64("hub", "hub_size").alias("sig"), F.lit(band).alias("band"), "rep", "size", "own", "label", F.col("together").alias("members"), *hub
    )
    result = store(live.join(chosen, hub, "left_anti").select(*merged.columns).union(merged), "live")
    discard(united, chosen)
    return result


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80, rare_df: int = 3) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id. Links: 100 * shared >= percent * united."""
    spark = docs.sparkSession
    share = spark.sparkContext.broadcast
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    hot = share(hot_tokens(docs, n))
    schema = "doc_id long, n_shingles long, d1 long, d2 long, prefix array<long>" + "".join(f", b{k} long" for k in range(SKETCH))
    sets = store(docs.mapInArrow(_sets(n, percent, hot), schema), "sets")
    one = ["n_shingles", "d1", "d2"]
    sketch = [f"b{k}" for k in range(SKETCH)]
    classes = sets.where("n_shingles > 0 and doc_id is not null").groupBy(*one).agg(F.min("doc_id").alias("rep"))
    classes = store(classes, "classes")
    prefixes = (
        sets.join(classes.withColumn("doc_id", F.col("rep")), [*one, "doc_id"], "left_semi")
        .where("n_shingles > 1")
        .select(F.col("doc_id").alias("rep"), F.col("n_shingles").alias("size"), F.size("prefix").cast("long").alias("kept"), "prefix", "d1", "d2", *sketch)
        .dropDuplicates(["rep", "size", "d1", "d2"])
    )
    prefixes = store(prefixes, "prefixes")

    often = prefixes.select(F.explode("prefix").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    often = store(often, "often")
    bits = share(membership_bits(often, F.col("token")))
    postings = prefixes.select("rep", "size", "prefix", "kept", "d1")
    postings = postings.mapInArrow(_postings(bits), "token long, rep long, place int, size long, kept long, d1 long")
    signatures = (
        postings.join(often, "token")
        .groupBy("rep", "size", "kept", "d1")
        .agg(F.collect_list(F.struct("token", "place", "df")).alias("items"))  # of one set's own prefix
        .select("rep", "size", "kept", "items")
        .mapInArrow(_signatures(percent, rare_df), "sig long, band int, rep long, size long, own long")
    )
    index = store(signatures, "index")
    discard(often)

    several = _several_texts(sets, classes)
    labels = None if several is None else components(several, "low", "rep")
    lo, hi = 0, 1
    live, whole = None, index  # what the next round reads
    # What two linked sets share is at most what neither has alone; that must suffice for the threshold.
    room = lambda a, b: F.least(F.col(f"{a}size") - F.col(f"{a}own"), F.col(f"{b}size") - F.col(f"{b}own"))
    may = lambda a, b: 100 * room(a, b) >= percent * (F.col(f"{a}size") + F.col(f"{b}size") - room(a, b))
    while True:
        if labels is None:
            rows = index.withColumn("label", F.col("rep"))
        else:
            rows = index.join(labels, index.rep == labels.node, "left").select(*index.columns, F.coalesce("label", "rep").alias("label"))
        # The hub of a bucket is the member with the fewest tokens of its own. Buckets of the same members are one.
        buckets = (
            rows.groupBy("sig", "band")
            .agg(
                F.count(F.lit(1)).alias("members"),
                F.min("label").alias("low"),
                F.max("label").alias("high"),
                F.min(F.struct("own", "rep", "size")).alias("h"),
                F.bit_xor(F.xxhash64("rep")).alias("k1"),
                F.sum(F.xxhash64("rep", F.lit(1)).cast("decimal(38,0)")).alias("k2"),
            )
            .where("low <> high")
        )
        if lo:
            buckets = buckets.where(F.col("members") >= lo)
        buckets = buckets.groupBy("members", "k1", "k2").agg(F.min(F.struct("sig", "band", "h")).alias("b"))
        buckets = buckets.select("b.sig", "b.band", "members", F.col("b.h.rep").alias("hub"), F.col("b.h.own").alias("hub_own"), F.col("b.h.size").alias("hub_size"))
        before, live = live, store(rows.join(buckets, ["sig", "band"]), "live")
        discard(before, whole)
        if live.isEmpty():
            discard(live, prefixes)
            break
        if lo <= 1:  # before the first batch of hubs
            apart, live = live, _merged_by_hub(live, -1 - lo)
            discard(apart)
        if lo == 0:
            pairs = live.where((F.col("rep") != F.col("hub")) & may("", "hub_")).select(F.col("hub").alias("x"), F.col("rep").alias("y"))
        else:
            # Each member has a random number; the hubs of a batch are those in an interval of it.
            draw = F.pmod(F.xxhash64("rep", "sig"), F.lit(1 << 32)) / F.lit(float(1 << 32)) * F.col("members")
            drawn = live.join(prefixes.select("rep", *sketch), "rep").withColumn("draw", draw)
            hubs = drawn.where((F.col("draw") < hi) & (F.col("draw") >= lo - 1)).select(
                "sig", "band", *[F.col(c).alias(f"x_{c}") for c in ("rep", "label", "draw", "own", "size", *sketch)]
            )
            met = (F.col("label") != F.col("x_label")) & ((F.col("draw") > F.col("x_draw")) | ((F.col("draw") == F.col("x_draw")) & (F.col("rep") > F.col("x_rep"))))
            # A sketch bit that only one set has stands for at least one token that the other lacks.
            lacks = lambda a, b: sum((F.bit_count(F.col(f"{a}{k}").bitwiseAND(F.bitwise_not(f"{b}{k}"))) for k in sketch), F.lit(0))
            common = F.least(F.col("size") - lacks("", "x_"), F.col("x_size") - lacks("x_", ""))
            near = 100 * common >= percent * (F.col("size") + F.col("x_size") - common)
            pairs = drawn.join(hubs, ["sig", "band"]).where(met & may("", "x_") & near).select(F.col("x_rep").alias("x"), F.col("rep").alias("y"))
        pairs = pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
        found = _links(docs, prefixes, pairs, n, percent, hot)
        united, old = found if labels is None else found.union(labels.selectExpr("node as x", "label as y")), labels
        labels = components(united, "x", "y")
        discard(found, old)
        left = live
        if lo == 0:  # the hub has met all others; what remains of a pair is no bucket any more
            left = live.where((F.col("rep") != F.col("hub")) | (F.col("size") != F.col("hub_size")) | (F.col("own") != F.col("hub_own")))
        index = left.select(*index.columns)
        lo, hi = (1, BATCH_GROWTH) if lo == 0 else (hi + 1, hi * BATCH_GROWTH)
    ends = classes if labels is None else classes.join(labels, classes.rep == labels.node, "left")
    ends = ends.select(*one, (F.col("rep") if labels is None else F.coalesce("label", "rep")).alias("component"))
    rows = sets.select("doc_id", *one).join(ends, one, "left")
    if several is not None:  # an empty text of a document goes where its other texts are
        place = several.join(labels, several.low == labels.node, "left").select("doc_id", F.coalesce("label", "low").alias("common")).distinct()
        rows = rows.join(place, "doc_id", "left").withColumn("component", F.coalesce("common", "component"))
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return rows.select("doc_id", "n_shingles", own.alias("component_id"))


def _several_texts(sets: DataFrame, classes: DataFrame) -> DataFrame | None:
    """(doc_id, low, rep) for documents with texts of several classes: the smallest representative and another; None without any."""
    filled = sets.where("n_shingles > 0 and doc_id is not null")
    again = store(sets.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"), "again")
    if again.isEmpty():
        discard(again)
        return None
    held = filled.join(again, "doc_id").join(classes, ["n_shingles", "d1", "d2"]).select("doc_id", "rep").distinct()
    held = store(held, "held")
    low = held.groupBy("doc_id").agg(F.min("rep").alias("low"))
    return store(held.join(low, "doc_id").select("doc_id", "low", "rep"), "several")


def _links(docs: DataFrame, prefixes: DataFrame, pairs: DataFrame, n: int, percent: int, hot) -> DataFrame:
    """The pairs (x, y) of doc ids that reach the threshold."""
    share = docs.sparkSession.sparkContext.broadcast
    side = lambda name: prefixes.select(F.col("rep").alias(name), F.col("size").alias(f"n{name}"), F.col("prefix").alias(f"p{name}"))
    near = (
        pairs.join(side("x"), "x")
        .join(side("y"), "y")
        .where("100 * least(nx, ny) >= {0} * greatest(nx, ny)".format(percent))
        .select("x", "y", "nx", "ny", "px", "py")
        .mapInArrow(_may_link(percent, hot), "x long, y long")
        .distinct()
    )
    near = store(near, "near")
    ends = near.select(F.explode(F.array("x", "y")).alias("id")).distinct()
    bits = share(membership_bits(ends, F.xxhash64("id")))
    texts = docs.where("doc_id is not null").select("doc_id", "text", F.xxhash64("doc_id").alias("key"))
    texts = texts.mapInArrow(_holds(bits), "doc_id long, text string")
    both = near.join(texts.withColumnsRenamed({"doc_id": "x", "text": "tx"}), "x").join(
        texts.withColumnsRenamed({"doc_id": "y", "text": "ty"}), "y"
    )
    found = both.select("x", "y", "tx", "ty").mapInArrow(_linked(n, percent), "x long, y long").distinct()
    found = store(found, "found")
    discard(near)
    return found
