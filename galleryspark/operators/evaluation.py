"""Leave-one-out ranking metrics and pair-score distributions.

Only average precision needs a whole ranking; precision@k needs a top-k list and the class
similarity means follow from class sums, so they never touch a pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from galleryspark.functions import vectors as V
from galleryspark.operators import blocks
from galleryspark.operators.knn import knn
from galleryspark.operators.quantiles import exact_quantiles
from galleryspark.session import cut_lineage

AP_CELL_ROWS = 131_072  # galleries up to this size (and CELL_BYTES) are ranked inside one cell
AP_BINS = 256  # score bins that are counted per query and block
THRESHOLDS = 6_000_000  # relevant scores that a group of queries may hold
HELD_KEYS = 16_000_000  # rank keys that a group of queries may hold (128 MB)
PIECE_SCORES = 1 << 17  # scores of a piece (1 MB)
PLACE_BITS = 22  # a rank key holds the score (in steps of 1e-12, falling) and below it the place in id order
KEY_ROOM = 1 << 20  # a cosine may exceed 1 by rounding
KEY_STEPS = 10**12  # scores have 12 decimals
OWN_LEVEL = 2 * KEY_STEPS + 2 * KEY_ROOM  # beyond the lowest score


def precision_at_k(df: DataFrame, ks: Sequence[int], **names) -> DataFrame:
    """Mean over items of matches in the first k (clamped to N - 1) divided by k: one column per k."""
    lists, n = _top_lists(df, max(ks), **names)
    clamped = {k: min(k, n - 1) for k in ks}
    per_item = lists.groupBy("query_id").agg(
        *[F.sum(F.when(F.col("rank") <= kk, F.col("match")).otherwise(0)).alias(f"m{k}") for k, kk in clamped.items()]
    )
    return per_item.agg(*[F.avg(F.col(f"m{k}") / F.lit(float(kk))).alias(f"top{k}_precision") for k, kk in clamped.items()])


def _top_lists(df, k, id_col="vec_id", vector="embedding", label="label", queries=None):
    items = df.select(F.col(id_col).alias("id"), F.col(vector).alias("v"), F.col(label).alias("label"))
    asked = items if queries is None else items.where(queries)
    n = items.count()
    lists = knn(asked.withColumnRenamed("id", "query_id"), items, min(k, n - 1), metric="cosine", exclude_self=True, vector="v")
    labelled = lists.join(items.select("id", F.col("label").alias("found")), "id").join(
        items.select(F.col("id").alias("query_id"), F.col("label").alias("asked")), "query_id"
    )
    return labelled.withColumn("match", (F.col("found") == F.col("asked")).cast("int")), n


def average_precision(
    df: DataFrame,
    id_col: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    queries: Column | None = None,
    cell_rows: int = AP_CELL_ROWS,
) -> DataFrame:
    """(id, label, ap) for every query; the whole rest of the table is its gallery.

    AP is the sum of precision at each relevant rank over the number of relevant items, 0 where a
    class has one member. Equal scores are ranked by id.
    """
    return item_ranking(df, (), id_col, vector, label, queries, cell_rows)


def item_ranking(
    df: DataFrame,
    ks: Sequence[int] = (),
    id_col: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    queries: Column | None = None,
    cell_rows: int = AP_CELL_ROWS,
) -> DataFrame:
    """(id, label, ap, m<k>...): average precision and the matches among the first k, for every query.

    A gallery of one cell is ranked there. Beyond, bins of scores are counted piece by piece and only mixed bins are
    refined; both give the same rows.
    """
    items = df.select(F.col(id_col).alias("id"), blocks.stored(df, vector).alias("v"), F.col(label).alias("label"))
    asked = (items if queries is None else items.where(queries)).select(
        F.col("id").alias("query_id"), F.col("v").alias("qv"), F.col("label").alias("asked")
    )
    id_type = dict(items.dtypes)["id"]
    room, n = blocks.cell_rows_for(items, "v", AP_CELL_ROWS), items.count()
    cell_rows = min(cell_rows, room)
    if n <= cell_rows:
        sums = _whole_ranking(asked, items, id_type, cell_rows, n, ks)
    else:
        sums = _block_ranking(asked, items, id_type, cell_rows, n, ks)
    ap = F.when(F.coalesce("relevant", F.lit(0)) > 0, F.col("gain") / F.col("relevant")).otherwise(F.lit(0.0))
    matches = [F.coalesce(f"m{k}", F.lit(0)).alias(f"m{k}") for k in ks]
    return asked.join(sums, "query_id", "left").select(
        F.col("query_id").alias("id"), F.col("asked").alias("label"), ap.alias("ap"), *matches
    )


def _cosines(qv: np.ndarray, gv: np.ndarray) -> np.ndarray:
    return np.round(blocks.unit_rows(qv) @ blocks.unit_rows(gv).T, blocks.TIE_DECIMALS)


def _whole_ranking(asked, items, id_type, cell_rows, n, ks):
    names = ["query_id", "gain", "relevant", *[f"m{k}" for k in ks]]

    def kernel(lpdf: pd.DataFrame, rpdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        if not lpdf.empty and not rpdf.empty:
            gallery = rpdf.sort_values("id", kind="stable")
            ids, labels, gv = gallery["id"].to_numpy(), gallery["label"].to_numpy(), blocks.unit_rows(blocks.matrix(gallery["v"]))
            qid, asked_label, qv = lpdf["query_id"].to_numpy(), lpdf["asked"].to_numpy(), blocks.unit_rows(blocks.matrix(lpdf["qv"]))
            codes, _ = pd.factorize(asked_label)
            same = {}  # places of the rows of a label
            for part in blocks.slices(len(qv), len(gv)):
                keys = _rank_keys(_score_steps(qv[part], gv), np.arange(len(gv)))
                own = np.nonzero(qid[part][:, None] == ids[None, :])
                keys[own] = (OWN_LEVEL << PLACE_BITS) + own[1]  # the item itself goes last
                sums = np.zeros((len(keys), len(names) - 1))
                for i, line in enumerate(keys):
                    at = part.start + i
                    if codes[at] not in same:
                        same[codes[at]] = np.flatnonzero(labels == asked_label[at : at + 1])
                    wanted = np.sort(line[same[codes[at]]])
                    line.sort()
                    place = np.searchsorted(line, wanted)
                    place = place[place < len(line) - 1]
                    gain = (np.arange(1, len(place) + 1) / (place + 1)).sum()
                    sums[i] = [gain, len(place), *[(place < k).sum() for k in ks]]
                counts = [c.astype(np.int64) for c in sums.T[1:]]
                out.append(pd.DataFrame(dict(zip(names, [qid[part], sums[:, 0], *counts]))))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame(columns=names)

    schema = f"query_id {id_type}, gain double, relevant long" + "".join(f", m{k} long" for k in ks)
    return blocks.grid(asked, items, ["query_id"], ["id"], kernel, schema, cell_rows, 1024, n_right=n)


def _score_steps(unit: np.ndarray, gallery: np.ndarray) -> np.ndarray:
    """Cosines of unit rows in whole steps of 1e-12."""
    steps = unit @ gallery.T
    steps *= KEY_STEPS
    return np.rint(steps, out=steps)


def _levels(steps: np.ndarray) -> np.ndarray:
    """Levels that rise as the score falls, in place; scores that are no number come last."""
    np.subtract(KEY_STEPS + KEY_ROOM, steps, out=steps)
    if np.isnan(steps.min()):
        steps[np.isnan(steps)] = OWN_LEVEL + 1
    return steps


def _rank_keys(steps: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Keys that rise with the level and, where scores agree, with the place in id order."""
    keys = _levels(steps).astype(np.int64)
    keys <<= PLACE_BITS
    keys += places
    return keys


def _bins(level: np.ndarray) -> np.ndarray:
    """Bin of a level, in place and not yet cut to whole numbers; a smaller bin holds larger scores, equal scores share one."""
    level -= KEY_ROOM
    level /= 2 * KEY_STEPS // AP_BINS
    return np.clip(level, 0, AP_BINS - 1, out=level)


def _key_bins(keys: np.ndarray) -> np.ndarray:
    return _bins((keys >> PLACE_BITS).astype(np.float64)).astype(np.int64)


def _block_ranking(asked, items, id_type, cell_rows, n, ks) -> DataFrame:
    """(query_id, gain, relevant, m<k>...) over a gallery of many blocks.

    A task keeps the gallery in a local file, in id order, and a group of queries reads it in pieces of at most ``cell_rows``. The
    scores are counted in AP_BINS bins, which add up over the pieces; a bin of relevant items only needs no more, its ranks follow
    from the counts before it. The relevant items of mixed bins are then placed among the keys of all items. Only sums leave a task.
    A group holds HELD_KEYS keys and THRESHOLDS relevant ones at most (4 queries at least).
    """
    if n >= 1 << PLACE_BITS:
        raise ValueError(f"a gallery of {1 << PLACE_BITS} items or more cannot be ranked whole")
    most = items.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first().n or 1
    rows = max(4, min(1024, THRESHOLDS // most, HELD_KEYS // n))

    def rank(parts: list[pa.RecordBatch], gallery: blocks.Kept) -> Iterator[pa.RecordBatch]:
        held = _QueryBlock(ks, cell_rows, parts, gallery.room(n * sum(part.num_rows for part in parts)))
        for batch in gallery.batches():
            held.add(batch)
        yield held.sums()

    queries = asked.select(F.col("query_id").alias("id"), F.col("qv").alias("v"), F.col("asked").alias("label"))
    schema = f"query_id {id_type}, gain double, relevant long" + "".join(f", m{k} long" for k in ks)
    return blocks.against_all(queries, items, asked.count(), rows, rank, schema)


class _QueryBlock:
    """A group of queries while the gallery passes; ``keys`` has room for all of theirs."""

    OWN = np.iinfo(np.int64).max  # key of the item itself

    def __init__(self, ks: Sequence[int], cell_rows: int, parts: list[pa.RecordBatch], keys: np.ndarray):
        column = lambda name: np.concatenate([p.column(name).to_pandas().to_numpy() for p in parts])
        self.ks, self.query_ids, self.ids, self.labels = ks, pa.concat_arrays([p.column("id") for p in parts]), column("id"), column("label")
        self.unit = blocks.unit_rows(np.concatenate([blocks.vectors(p.column("v")) for p in parts]))
        self.step = max(1, min(cell_rows, PIECE_SCORES // len(self.ids)))
        self.every = np.zeros((len(self.ids), AP_BINS), np.int64)
        self.keys, self.found = keys.reshape(len(self.ids), -1), []  # found: the labels of the items, batch by batch
        self.at, self.place, self.last = 0, 0, None

    def add(self, batch: pa.RecordBatch) -> None:
        ids, labels = (batch.column(name).to_pandas().to_numpy() for name in ("id", "label"))
        places = self.place + np.cumsum(np.concatenate(([ids[0] != self.last], ids[1:] != ids[:-1])))  # rows of one id share one
        self.place, self.last = int(places[-1]), ids[-1]
        self.found.append(labels)
        keys = self.keys[:, self.at : self.at + len(ids)]
        for start in range(0, len(ids), self.step):
            piece = slice(start, start + self.step)
            unit = blocks.unit_rows(blocks.vectors(batch.column("v").slice(start, self.step)))
            self._count(_levels(_score_steps(self.unit, unit)), places[piece], keys[:, piece])
        near = np.flatnonzero(np.isin(ids, self.ids))
        row, col = np.nonzero(self.ids[:, None] == ids[None, near])
        own = row, near[col]
        np.subtract.at(self.every, (row, _key_bins(keys[own])), 1)
        keys[own] = self.OWN
        self.at += len(ids)

    def _count(self, level: np.ndarray, places: np.ndarray, keys: np.ndarray) -> None:
        np.copyto(keys, level, casting="unsafe")
        keys <<= PLACE_BITS
        keys += places
        spot = _bins(level).astype(np.int64)
        spot += AP_BINS * np.arange(len(keys))[:, None]
        self.every += np.bincount(spot.ravel(), minlength=self.every.size).reshape(self.every.shape)

    def _relevant(self) -> list[np.ndarray]:
        """The keys of the relevant items of each query, in rank order."""
        labels, (codes, _), places, out = np.concatenate(self.found), pd.factorize(self.labels), {}, []
        for i, code in enumerate(codes):
            if code not in places:
                places[code] = np.flatnonzero(labels == self.labels[i : i + 1])
            keys = np.sort(self.keys[i].take(places[code]))
            out.append(keys[: np.searchsorted(keys, self.OWN)])
        return out

    def sums(self) -> pa.RecordBatch:
        """Precision at the ranks of the relevant items, summed per query, their number, and those among the first k."""
        relevant = self._relevant()
        self.same = np.array([np.bincount(_key_bins(keys), minlength=AP_BINS) for keys in relevant])
        before, before_same = (np.cumsum(c, axis=1) - c for c in (self.every, self.same))
        # Rows of one query id are one query; its counts add up.
        _, one, same_id, copies = np.unique(self.ids, return_index=True, return_inverse=True, return_counts=True)
        for c in (self.every, self.same):
            total = np.zeros((len(copies), AP_BINS), np.int64)
            np.add.at(total, same_id, c)
            c[:] = total[same_id]
        gain = self._pure_gain()
        matches = np.zeros((len(self.ks), len(self.ids)), np.int64)
        for i, (keys, n) in enumerate(zip(relevant, copies[same_id])):
            bins, place = _key_bins(keys), np.arange(len(keys))
            fresh = np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]))
            mixed = (self.same[i] < self.every[i])[bins]
            rank = before[i, bins] + place - before_same[i, bins]
            rank[mixed] = self._refined(i, keys[mixed])
            index = np.maximum.accumulate(np.where(fresh, place, 0))[mixed]
            gain[i] += ((n * index + 1) / (n * rank[mixed] + 1)).sum()
            for number, k in enumerate(self.ks):
                matches[number, i] = (rank < k).sum()
        values = [v[one] for v in (gain, self.same.sum(axis=1), *matches)]
        names = ["query_id", "gain", "relevant", *(f"m{k}" for k in self.ks)]
        return pa.RecordBatch.from_arrays([self.query_ids.take(pa.array(one)), *map(pa.array, values)], names=names)

    def _pure_gain(self) -> np.ndarray:
        """Precision at the ranks of bins that hold relevant items only, summed per query."""
        before, before_same = (np.cumsum(c, axis=1) - c for c in (self.every, self.same))
        row, col = np.nonzero((self.same > 0) & (self.same == self.every))
        n = self.same[row, col]
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + 1
        at = np.repeat(row, n), np.repeat(col, n)
        gain = np.bincount(at[0], (before_same[at] + place) / (before[at] + place), minlength=len(self.ids))
        return gain.astype(np.float64)  # of no ranks it is made of integers

    def _refined(self, i: int, sought: np.ndarray) -> np.ndarray:
        """How many items of query ``i`` lie before each sought one."""
        self.keys[i].sort()
        return np.searchsorted(self.keys[i], sought)


def macro_map(ap: DataFrame) -> DataFrame:
    """Mean within each class, then across classes."""
    return ap.groupBy("label").agg(F.avg("ap").alias("class_ap")).agg(F.avg("class_ap").alias("macro_map"))


def class_sums(df: DataFrame, vector: str = "embedding", label: str = "label") -> DataFrame:
    """Per class: n, all_n (items of all classes), self_sq (sum of squared norms), own (|s_c|^2) and cross
    (s_c . S) of unit vectors."""
    unit = df.select(F.col(label).alias("label"), F.posexplode(V.l2_normalize(F.col(vector))).alias("pos", "x"))
    per_dim = unit.groupBy("label", "pos").agg(
        F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("sq"), F.count(F.lit(1)).alias("n")
    )
    totals = per_dim.groupBy("pos").agg(F.sum("s").alias("t"), F.sum("n").alias("all_n"))
    # One row per vector dimension: bounded whatever the table size.
    return per_dim.join(F.broadcast(totals), "pos").groupBy("label").agg(
        F.max("n").alias("n"),
        F.max("all_n").alias("all_n"),
        F.sum("sq").alias("self_sq"),
        F.sum(F.col("s") * F.col("s")).alias("own"),
        F.sum(F.col("s") * F.col("t")).alias("cross"),
    )


def class_margin(df: DataFrame, vector: str = "embedding", label: str = "label") -> DataFrame:
    """Per-item dialect: each item's mean similarity to its class (0 if alone) and to the other
    classes (0 if none), averaged over the items; margin is the difference."""
    sums = class_sums(df, vector, label)
    n = F.col("n")
    rest = F.col("all_n") - n
    intra = F.when(n > 1, (F.col("own") - F.col("self_sq")) / (n - 1)).otherwise(F.lit(0.0))
    inter = F.when(rest > 0, (F.col("cross") - F.col("own")) / rest).otherwise(F.lit(0.0))
    totals = sums.agg(F.sum(intra).alias("a"), F.sum(inter).alias("b"), F.sum("n").alias("n"))
    iacs, other = F.col("a") / F.col("n"), F.col("b") / F.col("n")
    return totals.select(iacs.alias("iacs"), other.alias("inter"), (iacs - other).alias("margin"))


def pair_margin(df: DataFrame, vector: str = "embedding", label: str = "label") -> DataFrame:
    """Pair-level dialect: means over ordered same-class pairs and over cross-class pairs."""
    totals = class_sums(df, vector, label).agg(
        F.sum(F.col("own") - F.col("self_sq")).alias("same"),
        F.sum(F.col("n") * (F.col("n") - 1)).alias("same_n"),
        F.sum(F.col("cross") - F.col("own")).alias("other"),
        (F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))).alias("other_n"),
    )
    iacs = F.when(F.col("same_n") > 0, F.col("same") / F.col("same_n")).otherwise(F.lit(0.0))
    inter = F.when(F.col("other_n") > 0, F.col("other") / F.col("other_n")).otherwise(F.lit(0.0))
    return totals.select(iacs.alias("iacs"), inter.alias("inter"), (iacs - inter).alias("margin"))


def group_metrics(df: DataFrame, n_groups: int = 50, id_col: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """Grouped evaluation: queries are the items with label >= 0, distractors (-1) stay in the
    gallery; macro mAP divides by a fixed number of groups; top1 and top5 are hit rates."""
    per_item = item_ranking(df, (1, 5), id_col, vector, label, F.col("label") >= 0)
    classes = per_item.groupBy("label").agg(
        F.avg("ap").alias("class_ap"),
        F.count(F.lit(1)).alias("n"),
        F.sum((F.col("m1") > 0).cast("bigint")).alias("h1"),
        F.sum((F.col("m5") > 0).cast("bigint")).alias("h5"),
    )
    in_range = F.when(F.col("label") < n_groups, F.col("class_ap"))
    rates = classes.agg(
        (F.coalesce(F.sum(in_range), F.lit(0.0)) / F.lit(float(n_groups))).alias("macro_map"),
        F.coalesce(F.sum("h1") / F.sum("n"), F.lit(0.0)).alias("top1_accuracy"),
        F.coalesce(F.sum("h5") / F.sum("n"), F.lit(0.0)).alias("top5_accuracy"),
    )
    return _side_by_side(rates, pair_margin(df.where(F.col(label) >= 0), vector, label))


def _side_by_side(*one_row: DataFrame) -> DataFrame:
    """Join aggregates of one row each."""
    keyed = [frame.withColumn("_one", F.lit(1)) for frame in one_row]
    joined = keyed[0]
    for frame in keyed[1:]:
        joined = joined.join(frame, "_one")
    return joined.drop("_one")


def loo_metrics(df: DataFrame, ks: Sequence[int] = (1, 5, 10), **names) -> DataFrame:
    """The per-item dialect in one row: macro mAP, IACS, inter, margin and precision at each k."""
    per_item = item_ranking(df, ks, **names)
    sums = [F.sum(f"m{k}").alias(f"m{k}") for k in ks]
    classes = per_item.groupBy("label").agg(F.avg("ap").alias("class_ap"), F.count(F.lit(1)).alias("n"), *sums)
    total = F.sum("n")
    rates = [(F.sum(f"m{k}") / total / F.least(F.lit(k), total - 1)).alias(f"top{k}_precision") for k in ks]
    ranking = classes.agg(F.avg("class_ap").alias("macro_map"), *rates)
    return _side_by_side(ranking, class_margin(df, names.get("vector", "embedding"), names.get("label", "label")))


# --- pair scores -----------------------------------------------------------------------------

EXPORT_ROWS = 1_024  # side of a cell whose pairs are returned
QUARTILES = (0.25, 0.5, 0.75)
FINE = 1 << 16  # equal parts of [-1, 1] in which scores are counted; one more holds those that rounding lifts to 1 and above
SCORE_TILE = (128, 512)  # scores that a core works on at once (512 KB)
PART_BITS = 12  # a part holds 2**25 steps of a score; they are counted in groups of 2**12, then singly

# Modulus and factors of the pair order used for sampling.
PAIR_PRIME = 2_147_483_647
PAIR_Q, PAIR_G, PAIR_MIX = 48_271, 69_621, 40_692


def _pair_order(q: np.ndarray, g: np.ndarray, seed: int) -> np.ndarray:
    x = (q % PAIR_PRIME * PAIR_Q + g % PAIR_PRIME * PAIR_G + seed) % PAIR_PRIME
    return (x * x + x * PAIR_MIX) % PAIR_PRIME


def export_pair_scores(
    df: DataFrame,
    max_fp: int | None = None,
    seed: int = 42,
    id_col: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    min_score: float | None = None,
) -> DataFrame:
    """(query_id, id, similarity, is_tp): all ordered pairs of different items.

    With ``min_score`` only pairs of at least that similarity leave their cell; ``pair_score_counts`` tells
    how many lie below. With ``max_fp`` the cross-class pairs are a sample, those that come first in a pseudo-random order, and a
    cell returns no more of them than the sample can use. Cells have sides of EXPORT_ROWS at most; a task keeps the gallery and returns
    the pairs of one cell after the other, so that the gallery is not sent to each of them.
    """
    items = df.select(F.col(id_col).cast("long").alias("id"), blocks.stored(df, vector).alias("v"), F.col(label).alias("label"))

    def all_pairs(qid, asked, qv, ids, labels, gv):
        value = _cosines(qv, gv)
        row, col = np.nonzero((qid[:, None] != ids[None, :]) & (value >= floor))
        return _pairs(qid[row], ids[col], value[row, col], asked[row] == labels[col], -1)

    def same_class(qid, asked, qv, ids, labels, gv):
        value = _cosines(qv, gv)
        row, col = np.nonzero((asked[:, None] == labels[None, :]) & (qid[:, None] != ids[None, :]) & (value >= floor))
        return _pairs(qid[row], ids[col], value[row, col], True, -1)

    def cross_class(qid, asked, qv, ids, labels, gv):
        value = _cosines(qv, gv)
        row, col = np.nonzero((asked[:, None] != labels[None, :]) & (value >= floor))
        order = _pair_order(qid[row], ids[col], seed)
        if len(order) > max_fp:  # keep the max_fp smallest, with every tie of the last
            keep = order <= np.partition(order, max_fp - 1)[max_fp - 1]
            row, col, order = row[keep], col[keep], order[keep]
        return _pairs(qid[row], ids[col], value[row, col], False, order)

    def of(pick):
        def work(parts: list[pa.RecordBatch], gallery: blocks.Kept) -> Iterator[pa.RecordBatch]:
            for part in parts:
                qid, asked, qv = side(part)
                for batch in gallery.batches():
                    for start in range(0, batch.num_rows, rows):
                        ids, labels, gv = side(batch.slice(start, rows))
                        for p in blocks.slices(len(qv), len(gv)):
                            yield pa.RecordBatch.from_pandas(pick(qid[p], asked[p], qv[p], ids, labels, gv), returned, preserve_index=False)

        return blocks.against_all(items, items, n, rows, work, "query_id long, id long, similarity double, is_tp boolean, ord long")

    def side(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids, labels = (batch.column(name).to_pandas().to_numpy() for name in ("id", "label"))
        return ids, labels, blocks.vectors(batch.column("v"))

    returned = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("similarity", pa.float64()), ("is_tp", pa.bool_()), ("ord", pa.int64())])
    n, rows = items.count(), min(EXPORT_ROWS, blocks.cell_rows_for(items, "v"))
    floor = -math.inf if min_score is None else min_score
    if max_fp is None:
        return of(all_pairs).drop("ord")
    sampled = of(cross_class).orderBy("ord", "query_id", "id").limit(max_fp)
    return of(same_class).unionByName(sampled).drop("ord")


def _pairs(q, g, similarity, is_tp, order):
    return pd.DataFrame({"query_id": q, "id": g, "similarity": similarity, "is_tp": is_tp, "ord": order})


def _pair_cells(df: DataFrame, count, schema: str, id_col: str, vector: str, label: str, cell_rows: int) -> DataFrame:
    """What ``count(is_tp, query ids, scores, own)`` makes of the pairs of every cell: no pair leaves its cell.

    It is called for pieces of the score matrix that hold same-class pairs (True) or others (False) only: the sides of a cell are
    taken class by class. ``own`` are the places of pairs of one item, which do not count. Rows of one cell that agree in all columns
    but the sums (n, total) and extremes (low, high) are merged.
    """
    items = df.select(F.col(id_col).alias("id"), blocks.stored(df, vector).alias("v"), F.col(label).alias("label"))
    left = items.select(F.col("id").alias("query_id"), F.col("v").alias("qv"), F.col("label").alias("asked"))
    columns = [part.split()[0] for part in schema.split(", ")]
    merge = {c: how for c, how in {"n": "sum", "total": "sum", "low": "min", "high": "max"}.items() if c in columns}
    keys = [c for c in columns if c not in merge]

    def kernel(lpdf: pd.DataFrame, rpdf: pd.DataFrame) -> pd.DataFrame:
        out, held = [], 0
        if not lpdf.empty and not rpdf.empty:
            codes, classes = pd.factorize(rpdf["label"])  # -1 for null, which equals nothing
            order = np.argsort(codes, kind="stable")
            codes, ids, gv = codes[order], rpdf["id"].to_numpy()[order], blocks.unit_rows(blocks.matrix(rpdf["v"])[order])
            asked = pd.Index(classes).get_indexer(lpdf["asked"])
            qid, qv = lpdf["query_id"].to_numpy(), blocks.unit_rows(blocks.matrix(lpdf["qv"]))
            for code in np.unique(asked):
                low, high = np.searchsorted(codes, [code, code + 1]) if code >= 0 else (0, 0)
                of_class = np.flatnonzero(asked == code)
                for p in blocks.slices(len(of_class), len(gv)):
                    rows = of_class[p]
                    value = np.round(qv[rows] @ gv.T, blocks.TIE_DECIMALS)
                    row, col = np.nonzero(qid[rows][:, None] == ids[None, :])
                    for is_tp, start, end in ((False, 0, low), (True, low, high), (False, high, len(gv))):
                        if end > start:
                            here = (col >= start) & (col < end)
                            out.append(count(is_tp, qid[rows], value[:, start:end], (row[here], col[here] - start)))
                            held += len(out[-1])
                    if held > 1_000_000:
                        out = [merged(out)]
                        held = -len(out[0])  # counted anew
        return merged(out)

    def merged(out: list) -> pd.DataFrame:
        if not out:
            return pd.DataFrame(columns=columns)
        return pd.concat(out, ignore_index=True).groupby(keys, as_index=False, sort=False, dropna=False).agg(merge)[columns]

    rows = min(cell_rows, blocks.cell_rows_for(items, "v"))
    n = items.count()
    return blocks.grid(left, items, ["query_id"], ["id"], kernel, schema, rows, n_left=n, n_right=n)


def _edge_bins(value: np.ndarray, low: float, high: float, edges: int) -> np.ndarray:
    """The bin of each value, as ``density_histogram`` has it; -1 outside."""
    bins = edges - 1
    width = (high - low) / bins
    at = np.minimum(np.floor((value - low) * (1.0 / width)), bins - 1).astype(np.int64)
    return np.where((value >= low) & (value <= high), at, -1)


def pair_score_counts(
    df: DataFrame, edges: int = 100, decimals: int = 9, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", cell_rows: int = blocks.CELL_ROWS
) -> DataFrame:
    """(query_id, is_tp, bin, n): how many pairs of a query have a similarity in each of edges - 1 bins over [-1, 1]."""

    def count(is_tp, qid, value, own):
        at = _edge_bins(np.round(value, decimals), -1.0, 1.0, edges)
        at[own] = -1
        at += 1 + edges * np.arange(len(qid))[:, None]  # the first place of a query takes what does not count
        n = np.bincount(at.ravel())
        spot = np.flatnonzero(n)
        spot = spot[spot % edges > 0]
        return pd.DataFrame({"query_id": qid[spot // edges], "is_tp": is_tp, "bin": spot % edges - 1, "n": n[spot]})

    id_type = dict(df.dtypes)[id_col]
    counts = _pair_cells(df, count, f"query_id {id_type}, is_tp boolean, bin long, n long", id_col, vector, label, cell_rows)
    return counts.groupBy("query_id", "is_tp", "bin").agg(F.sum("n").alias("n"))


class _Block(NamedTuple):
    """Rows of a cell's side in the order of their classes; codes are -1 for null and the same on both sides."""

    codes: np.ndarray
    ids: np.ndarray
    unit: np.ndarray

    def known(self) -> _Block:
        """The rows whose scores are numbers."""
        good = np.isfinite(self.unit).all(1)
        return self if good.all() else _Block(*(part[good] for part in self))


def _half_cells(df: DataFrame, count, schema: str, id_col: str, vector: str, label: str, cell_rows: int) -> DataFrame:
    """What ``count(one block, other block)`` makes of every unordered pair of blocks: a score is the same from both sides.

    A block that meets itself is given as both sides, and all its ordered pairs lie in that cell; else the cell holds half of
    them. The pairs of rows of one id lie where a block meets itself.
    """
    items = df.select(F.col(id_col).alias("id"), blocks.stored(df, vector).alias("v"), F.col(label).alias("label"))
    columns = [part.split()[0] for part in schema.split(", ")]

    def kernel(one: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        if one.empty or other.empty:
            return pd.DataFrame(columns=columns)
        classes = pd.factorize(pd.concat([one["label"], other["label"]]))[1]

        def block(side: pd.DataFrame) -> _Block:
            codes, ids = classes.get_indexer(side["label"]), pd.factorize(side["id"], sort=True)[0]
            codes = np.where(side["label"].isna(), -1, codes)
            order = np.lexsort((ids, codes))  # the same in every pass
            return _Block(codes[order], ids[order], blocks.unit_rows(blocks.matrix(side["v"])[order]))

        left = block(one)
        out = count(left, left if other is one else block(other))
        if other is not one:
            out = out.assign(**{c: 2 * out[c] for c in ("n", "bad", "total") if c in columns})
        return out[columns]

    rows, n = min(cell_rows, blocks.cell_rows_for(items, "v")), items.count()
    return blocks.half_grid(items, ["id"], kernel, schema, rows, n)


def _score_tiles(left: _Block, right: _Block) -> Iterator[tuple]:
    """(classes of the rows, of the columns, scores, parts, same): the scores of a cell tile by tile, the part of FINE of each, and the
    rectangles that hold the pairs of one class. Parts rise with the scores; pairs of one id are in part FINE + 1, rows whose scores are
    no numbers are left out. The arrays are used again."""
    itself, left, right = right is left, left.known(), right.known()
    room = [np.empty(SCORE_TILE[0] * SCORE_TILE[1], kind) for kind in (np.float64, np.float64, np.int64)]
    for top in range(0, len(left.unit), SCORE_TILE[0]):
        rows = slice(top, min(top + SCORE_TILE[0], len(left.unit)))
        for first in range(0, len(right.unit), SCORE_TILE[1]):
            cols = slice(first, min(first + SCORE_TILE[1], len(right.unit)))
            shape = (rows.stop - rows.start, cols.stop - cols.start)
            value, scaled, part = (held[: shape[0] * shape[1]].reshape(shape) for held in room)
            np.matmul(left.unit[rows], right.unit[cols].T, out=value)
            np.add(value, 1.0, out=scaled)
            scaled *= FINE // 2
            np.copyto(part, scaled, casting="unsafe")
            if itself:
                part[np.equal.outer(left.ids[rows], right.ids[cols]) & (left.ids[rows] >= 0)[:, None]] = FINE + 1
            asked, codes = left.codes[rows], right.codes[cols]
            yield asked, codes, value, part, _one_class(asked, codes)


def _one_class(asked: np.ndarray, codes: np.ndarray) -> list[tuple[slice, slice]]:
    if asked[0] > codes[-1] or asked[-1] < codes[0]:
        return []
    common = np.intersect1d(asked, codes)
    common = common[common >= 0]
    edges = [np.searchsorted(side, common, how) for side in (asked, codes) for how in ("left", "right")]
    return [(slice(a, b), slice(c, d)) for a, b, c, d in zip(*edges)]


def _count_tile(counts: np.ndarray, part: np.ndarray, same: list[tuple[slice, slice]]) -> None:
    """Add the scores of a tile to (not of one class, of one class) x parts."""
    n = np.bincount(part.ravel(), minlength=FINE + 2)
    inside = np.concatenate([part[spot].ravel() for spot in same]) if same else np.empty(0, np.int64)
    if len(inside) == part.size:
        counts[1] += n
        return
    counts[0] += n
    if len(inside):
        n = np.bincount(inside, minlength=FINE + 2)
        counts[0] -= n
        counts[1] += n


def _picked(picks: np.ndarray, asked: np.ndarray, codes: np.ndarray, value: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(flag, part, score) of the scores of a tile whose part is marked in ``picks``."""
    at = np.flatnonzero(picks.take(part.ravel()))
    asked, codes = asked[at // value.shape[1]], codes[at % value.shape[1]]
    return (asked == codes) & (asked >= 0), part.ravel()[at], np.round(value.ravel()[at], blocks.TIE_DECIMALS)


def pair_score_distribution(
    df: DataFrame, edges: int = 100, decimals: int = 9, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", cell_rows: int = blocks.CELL_ROWS
) -> DataFrame:
    """``score_distribution`` of all ordered pairs, counted inside the cells: a row per cell, series, flag and bin.

    Scores are counted by their part of FINE. Bins follow the scores, so a part whose ends share a bin lies in it; the scores of
    the other parts (about one for each edge) are looked at one by one.
    """

    def bins(value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        value = np.round(value, decimals)
        far = np.sqrt(np.maximum(2.0 - 2.0 * value, 0.0))
        return _edge_bins(value, -1.0, 1.0, edges), _edge_bins(far, 0.0, 2.0, edges)

    def count(left: _Block, right: _Block) -> pd.DataFrame:
        ends = np.clip(np.arange(FINE + 2) / (FINE // 2) - 1.0, -1.0, 1.0)  # no cosine is further beyond than rounding takes it
        low, high = bins(ends[:-1] - 1e-15), bins(ends[1:] + 1e-15)
        split = np.append((low[0] != high[0]) | (low[1] != high[1]), False)
        counts, found = np.zeros((2, FINE + 2), np.int64), np.zeros((2, 2, edges - 1), np.int64)
        for *tile, part, same in _score_tiles(left, right):
            _count_tile(counts, part, same)
            flag, _, value = _picked(split, *tile, part)
            for series, at in enumerate(bins(value)):
                for is_tp in (0, 1):
                    here = at[(flag == is_tp) & (at >= 0)]
                    found[series, is_tp] += np.bincount(here, minlength=edges - 1)
        for series, at in enumerate(low):
            whole = np.flatnonzero(~split[:-1] & (at >= 0))
            for is_tp in (0, 1):
                np.add.at(found[series, is_tp], at[whole], counts[is_tp, whole])
        series, is_tp, spot = np.nonzero(found)
        names = np.array(["similarity", "distance"], object)
        return pd.DataFrame({"series": names[series], "is_tp": is_tp == 1, "bin": spot, "n": found[series, is_tp, spot]})

    counts = _half_cells(df, count, "series string, is_tp boolean, bin long, n long", id_col, vector, label, cell_rows)
    counts = counts.groupBy("series", "is_tp", "bin").agg(F.sum("n").alias("n"))
    total = F.sum("n").over(Window.partitionBy("series", "is_tp"))  # at most edges - 1 rows
    return counts.select("series", "is_tp", "bin", "n", (F.col("n") / (total * F.lit(2.0 / (edges - 1)))).alias("density"))


def _pair_sums(left: _Block, right: _Block) -> pd.DataFrame:
    """(is_tp, n, bad, total) of a cell: its pairs, those without a number as score, and the sum of the other scores, from sums of vectors."""

    def pairs(one: _Block, other: _Block, group) -> np.ndarray:
        """Number and sum of scores of the pairs that share a group; rows of group -1 have none."""
        (a, n, s), (b, m, t) = (_grouped(group(side), side.unit) for side in (one, other))
        _, a, b = np.intersect1d(a, b, assume_unique=True, return_indices=True)
        return np.array([(n[a] * m[b]).sum(), (s[a] * t[b]).sum()])

    def tally(one: _Block, other: _Block, itself: bool) -> tuple[np.ndarray, np.ndarray]:
        whole, same = pairs(one, other, lambda side: np.zeros(len(side.ids), np.int64)), pairs(one, other, lambda side: side.codes)
        if itself:
            classes = max(one.codes.max(initial=0), 0) + 1
            both = lambda side: np.where((side.ids >= 0) & (side.codes >= 0), side.ids * classes + side.codes, -1)
            whole, same = whole - pairs(one, other, lambda side: side.ids), same - pairs(one, other, both)
        return whole - same, same

    itself, rows = right is left, []
    for is_tp, (every, good) in enumerate(zip(tally(left, right, itself), tally(left.known(), right.known(), itself))):
        rows.append((is_tp == 1, int(every[0]), int(every[0] - good[0]), good[1]))
    return pd.DataFrame(rows, columns=["is_tp", "n", "bad", "total"])


def _grouped(group: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Groups, rows and sum of vectors of each."""
    order = np.argsort(group, kind="stable")
    order = order[group[order] >= 0]
    names, start, n = np.unique(group[order], return_index=True, return_counts=True)
    return names, n, np.add.reduceat(unit[order], start) if len(names) else np.empty((0, unit.shape[1]))


def _with_mean(sums: DataFrame) -> DataFrame:
    """(is_tp, n, bad, mean) from the sums of the cells."""
    sums = sums.groupBy("is_tp").agg(*[F.sum(c).alias(c) for c in ("n", "bad", "total")]).where("n > 0")
    return sums.select("is_tp", "n", "bad", F.when(F.col("bad") > 0, F.lit(math.nan)).otherwise(F.col("total") / F.col("n")).alias("mean"))


def pair_score_summary(
    df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", cell_rows: int = blocks.CELL_ROWS
) -> DataFrame:
    """``score_summary`` of all ordered pairs: means from sums of vectors, order statistics by two passes over the scores.

    The first pass counts, inside the cells, the scores in each part of FINE; the second returns those of the at most 16 parts that
    hold a wanted rank, in whole steps of 1e-12, so that the order statistics are exact.
    """
    spark = df.sparkSession

    def sums_and_parts(left, right):
        counts = np.zeros((2, FINE + 2), np.int64)
        for *_, part, same in _score_tiles(left, right):
            _count_tile(counts, part, same)
        is_tp, part = np.nonzero(counts[:, : FINE + 1])
        parts = pd.DataFrame({"is_tp": is_tp == 1, "part": part, "n": counts[is_tp, part], "bad": 0, "total": 0.0})
        return pd.concat([parts, _pair_sums(left, right).assign(part=-1)], ignore_index=True)

    schema = "is_tp boolean, part long, n long, bad long, total double"
    parts = _half_cells(df, sums_and_parts, schema, id_col, vector, label, cell_rows).groupBy("is_tp", "part")
    parts = cut_lineage(parts.agg(*[F.sum(c).alias(c) for c in ("n", "bad", "total")]))  # at most FINE + 2 rows for each flag
    known = {r["is_tp"]: r.asDict() for r in _with_mean(parts.where("part = -1")).collect()}  # two rows
    places = {f: {q: q * (r["n"] - 1) for q in (0.0, *QUARTILES, 1.0)} for f, r in known.items()}
    ranks = {f: {at for x in asked.values() for at in (math.floor(x), math.ceil(x)) if at < known[f]["n"] - known[f]["bad"]} for f, asked in places.items()}
    wanted = {(f, r): ((f,), 0) for f, some in ranks.items() for r in some}  # (flag, rank) -> its place as far as known, scores before that
    counted = parts.where("part >= 0").select("is_tp", "part", "n")
    wanted = _narrowed(wanted, counted.toPandas())
    picks = np.zeros((2, FINE + 2), bool)
    for (f, part), _ in wanted.values():
        picks[int(f), part] = True

    def chosen(left, right, picks=picks):
        out, held = [], 0
        either = picks.any(0)
        for *tile, part, _ in _score_tiles(left, right):
            flag, part, value = _picked(either, *tile, part)
            keep = picks[flag.astype(int), part]
            out.append(pd.DataFrame({"is_tp": flag[keep], "part": part[keep], "step": _steps(value[keep]), "n": 1}))
            held += len(out[-1])
            if held > 1_000_000:
                out = [merged(out)]
                held = -len(out[0])  # counted anew
        return merged(out)

    def merged(out):
        out = pd.concat(out, ignore_index=True) if out else pd.DataFrame(columns=["is_tp", "part", "step", "n"])
        return out.groupby(["is_tp", "part", "step"], as_index=False, sort=False).agg({"n": "sum"})

    steps = cut_lineage(_half_cells(df, chosen, "is_tp boolean, part long, step long, n long", id_col, vector, label, cell_rows))
    steps = steps.withColumn("group", F.shiftright("step", PART_BITS))
    for column in ("group", "step"):
        names = ["is_tp", "part", "group", "step"][: 3 + (column == "step")]
        # at most 2**13 groups in each of 16 parts, then 2**12 steps in each of 16 groups
        near = spark.createDataFrame(sorted({place for place, _ in wanted.values()}), steps.select(*names[:-1]).schema)
        counted = steps.join(F.broadcast(near), names[:-1], "left_semi").groupBy(*names).agg(F.sum("n").alias("n"))
        wanted = _narrowed(wanted, counted.toPandas())
    score = {k: round(place[-1] / KEY_STEPS - 1.0, blocks.TIE_DECIMALS) for k, (place, _) in wanted.items()}

    def between(f, at):
        low, high = (score.get((f, r), math.nan) for r in (math.floor(at), math.ceil(at)))
        return low + (high - low) * (at - math.floor(at))

    rows = [(f, r["n"], r["mean"], *(between(f, places[f][q]) for q in (0.0, 1.0, *QUARTILES))) for f, r in known.items()]
    return spark.createDataFrame(rows, "is_tp boolean, n long, mean double, min double, max double, q1 double, median double, q3 double")


def _narrowed(wanted: dict, counts: pd.DataFrame) -> dict:
    """Each (flag, rank) -> (place, scores before it) with the place one column longer; ``counts``: the place's columns, that one and n."""
    counts = counts.sort_values(list(counts.columns[:-1]))
    groups = {place if isinstance(place, tuple) else (place,): own for place, own in counts.groupby(list(counts.columns[:-2]))}
    out = {}
    for (f, rank), (place, before) in wanted.items():
        own = groups[place]
        total = own["n"].to_numpy().cumsum()
        at = min(int(np.searchsorted(total, rank - before, side="right")), len(own) - 1)
        out[f, rank] = (*place, int(own.iloc[at, -2])), before + (int(total[at - 1]) if at else 0)
    return out


def _steps(value: np.ndarray) -> np.ndarray:
    """Scores as whole steps above -1."""
    return np.rint((value + 1.0) * KEY_STEPS).astype(np.int64)


def pair_score_margin(
    df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", cell_rows: int = blocks.CELL_ROWS
) -> DataFrame:
    """``score_margin`` of all ordered pairs, from sums made inside the cells."""
    known = _with_mean(_half_cells(df, _pair_sums, "is_tp boolean, n long, bad long, total double", id_col, vector, label, cell_rows))
    means = known.agg(F.max(F.when(F.col("is_tp"), F.col("mean"))).alias("tp_mean"), F.max(F.when(~F.col("is_tp"), F.col("mean"))).alias("fp_mean"))
    return means.withColumn("margin", F.abs(F.col("tp_mean") - F.col("fp_mean")))


def flag_alias(col: Column) -> Column:
    """True-positive flag from the spellings found in pair files."""
    return F.lower(F.trim(col.cast("string"))).isin("true", "1", "true positive")


def density_histogram(df: DataFrame, value: Column, low: float, high: float, edges: int = 100, by: Sequence[str] = ()) -> DataFrame:
    """Density over edges - 1 equal bins; the last bin includes its right edge."""
    bins = edges - 1
    width = (high - low) / bins
    inside = df.select(*by, value.alias("v")).where(F.col("v").between(low, high))
    index = F.least(F.floor((F.col("v") - low) * F.lit(1.0 / width)), F.lit(bins - 1))
    counts = inside.groupBy(*by, index.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(*by, F.lit(0)))  # at most edges - 1 rows per series
    return counts.select(*by, "bin", "n", (F.col("n") / (total * F.lit(width))).alias("density"))


def score_distribution(pairs: DataFrame, edges: int = 100) -> DataFrame:
    """Density of similarity over [-1, 1] and of distance over [0, 2], per flag: one row per bin."""
    similarity = density_histogram(pairs, F.col("similarity"), -1.0, 1.0, edges, ["is_tp"])
    distance = density_histogram(pairs, V.sim_to_l2(F.col("similarity")), 0.0, 2.0, edges, ["is_tp"])
    return similarity.withColumn("series", F.lit("similarity")).unionByName(distance.withColumn("series", F.lit("distance")))


def score_summary(pairs: DataFrame) -> DataFrame:
    """Count, mean and box quartiles of the similarity per flag."""
    long = pairs.select("is_tp", F.lit("similarity").alias("metric"), F.col("similarity").alias("v"))
    q = exact_quantiles(long, [0.25, 0.5, 0.75], ["is_tp"])
    base = long.groupBy("is_tp").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.min("v").alias("min"), F.max("v").alias("max"))
    quart = q.select("is_tp", *[F.col("q")[i].alias(name) for i, name in enumerate(["q1", "median", "q3"])])
    return base.join(quart, "is_tp")


def score_margin(pairs: DataFrame) -> DataFrame:
    """Means of both flags and the absolute difference, in one row."""
    means = pairs.agg(
        F.avg(F.when(F.col("is_tp"), F.col("similarity"))).alias("tp_mean"),
        F.avg(F.when(~F.col("is_tp"), F.col("similarity"))).alias("fp_mean"),
    )
    return means.withColumn("margin", F.abs(F.col("tp_mean") - F.col("fp_mean")))


# --- report tables ---------------------------------------------------------------------------


def unpivot_metrics(metrics: DataFrame, value: str = "value") -> DataFrame:
    """One row of metric columns to (metric, value) rows."""
    names = metrics.columns
    return metrics.unpivot([], [F.col(c).cast("double").alias(c) for c in names], "metric", value)


def compare_metrics(raw: DataFrame, preprocessed: DataFrame, order: Sequence[str]) -> DataFrame:
    """metric, raw, preprocessed and delta in the given order; a metric of one side only stays."""
    both = unpivot_metrics(raw, "raw").join(unpivot_metrics(preprocessed, "preprocessed"), "metric", "full_outer")
    place = F.array_position(F.array(*[F.lit(m) for m in order]), F.col("metric"))
    return both.withColumn("delta", F.col("preprocessed") - F.col("raw")).withColumn("place", place).orderBy("place", "metric")


def precision_curve(metrics: DataFrame) -> DataFrame:
    """(k, series, value) of the metrics named precision, sorted by k and labelled P@k."""
    rows = unpivot_metrics(metrics).where(F.col("metric").contains("precision"))
    k = F.regexp_extract("metric", r"top(\d+)", 1).cast("int")
    return rows.select(k.alias("k"), F.concat(F.lit("P@"), k.cast("string")).alias("series"), "value").orderBy("k")
