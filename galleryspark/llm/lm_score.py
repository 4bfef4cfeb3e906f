"""Log probabilities of texts under a hashed maximum-entropy language model.

P(word | history) = P(class of word | history) * P(word | class). The class is a softmax over CLASSES with three kinds
of features: the previous word, the word before it (a skip), and the hashed pair of both, each a row of weights.
Inside its class a word has its smoothed share of the corpus count, the closed form of a maximum-entropy model with
only an intercept per word. Words enter features through forms: the commonest words have one each, all others share
forms by their last three bytes, so the model's size is fixed while every word counts. Classes group forms by
what stands before them (means of the rows of a table forms x common previous words, counted over all
training text).

Training passes over all training text once: every task starts from common weights (log odds of the counted table),
updates a copy by AdaGrad gradient steps on batches of tokens, and Spark averages the copies by tokens, first in
groups, then over the groups. Counts of words grow with the corpus and stay distributed; only words above a share of
1/HOT of all tokens are broadcast (at most HOT of them), and the others are joined.

Cases: null and empty texts are one end token; a null doc_id is scored but neither held out nor learned; repeated rows
are scored (and counted) as often as they occur; without training text every token has the base probability;
words that training lacks share their class's half count; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from galleryspark.llm.common import store
from galleryspark.llm.hashing import LOWER_CODES, U, blocks, mix, words

HOT = 1 << 18
TOP_FORMS = 1023
TAIL_FORMS = 1024
FORMS = TOP_FORMS + TAIL_FORMS + 1  # the last one is the edge of a text
PAIRS = 1 << 12
CLASSES = 16
ANCHORS = 48
STEP = 0.3
BATCH_TOKENS = 1 << 13
COUNT_TOKENS = 1 << 21
GROUPS = 64
END_HASH = int(mix(np.array([0x5EED], U)).view(np.int64)[0])
_EDGE = FORMS - 1


def _tokens(texts: pa.Array):
    """(first row, end row, word hashes, rows, tails) per block; a tail is the bucket of a word's last three bytes."""
    for base, end, data, starts in blocks(texts):
        hashes, rows, first, stop = words(data, starts)
        tail = np.zeros(len(hashes), U)
        for back in (1, 2, 3):
            at = np.maximum(stop - back, first)
            tail = tail * U(0x100000001B3) + LOWER_CODES[data[at]] if len(hashes) else tail
        yield base, end, hashes, rows, (mix(tail) % U(TAIL_FORMS)).astype(np.int32)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, tail, n), summed over runs of a bounded number of tokens; texts count their end token."""
    held, size = [], 0

    def flush():
        hashes = np.concatenate([h for h, _ in held])
        tails = np.concatenate([t for _, t in held])
        word, at, n = np.unique(hashes, return_index=True, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(tails[at]), pa.array(n.astype(np.int64))], names=["word", "tail", "n"])

    for batch in batches:
        yield pa.RecordBatch.from_arrays(
            [pa.array([END_HASH]), pa.array([-1], pa.int32()), pa.array([batch.num_rows])], names=["word", "tail", "n"]
        )
        for _, _, hashes, _, tails in _tokens(batch.column(0)):
            held.append((hashes, tails))
            size += len(hashes)
            if size >= COUNT_TOKENS:
                yield flush()
                held, size = [], 0
    if size:
        yield flush()


class _Vocabulary:
    """Counts of hot words and the form of any word."""

    def __init__(self, hot: np.ndarray, n: np.ndarray):
        order = np.argsort(hot)
        self.word, self.n = hot[order], n[order]
        by_count = np.lexsort((self.word, -self.n))[:TOP_FORMS]
        self.form = np.full(len(hot), -1, np.int32)
        self.form[by_count] = np.arange(len(by_count))

    def look_up(self, hashes: np.ndarray, tails: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count (0 if not hot) and form."""
        forms = TOP_FORMS + tails
        if not len(self.word):
            return np.zeros(len(hashes), np.int64), forms
        at = np.minimum(np.searchsorted(self.word, hashes), len(self.word) - 1)
        known = self.word[at] == hashes
        return np.where(known, self.n[at], 0), np.where(known & (self.form[at] >= 0), self.form[at], forms)


def _streams(texts: pa.Array, vocabulary: _Vocabulary):
    """Per block: rows of all tokens (words and ends), their forms, the two forms before, and of words place, hash, count."""
    for base, end, hashes, rows, tails in _tokens(texts):
        count, forms = vocabulary.look_up(hashes, tails)
        texts_here = np.arange(end - base)
        owner = np.concatenate([rows, texts_here])
        order = np.argsort(owner, kind="stable")  # a text's end comes after its words
        owner = owner[order]
        form = np.concatenate([forms, np.full(end - base, _EDGE)])[order].astype(np.int32)
        before = np.concatenate(([_EDGE], form[:-1]))  # the token before a text's first one is an end
        skip = np.concatenate(([_EDGE], before[:-1]))
        skip[before == _EDGE] = _EDGE
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        yield base, end, owner, form, before, skip, place[: len(hashes)], hashes, count


def _pair_rows(before: np.ndarray, skip: np.ndarray) -> np.ndarray:
    return ((before.astype(np.uint32) * np.uint32(0x9E3779B1) ^ skip.astype(np.uint32) * np.uint32(0x85EBCA77)) >> np.uint32(20)).astype(np.int32)


def _form_mass(vocabulary):
    """(form, mass): smoothed counts per form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(FORMS)
        for batch in batches:
            word, tail, n = (batch.column(i).to_numpy() for i in range(3))
            _, form = vocabulary.value.look_up(word.view(U), tail)
            form = np.where(tail < 0, _EDGE, form)
            total += np.bincount(form, weights=n + 0.5, minlength=FORMS)
        at = np.flatnonzero(total).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["form", "mass"])

    return run


def _before_table(vocabulary):
    """(cell, n): how often each common form (or another one) stands before each form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = ANCHORS + 2
        total = np.zeros(FORMS * width, np.int64)
        for batch in batches:
            for _, _, _, form, before, _, _, _, _ in _streams(batch.column(0), vocabulary.value):
                column = np.where(before < ANCHORS, before, np.where(before == _EDGE, ANCHORS + 1, ANCHORS))
                total += np.bincount(form * width + column, minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["cell", "n"])

    return run


def form_classes(table: np.ndarray) -> np.ndarray:
    """The class of each form: k-means over square roots of the shares of what stands before it; ends are the last class."""
    n = table.sum(1)
    points = np.sqrt((table + 0.1 * table.sum(0) / max(table.sum(), 1)) / (n + 0.1)[:, None])
    order = np.argsort(-n[:_EDGE], kind="stable")
    centres = points[order[:1]]
    for _ in range(CLASSES - 2):  # the farthest of the commonest, weighted
        gap = ((points[order[:512], None] - centres[None]) ** 2).sum(2).min(1) * np.sqrt(n[order[:512]] + 1)
        centres = np.vstack([centres, points[order[int(gap.argmax())]]])
    for _ in range(20):
        own = ((points[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        for k in range(CLASSES - 1):
            mine = (own == k) & (np.arange(FORMS) != _EDGE)
            if n[mine].sum():
                centres[k] = np.average(points[mine], axis=0, weights=n[mine])
    own[_EDGE] = CLASSES - 1
    return own.astype(np.int32)


def _logits(weights: list[np.ndarray], before, skip, pair) -> np.ndarray:
    out = weights[0][before] + weights[1][skip] + weights[2][pair]
    out -= out.max(1, keepdims=True)
    return out


def _add_rows(table: np.ndarray, square: np.ndarray, at: np.ndarray, gradient: np.ndarray) -> None:
    """One AdaGrad step on the rows ``at``."""
    order = np.argsort(at, kind="stable")
    keys = at[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    rows = keys[first]
    total = np.add.reduceat(gradient[order], first, axis=0)
    square[rows] += total * total
    table[rows] -= STEP * total / (np.sqrt(square[rows]) + 1.0)


def _train(shared):
    """One pass of gradient steps over this task's text; one row (part, tokens, weights) of the copy it ends with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, classes, start = shared.value
        weights = [w.copy() for w in start]
        squares = [np.zeros_like(w) for w in weights]
        seen = 0
        for batch in batches:
            for _, _, _, form, before, skip, _, _, _ in _streams(batch.column(0), vocabulary):
                target, pair = classes[form], _pair_rows(before, skip)
                for lo in range(0, len(form), BATCH_TOKENS):
                    part = slice(lo, lo + BATCH_TOKENS)
                    at = (before[part], skip[part], pair[part])
                    share = np.exp(_logits(weights, *at))
                    share /= share.sum(1, keepdims=True)
                    share[np.arange(len(share)), target[part]] -= 1
                    for w, s, rows in zip(weights, squares, at):
                        _add_rows(w, s, rows, share)
                seen += len(form)
        if seen:
            flat = np.concatenate([w.ravel() for w in weights]).astype(np.float32)
            part = int(mix(np.array([seen, int(np.abs(flat[:64]).sum() * 1e6)], U)).sum() % U(GROUPS))
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seen]), pa.array([flat.tobytes()])], names=["part", "tokens", "weights"])

    return run


def _averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Running mean by tokens of the copies in this task."""
    total, seen, part = None, 0, 0
    for batch in batches:
        for part, tokens, weights in zip(*(batch.column(i).to_pylist() for i in range(3))):
            values = np.frombuffer(weights, np.float32).astype(np.float64) * tokens
            total = values if total is None else total + values
            seen += tokens
    if seen:
        yield pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([seen]), pa.array([(total / seen).astype(np.float32).tobytes()])], names=["part", "tokens", "weights"]
        )


def _partial(shared):
    """Per text: what hot words and histories give, and the rare words (word, times) left to be joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, classes, weights, log_mass, end_count = shared.value
        random = np.random.default_rng()
        for batch in batches:
            n = batch.num_rows
            tokens, known = np.zeros(n, np.int64), np.zeros(n, np.int64)
            counted, context = np.zeros(n), np.zeros(n)
            rare_words: list = [None] * n
            rare_times: list = [None] * n
            for base, end, owner, form, before, skip, _, hashes, count in _streams(batch.column(1), vocabulary):
                size = end - base
                tokens[base:end] = np.bincount(owner, minlength=size)
                target, pair = classes[form], _pair_rows(before, skip)
                gained = np.empty(len(form))
                for lo in range(0, len(form), BATCH_TOKENS):
                    part = slice(lo, lo + BATCH_TOKENS)
                    out = _logits(weights, before[part], skip[part], pair[part])
                    gained[part] = out[np.arange(len(out)), target[part]] - np.log(np.exp(out).sum(1))
                context[base:end] = np.bincount(owner, weights=gained / np.log(10) - log_mass[target], minlength=size)
                rows = owner[form != _EDGE]  # of words, in order
                hot = count > 0
                known[base:end] = np.bincount(rows[hot], minlength=size) + (end_count > 0)
                counted[base:end] = np.bincount(rows[hot], weights=np.log10(count[hot] + 0.5), minlength=size) + np.log10(end_count + 0.5)
                cold, cold_rows = hashes[~hot], rows[~hot]
                at = np.concatenate(([0], np.cumsum(np.bincount(cold_rows, minlength=size))))
                for i in range(size):
                    word, times = np.unique(cold[at[i] : at[i + 1]], return_counts=True)
                    rare_words[base + i], rare_times[base + i] = word.view(np.int64), times.astype(np.int32)
            rare = pa.StructArray.from_arrays(
                [pa.array(np.concatenate(rare_words) if n else np.zeros(0, np.int64)), pa.array(np.concatenate(rare_times) if n else np.zeros(0, np.int32))],
                names=["word", "times"],
            )
            ends = np.concatenate(([0], np.cumsum([len(x) for x in rare_words]))).astype(np.int32)
            row = random.integers(-(1 << 63), (1 << 63) - 1, n)  # a name for the row, once stored
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(row), pa.array(tokens), pa.array(known), pa.array(counted), pa.array(context), pa.ListArray.from_arrays(pa.array(ends), rare)],
                names=["doc_id", "held_out", "row", "n_tokens", "known", "counted", "context", "rare"],
            )

    return run


def score_texts(docs: DataFrame, learn: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score per row; learns where ``learn`` is true."""
    spark = docs.sparkSession
    share = spark.sparkContext.broadcast
    docs = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        F.coalesce(learn, F.lit(False)).alias("learn"),
    ).withColumn("held_out", F.col("doc_id").isNotNull() & ~F.col("learn"))
    training = docs.where("learn").select("text")
    counts = training.mapInArrow(_counts, "word long, tail int, n long").groupBy("word").agg(F.min("tail").alias("tail"), F.sum("n").alias("n"))
    counts = store(counts.where("n > 0"), "counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    n, v = int(total["n"]), int(total["v"])
    end_count = int(counts.where(F.col("word") == END_HASH).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    hot = counts.where((F.col("n") * HOT > n) & (F.col("tail") >= 0)).select("word", "n").toArrow()  # fewer than HOT
    vocabulary = _Vocabulary(hot["word"].to_numpy().view(U), hot["n"].to_numpy())
    shared_vocabulary = share(vocabulary)

    mass = np.zeros(FORMS)
    for r in counts.mapInArrow(_form_mass(shared_vocabulary), "form int, mass double").groupBy("form").agg(F.sum("mass").alias("mass")).collect():
        mass[r["form"]] = r["mass"]
    table = np.zeros(FORMS * (ANCHORS + 2))
    cells = training.mapInArrow(_before_table(shared_vocabulary), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    table[cells["cell"].to_numpy()] = cells["n"].to_numpy()
    table = table.reshape(FORMS, -1)
    classes = form_classes(table)
    class_mass = np.bincount(classes, weights=mass, minlength=CLASSES) + 0.5

    # Start: log share of each class, and the log odds of it after a common form
    by_class = np.zeros((CLASSES, ANCHORS + 2))
    np.add.at(by_class, classes, table)
    share_of = (by_class.sum(1) + 1) / (by_class.sum() + CLASSES)
    odds = np.log((by_class + 5 * share_of[:, None]) / (by_class.sum(0) + 5) / share_of[:, None]).T
    first = np.tile(np.log(share_of), (FORMS, 1)).astype(np.float32)
    first[:ANCHORS] += odds[:ANCHORS]
    first[ANCHORS:_EDGE] += odds[ANCHORS]
    first[_EDGE] += odds[ANCHORS + 1]
    weights = [first, np.zeros((FORMS, CLASSES), np.float32), np.zeros((PAIRS, CLASSES), np.float32)]
    copies = training.mapInArrow(_train(share((vocabulary, classes, weights))), "part int, tokens long, weights binary")
    copies = copies.repartition(GROUPS, "part").mapInArrow(_averaged, "part int, tokens long, weights binary").collect()  # GROUPS rows
    if copies:
        flat = np.average([np.frombuffer(r["weights"], np.float32) for r in copies], axis=0, weights=[r["tokens"] for r in copies]).astype(np.float32)
        cuts = np.cumsum([w.size for w in weights])[:-1]
        weights = [part.reshape(w.shape) for part, w in zip(np.split(flat, cuts), weights)]

    shape = share((vocabulary, classes, weights, np.log10(class_mass), end_count))
    schema = "doc_id long, held_out boolean, row long, n_tokens long, known long, counted double, context double, rare array<struct<word:long,times:int>>"
    partial = store(docs.select("doc_id", "text", "held_out").mapInArrow(_partial(shape), schema), "partial")
    rare = partial.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.times")
    joined = rare.join(counts.select("word", "n"), "word", "left").groupBy("row").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("more_known"),
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("more"),
    )
    counted = F.col("counted") + F.coalesce("more", F.lit(0.0))
    base = counted - F.col("n_tokens") * F.lit(float(np.log10(n + 0.5 * (v + 1))))
    return partial.join(joined, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        (counted + F.col("context") if n else base).alias("score"),
    )
