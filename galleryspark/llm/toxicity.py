"""Toxicity scores by a weighted finite-state grammar over clauses.

Letters: the insult transducer reads a word letter by letter along learned paths (beginnings of words, or whole words ended
by END) and writes the class insult with the weight of the longest path it knows. A path's weight is the lower confidence
bound of its log-odds in toxic against other texts, counted over labelled rows; paths below a weighted one that are
no sign of toxicity have weight 0, so a harmless word stays harmless though it begins like an insult.

Words: three transducers over word classes are composed into one machine: *target* (an insult near a word for the person
addressed, a threat verb followed by one), *negation* (what follows a negator closely) and *reported speech* (what
follows a reporting verb or an opening quotation mark). Each clause that holds an insult or a threat verb runs through the
machine; what it writes has a factor, so "you are an I" weighs more than "I", "not an I" and "she said: I" much less.

A text's score is a logistic function of its clauses: sum and maximum of their scores, how many matched, how many
different words did, and the number of words. Its coefficients are fitted on labelled rows of the other of two halves
than the paths (and the other way round), so that chance paths earn no trust. Where few labels say little, a short list of
known insults and the expected signs of the coefficients stand in.

At most TRAIN_ROWS labelled rows are used, in hash order; of labelled near copies (equal smallest shingle hash) one. Cases:
null and empty texts have no clause and get the score of no match; a null doc_id is scored but neither held out nor
learned; null labels are left out, of several labels of one document the smallest counts; repeated rows are scored as
often as they occur; with no label, or only one kind, every score is the smoothed share of toxic labels, (toxic + 1/2) /
(labels + 2); other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from galleryspark.llm.common import store
from galleryspark.llm.transducers import Machine, Transducer

TRAIN_ROWS = 40_000
#: Learned paths: lengths, confidence, documents that a harmless path needs to overrule a shorter one, and how many at most.
SHORTEST, LONGEST = 3, 12
CONFIDENCE = 2.33
OVERRULE_DOCS = 8
LEXICON = 20_000
END = "$"
RIDGE = 1.0
#: What the ridge pulls the coefficients of ClauseScorer.NAMES to: without evidence an insult raises the score.
EXPECTED = (0.0, 1.0, 1.0, 0.0, 1.0, 0.0)

TARGET_REACH, THREAT_REACH, NEGATION_REACH = 5, 3, 4
# Word lists of the closed classes in English, German, French and Spanish.
TARGETS = "you your yours yourself u ur du dich dir dein deine ihr euch euer tu te toi ton ta vous votre tú ti tus vosotros usted ustedes".split()
THREATS = "kill murder hurt destroy strangle stab shoot crush töten umbringen erschießen verprügeln vernichten tuer frapper détruire matar golpear destruir".split()
NEGATORS = "not no never isn't aren't wasn't don't nobody nicht kein keine keinen nie niemals pas jamais aucun aucune nunca jamás ningún ninguna".split()
# Insults that have KNOWN_WEIGHT from the start, for tables with few labels; enough labelled documents without a sign of toxicity overrule it.
INSULTS = (
    "idiot idiots stupid moron morons imbecile loser losers disgusting pathetic worthless scum scumbag filth filthy trash garbage bastard dumb dumbass fool "
    "idioten idiotisch dumm dummkopf trottel versager ekelhaft widerlich erbärmlich wertlos abschaum dreckskerl schwachkopf "
    "idiote idiotes stupide imbécile crétin abruti débile minable dégoûtant pathétique ordure salaud racaille "
    "idiota idiotas estúpido estúpida imbécil tonto inútil basura asqueroso asquerosa patético patética escoria"
).split()
KNOWN_WEIGHT = 2.0
REPORTERS = "said says wrote writes called claims claimed quoted sagte sagt schrieb nannte behauptet dit disait écrit appelé dijo dice escribió llamó".split()

INPUTS = ["other", "insult", "threat", "target", "not", "report", "close", "comma"]
#: What the machine writes, and the factor of the word's weight; a threat has THREAT_WEIGHT.
FACTORS = {"insult": 1.0, "insult at target": 1.5, "insult negated": 0.1, "insult reported": 0.3, "threat at target": 1.0, "threat reported": 0.1}
THREAT_WEIGHT = 4.0

_CLASS = {
    **{w: INPUTS.index("target") for w in TARGETS},
    **{w: INPUTS.index("threat") for w in THREATS},
    **{w: INPUTS.index("not") for w in NEGATORS},
    **{w: INPUTS.index("report") for w in [*REPORTERS, "“", "„", "«"]},
    **{w: INPUTS.index("close") for w in ("”", "»")},
    ",": INPUTS.index("comma"),
}
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|[,“”„«»]|[.!?;\n]+")
_STOPS = frozenset(".!?;\n")
_CACHE = 1 << 20


def target_transducer() -> Transducer:
    """Marks insults up to TARGET_REACH words after a target, and targets up to THREAT_REACH words after a threat verb."""
    rules = {}
    for near in range(TARGET_REACH + 1):
        for threat in range(THREAT_REACH + 1):
            after = max(near - 1, 0), max(threat - 1, 0)
            for symbol in INPUTS:
                rules[(near, threat), symbol] = after, symbol
            rules[(near, threat), "threat"] = (after[0], THREAT_REACH), "threat"
            rules[(near, threat), "target"] = (TARGET_REACH, 0), "threat at target" if threat else "target"
            rules[(near, threat), "insult"] = after, "insult at target" if near else "insult"
    return Transducer((0, 0), rules)


def negation_transducer() -> Transducer:
    """Marks insults in the scope of a negator and takes threats there back; a comma ends the scope."""
    rules = {}
    for scope in range(NEGATION_REACH + 1):
        after = max(scope - 1, 0)
        for symbol in [*INPUTS, *FACTORS]:
            rules[scope, symbol] = after, symbol
        rules[scope, "not"] = NEGATION_REACH, "not"
        rules[scope, "comma"] = 0, "comma"
        if scope:
            rules.update({(scope, s): (after, "insult negated") for s in ("insult", "insult at target")})
            rules[scope, "threat at target"] = after, "other"
    return Transducer(0, rules)


def report_transducer() -> Transducer:
    """Marks what a reporting verb or an opening quotation mark introduces, up to a closing one or the end of the clause."""
    quiet, quoted = "quiet", "quoted"
    return Transducer(
        quiet,
        {
            (quiet, "report"): (quoted, "report"),
            (quoted, "close"): (quiet, "close"),
            (quoted, "insult"): (quoted, "insult reported"),
            (quoted, "insult at target"): (quoted, "insult reported"),
            (quoted, "threat at target"): (quoted, "threat reported"),
        },
    )


def grammar() -> Transducer:
    middle = [*INPUTS, *FACTORS]
    return target_transducer().then(negation_transducer().then(report_transducer(), middle), INPUTS)


class ClauseScorer:
    """Features of texts by the composed machine and a lexicon {path: weight}."""

    NAMES = ["one", "total", "peak", "clauses", "different", "words"]

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon, self.known = lexicon, {}
        self.machine = Machine(grammar(), INPUTS, list(FACTORS))
        self.factors = np.array([*FACTORS.values(), 0.0])  # the last one for what is written as -1

    def weight(self, word: str) -> float:
        """The weight that the longest known path of ``word`` writes."""
        paths = [word + END, *(word[:k] for k in range(min(len(word), LONGEST), SHORTEST - 1, -1))]
        return next((self.lexicon[p] for p in paths if p in self.lexicon), 0.0)

    def weights(self, words: set[str]) -> dict[str, float]:
        """Those of ``words`` that have a weight."""
        found = {}
        for word in words:
            weight = self.known.get(word)
            if weight is None:
                if len(self.known) >= _CACHE:
                    self.known.clear()
                weight = self.known[word] = self.weight(word)
            if weight:
                found[word] = weight
        return found

    def features(self, texts: list[str | None]) -> np.ndarray:
        """One row of NAMES per text."""
        symbols: list[int] = []
        weights: list[float] = []
        first, end, owner = [], [], []
        rows = np.zeros((len(texts), len(self.NAMES)))
        rows[:, 0] = 1
        insult, threat = INPUTS.index("insult"), INPUTS.index("threat")
        for i, text in enumerate(texts):
            text = (text or "").lower()
            words = _WORD.findall(text)
            rows[i, 5] = len(words)
            distinct = set(words)
            hits = self.weights(distinct)
            rows[i, 4] = len(hits)
            if not hits and distinct.isdisjoint(THREATS):
                continue
            begin, live = len(symbols), False
            for token in [*_TOKEN.findall(text), "."]:
                if token[0] in _STOPS:
                    if live:
                        first.append(begin)
                        end.append(len(symbols))
                        owner.append(i)
                    else:
                        del symbols[begin:], weights[begin:]
                    begin, live = len(symbols), False
                    continue
                weight = hits.get(token)
                symbol = insult if weight else _CLASS.get(token, 0)
                live = live or symbol == insult or symbol == threat
                symbols.append(symbol)
                weights.append(weight or THREAT_WEIGHT)
        if owner:
            starts, ends = np.array(first), np.array(end)
            written = self.machine.run(np.array(symbols, np.int32), starts, ends)
            score = np.concatenate(([0.0], np.cumsum(np.array(weights) * self.factors[written])))
            clause = score[ends] - score[starts]
            at = np.array(owner)
            np.add.at(rows[:, 1], at, clause)
            np.maximum.at(rows[:, 2], at, clause)
            np.add.at(rows[:, 3], at, clause > 0)
        rows[:, 1:] = np.log1p(np.maximum(rows[:, 1:], 0))
        return rows


def fit_logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Coefficients of a logistic regression with a ridge towards EXPECTED on all but the first (Newton steps, halved until
    the loss falls: whole ones run away from few labels)."""
    share = (y.sum() + 0.5) / (len(y) + 2)
    w = np.zeros(x.shape[1])
    w[0] = math.log(share / (1 - share))
    if not 0 < y.sum() < len(y):
        return w
    expected = np.array(EXPECTED)
    ridge = np.full(x.shape[1], RIDGE)
    ridge[0] = 1e-6
    loss = lambda w: np.logaddexp(0, x @ w).sum() - y @ (x @ w) + (ridge * (w - expected) ** 2).sum() / 2
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * (w - expected))
        now = loss(w)
        while loss(w + step) > now and np.abs(step).max() >= 1e-6:
            step = step / 2
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _training_rows(docs: DataFrame, labels: DataFrame, learn: Column, target: str, train_rows: int) -> DataFrame:
    """(text, label, half) of at most about ``train_rows`` labelled documents, one of each group of near copies."""
    known = labels.where(F.coalesce(learn, F.lit(False)) & F.col(target).isNotNull())
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(target).cast("int").alias("label"))
    total = max(known.count(), 1)
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(min(1.0, train_rows / total) * (1 << 30)))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen.limit(2 * train_rows)), "doc_id")  # the limit is never met: it states the bound
    words = F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+")
    rows = rows.withColumn("w", words)
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - 2, F.lit(1))), lambda i: F.xxhash64(F.slice("w", i, 3)))
    rows = rows.withColumn("sketch", F.array_min(grams)).drop("w")
    rows = rows.groupBy("sketch", "label").agg(F.min_by("text", F.xxhash64("doc_id")).alias("text"))
    return store(rows.select("text", "label", F.pmod("sketch", F.lit(2)).cast("int").alias("half")), "training")


def _path_counts(rows: DataFrame) -> DataFrame:
    """(path, toxic0, other0, toxic1, other1): texts of each half and label by distinct words along the path."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+(?:['’]\p{L}+)?"), F.lit(0)))
    seen = rows.where("text is not null").select("label", "half", F.explode(words).alias("word"))
    sums = [F.sum(F.when((F.col("half") == h) & (F.col("label") == l), F.col("n")).otherwise(0)).alias(f"{k}{h}") for h in (0, 1) for k, l in (("toxic", 1), ("other", 0))]
    each = F.count(F.lit(1)).alias("n")
    by_word = seen.groupBy("word", "label", "half").agg(each).groupBy("word").agg(*sums)
    starts = F.transform(F.sequence(F.lit(SHORTEST), F.least(F.length("word"), F.lit(LONGEST))), lambda k: F.substring("word", F.lit(1), k))
    paths = F.concat(F.when(F.length("word") >= SHORTEST, starts).otherwise(F.array().cast("array<string>")), F.array(F.concat("word", F.lit(END))))
    columns = ["toxic0", "other0", "toxic1", "other1"]
    return by_word.select(F.explode(paths).alias("path"), *columns).groupBy("path").agg(*(F.sum(c).alias(c) for c in columns))


def lexicon_of(counts: pd.DataFrame, totals: tuple[float, float], toxic: np.ndarray, other: np.ndarray) -> dict[str, float]:
    """{path: weight}: weighted paths, and harmless ones below them."""
    odds = np.log((toxic + 0.5) / (totals[0] + 1)) - np.log((other + 0.5) / (totals[1] + 1))
    weight = np.maximum(odds - CONFIDENCE * np.sqrt(1 / (toxic + 0.5) + 1 / (other + 0.5)), 0)
    paths = counts["path"].to_numpy()
    found = dict(zip(paths[weight > 0], weight[weight > 0].tolist()))
    harmless = (weight == 0) & (toxic + other >= OVERRULE_DOCS)
    for path in paths[harmless]:
        if any(path[:k] in found for k in range(SHORTEST, len(path))):
            found.setdefault(path, 0.0)
    overruled = set(paths[harmless])
    for path in (word + END for word in INSULTS):
        if path not in overruled:
            found.setdefault(path, KNOWN_WEIGHT)
    return found


def _learned(rows: DataFrame) -> tuple[dict[str, float], np.ndarray]:
    """The lexicon and the coefficients."""
    spark = rows.sparkSession
    per_half = {(r["half"], r["label"]): r["n"] for r in rows.groupBy("half", "label").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = lambda label, halves: sum(per_half.get((h, label), 0) for h in halves)
    counts = store(_path_counts(rows), "paths")
    toxic = F.col("toxic0") + F.col("toxic1")
    # lifted above the share of toxic texts in one half at least: the others can have no weight in any lexicon
    lift = lambda h: F.col(f"toxic{h}") * total(0, (h,)) > F.col(f"other{h}") * total(1, (h,))
    lifted = counts.where((toxic >= 2) & (lift(0) | lift(1)))
    lifted = lifted.orderBy(F.desc(F.col("toxic0") + F.col("toxic1") - F.col("other0") - F.col("other1")), "path").limit(LEXICON)
    lifted = store(lifted, "lifted")
    below = F.transform(F.sequence(F.lit(SHORTEST), F.length("path") - 1), lambda k: F.substring("path", F.lit(1), k))
    common = counts.where(F.length("path") > SHORTEST).where(toxic + F.col("other0") + F.col("other1") >= OVERRULE_DOCS)
    under = common.select("path", F.explode(below).alias("start")).join(F.broadcast(lifted.select(F.col("path").alias("start"))), "start")
    under = counts.join(under.select("path").distinct(), "path", "left_semi").join(lifted, "path", "left_anti")
    under = under.orderBy(F.desc(toxic + F.col("other0") + F.col("other1")), "path").limit(LEXICON)
    known = counts.where(F.col("path").isin([word + END for word in INSULTS])).join(lifted, "path", "left_anti").join(under, "path", "left_anti")
    table = lifted.unionByName(under).unionByName(known).toPandas()  # 2 * LEXICON + len(INSULTS) rows at most
    lexicons = {}
    for name, halves in ((0, (0,)), (1, (1,)), ("all", (0, 1))):
        t, o = (sum(table[f"{k}{h}"].to_numpy(float) for h in halves) for k in ("toxic", "other"))
        lexicons[name] = lexicon_of(table, (total(1, halves), total(0, halves)), t, o)
    shared = spark.sparkContext.broadcast(lexicons)

    def crossed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorers = [ClauseScorer(shared.value[1]), ClauseScorer(shared.value[0])]  # each half by the other's lexicon
        for batch in batches:
            half = batch.column(2).to_numpy()
            texts = batch.column(0).to_pylist()
            rows = np.zeros((len(texts), len(ClauseScorer.NAMES)))
            for h in (0, 1):
                rows[half == h] = scorers[h].features([t for t, x in zip(texts, half) if x == h])
            yield pa.RecordBatch.from_arrays([batch.column(1), *map(pa.array, rows.T)], names=["label", *ClauseScorer.NAMES])

    schema = ", ".join(["label int", *(f"{n} double" for n in ClauseScorer.NAMES)])
    made = rows.select("text", "label", "half").mapInArrow(crossed, schema).toPandas()  # TRAIN_ROWS short rows
    return lexicons["all"], fit_logistic(made[ClauseScorer.NAMES].to_numpy(), made["label"].to_numpy(float))


def score_toxicity(docs: DataFrame, labels: DataFrame, learn: Column, target: str = "toxic", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted per row; learns from labels whose doc_id fulfils ``learn``."""
    docs = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        (F.col("doc_id").isNotNull() & ~F.coalesce(learn, F.lit(False))).alias("held_out"),
    )
    lexicon, coefficients = _learned(_training_rows(docs, labels, learn, target, train_rows))
    shared = docs.sparkSession.sparkContext.broadcast((lexicon, coefficients))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, w = ClauseScorer(shared.value[0]), shared.value[1]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                scores = 1 / (1 + np.exp(-np.clip(scorer.features(part.column(1).to_pylist()) @ w, -30, 30)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))],
                    names=["doc_id", "held_out", "score", "predicted"],
                )

    return docs.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")
