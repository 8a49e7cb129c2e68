"""Toxicity by a weighted finite-state pattern grammar over clauses.

Five small transducers read the word classes of a clause from left to right:

- insult: emits a match at an insulting word, with the weight of its stem;
- threat: follows speaker and intent ("I will", "ich werde", "voy a") up to a verb of violence, and knows passives;
- target: how far the last person named lies behind, and which open matches a person that follows still reaches;
- negation: how far the last negation lies behind;
- reported speech: whether a verb of saying or an open quotation mark came before.

``compose`` runs them as one machine, whose transitions are built once for each state and class. A match keeps its weight
as a register until the words that can change it have passed: an insult that meets a person counts more than one alone, a
threat counts only with its object, negated and reported matches count less. A clause's weight is the sum of its matches';
a text's score is the logistic of a linear form in the weights of its clauses and its length.

Insults beyond a few known ones are stems (word beginnings of 3 to 12 letters) chosen on a bounded sample of labelled
rows, ``SAMPLE_ROWS`` at most, equal texts once, toxic if any of their labels says so. A stem is a candidate only if the
share of its occurrences (each doubling within a text counts one more) that lies in toxic texts would come about by
chance with a probability below ``CHANCE`` over all stems of the sample (the Chernoff bound of the binomial tail). Its weight is the logarithm of its rate among the words of toxic texts over that
among those of clean ones; each round takes the stem that adds most weight to toxic texts, which then count less for the next stem. Stem
counts are made by Spark; the driver gets only candidates. The linear form is then fitted on the same sample, so that the
cut at a score of 0.7 errs least. Scoring runs over whole texts, in time proportional to their length.

Results for odd input: null or empty text gets the score of a text without matches; very long texts are read whole; an
empty table gives no rows; without labels of both kinds only the known words score; rows that repeat give equal rows; a
null id passes through; extra columns are ignored by scores and kept by ``keep_clean``, whatever their names.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Callable, Hashable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialize

SAMPLE_ROWS = 12_000
STEM_MIN, STEM_MAX = 3, 12
#: Greatest probability that any stem of the sample is a candidate by chance.
CHANCE = 0.01
#: Least ratio of the rates in toxic and clean texts of a stem.
RATIO = 8.0
#: Least number of toxic texts with a stem.
TEXTS = 3
#: The linear form at a score of 0.7, and what a clean text that is flagged costs against a toxic one that is missed.
CUT, FLAGGED = math.log(0.7 / 0.3), 2.0
#: Least distance of evidence between texts that a cut by length may part.
GAP = 0.2
#: Most characters of the texts whose stems a worker holds at once; a single longer text is held alone.
HELD = 1 << 18
#: Words that a negation reaches, that a person before a match and one after it reach, and that a threat's parts span.
NEGATED, BEHIND, AHEAD, SPAN = 3, 4, 3, 4
#: What a match's weight is multiplied by.
AIMED, ALONE, DENIED, SAID, INTENDED = 1.3, 1.0, 0.5, 0.7, 1.5
TOKEN = re.compile(r"[^\W\d_]+|[\"\u201c\u201d\u00ab\u00bb\u201e]")
WORD = re.compile(r"[^\W\d_]+")
MARKS = ".!?;:\n"
CLAUSE = re.compile(r"[.!?;:\n]+")

#: Fixed word classes in English, French, German and Spanish.
CLASSES = {
    "negation": frozenset("not no never nobody neither nor without isn aren wasn weren don doesn didn won wouldn cannot cant pas jamais aucun nicht kein keine keinen niemals nie nunca jamás tampoco".split()),
    "report": frozenset("said says say quoted reported reports claims claimed wrote called calls dit écrit rapporte affirme sagte sagt schrieb berichtet dijo dice escribió".split()),
    "person": frozenset("you your yours yourself yourselves u he she they them him her his their these those tu vous te toi ton votre ils elles lui leur du ihr dich euch dir er sie ihn ihm tú usted ustedes vosotros os ellos ellas él ella".split()),
    "speaker": frozenset("i we ll m im je j nous ich wir yo nosotros".split()),
    "intent": frozenset("will gonna going shall should must want ll vais allons veux dois werde werden will muss soll voy vamos quiero debo".split()),
    "auxiliary": frozenset("was were been being be is are got get été est sont wurde wurden wird fue fueron sido son".split()),
}
#: Fixed stems of known insults and of verbs of violence, with weights.
INSULT = {"idiot": 5.0, "moron": 5.0, "stupid": 4.0, "scum": 5.0, "imbecil": 5.0, "imbécile": 5.0, "dummkopf": 5.0, "imbécil": 5.0, "loser": 4.0, "pathetic": 4.0, "worthless": 4.0}
THREAT = {"kill": 4.0, "murder": 4.0, "hurt": 3.0, "destroy": 3.0, "strangle": 4.0, "tuer": 4.0, "töten": 4.0, "umbring": 4.0, "matar": 4.0}
#: Endings of a verb of violence that tell of the past.
PAST = re.compile(r"(?:ed|ó|aron|té|tét)$")


@dataclass(frozen=True)
class Model:
    """Stem weights, the linear form (shift, per unit of weight, per 100 characters), and the scale of threats."""

    stems: tuple[tuple[str, float], ...]
    form: tuple[float, float, float] = (-4.0, 1.2, -0.01)
    level: float = 1.0


def known() -> dict[str, float]:
    return dict(INSULT)


# -- transducers


@dataclass(frozen=True)
class Transducer:
    """``step(state, word class)`` gives the next state and what is told of the word."""

    start: Hashable
    step: Callable[[Hashable, str], tuple[Hashable, Hashable]]


def since(kinds: set[str], reach: int) -> Transducer:
    """Tells whether a word of ``kinds`` is among the ``reach`` words before."""
    return Transducer(reach, lambda s, c: (0 if c in kinds else min(s + 1, reach), s < reach))


def insult() -> Transducer:
    return Transducer(0, lambda s, c: (0, c == "insult"))


def threat() -> Transducer:
    """Tells of a verb of violence whether it is intended, plain, or of the past or passive (None); False for other words.

    The state is how far speaker, intent and auxiliary lie behind.
    """

    def step(state: tuple[int, int, int], c: str):
        told: Hashable = False
        speaker, intent, auxiliary = state
        if c in ("violence", "violent past"):
            intended = intent < SPAN
            told = "intended" if intended else None if c == "violent past" or auxiliary < 2 else "plain"
        near = lambda hit, n: 0 if hit else min(n + 1, SPAN)
        # an intent counts with the speaker before it, or if none other is named
        begun = c in ("intent", "speaker intent") and speaker < SPAN
        return (near(c in ("speaker", "speaker intent"), speaker), near(begun, intent), near(c == "auxiliary", auxiliary)), told

    return Transducer((SPAN, SPAN, SPAN), step)


def report() -> Transducer:
    """Tells whether a verb of saying came before in the clause, or a quotation is open."""

    def step(state: tuple[bool, bool], c: str):
        said, quoted = state
        return (said or c == "report", quoted != (c == "quote")), said or quoted

    return Transducer((False, False), step)


def reach() -> Transducer:
    """Tells the ages of the open matches that a person meets; a match is open for AHEAD words."""

    def step(ages: tuple[int, ...], c: str):
        older = tuple(a + 1 for a in ages if a + 1 <= AHEAD)
        return (*older, *((0,) if c in ("insult", "violence", "violent past") else ())), older if c == "person" else ()

    return Transducer((), step)


def compose(*machines: Transducer) -> Transducer:
    """The machines side by side, as one; a transition is built when it is first taken."""
    table: dict = {}

    def step(states, c: str):
        found = table.get((states, c))
        if found is None:
            moved = [m.step(s, c) for m, s in zip(machines, states, strict=True)]
            found = table[states, c] = (tuple(s for s, _ in moved), tuple(out for _, out in moved))
        return found

    return Transducer(tuple(m.start for m in machines), step)


GRAMMAR = compose(insult(), threat(), since({"person"}, BEHIND), since({"negation"}, NEGATED), report(), reach())


@functools.lru_cache(maxsize=8)
def matcher(stems: tuple[tuple[str, float], ...]):
    """A pattern that finds words of the lexicon, and the weights of insults by stem."""
    weights = dict(stems)
    # longest first: the most specific stem of a word decides
    body = "|".join(map(re.escape, sorted({**weights, **THREAT}, key=lambda s: (-len(s), s))))
    return re.compile(rf"(?<![^\W\d_])(?:{body})"), weights


def classify(token: str, stem: str | None, weights: dict[str, float]) -> str:
    """The class of a word, ``stem`` being the lexicon's stem that it begins with."""
    if stem is not None:
        return "insult" if stem in weights else "violent past" if PAST.search(token) else "violence"
    if not token[0].isalpha():
        return "quote"
    if token in CLASSES["speaker"]:
        return "speaker intent" if token in CLASSES["intent"] else "speaker"
    for name in ("negation", "report", "person", "intent", "auxiliary"):
        if token in CLASSES[name]:
            return name
    return "word"


def matches(classes: list[str], weights: list[float]) -> list[float]:
    """The weights of a clause's matches, from its words' classes and their stems' weights."""
    state, found, kinds = GRAMMAR.start, [], {}
    for k, c in enumerate(classes):
        state, (is_insult, violence, person, negated, reported, met) = GRAMMAR.step(state, c)
        for age in met:
            at = k - age
            if at in kinds:
                kind, scale, aimed = kinds[at]
                kinds[at] = kind, scale, True
        scale = (DENIED if negated else 1.0) * (SAID if reported else 1.0)
        if is_insult:
            kinds[k] = "insult", scale, person
        elif violence:
            # the object stands behind the verb, or before it after an intent
            kinds[k] = violence, scale, person and violence == "intended"
    for at, (kind, scale, aimed) in kinds.items():
        if kind == "insult":
            found.append(weights[at] * scale * (AIMED if aimed else ALONE))
        elif aimed:
            found.append(weights[at] * scale * (INTENDED if kind == "intended" else 1.0))
    return found


def clause_weight(clause: str, pattern, weights: dict[str, float], level: float) -> float:
    """The grammar's run over one clause."""
    classes, values = [], []
    for m in TOKEN.finditer(clause):
        hit = pattern.match(clause, m.start()) if m[0][0].isalpha() else None
        stem = hit[0] if hit else None
        classes.append(classify(m[0], stem, weights))
        values.append(0.0 if stem is None else weights[stem] if stem in weights else level * THREAT[stem])
    return sum(matches(classes, values))


def evidence(text: str, stems: tuple[tuple[str, float], ...], level: float = 1.0) -> float:
    """The sum of the clauses' weights; only clauses with a word of the lexicon are read."""
    pattern, weights = matcher(stems)
    low = text.lower()
    total, at = 0.0, 0
    while hit := pattern.search(low, at):
        # from the last clause mark before the match to the next after it
        begin = max(at, *(low.rfind(mark, at, hit.start()) + 1 for mark in MARKS))
        end = CLAUSE.search(low, hit.end())
        at = end.start() if end else len(low)
        total += clause_weight(low[begin:at], pattern, weights, level)
    return total


def score(text: str, model: Model) -> float:
    shift, slope, length = model.form
    z = shift + slope * evidence(text, model.stems, model.level) + length * len(text) / 100
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


# -- learning


def stems_of(text: str) -> dict[str, float]:
    """How often the stems of a text's words occur, each doubling counting one more."""
    found: Counter = Counter()
    for word, n in Counter(WORD.findall(text.lower())).items():
        for k in range(STEM_MIN, min(len(word), STEM_MAX) + 1):
            found[word[:k]] += n
    return {s: 1 + math.log2(n) for s, n in found.items()}


def stem_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``y, stem, n`` of each text of ``body, y`` batches, HELD characters at once: stems take fifty times their text's memory."""
    for batch in batches:
        texts, labels = batch.column("body").to_pylist(), batch.column("y").to_pylist()
        at = 0
        while at < len(texts):
            end, held = at + 1, len(texts[at])
            while end < len(texts) and held + len(texts[end]) <= HELD:
                held += len(texts[end])
                end += 1
            found = [{**stems_of(t), "": float(len(WORD.findall(t)))} for t in texts[at:end]]
            y = np.repeat(np.array(labels[at:end], bool), [len(f) for f in found])
            yield pa.RecordBatch.from_arrays([pa.array(y), pa.array([s for f in found for s in f], pa.string()), pa.array([n for f in found for n in f.values()], pa.float64())], ["y", "stem", "n"])
            at = end


def choose(rows: list[tuple[list[int], list[float]]], stems: list[str], weights: np.ndarray) -> dict[str, float]:
    """Greedy cover. rows: numbers of the candidates in each toxic text, and how often they occur."""
    gain, share = np.zeros(len(stems)), np.ones(len(rows))
    having: dict[int, list[int]] = {}
    rows = [(np.array(j, np.int64), np.array(n, float)) for j, n in rows]
    for i, (j, n) in enumerate(rows):
        np.add.at(gain, j, n * weights[j])
        for k in j.tolist():
            having.setdefault(k, []).append(i)
    lengths = np.array([len(s) for s in stems])
    found: dict[str, float] = {}
    least = max(1.5, 0.002 * len(rows))
    while len(stems):
        # among equals the longest: it covers as much and is the most specific
        k = int(np.lexsort((lengths, np.round(gain, 6)))[-1])
        if gain[k] < least * weights[k]:
            break
        found[stems[k]] = float(weights[k])
        for i in having[k]:
            j, n = rows[i]
            np.add.at(gain, j, -0.7 * share[i] * n * weights[j])
            share[i] *= 0.3
        # beginnings and continuations of a chosen stem say the same
        gain[[i for i, s in enumerate(stems) if s.startswith(stems[k]) or stems[k].startswith(s)]] = -np.inf
    return found


def fit(x: np.ndarray, n: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """The linear form: evidence, less a share for a text's length, is cut where the sample has the least cost of errors.

    Among equal costs the least share for length and the widest gap between texts win; the slope then is the likeliest one.
    """
    best: tuple = (math.inf, 0.0, 0.0, 0.0)
    for per in (0.0, *(0.01 * 2.0**k for k in range(6))):
        v = x - per * n
        order = np.argsort(v, kind="stable")
        low, toxic = v[order], y[order].astype(float)
        # cutting before text k: toxic texts below are missed, clean ones from there on are flagged
        cost = np.concatenate(([0.0], np.cumsum(toxic))) + FLAGGED * ((1 - toxic).sum() - np.concatenate(([0.0], np.cumsum(1 - toxic))))
        gap = np.concatenate(([0.0], np.diff(low), [1.0]))
        gap[0] = 1.0
        # length may only part texts that it parts clearly: between texts of equal evidence it would fit chance
        usable = np.flatnonzero(gap > (GAP if per else 1e-9))
        k = usable[np.lexsort((-gap[usable], cost[usable]))[0]]
        middle = low[0] - 0.5 if k == 0 else low[-1] + 0.5 if k == len(low) else (low[k - 1] + low[k]) / 2
        if cost[k] < best[0] - 1e-9:
            best = (cost[k], per, float(middle), 0.0)
    _, per, middle, _ = best
    z = lambda slope: CUT + slope * (x - per * n - middle)
    slopes = [0.1 * k for k in range(3, 31)]
    loss = [np.logaddexp(0, (1 - 2 * y) * z(slope)).sum() for slope in slopes]
    slope = slopes[int(np.argmin(loss))]
    return CUT - slope * middle, slope, -slope * per


def draw(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``body, y`` of at most ``sample_rows`` labelled rows, chosen by the hash of their texts; equal texts come once.

    Rows are chosen by key and hash; only the chosen ones' texts are fetched. A text with any label 1 is toxic.
    """
    bounded_batches(docs.sparkSession)
    ids = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("key")).agg(F.max(F.col(label_col) == 1).alias("y"))
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("key"), F.col(text_col).alias("body"))
    hashes = [F.xxhash64("body").alias("h0"), F.xxhash64("body", F.lit(1)).alias("h1")]
    # a row of labels is narrow; the texts' side is read for its key and hashes alone
    rows = materialize(texts.select("key", *hashes).join(ids, "key"), "toxicity")
    chosen = rows.groupBy("h0", "h1").agg(F.max("y").alias("y"), F.min("key").alias("key")).orderBy("h0", "h1").limit(sample_rows)
    chosen = materialize(chosen, "toxicity")
    # at most sample_rows rows
    found = texts.join(F.broadcast(chosen), "key").where((F.xxhash64("body") == F.col("h0")) & (F.xxhash64("body", F.lit(1)) == F.col("h1")))
    return materialize(found.groupBy("h0", "h1").agg(F.first("body").alias("body"), F.max("y").alias("y")).select("body", "y"), "toxicity")


def train(sample: DataFrame) -> Model:
    """Learn stems and linear form from ``body, y`` rows, which must be bounded in number: see ``draw``."""

    sizes = {r.y: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(True, 0), sizes.get(False, 0)
    if not n1 or not n0:
        return Model(tuple(known().items()))
    of = lambda column, y: F.coalesce(F.sum(F.when(F.col("y") == y, column)), F.lit(0))
    counts = sample.mapInArrow(stem_rows, "y boolean, stem string, n double").groupBy("stem").agg(of(F.lit(1), True).alias("c1"), of(F.col("n"), True).alias("s1"), of(F.col("n"), False).alias("s0"))
    counts = materialize(counts, "toxicity")
    words, stems = counts.where("stem = ''").first(), counts.count()
    share, toxic = F.col("s1") / (F.col("s1") + F.col("s0")), words.s1 / (words.s1 + words.s0)
    rest = F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - toxic))).otherwise(0.0)
    surprise = (F.col("s1") + F.col("s0")) * (share * F.log(share / toxic) + rest)
    weight = F.log((F.col("s1") + 0.5) / (words.s1 + 1)) - F.log((F.col("s0") + 0.5) / (words.s0 + 1))
    fits = (share > toxic) & (surprise > math.log(stems / CHANCE)) & (weight >= math.log(RATIO))
    # the sums of a group may differ in their last digits from run to run: weights are rounded
    chosen = counts.where(F.col("c1") >= TEXTS).where("stem <> ''").withColumn("w", F.round(weight, 6)).where(fits).orderBy(F.desc("c1"), F.desc(F.length("stem")), "stem").collect()
    number = {r.stem: k for k, r in enumerate(chosen)}

    def restrict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            have = [sorted((number[s], n) for s, n in stems_of(t).items() if s in number) for t in batch.column("body").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([[k for k, _ in h] for h in have], pa.list_(pa.int32())), pa.array([[n for _, n in h] for h in have], pa.list_(pa.float64()))], ["stems", "n"])

    have = [(r.stems, r["n"]) for r in sample.where("y").mapInArrow(restrict, "stems array<int>, n array<double>").orderBy("stems", "n").collect()] if number else []
    learned = choose(have, list(number), np.array([r.w for r in chosen])) if number else {}
    # known words weigh what they are known for at least, on the scale of the learned ones
    level = max(1.0, max(learned.values(), default=0.0) / max(INSULT.values()))
    weights = tuple({**learned, **{s: max(level * w, learned.get(s, 0.0)) for s, w in known().items()}}.items())

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"x": [evidence(t, weights, level) for t in pdf["body"]], "n": pdf["body"].str.len() / 100, "y": pdf["y"].astype(float)})

    xy = sample.mapInPandas(weigh, "x double, n double, y double").toPandas().sort_values(["x", "n", "y"])
    return Model(weights, level=level, form=fit(*(xy[c].to_numpy() for c in ("x", "n", "y"))))


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, score`` of each row."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [score(t, model) for t in batch.column("body").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(scores, pa.float64())], ["key", "score"])

    return rows.mapInArrow(run, f"key {kind}, score double").withColumnRenamed("key", id_col)


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows, all columns as they are, whose text scores below ``threshold``."""
    bounded_batches(docs.sparkSession)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = [score(t or "", model) < threshold for t in batch.column(names.index(text_col)).to_pylist()]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
