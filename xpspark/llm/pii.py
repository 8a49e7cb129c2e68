"""Personal data by candidate gradient boosting, in DataFrame functions only.

Base kinds (email, ip, card, phone) are patterns with a check. High-recall generators propose further spans, which may
overlap: secrets, social-security-like numbers, phones without a country code, account numbers, plain numbers, hex
keys and spelled-out addresses. Boosted trees read format and context features of each proposal (its kind, length,
character classes, the words before it); a threshold calibrated for its kind selects it for redaction. Base spans always
stay, a proposal that overlaps one is dropped, and of selected proposals that overlap each other the one furthest above its
threshold stays.

The trees are trained on the driver on ``SAMPLE`` generated lines, a bounded sample whose features the same
expressions compute; calibration and threshold use lines that the trees have not seen. They are applied as one expression
per candidate, so that texts never leave the JVM.

Positions: a text is split at a kind's matches; spans follow from prefix sums over the lengths of the pieces, in code
points. Patterns are written so that a search never restarts inside a run that failed, and with possessive loops, which
neither recurse nor backtrack: time is linear in a text's length.

Results for odd input: null text counts as empty; an empty text has no spans; very long texts are read whole; rows that
repeat give equal rows; proposals equally far above their thresholds (ties) go by start, then end, then kind; a null id
passes through; an empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import json
import math
import random
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let

SAMPLE, SEED, TREES, DEPTH, RATE, PRECISION = 3000, 5, 40, 3, 0.3, 0.97
BLOCK = 512

#: Fixed patterns of the base kinds, in their order. A start inside a run is tried only where the last match ended.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[ -][0-9]++)*+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must hold for a kind's pattern to be tried at all.
HINT = {"email": "@", "ip": ".", "phone": "+"}

#: Fixed patterns of the generators, in the order of their kinds.
PROPOSED = {
    "secret": r"(?:\bAKIA[0-9A-Z]{16}\b|\b(?i:password|passwd|pwd|secret|token|api[_-]?key)[ ]{0,2}[=:][ ]{0,2}\"?[^\s\"]{4,})",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "local": r"(?<![0-9+(.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])",
    "account": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "number": r"(?<![0-9A-Za-z.,-])[0-9]{7,11}(?![0-9A-Za-z-]|[.,][0-9])",
    "hex": r"(?<![0-9A-Za-z])[0-9a-f]{32,64}(?![0-9A-Za-z])",
    "spelled": r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]++ ?[(\[](?i:at)[)\]] ?[A-Za-z0-9-]++ ?(?:\.|[(\[](?i:dot)[)\]]) ?[A-Za-z]{2,}",
}
#: A proposal needs one of these somewhere in the text.
PROPOSED_HINT = {"secret": r"AKIA|[=:]", "hex": r"[0-9a-f]{32}", "spelled": r"[(\[]"}

#: Words before a proposal that speak for or against personal data.
FOR = r"(?i)(?:phone|tel|call|mobile|fax|ssn|social|security|passport|account|acct|iban|bank|licen[cs]e|secret|token|key|password|contact|customer|patient)\W*(?:(?:no|nr|number|is|at|id)\W*)?$"
AGAINST = r"(?i)(?:commit|md5|sha\d*|checksum|hash|page|order|total|sum|part|isbn|ref|version|model|population|item|invoice|batch|serial|sku|score)\W*(?:(?:no|nr|number|is|of|id)\W*)?$"
KINDS = [*BASE, *PROPOSED]


def prefix_sums(lengths: Column) -> Column:
    """For each element the sum of those before it; blocks keep the copying of growing arrays bounded."""
    zero = F.struct(F.array().cast("array<int>").alias("a"), F.lit(0).alias("s"))

    def scan(xs: Column) -> Column:
        return F.aggregate(xs, zero, lambda acc, x: F.struct(F.array_append(acc["a"], acc["s"]).alias("a"), (acc["s"] + x).alias("s")), lambda acc: acc["a"])

    def two_levels(xs: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / BLOCK).cast("int")), lambda b: F.slice(xs, b * BLOCK + 1, F.lit(BLOCK)))
        add = lambda bs: F.zip_with(bs, scan(F.transform(bs, lambda b: F.aggregate(b, F.lit(0), lambda s, x: s + x))), lambda b, o: F.transform(scan(b), lambda x: x + o))
        return F.flatten(let(blocks, add))

    return let(lengths, lambda xs: F.when(F.size(xs) <= BLOCK, scan(xs)).otherwise(two_levels(xs)))


def located(text: Column, pattern: str) -> Column:
    """Matches as ``array<struct<start, end, value, before, after>>``, leftmost and not overlapping."""

    def place(rest: Column, values: Column) -> Column:
        lengths = F.transform(values, lambda v, i: F.length(F.get(rest, i)) + F.length(v))
        one = lambda at: F.transform(values, lambda v, i: F.struct(
            (F.get(at, i) + F.length(F.get(rest, i))).alias("start"), (F.get(at, i) + F.length(F.get(rest, i)) + F.length(v)).alias("end"),
            v.alias("value"), F.right(F.get(rest, i), F.lit(32)).alias("before"), F.left(F.get(rest, i + 1), F.lit(8)).alias("after"),
        ))
        return let(prefix_sums(lengths), one)

    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return let(values, lambda v: F.when(F.size(v) > 0, let(F.split(text, pattern, -1), lambda rest: place(rest, v))))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """True if a string of digits passes the check sum."""
    back = F.reverse(number)
    digit = lambda i: F.substring(back, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
    doubled = F.transform(F.sequence(F.lit(1), F.length(number)), lambda i: let(digit(i), lambda d: F.when(d > 9, d - 9).otherwise(d)))
    return F.aggregate(doubled, F.lit(0), lambda s, d: s + d) % 10 == 0


def passes(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: p.rlike("^0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        # the length goes first: long runs of digits are never read digit by digit
        return let(digits(value), lambda d: F.when(F.length(d).between(12, 19), luhn(d)).otherwise(F.lit(False)))
    if kind == "phone":
        return F.length(digits(value)).between(9, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    """``array<struct<start, rank, end>>`` of a base kind."""
    rank = KINDS.index(kind)
    found = F.filter(located(text, BASE[kind]), lambda m: passes(kind, m["value"]))
    spans = F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end")))
    tried = F.contains(text, F.lit(HINT[kind])) if kind in HINT else text.rlike("[0-9](?:[ -]?[0-9]){11}")
    return F.coalesce(F.when(tried, spans), F.array().cast("array<struct<start:int,rank:int,end:int>>"))


FEATURES = ["rank", "length", "digits", "letters", "capitals", "marks", "distinct", "said_for", "said_against", "zeros", "quoted", "lower_only"]


def features(kind: str, m: Column) -> Column:
    value, before = m["value"], m["before"]
    count = lambda pattern: F.length(F.regexp_replace(value, pattern, ""))
    tail = F.regexp_replace(value, r"^(?i:password|passwd|pwd|secret|token|api[_-]?key)[ ]*[=:][ ]*\"?", "")
    flag = lambda c: c.cast("int")
    columns = {
        "rank": F.lit(KINDS.index(kind)),
        "length": F.length(tail),
        "digits": count("[^0-9]"),
        "letters": count("[^A-Za-z]"),
        "capitals": count("[^A-Z]"),
        "marks": count("[A-Za-z0-9]"),
        "distinct": F.size(F.array_distinct(F.split(F.left(tail, F.lit(80)), ""))),
        "said_for": flag(before.rlike(FOR)),
        "said_against": flag(before.rlike(AGAINST)),
        "zeros": flag(value.rlike("000|1234|^9")),
        "quoted": flag(m["after"].rlike('^"')),
        "lower_only": flag(tail.rlike("^[a-z.]+$")),
    }
    return F.struct(m["start"].alias("start"), m["end"].alias("end"), *(columns[f].cast("double").alias(f) for f in FEATURES))


def proposals(text: Column) -> Column:
    """Features of every generator's matches, in one array."""
    kind_of = "array<struct<start:int,end:int," + ",".join(f"{f}:double" for f in FEATURES) + ">>"

    def one(kind: str) -> Column:
        found = F.transform(located(text, PROPOSED[kind]), functools.partial(lambda k, m: features(k, m), kind))
        tried = text.rlike(PROPOSED_HINT.get(kind, r"[0-9]{2}"))
        return F.coalesce(F.when(tried, found), F.array().cast(kind_of))

    return F.concat(*(one(k) for k in PROPOSED))


@dataclass(frozen=True)
class Model:
    """Trees as nested (feature, cut, left, right) tuples with leaf values, and for each kind the least sum that selects."""

    trees: tuple
    thresholds: tuple[tuple[int, float], ...]


def lines(n: int, seed: int) -> list[tuple[str, int]]:
    """Generated lines, each with one proposal, and whether it is personal data."""
    rng = random.Random(seed)
    pick, run = rng.choice, lambda chars, k: "".join(rng.choices(chars, k=k))
    num, hexa, caps, low = "0123456789", "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyz"
    word = lambda: run(low, rng.randint(2, 9))
    name = lambda: pick(["password", "passwd", "pwd", "secret", "token", "api_key", "Password", "TOKEN"])
    sep, good, bad = lambda: pick(["=", " = ", ": ", ":"]), ["phone", "tel.", "call", "ssn", "passport no", "account", "IBAN", "bank account", "contact", "customer id", "patient id"], ["commit", "md5", "checksum", "page", "order", "total", "part no", "ref", "version", "population", "invoice", "batch", "serial"]
    iban = lambda: pick(["DE", "FR", "ES", "GB", "NL"]) + run(num, 2) + pick(["", " "]).join(["", *(run(num, 4) for _ in range(rng.randint(3, 5)))])
    local = lambda: pick(["({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "({}){}-{}", "{} {} {}"]).format(str(rng.randint(201, 989)), str(rng.randint(200, 999)), run(num, 4))
    makers = [
        lambda: (1, f"{name()}{sep()}{run(hexa, rng.randint(8, 40))}"), lambda: (1, f'{name()}{sep()}"{run(hexa + caps, rng.randint(8, 40))}"'), lambda: (1, "AKIA" + run(caps, 16)),
        lambda: (0, f"{name()}{sep()}{word()}{word()[:4]}"), lambda: (0, f'{name()}{sep()}"{word()}.{word()}"'),
        lambda: (1, f"{pick(['', 'ssn ', 'social security '])}{rng.randint(100, 899)}-{rng.randint(10, 99)}-{run(num, 4)}"), lambda: (0, f"{pick(bad)} 000-{run(num, 2)}-{run(num, 4)}"), lambda: (0, f"{pick(bad)} {run(num, 3)}-{run(num, 2)}-{run(num, 4)}"),
        lambda: (1, f"{pick(['', 'call ', 'tel. ', 'phone: '])}{local()}"), lambda: (0, f"{pick(bad)} {local()}"),
        lambda: (1, f"{pick(['', 'IBAN ', 'account '])}{iban()}"), lambda: (0, f"{pick(bad)} {run(caps[:26], 2)}{run(num, 2)} {run(caps[:26], 4)} {run(caps[:26], 4)}"),
        lambda: (1, f"{pick(good)} {run(num, rng.randint(7, 11))}"), lambda: (0, f"{pick([word(), word(), pick(bad)])} {run(num, rng.randint(7, 11))}"),
        lambda: (1, f"{pick(['secret', 'token', 'key'])} {run(hexa, rng.choice([32, 40, 64]))}"), lambda: (0, f"{pick([word(), word(), pick(bad)])} {run(hexa, rng.choice([32, 40, 64]))}"),
        lambda: (1, f"{word()}.{word()} {pick(['(at)', '[at]'])} {word()}{pick(['.', ' (dot) '])}{pick(['com', 'org', 'de'])}"), lambda: (0, f"{word()} (at) {word()}"),
    ]
    found = []
    for k in range(n):
        label, core = makers[k % len(makers)]()
        found.append((f"{word()} {word()}{pick([' ', ', ', '. '])}{core}{pick([' ', '. ', ', '])}{word()} {word()}.", label))
    return found


def grow(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, depth: int):
    """A regression tree on gradients, by exact gain."""
    leaf = float(-RATE * grad.sum() / (hess.sum() + 1.0))
    if depth == 0 or len(x) < 20:
        return leaf
    best, total = (1e-6, None, None), grad.sum() ** 2 / (hess.sum() + 1.0)
    for f in range(x.shape[1]):
        for cut in np.unique(np.quantile(x[:, f], np.linspace(0, 1, 17)[:-1])):
            left = x[:, f] <= cut
            if 5 <= left.sum() <= len(x) - 5:
                gain = sum(grad[s].sum() ** 2 / (hess[s].sum() + 1.0) for s in (left, ~left)) - total
                if gain > best[0] + 1e-9:
                    best = (gain, f, float(cut))
    if best[1] is None:
        return leaf
    left = x[:, best[1]] <= best[2]
    return best[1], best[2], grow(x[left], grad[left], hess[left], depth - 1), grow(x[~left], grad[~left], hess[~left], depth - 1)


def predict(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    f, cut, left, right = tree
    return np.where(x[:, f] <= cut, predict(left, x), predict(right, x))


def boost(x: np.ndarray, y: np.ndarray) -> tuple:
    """Boosted trees on logistic loss."""
    total, trees = np.zeros(len(x)), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-total))
        trees.append(grow(x, p - y, p * (1 - p), DEPTH))
        total = total + predict(trees[-1], x)
    return tuple(trees)


def calibrate(total: np.ndarray, y: np.ndarray) -> float:
    """The least sum from which on the share of personal data, among unseen lines, is PRECISION or more."""
    best = math.inf
    for cut in np.unique(total):
        if y[total >= cut].mean() >= PRECISION:
            best = min(best, float(cut))
    return best


@functools.lru_cache(maxsize=1)
def trained(rows: str) -> Model:
    data = np.array(json.loads(rows), dtype=float)
    x, y = data[:, :-1], data[:, -1]
    seen = np.arange(len(x)) % 3 != 0
    trees = boost(x[seen], y[seen])
    total, kind = sum(predict(t, x[~seen]) for t in trees), x[~seen][:, FEATURES.index("rank")]
    cuts = {r: calibrate(total[kind == r], y[~seen][kind == r]) for r in range(len(BASE), len(KINDS)) if (kind == r).any()}
    return Model(trees, tuple((r, cuts.get(r, math.inf)) for r in range(len(BASE), len(KINDS))))


def train(spark: SparkSession, sample: int = SAMPLE, seed: int = SEED) -> Model:
    """Train on ``sample`` generated lines; the driver gets their features only."""
    text = json.dumps([{"k": k, "t": t, "y": y} for k, (t, y) in enumerate(lines(sample, seed))])
    rows = spark.range(1).select(F.explode(F.from_json(F.lit(text), "array<struct<k:int,t:string,y:int>>")).alias("r")).select("r.*")
    flat = rows.select("k", "y", F.explode(proposals(F.col("t"))).alias("m")).select("k", *(F.col(f"m.{f}") for f in FEATURES), "y").collect()
    return trained(json.dumps(sorted([list(r)[1:] for r in flat])))


def tree_column(tree, m: Column) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(tree)
    f, cut, left, right = tree
    return F.when(m[FEATURES[f]] <= cut, tree_column(left, m)).otherwise(tree_column(right, m))


def margin(model: Model, m: Column) -> Column:
    """How far a proposal's sum of leaves lies above its kind's threshold."""
    total = functools.reduce(lambda a, b: a + b, (tree_column(t, m) for t in model.trees))
    cuts = F.array(*(F.lit(cut) for _, cut in model.thresholds))
    return total - F.get(cuts, (m["rank"] - model.thresholds[0][0]).cast("int"))


def apart(found: Column) -> Column:
    """Of spans in order of preference, those that overlap none before them."""
    none = F.array().cast("array<struct<start:int,rank:int,end:int>>")
    free = lambda kept, m: ~F.exists(kept, lambda k: (k["start"] < m["end"]) & (m["start"] < k["end"]))
    plain = lambda m: F.struct(m["start"].alias("start"), m["rank"].alias("rank"), m["end"].alias("end"))
    return F.aggregate(found, none, lambda kept, m: F.when(free(kept, m), F.array_append(kept, plain(m))).otherwise(kept))


def find(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, base, added``: arrays of ``start, rank, end`` by start, then rank; ``KINDS[rank]`` is the kind."""
    model = model or train(docs.sparkSession)
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("__body"))
    text = F.col("__body")
    base = F.sort_array(F.concat(*(base_spans(text, k) for k in BASE)))
    rows = rows.select(id_col, base.alias("base"), proposals(text).alias("__proposed"))
    free = lambda m: ~F.exists("base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"]))
    scored = F.transform(F.filter("__proposed", free), lambda m: F.struct((-margin(model, m)).alias("below"), m["start"].alias("start"), m["end"].alias("end"), m["rank"].cast("int").alias("rank")))
    chosen = F.array_sort(F.filter(scored, lambda m: m["below"] <= 0))
    none = F.array().cast("array<struct<start:int,rank:int,end:int>>")
    return rows.select(id_col, "base", F.when(F.size("__proposed") > 0, F.sort_array(apart(chosen))).otherwise(none).alias("added"))


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``id_col, n_email, n_ip, n_card, n_phone, n_spans, base_text, spans``; ``n_spans`` counts spans of all kinds."""
    counts = [F.size(F.filter("base", functools.partial(lambda r, s: s["rank"] == r, r))).cast("long").alias(f"n_{k}") for r, k in enumerate(BASE)]
    counts.append((F.size("base") + F.size("added")).cast("long").alias("n_spans"))
    return found.select(id_col, *counts, span_text(F.col("base")).alias("base_text"), span_text(F.sort_array(F.concat("base", "added"))).alias("spans"))
