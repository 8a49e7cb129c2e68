"""The function library of the column lane: each entry builds a Column from argument values.

``LIBRARY`` maps a name to (least arity, most arity, builder). A builder gets the compiler, for focus, clock and
options, and the argument values.
"""

from __future__ import annotations

import json
import math
import os
import re
import unicodedata
from collections.abc import Callable
from urllib.parse import quote, urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import DynamicError, StaticError, TypeMismatch, fail
from . import core
from .core import DATE, JSON, NUM, STR, TS, Ty, Val, boolean, each, items, js_round, many, nan, num, one, str0, string, to_num, to_str

LIBRARY: dict[str, tuple[int, int, Callable]] = {}
MANY = 99


def fn(*names: str, least: int = 1, most: int | None = None):
    def add(f):
        for name in names:
            LIBRARY[name] = (least, least if most is None else most, f)
        return f

    return add


def literal(v: Val, what: str):
    if v.literal is None:
        raise StaticError("XPST0001", f"{what} must be a literal")
    return v.literal


def focus0(c, a: list[Val]) -> Val:
    """The argument, else the context item."""
    if a:
        return a[0]
    if c.focus is None:
        raise DynamicError("XPDY0002", "no context item")
    return c.focus


# -- strings


@fn("string", least=0, most=1)
def _string(c, a):
    return string(str0(focus0(c, a)))


@fn("concat", least=2, most=MANY)
def _concat(c, a):
    return string(F.concat(*map(str0, a)))


@fn("upper-case")
def _upper(c, a):
    return string(F.upper(str0(a[0])))


@fn("lower-case")
def _lower(c, a):
    return string(F.lower(str0(a[0])))


@fn("starts-with", least=2, most=3)
def _starts(c, a):
    return boolean(F.startswith(str0(a[0]), str0(a[1])))


@fn("ends-with", least=2, most=3)
def _ends(c, a):
    return boolean(F.endswith(str0(a[0]), str0(a[1])))


@fn("contains", least=2, most=3)
def _contains(c, a):
    return boolean(F.contains(str0(a[0]), str0(a[1])))


@fn("substring-before", least=2, most=3)
def _before(c, a):
    s, t = str0(a[0]), str0(a[1])
    at = F.call_function("instr", s, t)
    return string(F.when((at > 0) & (t != ""), F.substring(s, F.lit(1), at - 1)).otherwise(""))


@fn("substring-after", least=2, most=3)
def _after(c, a):
    s, t = str0(a[0]), str0(a[1])
    at = F.call_function("instr", s, t)
    return string(F.when(t == "", s).when(at > 0, F.substring(s, at + F.length(t), F.length(s))).otherwise(""))


@fn("substring", least=2, most=3)
def _substring(c, a):
    s, start = str0(a[0]), js_round(F.coalesce(to_num(a[1]), nan()))
    stop = start + js_round(F.coalesce(to_num(a[2]), nan())) if len(a) > 2 else core.inf()
    first = F.greatest(start, F.lit(1.0))
    size = F.least(stop, F.lit(2147483647.0)) - first
    return string(F.when(F.isnan(size) | F.isnan(start) | F.isnan(stop) | (size <= 0), "").otherwise(F.substring(s, core.clip_int(first), core.clip_int(size))))


@fn("string-length", least=0, most=1)
def _length(c, a):
    s = str0(focus0(c, a))
    # code points, or the reference's UTF-16 units
    return num((F.length(F.encode(s, "UTF-16BE")) / 2 if c.options.utf16 else F.length(s)).cast("double"))


@fn("normalize-space", least=0, most=1)
def _normalize(c, a):
    return string(F.trim(F.regexp_replace(str0(focus0(c, a)), core.SPACE, " ")))


@fn("translate", least=3)
def _translate(c, a):
    return string(F.call_function("translate", *map(str0, a)))


@fn("string-join", least=1, most=2)
def _join(c, a):
    texts = F.transform(items(a[0]), lambda x: str0(Val(x, a[0].ty.item)))
    return string(F.coalesce(F.call_function("array_join", texts, str0(a[1]) if len(a) > 1 else F.lit("")), F.lit("")))


def pattern_of(p: Val, flags: list[Val]) -> Column:
    """A Java pattern: \\i and \\c are spelled out, flags s m i x become a prefix, q quotes."""
    marks = literal(flags[0], "regular expression flags") if flags else ""
    if set(marks) - set("smixq"):
        raise StaticError("FORX0001", marks)
    if p.literal is not None:
        text = re.escape(p.literal) if "q" in marks else java_pattern(p.literal)
        try:
            re.compile(re.sub(r"\\p\{\w+\}|&&", "", text))
        except re.error as e:
            raise StaticError("FORX0002", str(e)) from e
        body = F.lit(text)
    else:
        body = str0(p)
    marks = marks.replace("q", "")
    return F.concat(F.lit(f"(?{marks})"), body) if marks else body


def java_pattern(text: str) -> str:
    text = re.sub(r"-\[([^\]]*)\]\]", r"&&[^\1]]", text)  # class subtraction
    return text.replace("\\i", r"[\p{L}_:]").replace("\\I", r"[^\p{L}_:]").replace("\\c", r"[\p{L}\p{N}._:-]").replace("\\C", r"[^\p{L}\p{N}._:-]")


@fn("matches", least=2, most=3)
def _matches(c, a):
    return boolean(F.regexp_like(str0(a[0]), pattern_of(a[1], a[2:])))


@fn("replace", least=3, most=4)
def _replace(c, a):
    if a[1].literal is not None and re.fullmatch(java_pattern(a[1].literal), ""):
        raise StaticError("FORX0003")
    if a[2].literal is not None and re.search(r"(?<!\\)\$(?!\d|&)", a[2].literal):
        raise StaticError("FORX0004")
    return string(F.regexp_replace(str0(a[0]), pattern_of(a[1], a[3:]), F.replace(str0(a[2]), F.lit("$&"), F.lit("$0"))))


@fn("tokenize", least=1, most=3)
def _tokenize(c, a):
    s = str0(a[0])
    if len(a) == 1:
        return Val(F.filter(F.split(s, core.SPACE, -1), lambda x: x != ""), STR.seq)
    if a[1].literal is not None and re.fullmatch(java_pattern(a[1].literal), ""):
        raise StaticError("FORX0003")
    parts = F.call_function("split", s, pattern_of(a[1], a[2:]), F.lit(-1))
    # empty edges go, empty inner tokens stay
    return Val(F.filter(parts, lambda x, i: (x != "") | ((i > 0) & (i < F.size(parts) - 1))), STR.seq)


@fn("analyze-string", least=2, most=3)
def _analyze(c, a):
    s, text = str0(a[0]), java_pattern(literal(a[1], "pattern"))
    p, groups = pattern_of(a[1], a[2:]), re.compile(re.sub(r"\\p\{\w+\}", "x", text)).groups
    found, rest = F.regexp_extract_all(s, p, F.lit(0)), F.call_function("split", s, p, F.lit(-1))
    piece = lambda kind, value, got: F.struct(F.lit(kind).alias("type"), value.alias("value"), got.alias("groups"))
    got = lambda m: F.array(*(F.call_function("regexp_extract", m, p, F.lit(g + 1)) for g in range(groups))) if groups else F.array().cast("array<string>")
    pairs = F.transform(rest, lambda r, i: F.array(piece("non-match", r, F.array().cast("array<string>")), piece("match", F.get(found, i), got(F.get(found, i)))))
    kind = Ty("rec", fields=(("type", STR), ("value", STR), ("groups", Ty("arr", STR))), many=True)
    return Val(F.filter(F.flatten(pairs), lambda x: x["value"].isNotNull() & ((x["value"] != "") | (x["type"] == "match"))), kind)


@fn("compare", least=2, most=3)
def _compare(c, a):
    x, y = (to_str(v) for v in a[:2])
    if len(a) > 2:
        x, y = F.collate(x, "UNICODE"), F.collate(y, "UNICODE")
    return num(F.when(x < y, -1.0).when(x == y, 0.0).when(x > y, 1.0))


@fn("codepoints-to-string")
def _from_codepoints(c, a):
    utf8 = lambda n: F.decode(F.unhex(F.lpad(F.hex(to_num(Val(n, a[0].ty.item)).cast("long")), 8, "0")), "UTF-32")
    return string(F.array_join(F.transform(items(a[0]), utf8), ""))


@fn("string-to-codepoints")
def _to_codepoints(c, a):
    chars = F.filter(F.split(str0(a[0]), "", -1), lambda x: x != "")
    return Val(F.transform(chars, lambda x: F.conv(F.hex(F.encode(x, "UTF-32")), 16, 10).cast("double")), NUM.seq)


@fn("normalize-unicode", least=1, most=2)
def _unicode(c, a):
    form = (literal(a[1], "form").strip().upper() if len(a) > 1 else "NFC") or None
    if form not in ("NFC", "NFD", "NFKC", "NFKD", None):
        raise StaticError("FOCH0003", form)
    if form is None:
        return string(str0(a[0]))


    @F.pandas_udf("string")
    def normal(s: pd.Series) -> pd.Series:
        return s.map(lambda x: unicodedata.normalize(form, x))

    return string(normal(str0(a[0])))


ROMAN = (("", "m", "mm", "mmm"), ("", "c", "cc", "ccc", "cd", "d", "dc", "dcc", "dccc", "cm"), ("", "x", "xx", "xxx", "xl", "l", "lx", "lxx", "lxxx", "xc"), ("", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix"))
ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "- - twenty thirty forty fifty sixty seventy eighty ninety".split()


def pick(words, at: Column) -> Column:
    return F.get(F.array(*map(F.lit, words)), at.cast("int"))


def in_words(n: Column, scale: int = 3) -> Column:
    """English words below 1000 ** scale."""
    if scale == 0:
        small = F.when(n < 20, pick(ONES, n)).otherwise(F.concat(pick(TENS, F.floor(n / 10)), F.when(n % 10 == 0, "").otherwise(F.concat(F.lit(" "), pick(ONES, n % 10)))))
        hundred = F.concat(pick(ONES, F.floor(n / 100)), F.lit(" hundred"))
        tail = n % 100
        rest = F.when(tail < 20, pick(ONES, tail)).otherwise(F.concat(pick(TENS, F.floor(tail / 10)), F.when(tail % 10 == 0, "").otherwise(F.concat(F.lit(" "), pick(ONES, tail % 10)))))
        return F.when(n < 100, small).when(tail == 0, hundred).otherwise(F.concat(hundred, F.lit(" "), rest))
    unit, name = 1000**scale, ("", "thousand", "million", "billion")[scale]
    high, low = F.floor(n / unit), n % unit
    some = F.concat(in_words(high, 0), F.lit(f" {name}"), F.when(low == 0, "").otherwise(F.concat(F.lit(" "), in_words(low, scale - 1))))
    return F.when(n < unit, in_words(n, scale - 1)).otherwise(some)


@fn("format-integer", least=2, most=3)
def _format_integer(c, a):
    x, picture = to_num(a[0]), literal(a[1], "picture")
    n = F.abs(x).cast("long")
    sign = F.when(x < 0, "-").otherwise("")
    if picture in ("i", "I"):
        text = F.concat(*(pick(r, F.floor(n / 10 ** (3 - k)) % 10) for k, r in enumerate(ROMAN)))
        text = F.when((n >= 1) & (n < 4000), text).otherwise(n.cast("string"))
        out = F.upper(text) if picture == "I" else text
    elif picture in ("a", "A"):
        digit = lambda k: F.floor((n - sum(26**i for i in range(k + 1))) / 26**k) % 26
        base = ord(picture)
        out = F.concat(*(F.when(n >= sum(26**i for i in range(k + 1)), F.chr(digit(k) + base)).otherwise("") for k in (4, 3, 2, 1, 0)))
    elif picture in ("w", "W", "Ww"):
        text = in_words(n)
        out = F.upper(text) if picture == "W" else F.initcap(text) if picture == "Ww" else text
    elif re.fullmatch(r"#*0+", picture):
        out = F.concat(sign, F.when(F.length(n.cast("string")) >= len(picture.strip("#")), n.cast("string")).otherwise(F.lpad(n.cast("string"), len(picture.strip("#")), "0")))
    elif re.fullmatch(r"0*1", picture):
        w = len(picture)
        out = F.concat(sign, F.when(F.length(n.cast("string")) >= w, n.cast("string")).otherwise(F.lpad(n.cast("string"), w, "0")))
    else:
        out = F.concat(sign, n.cast("string"))
    return string(F.when(x.isNull(), "").otherwise(out))


@fn("format-number", least=2, most=3)
def _format_number(c, a):
    x, picture = F.coalesce(to_num(a[0]), nan()), literal(a[1], "picture")
    whole, _, part = picture.partition(".")
    least_whole, least_part, most_part = whole.count("0"), part.count("0"), sum(ch in "0#" for ch in part)
    most_part = max(least_part, min(most_part, 6))
    text = F.format_string(f"%.{most_part}f", F.abs(x))
    if most_part > least_part:
        text = F.regexp_replace(text, rf"0{{0,{most_part - least_part}}}$", "")
        text = F.regexp_replace(text, r"\.$", "")
    body = text
    if least_whole > 1:
        head = F.substring_index(text, ".", 1)
        body = F.concat(F.when(F.length(head) < least_whole, F.lpad(head, least_whole, "0")).otherwise(head), F.substring(text, F.length(head) + 1, F.length(text)))
    out = F.concat(F.when(x < 0, "-").otherwise(""), body)
    return string(F.when(F.isnan(x), "NaN").when(x == core.inf(), "Infinity").when(x == -core.inf(), "-Infinity").otherwise(out))


def encoded(s: Column) -> Column:
    """All but the unreserved characters percent-encoded."""
    return F.replace(F.replace(F.replace(F.url_encode(s), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


@fn("encode-for-uri")
def _encode_uri(c, a):
    return string(encoded(str0(a[0])))


def unescaped(s: Column, chars: str) -> Column:
    for ch in chars:
        s = F.replace(s, F.lit(quote(ch, safe="")), F.lit(ch))
    return s


@fn("iri-to-uri")
def _iri(c, a):
    return string(unescaped(encoded(str0(a[0])), ";/?:@&=+$,#!*'()"))


@fn("escape-html-uri")
def _html_uri(c, a):
    return string(unescaped(encoded(str0(a[0])), ";/?:@&=$,#!*()"))


@fn("resolve-uri", least=1, most=2)
def _resolve(c, a):


    @F.pandas_udf("string")
    def join(rel: pd.Series, base: pd.Series) -> pd.Series:
        return pd.Series([urljoin(b, r) if r else None for r, b in zip(rel, base, strict=True)], dtype=object)

    return string(join(str0(a[0]), str0(a[1]) if len(a) > 1 else F.lit(c.options.base_uri)))


# -- numbers


@fn("number", least=0, most=1)
def _number(c, a):
    return num(F.coalesce(to_num(focus0(c, a)), nan()))


def math1(name: str, build: Callable[[Column], Column]):
    LIBRARY[name] = (1, 1, lambda c, a: num(build(to_num(a[0]))))


math1("abs", F.abs)
math1("floor", lambda x: F.when(F.isnan(x) | (F.abs(x) == core.inf()), x).otherwise(F.floor(x).cast("double")))
math1("ceiling", lambda x: F.when(F.isnan(x) | (F.abs(x) == core.inf()), x).otherwise(F.ceil(x).cast("double")))
math1("math:exp", F.exp)
math1("math:exp10", lambda x: F.pow(F.lit(10.0), x))
math1("math:log", lambda x: F.when(x > 0, F.log(x)).when(x == 0, -core.inf()).when(x.isNotNull(), nan()))
math1("math:log10", lambda x: F.when(x > 0, F.log10(x)).when(x == 0, -core.inf()).when(x.isNotNull(), nan()))
for _name in ("sqrt", "sin", "cos", "tan", "asin", "acos", "atan"):
    math1(f"math:{_name}", getattr(F, _name))


@fn("round", least=1, most=2)
def _round(c, a):
    x = to_num(a[0])
    if len(a) > 1:
        p = literal(a[1], "precision")
        return num(js_round(x * 10.0**p) / 10.0**p)
    return num(F.when(F.isnan(x) | (F.abs(x) == core.inf()), x).otherwise(js_round(x)))


@fn("round-half-to-even", least=1, most=2)
def _half_even(c, a):
    p = 10.0 ** (literal(a[1], "precision") if len(a) > 1 else 0)
    scaled = to_num(a[0]) * p
    low = F.floor(scaled).cast("double")
    up = F.when(scaled - low == 0.5, low + (low % 2 != 0).cast("double")).otherwise(js_round(scaled))
    return num(up / p)


@fn("math:pi", least=0)
def _pi(c, a):
    return num(math.pi)


@fn("math:pow", least=2)
def _pow(c, a):
    return num(F.pow(to_num(a[0]), to_num(a[1])))


@fn("math:atan2", least=2)
def _atan2(c, a):
    return num(F.atan2(to_num(a[0]), to_num(a[1])))


# -- booleans


@fn("true", least=0)
def _true(c, a):
    return boolean(True)


@fn("false", least=0)
def _false(c, a):
    return boolean(False)


@fn("boolean")
def _boolean(c, a):
    return boolean(core.ebv(a[0]))


@fn("not")
def _not(c, a):
    return boolean(~core.ebv(a[0]))


@fn("lang", least=1, most=2)
def _lang(c, a):
    v = F.lower(str0(a[1] if len(a) > 1 else c.variable("lang")))
    t = F.lower(str0(a[0]))
    return boolean((v == t) | F.startswith(v, F.concat(t, F.lit("-"))))


# -- sequences


def size(v: Val) -> Column:
    return F.size(items(v))


@fn("count")
def _count(c, a):
    if c.options.compat and not a[0].many and not a[0].nodes:
        return num(0.0)  # the reference counts only arrays
    if a[0].bounds is not None:
        low, high = a[0].bounds
        return num(F.greatest(high - low + 1, F.lit(0)).cast("double"))
    return num(size(a[0]).cast("double"))


@fn("empty")
def _empty(c, a):
    return boolean(size(a[0]) == 0 if a[0].many else a[0].col.isNull())


@fn("exists")
def _exists(c, a):
    return boolean(size(a[0]) > 0 if a[0].many else a[0].col.isNotNull())


def numbers(v: Val) -> Column:
    return F.transform(items(v), lambda x: to_num(Val(x, v.ty.item)))


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)


def skip_nan(xs: Column) -> Column:
    return F.transform(xs, lambda x: F.when(F.isnan(x), 0.0).otherwise(x))


@fn("sum", least=1, most=2)
def _sum(c, a):
    xs = numbers(a[0])
    out = total(xs if c.options.strict else skip_nan(xs))
    return num(F.when(F.size(xs) == 0, to_num(a[1])).otherwise(out) if len(a) > 1 else out)


@fn("avg")
def _avg(c, a):
    xs = numbers(a[0])
    return num(F.when(F.size(xs) > 0, total(xs if c.options.strict else skip_nan(xs)) / F.size(xs)))


def extreme(pick_one):
    def build(c, a):
        if a[0].kind in core.TEXT_KINDS and c.options.strict:
            return Val(pick_one(items(a[0])), a[0].ty.item)
        xs = numbers(a[0])
        return num(F.when(F.exists(xs, F.isnan), nan()).otherwise(pick_one(xs)))

    return build


LIBRARY["min"], LIBRARY["max"] = (1, 2, extreme(F.array_min)), (1, 2, extreme(F.array_max))


@fn("distinct-values", least=1, most=2)
def _distinct(c, a):
    return Val(F.array_distinct(items(a[0])), a[0].ty.seq)


@fn("reverse")
def _reverse(c, a):
    return Val(F.reverse(items(a[0])), a[0].ty.seq)


def window(v: Val, start: Column, stop: Column) -> Val:
    """The items at positions from start to before stop."""
    return Val(F.filter(items(v), lambda x, i: (i + 1 >= start) & (i + 1 < stop)), v.ty.seq)


@fn("subsequence", least=2, most=3)
def _subsequence(c, a):
    start = js_round(to_num(a[1]))
    return window(a[0], start, start + js_round(to_num(a[2])) if len(a) > 2 else core.inf())


@fn("insert-before", least=3)
def _insert(c, a):
    ty = core.unify([a[0], a[2]])
    xs, ins = items(core.fit(a[0], ty)), items(core.fit(a[2], ty))
    at = F.greatest(F.lit(1), F.least(F.floor(to_num(a[1])).cast("int"), F.size(xs) + 1))
    return Val(F.concat(F.slice(xs, F.lit(1), at - 1), ins, F.slice(xs, at, F.size(xs))), ty.seq)


@fn("remove", least=2)
def _remove(c, a):
    at = F.floor(to_num(a[1]))
    return Val(F.filter(items(a[0]), lambda x, i: i + 1 != at), a[0].ty.seq)


@fn("head")
def _head(c, a):
    return one(a[0])


@fn("tail")
def _tail(c, a):
    return window(a[0], F.lit(2.0), core.inf())


@fn("index-of", least=2, most=3)
def _index_of(c, a):
    xs = F.transform(items(a[0]), lambda x, i: F.when(F.coalesce(core.compare("=", Val(x, a[0].ty.item), one(a[1])), F.lit(False)), (i + 1).cast("double")))
    return Val(F.array_compact(xs), NUM.seq)


@fn("deep-equal", least=2, most=3)
def _deep_equal(c, a):
    if a[0].kind in ("map", "rec", "json") or a[1].kind in ("map", "rec", "json"):
        return boolean(F.coalesce(F.to_json(F.struct(items(a[0]))) == F.to_json(F.struct(items(a[1]))), F.lit(False)))
    same = F.zip_with(items(a[0]), items(a[1]), lambda x, y: F.coalesce(core.compare("=", Val(x, a[0].ty.item), Val(y, a[1].ty.item)), F.lit(False)))
    return boolean((size(a[0]) == size(a[1])) & F.forall(same, lambda x: x))


@fn("unordered")
def _unordered(c, a):
    return a[0]


@fn("data")
def _data(c, a):
    return each(a[0], lambda x: x)


def cardinality(name, code, bad, first):
    def build(c, a):
        v, n = a[0], size(a[0])
        out = one(v) if first else many(v)
        return Val(F.when(bad(n), fail(code, name, out.ty.spark())).otherwise(out.col), out.ty)

    LIBRARY[name] = (1, 1, build)


cardinality("zero-or-one", "XPTY0004", lambda n: n > 1, True)
cardinality("one-or-more", "XPTY0004", lambda n: n == 0, False)
cardinality("exactly-one", "XPTY0004", lambda n: n != 1, True)


def sort_values(v: Val, key: Callable | None, collation: bool) -> Column:
    """Items by key, numbers as numbers; equal keys keep their order."""
    kt: list[Ty] = []

    def pair(x, i):
        k = key([Val(x, v.ty.item)]) if key else Val(x, v.ty.item)
        k = one(k)
        col = k.col if k.kind in ("num", "bool", "date", "ts") else to_str(k)
        kt.append(k.ty)
        return F.struct((F.collate(col, "UNICODE") if collation and k.kind in core.TEXT_KINDS else col).alias("k"), i.alias("i"), x.alias("x"))

    return F.transform(F.sort_array(F.transform(items(v), pair)), lambda p: p["x"])


@fn("sort", least=1, most=3)
def _sort(c, a):
    key = a[2].call if len(a) > 2 else None
    return Val(sort_values(a[0], key, len(a) > 1 and a[1].literal not in (None, "")), a[0].ty.seq)


# -- focus and environment


@fn("position", least=0)
def _position(c, a):
    if c.position is None:
        raise DynamicError("XPDY0002", "no position")
    return num(c.position.cast("double"))


@fn("last", least=0)
def _last(c, a):
    if c.last is None:
        raise DynamicError("XPDY0002", "no size")
    return num(c.last.cast("double"))


@fn("environment-variable")
def _environment(c, a):
    return string(os.environ.get(literal(a[0], "name")))


@fn("available-environment-variables", least=0)
def _environments(c, a):
    return Val(F.array(*map(F.lit, sorted(os.environ))), STR.seq)


@fn("system-property")
def _system_property(c, a):
    known = {"xsl:version": "3.0", "xsl:vendor": "", "xsl:vendor-url": "", **dict(c.options.properties)}
    return string(known.get(literal(a[0], "name"), ""))


@fn("function-available", least=1, most=2)
def _function_available(c, a):
    name = literal(a[0], "name").removeprefix("fn:")
    entry = c.functions.get(name) or LIBRARY.get(name)
    if entry is None or len(a) < 2:
        return boolean(entry is not None or name.startswith("xs:"))
    return boolean(entry[0] <= literal(a[1], "arity") <= entry[1])


@fn("element-available")
def _element_available(c, a):
    # a query has no instructions: hosts that do declare them as properties
    return boolean(literal(a[0], "name") in dict(c.options.properties))


@fn("unparsed-entity-uri")
def _unparsed_entity(c, a):
    # documents are read without external entities
    return string(F.lit(""))


@fn("error", least=0, most=3)
def _error(c, a):
    return string(F.raise_error(F.concat(str0(a[0]) if a else F.lit("FOER0000"), F.lit(": "), str0(a[1]) if len(a) > 1 else F.lit(""))))


@fn("regex-group")
def _regex_group(c, a):
    return string(F.coalesce(F.get(c.variable("regex-groups").col, to_num(a[0]).cast("int")), F.lit("")))


@fn("current-group", least=0)
def _current_group(c, a):
    return c.variables.get("current-group", Val(F.array().cast("array<string>"), STR.seq))


@fn("current-grouping-key", least=0)
def _current_key(c, a):
    return c.variables.get("current-grouping-key", string(""))


# -- QNames


@fn("QName", least=2)
def _qname(c, a):
    u, q = str0(a[0]), str0(a[1])
    bad = ~q.rlike(r"^([\p{L}_][\p{L}\p{N}._-]*:)?[\p{L}_][\p{L}\p{N}._-]*$")
    return Val(F.when(bad, fail("FOCA0002")).when((u == "") & F.contains(q, F.lit(":")), fail("FONS0004")).otherwise(F.concat(F.lit("{"), u, F.lit("}"), q)), Ty("qname"))


@fn("prefix-from-QName")
def _prefix(c, a):
    p = F.regexp_extract(str0(a[0]), r"^(?:\{[^}]*\})?([^:]+):", 1)
    return string(F.when(p != "", p))


@fn("local-name-from-QName")
def _local(c, a):
    return string(F.regexp_extract(str0(a[0]), r"([^:}]*)$", 1))


@fn("namespace-uri-from-QName")
def _uri_of(c, a):
    u = F.regexp_extract(str0(a[0]), r"^\{([^}]*)\}", 1)
    return string(F.when(u != "", u))


# -- functions as values


def callee(v: Val, arity: int) -> Callable:
    if v.call is None:
        raise TypeMismatch("XPTY0004", "not a function")
    if v.arity is not None and v.arity != arity:
        raise TypeMismatch("XPTY0004", f"{v.name or 'function'} takes {v.arity} arguments, not {arity}")
    return v.call


@fn("for-each", least=2)
def _for_each(c, a):
    f = callee(a[1], 1)
    return each(many(a[0]), lambda x: f([x]))


@fn("filter", least=2)
def _filter(c, a):
    f = callee(a[1], 1)
    return Val(F.filter(items(a[0]), lambda x: core.ebv(f([Val(x, a[0].ty.item)]))), a[0].ty.seq)


def fold(v: Val, zero: Val, step: Callable, right: bool) -> Val:
    """Fold with one accumulator type: the zero's, or a number or string if the step's result is one."""
    probe: list[Val] = []

    def run(acc, x):
        out = step(Val(acc, zero.ty), Val(x, v.ty.item))
        probe.append(out)
        return core.fit(out, zero.ty.item).col if out.ty != zero.ty and not zero.many else out.col

    xs = F.reverse(items(v)) if right else items(v)
    start = zero.col.cast(zero.ty.spark()) if zero.kind in ("num", "str", "bool") or zero.many else zero.col
    return Val(F.aggregate(xs, start, run), zero.ty)


@fn("fold-left", "array:fold-left", least=3)
def _fold_left(c, a):
    f = callee(a[2], 2)
    return fold(members(a[0]), a[1], lambda acc, x: f([acc, x]), False)


@fn("fold-right", "array:fold-right", least=3)
def _fold_right(c, a):
    f = callee(a[2], 2)
    return fold(members(a[0]), a[1], lambda acc, x: f([x, acc]), True)


@fn("for-each-pair", least=3)
def _pairs(c, a):
    f = callee(a[2], 2)
    n = F.least(size(a[0]), size(a[1]))
    out: list[Val] = []

    def run(x, y):
        out.append(f([Val(x, a[0].ty.item), Val(y, a[1].ty.item)]))
        return out[-1].col

    col = F.zip_with(F.slice(items(a[0]), F.lit(1), n), F.slice(items(a[1]), F.lit(1), n), run)
    return Val(F.flatten(col), out[-1].ty) if out[-1].many else Val(F.array_compact(col), out[-1].ty.seq)


@fn("apply", least=2)
def _apply(c, a):
    n = a[0].arity
    return callee(a[0], n)([Val(F.get(a[1].col, F.lit(k)), a[1].ty.of or a[1].ty.item) for k in range(n)])


@fn("function-name")
def _function_name(c, a):
    return string(a[0].name)


@fn("function-arity")
def _function_arity(c, a):
    return num(float(a[0].arity))


# -- maps


def as_map(v: Val) -> Val:
    v = one(v)
    if v.kind == "json":
        return Val(F.try_variant_get(v.col, "$", "map<string,variant>"), Ty("map", JSON))
    if v.kind == "rec":
        ty = core.unify([Val(v.col[n], t) for n, t in v.ty.fields])
        pairs = [x for n, t in v.ty.fields for x in (F.lit(n), core.fit(Val(v.col[n], t), ty).col)]
        return Val(F.create_map(*pairs), Ty("map", ty))
    if v.kind != "map":
        raise TypeMismatch("XPTY0004", f"expected a map, found {v.kind}")
    return v


def key_of(v: Val) -> Column:
    return str0(v)


def without(m: Column, k: Column) -> Column:
    return F.map_filter(m, lambda x, _: x != k)


@fn("map:size")
def _map_size(c, a):
    return num(F.size(as_map(a[0]).col).cast("double"))


@fn("map:keys")
def _map_keys(c, a):
    keys = F.map_keys(as_map(a[0]).col)
    # integer-like keys first, ascending, as the reference lists them
    rank = F.transform(keys, lambda k, i: F.struct(F.when(k.rlike("^(0|[1-9][0-9]{0,8})$"), k.cast("int")).otherwise(2147483647).alias("n"), i.alias("i"), k.alias("k")))
    return Val(F.transform(F.sort_array(rank), lambda r: r["k"]), STR.seq)


@fn("map:contains", least=2)
def _map_contains(c, a):
    return boolean(F.map_contains_key(as_map(a[0]).col, key_of(a[1])))


@fn("map:get", least=2)
def _map_get(c, a):
    if a[0].kind == "rec" and a[1].literal is not None:
        return field(a[0], a[1].literal)
    m = as_map(a[0])
    return Val(F.try_element_at(m.col, key_of(a[1])), m.ty.of)


def field(v: Val, name) -> Val:
    text = str(int(name)) if isinstance(name, float) and name == int(name) else str(name)
    kind = dict(v.ty.fields).get(text)
    return core.empty() if kind is None else Val(v.col[text], kind)


@fn("map:put", least=3)
def _map_put(c, a):
    m = as_map(a[0])
    ty = core.unify([Val(m.col, m.ty.of), a[2]])
    old = m.col if m.ty.of == ty else F.transform_values(m.col, lambda _, x: core.fit(Val(x, m.ty.of), ty).col)
    return Val(F.map_concat(without(old, key_of(a[1])), F.create_map(key_of(a[1]), core.fit(a[2], ty).col)), Ty("map", ty))


@fn("map:entry", least=2)
def _map_entry(c, a):
    return Val(F.create_map(key_of(a[0]), a[1].col), Ty("map", a[1].ty))


@fn("map:remove", least=2)
def _map_remove(c, a):
    m = as_map(a[0])
    gone = F.transform(items(a[1]), lambda x: str0(Val(x, a[1].ty.item)))
    return Val(F.map_filter(m.col, lambda k, _: ~F.array_contains(gone, k)), m.ty)


@fn("map:merge", least=1, most=2)
def _map_merge(c, a):
    how = "use-last"
    if len(a) > 1:
        how = {n: v for n, v in zip([n for n, _ in a[1].ty.fields], a[1].literal or [], strict=False)}.get("duplicates", how)
    maps = [as_map(Val(F.get(a[0].col, F.lit(k)), a[0].ty.item)) for k in range(c.parts(a[0]))] if a[0].literal is not None else None
    if maps is None:
        if a[0].kind != "map":
            raise TypeMismatch("XPTY0004", "map:merge of maps of different types")
        kind = a[0].ty.of
        entries = F.flatten(F.transform(items(a[0]), F.map_entries))
    else:
        kind = core.unify([Val(None, m.ty.of) for m in maps])
        entries = F.concat(*(F.map_entries(m.col) for m in maps))
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    of = lambda k: F.transform(F.filter(entries, lambda e: e["key"] == k), lambda e: e["value"])
    if how == "combine":
        return Val(F.map_from_arrays(keys, F.transform(keys, of)), Ty("map", Ty("arr", kind)))
    chosen = F.transform(keys, lambda k: F.get(of(k), F.lit(0)) if how == "use-first" else F.element_at(of(k), -1))
    out = F.map_from_arrays(keys, chosen)
    if how == "reject":
        out = F.when(F.size(keys) == F.size(entries), out).otherwise(fail("XUST0003", kind=Ty("map", kind).spark()))
    return Val(out, Ty("map", kind))


@fn("map:for-each", least=2)
def _map_for_each(c, a):
    m, f, out = as_map(a[0]), callee(a[1], 2), []

    def run(k, v):
        out.append(f([Val(k, STR), Val(v, m.ty.of)]))
        return out[-1].col

    col = F.transform_values(m.col, run)
    return Val(col, Ty("map", out[-1].ty))


# -- arrays


def as_array(v: Val) -> Val:
    if v.kind == "json":
        return Val(F.try_variant_get(one(v).col, "$", "array<variant>"), Ty("arr", JSON))
    if one(v).kind != "arr":
        raise TypeMismatch("XPTY0004", f"expected an array, found {v.kind}")
    return one(v)


def members(v: Val) -> Val:
    """An array's members, or a sequence's items, as a sequence."""
    if v.kind in ("arr",) and not v.many:
        return Val(v.col, v.ty.of.seq)
    return many(v)


def array_of(v: Val, col: Column) -> Val:
    return Val(col, v.ty)


def in_bounds(v: Val, at: Column, out: Column, extra: int = 0, kind: Ty | None = None) -> Column:
    ok = (at >= 1) & (at <= F.size(v.col) + extra)
    return F.when(ok, out).otherwise(fail("FOAY0001", kind=(kind or v.ty).spark()))


@fn("array:size")
def _array_size(c, a):
    return num(F.size(as_array(a[0]).col).cast("double"))


@fn("array:get", least=2)
def _array_get(c, a):
    v, at = as_array(a[0]), to_num(a[1]).cast("int")
    return Val(in_bounds(v, at, F.get(v.col, at - 1), kind=v.ty.of), v.ty.of)


@fn("array:put", least=3)
def _array_put(c, a):
    v, at = as_array(a[0]), to_num(a[1]).cast("int")
    new = core.fit(a[2], v.ty.of).col
    return array_of(v, in_bounds(v, at, F.transform(v.col, lambda x, i: F.when(i + 1 == at, new).otherwise(x))))


@fn("array:append", least=2)
def _array_append(c, a):
    v = as_array(a[0])
    return array_of(v, F.array_append(v.col, core.fit(a[1], v.ty.of).col))


@fn("array:subarray", least=2, most=3)
def _subarray(c, a):
    v, at = as_array(a[0]), to_num(a[1]).cast("int")
    n = to_num(a[2]).cast("int") if len(a) > 2 else F.size(v.col) - at + 1
    ok = (at >= 1) & (at <= F.size(v.col) + 1) & (at + n <= F.size(v.col) + 1)
    out = F.when(n < 0, fail("FOAY0002", kind=v.ty.spark())).when(ok, F.slice(v.col, F.greatest(at, F.lit(1)), F.greatest(n, F.lit(0)))).otherwise(fail("FOAY0001", kind=v.ty.spark()))
    return array_of(v, out)


@fn("array:remove", least=2)
def _array_remove(c, a):
    v = as_array(a[0])
    gone = F.transform(items(a[1]), lambda x: to_num(Val(x, a[1].ty.item)).cast("int"))
    bad = F.exists(gone, lambda p: (p < 1) | (p > F.size(v.col)))
    return array_of(v, F.when(bad, fail("FOAY0001", kind=v.ty.spark())).otherwise(F.filter(v.col, lambda x, i: ~F.array_contains(gone, i + 1))))


@fn("array:insert-before", least=3)
def _array_insert(c, a):
    v, at = as_array(a[0]), to_num(a[1]).cast("int")
    return array_of(v, in_bounds(v, at, F.concat(F.slice(v.col, F.lit(1), F.greatest(at - 1, F.lit(0))), F.array(core.fit(a[2], v.ty.of).col), F.slice(v.col, F.greatest(at, F.lit(1)), F.size(v.col))), 1))


@fn("array:head")
def _array_head(c, a):
    v = as_array(a[0])
    return Val(F.when(F.size(v.col) > 0, F.get(v.col, F.lit(0))).otherwise(fail("FOAY0001", kind=v.ty.of.spark())), v.ty.of)


@fn("array:tail")
def _array_tail(c, a):
    v = as_array(a[0])
    return array_of(v, F.when(F.size(v.col) > 0, F.slice(v.col, F.lit(2), F.size(v.col))).otherwise(fail("FOAY0001", kind=v.ty.spark())))


@fn("array:reverse")
def _array_reverse(c, a):
    v = as_array(a[0])
    return array_of(v, F.reverse(v.col))


@fn("array:join")
def _array_join(c, a):
    if a[0].many:
        return Val(F.flatten(a[0].col), a[0].ty.item)
    return as_array(a[0])


@fn("array:flatten")
def _array_flatten(c, a):
    v = a[0]
    if v.many and v.kind == "arr":
        v = Val(F.flatten(v.col), v.ty.item)
    while v.kind == "arr" and not v.many:
        v = Val(F.flatten(v.col), v.ty.of) if v.ty.of.kind == "arr" else Val(v.col, v.ty.of.seq)
    return many(v)


@fn("array:for-each", least=2)
def _array_for_each(c, a):
    v, f, out = as_array(a[0]), callee(a[1], 1), []

    def run(x):
        out.append(f([Val(x, v.ty.of)]))
        return out[-1].col

    col = F.transform(v.col, run)
    return Val(col, Ty("arr", out[-1].ty))


@fn("array:filter", least=2)
def _array_filter(c, a):
    v, f = as_array(a[0]), callee(a[1], 1)
    return array_of(v, F.filter(v.col, lambda x: core.ebv(f([Val(x, v.ty.of)]))))


@fn("array:sort", least=1, most=3)
def _array_sort(c, a):
    v = as_array(a[0])
    key = a[2].call if len(a) > 2 else None
    return array_of(v, sort_values(members(v), key, len(a) > 1 and a[1].literal not in (None, "")))


# -- JSON


@fn("parse-json", least=1, most=2)
def _parse_json(c, a):
    v = one(a[0])
    bad = F.when(F.try_parse_json(str0(v)).isNull(), fail("FOJS0001", kind="variant"))
    return Val(F.when(v.col.isNotNull(), F.coalesce(F.try_parse_json(to_str(v)), bad)), JSON)


@fn("serialize", least=1, most=2)
def _serialize(c, a):
    v = a[0]
    if v.kind == "fn":
        raise TypeMismatch("FOJS0002")
    if v.many or v.kind in ("arr", "map", "rec", "json"):
        return string(F.to_json(v.col))
    return string(F.to_json(core.to_json(v)))


# -- dates, times, durations


@fn("current-dateTime", least=0)
def _now(c, a):
    return Val(F.lit(c.options.now) if c.options.now else F.current_timestamp(), TS)


@fn("current-date", least=0)
def _today(c, a):
    return Val(F.to_date(_now(c, a).col), DATE)


@fn("current-time", least=0)
def _time(c, a):
    return Val(F.date_format(_now(c, a).col, "HH:mm:ss"), Ty("time"))


@fn("implicit-timezone", least=0)
def _zone(c, a):
    return Val(F.lit("PT0S"), Ty("dur"))


def moment(v: Val) -> Column:
    v = one(v)
    return v.col if v.kind in ("ts", "date") else F.try_to_timestamp(F.regexp_replace(to_str(v), r"(Z|[+-]\d\d:\d\d)$", ""))


for _unit, _f in (("year", F.year), ("month", F.month), ("day", F.dayofmonth), ("hours", F.hour), ("minutes", F.minute)):
    if _unit in ("year", "month", "day"):
        LIBRARY[f"{_unit}-from-date"] = (1, 1, lambda c, a, f=_f: num(f(moment(a[0])).cast("double")))
    LIBRARY[f"{_unit}-from-dateTime"] = (1, 1, lambda c, a, f=_f: num(f(moment(a[0])).cast("double")))
LIBRARY["seconds-from-dateTime"] = (1, 1, lambda c, a: num(F.date_part(F.lit("SECOND"), moment(a[0])).cast("double")))


def piece(pattern: str, group: int, default: float | None = None):
    def build(c, a):
        v = to_str(a[0])
        text = F.regexp_extract(v, pattern, group)
        return num(F.when(v.isNotNull(), F.when(text != "", text.try_cast("double")).otherwise(F.lit(default))))

    return build


CLOCK = r"^(\d\d):(\d\d):(\d\d(?:\.\d+)?)"
for _k, _unit in enumerate(("hours", "minutes", "seconds")):
    LIBRARY[f"{_unit}-from-time"] = (1, 1, piece(CLOCK, _k + 1))
DURATION = r"^-?P(?:(\d+)Y)?(?:(\d+)M)?(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+(?:\.\d+)?)S)?)?$"
for _k, _unit in enumerate(("years", "months", "days", "hours", "minutes", "seconds")):
    LIBRARY[f"{_unit}-from-duration"] = (1, 1, piece(DURATION, _k + 1, 0.0))


@fn("timezone-from-dateTime", "timezone-from-date", "timezone-from-time")
def _timezone(c, a):
    s = to_str(a[0])
    sign, h, m = (F.regexp_extract(s, r"([+-])(\d\d):(\d\d)$", k) for k in (1, 2, 3))
    text = F.concat(F.when((sign == "-"), "-").otherwise(""), F.lit("PT"), h.try_cast("int").cast("string"), F.lit("H"), F.when(m != "00", F.concat(m.try_cast("int").cast("string"), F.lit("M"))).otherwise(""))
    return Val(F.when(F.endswith(s, F.lit("Z")), "PT0S").when(h != "", text), Ty("dur"))


def minutes_of(v: Val) -> Column:
    """A day-time duration in minutes."""
    s = to_str(v)
    part = lambda k: F.coalesce(F.regexp_extract(s, DURATION, k).try_cast("int"), F.lit(0))
    return (part(3) * 1440 + part(4) * 60 + part(5)) * F.when(F.startswith(s, F.lit("-")), -1).otherwise(1)


def adjust(render: str, prefix: str = ""):
    def build(c, a):
        s = F.concat(F.lit(prefix), to_str(a[0]))
        zone = F.regexp_extract(s, r"(Z|[+-]\d\d:\d\d)$", 1)
        plain = F.try_to_timestamp(F.regexp_replace(s, r"(Z|[+-]\d\d:\d\d)$", ""))
        if len(a) > 1 and a[1].kind == "empty":
            return string(F.date_format(plain, render))
        target = minutes_of(a[1]) if len(a) > 1 else F.lit(0)
        now = F.when(zone.isin("", "Z"), 0).otherwise((F.substring(zone, 2, 2).try_cast("int") * 60 + F.substring(zone, 5, 2).try_cast("int")) * F.when(F.startswith(zone, F.lit("-")), -1).otherwise(1))
        shifted = F.when(zone == "", plain).otherwise(F.timestamp_add("MINUTE", target - now, plain))
        hour = F.abs(target)
        offset = F.when(target == 0, "Z").otherwise(F.concat(F.when(target < 0, "-").otherwise("+"), F.format_string("%02d:%02d", F.floor(hour / 60).cast("int"), (hour % 60).cast("int"))))
        return string(F.concat(F.date_format(shifted, render), offset))

    return build


LIBRARY["adjust-dateTime-to-timezone"] = (1, 2, adjust("yyyy-MM-dd'T'HH:mm:ss"))
LIBRARY["adjust-date-to-timezone"] = (1, 2, adjust("yyyy-MM-dd"))
LIBRARY["adjust-time-to-timezone"] = (1, 2, adjust("HH:mm:ss", "2000-01-01T"))


# -- binary


def bytes_of(v: Val, form: str) -> Column:
    return F.unhex(str0(v)) if form == "hex" else F.unbase64(str0(v))


def text_of(b: Column, form: str) -> Val:
    return Val(F.hex(b) if form == "hex" else F.replace(F.base64(b), F.lit("\r\n"), F.lit("")), Ty("hex" if form == "hex" else "b64"))


LIBRARY["hex-to-base64"] = (1, 1, lambda c, a: text_of(bytes_of(a[0], "hex"), "base64"))
LIBRARY["base64-to-hex"] = (1, 1, lambda c, a: text_of(bytes_of(a[0], "base64"), "hex"))
LIBRARY["encode-base64"] = (1, 1, lambda c, a: text_of(F.encode(str0(a[0]), "UTF-8"), "base64"))
LIBRARY["decode-base64"] = (1, 1, lambda c, a: string(F.decode(bytes_of(a[0], "base64"), "UTF-8")))
LIBRARY["encode-hex"] = (1, 1, lambda c, a: text_of(F.encode(str0(a[0]), "UTF-8"), "hex"))
LIBRARY["decode-hex"] = (1, 1, lambda c, a: string(F.decode(bytes_of(a[0], "hex"), "UTF-8")))
LIBRARY["binary-length"] = (2, 2, lambda c, a: num(F.octet_length(bytes_of(a[0], literal(a[1], "format"))).cast("double")))


@fn("binary-concat", least=2)
def _binary_concat(c, a):
    form = literal(a[1], "format")
    joined = F.aggregate(items(a[0]), F.lit(b"").cast("binary"), lambda s, x: F.concat(s, bytes_of(Val(x, a[0].ty.item), form)))
    return text_of(joined, form)


@fn("binary-substring", least=3, most=4)
def _binary_substring(c, a):
    form = literal(a[-1], "format")
    b = bytes_of(a[0], form)
    return text_of(F.substring(b, to_num(a[1]).cast("int"), to_num(a[2]).cast("int") if len(a) > 3 else F.octet_length(b)), form)


# -- CSV and node-free serialization


@fn("parse-csv", least=1, most=2)
def _parse_csv(c, a):
    """Lines of fields; quoted fields with doubled quotes, no line breaks in them."""
    field_ = lambda x: F.when(F.startswith(x, F.lit('"')), F.replace(F.substring(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x)
    cells = lambda line: F.transform(F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(r',("(?:[^"]|"")*"|[^,]*)'), F.lit(1)), field_)
    lines = F.filter(F.split(str0(a[0]), "\r?\n", -1), lambda x: x != "")
    return Val(F.transform(lines, cells), Ty("arr", Ty("arr", STR)))


@fn("serialize-csv", least=1, most=2)
def _serialize_csv(c, a):
    v = as_array(a[0]) if not a[0].many else Val(a[0].col, Ty("arr", a[0].ty.item))
    quoted = lambda s: F.when(s.rlike('[,"\r\n]'), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)
    row = lambda cells, kind: F.array_join(F.transform(cells, lambda x: quoted(str0(Val(x, kind)))), ",")
    if v.ty.of.kind == "arr":
        return string(F.array_join(F.transform(v.col, lambda r: row(r, v.ty.of.of)), "\n"))
    return string(row(v.col, v.ty.of))




# -- trees as text: these need a parser, so they run as Arrow functions


def as_text(build: Callable[[str], str | None], text: Column) -> Val:
    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else build(x) for x in s], dtype=object)

    return string(run(text))


def xml_of_json(text: str) -> str | None:
    """The XML that ``json-to-xml`` gives: elements named after keys, members named item."""
    from xml.sax.saxutils import escape

    from ..sources.shred import json_name

    def element(name: str, v) -> str:
        if isinstance(v, dict):
            inner = "".join(element(json_name(k), x) for k, x in v.items())
        elif isinstance(v, list):
            inner = "".join(element("item", x) for x in v)
        else:
            inner = "" if v is None else escape(v if isinstance(v, str) else json.dumps(v))
        return f"<{name}>{inner}</{name}>" if inner else f"<{name}/>"

    try:
        return element("root", json.loads(text))
    except (ValueError, RecursionError):
        return None


def json_of_xml(text: str) -> str | None:
    from ..sources import serialize, shred

    rows = shred.xml_nodes(text)
    return None if rows is None else serialize.json_text([(r[0], r[3], r[4], r[5], r[8]) for r in rows])


@fn("json-to-xml", least=1, most=2)
def _json_to_xml(c, a):
    return as_text(xml_of_json, to_str(a[0]))


@fn("xml-to-json", least=1, most=2)
def _xml_to_json(c, a):
    return as_text(json_of_xml, to_str(a[0]))


@fn("parse-yaml", least=1, most=2)
def _parse_yaml(c, a):
    from ..sources import serialize

    return Val(F.parse_json(serialize.yaml_to_json(to_str(a[0]))), JSON)


@fn("serialize-yaml", least=1, most=2)
def _serialize_yaml(c, a):
    from ..sources import serialize

    return string(serialize.json_to_yaml(_serialize(c, a[:1]).col))


@fn("serialize-json", "serialize-text", "serialize-xml", "serialize-html", least=1, most=2)
def _serialize_value(c, a):
    return _serialize(c, a[:1]) if a[0].many or a[0].kind in ("arr", "map", "rec", "json") else string(str0(a[0]))
