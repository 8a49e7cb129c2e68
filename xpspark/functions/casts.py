"""Constructors, casts and tests of types.

A lexical check comes first and the cast itself never raises, so a failed cast is either FORG0001 or, in ``castable``
and ``try``, NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import StaticError, TypeMismatch, fail
from ..plans import ast as A
from . import core
from .core import BOOL, DATE, NUM, STR, TS, Ty, Val, boolean, items, one, to_num, to_str

ZONE = r"(Z|[+-]\d\d:\d\d)?"
#: Fixed lexical forms of the types that are kept as strings.
LEXICAL = {
    "duration": ("dur", r"^-?P(?=.)(\d+Y)?(\d+M)?(\d+D)?(T(?=.)(\d+H)?(\d+M)?(\d+(\.\d+)?S)?)?$"),
    "dayTimeDuration": ("dur", r"^-?P(?=.)(\d+D)?(T(?=.)(\d+H)?(\d+M)?(\d+(\.\d+)?S)?)?$"),
    "yearMonthDuration": ("dur", r"^-?P(?=.)(\d+Y)?(\d+M)?$"),
    "time": ("time", rf"^([01]\d|2[0-3]):[0-5]\d:[0-5]\d(\.\d+)?{ZONE}$"),
    "gYearMonth": ("gYearMonth", rf"^-?\d{{4,}}-(0[1-9]|1[0-2]){ZONE}$"),
    "gYear": ("gYear", rf"^-?\d{{4,}}{ZONE}$"),
    "gMonthDay": ("gMonthDay", rf"^--(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01]){ZONE}$"),
    "gDay": ("gDay", rf"^---(0[1-9]|[12]\d|3[01]){ZONE}$"),
    "gMonth": ("gMonth", rf"^--(0[1-9]|1[0-2]){ZONE}$"),
    "hexBinary": ("hex", r"^([0-9A-Fa-f]{2})*$"),
    "base64Binary": ("b64", r"^([A-Za-z0-9+/]{4})*([A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$"),
    "anyURI": ("uri", r"^.*$"),
    "QName": ("qname", r"^([\p{L}_][\p{L}\p{N}._-]*:)?[\p{L}_][\p{L}\p{N}._-]*$"),
}
#: Fixed ranges of the integer types; long and unsignedLong stop where doubles stop being exact.
EXACT = 2**53 - 1
RANGES = {
    "integer": (None, None), "long": (-EXACT, EXACT), "int": (-(2**31), 2**31 - 1), "short": (-(2**15), 2**15 - 1), "byte": (-128, 127),
    "nonPositiveInteger": (None, 0), "negativeInteger": (None, -1), "nonNegativeInteger": (0, None), "positiveInteger": (1, None),
    "unsignedLong": (0, EXACT), "unsignedInt": (0, 2**32 - 1), "unsignedShort": (0, 2**16 - 1), "unsignedByte": (0, 255),
}
NUMERIC = {"decimal", "float", "double", *RANGES}
PREFIX = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"


def prefix_number(v: Val) -> Column:
    """The number that a text begins with, NULL if none."""
    if one(v).kind in ("num", "bool"):
        return to_num(v)
    text = to_str(v)
    spelled = F.when(F.trim(text) == "NaN", core.nan()).when(F.trim(text).isin("INF", "+INF"), core.inf()).when(F.trim(text) == "-INF", -core.inf())
    return spelled.otherwise(F.regexp_extract(text, PREFIX, 1).try_cast("double"))


def attempt(name: str, v: Val, whole: bool = False) -> Val:
    """The cast, NULL where it fails. ``whole``: numbers must be spelled in full."""
    v = one(v)
    text = to_str(v)
    if name in ("string", "untypedAtomic", "anyAtomicType"):
        return Val(text, STR)
    if name == "boolean":
        if v.kind in ("bool", "num"):
            return Val(core.ebv(v) if v.kind == "num" else v.col, BOOL)
        t = F.lower(F.trim(text))
        return Val(F.when(t.isin("true", "1"), True).when(t.isin("false", "0"), False), BOOL)
    if name in NUMERIC:
        x = F.when(F.trim(text).rlike(core.NUMBER) | F.trim(text).isin("INF", "-INF", "NaN") | F.lit(v.kind in ("num", "bool")), prefix_number(v)) if whole else prefix_number(v)
        finite = ~F.isnan(x) & (F.abs(x) != core.inf())
        if name in ("float", "double"):
            return Val(x, NUM)
        if name == "decimal":
            return Val(F.when(finite, x), NUM)
        n = F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double")
        low, high = RANGES[name]
        ok = finite
        if low is not None:
            ok = ok & (n >= low)
        if high is not None:
            ok = ok & (n <= high)
        return Val(F.when(ok, n), NUM)
    if name == "dateTime":
        return Val(v.col.cast("timestamp") if v.kind in ("ts", "date") else F.when(F.trim(text).rlike(rf"^-?\d{{4}}-\d\d-\d\d(T\d\d:\d\d(:\d\d(\.\d+)?)?{ZONE})?$"), F.try_to_timestamp(F.trim(text))), TS)
    if name == "date":
        day = F.regexp_replace(F.trim(text), r"(Z|[+-]\d\d:\d\d)$", "")
        return Val(v.col.cast("date") if v.kind in ("ts", "date") else F.when(day.rlike(r"^-?\d{4}-\d\d-\d\d(T.*)?$"), F.substring(day, 1, 10).try_cast("date")), DATE)
    if name in LEXICAL:
        kind, form = LEXICAL[name]
        t = F.trim(text)
        out = F.upper(t) if kind == "hex" else t
        return Val(F.when(t.rlike(form), out), Ty(kind))
    raise StaticError("XPST0051", name)


def construct(name: str, v: Val) -> Val:
    """``xs:name(v)``: exactly one item, else XPTY0004; FORG0001 if it can't be cast."""
    out = attempt(name, v)
    bad = fail("FORG0001", f"not xs:{name}", out.ty.spark())
    if v.many:
        return Val(F.when(F.size(v.col) != 1, fail("XPTY0004", f"xs:{name}", out.ty.spark())).otherwise(F.coalesce(out.col, bad)), out.ty)
    if v.kind == "empty":
        return Val(fail("XPTY0004", f"xs:{name}", out.ty.spark()), out.ty)
    return Val(F.when(v.col.isNotNull(), F.coalesce(out.col, bad)), out.ty)


def cast(v: Val, ty: A.SeqType) -> Val:
    return construct(ty.item, v)


def castable(v: Val, ty: A.SeqType) -> Column:
    n = F.size(items(v)) if v.kind != "empty" else F.lit(0)
    ok = attempt(ty.item, v, whole=True).col.isNotNull()
    return F.when(n == 1, ok).otherwise((n == 0) & F.lit(ty.occurrence == "?"))


KINDS = {"string": {"str", "untyped", "time", "uri"}, "boolean": {"bool"}, "date": {"date"}, "dateTime": {"ts"}, "duration": {"dur"}, "time": {"time"}, "hexBinary": {"hex"}, "base64Binary": {"b64"}, "anyURI": {"uri"}, "QName": {"qname"}, "untypedAtomic": {"untyped"}}
NODE_KINDS = {"node", "element", "attribute", "text", "comment", "processing-instruction", "document-node", "schema-element", "schema-attribute"}


def item_matches(v: Val, ty: A.SeqType) -> Column:
    """True if a single value is of an item type."""
    name = ty.item
    if name in ("item", "anyAtomicType"):
        return F.lit(name == "item" or v.kind not in ("arr", "map", "rec", "fn"))
    if name == "union":
        out = F.lit(False)
        for t in ty.params:
            out = out | item_matches(v, t)
        return out
    if name == "function":
        return F.lit(v.kind in ("fn", "map", "rec", "arr") and (not ty.params or v.arity in (None, len(ty.params) - 1, len(ty.params))))
    if name == "map":
        if v.kind == "json":
            return F.schema_of_variant(v.col).startswith("OBJECT")
        if v.kind not in ("map", "rec"):
            return F.lit(False)
        if len(ty.params) < 2:
            return F.lit(True)
        if v.kind == "rec":
            out = F.lit(True)
            for n, t in v.ty.fields:
                out = out & matches(Val(v.col[n], t), ty.params[1])
            return out
        return F.forall(F.map_values(v.col), lambda x: matches(Val(x, v.ty.of), ty.params[1]))
    if name == "array":
        if v.kind == "json":
            return F.schema_of_variant(v.col).startswith("ARRAY")
        return F.lit(v.kind == "arr") if not ty.params or v.kind != "arr" else F.forall(v.col, lambda x: matches(Val(x, v.ty.of), ty.params[0]))
    if name in NUMERIC:
        if v.kind == "json":
            return F.try_variant_get(v.col, "$", "double").isNotNull() & ~F.schema_of_variant(v.col).isin("STRING", "BOOLEAN")
        if v.kind != "num":
            return F.lit(False)
        if name in ("double", "float", "decimal"):
            return F.lit(True) if name != "decimal" else ~F.isnan(v.col) & (F.abs(v.col) != core.inf())
        low, high = RANGES[name]
        ok = v.col == F.floor(v.col)
        ok = ok & (v.col >= low) if low is not None else ok
        return ok & (v.col <= high) if high is not None else ok
    if name in NODE_KINDS:
        return F.lit(v.kind == "node")
    if name not in KINDS and name not in LEXICAL:
        raise StaticError("XPST0051", name)
    if v.kind == "json":
        want = {"string": "STRING", "boolean": "BOOLEAN"}.get(name)
        return F.schema_of_variant(v.col) == want if want else F.lit(False)
    return F.lit(v.kind in KINDS.get(name, {LEXICAL.get(name, ("",))[0]}))


def matches(v: Val, ty: A.SeqType) -> Column:
    """True if a value, as a sequence, is of a sequence type."""
    if v.kind == "fn":
        return item_matches(v, ty)
    n = F.size(items(v)) if v.kind != "empty" else F.lit(0)
    if ty.item == "empty-sequence":
        return n == 0
    least, most = {"": (1, 1), "?": (0, 1), "*": (0, None), "+": (1, None)}[ty.occurrence]
    ok = n >= least
    if most is not None:
        ok = ok & (n <= most)
    if v.kind == "empty":
        return ok
    each = F.forall(v.col, lambda x: item_matches(Val(x, v.ty.item), ty)) if v.many else F.coalesce(item_matches(v, ty), F.lit(False)) | v.col.isNull()
    return F.coalesce(ok & each, F.lit(False))


def instance(v: Val, ty: A.SeqType) -> Column:
    return matches(v, ty)


def treat(v: Val, ty: A.SeqType) -> Val:
    return v if v.kind == "fn" else Val(F.when(matches(v, ty), v.col).otherwise(fail("XPDY0050", str(ty), v.ty.spark())), v.ty)


def shift(v: Val, duration: Val, sign: int) -> Val:
    """A date or dateTime plus or minus a duration."""
    s = duration.col
    form = r"^-?P(?:(\d+)Y)?(?:(\d+)M)?(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+(?:\.\d+)?)S)?)?$"
    part = lambda k, t: F.coalesce(F.regexp_extract(s, form, k).try_cast(t), F.lit(0).cast(t)) * F.when(F.startswith(s, F.lit("-")), -sign).otherwise(sign)
    seconds = part(6, "decimal(18,6)")
    moved = v.col.cast("timestamp") + F.make_interval(part(1, "int"), part(2, "int"), F.lit(0), part(3, "int"), part(4, "int"), part(5, "int"), seconds)
    return Val(moved.cast("date") if v.kind == "date" else moved, v.ty)


def safe(c, n: A.Node) -> Val:
    """The value of an expression, NULL on rows where it would raise."""
    if isinstance(n, A.TypeOp) and n.op == "cast as":
        return attempt(n.type.item, safe(c, n.operand))
    if isinstance(n, A.Call) and n.name.startswith("xs:") and len(n.args) == 1:
        return attempt(n.name[3:], safe(c, n.args[0]))
    if isinstance(n, A.Call) and n.name.removeprefix("fn:") == "parse-json":
        return Val(F.try_parse_json(to_str(safe(c, n.args[0]))), core.JSON)
    if isinstance(n, A.Call) and n.name.removeprefix("fn:") == "error":
        return Val(F.lit(None).cast("string"), STR)
    if isinstance(n, A.Call) and n.name == "array:get":
        v = safe(c, n.args[0])
        return Val(F.get(v.col, to_num(safe(c, n.args[1])).cast("int") - 1), v.ty.of)
    if isinstance(n, A.Bin) and n.op in ("idiv", "mod", "+", "-", "*", "div"):
        a, b = safe(c, n.left), safe(c, n.right)
        if n.op in ("idiv", "mod"):
            y = to_num(b)
            b = Val(F.when(y != 0, y), NUM)
        return c.arithmetic(n.op, a, b)
    if isinstance(n, A.Bin) and n.op in core.SYMBOL:
        return boolean(core.compare(n.op, one(safe(c, n.left)), one(safe(c, n.right)), ordered_text=True))
    if isinstance(n, A.If):
        return c.choose(core.ebv(safe(c, n.test)), safe(c, n.then), safe(c, n.other))
    if isinstance(n, A.Lookup) and n.key is not None:
        v = safe(c, n.base) if n.base is not None else c.focus
        if v.kind == "arr":
            return Val(F.get(v.col, to_num(c.compile(n.key)).cast("int") - 1), v.ty.of)
    if isinstance(n, A.Num | A.Str | A.Var | A.Context | A.Path):
        return c.compile(n)
    if isinstance(n, A.Call):
        return c.resolve(n.name, len(n.args))([safe(c, a) for a in n.args])
    if any(isinstance(x, A.TypeOp | A.Call) for x in n.children()):
        raise TypeMismatch("XPTY0004", f"try around {type(n).__name__} is not supported")
    return c.compile(n)
