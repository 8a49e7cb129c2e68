"""Values of the column lane: a Column with a static type, and the language's coercions.

Numbers are doubles. An empty sequence is NULL, or an empty array where many items are possible. JSON stays VARIANT.
Types that Spark lacks are kept as validated strings: time, duration, gYear and so on, QName, hexBinary, base64Binary.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import TypeMismatch

TEXT_KINDS = ("str", "time", "dur", "gYear", "gYearMonth", "gMonth", "gMonthDay", "gDay", "qname", "hex", "b64", "uri", "untyped")


@dataclass(frozen=True)
class Ty:
    """kind: num, str, bool, date, ts, json, arr, map, rec, fn, empty or another of TEXT_KINDS; of: members' type."""

    kind: str
    of: Ty | None = None
    many: bool = False
    fields: tuple = ()

    @property
    def item(self) -> Ty:
        return replace(self, many=False)

    @property
    def seq(self) -> Ty:
        return replace(self, many=True)

    def spark(self) -> str:
        """DDL of the column."""
        one = {"num": "double", "bool": "boolean", "date": "date", "ts": "timestamp", "json": "variant", "empty": "void"}.get(self.kind, "string")
        if self.kind == "arr":
            one = f"array<{self.of.spark()}>"
        elif self.kind == "map":
            one = f"map<string,{self.of.spark()}>"
        elif self.kind == "rec":
            one = "struct<" + ",".join(f"`{n}`:{t.spark()}" for n, t in self.fields) + ">"
        return f"array<{one}>" if self.many else one


NUM, STR, BOOL, DATE, TS, JSON, EMPTY = (Ty(k) for k in ("num", "str", "bool", "date", "ts", "json", "empty"))


@dataclass(frozen=True)
class Val:
    col: Column | None
    ty: Ty
    call: Callable | None = None
    arity: int | None = None
    name: str | None = None
    literal: object = None
    #: The value stands for nodes: true if there is any.
    nodes: bool = False
    #: First and last number of a range.
    bounds: tuple | None = None

    @property
    def many(self) -> bool:
        return self.ty.many

    @property
    def kind(self) -> str:
        return self.ty.kind


def num(col) -> Val:
    return Val(col if isinstance(col, Column) else F.lit(float(col)), NUM, literal=None if isinstance(col, Column) else float(col))


def string(col) -> Val:
    return Val(col if isinstance(col, Column) else F.lit(col), STR, literal=None if isinstance(col, Column) else col)


def boolean(col) -> Val:
    return Val(col if isinstance(col, Column) else F.lit(col), BOOL)


def empty() -> Val:
    return Val(F.lit(None), EMPTY)


def of_spark(col: Column, kind: T.DataType) -> Val:
    """A column of a table as a value."""
    ty = ty_of(kind)
    if ty.kind == "num":
        col = col.cast(ty.spark())
    elif ty.kind == "map" or (ty.kind == "arr" and ty.of.kind == "num"):
        col = col.cast(ty.spark())
    return Val(col, ty)


def ty_of(kind: T.DataType) -> Ty:
    if isinstance(kind, T.NumericType):
        return NUM
    if isinstance(kind, T.BooleanType):
        return BOOL
    if isinstance(kind, T.DateType):
        return DATE
    if isinstance(kind, T.TimestampType | T.TimestampNTZType):
        return TS
    if isinstance(kind, T.VariantType):
        return JSON
    if isinstance(kind, T.ArrayType):
        return Ty("arr", ty_of(kind.elementType))
    if isinstance(kind, T.MapType):
        return Ty("map", ty_of(kind.valueType))
    if isinstance(kind, T.StructType):
        return Ty("rec", fields=tuple((f.name, ty_of(f.dataType)) for f in kind))
    return STR


# -- shape


def one(v: Val) -> Val:
    """The first item."""
    return Val(F.get(v.col, F.lit(0)), v.ty.item) if v.many else v


def items(v: Val) -> Column:
    """All items as an array."""
    if v.many:
        return v.col
    if v.kind == "empty":
        return F.array()
    return F.array_compact(F.array(v.col))


def many(v: Val) -> Val:
    return v if v.many else Val(items(v), v.ty.seq)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once for each row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def each(v: Val, body: Callable[[Val], Val], compact: bool = True) -> Val:
    """The items' results, concatenated."""
    inner: list[Val] = []

    def run(x: Column) -> Column:
        out = body(Val(x, v.ty.item))
        inner.append(out)
        return out.col

    if not v.many:
        return body(v)
    col = F.transform(v.col, run)
    out = inner[-1]
    if out.many:
        return Val(F.flatten(col), out.ty)
    return Val(F.array_compact(col) if compact else col, out.ty.seq)


def unify(values: list[Val]) -> Ty:
    """The least type that all values fit; numbers and other kinds together become strings."""
    kinds = {v.kind for v in values if v.kind != "empty"}
    if not kinds:
        return EMPTY
    if len(kinds) == 1:
        first = next(v.ty.item for v in values if v.kind != "empty")
        if all(v.ty.item == first for v in values if v.kind != "empty"):
            return first
        if first.kind in ("arr", "map") and {v.ty.of.kind for v in values if v.kind != "empty"} <= {"num", "empty"}:
            return Ty(first.kind, NUM)
        return JSON
    if "json" in kinds or kinds & {"arr", "map", "rec"}:
        return JSON
    return STR


def fit(v: Val, ty: Ty) -> Val:
    """A value in a type that ``unify`` found for it."""
    if v.kind == "empty" or v.ty.item == ty:
        return Val(v.col.cast(replace(ty, many=v.many).spark()), replace(ty, many=v.many)) if v.kind == "empty" else v
    if ty.kind == "str":
        return each(v, lambda x: Val(to_str(x), STR))
    if ty.kind == "json":
        return each(v, lambda x: Val(to_json(x), JSON))
    return Val(v.col.cast(replace(ty, many=v.many).spark()), replace(ty, many=v.many))


# -- coercions

NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
SPACE = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]+"


def inf() -> Column:
    return F.lit(float("inf"))


def nan() -> Column:
    return F.lit(float("nan"))


def parse_number(text: Column) -> Column:
    """The number that a string spells, else NaN; NULL stays."""
    t = F.trim(text)
    spelled = F.when(t.rlike(NUMBER), t.try_cast("double")).when(t.isin("INF", "Infinity", "+INF"), inf()).when(t.isin("-INF", "-Infinity"), -inf())
    return F.when(text.isNotNull(), spelled.otherwise(nan()))


def to_num(v: Val) -> Column:
    """A number; NULL for an empty sequence."""
    v = one(v)
    if v.kind == "num":
        return v.col
    if v.kind == "bool":
        return v.col.cast("double")
    if v.kind == "json":
        return F.when(v.col.isNotNull(), F.coalesce(F.try_variant_get(v.col, "$", "double"), parse_number(F.try_variant_get(v.col, "$", "string")), nan()))
    if v.kind == "empty":
        return F.lit(None).cast("double")
    if v.kind in TEXT_KINDS:
        return parse_number(v.col)
    if v.kind == "ts":
        return F.unix_millis(v.col).cast("double")
    return F.when(v.col.isNotNull(), nan())


def num_str(x: Column) -> Column:
    """A number as the language prints it: no point for whole numbers, NaN, INF, -INF."""
    whole = (F.abs(x) < 1e21) & (x == F.rint(x))
    return F.when(F.isnan(x), "NaN").when(x == inf(), "INF").when(x == -inf(), "-INF").when(whole, x.cast("decimal(38,0)").cast("string")).otherwise(F.regexp_replace(F.regexp_replace(x.cast("string"), r"\.0E", "E"), r"E(\d)", "e+$1"))


def to_str(v: Val) -> Column:
    """A string; NULL for an empty sequence."""
    v = one(v)
    if v.kind in TEXT_KINDS:
        return v.col
    if v.kind == "num":
        return num_str(v.col)
    if v.kind == "bool":
        return v.col.cast("string")
    if v.kind == "ts":
        return F.regexp_replace(F.date_format(v.col, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.?0+$", "")
    if v.kind == "date":
        return F.date_format(v.col, "yyyy-MM-dd")
    if v.kind == "json":
        number = F.try_variant_get(v.col, "$", "double")
        return F.when(F.schema_of_variant(v.col).isin("BIGINT", "DOUBLE") | F.schema_of_variant(v.col).startswith("DECIMAL"), num_str(number)).otherwise(F.try_variant_get(v.col, "$", "string"))
    if v.kind == "empty":
        return F.lit(None).cast("string")
    if v.kind == "fn":
        raise TypeMismatch("FOTY0012", "a function has no string value")
    return F.to_json(v.col)


def str0(v: Val) -> Column:
    """A string; '' for an empty sequence."""
    return F.coalesce(to_str(v), F.lit(""))


def to_json(v: Val) -> Column:
    if v.kind == "json":
        return v.col
    if v.kind in ("arr", "map", "rec"):
        return F.parse_json(F.to_json(v.col)) if v.kind != "arr" or v.ty.of.kind not in TEXT_KINDS else F.parse_json(F.to_json(v.col))
    col = num_str(v.col) if v.kind == "num" else to_str(v)
    text = F.when(F.isnan(v.col) | (F.abs(v.col) == inf()), "null").otherwise(col) if v.kind == "num" else col if v.kind == "bool" else F.concat(F.lit('"'), F.replace(F.replace(F.replace(col, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit('"'))
    return F.when(v.col.isNotNull(), F.parse_json(text))


def ebv(v: Val) -> Column:
    """Effective boolean value; never NULL. Many items are true if there is any; one item goes by its own value."""
    if v.nodes:
        return F.size(v.col) > 0 if v.many else v.col.isNotNull()
    if v.many:
        # a sequence of one value goes by the value, as after a filter
        if v.kind in ("num", "str", "bool"):
            first = ebv(one(v))
            return F.when(F.size(v.col) == 1, first).otherwise(F.size(v.col) > 0)
        return F.size(v.col) > 0
    if v.kind == "empty":
        return F.lit(False)
    if v.kind == "bool":
        return F.coalesce(v.col, F.lit(False))
    if v.kind == "num":
        return F.coalesce((v.col != 0) & ~F.isnan(v.col), F.lit(False))
    if v.kind in TEXT_KINDS:
        return F.coalesce(F.length(v.col) > 0, F.lit(False))
    if v.kind == "json":
        kind = F.schema_of_variant(v.col)
        truth = F.when(kind == "BOOLEAN", F.try_variant_get(v.col, "$", "boolean")).when(kind == "STRING", F.length(F.try_variant_get(v.col, "$", "string")) > 0).when(kind == "VOID", False).when(kind.rlike("^(BIGINT|DOUBLE|DECIMAL)"), F.try_variant_get(v.col, "$", "double") != 0).otherwise(True)
        return F.coalesce(truth, F.lit(False))
    return v.col.isNotNull() if v.col is not None else F.lit(True)


# -- comparison

SYMBOL = {"eq": "=", "ne": "!=", "lt": "<", "le": "<=", "gt": ">", "ge": ">="}


def compare(op: str, a: Val, b: Val, ordered_text: bool = False) -> Column:
    """Two single values. Numbers never equal NaN; < and the like compare text as numbers unless ``ordered_text``."""
    op = SYMBOL.get(op, op)
    if "empty" in (a.kind, b.kind):
        return F.lit(None).cast("boolean")
    if a.kind == "bool" or b.kind == "bool":
        x, y = (v.col if v.kind == "bool" else ebv(v) for v in (a, b))
        if op not in ("=", "!="):
            x, y = x.cast("double"), y.cast("double")
    elif a.kind == b.kind and a.kind in ("date", "ts", "arr", "rec"):
        x, y = a.col, b.col
    elif "num" in (a.kind, b.kind) or (op not in ("=", "!=") and not ordered_text and not {a.kind, b.kind} & {"date", "ts"}):
        x, y = to_num(a), to_num(b)
        out = {"=": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
        return (out | F.isnan(x) | F.isnan(y)) if op == "!=" else (out & ~F.isnan(x) & ~F.isnan(y))
    else:
        x, y = to_str(a), to_str(b)
    return {"=": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]


def general(op: str, a: Val, b: Val) -> Column:
    """True if any pair of items compares; an empty side is false. Nodes compare with a boolean by their existence."""
    if a.kind == "bool" and not a.many and b.nodes:
        b = boolean(ebv(b))
    elif b.kind == "bool" and not b.many and a.nodes:
        a = boolean(ebv(a))
    if a.many and b.many:
        if op == "=" and a.ty == b.ty and a.kind in ("str", "date"):
            return F.coalesce(F.arrays_overlap(a.col, b.col), F.lit(False))
        out = F.exists(a.col, lambda x: F.exists(b.col, lambda y: F.coalesce(compare(op, Val(x, a.ty.item), Val(y, b.ty.item)), F.lit(False))))
    elif a.many:
        out = F.exists(a.col, lambda x: F.coalesce(compare(op, Val(x, a.ty.item), b), F.lit(False)))
    elif b.many:
        out = F.exists(b.col, lambda y: F.coalesce(compare(op, a, Val(y, b.ty.item)), F.lit(False)))
    else:
        out = compare(op, a, b)
    return F.coalesce(out, F.lit(False))


def js_round(x: Column) -> Column:
    """Half towards plus infinity."""
    return F.when(F.isnan(x) | (F.abs(x) >= 1e15), x).otherwise(F.floor(x + 0.5).cast("double"))


def clip_int(x: Column) -> Column:
    """A whole double as an int, cut at the int range."""
    return F.when(F.isnan(x), 0).otherwise(F.greatest(F.least(x, F.lit(2147483647.0)), F.lit(-2147483648.0)).cast("int"))
