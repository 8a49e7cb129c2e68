"""Schema validation of nodes: declarations become conditions on rows, results become columns.

Declarations come from objects or from a small part of XSD: named elements and attributes with a built-in type, simple
types with facets, nillable. Nodes without a declaration are valid. ``validate`` adds ``type_name, is_valid, is_nilled,
typed_value, errors`` to element and attribute rows, which is the schema-checked view of a document.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .errors import StaticError
from .functions import casts
from .functions.core import Val
from .functions.core import STR as TEXT_TYPE
from .operators.nodes import ATTRIBUTE, ELEMENT

XS = "{http://www.w3.org/2001/XMLSchema}"
FACETS = ("enumeration", "minInclusive", "maxInclusive", "minExclusive", "maxExclusive", "minLength", "maxLength", "pattern")


@dataclass
class SimpleType:
    """A built-in base with facets; enumeration and pattern hold lists."""

    base: str = "string"
    facets: dict[str, object] = field(default_factory=dict)


@dataclass
class Declaration:
    name: str
    type: str | SimpleType = "string"
    nillable: bool = False
    required: tuple[str, ...] = ()
    children: tuple[str, ...] | None = None


@dataclass
class Schema:
    elements: dict[str, Declaration] = field(default_factory=dict)
    attributes: dict[str, Declaration] = field(default_factory=dict)
    types: dict[str, SimpleType] = field(default_factory=dict)

    def type_of(self, d: Declaration) -> SimpleType:
        if isinstance(d.type, SimpleType):
            return d.type
        return self.types.get(d.type) or SimpleType(d.type)


def local(name: str) -> str:
    return name.rpartition(":")[2]


def from_xsd(text: str) -> Schema:
    """A schema from XSD text; content models are reduced to the names of children."""
    try:
        root = ET.fromstring(text)
    except ET.ParseError as e:
        raise StaticError("XPST0001", f"not an XSD: {e}") from e
    schema = Schema()

    def simple(node) -> SimpleType:
        restriction = node.find(f"{XS}restriction")
        facets: dict[str, object] = {}
        for f in restriction:
            name = f.tag.removeprefix(XS)
            if name in ("enumeration", "pattern"):
                facets.setdefault(name, []).append(f.get("value"))
            elif name in FACETS:
                facets[name] = float(f.get("value"))
        return SimpleType(local(restriction.get("base")), facets)

    for t in root.iter(f"{XS}simpleType"):
        if t.get("name"):
            schema.types[t.get("name")] = simple(t)
    for kind, target in (("element", schema.elements), ("attribute", schema.attributes)):
        for e in root.iter(f"{XS}{kind}"):
            if not e.get("name"):
                continue
            inline, model = e.find(f"{XS}simpleType"), e.find(f"{XS}complexType")
            children = tuple(c.get("name") or local(c.get("ref")) for c in model.iter(f"{XS}element")) if model is not None and next(model.iter(f"{XS}element"), None) is not None else None
            required = tuple(a.get("name") for a in model.iter(f"{XS}attribute") if a.get("use") == "required") if model is not None else ()
            type_ = simple(inline) if inline is not None else local(e.get("type") or ("anyType" if model is not None else "string"))
            target[e.get("name")] = Declaration(e.get("name"), type_, e.get("nillable") == "true", required, children)
    return schema


def facet(name: str, limit, text: Column, number: Column) -> Column:
    if name == "enumeration":
        return text.isin(*limit)
    if name == "pattern":
        out = F.lit(False)
        for p in limit:
            out = out | text.rlike(f"^(?:{p})$")
        return out
    size = F.length(text)
    return {"minInclusive": number >= limit, "maxInclusive": number <= limit, "minExclusive": number > limit, "maxExclusive": number < limit, "minLength": size >= limit, "maxLength": size <= limit}[name]


def checks(schema: Schema, d: Declaration, text: Column) -> list[tuple[str, Column]]:
    """What has to hold of a simple value."""
    t = schema.type_of(d)
    if t.base in ("anyType", "anySimpleType"):
        return []
    base = t.base
    facets = dict(t.facets)
    while base in schema.types:
        facets = schema.types[base].facets | facets
        base = schema.types[base].base
    value = casts.attempt(base, Val(text, TEXT_TYPE), whole=True).col
    out = [(f"not xs:{base}", value.isNotNull())]
    number = casts.attempt("double", Val(text, TEXT_TYPE), whole=True).col
    return out + [(f"{name} {limit}", F.coalesce(facet(name, limit, text, number), F.lit(False))) for name, limit in facets.items()]


def validate(nodes: DataFrame, schema: Schema) -> DataFrame:
    """Element and attribute rows with their type, validity and errors."""
    kind, name, text = F.col("kind"), F.col("local"), F.col("str_val")
    kids = nodes.where(kind.isin(ELEMENT, ATTRIBUTE)).groupBy(F.col("doc_id").alias("k_doc"), F.col("parent").alias("k_pre")).agg(
        F.collect_set(F.when(kind == ELEMENT, name)).alias("__kids"), F.collect_set(F.when(kind == ATTRIBUTE, name)).alias("__own"), F.max(F.when((kind == ATTRIBUTE) & (name == "nil"), text)).alias("__nil")
    )
    rows = nodes.where(kind.isin(ELEMENT, ATTRIBUTE)).join(kids, (F.col("doc_id") == F.col("k_doc")) & (F.col("pre") == F.col("k_pre")), "left").drop("k_doc", "k_pre")
    empty = F.array().cast("array<string>")
    nilled = F.coalesce(F.col("__nil").isin("true", "1"), F.lit(False))
    type_name, errors, typed = F.lit(None).cast("string"), empty, F.lit(None).cast("string")
    for of, declared in ((ELEMENT, schema.elements), (ATTRIBUTE, schema.attributes)):
        for d in declared.values():
            here = (kind == of) & (name == d.name)
            failed = [F.when(~ok, F.lit(message)) for message, ok in checks(schema, d, text)] if d.children is None else []
            if d.children is not None:
                failed.append(F.when(F.size(F.array_except(F.coalesce("__kids", empty), F.array(*map(F.lit, d.children)))) > 0, F.lit("unexpected child")))
            failed += [F.when(~F.array_contains(F.coalesce("__own", empty), a), F.lit(f"missing @{a}")) for a in d.required]
            found = F.array_compact(F.array(*failed)) if failed else empty
            if of == ELEMENT:
                found = F.when(nilled, empty if d.nillable else F.array(F.lit("not nillable"))).otherwise(found)
            base = schema.type_of(d).base
            type_name = F.when(here, d.type if isinstance(d.type, str) else base).otherwise(type_name)
            errors = F.when(here, found).otherwise(errors)
            typed = F.when(here & ~nilled, text).otherwise(typed)
    return rows.withColumns({"type_name": type_name, "errors": errors, "is_nilled": nilled & (kind == ELEMENT), "typed_value": typed}).withColumn("is_valid", F.size("errors") == 0).drop("__kids", "__own", "__nil")
