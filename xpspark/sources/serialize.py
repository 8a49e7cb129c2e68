"""Nodes and values as text: XML, HTML, XHTML, text, JSON, adaptive; YAML and CSV.

XML and HTML are assembled by DataFrame operations: each node gives an opening and a closing event with an order key, and
a document's events are joined in that order. A document is the unit, so a group is one document. Empty documents give ''.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import StaticError
from ..operators.nodes import ATTRIBUTE, COMMENT, DOCUMENT, ELEMENT, NAMESPACE, PI
from .shred import TEXT, VOID

METHODS = ("xml", "html", "xhtml", "text", "json", "adaptive")


def escaped(text: Column, attribute: bool = False) -> Column:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), *((('"', "&quot;"),) if attribute else ())):
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text


def serialize(nodes: DataFrame, method: str = "xml", indent: bool = False, declaration: bool = False, doctype: str | None = None) -> DataFrame:
    """``doc_id, text`` of whole documents."""
    if method not in METHODS:
        raise StaticError("XPST0001", f"method {method}")
    if method == "text":
        return nodes.where(F.col("kind") == DOCUMENT).select("doc_id", F.col("str_val").alias("text"))
    if method == "json":
        return xml_to_json(nodes).withColumnRenamed("json", "text")
    text = assembled(nodes, method in ("html",), indent)
    head = ('<?xml version="1.0" encoding="UTF-8"?>' if declaration else "") + (f"<!DOCTYPE {doctype}>" if doctype else "")
    return text.withColumn("text", F.concat(F.lit(head), "text"))


def assembled(nodes: DataFrame, html: bool, indent: bool) -> DataFrame:
    kind = F.col("kind")
    name = F.when(kind == NAMESPACE, F.when(F.col("name") == "", "xmlns").otherwise(F.concat(F.lit("xmlns:"), "name"))).otherwise(F.col("name"))
    pair = F.concat(F.lit(" "), name, F.lit('="'), escaped(F.col("value"), True), F.lit('"'))
    own = nodes.where(kind.isin(ATTRIBUTE, NAMESPACE)).select("doc_id", F.col("parent").alias("pre"), F.struct(F.col("pre").alias("at"), pair.alias("t")).alias("p"))
    own = own.groupBy("doc_id", "pre").agg(F.array_join(F.transform(F.sort_array(F.collect_list("p")), lambda p: p["t"]), "").alias("attributes"))
    # an element whose last descendant is its last own attribute has no content
    inner = nodes.where(~kind.isin(ATTRIBUTE, NAMESPACE) & F.col("parent").isNotNull()).select("doc_id", F.col("parent").alias("pre")).distinct().withColumn("has_content", F.lit(True))
    rows = nodes.where(~kind.isin(ATTRIBUTE, NAMESPACE, DOCUMENT)).join(own, ["doc_id", "pre"], "left").join(inner, ["doc_id", "pre"], "left")
    full = F.coalesce("has_content", F.lit(False))
    void = F.col("name").isin(*sorted(VOID)) if html else F.lit(False)
    close = F.lit(">") if html else F.when(full, ">").otherwise("/>")
    pad = F.concat(F.lit("\n"), F.repeat(F.lit("  "), F.col("level") - 1)) if indent else F.lit("")
    opened = (
        F.when(kind == ELEMENT, F.concat(pad, F.lit("<"), "name", F.coalesce("attributes", F.lit("")), close))
        .when(kind == COMMENT, F.concat(F.lit("<!--"), "value", F.lit("-->")))
        .when(kind == PI, F.concat(F.lit("<?"), "name", F.lit(" "), F.coalesce("value", F.lit("")), F.lit("?>")))
        .when(kind.isin(TEXT, 4), escaped(F.col("value")))
    )
    closed = F.when((kind == ELEMENT) & (full | (F.lit(html) & ~void)), F.concat(F.lit("</"), "name", F.lit(">")))
    # a closing event stands after all of its subtree; of elements that end together the deepest closes first
    events = F.array(F.struct(F.col("pre").alias("at"), F.lit(0).alias("after"), F.lit(0).cast("long").alias("depth"), opened.alias("t")), F.struct(F.col("fin").alias("at"), F.lit(1).alias("after"), (-F.col("level")).cast("long").alias("depth"), closed.alias("t")))
    out = rows.select("doc_id", F.explode(events).alias("e")).where("e.t IS NOT NULL").groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("e")), lambda e: e["t"]), "").alias("text"))
    return nodes.where(kind == DOCUMENT).select("doc_id").join(out, "doc_id", "left").withColumn("text", F.coalesce("text", F.lit("")))


def scalar(text: str):
    """A text as JSON: true, false, null and numbers are recognised."""
    low = text.strip()
    if low in ("true", "false", "null"):
        return {"true": True, "false": False, "null": None}[low]
    try:
        number = float(low)
    except ValueError:
        return text
    return int(number) if number.is_integer() and abs(number) < 1e15 and not any(c in low for c in ".eE") else number if number == number and abs(number) != float("inf") else text


def scalar_text(text: str) -> str:
    return json.dumps(scalar(text), ensure_ascii=False)


def entry(name: str, text: str) -> str:
    """An attribute as a member of a JSON object."""
    return f"{json.dumps('@' + name, ensure_ascii=False)}: {scalar_text(text)}"


#: Names, and short values that repeat such as flags and small numbers, are spelled once.
label = functools.lru_cache(1 << 12)(functools.partial(json.dumps, ensure_ascii=False))
short_entry = functools.lru_cache(1 << 14)(entry)


def json_text(rows: list[tuple], attributes: dict[int, list[tuple[str, str]]] | None = None) -> str:
    """A document's (pre, parent, kind, name, value) rows as a JSON text: elements by content, repeated names as arrays.

    ``attributes``: names and values by element, in order; without it they are rows.
    """
    below: dict[int | None, list[tuple]] = {}
    for r in rows:
        if r[1] in below:
            below[r[1]].append(r)
        else:
            below[r[1]] = [r]

    def value(r):
        inner = below.get(r[0], ())
        own = [(k[3], k[4]) for k in inner if k[2] == ATTRIBUTE] if attributes is None else attributes.get(r[0], ())
        parts = [short_entry(n, v) if v and len(v) <= 32 else entry(n, v or "") for n, v in own]
        if not inner:
            return "{" + ", ".join(parts) + "}" if parts else "null"
        kids = [k for k in inner if k[2] == ELEMENT]
        text = "".join(k[4] or "" for k in inner if k[2] in (TEXT, 4))
        if not kids and not own:
            return scalar_text(text) if text else "null"
        seen: dict[str, list] = {}
        for k in kids:
            seen.setdefault(k[3], []).append(value(k))
        if not own and list(seen) == ["item"]:
            return "[" + ", ".join(seen["item"]) + "]"
        parts += [f"{label(n)}: {v[0] if len(v) == 1 else '[' + ', '.join(v) + ']'}" for n, v in seen.items()]
        if text.strip() and not kids:
            parts.append(f'"#text": {scalar_text(text)}')
        return "{" + ", ".join(parts) + "}"

    root = next((r for r in below.get(next((r[0] for r in rows if r[2] == DOCUMENT), None), []) if r[2] == ELEMENT), None)
    return value(root) if root else "null"


def listed(column: pa.Array) -> list:
    """A column's values: much faster than ``to_pylist``, which only numbers with nulls need."""
    return column.to_pylist() if column.null_count and pa.types.is_integer(column.type) else column.to_numpy(zero_copy_only=False).tolist()


def xml_to_json(nodes: DataFrame) -> DataFrame:
    """``doc_id, json``: the value of each document's root element.

    Partitions are sorted by document and place and read as a stream, so a task holds one document at a time. Where elements
    have their attributes in ``attrs``, attribute nodes are not read.
    """
    held = "attrs" in nodes.columns
    kept = nodes.where(F.col("kind") != ATTRIBUTE) if held else nodes
    # the document node alone has no parent
    kept = kept.select("doc_id", "pre", F.coalesce("parent", F.lit(-1).cast("long")).alias("parent"), "kind", "name", "value", *(["attrs"] if held else []))

    def made(docs: list, texts: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(texts, pa.string())], ["doc_id", "json"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, rows, own = None, [], {} if held else None
        for batch in batches:
            docs, texts = [], []
            columns = [listed(batch.column(c)) for c in ("pre", "parent", "kind", "name", "value")]
            if held:
                maps = batch.column("attrs")
                edges, keys = listed(maps.offsets), listed(maps.keys)
                offs, values = (listed(maps.items.field(c)) for c in ("off", "v"))
            for i, (d, r) in enumerate(zip(listed(batch.column("doc_id")), zip(*columns, strict=True), strict=True)):
                if d != doc:
                    if rows:
                        docs.append(doc)
                        texts.append(json_text(rows, own))
                    doc, rows, own = d, [], {} if held else None
                rows.append(r)
                if held and (a := edges[i]) < (b := edges[i + 1]):
                    at = range(a, b) if offs[a:b] == sorted(offs[a:b]) else sorted(range(a, b), key=offs.__getitem__)
                    own[r[0]] = [(keys[k], values[k]) for k in at if values[k] is not None]
            if docs:
                yield made(docs, texts)
        if rows:
            yield made([doc], [json_text(rows, own)])

    return kept.repartition("doc_id").sortWithinPartitions("doc_id", "pre").mapInArrow(run, "doc_id long, json string")


def copy_of(nodes: DataFrame, selected: DataFrame, deep: bool = True) -> DataFrame:
    """Copies of the selected nodes with their subtrees, or alone with their attributes; each copy is a document.

    ``doc_id`` becomes a struct-free new id: the hash of document and node.
    """
    tops = selected.select(F.col("doc_id").alias("t_doc"), F.col("pre").alias("t_pre"), F.col("fin").alias("t_fin"), F.col("level").alias("t_level"))
    inside = (F.col("pre") >= F.col("t_pre")) & (F.col("pre") <= F.col("t_fin"))
    if not deep:
        inside = (F.col("pre") == F.col("t_pre")) | ((F.col("parent") == F.col("t_pre")) & F.col("kind").isin(ATTRIBUTE, NAMESPACE))
    rows = nodes.join(tops, (F.col("doc_id") == F.col("t_doc")) & inside)
    moved = {"doc_id": F.xxhash64("t_doc", "t_pre"), "level": F.col("level") - F.col("t_level") + 1, "parent": F.when(F.col("pre") != F.col("t_pre"), F.col("parent")), "anc": F.slice("anc", F.col("t_level") + 1, F.size("anc"))}
    if "path" in nodes.columns:
        moved["path"] = F.concat(F.lit("/"), F.array_join(F.slice(F.split("path", "/"), F.col("t_level") + 1, F.size("anc") + 2), "/"))
    return rows.withColumns(moved).select(*nodes.columns)


# -- YAML: block maps and lists, plain, quoted and flow scalars, comments


def yaml_scalar(text: str):
    text = text.strip()
    if len(text) > 1 and text[0] == text[-1] and text[0] in "'\"":
        return text[1:-1].replace("''", "'") if text[0] == "'" else json.loads(text)
    if text.startswith(("[", "{")):
        try:
            return json.loads(text)
        except ValueError:
            inner = text[1:-1].strip()
            parts = [p for p in inner.split(",") if p.strip()]
            return [yaml_scalar(p) for p in parts] if text[0] == "[" else {k.strip(): yaml_scalar(v) for k, _, v in (p.partition(":") for p in parts)}
    return None if text in ("", "~") else scalar(text)


def parse_yaml(text: str) -> object:
    lines = []
    for raw in text.splitlines():
        body = raw.rstrip()
        if body.strip() and not body.lstrip().startswith("#") and body.strip() != "---":
            cut = body.find(" #")
            body = body[:cut].rstrip() if cut >= 0 and body.count('"') % 2 == 0 else body
            lines.append((len(body) - len(body.lstrip()), body.strip()))

    def block(k: int, depth: int):
        if lines[k][1].startswith("- ") or lines[k][1] == "-":
            out: object = []
            while k < len(lines) and lines[k][0] == depth and lines[k][1].startswith("-"):
                rest = lines[k][1][1:].strip()
                if not rest:
                    v, k = block(k + 1, lines[k + 1][0]) if k + 1 < len(lines) and lines[k + 1][0] > depth else (None, k + 1)
                elif ": " in rest or rest.endswith(":"):
                    lines[k] = (depth + 2, rest)
                    v, k = block(k, depth + 2)
                else:
                    v, k = yaml_scalar(rest), k + 1
                out.append(v)
            return out, k
        if ": " not in lines[k][1] and not lines[k][1].endswith(":"):
            return yaml_scalar(lines[k][1]), k + 1
        out = {}
        while k < len(lines) and lines[k][0] == depth and not lines[k][1].startswith("- "):
            key, _, rest = lines[k][1].partition(":")
            key = str(yaml_scalar(key))
            if rest.strip():
                out[key], k = yaml_scalar(rest), k + 1
            elif k + 1 < len(lines) and (lines[k + 1][0] > depth or (lines[k + 1][0] == depth and lines[k + 1][1].startswith("-"))):
                out[key], k = block(k + 1, lines[k + 1][0])
            else:
                out[key], k = None, k + 1
        return out, k

    return block(0, lines[0][0])[0] if lines else None


def to_yaml(value, indent: int = 2, sort_keys: bool = False, depth: int = 0) -> str:
    pad = " " * indent * depth
    if isinstance(value, dict) and value:
        keys = sorted(value) if sort_keys else list(value)
        parts = []
        for k in keys:
            v = value[k]
            nested = isinstance(v, dict | list) and v
            parts.append(f"{pad}{k}:" + ("\n" + to_yaml(v, indent, sort_keys, depth + 1) if nested else f" {plain(v)}"))
        return "\n".join(parts)
    if isinstance(value, list) and value:
        return "\n".join(f"{pad}-" + (f"\n{to_yaml(v, indent, sort_keys, depth + 1)}" if isinstance(v, dict | list) and v else f" {plain(v)}") for v in value)
    return pad + plain(value)


def plain(v) -> str:
    if v is None or isinstance(v, bool | int | float):
        return json.dumps(v)
    if isinstance(v, dict | list):
        return "{}" if isinstance(v, dict) else "[]"
    return json.dumps(v, ensure_ascii=False) if v == "" or scalar(v) != v or v[0] in "-?:,[]{}#&*!|>'\"%@` " or ": " in v or " #" in v or "\n" in v or v.endswith((":", " ")) else v


@F.pandas_udf(T.StringType())
def yaml_to_json(text: pd.Series) -> pd.Series:
    """YAML texts as JSON texts; null for texts outside the subset."""

    def one(t):
        try:
            return None if t is None else json.dumps(parse_yaml(t), ensure_ascii=False)
        except (ValueError, IndexError, RecursionError):
            return None

    return pd.Series([one(t) for t in text], dtype=object)


@F.pandas_udf(T.StringType())
def json_to_yaml(text: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else to_yaml(json.loads(t)) for t in text], dtype=object)


def read_csv(spark, path: str, **options) -> DataFrame:
    """CSV files with a header; all columns are strings."""
    return spark.read.csv(path, header=True, **options)


