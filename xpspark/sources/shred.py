"""Shredders: tables, XML, HTML and JSON become a ``nodes`` relation.

Tables are shredded by DataFrame operations alone: a node's ``pre`` is put together from the keys on its path, so that no
sort or window is needed and filters on names prune whole branches of the union. Texts are parsed in one pass by Arrow
batches, a document at a time, within a task.

Beside the node columns, elements have ``path``, the local names from the root, and ``attrs``, their attributes by name
with the distance of their ``pre``; XML, where attributes may have prefixes, has no ``attrs``.

Null texts and texts that aren't well formed (XML, JSON) give no nodes; HTML always parses.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import StaticError
from ..operators.nodes import ATTRIBUTE, COLUMNS, COMMENT, DOCUMENT, ELEMENT, MORE, NAMESPACE, PI, text

TEXT = 3
SCHEMA = "doc_id long, pre long, fin long, level int, parent long, kind tinyint, name string, local string, ns_uri string, value string, str_val string, ord long, anc array<long>, path string, attrs map<string,struct<off:int,v:string>>"
#: Bits for an element's own attributes.
OWN_BITS = 6


@dataclass
class Level:
    """Elements of one depth: rows of ``df``, which has key columns of all levels above as well.

    ``key`` is a whole number in [0, 2 ** bits), unique below its parent; ``attributes`` maps names to columns.
    """

    tag: str
    df: DataFrame
    key: Column
    bits: int
    attributes: dict[str, Column] = field(default_factory=dict)


def relational(levels: list[Level], doc_id: str, ancestors: list[list[Column]]) -> DataFrame:
    """A document per row of the first level, whose column ``doc_id`` all levels have.

    ``ancestors[k]`` are the keys of levels 1 to k, as columns of level k. The keys' bits must fit 62; if they don't, begin
    documents at a deeper level.
    """
    if sum(x.bits for x in levels[1:]) + OWN_BITS > 62:
        raise StaticError("FODC0005", "keys need more than 62 bits: begin documents at a deeper level")
    shifts, at = [0] * len(levels), OWN_BITS
    for k in range(len(levels) - 1, 0, -1):
        shifts[k] = at
        at += levels[k].bits
    parts = [levels[0].df.select(F.col(doc_id).cast("long").alias("doc_id")).selectExpr(*row("0L", f"{(1 << at) - 1}L", 0, "CAST(NULL AS BIGINT)", DOCUMENT, "#document", "CAST(NULL AS STRING)", "1L", "CAST(array() AS ARRAY<BIGINT>)"))]
    path = ""
    for k, level in enumerate(levels):
        path += f"/{level.tag}"
        pre, ups = "1L", ["0L"]
        for j in range(1, k + 1):
            ups.append(pre)
            guarded = f"CASE WHEN k{j} >= 0 AND k{j} < {(1 << levels[j].bits) - 1} THEN k{j} ELSE CAST(raise_error({text('key of ' + levels[j].tag + ' exceeds its bits')}) AS BIGINT) END"
            pre = f"{pre} + shiftleft({guarded} + 1, {shifts[j]})"
        size = (1 << OWN_BITS) - 2 if k == len(levels) - 1 else (1 << shifts[k]) - 2 if k else (1 << at) - 2
        keys = [c.cast("long").alias(f"k{j + 1}") for j, c in enumerate(ancestors[k])]
        base = level.df.select(F.col(doc_id).cast("long").alias("doc_id"), level.key.cast("long").alias("k"), *keys, *(c.cast("string").alias(f"a{i}") for i, c in enumerate(level.attributes.values())))
        own = [f"a{i}" for i in range(len(level.attributes))]
        base = base.selectExpr("doc_id", "k", f"{pre} AS p", f"{ups[-1]} AS up", f"array({', '.join(ups)}) AS ups", *own)
        entries = ", ".join(f"{text(name)}, named_struct('off', {i + 1}, 'v', a{i})" for i, name in enumerate(level.attributes))
        parts.append(base.selectExpr(*row("p", f"p + {size}L", k + 1, "up", ELEMENT, level.tag, "CAST(NULL AS STRING)", "k", "ups", text(path), f"map({entries})" if entries else None)))
        for i, name in enumerate(level.attributes):
            parts.append(base.where(f"a{i} IS NOT NULL").selectExpr(*row(f"p + {i + 1}L", f"p + {i + 1}L", k + 2, "p", ATTRIBUTE, name, f"a{i}", f"{i + 1}L", "concat(ups, array(p))")))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def row(pre: str, fin: str, level: int, parent: str, kind: int, name: str, value: str, ord_: str, anc: str, path: str = "CAST(NULL AS STRING)", attrs: str | None = None) -> list[str]:
    """SQL for the node columns; a filter on a literal column prunes a whole branch of a union."""
    content = value if kind == ATTRIBUTE else "''"
    space = "CAST(NULL AS STRING)" if kind == DOCUMENT else "''"
    cols = ["doc_id", pre, fin, str(level), parent, f"CAST({kind} AS TINYINT)", text(name), text(name.rpartition(":")[2]), space, value, content, ord_, anc, path, attrs or "CAST(NULL AS MAP<STRING, STRUCT<off: INT, v: STRING>>)"]
    return [f"{c} AS {n}" for c, n in zip(cols, COLUMNS + MORE, strict=True)]


class Builder:
    """Numbers the nodes of one document as a parser meets them."""

    def __init__(self, uri: str | None = None):
        self.rows: list[list] = []
        self.open: list[int] = []
        self.counts: list[int] = []
        self.paths: list[str] = []
        self.add(DOCUMENT, "#document", None, "", uri)
        self.open.append(0)
        self.counts.append(0)
        self.paths.append("")

    def add(self, kind: int, name: str | None, local: str | None, ns: str | None, value: str | None) -> int:
        pre, parent = len(self.rows), self.open[-1] if self.open else None
        if kind in (ATTRIBUTE, NAMESPACE):
            ord_ = pre - parent
        else:
            if self.counts:
                self.counts[-1] += 1
            ord_ = self.counts[-1] if self.counts else 1
        self.rows.append([pre, pre, len(self.open), parent, kind, name, local, ns, value, [value] if value is not None and kind != DOCUMENT else [], ord_, list(self.open), None, None])
        return pre

    def start(self, name: str, local: str, ns: str, attributes: list[tuple[str, str, str, str]], declared: dict[str, str] | None = None) -> None:
        pre = self.add(ELEMENT, name, local, ns, None)
        self.paths.append(f"{self.paths[-1]}/{local}")
        self.rows[pre][12] = self.paths[-1]
        self.open.append(pre)
        self.counts.append(0)
        for prefix, uri in (declared or {}).items():
            self.add(NAMESPACE, prefix, prefix, "", uri)
        self.rows[pre][13] = [(full, {"off": self.add(ATTRIBUTE, full, loc, uri, value) - pre, "v": value}) for full, loc, uri, value in attributes]

    def end(self) -> None:
        self.rows[self.open.pop()][1] = len(self.rows) - 1
        self.counts.pop()
        self.paths.pop()

    def text(self, data: str) -> None:
        last = self.rows[-1]
        if last[4] == TEXT and last[3] == self.open[-1] and last[1] == len(self.rows) - 1:
            last[8] += data  # neighbouring pieces are one text node
        else:
            self.add(TEXT, "#text", None, None, data)

    def finish(self) -> list[list]:
        """Rows with string values: an element's is its text nodes', in order."""
        while self.open:
            self.end()
        pieces = [r[8] for r in self.rows if r[4] == TEXT]
        at, begins = 0, []
        for r in self.rows:
            begins.append(at)
            at += r[4] == TEXT
        begins.append(at)
        for r in self.rows:
            r[9] = "".join(pieces[begins[r[0]] : begins[r[1] + 1]]) if r[4] in (ELEMENT, DOCUMENT) else r[8] or ""
        return self.rows


def xml_nodes(text: str, uri: str | None = None) -> list[list] | None:
    """Rows of a well-formed XML document, else None. External entities are not read."""
    b, p = Builder(uri), expat.ParserCreate(namespace_separator="\x1f")
    p.namespace_prefixes, p.buffer_text, p.ordered_attributes = True, True, True
    declared: dict[str, str] = {}

    def split(name: str) -> tuple[str, str, str]:
        uri_, _, rest = name.rpartition("\x1f") if name.count("\x1f") < 2 else ("", "", "")
        if name.count("\x1f") == 2:
            uri_, local, prefix = name.split("\x1f")
            return f"{prefix}:{local}", local, uri_
        return (rest, rest, uri_) if uri_ else (name, name, "")

    def start(name, attrs):
        pairs = [(*split(a), v) for a, v in zip(attrs[::2], attrs[1::2], strict=True)]
        b.start(*split(name), pairs, dict(declared))
        declared.clear()

    p.StartNamespaceDeclHandler = lambda prefix, uri_: declared.__setitem__(prefix or "", uri_ or "")
    p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler = start, lambda _: b.end(), b.text
    p.CommentHandler = lambda d: b.add(COMMENT, "#comment", None, None, d)
    p.ProcessingInstructionHandler = lambda t, d: b.add(PI, t, t, None, d)
    try:
        p.Parse(text.encode("utf-8", "surrogatepass") if not text.lstrip().startswith("<?xml") else re.sub(r"^\s*<\?xml[^>]*\?>", "", text).encode(), True)
    except expat.ExpatError:
        return None
    return b.finish()


VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose start ends an open element of the kinds named, up to the given containers.
ENDS = {"li": ({"li"}, {"ul", "ol"}), "p": ({"p"}, {"div", "article", "section", "td", "body", "li"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"})}


class HtmlBuilder(HTMLParser):
    """Tolerant: void elements have no content, list items and cells end where the next begins, stray ends are skipped."""

    def __init__(self, uri: str | None = None):
        super().__init__(convert_charrefs=True)
        self.b, self.tags = Builder(uri), []

    def handle_starttag(self, tag, attrs):
        if tag in ENDS:
            ends, stop = ENDS[tag]
            for k in range(len(self.tags) - 1, -1, -1):
                if self.tags[k] in stop:
                    break
                if self.tags[k] in ends:
                    while len(self.tags) > k:
                        self.tags.pop()
                        self.b.end()
                    break
        seen: dict[str, str] = {}
        for name, value in attrs:
            seen.setdefault(name, value or "")
        # names have no prefixes here: a colon is part of the name
        self.b.start(tag, tag, "", [(n, n, "", v) for n, v in seen.items()])
        if tag in VOID:
            self.b.end()
        else:
            self.tags.append(tag)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in self.tags:
            while self.tags.pop() != tag:
                self.b.end()
            self.b.end()

    def handle_data(self, data):
        if data:
            self.b.text(data)

    def handle_comment(self, data):
        self.b.add(COMMENT, "#comment", None, None, data)

    def handle_pi(self, data):
        target, _, rest = data.partition(" ")
        self.b.add(PI, target, target, None, rest)


def html_nodes(text: str, uri: str | None = None) -> list[list]:
    p = HtmlBuilder(uri)
    p.feed(text)
    p.close()
    return p.b.finish()


def json_name(key: str) -> str:
    """A key as an element name: other characters become underscores."""
    name = re.sub(r"[^\w.-]", "_", key) or "_"
    return name if not name[0].isdigit() and name[0] not in ".-" else f"_{name}"


def json_nodes(text: str, uri: str | None = None) -> list[list] | None:
    """Elements named after keys below ``root``; array members are ``item``; scalars are text."""
    try:
        value = json.loads(text)
    except (ValueError, RecursionError):
        return None
    b = Builder(uri)

    def put(name: str, v) -> None:
        b.start(json_name(name), json_name(name), "", [])
        if isinstance(v, dict):
            for k, x in v.items():
                put(k, x)
        elif isinstance(v, list):
            for x in v:
                put("item", x)
        elif v is not None:
            b.text(json.dumps(v) if not isinstance(v, str) else v)
        b.end()

    put("root", value)
    return b.finish()


PARSERS: dict[str, Callable] = {"xml": xml_nodes, "html": html_nodes, "json": json_nodes}


def shred(df: DataFrame, form: str, id_col: str, text_col: str, uri_col: str | None = None) -> DataFrame:
    """The nodes of all documents; ``id_col`` must be unique and fit a long."""
    parse = PARSERS[form]
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("body"), (F.col(uri_col) if uri_col else F.lit(None)).cast("string").alias("uri"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[list] = []
            for doc, body, uri in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "body", "uri")), strict=True):
                held += ([doc, *r] for r in parse(body, uri) or ())
                while len(held) >= 20_000:
                    yield pack(held[:20_000])
                    held = held[20_000:]
            if held:
                yield pack(held)

    # parsing costs far more than dealing the texts evenly
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = rows.where("doc_id IS NOT NULL AND body IS NOT NULL").repartition(n, "doc_id").mapInArrow(run, SCHEMA)
    out = out.drop("attrs") if form == "xml" else out
    # a query that reads the nodes more than once writes them first
    out._parsed = True
    return out


ARROW = pa.schema([("doc_id", pa.int64()), ("pre", pa.int64()), ("fin", pa.int64()), ("level", pa.int32()), ("parent", pa.int64()), ("kind", pa.int8()), ("name", pa.string()), ("local", pa.string()), ("ns_uri", pa.string()), ("value", pa.string()), ("str_val", pa.string()), ("ord", pa.int64()), ("anc", pa.list_(pa.int64())), ("path", pa.string()), ("attrs", pa.map_(pa.string(), pa.struct([("off", pa.int32()), ("v", pa.string())])))])


def pack(rows: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)
