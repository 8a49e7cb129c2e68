"""Expression trees of queries."""

from __future__ import annotations

from dataclasses import dataclass, field, fields


class Node:
    """Base of all expressions."""

    def children(self):
        for f in fields(self):
            yield from _nodes(getattr(self, f.name))

    def walk(self):
        yield self
        for c in self.children():
            yield from c.walk()


def _nodes(value):
    if isinstance(value, Node):
        yield value
    elif isinstance(value, list | tuple):
        for v in value:
            yield from _nodes(v)


def expr(cls):
    return dataclass(cls)


@expr
class Num(Node):
    value: float


@expr
class Str(Node):
    value: str


@expr
class Var(Node):
    name: str


@expr
class Context(Node):
    """The context item."""


@expr
class Root(Node):
    """The root of the context node's document."""


@expr
class Test(Node):
    """kind: name, any, node, text, comment, pi, element, attribute, document, schema-element, schema-attribute."""

    kind: str
    name: str | None = None
    prefix: str | None = None
    inner: Test | None = None


@expr
class Step(Node):
    axis: str
    test: Test
    predicates: list = field(default_factory=list)


@expr
class Path(Node):
    """Steps from a start; a step may be any expression in place of an axis step."""

    start: Node
    steps: list


@expr
class Filter(Node):
    base: Node
    predicates: list


@expr
class Call(Node):
    name: str
    args: list


@expr
class DynCall(Node):
    target: Node
    args: list


@expr
class FnRef(Node):
    name: str
    arity: int


@expr
class Inline(Node):
    params: list
    body: Node


@expr
class Placeholder(Node):
    """``?`` as an argument: partial application."""


@expr
class Bin(Node):
    op: str
    left: Node
    right: Node


@expr
class Unary(Node):
    op: str
    operand: Node


@expr
class If(Node):
    test: Node
    then: Node
    other: Node


@expr
class For(Node):
    bindings: list
    body: Node


@expr
class Let(Node):
    bindings: list
    body: Node


@expr
class Quant(Node):
    kind: str
    bindings: list
    test: Node


@expr
class Sequence(Node):
    items: list


@dataclass
class SeqType:
    """An item type with an occurrence of '', '?', '*' or '+'; ``params`` are its type parameters."""

    item: str
    occurrence: str = ""
    params: tuple = ()
    name: str | None = None

    def __str__(self) -> str:
        inner = ", ".join(map(str, self.params))
        base = f"{self.item}({self.name or inner or ('*' if self.item in ('map', 'array', 'function') else '')})" if self.item in KIND_NAMES else self.item
        return base + self.occurrence


KIND_NAMES = {"item", "node", "element", "attribute", "text", "comment", "processing-instruction", "document-node", "schema-element", "schema-attribute", "map", "array", "function", "empty-sequence", "namespace-node"}


@expr
class TypeOp(Node):
    """op: instance of, castable as, cast as, treat as."""

    op: str
    operand: Node
    type: SeqType


@expr
class Lookup(Node):
    """key None stands for ``*``; base None for the context item."""

    base: Node | None
    key: Node | None


@expr
class MapNew(Node):
    entries: list


@expr
class ArrayNew(Node):
    """square: a member for each expression; else a member for each item."""

    members: list
    square: bool


@expr
class SimpleMap(Node):
    left: Node
    right: Node


@expr
class Template(Node):
    parts: list


@expr
class Try(Node):
    """catches: (error names, expression)."""

    body: Node
    catches: list
