"""The facade: queries over columns of a DataFrame and over shredded documents."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import StaticError
from .functions import core
from .functions.core import Val
from .operators import nodes as node_lane
from .operators.value import Compiler, Options
from .plans.parser import parse
from .plans.rules import rewrite
from .sources.storage import stage


class Engine:
    """``version`` gates the grammar; ``options`` are those of ``operators.value.Options``."""

    def __init__(self, spark: SparkSession, version: str = "3.1", **options):
        self.spark, self.options, self.functions = spark, Options(version=version, **options), {}
        #: Where ``doc`` and ``collection`` find documents; the accumulators and keys that queries may name.
        self.catalog, self.accumulators, self.keys = None, [], {}

    def register(self, name: str, build, least: int = 1, most: int | None = None) -> None:
        """A host function: ``build(compiler, values)`` returns a value, or takes and returns Columns of strings."""
        if name in self.functions:
            raise StaticError("XPST0017", f"{name} is registered already")
        if not callable(build) or least < 0 or (most is not None and most < least):
            raise StaticError("XPST0017", f"{name}: bad signature")
        self.functions[name] = (least, least if most is None else most, build)

    def register_columns(self, name: str, build, arity: int = 1, kind: str = "str") -> None:
        """A host function over Columns, for instance an Arrow UDF."""
        self.register(name, lambda c, args: Val(build(*(core.one(a).col for a in args)), core.Ty(kind)), arity)

    def compile(self, query: str, df: DataFrame, context: str | None = None, **variables) -> Val:
        """A query over a row: columns of ``df`` are variables, ``context`` names the column that is the context item."""
        bound = {f.name: core.of_spark(F.col(f"`{f.name}`"), f.dataType) for f in df.schema}
        bound |= {k: v if isinstance(v, Val) else self.constant(v) for k, v in variables.items()}
        c = Compiler(bound, bound[context] if context else None, functions=self.functions, options=self.options)
        return c.compile(parse(query, self.options.version))

    def constant(self, value) -> Val:
        if isinstance(value, bool):
            return core.boolean(value)
        if isinstance(value, int | float):
            return core.num(value)
        if value is None:
            return core.empty()
        if isinstance(value, list | tuple):
            vals = [self.constant(v) for v in value]
            ty = core.unify(vals)
            return Val(F.array(*(core.fit(v, ty).col for v in vals)), ty.seq)
        return core.string(str(value))

    def column(self, query: str, df: DataFrame, context: str | None = None, **variables) -> Column:
        return self.compile(query, df, context, **variables).col

    def select(self, df: DataFrame, keep: list[str] | None = None, context: str | None = None, **queries: str) -> DataFrame:
        """``keep`` columns and one column for each named query."""
        cols = [self.column(q, df, context).alias(name) for name, q in queries.items()]
        return df.select(*(keep or []), *cols)

    def with_options(self, **options) -> Engine:
        out = Engine(self.spark, self.options.version)
        out.options, out.functions = replace(self.options, **options), dict(self.functions)
        out.catalog, out.accumulators, out.keys = self.catalog, list(self.accumulators), dict(self.keys)
        return out

    # -- nodes

    def compiler(self, variables: dict | None = None) -> Compiler:
        bound = {k: v if isinstance(v, Val) else self.constant(v) for k, v in (variables or {}).items()}
        return Compiler(bound, functions=self.functions, options=self.options)

    def key(self, name: str, match: str, use: str) -> None:
        """Declare what ``key(name, value)`` finds: elements named ``match`` whose ``use`` equals the value."""
        self.keys[name] = (match, parse(use, self.options.version))

    def lane(self, options: dict) -> dict:
        return {"catalog": self.catalog, "keys": self.keys, "accumulators": tuple(self.accumulators), **options}

    @staticmethod
    def read(nodes: DataFrame, *queries) -> DataFrame:
        """Nodes that come from a parser are written first if a query reads them more than once."""
        return stage(nodes, "nodes") if getattr(nodes, "_parsed", False) and node_lane.scans(*map(rewrite, queries)) > 1 else nodes

    def nodes(self, nodes: DataFrame, query: str, variables: dict | None = None, namespaces: dict | None = None, order_mode: str = "reference", scope: str = "document") -> DataFrame:
        """The items that a query selects in each document, or with scope "all" in all of them at once.

        Nodes come with their columns, values as rows of kind 0 (``str_val`` their text, ``name`` their type); ``seq`` gives
        the order where it isn't that of the documents.
        """
        tree = parse(query, self.options.version)
        return node_lane.select(self.read(nodes, tree), tree, self.compiler(variables), **self.lane({"namespaces": namespaces, "order_mode": order_mode, "scope": scope}))

    def table(self, nodes: DataFrame, each: str, queries: dict[str, str], variables: dict | None = None, namespaces: dict | None = None, order_mode: str = "reference") -> DataFrame:
        """A row for each node of ``each``, a column for each query with that node as context."""
        parsed, top = {k: parse(q, self.options.version) for k, q in queries.items()}, parse(each, self.options.version)
        return node_lane.values(self.read(nodes, top, *parsed.values()), top, parsed, self.compiler(variables), **self.lane({"namespaces": namespaces, "order_mode": order_mode}))

    def flwor(self, nodes: DataFrame, query: str, variables: dict | None = None) -> DataFrame:
        """``for $x in path return value``; over ``distinct-values`` it groups."""
        tree = parse(query, self.options.version)
        return node_lane.flwor(self.read(nodes, tree), tree, self.compiler(variables), **self.lane({}))
