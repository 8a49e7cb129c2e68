"""The node lane: queries over a ``nodes`` relation become joins, windows and aggregates.

A node is a row ``doc_id, pre, fin, level, parent, kind, name, local, ns_uri, value, str_val, ord, anc``: ``pre`` numbers
nodes in document order (gaps are fine), a node's subtree is ``pre`` to ``fin``, ``anc`` lists its ancestors from the root.
Two more columns save joins where a shredder gives them: ``path``, the local names from the root to an element, answers a
chain of steps by one filter; ``attrs``, an element's attributes by name, turns attribute steps into projections.

An expression becomes a ``Seq``: rows keyed by the columns ``it``, the iteration that they belong to. At the outside an
iteration is a document (or all of them, ``scope="all"``); each binding of a loop adds its node to the key. What doesn't
depend on a loop is computed once and keyed by fewer columns; it meets the loop's rows only where a result needs them, and
a comparison with a loop's variable is a join on the compared values. In a predicate the iteration is the candidate node
itself, so predicates are evaluated once a node, however many contexts lead to it.

Order: without ``order`` a sequence is in document order. Commas, ``reverse``, ``sort``, loops, and in the mode "reference"
steps whose result the reference doesn't sort, carry an order key ``seq``. Positions follow the axis: "reference" counts
siblings before a node from the first one and puts a subtree's root after its descendants on ``preceding``; "spec" counts
reverse axes backwards. A predicate of numeric type is a position, whatever its form.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import DynamicError, StaticError, TypeMismatch
from ..functions import core
from ..functions.core import STR, Ty, Val, boolean, num, string
from ..plans import ast as A
from ..plans.rules import movable, own_calls, rewrite, substitute, variables
from .running import before
from .value import Compiler

COLUMNS = ["doc_id", "pre", "fin", "level", "parent", "kind", "name", "local", "ns_uri", "value", "str_val", "ord", "anc"]
#: Columns that a relation may have as well: local names from the root, and attributes by name.
MORE = ["path", "attrs"]
ATOM, ELEMENT, ATTRIBUTE, PI, COMMENT, DOCUMENT, NAMESPACE = 0, 1, 2, 7, 8, 9, 13
#: Steps that keep document order if their contexts are in it.
EASY = {"self", "child", "attribute", "descendant", "descendant-or-self", "//", "//@"}
SIBLINGS = {"following-sibling", "preceding-sibling"}
ROAMING = {*SIBLINGS, "following", "preceding"}
XML_NS = "http://www.w3.org/XML/1998/namespace"
#: Functions that give nodes if their first argument does.
NODE_CALLS = {"root", "innermost", "outermost", "reverse", "unordered", "head", "tail", "subsequence", "remove", "insert-before", "sort", "one-or-more", "zero-or-one", "exactly-one", "copy-of"}
#: Functions that give nodes from addresses or keys.
SOURCES = {"doc", "document", "collection", "key"}
#: Functions that give a number.
NUMERIC = {"count", "sum", "avg", "min", "max", "number", "round", "floor", "ceiling", "abs", "string-length", "position", "last", "round-half-to-even", "map:size", "array:size", "compare", "binary-length"}


@dataclass(frozen=True)
class Seq:
    """A sequence for each iteration.

    order: an array of longs that sorts the items of an iteration; None for document order. flat: no node holds another;
    level: the level of all nodes, if known; unique: a node occurs once over all iterations; bag: a node may occur more
    than once in one; single: one item at most; atoms: the type of the items if they aren't nodes.
    """

    df: DataFrame
    it: tuple[str, ...]
    order: Column | None = None
    flat: bool = False
    level: int | None = None
    unique: bool = True
    bag: bool = False
    single: bool = False
    atoms: str | None = None

    def key(self) -> Column:
        return F.array("doc_id", "pre") if self.order is None else self.order


@dataclass(frozen=True)
class Env:
    """Where an expression stands: its iterations (``rows``, keyed by ``it``), their context node and loop variables.

    doc names the column with the document of absolute paths (None: all documents); free: paths may start from nodes that
    are no context, as results meet the contexts afterwards; own: name and items of the variable whose nodes ``rows`` are.
    """

    it: tuple[str, ...]
    rows: DataFrame
    focus: Seq | None = None
    loops: dict = field(default_factory=dict)
    values: dict = field(default_factory=dict)
    doc: str | None = None
    free: bool = False
    own: tuple[str, Seq] | None = None


def text(value: str) -> str:
    """A string as an SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def on(left: DataFrame, right: DataFrame, keys: tuple | list, how: str = "inner") -> DataFrame:
    """A join on equal column names; without keys ``right`` is one row, or all of it belongs to every row."""
    return left.join(right, list(keys), how) if keys else left.crossJoin(right)


def test_condition(test: A.Test, axis: str, namespaces: dict) -> Column:
    kind = F.col("kind")
    if test.kind == "node":
        return F.lit(True)
    if test.kind in ("text", "comment"):
        return kind.isin(3, 4) if test.kind == "text" else kind == COMMENT
    if test.kind == "pi":
        return (kind == PI) & (F.col("name") == test.name) if test.name else kind == PI
    if test.kind in ("element", "schema-element", "attribute", "schema-attribute"):
        of = kind == (ELEMENT if "element" in test.kind else ATTRIBUTE)
        return of & (F.col("local") == test.name.rpartition(":")[2]) if test.name else of
    if test.kind == "document":
        return kind == DOCUMENT
    principal = {"attribute": kind == ATTRIBUTE, "//@": kind == ATTRIBUTE, "namespace": kind == NAMESPACE}.get(axis, kind == ELEMENT)
    out = principal if test.kind == "any" else principal & (F.col("local") == test.name)
    if test.prefix is not None:
        uri = test.prefix[1:-1] if test.prefix.startswith("{") else namespaces.get(test.prefix)
        out = out & (F.col("ns_uri") == uri) if uri is not None else F.lit(False)
    return out


class Paths:
    """Evaluation over one ``nodes`` relation.

    catalog: addresses of documents and collections; keys: ``name -> (pattern, use)`` for ``key()``; accumulators: those
    that ``accumulator-before`` and ``-after`` may name.
    """

    def __init__(self, nodes: DataFrame, compiler: Compiler, namespaces: dict | None = None, order_mode: str = "reference", scope: str = "document", catalog=None, keys: dict | None = None, accumulators: tuple = ()):
        if order_mode not in ("reference", "spec") or scope not in ("document", "all"):
            raise StaticError("XPST0001", f"order mode {order_mode}, scope {scope}")
        self.columns = COLUMNS + [c for c in MORE if c in nodes.columns]
        self.nodes, self.compiler, self.namespaces = nodes.select(*self.columns), compiler, namespaces or {}
        self.order_mode, self.scope, self.catalog, self.keys, self.accumulators = order_mode, scope, catalog, keys or {}, accumulators
        self.made = 0

    def fresh(self, n: int = 1) -> tuple[str, ...]:
        self.made += n
        return tuple(f"i{self.made - k}" for k in range(n))

    # -- environments

    def top(self) -> Env:
        if self.scope == "all":
            return Env((), self.nodes.sparkSession.range(1).select(F.lit(True).alias("__one")))
        (doc,) = self.fresh()
        docs = self.nodes.where("level = 0").withColumn(doc, F.col("doc_id"))
        return Env((doc,), docs.select(doc), Seq(docs, (doc,), flat=True, level=0, single=True), doc=doc)

    def inside(self, seq: Seq, env: Env, correlated: bool = False) -> tuple[DataFrame, Env]:
        """Rows of ``seq`` and the environment of an expression with each of them as context node."""
        a, b = self.fresh(2)
        rows = seq.df.withColumns({a: F.col("doc_id"), b: F.col("pre")})
        it = (*seq.it, a, b) if correlated else (a, b)
        # contexts that repeat count once
        known = rows if seq.unique or (correlated and not seq.bag) else rows.dropDuplicates(list(it))
        focus = Seq(known.select(*it, *self.columns), it, flat=True, level=seq.level, unique=not correlated, single=True)
        loops = env.loops if correlated else {}
        return rows, Env(it, known.select(*it), focus, loops, env.values, a, free=not correlated)

    def enter(self, seq: Seq, env: Env, ordered: bool, name: str | None = None) -> Env:
        """An iteration for each item of ``seq``: as context node, or as the variable ``name``."""
        marked = seq.atoms is not None or seq.bag or (ordered and seq.order is not None)
        new = self.fresh(1 if marked else 2)
        seq = self.lift(seq, env)
        cols = {new[0]: seq.key()} if marked else {new[0]: F.col("doc_id"), new[1]: F.col("pre")}
        it = (*env.it, *new)
        rows = seq.df.withColumns(cols)
        item = Seq(rows.select(*it, *self.columns), it, flat=True, level=seq.level, unique=seq.unique and not seq.bag, single=True, atoms=seq.atoms)
        loops = env.loops if name is None else {**env.loops, name: item}
        focus = item if name is None or self.compiler.options.compat else env.focus
        own = (name, item) if name is not None and seq.atoms is None else None
        return replace(env, it=it, rows=rows.select(*it), focus=focus, loops=loops, free=False, doc=new[0] if name is None and not marked else env.doc, own=own)

    def leave(self, out: Seq, inner: Env, env: Env, ordered: bool, distinct: bool = False) -> Seq:
        """The items of all of ``inner``'s iterations as one sequence of ``env``'s."""
        out = self.lift(out, inner)
        new = inner.it[len(env.it) :]
        df, order = out.df, None
        if ordered or out.atoms is not None:
            at = F.col(new[0]) if len(new) == 1 else F.array(*new)
            df, order = df.withColumn("seq", F.concat(at, out.key())), F.col("seq")
        cols = [*env.it, *self.columns, *(["seq"] if order is not None else [])]
        df = df.select(*cols)
        if distinct and out.atoms is None:
            df = self.once(df, env.it, order is not None)
        return Seq(df, env.it, order, unique=False, bag=not distinct, atoms=out.atoms)

    def once(self, df: DataFrame, it: tuple, ordered: bool) -> DataFrame:
        """Each node once an iteration, at its first place."""
        if not ordered:
            return df.dropDuplicates([*it, "doc_id", "pre"])
        rest = [c for c in self.columns if c not in ("doc_id", "pre")]
        found = df.groupBy(*it, "doc_id", "pre").agg(F.min("seq").alias("seq"), *(F.first(c).alias(c) for c in rest))
        return found.select(*it, *self.columns, "seq")

    def lift(self, seq: Seq, env: Env) -> Seq:
        """``seq`` for every iteration of ``env``."""
        if set(seq.it) == set(env.it):
            return seq
        return replace(seq, df=on(env.rows.select(*env.it), seq.df, seq.it), it=env.it, unique=False)

    # -- static kinds

    def noded(self, n: A.Node, env: Env) -> bool:
        """True if an expression gives nodes."""
        if isinstance(n, A.Path):
            return not n.steps or isinstance(n.steps[-1], A.Step) or self.noded(n.steps[-1], env)
        if isinstance(n, A.Root | A.Context):
            return isinstance(n, A.Root) or (env.focus is not None and env.focus.atoms is None)
        if isinstance(n, A.Bin):
            return n.op in ("union", "intersect", "except")
        if isinstance(n, A.Filter):
            return self.noded(n.base, env)
        if isinstance(n, A.Sequence):
            return bool(n.items) and all(self.noded(x, env) for x in n.items)
        if isinstance(n, A.If):
            branches = [x for x in (n.then, n.other) if not (isinstance(x, A.Sequence) and not x.items)]
            return bool(branches) and all(self.noded(x, env) for x in branches)
        if isinstance(n, A.For | A.Let):
            return self.noded(n.body, self.known(n.bindings, env))
        if isinstance(n, A.SimpleMap):
            return self.noded(n.right, replace(env, focus=self.any_node()) if self.noded(n.left, env) else replace(env, focus=None))
        if isinstance(n, A.Call):
            name = n.name.removeprefix("fn:")
            return name in SOURCES or (name in NODE_CALLS and (self.noded(n.args[0], env) if n.args else name == "root"))
        return isinstance(n, A.Var) and n.name in env.loops and env.loops[n.name].atoms is None

    def known(self, bindings: list, env: Env) -> Env:
        """The environment of a body as far as kinds go."""
        for name, source in bindings:
            if self.plural(source, env):
                env = replace(env, loops={**env.loops, name: self.any_node() if self.noded(source, env) else replace(self.any_node(), atoms="str")})
        return env

    def any_node(self) -> Seq:
        return Seq(self.nodes, ())

    def plural(self, n: A.Node, env: Env) -> bool:
        """True if an expression is computed as rows: it reads nodes and may give many items."""
        if isinstance(n, A.Context):
            return False
        if isinstance(n, A.Path):
            return True
        if isinstance(n, A.Sequence):
            return any(self.plural(x, env) for x in n.items)
        if isinstance(n, A.If):
            return self.plural(n.then, env) or self.plural(n.other, env)
        if isinstance(n, A.For):
            return any(self.plural(s, env) for _, s in n.bindings) or self.plural(n.body, self.known(n.bindings, env))
        if isinstance(n, A.Let):
            return self.plural(n.body, self.known(n.bindings, env))
        if isinstance(n, A.SimpleMap):
            return self.plural(n.left, env) or self.plural(n.right, env)
        if isinstance(n, A.Filter):
            return self.plural(n.base, env)
        if isinstance(n, A.Call) and n.args and n.name.removeprefix("fn:") in NODE_CALLS | {"distinct-values", "data"}:
            name = n.name.removeprefix("fn:")
            return self.plural(n.args[0], env) or (name in NODE_CALLS and self.noded(n.args[0], env))
        return self.noded(n, env)

    def kind_of(self, p: A.Node, env: Env) -> str:
        """num, bool, nodes, str, or any if only the compiled expression can tell."""
        if isinstance(p, A.Num | A.Unary) or (isinstance(p, A.Bin) and p.op in ("+", "-", "*", "div", "mod", "idiv")):
            return "num"
        if isinstance(p, A.Bin):
            return "nodes" if p.op in ("union", "intersect", "except") else "bool" if p.op not in ("to", "||") else "any"
        if isinstance(p, A.Str | A.Template):
            return "str"
        if isinstance(p, A.Quant) or (isinstance(p, A.TypeOp) and p.op in ("instance of", "castable as")):
            return "bool"
        if self.noded(p, env):
            return "nodes"
        if isinstance(p, A.Call):
            name = p.name.removeprefix("fn:")
            if name in NUMERIC:
                return "num"
            if name in ("not", "empty", "exists", "boolean", "true", "false", "contains", "starts-with", "ends-with", "matches", "lang", "has-children", "nilled", "doc-available", "deep-equal"):
                return "bool"
        return "any"

    # -- expressions as rows

    def relation(self, n: A.Node, env: Env, ordered: bool = False) -> Seq:
        """An expression that gives nodes."""
        out = self.sequence(n, env, ordered)
        if out.atoms is not None:
            raise TypeMismatch("XPTY0019", f"{type(n).__name__} is not a node sequence")
        return out

    def sequence(self, n: A.Node, env: Env, ordered: bool = False) -> Seq:
        """Any expression: nodes, or atomic items as rows of kind 0 with their text as ``str_val`` and type as ``name``."""
        if isinstance(n, A.Path | A.Root):
            return self.path(n if isinstance(n, A.Path) else A.Path(n, []), env, ordered)
        if isinstance(n, A.Context) and env.focus is not None:
            return env.focus
        if isinstance(n, A.Var) and n.name in env.loops:
            return env.loops[n.name]
        if isinstance(n, A.Bin) and n.op in ("union", "intersect", "except"):
            return self.combined(n, env)
        if isinstance(n, A.Sequence) and n.items:
            return self.comma([self.sequence(x, env, ordered) for x in n.items], env, ordered)
        if isinstance(n, A.Filter) and self.plural(n.base, env):
            # positions count over the whole sequence of an iteration
            return self.filtered(self.sequence(n.base, env, True), n.predicates, (), None, env)
        if isinstance(n, A.If) and self.plural(n, env):
            return self.choice(n, env, ordered)
        if isinstance(n, A.For) and self.plural(n, env):
            return self.loop(n, env, ordered)
        if isinstance(n, A.Let):
            return self.sequence(n.body, self.bound(n.bindings, env), ordered)
        if isinstance(n, A.SimpleMap) and self.plural(n, env):
            if not self.plural(n.left, env):
                return self.loop(A.For([("__each", n.left)], substitute(n.right, "__each", back=True)), env, ordered)
            return self.mapped(self.sequence(n.left, env, ordered), n.right, env, ordered)
        if isinstance(n, A.Call):
            out = self.called(n, env, ordered)
            if out is not None:
                return out
        return self.scalar(n, env)

    def scalar(self, n: A.Node, env: Env) -> Seq:
        """An expression of values, once for each iteration."""
        if isinstance(n, A.Sequence) and not n.items:
            return Seq(self.atom_rows(env.rows.where(F.lit(False)), F.lit(""), "str", env.it, F.array(F.lit(0).cast("long"))), env.it, F.col("seq"), atoms="str")
        rows = env.rows if env.focus is None or set(env.focus.it) != set(env.it) else env.focus.df
        if env.own is not None and rows is env.rows and set(env.own[1].it) == set(env.it) and "attrs" in self.columns:
            # the innermost variable's own rows: its attributes need no join
            rows = env.own[1].df.select(*env.it, F.col("attrs").alias("__attrs"))
        s = Scope(self, rows, env)
        v = s.compile(n)
        return self.spread(s.result(), v, env.it, None)

    def spread(self, df: DataFrame, v: Val, it: tuple, at: Column | None) -> Seq:
        """A value column as atomic items, one row each; ``at`` is the order of the rows they come from."""
        if v.kind in ("arr", "map", "rec", "fn"):
            raise TypeMismatch("FOTY0012", f"a {v.kind} has no string value")
        zero = F.array(F.lit(0).cast("long"))
        if v.many:
            df = df.select("*", F.posexplode(v.col).alias("__at", "__item"))
            text, place = core.to_str(Val(F.col("__item"), v.ty.item)), F.array(F.col("__at").cast("long"))
        else:
            df = df.withColumn("__item", v.col).where("__item IS NOT NULL")
            text, place = core.to_str(Val(F.col("__item"), v.ty.item)), zero
        order = place if at is None else F.concat(at, place)
        kind = v.kind if v.kind in ("num", "bool") else "str"
        return Seq(self.atom_rows(df, text, kind, it, order), it, F.col("seq"), unique=False, atoms=kind, single=not v.many and at is None)

    def atom_rows(self, df: DataFrame, text: Column, kind: str, it: tuple, order: Column) -> DataFrame:
        types = dict(self.nodes.dtypes)
        given = {"kind": F.lit(ATOM), "name": F.lit(kind), "value": text, "str_val": text}
        return df.select(*it, *(given.get(c, F.lit(None)).cast(types[c]).alias(c) for c in self.columns), order.alias("seq"))

    def combined(self, n: A.Bin, env: Env) -> Seq:
        a, b = (self.relation(x, env) for x in (n.left, n.right))
        it = a.it
        if set(a.it) != set(b.it):
            it = tuple(x for x in env.it if x in a.it or x in b.it)
            rows = replace(env, it=it, rows=env.rows.select(*it).distinct())
            a, b = self.lift(a, rows), self.lift(b, rows)
        same = [*it, "doc_id", "pre"]
        cols = [*it, *self.columns]
        if n.op == "union":
            return Seq(a.df.select(*cols).unionByName(b.df.select(*cols)).dropDuplicates(same), it, unique=a.unique and b.unique)
        df = a.df.select(*cols) if not a.bag else a.df.select(*cols).dropDuplicates(same)
        return Seq(df.join(b.df.select(*same), same, "left_semi" if n.op == "intersect" else "left_anti"), it, flat=a.flat, level=a.level, unique=a.unique)

    def comma(self, parts: list[Seq], env: Env, ordered: bool) -> Seq:
        atoms = {p.atoms for p in parts}
        parts = [self.lift(p, env) for p in parts]
        marked = ordered or atoms != {None}
        cols = [*env.it, *self.columns]
        dfs = [p.df.withColumn("seq", F.concat(F.array(F.lit(k).cast("long")), p.key())).select(*cols, "seq") if marked else p.df.select(*cols) for k, p in enumerate(parts)]
        kind = None if atoms == {None} else next(iter(atoms)) if len(atoms) == 1 else "str"
        return Seq(functools.reduce(DataFrame.unionByName, dfs), env.it, F.col("seq") if marked else None, unique=False, bag=len(parts) > 1, atoms=kind)

    def choice(self, n: A.If, env: Env, ordered: bool) -> Seq:
        s = Scope(self, env.rows if env.focus is None or set(env.focus.it) != set(env.it) else env.focus.df, env)
        test = core.ebv(s.compile(n.test))
        rows = s.result().select(*env.it, test.alias("__test"))
        parts = []
        for branch, keep in ((n.then, F.col("__test")), (n.other, ~F.col("__test"))):
            if isinstance(branch, A.Sequence) and not branch.items:
                continue
            found = self.sequence(branch, env, ordered)
            parts.append(replace(found, df=on(rows.where(keep).select(*env.it), found.df, found.it), it=env.it))
        return replace(self.comma(parts, env, ordered), bag=any(p.bag for p in parts), unique=all(p.unique for p in parts)) if len(parts) > 1 else parts[0]

    def bound(self, bindings: list, env: Env) -> Env:
        for name, source in bindings:
            if self.plural(source, env) or variables(source) & env.loops.keys():
                env = replace(env, loops={**env.loops, name: self.sequence(source, env, True)})
            else:
                s = Scope(self, env.rows, env)
                v = s.compile(source)
                if s.joins or s.ready:
                    env = replace(env, loops={**env.loops, name: self.sequence(source, env, True)})
                else:
                    env = replace(env, values={**env.values, name: v})
        return env

    def loop(self, n: A.For, env: Env, ordered: bool) -> Seq:
        """``for``: an iteration for each item of each binding; a condition on all of them narrows the last binding."""
        bindings, body = list(n.bindings), n.body
        empty = isinstance(body, A.If) and isinstance(body.other, A.Sequence) and not body.other.items
        last, source = bindings[-1]
        if empty and isinstance(source, A.Path) and source.steps and isinstance(source.steps[-1], A.Step) and movable(body.test, last, {name for name, _ in bindings}):
            step = source.steps[-1]
            test = A.Call("boolean", [substitute(body.test, last)]) if self.kind_of(body.test, env) != "bool" else substitute(body.test, last)
            bindings[-1] = (last, replace(source, steps=[*source.steps[:-1], replace(step, predicates=[*step.predicates, test])]))
            body = body.then
        envs = [env]
        for name, source in bindings:
            now = envs[-1]
            envs.append(self.enter(self.sequence(rewrite(source), now, ordered), now, ordered, name))
        out = self.sequence(body, envs[-1], ordered)
        for inner, outer in zip(reversed(envs[1:]), reversed(envs[:-1]), strict=True):
            out = self.leave(out, inner, outer, ordered)
        return out

    def mapped(self, seq: Seq, body: A.Node, env: Env, ordered: bool, step: bool = False) -> Seq:
        """``body`` with each item as context; ``step``: nodes come once, as after a path's step."""
        if seq.atoms is None and (self.noded(body, replace(env, focus=seq)) or self.plural(body, replace(env, focus=seq))):
            inner = self.enter(seq, env, ordered)
            return self.leave(self.sequence(body, inner, ordered), inner, env, ordered, step)
        # a value for each item: no further rows
        calls = {c.name.removeprefix("fn:") for c in own_calls(body) if not c.args}
        correlated = bool(variables(body) & env.loops.keys())
        seq = self.lift(seq, env) if correlated else seq
        if seq.atoms is None:
            rows, inside = self.inside(seq, env, correlated)
            s = Scope(self, rows, inside)
        else:
            s = Scope(self, seq.df, replace(env, it=seq.it, focus=replace(seq, single=True)), item=seq)
        v = s.compile(body, position=F.col("__pos"), last=F.col("__last"))
        df = s.result()
        if calls & {"position", "last"}:
            df = self.numbered(df, seq.it, [seq.key()])
        return self.spread(df, v, seq.it, seq.key())

    def numbered(self, df: DataFrame, by: tuple, order: list[Column]) -> DataFrame:
        w = Window.partitionBy(*by)
        return df.withColumns({"__pos": F.row_number().over(w.orderBy(*order)), "__last": F.count("*").over(w)})

    # -- paths

    def path(self, n: A.Path, env: Env, ordered: bool = False) -> Seq:
        """The nodes of a path: after every step each once an iteration."""
        steps = list(n.steps)
        if isinstance(n.start, A.Root):
            now, steps = self.from_documents(steps, env, ordered)
        elif isinstance(n.start, A.Context):
            if env.focus is None:
                raise DynamicError("XPDY0002", "no context item")
            now = env.focus
            if env.free and steps and isinstance(steps[0], A.Step) and steps[0].axis in ("child", "attribute"):
                now, steps = self.from_parents(steps[0], env), steps[1:]
        else:
            now = self.relation(n.start, env, ordered)
        for s in steps:
            now = self.step(now, s, env, ordered) if isinstance(s, A.Step) else self.expression_step(now, s, env, ordered)
        return now

    def keyed(self, df: DataFrame, name: str | None) -> DataFrame:
        return df if name is None else df.withColumn(name, F.col("doc_id"))

    def simple(self, s: A.Node, first: bool) -> bool:
        """True if a step from the root, or from one of simple steps, can be a filter on the nodes."""
        if not isinstance(s, A.Step):
            return False
        if s.axis == "//@":
            return first
        return s.axis in ("child", "//", "descendant") and s.test.kind != "document" and (first or (s.test.kind in ("name", "any") and s.test.prefix is None))

    def from_documents(self, steps: list, env: Env, ordered: bool) -> tuple[Seq, list]:
        """Absolute steps: a chain of names is one filter on the nodes, without a join."""
        it = (env.doc,) if env.doc else ()
        n = 0
        while n < len(steps) and self.simple(steps[n], n == 0):
            n += 1
            if steps[n - 1].predicates or steps[n - 1].axis == "//@" or steps[n - 1].test.kind not in ("name", "any") or steps[n - 1].test.prefix is not None:
                break
        strict = ordered and self.order_mode == "reference"
        while n > 1 and ("path" not in self.columns or (strict and any(s.axis == "//" for s in steps[:n])) or (steps[n - 1].axis == "descendant" and steps[n - 1].predicates)):
            n -= 1
        if n == 0:
            return Seq(self.keyed(self.nodes.where("level = 0"), env.doc), it, flat=True, level=0, single=bool(it)), steps
        last, down = steps[n - 1], all(s.axis == "child" for s in steps[:n])
        here = test_condition(last.test, last.axis, self.namespaces)
        if last.axis != "//@":
            here = here & ~F.col("kind").isin(ATTRIBUTE, NAMESPACE)
        if n == 1:
            here = here & (F.col("level") == 1 if down else F.col("level") >= 1)
        else:
            name = lambda s: re.escape(s.test.name) if s.test.kind == "name" else "[^/]+"
            if down and all(s.test.kind == "name" for s in steps[:n]):
                here = here & (F.col("path") == "".join(f"/{s.test.name}" for s in steps[:n]))
            else:
                here = here & F.col("path").rlike("^" + "".join(("/" if s.axis == "child" else "(?:/[^/]+)*/") + name(s) for s in steps[:n]) + "$")
        found = Seq(self.keyed(self.nodes.where(here), env.doc), it, flat=down or last.axis == "//@", level=n if down else None)
        found = self.filtered(found, last.predicates, ("doc_id",) if last.axis == "descendant" else ("doc_id", "parent"), "pre", env)
        return replace(found, order=F.array("doc_id", "parent", "pre") if strict and last.axis == "//" else None), steps[n:]

    def from_parents(self, s: A.Step, env: Env) -> Seq:
        """A first child or attribute step of all nodes, keyed by the parent: what is no context meets none afterwards."""
        a, b = env.it
        here = test_condition(s.test, s.axis, self.namespaces)
        plain = F.col("kind").isin(ATTRIBUTE, NAMESPACE)
        rows = self.nodes.where(here & (F.col("kind") == ATTRIBUTE if s.axis == "attribute" else ~plain) & F.col("parent").isNotNull())
        level = env.focus.level + 1 if env.focus is not None and env.focus.level is not None else None
        rows = rows if level is None else rows.where(F.col("level") == level)
        rows = self.tested(rows, s.test)
        found = Seq(rows.withColumns({a: F.col("doc_id"), b: F.col("parent")}), env.it, flat=True, level=level)
        return self.filtered(found, s.predicates, (), "pre", env)

    def tested(self, df: DataFrame, test: A.Test) -> DataFrame:
        """``document-node(element(n))``: documents whose first element fits."""
        if test.kind != "document" or test.inner is None:
            return df
        roots = self.nodes.where((F.col("level") == 1) & (F.col("kind") == ELEMENT))
        first = roots.groupBy(F.col("doc_id").alias("__r")).agg(*(F.min_by(c, "pre").alias(c) for c in ("kind", "name", "local", "ns_uri")))
        fits = first.where(test_condition(test.inner, "child", self.namespaces)).select("__r")
        return df.join(fits, F.col("doc_id") == F.col("__r")).drop("__r")

    def step(self, ctx: Seq, s: A.Step, env: Env, ordered: bool = False) -> Seq:
        if ctx.atoms is not None:
            raise TypeMismatch("XPTY0019", f"step {s.axis} on a value")
        strict = ordered and self.order_mode == "reference"
        if s.axis == "namespace":
            return self.filtered(self.namespace_nodes(ctx, s), s.predicates, ("parent",), [F.asc("ord")], env)
        if strict and ctx.order is not None and s.axis in ("child", "attribute") and not ctx.bag:
            return self.kept_order(ctx, s, env)
        if strict and (ctx.order is not None or s.axis not in EASY):
            return self.pairwise(ctx, s, env, True)
        parental = s.axis in ("self", "child", "attribute", "//", "//@")
        counted = any(self.kind_of(p, env) in ("num", "any") or self.placed(p) for p in s.predicates)
        if counted and not parental:
            return self.nth(ctx, s, env) or self.pairwise(ctx, s, env, False)
        out = self.targets(ctx, s)
        order = F.array("doc_id", "parent", "pre") if strict and (s.axis == "//" or (s.axis in ("child", "attribute") and not ctx.flat)) else None
        by = ("doc_id", "pre") if s.axis == "self" else ("doc_id", "parent")
        return replace(self.filtered(out, s.predicates, by, "pre", env), order=order)

    def kept_order(self, ctx: Seq, s: A.Step, env: Env) -> Seq:
        """A child or attribute step of contexts in an order of their own: a node has one parent, so nothing is met twice."""
        carried = replace(ctx, df=ctx.df.withColumn("seq", ctx.key()))
        cols = [*ctx.it, *self.columns, F.concat("c_seq", F.array("pre")).alias("seq")]
        if s.axis == "attribute" and (rows := self.attributes(carried, s.test, "seq")) is not None:
            df = rows.withColumnRenamed("seq", "c_seq").select(*cols)
        else:
            c = carried.df.select(*ctx.it, F.col("doc_id").alias("c_doc"), F.col("pre").alias("c_pre"), F.col("seq").alias("c_seq"))
            df = c.join(self.goal(s), (F.col("doc_id") == F.col("c_doc")) & (F.col("parent") == F.col("c_pre"))).select(*cols)
        out = replace(ctx, df=df, level=None if ctx.level is None else ctx.level + 1, order=F.col("seq"), flat=ctx.flat or s.axis == "attribute", single=False)
        return self.filtered(out, s.predicates, ("doc_id", "parent"), "pre", env)

    @staticmethod
    def placed(p: A.Node) -> bool:
        return any(c.name.removeprefix("fn:") in ("position", "last") and not c.args for c in own_calls(p))

    def goal(self, s: A.Step) -> DataFrame:
        """The nodes that a step may reach, by its test."""
        here = test_condition(s.test, s.axis, self.namespaces)
        if s.axis not in ("attribute", "//@", "parent", "ancestor", "ancestor-or-self", "descendant-or-self"):
            here = here & ~F.col("kind").isin(ATTRIBUTE, NAMESPACE)
        if s.axis in ("attribute", "//@"):
            here = here & (F.col("kind") == ATTRIBUTE)
        # only elements and documents have others below them
        if s.axis in ("parent", "ancestor"):
            here = here & F.col("kind").isin(ELEMENT, DOCUMENT)
        return self.tested(self.nodes.where(here), s.test)

    def targets(self, ctx: Seq, s: A.Step) -> Seq:
        """The distinct nodes of a step. Contexts are reduced to distinct keys first, so results need no deduplication."""
        axis, it = s.axis, list(ctx.it)
        same = F.col("doc_id") == F.col("c_doc")
        cols = [*it, *self.columns]
        c = ctx.df.select(*it, F.col("doc_id").alias("c_doc"), F.col("pre").alias("c_pre"))
        if axis == "self":
            return replace(ctx, df=self.tested(ctx.df.where(test_condition(s.test, axis, self.namespaces)).select(*cols), s.test), order=None)
        below = replace(ctx, level=None if ctx.level is None else ctx.level + 1, order=None, single=False)
        if axis == "attribute" and (rows := self.attributes(ctx, s.test)) is not None:
            return replace(below, df=rows.select(*cols), flat=True)
        d = self.goal(s)
        if axis in ("child", "attribute"):
            c = c.distinct() if ctx.bag else c
            return replace(below, df=c.join(d, same & (F.col("parent") == F.col("c_pre"))).select(*cols), flat=ctx.flat or axis == "attribute", bag=False)
        unique = ctx.unique and (ctx.it == () or len(ctx.it) == 1)
        if axis == "parent":
            keys = ctx.df.where("parent IS NOT NULL").select(*it, F.col("doc_id").alias("c_doc"), F.col("parent").alias("c_pre")).distinct()
            return Seq(keys.join(d, same & (F.col("pre") == F.col("c_pre"))).select(*cols), ctx.it, level=ctx.level - 1 if ctx.level else None, flat=ctx.level is not None, unique=unique)
        if axis in ("ancestor", "ancestor-or-self"):
            up = F.col("anc") if axis == "ancestor" else F.concat("anc", F.array("pre"))
            keys = ctx.df.select(*it, F.col("doc_id").alias("c_doc"), F.explode(up).alias("c_pre")).distinct()
            return Seq(keys.join(d, same & (F.col("pre") == F.col("c_pre"))).select(*cols), ctx.it, unique=unique)
        if axis in ("descendant", "descendant-or-self", "//", "//@"):
            own = axis == "descendant-or-self"
            if ctx.level is not None:
                # all contexts are of one level: a node has one ancestor there
                at = F.get("anc", F.lit(ctx.level))
                at = F.when(F.col("level") == ctx.level, F.col("pre")).otherwise(at) if own else at
                d, c = d.where(F.col("level") >= ctx.level).withColumn("__a", at), c.distinct() if ctx.bag else c
            else:
                c = self.outermost(ctx).select(*it, F.col("doc_id").alias("c_doc"), F.col("pre").alias("c_pre")) if not ctx.flat else c
                d = d.withColumn("__a", F.explode(F.concat("anc", F.array("pre")) if own else F.col("anc")))
            out = c.join(d, same & (F.col("__a") == F.col("c_pre")))
            if own:
                out = out.where(~F.col("kind").isin(ATTRIBUTE, NAMESPACE) | (F.col("pre") == F.col("c_pre")))
            return Seq(out.select(*cols), ctx.it, flat=axis == "//@", unique=ctx.unique)
        if axis == "self-and-siblings":
            keys = ctx.df.where(~F.col("kind").isin(ATTRIBUTE, NAMESPACE)).select(*it, F.col("doc_id").alias("c_doc"), F.col("parent").alias("c_pre")).distinct()
            return Seq(keys.join(d, same & (F.col("parent") == F.col("c_pre"))).select(*cols), ctx.it, flat=True, level=ctx.level, unique=unique)
        # of all contexts in a group the first or last one decides
        if axis in SIBLINGS:
            edge = F.min("ord") if axis == "following-sibling" else F.max("ord")
            keys = ctx.df.where(~F.col("kind").isin(ATTRIBUTE, NAMESPACE)).groupBy(*it, F.col("doc_id").alias("c_doc"), F.col("parent").alias("c_pre")).agg(edge.alias("__edge"))
            beyond = F.col("ord") > F.col("__edge") if axis == "following-sibling" else F.col("ord") < F.col("__edge")
            return Seq(keys.join(d, same & (F.col("parent") == F.col("c_pre")) & beyond).select(*cols), ctx.it, flat=True, level=ctx.level, unique=unique)
        edge, beyond = (F.min("fin"), F.col("pre") > F.col("__edge")) if axis == "following" else (F.max("pre"), F.col("fin") < F.col("__edge"))
        if axis not in ("following", "preceding"):
            raise StaticError("XPST0010", axis)
        keys = ctx.df.groupBy(*it, F.col("doc_id").alias("c_doc")).agg(edge.alias("__edge"))
        # one row for a document and iteration: no node is met twice
        return Seq(d.join(keys, same & beyond).select(*cols), ctx.it, unique=unique)

    def attributes(self, ctx: Seq, test: A.Test, *more: str) -> DataFrame | None:
        """Attribute nodes made from their elements' ``attrs``, without a join; None if that can't be done."""
        if "attrs" not in self.columns or test.prefix is not None or test.kind not in ("name", "any") or ctx.bag:
            return None
        if test.kind == "name":
            rows, name, a = ctx.df, text(test.name), f"attrs[{text(test.name)}]"
        else:
            rows, name, a = ctx.df.selectExpr("*", "explode(attrs) AS (__k, __a)"), "__k", "__a"
        made = {
            "pre": f"pre + {a}.off", "fin": f"pre + {a}.off", "level": "level + 1", "parent": "pre", "kind": f"CAST({ATTRIBUTE} AS TINYINT)", "name": name, "local": name, "ns_uri": "''",
            "value": f"{a}.v", "str_val": f"{a}.v", "ord": f"CAST({a}.off AS BIGINT)", "anc": "concat(anc, array(pre))", "attrs": f"CAST(NULL AS {dict(self.nodes.dtypes)['attrs']})",
        }
        return rows.where(f"{a}.v IS NOT NULL").selectExpr(*ctx.it, *(f"{made.get(c, c)} AS {c}" for c in self.columns), *more)

    def attribute(self, n: A.Node) -> Column | None:
        """The value of an attribute of the row at hand, if a column holds it."""
        if "attrs" not in self.columns or not isinstance(n, A.Path) or not isinstance(n.start, A.Context) or len(n.steps) != 1:
            return None
        s = n.steps[0]
        fits = isinstance(s, A.Step) and s.axis == "attribute" and not s.predicates and s.test.kind == "name" and s.test.prefix is None
        return F.col("attrs")[s.test.name]["v"] if fits else None

    def of_variable(self, n: A.Node, env: Env) -> bool:
        """True for an attribute of a loop's variable, which is one node at most: it has one value at most."""
        here = isinstance(n, A.Path) and isinstance(n.start, A.Var) and n.start.name in env.loops and self.attribute(A.Path(A.Context(), n.steps)) is not None
        return here and env.loops[n.start.name].single and env.loops[n.start.name].atoms is None

    def outermost(self, ctx: Seq) -> DataFrame:
        """The contexts that no other one holds."""
        it = list(ctx.it)
        rows = ctx.df.dropDuplicates([*it, "doc_id", "pre"]) if ctx.bag else ctx.df
        ups = rows.select(*it, "doc_id", F.explode("anc").alias("__up"), F.col("pre").alias("__below"))
        tops = rows.select(*it, "doc_id", F.col("pre").alias("__up"))
        hit = ups.join(tops, [*it, "doc_id", "__up"]).select(*it, "doc_id", F.col("__below").alias("pre")).distinct()
        return rows.join(hit, [*it, "doc_id", "pre"], "left_anti")

    def namespace_nodes(self, ctx: Seq, s: A.Step) -> Seq:
        """In-scope namespaces of each element: the nearest declaration of a prefix, ``xml`` always; undeclared ones are out.

        Each element has nodes of its own, numbered below all others by a hash of element and prefix.
        """
        it = list(ctx.it)
        c = ctx.df.where(F.col("kind") == ELEMENT).select(*it, F.col("doc_id").alias("c_doc"), F.col("pre").alias("c_pre"), F.col("level").alias("c_level"), F.col("anc").alias("c_anc"))
        scope = c.withColumn("__a", F.explode(F.concat("c_anc", F.array("c_pre"))))
        found = self.nodes.where(F.col("kind") == NAMESPACE).select(F.col("doc_id").alias("__d"), F.col("parent").alias("__p"), F.col("pre").alias("__at"), F.col("level").alias("__l"), F.col("local").alias("prefix"), F.col("value").alias("uri"))
        known = scope.join(found, (F.col("c_doc") == F.col("__d")) & (F.col("__a") == F.col("__p"))).groupBy(*it, "c_doc", "c_pre", "c_level", "c_anc", "prefix")
        known = known.agg(F.max_by("uri", "__l").alias("uri"), F.max(F.struct("__l", -F.col("__at"))).alias("__near")).where("uri <> ''")
        known = known.select(*it, "c_doc", "c_pre", "c_level", "c_anc", "prefix", "uri", "__near")
        none = F.lit(None).cast("struct<__l:int,col2:bigint>")
        xml = c.select(*it, "c_doc", "c_pre", "c_level", "c_anc", F.lit("xml").alias("prefix"), F.lit(XML_NS).alias("uri"), none.alias("__near"))
        rows = known.union(xml).withColumn("__n", F.row_number().over(Window.partitionBy(*it, "c_doc", "c_pre").orderBy(F.desc_nulls_last("__near"))))
        types = dict(self.nodes.dtypes)
        at = -F.abs(F.xxhash64("c_pre", "prefix").bitwiseAND(F.lit((1 << 62) - 1))) - 1
        made = {"doc_id": F.col("c_doc"), "pre": at, "fin": at, "level": F.col("c_level") + 1, "parent": F.col("c_pre"), "kind": F.lit(NAMESPACE), "name": F.col("prefix"), "local": F.col("prefix"), "ns_uri": F.col("uri"), "value": F.col("uri"), "str_val": F.col("uri"), "ord": F.col("__n"), "anc": F.concat("c_anc", F.array("c_pre"))}
        df = rows.select(*it, *(made.get(c, F.lit(None)).cast(types[c]).alias(c) for c in self.columns))
        return Seq(df.where(test_condition(s.test, "namespace", self.namespaces)), ctx.it, flat=True, unique=ctx.unique)

    # -- steps that need each context by itself

    def positions(self, axis: str) -> list[Column] | str:
        """The order in which an axis numbers its nodes; "pre" for that of the document."""
        if axis in ("ancestor", "ancestor-or-self") or (axis in ("preceding", "preceding-sibling") and self.order_mode == "spec"):
            return [F.desc("pre")]
        if axis == "preceding":
            # a subtree's root stands after all that is below it
            root = F.get(F.array_except(F.concat("anc", F.array("pre")), "c_anc"), F.lit(0))
            return [root.asc(), (F.col("pre") == root).asc(), F.asc("pre")]
        return "pre"

    def pairs(self, ctx: Seq, s: A.Step, keyed: bool) -> DataFrame:
        """A row for each context and node that it reaches."""
        axis, it = s.axis, list(ctx.it)
        names = {"doc_id": "c_doc", "pre": "c_pre", "fin": "c_fin", "parent": "c_parent", "ord": "c_ord", "anc": "c_anc", "kind": "c_kind"}
        c = ctx.df.select(*it, *(F.col(a).alias(b) for a, b in names.items()), *([ctx.key().alias("c_seq")] if keyed else []))
        d = self.goal(s)
        same = F.col("doc_id") == F.col("c_doc")
        pre, parent = F.col("pre"), F.col("parent")
        if axis == "self":
            out = c.join(d, same & (pre == F.col("c_pre")))
        elif axis in ("child", "attribute"):
            out = c.join(d, same & (parent == F.col("c_pre")))
        elif axis == "parent":
            out = c.join(d, same & (pre == F.col("c_parent")))
        elif axis in ("ancestor", "ancestor-or-self"):
            up = F.col("c_anc") if axis == "ancestor" else F.concat("c_anc", F.array("c_pre"))
            out = c.withColumn("__a", F.explode(up)).join(d, same & (pre == F.col("__a")))
        elif axis in ("descendant", "descendant-or-self", "//", "//@"):
            own = axis == "descendant-or-self"
            out = c.join(d.withColumn("__a", F.explode(F.concat("anc", F.array("pre")) if own else F.col("anc"))), same & (F.col("__a") == F.col("c_pre")))
            out = out.where(~F.col("kind").isin(ATTRIBUTE, NAMESPACE) | (pre == F.col("c_pre"))) if own else out
        elif axis in ("following-sibling", "preceding-sibling", "self-and-siblings"):
            order = {"following-sibling": F.col("ord") > F.col("c_ord"), "preceding-sibling": F.col("ord") < F.col("c_ord")}.get(axis, F.lit(True))
            out = c.where(~F.col("c_kind").isin(ATTRIBUTE, NAMESPACE)).join(d, same & (parent == F.col("c_parent")) & order)
        elif axis in ("following", "preceding"):
            out = c.join(d, same & (pre > F.col("c_fin") if axis == "following" else F.col("fin") < F.col("c_pre")))
        else:
            raise StaticError("XPST0010", axis)
        return out.select(*it, "c_doc", "c_pre", "c_anc", *(["c_seq"] if keyed else []), *self.columns)

    def pairwise(self, ctx: Seq, s: A.Step, env: Env, keyed: bool) -> Seq:
        order = self.positions(s.axis)
        by = ("parent",) if s.axis == "//" else ()
        found = self.filtered(Seq(self.pairs(ctx, s, keyed), ctx.it, unique=False), s.predicates, ("c_doc", "c_pre", *by), order, env)
        it, df = found.it, found.df
        if not keyed:
            return Seq(self.once(df.select(*it, *self.columns), it, False), it, unique=len(it) <= 1)
        # the axis' place of a node, as longs
        place = {"ancestor": [F.bitwise_not("pre")], "ancestor-or-self": [F.bitwise_not("pre")], "//": [F.col("parent"), F.col("pre")]}.get(s.axis, [F.col("pre")])
        if s.axis == "preceding":
            root = F.get(F.array_except(F.concat("anc", F.array("pre")), "c_anc"), F.lit(0))
            place = [root, (F.col("pre") == root).cast("long"), F.col("pre")]
        df = df.withColumn("seq", F.concat("c_seq", F.array(*place))).select(*it, *self.columns, "seq")
        return Seq(self.once(df, it, True), it, F.col("seq"), unique=len(it) <= 1)

    def nth(self, ctx: Seq, s: A.Step, env: Env) -> Seq | None:
        """``[k]`` and ``[last()]`` on siblings and ``following``: the node's rank is counted, and joined on; None for other forms."""
        p = s.predicates[0]
        last = isinstance(p, A.Call) and p.name == "last" and not p.args
        whole = isinstance(p, A.Num) and p.value == int(p.value) and p.value >= 1
        if s.axis not in (*SIBLINGS, "following") or not (last or whole):
            return None
        rows = ctx.df if s.axis == "following" else ctx.df.where(~F.col("kind").isin(ATTRIBUTE, NAMESPACE))
        counted, group = self.ranks(rows.select(*ctx.it, *self.columns), list(ctx.it), s)
        n, total = F.col("__n"), F.col("__total")
        k = None if last else int(p.value)
        if s.axis == "preceding-sibling":
            at = n if (last and self.order_mode == "reference") or (k == 1 and self.order_mode == "spec") else F.lit(1) if last else F.lit(k) if self.order_mode == "reference" else n - k + 1
            ok = (at >= 1) & (at <= n)
        else:
            at = total if last else n + k
            ok = (at > n) & (at <= total)
        nodes = counted.where("__w = 1").select(*(F.col(f"__d.{c}").alias(c) for c in self.columns), F.col("__n").alias("__rank"))
        wanted = counted.where("__w = 0").where(ok).select(*ctx.it, *(F.col(g).alias(f"c_{g}") for g in group), at.alias("__want")).distinct()
        same = functools.reduce(lambda a, b: a & b, (F.col(g) == F.col(f"c_{g}") for g in group))
        df = nodes.join(wanted, same & (F.col("__rank") == F.col("__want"))).select(*ctx.it, *self.columns)
        out = Seq(df, ctx.it, flat=s.axis in SIBLINGS, level=ctx.level if s.axis in SIBLINGS else None, unique=len(ctx.it) <= 1)
        # what follows counts a single node for each context
        rest = s.predicates[1:]
        if any(self.kind_of(q, env) in ("num", "any") or self.placed(q) for q in rest):
            return None
        return self.filtered(out, rest, (), "pre", env)

    def ranks(self, rows: DataFrame, keep: list[str], s: A.Step) -> tuple[DataFrame, list[str]]:
        """Contexts (``__w`` 0) and a step's nodes (``__w`` 1), each with ``__n``, the nodes up to its place, and ``__total``.

        Counts run over bounded blocks of places, so a large document or family is spread over many tasks.
        """
        group = ["doc_id", "parent"] if s.axis in SIBLINGS else ["doc_id"]
        place, here = ("ord", "ord") if s.axis in SIBLINGS else ("pre", "fin") if s.axis == "following" else ("fin", "pre")
        d, strict = self.goal(replace(s, predicates=[])), s.axis.startswith("preceding")
        if s.predicates and not (isinstance(s.predicates[0], A.Num) or (isinstance(s.predicates[0], A.Call) and s.predicates[0].name == "last")):
            d = self.filtered(Seq(d, ()), s.predicates, ("doc_id", "parent"), "pre", Env((), d)).df
        types = dict(self.nodes.dtypes)
        full = "struct<" + ",".join(f"{c}:{types[c]}" for c in self.columns) + ">"
        kinds = dict(rows.dtypes)
        nodes = d.select(*(F.lit(None).cast(kinds[k]).alias(k) for k in keep), *group, F.col(place).alias("__at"), F.lit(0 if not strict else 1).alias("__tie"), F.lit(1).cast("long").alias("__w"), F.struct(*self.columns).cast(full).alias("__d"), F.lit(None).cast("long").alias("__id"))
        contexts = rows.select(*keep, *group, F.col(here).alias("__at"), F.lit(1 if not strict else 0).alias("__tie"), F.lit(0).cast("long").alias("__w"), F.lit(None).cast(full).alias("__d"), F.col("pre").alias("__id"))
        return before(nodes.unionByName(contexts), group, "__at", "__tie", "__w", "__n", "__total"), group

    # -- predicates

    def filtered(self, found: Seq, predicates: list, by: tuple, order: list[Column] | str | None, env: Env) -> Seq:
        """``by``: columns beside the iteration within which positions count; order "pre": by document, None: the sequence's."""
        for p in predicates:
            found = self.predicate(found, p, by, order, env)
        return found

    def predicate(self, found: Seq, p: A.Node, by: tuple, order: list[Column] | str | None, env: Env) -> Seq:
        """Items that a predicate keeps."""
        kinds = replace(env, focus=found if found.atoms is None else None)
        if isinstance(p, A.Bin) and p.op == "and" and not self.placed(p) and {self.kind_of(p.left, kinds), self.kind_of(p.right, kinds)} <= {"bool", "nodes"}:
            return self.predicate(self.predicate(found, p.left, by, order, env), p.right, by, order, env)
        if isinstance(p, A.Bin) and p.op == "=" and [type(x) for x in (p.left, p.right)] == [A.Call, A.Call] and {p.left.name, p.right.name} == {"position", "last"} and not p.left.args + p.right.args:
            p = A.Call("last", [])
        columns = found.df.columns
        scope = (*found.it, *by)
        place = F.col("pre") if order == "pre" else found.key() if order is None else None
        order = order if place is None else [place]
        if isinstance(p, A.Num):
            df = found.df.withColumn("__n", F.row_number().over(Window.partitionBy(*scope).orderBy(*order))).where(F.col("__n") == p.value)
            return replace(found, df=df.select(*columns), single=found.single or not by)
        if isinstance(p, A.Call) and p.name == "last" and not p.args:
            if place is None:
                df = self.numbered(found.df, scope, order).where("__pos = __last")
            else:
                # the greatest place, combined before the shuffle: no task holds all rows of a group
                rows = found.df.withColumn("__place", place)
                df = on(rows, rows.groupBy(*scope).agg(F.max("__place").alias("__edge")), scope).where("__place = __edge")
            return replace(found, df=df.select(*columns), single=found.single or not by)
        correlated = bool(variables(p) & env.loops.keys())
        if found.atoms is None and correlated and (kept := self.value_join(found, p, env)) is not None:
            return kept
        if found.atoms is None and not correlated and not self.placed(p) and (kept := self.semi(found, p, env)) is not None:
            return kept
        if found.atoms is not None:
            s = Scope(self, found.df, replace(env, it=found.it, focus=None), item=found)
        else:
            if correlated:
                found = self.lift(found, env)
                columns, scope = list(dict.fromkeys([*found.it, *columns])), (*found.it, *by)
            rows, inside = self.inside(found, env, correlated)
            s = Scope(self, rows, inside)
        v = s.compile(p, position=F.col("__pos"), last=F.col("__last"))
        numeric = v.kind == "num" and not v.many and not v.nodes
        df = s.result()
        if numeric or self.placed(p):
            df = self.numbered(df, scope, order)
        keep = F.coalesce(v.col == F.col("__pos"), F.lit(False)) if numeric else core.ebv(v)
        return replace(found, df=df.where(keep).select(*columns))

    def semi(self, found: Seq, p: A.Node, env: Env) -> Seq | None:
        """Existence of nodes, or of one that compares with a value, as a semi or anti join on the node; None for other forms."""
        keep, probe = True, replace(env, focus=found, loops={})
        while isinstance(p, A.Call) and p.name.removeprefix("fn:") in ("not", "empty", "exists", "boolean") and len(p.args) == 1:
            inner = p.args[0]
            if not (self.noded(inner, probe) or (p.name.removeprefix("fn:") in ("not", "boolean") and (isinstance(inner, A.Call) or (isinstance(inner, A.Bin) and inner.op in ("=", "!=", "<", "<=", ">", ">="))))):
                return None
            keep = keep != (p.name.removeprefix("fn:") in ("not", "empty"))
            p = inner
        rows, inside = self.inside(found, env)
        hits = self.hits(p, inside, found)
        if hits is None:
            return None
        marked = on(rows, hits.df.select(*hits.it).distinct().withColumn("__hit", F.lit(True)), hits.it, "left" if hits.it else "inner")
        # an outer join: a semi or anti join would be pushed into every branch of a union, with its whole right side
        df = marked.where("__hit") if keep else marked.where("__hit IS NULL")
        return replace(found, df=df.select(*found.df.columns))

    def hits(self, p: A.Node, inside: Env, found: Seq) -> Seq | None:
        """The nodes, as iterations of ``inside``, for which an existence test holds."""
        if self.noded(p, inside) and not isinstance(p, A.Context):
            if self.attribute(p) is not None:
                return None
            if isinstance(p, A.Path) and isinstance(p.start, A.Context) and len(p.steps) == 1 and p.steps[0].axis in ROAMING and not p.steps[0].predicates:
                return self.any_beyond(p.steps[0], inside)
            seq = self.relation(p, inside)
            return seq if seq.it else None
        if not (isinstance(p, A.Bin) and p.op in ("=", "!=", "<", "<=", ">", ">=")):
            return None
        left, right, op = p.left, p.right, p.op
        path = lambda n: isinstance(n, A.Path) and self.noded(n, inside) and self.attribute(n) is None
        if path(right) and not path(left):
            left, right, op = right, left, {"<": ">", "<=": ">=", ">": "<", ">=": "<="}.get(op, op)
        if not path(left):
            return None
        if self.noded(right, inside):
            if op != "=" or not isinstance(right, A.Path):
                return None
            # a value join: both sides meet on their string values
            values = self.relation(left, inside)
            others = self.relation(right, inside) if self.attribute(right) is None else replace(inside.focus, df=inside.focus.df.withColumn("str_val", self.attribute(right)))
            it = [x for x in inside.it if x in values.it or x in others.it]
            shared = [x for x in values.it if x in others.it]
            met = values.df.select(*values.it, "str_val").distinct().join(others.df.select(*others.it, "str_val").distinct(), [*shared, "str_val"])
            return Seq(met.select(*it), tuple(it)) if it else None
        if any(isinstance(x, A.Path | A.Context | A.Root) for x in right.walk()) or self.placed(right):
            return None
        v = replace(self.compiler, variables={**self.compiler.variables, **inside.values}).compile(right)
        if v.kind not in ("num", "str"):
            return None
        seq, value = self.valued(left, inside)
        return replace(seq, df=seq.df.where(core.general(op, Val(value, STR), v))) if seq.it else None

    def any_beyond(self, s: A.Step, inside: Env) -> Seq:
        """Contexts that have a node on a roaming axis, by the extreme place of the group's nodes."""
        group = ["doc_id", "parent"] if s.axis in SIBLINGS else ["doc_id"]
        forward = s.axis.startswith("following")
        place = "ord" if s.axis in SIBLINGS else "pre" if forward else "fin"
        edge = self.goal(s).groupBy(*group).agg((F.max if forward else F.min)(place).alias("__edge"))
        rows = inside.focus.df if s.axis in ("following", "preceding") else inside.focus.df.where(~F.col("kind").isin(ATTRIBUTE, NAMESPACE))
        here = F.col("ord" if s.axis in SIBLINGS else "fin" if forward else "pre")
        met = rows.join(edge, group).where(here < F.col("__edge") if forward else here > F.col("__edge"))
        return Seq(met, inside.it)

    def valued(self, n: A.Node, env: Env, ordered: bool = False) -> tuple[Seq, Column]:
        """Nodes and the column of their values; a last attribute step is read from its element's row."""
        last = A.Path(A.Context(), n.steps[-1:]) if isinstance(n, A.Path) and len(n.steps) > 1 else None
        value = self.attribute(last) if last is not None else None
        if value is None:
            return self.sequence(n, env, ordered), F.col("str_val")
        seq = self.sequence(replace(n, steps=n.steps[:-1]), env, ordered)
        return replace(seq, df=seq.df.where(value.isNotNull())), value

    def value_join(self, found: Seq, p: A.Node, env: Env) -> Seq | None:
        """A comparison of the candidates' values with those of a loop's variables, as a join on them; None for other forms."""
        if not (isinstance(p, A.Bin) and p.op in ("=", "!=", "<", "<=", ">", ">=")):
            return None
        left, right, op = p.left, p.right, p.op
        if variables(left) & env.loops.keys():
            left, right, op = right, left, {"<": ">", "<=": ">=", ">": "<", ">=": "<="}.get(op, op)
        own = any(isinstance(x, A.Context) for x in right.walk()) or self.placed(right)
        if variables(left) & env.loops.keys() or own or not (isinstance(right, A.Var) or (isinstance(right, A.Path) and isinstance(right.start, A.Var))):
            return None
        rows, inside = self.inside(found, env)
        if not (isinstance(left, A.Context) or self.noded(left, inside)):
            return None
        other, value = self.valued(right, env)
        own_value = F.col("str_val") if isinstance(left, A.Context) else self.attribute(left)
        if own_value is not None:
            mine = rows.withColumn("__mine", own_value).where("__mine IS NOT NULL")
        else:
            seq, text = self.valued(left, inside)
            mine = on(rows, seq.df.select(*seq.it, text.alias("__mine")), seq.it)
        theirs = other.df.select(*other.it, value.alias("__theirs"))
        shared = [x for x in found.it if x in other.it]
        theirs = theirs.select(*(F.col(x).alias(f"__k_{x}") if x in shared else F.col(x) for x in other.it), "__theirs").distinct()
        same = functools.reduce(lambda a, b: a & b, (F.col(x) == F.col(f"__k_{x}") for x in shared), F.lit(True))
        kind = other.atoms or "str"
        a, b = Val(F.col("__mine"), STR), Val(core.parse_number(F.col("__theirs")), core.NUM) if kind == "num" else Val(F.col("__theirs"), STR)
        if op == "=" and kind != "num":
            met = mine.join(theirs, same & (F.col("__mine") == F.col("__theirs")))
        elif op == "=":
            met = mine.withColumn("__number", core.parse_number(F.col("__mine"))).join(theirs.withColumn("__value", b.col), same & (F.col("__number") == F.col("__value")) & ~F.isnan("__number"))
        else:
            met = self.theta(mine, theirs, shared, op, a, b)
        it = tuple(x for x in env.it if x in found.it or x in other.it)
        one = own_value is not None and (other.single or self.of_variable(right, env))
        extra = [c for c in found.df.columns if c not in found.it]
        df = met.select(*it, *extra)
        df = df if one else df.dropDuplicates([*it, "doc_id", "pre", *(c for c in ("c_doc", "c_pre") if c in extra)])
        return replace(found, df=df, it=it, unique=False)

    def theta(self, mine: DataFrame, theirs: DataFrame, shared: list[str], op: str, a: Val, b: Val) -> DataFrame:
        """Pairs of equal ``shared`` columns that compare by order or differ.

        Numbers are read once a row, not once a pair; of a group's candidates only those beyond the other side's edge are paired.
        """
        keys = [f"__k_{x}" for x in shared]
        same = functools.reduce(lambda p, q: p & q, (F.col(x) == F.col(k) for x, k in zip(shared, keys, strict=True)), F.lit(True))
        if op == "!=":
            return mine.join(theirs, same & core.compare(op, a, b))
        x, y = F.col("__x"), F.col("__y")
        beyond = lambda p, q: {"<": p < q, "<=": p <= q, ">": p > q, ">=": p >= q}[op]
        mine, theirs = (df.withColumn(name, core.to_num(v)).where(~F.isnan(name)) for df, name, v in ((mine, "__x", a), (theirs, "__y", b)))
        edge = (F.min if op in (">", ">=") else F.max)("__y").alias("__edge")
        edges = theirs.groupBy(*(F.col(k).alias(f"{k}_e") for k in keys)).agg(edge) if keys else theirs.agg(edge)
        near = functools.reduce(lambda p, q: p & q, (F.col(s) == F.col(f"{k}_e") for s, k in zip(shared, keys, strict=True)), F.lit(True))
        mine = mine.join(edges, near & beyond(x, F.col("__edge"))).drop("__edge", *(f"{k}_e" for k in keys))
        # a row makes many pairs: rows are dealt evenly first, however few files or bytes hold them
        mine = mine.repartition(int(mine.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id", "pre")
        return mine.join(theirs, same & beyond(x, y))

    def expression_step(self, ctx: Seq, s: A.Node, env: Env, ordered: bool) -> Seq:
        """A step that is any expression, with each node as its context."""
        return self.mapped(ctx, s, env, ordered, step=True)

    # -- functions that give sequences

    def called(self, n: A.Call, env: Env, ordered: bool) -> Seq | None:
        name = n.name.removeprefix("fn:")
        if name in SOURCES:
            return self.source(name, n, env)
        if name == "root" and not n.args:
            return self.roots(env.focus)
        if not n.args or not (self.plural(n.args[0], env) or (name in NODE_CALLS and self.noded(n.args[0], env))):
            return None
        if name == "distinct-values":
            seq, value = self.valued(n.args[0], env, True)
            df = seq.df.withColumn("__v", value).groupBy(*seq.it, F.col("__v").alias("__v")).agg(F.min(seq.key()).alias("__k"))
            return Seq(self.atom_rows(df, F.col("__v"), seq.atoms or "str", seq.it, F.col("__k")), seq.it, F.col("seq"), unique=False, atoms=seq.atoms or "str")
        if name == "data":
            seq = self.sequence(n.args[0], env, True)
            return seq if seq.atoms else Seq(self.atom_rows(seq.df, F.col("str_val"), "str", seq.it, seq.key()), seq.it, F.col("seq"), unique=False, atoms="str")
        if name not in NODE_CALLS:
            return None
        if name == "root":
            return self.roots(self.relation(n.args[0], env))
        if name in ("innermost", "outermost"):
            seq = self.relation(n.args[0], env)
            if name == "outermost":
                return replace(seq, df=self.outermost(seq), flat=True, order=None, bag=False)
            same = [*seq.it, "doc_id", "pre"]
            ups = seq.df.select(*seq.it, "doc_id", F.explode("anc").alias("pre")).distinct()
            return replace(seq, df=seq.df.join(ups, same, "left_anti"), flat=True, order=None)
        if name in ("unordered", "one-or-more", "zero-or-one", "exactly-one", "copy-of"):
            seq = self.sequence(n.args[0], env, ordered)
            return seq if name in ("unordered", "copy-of") else self.checked(name, seq, env)
        seq = self.sequence(n.args[0], env, True)
        if name == "reverse":
            back = F.transform(seq.key(), F.bitwise_not)
            return replace(seq, df=seq.df.withColumn("seq", back), order=F.col("seq"))
        if name == "sort":
            return self.sorted(seq, n, env)
        if name == "insert-before":
            return self.inserted(seq, n, env)
        df = self.numbered(seq.df, seq.it, [seq.key()])
        at = F.col("__pos")
        if name in ("head", "tail"):
            keep = at == 1 if name == "head" else at > 1
        else:
            bounds = [replace(self.compiler, variables={**self.compiler.variables, **env.values}).compile(x) for x in n.args[1:]]
            start = core.js_round(core.to_num(bounds[0]))
            if name == "remove":
                keep = at != F.floor(core.to_num(bounds[0]))
            else:
                keep = (at >= start) & (at < start + core.js_round(core.to_num(bounds[1])) if len(bounds) > 1 else F.lit(True))
        return replace(seq, df=df.where(keep).drop("__pos", "__last"), single=seq.single or name == "head")

    def checked(self, name: str, seq: Seq, env: Env) -> Seq:
        """Cardinality functions: an iteration of another size raises when its rows are read."""
        sizes = on(env.rows.select(*env.it), seq.df.groupBy(*seq.it).agg(F.count("*").alias("__size")), seq.it, "left" if seq.it else "inner")
        size = F.coalesce("__size", F.lit(0))
        bad = {"one-or-more": size == 0, "zero-or-one": size > 1, "exactly-one": size != 1}[name]
        ok = sizes.select(*env.it, F.when(bad, F.raise_error(F.lit(f"XPTY0004: {name}")).cast("boolean")).otherwise(True).alias("__fine"))
        seq = self.lift(seq, env)
        return replace(seq, df=on(ok, seq.df, env.it, "left" if env.it else "inner").where("__fine AND kind IS NOT NULL").drop("__fine"), single=name != "one-or-more")

    def sorted(self, seq: Seq, n: A.Call, env: Env) -> Seq:
        """``sort``: by value or by a function of each item; equal keys keep their order."""
        value: Column = F.col("str_val")
        df = seq.df
        if len(n.args) > 2:
            rows, inside = self.inside(seq, env)
            s = Scope(self, rows, inside)
            key = s.compile(n.args[2]).call([s.focus()]) if not isinstance(n.args[2], A.Inline) else s.compile(substitute(n.args[2].body, n.args[2].params[0]))
            key = core.one(key)
            df, value = s.result(), key.col if key.kind in ("num", "bool", "date", "ts") else core.to_str(key)
        elif seq.atoms == "num":
            value = core.parse_number(value)
        w = Window.partitionBy(*seq.it).orderBy(value, seq.key())
        df = df.withColumn("__rank", F.array(F.row_number().over(w).cast("long")))
        rest = [c for c in seq.df.columns if c != "seq"]
        return replace(seq, df=df.select(*rest, F.col("__rank").alias("seq")), order=F.col("seq"))

    def inserted(self, seq: Seq, n: A.Call, env: Env) -> Seq:
        """``insert-before``: items before the position, the new ones, and the others."""
        at = core.to_num(replace(self.compiler, variables={**self.compiler.variables, **env.values}).compile(n.args[1]))
        df = self.numbered(self.lift(seq, env).df, env.it, [seq.key()])
        head = replace(seq, df=df.where((F.col("__pos") < at) | (F.col("__last") < F.col("__pos"))).drop("__pos", "__last"), it=env.it)
        tail = replace(seq, df=df.where(F.col("__pos") >= at).drop("__pos", "__last"), it=env.it)
        return self.comma([head, self.sequence(n.args[2], env, True), tail], env, True)

    def roots(self, seq: Seq | None) -> Seq:
        if seq is None:
            raise DynamicError("XPDY0002", "no context item")
        docs = seq.df.select(*seq.it, F.col("doc_id").alias("c_doc")).distinct()
        return Seq(self.nodes.where("level = 0").join(docs, F.col("doc_id") == F.col("c_doc")).select(*seq.it, *self.columns), seq.it, flat=True, level=0, unique=len(seq.it) <= 1)

    def source(self, name: str, n: A.Call, env: Env) -> Seq:
        """``doc``, ``document``, ``collection`` by address; ``key`` as the loop over its value that it stands for."""
        if name == "key":
            if not isinstance(n.args[0], A.Str) or n.args[0].value not in self.keys:
                raise StaticError("XPST0001", "key() needs the name of a declared key")
            pattern, use = self.keys[n.args[0].value]
            where = A.Path(A.Root(), [A.Step("//", A.Test("name", pattern), [A.Bin("=", use, A.Var("__key"))])])
            return replace(self.loop(A.For([("__key", n.args[1])], where), env, False), bag=True)
        if self.catalog is None:
            raise DynamicError("FODC0005", "no documents are known by address")
        if n.args and not isinstance(n.args[0], A.Str):
            raise StaticError("XPST0001", f"the address of {name}() must be a literal")
        uri = n.args[0].value if n.args else None
        docs = self.catalog.known(uri, collection=name == "collection")
        rows = self.nodes.where("level = 0").join(docs.select(F.col("doc_id").alias("__known")).distinct(), F.col("doc_id") == F.col("__known")).select(*self.columns)
        return Seq(rows, (), flat=True, level=0, single=name != "collection")


class Scope:
    """Rows that an expression is evaluated on; what it reads from nodes becomes columns of them, by a left join each.

    Aggregates over one path share a group-by and a join. ``item``: the rows are atomic items, which are the focus.
    """

    def __init__(self, paths: Paths, rows: DataFrame, env: Env, item: Seq | None = None):
        self.paths, self.rows, self.env, self.item = paths, rows, env, item
        self.joins: dict[str, tuple[Seq, list[Column]]] = {}
        self.ready: list[tuple[DataFrame, list[str]]] = []
        self.at_nodes = item is None and env.focus is not None and "str_val" in rows.columns

    def name(self) -> str:
        self.paths.made += 1
        return f"__v{self.paths.made}"

    def focus(self) -> Val | None:
        if self.item is not None:
            text = F.col("str_val")
            return {"num": num(core.parse_number(text)), "bool": boolean(text == "true")}.get(self.item.atoms, string(text))
        return Val(F.col("str_val"), STR, nodes=False) if self.at_nodes else None

    def compile(self, n: A.Node, **where) -> Val:
        c = self.paths.compiler
        return replace(c, variables={**c.variables, **self.env.values}, paths=self, focus=self.focus(), **where).compile(n)

    def join(self, seq: Seq, column: Column, default: Column | None = None, key: str | None = None) -> Column:
        """A column of one aggregated value for each iteration."""
        name = self.name()
        self.joins.setdefault(key or name, (seq, []))[1].append(column.alias(name))
        return F.col(name) if default is None else F.coalesce(F.col(name), default)

    def result(self) -> DataFrame:
        """The rows with all columns that were asked for."""
        rows = self.rows
        for seq, columns in self.joins.values():
            found = seq.df.groupBy(*seq.it).agg(*columns) if seq.it else seq.df.agg(*columns)
            rows = on(rows, found, seq.it, "left")
        for found, keys in self.ready:
            rows = on(rows, found, keys, "left")
        return rows

    # -- hooks of the compiler

    def takes(self, n: A.Node) -> bool:
        """True for expressions that must be computed as rows."""
        if isinstance(n, A.Let):
            return any(self.paths.plural(source, self.env) for _, source in n.bindings)
        return isinstance(n, A.For | A.SimpleMap | A.Filter | A.Sequence | A.If | A.Call | A.Root | A.Path) and self.paths.plural(n, self.env)

    def variable(self, name: str) -> Val | None:
        if name not in self.env.loops:
            return None
        seq = self.env.loops[name]
        if not seq.single:
            return self.collected(seq, f"${name}")
        text = self.join(seq, F.max("str_val"), key=f"${name}")
        return self.typed(text, seq)

    def typed(self, text: Column, seq: Seq) -> Val:
        if seq.atoms == "num":
            return num(core.parse_number(text))
        return boolean(text == "true") if seq.atoms == "bool" else Val(text, STR, nodes=seq.atoms is None)

    def collected(self, seq: Seq, key: str | None) -> Val:
        pairs = F.sort_array(F.collect_list(F.struct(seq.key().alias("k"), F.col("str_val").alias("v"))))
        texts = self.join(seq, F.transform(pairs, lambda p: p["v"]), F.array().cast("array<string>"), key)
        if seq.atoms == "num":
            return Val(F.transform(texts, core.parse_number), core.NUM.seq)
        return Val(texts, STR.seq, nodes=seq.atoms is None)

    def value(self, c: Compiler, n: A.Node) -> Val:
        """Nodes as a value: their string values, in order."""
        if isinstance(n, A.Let):
            outer, self.env = self.env, self.paths.bound(n.bindings, self.env)
            out = replace(c, variables={**c.variables, **self.env.values}).compile(n.body)
            self.env = outer
            return out
        if isinstance(n, A.Path) and isinstance(n.start, A.Context) and not n.steps and c.focus is not None:
            return c.focus
        if self.item is not None and isinstance(n, A.Path) and isinstance(n.start, A.Context):
            return replace(c, paths=None).on_path(n)
        if self.at_nodes and (own := self.paths.attribute(n)) is not None:
            return Val(own, STR, nodes=True)
        if isinstance(n, A.Path) and isinstance(n.start, A.Var) and n.start.name not in self.env.loops:
            return replace(c, paths=None).on_path(n)
        if isinstance(n, A.Path) and isinstance(n.start, A.Var) and self.paths.of_variable(n, self.env):
            name, (step,) = n.start.name, n.steps
            if self.env.own is not None and self.env.own[0] == name and self.env.own[1] is self.env.loops[name] and "__attrs" in self.rows.columns:
                return Val(F.col("__attrs")[step.test.name]["v"], STR, nodes=True)
            return Val(self.join(self.env.loops[name], F.max(F.col("attrs")[step.test.name]["v"]), key=f"${name}"), STR, nodes=True)
        return self.collected(self.paths.sequence(n, self.env, True), f"value {n!r}")

    def is_kind(self, n: A.TypeOp) -> Val | None:
        """``. instance of element(name)`` and the like; None for types of values."""
        kinds = {"node": None, "element": (1,), "attribute": (2,), "text": (3, 4), "comment": (8,), "processing-instruction": (7,), "document-node": (9,), "schema-element": (1,), "schema-attribute": (2,)}
        if n.op != "instance of" or n.type.item not in kinds or not isinstance(n.operand, A.Context) or not self.at_nodes:
            return None
        of = kinds[n.type.item]
        out = F.lit(True) if of is None else F.col("kind").isin(*of)
        return boolean(out & (F.col("local") == n.type.name.rpartition(":")[2]) if n.type.name not in (None, "*") else out)

    def set_value(self, c: Compiler, n: A.Bin) -> Val:
        if n.op not in ("is", "<<", ">>"):
            return self.collected(self.paths.relation(n, self.env), f"value {n!r}")
        a, b = (self.identity(x) for x in (n.left, n.right))
        return boolean({"is": a == b, "<<": a < b, ">>": a > b}[n.op])

    def identity(self, n: A.Node) -> Column:
        if isinstance(n, A.Context) and self.at_nodes:
            return F.struct("doc_id", "pre")
        seq = self.paths.relation(n, self.env, True)
        return self.join(seq, F.min_by(F.struct("doc_id", "pre"), seq.key()))

    #: Functions of the row at hand, by column.
    OWN = {"name": "name", "local-name": "local", "namespace-uri": "ns_uri", "node-name": "name"}
    NODE = ("has-children", "generate-id", "path", "nilled", "base-uri", "document-uri", "in-scope-prefixes", "root", "accumulator-before", "accumulator-after")

    def own(self, name: str) -> Val | None:
        """A function of the context node."""
        if name in self.OWN:
            return string(F.coalesce(F.col(self.OWN[name]), F.lit("")))
        if name == "has-children":
            return boolean(self.join(self.relative(A.Step("child", A.Test("node"))), F.bool_or(F.lit(True)), F.lit(False), "has-children"))
        if name == "generate-id":
            return string(F.concat(F.lit("n"), F.lower(F.hex(F.xxhash64("doc_id", "pre")))))
        if name == "path":
            return self.node_path()
        if name in ("nilled", "base-uri", "document-uri", "in-scope-prefixes"):
            return self.inherited(name)
        return None

    def relative(self, *steps: A.Step) -> Seq:
        return self.paths.relation(A.Path(A.Context(), list(steps)), self.env)

    def call(self, c: Compiler, n: A.Call) -> Val | None:
        """Functions that read nodes, as aggregates over their rows; None for all others."""
        name = n.name.removeprefix("fn:")
        here = not n.args or (len(n.args) == 1 and isinstance(n.args[0], A.Context))
        if here and self.at_nodes and (name in self.OWN or name in self.NODE):
            return self.own(name)
        if name in ("string", "number", "data", "string-length", "normalize-space") and here and self.at_nodes:
            return None
        if name in ("accumulator-before", "accumulator-after"):
            return self.accumulated(name, n)
        if name == "lang" and len(n.args) == 1 and self.at_nodes:
            found = string(self.join(self.relative(A.Step("ancestor-or-self", A.Test("node")), A.Step("attribute", A.Test("name", "lang"))), F.max_by("str_val", "level")))
            return c.bind("lang", found).resolve("lang", 1)([c.compile(n.args[0])])
        if name == "namespace-uri-for-prefix" and self.at_nodes:
            prefix = core.str0(c.compile(n.args[0]))
            seq = self.relative(A.Step("namespace", A.Test("any")))
            entries = self.join(seq, F.map_from_entries(F.collect_list(F.struct("local", "str_val"))), key="in scope")
            return string(F.try_element_at(entries, prefix))
        if name == "resolve-QName" and len(n.args) == 2 and isinstance(n.args[0], A.Str) and self.at_nodes:
            prefix, _, _ = n.args[0].value.rpartition(":")
            uri = self.join(self.relative(A.Step("namespace", A.Test("name", prefix))), F.max("str_val"))
            known = F.when(uri.isNotNull(), uri) if prefix else F.coalesce(uri, F.lit(""))
            missing = F.raise_error(F.lit(f"FONS0004: no namespace for prefix {prefix}")).cast("string")
            return Val(F.concat(F.lit("{"), F.coalesce(known, missing), F.lit("}"), F.lit(n.args[0].value)), Ty("qname"))
        if name == "doc-available":
            return self.available(c, n)
        if not n.args:
            return None
        if name in (*self.OWN, *self.NODE) and self.paths.noded(n.args[0], self.env):
            if name == "in-scope-prefixes":
                return c.compile(A.Call("distinct-values", [A.SimpleMap(n.args[0], A.Call(name, []))]))
            if name == "root":
                return None
            found = core.one(self.collected(self.paths.mapped(self.paths.sequence(n.args[0], self.env, True), A.Call(name, []), self.env, True), None))
            if name == "has-children":
                return boolean(F.coalesce(found.col == "true", F.lit(False)))
            return string(F.coalesce(found.col, F.lit("")))
        if not self.paths.plural(n.args[0], self.env):
            return None
        return self.aggregated(c, name, n)

    def aggregated(self, c: Compiler, name: str, n: A.Call) -> Val | None:
        arg = n.args[0]
        if self.at_nodes and (own := self.paths.attribute(arg)) is not None:
            return self.single(name, Val(own, STR, nodes=True), c, n)
        if name not in ("count", "exists", "boolean", "empty", "not", "sum", "avg", "min", "max", "string", "data", "number", "string-join", "distinct-values") or len(n.args) > (2 if name == "string-join" else 1):
            return None
        if (found := self.tallied(name, arg)) is not None:
            return found
        ordered = name in ("string", "data", "number", "string-join")
        key = f"{ordered} {replace(arg, steps=arg.steps[:-1])!r}" if isinstance(arg, A.Path) and len(arg.steps) > 1 and self.paths.attribute(A.Path(A.Context(), arg.steps[-1:])) is not None else f"{ordered} {arg!r}"
        value: Column | None = None
        if key in self.joins:
            seq = self.joins[key][0]
        else:
            seq, _ = self.whole(arg, ordered)
        value = self.whole_value(arg)
        join = functools.partial(self.join, seq, key=key)
        number, zero = core.parse_number(value), F.lit(0.0)
        some = F.count(value)
        if name == "count":
            return num(join(some.cast("double"), zero))
        if name in ("exists", "empty") or (name in ("boolean", "not") and seq.atoms is None):
            out = join(some > 0, F.lit(False))
            return boolean(out if name in ("exists", "boolean") else ~out)
        if name in ("boolean", "not"):
            return None
        if name == "sum":
            return num(join(F.sum(F.nanvl(number, zero)), zero))
        if name == "avg":
            return num(join(F.sum(F.nanvl(number, zero)) / some))
        if name in ("min", "max"):
            pick = F.min(number) if name == "min" else F.max(number)
            return num(join(F.when(F.bool_or(F.isnan(number)), core.nan()).otherwise(pick)))
        at = F.when(value.isNotNull(), seq.key())
        if name in ("string", "data"):
            return string(join(F.min_by(value, at), F.lit("")))
        if name == "number":
            return num(join(F.min_by(number, at), core.nan()))
        if name == "string-join":
            sep = c.compile(n.args[1]).literal if len(n.args) > 1 else ""
            pairs = F.sort_array(F.collect_list(F.when(value.isNotNull(), F.struct(seq.key().alias("k"), value.alias("v")))))
            return string(join(F.array_join(F.transform(pairs, lambda p: p["v"]), sep or ""), F.lit("")))
        return Val(join(F.array_sort(F.collect_set(value)), F.array().cast("array<string>")), STR.seq)

    def whole(self, arg: A.Node, ordered: bool) -> tuple[Seq, Column]:
        """The rows that an aggregate reads: an attribute step's elements, with absent attributes as NULL."""
        value = self.whole_value(arg)
        if isinstance(arg, A.Path) and len(arg.steps) > 1 and self.paths.attribute(A.Path(A.Context(), arg.steps[-1:])) is not None:
            return self.paths.sequence(replace(arg, steps=arg.steps[:-1]), self.env, ordered), value
        return self.paths.sequence(arg, self.env, ordered), value

    def whole_value(self, arg: A.Node) -> Column:
        if isinstance(arg, A.Path) and len(arg.steps) > 1 and (value := self.paths.attribute(A.Path(A.Context(), arg.steps[-1:]))) is not None:
            return value
        return F.coalesce("str_val", F.lit(""))

    def single(self, name: str, v: Val, c: Compiler, n: A.Call) -> Val | None:
        """Aggregates of an attribute that is a column."""
        number = F.nanvl(core.parse_number(v.col), F.lit(0.0))
        there = v.col.isNotNull()
        if name == "count":
            return num(there.cast("double"))
        if name in ("exists", "boolean"):
            return boolean(there)
        if name in ("empty", "not"):
            return boolean(~there)
        if name == "sum" and len(n.args) == 1:
            return num(F.coalesce(number, F.lit(0.0)))
        return num(F.when(there, number)) if name == "avg" else None

    def tallied(self, name: str, arg: A.Node) -> Val | None:
        """``count`` along a roaming axis from the context: a difference of running counts; None for other forms."""
        if not (name in ("count", "exists", "empty") and self.at_nodes and self.env.free and isinstance(arg, A.Path) and isinstance(arg.start, A.Context) and len(arg.steps) == 1):
            return None
        s = arg.steps[0]
        probe = replace(self.env, focus=self.paths.any_node())
        if not (isinstance(s, A.Step) and s.axis in ROAMING and not any(self.paths.kind_of(p, probe) in ("num", "any") or self.paths.placed(p) or variables(p) for p in s.predicates)):
            return None
        focus = self.env.focus
        counted, _ = self.paths.ranks(focus.df, list(self.env.it), s)
        n = F.col("__total") - F.col("__n") if s.axis.startswith("following") else F.col("__n")
        column = self.name()
        still = F.col("__w") == 0
        if s.axis in SIBLINGS:
            plain = focus.df.where(~F.col("kind").isin(ATTRIBUTE, NAMESPACE)).select(*self.env.it)
            counted = counted.join(plain, list(self.env.it), "left_semi")
        self.ready.append((counted.where(still).select(*self.env.it, n.cast("double").alias(column)), list(self.env.it)))
        out = F.coalesce(F.col(column), F.lit(0.0))
        return num(out) if name == "count" else boolean(out > 0 if name == "exists" else out == 0)

    def accumulated(self, name: str, n: A.Call) -> Val:
        """An accumulator's running value at the context node."""
        from ..streaming.runtime import accumulate

        if not n.args or not isinstance(n.args[0], A.Str) or not self.at_nodes or len(self.env.focus.it) < 2:
            raise StaticError("XPST0001", f"{name} needs an accumulator's name and a context node")
        known = [a for a in self.paths.accumulators if a.name == n.args[0].value]
        if not known:
            raise DynamicError("XPDY0002", f"no accumulator {n.args[0].value}")
        a, b = self.env.focus.it[-2:]
        rows = accumulate(self.paths.nodes, known).select(F.col("doc_id").alias(a), F.col("pre").alias(b), F.col(f"{known[0].name}_before").alias("__before"), F.col(f"{known[0].name}_after").alias("__after"))
        return num(self.join(Seq(rows, (a, b)), F.max("__before" if name.endswith("before") else "__after").cast("double"), key=f"accumulator {known[0].name}"))

    def available(self, c: Compiler, n: A.Call) -> Val:
        if self.paths.catalog is None:
            return boolean(False)
        column = self.name()
        uris = self.paths.catalog.documents.select(F.col("uri").alias(f"__u{column}")).distinct()
        self.rows = self.rows.join(uris.withColumn(column, F.lit(True)), core.str0(c.compile(n.args[0])) == F.col(f"__u{column}"), "left").drop(f"__u{column}")
        return boolean(F.coalesce(F.col(column), F.lit(False)))

    def node_path(self) -> Val:
        """Names of the ancestors and the node, with an index where siblings share a name."""
        nodes = self.paths.nodes
        w = Window.partitionBy("doc_id", "parent", "kind", "name")
        named = nodes.where("level > 0").select("doc_id", "pre", "level", F.when(F.col("kind") == ATTRIBUTE, F.concat(F.lit("@"), "name")).otherwise(F.col("name")).alias("nm"), F.row_number().over(w.orderBy("pre")).alias("i"), F.count("*").over(w).alias("k"))
        part = F.when(F.col("k") > 1, F.concat("nm", F.lit("["), F.col("i").cast("string"), F.lit("]"))).otherwise(F.col("nm"))
        ups = self.env.focus.df.select(*self.env.focus.it, "doc_id", F.explode(F.concat("anc", F.array("pre"))).alias("pre"))
        rows = ups.join(named, ["doc_id", "pre"]).select(*self.env.focus.it, "level", part.alias("part"))
        pairs = F.sort_array(F.collect_list(F.struct("level", "part")))
        return string(self.join(Seq(rows, self.env.focus.it), F.concat(F.lit("/"), F.array_join(F.transform(pairs, lambda p: p["part"]), "/")), F.lit("/")))

    def inherited(self, name: str) -> Val:
        if name == "in-scope-prefixes":
            found = self.join(self.relative(A.Step("namespace", A.Test("any"))), F.array_sort(F.collect_set("local")), F.array().cast("array<string>"))
            return Val(found, STR.seq)
        if name == "nilled":
            return boolean(self.join(self.relative(A.Step("attribute", A.Test("name", "nil"))), F.bool_or(F.col("str_val").isin("true", "1")), F.lit(False)))
        if name == "base-uri":
            rows = self.relative(A.Step("ancestor-or-self", A.Test("node")), A.Step("attribute", A.Test("name", "base")))
            return string(self.join(rows, F.max_by("str_val", "level"), F.lit(self.paths.compiler.options.base_uri)))
        return string(F.when(F.col("kind") == DOCUMENT, F.col("value")))


def scans(*queries: A.Node) -> int:
    """How often queries read the nodes, about."""
    n = 0
    for q in queries:
        for x in q.walk():
            if isinstance(x, A.Path):
                moving = [s for s in x.steps if isinstance(s, A.Step) and s.axis not in ("self", "attribute")]
                chained = isinstance(x.start, A.Root) and all(isinstance(s, A.Step) and s.test.kind in ("name", "any") for s in moving) and not any(s.predicates for s in moving[:-1])
                n += 1 if chained and moving else len(moving)
    return n


def result(p: Paths, out: Seq, it: tuple) -> DataFrame:
    """Items with ``it``, the document they were selected from, and ``seq`` where their order isn't the documents'."""
    df = out.df
    first = F.col(it[0]) if it and it[0] in df.columns else F.col("doc_id")
    doc = F.coalesce("doc_id", first) if out.atoms else F.col("doc_id")
    cols = [first.alias("it"), *((doc if c == "doc_id" else F.col(c)).alias(c) for c in p.columns)]
    return df.select(*cols, *([out.order.alias("seq")] if out.order is not None else []))


def select(nodes: DataFrame, query: A.Node, compiler: Compiler, **options) -> DataFrame:
    """The items that a query gives in each document: nodes, or values as rows of kind 0."""
    p = Paths(nodes, compiler, **options)
    env = p.top()
    query = rewrite(query)
    # nodes of paths can be sorted by their place; other sequences tell their order
    plain = isinstance(query, A.Root | A.Bin) or (isinstance(query, A.Path) and isinstance(query.start, A.Root | A.Context))
    out = p.sequence(query, env, not plain)
    return result(p, p.lift(out, env), env.it)


def values(nodes: DataFrame, each: A.Node, queries: dict[str, A.Node], compiler: Compiler, **options) -> DataFrame:
    """``doc_id, pre`` and one column per query, for each node of ``each``, which is the queries' context."""
    p = Paths(nodes, compiler, **options)
    env = p.top()
    rows, inside = p.inside(p.relation(rewrite(each), env), env)
    s = Scope(p, rows, inside)
    out = {name: s.compile(rewrite(q)).col for name, q in queries.items()}
    return s.result().select("doc_id", "pre", *(c.alias(k) for k, c in out.items()))


def flwor(nodes: DataFrame, query: A.For, compiler: Compiler, **options) -> DataFrame:
    """``for $x in path return value`` as ``doc_id, pre, value``; over distinct-values of all documents as ``key, value``."""
    (name, source), *more = query.bindings
    if not more and isinstance(source, A.Call) and source.name == "distinct-values":
        return grouped(nodes, name, source.args[0], query.body, compiler, **options)
    if more or not movable(query.body, name, {name}):
        out = select(nodes, query, compiler, **options)
        return out.select("doc_id", "pre", F.col("str_val").alias("value"), *(["seq"] if "seq" in out.columns else []))
    return values(nodes, source, {"value": substitute(query.body, name)}, compiler, **options)


def grouped(nodes: DataFrame, name: str, source: A.Path, body: A.Node, compiler: Compiler, **options) -> DataFrame:
    """``for $k in distinct-values(P/k) return agg(Q[k = $k]/v)`` as one group-by on the key."""
    p = Paths(nodes, compiler, **options)
    if not (isinstance(body, A.Call) and body.name in ("count", "sum", "avg", "min", "max") and isinstance(body.args[0], A.Path)):
        raise TypeMismatch("XPTY0004", "grouping needs an aggregate over a path")
    path = rewrite(body.args[0])
    steps = list(path.steps)
    test = next((q for s in steps for q in s.predicates if isinstance(q, A.Bin) and q.op == "=" and isinstance(q.right, A.Var) and q.right.name == name), None)
    if test is None or rewrite(source).steps[-1] != (test.left.steps[-1] if isinstance(test.left, A.Path) else None):
        raise TypeMismatch("XPTY0004", f"grouping needs a comparison with ${name}")
    at = next(k for k, s in enumerate(steps) if any(q is test for q in s.predicates))
    owner = replace(steps[at], predicates=[q for q in steps[at].predicates if q is not test])
    env = p.top()
    rows, inside = p.inside(p.path(A.Path(path.start, [*steps[:at], owner]), env), env)
    own = p.attribute(test.left)
    if own is not None:
        key = rows.withColumn("key", own).where("key IS NOT NULL")
    else:
        seq = p.relation(test.left, inside)
        key = on(rows, seq.df.select(*seq.it, F.col("str_val").alias("key")).distinct(), seq.it)
    key = key.select(*inside.it, "key")
    if steps[at + 1 :]:
        seq, value = p.valued(A.Path(A.Context(), steps[at + 1 :]), inside)
        key = on(key, seq.df.select(*seq.it, value.alias("str_val")), seq.it)
    else:
        key = key.withColumn("str_val", F.lit(""))
    number = F.nanvl(core.parse_number(F.col("str_val")), F.lit(0.0))
    agg = {"count": F.count("*").cast("double"), "sum": F.sum(number), "avg": F.avg(number), "min": F.min(number), "max": F.max(number)}[body.name]
    return key.groupBy("key").agg(agg.alias("value"))
