"""The column lane: an expression tree becomes one Catalyst Column.

Function items are closed over at compile time and inlined where they are called, so a query with inline functions,
partial application or named references is still a single expression.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import DynamicError, StaticError, TypeMismatch, fail
from ..functions import casts, compat, core
from ..functions.core import EMPTY, JSON, NUM, STR, Ty, Val, boolean, each, items, many, num, one, str0, string, to_num
from ..functions.library import LIBRARY, as_map, callee
from ..functions.library import field as record_field
from ..plans import ast as A

#: Fixed namespaces of the function library, by the prefix that stands for them here.
NAMESPACES = {
    "http://www.w3.org/2005/xpath-functions": "",
    "http://www.w3.org/2005/xpath-functions/math": "math:",
    "http://www.w3.org/2005/xpath-functions/map": "map:",
    "http://www.w3.org/2005/xpath-functions/array": "array:",
    "http://www.w3.org/2001/XMLSchema": "xs:",
}


@dataclass(frozen=True)
class Options:
    """strict: the stricter variants of aggregates; compat: the oldest behaviour of a few functions."""

    version: str = "3.1"
    strict: bool = False
    compat: bool = False
    utf16: bool = False
    base_uri: str = ""
    now: object = None
    #: What system-property() knows, by name.
    properties: tuple = ()
    #: Comparisons of the first version: of first items, numbers before strings.
    first_items: bool = False


@dataclass(frozen=True)
class Compiler:
    variables: dict = field(default_factory=dict)
    focus: Val | None = None
    position: Column | None = None
    last: Column | None = None
    functions: dict = field(default_factory=dict)
    options: Options = field(default_factory=Options)
    #: Compiles paths over nodes, where there are any.
    paths: object = None

    # -- environment

    def bind(self, name: str, v: Val) -> Compiler:
        return replace(self, variables={**self.variables, name: v})

    def at(self, focus: Val, position: Column | None = None, last: Column | None = None) -> Compiler:
        return replace(self, focus=focus, position=position, last=last)

    def variable(self, name: str) -> Val:
        if name not in self.variables:
            raise StaticError("XPST0008", f"${name}")
        return self.variables[name]

    def parts(self, v: Val) -> int:
        return v.literal

    # -- dispatch

    def compile(self, n: A.Node) -> Val:
        if self.paths is not None and not isinstance(n, A.Call) and self.paths.takes(n):
            return self.paths.value(self, n)
        return getattr(self, f"on_{type(n).__name__.lower()}")(n)

    def many_of(self, nodes: list) -> list[Val]:
        return [self.compile(n) for n in nodes]

    def on_num(self, n):
        return num(n.value)

    def on_str(self, n):
        return string(n.value)

    def on_var(self, n):
        if self.paths is not None and (v := self.paths.variable(n.name)) is not None:
            return v
        return self.variable(n.name)

    def on_context(self, n):
        if self.focus is None:
            raise DynamicError("XPDY0002", "no context item")
        return self.focus

    def on_root(self, n):
        return self.on_path(A.Path(n, []))

    def on_path(self, n):
        if self.paths is not None:
            return self.paths.value(self, n)
        # a child step on a record or map is a lookup of its field
        v = self.compile(n.start) if not isinstance(n.start, A.Root) else self.on_context(n.start)
        for step in n.steps:
            if not isinstance(step, A.Step):
                v = each(v, lambda x, s=step: self.at(x).compile(s))
                continue
            if step.axis == "self" and step.test.kind == "node":
                pass
            elif step.axis in ("child", "attribute") and step.test.kind == "name" and v.kind in ("rec", "map", "json"):
                v = each(v, lambda x, s=step: self.member(x, string(s.test.name)))
                if v.kind == "arr":
                    v = Val(v.col, v.ty.of.seq)
            else:
                raise TypeMismatch("XPTY0019", f"step {step.axis} on {v.kind}")
            for p in step.predicates:
                v = self.filtered(many(v), p)
        return v

    # -- operators

    def on_bin(self, n):
        op = n.op
        if op in ("and", "or"):
            a, b = (core.ebv(self.compile(x)) for x in (n.left, n.right))
            return boolean(a & b if op == "and" else a | b)
        if op in ("union", "intersect", "except", "is", "<<", ">>"):
            if self.paths is None:
                raise TypeMismatch("XPTY0004", f"{op} needs nodes")
            return self.paths.set_value(self, n)
        a, b = self.compile(n.left), self.compile(n.right)
        if op in ("=", "!=", "<", "<=", ">", ">="):
            return boolean(compat.compare(op, a, b) if self.options.first_items else core.general(op, a, b))
        if op in core.SYMBOL:
            out = core.compare(op, one(a), one(b), ordered_text=True)
            missing = F.lit(False)
            for v in (a, b):
                missing = missing | (F.size(v.col) != 1 if v.many else v.col.isNull())
            return boolean(F.when(missing, fail("XPTY0004", f"{op} needs single values", "boolean")).otherwise(out))
        if op == "to":
            x, y = (F.floor(to_num(v)).cast("long") for v in (a, b))
            return Val(F.when(x <= y, F.transform(F.sequence(x, y), lambda i: i.cast("double"))).otherwise(F.array().cast("array<double>")), NUM.seq, bounds=(x, y))
        if op == "||":
            return string(F.concat(str0(a), str0(b)))
        return self.arithmetic(op, a, b)

    def arithmetic(self, op, a, b):
        if op in ("+", "-") and one(a).kind in ("date", "ts") and one(b).kind == "dur":
            return casts.shift(one(a), one(b), 1 if op == "+" else -1)
        x, y = to_num(a), to_num(b)
        if op in "+-*":
            return num({"+": x + y, "-": x - y, "*": x * y}[op])
        by_zero = F.when((x == 0) | F.isnan(x), core.nan()).when(x > 0, core.inf()).when(x < 0, -core.inf())
        if op == "div":
            return num(F.when(y == 0, by_zero).otherwise(x / F.when(y != 0, y)))
        guarded = F.when(y != 0, y)
        whole = x / guarded
        cut = F.when(whole < 0, F.ceil(whole)).otherwise(F.floor(whole)).cast("double")
        zero = fail("XPDY0002" if self.options.compat else "FOAR0001", kind="double")
        if op == "idiv":
            return num(F.when(y == 0, zero).otherwise(cut))
        return num(F.when(y == 0, zero).otherwise(x % guarded))

    def on_unary(self, n):
        v = to_num(self.compile(n.operand))
        return num(-v if n.op == "-" else v)

    def on_if(self, n):
        test, a, b = core.ebv(self.compile(n.test)), self.compile(n.then), self.compile(n.other)
        if "fn" in (a.kind, b.kind):
            # the choice moves into the call
            return Val(None, Ty("fn"), lambda args: self.choose(test, a.call(args), b.call(args)), a.arity)
        return self.choose(test, a, b)

    def choose(self, test, a, b):
        ty = core.unify([a, b])
        if a.many or b.many:
            return Val(F.when(test, items(core.fit(a, ty))).otherwise(items(core.fit(b, ty))), ty.seq)
        return Val(F.when(test, core.fit(a, ty).col).otherwise(core.fit(b, ty).col), ty)

    def on_for(self, n):
        (name, source), *rest = n.bindings
        body = A.For(rest, n.body) if rest else n.body
        return each(many(self.compile(source)), lambda x: self.bind(name, x).compile(body))

    def on_let(self, n):
        c = self
        for name, source in n.bindings:
            c = c.bind(name, c.compile(source))
        return c.compile(n.body)

    def on_quant(self, n):
        (name, source), *rest = n.bindings
        v = many(self.compile(source))
        body = A.Quant(n.kind, rest, n.test) if rest else n.test
        test = lambda x: core.ebv(self.bind(name, Val(x, v.ty.item)).compile(body))
        return boolean((F.exists if n.kind == "some" else F.forall)(v.col, test))

    def on_sequence(self, n):
        if not n.items:
            return Val(F.lit(None), EMPTY)
        vals = self.many_of(n.items)
        if any(v.kind == "fn" for v in vals):
            raise TypeMismatch("XPTY0004", "functions can't stand in a sequence of rows")
        if len(vals) == 1:
            return vals[0]
        ty = core.unify(vals)
        if ty.kind == "empty":
            return vals[0]
        col = F.concat(*(items(core.fit(v, ty)) for v in vals if v.kind != "empty"))
        return Val(col, ty.seq, literal=None if any(v.many for v in vals) else len(vals))

    def on_simplemap(self, n):
        left = many(self.compile(n.left))
        if not any(isinstance(x, A.Call) and x.name.removeprefix("fn:") == "last" for x in n.right.walk()):
            sized = lambda body: body(left.col, F.lit(None).cast("int"))
        else:
            # the sequence is computed once, not again for each item's last()
            sized = lambda body: core.let(left.col, lambda xs: body(xs, F.size(xs)))
        out: list[Val] = []

        def run(xs, size):
            def each_(x, i):
                out.append(self.at(Val(x, left.ty.item), i + 1, size).compile(n.right))
                return out[-1].col

            col = F.transform(xs, each_)
            return F.flatten(col) if out[-1].many else F.array_compact(col)

        col = sized(run)
        return Val(col, out[-1].ty if out[-1].many else out[-1].ty.seq)

    def on_filter(self, n):
        v = self.compile(n.base)
        for p in n.predicates:
            v = self.filtered(many(v), p)
        return v

    def filtered(self, v: Val, p: A.Node) -> Val:
        """Items whose position equals a numeric predicate, or for which another one holds."""
        last = isinstance(p, A.Call) and p.name.removeprefix("fn:") == "last" and not p.args
        if isinstance(p, A.Num):
            if p.value != int(p.value) or p.value < 1:
                return Val(F.filter(v.col, lambda x: F.lit(False)), v.ty)
            if v.bounds is not None:
                low, high = v.bounds
                return num(F.when(low + int(p.value) - 1 <= high, (low + int(p.value) - 1).cast("double")))
            return Val(F.get(v.col, F.lit(int(p.value) - 1)), v.ty.item)
        if last and v.bounds is not None:
            return many(num(F.when(v.bounds[0] <= v.bounds[1], v.bounds[1].cast("double"))))
        if last:
            return Val(F.slice(v.col, -1, 1), v.ty)

        def keep(x, i, size):
            t = self.at(Val(x, v.ty.item), i + 1, size).compile(p)
            if t.kind == "json" and not t.many:
                number = F.try_variant_get(t.col, "$", "double")
                return F.when(number.isNotNull() & ~F.schema_of_variant(t.col).isin("STRING", "BOOLEAN"), number == (i + 1)).otherwise(core.ebv(t))
            return F.coalesce(t.col == (i + 1), F.lit(False)) if t.kind == "num" and not t.many else core.ebv(t)

        if any(isinstance(x, A.Call) and x.name.removeprefix("fn:") == "last" for x in p.walk()):
            return Val(core.let(v.col, lambda xs: F.filter(xs, lambda x, i: keep(x, i, F.size(xs)))), v.ty)
        return Val(F.filter(v.col, lambda x, i: keep(x, i, F.lit(None).cast("int"))), v.ty)

    def on_template(self, n):
        return string(F.concat(*(str0(self.compile(p)) for p in n.parts))) if n.parts else string("")

    def on_try(self, n):
        """Errors in a body that can fail per row give the catch's value; ``casts.safe`` knows the forms that can."""
        v = casts.safe(self, n.body)
        if not n.catches:
            return v
        names, handler = n.catches[0]
        c = self.bind("err:code", string("err:FORG0001")).bind("err:description", string("error in try")).bind("err:value", core.empty())
        other = c.compile(handler)
        ty = core.unify([v, other])
        return Val(F.coalesce(core.fit(one(v), ty).col, core.fit(one(other), ty).col), ty)

    # -- maps, arrays, lookup

    def on_mapnew(self, n):
        entries: dict[str, Val] = {}
        pairs = [(self.compile(k), self.compile(v)) for k, v in n.entries]
        if all(k.literal is not None for k, _ in pairs):
            for k, v in pairs:
                key = str(int(k.literal)) if isinstance(k.literal, float) and k.literal == int(k.literal) else str(k.literal)
                entries[key] = v
            if any(v.kind == "fn" for v in entries.values()):
                return Val(None, Ty("fn"), lambda a: entries[a[0].literal], 1)
            cols = [v.col.cast("string") if v.kind == "empty" else v.col for v in entries.values()]
            col = F.struct(*(c.alias(k) for c, k in zip(cols, entries, strict=True))) if entries else F.create_map().cast("map<string,string>")
            if not entries:
                return Val(col, Ty("map", STR))
            return Val(col, Ty("rec", fields=tuple((k, STR if v.kind == "empty" else v.ty) for k, v in entries.items())), literal=[v.literal for v in entries.values()])
        ty = core.unify([v for _, v in pairs])
        entry = [F.struct(str0(k).alias("k"), core.fit(one(v), ty).col.alias("v")) for k, v in pairs]
        # the last of equal keys wins
        all_ = F.array(*entry)
        kept = F.filter(all_, lambda e, i: ~F.exists(F.slice(all_, i + 2, F.size(all_)), lambda l: l["k"] == e["k"]))
        return Val(F.map_from_entries(kept), Ty("map", ty))

    def on_arraynew(self, n):
        vals = self.many_of(n.members)
        if any(v.kind == "fn" for v in vals):
            raise TypeMismatch("XPTY0004", "functions can't stand in an array of rows")
        if not n.square:
            v = vals[0]
            return Val(items(v) if v.kind != "empty" else F.array().cast("array<string>"), Ty("arr", v.ty.item if v.kind != "empty" else STR))
        if not vals:
            return Val(F.array().cast("array<string>"), Ty("arr", STR))
        ty = core.unify([Val(v.col, v.ty.item) for v in vals])
        nested = any(v.many for v in vals)
        cols = [items(core.fit(v, ty)) if nested else core.fit(v, ty).col for v in vals]
        return Val(F.array(*cols), Ty("arr", ty.seq if nested else ty))

    def on_lookup(self, n):
        base = self.compile(n.base) if n.base is not None else self.on_context(n)
        if n.key is None:
            return self.wildcard(base)
        key = self.compile(n.key)
        return each(base, lambda x: self.member(x, key)) if not key.many else each(key, lambda k: self.member(one(base), k))

    def member(self, v: Val, key: Val) -> Val:
        key = one(key)
        if v.kind == "arr":
            at = to_num(key).cast("int")
            ok = (at >= 1) & (at <= F.size(v.col))
            return Val(F.when(v.col.isNull(), F.lit(None)).when(ok, F.get(v.col, at - 1)).otherwise(fail("FOAY0001", kind=v.ty.of.spark())), v.ty.of)
        if v.kind == "json":
            if isinstance(key.literal, float):
                return Val(F.try_variant_get(v.col, f"$[{int(key.literal) - 1}]", "variant"), JSON)
            if key.literal is not None:
                name = str(key.literal).replace("'", "\\'")
                return Val(F.try_variant_get(v.col, f"$['{name}']", "variant"), JSON)
            return Val(F.try_element_at(as_map(v).col, str0(key)), JSON)
        if v.kind == "rec" and key.literal is not None:
            return record_field(v, key.literal)
        if v.kind in ("map", "rec"):
            m = as_map(v)
            return Val(F.try_element_at(m.col, str0(key)), m.ty.of)
        raise TypeMismatch("XPTY0004", f"lookup in {v.kind}")

    def wildcard(self, v: Val) -> Val:
        v = one(v)
        if v.kind == "arr":
            return LIBRARY["array:flatten"][2](self, [v])
        if v.kind == "json":
            values = F.coalesce(F.try_variant_get(v.col, "$", "array<variant>"), F.map_values(F.try_variant_get(v.col, "$", "map<string,variant>")))
            return Val(values, JSON.seq)
        m = as_map(v)
        return Val(F.map_values(m.col), m.ty.of.seq)

    # -- functions

    def resolve(self, name: str, arity: int):
        for uri, prefix in NAMESPACES.items():
            name = name.replace(f"Q{{{uri}}}", prefix)
        if name in self.functions:
            least, most, build = self.functions[name]
            if not least <= arity <= most:
                raise StaticError("XPST0017", f"{name}#{arity}")
            return lambda args: build(self, args)
        name = name.removeprefix("fn:")
        if name.startswith("xs:"):
            if arity != 1:
                raise StaticError("XPST0017", f"{name}#{arity}")
            return lambda args: casts.construct(name[3:], args[0])
        if name not in LIBRARY:
            raise StaticError("XPST0008", f"function {name}")
        least, most, build = LIBRARY[name]
        if not least <= arity <= most:
            raise StaticError("XPST0017", f"{name}#{arity}")
        return lambda args: build(self, args)

    def on_call(self, n):
        if self.paths is not None and (out := self.paths.call(self, n)) is not None:
            return out
        if self.paths is not None and self.paths.takes(n):
            return self.paths.value(self, n)
        if any(isinstance(a, A.Placeholder) for a in n.args):
            return self.partial(self.resolve(n.name, len(n.args)), n.args, n.name)
        if n.name.removeprefix("fn:") == "distinct-values" and len(n.args) == 1 and isinstance(n.args[0], A.Sequence) and len(n.args[0].items) > 1:
            return self.distinct(self.many_of(n.args[0].items))
        return self.resolve(n.name, len(n.args))(self.many_of(n.args))

    def distinct(self, vals: list[Val]) -> Val:
        """Distinct items of expressions of several types: 1 and '1' are two."""
        vals = [v for v in vals if v.kind != "empty"]
        ty = core.unify(vals)
        if len({v.kind for v in vals}) == 1 or ty.kind != "str":
            return Val(F.array_distinct(F.concat(*(items(core.fit(v, ty)) for v in vals))), ty.seq)
        tagged = lambda v: F.transform(items(v), lambda x: F.struct(F.lit(v.kind).alias("k"), core.to_str(Val(x, v.ty.item)).alias("v")))
        typed = F.concat(*map(tagged, vals))
        return Val(F.transform(F.array_distinct(typed), lambda s: s["v"]), ty.seq)

    def partial(self, call, args, name=None):
        fixed = [None if isinstance(a, A.Placeholder) else self.compile(a) for a in args]

        def run(given):
            rest = iter(given)
            return call([next(rest) if f is None else f for f in fixed])

        return Val(None, Ty("fn"), run, sum(f is None for f in fixed), name)

    def on_fnref(self, n):
        return Val(None, Ty("fn"), self.resolve(n.name, n.arity), n.arity, n.name)

    def on_inline(self, n):
        def run(args):
            c = self
            for name, v in zip(n.params, args, strict=True):
                c = c.bind(name, v)
            return c.compile(n.body)

        return Val(None, Ty("fn"), run, len(n.params))

    def on_dyncall(self, n):
        target = self.compile(n.target)
        if target.kind != "fn":
            # maps and arrays are functions of their key
            return self.member(one(target), self.compile(n.args[0]))
        if any(isinstance(a, A.Placeholder) for a in n.args):
            return self.partial(callee(target, len(n.args)), n.args)
        return callee(target, len(n.args))(self.many_of(n.args))

    # -- types

    def on_typeop(self, n):
        if self.paths is not None and (out := self.paths.is_kind(n)) is not None:
            return out
        v = self.compile(n.operand)
        if n.op == "instance of":
            return boolean(casts.instance(v, n.type))
        if n.op == "castable as":
            return boolean(casts.castable(v, n.type))
        if n.op == "cast as":
            return casts.cast(v, n.type)
        return casts.treat(v, n.type)


