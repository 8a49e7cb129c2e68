"""Node lane against an independent evaluation over plain Python trees."""

import random

import pytest

from xpspark.engine import Engine
from xpspark.sources import shred

XML = """<root xml:lang="en" xmlns:p="http://p"><!--c--><a id="1"><b>x</b><b id="7">y<c/></b></a><a id="2"><b>z</b>t<?go now?></a><p:d p:k="v">5</p:d><a><e><b>q</b></e></a></root>"""


@pytest.fixture(scope="module")
def doc(spark):
    docs = [(1, XML), (2, "<r><a id='9'><b>10</b></a></r>"), (3, "<broken>"), (4, None)]
    return shred.shred(spark.createDataFrame(docs, "i long, t string"), "xml", "i", "t").cache()


def names(engine, doc, query, **kw):
    rows = engine.nodes(doc, query, **kw).where("doc_id = 1").orderBy("pre").collect()
    return [r.str_val if r.kind in (2, 3, 8) else f"{r.name}={r.str_val}" for r in rows]


CASES = [
    ("/root/a/@id", ["1", "2"]), ("//b", ["b=x", "b=y", "b=z", "b=q"]), ("//a[@id='2']/b", ["b=z"]), ("//a[b='y']/@id", ["1"]), ("//a[not(@id)]//b", ["b=q"]), ("//b[1]", ["b=x", "b=z", "b=q"]), ("//b[last()]", ["b=y", "b=z", "b=q"]), ("(//b)[2]", ["b=y"]), ("//a/b[2]/@id", ["7"]),
    ("//c/ancestor::*", ["root=xyzt5q", "a=xy", "b=y"]), ("//c/ancestor::*[1]", ["b=y"]), ("//c/..", ["b=y"]), ("//a[1]/following-sibling::a", ["a=zt", "a=q"]), ("//a[3]/preceding-sibling::*", ["a=xy", "a=zt", "p:d=5"]), ("//c/following::b", ["b=z", "b=q"]), ("//e/preceding::b", ["b=x", "b=y", "b=z"]),
    ("//comment()", ["c"]), ("//a[2]/text()", ["t"]), ("//processing-instruction('go')", ["go=now"]), ("//p:d/@p:k", ["v"]), ("//*[@p:k]", ["p:d=5"]), ("//a[2]/node()", ["b=z", "t", "go=now"]), ("/root/*[self::a]/@id", ["1", "2"]), ("//element(b)", ["b=x", "b=y", "b=z", "b=q"]),
    ("//a[count(b) = 2]/@id", ["1"]), ("//a[count(b) > 0]/@id", ["1", "2"]), ("//a[string-length(string(b)) = 1]/@id", ["1", "2"]), ("//a[position() > 1]/@id", ["2"]), ("//a[position() = last()]", ["a=q"]), ("//*[. > 4]", ["p:d=5"]), ("//b[. = 'x' or @id = 7]", ["b=x", "b=y"]), ("//*[name() = 'e']", ["e=q"]), ("//*[local-name() = 'd']", ["p:d=5"]), ("//*[namespace-uri() = 'http://p']", ["p:d=5"]),
    ("//a[some $x in b satisfies $x = 'z']/@id", ["2"]), ("//a[every $x in b satisfies $x/@id]", ["a=q"]), ("//a[@id = //b/@id] | //c", ["c="]), ("//b union //c", ["b=x", "b=y", "c=", "b=z", "b=q"]), ("//b intersect //a/b", ["b=x", "b=y", "b=z"]), ("//b except //a/b", ["b=q"]), ("//b[lang('en')][1]", ["b=x", "b=z", "b=q"]), ("//a[b/@id]/b[1]", ["b=x"]), ("//a[b][2]/@id", ["2"]), ("innermost(//a | //b)", ["b=x", "b=y", "b=z", "b=q"]), ("outermost(//a | //b)", ["a=xy", "a=zt", "a=q"]), ("//b[has-children()]", ["b=x", "b=y", "b=z", "b=q"]), ("//b/descendant-or-self::*", ["b=x", "b=y", "c=", "b=z", "b=q"]), ("//*[. instance of element(b)]", ["b=x", "b=y", "b=z", "b=q"]), ("//a/node()[. instance of text()]", ["t"]), ("//*[b[2] is b[@id]]/@id", ["1"]), ("//a[b[1] << b[2]]/@id", ["1"]), ("//p:d[resolve-QName('p:x', .) = '{http://p}p:x']", ["p:d=5"]),
]


@pytest.mark.parametrize(("query", "want"), [c for c in CASES if c[1] is not None])
def test_paths(spark, doc, query, want):
    assert names(Engine(spark), doc, query, namespaces={"p": "http://p"}) == want


def test_order_modes(spark, doc):
    e = Engine(spark)
    assert names(e, doc, "//a[3]/preceding-sibling::*[1]") == ["a=xy"]
    assert names(e, doc, "//a[3]/preceding-sibling::*[1]", order_mode="spec") == ["p:d=5"]


def test_table_of_values(spark, doc):
    got = Engine(spark).table(doc, "//a", {"id": "string(@id)", "n": "count(b)", "first": "upper-case(string(b))", "all": "string-join(.//b, '+')", "p": "path()", "big": "if (count(b) > 1) then 'many' else 'few'"})
    rows = [tuple(r)[2:] for r in got.where("doc_id = 1").orderBy("pre").collect()]
    assert rows == [("1", 2.0, "X", "x+y", "/root/a[1]", "many"), ("2", 1.0, "Z", "z", "/root/a[2]", "few"), ("", 0.0, "", "q", "/root/a[3]", "few")]


def test_flwor(spark, doc):
    e = Engine(spark)
    assert [r.value for r in e.flwor(doc, "for $x in //a return count($x/b)").where("doc_id = 1").orderBy("pre").collect()] == [2.0, 1.0, 0.0]
    got = {r.key: r.value for r in e.flwor(doc, "for $k in distinct-values(//a/@id) return count(//a[@id = $k])").collect()}
    assert got == {"1": 1.0, "2": 1.0, "9": 1.0}


def test_encoding(spark, doc):
    rows = doc.collect()
    for d in {r.doc_id for r in rows}:
        mine = {r.pre: r for r in rows if r.doc_id == d}
        for r in mine.values():
            assert r.pre <= r.fin and len(r.anc) == r.level
            if r.parent is not None:
                assert mine[r.parent].pre < r.pre and r.fin <= mine[r.parent].fin and r.anc[-1] == r.parent


def test_html_and_json(spark):
    page = "<html><body><ul><li>one<li>two</ul><p>a<p>b<br>c</body><a href='u'>k</a>"
    d = shred.shred(spark.createDataFrame([(1, page)], "i long, t string"), "html", "i", "t")
    e = Engine(spark)
    assert [r.str_val for r in e.nodes(d, "//li").orderBy("pre").collect()] == ["one", "two"]
    assert [r.str_val for r in e.nodes(d, "//a/@href").collect()] == ["u"]
    j = shred.shred(spark.createDataFrame([(1, '{"a b": [1, {"x": "y"}], "t": true}'), (2, "{")], "i long, t string"), "json", "i", "t")
    assert [r.str_val for r in e.nodes(j, "/root/a_b/item").orderBy("pre").collect()] == ["1", "y"]


def test_stored_nodes(spark, doc, tmp_path):
    from xpspark.sources import store

    store.save(doc, str(tmp_path / "n"))
    back = store.load(spark, str(tmp_path / "n"))
    assert names(Engine(spark), back, "//a[@id='2']/b") == ["b=z"] and back.count() == doc.count()
    one = store.load(spark, str(tmp_path / "n"), 1, "b")
    assert one.count() == doc.where("kind = 1 AND local = 'b'").count()
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "(part_local#" in plan.split("PartitionFilters: [")[1].split("]")[0]


def reference(tree, axis, pre):
    """Document-order nodes of an axis, from parent links alone."""
    up = lambda k: [] if tree[k] is None else [tree[k], *up(tree[k])]
    below = lambda k: [n for n in tree if k in up(n)]
    kids = lambda k: [n for n in tree if tree[n] == k]
    after = [n for n in tree if n > pre and pre not in up(n)]
    before = [n for n in tree if n < pre and n not in up(pre)]
    return {"child": kids(pre), "descendant": below(pre), "ancestor": up(pre), "following": after, "preceding": before, "following-sibling": [n for n in kids(tree[pre]) if n > pre] if tree[pre] is not None else [], "preceding-sibling": [n for n in kids(tree[pre]) if n < pre] if tree[pre] is not None else []}[axis]


def test_axes_on_random_trees(spark):
    rng, docs, trees = random.Random(2), [], {}
    for d in range(4):
        tree, text, open_ = {0: None}, "<n i='0'>", [0]
        for k in range(1, 25):
            while len(open_) > 1 and rng.random() < 0.4:
                text += "</n>"
                open_.pop()
            tree[k] = open_[-1]
            text += f"<n i='{k}'>"
            open_.append(k)
        docs.append((d, text + "</n>" * len(open_)))
        trees[d] = tree
    nodes = shred.shred(spark.createDataFrame(docs, "i long, t string"), "xml", "i", "t").cache()
    for axis in ("child", "descendant", "ancestor", "following", "preceding", "following-sibling", "preceding-sibling"):
        got = Engine(spark).table(nodes, "//n", {"i": "number(@i)", "to": f"{axis}::n/@i"}).collect()
        assert len(got) == 100
        for r in got:
            assert sorted(map(int, r.to)) == sorted(reference(trees[r.doc_id], axis, int(r.i))), axis


R = '<r><a id="1"><b/><b/></a><a id="2"><b/></a><c/><a id="3"/><g><h/><a id="4"><b>x</b></a></g></r>'
ITEMS = [
    ("/r/a[$n]/@id", ["2"]), ("/r/a[count(b)]/@id", []), ("/r/a[string-length(@id)]/@id", ["1"]), ("/r/a[number(@id)]/@id", ["1", "2", "3"]), ("/r/a[if (b) then 1 else 2]/@id", ["1"]), ("//a[$n]/@id", ["2"]), ("/r/a[position() = last()]/@id", ["3"]), ("/r/a[@id and 2]/@id", ["1", "2", "3"]),
    ("name((//c, //a)[1])", ["c"]), ("reverse(//a)[1]/@id", ["4"]), ("head(reverse(//a))/@id", ["4"]), ("(//a, //a)/@id", ["1", "2", "3", "4"]), ("count((//a, //a))", ["8"]), ("reverse((//c, //a))/name()", ["a", "a", "a", "a", "c"]), ("name((//c/ancestor::*)[1])", ["r"]), ("name((//h/ancestor::*)[1])", ["g"]), ("sort(//a, (), function($x) { -number($x/@id) })/@id", ["4", "3", "2", "1"]), ("insert-before(//c, 1, //g)/name()", ["g", "c"]), ("remove(//a, 2)/@id", ["1", "3", "4"]), ("tail(//a)/@id", ["2", "3", "4"]), ("subsequence(//a, 2, 2)/@id", ["2", "3"]),
    ("name(//g/preceding::*[1])", ["b"]), ("//g/preceding-sibling::a[1]/@id", ["1"]), ("//g/preceding-sibling::a[last()]/@id", ["3"]), ("//c/following-sibling::a[1]/@id", ["3"]), ("name(//c/following::*[2])", ["g"]), ("//a[1]/following-sibling::a[1]/@id", ["2"]), ("//a[following-sibling::c]/@id", ["1", "2"]), ("//a[not(following::a)]/@id", ["4"]), ("//a[preceding-sibling::a][1]/@id", ["2"]),
    ("if (//c) then //a/@id else //b", ["1", "2", "3", "4"]), ("if (//z) then //a else //g/a/@id", ["4"]), ("let $x := //a return $x[b]/@id", ["1", "2", "4"]), ("let $n := count(//a) return $n + 1", ["5"]), ("for $x in //a return count($x/b)", ["2", "1", "0", "1"]), ("for $x in //a return $x/b/..", ["", "", "x"]), ("for $x in //a[b], $y in $x/b return concat($x/@id, $y)", ["1", "1", "2", "4x"]), ("for $x in (1, 2), $a in //a[@id = $x] return $a/@id", ["1", "2"]), ("//a ! @id", ["1", "2", "3", "4"]), ("//a ! position()", ["1", "2", "3", "4"]), ("(1, 2) ! count(//a)", ["4", "4"]), ("//a/string(@id)", ["1", "2", "3", "4"]), ("//a/(b | @id)", ["1", "", "", "2", "", "3", "4", "x"]), ("distinct-values(//*/name())", ["r", "a", "c", "g", "b", "h"]),
    ("for $a in //a, $b in //a[@id > $a/@id] return concat($a/@id, $b/@id)", ["12", "13", "14", "23", "24", "34"]), ("for $a in //a, $b in //b return if ($b/../@id = $a/@id) then concat($a/@id, name($b)) else ()", ["1b", "1b", "2b", "4b"]), ("for $k in distinct-values(//a/@id) return count(//a[@id = $k]/b)", ["2", "1", "0", "1"]), ("some $x in //a, $y in //h satisfies $y << $x", ["true"]), ("every $x in //a satisfies $x/b", ["false"]), ("//a[some $x in b satisfies $x = 'x']/@id", ["4"]),
    ("count(//namespace::*)", ["12"]), ("//c/namespace::xml", ["http://www.w3.org/XML/1998/namespace"]), ("//a[@id = true()]/@id", ["1", "2", "3", "4"]), ("//a[@id > 2]/@id", ["3", "4"]), ("sum(//a/@id)", ["10"]), ("max(//a/@id)", ["4"]), ("string-join(//a/@id, '-')", ["1-2-3-4"]), ("//b/root()/name()", ["#document"]), ("path(//c)", ["/r/c"]), ("//a[last()]/@id", ["3", "4"]), ("//a[b][last()]/@id", ["2", "4"]), ("count(//a[1]/following::*)", ["8"]), ("exactly-one(//c)/name()", ["c"]), ("//document-node(element(r))/name()", []), ("/self::document-node(element(r))/name()", ["#document"]), ("/self::document-node(element(q))", []), ("string(100000000000000000000)", ["100000000000000000000"]),
]


def shown(df):
    return [r.str_val for r in df.orderBy("seq" if "seq" in df.columns else "pre").collect()]


@pytest.fixture(scope="module")
def tree(spark):
    return shred.shred(spark.createDataFrame([(1, R)], "i long, t string"), "xml", "i", "t").cache()


@pytest.mark.parametrize(("query", "want"), ITEMS)
def test_items(spark, tree, query, want):
    assert shown(Engine(spark).nodes(tree, query, {"n": 2} if "$n]" in query else None)) == want


def test_wrong_steps_have_codes(spark, tree):
    from xpspark.errors import QueryError

    for query, code in (("(1, 2)/a", "XPTY0019"), ("//a/string(@id)/b", "XPTY0019"), ("doc('x')", "FODC0005"), ("key('k', 1)", "XPST0001"), ("[abs#1]", "XPTY0004")):
        with pytest.raises(QueryError) as e:
            Engine(spark).nodes(tree, query)
        assert e.value.code == code, query


def test_attributes_and_paths_need_no_join(spark):
    docs = spark.createDataFrame([(1, "<html><body><ul><li class='x'><a href='u'>k</a></li></ul><a href='v' id='w'>l</a></body></html>")], "i long, t string")
    nodes = shred.shred(docs, "html", "i", "t")
    e = Engine(spark)
    for query, want in (("//a[@href]/@href", ["u", "v"]), ("/html/body/a/@id", ["w"]), ("//li//a", ["k"]), ("//a[@id = 'w']", ["l"]), ("//a[not(@id)]/@*", ["u"])):
        df = e.nodes(nodes, query)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert shown(df) == want and plan.count("MapInArrow") == 1 and "Join" not in plan, query


def test_values_meet_within_a_document(spark):
    docs = spark.createDataFrame([(1, "<r><a k='1'/></r>"), (2, "<r><a k='2'/><b k='1'/><b k='2'/></r>")], "i long, t string")
    nodes = shred.shred(docs, "xml", "i", "t").cache()
    e = Engine(spark)
    assert [(r.doc_id, r.str_val) for r in e.nodes(nodes, "//a[@k = //b/@k]/@k").collect()] == [(2, "2")]
    assert [(r.it, r.str_val) for r in e.nodes(nodes, "count(//a[@k = //b/@k])").orderBy("it").collect()] == [(1, "0"), (2, "1")]
    assert shown(e.nodes(nodes, "for $b in //b return //a[@k = $b/@k]/@k", scope="all")) == ["1", "2"]


def test_nested_contexts(spark):
    docs = spark.createDataFrame([(1, "<a i='1'><a i='2'><b/><a i='3'><b/></a></a><b/></a>")], "i long, t string")
    nodes = shred.shred(docs, "xml", "i", "t").cache()
    e = Engine(spark)
    assert e.nodes(nodes, "//a//b").count() == 3 == e.nodes(nodes, "//a/descendant::b").count()
    assert shown(e.nodes(nodes, "//a//a/@i")) == ["2", "3"]
    assert [r.n for r in e.table(nodes, "//a", {"n": "count(.//b)"}).orderBy("pre").collect()] == [3.0, 2.0, 1.0]


def test_running_sums(spark):
    from xpspark.operators.running import before

    rng = random.Random(3)
    rows = [(g, rng.randrange(1 << 50), t, rng.randint(0, 3)) for g in range(3) for t in range(200)]
    df = spark.createDataFrame(rows, "g int, at long, tie int, w long")
    for r in before(df, ["g"], "at", "tie", "w", "n", "total").collect():
        assert r.n == sum(w for g, a, t, w in rows if g == r.g and (a, t) <= (r.at, r.tie)) and r.total == sum(w for g, *_, w in rows if g == r.g)


def test_ordered_join_of_variables_stays_narrow(spark):
    """Pairs that compare by order are neither grouped nor joined again for their attributes."""
    def rows(i, values):
        return "<r>" + "".join(f'<c k="{i}{j}" v="{v}"/>' for j, v in enumerate(values)) + "</r>"

    values = [["3", "10", "9", "x", "10.0", "-1"], ["2"], []]
    df = spark.createDataFrame([(i, rows(i, v)) for i, v in enumerate(values)], "doc_id long, text string")
    nodes = shred.shred(df, "html", "doc_id", "text")
    for op, holds in ((">", lambda a, b: b > a), (">=", lambda a, b: b >= a), ("<", lambda a, b: b < a), ("<=", lambda a, b: b <= a)):
        found = Engine(spark).nodes(nodes, f"for $a in //c[@v > 2], $b in //c[@v {op} $a/@v] return concat($a/@k, '{op}', $b/@k, $b/@none)")
        want = sorted(f"{i}{j}{op}{i}{k}" for i, v in enumerate(values) for j, a in enumerate(v) for k, b in enumerate(v) if "x" not in (a, b) and float(a) > 2 and holds(float(a), float(b)))
        assert sorted(r.str_val for r in found.collect()) == want
        assert "collect_list" not in found.select("doc_id", "str_val")._jdf.queryExecution().optimizedPlan().toString()
