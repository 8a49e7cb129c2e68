import pytest
from pyspark.sql import functions as F

from xpspark import schema
from xpspark.engine import Engine
from xpspark.errors import DynamicError, StaticError, describe, is_static
from xpspark.functions import compat, core, indexed
from xpspark.plans import analyze
from xpspark.sources import shred
from xpspark.sources.catalog import Catalog


@pytest.mark.parametrize(("query", "codes"), [("$a + nope(1)", ["XPST0008", "XPST0008"]), ("abs(1, 2)", ["XPST0017"]), ("1 idiv 0", ["FOAR0001"]), ("'x' cast as xs:integer", ["FORG0001"]), ("1 cast as xs:nope", ["XPST0051"]), ("let $a := 1 return $a", []), ("1 +", ["XPST0003"]), ("function($x) {$x}(1)", [])])
def test_checks(query, codes):
    assert sorted(f.code for f in analyze.check(query)) == sorted(codes)


@pytest.mark.parametrize(("query", "want"), [("1", "xs:integer"), ("1 + 1.5", "xs:decimal"), ("1 div 2", "xs:decimal"), ("'a' || 'b'", "xs:string"), ("(1, 2)", "xs:integer+"), ("()", "empty-sequence()"), ("if (true()) then 1 else ()", "xs:integer?"), ("1 to 3", "xs:integer*"), ("for $x in (1, 2) return 'a'", "xs:string+"), ("//a/@b", "attribute()*"), ("map{'a':1}", "map(*)"), ("count(//a)", "xs:integer"), ("1 = 2", "xs:boolean"), ("'1' cast as xs:date?", "xs:date?")])
def test_static_types(query, want):
    assert str(analyze.infer(query)) == want


def test_complexity_hints_warnings():
    assert analyze.complexity("1").level == "simple"
    assert analyze.complexity("//a[b[c = 1]][position() > 2]/d[count(e) = last()]").level in ("complex", "very complex")
    assert any("nested" in h.message for h in analyze.hints("//a[b[c]]"))
    assert any("ms" in h.message for h in analyze.hints("1", seconds=0.5))
    assert analyze.Warnings(least="warning").inspect("//a") == []


@pytest.mark.parametrize(("query", "codes"), [
    ("namespace::x", ["XPWD0001"]), ("contains(a, 'x')", ["XPWD0002"]), ("'a' lt 'b'", ["XPWC0002"]), ("number(())", ["XPWC0003"]), ("'1' + 2", ["XPWT0001"]), ("'1' = 2", ["XPWT0001"]), ("a['x']", ["XPWT0002"]), ("1 + 1.5", ["XPWT0003"]), ("() + 1", ["XPWB0001"]),
    ("() eq 1", ["XPWB0002"]), ("(1, 2) eq 1", ["XPWB0003"]), ("string(a)", ["XPWB0004"]), ("//a", ["XPWP0001"]), ("a = 1", ["XPWP0002"]), ("1 + 2", []),
])
def test_warnings(query, codes):
    assert [c for c, _ in analyze.Warnings().inspect(query)] == codes
    assert [c for c, _ in analyze.Warnings().inspect(query, compat=True)] == ["XPWC0001", *codes]


def test_warning_filters():
    assert len(analyze.WARNINGS) == 14
    seen = []
    w = analyze.Warnings(categories=("performance",), once=False, most=3, handler=lambda c, m: seen.append(c))
    w.inspect("//a[b = 1][//c = 2]/string(d)")
    assert [c for c, _ in w.found] == seen and len(seen) == 3 and set(seen) <= {"XPWP0001", "XPWP0002"}


def test_profiler():
    p = analyze.Profiler()
    assert p.run("q", lambda: [1, 2]) == [1, 2] and p.summary()["q"]["rows"] == 2 and p.hot_spots() == ["q"]


def test_extensions(spark):
    df = spark.createDataFrame([("abc",)], "s string")
    e = Engine(spark)
    analyze.Extensions((analyze.Function("my:twice", lambda c, a: core.string(F.concat(core.str0(a[0]), core.str0(a[0])))),)).install(e)
    e.register_columns("my:rev", F.reverse)
    assert df.select(e.column("my:twice(my:rev($s))", df)).first()[0] == "cbacba"
    with pytest.raises(StaticError):
        analyze.Extensions((analyze.Function("a", abs), analyze.Function("a", abs, 2, 1))).install(e)
    with pytest.raises(StaticError):
        e.register("my:twice", abs)


def test_errors():
    assert is_static("XPST0003") and "zero" in describe("FOAR0001") and StaticError("XPST0003").qname == "err:XPST0003"


XSD = """<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema">
<xs:simpleType name="small"><xs:restriction base="xs:integer"><xs:minInclusive value="1"/><xs:maxInclusive value="9"/></xs:restriction></xs:simpleType>
<xs:element name="r"><xs:complexType><xs:sequence><xs:element name="n" type="small"/><xs:element name="d" type="xs:date" nillable="true"/></xs:sequence></xs:complexType></xs:element>
<xs:element name="c"><xs:simpleType><xs:restriction base="xs:string"><xs:enumeration value="x"/><xs:enumeration value="y"/><xs:maxLength value="1"/></xs:restriction></xs:simpleType></xs:element>
<xs:attribute name="k" type="xs:boolean"/></xs:schema>"""


def test_schema(spark):
    xml = "<r k='true'><n>5</n><n>12</n><n>x</n><d>2024-01-01</d><d nil='true'/><d>no</d><c>x</c></r>"
    nodes = shred.shred(spark.createDataFrame([(1, xml)], "i long, t string"), "xml", "i", "t")
    got = schema.validate(nodes, schema.from_xsd(XSD)).orderBy("pre").collect()
    by = [(r.name, r.str_val, r.is_valid, r.is_nilled) for r in got if r.name in ("n", "d", "c", "k")]
    assert by == [("k", "true", True, False), ("n", "5", True, False), ("n", "12", False, False), ("n", "x", False, False), ("d", "2024-01-01", True, False), ("d", "", True, True), ("d", "no", False, False), ("c", "x", True, False)]
    assert next(r for r in got if r.name == "r").errors == ["unexpected child"]
    with pytest.raises(StaticError):
        schema.from_xsd("<")


def test_catalog(spark):
    docs = spark.createDataFrame([(1, "a.xml", "c"), (2, "b.xml", "c"), (3, "z.xml", "d")], "doc_id long, uri string, collection string")
    nodes = shred.shred(spark.createDataFrame([(i, f"<r>{i}</r>") for i in (1, 2, 3)], "i long, t string"), "xml", "i", "t")
    c = Catalog(docs, nodes)
    e = Engine(spark)
    assert [r.str_val for r in e.nodes(c.doc("b.xml"), "/r").collect()] == ["2"]
    assert sorted(r.str_val for r in e.nodes(c.collection("c"), "/r").collect()) == ["1", "2"]
    assert c.collection().where("level = 0").count() == 3
    got = c.doc_available(spark.createDataFrame([("a.xml",), ("q",)], "uri string")).collect()
    assert {(r.uri, r.available) for r in got} == {("a.xml", True), ("q", False)}
    with pytest.raises(DynamicError):
        c.doc("")


def test_lookups_and_compat(spark):
    t = spark.createDataFrame([(k, k % 3, float(k)) for k in range(30)], "a int, b int, v double")
    assert indexed.by_key(t, spark.createDataFrame([(4, 1), (5, 1)], "a int, b int"), "a", "b").count() == 1
    assert indexed.by_range(t, "v", 3, 7).count() == 5
    row = t.limit(1).select(
        compat.compare("=", core.boolean(True), core.string("x")).alias("a"), compat.to_boolean(core.Val(F.array(F.lit("")), core.STR.seq)).alias("b"), compat.to_number(core.string("")).alias("c"), compat.compare("<", core.string("2"), core.string("10")).alias("d")
    ).first()
    assert row.a and row.b and row.c != row.c and row.d
