import pytest
from pyspark.sql import functions as F

from xpspark.errors import DynamicError
from xpspark.sources import serialize, shred
from xpspark.streaming import runtime
from xpspark.streaming.analyzer import analyze

XML = '<r xmlns:p="http://p" a="1 &lt; 2"><b>x &amp; y</b><c/><p:d>5</p:d><!--n--><?go now?></r>'


@pytest.mark.parametrize(("query", "posture", "streamable"), [("a/b", "grounded", True), ("//a", "roaming", False), ("a[b]/c", "grounded", True), ("..", "consuming", True), ("following::a", "roaming", False), ("sum(a)", "consuming", True), ("sort(a)", "roaming", False), ("1 + 2", "motionless", True), ("count(a/b)", "grounded", True)])
def test_analysis(query, posture, streamable):
    found = analyze(query)
    assert (found.posture, found.streamable) == (posture, streamable)


def test_stream_of_documents(spark, tmp_path):
    docs = [(i, f"<r><a>{i}</a><a>{i + 1}</a></r>") for i in range(20)]
    spark.createDataFrame(docs, "i long, t string").repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("i long, t string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stats = runtime.Stats()
    got = runtime.select_stream(spark, stream, "xml", "i", "t", "//a[. = 7]", stats=stats).collect()
    assert sorted(r.doc_id for r in got) == [6, 7] and stats.processed == 20 and len(stats.batches) >= 4
    with pytest.raises(DynamicError):
        runtime.select_stream(spark, stream, "xml", "i", "t", "//a", runtime.Config(strict=True))


def test_windows(spark, tmp_path):
    rows = [(k, f"2024-01-01 00:{k % 50:02d}:00", "ab"[k % 2]) for k in range(200)]
    df = spark.createDataFrame(rows, "i long, s string, k string").select("i", F.to_timestamp("s").alias("ts"), "k")
    df.write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "ev"))
    got = {(str(r.start), r.k): r.n for r in runtime.tumbling_counts(spark, stream, "ts", "k", "10 minutes").collect()}
    want = {(str(r.start), r.k): r.n for r in df.groupBy(F.window("ts", "10 minutes").start.alias("start"), "k").agg(F.count("*").alias("n")).collect()}
    assert got == want


def test_accumulators(spark):
    nodes = shred.shred(spark.createDataFrame([(1, "<r><n>1</n><n>2</n><n>4</n></r>")], "i long, t string"), "xml", "i", "t")
    got = runtime.accumulate(nodes, [runtime.Accumulator("s", F.col("name") == "n", F.col("str_val").cast("double"))]).where("name = 'n'").orderBy("pre").collect()
    assert [(r.s_before, r.s_after) for r in got] == [(0, 1), (1, 3), (3, 7)]


def test_buffer():
    b = runtime.Buffer(3)
    for k in range(5):
        b.add(k)
    assert b.last(2) == [3, 4] and 1 not in b and len(b) == 3


def test_serialize(spark):
    nodes = shred.shred(spark.createDataFrame([(1, XML)], "i long, t string"), "xml", "i", "t").cache()
    assert serialize.serialize(nodes).first().text == '<r xmlns:p="http://p" a="1 &lt; 2"><b>x &amp; y</b><c/><p:d>5</p:d><!--n--><?go now?></r>'
    assert serialize.serialize(nodes, "text").first().text == "x & y5"
    assert serialize.serialize(nodes, "json").first().text == '{"@a": "1 < 2", "b": "x & y", "c": null, "p:d": 5}'
    assert serialize.serialize(nodes, "html").first().text.count("<c></c>") == 1
    copies = serialize.copy_of(nodes, nodes.where("name = 'b'"))
    assert sorted((r.level, r.name) for r in copies.collect()) == [(1, "b"), (2, "#text")]


def test_yaml():
    text = "a: 1\nb:\n  - x\n  - y: 2\n    z: 'q'\nc: [1, 2]\n# no\nd:\n  e: true\n"
    value = serialize.parse_yaml(text)
    assert value == {"a": 1, "b": ["x", {"y": 2, "z": "q"}], "c": [1, 2], "d": {"e": True}}
    assert serialize.parse_yaml(serialize.to_yaml({"a": "1", "b": {"c": [1, "x"]}})) == {"a": "1", "b": {"c": [1, "x"]}}


def test_late_events_and_other_windows(spark, tmp_path):
    rows = [(0, "2024-01-01 00:01:00", "a"), (1, "2024-01-01 00:04:00", "a"), (2, "2024-01-01 02:00:00", "a")]
    late = [(3, "2024-01-01 00:02:00", "a"), (4, "2024-01-01 01:58:00", "a")]
    more = [(5, "2024-01-01 02:01:00", "a")]
    for k, part in enumerate((rows, more, late)):
        spark.createDataFrame(part, "i long, s string, k string").select("i", F.to_timestamp("s").alias("ts"), "k").coalesce(1).write.parquet(str(tmp_path / f"ev/p={k}"))
    stream = lambda: spark.readStream.schema("i long, ts timestamp, k string, p int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "ev"))
    got = {str(r.start)[11:16]: r.n for r in runtime.tumbling_counts(spark, stream(), "ts", "k", "10 minutes", late="10 minutes").collect()}
    # the watermark is at 01:50 when the late files come: the window at 00:00 is closed, that at 01:50 is open
    assert got == {"00:00": 2, "02:00": 2, "01:50": 1}
    slid = {str(r.start)[11:16]: r.n for r in runtime.sliding_counts(spark, stream(), "ts", "k", "10 minutes", "5 minutes", late="1 day").collect()}
    assert slid == {"23:55": 3, "00:00": 3, "01:50": 1, "01:55": 3, "02:00": 2}
    assert sorted((str(r.start)[11:16], r.n) for r in runtime.session_counts(spark, stream(), "ts", "k", "5 minutes").collect()) == [("00:01", 3), ("01:58", 3)]


def test_accumulator_stream(spark, tmp_path):
    rows = [(d, p, float(p)) for d in (1, 2) for p in (1, 2, 3)]
    spark.createDataFrame(rows, "doc_id long, pre long, x double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, pre long, x double").parquet(str(tmp_path / "in"))
    got = sorted(tuple(r) for r in runtime.run_accumulator(spark, stream, lambda v, r: v + r["x"]).collect())
    assert got == [(d, p, b, a) for d in (1, 2) for p, b, a in ((1, 0.0, 1.0), (2, 1.0, 3.0), (3, 3.0, 6.0))]


def test_host_accumulators():
    a = runtime.Accumulators()
    a.register({"n": 0.0})
    a.update("n", 5.0, "pre")
    held = a.snapshot()
    a.update("n", 9.0)
    assert (a.before("n"), a.after("n")) == (5.0, 9.0)
    a.restore(held)
    assert (a.before("n"), a.after("n")) == (5.0, 5.0)
    with pytest.raises(DynamicError):
        a.after("m")


def test_analysis_helpers():
    from xpspark.streaming import analyzer

    assert analyzer.is_motionless("1 + 2") and analyzer.is_grounded("a/b") and not analyzer.is_streamable("//a") and analyzer.memory_footprint("a[b]") == 0.4


def test_json_reads_no_attribute_nodes(spark):
    """Documents are a stream of few rows: attributes come with their elements, and no group is a pandas frame."""
    texts = ['<a><b x="1" y="z">7</b><b>t</b></a>', "<a></a>", '<p q="2.50"></p>', "<ul><li>1<li>2</ul>"]
    nodes = shred.shred(spark.createDataFrame(list(enumerate(texts)), "k long, t string"), "html", "k", "t")
    found = serialize.xml_to_json(nodes)
    want = {0: '{"b": [{"@x": 1, "@y": "z", "#text": 7}, "t"]}', 1: "null", 2: '{"@q": 2.5}', 3: '{"li": [1, 2]}'}
    assert {r.doc_id: r.json for r in found.collect()} == want
    assert {r.doc_id: r.json for r in serialize.xml_to_json(nodes.drop("attrs")).collect()} == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan and "MapInArrow" in plan
