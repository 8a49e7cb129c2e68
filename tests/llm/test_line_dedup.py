import random

from xpspark.llm import line_dedup


def brute(rows):
    seen, out = set(), []
    for key, text in sorted(rows):
        lines, gone = text.split("\n"), set()
        for k, pair in enumerate(zip(lines, lines[1:], strict=False)):
            if "".join(pair).strip():
                gone |= {k, k + 1} if pair in seen else set()
                seen.add(pair)
        out.append((key, len(lines), len(gone), "\n".join(x for k, x in enumerate(lines) if k not in gone)))
    return out


def test_equals_brute_force(spark):
    rng = random.Random(6)
    rows = [(i, "\n".join(rng.choices(["", " ", "a", "b", "c", f"own {i}"], k=rng.randint(0, 9)))) for i in range(120)]
    rows += [(500, "a\na\na\na"), (501, "\n".join(map(str, range(5000)))), (502, "\n".join(map(str, range(5000)))), (503, ""), (504, "x" * 50_000 + "\n\n"), (505, "y\n" + "x" * 50_000 + "\n\n")]
    df = spark.createDataFrame([(*r, 1, "k", 2) for r in rows], "doc_id long, text string, __gone int, key string, __gone_id int")
    got = line_dedup.dedup(df, details=True)
    assert got.columns == [*df.columns, "n_lines", "n_removed"]
    got = got.collect()
    assert sorted((r.doc_id, r.n_lines, r.n_removed, r.text) for r in got) == brute(rows) and {r["__gone"] for r in got} == {1}
    lines = lambda texts: {x for t in texts for x in t.split("\n") if x.strip()}
    assert lines(r.text for r in got) == lines(t for _, t in rows)


def test_every_repeated_block_goes(spark):
    rng = random.Random(5)
    blocks = [[f"block {b} {rng.random()}" for _ in range(n)] for b, n in enumerate([2, 2, 2, 3, 3, 4, 5, 9])]
    rows, own = [], {}
    for i in range(160):
        own[i] = [f"own {i} {k}" for k in range(rng.randint(1, 4))]
        rows.append((i, "\n".join([*own[i], *blocks[i % 8], *([f"end {i}"] if i % 3 else [])])))
        own[i] += [f"end {i}"] if i % 3 else []
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in line_dedup.dedup(df, details=True).collect()}
    assert {k: r.text for k, r in got.items()} == {i: t if i < 8 else "\n".join(own[i]) for i, t in rows}
    assert all(r.n_removed == (len(blocks[k % 8]) if k >= 8 else 0) for k, r in got.items())


def test_odd_rows(spark):
    text = "\n".join(f"line {k}" for k in range(40))
    df = spark.createDataFrame([(1, text), (2, text), (2, text), (None, text), (3, None)], "doc_id long, text string")
    got = {(r.doc_id, r.text == text, r.text is None) for r in line_dedup.dedup(df).collect()}
    assert got == {(1, True, False), (2, False, False), (None, True, False), (3, False, True)}
    assert line_dedup.dedup(df.limit(0)).count() == 0
    assert sorted(r.text for r in line_dedup.dedup(spark.createDataFrame([("b", "x\ny"), ("a", "x\ny\nz")], "doc_id string, text string")).collect()) == ["", "x\ny\nz"]


def test_texts_that_share_a_hash(spark, monkeypatch):
    from pyspark.sql import functions as F

    real = F.xxhash64
    # every chunk of text gets one of three hashes
    monkeypatch.setattr(line_dedup.F, "xxhash64", lambda c, *more: F.length(c).cast("long") % 3 if not more else real(c, *more))
    rng = random.Random(7)
    rows = [(i, "\n".join(rng.choices(["a", "bb", "ccc", "dddd", "ee", f"own {i}"], k=rng.randint(0, 7)))) for i in range(60)]
    got = line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), details=True).collect()
    assert sorted((r.doc_id, r.n_lines, r.n_removed, r.text) for r in got) == brute(rows)
