"""Every registered query against its DuckDB SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from xpspark import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    plain = lambda v: round(v, 6) if isinstance(v, float) and math.isfinite(v) else v
    return sorted(str([plain(r[k]) for k in order]) for r in found), sorted(columns)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_equals_sql(spark, duck, name):
    df = queries.queries()[name](spark, SF)
    want = duck.execute(queries.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, want.fetchall())


def test_whole_texts(spark, tmp_path):
    text = "ABC the " * 100
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    r = queries.queries()["strings_whole"](spark, str(tmp_path)).first()
    assert (r["lower"], r["swapped"]) == (text.lower(), text.replace("e", "E"))
    r = queries.queries()["regex_whole"](spark, str(tmp_path)).first()
    assert (r["masked"], r["groups"]) == (text.replace("e", "*"), text.replace("th", "ht"))
