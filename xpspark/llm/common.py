"""Shared plumbing of the training-data operators: shared storage, size-checked broadcast, components."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import shared_path

#: Most bytes of an Arrow batch that goes to a Python worker; a single longer row is a batch of its own.
BATCH_BYTES = 4 << 20
#: Most bytes of a broadcast side.
MAX_BYTES = 32 << 20
#: A value is hot if it has more than a HOT-th of all rows; longer ones than LONG_KEY characters are not broadcast.
HOT, LONG_KEY = 1000, 4096


def bounded_batches(spark: SparkSession) -> None:
    """Let Arrow batches of this session hold BATCH_BYTES at most: by default 10,000 rows of any length make one."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(spark.conf.get(name, None) or -1)
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once for each row."""
    return F.transform(F.array(value), body)[0]


def unused(df: DataFrame, n: int) -> list[str]:
    """Names for ``n`` helper columns that ``df`` does not have, whatever its columns are called."""
    have, found, k = {c.lower() for c in df.columns}, [], 0
    while len(found) < n:
        if f"__{k}" not in have:
            found.append(f"__{k}")
        k += 1
    return found


def materialize(df: DataFrame, name: str, narrow: bool = False) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it again: this cuts the lineage durably.

    ``narrow`` tables (keys and counts) are written by a sixteenth of the session's partitions, 8 at least: fewer files.
    """
    spark = df.sparkSession
    if narrow:
        df = df.coalesce(max(8, int(spark.conf.get("spark.sql.shuffle.partitions")) // 16))
    path = shared_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete the files of a materialized table that no later plan reads."""
    spark, path = df.sparkSession, df._shared_path
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def small_side(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``max_rows`` rows and ``MAX_BYTES`` of text, else as it is (shuffle join).

    ``df`` should be materialized or cheap: it is counted, up to one row past the bound. Its columns must be numbers or text.
    """
    size = F.lit(0).cast("long")
    for name, kind in df.dtypes:
        size = size + (F.coalesce(F.octet_length(name), F.lit(0)) if kind in ("string", "binary") else F.lit(8))
    rows, held = df.limit(max_rows + 1).agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(df) if rows <= max_rows and held <= MAX_BYTES else df


def join_hot(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` joined with ``keys``, which has a row for each value of ``on`` and ``n``, the number of rows with it.

    Both should be materialized. Values with more than a HOT-th of all rows are HOT at most, and of at most LONG_KEY
    characters each: they are broadcast, so their rows stay where they are and no task gets all rows of one value.
    """
    total = rows.count()
    short = F.lit(True)
    for c in on:
        if dict(keys.dtypes)[c] == "string":
            short = short & (F.length(c) <= LONG_KEY)
    often = (F.col("n") * HOT > total) & short
    hot, cold = keys.where(often), keys.where(~often)
    marked = rows.join(F.broadcast(hot.select(*on, F.lit(True).alias("__hot"))), on, "left")
    apart = marked.where("__hot").drop("__hot").join(F.broadcast(hot), on)
    return apart.unionByName(marked.where("__hot IS NULL").drop("__hot").join(cold, on)).drop("n")


def connected_components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """Connected components by alternating large-star and small-star steps.

    ``edges`` has long columns ``u`` and ``v``; rows with a null or with ``u = v`` join nothing. Returns
    ``node, component`` for every node on an edge, component being its smallest reachable node. Each round is
    two joins on a node with a partially aggregated minimum, so a hub's rows are never gathered in one group
    and skewed join partitions can be split; rounds are written to the shared folder.
    """
    pairs = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, before = materialize(pairs, name, narrow=True), None
    while True:
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if mark == before or mark[0] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        before = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        step = small.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        new = materialize(step, name, narrow=True)
        release(now)
        now = new
