"""Embedding near-dedup: random-hyperplane sign hashing in several tables, exact cosines, distributed components.

Equal vectors of a label form a class, which goes on as one row with its number of copies. In each table the signs against
random hyperplanes, hashed with table, label and length, name a bucket. The number of hyperplanes grows with the logarithm
of the number of classes, so that a bucket meets few strangers at any size, and the number of tables follows from it, so
that a pair at a cosine of 0.98 shares some bucket with a probability of 1 - ``MISS``, the expected recall at the
threshold; above it, recall is higher. Of buckets that hold the same classes the first table's is enough. Buckets are
compared exactly, in double precision, in blocks of at most about ``BLOCK`` x ``BLOCK`` classes; a large bucket is dealt to
blocks by hash. Blocks stream through a task in the order of their keys. A pair that meets in several tables counts in the
first. A block returns a number of links and one forest edge for each class at most, never its pairs, but for blocks of at
most ``SMALL`` classes, which are compared many at a time and give their few links. Components come from these edges.

Results for odd input: vectors that are null, empty, zero or hold null or non-finite components, and vectors without label
or id, link with nothing; vectors of different lengths don't link; vectors of any length are compared whole; rows that
share an id are vectors of their own, equal vectors (ties) link with each other; a row without id has no component and is
kept; an empty table gives no rows; extra columns are ignored, whatever their names. Ids must be whole numbers.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, connected_components, materialize

BLOCK, SEED, MISS, LEAST_BITS = 1024, 7, 4e-6, 10


def shape(classes: int, threshold: float) -> tuple[int, int]:
    """Numbers of tables and hyperplanes for so many classes."""
    bits = max(LEAST_BITS, math.ceil(math.log2(max(2, classes))))
    share = (1 - math.acos(threshold) / math.pi) ** bits
    return math.ceil(math.log(MISS) / math.log(1 - share)), bits


@functools.lru_cache(maxsize=8)
def planes(dim: int, tables: int, bits: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim]).standard_normal((dim, tables * bits))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words in which every bit depends on all."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def buckets(x: np.ndarray, own: np.ndarray, tables: int, bits: int) -> np.ndarray:
    """Bucket hashes, a row per vector, a column per table; ``own`` is a hash of label and length."""
    up = (x @ planes(x.shape[1], tables, bits) > 0).reshape(len(x), tables, bits)
    signs = up @ (np.uint64(1) << np.arange(bits, dtype=np.uint64))
    seeds = mix(own.astype(np.int64).view(np.uint64))[:, None] + np.arange(1, tables + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mix(mix(signs) + seeds).view(np.int64)


def prepared(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """``vec_id, label, dim, d0, d1, vector``; dim and digest are null for vectors that link with nothing."""
    inner = vectors.schema[vector_col].dataType
    kind = "float" if isinstance(inner, T.ArrayType) and isinstance(inner.elementType, T.FloatType) else "double"
    number = np.float32 if kind == "float" else np.float64
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast(f"array<{kind}>").alias("vector"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("vector")
            flat = lists.values.to_numpy(zero_copy_only=False).astype(number) + number(0)  # null components become NaN
            ends = lists.offsets.to_numpy()
            absent = np.asarray(lists.is_null()) | np.asarray(batch.column("vec_id").is_null()) | np.asarray(batch.column("label").is_null())
            dims, d0, d1, kept = [], [], [], []
            for k in range(batch.num_rows):
                x = flat[ends[k] : ends[k + 1]]
                if absent[k] or not np.isfinite(x).all() or not x.any():
                    dims.append(None), d0.append(None), d1.append(None), kept.append(None)
                    continue
                a, b = np.frombuffer(xxhash.xxh3_128_digest(x.tobytes()), dtype=">i8").tolist()
                dims.append(len(x)), d0.append(a), d1.append(b), kept.append(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array(dims, pa.int32()), pa.array(d0, pa.int64()), pa.array(d1, pa.int64()), pa.array(kept, pa.list_(pa.float32() if kind == "float" else pa.float64()))],
                ["vec_id", "label", "dim", "d0", "d1", "vector"],
            )

    return rows.mapInArrow(run, f"vec_id long, label string, dim int, d0 long, d1 long, vector array<{kind}>")


def compare(left: dict, right: dict, same: bool, table: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``u, v, links``: copies that each class links with, met here first (v -1), and a forest of the links."""
    x, y = left["vector"], right["vector"]
    cosine = (x @ y.T) / (np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)[None, :])
    i, j = np.nonzero(np.triu(cosine >= threshold, 1) if same else cosine >= threshold)
    if table:
        a, b = left["hashes"][:, :table], right["hashes"][:, :table]
        fresh = [~(a[i[k : k + 100_000]] == b[j[k : k + 100_000]]).any(axis=1) for k in range(0, len(i), 100_000)]
        fresh = np.concatenate(fresh) if fresh else np.zeros(0, bool)
        i, j = i[fresh], j[fresh]
    at = j if same else j + len(x)
    cids = left["cid"] if same else np.concatenate((left["cid"], right["cid"]))
    copies = left["copies"] if same else np.concatenate((left["copies"], right["copies"]))
    links, root = np.zeros(len(cids), np.int64), np.arange(len(cids))
    np.add.at(links, i, copies[at])
    np.add.at(links, at, copies[i])
    while len(i):
        low = np.minimum(root[i], root[at])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, at, low)
        if (new == root).all():
            break
        root = new
    tied, some = np.flatnonzero(root != np.arange(len(cids))), np.flatnonzero(links)
    return np.concatenate((cids[some], cids[tied])), np.concatenate((np.full(len(some), -1), cids[root[tied]])), np.concatenate((links[some], np.zeros(len(tied), np.int64)))


#: Blocks of at most so many classes are compared many at a time.
SMALL = 8
NUMBERS = ("b", "i", "j", "t", "own", "label", "cid", "copies")


def block_links(rows: dict, at: slice, threshold: float) -> list[tuple]:
    """The links of one block: rows of ``own`` i against those of j; vectors of another label or length don't meet."""
    i, j, table = (int(rows[c][at.start]) for c in ("i", "j", "t"))
    found = []
    for label in np.unique(rows["label"][at]):
        sides = []
        for own in (i, j):
            some = at.start + np.flatnonzero((rows["own"][at] == own) & (rows["label"][at] == label))
            vectors = [rows["flat"][rows["ends"][k] : rows["ends"][k + 1]] for k in some]
            sides.append({"vector": np.stack(vectors).astype(np.float64), "hashes": rows["hashes"][some], "cid": rows["cid"][some], "copies": rows["copies"][some]} if len(some) else None)
        if sides[0] is not None and sides[1] is not None and (i != j or len(sides[0]["cid"]) > 1):
            found.append(compare(*sides, i == j, table, threshold))
    return found


def small_links(rows: dict, starts: np.ndarray, size: int, x: np.ndarray, threshold: float) -> tuple:
    """The links of many blocks of ``size`` classes, which are few enough to give them all as edges."""
    at = starts[:, None] + np.arange(size)
    v = x[at].astype(np.float64)
    norm = np.sqrt(np.einsum("gid,gid->gi", v, v))
    a, b = np.triu_indices(size, 1)
    cosine = np.einsum("gid,gjd->gij", v, v)[:, a, b] / (norm[:, a] * norm[:, b])
    g, k = np.nonzero(cosine >= threshold)
    p, q = at[g, a[k]], at[g, b[k]]
    # pairs that met in an earlier table are known from there
    fresh = (rows["hashes"][p] == rows["hashes"][q]).argmax(axis=1) == rows["t"][starts[g]]
    p, q = p[fresh], q[fresh]
    u, w, copies = rows["cid"][p], rows["cid"][q], rows["copies"]
    return np.concatenate((u, w, w)), np.concatenate((np.full(2 * len(u), -1), u)), np.concatenate((copies[q], copies[p], np.zeros(len(u), np.int64)))


def links_of(rows: dict, threshold: float) -> list[tuple]:
    """The links of whole blocks, which follow each other in ``rows``."""
    n = len(rows["b"])
    if not n:
        return []
    new = np.concatenate(([True], (np.diff(rows["b"]) != 0) | (np.diff(rows["i"]) != 0) | (np.diff(rows["j"]) != 0)))
    starts = np.flatnonzero(new)
    sizes = np.diff(np.concatenate((starts, [n])))
    dims = np.diff(rows["ends"])
    even = (dims == dims[0]).all()
    small = (sizes <= SMALL) & (rows["i"][starts] == rows["j"][starts]) & (np.minimum.reduceat(rows["label"], starts) == np.maximum.reduceat(rows["label"], starts)) & even
    found = []
    if even:
        x = rows["flat"].reshape(n, -1)
        for size in range(2, SMALL + 1):
            some = starts[small & (sizes == size)]
            found += [small_links(rows, some[k : k + 4096], size, x, threshold) for k in range(0, len(some), 4096)]
    for start, size in zip(starts[~small].tolist(), sizes[~small].tolist(), strict=True):
        found += block_links(rows, slice(start, start + size), threshold)
    return found


def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows sorted by block as arrays, whole blocks at a time; a block may lie in several batches."""
    held: dict | None = None
    for batch in batches:
        lists, hashes = batch.column("vector"), batch.column("hashes")
        ends = lists.offsets.to_numpy()
        now = {c: batch.column(c).to_numpy() for c in NUMBERS} | {"flat": lists.values.to_numpy()[ends[0] : ends[-1]], "ends": ends - ends[0], "hashes": hashes.flatten().to_numpy().reshape(batch.num_rows, -1)}
        if held is not None:
            now = {c: np.concatenate((held[c], now[c])) for c in (*NUMBERS, "flat", "hashes")} | {"ends": np.concatenate((held["ends"], held["ends"][-1] + now["ends"][1:]))}
        edges = np.flatnonzero((np.diff(now["b"]) != 0) | (np.diff(now["i"]) != 0) | (np.diff(now["j"]) != 0))
        cut = int(edges[-1]) + 1 if len(edges) else 0
        split = now["ends"][cut]
        if cut:
            yield {c: now[c][:cut] for c in (*NUMBERS, "hashes")} | {"flat": now["flat"][:split], "ends": now["ends"][: cut + 1]}
        held = {c: now[c][cut:].copy() for c in (*NUMBERS, "hashes")} | {"flat": now["flat"][split:].copy(), "ends": now["ends"][cut:] - split}
    if held is not None:
        yield held


def components(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of each row."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    key = ["label", "dim", "d0", "d1"]
    good = prepared(vectors, id_col, vector_col, label_col)
    # vectors are read twice, so that they are shuffled once and written once
    rows = materialize(good.drop("vector"), "embeddings")
    classes = good.where("d0 IS NOT NULL").groupBy(key).agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
    n = rows.where("d0 IS NOT NULL").select(*key).distinct().count()
    tables, bits = shape(n, threshold)
    classes = classes.withColumn("own", F.xxhash64("label", "dim"))
    names = [*key, "rep", "copies", "vector", "own"]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, own, lists = batch.column("dim").to_numpy(), batch.column("own").to_numpy(), batch.column("vector")
            ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            found = np.zeros((batch.num_rows, tables), np.int64)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                for k in range(0, len(at), 4096):
                    some = at[k : k + 4096]
                    found[some] = buckets(np.stack([flat[ends[r] : ends[r + 1]] for r in some]).astype(np.float64), own[some], tables, bits)
            hashes = pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, tables), pa.int32()), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), hashes], [*names, "hashes"])

    vector = dict(classes.dtypes)["vector"]
    signed = classes.select(*names).mapInArrow(sign, f"label string, dim int, d0 long, d1 long, rep long, copies long, vector {vector}, own long, hashes array<long>")
    classes = materialize(signed.withColumn("cid", F.monotonically_increasing_id()), "embeddings")

    slots = classes.select("cid", F.posexplode("hashes").alias("t", "h"))
    twice = slots.groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    met = materialize(slots.join(twice, "h"), "embeddings")
    # of buckets that hold the same classes the first is enough
    shared = met.groupBy("t", "h", "n").agg(F.sum(F.xxhash64("cid").cast("decimal(38,0)")).alias("f0"), F.bit_xor(F.xxhash64("cid", F.lit(1))).alias("f1"))
    shared = shared.groupBy("n", "f0", "f1").agg(F.min(F.struct("t", "h")).alias("first")).select("first.t", "first.h", "n")
    shared = materialize(shared.withColumn("b", F.monotonically_increasing_id()), "embeddings", narrow=True)
    members = met.drop("n").join(shared, ["t", "h"])
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    members = members.withColumns({"own_block": F.pmod(F.xxhash64("cid"), blocks).cast("int"), "other": F.explode(F.sequence(F.lit(0), blocks - 1))})
    members = members.select("b", "t", "cid", F.col("own_block").alias("own"), F.least("own_block", "other").alias("i"), F.greatest("own_block", "other").alias("j"))
    members = members.join(classes.select("cid", "copies", "vector", "hashes", F.col("own").alias("label")), "cid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, size = [], 0
        for rows_ in streamed(batches):
            done += (new := links_of(rows_, threshold))
            size += sum(len(d[0]) for d in new)
            if size > 50_000:
                yield packed(done)
                done, size = [], 0
        yield packed(done)

    def packed(done: list) -> pa.RecordBatch:
        u, v, links = (np.concatenate([d[k] for d in done]).astype(np.int64) if done else np.zeros(0, np.int64) for k in range(3))
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(links)], ["u", "v", "links"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = members.select("b", "i", "j", "t", "own", "label", "cid", "copies", "vector", "hashes").repartition(parts, "b", "i", "j").sortWithinPartitions("b", "i", "j")
    found = materialize(dealt.mapInArrow(run, "u long, v long, links long"), "embeddings")
    links = found.groupBy(F.col("u").alias("cid")).agg(F.sum("links").alias("links"))
    label = connected_components(found.where("v >= 0").select("u", "v"), "embeddings").withColumnRenamed("node", "cid")
    known = classes.select(*key, "cid", "rep", "copies").join(links, "cid", "left").join(label, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    least = known.groupBy("component").agg(F.min("rep").alias("component_id"))
    known = known.join(least, "component").select(*key, "component_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = rows.join(known, key, "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
