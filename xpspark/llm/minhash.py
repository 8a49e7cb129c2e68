"""MinHash near-dedup: one-permutation hashing with optimal densification, banded buckets, star-shaped edges.

Every text becomes the set of its distinct word shingles, as 64-bit hashes. One permutation deals the set into 256
bins and keeps each bin's least value; an empty bin borrows from bins that a hash of (bin, attempt) names until one
holds a value. ``BANDS`` bands of ``ROWS`` bins are the buckets. Texts with equal sets form a class, of which only the
member with the smallest id goes on. In every bucket each class is paired with the smallest only, so that n classes give
n - 1 candidate edges; edges are confirmed on full sets. Connected components follow. What the stars cannot see, two
classes of one bucket in different components, neither its center, is then compared exactly, in blocks of bounded size
that count common shingles for all their pairs at once and return at most one edge per class.

Results for odd input: null, empty or blank text has an empty set, links with nothing and is kept; a text with fewer
words than a shingle has one shingle, all its words; very long texts are read whole; rows that share an id are one
document, linked if any of them is; equal texts (ties) form one class, whose smallest id is kept; rows without id link with
nothing, get no component and are kept; an empty table gives no rows; extra columns are ignored, whatever their names. Ids
must be whole numbers.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, connected_components, materialize, small_side

BINS, BANDS, ROWS, ATTEMPTS = 256, 42, 6, 128
#: Shingles that a block of the exhaustive comparison holds on either side, about.
BLOCK = 1_000_000
#: Most ids that are broadcast to pick candidates' texts; beyond it they are picked by a shuffle join.
BROADCAST_IDS = 200_000


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words in which every bit depends on all."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@functools.cache
def odd(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


@functools.cache
def donors() -> np.ndarray:
    """The bin that each bin asks at each attempt."""
    ask = np.arange(BINS * ATTEMPTS, dtype=np.uint64) + np.uint64(1 << 32)
    return (mix(ask * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(BINS)).astype(np.int64).reshape(BINS, ATTEMPTS)


def shingles(text: str, words: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text, ASCII capitals lowered, split at ASCII white space."""
    tokens = text.encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    h = np.array([xxhash.xxh3_64_intdigest(t) for t in tokens], dtype=np.uint64)
    k = min(words, len(h))
    total = np.full(len(h) - k + 1, k, dtype=np.uint64)
    for i in range(k):
        total = mix(total * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i])
    return np.unique(total)


def buckets(hashes: np.ndarray) -> np.ndarray:
    """The band hashes of a set that is not empty."""
    bins = (hashes >> np.uint64(56)).astype(np.int64)
    first = np.searchsorted(bins, np.arange(BINS))
    full = np.zeros(BINS, bool)
    full[bins] = True
    sign = hashes[np.minimum(first, len(hashes) - 1)]
    if not full.all():
        empty = np.flatnonzero(~full)
        asked = full[donors()[empty]]
        hit = asked.argmax(axis=1)
        found = asked[np.arange(len(empty)), hit]
        sign[empty[found]] = sign[donors()[empty[found], hit[found]]]
        # a bin whose attempts all failed takes the next full one
        have = np.flatnonzero(full)
        rest = empty[~found]
        sign[rest] = sign[have[np.searchsorted(have, rest) % len(have)]]
    rows = sign[: BANDS * ROWS].reshape(BANDS, ROWS)
    return mix((rows * odd(ROWS)).sum(axis=1, dtype=np.uint64) * odd(BANDS) + np.arange(BANDS, dtype=np.uint64))


def signatures(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, n, cls, bands`` of each row: set size, 128-bit digest of the set, bucket hashes; no cls for empty sets."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                n, cls, bands = [], [], []
                for text in part.column("body").to_pylist():
                    h = shingles(text, words)
                    n.append(len(h))
                    cls.append(xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None)
                    bands.append(buckets(h).view(np.int64) if len(h) else np.zeros(0, np.int64))
                ends = np.cumsum([0, *map(len, bands)])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(bands)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(cls, pa.binary()), lists], ["doc_id", "n", "cls", "bands"])

    return rows.mapInArrow(run, "doc_id long, n long, cls binary, bands array<long>")


def sets_of(docs: DataFrame, ids: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """``rep, hashes`` of the rows whose id is in ``ids``."""
    rows = docs.select(F.col(id_col).cast("long").alias("rep"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    rows = rows.join(small_side(ids, BROADCAST_IDS), "rep", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = [shingles(t, words).view(np.int64) for t in part.column("body").to_pylist()]
                ends = np.cumsum([0, *map(len, sets)])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets)))
                yield pa.RecordBatch.from_arrays([part.column("rep"), lists], ["rep", "hashes"])

    return rows.mapInArrow(run, "rep long, hashes array<long>")


def block_links(left: list[np.ndarray], right: list[np.ndarray], same: bool, apart, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between two lists of sets; ``apart(i)`` masks the right ones that i may link with."""
    root = list(range(len(left) + len(right)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    flat = np.concatenate(right)
    sizes = np.array(list(map(len, right)))
    order = np.argsort(flat, kind="stable")
    ordered, owner = flat[order], np.repeat(np.arange(len(right)), sizes)[order]
    found = []
    for i, have in enumerate(left):
        lo, hi = np.searchsorted(ordered, have, "left"), np.searchsorted(ordered, have, "right")
        some = hi > lo
        lo, width = lo[some], (hi - lo)[some]
        take = np.repeat(lo - np.concatenate(([0], np.cumsum(width)[:-1])), width) + np.arange(width.sum()) if len(lo) else np.zeros(0, np.int64)
        common = np.bincount(owner[take], minlength=len(right))
        linked = (100 * common >= percent * (len(have) + sizes - common)) & apart(i)
        for j in np.flatnonzero(linked):
            if same and j <= i:
                continue
            a, b = find(i), find(int(j) if same else len(left) + int(j))
            if a != b:
                root[a] = b
                found.append((i, int(j)))
    return found


def rest_links(buckets_: DataFrame, components: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links ``u, v`` between classes of one bucket that are still in different components; stars are left out."""
    rows = buckets_.join(components.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    seen = rows.groupBy("band").agg(
        F.count("*").alias("k"), F.sum(F.col("n")).alias("total"), F.min("component").alias("c0"), F.max("component").alias("c1"),
        F.min("rep").alias("center"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("f0"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("f1"),
    )
    # of buckets with the same classes one is enough
    seen = seen.where("k > 2 AND c0 <> c1").groupBy("k", "f0", "f1").agg(F.min(F.struct("band", "center", "total")).alias("b")).select("b.*")
    members = rows.join(seen, "band").where("rep <> center")
    blocks = F.ceil(F.col("total") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("rep"), blocks).cast("int")
    members = members.withColumns({"blocks": blocks, "own": own}).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    members = members.select("band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "component").join(sets, "rep")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        left, right = pdf[pdf["own"] == i], pdf[pdf["own"] == j]
        if left.empty or right.empty:
            return pd.DataFrame({"u": [], "v": []}, dtype="int64")
        a, b = left["component"].to_numpy(), right["component"].to_numpy()
        pairs = block_links(list(left["hashes"]), list(right["hashes"]), i == j, lambda k: b != a[k], percent)
        ra, rb = left["rep"].to_numpy(), right["rep"].to_numpy()
        return pd.DataFrame({"u": [ra[x] for x, _ in pairs], "v": [rb[y] for _, y in pairs]}, dtype="int64")

    return members.groupBy("band", "i", "j").applyInPandas(run, "u long, v long")


def components(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of each row; texts link at a Jaccard similarity of percent / 100."""
    bounded_batches(docs.sparkSession)
    sig = materialize(signatures(docs, words, id_col, text_col), "minhash")
    have = sig.where("cls IS NOT NULL AND doc_id IS NOT NULL")
    classes = materialize(have.groupBy("cls").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands")), "minhash")
    members = have.select("doc_id", "cls").join(classes.select("cls", "rep"), "cls").select("doc_id", "rep")
    twice = members.groupBy("doc_id").agg(F.min("rep").alias("v"), F.max("rep").alias("w")).where("v < w").drop("w")
    twice = members.join(twice, "doc_id").select(F.col("rep").alias("u"), "v").where("u <> v").distinct()

    rows = classes.select("rep", "n", F.explode("bands").alias("band"))
    centers = rows.groupBy("band").agg(F.min("rep").alias("center"), F.count("*").alias("k")).where("k > 1").drop("k")
    full = materialize(rows.join(centers, "band").select("band", "rep", "n", "center"), "minhash")
    edges = materialize(full.where("rep <> center").select(F.col("rep").alias("u"), F.col("center").alias("v")).distinct(), "minhash", narrow=True)
    nodes = materialize(edges.select(F.col("u").alias("rep")).unionByName(edges.select(F.col("v").alias("rep"))).distinct(), "minhash", narrow=True)
    sets = materialize(sets_of(docs, nodes, words, id_col, text_col), "minhash")
    a = sets.select(F.col("rep").alias("u"), F.col("hashes").alias("a"))
    b = sets.select(F.col("rep").alias("v"), F.col("hashes").alias("b"))
    common, both = F.size(F.array_intersect("a", "b")), F.size("a") + F.size("b")
    sized = (100 * F.least(F.size("a"), F.size("b"))) >= percent * F.greatest(F.size("a"), F.size("b"))
    links = edges.join(a, "u").join(b, "v").where(sized & (100 * common >= percent * (both - common))).select("u", "v")
    first = materialize(connected_components(links.unionByName(twice), "minhash"), "minhash", narrow=True)

    more = rest_links(full.select("band", "rep", "n"), first, sets, percent)
    label = first.withColumnRenamed("node", "w")
    for side in ("u", "v"):
        more = more.join(label.withColumnsRenamed({"w": side, "component": f"c{side}"}), side, "left").withColumn(f"c{side}", F.coalesce(f"c{side}", side))
    second = connected_components(more.select(F.col("cu").alias("u"), F.col("cv").alias("v")), "minhash")
    # a class takes its component's component
    final = classes.select("rep").distinct().join(first.withColumnRenamed("node", "rep"), "rep", "left").withColumn("c", F.coalesce("component", "rep")).drop("component")
    final = final.join(second.withColumnRenamed("node", "c"), "c", "left").select("rep", F.coalesce("component", "c").alias("component_id"))

    label = classes.select("cls", "rep").join(final, "rep").select("cls", "component_id")
    own = sig.join(label, (sig.cls == label.cls) & sig.doc_id.isNotNull(), "left").drop(label.cls)
    found = F.coalesce("component_id", "doc_id")
    return own.select("doc_id", F.col("n").alias("n_shingles"), found.alias("component_id"), F.coalesce(F.col("doc_id") == found, F.lit(True)).alias("kept"))
