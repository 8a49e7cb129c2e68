"""Substring dedup over sliding sentence spans.

A text is cut into sentences; one of more than ``LONG`` words is cut further after words whose hash is the least among
``NEIGHBOURS`` on either side, alike wherever it stands. Runs of consecutive sentences slide over the text: from each
sentence on, and back from each sentence, a run grows over as many sentences (two or more) as hold ``LEAST_WORDS`` words,
so a repeated passage of whole sentences is covered from its first to its last, however short they are. A run is known by
the hash of its words (128 bits, from prefix sums over word hashes; white space between words does not count). Repeats within
a text are told there, so a text meets others by one row a hash, however often it repeats itself. Hashes meet
globally: half of the hash finds what may repeat, map-side minima find each run's first occurrence (by id, then place), a
join on the hash finds the others, with very frequent hashes joined apart. Sentences covered by any occurrence that isn't the first are
removed, in other documents and in the same one.

Characters of scripts without spaces count half a word, other words of more than ``LONG_CHARS`` characters a word per five;
where a long sentence has no white space, hashes of three characters cut it.

Results for odd input: null text stays null, with null counts; empty and very long texts are read whole; a text of fewer
sentences than a run is left alone; rows without id are neither changed nor counted; rows that share an id keep a run if
any of them holds its first occurrence at that place; equal texts (ties) keep the one with the smallest id; an empty table
gives no rows; extra columns pass through ``dedup``, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, join_hot, materialize, unused

LEAST_WORDS, LONG, NEIGHBOURS, LONG_CHARS = 12, 30, 4, 40
#: After a sentence: white space behind its mark, an ideographic mark, or a new line.
END = re.compile(r"(?<=[.!?])[\t-\r ]+|(?<=[。！？])[\t-\r ]*|\n[\t-\r ]*")
WORD = re.compile(r"[^\t-\r ]+[\t-\r ]*")
SPACELESS = re.compile("[฀-໿က-႟ក-៿぀-ヿ㐀-鿿豈-﫿\U00020000-\U0003ffff]")
#: Odd multipliers of the two rolling hashes.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def sentences(text: str) -> list[tuple[int, int]]:
    """First and end character of each sentence; together they cover the text."""
    found, at = [], 0
    for m in END.finditer(text):
        if m.end() > at:
            found.append((at, m.end()))
            at = m.end()
    return [*found, (at, len(text))] if at < len(text) else found


def word_hash(word: str) -> int:
    return int(hashlib.md5(word.encode("utf-8", "surrogatepass")).hexdigest()[:7], 16)


def weight(words: list[str]) -> int:
    """How many words ``words`` count for."""
    return sum(max(1, len(SPACELESS.findall(w)) // 2, len(w) // 5 if len(w) > LONG_CHARS else 0) for w in words)


def low_cuts(ends: list[int], values: list[int]) -> list[int]:
    """The ends, but for the last, whose value is the least of ``NEIGHBOURS`` on either side."""
    return [e for i, e in enumerate(ends[:-1]) if values[i] == min(values[max(0, i - NEIGHBOURS) : i + NEIGHBOURS + 1])]


def units(text: str) -> list[tuple[int, int, list[bytes], int]]:
    """First and end character, words and weight of each sentence or piece of a long one."""
    found = []
    spaced = text.isascii() or not SPACELESS.search(text)

    def unit(a: int, b: int) -> tuple[int, int, list[bytes], int]:
        words = text[a:b].encode("utf-8", "surrogatepass").split()
        plain = spaced and (b - a <= LONG_CHARS or not words or max(map(len, words)) <= LONG_CHARS)
        return a, b, words, len(words) if plain else weight([w.decode("utf-8", "surrogatepass") for w in words])

    for a, b in sentences(text):
        whole = unit(a, b)
        if whole[3] <= LONG:
            found.append(whole)
            continue
        if len(whole[2]) > LONG:
            marks = list(WORD.finditer(text, a, b))
            cuts = low_cuts([m.end() for m in marks], [word_hash(m[0].strip("\t\n\x0b\f\r ")) for m in marks])
        else:
            cuts = low_cuts(list(range(a + 3, b + 1)), [word_hash(text[i - 3 : i]) for i in range(a + 3, b + 1)])
        found += [unit(x, y) for x, y in zip([a, *cuts], [*cuts, b], strict=True)]
    return found


_powers: list[tuple[np.ndarray, np.ndarray]] = []


def powers(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Powers 0 to n - 1 of each base and of its inverse, modulo 2 ** 64."""
    if not _powers or len(_powers[0][0]) < n:
        size, found = max(n, 4096, 2 * len(_powers[0][0]) if _powers else 0), []
        for base in BASES:
            pair = []
            for b in (base, pow(base, -1, 1 << 64)):
                steps = np.full(size, b, np.uint64)
                steps[0] = 1
                pair.append(np.cumprod(steps, dtype=np.uint64))
            found.append(tuple(pair))
        _powers[:] = found
    return _powers


def runs(text: str, least_words: int = LEAST_WORDS) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], int]:
    """Place, number of units and the two hash halves of each run, and the text's number of units."""
    found = units(text)
    parts = [(k, words, n) for k, (_, _, words, n) in enumerate(found) if words]
    none = np.zeros(0, np.int64)
    if len(parts) < 2:
        return none, none, [none, none], len(found)
    place = np.array([k for k, _, _ in parts])
    total = np.concatenate(([0], np.cumsum([n for _, _, n in parts])))
    at = np.arange(len(parts))
    # the last part of the run from each part on, and the first part of the run back from each part
    stop = np.maximum(np.searchsorted(total, total[:-1] + least_words) - 1, at + 1)
    start = np.minimum(np.searchsorted(total, total[1:] - least_words, side="right") - 1, at - 1)
    fore, back = stop < len(parts), start >= 0
    pairs = np.unique(np.concatenate((at[fore] * len(parts) + stop[fore], start[back] * len(parts) + at[back])))
    first, last = pairs // len(parts), pairs % len(parts)
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for _, words, _ in parts for w in words], np.uint64)
    ends = np.concatenate(([0], np.cumsum([len(words) for _, words, _ in parts])))
    a, b = ends[first], ends[last + 1]
    halves = []
    for k, (power, inverse) in enumerate(powers(len(hashes))):
        own = hashes if k == 0 else (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(own * power[: len(own)], dtype=np.uint64)))
        rolled = (sums[b] - sums[a]) * inverse[a] + (b - a).astype(np.uint64)
        halves.append(((rolled ^ (rolled >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)).view(np.int64))
    return place[first], place[last] - place[first] + 1, halves, len(found)


def told(which: np.ndarray, halves: list[np.ndarray]) -> np.ndarray:
    """For each run of texts ``which``, in order of place: 0 if its text has it once, 1 at the first of several, 2 at the others."""
    order = np.lexsort((*halves, which))
    same = np.logical_and.reduce([x[order[1:]] == x[order[:-1]] for x in (which, *halves)])
    after, before = np.concatenate(([False], same)), np.concatenate((same, [False]))
    found = np.zeros(len(which), np.int8)
    found[order] = np.where(after[: len(which)], 2, before[: len(which)])
    return found


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS) -> tuple[DataFrame, DataFrame]:
    """``key, runs, first_ids``: for each text, place and length of its runs that occur earlier and where those stand;
    and ``key, h0, size``: each text's hash and number of units."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("key"), F.col(text_col).alias("body"), F.xxhash64(text_col).alias("own"))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                found = [runs(t, least_words) for t in part.column("body").to_pylist()]
                n, own = part.num_rows, part.column("own").to_numpy()
                # a row for each text with its size and hash, at place -1, and the rows of its runs
                which = np.concatenate((np.arange(n), np.repeat(np.arange(n), [len(f[0]) for f in found])))
                places = np.concatenate((np.full(n, -1), *(f[0] for f in found))).astype(np.int32)
                sizes = np.concatenate((np.array([f[3] for f in found], np.int64), *(f[1] for f in found))).astype(np.int32)
                halves = [np.concatenate((own, *(f[2][k] for f in found))).astype(np.int64) for k in (0, 1)]
                more = np.concatenate((np.zeros(n, np.int8), told(which[n:], [h[n:] for h in halves])))
                yield pa.RecordBatch.from_arrays([part.column("key").take(pa.array(which)), *map(pa.array, (places, sizes, *halves, more))], ["key", "place", "size", "h0", "h1", "more"])

    all_ = materialize(rows.mapInArrow(spread, f"key {kind}, place int, size int, h0 long, h1 long, more byte"), "runs")
    seen, sizes = all_.where("place >= 0 AND more < 2"), all_.where("place < 0").select("key", "h0", "size").distinct()
    # half of the hash finds what may repeat, so that little is left to group by all of it
    often = [F.count("*").alias("n"), F.max("more").alias("more")]
    again = materialize(seen.groupBy("h0").agg(*often).where("n > 1 OR more > 0").drop("more"), "runs")
    met = materialize(join_hot(seen, again, ["h0"]), "runs")
    first = materialize(met.groupBy("h0", "h1").agg(F.min(F.struct("key", "place")).alias("first"), *often).where("n > 1 OR more > 0").drop("more"), "runs")
    later = (F.col("key") != F.col("first.key")) | (F.col("place") != F.col("first.place"))
    run = F.struct("place", "size")
    # a row that is the first itself is kept, but its text's others, told before, still name its id
    found = join_hot(met, first, ["h0", "h1"]).where(later | (F.col("more") > 0)).select("key", F.when(later, run).alias("run"), F.col("first.key").alias("first_id"))
    within = all_.where("more = 2").select("key", run.alias("run"), F.lit(None).cast(kind).alias("first_id"))
    return found.unionByName(within).groupBy("key").agg(F.collect_set("run").alias("runs"), F.collect_set("first_id").alias("first_ids")), sizes


def without(text: str, found: list[dict]) -> tuple[str, list[dict], int, int]:
    """The text without its repeated runs, the removed spans, how many units there were and how many went."""
    spans = units(text)
    gone = sorted({k for r in found for k in range(r["place"], r["place"] + r["size"]) if k < len(spans)})
    removed: list[dict] = []
    for k in gone:
        a, b = spans[k][:2]
        if removed and removed[-1]["end"] == a:
            removed[-1]["end"] = b
        else:
            removed.append({"start": a, "end": b})
    edges = [0, *(x for s in removed for x in (s["start"], s["end"])), len(text)]
    return "".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)), removed, len(spans), len(gone)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """All rows and columns, ``text_col`` without repeated spans."""
    key, runs_ = unused(docs, 2)
    lost = repeated(docs, id_col, text_col, least_words)[0].select(F.col("key").alias(key), F.col("runs").alias(runs_))
    rows = docs.join(lost, F.col(id_col) == F.col(key), "left")

    @F.pandas_udf("string")
    def cut(text: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([t if f is None or t is None else without(t, list(f))[0] for t, f in zip(text, found, strict=True)], dtype=object)

    changed = F.when(F.col(runs_).isNotNull(), cut(F.col(text_col), F.col(runs_))).otherwise(F.col(text_col))
    return rows.withColumn(text_col, changed).select(*docs.columns)


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """Every row: ``id, n_sentences, n_removed, spans, first_ids, text``; spans in code points, end exclusive.

    Unchanged rows keep their text and have no spans; null text has null counts.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    lost, sizes = repeated(docs, id_col, text_col, least_words)
    known = sizes.join(lost, "key", "left").withColumnRenamed("key", "lost")
    rows = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("body"))
    rows = rows.join(known, (F.col("key") == F.col("lost")) & (F.xxhash64("body") == F.col("h0")), "left")
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def one(text: str | None, found: list[dict] | None, size: int | None) -> tuple:
        if text is None:
            return None, None, [], None
        if not found:
            return len(units(text)) if size is None else size, 0, [], text
        left, removed, n, gone = without(text, found)
        return n, gone, removed, left

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [one(*row) for row in zip(*(batch.column(c).to_pylist() for c in ("body", "runs", "size")), strict=True)]
            made = [pa.array([d[k] for d in done], t) for k, t in enumerate((pa.int64(), pa.int64(), span, pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column("key"), *made[:3], batch.column("first_ids"), made[3]], ["key", "n_sentences", "n_removed", "spans", "first_ids", "body"])

    out = f"key {kind}, n_sentences long, n_removed long, spans array<struct<start:long,end:long>>, first_ids array<{kind}>, body string"
    ids = F.coalesce(F.array_sort("first_ids"), F.array().cast(f"array<{kind}>")).alias("first_ids")
    return rows.select("key", "body", "runs", "size", ids).mapInArrow(cut, out).withColumnsRenamed({"key": id_col, "body": text_col})
