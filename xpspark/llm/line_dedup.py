"""Line dedup by content-defined line chunks, in DataFrame functions only.

A text's lines are hashed; a hash rolls over two neighbouring lines, and its value alone, not a position, puts a boundary
after the second one, so that the same run of lines is cut alike wherever it stands. A single set of sparse boundaries
would miss most short blocks: a chunk that holds both its boundaries is longer than they are. So all residues of the
rolling hash are used as boundary sets side by side: every pair of neighbouring lines closes a chunk in one of the sets,
and the chunk is known by that pair, its own content. A block of two or more lines that repeats is then covered from its
first line to its last, wherever it stands, as the chunks that overlap in it repeat with it. Pairs that are blank throughout
are no chunks. Lines of any chunk but a first occurrence (by id, then place) are removed; the first occurrence of each line
stays.

A narrow pass finds hashes that repeat. Only chunks with such hashes are fetched as text and compared byte by byte, by
grouping on the text itself; copies are pre-aggregated where they lie. What a hash stands for is then known, and texts that
share a hash but differ are told apart. Chunks that hold more than a thousandth of all rows,
which are a thousand at most, are joined apart, so that no task gets one key's rows. What is removed then meets its text by
id.

Results for odd input: null text stays null and empty text empty; very long texts and lines are compared whole; a text that
loses all its chunks is empty; rows without id are neither changed nor counted; rows that share an id keep a chunk if any
of them holds its first occurrence at that place; of equal texts (ties) the one with the smallest id stays; an empty table
gives no rows; extra columns pass through, whatever their names, but for ``n_lines`` and ``n_removed`` with ``details``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_hot, let, materialize, unused


def pairs(text: Column) -> Column:
    """The chunks of a text in order: each line with the one after it."""
    both = lambda lines: F.zip_with(F.slice(lines, 1, F.size(lines) - 1), F.slice(lines, 2, F.size(lines) - 1), lambda a, b: F.concat(a, F.lit("\n"), b))
    return let(F.split(text, "\n", -1), both)


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``key, gone``: the places of the chunks that each text loses."""
    rows = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("key"), F.col(text_col).alias("body"))
    rolled = F.transform(pairs(F.col("body")), lambda c, i: F.when(c.rlike(r"\S"), F.struct(i.alias("place"), F.xxhash64(c).alias("h"))))
    seen = rows.select("key", F.explode(F.filter(rolled, lambda x: x.isNotNull())).alias("c")).select("key", "c.*")
    seen = materialize(seen, "lines")
    again = materialize(seen.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "lines")
    met = materialize(join_hot(seen, again, ["h"]), "lines")
    places = met.groupBy("key").agg(F.collect_list(F.struct("place", "h")).alias("places"))
    body = lambda c: F.transform("places", lambda p: F.struct(p["place"].alias("place"), p["h"].alias("h"), F.get(c, p["place"]).alias("chunk")))
    fetched = let(pairs(F.col("body")), body)
    texts = rows.join(places, "key").select("key", F.explode(fetched).alias("c")).select("key", "c.*").where(F.xxhash64("chunk") == F.col("h"))
    # the bytes of all chunks with a hash are compared here: copies lie in one group, each other text is a group of its own
    first = texts.groupBy("h", "chunk").agg(F.min(F.struct("key", "place")).alias("first"), F.count("*").alias("n"))
    known = first.groupBy("h").agg(F.count("*").alias("texts"), F.min("first").alias("first"), F.sum("n").alias("n"))
    known = materialize(known.where("n > 1"), "lines")
    later = (F.col("key") != F.col("first.key")) | (F.col("place") != F.col("first.place"))
    lost = join_hot(met, known.where("texts = 1").drop("texts"), ["h"]).where(later).select("key", "place")
    if known.where("texts > 1").limit(1).count():
        # several texts share a hash: they are told apart by their bytes
        mixed = texts.join(known.where("texts > 1").select("h"), "h")
        again = mixed.groupBy("chunk").agg(F.min(F.struct("key", "place")).alias("first"), F.count("*").alias("n")).where("n > 1")
        lost = lost.unionByName(mixed.join(again, "chunk").where(later).select("key", "place"))
    return lost.groupBy("key").agg(F.collect_set("place").alias("gone"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", details: bool = False) -> DataFrame:
    """The rows with repeated chunks taken out of ``text_col``; ``details`` adds ``n_lines`` and ``n_removed``."""
    key, gone = unused(docs, 2)
    rows = docs.join(removals(docs, id_col, text_col).withColumnsRenamed({"key": key, "gone": gone}), F.col(id_col) == F.col(key), "left")
    lines = F.split(text_col, "\n", -1)
    covered = F.array_union(F.col(gone), F.transform(gone, lambda i: i + 1))
    kept = lambda found: F.array_except(F.sequence(F.lit(0), F.size(found) - 1), covered)
    left = let(lines, lambda found: F.transform(kept(found), lambda i: F.get(found, i)))
    out = {text_col: F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(F.array_join(left, "\n"))}
    if details:
        out["n_lines"] = F.size(lines).cast("long")
        out["n_removed"] = F.when(F.col(gone).isNull(), 0).otherwise(F.size(lines) - F.size(let(lines, kept))).cast("long")
    return rows.withColumns(out).select(*docs.columns, *(n for n in out if n not in docs.columns))
