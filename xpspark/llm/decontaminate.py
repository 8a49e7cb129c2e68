"""Benchmark decontamination with a positional inverted index, in DataFrame functions only.

One pass over the corpus stores the postings (row, term, position) of every benchmark term and a row's number of words;
all else reads the index. Postings of other words answer no test term, so they are not stored: an index belongs to its
benchmark. Where a posting's next word makes a pair that the benchmark has, the posting says so: the lists of neighbouring
terms are intersected where they lie. Each benchmark window (``WINDOW`` consecutive words of an item, or all words of a
shorter item) looks up its rarest pairs by their counts in the index, two more than may be broken; their lists, less the
pairs' offsets in the item, are intersected on (row, item) in the order of their starts: any two that start at most ``SLOP``
words apart make a candidate. By the pigeonhole no window with ``NEAR`` tenths of its terms in place is missed, whichever
words were altered: a missing word breaks two pairs, one put in breaks one. What is left is confirmed term by term, again as an intersection of offset-adjusted postings on (row, position,
term): all terms in place make an exact phrase match; in windows of ``LEAST_NEAR`` words or more, ``NEAR`` tenths of them,
each in place or up to ``SLOP`` words late, so that a word may have been put in between them, make a proximity match. Every join is an equi-join on those keys, so
work grows with postings, not with their products, and a broadcast side is counted first.

Words are runs of ASCII letters and digits and of non-ASCII characters, ASCII capitals lowered.

Results for odd input: null or empty text has no words and no hits; very long texts are read whole; an empty table gives no
rows, an empty benchmark no hits; an item without words has no windows; rows and items that repeat are treated each for
itself, equal item ids counting once; terms of equal frequency (ties) are taken in the item's order; an item without id
hits words but isn't listed; a null doc_id passes through; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small_side

WINDOW, NEAR, SLOP, LEAST_NEAR = 10, 8, 1, 5
SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Most rows of a side that is broadcast.
BROADCAST_ROWS = 200_000


def raw_words(text: Column) -> Column:
    """The words of a text, capitals as they are."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATOR, -1), "")


def lowered(word: Column) -> Column:
    return F.when(word == F.lower(word), word).otherwise(F.translate(word, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def item_terms(benchmark: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``item, item_id, off, n, term, pair`` of every item word; ``term, word`` of every benchmark word; ``pair, term, word``
    of every two neighbouring ones, ``word`` being the second. The last word of an item begins no pair."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item_id"), F.monotonically_increasing_id().alias("item"), raw_words(F.col(text_col)).alias("words"))
    both = F.transform("words", lambda w, i: F.struct(lowered(w).alias("word"), lowered(F.get("words", i + 1)).alias("following")))
    words = items.select("item_id", "item", F.size("words").alias("n"), F.posexplode(both).alias("off", "w")).select("item_id", "item", "n", "off", "w.*")
    words = materialize(words, "decontaminate")
    terms = materialize(words.select("word").distinct().withColumn("term", F.monotonically_increasing_id()), "decontaminate", narrow=True)
    words = words.join(terms, "word").drop("word")
    pairs = words.where("following IS NOT NULL").select("term", F.col("following").alias("word")).distinct()
    pairs = materialize(pairs.withColumn("pair", F.monotonically_increasing_id()), "decontaminate", narrow=True)
    words = words.join(pairs.withColumnRenamed("word", "following"), ["term", "following"], "left").drop("following")
    return materialize(words, "decontaminate", narrow=True), terms, pairs


def build_index(docs: DataFrame, terms: DataFrame, pairs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``row, term, pos, pair, doc_id`` postings of the terms; ``pair`` where the next word makes one with it.

    Term -1 stands once in each row, at its number of words.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"), raw_words(F.col(text_col)).alias("words"))
    # the end mark travels as a null word, so that a single pass and a single split give postings and lengths
    both = F.transform(F.concat("words", F.array(F.lit(None).cast("string"))), lambda w, i: F.struct(w.alias("raw"), F.get("words", i + 1).alias("following")))
    marked = rows.select("row", "doc_id", F.posexplode(both).alias("pos", "w")).select("row", "doc_id", "pos", "w.*")
    words = marked.withColumn("word", lowered(F.col("raw"))).withColumn("h", F.xxhash64("word"))
    known = small_side(terms.withColumnRenamed("word", "known").withColumn("h", F.xxhash64("known")), BROADCAST_ROWS)
    found = words.join(known, (words["h"] == known["h"]) & (words["word"] == known["known"]), "left").where("term IS NOT NULL OR raw IS NULL")
    end = F.col("raw").isNull()
    postings = found.select("row", F.when(end, -1).otherwise(F.col("term")).alias("term"), "pos", F.when(end, F.col("doc_id")).alias("doc_id"), lowered(F.col("following")).alias("following"))
    two = small_side(pairs.select(F.col("term").alias("first"), F.col("word").alias("second"), "pair"), BROADCAST_ROWS)
    postings = postings.join(two, (F.col("term") == F.col("first")) & (F.col("following") == F.col("second")), "left")
    return materialize(postings.select("row", "term", "pos", "pair", "doc_id"), "decontaminate")


def matches(index: DataFrame, words: DataFrame, window: int = WINDOW, near: int = NEAR, slop: int = SLOP) -> DataFrame:
    """``row, item, item_id, start, size, in_place, met``: windows of items found from position ``start`` on.

    ``in_place`` is the number of the window's words that stand in their places, ``size`` for exact phrases; ``met`` also
    counts those that stand up to ``slop`` words late, in windows of ``LEAST_NEAR`` words or more.
    """
    spread = words.withColumns({"size": F.least(F.lit(window), "n"), "last": F.greatest(F.lit(0), F.col("n") - window)})
    # a window begins size - 1 pairs; a single word stands for itself, as a pair numbered below all others
    spread = spread.withColumn("pair", F.when(F.col("n") == 1, -1 - F.col("term")).otherwise(F.col("pair"))).where("pair IS NOT NULL")
    reach = F.when(F.col("n") == 1, 0).otherwise(F.col("size") - 2)
    in_window = spread.withColumn("w", F.explode(F.sequence(F.greatest(F.lit(0), F.col("off") - reach), F.least("last", "off"))))
    freq = index.where("pair IS NOT NULL").groupBy("pair").agg(F.count("*").alias("freq"))
    single = words.where("n = 1").select("term").distinct()
    alone = index.where("term >= 0").join(small_side(single, BROADCAST_ROWS), "term").groupBy((-1 - F.col("term")).alias("pair")).agg(F.count("*").alias("freq"))
    freq = materialize(freq.unionByName(alone), "decontaminate", narrow=True)
    counted = in_window.join(small_side(freq, BROADCAST_ROWS), "pair")
    rank = F.sort_array(F.collect_list(F.struct("freq", "off", "pair")))
    rare = counted.groupBy("item", "w", "size").agg(rank.alias("pairs"))
    # a missing word breaks two pairs, a word put in one; pairs that the corpus lacks are broken already
    missing = F.floor(F.col("size") * (10 - near) / 10).cast("int")
    loose = F.col("size") >= LEAST_NEAR
    spare = F.when(loose, 2 * missing + slop).otherwise(0) - (F.greatest(F.col("size") - 1, F.lit(1)) - F.size("pairs"))
    # any so many and two more pairs hold two that are there
    picked = F.slice("pairs", 1, spare + 2)
    anchors = rare.where(spare >= 0).where(F.size("pairs") > spare).select("item", "size", F.least(F.lit(2), F.size("pairs") - spare).alias("least"), F.explode(picked).alias("t"))
    known = materialize(anchors.groupBy("item", "t.off", "t.pair").agg(F.min("least").alias("least"), F.max("size").alias("size")), "decontaminate", narrow=True)
    postings = index.where("pair IS NOT NULL").select("row", "pos", "pair").unionByName(index.where("term >= 0").join(small_side(single, BROADCAST_ROWS), "term").select("row", "pos", (-1 - F.col("term")).alias("pair")))
    lists = postings.join(small_side(known, BROADCAST_ROWS), "pair").select("row", "item", (F.col("pos") - F.col("off")).alias("diagonal"), "off", "least", "size")
    # two pairs of an item whose starts are at most slop apart are neighbours in the order of starts
    order = Window.partitionBy("row", "item").orderBy("diagonal", "off")
    near_by = lists.withColumn("gap", F.col("diagonal") - F.lag("diagonal").over(order)).where((F.col("gap") <= slop) | (F.col("least") == 1))
    alone = F.col("least") == 1
    starts = F.array(F.when(alone, F.col("diagonal")), *(F.when((F.col("gap") <= k) | (alone & loose), F.col("diagonal") - k) for k in range(slop + 1)))
    places = near_by.select("row", "item", F.explode(F.array_distinct(F.array_compact(starts))).alias("diagonal")).distinct()
    places = materialize(places, "decontaminate", narrow=True)

    wanted = places.join(words.select("item", "off", "term", "n"), "item")
    wanted = wanted.withColumn("late", F.explode(F.array(*map(F.lit, range(slop + 1))))).withColumn("pos", F.col("diagonal") + F.col("off") + F.col("late")).where("pos >= 0")
    rows = small_side(materialize(places.select("row").distinct(), "decontaminate", narrow=True), BROADCAST_ROWS)
    there = index.where("term >= 0").join(rows, "row", "left_semi").select("row", "term", "pos")
    # a word counts once for a start, and as in place if it is so at all
    hit = wanted.join(there, ["row", "pos", "term"]).groupBy("row", "item", "diagonal", "off", "n").agg(F.min("late").alias("late"))
    hit = hit.withColumns({"size": F.least(F.lit(window), "n"), "last": F.greatest(F.lit(0), F.col("n") - window)})
    hit = hit.withColumn("w", F.explode(F.sequence(F.greatest(F.lit(0), F.col("off") - F.col("size") + 1), F.least("last", "off"))))
    found = hit.groupBy("row", "item", "diagonal", "w", "size").agg(F.sum((F.col("late") == 0).cast("long")).alias("in_place"), F.count("*").alias("met"))
    found = found.where((F.col("in_place") == F.col("size")) | ((F.col("met") * 10 >= F.col("size") * near) & loose))
    names = words.select("item", "item_id").distinct()
    return found.join(names, "item").select("row", "item", "item_id", (F.col("diagonal") + F.col("w")).alias("start"), "size", "in_place", "met")


def search(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The index of ``docs`` and the matches of ``benchmark`` in it, both written."""
    words, terms, pairs = item_terms(benchmark, item_col, item_text_col)
    index = build_index(docs, terms, pairs, id_col, text_col)
    return index, materialize(matches(index, words), "decontaminate", narrow=True)


def report(index: DataFrame, found: DataFrame) -> DataFrame:
    """Per document: ``doc_id, n_words, n_hit, n_items, item_ids, n_near, contaminated``.

    ``n_near`` is the number of items with a proximity match and no exact one.
    """
    exact = found.where("in_place = size")
    covered = exact.select("row", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("size") - 1)).alias("pos")).distinct()
    hits = covered.groupBy("row").agg(F.count("*").alias("n_hit"))
    items = exact.where("item_id IS NOT NULL").groupBy("row").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    near = found.groupBy("row", "item").agg(F.bool_or(F.col("in_place") == F.col("size")).alias("whole")).where("NOT whole").groupBy("row").agg(F.count("*").alias("n_near"))
    rows = index.where("term = -1").select("row", "doc_id", F.col("pos").cast("long").alias("n_words"))
    for more in (hits, items, near):
        rows = rows.join(more, "row", "left")
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    return rows.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"), F.coalesce("n_near", F.lit(0)).alias("n_near"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    return report(*search(docs, benchmark, id_col, text_col, item_col, item_text_col))
