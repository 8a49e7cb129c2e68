import random
import tracemalloc
import zlib

import pyarrow as pa
import pytest

from xpspark.llm import queries, toxicity


def corpus(rng, n):
    vocab = ["".join(rng.choices("abcdeghiklmnorstu", k=rng.randint(2, 7))) for _ in range(800)]
    rows = []
    for i in range(n):
        words = rng.choices(vocab, k=rng.randint(5, 80))
        toxic = i % 7 == 0
        for _ in range(rng.randint(1, 4) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["zorgle", "blarno", "vequ" + rng.choice(vocab)]))
        rows.append((i, " ".join(words) + ".", int(toxic)))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus(random.Random(5), 900)
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    part = df.where("doc_id % 3 <> 1")
    model = toxicity.train(toxicity.draw(part, part.select("doc_id", "toxic")))
    assert {"zorgle", "blarno"} <= dict(model.stems).keys()
    # no stem by chance: all others are known, or beginnings of the planted ones
    assert all(s in toxicity.INSULT or s in ("zorgle", "blarno") or s.startswith("vequ") for s, _ in model.stems)
    got = {r.doc_id: r.score for r in toxicity.score_documents(df.withColumnRenamed("toxic", "score"), model).collect()}
    right = [(got[i] >= 0.7) == bool(y) for i, _, y in rows if i % 3 == 1]
    assert sum(right) >= 0.97 * len(right)
    assert toxicity.keep_clean(df, model).count() == sum(s < 0.7 for s in got.values())


def test_stems_of_a_batch_are_held_a_part_at_a_time():
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdeghiklmnorstu", k=rng.randint(3, 12)))
    texts = [" ".join(word() for _ in range(300)) for _ in range(400)] + ["", " ".join(word() for _ in range(40_000)), "last one"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array([k % 3 == 0 for k in range(len(texts))])], ["body", "y"])
    tracemalloc.start()
    try:
        rows = sum(b.num_rows for b in toxicity.stem_rows(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    # all stems at once take 95 MB, those of the longest text 46
    assert peak < 60 << 20
    got = [r for b in toxicity.stem_rows(iter([batch])) for r in zip(*b.to_pydict().values(), strict=True)]
    want = [(k % 3 == 0, s, n) for k, t in enumerate(texts) for s, n in {**toxicity.stems_of(t), "": float(len(toxicity.WORD.findall(t)))}.items()]
    assert len(got) == rows and got == want


KINDS = ["insult", "violence", "violent past", "person", "negation", "report", "quote", "speaker", "intent", "speaker intent", "auxiliary", "word", "word", "word"]


def brute(classes, weights):
    """Each match by itself, from the words around it."""
    total = 0.0
    for k, c in enumerate(classes):
        near = lambda kinds, a, b: any(x in kinds for x in classes[max(0, a) : max(0, b)])  # noqa: E731, B023
        scale = (toxicity.DENIED if near({"negation"}, k - toxicity.NEGATED, k) else 1) * (toxicity.SAID if "report" in classes[:k] or classes[:k].count("quote") % 2 else 1)
        behind, ahead = near({"person"}, k - toxicity.BEHIND, k), near({"person"}, k + 1, k + 1 + toxicity.AHEAD)
        if c == "insult":
            total += weights[k] * scale * (toxicity.AIMED if behind or ahead else toxicity.ALONE)
        if c in ("violence", "violent past"):
            intents = [j for j in range(max(0, k - toxicity.SPAN), k) if classes[j] in ("intent", "speaker intent")]
            intended = any(near({"speaker", "speaker intent"}, j - toxicity.SPAN, j) for j in intents)
            passive = near({"auxiliary"}, k - 2, k)
            if intended and (behind or ahead):
                total += weights[k] * scale * toxicity.INTENDED
            elif not intended and c == "violence" and not passive and ahead:
                total += weights[k] * scale
    return total


@pytest.mark.parametrize("seed", range(40))
def test_grammar_equals_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(100):
        classes = rng.choices(KINDS, k=rng.randint(0, 25))
        weights = [rng.choice([1.0, 3.0, 5.0]) for _ in classes]
        assert sum(toxicity.matches(classes, weights)) == pytest.approx(brute(classes, weights))


def test_clauses():
    model = toxicity.Model(tuple(toxicity.known().items()))
    score = lambda t: toxicity.score(t, model)
    plain = score("a text")
    assert score("you are an idiot") >= 0.7 and score("You idiot!") >= 0.7 and score("an idiot like you") >= 0.7
    assert score("I will kill you") >= 0.7 > 0.1 > score("he was killed in the war") == pytest.approx(plain, abs=0.01)
    assert score("ich werde dich töten") >= 0.7 and score("we are going to murder them") >= 0.7
    assert score("time to kill") < 0.1 and score("they killed the lights") < 0.1
    assert score("you are not an idiot") < 0.7 and score("he wrote: she was not stupid") < 0.7
    weigh = lambda t: toxicity.evidence(t, (("scum", 5.0),))
    assert weigh("not scum") < weigh("he wrote scum") < weigh("scum") < weigh("you scum") == weigh("scum like you")
    assert weigh("you. scum") == weigh("scum") and weigh("scum. scum") == 2 * weigh("scum")
    assert weigh("xscum, scu m") == 0 == weigh("")


def test_odd_rows(spark):
    model = toxicity.Model(tuple(toxicity.known().items()))
    rows = [(1, None), (2, ""), (3, "you idiot"), (3, "you idiot"), (None, "x " * 60_000)]
    got = toxicity.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    none = spark.createDataFrame([], "doc_id long, text string, toxic int")
    assert toxicity.train(toxicity.draw(none, none)) == model
    assert toxicity.score_documents(none, model).count() == 0 == toxicity.keep_clean(none, model).count()
    # of equal texts with both labels the toxic one counts, however rows are dealt
    both = spark.createDataFrame([(1, "same", 0), (2, "same", 1), (3, "other", 0), (3, "other", 0)], "doc_id long, text string, toxic int")
    for n in (1, 5):
        d = both.repartition(n)
        assert sorted((r.body, r.y) for r in toxicity.draw(d.select("doc_id", "text"), d.select("doc_id", "toxic")).collect()) == [("other", False), ("same", True)]


def test_registered_query(spark, tmp_path):
    rows = corpus(random.Random(6), 400)
    docs = [(i, t) for i, t, _ in rows] + [(None, "you idiot"), (5000, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    model = queries.toxicity_model(spark, str(tmp_path), queries.table(spark, str(tmp_path), "documents"))
    want = sorted((str(i), i is not None and zlib.crc32(str(i).encode()) % 3 == 1, round(toxicity.score(t or "", model), 9), int(toxicity.score(t or "", model) >= 0.7)) for i, t in docs)
    got = queries.op7_toxicity(spark, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), r.held_out, round(r.score, 9), r.predicted) for r in got) == want
    # labels of held-out rows are never read
    flipped = [(i, 1, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, _, y in rows]
    spark.createDataFrame(flipped, "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{tmp_path}/labels.parquet")
    assert queries.toxicity_model(spark, str(tmp_path), queries.table(spark, str(tmp_path), "documents")) == model
