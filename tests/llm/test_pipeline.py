import hashlib
import random
import sys

import public_tokenizers
from test_decontaminate import brute as brute_contaminated
from test_line_dedup import brute as brute_lines
from test_minhash import brute as brute_components

import corpus_pipeline
from xpspark.llm import bpe, queries, toxicity

sys.setrecursionlimit(10_000)


def corpus():
    rng = random.Random(13)
    word = lambda: "".join(rng.choices("abcdefghiklmnoprstu", k=rng.randint(2, 8)))
    line = lambda: " ".join(word() for _ in range(rng.randint(4, 12)))
    passage = [line() for _ in range(8)]
    items = [(k, " ".join(word() for _ in range(14))) for k in range(5)]
    docs, labels = [], []
    for i in range(300):
        lines = [line() for _ in range(rng.randint(1, 8))]
        toxic = i % 6 == 0
        if toxic:
            lines[0] += " blarno zorgle "
        if i % 5 == 1:
            lines[1:1] = passage
        if i % 7 == 2:
            lines.append("so " + items[i % 5][1] + " ends")
        if i % 11 == 3:
            lines = docs[i - 1][1].split("\n") + ["more"]
        docs.append((i, "\n".join(lines), "en", "s", 1))
        labels.append((i, 1, int(toxic)))
    docs += [(400, None, None, None, None), (401, "", "en", "s", 0), (None, "free text here", "en", "s", 3), (403, "long " + " ".join(f"w{k}" for k in range(20_000)), "en", "s", 0)]
    return docs, labels, items


def test_equals_brute_force_stage_by_stage(spark, tmp_path):
    docs, labels, items = corpus()
    sf = str(tmp_path)
    docs = [(*d, 7, "k") for d in docs]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, __0 int, key string").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    now = queries.table(spark, sf, "documents")
    model = queries.toxicity_model(spark, sf, now)
    rows = [(i, t) for i, t, *_ in docs if toxicity.score(t or "", model) < 0.7]
    assert rows == [(i, t) for i, t, *_ in docs if "blarno" not in (t or "")]
    lined = {i: t for i, _, _, t in brute_lines([(i, t) for i, t in rows if i is not None and t is not None])}
    rows = [(i, lined.get(i, t)) for i, t in rows]
    kept = {(i, k) for i, _, c, k in brute_components(rows, 5, 80)}
    rows = [(i, t) for i, t in rows if (str(i), True) in kept]
    bad = {i for i, _, _, _, hit in brute_contaminated(rows, items) if hit}
    rows = [(i, t) for i, t in rows if str(i) not in bad or i is None]
    path = public_tokenizers.path("word_bpe_49k.json")
    want = sorted((str(i), len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()) for i, ids in ((i, bpe.load(path).encode(t or "", add_special_tokens=False).ids) for i, t in rows))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, sf)
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "__0", "key"], name
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, sf).collect())
    assert 20 < len(got) < 240 and got == want
    none = now.limit(0)
    assert all(stage(spark, none, sf).count() == 0 for _, stage in corpus_pipeline.STAGES)
