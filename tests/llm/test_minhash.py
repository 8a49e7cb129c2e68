import random

import numpy as np
import pytest

from xpspark.llm import minhash


def brute(rows, words, percent):
    def shingle_set(text):
        t = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
        return {tuple(t)} if 0 < len(t) < words else {tuple(t[i : i + words]) for i in range(len(t) - words + 1)}

    sets = [shingle_set(t) for _, t in rows]
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (i, _), a in zip(rows, sets):
        for (j, _), b in zip(rows, sets):
            if a and b and None not in (i, j) and i != j and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return sorted((str(i), len(s), str(find(i) if i is not None and s else i), True if i is None or not s else find(i) == i) for (i, _), s in zip(rows, sets))


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(300)]
    rows, base = [], []
    for i in range(60):
        base.append([rng.choice(vocab) for _ in range(rng.choice([1, 2, 4, 12, 60, 200]))])
    for i in range(400):
        words = list(rng.choice(base))
        for _ in range(rng.randint(0, 1 + len(words) // 25)):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        rows.append((i, " ".join(words).capitalize()))
    chain = [f"c{k}" for k in range(120)]
    for i in range(30):  # each links with its neighbours only
        chain = chain[:]
        chain[i * 4] = f"d{i}"
        rows.append((1000 + i, " ".join(chain)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("words", "percent", "seed"), [(3, 85, 1), (5, 80, 2)])
def test_equals_brute_force(spark, words, percent, seed):
    rows = corpus(seed) + [(2000, None), (2001, ""), (2002, " \n\t"), (None, "x y z"), (2003, "É one two"), (2004, "é one two"), (5, "\xa0a b")]
    rows += [(3000, "same text here now"), (3000, "same text here now"), (3001, "same text here now")]
    rows = [r for r in rows if r[0] != 5 or r[1] == "\xa0a b"]
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id long, text string, rep string, n int")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in minhash.components(df, words, percent).collect())
    assert got == brute(rows, words, percent)


def test_ids_that_repeat(spark):
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g"), (2, "h i j k l m n"), (3, "h i j k l m n"), (9, "")]
    got = minhash.components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(1, 1), (2, 1), (3, 1), (9, 9)}


def test_no_rows(spark):
    assert minhash.components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_bands_find_links_at_the_threshold():
    rng, missed = np.random.default_rng(3), 0
    for _ in range(400):
        n = int(rng.integers(20, 400))
        common, gone = rng.integers(0, 2**63, n).astype(np.uint64), max(1, n // 12)
        a, b = np.unique(common), np.unique(np.concatenate((common[gone:], rng.integers(0, 2**63, gone).astype(np.uint64))))
        missed += not (minhash.buckets(minhash.mix(a)[np.argsort(minhash.mix(a))]) == minhash.buckets(np.sort(minhash.mix(b)))).any()
    assert missed <= 1
