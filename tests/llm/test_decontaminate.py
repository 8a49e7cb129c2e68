import random
import re

from xpspark.llm import decontaminate

WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(docs, items):
    out = []
    for key, text in docs:
        have, hit, ids = words(text), set(), set()
        for item, body in items:
            w = words(body)
            size = min(10, len(w))
            for at in range(max(1, len(w) - 9) if w else 0):
                for p in range(len(have) - size + 1):
                    if have[p : p + size] == w[at : at + size]:
                        hit |= set(range(p, p + size))
                        if item is not None:
                            ids.add(str(item))
        out.append((str(key), len(have), len(hit), sorted(ids), bool(hit)))
    return sorted(out)


def test_equals_brute_force(spark):
    rng = random.Random(6)
    vocab = [f"v{k}" for k in range(40)] + ["É", "é", "A1"]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([1, 3, 9, 10, 11, 25])))) for i in range(2, 22)]
    items += [(30, None), (31, " .,"), (32, "so so so so so so so so so so so so"), (2, "v1 v2 v3"), (None, "v3 v2 v1")]
    docs = []
    for i in range(120):
        parts = rng.choices(vocab, k=rng.randint(0, 60))
        body = rng.choice(items)[1] or ""
        if i % 3 == 0:
            cut = body.split()
            k = rng.randint(0, max(0, len(cut) - 10))
            parts[10:10] = cut[k : k + 12]
        docs.append((i, rng.choice([" ", ", ", "\n", "@"]).join(parts).upper() if i % 5 == 0 else " ".join(parts)))
    docs += [(200, None), (201, ""), (7, "So so so, so so so so so so so so so so so!"), (None, items[3][1]), (7, "so " * 3000)]
    d = spark.createDataFrame([(*r, 1, "k") for r in docs], "doc_id long, text string, row int, word string")
    b = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, term int")
    got = decontaminate.decontaminate(d, b).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, list(r.item_ids), r.contaminated) for r in got) == brute(docs, items)


def near_items(have, items):
    """Items with 8 tenths of a window's words, five or more, in place or one word late, and no window whole in place."""
    out = set()
    for item, w in items:
        size, whole, close = min(10, len(w)), False, False
        for at in range(len(w) - size + 1):
            for p in range(-size - at - 2, len(have) + 1):
                word = lambda q: have[q] if 0 <= q < len(have) else None
                exact = [word(p + k) == w[at + k] for k in range(size)]
                late = [word(p + k + 1) == w[at + k] for k in range(size)]
                n = sum(a or b for a, b in zip(exact, late, strict=True))
                whole, close = whole or all(exact), close or (10 * n >= 8 * size and size >= 5)
        out |= {item} if close and not whole else set()
    return out


def test_proximity(spark):
    base = "a b c d e f g h i j".split()
    docs = [("x a b c d q f g h i j y", 1), ("a b c d", 0), ("a b c d e f g h i j", 0), ("a b c d e new f g h i j", 1), ("a b c d e g h i j", 1), ("j i h g f e d c b a", 0)]
    # every place, and every two places, altered
    docs += [(" ".join("q" if k == m else w for k, w in enumerate(base)), 1) for m in range(10)]
    docs += [(" ".join("q" if k in (m, n) else w for k, w in enumerate(base)), 1) for m in range(10) for n in range(m)]
    docs += [(" ".join(base[:m] + ["in"] + base[m:]), 1) for m in range(1, 10)]
    d = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(docs)], "doc_id long, text string")
    b = spark.createDataFrame([(1, " ".join(base))], "item_id long, text string")
    got = {r.doc_id: r.n_near for r in decontaminate.decontaminate(d, b).collect()}
    assert [(t, got[k]) for k, (t, n) in enumerate(docs) if got[k] != n] == []


def test_no_rows(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontaminate.decontaminate(d.limit(0), b).count() == 0
    assert decontaminate.decontaminate(d, b.limit(0)).first().n_hit == 0


def test_proximity_equals_brute_force(spark):
    rng = random.Random(7)
    vocab = [f"v{k}" for k in range(60)]
    items = [(i, rng.choices(vocab, k=rng.choice([1, 2, 4, 5, 9, 10, 12, 20]))) for i in range(16)]
    docs = [(1, "x a b c d q f g h i j y".split()), (2, ["e"])]
    items.append((99, list("abcdefghij")))
    for i in range(10, 90):
        copy = list(items[i % 16][1])
        for _ in range(rng.randint(0, 3)):
            copy[rng.randrange(len(copy))] = rng.choice([*vocab, "new"])
        docs.append((i, rng.choices(vocab, k=rng.randint(0, 9)) + copy + rng.choices(vocab, k=3)))
    want = {key: len(near_items(have, items)) for key, have in docs}
    d = spark.createDataFrame([(k, " ".join(w)) for k, w in docs], "doc_id long, text string")
    b = spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id long, text string")
    got = {r.doc_id: r.n_near for r in decontaminate.decontaminate(d, b).collect()}
    assert want[1] == 1 and got == want
