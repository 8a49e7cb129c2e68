import hashlib
import random
import re

from xpspark.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(number):
    total = 0
    for k, c in enumerate(reversed(number)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def brute(text):
    found = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            n = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else 0, "card": 12 <= len(n) <= 19 and luhn(n), "phone": 9 <= len(n) <= 15}[kind]
            if ok:
                found.append((m.start(), rank, kind, m.end()))
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(found))


def texts():
    rng = random.Random(3)
    bits = ["a@b.cc", "x.y+z@d-e.f-g.hh", "@", ".", "..", "_q@r.st", "1.2.3.4", "256.1.1.1", "1.22.333.4.5.6.7.8", "+1 (555) 010-9999", "+", "4111 1111 1111 1111", "4111111111111111", "5500-0000-0000-0004", "79927398713", "123456789012", " ", "-", "é", "😀", "00", "7", "\n", "(", "000.000.000.001"]
    out = ["".join(rng.choices(bits, k=rng.randint(0, 14))) for _ in range(600)]
    out += [None, "", "9" * 40_000, "1 " * 30_000, "a" * 40_000, "a@b.cc " * 3000, "+1" + " " * 30_000, "a." * 20_000 + "@", "4111 1111 1111 1111" + " x" * 40]
    return out


def test_base_equals_brute_force(spark):
    rows = [(i, t, "k", 1) for i, t in enumerate(texts())] + [(None, "1.2.3.4", "k", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, base string, added int").repartition(8)
    got = {r.doc_id: r for r in pii.report(pii.find(df)).collect()}
    assert len(got) == len(rows)
    for i, text, *_ in rows:
        want = brute(text)
        assert got[i].base_text == want, text[:200]
        assert got[i].n_email == want.count("email") and got[i].n_card == want.count("card")
        assert set(filter(None, want.split(","))) <= set(got[i].spans.split(","))
    assert pii.report(pii.find(df.limit(0))).count() == 0


def python_features(kind, value, before, after):
    tail = re.sub(r'^(?i:password|passwd|pwd|secret|token|api[_-]?key)[ ]*[=:][ ]*"?', "", value)
    count = lambda pattern: len(re.sub(pattern, "", value))
    found = {
        "rank": pii.KINDS.index(kind), "length": len(tail), "digits": count("[^0-9]"), "letters": count("[^A-Za-z]"), "capitals": count("[^A-Z]"), "marks": count("[A-Za-z0-9]"),
        "distinct": len(set(tail[:80])), "said_for": bool(re.search(pii.FOR, before)), "said_against": bool(re.search(pii.AGAINST, before)), "zeros": bool(re.search("000|1234|^9", value)), "quoted": after.startswith('"'), "lower_only": bool(re.search("^[a-z.]+$", tail)),
    }
    return [float(found[f]) for f in pii.FEATURES]


def leaf(tree, x):
    while isinstance(tree, tuple):
        f, cut, left, right = tree
        tree = left if x[f] <= cut else right
    return tree


def brute_added(text, model):
    base = [tuple(map(int, s.split(":")[1:])) for s in filter(None, brute(text).split(","))]
    cuts, found = dict(model.thresholds), []
    for kind, pattern in pii.PROPOSED.items():
        ms = list(re.finditer(pattern, text))
        for k, m in enumerate(ms):
            begin = max(ms[k - 1].end() if k else 0, m.start() - 32)
            stop = min(ms[k + 1].start() if k + 1 < len(ms) else len(text), m.end() + 8)
            x = python_features(kind, m[0], text[begin : m.start()], text[m.end() : stop])
            total = 0.0
            for t in model.trees:
                total += leaf(t, x)
            over = total - cuts[pii.KINDS.index(kind)]
            if over >= 0 and not any(a < m.end() and m.start() < b for a, b in base):
                found.append((-over, m.start(), m.end(), pii.KINDS.index(kind)))
    kept = []
    for _, a, b, r in sorted(found):
        if not any(x < b and a < y for x, y, _ in kept):
            kept.append((a, b, r))
    return sorted((a, r, b) for a, b, r in kept)


def other_lines(n, seed):
    """Lines by other hands than those of the trained ones: whole sentences, several kinds in a line."""
    rng = random.Random(seed)
    num = lambda k: "".join(rng.choices("0123456789", k=k))
    hexa = lambda k: "".join(rng.choices("0123456789abcdef", k=k))
    good = [
        lambda: f"Please wire it to account {rng.choice(['DE', 'FR'])}{num(2)} {num(4)} {num(4)} {num(4)} {num(4)} {num(2)} by Monday.",
        lambda: f"Her social security number, {rng.randint(100, 665)}-{rng.randint(10, 99)}-{rng.randint(1001, 8999)}, is on file.",
        lambda: f"Set password={hexa(16)} in the config.",
        lambda: f"export AWS_KEY=AKIA{''.join(rng.choices('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', k=16))} # remove",
        lambda: f"If nobody answers, call {rng.randint(201, 989)}-{rng.randint(200, 899)}-{rng.randint(1001, 8999)} after six.",
    ]
    bad = [
        lambda: f"Fixed in commit {hexa(40)} yesterday.",
        lambda: f"Invoice total {num(8)} was paid, see page {num(3)}.",
        lambda: "The token: nothing else matters to them.",
        lambda: f"Chapter {num(1)}.{num(1)} has {num(3)} pages and costs {num(2)}.{num(2)} euros.",
    ]
    return [(rng.choice(good)(), 1) if k % 2 else (rng.choice(bad)(), 0) for k in range(n)]


def test_added_spans_equal_brute_force(spark):
    model = pii.train(spark)
    texts = [t for t, _ in pii.lines(300, seed=98)] + [t for t, _ in other_lines(200, 1)]
    texts += [" ".join(texts[k : k + 7]) for k in range(0, 490, 7)] + ["", "secret 0123456789abcdef0123456789abcdef password=0123456789abcdef0123456789abcdef"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    got = {r.doc_id: [tuple(s) for s in r.added] for r in pii.find(df, model).collect()}
    assert [(t, got[i]) for i, t in enumerate(texts) if got[i] != brute_added(t, model)] == []
    spans = [(a, b) for i in got for a, _, b in got[i]]
    assert spans and all(not (a < y and x < b) for i in got for n, (a, _, b) in enumerate(got[i]) for x, _, y in got[i][:n])


def test_added_spans_on_unseen_lines(spark):
    model = pii.train(spark)
    for lines, least, most in ((pii.lines(700, seed=99), 0.8, 0.06), (other_lines(400, seed=2), 0.8, 0.1)):
        df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(lines)], "doc_id long, text string")
        got = {r.doc_id: bool(r.added) for r in pii.find(df, model).collect()}
        hits = sum(got[i] for i, (_, y) in enumerate(lines) if y)
        false = sum(got[i] for i, (_, y) in enumerate(lines) if not y)
        assert hits >= least * sum(y for _, y in lines) and false <= most * (hits + false), (hits, false)


def test_registered_query(spark, tmp_path):
    from xpspark.llm import queries

    rows = [(1, "a@b.cc and 1.2.3.4"), (2, None), (None, "+1 (555) 010-9999")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op6_pii(spark, str(tmp_path)).collect()}
    assert {k: (r.n_email, r.n_ip, r.n_card, r.n_phone, r.n_spans) for k, r in got.items()} == {1: (1, 1, 0, 0, 2), 2: (0, 0, 0, 0, 0), None: (0, 0, 0, 1, 1)}
    assert all(got[i].base_sha256 == hashlib.sha256(brute(t).encode()).hexdigest() for i, t in rows)


def test_plain_prose_is_left_alone(spark):
    text = "Version 3.14.15 of 2024-01-02, page 12 of 300, costs 1,234.56 at 10:30. Call it a day. " * 20
    row = pii.report(pii.find(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    assert row.spans == "" == row.base_text
