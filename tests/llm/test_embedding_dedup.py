import numpy as np

from xpspark.llm import embedding_dedup as ed


def brute(rows, threshold=0.98):
    def fit(v):
        return v is not None and len(v) and None not in v and np.isfinite(np.array(v, float)).all() and any(v)

    good = [(k, i, np.array(v, np.float64), lab) for k, (i, v, lab) in enumerate(rows) if i is not None and lab is not None and fit(v)]
    links, root = {k: 0 for k, *_ in good}, {k: k for k, *_ in good}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for n, (k, _, x, a) in enumerate(good):
        for m, _, y, b in good[n + 1 :]:
            if a == b and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                links[k] += 1
                links[m] += 1
                root[find(k)] = find(m)
    low = {}
    for k, i, *_ in good:
        low[find(k)] = min(i, low.get(find(k), i))
    out = []
    for k, (i, *_) in enumerate(rows):
        c = low[find(k)] if k in root else i
        out.append((str(i), links.get(k, 0), str(c), c == i))
    return sorted(out)


def test_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(11)
    monkeypatch.setattr(ed, "BLOCK", 16)  # large buckets go to many blocks
    rows = []
    for i in range(500):
        c = rng.standard_normal(32) if i % 4 == 0 else c + 0.02 * rng.standard_normal(32) * (i % 3)
        rows.append((i, c.astype(np.float32).tolist(), int(i // 4 % 5)))
    hot = rng.standard_normal(32)
    rows += [(1000 + i, (hot + 0.01 * rng.standard_normal(32)).astype(np.float32).tolist(), 1) for i in range(120)]
    rows += [(2000 + i, rows[0][1], 0) for i in range(50)] + [(3000, rows[0][1], 1), (3001, rows[0][1], None), (None, rows[0][1], 0)]
    rows += [(3002, None, 0), (3003, [], 0), (3004, [0.0] * 32, 0), (3005, [float("nan")] * 32, 0), (3006, [float("inf")] + [1.0] * 31, 0), (3007, [None] + [1.0] * 31, 0)]
    # a cosine of exactly 0.98, and the next below
    rows += [(3100, [1.0, 0.0, 0.0, 0.0], 2), (3101, [49.0, 3.0, 3.0, 9.0], 2), (3102, [49.0, 3.0, 3.0, 9.001], 3), (3103, [1.0, 0.0, 0.0, 0.0], 3)]
    rows += [(3008, [0.0, 1.0], 0), (3009, [-0.0, 2.0], 0), (3010, [0.0, 1.0], 0), (3010, [0.0, 1.0], 0)]
    df = spark.createDataFrame([(*r, 7) for r in rows], "vec_id long, embedding array<float>, label int, cid int")
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in ed.components(df).collect())
    assert got == brute(rows)
    assert {g[0]: g[1] for g in got}["3100"] == 1 and {g[0]: g[1] for g in got}["3103"] == 0
    assert ed.components(df.limit(0)).count() == 0
