import random

import numpy as np

from xpspark.llm import substring_dedup as sd


def brute(rows):
    """Text by id, from runs as plain strings."""
    seen, out = set(), {}
    for key, text in sorted(rows):
        parts = [(k, text[a:b].split(), n) for k, (a, b, _, n) in enumerate(sd.units(text)) if text[a:b].strip()]
        gone, found = set(), set()
        total = lambda i, j: sum(n for *_, n in parts[i : j + 1])  # noqa: B023, E731
        for i in range(len(parts)):
            found |= set([(i, j) for j in range(i + 1, len(parts)) if total(i, j) >= sd.LEAST_WORDS][:1])
            found |= set([(j, i) for j in range(i - 1, -1, -1) if total(j, i) >= sd.LEAST_WORDS][:1])
        for i, j in sorted(found):
            run = " ".join(x for _, w, _ in parts[i : j + 1] for x in w)
            if run in seen:
                gone |= set(range(parts[i][0], parts[j][0] + 1))
            seen.add(run)
        out[key] = "".join(text[a:b] for k, (a, b, *_) in enumerate(sd.units(text)) if k not in gone)
    return out


def test_equals_brute_force(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(1, 8)))
    sentence = lambda n: " ".join(word() for _ in range(n)).capitalize() + rng.choice([". ", "! ", ".\n", "\n\n"])
    short = lambda n: "".join(" ".join(word() for _ in range(rng.randint(1, 5))) + rng.choice([". ", "!! ", "\n"]) for _ in range(n))
    passages = ["".join(sentence(rng.randint(3, 14)) for _ in range(6)) for _ in range(5)] + [sentence(70), short(30), " ".join(word() + "!!" for _ in range(60)) + " "]
    rows = []
    for i in range(150):
        text = [sentence(rng.randint(1, 20)) for _ in range(rng.randint(0, 9))]
        if i % 2:
            text.insert(rng.randint(0, len(text)), rng.choice(passages))
        rows.append((i, "".join(text)))
    rows += [(500, rows[7][1]), (501, ""), (502, "x " * 200), (503, rows[9][1] + rows[9][1]), (504, "\n\n Ab. \n\n")]
    df = spark.createDataFrame([(*r, 1, "k", 2) for r in rows], "doc_id long, text string, __places int, key string, __0 int")
    want = brute(rows)
    out = sd.dedup(df)
    assert out.columns == df.columns and {r.doc_id: r.text for r in out.collect()} == want
    for r in sd.report(df).collect():
        text = dict(rows)[r.doc_id]
        assert r.text == want[r.doc_id] and r.n_sentences == len(sd.units(text)) and bool(r.n_removed) == (want[r.doc_id] != text) == bool(r.first_ids)
        for s in reversed(r.spans):
            text = text[: s.start] + text[s.end :]
        assert text == r.text


def test_run_hashes_are_those_of_words():
    a = "One two three four. Five six seven eight nine ten eleven twelve. Thirteen fourteen."
    b = "Other words stand here. And more of them. " + a.replace(". ", ".\n ") + " Tail."
    hashes = lambda t: set(zip(*(h.tolist() for h in sd.runs(t)[2]), strict=True))
    assert hashes(a) <= hashes(b) and len(hashes(a)) == 2
    assert not hashes("One two three four. Five six seven eight nine ten twelve eleven. Thirteen fourteen.") & hashes(a)


def test_long_sentence_in_other_context(spark):
    rng = random.Random(9)
    words = lambda n: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(n))
    passage = words(90)
    df = spark.createDataFrame([(i, f"{words(20 + i)} {passage} {words(9)}.") for i in range(6)], "doc_id long, text string")
    got = {r.doc_id: r for r in sd.report(df).collect()}
    assert all(got[i].first_ids == [0] and len(got[i].text.split()) < 70 for i in range(1, 6)) and not got[0].n_removed


def test_units_cover_the_text():
    for text in ("", "a", "A b. C d!  E\n\n f 3.14 g。h！", "\n\n", " . ", "x " * 99, "漢" * 99):
        assert "".join(text[a:b] for a, b, *_ in sd.units(text)) == text


def test_texts_without_spaces(spark):
    rng = random.Random(11)
    glyphs = "".join(chr(rng.randint(0x4E00, 0x9000)) for _ in range(300))
    df = spark.createDataFrame([(1, f"前{glyphs}"), (2, f"後文{glyphs}"), (3, "z" * 500), (4, "y" + "z" * 500)], "doc_id long, text string")
    got = {r.doc_id: r for r in sd.report(df).collect()}
    assert len(got[2].text) < 60


def test_repeats_within_a_text_are_told_there(spark, monkeypatch):
    passage = "One two three four five six seven. Eight nine ten eleven twelve thirteen fourteen. "
    rows = [(i, f"Start {i} of a text. " + passage * 20) for i in range(1, 31)] + [(40, "Alone stands this one here, of seven. And this goes with it, is as long. " * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    met, join = [], sd.join_hot
    monkeypatch.setattr(sd, "join_hot", lambda rows_, keys, on: met.append(rows_.count()) or join(rows_, keys, on))
    got = sorted((r.doc_id, r.n_removed, r.first_ids) for r in sd.report(df).collect())
    # by hand: the first text keeps its first passage, as does the text that only repeats itself
    assert got == [(i, 40 - 2 * (i == 1), [1]) for i in range(1, 31)] + [(40, 4, [40])]
    # two hashes of the passage in each of 30 texts and two in the last, where each text's 39 runs of the passage were met before
    assert met[-1] == 2 * 31


def test_told():
    which, h0, h1 = np.array([0, 0, 0, 0, 1, 1]), np.array([5, 5, 5, 6, 5, 6]), np.array([1, 1, 2, 1, 1, 6])
    assert sd.told(which, [h0, h1]).tolist() == [1, 2, 0, 0, 0, 0]
    assert sd.told(which[:0], [h0[:0], h1[:0]]).tolist() == []


def test_odd_rows(spark):
    text = "One two three four five six seven. Eight nine ten eleven twelve thirteen. End."
    rows = [(1, text), (2, text + " Other."), (None, text), (3, None), (4, ""), (5, "Short."), (6, "Not repeated. At all.")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.n_sentences, r.n_removed, r.text) for r in sd.report(df).collect()}
    assert got == {(1, 3, 0, text), (2, 4, 3, "Other."), (None, 3, 0, text), (3, None, None, None), (4, 0, 0, ""), (5, 1, 0, "Short."), (6, 2, 0, "Not repeated. At all.")}
    assert sd.report(df.limit(0)).count() == 0 == sd.dedup(df.limit(0)).count()
