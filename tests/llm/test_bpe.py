import random

import public_tokenizers
import pytest

from xpspark.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
PARTS = ['the ', "don't", "'s", "''ll", '!!!', '<|endoftext|>', '<|startoftext|>', '\xe9', 'e\u0301', '\u65e5\u672c\u8a9e', '\U0001f600', '12', ' ', '\n', '\x1c', '\xa0', 'ABC', 'syntactic', '\xdfx', '\u1100\u1161\u11a8', '\u0130', '...', "'", 'aaaaaaaa', '-', '_', '\u0301\u0323']


def expected(text):
    return bpe.load(PATH).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(60))
def test_tree_equals_library(seed):
    rng = random.Random(seed)
    parts = rng.sample(PARTS, rng.randint(2, len(PARTS)))
    text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 1500)))
    assert bpe.encode_text(PATH, text, leaf_chars=rng.choice([150, 200, 333, 1000])) == expected(text)


@pytest.mark.parametrize("seed", range(12))
def test_unsplit_text(seed):
    rng = random.Random(seed)
    text = "".join(rng.choice("abcdehinorst" if seed % 2 else "!?.'*#-") for _ in range(4000))
    assert bpe.encode_text(PATH, text, leaf_chars=300) == expected(text)


@pytest.mark.parametrize("seed", range(10))
def test_words_equal_library(seed):
    rng = random.Random(seed)
    chars = "abcABC'sSxyz<|>.,!?019-_" + "\xe9\xc9\xdf\xaa\xb2\xbd\xd7\u0130\u01c5\u024f\u03a3\u0301\xad\x7f\x01\x1c"
    for _ in range(400):
        text = "".join(rng.choices(chars, k=rng.randint(1, 12)))
        assert bpe.encode_text(PATH, text) == expected(text)


def test_rows(spark):
    long = "word's " * 400 + "x" * 900
    rows = [(1, "Hello, World"), (2, None), (3, ""), (4, long), (4, long), (None, "a"), (None, long), (5, "a\x1cb <|endoftext|>c")]
    df = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, key string, ids int")
    got = sorted((str(r.doc_id), list(r.ids), r.decoded) for r in bpe.encode(df, PATH, leaf_chars=700).collect())
    want = sorted((str(i), expected(t or ""), bpe.load(PATH).decode(expected(t or ""), skip_special_tokens=False)) for i, t in rows)
    assert got == want
    assert bpe.encode(df.limit(0), PATH).count() == 0
