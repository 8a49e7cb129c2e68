"""BPE encoding and decoding of whole texts, exact to the tokenizer file, with tree concatenation of long texts.

A text of at most ``leaf_chars`` is encoded where it lies. A longer one is halved again and again at any place
(white space or not); the leaves are encoded by different tasks and concatenated pairwise up the tree. At each
join, a window around the cut is encoded again and grown until it agrees exactly with both sides: its first token
with the left side's token there, and one of its inner tokens with the right side's. Agreement on a token's id and
extent fixes the rest, as each adjacent pair of tokens then stands in an encoding of the same characters.

Results for odd input: null text counts as empty; an empty text has no ids and decodes to ''; very long texts are encoded
whole; rows that repeat (ties) give equal rows, one for each; a null id passes through; an empty table gives no rows; extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import os
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

#: White space to the tokenizer's ``\s``; str.split() also splits at the four separators 1C to 1F.
WHITE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
BLACK = re.compile(f"[^{WHITE.pattern[1:]}")
SEPARATORS = re.compile("[\x1c-\x1f]")
LEAF_CHARS = 32_768
FIRST_WINDOW = 64


@functools.lru_cache(maxsize=4)
def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


#: The pre-tokenizer's pattern, for words below U+0250, which normalize to their lower case (U+0130 does not).
TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{L}\p{N}]+")
PLAIN = re.compile("[!-~\x80-\u012f\u0131-\u024f]*")


def byte_alphabet() -> dict[int, str]:
    """The byte-level pre-tokenizer's characters: printable bytes stand for themselves, others for 256 and on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordCache(dict):
    """Ids by white-space-free piece; at most ``limit`` pieces and as many pre-tokens are kept."""

    def __init__(self, tokenizer, limit: int = 250_000):
        super().__init__()
        self.tokenizer, self.limit, self.parts = tokenizer, limit, {}
        self.model, self.number = tokenizer.model, list(range(tokenizer.get_vocab_size()))
        self.letters = byte_alphabet()

    def __missing__(self, word: str):
        if word.isalpha() and PLAIN.fullmatch(word):
            low = word.lower()
            ids = self.parts.get(low) or self.part(low)
        elif PLAIN.fullmatch(word) and "<|" not in word:
            found: list[int] = []
            for part in TOKEN.findall(word.lower()):
                ids = self.parts.get(part)
                found += self.part(part) if ids is None else ids
            ids = tuple(found)
        else:
            ids = tuple(self.number[i] for i in self.tokenizer.encode(word, add_special_tokens=False).ids)
        if len(self) < self.limit and len(word) <= 64:
            self[word] = ids
        return ids

    def part(self, part: str) -> tuple[int, ...]:
        """Ids of one pre-token, by the model alone."""
        mapped = part if part.isascii() else "".join(map(self.letters.__getitem__, part.encode()))
        ids = tuple(self.number[t.id] for t in self.model.tokenize(mapped))
        if len(self.parts) < self.limit and len(part) <= 64:
            self.parts[part] = ids
        return ids


@functools.lru_cache(maxsize=4)
def cache(path: str) -> WordCache:
    return WordCache(load(path))


def words_of(text: str) -> list[str]:
    """White-space-free pieces; no token spans two of them, as the pre-tokenizer drops white space."""
    return [w for w in WHITE.split(text) if w] if SEPARATORS.search(text) else text.split()


class Piece:
    """An encoded stretch: ids and each token's first and end character in the whole text."""

    def __init__(self, lo: int, hi: int, ids, starts, ends):
        self.lo, self.hi, self.ids, self.starts, self.ends = lo, hi, ids, starts, ends


def encode_piece(tokenizer, text: str, at: int) -> Piece:
    e = tokenizer.encode(text, add_special_tokens=False)
    spans = np.array(e.offsets, dtype=np.int64).reshape(-1, 2) + at
    return Piece(at, at + len(text), np.array(e.ids, dtype=np.int32), spans[:, 0], spans[:, 1])


def clean_edge(piece: Piece, i: int) -> bool:
    """True if token i begins where no earlier token still covers a character."""
    return i == 0 or piece.ends[i - 1] <= piece.starts[i]


def encode_leaf(path: str, text: str, at: int) -> Piece:
    """As encode_piece, from the cache. Tokens of a cached word all get the word's extent: exact for words of one
    token; the other words' tokens match no token of a window, and the window grows past them."""
    table, tokenizer = cache(path), load(path)
    parts: list = []
    for m in BLACK.finditer(text):
        if m.end() - m.start() > 64:
            p = encode_piece(tokenizer, m[0], at + m.start())
            parts.append((p.ids, p.starts, p.ends))
        else:
            ids = table[m[0]]
            parts.append((ids, [at + m.start()] * len(ids), [at + m.end()] * len(ids)))
    ids, starts, ends = (np.fromiter(itertools.chain.from_iterable(p[k] for p in parts), t) for k, t in enumerate((np.int32, np.int64, np.int64)))
    return Piece(at, at + len(text), ids, starts, ends)


def concatenate(tokenizer, text, left: Piece, right: Piece) -> Piece:
    """The encoding of two adjacent pieces; ``text(a, b)`` gives characters a to b."""
    cut, width = left.hi, FIRST_WINDOW
    while True:
        a, b = max(left.lo, cut - width), min(right.hi, cut + width)
        while b < right.hi and not starter(text, b):
            b += 1
        i = int(np.searchsorted(left.starts, a, side="right")) - 1
        while i > 0 and not (clean_edge(left, i) and starter(text, int(left.starts[i]))):
            i -= 1
        a = left.lo if i <= 0 else int(left.starts[i])
        i = max(i, 0)
        w = encode_piece(tokenizer, text(a, b), a)
        head = a == left.lo or (len(w.ids) and w.ids[0] == left.ids[i] and w.starts[0] == left.starts[i] and w.ends[0] == left.ends[i] and w.ends[0] <= cut - FIRST_WINDOW // 2)
        if b == right.hi and head:
            keep, tail = len(w.ids), len(right.ids)
        else:
            keep, tail = agreed(w, right, cut) if head else (0, 0)
        if head and keep:
            k = 0 if a == left.lo else i
            j = [np.concatenate((getattr(left, n)[:k], getattr(w, n)[:keep], getattr(right, n)[tail:])) for n in ("ids", "starts", "ends")]
            return Piece(left.lo, right.hi, *j)
        if a == left.lo and b == right.hi:
            return w
        width *= 2


def agreed(w: Piece, right: Piece, cut: int) -> tuple[int, int]:
    """How many tokens of the window and how many of the right side end with the last token that both have."""
    for n in range(len(w.ids) - 2, 0, -1):
        if w.starts[n] < cut + FIRST_WINDOW // 2:
            break
        j = int(np.searchsorted(right.starts, w.starts[n], side="left"))
        same = j < len(right.ids) and w.ids[n] == right.ids[j] and w.starts[n] == right.starts[j] and w.ends[n] == right.ends[j]
        if same and clean_edge(w, n) and clean_edge(right, j) and w.ends[n] <= w.starts[n + 1] and (j + 1 == len(right.ids) or right.ends[j] <= right.starts[j + 1]):
            return n + 1, j + 1
    return 0, 0


def starter(text, m: int) -> bool:
    """True if character m neither composes nor changes places with marks before it."""
    pair = text(m - 1, m + 1)
    return not unicodedata.combining(pair[-1]) and unicodedata.is_normalized("NFC", pair)


def cuts(text: str, leaf_chars: int) -> list[int]:
    """Where the halving tree cuts a text, moved right past marks that compose or reorder with what stands before."""
    found: list[int] = []
    todo = [(0, len(text))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo <= leaf_chars:
            continue
        m = (lo + hi) // 2
        while m < hi and not starter(lambda a, b: text[a:b], m):
            m += 1
        if lo < m < hi:
            found.append(m)
            todo += [(lo, m), (m, hi)]
    return sorted(found)


def tree(tokenizer, whole: str, level: list[Piece]) -> list[int]:
    """Ids of a text from the encodings of its leaves."""
    while len(level) > 1:
        joined = [concatenate(tokenizer, lambda a, b: whole[a:b], x, y) for x, y in zip(level[::2], level[1::2], strict=False)]
        level = joined + level[len(joined) * 2 :]
    return level[0].ids.tolist() if level else []


def encode_text(path: str, text: str, leaf_chars: int = LEAF_CHARS) -> list[int]:
    """Ids of one text, by the same steps in one process."""
    if len(text) > leaf_chars:
        at = [0, *cuts(text, leaf_chars), len(text)]
        return tree(load(path), text, [encode_leaf(path, text[a:b], a) for a, b in itertools.pairwise(at)])
    return list(itertools.chain.from_iterable(map(cache(path).__getitem__, words_of(text))))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """Ids and decoded text of each row: ``id_col``, ``ids array<int>``, ``decoded string``.

    Only texts longer than ``leaf_chars`` are shuffled, as leaves; a task holds one text at most.
    """
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    out = f"key {kind}, ids array<int>, decoded string"
    plain = load(path).decoder is None

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, tokenizer = cache(path), load(path)
        name = [tokenizer.id_to_token(i) for i in range(tokenizer.get_vocab_size())]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                flat, ends, decoded = [], [0], []
                for text in part.column("body").to_pylist():
                    ids = list(itertools.chain.from_iterable(map(table.__getitem__, words_of(text))))
                    flat += ids
                    ends.append(len(flat))
                    # the file names no decoder: the library puts a space between tokens
                    decoded.append(" ".join(map(name.__getitem__, ids)) if plain else tokenizer.decode(ids, skip_special_tokens=False))
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("key"), ids, pa.array(decoded, pa.string())], ["key", "ids", "decoded"])

    def halve(batches):
        for pdf in batches:
            for key, text in zip(pdf["key"], pdf["body"], strict=True):
                at = [0, *cuts(text, leaf_chars), len(text)]
                digest = hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
                yield pd.DataFrame({"key": [key] * (len(at) - 1), "digest": digest, "leaf": range(len(at) - 1), "lo": at[:-1], "body": [text[a:b] for a, b in itertools.pairwise(at)]}).astype({"key": pdf["key"].dtype})

    def leaves(batches):
        for pdf in batches:
            p = [encode_leaf(path, text, lo) for text, lo in zip(pdf["body"], pdf["lo"], strict=True)]
            yield pdf.assign(ids=[x.ids for x in p], starts=[x.starts for x in p], ends=[x.ends for x in p])

    def join_up(pdf):
        copies = int((pdf["leaf"] == 0).sum())
        pdf = pdf.drop_duplicates("leaf").sort_values("leaf")
        parts = [Piece(lo, lo + len(t), np.asarray(i, np.int32), np.asarray(s), np.asarray(e)) for lo, t, i, s, e in zip(pdf["lo"], pdf["body"], pdf["ids"], pdf["starts"], pdf["ends"], strict=True)]
        ids = tree(load(path), "".join(pdf["body"]), parts)
        decoded = load(path).decode(ids, skip_special_tokens=False)
        return pd.DataFrame({"key": [pdf["key"].iloc[0]] * copies, "ids": [ids] * copies, "decoded": [decoded] * copies}).astype({"key": pdf["key"].dtype})

    leaf = f"key {kind}, digest string, leaf int, lo long, body string"
    long = rows.where(F.length("body") > leaf_chars).mapInPandas(halve, leaf).repartition("key", "digest", "leaf")
    long = long.mapInPandas(leaves, f"{leaf}, ids array<int>, starts array<long>, ends array<long>").groupBy("key", "digest").applyInPandas(join_up, out)
    done = rows.where(F.length("body") <= leaf_chars).mapInArrow(short, out).unionByName(long)
    return done.select(F.col("key").alias(id_col), "ids", "decoded")
