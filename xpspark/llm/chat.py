"""Chat formatting with a grammar round trip.

A formatted conversation is a run of turns, each ``[INST]role[/INST]body</s>``. A deterministic parser reads it back;
a role or body must not contain a control string, and each stored ``[INST\\]``-like form loses one backslash. A turn is
first written as it is, parsed again and compared; parts that don't come back identical are escaped (one backslash is
put before the closing bracket of each control-like string) and the turn is parsed again. As a turn starts and ends in
the parser's start state, turns that round-trip alone also round-trip in sequence.

Rendering is per row, so a conversation of any length spreads over all tasks. Reading back streams the pieces, which are
hash-distributed by conversation and sorted by turn, through the parser as one text, wherever it is cut; a task keeps one
turn and a few hash states, never a conversation. As the digests of a conversation are sequential, its turns pass one task.

Results for odd input: null text or role counts as empty; very long texts are rendered whole; rows of a null conv_id form
one conversation; equal turns (ties) are ordered by role, then formatted text, nulls as empty; rows that repeat are turns
of their own; an empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

OPEN, MID, CLOSE = "[INST]", "[/INST]", "</s>"
#: Control strings, and those with backslashes before the last character.
LIKE = re.compile(r"(\[/?INST|</s)(\\*)([\]>])")
ESCAPED = re.compile(r"(\[/?INST|</s)(\\*)\\([\]>])")
TURN = re.compile(r"\[INST\](.*?)\[/INST\](.*?)</s>", re.DOTALL)
CONTROL = re.compile(r"\[/?INST\]|</s>")
#: Characters that the template adds to a turn.
OVERHEAD = len(OPEN + MID + CLOSE)


def escape(part: str) -> str:
    return LIKE.sub(r"\1\2\\\3", part)


def unescape(part: str) -> str:
    return ESCAPED.sub(r"\1\2\3", part)


def parse(formatted: str) -> list[tuple[str, str]] | None:
    """The turns of a formatted text, or None if the grammar doesn't derive it."""
    at, turns = 0, []
    while at < len(formatted):
        m = TURN.match(formatted, at)
        if m is None or CONTROL.search(m[1]) or CONTROL.search(m[2]):
            return None
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


def render(role: str, body: str) -> str:
    """One turn that parses to (role, body); only parts in conflict are escaped."""
    turn = [(role, body)]
    for r, b in ((role, body), (role, escape(body)), (escape(role), escape(body))):
        formatted = f"{OPEN}{r}{MID}{b}{CLOSE}"
        if parse(formatted) == turn:
            return formatted
    raise AssertionError("an escaped turn always parses")


def format_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per turn: ``conv_id, turn, role, formatted``, ``formatted`` being the turn's part of the output."""
    bounded_batches(turns.sparkSession)
    rows = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((role, "role"), (text, "body"))))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            formatted = [render(r, b) for r, b in zip(pdf["role"], pdf["body"], strict=True)]
            yield pd.DataFrame({"conv_id": pdf["conv_id"], "turn": pdf["turn"], "role": pdf["role"], "formatted": formatted})

    # bigints travel as strings so that a null among them leaves the others exact
    sent = rows.withColumns({c: F.col(c).cast("string") for c in ("conv_id", "turn")})
    out = sent.mapInPandas(run, "conv_id string, turn string, role string, formatted string")
    return out.withColumns({c: F.col(c).cast(kinds[c]) for c in ("conv_id", "turn")})


class Reader:
    """What is read back from one conversation's output, turn by turn."""

    def __init__(self):
        self.turns, self.chars, self.loss_chars, self.rest = 0, 0, 0, ""
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def feed(self, formatted: str) -> None:
        """The next piece of the conversation's text, wherever it was cut; what is no whole turn yet waits for the next."""
        self.chars += len(formatted)
        self.rest += formatted
        while m := TURN.match(self.rest):
            if CONTROL.search(m[1]) or CONTROL.search(m[2]):
                raise ValueError("the grammar does not derive this conversation")
            self.rest = self.rest[m.end() :]
            role, text = unescape(m[1]), unescape(m[2])
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            if role == "assistant":
                self.loss_chars += len(text)
                self.loss.update(text.encode("utf-8", "surrogatepass"))

    def row(self, conv: str | None) -> tuple:
        if self.rest:
            raise ValueError("a conversation ends within a turn")
        return conv, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of each conversation, read from the parts that ``format_turns`` wrote."""
    columns = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kind = formatted.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, reader, done = None, None, []
        for pdf in batches:
            for conv, part in zip(pdf["conv_id"], pdf["formatted"], strict=True):
                if reader is None or conv != now:
                    if reader is not None:
                        done.append(reader.row(now))
                    now, reader = conv, Reader()
                reader.feed(part)
            if len(done) >= 1000:
                yield pd.DataFrame(done, columns=columns)
                done = []
        if reader is not None:
            done.append(reader.row(now))
        yield pd.DataFrame(done, columns=columns)

    bounded_batches(formatted.sparkSession)
    n = int(formatted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent = formatted.withColumn("conv_id", F.col("conv_id").cast("string"))
    rows = sent.repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "formatted").select("conv_id", "formatted")
    out = rows.mapInPandas(run, "conv_id string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return out.withColumn("conv_id", F.col("conv_id").cast(kind))
