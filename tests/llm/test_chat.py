import hashlib
import random

from xpspark.llm import chat

BITS = ["[INST]", "[/INST]", "</s>", "\\", "[INST\\]", "</s\\\\>", "]", ">", "[", "<", "/s", "é", "\n", "ok", "[/INST", ""]


def test_round_trip_of_odd_texts():
    rng = random.Random(1)
    for _ in range(3000):
        role, body = ("".join(rng.choices(BITS, k=rng.randint(0, 6))) for _ in range(2))
        assert chat.parse(chat.render(role, body)) == [(role, body)]
    assert chat.render("user", "plain [x]") == "[INST]user[/INST]plain [x]</s>"


def test_sequence_parses_to_the_same_turns():
    rng = random.Random(2)
    turns = [("user", "".join(rng.choices(BITS, k=5))) for _ in range(50)]
    assert chat.parse("".join(chat.render(*t) for t in turns)) == turns


def test_conversations(spark):
    rows = [(1, 0, "user", "hi"), (1, 2, "user", None), (1, 1, "assistant", "yes </s> no"), (2, 0, None, ""), (None, 0, "assistant", "x"), (1, 2, "user", None), (3, 0, "system", "y" * 50_000)]
    df = spark.createDataFrame([(*r, "k") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(df)).collect()}
    assert set(got) == {1, 2, 3, None}
    text = "user\nhi\nassistant\nyes </s> no\nuser\n\nuser\n\n"
    assert got[1].n_turns == 4 and got[1].turns_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert got[1].loss_sha256 == hashlib.sha256(b"yes </s> no").hexdigest() and got[1].loss_chars == 11
    assert got[3].formatted_chars == 50_000 + 6 + chat.OVERHEAD and got[2].n_turns == 1
    assert chat.read_back(chat.format_turns(df.limit(0))).count() == 0


def test_a_conversation_is_one_text():
    rng = random.Random(4)
    for _ in range(200):
        turns = [(rng.choice(["user", "assistant"]), "".join(rng.choices(BITS, k=rng.randint(0, 5)))) for _ in range(rng.randint(1, 6))]
        text = "".join(chat.render(*t) for t in turns)
        reader, at = chat.Reader(), 0
        while at < len(text):
            step = rng.randint(1, 20)
            reader.feed(text[at : at + step])
            at += step
        row = reader.row("c")
        assert chat.parse(text) == turns and row[1] == len(turns) and row[5] == len(text)
        assert row[2] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
