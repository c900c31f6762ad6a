import hashlib
import random

from quarry.llm.chat_format import CONTROL, ParseError, escape, format_turns, parse, read_back, render, unescape
from quarry.llm.queries import q_op10


def digest(turns):
    return hashlib.sha256("".join(f"{r or ''}\n{t or ''}\n" for r, t in turns).encode()).hexdigest()


def test_round_trip_on_random_control_strings():
    rng = random.Random(1)
    parts = ["<s>", "</s>", "[INST]", "[/INST]", "\\", "<", "s>", "[", "/", "INST]", "\n", " ", "a", "é"]
    turns, whole = [], ""
    for _ in range(20_000):
        role = "".join(rng.choice(parts) for _ in range(rng.randrange(0, 4)))
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(0, 9)))
        assert unescape(escape(text)) == text
        turns.append((role, text))
        whole += render(role, text)
        if not CONTROL.search(text) and not CONTROL.search(role):
            assert text in whole[-len(text) - 6:]  # left as it is
    assert parse(whole) == turns


def test_parser_is_strict():
    for bad in ("x", "<s>[INST] user [/INST]\nhi", "<s>[INST] user [/INST]\na<s>b</s>\n", "hi</s>\n"):
        try:
            parse(bad)
        except ParseError:
            continue
        raise AssertionError(bad)


def test_edge_cases(spark):
    rows = [(1, 2, "assistant", None, 0), (1, 1, "user", "hi", 0), (1, 1, "user", "hi", 0), (2, None, None, "x", 0),
            (None, 1, "tool", "é" * 50_000, 0), (None, 2, "assistant", "<\\s> [INST]", 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")
    got = {r.conv_id: r for r in read_back(format_turns(df)).collect()}
    assert got[1].n_turns == 3 and got[1].turns_sha256 == digest([("user", "hi")] * 2 + [("assistant", "")])
    assert got[2].turns_sha256 == digest([("", "x")])
    assert got[None].loss_chars == len("<\\s> [INST]")
    assert got[None].loss_sha256 == hashlib.sha256(b"<\\s> [INST]").hexdigest()
    assert read_back(format_turns(df.limit(0))).count() == 0
    marked = [r.formatted[r.loss_start:r.loss_end] for r in format_turns(df).collect() if r.loss_start is not None]
    assert sorted(map(unescape, marked)) == ["", "<\\s> [INST]"]


def test_query_equals_plain_digests(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet")
            .select("conv_id", "turn", "role", "text").collect()]
    text = "</s>[INST] ok [/INST]"
    rows += [(-7, 0, "user", text), (-7, 1, "assistant", text)]
    conversations = {}
    for r in sorted(rows, key=lambda r: (r[0], r[1])):
        conversations.setdefault(r[0], []).append(r[2:])
    got = {r.conv_id: r for r in q_op10(spark, sf_dir).collect()}
    assert set(got) == set(conversations)
    for conv, turns in conversations.items():
        loss = "".join(t or "" for r, t in turns if r == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (
            len(turns), digest(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())
