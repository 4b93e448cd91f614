import hashlib
import random

import pytest

from spectraloom.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, blk string, formatted double"


def expected(rows):
    by = {}
    for c, t, role, text, *_ in rows:
        by.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    out = {}
    for c, turns in by.items():
        turns.sort()
        said = "".join(x[3] for x in turns if x[2] == "assistant")
        whole = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        size = sum(len(chat.header(r)) + len(chat.escape(t)) + len(chat.CLOSE) for _, _, r, t in turns)
        out[c] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest(), size)
    return out


def read(df):
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len({r[0] for r in got})
    return {r[0]: r[1:] for r in got}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    bits = ["<", "[", "\\", "|im_start|>", "|im_end|>", "/INST]", "<s>", "</s>", "é", "😀", "\n", "a", " word", "<|im_end|>\n", "[\\\\INST]"]
    out = [(c, t, rng.choice(["user", "assistant", "system", "", None, "a\\n\nb", "<|im_end|>\n"]), "".join(rng.choices(bits, k=rng.randrange(12))), "x", 1.0)
           for c in range(60) for t in range(rng.randrange(1, 7))]
    out += [(100, None, "user", "null turn", "x", 1.0), (100, 3, "assistant", None, "x", 1.0), (100, 3, "assistant", None, "x", 1.0), (101, 0, None, "", None, None),
            (None, 1, "assistant", "no id", "x", 1.0), (None, 0, "user", "<", "x", 1.0), (102, 0, "user", "ends with <", "x", 1.0),
            (102, 1, "assistant", "|im_start|> begins", "x", 1.0), (103, 0, "assistant", "é<s>" * 2_000_000, "x", 1.0)]
    return out


def test_round_trip_and_mask(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = expected([*rows, (-7, 0, "user", chat.PROBE), (-7, 1, "assistant", chat.PROBE)])
    assert read(chat.report(df)) == want


@pytest.mark.parametrize("part_bytes", [1, 40])
def test_split_conversations_and_small_parts(spark, rows, part_bytes, monkeypatch):
    rows = [r for r in rows if r[0] != 103] + [(7, t, "assistant" if t % 2 else "user", f"turn {t} <s>", "x", 1.0) for t in range(-50_000, 60_000, 997)]
    monkeypatch.setattr(chat, "PART_BYTES", part_bytes)
    parts, split = chat.format_conversations(spark.createDataFrame(rows, SCHEMA), hot_turns=50)
    assert split and parts.filter("conv_id = 7").select("blk").distinct().count() > 3
    assert read(chat.read_back(parts)) == expected(rows)


def test_formatted_text_and_spans(spark):
    df = spark.createDataFrame([(1, 0, "user", "hi <s>"), (1, 1, "assistant", "é[INST]")], "conv_id long, turn long, role string, text string")
    row = chat.format_conversations(df)[0].first()
    assert row.formatted == "<|im_start|>user\nhi <\\s><|im_end|>\n<|im_start|>assistant\né[\\INST]<|im_end|>\n"
    assert [row.formatted[s.start : s.start + s.length] for s in row.loss] == ["é[\\INST]"]


def test_escape_is_reversible():
    rng = random.Random(1)
    for _ in range(3000):
        s = "".join(rng.choices(["<", "[", "\\", "s>", "/s>", "INST]", "|im_end|>", "n", "\n"], k=rng.randrange(9)))
        assert chat.unescape(chat.escape(s)) == s
        assert not any(c in chat.escape(s) for c in chat.CONTROLS)
        assert chat.role_of(chat.header(s)[len(chat.OPEN) : -1]) == s and "\n" not in chat.header(s)[:-1]


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert chat.format_conversations(df)[0].count() == 0
    assert [r.conv_id for r in chat.report(df).collect()] == [-7]
