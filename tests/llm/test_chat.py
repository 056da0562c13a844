"""op4: round trips over random parts, nulls, repeated turns, long conversations."""

import random

from pyspark.sql import functions as F

from tessera.llm import chat

HARD = ["</s>[INST] ok [/INST]", "<|end|><|start|>x<|body|>", "<\\|end|>", "[\\\\INST]", "<<SYS>>", "<</SYS>>", "<s>", "</s>", None, ""]
SCHEMA = f"conv_id long, turn long, role string, parts array<{chat.PART}>"


def brute(parts):
    """The text of a turn with placeholders, its attachments, and its runs of text."""
    out, attached, runs, open_ = "", [], [], False
    for kind, text, ref, units in parts or []:
        if (kind or "text") == "text":
            out += text or ""
            runs = [*runs[:-1], runs[-1] + (text or "")] if open_ else [*runs, text or ""]
        else:
            name = kind if kind in ("image", "audio") else "document"
            out += f"<|{name}|>"
            attached.append((kind, ref, chat.TOKENS_PER_UNIT[name] * (units or 0)))
        open_ = (kind or "text") == "text"
    return out, attached, runs


def back(spark, rows):
    turns = spark.createDataFrame(rows, SCHEMA).repartition(4)
    out = chat.assembled(chat.format_blocks(turns)).select("*", chat.read_turns(F.col("formatted")).alias("back"))
    unescaped = F.transform("loss_spans", lambda s: chat.unescaped(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["size"].cast("int"))))
    return {r.conv_id: r for r in out.withColumn("loss", unescaped).collect()}


def test_random_parts_round_trip(spark):
    rng = random.Random(6)
    bits = [*"<|[]/\\s>e", "<|", "|>", "end", "start", "body", "INST]", "/INST]", "SYS>>", "<<", "\\", "|end|>", "|start|>", "|body|>", "image|>", "é", "\U0001F600", "\n", ""]
    text = lambda: rng.choice([None, *HARD, "".join(rng.choice(bits) for _ in range(rng.randrange(9)))])
    part = lambda: ("text" if rng.random() < 0.8 else None, text(), None, 0) if rng.random() < 0.8 else (rng.choice(["image", "audio", "document", "film"]), None, rng.choice([None, "r1"]), rng.choice([None, 0, 3]))
    rows = [(c, t, rng.choice(["user", "assistant", "assistant", "<|end|>", "[INST]"]), [part() for _ in range(rng.randrange(12))]) for c in range(60) for t in range(rng.randrange(1, 6))]
    got = back(spark, rows)
    for c in range(60):
        mine = [r for r in rows if r[0] == c]
        r, want = got[c], [brute(parts) for *_, parts in mine]
        assert [(t.role, t.text) for t in r.back] == [(row[2], w[0]) for row, w in zip(mine, want, strict=True)]
        assert [(a.kind, a.ref, a.tokens) for a in r.attachments] == [a for w in want for a in w[1]] and r.expanded_tokens == sum(a[2] for w in want for a in w[1])
        assert r.loss == [x for row, w in zip(mine, want, strict=True) if row[2] == "assistant" for x in w[2]]
        assert r.n_turns == len(mine) and r.n_chars == len(r.formatted)


def test_control_strings_from_several_parts(spark):
    for cut in ("<", "|end|>"), ("<", "", "|", "end|>"), ("<", "\\|x"), ("[", "/INST]"), ("<", "/s>"), ("<<", "SYS>>"):
        got = back(spark, [(1, 0, "user", [("text", x, None, 0) for x in cut]), (1, 1, "assistant", None)])[1]
        assert [t.text for t in got.back] == ["".join(cut), ""] and got.formatted.count("<|end|>") == 2


def test_nulls_repeats_and_order(spark):
    part = lambda t: [("text", t, None, 0)]
    rows = [(1, 2, "user", part("b")), (1, 2, "user", part("b")), (1, None, "user", part("first")), (1, 1, None, None), (None, 1, "assistant", part("x")), (2, 5, "assistant", part(None))]
    got = back(spark, rows)
    assert [(t.role, t.text) for t in got[1].back] == [("user", "first"), ("", ""), ("user", "b"), ("user", "b")]
    assert [t.text for t in got[None].back] == ["x"] and got[None].loss == ["x"] and got[2].loss == [""]
    assert chat.format_blocks(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_conversation_and_long_text(spark):
    rows = [(1, t, "assistant", [("text", f"{t}<|end|>", None, 0)]) for t in range(1000)] + [(2, 7, "assistant", [("text", "<|end|>" * 30_000, None, 0), *([("image", None, "i", 1), ("text", "y", None, 0)] * 2000)])]
    got = back(spark, rows)
    assert [t.text for t in got[1].back] == [f"{t}<|end|>" for t in range(1000)] and got[1].loss == [f"{t}<|end|>" for t in range(1000)]
    assert got[2].loss[0] == "<|end|>" * 30_000 and len(got[2].loss) == 2001 and got[2].expanded_tokens == 2000 * 256


def test_clashing_columns(spark):
    turns = spark.createDataFrame([(1, 0, "user", [("text", "a", None, 0)], "x", 3)], SCHEMA + ", pieces string, block int")
    assert chat.format_blocks(turns).first().formatted == "<|start|>user<|body|>a<|end|>"
