"""Chat formatting: typed content parts flattened to text with ordered placeholders, a loss mask and attachments.

A visitor handles each part by its kind: text is escaped, an image, audio or document part becomes a placeholder
whose reference and expanded token count are recorded in order. Text parts that follow each other are one run of text and
are escaped together, so that no control string can be put together from several parts. A turn reads
``<|start|>role<|body|>parts<|end|>``. Control strings inside texts get one backslash after their first character
(one more if they have some already), so escaping is reversible and no text can open or close a turn.

Turns are formatted in blocks of BLOCK_TURNS turn numbers, so that a very long conversation is spread over tasks;
assembled() puts the blocks of a conversation together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound, running, table

BLOCK_TURNS = 64
START, BODY, END = "<|start|>", "<|body|>", "<|end|>"
#: Control strings: anything that opens like one of ours, and those of other common templates.
CONTROL = r"(\||/?s>|/?INST\]|</?SYS>>)"
#: Tokens that a unit of each kind stands for: an image tile, a second of audio, a page of a document.
TOKENS_PER_UNIT = {"image": 256, "audio": 25, "document": 512}
PART = "struct<kind:string,text:string,ref:string,units:bigint>"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(<|\[)(\\*)" + CONTROL, r"$1$2\\$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(<|\[)\\(\\*)" + CONTROL, r"$1$2$3")


def text_parts(text: Column) -> Column:
    """A message that is one text part."""
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(0).cast("bigint").alias("units"))).cast(f"array<{PART}>")


def visited(part: Column) -> Column:
    """What a part becomes in the text: a null kind is text, an unknown kind a document."""
    kind = F.coalesce(part["kind"], F.lit("text"))
    shown = F.when(kind == "text", escaped(F.coalesce(part["text"], F.lit(""))))
    for name in ("image", "audio"):
        shown = shown.when(kind == name, F.lit(f"<|{name}|>"))
    units = F.coalesce(part["units"], F.lit(0))
    tokens = F.when(kind == "text", F.lit(0).cast("bigint"))
    for name in ("image", "audio"):
        tokens = tokens.when(kind == name, units * TOKENS_PER_UNIT[name])
    return F.struct(
        shown.otherwise(F.lit("<|document|>")).alias("shown"),
        (kind == "text").alias("is_text"),
        kind.alias("kind"),
        part["ref"].alias("ref"),
        tokens.otherwise(units * TOKENS_PER_UNIT["document"]).alias("tokens"),
    )


def runs(parts: Column) -> Column:
    """Parts with those of text that follow each other joined: what each run becomes in the text, in order."""
    plain = F.transform(parts, lambda p: p.withField("kind", F.coalesce(p["kind"], F.lit("text"))))

    def grouped(all_: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(all_) - 1), lambda i: (i == 0) | (F.get(all_, i)["kind"] != "text") | (F.coalesce(F.get(all_, i - 1)["kind"], F.lit("")) != "text"))
        ends = lambda s: F.concat(F.slice(s, F.lit(2), F.size(s)), F.array(F.size(all_)))
        run = lambda a, b: F.slice(all_, a + 1, b - a)
        text = lambda r: F.array_join(F.transform(r, lambda p: F.coalesce(p["text"], F.lit(""))), "")
        joined = lambda r: bound(r, lambda x: F.get(x, 0).withField("text", text(x)))
        return bound(starts, lambda s: F.zip_with(s, ends(s), lambda a, b: visited(joined(run(a, b)))))

    kinds = "array<struct<shown:string,is_text:boolean,kind:string,ref:string,tokens:bigint>>"
    return F.when(F.size(parts) > 0, bound(plain, grouped)).otherwise(F.array().cast(kinds))


def format_blocks(turns: DataFrame, trained_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Rows (conv_id, turn, role, parts) to rows (conv_id, block, n_turns, formatted, n_chars, loss_spans, attachments).

    loss_spans holds (start, size) in code points of formatted, one for each run of text of a trained role, in order.
    attachments holds (kind, ref, tokens) in the order of their placeholders. Turns are in the order of turn, nulls first;
    equal turn numbers and repeated rows all stay, by role and parts. A null role, text or parts array counts as
    empty; a null conv_id is a conversation of its own. Other columns are ignored. No rows give no rows.
    """
    size = lambda c: F.length(c).cast("bigint")
    role = F.coalesce(F.col("role"), F.lit(""))
    visits = runs(F.coalesce(F.col("parts"), F.array().cast(f"array<{PART}>")))
    head = F.concat(F.lit(START), escaped(role), F.lit(BODY))
    turn = turns.select("conv_id", "turn", role.alias("role"), "parts").select(
        "conv_id",
        F.floor(F.col("turn") / BLOCK_TURNS).alias("block"),
        F.struct("turn", "role", head.alias("head"), visits.alias("visits"), role.isin(*trained_roles).alias("trained")).alias("t"),
    )
    blocks = turn.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    piece = "struct<text:string,is_loss:boolean>"
    pieces = F.flatten(
        F.transform(
            "ts",
            lambda t: F.concat(
                F.array(F.struct(t["head"].alias("text"), F.lit(False).alias("is_loss"))).cast(f"array<{piece}>"),
                F.transform(t["visits"], lambda v: F.struct(v["shown"].alias("text"), (t["trained"] & v["is_text"]).alias("is_loss"))).cast(f"array<{piece}>"),
                F.array(F.struct(F.lit(END).alias("text"), F.lit(False).alias("is_loss"))).cast(f"array<{piece}>"),
            ),
        )
    )
    before = running(F.transform("pieces", lambda p: size(p["text"])), lambda a, b: a + b, F.lit(0).cast("bigint"))
    starts = F.zip_with("pieces", before, lambda p, at: F.struct(p["is_loss"].alias("is_loss"), at.alias("start"), size(p["text"]).alias("size")))
    spans = F.transform(F.filter(starts, lambda x: x["is_loss"]), lambda x: F.struct(x["start"].alias("start"), x["size"].alias("size")))
    attached = F.transform(F.filter(F.flatten(F.transform("ts", lambda t: t["visits"])), lambda v: ~v["is_text"]), lambda v: F.struct(v["kind"].alias("kind"), v["ref"].alias("ref"), v["tokens"].alias("tokens")))
    return (
        blocks.withColumn("pieces", pieces)
        .withColumn("formatted", F.array_join(F.transform("pieces", lambda p: p["text"]), ""))
        .select(
            "conv_id",
            "block",
            F.size("ts").cast("bigint").alias("n_turns"),
            "formatted",
            size(F.col("formatted")).alias("n_chars"),
            spans.alias("loss_spans"),
            attached.alias("attachments"),
        )
    )


def assembled(blocks: DataFrame) -> DataFrame:
    """Rows of format_blocks() to one row for each conversation, with loss_spans over the whole text and expanded_tokens.

    The whole text of a conversation is one value here, by the nature of the result.
    """
    gathered = blocks.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("block", "n_turns", "formatted", "n_chars", "loss_spans", "attachments"))).alias("bs"))
    ats = running(F.transform("bs", lambda b: b["n_chars"]), lambda a, b: a + b, F.lit(0).cast("bigint"))
    moved = F.flatten(F.zip_with("bs", ats, lambda b, at: F.transform(b["loss_spans"], lambda x: F.struct((x["start"] + at).alias("start"), x["size"].alias("size")))))
    return gathered.select(
        "conv_id",
        F.aggregate("bs", F.lit(0).cast("bigint"), lambda s, b: s + b["n_turns"]).alias("n_turns"),
        F.array_join(F.transform("bs", lambda b: b["formatted"]), "").alias("formatted"),
        F.aggregate("bs", F.lit(0).cast("bigint"), lambda s, b: s + b["n_chars"]).alias("n_chars"),
        moved.alias("loss_spans"),
        F.flatten(F.transform("bs", lambda b: b["attachments"])).alias("attachments"),
        F.aggregate(F.flatten(F.transform("bs", lambda b: b["attachments"])), F.lit(0).cast("bigint"), lambda s, a: s + a["tokens"]).alias("expanded_tokens"),
    )


def read_turns(formatted: Column) -> Column:
    """Reads formatted text back into an array of (role, text); placeholders stay in the text."""
    turns = F.split(formatted, r"<\|end\|>", -1)
    fields = F.transform(F.slice(turns, 1, F.size(turns) - 1), lambda t: F.split(t, r"<\|body\|>", -1))
    return F.transform(fields, lambda f: F.struct(unescaped(F.substring(f[0], F.lit(len(START) + 1), F.length(f[0]))).alias("role"), unescaped(f[1]).alias("text")))


def op4_chat(spark, sf_dir: str) -> DataFrame:
    """All conversations and conversation -1, formatted by format_blocks() and read back block by block."""
    columns = ["conv_id", "turn", "role", "text"]
    own = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text")
    )
    turns = table(spark, sf_dir, "conversations").select(*columns).unionByName(own)
    blocks = format_blocks(turns.select("conv_id", "turn", "role", text_parts(F.col("text")).alias("parts")))
    loss = F.transform("loss_spans", lambda s: unescaped(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["size"].cast("int"))))
    read = blocks.select(
        "conv_id",
        F.struct(
            "block",
            F.array_join(F.transform(read_turns(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("turns"),
            F.array_join(loss, "").alias("loss"),
        ).alias("b"),
        F.size(read_turns(F.col("formatted"))).cast("bigint").alias("n_turns"),
        F.length("formatted").cast("bigint").alias("n_chars"),
    )
    whole = read.groupBy("conv_id").agg(F.sort_array(F.collect_list("b")).alias("bs"), F.sum("n_turns").alias("n_turns"), F.sum("n_chars").alias("formatted_chars"))
    joined = lambda name: F.array_join(F.transform("bs", lambda b: b[name]), "")
    return whole.select(
        "conv_id",
        "n_turns",
        F.sha2(joined("turns"), 256).alias("turns_sha256"),
        F.length(joined("loss")).cast("bigint").alias("loss_chars"),
        F.sha2(joined("loss"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


OP4_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, length(regexp_replace(role, '(<|\[)(\\*)(\||/?s>|/?INST\]|</?SYS>>)', '\1\2\\\3', 'g'))
          + length(regexp_replace(text, '(<|\[)(\\*)(\||/?s>|/?INST\]|</?SYS>>)', '\1\2\\\3', 'g'))
          + length('<|start|><|body|><|end|>') AS shown
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(shown) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""
