"""Chunks of text: line windows, oversize pieces, heading sections, definition slices, hybrid coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import opening_line
from ..settings import MAX_CHUNK_CHARS, MIN_CHUNK_CHARS

SPAN = "struct<first:int,last:int,bytes:bigint>"
#: Bytes, as ISO-8859-1, of a UTF-8 character whose beginning or end a cut has taken.
HALVED = r"^[\x80-\xBF]+|(?:[\xC0-\xFF]|[\xE0-\xFF][\x80-\xBF]|[\xF0-\xFF][\x80-\xBF]{2})\z"


def lines_of(text: Column) -> Column:
    """Lines with their newline, the rest after the last one too if not empty."""
    pieces = F.split(text, "\n", -1)
    ended = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda x: F.concat(x, F.lit("\n")))
    last = F.element_at(pieces, -1)
    return F.when(last == "", ended).otherwise(F.concat(ended, F.array(last)))


def window_spans(lines: Column, target: int) -> Column:
    """Spans (first, last line from 1, bytes): a window ends with the newline that brings it to the target."""
    start = F.struct(F.array().cast(f"array<{SPAN}>").alias("done"), F.lit(1).alias("first"), F.lit(0).alias("last"), F.lit(0).cast("bigint").alias("bytes"))

    def step(s: Column, line: Column) -> Column:
        last, held = s["last"] + 1, s["bytes"] + F.octet_length(line)
        closed = (held >= target) & F.endswith(line, F.lit("\n"))
        span = F.array(F.struct(s["first"].alias("first"), last.alias("last"), held.alias("bytes")))
        return F.struct(
            F.when(closed, F.concat(s["done"], span)).otherwise(s["done"]).alias("done"),
            F.when(closed, last + 1).otherwise(s["first"]).alias("first"),
            last.alias("last"),
            F.when(closed, F.lit(0).cast("bigint")).otherwise(held).alias("bytes"),
        )

    rest = lambda s: F.when(s["bytes"] > 0, F.concat(s["done"], F.array(F.struct(s["first"].alias("first"), s["last"].alias("last"), s["bytes"].alias("bytes"))))).otherwise(s["done"])
    return F.aggregate(lines, start, step, rest)


def line_windows(corpus: DataFrame, target: int = 750, key: str = "doc_id", least: int = MIN_CHUNK_CHARS) -> DataFrame:
    """(key, start_line, end_line, text): windows of whole lines over each text; those under `least` characters, trimmed, go."""
    cut = corpus.select(key, lines_of(F.col("text")).alias("lines")).withColumn("span", F.explode(window_spans(F.col("lines"), target)))
    text = F.array_join(F.slice("lines", F.col("span.first"), F.col("span.last") - F.col("span.first") + 1), "")
    out = cut.select(key, F.col("span.first").alias("start_line"), F.col("span.last").alias("end_line"), text.alias("text"))
    return out.where(F.length(F.regexp_replace("text", r"^[ \t\n\r]+|[ \t\n\r]+$", "")) >= least)


def bounded(spans: DataFrame, most: int = MAX_CHUNK_CHARS, text: str = "text") -> DataFrame:
    """Texts cut into pieces of at most so many bytes, with piece numbers from 0; characters that a cut halves go."""
    pieces = F.ceil(F.octet_length(text) / most).cast("int")
    numbered = spans.withColumn("piece", F.explode(F.sequence(F.lit(0), F.greatest(pieces, F.lit(1)) - 1)))
    data = F.substring(F.col(text).cast("binary"), F.col("piece") * most + 1, F.lit(most))
    whole = F.regexp_replace(F.decode(data, "ISO-8859-1"), HALVED, "")  # one character a byte
    return numbered.withColumn(text, F.decode(F.encode(whole, "ISO-8859-1"), "UTF-8"))


def sections(corpus: DataFrame, is_heading: Column, key: str = "doc_id") -> DataFrame:
    """(key, name, start_line, end_line): each heading line and what follows up to the next; `line` and `n` are for is_heading."""
    lines = corpus.select(key, F.posexplode(F.split("text", "\n", -1)).alias("n", "line")).withColumn("n", F.col("n") + 1)
    by = Window.partitionBy(key).orderBy("n")
    last = Window.partitionBy(key)
    heads = lines.withColumn("total", F.max("n").over(last)).where(is_heading)
    return heads.select(key, F.col("line").alias("name"), F.col("n").alias("start_line"), (F.coalesce(F.lead("n").over(by), F.col("total") + 1) - 1).alias("end_line"))


def definition_chunks(definitions: DataFrame, corpus: DataFrame, max_lines: int = 200, key: str = "doc_id") -> DataFrame:
    """(key, name, start_line, end_line, text): definitions cut at max_lines; texts too short or too long are no chunks."""
    lines = corpus.select(key, F.split("text", "\n", -1).alias("lines"))
    end = F.least("end_line", F.col("start_line") + max_lines - 1)
    cut = definitions.select(key, "name", "start_line", end.alias("end_line")).join(lines, key)
    text = F.array_join(F.slice("lines", F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n")
    return cut.select(key, "name", "start_line", "end_line", text.alias("text")).where(F.length("text").between(MIN_CHUNK_CHARS, MAX_CHUNK_CHARS))


def hybrid(definitions: DataFrame, windows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Definition chunks and the windows of which at least half the lines lie in none; windows have the empty name."""
    covered = definitions.groupBy(key).agg(F.collect_list(F.struct("start_line", "end_line")).alias("spans"))
    owned = F.aggregate(
        "spans",
        F.array().cast("array<int>"),
        lambda all_, s: F.array_union(all_, F.sequence(F.greatest(s["start_line"], F.col("start_line")), F.least(s["end_line"], F.col("end_line")))),
    )
    touching = F.filter("spans", lambda s: (s["start_line"] <= F.col("end_line")) & (s["end_line"] >= F.col("start_line")))
    span = F.col("end_line") - F.col("start_line") + 1
    kept = windows.join(covered, key, "left").withColumn("spans", F.coalesce(touching, F.array().cast("array<struct<start_line:int,end_line:int>>")))
    kept = kept.where((span - F.size(owned)) * 2 >= span)
    return definitions.select(key, "name", "start_line", "end_line", "text").unionByName(kept.select(key, F.lit("").alias("name"), "start_line", "end_line", "text"))


def leading_comments(lines: Column, start: Column, look_back: int = 6) -> Column:
    """Comment lines right above a line, at most so many."""
    above = F.reverse(F.slice(lines, F.greatest(F.lit(1), start - look_back), F.least(start - 1, F.lit(look_back))))
    stop = F.array_position(F.transform(above, lambda x: (~F.trim(x).rlike(r"^(?:#|//|/\*|\*|--|;|@)")).cast("int")), 1)
    return F.reverse(F.slice(above, F.lit(1), F.when(stop > 0, stop - 1).otherwise(F.size(above)).cast("int")))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def window_signature(text: Column) -> Column:
    return opening_line(text)
