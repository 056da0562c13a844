"""Symbols: exact navigation, enumeration, counts, and which definition holds what.

symbols has name, tag (def or ref), path, start_line, end_line, lang, content_type and, where known, signature, enclosing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import glob_pattern, matches_globs

DIMENSIONS = {"name": "name", "lang": "lang", "file": "path", "tag": "tag", "content": "content_type"}


def symbol_filter(symbols: DataFrame, pattern: str | None = None, tag: str | None = None, lang=None, content=None, include=None, exclude=None) -> DataFrame:
    """Rows by name glob, tag, languages, categories and path globs; what is None doesn't filter."""
    keep: Column = matches_globs(F.col("path"), include, exclude)
    if pattern is not None:
        keep = keep & F.col("name").rlike(glob_pattern(pattern))
    if tag is not None:
        keep = keep & (F.col("tag") == tag)
    if lang:
        keep = keep & F.col("lang").isin(*([lang] if isinstance(lang, str) else lang))
    if content:
        keep = keep & F.col("content_type").isin(*([content] if isinstance(content, str) else content))
    return symbols.where(keep)


def named(symbols: DataFrame, name: str, tag: str, lang=None) -> DataFrame:
    """All definitions or references of a name, by path and line."""
    return symbol_filter(symbols.where(F.col("name") == name), tag=tag, lang=lang).orderBy("path", "start_line", "end_line")


def symbol_counts(symbols: DataFrame, by: str, limit: int | None = None) -> DataFrame:
    """(key, count), most first, then by key."""
    if by not in DIMENSIONS:
        raise ValueError(f"count by {', '.join(DIMENSIONS)}, not {by}")
    out = symbols.groupBy(F.col(DIMENSIONS[by]).alias("key")).agg(F.count("*").alias("count")).orderBy(F.desc("count"), "key")
    return out.limit(limit) if limit is not None else out


def symbol_totals(symbols: DataFrame, by: str) -> DataFrame:
    """One row: distinct keys and rows, whatever a limit shows."""
    return symbols.agg(F.countDistinct(DIMENSIONS[by]).alias("groups"), F.count("*").alias("total"))


def innermost(refs: DataFrame, spans: DataFrame, group: str, at: str, first: str, last: str, ref_key: str, span_key: str) -> DataFrame:
    """Each reference with the smallest span of its group that holds it, or null; equal spans by key.

    The group's equality makes it an equi-join with the range as residual condition.
    """
    s = spans.select(F.col(group).alias("g"), F.col(span_key).alias("enclosing"), F.col(first).alias("f"), F.col(last).alias("l"))
    joined = refs.join(s, (refs[group] == s["g"]) & (s["f"] <= refs[at]) & (refs[at] <= s["l"]), "left")
    best = F.min(F.struct((F.col("l") - F.col("f")).alias("size"), F.col("enclosing"))).alias("best")
    held = joined.where("enclosing is not null").groupBy(ref_key).agg(best)
    return refs.join(held, ref_key, "left").withColumn("enclosing", F.col("best.enclosing")).drop("best")


def with_enclosing(symbols: DataFrame) -> DataFrame:
    """Adds enclosing_id and enclosing_line: the first definition of the enclosing name in the file whose span holds the symbol, or null.

    symbols (symbol_id, path, name, tag, start_line, end_line, enclosing); path and name are the equality of the join, the span its residual.
    """
    d = symbols.where("tag = 'def'").select(F.col("path").alias("p"), F.col("name").alias("n"), F.col("start_line").alias("f"), F.col("end_line").alias("l"), F.col("symbol_id").alias("s"))
    inside = symbols.where("enclosing is not null").select("symbol_id", "path", "enclosing", "start_line").distinct()
    held = inside.join(d, (F.col("path") == F.col("p")) & (F.col("enclosing") == F.col("n")) & F.col("start_line").between(F.col("f"), F.col("l")))
    first = held.groupBy("symbol_id").agg(F.min(F.struct("f", "l", "s")).alias("first"))
    return symbols.join(first, "symbol_id", "left").withColumns({"enclosing_id": F.col("first.s"), "enclosing_line": F.col("first.f")}).drop("first")


def exact_chunks(symbols: DataFrame, chunks: DataFrame, queries: DataFrame, key: str = "chunk_id") -> DataFrame:
    """The exact tier: (query_id, key, path, line) of chunks that define a name equal to the whole query.

    A chunk matches by its symbol, or a chunk without one by a span that holds the definition's line; path is the equality
    of the join and the alternative its residual condition.
    """
    asked = queries.select("query_id", F.trim("query").alias("name"))
    s = symbols.where(F.col("tag") == "def").join(asked, "name").select("query_id", F.col("path").alias("p"), "symbol_id", F.col("start_line").alias("at"))
    c = chunks.select(key, "path", F.col("symbol_id").alias("own"), "start_line", "end_line")
    holds = F.col("own").isNull() & F.col("at").between(F.col("start_line"), F.col("end_line"))
    joined = s.join(c, (s["p"] == c["path"]) & ((F.col("own") == F.col("symbol_id")) | holds))
    return joined.groupBy("query_id", key).agg(F.min("path").alias("path"), F.min("start_line").alias("line"))


def first_of(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("n = 1").drop("n")


def status(files: DataFrame, chunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """(what, n) for files, chunks and symbols."""
    count = lambda df, what: df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
    return count(files, "files").unionByName(count(chunks, "chunks")).unionByName(count(symbols, "symbols"))


def total_bytes(files: DataFrame) -> DataFrame:
    """(what, n) for the bytes of files with a size."""
    return files.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).select(F.lit("bytes").alias("what"), "n")


def top_values(rows: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    """(value, n) of a column, most first, then by value."""
    out = rows.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")
    return out.limit(limit) if limit is not None else out
