"""Reranking as window expressions: coherence, definitions, stems, embedded symbols, penalties, saturation.

Candidates have query_id, query, a key, path, text and score; every function returns them with a new score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classify import path_penalty
from ..functions.text import directories, embedded_symbols, file_stem, is_symbol_query, split_identifier, stem_keywords, unqualified

#: Keywords that open a definition.
DEFINITION_WORDS = (
    "class", "module", "defmodule", "def", "interface", "struct", "enum", "trait", "type", "func", "function", "object", "abstract class",
    "data class", "fn", "fun", "package", "namespace", "protocol", "record", "typedef",
)
SQL_WORDS = ("CREATE TABLE", "CREATE VIEW", "CREATE PROCEDURE", "CREATE FUNCTION")
CANONICAL, EMBEDDED, LEAST_RATIO, LEAST_NAME = 1.5, 0.5, 0.10, 3
DIGITS = 6


def per_query(*more: str) -> Window:
    return Window.partitionBy("query_id", *more)


def defines(text: Column, name: Column) -> Column:
    """Whether a text declares a name: a keyword, white space, qualifiers, the name, and what may follow a name."""
    quoted = F.concat(F.lit(r"\Q"), F.replace(name, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    after = F.lit(r"(?:\s|[<({:\[;]|$)")
    general = F.concat(F.lit(r"(?md)(?:^|(?<=\s))(?:" + "|".join(DEFINITION_WORDS) + r")\s+(?:[A-Za-z_][A-Za-z0-9_]*(?:\.|::))*"), quoted, after)
    sql = F.concat(F.lit(r"(?mdi)(?:^|(?<=\s))(?:" + "|".join(SQL_WORDS) + r")\s+(?:[A-Za-z_][A-Za-z0-9_]*(?:\.|::))*"), quoted, after)
    return F.contains(text, name) & F.rlike(text, general) | F.contains(F.lower(text), F.lower(name)) & F.rlike(text, sql)


def stem_matches(stem: Column, name: Column) -> Column:
    """Whether a file's stem is a name, with or without underscores and a plural's s."""
    flat = F.replace(stem, F.lit("_"), F.lit(""))
    return (name == stem) | (name == flat) | (name == F.rtrim(stem, F.lit("s"))) | (name == F.rtrim(flat, F.lit("s")))


def coherence(cands: DataFrame, settings, key: str = "doc_id") -> DataFrame:
    """Adds to each file's best candidate in proportion to the file's sum."""
    total = F.sum("score").over(per_query("path"))
    top, most = F.max("score").over(per_query()), F.max("file_sum").over(per_query())
    best = F.row_number().over(per_query("path").orderBy(F.desc("score"), key))
    out = cands.withColumn("file_sum", total).withColumn("best", best)
    gain = top * settings.file_coherence * F.col("file_sum") / most
    return out.withColumn("score", F.round(F.col("score") + F.when((F.col("best") == 1) & (top > 0) & (most > 0), gain).otherwise(0.0), DIGITS)).drop("file_sum", "best")


def bonus(text: Column, path: Column, names: Column, unit: Column) -> Column:
    """The unit, half again for a file named for the symbol, if the text defines any of the names; else 0."""
    stem = F.lower(file_stem(path))
    named = F.exists(names, lambda n: stem_matches(stem, F.lower(n)))
    return F.when(F.exists(names, lambda n: defines(text, n)), unit * F.when(named, CANONICAL).otherwise(1.0)).otherwise(0.0)


def query_names(query: Column) -> Column:
    """The names a query asks definitions for: itself and unqualified if it is a symbol, else those inside it."""
    whole = F.trim(query)
    return F.when(is_symbol_query(query), F.array_distinct(F.array(unqualified(whole), whole))).otherwise(embedded_symbols(query))


def count_matches(words: Column, parts: Column) -> Column:
    """Words that are a part, and other words that share a beginning of three letters with one, each once."""
    begins = lambda a, b: F.startswith(a, b) & (F.length(b) >= 3)
    return F.size(F.filter(words, lambda w: F.exists(parts, lambda p: (w == p) | begins(w, p) | begins(p, w))))


def path_parts(path: Column) -> Column:
    parents = F.filter(directories(path), lambda d: d != "..")
    parent = F.get(parents, F.size(parents) - 1)
    return F.array_union(split_identifier(file_stem(path)), F.when(parent.isNotNull(), split_identifier(parent)).otherwise(F.array().cast("array<string>")))


def stem_gain(query: Column, path: Column, top: Column, settings) -> Column:
    words = stem_keywords(query)
    ratio = count_matches(words, path_parts(path)) / F.size(words)
    return F.when((F.size(words) > 0) & (ratio >= LEAST_RATIO), top * settings.stem_boost * ratio).otherwise(0.0)


def query_boosts(cands: DataFrame, settings) -> DataFrame:
    """Definitions for a symbol query; else stems, then definitions of embedded symbols at half strength.

    A query may have every row as a candidate, so no text is dealt by query: the best scores, a number a query, are broadcast.
    """
    tops = cands.groupBy(F.col("query_id").alias("query of top")).agg(F.max("score").alias("top"))
    symbol = is_symbol_query(F.col("query"))
    unit = F.col("top") * settings.definition_boost * F.when(symbol, 1.0).otherwise(EMBEDDED)
    out = cands.join(F.broadcast(tops), F.col("query_id").eqNullSafe(F.col("query of top")), "left").drop("query of top")
    gain = bonus(F.col("text"), F.col("path"), query_names(F.col("query")), unit) + F.when(symbol, 0.0).otherwise(stem_gain(F.col("query"), F.col("path"), F.col("top"), settings))
    return out.withColumn("score", F.round(F.col("score") + F.when(F.col("top") > 0, gain).otherwise(0.0), DIGITS)).drop("top")


def injected(cands: DataFrame, corpus: DataFrame, settings, key: str = "doc_id", most: int | None = None) -> DataFrame:
    """Candidates that no tier found: rows whose path holds a queried name and whose text defines it; their score is the bonus.

    The names of the queries are few and are broadcast only under Spark's threshold; rows are tested for the path before
    their text is read. `most` bounds them per query by path and key, all by default.
    """
    top = cands.groupBy("query_id", "query").agg(F.max("score").alias("top")).where("top > 0")
    names = top.select("query_id", "query", "top", F.explode(query_names(F.col("query"))).alias("name")).where(F.length("name") >= LEAST_NAME)
    rows = corpus.select(key, "path", "text")
    hits = rows.join(names, F.contains(F.lower(rows["path"]), F.lower(names["name"]))).groupBy("query_id", "query", "top", key).agg(F.first("path").alias("path"), F.first("text").alias("text"))
    fresh = hits.join(cands.select("query_id", key), ["query_id", key], "left_anti")
    unit = F.col("top") * settings.definition_boost * F.when(is_symbol_query(F.col("query")), 1.0).otherwise(EMBEDDED)
    scored = fresh.withColumn("score", F.round(bonus(F.col("text"), F.col("path"), query_names(F.col("query")), unit), DIGITS)).where("score > 0")
    if most is not None:
        scored = scored.withColumn("n", F.row_number().over(per_query().orderBy("path", key))).where(F.col("n") <= most).drop("n")
    return scored.select("query_id", "query", key, "path", "text", "score")


def penalised(cands: DataFrame) -> DataFrame:
    return cands.withColumn("score", F.round(F.col("score") * path_penalty(F.col("path")), DIGITS))


def saturated(cands: DataFrame, settings, limit: int, key: str = "doc_id") -> DataFrame:
    """The best `limit` of each query, each halved (decay) for every better one of its file or of its text.

    An empty text repeats nothing. Equal scores are taken by key; the greedy walk of a pool with exact ties may stop
    before a tied row with a smaller key, which this form keeps.
    """
    order = (F.desc("score"), F.col(key))
    in_file = F.row_number().over(per_query("path").orderBy(*order)) - 1
    same = F.row_number().over(per_query("text").orderBy(*order)) - 1
    repeats = F.when(F.coalesce(F.length("text"), F.lit(0)) > 0, same).otherwise(0)
    out = cands.withColumn("score", F.round(F.col("score") * F.pow(F.lit(settings.saturation_decay), in_file + repeats), DIGITS))
    return out.withColumn("rank", F.row_number().over(per_query().orderBy(*order))).where(F.col("rank") <= limit)


def rerank(cands: DataFrame, settings, limit: int, corpus: DataFrame | None = None, penalise: bool = True, key: str = "doc_id") -> DataFrame:
    """coherence, query boosts with injection from corpus, penalties, saturation; scores end between 0 and 1."""
    coherent = coherence(cands.select("query_id", "query", key, "path", "text", "score"), settings, key)
    boosted = query_boosts(coherent, settings)
    if corpus is not None:
        boosted = boosted.unionByName(injected(coherent, corpus, settings, key))
    chosen = saturated(penalised(boosted) if penalise else boosted, settings, limit, key)
    top = F.max("score").over(per_query())
    return chosen.withColumn("score", F.round(F.col("score") / F.when(top == 0, 1.0).otherwise(top), DIGITS))
