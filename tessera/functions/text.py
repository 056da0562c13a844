"""Text functions as columns: identifiers, query shapes, globs, rendered text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns of words and identifiers, and words without meaning for retrieval.
WORD_RUNS = r"[A-Z]+(?![a-z])|[A-Z][a-z]+|[a-z]+|[0-9]+"
CAMEL_RUNS = r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|[0-9]+"
LETTER_RUNS = r"[A-Z]+(?![a-z])|[A-Z][a-z]+|[a-z]+"
IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_]*"
LONG_IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_]{2,}"
QUERY_STOP_WORDS = (
    "how does do the where is are in to a an of and with it we for from on this that what when which work works done use used app".split()
)
STEM_STOP_WORDS = "a an and are as at be by do does for from has have how if in is it not of on or the to was what when where which who why with".split()
SYMBOL_QUERY = r"^(?:[A-Za-z_][A-Za-z0-9_]*(?:(?:::|\\|->|\.)[A-Za-z_][A-Za-z0-9_]*)+|_[A-Za-z0-9_]*|[A-Za-z][A-Za-z0-9]*[A-Z_][A-Za-z0-9_]*|[A-Z][A-Za-z0-9]*)$"
EMBEDDED_SYMBOL = r"\b(?:[A-Z][a-z][a-zA-Z0-9]*[A-Z][a-zA-Z0-9]*|[a-z][a-zA-Z0-9]*[A-Z][a-zA-Z0-9]+)\b"
QUALIFIERS = ("::", "\\", "->", ".")
INDEX_TOKEN = r"[\p{L}\p{N}]+"
BETWEEN_TOKENS = r"[^\p{L}\p{N}]+"
IDENTIFIER_CAP = 25


def found(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def humanise(text: Column) -> Column:
    """Words of identifiers and paths, a blank between."""
    return F.array_join(found(F.translate(text, "/.", "  "), WORD_RUNS), " ")


def parts(identifier: Column, pattern: str = CAMEL_RUNS) -> Column:
    """Lower-case parts of a snake_case or camelCase identifier."""
    snake = F.filter(F.split(F.lower(identifier), "_"), lambda p: p != "")
    camel = F.transform(found(identifier, pattern), lambda p: F.lower(p))
    return F.when(F.contains(identifier, F.lit("_")), snake).otherwise(camel)


def split_identifier(identifier: Column) -> Column:
    """The lower-case identifier, then its parts if there are two or more."""
    whole = F.array(F.lower(identifier))
    return F.when(F.size(parts(identifier)) >= 2, F.concat(whole, parts(identifier))).otherwise(whole)


def tokenize(text: Column) -> Column:
    """split_identifier() of every identifier in turn."""
    return F.flatten(F.transform(found(text, IDENTIFIER), split_identifier))


def tokenize_query(query: Column) -> Column:
    """Content words of a query: identifiers of over two letters and their parts, without stop words.

    Whole identifiers repeat as they do in the query; a part is added only if no word before equals it.
    """
    content = lambda w: (F.length(w) > 2) & ~w.isin(*QUERY_STOP_WORDS)
    empty = F.array().cast("array<string>")

    def step(words: Column, raw: Column) -> Column:
        low = F.lower(raw)
        first = F.when(content(low), F.concat(words, F.array(low))).otherwise(words)
        more = F.array_distinct(F.filter(F.transform(found(raw, LETTER_RUNS), lambda p: F.lower(p)), content))
        return F.concat(first, F.filter(more, lambda p: ~F.array_contains(first, p)))

    return F.aggregate(found(query, IDENTIFIER), empty, step)


def stem_keywords(query: Column) -> Column:
    """Distinct lower-case identifiers of over two letters, without stop words."""
    low = F.transform(F.filter(found(query, IDENTIFIER), lambda w: F.length(w) > 2), lambda w: F.lower(w))
    return F.array_distinct(F.filter(low, lambda w: ~w.isin(*STEM_STOP_WORDS)))


def is_symbol_query(query: Column) -> Column:
    return F.trim(query).rlike(SYMBOL_QUERY)


def looks_like_prose(query: Column, min_words: int) -> Column:
    return F.regexp_count(query, F.lit(IDENTIFIER)) >= min_words


def unqualified(name: Column) -> Column:
    """What follows the last of the first qualifier that occurs."""
    out = F.when(F.lit(False), name)
    for separator in QUALIFIERS:
        out = out.when(F.contains(name, F.lit(separator)), F.substring_index(name, separator, -1))
    return out.otherwise(name)


def embedded_symbols(query: Column) -> Column:
    """Distinct camelCase and PascalCase words of a query."""
    return F.array_distinct(found(query, EMBEDDED_SYMBOL))


def glob_pattern(glob: str) -> str:
    """A glob as an anchored pattern: * and ? cross slashes, [...] is a class, ^ or ! negates it."""
    out, k = [], 0
    while k < len(glob):
        c = glob[k]
        end = glob.find("]", k + 2) if c == "[" else -1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and end > 0:
            body = glob[k + 1 : end]
            negate = body[:1] in ("^", "!")
            out.append("[" + "^" * negate + body[negate:].replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&") + "]")
            k = end
        else:
            out.append(re.escape(c) if not c.isalnum() and c != "_" else c)
        k += 1
    return "(?s)^" + "".join(out) + "$"


def matches_globs(path: Column, include: list[str] | None = None, exclude: list[str] | None = None) -> Column:
    """Whether a path matches any include (none given: all) and no exclude."""
    keep = F.lit(True)
    if include:
        keep = F.lit(False)
        for glob in include:
            keep = keep | path.rlike(glob_pattern(glob))
    for glob in exclude or ():
        keep = keep & ~path.rlike(glob_pattern(glob))
    return keep


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def file_stem(path: Column) -> Column:
    """The last segment without its last suffix; a leading dot starts no suffix."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def directories(path: Column) -> Column:
    return F.filter(F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1), lambda d: (d != "") & (d != "."))


def enriched(path: Column, body: Column) -> Column:
    """The body, the stem twice and the last three directories."""
    dirs = directories(path)
    last = F.slice(dirs, F.greatest(F.lit(1), F.size(dirs) - 2), 3)
    return F.concat_ws(" ", body, file_stem(path), file_stem(path), F.array_join(last, " "))


def split_inline(text: Column) -> Column:
    """Every compound identifier followed by its parts of over two letters."""
    words = F.transform(found(text, LONG_IDENTIFIER), lambda w: F.struct(w.alias("w"), parts(w).alias("p")))
    more = lambda x: F.concat(x["w"], F.lit(" "), F.array_join(F.filter(x["p"], lambda p: F.length(p) > 2), " "))
    grown = F.transform(words, lambda x: F.when(F.size(x["p"]) >= 2, more(x)).otherwise(x["w"]))
    gaps = F.split(text, LONG_IDENTIFIER, -1)
    return F.array_join(F.zip_with(gaps, grown, lambda g, w: F.concat(g, F.coalesce(w, F.lit("")))), "")


def compound_parts(text: Column) -> Column:
    """Distinct parts (over two letters) of all compound identifiers, a blank between."""
    compound = F.filter(F.transform(F.array_distinct(found(text, LONG_IDENTIFIER)), parts), lambda p: F.size(p) >= 2)
    return F.array_join(F.array_distinct(F.filter(F.flatten(compound), lambda p: F.length(p) > 2)), " ")


def lexical(path: Column, body: Column, settings) -> Column:
    """The text that keyword search reads: path words and body, as the settings cap, enrich or split it."""
    body = F.substring(body, 1, settings.lexical_cap_chars) if settings.lexical_mode == "capped" else body
    out = enriched(path, body) if settings.lexical_enrich else F.concat(humanise(path), F.lit("\n"), body)
    if settings.split_identifiers == "inline":
        return split_inline(out)
    return F.concat(out, F.lit("\n"), compound_parts(out)) if settings.split_identifiers == "append" else out


def lexical_override(path: Column, body: Column, settings) -> Column:
    """lexical() where it differs from the default rendering, else null."""
    return F.nullif(lexical(path, body, settings), F.concat(humanise(path), F.lit("\n"), body))


def distilled(path: Column, kind: Column, comments: Column, body: Column) -> Column:
    """path :: kind :: comments :: identifiers, empty ones left out; at most IDENTIFIER_CAP distinct identifiers."""
    names = F.array_distinct(F.filter(F.transform(found(body, LONG_IDENTIFIER), humanise), lambda w: w != ""))
    fields = F.array(humanise(path), kind, comments, F.array_join(F.slice(names, 1, IDENTIFIER_CAP), " "))
    return F.array_join(F.filter(fields, lambda x: x != ""), " :: ")


def opening_line(text: Column, most: int = 500) -> Column:
    """The first line that is not blank, trimmed, at most so long; null if there is none."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.substring(F.get(lines, F.lit(0)), 1, most)
