"""Sources: directories of files and tables of documents, pages and conversations as one corpus relation.

A corpus has path, lang, content_type, text, size and mtime_ns; every operator downstream takes it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from ..functions.classify import classify, is_generated, is_indexable, language
from ..settings import Settings

IGNORE_FILES = (".gitignore", ".tesseraignore")
#: Suffixes of the made-up paths of documents, by doc_id modulo their number.
DOCUMENT_SUFFIXES = (".md", ".py", "_test.go", "Tests.swift", ".d.ts", ".json", ".csv", "/__init__.py")


def ignore_pattern(line: str, base: str = "") -> tuple[str, bool] | None:
    """One line of an ignore file in the directory `base` as (pattern for paths under it, ignored or not)."""
    line = line.rstrip("\n").rstrip()
    if not line or line.startswith("#"):
        return None
    ignored = not line.startswith("!")
    body = line.lstrip("!") if not ignored else line
    only_dirs = body.endswith("/")
    body = body.rstrip("/")
    rooted = "/" in body
    body = body.lstrip("/")
    out = ""
    for piece in re.split(r"(\*\*/|/\*\*|\*\*|\*|\?|\[[^\]]*\])", body):
        out += {"**/": "(?:.*/)?", "/**": "/.*", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(piece) or (piece.replace("[!", "[^") if piece.startswith("[") else re.escape(piece))
    start = re.escape(base.rstrip("/") + "/") if base.strip("/") else ""
    return f"^{start}{'' if rooted else '(?:.*/)?'}{out}{'/.*' if only_dirs else '(?:/.*)?'}$", ignored


def is_ignored(path: Column, rules: list[tuple[str, bool]]) -> Column:
    """Whether the last rule that matches a path ignores it."""
    out = F.lit(False)
    for pattern, ignored in rules:
        out = F.when(path.rlike(pattern), F.lit(ignored)).otherwise(out)
    return out


def ignore_rules(root: Path, settings: Settings) -> list[tuple[str, bool]]:
    """Rules of all ignore files of a tree, outer directories first, our own file last in each."""
    names = IGNORE_FILES if settings.gitignore else IGNORE_FILES[1:]
    found = sorted((p for n in names for p in root.rglob(n)), key=lambda p: (len(p.parts), str(p.parent), names.index(p.name)))
    rules = []
    for file in found:
        base = "" if file.parent == root else file.parent.relative_to(root).as_posix()
        rules += [r for line in file.read_text(errors="ignore").splitlines() if (r := ignore_pattern(line, base))]
    return rules


def with_category(files: DataFrame, settings: Settings) -> DataFrame:
    """Adds lang (by path, unless there) and content_type."""
    if "lang" not in files.columns:
        files = files.withColumn("lang", language(F.col("path")))
    return files.withColumn("content_type", classify(F.col("lang"), F.col("path"), settings))


def valid_text(content: Column) -> Column:
    """Bytes as text; what is no UTF-8 is left out."""
    return F.translate(F.make_valid_utf8(content.cast("string")), "\N{REPLACEMENT CHARACTER}", "")


def listing(spark: SparkSession, root: str, settings: Settings | None = None) -> DataFrame:
    """Every file under a directory that may be indexed, unread: path, lang, content_type, size, mtime_ns.

    Left out, in this order: what ignore files and excluded directory names say, files without a language, too large
    files, and categories that are never indexed. The size bound reaches the scan; no content is read.
    """
    settings = settings or Settings()
    base = Path(root).resolve()
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("ignoreMissingFiles", True)
        .load(base.as_uri())
        .where(F.col("length") <= settings.max_file_bytes)
        .withColumn("path", F.substring(F.regexp_replace("path", r"^[a-z]+:/+", "/"), len(str(base)) + 2, 1 << 20))
    )
    segments = F.split("path", "/")
    pruned = F.exists(F.slice(segments, 1, F.size(segments) - 1), lambda d: d.isin(*settings.hard_exclude))
    hidden = F.col("path").rlike("(?:^|/)(?:" + "|".join(map(re.escape, IGNORE_FILES)) + ")$")
    kept = files.where(~pruned & ~hidden & ~is_ignored(F.col("path"), ignore_rules(base, settings)) & is_indexable(F.col("path")))
    kept = with_category(kept, settings).where(~F.col("content_type").isin(*settings.index_excluded))
    return kept.select("path", "lang", "content_type", F.col("length").alias("size"), (F.unix_millis("modificationTime") * 1_000_000).alias("mtime_ns"))


#: Bytes of files that are handed on at a time.
READ_BYTES = 1 << 23


def read(files: DataFrame, root: str) -> DataFrame:
    """Listed files with their text and whether they are generated; one that cannot be read has no row, so the next listing tries it again."""
    base, schema = Path(root).resolve(), files.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found, held = [], [], 0
            for k, path in enumerate(batch.column("path").to_pylist()):
                try:
                    found.append((base / path).read_bytes())
                    at.append(k)
                    held += len(found[-1])
                except OSError:
                    continue
                if held >= READ_BYTES:
                    yield pa.RecordBatch.from_arrays([*batch.take(pa.array(at)).columns, pa.array(found, pa.binary())], names=[*batch.schema.names, "content"])
                    at, found, held = [], [], 0
            yield pa.RecordBatch.from_arrays([*batch.take(pa.array(at, pa.int64())).columns, pa.array(found, pa.binary())], names=[*batch.schema.names, "content"])

    out = files.mapInArrow(run, StructType([*schema.fields, StructField("content", BinaryType())]))
    return out.withColumn("generated", is_generated(F.col("content"), F.octet_length("content").cast("bigint"))).withColumn("text", valid_text(F.col("content"))).drop("content")


def walk(spark: SparkSession, root: str, settings: Settings | None = None) -> DataFrame:
    """Every indexable file under a directory: path, lang, content_type, text, size, mtime_ns; generated ones are left out."""
    return read(listing(spark, root, settings), root).where(~F.col("generated")).select("path", "lang", "content_type", "text", "size", "mtime_ns")


def document_path() -> Column:
    """A made-up path of a row of documents, by its source, language and id."""
    suffix = F.get(F.array(*map(F.lit, DOCUMENT_SUFFIXES)), F.pmod("doc_id", F.lit(len(DOCUMENT_SUFFIXES))).cast("int"))
    return F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit("/doc_"), F.col("doc_id").cast("string"), suffix)


def documents(spark: SparkSession, sf_dir: str, settings: Settings | None = None) -> DataFrame:
    """documents as a corpus keyed by doc_id; lang is the programming or markup language of the made-up path."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", document_path().alias("path"), "source", "text")
    return with_category(rows, settings or Settings())


def pages(spark: SparkSession, sf_dir: str, settings: Settings | None = None) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("doc_id"), F.col("url").alias("path"), F.lit("html").alias("lang"), F.col("html").alias("text"))
    return with_category(rows, settings or Settings())


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as spans of a file for each conversation."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return rows.select(F.concat(F.lit("chat/"), F.col("conv_id").cast("string")).alias("path"), F.col("turn").alias("start_line"), F.col("turn").alias("end_line"), F.col("role").alias("name"), "text")
