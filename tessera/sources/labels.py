"""Labelled questions from JSON: a list of repositories, and a file of annotations for each, named after it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A target is a path, or an object with a path and a span; read as text it is either the path or the object's JSON.
ANNOTATION = "repo string, query string, category string, relevant array<string>, secondary array<string>"


def repositories(spark: SparkSession, path: str) -> DataFrame:
    """(repo, language, url, revision, benchmark_root) of a JSON list; the root is null where the whole repository is meant."""
    schema = "name string, language string, url string, revision string, benchmark_root string"
    return spark.read.schema(schema).json(path, multiLine=True).withColumnRenamed("name", "repo")


def questions(spark: SparkSession, folder: str, repos: DataFrame) -> DataFrame:
    """(query_id, repo, language, query, category, targets) of the annotations of known repositories.

    targets are (path, start_line, end_line), primary ones before secondary, the span null where none is stated. An annotation
    may name another repository than its file's; the category is `semantic` where none is stated.
    """
    rows = spark.read.schema(ANNOTATION).json(folder, multiLine=True, pathGlobFilter="*.json")
    own = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1)
    rows = rows.select(own.alias("file"), "*").join(repos.select(F.col("repo").alias("file")), "file", "left_semi").withColumn("repo", F.coalesce("repo", "file"))
    none = F.array().cast("array<string>")
    pooled = F.concat(F.coalesce("relevant", none), F.coalesce("secondary", none))
    out = rows.withColumns({"category": F.coalesce("category", F.lit("semantic")), "targets": F.transform(pooled, target)}).join(repos.select("repo", "language"), "repo")
    return out.select(F.xxhash64("repo", "query").alias("query_id"), "repo", "language", "query", "category", "targets")


def target(raw: Column) -> Column:
    is_object = raw.startswith("{")
    line = lambda name: F.when(is_object, F.get_json_object(raw, f"$.{name}").cast("int")).alias(name)
    return F.struct(F.when(is_object, F.get_json_object(raw, "$.path")).otherwise(raw).alias("path"), line("start_line"), line("end_line"))
