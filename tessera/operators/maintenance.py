"""Keeping tables up to date: diffs, upserts, deletes with their dependants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff(seen: DataFrame, known: DataFrame, key: str, marks: list[str]) -> DataFrame:
    """(key, change): added, changed or deleted; unchanged rows are left out. Nulls equal nulls."""
    a = seen.select(key, F.struct(*marks).alias("now"))
    b = known.select(F.col(key).alias("known_key"), F.struct(*marks).alias("then"))
    joined = a.join(b, a[key] == b["known_key"], "full_outer")
    change = F.when(F.col("known_key").isNull(), "added").when(F.col(key).isNull(), "deleted").when(~F.col("now").eqNullSafe(F.col("then")), "changed")
    return joined.select(F.coalesce(key, "known_key").alias(key), change.alias("change")).where("change is not null")


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The table with rows in the place of those of equal keys."""
    return table.join(rows.select(*keys), keys, "left_anti").unionByName(rows)


def cascade(rows: DataFrame, gone: DataFrame, key: str, gone_key: str | None = None) -> DataFrame:
    """Rows whose key is not among those deleted."""
    return rows.join(gone.select(F.col(gone_key or key).alias(key)), key, "left_anti")
