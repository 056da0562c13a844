"""Relevance: discounted gain, hit rates, precision and recall, span cover."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIGITS = 6


def ndcg(ranking: DataFrame, relevance: DataFrame, k: int, key: str = "doc_id", queries: DataFrame | None = None) -> DataFrame:
    """(query_id, ndcg, hit) of rankings (query_id, key, rank) against (query_id, key, rel); queries without relevant rows go.

    With queries (query_id), relevance is (key, rel) for all of them alike: the ideal is worked out once.
    """
    gain = F.col("rel") / F.log2(F.col("rank") + 1)
    shared = queries is not None
    got = ranking.where(F.col("rank") <= k).join(relevance, [key] if shared else ["query_id", key]).groupBy("query_id").agg(F.sum(gain).alias("dcg"), F.max((F.col("rel") > 0).cast("int")).alias("hit"))
    if shared:
        first = relevance.orderBy(F.desc("rel"), key).limit(k)
        numbered = first.agg(F.array_sort(F.collect_list(F.struct((-F.col("rel")).alias("least"), key, "rel"))).alias("best"))  # k rows
        gains = F.transform("best", lambda x, i: x["rel"] / F.log2(i + 2))
        ideal = numbered.select(F.aggregate(gains, F.lit(0.0), lambda s, x: s + x).alias("idcg")).where("idcg > 0")
        best = queries.select("query_id").crossJoin(F.broadcast(ideal))  # one row
    else:
        ranked = relevance.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rel"), key))).where(F.col("rank") <= k)
        best = ranked.groupBy("query_id").agg(F.sum(gain).alias("idcg")).where("idcg > 0")
    out = best.join(got, "query_id", "left")
    return out.select("query_id", F.round(F.coalesce("dcg", F.lit(0.0)) / F.col("idcg"), DIGITS).alias("ndcg"), F.coalesce("hit", F.lit(0)).alias("hit"))


def precision_recall(found: DataFrame, truth: DataFrame, keys: list[str], group: str) -> DataFrame:
    """(group, precision, recall, f1) of distinct found rows against the truth."""
    f, t = found.select(group, *keys).distinct(), truth.select(group, *keys).distinct()
    counts = f.groupBy(group).agg(F.count("*").alias("nf")).join(t.groupBy(group).agg(F.count("*").alias("nt")), group, "full_outer")
    both = f.join(t, [group, *keys]).groupBy(group).agg(F.count("*").alias("nb"))
    out = counts.join(both, group, "left").fillna(0, ["nf", "nt", "nb"])
    p = F.when(F.col("nf") > 0, F.col("nb") / F.col("nf")).otherwise(0.0)
    r = F.when(F.col("nt") > 0, F.col("nb") / F.col("nt")).otherwise(0.0)
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return out.select(group, F.round(p, DIGITS).alias("precision"), F.round(r, DIGITS).alias("recall"), F.round(f1, DIGITS).alias("f1"))


def covers(path: Column, first: Column, last: Column, target_path: Column, target_first: Column, target_last: Column) -> Column:
    """Whether a result is at a target: its path ends with the target's at a segment, and the spans overlap if one is stated."""
    here = (path == target_path) | F.endswith(path, F.concat(F.lit("/"), target_path))
    return here & (target_first.isNull() | (first <= F.coalesce(target_last, target_first)) & (last >= target_first))


def quantile_at(values: DataFrame, column: str, q: float) -> DataFrame:
    """One row: the least value that the share q of the values does not exceed, by a distributed percentile."""
    return values.agg(F.expr(f"percentile_disc({float(q)}) within group (order by `{column}`)").alias(column))


def means(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the mean of each column and the number of rows."""
    return rows.agg(*(F.avg(c).alias(c) for c in columns), F.count("*").alias("n"))
