"""Recall of past questions, failure streaks, usage mining and graph upkeep over logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def memory_scores(hits: DataFrame, now: str) -> DataFrame:
    """similarity * (1 + 0.1 ln(1 + hits)) * exp(-age in days / 30)."""
    age = F.greatest(F.datediff(F.lit(now).cast("date"), F.col("last_used").cast("date")), F.lit(0))
    return hits.withColumn("score", F.round(F.col("similarity") * (1 + 0.1 * F.ln(1 + F.col("hits"))) * F.exp(-age / 30.0), 6))


def failure_streak(log: DataFrame, keys: list[str], order: str, failed: F.Column) -> DataFrame:
    """Failures of each key since its last success."""
    last_ok = F.max(F.when(~failed, F.col(order))).over(Window.partitionBy(*keys))
    return log.withColumn("_ok", last_ok).groupBy(*keys).agg(F.count_if(failed & (F.col("_ok").isNull() | (F.col(order) > F.col("_ok")))).alias("streak"))


def usage_pairs(log: DataFrame, query: str, item: str) -> DataFrame:
    """Pairs of items that one query uses, with their number of queries and its share of the most frequent pair.

    Items of a query are distinct first; the pairing joins within a query, whose items are few by nature.
    """
    one = log.select(F.col(query).alias("q"), F.col(item).alias("i")).distinct()
    pairs = one.alias("a").join(one.alias("b"), F.expr("a.q = b.q AND a.i < b.i")).groupBy(F.col("a.i").alias("left"), F.col("b.i").alias("right")).agg(F.count("*").alias("n"))
    most = pairs.agg(F.max("n").alias("_m"))
    return pairs.crossJoin(F.broadcast(most)).select("left", "right", "n", F.round(F.col("n") / F.col("_m"), 6).alias("frequency"))


def calibrated(static: F.Column, usage: F.Column) -> F.Column:
    return F.round(0.6 * static + 0.4 * F.coalesce(usage, F.lit(0.0)), 6)


def orphans(graph: DataFrame, alive: DataFrame, key: str, most_share: float = 0.5) -> tuple[DataFrame, bool]:
    """Graph rows whose document is gone, and whether they are few enough to be removed."""
    gone = graph.join(alive.select(key).distinct(), key, "left_anti")
    return gone, gone.count() <= most_share * graph.count()
