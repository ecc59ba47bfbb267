"""Comparison, contribution, trend, reconciliation and calendar operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def change(current: Column, base: Column) -> Column:
    """Relative change on the absolute base; null on a base of zero."""
    return (current - base) / F.nullif(F.abs(base), F.lit(0))


def direction(current: Column, base: Column, eps: float = 1e-6) -> Column:
    d = current - base
    return F.when(d > eps, "up").when(d < -eps, "down").otherwise("flat")


def compare_windows(df: DataFrame, time_col: str, value: Column, windows: dict, keys: list[str] | None = None) -> DataFrame:
    """One sum a window, in one scan: each row is counted in the windows that hold it."""
    keys = keys or []
    sums = [F.coalesce(F.sum(F.when(w.on(time_col), value)), F.lit(0)).cast("double").alias(n) for n, w in windows.items()]
    reach = None
    for w in windows.values():
        reach = w.on(time_col) if reach is None else reach | w.on(time_col)
    rows = df.where(reach)
    return rows.groupBy(*keys).agg(*sums) if keys else rows.agg(*sums)


def contribution(df: DataFrame, name: str, value: str, top: int = 3) -> DataFrame:
    """The leading rows with their share of the positive total; only they are put in order."""
    total = df.agg(F.sum(F.greatest(F.col(value), F.lit(0.0))).alias("total"))
    order = [F.col(value).desc(), F.col(name)]
    lead = df.orderBy(*order).limit(top).withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    return lead.crossJoin(F.broadcast(total)).select(name, value, "rank", F.round(F.col(value) / F.nullif("total", F.lit(0.0)), 6).alias("share"))


def concentration(df: DataFrame, value: str, top: int = 3) -> DataFrame:
    """Share of the leader and of the first `top` rows; null if any value is negative or all are zero."""
    lead = df.select(value).orderBy(F.col(value).desc()).limit(top).agg(F.max(value).alias("_first"), F.sum(value).alias("_lead"))
    both = df.agg(F.sum(value).alias("_sum"), F.min(value).alias("_least")).crossJoin(F.broadcast(lead))
    share = lambda c: F.when(F.col("_least") >= 0, F.round(F.col(c) / F.nullif("_sum", F.lit(0.0)), 6))
    return both.select(share("_first").alias("leader_share"), share("_lead").alias("cr"))


def lag_change(df: DataFrame, period: str, value: str, keys: list[str] | None = None) -> DataFrame:
    """Each period with the one before it and the change on the absolute base."""
    w = Window.partitionBy(*(keys or [])).orderBy(period)
    out = df.withColumn("previous", F.lag(value).over(w))
    return out.withColumn("delta", F.round(F.col(value) - F.col("previous"), 4)).withColumn("rate", F.round(change(F.col(value), F.col("previous")), 6))


def first_last(df: DataFrame, period: str, value: str, skip: str | None = None) -> DataFrame:
    """Change from the first to the last period; `skip` is a period that isn't over yet."""
    rows = df.where(F.col(period) != skip) if skip else df
    out = rows.agg(F.min_by(value, period).alias("first_value"), F.max_by(value, period).alias("last_value"), F.count("*").alias("periods"))
    return out.withColumn("rate", F.round(change(F.col("last_value"), F.col("first_value")), 6))


def reconcile(sections: DataFrame, total: DataFrame, name: str, value: str, bucket: str | None = None) -> DataFrame:
    """Sum of sections against the total, within the greater of 0.01 and a billionth; share of the unknown bucket."""
    t = total.select(F.col(value).alias("expected"))
    s = sections.agg(F.sum(value).alias("found"), F.sum(F.when(F.col(name) == bucket, F.col(value))).alias("unknown") if bucket else F.lit(None).cast("double").alias("unknown"))
    both = s.crossJoin(F.broadcast(t))  # one row each
    return both.select(F.round("expected", 2).alias("expected"), F.round("found", 2).alias("found"), (F.abs(F.col("found") - F.col("expected")) <= F.greatest(F.lit(0.01), F.abs(F.col("expected")) * 1e-9)).alias("balanced"), (F.coalesce(F.col("unknown"), F.lit(0.0)) > 0.05 * F.abs(F.col("expected"))).alias("many_unknown"))


def fill_days(df: DataFrame, time_col: str, begin: str, end: str, value: Column, name: str) -> DataFrame:
    """One row a day of [begin, end], 0 where there is nothing."""
    spark = df.sparkSession
    days = spark.sql(f"SELECT explode(sequence(DATE'{begin}', DATE'{end}', INTERVAL 1 DAY)) AS day")
    found = df.where((F.col(time_col) >= begin) & (F.col(time_col) < F.date_add(F.lit(end).cast("date"), 1))).groupBy(F.to_date(time_col).alias("day")).agg(value.alias(name))
    return days.join(found, "day", "left").select(F.date_format("day", "yyyy-MM-dd").alias("day"), F.coalesce(name, F.lit(0)).alias(name))


def unpivot_groups(df: DataFrame, groups: dict[str, list[str]], label: str, value: str) -> DataFrame:
    """Totals of groups of wide columns as rows, from one aggregate."""
    totals = df.agg(*[sum((F.coalesce(F.sum(F.col(c).cast("decimal(18,4)")), F.lit(0)) for c in cols), F.lit(0)).cast("double").alias(g) for g, cols in groups.items()])
    return totals.unpivot([], list(groups), label, value)
