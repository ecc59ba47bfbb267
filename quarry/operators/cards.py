"""Entity cards, digests, weekly tables, report sections and card-level aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.model import TimeWindow
from .analysis import change


def entity_cards(lines: DataFrame, kinds: dict[str, str], time_col: str) -> DataFrame:
    """(kind, name, orders, customers, skus, months, last_order) of the entities of all kinds.

    kinds gives each kind's column. A row goes once to its order, once to its customer and once to its product, whole:
    where all rows of such a key lie together its entities are made distinct, so that pairs are never shuffled.
    """
    names = [f"_k{i}" for i in range(len(kinds))]
    sets = F.explode(F.array(*[F.struct(F.lit(i).alias("kind"), F.col(c).alias("name")) for i, c in enumerate(names)])).alias("_e")
    wide = lines.select(*[F.col(c).cast("string").alias(n) for n, c in zip(names, kinds.values())], "o_orderkey", "o_custkey", "l_partkey", (12 * F.year(time_col) + F.month(time_col)).alias("_m"), F.col(time_col).alias("_t"))
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("g"), F.col(c).alias("v")) for i, c in enumerate(("o_orderkey", "o_custkey", "l_partkey"))])).alias("_v")
    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = wide.select(*names, keys).select(*names, "_v.g", "_v.v").where("v IS NOT NULL").repartition(parts, "g", "v")
    pairs = met.select("g", "v", sets).where("_e.name IS NOT NULL").select("g", "v", "_e.kind", "_e.name").distinct()
    counts = pairs.groupBy("kind", "name").agg(*[F.count_if(F.col("g") == i).alias(n) for i, n in enumerate(("orders", "customers", "skus"))])
    months = wide.select(sets, "_m", "_t").where("_e.name IS NOT NULL").groupBy("_e.kind", "_e.name", "_m").agg(F.max("_t").alias("_t"))
    times = months.groupBy("kind", "name").agg(F.count("_m").alias("months"), F.date_format(F.max("_t"), "yyyy-MM-dd").alias("last_order"))
    out = times.join(counts, ["kind", "name"], "left")
    label = F.element_at(F.array(*[F.lit(k) for k in kinds]), F.col("kind") + 1).alias("kind")
    return out.select(label, "name", *[F.coalesce(n, F.lit(0)).alias(n) for n in ("orders", "customers", "skus")], "months", "last_order")


def digest(df: DataFrame, time_col: str, parts: dict[str, Column], metrics: dict, windows: dict[str, TimeWindow], keys: list[str] | None = None) -> DataFrame:
    """(keys, metric, one column a window): several metrics over several windows, in one scan.

    parts are row values that are summed by window; metrics are functions of a window's sums by part.
    """
    keys = keys or []
    sums = [F.sum(F.when(w.on(time_col), v)).alias(f"{n}__{p}") for n, w in windows.items() for p, v in parts.items()]
    reach = None
    for w in windows.values():
        reach = w.on(time_col) if reach is None else reach | w.on(time_col)
    wide = df.where(reach).groupBy(*keys).agg(*sums) if keys else df.where(reach).agg(*sums)
    rows = []
    for m, value in metrics.items():
        cells = [value({p: F.col(f"{n}__{p}") for p in parts}).cast("double").alias(n) for n in windows]
        rows.append(F.struct(F.lit(m).alias("metric"), *cells))
    return wide.select(*keys, F.explode(F.array(*rows)).alias("_r")).select(*keys, "_r.*")


def with_rates(table: DataFrame, current: str, bases: list[str], percent: tuple[str, ...] = ()) -> DataFrame:
    """For each base a change: the relative one, or for metrics in percent the difference in points."""
    for b in bases:
        points = F.col(current) - F.col(b)
        table = table.withColumn(f"{b}_change", F.round(F.when(F.col("metric").isin(*percent), points).otherwise(change(F.col(current), F.col(b))), 6) if percent else F.round(change(F.col(current), F.col(b)), 6))
    return table


def section(rows: DataFrame, label: str, value: str, by_time: bool, limit: int = 20) -> DataFrame:
    """A report section: trends in order of time, others by value, the largest first."""
    return rows.orderBy(label).limit(limit) if by_time else rows.orderBy(F.col(value).desc(), label).limit(limit)


def highlights(sections: DataFrame) -> DataFrame:
    """(section, kind, label, figure) of sections (section, trend, label, value): the latest change of a trend, else the leader's share.

    A trend's change is that of its last period on the one before, on the absolute base; a share is of the sum, and
    missing where a value is negative.
    """
    t = sections.where("trend").groupBy("section").agg(F.max_by("label", "label").alias("label"), F.max_by("value", "label").alias("_last"), F.max("label").alias("_at"))
    before = sections.where("trend").join(t.select("section", "_at"), "section").where("label < _at").groupBy("section").agg(F.max_by("value", "label").alias("_before"))
    trend = t.join(before, "section").select("section", F.lit("change").alias("kind"), "label", F.round(change(F.col("_last"), F.col("_before")), 6).alias("figure"))
    h = sections.where("NOT trend").groupBy("section").agg(F.max(F.struct("value", "label")).alias("_m"), F.sum("value").alias("_s"), F.min("value").alias("_least"))
    head = h.select("section", F.lit("share").alias("kind"), F.col("_m.label").alias("label"), F.when(F.col("_least") >= 0, F.round(F.col("_m.value") / F.nullif("_s", F.lit(0.0)), 6)).alias("figure"))
    return trend.unionByName(head)


AGGREGATES = {"count": lambda c: F.count(c), "distinct": lambda c: F.countDistinct(c), "sum": lambda c: F.sum(c), "avg": lambda c: F.avg(c), "max": lambda c: F.max(c), "min": lambda c: F.min(c)}


def card_aggregate(df: DataFrame, column: str, how: str, semantic: str = "number") -> DataFrame:
    """One figure of a result's column: count, distinct, sum, avg, max or min; percents can't be summed."""
    if how not in AGGREGATES:
        raise ValueError(f"no aggregate {how}")
    if how == "sum" and semantic == "percent":
        raise ValueError("percents don't add up")
    return df.agg(AGGREGATES[how](column).alias("value"))


def goods_of(lines: DataFrame, orders: DataFrame, customers: DataFrame, amount: Column, limit: int) -> DataFrame:
    """Products of some customers, by amount, with their orders, quantity and last order; the customers' orders come first."""
    mine = orders.join(customers.select(F.col("c_custkey").alias("_c")), F.col("o_custkey") == F.col("_c"), "left_semi").select("o_orderkey", "o_orderdate")
    rows = lines.join(mine, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.groupBy(F.col("l_partkey").alias("partkey")).agg(F.countDistinct("o_orderkey").alias("orders"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("qty"), F.sum(amount).cast("double").alias("amount"), F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("last_order")).orderBy(F.desc("amount"), "partkey").limit(limit)
