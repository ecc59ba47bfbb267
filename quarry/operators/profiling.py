"""Column profiles and the edges inferred from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Confidence bands of overlap, correlation and lineage.
OVERLAP_BANDS = ((0.9, 0.90), (0.6, 0.75), (0.3, 0.55), (0.1, 0.35))
CORRELATION_BANDS = ((0.9, 0.80), (0.7, 0.60), (0.5, 0.40))
LINEAGE_BANDS = ((0.5, 0.70), (0.3, 0.55), (0.15, 0.40))
AUDIT = ("id", "created_time", "created_by", "create_time", "creator", "updated_time", "updated_by", "update_time", "updater", "deleted_flag", "is_deleted", "tenant_id", "remark", "version", "sync_time")


def band(value: float, bands) -> float | None:
    return next((c for least, c in bands if value >= least), None)


def bucket(t: T.DataType) -> str | None:
    if isinstance(t, T.NumericType):
        return "numeric"
    if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "temporal"
    return "string" if isinstance(t, T.StringType) else None


def profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, rows, nulls, distinct) of each column from one unpivoted aggregate; empty strings count as null."""
    columns = columns or df.columns
    wide = df.select(*[F.nullif(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns])
    long = wide.unpivot([], columns, "column", "value")
    return long.groupBy("column").agg(F.count("*").alias("rows"), F.count_if(F.col("value").isNull()).alias("nulls"), F.countDistinct("value").alias("distinct"))


def top_values(df: DataFrame, columns: list[str], top: int = 10) -> DataFrame:
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], columns, "column", "value").where("value is not null and value <> ''")
    n = long.groupBy("column", "value").agg(F.count("*").alias("n"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "value"))).where(F.col("rank") <= top)


def value_overlap(left: DataFrame, a: str, right: DataFrame, b: str) -> DataFrame:
    """Distinct values in common over the smaller side's, by one full join of the distinct values."""
    x = left.select(F.col(a).cast("string").alias("v")).where("v is not null and v <> ''").distinct().withColumn("l", F.lit(1))
    y = right.select(F.col(b).cast("string").alias("v")).where("v is not null and v <> ''").distinct().withColumn("r", F.lit(1))
    got = x.join(y, "v", "full").agg(F.count("l").alias("left_n"), F.count("r").alias("right_n"), F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("common"))
    return got.select("left_n", "right_n", "common", F.round(F.col("common") / F.nullif(F.least("left_n", "right_n"), F.lit(0)), 6).alias("overlap"))


def joinable_confidence(overlap: float, same_name: bool) -> float | None:
    c = band(overlap, OVERLAP_BANDS)
    return None if c is None else round(min(0.95, c + 0.05 * same_name), 2)


def pearson(df: DataFrame, pairs: list[tuple[str, str]], least: int = 30) -> DataFrame:
    """Correlation of each pair from one aggregate; null under `least` pairs or without variance."""
    aggs = []
    for k, (a, b) in enumerate(pairs):
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        ok = (F.count_if(both) >= least) & (F.stddev_pop(F.when(both, F.col(a))) > 0) & (F.stddev_pop(F.when(both, F.col(b))) > 0)
        aggs.append(F.when(ok, F.round(F.corr(a, b), 6)).alias(f"p{k}"))
    wide = df.agg(*aggs)
    return wide.select(F.explode(F.array(*[F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(f"p{k}").alias("r")) for k, (a, b) in enumerate(pairs)])).alias("e")).select("e.*")


def average_rank(df: DataFrame, col: str, out: str, parts: int = 64) -> DataFrame:
    """Average rank of each distinct value of a numeric column, from counts.

    The values are cut into ranges at approximate quantiles; each range is put in order by itself, and what lies
    before it is added, so that no task orders all of them.
    """
    n = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("_n"))
    cuts = n.agg(F.percentile_approx(F.col(col).cast("double"), [k / parts for k in range(1, parts)], 1000).alias("q")).first().q or []
    cuts = sorted(set(cuts))
    part = F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: c < F.col(col))) if cuts else F.lit(0)
    n = n.withColumn("_p", part)
    before = n.groupBy("_p").agg(F.sum("_n").alias("_s")).withColumn("_before", F.coalesce(F.sum("_s").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_s")
    upto = F.sum("_n").over(Window.partitionBy("_p").orderBy(col)) + F.col("_before")
    return n.join(F.broadcast(before), "_p").select(col, (upto - F.col("_n") + (F.col("_n") + 1) / 2).alias(out))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(a, b)
    return rows.join(average_rank(rows, a, "_ra"), a).join(average_rank(rows, b, "_rb"), b).agg(F.round(F.corr("_ra", "_rb"), 6).alias("rho"))


def distribution_similarity(left: DataFrame, a: str, right: DataFrame, b: str, top: int = 10) -> DataFrame:
    """Ratio of distinct counts times the overlap of the top values' shares."""
    x = top_values(left.withColumnRenamed(a, "x"), ["x"], top).withColumn("lw", F.col("n") / F.sum("n").over(Window.partitionBy())).select("value", "lw")
    y = top_values(right.withColumnRenamed(b, "y"), ["y"], top).withColumn("rw", F.col("n") / F.sum("n").over(Window.partitionBy())).select("value", "rw")
    shared = x.join(y, "value").agg(F.coalesce(F.sum(F.least("lw", "rw")), F.lit(0.0)).alias("shared"))
    counts = left.agg(F.countDistinct(a).alias("dl")).crossJoin(right.agg(F.countDistinct(b).alias("dr")))
    return counts.crossJoin(shared).select(F.round(F.least("dl", "dr") / F.nullif(F.greatest("dl", "dr"), F.lit(0)) * F.col("shared"), 6).alias("similarity"))


def code_match(values: DataFrame, col: str, codes: DataFrame, least: float = 0.8) -> DataFrame:
    """Code tables (dict, code, name) that cover the column's 2 to 60 distinct values to `least`, the best first.

    No more than 61 distinct values ever leave the tasks: a column with more of them is none of codes.
    """
    v = values.select(F.col(col).cast("string").alias("code")).where("code is not null and code <> ''").distinct()
    found = [r.code for r in v.limit(61).collect()]
    if not 2 <= len(found) <= 60:
        return codes.select("dict", F.lit(0).cast("long").alias("hits"), F.lit(0.0).alias("coverage")).limit(0)
    hit = codes.where(F.col("code").isin(*found)).groupBy("dict").agg(F.countDistinct("code").alias("hits"))
    return hit.withColumn("coverage", F.round(F.col("hits") / F.lit(float(len(found))), 6)).where(F.col("coverage") >= least)


def lineage_confidence(left: list[str], right: list[str], mentioned: bool = False, same_core: bool = False) -> float | None:
    """Confidence that one table feeds another, from shared columns without audit columns, and bonuses."""
    a, b = ({c.lower() for c in x} - set(AUDIT) for x in (left, right))
    c = band(len(a & b) / max(1, min(len(a), len(b))), LINEAGE_BANDS)
    if mentioned:
        c = max(c or 0, 0.85)
    return None if c is None else round(min(0.95, c + 0.10 * same_core), 2)


def canonical_edges(edges: DataFrame) -> DataFrame:
    """Undirected edges once, with the greatest confidence."""
    return edges.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.max("confidence").alias("confidence"))


def keep_reviewed(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Upsert in which a status that a person set outlasts new evidence."""
    o = old.select(*keys, F.col("status").alias("_old"), F.col("confidence").alias("_oc"))
    return new.join(o, keys, "full").select(*keys, F.coalesce("confidence", "_oc").alias("confidence"), F.when(F.col("_old").isin("accepted", "rejected"), F.col("_old")).otherwise(F.coalesce("status", "_old")).alias("status"))
