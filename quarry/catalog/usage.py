"""Log, lookup, relation and dashboard queries."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import analysis as A
from ..operators import recall as L
from ..operators import relations as R
from ..operators import retrieval as V
from ..plans.checks import spec_of
from ..plans.model import compose
from ..plans.sales import AMOUNT, SALES
from ..streaming.events import sessions, windowed
from .registry import query
from .sales import GEO, SUM


@query(f"SELECT coalesce(nullif(trim(r_name), ''), 'unregistered') AS region, {SUM} AS sales_amount FROM {GEO} WHERE o_orderdate >= DATE '1997-07-01' AND o_orderdate < DATE '1998-01-01' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
def question_to_plan(t, spark):
    """A question composed by declared aliases: metric, dimension, window, rank."""
    return compose(SALES, spec_of(SALES, "top 3 region by sales in second half of 1997", date(1998, 9, 15)), t)


@query("SELECT event_id, user_id, round(least(value / 100, 1) * (1 + 0.1 * ln(1 + user_id)) * exp(-greatest(date_diff('day', CAST(ts AS DATE), DATE '2024-02-01'), 0) / 30.0), 6) AS score FROM events")
def memory_rerank(t, spark):
    hits = t("events").select("event_id", "user_id", F.least(F.col("value") / 100, F.lit(1)).alias("similarity"), F.col("user_id").alias("hits"), F.col("ts").alias("last_used"))
    return L.memory_scores(hits, "2024-02-01").select("event_id", "user_id", "score")


@query("WITH o AS (SELECT user_id, max(CASE WHEN event_type <> 'error' THEN event_id END) AS ok FROM events GROUP BY 1) SELECT e.user_id, count(*) FILTER (WHERE event_type = 'error' AND (ok IS NULL OR event_id > ok)) AS streak FROM events e JOIN o USING (user_id) GROUP BY 1")
def failure_streaks(t, spark):
    return L.failure_streak(t("events"), ["user_id"], "event_id", F.col("event_type") == "error")


@query("WITH o AS (SELECT DISTINCT l_orderkey AS q, l_returnflag || l_linestatus AS i FROM lineitem), p AS (SELECT a.i AS l, b.i AS r, count(*) AS n FROM o a JOIN o b ON a.q = b.q AND a.i < b.i GROUP BY 1, 2) SELECT l AS \"left\", r AS \"right\", n, round(n / (SELECT max(n) FROM p), 6) AS frequency FROM p")
def usage_pairs(t, spark):
    return L.usage_pairs(t("lineitem").select("l_orderkey", F.concat("l_returnflag", "l_linestatus").alias("i")), "l_orderkey", "i")


@query("SELECT user_id, arg_max(event_type, event_id) AS last_type, max(event_id) AS last_id FROM events GROUP BY 1")
def lateral_latest(t, spark):
    return t("events").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("last_type"), F.max("event_id").alias("last_id"))


@query("SELECT CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS status, count(*) AS orders FROM orders GROUP BY 1")
def code_labels_from_map(t, spark):
    labels = spark.createDataFrame([("F", "finished"), ("O", "open")], "code string, label string")
    return t("orders").join(F.broadcast(labels), F.col("o_orderstatus") == F.col("code"), "left").groupBy(F.coalesce("label", "o_orderstatus").alias("status")).agg(F.count("*").alias("orders"))


@query("SELECT conv_id, turn, role FROM conversations WHERE conv_id = (SELECT min(conv_id) FROM conversations) AND turn BETWEEN 0 AND 2")
def chunk_neighbours(t, spark):
    first = t("conversations").agg(F.min("conv_id")).first()[0]
    c = t("conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ord"), "role")
    return V.neighbours(c, first, 1, 1).select(F.col("doc_id").alias("conv_id"), F.col("ord").alias("turn"), "role")


@query("SELECT DISTINCT ancestor, count(*) OVER (PARTITION BY ancestor) AS docs FROM (SELECT 'src/' || lang AS ancestor FROM documents UNION ALL SELECT 'src' FROM documents)")
def folder_ancestors(t, spark):
    paths = t("documents").select(F.concat_ws("/", F.lit("src"), "lang", "source").alias("path"))
    return R.ancestors(paths).groupBy("ancestor").agg(F.count("*").alias("docs"))


@query("WITH s AS (SELECT doc_id, source, lang FROM documents WHERE doc_id = 3), c AS (SELECT d.doc_id, 1 AS priority FROM documents d JOIN s ON d.source = s.source UNION ALL SELECT d.doc_id, 2 FROM documents d JOIN s ON d.lang = s.lang) SELECT doc_id, min(priority) AS priority FROM c WHERE doc_id <> 3 GROUP BY 1 ORDER BY 2, 1 LIMIT 10")
def relation_candidates(t, spark):
    d = t("documents").select("doc_id", "source", "lang")
    seed = d.where("doc_id = 3")
    same = d.join(F.broadcast(seed.select("source")), "source", "left_semi").select("doc_id", F.lit(1).alias("priority"))
    both = same.unionByName(d.join(F.broadcast(seed.select("lang")), "lang", "left_semi").select("doc_id", F.lit(2).alias("priority")))
    return both.join(seed.select("doc_id"), "doc_id", "left_anti").groupBy("doc_id").agg(F.min("priority").alias("priority")).orderBy("priority", "doc_id").limit(10)


@query("SELECT count(*) AS requests, count(*) FILTER (WHERE event_type = 'error') AS errors, round(100.0 * count(*) FILTER (WHERE event_type = 'error') / nullif(count(*), 0), 4) AS error_pct, count(DISTINCT user_id) AS users, round(quantile_cont(value, 0.95), 6) AS p95 FROM events")
def usage_dashboard(t, spark):
    t("events").createOrReplaceTempView("_quarry_usage")
    return spark.sql("SELECT count(*) AS requests, count_if(event_type = 'error') AS errors, round(CAST(100.0 * count_if(event_type = 'error') / nullif(count(*), 0) AS DOUBLE), 4) AS error_pct, count(DISTINCT user_id) AS users, round(percentile_cont(0.95) WITHIN GROUP (ORDER BY value), 6) AS p95 FROM _quarry_usage")


@query("SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:00') AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def events_windowed(t, spark):
    return windowed(t("events")).select(F.date_format("begin", "yyyy-MM-dd HH:00").alias("hour"), "event_type", "n")


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM events), n AS (SELECT user_id, sum(s) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g), c AS (SELECT user_id, k, count(*) AS n FROM n GROUP BY 1, 2) SELECT n, count(*) AS sessions FROM c GROUP BY 1")
def session_sizes(t, spark):
    return sessions(t("events")).groupBy("n").agg(F.count("*").alias("sessions"))


@query("SELECT p_brand, p_name, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rn FROM part) WHERE rn = 1")
def best_part_per_brand(t, spark):
    w = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    return t("part").withColumn("rn", F.row_number().over(w)).where("rn = 1").select("p_brand", "p_name", "p_retailprice")


@query(f"SELECT round(CAST(sum({AMOUNT}) AS DOUBLE) / (SELECT CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) FROM orders), 6) AS ratio FROM lineitem")
def scalar_ratio(t, spark):
    a = t("lineitem").agg(F.expr(f"CAST(sum({AMOUNT}) AS DOUBLE)").alias("a"))
    b = t("orders").agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("b"))
    return a.crossJoin(b).select(F.round(F.col("a") / F.nullif("b", F.lit(0)), 6).alias("ratio"))


@query("SELECT o_orderpriority AS priority, CAST(sum(p) FILTER (WHERE o_orderdate >= DATE '1998-01-01') AS DOUBLE) AS current_value, round((CAST(sum(p) FILTER (WHERE o_orderdate >= DATE '1998-01-01') AS DOUBLE) - CAST(sum(p) FILTER (WHERE o_orderdate < DATE '1998-01-01') AS DOUBLE)) / nullif(abs(CAST(sum(p) FILTER (WHERE o_orderdate < DATE '1998-01-01') AS DOUBLE)), 0), 6) AS rate FROM (SELECT o_orderpriority, o_orderdate, CAST(o_totalprice AS DECIMAL(18,2)) AS p FROM orders WHERE o_orderdate >= DATE '1997-01-01' AND o_orderdate < DATE '1999-01-01') GROUP BY 1")
def comparison_cards(t, spark):
    from ..plans.model import TimeWindow

    w = {"current_value": TimeWindow(date(1998, 1, 1), date(1999, 1, 1)), "base": TimeWindow(date(1997, 1, 1), date(1998, 1, 1))}
    rows = A.compare_windows(t("orders").withColumnRenamed("o_orderpriority", "priority"), "o_orderdate", F.col("o_totalprice").cast("decimal(18,2)"), w, ["priority"])
    return rows.select("priority", "current_value", F.round(A.change(F.col("current_value"), F.col("base")), 6).alias("rate"))
