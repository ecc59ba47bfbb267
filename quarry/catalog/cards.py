"""Metric recall, table recall, relation cards, schema upkeep and title families over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalogs as C
from .registry import query

#: Metrics as (name, aliases): the words stand in the test texts and event types.
METRICS = [("sign", ["sign-in"]), ("signup", []), ("purchase", ["pur"]), ("view", ["page view"])]


@query("WITH w(name, word) AS (VALUES ('sign', 'sign'), ('sign', 'sign-in'), ('signup', 'signup'), ('purchase', 'purchase'), ('purchase', 'pur'), ('view', 'view'), ('view', 'page view')), h AS (SELECT event_id AS q_id, name, arg_max(word, length(word)) AS hit_word FROM events JOIN w ON contains(lower(event_type), word) GROUP BY ALL) SELECT * FROM h WHERE NOT EXISTS (SELECT 1 FROM h o WHERE o.q_id = h.q_id AND length(o.hit_word) > length(h.hit_word) AND contains(o.hit_word, h.hit_word))")
def metric_recall(t, spark):
    metrics = spark.createDataFrame([(n, a, "active") for n, a in METRICS], "name string, aliases array<string>, status string")
    return C.metric_hits(t("events").select(F.col("event_id").alias("q_id"), F.col("event_type").alias("question")), metrics)


_EDGES = "SELECT s_name AS left_table, n_name AS right_table, CASE s_suppkey % 4 WHEN 0 THEN 'joinable' WHEN 1 THEN 'lineage' WHEN 2 THEN 'contract' ELSE 'co_occurs' END AS kind, s_acctbal AS confidence, CASE s_suppkey % 5 WHEN 0 THEN 'rejected' ELSE 'active' END AS status, s_suppkey AS seen FROM supplier JOIN nation ON s_nationkey = n_nationkey"


@query(f"""WITH e AS ({_EDGES}), live AS (SELECT * FROM e WHERE status <> 'rejected'),
both_ends AS (SELECT left_table AS "table", right_table AS other, confidence, seen, CASE kind WHEN 'joinable' THEN 'stat_edges' WHEN 'contract' THEN 'contracts' WHEN 'co_occurs' THEN 'co_occurs' ELSE 'lineage_sources' END AS section FROM live
 UNION ALL SELECT right_table, left_table, confidence, seen, CASE kind WHEN 'joinable' THEN 'stat_edges' WHEN 'contract' THEN 'contracts' WHEN 'co_occurs' THEN 'co_occurs' ELSE 'lineage_consumers' END FROM live),
ranked AS (SELECT *, row_number() OVER (PARTITION BY "table", section ORDER BY confidence DESC, seen DESC, other) AS rank FROM both_ends)
SELECT "table", section, other, confidence, rank FROM ranked WHERE section NOT IN ('stat_edges', 'co_occurs') OR rank <= 2""")
def relation_cards(t, spark):
    k = F.col("s_suppkey")
    kind = F.element_at(F.array(*map(F.lit, ("joinable", "lineage", "contract", "co_occurs"))), (k % 4 + 1).cast("int"))
    e = t("supplier").join(t("nation"), F.expr("s_nationkey = n_nationkey"))
    edges = e.select(F.col("s_name").alias("left_table"), F.col("n_name").alias("right_table"), kind.alias("kind"), F.col("s_acctbal").alias("confidence"), F.when(k % 5 == 0, "rejected").otherwise("active").alias("status"), k.alias("seen"))
    return C.relation_cards(edges, 2)


@query("""WITH f AS (SELECT o_orderkey AS q_id, o_orderpriority AS "table" FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL),
l AS (SELECT l_orderkey AS q_id, l_shipmode AS "table", max(l_tax) AS near, max(l_discount) AS alike FROM (SELECT *, l_returnflag || l_linestatus AS l_shipmode FROM lineitem) GROUP BY ALL),
v AS (SELECT q_id, "table" FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY near DESC, "table") AS n FROM l) WHERE n < 3),
u AS (SELECT q_id, count(*) AS used FROM v GROUP BY 1),
s AS (SELECT q_id, "table", alike, row_number() OVER (PARTITION BY q_id ORDER BY alike DESC, "table") AS n FROM l ANTI JOIN v USING (q_id, "table"))
SELECT q_id, "table", 1.0 AS score, 0 AS route FROM f UNION ALL SELECT q_id, "table", 0.9, 1 FROM v UNION ALL SELECT q_id, "table", alike, 2 FROM s LEFT JOIN u USING (q_id) WHERE n + coalesce(used, 0) <= 3""")
def table_recall(t, spark):
    forced = t("orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("q_id"), F.col("o_orderpriority").alias("table"))
    lines = t("lineitem").groupBy(F.col("l_orderkey").alias("q_id"), F.concat("l_returnflag", "l_linestatus").alias("table")).agg(F.max("l_tax").alias("near"), F.max("l_discount").alias("alike"))
    return C.table_recall(forced, lines.select("q_id", "table", F.col("near").alias("score")), lines.select("q_id", "table", F.col("alike").alias("score")), 3)


@query("SELECT p_partkey, p_brand AS folder, family, (row_number() OVER (PARTITION BY p_brand, family ORDER BY p_name, p_partkey) - 1) // 12 AS part FROM (SELECT *, CASE WHEN length(run) >= 2 THEN run ELSE substr(regexp_replace(p_name, '[^\\p{L}\\p{N}]', '', 'g'), 1, 2) END AS family FROM (SELECT *, substr(regexp_extract(p_name, '^[^-0-9(_ \\[]*', 0), 1, 8) AS run FROM part))")
def title_families(t, spark):
    return C.title_groups(t("part").withColumn("folder", F.col("p_brand")), "p_name", "p_partkey")


ENTRIES = [("term", "promo", "goods of a campaign"), ("term", "stand", "usual goods"), ("value", "ECONOMY", "p_type"), ("value", "LARGE", "p_type"), ("pitfall", "size", "sizes are codes"), ("dimension", "brand", "part by brand"), ("dimension", "type", "part by type")]


@query("WITH e(kind, word, note) AS (VALUES ('term', 'promo', 'goods of a campaign'), ('term', 'stand', 'usual goods'), ('value', 'ECONOMY', 'p_type'), ('value', 'LARGE', 'p_type'), ('pitfall', 'size', 'sizes are codes'), ('dimension', 'brand', 'part by brand'), ('dimension', 'type', 'part by type')), q AS (SELECT p_partkey AS q_id, lower(p_type || ' by ' || CASE WHEN p_size % 2 = 0 THEN 'size' ELSE p_brand END) AS question FROM part) SELECT q_id, kind, word, note, row_number() OVER (PARTITION BY q_id, kind ORDER BY length(word) DESC, word) AS rank FROM q JOIN e ON contains(question, lower(word))")
def recall_cards(t, spark):
    """Term, value, pitfall and dimension cards of each question, the longest words first."""
    q = t("part").select(F.col("p_partkey").alias("q_id"), F.lower(F.concat("p_type", F.lit(" by "), F.when(F.col("p_size") % 2 == 0, "size").otherwise(F.col("p_brand")))).alias("question"))
    return C.cards(q, spark.createDataFrame(ENTRIES, "kind string, word string, note string"))


@query("WITH o AS (SELECT DISTINCT l_orderkey AS q, l_returnflag || l_linestatus AS i FROM lineitem), p AS (SELECT a.i AS l, b.i AS r, count(*) AS n FROM o a JOIN o b ON a.q = b.q AND a.i < b.i GROUP BY 1, 2), u AS (SELECT l, r, round(n / max(n) OVER (), 6) AS f FROM p), e AS (SELECT DISTINCT least(x, y) AS l, greatest(x, y) AS r FROM (SELECT DISTINCT l_returnflag || l_linestatus AS x FROM lineitem) a, (SELECT DISTINCT l_returnflag || l_linestatus AS y FROM lineitem) b WHERE x <> y AND left(x, 1) <> left(y, 1)) SELECT l AS \"left\", r AS \"right\", round(0.6 * 0.5 + 0.4 * coalesce(f, 0), 6) AS confidence FROM e LEFT JOIN u USING (l, r)")
def calibrated_edges(t, spark):
    """Edges' confidence of six parts evidence and four parts use."""
    from ..operators import recall as L

    items = t("lineitem").select("l_orderkey", F.concat("l_returnflag", "l_linestatus").alias("i"))
    used = L.usage_pairs(items, "l_orderkey", "i").select("left", "right", "frequency")
    kinds = items.select("i").distinct()
    a, b = kinds.select(F.col("i").alias("left")), kinds.select(F.col("i").alias("right"))
    edges = a.join(b, (F.col("left") < F.col("right")) & (F.substring("left", 1, 1) != F.substring("right", 1, 1)))
    return edges.join(used, ["left", "right"], "left").select("left", "right", L.calibrated(F.lit(0.5), F.col("frequency")).alias("confidence"))


@query("SELECT p_partkey, coalesce(nullif(trim(CASE WHEN p_size % 3 = 0 THEN ' ' ELSE p_name END), ''), nullif(trim(CASE WHEN p_size % 2 = 0 THEN '' ELSE p_brand END), ''), 'unknown') AS label FROM part")
def two_level_fallback(t, spark):
    """A name, else its code, else unknown; blanks count as missing."""
    name = F.when(F.col("p_size") % 3 == 0, " ").otherwise(F.col("p_name"))
    code = F.when(F.col("p_size") % 2 == 0, "").otherwise(F.col("p_brand"))
    return t("part").select("p_partkey", F.coalesce(F.nullif(F.trim(name), F.lit("")), F.nullif(F.trim(code), F.lit("")), F.lit("unknown")).alias("label"))


@query("SELECT o_orderkey FROM orders WHERE (CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderdate END IS NULL OR o_orderdate <= DATE '1998-06-01') AND (CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderdate + INTERVAL 400 DAY END IS NULL OR o_orderdate + INTERVAL 400 DAY >= DATE '1998-06-01')")
def rows_in_effect(t, spark):
    """Rows in effect on a day; a window's missing end is open."""
    begin = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderdate"))
    end = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderdate") + F.expr("INTERVAL 400 DAY"))
    on = F.lit("1998-06-01").cast("date")
    return t("orders").where((begin.isNull() | (F.col("o_orderdate") <= on)) & (end.isNull() | (end >= on))).select("o_orderkey")


@query("WITH g AS (SELECT event_type, user_id, CASE WHEN value >= 50 THEN 1.0 WHEN value >= 20 THEN 0.5 ELSE 0.0 END AS grade, CASE event_type WHEN 'purchase' THEN 3 WHEN 'click' THEN 2 ELSE 1 END AS weight FROM events) SELECT event_type, round(sum(grade * weight) / sum(weight), 6) AS accuracy, count(*) FILTER (WHERE grade = 1) AS right_answers FROM g GROUP BY ROLLUP (event_type)")
def weighted_answer_accuracy(t, spark):
    """Graded answers by kind and in all, each by its weight."""
    grade = F.when(F.col("value") >= 50, 1.0).when(F.col("value") >= 20, 0.5).otherwise(0.0)
    weight = F.when(F.col("event_type") == "purchase", 3).when(F.col("event_type") == "click", 2).otherwise(1)
    g = t("events").select("event_type", grade.alias("grade"), weight.alias("weight"))
    return g.rollup("event_type").agg(F.round(F.sum(F.col("grade") * F.col("weight")) / F.sum("weight"), 6).alias("accuracy"), F.count_if(F.col("grade") == 1).alias("right_answers"))


@query("SELECT 'nation' AS table_name, count(*) AS row_count FROM nation UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem")
def table_row_counts(t, spark):
    return t.counts(("nation", "orders", "lineitem"))


@query("SELECT CASE WHEN o_orderdate >= DATE '1998-09-14' THEN 'current_value' WHEN o_orderdate >= DATE '1998-09-01' THEN 'previous_value' ELSE 'year_ago_value' END AS period, count(*) AS orders FROM orders WHERE (o_orderdate >= DATE '1998-09-14' AND o_orderdate < DATE '1998-09-16') OR (o_orderdate >= DATE '1998-09-07' AND o_orderdate < DATE '1998-09-09') OR (o_orderdate >= DATE '1997-09-15' AND o_orderdate < DATE '1997-09-17') GROUP BY 1")
def weekly_periods(t, spark):
    """A Wednesday's week so far against the same days of the week before and a year ago."""
    from datetime import date

    from ..functions.timewin import weekly

    out = None
    for name, w in weekly(date(1998, 9, 16)).items():
        part = t("orders").where(w.on("o_orderdate")).select(F.lit(name).alias("period"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("period").agg(F.count("*").alias("orders"))
