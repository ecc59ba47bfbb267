"""Sales, order, governance and analysis queries."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..functions import timewin
from ..operators import analysis as A
from ..operators import relations as R
from ..plans.governance import Binding, Principal, run_scoped, scoped
from ..plans.model import QuerySpec, Snapshot, TimeWindow, compose, latest
from ..plans.sales import AMOUNT, COST, SALES
from ..sources.tables import ParquetSource
from .registry import query

YEAR = TimeWindow(date(1997, 1, 1), date(1998, 1, 1))
TODAY = date(1998, 9, 15)
LINES = "lineitem LEFT JOIN orders ON l_orderkey = o_orderkey"
CUSTOMERS = "LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey"
GEO = f"{LINES} {CUSTOMERS} LEFT JOIN region ON n_regionkey = r_regionkey"
SUM = f"CAST(coalesce(sum({AMOUNT}), 0) AS DOUBLE)"
IN_YEAR = "o_orderdate >= DATE '1997-01-01' AND o_orderdate < DATE '1998-01-01'"


def ask(t, *metrics, **spec):
    return compose(SALES, QuerySpec(metrics, **spec), t)


@query(f"SELECT {SUM} AS sales_amount, CAST(coalesce(sum(CAST(l_quantity AS DECIMAL(18,2))), 0) AS DOUBLE) AS sales_quantity FROM {LINES} WHERE {IN_YEAR}")
def sales_total(t, spark):
    return ask(t, "sales_amount", "sales_quantity", window=YEAR)


@query(f"SELECT coalesce(nullif(trim(r_name), ''), 'unregistered') AS region, {SUM} AS sales_amount, CAST(coalesce(sum({AMOUNT} - {COST}), 0) AS DOUBLE) AS gross_profit FROM {GEO} WHERE {IN_YEAR} GROUP BY 1")
def sales_by_region(t, spark):
    """The flagship: two metrics by a dimension four joins away, in one scan."""
    return ask(t, "sales_amount", "gross_profit", dimensions=("region",), window=YEAR)


@query(f"SELECT coalesce(nullif(trim(n_name), ''), 'unregistered') AS nation, strftime(o_orderdate, '%Y-%m') AS month, {SUM} AS sales_amount FROM {GEO} WHERE {IN_YEAR} GROUP BY 1, 2")
def sales_by_nation_month(t, spark):
    return ask(t, "sales_amount", dimensions=("nation", "month"), window=YEAR)


@query(f"SELECT coalesce(nullif(trim(c_name), ''), 'unregistered') AS customer, {SUM} AS sales_amount FROM {GEO} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def sales_top5_customers(t, spark):
    return ask(t, "sales_amount", dimensions=("customer",), sort="sales_amount", limit=timewin.top_n("top 5 customers"))


@query(f"SELECT coalesce(nullif(trim(p_name), ''), 'unregistered') AS part, {SUM} AS sales_amount FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY 1 ORDER BY 2, 1 LIMIT 3")
def sales_bottom3_parts(t, spark):
    return ask(t, "sales_amount", dimensions=("part",), sort="sales_amount", ascending=timewin.ascending("lowest 3 parts"), limit=timewin.top_n("lowest 3 parts"))


@query(f"SELECT coalesce(nullif(trim(n_name), ''), 'unregistered') AS nation, {SUM} AS sales_amount FROM {GEO} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1 OFFSET 1")
def second_ranked_nation(t, spark):
    return ask(t, "sales_amount", dimensions=("nation",), sort="sales_amount", limit=1, offset=1)


@query("SELECT coalesce(nullif(trim(c_mktsegment), ''), 'unregistered') AS segment, count(DISTINCT o_orderkey) AS order_count, count(DISTINCT o_custkey) AS buyers, round(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / nullif(count(DISTINCT o_orderkey), 0), 2) AS order_value FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def order_metrics_by_segment(t, spark):
    return ask(t, "order_count", "buyers", "order_value", dimensions=("segment",))


@query(f"SELECT coalesce(nullif(trim(r_name), ''), 'unregistered') AS region, round(CAST(sum({AMOUNT} - {COST}) AS DOUBLE) / nullif(CAST(sum({AMOUNT}) AS DOUBLE), 0), 6) AS gross_margin FROM {GEO} GROUP BY 1")
def gross_margin_by_region(t, spark):
    return ask(t, "gross_margin", dimensions=("region",))


@query("SELECT return_flag, count(*) AS distinct_lines FROM (SELECT DISTINCT l_returnflag AS return_flag, l_orderkey, l_linenumber, l_returnflag FROM lineitem) GROUP BY 1")
def lines_deduped_sales(t, spark):
    return ask(t, "distinct_lines", dimensions=("return_flag",))


@query("SELECT CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' WHEN 'P' THEN 'partial' ELSE 'other' END AS status, count(DISTINCT o_orderkey) AS order_count FROM orders GROUP BY 1")
def orders_by_status_label(t, spark):
    return ask(t, "order_count", dimensions=("status",))


@query(f"SELECT o_orderpriority AS priority, count(DISTINCT l_partkey) AS active_skus FROM {LINES} WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY 1")
def filtered_priority_skus(t, spark):
    return ask(t, "active_skus", dimensions=("priority",), equals=(("priority", ("1-URGENT", "2-HIGH")),))


@query(f"SELECT coalesce(nullif(trim(p_brand), ''), 'unregistered') AS brand, {SUM} AS sales_amount FROM lineitem LEFT JOIN part ON l_partkey = p_partkey WHERE coalesce(nullif(trim(p_brand), ''), 'unregistered') <> 'unregistered' GROUP BY 1")
def unregistered_bucket_excluded(t, spark):
    return ask(t, "sales_amount", dimensions=("brand",), no_bucket=("brand",))


@query("SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def latest_event_per_user(t, spark):
    return latest(t("events"), Snapshot(("user_id",), ("ts", "event_id"))).select("event_id", "user_id", "event_type")


@query("SELECT coalesce(nullif(trim(event_type), ''), 'unregistered') AS event_type, count(DISTINCT user_id) AS users_seen, CAST(coalesce(sum(CAST(value AS DECIMAL(18,4))), 0) AS DOUBLE) AS latest_value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1 GROUP BY 1")
def balance_snapshot_total(t, spark):
    """Each user's latest row, by the snapshot that the model declares, then the aggregate."""
    return ask(t, "users_seen", "latest_value", dimensions=("event_type",))


@query("SELECT count(*) AS orders, count(c_custkey) AS matched FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0")
def scope_in_on_left_join(t, spark):
    c = t("customer").where("c_acctbal > 0")
    return t("orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left").agg(F.count("*").alias("orders"), F.count("c_custkey").alias("matched"))


@query(f"SELECT o_orderpriority, count(*) AS orders, CAST(sum(a) AS DOUBLE) AS amount FROM orders JOIN (SELECT l_orderkey, sum({AMOUNT}) AS a FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey GROUP BY 1")
def prejoin_aggregate(t, spark):
    d = t("lineitem").groupBy("l_orderkey").agg(F.expr(f"sum({AMOUNT})").alias("a"))
    return t("orders").join(d, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderpriority").agg(F.count("*").alias("orders"), F.sum("a").cast("double").alias("amount"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size = 7)")
def orders_with_part_semi(t, spark):
    parts = t("part").where("p_size = 7").select("p_partkey")
    lines = t("lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey"), "left_semi").select("l_orderkey")
    return t("orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey", "o_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P' AND o_totalprice > 200000)")
def customers_without_orders_anti(t, spark):
    """Customers without a large order that is partly delivered."""
    large = t("orders").where("o_orderstatus = 'P' AND o_totalprice > 200000")
    return t("customer").join(large, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


BINDINGS = {"orders": Binding(customer_col="o_custkey"), "lineitem": Binding("via", via_table="orders", via_col="l_orderkey", via_key="o_orderkey"), "nation": Binding("global"), "customer": Binding(customer_col="c_custkey", owner_col="c_nationkey")}
WHO = Principal("ann", customers=tuple(range(0, 400, 3)))


@query("SELECT n_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_nationkey IN (1, 2, 3) GROUP BY 1")
def scoped_sales_nation_set(t, spark):
    """A statement gated and run on views that hold the principal's rows alone."""
    sql = "SELECT n_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name"
    return run_scoped(spark, sql, lambda s, n: ParquetSource(s, t.root)(n), BINDINGS, Principal("bob", owners=(1, 2, 3))).df


@query("SELECT l_returnflag, count(*) AS lines FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey < 400 AND o_custkey % 3 = 0) GROUP BY 1")
def scoped_lines_via_orders(t, spark):
    return scoped("lineitem", t, BINDINGS, WHO).groupBy("l_returnflag").agg(F.count("*").alias("lines"))


MTD, PREV, AGO = timewin.to_date(timewin.parse("this month", TODAY), TODAY), timewin.previous("this month", TODAY, True), timewin.year_ago("this month", TODAY, True)


@query("SELECT CAST(coalesce(sum(CASE WHEN o_orderdate >= DATE '1998-09-01' AND o_orderdate < DATE '1998-09-16' THEN p END), 0) AS DOUBLE) AS current_value, CAST(coalesce(sum(CASE WHEN o_orderdate >= DATE '1998-08-01' AND o_orderdate < DATE '1998-08-16' THEN p END), 0) AS DOUBLE) AS previous_value, CAST(coalesce(sum(CASE WHEN o_orderdate >= DATE '1997-09-01' AND o_orderdate < DATE '1997-09-16' THEN p END), 0) AS DOUBLE) AS year_ago_value FROM (SELECT o_orderdate, CAST(o_totalprice AS DECIMAL(18,2)) AS p FROM orders)")
def mtd_vs_previous_vs_year_ago(t, spark):
    return A.compare_windows(t("orders"), "o_orderdate", F.col("o_totalprice").cast("decimal(18,2)"), {"current_value": MTD, "previous_value": PREV, "year_ago_value": AGO})


@query("""WITH w AS (SELECT o_orderpriority AS priority, CAST(coalesce(sum(CASE WHEN o_orderdate >= DATE '1998-09-14' AND o_orderdate < DATE '1998-09-16' THEN p END), 0) AS DOUBLE) AS current_value, CAST(coalesce(sum(CASE WHEN o_orderdate >= DATE '1998-09-07' AND o_orderdate < DATE '1998-09-09' THEN p END), 0) AS DOUBLE) AS previous_value FROM (SELECT o_orderpriority, o_orderdate, CAST(o_totalprice AS DECIMAL(18,2)) AS p FROM orders) WHERE (o_orderdate >= DATE '1998-09-14' AND o_orderdate < DATE '1998-09-16') OR (o_orderdate >= DATE '1998-09-07' AND o_orderdate < DATE '1998-09-09') GROUP BY 1)
SELECT *, round((current_value - previous_value) / nullif(abs(previous_value), 0), 6) AS rate, CASE WHEN current_value - previous_value > 1e-6 THEN 'up' WHEN current_value - previous_value < -1e-6 THEN 'down' ELSE 'flat' END AS direction FROM w""")
def weekly_core_table(t, spark):
    w = {"current_value": timewin.to_date(timewin.parse("this week", TODAY), TODAY), "previous_value": timewin.previous("this week", TODAY, True)}
    c, p = F.col("current_value"), F.col("previous_value")
    rows = A.compare_windows(t("orders").withColumnRenamed("o_orderpriority", "priority"), "o_orderdate", F.col("o_totalprice").cast("decimal(18,2)"), w, ["priority"])
    return rows.withColumns({"rate": F.round(A.change(c, p), 6), "direction": A.direction(c, p)})


NATION_SALES = f"SELECT coalesce(nullif(trim(n_name), ''), 'unregistered') AS nation, {SUM} AS sales_amount FROM {GEO} GROUP BY 1"
MONTHLY = f"SELECT strftime(o_orderdate, '%Y-%m') AS month, {SUM} AS sales_amount FROM {LINES} GROUP BY 1"


@query(f"SELECT nation, sales_amount, rank, round(sales_amount / nullif(total, 0), 6) AS share FROM (SELECT *, sum(greatest(sales_amount, 0)) OVER () AS total, row_number() OVER (ORDER BY sales_amount DESC, nation) AS rank FROM ({NATION_SALES})) WHERE rank <= 3")
def contribution_top3(t, spark):
    return A.contribution(ask(t, "sales_amount", dimensions=("nation",)), "nation", "sales_amount").withColumn("rank", F.col("rank").cast("long"))


@query(f"SELECT round(max(sales_amount) / sum(sales_amount), 6) AS leader_share, round(sum(CASE WHEN rank <= 3 THEN sales_amount END) / sum(sales_amount), 6) AS cr FROM (SELECT *, row_number() OVER (ORDER BY sales_amount DESC) AS rank FROM ({NATION_SALES}))")
def cr3_share(t, spark):
    return A.concentration(ask(t, "sales_amount", dimensions=("nation",)), "sales_amount")


@query(f"SELECT *, round(sales_amount - previous, 4) AS delta, round((sales_amount - previous) / nullif(abs(previous), 0), 6) AS rate FROM (SELECT month, sales_amount, lag(sales_amount) OVER (ORDER BY month) AS previous FROM ({MONTHLY}))")
def monthly_lag_change(t, spark):
    return A.lag_change(ask(t, "sales_amount", dimensions=("month",)), "month", "sales_amount")


@query(f"SELECT first_value, last_value, periods, round((last_value - first_value) / nullif(abs(first_value), 0), 6) AS rate FROM (SELECT arg_min(sales_amount, month) AS first_value, arg_max(sales_amount, month) AS last_value, count(*) AS periods FROM ({MONTHLY}) WHERE month <> '2001-08')")
def first_last_trend(t, spark):
    return A.first_last(ask(t, "sales_amount", dimensions=("month",)), "month", "sales_amount", skip="2001-08")


@query(f"SELECT round(e, 2) AS expected, round(f, 2) AS found, abs(f - e) <= greatest(0.01, abs(e) * 1e-9) AS balanced, coalesce(u, 0) > 0.05 * abs(e) AS many_unknown FROM (SELECT sum(sales_amount) AS f, sum(CASE WHEN nation = 'unregistered' THEN sales_amount END) AS u FROM ({NATION_SALES})) CROSS JOIN (SELECT {SUM} AS e FROM lineitem)")
def reconcile_sections(t, spark):
    return A.reconcile(ask(t, "sales_amount", dimensions=("nation",)), ask(t, "sales_amount"), "nation", "sales_amount", "unregistered")


@query("SELECT o_custkey, count(DISTINCT o_orderkey) AS orders FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderkey) >= 2")
def repurchase_customers(t, spark):
    return t("orders").groupBy("o_custkey").agg(F.countDistinct("o_orderkey").alias("orders")).where("orders >= 2")


@query("SELECT strftime(d, '%Y-%m-%d') AS day, coalesce(n, 0) AS events FROM (SELECT unnest(generate_series(DATE '2024-01-20', DATE '2024-02-10', INTERVAL 1 DAY)) AS d) LEFT JOIN (SELECT CAST(ts AS DATE) AS e, count(*) AS n FROM events GROUP BY 1) ON d = e")
def calendar_filled_daily_events(t, spark):
    return A.fill_days(t("events"), "ts", "2024-01-20", "2024-02-10", F.count("*"), "events")


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1")
def route_latency_percentiles(t, spark):
    from ..operators.iterated import exact_percentiles

    got = exact_percentiles(t("events"), ["event_type"], "value", [0.5, 0.95])
    at = lambda p: F.round(F.max(F.when(F.col("p") == p, F.col("value"))), 6)
    return got.groupBy("event_type").agg(at(0.5).alias("p50"), at(0.95).alias("p95"))


@query("SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.5), 6) AS p50, round(quantile_cont(l_extendedprice, 0.95), 6) AS p95, round(quantile_cont(l_extendedprice, 0.999), 6) AS p999 FROM lineitem GROUP BY 1 UNION ALL SELECT NULL, round(quantile_cont(l_quantity, 0.5), 6), round(quantile_cont(l_quantity, 0.95), 6), round(quantile_cont(l_quantity, 0.999), 6) FROM lineitem")
def exact_percentiles_of_lines(t, spark):
    """Percentiles of large groups and, as one group of all rows, of a column of few values."""
    from ..operators.iterated import exact_percentiles

    at = lambda p: F.round(F.max(F.when(F.col("p") == p, F.col("value"))), 6)
    shown = [at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.999).alias("p999")]
    flags = exact_percentiles(t("lineitem"), ["l_returnflag"], "l_extendedprice", [0.5, 0.95, 0.999]).groupBy("l_returnflag").agg(*shown)
    whole = exact_percentiles(t("lineitem"), [], "l_quantity", [0.5, 0.95, 0.999]).agg(*shown).select(F.lit(None).cast("string").alias("l_returnflag"), "p50", "p95", "p999")
    return flags.unionByName(whole)


@query("SELECT o_orderpriority, count(*) AS orders, count(*) FILTER (WHERE o_orderstatus = 'F') AS finished, round(100.0 * count(*) FILTER (WHERE o_orderstatus = 'F') / count(*), 4) AS finished_pct FROM orders GROUP BY 1")
def conditional_rates(t, spark):
    done = F.count_if(F.col("o_orderstatus") == "F")
    return t("orders").groupBy("o_orderpriority").agg(F.count("*").alias("orders"), done.alias("finished"), F.round(100.0 * done / F.count("*"), 4).alias("finished_pct"))


@query("SELECT unnest(['price', 'rates']) AS category, unnest([CAST(coalesce(sum(CAST(l_extendedprice AS DECIMAL(18,4))), 0) AS DOUBLE), CAST(coalesce(sum(CAST(l_discount AS DECIMAL(18,4))), 0) + coalesce(sum(CAST(l_tax AS DECIMAL(18,4))), 0) AS DOUBLE)]) AS total FROM lineitem")
def unpivot_cost_groups(t, spark):
    return A.unpivot_groups(t("lineitem"), {"price": ["l_extendedprice"], "rates": ["l_discount", "l_tax"]}, "category", "total")


EDGES = f"SELECT o_custkey AS custkey, l_partkey AS partkey, n_regionkey AS regionkey, CAST(sum({AMOUNT}) AS DOUBLE) AS amount, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS qty FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, 3"


def edges(t):
    return R.purchase_edges(t("lineitem"), t("orders"), t("customer"), t("nation"), F.expr(AMOUNT))


@query(EDGES)
def purchase_edges(t, spark):
    return edges(t)


@query(f"SELECT custkey, CAST(sum(CAST(amount AS DECIMAL(18,4))) AS DOUBLE) AS amount, CAST(sum(CAST(qty AS DECIMAL(18,2))) AS DOUBLE) AS qty FROM ({EDGES}) WHERE partkey IN (SELECT p_partkey FROM part WHERE p_size = 7) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def buyers_of_part(t, spark):
    return R.buyers_of(edges(t), t("part").where("p_size = 7"), 20)


@query(f"SELECT custkey, CAST(sum(CAST(amount AS DECIMAL(18,4))) AS DOUBLE) AS amount, CAST(sum(CAST(qty AS DECIMAL(18,2))) AS DOUBLE) AS qty FROM ({EDGES}) WHERE regionkey = 1 AND partkey IN (SELECT p_partkey FROM part WHERE p_size = 7) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def buyers_filtered_by_region(t, spark):
    return R.buyers_of(edges(t).where("regionkey = 1"), t("part").where("p_size = 7"), 20)


@query(f"WITH e AS ({EDGES}), k AS (SELECT p_partkey FROM part WHERE p_partkey < 3) SELECT partkey, count(DISTINCT custkey) AS buyers, CAST(sum(CAST(amount AS DECIMAL(18,4))) AS DOUBLE) AS amount FROM e WHERE custkey IN (SELECT custkey FROM e WHERE partkey IN (SELECT * FROM k)) AND partkey NOT IN (SELECT * FROM k) GROUP BY 1 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 20")
def copurchase_parts(t, spark):
    return R.copurchase(t("lineitem"), t("orders"), t("part").where("p_partkey < 3"), F.expr(AMOUNT), 20)


@query("SELECT day, CAST(sum(n) AS BIGINT) AS n FROM (SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, count(*) AS n FROM orders GROUP BY 1 UNION ALL SELECT strftime(l_shipdate, '%Y-%m-%d'), count(*) FROM lineitem GROUP BY 1) GROUP BY 1")
def union_all_streams(t, spark):
    a = t("orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    return a.unionByName(t("lineitem").select(F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"))).groupBy("day").agg(F.count("*").alias("n"))


@query("SELECT strftime(ts, '%H:00') AS hour, event_type, count(*) AS events FROM events GROUP BY 1, 2")
def events_per_hour(t, spark):
    return t("events").groupBy(F.date_format("ts", "HH:00").alias("hour"), "event_type").agg(F.count("*").alias("events"))


@query("SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds FROM events GROUP BY 1 HAVING count(DISTINCT event_type) >= 3")
def ordered_string_aggregate(t, spark):
    return t("events").groupBy("user_id").agg(F.array_join(F.sort_array(F.collect_set("event_type")), ",").alias("kinds"), F.size(F.collect_set("event_type")).alias("_n")).where("_n >= 3").drop("_n")


@query("SELECT c_custkey, c_name, orders, amount, last_order FROM customer JOIN (SELECT o_custkey, count(*) AS orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS amount, strftime(max(o_orderdate), '%Y-%m-%d') AS last_order FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def customer_cards(t, spark):
    o = t("orders").groupBy("o_custkey").agg(F.count("*").alias("orders"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("amount"), F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("last_order"))
    return t("customer").join(o, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "c_name", "orders", "amount", "last_order")


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, o_totalprice, round(o_totalprice / (SELECT avg(o_totalprice) FROM orders), 6) AS ratio FROM orders ORDER BY o_orderdate DESC, abs(o_totalprice) DESC, o_orderkey LIMIT 50")
def order_detail_rows(t, spark):
    mean = t("orders").agg(F.avg("o_totalprice").alias("_m"))
    top = t("orders").orderBy(F.desc("o_orderdate"), F.abs("o_totalprice").desc(), "o_orderkey").limit(50)
    return top.crossJoin(F.broadcast(mean)).select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "o_totalprice", F.round(F.col("o_totalprice") / F.col("_m"), 6).alias("ratio"))


@query("SELECT o_orderkey, greatest(date_diff('day', o_orderdate, s) + 1, 1) AS days FROM (SELECT o_orderkey, o_orderdate, max(l_shipdate) AS s FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2)")
def order_durations(t, spark):
    last = t("lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("s"))
    return t("orders").join(last, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", F.greatest(F.datediff("s", "o_orderdate") + 1, F.lit(1)).cast("long").alias("days"))
