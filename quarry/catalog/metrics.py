"""Metric families, digests, cards, report sections and dashboards."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..functions import timewin
from ..operators import analysis as A
from ..operators import cards as C
from ..plans.model import Dimension, Metric, QuerySpec, Registry, compose
from ..plans.sales import AMOUNT, COST, REVENUE, SALES
from .registry import query
from .sales import GEO, LINES, SUM, TODAY

QTY = "CAST(l_quantity AS DECIMAL(18,2))"
FACT = {"sales_amount": f"CAST(coalesce(sum({AMOUNT}), 0) AS DOUBLE)", "sales_quantity": f"CAST(coalesce(sum({QTY}), 0) AS DOUBLE)", "sales_cost": f"CAST(coalesce(sum({COST}), 0) AS DOUBLE)", "sales_revenue": f"CAST(coalesce(sum({REVENUE}), 0) AS DOUBLE)", "gross_profit": f"CAST(coalesce(sum({AMOUNT} - {COST}), 0) AS DOUBLE)", "gross_margin": f"round(CAST(sum({AMOUNT} - {COST}) AS DOUBLE) / nullif(CAST(sum({AMOUNT}) AS DOUBLE), 0), 6)"}


def listed(metrics: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {n}" for n, e in metrics.items())


@query(f"SELECT strftime(o_orderdate, '%Y') AS year, {listed(FACT)} FROM {LINES} GROUP BY 1")
def fact_metrics_by_year(t, spark):
    """Amount, quantity, cost, revenue, profit and margin in one scan."""
    return compose(SALES, QuerySpec(tuple(FACT), ("year",)), t)


AFTER = {"tax_amount": f"CAST(coalesce(sum({REVENUE} - {AMOUNT}), 0) AS DOUBLE)", "discount_amount": "CAST(coalesce(sum(CAST(l_extendedprice * l_discount AS DECIMAL(18,4))), 0) AS DOUBLE)", "returned_amount": f"CAST(coalesce(sum(CASE WHEN l_returnflag = 'R' THEN {AMOUNT} END), 0) AS DOUBLE)", "return_count": "count(CASE WHEN l_returnflag = 'R' THEN 1 END)", "return_rate": "round(CAST(count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS DOUBLE) / nullif(count(*), 0), 6)", "line_count": "count(*)", "active_skus": "count(DISTINCT l_partkey)"}


@query(f"SELECT coalesce(nullif(trim(s_name), ''), 'unregistered') AS supplier, {listed(AFTER)} FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1")
def after_sales_by_supplier(t, spark):
    return compose(SALES, QuerySpec(tuple(AFTER), ("supplier",)), t)


ORDERS = {"order_amount": "CAST(coalesce(sum(CAST(o_totalprice AS DECIMAL(18,2))), 0) AS DOUBLE)", "order_count": "count(DISTINCT o_orderkey)", "buyers": "count(DISTINCT o_custkey)", "open_orders": "count(DISTINCT CASE WHEN o_orderstatus = 'O' THEN o_orderkey END)", "largest_order": "max(o_totalprice)", "first_order": "strftime(min(o_orderdate), '%Y-%m-%d')"}


@query(f"SELECT strftime(o_orderdate, '%Y') AS year, o_orderpriority AS priority, {listed(ORDERS)} FROM orders GROUP BY 1, 2")
def order_metrics_by_year(t, spark):
    return compose(SALES, QuerySpec(tuple(ORDERS), ("year", "priority")), t)


@query("SELECT coalesce(nullif(trim(n_name), ''), 'unregistered') AS nation, CAST(coalesce(sum(CAST(c_acctbal AS DECIMAL(18,2))), 0) AS DOUBLE) AS account_balance, CAST(coalesce(sum(CASE WHEN c_acctbal < 0 THEN CAST(c_acctbal AS DECIMAL(18,2)) END), 0) AS DOUBLE) AS credit_balance, count(DISTINCT c_custkey) AS customers_total FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def account_metrics_by_nation(t, spark):
    return compose(SALES, QuerySpec(("account_balance", "credit_balance", "customers_total"), ("nation",)), t)


@query("SELECT coalesce(nullif(trim(p_brand), ''), 'unregistered') AS brand, count(DISTINCT p_partkey) AS stock_skus, CAST(coalesce(sum(CAST(p_retailprice AS DECIMAL(18,2))), 0) AS DOUBLE) AS stock_value FROM part GROUP BY 1")
def stock_metrics_by_brand(t, spark):
    return compose(SALES, QuerySpec(("stock_skus", "stock_value"), ("brand",)), t)


OPS_SQL = {
    "sessions": "count(DISTINCT CASE WHEN event_type = 'view' THEN event_id END)",
    "event_sales": "CAST(coalesce(sum(CASE WHEN event_type = 'purchase' THEN CAST(value AS DECIMAL(18,4)) END), 0) AS DOUBLE)",
    "event_cost": "CAST(coalesce(sum(CASE WHEN event_type = 'click' THEN CAST(value AS DECIMAL(18,4)) END), 0) AS DOUBLE)",
    "cost_ratio": "round(CAST(sum(CASE WHEN event_type = 'click' THEN CAST(value AS DECIMAL(18,4)) END) AS DOUBLE) / nullif(CAST(sum(CASE WHEN event_type = 'purchase' THEN CAST(value AS DECIMAL(18,4)) END) AS DOUBLE), 0), 6)",
    "roi": "round(CAST(sum(CASE WHEN event_type = 'purchase' THEN CAST(value AS DECIMAL(18,4)) END) AS DOUBLE) / nullif(CAST(sum(CASE WHEN event_type = 'click' THEN CAST(value AS DECIMAL(18,4)) END) AS DOUBLE), 0), 6)",
    "person_day_price": "round(CAST(sum(CASE WHEN event_type = 'click' THEN CAST(value AS DECIMAL(18,4)) END) AS DOUBLE) / nullif(count(DISTINCT CASE WHEN event_type = 'click' THEN CAST(user_id AS VARCHAR(20)) || ' ' || CAST(CAST(ts AS DATE) AS VARCHAR(20)) END), 0), 6)",
    "visits": "count(DISTINCT CASE WHEN event_type = 'signup' THEN event_id END)",
    "visited_users": "count(DISTINCT CASE WHEN event_type = 'signup' THEN user_id END)",
    "avg_view": "round(avg(CASE WHEN event_type = 'view' THEN value END), 6)",
    "avg_click": "round(avg(CASE WHEN event_type = 'click' THEN value END), 6)",
    "avg_purchase": "round(avg(CASE WHEN event_type = 'purchase' THEN value END), 6)",
    "avg_signup": "round(avg(CASE WHEN event_type = 'signup' THEN value END), 6)",
    "avg_error": "round(avg(CASE WHEN event_type = 'error' THEN value END), 6)",
}
OPERATIONS = Registry(metrics={n: Metric(n, "events", e, "ts") for n, e in OPS_SQL.items()}, dimensions={"day": Dimension("day", "", "", grain="day"), "user": Dimension("user", "events", "user_id")})


@query(f"SELECT strftime(ts, '%Y-%m-%d') AS day, {listed(OPS_SQL)} FROM events WHERE ts >= DATE '2024-01-08' AND ts < DATE '2024-01-15' GROUP BY 1")
def operation_metrics(t, spark):
    """Thirteen operation metrics of a week, by day."""
    return compose(OPERATIONS, QuerySpec(tuple(OPS_SQL), ("day",), window=timewin.days(date(2024, 1, 8), 7)), t)


GROUPS = {f"cost_{k}": ["l_extendedprice", "l_tax", "l_discount", "l_quantity"][: 1 + k % 4] for k in range(10)}
_TOTAL = {c: f"coalesce(sum(CAST({c} AS DECIMAL(18,4))), 0)" for c in ("l_extendedprice", "l_tax", "l_discount", "l_quantity")}


@query(" UNION ALL ".join(f"SELECT '{g}' AS category, CAST({' + '.join(_TOTAL[c] for c in cols)} AS DOUBLE) AS total FROM lineitem" for g, cols in GROUPS.items()))
def ten_cost_groups(t, spark):
    """Wide cost columns as ten category rows, from one scan."""
    return A.unpivot_groups(t("lineitem"), GROUPS, "category", "total")


@query(f"SELECT 'cost_6' AS category, CAST({' + '.join(_TOTAL[c] for c in GROUPS['cost_6'])} AS DOUBLE) AS total FROM lineitem")
def named_cost_group(t, spark):
    return A.unpivot_groups(t("lineitem"), {"cost_6": GROUPS["cost_6"]}, "category", "total")


def windows(*names):
    day = timewin.days(date(TODAY.year, TODAY.month, TODAY.day))
    mtd = timewin.to_date(timewin.parse("this month", TODAY), TODAY)
    return {k: v for k, v in {"day": day, "mtd": mtd, "previous": timewin.previous("this month", TODAY, True), "year_ago": timewin.year_ago("this month", TODAY, True)}.items() if k in names}


def parts():
    return {"a": F.expr(AMOUNT), "q": F.expr(QTY), "r": F.expr(REVENUE), "c": F.expr(COST)}


ZERO = lambda c: F.coalesce(c, F.lit(0))
KPIS = {"amount": lambda s: ZERO(s["a"]), "quantity": lambda s: ZERO(s["q"]), "revenue": lambda s: ZERO(s["r"]), "cost": lambda s: ZERO(s["c"]), "profit": lambda s: ZERO(s["a"] - s["c"]), "margin": lambda s: F.round((s["a"] - s["c"]).cast("double") / F.nullif(s["a"].cast("double"), F.lit(0.0)), 6)}
KPI_SQL = {"amount": "coalesce(sum(a), 0)", "quantity": "coalesce(sum(q), 0)", "revenue": "coalesce(sum(r), 0)", "cost": "coalesce(sum(c), 0)", "profit": "coalesce(sum(a) - sum(c), 0)", "margin": "round(CAST(sum(a) - sum(c) AS DOUBLE) / nullif(CAST(sum(a) AS DOUBLE), 0), 6)"}
BOUNDS = {"day": ("1998-09-15", "1998-09-16"), "mtd": ("1998-09-01", "1998-09-16"), "previous": ("1998-08-01", "1998-08-16"), "year_ago": ("1997-09-01", "1997-09-16")}


def kpi_table(metrics, names, extra=""):
    rows = f"(SELECT {AMOUNT} AS a, {QTY} AS q, {REVENUE} AS r, {COST} AS c, o_orderdate AS d{extra} FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
    cells = {w: {m: KPI_SQL[m].replace("sum(a)", f"sum(CASE WHEN d >= DATE '{b}' AND d < DATE '{e}' THEN a END)").replace("sum(q)", f"sum(CASE WHEN d >= DATE '{b}' AND d < DATE '{e}' THEN q END)").replace("sum(r)", f"sum(CASE WHEN d >= DATE '{b}' AND d < DATE '{e}' THEN r END)").replace("sum(c)", f"sum(CASE WHEN d >= DATE '{b}' AND d < DATE '{e}' THEN c END)") for m in metrics} for w, (b, e) in BOUNDS.items() if w in names}
    return " UNION ALL ".join(f"SELECT '{m}' AS metric, {', '.join(f'CAST({cells[w][m]} AS DOUBLE) AS {w}' for w in names)} FROM {rows}" for m in metrics)


def sold(t):
    return t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))


@query(kpi_table(KPIS, ("day", "mtd", "previous", "year_ago")))
def six_kpi_digest(t, spark):
    """Six figures over the day, the month to date, and the same days of the month and the year before, in one scan."""
    return C.digest(sold(t), "o_orderdate", parts(), KPIS, windows("day", "mtd", "previous", "year_ago"))


WEEK = {"mtd": ("1998-09-14", "1998-09-16"), "previous": ("1998-09-07", "1998-09-09"), "year_ago": ("1997-09-15", "1997-09-17")}


def weekly_sql():
    global BOUNDS
    kept, BOUNDS = BOUNDS, WEEK
    inner = kpi_table(("amount", "quantity", "profit", "margin"), ("mtd", "previous", "year_ago"))
    BOUNDS = kept
    rate = lambda b: f"round(CASE WHEN metric = 'margin' THEN mtd - {b} ELSE (mtd - {b}) / nullif(abs({b}), 0) END, 6)"
    return f"SELECT *, {rate('previous')} AS previous_change, {rate('year_ago')} AS year_ago_change FROM ({inner})"


@query(weekly_sql())
def weekly_four_metrics(t, spark):
    """Four metrics of the week so far, as far into the week before, and the same weekdays a year ago, with changes."""
    w = {"mtd": timewin.to_date(timewin.parse("this week", TODAY), TODAY), "previous": timewin.previous("this week", TODAY, True), "year_ago": timewin.year_ago("this week", TODAY, True)}
    table = C.digest(sold(t), "o_orderdate", parts(), {k: KPIS[k] for k in ("amount", "quantity", "profit", "margin")}, w)
    return C.with_rates(table, "mtd", ["previous", "year_ago"], ("margin",))


KINDS = {"brand": "p_brand", "shop": "s_name", "employee": "n_name", "customer": "c_name", "goods": "p_name", "category": "p_type"}
WIDE = "lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey"


@query(" UNION ALL ".join(f"SELECT '{k}' AS kind, CAST({c} AS VARCHAR) AS name, count(DISTINCT o_orderkey) AS orders, count(DISTINCT o_custkey) AS customers, count(DISTINCT l_partkey) AS skus, count(DISTINCT strftime(o_orderdate, '%Y-%m')) AS months, strftime(max(o_orderdate), '%Y-%m-%d') AS last_order FROM {WIDE} WHERE {c} IS NOT NULL GROUP BY 2" for k, c in KINDS.items()))
def entity_cards(t, spark):
    """Cards of six kinds of entities."""
    lines = sold(t).join(t("customer"), F.expr("o_custkey = c_custkey")).join(t("nation"), F.expr("c_nationkey = n_nationkey")).join(t("part"), F.expr("l_partkey = p_partkey")).join(t("supplier"), F.expr("l_suppkey = s_suppkey"))
    return C.entity_cards(lines, KINDS, "o_orderdate")


@query("SELECT c_custkey, c_name, balance, seen_on FROM customer LEFT JOIN (SELECT user_id, arg_max(value, event_id) AS balance, strftime(max(ts), '%Y-%m-%d') AS seen_on FROM events GROUP BY 1) ON c_custkey = user_id")
def customer_latest_balance(t, spark):
    e = t("events").groupBy("user_id").agg(F.max_by("value", "event_id").alias("balance"), F.date_format(F.max("ts"), "yyyy-MM-dd").alias("seen_on"))
    return t("customer").join(e, F.col("c_custkey") == F.col("user_id"), "left").select("c_custkey", "c_name", "balance", "seen_on")


@query("SELECT CAST(count(value) AS DOUBLE) AS n, CAST(count(DISTINCT user_id) AS DOUBLE) AS users, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, max(value) AS most, min(value) AS least FROM events")
def card_aggregates(t, spark):
    """The six aggregates that a card can show of a result's column."""
    cells = {"n": ("value", "count"), "users": ("user_id", "distinct"), "total": ("value", "sum"), "mean": ("value", "avg"), "most": ("value", "max"), "least": ("value", "min")}
    out = t("events").agg(*[C.AGGREGATES[how](c).cast("double").alias(n) for n, (c, how) in cells.items()])
    return out.withColumns({"total": F.round("total", 4), "mean": F.round("mean", 6)})


CUSTOMER_SECTION = f"SELECT c_custkey AS customer_code, coalesce(nullif(trim(c_name), ''), 'unregistered') AS customer, {SUM} AS sales_amount FROM {GEO} GROUP BY 1, 2"


@query(f"{CUSTOMER_SECTION} ORDER BY sales_amount DESC, customer_code LIMIT 20")
def customer_section(t, spark):
    """A section by customer has the code beside the name, the largest first."""
    return C.section(compose(SALES, QuerySpec(("sales_amount",), ("customer_code", "customer")), t), "customer_code", "sales_amount", False)


@query(f"SELECT strftime(o_orderdate, '%Y-%m') AS month, {SUM} AS sales_amount FROM {LINES} GROUP BY 1 ORDER BY 1 LIMIT 20")
def trend_section(t, spark):
    return C.section(compose(SALES, QuerySpec(("sales_amount",), ("month",)), t), "month", "sales_amount", True)


@query(f"WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS l, {SUM} AS v FROM {LINES} GROUP BY 1), n AS (SELECT coalesce(nullif(trim(n_name), ''), 'unregistered') AS l, {SUM} AS v FROM {GEO} GROUP BY 1) SELECT 'trend' AS section, 'change' AS kind, l AS label, round((v - p) / nullif(abs(p), 0), 6) AS figure FROM (SELECT l, v, lag(v) OVER (ORDER BY l) AS p FROM m) WHERE l = (SELECT max(l) FROM m) UNION ALL SELECT 'nation', 'share', arg_max(l, v), round(max(v) / sum(v), 6) FROM n")
def section_highlights(t, spark):
    m = compose(SALES, QuerySpec(("sales_amount",), ("month",)), t).select(F.lit("trend").alias("section"), F.lit(True).alias("trend"), F.col("month").alias("label"), F.col("sales_amount").alias("value"))
    n = compose(SALES, QuerySpec(("sales_amount",), ("nation",)), t).select(F.lit("nation").alias("section"), F.lit(False).alias("trend"), F.col("nation").alias("label"), F.col("sales_amount").alias("value"))
    return C.highlights(m.unionByName(n))


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS asked, count(*) FILTER (WHERE event_type = 'error') AS failed, count(*) FILTER (WHERE event_type IN ('view', 'click')) AS answered, round(100.0 * count(*) FILTER (WHERE event_type IN ('view', 'click')) / count(*), 4) AS answered_pct, round(avg(value) FILTER (WHERE event_type <> 'error'), 6) AS mean_value FROM events GROUP BY 1")
def quality_dashboard(t, spark):
    e = F.col("event_type")
    good = e.isin("view", "click")
    return t("events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("asked"), F.count_if(e == "error").alias("failed"), F.count_if(good).alias("answered"), F.round(100.0 * F.count_if(good) / F.count("*"), 4).alias("answered_pct"), F.round(F.avg(F.when(e != "error", F.col("value"))), 6).alias("mean_value"))


@query(f"SELECT l_partkey AS partkey, count(DISTINCT o_orderkey) AS orders, CAST(sum({QTY}) AS DOUBLE) AS qty, CAST(sum({AMOUNT}) AS DOUBLE) AS amount, strftime(max(o_orderdate), '%Y-%m-%d') AS last_order FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE contains(c_name, '00000002') GROUP BY 1 ORDER BY 4 DESC, 1 LIMIT 20")
def goods_of_customer(t, spark):
    return C.goods_of(t("lineitem"), t("orders"), t("customer").where(F.contains("c_name", F.lit("00000002"))), F.expr(AMOUNT), 20)


@query(f"SELECT p_partkey, max(p_name) AS name, count(DISTINCT o_orderkey) AS orders, CAST(sum({QTY}) AS DOUBLE) AS qty, CAST(sum({AMOUNT}) AS DOUBLE) AS amount, strftime(max(o_orderdate), '%Y-%m-%d') AS last_order FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1")
def goods_twins(t, spark):
    """What the purchase graph says of goods, from the tables: orders, quantity, amount, last order."""
    # as many tasks as the session has shuffle partitions: an order's lines are held in a hash table, in bytes several times those shuffled
    orders = t("orders").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "o_orderkey")
    rows = t("lineitem").join(orders, F.expr("l_orderkey = o_orderkey")).groupBy("l_partkey").agg(F.countDistinct("o_orderkey").alias("orders"), F.sum(F.expr(QTY)).cast("double").alias("qty"), F.sum(F.expr(AMOUNT)).cast("double").alias("amount"), F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("last_order"))
    return rows.join(t("part"), F.col("l_partkey") == F.col("p_partkey")).select("p_partkey", F.col("p_name").alias("name"), "orders", "qty", "amount", "last_order")
