"""The registry of the test tables' sales model."""

from __future__ import annotations

from .model import Dimension, Edge, Metric, Registry, Snapshot

#: Line amounts as exact decimals; the ratio divides sums and is null on an empty base.
AMOUNT = "CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))"
COST = "CAST(l_extendedprice * 0.6 AS DECIMAL(18,4))"
REVENUE = "CAST(l_extendedprice * (1 - l_discount) * (1 + l_tax) AS DECIMAL(18,6))"

SALES = Registry(
    metrics={m.name: m for m in (
        Metric("sales_amount", "lineitem", f"CAST(coalesce(sum({AMOUNT}), 0) AS DOUBLE)", "o_orderdate", aliases=("sales", "amount", "销售额")),
        Metric("sales_quantity", "lineitem", "CAST(coalesce(sum(CAST(l_quantity AS DECIMAL(18,2))), 0) AS DOUBLE)", "o_orderdate", aliases=("quantity", "销量")),
        Metric("sales_cost", "lineitem", f"CAST(coalesce(sum({COST}), 0) AS DOUBLE)", "o_orderdate", aliases=("cost",)),
        Metric("gross_profit", "lineitem", f"CAST(coalesce(sum({AMOUNT} - {COST}), 0) AS DOUBLE)", "o_orderdate", aliases=("profit", "毛利")),
        Metric("gross_margin", "lineitem", f"round(CAST(sum({AMOUNT} - {COST}) AS DOUBLE) / nullif(CAST(sum({AMOUNT}) AS DOUBLE), 0), 6)", "o_orderdate", aliases=("margin", "毛利率")),
        Metric("order_amount", "orders", "CAST(coalesce(sum(CAST(o_totalprice AS DECIMAL(18,2))), 0) AS DOUBLE)", "o_orderdate"),
        Metric("order_count", "orders", "count(DISTINCT o_orderkey)", "o_orderdate", distinct=True, aliases=("orders", "订单数")),
        Metric("buyers", "orders", "count(DISTINCT o_custkey)", "o_orderdate", distinct=True, aliases=("customers",)),
        Metric("order_value", "orders", "round(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / nullif(count(DISTINCT o_orderkey), 0), 2)", "o_orderdate", aliases=("average order value",)),
        Metric("distinct_lines", "lineitem", "count(*)", None, dedup_keys=("l_orderkey", "l_linenumber", "l_returnflag"), dimensions=("return_flag",)),
        Metric("account_balance", "customer", "CAST(coalesce(sum(CAST(c_acctbal AS DECIMAL(18,2))), 0) AS DOUBLE)"),
        Metric("sales_revenue", "lineitem", f"CAST(coalesce(sum({REVENUE}), 0) AS DOUBLE)", "o_orderdate", aliases=("revenue", "收入")),
        Metric("tax_amount", "lineitem", f"CAST(coalesce(sum({REVENUE} - {AMOUNT}), 0) AS DOUBLE)", "o_orderdate", aliases=("tax",)),
        Metric("discount_amount", "lineitem", "CAST(coalesce(sum(CAST(l_extendedprice * l_discount AS DECIMAL(18,4))), 0) AS DOUBLE)", "o_orderdate", aliases=("discount",)),
        Metric("returned_amount", "lineitem", f"CAST(coalesce(sum(CASE WHEN l_returnflag = 'R' THEN {AMOUNT} END), 0) AS DOUBLE)", "o_orderdate", aliases=("refund", "退款")),
        Metric("return_count", "lineitem", "count(CASE WHEN l_returnflag = 'R' THEN 1 END)", "o_orderdate", aliases=("returns", "售后数")),
        Metric("return_rate", "lineitem", "round(CAST(count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS DOUBLE) / nullif(count(*), 0), 6)", "o_orderdate", aliases=("return rate",)),
        Metric("line_count", "lineitem", "count(*)", "o_orderdate", aliases=("lines",)),
        Metric("open_orders", "orders", "count(DISTINCT CASE WHEN o_orderstatus = 'O' THEN o_orderkey END)", "o_orderdate", distinct=True, aliases=("open orders",)),
        Metric("largest_order", "orders", "max(o_totalprice)", "o_orderdate", aliases=("largest order",)),
        Metric("first_order", "orders", "date_format(min(o_orderdate), 'yyyy-MM-dd')", "o_orderdate"),
        Metric("credit_balance", "customer", "CAST(coalesce(sum(CASE WHEN c_acctbal < 0 THEN CAST(c_acctbal AS DECIMAL(18,2)) END), 0) AS DOUBLE)"),
        Metric("customers_total", "customer", "count(DISTINCT c_custkey)", distinct=True),
        Metric("supplier_balance", "supplier", "CAST(coalesce(sum(CAST(s_acctbal AS DECIMAL(18,2))), 0) AS DOUBLE)"),
        Metric("stock_skus", "part", "count(DISTINCT p_partkey)", distinct=True),
        Metric("stock_value", "part", "CAST(coalesce(sum(CAST(p_retailprice AS DECIMAL(18,2))), 0) AS DOUBLE)"),
        Metric("latest_value", "events", "CAST(coalesce(sum(CAST(value AS DECIMAL(18,4))), 0) AS DOUBLE)", aliases=("balance",)),
        Metric("users_seen", "events", "count(DISTINCT user_id)", distinct=True),
        Metric("active_skus", "lineitem", "count(DISTINCT l_partkey)", "o_orderdate", distinct=True),
    )},
    dimensions={d.name: d for d in (
        Dimension("region", "region", "r_name", "unregistered", aliases=("region", "大区")),
        Dimension("nation", "nation", "n_name", "unregistered", aliases=("nation", "country")),
        Dimension("segment", "customer", "c_mktsegment", "unregistered", aliases=("segment",)),
        Dimension("customer", "customer", "c_name", "unregistered", aliases=("customer", "客户")),
        Dimension("part", "part", "p_name", "unregistered", aliases=("part", "goods", "商品")),
        Dimension("brand", "part", "p_brand", "unregistered", aliases=("brand", "品牌")),
        Dimension("customer_code", "customer", "c_custkey"),
        Dimension("part_code", "part", "p_partkey"),
        Dimension("nation_code", "nation", "n_nationkey"),
        Dimension("part_type", "part", "p_type", "unregistered", multi=True),
        Dimension("supplier", "supplier", "s_name", "unregistered", aliases=("supplier",)),
        Dimension("line_status", "lineitem", "l_linestatus"),
        Dimension("event_type", "events", "event_type", "unregistered"),
        Dimension("year", "", "", grain="year", aliases=("year", "yearly", "年")),
        Dimension("return_flag", "lineitem", "l_returnflag"),
        Dimension("status", "orders", "CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' WHEN 'P' THEN 'partial' ELSE 'other' END"),
        Dimension("priority", "orders", "o_orderpriority"),
        Dimension("month", "", "", grain="month", aliases=("month", "monthly", "月")),
        Dimension("day", "", "", grain="day", aliases=("day", "daily", "日")),
    )},
    edges=[
        Edge("lineitem", "l_orderkey", "orders", "o_orderkey"),
        Edge("lineitem", "l_partkey", "part", "p_partkey"),
        Edge("lineitem", "l_suppkey", "supplier", "s_suppkey"),
        Edge("orders", "o_custkey", "customer", "c_custkey"),
        Edge("customer", "c_nationkey", "nation", "n_nationkey"),
        Edge("nation", "n_regionkey", "region", "r_regionkey"),
    ],
    snapshots={"events": Snapshot(("user_id",), ("ts", "event_id"))},
)
