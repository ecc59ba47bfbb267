"""Profiles and inferred edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profiling as P
from ..operators.relations import array_overlap
from .registry import query

PROFILED = ["c_name", "c_mktsegment", "c_nationkey", "c_acctbal"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS rows, count(*) FILTER (WHERE nullif(CAST({c} AS VARCHAR), '') IS NULL) AS nulls, count(DISTINCT nullif(CAST({c} AS VARCHAR), '')) AS \"distinct\" FROM customer" for c in PROFILED))
def column_profile(t, spark):
    return P.profile(t("customer"), PROFILED)


@query("SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY \"column\" ORDER BY n DESC, value) AS rank FROM (SELECT 'o_orderpriority' AS \"column\", o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderstatus', o_orderstatus, count(*) FROM orders GROUP BY 2)) WHERE rank <= 3")
def top_column_values(t, spark):
    return P.top_values(t("orders"), ["o_orderpriority", "o_orderstatus"], 3).withColumn("rank", F.col("rank").cast("long"))


@query("SELECT *, round(common / nullif(least(left_n, right_n), 0), 6) AS overlap FROM (SELECT (SELECT count(DISTINCT o_custkey) FROM orders) AS left_n, (SELECT count(DISTINCT c_custkey) FROM customer) AS right_n, (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)) AS common)")
def value_overlap_edges(t, spark):
    return P.value_overlap(t("orders"), "o_custkey", t("customer"), "c_custkey")


@query("SELECT 'l_quantity' AS \"left\", 'l_extendedprice' AS \"right\", round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem UNION ALL SELECT 'l_discount', 'l_tax', round(corr(l_discount, l_tax), 6) FROM lineitem")
def pearson_pairs(t, spark):
    return P.pearson(t("lineitem"), [("l_quantity", "l_extendedprice"), ("l_discount", "l_tax")])


@query("WITH r AS (SELECT rank() OVER (ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_acctbal) - 1) / 2.0 AS a, rank() OVER (ORDER BY c_nationkey) + (count(*) OVER (PARTITION BY c_nationkey) - 1) / 2.0 AS b FROM customer) SELECT round(corr(a, b), 6) AS rho FROM r")
def spearman_pairs(t, spark):
    return P.spearman(t("customer"), "c_acctbal", "c_nationkey")


def _top(table: str, col: str) -> str:
    return f"SELECT value, n / sum(n) OVER () AS w FROM (SELECT CAST({col} AS VARCHAR) AS value, count(*) AS n FROM {table} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)"


@query(f"WITH x AS ({_top('customer', 'c_nationkey')}), y AS ({_top('supplier', 's_nationkey')}) SELECT round(least(dl, dr) / greatest(dl, dr) * s, 6) AS similarity FROM (SELECT count(DISTINCT c_nationkey) AS dl FROM customer), (SELECT count(DISTINCT s_nationkey) AS dr FROM supplier), (SELECT coalesce(sum(least(x.w, y.w)), 0) AS s FROM x JOIN y USING (value))")
def distribution_similarity(t, spark):
    return P.distribution_similarity(t("customer"), "c_nationkey", t("supplier"), "s_nationkey")


@query("WITH v AS (SELECT DISTINCT CAST(c_nationkey AS VARCHAR) AS code FROM customer), d AS (SELECT 'nation' AS dict, CAST(n_nationkey AS VARCHAR) AS code FROM nation UNION ALL SELECT 'region', CAST(r_regionkey AS VARCHAR) FROM region) SELECT dict, count(DISTINCT code) AS hits, round(count(DISTINCT code) / (SELECT count(*) FROM v), 6) AS coverage FROM d JOIN v USING (code) GROUP BY 1 HAVING coverage >= 0.8")
def code_table_match(t, spark):
    codes = t("nation").select(F.lit("nation").alias("dict"), F.col("n_nationkey").cast("string").alias("code")).unionByName(t("region").select(F.lit("region").alias("dict"), F.col("r_regionkey").cast("string").alias("code")))
    return P.code_match(t("customer"), "c_nationkey", codes)


@query("WITH e AS (SELECT l_suppkey AS src, l_partkey AS dst, l_discount AS confidence FROM lineitem) SELECT least(src, dst) AS src, greatest(src, dst) AS dst, max(confidence) AS confidence FROM e GROUP BY 1, 2")
def canonical_edges(t, spark):
    return P.canonical_edges(t("lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_discount").alias("confidence")))


def tagged(t):
    """The suppliers of lines and all suppliers, each with two tags."""
    a = t("lineitem").select("l_suppkey").distinct().select(F.col("l_suppkey").alias("a"), F.array((F.col("l_suppkey") % 7).cast("long"), (7 + F.col("l_suppkey") % 3).cast("long")).alias("tags"))
    b = t("supplier").select(F.col("s_suppkey").alias("b"), F.array((F.col("s_nationkey") % 7).cast("long"), (7 + F.col("s_suppkey") % 3).cast("long")).alias("tags"))
    return a, b


@query("SELECT DISTINCT a, s_suppkey AS b FROM (SELECT DISTINCT l_suppkey AS a, unnest([l_suppkey % 7, 7 + l_suppkey % 3]) AS tag FROM lineitem) x JOIN (SELECT s_suppkey, unnest([s_nationkey % 7, 7 + s_suppkey % 3]) AS tag FROM supplier) y USING (tag)")
def shared_tag_pairs(t, spark):
    """Each supplier of a line with each supplier that it shares a tag with, over whole tables."""
    return array_overlap(*tagged(t), "a", "b", "tags")


@query("SELECT a, count(DISTINCT s_suppkey) AS partners FROM (SELECT DISTINCT l_suppkey AS a, unnest([l_suppkey % 7, 7 + l_suppkey % 3]) AS tag FROM lineitem) x JOIN (SELECT s_suppkey, unnest([s_nationkey % 7, 7 + s_suppkey % 3]) AS tag FROM supplier) y USING (tag) GROUP BY a")
def shared_tag_counts(t, spark):
    """With how many suppliers each supplier of a line shares a tag, over whole tables: sets of tags meet, and not their suppliers."""
    from ..operators.relations import overlap_counts

    return overlap_counts(*tagged(t), "a", "b", "tags")


@query("SELECT DISTINCT a.l_suppkey AS a, b.s_suppkey AS b FROM (SELECT DISTINCT l_suppkey FROM lineitem) a JOIN supplier b ON a.l_suppkey % 7 = b.s_nationkey % 7")
def all_shared_tag_pairs(t, spark):
    a = t("lineitem").select("l_suppkey").distinct().select(F.col("l_suppkey").alias("x"), F.array(F.col("l_suppkey") % 7).alias("tags"))
    b = t("supplier").select(F.col("s_suppkey").alias("y"), F.array((F.col("s_nationkey") % 7).cast("long")).alias("tags"))
    return array_overlap(a, b, "x", "y", "tags")


#: Statements as a log holds them, by the remainder of an order's key; {} is the order's status. The last can't be read.
LOGGED = (
    "SELECT o.total, c.name FROM shop.orders o JOIN customer AS c ON o.cid = c.id WHERE o.state = '{}' -- JOIN nation n ON n.k = c.k",
    "select `x`.`total` from orders x, lineitem l where l.oid = x.id /* FROM part p */ and x.note like '%FROM supplier s%{}'",
    "WITH recent AS (SELECT o.id, o.cid FROM orders o WHERE o.state = '{}') SELECT r.id, c.name FROM recent r LEFT JOIN customer c ON c.id = r.cid",
    "SELECT c.name FROM customer c WHERE EXISTS (SELECT 1 FROM orders o JOIN lineitem l ON l.oid = o.id WHERE o.cid = c.id AND l.flag = '{}')",
    "SELECT (o.total FROM orders o WHERE o.state = '{}'",
)


def logged_pairs() -> str:
    """The pairs of each statement above, told by hand, for the comparison."""
    pairs = {
        0: [("customer", "", "orders", ""), ("customer", "name", "orders", "state"), ("customer", "name", "orders", "total"), ("orders", "state", "orders", "total")],
        1: [("lineitem", "", "orders", ""), ("lineitem", "oid", "orders", "id"), ("lineitem", "oid", "orders", "note"), ("lineitem", "oid", "orders", "total"), ("orders", "id", "orders", "note"), ("orders", "id", "orders", "total"), ("orders", "note", "orders", "total")],
        2: [("customer", "name", "orders", "cid"), ("customer", "name", "orders", "id"), ("customer", "name", "orders", "state"), ("orders", "cid", "orders", "id"), ("orders", "cid", "orders", "state"), ("orders", "id", "orders", "state")],
        3: [("lineitem", "", "orders", ""), ("customer", "id", "customer", "name"), ("customer", "id", "lineitem", "flag"), ("customer", "id", "orders", "cid"), ("customer", "name", "lineitem", "flag"), ("customer", "name", "orders", "cid"), ("lineitem", "flag", "orders", "cid")],
    }
    rows = ", ".join("({}, '{}', '{}', '{}', '{}')".format(k, *p) for k, ps in pairs.items() for p in ps)
    return f"(VALUES {rows}) AS p(k, left_table, left_column, right_table, right_column)"


@query(f"WITH c AS (SELECT lower(o_orderpriority) AS source, left_table, left_column, right_table, right_column, count(*) AS n FROM orders JOIN {logged_pairs()} ON o_orderkey % 5 = k GROUP BY ALL) SELECT source, left_table, left_column, right_table, right_column, n, round(n / max(n) OVER (PARTITION BY source), 6) AS frequency FROM c")
def mined_usage(t, spark):
    """Pairs of tables and columns mined from a log of statements, one for each order, of which a fifth can't be read; equal ones are read once."""
    from ..operators import sqllog

    log = t("orders").select("o_orderpriority", F.replace(F.element_at(F.array(*[F.lit(s) for s in LOGGED]), (F.col("o_orderkey") % 5 + 1).cast("int")), F.lit("{}"), F.col("o_orderstatus")).alias("sql"))
    once = log.groupBy("o_orderpriority", "sql").agg(F.count("*").alias("times"))
    out = sqllog.usage_edges(sqllog.mined(once, "sql"), "o_orderpriority", weight="times")
    return out.select("source", "left_table", "left_column", "right_table", "right_column", "n", F.round("frequency", 6).alias("frequency"))
