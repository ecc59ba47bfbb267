"""Value words, qualifiers, codes, labels, statements with parameters, and join shapes."""

from __future__ import annotations

from dataclasses import replace
from datetime import date

from pyspark.sql import functions as F

from ..functions import timewin
from ..plans import values as V
from ..plans.checks import spec_of
from ..plans.governance import Binding, Principal, expand_tree, run_scoped
from ..plans.model import ALL_TIME, Edge, QuerySpec, Snapshot, compose, detail
from ..plans.sales import AMOUNT, SALES
from ..sources.tables import ParquetSource
from .registry import query
from .sales import GEO, LINES, SUM


def ask(t, registry, *metrics, **spec):
    return compose(registry, QuerySpec(metrics, **spec), t)


@query(f"SELECT l_linestatus AS line_status, {SUM} AS sales_amount FROM {LINES} WHERE o_orderdate >= DATE '1000-01-01' AND o_orderdate < DATE '9999-12-31' GROUP BY 1")
def sales_all_time(t, spark):
    return ask(t, SALES, "sales_amount", dimensions=("line_status",), window=ALL_TIME)


SOLVENT = replace(SALES, scopes={"customer": "c_acctbal > 0", "orders": "o_orderstatus <> 'P'"})


@query("SELECT coalesce(nullif(trim(c_mktsegment), ''), 'unregistered') AS segment, count(DISTINCT o_orderkey) AS order_count FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0 WHERE o_orderstatus <> 'P' GROUP BY 1")
def composed_scopes(t, spark):
    """The base table's scope filters its rows; a joined table's stands in the join's condition, so that base rows stay."""
    return ask(t, SOLVENT, "order_count", dimensions=("segment",))


@query(f"SELECT coalesce(nullif(trim(n_name), ''), 'unregistered') AS nation, {SUM} AS sales_amount FROM {GEO} GROUP BY 1 ORDER BY 2 DESC, 1")
def sorted_without_limit(t, spark):
    return ask(t, SALES, "sales_amount", dimensions=("nation",), sort="sales_amount")


LAST_DAY = replace(SALES, snapshots={"orders": Snapshot(at="o_orderdate")})


@query("SELECT o_orderpriority AS priority, count(DISTINCT o_orderkey) AS order_count FROM orders WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders) GROUP BY 1")
def orders_at_last_date(t, spark):
    return ask(t, LAST_DAY, "order_count", dimensions=("priority",))


MASTER = replace(SALES, edges=[*SALES.edges, Edge("customer", "c_custkey", "events", "user_id", "1:1")])


@query("SELECT coalesce(nullif(trim(event_type), ''), 'unregistered') AS event_type, count(DISTINCT c_custkey) AS customers_total FROM customer LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1) ON c_custkey = user_id GROUP BY 1")
def snapshot_joined_to_master(t, spark):
    return ask(t, MASTER, "customers_total", dimensions=("event_type",))


def place_values(t):
    n = t("nation").select(F.lit("nation").alias("table"), F.lit("n_name").alias("column"), F.col("n_name").alias("name"), F.col("n_name").alias("code"))
    r = t("region").select(F.lit("region").alias("table"), F.lit("r_name").alias("column"), F.col("r_name").alias("name"), F.col("r_name").alias("code"))
    return n.unionByName(r).withColumn("kind", F.lit("eq"))


def place_questions(t):
    return t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").cast("long").alias("q_id"), F.concat(F.lit("sales of "), F.lower("n_name"), F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit(" and "), "r_name")).otherwise(F.lit(""))).alias("question"))


PLACES = "(SELECT n_name AS name, 'nation' AS \"table\" FROM nation UNION ALL SELECT r_name, 'region' FROM region)"
ASKED = "(SELECT CAST(n_nationkey AS BIGINT) AS q_id, 'sales of ' || lower(n_name) || CASE WHEN n_nationkey % 3 = 0 THEN ' and ' || r_name ELSE '' END AS question FROM nation JOIN region ON n_regionkey = r_regionkey)"
NAMED = f"WITH h AS (SELECT q_id, p.name, p.\"table\" FROM {ASKED} q JOIN {PLACES} p ON contains(lower(q.question), lower(p.name))), k AS (SELECT * FROM h WHERE NOT EXISTS (SELECT 1 FROM h o WHERE o.q_id = h.q_id AND length(o.name) > length(h.name) AND contains(lower(o.name), lower(h.name))))"


@query(f"{NAMED} SELECT q_id, \"table\", name FROM k")
def value_word_filters(t, spark):
    return V.value_filters(place_questions(t), place_values(t)).select("q_id", "table", "name")


@query(f"{NAMED} SELECT q.q_id, CASE WHEN n IS NULL THEN 'none' WHEN n = 1 THEN 'one' ELSE 'conflict' END AS status, CASE WHEN n = 1 THEN c END AS place FROM {ASKED} q LEFT JOIN (SELECT q_id, count(DISTINCT name) AS n, min(name) AS c FROM k GROUP BY 1) USING (q_id)")
def place_qualifiers(t, spark):
    return V.qualifiers(place_questions(t), place_values(t).select("name", "code"))


@query(f"SELECT coalesce(nullif(trim(n_name), ''), 'unregistered') AS nation, {SUM} AS sales_amount FROM {GEO} WHERE r_name = 'ASIA' AND o_orderdate >= DATE '1997-07-01' AND o_orderdate < DATE '1998-01-01' GROUP BY 1 ORDER BY 2 DESC, 1")
def sales_in_named_region(t, spark):
    """A question with a metric, a dimension, a year before 2000 and a value word."""
    question = "sales by nation in Asia in second half of 1997"
    names = V.value_filters(spark.createDataFrame([(1, question)], "q_id long, question string"), place_values(t)).select("table", "code").collect()
    spec = V.with_values(SALES, spec_of(SALES, question, date(1998, 9, 15)), [(r.table, r.code) for r in names])
    return compose(SALES, replace(spec, limit=None), t)


@query(f"SELECT coalesce(nullif(trim(p_brand), ''), 'unregistered') AS brand, {SUM} AS sales_amount FROM lineitem LEFT JOIN part ON l_partkey = p_partkey WHERE contains(coalesce(nullif(trim(p_type), ''), 'unregistered'), 'STAND') OR contains(coalesce(nullif(trim(p_type), ''), 'unregistered'), 'PROMO') GROUP BY 1")
def multi_value_column(t, spark):
    return ask(t, SALES, "sales_amount", dimensions=("brand",), equals=(("part_type", ("STAND", "PROMO")),))


@query(f"SELECT coalesce(nullif(trim(p_brand), ''), 'unregistered') AS brand, {SUM} AS sales_amount FROM lineitem LEFT JOIN part ON l_partkey = p_partkey WHERE NOT (coalesce(contains(coalesce(nullif(trim(p_name), ''), 'unregistered'), 'widget'), false) OR coalesce(CAST(p_partkey AS VARCHAR) = '7', false)) GROUP BY 1")
def negated_match(t, spark):
    return ask(t, SALES, "sales_amount", dimensions=("brand",), excludes=(("part", "widget", "part_code", "7"),))


@query("SELECT l_returnflag, count(*) AS lines FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE contains(lower(p_name), 'cold')) GROUP BY 1")
def lines_of_named_goods(t, spark):
    return V.fragment_rows(t("lineitem"), "l_partkey", t("part"), "p_partkey", "p_name", " Cold ", 1_000_000).groupBy("l_returnflag").agg(F.count("*").alias("lines"))


@query("SELECT o_orderkey AS order_no, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE o_orderstatus END || ',' || CASE left(o_orderpriority, 1) WHEN '1' THEN 'urgent' WHEN '2' THEN 'high' ELSE left(o_orderpriority, 1) END AS state FROM orders")
def display_labels(t, spark):
    labels = spark.createDataFrame([("s", "F", "finished"), ("s", "O", "open"), ("s", "1", "urgent"), ("s", "2", "high")], "kind string, code string, label string")
    rows = t("orders").select("o_orderkey", F.concat_ws(",", "o_orderstatus", F.substring("o_orderpriority", 1, 1)).alias("codes"))
    return V.presented(rows, {"o_orderkey": "order_no", "codes": "state"}, labels, {"codes": "s"})


@query("SELECT o_orderpriority, count(*) AS orders FROM orders WHERE o_orderdate >= DATE '1997-01-01' AND o_orderdate < DATE '1998-01-01' AND o_orderstatus IN ('F', 'O') GROUP BY 1")
def statement_with_parameters(t, spark):
    """A fixed statement: its time column is filled in, its dates and its list are parameters."""
    text = V.time_slot("SELECT o_orderpriority, count(*) AS orders FROM {orders} WHERE {time} >= :begin AND {time} < :end AND o_orderstatus IN (:states) GROUP BY o_orderpriority", "o_orderdate")
    return V.statement(spark, text, {"orders": t("orders")}, begin=date(1997, 1, 1), end=date(1998, 1, 1), states=["F", "O"])


@query("WITH d AS (SELECT p_partkey AS id, upper('see ' || p_brand || '-' || p_size || ' and ' || left(p_brand || '-' || p_size, 7)) AS text FROM part), c AS (SELECT id, unnest(list_distinct(regexp_extract_all(text, '([A-Z0-9][A-Z0-9-]*[0-9][A-Z0-9-]*)', 1))) AS code FROM d), n AS (SELECT DISTINCT s_suppkey % 50 || '-' || '13' AS code, s_suppkey % 50 AS document FROM supplier), e AS (SELECT DISTINCT id, c.code, n.document FROM c JOIN n USING (code) WHERE length(c.code) >= 4), p AS (SELECT c.id, c.code, count(DISTINCT n.document) AS k, min(n.document) AS document FROM c JOIN n ON starts_with(n.code, c.code) AND length(n.code) > length(c.code) WHERE length(c.code) >= 4 AND NOT EXISTS (SELECT 1 FROM e WHERE e.id = c.id AND e.code = c.code) GROUP BY 1, 2) SELECT id, code, document FROM e UNION ALL SELECT id, code, document FROM p WHERE k = 1")
def document_codes(t, spark):
    text = F.concat(F.lit("see "), "p_brand", F.lit("-"), "p_size", F.lit(" and "), F.substring(F.concat("p_brand", F.lit("-"), "p_size"), 1, 7))
    known = t("supplier").select(F.concat((F.col("s_suppkey") % 50).cast("string"), F.lit("-13")).alias("code"), (F.col("s_suppkey") % 50).alias("document"))
    return V.resolved_codes(t("part").select(F.col("p_partkey").alias("id"), text.alias("text")), known)


@query("SELECT DISTINCT CASE WHEN l_suppkey = 3 THEN l_partkey ELSE l_suppkey END AS other FROM lineitem WHERE (l_suppkey = 3 OR l_partkey = 3) AND NOT (l_suppkey = 3 AND l_partkey = 3)")
def or_join_links(t, spark):
    """Links whose source or target is the seed: two equality joins, so that neither is a loop over pairs."""
    links = t("lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"))
    a = links.where("src = 3 AND dst <> 3").select(F.col("dst").alias("other"))
    return a.unionByName(links.where("dst = 3 AND src <> 3").select(F.col("src").alias("other"))).distinct()


@query("SELECT o_orderkey, c_name, n_name, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' END AS status FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey")
def multi_lookup_join(t, spark):
    words = spark.createDataFrame([("status", "F", "finished"), ("status", "O", "open"), ("other", "P", "wrong")], "kind string, code string, label string")
    d = words.where("kind = 'status'").select("code", F.col("label").alias("status"))
    rows = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"), "left").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return rows.join(d, F.col("o_orderstatus") == F.col("code"), "left").select("o_orderkey", "c_name", "n_name", "status")


@query("WITH RECURSIVE n AS (SELECT c_custkey AS id, CASE WHEN c_custkey > 0 THEN c_custkey // 3 END AS parent FROM customer), s AS (SELECT id FROM n WHERE id = 4 UNION SELECT n.id FROM n JOIN s ON n.parent = s.id) SELECT id FROM s")
def department_subtree(t, spark):
    nodes = t("customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") > 0, F.floor(F.col("c_custkey") / 3)).alias("parent"))
    return expand_tree(nodes, [4])


@query("SELECT c_nationkey, max(c_name) AS label, count(*) AS customers FROM customer GROUP BY 1")
def label_per_code(t, spark):
    return t("customer").groupBy("c_nationkey").agg(F.max("c_name").alias("label"), F.count("*").alias("customers"))


@query("SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 1")
def latest_event_overall(t, spark):
    return V.latest_overall(t("events"), "ts", "event_id")


def detail_columns():
    return [F.col("l_orderkey"), F.col("l_linenumber"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"), "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", "l_discount", "l_tax", F.expr(f"CAST({AMOUNT} AS DOUBLE)").alias("amount"), F.expr("round((l_extendedprice * (1 - l_discount) - l_extendedprice * 0.6) / nullif(l_extendedprice * (1 - l_discount), 0), 6)").alias("margin")]


SHIPPED = replace(SALES, metrics={"sales_amount": replace(SALES.metrics["sales_amount"], time_col="l_shipdate")})


@query(f"SELECT l_orderkey, l_linenumber, strftime(l_shipdate, '%Y-%m-%d') AS day, l_partkey, l_suppkey, l_returnflag, l_linestatus, l_quantity, l_extendedprice, l_discount, l_tax, CAST({AMOUNT} AS DOUBLE) AS amount, round((l_extendedprice * (1 - l_discount) - l_extendedprice * 0.6) / nullif(l_extendedprice * (1 - l_discount), 0), 6) AS margin FROM (SELECT * FROM lineitem WHERE l_shipdate >= DATE '1997-01-01' AND l_shipdate < DATE '1998-01-01' ORDER BY l_shipdate DESC, abs(l_extendedprice) DESC, l_orderkey LIMIT 500)")
def line_details(t, spark):
    """Thirteen columns of the lines of a year, the latest first; a detail has 500 rows at most."""
    return detail(SHIPPED, QuerySpec(("sales_amount",), window=timewin.months(date(1997, 1, 1), 12), sort="l_extendedprice", limit=9999), t, detail_columns(), "l_orderkey")


@query("SELECT event_id, value, (SELECT count(*) FROM events) AS row_count FROM events ORDER BY value DESC, event_id LIMIT 20")
def capped_sample(t, spark):
    return V.top_sample(t("events").select("event_id", "value"), [F.desc("value"), F.col("event_id")])


BOUND = {"orders": Binding(customer_col="o_custkey"), "nation": Binding("global")}


@query("SELECT o_orderstatus, count(*) AS orders FROM orders WHERE o_custkey IN (1, 2, 3) GROUP BY 1")
def scoped_shadowing_cte(t, spark):
    """A CTE named like the table that it reads: the table inside is the principal's view."""
    sql = "WITH orders AS (SELECT * FROM orders) SELECT o_orderstatus, count(*) AS orders FROM orders GROUP BY o_orderstatus"
    return run_scoped(spark, sql, lambda s, n: ParquetSource(s, t.root)(n), BOUND, Principal("eve", customers=(1, 2, 3))).df


@query("SELECT CASE WHEN o_custkey % 2 = 0 THEN 'even' ELSE 'odd' END AS kind, count(*) AS orders FROM orders WHERE o_custkey IN (1, 2, 3) GROUP BY 1")
def scoped_union(t, spark):
    """Scope reaches both sides of a union and a subquery inside it."""
    sql = "SELECT 'even' AS kind, count(*) AS orders FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders WHERE o_custkey % 2 = 0) HAVING count(*) > 0 UNION ALL SELECT 'odd', count(*) FROM orders WHERE o_custkey % 2 = 1 HAVING count(*) > 0"
    return run_scoped(spark, sql, lambda s, n: ParquetSource(s, t.root)(n), BOUND, Principal("eve", customers=(1, 2, 3))).df


@query("SELECT p_partkey, relation, priority FROM (SELECT p_partkey, min(priority) AS priority, arg_min(relation, priority) AS relation FROM (SELECT d.p_partkey, 'references' AS relation, 1 AS priority FROM part d WHERE d.p_partkey IN (SELECT l_suppkey FROM lineitem WHERE l_partkey = 5) UNION ALL SELECT DISTINCT l_partkey, 'referenced_by', 2 FROM lineitem WHERE l_suppkey = 5 UNION ALL SELECT d.p_partkey, 'revision', 3 FROM part d JOIN part s ON s.p_partkey = 5 AND d.p_type = s.p_type AND d.p_size = s.p_size UNION ALL SELECT d.p_partkey, 'family', 4 FROM part d JOIN part s ON s.p_partkey = 5 AND d.p_type = s.p_type UNION ALL SELECT d.p_partkey, 'folder', 5 FROM part d JOIN part s ON s.p_partkey = 5 AND d.p_brand = s.p_brand UNION ALL SELECT d.p_partkey, 'domain', 6 FROM part d JOIN part s ON s.p_partkey = 5 AND left(d.p_name, 4) = left(s.p_name, 4)) WHERE p_partkey <> 5 GROUP BY 1) ORDER BY priority, p_partkey LIMIT 10")
def related_documents(t, spark):
    from ..operators.routes import relation_route

    docs = t("part").select(F.col("p_partkey").alias("doc_id"), F.col("p_type").alias("family"), F.col("p_size").alias("revision"), F.col("p_brand").alias("folder"), F.substring("p_name", 1, 4).alias("domain"))
    links = t("lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).distinct()
    return relation_route(docs, links, docs.where("doc_id = 5")).select(F.col("doc_id").alias("p_partkey"), "relation", F.col("priority").cast("long").alias("priority"))


#: Definitions that the statement below has to keep, and what its question asks for.
STATEMENT = "SELECT c_mktsegment, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS amount FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus IN ('F', 'O') AND o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1998-01-01' GROUP BY c_mktsegment"


@query(STATEMENT)
def proven_statement(t, spark):
    """A free statement that runs once its facts prove the question's intent, keep the definitions and have evidence for their joins."""
    from ..plans.analysed import facts
    from ..plans.governance import Raw, Unrestricted, check, opened, scope
    from ..plans.statements import Intent, StatementRule, evidence_problems, proof, violations

    root = Principal("root", proof=Unrestricted("root", True, True))
    stage = scope(spark, check(spark, Raw(STATEMENT)), lambda s, n: ParquetSource(s, t.root)(n), {"orders": Binding(customer_col="o_custkey"), "customer": Binding(customer_col="c_custkey")}, root)
    df = opened(stage)
    f = facts(df, set(stage.tables))
    known = tuple(r[0] for r in t("orders").select("o_orderstatus").distinct().limit(60).collect())
    rules = [StatementRule("require_columns", "orders", ("o_orderstatus",)), StatementRule("known_value", "orders", ("o_orderstatus",), known), StatementRule("time_column", columns=("o_orderdate",)), StatementRule("no_fanout", values=(("orders", "o_custkey"),))]
    intent = Intent(filters=((("orders", "o_orderstatus"), ("F", "O")),), time=(("orders", "o_orderdate"), date(1996, 1, 1), date(1998, 1, 1)), groups=(("customer", "c_mktsegment"),), metrics=(("sum", ("orders", "o_totalprice")),))
    got = proof(f, intent)
    problems = [*violations(f, rules, date(2026, 1, 1)), *evidence_problems(f, {"orders", "customer"}, {(("orders", "o_custkey"), ("customer", "c_custkey"))}, {}), *got["missing"], *got["conflicts"]]
    if problems:
        raise ValueError(f"the statement may not run: {problems}")
    return df


@query("SELECT c_nationkey, count(*) AS n, CAST(NULL AS DOUBLE) AS best, CAST(NULL AS VARCHAR) AS worst FROM customer WHERE c_custkey < 400 AND c_custkey % 3 = 0 GROUP BY c_nationkey")
def masked_by_lineage(t, spark):
    """Balances count as sensitive: what derives from them is null under any name, in a CTE, an aggregate and a text."""
    sql = "WITH a AS (SELECT c_nationkey AS k, c_acctbal AS harmless FROM customer), b AS (SELECT k, max(harmless) AS m, min(harmless) AS w, count(*) AS n FROM a GROUP BY k) SELECT k AS c_nationkey, n, m AS best, concat('least ', w) AS worst FROM b"
    who = Principal("ann", customers=tuple(range(0, 400, 3)))
    return run_scoped(spark, sql, lambda s, n: ParquetSource(s, t.root)(n), {"customer": Binding(customer_col="c_custkey")}, who, sensitive=("acctbal",)).df
