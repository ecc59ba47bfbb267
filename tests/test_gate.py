"""The gate, row scope, time phrases of follow-ups, values and statements."""

from datetime import date

import pytest

from quarry.functions import timewin
from quarry.operators import cards, edges
from quarry.plans import values as V
from quarry.plans.governance import FUNCTIONS, Binding, GateError, Principal, ScopeCache, ScopeError, Unrestricted, bounded, clamp, decide_scope, merge_codes, redact, relations, run_scoped
from quarry.plans.model import PlanError, QuerySpec, compose
from quarry.plans.sales import SALES
from quarry.sources.tables import ParquetSource

SF = "/root/testdata/sf0.001"
D = date(2026, 7, 15)
BOUND = {"orders": Binding(customer_col="o_custkey"), "nation": Binding("global")}
EVE = Principal("eve", customers=(1, 2, 3))


def scoped_count(spark, sql):
    return run_scoped(spark, sql, lambda s, n: ParquetSource(s, SF)(n), BOUND, EVE).df.first()[0]


@pytest.mark.parametrize("sql", [
    "SELECT reflect('java.lang.System', 'getProperty', 'user.home') FROM nation", "SELECT java_method('java.lang.System', 'getProperty', 'user.home') FROM nation",
    "SELECT n_name FROM nation WHERE try_reflect('a', 'b') IS NULL", "SELECT count(*) FROM nation HAVING max(input_file_name()) <> ''", "SELECT * FROM nation ORDER BY current_user()",
    "WITH a AS (SELECT reflect('a', 'b') AS x FROM nation) SELECT x FROM a", "SELECT TRANSFORM (n_name) USING 'cat' AS (x) FROM nation", "SELECT my_udf(n_name) FROM nation",
])
def test_code_does_not_run(spark, sql):
    with pytest.raises(GateError):
        relations(spark, sql)


def test_listed_functions_pass(spark):
    assert relations(spark, "SELECT upper(n_name), count(*) OVER (PARTITION BY n_regionkey) AS c, round(avg(n_nationkey) OVER (), 2) FROM nation WHERE n_name LIKE 'N%' AND n_nationkey BETWEEN 1 AND 3") == {"nation"}
    assert not {"reflect", "java_method", "input_file_name", "current_user", "assert_true", "raise_error"} & FUNCTIONS


@pytest.mark.parametrize("sql, names", [
    ("WITH lineitem AS (SELECT * FROM lineitem) SELECT * FROM lineitem, nation", {"lineitem", "nation"}),
    ("WITH a AS (SELECT * FROM b), b AS (SELECT * FROM nation) SELECT * FROM a", {"b", "nation"}),
    ("WITH a AS (SELECT * FROM nation) SELECT * FROM (WITH nation AS (SELECT * FROM a) SELECT * FROM nation) x", {"nation"}),
    ("SELECT * FROM (WITH orders AS (SELECT * FROM nation) SELECT * FROM orders) x JOIN orders ON true", {"nation", "orders"}),
    ("WITH a AS (SELECT * FROM nation WHERE n_nationkey IN (SELECT o_custkey FROM orders)) SELECT * FROM a UNION ALL SELECT * FROM nation", {"nation", "orders"}),
])
def test_names_are_resolved_by_place(spark, sql, names):
    assert relations(spark, sql) == names


@pytest.mark.parametrize("sql", [
    "SELECT count(*) FROM orders", "WITH orders AS (SELECT * FROM orders) SELECT count(*) FROM orders", "WITH a AS (WITH orders AS (SELECT * FROM orders) SELECT * FROM orders) SELECT count(*) FROM a",
    "SELECT sum(n) FROM (SELECT count(*) AS n FROM orders WHERE o_custkey % 2 = 0 UNION ALL SELECT count(*) FROM orders WHERE o_custkey % 2 = 1)",
    "SELECT count(*) FROM nation RIGHT JOIN orders ON n_nationkey < 0",
])
def test_no_way_around_the_scope(spark, sql):
    want = ParquetSource(spark, SF)("orders").where("o_custkey IN (1, 2, 3)").count()
    assert scoped_count(spark, sql) == want > 0


def test_scope_refuses(spark):
    for sql in ("SELECT * FROM part", "SELECT * FROM spark_catalog.default.orders", "SELECT * FROM parquet.`/root/testdata/sf0.001/orders.parquet`"):
        with pytest.raises(ScopeError):
            scoped_count(spark, sql)
    with pytest.raises(ScopeError):
        decide_scope([], "x", (), (), ())
    assert decide_scope(["department", "tree"], "x", (1,), (1, 2), (), (1, 2, 3)).owners == (1, 2, 3)
    with pytest.raises(ScopeError):
        Unrestricted("x", True, False)
    assert Unrestricted("x", True, True).login == "x"
    assert merge_codes([1, -1], [2]) == (1, 2) and merge_codes([-1]) == () and merge_codes([1], []) is None
    assert (clamp(500, 200, None), clamp(None, 200), clamp(0, 5)) == (200, 200, 1)
    loads = []
    cache = ScopeCache(lambda *k: loads.append(k) or Principal(k[0]))
    for version in ("a", "a", "b"):
        cache.get("ann", "r", "s", version)
    assert len(loads) == 2


def test_rows_and_flag_agree(spark):
    r = redact(spark.range(10).withColumnRenamed("id", "n"))
    out = bounded(r, 4)
    assert out.truncated and out.df.count() == 4 and not bounded(r, 10).truncated


def test_sort_limit_and_offset(spark):
    t = ParquetSource(spark, SF)
    assert compose(SALES, QuerySpec(("sales_amount",), ("nation",), sort="sales_amount"), t).count() == 25
    assert compose(SALES, QuerySpec(("sales_amount",), ("nation",), sort="sales_amount", offset=3), t).count() == 1
    assert compose(SALES, QuerySpec(("sales_amount",), ("nation",), sort="sales_amount", limit=5), t).count() == 5


@pytest.mark.parametrize("phrase, begin, end", [("second half of 1997", "1997-07-01", "1998-01-01"), ("Q1 1997", "1997-01-01", "1997-04-01"), ("1997", "1997-01-01", "1998-01-01"), ("1997-02", "1997-02-01", "1997-03-01"), ("1996年12月", "1996-12-01", "1997-01-01")])
def test_years_before_2000(phrase, begin, end):
    w = timewin.parse(phrase, D)
    assert (str(w.begin), str(w.end)) == (begin, end)


@pytest.mark.parametrize("phrase, prev, ago", [
    ("today", ("2026-07-14", "2026-07-14"), ("2025-07-15", "2025-07-15")), ("yesterday", ("2026-07-13", "2026-07-14"), ("2025-07-14", "2025-07-15")),
    ("this quarter", ("2026-04-01", "2026-04-15"), ("2025-07-01", "2025-07-15")), ("last quarter", ("2026-01-01", "2026-04-01"), ("2025-04-01", "2025-07-01")),
    ("last week", ("2026-06-29", "2026-07-06"), ("2025-07-07", "2025-07-14")), ("last year", ("2024-01-01", "2025-01-01"), ("2024-01-01", "2025-01-01")), ("this year", ("2025-01-01", "2025-07-15"), ("2025-01-01", "2025-07-15")),
])
def test_comparison_windows(phrase, prev, ago):
    p, y = timewin.previous(phrase, D), timewin.year_ago(phrase, D)
    assert (str(p.begin), str(p.end)) == prev and (str(y.begin), str(y.end)) == ago


def test_time_in_follow_ups():
    assert timewin.inherit("and by region?", "sales in second half of 1997") == "and by region? second half of 1997"
    assert timewin.inherit("and this month?", "sales last year") == "and this month?"
    assert timewin.inherit("客户呢", "最近三个月销售额") == "客户呢 最近三个月"
    assert timewin.includes_today("this month", D) and not timewin.includes_today("last month", D) and not timewin.includes_today("nothing", D)
    assert timewin.time_tokens("day before yesterday and 2024-05, 去年") == {"day before yesterday", "2024-05", "去年"}
    w = timewin.parse("2026-07", D)
    assert timewin.to_date(w, D, "2026-07") == w and str(timewin.to_date(timewin.parse("this month", D), D, "this month").end) == "2026-07-16"


def test_values_and_statements(spark):
    t = ParquetSource(spark, SF)
    spec = V.with_values(SALES, QuerySpec(("sales_amount",), ("nation",)), [("region", "ASIA")])
    assert spec.equals == (("region", ("ASIA",)),)
    for bad in ([("region", "ASIA"), ("region", "EUROPE")], [("event_type", "view")]):
        with pytest.raises(PlanError):
            V.with_values(SALES, QuerySpec(("sales_amount",)), bad)
    with pytest.raises(PlanError):
        V.with_values(SALES, QuerySpec(("order_amount",)), [("return_flag", "R")])
    rows = t("nation")
    assert V.statement(spark, "SELECT count(*) AS n FROM {x} WHERE n_name IN (:names) AND n_nationkey < :k", {"x": rows}, names=["NATION_1", "x' OR '1'='1"], k=20).first().n == 1
    for text, args in (("SELECT 1 FROM {x} WHERE n_name = :a", {}), ("SELECT 1 FROM {x}", {"a": 1}), ("SELECT 1 FROM {x} WHERE n_name IN (:a)", {"a": []}), ("SELECT 1 FROM {x} WHERE n_name = :a", {"a": {}})):
        with pytest.raises(PlanError):
            V.statement(spark, text, {"x": rows}, **args)
    with pytest.raises(PlanError):
        V.time_slot("SELECT {time}", "a; DROP")
    with pytest.raises(PlanError):
        V.fragment_rows(t("lineitem"), "l_partkey", t("part"), "p_partkey", "p_name", "no such goods")
    rows.createOrReplaceTempView("gate_nation")
    assert V.schema_problems(spark, "SELECT n_name FROM gate_nation") == [] and "nosuch" in V.schema_problems(spark, "SELECT nosuch FROM gate_nation")[0] and V.schema_problems(spark, "SELECT 1 FROM no_table_here")


def test_names_of_tables():
    assert edges.table_core("dws_fin_customer_balances_dnf") == edges.table_core("t_customer_balance") == ["customer", "balance"]
    assert edges.table_core("ods_status") == ["status"] and edges.table_core("dim_t") == []
    with pytest.raises(ValueError):
        cards.card_aggregate(None, "x", "sum", "percent")


def test_sampled_values_agree_between_columns(spark):
    """Columns of one domain keep the same values of it, and no more than asked for."""
    a, b = spark.range(5000).selectExpr("id AS x"), spark.range(2500, 7500).selectExpr("id AS y")
    got = edges.column_values({"a": a, "b": b}, {"a": ["x"], "b": ["y"]}, 200).toPandas()
    x, y = (set(got[got.column == c].value) for c in ("a.x", "b.y"))
    assert len(x) == len(y) == 200 and len({v for v in x & y}) > 60
