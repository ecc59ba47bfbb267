"""Composer, governance, time windows and text functions."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from quarry.functions import text, timewin
from quarry.operators import profiling, relations, retrieval
from quarry.plans.governance import Binding, GateError, Principal, ScopeError, Unrestricted, bounded, decide_scope, expand_tree, redact, relations as read_relations, run_scoped, scoped
from quarry.plans.model import FanoutError, PlanError, QuerySpec, compose
from quarry.plans.sales import SALES
from quarry.sources.tables import ParquetSource, hide_login, infer_types, safe_columns

SF = "/root/testdata/sf0.001"
D = date(2026, 7, 15)


def test_fanout_and_whitelist(spark):
    t = ParquetSource(spark, SF)
    with pytest.raises(FanoutError):
        compose(SALES, QuerySpec(("order_amount",), ("return_flag",)), t)
    assert compose(SALES, QuerySpec(("order_count",), ("return_flag",)), t).where("return_flag is not null").count() == 3
    with pytest.raises(PlanError):
        compose(SALES, QuerySpec(("distinct_lines",), ("brand",)), t)
    with pytest.raises(PlanError):
        compose(SALES, QuerySpec(("order_count",), equals=(("priority", ()),)), t)
    assert SALES.path("lineitem", "region")[-1][0].right == "region"


@pytest.mark.parametrize("sql", ["DROP TABLE orders", "SELECT 1", "SELECT * FROM orders; SELECT 1", "INSERT INTO orders SELECT * FROM orders", "SELECT * FROM information_schema.tables", "SELECT * FROM orders WHERE o_custkey = ?", "SELECT /*! x */ * FROM orders", "SHOW TABLES"])
def test_gate_refuses(spark, sql):
    with pytest.raises(GateError):
        read_relations(spark, sql)


def test_gate_reads(spark):
    assert read_relations(spark, "WITH a AS (SELECT * FROM orders) SELECT * FROM a WHERE o_custkey IN (SELECT c_custkey FROM customer)") == {"orders", "customer"}


def test_scopes(spark):
    t = ParquetSource(spark, SF)
    b = {"orders": Binding(customer_col="o_custkey"), "lineitem": Binding("via", via_table="orders", via_col="l_orderkey", via_key="o_orderkey"), "nation": Binding("global")}
    assert scoped("orders", t, b, Principal("x", customers=())).count() == 0
    assert scoped("nation", t, b, Principal("x", customers=())).count() == 25
    assert scoped("orders", t, b, Principal("x")).count() == 0
    assert scoped("orders", t, b, Principal("x", proof=Unrestricted("x", True, True))).count() == t("orders").count()
    with pytest.raises(ScopeError):
        scoped("part", t, b, Principal("x"))
    got = run_scoped(spark, "SELECT o_custkey FROM orders", lambda s, n: ParquetSource(s, SF)(n), b, Principal("x", customers=tuple(range(100))), cap=5)
    assert got.truncated and got.df.count() == 5
    assert decide_scope(["self", "all"], "x", (1,), (1, 2), (), admin=True).unrestricted
    with pytest.raises(ScopeError):
        decide_scope(["odd"], "x", (), (), ())
    tree = spark.createDataFrame([(1, 0), (2, 1), (3, 2), (4, 9), (2, 3)], "id int, parent int")
    assert sorted(r.id for r in expand_tree(tree, [1]).collect()) == [1, 2, 3]


def test_redaction_and_truncation(spark):
    r = redact(spark.createDataFrame([(1, "x")], "id int, phone string"))
    assert r.redacted == ["phone"] and r.df.first().phone is None
    assert not bounded(r, 1).truncated


@pytest.mark.parametrize("phrase, begin, end", [
    ("last 7 days", "2026-07-09", "2026-07-16"), ("最近三个月", "2026-04-16", "2026-07-16"), ("2026-01-03 to 2026-02-05", "2026-01-03", "2026-02-06"),
    ("second half of last year 下半年", "2025-07-01", "2026-01-01"), ("Q1", "2026-01-01", "2026-04-01"), ("第三季度", "2026-07-01", "2026-10-01"), ("上季度", "2026-04-01", "2026-07-01"),
    ("去年十二月", "2025-12-01", "2026-01-01"), ("last week", "2026-07-06", "2026-07-13"), ("yesterday", "2026-07-14", "2026-07-15"), ("2024年", "2024-01-01", "2025-01-01"), ("前两个季度", "2026-01-01", "2026-07-01"),
])
def test_time_phrases(phrase, begin, end):
    w = timewin.parse(phrase, D)
    assert (str(w.begin), str(w.end)) == (begin, end)


def test_comparisons_and_ranks():
    p = timewin.previous("this month", D)
    assert (str(p.begin), str(p.end)) == ("2026-06-01", "2026-06-15")
    assert str(timewin.year_ago("this week", D).begin) == "2025-07-14"
    assert timewin.previous("somewhen", D) is None and timewin.parse("nothing", D) is None
    assert timewin.add_months(date(2024, 2, 29), -12) == date(2023, 2, 28)
    assert (timewin.top_n("前十名"), timewin.top_n("top 5"), timewin.top_n("最低的3个"), timewin.top_n("last 3 days")) == (10, 5, 3, 200)
    assert timewin.cn_num("二十三") == 23


def test_text_functions():
    assert text.word_similarity("word", "two words") == 0.8
    assert text.normalize("请问 Ｓales，总额？") == "sales 总额"
    assert text.exact_tokens("order AB-123456 and ab") == ["AB-123456"]
    assert text.html_text("<p>a &amp; b</p><script>x</script><div>c</div>") == "a & b\nc"
    assert text.md_blocks("# A\nx\n## B\ny") == [("A", "x"), ("A > B", "y")]
    spans = text.chunk("One two three. " * 200)
    assert spans[0][0] == 0 and spans[-1][1] == 3000 and all(b[0] <= a[1] for a, b in zip(spans, spans[1:]))
    assert text.longest_common_run("abcdef", "xbcdy") == 3 and text.chunk("") == []


def test_profiling_and_graph(spark):
    assert profiling.joinable_confidence(0.95, True) == 0.95 and profiling.joinable_confidence(0.05, True) is None
    assert profiling.lineage_confidence(["a", "b", "id"], ["a", "b", "c"]) == 0.70
    rank, _ = relations.pagerank(3, [(0, 1, 1.0), (1, 2, 1.0)], [1, 0, 0])
    assert abs(rank.sum() - 1) < 1e-9 and rank[0] > rank[1] > rank[2]
    old = spark.createDataFrame([("a", 0.5, "rejected")], "k string, confidence double, status string")
    new = spark.createDataFrame([("a", 0.9, "pending"), ("b", 0.8, "pending")], "k string, confidence double, status string")
    got = {r.k: (r.confidence, r.status) for r in profiling.keep_reviewed(old, new, ["k"]).collect()}
    assert got == {"a": (0.9, "rejected"), "b": (0.8, "pending")}
    paths = relations.ancestors(spark.createDataFrame([("/a/b/c",)], "path string"))
    assert sorted(r.ancestor for r in paths.collect()) == ["/a", "/a/b"]


def test_acl_and_empty_routes(spark):
    docs = spark.createDataFrame([("d1", "s1", "ann", True, None, None), ("d2", "s1", "bob", True, None, None), ("d3", "s2", "bob", True, None, "2020-01-01"), ("d4", "s2", "bob", False, None, None)], "doc_id string, space string, owner string, enabled boolean, effective_from string, effective_to string")
    grants = spark.createDataFrame([("doc", "d2", "login", "ann"), ("space", "s2", "role", "r")], "scope string, target_id string, grantee_kind string, grantee string")
    assert sorted(r.doc_id for r in retrieval.visible(docs, grants, "ann", ["r"], "2026-01-01").collect()) == ["d1", "d2"]
    chunks = spark.createDataFrame([(1, "x", [1.0, 0.0]), (2, None, None)], "chunk_id long, text string, embedding array<double>")
    assert retrieval.token_route(chunks, "a b").count() == 0
    assert [r.chunk_id for r in retrieval.vector_route(chunks, [1.0, 0.0]).collect()] == [1]


def test_sources(spark):
    assert safe_columns(["A b", "a-b", "1x", ""]) == ["a_b", "a_b_2", "c_1x", "col"]
    df = spark.createDataFrame([("007", "1.5", "2024-01-02", ""), ("8", "", "2024/1/3 10:00", "")], "a string, b string, c string, d string")
    assert infer_types(df) == {"a": "text", "b": "numeric", "c": "timestamp", "d": "text"}
    assert hide_login("mysql://u:pw@h/db") == "mysql://u:***@h/db"
