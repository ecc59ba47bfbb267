"""The text queries against plain versions, requests, sources and small text functions."""

import html
import math
import re
import unicodedata
from datetime import date

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarry.catalog import QUERIES
from quarry.functions import text
from quarry.plans import checks as C
from quarry.plans.model import Metric, PlanError, QuerySpec, Registry, TimeWindow
from quarry.plans.sales import SALES
from quarry.sources import registry as S
from quarry.sources.tables import ParquetSource

SF = "/root/testdata/sf0.001"


def test_chunks_cover_whole_documents(spark):
    """Spans in order without a gap, of bounded length, ended at sentences, with an overlap of bounded length."""
    texts = pd.read_parquet(f"{SF}/documents.parquet").set_index("doc_id").text.fillna("")
    got = QUERIES["chunk_documents"](spark, SF).toPandas()
    for d, t in texts.items():
        spans = got[got.doc_id == d].sort_values("ord")[["start", "stop"]].to_numpy().tolist()
        if not t:
            assert not spans
            continue
        assert spans[0][0] == 0 and spans[-1][1] == len(t) and [k for k in got[got.doc_id == d].ord.sort_values()] == list(range(len(spans)))
        for a, z in spans:
            assert z > a and math.ceil((z - a) / 1.6) <= 480
            assert z == len(t) or t[z - 1] in ".!?。！？\n" or t[z - 1].isspace() or z - a >= 300 * 1.6 or math.ceil((z - a) / 1.6) <= 480
        for (_, z), (a, y) in zip(spans, spans[1:]):
            assert a <= z < y and math.ceil((z - a) / 1.6) <= 61


def test_html_has_the_words_of_its_text(spark):
    pages = pd.read_parquet(f"{SF}/pages.parquet").set_index("page_id").html
    got = QUERIES["html_to_text"](spark, SF).toPandas().set_index("page_id").text
    assert set(got.index) == set(pages.index)
    for k, h in pages.items():
        plain = re.sub(r"(?is)<(script|style|noscript|template|svg)\b.*?</\1\s*>", "", h or "")
        plain = html.unescape(re.sub(r"(?si)<!--.*?-->|<!doctype[^>]*>|</?[a-zA-Z][^>]*>", " ", plain))
        assert "".join(got[k].split()) == "".join(plain.split())


def slow_word_similarity(query, target):
    grams = lambda w: [f"  {w} "[k : k + 3] for k in range(len(w) + 1)]
    q = {g for w in re.findall(r"\w+", query.lower()) for g in grams(w)}
    seq = [g for w in re.findall(r"\w+", target.lower()) for g in grams(w)]
    return max((len(set(seq[a:b]) & q) / len(set(seq[a:b]) | q) for a in range(len(seq)) for b in range(a + 1, len(seq) + 1)), default=0.0)


def test_trigrams_by_brute_force(spark):
    texts = pd.read_parquet(f"{SF}/benchmark.parquet").set_index("item_id").text.str.slice(0, 60)
    rows = spark.createDataFrame([(int(k), t) for k, t in texts.items()], "chunk_id long, text string")
    from quarry.operators.retrieval import trigram_route

    want = sorted(((k, slow_word_similarity("the reading of the", t)) for k, t in texts.items()), key=lambda x: (-x[1], x[0]))
    want = [(k, s) for k, s in want if s > 0.2][:10]
    assert [(r.chunk_id, round(r.score, 9)) for r in trigram_route(rows, "the reading of the").collect()] == [(k, round(s, 9)) for k, s in want]


def test_small_text_functions():
    assert text.fnv1a64("") == "cbf29ce484222325" and text.fnv1a64("a") == "af63dc4c8601ec8c" and text.fnv1a64("foobar") == "85944171f73967e8"
    assert text.clean_label("订单状态(1-有效,2-无效)") == "订单状态" and text.clean_label("Region: where it is") == "Region" and text.clean_label("（x）") is None
    assert text.recipe("n", "", "h > i", "b") == "n\nh > i\nb"


def test_requests_are_repaired():
    spec, fixes = C.repaired(SALES, C.Request(("sales_amount",), ("nation",), (("sales_amount", "sum"),), end=date(1998, 1, 1)))
    assert spec == QuerySpec(("sales_amount",), ("nation",), TimeWindow(date(1970, 1, 1), date(1998, 1, 1))) and fixes == ["selected ['nation']", "lower bound"]
    with pytest.raises(PlanError):
        C.repaired(SALES, C.Request(("nothing",)))
    with pytest.raises(PlanError):
        C.repaired(SALES, C.Request(("sales_amount",), aggregate=(("sales_amount", "max"),)), "the largest sales")


def test_more_rules():
    reg = Registry(metrics={"n": Metric("n", "lineitem", "count(*)", "o_orderdate", dedup_keys=("l_orderkey",)), "e": Metric("e", "events", "count(*)", "ts")}, dimensions=SALES.dimensions, edges=SALES.edges, snapshots={"events": SALES.snapshots["events"]})
    today, spec = date(1998, 1, 1), QuerySpec(("n",), equals=(("customer_code", ("7", "Ann's")),), window=TimeWindow(date(1997, 1, 1), date(1997, 2, 1)))
    rules = [C.Rule("require_dedup", "n", ("l_orderkey",)), C.Rule("require_dedup", "n", ("l_partkey",)), C.Rule("require_latest", "n"), C.Rule("require_latest", "e"), C.Rule("join_and_filter", "n", "customer"), C.Rule("join_and_filter", "n", "part"), C.Rule("code_on_column", "n", "customer_code"), C.Rule("time_column", "n", "l_shipdate"), C.Rule("time_column", "n", "o_orderdate")]
    assert [(v.rule) for v in C.check(reg, spec, rules, today)] == ["require_dedup", "require_latest", "join_and_filter", "code_on_column", "time_column"]


def test_plans_of_questions():
    assert [C.plan_for(q) for q in ("sales compared with last year", "monthly sales", "share of each region", "top 5 customers", "do the sections add up", "sales")] == ["compare", "trend", "structure", "rank", "reconcile", "total"]
    assert C.split_compound("sales of 1997; buyers by region") == ["sales of 1997", "buyers by region"] and C.split_compound("sales by region") == ["sales by region"]
    assert C.merged_answers([("a", 1), ("b", None)]) == ([("a", 1)], ["no answer to: b"])


def test_source_registry(spark, tmp_path):
    calls = []
    r = S.SourceRegistry({"files": lambda: calls.append(1) or ParquetSource(spark, SF), "broken": lambda: 1 / 0})
    assert r.get("files") is r.get("files") and calls == [1]
    assert r.preload() == {"files": None, "broken": "division by zero"}
    assert r.probe("files", "nation") and not r.probe("files", "none") and not r.probe("broken", "x")
    assert r.close("files") and not r.close("files")
    with pytest.raises(KeyError):
        r.get("other")
    assert S.Policy(200, 30).tightened(500, 10) == S.Policy(200, 10)
    o = S.jdbc_options("jdbc:postgresql://h/db", "SELECT 1", S.Policy(5, 7), "app")
    assert o["query"].endswith("LIMIT 6") and o["queryTimeout"] == "7" and "search_path TO app" in o["sessionInitStatement"] and "read_only" in o["sessionInitStatement"]
    with pytest.raises(ValueError):
        S.jdbc_options("jdbc:postgresql://h/db", "SELECT 1", S.Policy(), "a; DROP")
    terms = spark.createDataFrame([("a", 'x "quoted", y'), ("b", ""), ("c", None)], "term string, meaning string")
    S.export_csv(terms, str(tmp_path / "csv"))
    back = S.import_csv(spark, str(tmp_path / "csv"), "term string, meaning string", ["term"], spark.createDataFrame([("a", "old"), ("z", "kept")], terms.schema))
    assert {tuple(x) for x in back.collect()} == {tuple(x) for x in terms.collect()} | {("z", "kept")}
    (tmp_path / "twice").mkdir()
    for k, lines in enumerate((["a,first", "b,1", "a,last"], ["b,2", "c,", "b,3"])):
        (tmp_path / "twice" / f"part{k}.csv").write_text("\n".join(["term,meaning", *lines]) + "\n")
    assert {tuple(x) for x in S.import_csv(spark, str(tmp_path / "twice"), terms.schema.simpleString()[7:-1].replace(":", " "), ["term"]).collect()} == {("a", "last"), ("b", "3"), ("c", None)}
    m = spark.createDataFrame([(1, 1, "a", "t")], "chunk_id long, doc_id long, entity string, type string")
    e = spark.createDataFrame([(1, "a", "b", "t", 1.0)], "doc_id long, src string, dst string, type string, weight double")
    for _ in range(2):
        S.append_graph(m, e, str(tmp_path / "graph"))
    kept = S.stored_graph(spark, str(tmp_path / "graph"))
    assert [tuple(x) for x in kept[0].collect()] == [tuple(x) for x in m.collect()] and [tuple(x) for x in kept[1].collect()] == [tuple(x) for x in e.collect()]
    S.append_graph(m.unionByName(m.withColumn("entity", F.lit("b"))), e.limit(0), str(tmp_path / "graph"))
    kept = S.stored_graph(spark, str(tmp_path / "graph"))
    assert kept[0].count() == 2 and kept[1].count() == 1 and S.stored_graph(spark, str(tmp_path / "none")) is None
    assert unicodedata.normalize("NFKC", "Ａ") == "A"


def test_more_checks():
    spec = QuerySpec(("sales_amount",), equals=(("region", ("ASIA",)),))
    got = C.coverage(spec, {"metric": ["sales_amount"], "filter": ["region"], "values": {"region": "EUROPE"}, "comparison": ["last year"]})
    assert got["conflicts"] == ["region:EUROPE"] and got["unverifiable"] == ["comparison"] and got["missing"] == []
    assert C.judge([[], None]) == "grader_error" and C.judge([[]]) == "pass"
    assert C.fingerprint([(2**60 + 1,)]) != C.fingerprint([(2**60,)]) and C.fingerprint([(2.0,)]) == C.fingerprint([(2,)])
    assert not C.same_question("my sales 2024", "sales 2024", 0.01, set()) and C.same_question("my sales 2024", "my sale 2024", 0.01, set())
    assert C.same_shape(["a", "b"], ["a", "b", "c"]) == [] and C.same_shape(["a", "b"], ["b", "a"]) == ["out of order"] and C.same_shape(["a"], ["b"]) == ["without a"]
    assert C.notes(True, 200, {"orders"}, {"lineitem"}, True)["trust"] == "low" and C.notes(False, 200, {"orders"}, {"orders"}, True) == {"trust": "high", "notes": []}
    assert C.hybrid((["x"], [(None,)]), "text", 1)["kind"] == "document" and C.hybrid((["x"], [(1,)]), "text", 0)["kind"] == "data" and C.hybrid(None, "", 0)["kind"] == "none"


def test_numbers_and_claims():
    from quarry.functions import answers as A
    from quarry.functions import entities as E

    assert (A.chinese_number("一百二十三"), A.chinese_number("两千零五"), A.chinese_number("三万五千"), A.chinese_number("十二"), A.chinese_number("x")) == (123, 2005, 35000, 12, None)
    assert A.values("sales of 1.2亿, 15% and 二十三") == [1.2e8, 0.15, 23.0]
    assert A.bound_claims([("amount is 1,204", ["f1"]), ("amount is 1,300", ["f1"]), ("amount is 1,200", []), ("up 20%", ["f2"])], {"f1": 1200.0, "f2": 0.2}) == ["amount is 1,204", "up 20%"]
    assert E.entity_id("s", " “Ann  Lee” ") == E.entity_id("s", "ann lee") != E.entity_id("t", "ann lee") and E.entity_id("s", "7") is None
    spans = E.chunk_preset("The cat sat. The cat ran. Stock prices fell. Stock prices rose." + "x" * 2000, "meaning")
    assert spans[0] == (0, 26) and spans[-1][1] == 2063 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    assert text.terms("销售额 of Asia") == ["销售", "售额", "asia"] and text.json_block('{"a":1}').startswith("```json\n{") and text.json_block("no") == "no"


def test_more_presentation():
    from quarry.functions import timewin
    from quarry.operators import presentation as P

    lines = P.series(["month", "region", "amount"], [("1", "a", 5.0), ("2", "a", 1.0), ("1", "b", 2.0), ("1", "c", 1.0)], 2)
    assert lines == {"a": [("1", 5.0), ("2", 1.0)], "b": [("1", 2.0)], "other": [("1", 1.0)]} and P.series(["amount"], [(1.0,)]) is None
    assert P.kpi_delta(0.5, 0.4, "percent") == "+10.0pp" and P.kpi_delta(3, 2, "money") == "+50.0%"
    assert [str(x) for x in P.in_order([lambda: 1, lambda: 1 / 0, lambda: 3])] == ["1", "division by zero", "3"]
    assert P.localised(["a", "b"], {"a": {"zh": "甲", "en": "A"}}, "zh") == ["甲", "b"] and P.localised(["a"], {"a": {"en": "A"}}, "fr") == ["A"]
    assert timewin.weekly(date(1998, 9, 14)) is None  # a week that has not started
    assert timewin.partial_month("2026-07", date(2026, 7, 15)) == "2026-07" and timewin.partial_month("2026-06", date(2026, 7, 15)) is None and timewin.partial_month("2026-07", date(2026, 7, 31)) is None


def test_uploads(spark, tmp_path):
    from quarry.plans.lookup import partitions_read
    from quarry.sources.files import replaced
    from quarry.sources.tables import typed

    stored = spark.createDataFrame([("s", "a", "1", 1), ("s", "b", "2", 1)], "space string, name string, sha256 string, version int")
    new = spark.createDataFrame([("s", "a", "9"), ("s", "b", "2"), ("s", "c", "3")], "space string, name string, sha256 string")
    got = {(r.name, r.sha256, r.version, r.active) for r in replaced(stored, new).collect()}
    assert got == {("a", "1", 1, False), ("a", "9", 2, True), ("b", "2", 1, True), ("c", "3", 1, True)}
    with pytest.raises(ValueError):
        typed(spark.range(20).selectExpr("cast(id AS string) AS a"), 10)
    spark.range(40).selectExpr("id", "id % 5 AS p").write.partitionBy("p").parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    assert partitions_read(t, "p") == {"scanned": 5, "total": 5, "full": True} and not partitions_read(t.where("p < 2"), "p")["full"]
