"""Definition checks, answers, presentation, files and logs."""

from datetime import date

import pytest

from quarry.functions import answers
from quarry.operators import presentation, recall
from quarry.plans import checks
from quarry.plans.model import PlanError, QuerySpec, TimeWindow
from quarry.plans.sales import SALES
from quarry.sources import files

D = date(2026, 7, 15)


def test_rules_and_corrections():
    spec = QuerySpec(("sales_amount", "sales_amount"), ("region", "region"), TimeWindow(date(2026, 7, 1), date(2026, 8, 1)), equals=(("status", ("done",)),))
    rules = [checks.Rule("cap_window", "sales_amount"), checks.Rule("require_value", "sales_amount", ("brand", ("A",))), checks.Rule("require_window", "sales_amount"), checks.Rule("known_value", "sales_amount")]
    found = checks.check(SALES, spec, rules, D, {"status": {"finished"}})
    assert {v.rule for v in found} == {"cap_window", "require_value", "known_value"}
    fixed = checks.correct(spec, rules, D, {"status": {"done": "finished"}})
    assert fixed.window.end == D and fixed.dimensions == ("region",) and not checks.check(SALES, fixed, rules, D, {"status": {"finished"}})
    assert [checks.judge(x) for x in ([[]], [[found]], [[found], [found], [found]])] == ["pass", "retry", "unresolved"]
    assert checks.check(SALES, QuerySpec(("order_amount",), ("return_flag",)), [checks.Rule("forbid_fanout", "order_amount")], D)
    assert checks.coverage(spec, {"metric": ["cost"], "time": ["window"]})["missing"] == ["metric:cost"]


def test_questions_votes_and_cache():
    s = checks.spec_of(SALES, "top 3 region by sales last month", D)
    assert (s.metrics, s.dimensions, s.limit, str(s.window.begin)) == (("sales_amount",), ("region",), 3, "2026-06-01")
    with pytest.raises(PlanError):
        checks.spec_of(SALES, "weather today", D)
    assert checks.vote([[(1, 2.0)], [(1, 2.0000000001)], [(3, 1.0)]]) == 0 and checks.vote([[(1,)], [(2,)]]) is None
    assert checks.same_question("sales 2024", "sales in 2024", 0.1, {"month"}) and not checks.same_question("sales 2024", "sales 2025", 0.1, set())


def test_answers():
    assert (answers.compress(123456789), answers.compress(12345), answers.compress(12.5)) == ("1.23亿", "1.23万", "12.5")
    assert (answers.change_text(1.2, 1.0), answers.change_text(1, 0), answers.change_text(0.5, 0.4, True)) == ("+20.0%", "new", "+10.0pp")
    assert answers.grounded("Sales were 1,200 [1]. Cost was 7 [1]. No source.", {1: "sales 1200"}) == "Sales were 1,200 [1]."
    assert answers.extract_json('so: {"a": [1]} ok') == {"a": [1]} and answers.extract_json("none") is None
    assert answers.version_of("Manual_v2.1.docx") == ("Manual", "2.1") and answers.version_of("plain.txt") == ("plain", None)
    assert "abc" not in answers.sanitize("token=abc")


def test_presentation():
    assert presentation.view(["amount"], [(1.0,)])["blocks"][0]["kind"] == "kpis"
    v = presentation.view(["month", "amount"], [("2024-01", 1.0), ("2024-02", 2.0)])
    assert v["blocks"][0]["kind"] == "line" and "+100.0%" in v["insight"]
    assert presentation.view(["region", "amount"], [("a", 3.0), ("b", 1.0)])["blocks"][0]["kind"] == "pie"
    assert presentation.insight([{"name": "r", "role": "category"}, {"name": "x", "role": "metric"}], [("a", -1.0), ("b", 2.0)]) is None
    assert "region" not in presentation.drills(["region"], SALES)


def test_files_and_logs(spark, tmp_path):
    assert files.classify("a.PDF", 10) == "pdf"
    for bad in (("a.exe", 10), ("a.txt", 0)):
        with pytest.raises(ValueError):
            files.classify(*bad)
    for url in ("ftp://a.com", "http://127.0.0.1/", "http://u:p@a.com", "http://localhost/", "http://10.0.0.1"):
        with pytest.raises(ValueError):
            files.check_url(url)
    assert files.check_url("https://example.com/x", ["93.184.216.34"])
    assert files.decode("表".encode("gbk")) == "表" and files.decode("é".encode("utf-16")) == "é"
    files.append_log(spark.createDataFrame([("token=abc here",)], "question string"), str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).first().question == "token=*** here"
    a = spark.createDataFrame([("s", "1"), ("s", "1"), ("s", "2")], "space string, sha256 string")
    assert files.new_files(a, a.where("sha256 = '2'")).count() == 1
    gone, few = recall.orphans(a, a.where("sha256 = '1'"), "sha256")
    assert gone.count() == 1 and few


def test_stream(spark):
    from quarry.streaming.events import windowed

    schema = spark.read.parquet("/root/testdata/sf0.001/events.parquet").schema
    import os
    import tempfile

    folder = tempfile.mkdtemp()
    os.symlink("/root/testdata/sf0.001/events.parquet", f"{folder}/events.parquet")
    q = windowed(spark.readStream.schema(schema).parquet(folder)).writeStream.outputMode("complete").format("memory").queryName("w").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT sum(n) AS n FROM w").first().n == spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()
