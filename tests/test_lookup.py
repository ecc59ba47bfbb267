"""Point lookups, plan verdicts, entities and chunking presets."""

import pytest

from quarry.functions import entities
from quarry.plans.governance import GateError
from quarry.plans.lookup import ensure_limit, point_lookup, scan_verdict

SF = "/root/testdata/sf0.001"
INDEX = {"orders": {"o_orderkey"}}


@pytest.mark.parametrize("sql", ["SELECT o_custkey FROM orders WHERE o_orderkey = 1 LIMIT 5", "SELECT o_custkey FROM orders WHERE o_orderkey IN (1, 2) LIMIT 50", "SELECT o.o_custkey AS c FROM orders o WHERE 7 = o.o_orderkey AND o_orderstatus = 'F' LIMIT 5", "SELECT o_custkey FROM orders WHERE o_orderkey LIKE '12%' LIMIT 1"])
def test_lookups(spark, sql):
    assert point_lookup(spark, sql, INDEX) == sql


@pytest.mark.parametrize("sql", ["SELECT * FROM orders WHERE o_orderkey = 1 LIMIT 5", "SELECT o_custkey FROM orders WHERE o_orderkey = 1", "SELECT o_custkey FROM orders WHERE o_custkey = 1 LIMIT 5", "SELECT o_custkey FROM orders WHERE o_orderkey = 1 ORDER BY 1 LIMIT 5", "SELECT o_custkey FROM orders WHERE o_orderkey = 1 OR o_custkey = 2 LIMIT 5", "SELECT count(*) FROM orders WHERE o_orderkey = 1 GROUP BY o_custkey LIMIT 5", "SELECT o_custkey FROM orders WHERE o_orderkey IN (1,2,3,4,5,6) LIMIT 5", "SELECT o_custkey FROM orders WHERE o_orderkey = 1 LIMIT 99",
    "SELECT o_custkey FROM orders WHERE o_orderstatus = 'o_orderkey = 5' LIMIT 5", "SELECT o_custkey FROM orders WHERE coalesce(o_custkey, o_orderkey = 5) LIMIT 5", "SELECT o_custkey FROM orders WHERE o_orderkey = 5 + o_custkey LIMIT 5", "SELECT o_custkey FROM orders WHERE o_orderkey = 5 || o_custkey LIMIT 5",
    "SELECT o_custkey, * FROM orders WHERE o_orderkey = 5 LIMIT 5", "SELECT o_custkey FROM orders WHERE NOT o_orderkey = 5 LIMIT 5", "SELECT o_custkey FROM orders WHERE o_orderkey = NULL LIMIT 5", "SELECT o_custkey FROM orders WHERE o_orderkey LIKE '%12' LIMIT 5", "SELECT max(o_custkey) FROM orders WHERE o_orderkey = 5 LIMIT 5",
    "SELECT a.o_custkey FROM orders a JOIN orders b ON true WHERE a.o_orderkey = 5 LIMIT 5", "SELECT o_custkey FROM (SELECT * FROM orders LIMIT 3) x WHERE o_orderkey = 1 LIMIT 5"])
def test_lookups_refused(spark, sql):
    with pytest.raises(GateError):
        point_lookup(spark, sql, INDEX)


def test_limits_and_scans(spark):
    spark.read.parquet(f"{SF}/orders.parquet").createOrReplaceTempView("orders")
    assert ensure_limit(spark, "SELECT o_custkey FROM orders", 7).count() == 7
    assert ensure_limit(spark, "SELECT o_custkey FROM orders LIMIT 9", 7).count() == 9
    (scan,) = scan_verdict(spark.sql("SELECT o_custkey FROM orders WHERE o_orderkey = 3"))
    assert not scan["full"] and scan["columns"] == 2
    assert scan_verdict(spark.sql("SELECT o_custkey FROM orders"))[0] == {"columns": 1, "full": True}


def test_entities():
    assert entities.relation_of("Who bought Blue Pen?") == ("buyers", "Blue Pen")
    assert entities.relation_of("买了蓝笔的客户还买了什么")[0] == "copurchase" and entities.relation_of("sales") is None
    got = entities.resolve("sales of blue pen in EUROPE", {"EUROPE": "region"}, {"blue pen large", "red ink"})
    assert ("region", "EUROPE") in got and ("name", "blue pen large") in got
    assert entities.purify(["ab", "abc", "x", "abc"]) == ["abc"] and entities.purify(["ab", "abc"], "ab") == ["ab"]
    assert entities.residue("sales by region today", ["sales", "region"], ("by",)) == "today"
    assert entities.entity_key(" “Acme  Co” ") == "acme co" and entities.entity_key("12-3") is None


def test_presets():
    law = "第一条 aaa\n第二条 bbb\n"
    assert [law[a:z] for a, z in entities.chunk_preset(law, "laws")] == ["第一条 aaa\n", "第二条 bbb\n"]
    book = "Chapter 1\n" + "One two. " * 300 + "\nChapter 2\nx"
    spans = entities.chunk_preset(book, "book")
    assert spans[0][0] == 0 and spans[-1][1] == len(book) and len(spans) > 2
    parts = entities.chunk_table("a|b", ["1|" + "x" * 300] * 10)
    assert len(parts) > 1 and all(p.startswith("a|b\n") for p in parts)


def test_headings_bound_semantic_chunks():
    text = "intro words\n\n# A\npara one.\n\npara two.\n\n## B\nunder b.\n\n" + "Long sentence here. " * 200 + "\n\n## C\n### D\nunder d.\n\n# E\nend"
    spans = entities.chunk_preset(text, "semantic")
    parts = [text[a:z].strip() for a, z in spans]
    assert parts[:2] == ["intro words", "# A\npara one.\n\npara two."] and parts[-1] == "# E\nend" and "## C\n### D\nunder d." in "\n".join(parts)
    assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:])) and all(z - a < 2600 for a, z in spans)
    assert not any("under b" in p and ("para two" in p or "under d" in p) for p in parts) and len([p for p in parts if "Long sentence" in p]) > 1
    assert "".join(text[a:z] for a, z in spans).split() == text.split()
    assert entities.chunk_preset("", "semantic") == [] and len(entities.chunk_preset("# A\nx\n## B\ny", "semantic")) == 2
    from quarry.functions.text import chunk_by_heading

    assert len(chunk_by_heading("# A\nx\n## B\ny\n# C\nz", top_level=True)) == 2
