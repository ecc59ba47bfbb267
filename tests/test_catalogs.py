"""Metadata cards and snapshots on small tables."""

import pytest

from quarry.operators import catalogs as C


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_metric_hits(spark):
    metrics = spark.createDataFrame([("stock", ["inventory"], "active"), ("stock value", None, "active"), ("returns", ["refund", " "], "active"), ("old", [], "retired")], "name string, aliases array<string>, status string")
    asked = spark.createDataFrame([(1, "Stock value by region, old"), (2, "inventory and refund"), (3, None), (4, "weather")], "q_id long, question string")
    assert rows(C.metric_hits(asked, metrics)) == [(1, "stock value", "stock value"), (2, "returns", "refund"), (2, "stock", "inventory")]


def test_table_recall(spark):
    forced = spark.createDataFrame([(1, "f"), (1, "f")], "q_id long, table string")
    near = spark.createDataFrame([(1, "f", 0.99), (1, "a", 0.8), (1, "b", 0.7), (1, "c", 0.6)], "q_id long, table string, score double")
    similar = spark.createDataFrame([(1, "a", 0.9), (1, "d", 0.5), (1, "e", 0.4), (2, "d", 0.3)], "q_id long, table string, score double")
    assert rows(C.table_recall(forced, near, similar, 3)) == [(1, "a", 0.9, 1), (1, "b", 0.9, 1), (1, "d", 0.5, 2), (1, "f", 1.0, 0), (2, "d", 0.3, 2)]


def test_relation_cards(spark):
    edges = spark.createDataFrame([("a", "b", "contract", "active", 1.0, 1), ("a", "c", "contract", "draft", 1.0, 1), ("a", "b", "lineage", "suggested", 0.7, 1), ("a", "b", "joinable", "suggested", 0.5, 1), ("a", "c", "synonym", "accepted", 0.9, 1), ("a", "d", "joinable", "rejected", 1.0, 1)], "left_table string, right_table string, kind string, status string, confidence double, seen long")
    got = rows(C.relation_cards(edges, 1))
    assert ("a", "stat_edges", "c", 0.9, 1) in got and ("a", "stat_edges", "b", 0.5, 2) not in got
    assert ("a", "lineage_sources", "b", 0.7, 1) in got and ("b", "lineage_consumers", "a", 0.7, 1) in got
    assert [g for g in got if g[1] == "contracts"] == [("a", "contracts", "b", 1.0, 1), ("b", "contracts", "a", 1.0, 1)]


def test_sync_and_fallback(spark, tmp_path):
    kind = "table string, column string, type string, comment string"
    old = spark.createDataFrame([("t", "a", "int", "by hand"), ("t", "b", "int", ""), ("gone", "x", "int", "")], kind)
    new = spark.createDataFrame([("t", "a", "int", ""), ("t", "b", "bigint", "text"), ("t", "c", "int", None)], kind)
    assert rows(C.synced(old, new)) == [("t", "a", "int", "by hand", "same"), ("t", "b", "bigint", "text", "changed"), ("t", "c", "int", "", "added")]
    assert rows(C.schema_rows({"t": old.select("table")})) == [("t", "table", "string", "")]

    def down():
        raise ConnectionError("down")

    path = str(tmp_path / "snapshot")
    with pytest.raises(ConnectionError):
        C.with_fallback(spark, down, path)
    assert C.with_fallback(spark, lambda: new, path)[1] == "live"
    df, trust = C.with_fallback(spark, down, path)
    assert trust == "snapshot" and df.count() == 3


def test_title_groups(spark):
    names = ["Price list 2024.xlsx", "Price list v2.xlsx", "(3) x.pdf", "2024.md", "...", "Contract_A.doc"]
    docs = spark.createDataFrame([(k, n, "f") for k, n in enumerate(names)], "id long, name string, folder string")
    assert {r.id: r.family for r in C.title_groups(docs, "name", "id").collect()} == {0: "Price", 1: "Price", 2: "3x", 3: "20", 4: "other", 5: "Contract"}
    assert {r.id: r.part for r in C.title_groups(docs, "name", "id", 1).collect()}[1] == 1


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_few_words_meet_questions_without_moving_them(spark, monkeypatch):
    """Questions are shuffled once, by their id, and nothing of them is broadcast; many words give the same hits."""
    metrics = spark.createDataFrame([("stock", ["inventory"], "active"), ("stock value", None, "active"), ("value", [], "active")], "name string, aliases array<string>, status string")
    asked = spark.createDataFrame([(k, text) for k in (1, 1, 2, None) for text in ("Stock value", "inventory")], "q_id long, question string")
    hits = C.metric_hits(asked, metrics)
    assert plan_of(hits).count("Exchange hashpartitioning") == 1 and plan_of(hits).count("BroadcastExchange") == 1
    want = [(1, "stock value", "stock value"), (1, "stock", "inventory"), (2, "stock value", "stock value"), (2, "stock", "inventory"), (None, "stock value", "stock value"), (None, "stock", "inventory"), (None, "value", "value")]
    assert {tuple(r) for r in hits.collect()} == set(want) and hits.count() == len(want)
    monkeypatch.setattr(C, "WORDS", 0)
    assert {tuple(r) for r in C.metric_hits(asked, metrics).collect()} == set(want)


def test_cards_rank_in_one_aggregate(spark):
    """Cards are shuffled once, repeated questions and entries count once, and equal lengths go by word."""
    entries = spark.createDataFrame([("term", "ab", "x"), ("term", "ab", "x"), ("term", "Abc", "y"), ("term", "zc", "z"), ("value", "c", "one"), ("value", "bc", None)], "kind string, word string, note string")
    asked = spark.createDataFrame([(1, "ABC zc"), (1, "abc zc"), (2, None)], "q_id long, question string")
    got = C.cards(asked, entries, 2)
    assert plan_of(got).count("Exchange hashpartitioning") == 1
    assert sorted(map(tuple, got.collect()), key=lambda r: (r[1], r[4])) == [(1, "term", "Abc", "y", 1), (1, "term", "ab", "x", 2), (1, "value", "bc", None, 1), (1, "value", "c", "one", 2)]
