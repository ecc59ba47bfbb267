"""Operators whose tasks hold little, whatever the tables' sizes."""

import random


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_goods_twins_spreads_orders(spark):
    from quarry.catalog import QUERIES

    assert "REPARTITION_BY_NUM" in plan(QUERIES["goods_twins"](spark, "/root/testdata/sf0.001"))


def test_adjacent_chunks_are_sorted_once(spark):
    """Runs of any length are cut at the span; repeated rows count once, a null place is a piece of its own."""
    from quarry.operators.retrieval import merge_adjacent

    rng = random.Random(1)
    rows = [(d, o) for d in (1, 2, None) for o in rng.sample(range(120), 80)] + [(3, o) for o in range(-5, 60)] + [(3, 7), (4, None), (4, 1), (5, 9)]
    want = set()
    for d in {d for d, _ in rows}:
        places = sorted({o for x, o in rows if x == d and o is not None})
        runs = [p for p in places if p - 1 not in places]
        for a in runs:
            z = next(p for p in places if p >= a and p + 1 not in places)
            want |= {(d, k, min(k + 15, z), min(k + 15, z) - k + 1) for k in range(a, z + 1, 16)}
    df = merge_adjacent(spark.createDataFrame(rows, "doc_id int, ord int"))
    assert plan(df).count("Sort [") == 1
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(want) + 1 and set(got) == want | {(4, None, None, 1)}


def test_merged_runs_are_folded_as_they_are_read(spark):
    """Long stretches, headings, scores without a value and null places; nothing is collected by stretch."""
    from quarry.operators.routes import merged_runs

    rng = random.Random(2)
    rows = [(d, o, d * 1000 + o, rng.choice([None, 1.0, 2.0, 3.0]), rng.choice(["plain", "旧版", "新版", None]), rng.choice([None, "", "plain", "历史口径", "修订版"])) for d in range(40) for o in rng.sample(range(400), 390)]
    want, side = [], lambda o, c: int(c and not o) - int(o and not c)
    run = None
    for d, o, chunk, score, text, head in sorted(rows, key=lambda r: r[:2]):
        ho, hc, to, tc = head == "历史口径", head == "修订版", text == "旧版", text == "新版"
        if run and run["d"] == d and run["z"] + 1 == o and run["n"] < 16 and side(run["o"], run["c"]) * side(ho or to, hc or tc) >= 0:
            takes = not run["h"] and bool(head)
            run |= {"z": o, "n": run["n"] + 1, "o": run["o"] or to or (takes and ho), "c": run["c"] or tc or (takes and hc), "h": run["h"] or bool(head), "s": [*run["s"], score]}
        else:
            want.append(run := {"d": d, "k": chunk, "a": o, "z": o, "n": 1, "o": ho or to, "c": hc or tc, "h": bool(head), "s": [score]})
    best = lambda s: max((x for x in s if x is not None), default=None)
    df = merged_runs(spark.createDataFrame([*rows, (50, None, 7, 1.0, None, None)], "doc_id int, ord int, chunk_id long, score double, text string, heading string"))
    got = [tuple(r) for r in df.select("doc_id", "chunk_id", "ord", "last_ord", "chunks", "score").collect()]
    wanted = {(r["d"], r["k"], r["a"], r["z"], r["n"], best(r["s"])) for r in want}
    assert len(got) == len(want) + 1 and set(got) == wanted | {(50, 7, None, None, 1, 1.0)}
    assert "Aggregate" not in plan(df)


def test_graph_route_takes_a_hop_only_while_there_is_room(spark, monkeypatch):
    """What a hop starts from is broadcast; seeds that fill the room need none, and all hops give the nearest."""
    from quarry.operators import relations as R

    sent = []
    broadcast = R.F.broadcast
    monkeypatch.setattr(R.F, "broadcast", lambda df: sent.append(1) or broadcast(df))
    relations = spark.createDataFrame([(1, 2, 1.0), (1, 3, 1.0), (3, 4, 2.0), (4, 5, 1.0), (1, None, 1.0)], "src long, dst long, weight double")
    mentions = spark.createDataFrame([(10 * e, e) for e in range(1, 7)], "chunk long, entity long")
    for nodes, chunks, n in ((1, [10], 3), (4, [10, 20, 30], 4), (200, [10, 20, 30, 40], 5)):
        sent.clear()
        got = [r.chunk for r in R.graph_route(mentions, relations, [1, 1], nodes).collect()]
        assert sorted(got) == chunks and len(sent) == n


def test_entity_cards_shuffle_no_pairs(spark):
    """Rows are sent whole to their keys; missing names, keys and times, and names that several keys share."""
    from quarry.operators.cards import entity_cards

    rows = [(1, 1, 1, "2024-01-05", "a", "x"), (1, 1, 2, "2024-01-05", "a", "y"), (2, 1, 1, "2024-02-01", "a", None), (3, None, 1, None, "b", "x"), (None, None, None, "2023-02-01", "c", "x")]
    df = spark.createDataFrame(rows, "o_orderkey long, o_custkey long, l_partkey long, d string, p string, q string").selectExpr("*", "to_timestamp(d) AS t")
    cards = entity_cards(df, {"one": "p", "two": "q"}, "t")
    assert "Expand" not in plan(cards)
    want = {("one", "a", 2, 1, 2, 2, "2024-02-01"), ("one", "b", 1, 0, 1, 0, None), ("one", "c", 0, 0, 0, 1, "2023-02-01"), ("two", "x", 2, 1, 1, 2, "2024-01-05"), ("two", "y", 1, 1, 1, 1, "2024-01-05")}
    got = [tuple(r) for r in cards.collect()]
    assert len(got) == len(want) and set(got) == want
