"""Pairs of ids that share a tag, by classes and blocks."""

from quarry.operators import relations as R


def test_array_overlap_pairs_blocks(spark):
    """All pairs, each once, in blocks of any size; ids and tags may be null, and pairs are never shuffled."""
    left = [(k % 40, [k % 3, 5 + k % 2, None]) for k in range(60)] + [(None, [1, 1]), (41, None), (42, [])]
    right = [(k, [k % 4]) for k in range(30)] + [(None, [2]), (31, [99])]
    want = {(a, b) for a, s in left for b, r in right if ({*(s or [])} - {None}) & {*r}}
    a, b = spark.createDataFrame(left, "x long, tags array<long>"), spark.createDataFrame(right, "y long, tags array<long>")
    for block in (3, 1024):
        got = [tuple(r) for r in R.array_overlap(a, b, "x", "y", "tags", block).collect()]
        assert len(got) == len(want) and set(got) == want
    plan = R.array_overlap(a, b, "x", "y", "tags")._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in next(line for line in plan.splitlines() if "Exchange" in line), "what is shuffled last is blocks"


def test_array_overlap_keeps_one_ids_pairs(spark):
    """Only the last explode is in generated code, which keeps all that it makes of a row; lines are made distinct before they get tags."""
    from quarry.catalog import QUERIES

    for name in ("shared_tag_pairs", "all_shared_tag_pairs"):
        pairs = QUERIES[name](spark, "/root/testdata/sf0.001")
        pairs.collect()
        lines = pairs._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines()
        made = [line.strip(" +-:") for line in lines[: next(k for k, line in enumerate(lines) if "Exchange" in line)] if "Generate explode" in line]
        assert len(made) == 2 and made[0].startswith("*(") and made[1].startswith("Generate"), made
        scans = [k for k, line in enumerate(lines) if "FileScan parquet" in line and "l_suppkey" in line]
        assert scans and all("HashAggregate" in next(line for line in reversed(lines[:k]) if "Aggregate" in line or "Generate" in line) for k in scans)


def test_shared_tag_pairs_are_pairs(spark):
    """The query gives the pairs themselves, as many as the counts add up to."""
    from quarry.catalog import QUERIES

    sf = "/root/testdata/sf0.001"
    pairs, counts = QUERIES["shared_tag_pairs"](spark, sf), QUERIES["shared_tag_counts"](spark, sf)
    assert pairs.columns == ["a", "b"]
    assert sorted(map(tuple, pairs.groupBy("a").count().collect())) == sorted(map(tuple, counts.collect()))


def test_chunk_graph_by_chunk(spark):
    """Names of all rows of a chunk count for its relations, of any document; noise, null chunks and bad JSON give nothing; one aggregate by chunk."""
    from quarry.operators import routes

    raw = [
        (1, 1, 'so {"entities": [{"name": " Ab  c "}, {"name": "x"}, {"name": "12"}, {"name": "De", "type": "t"}], "relations": [{"source": "AB C", "target": "de"}, {"source": "de", "target": "De"}, {"source": "de", "target": "fg", "type": "k", "weight": 2}, {"source": "x", "target": "de"}]} end'),
        (1, 2, '{"entities": [{"name": "fg"}]}'),
        (2, 1, '{"relations": [{"source": "ab c", "target": "de"}]}'),
        (None, 1, '{"entities": [{"name": "hi"}, {"name": "jk"}], "relations": [{"source": "hi", "target": "jk"}]}'),
        (3, 3, "none"),
        (4, None, None),
    ]
    mentions, relations = routes.chunk_graph(spark.createDataFrame(raw, "chunk_id long, doc_id long, raw string"))
    assert sorted(map(tuple, mentions.where("chunk_id IS NOT NULL").collect())) == [(1, 1, "ab c", "other"), (1, 1, "de", "t"), (1, 2, "fg", "other")]
    assert sorted(map(tuple, relations.collect())) == [(1, "ab c", "de", "related", 1.0), (1, "de", "fg", "k", 2.0)]
    assert "Join" not in relations._jdf.queryExecution().executedPlan().toString()
    stats = routes.graph_stats(mentions, relations)
    assert sorted(map(tuple, stats.collect())) == [(1, 4, 2, 2), (2, 1, 0, 1)]
    assert "Join" not in stats._jdf.queryExecution().executedPlan().toString()


def test_title_similarity_makes_each_set_once(spark):
    """The plan splits the title and the question once each; missing and blank titles are like nothing."""
    from pyspark.sql import functions as F

    from quarry.operators.routes import title_similarity

    got = spark.createDataFrame([("Cold promo",), ("cold",), ("...",), (None,)], "title string").select("title", F.round(title_similarity(F.col("title"), "cold promo"), 6).alias("s"))
    assert {r.title: r.s for r in got.collect()} == {"Cold promo": 1.0, "cold": round(5 / 11, 6), "...": 0.0, None: 0.0}
    assert got._jdf.queryExecution().analyzed().toString().count("split(") == 2


def test_equal_statements_are_read_once(spark):
    """Rows that stand for several equal statements count as often."""
    from pyspark.sql import functions as F

    from quarry.operators import sqllog

    log = spark.createDataFrame([("a", "SELECT o.x, c.y FROM o JOIN c ON o.k = c.k")] * 3 + [("a", "SELECT c.y, c.z FROM c"), ("b", "SELECT c.y, c.z FROM c"), ("b", "SELECT (")], "src string, sql string")
    once = log.groupBy("src", "sql").agg(F.count("*").alias("times"))
    each, counted = sqllog.usage_edges(sqllog.mined(log, "sql"), "src"), sqllog.usage_edges(sqllog.mined(once, "sql"), "src", weight="times")
    assert sorted(map(tuple, each.collect())) == sorted(map(tuple, counted.collect())) and each.schema == counted.schema
