"""The data source over a real database file."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from quarry.functions.text import terms
from quarry.sources.external import SqliteReader, outside_top
from quarry.sources.registry import Policy, SourceRegistry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def path(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("db") / "shop.db")
    db = sqlite3.connect(at)
    db.execute('CREATE TABLE orders (id INTEGER PRIMARY KEY, customer INTEGER, status TEXT, total REAL, "odd ""name" TEXT)')
    rows = spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice").collect()
    db.executemany("INSERT INTO orders VALUES (?, ?, ?, ?, ?)", [(r[0] + 1, r[1], r[2] if r[0] % 11 else None, r[3], f"x{r[0] % 5}") for r in rows])
    db.execute("CREATE TABLE notes (body TEXT)")
    db.executemany("INSERT INTO notes VALUES (?)", [(r[0],) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("text").collect()] + [(None,), ("",)])
    db.execute("CREATE TABLE keyed (k TEXT PRIMARY KEY, v BLOB) WITHOUT ROWID")
    db.execute("INSERT INTO keyed VALUES ('a', x'0102'), ('b', NULL)")
    db.execute("CREATE TABLE vacant (x INTEGER)")
    db.execute("CREATE INDEX by_customer ON orders (customer)")
    db.execute("ANALYZE")
    db.commit()
    db.close()
    return at


def test_reads_in_partitions_what_the_database_holds(spark, path):
    read = SqliteReader(spark, path)
    assert read.problems == []
    df = read("orders")
    want = spark.read.parquet(f"{SF}/orders.parquet")
    assert df.dtypes == [("id", "bigint"), ("customer", "bigint"), ("status", "string"), ("total", "double"), ('odd "name', "string")]
    assert df.count() == want.count() and df.rdd.getNumPartitions() == 4
    assert df.agg(F.round(F.sum("total"), 2)).first() == want.agg(F.round(F.sum("o_totalprice"), 2)).first()
    assert [tuple(r) for r in read("keyed").orderBy("k").collect()] == [("a", bytearray(b"\x01\x02")), ("b", None)] and read("vacant").count() == 0
    with pytest.raises(Exception, match="no table"):
        read("absent").count()


@pytest.mark.parametrize("where", ["id = 7", "id IN (3, 5, 99999)", "status = 'F' AND total > 1000.5", "status IS NULL", "status IS NOT NULL AND customer <= 20", "startswith(status, 'F')", "contains(`odd \"name`, '3')", "NOT id > 9", "id % 2 = 0 AND total < 5000", "status <=> 'O'", "total >= 10 OR id = 1", "status LIKE 'f%'"])
def test_filters_give_the_same_rows_wherever_they_run(spark, path, where):
    df = SqliteReader(spark, path)("orders")
    whole = spark.createDataFrame(df.collect(), df.schema)
    assert sorted(map(str, df.where(where).collect())) == sorted(map(str, whole.where(where).collect()))


def test_filters_reach_the_database(spark, path):
    df = SqliteReader(spark, path)("orders").where("id = 7 AND customer % 2 = customer % 2")
    text = df._jdf.queryExecution().executedPlan().toString()
    (left,) = [line for line in text.splitlines() if "Filter (" in line]
    assert "= 7" not in left and "% 2" in left and df.count() == 1  # what is left to Spark is the part that the database wasn't given


def test_policies_plans_and_probe(spark, path, tmp_path):
    read = SqliteReader(spark, path, Policy(rows=10))
    rows, more = read.fetch("orders", rows=50)
    assert rows.count() == 10 and more
    rows, more = read.fetch("orders", "id < 4")
    assert not more and {r.id for r in rows.collect()} <= {1, 2, 3}
    assert "by_customer" in read.explain("SELECT total FROM orders WHERE customer = 5") and read.full_scans("SELECT total FROM orders WHERE customer = 5") == []
    assert read.full_scans("SELECT total FROM orders WHERE status = 'F'") == ["orders"]
    for bad in ("SELECT nosuch FROM orders", "SELEC 1", "SELECT 1; DROP TABLE orders"):
        with pytest.raises(ValueError):
            read.explain(bad)
    seen = {(r.table, r.column): (r.type, r.rows) for r in read.probe().collect()}
    assert seen["orders", "id"] == ("bigint", read("orders").count()) and ("keyed", "v") in seen and seen["vacant", "x"][1] == -1
    empty = tmp_path / "empty.db"
    sqlite3.connect(empty).close()
    assert SqliteReader(spark, str(empty)).problems == ["no table is visible"] and SqliteReader(spark, str(tmp_path / "none.db")).problems
    registry = SourceRegistry({"shop": lambda: SqliteReader(spark, path)})
    assert registry.probe("shop", "orders") and not registry.probe("shop", "absent")


def test_top_of_outside_records(spark, path):
    df = SqliteReader(spark, path)("notes")
    texts = [r.body for r in df.collect()]
    question = " ".join((texts[0] or "").split()[:6])
    asked = set(terms(question))
    want = sorted({(-n, t) for t in texts if (n := len(asked & set(terms(t or ""))))})[:5]
    assert [(r.position, r.text, r.hits) for r in outside_top(df, "body", question).collect()] == [(k, t, -n) for k, (n, t) in enumerate(want)]
    assert outside_top(df, "body", "zzzz").count() == 0
