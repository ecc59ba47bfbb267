"""Free SQL over scoped tables: nothing but the scoped views is read, and nothing of sensitive columns is shown."""

import pytest

from quarry.plans import analysed as A
from quarry.plans.governance import Binding, GateError, Principal, ScopeError, Unrestricted, run_scoped

ROWS = {
    "users": ("id int, owner int, name string, password string, phone string", [(1, 1, "ann", "pw1", "p1"), (2, 1, "bob", "pw2", "p2"), (3, 2, "eve", "pw3", "p3")]),
    "parents": ("id int, parent int", [(1, 2), (2, 3), (3, None)]),
    "orders": ("oid int, owner int, uid int, total double", [(10, 1, 1, 5.0), (11, 1, 2, 7.0), (12, 2, 3, 900.0)]),
}
BOUND = {"users": Binding(owner_col="owner"), "orders": Binding(owner_col="owner"), "parents": Binding("global")}
ANN = Principal("ann", owners=(1,))


@pytest.fixture(scope="module")
def other(spark):
    """Tables that no scope covers: a catalogue's and a global temporary view."""
    spark.sql("DROP TABLE IF EXISTS cat_secret")
    spark.createDataFrame([(1, "seen")], "k int, v string").write.saveAsTable("cat_secret")
    spark.createDataFrame([(1, "seen")], "k int, v string").createOrReplaceGlobalTempView("secret_view")
    yield
    spark.sql("DROP TABLE cat_secret")
    spark.catalog.dropGlobalTempView("secret_view")


def run(spark, sql, who=ANN, **how):
    return run_scoped(spark, sql, lambda s, n: s.createDataFrame(ROWS[n][1], ROWS[n][0]), BOUND, who, **how)


def rows(result):
    return sorted(tuple(r) for r in result.df.collect())


@pytest.mark.parametrize("sql", [
    "SELECT u.id, c.v FROM users u JOIN identifier('cat_secret') c ON true", "SELECT u.id, c.v FROM users u JOIN IDENTIFIER('cat' || '_secret') c ON true",
    "SELECT u.id FROM users u, cat_secret", "SELECT u.id, v FROM users u JOIN global_temp.secret_view ON true", "SELECT u.id, (SELECT max(v) FROM cat_secret) FROM users u",
    "SELECT identifier('reflect')('java.lang.System', 'getProperty', 'user.home') FROM users", "FROM users |> JOIN cat_secret ON true |> SELECT v", "WITH RECURSIVE cat_secret AS (SELECT * FROM cat_secret) SELECT * FROM users, cat_secret",
    "SELECT * FROM users VERSION AS OF 1", "SELECT * FROM users TIMESTAMP AS OF '2020-01-01'", "SELECT * FROM users, LATERAL (SELECT v FROM cat_secret) x", "SELECT * FROM users WHERE EXISTS (FROM cat_secret |> WHERE k = 1)",
    "SELECT u.id, r.id FROM users u, range(3) r", "SELECT * FROM users TABLESAMPLE (50 PERCENT)", "EXECUTE IMMEDIATE 'SELECT * FROM cat_secret'", "SELECT * FROM users UNION ALL (TABLE cat_secret)", "DECLARE x INT",
])
def test_only_scoped_views_are_read(spark, other, sql):
    with pytest.raises((GateError, ScopeError)):
        run(spark, sql).df.collect()


@pytest.mark.parametrize("sql, want", [
    ("FROM users |> WHERE id > 0 |> SELECT id", [(1,), (2,)]),
    ("TABLE orders", [(10, 1, 1, 5.0), (11, 1, 2, 7.0)]),
    ("WITH RECURSIVE up AS (SELECT id, 0 AS n FROM users UNION ALL SELECT p.parent, n + 1 FROM up JOIN parents p ON p.id = up.id WHERE n < 2 AND p.parent IS NOT NULL) SELECT DISTINCT id FROM up", [(1,), (2,), (3,)]),
    ("SELECT count(*) FROM users u, LATERAL (SELECT total FROM orders o WHERE o.uid = u.id) x", [(2,)]),
    ("SELECT x FROM users LATERAL VIEW explode(array(id, 9)) t AS x WHERE id = 1", [(1,), (9,)]),
    ("SELECT owner, sum(total) AS t FROM orders GROUP BY ROLLUP (owner)", None),
    ("SELECT id FROM users EXCEPT SELECT uid FROM orders WHERE total > 6 INTERSECT SELECT id FROM users", [(1,)]),
])
def test_what_reads_passes(spark, sql, want):
    got = run(spark, sql)
    assert want is None or rows(got) == want


def test_principals_deny_unless_proven(spark):
    assert rows(run(spark, "SELECT id FROM users", Principal("who"))) == []
    assert rows(run(spark, "SELECT id FROM users", Principal("who", customers=(1, 2)))) == []
    assert len(rows(run(spark, "SELECT id FROM users", Principal("who", proof=Unrestricted("who", True, True))))) == 3
    with pytest.raises(ScopeError):
        Principal("who", proof=Unrestricted("root", True, True))
    with pytest.raises(ScopeError):
        Unrestricted("who", True, False)


@pytest.mark.parametrize("sql, hidden", [
    ("SELECT id, password FROM users", ["password"]),
    ("SELECT id, password AS p FROM users", ["p"]),
    ("SELECT id, upper(substr(password, 1, 3)) AS p, concat(name, phone) AS q, name FROM users", ["p", "q"]),
    ("WITH a AS (SELECT id AS i, password AS x FROM users), b AS (SELECT i, x AS y FROM a) SELECT y, i FROM b", ["y"]),
    ("SELECT z.x FROM (SELECT max(password) AS x, count(*) AS n FROM users) z", ["x"]),
    ("SELECT n, k FROM (SELECT count(*) AS n, count(password) AS k FROM users)", ["k"]),
    ("SELECT name AS a FROM users UNION ALL SELECT password FROM users", ["a"]),
    ("SELECT id, (SELECT max(password) FROM users) AS m FROM users", ["m"]),
    ("SELECT id, lag(password) OVER (ORDER BY id) AS l, row_number() OVER (ORDER BY id) AS r FROM users", ["l"]),
    ("SELECT id, case WHEN password LIKE 'pw1%' THEN 1 ELSE 0 END AS guess FROM users", ["guess"]),
    ("SELECT x FROM users LATERAL VIEW explode(array(password)) t AS x", ["x"]),
    ("SELECT a.p FROM users u, LATERAL (SELECT u.password AS p) a", ["p"]),
    ("WITH RECURSIVE r AS (SELECT id, name AS v, password AS w FROM users UNION ALL SELECT id + 10, w, v FROM r WHERE id < 5) SELECT id, v FROM r", ["v"]),
    ("SELECT named_struct('a', password) AS s, array(phone, 'x') AS t, id FROM users", ["s", "t"]),
    ("FROM users |> EXTEND password AS p |> SELECT id, p", ["p"]),
    ("SELECT u.* FROM users u JOIN orders o ON o.uid = u.id", ["password", "phone"]),
    ("SELECT total AS token, id FROM orders JOIN users ON uid = id", ["token"]),
])
def test_sensitive_columns_are_null_under_any_name(spark, sql, hidden):
    got = run(spark, sql)
    assert got.redacted == hidden
    for r in got.df.collect():
        assert all(r[c] is None for c in hidden) and not any("pw" in str(v) or str(v) in ("p1", "p2", "p3") for v in r)
    kept = [c for c in got.df.columns if c not in hidden]
    assert not kept or any(r[kept[0]] is not None for r in got.df.collect())


@pytest.mark.parametrize("sql", [
    "SELECT id FROM users WHERE password LIKE 'pw1%'", "SELECT id FROM users WHERE id = 1 OR length(password) > 2", "SELECT count(*) FROM users GROUP BY password", "SELECT id FROM users ORDER BY password",
    "SELECT a.id FROM users a JOIN users b ON a.password = b.password", "SELECT id FROM users WHERE id IN (SELECT id FROM users WHERE password > 'a')", "SELECT id FROM users WHERE name IN (SELECT password FROM users)",
    "SELECT DISTINCT password FROM users", "SELECT count(*) FILTER (WHERE password = 'pw1') FROM users", "SELECT rank() OVER (ORDER BY phone) FROM users", "WITH a AS (SELECT id, password AS x FROM users) SELECT id FROM a WHERE x = 'pw1'",
    "SELECT password FROM users INTERSECT SELECT name FROM users", "SELECT owner, count(*) FROM users GROUP BY owner HAVING max(password) > 'a'", "SELECT id FROM users WHERE EXISTS (SELECT 1 FROM orders WHERE users.password = 'pw1')",
])
def test_rows_are_not_told_apart_by_sensitive_columns(spark, sql):
    with pytest.raises(GateError):
        run(spark, sql)


def test_other_words_are_sensitive_where_said(spark):
    assert run(spark, "SELECT total AS t, oid FROM orders", sensitive=("total",)).redacted == ["t"]
    assert run(spark, "SELECT total AS t, oid FROM orders").redacted == []


def test_origins_of_a_frame(spark):
    df = spark.createDataFrame([(1, "a", 2.0)], "a int, b string, c double")
    df = df.selectExpr("a AS x", "c * 100 AS y", "b").groupBy("x").agg({"y": "max"}).toDF("x", "m")
    x, m = A.Lineage(A.analysed(df)).columns()
    assert ({c for _, c in x.sources}, x.how) == ({"a"}, "column") and ({c for _, c in m.sources}, m.how) == ({"c"}, "max")
