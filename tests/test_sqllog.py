"""Mining of logged SQL: the scanner, the counts and the calibration."""

from collections import Counter

import pytest

from quarry.operators import sqllog as S


def short(found):
    return {f"{t}.{c}:{r}" for t, c, r in found}


@pytest.mark.parametrize("sql, uses, joins, edges", [
    ("SELECT o.Total, c.name FROM Orders o JOIN db.customer AS c ON o.cid = c.id WHERE o.day > '2020'", {"orders.total:select", "customer.name:select", "orders.cid:on", "customer.id:on", "orders.day:where"}, {("customer", "orders")}, {("customer", "id", "orders", "cid")}),
    ("select a.x from t1 a, t2 b left join t3 c on b.k = c.k and c.v = 'FROM z JOIN q' where a.y = b.y", {"t1.x:select", "t2.k:on", "t3.k:on", "t3.v:on", "t1.y:where", "t2.y:where"}, {("t1", "t2"), ("t2", "t3")}, {("t2", "k", "t3", "k")}),
    ("SELECT a.x /* , b.y FROM z */ FROM t a -- JOIN nothing n ON n.a = a.b\n WHERE a.s = 'it''s -- not' AND a.q LIKE \"a.b\" # end", {"t.x:select", "t.s:where", "t.q:where"}, set(), set()),
    ("WITH r AS (SELECT o.k, sum(o.v) AS s FROM orders o GROUP BY o.k), q(a, b) AS (SELECT r.k, 1 FROM r) SELECT r.s, c.name FROM r JOIN cust c ON c.id = r.k JOIN q ON q.a = c.id", {"orders.k:select", "orders.v:select", "orders.k:group", "cust.name:select", "cust.id:on"}, set(), set()),
    ("SELECT x.k FROM (SELECT o.k FROM orders o JOIN lines l ON l.ok = o.id) x JOIN cust c ON x.k = c.k", {"orders.k:select", "lines.ok:on", "orders.id:on", "cust.k:on"}, {("lines", "orders")}, {("lines", "ok", "orders", "id")}),
    ("SELECT c.name FROM cust c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.cid = c.id) AND c.z IN (SELECT z.z FROM zones z)", {"cust.name:select", "orders.cid:where", "cust.id:where", "cust.z:where", "zones.z:select"}, set(), set()),
    ("SELECT o.a FROM orders o JOIN cust c ON o.cid = c.id + 1 JOIN zone z ON upper(z.k) = c.k", {"orders.a:select", "orders.cid:on", "cust.id:on", "zone.k:on", "cust.k:on"}, {("cust", "orders"), ("cust", "zone")}, set()),
    ("SELECT `o`.`Total`, \"c\".\"Name\" FROM `db`.`orders` `o` CROSS JOIN \"s\".\"cust\" \"c\" ORDER BY c.name, o.d LIMIT 3", {"orders.total:select", "cust.name:select", "cust.name:order", "orders.d:order"}, {("cust", "orders")}, set()),
    ("SELECT a.x FROM t a WHERE a.x > 1 UNION ALL SELECT a.y FROM u a JOIN v ON v.k = a.k HAVING max(a.z) > 2", {"t.x:select", "t.x:where", "u.y:select", "v.k:on", "u.k:on", "u.z:having"}, {("u", "v")}, {("u", "k", "v", "k")}),
    ("SELECT e.a, m.a FROM emp e JOIN emp m ON e.boss = m.id", {"emp.a:select", "emp.boss:on", "emp.id:on"}, set(), {("emp", "boss", "emp", "id")}),
    ("SELECT t.a FROM t JOIN u USING (k, b) LEFT JOIN v ON v.x = u.x WHERE left(t.a, 2) = 'b'", {"t.a:select", "v.x:on", "u.x:on", "t.a:where"}, {("t", "u"), ("u", "v")}, {("u", "x", "v", "x")}),
    ("SELECT u.a, row_number() OVER (PARTITION BY u.b ORDER BY u.c) FROM unnest(array(1)) x, u", {"u.a:select", "u.b:select", "u.c:select"}, set(), set()),
    ("SELECT total FROM orders WHERE day > ? AND k = :key", set(), set(), set()),
    ("(SELECT a.x FROM t a) UNION (SELECT b.y FROM s b)", {"t.x:select", "s.y:select"}, set(), set()),
    ("SELECT a.x FROM t a; SELECT a.y FROM s a JOIN r ON r.k = a.k", {"t.x:select", "s.y:select", "r.k:on", "s.k:on"}, {("r", "s")}, {("r", "k", "s", "k")}),
])
def test_scan(sql, uses, joins, edges):
    got = S.scan(sql)
    assert (short(got[0]), got[1], got[2]) == (uses, joins, edges)


@pytest.mark.parametrize("sql", ["DROP TABLE x", "SELECT (a.b FROM t a", "SELECT a.b) FROM t a", "SELECT 'open FROM t", "SELECT a FROM t /* open", "hello world", "UPDATE t SET a = (SELECT 1)", "(((", "SELECT `a FROM t"])
def test_unreadable(sql):
    with pytest.raises((S.Unreadable, IndexError)):
        S.scan(sql)


def test_scanner_ends_on_anything():
    import random

    rng = random.Random(4)
    bits = ["SELECT", "FROM", "JOIN", "ON", "(", ")", ",", ".", "=", "a", "b", "t", "AS", "WITH", "UNION", "WHERE", ";", "'x'", "`q`", "*", "order", "by", "in"]
    for _ in range(3000):
        try:
            S.scan("SELECT " + " ".join(rng.choice(bits) for _ in range(rng.randrange(30))))
        except (S.Unreadable, IndexError):
            pass


def test_counts_and_calibration(spark):
    good = ["SELECT o.a, c.b FROM orders o JOIN cust c ON o.k = c.k", "select c.b from cust c, orders o where o.a = 1", "SELECT o.a FROM orders o WHERE o.z > 0", "SELECT " + ", ".join(f"t.c{i}" for i in range(30)) + " FROM t JOIN u ON t.a = u.a"]
    rows = [(i, s, " Shop " if i % 2 else "shop") for i, s in enumerate(good * 3)] + [(90, "SELECT (", "shop"), (91, None, None), (92, " ", "x"), (93, good[0], "other"), (94, "DROP TABLE t", None)]
    log = S.mined(spark.createDataFrame(rows, "id int, sql string, ds string"), "sql")
    assert {r.id for r in log.where("mined.error IS NOT NULL").collect()} == {90, 94}
    want = Counter()
    for _, s, ds in rows:
        try:
            uses, joins, _ = S.scan(s) if s and s.strip() else (set(), set(), set())
        except (S.Unreadable, IndexError):
            continue
        key = (ds or "").strip().lower()
        for a, b in joins:
            want[key, a, "", b, ""] += 1
        cols = sorted({(t, c) for t, c, r in uses if r in ("select", "where", "having")})
        if len(cols) <= 24:
            for i, a in enumerate(cols):
                for b in cols[i + 1 :]:
                    want[(key, *a, *b)] += 1
    got = {tuple(r)[:5]: (r.n, r.frequency, r.usage) for r in S.usage_edges(log, "ds").collect()}
    top = {k[0]: max(n for x, n in want.items() if x[0] == k[0]) for k in want}
    assert got == {k: (n, n / top[k[0]], 0.4 * (n / top[k[0]])) for k, n in want.items()}
    assert S.usage_edges(log, "ds", most_edges=2).where("source = 'shop'").count() == 2
    known = spark.createDataFrame([("shop", "cust", "", "orders", "", 0.9, 5, "accepted"), ("shop", "x", "", "y", "", 0.3, 1, "rejected")], "source string, left_table string, left_column string, right_table string, right_column string, confidence double, seen int, status string")
    after = {tuple(r)[:5]: tuple(r)[5:] for r in S.calibrated_by_log(known, S.usage_edges(log, "ds")).collect()}
    n, frequency, usage = got["shop", "cust", "", "orders", ""]
    assert after["shop", "cust", "", "orders", ""] == (min(1.0, 0.6 * 0.9 + usage), 5 + n, "accepted")
    assert after["shop", "x", "", "y", ""] == (0.3, 1, "rejected")
    assert after["other", "cust", "", "orders", ""] == (0.4, 1, "pending")
