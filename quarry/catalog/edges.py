"""Edges that are inferred between columns and tables, recall cards and learning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import edges as E
from .registry import ORACLE, query

COLUMNS = {"customer": ["c_custkey", "c_nationkey", "c_mktsegment"], "nation": ["n_nationkey", "n_regionkey", "n_name"], "region": ["r_regionkey", "r_name"], "supplier": ["s_nationkey", "s_name"]}
NUMERIC = {"c_custkey", "c_nationkey", "n_nationkey", "n_regionkey", "r_regionkey", "s_nationkey"}
ALL = [(t, c) for t, cols in COLUMNS.items() for c in cols]
VALUES = " UNION ALL ".join(f"SELECT DISTINCT '{t}.{c}' AS col, '{'numeric' if c in NUMERIC else 'string'}' AS kind, CAST({c} AS VARCHAR) AS value FROM {t}" for t, c in ALL)
BAND = "CASE WHEN o >= 0.9 THEN 0.90 WHEN o >= 0.6 THEN 0.75 WHEN o >= 0.3 THEN 0.55 WHEN o >= 0.1 THEN 0.35 END"


def values(t):
    return E.column_values({n: t(n) for n in COLUMNS}, COLUMNS, None)


@query(f"WITH v AS ({VALUES}), n AS (SELECT col, kind, count(*) AS n FROM v GROUP BY 1, 2 HAVING count(*) >= 3), c AS (SELECT a.col AS l, b.col AS r, count(*) AS common FROM v a JOIN v b ON a.kind = b.kind AND a.value = b.value AND a.col < b.col AND split_part(a.col, '.', 1) <> split_part(b.col, '.', 1) WHERE a.col IN (SELECT col FROM n) AND b.col IN (SELECT col FROM n) GROUP BY 1, 2), s AS (SELECT l, r, common / least(x.n, y.n) AS o FROM c JOIN n x ON c.l = x.col JOIN n y ON c.r = y.col) SELECT l AS \"left\", r AS \"right\", round(o, 6) AS overlap, least(0.95, round({BAND} + CASE WHEN regexp_replace(lower(split_part(l, '.', 2)), '[^a-z0-9]', '', 'g') = regexp_replace(lower(split_part(r, '.', 2)), '[^a-z0-9]', '', 'g') THEN 0.05 ELSE 0 END, 2)) AS confidence FROM s WHERE o >= 0.1")
def joinable_edges(t, spark):
    return E.joinable_edges(values(t)).withColumn("confidence", F.col("confidence").cast("double"))


#: Tables whose columns are compared, by the prefix of their columns.
SHORT = {"customer": "c", "lineitem": "l", "nation": "n", "orders": "o", "part": "p", "region": "r", "supplier": "s"}


def told_columns(t):
    """(table, column, comment) of columns that hold more than one value; the last part of a name is its comment if it says what is held."""
    out = None
    for name, k in SHORT.items():
        df = t(name)
        wide = df.agg(*[(F.min(c) < F.max(c)).alias(c) for c in df.columns]).unpivot([], df.columns, "column", "varied").where("varied").select(F.lit(name).alias("table"), "column")
        out = wide if out is None else out.unionByName(wide)
    last = F.substring_index("column", "_", -1)
    return out.withColumn("comment", F.when(last.rlike("key$|name|date|price"), last).otherwise(""))




#: The columns of the tables above without their prefix, for the comparison.
HELD = {
    "customer": "custkey name nationkey acctbal mktsegment", "lineitem": "orderkey partkey suppkey linenumber quantity extendedprice discount tax returnflag linestatus shipdate", "nation": "nationkey name regionkey",
    "orders": "orderkey custkey orderstatus totalprice orderdate orderpriority", "part": "partkey name brand type size retailprice", "region": "regionkey name", "supplier": "suppkey name nationkey acctbal",
}
TOLD = "c AS (SELECT tab, col, CASE WHEN regexp_matches(split_part(col, '_', 2), 'key$|name|date|price') THEN split_part(col, '_', 2) ELSE '' END AS m FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS tab, '{SHORT[n]}_{c}' AS col, min({SHORT[n]}_{c}) < max({SHORT[n]}_{c}) AS varied FROM {n}" for n, cs in HELD.items() for c in cs.split()) + ") WHERE varied)"


@query(f"WITH {TOLD}, d AS (SELECT tab || '.' || col AS col, regexp_replace(lower(col), '[^a-z0-9]', '', 'g') AS n, m FROM c), p AS (SELECT a.col AS l, b.col AS r, a.n AS x, b.n AS y, a.m <> '' AND a.m = b.m AS told FROM d a JOIN d b ON a.col < b.col AND a.n <> b.n), s AS (SELECT l, r, told, round(CASE WHEN contains(x, y) OR contains(y, x) THEN 0.5 + 0.5 * least(length(x), length(y)) / greatest(length(x), length(y)) ELSE len(list_intersect(list_distinct(string_split(x, '')), list_distinct(string_split(y, '')))) / len(list_distinct(list_concat(string_split(x, ''), string_split(y, '')))) END, 6) AS s FROM p) SELECT l AS \"left\", r AS \"right\", s AS similarity, CAST(CASE WHEN told AND s > 0.5 THEN 0.95 WHEN told THEN 0.85 WHEN s > 0.7 THEN 0.6 WHEN s > 0.5 THEN 0.4 END AS DOUBLE) AS confidence FROM s WHERE told OR s > 0.5")
def synonym_edges(t, spark):
    """Columns of the given tables that hold more than one value and mean the same under other names."""
    return E.synonym_edges(told_columns(t).select(F.concat_ws(".", "table", "column").alias("column"), F.col("column").alias("name"), "comment"))


COUNTS = " UNION ALL ".join(f"SELECT '{t}.{c}' AS col, '{'numeric' if c in NUMERIC else 'string'}' AS kind, CAST({c} AS VARCHAR) AS value, count(*) AS n FROM {t} GROUP BY 3" for t, c in ALL)


@query(f"WITH c AS ({COUNTS}), d AS (SELECT col, kind, count(*) AS d FROM c GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY col ORDER BY n DESC, value) AS k FROM c), w AS (SELECT r.col, r.kind, value, n / sum(n) OVER (PARTITION BY r.col) AS w, d FROM r JOIN d ON r.col = d.col WHERE k <= 10) SELECT * FROM (SELECT a.col AS \"left\", b.col AS \"right\", round(any_value(least(a.d, b.d) / greatest(a.d, b.d)) * sum(least(a.w, b.w)), 6) AS similarity FROM w a JOIN w b ON a.kind = b.kind AND a.value = b.value AND a.col < b.col AND split_part(a.col, '.', 1) <> split_part(b.col, '.', 1) GROUP BY 1, 2) WHERE similarity >= 0.5")
def distribution_edges(t, spark):
    counts = None
    for table, cols in COLUMNS.items():
        wide = t(table).select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot([], cols, "c", "value").where("value IS NOT NULL AND value <> ''")
        part = wide.groupBy(F.concat(F.lit(f"{table}."), "c").alias("column"), "value").agg(F.count("*").alias("n"))
        counts = part if counts is None else counts.unionByName(part)
    return E.distribution_edges(values(t), counts)


@query("WITH r AS (" + " UNION ALL ".join(f"SELECT 'part.{a}' AS \"left\", 'part.{b}' AS \"right\", round(corr({a}, {b}), 6) AS r FROM part" for a, b in (("p_partkey", "p_size"), ("p_partkey", "p_retailprice"), ("p_size", "p_retailprice"))) + ") SELECT *, CAST(CASE WHEN abs(r) >= 0.9 THEN 0.80 WHEN abs(r) >= 0.7 THEN 0.60 ELSE 0.40 END AS DOUBLE) AS confidence FROM r WHERE abs(r) >= 0.5")
def correlated_edges(t, spark):
    return E.correlated_edges(t("part"), "part", ["p_partkey", "p_size", "p_brand", "p_retailprice"])


#: Domains of the tables; what orders' description names.
DOMAINS = {"customer": "sales", "lineitem": "sales", "nation": "place", "orders": "sales", "part": "goods", "region": "place", "supplier": "goods"}
MENTIONS = {"orders": ["customer", "nation"]}


@query(f"""WITH {TOLD}, k AS (SELECT DISTINCT tab, split_part(col, '_', 2) AS col, m FROM c), n AS (SELECT tab, count(*) AS n FROM k GROUP BY 1),
d(tab, dom) AS (VALUES {', '.join(f"('{k}', '{v}')" for k, v in DOMAINS.items())}), told(l, r) AS (VALUES ('customer', 'orders'), ('nation', 'orders')),
s AS (SELECT a.tab AS l, b.tab AS r, count(*) AS shared, count(*) FILTER (WHERE a.m <> '' AND a.m = b.m) AS same FROM k a JOIN k b ON a.col = b.col AND a.tab < b.tab GROUP BY 1, 2),
j AS (SELECT DISTINCT least(split_part("left", '.', 1), split_part("right", '.', 1)) AS l, greatest(split_part("left", '.', 1), split_part("right", '.', 1)) AS r FROM ({ORACLE["joinable_edges"]}) WHERE confidence >= 0.9),
p AS (SELECT coalesce(s.l, told.l) AS l, coalesce(s.r, told.r) AS r, coalesce(shared, 0) AS shared, coalesce(same, 0) AS same, told.l IS NOT NULL AS mention FROM s FULL JOIN told ON s.l = told.l AND s.r = told.r),
q AS (SELECT p.*, shared / least(x.n, y.n) AS ratio, dx.dom = dy.dom AS near, j.l IS NOT NULL AS joined FROM p JOIN n x ON p.l = x.tab JOIN n y ON p.r = y.tab JOIN d dx ON p.l = dx.tab JOIN d dy ON p.r = dy.tab LEFT JOIN j ON p.l = j.l AND p.r = j.r),
b AS (SELECT *, CASE WHEN mention THEN 0.85 WHEN shared >= 2 AND ratio >= 0.5 THEN 0.70 WHEN shared >= 2 AND ratio >= 0.3 THEN 0.55 WHEN shared >= 2 AND ratio >= 0.15 THEN 0.40 END AS base FROM q)
SELECT l AS "left", r AS "right", shared, round(ratio, 6) AS ratio, CAST(least(0.95, round(base + CASE WHEN joined THEN 0.1 ELSE 0 END + CASE WHEN shared > 0 THEN 0.1 * same / shared ELSE 0 END + CASE WHEN near THEN 0.05 ELSE 0 END, 4)) AS DOUBLE) AS confidence FROM b WHERE base IS NOT NULL""")
def lineage_edges(t, spark):
    """Which of the given tables may feed one another: columns in common, descriptions, joinable values, domains and names."""
    columns = told_columns(t).select("table", F.substring_index("column", "_", -1).alias("column"), "comment", F.lit("string").alias("kind"))
    tables = spark.createDataFrame([(a, d, E.table_core(a), MENTIONS.get(a, [])) for a, d in DOMAINS.items()], "table string, domain string, core array<string>, mentions array<string>")
    joinable = E.joinable_edges(values(t))
    return E.lineage_edges(columns, tables, joinable).withColumn("shared", F.col("shared").cast("long"))


EDGE_SQL = "(SELECT DISTINCT 'n' || c_nationkey AS l, 's' || c_mktsegment AS r FROM customer WHERE c_acctbal > 0 UNION SELECT DISTINCT 'n' || n_nationkey, 'r' || n_regionkey FROM nation)"


@query(f"WITH e AS {EDGE_SQL}, b AS (SELECT l AS a, r AS b FROM e UNION SELECT r, l FROM e) SELECT DISTINCT x.a, x.b AS via, y.b FROM b x JOIN b y ON x.b = y.a WHERE x.a = 'r1' AND y.b = 'sBUILDING' AND NOT EXISTS (SELECT 1 FROM b WHERE a = 'r1' AND b = 'sBUILDING')")
def review_paths(t, spark):
    a = t("customer").where("c_acctbal > 0").select(F.concat(F.lit("n"), "c_nationkey").alias("left"), F.concat(F.lit("s"), "c_mktsegment").alias("right"))
    b = t("nation").select(F.concat(F.lit("n"), "n_nationkey").alias("left"), F.concat(F.lit("r"), "n_regionkey").alias("right"))
    return E.review_paths(a.unionByName(b).distinct().withColumn("confidence", F.lit(0.9)), "r1", "sBUILDING")


ASSETS = [("sales_fact", "sales", "sales amount by nation and month"), ("stock", "stock", "stock by part and brand"), ("people", "staff", "employees of a nation")]


@query("WITH a(asset, domain, t) AS (VALUES ('sales_fact', 'sales', 'sales amount by nation and month'), ('stock', 'stock', 'stock by part and brand'), ('people', 'staff', 'employees of a nation')), q AS (SELECT CAST(n_nationkey AS BIGINT) AS q_id, lower('stock of ' || n_name) AS q FROM nation), w AS (SELECT q_id, asset, max(length(g)) AS w FROM (SELECT q_id, asset, t, unnest(flatten(list_transform(range(2, 9), lambda n: list_transform(range(1, greatest(length(q) - n + 2, 2)), lambda i: substr(q, CAST(i AS BIGINT), CAST(n AS BIGINT)))))) AS g FROM q, a) WHERE contains(t, g) AND length(g) >= 2 GROUP BY 1, 2), d AS (SELECT q_id, asset FROM q, a WHERE contains(q, domain)) SELECT q_id, asset, CAST(coalesce(w, 0) + CASE WHEN d.asset IS NULL THEN 0 ELSE 32 END + CASE WHEN asset = 'sales_fact' THEN 40 ELSE 0 END AS BIGINT) AS score FROM w FULL JOIN d USING (q_id, asset)")
def asset_scores(t, spark):
    q = t("nation").select(F.col("n_nationkey").cast("long").alias("q_id"), F.lower(F.concat(F.lit("stock of "), "n_name")).alias("question"))
    return E.asset_scores(q, spark.createDataFrame(ASSETS, "asset string, domain string, text string"), "sales_fact").withColumn("score", F.col("score").cast("long"))


@query("WITH q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings ORDER BY vec_id LIMIT 1), d AS (SELECT vec_id AS id, 1 - list_cosine_similarity(embedding::DOUBLE[], e) AS d FROM embeddings, q WHERE vec_id % 7 <> 3 AND label < 8) SELECT id, round(d, 6) AS distance FROM d WHERE d <= 0.9 ORDER BY d, id LIMIT 8")
def nearest_exemplars(t, spark):
    """The vectors nearest to the first one, of those that count as enabled and valid."""
    v = t("embeddings")
    question = v.orderBy("vec_id").select("embedding").first()[0]
    e = v.select(F.col("vec_id").alias("id"), "embedding", (F.col("vec_id") % 7 != 3).alias("enabled"), (F.col("label") < 8).alias("valid"))
    return E.nearest_exemplar(e, list(question), most=0.9).select("id", F.round("distance", 6).alias("distance"))


@query("WITH e AS (SELECT 'nation.n' || n_nationkey AS l, CASE n_regionkey WHEN 0 THEN 'region.r' WHEN 1 THEN 'part.p' ELSE 'orders.o' END || n_nationkey AS r, round(0.86 + n_nationkey % 7 / 50.0, 4) AS c FROM nation), k AS (SELECT *, row_number() OVER (PARTITION BY split_part(l, '.', 1), split_part(r, '.', 1) ORDER BY c DESC, l, r) AS rank FROM e WHERE c >= 0.9 AND split_part(r, '.', 1) IN ('region', 'orders')) SELECT l AS \"left\", r AS \"right\", CAST(c AS DOUBLE) AS confidence, rank FROM k WHERE rank <= 10")
def join_evidence(t, spark):
    r = F.when(F.col("n_regionkey") == 0, "region.r").when(F.col("n_regionkey") == 1, "part.p").otherwise("orders.o")
    e = t("nation").select(F.concat(F.lit("nation.n"), "n_nationkey").alias("left"), F.concat(r, "n_nationkey").alias("right"), F.round(0.86 + F.col("n_nationkey") % 7 / 50.0, 4).alias("confidence"))
    return E.join_evidence(e, ["nation", "region", "orders"])


@query("WITH v AS (SELECT 'o_orderstatus' AS col, o_orderstatus AS code FROM orders UNION SELECT 'l_linestatus', l_linestatus FROM lineitem UNION SELECT 'c_nationkey', CAST(c_nationkey AS VARCHAR) FROM customer UNION SELECT 's_nationkey', CAST(s_nationkey AS VARCHAR) FROM supplier), n AS (SELECT col, count(*) AS n FROM v GROUP BY 1), d AS (SELECT 'status' AS dict, unnest(['F', 'O', 'P', 'X']) AS code UNION ALL SELECT 'nations', CAST(n_nationkey AS VARCHAR) FROM nation UNION ALL SELECT 'numbers', CAST(n_nationkey AS VARCHAR) FROM nation), h AS (SELECT v.col, dict, count(*) AS hits FROM v JOIN d USING (code) GROUP BY 1, 2), g AS (SELECT h.col, dict, hits, round(hits / n, 6) AS coverage, n, contains(h.col, dict) AS named FROM h JOIN n USING (col) WHERE n BETWEEN 2 AND 60 AND hits / n >= 0.8) SELECT col AS \"column\", dict, hits, coverage FROM (SELECT *, row_number() OVER (PARTITION BY col ORDER BY named DESC, coverage DESC, hits DESC, dict) AS r FROM g WHERE named OR (coverage = 1 AND n >= 8) OR contains(col, 'nat')) WHERE r = 1")
def dictionary_matches(t, spark):
    v = None
    for table, c in (("orders", "o_orderstatus"), ("lineitem", "l_linestatus"), ("customer", "c_nationkey"), ("supplier", "s_nationkey")):
        part = t(table).select(F.lit(c).alias("column"), F.lit("").alias("comment"), F.col(c).cast("string").alias("value")).distinct()
        v = part if v is None else v.unionByName(part)
    d = spark.createDataFrame([("status", "statuses", x) for x in "FOPX"], "dict string, name string, code string")
    for k in ("nations", "numbers"):
        d = d.unionByName(t("nation").select(F.lit(k).alias("dict"), F.lit("nations" if k == "nations" else "##").alias("name"), F.col("n_nationkey").cast("string").alias("code")))
    return E.dictionary_match(v, d)


@query("WITH l AS (SELECT user_id AS batch, event_id AS seq, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events), bad AS (SELECT batch FROM l WHERE n <= 2 GROUP BY 1 HAVING count(*) = 2 AND count(*) FILTER (WHERE ok) = 0) SELECT c_custkey AS rule, c_custkey % 200 AS batch, CASE WHEN c_custkey % 200 IN (SELECT batch FROM bad) THEN 'rolled_back' ELSE 'active' END AS status FROM customer")
def learning_rollback(t, spark):
    log = t("events").select(F.col("user_id").alias("batch"), F.col("event_id").alias("seq"), (F.col("event_type") != "error").alias("ok"))
    rules = t("customer").select(F.col("c_custkey").alias("rule"), (F.col("c_custkey") % 200).alias("batch"), F.lit("active").alias("status"))
    return E.rolled_back(rules, log, 2)


@query("SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS \"table\", '{c}' AS \"column\", count(DISTINCT nullif({c}, '')) AS \"distinct\" FROM {n}" for n, c in (("orders", "o_orderstatus"), ("lineitem", "l_linestatus"), ("lineitem", "l_returnflag"), ("events", "event_type"), ("part", "p_type"))) + ") WHERE \"distinct\" BETWEEN 2 AND 60")
def candidate_code_columns(t, spark):
    """Columns whose names and types may be codes, and whose values are few."""
    from ..operators.profiling import bucket

    tables = {n: t(n) for n in ("orders", "lineitem", "events", "part", "customer")}
    rows = [(n, f.name, bucket(f.dataType), "") for n, df in tables.items() for f in df.schema]
    named = E.candidate_columns(spark.createDataFrame(rows, "table string, column string, kind string, comment string"))
    return E.code_columns(tables, named)
