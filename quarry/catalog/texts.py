"""Keys, labels, recipes and traces of texts, repaired requests, and merged catalogues."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..plans.checks import Request, derivation_problems, repaired
from ..plans.model import compose
from ..plans.sales import SALES
from ..sources.registry import merged_catalog, outside_records
from .registry import query
from .sales import GEO, SUM


@query("SELECT doc_id, md5(lower(regexp_replace(text, '[ \\t\\n\\v\\f\\r]', '', 'g'))) AS key FROM documents")
def text_keys(t, spark):
    """Texts without white space and case, as bodies are compared."""
    return t("documents").select("doc_id", F.md5(F.lower(F.regexp_replace("text", r"[ \t\n\x0B\f\r]", ""))).alias("key"))


@query("SELECT doc_id, md5(concat_ws(chr(10), nullif(source, ''), nullif(lang, ''), coalesce(text, ''))) AS recipe FROM documents")
def embedding_recipes(t, spark):
    parts = [F.nullif(F.col(c), F.lit("")) for c in ("source", "lang")]
    return t("documents").select("doc_id", F.md5(F.concat_ws("\n", *parts, F.coalesce("text", F.lit("")))).alias("recipe"))


@query("SELECT conv_id, '[' || string_agg('{\"turn\":' || turn || ',\"role\":\"' || role || '\",\"chars\":' || length(text) || '}', ',' ORDER BY turn, role, length(text)) || ']' AS trace FROM conversations GROUP BY 1")
def trace_json(t, spark):
    """A conversation's steps as one JSON array."""
    step = F.struct(F.col("turn"), F.col("role"), F.length("text").alias("chars"))
    return t("conversations").groupBy("conv_id").agg(F.to_json(F.sort_array(F.collect_list(step))).alias("trace"))


@query(f"SELECT coalesce(nullif(trim(r_name), ''), 'unregistered') AS region, {SUM} AS sales_amount FROM {GEO} WHERE o_orderdate >= DATE '1970-01-01' AND o_orderdate < DATE '1997-01-01' GROUP BY 1 ORDER BY 2 DESC, 1")
def repaired_request(t, spark):
    """A request that selects a region without grouping it, repeats its metric, asks for another aggregate, and has no lower bound."""
    spec, fixes = repaired(SALES, Request(("sales_amount", "region", "sales_amount"), aggregate=(("sales_amount", "avg"),), end=date(1997, 1, 1), sort="sales_amount"))
    if len(fixes) != 4:
        raise AssertionError(fixes)
    return compose(SALES, spec, t)


@query("SELECT * FROM (VALUES ('join customer-nation'), ('join nation-region'), ('label ATLANTIS'), ('table region')) AS t(problem)")
def derivation_guard(t, spark):
    """Why a derived specification may not run, from the tables' own values as evidence."""
    spec, _ = repaired(SALES, Request(("order_count", "segment"), equals=(("region", ("ASIA", "ATLANTIS")),)))
    names = {r.r_name for r in t("region").select("r_name").collect()}
    found = derivation_problems(SALES, spec, {"orders", "customer", "nation"}, {("orders", "customer")}, {"region": names})
    return spark.createDataFrame([(p,) for p in sorted(found)], "problem string")


@query("SELECT 'nation' AS \"table\", n_name AS \"column\", 'int' AS type, CASE WHEN n_regionkey = 1 THEN 'told' WHEN n_nationkey % 2 = 0 THEN 'own' ELSE '' END AS comment, CASE WHEN n_regionkey < 2 THEN 'both' ELSE 'native' END AS origin FROM nation UNION ALL SELECT 'region', r_name, 'string', 'extra', 'warehouse' FROM region")
def merged_catalogues(t, spark):
    n = t("nation")
    native = n.select(F.lit("nation").alias("table"), F.col("n_name").alias("column"), F.lit("int").alias("type"), F.when(F.col("n_nationkey") % 2 == 0, "own").otherwise("").alias("comment"))
    known = n.where("n_regionkey < 2").select(F.lit("nation").alias("table"), F.col("n_name").alias("column"), F.lit("bigint").alias("type"), F.when(F.col("n_regionkey") == 1, "told").otherwise(" ").alias("comment"))
    extra = t("region").select(F.lit("region").alias("table"), F.col("r_name").alias("column"), F.lit("string").alias("type"), F.lit("extra").alias("comment"))
    return merged_catalog(native, known.unionByName(extra))


@query("WITH h AS (SELECT text, len(list_intersect(list_distinct(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+')), ['reading', 'thereading', 'er'])) AS h FROM benchmark) SELECT CAST(row_number() OVER (ORDER BY h DESC, text) - 1 AS INT) AS position, text FROM h WHERE h > 0 ORDER BY h DESC, text LIMIT 5")
def outside_knowledge(t, spark):
    """The best records of a read-only outside table."""
    return outside_records(t("benchmark"), "text", "reading thereading er")
