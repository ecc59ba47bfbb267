"""Document retrieval queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import chunk, html_text
from ..operators import retrieval as V
from ..operators.relations import first_occurrence, graph_route
from .registry import query

QUESTION = "worthless documents with thereading"
PROBE = [((k * 37) % 17 - 8) / 8 for k in range(64)]
PROBE_SQL = "[" + ", ".join(map(repr, PROBE)) + "]::DOUBLE[]"


def chunks(t):
    return t("documents").select(F.col("doc_id").alias("chunk_id"), "doc_id", "text", "source")


@query("SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY sha256(text)")
def doc_dedup_by_hash(t, spark):
    return t("documents").groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).drop("h")


@query("SELECT doc_id AS chunk_id, (contains(text, 'worthless')::INT + contains(text, 'documents')::INT + contains(text, 'thereading')::INT) AS hits FROM documents WHERE hits > 0 ORDER BY hits DESC, chunk_id LIMIT 20")
def token_route(t, spark):
    return V.token_route(chunks(t), QUESTION)


@query("SELECT doc_id AS chunk_id, len(list_intersect(list_distinct(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+')), ['eau', 'les', 'qui', 'idiot'])) AS hits FROM documents WHERE hits >= 2 ORDER BY hits DESC, chunk_id LIMIT 10")
def term_route(t, spark):
    return V.term_route(chunks(t), "eau les qui idiot").withColumn("hits", F.col("hits").cast("long"))


@query(f"SELECT vec_id, round(distance, 9) AS distance FROM (SELECT vec_id, 1 - list_cosine_similarity(embedding::DOUBLE[], {PROBE_SQL}) AS distance FROM embeddings) WHERE distance < 2.0 ORDER BY distance, vec_id LIMIT 20")
def cosine_topk(t, spark):
    return V.vector_route(t("embeddings"), PROBE, 20, 2.0, key="vec_id").select("vec_id", F.round("distance", 9).alias("distance"))


R1 = "SELECT doc_id AS chunk_id, source, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents"
R2 = "SELECT doc_id AS chunk_id, source, row_number() OVER (ORDER BY lang, doc_id DESC) AS rank FROM documents"
FUSED = f"SELECT chunk_id, round(sum(s), 9) AS score FROM (SELECT chunk_id, 1.0 / (60 + rank) AS s FROM ({R1}) WHERE rank <= 40 UNION ALL SELECT chunk_id, 0.25 / (60 + rank) FROM ({R2}) WHERE rank <= 40) GROUP BY 1"


def routes(t):
    d = t("documents").select(F.col("doc_id").alias("chunk_id"), "n_chars", "lang")
    a = d.orderBy(F.desc("n_chars"), "chunk_id").limit(40)
    b = d.orderBy("lang", F.desc("chunk_id")).limit(40)
    return {"body": V.ranked(a, F.desc("n_chars"), "chunk_id"), "relation": V.ranked(b, "lang", F.desc("chunk_id"))}


@query(FUSED)
def rrf_fusion(t, spark):
    return V.rrf(routes(t), {"body": 1.0, "relation": 0.25})


@query(f"SELECT chunk_id, source, score, n > 2 AS late FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, chunk_id) AS n FROM ({FUSED}) f JOIN (SELECT doc_id, source FROM documents) d ON f.chunk_id = d.doc_id) ORDER BY n > 2, score DESC, chunk_id LIMIT 24")
def diversified_topk(t, spark):
    hits = V.rrf(routes(t), {"body": 1.0, "relation": 0.25}).join(chunks(t).select("chunk_id", "source"), "chunk_id")
    return V.diversify(hits, 24, doc="source").select("chunk_id", "source", "score", "late")


@query("WITH h AS (SELECT DISTINCT l_suppkey AS doc_id, l_partkey AS ord FROM lineitem), i AS (SELECT *, ord - row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS g FROM h), p AS (SELECT *, floor((ord - min(ord) OVER (PARTITION BY doc_id, g)) / 16) AS k FROM i) SELECT doc_id, min(ord) AS first_ord, max(ord) AS last_ord, count(*) AS chunks FROM p GROUP BY doc_id, g, k")
def merge_adjacent_chunks(t, spark):
    return V.merge_adjacent(t("lineitem").select(F.col("l_suppkey").alias("doc_id"), F.col("l_partkey").alias("ord")))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def graph_missing_docs(t, spark):
    return t("documents").join(t("labels"), "doc_id", "left_anti").select("doc_id")


@query("SELECT round(avg(CASE WHEN r <= 1 THEN 1.0 ELSE 0.0 END), 6) AS recall_1, round(avg(CASE WHEN r <= 3 THEN 1.0 ELSE 0.0 END), 6) AS recall_3, round(avg(CASE WHEN r <= 5 THEN 1.0 ELSE 0.0 END), 6) AS recall_5, round(avg(CASE WHEN r <= 10 THEN 1.0 ELSE 0.0 END), 6) AS recall_10, round(avg(coalesce(1.0 / r, 0)), 6) AS mrr, round(avg(k / 6.0), 6) AS precision FROM (SELECT q, min(rank) AS r, count(*) FILTER (WHERE rank <= 6) AS k FROM (SELECT DISTINCT l_orderkey AS q, l_linenumber AS chunk_id FROM lineitem WHERE l_returnflag = 'A') g LEFT JOIN (SELECT o_orderkey AS q, CAST(o_custkey % 7 + 1 AS INT) AS chunk_id, CAST(o_custkey % 12 + 1 AS INT) AS rank FROM orders) USING (q, chunk_id) GROUP BY 1)")
def recall_mrr(t, spark):
    gold = t("lineitem").where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("q"), F.col("l_linenumber").alias("chunk_id")).distinct()
    got = t("orders").select(F.col("o_orderkey").alias("q"), (F.col("o_custkey") % 7 + 1).cast("int").alias("chunk_id"), (F.col("o_custkey") % 12 + 1).cast("int").alias("rank"))
    return V.evaluate(got, gold)


@query("SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1")
def first_doc_per_source(t, spark):
    return first_occurrence(t("documents").select("doc_id", "source"), ["source"], "doc_id")


@query()
def chunk_documents(t, spark):
    import pandas as pd

    def run(batches):
        for b in batches:
            rows = [(d, k, a, z) for d, text in zip(b.doc_id, b.text) for k, (a, z) in enumerate(chunk(text or ""))]
            yield pd.DataFrame(rows, columns=["doc_id", "ord", "start", "stop"])

    return t("documents").select("doc_id", "text").mapInPandas(run, "doc_id long, ord long, start long, stop long")


@query()
def html_to_text(t, spark):
    import pyarrow as pa

    text = F.arrow_udf(lambda h: pa.array([html_text(x) for x in h.to_pylist()], pa.string()), "string")
    return t("pages").select("page_id", text("html").alias("text"))


@query()
def trigram_similarity(t, spark):
    from ..operators.indexes import gram_postings, trigram_search

    chunks = t("benchmark").select(F.col("item_id").alias("chunk_id"), "text")
    asked = spark.createDataFrame([(0, "the reading of the")], "question_id int, question string")
    return trigram_search(chunks, gram_postings(chunks), asked).orderBy("rank").select("chunk_id", "score")


@query()
def ppr_top_chunks(t, spark):
    mentions = t("lineitem").select(F.col("l_orderkey").alias("chunk"), F.col("l_partkey").alias("entity"))
    relations = t("lineitem").select(F.col("l_partkey").alias("src"), F.pmod(F.col("l_suppkey") * 7, F.lit(60)).alias("dst"), F.col("l_quantity").alias("weight"))
    return graph_route(mentions, relations, [1, 2])


@query("WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), d AS (SELECT q.vec_id AS query_id, v.vec_id, round(1 - list_cosine_similarity(q.e, v.e), 6) AS distance, row_number() OVER (PARTITION BY q.vec_id ORDER BY 1 - list_cosine_similarity(q.e, v.e), v.vec_id) AS rank FROM v q JOIN v ON q.vec_id % 100 = 0 AND 1 - list_cosine_similarity(q.e, v.e) < 0.55) SELECT query_id, vec_id, distance, rank FROM d WHERE rank <= 20")
def indexed_neighbours(t, spark):
    """Vectors near those whose id is divisible by 100, by an inverted file of which all lists are probed, so that it is exact."""
    from ..operators.indexes import index_search, vector_index

    index = vector_index(t("embeddings"))
    asked = t("embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return index_search(index, asked, probes=len(index.centres)).select("query_id", "vec_id", F.round("distance", 6).alias("distance"), "rank")


@query()
def trigram_search(t, spark):
    """For the first words of each benchmark text the texts that are most like them, by posting lists of trigrams."""
    from ..operators.indexes import gram_postings
    from ..operators.indexes import trigram_search as search

    chunks = t("benchmark").select(F.col("item_id").alias("chunk_id"), "text")
    asked = t("benchmark").select(F.col("item_id").alias("question_id"), F.substring_index("text", " ", 4).alias("question"))
    return search(chunks, gram_postings(chunks), asked).select("question_id", "chunk_id", F.round("score", 9).alias("score"), "rank")
