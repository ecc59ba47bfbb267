"""Title, metadata, relation and external routes, fusion, versions, citations and chunk graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import routes as R
from .registry import query

#: Documents of the test: parts with their name as title, brand as domain and type as tag; chunks of two a document.
CHUNKS = "(SELECT p_partkey AS doc_id, p_partkey * 2 + o AS chunk_id, o AS ord, p_name AS title, p_brand AS domain, p_type AS tag, p_retailprice AS price, p_size AS size FROM part, (SELECT unnest([0, 1]) AS o))"


def chunks(t):
    return t("part").select(F.col("p_partkey").alias("doc_id"), F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("ord"), F.col("p_name").alias("title"), F.col("p_brand").alias("domain"), F.array("p_type").alias("tags"), F.col("p_retailprice").alias("price"), F.col("p_size").alias("size")).withColumn("chunk_id", F.col("doc_id") * 2 + F.col("ord"))


def grams(text: str) -> str:
    w = f"list_filter(regexp_split_to_array(lower({text}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
    return f"list_distinct(flatten(list_transform({w}, lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', CAST(i AS BIGINT), 3)))))"


def like(text: str, question: str) -> str:
    a, b = grams(text), grams(f"'{question}'")
    return f"(len(list_intersect({a}, {b})) / (len({a}) + len({b}) - len(list_intersect({a}, {b}))))"


ASKED = "cold widgets of promo"


@query(f"SELECT doc_id, min(chunk_id) AS chunk_id, round(max(s), 6) AS score FROM (SELECT doc_id, chunk_id, {like('title', ASKED)} AS s FROM {CHUNKS}) WHERE round(s, 6) > 0.35 GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 10")
def title_route(t, spark):
    return R.title_route(chunks(t), ASKED)


@query(f"SELECT doc_id, min(chunk_id) AS chunk_id, round(max(s), 6) AS score FROM (SELECT doc_id, chunk_id, CASE WHEN contains('{ASKED}', lower(tag)) OR contains('{ASKED}', lower(domain)) THEN 1.0 ELSE greatest({like('tag', ASKED)}, {like('domain', ASKED)}) END AS s FROM {CHUNKS}) WHERE round(s, 6) > 0.35 AND doc_id IN (SELECT l_partkey FROM lineitem WHERE l_discount > 0.05) GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 10")
def metadata_route(t, spark):
    direct = t("lineitem").where("l_discount > 0.05").select(F.col("l_partkey").alias("doc_id"))
    return R.metadata_route(chunks(t), ASKED, direct)


BODY = "SELECT chunk_id, row_number() OVER (ORDER BY price DESC, chunk_id) AS rank FROM {c} ORDER BY 2 LIMIT 20"
META = "SELECT chunk_id, row_number() OVER (ORDER BY size DESC, chunk_id) AS rank FROM {c} ORDER BY 2 LIMIT 20"


def top_ranked(df, *order):
    from ..operators.retrieval import ranked

    return ranked(df.orderBy(*order).limit(20), *order)


def routed(t):
    c = chunks(t)
    external = R.external_route(t("benchmark").orderBy("item_id").limit(5).select(F.col("item_id").cast("int").alias("position"), "text"))
    return {"vector": top_ranked(c, F.desc("price"), "chunk_id").select("chunk_id", "rank")}, {"metadata": top_ranked(c, F.desc("size"), "chunk_id").select("chunk_id", "rank"), "external": external.select("chunk_id", "rank")}


FUSED = f"SELECT chunk_id, round(sum(s), 9) AS score, max(d) AS direct, string_agg(r, ',' ORDER BY r) AS routes FROM (SELECT chunk_id, 1.0 / (60 + rank) AS s, true AS d, 'vector' AS r FROM ({BODY.format(c=CHUNKS)}) UNION ALL SELECT chunk_id, 0.2 / (60 + rank), false, 'metadata' FROM ({META.format(c=CHUNKS)}) UNION ALL SELECT -(item_id) - 1, 0.2 / (60 + item_id + 1), false, 'external' FROM (SELECT * FROM benchmark ORDER BY item_id LIMIT 5)) GROUP BY 1"


@query(FUSED)
def two_pass_fusion(t, spark):
    body, auxiliary = routed(t)
    return R.fused(body, auxiliary)


@query(f"SELECT 'with' AS body, count(*) AS hits, count(*) FILTER (WHERE direct) AS direct FROM ({FUSED}) UNION ALL SELECT 'without', 0, 0")
def no_direct_hit(t, spark):
    """With a direct hit the auxiliary routes' hits stay beside it; without one they are dropped."""
    body, auxiliary = routed(t)
    counted = lambda name, hits: hits.agg(F.lit(name).alias("body"), F.count("*").alias("hits"), F.count_if("direct").alias("direct"))
    return counted("with", R.fused(body, auxiliary)).unionByName(counted("without", R.fused({k: v.where("false") for k, v in body.items()}, auxiliary)))


HITS = "(SELECT event_id AS chunk_id, value AS score FROM events ORDER BY value DESC, event_id LIMIT 60)"


@query(f"WITH h AS (SELECT *, row_number() OVER (ORDER BY score DESC, chunk_id) AS p FROM {HITS}) SELECT chunk_id, score, CASE WHEN p <= 24 THEN row_number() OVER (ORDER BY p > 24, chunk_id % 7 DESC, p) ELSE 0 END AS position FROM h")
def reranked_window(t, spark):
    hits = t("events").select(F.col("event_id").alias("chunk_id"), F.col("value").alias("score")).orderBy(F.desc("score"), "chunk_id").limit(60)
    return R.reranked(hits, hits.select("chunk_id", (F.col("chunk_id") % 7).alias("rerank"))).fillna(0, ["position"])


#: Of a chunk's place: the marker in its text (-1 old, 1 current) and its heading's.
TEXT_SIDE = "CASE WHEN ord % 9 = 4 THEN -1 WHEN ord % 13 IN (5, 8) THEN 1 ELSE 0 END"
HEAD_SIDE = "CASE WHEN ord % 17 = 3 THEN -1 WHEN ord % 19 = 6 THEN 1 ELSE 0 END"


@query(f"""WITH RECURSIVE h AS (SELECT doc_id, ord, {TEXT_SIDE} AS t, {HEAD_SIDE} AS g, ord % 17 = 3 OR ord % 19 = 6 OR ord % 5 = 0 AS has, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS k
  FROM (SELECT DISTINCT l_suppkey AS doc_id, l_partkey AS ord FROM lineitem)),
f AS (
  SELECT doc_id, k, ord, 1 AS n, t = -1 OR g = -1 AS o, t = 1 OR g = 1 AS c, has, 1 AS run FROM h WHERE k = 1
  UNION ALL
  SELECT doc_id, k, ord, CASE WHEN more THEN n + 1 ELSE 1 END, CASE WHEN more THEN o OR t = -1 OR (NOT had AND g = -1) ELSE t = -1 OR g = -1 END, CASE WHEN more THEN c OR t = 1 OR (NOT had AND g = 1) ELSE t = 1 OR g = 1 END,
    CASE WHEN more THEN had OR has ELSE has END, CASE WHEN more THEN run ELSE run + 1 END
  FROM (SELECT h.doc_id, h.k, h.ord, h.t, h.g, h.has, f.n, f.o, f.c, f.has AS had, f.run,
    h.ord = f.ord + 1 AND f.n < 16 AND NOT ((f.o AND NOT f.c AND (h.t = 1 OR h.g = 1) AND NOT (h.t = -1 OR h.g = -1)) OR (f.c AND NOT f.o AND (h.t = -1 OR h.g = -1) AND NOT (h.t = 1 OR h.g = 1))) AS more
    FROM f JOIN h ON h.doc_id = f.doc_id AND h.k = f.k + 1)
)
SELECT doc_id, min(doc_id * 100000 + ord) AS chunk_id, min(ord) AS ord, max(ord) AS last_ord, count(*) AS chunks, max(CAST(ord % 11 AS DOUBLE)) AS score FROM f GROUP BY doc_id, run""")
def merged_with_version_barrier(t, spark):
    """Neighbouring chunks are merged unless what is merged so far is of an old version and the next of the current one, or the other way round."""
    h = t("lineitem").select(F.col("l_suppkey").alias("doc_id"), F.col("l_partkey").alias("ord")).distinct()
    place = lambda n, *k: (F.col("ord") % n).isin(*k)
    text = F.when(place(9, 4), "见旧版说明").when(place(13, 5), "现行口径如下").when(place(13, 8), "新版").otherwise("plain")
    heading = F.when(place(17, 3), "历史口径").when(place(19, 6), "修订版").when(place(5, 0), "plain")
    return R.merged_runs(h.withColumns({"chunk_id": F.col("doc_id") * 100000 + F.col("ord"), "score": (F.col("ord") % 11).cast("double"), "heading": heading, "text": text}))


@query("WITH c AS (SELECT doc_id, doc_id * 3 AS chunk_id, sha256(text) AS sha, CAST(n_chars % 13 AS DOUBLE) AS score, lower(regexp_replace(text, '\\s', '', 'g')) AS body FROM documents UNION ALL SELECT doc_id, doc_id * 3 + 1, sha256(text), CAST(n_chars % 5 AS DOUBLE), lower(regexp_replace(text, '\\s', '', 'g')) FROM documents), b AS (SELECT sha, doc_id FROM (SELECT sha, doc_id, row_number() OVER (PARTITION BY sha ORDER BY score DESC, chunk_id) AS n FROM c) WHERE n = 1), k AS (SELECT c.*, row_number() OVER (PARTITION BY c.doc_id, body ORDER BY score DESC, chunk_id) AS n FROM c JOIN b ON c.sha = b.sha AND c.doc_id = b.doc_id) SELECT chunk_id, doc_id, score FROM k WHERE n = 1")
def deduped_hits(t, spark):
    d = t("documents").where("text IS NOT NULL").select("doc_id", "text", F.sha2("text", 256).alias("sha256"), "n_chars")
    a = d.select("doc_id", (F.col("doc_id") * 3).alias("chunk_id"), "sha256", "text", (F.col("n_chars") % 13).cast("double").alias("score"))
    b = d.select("doc_id", (F.col("doc_id") * 3 + 1).alias("chunk_id"), "sha256", "text", (F.col("n_chars") % 5).cast("double").alias("score"))
    return R.deduped(a.unionByName(b)).select("chunk_id", "doc_id", "score")


FINAL = "(SELECT p_partkey * 2 + o AS chunk_id, p_partkey AS doc_id, p_type AS family, CAST(p_size % 3 AS VARCHAR) AS revision, p_retailprice - o AS score, CASE WHEN p_partkey % 17 = 3 THEN 'references' END AS relation FROM part, (SELECT unnest([0, 1]) AS o))"


@query(f"WITH h AS {FINAL}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, chunk_id) > 2 AS late FROM h), top AS (SELECT chunk_id, score, 'top' AS why FROM r ORDER BY late, score DESC, chunk_id LIMIT 6), fam AS (SELECT family FROM h GROUP BY 1 HAVING count(DISTINCT revision) > 1), best AS (SELECT chunk_id, score FROM (SELECT h.*, row_number() OVER (PARTITION BY family, revision ORDER BY score DESC, chunk_id) AS n FROM h JOIN fam USING (family)) WHERE n = 1), ver AS (SELECT chunk_id, score, 'version' AS why FROM best WHERE chunk_id NOT IN (SELECT chunk_id FROM top) ORDER BY score DESC, chunk_id LIMIT 2), ch AS (SELECT * FROM top UNION ALL SELECT * FROM ver) SELECT * FROM ch UNION ALL SELECT * FROM (SELECT chunk_id, score, 'link' FROM h WHERE relation = 'references' AND chunk_id NOT IN (SELECT chunk_id FROM ch) ORDER BY score DESC, chunk_id LIMIT 1)")
def final_hits(t, spark):
    """Six hits of several documents, up to two other revisions, and one linked document."""
    h = chunks(t).select("chunk_id", "doc_id", F.col("tags")[0].alias("family"), (F.col("size") % 3).cast("string").alias("revision"), (F.col("price") - F.col("ord")).alias("score"), F.when(F.col("doc_id") % 17 == 3, "references").alias("relation"))
    return R.final_hits(h)


@query("SELECT c.conv_id * 100000 + c.turn AS cited, n.conv_id * 100000 + n.turn AS chunk_id, n.conv_id AS doc_id, n.turn AS ord FROM (SELECT DISTINCT conv_id, turn FROM conversations WHERE turn = 1) c JOIN (SELECT DISTINCT conv_id, turn FROM conversations) n ON n.conv_id = c.conv_id AND n.turn BETWEEN c.turn - 1 AND c.turn + 1 WHERE c.conv_id % 2 = 0")
def citation_windows(t, spark):
    """A cited chunk with its neighbours, of documents that the viewer may still see."""
    c = t("conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ord")).distinct().withColumn("chunk_id", F.col("doc_id") * 100000 + F.col("ord"))
    return R.citation_window(c, c.where("doc_id % 2 = 0").select("doc_id"), c.where("ord = 1"), 1)


@query("SELECT DISTINCT doc_id FROM (SELECT doc_id, source, n_chars, doc_id % 5 AS o FROM documents WHERE doc_id % 4 <> 0 AND n_chars > 0) WHERE o = 1 OR doc_id % 7 = 2 OR source = 'src1'")
def readable_documents(t, spark):
    """Enabled, ready and in effect, with a chunk, and owned or granted to login, role or department."""
    d = t("documents").select("doc_id", F.col("source").alias("space"), F.when(F.col("doc_id") % 5 == 1, "ann").otherwise("bob").alias("owner"), (F.col("doc_id") % 4 != 0).alias("enabled"), F.lit("ready").alias("status"), F.lit(None).cast("string").alias("effective_from"), F.lit(None).cast("string").alias("effective_to"), "n_chars")
    docs = d.select(*[F.col(c).cast("string") if c == "doc_id" else F.col(c) for c in d.columns])
    by_doc = docs.where(F.col("doc_id").cast("long") % 7 == 2).select(F.lit("doc").alias("scope"), F.col("doc_id").alias("target_id"), F.lit("department").alias("grantee_kind"), F.lit("d1").alias("grantee"))
    grants = by_doc.unionByName(t("documents").sparkSession.createDataFrame([("space", "src1", "role", "r1"), ("space", "src2", "role", "r2")], "scope string, target_id string, grantee_kind string, grantee string"))
    return R.readable(docs, docs.where("n_chars > 0"), grants, "ann", ["r1"], ["d1"], "2026-01-01").select(F.col("doc_id").cast("long").alias("doc_id"))


def extracted(t):
    names = F.concat(F.lit('found: {"entities": [{"name": " Supplier '), "l_suppkey", F.lit(' ", "type": "s"}, {"name": "part '), "l_partkey", F.lit('"}, {"name": "7"}], "relations": [{"source": "supplier '), "l_suppkey", F.lit('", "target": "Part '), "l_partkey", F.lit('", "type": "sells", "weight": 2}, {"source": "part '), "l_partkey", F.lit('", "target": "nobody here"}]} that is all'))
    return t("lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("chunk_id"), F.when(F.col("l_returnflag") == "R", "no json").otherwise(names).alias("raw"))


@query("SELECT l_orderkey AS doc_id, 'supplier ' || l_suppkey AS src, 'part ' || l_partkey AS dst, 'sells' AS type, CAST(2 * count(*) AS DOUBLE) AS weight FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1, 2, 3")
def extracted_relations(t, spark):
    """Relations out of JSON in prose: names as keys, ends that the chunk mentions, weights summed."""
    return R.chunk_graph(extracted(t))[1]


@query("SELECT doc_id, count(*) AS entities, count(DISTINCT p) * 0 + (SELECT count(*) FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem r WHERE r.l_orderkey = doc_id AND r.l_returnflag <> 'R')) AS relations, 0 AS dangling FROM (SELECT DISTINCT l_orderkey AS doc_id, 'supplier ' || l_suppkey AS p FROM lineitem WHERE l_returnflag <> 'R' UNION SELECT l_orderkey, 'part ' || l_partkey FROM lineitem WHERE l_returnflag <> 'R') GROUP BY 1")
def chunk_graph_stats(t, spark):
    mentions, relations = R.chunk_graph(extracted(t))
    return R.graph_stats(mentions, relations)


@query("WITH e AS (SELECT DISTINCT 's' || l_suppkey AS a, 'p' || l_partkey AS b FROM lineitem), b AS (SELECT a, b FROM e UNION SELECT b, a FROM e), n AS (SELECT 's3' AS entity, 0 AS hop UNION ALL SELECT b, 1 FROM b WHERE a = 's3' UNION ALL SELECT y.b, 2 FROM b x JOIN b y ON x.b = y.a WHERE x.a = 's3') SELECT entity, min(hop) AS hop FROM n GROUP BY 1")
def entity_neighbourhood(t, spark):
    r = t("lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst")).distinct()
    return R.neighbourhood(r, spark.createDataFrame([("s3",)], "entity string"), 2).withColumn("hop", F.col("hop").cast("long"))
