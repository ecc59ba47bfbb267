"""The queries opN_<name>: each applies its operator to its whole table, and its DuckDB SQL where there is one."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import cotraining, embedding_dedup, language_id, lexical_search, lm_scoring, mixing, packing, quality_rules, secrets, sharding, simhash, toxicity, vector_codes
from .common import read


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: Production parameter of the sharding query.
SHARDS = [f"shard-{k:03d}" for k in range(64)]


def op1_language_id(spark, sf_dir):
    return language_id.identify(read(spark, sf_dir, "documents"))


def op2_secret_scan(spark, sf_dir):
    return secrets.secret_scan(read(spark, sf_dir, "documents"))


def op3_simhash_dedup(spark, sf_dir):
    return simhash.simhash_components(read(spark, sf_dir, "documents"))


def op4_quality_classifier(spark, sf_dir):
    q = cotraining.with_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return q.select("doc_id", "_quarry_q.p_text", "_quarry_q.p_meta", "_quarry_q.score", "_quarry_q.kept")


def op5_packing(spark, sf_dir):
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer_path())


def op6_lm_scoring(spark, sf_dir):
    return lm_scoring.lm_scores(read(spark, sf_dir, "documents"))


def op7_quality_rules(spark, sf_dir):
    return quality_rules.quality_rules(read(spark, sf_dir, "documents"))


def op8_sharding(spark, sf_dir):
    return sharding.shard(read(spark, sf_dir, "documents").select("doc_id", "source"), SHARDS, "doc_id")


def op9_embedding_dedup(spark, sf_dir):
    return embedding_dedup.embedding_components(read(spark, sf_dir, "embeddings"))


def op10_source_mixing(spark, sf_dir):
    m = mixing.mix(read(spark, sf_dir, "documents"))
    return m.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source")


def op11_vector_codes(spark, sf_dir):
    return vector_codes.compress(read(spark, sf_dir, "embeddings"))


def op12_lexical_search(spark, sf_dir):
    return lexical_search.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_toxicity(spark, sf_dir):
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_language_id, op2_secret_scan, op3_simhash_dedup, op4_quality_classifier, op5_packing, op6_lm_scoring, op7_quality_rules, op8_sharding, op9_embedding_dedup, op10_source_mixing, op11_vector_codes, op12_lexical_search, op13_toxicity)}



def _lloyd(k: int) -> str:
    """Assignment a<k> to codebooks b<k>, and codebooks b<k+1>."""
    return f"""a{k} AS (
  SELECT vec_id, label, part, x, e[1] AS d, e[2] AS entry FROM (
    SELECT p.vec_id, p.label, p.part, any_value(p.x) AS x, min([list_sum(list_transform(list_zip(p.x, b.c), lambda z: (z[1] - z[2]) ** 2))::BIGINT, b.entry]) AS e
    FROM p JOIN b{k} AS b ON p.part = b.part GROUP BY p.vec_id, p.label, p.part)
), m{k} AS (
  SELECT part, entry, list(floor(s / n)::BIGINT ORDER BY i) AS c FROM (
    SELECT part, entry, i, sum(x[i])::DOUBLE AS s, count(*) AS n FROM a{k}, range(1, 65) AS t(i) WHERE i <= len(x) GROUP BY part, entry, i)
  GROUP BY part, entry
), b{k + 1} AS (SELECT part, entry, coalesce(m.c, b.c) AS c FROM b{k} AS b LEFT JOIN m{k} AS m USING (part, entry))"""


ORACLE = {
    "op9_embedding_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
  ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95
), reach AS (
  SELECT vec_id AS a, vec_id AS r FROM v
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.r = links.a
), comp AS (SELECT a, min(r) AS component_id FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT v.vec_id, coalesce(n.n_links, 0) AS n_links, comp.component_id, v.vec_id = comp.component_id AS kept
FROM v JOIN comp ON comp.a = v.vec_id LEFT JOIN n ON n.a = v.vec_id""",
    "op11_vector_codes": f"""
WITH v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT v.vec_id, v.label, k AS part, list_slice(e, k * len(e) // 16 + 1, (k + 1) * len(e) // 16) AS x FROM v, range(16) AS t(k)
), b0 AS (
  SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x AS c FROM p
  QUALIFY row_number() OVER (PARTITION BY part ORDER BY vec_id) <= 64
), {_lloyd(0)}, {_lloyd(1)}, {_lloyd(2)}, out AS (
  SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY vec_id
)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) FROM b2) AS codebooks_sha256
FROM out""",
    "op12_lexical_search": r"""
WITH d AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM documents
), q AS (
  SELECT item_id, t, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark) GROUP BY item_id, t
), c AS (SELECT doc_id, t, count(*) AS tf FROM d GROUP BY doc_id, t),
l AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM c GROUP BY doc_id),
g AS (SELECT count(*) AS total, sum(n)::BIGINT AS length FROM l),
w AS (SELECT t, floor(1000 * ln((2 * total + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM c, g GROUP BY t, total),
m AS (SELECT doc_id, 25 + (75 * n * total) // length AS m FROM l, g),
s AS (
  SELECT q.item_id, c.doc_id, sum(q.times * w.w * ((1000000000 * c.tf) // (1000 * c.tf + 8 * m.m)))::BIGINT AS score
  FROM q JOIN c USING (t) JOIN w USING (t) JOIN m USING (doc_id) GROUP BY q.item_id, c.doc_id
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10""",
}
