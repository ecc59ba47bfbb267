"""Retrieval routes over chunks, rank fusion, merging, diversity and evaluation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.segment import Segmenter, terms_of
from ..functions.text import exact_tokens, terms, word_similarity

RRF_K = 60


def visible(docs: DataFrame, grants: DataFrame, login: str, roles: list[str], on: str) -> DataFrame:
    """Documents that a viewer may read on a day: theirs, or granted to login or role, enabled and in effect."""
    ok = docs.where(F.col("enabled") & (F.col("effective_from").isNull() | (F.col("effective_from") <= on)) & (F.col("effective_to").isNull() | (F.col("effective_to") >= on)))
    mine = grants.where(((F.col("grantee_kind") == "login") & (F.col("grantee") == login)) | ((F.col("grantee_kind") == "role") & F.col("grantee").isin(*roles)))
    by_doc = ok.join(mine.where("scope = 'doc'").select(F.col("target_id").alias("doc_id")), "doc_id", "left_semi")
    by_space = ok.join(mine.where("scope = 'space'").select(F.col("target_id").alias("space")), "space", "left_semi")
    return ok.where(F.col("owner") == login).union(by_doc).union(by_space).dropDuplicates(["doc_id"])


def vector_route(chunks: DataFrame, query: list[float], top: int = 20, farthest: float = 0.55, vec: str = "embedding", key: str = "chunk_id") -> DataFrame:
    """Nearest chunks by cosine distance, scored in Arrow batches and cut by a top-k; exact."""
    q = np.array(query, float)
    q = q / (np.linalg.norm(q) or 1.0)

    def distance(v: pa.Array) -> pa.Array:
        """Vectors of the query's length are one matrix; others, and those with nulls, have no distance."""
        ok = pc.and_(pc.equal(pc.list_value_length(v), len(q)), pc.is_valid(v)).fill_null(False).to_numpy(zero_copy_only=False)
        out = np.full(len(v), np.nan)
        if ok.any():
            m = v.filter(pa.array(ok)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, len(q))
            n = np.sqrt((m * m).sum(1))
            with np.errstate(invalid="ignore", divide="ignore"):
                out[ok] = 1 - m @ q / n
        return pa.array(out, pa.float64(), from_pandas=True)

    scored = chunks.select(key, F.arrow_udf(distance, "double").asNondeterministic()(F.col(vec)).alias("distance"))
    return scored.where(F.col("distance") < farthest).orderBy("distance", key).limit(top)


def token_route(chunks: DataFrame, question: str, top: int = 20, key: str = "chunk_id") -> DataFrame:
    """Chunks by the number of the question's codes and long tokens that they contain."""
    tokens = exact_tokens(question)
    if not tokens:
        return chunks.select(key, F.lit(0).alias("hits")).limit(0)
    hits = sum((F.contains("text", F.lit(t)).cast("int") for t in tokens), F.lit(0))
    return chunks.select(key, hits.alias("hits")).where("hits > 0").orderBy(F.desc("hits"), key).limit(top)


def term_route(chunks: DataFrame, question: str, top: int = 10, key: str = "chunk_id", most: int = 32, segmenter: Segmenter | None = None) -> DataFrame:
    """Chunks with at least two (or all) of the question's distinct terms; a segmenter divides scripts without spaces into words."""
    q = (segmenter.terms(question) if segmenter else terms(question))[:most]
    if not q:
        return chunks.select(key, F.lit(0).alias("hits")).limit(0)
    words = terms_of(F.col("text"), segmenter) if segmenter else F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"))
    hits = F.size(F.array_intersect(words, F.array(*[F.lit(t) for t in q])))
    return chunks.select(key, hits.alias("hits")).where(F.col("hits") >= min(2, len(q))).orderBy(F.desc("hits"), key).limit(top)


def trigram_route(chunks: DataFrame, question: str, top: int = 10, least: float = 0.2, key: str = "chunk_id", text: str = "text") -> DataFrame:
    score = F.arrow_udf(lambda t: pa.array([word_similarity(question, x or "") for x in t.to_pylist()], pa.float64()), "double").asNondeterministic()
    return chunks.select(key, score(F.col(text)).alias("score")).where(F.col("score") > least).orderBy(F.desc("score"), key).limit(top)


def rrf(routes: dict[str, DataFrame], weights: dict[str, float], key: str = "chunk_id") -> DataFrame:
    """Sum of weight / (60 + rank) over routes, each with `key` and `rank`; ties go to the lower key."""
    all_routes = None
    for name, df in routes.items():
        part = df.select(key, (F.lit(float(weights.get(name, 1.0))) / (RRF_K + F.col("rank"))).alias("_s"))
        all_routes = part if all_routes is None else all_routes.unionByName(part)
    return all_routes.groupBy(key).agg(F.round(F.sum("_s"), 9).alias("score")).orderBy(F.desc("score"), key)


def ranked(df: DataFrame, *order) -> DataFrame:
    """Ranks of a route's rows, which are few: a route is cut at its top before it is ranked."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy().orderBy(*order)))


def diversify(hits: DataFrame, limit: int, first: int = 2, doc: str = "doc_id", score: str = "score", key: str = "chunk_id") -> DataFrame:
    """At most `first` hits a document come first, by score; the others fill up to the limit."""
    w = Window.partitionBy(doc).orderBy(F.col(score).desc(), key)
    return hits.withColumn("_n", F.row_number().over(w)).withColumn("late", F.col("_n") > first).orderBy("late", F.col(score).desc(), key).limit(limit).drop("_n")


def merge_adjacent(hits: DataFrame, span: int = 16, doc: str = "doc_id", ord_col: str = "ord") -> DataFrame:
    """Runs of consecutive chunks of a document, in pieces of at most `span`.

    A document's chunks are sorted once; of a run only its first and last chunk are kept, from which its pieces follow.
    """
    w = Window.partitionBy(doc).orderBy(ord_col)
    o = F.col(ord_col)
    placed = hits.select(doc, ord_col).distinct().repartition(doc)
    ends = placed.withColumns({"_a": ~F.coalesce(o == F.lag(o).over(w) + 1, F.lit(False)), "_z": ~F.coalesce(o + 1 == F.lead(o).over(w), F.lit(False))}).where("_a OR _z")
    runs = ends.withColumn("_l", F.when(F.col("_z"), o).otherwise(F.lead(o).over(w))).where("_a")
    pieces = runs.withColumn("_p", F.explode(F.coalesce(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_l") - o) / span)), F.array(F.lit(0).cast("long")))))
    first = (o + F.col("_p") * span).cast(hits.schema[ord_col].dataType)
    last = F.when(o.isNotNull(), F.least(F.col("_l"), first + (span - 1))).cast(hits.schema[ord_col].dataType)
    return pieces.select(doc, first.alias("first_ord"), last.alias("last_ord"), F.coalesce((last - first + 1).cast("long"), F.lit(1).cast("long")).alias("chunks"))


def neighbours(chunks: DataFrame, doc_id, ord_at: int, width: int) -> DataFrame:
    w = min(max(width, 0), 3)
    return chunks.where((F.col("doc_id") == doc_id) & F.col("ord").between(ord_at - w, ord_at + w)).orderBy("ord")


def evaluate(results: DataFrame, gold: DataFrame, k: int = 6) -> DataFrame:
    """recall@1/3/5/10, MRR and precision@k from results (q, chunk_id, rank) and gold (q, chunk_id)."""
    best = gold.join(results, ["q", "chunk_id"], "left").groupBy("q").agg(F.min("rank").alias("r"), F.count_if(F.col("rank") <= k).alias("in_k"))
    recall = [F.round(F.avg(F.when(F.col("r") <= n, 1.0).otherwise(0.0)), 6).alias(f"recall_{n}") for n in (1, 3, 5, 10)]
    return best.agg(*recall, F.round(F.avg(F.coalesce(1 / F.col("r"), F.lit(0.0))), 6).alias("mrr"), F.round(F.avg(F.col("in_k") / k), 6).alias("precision"))


def dedup_sources(hits: DataFrame, sha: str = "sha256", score: str = "score", key: str = "chunk_id") -> DataFrame:
    """Of documents with equal files, the chunks of the least doc_id alone."""
    first = hits.groupBy(sha).agg(F.min("doc_id").alias("_d"))
    return hits.join(first, sha).where("doc_id = _d").drop("_d")
