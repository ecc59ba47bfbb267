"""From raw documents to packed sequences: quality, near-duplicates, secrets, mixing, packing."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm import cotraining, mixing, packing, secrets
from quarry.llm.common import cut, read
from quarry.llm.near_copies import near_copies
from quarry.llm.queries import tokenizer_path


#: Up to so many ids go to the texts by a broadcast; beyond, texts and ids meet by a shuffle.
IDS = 1_000_000


#: Rows and bytes of a batch of texts that goes to Python: Spark keeps buffers of the size of the largest. By setting, (Spark's own, ours).
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8388608b")}


def lean(stage):
    """A stage that runs with small batches, in a session that has no settings of its own for them; they stay, since the stage's rows are lazy."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for key, (usual, small) in BATCH.items():
            if spark.conf.get(key, usual) == usual:
                spark.conf.set(key, small)
        return stage(spark, docs, sf_dir)

    return run


@lean
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier keeps.

    Null and empty texts and null metadata are judged like any other; repeated rows fare alike; without labels of
    both classes everything stays; an empty table stays empty; further columns are carried along.
    """
    return cotraining.with_quality(docs, read(spark, sf_dir, "labels")).where("_quarry_q.kept").select(*docs.columns)


@lean
def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each group of near copies (five words, similarity 0.8).

    Null, empty and blank texts are one group. Rows that share an id share a group; of the id that stays every
    different text stays, and of equal texts the row with the least other columns, so that reruns agree. Rows
    without an id can't be a group's document; they stay, each text once. An empty table stays empty.
    """
    stays = cut(near_copies(docs.where("doc_id is not null")).where("doc_id = component_id").select("doc_id"))
    ids = cut(stays.distinct())
    n = ids.count()
    kept = docs.join(F.broadcast(ids) if n <= IDS else ids, "doc_id", "left_semi").select(*docs.columns)
    other = [c for c in docs.columns if c not in ("doc_id", "text")]
    least = lambda df: df.groupBy("doc_id", "text").agg(F.min(F.struct(*other)).alias("_quarry_o")).select("doc_id", "text", "_quarry_o.*").select(*docs.columns)
    if stays.count() > n:
        kept = least(kept)
    nameless = docs.where("doc_id is null")
    return kept.unionByName(least(nameless)) if nameless.head(1) else kept


@lean
def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every span of a secret replaced by a mark and n_chars as it then is.

    Null text stays null, with n_chars null; empty text stays empty; repeated rows stay alike; an empty table stays
    empty.
    """
    marked = secrets.with_secrets(docs, mark="[SECRET]")
    return marked.withColumns({"text": F.col("_quarry_s.text"), "n_chars": F.length("_quarry_s.text").cast("long")}).select(*docs.columns)


@lean
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them.

    A document without words is never taken; null source is a source; repeated rows and rows that share an id are
    told apart by their source, size and place among their equals in order of text; an empty table stays empty.
    """
    copies = cut(mixing.mix(docs).select("doc_id", "source", "size", "nth", F.col("copies").cast("int").alias("m_copies")))
    taken = copies.where("m_copies > 0")
    n = copies.count()
    near = F.broadcast if n <= IDS else (lambda df: df)
    if copies.select("doc_id").distinct().count() == n and not copies.where("doc_id is null").head(1):
        joined = docs.join(near(taken.select(F.col("doc_id").alias("m_id"), "m_copies")), docs["doc_id"] == F.col("m_id"))
    else:
        on = taken.select(F.col("doc_id").alias("m_id"), F.col("source").alias("m_source"), F.col("size").alias("m_size"), F.col("nth").alias("m_nth"), "m_copies")
        same = Window.partitionBy("doc_id", "source", "_quarry_z.size").orderBy("text")
        rows = docs.withColumn("_quarry_z", mixing.size_of("text")).withColumn("_quarry_n", F.row_number().over(same))
        joined = rows.join(near(on), rows["doc_id"].eqNullSafe(on["m_id"]) & rows["source"].eqNullSafe(on["m_source"]) & (F.col("_quarry_z.size") == on["m_size"]) & (F.col("_quarry_n") == on["m_nth"]))
    return joined.select(*[docs[c] for c in docs.columns], F.explode(F.sequence(F.lit(1), "m_copies")).alias("_quarry_k")).drop("_quarry_k")


@lean
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens.

    Null text counts as empty and gives one token; repeated rows are packed each; an empty table gives no pieces.
    """
    return packing.pack(docs, tokenizer_path())


STAGES = [("quality", quality), ("dedup", dedup), ("secrets", hide_secrets), ("mix", mix), ("pack", pack)]

#: SQL can't express the classifier, the fingerprints' hash or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
