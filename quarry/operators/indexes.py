"""Indexes for retrieval: trigram posting lists with a threshold bound, and an inverted file of vectors."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import trigrams, word_similarity
from .iterated import settled


def grams_of(text: str | None) -> list[str]:
    """The distinct trigrams of a text's words, in order."""
    return sorted({g for w in re.findall(r"\w+", (text or "").lower()) for g in trigrams(w)})


def with_grams(df: DataFrame, text: str) -> DataFrame:
    split = F.arrow_udf(lambda t: pa.array([grams_of(x) for x in t.to_pylist()], pa.list_(pa.string())), "array<string>")
    return df.withColumn("_grams", split(F.col(text)))


def gram_postings(chunks: DataFrame, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """(gram, key) of every trigram of every chunk: a table to be written once and searched often. Null texts have none."""
    return with_grams(chunks.select(key, text), text).select(F.explode("_grams").alias("gram"), key)


def trigram_search(chunks: DataFrame, postings: DataFrame, questions: DataFrame, top: int = 10, least: float = 0.2, key: str = "chunk_id", text: str = "text", question_key: str = "question_id", question: str = "question") -> DataFrame:
    """(question_id, chunk_id, score, rank): each question's chunks of a word similarity above `least`, the `top` best.

    A chunk's similarity is at most the share of the question's n trigrams that it holds, so it has to hold more than
    least * n of them, and one at least of the n - floor(least * n) rarest. Only those lists are read, and a chunk is a
    candidate only if what it holds of them, with all the others, would do; candidates alone are verified, on whole
    texts. Equal scores go by key; questions without trigrams find nothing; a repeated question's key must differ.
    """
    asked = settled(with_grams(questions.select(question_key, question), question).withColumn("_n", F.size("_grams")).where("_n > 0"))
    grams = asked.select(question_key, "_n", F.explode("_grams").alias("gram"))
    known = postings.join(grams.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("_df"))
    rarest = Window.partitionBy(question_key).orderBy(F.coalesce("_df", F.lit(0)), "gram")
    read = grams.join(known, "gram", "left").withColumn("_k", F.row_number().over(rarest)).withColumn("_take", F.col("_n") - F.floor(F.lit(least) * F.col("_n"))).where("_k <= _take")
    held = postings.join(read.select("gram", question_key, "_n", "_take"), "gram").groupBy(question_key, key, "_n", "_take").agg(F.count("*").alias("_hits"))
    candidates = held.where(F.col("_hits") + F.col("_n") - F.col("_take") > F.lit(least) * F.col("_n")).select(question_key, key)
    score = F.arrow_udf(lambda q, t: pa.array([word_similarity(a or "", b or "") for a, b in zip(q.to_pylist(), t.to_pylist())], pa.float64()), "double").asNondeterministic()
    pairs = candidates.join(asked.select(question_key, question), question_key).withColumnRenamed(question, "_q").join(chunks.select(key, F.col(text).alias("_t")), key)
    scored = pairs.withColumn("score", score("_q", "_t")).where(F.col("score") > least)
    best = Window.partitionBy(question_key).orderBy(F.desc("score"), key)
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select(question_key, key, "score", "rank")


def unit(m: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore", divide="ignore"):
        return m / np.sqrt((m * m).sum(1, keepdims=True))


def usable(v: pa.Array, size: int) -> np.ndarray:
    """Which vectors have the given length, no null, and a direction."""
    out = pc.fill_null(pc.list_value_length(v), -1).to_numpy(zero_copy_only=False) == size
    m = components(v.filter(pa.array(out)), size)
    out[out] = np.isfinite(m).all(1) & m.any(1)
    return out


def components(v: pa.Array, size: int) -> np.ndarray:
    """Vectors of one length as rows; null components are NaN."""
    return v.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, size)


def spherical_means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 1) -> np.ndarray:
    """k directions that unit vectors gather about: far seeds, then Lloyd rounds by cosine."""
    rng = np.random.default_rng(seed)
    c = [x[rng.integers(len(x))]]
    near = x @ c[0]
    while len(c) < min(k, len(x)):
        gap = np.maximum(1 - near, 0) + 1e-12
        c.append(x[rng.choice(len(x), p=gap / gap.sum())])
        near = np.maximum(near, x @ c[-1])
    c = np.array(c)
    for _ in range(rounds):
        at = (x @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        size = np.sqrt((total * total).sum(1))
        c = np.where(size[:, None] > 1e-9, total / np.maximum(size, 1e-9)[:, None], c)
    return c


@dataclass
class VectorIndex:
    """An inverted file: the centres, which the driver holds, and a table (list, key, vector) of all vectors."""

    centres: np.ndarray
    table: DataFrame
    key: str


def vector_index(vectors: DataFrame, lists: int | None = None, sample: int = 20_000, key: str = "vec_id", vec: str = "embedding", path: str | None = None) -> VectorIndex:
    """Every vector in the list of its nearest centre by cosine. The centres are fitted on about `sample` vectors, chosen by a hash.

    lists: about the root of the number of vectors, 4,096 at most. With a path the table is written there by list, so
    that a search reads the files of its lists alone. Null vectors, those with null, non-finite or no direction, and
    those whose length isn't the most frequent are in no list; an empty table gives an index without centres.
    """
    rows = vectors.select(F.col(key), F.col(vec).alias("vector"))
    sizes = rows.where("vector IS NOT NULL").groupBy(F.size("vector").alias("s")).count().orderBy(F.desc("count"), "s").first()
    n, size = (sizes["count"], sizes["s"]) if sizes and sizes["s"] > 0 else (0, 0)
    k = lists or int(min(4096, max(1, n**0.5)))
    share = min(1.0, sample / max(1, n))
    picked = rows.where(F.size("vector") == size).where(F.pmod(F.xxhash64(key), F.lit(1 << 20)) < int(share * (1 << 20))).orderBy(F.xxhash64(key), key).limit(2 * sample).select("vector").toPandas().vector if n else []
    fit = np.array([v for v in picked if v is not None and None not in list(v) and np.isfinite(v).all() and np.any(v)], float)
    if not len(fit):
        return VectorIndex(np.zeros((0, size)), rows.withColumn("list", F.lit(0)).select("list", key, "vector").limit(0), key)
    centres = spherical_means(unit(fit), k)

    def place(v: pa.Array) -> pa.Array:
        ok = usable(v, size)
        out = np.full(len(v), -1, np.int32)
        if ok.any():
            m = unit(components(v.filter(pa.array(ok)), size))
            out[ok] = np.concatenate([(m[i : i + 1024] @ centres.T).argmax(1) for i in range(0, len(m), 1024)])
        return pa.array(out)

    table = rows.withColumn("list", F.arrow_udf(place, "int")(F.col("vector"))).where("list >= 0").select("list", key, "vector")
    if path:
        table.write.mode("overwrite").partitionBy("list").parquet(path)
        table = vectors.sparkSession.read.parquet(path).select("list", key, "vector")
    return VectorIndex(centres, table, key)


class Nearest:
    """The `top` nearest of each of some queries' unit vectors q, among rows that come in any number of batches.

    Distances that a matrix product gives differ in their last bits from one place to another, so they only choose candidates; a candidate's
    own is summed by itself, so that equal vectors are equally far. Memory follows the queries and `cells`, not the rows.
    """

    SLACK = 1e-9

    def __init__(self, q: np.ndarray, top: int, farthest: float, cells: int = 1 << 20):
        self.q, self.top, self.farthest, self.cells = q, top, farthest, cells
        self.best = pd.DataFrame({"w": np.zeros(0, np.int64), "d": np.zeros(0), "k": []})
        self.limit = np.full(len(q), farthest)

    def add(self, m: np.ndarray, keys: pa.Array, asked: np.ndarray | None) -> None:
        """Unit vectors m with their keys; asked has a row of bits for each, packed, for the queries that read it, or is None if all do."""
        step = max(1, self.cells // len(self.q))
        for i in range(0, len(m), step):
            bits = None if asked is None else np.unpackbits(asked[i : i + step], axis=1, count=len(self.q)).astype(bool)
            who = np.arange(len(self.q)) if bits is None else np.flatnonzero(bits.any(0))
            d = 1 - m[i : i + step] @ self.q[who].T
            if bits is not None:
                d[~bits[:, who]] = np.inf
            near = d < self.limit[who] + self.SLACK
            many = np.flatnonzero(near.sum(0) > 4 * self.top)
            if len(many):
                least = np.partition(d[:, many], self.top - 1, axis=0)[self.top - 1]
                near[:, many] &= d[:, many] <= least + self.SLACK
            row, w = np.nonzero(near)
            for j in range(0, len(row), self.cells // 64):
                self.merge(who[w[j : j + self.cells // 64]], m, i + row[j : j + self.cells // 64], keys)

    def merge(self, w: np.ndarray, m: np.ndarray, row: np.ndarray, keys: pa.Array) -> None:
        d = 1 - (m[row] * self.q[w]).sum(1)
        ok = (d < self.farthest) & (d <= self.limit[w])
        if not ok.any():
            return
        new = pd.DataFrame({"w": w[ok], "d": d[ok], "k": keys.take(pa.array(row[ok])).to_pandas(integer_object_nulls=True)})
        old = self.best.w.isin(new.w)
        t = (pd.concat([self.best[old], new]) if old.any() else new).sort_values(["w", "d", "k"])
        t = t[t.groupby("w").cumcount() < self.top]
        last = t[t.groupby("w").cumcount() == self.top - 1]
        self.limit[last.w.to_numpy()] = last.d.to_numpy()
        self.best = pd.concat([self.best[~old], t], ignore_index=True) if len(self.best) else t.reset_index(drop=True)


def index_search(index: VectorIndex, queries: DataFrame, top: int = 20, probes: int | None = None, farthest: float = 0.55, query_key: str = "query_id", vec: str = "embedding", block: int = 2048) -> DataFrame:
    """(query_id, key, distance, rank): each query's nearest vectors by cosine distance below `farthest` in its `probes` nearest lists.

    probes is a third of the lists unless given; all of them make the search exact. Distances are exact. Queries go
    to the tasks in blocks of `block`, and each task keeps `top` of a query, so that a list of any size is read in
    batches. Queries without a direction or of another length find nothing; equal distances go by key.
    """
    lists, size = index.centres.shape
    kinds = {f.name: f.dataType.simpleString() for f in index.table.schema.fields}
    q_kind = queries.schema[query_key].dataType.simpleString()
    schema = f"{query_key} {q_kind}, {index.key} {kinds[index.key]}, distance double"
    out = None
    numbered = settled(queries.select(F.col(query_key), F.col(vec).alias("vector")).withColumn("_b", F.pmod(F.xxhash64(query_key), F.lit(max(1, -(-queries.count() // block))))))
    for b in range(max(1, -(-numbered.count() // block))):
        asked = [(r[query_key], list(r.vector)) for r in numbered.where(F.col("_b") == b).collect() if r.vector is not None and len(r.vector) == size and None not in r.vector and np.isfinite(r.vector).all() and any(r.vector)] if lists else []
        if not asked:
            continue
        ids, q = [a[0] for a in asked], unit(np.array([a[1] for a in asked], float))
        p = min(lists, probes or max(1, -(-lists // 3)))
        wanted = None
        if p < lists:
            wanted = np.zeros((lists, len(q)), bool)
            np.put_along_axis(wanted.T, np.argsort(-(q @ index.centres.T), axis=1, kind="stable")[:, :p], True, axis=1)

        def run(batches, ids=pa.array(ids), q=q, wanted=None if wanted is None else np.packbits(wanted, axis=1), key=index.key, kind=None):
            best = Nearest(q, top, farthest)
            for part in batches:
                kind = part.schema.field(key).type
                m = unit(components(part.column("vector"), size))
                best.add(m, part.column(key), None if wanted is None else wanted[part.column("list").to_numpy()])
            t = best.best
            if len(t):
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(t.w.to_numpy())), pa.array(t.k, kind, from_pandas=True), pa.array(t.d.to_numpy())], names=[query_key, key, "distance"])

        read = index.table if wanted is None else index.table.where(F.col("list").isin(*np.flatnonzero(wanted.any(1)).tolist()))
        found = read.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return queries.sparkSession.createDataFrame([], f"{schema}, rank int")
    order = Window.partitionBy(query_key).orderBy("distance", index.key)
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
