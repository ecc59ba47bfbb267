"""Posting lists and the vector index against plain versions."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.functions.text import word_similarity
from quarry.operators import indexes as X

SF = "/root/testdata/sf0.1"


@pytest.mark.parametrize("least", [0.2, 0.5])
def test_trigram_search_equals_every_pair(spark, least):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select("item_id", "text").collect()]
    rows += [(900, None), (901, ""), (902, "!!"), (903, rows[0][1]), (904, "Ünïcode_words 你好 世界 and more")]
    questions = [(k, " ".join((t or "").split()[2:5])) for k, t in rows] + [(-1, None), (-2, "zzz qqq"), (-3, "世界")]
    chunks = spark.createDataFrame(rows, "chunk_id long, text string")
    asked = spark.createDataFrame(questions, "question_id long, question string")
    got = {}
    for r in X.trigram_search(chunks, X.gram_postings(chunks), asked, 10, least).collect():
        got.setdefault(r.question_id, []).append((r["rank"], r.chunk_id, r.score))
    want = {}
    for k, q in questions:
        best = sorted((-s, c) for c, t in rows if (s := word_similarity(q or "", t or "")) > least)[:10]
        if best:
            want[k] = [(i + 1, c, -s) for i, (s, c) in enumerate(best)]
    assert {k: sorted(v) for k, v in got.items()} == want and len(want) > 20


def exact(ids, v, q, top, farthest):
    u, w = v / np.linalg.norm(v, axis=1, keepdims=True), q / np.linalg.norm(q)
    d = 1 - u @ w
    order = np.lexsort((ids, d))
    return [(int(ids[i]), float(d[i])) for i in order if d[i] < farthest][:top]


def test_vector_index_recall(spark, tmp_path):
    """On the given vectors: a third of the lists finds over nine tenths of what the exact search finds; all of them find all."""
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").select("vec_id", "embedding").collect()
    ids, v = np.array([r.vec_id for r in rows]), np.array([list(r.embedding) for r in rows], float)
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    index = X.vector_index(df, path=str(tmp_path / "ivf"))
    assert index.table.count() == len(ids) and 20 < len(index.centres) < 100
    queries = df.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    want = {int(i): exact(ids, v, v[k], 20, 0.55) for k, i in enumerate(ids) if i % 100 == 0}
    whole = {}
    for r in X.index_search(index, queries, probes=len(index.centres)).collect():
        whole.setdefault(r.query_id, []).append((r["rank"], r.vec_id, round(r.distance, 9)))
    assert {k: sorted(x) for k, x in whole.items()} == {k: [(n + 1, i, round(d, 9)) for n, (i, d) in enumerate(x)] for k, x in want.items() if x}
    some = {(r.query_id, r.vec_id) for r in X.index_search(index, queries).collect()}
    true = {(q, i) for q, x in want.items() for i, _ in x}
    assert some <= true | some and len(some & true) >= 0.9 * len(true)


def test_awkward_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [None, 1.0]), (5, [1.0]), (6, [float("nan"), 1.0]), (7, [2.0, 0.1]), (7, [0.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = X.vector_index(df, lists=2)
    assert sorted(r.vec_id for r in index.table.collect()) == [1, 7, 7]
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0]), (4, [0.0, 0.0])], "query_id long, embedding array<double>")
    assert [(r.query_id, r.vec_id, r["rank"]) for r in X.index_search(index, q, probes=2).orderBy("rank").collect()] == [(1, 1, 1), (1, 7, 2)]
    assert X.index_search(X.vector_index(df.limit(0)), q).count() == 0


def test_equal_vectors_are_equally_far(spark):
    """Copies of a vector go by key wherever they stand, which the last bits of a matrix product don't keep to."""
    rng = np.random.default_rng(5)
    v, at = rng.standard_normal((40, 64)).astype(np.float32).tolist(), rng.permutation(3000)
    df = spark.createDataFrame([(int(i), v[int(i) % 40]) for i in at], "vec_id long, embedding array<float>").coalesce(1)
    queries = df.where("vec_id < 200").select(F.col("vec_id").alias("query_id"), "embedding")
    index = X.vector_index(df)
    for probes in (len(index.centres), None):
        got = {}
        for r in X.index_search(index, queries, probes=probes).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.vec_id)
        assert got == {q: [q % 40 + 40 * k for k in range(20)] for q in range(200)}


def test_nearest_holds_a_block_at_a_time():
    """What a task holds follows the queries and the block: not the rows of a batch, nor a frame for each query."""
    rng = np.random.default_rng(6)
    m, q = X.unit(rng.standard_normal((20_000, 16))), X.unit(rng.standard_normal((500, 16)))
    m[10_000:] = m[0]  # many equally far
    best = X.Nearest(q, 5, 0.9, cells=1 << 16)
    tracemalloc.start()
    best.add(m, pa.array(np.arange(20_000)[::-1]), None)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 8 << 20
    got = best.best.sort_values(["w", "d", "k"])
    for w in (0, 77, 499):
        d = 1 - (m * q[w]).sum(1)
        order = [i for i in np.lexsort((np.arange(20_000)[::-1], d)) if d[i] < 0.9][:5]
        assert got[got.w == w].k.tolist() == [19_999 - i for i in order]
    odd = X.Nearest(q[:1], 5, 2.5)
    odd.add(m[:3], pa.array([2**60 + 1, None, 7]), None)
    assert set(odd.best.k.dropna()) == {2**60 + 1, 7} and len(odd.best) == 3
