"""Near copies by word-shingle similarity: SimHash signatures searched with vantage-point trees, then verified.

At a Jaccard similarity of 0.8 two signatures differ in about 15 % of their bits, too many for a range search
over 64 bits to prune anything. A signature here has 192 bits in twelve segments; a pair counts as a candidate
if some segment differs in at most one bit and the whole in at most `most` bits. At similarity 0.8 a segment is
that close with probability 0.28, so one of twelve is with 0.98 (0.999 at 0.85). Each segment has its tree.
A shard gives the minimum spanning forest of its candidates, so that a large group gives few edges; their
components are loose clusters. Texts of few shingles, whose signatures tell least, are found exactly besides: two sets
of similarity s share a subset that lacks at most 1 / s - 1 of either's shingles, so texts meet by the hashes of such
subsets. Within a loose cluster every pair of texts is then compared shingle by shingle, in
blocks of bounded size that hand back no more than a forest of the pairs that reach the similarity.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import array_udf, as_bytes, components, cut, record, sample, tidied, tidy, with_class
from .simhash import block_tasks, close_pairs, grow, leaves, majority, shingle_hashes, spanning

WORDS, BITS = 3, 16
SEGMENTS = WORDS * 64 // BITS


def signature(text: bytes, size: int) -> bytes:
    """Majority bits of the distinct shingles' hashes, each hash widened to 192 bits; zero for a blank text."""
    h = np.unique(shingle_hashes(text, size))
    wide = np.empty((len(h), WORDS), "<u8")
    for k in range(WORDS):
        x = h + np.uint64((0x9E3779B97F4A7C15 * (k + 1)) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        wide[:, k] = x ^ (x >> np.uint64(31))
    return majority(wide).tobytes()


def subset_keys(text: bytes, size: int, similarity: float, most: int) -> list[int]:
    """Hashes of the shingle subsets that any text of `similarity` shares one of; none for over `most` shingles."""
    if len(text.split(None, most + size)) >= most + size:
        return []
    h = np.unique(shingle_hashes(text, size))
    if not 0 < len(h) <= most:
        return []
    x = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = ((x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)).tolist()
    whole, spare = sum(x), int(len(x) * (1 / similarity - 1) + 1e-9)
    keys = {(whole - sum(gone)) & (2**64 - 1) for d in range(spare + 1) for gone in combinations(x, d)}
    return [k - (1 << 63) for k in sorted(keys)]


def short_links(prints: DataFrame, reps: DataFrame) -> DataFrame:
    """Edges (a, b) of classes whose texts share a key: each to the least of those with the key."""
    keyed = prints.where(F.size("keys") > 0).select("sig", "keys").distinct().join(reps.select("sig", "rep"), "sig").select("rep", F.explode("keys").alias("key"))
    keyed = cut(keyed)
    least = keyed.groupBy("key").agg(F.min("rep").alias("least"), F.max("rep").alias("other"), F.count("*").alias("copies")).where("least < other").drop("other")
    return with_class(keyed, cut(least), "key").select(F.col("least").alias("a"), F.col("rep").alias("b")).where("a <> b").distinct()


def matrix(signatures) -> np.ndarray:
    """Signatures as rows of 16-bit segments."""
    return np.frombuffer(b"".join(signatures), "<u2").reshape(-1, SEGMENTS)


def spread_out(reps: DataFrame, shard: int, fit: int, r: int = 1) -> DataFrame:
    """Rows (cell, home, sig, rep): where the trees of the segments send each of reps (distinct sig and rep)."""
    n = reps.count()
    fitted = matrix([x.sig for x in sample(reps, fit, "sig").select("sig").collect()]).astype(np.uint32)
    depth = min(14, max(0, math.ceil(math.log2(max(1, n) / shard)))) if len(fitted) else 0
    trees = [grow(fitted[:, s], depth, 7 + s) if depth else None for s in range(SEGMENTS)]

    def deal(batches):
        for x in batches:
            raw, rep = x.column("sig"), x.column("rep").to_numpy()
            m = matrix(raw.to_pylist()).astype(np.uint32)
            for s in range(SEGMENTS):
                row, at, home = leaves(m[:, s], trees[s], r)
                yield record("cell long, home boolean, sig binary, rep long", [at * SEGMENTS + s, home, raw.take(pa.array(row)), rep[row]])

    return reps.select("sig", "rep").mapInArrow(tidied(deal), "cell long, home boolean, sig binary, rep long")


def candidates(spread: DataFrame, most: int, shard: int, guests: int, r: int = 1) -> DataFrame:
    """Edges (a, b) of the shards' minimum spanning forests by signature distance, up to `most` bits."""

    def shard_links(key: tuple, t: pd.DataFrame) -> pd.DataFrame:
        m, rep, home = matrix(t.sig), t.rep.to_numpy(), t.home.to_numpy()
        wide, s = m.view("<u8"), int(key[0]) % SEGMENTS

        def gap(i, j):
            return sum(np.bitwise_count(wide[i, k] ^ wide[j, k]) for k in range(WORDS))

        a, b = close_pairs(m[:, s].astype(np.uint32), np.flatnonzero(home), np.flatnonzero(~home), s, r, gap, most, spanning)
        tidy()
        return pd.DataFrame({"a": np.minimum(rep[a], rep[b]), "b": np.maximum(rep[a], rep[b])})

    return block_tasks(spread, shard, guests, "sig", "rep").groupBy("cell", "i", "j").applyInPandas(shard_links, "a long, b long").where("a <> b").distinct()


def alike(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """A forest of the pairs of left and right whose Jaccard index reaches `similarity`: it joins what all of them join."""
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    distinct, ids = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(n)
    root, mark, out = np.arange(len(sets)), np.zeros(len(distinct), bool), []
    for i in left.tolist():
        near = right[(root[right] != root[i]) & (np.minimum(n[right], n[i]) >= similarity * np.maximum(n[right], n[i]))]
        if not len(near):
            continue
        own = ids[ends[i] - n[i] : ends[i]]
        mark[own] = True
        stops = np.cumsum(n[near])
        both = np.add.reduceat(mark[ids[np.repeat(ends[near] - stops, n[near]) + np.arange(stops[-1])]].astype(np.int64), stops - n[near])
        mark[own] = False
        hit = near[both >= similarity * (n[near] + n[i] - both)]
        for j in hit.tolist():
            if root[j] != root[i]:
                root[root == root[j]] = root[i]
                out.append((i, j))
    return out


def verified(members: DataFrame, similarity: float, block: int, held: int) -> DataFrame:
    """Edges (a, b) that join what all pairs of one cluster with `similarity` join; members has cluster, rep and set.

    A cluster of over `block` members or `held` bytes is dealt out in blocks, and every two blocks meet in one
    task; small clusters share tasks.
    """
    sizes = cut(members.groupBy("cluster").agg(F.count("*").alias("m"), F.sum(F.octet_length("set")).alias("bytes")).where("m > 1"))
    sizes = sizes.withColumn("nb", F.greatest(F.ceil(F.col("m") / block), F.ceil(F.col("bytes") / held)))
    few = max(1, -(-(sizes.where("nb = 1").agg(F.sum("bytes")).first()[0] or 0) // held))
    rows = with_class(members, sizes.select("cluster", "nb", F.col("m").alias("copies")), "cluster").withColumn("k", F.pmod(F.xxhash64("rep"), F.col("nb")))
    to = F.expr("transform(sequence(0L, nb - 1), x -> struct(least(k, x) AS i, greatest(k, x) AS j))")
    tasks = rows.select("nb", "cluster", "k", "rep", "set", F.when(F.col("nb") > 1, F.col("cluster")).otherwise(F.pmod(F.xxhash64("cluster"), F.lit(few))).alias("g"), F.explode(to).alias("t")).select((F.col("nb") > 1).alias("big"), "g", "t.i", "t.j", "k", "cluster", "rep", "set")

    def compare(key: tuple, t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("cluster", kind="stable")
        cluster, k, rep, raw = t.cluster.to_numpy(), t.k.to_numpy(), t.rep.to_numpy(), t.set.tolist()
        _, first = np.unique(cluster, return_index=True)
        edges = []
        for a, z in zip(first.tolist(), [*first.tolist()[1:], len(t)]):
            sets = [np.frombuffer(x, "<u8") for x in raw[a:z]]
            left, right = (np.flatnonzero(k[a:z] == key[2]), np.flatnonzero(k[a:z] == key[3])) if key[0] else (np.arange(z - a),) * 2
            edges += [(rep[a + i], rep[a + j]) for i, j in alike(sets, left, right, similarity)]
        a, b = np.array(edges, np.int64).reshape(-1, 2).T
        tidy()
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return tasks.groupBy("big", "g", "i", "j").applyInPandas(compare, "a long, b long").where("a <> b")


def near_copies(docs: DataFrame, text: str = "text", size: int = 5, similarity: float = 0.8, most: int = 46, shard: int = 8192, guests: int = 32768, fit: int = 20000, block: int = 512, held: int = 8 << 20, ids: int = 2_000_000, short: int = 11) -> DataFrame:
    """(doc_id, component_id) for every row of docs: groups of texts that share `similarity` of their shingles.

    Similarity is the Jaccard index of the sets of `size`-word shingles, A-Z in lower case; a shorter text is one
    shingle. Texts of one signature are one class without a further look; other links are pairs of one loose
    cluster of candidates whose whole texts reach `similarity`, and no pair of a loose cluster is left uncompared
    unless it is joined already. Texts of at most `short` shingles lose no link to one another. The texts of the clusters' members are found by a broadcast of their ids if there
    are at most `ids`, else by a shuffle. A component's id is its least doc_id. Null, empty and blank texts are one
    class; repeated rows are each returned; a row without an id joins the class of its signature alone and gets its
    component's id (null if it has none); rows that share an id share a component; an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    sign = array_udf(lambda t: pa.array([signature(b, size) for b in as_bytes(t)], pa.binary()), "binary")
    few = array_udf(lambda t: pa.array([subset_keys(b, size, similarity, short) for b in as_bytes(t)], pa.list_(pa.int64())), "array<bigint>")
    prints = cut(docs.select("doc_id", sign("text").alias("sig"), few("text").alias("keys")))
    reps = cut(prints.groupBy("sig").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"))).withColumn("rep", F.coalesce("first", F.lit(2**63 - 1)))
    spread = cut(spread_out(reps.where("first is not null").select("sig", "rep"), shard, fit))
    brief = short_links(prints, reps.where("first is not null"))
    loose = components(candidates(spread, most, shard, guests).unionByName(brief))
    members = cut(loose.select(F.col("node").alias("doc_id"), F.col("root").alias("cluster")).unionByName(loose.select(F.col("root").alias("doc_id"), F.col("root").alias("cluster")).distinct()))
    shingles = array_udf(lambda t: pa.array([np.unique(shingle_hashes(b, size)).tobytes() for b in as_bytes(t)], pa.binary()), "binary")
    # nothing is left of most texts, so the few members' ids go to the texts and not the texts to them
    found = docs.join(F.broadcast(members) if members.count() <= ids else members, "doc_id")
    sets = cut(found.select("cluster", F.col("doc_id").alias("rep"), shingles("text").alias("set")).where(F.octet_length("set") > 0))
    joined = components(verified(sets, similarity, block, held))
    of = cut(reps.join(joined, reps.rep == joined.node, "left").select("sig", "copies", F.coalesce("root", "first").alias("component_id")))
    return with_class(prints.select("doc_id", "sig"), of, "sig").select("doc_id", "component_id")
