"""SimHash near-duplicates: fingerprints partitioned by vantage-point trees, queried across shard boundaries.

Two fingerprints of 64 bits that differ in at most `radius` bits differ in few bits of some segment. With
three segments of radii r0, r1, r2 and r0 + r1 + r2 + 3 > radius, a pair lies within the radius of at least
one segment, so a tree for each segment finds every pair. Within a segment a tree splits by the Hamming
distance to a vantage point; a fingerprint goes to one side as at home, and also as a guest to the outer side
if the triangle bound lets a neighbour within the segment's radius lie there.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, components, cut, forest, least_id, lower_words, record, sample, struct_udf, tidied, tidy, with_class

#: Segments as (first bit, bits).
SEGMENTS = ((0, 23), (23, 23), (46, 18))


def radii(radius: int) -> list[int]:
    """Segment radii with the least sum such that a pair within `radius` lies within one of them."""
    spare = radius + 1 - len(SEGMENTS)
    return [max(-1, spare // 3 + (k < spare % 3)) for k in range(3)] if spare >= 0 else [0] * 3


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64 of each shingle of `size` words, repeats included; a shorter text is one shingle, a blank one has none."""
    words = lower_words(text)
    n, digest = len(words), xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if n <= size:
        return np.array([digest(joined, 42)][: min(n, 1)], "<u8")
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts[: n - size + 1].tolist(), ends[size - 1 :].tolist())], "<u8")


def majority(hashes: np.ndarray) -> np.ndarray:
    """Per column of hashes (rows, words of 64 bits): the bits that are set in over half of the rows."""
    total = np.zeros(64 * hashes.shape[1], np.int64)
    for k in range(0, len(hashes), 4096):
        total += np.unpackbits(hashes[k : k + 4096].view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(total * 2 > len(hashes), bitorder="little").view("<u8")


def fingerprint(text: bytes, size: int) -> int:
    """Bit k is 1 if it is set in over half of the shingles' XXH64 values."""
    return int(majority(shingle_hashes(text, size)[:, None])[0])


def with_fingerprint(docs: DataFrame, text: str = "text", size: int = 4) -> DataFrame:
    """Adds _f.fp: the fingerprint's bits as a signed long."""

    def run(texts: pa.Array):
        return [np.array([fingerprint(b, size) for b in as_bytes(texts)], np.uint64).view(np.int64)]

    return docs.withColumn("_f", struct_udf("fp long", run)(F.col(text)))


def segment(fp: np.ndarray, s: int) -> np.ndarray:
    first, bits = SEGMENTS[s]
    return ((fp >> np.uint64(first)) & np.uint64((1 << bits) - 1)).astype(np.uint32)


def grow(values: np.ndarray, depth: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """A complete tree of `depth` levels over a bounded sample: vantage point and radius of each node.

    A radius is the median distance. On odd levels a sampled point is moved by random bits, since from a point
    outside of a dense cluster its members' distances spread more and the median divides them better; any point
    gives right results.
    """
    rng = np.random.default_rng(seed)
    points, mu = np.zeros(2**depth - 1, np.uint32), np.zeros(2**depth - 1, np.int16)
    node = np.zeros(len(values), np.int64)
    for level in range(depth):
        for at in range(2**level - 1, 2 ** (level + 1) - 1):
            mine = values[node == at]
            if len(mine) == 0:
                mine = values
            points[at] = mine[rng.integers(len(mine))] ^ np.uint32(rng.integers(1 << 31)) & np.uint32(0x3FFFF if level % 2 else 0)
            mu[at] = int(np.median(np.bitwise_count(mine ^ points[at])))
        d = np.bitwise_count(values ^ points[node])
        node = 2 * node + 1 + (d > mu[node])
    return points, mu


def route(values: np.ndarray, tree: tuple[np.ndarray, np.ndarray], r: int, native: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, leaf, at home) of every value: its own leaf, and the leaves where neighbours within r may live.

    Values that aren't native are guests from the start, and go to both sides wherever the bound allows.
    """
    points, mu = tree
    depth = int(math.log2(len(points) + 1))
    row, node, home = np.arange(len(values)), np.zeros(len(values), np.int64), np.ones(len(values), bool) if native is None else native.copy()
    for _ in range(depth):
        d = np.bitwise_count(values[row] ^ points[node]).astype(np.int16)
        inside = d <= mu[node]
        over = np.flatnonzero(inside & (d + r > mu[node]))
        back = np.flatnonzero(~home & ~inside & (d - r <= mu[node]))  # a guest is also looked for on the inner side
        child = 2 * node + 1 + ~inside
        row = np.concatenate([row, row[over], row[back]])
        node = np.concatenate([child, child[over] + 1, child[back] - 1])
        home = np.concatenate([home, np.zeros(len(over) + len(back), bool)])
    return row, node - (2**depth - 1), home


def close_pairs(v: np.ndarray, homes: np.ndarray, guests: np.ndarray, seed: int, r: int, gap, radius: int, thin, leaf: int = 48) -> tuple[np.ndarray, ...]:
    """Index pairs of homes with one another and with guests: a tree inside the shard, then its leaves.

    v are the rows' segments, searched within r; gap gives the whole distance of index pairs, which is at most
    `radius` in a result. thin(a, b, d) leaves out edges that the components don't need.
    """
    found: list[tuple[np.ndarray, ...]] = []
    depth = max(0, min(14, math.ceil(math.log2(max(1, len(homes)) / leaf))))
    everyone = np.concatenate([homes, guests])
    native = np.concatenate([np.ones(len(homes), bool), np.zeros(len(guests), bool)])
    if depth:
        tree = grow(v[homes][:: max(1, len(homes) // 20000)], depth, seed)
        row, at, home = route(v[everyone], tree, r, native)
    else:
        row, at, home = np.arange(len(everyone)), np.zeros(len(everyone), np.int64), native
    h = np.flatnonzero(home)
    h = h[np.argsort(at[h], kind="stable")]
    first = np.searchsorted(at[h], at, "left")
    count = np.searchsorted(at[h], at, "right") - first
    ids = everyone[row]
    block = 1_000_000
    ends = np.cumsum(count)
    start = 0
    while start < len(row):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + block, "right")))
        c = count[start:stop]
        left = np.repeat(ids[start:stop], c)
        right = ids[h[np.repeat(first[start:stop] - np.cumsum(c) + c, c) + np.arange(c.sum())]]
        d = gap(left, right)
        near = (d <= radius) & (left != right)
        if near.any():
            found.append(thin(left[near], right[near], d[near]))
        start = stop
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return thin(*(np.concatenate(x) for x in zip(*found)))[:2]


def stars(a: np.ndarray, b: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, ...]:
    """Edges with the same components as (a, b), by way of their least members."""
    x, y = forest(a, b)
    return x, y, np.zeros(len(x), np.uint8)


def spanning(a: np.ndarray, b: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, ...]:
    """The minimum spanning forest: in rounds, every component takes its shortest edge that leads out."""
    order = np.argsort(d, kind="stable")
    a, b, d = a[order], b[order], d[order]
    ids, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    root, kept = np.arange(len(ids)), np.zeros(len(a), bool)
    live = np.arange(len(a))
    while len(live := live[root[x[live]] != root[y[live]]]):
        best = np.full(len(ids), len(a))
        np.minimum.at(best, root[x[live]], live)
        np.minimum.at(best, root[y[live]], live)
        pick = np.unique(best[best < len(a)])
        kept[pick] = True
        top, member = forest(root[x[pick]], root[y[pick]])
        joined = np.arange(len(ids))
        joined[member] = top
        root = joined[root]
    return a[kept], b[kept], d[kept]


def block_tasks(spread: DataFrame, shard: int, guests: int, *carried: str) -> DataFrame:
    """Rows (cell, i, j, home, carried) of the tasks that together compare a cell's homes with its homes and guests.

    A cell with more homes than twice `shard`, or guests than `guests`, is dealt out in blocks: tasks are (home
    block i, home block j >= i) and (home block i, guest block hb + j).
    """
    sizes = spread.groupBy("cell").agg(F.count_if("home").alias("h"), F.count_if(~F.col("home")).alias("g"))
    plan = sizes.select("cell", F.greatest(F.lit(1), F.ceil(F.col("h") / (2 * shard))).alias("hb"), F.greatest(F.lit(0), F.ceil(F.col("g") / guests)).alias("gb"))
    placed = spread.join(plan, "cell").withColumn("k", F.pmod(F.xxhash64("rep"), F.when(F.col("home"), F.col("hb")).otherwise(F.greatest(F.col("gb"), F.lit(1)))))
    as_home = F.expr("concat(transform(sequence(k, hb + gb - 1), j -> struct(k AS i, j AS j, true AS home)), filter(transform(sequence(0L, k), j -> struct(j AS i, k AS j, false AS home)), x -> x.i < k))")
    as_guest = F.expr("transform(sequence(0L, hb - 1), j -> struct(j AS i, hb + k AS j, false AS home))")
    return placed.select("cell", *carried, F.explode(F.when(F.col("home"), as_home).otherwise(as_guest)).alias("t")).select("cell", "t.i", "t.j", F.col("t.home").alias("home"), *carried)


def leaves(values: np.ndarray, tree: tuple[np.ndarray, np.ndarray] | None, r: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """route() with every (row, leaf) once, since a row can reach a leaf on several ways; one leaf without a tree."""
    if tree is None:
        return np.arange(len(values)), np.zeros(len(values), np.int64), np.ones(len(values), bool)
    row, at, home = route(values, tree, r)
    keep = np.unique(np.stack([row, at, ~home]), axis=1)
    one = np.concatenate([[True], (np.diff(keep[:2], axis=1) != 0).any(0)]) if keep.size else np.zeros(0, bool)
    return keep[0][one], keep[1][one], keep[2][one] == 0


def links(prints: DataFrame, radius: int = 4, shard: int = 8192, guests: int = 32768, fit: int = 20000) -> DataFrame:
    """Edges (a, b) of representatives that span the same components as all pairs within `radius` bits.

    prints has distinct fp and rep. Trees are grown on a bounded sample of `fit` fingerprints; the number of
    shards follows the number of fingerprints. A shard with more homes than twice `shard`, or guests than
    `guests`, is dealt out in blocks, and every block of homes meets every block of homes and guests.
    """
    n = prints.count()
    picked = np.array([x.fp for x in sample(prints, fit, "fp").select("fp").collect()], np.int64).view(np.uint64)
    if n < 2 or not len(picked):
        return prints.select(F.col("rep").alias("a"), F.col("rep").alias("b")).limit(0)
    depth = min(14, max(0, math.ceil(math.log2(n / shard))))
    rs = radii(radius)
    trees = [grow(segment(picked, s), depth, 7 + s) if depth else None for s in range(3)]

    def deal(batches):
        for x in batches:
            fp, rep = x.column("fp").to_numpy().view(np.uint64), x.column("rep").to_numpy()
            for s in range(3):
                if rs[s] < 0:
                    continue
                row, at, home = leaves(segment(fp, s), trees[s], rs[s])
                yield record("cell long, home boolean, fp long, rep long", [at * 3 + s, home, fp[row].view(np.int64), rep[row]])

    spread = cut(prints.select("fp", "rep").mapInArrow(tidied(deal), "cell long, home boolean, fp long, rep long"))

    def shard_links(key: tuple, t: pd.DataFrame) -> pd.DataFrame:
        fp, rep, home = t.fp.to_numpy().view(np.uint64), t.rep.to_numpy(), t.home.to_numpy()
        s = int(key[0]) % 3
        a, b = close_pairs(segment(fp, s), np.flatnonzero(home), np.flatnonzero(~home), s, rs[s], lambda i, j: np.bitwise_count(fp[i] ^ fp[j]), radius, stars)
        tidy()
        return pd.DataFrame({"a": rep[a], "b": rep[b]})

    return block_tasks(spread, shard, guests, "fp", "rep").groupBy("cell", "i", "j").applyInPandas(shard_links, "a long, b long")


def simhash_components(docs: DataFrame, text: str = "text", size: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs.

    Fingerprints link at `radius` or fewer differing bits; a component's id is its least doc_id. Null, empty
    and blank texts have fingerprint zero and are linked like any other; repeated rows are each returned; a
    null doc_id gets its component's id and never is one (null if there is no other). Classes of equal fingerprints
    are numbered for the search, so that those without an id stay apart; an empty table gives
    no rows. Texts are hashed whole, and equal fingerprints are one node, so a group of exact copies costs
    one comparison.
    """
    prints = cut(with_fingerprint(docs.select("doc_id", F.col(text).alias("text")), "text", size).select("doc_id", F.col("_f.fp").alias("fp")))
    reps = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")).withColumn("rep", F.monotonically_increasing_id()))
    joined = components(links(reps.select("fp", "rep"), radius))
    of = cut(reps.join(joined, reps.rep == joined.node, "left").select("fp", "first", "copies", F.coalesce("root", "rep").alias("root")))
    return with_class(prints, least_id(of, "fp"), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
