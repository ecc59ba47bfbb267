"""Ranked lexical search: a dual-sorted wavelet tree for each shard of documents.

A shard lays the posting lists of its terms one behind the other, each by falling impact, and keeps the sequence of
their document ordinals as a wavelet tree: every level splits a node's ordinals at the middle, stably, so that in
each node a list is still one range and still ordered by impact. The first posting of a range thus bounds what its
list can add to any document of the node, and the sum over a query's lists bounds the whole score. A search takes the
nodes of the greatest bounds first, follows the ranges of all lists into both children at once, scores the
documents of the lowest nodes exactly, and ends when no bound reaches the k-th best score.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, tidied

#: Fixed value: bytes of [^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F] stay, A-Z in lower case; others separate terms.
TERM_BYTES = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def counted(text: bytes | None) -> Counter:
    """How often each term occurs; null has none."""
    return Counter((text or b"").translate(TERM_BYTES).split())


class WaveletTree:
    """Postings (list, ordinal, impact) of a shard; ordinals are below 2^depth times `leaf`."""

    def __init__(self, lists: np.ndarray, ordinals: np.ndarray, impacts: np.ndarray, n_lists: int, n_ordinals: int, leaf: int = 16):
        self.depth = max(0, math.ceil(math.log2(max(1, n_ordinals) / leaf)))
        self.shift = max(0, math.ceil(math.log2(max(1, n_ordinals)))) - self.depth  # low bits that stay together
        order = np.lexsort((ordinals, -impacts, lists))
        lists, docs, worth = lists[order], ordinals[order].astype(np.int32), impacts[order]
        self.starts = np.searchsorted(lists, np.arange(n_lists + 1)).astype(np.int32)
        n = len(docs)
        self.zeros = np.zeros((self.depth, n + 1), np.int32)  # rank of the postings that go left
        self.worth = np.zeros((self.depth + 1, n + 1), np.int64)  # one more, so that an empty range's first can be read
        self.worth[0, :n] = worth
        for level in range(self.depth):
            # nodes lie behind one another and their postings go on in the same order: one stable sort by the next bit
            child = docs >> (self.shift + self.depth - 1 - level)
            np.cumsum(child & 1 == 0, out=self.zeros[level, 1:])
            to = np.argsort(child, kind="stable")
            docs = docs[to]
            self.worth[level + 1, :n] = self.worth[level, to]
        self.docs, self.n_ordinals = docs, n_ordinals

    def top(self, lists: np.ndarray, times: np.ndarray, k: int, floor: int = 0, batch: int = 128) -> tuple[np.ndarray, np.ndarray]:
        """(ordinal, score) of the k best documents for the lists, each counted `times`; equal scores by ordinal.

        Scores that don't exceed `floor` aren't sought. Nodes are taken `batch` at a time.
        """
        best_doc, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
        lo, hi = self.starts[lists][None].astype(np.int64), self.starts[lists + 1][None].astype(np.int64)
        frontier = [np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64), np.full(1, len(self.docs)), lo, hi]  # level, first ordinal, node's begin and end, ranges
        bound = (np.where(hi > lo, self.worth[0, lo], 0) * times).sum(1)
        while len(bound):
            least = max(floor, best[-1] if len(best) == k else 0)
            # of a bound that only equals the k-th score, a lower ordinal may still matter
            alive = (bound > least) | ((bound == least) & (least > floor) & (len(best) == k) & (frontier[1] < (best_doc[-1] if len(best) else 0)))
            if not alive.all():
                bound, frontier = bound[alive], [f[alive] for f in frontier]
                if not len(bound):
                    break
            if len(bound) > batch:
                pick = np.argpartition(-bound, batch)[:batch]
                rest = np.ones(len(bound), bool)
                rest[pick] = False
                now, bound, frontier = [f[pick] for f in frontier], bound[rest], [f[rest] for f in frontier]
            else:
                now, bound, frontier = frontier, bound[:0], [f[:0] for f in frontier]
            low = now[0] == self.depth
            if low.any():
                d, s = self._scored(now[4][low], now[5][low], times)
                keep = s > least
                if least > floor:
                    keep |= s == least
                d, s = np.concatenate([best_doc, d[keep]]), np.concatenate([best, s[keep]])
                at = np.lexsort((d, -s))[:k]
                best_doc, best = d[at], s[at]
            if not low.all():
                level, first, begin, end, lo, hi = (f[~low] for f in now)
                z = self.zeros
                at = level[:, None]
                zb, zl, zh = z[level, begin], z[at, lo], z[at, hi]
                split = begin + z[level, end] - zb
                l_lo, l_hi = begin[:, None] + zl - zb[:, None], begin[:, None] + zh - zb[:, None]
                r_lo, r_hi = split[:, None] + lo - begin[:, None] - (zl - zb[:, None]), split[:, None] + hi - begin[:, None] - (zh - zb[:, None])
                lo, hi, level = np.concatenate([l_lo, r_lo]), np.concatenate([l_hi, r_hi]), np.concatenate([level, level]) + 1
                more = (np.where(hi > lo, self.worth[level[:, None], lo], 0) * times).sum(1)
                half = np.int64(1) << (self.shift + self.depth - level)
                child = [level, np.concatenate([first, first]) + np.where(np.arange(len(level)) < len(first), 0, half), np.concatenate([begin, split]), np.concatenate([split, end]), lo, hi]
                bound, frontier = np.concatenate([bound, more]), [np.concatenate([f, c]) for f, c in zip(frontier, child)]
        return best_doc, best

    def _scored(self, lo: np.ndarray, hi: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact scores of the documents in lowest nodes: the sums over their ranges."""
        size = (hi - lo).ravel()
        total = int(size.sum())
        at = np.repeat(lo.ravel() - np.cumsum(size) + size, size) + np.arange(total)
        docs, add = self.docs[at], self.worth[self.depth, at] * np.repeat(np.broadcast_to(times, lo.shape).ravel(), size)
        score = np.zeros(self.n_ordinals, np.int64)
        np.add.at(score, docs, add)
        seen = np.flatnonzero(score)
        return seen, score[seen]


def postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, t array, tf array): terms with repeats in the whole text, and those of the vocabulary with their numbers."""
    schema = "doc_id long, n long, t array<int>, tf array<long>"

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, 1024):
                part = b.slice(k, 1024)
                n, t, tf, ends = [], [], [], [0]
                for text in part.column("text"):
                    raw = text.as_buffer()
                    got = counted(raw.to_pybytes() if raw is not None else None)
                    n.append(got.total())
                    for w, c in got.items():
                        v = vocabulary.get(w)
                        if v is not None:
                            t.append(v)
                            tf.append(c)
                    ends.append(len(t))
                ends = pa.array(ends, pa.int32())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(t, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(tf, pa.int64()))], names=["doc_id", "n", "t", "tf"])

    return docs.mapInArrow(tidied(run), schema)


def shard_best(index: DataFrame, items: list[tuple[int, np.ndarray, np.ndarray]], weights: np.ndarray, total: int, length: int, k: int, shard: int, most: int) -> DataFrame:
    """(item, doc_id, score): the k best documents of each partition for each item.

    A partition's documents make shards of at most `shard` documents and about `most` postings, one tree each; the
    k-th score so far is the floor for the next shard's search.
    """

    def run(batches):
        found = [(np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))] * len(items)  # ids, whether null, scores
        held, size = [], 0

        def search():
            doc_id, n = np.concatenate([h[0] for h in held]), np.concatenate([h[2] for h in held])
            null = np.concatenate([h[1] for h in held])
            each = np.concatenate([h[3] for h in held])
            t, tf = np.concatenate([h[4] for h in held]), np.concatenate([h[5] for h in held])
            order = np.lexsort((doc_id, null))  # ordinals follow the ids, null ones last
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            m = 25 + 75 * n * total // length
            impact = weights[t] * (1_000_000_000 * tf // (1000 * tf + 8 * np.repeat(m, each)))
            tree = WaveletTree(t, np.repeat(place, each), impact, len(weights), len(order))
            for i, (_, lists, times) in enumerate(items):
                ids, nulls, scores = found[i]
                # a score that only equals the floor may belong to a lower id, so the floor is one less
                floor = max(0, int(scores[-1]) - 1) if len(scores) == k else 0
                d, s = tree.top(lists, times, k, floor)
                if len(d):
                    d = order[d]
                    ids, nulls, scores = np.concatenate([ids, doc_id[d]]), np.concatenate([nulls, null[d]]), np.concatenate([scores, s])
                    at = np.lexsort((ids, nulls, -scores))[:k]
                    found[i] = ids[at], nulls[at], scores[at]

        for b in batches:
            for k0 in range(0, b.num_rows, 512):
                part = b.slice(k0, 512)
                ids, t, tf = part.column("doc_id"), part.column("t"), part.column("tf")
                held.append((ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False), part.column("n").to_numpy(), np.diff(t.offsets.to_numpy()), t.flatten().to_numpy(), tf.flatten().to_numpy()))
                size += len(held[-1][4])
                if sum(len(h[0]) for h in held) >= shard or size >= most:
                    search()
                    held, size = [], 0
        if held:
            search()
        for (item, _, _), (ids, nulls, scores) in zip(items, found):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), item)), pa.array(ids, mask=nulls), pa.array(scores)], names=["item", "doc_id", "score"])

    return index.mapInArrow(tidied(run), "item long, doc_id long, score long")


def ranked(found: DataFrame, k: int, parts: int) -> DataFrame:
    """The k best of each item: first within groups of partitions, then of all, so that no task gets all candidates of an item."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    some = found.withColumn("_g", F.spark_partition_id() % max(1, math.isqrt(parts)))
    some = some.withColumn("_r", F.row_number().over(Window.partitionBy("item", "_g").orderBy(*order))).where(f"_r <= {k}").drop("_r", "_g")
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(f"rank <= {k}")


def search(docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", query_col: str = "text", shard: int = 8192, most: int = 1_000_000, block_chars: int = 16_000_000) -> DataFrame:
    """(item_id, rank, doc_id, score): the k highest-scoring documents of each item, equal scores by ascending doc_id.

    Terms are the maximal runs of letters and digits of ASCII and of characters beyond it, A-Z in lower case, over
    whole texts. N documents hold a term, L terms with repeats are in all of them, n in one, df documents hold a
    term, tf times it occurs in one: w = floor(1000 ln((2N+2)/(2df+1))), m = 25 + 75nN div L, and a document's score
    sums w * (10^9 tf div (1000 tf + 8m)) over the item's terms, repeats included. Only scores above 0 count.

    Null and empty texts have no terms, so they are never found and find nothing. Each row is a document of its
    own, whatever its id: rows that share an id are ranked each, null ids come last among equal scores. Items are
    rows of their own as well: a repeated item, or one with a null id, gets its ranks each time. Empty tables give no rows.

    Items are searched in blocks of about `block_chars` characters, each against all documents; what is sent to the
    tasks is bounded by it. The index of a block holds the postings of its terms over all documents.
    """
    items = cut(queries.select(F.col(item_col).cast("long").alias("item_id"), F.col(query_col).cast("string").alias("text")).withColumn("item", F.monotonically_increasing_id()))
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_chars))
    out = None
    for block in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block) if blocks > 1 else items
        asked = [(r.item, counted(r.text.encode())) for r in mine.where("text is not null").select("item", "text").collect()]
        vocabulary = {w: i for i, w in enumerate(sorted({w for _, c in asked for w in c}))}
        source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
        index = cut(postings(source, vocabulary))
        total, length = index.where("n > 0").agg(F.count("*"), F.sum("n")).first()
        if not vocabulary or not total:
            continue
        df = np.zeros(len(vocabulary), np.int64)
        for r in index.select(F.explode("t").alias("t")).groupBy("t").count().collect():
            df[r.t] = r["count"]
        weights = np.array([math.floor(1000 * math.log((2 * total + 2) / (2 * int(x) + 1))) for x in df], np.int64)
        lists = [(item, np.array([vocabulary[w] for w in c], np.int64), np.array(list(c.values()), np.int64)) for item, c in asked if c]
        # shards of a useful size, with as many tasks as the session's default at least
        parts = max(docs.sparkSession.sparkContext.defaultParallelism, -(-total // shard))
        best = ranked(shard_best(index.where("n > 0").coalesce(parts), lists, weights, total, length, k, shard, most), k, parts)
        got = cut(best.join(F.broadcast(mine.select("item", "item_id")), "item").select("item_id", "rank", "doc_id", "score"))
        out = got if out is None else out.unionByName(got)
    return out if out is not None else docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
