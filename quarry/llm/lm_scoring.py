"""Language-model scoring: corpus-wide word counts and a gated recurrent model over whole documents."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gru
from .common import cut, held_out, lower_words, record, reuse_memory, tidied, tidy

CHUNK = "chunk long, doc_ids binary, nulls binary, held binary, lengths binary, words binary, hashes binary, counts binary"
#: The hash that stands for the end of a text; a word's XXH64 is never taken to be this one.
END_HASH = np.uint64(0)


def squeeze(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).tobytes())


def open_up(raw: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), kind)


def word_hashes(words: list[bytes]) -> np.ndarray:
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    h[h == END_HASH] = 1
    return h


def distinct_places(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.unique() with the inverse, of few distinct values among many: only the distinct ones are sorted."""
    at, distinct = pd.factorize(h)
    order = np.argsort(distinct)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return distinct[order], place[at]


def chunks(docs: DataFrame, size: int) -> DataFrame:
    """Documents in chunks of about `size` bytes of text: words as places in the chunk's sorted list of hashes.

    hashes are distinct; counts are their numbers in the chunk's training documents.
    """

    def run(batches):
        task = TaskContext.get()
        chunk = (task.partitionId() if task else 0) << 32
        ids, held, hashes, bytes_held = [], [], [], 0

        def flush():
            nonlocal ids, held, hashes, bytes_held, chunk
            lengths = np.array([len(h) for h in hashes], np.int64)
            distinct, at = distinct_places(np.concatenate(hashes))
            learn = np.repeat(~np.array(held, bool), lengths)
            counts = np.bincount(at[learn], minlength=len(distinct))
            row = [[chunk], [np.array([i or 0 for i in ids], "<i8").tobytes()], [np.array([i is None for i in ids]).tobytes()], [np.array(held, bool).tobytes()], [lengths.astype("<i4").tobytes()], [squeeze(at.astype("<i4"))], [distinct.astype("<u8").tobytes()], [counts.astype("<i4").tobytes()]]
            chunk += 1
            ids, held, hashes, bytes_held = [], [], [], 0
            return record(CHUNK, row)

        for b in batches:
            for i, h, t in zip(b.column("doc_id").to_pylist(), b.column("held_out").to_pylist(), b.column("text").cast(pa.binary())):
                t = t.as_py() or b""
                ids.append(i)
                held.append(h)
                hashes.append(np.append(word_hashes(lower_words(t)), END_HASH))
                bytes_held += len(t) + 64
                if bytes_held >= size:
                    yield flush()
        if ids:
            yield flush()

    return docs.mapInArrow(tidied(run), CHUNK)


def sides(distinct: int) -> int:
    """Classes, and words a class, of a network for so many distinct words: four times their root in all, 1,024 at least."""
    return max(32, math.ceil(2 * distinct**0.25))


def ids_of(hidden: int, classes: int, members: int, singles: int = 0) -> int:
    return singles + classes * members


def layout(distinct: int) -> tuple[int, int, int, int]:
    """(hidden, classes, members, singles) with room for as many words as sides() says, and the two special ids.

    The end, other words and the most frequent ones, some half of all tokens, lie in no class and need a small softmax
    alone; fewer, larger classes hold the rest.
    """
    side = sides(distinct)
    singles, classes = side // 4, -(-2 * side // 3)
    return 32, classes, -(-(side * side + 2 - singles) // classes), singles


def lookups(packed: DataFrame, top: int | None, entries: int) -> DataFrame:
    """Counts over all training documents: rows (kind, chunk, bucket, payload, n, v).

    A chunk's sorted hashes are cut into ranges, one a bucket; the chunk has each word once, so no word is hot.
    kind 0 answers a chunk with the counts of its hashes in a bucket; kind 1 has a bucket's tokens n, distinct
    words v, and its `top` most frequent words, by default as many as the network can have. Buckets follow the number of entries, about `entries` in each.
    """
    n = packed.agg(F.sum(F.octet_length("hashes"))).first()[0] or 0
    buckets = max(1, math.ceil(n / 8 / entries))
    top = top or ids_of(*layout(n // 8))  # a distinct word is an entry of some chunk
    width = (1 << 64) // buckets + 1

    def split(batches):
        for b in batches:
            for chunk, h, c in zip(*(b.column(x).to_pylist() for x in ("chunk", "hashes", "counts"))):
                h, c = np.frombuffer(h, "<u8"), np.frombuffer(c, "<i4")
                ends = np.searchsorted(h, np.array([k * width for k in range(1, buckets)], np.uint64)) if buckets > 1 else np.zeros(0, np.int64)
                at = [0, *ends.tolist(), len(h)]
                rows = [(k, chunk, h[a:z].tobytes(), c[a:z].tobytes()) for k, (a, z) in enumerate(zip(at, at[1:])) if z > a]
                if rows:
                    yield record("bucket long, chunk long, hashes binary, counts binary", [list(x) for x in zip(*rows)])

    def add(key: tuple, t: pd.DataFrame) -> pd.DataFrame:
        h = np.concatenate([np.frombuffer(x, "<u8") for x in t.hashes])
        c = np.concatenate([np.frombuffer(x, "<i4") for x in t.counts])
        distinct, at = np.unique(h, return_inverse=True)
        total = np.bincount(at, c, len(distinct)).astype("<i8")
        answers = total[at]
        ends = np.cumsum([len(x) // 8 for x in t.hashes])
        best = np.lexsort((distinct, -total))[:top]
        rows = [(0, int(k), int(key[0]), squeeze(answers[z - len(x) // 8 : z]), 0, 0) for k, x, z in zip(t.chunk, t.hashes, ends)]
        rows.append((1, -1, int(key[0]), np.concatenate([distinct[best].view("<i8"), total[best]]).tobytes(), int(total.sum()), int((total > 0).sum())))
        return pd.DataFrame(rows, columns=["kind", "chunk", "bucket", "payload", "n", "v"])

    ranges = packed.select("chunk", "hashes", "counts").mapInArrow(split, "bucket long, chunk long, hashes binary, counts binary")
    return ranges.repartition(min(buckets, 20_000), "bucket").groupBy("bucket").applyInPandas(add, "kind long, chunk long, bucket long, payload binary, n long, v long")


class Language:
    """Weights with the vocabulary's hashes (sorted) and their word ids, and what lies outside it."""

    def __init__(self, hashes, ids, weights, tokens, distinct, known_tokens, known):
        self.hashes, self.ids, self.weights = hashes, ids, weights
        self.tokens, self.distinct = tokens, distinct
        self.outside = math.log(tokens - known_tokens + (distinct - known) + 1)

    def words(self, h: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.ids[at], gru.UNKNOWN)


def document_hash(ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A hash of each document's id and number of words: the same wherever the document stands."""
    h = (ids.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9) + lengths.astype(np.uint64)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def streams_of(packed: DataFrame, language: Language, groups: int, one_of: int = 1) -> DataFrame:
    """Rows (g, keys, lengths, words): the training documents dealt to groups by a hash, as ids of the vocabulary.

    With one_of, one document of so many, by another part of the hash.
    """
    shared = packed.sparkSession.sparkContext.broadcast(language)
    schema = "g long, keys binary, lengths binary, words binary"

    def run(batches):
        reuse_memory()
        lang = shared.value
        for b in batches:
            for ids, held, lengths, words, hashes in zip(*(b.column(x).to_pylist() for x in ("doc_ids", "held", "lengths", "words", "hashes"))):
                n = np.frombuffer(lengths, "<i4").astype(np.int64)
                key = document_hash(np.frombuffer(ids, "<i8"), n)
                word = lang.words(np.frombuffer(hashes, "<u8"))[open_up(words, "<i4")].astype("<u4")
                learn = ~np.frombuffer(held, bool) & ((key >> np.uint64(32)) % np.uint64(one_of) == 0)
                group = np.where(learn, (key & np.uint64(0xFFFFFFFF)) % np.uint64(groups), groups).astype(np.int64)
                owner = np.repeat(group, n)
                for g in np.unique(group[learn]).tolist():
                    mine = group == g
                    yield record(schema, [[g], [key[mine].tobytes()], [n[mine].astype("<i4").tobytes()], [squeeze(word[owner == g])]])

    return packed.select("doc_ids", "held", "lengths", "words", "hashes").mapInArrow(tidied(run), schema)


def improve(packed: DataFrame, language: Language, groups: int, one_of: int = 1, streams: int = 256, rate: float = 8e-3, fan: int = 32) -> tuple[np.ndarray | None, int]:
    """One round of local training: every group goes on from the weights over all its documents, in the order of
    their hashes; the weights are averaged by the number of tokens, `fan` at a time, up a tree. Neither
    the groups nor any order depend on how the rows are partitioned. Also gives the number of tokens."""
    shared = packed.sparkSession.sparkContext.broadcast(language.weights)

    def learn(key: tuple, t: pd.DataFrame) -> pd.DataFrame:
        reuse_memory()
        keys = np.concatenate([np.frombuffer(x, "<u8") for x in t["keys"]])
        lengths = np.concatenate([np.frombuffer(x, "<i4") for x in t.lengths]).astype(np.int64)
        words = np.concatenate([open_up(x, "<u4") for x in t.words])
        begin = np.cumsum(lengths) - lengths
        first = words[begin]
        order = np.lexsort((first, lengths, keys))
        n = lengths[order]
        to = np.cumsum(n)
        stream = words[np.repeat(begin[order] - to + n, n) + np.arange(to[-1])].astype(np.int64)
        trainer = gru.Trainer(shared.value)
        trainer.run(stream, min(streams, max(16, len(stream) // 16_000)), 16, rate)
        tidy()
        return pd.DataFrame({"g": [int(key[0])], "n": [len(stream)], "w": [gru.pack(trainer.p).tobytes()]})

    def merge(key: tuple, t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("g")
        total = np.zeros(len(t.w.iloc[0]) // 4)
        for w, n in zip(t.w, t.n):
            total += np.frombuffer(w, np.float32).astype(np.float64) * n
        return pd.DataFrame({"g": [int(key[0])], "n": [int(t.n.sum())], "w": [(total / t.n.sum()).astype(np.float32).tobytes()]})

    schema = "g long, n long, w binary"
    parts = streams_of(packed, language, groups, one_of).repartition(min(groups, 20_000), "g").groupBy("g").applyInPandas(learn, schema)
    left = groups
    while left > 1:  # a tree of averages: no task holds more than `fan` weight vectors
        left = -(-left // fan)
        parts = parts.groupBy(F.pmod("g", F.lit(left)).alias("k")).applyInPandas(merge, schema)
    got = parts.collect()
    return (np.frombuffer(got[0].w, np.float32), got[0].n) if got else (None, 0)


def lm_scores(docs: DataFrame, dims: tuple[int, ...] | None = None, chunk: int = 10 << 20, entries: int = 250_000, start: int = 500_000, group: int = 2_000_000) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of docs (doc_id, text).

    Counts are of all documents whose id's CRC-32 modulo 7 is not 2. The recurrent model has dims = (hidden,
    classes, words a class, and words that are in none): the most frequent words of all training documents, the end, and one id for other
    words, whose share is dealt out by their counts plus one. By default hidden is 32 and the vocabulary grows
    with the distinct words of the training documents, as layout() says. The model is started on training documents
    of about `start` tokens; from there groups of about `group` tokens, or eight times the number of weights where
    that is more, each train on all their documents, and the weights are averaged.
    Every text is scored whole from its first word to its end, its state carried along. Null text counts as empty: one token,
    the end. Repeated rows are scored alike; without training documents N and V are 0 and the model is uniform
    over its ids; an empty table gives no rows. Words are told apart by their 64-bit hashes.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("held_out", held_out("doc_id", 7))
    packed = cut(chunks(docs, chunk))
    answers = cut(lookups(packed, dims and ids_of(*dims), entries))
    stats = answers.where("kind = 1")
    sums = stats.agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    tokens, distinct = int(sums.n or 0), int(sums.v or 0)
    dims = dims or layout(distinct)
    size = ids_of(*dims)

    def unroll(batches):
        for b in batches:
            for raw in b.column("payload").to_pylist():
                a = np.frombuffer(raw, "<i8")
                yield record("h long, c long", [a[: len(a) // 2], a[len(a) // 2 :]])

    most = stats.select("payload").mapInArrow(unroll, "h long, c long").where("c > 0").orderBy(F.desc("c"), "h").limit(size - 1).collect()
    end = [x.c for x in most if x.h == 0] + [0]
    vocabulary = [(x.h, x.c) for x in most if x.h != 0][: size - 2]
    counts = np.zeros(size)
    counts[gru.END] = end[0]
    counts[2 : 2 + len(vocabulary)] = [c for _, c in vocabulary]
    known_tokens = int(counts.sum())
    counts[gru.UNKNOWN] = max(1, tokens - known_tokens)
    hashes = np.array([0] + [h for h, _ in vocabulary], np.int64).view(np.uint64)
    order = np.argsort(hashes)
    ids = np.concatenate([[gru.END], np.arange(2, 2 + len(vocabulary))])
    language = Language(hashes[order], ids[order], gru.start(counts, *dims), tokens, distinct, known_tokens, len(vocabulary) + (end[0] > 0))
    at_least = max(group, 8 * sum(v.size for v in language.weights.values()))
    for groups, one_of in ((1, max(1, tokens // start)), (max(1, -(-tokens // at_least)), 1)):
        flat, _ = improve(packed, language, groups, one_of)
        if flat is not None:
            language.weights = gru.unpack(flat, *dims)
    shared = docs.sparkSession.sparkContext.broadcast(language)
    out = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def run(batches):
        reuse_memory()
        lang = shared.value
        for b in batches:
            for row in b.to_pylist():
                n = np.frombuffer(row["lengths"], "<i4").astype(np.int64)
                at = open_up(row["words"], "<i4")
                c = np.concatenate([open_up(x["payload"], "<i8") for x in sorted(row["parts"], key=lambda x: x["bucket"])])
                word = lang.words(np.frombuffer(row["hashes"], "<u8"))
                base = np.log10((c + 1) / (lang.tokens + lang.distinct + 1))
                rare = np.where(word == gru.UNKNOWN, np.log(c + 1.0) - lang.outside, 0.0)
                begin = np.cumsum(n) - n
                ll = gru.score(lang.weights, word[at], n) + np.add.reduceat(rare[at], begin)
                nulls = np.frombuffer(row["nulls"], bool)
                yield record(out, [pa.array(np.frombuffer(row["doc_ids"], "<i8"), mask=nulls), np.frombuffer(row["held"], bool), n, np.add.reduceat((c > 0)[at].astype(np.int64), begin), np.full(len(n), lang.tokens), np.add.reduceat(base[at], begin), ll / math.log(10)])

    parts = answers.where("kind = 0").groupBy("chunk").agg(F.collect_list(F.struct("bucket", "payload")).alias("parts"))
    return packed.select("chunk", "doc_ids", "nulls", "held", "lengths", "words", "hashes").join(parts, "chunk").mapInArrow(tidied(run), out)
