"""Ranked search against plain scoring of every document, on awkward rows."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from quarry.llm import lexical_search

DOCS = "doc_id long, text string, item_id string, rank string, score string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(t):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def plain(docs, items, k=10):
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c, c.total()) for i, c in held if c]
    total, length = len(held), sum(n for _, _, n in held)
    df = Counter(w for _, c, _ in held for w in c)
    out = []
    for item, text in items:
        rows = []
        for i, c, n in held:
            m = 100 - 75 + (75 * n * total) // length
            score = sum(times * math.floor(1000 * math.log((2 * total + 2) / (2 * df[w] + 1))) * ((1000000000 * c[w]) // (1000 * c[w] + 8 * m)) for w, times in Counter(terms(text)).items() if w in c)
            if score > 0:
                rows.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(rows)[:k])]
    return Counter(out)


@pytest.fixture(scope="module")
def rows(spark):
    base = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    hot = [(5000 + i, base[0][1]) for i in range(40)]
    return [*base, *hot, base[1], base[1], (None, base[2][1]), (None, base[2][1]), (None, None), (7000, None), (7001, ""), (7002, " \t%%"), (7003, "word " * 30000), (7004, "É1 é1 Ünder x\U0001f600 A_b C-d"), (7005, base[3][1][: len(base[3][1]) // 2])]


@pytest.mark.parametrize("shard, most, chars, parts", [(8192, 1_000_000, 16_000_000, 3), (50, 2000, 20_000, 7)])
def test_against_plain_scoring(spark, rows, shard, most, chars, parts):
    items = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select("item_id", "text").collect()]
    items += [(100, rows[0][1]), (101, rows[2][1]), (102, None), (103, ""), (104, "nosuchterm"), (105, "É1 a_b a_b a_b C d"), (None, rows[1][1])]
    docs = spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], DOCS).repartition(parts)
    queries = spark.createDataFrame([(*r, "clash", 1.0) for r in items], "item_id long, text string, doc_id string, score double")
    got = Counter(tuple(r) for r in lexical_search.search(docs, queries, shard=shard, most=most, block_chars=chars).select("item_id", "rank", "doc_id", "score").collect())
    assert got == plain(rows, items)


def test_repeated_items_and_empty_tables(spark, rows):
    docs = spark.createDataFrame([(*r, "", "", "") for r in rows], DOCS)
    queries = spark.createDataFrame([(1, rows[0][1]), (1, rows[0][1])], "item_id long, text string")
    got = lexical_search.search(docs, queries, k=3).collect()
    assert sorted(r["rank"] for r in got) == [1, 1, 2, 2, 3, 3]
    assert lexical_search.search(docs.limit(0), queries).count() == 0 and lexical_search.search(docs, queries.limit(0)).count() == 0


@pytest.mark.parametrize("leaf, batch", [(16, 64), (1, 1), (4, 5)])
def test_tree_finds_the_best_and_prunes(leaf, batch):
    rng = np.random.default_rng(4)
    n, lists = 700, 30
    hold = rng.random((lists, n)) < rng.uniform(0.02, 0.9, (lists, 1))
    worth = np.where(hold, rng.integers(1, 50, (lists, n)) * rng.choice([1, 40], (lists, 1)), 0)
    t, d = np.nonzero(worth)
    tree = lexical_search.WaveletTree(t, d, worth[t, d], lists, n, leaf)
    for _ in range(40):
        asked = rng.choice(lists, 6, replace=False)
        times = rng.integers(1, 4, 6)
        score = (worth[asked] * times[:, None]).sum(0)
        order = np.lexsort((np.arange(n), -score))
        order = order[score[order] > 0]
        for floor in (0, int(score[order[4]])):
            want = order[score[order] > floor][:10]
            got, s = tree.top(asked, times, 10, floor, batch)
            assert got.tolist() == want.tolist() and s.tolist() == score[want].tolist()
    planted = worth[:, :1] * 0
    planted[:6] = 10**6
    t, d = np.nonzero(np.concatenate([worth[:, 1:], planted], axis=1))
    tree, seen = lexical_search.WaveletTree(t, d, np.concatenate([worth[:, 1:], planted], axis=1)[t, d], lists, n, leaf), []
    real = tree._scored
    tree._scored = lambda lo, hi, times: seen.append(len(lo)) or real(lo, hi, times)
    assert tree.top(np.arange(6), np.ones(6, int), 1, 0, 1)[0].tolist() == [n - 1] and sum(seen) == 1  # one leaf of all
