"""Segmentation against all divisions, and against the words that unspaced text was made of."""

import itertools
import math
import random

from pyspark.sql import functions as F

from quarry.functions.segment import Segmenter, counted_words, terms_of
from quarry.operators.retrieval import term_route


def cheapest(run, counts):
    total, unknown = sum(counts.values()), math.log(sum(counts.values())) + 5.0
    best = None
    for cuts in itertools.product((0, 1), repeat=len(run) - 1):
        words, at = [], 0
        for k, c in enumerate(cuts, 1):
            if c:
                words.append(run[at:k])
                at = k
        words.append(run[at:])
        if all(len(w) == 1 or w in counts for w in words):
            cost = sum(-math.log(counts[w] / total) if w in counts else unknown for w in words)
            best = cost if best is None else min(best, cost)
    return best


def test_best_path():
    rng = random.Random(3)
    counts = {"".join(rng.choices("天地人口手", k=rng.randint(1, 4))): rng.randint(1, 50) for _ in range(40)}
    s, total = Segmenter(counts), sum(counts.values())
    for _ in range(200):
        run = "".join(rng.choices("天地人口手足", k=rng.randint(1, 11)))
        got = s.split(run)
        cost = sum(-math.log(counts[w] / total) if w in counts else s.unknown for w in got)
        assert "".join(got) == run and abs(cost - cheapest(run, counts)) < 1e-9
    assert Segmenter({}).split("天地") == ["天", "地"] and s.words("Abc１２ 天x_y") == ["abc12", *s.split("天"), "x", "y"] and s.words(None) == [] and s.terms("the 天") == []


def test_dictionary_of_a_corpus(spark):
    rng = random.Random(7)
    letters = [chr(0x4E00 + k) for k in range(300)]
    words = list({"".join(rng.sample(letters, rng.choice((1, 2, 2, 2, 3)))) for _ in range(400)})
    weight = [1 / (k + 5) for k in range(len(words))]
    lines = [rng.choices(words, weight, k=rng.randint(4, 14)) for _ in range(4000)]
    docs = spark.createDataFrame([(k, "，".join(["".join(w[:5]), "".join(w[5:])]) + " plain words") for k, w in enumerate(lines)] + [(-1, None), (-2, ""), (-3, "only latin")], "chunk_id long, text string")
    counts = counted_words(docs)
    s = Segmenter(counts)

    def spans(parts):
        at, out = 0, set()
        for p in parts:
            out.add((at, at + len(p)))
            at += len(p)
        return out

    hit = found = true = 0
    for w in lines[:600]:
        a, b = spans(w[:5]), spans(s.split("".join(w[:5])))
        hit, found, true = hit + len(a & b), found + len(b), true + len(a)
    assert hit / found > 0.9 and hit / true > 0.9
    got = {r.chunk_id: r.t for r in docs.select("chunk_id", terms_of(F.col("text"), s).alias("t")).collect()}
    assert got[-1] == [] and got[-3] == ["only", "latin"] and all("plain" in got[k] for k in range(9))
    two = [w for w in words[:30] if len(w) == 2 and w in counts][:2]
    best = term_route(docs, "".join(two), segmenter=s).collect()
    asked = s.terms("".join(two))
    assert best and all(r.hits == len(set(asked) & set(got[r.chunk_id])) >= min(2, len(asked)) for r in best)
    assert counted_words(docs.limit(0)) == {}
