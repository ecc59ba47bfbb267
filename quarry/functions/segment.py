"""Word segmentation of unspaced text: a dictionary counted from the corpus, its automaton, and the best path through a text."""

from __future__ import annotations

import math
import re
import unicodedata

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Scripts that write words without spaces between them.
UNSPACED = "぀-ヿ㐀-䶿一-鿿豈-﫿฀-໿က-႟ក-៿"
RUN = re.compile(rf"[{UNSPACED}]+|[^\W_{UNSPACED}]+")
#: Words that say nothing of a text.
STOP = frozenset("the and for with that this from are was were has have not but you all can will of to in on is it an or by as at be 的 了 是 在 和 与 及 或 有 我 你 他 她 它 们 这 那 就 也 都 而 着 把 被 对 于 以 为 从 到 吗 呢 吧 什么 怎么 如何 多少 一个 可以".split())


def fold(text: str | None) -> str:
    return unicodedata.normalize("NFKC", text or "").lower()


class Segmenter:
    """Finds the division of a run into words with the greatest product of probabilities.

    A character that no word covers stands for itself at a price above the rarest word's; of equally good divisions
    the one with longer words at its beginning counts.
    """

    def __init__(self, counts: dict[str, int]):
        self.counts = counts
        total = sum(counts.values()) or 1
        self.price = {w: -math.log(c / total) for w, c in counts.items()}
        self.unknown = math.log(total) + 5.0
        self.automaton = ahocorasick.Automaton()
        for w, p in self.price.items():
            self.automaton.add_word(w, (len(w), p))
        if counts:
            self.automaton.make_automaton()

    def __reduce__(self):
        return Segmenter, (self.counts,)

    def split(self, run: str) -> list[str]:
        n = len(run)
        ways: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        if self.counts:
            for end, (size, price) in self.automaton.iter(run):
                ways[end - size + 1].append((size, price))
        best, step = [0.0] * (n + 1), [1] * (n + 1)
        for i in range(n - 1, -1, -1):
            best[i], step[i] = self.unknown + best[i + 1], 1
            for size, price in ways[i]:
                cost = price + best[i + size]
                if cost < best[i] - 1e-12 or abs(cost - best[i]) <= 1e-12 and size > step[i]:
                    best[i], step[i] = cost, size
        out, i = [], 0
        while i < n:
            out.append(run[i : i + step[i]])
            i += step[i]
        return out

    def words(self, text: str | None) -> list[str]:
        """All words of a text in order: runs of unspaced scripts are divided, others are words as they stand."""
        return [w for run in RUN.findall(fold(text)) for w in (self.split(run) if re.match(f"[{UNSPACED}]", run) else [run])]

    def terms(self, text: str | None) -> list[str]:
        """Distinct words of two characters or more that aren't stop words, in order of appearance."""
        return list(dict.fromkeys(w for w in self.words(text) if len(w) >= 2 and w not in STOP))


def counted_words(docs: DataFrame, text: str = "text", longest: int = 4, least: int = 5, cohesion: float = 1.0, most: int = 100_000) -> dict[str, int]:
    """The dictionary of a corpus' unspaced runs: single characters, and sequences that hang together.

    A sequence of up to `longest` characters is a word if it occurs `least` times, if everywhere that it may be cut its
    parts are met together exp(cohesion) times as often as by chance, and if at least two different neighbours stand on each
    side of it. Counts are over all documents, by a shuffle of sequences that are summed up before it; the driver gets the
    `most` frequent words.
    """

    def runs(t: pa.Array) -> pa.Array:
        return pa.array([["^" + r + "$" for r in RUN.findall(fold(x)) if re.match(f"[{UNSPACED}]", r)] for x in t.to_pylist()], pa.list_(pa.string()))

    lines = docs.select(F.explode(F.arrow_udf(runs, "array<string>")(F.col(text))).alias("r"))
    at = F.sequence(F.lit(2), F.length("r") - 1)
    pieces = lines.select(F.explode(F.flatten(F.transform(at, lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("r") - i)), lambda k: F.struct(F.substring("r", i, k).alias("w"), F.substring("r", i - 1, F.lit(1)).alias("a"), F.substring("r", i + k, F.lit(1)).alias("z")))))).alias("p")).select("p.*")
    grams = pieces.groupBy("w").agg(F.count("*").alias("n"), F.approx_count_distinct("a").alias("na"), F.approx_count_distinct("z").alias("nz"))
    total = lines.agg(F.sum(F.length("r") - 2)).first()[0] or 0
    if not total:
        return {}
    long = grams.where((F.length("w") > 1) & (F.col("n") >= least) & (F.col("na") > 1) & (F.col("nz") > 1))
    cuts = long.select("w", F.col("n").alias("n"), F.explode(F.sequence(F.lit(1), F.length("w") - 1)).alias("k")).select("w", "n", F.expr("substring(w, 1, k)").alias("x"), F.expr("substring(w, k + 1)").alias("y"))
    parts = cuts.join(grams.select(F.col("w").alias("x"), F.col("n").alias("nx")), "x").join(grams.select(F.col("w").alias("y"), F.col("n").alias("ny")), "y")
    tight = parts.groupBy("w", "n").agg(F.min(F.log(F.col("n") * F.lit(float(total)) / (F.col("nx") * F.col("ny")))).alias("c")).where(F.col("c") >= cohesion)
    kept = tight.select("w", "n").unionByName(grams.where(F.length("w") == 1).select("w", "n")).orderBy(F.desc("n"), "w").limit(most)
    return {r.w: r.n for r in kept.collect()}


def terms_of(text: Column, segmenter: Segmenter) -> Column:
    """The segmenter's distinct terms of a text column."""
    return F.arrow_udf(lambda t: pa.array([segmenter.terms(x) for x in t.to_pylist()], pa.list_(pa.string())), "array<string>")(text)
