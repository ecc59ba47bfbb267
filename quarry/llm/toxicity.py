"""Toxicity: a weighted lexicon found by an Aho-Corasick automaton in folded texts.

Folding takes case, accents, homoglyphs, digit and symbol substitutions and stretched letters off a word, so that
disguised forms meet the lexicon. Entries are beginnings of folded words; they and their weights are learned from
labelled documents. Exception phrases, given or learned, void the entries inside them. A document's score is a
logistic function of its entries' weight for its length, fitted on the labelled documents.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, held_out, record, sample, small, struct_udf, tidied

#: Letters of other scripts that look like Latin ones.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ɡ": "g", "һ": "h", "ӏ": "l", "ԛ": "q", "ԝ": "w", "п": "n", "г": "r", "ь": "b",
    "α": "a", "β": "b", "γ": "y", "ε": "e", "η": "n", "ι": "i", "κ": "k", "μ": "u", "ν": "v", "ο": "o", "ρ": "p", "σ": "o", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
    "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ħ": "h", "ŧ": "t", "ɑ": "a", "ɩ": "i", "ʟ": "l", "ɴ": "n", "ʀ": "r", "ꜱ": "s",
}
#: Digits and symbols that stand for letters; l and i share a form, since 1 and | stand for both.
SUBSTITUTES = {"0": "o", "1": "i", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i", "+": "t", "l": "i"}
#: Phrases in which the lexicon's words harm nobody; more are learned, and callers may give their own.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "trash collection", "clown fish", "circus clown", "pond scum", "soap scum", "idiot proof", "sore loser", "loser bracket")

#: Characters that a word may hold unseen: combining marks, soft hyphens and zero-width characters.
UNSEEN = [chr(c) for c in (*range(0x300, 0x370), 0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)]
LETTERS = str.maketrans({**HOMOGLYPHS, **{c: None for c in UNSEEN}})
INNER = str.maketrans(SUBSTITUTES)
WORD = re.compile(rf"[\w@$!|+{''.join(UNSEEN)}]+")
STRETCHED = re.compile(r"(.)\1\1+")


def fold_word(word: str) -> tuple[str, ...]:
    """The forms in which a word's parts between underscores are compared; parts without a letter leave nothing.

    Symbols at an end are punctuation, but for one @ or $ before a letter.
    """
    if not word.isascii():
        word = unicodedata.normalize("NFKD", word.translate(LETTERS)).translate(LETTERS)
    out = []
    for part in word.split("_"):
        part = part.rstrip("!|+@$").lstrip("!|+")
        if part[:2] in ("@@", "$$", "@$", "$@"):
            part = part.lstrip("@$!|+")
        if any(c.isalpha() for c in part):
            out.append(STRETCHED.sub(r"\1", part.translate(INNER)))
    return tuple(out)


class Folder:
    """Folds whole texts, with a bounded table of words that it has folded."""

    def __init__(self, most: int = 200_000):
        self.seen, self.most = {}, most

    def __call__(self, text: str | None) -> list[str]:
        """The folded words, in order."""
        out, seen = [], self.seen
        for w in WORD.findall((text or "").lower()):
            f = seen.get(w)
            if f is None:
                if len(seen) >= self.most:
                    seen.clear()
                f = seen[w] = fold_word(w)
            out += f
        return out


class Lexicon:
    """An automaton over weighted beginnings of words and exception phrases."""

    def __init__(self, weights: dict[str, float], exceptions=()):
        fold = Folder()
        self.weights, self.exceptions, self.automaton = weights, tuple(exceptions), ahocorasick.Automaton()
        for stem, w in weights.items():
            self.automaton.add_word(" " + stem, (len(stem) + 1, w, stem))
        for phrase in exceptions:
            folded = " " + " ".join(fold(phrase)) + " "
            if folded.strip():
                self.automaton.add_word(folded, (len(folded), 0.0, None))
        if len(self.automaton):
            self.automaton.make_automaton()

    def __reduce__(self):
        return Lexicon, (self.weights, self.exceptions)

    def hits(self, words: list[str]) -> list[tuple[int, float, str]]:
        """(begin, weight, entry) of the entries found outside of exception phrases, one a word at most."""
        if not len(self.automaton):
            return []
        found, spans = {}, []
        for end, (size, w, stem) in self.automaton.iter(" " + " ".join(words) + " "):
            begin = end - size + 1
            if stem is None:
                spans.append((begin, end))
            elif begin not in found or found[begin][0] < size:
                found[begin] = (size, w, stem)
        return [(b, w, stem) for b, (_, w, stem) in sorted(found.items()) if not any(lo <= b < hi for lo, hi in spans)]

    def weigh(self, words: list[str]) -> tuple[float, int, int]:
        """(summed weight, entries found, words)."""
        found = self.hits(words)
        return sum(w for _, w, _ in found), len(found), len(words)


def features(weight: np.ndarray, hits: np.ndarray, words: np.ndarray) -> np.ndarray:
    """What the score is made of: the weight for the text's length, the number of entries, and the length."""
    rate = weight / np.maximum(words, 20)
    return np.stack([np.ones(len(weight)), np.log1p(100 * rate), np.minimum(100 * rate, 5), np.log1p(hits), np.log1p(words) / 5, hits > 0], axis=1)


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-2, steps: int = 60) -> np.ndarray:
    """Weighted ridge regression by Newton steps."""
    b = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (w * (p - y)) + ridge * b
        h = (x * (w * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge * np.eye(len(b))
        step = np.linalg.solve(h, g)
        b = b - step
        if np.abs(step).max() < 1e-8:
            break
    return b


def shape(words: list[str], size: int = 3) -> int:
    """The least hash of the text's word shingles: near copies mostly share it, so that a group of them counts as one."""
    joined = [" ".join(words[k : k + size]) for k in range(max(1, len(words) - size + 1))]
    return min(xxhash.xxh64_intdigest(j.encode(), 7) for j in joined) - (1 << 63)


def stems(word: str, least: int = 4, most: int = 10) -> list[str]:
    """Beginnings of a word that may become entries; a shorter word only as a whole, with the space behind it."""
    return [word[:k] for k in range(least, min(len(word), most) + 1)] if len(word) >= least else [word + " "]


def labelled(docs: DataFrame, labels: DataFrame, per_class: int) -> DataFrame:
    """(text, y, w): labelled training texts, at most about `per_class` of each label, and how many rows each stands for.

    Rows whose crc32 of the id leaves 1 modulo 3 are kept back. An id that has both labels has none; of rows that share
    an id one counts, and of texts of one shape and label. Neither the id nor the label goes into a text.
    """
    known = labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out("doc_id", 3, 1)).groupBy("doc_id").agg(F.min("toxic").alias("y"), F.max("toxic").alias("_y")).where("y = _y").drop("_y")
    n = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    picked = None
    for y in n:
        one = sample(known.where(F.col("y") == y), per_class, "doc_id").withColumn("w", F.lit(max(1.0, n[y] / per_class)))
        picked = one if picked is None else picked.unionByName(one)
    if picked is None:
        return docs.sparkSession.createDataFrame([], "text string, y int, w double")
    picked = picked.select(F.col("doc_id").alias("_id"), F.col("y").cast("int").alias("y"), "w")
    fold = Folder()

    def shaped(texts: pa.Array):
        return [np.array([shape(fold(t)) for t in texts.to_pylist()], np.int64)]

    joined = docs.select("doc_id", "text").join(small(picked, 4 * per_class + 1000), F.col("doc_id") == F.col("_id")).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "y", "w")
    joined = cut(joined.withColumn("_s", struct_udf("shape long", shaped)(F.col("text"))).select("doc_id", "text", "y", "w", F.col("_s.shape").alias("shape")))
    # the least of each shape, told by a hash, so that texts aren't shuffled
    joined = joined.withColumn("_h", F.xxhash64("doc_id", "text"))
    # and one text of each id, so that the rows are as few as the ids that were picked
    one = joined.groupBy("doc_id").agg(F.min("_h").alias("_one")).select(F.col("doc_id").alias("_id1"), "_one")
    joined = joined.join(small(one, 4 * per_class + 1000), (F.col("doc_id") == F.col("_id1")) & (F.col("_h") == F.col("_one")), "left_semi")
    chosen = joined.groupBy("shape", "y").agg(F.min("_h").alias("_h")).select(F.col("_h").alias("_c"), F.col("shape").alias("_sc"), F.col("y").alias("_yc"))
    same = (F.col("_h") == F.col("_c")) & (F.col("shape") == F.col("_sc")) & (F.col("y") == F.col("_yc"))
    return joined.join(small(chosen, 4 * per_class + 1000), same, "left_semi").dropDuplicates(["_h", "shape", "y"]).select("text", "y", "w")


def likelihood_ratio(pos: float, neg: float, positives: float, negatives: float) -> float:
    """Twice the log-likelihood ratio of an event's shares in two groups being different."""
    share = (pos + neg) / (positives + negatives)
    if not 0 < share < 1:
        return 0.0
    part = lambda x, n: x * np.log(max(x, 1e-12) / (n * share)) + (n - x) * np.log(max(n - x, 1e-12) / (n * (1 - share)))
    return float(2 * (part(pos, positives) + part(neg, negatives)))


def choose(counts: list, positives: float, negatives: float, entries: int, least: int, odds: float, ratio: float = 20.0) -> dict[str, float]:
    """The lexicon from (stem, pos, neg, pos2, neg2, pos_rate, neg_rate).

    The counts are of texts that hold a stem, and that hold it twice or more, the rates are occurrences a word.
    Stems are taken by falling log-likelihood ratio, the greater of both counts', of equal ones the longest, and no
    entry begins with another.
    """
    rows = []
    for stem, pos, neg, pos2, neg2, pos_rate, neg_rate in counts:
        weight = np.log((pos_rate / positives + 1e-5) / (neg_rate / negatives + 1e-5))
        if pos < least or pos / positives <= neg / negatives or weight < odds:
            continue
        evidence = max(likelihood_ratio(pos, neg, positives, negatives), likelihood_ratio(pos2, neg2, positives, negatives) if pos2 / positives > neg2 / negatives else 0.0)
        if evidence > ratio:
            rows.append((evidence, len(stem), stem, float(weight)))
    out: dict[str, float] = {}
    below: set[str] = set()  # all beginnings of entries
    for _, _, stem, w in sorted(rows, key=lambda r: (-round(r[0], 6), -r[1], r[2])):
        if len(out) >= entries:
            break
        if stem in below or any(stem[:k] in out for k in range(1, len(stem))):
            continue
        out[stem] = w
        below |= {stem[:k] for k in range(1, len(stem) + 1)}
    return out


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 6000, entries: int = 4000, least: int = 5, odds: float = 1.5, exceptions=EXCEPTIONS) -> tuple[Lexicon, np.ndarray]:
    """The lexicon and the score's coefficients from about `per_class` labelled texts of each label at most.

    What goes to the driver is bounded by `per_class` rows of numbers, and by 50,000 stems. Without texts of both
    labels the lexicon is empty and the score is the share of toxic labels, or a half without labels.
    """
    rows = cut(labelled(docs, labels, per_class))
    n = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    if len(n) < 2:
        return Lexicon({}), np.array([4.0 if n.get(1) else -4.0 if n else 0.0, 0, 0, 0, 0, 0])

    schema = "stem string, pos double, neg double, pos2 double, neg2 double, pos_rate double, neg_rate double"

    def count(batches):
        fold, found = Folder(), {}
        for b in batches:
            for text, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist()):
                words = fold(text)
                rate = 1 / max(20, len(words))
                times = Counter()
                for w, c in Counter(words).items():
                    for s in stems(w):
                        times[s] += c
                for s, c in times.items():
                    x = found.setdefault(s, [0, 0, 0, 0, 0.0, 0.0])
                    x[1 - y] += 1
                    x[3 - y] += c > 1
                    x[5 - y] += c * rate
        keys = list(found)
        values = np.array([found[s] for s in keys], float).reshape(-1, 6)
        for k in range(0, len(keys), 100_000):
            yield record(schema, [keys[k : k + 100_000], *values[k : k + 100_000].T])

    counts = rows.mapInArrow(tidied(count), schema).groupBy("stem").agg(*[F.sum(c).alias(c) for c in ("pos", "neg", "pos2", "neg2", "pos_rate", "neg_rate")])
    likely = counts.where(F.col("pos") >= least).where(F.col("pos_rate") / n[1] + 1e-5 >= np.exp(odds) * (F.col("neg_rate") / n[0] + 1e-5)).orderBy(F.col("pos").desc(), "stem").limit(50_000)
    weights = choose([tuple(r) for r in likely.collect()], n[1], n[0], entries, least, odds)
    lexicon = Lexicon(weights, exceptions)

    def phrases(batches):
        fold, found = Folder(), Counter()
        for b in batches:
            for text, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist()):
                words = fold(text)
                starts = {}
                at = 0
                for k, w in enumerate(words):
                    starts[at] = k
                    at += len(w) + 1
                mine = {" ".join(words[max(0, j) : j + 2]) for b0, _, _ in lexicon.hits(words) for j in (starts[b0] - 1, starts[b0]) if 0 <= j < len(words) - 1}
                found.update((p, y) for p in mine)
        keys = list(found)
        yield record("phrase string, y int, n long", [[k[0] for k in keys], [k[1] for k in keys], [found[k] for k in keys]])

    both = rows.mapInArrow(tidied(phrases), "phrase string, y int, n long").groupBy("phrase").agg(F.sum(F.expr("if(y = 1, n, 0)")).alias("pos"), F.sum(F.expr("if(y = 0, n, 0)")).alias("neg"))
    clean = both.where(F.col("neg") >= least).where(F.col("neg") / n[0] > 2 * F.col("pos") / n[1]).orderBy(F.col("neg").desc(), "phrase").limit(1000)
    lexicon = Lexicon(weights, [*exceptions, *[r.phrase for r in clean.collect()]])
    weigh = weighing(lexicon)
    got = rows.withColumn("_t", weigh(F.col("text"))).select("y", "w", "_t.*").toPandas()
    x = features(*(got[c].to_numpy(float) for c in ("weight", "hits", "words")))
    return lexicon, logistic(x, got.y.to_numpy(float), got.w.to_numpy(float))


def weighing(lexicon: Lexicon):
    """UDF from a text to (weight, hits, words)."""
    fold = Folder()

    def run(texts: pa.Array):
        got = [lexicon.weigh(fold(t)) for t in texts.to_pylist()]
        return [np.array([g[k] for g in got], kind) for k, kind in enumerate((float, np.int64, np.int64))]

    return struct_udf("weight double, hits long, words long", run)


def with_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **how) -> DataFrame:
    """docs with _quarry_t: weight, hits, words, score (0 to 1) and predicted (1 if score >= threshold, else 0).

    Whole texts are scored, and nothing but the text goes into a score. Null and empty texts have no words and get
    the score of a text without entries; repeated rows fare alike; other columns are carried along; an empty table
    stays empty. Without labels of both classes see fit().
    """
    lexicon, b = fit(docs, labels, **how)
    got = docs.withColumn("_quarry_t", weighing(lexicon)(F.col("text")))
    t = lambda c: F.col(f"_quarry_t.{c}")
    rate = t("weight") / F.greatest(t("words"), F.lit(20))
    parts = [F.lit(1.0), F.log1p(100 * rate), F.least(100 * rate, F.lit(5.0)), F.log1p(t("hits")), F.log1p(t("words")) / 5, (t("hits") > 0).cast("double")]
    z = sum((float(c) * p for c, p in zip(b, parts)), F.lit(0.0))
    score = 1 / (1 + F.exp(-z))
    return got.withColumn("_quarry_t", F.col("_quarry_t").withField("score", score)).withColumn("_quarry_t", F.col("_quarry_t").withField("predicted", (t("score") >= threshold).cast("int")))


def toxicity(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """(doc_id, held_out, score, predicted, hits) of every row of docs."""
    return with_toxicity(docs, labels, **how).select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "_quarry_t.score", "_quarry_t.predicted", "_quarry_t.hits")
