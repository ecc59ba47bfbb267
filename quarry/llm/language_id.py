"""Language identification by interpolated Kneser-Ney character models."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, reuse_memory, struct_udf

SPACE_ID, OTHER = 0, 1


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points in a row, and each text's number of them."""
    raw = "".join(texts).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(raw, np.uint32), np.fromiter(map(len, texts), np.int64, len(texts))


class Alphabet:
    """Maps code points, lower-cased, to ids: white space 0, those that no language was seen with 1, then every other."""

    def __init__(self, letters: str):
        self.letters = letters
        self.table = np.full(0x110000, OTHER, np.uint32)
        every = list(map(chr, range(0x110000)))
        self.letter = np.array([c.isalpha() for c in every])
        self.table[[c.isspace() for c in every]] = SPACE_ID
        for k, c in enumerate(letters):
            self.table[ord(c)] = k + 2
            for up in (c.upper(), c.title()):
                if len(up) == 1 and up not in letters:
                    self.table[ord(up)] = k + 2

    @property
    def size(self) -> int:
        return len(self.letters) + 2

    @staticmethod
    def of(texts: list[str]) -> Alphabet:
        cps, _ = code_points([t.lower() for t in texts])
        return Alphabet("".join(c for c in map(chr, np.unique(cps).tolist()) if not c.isspace()))


class Grams:
    """Hashes of the grams that end at each character of some texts, each text preceded by spaces.

    A gram's hash comes from its shorter gram's with one more character to the left, so gram[k] and its suffix
    gram[k - 1] stand at one place, and history[k], the k - 1 characters before the last, at the place before.
    Characters have all their bits in the hash, so the alphabet may be of any size.
    """

    def __init__(self, ids: np.ndarray, counts: np.ndarray, order: int):
        pad = order
        where = np.arange(len(ids)) + pad * (1 + np.repeat(np.arange(len(counts)), counts))
        x = np.zeros(len(ids) + pad * len(counts), np.uint64)
        x[where] = ids
        self.starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
        h = np.zeros(len(x), np.uint64)
        self.gram, self.history = [h[where]], [h[where]]
        for k in range(order):
            self.history.append(h[where - 1])
            left = np.concatenate([np.zeros(k, np.uint64), x[: len(x) - k]])
            h = (h + left + np.uint64(0x51_7C_C1_B7 * (k + 1))) * np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(32)
            self.gram.append(h[where])


class KneserNey:
    """Models of all languages over one alphabet: sorted hash arrays of n-grams and contexts, a column a language."""

    def __init__(self, order: int, languages: list[str], letters: str):
        self.order, self.languages, self.letters = order, languages, letters
        self.gram: list[tuple[np.ndarray, np.ndarray]] = []
        self.context: list[tuple[np.ndarray, np.ndarray]] = []

    @staticmethod
    def table(parts: list[tuple[np.ndarray, np.ndarray]], default: float) -> tuple[np.ndarray, np.ndarray]:
        keys = np.unique(np.concatenate([k for k, _ in parts]))
        values = np.full((len(keys), len(parts)), default, np.float32)
        for j, (k, v) in enumerate(parts):
            values[np.searchsorted(keys, k), j] = v
        return keys, values

    @classmethod
    def fit(cls, texts: dict[str, list[str]], order: int) -> KneserNey:
        alphabet = Alphabet.of([t for v in texts.values() for t in v])
        model = cls(order, sorted(texts), alphabet.letters)
        grams_of, contexts_of = [[] for _ in range(order)], [[] for _ in range(order)]
        for lang in model.languages:
            cps, n = code_points(texts[lang])
            g = Grams(alphabet.table[cps], n, order)
            at = np.arange(len(cps))
            for k in range(order, 0, -1):
                # below the highest order counts are of distinct one-character extensions to the left
                keys, first, count = np.unique(g.gram[k][at], return_index=True, return_counts=True)
                at = at[first]
                ones, twos = (count == 1).sum(), (count == 2).sum()
                discount = ones / max(1, ones + 2 * twos) if ones else 0.5
                history, of = np.unique(g.history[k][at], return_inverse=True)
                total, kinds = np.bincount(of, count), np.bincount(of)
                grams_of[k - 1].append((keys, (np.maximum(count - discount, 0) / total[of]).astype(np.float32)))
                contexts_of[k - 1].append((history, (discount * kinds / total).astype(np.float32)))
        model.gram = [cls.table(p, 0.0) for p in grams_of]
        model.context = [cls.table(p, 1.0) for p in contexts_of]
        return model

    @staticmethod
    def find(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray, default: float) -> np.ndarray:
        hashes, values = table
        at = np.minimum(np.searchsorted(hashes, keys), len(hashes) - 1)
        return np.where((hashes[at] == keys)[:, None], values[at], np.float32(default))

    def log2(self, g: Grams, at: np.ndarray) -> np.ndarray:
        """log2 P of the characters at some places, a column a language."""
        p = np.full((len(at), len(self.languages)), 1 / (len(self.letters) + 2), np.float32)
        for k in range(1, self.order + 1):
            p = self.find(self.gram[k - 1], g.gram[k][at], 0.0) + self.find(self.context[k - 1], g.history[k][at], 1.0) * p
        return np.log2(p)

    def entropies(self, alphabet: Alphabet, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bits a character by language, the number of characters, and whether there is a letter, of each text."""
        cps, n = code_points(texts)
        out, letter = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), bool)
        some = np.flatnonzero(n)
        if not len(some):
            return out, n, letter
        g = Grams(alphabet.table[cps], n, self.order)
        _, first, which = np.unique(g.gram[self.order], return_index=True, return_inverse=True)
        bits = -self.log2(g, first)
        owner = g.starts[some]
        for j in range(len(self.languages)):
            out[some, j] = np.add.reduceat(bits[:, j][which], owner, dtype=np.float64) / n[some]
        letter[some] = np.logical_or.reduceat(alphabet.letter[cps], owner)
        return out, n, letter


def evidence(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best language, its lead over the second in bits (compressed), and its own bits a character."""
    best = h.argmin(1)
    own = h[np.arange(len(h)), best]
    second = np.partition(h, 1, axis=1)[:, 1] if h.shape[1] > 1 else own + 1
    return best, np.log1p((second - own) * np.maximum(n, 1)), own


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 60) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton steps; the last is the bias."""
    a = np.column_stack([x, np.ones(len(x))])
    w, pull = np.zeros(a.shape[1]), ridge * np.append(np.ones(a.shape[1] - 1), 1e-3)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) + pull * w
        step = np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + np.diag(pull + 1e-9), g)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def training_texts(docs: DataFrame, bound: int, chars: int, slice_chars: int = 1 << 18, total: int = 40_000_000) -> dict[str, list[str]]:
    """Texts by language, of at most about `bound` rows and `chars` characters each, chosen by a hash of the row.

    Of a longer text a slice of `slice_chars` at a place that the hash tells stands for it. All languages together have about
    `total` characters at most, so that what the driver holds doesn't grow with their number.
    """
    known = docs.where("text is not null and lang is not null and trim(text) <> ''")
    first = F.pmod(F.xxhash64(F.lit("slice"), "doc_id"), F.greatest(F.length("text") - slice_chars, F.lit(0)) + 1) + 1
    known = known.select("doc_id", "lang", F.when(F.length("text") > slice_chars, F.col("text").substr(first.cast("int"), F.lit(slice_chars))).otherwise(F.col("text")).alias("text"))
    held = known.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).collect()
    chars = min(chars, total // max(1, len(held)))
    n = {x.lang: max(x.n / bound, x.chars / chars) for x in held}
    if not n:
        return {}
    share = F.create_map(*[F.lit(v) for k, c in n.items() for v in (k, 1 / max(1.0, c))])
    rows = known.where(F.pmod(F.xxhash64(F.lit("lang"), "doc_id"), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20)).select("doc_id", "lang", "text").toPandas().sort_values(["lang", "doc_id", "text"])
    return {k: g.text.tolist() for k, g in rows.groupby("lang")}


def identify(docs: DataFrame, bound: int = 600, chars: int = 4_000_000, order: int = 5, lost: float = 0.002) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, accepted, bits) for every row of docs (doc_id, text, lang).

    The models learn from at most about `bound` texts and `chars` characters of each language, of long texts from a
    slice, among rows whose id's CRC-32 modulo 4 is not 2; one text in five of them is kept
    back to calibrate. lang_pred is the language with the least bits
    a character (ties: the first by name); `und` with score 0 if the text is null or has no letter, or if there
    is nothing to learn from. score is the calibrated probability that it is right, from the lead over the
    second language and the bits a character; its wrong cases are also the calibration texts as the other languages'
    models see them, so that a language nobody learned is rejected. Rows below a score that `lost` of the right
    calibration texts miss aren't accepted. Whole texts are scored; repeated rows get equal results; an empty table gives no rows.
    """
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    texts = training_texts(docs.where(~held_out("doc_id", 4)), bound, chars)
    out = docs.withColumn("held_out", held_out("doc_id", 4))
    if not texts:
        return out.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("accepted"), F.lit(None).cast("double").alias("bits"))
    fit = {k: [t for i, t in enumerate(v) if i % 5 or len(v) < 5] for k, v in texts.items()}
    model = KneserNey.fit(fit, order)
    alphabet = Alphabet(model.letters)
    # calibration sees whole texts and short pieces, since leads grow with length
    x, y = [], []
    for j, k in enumerate(model.languages):
        kept = [t for i, t in enumerate(texts[k]) if i % 5 == 0]
        pieces = [t[len(t) // 3 :][:m] for t in kept for m in (6, 12, 25, 60)] + kept
        h, n, letter = model.entropies(alphabet, pieces)
        best, lead, own = evidence(h, n)
        x.append(np.column_stack([lead, own])[letter])
        y.append((best == j)[letter])
        if len(model.languages) > 1:  # as if its own language were not learned
            _, lead, own = evidence(np.delete(h, j, 1), n)
            x.append(np.column_stack([lead, own])[letter])
            y.append(np.zeros(letter.sum(), bool))
    x, y = np.concatenate(x), np.concatenate(y).astype(float)
    weights = logistic(x, y) if 0 < y.mean() < 1 else np.array([0.0, 0.0, 6.0])
    p = 1 / (1 + np.exp(-(np.column_stack([x, np.ones(len(x))]) @ weights)))
    least = float(np.quantile(p[y > 0], lost)) if y.any() else 0.0
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(col: pa.Array):
        reuse_memory()
        model = shared.value
        if not hasattr(model, "alphabet"):
            model.alphabet = Alphabet(model.letters)
        values = [t or "" for t in col.to_pylist()]
        langs, scores, bits, k = [], [], [], 0
        while k < len(values):
            stop, chars = k, 0
            while stop < len(values) and chars < 3_000_000:
                chars += len(values[stop])
                stop += 1
            h, n, letter = model.entropies(model.alphabet, values[k:stop])
            best, lead, own = evidence(h, n)
            s = 1 / (1 + np.exp(-np.clip(weights[0] * lead + weights[1] * own + weights[2], -40, 40)))
            langs += [model.languages[b] if ok else "und" for b, ok in zip(best, letter)]
            scores += np.where(letter, s, 0.0).tolist()
            bits += [float(b) if ok else None for b, ok in zip(own, letter)]
            k = stop
        return [langs, scores, bits]

    r = struct_udf("lang_pred string, score double, bits double", run)
    return out.withColumn("r", r("text")).select("doc_id", "held_out", "r.lang_pred", "r.score", (F.col("r.score") >= max(least, 1e-300)).alias("accepted"), "r.bits")
