"""Quality classifier by co-training a text view and a page-metadata view."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, cut, sample, struct_udf
from .language_id import logistic

#: Byte classes of the text view, one string a class; other ASCII, lead and continuation bytes follow.
CLASSES = ("aeiou", "bcdfghjklmnpqrstvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n", "#", "*", "$", "%", "&", "|", "<>", "!?", ".,;:", "\"'()")
N = len(CLASSES) + 3
TABLE = np.full(256, N - 3, np.uint16)
TABLE[128:192], TABLE[192:] = N - 1, N - 2
for _k, _c in enumerate(CLASSES):
    TABLE[np.frombuffer(_c.encode(), np.uint8)] = _k
TEXT = N * N + 4


def text_view(b: bytes) -> np.ndarray:
    """Square roots of byte-class bigram shares, the text's length, and its shares of repeated lines and words."""
    x = np.zeros(TEXT, np.float32)
    if len(b) < 2:
        return x
    c = TABLE[np.frombuffer(b, np.uint8)]
    x[: N * N] = np.sqrt(np.bincount(c[:-1] * np.uint16(N) + c[1:], minlength=N * N) / (len(b) - 1))
    words, lines = b.split(), [s for s in b.split(b"\n") if s]
    x[N * N] = np.log1p(len(words)) / 10
    x[N * N + 1] = 1 - len(set(lines)) / max(1, len(lines))
    x[N * N + 2] = len(set(words)) / max(1, len(words))
    x[N * N + 3] = len(b) / max(1, len(words)) / 10
    return x


class Metadata:
    """The metadata view: a column for each source and language with enough labelled rows, one for the others."""

    def __init__(self, sources: list, langs: list, least: int = 3):
        self.columns: dict[tuple, int] = {}
        for kind, values in (("source", sources), ("lang", langs)):
            for v in [None, *sorted(x for x, n in Counter(values).items() if n >= least and x is not None), "other"]:
                self.columns[kind, v if v != "other" else Ellipsis] = len(self.columns)
        self.width = len(self.columns) + 2

    def view(self, source: str | None, lang: str | None, n_chars: int | None) -> np.ndarray:
        x = np.zeros(self.width, np.float32)
        for key in (("source", source), ("lang", lang)):
            x[self.columns.get(key, self.columns[key[0], Ellipsis])] = 1
        x[-2] = np.log1p(max(0, n_chars or 0)) / 10
        x[-1] = n_chars is None
        return x


COLUMNS = ("text", "source", "lang", "n_chars")


def plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).cast("string").alias(c) for c in COLUMNS[:3]], F.col("n_chars").cast("long").alias("n_chars"))


def collected(rows: DataFrame, *more: str) -> tuple:
    """Text views, metadata rows and further columns of bounded ids; the texts themselves stay in the tasks.

    Of rows that share an id the least counts, so that the rows are bounded as well.
    """
    udf = struct_udf("view binary", lambda text: [[text_view(b).tobytes() for b in as_bytes(text)]])
    viewed = rows.select("doc_id", udf("text").alias("v"), "source", "lang", "n_chars", *more)
    got = viewed.groupBy("doc_id").agg(F.min(F.struct("v.view", "source", "lang", "n_chars", *more)).alias("r")).select("doc_id", "r.*").toPandas().sort_values("doc_id")
    meta = [(s, g, None if n != n or n is None else int(n)) for s, g, n in zip(got.source.where(got.source.notna(), None), got.lang.where(got.lang.notna(), None), got.n_chars)]
    return np.frombuffer(b"".join(got.view), np.float32).reshape(-1, TEXT).astype(np.float64), meta, got


def probability(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


class Model:
    """Weights of both views, and what makes one score of them; score() is of the views that it is trained for."""

    def __init__(self, meta: Metadata, weights: list[np.ndarray]):
        self.meta, self.weights = meta, weights
        self.calibration, self.combine, self.least = [np.array([1.0, 0.0])] * 2, np.array([0.5, 0.5, 0.0]), 0.0

    def each(self, x: list[np.ndarray]) -> list[np.ndarray]:
        return [probability(x[v], self.weights[v]) for v in (0, 1)]

    def score(self, x: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p = [probability(logit(q)[:, None], c) for q, c in zip(self.each(x), self.calibration)]
        return p[0], p[1], probability(np.column_stack([logit(q) for q in p]), self.combine)


def scored(model: Model, docs: DataFrame, schema: str, of):
    """An Arrow UDF over text, source, lang and n_chars that gives of(model, views), whole texts in blocks of rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(text: pa.Array, source: pa.Array, lang: pa.Array, n: pa.Array):
        model, out = shared.value, []
        body, meta = as_bytes(text), list(zip(source.to_pylist(), lang.to_pylist(), n.to_pylist()))
        for k in range(0, len(body), 2000):
            out.append(of(model, [np.stack([text_view(b) for b in body[k : k + 2000]]), np.stack([model.meta.view(*m) for m in meta[k : k + 2000]])]))
        return [np.concatenate(v) for v in zip(*out)] or [[] for _ in schema.split(",")]

    return struct_udf(schema, run)(*[F.col(c).cast("long" if c == "n_chars" else "string") for c in COLUMNS])


def surest(scores: DataFrame, view: str, prior: float, share: float, sure: float) -> DataFrame:
    """(doc_id, label) of the rows of all scores that a view is surest of: `share` of them, dealt by the prior."""
    cuts = scores.agg(F.percentile_approx(view, [share * (1 - prior), 1 - share * prior], 10_000).alias("q")).first().q
    if not cuts:
        return scores.select("doc_id", F.lit(0.0).alias("label")).limit(0)
    low, high = min(cuts[0], 1 - sure), max(cuts[1], sure)
    return scores.where((F.col(view) <= low) | (F.col(view) >= high)).select("doc_id", (F.col(view) >= high).cast("double").alias("label"))


def fit(docs: DataFrame, labels: DataFrame, bound: int = 6000, rounds: int = 3, share: float = 0.1, sure: float = 0.95, given: int = 3000, keep: float = 0.998, ridge: float = 1.0) -> Model | None:
    """The co-trained model; None if the labels don't hold both classes.

    The first fit is on at most about `bound` labelled rows; where a doc_id has several labels the least counts.
    In each round both views score every document without a label; the `share` that a view is surest of, at least
    as sure as `sure`, are pseudo-labelled rows for the other view, which is fitted anew on the labelled rows and
    at most about `given` pseudo-labelled ones a round. Of the labelled rows a quarter calibrates each view, and
    another quarter fits their combination and sets the score that `keep` of its good documents reach.
    """
    docs = plain(docs)
    known = cut(labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality")))
    text, meta, got = collected(docs.join(F.broadcast(sample(known, bound, "doc_id")), "doc_id"), "quality")
    if got.quality.nunique() < 2:
        return None
    y = (got.quality.to_numpy() > 0).astype(float)
    part = np.array([zlib.crc32(str(i).encode()) % 4 for i in got.doc_id])
    folds = [part > 1, part == 0, part == 1]
    if any(len(set(y[f])) < 2 for f in folds):
        folds = [np.ones(len(y), bool)] * 3
    view = Metadata([m[0] for m in meta], [m[1] for m in meta])
    x = [text, np.stack([view.view(*m) for m in meta]).astype(np.float64)]
    learn = [[v[folds[0]]] for v in x], [[y[folds[0]]], [y[folds[0]]]]
    model = Model(view, [logistic(v[folds[0]], y[folds[0]], ridge) for v in x])
    prior = float(y[folds[0]].mean())
    for r in range(rounds):
        scores = docs.where("doc_id is not null").select("doc_id", scored(model, docs, "p0 double, p1 double", Model.each).alias("p")).select("doc_id", "p.*")
        scores = cut(scores.join(known, "doc_id", "left_anti"))
        for v in (0, 1):
            picked = sample(cut(surest(scores, f"p{v}", prior, share, sure).dropDuplicates(["doc_id"])), given, "doc_id")
            text, meta, got = collected(docs.join(F.broadcast(picked), "doc_id"), "label")
            learn[0][1 - v].append(text if v else np.stack([view.view(*m) for m in meta] or [np.zeros(view.width)])[: len(meta)].astype(np.float64))
            learn[1][1 - v].append(got.label.to_numpy())
        model = Model(view, [logistic(np.concatenate(learn[0][v]), np.concatenate(learn[1][v]), ridge) for v in (0, 1)])
    calibrate, combine = folds[1:]
    model.calibration = [logistic(logit(p)[:, None], y[calibrate], 1e-2) for p in model.each([v[calibrate] for v in x])]
    p = model.score([v[combine] for v in x])
    model.combine = logistic(np.column_stack([logit(q) for q in p[:2]]), y[combine], 1e-2)
    good = model.score([v[combine] for v in x])[2][y[combine] > 0]
    model.least = min(0.5, float(np.quantile(good, 1 - keep)))
    return model


def with_quality(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """docs with struct _quarry_q: p_text, p_meta, score, kept, for every row of docs (text, source, lang, n_chars).

    Null text counts as empty, null metadata as a value of its own, and a source or language with few labelled
    rows as any other such; labels decide nothing but the fit. Without labels of both classes every row is kept,
    with null scores. Repeated rows get equal results; an empty table gives no rows.
    """
    model = fit(docs, labels, **options)
    if model is None:
        return docs.withColumn("_quarry_q", F.expr("struct(CAST(NULL AS DOUBLE) AS p_text, CAST(NULL AS DOUBLE) AS p_meta, CAST(NULL AS DOUBLE) AS score, true AS kept)"))

    def of(model, x):
        a, b, s = model.score(x)
        return a, b, s, s >= model.least

    return docs.withColumn("_quarry_q", scored(model, docs, "p_text double, p_meta double, score double, kept boolean", of))
