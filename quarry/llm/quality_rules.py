"""Quality rules: robust multivariate outliers by minimum-covariance-determinant estimates."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, as_bytes, cut, small, struct_udf

#: The transformed statistics of a text, and the least standard deviation that each is given.
FEATURES = {"x_words": 0.15, "x_length": 0.25, "x_symbols": 0.08, "x_lines": 0.12, "x_repeats": 0.12, "x_upper": 0.08}
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, " + ", ".join(f"{x} double" for x in FEATURES)


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    h = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    key = h[:-2] * np.uint64(0x9E3779B97F4A7C15) + (h[1:-1] ^ (h[1:-1] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + (h[2:] ^ (h[2:] >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    at = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[at + k] = True
    return int(covered.sum())


def text_stats(b: bytes) -> tuple:
    words = b.split()
    n = len(words)
    body = b.translate(None, SPACE)
    chars = len(body.decode("utf-8", "replace"))
    symbols = len(b) - len(b.translate(None, b"#*$%&|<>"))
    lines = [x for x in b.split(b"\n") if x.split(None, 1)]
    dup, rep = len(lines) - len(set(lines)), repeat_words(words)
    upper = len(body) - len(body.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    some = max(1, n)
    return n, chars, symbols, dup, rep, math.log1p(n), math.sqrt(chars / some), math.sqrt(symbols / max(1, chars)), math.sqrt(dup / max(1, len(lines))), math.sqrt(rep / some), math.sqrt(upper / max(1, chars))


def with_stats(docs: DataFrame) -> DataFrame:
    udf = struct_udf(STATS, lambda texts: list(zip(*map(text_stats, as_bytes(texts)))) or [[]] * len(STATS.split(",")))
    return docs.withColumn("_s", udf("text"))


def chi2(p: int, z: float) -> float:
    """Chi-square quantile with p degrees of freedom at the normal quantile z (Wilson and Hilferty)."""
    return p * (1 - 2 / (9 * p) + z * math.sqrt(2 / (9 * p))) ** 3


def floored(flat: list) -> F.Column:
    """A flat covariance with the variance floors added."""
    p, least = len(FEATURES), [x * x for x in FEATURES.values()]
    return F.array(*[c + F.lit(least[k // p] if k // p == k % p else 0.0) for k, c in enumerate(flat)])


def inverse(covs: pa.Array) -> pa.Array:
    """Row-major inverse of each covariance, given as flat lists, and the log of its determinant behind it."""
    p, out = len(FEATURES), []
    for x in covs.to_pylist():
        m = np.array(x, float).reshape(p, p)
        out.append([*np.linalg.inv(m).ravel().tolist(), float(np.linalg.slogdet(m)[1])])
    return pa.array(out, pa.list_(pa.float64()))


def inverted(cov: str) -> F.Column:
    return F.arrow_udf(inverse, "array<double>")(cov)


def distance(mean: str = "mean", inv: str = "inv") -> F.Column:
    x, p = list(FEATURES), len(FEATURES)
    d = [F.col(c) - F.col(mean)[i] for i, c in enumerate(x)]
    terms = [(d[i] * d[j] * F.col(inv)[i * p + j]) * (1 if i == j else 2) for i in range(p) for j in range(i, p)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


PAIRS = [(i, j) for i in range(len(FEATURES)) for j in range(i, len(FEATURES))]


def moments(keep: F.Column | None = None) -> list[F.Column]:
    """Aggregates m0.. and c0_0.. of the features' means and covariances, of the rows to keep."""
    x = [F.when(keep, F.col(c)) if keep is not None else F.col(c) for c in FEATURES]
    return [F.avg(c).alias(f"m{i}") for i, c in enumerate(x)] + [F.covar_pop(x[i], x[j]).alias(f"c{i}_{j}") for i, j in PAIRS]


def estimate(start: F.Column, mean: str = "m", cov: str = "c") -> list[F.Column]:
    """Columns start, mean and cov (flat, with the floors) from the aggregates."""
    p = len(FEATURES)
    flat = [F.coalesce(F.col(f"{cov}{min(i, j)}_{max(i, j)}"), F.lit(0.0)) for i in range(p) for j in range(p)]
    return [start.alias("start"), F.array(*[F.col(f"{mean}{i}") for i in range(p)]).alias("mean"), floored(flat).alias("cov")]


def starts(stats: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, start, mean, cov): three robust first estimates of each group.

    0: medians and median absolute deviations; 1: the medians and the covariance of the directions from them;
    2: mean and covariance of the half of the rows nearest to the medians, deviations being the unit.
    """
    x = list(FEATURES)
    med = cut(stats.groupBy(*keys).agg(*[F.percentile_approx(c, 0.5, 1000).alias(f"m{i}") for i, c in enumerate(x)]))
    far = stats.join(small(med), keys).groupBy(*keys).agg(*[F.first(f"m{i}").alias(f"m{i}") for i in range(len(x))], *[F.percentile_approx(F.abs(F.col(c) - F.col(f"m{i}")), 0.5, 1000).alias(f"a{i}") for i, c in enumerate(x)])
    centre = cut(far.withColumns({f"s{i}": F.sqrt(F.pow(1.4826 * F.col(f"a{i}"), 2) + least * least) for i, least in enumerate(FEATURES.values())}))
    units = stats.join(small(centre), keys).withColumns({f"u{i}": (F.col(c) - F.col(f"m{i}")) / F.col(f"s{i}") for i, c in enumerate(x)})
    units = units.withColumn("u", sum((F.col(f"u{i}") * F.col(f"u{i}") for i in range(1, len(x))), F.col("u0") * F.col("u0")))
    edge = cut(units.groupBy(*keys).agg(F.percentile_approx("u", 0.5, 1000).alias("edge")))
    signs = [F.avg(F.when(F.col("u") > 0, F.col(f"u{i}") * F.col(f"u{j}") / F.col("u"))).alias(f"d{i}_{j}") for i, j in PAIRS]
    ball = cut(units.join(small(edge), keys).groupBy(*keys).agg(*[a.alias(f"b_{n}") for n, a in zip([f"m{i}" for i in range(len(x))] + [f"c{i}_{j}" for i, j in PAIRS], moments(F.col("u") <= F.col("edge")))], *signs))
    both = ball.join(centre, keys).withColumns({f"d{i}_{j}": F.col(f"d{i}_{j}") * F.col(f"s{i}") * F.col(f"s{j}") for i, j in PAIRS})
    both = both.withColumns({f"v{i}_{j}": F.pow(1.4826 * F.col(f"a{i}"), 2) if i == j else F.lit(0.0) for i, j in PAIRS})
    made = [F.struct(*estimate(F.lit(0), "m", "v")), F.struct(*estimate(F.lit(1), "m", "d")), F.struct(*estimate(F.lit(2), "b_m", "b_c"))]
    return both.select(*keys, F.explode(F.array(*made)).alias("e")).select(*keys, "e.*")


def mcd(stats: DataFrame, keys: list[str], share: float, steps: int, still: float = 1e-3) -> DataFrame:
    """Minimum-covariance-determinant estimate of each group: mean, scatter (flat, its scale multiplied in) and rows n.

    From each of the three starts concentration steps keep the `share` of the rows with the least distance and take
    their mean and covariance, until the log of the determinant falls by no more than `still`, or for `steps`
    steps; the start that ends with the least determinant gives the estimate. Each step is over all rows of the
    groups that still move, by aggregates that are combined before the shuffle.
    """
    own = [*keys, "start"]
    now = cut(starts(stats, keys).withColumn("inv", inverted("cov")).withColumn("det", F.lit(None).cast("double")))
    ends: list[DataFrame] = []
    for _ in range(steps):
        d = stats.join(small(now.select(*own, "mean", "inv", "det")), keys).withColumn("d2", distance())
        edge = cut(d.groupBy(*own).agg(F.percentile_approx("d2", share, 1000).alias("edge")))
        sums = d.join(small(edge), own).where("d2 <= edge").groupBy(*own).agg(*moments(), F.first("det").alias("before"))
        est = cut(sums.select(*keys, *estimate(F.col("start")), "before").withColumn("inv", inverted("cov")).withColumn("det", F.element_at("inv", -1)))
        moves = F.col("before").isNull() | (F.col("before") - F.col("det") > still)
        ends.append(est.where(~moves).drop("before"))
        now = est.where(moves).drop("before")
        if not now.head(1):
            break
    else:
        ends.append(now)
    every = ends[0]
    for e in ends[1:]:
        every = every.unionByName(e)
    best = cut(every.groupBy(*keys).agg(F.min_by(F.struct("mean", "cov", "inv"), F.struct("det", "start")).alias("e")).select(*keys, "e.*"))
    scale = stats.join(small(best), keys).groupBy(*keys).agg(F.greatest(F.percentile_approx(distance(), 0.5, 1000) / chi2(len(FEATURES), 0.0), F.lit(1e-9)).alias("scale"), F.count("*").alias("n"))
    return cut(best.join(scale, keys).select(*keys, "mean", F.transform("cov", lambda c: c * F.col("scale")).alias("scatter"), "n"))


def shrunk(groups: DataFrame, least: int) -> DataFrame:
    """groups has mean, scatter and n (null without rows) and the prior's p_mean and p_scatter: all by n / (n + least)."""
    w = F.col("n") / (F.col("n") + F.lit(least))
    for x in ("mean", "scatter"):
        groups = groups.withColumn(x, F.when(F.col("n").isNull(), F.col(f"p_{x}")).otherwise(F.zip_with(x, f"p_{x}", lambda a, b: w * a + (1 - w) * b)))
    return groups.drop("p_mean", "p_scatter", "n")


def estimates(base: DataFrame, share: float, steps: int, least: int) -> DataFrame:
    """(lang, source, mean, inv) of every group: its own estimate drawn to its language's, and that to the pooled one."""
    keys = ["level", "g_lang", "g_source"]
    passing = base.where("not base_failed").select("lang", "source", *FEATURES)
    levels = F.array(*[F.struct(F.lit(k).alias("level"), a.alias("g_lang"), b.alias("g_source")) for k, (a, b) in enumerate([(F.lit(""), F.lit("")), (F.col("lang"), F.lit("")), (F.col("lang"), F.col("source"))])])
    est = mcd(passing.select(F.explode(levels).alias("g"), *FEATURES).select("g.*", *FEATURES), keys, share, steps)
    prior = lambda df: df.withColumnsRenamed({"mean": "p_mean", "scatter": "p_scatter"})
    all_groups = cut(base.select("lang", "source").distinct())
    pooled = prior(est.where("level = 0").select("mean", "scatter"))
    own = est.where("level = 1").select(F.col("g_lang").alias("lang"), "mean", "scatter", "n")
    by_lang = prior(shrunk(all_groups.select("lang").distinct().join(own, "lang", "left").crossJoin(F.broadcast(pooled)), least))
    own = est.where("level = 2").select(F.col("g_lang").alias("lang"), F.col("g_source").alias("source"), "mean", "scatter", "n")
    by_group = shrunk(all_groups.join(by_lang, "lang").join(own, ["lang", "source"], "left"), least)
    return cut(by_group.select("lang", "source", "mean", inverted("scatter").alias("inv")))


def quality_rules(docs: DataFrame, least: int = 400, share: float = 0.75, steps: int = 12, z: float = 6.0) -> DataFrame:
    """Statistics, the two base rules and a Mahalanobis verdict for every row of docs (doc_id, text, lang, source).

    A group is a language and source. Its minimum-covariance-determinant location and scatter, scaled so that its median distance fits
    chi-square, come from its n rows that pass the base rules with the weight n / (n + least), for the rest from
    its language's, which are drawn to those of all rows alike. A row is rejected if its squared distance lies
    beyond the chi-square quantile at the normal quantile z, chosen by the rejections of good and bad rows. Null text counts as empty and fails the base rules; null lang or source is a
    group value of its own; repeated rows get one result each; an empty table gives no rows.
    """
    # behind a mark, so that null and the empty text are two groups
    marked = lambda c: F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n")).alias(c)
    base = with_stats(docs.select("doc_id", "text", marked("lang"), marked("source"))).select("doc_id", "lang", "source", "_s.*")
    base = base.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    base = cut(base)
    d2 = base.join(small(estimates(base, share, steps, least)), ["lang", "source"], "left").withColumn("distance", distance())
    return d2.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= chi2(len(FEATURES), z))).alias("kept"), "distance")
