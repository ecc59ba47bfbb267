"""Quality rules and the quality classifier on made tables."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import cotraining, quality_rules

X = list(quality_rules.FEATURES)
FLOOR = np.diag([v * v for v in quality_rules.FEATURES.values()])


def groups(seed, n, bad):
    rng = np.random.default_rng(seed)
    rows = {}
    for g in range(6):
        x = rng.standard_normal((n, 6)) @ (np.eye(6) + 0.5 * rng.standard_normal((6, 6))) * 0.5
        x[:bad] += 12 * (1 if g % 2 else -1) + 0.1 * rng.standard_normal((bad, 6))
        rows[f"g{g}"] = x
    return rows


def estimates(spark, rows, share):
    df = spark.createDataFrame([(g, *map(float, v)) for g, x in rows.items() for v in x], "g string, " + ", ".join(f"{c} double" for c in X))
    return {r.g: (np.array(r["mean"]), np.array(r.scatter).reshape(6, 6)) for r in quality_rules.mcd(df, ["g"], share, 12).collect()}


def test_mcd_brute_force(spark):
    """The least determinant over all subsets of small groups, up to the median's scale."""
    rows = groups(3, 13, 3)
    got = estimates(spark, rows, 10 / 13)
    for g, x in rows.items():
        best = min(itertools.combinations(range(13), 10), key=lambda k: np.linalg.det(np.cov(x[list(k)].T, bias=True) + FLOOR))
        mean, cov = x[list(best)].mean(0), np.cov(x[list(best)].T, bias=True) + FLOOR
        d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
        scale = max(np.sort(d)[6] / quality_rules.chi2(6, 0.0), 1e-9)
        assert np.allclose(got[g][0], mean, atol=1e-8) and np.allclose(got[g][1], cov * scale, rtol=1e-6)
        assert set(range(3)).isdisjoint(best)


def test_mcd_resists_a_cluster_of_outliers(spark):
    for g, (mean, scatter) in estimates(spark, rows := groups(4, 400, 90), 0.75).items():
        x = rows[g]
        d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(scatter), x - mean)
        assert d[:90].min() > quality_rules.chi2(6, 6.0) and np.mean(d[90:] < quality_rules.chi2(6, 6.0)) > 0.99


def test_sources_do_not_collide():
    names = [f"s{k}" for k in range(500) for _ in range(3)]
    meta = cotraining.Metadata([*names, "rare", None], ["en"] * len(names))
    assert len({meta.view(s, "en", 5).tobytes() for s in names}) == 500
    assert meta.view("rare", "en", 5).tobytes() == meta.view("never seen", "en", 5).tobytes() != meta.view(None, "en", 5).tobytes()


def test_pseudo_labels_are_of_all_scores(spark):
    """The surest rows are those of the whole table, as sorting it gives them."""
    rng = np.random.default_rng(2)
    p = rng.random(5000)
    df = spark.createDataFrame([(k, float(v)) for k, v in enumerate(p)], "doc_id long, p0 double").repartition(8)
    got = {r.doc_id: r.label for r in cotraining.surest(df, "p0", 0.75, 0.1, 0.5).collect()}
    order = np.argsort(p)
    assert {k for k, v in got.items() if v == 0} == set(order[:125].tolist()) and abs(sum(got.values()) - 375) <= 1
    assert not [k for k in cotraining.surest(df, "p0", 0.75, 0.1, 0.999).collect() if 0.001 < p[k.doc_id] < 0.999]
    assert cotraining.surest(df.limit(0), "p0", 0.75, 0.1, 0.5).count() == 0


@pytest.mark.parametrize("informed", [0, 1])
def test_one_view_teaches_the_other(spark, informed):
    """Few labelled rows, many others: pseudo-labels of the view that knows reach the one that doesn't."""
    rng = np.random.default_rng(6)
    good = rng.random(1500) < 0.5
    words = np.array([f"w{k}" for k in range(400)])
    text = [" ".join(rng.choice(words, 80)) if g else "## $$ %% buy!! " * 20 for g in good]
    docs = spark.createDataFrame([(k, t, ("site" if g else "spam") if rng.random() < 0.9 else "other", "en", len(t)) for k, (t, g) in enumerate(zip(text, good))], "doc_id long, text string, source string, lang string, n_chars long")
    labels = spark.createDataFrame([(k, int(good[k])) for k in range(60)], "doc_id long, quality int")
    r = cotraining.with_quality(docs, labels).select("doc_id", "_quarry_q.*").toPandas().sort_values("doc_id")
    p = (r.p_text, r.p_meta)[informed]
    assert ((p > 0.5).to_numpy() == good)[60:].mean() > (0.98, 0.85)[informed] and (r.kept.to_numpy() == good)[60:].mean() > 0.95
