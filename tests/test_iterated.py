"""Descendants, cycles and exact percentiles against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import iterated as I


def plain_below(edges, roots):
    found = {i for i, _ in edges if i in roots}
    while more := {i for i, p in edges if p in found} - found:
        found |= more
    return found


@pytest.mark.parametrize("kind", ["chain", "forest", "cycles", "several"])
def test_descendants(spark, kind):
    rng = random.Random(kind)
    edges = {
        "chain": [(k, k - 1 if k else None) for k in range(300)],
        "forest": [(k, rng.randrange(k) if k % 7 and k else None) for k in range(400)] + [(5, None), (None, 3)],
        "cycles": [(k, (k + 1) % 40) for k in range(40)] + [(100 + k, rng.randrange(100 + k) if k % 3 else rng.randrange(40)) for k in range(200)] + [(7, 8)],
        "several": [(k, rng.randrange(60)) for k in range(60) for _ in range(2)],
    }[kind]
    if kind == "cycles":
        known = {i for i, _ in edges}
        edges = [(i, p if p in known else None) for i, p in edges]
    nodes = spark.createDataFrame(edges, "id int, parent int")
    for roots in ([3], [0, 120], [9999], [399, 7]):
        got = [r.id for r in I.descendants(nodes, F.col("id").isin(*roots)).collect()]
        assert len(got) == len(set(got)) and set(got) == plain_below([e for e in edges if e[0] is not None], set(roots))


def test_cyclic(spark):
    edges = [(0, 1), (1, 2), (2, 0), (3, 0), (4, 3), (5, 5), (6, None), (7, 6), (8, 99), (None, 1), (9, 8)]
    assert {r.id for r in I.cyclic(spark.createDataFrame(edges, "id int, parent int")).collect()} == {0, 1, 2, 5}
    assert I.cyclic(spark.createDataFrame([(k, k - 1 if k else None) for k in range(70)], "id int, parent int")).count() == 0


@pytest.mark.parametrize("most, parts", [(10_000, 256), (60, 32)])
def test_exact_percentiles(spark, most, parts):
    rng = np.random.default_rng(1)
    groups = {
        "hot": rng.lognormal(0, 3, 6_000), "ties": np.concatenate([np.full(3000, 7.0), rng.normal(7, 1, 500)]), "few": rng.integers(0, 3, 900).astype(float), "one": np.array([4.5]), "two": np.array([1.0, 2.0]),
        "same": np.full(700, -3.25), "wide": np.concatenate([rng.normal(0, 1e-9, 400), rng.normal(1e12, 1e3, 300), [-1e300, 1e300]]), None: rng.normal(0, 1, 333),
    }
    rows = [(k, float(x)) for k, v in groups.items() for x in v] + [("hot", None), ("empty", None)]
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    fractions = [0.0, 0.5, 0.999]
    got = {(r.g, r.p): r.value for r in I.exact_percentiles(df, ["g"], "x", fractions, most, parts).collect()}
    assert len(got) == len(groups) * len(fractions)
    for g, v in groups.items():
        for p in fractions:
            assert got[g, p] == pytest.approx(np.quantile(v, p), rel=1e-12, abs=1e-12), (g, p)


def test_no_values(spark):
    assert I.exact_percentiles(spark.createDataFrame([("a", None)], "g string, x double"), ["g"], "x", [0.5]).count() == 0
