"""Every catalogue query agrees with its SQL."""

import duckdb
import pandas as pd
import pytest

from quarry.catalog import ORACLE, QUERIES
from quarry.sources.tables import TABLES

SF = "/root/testdata/sf0.001"


def canonical(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]
    return sorted(tuple("" if pd.isna(v) else f"{float(v):.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in row) for row in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(ORACLE[name]).df()
    got = QUERIES[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_ppr_is_over_all_lines(spark):
    """The route ranks the chunks of the whole table, as a walk over all its lines does."""
    from collections import defaultdict

    from quarry.operators.relations import pagerank

    lines = pd.read_parquet(f"{SF}/lineitem.parquet")
    weight, near = defaultdict(float), {1: 0, 2: 0}
    for s, d, w in zip(lines.l_partkey, lines.l_suppkey * 7 % 60, lines.l_quantity):
        weight[s, d] += float(w)
        weight[d, s] += float(w)
    for hop in (1, 2):
        for d in {d for s, d in weight if s in near}:
            near.setdefault(d, hop)
    names = sorted(near.items(), key=lambda x: (x[1], x[0]))[:200]
    at = {e: k for k, (e, _) in enumerate(names)}
    rank, _ = pagerank(len(names), [(at[s], at[d], w) for (s, d), w in weight.items() if s in at and d in at], [{0: 1.0, 1: 0.8}.get(h, 0.0) for _, h in names])
    want = defaultdict(float)
    for chunk, e in zip(lines.l_orderkey, lines.l_partkey):
        if e in at:
            want[chunk] += float(rank[at[e]])
    got = [(r.chunk, r.score) for r in QUERIES["ppr_top_chunks"](spark, SF).collect()]
    assert len(got) == 10 and all(abs(want[c] - s) < 1e-6 for c, s in got)
    assert abs(got[0][1] - max(want.values())) < 1e-6
