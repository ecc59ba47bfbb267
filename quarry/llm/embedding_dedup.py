"""Embedding near-duplicates: an exact metric range join over pivot cells.

Unit vectors with cosine >= c are at most r = sqrt(2 - 2c) apart. Every vector lives in the cell of its
nearest pivot. If x in cell i and y in cell j are within r, then d(x, p_j) <= d(x, p_i) + 2r, and x lies
within r of the plane halfway between p_i and p_j; x is copied to cell j as a guest only if both bounds allow
it, and only towards lower cells, so each pair meets in one cell. Cells join independently.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import array_udf, components, cut, forest, least_id, record, sample, tidied, tidy, with_class


def packed(v) -> bytes:
    """A vector's bytes behind a mark: f for floats that lose nothing of it, d for doubles. Equal vectors are equal bytes."""
    a = np.array(v, "<f8") + 0.0
    with np.errstate(over="ignore"):
        f = a.astype("<f4")
    return b"f" + f.tobytes() if np.array_equal(f.astype("<f8"), a) else b"d" + a.tobytes()


def usable(vectors: pa.Array) -> list[bytes | None]:
    """packed() of each vector that may link; else None."""
    out = []
    for v in vectors.to_pylist():
        a = np.array(v, "<f8") if v and None not in v else np.zeros(0)
        out.append(packed(a) if np.isfinite(a).all() and a.any() else None)
    return out


def dimension(raw: bytes) -> int:
    return (len(raw) - 1) // (4 if raw[:1] == b"f" else 8)


def unit(raw) -> np.ndarray:
    """Unit vectors, in double precision, of packed vectors of one length."""
    raw = list(raw)
    m = np.empty((len(raw), dimension(raw[0])))
    for mark, kind in ((b"f", "<f4"), (b"d", "<f8")):
        at = [k for k, x in enumerate(raw) if x[:1] == mark]
        if at:
            m[at] = np.frombuffer(b"".join([raw[k][1:] for k in at]), kind).reshape(len(at), -1)
    m /= np.abs(m).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    return m / np.sqrt((m * m).sum(1, keepdims=True))


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines in double precision; each depends on its own two vectors alone and not on their order."""
    return (a * b).sum(1)


def choose(sample: np.ndarray, k: int, spread: int = 1024) -> np.ndarray:
    """k pivots of a sample: up to `spread` each the farthest from those before it, then others as they come."""
    chosen, near = [0], sample @ sample[0]
    while len(chosen) < min(k, spread, len(sample)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, sample @ sample[chosen[-1]])
    taken = set(chosen)
    chosen += [i for i in range(len(sample)) if i not in taken][: max(0, k - len(chosen))]
    return sample[chosen]


def range_links(reps: DataFrame, cosine: float, cell: int = 16384, guests: int = 16384, most_pivots: int = 65536) -> DataFrame:
    """Rows (id, n, root): for a representative, the vectors it links with in one task, or an edge to a root.

    reps has rep (long), copies (long) and raw (binary, packed). There is a pivot for every `cell` vectors; they
    come from a sample of four times their number, 4,096 at least. What is broadcast is bounded by `most_pivots`
    vectors, beyond which cells grow. A cell's homes and guests are dealt out in blocks, and every block of homes
    meets every other block.
    """
    n = reps.count()
    r = np.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-6
    k = max(1, min(most_pivots, -(-n // cell)))
    got = [x.raw for x in sample(reps, max(4096, 4 * k), "rep").select("raw").collect()]
    if n < 2 or not got:
        return reps.select(F.col("rep").alias("id"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("root")).limit(0)
    pivots = {d: choose(unit([x for x in got if dimension(x) == d]), k) for d in {dimension(x) for x in got}}
    schema = "cell long, home boolean, rep long, copies long, raw binary"

    def deal(batches):
        for x in batches:
            raw, rep, copies = x.column("raw").to_pylist(), x.column("rep").to_numpy(), x.column("copies").to_numpy()
            size = np.array([dimension(v) for v in raw])
            for dim in np.unique(size):
                rows, p = np.flatnonzero(size == dim), pivots.get(int(dim))
                step = max(1, 4_000_000 // (1 if p is None else len(p)))
                for a in range(0, len(rows), step):
                    at = rows[a : a + step]
                    if p is None:  # a length that the sample has not seen: one cell
                        to, who, home = np.zeros(len(at), np.int64), at, np.ones(len(at), bool)
                    else:
                        d = np.sqrt(np.maximum(0, 2 - 2 * unit([raw[i] for i in at]) @ p.T))
                        own = d.argmin(1)
                        mine = d[np.arange(len(at)), own][:, None]
                        apart = np.sqrt(np.maximum(1e-12, 2 - 2 * p[own] @ p.T))
                        reach = (d <= mine + 2 * r + 1e-9) & (d * d - mine * mine <= 2 * apart * r + 1e-9) & (np.arange(len(p))[None] < own[:, None])
                        g = np.nonzero(reach)
                        to, who, home = np.concatenate([own, g[1]]), at[np.concatenate([np.arange(len(at)), g[0]])], np.concatenate([np.ones(len(at), bool), np.zeros(len(g[0]), bool)])
                    yield record(schema, [to * (1 << 20) + dim % (1 << 20), home, rep[who], copies[who], pa.array([raw[i] for i in who], pa.binary())])

    spread = cut(reps.select("rep", "copies", "raw").mapInArrow(tidied(deal), schema))
    count = spread.groupBy("cell").agg(F.count_if("home").alias("h"), F.count_if(~F.col("home")).alias("g"))
    plan = count.select("cell", F.greatest(F.lit(1), F.ceil(F.col("h") / cell)).alias("hb"), F.ceil(F.col("g") / guests).alias("gb"))
    placed = spread.join(plan, "cell").withColumn("k", F.pmod(F.xxhash64("rep"), F.when(F.col("home"), F.col("hb")).otherwise(F.greatest(F.col("gb"), F.lit(1)))))
    as_home = F.expr("concat(transform(sequence(k, hb + gb - 1), j -> struct(k AS i, j AS j, true AS home)), filter(transform(sequence(0L, k), j -> struct(j AS i, k AS j, false AS home)), x -> x.i < k))")
    as_guest = F.expr("transform(sequence(0L, hb - 1), j -> struct(j AS i, hb + k AS j, false AS home))")
    tasks = placed.select("cell", "rep", "copies", "raw", F.explode(F.when(F.col("home"), as_home).otherwise(as_guest)).alias("t")).select("cell", "t.i", "t.j", F.col("t.home").alias("home"), "rep", "copies", "raw")

    def join(key: tuple, t: pd.DataFrame) -> pd.DataFrame:
        rep, copies, home = t.rep.to_numpy(), t.copies.to_numpy(), t.home.to_numpy()
        u = unit(t.raw)
        f = u.astype(np.float32)
        h, g = np.flatnonzero(home), np.flatnonzero(~home)
        own_pairs = key[1] == key[2]
        other = h if own_pairs else g
        links, xs, ys = np.zeros(len(t), np.int64), [], []
        step = max(1, 4_000_000 // max(1, len(other)))
        for k in range(0, len(h), step):
            a, b = np.nonzero(f[h[k : k + step]] @ f[other].T >= np.float32(cosine - 1e-4))
            a, b = h[k + a], other[b]
            if own_pairs:
                a, b = a[rep[a] < rep[b]], b[rep[a] < rep[b]]
            ok = dots(u[a], u[b]) >= cosine
            a, b = a[ok], b[ok]
            np.add.at(links, a, copies[b])
            np.add.at(links, b, copies[a])
            if len(a):
                a, b = forest(rep[a], rep[b])
                xs.append(a)
                ys.append(b)
        x, y = forest(np.concatenate(xs), np.concatenate(ys)) if xs else (np.zeros(0, np.int64),) * 2
        some = np.flatnonzero(links)
        tidy()
        return pd.DataFrame({"id": np.concatenate([rep[some], y]), "n": np.concatenate([links[some], np.zeros(len(y), np.int64)]), "root": pd.array(np.concatenate([np.full(len(some), -1), x]), "Int64")}).assign(root=lambda z: z.root.where(z.n == 0))

    return tasks.groupBy("cell", "i", "j").applyInPandas(join, "id long, n long, root long")


def embedding_components(vectors: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, and neither do
    vectors of different lengths. Equal vectors are one class: their rows link with one another and share all
    other links, which are counted with multiplicity. A component's id is its least vec_id, null if all are null; kept
    is vec_id = component_id, false where one is null. Rows with a null id, or repeated ids, link like any other; an
    empty table gives no rows.
    """
    raw = array_udf(lambda v: pa.array(usable(v), pa.binary()), "binary")
    rows = cut(vectors.select(F.col(id_col).cast("long").alias("vec_id"), raw(F.col(vec_col)).alias("raw")))
    classes = rows.where("raw is not null").groupBy("raw").agg(F.count("*").alias("copies"), F.min("vec_id").alias("first"))
    classes = cut(classes.withColumn("rep", F.monotonically_increasing_id()))
    out = cut(range_links(classes, cosine))
    root = components(out.where("root is not null").select(F.col("root").alias("a"), F.col("id").alias("b")))
    n = out.groupBy("id").agg(F.sum("n").alias("n"))
    of = classes.join(n, classes.rep == n.id, "left").join(root, classes.rep == root.node, "left").select("raw", "first", "copies", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "rep").alias("root"))
    of = least_id(cut(of), "raw", "n_links")
    alone = rows.where("raw is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    joined = with_class(rows.where("raw is not null"), of, "raw").select("vec_id", "n_links", "component_id").unionByName(alone)
    comp = F.coalesce("component_id", "vec_id")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), comp.alias("component_id"), F.coalesce(F.col("vec_id") == comp, F.lit(False)).alias("kept"))
