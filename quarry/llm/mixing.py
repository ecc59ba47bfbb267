"""Mixing sources to target weights by pivotal dependent rounding of fractional copy counts."""

from __future__ import annotations

import math

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, cut, small, struct_udf

#: The sources' weights by code point order, repeating.
WEIGHTS = (5, 2, 1)
#: Equal rows that are numbered at a time.
EQUAL = 10_000


def targets(sizes: DataFrame, weights=WEIGHTS, most: int = 3) -> DataFrame:
    """(source, source_size, n, target) from one row per source (source, source_size, n).

    Each source gets its weight's share of all sizes; at most times its size it stops, and the excess goes to
    the others by weight until none is above: the level L with sum(min(most * size, L * weight)) = total. Sources
    in order of the level at which they stop give L in one pass over the sources' table.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("w", w).withColumn("cap", most * F.col("source_size").cast("double")).withColumn("stop", F.col("cap") / F.col("w"))
    order = Window.orderBy("stop", F.col("source").asc_nulls_last())
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumns({"total": F.sum(F.col("source_size").cast("double")).over(every), "w_all": F.sum("w").over(every), "cap_to": F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, 0)), "w_to": F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, 0))})
    # the level if this source and those before it stop, or if only those before it stop
    s = s.withColumn("level", (F.col("total") - (F.col("cap_to") - F.col("cap"))) / (F.col("w_all") - (F.col("w_to") - F.col("w"))))
    # the first source that its level doesn't stop has the final level
    s = s.withColumn("final", F.min(F.when(F.col("level") <= F.col("stop"), F.struct("stop", F.coalesce(F.col("source"), F.lit("\U0010ffff")).alias("o"), "level"))).over(every)["level"])
    return s.select("source", "source_size", "n", F.least("cap", F.coalesce(F.col("final") * F.col("w"), F.col("cap"))).alias("target"))


def coin(seed: int, *key) -> float:
    return xxhash.xxh64_intdigest(repr(key).encode(), seed) / 2**64


def pivot(items: list[tuple[float, int]], seed: int, key: tuple) -> tuple[list[tuple[int, int]], tuple[float, int] | None]:
    """Pairs fractional probabilities along the list; of each pair one becomes 0 or 1 and the other goes on.

    Returns the items decided, as (item, 0 or 1), and the item that is left over with its probability.
    """
    done: list[tuple[int, int]] = []
    open_p, open_i = 0.0, None
    for p, i in items:
        if open_i is None:
            open_p, open_i = p, i
            continue
        total, u = open_p + p, coin(seed, key, open_i, i)
        if total <= 1:
            # all mass moves to one of the two, and the other gets none
            stays = u * total < open_p
            done.append((i if stays else open_i, 0))
            open_i = open_i if stays else i
            open_p = total
        else:
            full = u * (2 - total) < 1 - p
            done.append((open_i if full else i, 1))
            open_i = i if full else open_i
            open_p = total - 1
        if open_p < 1e-12 or open_p > 1 - 1e-12:
            done.append((open_i, int(round(open_p))))
            open_i = None
    return done, None if open_i is None else (open_p, open_i)


def size_of(text: str) -> F.Column:
    """Struct with size: the number of words."""
    return struct_udf("size long", lambda texts: [[len(b.split()) for b in as_bytes(texts)]])(text)


def mix(docs: DataFrame, key: str = "doc_id", seed: int = 20, leaf: int = 4096, fan: int = 64) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) for every row of docs (doc_id, text, source).

    A document of a source with target t and size s is taken floor(t / s) times, and once more with the
    fraction that is left; the fractions of a source are rounded together so that their sum is kept. They are
    paired in order of size, the longest first, inside leaf groups of documents of about one size, so that mass
    moves between documents of like size and the words taken are kept with the copies. The fraction that each
    group leaves over goes up a tree of `fan` neighbouring groups a node until one a source is left. Null text has
    size 0 and no copies; null source is a source, last in order; rows that repeat are told apart by their number
    among their equals; an empty table, or one without words, takes nothing. Reruns give the same mix.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.col("source").cast("string").alias("source"), size_of("text").alias("_z")).select("doc_id", "source", F.col("_z.size").alias("size"))
    # equal rows are interchangeable, so a count stands for them until they are numbered
    counted = cut(rows.groupBy("doc_id", "source", "size").agg(F.count("*").alias("same")))
    t = cut(targets(counted.groupBy("source").agg(F.sum(F.col("size") * F.col("same")).alias("source_size"), F.sum("same").alias("n"))))
    numbered = counted.select("doc_id", "source", "size", "same", F.explode(F.expr(f"sequence(0, same - 1, {EQUAL})")).alias("base"))
    numbered = numbered.withColumn("nth", F.explode(F.expr(f"sequence(base + 1, least(base + {EQUAL}, same))"))).drop("base", "same")
    keyed = numbered.withColumn("h", F.xxhash64("doc_id", "source", "size")).join(small(t.withColumnRenamed("source", "of")), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    keyed = keyed.withColumn("f", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    keyed = keyed.withColumns({"whole": F.floor("f"), "p": F.col("f") - F.floor("f"), "id": F.xxhash64("h", "nth"), "src": F.xxhash64(F.coalesce("source", F.lit("\u0000null"))), "band": F.floor(F.log1p(F.col("size").cast("double")) * 64)})
    # leaf groups are runs of documents of about one size: those of a band start behind the smaller ones of the source
    bands = cut(keyed.groupBy("src", "band").agg(F.count("*").alias("in_band")))
    before = Window.partitionBy("src").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    bands = cut(bands.withColumn("before", F.coalesce(F.sum("in_band").over(before), F.lit(0))))
    u = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1 << 30)) / float(1 << 30)
    keyed = cut(keyed.join(small(bands), ["src", "band"]).withColumn("g", F.floor((F.col("before") + u * F.col("in_band")) / leaf)).drop("band", "before", "in_band"))

    def decide(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(["size", "id"], ascending=[False, True], kind="stable")
        done, rest = pivot(list(zip(b.p.tolist(), b.id.tolist())), seed, tuple(int(x) for x in key))
        size = dict(zip(b.id.tolist(), b["size"].tolist()))
        out = [(i, float(v), True, size[i]) for i, v in done] + ([(rest[1], rest[0], False, size[rest[1]])] if rest else [])
        return pd.DataFrame({"id": [x[0] for x in out], "p": [x[1] for x in out], "done": [x[2] for x in out], "size": [x[3] for x in out], "src": int(key[0]), "g": int(key[1])}).astype({"id": "int64", "p": "float64", "done": "bool", "size": "int64", "src": "int64", "g": "int64"})

    schema = "id long, p double, done boolean, size long, src long, g long"
    open_rows = keyed.where("p > 1e-12 and p < 1 - 1e-12").select("src", "g", "id", "p", "size")
    levels = max(0, math.ceil(math.log(max(1, (t.agg(F.max("n")).first()[0] or 1) / leaf), fan)))
    step = cut(open_rows.groupBy("src", "g").applyInPandas(decide, schema))
    decided = step.where("done").select("id", F.col("p").cast("long").alias("more"))
    for _ in range(levels):
        step = cut(step.where("not done").withColumn("g", F.floor(F.col("g") / fan)).groupBy("src", "g").applyInPandas(decide, schema))
        decided = decided.unionByName(step.where("done").select("id", F.col("p").cast("long").alias("more")))
    # one fraction a source is left: a last draw
    last = step.where("not done").select("id", (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40) < F.col("p")).cast("long").alias("more"))
    decided = decided.unionByName(last)
    sure = F.when(F.col("p") >= 1 - 1e-12, 1).otherwise(0)
    return keyed.join(decided, "id", "left").select("doc_id", "source", "size", "source_size", "target", (F.col("whole") + F.coalesce("more", sure)).alias("copies"), "nth")
