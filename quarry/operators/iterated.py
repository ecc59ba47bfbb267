"""Operators that take several rounds over tables of any size: descendants, cycles and exact percentiles.

Between rounds a table is written to the reliable checkpoint folder, and the driver sees counts alone.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def settled(df: DataFrame) -> DataFrame:
    """df, written to the session's checkpoint folder, which all executors share; a local session without one gets a temporary folder."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir names no folder; set it to one that driver and executors share")
            folder = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def descendants(nodes: DataFrame, roots: Column) -> DataFrame:
    """(id) of the nodes (id, parent) at or below those for which `roots` is true.

    Where every node has one parent, each round doubles how far up it looks, so there are as many rounds as a path's
    length has binary digits. Where some have several, a round goes one level down. Both end on cycles, since a round
    that finds nothing new is the last. A null id is no node; repeated rows count once.
    """
    edges = settled(nodes.where("id IS NOT NULL").groupBy("id", "parent").agg(F.max(roots).alias("hit")))
    if edges.where("parent IS NOT NULL").groupBy("id").count().where("count > 1").head(1):
        return _by_level(edges)
    state = settled(edges.groupBy("id").agg(F.max("parent").alias("up"), F.max("hit").alias("hit")))
    before = -1
    while (n := state.where("hit").count()) != before:
        before = n
        above = state.select(F.col("id").alias("_id"), F.col("up").alias("_up"), F.col("hit").alias("_hit"))
        open_ = state.where("NOT hit AND up IS NOT NULL").join(above, F.col("up") == F.col("_id"), "left").select("id", F.col("_up").alias("up"), F.coalesce("_hit", F.lit(False)).alias("hit"))
        state = settled(open_.unionByName(state.where("hit OR up IS NULL")))
    return state.where("hit").select("id")


def _by_level(edges: DataFrame) -> DataFrame:
    found = settled(edges.where("hit").select("id").distinct())
    front = found
    while True:
        below = edges.join(front.select(F.col("id").alias("_in")), F.col("parent") == F.col("_in"), "left_semi").select("id").distinct()
        front = settled(below.join(found, "id", "left_anti"))
        if not front.head(1):
            return found
        found = settled(found.unionByName(front))


def cyclic(nodes: DataFrame) -> DataFrame:
    """(id) of the nodes that are their own ancestors; every node (id, parent) has one parent at most.

    Steps up are doubled until they are longer than any path without a cycle; whoever is reached then lies on one.
    """
    state = settled(nodes.where("id IS NOT NULL").groupBy("id").agg(F.max("parent").alias("up")))
    steps, n = 1, state.count()
    while steps <= n:
        above = state.select(F.col("id").alias("_id"), F.col("up").alias("_up"))
        state = settled(state.join(above, F.col("up") == F.col("_id")).select("id", F.col("_up").alias("up")).where("up IS NOT NULL"))
        steps *= 2
        if not state.head(1):
            break
    return state.select(F.col("up").alias("id")).distinct()


def exact_percentiles(df: DataFrame, keys: list[str], value: str, fractions: list[float], most: int = 10_000, parts: int = 256, rounds: int = 12) -> DataFrame:
    """(keys, p, value): percentile_cont of each group, whatever its size; nulls don't count, and a null key is a group.

    A wanted rank lies in a bracket of values, at first the group's least and greatest. In a round the bracket's
    values are cut into `parts` by approximate quantiles, a few parts about the rank make the next bracket, and an
    exact count tells whether the rank lies in it; else the bracket stays open on that side. When a bracket has at
    most `most` values, or about so many distinct ones, they are counted, and the ranks are picked from the sums. No
    task gets more of a group than partial aggregates and, at the end, a bracket's distinct values. If quantiles
    don't narrow a bracket down in `rounds`, it is counted as it is.
    """
    rows = df.where(F.col(value).isNotNull()).select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col(value).cast("double").alias("v"))
    names = [f"k{i}" for i in range(len(keys))]
    stats = rows.groupBy(*names).agg(F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("b"), F.approx_count_distinct("v").alias("d"))
    pos = (F.col("n") - 1) * F.col("p")
    goals = stats.withColumn("p", F.explode(F.array(*[F.lit(float(x)) for x in fractions]))).withColumns({"pos": pos, "lo": F.floor(pos), "hi": F.ceil(pos), "below": F.lit(0).cast("long"), "held": F.col("n")})
    goals = settled(goals)

    def inside(goals: DataFrame) -> DataFrame:
        """Rows in the brackets of goals; a goal's group meets its rows by a broadcast if there are few goals."""
        side = F.broadcast(goals) if goals.count() <= 20_000 else goals
        cond = F.col("v").between(F.col("a"), F.col("b"))
        for k in names:
            cond = cond & F.col(k).eqNullSafe(F.col(f"_{k}"))
        return rows.join(side.select(*[F.col(k).alias(f"_{k}") for k in names], "p", "a", "b"), cond).select(*names, "p", "v")

    wide = (F.col("held") > most) & (F.col("d") > most) & (F.col("a") < F.col("b"))
    for _ in range(rounds):
        open_ = settled(goals.where(wide))
        if not open_.head(1):
            break
        cuts = inside(open_).groupBy(*names, "p").agg(F.percentile_approx("v", [i / parts for i in range(parts + 1)], 20 * parts).alias("q"))
        share = lambda r: (F.col(r) - F.col("below")) / F.col("held") * parts
        at = lambda r, by: F.greatest(F.lit(0), F.least(F.lit(parts), r + by)).cast("int") + 1
        cuts = cuts.withColumnsRenamed({**{k: f"c{k}" for k in names}, "p": "cp"})
        on = [F.col(k).eqNullSafe(F.col(f"c{k}")) for k in names] + [F.col("p") == F.col("cp")]
        tried = settled(open_.join(cuts, on).select(*open_.columns, F.element_at("q", at(F.floor(share("lo")), -1)).alias("x"), F.element_at("q", at(F.ceil(share("hi")), 1)).alias("y")))
        spots = tried.select(*[F.col(k).alias(f"t{k}") for k in names], F.col("p").alias("tp"), "x", "y")
        cond = F.col("p") == F.col("tp")
        for k in names:
            cond = cond & F.col(k).eqNullSafe(F.col(f"t{k}"))
        within = (F.col("v") >= F.col("x")) & (F.col("v") <= F.col("y"))
        few = F.broadcast(spots) if spots.count() <= 20_000 else spots
        counts = inside(open_).join(few, cond).groupBy(*names, "p").agg(F.count_if(F.col("v") < F.col("x")).alias("under"), F.count_if(within).alias("mid"), F.approx_count_distinct(F.when(within, F.col("v"))).alias("dm"))
        counts = counts.withColumnsRenamed({**{k: f"c{k}" for k in names}, "p": "cp"})
        lower = F.col("below") + F.col("under") <= F.col("lo")
        upper = F.col("hi") < F.col("below") + F.col("under") + F.col("mid")
        both = lower & upper
        # a side that the quantiles missed stays where it was; the other moves in the next round
        narrowed = tried.join(counts, on).select(
            *names, "n", F.when(both, F.col("x")).otherwise(F.col("a")).alias("a"), F.when(both, F.col("y")).otherwise(F.col("b")).alias("b"), F.when(both, F.col("dm")).otherwise(F.col("d")).alias("d"), "p", "pos", "lo", "hi",
            F.when(both, F.col("below") + F.col("under")).otherwise(F.col("below")).alias("below"), F.when(both, F.col("mid")).otherwise(F.col("held")).alias("held"),
        )
        goals = settled(goals.where(~wide).select(*narrowed.columns).unionByName(narrowed))
    counted = inside(goals).groupBy(*names, "p", "v").agg(F.count("*").alias("c"))
    counted = counted.withColumn("upto", F.sum("c").over(Window.partitionBy(*names, "p").orderBy("v")))
    counted = counted.withColumnsRenamed({**{k: f"c{k}" for k in names}, "p": "cp"})
    joined = goals.join(counted, [F.col(k).eqNullSafe(F.col(f"c{k}")) for k in names] + [F.col("p") == F.col("cp")])
    reached = lambda r: F.min(F.when(F.col("below") + F.col("upto") > F.col(r), F.col("v")))
    picked = joined.groupBy(*names, "p", "pos", "lo").agg(reached("lo").alias("x"), reached("hi").alias("y"))
    return picked.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], "p", (F.col("x") + (F.col("y") - F.col("x")) * (F.col("pos") - F.col("lo"))).alias("value"))
