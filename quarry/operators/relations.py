"""Join shapes, snapshots, deduplication, purchase graphs and personalised PageRank."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_by(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def first_occurrence(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    """Keeps the row with the least position of each key: deduplication that keeps order."""
    w = Window.partitionBy(*keys).orderBy(position)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def ancestors(paths: DataFrame, col: str = "path") -> DataFrame:
    """Each path with its proper ancestors exploded, so that prefix joins become equality joins."""
    parts = F.split(col, "/")
    return paths.withColumn("ancestor", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")))).where("ancestor <> ''")


def tag_classes(df: DataFrame, key: str, tags: str) -> DataFrame:
    """(key, _s): the set of tags of each id that has any; ids with equal sets are one class. Repeated rows go before sets are collected."""
    return df.select(key, F.explode(tags).alias("_t")).where("_t IS NOT NULL").distinct().groupBy(key).agg(F.sort_array(F.collect_list("_t")).alias("_s"))


def class_pairs(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """(_s, _r): the classes of both sides that share a tag."""
    return mine.select("_s").distinct().select("_s", F.explode("_s").alias("_t")).join(theirs.select(F.col("_s").alias("_r")).distinct().select("_r", F.explode("_r").alias("_t")), "_t").select("_s", "_r").distinct()


def tag_blocks(classed: DataFrame, key: str, s: str, ids: str, block: int) -> DataFrame:
    """(s, ids): each class with its ids, in blocks of about `block`."""
    sizes = classed.groupBy("_s").agg(F.ceil(F.count("*") / block).alias("_n"))
    return classed.join(sizes, "_s").groupBy(F.col("_s").alias(s), F.pmod(F.xxhash64(key), F.col("_n")).alias("_k")).agg(F.collect_list(F.struct(key))[key].alias(ids)).drop("_k")


def array_overlap(left: DataFrame, right: DataFrame, left_id: str, right_id: str, col: str, block: int = 1024) -> DataFrame:
    """Pairs of ids that share an element, each once.

    Rows with equal sets are one class and classes are paired first. The ids of a class are cut into blocks; two blocks meet as one
    row, so that what is shuffled grows with the blocks' pairs, and ids are paired where their blocks are. An id has one class and
    one block, so no pair is made twice.

    Generated code keeps all rows that it makes of one row until it is through with it: a million for two blocks, if both are exploded
    in it. Transform stays out of generated code, and with it the first explode, so only one id's pairs are kept at a time.
    """
    mine, theirs = tag_classes(left.select(F.col(left_id).alias("a"), col), "a", col), tag_classes(right.select(F.col(right_id).alias("b"), col), "b", col)
    met = tag_blocks(mine, "a", "_s", "_a", block).join(class_pairs(mine, theirs), "_s").join(tag_blocks(theirs, "b", "_r", "_b", block), "_r")
    spread = met.select("_a", "_b").repartition(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.col("_a")[0], F.col("_b")[0])
    return spread.select(F.explode(F.transform("_a", lambda x: x)).alias("a"), "_b").select("a", F.explode("_b").alias("b"))


def overlap_counts(left: DataFrame, right: DataFrame, a: str, b: str, tags: str) -> DataFrame:
    """(a, partners): with how many b's of the right side each a of the left shares a tag, counted once each.

    Rows with equal sets of tags are one class, so pairs are formed of classes that share a tag and never of their members.
    """
    mine, theirs = tag_classes(left.where(F.col(a).isNotNull()), a, tags), tag_classes(right.where(F.col(b).isNotNull()), b, tags)
    n = theirs.groupBy("_s").agg(F.count("*").alias("_n")).withColumnRenamed("_s", "_r")
    return mine.join(class_pairs(mine, theirs).join(n, "_r").groupBy("_s").agg(F.sum("_n").alias("partners")), "_s").select(a, "partners")


def purchase_edges(lines: DataFrame, orders: DataFrame, customers: DataFrame, nation: DataFrame, amount: Column) -> DataFrame:
    """Customer, product and region with their summed amount and quantity: one join on the order, one aggregate."""
    sold = lines.select("l_orderkey", "l_partkey", amount.alias("amount"), F.col("l_quantity").cast("decimal(18,2)").alias("qty"))
    e = sold.join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey", "l_partkey").agg(F.sum("amount").alias("amount"), F.sum("qty").alias("qty"))
    c = customers.select("c_custkey", "c_nationkey")
    return e.join(c, e.o_custkey == c.c_custkey).join(nation.select("n_nationkey", "n_regionkey"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("o_custkey").alias("custkey"), F.col("l_partkey").alias("partkey"), F.col("n_regionkey").alias("regionkey"), F.col("amount").cast("double"), F.col("qty").cast("double"))


def buyers_of(edges: DataFrame, parts: DataFrame, limit: int) -> DataFrame:
    hit = edges.join(parts.select(F.col("p_partkey").alias("partkey")), "partkey", "left_semi")
    return hit.groupBy("custkey").agg(F.sum(F.col("amount").cast("decimal(18,4)")).cast("double").alias("amount"), F.sum(F.col("qty").cast("decimal(18,2)")).cast("double").alias("qty")).orderBy(F.desc("amount"), "custkey").limit(limit)


def copurchase(lines: DataFrame, orders: DataFrame, parts: DataFrame, amount: Column, limit: int) -> DataFrame:
    """Other products of the distinct buyers of the given ones, from the seeds' lines to the buyers' and no further."""
    keys = parts.select(F.col("p_partkey").alias("l_partkey"))
    of = orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("custkey"))
    buyers = of.join(lines.join(keys, "l_partkey", "left_semi").select("l_orderkey"), "l_orderkey", "left_semi").select("custkey").distinct()
    theirs = of.join(buyers, "custkey", "left_semi")
    other = lines.join(keys, "l_partkey", "left_anti").select("l_orderkey", F.col("l_partkey").alias("partkey"), amount.alias("amount")).join(theirs, "l_orderkey")
    return other.groupBy("partkey").agg(F.countDistinct("custkey").alias("buyers"), F.sum("amount").cast("double").alias("amount")).orderBy(F.desc("buyers"), F.desc("amount"), "partkey").limit(limit)


def pagerank(n: int, edges: list[tuple[int, int, float]], teleport: list[float], damping: float = 0.85, rounds: int = 100, tol: float = 1e-6) -> tuple[np.ndarray, int]:
    """Personalised PageRank of a bounded neighbourhood; nodes without edges out give their mass to the teleport."""
    t = np.array(teleport, float)
    t = t / t.sum() if t.sum() > 0 else np.full(n, 1 / max(1, n))
    src, dst, w = (np.array([e[k] for e in edges], kind) for k, kind in ((0, int), (1, int), (2, float)))
    out = np.bincount(src, w, n) if len(src) else np.zeros(n)
    p, k = t.copy(), 0
    for k in range(1, rounds + 1):
        spread = np.bincount(dst, p[src] * w / out[src], n) if len(src) else np.zeros(n)
        new = (1 - damping) * t + damping * (spread + p[out == 0].sum() * t)
        gap = np.abs(new - p).sum()
        p = new
        if gap < tol:
            break
    return p, k


def graph_route(mentions: DataFrame, relations: DataFrame, seeds: list, nodes: int = 200, top: int = 10) -> DataFrame:
    """Chunks by the PageRank of their entities, over at most `nodes` entities within two hops of the seeds.

    The neighbourhood is cut by joins on Spark, nearer entities first; only its bounded edges are ranked. A hop is taken
    only while there is room, so what it starts from is always fewer than `nodes` entities.
    """
    spark = mentions.sparkSession
    both = relations.select("src", "dst", "weight").union(relations.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    kind = mentions.select("entity").schema
    names = [(r.entity, 0) for r in spark.createDataFrame([(s,) for s in seeds], kind).distinct().orderBy("entity").limit(nodes).collect()]
    for hop in (1, 2):
        if len(names) < nodes:
            near = F.broadcast(spark.createDataFrame([(e,) for e, _ in names], kind))
            more = both.join(near, F.col("src") == near.entity, "left_semi").select("dst").distinct()
            new = more.join(near, F.col("dst").eqNullSafe(near.entity), "left_anti").orderBy("dst").limit(nodes - len(names))
            names += [(r.dst, hop) for r in new.collect()]
    kept = spark.createDataFrame([(e,) for e, _ in names], kind)
    at = {e: k for k, (e, _) in enumerate(names)}
    inside = both.join(F.broadcast(kept.select(F.col("entity").alias("src"))), "src", "left_semi").join(F.broadcast(kept.select(F.col("entity").alias("dst"))), "dst", "left_semi")
    edges = inside.groupBy("src", "dst").agg(F.sum("weight").alias("w")).collect()
    rank, _ = pagerank(len(names), [(at[e.src], at[e.dst], e.w) for e in edges], [{0: 1.0, 1: 0.8}.get(h, 0.0) for _, h in names])
    scores = spark.createDataFrame([(e, float(rank[k])) for e, k in at.items()], mentions.select("entity").withColumn("rank", F.lit(0.0)).schema)
    return mentions.join(F.broadcast(scores), "entity").groupBy("chunk").agg(F.round(F.sum("rank"), 9).alias("score")).orderBy(F.desc("score"), "chunk").limit(top)
