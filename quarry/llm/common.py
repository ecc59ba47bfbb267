"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the six white-space bytes of the word rule [^\x20\x09-\x0D]+.
SPACE = b" \t\n\x0b\x0c\r"

ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the reliable checkpoint folder and returns it with a short lineage.

    The folder is the session's, which every executor shares; none is made up here.
    """
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            raise ValueError("spark.checkpoint.dir names no folder; set it to one that driver and executors share")
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def fields(schema: str) -> list[tuple[str, str]]:
    return [tuple(x.split()) for x in schema.split(",")]


def columns(schema: str, values: list) -> list[pa.Array]:
    return [v if isinstance(v, pa.Array) else pa.array(v, ARROW[kind], from_pandas=False) for (_, kind), v in zip(fields(schema), values)]


def record(schema: str, values: list) -> pa.RecordBatch:
    """A record batch of the columns that a flat DDL schema lists."""
    return pa.RecordBatch.from_arrays(columns(schema, values), names=[n for n, _ in fields(schema)])


@functools.cache
def reuse_memory(most: int = 64 << 20) -> None:
    """Has a task's process keep up to `most` bytes of freed arrays for the next ones, which spares it most page faults."""
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 32 << 20)  # M_MMAP_THRESHOLD, at most half a heap
        libc.mallopt(-1, most)  # M_TRIM_THRESHOLD
        libc.mallopt(-2, 4 << 20)  # M_TOP_PAD
    except (OSError, AttributeError):
        pass  # another C library: only slower


def tidy() -> None:
    """Gives freed memory back to the system: a task's process lives on, and others of the executor need it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def tidied(run):
    """A mapInArrow function that is tidy when its partition is done."""

    def go(batches):
        try:
            yield from run(batches)
        finally:
            tidy()

    return go


def array_udf(fn, kind: str):
    """Arrow UDF of one column whose process is tidy after each batch; fn gets and returns an Arrow array."""

    def run(values: pa.Array) -> pa.Array:
        out = fn(values)
        tidy()
        return out

    return F.arrow_udf(run, kind)


def struct_udf(schema: str, fn):
    """Scalar Arrow UDF: fn gets Arrow arrays and returns one sequence for each field of schema.

    It counts as nondeterministic so that the optimiser doesn't run it once more for a filter on its result.
    """

    def run(*arrays: pa.Array) -> pa.Array:
        # in slices, so that a batch's texts aren't copied all at once
        out = []
        for k in range(0, max(1, len(arrays[0])), 2048):
            values = fn(*[a.slice(k, 2048) for a in arrays])
            out.append(pa.StructArray.from_arrays(columns(schema, values), names=[n for n, _ in fields(schema)]))
        tidy()
        return pa.concat_arrays(out)

    ddl = "struct<" + ",".join(f"{n}:{k}" for n, k in fields(schema)) + ">"
    return F.arrow_udf(run, ddl).asNondeterministic()


def as_bytes(texts: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return [x or b"" for x in texts.cast(pa.binary()).to_pylist()]


def lower_words(text: bytes) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ with A-Z in lower case; bytes.lower() and bytes.split() know ASCII only."""
    return text.lower().split()


def held_out(doc_id, modulus: int, remainder: int = 2):
    """True where crc32 of the id's text leaves the remainder; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % modulus == remainder


def sample(df: DataFrame, bound: int, *key: str) -> DataFrame:
    """About `bound` rows, chosen by a hash of the key: the same rows at each run, whatever the partitioning."""
    share = min(1.0, bound / max(1, df.count()))
    return df if share == 1.0 else df.where(F.pmod(F.xxhash64(F.lit("sample"), *key), F.lit(1 << 30)) < int(share * (1 << 30)))


def small(df: DataFrame, rows: int = 50_000) -> DataFrame:
    """df with a broadcast hint if its count is within the bound; a larger one is joined by a shuffle."""
    return F.broadcast(df) if df.count() <= rows else df


def with_class(rows: DataFrame, classes: DataFrame, key: str) -> DataFrame:
    """rows with the columns of their class; classes has one row a key, and copies, the number of its rows.

    A class with over a thousandth of all rows is joined by a broadcast: there are less than a thousand of them, and
    no task gets all of one's rows. The others are joined by a shuffle.
    """
    total = classes.agg(F.sum("copies")).first()[0] or 0
    hot = classes.where(F.col("copies") > max(1000, total // 1000))
    if not hot.head(1):
        return rows.join(classes, key)
    hot = F.broadcast(cut(hot))
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(classes, key))


def least_id(classes: DataFrame, key: str, *carried: str) -> DataFrame:
    """(key, copies, carried, component_id) of classes (key, first, copies, root): the least `first` of a root's classes.

    Roots of one class, which most are, don't meet a shuffle twice: the others' are summed up and joined by themselves.
    """
    ids = classes.groupBy("root").agg(F.count("*").alias("classes"), F.min("first").alias("component_id"))
    many = cut(ids.where("classes > 1").select("root", F.col("classes").alias("copies"), "component_id"))
    keep = [key, F.col("n_rows").alias("copies"), *carried, "component_id"]
    named = classes.withColumnRenamed("copies", "n_rows")
    together = with_class(named.join(small(many.select("root")), "root", "left_semi"), many, "root").select(*keep)
    alone = named.join(small(many.select("root")), "root", "left_anti").withColumn("component_id", F.col("first")).select(*keep)
    return cut(together.unionByName(alone))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (root, member) of the components of edges (a, b); root is the smallest member."""
    ids, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(ids))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        while not np.array_equal(new, nxt := new[new]):
            new = nxt
        if np.array_equal(new, root):
            break
        root = new
    members = np.flatnonzero(root != np.arange(len(ids)))
    return ids[root[members]], ids[members]


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of edges (a long, b long) as (node, root): root is the smallest node reachable.

    Alternates the large-star and small-star steps; each round is checkpointed, no component is ever gathered
    in one place, and each step's aggregate is combined before its shuffle. Nodes that are their own root
    aren't listed. Stops when a round changes nothing.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    for _ in range(rounds):
        got = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if got == seen or not got["n"]:
            break
        seen = got
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count_if(F.col("v") > F.col("u")).alias("copies")))
        large = with_class(both.where("v > u"), least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = cut(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        now = cut(large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct())
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
