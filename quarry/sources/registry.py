"""Named sources, opened when they are first asked for, and what they share: policies, catalogues, CSV, graphs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.governance import clamp


@dataclass(frozen=True)
class Policy:
    """What a source allows: rows and seconds of one statement. A request can only tighten them."""

    rows: int = 200
    seconds: int = 30

    def tightened(self, rows: int | None = None, seconds: int | None = None) -> Policy:
        return Policy(clamp(rows, self.rows), clamp(seconds, self.seconds))


def jdbc_options(url: str, sql: str, policy: Policy, schema: str | None = None) -> dict[str, str]:
    """Options for a bounded read of a database: one statement, its limit and time, and a session that can't write.

    PostgreSQL gets its search path, MySQL-like servers a read-only transaction.
    """
    postgres = url.startswith("jdbc:postgresql")
    first = f"SET search_path TO {schema}; SET default_transaction_read_only = on" if postgres and schema else "SET default_transaction_read_only = on" if postgres else "SET SESSION TRANSACTION READ ONLY"
    if schema is not None and not schema.replace("_", "").isalnum():
        raise ValueError(f"{schema!r} isn't a schema")
    return {"url": url, "query": f"SELECT * FROM ({sql}) q LIMIT {policy.rows + 1}", "queryTimeout": str(policy.seconds), "sessionInitStatement": first, "fetchsize": str(min(1000, policy.rows + 1))}


class JdbcReader:
    """A database behind one JDBC address; every read is bounded and read-only."""

    def __init__(self, spark: SparkSession, url: str, policy: Policy = Policy(), schema: str | None = None, **login):
        self.spark, self.url, self.policy, self.schema, self.login = spark, url, policy, schema, login

    def fetch(self, sql: str, rows: int | None = None, seconds: int | None = None) -> DataFrame:
        return self.spark.read.format("jdbc").options(**jdbc_options(self.url, sql, self.policy.tightened(rows, seconds), self.schema), **self.login).load()

    def __call__(self, table: str) -> DataFrame:
        return self.spark.read.format("jdbc").options(url=self.url, dbtable=f"{self.schema}.{table}" if self.schema else table, **self.login).load()

    def explain(self, sql: str) -> str:
        """The server's own plan of a statement that isn't run, asked for on a read-only connection of the driver.

        Spark's `query` option makes a subquery of a statement, where EXPLAIN can't stand.
        """
        jvm = self.spark._jvm
        login = jvm.java.util.Properties()
        for k, v in self.login.items():
            login.setProperty(k, str(v))
        connection = jvm.java.sql.DriverManager.getConnection(self.url, login)
        try:
            connection.setReadOnly(True)
            statement = connection.createStatement()
            statement.setQueryTimeout(self.policy.seconds)
            rows, out = statement.executeQuery(f"EXPLAIN {sql}"), []
            while rows.next() and len(out) < 200:
                out.append(str(rows.getString(1)))
            return "\n".join(out)
        finally:
            connection.close()


class SourceRegistry:
    """Sources by name; each loader runs once, when its source is first asked for or preloaded."""

    def __init__(self, loaders: dict[str, Callable[[], object]]):
        self.loaders, self.open = dict(loaders), {}

    def get(self, name: str):
        if name not in self.loaders:
            raise KeyError(f"no source {name}")
        if name not in self.open:
            self.open[name] = self.loaders[name]()
        return self.open[name]

    def preload(self) -> dict[str, str | None]:
        """Opens every source; says what went wrong with those that don't open, and goes on."""
        problems: dict[str, str | None] = {}
        for name in self.loaders:
            try:
                self.get(name)
                problems[name] = None
            except Exception as e:  # noqa: BLE001 - any loader's failure is reported by name
                problems[name] = str(e).splitlines()[0] if str(e) else type(e).__name__
        return problems

    def probe(self, name: str, table: str) -> bool:
        """Whether a table's first row can be read."""
        try:
            self.get(name)(table).limit(1).count()
            return True
        except Exception:  # noqa: BLE001 - a probe answers, it doesn't raise
            return False

    def close(self, name: str) -> bool:
        source = self.open.pop(name, None)
        if hasattr(source, "close"):
            source.close()
        return source is not None


def merged_catalog(native: DataFrame, warehouse: DataFrame) -> DataFrame:
    """(table, column, type, comment, origin) of a source's own schema and a warehouse catalogue over it.

    Both have table, column, type, comment. The own schema says what exists and of which type; the catalogue's
    comment counts where there is one; what the catalogue alone has is kept and marked.
    """
    w = warehouse.select("table", "column", F.col("type").alias("_t"), F.nullif(F.trim("comment"), F.lit("")).alias("_c"))
    both = native.withColumn("_own", F.lit(True)).join(w.withColumn("_other", F.lit(True)), ["table", "column"], "full")
    origin = F.when(F.col("_own") & F.col("_other"), "both").when(F.col("_own"), "native").otherwise("warehouse")
    return both.select("table", "column", F.coalesce("type", "_t").alias("type"), F.coalesce("_c", "comment", F.lit("")).alias("comment"), origin.alias("origin"))


def export_csv(rows: DataFrame, path: str) -> None:
    """Terms, comments or exemplars as CSV with a header; nulls and empty strings stay apart."""
    rows.write.mode("overwrite").option("header", True).option("nullValue", "\\N").option("escape", '"').csv(path)


def import_csv(spark: SparkSession, path: str, schema: str, keys: list[str], stored: DataFrame | None = None) -> DataFrame:
    """Rows of a CSV in a schema, over the stored ones: a key in the file replaces the stored row, the last row of a key counts."""
    got = spark.read.option("header", True).option("nullValue", "\\N").option("escape", '"').option("mode", "FAILFAST").schema(schema).csv(path)
    names = got.columns
    # a row's place: its file, its part of the file, and its number in the part
    placed = got.select("*", F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("n")).alias("_at"))
    other = [c for c in names if c not in keys]
    got = placed.groupBy(*keys).agg(F.max_by(F.struct(*other) if other else F.lit(1), "_at").alias("_row"))
    got = got.select(*keys, *([f"_row.{c}" for c in other])).select(*names)
    return got if stored is None else got.unionByName(stored.join(got.select(*keys), keys, "left_anti"))


def stored_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame] | None:
    """(mentions, relations) as append_graph() stored them; None where nothing is stored."""
    try:
        rows = spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
    parts = [rows.where(F.col("kind") == k).select(f"{k}.*") for k in ("mention", "relation")]
    return parts[0], parts[1]


def append_graph(mentions: DataFrame, relations: DataFrame, path: str) -> None:
    """Adds a document graph's new rows to the stored mentions and relations; rows that are stored already aren't added again.

    Both go into one table by one write, whose commit shows all of them or, if it fails before, none.
    """
    spark = mentions.sparkSession
    keys = ["chunk_id", "doc_id", "entity"], ["doc_id", "src", "dst", "type"]
    new = [mentions.dropDuplicates(keys[0]), relations.dropDuplicates(keys[1])]
    if old := stored_graph(spark, path):
        new = [n.join(o.select(*k), k, "left_anti").select(*n.columns) for n, o, k in zip(new, old, keys)]
    m, r = (n.select(F.lit(k).alias("kind"), F.struct(*n.columns).alias(k)) for n, k in zip(new, ("mention", "relation")))
    m.unionByName(r, allowMissingColumns=True).write.mode("append").partitionBy("kind").parquet(path)


def outside_records(rows: DataFrame, text: str, question: str, top: int = 5) -> DataFrame:
    """(position, text) of a read-only outside table's records with the most of the question's words; at most `top`."""
    from ..functions.text import terms

    q = terms(question)
    words = F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+"))
    hits = F.size(F.array_intersect(words, F.array(*[F.lit(x) for x in q]))) if q else F.lit(0)
    found = rows.select(F.col(text).alias("text"), hits.alias("_h")).where("_h > 0").orderBy(F.desc("_h"), "text").limit(top)
    return found.agg(F.sort_array(F.collect_list(F.struct((-F.col("_h")).alias("h"), "text"))).alias("a")).select(F.posexplode(F.col("a").text).alias("position", "text"))
