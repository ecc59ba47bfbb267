"""A data source for outside databases in SQLite files: partitioned reads, filters that the database applies, plans, and a top-k.

The file has to lie where driver and executors reach it. Every connection is read-only.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .registry import Policy

NAME = "quarry_sqlite"
#: How SQLite tells a column's kind by a part of its declared type.
AFFINITY = (("INT", "bigint"), ("CHAR", "string"), ("CLOB", "string"), ("TEXT", "string"), ("BLOB", "binary"), ("REAL", "double"), ("FLOA", "double"), ("DOUB", "double"))
COMPARED = {D.EqualTo: "=", D.EqualNullSafe: "IS", D.GreaterThan: ">", D.GreaterThanOrEqual: ">=", D.LessThan: "<", D.LessThanOrEqual: "<="}


def connected(path: str, seconds: float = 30) -> sqlite3.Connection:
    """A read-only connection whose statements end after some seconds."""
    import time

    db = sqlite3.connect(f"file:{path}?mode=ro", uri=True, timeout=seconds)
    db.execute("PRAGMA query_only = ON")
    end = time.monotonic() + seconds
    db.set_progress_handler(lambda: int(time.monotonic() > end), 100_000)
    return db


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def kind_of(declared: str) -> str:
    return next((k for mark, k in AFFINITY if mark in declared.upper()), "double" if declared else "string")


def columns_of(db: sqlite3.Connection, table: str) -> list[tuple[str, str]]:
    got = [(r[1], kind_of(r[2] or "")) for r in db.execute(f"PRAGMA table_info({quoted(table)})")]
    if not got:
        raise ValueError(f"no table {table!r}")
    return got


def condition(f: D.Filter) -> tuple[str, list] | None:
    """A filter as a condition and its values; None for those that Spark has to apply."""
    if isinstance(f, D.Not):
        inner = condition(f.child)
        return (f"NOT ({inner[0]})", inner[1]) if inner else None
    if len(getattr(f, "attribute", ())) != 1:
        return None
    name = quoted(f.attribute[0])
    if type(f) in COMPARED and isinstance(f.value, (int, float, str)) and not isinstance(f.value, bool):
        return f"{name} {COMPARED[type(f)]} ?", [f.value]
    if isinstance(f, D.In) and f.value and len(f.value) <= 500 and all(isinstance(v, (int, float, str)) for v in f.value):
        return f"{name} IN ({', '.join('?' * len(f.value))})", list(f.value)
    if isinstance(f, D.IsNull):
        return f"{name} IS NULL", []
    if isinstance(f, D.IsNotNull):
        return f"{name} IS NOT NULL", []
    if isinstance(f, (D.StringContains, D.StringStartsWith)):  # instr minds the case, as Spark does
        return f"instr({name}, ?) {'= 1' if isinstance(f, D.StringStartsWith) else '> 0'}", [f.value]
    return None


class Span(D.InputPartition):
    def __init__(self, first: int | None, last: int | None):
        self.first, self.last = first, last


class Reader(D.DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.path, self.table, self.schema = options["path"], options["dbtable"], schema
        self.parts, self.rows, self.seconds = int(options.get("parts", 4)), int(options.get("rows", 0)), float(options.get("seconds", 30))
        self.where: list[tuple[str, list]] = []

    def pushFilters(self, filters):
        for f in filters:
            c = condition(f)
            if c is None:
                yield f
            else:
                self.where.append(c)

    def partitions(self) -> list[Span]:
        """Ranges of row ids; a table without them is one."""
        db = connected(self.path, self.seconds)
        try:
            low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(self.table)}").fetchone()
        except sqlite3.OperationalError:
            return [Span(None, None)]
        finally:
            db.close()
        if low is None:
            return []
        step = -(-(high - low + 1) // max(1, self.parts))
        return [Span(a, min(high, a + step - 1)) for a in range(low, high + 1, step)]

    def read(self, partition: Span | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # an empty table has no ranges
            return
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(self.schema)
        where, values = [c for c, _ in self.where], [v for _, vs in self.where for v in vs]
        if partition.first is not None:
            where.append("rowid BETWEEN ? AND ?")
            values += [partition.first, partition.last]
        sql = f"SELECT {', '.join(quoted(f.name) for f in self.schema)} FROM {quoted(self.table)}" + (f" WHERE {' AND '.join(where)}" if where else "") + (f" LIMIT {self.rows + 1}" if self.rows else "")
        db = connected(self.path, self.seconds)
        try:
            got = db.execute(sql, values)
            while rows := got.fetchmany(4096):
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t.type) for k, t in enumerate(kinds)], schema=kinds)
        finally:
            db.close()


class SqliteSource(D.DataSource):
    """spark.read.format("quarry_sqlite") with path and dbtable; parts, rows (of a partition) and seconds may be given."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        db = connected(self.options["path"])
        try:
            return ", ".join(f"`{c.replace('`', '``')}` {k}" for c, k in columns_of(db, self.options["dbtable"]))
        finally:
            db.close()

    def reader(self, schema: StructType) -> Reader:
        return Reader(dict(self.options), schema)


class SqliteReader:
    """A database for the source registry: tables, bounded fetches, plans and a probe of what is there."""

    def __init__(self, spark: SparkSession, path: str, policy: Policy = Policy(), parts: int = 4):
        self.spark, self.path, self.policy, self.parts = spark, path, policy, parts
        spark.dataSource.register(SqliteSource)
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
        self.problems = self.checked()

    def __call__(self, table: str, rows: int = 0) -> DataFrame:
        return self.spark.read.format(NAME).options(path=self.path, dbtable=table, parts=str(self.parts), rows=str(rows), seconds=str(self.policy.seconds)).load()

    def fetch(self, table: str, where: str | None = None, rows: int | None = None) -> tuple[DataFrame, bool]:
        """At most so many rows as the policy and the request allow, and whether there are more."""
        most = self.policy.tightened(rows).rows
        df = self(table)
        got = (df.where(where) if where else df).limit(most + 1).collect()
        return self.spark.createDataFrame(got[:most], df.schema), len(got) > most

    def checked(self) -> list[str]:
        """What is wrong with the file at the start: nothing if its tables can be seen and it can't be written."""
        try:
            db = connected(self.path, self.policy.seconds)
        except sqlite3.Error as e:
            return [str(e)]
        try:
            if not db.execute("SELECT count(*) FROM sqlite_master WHERE type IN ('table', 'view')").fetchone()[0]:
                return ["no table is visible"]
            try:
                db.execute("CREATE TABLE _quarry_probe (x)")
                return ["the connection can write"]
            except sqlite3.OperationalError:
                return []
        except sqlite3.Error as e:
            return [str(e)]
        finally:
            db.close()

    def probe(self) -> DataFrame:
        """(table, column, type, rows) of everything in the file; rows are the database's estimates where it has them, else -1."""
        db = connected(self.path, self.policy.seconds)
        try:
            names = [r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type IN ('table', 'view') AND name NOT LIKE 'sqlite_%' ORDER BY 1")]
            known = dict(db.execute("SELECT tbl, CAST(max(stat) AS INTEGER) FROM sqlite_stat1 GROUP BY tbl").fetchall()) if db.execute("SELECT 1 FROM sqlite_master WHERE name = 'sqlite_stat1'").fetchone() else {}
            rows = [(n, c, k, int(known.get(n, -1))) for n in names for c, k in columns_of(db, n)]
        finally:
            db.close()
        return self.spark.createDataFrame(rows, "table string, column string, type string, rows long")

    def explain(self, sql: str) -> str:
        """The database's own plan of a statement that isn't run; statements that write or don't compile are refused."""
        db = connected(self.path, self.policy.seconds)
        try:
            return "\n".join(str(r[3]) for r in db.execute(f"EXPLAIN QUERY PLAN {sql}"))
        except (sqlite3.Error, sqlite3.Warning) as e:
            raise ValueError(str(e)) from None
        finally:
            db.close()

    def full_scans(self, sql: str) -> list[str]:
        """The tables that the database's plan of a statement reads from end to end, without an index."""
        return [line.split()[1] for line in self.explain(sql).splitlines() if line.startswith("SCAN ") and "INDEX" not in line]


def outside_top(df: DataFrame, text: str, question: str, top: int = 5) -> DataFrame:
    """(position, text, hits): the records with the most of the question's words; ties go by text.

    Each partition of the source gives its own best, so that the last step gets `top` rows of each.
    """
    from ..functions.text import terms

    asked = set(terms(question))

    def best(batches):
        held: dict[str, int] = {}
        for b in batches:
            for t in b.column("text").to_pylist():
                if n := len(asked & set(terms(t or ""))):
                    held[t] = n
            held = dict(sorted(held.items(), key=lambda x: (-x[1], x[0]))[:top])
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["text", "hits"])

    found = df.select(F.col(text).cast("string").alias("text")).mapInArrow(best, "text string, hits long").distinct().orderBy(F.desc("hits"), "text").limit(top)
    rows = found.agg(F.sort_array(F.collect_list(F.struct((-F.col("hits")).alias("h"), "text"))).alias("a")).select(F.posexplode("a").alias("position", "r"))
    return rows.select("position", "r.text", (-F.col("r.h")).alias("hits"))
