"""Table sources, schema probes, typed statements and column inference."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


class ParquetSource:
    """A folder of Parquet tables; frames are read when asked for."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def __call__(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{table}.parquet")

    def counts(self, tables=TABLES) -> DataFrame:
        """(table_name, row_count) of the tables, from the files' footers."""
        out = None
        for t in tables:
            part = self(t).agg(F.count("*").alias("row_count")).select(F.lit(t).alias("table_name"), "row_count")
            out = part if out is None else out.unionByName(part)
        return out

    def probe(self, tables=TABLES) -> DataFrame:
        rows = [(t, f.name, f.dataType.simpleString(), k, f.metadata.get("comment")) for t in tables for k, f in enumerate(self(t).schema)]
        return self.spark.createDataFrame(rows, "table_name string, column_name string, data_type string, ordinal int, comment string")


class JdbcSource:
    def __init__(self, spark: SparkSession, url: str, **options):
        self.spark, self.url, self.options = spark, url, options

    def __call__(self, table: str) -> DataFrame:
        return self.spark.read.format("jdbc").options(url=self.url, dbtable=table, **self.options).load()


def hide_login(url: str) -> str:
    """A connection string without its password."""
    return re.sub(r"(?i)(password|pwd)=[^&;\s]*", r"\1=***", re.sub(r"(//[^:/@\s]+):[^@\s]*@", r"\1:***@", url))


def safe_columns(names: list[str]) -> list[str]:
    """Identifiers from headers; repeats get _2, _3 and so on."""
    out: list[str] = []
    for n in names:
        base = re.sub(r"\W+", "_", n.strip()).strip("_").lower() or "col"
        base = f"c_{base}" if base[0].isdigit() else base
        name, k = base, 2
        while name in out:
            name, k = f"{base}_{k}", k + 1
        out.append(name)
    return out


#: Plain numbers, unlike codes with leading zeros or over 15 digits; civil dates with an optional time.
NUMBER = r"^-?(0|[1-9]\d{0,14})(\.\d+)?$"
CIVIL = r"^\d{4}[-/]\d{1,2}[-/]\d{1,2}([ T]\d{1,2}:\d{2}(:\d{2})?)?$"


def infer_types(df: DataFrame) -> dict[str, str]:
    """numeric, timestamp or text for each string column, from one aggregate over all rows; blanks are ignored."""
    aggs = []
    for c in df.columns:
        v = F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
        aggs += [F.count(v).alias(f"{c}|n"), F.min(v.rlike(NUMBER)).alias(f"{c}|num"), F.min(v.rlike(CIVIL)).alias(f"{c}|civ")]
    r = df.agg(*aggs).first()
    return {c: "text" if not r[f"{c}|n"] else "numeric" if r[f"{c}|num"] else "timestamp" if r[f"{c}|civ"] else "text" for c in df.columns}


def typed(df: DataFrame, most_rows: int = 200_000, most_columns: int = 200) -> DataFrame:
    """An uploaded sheet with typed columns; larger ones than the bounds are refused."""
    if len(df.columns) > most_columns or df.limit(most_rows + 1).count() > most_rows:
        raise ValueError(f"a sheet has at most {most_rows} rows and {most_columns} columns")
    kinds = infer_types(df)
    cast = {"numeric": lambda c: F.col(c).cast("decimal(38,6)"), "timestamp": lambda c: F.to_timestamp(F.regexp_replace(c, "/", "-")), "text": F.col}
    return df.select(*[cast[kinds[c]](c).alias(c) for c in df.columns])
