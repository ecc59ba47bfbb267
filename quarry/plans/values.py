"""Filters from words of a question, qualifiers, document codes, labels for people, and statements with parameters."""

from __future__ import annotations

import re
from dataclasses import replace
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .model import PlanError, QuerySpec, Registry


def value_filters(questions: DataFrame, values: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """(q_id, table, column, name, code): the values that a question (q_id, question) names.

    values has table, column, name, code, kind. Names of two characters or more count, of kind eq; one that stands
    for several (table, column, code) says nothing; of names within one another the longest counts, and so none that
    lies in a metric's or dimension's word (column word). Names meet questions by an equality join of their first
    two characters, so neither side need be small.
    """
    known = values.where("kind = 'eq' AND length(name) >= 2")
    sole = known.groupBy("name").agg(F.countDistinct("table", "column", "code").alias("_n"), F.first("table").alias("table"), F.first("column").alias("column"), F.first("code").alias("code")).where("_n = 1").drop("_n")
    found = holding(questions, sole)
    longer = found.select("q_id", F.col("name").alias("_name"))
    if words is not None:
        longer = longer.unionByName(holding(questions, words.select(F.col("word").alias("name"))).select("q_id", F.col("name").alias("_name")))
    inside = (F.length("_name") > F.length("name")) & F.contains(F.lower("_name"), F.lower("name"))
    same = longer.withColumnRenamed("q_id", "_q")
    return found.join(same, (F.col("q_id") == F.col("_q")) & inside, "left_anti").drop("question")


def holding(questions: DataFrame, names: DataFrame) -> DataFrame:
    """Questions with each of the names that they contain, case aside."""
    q = F.lower("question")
    pairs = questions.withColumn("_k", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(q) - 1, F.lit(1))), lambda i: F.substring(q, i, F.lit(2))))))
    return pairs.join(names.withColumn("_k", F.substring(F.lower("name"), 1, 2)), "_k").where(F.contains(q, F.lower("name"))).drop("_k").distinct()


def with_values(registry: Registry, spec: QuerySpec, named: list[tuple[str, str]]) -> QuerySpec:
    """The specification with (dimension, value) filters; refused where a dimension is filtered already or out of reach."""
    for name, value in named:
        if name in {k for k, _ in (*spec.equals, *spec.contains)}:
            raise PlanError(f"{name} is filtered already")
        table = registry.metrics[spec.metrics[0]].table
        way = registry.path(table, registry.dimensions[name].table)
        if way is None or any(fans for _, fans in way):
            raise PlanError(f"{name} can't be reached from {table} without repeating rows")
        spec = replace(spec, equals=(*spec.equals, (name, (value,))))
    return spec


def qualifiers(questions: DataFrame, places: DataFrame) -> DataFrame:
    """(q_id, status, place): the one place that a question names; status none, one, or conflict for several."""
    hits = value_filters(questions, places.select(F.lit("place").alias("table"), F.lit("place").alias("column"), F.col("name"), F.col("code"), F.lit("eq").alias("kind")))
    got = hits.groupBy("q_id").agg(F.countDistinct("code").alias("_n"), F.min("code").alias("_c"))
    n = F.coalesce("_n", F.lit(0))
    return questions.select("q_id").join(got, "q_id", "left").select("q_id", F.when(n == 0, "none").when(n == 1, "one").otherwise("conflict").alias("status"), F.when(n == 1, F.col("_c")).alias("place"))


def fragment_rows(rows: DataFrame, key: str, goods: DataFrame, goods_key: str, name: str, fragment: str, most: int = 2000) -> DataFrame:
    """The rows whose goods have a fragment in their name; refused if no goods have it, or more than `most`."""
    hit = goods.where(F.contains(F.lower(F.trim(name)), F.lit(fragment.strip().lower()))).select(F.col(goods_key).alias("_k")).distinct()
    n = hit.limit(most + 1).count()
    if not fragment.strip() or not 0 < n <= most:
        raise PlanError(f"{fragment!r} names {n} goods")
    return rows.join(F.broadcast(hit), F.col(key) == F.col("_k"), "left_semi")


def presented(df: DataFrame, names: dict[str, str], labels: DataFrame | None = None, coded: dict[str, str] | None = None, separator: str = ",") -> DataFrame:
    """Columns under their names for people, and codes as labels.

    labels has kind, code, label; coded gives the kind of a column's codes. A cell with several codes between
    separators is translated code by code; an unknown code stays.
    """
    for column, kind in (coded or {}).items():
        # the distinct cells are translated, by a join of their codes, and meet the rows again as a table of cells
        cell = F.col(column).cast("string").alias("_cell")
        codes = df.select(cell).where("_cell IS NOT NULL").distinct().select("_cell", F.posexplode(F.split("_cell", separator)).alias("_k", "_code"))
        told = labels.where(F.col("kind") == kind).groupBy("code").agg(F.max("label").alias("_label"))
        known = codes.join(told, F.trim("_code") == F.col("code"), "left").groupBy("_cell").agg(F.sort_array(F.collect_list(F.struct("_k", F.coalesce("_label", F.trim("_code")).alias("t")))).alias("_t"))
        known = known.select("_cell", F.array_join(F.col("_t.t"), separator).alias("_text"))
        df = df.join(known, F.col(column).cast("string") == F.col("_cell"), "left").withColumn(column, F.col("_text")).drop("_cell", "_text")
    return df.withColumnsRenamed(names)


def resolved_codes(texts: DataFrame, known: DataFrame, least: int = 4) -> DataFrame:
    """(id, code, document): codes in texts (id, text) resolved by known documents (code, document).

    A code is a run of letters, digits and hyphens with a digit; it means the document with the same code, or
    else the only one whose code it begins.
    """
    found = texts.select("id", F.explode(F.array_distinct(F.regexp_extract_all(F.upper("text"), F.lit(r"([A-Z0-9][A-Z0-9-]*[0-9][A-Z0-9-]*)")))).alias("code")).where(F.length("code") >= least)
    k = known.select(F.upper("code").alias("_full"), "document").distinct()
    exact = found.join(k, F.col("code") == F.col("_full")).select("id", "code", "document")
    begins = k.withColumn("_part", F.explode(F.transform(F.sequence(F.lit(least), F.greatest(F.length("_full") - 1, F.lit(least))), lambda n: F.substring("_full", F.lit(1), n)))).where(F.length("_part") < F.length("_full"))
    rest = found.join(exact.select("id", "code"), ["id", "code"], "left_anti").join(begins.distinct(), F.col("code") == F.col("_part"))
    one = rest.groupBy("id", "code").agg(F.countDistinct("document").alias("_n"), F.min("document").alias("document")).where("_n = 1").drop("_n")
    return exact.unionByName(one)


def statement(spark: SparkSession, template: str, tables: dict[str, DataFrame], **values) -> DataFrame:
    """A fixed statement with {table} places and :name parameters; a list fills `IN (:name)`, a date a DATE place.

    Values reach Spark as parameters and never as text; a parameter without a value, or a value without a
    parameter, is refused.
    """
    asked = set(re.findall(r"(?<!:):([A-Za-z_]\w*)", re.sub(r"'(?:[^']|'')*'", "''", template)))
    if asked != set(values):
        raise PlanError(f"parameters {sorted(asked ^ set(values))} don't match")
    args: dict = {}
    for name, v in values.items():
        if isinstance(v, (list, tuple)):
            if not v:
                raise PlanError(f"{name} is an empty list")
            template = re.sub(rf":{name}\b", ", ".join(f":{name}_{k}" for k in range(len(v))), template)
            args |= {f"{name}_{k}": x for k, x in enumerate(v)}
        else:
            args[name] = v
    if bad := [n for n, v in args.items() if not isinstance(v, (int, float, str, date, datetime, bool))]:
        raise PlanError(f"no plain value for {bad}")
    return spark.sql(template, args=args, **tables)


def time_slot(template: str, column: str) -> str:
    """A template whose {time} places are filled by a column's name, which must be a plain one."""
    if not re.fullmatch(r"[A-Za-z_]\w*(\.[A-Za-z_]\w*)?", column):
        raise PlanError(f"{column!r} isn't a column")
    return template.replace("{time}", column)


def schema_problems(spark: SparkSession, sql: str) -> list[str]:
    """Unknown tables and columns of a statement, as Spark's analyser names them; none if it resolves."""
    from pyspark.errors import AnalysisException

    try:
        spark.sql(sql)
    except AnalysisException as e:
        return [f"{e.getCondition()}: {next(iter((e.getMessageParameters() or {}).values()), '')}"]
    return []


def top_sample(df: DataFrame, order: list[Column], most: int = 20) -> DataFrame:
    """The first rows for a prompt or a page, with the number of all rows beside them."""
    n = df.agg(F.count("*").alias("row_count"))
    return df.orderBy(*order).limit(most).crossJoin(F.broadcast(n))


def latest_overall(df: DataFrame, *order: str) -> DataFrame:
    """The one latest row of a table, by one aggregate."""
    return df.agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("_r")).select("_r.*")


def latest_flag(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("is_latest", F.row_number().over(w) == 1)
