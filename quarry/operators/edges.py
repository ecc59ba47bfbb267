"""Edges between columns and tables: candidates, scores, bands, reviews, paths, and relevance of assets."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .profiling import AUDIT, CORRELATION_BANDS, LINEAGE_BANDS, OVERLAP_BANDS, bucket

#: Tokens of table names that say where a table lies and not what it holds.
LAYER = ("dws", "ads", "dwd", "ods", "dim", "t")
DOMAIN = ("off", "mkt", "fin", "hr", "msy", "app", "winc")
SUFFIX = ("dfn", "dnf", "fin", "min", "scd", "d", "m")


def banded(value: Column, bands) -> Column:
    out = None
    for least, c in bands:
        out = F.when(value >= least, c) if out is None else out.when(value >= least, c)
    return out


def normal(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def column_values(tables: dict[str, DataFrame], columns: dict[str, list[str]], most: int | None = 500) -> DataFrame:
    """(column, kind, value) of the distinct values of table.column, at most `most` of each by a hash of the value, or all.

    Equal values have equal hashes, so that columns of one domain keep the same values. Before a column's values are
    put in order, its share of hashes that holds some twice `most` of them is kept, so no task orders a large column.
    """
    out = None
    for table, df in tables.items():
        kinds = {f.name: bucket(f.dataType) for f in df.schema}
        cols = [c for c in columns[table] if kinds[c]]
        wide = df.select(*[F.nullif(F.col(c).cast("string"), F.lit("")).alias(c) for c in cols])
        long = wide.unpivot([], cols, "c", "value").where("value IS NOT NULL").distinct()
        kind = F.create_map(*[F.lit(x) for c in cols for x in (c, kinds[c])])
        part = long.select(F.concat(F.lit(f"{table}."), "c").alias("column"), kind[F.col("c")].alias("kind"), "value")
        out = part if out is None else out.unionByName(part)
    if most is None:
        return out
    share = out.groupBy("column").agg((F.lit(2.0 * most + 50) / F.count("*")).alias("_s"))
    out = out.join(share, "column").where(F.pmod(F.xxhash64("value"), F.lit(1 << 30)) / float(1 << 30) <= F.col("_s")).drop("_s")
    w = Window.partitionBy("column").orderBy(F.pmod(F.xxhash64("value"), F.lit(1 << 30)), "value")
    return out.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def joinable_edges(values: DataFrame, least_values: int = 3) -> DataFrame:
    """(left, right, overlap, confidence) of the columns of different tables that could be joined.

    Columns of one kind with enough values to tell; the overlap is by the smaller side, its band the confidence,
    with 0.05 more for equal names and 0.95 at most.
    """
    n = values.groupBy("column", "kind").agg(F.count("*").alias("n")).where(F.col("n") >= least_values)
    v = values.join(n.select("column"), "column", "left_semi")
    a = v.select(F.col("column").alias("left"), "kind", "value")
    b = v.select(F.col("column").alias("right"), "kind", "value")
    table = lambda c: F.substring_index(c, ".", 1)
    common = a.join(b, ["kind", "value"]).where((F.col("left") < F.col("right")) & (table(F.col("left")) != table(F.col("right")))).groupBy("left", "right").agg(F.count("*").alias("common"))
    both = common.join(n.select(F.col("column").alias("left"), F.col("n").alias("ln")), "left").join(n.select(F.col("column").alias("right"), F.col("n").alias("rn")), "right")
    overlap = F.col("common") / F.least("ln", "rn")
    same = normal(F.substring_index("left", ".", -1)) == normal(F.substring_index("right", ".", -1))
    return both.select("left", "right", F.round(overlap, 6).alias("overlap"), F.when(overlap >= OVERLAP_BANDS[-1][0], F.least(F.lit(0.95), F.round(banded(overlap, OVERLAP_BANDS) + F.when(same, 0.05).otherwise(0.0), 2))).alias("confidence")).where("confidence IS NOT NULL")


def name_likeness(a: Column, b: Column) -> Column:
    """1 for equal names, 0.5 and half the ratio of lengths for one within the other, else the letters in common."""
    ratio = F.least(F.length(a), F.length(b)) / F.greatest(F.length(a), F.length(b))
    letters = lambda c: F.array_distinct(F.filter(F.split(c, ""), lambda x: x != ""))
    shared = F.size(F.array_intersect(letters(a), letters(b))) / F.size(F.array_union(letters(a), letters(b)))
    return F.when(a == b, 1.0).when(F.contains(a, b) | F.contains(b, a), 0.5 + 0.5 * ratio).otherwise(shared)


def synonym_edges(columns: DataFrame) -> DataFrame:
    """(left, right, similarity, confidence) of columns (column, name, comment) that mean the same under other names.

    Equal comments are found by a join, like names by a join on their first letter or the comment's.
    """
    c = columns.select("column", normal(F.col("name")).alias("n"), F.trim(F.coalesce("comment", F.lit(""))).alias("comment"))
    keyed = c.withColumn("_k", F.explode(F.array_distinct(F.concat(F.transform(F.split("n", ""), lambda x: F.concat(F.lit("n"), x)), F.array(F.concat(F.lit("c"), F.col("comment"))))))).where("_k NOT IN ('n', 'c')")
    a = keyed.select("_k", F.col("column").alias("left"), F.col("n").alias("ln"), F.col("comment").alias("lc"))
    b = keyed.select("_k", F.col("column").alias("right"), F.col("n").alias("rn"), F.col("comment").alias("rc"))
    pairs = a.join(b, "_k").where("left < right AND ln <> rn").drop("_k").distinct().withColumn("similarity", F.round(name_likeness(F.col("ln"), F.col("rn")), 6))
    told = (F.col("lc") != "") & (F.col("lc") == F.col("rc"))
    s = F.col("similarity")
    return pairs.select("left", "right", "similarity", F.when(told & (s > 0.5), 0.95).when(told, 0.85).when(s > 0.7, 0.6).when(s > 0.5, 0.4).alias("confidence")).where("confidence IS NOT NULL")


def distribution_edges(values: DataFrame, counts: DataFrame, top: int = 10, least: float = 0.5) -> DataFrame:
    """(left, right, similarity) of columns of different tables whose frequent values are alike.

    counts has column, value, n. The similarity is the ratio of the distinct counts times the overlap of the top
    values' shares.
    """
    d = values.groupBy("column", "kind").agg(F.count("*").alias("d"))
    ranked = counts.withColumn("_r", F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "value"))).where(F.col("_r") <= top)
    share = ranked.withColumn("w", F.col("n") / F.sum("n").over(Window.partitionBy("column"))).join(d, "column")
    a = share.select(F.col("column").alias("left"), "kind", "value", F.col("w").alias("lw"), F.col("d").alias("ld"))
    b = share.select(F.col("column").alias("right"), "kind", "value", F.col("w").alias("rw"), F.col("d").alias("rd"))
    table = lambda c: F.substring_index(c, ".", 1)
    both = a.join(b, ["kind", "value"]).where((F.col("left") < F.col("right")) & (table(F.col("left")) != table(F.col("right"))))
    out = both.groupBy("left", "right").agg(F.round(F.first(F.least("ld", "rd") / F.greatest("ld", "rd")) * F.sum(F.least("lw", "rw")), 6).alias("similarity"))
    return out.where(F.col("similarity") >= least)


def correlated_edges(df: DataFrame, table: str, columns: list[str], most: int = 8, least: int = 30) -> DataFrame:
    """(left, right, r, confidence) of the numeric columns of one table that go together, from one aggregate."""
    cols = [c for c in columns if bucket(df.schema[c].dataType) == "numeric"][:most]
    pairs = [(a, b) for k, a in enumerate(cols) for b in cols[k + 1 :]]
    aggs = [F.when(F.count_if(F.col(a).isNotNull() & F.col(b).isNotNull()) >= least, F.corr(F.col(a).cast("double"), F.col(b).cast("double"))).alias(f"p{k}") for k, (a, b) in enumerate(pairs)]
    long = df.agg(*aggs).select(F.explode(F.array(*[F.struct(F.lit(f"{table}.{a}").alias("left"), F.lit(f"{table}.{b}").alias("right"), F.round(F.col(f"p{k}"), 6).alias("r")) for k, (a, b) in enumerate(pairs)])).alias("e")).select("e.*")
    return long.withColumn("confidence", banded(F.abs("r"), CORRELATION_BANDS)).where("confidence IS NOT NULL")


def table_core(name: str) -> list[str]:
    """What a table's name says of its content: words without layers and domains before and suffixes behind, in the singular."""
    t = name.lower().split("_")
    while t and t[0] in LAYER + DOMAIN:
        t = t[1:]
    while t and t[-1] in SUFFIX:
        t = t[:-1]
    return [re.sub(r"(?<=...)(?<![su])s$", "", w) for w in t if w]


def lineage_edges(columns: DataFrame, tables: DataFrame, joinable: DataFrame | None = None, least_shared: int = 2, least_joinable: float = 0.9) -> DataFrame:
    """(left, right, shared, ratio, confidence) of tables of which one may feed the other.

    columns has table, column, comment, kind; tables has table, domain, core (its words), mentions (tables that its
    description names). The share of the smaller table's columns in common, without those for audit, gives a band; a
    mention counts 0.85; equal comments add up to 0.1, a joinable edge (left, right as table.column, confidence) of
    `least_joinable` between the tables 0.1, one domain and related names 0.05 each, and 0.95 is the most. What is
    added makes no edge of its own, and fewer common columns than `least_shared` make none.
    """
    c = columns.where(~F.lower("column").isin(*AUDIT)).select("table", F.lower("column").alias("column"), F.trim(F.coalesce("comment", F.lit(""))).alias("comment")).distinct()
    n = c.groupBy("table").agg(F.count("*").alias("n"))
    a, b = (c.select(F.col("table").alias(s), "column", F.col("comment").alias(f"{s}_c")) for s in ("left", "right"))
    shared = a.join(b, "column").where("left < right").groupBy("left", "right").agg(F.count("*").alias("shared"), F.count_if((F.col("left_c") != "") & (F.col("left_c") == F.col("right_c"))).alias("told"))
    t = tables.select("table", "domain", "core", "mentions").join(n, "table")
    side = lambda s: t.select(*[F.col(x).alias(s if x == "table" else f"{s}_{x}") for x in ("table", "domain", "core", "mentions", "n")])
    named = tables.select(F.col("table").alias("x"), F.explode("mentions").alias("y")).where("x <> y").select(F.least("x", "y").alias("left"), F.greatest("x", "y").alias("right")).distinct().withColumn("mention", F.lit(True))
    pairs = shared.join(named, ["left", "right"], "full").join(side("left"), "left").join(side("right"), "right").withColumn("joined", F.lit(False))
    if joinable is not None:
        of = lambda c: F.substring_index(c, ".", 1)
        sure = joinable.where(F.col("confidence") >= least_joinable).select(F.least(of("left"), of("right")).alias("left"), F.greatest(of("left"), of("right")).alias("right")).distinct().withColumn("_j", F.lit(True))
        pairs = pairs.join(sure, ["left", "right"], "left").withColumn("joined", F.coalesce("_j", F.lit(False)))
    s = F.coalesce("shared", F.lit(0))
    ratio = s / F.least("left_n", "right_n")
    base = F.when(F.col("mention"), 0.85).otherwise(F.when(s >= least_shared, banded(ratio, LINEAGE_BANDS)))
    related = (F.size("left_core") > 0) & (F.size("right_core") > 0) & ((F.size(F.array_except("left_core", "right_core")) == 0) | (F.size(F.array_except("right_core", "left_core")) == 0))
    more = F.when(F.col("joined"), 0.1).otherwise(0.0) + F.when(s > 0, 0.1 * F.coalesce("told", F.lit(0)) / s).otherwise(0.0) + F.when(F.col("left_domain") == F.col("right_domain"), 0.05).otherwise(0.0) + F.when(related, 0.05).otherwise(0.0)
    return pairs.select("left", "right", s.alias("shared"), F.round(ratio, 6).alias("ratio"), F.when(base.isNotNull(), F.least(F.lit(0.95), F.round(base + more, 4))).alias("confidence")).where("confidence IS NOT NULL")


def review_paths(edges: DataFrame, start: str, goal: str, most: int = 500) -> DataFrame:
    """(a, via, b) of the ways of one or two edges from start to goal, over the `most` surest edges."""
    kept = edges.orderBy(F.desc("confidence"), "left", "right").limit(most)
    both = kept.select(F.col("left").alias("a"), F.col("right").alias("b")).unionByName(kept.select(F.col("right").alias("a"), F.col("left").alias("b"))).distinct()
    one = both.where((F.col("a") == start) & (F.col("b") == goal)).select("a", F.lit(None).cast("string").alias("via"), "b")
    two = both.where(F.col("a") == start).select("a", F.col("b").alias("via")).join(both.where(F.col("b") == goal).select(F.col("a").alias("via"), "b"), "via").select("a", "via", "b")
    return one.unionByName(two.join(one.agg(F.count("*").alias("_n")).where("_n > 0"), F.lit(True), "left_anti"))


def asset_scores(questions: DataFrame, assets: DataFrame, default: str, most: int = 8) -> DataFrame:
    """(q_id, asset, score): assets (asset, domain, text) by what of the question stands in them.

    32 for the domain's name, the length of the longest run of 2 to `most` characters that stands in the text, 40
    more for the default table where anything else speaks for it. Runs meet by an equality join.
    """
    grams = lambda c, n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(n)))
    runs = lambda df, key, c: df.select(key, F.explode(F.array_distinct(F.concat(*[grams(F.lower(c), n) for n in range(2, most + 1)]))).alias("run")).where(F.length("run") >= 2)
    found = runs(questions, "q_id", "question").join(runs(assets, "asset", "text"), "run").groupBy("q_id", "asset").agg(F.max(F.length("run")).alias("_w"))
    named = questions.select("q_id", "question").join(F.broadcast(assets.select("domain").distinct()), F.contains(F.lower("question"), F.lower("domain"))).select("q_id", "domain").join(assets.select("asset", "domain"), "domain").select("q_id", "asset", F.lit(32).alias("_d"))
    both = found.join(named, ["q_id", "asset"], "full")
    return both.select("q_id", "asset", (F.coalesce("_w", F.lit(0)) + F.coalesce("_d", F.lit(0)) + F.when(F.col("asset") == default, 40).otherwise(0)).alias("score"))


def nearest_exemplar(exemplars: DataFrame, question: list[float], top: int = 8, most: float = 0.35) -> DataFrame:
    """(id, distance): the exemplars (id, embedding, enabled, valid) nearest to a question's vector by cosine distance, of those enabled and valid."""
    from .retrieval import vector_route

    return vector_route(exemplars.where("enabled AND valid"), question, top, math.nextafter(most, 2), "embedding", "id")


def code_columns(tables: dict[str, DataFrame], candidates: DataFrame, least: int = 2, most: int = 60) -> DataFrame:
    """(table, column, distinct) of candidate columns (table, column) that hold from `least` to `most` different values.

    Which columns are candidates is a matter of the schemas, and so few that the driver plans their scan.
    """
    columns: dict[str, list[str]] = {}
    for r in candidates.select("table", "column").distinct().collect():
        columns.setdefault(r["table"], []).append(r["column"])
    if not columns:
        return candidates.select("table", "column", F.lit(0).cast("long").alias("distinct")).limit(0)
    n = column_values({t: tables[t] for t in columns}, columns, None).groupBy("column").agg(F.count("*").alias("distinct"))
    return n.where(F.col("distinct").between(least, most)).select(F.substring_index("column", ".", 1).alias("table"), F.substring_index("column", ".", -1).alias("column"), "distinct")


def join_evidence(edges: DataFrame, tables: list[str], least: float = 0.9, top: int = 10) -> DataFrame:
    """Joinable edges of at least `least` with both ends among the candidate tables, the surest of each pair of tables."""
    table = lambda c: F.substring_index(c, ".", 1)
    e = edges.where((F.col("confidence") >= least) & table(F.col("left")).isin(*tables) & table(F.col("right")).isin(*tables))
    w = Window.partitionBy(table(F.col("left")), table(F.col("right"))).orderBy(F.desc("confidence"), "left", "right")
    return e.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= top)


def candidate_columns(columns: DataFrame, suffixes: tuple[str, ...] = ("type", "status", "flag", "code", "level", "kind")) -> DataFrame:
    """Columns (table, column, kind, comment) that may hold codes: of text or whole numbers, with such a name, not for audit."""
    name = F.lower("column")
    ends = None
    for s in suffixes:
        ends = F.endswith(name, F.lit(s)) if ends is None else ends | F.endswith(name, F.lit(s))
    return columns.where(ends & ~name.isin(*AUDIT) & F.col("kind").isin("string", "numeric"))


def dictionary_match(values: DataFrame, dictionaries: DataFrame) -> DataFrame:
    """(column, dict, hits, coverage): the dictionary (dict, name, code) whose codes a column (column, comment, value) holds.

    2 to 60 distinct values, 0.8 of them covered; a dictionary that the column's name or comment names comes first;
    another needs all of eight or more values, or three characters of its name in the comment.
    """
    v = values.select("column", F.col("value").cast("string").alias("code"), "comment").distinct()
    n = v.groupBy("column").agg(F.count("*").alias("n"), F.first("comment").alias("comment")).where("n BETWEEN 2 AND 60")
    d = dictionaries.select("dict", "name", "code").distinct()
    hit = v.join(n.select("column"), "column", "left_semi").join(d, "code").groupBy("column", "dict").agg(F.count("*").alias("hits"), F.first("name").alias("name"))
    got = hit.join(n, "column").withColumn("coverage", F.round(F.col("hits") / F.col("n"), 6)).where("coverage >= 0.8")
    text = F.lower(F.concat_ws(" ", "column", "comment"))
    named = F.contains(text, F.lower("dict")) | F.contains(text, F.lower("name"))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length("name") - 2, F.lit(1))), lambda i: F.substring(F.lower(F.col("name")), i, F.lit(3)))
    close = F.exists(grams, lambda g: (F.length(g) == 3) & F.contains(text, g))
    ok = got.withColumn("_named", named).where(F.col("_named") | ((F.col("coverage") == 1) & (F.col("n") >= 8)) | close)
    best = Window.partitionBy("column").orderBy(F.desc("_named"), F.desc("coverage"), F.desc("hits"), "dict")
    return ok.withColumn("_r", F.row_number().over(best)).where("_r = 1").select("column", "dict", "hits", "coverage")


def rolled_back(rules: DataFrame, log: DataFrame, streak: int = 3) -> DataFrame:
    """Rules (rule, batch, status) after learning batches that failed are rolled back.

    log has batch, seq, ok. A batch is rolled back if its last `streak` runs all failed; its rules get status
    rolled_back, others keep theirs.
    """
    w = Window.partitionBy("batch").orderBy(F.desc("seq"))
    last = log.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= streak)
    bad = last.groupBy("batch").agg(F.count("*").alias("_runs"), F.count_if("ok").alias("_ok")).where((F.col("_runs") == streak) & (F.col("_ok") == 0)).select("batch", F.lit(True).alias("_bad"))
    return rules.join(bad, "batch", "left").withColumn("status", F.when(F.col("_bad"), "rolled_back").otherwise(F.col("status"))).drop("_bad")
