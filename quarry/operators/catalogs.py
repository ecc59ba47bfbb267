"""Cards, snapshots and groupings of metadata: metric recall, table relations, schema upkeep, title families."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The scores of the recall routes, and the kinds of statistical edges.
FORCED, VECTOR = 1.0, 0.9
STATISTICAL = ("joinable", "synonym", "distribution_similar")


#: Up to so many words go to the questions by a broadcast; beyond, words and questions meet by a shuffle.
WORDS = 10_000


def with_words(questions: DataFrame, words: DataFrame) -> DataFrame:
    """The questions (q_id, question) with the words (word, ...) that stand in them, both in lower case.

    Questions and words meet by an equality join of a word's first two characters. Few words are broadcast, so that
    the questions, of which common beginnings make many rows each, stay where they are; these rows are never broadcast,
    as Spark would choose by the size of the questions' files.
    """
    q = F.lower("question")
    starts = F.transform(F.sequence(F.lit(1), F.greatest(F.length(q), F.lit(1))), lambda i: F.array(F.substring(q, i, F.lit(1)), F.substring(q, i, F.lit(2))))
    keyed = questions.select("q_id", "question", F.explode(F.array_distinct(F.flatten(starts))).alias("_k"))
    keys = words.withColumn("_k", F.substring(F.lower("word"), 1, 2))
    few = len(words.select(F.lit(1)).take(WORDS + 1)) <= WORDS
    return keyed.join(F.broadcast(keys) if few else keys.hint("merge"), "_k").where(F.contains(q, F.lower("word"))).drop("_k", "question")


def metric_hits(questions: DataFrame, metrics: DataFrame) -> DataFrame:
    """(q_id, name, hit_word) of the active metrics (name, aliases, status) whose name or alias a question (q_id, question) has.

    A metric counts with its longest word found; a hit goes if another metric of the question has a longer word
    that contains it. What one question has is gathered by one aggregate and compared in its row; questions without an
    id aren't compared.
    """
    words = metrics.where("status = 'active'").select("name", F.explode(F.array_distinct(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("word")).where("trim(word) <> ''")
    found = with_words(questions, words).groupBy("q_id").agg(F.collect_set(F.struct(F.length("word").alias("n"), "word", "name")).alias("x"))
    longest = found.withColumn("x", F.filter("x", lambda h: ~F.exists("x", lambda o: o["name"].eqNullSafe(h["name"]) & ((o["n"] > h["n"]) | ((o["n"] == h["n"]) & (o["word"] > h["word"]))))))
    inside = lambda h: F.exists("x", lambda o: (o["n"] > h["n"]) & F.contains(F.lower(o["word"]), F.lower(h["word"])))
    hits = longest.select("q_id", F.explode(F.when(F.col("q_id").isNull(), F.col("x")).otherwise(F.filter("x", lambda h: ~inside(h)))).alias("h"))
    return hits.select("q_id", "h.name", F.col("h.word").alias("hit_word"))


def cards(questions: DataFrame, entries: DataFrame, top: int = 10) -> DataFrame:
    """(q_id, kind, word, note, rank): of each kind the entries (kind, word, note) whose word a question has, the longest first."""
    found = with_words(questions, entries).select("q_id", "kind", "word", "note").groupBy("q_id", "kind").agg(F.collect_set(F.struct((-F.length("word")).alias("n"), "word", "note")).alias("x"))
    ranked = found.select("q_id", "kind", F.posexplode(F.slice(F.array_sort("x"), 1, top)).alias("p", "c"))
    return ranked.select("q_id", "kind", "c.word", "c.note", (F.col("p") + 1).cast("long").alias("rank"))


def table_recall(forced: DataFrame, near: DataFrame, similar: DataFrame, limit: int) -> DataFrame:
    """(q_id, table, score, route) of each question's tables: all forced ones, then the nearest, then the most similar.

    forced has q_id, table; near and similar have q_id, table, score. A table counts for its first route, and one
    place is kept for the last; forced tables aren't counted against the limit.
    """
    routes = forced.select("q_id", "table", F.lit(FORCED).alias("score"), F.lit(0).alias("route"))
    first = Window.partitionBy("q_id").orderBy(F.desc("score"), "table")
    vector = near.join(forced, ["q_id", "table"], "left_anti").withColumn("_n", F.row_number().over(first)).where(F.col("_n") < limit)
    vector = vector.select("q_id", "table", F.lit(VECTOR).alias("score"), F.lit(1).alias("route"))
    taken = routes.unionByName(vector).select("q_id", "table")
    used = vector.groupBy("q_id").agg(F.count("*").alias("_used"))
    trigram = similar.join(taken, ["q_id", "table"], "left_anti").withColumn("_n", F.row_number().over(first)).join(used, "q_id", "left")
    trigram = trigram.where(F.col("_n") + F.coalesce("_used", F.lit(0)) <= limit).select("q_id", "table", "score", F.lit(2).alias("route"))
    return routes.distinct().unionByName(vector).unionByName(trigram)


def relation_cards(edges: DataFrame, top: int = 10) -> DataFrame:
    """(table, section, other, confidence, rank): what each table is related to, from both ends of every edge.

    edges has left_table, right_table, kind, confidence, status, seen. Contracts need status active; lineage and
    statistical edges anything but rejected. Statistical edges and co-occurrences keep the `top` of each table.
    """
    ok = F.when(F.col("kind") == "contract", F.col("status") == "active").otherwise(F.col("status") != "rejected")
    live = edges.where(ok)
    group = F.when(F.col("kind").isin(*STATISTICAL), "stat_edges").when(F.col("kind") == "contract", "contracts").when(F.col("kind") == "co_occurs", "co_occurs")
    seen = ["confidence", "seen"]
    left = live.select(F.col("left_table").alias("table"), F.col("right_table").alias("other"), *seen, F.coalesce(group, F.lit("lineage_sources")).alias("section"))
    right = live.select(F.col("right_table").alias("table"), F.col("left_table").alias("other"), *seen, F.coalesce(group, F.lit("lineage_consumers")).alias("section"))
    order = Window.partitionBy("table", "section").orderBy(F.desc("confidence"), F.desc("seen"), "other")
    ranked = left.unionByName(right).withColumn("rank", F.row_number().over(order).cast("long"))
    return ranked.where(~F.col("section").isin("stat_edges", "co_occurs") | (F.col("rank") <= top)).select("table", "section", "other", "confidence", "rank")


def synced(old: DataFrame, new: DataFrame) -> DataFrame:
    """The schema table after a sync: (table, column, type, comment, change).

    Both have table, column, type, comment. What the source no longer has is pruned; a comment that a person
    wrote outlasts an empty one; change says added, changed or same.
    """
    o = old.select("table", "column", F.col("type").alias("_type"), F.col("comment").alias("_comment"), F.lit(True).alias("_old"))
    comment = F.coalesce(F.nullif(F.trim("comment"), F.lit("")), F.col("_comment"), F.lit(""))
    change = F.when(F.col("_old").isNull(), "added").when(F.col("type") != F.col("_type"), "changed").otherwise("same")
    return new.join(o, ["table", "column"], "left").select("table", "column", "type", comment.alias("comment"), change.alias("change"))


def schema_rows(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, column, type, comment) of the tables' schemas, for synced()."""
    spark = next(iter(tables.values())).sparkSession
    rows = [(name, f.name, f.dataType.simpleString(), f.metadata.get("comment", "")) for name, df in sorted(tables.items()) for f in df.schema]
    return spark.createDataFrame(rows, "table string, column string, type string, comment string")


def save_snapshot(catalog: DataFrame, path: str) -> None:
    catalog.write.mode("overwrite").parquet(path)


def with_fallback(spark, probe, path: str) -> tuple[DataFrame, str]:
    """The live catalogue and trust `live`, after saving it; the last snapshot and `snapshot` if the probe fails.

    Without a snapshot the probe's own error is raised.
    """
    try:
        live = probe()
        save_snapshot(live, path)
        return spark.read.parquet(path), "live"
    except Exception as error:
        try:
            return spark.read.parquet(path), "snapshot"
        except Exception:
            raise error from None


def title_family(name: str) -> F.Column:
    """A title's first run of up to eight letters before a digit, bracket, dash or blank; else its first two letters."""
    stem = F.trim(F.regexp_replace(name, r"\.[^.]*$", ""))
    run = F.substring(F.regexp_replace(F.regexp_extract(stem, r"^[^0-9(（\[【\-_ ·—]*", 0), r"[!-/:-@\[-`{-~]", ""), 1, 8)
    short = F.substring(F.regexp_replace(stem, r"[^\p{L}\p{N}]", ""), 1, 2)
    family = F.when(F.length(run) >= 2, run).otherwise(short)
    return F.when(family == "", "other").otherwise(family)


def title_groups(docs: DataFrame, name: str, key: str, size: int = 12) -> DataFrame:
    """(key, folder, family, part): documents of a folder by title family; families over `size` are cut in parts."""
    of = docs.select(F.col(key), "folder", F.col(name).alias("_name"), title_family(name).alias("family"))
    order = Window.partitionBy("folder", "family").orderBy("_name", key)
    return of.withColumn("part", F.floor((F.row_number().over(order) - 1) / size).cast("long")).drop("_name")
