"""Title, metadata, relation and external routes, fusion in two passes, versions, citations and chunk graphs."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The weights of the auxiliary routes; body routes weigh 1. The markers of old and current versions.
AUXILIARY = {"metadata": 0.2, "relation": 0.25, "graph": 0.3, "external": 0.2}
OLD = ("旧版", "历史版", "历史口径", "废止")
CURRENT = ("新版", "现行版", "现行口径", "修订版")
#: Markers in English, for callers who want them besides.
OLD_ENGLISH = ("old version", "superseded")
CURRENT_ENGLISH = ("current version", "in force")
RRF_K = 60


def trigram_set(text: Column) -> Column:
    """The distinct trigrams of a text's words, each word set off by two spaces before and one behind it."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    grams = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def title_similarity(title: Column, question: str) -> Column:
    """Share of the question's trigrams and the title's that both have; each set is made once a title, and the common ones are counted once."""
    sets = F.array(F.struct(trigram_set(title).alias("a"), trigram_set(F.lit(question)).alias("b")))
    sizes = F.transform(sets, lambda s: F.struct(F.size(F.array_intersect(s["a"], s["b"])).alias("both"), (F.size(s["a"]) + F.size(s["b"])).alias("n")))
    return F.transform(sizes, lambda s: F.coalesce(s["both"] / F.nullif(s["n"] - s["both"], F.lit(0)), F.lit(0.0)))[0]


def best_of_document(hits: DataFrame, score: str, key: str = "chunk_id") -> DataFrame:
    """One chunk a document: the best, then the first."""
    return hits.groupBy("doc_id").agg(F.max_by(F.struct(score, key), F.struct(F.col(score), -F.col(key))).alias("_b")).select("doc_id", f"_b.{key}", f"_b.{score}")


def scan_mode(visible: int, indexed: bool = False, least: int = 50) -> str | None:
    """How vectors are searched: not at all without a visible document, by an index only where the caller has one and says so, else exactly.

    Fewer than `least` documents are searched exactly in any case.
    """
    return None if not visible else "index" if indexed and visible >= least else "exact"


def title_route(chunks: DataFrame, question: str, least: float = 0.35, top: int = 10) -> DataFrame:
    """(doc_id, chunk_id, score): documents whose title is like the question, each by its first chunk."""
    scored = chunks.withColumn("score", F.round(title_similarity(F.col("title"), question), 6)).where(F.col("score") > least)
    return best_of_document(scored, "score").orderBy(F.desc("score"), "doc_id").limit(top)


def metadata_route(chunks: DataFrame, question: str, direct: DataFrame, least: float = 0.35, top: int = 10) -> DataFrame:
    """Documents of the direct hits whose domain or a tag stands in the question (1), or is like it."""
    words = F.concat(F.coalesce("tags", F.array().cast("array<string>")), F.array("domain"))
    named = F.exists(words, lambda w: (F.length(w) >= 2) & F.contains(F.lit(question.lower()), F.lower(w)))
    score = F.when(named, 1.0).otherwise(F.array_max(F.transform(words, lambda w: title_similarity(F.coalesce(w, F.lit("")), question))))
    scored = chunks.withColumn("score", F.round(score, 6)).where(F.col("score") > least).join(direct.select("doc_id").distinct(), "doc_id", "left_semi")
    return best_of_document(scored, "score").orderBy(F.desc("score"), "doc_id").limit(top)


def relation_route(docs: DataFrame, links: DataFrame, seeds: DataFrame, top: int = 10) -> DataFrame:
    """(doc_id, relation, priority): documents related to the seeds, each by its first relation.

    Explicit links count from both ends; then come revisions of a family, the family, the folder, and the domain.
    Every kind is an equality join with the seeds' few values.
    """
    s = seeds.select("doc_id").distinct()
    out = links.join(s.withColumnRenamed("doc_id", "src"), "src", "left_semi").select(F.col("dst").alias("doc_id"), F.lit("references").alias("relation"), F.lit(1).alias("priority"))
    out = out.unionByName(links.join(s.withColumnRenamed("doc_id", "dst"), "dst", "left_semi").select(F.col("src").alias("doc_id"), F.lit("referenced_by").alias("relation"), F.lit(2).alias("priority")))
    mine = docs.join(s, "doc_id", "left_semi")
    for priority, (relation, keys) in enumerate((("revision", ["family", "revision"]), ("family", ["family"]), ("folder", ["folder"]), ("domain", ["domain"])), 3):
        same = docs.join(mine.select(*keys).distinct(), keys, "left_semi")
        out = out.unionByName(same.select("doc_id", F.lit(relation).alias("relation"), F.lit(priority).alias("priority")))
    out = out.join(s, "doc_id", "left_anti")
    return out.groupBy("doc_id").agg(F.min_by("relation", "priority").alias("relation"), F.min("priority").alias("priority")).orderBy("priority", "doc_id").limit(top)


def external_route(records: DataFrame) -> DataFrame:
    """Records of an outside source (position, text) as chunks with negative ids, so that they never meet an own one."""
    return records.select((-F.col("position").cast("long") - 1).alias("chunk_id"), "text", (F.col("position") + 1).alias("rank"))


def weighted(routes: dict[str, DataFrame], key: str = "chunk_id") -> DataFrame:
    every = None
    for name, df in routes.items():
        part = df.select(key, (F.lit(AUXILIARY.get(name, 1.0)) / (RRF_K + F.col("rank"))).alias("_s"), F.lit(name).alias("_r"))
        every = part if every is None else every.unionByName(part)
    return every.groupBy(key).agg(F.round(F.sum("_s"), 9).alias("score"), F.array_join(F.sort_array(F.collect_set("_r")), ",").alias("routes"))


def fused(body: dict[str, DataFrame], auxiliary: dict[str, DataFrame], key: str = "chunk_id") -> DataFrame:
    """Two passes of rank fusion: the body routes alone, then all with the auxiliary ones at their weights.

    Routes have key and rank. direct says that a body route has the chunk. Without any direct hit the auxiliary
    routes are dropped, so nothing is returned.
    """
    first = weighted(body, key)
    direct = first.select(key, F.lit(True).alias("direct"))
    some = first.agg((F.count("*") > 0).alias("_any"))
    both = weighted({**body, **auxiliary}, key).join(direct, key, "left").crossJoin(F.broadcast(some)).where("_any").drop("_any")
    return both.withColumn("direct", F.coalesce("direct", F.lit(False)))


def reranked(hits: DataFrame, scores: DataFrame | None, window: int = 24, key: str = "chunk_id") -> DataFrame:
    """Hits (key, score) with position: the first `window` in order of the given scores, ties and the rest as they were.

    Without scores, or where one of the window has none, the order stays.
    """
    order = Window.orderBy(F.desc("score"), key)
    head = hits.orderBy(F.desc("score"), key).limit(window).withColumn("_p", F.row_number().over(order))
    tail = hits.join(head.select(key), key, "left_anti").withColumn("_rank", F.lit(None).cast("double"))
    if scores is None:
        head = head.withColumn("_rank", F.lit(0.0))
    else:
        head = head.join(scores.select(key, F.col("rerank").cast("double").alias("_rank")), key, "left")
        whole = Window.partitionBy()
        head = head.withColumn("_rank", F.when(F.count_if(F.col("_rank").isNull()).over(whole) == 0, F.col("_rank")).otherwise(0.0))
    first = head.withColumn("position", F.row_number().over(Window.orderBy(F.desc("_rank"), "_p")).cast("long"))
    return first.select(key, "score", "position").unionByName(tail.select(key, "score", F.lit(None).cast("long").alias("position")))


def marked(text: Column, words: tuple[str, ...]) -> Column:
    """Whether a text holds one of the words."""
    t = F.coalesce(text, F.lit(""))
    return F.greatest(*[F.contains(t, F.lit(w)) for w in words]) if len(words) > 1 else F.contains(t, F.lit(words[0]))


def merged_runs(hits: DataFrame, span: int = 16, old: tuple[str, ...] = OLD, current: tuple[str, ...] = CURRENT) -> DataFrame:
    """(doc_id, chunk_id, ord, last_ord, chunks, score): consecutive chunks of a document as one, `span` at most.

    hits has doc_id, chunk_id, ord, score, text, heading. A run is of a version if markers of that one alone stand in its
    first heading or in the text it has taken in, so that chunks without markers carry it on; it ends where the next
    chunk's own heading and text are of the opposite version. A run's score is its best, its id the first chunk's.
    Markers become five bits before anything is shuffled; a document's chunks lie together in order and are folded as
    they are read, so that beside the sort a task holds one run and one batch.
    """
    h, t = F.col("heading"), F.col("text")
    bits = [F.coalesce(h, F.lit("")) != "", marked(h, old), marked(h, current), marked(t, old), marked(t, current)]
    rows = hits.select("doc_id", "ord", "chunk_id", "score", sum((F.when(b, 1 << i).otherwise(0) for i, b in enumerate(bits)), F.lit(0)).alias("_m"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    out = f"doc_id {kinds['doc_id']}, chunk_id {kinds['chunk_id']}, ord {kinds['ord']}, last_ord {kinds['ord']}, chunks long, score {kinds['score']}"

    def fold(batches):
        run, o, c, headed = None, 0, 0, 0  # [doc_id, chunk_id, ord, last_ord, chunks, score], its versions, whether it has a heading
        for b in batches:
            done = []
            for doc, at, chunk, score, m in zip(*(b.column(x).to_pylist() for x in ("doc_id", "ord", "chunk_id", "score", "_m"))):
                ho, hc, to, tc = m >> 1 & 1, m >> 2 & 1, m >> 3 & 1, m >> 4 & 1
                on = run is not None and run[4] < span and at is not None and run[3] is not None and at == run[3] + 1 and doc == run[0]
                if on and (o - c) * ((ho | to) - (hc | tc)) >= 0:
                    o, c = o | to | (ho & ~headed), c | tc | (hc & ~headed)  # the run's heading is the first that isn't empty
                    headed |= m & 1
                    run[3] = at
                    run[4] += 1
                    if score is not None and (run[5] is None or score != score or score > run[5]):
                        run[5] = score
                else:
                    if run is not None:
                        done.append(run)
                    run, o, c, headed = [doc, chunk, at, at, 1, score], ho | to, hc | tc, m & 1
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*done), types(b))], names=names)
        if run is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(run, types(b))], names=names)

    names = ["doc_id", "chunk_id", "ord", "last_ord", "chunks", "score"]
    types = lambda b: [pa.int64() if n == "chunks" else b.schema.field("ord" if n == "last_ord" else n).type for n in names]
    return rows.repartition("doc_id").sortWithinPartitions("doc_id", "ord").mapInArrow(fold, out)


def deduped(hits: DataFrame) -> DataFrame:
    """Of files with one hash the best document's chunks, and of equal bodies in a document the best, then the first.

    hits has doc_id, chunk_id, sha256, text, score; bodies are compared without white space and case.
    """
    best = hits.groupBy("sha256").agg(F.max_by("doc_id", F.struct("score", -F.col("chunk_id"))).alias("_d"))
    kept = hits.join(best, hits["sha256"].eqNullSafe(best["sha256"])).where(F.col("doc_id") == F.col("_d")).drop(best["sha256"]).drop("_d")
    same = Window.partitionBy("doc_id", F.lower(F.regexp_replace("text", r"\s", ""))).orderBy(F.desc("score"), "chunk_id")
    return kept.withColumn("_n", F.row_number().over(same)).where("_n = 1").drop("_n")


def final_hits(hits: DataFrame, limit: int = 6, first: int = 2, more: int = 2) -> DataFrame:
    """The hits for an answer, with why: top, version or link.

    hits has chunk_id, doc_id, family, revision, score, relation (null, or how an auxiliary route found it). At
    most `first` a document come first and others fill up to `limit`; of families found in several revisions the
    best hit of each revision is kept too, `more` at most; and one linked document that no other route found.
    """
    order = [F.desc("score"), "chunk_id"]
    w = Window.partitionBy("doc_id").orderBy(*order)
    top = hits.withColumn("_late", F.row_number().over(w) > first).orderBy("_late", *order).limit(limit).select("chunk_id", "score", F.lit("top").alias("why"))
    several = hits.where("family IS NOT NULL AND revision IS NOT NULL").groupBy("family").agg(F.countDistinct("revision").alias("_n")).where("_n > 1").select("family")
    best = hits.join(several, "family", "left_semi").groupBy("family", "revision").agg(F.max_by(F.struct("chunk_id", "score"), F.struct("score", -F.col("chunk_id"))).alias("_b")).select("_b.*")
    versions = best.join(top, "chunk_id", "left_anti").orderBy(*order).limit(more).select("chunk_id", "score", F.lit("version").alias("why"))
    chosen = top.unionByName(versions)
    link = hits.where(F.col("relation").isin("references", "referenced_by")).join(chosen, "chunk_id", "left_anti").orderBy(*order).limit(1).select("chunk_id", "score", F.lit("link").alias("why"))
    return chosen.unionByName(link)


def citation_window(chunks: DataFrame, visible: DataFrame, cited: DataFrame, width: int = 1) -> DataFrame:
    """The chunks about each cited one (chunk_id), up to `width` (3 at most) on each side, if the viewer may see them.

    Visibility is asked again: documents that aren't in `visible` (doc_id) give nothing.
    """
    w = min(max(width, 0), 3)
    at = chunks.join(cited.select("chunk_id"), "chunk_id", "left_semi").select(F.col("chunk_id").alias("cited"), "doc_id", F.explode(F.sequence(F.col("ord") - w, F.col("ord") + w)).alias("ord"))
    return at.join(chunks.select("doc_id", "ord", "chunk_id"), ["doc_id", "ord"]).join(visible.select("doc_id").distinct(), "doc_id", "left_semi").select("cited", "chunk_id", "doc_id", "ord")


def readable(docs: DataFrame, chunks: DataFrame, grants: DataFrame, login: str, roles: list[str], departments: list[str], on: str, space: str | None = None) -> DataFrame:
    """Documents that a viewer may search: enabled, ready, in effect on a day, with a chunk, in the space if one is given,
    and theirs or granted to their login, a role or a department, for the document or its space."""
    ok = docs.where((F.col("enabled")) & (F.col("status") == "ready") & (F.col("effective_from").isNull() | (F.col("effective_from") <= on)) & (F.col("effective_to").isNull() | (F.col("effective_to") >= on)))
    ok = ok.where(F.col("space") == space) if space else ok
    ok = ok.join(chunks.select("doc_id").distinct(), "doc_id", "left_semi")
    kind, who = F.col("grantee_kind"), F.col("grantee")
    mine = grants.where(((kind == "login") & (who == login)) | ((kind == "role") & who.isin(*roles)) | ((kind == "department") & who.isin(*departments)))
    by_doc = ok.join(mine.where("scope = 'doc'").select(F.col("target_id").alias("doc_id")), "doc_id", "left_semi")
    by_space = ok.join(mine.where("scope = 'space'").select(F.col("target_id").alias("space")), "space", "left_semi")
    return ok.where(F.col("owner") == login).select("doc_id").unionByName(by_doc.select("doc_id")).unionByName(by_space.select("doc_id")).distinct()


EXTRACTION = "entities array<struct<name:string,type:string>>, relations array<struct<source:string,target:string,type:string,weight:double>>"


def folded_name(name: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(F.regexp_replace(name, "[\"'“”《》()（）]", "")), r"\s+", " "))


def real_name(folded: Column) -> Column:
    return F.when((F.length(folded) >= 2) & ~folded.rlike(r"^[\d\W_]+$"), folded)


def entity_name(name: Column) -> Column:
    """An entity's name as a key: trimmed, quotes and blanks folded, lower case; null for noise (one character, numbers)."""
    return real_name(folded_name(name))


def chunk_graph(extracted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(mentions, relations) from what was extracted of each chunk: (chunk_id, doc_id, raw), raw being JSON in prose.

    mentions has chunk_id, doc_id, entity, type; relations has doc_id, src, dst, type, weight, summed over chunks,
    of entities that are mentioned in the chunk, and never from one to itself. What doesn't parse gives nothing.
    A chunk's names and relations are read once and meet in one aggregate by chunk.
    """

    def names(of: Column, part: str) -> Column:
        return F.transform(F.transform(of, lambda e: folded_name(e[part])), lambda n: real_name(n))

    def read(x: Column) -> Column:
        """What is extracted of a chunk: entities with their names, and relations with those of both ends."""
        e, r = x["entities"], x["relations"]
        return F.struct(e.alias("entities"), names(e, "name").alias("names"), names(r, "source").alias("src"), names(r, "target").alias("dst"), F.transform(r, lambda v: F.coalesce(v["type"], F.lit("related"))).alias("type"), F.transform(r, lambda v: F.coalesce(v["weight"], F.lit(1.0))).alias("weight"))

    parsed = F.from_json(F.regexp_extract("raw", r"(?s)(\{.*\})", 1), EXTRACTION)
    x = extracted.select("chunk_id", "doc_id", F.transform(F.array(parsed), read)[0].alias("_x"))
    m = x.select("chunk_id", "doc_id", F.explode(F.arrays_zip("_x.names", "_x.entities")).alias("_e")).select("chunk_id", "doc_id", F.col("_e.names").alias("entity"), F.coalesce("_e.entities.type", F.lit("other")).alias("type")).where("entity IS NOT NULL")
    mentions = m.groupBy("chunk_id", "doc_id", "entity").agg(F.min("type").alias("type"))
    rows = x.where("chunk_id IS NOT NULL").select("chunk_id", F.coalesce("_x.names", F.array().cast("array<string>")).alias("_n"), F.struct("doc_id", F.filter(F.arrays_zip("_x.src", "_x.dst", "_x.type", "_x.weight"), lambda r: r["src"] != r["dst"]).alias("_r")).alias("_d"))
    chunks = rows.groupBy("chunk_id").agg(F.flatten(F.collect_list("_n")).alias("_n"), F.collect_list("_d").alias("_d"))
    r = chunks.select("_n", F.explode("_d").alias("_d")).select("_n", "_d.doc_id", F.explode("_d._r").alias("_r"))
    r = r.where(F.array_contains("_n", F.col("_r.src")) & F.array_contains("_n", F.col("_r.dst"))).select("doc_id", "_r.*")
    return mentions, r.groupBy("doc_id", "src", "dst", "type").agg(F.sum("weight").alias("weight"))


def graph_stats(mentions: DataFrame, relations: DataFrame) -> DataFrame:
    """(doc_id, entities, relations, dangling): dangling entities are mentioned but in no relation of the document.

    Mentions and ends of relations meet in one aggregate by document and entity; a relation is counted at its source.
    """
    here = mentions.select("doc_id", "entity", F.lit(True).alias("_m"), F.lit(False).alias("_in"), F.lit(0).alias("_r"))
    ends = F.explode(F.array(F.struct(F.col("src").alias("entity"), F.lit(1).alias("r")), F.struct(F.col("dst").alias("entity"), F.lit(0).alias("r"))))
    there = relations.where("doc_id IS NOT NULL").select("doc_id", ends.alias("_e")).select("doc_id", "_e.entity", F.lit(False).alias("_m"), F.col("_e.entity").isNotNull().alias("_in"), F.col("_e.r").alias("_r"))
    per = here.unionByName(there).groupBy("doc_id", "entity").agg(F.max("_m").alias("_m"), F.max("_in").alias("_in"), F.sum("_r").alias("_r"))
    out = per.groupBy("doc_id").agg(F.count_if("_m").alias("entities"), F.sum("_r").alias("relations"), F.count_if(F.col("_m") & ~F.col("_in")).alias("dangling"))
    return out.where("entities > 0").select("doc_id", "entities", "relations", "dangling")


def neighbourhood(relations: DataFrame, seeds: DataFrame, hops: int = 1) -> DataFrame:
    """(entity, hop) of the entities within some hops of the seeds (entity), over relations either way."""
    both = relations.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(relations.select(F.col("dst").alias("a"), F.col("src").alias("b"))).distinct()
    near = seeds.select("entity", F.lit(0).alias("hop")).distinct()
    for hop in range(1, hops + 1):
        more = both.join(near.where(F.col("hop") == hop - 1).select(F.col("entity").alias("a")), "a", "left_semi").select(F.col("b").alias("entity"), F.lit(hop).alias("hop"))
        near = near.unionByName(more).groupBy("entity").agg(F.min("hop").alias("hop"))
    return near
