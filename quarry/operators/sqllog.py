"""Mining of logged SQL on executors: which tables a statement joins and which columns it uses, whatever its dialect.

A scanner reads a statement's words, without its literals and comments, and keeps a frame for each query block; it
needs no session, so logs of any size are read in Arrow batches. A statement that it can't follow gets an error
and no facts, and the others aren't disturbed.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TOKEN = re.compile(
    r"(?P<skip>\s+|--[^\n]*|\#[^\n]*|/\*.*?\*/)|(?P<text>'(?:[^'\\]|''|\\.)*')|(?P<quoted>`(?:[^`]|``)+`|\"(?:[^\"\\]|\"\"|\\.)*\"|\[[A-Za-z_]\w*\])|(?P<number>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|\.\d+)|(?P<word>[^\W\d]\w*\$?)|(?P<bind>[:@?$]+\w*|\{\w+\})|(?P<sign><=>|<>|!=|<=|>=|\|\||::|->>?|.)",
    re.S,
)
#: Words that end a relation or a clause and so are no aliases.
KEYWORDS = frozenset("""
select from where group by having order limit offset union intersect except minus all distinct join inner left right full outer cross natural semi anti lateral on using
as and or not in is null like between exists case when then else end asc desc with recursive window qualify fetch for over partition interval cast straight_join tablesample values
""".split())
CLAUSES = {"select": "select", "from": "from", "where": "where", "having": "having", "group": "group", "order": "order", "limit": "limit", "window": "window", "qualify": "where"}
JOINS = frozenset(("join", "straight_join"))
NEAR = frozenset(("inner", "left", "right", "full", "outer", "cross", "natural", "semi", "anti"))


class Unreadable(ValueError):
    pass


@dataclass
class Frame:
    """A query block, or the inside of parentheses, which shares its block's clause."""

    parent: Frame | None
    block: bool
    clause: str = ""
    wants: bool = False  # a relation comes next
    join: bool = False  # and it is joined to the last one
    aliases: dict[str, str | None] = field(default_factory=dict)  # None: a subquery or a common table
    items: list[str | None] = field(default_factory=list)  # tables of the comma list
    last: str | None = None
    pending: tuple[str, str] | None = None  # a join without an equality so far
    cte: str | None = None  # the name that this block's rows get
    depth_with: bool = False

    def home(self) -> Frame:
        f = self
        while not f.block:
            f = f.parent
        return f


def tokens(sql: str) -> list[tuple[str, str]]:
    """(kind, text) of a statement's words and signs: comments are gone, literals are empty, names are in lower case."""
    out, at = [], 0
    while at < len(sql):
        m = TOKEN.match(sql, at)
        kind, at = m.lastgroup, m.end()
        text = m[0]
        if kind == "skip":
            continue
        if kind == "sign" and text in "'\"`" or kind == "sign" and sql.startswith("/*", m.start()):
            raise Unreadable(f"what begins at {m.start()} has no end")
        if kind == "quoted":
            # a double-quoted name stands beside a dot or behind a name; else it is a literal, as in logs of MySQL
            before = out[-1] if out else ("sign", "")
            dotted = text[0] != '"' or sql[at : at + 1] == "." or before in (("sign", "."), ("sign", ")"), ("word", "as")) or before[0] == "name" or before[0] == "word" and before[1] not in KEYWORDS
            kind, text = ("word", text[1:-1].lower()) if dotted else ("text", "")
            out.append(("name" if kind == "word" else kind, text))
            continue
        out.append((kind, "" if kind == "text" else text.lower()))
    return out


def scan(sql: str) -> tuple[set[tuple[str, str, str]], set[tuple[str, str]], set[tuple[str, str, str, str]]]:
    """(uses, joins, edges) of a statement: (table, column, role), pairs of joined tables, and equal columns of joins.

    Roles are select, where, on, having, group and order. Only columns behind a table's name or alias are told of,
    since others can't be placed; subqueries and common tables have no columns of their own. Names are resolved in
    their block and those around it. Pairs are in order of their names.
    """
    words = [*tokens(sql), ("sign", ";")]
    if not any(k == "word" and w in ("select", "with") for k, w in words[:3]):
        raise Unreadable("not a query")
    uses: list[tuple[Frame, str, str, str]] = []
    joins: set[tuple[str, str]] = set()
    equal: list[tuple[Frame, tuple[str, str], tuple[str, str], Frame]] = []
    fallback: list[tuple[Frame, tuple[str, str], int]] = []
    ctes: set[str] = set()
    root = frame = Frame(None, True)
    at = 0

    def begins_query(k: int) -> bool:
        return words[k][0] == "word" and words[k][1] in ("select", "with") or words[k] == ("sign", "(") and k + 1 < len(words) and begins_query(k + 1)

    def chain(k: int) -> tuple[list[str], int]:
        """A dotted name from k on, and where it ends."""
        parts = [words[k][1]]
        k += 1
        while words[k] == ("sign", ".") and (words[k + 1][0] in ("word", "name") or words[k + 1] == ("sign", "*")):
            parts.append(words[k + 1][1])
            k += 2
        return parts, k

    def settle(home: Frame) -> None:
        if home.pending:
            fallback.append((home, home.pending, len(equal)))
            home.pending = None

    def related(home: Frame, table: str | None, alias: str) -> None:
        home.aliases[alias] = table
        if home.join:
            settle(home)
            if table and home.last and table != home.last:
                home.pending = (home.last, table)
        else:
            settle(home)
            home.items.append(table)
        home.last = table or home.last
        home.wants = home.join = False

    def done(home: Frame) -> None:
        settle(home)
        some = [t for t in home.items if t]
        for i, a in enumerate(some):
            joins.update((min(a, b), max(a, b)) for b in some[i + 1 :] if a != b)
        home.items, home.last = [], None

    while at < len(words) - 1:
        kind, word = words[at]
        home = frame.home()
        if (kind, word) == ("sign", "("):
            query = begins_query(at + 1)
            inner = Frame(frame, query)
            if query and home.wants and not frame.cte:
                inner.cte = ""  # a derived table: its alias follows
            elif not query:
                inner.clause = "list" if words[at - 1][1] == "using" else ""
            frame = inner
        elif (kind, word) == ("sign", ")"):
            if frame is root:
                raise Unreadable("a parenthesis too many")
            if frame.block:
                done(frame)
            closed, frame = frame, frame.parent
            home = frame.home()
            if closed.block and closed.cte == "" and home.wants:
                k = at + 1
                k += words[k] == ("word", "as")
                alias = words[k][1] if words[k][0] in ("word", "name") and words[k][1] not in KEYWORDS else ""
                related(home, None, alias)
                at = k if alias else k - 1
        elif (kind, word) == ("sign", ";"):
            if frame is not root:
                raise Unreadable("a parenthesis without an end")
            done(root)
            root = frame = Frame(None, True)
        elif kind == "word" and word == "with" and not home.clause:
            k = at + 1
            k += words[k] == ("word", "recursive")
            home.depth_with = True
            at = k - 1
        elif home.depth_with and not home.clause and kind in ("word", "name") and word not in KEYWORDS:
            ctes.add(word)
            while at < len(words) - 1 and words[at + 1] != ("word", "as"):  # a list of columns may stand between
                at += 1
            at += 1
        elif kind == "word" and word in ("union", "intersect", "except", "minus") and frame.block:
            done(frame)
            frame.aliases = dict(frame.aliases)
            sibling = Frame(frame.parent, True, cte=frame.cte)
            if frame is root:
                root = sibling
            frame = sibling
            at += words[at + 1][1] in ("all", "distinct")
        elif kind == "word" and word in CLAUSES and frame.block:
            home.clause, home.wants = CLAUSES[word], word == "from"
            home.join = False
        elif kind == "word" and home.clause in ("from", "on") and word in JOINS | NEAR and not (word in ("left", "right") and words[at + 1] == ("sign", "(")):
            if word in JOINS:
                home.clause, home.wants, home.join = "from", True, True
        elif kind == "word" and word == "lateral" and home.clause == "from":
            pass
        elif kind == "word" and word == "on" and home.clause == "from":
            home.clause = "on"
        elif (kind, word) == ("sign", ",") and frame.block and home.clause in ("from", "on"):
            home.clause, home.wants, home.join = "from", True, False
        elif kind in ("word", "name") and home.clause == "from" and home.wants and word not in KEYWORDS:
            parts, k = chain(at)
            if words[k] == ("sign", "("):  # a function that makes rows
                level = 1
                while level and k < len(words) - 1:
                    k += 1
                    level += (words[k] == ("sign", "(")) - (words[k] == ("sign", ")"))
                k += 1
                table = None
            else:
                table = parts[-1]
            k += words[k] == ("word", "as")
            alias = table or ""
            if words[k][0] in ("word", "name") and words[k][1] not in KEYWORDS:
                alias, k = words[k][1], k + 1
            related(home, None if table in ctes else table, alias)
            at = k - 1
        elif kind in ("word", "name") and (kind == "name" or word not in KEYWORDS) and home.clause in ("select", "where", "on", "having", "group", "order") and frame.clause != "list":
            parts, k = chain(at)
            if len(parts) > 1 and parts[-1] != "*" and words[k] != ("sign", "("):
                uses.append((frame, parts[-2], parts[-1], home.clause))
                before, after = words[at - 1], words[k]
                if home.clause == "on" and after in (("sign", "="), ("sign", "<=>")) and words[k + 1][0] in ("word", "name"):
                    more, e = chain(k + 1)
                    ends = words[e] in (("sign", ")"), ("sign", ","), ("sign", ";")) or words[e][0] == "word" and words[e][1] in KEYWORDS
                    if len(more) > 1 and ends and (before[1] in ("on", "and", "or", "(", "not")):
                        equal.append((frame, (parts[-2], parts[-1]), (more[-2], more[-1]), home))
                        home.pending = None if more[-2] != parts[-2] else home.pending
            at = k - 1
        at += 1
    if frame is not root:
        raise Unreadable("a parenthesis without an end")
    done(root)

    def resolve(f: Frame | None, name: str) -> str | None:
        while f is not None:
            if f.block and name in f.aliases:
                return f.aliases[name]
            f = f.parent
        return None if name in ctes else name

    edges = set()
    for f, (pa_, ca), (pb, cb), _ in equal:
        a, b = resolve(f, pa_), resolve(f, pb)
        if a and b and pa_ != pb:
            if a != b:
                joins.add((min(a, b), max(a, b)))
            edges.add((a, ca, b, cb) if (a, ca) <= (b, cb) else (b, cb, a, ca))
    for _, (a, b), _ in fallback:
        if a not in ctes and b not in ctes:
            joins.add((min(a, b), max(a, b)))
    found = {(t, c, role) for f, p, c, role in uses if (t := resolve(f, p))}
    return found, {j for j in joins if not set(j) & ctes}, edges


MINED = "struct<error:string,uses:array<struct<table:string,column:string,role:string>>,joins:array<struct<left:string,right:string>>,edges:array<struct<left_table:string,left_column:string,right_table:string,right_column:string>>>"


def mined(log: DataFrame, sql: str) -> DataFrame:
    """The log with `mined`: error, uses, joins and edges of each statement; blank and null statements have none of them."""

    def names(*columns: str) -> pa.DataType:
        return pa.list_(pa.struct([(c, pa.string()) for c in columns]))

    kinds = [pa.string(), names("table", "column", "role"), names("left", "right"), names("left_table", "left_column", "right_table", "right_column")]

    def run(texts: pa.Array) -> pa.Array:
        rows = []
        for text in texts.to_pylist():
            try:
                got = scan(text) if text and text.strip() else (set(), set(), set())
                rows.append((None, *([dict(zip(("table", "column", "role") if k == 0 else ("left", "right") if k == 1 else ("left_table", "left_column", "right_table", "right_column"), x)) for x in sorted(s)] for k, s in enumerate(got))))
            except (Unreadable, IndexError, RecursionError) as e:
                rows.append((str(e)[:200] or type(e).__name__, [], [], []))
        return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["error", "uses", "joins", "edges"])

    return log.withColumn("mined", F.arrow_udf(run, MINED).asNondeterministic()(F.col(sql)))


def usage_edges(log: DataFrame, source: str, most_columns: int = 24, most_edges: int | None = 500, weight: str | None = None) -> DataFrame:
    """(source, left_table, left_column, right_table, right_column, n, frequency, usage) of a mined log.

    Tables that are joined make pairs without columns; columns that one statement selects or filters by make pairs,
    unless it uses more than `most_columns`. n counts statements; frequency is its share of the source's greatest;
    usage is 0.4 of it. A source keeps its `most_edges` most frequent pairs, equal ones by name. weight: a column that says how
    many equal statements a row stands for.
    """
    key = F.lower(F.trim(F.coalesce(F.col(source), F.lit("")))).alias("source")
    good = log.where("mined.error IS NULL").select(key, "mined", (F.col(weight) if weight else F.lit(1)).cast("long").alias("_w"))
    tables = good.select("source", "_w", F.explode("mined.joins").alias("j")).select("source", "_w", F.col("j.left").alias("left_table"), F.lit("").alias("left_column"), F.col("j.right").alias("right_table"), F.lit("").alias("right_column"))
    used = F.expr("array_sort(array_distinct(transform(filter(mined.uses, u -> u.role IN ('select', 'where', 'having')), u -> struct(u.table AS table, u.column AS column))))")
    pairs = F.expr("flatten(transform(u, (a, i) -> transform(slice(u, i + 2, size(u)), b -> struct(a.table AS left_table, a.column AS left_column, b.table AS right_table, b.column AS right_column))))")
    columns = good.select("source", "_w", used.alias("u")).where(F.size("u").between(2, most_columns)).select("source", "_w", F.explode(pairs).alias("p")).select("source", "_w", "p.*")
    names = ["source", "left_table", "left_column", "right_table", "right_column"]
    counts = tables.unionByName(columns).groupBy(*names).agg(F.sum("_w").alias("n"))
    top = counts.groupBy("source").agg(F.max("n").alias("_m"))
    out = counts.join(top, "source").withColumn("frequency", F.col("n") / F.col("_m")).drop("_m").withColumn("usage", 0.4 * F.col("frequency"))
    if most_edges is None:
        return out
    w = Window.partitionBy("source").orderBy(F.desc("n"), *names[1:])
    return out.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most_edges).drop("_r")


def calibrated_by_log(edges: DataFrame, usage: DataFrame) -> DataFrame:
    """Known edges (source, left_table, ..., confidence, seen, status) after a round of usage_edges().

    A known edge's confidence becomes 0.6 of what it was plus its usage, within 0 and 1; an edge that is new starts with its usage,
    pending. A reviewer's status stays, and sightings add up; edges that weren't seen stay as they are.
    """
    names = ["source", "left_table", "left_column", "right_table", "right_column"]
    both = edges.join(usage.select(*names, "n", "usage"), names, "full_outer")
    merged = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(0.6 * F.col("confidence"), F.lit(0.0)) + F.col("usage")))
    return both.select(*names, F.when(F.col("usage").isNull(), F.col("confidence")).otherwise(merged).alias("confidence"), (F.coalesce("seen", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("seen"), F.coalesce("status", F.lit("pending")).alias("status"))
