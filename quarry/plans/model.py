"""Declared metrics, dimensions, join edges, scopes and snapshots, composed into one DataFrame plan."""

from __future__ import annotations

import re
from collections import deque
from dataclasses import dataclass, field, replace
from datetime import date
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class PlanError(ValueError):
    """A question that can't be answered with a correct plan."""


class FanoutError(PlanError):
    """A 1:N hop would repeat the rows of the metric's table."""


@dataclass(frozen=True)
class Metric:
    name: str
    table: str
    expr: str  # aggregate over the table's columns
    time_col: str | None = None
    distinct: bool = False  # COUNT DISTINCT stays right when rows repeat
    dedup_keys: tuple[str, ...] = ()
    dimensions: tuple[str, ...] | None = None  # None: all are allowed
    scope: str | None = None
    aliases: tuple[str, ...] = ()


@dataclass(frozen=True)
class Dimension:
    name: str
    table: str
    expr: str
    bucket: str | None = None  # label of empty values
    grain: str | None = None  # a time bucket is bound to the metric's own time column
    multi: bool = False  # a row holds several codes in one string: equality is containment
    aliases: tuple[str, ...] = ()


@dataclass(frozen=True)
class Edge:
    left: str
    left_col: str
    right: str
    right_col: str
    card: str = "N:1"


@dataclass(frozen=True)
class Snapshot:
    """The latest row of each partition, or with `at` all rows at the greatest value of that column."""

    partition: tuple[str, ...] = ()
    order: tuple[str, ...] = ()
    extra: str | None = None
    at: str | None = None


@dataclass(frozen=True)
class TimeWindow:
    """Half-open [begin, end)."""

    begin: date
    end: date

    def on(self, col: str) -> F.Column:
        return (F.col(col) >= F.lit(self.begin)) & (F.col(col) < F.lit(self.end))


#: The window of a question that names no time, and the most rows of an aggregate and of a detail.
ALL_TIME = TimeWindow(date(1000, 1, 1), date(9999, 12, 31))
MOST_GROUPS, MOST_ROWS = 1000, 500


@dataclass(frozen=True)
class QuerySpec:
    metrics: tuple[str, ...]
    dimensions: tuple[str, ...] = ()
    window: TimeWindow | None = None
    equals: tuple[tuple[str, tuple], ...] = ()  # dimension name, allowed values
    contains: tuple[tuple[str, str], ...] = ()
    excludes: tuple[tuple[str, str, str, str], ...] = ()  # name dimension, part of the name, code dimension, code
    no_bucket: tuple[str, ...] = ()  # dimensions whose empty-value bucket is left out
    sort: str | None = None
    ascending: bool = False
    limit: int | None = None
    offset: int | None = None

    def with_window(self, window: TimeWindow) -> QuerySpec:
        return replace(self, window=window)


@dataclass
class Registry:
    metrics: dict[str, Metric] = field(default_factory=dict)
    dimensions: dict[str, Dimension] = field(default_factory=dict)
    edges: list[Edge] = field(default_factory=list)
    scopes: dict[str, str] = field(default_factory=dict)
    snapshots: dict[str, Snapshot] = field(default_factory=dict)

    def path(self, start: str, goal: str, hops: int = 4) -> list[tuple[Edge, bool]] | None:
        """Shortest way over declared edges, as (edge from the nearer table, does it fan out)."""
        seen, queue = {start}, deque([(start, [])])
        while queue:
            at, way = queue.popleft()
            if at == goal:
                return way
            if len(way) == hops:
                continue
            for e in self.edges:
                if e.left == at:
                    step = (e, e.card == "1:N")
                elif e.right == at:
                    step = (Edge(e.right, e.right_col, e.left, e.left_col), e.card == "N:1")
                else:
                    continue
                if step[0].right not in seen:
                    seen.add(step[0].right)
                    queue.append((step[0].right, [*way, step]))
        return None


def latest(df: DataFrame, snap: Snapshot) -> DataFrame:
    """The latest row of each partition; ties go on to the later order columns."""
    rows = df.where(snap.extra) if snap.extra else df
    if snap.at:
        return rows.join(F.broadcast(rows.agg(F.max(snap.at).alias("_at"))), F.col(snap.at) == F.col("_at"), "left_semi")
    w = Window.partitionBy(*snap.partition).orderBy(*[F.col(c).desc_nulls_last() for c in snap.order])
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def dimension_column(d: Dimension, time_col: str | None) -> F.Column:
    if d.grain:
        if not time_col:
            raise PlanError(f"{d.name} needs a metric with a time column")
        c = F.date_format(F.date_trunc(d.grain, F.col(time_col)), "yyyy-MM" if d.grain == "month" else "yyyy" if d.grain == "year" else "yyyy-MM-dd")
        return c
    c = F.expr(d.expr)
    return F.coalesce(F.nullif(F.trim(c.cast("string")), F.lit("")), F.lit(d.bucket)) if d.bucket else c


def sums(expr: str) -> tuple[str, list[str]] | None:
    """A metric of sums alone as (the same of sums of _s0, _s1 .., what these stand for); None for other aggregates."""
    out, parts, at = "", [], 0
    for m in re.finditer(r"\bsum\(", expr, re.I):
        if m.start() < at:
            return None
        end, depth = m.end(), 1
        while depth:
            depth += {"(": 1, ")": -1}.get(expr[end], 0)
            end += 1
        inner = expr[m.end() : end - 1]
        if inner.upper().startswith("DISTINCT"):
            return None
        if inner not in parts:
            parts.append(inner)
        out, at = f"{out}{expr[at : m.end()]}_s{parts.index(inner)})", end
    out += expr[at:]
    return None if not parts or re.search(r"\b(count|max|min|avg|percentile\w*|first|last)\(", out, re.I) else (out, parts)


def compose(registry: Registry, spec: QuerySpec, tables) -> DataFrame:
    """One plan for the metrics of one table by dimensions that declared edges reach.

    Scopes filter a joined table before its left join, so that base rows survive; a hop that repeats rows is
    refused unless every metric counts distinct keys; deduplicated metrics must have their dimensions among the
    keys; snapshots are taken inside the scope. Where all metrics are sums and no filter waits behind a join, rows
    are summed by the columns that the joins and dimensions need before they are joined.
    """
    metrics = [registry.metrics[m] for m in spec.metrics]
    base = {m.table for m in metrics}
    if len(base) != 1 or not metrics:
        raise PlanError("metrics of one table are composed together")
    table = base.pop()
    dims = [registry.dimensions[d] for d in dict.fromkeys([*spec.dimensions, *[k for k, _ in spec.equals], *[k for k, _ in spec.contains], *[k for x in spec.excludes for k in (x[0], x[2])], *spec.no_bucket])]
    for m in metrics:
        if m.dimensions is not None and (bad := [d for d in spec.dimensions if d not in m.dimensions]):
            raise PlanError(f"{m.name} can't be split by {bad}")
    time_col = metrics[0].time_col
    df = tables(table)
    for f in dict.fromkeys([registry.scopes.get(table), *[m.scope for m in metrics]]):
        df = df.where(f) if f else df
    bridge = None
    if spec.window and not time_col:
        raise PlanError("the metric has no time column")
    if time_col and time_col not in df.columns:
        bridge = next((e.right for e in registry.edges if e.left == table and time_col in tables(e.right).columns), None)
        if bridge is None:
            raise PlanError(f"no edge from {table} leads to {time_col}")
    elif spec.window:
        df = df.where(spec.window.on(time_col))
    joined = {table}

    def reach(df: DataFrame, goal: str) -> DataFrame:
        way = registry.path(table, goal)
        if way is None:
            raise PlanError(f"no path from {table} to {goal}")
        for e, fans in way:
            if e.right in joined:
                continue
            if fans and not all(m.distinct for m in metrics):
                raise FanoutError(f"{e.left} to {e.right} repeats rows")
            right = tables(e.right)
            if scope := registry.scopes.get(e.right):
                right = right.where(scope)
            if snap := registry.snapshots.get(e.right):
                right = latest(right, snap)
            df = df.join(right, df[e.left_col] == right[e.right_col], "left")
            joined.add(e.right)
        return df

    if snap := registry.snapshots.get(table):
        df = latest(df, snap)
    keys = {k for m in metrics for k in m.dedup_keys}
    exprs = {m.name: m.expr for m in metrics}
    goals = dict.fromkeys([d.table for d in dims if not d.grain] + ([bridge] if bridge and any(d.grain for d in dims) else []))
    if any(g != table for g in goals) and not keys and table not in registry.snapshots and not (bridge and spec.window or spec.equals or spec.contains or spec.excludes or spec.no_bucket):
        parts: list[str] = []
        summed = {}
        for m in metrics:
            if found := sums(m.expr):
                text, own = found
                parts += [x for x in own if x not in parts]
                summed[m.name] = re.sub(r"\b_s(\d+)\b", lambda k, own=own: f"_s{parts.index(own[int(k[1])])}", text)
        if len(summed) == len(metrics):
            of = {way[0][0].left_col for g in goals if (way := registry.path(table, g))}
            for d in dims:
                of |= {c for c in df.columns if (d.table == table and not d.grain and re.search(rf"\b{c}\b", d.expr)) or (d.grain and c == time_col)}
            df = df.groupBy(*sorted(of)).agg(*[F.sum(F.expr(x)).alias(f"_s{k}") for k, x in enumerate(parts)])
            exprs = summed
    for d in dims:
        if not d.grain:
            df = reach(df, d.table)
    if bridge and (spec.window or any(d.grain for d in dims)):
        df = reach(df, bridge)
        df = df.where(spec.window.on(time_col)) if spec.window else df
    cols = {d.name: dimension_column(d, time_col) for d in dims}
    for name, values in spec.equals:
        if not values:
            raise PlanError(f"no value for {name}")
        if registry.dimensions[name].multi:
            df = df.where(reduce(or_, [F.contains(cols[name], F.lit(v)) for v in values]))
        else:
            df = df.where(cols[name].isin(*values))
    for name, part in spec.contains:
        df = df.where(F.contains(cols[name], F.lit(part)))
    for name, part, code_name, code in spec.excludes:
        df = df.where(~(F.coalesce(F.contains(cols[name], F.lit(part)), F.lit(False)) | F.coalesce(cols[code_name].cast("string") == code, F.lit(False))))
    for name in spec.no_bucket:
        df = df.where(cols[name] != registry.dimensions[name].bucket)
    if keys:
        if any(not m.dedup_keys or set(m.dedup_keys) != keys for m in metrics):
            raise PlanError("deduplicated metrics are composed on the same keys")
        df = df.select(*[cols[d].alias(d) for d in spec.dimensions], *sorted(keys)).distinct()
        group = [F.col(d) for d in spec.dimensions]
    else:
        group = [cols[d].alias(d) for d in spec.dimensions]
    out = (df.groupBy(*group) if group else df).agg(*[F.expr(exprs[m.name]).alias(m.name) for m in metrics])
    limit = spec.limit if spec.limit is not None else 1 if spec.offset else None
    if spec.sort or limit is not None:
        first = spec.sort or spec.metrics[0]
        lead = F.col(first).asc_nulls_last() if spec.ascending or (first in cols and registry.dimensions[first].grain) else F.col(first).desc_nulls_last()
        out = out.orderBy(lead, *[F.col(d) for d in spec.dimensions])
        if spec.offset:
            out = out.offset(spec.offset)
        out = out.limit(min(max(limit, 1), MOST_GROUPS)) if limit is not None else out
    return out


def detail(registry: Registry, spec: QuerySpec, tables, columns: list[F.Column], key: str) -> DataFrame:
    """Rows of the metrics' table within the window and scope: the latest first, then the largest, at most MOST_ROWS."""
    m = registry.metrics[spec.metrics[0]]
    df = tables(m.table)
    for f in filter(None, (registry.scopes.get(m.table), m.scope)):
        df = df.where(f)
    df = df.where(spec.window.on(m.time_col)) if spec.window else df
    return df.orderBy(F.col(m.time_col).desc(), F.abs(F.col(spec.sort)).desc(), F.col(key)).limit(min(max(spec.limit or MOST_ROWS, 1), MOST_ROWS)).select(*columns)
