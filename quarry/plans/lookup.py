"""Point lookups, limits that statements lack, and verdicts on physical plans."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession

from .analysed import Node, held, tree_of, conjuncts
from .governance import ROW_CAP, GateError, relations


def parsed(spark: SparkSession, sql: str):
    return spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)


def named(e: Node) -> str | None:
    """The column that an unresolved expression is, without its table's name."""
    return e.fields["nameParts"].strip("[]").split(",")[-1].strip().lower() if e.kind == "UnresolvedAttribute" else None


def point_lookup(spark: SparkSession, sql: str, indexed: dict[str, set[str]], most: int = 50, keys: int = 5) -> str:
    """The statement if it reads one table by an indexed column: equality, IN of few values or a prefix.

    All is read from the parsed plan: a limit over a list of named columns over a filter over the table, and nothing
    else. The filter's demands are columns compared with constants, one of them an indexed column's.
    """
    names = relations(spark, sql)
    if len(names) != 1:
        raise GateError("a lookup reads one table")
    table = next(iter(names))
    node, seen = tree_of(json.loads(parsed(spark, sql).toJSON()), 0)[0], {}
    while node.kind in ("GlobalLimit", "LocalLimit", "Project", "Filter", "SubqueryAlias") and len(node.children) == 1:
        if node.kind in seen:
            raise GateError(f"a lookup has one {node.kind}")
        seen[node.kind] = node
        node = node.children[0]
    if node.kind != "UnresolvedRelation":
        raise GateError(f"a lookup has no {node.kind}")
    limit = seen.get("GlobalLimit")
    if not limit or limit.fields["limitExpr"].kind != "Literal" or not 0 <= int(limit.fields["limitExpr"].fields["value"]) <= most:
        raise GateError(f"a lookup has a limit of at most {most}")
    shown = list(held(seen["Project"].fields["projectList"])) if "Project" in seen else []
    if not shown or any(named(e.children[0] if e.kind == "Alias" else e) is None for e in shown):
        raise GateError("a lookup names its columns")
    found = False
    for e in conjuncts(seen["Filter"].fields["condition"]) if "Filter" in seen else []:
        column, values = (named(e.children[0]), e.children[1:]) if e.children else (None, [])
        if column is None and e.kind == "EqualTo":
            column, values = named(e.children[1]), e.children[:1]
        if column is None or e.kind not in ("EqualTo", "In", "Like") or any(v.kind != "Literal" or v.fields.get("value") is None for v in values):
            raise GateError("a lookup has plain conditions")
        text = str(values[0].fields["value"])
        short = e.kind == "EqualTo" or e.kind == "In" and len(values) <= keys or e.kind == "Like" and re.fullmatch(r"[^%_]+%", text) is not None
        found |= short and column in indexed.get(table, ())
    if not found:
        raise GateError(f"a lookup needs an indexed column of {table}")
    return sql


def ensure_limit(spark: SparkSession, sql: str, most: int = ROW_CAP) -> DataFrame:
    """The statement's rows; one without a limit at its top gets one, found in the plan and not in the text."""
    top = parsed(spark, sql).getClass().getSimpleName()
    df = spark.sql(sql)
    return df if top in ("GlobalLimit", "LimitAndOffset") else df.limit(most)


def scan_verdict(df: DataFrame) -> list[dict]:
    """For each file scan of the plan: its columns, and whether a filter reached it."""
    text = df._jdf.queryExecution().executedPlan().toString()
    out = []
    for line in re.findall(r"FileScan[^\n]*", text):
        filters = re.search(r"PushedFilters: \[([^\]]*)\]", line)
        partitions = re.search(r"PartitionFilters: \[([^\]]*)\]", line)
        schema = re.search(r"ReadSchema: struct<([^\n]*)>", line)
        out.append({"columns": len(re.findall(r"(?:^|,)[^:,<>]+:", schema[1])) if schema else 0, "full": not (filters and filters[1] or partitions and partitions[1])})
    return out


def partition_counts(df: DataFrame) -> list[dict]:
    """For each file scan of the planned statement: its partition columns, and how many of its partitions it would read of how many.

    All is read from the file index of the physical plan; nothing runs. A filter that is only known at run time, as that of a
    dynamic join, prunes nothing here.
    """
    out, queue = [], [df._jdf.queryExecution().sparkPlan()]
    while queue:
        node = queue.pop()
        if node.getClass().getSimpleName() == "FileSourceScanExec":
            relation = node.relation()
            fields = relation.partitionSchema().fieldNames()
            listed = node.selectedPartitions()
            out.append({"columns": list(fields), "scanned": listed.partitionCount() if len(fields) else 1, "total": relation.location().partitionSpec().partitions().size() if len(fields) else 1, "files": listed.totalNumberOfFiles(), "bytes": listed.totalFileSize()})
        for group in (node.children(), node.subqueries()):
            queue += [group.apply(k) for k in range(group.size())]
    return out


def partitions_read(df: DataFrame, column: str, floor: int = 4) -> dict:
    """How many partitions by a column the plan's scans read: all of `floor` or more in one of them is a full scan."""
    scans = [s for s in partition_counts(df) if column in s["columns"]]
    return {"scanned": sum(s["scanned"] for s in scans), "total": sum(s["total"] for s in scans), "full": any(s["total"] >= floor and s["scanned"] == s["total"] for s in scans)}
