"""Column roles, views and insight sentences of a bounded result."""

from __future__ import annotations

import re

from ..functions.answers import change_text, compress


def column_spec(name: str, values: list) -> dict:
    some = [v for v in values if v is not None]
    low = name.lower()
    number = bool(some) and all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in some)
    if re.search(r"(^|_)(date|day|month|year|week|time|ts)$|日期|月份", low):
        role = "time"
    elif re.search(r"(^|_)(id|code|key)$|编码", low):
        role = "id"
    else:
        role = "metric" if number else "category"
    meaning = "percent" if re.search("rate|pct|margin|share|率|占比", low) else "count" if re.search("count|orders|buyers|^n_|数", low) else "money" if re.search("amount|price|cost|profit|revenue|额", low) else "none"
    return {"name": name, "role": role, "semantic": meaning if role == "metric" else "none"}


def view(columns: list[str], rows: list[tuple]) -> dict:
    """Key figures, entity, line, pie, bar or table, by the roles of the columns."""
    specs = [column_spec(c, [r[k] for r in rows]) for k, c in enumerate(columns)]
    roles = [s["role"] for s in specs]
    metric, time, cat = roles.count("metric"), roles.count("time"), roles.count("category")
    if len(rows) == 1 and metric and not time:
        block = {"kind": "kpis"} if metric == len(roles) else {"kind": "entity"}
    elif not rows or not metric:
        block = {"kind": "table"}
    elif time:
        block = {"kind": "line", "series": next((s["name"] for s in specs if s["role"] == "category"), None) if cat == 1 and metric == 1 else None}
    elif cat and metric == 1:
        k = roles.index("metric")
        shares = all((r[k] or 0) >= 0 for r in rows)
        block = {"kind": "pie" if shares and len(rows) <= 10 and specs[k]["semantic"] != "percent" else "bar", "top": 20 if len(rows) > 20 else None}
    else:
        block = {"kind": "grouped_bar"} if cat and len(rows) <= 50 else {"kind": "table"}
    return {"columns": specs, "blocks": [block, *([] if block["kind"] == "table" else [{"kind": "table"}])], "insight": insight(specs, rows)}


def insight(specs: list[dict], rows: list[tuple], partial: str | None = None) -> str | None:
    """First against last period, or the leader's share; none on negative values or a single row."""
    at = {r: next((k for k, s in enumerate(specs) if s["role"] == r), None) for r in ("metric", "time", "category")}
    m = at["metric"]
    if m is None or len(rows) < 2:
        return None
    if at["time"] is not None:
        series = sorted((r[at["time"]], r[m]) for r in rows if r[m] is not None and r[at["time"]] != partial)
        if len(series) < 2:
            return None
        return f"{specs[m]['name']} {change_text(series[-1][1], series[0][1])} from {series[0][0]} to {series[-1][0]}"
    if at["category"] is None or any((r[m] or 0) < 0 for r in rows) or not sum(r[m] or 0 for r in rows):
        return None
    best = max(rows, key=lambda r: (r[m] or 0, str(r[at["category"]])))
    total = sum(r[m] or 0 for r in rows)
    return f"{best[at['category']]} leads with {compress(best[m])}, {best[m] / total * 100:.1f}% of the total"


def series(columns: list[str], rows: list[tuple], most: int = 8) -> dict[str, list[tuple]] | None:
    """The lines of a result with one time, one category and one metric: (time, value) by category, the largest first,
    at most `most` and the others summed; None for other results."""
    specs = [column_spec(c, [r[k] for r in rows]) for k, c in enumerate(columns)]
    at = {role: [k for k, s in enumerate(specs) if s["role"] == role] for role in ("time", "category", "metric")}
    if any(len(v) != 1 for v in at.values()):
        return None
    t, c, m = at["time"][0], at["category"][0], at["metric"][0]
    size: dict = {}
    for r in rows:
        size[r[c]] = size.get(r[c], 0) + abs(r[m] or 0)
    lead = sorted(size, key=lambda x: (-size[x], str(x)))[:most]
    out: dict = {}
    for r in rows:
        line = out.setdefault(r[c] if r[c] in lead else "other", {})
        line[r[t]] = line.get(r[t], 0) + (r[m] or 0)
    return {str(k): sorted(v.items()) for k, v in out.items()}


def kpi_delta(current: float | None, base: float | None, semantic: str) -> str:
    """A key figure's change: points for percents, else relative."""
    return change_text(current, base, semantic == "percent")


def in_order(tasks: list, workers: int = 2) -> list:
    """Results of report sections that run side by side, `workers` at a time, in the order of the tasks; a failed one gives its error."""
    from concurrent.futures import ThreadPoolExecutor

    def run(task):
        try:
            return task()
        except Exception as e:  # noqa: BLE001 - one section's failure is its own
            return e

    with ThreadPoolExecutor(workers) as pool:
        return list(pool.map(run, tasks))


def localised(columns: list[str], labels: dict[str, dict[str, str]], locale: str, default: str = "en") -> list[str]:
    """Columns by their labels in a locale, else in the default one, else as they are."""
    return [labels.get(c, {}).get(locale) or labels.get(c, {}).get(default) or c for c in columns]


def drills(shown: list[str], registry) -> list[str]:
    """Declared dimensions that a result doesn't show yet."""
    return [d for d in registry.dimensions if d not in shown]
