"""Definition checks and corrections on query specifications, result votes, and cache guards."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from dataclasses import dataclass, replace
from datetime import date

from .model import PlanError, QuerySpec, Registry, TimeWindow


@dataclass(frozen=True)
class Violation:
    rule: str
    detail: str


@dataclass(frozen=True)
class Rule:
    """kind: one of require_dimension, require_value, require_window, cap_window, forbid_fanout, known_value,
    require_dedup, require_latest, percent_scale, join_and_filter, code_on_column, time_column."""

    kind: str
    metric: str
    arg: object = None


def check(registry: Registry, spec: QuerySpec, rules: list[Rule], today: date, values: dict[str, set] | None = None) -> list[Violation]:
    out = []
    for r in rules:
        if r.metric not in spec.metrics:
            continue
        named = {k for k, _ in spec.equals} | set(spec.dimensions)
        if r.kind == "require_dimension" and r.arg not in named:
            out.append(Violation(r.kind, f"{r.metric} needs {r.arg}"))
        elif r.kind == "require_value" and r.arg not in spec.equals:
            out.append(Violation(r.kind, f"{r.metric} needs {r.arg[0]} in {list(r.arg[1])}"))
        elif r.kind == "require_window" and spec.window is None:
            out.append(Violation(r.kind, f"{r.metric} needs a time window"))
        elif r.kind == "cap_window" and spec.window and spec.window.end > today:
            out.append(Violation(r.kind, f"{r.metric} ends yesterday"))
        elif r.kind == "forbid_fanout":
            for d in spec.dimensions:
                way = registry.path(registry.metrics[r.metric].table, registry.dimensions[d].table) or []
                if any(f for _, f in way) and not registry.metrics[r.metric].distinct:
                    out.append(Violation(r.kind, f"{d} repeats rows of {r.metric}"))
        elif r.kind == "require_dedup" and registry.metrics[r.metric].dedup_keys != r.arg:
            out.append(Violation(r.kind, f"{r.metric} counts each {list(r.arg)} once"))
        elif r.kind == "require_latest" and registry.metrics[r.metric].table not in registry.snapshots:
            out.append(Violation(r.kind, f"{r.metric} is of the latest rows"))
        elif r.kind == "percent_scale" and spec.contains and any(k == r.metric for k, _ in spec.contains):
            out.append(Violation(r.kind, f"{r.metric} is a share of 1"))
        elif r.kind == "join_and_filter" and not any(registry.dimensions[k].table == r.arg for k, _ in (*spec.equals, *spec.contains)):
            out.append(Violation(r.kind, f"{r.metric} is filtered by {r.arg}"))
        elif r.kind == "code_on_column":
            if bad := [v for k, vs in spec.equals if k == r.arg for v in vs if not re.fullmatch(r"[A-Za-z0-9_-]+", str(v))]:
                out.append(Violation(r.kind, f"{r.arg} takes codes and not {bad}"))
        elif r.kind == "time_column" and spec.window and registry.metrics[r.metric].time_col != r.arg:
            out.append(Violation(r.kind, f"{r.metric} has its time in {r.arg}"))
        elif r.kind == "known_value":
            for k, v in spec.equals:
                if values and k in values and (bad := [x for x in v if x not in values[k]]):
                    out.append(Violation(r.kind, f"{k} has no {bad}"))
    return out


def correct(spec: QuerySpec, rules: list[Rule], today: date, names: dict[str, dict[str, str]] | None = None) -> QuerySpec:
    """Repeats dropped, names replaced by codes, required values added, open or late windows bounded."""
    equals = tuple((k, tuple((names or {}).get(k, {}).get(x, x) for x in v)) for k, v in spec.equals)
    out = replace(spec, metrics=tuple(dict.fromkeys(spec.metrics)), dimensions=tuple(dict.fromkeys(spec.dimensions)), equals=equals)
    for r in rules:
        if r.metric not in out.metrics:
            continue
        if r.kind == "require_value" and r.arg[0] not in {k for k, _ in out.equals}:
            out = replace(out, equals=(*out.equals, r.arg))
        if r.kind == "require_dimension" and r.arg not in out.dimensions:
            out = replace(out, dimensions=(*out.dimensions, r.arg))
        if r.kind == "cap_window" and out.window and out.window.end > today:
            out = replace(out, window=TimeWindow(out.window.begin, today))
    return out


def judge(violations: list[list[Violation] | None], rounds: int = 2) -> str:
    """pass, retry, unresolved or grader_error, from the violations after each round of repair.

    None stands for a round whose check itself failed: that is no pass and no violation.
    """
    if violations and violations[-1] is None:
        return "grader_error"
    if not violations or not violations[-1]:
        return "pass"
    return "retry" if len(violations) <= rounds else "unresolved"


def coverage(spec: QuerySpec, intent: dict) -> dict[str, list[str]]:
    """What an intent asks for that the specification lacks, and the other way round; filters with other values than asked
    conflict, and what the specification has no place for can't be verified."""
    have = {"metric": set(spec.metrics), "dimension": set(spec.dimensions), "filter": {k for k, _ in spec.equals} | {k for k, _ in spec.contains}, "time": {"window"} if spec.window else set()}
    want = {k: set(intent.get(k, ())) for k in have}
    values = {k: set(map(str, v)) for k, v in spec.equals}
    conflicts = sorted(f"{k}:{v}" for k, v in (intent.get("values") or {}).items() if k in values and str(v) not in values[k])
    return {"missing": sorted(f"{k}:{x}" for k in have for x in want[k] - have[k]), "extra": sorted(f"{k}:{x}" for k in have for x in have[k] - want[k]), "conflicts": conflicts, "unverifiable": sorted(k for k in intent if k not in have and k != "values" and intent[k])}


def fingerprint(rows: list[tuple]) -> str:
    """Values alone, in any row order: numbers to six decimals, but integers too large for that as they are."""

    def told(v) -> str:
        number = isinstance(v, float) or isinstance(v, int) and not isinstance(v, bool) and abs(v) <= 2**53
        return f"{v:.6f}" if number else str(v)

    text = sorted("|".join(map(told, r)) for r in rows)
    return hashlib.sha256("\n".join(text).encode()).hexdigest()


def vote(results: list[list[tuple]]) -> int | None:
    """Index of a result that more than half agree on; None without such a majority."""
    prints = [fingerprint(r) for r in results]
    if not prints:
        return None
    best, n = Counter(prints).most_common(1)[0]
    return prints.index(best) if 2 * n > len(prints) else None


def same_question(a: str, b: str, distance: float, times: set[str], most: float = 0.12, scopes: tuple[str, ...] = ("my", "mine", "our", "all", "total", "我的", "我们", "全部", "全国")) -> bool:
    """Whether a cached answer may serve: near, with equal time words, equal scope words and equal numbers."""
    if {s for s in scopes if re.search(rf"\b{s}\b" if s.isascii() else s, a)} != {s for s in scopes if re.search(rf"\b{s}\b" if s.isascii() else s, b)}:
        return False
    said = lambda q: {t for t in times if t in q}
    numbers = lambda q: sorted(re.findall(r"\d+(?:\.\d+)?", q))
    return distance <= most and said(a) == said(b) and numbers(a) == numbers(b)


def pick(question: str, names: dict[str, tuple[str, ...]], used: str = "") -> str | None:
    """The entry whose longest alias stands in the question; ties go by name; words already used don't count."""
    q = question.replace(used, " ") if used else question
    hits = [(len(a), n) for n, aliases in names.items() for a in (n, *aliases) if a and a in q]
    return min(hits, key=lambda h: (-h[0], h[1]))[1] if hits else None


def spec_of(registry: Registry, question: str, today: date) -> QuerySpec:
    """A specification from a question by declared aliases alone; refused if no metric is named."""
    from ..functions import timewin

    metric = pick(question, {m.name: m.aliases for m in registry.metrics.values()})
    if metric is None:
        raise PlanError("the question names no declared metric")
    word = max((a for a in (metric, *registry.metrics[metric].aliases) if a in question), key=len)
    dim = pick(question, {d.name: d.aliases for d in registry.dimensions.values() if d.aliases}, word)
    window = timewin.parse(question, today)
    n = timewin.top_n(question)
    return QuerySpec((metric,), (dim,) if dim else (), timewin.to_date(window, today) if window else None, sort=metric if dim else None, ascending=timewin.ascending(question), limit=n if dim else None)


@dataclass(frozen=True)
class Request:
    """What an answer asks for before it is a specification: it may leave out what it implies."""

    select: tuple[str, ...]  # metrics and dimensions
    group: tuple[str, ...] = ()
    aggregate: tuple[tuple[str, str], ...] = ()  # metric, the aggregate that was asked for
    equals: tuple[tuple[str, tuple], ...] = ()
    begin: date | None = None
    end: date | None = None
    sort: str | None = None
    limit: int | None = None


#: The lower bound of a window with an upper one alone, and words that ask for another aggregate outright.
FIRST_DAY = date(1970, 1, 1)
OTHER_AGGREGATES = ("max", "min", "avg", "largest", "smallest", "average", "最大", "最小", "平均")


def repaired(registry: Registry, request: Request, question: str = "") -> tuple[QuerySpec, list[str]]:
    """The specification of a request, and what was put right.

    A dimension that is selected is grouped and the other way round; an aggregate other than the metric's declared
    one gives way to it, unless the question asks for it outright, which is refused; a window without a lower bound
    gets one; unknown names are refused.
    """
    fixes = []
    if bad := [n for n in (*request.select, *request.group) if n not in registry.metrics and n not in registry.dimensions]:
        raise PlanError(f"unknown names {sorted(set(bad))}")
    metrics = tuple(dict.fromkeys(n for n in request.select if n in registry.metrics))
    chosen = tuple(dict.fromkeys(n for n in request.select if n in registry.dimensions))
    if more := [d for d in request.group if d not in chosen]:
        fixes.append(f"selected {more}")
    if more := [d for d in chosen if d not in request.group]:
        fixes.append(f"grouped {more}")
    if len(metrics) + len(chosen) < len(request.select):
        fixes.append("dropped repeats")
    for m, how in request.aggregate:
        declared = re.match(r"\W*(?:CAST\(|round\(|coalesce\(|CAST\(coalesce\()*(\w+)\(", registry.metrics[m].expr, re.I)
        if declared and declared[1].lower() != how.lower():
            if any(w in question for w in OTHER_AGGREGATES):
                raise PlanError(f"{m} has no {how}")
            fixes.append(f"{m} by {declared[1].lower()} and not {how}")
    window = None
    if request.begin or request.end:
        if request.end is None:
            raise PlanError("a window has an end")
        window = TimeWindow(request.begin or FIRST_DAY, request.end)
        if request.begin is None:
            fixes.append("lower bound")
    return QuerySpec(metrics, tuple(dict.fromkeys((*chosen, *request.group))), window, request.equals, sort=request.sort, limit=request.limit), fixes


def derivation_problems(registry: Registry, spec: QuerySpec, tables: set[str], joins: set[tuple[str, str]], labels: dict[str, set]) -> list[str]:
    """Why a derived specification may not run: tables that aren't allowed, joins without evidence, labels nobody has seen."""
    start = registry.metrics[spec.metrics[0]].table
    out = [] if start in tables else [f"table {start}"]
    for name in (*spec.dimensions, *(k for k, _ in spec.equals)):
        d = registry.dimensions[name]
        for e, _ in (registry.path(start, d.table) or []) if d.table else []:
            if e.right not in tables:
                out.append(f"table {e.right}")
            if (e.left, e.right) not in joins and (e.right, e.left) not in joins:
                out.append(f"join {e.left}-{e.right}")
    for name, values in spec.equals:
        out += [f"label {v}" for v in values if v not in labels.get(name, set())]
    return list(dict.fromkeys(out))


def plan_for(question: str) -> str:
    """The report that a question asks for: compare, trend, structure, rank, reconcile, or total for none of these."""
    kinds = (("compare", "compared|versus|year over year|同比|环比|对比"), ("trend", "trend|monthly|daily|over time|趋势|走势"), ("structure", "share|structure|contribution|占比|构成|贡献"), ("rank", r"\btop\b|lowest|best|worst|前\d|前[一二三四五六七八九十]|最[高低]"), ("reconcile", "reconcile|add up|对账|核对"))
    return next((k for k, p in kinds if re.search(p, question, re.I)), "total")


def split_compound(question: str, most: int = 4) -> list[str]:
    """Parts of a compound question, each with a subject of its own; one part if it isn't compound."""
    parts = [p.strip(" ,，;；。?？") for p in re.split(r"(?:[;；]|[,，]?\s*\b(?:and also|as well as|and then)\b|，?(?:以及|同时|另外|还有))", question)]
    parts = [p for p in parts if len(p) >= 4]
    return parts[:most] if len(parts) > 1 else [question]


def merged_answers(parts: list[tuple[str, object]]) -> tuple[list[tuple[str, object]], list[str]]:
    """Answers of a compound question's parts in their order, and a note for each that has none."""
    return [(q, a) for q, a in parts if a is not None], [f"no answer to: {q}" for q, a in parts if a is None]


def same_shape(before: list[str], after: list[str]) -> list[str]:
    """Why a repaired result isn't of the shape that was asked for: columns that are gone, renamed or out of order; more may follow."""
    gone = [c for c in before if c not in after]
    return [f"without {c}" for c in gone] or ([] if [c for c in after if c in before] == before else ["out of order"])


def notes(truncated: bool, cap: int, contracts: set[str], used: set[str], checked: bool) -> dict:
    """The envelope of a result: how far it can be trusted, and why not further.

    contracts are the declared metrics' tables of the question, used the tables that the statement read.
    """
    said = [f"only the first {cap} rows are shown"] if truncated else []
    if contracts and not contracts & used:
        said.append(f"read around the declared {', '.join(sorted(contracts))}")
    elif contracts - used:
        said.append(f"only a part of the declared {', '.join(sorted(contracts))}")
    trust = "low" if contracts and not contracts & used or not checked else "medium" if said else "high"
    return {"trust": trust, "notes": said}


def hybrid(data: tuple[list[str], list[tuple]] | None, text: str | None, citations: int) -> dict:
    """One outcome of a data and a document answer: each counts only with substance, rows with a value or text with a citation."""
    rows = data is not None and any(v is not None for r in data[1] for v in r)
    told = bool(text and text.strip()) and citations > 0
    return {"kind": "hybrid" if rows and told else "data" if rows else "document" if told else "none", "data": data if rows else None, "text": text if told else None}
