"""Numbers, grounding, versions and formatting of answers."""

from __future__ import annotations

import json
import re


def compress(n: float) -> str:
    """万 and 亿 with two decimals."""
    for unit, name in ((1e8, "亿"), (1e4, "万")):
        if abs(n) >= unit:
            return f"{n / unit:.2f}{name}"
    return f"{n:.2f}".rstrip("0").rstrip(".")


def change_text(current: float | None, base: float | None, points: bool = False) -> str:
    if current is None or base is None:
        return "-"
    d = current - base
    if points:
        return f"{d * 100:+.1f}pp"
    if abs(base) < 1e-6:
        return "0.0%" if abs(current) < 1e-6 else "new"
    return f"{d / abs(base) * 100:+.1f}%"


def numbers(text: str) -> list[str]:
    """Numbers as written, thousands separators dropped."""
    return [x.replace(",", "") for x in re.findall(r"-?\d+(?:,\d{3})*(?:\.\d+)?%?", text)]


UNITS = {"十": 10, "百": 100, "千": 1000, "万": 10**4, "亿": 10**8}


def chinese_number(s: str) -> int | None:
    """A whole number in Chinese numerals; None for anything else."""
    digits = {c: k for k, c in enumerate("零一二三四五六七八九")} | {"两": 2}
    if not s or any(c not in digits and c not in UNITS for c in s):
        return None
    total = part = digit = 0
    for c in s:
        if c in digits:
            digit = digits[c]
        elif UNITS[c] >= 10**4:
            total, part, digit = (total + part + digit) * UNITS[c], 0, 0
        else:
            part, digit = part + (digit or 1) * UNITS[c], 0
    return total + part + digit


def values(text: str) -> list[float]:
    """The numbers of a text by value: digits with 万 or 亿, percents as shares, and Chinese numerals of two characters or more."""
    out = []
    for m in re.finditer(r"(-?\d+(?:,\d{3})*(?:\.\d+)?)\s*(%|万|亿)?", text):
        out.append(float(m[1].replace(",", "")) * {"%": 0.01, "万": 1e4, "亿": 1e8, None: 1.0}[m[2]])
    for m in re.finditer("[零一二两三四五六七八九十百千万亿]{2,}", re.sub(r"\d[\d,.]*\s*[万亿]", " ", text)):
        if (n := chinese_number(m[0])) is not None:
            out.append(float(n))
    return out


def bound_claims(claims: list[tuple[str, list[str]]], facts: dict[str, float], within: float = 0.005) -> list[str]:
    """The claims (text, ids of facts) whose every number is that of a fact it cites, within a relative error; others are dropped."""
    out = []
    for text, ids in claims:
        known = [facts[i] for i in ids if i in facts]
        if ids and len(known) == len(ids) and all(any(abs(v - f) <= within * max(abs(f), 1e-9) or abs(abs(v) - abs(f)) <= within * max(abs(f), 1e-9) for f in known) for v in values(text)):
            out.append(text)
    return out


def grounded(answer: str, cited: dict[int, str]) -> str:
    """Sentences with a citation like [1] whose numbers all stand in what they cite."""
    out = []
    for s in re.split(r"(?<=[.!?。！？])(?!\s*\[\d)\s*", answer):
        refs = [int(x) for x in re.findall(r"\[(\d+)\]", s)]
        body = re.sub(r"\[\d+\]", "", s)
        source = " ".join(cited.get(r, "") for r in refs)
        if refs and all(r in cited for r in refs) and set(numbers(body)) <= set(numbers(source)):
            out.append(s.strip())
    return " ".join(out)


def extract_json(text: str):
    """The first JSON object or array in prose; None if there is none."""
    decoder = json.JSONDecoder()
    for m in re.finditer(r"[{\[]", text):
        try:
            return decoder.raw_decode(text[m.start() :])[0]
        except ValueError:
            continue
    return None


def version_of(name: str) -> tuple[str, str | None]:
    """Family and revision from a file name: v2, V1.3, 2024-05-01, (3)."""
    stem = re.sub(r"\.[A-Za-z0-9]{1,5}$", "", name)
    m = re.search(r"[\s_(-]*(?:[vV](\d+(?:\.\d+)*)|(20\d{2}[-_.]?\d{2}(?:[-_.]?\d{2})?)|\((\d+)\))\)?$", stem)
    return (stem[: m.start()] or stem, next(g for g in m.groups() if g)) if m else (stem, None)


def sanitize(text: str, most: int = 2000) -> str:
    """For logs: secrets hidden, clipped by characters."""
    return re.sub(r"(?i)(password|token|secret|api_?key)(\s*[:=]\s*)\S+", r"\1\2***", text)[:most]
