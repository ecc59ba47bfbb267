"""Names in questions: windows resolved to entities, relation phrases, residue, and chunking presets."""

from __future__ import annotations

import hashlib
import re

from .text import chunk, chunk_by_heading, chunk_by_meaning, est_tokens, windows

#: Phrases of the purchase relations.
RELATIONS = {
    "buyers": (r"who (?:bought|buys)\s+(.+)", r"buyers of\s+(.+)", r"(?:谁|哪些客户)买了?(?:过)?(.+)"),
    "copurchase": (r"bought together with\s+(.+)", r"also bought with\s+(.+)", r"买(?:了)?(.+?)(?:的客户)?还买(?:了)?(?:什么|哪些)"),
    "goods": (r"what did\s+(.+?)\s+buy", r"(.+?)买(?:了|过)(?:什么|哪些)"),
}


def relation_of(q: str) -> tuple[str, str] | None:
    """Relation and the words that it is about."""
    for kind in ("copurchase", "goods", "buyers"):
        for p in RELATIONS[kind]:
            if (m := re.search(p, q, re.I)) and (rest := m[1].strip(" ?？。.")):
                return kind, rest
    return None


def resolve(q: str, closed: dict[str, str], known: set[str]) -> list[tuple[str, str]]:
    """(kind, name) of entities in a question: longest first, without overlaps; closed sets exactly, others by part.

    A window of an open set counts only if it is part of exactly one known name.
    """
    taken, out = [False] * len(q), []
    longest = max([len(x) for x in (*closed, *known)] or [0])
    for at, w in windows(q, 2, max(8, longest)):
        if any(taken[at : at + len(w)]) or w != w.strip():
            continue
        if w in closed:
            out.append((at, closed[w], w))
        elif len(hit := [n for n in known if w in n]) == 1 and len(w) >= 3:
            out.append((at, "name", hit[0]))
        else:
            continue
        taken[at : at + len(w)] = [True] * len(w)
    return [(k, n) for _, k, n in sorted(out)]


def purify(hits: list[str], exact: str | None = None) -> list[str]:
    """Hits of two or more characters, each once, without those inside a longer one; an exact hit stands alone."""
    some = list(dict.fromkeys(h for h in hits if len(h) >= 2))
    if exact in some:
        return [exact]
    return [h for h in some if not any(h != o and h in o for o in some)]


def residue(q: str, consumed: list[str], strip: tuple[str, ...] = ()) -> str:
    """What of a question no rule has used."""
    for w in sorted((*consumed, *strip), key=len, reverse=True):
        q = q.replace(w, " ") if w else q
    return re.sub(r"[\W_]+", " ", q).strip()


def entity_key(name: str) -> str | None:
    """Normalised entity name; None for noise: single characters, numbers, dates."""
    n = re.sub(r"\s+", " ", name.strip().strip("\"'“”《》()（）")).lower()
    return None if len(n) < 2 or re.fullmatch(r"[\d\W_]+", n) else n


def entity_id(space: str, name: str) -> str | None:
    """An id that the same name of a space always gets; None for noise."""
    key = entity_key(name)
    return None if key is None else hashlib.sha256(f"{space}\0{key}".encode()).hexdigest()[:24]


def chunk_preset(text: str, preset: str = "general") -> list[tuple[int, int]]:
    """Spans by preset: semantic by full heading path, meaning by words in common, laws by article, qa by question, book by chapter, else general; long parts are cut further."""
    marks = {"laws": r"(?m)^(?:第[一二三四五六七八九十百零\d]+条|Article\s+\d+)", "qa": r"(?m)^(?:Q[:：]|问[:：])", "book": r"(?m)^(?:第[一二三四五六七八九十百零\d]+章|Chapter\s+\d+|#\s)"}
    if preset == "semantic":
        return chunk_by_heading(text)
    if preset == "meaning":
        return chunk_by_meaning(text)
    if preset not in marks:
        return chunk(text)
    at = sorted({0, *(m.start() for m in re.finditer(marks[preset], text)), len(text)})
    out = []
    for a, z in zip(at, at[1:]):
        if est_tokens(z - a) <= 480:
            out.append((a, z))
        else:
            out += [(a + x, a + y) for x, y in chunk(text[a:z])]
    return out


def chunk_table(header: str, rows: list[str], most: int = 400) -> list[str]:
    """Rows in chunks that each begin with the header."""
    out, body = [], []
    for r in rows:
        if body and est_tokens(len("\n".join([header, *body, r]))) > most:
            out.append("\n".join([header, *body]))
            body = []
        body.append(r)
    return out + (["\n".join([header, *body])] if body else [])
