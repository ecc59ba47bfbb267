"""Text normalisation, tokens, similarity and chunking."""

from __future__ import annotations

import html
import json
import math
import re
import unicodedata
from html.parser import HTMLParser

#: English function words that carry no search meaning.
STOP = {"the", "and", "for", "are", "was", "with", "that", "this", "from", "what", "which", "how", "of", "is", "to", "in", "on", "an", "it", "be", "by", "or", "as", "at"}


def normalize(text: str) -> str:
    """Full-width folded, punctuation to spaces, lower case, polite openings dropped."""
    t = unicodedata.normalize("NFKC", text).lower()
    t = re.sub(r"[^\w\s.%-]+", " ", t)
    t = re.sub(r"\s+", " ", t).strip()
    return re.sub(r"^(please|could you|can you|请问|请|帮我|麻烦)\s*(tell me|show me|查一下|看一下)?\s*", "", t)


def exact_tokens(q: str, most: int = 8) -> list[str]:
    return list(dict.fromkeys(re.findall(r"[A-Za-z0-9-]{6,}", unicodedata.normalize("NFKC", q))))[:most]


def terms(text: str) -> list[str]:
    """Words of two characters or more, each once; runs of Chinese characters give their pairs, since no blanks divide them."""
    words: list[str] = []
    for w in re.findall(r"[\u4e00-\u9fff]+|[^\W\u4e00-\u9fff]+", unicodedata.normalize("NFKC", text).lower()):
        words += [w[k : k + 2] for k in range(max(1, len(w) - 1))] if "\u4e00" <= w[0] <= "\u9fff" else [w]
    return list(dict.fromkeys(w for w in words if len(w) >= 2 and w not in STOP))


def trigrams(word: str) -> list[str]:
    w = f"  {word} "
    return [w[k : k + 3] for k in range(len(w) - 2)]


def word_similarity(query: str, text: str) -> float:
    """Greatest trigram similarity of the query with a run of the text's trigrams, in text order."""
    q = {t for w in re.findall(r"\w+", query.lower()) for t in trigrams(w)}
    seq = [t for w in re.findall(r"\w+", text.lower()) for t in trigrams(w)]
    hit = [k for k, t in enumerate(seq) if t in q]
    best = 0.0
    for a, start in enumerate(hit):
        extent: set[str] = set()
        seen = start
        common = 0
        for stop in hit[a:]:
            extent.update(seq[seen : stop + 1])
            seen = stop + 1
            common = len(extent & q)
            best = max(best, common / (len(q) + len(extent) - common))
            if len(extent) > 2 * len(q):
                break
    return best


def longest_common_run(a: str, b: str) -> int:
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        row = [0] + [row[k] + 1 if x == y else 0 for k, y in enumerate(b)]
        best = max(best, *row)
    return best


def windows(text: str, least: int = 2, most: int = 8) -> list[tuple[int, str]]:
    """Substrings of 2 to 8 characters with their places, the longer ones first."""
    return [(k, text[k : k + n]) for n in range(min(most, len(text)), least - 1, -1) for k in range(len(text) - n + 1)]


def name_similarity(a: str, b: str) -> float:
    """1 for equal names, 0.5 + half the length ratio if one holds the other, else shared letters or prefix."""
    x, y = (re.sub(r"[^a-z0-9]", "", s.lower()) for s in (a, b))
    if not x or not y:
        return 0.0
    if x == y:
        return 1.0
    if x in y or y in x:
        return 0.5 + 0.5 * min(len(x), len(y)) / max(len(x), len(y))
    same = next((k for k, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
    return max(len(set(x) & set(y)) / len(set(x) | set(y)), same / max(len(x), len(y)))


def est_tokens(chars: int) -> int:
    return math.ceil(chars / 1.6)


class _Text(HTMLParser):
    BLOCK = {"p", "div", "br", "li", "tr", "table", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "title", "pre"}
    SKIP = {"script", "style", "noscript", "template", "svg"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.skip = [], 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in self.SKIP
        if tag in self.BLOCK:
            self.out.append("\n")

    def handle_endtag(self, tag):
        self.skip = max(0, self.skip - (tag in self.SKIP))
        if tag in self.BLOCK:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data)


def html_text(raw: str | None) -> str:
    p = _Text()
    p.feed(raw or "")
    p.close()
    lines = [re.sub(r"[ \t\r\f\v]+", " ", x).strip() for x in "".join(p.out).split("\n")]
    return "\n".join(x for x in lines if x)


def md_blocks(text: str) -> list[tuple[str, str]]:
    """(heading path, body) blocks of a Markdown text."""
    stack: list[tuple[int, str]] = []
    out, body = [], []

    def close():
        if any(x.strip() for x in body):
            out.append((" > ".join(h for _, h in stack), "\n".join(body).strip()))
        body.clear()

    for line in text.split("\n"):
        if m := re.match(r"(#{1,6})\s+(.*)", line):
            close()
            while stack and stack[-1][0] >= len(m[1]):
                stack.pop()
            stack.append((len(m[1]), html.unescape(m[2]).strip()))
        else:
            body.append(line)
    close()
    return out


def chunk(text: str, target: int = 400, overlap: int = 60, hard: int = 480) -> list[tuple[int, int]]:
    """Character spans of about `target` tokens, ended at sentences; neighbours share about `overlap` tokens."""
    ends = [m.end() for m in re.finditer(r"[.!?。！？\n]+\s*", text)]
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
    units, at = [], 0
    most = int(hard * 1.6)
    for e in ends:
        while e - at > most:
            units.append((at, at + most))
            at += most
        if e > at:
            units.append((at, e))
        at = e
    out, k = [], 0
    while k < len(units):
        start, j = units[k][0], k
        while j + 1 < len(units) and est_tokens(units[j + 1][1] - start) <= target:
            j += 1
        if out and units[j][1] <= out[-1][1]:
            k = j + 1  # beside the overlap nothing new fits
            continue
        out.append((start, units[j][1]))
        if j + 1 == len(units):
            break
        back = j
        while back > k and est_tokens(units[j][1] - units[back][0]) <= overlap:
            back -= 1
        k = max(back + 1 if back < j else j + 1, k + 1)
    return out


def clean_label(comment: str) -> str | None:
    """A dimension's name from a column's comment: what stands before brackets, colons, commas and lists of codes; None if nothing is left."""
    t = re.sub(r"[(（\[【{].*?[)）\]】}]", "", unicodedata.normalize("NFKC", comment))
    t = re.split(r"[:：,，;；。/|]|\d+\s*[-=.、]", t)[0]
    t = re.sub(r"(?:代码|编码|编号|名称| code| name| id)$", "", t.strip(), flags=re.I).strip()
    return t if 0 < len(t) <= 20 else None


def fnv1a64(text: str) -> str:
    """The 64-bit FNV-1a hash of a text's UTF-8 bytes, in hexadecimal."""
    h = 0xCBF29CE484222325
    for b in text.encode():
        h = (h ^ b) * 0x100000001B3 % (1 << 64)
    return f"{h:016x}"


def recipe(name: str, folder: str, heading: str, body: str) -> str:
    """The text that stands for a chunk where it is embedded: what it is of, then its body."""
    return "\n".join([*(x for x in (folder, name, heading) if x), body])


def json_block(raw: str, most: int = 20_000) -> str:
    """A JSON text as an indented block of code; as it is if it doesn't parse."""
    try:
        return "```json\n" + json.dumps(json.loads(raw), ensure_ascii=False, indent=2)[:most] + "\n```"
    except ValueError:
        return raw[:most]


def chunk_by_meaning(text: str, least: float = 0.12, target: int = 400) -> list[tuple[int, int]]:
    """Spans of sentences that go on with the words of those before; a new one begins where less than `least` of a
    sentence's words were said in its span, or where the span would pass `target` tokens. A long sentence is cut."""
    ends = [m.end() for m in re.finditer(r"[.!?。！？\n]+\s*", text)]
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
    out: list[tuple[int, int]] = []
    start, at, said = 0, 0, set()
    for e in ends:
        own = set(terms(text[at:e]))
        if at > start and (est_tokens(e - start) > target or own and len(own & said) < least * len(own)):
            out.append((start, at))
            start, said = at, set()
        said |= own
        at = e
    if at > start:
        out.append((start, at))
    hard = int(target * 1.6)
    return [(a + k, min(a + k + hard, z)) for a, z in out for k in range(0, z - a, hard)]


def chunk_by_heading(text: str, top_level: bool = False, target: int = 400, hard: int = 480) -> list[tuple[int, int]]:
    """Spans of a Markdown text that never leave a section, which is a full heading path, or a chapter with `top_level`.

    Paragraphs of one section follow one another up to `target` tokens; neighbours share nothing, so that no words of
    one section stand under another's heading. A paragraph over `hard` tokens is cut at sentences. A heading begins the span of
    what follows it.
    """
    stack: list[tuple[int, str]] = []
    units: list[tuple[str, int, int]] = []  # section, begin, end of a paragraph
    at, start, key = 0, None, ""
    for line in text.splitlines(keepends=True):
        m = re.match(r"(#{1,6})\s+(.*)", line)
        if m or not line.strip():
            if start is not None and (m or text[start:at].lstrip("#").strip()):
                units.append((key, start, at))
                start = None
        if m:
            while stack and stack[-1][0] >= len(m[1]):
                stack.pop()
            stack.append((len(m[1]), m[2].strip()))
            key = stack[0][1] if top_level else " > ".join(h for _, h in stack)
            if start is None:
                start = at
        elif line.strip() and start is None:
            start = at
        at += len(line)
    if start is not None:
        units.append((key, start, at))
    out: list[tuple[str, int, int]] = []
    for k, a, z in units:
        if out and out[-1][0] == k and est_tokens(z - out[-1][1]) <= target:
            out[-1] = (k, out[-1][1], z)
        elif est_tokens(z - a) <= hard:
            out.append((k, a, z))
        else:
            out += [(f"{k}\0", a + x, a + y) for x, y in chunk(text[a:z], target, 0, hard)]
    return [(a, z) for _, a, z in out]
