"""Secret scans: fixed patterns, and a character convolutional network over every other candidate in its context."""

from __future__ import annotations

import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, record, sample, struct_udf, tidied
from .language_id import logistic

#: The base patterns, and the least length of what they must hold.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "model")
WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

HEX_MAP = bytes(104 if chr(k) in "0123456789abcdef" else 32 for k in range(256))
RUN = re.compile(rb"[A-Za-z0-9+/_.=-]{8,}")
DIGIT = re.compile(rb"[0-9]")
LEAST, LEFT, RIGHT, WIDTH = 12, 24, 12, 5
#: Ids of the network: 0 pads, then ASCII characters of the context, then of the candidate.
IDS = 1 + 2 * 129


def base_spans(t: str, b: bytes) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind; offsets are code points."""
    out, low = [], b.lower()
    if any(w in low for w in WORDS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(t) if len(m[2]) >= 12]
    if b"AKIA" in b:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(t) if m.end() - m.start() >= 18]
    if b"h" * 16 in b.translate(HEX_MAP):
        out += [(m.start(), m.end(), "hex") for m in HEX.finditer(t)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def candidates(b: bytes) -> list[tuple[int, int]]:
    """Byte spans of the runs of [A-Za-z0-9+/_.=-]: all of LEAST characters or more, and those of 8 with a digit."""
    out = []
    for m in RUN.finditer(b):
        body = m[0].strip(b".-")
        a = m.start() + m[0].find(body)
        if len(body) >= LEAST or len(body) >= 8 and DIGIT.search(body):
            out.append((a, a + len(body)))
    return out


def scan(t: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str, str, str]]]:
    """Base spans, and every candidate that no base span touches as (start, end, left, body, right)."""
    b = t.encode()
    base, out, last, done = base_spans(t, b), [], 0, 0
    starts, ends, most = [s[0] for s in base], [], 0
    for s in base:
        most = max(most, s[1])
        ends.append(most)
    plain = len(b) == len(t)
    for a, z in candidates(b):
        done += a - last if plain else len(b[last:a].decode())
        last = a
        start, end = done, done + z - a
        k = bisect_left(starts, end)
        if k and ends[k - 1] > start:
            continue
        out.append((start, end, t[max(0, start - LEFT) : start], t[start:end], t[end : end + RIGHT]))
    return base, out


def ids(left: str, body: str, right: str) -> np.ndarray:
    code = lambda s, off: np.minimum(np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32), 128).astype(np.int64) + 1 + off
    pad = np.zeros(WIDTH // 2, np.int64)
    return np.concatenate([pad, code(left, 0), code(body, 129), code(right, 0), pad])


def piece(row: np.ndarray, window: int, rng: np.random.Generator) -> np.ndarray:
    """A window of a row at a random place; all of a row that isn't longer."""
    at = int(rng.integers(len(row) - window + 1)) if len(row) > window else 0
    return row[at : at + window]


def window_of(column: str, chars: int):
    """A window of a text's characters at a place that its hash tells; all of a text that isn't longer."""
    at = F.pmod(F.xxhash64(column), F.greatest(F.length(column) - chars, F.lit(0)) + 1) + 1
    return F.col(column).substr(at.cast("int"), F.lit(chars))


class Network:
    """Convolution of one-hot characters, a rectifier, the maximum and the mean over positions, and a dense layer."""

    def __init__(self, filters: int = 32, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.w = (rng.standard_normal((WIDTH, IDS, filters)) * 0.15).astype(np.float32)
        self.w[:, 0] = 0
        self.bias = np.zeros(filters, np.float32)
        self.v = (rng.standard_normal(2 * filters) * 0.3).astype(np.float32)
        self.c = np.zeros(1, np.float32)
        self.scale, self.shift, self.least, self.recall, self.precision = 1.0, 0.0, 1.0, 0.0, 0.0

    def layer(self, x: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Rectified responses (rows, positions, filters); zero behind a row's end."""
        n = x.shape[1] - WIDTH + 1
        y = self.bias + self.w[0][x[:, :n]]
        for k in range(1, WIDTH):
            y += self.w[k][x[:, k : k + n]]
        y *= (y > 0) & (np.arange(n)[None] < (length - WIDTH + 1)[:, None])[:, :, None]
        return y

    @staticmethod
    def padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        length = np.fromiter(map(len, rows), np.int64, len(rows))
        x = np.zeros((len(rows), int(length.max())), np.int64)
        x[np.arange(x.shape[1])[None] < length[:, None]] = np.concatenate(rows)
        return x, length

    def features(self, rows: list[np.ndarray], block: int = 40_000) -> np.ndarray:
        """Maximum and mean of each filter over whole candidates of any length, in blocks of bounded size."""
        f = len(self.bias)
        out = np.zeros((len(rows), 2 * f), np.float32)
        length = np.fromiter(map(len, rows), np.int64, len(rows))
        order = np.argsort(length, kind="stable")
        at = 0
        while at < len(rows):
            if length[order[at]] > block:
                x, done = rows[order[at]], length[order[at]] - WIDTH + 1
                for k in range(0, int(done), block):
                    y = self.layer(x[None, k : k + block + WIDTH - 1], np.array([len(x[k : k + block + WIDTH - 1])]))[0]
                    out[order[at], :f] = np.maximum(out[order[at], :f], y.max(0))
                    out[order[at], f:] += y.sum(0) / done
                at += 1
                continue
            stop = at + 1
            while stop < len(rows) and length[order[stop]] * (stop + 1 - at) <= block:
                stop += 1
            x, n = self.padded([rows[i] for i in order[at:stop]])
            y = self.layer(x, n)
            out[order[at:stop], :f] = y.max(1)
            out[order[at:stop], f:] = y.sum(1) / (n - WIDTH + 1)[:, None]
            at = stop
        return out

    def raw(self, rows: list[np.ndarray]) -> np.ndarray:
        return self.features(rows) @ self.v + self.c

    def probability(self, rows: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.raw(rows) + self.shift, -30, 30)))

    def train(self, rows: list[np.ndarray], y: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.02, seed: int = 5, window: int = 400) -> None:
        """Adagrad; both classes weigh the same in all. Rows of like length share a batch.

        Of a row longer than `window` every epoch sees another window, so that over the epochs no part is left out.
        """
        rng = np.random.default_rng(seed)
        weight = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
        length = np.fromiter(map(len, rows), np.int64, len(rows))
        params = [self.w, self.bias, self.v, self.c]
        seen = [np.full_like(a, 1e-6) for a in params]
        f = len(self.bias)
        for _ in range(epochs):
            order = np.argsort(length + rng.random(len(rows)) * 8, kind="stable")
            for k in rng.permutation(np.arange(0, len(order), batch)):
                pick = order[k : k + batch]
                x, n = self.padded([piece(rows[i], window, rng) for i in pick])
                z = self.layer(x, n)
                at, width = z.argmax(1), (n - WIDTH + 1)[:, None]
                m = np.concatenate([z.max(1), z.sum(1) / width], 1)
                d = (weight[pick] * (1 / (1 + np.exp(-(m @ self.v + self.c))) - y[pick]) / len(pick)).astype(np.float32)
                dz = (d[:, None] * self.v[f:] / width)[:, None] * (z > 0)
                r, c = np.arange(len(pick))[:, None], np.arange(f)[None]
                dz[r, at, c] += d[:, None] * self.v[:f] * (m[:, :f] > 0)
                flat = dz.reshape(-1, f)
                g = [np.zeros_like(self.w), flat.sum(0), m.T @ d, np.array([d.sum()], np.float32)]
                for j in range(WIDTH):
                    i = x[:, j : j + z.shape[1]].ravel()
                    by = np.argsort(i, kind="stable")
                    first = np.flatnonzero(np.concatenate([[True], np.diff(i[by]) > 0]))
                    g[0][j][i[by][first]] = np.add.reduceat(flat[by], first)
                g[0][:, 0] = 0
                for a, s, q in zip(params, seen, g):
                    s += q * q
                    a -= rate * q / np.sqrt(s)


LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ALNUM = LOWER + UPPER + DIGITS


class Findings:
    """Labelled findings by rule: secrets of several forms, and things that only look like them, in given contexts.

    Each method of a form returns (words before it, body); bodies are random, so that no finding is a real secret.
    """

    BEARS = ("Authorization: Bearer ", "key: ", "KEY=", "credentials ", "pwd: ", "export ACCESS_KEY=", "private_key = ", "auth=", "--key ", "signature=", "pass ", "login with ", "AccessKey ", "\"key\": \"")
    LOOKS = ("see ", "version ", "file ", "commit ", "sha256:", "id ", "at ", "from ", "order ", "<a href=\"", "isbn ", "build ", "md5 ", "uuid ", "call ", "ref ")

    def __init__(self, contexts: list[tuple[str, str]], words: list[str], seed: int = 23):
        self.rng = np.random.default_rng(seed)
        self.contexts = contexts or [("it was said that ", " and so on"), ("", "")]
        self.words = words or ["intheabletion", "configuration", "documentation", "Verantwortung"]

    def some(self, alphabet: str, n: int, most: int | None = None) -> str:
        n = n if most is None else int(self.rng.integers(n, most + 1))
        return "".join(alphabet[i] for i in self.rng.integers(0, len(alphabet), n))

    def word(self) -> str:
        return self.words[int(self.rng.integers(len(self.words)))]

    def pick(self, options):
        return options[int(self.rng.integers(len(options)))]

    def secret(self) -> str:
        k = int(self.rng.integers(7))
        if k == 0:
            return self.some(ALNUM + "+/", 40)
        if k == 1:
            return self.some(ALNUM + "-_", 32, 64)
        if k == 2:  # a service's prefix and a random part
            return self.some(LOWER, 2, 5) + self.pick("_-") + self.pick(("", "live_", "test_", self.some(DIGITS, 9, 12) + "-")) + self.some(ALNUM, 20, 40)
        if k == 3:
            return ".".join(("eyJ" + self.some(ALNUM, 15, 40), "eyJ" + self.some(ALNUM, 20, 80), self.some(ALNUM + "-_", 27, 43)))
        if k == 4:
            return self.some(UPPER + DIGITS, 16, 32)
        if k == 5:
            return self.some(ALNUM + "+/", 22, 43) + self.pick(("=", "=="))
        return self.some(ALNUM + "_-+=", 12, 20)

    def look_alike(self) -> str:
        k, d = int(self.rng.integers(17)), lambda n: self.some(DIGITS, n)
        w = lambda: self.word().strip(".").lower()
        if k == 0:
            return f"//www.{w()}.com/{w()}/{w()}.html"
        if k == 1:
            return f"{w()}.{d(2)}"
        if k == 2:
            return ".".join(str(self.rng.integers(1, 256)) for _ in range(4))
        if k == 3:
            return f"20{d(2)}-{d(2)}-{d(2)}T{d(2)}"
        if k == 4:
            return f"v{d(1)}.{d(2)}.{d(1)}-rc.{d(1)}"
        if k == 5:
            h = DIGITS + "abcdef"
            return "-".join(self.some(h, n) for n in (8, 4, 4, 4, 12))
        if k == 6:
            return "-".join((d(3), d(3), d(4))) if self.rng.random() < 0.5 else "+" + d(11)
        if k == 7:
            return "_".join((w(), w(), w()))
        if k == 8:
            return "".join(x.capitalize() for x in (w(), w()))
        if k == 9:
            return f"{w()}_20{d(2)}-{d(2)}-{d(2)}.csv"
        if k == 10:
            return d(int(self.rng.integers(8, 16)))
        if k == 11:
            return self.pick("=-_.") * int(self.rng.integers(12, 40))
        if k == 12:
            return f"/{w()}/{w()}/{w()}{d(1)}.py"
        if k == 13:
            return self.word().upper()
        if k == 14:
            return (w() + w()).upper()[: int(self.rng.integers(12, 30))]
        if k == 15:
            return "".join(self.pick((x, x.upper(), x.capitalize())) for x in (w(), w()))
        return self.word()

    def rows(self, n: int, body, marks) -> list[tuple[str, str, str]]:
        out = []
        while len(out) < n:
            left, right = self.pick(self.contexts)
            b = body()
            if len(b.strip(".-")) >= 8:
                left = left if self.rng.random() < 0.5 else left[:8] + self.pick(marks)
                out.append((left[-LEFT:], b, (right if self.rng.random() < 0.8 else self.pick(("\"", "\n", ",", "'"))  + right)[:RIGHT]))
        return out


def entropy(body: str) -> float:
    n = np.unique(list(body), return_counts=True)[1] / len(body)
    return float(-(n * np.log2(n)).sum())


def fit(docs: DataFrame, bound: int = 30_000, findings: int = 6000, made: int = 4000, recall: float = 0.95, seed: int = 23, train_chars: int = 400) -> Network:
    """A network trained on labelled findings: `made` of each label by rule, and those of about `bound` documents.

    The patterns' own findings are learned without what the patterns look for: the key word before an assigned
    value and the mark AKIA are replaced. A document's candidates outside of the base spans are learned as no
    secrets, but for long ones of high entropy, which nobody has looked at; of both at most about `findings`
    rows are used, each by a window of `train_chars` characters at a place that a hash tells, which bounds the fit;
    scoring sees whole candidates. A third of all findings is kept back: it calibrates the score, and the least score for a span is
    the highest at which `recall` of the secrets kept back are caught; recall and precision on them are kept with
    the network. Where the documents give nothing the findings by rule are all.
    """

    def run(batches):
        for b in batches:
            rows = []
            for t, i in zip(b.column("text").to_pylist(), b.column("doc_id").to_pylist()):
                base, more = scan(t or "")
                for a, z, kind in base:
                    m = ASSIGN.match(t, a) if kind == "assign" else None
                    x, y = m.span(2) if m else (a, z)
                    if kind != "hex":
                        rows.append((a, "" if m else t[max(0, x - LEFT) : x], t[x:y] if m else t[x + 4 : y], t[y : y + RIGHT], 1, i))
                rows += [(a, left, body, right, 0, i) for a, _, left, body, right in more]
            if rows:
                yield record(schema, [list(x) for x in zip(*rows)])

    schema = "start long, prior string, body string, after string, label long, doc_id long"
    found = cut(sample(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), bound, "doc_id").mapInArrow(tidied(run), schema))
    got = found.where("label = 1"), found.where("label = 0")
    good, bad = (sample(x.withColumn("body", window_of("body", train_chars)), findings // 2, "doc_id", "start", "body").toPandas().sort_values(["doc_id", "start", "body"]) for x in got)
    bad = bad[[len(x) < 16 or entropy(x) < 4 for x in bad.body]]
    by_rule = Findings(list(zip(bad.prior, bad.after)), [x for x in bad.body if x.isalpha()], seed)
    rng = by_rule.rng
    rows, y = [], []
    for left, body, right in zip(good.prior, good.body, good.after):
        # the words before an assigned value are the pattern's own: other words take their place
        left = left or by_rule.pick(by_rule.contexts)[0] + by_rule.pick(by_rule.BEARS)
        body = body if rng.random() < 0.5 or len(body) > 16 else body + by_rule.some(UPPER + DIGITS, 4)
        rows.append((left[-LEFT:], body, right))
        y.append(1.0)
    rows += zip(bad.prior, bad.body, bad.after)
    y += [0.0] * len(bad)
    rows += by_rule.rows(made, by_rule.secret, by_rule.BEARS) + by_rule.rows(made, by_rule.look_alike, by_rule.LOOKS)
    y = np.array(y + [1.0] * made + [0.0] * made)
    rows = [ids(*r) for r in rows]
    back = np.arange(len(y)) % 3 == 0
    net = Network()
    net.train([r for r, k in zip(rows, back) if not k], y[~back], window=train_chars)
    held = [r for r, k in zip(rows, back) if k]
    net.scale, net.shift = (float(v) for v in logistic(net.raw(held)[:, None], y[back], 1e-3))
    p, t = net.probability(held), y[back] > 0
    net.least = float(np.sort(p[t])[int((1 - recall) * t.sum())])
    net.recall, net.precision = float((p[t] >= net.least).mean()), float(t[p >= net.least].mean())
    return net


SPANS = "n_assign long, n_access long, n_hex long, base string, spans string, text string"


def with_secrets(docs: DataFrame, mark: str | None = None, **options) -> DataFrame:
    """docs with struct _quarry_s: counts of base spans, base and all spans as kind:start:end, and the marked text.

    Base spans always stay; the network adds those candidates outside of them that reach its least score. Spans
    are in code points, end exclusive, by start and then kind. With `mark`, text is the text with the union of the
    spans replaced by it (null stays null); else it is null. Null text counts as empty; repeated rows get equal
    results; an empty table gives no rows.
    """
    net = fit(docs, **options)
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(col: pa.Array):
        net, out = shared.value, []
        for raw in col.to_pylist():
            t = raw or ""
            base, more = scan(t)
            spans = list(base)
            for k in range(0, len(more), 8192):
                p = net.probability([ids(*c[2:]) for c in more[k : k + 8192]])
                spans += [(c[0], c[1], "model") for c, s in zip(more[k:], p) if s >= net.least]
            if more:
                spans.sort(key=lambda s: (s[0], KINDS.index(s[2])))
            n = [sum(s[2] == k for s in base) for k in KINDS[:3]]
            text = None
            if mark is not None and raw is not None:
                parts, at = [], 0
                for a, z, _ in spans:
                    if a > at or not parts:
                        parts += [t[at:a], mark]
                    at = max(at, z)
                text = "".join(parts) + t[at:]
            out.append((*n, *(",".join(f"{k}:{a}:{z}" for a, z, k in v) for v in (base, spans)), text))
        return [list(x) for x in zip(*out)] or [[]] * 6

    return docs.withColumn("_quarry_s", struct_udf(SPANS, run)(F.col("text").cast("string")))


def secret_scan(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) for every row of docs; see with_secrets()."""
    return with_secrets(docs.select("doc_id", "text"), **options).select("doc_id", "_quarry_s.n_assign", "_quarry_s.n_access", "_quarry_s.n_hex", F.sha2("_quarry_s.base", 256).alias("base_sha256"), "_quarry_s.spans")
