"""Vector code compression: product codebooks fitted to all vectors by Heap Lloyd.

A vector's integer components are cut into equal parts, and each part position has a codebook of its own. After a
full assignment every part knows an upper bound of the distance to its entry and a lower bound of the distance to
any other; their difference is the slack. A block of vectors keeps a heap of parts for each entry, keyed by the
slack plus the drift that the entry had cumulated when the part came in. When the entries move, an entry's
cumulative drift grows by its own step and the longest step of the others; only parts whose keys it has reached may
have another nearest entry. They are popped, rescanned exactly and pushed to the heap of their entry. A heap is
held as an ascending array, so that popping is reading its beginning.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import array_udf, columns, cut, fields, tidied, with_class

#: Components beyond are held here: the squared distances of greater ones wouldn't fit 64-bit integers.
LARGEST = 1 << 28

STATE = "n long, wide boolean, x binary, code binary, order binary, key binary, deltas binary"


def whole(vectors: pa.Array, scale: int) -> list[bytes | None]:
    """floor(scale * x) of each vector as 32-bit integers; None if the vector or a component is null or not finite."""
    out = []
    for v in vectors.to_pylist():
        a = np.array(v, "<f8") if v and None not in v else np.full(1, np.nan)
        with np.errstate(over="ignore"):
            out.append(np.clip(np.floor(a * scale), -LARGEST, LARGEST).astype("<i4").tobytes() if np.isfinite(a).all() else None)
    return out


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry (ties: the lower) of each row, and the slack: how much farther the next one is.

    Distances are exact in integers; the slack is rounded down by more than a square root's error.
    """
    if len(book) < 2:
        return np.zeros(len(x), np.uint8), np.full(len(x), np.inf)
    best, slack = np.empty(len(x), np.uint8), np.empty(len(x))
    for k in range(0, len(x), 8192):
        d = np.zeros((len(x[k : k + 8192]), len(book)), np.int64)
        for c in range(x.shape[1]):
            one = x[k : k + 8192, c, None] - book[None, :, c]
            d += one * one
        two = np.sqrt(np.partition(d, 1, axis=1)[:, :2].astype(float))
        best[k : k + 8192] = d.argmin(1)
        slack[k : k + 8192] = (two[:, 1] - two[:, 0]) * (1 - 1e-9) - 1e-9 * two[:, 1]
    return best, slack


def heaps(code: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The rows of a part position in the order of their heaps: by entry, then by key."""
    return np.lexsort((key, code)).astype("<u2")


def deltas(x: np.ndarray, rows: np.ndarray, old: np.ndarray | None, new: np.ndarray, entries: int) -> np.ndarray:
    """(entries, 1 + components): what the rows add to each entry's count and sums when they move from old to new."""
    out = np.zeros((entries, 1 + x.shape[1]), np.int64)
    ones = np.concatenate([np.ones((len(rows), 1), np.int64), x[rows]], axis=1)
    np.add.at(out, new, ones)
    if old is not None:
        np.subtract.at(out, old, ones)
    return out


def drift(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """(parts, entries): each entry's own step plus the longest step of the others, rounded up."""
    step = np.sqrt(((new - old).astype(float) ** 2).sum(2)) * (1 + 1e-9)
    top = np.sort(step, axis=1)
    most = top[:, -1:]
    others = np.where((step == most) & ((step == most).sum(1, keepdims=True) == 1), top[:, -2:-1] if step.shape[1] > 1 else 0.0, most)
    return step + others


def pushed(key: np.ndarray) -> np.ndarray:
    """Keys in 32 bits, rounded down."""
    return np.nextafter(key.astype("<f4"), np.float32(-np.inf))


class Block:
    """Up to 65,536 vectors with the entries and heaps of their parts."""

    def __init__(self, x: np.ndarray, code=None, order=None, key=None):
        self.x, self.code, self.order, self.key = x, code, order, key

    @classmethod
    def read(cls, row: dict, parts: int) -> Block:
        n, kind = row["n"], "<i4" if row["wide"] else "<i2"
        x = np.frombuffer(row["x"], kind).reshape(parts, n, -1).astype(np.int64)
        return cls(x, *(np.frombuffer(row[k], t).reshape(parts, n).copy() for k, t in (("code", np.uint8), ("order", "<u2"), ("key", "<f4"))))

    def start(self, books: np.ndarray) -> np.ndarray:
        """Assigns every part by a full scan; the deltas are all counts and sums."""
        found = [nearest(x, book) for x, book in zip(self.x, books)]
        self.code = np.stack([f[0] for f in found])
        self.key = np.stack([pushed(f[1]) for f in found])  # nothing has drifted yet
        self.order = np.stack([heaps(c, k) for c, k in zip(self.code, self.key)])
        every = np.arange(self.x.shape[1])
        return np.stack([deltas(x, every, None, c, books.shape[1]) for x, c in zip(self.x, self.code)])

    def move(self, books: np.ndarray, total: np.ndarray) -> np.ndarray:
        """Pops and rescans the parts whose keys the entries' cumulative drift (parts, entries) has reached."""
        out = np.zeros((len(books), books.shape[1], 1 + self.x.shape[2]), np.int64)
        for p, (x, book) in enumerate(zip(self.x, books)):
            code, order, key = self.code[p], self.order[p], self.key[p]
            ends = np.searchsorted(code[order], np.arange(books.shape[1] + 1))
            popped = []
            for e in range(books.shape[1]):
                heap = order[ends[e] : ends[e + 1]]
                popped.append(heap[: np.searchsorted(key[heap], total[p, e], "right")])
            rows = np.concatenate(popped)
            if not len(rows):
                continue
            new, slack = nearest(x[rows], book)
            moved = new != code[rows]
            out[p] = deltas(x, rows[moved], code[rows][moved], new[moved], books.shape[1])
            code[rows], key[rows] = new, pushed(slack + total[p, new])
            self.order[p] = heaps(code, key)
        return out

    def errors(self, books: np.ndarray) -> np.ndarray:
        out = np.zeros(self.x.shape[1], np.int64)
        for x, book, code in zip(self.x, books, self.code):
            d = x - book[code]
            out += (d * d).sum(1)
        return out

    def write(self, change: np.ndarray) -> list:
        wide = bool(np.abs(self.x).max(initial=0) >= 1 << 15)
        return [self.x.shape[1], wide, self.x.astype("<i4" if wide else "<i2").tobytes(), self.code.tobytes(), self.order.tobytes(), self.key.astype("<f4").tobytes(), change.astype("<i8").tobytes()]


def batches_of(batches, rows: int):
    """Tables of `rows` rows, the last fewer."""
    held, n = [], 0
    for b in batches:
        while b.num_rows:
            take = b.slice(0, rows - n)
            held.append(take)
            n, b = n + take.num_rows, b.slice(take.num_rows)
            if n == rows:
                yield pa.Table.from_batches(held)
                held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def sums(state: DataFrame, parts: int, entries: int, width: int) -> np.ndarray:
    """(parts, entries, width) of all blocks' deltas: added in each task, then by slot."""

    def add(batches):
        total = np.zeros(parts * entries * width, np.int64)
        for b in batches:
            for raw in b.column("deltas"):
                total += np.frombuffer(raw.as_buffer(), "<i8")
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["slot", "value"])

    out = np.zeros(parts * entries * width, np.int64)
    for r in state.select("deltas").mapInArrow(tidied(add), "slot long, value long").groupBy("slot").agg(F.sum("value").alias("value")).collect():
        out[r.slot] = r.value
    return out.reshape(parts, entries, width)


def nullable_key(c: Column) -> Column:
    """The value as text behind a mark, so that null is a key like any other."""
    return F.coalesce(F.concat(F.lit("v"), c.cast("string")), F.lit("n"))


def compress(vectors: DataFrame, **how) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of encode()'s vectors.

    label_error is the sum of error over the rows of a label, null being a label; the digest is over all entries'
    components by part, entry and position. A label may hold any share of the rows.
    """
    out, books = encode(vectors, **how)
    out = cut(out.withColumn("label", nullable_key(F.col("label"))))
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    classes = cut(out.groupBy("label").agg(F.count("*").alias("copies"), F.sum("error").alias("label_error")))
    return with_class(out, classes, "label").select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def encode(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, block: int = 16384, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error) of every vector that is neither null nor holds null or non-finite components, and the codebooks (part, entry, position).

    Each component x is floor(scale * x), held within +-2^28. The codebooks start as the parts of the vectors of the
    `entries` least ids, ascending, null ids last and equal ids by their components' bytes; fewer vectors give fewer
    entries. Each round assigns all parts (ties to the lower entry) and replaces entries by floor(sum / count); unused
    entries stay. At the end parts are assigned once more. code has two hexadecimal digits a part; error is the
    squared distance to the final entries. Empty vectors, and vectors whose length isn't that of the least id's, are
    dropped too; a length that the parts don't divide is an error. Repeated rows are each returned; other columns
    don't matter; an empty table gives no rows and no entries.

    The driver holds the codebooks and their sums, whose size doesn't depend on the number of vectors.
    """
    if not (0 < entries <= 256 and 0 < block <= 65536):
        raise ValueError("at most 256 entries, and blocks of at most 65,536 vectors")
    raw = array_udf(lambda v: pa.array(whole(v, scale), pa.binary()), "binary")
    label_kind = vectors.schema[label_col].dataType.simpleString()
    kept = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), raw(F.col(vec_col)).alias("x")).where("x is not null")
    least = lambda df: df.select("vec_id", "x").orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).collect()
    seeds = least(kept)
    if not seeds:
        return vectors.sparkSession.createDataFrame([], f"vec_id long, label {label_kind}, code string, error long"), np.zeros((parts, 0, 0), np.int64)
    size = len(seeds[0].x) // 4
    if size % parts:
        raise ValueError(f"{parts} parts don't divide vectors of {size} components")
    kept = kept.where(F.octet_length("x") == 4 * size)
    if any(len(r.x) != 4 * size for r in seeds):
        seeds = least(kept)
    books = np.stack([np.frombuffer(r.x, "<i4").reshape(parts, -1) for r in seeds], axis=1).astype(np.int64)
    n_entries, width = books.shape[1], 1 + size // parts
    ids = f"ids array<bigint>, labels array<{label_kind}>"
    state_schema = f"{ids}, {STATE}"

    def listed(values: pa.Array | pa.ChunkedArray) -> pa.Array:
        flat = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
        flat = pa.concat_arrays(flat.chunks) if isinstance(flat, pa.ChunkedArray) else flat
        return pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)

    def stated(id_list, label_list, b: Block, change: np.ndarray) -> pa.RecordBatch:
        values = columns(STATE, [[v] for v in b.write(change)])
        return pa.RecordBatch.from_arrays([id_list, label_list, *values], names=["ids", "labels", *[n for n, _ in fields(STATE)]])

    def first(batches):
        for t in batches_of(batches, block):
            x = np.frombuffer(b"".join(t.column("x").to_pylist()), "<i4").reshape(t.num_rows, parts, -1).transpose(1, 0, 2).astype(np.int64)
            b = Block(x)
            change = b.start(books)
            yield stated(listed(t.column("vec_id")), listed(t.column("label")), b, change)

    def again(now: np.ndarray, total: np.ndarray):
        def run(batches):
            for batch in batches:
                for k in range(batch.num_rows):
                    one = batch.slice(k, 1)
                    b = Block.read({c: one.column(c)[0].as_py() for c, _ in fields(STATE) if c != "deltas"}, parts)
                    change = b.move(now, total)
                    yield stated(one.column("ids"), one.column("labels"), b, change)

        return run

    def last(now: np.ndarray, total: np.ndarray):
        def run(batches):
            for batch in batches:
                for k in range(batch.num_rows):
                    one = batch.slice(k, 1)
                    b = Block.read({c: one.column(c)[0].as_py() for c, _ in fields(STATE) if c != "deltas"}, parts)
                    b.move(now, total)
                    code = [row.tobytes().hex() for row in np.ascontiguousarray(b.code.T)]
                    yield pa.RecordBatch.from_arrays([one.column("ids").flatten(), one.column("labels").flatten(), pa.array(code, pa.string()), pa.array(b.errors(now))], names=["vec_id", "label", "code", "error"])

        return run

    state = cut(kept.mapInArrow(tidied(first), state_schema))
    held, total = np.zeros((parts, n_entries, width), np.int64), np.zeros((parts, n_entries))
    for k in range(rounds):
        held = held + sums(state, parts, n_entries, width)
        count = held[:, :, :1]
        new = np.where(count > 0, held[:, :, 1:] // np.maximum(count, 1), books)
        total = total + drift(books, new)
        books = new
        if k < rounds - 1:
            state = cut(state.mapInArrow(tidied(again(books, total)), state_schema))
    return state.mapInArrow(tidied(last(books, total)), f"vec_id long, label {label_kind}, code string, error long"), books


def decode(codes, books: np.ndarray) -> np.ndarray:
    """The integer vectors that codes stand for."""
    index = np.array([np.frombuffer(bytes.fromhex(c), np.uint8) for c in codes]).reshape(len(codes), len(books))
    return np.concatenate([book[index[:, p]] for p, book in enumerate(books)], axis=1)
