"""Packing: vector bin packing of token sequences by the dot-product heuristic."""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import record, tidied

#: Fixed value: the pre-tokenizer's pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END = 1
SPACES = re.compile(r"\s\s")
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss long"


class Parts(dict):
    """Ids, as bytes, of the parts between single spaces, told apart by their own characters; long ones aren't kept."""

    def __init__(self, bpe, longest: int = 64):
        super().__init__()
        self.bpe, self.longest = bpe, longest

    def __missing__(self, part: str) -> bytes:
        ids = np.array(self.bpe(" " + part), "<u4").tobytes()
        if len(part) <= self.longest:
            self[part] = ids
        return ids


class Encoder:
    """Byte-level BPE of a tokenizers file; a part between single spaces is encoded once as long as the table keeps it.

    No token reaches over a space that has no white space beside it, so the text's ids are those of its parts.
    Texts where white space meets white space, or stands at an end, are encoded whole. The file's special tokens
    are taken out of a text first, and what lies between them is encoded apart, as the tokenizers library does.
    The table is bounded.
    """

    def __init__(self, path: str, bound: int = 200_000):
        import tiktoken

        file = json.load(open(path, encoding="utf-8"))
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(x for x in range(256) if x not in plain)}
        self.special = {x["content"]: x["id"] for x in file["added_tokens"]}
        self.marks = re.compile("|".join(re.escape(x) for x in sorted(self.special, key=len, reverse=True)) or "(?!)")
        ranks = {bytes(byte[c] for c in t): i for t, i in file["model"]["vocab"].items() if t not in self.special and all(c in byte for c in t)}
        self.whole = tiktoken.Encoding("whole", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        # without the look-ahead, which matters only where white space meets white space
        self.bpe = tiktoken.Encoding("parts", pat_str=PATTERN.replace(r"|\s+(?!\S)", ""), mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.parts, self.bound = Parts(self.bpe), bound

    def ids(self, text: str) -> bytes:
        """Ids of a text without special tokens, as little-endian unsigned 32-bit bytes."""
        if text.find(" ") <= 0 or text[-1].isspace() or text[0].isspace() or SPACES.search(text):
            return np.array(self.whole(text), "<u4").tobytes()
        if len(self.parts) > self.bound:
            self.parts.clear()
        head, *rest = text.split(" ")
        return np.array(self.bpe(head), "<u4").tobytes() + b"".join(map(self.parts.__getitem__, rest))

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text, then END."""
        out, at = [], 0
        for m in self.marks.finditer(text):
            out += [self.ids(text[at : m.start()]), np.array([self.special[m[0]]], "<u4").tobytes()]
            at = m.end()
        out += [self.ids(text[at:]), np.array([END], "<u4").tobytes()]
        return np.frombuffer(b"".join(out), "<u4")


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def place(tokens: np.ndarray, loss: np.ndarray, limits: tuple[int, int, int], cut: bool, last: bool, sums: list[np.ndarray] | None = None, least_gap: int = 32):
    """Sequences as lists of (item, from, length); items that are left for a later call, as (item, from).

    limits: tokens, segments, loss-bearing tokens of a sequence. The open sequence takes the item that fits and
    has the largest dot product of its vector with the room that is left, each dimension as a share of its limit.
    If none fits and `cut` is on, the item with the least tokens of which a part fits is cut to fill the gap; else
    the sequence closes. sums[k] counts item k's loss-bearing tokens before each of its tokens and behind the
    last; without sums every token bears loss. Unless `last`, a sequence that isn't full stays open: its items
    are handed back.
    """
    t, l, at = np.array(tokens, np.int64), np.array(loss, np.int64), np.zeros(len(tokens), np.int64)
    free, size = np.ones(len(t), bool), np.array(limits, float)
    out: list[list[tuple[int, int, int]]] = []

    def part(k: int, gap: int, room: int) -> int:
        """How many tokens of item k fit from where it stands, fewer than all."""
        if sums is None:
            return min(gap, room, int(t[k]) - 1)
        fits = int(np.searchsorted(sums[k], sums[k][at[k]] + room, "right")) - 1 - int(at[k])
        return min(gap, fits, int(t[k]) - 1)

    while free.any():
        room = np.array(limits, np.int64)
        mine: list[tuple[int, int, int]] = []
        while room[1] > 0:
            r = room / size
            score = np.where(free & (t <= room[0]) & (l <= room[2]), t * (r[0] / size[0]) + l * (r[2] / size[2]) + r[1] / size[1], -1.0)
            k = int(score.argmax())
            if score[k] < 0:
                break
            mine.append((k, int(at[k]), int(t[k])))
            room -= (t[k], 1, l[k])
            free[k] = False
        gap = int(room[0])
        if cut and gap >= min(least_gap, limits[0]) and room[1] > 0 and free.any():
            some = np.flatnonzero(free)
            for k in some[np.argsort(t[some], kind="stable")].tolist():
                take = part(k, gap, int(room[2]))
                if take > 0:
                    mine.append((k, int(at[k]), take))
                    at[k] += take
                    t[k] -= take
                    l[k] = t[k] if sums is None else sums[k][-1] - sums[k][at[k]]
                    gap -= take
                    break
        if not mine:
            raise ValueError("an item exceeds the limits of a sequence")
        if not last and not free.any() and gap:
            return out, [(k, a) for k, a, _ in mine]
        out.append(mine)
    return out, []


class Packer:
    """One task's sequences: items wait in a buffer of about `buffer` tokens or `most` items, then are placed.

    An item is (keys, ids, loss sums or None, from). Rows are the keys, then start, length, ids_crc32, doc_tokens,
    sequence_id, offset and loss.
    """

    def __init__(self, limits: tuple[int, int, int], schema: str, buffer: int, most: int):
        task = TaskContext.get()
        self.limits, self.schema, self.buffer, self.most = limits, schema, buffer, most
        self.sequence = (task.partitionId() if task else 0) << 33
        self.rows: list[tuple] = []
        self.pending: list[tuple] = []
        self.held = 0

    def emit(self, keys, ids, sums, start, length, at):
        loss = length if sums is None else int(sums[start + length] - sums[start])
        self.rows.append((*keys, start, length, zlib.crc32(ids[start : start + length].astype("<u4").tobytes()), len(ids), self.sequence, at, loss))

    def add(self, keys: tuple, ids: np.ndarray, sums: np.ndarray | None = None) -> None:
        """Whole windows of `size` tokens are sequences of their own where every token bears loss and may."""
        size, first = self.limits[0], 0
        if sums is None and self.limits[2] >= size:
            while len(ids) - first >= size:
                self.emit(keys, ids, None, first, size, 0)
                self.sequence += 1
                first += size
        if first < len(ids):
            self.pending.append((keys, ids, sums, first))
            self.held += len(ids) - first
        if self.held >= self.buffer or len(self.pending) >= self.most:
            self.flush(False)

    def flush(self, last: bool) -> None:
        items = self.pending
        if items:
            sums = None if items[0][2] is None else [s[a:] - s[a] for _, _, s, a in items]
            n = np.array([len(i) - a for _, i, _, a in items], np.int64)
            loss = n if sums is None else np.array([s[-1] for s in sums], np.int64)
            done, left = place(n, loss, self.limits, True, last, sums)
            for s in done:
                at = 0
                for k, a, length in s:
                    keys, ids, own, first = items[k]
                    self.emit(keys, ids, own, first + a, length, at)
                    at += length
                self.sequence += 1
            self.pending = [(*items[k][:3], items[k][3] + a) for k, a in left]
        self.held = sum(len(i) - a for _, i, _, a in self.pending)

    def drain(self):
        out = record(self.schema, [list(x) for x in zip(*self.rows)])
        self.rows = []
        return out


def pack(docs: DataFrame, path: str, size: int = 2048, segments: int = 256, loss: int | None = None, buffer: int = 1 << 19, most: int = 8192) -> DataFrame:
    """Pieces of every row of docs (doc_id, text) packed into sequences of at most `size` tokens.

    A text's ids are those of the tokenizers file at `path`, then END. Each task packs its own rows, by
    buffers of about `buffer` tokens or `most` items, so nothing is shuffled and memory and work are bounded;
    sequences get ids that no other task gives. Whole windows of `size` tokens are sequences of their own; what is
    left over is placed by vectors of tokens, segments and loss-bearing tokens (in plain documents, all of them;
    pack_conversations() has a mask). Null text counts as empty and gives the one token END; repeated rows and
    null ids are packed like any other; an empty table gives no rows. A retried task gives the same rows, as its
    input rows come in the same order.
    """

    def run(batches):
        enc, task = encoder(path), Packer((size, segments, loss or size), PIECES, buffer, most)
        for b in batches:
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                task.add((doc,), enc.encode(text.as_py() or ""))
                if len(task.rows) >= 4096:
                    yield task.drain()
        task.flush(True)
        if task.rows:
            yield task.drain()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidied(run), PIECES)


TURNS = PIECES.replace("doc_id long,", "conv_id long, turn long,")


def pack_conversations(turns: DataFrame, path: str, size: int = 2048, segments: int = 64, loss: int = 1024, bearing: tuple[str, ...] = ("assistant",), buffer: int = 1 << 19, most: int = 8192) -> DataFrame:
    """Instruction data (conv_id, turn, role, text) packed under limits on tokens, segments and loss-bearing tokens.

    An item is a run of consecutive turns of one conversation, of up to `size` tokens or one longer turn; its ids
    are those of its texts, each with an END. The tokens of turns whose role is in `bearing` bear loss, and at
    most `loss` of them lie in a sequence; the column loss counts a piece's. turn is the item's first turn, and
    start and doc_tokens count in the item. Turns are ordered by ranges of (conv_id, turn), so that a very long
    conversation is several tasks' work. Null text counts as empty, null role bears no loss, null ids are one
    conversation; repeated turns are kept; an empty table gives no rows.
    """

    def run(batches):
        enc, task = encoder(path), Packer((size, segments, loss), TURNS, buffer, most)
        item: list[tuple[np.ndarray, np.ndarray]] = []
        key, length = None, 0

        def close():
            nonlocal item, length
            if item:
                task.add(key, np.concatenate([i for i, _ in item]), np.concatenate([[0], np.cumsum(np.concatenate([m for _, m in item]))]))
            item, length = [], 0

        for b in batches:
            for conv, turn, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text"))):
                ids = enc.encode(text or "")
                if item and (conv != key[0] or length + len(ids) > size):
                    close()
                if not item:
                    key = (conv, turn)
                item.append((ids, np.full(len(ids), role in bearing, np.int64)))
                length += len(ids)
                if len(task.rows) >= 4096:
                    yield task.drain()
        close()
        task.flush(True)
        if task.rows:
            yield task.drain()

    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    order = ("conv_id", "turn", "role", "text")
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(tidied(run), TURNS)
