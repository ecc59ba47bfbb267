"""Heap Lloyd against plain Lloyd iterations, on awkward rows."""

import hashlib

import numpy as np
import pytest

from quarry.llm import vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error string"


def plain(rows, parts=16, entries=64, rounds=2):
    """Full scans of every part in every round; rows are (id, integer vector) in order of their ids."""
    x = np.array([r[1] for r in rows], dtype=np.int64).reshape(len(rows), parts, -1)
    books = x[:entries].transpose(1, 0, 2).copy()

    def assign():
        d = ((x[:, :, None, :] - books[None]) ** 2).sum(3)
        return d.argmin(2), d.min(2)

    for _ in range(rounds):
        code, _ = assign()
        for p in range(parts):
            for e in range(books.shape[1]):
                mine = x[code[:, p] == e, p]
                if len(mine):
                    books[p, e] = mine.sum(0) // len(mine)
    code, d = assign()
    return ["".join(f"{c:02x}" for c in r) for r in code], d.sum(1), books


@pytest.mark.parametrize("n, block", [(900, 16384), (900, 100), (40, 16384)])
def test_against_plain_lloyd(spark, n, block):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(9, 64))
    v = (centres[rng.integers(0, 9, n)] + 0.2 * rng.normal(size=(n, 64))).astype(np.float32)
    v[n // 2 :] = np.where(rng.random((n - n // 2, 1)) < 0.3, v[0], v[n // 2 :])  # repeated vectors and ties
    rows = [(int(i), v[i].tolist(), int(rng.integers(3)) if i % 7 else None, "clash", "clash") for i in range(n)]
    bad = [(9001, None, 1, "", ""), (9002, [float("nan")] * 64, 1, "", ""), (9003, [None] + [0.0] * 63, 1, "", ""), (9004, [float("inf")] + [0.0] * 63, 1, "", ""), (9005, [], 1, "", ""), (9006, [1.0] * 32, 1, "", "")]
    more = [(None, v[3].tolist(), 2, "", ""), (n - 1, v[n - 1].tolist(), None, "", "")]
    order = [(r[0], np.floor(256.0 * np.array(r[1])).astype(int)) for r in (*rows, more[1], more[0])]
    code, error, books = plain(order)
    labels = [r[2] for r in (*rows, more[1], more[0])]
    of = {lab: sum(int(e) for e, x in zip(error, labels) if x == lab) for lab in set(labels)}
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    want = sorted(((-1 if r[0] is None else r[0]), c, int(e), of[lab], digest) for r, c, e, lab in zip(order, code, error, labels))
    df = spark.createDataFrame(rows + bad + more, SCHEMA)
    got = sorted(((-1 if r[0] is None else r[0]), *r[1:]) for r in vector_codes.compress(df, block=block).collect())
    assert got == want


def test_pops_little_and_nothing_wrong():
    """Rounds by heaps leave the same entries as full scans, and pop fewer parts than there are."""
    rng = np.random.default_rng(2)
    x = np.rint(rng.integers(-4000, 4000, (8, 1, 4)) + 20 * rng.normal(size=(1, 3000, 4))).astype(np.int64)[rng.integers(0, 8, 3000), np.arange(3000)][None]
    books = x[:, :: 3000 // 16][:, :16].copy()
    b, total = vector_codes.Block(x), np.zeros((1, 16))
    b.start(books)
    for k in range(6):
        new = books + rng.integers(-9, 9, books.shape) * (k % 2 + 1)
        total = total + vector_codes.drift(books, new)
        books = new
        b.move(books, total)
        assert np.array_equal(b.code[0], vector_codes.nearest(x[0], books[0])[0])


def test_decodes_and_empty(spark):
    rng = np.random.default_rng(8)
    v = rng.normal(size=(300, 32)).astype(np.float32)
    df = spark.createDataFrame([(i, v[i].tolist(), 1, "", "") for i in range(300)], SCHEMA)
    out, books = vector_codes.encode(df, parts=8, entries=32, rounds=3)
    rows = out.collect()
    back = vector_codes.decode([r.code for r in rows], books)
    ints = np.floor(256.0 * v[[r.vec_id for r in rows]]).astype(int)
    assert [r.error for r in rows] == ((ints - back) ** 2).sum(1).tolist()
    assert vector_codes.compress(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        vector_codes.encode(df, parts=7)
