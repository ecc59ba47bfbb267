"""The recurrent model's kernels: what they hold at once, frequent words, and large logits."""

import tracemalloc

import numpy as np

from quarry.llm import gru, lm_scoring


def model(hidden, side, seed=0):
    rng = np.random.default_rng(seed)
    counts = 1 / np.arange(1, side * side + 1)
    word = rng.choice(side * side, (16, 256), p=counts / counts.sum())
    word[rng.random(word.shape) < 0.4] = gru.UNKNOWN
    return gru.start(counts * 1e6, hidden, side, side), word, rng


def test_logits_are_held_a_block_at_a_time():
    """A window's logits stay in the processor's cache: fewer bytes are taken at once than the logits of one softmax have."""
    p, word, rng = model(4, 67)
    word = np.tile(word.ravel(), 8)
    h = rng.standard_normal((len(word), 4)).astype(np.float32)
    for work in (gru.output, gru.likelihood):
        tracemalloc.start()
        work(p, h, word)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert most < len(word) * 67 * 4


def test_row_sums_of_frequent_and_rare_words():
    _, word, rng = model(4, 20)
    v = rng.standard_normal((word.size, 12))
    for w in (word.ravel(), word.ravel() + (1 << 20), np.zeros(word.size, np.int64)):
        seen, got = gru.row_sums(w, v)
        want = np.zeros((w.max() + 1, 12))
        np.add.at(want, w, v)
        assert sorted(seen) == np.unique(w).tolist() and np.allclose(got, want[seen])


def test_logits_beyond_a_plain_exponential():
    """Each softmax holds where exponentials overflow or vanish, in training and in scoring."""
    p, word, rng = model(8, 6)
    h = np.tanh(rng.standard_normal((4096, 8))).astype(np.float32)
    for shift in (300.0, -300.0):
        far = p | {"ca": p["ca"] + np.float32(shift), "wb": p["wb"] + np.float32(shift)}
        want, grads, back = gru.output(p, h, word.ravel())
        got, far_grads, far_back = gru.output(far, h, word.ravel())
        assert np.allclose(got, want, atol=1e-3) and np.allclose(back, far_back, atol=1e-6)
        assert all(np.allclose(grads[k][1], far_grads[k][1], atol=1e-5) for k in grads)
        assert np.allclose(gru.likelihood(far, h, word.ravel()), want, atol=1e-3)


def test_words_outside_the_classes():
    """Single ids and classes are one distribution, with right gradients, and a text's score is that of its single steps."""
    rng = np.random.default_rng(1)
    dims, ids = (5, 3, 4, 4), 16
    p = {k: v.astype(np.float64) for k, v in gru.start(rng.integers(1, 50, ids).astype(float), *dims).items()}
    given, target, h = rng.integers(0, ids, (6, 3)), rng.integers(0, ids, (6, 3)), np.zeros((3, 5))
    grads = gru.dense(p, gru.window_gradient(p, given, target, h)[1])
    for k in p:
        for i in {(int(given[1, 0]), 3) if k == "x" else tuple(rng.integers(0, s) for s in p[k].shape) for _ in range(8)}:
            up, down = ({a: b.copy() for a, b in p.items()} for _ in range(2))
            up[k][i] += 1e-5
            down[k][i] -= 1e-5
            slope = (gru.window_gradient(up, given, target, h)[0] - gru.window_gradient(down, given, target, h)[0]) / 2e-5
            assert abs(slope - grads[k][i]) < 1e-7
    state = rng.standard_normal((1, 5)).repeat(ids, 0)
    for work in (lambda *a: gru.output(*a)[0], gru.likelihood):
        assert abs(np.exp(work(p, state, np.arange(ids))).sum() - 1) < 1e-9
        assert np.allclose(work(p, state[:4], np.arange(4)), work(p, state, np.arange(ids))[:4])  # no word of a class
    lengths, q = np.array([1, 40, 7, 600]), {k: v.astype(np.float32) for k, v in p.items()}
    words = rng.integers(0, ids, lengths.sum())
    for a, n, got in zip(np.cumsum(lengths) - lengths, lengths, gru.score(q, words, lengths)):
        state, before, ll = np.zeros((1, 5), np.float32), np.array([gru.END]), 0.0
        for w in words[a : a + n]:
            state = gru.cell(q, before, state)
            ll += gru.likelihood(q, state, np.array([w]))[0]
            before = np.array([w])
        assert abs(ll - got) < 1e-4 * n


def test_frequent_words_need_few_logits():
    """The network holds as many words as sides() says; those in no class meet a softmax of a quarter of a side."""
    for distinct in (0, 1000, 10**6, 10**8):
        side, dims = lm_scoring.sides(distinct), lm_scoring.layout(distinct)
        assert side * side + 2 <= lm_scoring.ids_of(*dims) <= side * side + 2 + dims[1]
        assert dims[3] == side // 4 and gru.shapes(*dims)["a"][1] == dims[3] + 1 + dims[1]
    h = np.random.default_rng(0).integers(0, 50, 1000).astype(np.uint64) << np.uint64(58)
    assert all(np.array_equal(x, y) for x, y in zip(lm_scoring.distinct_places(h), np.unique(h, return_inverse=True)))
