"""Gated recurrent language model in numpy with a class-factored output softmax."""

from __future__ import annotations

import numpy as np

#: Word ids: everything outside the vocabulary, and the end of a text, which is also what stands before its start.
UNKNOWN, END = 0, 1
#: Rows of a softmax that are worked on at once.
BLOCK = 512


def shapes(hidden: int, classes: int, members: int, singles: int = 0) -> dict[str, tuple[int, ...]]:
    """The first `singles` ids are outcomes of a softmax of their own, whose last outcome is that a word lies in a
    class; the others lie in `classes` of `members`. Without singles there is no such softmax."""
    outcomes = classes + (singles + 1 if singles else 0)
    return {"x": (singles + classes * members, 3 * hidden), "u": (hidden, 3 * hidden), "a": (hidden, outcomes), "ca": (outcomes,), "b": (classes, hidden, members), "wb": (classes, members)}


def start(counts: np.ndarray, hidden: int, classes: int, members: int, singles: int = 0, seed: int = 3) -> dict[str, np.ndarray]:
    """Weights that give the words' relative frequencies; counts has singles + classes * members entries, in class order."""
    rng = np.random.default_rng(seed)
    p = {k: (rng.standard_normal(s) * (0.1 if k == "x" else 0.3 / np.sqrt(hidden) if k == "u" else 0.02)).astype(np.float32) for k, s in shapes(hidden, classes, members, singles).items()}
    share = (counts + 0.5) / (counts.sum() + 0.5 * counts.size)
    alone, share = share[:singles], share[singles:].reshape(classes, members)
    p["ca"] = np.log(np.concatenate([alone, [share.sum()] if singles else [], share.sum(1) / share.sum()])).astype(np.float32)
    p["wb"] = np.log(share / share.sum(1, keepdims=True)).astype(np.float32)
    p["x"][:, :hidden] -= 1.0  # gates open at first
    return p


def pack(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sorted(p)])


def unpack(flat: np.ndarray, hidden: int, classes: int, members: int, singles: int = 0) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in sorted(shapes(hidden, classes, members, singles).items()):
        n = int(np.prod(s))
        out[k] = flat[at : at + n].reshape(s).astype(np.float32)
        at += n
    return out


def sigmoid(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-v))


def cell(p: dict[str, np.ndarray], word: np.ndarray, h: np.ndarray) -> np.ndarray:
    """One step, written out plainly: the new state. step() and window_gradient() do the same in place."""
    n = h.shape[1]
    x, v = p["x"][word], h @ p["u"]
    z, r = sigmoid(x[:, :n] + v[:, :n]), sigmoid(x[:, n : 2 * n] + v[:, n : 2 * n])
    c = np.tanh(x[:, 2 * n :] + r * v[:, 2 * n :])
    return c + z * (h - c)


def layout(p: dict[str, np.ndarray], word: np.ndarray) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, list[list[tuple[int, int, int]]]]:
    """The number of outcomes before the classes; places of words that lie in classes, in class order, their classes and members.

    Last the runs (class, from, to) of those places, in blocks of at most BLOCK rows.
    """
    classes, members = p["wb"].shape
    first = len(p["ca"]) - classes
    rest = word - max(0, first - 1)
    k = rest // members
    inside = np.flatnonzero(rest >= 0)
    order = inside[np.argsort(k[inside].astype(np.uint16) if classes < 1 << 16 else k[inside], kind="stable")]
    k = k[order]
    ends = np.searchsorted(k, np.arange(classes + 1)).tolist()
    blocks, at = [], 0
    for c, (a, z) in enumerate(zip(ends, ends[1:])):
        while a < z:
            if a == at:
                blocks.append([])
                at += BLOCK
            to = min(z, at)
            blocks[-1].append((c, a, to))
            a = to
    return first, order, k, rest[order] % members, blocks


def with_one(h: np.ndarray) -> np.ndarray:
    """Rows with a last column of ones, by which a weight matrix's last row is its bias."""
    out = np.empty((len(h), h.shape[1] + 1), h.dtype)
    out[:, :-1] = h
    out[:, -1] = 1
    return out


def exponentials(v: np.ndarray, at: np.ndarray, safe: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of logits, which become their exponentials in place: places of one column of each row, what stood there, and rows' sums.

    If safe, each row's largest logit is taken off first.
    """
    if safe:
        v -= v.max(1, keepdims=True)
    at = at + np.arange(0, v.size, v.shape[1])
    own = v.reshape(-1)[at]
    np.exp(v, out=v)
    return at, own, v @ np.ones(v.shape[1], v.dtype)


def gradient(v: np.ndarray, at: np.ndarray, total: np.ndarray, share: float) -> None:
    """Exponentials become the gradient of `share` of the negative log-softmax at each row's place."""
    v.reshape(-1)[at] -= total
    v *= (share / total)[:, None]


def output(p: dict[str, np.ndarray], h: np.ndarray, word: np.ndarray, safe: bool = False):
    """Natural log of P(single or none | h) P(class | h) P(word | class, h), and the gradients of the mean loss as window_gradient() has them.

    Rows go in blocks that stay in the processor's cache, with plain exponentials; should one overflow or all of a row's vanish, all is done again, safely.
    """
    classes, members = p["wb"].shape
    (rows, n), kind, share, given = h.shape, h.dtype, h.dtype.type(1 / len(word)), h
    first, order, k, m, blocks = layout(p, word)
    seen = sorted({c for block in blocks for c, _, _ in block})
    row, begun = {c: i for i, c in enumerate(seen)}, set()
    h, w = with_one(h), np.vstack([p["a"], p["ca"]])
    out, inner = np.zeros(rows), np.empty(len(order))
    back, back_m = np.zeros((rows, n), kind), np.empty((len(order), n), kind)
    ga, gb = np.zeros(w.T.shape, kind), np.empty((len(seen), n + 1, members), kind)
    sums = []
    with np.errstate(all="ignore"):
        if first:
            ws, wt = np.ascontiguousarray(w[:, :first]), np.ascontiguousarray(p["a"][:, :first].T)
            outcome = np.minimum(word, first - 1)
            for i in range(0, rows, BLOCK):
                hi, i = h[i : i + BLOCK], slice(i, i + BLOCK)
                v = hi @ ws
                at, own, total = exponentials(v, outcome[i], safe)
                gradient(v, at, total, share)
                ga[:first] += v.T @ hi
                np.matmul(v, wt, out=back[i])
                out[i] = own - np.log(total)
                sums.append(total)
        h = h.take(order, 0)
        wk, wt = np.ascontiguousarray(w[:, first:]), np.ascontiguousarray(p["a"][:, first:].T)
        w = joined(p)
        for block in blocks:
            a, z = block[0][1], block[-1][2]
            hi = h[a:z]
            v = hi @ wk
            at, own, total = exponentials(v, k[a:z], safe)
            gradient(v, at, total, share)
            ga[first:] += v.T @ hi
            toward = v @ wt
            u = np.empty((z - a, members), kind)
            for c, x, y in block:
                np.matmul(h[x:y], w[c], out=u[x - a : y - a])
            at, own_m, total_m = exponentials(u, m[a:z], safe)
            gradient(u, at, total_m, share)
            for c, x, y in block:
                if c in begun:
                    gb[row[c]] += h[x:y].T @ u[x - a : y - a]
                else:
                    begun.add(c)
                    np.matmul(h[x:y].T, u[x - a : y - a], out=gb[row[c]])
                np.matmul(u[x - a : y - a], p["b"][c].T, out=back_m[x:y])
            back_m[a:z] += toward
            inner[a:z] = own + own_m - np.log(total) - np.log(total_m)
            sums += [total, total_m]
        sums = np.concatenate(sums)
    if not safe and not (sums.min() > 1e-30 and sums.max() < 1e30):
        return output(p, given, word, safe=True)
    back[order] += back_m
    out[order] += inner
    touched = None if len(seen) == classes else np.array(seen, np.int64)
    ga = ga.T
    return out, {"a": (None, np.ascontiguousarray(ga[:-1])), "ca": (None, ga[-1].copy()), "b": (touched, np.ascontiguousarray(gb[:, :-1])), "wb": (touched, gb[:, -1].copy())}, back


def joined(p: dict[str, np.ndarray]) -> np.ndarray:
    """Each class's weights with its biases as the last row."""
    return np.concatenate([p["b"], p["wb"][:, None]], 1)


def likelihood(p: dict[str, np.ndarray], h: np.ndarray, word: np.ndarray, safe: bool = False, members: np.ndarray | None = None) -> np.ndarray:
    """The log-probabilities of output() alone, in the same blocks; members is joined(p), if it is at hand."""
    given = h
    first, order, k, m, blocks = layout(p, word)
    h, w = with_one(h), np.vstack([p["a"], p["ca"]])
    ll, inner = np.zeros(len(word)), np.empty(len(order))
    with np.errstate(all="ignore"):
        if first:
            ws, outcome = np.ascontiguousarray(w[:, :first]), np.minimum(word, first - 1)
            for i in range(0, len(h), BLOCK):
                i = slice(i, i + BLOCK)
                _, own, total = exponentials(h[i] @ ws, outcome[i], safe)
                ll[i] = own - np.log(total)
        h = h.take(order, 0)
        wk, w = np.ascontiguousarray(w[:, first:]), joined(p) if members is None else members
        for block in blocks:
            a, z = block[0][1], block[-1][2]
            _, own, total = exponentials(h[a:z] @ wk, k[a:z], safe)
            u = np.empty((z - a, w.shape[2]), h.dtype)
            for c, x, y in block:
                np.matmul(h[x:y], w[c], out=u[x - a : y - a])
            _, own_m, total_m = exponentials(u, m[a:z], safe)
            inner[a:z] = own + own_m - np.log(total) - np.log(total_m)
    ll[order] += inner
    if not safe and not np.isfinite(ll).all():
        return likelihood(p, given, word, True, members)
    return ll


def tangent(v: np.ndarray) -> None:
    """tanh in place, by the exponential, which numpy has at half the price."""
    v *= -2
    np.exp(v, out=v)
    v += 1
    np.divide(2, v, out=v)
    v -= 1


def parted(p: dict[str, np.ndarray]) -> tuple[np.ndarray, ...]:
    """The cell's weights as step() takes them: a row for each word and part, and both parts of u that make gates with their signs turned."""
    n = len(p["u"])
    sign = np.repeat(np.array([-1, -1, 1], p["u"].dtype), n)
    return np.ascontiguousarray(p["x"] * sign).reshape(-1, n), np.ascontiguousarray((p["u"] * sign).reshape(n, 3, n).transpose(1, 0, 2))


def step(w: tuple[np.ndarray, ...], word: np.ndarray, h: np.ndarray, parts: np.ndarray = np.arange(3)[:, None]) -> None:
    """As cell(), in place, with the weights of parted(), a block of rows at a time."""
    x, u = w
    for i in range(0, len(h), BLOCK):
        hi = h[i : i + BLOCK]
        v = np.matmul(hi, u)
        given = x.take(word[i : i + BLOCK] * 3 + parts, 0)
        zr, c = given[:2], given[2]
        zr += v[:2]
        np.exp(zr, out=zr)
        zr += 1
        np.reciprocal(zr, out=zr)
        c += np.multiply(v[2], zr[1], out=v[2])
        tangent(c)
        hi -= c
        hi *= zr[0]
        hi += c


def row_sums(word: np.ndarray, v: np.ndarray, few: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words and the sums of their rows of v: a frequent word's at once, the others' first, second and so on together."""
    order = np.argsort(word.astype(np.uint16) if word.max() < 1 << 16 else word, kind="stable")
    word = word[order]
    first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    count = np.diff(np.append(first, len(word)))
    by = np.argsort(-count, kind="stable")
    first, count = first[by], count[by]
    out = v.take(order[first], 0)
    often = int((count > few).sum())
    for j, (a, n) in enumerate(zip(first[:often].tolist(), count[:often].tolist())):
        out[j] = np.ones(n, v.dtype) @ v.take(order[a : a + n], 0)
    for k in range(1, few):
        live = int((count > k).sum())
        out[often:live] += v.take(order[first[often:live] + k], 0)
    return word[first], out


def window_gradient(p: dict[str, np.ndarray], given: np.ndarray, target: np.ndarray, h: np.ndarray):
    """Truncated backpropagation through one window (steps, streams): mean loss, gradients, last state.

    A gradient is (rows, values): of the rows of the weights that the window touches, or of all where rows is
    None. The state is reset where the word given is END, since a text starts there.
    """
    steps, streams = given.shape
    n, kind = h.shape[1], h.dtype
    # update gate, reset gate and candidate lie apart, so that each step's arrays are contiguous
    u = p["u"].reshape(n, 3, n).transpose(1, 0, 2) * np.array([-1, -1, 1], kind)[:, None, None]
    gates = p["x"].reshape(-1, n).take(given[:, None] * 3 + np.arange(3)[:, None], 0)
    fresh = [np.flatnonzero(ends) for ends in given == END]
    before, states, inner = (np.empty((steps, streams, n), kind) for _ in range(3))
    v = np.empty((3, streams, n), kind)
    for t in range(steps):
        hb = before[t]
        hb[...] = h
        hb[fresh[t]] = 0
        np.matmul(hb, u, out=v)
        zr, c = gates[t, :2], gates[t, 2]
        np.subtract(v[:2], zr, out=zr)
        np.exp(zr, out=zr)
        zr += 1
        np.reciprocal(zr, out=zr)
        inner[t] = v[2]
        c += np.multiply(v[2], zr[1], out=v[2])
        tangent(c)
        h = np.subtract(hb, c, out=states[t])
        h *= zr[0]
        h += c
    ll, g, dout = output(p, states.reshape(-1, n), target.ravel())
    dout = dout.reshape(steps, streams, n)
    # gradients of what the candidate's state is multiplied to, of both gates, and of the candidate
    d, ut = np.empty((steps, streams, 4 * n), kind), np.ascontiguousarray(np.roll(p["u"], n, 1).T)
    dh, q, back = np.zeros((streams, n), kind), np.empty((streams, n), kind), np.empty((streams, n), kind)
    for t in reversed(range(steps)):
        z, r, c = gates[t]
        dk, dz, dr, dc = (d[t, :, i : i + n] for i in range(0, 4 * n, n))
        dh += dout[t]
        np.subtract(1, z, out=q)
        q *= dh
        np.subtract(before[t], c, out=back)
        back *= z
        np.multiply(back, q, out=dz)
        np.multiply(c, c, out=c)
        np.subtract(1, c, out=c)
        q *= c
        dc[...] = q
        q *= r
        dk[...] = q
        q *= inner[t]
        np.multiply(q, np.subtract(1, r, out=r), out=dr)
        dh *= z
        dh += np.matmul(d[t, :, : 3 * n], ut, out=back)
        dh[fresh[t]] = 0
    d = d.reshape(-1, 4 * n)
    g["u"] = (None, np.roll((d[:, : 3 * n].T @ before.reshape(-1, n)).T, -n, 1))
    seen, gx = row_sums(given.ravel(), d)
    g["x"] = (seen, np.ascontiguousarray(gx[:, n:]))
    return -ll.mean(), g, h


def dense(p: dict[str, np.ndarray], g: dict) -> dict[str, np.ndarray]:
    """Gradients of whole arrays from window_gradient()'s."""
    out = {}
    for k, (rows, v) in g.items():
        out[k] = np.zeros_like(p[k])
        out[k][slice(None) if rows is None else rows] = v
    return out


class Trainer:
    """Adam over windows of parallel streams, on the touched rows alone; the state is carried from window to window."""

    def __init__(self, p: dict[str, np.ndarray]):
        self.p = {k: v.copy() for k, v in p.items()}
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.s = {k: np.zeros_like(v) for k, v in p.items()}
        self.count = 0

    def update(self, g: dict, speed: float) -> None:
        """One step with the gradients g, whose arrays it uses up."""
        norm = np.sqrt(sum(float(np.vdot(v, v)) for _, v in g.values()))
        scale = min(1.0, 1.0 / (norm + 1e-12))
        self.count += 1
        up, root = np.float32(speed / (1 - 0.9**self.count)), np.float32(np.sqrt(1 - 0.99**self.count))
        for k, (rows, d) in g.items():
            p, m, s = ((v[k] if rows is None else v[k].take(rows, 0)) for v in (self.p, self.m, self.s))
            d *= np.float32(0.1 * scale)
            m *= np.float32(0.9)
            m += d
            d *= d  # a hundredth of the gradient's square
            s *= np.float32(0.99)
            s += d
            np.sqrt(s, out=d)
            d += np.float32(1e-8) * root
            np.divide(m, d, out=d)
            d *= up * root
            p -= d
            if rows is not None:
                self.p[k][rows], self.m[k][rows], self.s[k][rows] = p, m, s

    def run(self, stream: np.ndarray, streams: int, steps: int, rate: float, last: float = 0.1) -> None:
        """One pass over a stream of whole texts, which starts behind an END; the rate falls to `last` of it.

        The stream is cut into parallel streams of one length; what is left over is a shorter pass of its own.
        """
        while len(stream):
            streams = min(streams, len(stream))
            length = len(stream) // streams
            target = stream[: length * streams].reshape(streams, length).T
            given = np.concatenate([np.full((1, streams), END, target.dtype), target[:-1]])
            h = np.zeros((streams, self.p["u"].shape[0]), np.float32)
            for t in range(0, length, steps):
                _, g, h = window_gradient(self.p, given[t : t + steps], target[t : t + steps], h)
                self.update(g, rate * (1 - (1 - last) * t / length))
            stream, streams = stream[length * streams :], max(1, streams // 8)


def train(p: dict[str, np.ndarray], stream: np.ndarray, streams: int = 32, steps: int = 16, rate: float = 4e-3) -> dict[str, np.ndarray]:
    t = Trainer(p)
    t.run(stream, streams, steps, rate)
    return t.p


def score(p: dict[str, np.ndarray], words: np.ndarray, lengths: np.ndarray, steps: int = 32) -> np.ndarray:
    """Natural log-probability of each whole text. Texts run side by side, the longest first; windows carry the state."""
    n, hidden = len(lengths), p["u"].shape[0]
    order = np.argsort(-lengths, kind="stable")
    first, size = (np.cumsum(lengths) - lengths)[order], lengths[order]
    total, h = np.zeros(n), np.zeros((n, hidden), np.float32)
    given, w, members = np.full(n, END, np.int64), parted(p), joined(p)
    t, longest = 0, int(size[0]) if n else 0
    alive = np.searchsorted(-size, -np.arange(longest), "left").tolist()
    while t < longest:
        # as many steps as keep a window's states within bounds
        states, targets, owners = [], [], []
        held = 0
        while t < longest and (not states or len(states) < steps or held < 4096) and held < 32_768:
            live = alive[t]
            step(w, given[:live], h[:live])
            word = words[first[:live] + t]
            states.append(h[:live].copy())
            targets.append(word)
            owners.append(live)
            given[:live] = word
            held += live
            t += 1
        ll = likelihood(p, np.concatenate(states), np.concatenate(targets), members=members)
        at = 0
        for live in owners:
            total[:live] += ll[at : at + live]
            at += live
    out = np.zeros(n)
    out[order] = total
    return out
