"""A gated recurrent network with a class-factored softmax, in numpy.

Tokens run in lanes: a lane holds whole documents one after the other, and its
state is set back where a document begins.  A window of steps is computed at
once for all lanes; the state goes on from window to window, so a document's
log-likelihood is that of its complete text, while gradients stop at the window
(truncated backpropagation through time).

Outputs are factored: a class, then a word of the class.  The first classes
split the vocabulary by rank; the others (tail classes) have no words here, the
caller knows their words' probabilities.

Training touches what a window touches: the embeddings of its inputs and the
classes of its targets have their own sparse gradients and lazy moments (one
second moment a row), so a step costs the window and not the vocabulary.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np

HIDDEN, EMBED = 24, 16
BLOCK = 65536  # logits worked on at once
SEGMENT = 1024  # tokens; a longer training document is dealt to lanes in pieces
WARM, FULL = 20, 2048  # steps until the full rate, tokens in a step of full rate: little text changes little


@dataclass
class Shape:
    words: int      # vocabulary with a softmax
    per_class: int  # words of a class, unless ``starts`` says otherwise
    tails: int      # tail classes; input ids words .. words + tails - 1
    starts: np.ndarray | None = None  # first word of each class

    def __post_init__(self):
        if self.starts is None:
            self.starts = np.arange(0, self.words, self.per_class)
        self.heads = len(self.starts)
        self.cuts = [*map(int, self.starts), self.words]
        self.classes = np.concatenate([np.repeat(np.arange(self.heads), np.diff(self.cuts)), self.heads + np.arange(self.tails)]).astype(np.int32)

    def class_of(self, ids: np.ndarray) -> np.ndarray:
        return self.classes[ids]


def start(shape: Shape, class_bias: np.ndarray, word_bias: np.ndarray, seed: int = 7) -> dict[str, np.ndarray]:
    """First weights; the biases are log unigram shares, so that an untrained
    model is the unigram model."""
    r = np.random.default_rng(seed)

    def small(*size, scale):
        return (r.standard_normal(size) * scale).astype(np.float32)
    h = HIDDEN
    bias = np.zeros(3 * h, np.float32)
    bias[:h] = -1.0  # update gate: remember
    return {"E": small(shape.words + shape.tails, EMBED, scale=0.3), "W": small(EMBED, 3 * h, scale=EMBED ** -0.5), "b": bias,
            "U": small(h, 3 * h, scale=h ** -0.5), "C": small(h, shape.heads + shape.tails, scale=0.01), "cb": class_bias.astype(np.float32),
            "V": small(shape.words, h, scale=0.01), "vb": word_bias.astype(np.float32)}


def lanes(docs: list[np.ndarray], most: int, end: int):
    """Inputs, targets, resets and mask (steps x lanes) of documents given as
    targets; and for each document (lane, first step, length)."""
    longest, total = max(map(len, docs)), sum(map(len, docs))
    n = int(np.clip(total // max(longest, 64), 1, most))
    heap, place = [(0, i) for i in range(n)], [None] * len(docs)
    for k in sorted(range(len(docs)), key=lambda k: -len(docs[k])):
        used, lane = heapq.heappop(heap)
        place[k] = (lane, used, len(docs[k]))
        heapq.heappush(heap, (used + len(docs[k]), lane))
    steps = max(u for u, _ in heap)
    y = np.full((n, steps), -1, np.int32)
    new = np.zeros((n, steps), bool)
    for (lane, at, size), d in zip(place, docs, strict=True):
        y[lane, at:at + size] = d
        new[lane, at] = True
    x = np.empty_like(y)
    x[:, 0], x[:, 1:] = end, y[:, :-1]
    x[new] = end
    x[x < 0] = end
    return np.ascontiguousarray(x.T), np.ascontiguousarray(y.T), np.ascontiguousarray(new.T), place


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def forward(p: dict, table: np.ndarray, x: np.ndarray, new: np.ndarray, h: np.ndarray, keep: bool = False):
    """States (steps x lanes x HIDDEN) of a window; ``table`` is E @ W + b."""
    k, out, tape = HIDDEN, np.empty((*x.shape, HIDDEN), np.float32), []
    gates, last = np.ascontiguousarray(p["U"][:, :2 * k]), np.ascontiguousarray(p["U"][:, 2 * k:])
    live = ~new
    for t in range(len(x)):
        h = h * live[t][:, None]
        a = table[x[t]]
        zr = _sigmoid(a[:, :2 * k] + h @ gates)
        z, r = zr[:, :k], zr[:, k:]
        n = np.tanh(a[:, 2 * k:] + (r * h) @ last)
        out[t] = n + z * (h - n)
        if keep:
            tape.append((h, z, r, n))
        h = out[t]
    return out, h, tape


_space: list[np.ndarray] = [np.empty(0, np.float32)]


def _room(rows: int, columns: int) -> np.ndarray:
    """A matrix that every call shares: fresh memory costs more than the sums in it."""
    if _space[0].size < rows * columns:
        _space[0] = np.empty(rows * columns, np.float32)
    return _space[0][:rows * columns].reshape(rows, columns)


def _softmax(h: np.ndarray, w: np.ndarray, bias: np.ndarray, pick: np.ndarray, up=None):
    """Log-softmax of ``h @ w + bias`` at ``pick``, a block of rows at a time.
    With ``up`` (``w`` transposed) also the gradients of its sum: of ``h``, ``w``
    and ``bias``.  Logits are biases of at most 0 plus products of bounded states
    and small weights, so they need no shift; the clip is for safety."""
    ll, k = np.empty(len(h), np.float32), w.shape[1]
    ones, dh, dw, db = np.ones(k, np.float32), np.empty_like(h) if up is not None else None, 0, 0
    size = max(16, BLOCK // k)
    for i in range(0, len(h), size):
        part, own = h[i:i + size], pick[i:i + size]
        rows, a = np.arange(len(part)), _room(len(part), k)
        np.matmul(part, w, out=a)
        a += bias
        got = a[rows, own]
        np.minimum(a, 80, out=a)
        np.exp(a, out=a)
        total = a @ ones
        ll[i:i + size] = got - np.log(total)
        if up is not None:
            a *= (-1 / total)[:, None]
            a[rows, own] += 1
            np.matmul(a, up, out=dh[i:i + size])
            dw, db = dw + part.T @ a, db + np.ones(len(part), np.float32) @ a
    return (ll, dh, dw, db) if up is not None else ll


def output(p: dict, shape: Shape, h: np.ndarray, y: np.ndarray, grad: dict | None = None):
    """Natural log-likelihood of targets ``y`` given states ``h`` (rows); with
    ``grad`` sets the gradients of its sum (``V``: first word, last word + 1 and
    the gradients of weights and biases, for each class met) and returns that of
    ``h`` too."""
    c = shape.class_of(y)
    order = np.argsort(c, kind="stable")
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    h, y, c = h[order], y[order], c[order]  # a class's rows are a slice
    cuts = np.searchsorted(c, np.arange(shape.heads + 1)).tolist()
    if grad is None:
        ll = _softmax(h, p["C"], p["cb"], c)
    else:
        ll, dh, grad["C"], grad["cb"] = _softmax(h, p["C"], p["cb"], c, np.ascontiguousarray(p["C"].T))
        grad["V"] = []
    for k in range(shape.heads):
        i, j = cuts[k], cuts[k + 1]
        if i == j:
            continue
        lo, hi = shape.cuts[k:k + 2]
        v = p["V"][lo:hi]
        if grad is None:
            ll[i:j] += _softmax(h[i:j], v.T, p["vb"][lo:hi], y[i:j] - lo)
        else:
            own, d, dv, db = _softmax(h[i:j], v.T, p["vb"][lo:hi], y[i:j] - lo, v)
            ll[i:j] += own
            dh[i:j] += d
            grad["V"].append((lo, hi, dv.T, db))
    return (ll[back], dh[back]) if grad is not None else ll[back]


def backward(p: dict, rows: np.ndarray, x: np.ndarray, new: np.ndarray, tape: list, dout: np.ndarray, grad: dict) -> None:
    """Sets the window's gradients of the recurrent weights and of the embeddings
    ``rows``, which ``x`` counts."""
    k, dh = HIDDEN, np.zeros_like(dout[0])
    da = np.empty((*x.shape, 3 * k), np.float32)
    gates, last = np.ascontiguousarray(p["U"][:, :2 * k].T), np.ascontiguousarray(p["U"][:, 2 * k:].T)
    live = ~new
    for t in range(len(x) - 1, -1, -1):
        h, z, r, n = tape[t]
        d = dout[t] + dh
        dz = d * z
        dn = (d - dz) * (1 - n * n)
        drh = dn @ last
        a = da[t]
        a[:, :k] = dz * (1 - z) * (h - n)
        a[:, k:2 * k] = drh * h * r * (1 - r)
        a[:, 2 * k:] = dn
        dh = (dz + drh * r + a[:, :2 * k] @ gates) * live[t][:, None]
    flat, h, rh = da.reshape(-1, 3 * k), np.concatenate([s[0] for s in tape]), np.concatenate([s[2] * s[0] for s in tape])
    grad["U"] = np.hstack([h.T @ flat[:, :2 * k], rh.T @ flat[:, 2 * k:]])
    ids = x.reshape(-1)
    order = np.argsort(ids, kind="stable")
    own = np.add.reduceat(flat[order], np.searchsorted(ids[order], np.arange(len(rows))))  # every row is met
    grad["b"] = own.sum(axis=0)
    grad["W"] = p["E"][rows].T @ own
    grad["E"] = own @ p["W"].T


def _adam(p: np.ndarray, m: np.ndarray, v: np.ndarray, g: np.ndarray, fix: float) -> None:
    """A step in place; matrices whose ``v`` is a vector have one second moment a row."""
    m += 0.1 * (g - m)
    if v.ndim < g.ndim:
        v += 0.01 * (np.einsum("ij,ij->i", g, g) / g.shape[1] - v)
        p += m * (fix / (np.sqrt(v) + 1e-6))[:, None]
    else:
        v += 0.01 * (g * g - v)
        p += fix * m / (np.sqrt(v) + 1e-6)


def gradients(p: dict, shape: Shape, x: np.ndarray, y: np.ndarray, new: np.ndarray, h: np.ndarray):
    """Of a window's log-likelihood: its sum, the number of targets, the
    gradients (``E``: of the rows returned next), those rows and the last state."""
    rows, place = np.unique(x, return_inverse=True)
    place = place.reshape(x.shape)
    out, h, tape = forward(p, p["E"][rows] @ p["W"] + p["b"], place, new, h, keep=True)
    on, grad = np.flatnonzero(y.reshape(-1) >= 0), {}
    if not len(on):
        return 0.0, 0, grad, rows, h
    ll, d = output(p, shape, out.reshape(-1, HIDDEN)[on], y.reshape(-1)[on], grad)
    dout = np.zeros((out.shape[0] * out.shape[1], HIDDEN), np.float32)
    dout[on] = d
    backward(p, rows, place, new, tape, dout.reshape(out.shape), grad)
    return float(ll.sum()), len(on), grad, rows, h


def train(p: dict, shape: Shape, batches, end: int, window: int = 32, most: int = 384, rate: float = 0.02):
    """Adam on the log-likelihood of batches of documents (lists of target
    arrays); returns the weights and the number of tokens seen.  Every token is a
    target once; the pieces of a document over ``SEGMENT`` tokens start without a
    state, in training only."""
    p = {n: a.copy() for n, a in p.items()}
    m = {n: np.zeros_like(a) for n, a in p.items()}
    v = {n: np.zeros(len(a) if n in ("E", "V") else a.shape, np.float32) for n, a in p.items()}
    seen = step = 0
    for docs in batches:
        x, y, new, _ = lanes([d[i:i + SEGMENT] for d in docs for i in range(0, len(d), SEGMENT)], most, end)
        h = np.zeros((x.shape[1], HIDDEN), np.float32)
        for t in range(0, len(x), window):
            _, n, grad, rows, h = gradients(p, shape, x[t:t + window], y[t:t + window], new[t:t + window], h)
            if not n:
                continue
            step += 1
            seen += n
            fix = rate * min(1.0, step / WARM) * min(1.0, n / FULL) * np.sqrt(1 - 0.99 ** step) / (1 - 0.9 ** step)
            for name in ("W", "b", "U", "C", "cb"):
                _adam(p[name], m[name], v[name], grad[name] / n, fix)
            for lo, hi, g, gb in grad["V"]:
                own = slice(lo, hi)
                g /= n
                _adam(p["V"][own], m["V"][own], v["V"][own], g, fix)
                _adam(p["vb"][own], m["vb"][own], v["vb"][own], gb / n, fix)
            part = [a["E"][rows] for a in (p, m, v)]
            _adam(*part, grad["E"] / n, fix)
            for a, b in zip((p, m, v), part, strict=True):
                a["E"][rows] = b
    return p, seen


def score(p: dict, shape: Shape, docs: list[np.ndarray], end: int, window: int = 96, most: int = 512) -> np.ndarray:
    """Natural log-likelihood of each whole document (tail words: their class)."""
    x, y, new, place = lanes(docs, most, end)
    table = p["E"] @ p["W"] + p["b"]
    h = np.zeros((x.shape[1], HIDDEN), np.float32)
    ll = np.zeros(x.shape)
    for t in range(0, len(x), window):
        out, h, _ = forward(p, table, x[t:t + window], new[t:t + window], h)
        ys = y[t:t + window].reshape(-1)
        on = np.flatnonzero(ys >= 0)
        ll[t:t + window].reshape(-1)[on] = output(p, shape, out.reshape(-1, HIDDEN)[on], ys[on])
    ll = np.ascontiguousarray(ll.T)
    return np.array([ll[lane, at:at + size].sum() for lane, at, size in place])
