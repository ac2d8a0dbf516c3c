"""A small causal self-attention language model over subword ids, in numpy.

Input at a position: the token's and the token before's vectors.  Each token looks back over at most
2 x BLOCK positions: score = query . key + a learned bias for the distance, masked to the past; values are mixed
by softmax and projected onto the input.  After a rectifier, the next token is predicted in LEVELS softmax steps
down a tree over the tokens by frequency, so that a token costs the cube root of the vocabulary.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np

BLOCK = 32
LEVELS = 3
#: Places that are scored at once.
MOST = 16_384
#: Blocks whose attention weights are worked on at once, to stay in a core's cache.
CHUNK = 64
_HIGH = np.float32(60)
_LOW = np.float32(-1e9)


def keep_freed() -> None:
    """Let the C library hold up to 64 MB of freed memory for the next arrays.

    Else it returns each large array to the system, and a fifth of a task goes to page faults.
    """
    lib = ctypes.CDLL(None)
    if hasattr(lib, "mallopt"):
        lib.mallopt(-3, 32 << 20)  # M_MMAP_THRESHOLD
        lib.mallopt(-1, 64 << 20)  # M_TRIM_THRESHOLD


def windows(text: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, tuple[int, int]]]:
    """Overlapping parts of a text with the span of places that count in each; every place counts once.

    Later parts begin 2 x BLOCK places early, all that a place looks back on, so that a place has the same
    probability in its part as in the whole text.  The end is a place of the last part alone.
    """
    size, step = len(text) + 1, max(1, most // BLOCK) * BLOCK
    for a in range(0, size, step):
        early = min(a, 2 * BLOCK)
        yield text[a - early : a + step], (early, min(step, size - a))


def grouped(parts: Iterator[tuple], most: int) -> Iterator[list[list]]:
    """(which, part, span) in groups of one part or of at most about ``most`` places, as three lists."""
    group: list[tuple] = []
    held = 0
    for x in parts:
        if group and held + len(x[1]) + 1 > most:
            yield [list(c) for c in zip(*group, strict=True)]
            group, held = [], 0
        group.append(x)
        held += len(x[1]) + 1
    if group:
        yield [list(c) for c in zip(*group, strict=True)]


class Model:
    """Parameters are named arrays; ``v`` tokens, of which the last is the end (and the beginning) of a text."""

    def __init__(self, v: int, d: int = 32, k: int = 8, logs: np.ndarray | None = None, seed: int = 3):
        self.v, self.d, self.k = v, d, k  # v at most 65,536
        self.width = int(np.ceil(round(v ** (1 / LEVELS), 6)))
        r = np.random.default_rng(seed)
        n = lambda *s, x=0.1: (r.standard_normal(s) * x).astype(np.float32)
        self.p = {
            "own": n(v, d), "prev": n(v, d), "q": n(v, k), "key": n(v, k), "val": n(v, k), "out": n(k, d),
            "far": np.linspace(0, -2, 2 * BLOCK).astype(np.float32), "b": np.zeros(d, np.float32),
        }
        w = self.width
        full = np.full(w**LEVELS, -np.inf)
        full[:v] = 0 if logs is None else logs  # begin with the corpus' own frequencies
        for j in range(LEVELS):
            self.p[f"w{j}"] = n(w**j, d, w)
            sums = np.exp(full.reshape(w ** (j + 1), -1)).sum(1).reshape(w**j, w)
            self.p[f"b{j}"] = np.maximum(np.log(np.maximum(sums, 1e-40)), -30).astype(np.float32)
        self.pad = [np.where(np.isfinite(full).reshape(w ** (j + 1), -1).any(1).reshape(w**j, w), np.float32(0), _LOW) for j in range(LEVELS)]
        leaves = np.arange(w**LEVELS)
        self.branch = leaves[:v, None] // w ** np.arange(LEVELS - 1, -1, -1) % w
        self.leaf = leaves[:v] // w
        dist = BLOCK + np.arange(BLOCK)[:, None] - np.arange(2 * BLOCK)[None]
        self.dist = np.clip(dist, 0, 2 * BLOCK - 1)
        self.mask = np.where(dist >= 0, np.float32(0), _LOW)

    def pack(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.p.values()])

    def unpack(self, flat: np.ndarray) -> Model:
        at = 0
        for name, x in self.p.items():
            self.p[name] = flat[at : at + x.size].reshape(x.shape).astype(np.float32)
            at += x.size
        return self

    def layout(self, texts: list[np.ndarray], spans: list[tuple[int, int]] | None = None):
        """Inputs in blocks, each text after an empty block: tokens, the real places, their targets and texts, the blocks that begin a text.

        ``spans`` names the first and the number of the places of each text that count; else all do, its end included.
        """
        sizes = np.array([len(t) + 1 for t in texts])
        first = np.cumsum(np.r_[0, -(-sizes // BLOCK) + 1])
        end, flat = self.v - 1, np.concatenate(texts)
        which = np.repeat(np.arange(len(texts)), sizes)
        before = np.cumsum(np.r_[0, sizes])
        place = np.arange(len(which)) + ((first[:-1] + 1) * BLOCK - before[:-1])[which]
        x, y, inner = np.full(int(first[-1]) * BLOCK, end, np.int32), np.full(len(which), end, np.int32), np.ones(len(which), bool)
        inner[before[1:] - 1] = False
        y[inner] = flat
        x[place[inner] + 1] = flat
        if spans is not None:
            at = np.arange(len(which)) - before[which]
            low, n = np.array(spans).T
            counts = (at >= low[which]) & (at < (low + n)[which])
            place, y, which = place[counts], y[counts], which[counts]
        return x, place, y, which, first[:-1]

    def hidden(self, x, place, first, keep: bool = True):
        """Batched masked attention: the queries of each block look at its own and the block before.

        Places after a text's end are behind the causal mask for all real queries; the empty block before a
        text is masked here.  Scores are held below 60 so that exp stays finite.  What gradients need is kept only on demand.
        """
        p, k = self.p, self.k
        n = len(x) // BLOCK - 1
        take = lambda name, ids: np.take(p[name], ids, axis=0)
        q, key, val = take("q", x), take("key", x), np.ones((len(x), k + 1), np.float32)
        val[:, :k] = take("val", x)
        pairs = lambda a: np.lib.stride_tricks.as_strided(a, (n, 2 * BLOCK, a.shape[1]), (BLOCK * a.strides[0], *a.strides))
        q, key, val = q.reshape(-1, BLOCK, k)[1:], pairs(key), pairs(val)
        s, mixed = np.empty((n if keep else min(n, CHUNK), BLOCK, 2 * BLOCK), np.float32), np.empty((n, BLOCK, k + 1), np.float32)
        opens = np.zeros(n, bool)
        opens[first] = True
        longest = lambda name: np.sqrt(np.einsum("ij,ij->i", p[name], p[name]).max())
        low = longest("q") * longest("key") + p["far"].max() < _HIGH  # no score is beyond it
        far = p["far"][self.dist] + self.mask
        for a in range(0, n, CHUNK):
            b = min(a + CHUNK, n)
            e = s[a:b] if keep else s[: b - a]
            np.matmul(q[a:b], key[a:b].transpose(0, 2, 1), out=e)
            e += far
            if not low:
                np.minimum(e, _HIGH, out=e)
            np.exp(e, out=e)
            e[opens[a:b], :, :BLOCK] = 0
            np.matmul(e, val[a:b], out=mixed[a:b])  # the last column is the sum of the weights
        m = np.take(mixed.reshape(-1, k + 1), place - BLOCK, axis=0)
        m /= m[:, k:].copy()  # its last column is one
        pre = m @ np.vstack([p["out"], p["b"]])
        pre += take("own", x[place])
        pre += take("prev", x[place - 1])
        return np.maximum(pre, 0, out=pre), (s, mixed, q, key, val, m)

    def _branches(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of sorted targets: the nodes of the last level that occur, the cuts between their rows, the place of each target's branch of each level in ``_choices``."""
        leaf = np.take(self.leaf, y)
        cuts = np.flatnonzero(np.r_[True, leaf[1:] != leaf[:-1], True])
        target = np.arange(0, len(y) * LEVELS * self.width, self.width).reshape(-1, LEVELS)
        target += np.take(self.branch, y, axis=0)
        return leaf[cuts[:-1]], cuts, target

    def _path(self, nodes: np.ndarray, level: int) -> np.ndarray:
        return nodes // self.width ** (LEVELS - 1 - level)

    def _choices(self, h: np.ndarray, nodes: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each row, whose last column is one, exp of all branches on the way to its node, held below 60; their sums by level; the nodes' weights side by side, biases below."""
        w, d = self.width, self.d
        weights = np.empty((len(nodes), d + 1, LEVELS * w), np.float32)
        for level in range(LEVELS):
            at, cols = self._path(nodes, level), slice(level * w, (level + 1) * w)
            weights[:, :d, cols] = self.p[f"w{level}"][at]
            weights[:, d, cols] = (self.p[f"b{level}"] + self.pad[level])[at]
        z = np.empty((len(h), LEVELS * w), np.float32)
        for x, a, b in zip(weights, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            np.matmul(h[a:b], x, out=z[a:b])
        if z.max(initial=0) > _HIGH:
            np.minimum(z, _HIGH, out=z)
        np.exp(z, out=z)
        return z, (z.reshape(-1, w) @ np.ones(w, np.float32)).reshape(-1, LEVELS), weights

    @staticmethod
    def _sorted(h: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Order by target, the rows in it with a column of ones, the targets in it."""
        order = np.argsort(y.astype(np.uint16), kind="stable")  # by radix
        rows = np.ones((len(h), h.shape[1] + 1), np.float32)
        rows[:, :-1] = np.take(h, order, axis=0)
        return order, rows, y[order]

    def log10(self, texts: list[np.ndarray], most: int = MOST) -> np.ndarray:
        """log10 probability of each text, its end included; every token is predicted once.

        What is held at once is bounded by windows of ``most`` places, however long a text is.
        """
        got = np.zeros(len(texts))
        for which, parts, spans in grouped(((i, *w) for i, t in enumerate(texts) for w in windows(t, most)), most):
            np.add.at(got, which, self._log10(parts, spans))
        return got

    def _log10(self, texts: list[np.ndarray], spans: list[tuple[int, int]]) -> np.ndarray:
        x, place, y, which, first = self.layout(texts, spans)
        h, _ = self.hidden(x, place, first, keep=False)
        order, h, y = self._sorted(h, y)
        nodes, cuts, target = self._branches(y)
        e, total, _ = self._choices(h, nodes, cuts)
        got = (np.take(e, target) / total).prod(1)
        return np.bincount(which[order], np.log10(np.maximum(got, np.float32(1e-37)).astype(np.float64)), len(texts))

    def gradients(self, texts: list[np.ndarray], spans: list[tuple[int, int]] | None = None) -> tuple[dict[str, np.ndarray], float, int]:
        """Of the mean negative log-likelihood of the places that count; also its sum and their number."""
        p, k, d, w = self.p, self.k, self.d, self.width
        x, place, y, _, first = self.layout(texts, spans)
        h, (s, mixed, q, key, val, m) = self.hidden(x, place, first)
        n, g = len(y), {}
        order, hs, ys = self._sorted(h, y)
        nodes, cuts, target = self._branches(ys)
        e, total, weights = self._choices(hs, nodes, cuts)
        got = np.take(e, target) / total
        loss = -float(np.log(got.astype(np.float64).prod(1) + 1e-300).sum())
        e.reshape(n, LEVELS, w)[:] *= (1 / (total * np.float32(n)))[:, :, None]
        e.reshape(-1)[target] -= np.float32(1 / n)
        gw, ds = np.empty_like(weights), np.empty((n, d), np.float32)
        for i, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
            np.matmul(hs[a:b].T, e[a:b], out=gw[i])
            np.matmul(e[a:b], weights[i, :d].T, out=ds[a:b])
        for level in range(LEVELS):
            at = self._path(nodes, level)
            starts, got = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]), gw[:, :, level * w : (level + 1) * w]
            if len(starts) < len(at):
                got = np.add.reduceat(got, starts, axis=0)
            g[f"w{level}"], g[f"b{level}"] = np.zeros_like(p[f"w{level}"]), np.zeros_like(p[f"b{level}"])
            g[f"w{level}"][at[starts]], g[f"b{level}"][at[starts]] = got[:, :d], got[:, d]
        back_to = np.empty_like(order)
        back_to[order] = np.arange(n)
        dh = np.zeros((n + 1, d), np.float32)  # its last row is for places that don't count
        np.take(ds, back_to, axis=0, out=dh[:n], mode="clip")
        dh[:n] *= h > 0
        both = m.T @ dh[:n]
        g["out"], g["b"] = both[:k], both[k]
        # through the softmax, whose sums are the last column of ``mixed`` and stand against the ones of ``val``
        row = np.full(len(x) + 1, n)
        row[place] = np.arange(n)
        back = dh @ np.vstack([p["out"], p["b"]]).T
        back[:n, k] = -np.einsum("ij,ij->i", back[:n, :k], m[:, :k])
        dm = np.take(back, row[BLOCK:-1], axis=0).reshape(-1, BLOCK, k + 1)
        dm /= np.maximum(mixed[:, :, k:], np.float32(1e-30))
        far = np.zeros((BLOCK, 2 * BLOCK), np.float32)
        dq, dkey, dval = np.empty_like(q), *np.zeros((2, len(q) + 1, k, BLOCK), np.float32)
        held = np.empty((min(len(q), CHUNK), BLOCK, 2 * BLOCK), np.float32)
        dval_of = np.ascontiguousarray(dm[:, :, :k])
        for a in range(0, len(q), CHUNK):
            b = min(a + CHUNK, len(q))
            ds = np.matmul(dm[a:b], val[a:b].transpose(0, 2, 1), out=held[: b - a])
            ds *= s[a:b]
            far += ds.sum(0)
            np.matmul(ds, key[a:b], out=dq[a:b])
            for out, left, right in ((dkey, q, ds), (dval, dval_of, s[a:b])):  # of pairs of blocks, summed onto the places they stand for
                pair = left[a:b].transpose(0, 2, 1) @ right
                out[a:b] += pair[:, :, :BLOCK]
                out[a + 1 : b + 1] += pair[:, :, BLOCK:]
        g["far"] = np.bincount(self.dist.ravel(), far.ravel(), 2 * BLOCK).astype(np.float32)
        # what the vectors of the token of each place of ``x`` get
        small = np.empty((len(q) + 1, BLOCK, 3 * k), np.float32)
        small[0, :, :k], small[1:, :, :k] = 0, dq
        small[:, :, k : 2 * k], small[:, :, 2 * k :] = dkey.transpose(0, 2, 1), dval.transpose(0, 2, 1)
        order, sums = self._gather(x)
        g["own"], g["prev"] = np.split(sums(np.take(dh, np.stack([row[order], row[order + 1]], 1), axis=0).reshape(len(x), -1)), 2, axis=1)
        g["q"], g["key"], g["val"] = np.split(sums(np.take(small.reshape(len(x), -1), order, axis=0)), 3, axis=1)
        return g, loss, n

    def _gather(self, ids: np.ndarray):
        """The order in which equal tokens are together; of rows in this order, the sum for each token: tokens that occur equally often are one sum over an axis."""
        times = np.bincount(ids, minlength=self.v)
        tokens = np.argsort(times, kind="stable")
        tokens = tokens[np.searchsorted(times[tokens], 1) :]
        rank = np.zeros(self.v, np.uint16)
        rank[tokens] = np.arange(len(tokens))
        sizes, starts = np.unique(times[tokens], return_index=True)
        sizes, starts, stops = sizes.tolist(), starts.tolist(), [*starts[1:].tolist(), len(tokens)]

        def sums(rows: np.ndarray) -> np.ndarray:
            got, at, wide = np.empty((len(tokens), rows.shape[1]), np.float32), 0, rows.shape[1]
            for size, a, b in zip(sizes, starts, stops, strict=True):
                end = at + size * (b - a)
                np.add.reduce(rows[at:end].reshape(b - a, size, wide), axis=1, out=got[a:b])
                at = end
            out = np.zeros((self.v, wide), np.float32)
            out[tokens] = got
            return out

        return np.argsort(rank[ids], kind="stable"), sums  # by radix


class Trainer:
    """Adam, on all parameters as one array, of which the model's become parts."""

    def __init__(self, model: Model, rate: float):
        self.model, self.rate, self.step = model, rate, 0
        self.flat = model.pack()
        cuts = np.cumsum([x.size for x in model.p.values()])[:-1]
        for (name, x), part in zip(model.p.items(), np.split(self.flat, cuts), strict=True):
            model.p[name] = part.reshape(x.shape)
        self.g, self.m, self.s = (np.zeros_like(self.flat) for _ in range(3))

    def learn(self, texts: list[np.ndarray], scale: float = 1.0, spans: list[tuple[int, int]] | None = None) -> tuple[float, int]:
        g, loss, n = self.model.gradients(texts, spans)
        self.step += 1
        rate = np.float32(self.rate * scale * np.sqrt(1 - 0.99**self.step) / (1 - 0.9**self.step))
        np.concatenate([g[k].ravel() for k in self.model.p], out=self.g)
        for a in range(0, len(self.flat), 1 << 15):
            x, g, m, s = (c[a : a + (1 << 15)] for c in (self.flat, self.g, self.m, self.s))
            m += np.float32(0.1) * (g - m)
            np.square(g, out=g)
            g -= s
            g *= np.float32(0.01)
            s += g
            np.sqrt(s, out=g)
            g += np.float32(1e-8)
            np.divide(m, g, out=g)
            g *= rate
            x -= g
        return loss, n
