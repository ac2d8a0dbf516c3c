"""The k nearest of blocks of vectors, in numpy: a matrix product says which pairs may count, only these get their exact distance."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..errors import InvalidError

#: Queries and rows of one matrix product, pairs whose exact distances are computed at once, pairs kept until the worse ones go.
TILE_Q, TILE_X, PAIRS, KEPT = 256, 2048, 16_384, 1 << 20
EPS = float(np.finfo(np.float64).eps)


def matrix(v: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows of doubles, and which of them hold a NULL (there NaN); an error if their sizes differ."""
    sizes = pc.list_value_length(v).to_numpy(zero_copy_only=False)
    width = int(sizes[0]) if len(sizes) else 0
    if (sizes != width).any():
        raise InvalidError("vectors of unequal length")
    flat = v.flatten()
    x = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(v), width)
    null = np.isnan(x).any(1) & np.array(flat.is_null()).reshape(len(v), width).any(1) if flat.null_count else np.zeros(len(v), bool)
    return x, null


def lists_of(centroids: np.ndarray, n: int) -> Callable[[pa.Array], pa.Array]:
    """Numbers of the n nearest centroids of each vector, nearest first; vectors must be as long as the centroids."""

    def run(v: pa.Array) -> pa.Array:
        x, _ = matrix(v)
        if len(x) and x.shape[1] != centroids.shape[1]:
            raise InvalidError("vectors of unequal length")
        m = min(n, len(centroids))
        out = np.empty((len(x), m), np.int32)
        with np.errstate(all="ignore"):
            for i in range(0, len(x), TILE_X):
                d = (centroids**2).sum(1) - 2 * (x[i : i + TILE_X] @ centroids.T)
                out[i : i + TILE_X] = d.argmin(1)[:, None] if m == 1 else d.argsort(1, kind="stable")[:, :m]
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * m), pa.array(out.ravel()))

    return run


def _sums(a: np.ndarray) -> np.ndarray:
    """Sums of rows, added one by one from 0 as Spark's aggregate() does."""
    return np.add.accumulate(a, axis=1)[:, -1] + 0.0 if a.shape[1] else np.zeros(len(a))


def exact(metric: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of pairs of rows, bit by bit those of ``functions.vector``."""
    if metric == "l2":
        d = a - b
        return np.sqrt(_sums(d * d))
    if metric == "inner":
        return -_sums(a * b)
    return 1 - _sums(a * b) / (np.sqrt(_sums(a * a)) * np.sqrt(_sums(b * b)) + 1e-12)


def _same(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first row of each set of rows with equal bytes, and each row's number among them."""
    if not x.shape[1]:
        return np.zeros(min(1, len(x)), np.int64), np.zeros(len(x), np.int64)
    bits = np.ascontiguousarray(x).view(np.uint64)
    odd = np.random.default_rng(0).integers(0, 1 << 63, x.shape[1], np.uint64) * np.uint64(2) + np.uint64(1)
    h = ((bits ^ (bits >> np.uint64(29))) * odd).sum(1, dtype=np.uint64)
    _, first, group = np.unique(h, return_index=True, return_inverse=True)
    other = np.flatnonzero((bits != bits[first[group]]).any(1))  # equal hashes of unequal rows: each stands for itself
    group[other] = len(first) + np.arange(len(other))
    return np.concatenate([first, other]), group


def _first_of_group(k: int, group: np.ndarray, *order: np.ndarray) -> np.ndarray:
    """Indices of the first k rows of each group, by group and then by ``order``."""
    by = np.lexsort((*order[::-1], group))
    g = group[by]
    new = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, np.int64)
    return by[np.arange(len(g)) - np.repeat(new, np.diff(np.r_[new, len(g)])) < k]


def _ranks(keys: pa.Array) -> np.ndarray:
    return np.asarray(pc.rank(keys, sort_keys="ascending", null_placement="at_start", tiebreaker="dense")).astype(np.int64)


class Nearest:
    """The k nearest rows, of all that are fed, of each query of a block: NULL distances first and NaN last, then smaller keys, as Spark sorts.

    Equal queries are searched for once.  ``lists`` are those that a query looks into (none: all).  Memory is bounded by the
    block, k and constants, however many rows are fed and however many of them tie.
    """

    def __init__(self, keys: pa.Array, v: pa.Array, k: int, metric: str, lists: pa.Array | None):
        q, null = matrix(v)
        first, self.group = _same(np.c_[q, null])
        self.keys, self.k, self.metric, self.q, self.null = keys, k, metric, q[first], null[first]
        self.probes: dict[int, np.ndarray] = {}
        if lists is not None:
            some = lists.take(pa.array(first))
            at, of = np.repeat(np.arange(len(first)), pc.list_value_length(some).to_numpy(zero_copy_only=False)), some.flatten().to_numpy()
            self.probes = {int(i): at[of == i] for i in np.unique(of)}
        with np.errstate(all="ignore"):
            self.norm = np.sqrt(_sums(self.q * self.q))
        self.odd = ~(self.norm < 1e150)  # infinite, NaN or NULL: no product tells about these
        self.clean = np.where(self.odd[:, None], 0, self.q)
        n = len(first)
        self.most = np.full(n, np.inf)  # at least the k-th best score so far: the square of an L2 distance, else the distance
        self.best = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, bool), None)  # query, distance, is it NULL, key
        self.new: list[tuple] = []
        self.waiting = 0

    def feed(self, keys: pa.Array, v: pa.Array, lists: np.ndarray | None = None) -> None:
        if not len(self.q) or not len(v):
            return
        x, null = matrix(v)
        if x.shape[1] != self.q.shape[1]:
            raise InvalidError("vectors of unequal length")
        if lists is None:
            self._meet(None, keys, x, null)
            return
        by = np.argsort(lists, kind="stable")
        for rows in np.split(by, np.flatnonzero(np.diff(lists[by])) + 1):
            if len(asked := self.probes.get(int(lists[rows[0]]), ())):
                self._meet(asked, keys.take(pa.array(rows)), x[rows], null[rows])

    def _meet(self, asked: np.ndarray | None, keys: pa.Array, x: np.ndarray, null: np.ndarray) -> None:
        first, group = _same(np.c_[x, null])
        if len(first) < len(x):  # of equal vectors only those with the k smallest keys can be among the nearest
            rows = np.sort(_first_of_group(self.k, group, _ranks(keys)))
            keys, x, null = keys.take(pa.array(rows)), x[rows], null[rows]
        with np.errstate(all="ignore"):
            norm = np.sqrt(_sums(x * x))
        odd = ~(norm < 1e150)
        clean = np.where(odd[:, None], 0, x) if odd.any() else x
        asked = np.arange(len(self.q)) if asked is None else asked
        for j in range(0, len(x), TILE_X):
            at = slice(j, j + TILE_X)
            for i in range(0, len(asked), TILE_Q):
                self._tile(asked[i : i + TILE_Q], j, clean[at], norm[at], odd[at], x, null, keys)
        self._merge()

    def _tile(self, qs: np.ndarray, start: int, clean: np.ndarray, norm: np.ndarray, odd: np.ndarray, x: np.ndarray, null: np.ndarray, keys: pa.Array) -> None:
        qn = self.norm[qs]
        far = float(norm[~odd].max(initial=0))
        with np.errstate(all="ignore"):  # odd queries may overflow; they meet all rows
            d = self.clean[qs] @ clean.T
            if self.metric == "l2":  # err: more than the rounding of this product, of the exact sum and of its root
                d *= -2
                d += (qn**2)[:, None]
                d += norm**2
                err = 4 * (x.shape[1] + 8) * EPS * (qn + far) ** 2 + 1e-290
            elif self.metric == "inner":
                np.negative(d, d)
                err = 4 * (x.shape[1] + 8) * EPS * qn * far + 1e-290
            else:
                d /= -(qn[:, None] * norm + 1e-12)
                d += 1
                err = np.full(len(qs), 8 * (x.shape[1] + 8) * EPS)
        d[:, odd] = np.inf
        may = d <= (self.most[qs] + err)[:, None]
        many = np.flatnonzero((may.sum(1) > 4 * self.k) & ~self.odd[qs])
        if len(many) and (~odd).sum() >= self.k:
            some = d[many]
            kth = np.partition(some, self.k - 1, axis=1)[:, self.k - 1] + err[many]
            self.most[qs[many]] = np.minimum(self.most[qs[many]], kth)
            may[many] = some <= (self.most[qs[many]] + err[many])[:, None]
        may[:, odd] = True
        may[self.odd[qs]] = True
        a, b = np.nonzero(may)
        for i in range(0, len(a), PAIRS):
            p, r = qs[a[i : i + PAIRS]], b[i : i + PAIRS] + start
            with np.errstate(all="ignore"):
                dist = exact(self.metric, self.q[p], x[r])
            none = self.null[p] | null[r]
            dist[none] = 0
            self.new.append((p, dist, none, keys.take(pa.array(r))))
            self.waiting += len(p)
            if self.waiting > KEPT:
                self._merge()

    def _merge(self) -> None:
        if not self.new:
            return
        parts = [self.best] * (self.best[3] is not None) + self.new
        p, dist, none = (np.concatenate([x[i] for x in parts]) for i in range(3))
        keys = pa.concat_arrays([x[3] for x in parts])
        keep = _first_of_group(self.k, p, ~none, dist, _ranks(keys))
        self.best = p, dist, none, _ = p[keep], dist[keep], none[keep], keys.take(pa.array(keep))
        self.new, self.waiting = [], 0
        last = np.flatnonzero(np.bincount(p, minlength=len(self.q)) >= self.k)
        at = np.searchsorted(p, last, "right") - 1
        score = np.where(none[at], -np.inf, dist[at] ** 2 if self.metric == "l2" else dist[at])
        self.most[last] = np.fmin(self.most[last], score)

    def found(self) -> tuple[pa.Array, pa.Array, pa.Array] | None:
        """(query key, key, distance) of each query's nearest, nearest first."""
        p, dist, none, keys = self.best
        if keys is None:
            return None
        start, n = np.searchsorted(p, self.group), np.bincount(p, minlength=len(self.q))[self.group]
        rows = np.repeat(start - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        return self.keys.take(pa.array(np.repeat(np.arange(len(n)), n))), keys.take(pa.array(rows)), pa.array(dist[rows], mask=none[rows])


def scan(k: int, metric: str, by_list: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Over rows (cell, side, query, key, v, lists) that are sorted by cell and side, a cell's queries (side 0) first: its rows (side 1) stream past them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, asked, block = None, [], None

        def answers() -> Iterator[pa.RecordBatch]:
            if block is not None and (got := block.found()) is not None:
                for i in range(0, len(got[0]), 1 << 16):
                    yield pa.RecordBatch.from_arrays([x.slice(i, 1 << 16) for x in got], ["query", "key", "distance"])

        for batch in batches:
            cells, sides = (batch.column(i).to_numpy() for i in (0, 1))
            cuts = np.r_[0, np.flatnonzero((np.diff(cells) != 0) | (np.diff(sides) != 0)) + 1, len(cells)]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if i == j:
                    continue
                part = batch.slice(i, j - i)
                if cells[i] != cell:
                    yield from answers()
                    cell, asked, block = cells[i], [], None
                if sides[i] == 0:
                    asked.append(part)
                    continue
                if block is None and asked:
                    q = pa.Table.from_batches(asked).combine_chunks()
                    one = lambda n: q.column(n).combine_chunks() if q.column(n).num_chunks != 1 else q.column(n).chunk(0)  # noqa: B023, E731
                    block, asked = Nearest(one("query"), one("v"), k, metric, one("lists") if by_list else None), []
                if block is not None:
                    block.feed(part.column("key"), part.column("v"), part.column("lists").flatten().to_numpy() if by_list else None)
        yield from answers()

    return run
