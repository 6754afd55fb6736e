"""Numerical kernels in NumPy for what is sequential or dense: they run inside vectorised UDFs, on one trace, group or image at a time."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def local_maxima(x: np.ndarray) -> np.ndarray:
    """Strict local maxima; a plateau counts at its middle rounded down; edges never count."""
    if len(x) < 3:
        return np.zeros(0, dtype=np.int64)
    first = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
    last = np.append(first[1:], len(x)) - 1
    v = x[first]
    k = np.flatnonzero((v[1:-1] > v[:-2]) & (v[1:-1] > v[2:])) + 1
    return (first[k] + last[k]) // 2


def find_peaks(x: np.ndarray, distance: float = 1, height: float | None = None, prominence: float | None = None) -> np.ndarray:
    """Local maxima at least `height` high, thinned so that none has a higher one nearer than `distance` (of equals the later stays),
    with at least `prominence`."""
    at = local_maxima(x)
    if height is not None:
        at = at[x[at] >= height]
    keep = np.ones(len(at), dtype=bool)
    for k in np.argsort(x[at], kind="stable")[::-1]:
        if keep[k]:
            near = (np.abs(at - at[k]) < np.ceil(distance)) & (np.arange(len(at)) != k)
            keep &= ~near
    at = at[keep]
    return at[prominences(x, at)[0] >= prominence] if prominence is not None else at


def prominences(x: np.ndarray, peaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prominence, left base and right base of each peak."""
    out, left, right = np.zeros(len(peaks)), np.zeros(len(peaks), dtype=np.int64), np.zeros(len(peaks), dtype=np.int64)
    for k, p in enumerate(peaks):
        higher = np.flatnonzero(x[:p] > x[p])
        lo = higher[-1] + 1 if len(higher) else 0
        higher = np.flatnonzero(x[p:] > x[p])
        hi = p + higher[0] if len(higher) else len(x)
        left[k] = p - np.argmin(x[lo : p + 1][::-1])
        right[k] = p + np.argmin(x[p:hi])
        out[k] = x[p] - max(x[left[k]], x[right[k]])
    return out, left, right


def widths(x: np.ndarray, peaks: np.ndarray, level: float = 0.5) -> np.ndarray:
    """Width of each peak at `level` of its prominence, interpolated."""
    prom, left, right = prominences(x, peaks)
    out = np.zeros(len(peaks))
    for k, p in enumerate(peaks):
        h = x[p] - level * prom[k]
        i = p
        while i > left[k] and x[i] > h:
            i -= 1
        a = i + (h - x[i]) / (x[i + 1] - x[i]) if x[i] < h else float(i)
        j = p
        while j < right[k] and x[j] > h:
            j += 1
        b = j - (h - x[j]) / (x[j - 1] - x[j]) if x[j] < h else float(j)
        out[k] = b - a
    return out


def linkage(d: np.ndarray, method: str = "average") -> np.ndarray:
    """Agglomerative merges (a, b, distance, size) of a distance matrix, by Lance-Williams updates."""
    n = len(d)
    d = np.array(d, dtype=float)
    np.fill_diagonal(d, np.inf)
    ids, sizes, out = np.arange(n), np.ones(n), []
    for step in range(n - 1):
        i, j = divmod(int(np.argmin(d)), n)
        i, j = min(i, j), max(i, j)
        a, b = sorted((ids[i], ids[j]))
        out.append((a, b, d[i, j], sizes[i] + sizes[j]))
        if method == "single":
            row = np.minimum(d[i], d[j])
        elif method == "complete":
            row = np.where(np.isinf(d[i]) | np.isinf(d[j]), np.inf, np.maximum(d[i], d[j]))
        elif method == "average":
            row = (sizes[i] * d[i] + sizes[j] * d[j]) / (sizes[i] + sizes[j])
        else:
            raise ValueError(f"unknown linkage {method!r}")
        d[i], d[:, i] = row, row
        d[j], d[:, j] = np.inf, np.inf
        d[i, i] = np.inf
        sizes[i] += sizes[j]
        ids[i] = n + step
    return np.array(out).reshape(-1, 4)


def flat_clusters(merges: np.ndarray, n: int, threshold: float) -> np.ndarray:
    """Cluster of each item when merges up to `threshold` are made; numbered from 1 in the order of their first items."""
    parent = np.arange(n + len(merges))

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for k, (a, b, distance, _) in enumerate(merges):
        if distance <= threshold:
            parent[root(int(a))] = parent[root(int(b))] = n + k
    number: dict[int, int] = {}
    return np.array([number.setdefault(root(i), len(number) + 1) for i in range(n)], dtype=np.int64)


def average_merges(d: np.ndarray, n: int) -> np.ndarray:
    """Agglomerative merges (item, item, distance) by average linkage of n items, by chains of nearest neighbours: time n squared and no copy of d,
    the distances above the diagonal row by row, which are overwritten. One item of each merged cluster is named; not in order of distance."""
    base = np.arange(n, dtype=np.int64) * (2 * n - 3 - np.arange(n, dtype=np.int64)) // 2 - 1  # of the pair (i, j): base[i] + j

    def places(i: int, others: np.ndarray) -> np.ndarray:
        k = np.searchsorted(others, i)
        return np.concatenate([base[others[:k]] + i, base[i] + others[k:]])

    live, sizes, chain, out = np.arange(n, dtype=np.int64), np.ones(n), [], []
    while len(live) > 1:
        if not chain:
            chain = [int(live[0])]
        while True:
            x = chain[-1]
            others = np.delete(live, np.searchsorted(live, x))
            row = d[places(x, others)]
            k = int(np.argmin(row))
            if len(chain) > 1 and not row[k] < row[np.searchsorted(others, chain[-2])]:
                break
            chain.append(int(others[k]))
        x, y = chain.pop(), chain.pop()
        out.append((x, y, row[np.searchsorted(others, y)]))
        rest = np.delete(others, np.searchsorted(others, y))
        d[places(y, rest)] = (sizes[x] * np.delete(row, np.searchsorted(others, y)) + sizes[y] * d[places(y, rest)]) / (sizes[x] + sizes[y])
        sizes[y] += sizes[x]
        live = others
    return np.array(out).reshape(-1, 3)


def cut_merges(merges: np.ndarray, n: int, threshold: float) -> np.ndarray:
    """Cluster of each item when average_merges() up to `threshold` are made; numbered from 1 in the order of their first items."""
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b, distance in merges:
        if distance <= threshold:
            parent[root(int(a))] = root(int(b))
    number: dict[int, int] = {}
    return np.array([number.setdefault(root(i), len(number) + 1) for i in range(n)], dtype=np.int64)


def cut_height(merges: np.ndarray, n: int, most: int) -> float:
    """The lowest height at which flat_clusters makes at most `most` clusters of n items; merges of one height are all made."""
    return float(np.sort(merges[:, 2])[n - most - 1]) if 0 < most < n else -1.0 if most >= n else float("inf")


def assignment(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of a minimum-cost assignment (shortest augmenting paths)."""
    cost = np.asarray(cost, dtype=float)
    flipped = cost.shape[0] > cost.shape[1]
    c = cost.T if flipped else cost
    n, m = c.shape
    u, v, match, way = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, dtype=int), np.zeros(m + 1, dtype=int)
    for i in range(1, n + 1):
        match[0], j = i, 0
        low, used = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=bool)
        while True:
            used[j] = True
            r = match[j]
            free = np.flatnonzero(~used[1:]) + 1
            reduced = c[r - 1, free - 1] - u[r] - v[free]
            better = reduced < low[free]
            low[free[better]] = reduced[better]
            way[free[better]] = j
            nxt = free[np.argmin(low[free])]
            delta = low[nxt]
            u[match[used]] += delta
            v[used] -= delta
            low[free] -= delta
            j = nxt
            if match[j] == 0:
                break
        while j:
            match[j] = match[way[j]]
            j = way[j]
    columns = np.flatnonzero(match[1:])
    rows = match[1:][columns] - 1
    order = np.argsort(columns if flipped else rows)
    return (columns[order], rows[order]) if flipped else (rows[order], columns[order])


def hull_area(points: np.ndarray) -> float:
    """Area of the convex hull (monotone chain); 0 below 3 points."""
    p = np.unique(np.asarray(points, dtype=float), axis=0)
    if len(p) < 3:
        return 0.0

    def chain(pts):
        out: list[np.ndarray] = []
        for q in pts:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    h = np.array(chain(p) + chain(p[::-1]))
    x, y = h[:, 0], h[:, 1]
    return float(abs(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2)


def phase_shift(anchor: np.ndarray, moving: np.ndarray, max_shift: int) -> tuple[int, int]:
    """(dy, dx) that moves `moving` onto `anchor`, by phase correlation within max_shift."""
    f = np.fft.fft2(anchor) * np.conj(np.fft.fft2(moving))
    r = np.fft.ifft2(f / np.maximum(np.abs(f), 1e-12)).real
    dy, dx = (np.fft.fftfreq(n, 1 / n).round().astype(int) for n in r.shape)
    allowed = (np.abs(dy)[:, None] <= max_shift) & (np.abs(dx)[None, :] <= max_shift)
    i, j = np.unravel_index(np.argmax(np.where(allowed, r, -np.inf)), r.shape)
    return int(dy[i]), int(dx[j])


def soft_dtw(a: np.ndarray, b: np.ndarray, gamma: float = 1.0) -> float:
    """Soft dynamic time warping of two series, squared differences, along anti-diagonals."""
    n, m = len(a), len(b)
    cost = (a[:, None] - b[None, :]) ** 2
    r = np.full((n + 1, m + 1), np.inf)
    r[0, 0] = 0.0
    for s in range(2, n + m + 1):
        i = np.arange(max(1, s - m), min(n, s - 1) + 1)
        j = s - i
        three = -np.stack([r[i - 1, j - 1], r[i - 1, j], r[i, j - 1]]) / gamma
        top = three.max(axis=0)
        r[i, j] = cost[i - 1, j - 1] - gamma * (top + np.log(np.exp(three - top).sum(axis=0)))
    return float(r[n, m])


#: Robust weights of lags: residuals beyond HUBER scales weigh less, a scale is LEAST_SCALE frames at least.
HUBER, LEAST_SCALE = 1.5, 0.5


def _leaves(x: np.ndarray, y: np.ndarray, rows: int) -> list[np.ndarray]:
    """Points halved along their longer side until at most `rows` are together."""
    todo, out = [np.arange(len(x))] if len(x) else [], []
    while todo:
        at = todo.pop()
        if len(at) <= rows:
            out.append(at)
            continue
        v = (x if np.ptp(x[at]) >= np.ptp(y[at]) else y)[at]
        by = np.argpartition(v, len(at) // 2)
        todo += [at[by[: len(at) // 2]], at[by[len(at) // 2 :]]]
    return out


def nearest(x: np.ndarray, y: np.ndarray, k: int, radius: float, rows: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(point, other, distance) of each point's k nearest others within radius, ties by position.

    Places are looked up once, however many points lie there, and offer their first k + 1 points. A leaf of places is compared with those
    leaves whose boxes are as near as the farthest of the k + 1 nearest in its own leaf; what lies beyond is farther away.
    """
    known = np.flatnonzero(np.isfinite(x) & np.isfinite(y))
    order = known[np.lexsort((y[known], x[known]))]
    xs, ys = x[order], y[order]
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = (xs[1:] != xs[:-1]) | (ys[1:] != ys[:-1])
    place, start = np.cumsum(fresh) - 1, np.flatnonzero(fresh)
    px, py = xs[start], ys[start]
    offered = np.minimum(np.diff(np.append(start, len(order))), k + 1)
    leaves = _leaves(px, py, rows)
    offers = [np.repeat(start[at] - np.cumsum(offered[at]) + offered[at], offered[at]) + np.arange(offered[at].sum()) for at in leaves]
    left, right, low, high = (np.array([f(v[at]) for at in leaves]) for v in (px, py) for f in (np.min, np.max))
    found = [(np.zeros(0, dtype=int), np.zeros(0, dtype=int), np.zeros(0))]

    def distances(at: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = np.sqrt((px[at][:, None] - xs[to][None, :]) ** 2 + (py[at][:, None] - ys[to][None, :]) ** 2)
        return d, np.partition(d, k, axis=1)[:, k] if d.shape[1] > k else np.full(len(at), np.inf)

    for at, own, x0, x1, y0, y1 in zip(leaves, offers, left, right, low, high, strict=True):
        reach = min(radius, distances(at, own)[1].max())
        apart = np.sqrt(np.maximum(np.maximum(left - x1, x0 - right), 0) ** 2 + np.maximum(np.maximum(low - y1, y0 - high), 0) ** 2)
        to = np.concatenate([offers[m] for m in np.flatnonzero(apart <= reach)] or [own])
        d, last = distances(at, to)
        i, j = np.nonzero((d <= last[:, None]) & (d <= radius) & np.isfinite(d))
        d, i, j = d[i, j], at[i], order[to[j]]
        by = np.lexsort((j, d, i))
        i, j, d = i[by], j[by], d[by]
        keep = np.arange(len(i)) - np.searchsorted(i, i) <= k
        found.append((i[keep], j[keep], d[keep]))
    at, other, d = (np.concatenate(c) for c in zip(*found, strict=True))
    by = np.argsort(at, kind="stable")
    at, other, d = at[by], other[by], d[by]
    first = np.searchsorted(at, np.arange(len(start)))
    count = (np.searchsorted(at, np.arange(len(start)), side="right") - first)[place]
    point = np.repeat(order, count)
    each = np.repeat(first[place] - np.cumsum(count) + count, count) + np.arange(len(point))
    by = np.argsort(point, kind="stable")
    point, each = point[by], each[by]
    point, each = (v[other[each] != point] for v in (point, each))
    keep = np.arange(len(point)) - np.searchsorted(point, point) < k
    return point[keep], other[each[keep]], d[each[keep]]


#: Nodes up to which a graph's normal equations are a dense matrix, and the residual, relative to the right side, that ends sparse ones.
DENSE_NODES, SOLVED = 16, 1e-13
#: Nodes that elimination() leaves to a dense matrix, and the edges a node, over all of the graph, at which it gives up.
CORE, FILL = 300, 30


def parts(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest node of each node's connected part."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        after = label.copy()
        np.minimum.at(after, i, low)
        np.minimum.at(after, j, low)
        np.minimum.at(after, label[i], low)
        np.minimum.at(after, label[j], low)
        after = after[after]
        if (after == label).all():
            return label
        label = after


def elimination(n: int, i: np.ndarray, j: np.ndarray, u: np.ndarray, part: np.ndarray) -> Callable[[np.ndarray], np.ndarray] | None:
    """What solves the graph's normal equations for right sides that add up to 0 in each part, up to a constant in each part; None if they
    fill up.

    In each round nodes of few edges, no two of them neighbours, are taken out, which joins a node's neighbours with one another; the last
    CORE nodes are a matrix.
    """
    a, b, w = i, j, np.asarray(u, dtype=float)
    shuffled, active, rounds = np.random.default_rng(0).permutation(n), np.ones(n, dtype=bool), []
    while True:
        code, at = np.unique(np.minimum(a, b) * n + np.maximum(a, b), return_inverse=True)
        a, b, w = code // n, code % n, np.bincount(at, w, len(code))
        a, b, w = (x[a != b] for x in (a, b, w))
        degree = np.bincount(a, minlength=n) + np.bincount(b, minlength=n)
        active &= degree > 0
        left = int(active.sum())
        if left <= CORE:
            break
        if len(a) > FILL * n:
            return None
        rank = degree * n + shuffled
        low = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(low, a, rank[b])
        np.minimum.at(low, b, rank[a])
        taken = active & (rank < low) & (degree <= max(3, 2 * len(a) / left))
        out = taken[a] | taken[b]
        node, near = np.where(taken[a], a, b)[out], np.where(taken[a], b, a)[out]
        by = np.argsort(node, kind="stable")
        node, near, share = node[by], near[by], w[out][by]
        v, first, d = np.unique(node, return_index=True, return_counts=True)
        total = np.add.reduceat(share, first)
        more = [(a[~out], b[~out], w[~out])]
        for k in np.unique(d[d > 1]):
            at = first[d == k][:, None] + np.arange(k)
            one, other = np.triu_indices(k, 1)
            x, y = near[at], share[at]
            more.append((x[:, one].ravel(), x[:, other].ravel(), (y[:, one] * y[:, other] / total[d == k][:, None]).ravel()))
        a, b, w = (np.concatenate(c) for c in zip(*more, strict=True))
        share = share / np.repeat(total, d)
        to = np.argsort(near, kind="stable")
        target, start = np.unique(near[to], return_index=True)
        rounds.append((v, total, near, share, first, node[to], share[to], target, start))
        active[v] = False
    core = np.flatnonzero(active)
    core = np.delete(core, np.unique(part[core], return_index=True)[1])  # one node of each part is 0
    place = np.full(n, -1)
    place[core] = np.arange(len(core))
    matrix = np.diag((np.bincount(a, w, n) + np.bincount(b, w, n))[core])
    both = (place[a] >= 0) & (place[b] >= 0)
    matrix[place[a[both]], place[b[both]]] = matrix[place[b[both]], place[a[both]]] = -w[both]
    inverse = np.linalg.inv(matrix)

    def solve(right: np.ndarray) -> np.ndarray:
        r, x = right.copy(), np.zeros(n)
        for _, _, _, _, _, node, share, target, start in rounds:
            r[target] += np.add.reduceat(share * r[node], start)
        x[core] = inverse @ r[core]
        for v, total, near, share, first, *_ in reversed(rounds):
            x[v] = r[v] / total + np.add.reduceat(share * x[near], first)
        return x

    return solve


class ArrivalGraph:
    """A graph's parts, and elimination() of its first weights: made once for all lags along its edges."""

    def __init__(self, n: int, edges: np.ndarray, weights: np.ndarray):
        i, j = edges[:, 0], edges[:, 1]
        self.part = parts(n, i, j) if n > DENSE_NODES else None
        self.solve = None if self.part is None else elimination(n, i, j, np.maximum(weights, 1e-8), self.part)


def sparse_arrivals(n: int, i: np.ndarray, j: np.ndarray, u: np.ndarray, lags: np.ndarray, part: np.ndarray, start: np.ndarray, solve: Callable[[np.ndarray], np.ndarray] | None = None) -> np.ndarray:
    """Arrival times of weighted least squares by conjugate gradients on the edges, preconditioned by `solve` of like weights, or else scaled by
    the nodes' weights: node 0 is 0 in its part, other parts have mean 0. A system that doesn't reach SOLVED is an error."""
    diagonal = np.bincount(i, u, n) + np.bincount(j, u, n)
    scale = np.where(diagonal > 0, diagonal, 1.0)
    solve = solve or (lambda r: r / scale)

    def times(x: np.ndarray) -> np.ndarray:
        flow = u * (x[j] - x[i])
        return np.bincount(j, flow, n) - np.bincount(i, flow, n)

    right = np.bincount(j, u * lags, n) - np.bincount(i, u * lags, n)
    x, end = start.copy(), SOLVED * float(np.linalg.norm(right))
    for _ in range(20):  # restarts, each from the residual as it is
        r = right - times(x)
        if np.linalg.norm(r) <= end:
            break
        z = solve(r)
        p, rz = z.copy(), float(r @ z)
        for _ in range(2 * n):
            q = times(p)
            if float(p @ q) <= 0:  # p is the same for all of a part: only rounding is left
                break
            step = rz / float(p @ q)
            x += step * p
            r -= step * q
            if np.linalg.norm(r) <= 0.5 * end:
                break
            z = solve(r)
            rz, old = float(r @ z), rz
            p = z + rz / old * p
    else:
        if np.linalg.norm(right - times(x)) > 1e3 * end:
            raise RuntimeError(f"arrival times of {n} nodes did not converge")
    size = np.bincount(part, minlength=n)
    level = np.bincount(part, x, n) / np.maximum(size, 1)
    level[part[0]] = x[0]
    return x - level[part]


def robust_arrivals(n: int, edges: np.ndarray, lags: np.ndarray, weights: np.ndarray, iterations: int = 4, graph: ArrivalGraph | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(arrivals, weights, residuals): arrival times whose differences along edges (i, j) fit the lags by reweighted least squares, node 0
    pinned and then centred; the edges' last weights, and what the fit leaves of the lags.

    The normal equations of the pinned graph are n - 1 square, whatever the number of edges; beyond DENSE_NODES they are solved along the
    edges, without a matrix. A graph in several parts gets its least solution. `graph` may be given where edges and weights come again.
    """
    i, j = edges[:, 0], edges[:, 1]
    graph = graph or ArrivalGraph(n, edges, weights)
    w, x, residual = np.asarray(weights, dtype=float).copy(), np.zeros(n), np.zeros(len(edges))
    for _ in range(iterations):
        u = np.maximum(w, 1e-8)
        if graph.part is not None:
            x = sparse_arrivals(n, i, j, u, lags, graph.part, x, graph.solve)
        else:
            laplace, right = np.zeros((n, n)), np.zeros(n)
            np.add.at(laplace, (np.r_[i, j], np.r_[i, j]), np.r_[u, u])
            np.add.at(laplace, (np.r_[i, j], np.r_[j, i]), -np.r_[u, u])
            np.add.at(right, j, u * lags)
            np.add.at(right, i, -u * lags)
            x = np.append(0.0, np.linalg.lstsq(laplace[1:, 1:], right[1:], rcond=None)[0])
        residual = x[j] - x[i] - lags
        spread = np.median(np.abs(residual - np.median(residual)))
        scale = max(LEAST_SCALE, 1.4826 * float(spread))
        w = weights * np.minimum(1.0, HUBER * scale / np.maximum(np.abs(residual), 1e-8))
    return x - x.mean(), w, residual


def graph_arrivals(n: int, edges: np.ndarray, lags: np.ndarray, weights: np.ndarray, iterations: int = 4, graph: ArrivalGraph | None = None) -> np.ndarray:
    return robust_arrivals(n, edges, lags, weights, iterations, graph)[0]


def refined_origin(coords: np.ndarray, values: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, float, float]:
    """(origin, slope, r2) of the radial front that fits best near start, within half a span around the points: a pattern search whose steps halve.

    Fronts that arrive earlier farther away count as no fit.
    """
    lo, hi = coords.min(axis=0), coords.max(axis=0)
    span = np.maximum(hi - lo, 1.0)
    low, high = lo - 0.5 * span, hi + 0.5 * span
    total = float(((values - values.mean()) ** 2).sum())

    def fit(origin: np.ndarray) -> tuple[float, float]:
        d = np.hypot(*(coords - origin).T)
        dc, vc = d - d.mean(), values - values.mean()
        square = float(dc @ dc)
        slope = float(dc @ vc) / square if square > 0 else 0.0
        return (total, slope) if slope < 0 else (float(((vc - slope * dc) ** 2).sum()), slope)

    at = np.clip(np.asarray(start, dtype=float), low, high)
    best, slope = fit(at)
    step = span / 20
    while (step > span * 1e-7).any():
        tried = [np.clip(at + step * d, low, high) for d in np.array([(1, 0), (-1, 0), (0, 1), (0, -1), (1, 1), (1, -1), (-1, 1), (-1, -1)])]
        scores = [fit(t) for t in tried]
        k = min(range(len(tried)), key=lambda m: scores[m][0])
        if scores[k][0] < best:
            at, (best, slope) = tried[k], scores[k]
        else:
            step = step / 2
    r2 = max(0.0, 1.0 - best / total) if total > 0 and slope >= 0 else 0.0
    return at, slope, r2


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, by its two monotone chains; all points where there are fewer than three."""
    p = np.unique(np.asarray(points, dtype=float).reshape(-1, 2), axis=0)
    if len(p) < 3:
        return p

    def chain(rows):
        out: list[np.ndarray] = []
        for q in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(chain(p) + chain(p[::-1]))


def linear_r2(design: np.ndarray, values: np.ndarray) -> float:
    """R squared of least squares on design, at least 0."""
    fit = design @ np.linalg.lstsq(design, values, rcond=None)[0]
    total = ((values - values.mean()) ** 2).sum()
    return max(0.0, 1.0 - float(((values - fit) ** 2).sum()) / total) if total > 0 else 0.0


def radial_scores(coords: np.ndarray, values: np.ndarray, grid: int = 21, margin: float = 0.25) -> tuple[float, np.ndarray]:
    """The largest squared positive correlation of values with the distance from a grid of origins, and that origin."""
    return radial_fit(radial_grid(coords, grid, margin), values)


def radial_grid(coords: np.ndarray, grid: int = 21, margin: float = 0.25) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(origins, distances from them less their mean, their squares' sums), for radial_fit() of many values."""
    lo, hi = coords.min(axis=0), coords.max(axis=0)
    pad = (hi - lo) * margin
    gx, gy = (np.linspace(lo[k] - pad[k], hi[k] + pad[k], grid) for k in (0, 1))
    origins = np.stack(np.meshgrid(gx, gy, indexing="ij"), axis=-1).reshape(-1, 2)
    d = np.hypot(coords[None, :, 0] - origins[:, :1], coords[None, :, 1] - origins[:, 1:])
    d = d - d.mean(axis=1, keepdims=True)
    return origins, d, (d**2).sum(axis=1)


def radial_fit(around: tuple[np.ndarray, np.ndarray, np.ndarray], values: np.ndarray) -> tuple[float, np.ndarray]:
    origins, d, squares = around
    v = values - values.mean()
    r = d @ v / np.maximum(np.sqrt(squares * (v**2).sum()), 1e-12)
    k = int(np.argmax(r))
    return float(max(r[k], 0.0) ** 2), origins[k]
