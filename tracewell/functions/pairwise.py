"""Similarities of all rows of one table with all rows of another, as matrices in NumPy."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa


def rounded(x: np.ndarray, digits: int | None) -> np.ndarray:
    """x to so many digits, halves away from 0."""
    if digits is None:
        return x
    scale = 10.0**digits
    return np.trunc(x * scale + np.copysign(0.5, x)) / scale


class Measure:
    """prepare() reads a table's columns; calling it with two prepared sides gives named matrices. `rows` of the left side at once."""

    rows = 64

    def prepare(self, table: pa.Table):
        raise NotImplementedError

    def __call__(self, a, b) -> dict[str, np.ndarray]:
        raise NotImplementedError


def arrays_by_length(column: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """{length: (positions, matrix)} of a column of arrays; null arrays and arrays with a null are left out."""
    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = np.asarray(c.values.to_numpy(zero_copy_only=False), dtype=float)
    start = c.offsets.to_numpy()
    ok = np.ones(len(c), dtype=bool) if c.null_count == 0 else np.asarray(c.is_valid())
    if c.values.null_count:
        nulls = np.append(0, np.cumsum(np.asarray(c.values.is_null())))
        ok &= nulls[start[1:]] == nulls[start[:-1]]
    n = np.diff(start)
    out = {}
    for length in np.unique(n[ok]):
        at = np.flatnonzero(ok & (n == length))
        out[int(length)] = at, values[start[at][:, None] + np.arange(length)]
    return out


class OnTraces(Measure):
    """A measure of traces f; traces of different lengths, or with nulls, have none."""

    def __init__(self, f: str = "f", digits: int | None = None, rows: int = 64):
        self.f, self.digits, self.rows = f, digits, rows

    def ready(self, x: np.ndarray):
        return x

    def matrix(self, x, y, n: int) -> np.ndarray:
        raise NotImplementedError

    def prepare(self, table: pa.Table):
        return len(table), {n: (at, self.ready(x)) for n, (at, x) in arrays_by_length(table[self.f]).items()}

    def value(self, a, b) -> np.ndarray:
        out = None
        for n, (at, x) in a[1].items():
            if n in b[1]:
                to, y = b[1][n]
                v = self.matrix(x, y, n)
                if v.shape == (a[0], b[0]):
                    return v
                out = np.full((a[0], b[0]), np.nan) if out is None else out
                out[np.ix_(at, to)] = v
        return np.full((a[0], b[0]), np.nan) if out is None else out

    def __call__(self, a, b) -> dict[str, np.ndarray]:
        return {"value": rounded(self.value(a, b), self.digits)}


def standardized(x: np.ndarray, least: float = 1e-8) -> np.ndarray:
    """Rows as population z-scores; a row whose deviation is below `least` becomes 0."""
    if not x.shape[1]:
        return x
    c = x - x.mean(axis=1, keepdims=True)
    sd = np.sqrt((c * c).mean(axis=1, keepdims=True))
    return np.where(sd < least, 0.0, c / np.where(sd < least, 1.0, sd))


class CrossCorrelation(OnTraces):
    """The largest mean product over lags, of traces standardised as a whole; cut to 0..1, or signed by the largest magnitude."""

    def __init__(self, max_lag: int, clip_negative: bool = True, **kw):
        super().__init__(**kw)
        self.max_lag, self.clip = max_lag, clip_negative

    def ready(self, x):
        return standardized(x)

    def matrix(self, x, y, n):
        best = None
        for k in range(-self.max_lag, self.max_lag + 1):
            if n > abs(k):
                v = x[:, max(0, k) : n + min(0, k)] @ y[:, max(0, -k) : n - max(0, k)].T / (n - abs(k))
                if best is None:
                    best = v
                elif self.clip:
                    np.maximum(best, v, out=best)
                else:
                    best = np.where((np.abs(v) > np.abs(best)) | ((np.abs(v) == np.abs(best)) & (v > best)), v, best)
        if best is None:
            return np.full((len(x), len(y)), 0.0 if self.clip else np.nan)
        return np.clip(best, 0.0, 1.0) if self.clip else best

    def value(self, a, b):
        v = super().value(a, b)
        return np.nan_to_num(v, nan=0.0) if self.clip else v


class Pearson(OnTraces):
    """Correlation; 0 where either hardly varies."""

    def __init__(self, least: float = 1e-12, **kw):
        super().__init__(**kw)
        self.least = least

    def ready(self, x):
        c = x - x.mean(axis=1, keepdims=True) if x.shape[1] else x
        return c, np.sqrt((c * c).sum(axis=1) / max(1, x.shape[1]))

    def matrix(self, x, y, n):
        cov, spread = x[0] @ y[0].T / max(1, n), x[1][:, None] * y[1][None, :]
        flat = spread < self.least
        return np.where(flat, 0.0, cov / np.where(flat, 1.0, spread))


class Distance(OnTraces):
    """1 less the mean product of standardised traces."""

    def ready(self, x):
        return standardized(x)

    def matrix(self, x, y, n):
        return 1 - x @ y.T / max(1, n)

    def __call__(self, a, b):
        return {"distance": rounded(self.value(a, b), self.digits)}


class WeightedPearson(OnTraces):
    """Correlation weighted by max(|x|, |y|) squared, cut to -1..1."""

    def __init__(self, least: float = 1e-12, rows: int = 16, **kw):
        super().__init__(rows=rows, **kw)
        self.least = least

    def matrix(self, x, y, n):
        shape = len(x), len(y)
        w, wx, wy = np.empty(shape), np.empty(shape), np.empty(shape)
        total, sx, sy, sxy, sxx, syy = (np.zeros(shape) for _ in range(6))
        for k in range(n):
            u, v = np.ascontiguousarray(x[:, k])[:, None], np.ascontiguousarray(y[:, k])[None, :]
            np.maximum(u * u, v * v, out=w)
            total += w
            np.multiply(w, u, out=wx)
            np.multiply(w, v, out=wy)
            sx += wx
            sy += wy
            sxy += np.multiply(wx, v, out=w)
            sxx += np.multiply(wx, u, out=wx)
            syy += np.multiply(wy, v, out=wy)
        none = total == 0
        total[none] = 1.0
        for s in (sx, sy, sxy, sxx, syy):
            s /= total
        d = np.sqrt(np.maximum(sxx - sx * sx, 0) * np.maximum(syy - sy * sy, 0))
        flat = none | (d < self.least)
        d[flat] = 1.0
        return np.where(flat, 0.0, np.clip((sxy - sx * sy) / d, -1.0, 1.0))

    def value(self, a, b):
        return np.nan_to_num(super().value(a, b), nan=0.0)


class Significance(Pearson):
    """Correlation with Student's two-sided p on its n - 2 degrees of freedom, and whether p is below alpha."""

    def __init__(self, alpha: float = 0.05, **kw):
        super().__init__(**kw)
        self.alpha = alpha

    def __call__(self, a, b):
        r = self.value(a, b)
        n = np.full(a[0], np.nan)
        for length, (at, _) in a[1].items():
            n[at] = length
        p = np.full(r.shape, np.nan)
        for length in np.unique(n[~np.isnan(n)]):
            rows = n == length
            if length > 2:
                p[rows] = student_two_sided(r[rows] * np.sqrt((length - 2) / (1 - r[rows] ** 2 + 1e-10)), int(length) - 2)
        return {"p": rounded(p, self.digits), "significant": p < self.alpha}


def student_two_sided(t: np.ndarray, df: int) -> np.ndarray:
    """Two-sided p of t on df whole degrees of freedom, by the finite series in the cosine of atan(t / sqrt(df))."""
    square = df / (df + t * t)  # the cosine's square
    sine = np.sqrt(1 - square)
    total, term = np.ones_like(square), np.ones_like(square)
    if df % 2 == 0:
        for k in range(1, df // 2):
            term *= square
            term *= (2 * k - 1) / (2 * k)
            total += term
        inside = sine * total
    else:
        for k in range(1, (df - 1) // 2):
            term *= square
            term *= 2 * k / (2 * k + 1)
            total += term
        angle = np.arctan2(sine, np.sqrt(square))
        inside = 2 / math.pi * (angle + (sine * np.sqrt(square) * total if df > 1 else 0.0))
    return np.where(np.isnan(t), np.nan, np.clip(1 - inside, 0.0, 1.0))


class Trains:
    """Event times of several trains, in order within each."""

    def __init__(self, column: pa.ChunkedArray):
        c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        start = c.offsets.to_numpy()
        times = np.asarray(c.values.to_numpy(zero_copy_only=False), dtype=float)[start[0] : start[-1]]
        self.n = np.diff(start)
        train = np.repeat(np.arange(len(self.n)), self.n)
        order = np.lexsort((times, train))
        self.times, self.train, self.start = times[order], train, np.append(0, np.cumsum(self.n))

    def likeness(self) -> np.ndarray:
        """The trains' positions in an order that puts equal trains side by side, those of fewest events last."""
        key = [(-n, self.times[at : at + n].tobytes()) for n, at in zip(self.n.tolist(), self.start.tolist(), strict=False)]
        return np.array(sorted(range(len(key)), key=key.__getitem__), dtype=np.int64)

    def spans(self, dt: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(train, lo, hi): what lies within dt of an event, as spans that don't touch."""
        lo, hi = self.times - dt, self.times + dt
        fresh = np.ones(len(lo), dtype=bool)
        fresh[1:] = (self.train[1:] != self.train[:-1]) | (lo[1:] > hi[:-1])
        first = np.flatnonzero(fresh)
        return self.train[first], lo[first], hi[np.append(first[1:], len(lo)) - 1] if len(first) else hi[:0]


def near_counts(a: Trains, b: Trains, dt: float, most: int = 1 << 22) -> np.ndarray:
    """How many events of each train of a (rows) lie within dt of an event of each train of b (columns).

    Running counts of a's events by train, looked up at both ends of b's spans; `most` bounds their elements at once.
    """
    out = np.zeros((len(a.n), len(b.n)), dtype=np.int64)
    train, lo, hi = b.spans(dt)
    nth = np.arange(len(train)) - np.searchsorted(train, train)  # a span's place among its train's
    order = np.argsort(nth, kind="stable")
    bounds = np.searchsorted(nth[order], np.arange(int(nth.max()) + 2)) if len(train) else np.zeros(1, dtype=int)
    at = 0
    while at < len(a.n):
        events = np.cumsum(a.n[at:])
        fits = np.flatnonzero(events * np.arange(1, len(events) + 1) <= most)
        take = int(fits[-1]) + 1 if len(fits) else 1
        first, last = a.start[at], a.start[at + take]
        own = np.argsort(a.times[first:last], kind="stable")
        times = a.times[first:last][own]
        kind = np.int16 if a.n[at : at + take].max(initial=0) < 30_000 else np.int64
        running = np.zeros((len(times) + 1, take), dtype=kind)
        running[np.arange(1, len(times) + 1), a.train[first:last][own] - at] = 1
        np.cumsum(running, axis=0, out=running)
        low, high = np.searchsorted(times, lo, side="left"), np.searchsorted(times, hi, side="right")
        part = np.zeros((len(b.n), take), dtype=kind)
        for k in range(len(bounds) - 1):
            s = order[bounds[k] : bounds[k + 1]]
            part[train[s]] += running[high[s]] - running[low[s]]
        out[at : at + take] = part.T
        at += take
    return out


def nonzero_tiles(x: np.ndarray, wide: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """np.nonzero(x) in another order: tile by tile of `wide` columns, and what isn't in a whole eight of columns behind all tiles.

    Parquet packs values by eights and then looks for bytes that repeat. So a tile's column numbers repeat from row to row, where a
    missing element in np.nonzero's order would move all that follow.
    """
    rows, columns = x.shape
    tiles = -(-columns // wide)
    present = np.zeros((rows, tiles * wide), dtype=bool)
    np.not_equal(x, 0, out=present[:, :columns])
    eights = present.reshape(rows, tiles, wide // 8, 8)
    whole = eights.all(axis=3)
    tile, i, eight = np.nonzero(whole.transpose(1, 0, 2))
    j = (tile * wide + eight * 8)[:, None] + np.arange(8)
    eights[whole] = False
    rest, left = np.nonzero(present)
    return np.append(np.repeat(i, 8), rest), np.append(j.ravel(), left)


class SpikeTiling(Measure):
    """The spike time tiling coefficient of trains `times` with their tiled shares `tiled`."""

    rows = 256

    def __init__(self, dt: float, digits: int | None = None):
        self.dt, self.digits = dt, digits

    def prepare(self, table: pa.Table):
        return Trains(table["times"]), table["tiled"].to_numpy()

    def __call__(self, a, b):
        pa_ = near_counts(a[0], b[0], self.dt) / np.maximum(a[0].n, 1)[:, None]
        pb = near_counts(b[0], a[0], self.dt).T / np.maximum(b[0].n, 1)[None, :]

        def half(p: np.ndarray, other: np.ndarray) -> np.ndarray:
            d = 1 - p * other
            return np.where(d == 0, 0.0, (p - other) / np.where(d == 0, 1.0, d))

        return {"value": rounded(0.5 * (half(pa_, b[1][None, :]) + half(pb, a[1][:, None])), self.digits)}


class Product(Measure):
    """The product of measures, each cut to 0..1, undefined as 0."""

    def __init__(self, *measures: Measure, digits: int | None = None):
        self.measures, self.digits, self.rows = measures, digits, min(256, min(m.rows for m in measures) * 4)

    def prepare(self, table: pa.Table):
        return [m.prepare(table) for m in self.measures]

    def __call__(self, a, b):
        out = 1.0
        for m, x, y in zip(self.measures, a, b, strict=True):
            out = out * np.clip(np.nan_to_num(m(x, y)["value"], nan=0.0), 0.0, 1.0)
        return {"value": rounded(out, self.digits)}


#: Series up to this length together are warped as products of exponentials; below LEAST they are done again as logarithms.
SHORT, LEAST = 128, 1e-200


class SoftWarping(OnTraces):
    """Soft dynamic time warping of standardised, downsampled traces, squared differences."""

    def __init__(self, downsample: int = 1, gamma: float = 1.0, rows: int = 16, **kw):
        super().__init__(rows=rows, **kw)
        self.downsample, self.gamma = downsample, gamma

    def ready(self, x):
        return np.ascontiguousarray(standardized(x)[:, :: self.downsample].T)  # frames first

    def matrix(self, x, y, n):
        short = len(x) + len(y) <= SHORT and len(x)
        out = self.products(x, y) if short else self.logarithms(x, y)
        if short and (bad := ~(out >= LEAST)).any():
            i, j = np.nonzero(bad)
            again = self.logarithms(x[:, i], y[:, j], paired=True)
            out = -self.gamma * np.log(np.where(bad, 1.0, out))
            out[bad] = again
            return out
        return -self.gamma * np.log(out) if short else out

    def products(self, x, y):
        """exp(-distance / gamma), row by row of the warping table."""
        shape = x.shape[1], y.shape[1]
        row = [np.ones(shape)] + [np.zeros(shape) for _ in range(len(y))]
        step, both = np.empty(shape), np.empty(shape)
        for s in range(len(x)):
            corner, row[0] = row[0], np.zeros(shape)
            for t in range(len(y)):
                np.subtract(x[s][:, None], y[t][None, :], out=step)
                np.multiply(step, step, out=step)
                step *= -1 / self.gamma
                np.exp(step, out=step)
                np.add(corner, row[t], out=both)
                both += row[t + 1]
                corner = row[t + 1]
                row[t + 1] = step * both
        return row[-1]

    def logarithms(self, x, y, paired: bool = False):
        """distance, row by row; paired: of column k of x with column k of y."""
        shape = (x.shape[1],) if paired else (x.shape[1], y.shape[1])
        row = [np.zeros(shape)] + [np.full(shape, np.inf) for _ in range(len(y))]
        for s in range(len(x)):
            corner, row[0] = row[0], np.full(shape, np.inf)
            for t in range(len(y)):
                d = x[s] - y[t] if paired else x[s][:, None] - y[t][None, :]
                low = np.minimum(np.minimum(corner, row[t]), row[t + 1])
                soft = sum(np.exp((low - v) / self.gamma) for v in (corner, row[t], row[t + 1]))
                corner = row[t + 1]
                row[t + 1] = d * d + low - self.gamma * np.log(soft)
        return row[-1]

    def __call__(self, a, b):
        return {"distance": rounded(self.value(a, b), self.digits)}


#: Pixels of a slice of the matrices that overlaps() multiplies, and the elements of a pair of masks that cost as much as one shared pixel looked up.
SLICE, DENSE = 4096, 200


def overlaps(a: pa.ChunkedArray, b: pa.ChunkedArray) -> np.ndarray:
    """How many pixels each mask of a (rows) shares with each mask of b (columns); both are columns of arrays of distinct pixels of any type.

    Matrix products where masks are dense in the pixels that both sides have, else pixel by pixel.
    """
    one, other = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (a, b))
    sizes = [np.diff(c.offsets.to_numpy()) for c in (one, other)]
    code = pa.concat_arrays([one.flatten(), other.flatten()]).dictionary_encode().indices.to_numpy()
    x, y = code[: sizes[0].sum()], code[sizes[0].sum() :]
    i, j = np.repeat(np.arange(len(one)), sizes[0]), np.repeat(np.arange(len(other)), sizes[1])
    n = int(code.max(initial=-1)) + 1
    na, nb = np.bincount(x, minlength=n), np.bincount(y, minlength=n)
    shared = (na > 0) & (nb > 0)
    place = np.cumsum(shared) - 1
    i, x, j, y = i[shared[x]], place[x[shared[x]]], j[shared[y]], place[y[shared[y]]]
    na, nb, n = na[shared], nb[shared], int(shared.sum())
    if len(one) * len(other) * n <= DENSE * float((na * nb).sum()):
        out = np.zeros((len(one), len(other)), dtype=np.float64)
        for at in range(0, n, SLICE):
            u, v = (x >= at) & (x < at + SLICE), (y >= at) & (y < at + SLICE)
            left, right = np.zeros((len(one), min(SLICE, n - at)), dtype=np.float32), np.zeros((len(other), min(SLICE, n - at)), dtype=np.float32)
            left[i[u], x[u] - at] = 1
            right[j[v], y[v] - at] = 1
            out += left @ right.T
        return out.astype(np.int64)
    out = np.zeros((len(one), len(other)), dtype=np.int64)
    i, j = i[np.argsort(x, kind="stable")], j[np.argsort(y, kind="stable")]
    starts, ends = np.cumsum(na) - na, np.cumsum(nb) - nb
    for k in range(n):
        out[i[starts[k] : starts[k] + na[k]][:, None], j[ends[k] : ends[k] + nb[k]][None, :]] += 1
    return out
