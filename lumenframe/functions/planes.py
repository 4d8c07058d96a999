"""Operators on one pixel plane: a two-dimensional array of doubles, row by row.

Statistics skip values that aren't finite or lie beyond single precision. Variances divide by n - 1 and are 0 for two
values or fewer.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

FLOAT_MAX = float(np.finfo(np.float32).max)
OTSU_LEVELS = 1024


@dataclass(frozen=True)
class Moments:
    n: int
    low: float
    high: float
    mean: float
    var: float
    skewness: float
    kurtosis: float

    @property
    def std(self) -> float:
        return float(np.sqrt(self.var))

    @classmethod
    def of(cls, values: np.ndarray) -> Moments:
        v = np.asarray(values, float).ravel()
        v = v[np.abs(v) <= FLOAT_MAX]
        n = len(v)
        if not n:
            return cls(0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)
        mean = float(v.mean())
        d = v - mean
        m2, m3, m4 = (float((d**k).sum()) for k in (2, 3, 4))
        if v.min() == v.max():
            m2 = m3 = m4 = 0.0
        with np.errstate(all="ignore"):
            skew = np.float64(np.sqrt(n) * m3) / np.float64(m2) ** 1.5 if n > 3 else 0.0
            kurt = np.float64(n * m4) / (np.float64(m2) * m2) if n > 4 else 0.0
        return cls(n, float(v.min()), float(v.max()), mean, m2 / (n - 1) if n > 2 else 0.0, float(skew), float(kurt))


def binned(values: np.ndarray, bins: int, low: float | None = None, high: float | None = None) -> np.ndarray:
    """Counts in bins of equal width between the extremes (or the bounds given); the last bin takes its upper bound,
    no range at all puts everything into the first."""
    v = np.asarray(values, float).ravel()
    if low is None:
        m = Moments.of(v)
        low, high = m.low, m.high
    scale = bins / (high - low) if high > low else 0.0
    with np.errstate(invalid="ignore"):
        at = (v - low) * scale
    at = np.where(np.isnan(at), bins - 1, np.clip(at, 0, bins - 1))  # what is no number goes to the last bin
    return np.bincount(at.astype(np.int64), minlength=bins).astype(float)


def otsu(plane: np.ndarray, bits: int | None = None) -> float:
    """The threshold that maximizes the variance between classes, over 1,024 levels of the plane's own range, or of the
    range of ``bits``; the first of several."""
    if bits is None:
        m = Moments.of(plane)
        low, high = m.low, m.high
    else:
        low, high = 0.0, 2.0**bits - 1
    share = binned(plane, OTSU_LEVELS, low, high) / plane.size
    omega = np.cumsum(share)
    mu = np.cumsum(share * np.arange(OTSU_LEVELS))
    with np.errstate(all="ignore"):
        between = (mu[-1] * omega - mu) ** 2 / (omega * (1.0 - omega))
    between = np.where((omega == 0.0) | (omega == 1.0), 0.0, between)[:-1]
    at = int(np.argmax(between)) if between.max() > 0 else 0
    return at / (OTSU_LEVELS - 1) * (high - low) + low


def otsu_mask(plane: np.ndarray) -> np.ndarray:
    return plane > otsu(plane)


def shifted(plane: np.ndarray, dy: int, dx: int) -> np.ndarray:
    """The value ``dy`` rows below and ``dx`` columns right of each pixel, 0 beyond the border."""
    h, w = plane.shape
    out = np.zeros_like(plane)
    y0, y1, x0, x1 = max(0, -dy), min(h, h - dy), max(0, -dx), min(w, w - dx)
    if y0 < y1 and x0 < x1:
        out[y0:y1, x0:x1] = plane[y0 + dy : y1 + dy, x0 + dx : x1 + dx]
    return out


def convolve(plane: np.ndarray, taps: np.ndarray) -> np.ndarray:
    """Correlation with ``taps`` (odd sides), 0 beyond the border."""
    cy, cx = taps.shape[0] // 2, taps.shape[1] // 2
    out = np.zeros(plane.shape)
    for j, i in zip(*np.nonzero(taps), strict=True):
        out += taps[j, i] * shifted(plane, int(j) - cy, int(i) - cx)
    return out


#: Left minus right column, upper minus lower row of the three by three neighbourhood.
PREWITT_X = np.array([[1.0, 0.0, -1.0]] * 3)
PREWITT_Y = PREWITT_X.T


def prewitt_magnitude(plane: np.ndarray) -> np.ndarray:
    return np.hypot(convolve(plane, PREWITT_X), convolve(plane, PREWITT_Y))


def prewitt_direction(plane: np.ndarray) -> np.ndarray:
    gx, gy = convolve(plane, PREWITT_X), convolve(plane, PREWITT_Y)
    return np.where(gy == 0, 3.1415926 * (gx < 0), np.arctan2(gy, gx))


def edge(plane: np.ndarray) -> np.ndarray:
    """The largest difference from a neighbour, along each axis only where both neighbours exist."""
    out = np.zeros(plane.shape)
    for axis in (0, 1):
        if plane.shape[axis] < 3:
            continue
        step = np.abs(np.diff(plane, axis=axis))
        inner = [slice(None)] * 2
        inner[axis] = slice(1, -1)
        a, b = (np.take(step, range(k, step.shape[axis] - 1 + k), axis) for k in (0, 1))
        out[tuple(inner)] = np.maximum(out[tuple(inner)], np.maximum(a, b))
    return out


def area_weights(n: int, ratio: float) -> np.ndarray:
    """Rows: shares of the old pixels in each new one."""
    size = 1.0 / min(ratio, 1.0)
    new = int(min(ratio, 1.0) * n)
    start = np.arange(new)[:, None] * size
    old = np.arange(n)[None, :]
    return np.clip(np.minimum(start + size, old + 1) - np.maximum(start, old), 0.0, None) / size


def downsample(plane: np.ndarray, x_ratio: float, y_ratio: float) -> np.ndarray:
    """By area averaging, along rows and then columns."""
    if x_ratio >= 1 and y_ratio >= 1:
        return plane
    return area_weights(plane.shape[0], y_ratio) @ (plane @ area_weights(plane.shape[1], x_ratio).T)


def crop(plane: np.ndarray, x1: int, y1: int, x2: int, y2: int) -> np.ndarray:
    """Columns x1 to x2 and rows y1 to y2, both ends included."""
    if not (0 <= x1 <= x2 < plane.shape[1] and 0 <= y1 <= y2 < plane.shape[0]):
        raise ValueError(f"({x1}, {y1}) to ({x2}, {y2}) isn't within {plane.shape[1]} x {plane.shape[0]} pixels")
    return plane[y1 : y2 + 1, x1 : x2 + 1]


def rotate(plane: np.ndarray, quarters: int) -> np.ndarray:
    """By quarters of a turn, clockwise."""
    return np.rot90(plane, -quarters)


def invert(plane: np.ndarray) -> np.ndarray:
    return plane.max() - plane + plane.min()


def scale_to_range(plane: np.ndarray, low: float, high: float, top: float) -> np.ndarray:
    """[low, high] to [0, top], clipped."""
    return np.where(plane < low, 0.0, np.where(plane > high, top, (plane - low) * (top / (high - low))))


def set_mean(plane: np.ndarray, mean: float, std: float = 0.0, bits: int = 8) -> np.ndarray:
    """Shifted to the mean and, where ``std`` is positive, scaled to it; clipped to the range of ``bits``."""
    m = Moments.of(plane)
    v = plane - (m.mean - mean)
    if std > 0 and m.std > 0:
        v = mean + (v - mean) * (std / m.std)
    return np.clip(v, 0.0, 2.0**bits - 1)


def to_8_bits(plane: np.ndarray) -> np.ndarray:
    m = Moments.of(plane)
    return (plane - m.low) * (255.0 / (m.high - m.low)) if m.high > m.low else np.zeros(plane.shape)


def labels(mask: np.ndarray, corners: bool = True) -> np.ndarray:
    """Numbers of the connected groups of set pixels, from 1 in the order of their first pixels; 0 elsewhere."""
    h, w = mask.shape
    at = np.arange(h * w).reshape(h, w)
    pairs = []
    for dy, dx in [(0, 1), (1, 0)] + [(1, 1), (1, -1)] * corners:
        a = (slice(0, h - dy), slice(max(0, -dx), w - max(0, dx)))
        b = (slice(dy, h), slice(max(0, dx), w - max(0, -dx)))
        both = mask[a] & mask[b]
        pairs.append(np.stack((at[a][both], at[b][both])))
    a, b = np.concatenate(pairs, axis=1)
    root = at.ravel().copy()
    while True:  # hook each pair's larger root below the smaller one, then shorten the paths
        x, y = root[a], root[b]
        if (x == y).all():
            break
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    out = np.zeros(h * w, np.int64)
    on = mask.ravel()
    out[on] = np.unique(root[on], return_inverse=True)[1] + 1
    return out.reshape(h, w)


def centroid(mask: np.ndarray) -> tuple[float, float]:
    """x and y, counted from 1; 0 for an empty mask."""
    y, x = np.nonzero(mask)
    return (float(x.mean()) + 1, float(y.mean()) + 1) if len(x) else (0.0, 0.0)


def euler_number(mask: np.ndarray) -> int:
    """From two by two neighbourhoods with one and with three set pixels, a quarter of their difference, cut towards 0;
    diagonal neighbourhoods don't count."""
    m = mask.astype(np.int64)
    quads = m[:-1, :-1] + m[:-1, 1:] + m[1:, :-1] + m[1:, 1:]
    return int((int((quads == 1).sum()) - int((quads == 3).sum())) / 4)
