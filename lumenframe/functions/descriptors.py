"""Descriptors of one pixel plane, each a vector of fixed width; ``@descriptor`` adds another.

Where a value isn't defined (a plane without range or mass), the docstring says what stands for it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache
from math import comb

import numpy as np

from lumenframe.functions import planes
from lumenframe.functions.colors import COLORS, ColorTable
from lumenframe.functions.planes import Moments, binned


@dataclass(frozen=True)
class Image:
    """A plane, and its hue, saturation and value (height x width x 3) where it has colours."""

    plane: np.ndarray
    hsv: np.ndarray | None = None
    colors: ColorTable | None = None


@dataclass(frozen=True)
class Descriptor:
    name: str
    width: int
    run: Callable[[Image], np.ndarray]


DESCRIPTORS: dict[str, Descriptor] = {}


def descriptor(name: str, width: int):
    """Registers a function of an ``Image`` that gives ``width`` numbers."""

    def add(run: Callable[[Image], np.ndarray]) -> Callable[[Image], np.ndarray]:
        DESCRIPTORS[name] = Descriptor(name, width, run)
        return run

    return add


# --- polynomials


@lru_cache(maxsize=2)
def polar_basis(h: int, w: int, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the pixels within the unit disc: which they are, radial polynomials and angular terms (pixels x 2 order + 1)."""
    x = -1.0 + np.arange(w)[None, :] * (2.0 / (w - 1) if w > 1 else 0.0)
    y = -1.0 + np.arange(h)[:, None] * (2.0 / (h - 1) if h > 1 else 0.0)
    r, angle = np.hypot(x, y), -np.arctan2(y, np.broadcast_to(x, (h, w)))
    inside = r < 1
    k = np.arange(2 * order + 1)
    radial = np.cos(np.arccos(np.clip(2 * r[inside] - 1, -1, 1))[:, None] * k)
    radial[:, 0] = 0.5
    turns = np.exp(-1j * angle[inside][:, None] * (k - order))
    turns[:, order] *= 0.5
    return inside, radial, turns


@descriptor("Chebyshev-Fourier Coefficients", 32)
def chebyshev_fourier(image: Image) -> np.ndarray:
    """Histogram of the magnitudes of polar Chebyshev-Fourier sums of order 11; zeros where they are all equal."""
    p = image.plane
    if p.size > 300 * 300:
        ratio = min(300.0 / p.shape[1], 300.0 / p.shape[0])
        p = planes.downsample(p, ratio, ratio)
    inside, radial, turns = polar_basis(*p.shape, min(11, (min(p.shape) - 1) // 2))
    size = np.abs((turns * p[inside][:, None]).T @ radial).ravel()
    return binned(size, 32, size.min(), size.max()) if size.max() > size.min() else np.zeros(32)


@lru_cache(maxsize=8)
def chebyshev_basis(n: int, order: int) -> np.ndarray:
    """Weights of n samples in each of the first ``order`` coefficients."""
    x = 2.0 * np.arange(1, n + 1) / n - 1.0
    t = np.cos(np.arccos(np.clip(x, -1, 1))[:, None] * np.arange(order))
    t[:, 1:] *= 2
    return t / (2 * n)


def chebyshev_coefficients(plane: np.ndarray, order: int) -> np.ndarray:
    """order x order coefficients, those along rows first."""
    h, w = plane.shape
    return (plane @ chebyshev_basis(w, order)).T @ chebyshev_basis(h, order)


@descriptor("Chebyshev Coefficients", 32)
def chebyshev(image: Image) -> np.ndarray:
    """Histogram of the Chebyshev coefficients up to order 20."""
    return binned(chebyshev_coefficients(image.plane, min(20, *image.plane.shape)), 32)


ZERNIKE_ORDER = 15


@lru_cache(maxsize=1)
def zernike_terms() -> list[tuple[int, int, np.ndarray]]:
    """(n, m, coefficients of r ** 0 to r ** n) of the radial polynomials."""
    out = []
    for n in range(ZERNIKE_ORDER + 1):
        for m in range(n % 2, n + 1, 2):
            c = np.zeros(ZERNIKE_ORDER + 1)
            for s in range((n - m) // 2 + 1):
                c[n - 2 * s] = (-1) ** s * comb(n - s, s) * comb(n - 2 * s, (n - m) // 2 - s)
            out.append((n, m, c))
    return out


@descriptor("Zernike Coefficients", 72)
def zernike(image: Image) -> np.ndarray:
    """Magnitudes of Zernike moments up to order 15 about the centroid, on a disc whose radius is the shorter side;
    zeros for a plane without mass."""
    p = image.plane
    h, w = p.shape
    mass = float(p.sum())
    if mass == 0 or not np.isfinite(mass):
        return np.zeros(len(zernike_terms()))
    radius = min(h, w)
    x = (np.arange(1, w + 1) - (p.sum(axis=0) * np.arange(1, w + 1)).sum() / mass)[None, :] / radius
    y = (np.arange(1, h + 1) - (p.sum(axis=1) * np.arange(1, h + 1)).sum() / mass)[:, None] / radius
    r = np.hypot(x, y)
    inside = (r >= np.finfo(float).eps) & (r <= 1.0)
    ri, f = r[inside], p[inside] / mass
    powers = ri[:, None] ** np.arange(ZERNIKE_ORDER + 1)
    turn = (np.broadcast_to(x, p.shape)[inside] - 1j * np.broadcast_to(y, p.shape)[inside]) / np.where(ri > 0, ri, 1.0)
    # sums over pixels of f * r ** k * turn ** m
    sums = np.array([(f * turn**m) @ powers for m in range(ZERNIKE_ORDER + 1)])
    return np.array([abs((n + 1) / np.pi * (sums[m] @ c)) for n, m, c in zernike_terms()])


# --- textures

LOG2_GUARD = 1e-9


def entropy(p: np.ndarray) -> float:
    return float(-(p * np.log2(p + LOG2_GUARD)).sum())


def cooccurrence_statistics(p: np.ndarray) -> np.ndarray:
    """The fourteen statistics of a symmetric matrix of shares between tones."""
    n = len(p)
    tone = np.arange(n)
    px = p.sum(axis=1)
    sums = np.bincount((tone[:, None] + tone).ravel(), p.ravel(), 2 * n - 1)
    differences = np.bincount(np.abs(tone[:, None] - tone).ravel(), p.ravel(), n)
    mean = float(px @ tone)
    spread = float(px @ tone**2) - mean**2
    sum_entropy = entropy(sums)
    hx, hxy = entropy(px), entropy(p)
    independent = np.outer(px, px)
    hxy1 = float(-(p * np.log2(independent + LOG2_GUARD)).sum())
    gap = float(differences @ tone)
    # largest correlation between functions of the two tones: the second eigenvalue of the transition matrix
    values = np.sort(np.linalg.eigvals((p / (independent + 1e-13)) @ p.T).real)[::-1]
    return np.array(
        [
            float((p * p).sum()),
            float(differences @ tone**2),
            (float(tone @ p @ tone) - mean * mean) / spread if spread > 0 else 1.0,
            float(px @ (tone - mean) ** 2),
            float((p / (1 + (tone[:, None] - tone) ** 2)).sum()),
            float(sums @ np.arange(2 * n - 1)),
            float(sums @ (np.arange(2 * n - 1) - sum_entropy) ** 2),  # about the entropy, not the mean
            sum_entropy,
            hxy,
            float(differences @ tone**2) - gap * gap,
            entropy(differences),
            (hxy - hxy1) / hx if hx != 0 else 1.0,
            float(np.sqrt(abs(1 - np.exp(-2.0 * (entropy(independent) - hxy))))),
            float(np.sqrt(max(values[1], 0.0))) if n > 1 else 0.0,
        ]
    )


#: The fourteen statistics in the order in which descriptors list them.
HARALICK_ORDER = [0, 1, 2, 9, 10, 8, 11, 4, 13, 12, 5, 7, 6, 3]


@descriptor("Haralick Textures", 28)
def haralick(image: Image) -> np.ndarray:
    """Mean and range over four directions of the statistics of co-occurring tones (0 to 255, at distance 1); pixels of
    tone 0 don't count. The maximal correlation is the root of the second largest eigenvalue, 0 with one tone."""
    tones = np.floor(planes.to_8_bits(image.plane)).astype(np.int64)
    present, of = np.unique(tones, return_inverse=True)
    of, n = of.reshape(tones.shape), len(present)
    h, w = tones.shape
    rows = []
    for dy, dx in ((0, 1), (1, -1), (1, 0), (1, 1)):
        a = (slice(0, h - dy), slice(max(0, -dx), w - max(0, dx)))
        b = (slice(dy, h), slice(max(0, dx), w - max(0, -dx)))
        counts = (tones[a] > 0) & (tones[b] > 0)
        pairs = np.bincount(of[a][counts] * n + of[b][counts], minlength=n * n).reshape(n, n).astype(float)
        pairs += pairs.T
        rows.append(cooccurrence_statistics(pairs / pairs.sum() if pairs.sum() else pairs))
    stats = np.array(rows)[:, HARALICK_ORDER]
    return np.stack((stats.mean(axis=0), stats.max(axis=0) - stats.min(axis=0)), axis=1).ravel()


@descriptor("Multiscale Histograms", 24)
def multiscale(image: Image) -> np.ndarray:
    """Histograms of 3, 5, 7 and 9 bins over the largest count of all."""
    counts = np.concatenate([binned(image.plane, n) for n in (3, 5, 7, 9)])
    return counts / counts.max()


#: The two kernels of directionality as descriptors use them.
DIRECTION_H = np.array([[-1.0, 2.0, 1.0], [-2.0, 0.0, 2.0], [-1.0, -2.0, -1.0]])
DIRECTION_V = np.array([[1.0, 0.0, 0.0], [0.0, 0.0, 0.0], [-1.0, 0.0, 0.0]])
COARSE_STEPS = 7


def coarseness(v: np.ndarray) -> tuple[float, np.ndarray]:
    """The mean of each pixel's best scale, and a histogram of them."""
    h, w = v.shape
    total = np.pad(v.cumsum(axis=0).cumsum(axis=1), ((1, 0), (1, 0)))  # 0 before the first row and column
    yy, xx = np.arange(h)[:, None], np.arange(w)[None, :]
    gains = []
    for k in range(COARSE_STEPS):
        half = 1 << k
        top, left = np.maximum(yy - half, 0), np.maximum(xx - half, 0)
        low, right = np.minimum(yy + half - 1, h - 1), np.minimum(xx + half - 1, w - 1)
        # fixed behaviour: of a block only its first column is summed, from the plane's first row on where the block
        # begins there, else its last row alone; divided by the whole block's pixels
        above = np.where(top > 0, total[low, left + 1] - total[low, left], 0.0)
        mean = (total[low + 1, left + 1] - total[low + 1, left] - above) / ((low - top + 1) * (right - left + 1))
        for axis in (1, 0):
            gain = np.zeros((h, w))
            if mean.shape[axis] > 2 * half:
                inner = [slice(None)] * 2
                inner[axis] = slice(half, mean.shape[axis] - half)
                n = mean.shape[axis]
                gain[tuple(inner)] = np.abs(np.take(mean, range(2 * half, n), axis) - np.take(mean, range(0, n - 2 * half), axis))
            gains.append(gain)
    gains = np.array(gains)
    best = np.where(gains.max(axis=0) > 0, gains.argmax(axis=0) // 2 + 1, 0)
    # fixed behaviour: sides below 32 wrap as unsigned 32-bit numbers do
    area = (w + 1 - 32) * (h + 1 - 32) if 32 in (h, w) else (w - 32) * (h - 32)
    counts = binned(best, 3)
    return float(best.sum()) / (area % (1 << 32)), counts / counts.max()


def directionality(v: np.ndarray) -> float:
    across, down = planes.convolve(v, DIRECTION_H), planes.convolve(v, DIRECTION_V)
    steep = across >= 0.0001
    angle = np.where(steep, np.arctan(down / np.where(steep, across, 1.0)) + (np.pi / 2 + 0.001), 0.0)
    counts = binned(angle, 125)
    at = int(counts.argmax())
    spread = float(counts @ (np.arange(1, 126) - at) ** 2.0)
    weight = float((across**2 + down**2 + angle**2)[steep].sum())
    with np.errstate(all="ignore"):
        return float(abs(np.log(np.float64(spread) / weight + 0.0000001)))


@descriptor("Tamura Textures", 6)
def tamura(image: Image) -> np.ndarray:
    """Histogram of coarseness, contrast, directionality and mean coarseness; zeros where the maximum is 0. A plane
    without any direction has infinite directionality."""
    m = Moments.of(image.plane)
    if m.high == 0:
        return np.zeros(6)
    v = (image.plane - m.low) / m.high
    mean, counts = coarseness(v)
    s = Moments.of(v)
    contrast = s.std / (s.kurtosis / s.std**4) ** 0.25 if s.std >= np.finfo(float).eps and s.kurtosis > 0 else 0.0
    return np.array([*counts, contrast, directionality(v), mean])


COMB_SLOTS = 20


@descriptor("Comb Moments", 48)
def comb_moments(image: Image) -> np.ndarray:
    """Of lines in four directions at up to twenty places each: histograms of kurtosis, mean, skewness and deviation.
    Slots without a line hold 0, as do lines without pixels; moments that a line of equal values lacks fall into the last bin."""
    p = image.plane
    h, w = p.shape
    x, y = np.arange(w)[None, :] + np.zeros((h, 1), int), np.arange(h)[:, None] + np.zeros((1, w), int)
    step = max(h / 10.0, 1.0)
    places, at = [], 1.0 - h
    while at <= h and len(places) < COMB_SLOTS:
        places.append(int(np.floor(abs(at) + 0.5) * np.sign(at)))
        at += step
    out = []
    # horizontal, vertical, falling and rising lines: which one each pixel is on
    for line in (h // 2 - 1 - y, w // 2 - 1 - x, x - y, w - 1 - x - y):
        moments = np.zeros((COMB_SLOTS, 4))
        for k, place in enumerate(places):
            m = Moments.of(p[line == place])
            moments[k] = m.kurtosis, m.mean, m.skewness, m.std
        for column in moments.T:
            real = column[~np.isnan(column)]
            out.append(binned(column, 3, real.min(), real.max()) if len(real) else binned(column, 3, 0.0, 0.0))
    return np.concatenate(out)


@descriptor("Radon Coefficients", 12)
def radon(image: Image) -> np.ndarray:
    """Histograms of the projections at 0, 135, 45 and 90 degrees; each pixel is spread as four quarters over the two
    nearest places."""
    p = image.plane
    h, w = p.shape
    ox, oy = (w - 1) // 2, (h - 1) // 2
    reach = int(np.ceil(np.hypot(w - 1 - ox, h - 1 - oy))) + 1
    x = (np.arange(2 * w) * 0.5 - 0.25 - ox)[None, :]
    y = (np.arange(2 * h)[::-1] * 0.5 - 0.25 - oy)[:, None]
    quarters = np.repeat(np.repeat(p, 2, axis=0), 2, axis=1).ravel() * 0.25
    out = []
    for degrees in (0, 135, 45, 90):
        a = degrees * np.pi / 180
        place = (x * np.cos(a) + y * np.sin(a) + reach).ravel()
        low = place.astype(np.int64)
        part = quarters * (1 - place + low)
        size = 2 * reach + 1
        line = np.bincount(low, part, size + 1) + np.bincount(low + 1, quarters - part, size + 1)
        line = line[:size]
        out.append(binned(line, 3, line.min(), line.max()))
    return np.concatenate(out)


@descriptor("Fractal Features", 20)
def fractal(image: Image) -> np.ndarray:
    """Mean absolute difference at growing distances below a fifth of the shorter side; unused places hold 0."""
    p = image.plane
    h, w = p.shape
    far = min(h, w) // 5
    out = np.zeros(20)
    for at, k in enumerate(range(1, far, max(1, far // 20))):
        if at < 20:
            out[at] = (np.abs(p[k:] - p[:-k]).sum() + np.abs(p[:, k:] - p[:, :-k]).sum()) / (w * (w - k) + h * (h - k))
    return out


@descriptor("Pixel Intensity Statistics", 5)
def intensity(image: Image) -> np.ndarray:
    m = Moments.of(image.plane)
    return np.array([m.mean, float(np.median(image.plane)), m.std, m.low, m.high])


@descriptor("Gini Coefficient", 1)
def gini(image: Image) -> np.ndarray:
    """Of the positive pixels; 0 with fewer than two."""
    v = np.sort(image.plane[image.plane > 0])
    n = len(v)
    return np.array([float((2.0 * np.arange(1, n + 1) - n - 1) @ v / (v.mean() * n * (n - 1))) if n > 1 else 0.0])


@descriptor("Edge Features", 28)
def edges(image: Image) -> np.ndarray:
    """Pixels of more than the mean gradient; how directions and magnitudes are spread."""
    size, direction = planes.prewitt_magnitude(image.plane), planes.prewitt_direction(image.plane)
    s, d = Moments.of(size), Moments.of(direction)
    ways = binned(direction, 8)
    ahead, back = ways[:4], ways[4:]
    opposed = np.abs(ahead - back) / np.where(ahead + back != 0, ahead + back, 1.0)
    return np.array([float((size > s.mean).sum()), *opposed, *ways, (ways[0] + ways[1]) / ways.sum(), d.mean, float(np.median(direction)), d.var, *binned(size, 8), s.mean, float(np.median(size)), s.var])


def object_statistics(values: np.ndarray, flat: bool) -> tuple[np.ndarray, list[float]]:
    """Histogram of ten bins, and maximum, mean, upper median, minimum and variance; ``flat``: equal values have an
    empty histogram."""
    v = np.sort(values)
    counts = np.zeros(10) if flat and v[0] == v[-1] else binned(v, 10, v[0], v[-1])
    # of two values without their mean, whose rounding would decide values that end on halves
    var = float((v[1] - v[0]) ** 2 / 2 if len(v) == 2 else ((v - v.mean()) ** 2).sum() / max(len(v) - 1, 1))
    return counts, [float(v[-1]), float(v.mean()), float(v[len(v) // 2]), float(v[0]), var]


def object_features(plane: np.ndarray) -> np.ndarray:
    mask = planes.otsu_mask(plane)
    of = planes.labels(mask)
    n = int(of.max())
    if not n:
        return np.zeros(34)
    cx, cy = planes.centroid(mask)
    on = of > 0
    y, x = np.nonzero(on)
    areas = np.bincount(of[on], minlength=n + 1)[1:].astype(float)
    dx, dy = (np.bincount(of[on], v, n + 1)[1:] / areas + 1 - c for v, c in ((x, cx), (y, cy)))
    area_counts, area_values = object_statistics(areas, True)
    # each step rounds as the centroid's do, and squares are added as they are: so objects at one distance share a bin
    counts, values = object_statistics(np.sqrt(dx * dx + dy * dy), False)
    return np.array([*area_counts, *area_values, cx, cy, n, *counts, *values, planes.euler_number(mask)])


@descriptor("Otsu Object Features", 34)
def otsu_objects(image: Image) -> np.ndarray:
    """Areas and distances from the centroid of the connected groups above Otsu's threshold; zeros without any."""
    return object_features(image.plane)


@descriptor("Inverse-Otsu Object Features", 34)
def inverse_objects(image: Image) -> np.ndarray:
    """The same of the inverted plane."""
    return object_features(planes.invert(image.plane))


GABOR_SIDE, GABOR_SQUASH, GABOR_WIDTH, GABOR_LOW = 38, 0.5, 0.56, 0.1


@lru_cache(maxsize=16)
def gabor_filter(frequency: float) -> np.ndarray:
    t = np.arange(GABOR_SIDE) - GABOR_SIDE // 2
    theta = 3.14159265 / 2
    along = t[None, :] * np.cos(theta) + t[:, None] * np.sin(theta)
    across = t[:, None] * np.cos(theta) - t[None, :] * np.sin(theta)
    sigma = GABOR_WIDTH * 2 * np.pi / frequency
    g = np.exp(-(along**2 + (GABOR_SQUASH * across) ** 2) / (2 * sigma**2)) * np.exp(1j * along * frequency)
    return g / np.abs(g).sum()


def gabor_energy(spectrum: np.ndarray, shape: tuple[int, int], frequency: float) -> np.ndarray:
    full = np.fft.ifft2(spectrum * np.fft.fft2(gabor_filter(frequency), spectrum.shape))
    at = GABOR_SIDE // 2
    return np.abs(full[at : at + shape[0], at : at + shape[1]])


@descriptor("Gabor Textures", 7)
def gabor(image: Image) -> np.ndarray:
    """Pixels with high energy at seven frequencies over those at a low one; 0 where the plane has no energy."""
    p = image.plane
    spectrum = np.fft.fft2(p, (p.shape[0] + GABOR_SIDE - 1, p.shape[1] + GABOR_SIDE - 1))
    low = gabor_energy(spectrum, p.shape, GABOR_LOW)
    base = int((low > low.max() * 0.4).sum())
    out = np.zeros(7)
    for k in range(7 if base else 0):
        e = gabor_energy(spectrum, p.shape, float(k + 1))
        e = e / e.max() if e.max() > 0 else e
        out[k] = (e > planes.otsu(e)).sum() / base
    return out


@descriptor("Color Histogram", COLORS + 1)
def color_histogram(image: Image) -> np.ndarray:
    """Share of each fuzzy colour; needs a plane with colours and a table of rules."""
    if image.hsv is None or image.colors is None:
        raise ValueError("Color Histogram needs hue, saturation and value, and a table of colour rules")
    return np.bincount(image.colors.classify(image.hsv).ravel(), minlength=COLORS + 1) / image.plane.size
