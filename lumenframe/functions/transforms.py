"""Transforms from plane to plane; ``@transform`` adds another. A name that isn't known leaves the plane as it is."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from lumenframe.functions import planes
from lumenframe.functions.colors import COLORS
from lumenframe.functions.descriptors import Image, chebyshev_coefficients

TRANSFORMS: dict[str, Callable[[Image], np.ndarray]] = {}


def transform(name: str):
    """Registers a function of an ``Image`` that gives a plane."""

    def add(run: Callable[[Image], np.ndarray]) -> Callable[[Image], np.ndarray]:
        TRANSFORMS[name] = run
        return run

    return add


def apply(name: str, image: Image) -> Image:
    """The transformed plane; colours don't outlive a transform."""
    if name not in TRANSFORMS:
        return image
    return Image(np.ascontiguousarray(TRANSFORMS[name](image), float))


@transform("Fourier")
def fourier(image: Image) -> np.ndarray:
    """Magnitudes of the discrete Fourier transform, neither shifted nor scaled."""
    return np.abs(np.fft.fft2(image.plane))


@transform("Chebyshev")
def chebyshev(image: Image) -> np.ndarray:
    return chebyshev_coefficients(image.plane, min(image.plane.shape))


# The low-pass taps of the symlet with five vanishing moments.
SYMLET_LOW = np.array([0.027333068345077982, 0.029519490925774643, -0.039134249302383094, 0.1993975339773936, 0.72340769040242059, 0.63397896345821192, 0.016602105764522319, -0.17532808990845047, -0.021101834024758855, 0.019538882735286728])
#: The mirrored filter.
SYMLET_HIGH = SYMLET_LOW[::-1] * (-1.0) ** np.arange(1, 11)


def halved(plane: np.ndarray, taps: np.ndarray, axis: int) -> np.ndarray:
    """Convolution along an axis, 0 beyond the border, every second value kept."""
    n = plane.shape[axis]
    out = np.zeros([n + len(taps) - 1 if a == axis else s for a, s in enumerate(plane.shape)])
    for k, tap in enumerate(taps):
        part = [slice(None)] * 2
        part[axis] = slice(k, k + n)
        out[tuple(part)] += tap * plane
    keep = [slice(None)] * 2
    keep[axis] = slice(1, None, 2)
    return out[tuple(keep)]


@transform("Wavelet")
def wavelet(image: Image) -> np.ndarray:
    """One level of the symlet transform: details of both axes above left, the approximation below right. Of the other two
    blocks the one above is of details along x, the one on the left of details along y."""
    low, high = (halved(image.plane, t, 0) for t in (SYMLET_LOW, SYMLET_HIGH))
    blocks = [[halved(part, t, 1) for t in (SYMLET_HIGH, SYMLET_LOW)] for part in (high, low)]
    (high_high, high_low), (low_high, low_low) = blocks
    return np.block([[high_high, low_high], [high_low, low_low]])


@transform("Edge")
def edge(image: Image) -> np.ndarray:
    return planes.edge(image.plane)


def colors_of(image: Image) -> np.ndarray:
    if image.hsv is None:
        raise ValueError("the plane has no colours")
    return image.hsv


@transform("Color")
def color(image: Image) -> np.ndarray:
    """The number of the colour class, spread over 0 to 255."""
    if image.colors is None:
        raise ValueError("Color needs a table of colour rules")
    return np.floor(255.0 * image.colors.classify(colors_of(image)) / COLORS)


@transform("Hue")
def hue(image: Image) -> np.ndarray:
    return colors_of(image)[..., 0].astype(float)
