"""Colours: conversions between RGB and HSV (each of 0 to 240), and fuzzy colour classes.

A colour class is the one whose rules hold most: each rule names a hue, a saturation and a value, and holds as much as
the product of their memberships. Which rules there are is a parameter (``ColorTable.read``).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

# Names of the colour classes in their order, from 1.
CLASSES = ["white", "light_grey", "dark_grey", "black", "red", "pink", "dark_brown", "light_brown", "dark_orange", "light_orange", "yellow", "olive", "light_green", "dark_green", "teal", "aqua", "blue", "dark_fucia", "light_fucia"]
COLORS = len(CLASSES)
NONE = CLASSES.index("light_grey") + 1
# Start, maximum and end of each degree of saturation, and of each degree of value.
SATURATIONS = {"grey": (-0.1, 0, 40), "almost_grey": (10, 30, 70), "tend_grey": (30, 70, 120), "medium_grey": (60, 120, 180), "tend_clear": (120, 180, 240), "clear": (180, 240, 240.1)}
VALUES = {"dark": (-0.1, 0, 60), "almost_dark": (0, 60, 120), "tend_dark": (60, 120, 180), "tend_light": (120, 180, 240), "light": (200, 240, 240.1)}


def rgb_to_hsv(rgb: np.ndarray) -> np.ndarray:
    """Of ... x 3 bytes, each of the three cut to whole numbers of 0 to 240."""
    c = np.asarray(rgb, float) / 255
    high, low = c.max(axis=-1), c.min(axis=-1)
    gap = high - low
    value = np.floor(high * 240.0)
    saturation = np.floor(np.where(high > 0, gap / np.where(high > 0, high, 1.0), 0.0) * 240.0)
    r, g, b = c[..., 0], c[..., 1], c[..., 2]
    d = np.where(gap > 0, gap, 1.0)
    sector = np.where(r == high, (g - b) / d, np.where(g == high, 2 + (b - r) / d, 4 + (r - g) / d))
    degrees = sector * 60.0
    degrees = np.where(degrees >= 360, degrees - 360, np.where(degrees < 0, degrees + 360, degrees))
    hue = np.where(saturation == 0, 0.0, np.floor(degrees * (240.0 / 360.0)))
    return np.stack((hue, saturation, value), axis=-1).astype(np.int64)


def hsv_to_rgb(hsv: np.ndarray) -> np.ndarray:
    h, s, v = (np.asarray(hsv, float)[..., k] for k in range(3))
    s, v = s / 240, v / 240
    turn = h * (360.0 / 240.0)
    turn = np.where(turn == 360, 0.0, turn) / 60
    sector = np.floor(turn).astype(np.int64)
    f = turn - sector
    p, q, t = v * (1 - s), v * (1 - s * f), v * (1 - s * (1 - f))
    parts = [(v, t, p), (q, v, p), (p, v, t), (p, q, v), (t, p, v), (v, p, q)]
    out = np.stack([np.choose(np.clip(sector, 0, 5), [x[k] for x in parts]) for k in range(3)], axis=-1)
    return np.floor(out * 255).astype(np.int64)


def rgb_to_gray(rgb: np.ndarray) -> np.ndarray:
    return np.asarray(rgb, float) @ np.array([0.2989, 0.5870, 0.1140])


def triangle(x: np.ndarray, start: float, top: float, end: float) -> np.ndarray:
    """0 outside, 1 at the top, straight lines between."""
    up, down = (x - start) / (top - start), 1 - (x - top) / (end - top)
    return np.where((x < start) | (x > end), 0.0, np.where(x < top, up, down))


def trapezium(x: np.ndarray, start: float, low: float, high: float, end: float) -> np.ndarray:
    up = (x - start) / (low - start) if low > start else np.ones(np.shape(x))
    down = 1 - (x - high) / (end - high) if end > high else np.ones(np.shape(x))
    return np.where((x < start) | (x > end), 0.0, np.where(x < low, up, np.where(x > high, down, 1.0)))


@dataclass(frozen=True)
class ColorTable:
    """Hue functions (name, start, both ends of the top, end; several of one name count in order, the first that holds)
    and rules (hue, saturation, value, colour class)."""

    hues: tuple[tuple[str, float, float, float, float], ...]
    rules: tuple[tuple[str, str, str, str], ...]

    @classmethod
    def read(cls, text: str) -> ColorTable:
        """Lines of five fields are hue functions, lines of four are rules; other lines don't count."""
        hues, rules = [], []
        for line in text.splitlines():
            x = line.split()
            if len(x) == 5 and not line.lstrip().startswith("//"):
                hues.append((x[0], *map(float, x[1:])))
            elif len(x) == 4 and x[3] in CLASSES:
                rules.append(tuple(x))
        return cls(tuple(hues), tuple(rules))

    def memberships(self, hsv: np.ndarray) -> np.ndarray:
        """... x (COLORS + 1): how far each class holds."""
        h, s, v = (np.asarray(hsv, float)[..., k] for k in range(3))
        hue: dict[str, np.ndarray] = {}
        for name, *corners in self.hues:
            new = trapezium(h, *corners)
            hue[name] = np.where(hue[name] > 0, hue[name], new) if name in hue else new
        out = np.zeros((*h.shape, COLORS + 1))
        for a, b, c, name in self.rules:
            out[..., CLASSES.index(name) + 1] += hue[a] * triangle(s, *SATURATIONS[b]) * triangle(v, *VALUES[c])
        return out

    def classify(self, hsv: np.ndarray) -> np.ndarray:
        """The class that holds most, the first of several; light grey where none does."""
        m = self.memberships(hsv)
        return np.where(m.max(axis=-1) > 0, m.argmax(axis=-1), NONE)


def color_statistics(hsv: np.ndarray, table: ColorTable) -> dict[str, object]:
    """Mean and deviation of hue, saturation and value, the share of each class, and the commonest one."""
    flat = np.asarray(hsv, float).reshape(-1, 3)
    shares = np.bincount(table.classify(flat), minlength=COLORS + 1) / len(flat)
    sd = flat.std(axis=0, ddof=1) if len(flat) > 1 else np.zeros(3)
    return {"mean": flat.mean(axis=0), "std": sd, "shares": shares, "commonest": int(shares.argmax())}
