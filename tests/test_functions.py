"""Descriptors, transforms, colours, names and distributions against plain loops and defining properties."""

from __future__ import annotations

import math

import numpy as np
import pytest

from lumenframe.functions import colors, names, planes, special, transforms
from lumenframe.functions.descriptors import DESCRIPTORS, Image, descriptor
from lumenframe.plans.features import FeaturePlan, compute, planes_of

RULES = """
red 0 0 0 11
blue 120 160 160 200
red 220 240 240 240
// red grey dark black
red grey dark black
red clear light red
blue clear light blue
blue grey tend_light light_grey
"""


def plane(h=12, w=9, seed=1):
    return np.floor(np.random.default_rng(seed).random((h, w)) * 255)


def run(name, p, **kw):
    return DESCRIPTORS[name].run(Image(np.asarray(p, float), **kw))


def counts(values, n):
    low, high = min(values), max(values)
    out = [0] * n
    for v in values:
        out[min(int((v - low) * (n / (high - low))), n - 1) if high > low else 0] += 1
    return out


def test_widths_and_edge_planes():
    assert [FeaturePlan.short().width, FeaturePlan.long().width, FeaturePlan.short(True).width, FeaturePlan.long(True).width] == [1059, 2919, 2199, 4059]
    assert FeaturePlan.long().version == "4.2" and FeaturePlan(["Gini Coefficient ()"]).version == "4.0"
    for p in (np.zeros((8, 8)), np.full((9, 7), 5.0), np.zeros((1, 1)), np.arange(3.0)[None], np.arange(30.0).reshape(30, 1), -plane(20, 20), plane(40, 33)):
        for name, d in DESCRIPTORS.items():
            if name != "Color Histogram":
                v = d.run(Image(p))
                assert len(v) == d.width and not np.isnan(v).any(), name
    with pytest.raises(ValueError):
        run("Color Histogram", plane())


def test_chebyshev_coefficients_by_loops():
    p = plane(7, 5)

    def t(n, k, x):
        return math.cos(k * math.acos(max(-1, min(1, 2 * (x + 1) / n - 1)))) * (1 if k == 0 else 2) / (2 * n)

    want = [[sum(p[y, x] * t(5, a, x) * t(7, b, y) for y in range(7) for x in range(5)) for b in range(5)] for a in range(5)]
    assert np.allclose(transforms.chebyshev(Image(p)), want)
    assert list(run("Chebyshev Coefficients", p)) == counts([v for r in want for v in r], 32)


def test_zernike_of_a_turned_plane_is_the_same():
    p = plane(21, 21)
    assert np.allclose(run("Zernike Coefficients", p), run("Zernike Coefficients", np.rot90(p)))
    assert np.allclose(run("Zernike Coefficients", p), run("Zernike Coefficients", 3 * p))
    # the first moment is the share of mass within the disc over pi
    assert run("Zernike Coefficients", np.pad([[1.0]], 6))[0] == 0  # the centre itself doesn't count
    assert run("Zernike Coefficients", np.ones((9, 9)))[0] == pytest.approx(80 / 81 / math.pi)


def test_chebyshev_fourier_by_loops():
    p = plane(9, 8)
    h, w = p.shape
    order = min(11, (min(h, w) - 1) // 2)
    sizes = []
    for m in range(-order, order + 1):
        for n in range(2 * order + 1):
            total = 0j
            for y in range(h):
                for x in range(w):
                    u, v = -1 + 2 * x / (w - 1), -1 + 2 * y / (h - 1)
                    r = math.hypot(u, v)
                    if r < 1:
                        total += p[y, x] * (0.5 if m == 0 else 1) * (0.5 if n == 0 else math.cos(n * math.acos(2 * r - 1))) * np.exp(1j * m * math.atan2(v, u))
            sizes.append(abs(total))
    assert list(run("Chebyshev-Fourier Coefficients", p)) == counts(sizes, 32)


def test_haralick_by_loops():
    p = plane(10, 11) // 40
    t = np.floor((p - p.min()) * (255 / (p.max() - p.min()))).astype(int)
    tones = sorted(set(t.ravel()))
    first, rng = [], []
    for dy, dx in ((0, 1), (1, -1), (1, 0), (1, 1)):
        m = np.zeros((len(tones),) * 2)
        for y in range(10):
            for x in range(11):
                if 0 <= x + dx < 11 and y + dy < 10 and t[y, x] and t[y + dy, x + dx]:
                    a, b = tones.index(t[y, x]), tones.index(t[y + dy, x + dx])
                    m[a, b] += 1
                    m[b, a] += 1
        m /= m.sum()
        n = len(tones)
        cell = [(i, j, m[i, j]) for i in range(n) for j in range(n)]
        mean = sum(i * v for i, _, v in cell)
        first.append((sum(v * v for *_, v in cell), sum((i - j) ** 2 * v for i, j, v in cell), sum(v / (1 + (i - j) ** 2) for i, j, v in cell), sum((i + j) * v for i, j, v in cell), sum((i - mean) ** 2 * v for i, _, v in cell), -sum(v * math.log2(v + 1e-9) for *_, v in cell)))
    first = np.array(first)
    got = run("Haralick Textures", p)
    for k, at in enumerate((0, 1, 7, 10, 13, 5)):
        assert got[2 * at] == pytest.approx(first[:, k].mean()) and got[2 * at + 1] == pytest.approx(np.ptp(first[:, k])), at


def test_comb_and_radon_by_loops():
    p = plane(20, 14)
    h, w = p.shape
    got = run("Comb Moments", p)
    places = [1 - h + k * h / 10 for k in range(20)]
    lines = [[p[y, x] for y in range(h) for x in range(w) if y == h // 2 - 1 - round(m)] for m in places]
    means = [float(np.mean(v)) if v else 0.0 for v in lines]
    sds = [float(np.std(v, ddof=1)) if len(v) > 2 else 0.0 for v in lines]
    assert list(got[3:6]) == counts(means, 3) and list(got[9:12]) == counts(sds, 3) and (got.reshape(16, 3).sum(axis=1) == 20).all()
    ox, oy = (w - 1) // 2, (h - 1) // 2
    reach = math.ceil(math.hypot(w - 1 - ox, h - 1 - oy)) + 1
    line = [0.0] * (2 * reach + 1)
    for y in range(2 * h):
        for x in range(2 * w):
            at = 0.5 * (2 * h - 1 - y) - 0.25 - oy + reach  # at 90 degrees
            low = int(at)
            line[low] += p[y // 2, x // 2] * 0.25 * (1 - at + low)
            line[low + 1] += p[y // 2, x // 2] * 0.25 * (at - low)
    assert list(run("Radon Coefficients", p)[9:12]) == counts([round(v, 9) for v in line], 3)


def test_edges_objects_and_thresholds_by_loops():
    p = plane(11, 13)
    h, w = p.shape

    def at(y, x):
        return p[y, x] if 0 <= y < h and 0 <= x < w else 0.0

    for y in range(h):
        for x in range(w):
            gx = sum(at(y + k, x - 1) - at(y + k, x + 1) for k in (-1, 0, 1))
            gy = sum(at(y - 1, x + k) - at(y + 1, x + k) for k in (-1, 0, 1))
            assert planes.prewitt_magnitude(p)[y, x] == pytest.approx(math.hypot(gx, gy))
            assert planes.prewitt_direction(p)[y, x] == pytest.approx(math.atan2(gy, gx) if gy else 3.1415926 * (gx < 0))
            e = 0.0
            if 0 < y < h - 1:
                e = max(abs(p[y, x] - p[y - 1, x]), abs(p[y, x] - p[y + 1, x]))
            if 0 < x < w - 1:
                e = max(e, abs(p[y, x] - p[y, x - 1]), abs(p[y, x] - p[y, x + 1]))
            assert planes.edge(p)[y, x] == e
    # Otsu: no other cut parts the pixels better
    t = planes.otsu(p)

    def between(c):
        a, b = p[p > c], p[p <= c]
        return len(a) * len(b) * (a.mean() - b.mean()) ** 2 if len(a) and len(b) else 0

    assert between(t) >= 0.999 * max(between(c) for c in range(256))
    mask = np.array([[1, 0, 0, 1], [0, 1, 0, 0], [0, 0, 0, 1], [1, 1, 0, 1]], bool)
    assert planes.labels(mask).tolist() == [[1, 0, 0, 2], [0, 1, 0, 0], [0, 0, 0, 3], [4, 4, 0, 3]]
    assert planes.labels(mask, corners=False).max() == 5 and planes.labels(np.zeros((3, 3), bool)).max() == 0
    assert planes.labels(np.ones((40, 40), bool)).max() == 1
    assert planes.centroid(mask) == (pytest.approx(11 / 7 + 1), pytest.approx(12 / 7 + 1))
    f = run("Otsu Object Features", p)
    assert f[17] == planes.labels(planes.otsu_mask(p)).max() and f[:10].sum() in (0, f[17]) and f[18:28].sum() == f[17]


def test_tamura_coarseness_of_stripes():
    fine, coarse = (np.tile(np.repeat([0.0, 200.0], k), (64, 64 // (2 * k))) for k in (1, 8))
    a, b = run("Tamura Textures", fine), run("Tamura Textures", coarse)
    assert a[0:3].max() == b[0:3].max() == 1 and b[5] > a[5]
    assert run("Tamura Textures", plane(40, 40))[3] == pytest.approx((lambda v: v.std(ddof=1) / ((((v - v.mean()) ** 4).mean() / v.var() ** 2) / v.std(ddof=1) ** 4) ** 0.25)((plane(40, 40) - plane(40, 40).min()) / plane(40, 40).max()))


def test_gabor_counts_strong_pixels():
    x = np.arange(60)[:, None] + np.zeros((1, 60))
    v = run("Gabor Textures", 100 + 100 * np.sin(2.0 * x))
    assert (v >= 0).all() and v.argmax() in (0, 1, 2)
    assert (run("Gabor Textures", np.zeros((12, 12))) == 0).all()


def test_transforms_by_their_properties():
    p = plane(15, 12)
    f = transforms.fourier(Image(p))
    assert f[0, 0] == pytest.approx(p.sum()) and (f**2).sum() == pytest.approx(p.size * (p**2).sum()) and f[1, 2] == pytest.approx(f[-1, -2])
    v = transforms.wavelet(Image(p))
    assert v.shape == (2 * ((15 + 9) // 2), 2 * ((12 + 9) // 2)) and (v**2).sum() == pytest.approx((p**2).sum())
    flat = transforms.wavelet(Image(np.full((40, 40), 3.0)))
    assert np.allclose(flat[6:20, 6:20], 0, atol=1e-9) and np.allclose(flat[30:38, 30:38], 6.0)  # no details within, twice the value
    assert (transforms.apply("no such transform", Image(p)).plane == p).all()
    d = planes.downsample(np.arange(16.0).reshape(4, 4), 0.5, 0.5)
    assert d.tolist() == [[2.5, 4.5], [10.5, 12.5]]
    assert planes.downsample(p, 0.75, 0.6).shape == (9, 9) and planes.downsample(np.ones((10, 7)), 0.3, 0.7) == pytest.approx(1.0)
    assert planes.rotate(np.array([[1.0, 2.0], [3.0, 4.0]]), 1).tolist() == [[3, 1], [4, 2]]
    assert planes.crop(p, 1, 2, 4, 6).shape == (5, 4) and (planes.invert(p) == p.max() - p + p.min()).all()
    assert planes.Moments.of(planes.set_mean(p, 100, 20)).mean == pytest.approx(100, abs=2)
    assert planes.scale_to_range(np.array([0.0, 5, 10, 20]), 5, 15, 100).tolist() == [0, 0, 50, 100]
    assert planes.to_8_bits(p).max() == 255
    taps = np.arange(9.0).reshape(3, 3)
    c = planes.convolve(p, taps)
    assert c[3, 3] == pytest.approx(sum(taps[j, i] * p[2 + j, 2 + i] for j in range(3) for i in range(3)))


def test_colors():
    rng = np.random.default_rng(3)
    rgb = rng.integers(0, 256, (50, 3))
    hsv = colors.rgb_to_hsv(rgb)
    import colorsys

    for c, got in zip(rgb, hsv, strict=True):
        h, s, v = colorsys.rgb_to_hsv(*(c / 255))
        assert abs(h * 240 - got[0]) < 1.01 or got[1] == 0
        assert abs(s * 240 - got[1]) < 1.01 and abs(v * 240 - got[2]) < 1.01
    assert np.abs(colors.hsv_to_rgb(hsv) - rgb).max() <= 14
    assert colors.rgb_to_gray(np.array([10, 20, 30])) == pytest.approx(2.989 + 11.74 + 3.42)
    table = colors.ColorTable.read(RULES)
    assert len(table.hues) == 3 and len(table.rules) == 4
    probe = np.array([[[0, 0, 0], [235, 240, 240], [160, 240, 240], [90, 100, 100], [160, 0, 180]]])
    assert table.classify(probe).tolist() == [[4, 5, 17, 2, 2]]
    h = run("Color Histogram", np.zeros((1, 5)), hsv=probe, colors=table)
    assert h[2] == 0.4 and h.sum() == 1
    assert transforms.color(Image(np.zeros((1, 5)), probe, table))[0, 0] == int(255 * 4 / 19)
    assert transforms.hue(Image(np.zeros((1, 5)), probe)).tolist() == [[0, 235, 160, 90, 160]]
    s = colors.color_statistics(probe, table)
    assert s["commonest"] == 2 and s["mean"][0] == 129


def test_names():
    f = names.parse(" Haralick Textures  (Fourier  ( Wavelet (DAPI) ))  [ 3 ]")
    assert f == names.Feature("Haralick Textures", ("Wavelet", "Fourier"), "DAPI", 3) and f.name == "Haralick Textures (Fourier (Wavelet (DAPI))) [3]"
    assert names.parse("Gini Coefficient ()") == names.Feature("Gini Coefficient", (), "", 0)
    assert names.parse("Plain name") == names.Feature("Plain name", ()) and names.parse("CombFirst [2]").index == 2
    assert names.parse("old", names.read_legacy("  old\tEdge Features () [4]\n1x\ty\n")).name == "Edge Features () [4]"
    with pytest.raises(ValueError):
        names.parse("A (B (C) [1]")


def test_distributions():
    assert special.binomial_tail(10, 8, 0.5) == pytest.approx(56 / 1024) and special.binomial_tail(3, 0, 0.1) == 1
    assert special.binomial_tail(5000, 4000, 0.1) < 1e-300 or special.binomial_tail(5000, 4000, 0.1) == 0
    assert special.choose(52, 5) == pytest.approx(2598960)
    assert special.t_two_sided(2.228138852, 10) == pytest.approx(0.05) and special.t_two_sided(1, 1) == pytest.approx(0.5)
    assert special.t_density(0, 1) == pytest.approx(1 / math.pi)
    assert special.correlation_p(0.0, 30) == pytest.approx(1) and special.correlation_p(1.0, 30) == 0 and math.isnan(special.correlation_p(0.3, 2))


def test_plans_share_transforms_and_take_plug_ins(spark):
    seen = []

    @descriptor("Test Sum", 1)
    def total(image):
        return np.array([image.plane.sum()])

    @transforms.transform("Test Twice")
    def twice(image):
        seen.append(1)
        return image.plane * 2

    try:
        p = FeaturePlan(["Test Sum ()", "Test Sum (Test Twice ())", "Pixel Intensity Statistics (Test Twice ())", "Test Sum ()"])
        assert p.run(Image(np.ones((2, 3)))).tolist() == [6, 12, 2, 2, 0, 2, 2] and len(seen) == 1
        assert p.names[:3] == ["Test Sum () [0]", "Test Sum (Test Twice ()) [0]", "Pixel Intensity Statistics (Test Twice ()) [0]"]
    finally:
        DESCRIPTORS.pop("Test Sum")
        transforms.TRANSFORMS.pop("Test Twice")
    with pytest.raises(ValueError):
        FeaturePlan(["No Such Thing ()"])
    of = FeaturePlan.of_features(["Gini Coefficient () [0]", "Edge Features (Fourier ()) [3]", "Edge Features (Fourier ()) [1]"])
    assert of.width == 29
    df = spark.createDataFrame([(1, [float(x) for x in range(64)]), (2, None), (3, [1.0] * 63)], "sample_id long, features array<double>")
    rows = {r["sample_id"]: r["features"] for r in compute(planes_of(df), of).collect()}
    assert rows[1] == pytest.approx(of.run(Image(np.arange(64.0).reshape(8, 8)))) and rows[2] is None and rows[3] is None
    assert of.feature_dict(spark).count() == 29
