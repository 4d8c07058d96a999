"""Plans of descriptors over planes, and their execution in one pass.

A plan is a list of groups ``Algorithm (Transform (... ()))``. Transforms that several groups share are computed once
for an image. The whole plan is one ``mapInArrow`` over rows (sample_id, height, width, pix, and hsv where there are
colours), so an image is read once and Catalyst never sees thousands of columns; a task holds one batch of images and
the transforms of one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lumenframe.functions import transforms
from lumenframe.functions.colors import ColorTable
from lumenframe.functions.descriptors import DESCRIPTORS, Image
from lumenframe.functions.names import Feature, parse

# The groups of algorithms that standard plans are made of.
OBJECTS = ["Edge Features", "Otsu Object Features", "Inverse-Otsu Object Features", "Gabor Textures"]
POLYNOMIALS = ["Chebyshev-Fourier Coefficients", "Chebyshev Coefficients", "Zernike Coefficients"]
TEXTURES = ["Comb Moments", "Haralick Textures", "Multiscale Histograms", "Tamura Textures", "Radon Coefficients", "Fractal Features", "Pixel Intensity Statistics", "Gini Coefficient"]
# The transforms of the long plan in their order, and whether polynomials are taken of them.
LONG = [("Fourier ()", True), ("Wavelet ()", True), ("Chebyshev ()", True), ("Chebyshev (Fourier ())", False), ("Wavelet (Fourier ())", False), ("Fourier (Wavelet ())", True), ("Fourier (Chebyshev ())", False), ("Chebyshev (Wavelet ())", False), ("Edge ()", True), ("Fourier (Edge ())", True), ("Wavelet (Edge ())", True)]
COLOR = ["Color Transform ()", "Hue ()", "Fourier (Hue ())", "Chebyshev (Hue ())"]
# The algorithms of the short plan in their order, each with its transforms.
FOUR = ["", "Chebyshev ()", "Chebyshev (Fourier ())", "Fourier ()"]
SIX = [*FOUR, "Wavelet ()", "Wavelet (Fourier ())"]
SHORT = {
    "Chebyshev-Fourier Coefficients": ["", "Fourier ()"],
    "Chebyshev Coefficients": ["", "Fourier ()"],
    "Comb Moments": SIX,
    "Edge Features": [""],
    "Otsu Object Features": [""],
    "Inverse-Otsu Object Features": [""],
    "Gabor Textures": [""],
    "Haralick Textures": SIX,
    "Multiscale Histograms": SIX,
    "Radon Coefficients": FOUR,
    "Tamura Textures": SIX,
    "Zernike Coefficients": ["", "Fourier ()"],
}


class FeaturePlan:
    """Groups in order; ``add`` takes one more and ``names`` numbers all features."""

    def __init__(self, groups: Iterable[str] = ()):
        self.groups: list[Feature] = []
        for g in groups:
            self.add(g)

    def add(self, group: str) -> FeaturePlan:
        g = parse(group)
        if g.algorithm not in DESCRIPTORS:
            raise ValueError(f"no descriptor is named {g.algorithm!r}")
        g = Feature(g.algorithm, g.transforms, g.channel)
        if g not in self.groups:
            self.groups.append(g)
        self.__dict__.pop("names", None)
        return self

    @classmethod
    def of_features(cls, names: Iterable[str]) -> FeaturePlan:
        """The plan whose groups hold the features named."""
        return cls(parse(n).group for n in names)

    @classmethod
    def short(cls, color: bool = False) -> FeaturePlan:
        out = cls(f"{a} ({t})" for a, ts in SHORT.items() for t in ts)
        return out.add_color() if color else out

    @classmethod
    def long(cls, color: bool = False) -> FeaturePlan:
        out = cls(f"{a} ()" for a in OBJECTS + POLYNOMIALS + TEXTURES)
        if color:
            out.add_color()
        for t, polynomials in LONG:
            for a in POLYNOMIALS * polynomials + TEXTURES:
                out.add(f"{a} ({t})")
        return out

    def add_color(self) -> FeaturePlan:
        self.add("Color Histogram ()")
        for t in COLOR:
            for a in POLYNOMIALS + TEXTURES:
                self.add(f"{a} ({t})")
        return self

    @property
    def width(self) -> int:
        return sum(DESCRIPTORS[g.algorithm].width for g in self.groups)

    @cached_property
    def names(self) -> list[str]:
        return [Feature(g.algorithm, g.transforms, g.channel, i).name for g in self.groups for i in range(DESCRIPTORS[g.algorithm].width)]

    @property
    def version(self) -> str:
        """Of the standard plans, by their width; 0 stands for any other."""
        return f"4.{ {1059: 1, 2919: 2, 2199: 3, 4059: 4}.get(self.width, 0) }"

    def run(self, image: Image) -> np.ndarray:
        """All features of one image."""
        done: dict[tuple[str, ...], Image] = {(): image}

        def transformed(chain: tuple[str, ...]) -> Image:
            if chain not in done:
                done[chain] = transforms.apply(chain[-1], transformed(chain[:-1]))
            return done[chain]

        return np.concatenate([DESCRIPTORS[g.algorithm].run(transformed(g.transforms)) for g in self.groups]) if self.groups else np.empty(0)

    def feature_dict(self, spark) -> DataFrame:
        """fidx, name, algorithm, transforms (in the order in which they are applied), channel, idx."""
        rows = [(i, n, f.algorithm, list(f.transforms), f.channel, f.index) for i, n in enumerate(self.names) for f in [parse(n)]]
        return spark.createDataFrame(rows, "fidx int, name string, algorithm string, transforms array<string>, channel string, idx int")


def compute(images: DataFrame, plan: FeaturePlan, colors: ColorTable | None = None) -> DataFrame:
    """The columns of ``images`` (which has height, width, pix: values row by row, and hsv: three to a pixel, if there are
    colours) but the pixels, and ``features``. Null or empty pixels, or such that don't fill the plane: null."""
    kept = [c for c in images.columns if c not in ("pix", "hsv", "features")]
    kind = T.StructType([images.schema[c] for c in kept] + [T.StructField("features", T.ArrayType(T.DoubleType()))])
    has_colors = "hsv" in images.columns

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = to_arrow_schema(kind)
        for b in batches:
            column = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            made = []
            for k in range(b.num_rows):
                h, w, pix = column["height"][k].as_py(), column["width"][k].as_py(), column["pix"][k]
                values = np.asarray(pix.values.to_numpy(zero_copy_only=False), float) if pix.is_valid else np.empty(0)
                if not h or not w or len(values) != h * w:
                    made.append(None)
                    continue
                hsv = np.array(column["hsv"][k].as_py(), np.int64).reshape(h, w, 3) if has_colors and column["hsv"][k].is_valid else None
                made.append(plan.run(Image(values.reshape(h, w), hsv, colors)).tolist())
            cols = [column[n].cast(out.field(n).type) for n in kept] + [pa.array(made, out.field("features").type)]
            yield pa.RecordBatch.from_arrays(cols, schema=out)

    return images.mapInArrow(go, kind)


def planes_of(df: DataFrame, features: str = "features", width: int = 8) -> DataFrame:
    """Vectors as planes of ``width`` columns: the other columns of ``df``, height, width and pix."""
    return df.withColumns({"height": (F.size(features) / width).cast("int"), "width": F.lit(width), "pix": F.col(features)}).drop(features)
