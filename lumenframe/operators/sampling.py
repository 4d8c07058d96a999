"""Samples of images, channels and names: what stands between images and a feature space."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sample_suffix(rotation: Column, tile_cols: int, tile_rows: int, col: Column, row: Column, color: bool = False, long: bool = False) -> Column:
    """What a sample's name says of how it was taken: rotation, tile, colour and long set."""
    out = [F.when(rotation > 0, F.concat(F.lit("-R_"), rotation.cast("string"))).otherwise("")]
    if tile_cols > 1 or tile_rows > 1:
        size = str(tile_cols) if tile_cols == tile_rows else f"{tile_cols}x{tile_rows}"
        out += [F.lit(f"-t{size}_"), col.cast("string"), F.lit("_"), row.cast("string")]
    out.append(F.lit("-c" * color + "-l" * long))
    return F.concat(*out)


def sampling_product(images: DataFrame, rotations: int = 1, tile_cols: int = 1, tile_rows: int = 1, color: bool = False, long: bool = False) -> DataFrame:
    """``images`` with rot, tile_col, tile_row and name: a row for each rotation and tile of each image."""

    def upto(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    rows = images.withColumn("rot", upto(rotations)).withColumn("tile_col", upto(tile_cols)).withColumn("tile_row", upto(tile_rows))
    return rows.withColumn("name", sample_suffix(F.col("rot"), tile_cols, tile_rows, F.col("tile_col"), F.col("tile_row"), color, long))


def missing_samples(expected: DataFrame, store: DataFrame, *keys: str, width: int | None = None) -> DataFrame:
    """Rows of ``expected`` whose keys no row of ``store`` has, with as many features as ``width`` says; nothing is deleted."""
    if width is not None:
        store = store.where(F.size("features") == width)
    return expected.join(store.select(*keys).distinct(), list(keys), "left_anti")


def stack_channels(rows: DataFrame, features: str = "features", by: tuple[str, ...] = ("grp",), column: str = "seq") -> DataFrame:
    """The keys ``by``, columns (how many channels were stacked) and ``features``: channels in the order of ``column``."""
    wide = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(column, features))).alias("parts"))  # as many as an image has channels
    return wide.select(*by, F.size("parts").alias("columns"), F.flatten(F.transform("parts", lambda p: p[features])).alias(features))


def channel_name(name: Column, column: Column) -> Column:
    """A feature's name with its channel in the innermost brackets."""
    return F.regexp_replace(name, r"\(\)", F.concat(F.lit("("), column.cast("string"), F.lit(")")))


def legacy_names(names: DataFrame, legacy: DataFrame) -> DataFrame:
    """``names`` (name) with new names (old, new) where there are any. Both are dictionaries, and Spark picks the join."""
    return names.join(legacy, names["name"] == legacy["old"], "left").select(*[c for c in names.columns if c != "name"], F.coalesce("new", "name").alias("name"))


def rgb_columns(r: Column, g: Column, b: Column) -> dict[str, Column]:
    """gray, h, s, v of bytes: hue, saturation and value are whole numbers of 0 to 240."""
    gray = 0.2989 * r + 0.5870 * g + 0.1140 * b
    r, g, b = r / 255.0, g / 255.0, b / 255.0
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    gap = high - low
    s = F.floor(F.when(high > 0, gap / high).otherwise(0.0) * 240.0)
    sector = F.when(r == high, (g - b) / gap).when(g == high, 2 + (b - r) / gap).otherwise(4 + (r - g) / gap)
    degrees = sector * 60.0
    degrees = F.when(degrees >= 360, degrees - 360).when(degrees < 0, degrees + 360).otherwise(degrees)
    h = F.when(s == 0, 0).otherwise(F.floor(degrees * (240.0 / 360.0)))
    return {"gray": gray, "h": h.cast("int"), "s": s.cast("int"), "v": F.floor(high * 240.0).cast("int")}
