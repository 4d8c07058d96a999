"""TIFF images as planes, and planes as TIFF, without an image library.

Read: one image a file, 8 or 16 bits, one sample (gray) or three (red, green, blue) to a pixel, in strips or tiles,
uncompressed, LZW or PackBits, with or without horizontal differences, either byte order. Three samples of 8 bits become
gray and HSV; of 16 bits they are scaled to bytes by the least and largest of all three first.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions import planes
from lumenframe.functions.colors import rgb_to_gray, rgb_to_hsv

# The format's types (bytes of one, its code) and the tags that are read.
TYPES = {1: "B", 2: "c", 3: "H", 4: "I", 16: "Q"}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, ROWS, COUNTS, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILES, TILE_COUNTS = 322, 323, 324, 325


@dataclass(frozen=True)
class Picture:
    plane: np.ndarray
    bits: int
    hsv: np.ndarray | None = None


def unpack_bits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        elif n > 128:
            out += data[at + 1 : at + 2] * (257 - n)
            at += 2
        else:
            at += 1
    return bytes(out)


def unpack_lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bits first; 256 begins a new table, 257 ends."""
    bits = int.from_bytes(data, "big")
    total = 8 * len(data)
    at, width = 0, 9
    table: list[bytes] = []
    out, last = [], b""
    while at + width <= total:
        code = bits >> total - at - width & (1 << width) - 1
        at += width
        if code == 256:
            table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
            continue
        if code == 257:
            break
        if not last:
            piece = table[code]
        else:
            piece = table[code] if code < len(table) else last + last[:1]
            table.append(last + piece[:1])
        out.append(piece)
        last = piece
        if len(table) >= (1 << width) - 1 and width < 12:
            width += 1
    return b"".join(out)


def tags_of(data: bytes) -> tuple[str, dict[int, list[int]]]:
    """Byte order, and the values of the one directory."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if not order or len(data) < 8 or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise ValueError("no TIFF")
    (at,) = struct.unpack(order + "I", data[4:8])
    (n,) = struct.unpack_from(order + "H", data, at)
    tags = {}
    for k in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
        if kind not in TYPES or kind == 2:
            continue
        size = struct.calcsize(TYPES[kind]) * count
        place = at + 10 + 12 * k if size <= 4 else struct.unpack_from(order + "I", data, at + 10 + 12 * k)[0]
        tags[tag] = list(struct.unpack_from(f"{order}{count}{TYPES[kind]}", data, place))
    if struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]:
        raise ValueError("more than one image in the file")
    return order, tags


def decode(data: bytes) -> Picture:
    """Raises ``ValueError`` for anything but the kinds that are read."""
    try:
        order, tags = tags_of(data)
        return _decode(data, order, tags)
    except (struct.error, IndexError, KeyError) as e:
        raise ValueError(f"broken TIFF: {e!r}") from e


def _decode(data: bytes, order: str, tags: dict[int, list[int]]) -> Picture:
    w, h = tags[WIDTH][0], tags[HEIGHT][0]
    bits, samples = tags.get(BITS, [1])[0], tags.get(SAMPLES, [1])[0]
    if bits not in (8, 16) or samples not in (1, 3) or not w or not h:
        raise ValueError(f"{bits} bits and {samples} samples to a pixel aren't read")
    packing = tags.get(COMPRESSION, [1])[0]
    unpack = {1: bytes, 5: unpack_lzw, 32773: unpack_bits}.get(packing)
    if unpack is None:
        raise ValueError(f"compression {packing} isn't read")
    planar = tags.get(PLANAR, [1])[0] == 2 and samples > 1
    tiled = TILES in tags
    bw, bh = (tags[TILE_WIDTH][0], tags[TILE_HEIGHT][0]) if tiled else (w, min(tags.get(ROWS, [h])[0], h))
    offsets, counts = (tags[TILES], tags[TILE_COUNTS]) if tiled else (tags[STRIPS], tags.get(COUNTS) or [len(data)])
    per = 1 if planar else samples
    kind = np.dtype(order + ("u1" if bits == 8 else "u2"))
    out = np.zeros((h, w, samples), kind.newbyteorder("="))
    across, down = -(-w // bw), -(-h // bh)
    for k, (at, n) in enumerate(zip(offsets, counts, strict=True)):
        sample, block = divmod(k, across * down) if planar else (slice(None), k)
        y, x = block // across * bh, block % across * bw
        rows = bh if tiled else min(bh, h - y)
        values = np.frombuffer(unpack(data[at : at + n]), kind)[: rows * bw * per]
        if len(values) < rows * bw * per:
            raise ValueError("image data cut short")
        values = values.reshape(rows, bw, per).astype(out.dtype)
        if tags.get(PREDICTOR, [1])[0] == 2:
            values = np.cumsum(values, axis=1, dtype=out.dtype)
        part = values[: h - y, : w - x]
        out[y : y + part.shape[0], x : x + part.shape[1], sample] = part[..., 0] if planar else part
    if tags.get(PHOTOMETRIC, [1])[0] == 0 and samples == 1:  # white is 0
        out = (2**bits - 1) - out
    if samples == 1:
        return Picture(out[..., 0].astype(float), bits)
    rgb = out.astype(float)
    if bits == 16:
        low, high = rgb.min(), rgb.max()
        rgb = np.floor((rgb - low) * (255.0 / (high - low))) if high > low else np.zeros(rgb.shape)
    return Picture(rgb_to_gray(rgb), bits, rgb_to_hsv(rgb))


def encode(plane: np.ndarray, bits: int = 8) -> bytes:
    """Gray, uncompressed, one strip; values are cut to whole numbers of the range."""
    kind = "<u1" if bits == 8 else "<u2"
    raw = np.clip(np.floor(plane), 0, 2**bits - 1).astype(kind).tobytes()
    h, w = plane.shape
    entries = [(WIDTH, 4, w), (HEIGHT, 4, h), (BITS, 3, bits), (COMPRESSION, 3, 1), (PHOTOMETRIC, 3, 1), (STRIPS, 4, 8), (SAMPLES, 3, 1), (ROWS, 4, h), (COUNTS, 4, len(raw)), (PLANAR, 3, 1)]
    pad = len(raw) % 2
    directory = struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHII", tag, t, 1, v) for tag, t, v in entries) + struct.pack("<I", 0)
    return struct.pack("<2sHI", b"II", 42, 8 + len(raw) + pad) + raw + b"\0" * pad + directory


def prepared(p: Picture, crop: tuple[int, int, int, int] | None = None, percent: int = 0, mean: float = 0.0, std: float = 0.0) -> Picture:
    """Cropped to (x, y, width, height), downsampled to a percentage, shifted to a mean and deviation, in this order."""
    plane, hsv = p.plane, p.hsv
    if crop and crop[0] >= 0:
        x, y, w, h = crop
        plane = planes.crop(plane, x, y, x + w - 1, y + h - 1)
        hsv = hsv[y : y + h, x : x + w] if hsv is not None else None
    if 0 < percent < 100:
        r = percent / 100.0
        plane = planes.downsample(plane, r, r)
        hsv = np.floor(np.stack([planes.downsample(hsv[..., k].astype(float), r, r) for k in range(3)], axis=-1)).astype(np.int64) if hsv is not None else None
    if mean > 0:
        plane = planes.set_mean(plane, mean, std, p.bits)
    return Picture(plane, p.bits, hsv)


IMAGES = "height int, width int, bits int, pix array<double>, hsv array<int>, error string"


def decoded(texts: DataFrame, crop: tuple[int, int, int, int] | None = None, percent: int = 0, mean: float = 0.0, std: float = 0.0) -> DataFrame:
    """path and IMAGES' columns of (path, content): a file that can't be read has an ``error`` and no pixels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):  # an image is a batch of its own
                row: tuple = (None, None, None, None, None)
                error = None
                try:
                    p = prepared(decode(b.column(1)[k].as_py() or b""), crop, percent, mean, std)
                    row = (*p.plane.shape, p.bits, p.plane.ravel(), None if p.hsv is None else p.hsv.ravel())
                except ValueError as e:
                    error = str(e)
                kinds = [pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.int32())]
                cols = [pa.array([v], t) for v, t in zip(row, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(k, 1), *cols, pa.array([error], pa.string())], names=["path", "height", "width", "bits", "pix", "hsv", "error"])

    return texts.select("path", "content").mapInArrow(run, "path string, " + IMAGES)


def read_images(spark: SparkSession, path: str | list[str], **how) -> DataFrame:
    """Every ``.tif`` or ``.tiff`` in ``path`` and below; ``how``: see ``prepared``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return decoded(files.where(F.lower("path").rlike(r"\.tiff?$")), **how)


def write_images(images: DataFrame, folder: str, bits: int = 8) -> DataFrame:
    """Writes (name, height, width, pix) as ``folder``/name.tif, each whole or not at all; the paths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        for b in batches:
            names = b.column(0).to_pylist()
            for k, name in enumerate(names):
                plane = np.array(b.column(3)[k].as_py(), float).reshape(b.column(1)[k].as_py(), b.column(2)[k].as_py())
                hidden = f"{base}/.{name}.{uuid.uuid4().hex}"
                with fs.open_output_stream(hidden) as f:
                    f.write(encode(plane, bits))
                fs.move(hidden, f"{base}/{name}.tif")
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{n}.tif" for n in names])], names=["path"])

    return images.select("name", "height", "width", "pix").mapInArrow(run, "path string")


def tiles_of(images: DataFrame, cols: int, rows: int) -> DataFrame:
    """``images`` (height, width, pix, ...) cut into cols x rows tiles of equal whole size, what is left over at the right
    and below left out: the other columns, tile_col, tile_row, seq_id (tile_col * rows + tile_row)."""
    out = images.withColumn("tile_col", F.explode(F.sequence(F.lit(0), F.lit(cols - 1)))).withColumn("tile_row", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))))
    w, h = F.floor(F.col("width") / cols).cast("int"), F.floor(F.col("height") / rows).cast("int")
    return windows_cut(out, F.col("tile_col") * w, F.col("tile_row") * h, w, h).withColumn("seq_id", F.col("tile_col") * rows + F.col("tile_row"))


def sliding_windows(images: DataFrame, w: int, h: int, dx: int, dy: int) -> DataFrame:
    """Windows of w x h pixels at steps of dx and dy: the other columns, x, y, seq_id. As many along each axis as
    whole steps fit between the first window and the border, the window at the very end left out."""
    across, down = F.floor((F.col("width") - w) / dx).cast("int"), F.floor((F.col("height") - h) / dy).cast("int")
    rows = images.where((F.col("width") >= w + dx) & (F.col("height") >= h + dy))
    rows = rows.withColumn("seq_id", F.explode(F.sequence(F.lit(0), across * down - 1)))
    rows = rows.withColumns({"x": (F.floor(F.col("seq_id") / down) * dx).cast("int"), "y": (F.pmod("seq_id", down) * dy).cast("int")})
    return windows_cut(rows, F.col("x"), F.col("y"), F.lit(w), F.lit(h))


def windows_cut(rows: DataFrame, x, y, w, h) -> DataFrame:
    """Each row's plane cut to w x h pixels at (x, y)."""
    old = F.col("width")
    pix = F.flatten(F.transform(F.sequence(F.lit(0), h - 1), lambda k: F.slice("pix", (y + k) * old + x + 1, w)))
    names = [c for c in rows.columns if c not in ("pix", "height", "width")]
    sized = rows.select(*names, "height", "width", pix.alias("pix"))  # before the sizes that it reads change
    return sized.select(*names, h.cast("int").alias("height"), w.cast("int").alias("width"), "pix")
