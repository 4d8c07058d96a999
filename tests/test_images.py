"""Images, folders, reports, names, streams of images and the command line, on small files."""

from __future__ import annotations

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe import __main__ as cli
from lumenframe.functions.colors import rgb_to_gray, rgb_to_hsv
from lumenframe.operators import classify
from lumenframe.plans.features import FeaturePlan
from lumenframe.sources import files, folders, report, sinks, tiff
from lumenframe.streaming import live


def build(order, w, h, bits, samples, strips, rows, compression=1, predictor=1, extra=()):
    """A TIFF with the given strips."""
    entries = [(256, 4, [w]), (257, 4, [h]), (258, 3, [bits] * samples), (259, 3, [compression]), (262, 3, [2 if samples == 3 else 1]), (277, 3, [samples]), (278, 4, [rows]), (317, 3, [predictor]), *extra]
    body, offsets = b"", []
    for s in strips:
        offsets.append(8 + len(body))
        body += s
    entries += [(273, 4, offsets), (279, 4, [len(s) for s in strips])]
    entries.sort()
    at = 8 + len(body)
    tail, records = b"", b""
    for tag, kind, values in entries:
        raw = struct.pack(f"{order}{len(values)}{'H' if kind == 3 else 'I'}", *values)
        if len(raw) > 4:
            place = at + 2 + 12 * len(entries) + 4 + len(tail)
            tail += raw
            raw = struct.pack(order + "I", place)
        records += struct.pack(order + "HHI", tag, kind, len(values)) + raw.ljust(4, b"\0")
    head = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, at)
    return head + body + struct.pack(order + "H", len(entries)) + records + struct.pack(order + "I", 0) + tail


def lzw(data):
    """Codes of nine bits only: a new table after every 200 bytes."""
    codes = []
    for k, b in enumerate(data):
        if k % 200 == 0:
            codes.append(256)
        codes.append(b)
    bits = "".join(f"{c:09b}" for c in [*codes, 257])
    return int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")


def test_tiff_kinds():
    rng = np.random.default_rng(60)
    gray = rng.integers(0, 256, (7, 5))
    assert (tiff.decode(tiff.encode(gray.astype(float))).plane == gray).all()
    deep = rng.integers(0, 65536, (6, 9))
    p = tiff.decode(tiff.encode(deep.astype(float), 16))
    assert p.bits == 16 and (p.plane == deep).all()
    assert (tiff.decode(build(">", 9, 6, 16, 1, [deep[:4].astype(">u2").tobytes(), deep[4:].astype(">u2").tobytes()], 4)).plane == deep).all()
    rgb = rng.integers(0, 256, (4, 6, 3))
    p = tiff.decode(build("<", 6, 4, 8, 3, [rgb.astype("u1").tobytes()], 4))
    assert np.allclose(p.plane, rgb_to_gray(rgb)) and (p.hsv == rgb_to_hsv(rgb)).all()
    assert (tiff.decode(build("<", 5, 7, 8, 1, [lzw(gray.astype("u1").tobytes())], 7, compression=5)).plane == gray).all()
    steps = np.diff(gray.astype("u1"), axis=1, prepend=np.zeros((7, 1), "u1")).astype("u1")
    assert (tiff.decode(build("<", 5, 7, 8, 1, [lzw(steps.tobytes())], 7, compression=5, predictor=2)).plane == gray).all()
    packed = bytes([4]) + gray[0].astype("u1").tobytes() + bytes([128]) + bytes([257 - 5, 9])
    assert (tiff.decode(build("<", 5, 2, 8, 1, [packed], 2, compression=32773)).plane == [gray[0].tolist(), [9] * 5]).all()
    wide = rng.integers(0, 65536, (3, 4, 3))
    p = tiff.decode(build("<", 4, 3, 16, 3, [wide.astype("<u2").tobytes()], 3))
    small = np.floor((wide - wide.min()) * (255.0 / (wide.max() - wide.min())))
    assert (p.hsv == rgb_to_hsv(small)).all()
    for broken in (b"", b"II*\0", tiff.encode(gray.astype(float))[:-20], build("<", 5, 7, 4, 1, [b"x" * 35], 7), build("<", 5, 7, 8, 1, [b"x" * 3], 7), build("<", 5, 7, 8, 1, [b"x"], 7, compression=7)):
        with pytest.raises(ValueError):
            tiff.decode(broken)


def test_lzw_with_growing_codes():
    # the text of the format's own example: tables grow with repeats
    data = bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])
    codes = [256, 7, 258, 8, 8, 258, 6, 6, 257]
    bits = "".join(f"{c:09b}" for c in codes)
    assert tiff.unpack_lzw(int(bits.ljust(88, "0"), 2).to_bytes(11, "big")) == data


@pytest.fixture
def images(tmp_path):
    rng = np.random.default_rng(61)
    for name, low in (("dim", 0), ("lit", 120)):
        (tmp_path / "in" / name).mkdir(parents=True)
        for k in range(5):
            plane = low + rng.integers(0, 40, (24, 32)) + (20 * k if name == "lit" else 0)
            (tmp_path / "in" / name / f"{k}.tif").write_bytes(tiff.encode(plane.astype(float)))
    (tmp_path / "in" / "dim" / "0-l.sig").write_text("0\t4.2\nx\n")
    (tmp_path / "in" / "dim" / "notes.txt").write_text("no image")
    (tmp_path / "in" / "lit" / "bad.tif").write_bytes(b"II*\0broken")
    (tmp_path / "in" / ".hidden").mkdir()
    (tmp_path / "in" / ".hidden" / "9.tif").write_bytes(b"")
    return tmp_path


def test_folders_are_classes_and_images_are_planes(spark, images):
    root = f"file://{images}/in"
    got = {(r["label"], r["base"], r["class_idx"]) for r in folders.scan_folder(spark, root).collect()}
    assert got == {("dim", str(k), 1) for k in range(5)} | {("lit", str(k), 2) for k in range(5)} | {("lit", "bad", 2)}
    (images / "in" / "top.tif").write_bytes(tiff.encode(np.ones((2, 2))))
    assert [(r["label"], r["base"], r["class_idx"]) for r in folders.scan_folder(spark, root).collect()] == [(None, "top", 0)]
    rows = tiff.read_images(spark, root, crop=(1, 2, 8, 6), percent=50, mean=100.0, std=10.0).collect()
    good = [r for r in rows if r["error"] is None]
    assert {(r["height"], r["width"]) for r in good} == {(3, 4)} and sum(r["error"] is not None for r in rows) >= 2
    assert all(abs(np.mean(r["pix"]) - 100) < 1 for r in good)


def test_tiles_and_windows(spark):
    pix = [float(v) for v in range(7 * 10)]
    df = spark.createDataFrame([(1, 7, 10, pix)], "img long, height int, width int, pix array<double>")
    plane = np.array(pix).reshape(7, 10)
    tiles = {r["seq_id"]: r for r in tiff.tiles_of(df, 3, 2).collect()}
    assert len(tiles) == 6 and all((r["height"], r["width"]) == (3, 3) for r in tiles.values())
    assert tiles[3]["pix"] == plane[3:6, 3:6].ravel().tolist() and (tiles[3]["tile_col"], tiles[3]["tile_row"]) == (1, 1)
    windows = tiff.sliding_windows(df, 4, 3, 2, 2).collect()
    assert len(windows) == int((10 - 4) / 2) * int((7 - 3) / 2)
    for r in windows:
        assert r["pix"] == plane[r["y"] : r["y"] + 3, r["x"] : r["x"] + 4].ravel().tolist()
    assert [(r["x"], r["y"]) for r in sorted(windows, key=lambda r: r["seq_id"])][:3] == [(0, 0), (0, 2), (2, 0)]


def test_numbers_and_names_of_files(spark):
    assert [sinks.number(v, True) for v in (4023.0, 0.5, 1e-7, 123456789.5, float("nan"), None, -3.0, 1e300)] == ["4023", "0.5", "1e-07", "1.2345679e+08", "nan", "nan", "-3", "1e+300"]
    rows = [("a/img", None, None, None, None, 50, 100, 20, 2, 6, 5, 5, 4, True, True), ("b", 1, 2, 3, 4, None, 10, None, None, 2, 2, 0, 1, False, True), ("c", *[None] * 14)]
    df = spark.createDataFrame(rows, "basename string, x int, y int, w int, h int, downsample int, mean int, std int, rot int, tile_cols int, tile_rows int, tile_col int, tile_row int, color boolean, long boolean")
    named = df.withColumn("file", sinks.sig_name("basename"))
    names = [r["file"] for r in named.collect()]
    assert names == ["a/img-d50-S100_20-R_2-t6x5_5_4-c-l.sig", "b-B1_2_3_4-S10-t2_0_1-l.sig", "c.sig"]
    back = named.select(*[c.alias(k) for k, c in files.sampling_options(F.col("file")).items()]).collect()
    assert [tuple(r[c] for c in ("x", "downsample", "mean", "std", "rot", "tile_cols", "tile_rows", "tile_col", "tile_row", "color", "long")) for r in back][:2] == [(None, 50, 100, 20, 2, 6, 5, 5, 4, True, True), (1, None, 10, None, None, 2, 2, 0, 1, False, True)]


def matrices(spark):
    confusion = spark.createDataFrame([("a", "a", 3), ("a", "b", 1), ("b", "b", 4)], "gt string, pred string, n long")
    p = spark.createDataFrame([("a", "a", 0.7), ("a", "b", 0.3), ("b", "a", 0.2), ("b", "b", 0.8)], "gt string, cls string, p double")
    return confusion, p.withColumn("s", F.col("p") / 0.8), p


def test_matrices_reports_and_spaces(spark, tmp_path):
    confusion, similarity, probability = matrices(spark)
    sinks.write_matrices(f"file://{tmp_path}/tsv", confusion, similarity, probability)
    assert [r.value for r in spark.read.text(f"file://{tmp_path}/tsv/avg_confusion.tsv").collect()] == ["\ta\tb", "a\t3\t1", "b\t0\t4"]
    lines = sinks.phylip_lines(probability.selectExpr("gt AS a", "concat('some_long_', cls, '.') AS b", "p AS d").unionByName(probability.selectExpr("concat('some_long_', gt, '.') AS a", "cls AS b", "p AS d")))
    assert lines[0] == "4" and any(x.startswith("_long_a ") for x in lines)
    predictions = spark.createDataFrame([(0, "x<1>&", 1.5e-20, {"a": 0.75, "b": 0.25}, "a", "a", 1.25), (1, "y", 2.0, {"a": 0.5, "b": 0.5}, None, "b", None)], "split int, name string, norm_factor double, p map<string,double>, label string, predicted string, value double")
    report.write_report(report.report_lines("A & B", predictions, confusion, similarity, probability), f"file://{tmp_path}/report")
    got = {r["name"]: r for r in report.read_report(spark, f"file://{tmp_path}/report").collect()}
    assert got["x<1>&"]["p"] == {"a": 0.75, "b": 0.25} and got["x<1>&"]["norm_factor"] == 1.5e-20 and (got["x<1>&"]["label"], got["x<1>&"]["value"]) == ("a", 1.25)
    assert (got["y"]["split"], got["y"]["label"], got["y"]["predicted"], got["y"]["value"]) == (1, "UNKNOWN", "b", None)
    samples = spark.createDataFrame([(1, "a", [1.0, 2.0]), (2, None, [0.5, 3.0])], "sample_id long, label string, features array<double>")
    folders.save_space(samples, ["f", "g"], f"file://{tmp_path}/space", "4.2")
    again, names, version = folders.load_space(spark, f"file://{tmp_path}/space")
    assert (names, version, sorted(map(tuple, again.select("sample_id", "label").collect()))) == (["f", "g"], "4.2", [(1, "a"), (2, None)])
    assert report.summary(samples).splitlines() == ["Feature space: 2 samples, 2 features, 1 classes", "UNKNOWN\t1", "a\t1"]
    assert report.text_table(["\ta\tbb", "row\t1\t2"]) == "     a  bb\nrow  1  2"


def test_densities_and_masks(spark, tmp_path):
    rng = np.random.default_rng(62)
    v = rng.normal(size=200)
    df = spark.createDataFrame([("a", float(x)) for x in v], "label string, v double")
    got = sorted((r["x"], r["density"]) for r in sinks.kernel_density(df, "v", "label", 60).collect())
    h = v.std(ddof=1) * 200**-0.2
    for x, d in got[::7]:
        assert d == pytest.approx(np.exp(-(((x - v) / h) ** 2) / 2).sum() / 200 / h / np.sqrt(2 * np.pi))
    windows = spark.createDataFrame([(1, "a", 0, 0, 1.0), (1, "a", 1, 2, 0.5), (1, "b", 0, 1, 0.25)], "img long, cls string, y int, x int, p double")
    paths = {r["path"] for r in tiff.write_images(sinks.class_masks(windows, 3, 2), f"file://{tmp_path}/masks").collect()}
    assert len(paths) == 2
    assert tiff.decode((tmp_path / "masks" / "1_a.tif").read_bytes()).plane.tolist() == [[255, 0, 0], [0, 0, 127]]


def test_streams_of_images(spark, images):
    plan = FeaturePlan(["Pixel Intensity Statistics ()", "Gini Coefficient ()"])
    root, store = f"file://{images}/in", f"file://{images}/store"
    for _ in range(2):  # a second job on the same images adds nothing
        for name in ("dim", "lit"):
            q = live.keep_features(spark, f"{root}/{name}", store, plan, f"file://{images}/check-{name}-{_}", once=True)
            assert q.awaitTermination(120)
    rows = live.stored(spark, store)
    assert rows.count() == 10 == spark.read.parquet(store).count()
    samples = rows.select(F.xxhash64("source").alias("sample_id"), F.regexp_extract("source", "/(dim|lit)/", 1).alias("label"), F.lit(1.0).alias("value"), F.lit(0).cast("long").alias("grp"), F.lit(0).alias("seq"), "features")
    samples.write.parquet(f"file://{images}/samples")
    train = spark.read.parquet(f"file://{images}/samples")
    by = classify.model(train, 3)
    stream = spark.readStream.schema(train.schema).parquet(f"file://{images}/samples")
    q = live.classify_stream(stream, train, by, f"file://{images}/out", f"file://{images}/check-c", once=True)
    assert q.awaitTermination(120)
    got = {r["sample_id"]: r["predicted"] for r in spark.read.parquet(f"file://{images}/out").collect()}
    assert got == {r["sample_id"]: r["label"] for r in train.collect()}


def test_command_line(spark, images, capsys):
    root = f"file://{images}"
    (images / "in" / "lit" / "bad.tif").unlink()
    said = cli.main(["train", f"{root}/in", f"{root}/space"], spark)
    assert said.startswith("10 samples of 1059 features")
    assert cli.main(["test", f"{root}/space", f"{root}/report", "--top", "40"], spark).startswith("accuracy 1.0")
    assert report.read_report(spark, f"{root}/report").count() == 10
    cli.main(["classify", f"{root}/space", f"{root}/space", f"{root}/classes"], spark)
    assert spark.read.parquet(f"{root}/classes").where("predicted = 'lit'").select("source").distinct().count() == 5
    assert cli.main(["check", f"{root}/in", f"{root}/space"], spark).startswith("0 of 10")
    assert cli.diagnostics()["long plan with colours"] == "4059"
