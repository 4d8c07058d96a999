import pytest

from lumenframe.sources import files, sinks
from lumenframe.streaming import ingest

FIT = "2\t4.2\n3\n4\nAlpha () [0]\nAlpha () [1]\nBeta () [0]\n\nhigh_2\nlow_1\n1 2 3.5 1\na.tif\n4 5 6 2\nb.tif\nnan -1e3 x 2\nc.tif\n7 8 9 0\nd.tif\n"


def put(path, text):
    path.write_bytes(text.encode())
    return f"file://{path}"


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_fit_rows(spark, tmp_path, end):
    got = files.read_fit(spark, put(tmp_path / "x.fit", FIT.replace("\n", end))).orderBy("sample_ord").collect()
    assert [(r.source, r.class_idx, r.label, r.value) for r in got] == [("a.tif", 1, "high_2", 2.0), ("b.tif", 2, "low_1", 1.0), ("c.tif", 2, "low_1", 1.0), ("d.tif", 0, None, None)]
    assert got[0].features == [1.0, 2.0, 3.5] and got[2].features[1:] == [-1000.0, None] and got[2].features[0] != got[2].features[0]


def test_fit_heads_and_continuous_values(spark, tmp_path):
    at = put(tmp_path / "x.fit", "0\t4.2\n1\n2\nA () [0]\n\n5 0.25\na\n6 -7.5\nb\n")
    assert [(r.value, r.label, r.features) for r in files.read_fit(spark, at, discrete=False).orderBy("sample_ord").collect()] == [(0.25, None, [5.0]), (-7.5, None, [6.0])]
    head = files.fit_heads(files.whole_texts(spark, put(tmp_path / "y.fit", FIT))).first()
    assert (head.version, head.num_classes, head.num_features, head.num_samples) == ("4.2", 2, 3, 4) and head.labels == ["high_2", "low_1"] and head["names"] == ["Alpha () [0]", "Alpha () [1]", "Beta () [0]"]


def test_what_is_no_fit_is_left_out(spark, tmp_path):
    for i, text in enumerate(["", "2 4.2\n", "two 4.2\n3\n4\n", "1 2 3\n1\n1\n"]):
        put(tmp_path / f"{i}.fit", text)
    assert files.read_fit(spark, f"file://{tmp_path}").count() == 0


def test_fit_round_trip(spark, tmp_path):
    one = files.read_fit(spark, put(tmp_path / "x.fit", FIT)).where("source <> 'c.tif'")
    sinks.write_fit(one.select("source", "label", "features"), ["Alpha () [0]", "Alpha () [1]", "Beta () [0]"], f"file://{tmp_path}/out")
    two = files.read_fit(spark, f"file://{tmp_path}/out")
    key = lambda df: sorted((r.source, r.class_idx, r.label or "", r.features) for r in df.collect())
    assert key(one) == key(two)


def test_sig_rows_and_round_trip(spark, tmp_path):
    name = "img_sj-05-3362-R2_001_E-t6x5_5_4-l.sig"
    at = put(tmp_path / name, "2\t4.1\n./img.tif\n4023\tEdge () [0]\n0.5\tEdge () [1]\n")
    assert [(r.ord, r.name, r.value, r.source, r.class_raw, r.version) for r in files.read_sig(spark, at).orderBy("ord").collect()] == [(0, "Edge () [0]", 4023.0, "./img.tif", "2", "4.1"), (1, "Edge () [1]", 0.5, "./img.tif", "2", "4.1")]
    r = files.sig_samples(files.whole_texts(spark, at)).first()
    assert (r.basename, r.tile_cols, r.tile_rows, r.tile_col, r.tile_row, r.long, r.color, r.rot) == ("img_sj-05-3362-R2_001_E", 6, 5, 5, 4, True, False, None)
    text = sinks.sig_text(files.sig_samples(files.whole_texts(spark, at))).first().value
    assert text == "2\t4.2\n./img.tif\n4023\tEdge () [0]\n0.5\tEdge () [1]"


def test_sig_without_version(spark, tmp_path):
    assert files.read_sig(spark, put(tmp_path / "a.sig", "1\nimg.tif\n3\tA () [0]\n")).first().version == "1.0"


def test_weights_both_ways(spark, tmp_path):
    rows = spark.createDataFrame([(0.25, "B () [1]"), (1.5, "A () [0]"), (None, "C () [0]")], "weight double, name string")
    sinks.write_weights(rows, f"file://{tmp_path}/w")
    got = files.read_weights(spark, f"file://{tmp_path}/w").orderBy("name").collect()
    assert [(r.name, r.weight) for r in got] == [("A () [0]", 1.5), ("B () [1]", 0.25)]


def test_file_lists(spark, tmp_path):
    at = put(tmp_path / "a.fof", "# comment\nx/1.tif\tdose 2.5\nx/2.tif\n\n")
    assert [(r["sample"], r.label, r.value) for r in files.read_file_list(spark, at).orderBy("sample").collect()] == [("x/1.tif", "dose 2.5", 2.5), ("x/2.tif", "UNKNOWN", None)]
    at = put(tmp_path / "b.fof", "s1\tCLL\t./a.tif\t{long=True;tile_num_cols=5}\t./b.tif{red}\t{blue}\n")
    got = files.read_channel_list(spark, at).orderBy("fs_col").collect()
    assert [(r.fs_col, r.path, r.opts) for r in got] == [(0, "./a.tif", {"long": "True", "tile_num_cols": "5"}), (1, "./b.tif", {"channel": "red"}), (2, "./b.tif", {"channel": "blue"})]


def test_statistics_of_a_stream_equal_those_of_the_batch(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(6):
        put(folder / f"{i}.sig", f"{i % 2}\t4.2\nimg{i}.tif\n{i * i}\tA () [0]\n{'nan' if i == 3 else i}\tB () [0]\n")
    q = ingest.keep_statistics(ingest.stream_sig(spark, f"file://{folder}", files_per_trigger=2), f"file://{tmp_path}/out", f"file://{tmp_path}/check", once=True)
    assert q.awaitTermination(120)
    newest = max((p for p in (tmp_path / "out").iterdir()), key=lambda p: int(p.name.split("=")[1]))
    key = lambda df: sorted((r.class_raw, r.name, r.n, r.low, r.high, round(r["mean"], 9), round(r["var"], 9)) for r in df.collect())
    assert key(spark.read.parquet(f"file://{newest}")) == key(ingest.column_statistics(files.read_sig(spark, f"file://{folder}")))
