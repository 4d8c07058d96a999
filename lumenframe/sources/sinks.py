"""Writers of the text formats: ``.fit`` and weights as one file each, ``.sig`` as one row of text per sample.

Numbers have eight significant digits as C's ``%.8g`` writes them; in a ``.fit`` whole numbers stay whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.plans.scratch import fresh


def number(v: float | None, whole: bool = False) -> str:
    if v is None:
        return "nan"
    return str(int(v)) if whole and v == v and abs(v) < 1 << 53 and v == int(v) else f"{v:.8g}"


def with_numbers(samples: DataFrame, name: str, whole: bool = False) -> DataFrame:
    """``samples`` with ``name``: their features as texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = b.column(b.schema.get_field_index("features")).to_pylist()
            texts = pa.array([None if v is None else [number(x, whole) for x in v] for v in values], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*b.columns, texts], names=[*b.schema.names, name])

    schema = samples.withColumn(name, F.array().cast("array<string>")).schema
    return samples.mapInArrow(run, schema)


def fit_text(samples: DataFrame, names: list[str], version: str = "4.2") -> DataFrame:
    """(value) the lines of a ``.fit`` file in order, from samples (source, label, features).

    Feature names and class labels go through the driver: they are the columns and classes of the space. Samples are
    streamed: the plan sorts them, and no task holds more than it is writing."""
    spark = samples.sparkSession
    labels = [r.label for r in samples.where("label is not null").select("label").distinct().orderBy("label").collect()]
    count = samples.count()
    head = [f"{len(labels)}\t{version}", str(len(names)), str(count), *names, "", *labels]
    top = spark.createDataFrame([(0, "", "", i, line) for i, line in enumerate(head)], "part int, label string, source string, at int, value string")
    index = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in labels]).cast("array<string>"), F.col("label")), F.lit(0)).cast("string")
    rows = with_numbers(samples.select("source", "label", "features"), "numbers", whole=True)
    text = F.concat_ws("\n", F.concat_ws(" ", "numbers", index), F.coalesce("source", F.lit("")))
    body = rows.select(F.lit(1).alias("part"), F.coalesce("label", F.lit("")).alias("label"), F.coalesce("source", F.lit("")).alias("source"), F.lit(0).alias("at"), text.alias("value"))
    return top.unionByName(body).orderBy("part", "label", "source", "at").select("value")


def write_fit(samples: DataFrame, names: list[str], path: str, version: str = "4.2") -> None:
    """One ``.fit`` file in the folder ``path``. The format is one file, so one task writes it, as a stream."""
    fit_text(samples, names, version).coalesce(1).write.mode("error").text(path)


def sig_text(samples: DataFrame, version: str = "4.2") -> DataFrame:
    """source, value: the whole ``.sig`` text of each sample (source, class_raw, names, features)."""
    rows = with_numbers(samples.select("source", "class_raw", "names", "features"), "numbers")
    lines = F.zip_with("numbers", "names", lambda v, n: F.concat_ws("\t", F.coalesce(v, F.lit("nan")), n))
    head = F.concat_ws("\t", F.coalesce("class_raw", F.lit("0")), F.lit(version))
    return rows.select("source", F.concat_ws("\n", head, F.coalesce("source", F.lit("")), F.concat_ws("\n", lines)).alias("value"))


def sig_name(base: Column | str) -> Column:
    """The file name of a sample from its options' columns, as ``sampling_options`` reads them: null ones are left out."""

    def part(mark: str, *fields: str, only: Column | None = None) -> Column:
        given = F.col(fields[0]).isNotNull() if only is None else only
        return F.when(given, F.concat(F.lit(mark), F.concat_ws("_", *[F.col(f).cast("string") for f in fields]))).otherwise("")

    cols, rows = F.col("tile_cols"), F.col("tile_rows")
    size = F.when(rows.isNull() | (rows == cols), cols.cast("string")).otherwise(F.concat(cols.cast("string"), F.lit("x"), rows.cast("string")))
    tiled = F.when(cols > 1, F.concat(F.lit("-t"), size, F.lit("_"), F.col("tile_col").cast("string"), F.lit("_"), F.col("tile_row").cast("string"))).otherwise("")
    marks = [F.when(F.coalesce(F.col(c), F.lit(False)), m).otherwise("") for c, m in (("color", "-c"), ("long", "-l"))]
    whole = F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("w").isNotNull() & F.col("h").isNotNull()
    shrunk = F.coalesce(F.col("downsample") > 0, F.lit(False))
    return F.concat(F.col(base) if isinstance(base, str) else base, part("-B", "x", "y", "w", "h", only=whole), part("-d", "downsample", only=shrunk), part("-S", "mean", "std"), part("-R_", "rot"), tiled, *marks, F.lit(".sig"))


def write_weights(weights: DataFrame, path: str) -> None:
    """``weight name`` per line with six decimals, heaviest first; ties by name."""
    rows = weights.where("weight is not null").orderBy(F.desc("weight"), "name")
    rows.select(F.format_string("%.6f %s", F.col("weight").cast("double"), F.col("name")).alias("value")).coalesce(1).write.mode("error").text(path)


# --- matrices of classes


def matrix_lines(matrix: DataFrame, row: str, column: str, value: str, pattern: str = "%.6f") -> list[str]:
    """Tab-separated lines of a matrix between classes, a head line first; the driver holds classes x classes numbers."""
    cells = {(r[row], r[column]): r[value] for r in matrix.select(row, column, value).collect()}
    names = sorted({n for pair in cells for n in pair})
    return ["\t".join(["", *names])] + ["\t".join([n, *(pattern % (cells.get((n, m)) or 0) for m in names)]) for n in names]


def write_lines(spark, lines: list[str], path: str) -> None:
    spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "at int, value string").orderBy("at").select("value").coalesce(1).write.mode("error").text(path)


def write_matrices(path: str, confusion: DataFrame, similarity: DataFrame, probability: DataFrame) -> None:
    """Three tab-separated tables (gt, pred, n), (gt, cls, s) and (gt, cls, p) in folders below ``path``."""
    spark = confusion.sparkSession
    write_lines(spark, matrix_lines(confusion, "gt", "pred", "n", "%d"), f"{path}/avg_confusion.tsv")
    write_lines(spark, matrix_lines(similarity, "gt", "cls", "s"), f"{path}/avg_similarity.tsv")
    write_lines(spark, matrix_lines(probability, "gt", "cls", "p"), f"{path}/avg_class_prob.tsv")


def phylip_lines(distances: DataFrame, a: str = "a", b: str = "b", d: str = "d") -> list[str]:
    """A distance matrix for tree builders: the number of classes, then each name (its last eight characters, an ending
    that is neither letter nor digit cut off) and its distances."""
    cells = {(r[a], r[b]): r[d] for r in distances.select(a, b, d).collect()}
    names = sorted({n for pair in cells for n in pair})
    out = [str(len(names))]
    for n in names:
        short = n[-8:]
        short = short if short[-1:].isalnum() else short[:-1]
        out.append(f"{short}{' ' * 17}" + "".join(f"{max(cells.get((n, m)) or 0.0, 0.0):.4f}       " for m in names))
    return out


# --- for plots and masks


def kernel_density(rows: DataFrame, value: str, by: str, points: int = 100) -> DataFrame:
    """by, x, density: a Gaussian kernel estimate of each group's values at even steps between all values' extremes."""
    spread = rows.agg(F.min(value).alias("low"), F.max(value).alias("high"))
    stats = rows.groupBy(by).agg(F.stddev_samp(value).alias("sd"), F.count(value).alias("n"))
    grid = spread.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.col("low") + (F.col("high") - F.col("low")) * i / (points - 1))).alias("x"))
    wide = F.col("sd") * F.pow("n", F.lit(-0.2))
    held = rows.where(F.col(value).isNotNull()).join(stats, by).crossJoin(F.broadcast(grid))  # ``points`` numbers
    u = (F.col("x") - F.col(value)) / wide
    return held.groupBy(by, "x").agg((F.sum(F.exp(-u * u / 2)) / F.first("n") / F.first(wide) / F.sqrt(F.lit(2.0) * F.pi())).alias("density"))


def class_masks(windows: DataFrame, width: int, height: int) -> DataFrame:
    """name, height, width, pix: of each image and class a plane whose pixel for a window is its probability as a byte;
    ``windows``: img, cls, y, x (places of the window in the grid), p."""
    cells = windows.groupBy("img", "cls").agg(F.map_from_entries(F.collect_list(F.struct((F.col("y") * width + F.col("x")).cast("int").alias("at"), F.floor(F.col("p") * 255).cast("double").alias("v")))).alias("m"))  # one image's windows
    pix = F.transform(F.sequence(F.lit(0), F.lit(width * height - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)))
    return cells.select(F.concat_ws("_", F.col("img").cast("string"), "cls").alias("name"), F.lit(height).alias("height"), F.lit(width).alias("width"), pix.alias("pix"))
