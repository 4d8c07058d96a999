"""Text formats of feature spaces as DataFrames: ``.sig``, ``.fit``, weights and file-of-files.

Every reader is a plan over (path, value) rows, so it takes a batch of files and a stream of them alike. A ``.sig`` or
``.fit`` file is one row of whole text, cut by index arithmetic; a weights file or file-of-files is read by line.

Lines may end in CR LF. A broken number becomes null and the row stays, so a bad file shows up instead of ending a job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sampling options in a file name, in the order they stand there; fixed values of the format.
OPTIONS = (
    ("bounds", r"-B(\d+)_(\d+)_(\d+)_(\d+)", ("x", "y", "w", "h")),
    ("downsample", r"-d(\d+)", ("downsample",)),
    ("shift", r"-S(\d+)(?:_(\d+))?", ("mean", "std")),
    ("rotation", r"-R_?(\d)", ("rot",)),
    ("tiles", r"-t(\d+)(?:x(\d+))?_(\d+)_(\d+)", ("tile_cols", "tile_rows", "tile_col", "tile_row")),
)
NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"


def whole_texts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, value): whole files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def lines_of(value: Column) -> Column:
    return F.split(value, "\r?\n", -1)


def version_of(first_line: Column) -> Column:
    """``major.minor`` behind the first word; a file without one is 1.0."""
    found = F.regexp_extract(first_line, r"^\s*\S+\s+(\d+\.\d+)\s*$", 1)
    return F.when(found == "", "1.0").otherwise(found)


def is_fit(value: Column) -> Column:
    """Whether the first line holds one or two plain numbers and at least two lines follow."""
    lines = lines_of(value)
    return F.coalesce((F.size(lines) >= 3) & F.element_at(lines, 1).rlike(rf"^\s*{NUMBER}(?:\s+{NUMBER})?\s*$"), F.lit(False))


def sampling_options(path: Column) -> dict[str, Column]:
    """What the file name says: crop, downsampling, shift, rotation, tile, colour and long set."""
    name = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?i)\.(sig|tiff?|ppm)$", "")
    # the suffix starts at the first option; what comes before is the image's name
    suffix = F.regexp_extract(name, r"((?:-(?:B\d+_\d+_\d+_\d+|d\d+|S\d+(?:_\d+)?|R_?\d|t\d+(?:x\d+)?_\d+_\d+|c|l|cl|lc))+)$", 1)
    out = {"basename": F.substr(name, F.lit(1), F.char_length(name) - F.char_length(suffix))}
    for _, pattern, fields in OPTIONS:
        for i, field in enumerate(fields, 1):
            out[field] = F.regexp_extract(suffix, pattern, i).try_cast("int")
    # one number of tiles stands for both directions
    out["tile_rows"] = F.coalesce(out["tile_rows"], out["tile_cols"])
    out["color"] = suffix.rlike(r"-(?:c|cl|lc)(?:-|$)")
    out["long"] = suffix.rlike(r"-(?:l|cl|lc)(?:-|$)")
    return out


def sig_rows(texts: DataFrame) -> DataFrame:
    """path, source, class_raw, version, ord (from 0), name, value of (path, value) whole ``.sig`` texts."""
    lines = lines_of(F.col("value"))
    head = texts.select("path", F.trim(F.get(lines, F.lit(1))).alias("source"), F.regexp_extract(F.get(lines, F.lit(0)), r"^\s*(\S+)", 1).alias("class_raw"), version_of(F.get(lines, F.lit(0))).alias("version"), F.filter(F.slice(lines, 3, F.greatest(F.size(lines), F.lit(1))), lambda x: F.trim(x) != "").alias("_rest"))
    rows = head.select("path", "source", "class_raw", "version", F.posexplode("_rest").alias("ord", "_line"))
    return rows.select("path", "source", "class_raw", "version", "ord", F.trim(F.regexp_extract("_line", r"^\s*\S+\s+(.*)$", 1)).alias("name"), F.regexp_extract("_line", r"^\s*(\S+)", 1).try_cast("double").alias("value"))


def read_sig(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return sig_rows(whole_texts(spark, path))


def sig_samples(texts: DataFrame) -> DataFrame:
    """One row per ``.sig``: its head, the options of its name, and feature names and values as arrays."""
    lines = lines_of(F.col("value"))
    rest = F.filter(F.slice(lines, 3, F.greatest(F.size(lines), F.lit(1))), lambda x: F.trim(x) != "")
    number = lambda x: F.regexp_extract(x, r"^\s*(\S+)", 1).try_cast("double")
    name = lambda x: F.trim(F.regexp_extract(x, r"^\s*\S+\s+(.*)$", 1))
    options = [c.alias(k) for k, c in sampling_options(F.col("path")).items()]
    return texts.select("path", F.trim(F.get(lines, F.lit(1))).alias("source"), F.regexp_extract(F.get(lines, F.lit(0)), r"^\s*(\S+)", 1).alias("class_raw"), version_of(F.get(lines, F.lit(0))).alias("version"), F.transform(rest, name).alias("names"), F.transform(rest, number).alias("features"), *options)


def fit_heads(texts: DataFrame) -> DataFrame:
    """path, version, num_classes, num_features, num_samples, names, labels (of classes 1..C) of (path, value)."""
    lines = lines_of(F.col("value"))
    first, count = F.get(lines, F.lit(0)), lambda i: F.trim(F.get(lines, F.lit(i))).try_cast("int")
    n = texts.select("path", version_of(first).alias("version"), F.regexp_extract(first, r"^\s*(\d+)", 1).try_cast("int").alias("num_classes"), count(1).alias("num_features"), count(2).alias("num_samples"), lines.alias("_lines"))
    names = F.transform(F.slice("_lines", F.lit(4), F.col("num_features")), lambda x: F.trim(x))
    # the blank line behind the names is the label of class 0
    labels = F.transform(F.slice("_lines", F.col("num_features") + 5, F.col("num_classes")), lambda x: F.trim(x))
    return n.where("num_features is not null and num_classes is not null").withColumns({"names": names, "labels": labels})


def fit_rows(texts: DataFrame, discrete: bool = True) -> DataFrame:
    """path, sample_ord (from 0), source, class_idx, label, value, features of whole ``.fit`` texts. A sample's last
    number is its class from 1 (0: unknown, no label), or its value where the space is continuous."""
    heads = fit_heads(texts)
    start = F.col("num_features") + F.col("num_classes") + 4  # lines before the first sample
    body = F.slice("_lines", start + 1, F.greatest(F.size("_lines") - start, F.lit(0)))
    pairs = F.transform(F.sequence(F.lit(0), F.col("num_samples") - 1), lambda i: F.struct(F.trim(F.get(body, i * 2)).alias("numbers"), F.trim(F.get(body, i * 2 + 1)).alias("source")))
    rows = heads.where("num_samples > 0").select("path", "labels", "num_features", F.posexplode(pairs).alias("sample_ord", "_p")).where("_p.numbers is not null")
    words = F.split("_p.numbers", r"\s+")
    rows = rows.select("path", "sample_ord", "labels", F.col("_p.source").alias("source"), F.element_at(words, -1).alias("_last"), F.transform(F.slice(words, F.lit(1), F.col("num_features")), lambda x: x.try_cast("double")).alias("features"))
    if not discrete:
        return rows.select("path", "sample_ord", "source", F.lit(None).cast("int").alias("class_idx"), F.lit(None).cast("string").alias("label"), F.col("_last").try_cast("double").alias("value"), "features")
    index = F.col("_last").try_cast("int")
    label = F.when(index > 0, F.get("labels", index - 1))
    return rows.select("path", "sample_ord", "source", index.alias("class_idx"), label.alias("label"), F.regexp_extract(label, r"(-?\d*\.?\d+)", 1).try_cast("double").alias("value"), "features")


def read_fit(spark: SparkSession, path: str | list[str], discrete: bool = True) -> DataFrame:
    return fit_rows(whole_texts(spark, path).where(is_fit(F.col("value"))), discrete)


def read_weights(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, weight, name of a weights file's lines; lines without a number in front are left out."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.split(F.trim("value"), r"\s+", 2).alias("_w"))
    return rows.select("path", F.get("_w", F.lit(0)).try_cast("double").alias("weight"), F.trim(F.regexp_replace(F.get("_w", F.lit(1)), r"\s+", " ")).alias("name")).where("weight is not null and name is not null")


def read_file_list(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, sample (or path), label, value (the first number in the label) of a two-column file-of-files; ``#`` starts
    a comment; a missing label is UNKNOWN."""
    rows = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#|$)")).select(F.col("_metadata.file_path").alias("file"), F.split("value", "\t").alias("_c"))
    label = F.coalesce(F.nullif(F.trim(F.get("_c", F.lit(1))), F.lit("")), F.lit("UNKNOWN"))
    return rows.select("file", F.trim(F.get("_c", F.lit(0))).alias("sample"), label.alias("label"), F.regexp_extract(label, r"(-?\d*\.?\d+)", 1).try_cast("double").alias("value"))


def read_channel_list(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, name, label, value, fs_col (from 0), path, opts of a multichannel file-of-files. From the third column on,
    each ``{...}`` is one column of the feature space; a bare word in it names the channel. A path stands before its
    braces, in the same column or the one before, and holds for those that follow until another one."""
    rows = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#|$)")).select(F.col("_metadata.file_path").alias("file"), F.split("value", "\t", 3).alias("_c"))
    found = F.regexp_extract_all(F.get("_c", F.lit(2)), F.lit(r"([^\t{}]*)\s*\{([^{}]*)\}"), F.lit(0))
    parts = F.transform(found, lambda x: F.struct(F.trim(F.regexp_extract(x, r"^\s*([^\t{]*)", 1)).alias("path"), F.regexp_extract(x, r"\{([^{}]*)\}", 1).alias("opts")))
    words = F.transform(F.filter(F.split("_p.opts", ";"), lambda w: F.trim(w) != ""), lambda w: F.when(w.contains("="), F.trim(w)).otherwise(F.concat(F.lit("channel="), F.trim(w))))
    label = F.coalesce(F.nullif(F.trim(F.get("_c", F.lit(1))), F.lit("")), F.lit("UNKNOWN"))
    out = rows.select("file", F.trim(F.get("_c", F.lit(0))).alias("name"), label.alias("label"), F.posexplode(parts).alias("fs_col", "_p"), parts.alias("_all"))
    # the nearest path at or before this column
    named = F.filter(F.slice("_all", F.lit(1), F.col("fs_col") + 1), lambda p: p["path"] != "")
    return out.select("file", "name", "label", F.regexp_extract("label", r"(-?\d*\.?\d+)", 1).try_cast("double").alias("value"), "fs_col", F.get(named, F.size(named) - 1)["path"].alias("path"), F.str_to_map(F.array_join(words, ";"), F.lit(";"), F.lit("=")).alias("opts"))
