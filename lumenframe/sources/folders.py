"""Folders of images as classes, and feature spaces kept as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.plans.scratch import delete

# The endings that count as images or features.
SUPPORTED = r"(?i)\.(sig|tiff?|ppm)$"


def classes_of(paths: DataFrame, root: str) -> DataFrame:
    """path, base, label, class_idx of (path) files under ``root``: each folder right below it is a class, numbered from
    1 in the order of names. Files in ``root`` itself make all of them unknown (null, 0) and folders don't count.
    Hidden folders and other endings are left out; of an image and its features, which share a name, one row stays."""
    rel = F.ltrim(F.substr("path", F.locate(root.rstrip("/") + "/", F.col("path")) + len(root.rstrip("/"))), F.lit("/"))
    parts = F.split(rel, "/")
    base = F.regexp_replace(F.regexp_replace(F.element_at(parts, -1), SUPPORTED, ""), r"(-(?:B\d+_\d+_\d+_\d+|d\d+|S\d+(?:_\d+)?|R_?\d|t\d+(?:x\d+)?_\d+_\d+|c|l))+$", "")
    rows = paths.select("path", parts.alias("parts"), base.alias("base")).where(F.col("path").rlike(SUPPORTED) & ~F.exists("parts", lambda p: p.startswith(".")))
    top = rows.agg(F.coalesce(F.max((F.size("parts") == 1).cast("int")), F.lit(0)).alias("top"))
    rows = rows.crossJoin(F.broadcast(top)).where((F.size("parts") == 2 - F.col("top")))  # one number
    rows = rows.withColumn("label", F.when(F.col("top") == 0, F.get("parts", F.lit(0))))
    rows = rows.groupBy("label", "base").agg(F.min_by("path", F.struct(F.lower("path").rlike(r"\.sig$"), "path")).alias("path"))
    names = rows.where("label is not null").select("label").distinct()
    index = names.join(names.withColumnRenamed("label", "other"), F.col("other") <= F.col("label")).groupBy("label").agg(F.count("*").cast("int").alias("class_idx"))  # names of classes
    return rows.join(index, "label", "left").select("path", "base", "label", F.coalesce("class_idx", F.lit(0)).alias("class_idx"))


def scan_folder(spark: SparkSession, folder: str) -> DataFrame:
    """``classes_of`` everything below ``folder``; no file is read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")
    return classes_of(found, folder.removeprefix("file://"))


def save_space(samples: DataFrame, names: list[str], path: str, version: str = "4.0") -> None:
    """Samples and the names of their features as two tables; a space is whole once its names are there."""
    samples.write.mode("error").parquet(f"{path}/samples")
    rows = [(i, n, version) for i, n in enumerate(names)]
    samples.sparkSession.createDataFrame(rows, "fidx int, name string, version string").coalesce(1).write.mode("error").parquet(f"{path}/names")


def load_space(spark: SparkSession, path: str) -> tuple[DataFrame, list[str], str]:
    """Samples, names and version of what ``save_space`` wrote."""
    names = spark.read.parquet(f"{path}/names").orderBy("fidx").collect()  # a row per feature
    return spark.read.parquet(f"{path}/samples"), [r["name"] for r in names], names[0]["version"] if names else "4.0"


def drop_space(spark: SparkSession, path: str) -> None:
    delete(spark, path)
