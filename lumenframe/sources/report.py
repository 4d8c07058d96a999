"""Reports of experiments as HTML, and their rows read back; and the same as plain text.

The head and the matrices are small and made on the driver; predictions are a DataFrame of lines, sorted and streamed.
"""

from __future__ import annotations

import html
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.sources.sinks import matrix_lines

MOST_SPLITS = 100


def escaped(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def table(title: str, lines: list[str]) -> list[str]:
    rows = ["<tr>" + "".join(f"<td>{html.escape(c, quote=False)}</td>" for c in line.split("\t")) + "</tr>" for line in lines]
    return [f"<h2>{html.escape(title)}</h2>", "<table>", *rows, "</table>"]


def prediction_lines(predictions: DataFrame, classes: list[str]) -> DataFrame:
    """split, name, value (an HTML row) of predictions (split, name, norm_factor, p: map of class to probability, label,
    predicted, value)."""
    cells = [F.col("split").cast("string"), escaped(F.col("name")), F.format_string("%.6e", F.col("norm_factor"))]
    cells += [F.format_string("%.6f", F.coalesce(F.try_element_at("p", F.lit(c)), F.lit(0.0))) for c in classes]
    cells += [escaped(F.coalesce("label", F.lit("UNKNOWN"))), escaped(F.coalesce("predicted", F.lit(""))), F.coalesce(F.format_string("%.6f", F.col("value")), F.lit(""))]
    inner = F.concat(*[F.concat(F.lit("<td>"), c, F.lit("</td>")) for c in cells])
    return predictions.select("split", "name", F.concat(F.lit('<tr class="prediction">'), inner, F.lit("</tr>")).alias("value"))


def report_lines(title: str, predictions: DataFrame, confusion: DataFrame, similarity: DataFrame, probability: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """(value) the lines of a report in order. Of more than ``MOST_SPLITS`` splits single predictions are left out."""
    spark = predictions.sparkSession
    classes = sorted(r[0] for r in probability.select("cls").distinct().collect())
    right = predictions.agg(F.count("*").alias("n"), F.sum((F.col("label") == F.col("predicted")).cast("int")).alias("c"), F.countDistinct("split").alias("k")).first()
    head = ["<!DOCTYPE html>", f"<html><head><title>{html.escape(title)}</title></head><body>", f"<h1>{html.escape(title)}</h1>"]
    head += [f"<p>Samples: {right.n}, splits: {right.k}, right: {right.c or 0}, accuracy: {(right.c or 0) / max(right.n, 1):.6f}</p>"]
    head += table("Confusion", matrix_lines(confusion, "gt", "pred", "n", "%d")) + table("Similarity", matrix_lines(similarity, "gt", "cls", "s")) + table("Probability", matrix_lines(probability, "gt", "cls", "p"))
    if weights is not None:
        head += table("Features", [f"{r['weight']:.6f}\t{r['name']}" for r in weights.orderBy(F.desc("weight"), "name").limit(50).collect()])
    head += ["<h2>Predictions</h2>", "<table>", '<tr class="head">' + "".join(f"<th>{html.escape(c, quote=False)}</th>" for c in ["split", "name", "norm factor", *classes, "actual", "predicted", "value"]) + "</tr>"]
    top = spark.createDataFrame([(0, 0, "", i, x) for i, x in enumerate(head)], "part int, split int, name string, at int, value string")
    rows = prediction_lines(predictions if right.k <= MOST_SPLITS else predictions.limit(0), classes)
    body = rows.select(F.lit(1).alias("part"), F.col("split").cast("int").alias("split"), "name", F.lit(0).alias("at"), "value")
    end = spark.createDataFrame([(2, 0, "", 0, "</table></body></html>")], top.schema)
    return top.unionByName(body).unionByName(end).orderBy("part", "split", "name", "at").select("value")


def write_report(lines: DataFrame, path: str) -> None:
    lines.coalesce(1).write.mode("error").text(path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """path, split, name, norm_factor, p (map of class to probability), label, predicted, value of a report's predictions."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), "value")
    heads = lines.where(F.col("value").startswith('<tr class="head">')).groupBy("path").agg(F.first(F.regexp_extract_all("value", F.lit("<th>(.*?)</th>"), F.lit(1))).alias("head"))
    cells = lines.where(F.col("value").startswith('<tr class="prediction">')).select("path", F.regexp_extract_all("value", F.lit("<td>(.*?)</td>"), F.lit(1)).alias("c")).join(heads, "path")

    def plain(c: Column) -> Column:
        return F.replace(F.replace(F.replace(c, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))

    n = F.size("c") - 6
    classes = F.transform(F.slice("head", F.lit(4), n), plain)
    return cells.select("path", F.get("c", F.lit(0)).cast("int").alias("split"), plain(F.get("c", F.lit(1))).alias("name"), F.get("c", F.lit(2)).cast("double").alias("norm_factor"), F.map_from_arrays(classes, F.transform(F.slice("c", F.lit(4), n), lambda x: x.cast("double"))).alias("p"), plain(F.element_at("c", -3)).alias("label"), plain(F.element_at("c", -2)).alias("predicted"), F.element_at("c", -1).try_cast("double").alias("value"))


def summary(samples: DataFrame, title: str = "Feature space") -> str:
    """What a space holds, as text: its classes and their sizes."""
    rows = samples.groupBy("label").agg(F.count("*").alias("n"), F.max(F.size("features")).alias("width")).orderBy("label").collect()  # a row per class
    total = sum(r["n"] for r in rows)
    out = [f"{title}: {total} samples, {max((r['width'] for r in rows), default=0)} features, {sum(r['label'] is not None for r in rows)} classes"]
    return "\n".join(out + [f"{'UNKNOWN' if r['label'] is None else r['label']}\t{r['n']}" for r in rows])


def text_table(lines: list[str]) -> str:
    """Tab-separated lines with their columns set below each other."""
    cells = [line.split("\t") for line in lines]
    widths = [max(len(r[k]) for r in cells if k < len(r)) for k in range(max(map(len, cells)))]
    return "\n".join(re.sub(r" +$", "", "  ".join(c.ljust(w) for c, w in zip(r, widths, strict=False))) for r in cells)
