"""python -m lumenframe train | test | classify | check: spaces from images, experiments, classes of new images."""

from __future__ import annotations

import argparse
import logging
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger("lumenframe")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lumenframe", description=__doc__)
    todo = top.add_subparsers(dest="command", required=True)
    train = todo.add_parser("train", help="features of a folder of images, a folder a class, into a space")
    train.add_argument("images")
    train.add_argument("space")
    train.add_argument("--long", action="store_true", help="the long plan")
    train.add_argument("--tiles", type=int, default=1, help="tiles along each side")
    train.add_argument("--downsample", type=int, default=0, help="percent")
    train.add_argument("--mean", type=float, default=0.0)
    train.add_argument("--std", type=float, default=0.0)
    test = todo.add_parser("test", help="an experiment on a space, with a report")
    test.add_argument("space")
    test.add_argument("report")
    test.add_argument("--top", type=float, default=0.15, help="number or share of features")
    classify = todo.add_parser("classify", help="classes of the samples of a space")
    classify.add_argument("train")
    classify.add_argument("space")
    classify.add_argument("out")
    classify.add_argument("--top", type=float, default=0.15)
    check = todo.add_parser("check", help="images whose features a space lacks")
    check.add_argument("images")
    check.add_argument("space")
    return top


def diagnostics() -> dict[str, str]:
    """Versions of what runs, and the sizes of the standard plans."""
    import numpy
    import pyarrow
    import pyspark

    from lumenframe.plans.features import FeaturePlan

    sizes = {f"{n} plan{' with colours' * c}": str(getattr(FeaturePlan, n)(c).width) for n in ("short", "long") for c in (False, True)}
    return {"python": sys.version.split()[0], "pyspark": pyspark.__version__, "numpy": numpy.__version__, "pyarrow": pyarrow.__version__} | sizes


def n_features(top: float, width: int) -> int:
    """A share below 1 of all features, or their number."""
    return max(1, round(top * width) if top < 1 else int(top))


def train(spark: SparkSession, a: argparse.Namespace) -> str:
    from lumenframe.plans.features import FeaturePlan, compute
    from lumenframe.sources.folders import save_space, scan_folder
    from lumenframe.sources.tiff import read_images, tiles_of

    plan = FeaturePlan.long() if a.long else FeaturePlan.short()
    images = read_images(spark, a.images, percent=a.downsample, mean=a.mean, std=a.std).where("error is null")
    known = scan_folder(spark, a.images).where("lower(path) like '%.tif%'").select("path", "label")
    images = images.join(known, "path")
    if a.tiles > 1:
        images = tiles_of(images, a.tiles, a.tiles)
    else:
        images = images.withColumn("seq_id", F.lit(0))
    rows = compute(images.select("path", "label", "seq_id", "height", "width", "pix"), plan)
    key = F.xxhash64("path")
    value = F.regexp_extract("label", r"(-?\d*\.?\d+)", 1).try_cast("double")
    samples = rows.select(F.xxhash64("path", "seq_id").alias("sample_id"), F.col("path").alias("source"), "label", value.alias("value"), key.alias("grp"), F.col("seq_id").cast("int").alias("seq"), "features")
    save_space(samples.where("features is not null"), plan.names, a.space, plan.version)
    return f"{spark.read.parquet(a.space + '/samples').count()} samples of {plan.width} features in {a.space}"


def experiment(samples: DataFrame, top: int) -> dict[str, DataFrame]:
    """Predictions, confusion, similarity and probability of a space against itself."""
    from lumenframe.operators.classify import model, one_split, similarities
    from lumenframe.plans.relations import run_plan, sample_form
    from lumenframe.plans.scratch import cut

    sims = cut(similarities(one_split(samples), one_split(samples), model(samples, top)), "similarities")
    given = {"sim": sims, "sample": sample_form(samples)}
    p = run_plan("SELECT 0 AS split, CAST(t AS STRING) AS name, max(nf) AS norm_factor, map_from_entries(collect_list(struct(rl, p))) AS p, max(tl) AS label, max_by(rl, p) AS predicted, sum(p * rv) AS value FROM prob GROUP BY t", **given)
    return {"predictions": p} | {k: run_plan(t, **given) for k, t in {"confusion": "SELECT tl AS gt, pl AS pred, count(*) AS n FROM pred GROUP BY tl, pl", "similarity": "SELECT gt, cls, s FROM smat", "probability": "SELECT gt, cls, p FROM mat"}.items()}


def test(spark: SparkSession, a: argparse.Namespace) -> str:
    from lumenframe.sources import report
    from lumenframe.sources.folders import load_space

    samples, names, _ = load_space(spark, a.space)
    found = experiment(samples, n_features(a.top, len(names)))
    report.write_report(report.report_lines(f"Experiment on {a.space}", **found), a.report)
    n = found["predictions"].agg(F.avg((F.col("label") == F.col("predicted")).cast("double")).alias("acc")).first()
    return f"accuracy {n.acc or 0:.6f}, report in {a.report}"


def classify(spark: SparkSession, a: argparse.Namespace) -> str:
    from lumenframe.operators.classify import wnd5
    from lumenframe.sources.folders import load_space

    known, names, _ = load_space(spark, a.train)
    asked, _, _ = load_space(spark, a.space)
    out = wnd5(asked, known, n_features(a.top, len(names)))
    source = asked.select(F.col("sample_id").alias("t"), "source")
    out.join(source, "t").select("source", F.col("rl").alias("class"), "p", F.col("pl").alias("predicted")).write.mode("error").parquet(a.out)
    return f"probabilities in {a.out}"


def check(spark: SparkSession, a: argparse.Namespace) -> str:
    from lumenframe.sources.folders import load_space, scan_folder

    held, _, _ = load_space(spark, a.space)
    images = scan_folder(spark, a.images).where("lower(path) like '%.tif%'")
    missing = images.join(held.select(F.col("source").alias("path")).distinct(), "path", "left_anti")
    return f"{missing.count()} of {images.count()} images lack features"


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> str:
    a = parser().parse_args(argv)
    level = os.environ.get("LUMENFRAME_VERBOSITY", "2")
    logging.basicConfig(level=max(10, 50 - 10 * int(level)) if level.isdigit() else logging.WARNING)
    log.info("%s", diagnostics())
    spark = spark or SparkSession.builder.appName("lumenframe").getOrCreate()
    said = {"train": train, "test": test, "classify": classify, "check": check}[a.command](spark, a)
    print(said)
    return said


if __name__ == "__main__":
    main()
