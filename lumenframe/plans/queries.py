"""Registered queries of the feature-space operators, bound to the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions.colors import ColorTable
from lumenframe.functions.descriptors import Image
from lumenframe.functions.names import parse
from lumenframe.operators import classify, evaluate, regress, sampling
from lumenframe.operators.classify import Models, distance_ranges, meet, model, models, nearest, one_split, similarities, similarities_by_step, wnd5
from lumenframe.operators.positions import with_positions
from lumenframe.plans import oracles
from lumenframe.plans.catalog import PLANS
from lumenframe.plans.features import FeaturePlan, compute, planes_of
from lumenframe.plans.relations import embedding_samples, feature_form, long_form, named, pixel_form, run_plan, sample_form
from lumenframe.plans.tables import table
from lumenframe.sources import artificial

TOP = 9
#: A few colour functions and rules to try the colour operators with; real ones are a parameter.
TRIAL_RULES = ColorTable.read(
    """
red 0 0 0 40
yellow 20 40 40 80
light_green 60 80 80 160
blue 120 160 160 220
red 200 240 240 240
red grey dark black
red clear light red
red medium_grey tend_light pink
yellow tend_clear tend_dark olive
yellow clear light yellow
light_green tend_clear tend_light light_green
light_green medium_grey tend_dark dark_green
blue tend_clear tend_light blue
blue medium_grey almost_dark teal
blue tend_grey light light_grey
"""
)


# --- relations that the pair kernel makes


def shuffled(samples: DataFrame, side: str) -> DataFrame:
    """The samples of one side of every split, with a column ``split``."""
    part = run_plan(f"SELECT split, sample_id FROM part WHERE side = '{side}'", sample=sample_form(samples))
    return samples.join(part, "sample_id")


def split_models(samples: DataFrame, top: int, order: str = "fidx") -> Models:
    """A model of the ``top`` heaviest columns for each split, in the order of a column."""
    text = f"SELECT split, fidx, mn, mx, w, r FROM cvranked JOIN cvmm USING (split, fidx) WHERE r <= {int(top)}"
    return models(run_plan(text, long=long_form(samples), sample=sample_form(samples)).toPandas(), order)  # a row per column and split


def cv_similarities(samples: DataFrame) -> DataFrame:
    by = split_models(samples, TOP)
    return similarities(shuffled(samples, "test"), shuffled(samples, "train"), by)


def tile_similarities(samples: DataFrame) -> DataFrame:
    """Each tile against the same tile of other samples."""
    m = model(samples, TOP)[0]
    by = {int(r[0]): m for r in samples.select("seq").distinct().collect()}  # tiles of an image
    rows = samples.withColumn("split", F.col("seq"))
    return similarities(rows, rows, by)


KERNELS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "sim": lambda s: similarities(one_split(s), one_split(s), model(s, TOP)),
    "near": lambda s: nearest(one_split(s), one_split(s), model(s, TOP), 5),
    "ranges": lambda s: distance_ranges(one_split(s), one_split(s), model(s, TOP)),
    "pairs": lambda s: meet(one_split(s), one_split(s), model(s, TOP), classify.AllPairs),
    "seqsim": tile_similarities,
    "cvs": cv_similarities,
}


def relations(text: str, samples: DataFrame) -> dict[str, DataFrame]:
    """The relations that a plan reads, over ``samples``."""
    simple = {"long": long_form, "pixel": pixel_form, "sample": sample_form, "feat": feature_form}
    return {n: (simple | KERNELS)[n](samples) for n in named(text) if n in simple or n in KERNELS}


def plan_over(samples: DataFrame, text: str) -> DataFrame:
    found = relations(text, samples)
    return run_plan(text, **found) if found else samples.sparkSession.sql(text)


def bound(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: plan_over(embedding_samples(spark, sf_dir), text)


def over_embeddings(run: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: run(embedding_samples(spark, sf_dir))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# --- queries that are functions


def FLAGSHIP(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fit-on-fit weighted-neighbour classification of ``embeddings``: marginal probabilities by sample and class."""
    samples = embedding_samples(spark, sf_dir)
    return wnd5(samples, samples, top=TOP)


def nearest_label(s: DataFrame) -> DataFrame:
    """J3: weights count once, no sample is its own neighbour."""
    by = {0: model(s, TOP)[0].rooted()}
    one = nearest(one_split(s), one_split(s), by, 1, 0.0, apart=True)
    return one.join(s.select(F.col("sample_id").alias("t"), F.col("label").alias("tl")), "t").join(s.select(F.col("sample_id").alias("r"), F.col("label").alias("pl")), "r").select("t", "tl", "pl")


def expected_samples(s: DataFrame) -> DataFrame:
    return sampling.sampling_product(s.select("sample_id"), rotations=4, tile_cols=2, tile_rows=2)


def missing(s: DataFrame) -> DataFrame:
    """S17: the store holds the first rotation of all, the second of samples whose first feature is positive, a short row of the third."""
    full = s.select("sample_id", F.explode(F.when(F.get("features", F.lit(0)) > 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("rot"), "features")
    store = full.unionByName(s.select("sample_id", F.lit(2).alias("rot"), F.slice("features", 1, 3).alias("features")))
    return sampling.missing_samples(expected_samples(s), store, "sample_id", "rot", width=64).select("sample_id", "rot", "tile_col", "tile_row")


def channels(s: DataFrame) -> DataFrame:
    """J7: the four rows of a group become one of 256 features."""
    wide = sampling.stack_channels(s)
    rows = wide.select("grp", "columns", F.posexplode("features").alias("wide_idx", "v"))
    name = sampling.channel_name(F.concat(F.lit("Embedding () ["), (F.col("wide_idx") % 64).cast("string"), F.lit("]")), (F.col("wide_idx") / 64).cast("int"))
    return rows.select("grp", "columns", "wide_idx", name.alias("name"), F.round("v", 6).alias("v"))


def legacy(s: DataFrame) -> DataFrame:
    old = s.sparkSession.createDataFrame([(f"Embedding () [{i}]", f"Vector () [{63 - i}]") for i in range(0, 64, 3)], "old string, new string")
    return sampling.legacy_names(feature_form(s).select("fidx", "name"), old)


def sorted_samples(s: DataFrame) -> DataFrame:
    return with_positions(s.select("sample_id", "value"), "value", "sample_id").select("sample_id", F.col("position").cast("int").alias("position"))


def union_of_samples(s: DataFrame) -> DataFrame:
    both = s.select("sample_id", "label", F.lit("a").alias("origin")).unionByName(s.where("seq = 0").select("sample_id", "label", F.lit("b").alias("origin")))
    return with_positions(both, "label", "sample_id", "origin", name="group_id").withColumn("group_id", (F.col("group_id") - 1).cast("int"))


def scrambled(s: DataFrame) -> DataFrame:
    a = with_positions(s.select("sample_id"), "sample_id", name="k")
    b = with_positions(s.select("label", F.md5(F.concat(F.col("sample_id").cast("string"), F.lit("-scramble"))).alias("m")), "m", name="k")
    return a.join(b, "k").select("sample_id", "label")


def group_ids(s: DataFrame) -> DataFrame:
    groups = with_positions(s.select("grp").distinct(), "grp", name="group_id")
    return s.select("sample_id", "grp").join(groups, "grp").select("sample_id", (F.col("group_id") - 1).cast("int").alias("group_id"))


def rank_order(s: DataFrame) -> DataFrame:
    pred = plan_over(s, "SELECT t, tl, tv, round(pv, 6) AS pv FROM pred")
    placed = with_positions(pred, "pv", "tv", "t", name="overall")
    return plan_of(placed, "SELECT t, tl, CAST(overall AS INT) AS overall, CAST(row_number() OVER (PARTITION BY tl ORDER BY pv, t) AS INT) AS in_class FROM placed")


def plan_of(placed: DataFrame, text: str) -> DataFrame:
    return run_plan(text, placed=placed)


def same_results(s: DataFrame) -> DataFrame:
    """N9: with 9 and with 8 columns."""
    both = classify.same_result(wnd5(s, s, TOP), wnd5(s, s, TOP - 1))
    return both.select("t", F.col("same").cast("int").alias("same"))


def one_sample(s: DataFrame) -> DataFrame:
    """N8: the sample with the smallest id against all others."""
    first = s.agg(F.min("sample_id").alias("least"))
    return wnd5(s.join(first, F.col("sample_id") == F.col("least")).drop("least"), s.join(first, F.col("sample_id") > F.col("least")).drop("least"), TOP)


def grid_search(s: DataFrame) -> DataFrame:
    """R4: accuracy over all splits for each number of columns of a log grid."""
    width = s.selectExpr("max(size(features))").first()[0] or 1
    grid = evaluate.log_grid(width)
    by = split_models(s, grid[-1], order="r")
    sims = similarities_by_step(shuffled(s, "test"), shuffled(s, "train"), by, grid)
    best = sims.groupBy("split", "step", "t").agg(F.max_by("rl", "s").alias("pl")).join(s.select(F.col("sample_id").alias("t"), F.col("label").alias("tl")), "t")
    right = F.sum((F.col("tl") == F.col("pl")).cast("int"))
    return best.groupBy(F.col("step").alias("n_features")).agg(F.count("*").alias("n"), right.alias("correct"), F.round(right / F.count("*"), 6).alias("accuracy"))


def pearson(s: DataFrame) -> DataFrame:
    long = run_plan("SELECT sample_id, value, fidx, v FROM norm", long=long_form(s))
    return rounded(evaluate.pearson_weights(long).drop("pearson_p", "spearman_p"))


def pearson_chances(s: DataFrame) -> DataFrame:
    long = run_plan("SELECT sample_id, value, fidx, v FROM norm", long=long_form(s))
    return rounded(evaluate.pearson_weights(long).select("fidx", "pearson_p", "spearman_p"))


def regression(s: DataFrame) -> DataFrame:
    out = evaluate.regression_error(plan_over(s, "SELECT tv, pv FROM pred"))
    return rounded(out.select("n", "rmse", "avg_abs_dif", "pearson_r", "pearson_se", "spearman_r"))


def regression_chances(s: DataFrame) -> DataFrame:
    out = evaluate.regression_error(plan_over(s, "SELECT tv, pv FROM pred"))
    return out.select("n", F.round("pearson_p", 6).alias("pearson_p"), F.round(F.log("t_density"), 4).alias("log_density"))


def accuracy_chance(s: DataFrame) -> DataFrame:
    """A18: the chance of so many right calls by luck."""
    counts = plan_over(s, "SELECT split, count(*) AS n, sum(CASE WHEN tl = pl THEN 1 ELSE 0 END) AS correct FROM cvbest GROUP BY split").crossJoin(s.agg(F.countDistinct("label").alias("classes")))
    return counts.select("split", "n", "correct", F.round(evaluate.log_binomial_tail("n", "correct", 1.0 / F.col("classes")), 6).alias("log_p"))


def least_squares(s: DataFrame) -> DataFrame:
    """N7: odd samples are predicted from even ones, all features with weight 1."""
    out = regress.least_squares(s.where("sample_id % 2 = 0"), s.where("sample_id % 2 = 1"), [1.0] * 64)
    return out.select("sample_id", F.round("predicted", 4).alias("predicted"))


def least_squares_by_group(s: DataFrame) -> DataFrame:
    """J12: each class in turn is predicted from the others; groups are eight blocks of samples."""
    rows = s.withColumn("fold", F.pmod("grp", F.lit(8)).cast("int"))
    return regress.leave_group_out(rows, [1.0] * 64, "fold").select("sample_id", F.round("predicted", 4).alias("predicted"))


def discriminants(s: DataFrame) -> DataFrame:
    return regress.discriminants(s, s).select("sample_id", F.posexplode("components").alias("component", "v")).select("sample_id", "component", F.round("v", 5).alias("v"))


# --- planes


def evenly(v: F.Column, steps: int = 10_000) -> F.Column:
    """Rounded to steps, halves up even where arithmetic has lost their last bits: so both engines agree on fractions."""
    return F.floor(v * steps + 0.501) / steps


def described(name: str, transforms: str = "", digits: int = 6) -> Callable[[SparkSession, str], DataFrame]:
    """img, idx, v: a descriptor of the embeddings as planes of eight columns."""
    plan = FeaturePlan([f"{name} ({transforms})"])

    def run(s: DataFrame) -> DataFrame:
        out = compute(planes_of(s.select("sample_id", "features")), plan)
        return out.select(F.col("sample_id").alias("img"), F.posexplode("features").alias("idx", "v")).select("img", "idx", (F.round("v", digits) + 0.0 if digits else evenly(F.col("v"))).alias("v"))

    return over_embeddings(run)


def text_plane(text: str | None, width: int = 32) -> np.ndarray:
    """A whole text as a plane: its code points, ``width`` to a row, the last row filled up with 0."""
    v = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4").astype(float)
    return np.pad(v, (0, -len(v) % width)).reshape(-1, width)


def text_features(docs: DataFrame, plan: FeaturePlan) -> DataFrame:
    """sample_id, features of every text that isn't empty. A task holds one text's plane beside a batch of texts: planes,
    eight bytes and more for each byte of text, never leave it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, made = [], []
            for i, text in zip(b.column(0), b.column(1), strict=True):
                plane = text_plane(text.as_py())
                if plane.size:
                    ids.append(i.as_py())
                    made.append(plan.run(Image(plane)).tolist())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(made, pa.list_(pa.float64()))], names=["sample_id", "features"])

    return docs.select(F.col("doc_id").cast("long").alias("sample_id"), "text").mapInArrow(run, "sample_id long, features array<double>")


def described_texts(name: str) -> Callable[[SparkSession, str], DataFrame]:
    plan = FeaturePlan([f"{name} ()"])

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = text_features(table(spark, sf_dir, "documents"), plan)
        rows = out.select(F.col("sample_id").alias("img"), F.posexplode("features").alias("idx", "v"))
        # means of whole numbers end on halves: both engines round these alike only by floor
        return rows.select("img", "idx", (F.floor(F.col("v") * 1_000_000 + 0.5) / 1_000_000).alias("v"))

    return run


def transformed(run: Callable[[np.ndarray], np.ndarray], digits: int = 6) -> Callable[[SparkSession, str], DataFrame]:
    """img, y, x, val: a transform of the embeddings as planes."""

    def go(batches):
        for b in batches:
            parts = []
            for i, f in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                p = run(np.array(f, float).reshape(-1, 8))
                y, x = np.indices(p.shape)
                parts.append(pa.RecordBatch.from_arrays([pa.array(np.full(p.size, i)), pa.array(y.ravel(), pa.int32()), pa.array(x.ravel(), pa.int32()), pa.array(p.ravel().astype(float))], names=["img", "y", "x", "val"]))
            yield from parts

    def query(s: DataFrame) -> DataFrame:
        out = s.select("sample_id", "features").mapInArrow(go, "img long, y int, x int, val double")
        return out.withColumn("val", F.round("val", digits) + 0.0)

    return over_embeddings(query)


def color_planes(s: DataFrame) -> DataFrame:
    """sample_id (a group), height, width, pix (gray), hsv: three rows of a group are red, green and blue."""
    top = F.array_max("features")
    low = F.array_min("features")
    byte = F.transform("features", lambda x: F.floor((x - low) * 255 / F.when(top > low, top - low)))
    rows = s.where("seq < 3").select("grp", "seq", byte.alias("bytes"))
    whole = rows.groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("seq", "bytes"))).alias("c")).where("size(c) = 3")
    pixels = F.transform(F.sequence(F.lit(0), F.size(F.col("c")[0]["bytes"]) - 1), lambda i: F.struct(*[F.get(F.col("c")[k]["bytes"], i).cast("double").alias(n) for k, n in enumerate("rgb")]))
    long = whole.select("grp", F.posexplode(pixels).alias("i", "p")).select("grp", "i", "p.r", "p.g", "p.b")
    return long.select("grp", "i", "r", "g", "b", *[c.alias(n) for n, c in sampling.rgb_columns(F.col("r"), F.col("g"), F.col("b")).items()])


def color_images(s: DataFrame) -> DataFrame:
    px = color_planes(s).groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("i", "gray", "h", "s", "v"))).alias("p"))
    return px.select(F.col("grp").alias("sample_id"), (F.size("p") / 8).cast("int").alias("height"), F.lit(8).alias("width"), F.transform("p", lambda x: x["gray"]).alias("pix"), F.flatten(F.transform("p", lambda x: F.array(x["h"], x["s"], x["v"]))).alias("hsv"))


def described_colors(group: str) -> Callable[[SparkSession, str], DataFrame]:
    plan = FeaturePlan([group])

    def run(s: DataFrame) -> DataFrame:
        out = compute(color_images(s), plan, TRIAL_RULES)
        return out.select(F.col("sample_id").alias("img"), F.posexplode("features").alias("idx", "v")).select("img", "idx", F.round("v", 6).alias("v"))

    return over_embeddings(run)


def color_pixels(s: DataFrame) -> DataFrame:
    return color_planes(s).select("grp", F.col("i").alias("pos"), F.round("gray", 6).alias("gray"), "h", "s", "v")


def color_statistics(s: DataFrame) -> DataFrame:
    """T18 by group: mean and deviation of hue, saturation and value."""
    return rounded(color_planes(s).groupBy("grp").agg(*[f(c).alias(f"{c}_{n}") for c in "hsv" for n, f in (("mean", F.avg), ("std", F.stddev_samp))]))


def parsed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1 over the names of the long plan with colours."""
    rows = [(n, f.algorithm, " < ".join(f.transforms), f.channel, f.index) for n in FeaturePlan.long(True).names for f in [parse(n)]]
    return spark.createDataFrame(rows, "name string, algorithm string, transforms string, channel string, idx int")


def legacy_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G2: names as an older file has them."""
    from lumenframe.functions.names import read_legacy

    known = read_legacy("# old\tnew\n  Zernike_3\tZernike Coefficients () [3]\nEdgeArea\tEdge Features () [0]\n")
    return spark.createDataFrame([(n, parse(n, known).name) for n in ("Zernike_3", "EdgeArea", "Gini Coefficient ()")], "old string, name string")


CONVOLVED = np.array([[0.0, 1.0, 0.5], [-1.0, 2.0, 0.0], [0.25, -0.5, 1.0]])


def function_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from lumenframe.functions import planes, transforms

    e = over_embeddings
    return {
        "wnd5": FLAGSHIP,
        "S13_continuous": lambda spark, sf_dir: artificial.rows(artificial.continuous(spark, n_samples=100, per_signal=3)),
        "S14_discrete": lambda spark, sf_dir: artificial.rows(artificial.discrete(spark, n_classes=7, n_samples=100, per_signal=2)),
        "S16_sampling": e(lambda s: expected_samples(s).select("sample_id", "rot", "tile_col", "tile_row", "name")),
        "S17_missing": e(missing),
        "J3_nearest_label": e(nearest_label),
        "J7_channels": e(channels),
        "J9_legacy_names": e(legacy),
        "J12_leave_group_out": e(least_squares_by_group),
        "A6_pearson": e(pearson),
        "A6_chances": e(pearson_chances),
        "A18_chance": e(accuracy_chance),
        "A20_regression_error": e(regression),
        "A21_chances": e(regression_chances),
        "W2_group_ids": e(group_ids),
        "W3_rank_order": e(rank_order),
        "K1_sort": e(sorted_samples),
        "U1_union": e(union_of_samples),
        "U5_scramble": e(scrambled),
        "R4_grid": e(grid_search),
        "N5_discriminants": e(discriminants),
        "N7_least_squares": e(least_squares),
        "N8_one_sample": e(one_sample),
        "N9_same_result": e(same_results),
        "F1_chebyshev_fourier": described("Chebyshev-Fourier Coefficients"),
        "F2_chebyshev": described("Chebyshev Coefficients"),
        "F3_zernike": described("Zernike Coefficients"),
        "F4_haralick": lambda spark, sf_dir: described("Haralick Textures", digits=0)(spark, sf_dir).where("idx NOT IN (16, 17)"),
        "F4_maximal_correlation": lambda spark, sf_dir: described("Haralick Textures", digits=0)(spark, sf_dir).where("idx IN (16, 17)"),
        "F5_multiscale": described("Multiscale Histograms"),
        "F6_tamura": described("Tamura Textures", digits=5),
        "F7_comb": described("Comb Moments"),
        "F8_radon": described("Radon Coefficients"),
        "F9_fractal": described_texts("Fractal Features"),
        "F10_intensity": described("Pixel Intensity Statistics"),
        "F10_intensity_texts": described_texts("Pixel Intensity Statistics"),
        "F11_edge": described("Edge Features"),
        "F12_objects": described("Otsu Object Features"),
        "F13_inverse_objects": described("Inverse-Otsu Object Features"),
        "F14_gabor": described("Gabor Textures"),
        "F15_gini": described("Gini Coefficient"),
        "F16_color_histogram": described_colors("Color Histogram ()"),
        "F_fourier_intensity": described("Pixel Intensity Statistics", "Fourier ()", digits=5),
        "T1_fourier": transformed(lambda p: transforms.fourier(Image(p))),
        "T2_chebyshev": transformed(lambda p: transforms.chebyshev(Image(p))),
        "T3_wavelet": transformed(lambda p: transforms.wavelet(Image(p))),
        "T5_color": described_colors("Pixel Intensity Statistics (Color ())"),
        "T6_hue": described_colors("Pixel Intensity Statistics (Hue ())"),
        "T7_empty": described("Pixel Intensity Statistics", "Color Transform ()"),
        "T9_downsample": transformed(lambda p: planes.downsample(p, 0.6, 0.4)),
        "T13_convolve": transformed(lambda p: planes.convolve(p, CONVOLVED)),
        "T16_labels": transformed(lambda p: planes.labels(planes.otsu_mask(p))),
        "T17_color_spaces": e(color_pixels),
        "T18_color_statistics": e(color_statistics),
        "G1_name_parse": parsed_names,
        "G2_legacy_names": legacy_text,
    }


QUERIES = {name: bound(text) for name, text in PLANS.items()} | function_queries()
ORACLE = oracles.SQL
