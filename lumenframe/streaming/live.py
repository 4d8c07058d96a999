"""Streams of images: features as images land, and their classes.

The feature store is a folder of Parquet keyed by source, options and version. A batch computes only what the store lacks,
so a batch that runs again, or a second job on the same folder of images, adds nothing twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lumenframe.functions.colors import ColorTable
from lumenframe.operators.classify import Models, one_split, similarities
from lumenframe.plans.features import FeaturePlan, compute
from lumenframe.sources.tiff import decoded

KEYS = ["source", "opts", "version"]
STORE = "source string, opts string, version string, features array<double>"


def stored(spark: SparkSession, store: str) -> DataFrame:
    """What the store holds so far, each key once."""
    return spark.read.schema(STORE).parquet(store).dropDuplicates(KEYS)


def ensure(spark: SparkSession, store: str) -> None:
    """Makes an empty store where there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(store)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        spark.createDataFrame([], STORE).write.mode("ignore").parquet(store)


def compute_missing(images: DataFrame, store: str, plan: FeaturePlan, opts: str = "", colors: ColorTable | None = None) -> DataFrame:
    """Features of the images (path, content) that the store lacks; files that can't be read have none."""
    spark = images.sparkSession
    ensure(spark, store)
    wanted = images.withColumns({"source": F.col("path"), "opts": F.lit(opts), "version": F.lit(plan.version)})
    left = wanted.join(stored(spark, store).select(*KEYS), KEYS, "left_anti")
    made = compute(decoded(left).where("error is null"), plan, colors)
    return made.select(F.col("path").alias("source"), F.lit(opts).alias("opts"), F.lit(plan.version).alias("version"), "features")


def keep_features(spark: SparkSession, folder: str, store: str, plan: FeaturePlan, checkpoint: str, opts: str = "", files_per_trigger: int = 100, once: bool = False) -> StreamingQuery:
    """Computes the features of every image that lands in ``folder`` into ``store``."""
    ensure(spark, store)
    source = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    images = source.option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "*.tif*").load(folder)

    def put(batch: DataFrame, number: int) -> None:
        compute_missing(batch.select("path", "content"), store, plan, opts).write.mode("append").parquet(store)

    out = images.writeStream.option("checkpointLocation", checkpoint).foreachBatch(put)
    return (out.trigger(availableNow=True) if once else out).start()


def classify_stream(samples: DataFrame, train: DataFrame, by: Models, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Writes source, predicted, p (of that class) of each streamed sample (sample_id, label, features) against a fixed
    train set; ``by``: the model of split 0."""

    def put(batch: DataFrame, number: int) -> None:
        sims = similarities(one_split(batch), one_split(train), by)
        out = sims.groupBy("t").agg(F.max_by("rl", "s").alias("predicted"), (F.max("s") / F.sum("s")).alias("p"))
        out.withColumnRenamed("t", "sample_id").write.mode("overwrite").parquet(f"{path}/batch={number}")

    out = samples.writeStream.option("checkpointLocation", checkpoint).foreachBatch(put)
    return (out.trigger(availableNow=True) if once else out).start()
