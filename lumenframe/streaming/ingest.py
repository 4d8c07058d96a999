"""Structured Streaming over feature files: signatures as they land, and running statistics by class and feature."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lumenframe.sources.files import sig_rows


def stream_sig(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """The rows of every ``.sig`` that lands in ``folder``, once each."""
    texts = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "*.sig").text(folder, wholetext=True)
    return sig_rows(texts.select(F.col("_metadata.file_path").alias("path"), "value"))


def column_statistics(rows: DataFrame) -> DataFrame:
    """class_raw, name, n, mean, var, low, high over finite values: state grows with classes and features, not rows."""
    finite = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf"))
    return rows.where(finite).groupBy("class_raw", "name").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.var_samp("value").alias("var"), F.min("value").alias("low"), F.max("value").alias("high"))


def keep_statistics(rows: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Write the statistics after each batch of files to ``path``/batch=<id>; the newest batch is the state."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    out = column_statistics(rows).writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(put)
    return (out.trigger(availableNow=True) if once else out).start()
