"""Reliable cut points for long plans: tables written to the folder that all executors share.

The folder is what the cluster names in ``spark.checkpoint.dir``; only where that is unset (tests, a laptop) a
private temporary folder is chosen, and only where driver and executors are one machine. A lost executor therefore never
loses a cut: readers find committed Parquet. ``discard`` deletes tables that nothing reads any more, ``clean`` all that
this session wrote.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; sets a temporary one where the session names none and runs on one machine."""
    found = spark.conf.get(SETTING, None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError(f"set {SETTING} to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lumenframe-")
        spark.conf.set(SETTING, found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/lumenframe/{tag}-{uuid.uuid4().hex}"


#: Folders of the tables that this process wrote and didn't discard.
_written: set[str] = set()


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there."""
    path = scratch_path(df.sparkSession, tag)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._lumenframe_path = path
    _written.add(path)
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``cut`` gave. Whatever is still to be computed must not need them."""
    for t in tables:
        path = getattr(t, "_lumenframe_path", None)
        if path in _written:
            _written.remove(path)
            delete(t.sparkSession, path)


def clean(spark: SparkSession) -> None:
    """Deletes every table that this process wrote and didn't discard."""
    while _written:
        delete(spark, _written.pop())


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores as keep it apart from the columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out


def numbered(df: DataFrame, name: str = "_row") -> DataFrame:
    """``df`` with a number of its own for every row (``name``), fixed as the table is written."""
    return cut(df.withColumn(name, F.monotonically_increasing_id()), "rows")
