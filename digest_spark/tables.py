"""Tables in the cluster's shared folder, and joins whose small side is measured first."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast if it has at most so many rows, of so many bytes as JSON.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only for a local master without it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder and read again."""
    path = f"{shared_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def has_table(spark: SparkSession, path: str) -> bool:
    """Whether a folder holds a table that was written to its end."""
    jvm = spark.sparkContext._jvm
    mark = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)


def fits(df: DataFrame, most: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether a table may be broadcast. Measuring it is an action."""
    size = F.sum(F.octet_length(F.to_json(F.struct("*")))) if df.columns else F.lit(0)
    rows, size = df.limit(most + 1).agg(F.count("*"), size).first()
    return rows <= most and (size or 0) <= most_bytes


def small(df: DataFrame, most: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Marked for a broadcast if it is small enough, else as it is, to be joined by a shuffle."""
    return F.broadcast(df) if fits(df, most, most_bytes) else df
