"""Tables in the cluster's shared folder, and row keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Spark's setting to remove the shuffle files of a query when it has ended.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(df: DataFrame) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one only for a local master without it."""
    conf = df.sparkSession.conf
    if folder := conf.get("spark.checkpoint.dir", None):
        return folder
    if not df.sparkSession.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="spark-")
    conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """The same rows, written as a table in the shared folder and read from it: the lineage ends there.

    The shuffle files that it took are removed when it is written, unless the session says otherwise.
    """
    path = f"{shared_folder(df).rstrip('/')}/tables/{uuid.uuid4().hex}"
    conf = df.sparkSession.conf
    before = conf.get(CLEAN_UP, None)
    conf.set(CLEAN_UP, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        conf.set(CLEAN_UP, before) if before is not None else conf.unset(CLEAN_UP)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Removes the files of a table made by `written` that nothing reads any more."""
    jvm, spark = df.sparkSession.sparkContext._jvm, df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def text_key(text: str | Column) -> Column:
    """A 64-bit key of a text; null texts have one of their own."""
    column = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.xxhash64(column), F.lit(0).cast("long"))


def small_batches(df: DataFrame) -> DataFrame:
    """The same table, its session set to hand whole texts to Python in batches of at most 1000 rows."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(conf.get(key)) > 1000:
        conf.set(key, 1000)
    return df
