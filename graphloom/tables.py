"""Tables in the shared folder, for results that are read again: Parquet is several times smaller than a checkpoint."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame


def saved(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage with a Parquet table in the session's checkpoint folder, and read it back. The caller sets the folder."""
    spark = df.sparkSession
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._graphloom_path = path
    freed(spark)
    return out


def dropped(*frames: DataFrame) -> None:
    """Delete tables of saved() that nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._graphloom_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def freed(spark) -> None:
    """Shuffle files go only once the driver has collected what refers to them."""
    gc.collect()
    spark._jvm.System.gc()
