"""The folder that the driver and all executors share, and tables written there.

A written table ends a plan's lineage: later plans stay small, and lost executors cost nothing but
the step that runs.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where that is unset, a temporary folder serves a single machine
    (tests); a cluster without it is refused, as executors would not see the driver's folder. The
    session's own checkpoint folder is left as it is."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not hasattr(spark, "_vellumine_dir"):
        spark._vellumine_dir = tempfile.mkdtemp(prefix="vellumine-")
    return spark._vellumine_dir


def written(df: DataFrame, tag: str = "table") -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._written = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete the files of written tables that nothing reads any more."""
    for t in tables:
        jvm, conf = t.sparkSession.sparkContext._jvm, t.sparkSession.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(t._written)
        path.getFileSystem(conf).delete(path, True)
