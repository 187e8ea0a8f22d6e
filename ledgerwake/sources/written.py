"""Tables that are written once and read back, in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_folders: dict[str, str] = {}


def own_folder(spark: SparkSession) -> str:
    """This application's folder in spark.checkpoint.dir (or in what setCheckpointDir was given), deleted when the session's JVM ends. A local session may leave it unset: it gets a temporary one."""
    context = spark.sparkContext
    if context.applicationId not in _folders:
        root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
        if not root:
            if not re.match(r"local(\[|$)", context.master):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            root = f"file://{tempfile.mkdtemp(prefix='ledgerwake-')}"
            context.setCheckpointDir(root)
            spark.conf.set("spark.checkpoint.dir", root)
        folder = f"{root.rstrip('/')}/tables-{uuid.uuid4().hex}"
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).mkdirs(path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(path)
        _folders[context.applicationId] = folder
    return _folders[context.applicationId]


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table of its own: what it is made of is computed once, however often it is read, and a lost executor costs a reread."""
    path = f"{own_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def observed(df: DataFrame, name: str, columns: list[str], **metrics: Column) -> tuple[DataFrame, dict]:
    """The columns of df, written, and aggregates of df that the same job gathers on the way."""
    watch = Observation()
    table = written(df.observe(watch, *(value.alias(key) for key, value in metrics.items())).select(*columns), name)
    return table, watch.get
