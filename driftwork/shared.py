"""Tables in the folder that all machines share, where a step is read more than once or its lineage is to be cut."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local folder where that is unset and the master is local (tests), else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    context = spark.sparkContext
    if not re.match(r"local(\[[^,]*(,\d+)?\])?$", context.master):
        raise ValueError(f"spark.checkpoint.dir must name a folder that all machines share; the master is {context.master}")
    if context.applicationId not in _OWN:
        _OWN[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="driftwork-")
    return _OWN[context.applicationId]


def scratch(spark: SparkSession, tag: str) -> str:
    """A fresh folder in the shared one. It is deleted when the driver ends, as a result may read it until then."""
    path = f"{folder(spark)}/driftwork-{tag}-{uuid.uuid4().hex[:12]}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.mkdirs(at)
    store.deleteOnExit(at)
    return path


def written(df: DataFrame, tag: str) -> DataFrame:
    """df from a table in the shared folder."""
    path = scratch(df.sparkSession, tag)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
