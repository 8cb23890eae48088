"""The folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Only a session within one machine may do without the setting: it then gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file://" + tempfile.mkdtemp(prefix="agentframe-")


def settled(df: DataFrame) -> DataFrame:
    """df worked out once, though read more than once: written as a table in the shared folder, which ends lineage and survives lost executors; where no folder is set, kept by Spark as it can."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        return df.persist()
    path = f"{root.rstrip('/')}/agentframe/state-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def let_go(df: DataFrame) -> None:
    """Deletes the table of a settled df that nothing reads any more."""
    hadoop = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/agentframe/state-" in name:
            path = hadoop(name)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
