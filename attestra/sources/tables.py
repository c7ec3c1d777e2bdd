"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Bytes at which an Arrow batch on its way to Python is closed; a longer row is a batch of its own.
BATCH_BYTES = 2 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Close the session's Arrow batches by their bytes, as rows can be long; a setting of the user's own stays."""
    if BATCH_SETTING not in spark.conf.getAll:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where one machine runs everything."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="attestra-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as Parquet to the shared folder and read it back."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder, wherever Spark keeps it."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


class Workspace:
    """The intermediate tables of one job, each written once; finish() writes a result outside of them, close() deletes them."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.root, self.paths = spark, name, scratch(spark, name), {}

    def written(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{len(self.paths)}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def dropped(self, *tables: DataFrame | None) -> None:
        """Delete tables that nothing reads any more."""
        for t in tables:
            if t is not None and self.paths.get(id(t), (None, ""))[1]:
                removed(self.spark, self.paths[id(t)][1])
                self.paths[id(t)] = (t, "")

    def finish(self, df: DataFrame) -> DataFrame:
        out = written(df, f"{self.name}-result")
        self.close()
        return out

    def close(self) -> None:
        removed(self.spark, self.root)
