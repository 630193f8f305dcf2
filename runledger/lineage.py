"""Tables that loops write level by level in the folder that all executors share, so that no plan grows with the loop."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Only a local master without one (tests) gets a folder of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="runledger-"))
    return spark.sparkContext.getCheckpointDir()


class Levels:
    """A table that grows by a level a round: each level is written as Parquet and read back.

    What is read back carries neither the plan nor the constraints of the level before, so every round plans and
    runs in the same time, and a lost executor costs the tasks of one level.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n, self.schema = 0, None

    def append(self, df: DataFrame) -> DataFrame:
        """Writes a level and gives back that level alone."""
        path = f"{self.root}/level={self.n}"
        df.write.parquet(path)
        self.n, self.schema = self.n + 1, df.schema
        return self.spark.read.schema(df.schema).parquet(path)

    def all(self) -> DataFrame:
        """The rows of all levels so far, with their level."""
        return self.spark.read.schema(self.schema).option("basePath", self.root).parquet(self.root)

    def drop(self, level: int | None = None) -> None:
        """Deletes the table, or one level of it; no DataFrame that is still in use may read them."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(self.root if level is None else f"{self.root}/level={level}")
        hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
