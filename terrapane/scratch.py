"""Written tables between the steps of an iterative job."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def scratch_base(spark: SparkSession) -> str:
    """The shared folder that the session names in spark.checkpoint.dir. A local session without the setting gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = _own.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="spark-scratch-"))
    return base


class StepLog:
    """Steps of a long job as tables under one folder: a step that is complete there is read, any other is made and written. A run that was killed goes on where it stopped. The folder belongs to one set of parameters."""

    def __init__(self, spark: SparkSession, path: str, parameters: str):
        self.spark, self.path = spark, path
        said = self.step("parameters", lambda: spark.createDataFrame([(parameters,)], "value string")).first().value
        if said != parameters:
            raise ValueError(f"{path} holds the steps of other parameters: {said}")

    def step(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        where = f"{self.path}/{name}"
        marker = self.spark._jvm.org.apache.hadoop.fs.Path(f"{where}/_SUCCESS")
        if not marker.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(marker):
            make().write.mode("overwrite").parquet(where)  # the marker is written last
        return self.spark.read.parquet(where)


def written(df: DataFrame, name: str) -> DataFrame:
    """df's rows written to the shared folder and read back: the plan starts anew from files that any executor can read."""
    spark = df.sparkSession
    path = f"{scratch_base(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
