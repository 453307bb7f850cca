"""Run a stream over what its source holds, to its end, and read back what it wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


class NoSharedFolder(RuntimeError):
    """State and results of a stream need a folder that the driver and all executors share."""


def folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one of the cluster; only where all runs in one process (master local, as in tests) may that be unset."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base and spark.sparkContext.master.partition("[")[0] != "local":
        raise NoSharedFolder("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(base or 'file:///tmp/contractlens-streams').rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpoints(spark: SparkSession) -> None:
    """See to it that checkpoint() has a folder; the one that is set stays."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(folder(spark, "checkpoints"))


def drain(df: DataFrame, mode: str = "append") -> DataFrame:
    """append: a file sink. complete: each batch replaces the result, as an aggregate without late rows left open would."""
    spark, base = df.sparkSession, folder(df.sparkSession, "stream")
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", base + "/state").trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").option("path", base + "/out").start().awaitTermination()
    else:
        writer.foreachBatch(lambda b, _: b.write.mode("overwrite").parquet(base + "/out")).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(base + "/out")
