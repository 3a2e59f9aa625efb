"""Incremental recognition as a stream: every micro-batch is matched with what is stored and appended once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def recognise_stream(
    source: DataFrame, target: str, checkpoint: str, recognise: Callable[[DataFrame, DataFrame], DataFrame], schema: str
) -> StreamingQuery:
    """Start a query that hands each micro-batch and the stored results to ``recognise`` and writes what it returns
    below ``target``, one folder per batch, overwritten when a batch is repeated after a failure. So every result
    is written once, and a batch is never compared with its own earlier attempt."""

    def write(batch: DataFrame, number: int) -> None:
        spark: SparkSession = batch.sparkSession
        stored = _stored(spark, target, schema, number)
        recognise(batch, stored).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _stored(spark: SparkSession, target: str, schema: str, before: int) -> DataFrame:
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    exists = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    if not exists:
        return spark.createDataFrame([], schema)
    return spark.read.schema(f"{schema}, batch bigint").parquet(target).where(f"batch < {before}").drop("batch")
