"""Drop folders read as they fill: each run takes what is new, and writes data and status together."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def drops(spark: SparkSession, folder: str, schema: str, sep: str = ";") -> DataFrame:
    """New files of a folder, as text columns."""
    return spark.readStream.schema(schema).csv(folder, sep=sep, header=True, escape='"')


def take_new(stream: DataFrame, out: str, checkpoint: str, change: Callable[[DataFrame], DataFrame] = lambda d: d) -> StreamingQuery:
    """One run over all files that no run has taken.

    A batch is a folder of its own, overwritten if the batch is run again: after a crash no row is there twice."""

    def write(batch: DataFrame, number: int) -> None:
        change(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
