"""What the operators ask of a Spark session."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch: texts of some KB then make a few MB for a Python worker.
ARROW_ROWS = "1024"


def prepared(spark: SparkSession) -> SparkSession:
    """Bound Arrow batches, and give a checkpoint folder where a local session names none (as in tests)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.getCheckpointDir() is None:
        import tempfile

        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
    return spark


def once(df: DataFrame) -> DataFrame:
    """df computed once and written to the shared checkpoint folder, without lineage."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder and spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def crc_rest(column: str, divisor: int):
    """crc32 of the id as text, modulo divisor; of an id that is null: null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % divisor


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir}/documents.parquet")


def stored(df: DataFrame) -> DataFrame:
    """df written once as a table under the shared checkpoint folder, and read from there."""
    import uuid

    spark = prepared(df.sparkSession)
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    path = f"{folder}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def running(df: DataFrame, value: str, name: str, by: str = "s", order: str = "rid") -> DataFrame:
    """df with the sum of `value` over all rows before a row, in the order of (by, order).

    Sums of the groups of `by` are few and are summed in one task; within a group a window sums."""
    from pyspark.sql import Window as W

    sums = df.groupBy(by).agg(F.sum(value).alias("__sum"))
    before = sums.select(by, F.coalesce(F.sum("__sum").over(W.orderBy(by).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    own = F.coalesce(F.sum(value).over(W.partitionBy(by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("__own", own).join(before, by).withColumn(name, (F.col("__own") + F.col("__before")).cast("long")).drop("__own", "__before")
