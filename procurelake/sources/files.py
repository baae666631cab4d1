"""Files in and out: delimited extracts, register keys, newest files, stage tables."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procurelake.functions.scalars import iso_date


class HeaderMismatch(ValueError):
    """Files of one extract whose headers differ."""


def headers(spark: SparkSession, path: str, sep: str = ";") -> dict[str, list[str]]:
    """The header of each file: one line a file goes to the driver."""
    name = F.col("_metadata.file_path")
    lines = spark.read.text(path).select(name.alias("file"), F.col("_metadata.file_block_start").alias("at"), "value", F.monotonically_increasing_id().alias("id"))
    first = lines.where("at = 0").groupBy("file").agg(F.min_by("value", "id").alias("value"))
    return {r.file: [c.strip('"﻿') for c in r.value.split(sep)] for r in first.collect()}


def concordant(spark: SparkSession, path: str, sep: str = ";") -> list[str]:
    """The columns that all files share; an error if any file has others. One file is fine."""
    found = headers(spark, path, sep)
    if not found:
        raise FileNotFoundError(path)
    (first, columns), *rest = sorted(found.items())
    for name, other in rest:
        if set(other) != set(columns):
            raise HeaderMismatch(f"{first} and {name} differ in {sorted(set(other) ^ set(columns))}")
    return columns


def extract(spark: SparkSession, path: str, sep: str = ";") -> DataFrame:
    """All files of an extract as text columns with `dataset`, the file's name. Files may order columns differently.

    An empty cell is an empty text and NA is null."""
    columns = concordant(spark, path, sep)
    by_order: dict[tuple, list[str]] = {}
    for name, own in headers(spark, path, sep).items():
        by_order.setdefault(tuple(own), []).append(name)
    out = None
    for own, names in by_order.items():
        schema = ", ".join(f"`{c}` string" for c in own)
        part = spark.read.schema(schema).csv(names, sep=sep, header=True, escape='"', multiLine=True, nullValue="NA", emptyValue="", enforceSchema=True)
        part = part.select(*[F.col(f"`{c}`") for c in columns], F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("dataset"))
        out = part if out is None else out.unionByName(part)
    return out


def newest(spark: SparkSession, folder: str, pattern: str) -> str:
    """The file changed last among those whose names match; listed by Spark, so that any store will do."""
    files = spark.read.format("binaryFile").load(folder).select("path", "modificationTime")
    found = [(r.modificationTime, r.path) for r in files.collect() if re.search(pattern, r.path.rsplit("/", 1)[-1])]
    if not found:
        raise FileNotFoundError(f"{folder}: {pattern}")
    return max(found)[1]


def register_names(spark: SparkSession, path: str, name: str = "name", encoding: str = "UTF-8") -> DataFrame:
    """Registered names with their validity as dates; numbers stay text."""
    raw = spark.read.csv(path, header=True, escape='"', encoding=encoding, inferSchema=False)
    day = lambda c: iso_date(F.col(c)) if c in raw.columns else F.lit(None).cast("date")
    return raw.select(F.lpad("cvr", 8, "0").alias("cvr"), F.col(name).alias("name"), day("gyldigfra").alias("valid_from"), day("gyldigtil").alias("valid_to"))


def typed(spark: SparkSession, path: str, schema: str, columns: list[str] | None = None, **options) -> DataFrame:
    """A delimited file with types. `columns`: those to read, in any encoding given."""
    df = spark.read.schema(schema).csv(path, header=True, **options)
    return df.select(*columns) if columns else df


def chunked(tables: dict[str, DataFrame], path: str, chunk: str) -> dict[str, DataFrame]:
    """Tables of a run by chunks, each written by chunk under `path`; chunks that are written anew replace themselves only."""
    spark = next(iter(tables.values())).sparkSession
    out = {}
    for name, df in tables.items():
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(chunk).parquet(f"{path}/{name}")
        out[name] = spark.read.parquet(f"{path}/{name}")
    return out


def save(df: DataFrame, path: str, *, refuse: bool = False) -> DataFrame:
    """A stage's table, written and read back. refuse: an existing one is an error."""
    df.write.mode("errorifexists" if refuse else "overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def append(df: DataFrame, path: str) -> None:
    """Rows added to a delimited table; nulls are empty cells."""
    df.write.mode("append").csv(path, header=True, nullValue="", emptyValue="")


def replace_in_place(spark: SparkSession, path: str, change) -> DataFrame:
    """A table read, changed and put where it was: written beside it first, then swapped."""
    side = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    change(spark.read.parquet(path)).write.parquet(side)
    jvm = spark._jvm
    old, new, aside = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, side, f"{side}.old"))
    fs = new.getFileSystem(spark._jsc.hadoopConfiguration())
    # the old table goes last: at any time one of the two is whole
    for a, b in ((old, aside), (new, old)):
        if not fs.rename(a, b):
            raise OSError(f"{a} could not be renamed to {b}")
    fs.delete(aside, True)
    return spark.read.parquet(path)


def left_to_do(all_: DataFrame, done: DataFrame, key: str, *, version: str | None = None, final: tuple[str, ...] = ("ok", "not_found")) -> DataFrame:
    """Keys without a final status; a status table of another version is an error."""
    if version is not None:
        other = done.where(F.col("version") != version).limit(1).collect()
        if other:
            raise ValueError(f"status table of version {other[0].version}, not {version}")
    return all_.join(done.where(F.col("status").isin(*final)).select(key).distinct(), key, "left_anti")
