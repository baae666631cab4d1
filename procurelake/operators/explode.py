"""Lists in cells to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procurelake.functions.ids import n_valid
from procurelake.functions.scalars import pieces, trimmed

#: What separates firms in a field that holds several valid numbers.
SEPARATORS = r"(?i)\s*(?:[,;|/&.-]|\b(?:og|samt|and)\b|(?<=\d)(?:og|samt|and)(?=\d))\s*"


def delimited(df: DataFrame, column: str, delimiter: str = ";", number: str | None = None) -> DataFrame:
    """A row for each piece of a delimited field, blank pieces null; optionally numbered from 1."""
    df = df.select("*", F.posexplode(pieces(F.col(column), delimiter)).alias("__at", "__piece"))
    df = df.withColumn(column, F.nullif(trimmed(F.col("__piece")), F.lit("")))
    return (df.withColumn(number, F.col("__at") + 1) if number else df).drop("__at", "__piece")


def parts(c: Column, *, dots: bool = False) -> Column:
    """The stripped parts of a list of firms; empty parts are null, a null list has none."""
    same = F.regexp_replace(c, r"\s*[,;]\s*", ";")
    if dots:  # in lists of numbers a dot before a letter or digit separates too
        same = F.regexp_replace(same, r"\.\s*(?=[A-Z0-9])", ";")
    return F.transform(pieces(same, ";"), lambda p: F.nullif(trimmed(p), F.lit("")))


def parallel(df: DataFrame, columns: list[str], id_column: str, number: str = "entity_number") -> DataFrame:
    """Lists that run in parallel, to rows numbered from 1; shorter lists end in nulls, and rows without any list go."""
    lists = df.withColumns({f"__{c}": parts(F.col(c), dots=c == id_column) for c in columns})
    n = F.greatest(*[F.coalesce(F.size(f"__{c}"), F.lit(0)) for c in columns], F.lit(0))
    lists = lists.withColumn("max_detected", n).where("max_detected > 0")
    rows = lists.select("*", F.explode(F.sequence(F.lit(1), F.col("max_detected"))).alias(number))
    return rows.withColumns({c: F.get(F.col(f"__{c}"), F.col(number) - 1) for c in columns}).drop(*[f"__{c}" for c in columns])


def several_numbers(df: DataFrame, column: str, number: str = "part_number") -> DataFrame:
    """Rows with more than one valid number in a field split at all known separators; others as they are, numbered 1."""
    split = F.regexp_replace(F.regexp_replace(F.col(column), SEPARATORS, ";"), ";+", ";")
    own = F.when(n_valid(F.col(column)) > 1, F.filter(F.split(split, ";"), lambda p: trimmed(p) != "")).otherwise(F.array(F.col(column)))
    return df.select("*", F.posexplode(own).alias("__at", "__part")).withColumns({column: F.col("__part"), number: F.col("__at") + 1}).drop("__at", "__part")


def repeated(df: DataFrame, columns: list[str], delimiter: str = ";") -> DataFrame:
    """df with each of some delimited columns as an array."""
    return df.withColumns({c: pieces(F.col(c), delimiter) for c in columns})
