"""Scalar functions on columns that Spark has no single function for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trimmed(c: Column) -> Column:
    """Without blanks, tabs and line ends at both ends."""
    return F.btrim(c, F.lit(" \t\r\n"))


def squished(c: Column) -> Column:
    """Trimmed, and white space inside made one blank."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def blank(c: Column) -> Column:
    """Null or nothing but white space."""
    return c.isNull() | (trimmed(c) == "")


def number_in(c: Column) -> Column:
    """The first number in a text, with commas as grouping marks; null without one."""
    found = F.regexp_extract(c, r"-?[0-9][0-9,]*\.?[0-9]*", 0)
    return F.replace(found, F.lit(","), F.lit("")).try_cast("double")


def left_padded(c: Column, width: int, fill: str = "0") -> Column:
    """Padded on the left, never cut."""
    return F.when(F.length(c) >= width, c).otherwise(F.lpad(c, width, fill))


def registry_id(c: Column) -> Column:
    """A number of at most eight digits as an eight-digit text; null if it isn't a number."""
    return left_padded(c.try_cast("int").cast("string"), 8)


def iso_date(c: Column) -> Column:
    """The date in the first ten characters, null if there is none."""
    return F.try_to_date(F.substring(c, 1, 10), "yyyy-MM-dd")


def sheet_date(c: Column) -> Column:
    """A date written as a spreadsheet's serial number or as ISO text."""
    serial = F.date_add(F.to_date(F.lit("1899-12-30")), c.try_cast("int"))
    return F.when(c.rlike("^[0-9]+$"), serial).otherwise(iso_date(c))


def pieces(c: Column, delimiter: str) -> Column:
    """Pieces between delimiters; nothing stands after a last delimiter, and an empty text has no piece."""
    ended = F.regexp_replace(c, delimiter + "$", "")
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(ended, delimiter))


def bits(code: Column, n: int) -> Column:
    """The lowest n bits of a number, lowest first, as booleans."""
    return F.array(*[F.getbit(code, F.lit(i)) == 1 for i in range(n)])


def notice_id(url: Column) -> Column:
    """The notice number (digits, hyphen, year) in an address, or null."""
    return F.nullif(F.regexp_extract(url, "([0-9]{6,8}-[0-9]{4})", 1), F.lit(""))


def period_start(frequency: Column, year: Column, quarter: Column, month: Column) -> Column:
    first = F.when(frequency.startswith("annual"), F.lit(1)).when(frequency.startswith("quarterly"), quarter * 3 - 2).otherwise(month)
    return F.make_date(year, first, F.lit(1))


def period_end(frequency: Column, year: Column, quarter: Column, month: Column) -> Column:
    last = F.when(frequency.startswith("annual"), F.lit(12)).when(frequency.startswith("quarterly"), quarter * 3).otherwise(month)
    return F.last_day(F.make_date(year, last, F.lit(1)))


def clamped(c: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def log_positive(c: Column) -> Column:
    """Natural log of positive numbers, else null."""
    return F.when(c > 0, F.log(c))


def with_transforms(name: str) -> dict[str, Column]:
    """A value, its natural log where positive, and its inverse hyperbolic sine."""
    c = F.col(name)
    return {name: c, f"log_{name}": log_positive(c), f"asinh_{name}": F.asinh(c)}


def year_start(c: Column) -> Column:
    return F.trunc(c, "year")


def years_between(start: Column, end: Column) -> Column:
    """Whole years of 365.25 days."""
    return F.floor(F.datediff(end, start) / F.lit(365.25)).cast("int")


def shown_number(c: Column, digits: int = 0) -> Column:
    return F.format_number(c, digits)


def shown_share(c: Column, digits: int = 1) -> Column:
    return F.concat(F.format_number(c * 100, digits), F.lit("%"))


def shown_mean(mean: Column, sd: Column, digits: int = 2) -> Column:
    return F.concat(F.format_number(mean, digits), F.lit(" ["), F.format_number(sd, digits), F.lit("]"))
