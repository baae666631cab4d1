"""Business-register identifiers: eight digits, kept as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from procurelake.functions.scalars import blank, trimmed

#: Numbers that stand for "no number".
PLACEHOLDERS = ("00000000", "11111111", "12345678", "99999999")


def candidate(c: Column) -> Column:
    """A raw identifier without any white space; null if nothing is left."""
    return F.nullif(F.regexp_replace(c.cast("string"), r"\s+", ""), F.lit(""))


def valid_numbers(c: Column) -> Column:
    """All runs of exactly eight digits, in order; null without one."""
    runs = F.regexp_extract_all(candidate(c), F.lit(r"(?<!\d)\d{8}(?!\d)"), 0)
    return F.when(F.size(runs) > 0, runs)


def n_valid(c: Column) -> Column:
    return F.coalesce(F.size(F.array_distinct(valid_numbers(c))), F.lit(0))


def recovered(c: Column, country: Column, n_raw: Column) -> Column:
    """The eight digits of a formatted Danish number in which no run of eight was found."""
    digits = F.regexp_replace(c, "[^0-9]", "")
    ok = ~blank(c) & (F.upper(trimmed(country)) == "DK") & (n_raw == 0) & (F.length(digits) == 8) & ~digits.isin(*PLACEHOLDERS)
    return F.when(ok, digits)


def standardised(c: Column) -> dict[str, Column]:
    """A stated number cleaned step by step; each flag is about what the steps before left."""
    no_space = F.regexp_replace(c, r"(?U)\s", "")
    no_letter = F.regexp_replace(no_space, r"\p{IsAlphabetic}", "")
    clean = F.regexp_replace(no_letter, r"\p{IsPunctuation}", "")
    flag = lambda x, p: F.coalesce(x.rlike(p), F.lit(False))
    return {
        "cvr_clean": F.nullif(clean, F.lit("")),
        "flag_cvr_whitespace": flag(c, r"(?U)\s"),
        "flag_cvr_alpha": flag(no_space, r"\p{IsAlphabetic}"),
        "flag_cvr_punct": flag(no_letter, r"\p{IsPunctuation}"),
    }


def raw_flags(c: Column) -> dict[str, Column]:
    """The same flags, all about the raw candidate; a placeholder is no number."""
    flag = lambda p: F.coalesce(c.rlike(p), F.lit(False))
    first = F.get(valid_numbers(c), F.lit(0))
    return {
        "cvr_clean": F.when(~first.isin(*PLACEHOLDERS), first),
        "flag_cvr_whitespace": flag(r"(?U)\s"),
        "flag_cvr_alpha": flag(r"\p{IsAlphabetic}"),
        "flag_cvr_punct": flag(r"\p{IsPunctuation}"),
    }


def quality_flags(original: Column, clean: Column, name: Column, country: Column, *, placeholders: bool) -> dict[str, Column]:
    """Flags of an entity row. `placeholders`: whether these count as valid numbers."""
    eight = F.coalesce(clean.rlike("^[0-9]{8}$"), F.lit(False))
    valid = eight if placeholders else eight & ~F.coalesce(clean.isin(*PLACEHOLDERS), F.lit(False))
    foreign = F.coalesce(F.upper(trimmed(country)) != "DK", F.lit(False))
    return {
        "flag_cvr_valid": valid,
        "flag_cvr_changed": F.coalesce(original != clean, F.lit(False)),
        "flag_cvr_missing": blank(clean),
        "flag_name_missing": blank(name),
        "flag_country_missing": blank(country),
        "flag_foreign": foreign,
        "review_cvr_invalid": ~blank(clean) & ~valid & ~foreign,
        "review_cvr_missing_domestic": blank(clean) & ~foreign,
    }
