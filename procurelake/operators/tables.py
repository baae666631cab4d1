"""Cleaning and aggregation of tables: amounts, first rows, fills, splits, borrowed numbers, shares, overlaps."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from procurelake.functions.scalars import blank
from procurelake.operators.session import settled

#: Kroner a euro, days of a month and a year.
PEG, MONTH, YEAR = 7.46038, 30, 365


def n_distinct(c: Column) -> Column:
    """Distinct values, null counting as one."""
    return F.countDistinct(c) + F.max(c.isNull().cast("int"))


def n_distinct_over(c: Column, w) -> Column:
    return F.size(F.collect_set(c).over(w)) + F.max(c.isNull().cast("int")).over(w)


def joined_values(c: Column, delimiter: str = ";") -> Column:
    """Sorted distinct values in one text; sorted before they become text."""
    return F.array_join(F.transform(F.array_sort(F.collect_set(c)), lambda x: x.cast("string")), delimiter)


def first_present(c: Column, order: Column) -> Column:
    """The first value that is neither null nor empty."""
    own = F.nullif(c.cast("string"), F.lit(""))
    return F.min_by(own, F.when(own.isNotNull(), order))


def first_rows(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key; ties by a hash of the row."""
    w = W.partitionBy(*keys).orderBy(*order, F.xxhash64(*df.columns))
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def numbered(df: DataFrame, order: list[Column], name: str = "row_id") -> DataFrame:
    """Rows numbered from 1 in a total order, without one task for all: range-partitioned, counted, then numbered within."""
    spread = settled(df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()))
    local = W.partitionBy("__p").orderBy(*order)
    own = spread.withColumn("__n", F.row_number().over(local))
    counts = spread.groupBy("__p").count()
    before = counts.select("__p", F.coalesce(F.sum("count").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return own.join(F.broadcast(before), "__p").withColumn(name, F.col("__n") + F.col("__before")).drop("__p", "__n", "__before")


def amounts(final: Column, estimated: Column) -> Column:
    """The final amount, else the estimated one."""
    return F.coalesce(final, estimated)


def euros(kroner: Column) -> Column:
    return kroner / F.lit(PEG)


def kroner(euro: Column) -> Column:
    return euro * F.lit(PEG)


def award_end(award: Column, shortest: Column, longest: Column, awarded: Column) -> Column:
    """Award date and months of 30 days, for what was awarded."""
    return F.when(awarded, F.date_add(award, (F.coalesce(shortest, longest) * MONTH).cast("int")))


def framework_days(days: Column, months: Column, years: Column) -> Column:
    return F.coalesce(days, months * MONTH, years * YEAR)


def annualised(amount: Column, duration: Column, per_year: int, framework: Column) -> Column:
    """An amount a year, of frameworks with a positive duration. per_year: 12 for months, 365 for days."""
    return F.when(framework & (duration > 0), amount / duration * per_year)


def split_evenly(df: DataFrame, tender: str, lot: str, tender_amount: str, lot_amount: str) -> DataFrame:
    """Lots of a tender without any lot amount share the tender's amount."""
    w = W.partitionBy(tender)
    none = F.min(F.col(lot_amount).isNull().cast("int")).over(w) == 1
    return df.withColumn(lot_amount, F.when(none, F.col(tender_amount) / n_distinct_over(F.col(lot), w)).otherwise(F.col(lot_amount)))


def sum_of_lots(df: DataFrame, tender: str, lot: str, tender_amount: str, lot_amount: str, order: str) -> DataFrame:
    """Tenders without any amount get the sum of their lots' first amounts, if every lot has one."""
    w = W.partitionBy(tender)
    first = F.row_number().over(W.partitionBy(tender, lot).orderBy(order)) == 1
    df = df.withColumn("__first", F.when(first, F.col(lot_amount)))
    ok = (F.count(tender_amount).over(w) == 0) & (F.count(lot_amount).over(w) == F.count(F.lit(1)).over(w))
    return df.withColumn(tender_amount, F.when(ok, F.sum("__first").over(w)).otherwise(F.col(tender_amount))).drop("__first")


def split_between(df: DataFrame, group: list[str], entity: str, amount: str, when: Column) -> DataFrame:
    """An amount divided by the distinct entities of its group, where `when` holds."""
    return df.withColumn(amount, F.when(when, F.col(amount) / n_distinct_over(F.col(entity), W.partitionBy(*group))).otherwise(F.col(amount)))


def without_cancelled_twins(df: DataFrame, key: str, cancelled: str) -> DataFrame:
    """Of a lot that is there both cancelled and not, only the row that isn't."""
    w = W.partitionBy(key)
    both = (F.max(F.col(cancelled).cast("int")).over(w) == 1) & (F.min(F.col(cancelled).cast("int")).over(w) == 0)
    return df.withColumn("__both", both).where(~(F.col("__both") & F.col(cancelled))).drop("__both")


def valid_if_any(df: DataFrame, group: list[str], valid: str, order: str, number: str) -> DataFrame:
    """Invalid entries go where their group has a valid one; numbered anew from 1."""
    some = F.max(F.col(valid).cast("int")).over(W.partitionBy(*group)) == 1
    left = df.withColumn("__some", some).where(~F.col("__some") | F.col(valid)).drop("__some")
    return left.withColumn(number, F.row_number().over(W.partitionBy(*group).orderBy(order)))


def borrowed(df: DataFrame, name: str, number: str, valid: str, row: str, *, stated: str | None = None, blank_names: bool = False) -> DataFrame:
    """Blank numbers filled from rows with the same name, if these have exactly one valid number.

    stated: the column that has to be blank (default: the number itself). blank_names: whether an empty name may borrow."""
    own = df.select(name, number, valid, row)
    some = own.where(F.col(name).isNotNull() & (F.lit(blank_names) | (F.col(name) != "")))
    per = some.groupBy(name).agg(F.collect_set(F.when(F.col(valid), F.col(number))).alias("__valid"), n_distinct(F.nullif(F.col(number), F.lit(""))).alias("__total"), joined_values(F.when(F.col(valid), F.col(row))).alias("borrowed_from"))
    one = per.where((F.size("__valid") == 1) & (F.col("__total") > 1)).select(name, F.get("__valid", F.lit(0)).alias("__number"), "borrowed_from")
    met = df.join(one, name, "left")
    gap = blank(F.col(stated or number)) & F.col("__number").isNotNull()
    return met.withColumns({number: F.when(gap, F.col("__number")).otherwise(F.col(number)), "flag_borrowed": gap, "borrowed_from": F.when(gap, F.col("borrowed_from"))}).drop("__number").select(*df.columns, "flag_borrowed", "borrowed_from")


class DuplicateKeys(ValueError):
    """A table of attributes has several rows for a key."""


def refreshed(df: DataFrame, attributes: DataFrame, keys: list[str], columns: list[str] | None = None) -> DataFrame:
    """df with attributes of a table (all, or some columns) replaced by their new values; df's rows stay as many, and several rows of a key are an error."""
    new = [c for c in (columns or attributes.columns) if c not in keys]
    twice = attributes.groupBy(*keys).count().where("count > 1").limit(1).collect()
    if twice:
        raise DuplicateKeys(f"several rows for {twice[0].asDict()}")
    return df.drop(*new).join(attributes.select(*keys, *new), keys, "left")


def looked_up(df: DataFrame, register: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """df with where each (name, number) comes from: the sorted values that a register has for it, joined."""
    own = register.groupBy(*keys).agg(*[joined_values(F.col(c)).alias(c) for c in columns])
    return df.join(own, keys, "left")


def union_all(frames: Iterable[DataFrame]) -> DataFrame:
    """Rows of all frames; columns that one lacks are null."""
    first, *rest = frames
    for f in rest:
        first = first.unionByName(f, allowMissingColumns=True)
    return first


def shares(df: DataFrame, by: list[str], levels: DataFrame | None = None) -> DataFrame:
    """Count and share of each value; `levels` names values that are listed even if they don't occur."""
    n = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    if levels is not None:
        n = levels.join(n, by, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return n.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy()))


def measures(df: DataFrame, **named: Column) -> DataFrame:
    """Several aggregates of a table, a row each: (measure, value)."""
    one = df.agg(*[c.cast("double").alias(k) for k, c in named.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), F.col(k).alias("value")) for k in named])).alias("m")).select("m.*")


def described(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, mean, sd, quartiles, least and most of a value in each group."""
    v = F.col(value)
    q = lambda p, n: F.percentile(v, p).alias(n)
    return df.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), q(0.25, "p25"), q(0.5, "median"), q(0.75, "p75"), F.min(v).alias("least"), F.max(v).alias("most"))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    return df.where(F.col(value).isNotNull()).groupBy(F.width_bucket(F.col(value), F.lit(low), F.lit(high), F.lit(bins)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def coverage(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Rows, present and positive values of some columns in each group."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for c in columns:
        aggs += [F.count(c).alias(f"{c}_present"), F.sum(F.when(F.col(c) > 0, 1).otherwise(0)).alias(f"{c}_positive")]
    return df.groupBy(*by).agg(*aggs)


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Distinct keys in both, in the first only and in the second only."""
    met = a.select(key).distinct().withColumn("__a", F.lit(1)).join(b.select(key).distinct().withColumn("__b", F.lit(1)), key, "full")
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return met.agg(n(F.col("__a").isNotNull() & F.col("__b").isNotNull()).alias("n_both"), n(F.col("__b").isNull()).alias("n_first_only"), n(F.col("__a").isNull()).alias("n_second_only"))


def concordance(old: DataFrame, new: DataFrame, key: str, name: str) -> DataFrame:
    """For each name of the old table whether the new one has it under the same key, and whether the key has any such name."""
    has = new.select(key, name).distinct().withColumn("__hit", F.lit(True))
    met = old.join(has, [key, name], "left").withColumn("same_name", F.coalesce("__hit", F.lit(False))).drop("__hit")
    return met.withColumn("any_same_name", F.max(F.col("same_name").cast("int")).over(W.partitionBy(key)) == 1)


def pairs_in_group(df: DataFrame, group: str, item: str) -> DataFrame:
    """Distinct items of a group in pairs (a < b) with their edit distance. For small groups: several numbers of one name."""
    own = df.select(group, item).distinct()
    met = own.withColumnRenamed(item, "a").join(own.withColumnRenamed(item, "b"), group).where("a < b")
    return met.withColumn("distance", F.levenshtein("a", "b"))


def sampled(df: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """n random rows."""
    return df.orderBy(F.rand(seed)).limit(n)
