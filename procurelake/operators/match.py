"""Linking entities to registered names: the exact ladder, blocked fuzzy passes, and what is accepted.

The ladder is one job: the joins of all steps are tagged and united, date-invalid candidates go, and
each entity keeps its first step with a candidate left. A fuzzy pass is a job and gets what the
passes before it left. Name keys that are null match null keys, as they do where the results come
from, by distinct dates and not by rows; null_safe=False turns that off.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from procurelake.functions.names import likeness, mentions_collaboration, prepared, without_collaboration
from procurelake.operators.session import settled

#: Days that a registration may begin after, or end before, the date of a match.
TOLERANCE = 730
#: The ladder's steps: columns that have to be equal.
STEPS = (("name_basic", "firm_type"), ("name_no_spaces", "firm_type"), ("name_no_spaces",), ("name_broad",))
#: Fuzzy passes: source of the key, name compared, block, and the score to exceed.
PASSES = (("name", "name_clean", "first_letter", 85.0), ("biname", "name_clean", "first_letter", 85.0), ("name", "name_broad", "broad_first_letter", 86.0), ("biname", "name_broad", "broad_first_letter", 89.0))
#: The number of a step that compares prepared or broad names.
FUZZY_STEPS = {"name_clean": 5, "name_broad": 6}
TOP = 5
SOURCES = {"name": 1, "biname": 2}
FORMS = ("name_basic", "name_clean", "name_no_spaces", "name_broad", "firm_type")


def keyed(names: DataFrame, column: str, source: str) -> DataFrame:
    """Registered names with their forms, tagged with their source."""
    forms = prepared(F.col(column))
    out = names.withColumns({"registered_name": F.col(column), **forms, "name_source": F.lit(source), "source_order": F.lit(SOURCES[source])})
    return out.withColumn("broad_first_letter", F.substring("name_broad", 1, 1)).drop(*([column] if column != "registered_name" else []))


def valid_on(date: Column, start: Column, end: Column, days: int = TOLERANCE) -> Column:
    """Whether a validity, open where null, covers a date within the tolerance; always for no date."""
    return date.isNull() | ((start.isNull() | (date >= F.date_sub(start, days))) & (end.isNull() | (date <= F.date_add(end, days))))


def entities(df: DataFrame, name: str, match_id: str, date: str | None = None) -> DataFrame:
    """(match_id, match_date, forms of the name) of rows to link."""
    forms = prepared(F.col(name))
    day = F.col(date) if date else F.lit(None).cast("date")
    return df.select(F.col(match_id).alias("match_id"), day.alias("match_date"), F.col(name).alias("entity_name"), *[forms[k].alias(k) for k in FORMS], forms["first_letter"].alias("first_letter"), F.substring(forms["name_broad"], 1, 1).alias("broad_first_letter"))


_FOUND = ("cvr", "registered_name", "name_source", "source_order", "valid_from", "valid_to")


def _candidates(rows: DataFrame, key: DataFrame, columns: tuple[str, ...], step: int) -> DataFrame:
    """Date-valid candidates of rows whose columns are all known."""
    left = rows.select("match_id", "match_date", *[F.col(c).alias(f"__{c}") for c in columns])
    met = left.join(key, reduce(lambda a, b: a & b, [F.col(f"__{c}") == F.col(c) for c in columns]))
    met = met.where(valid_on(F.col("match_date"), F.col("valid_from"), F.col("valid_to")))
    return met.select("match_id", "match_date", F.lit(step).alias("step"), *_FOUND)


def _unknown(rows: DataFrame, key: DataFrame, columns: tuple[str, ...], step: int) -> DataFrame:
    """The preferred candidate of rows with an unknown column, which unknown columns of the key equal.

    Rows with equal columns and dates are one problem, so candidates grow with dates and not with rows."""
    some = lambda df: df.where(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns]))
    left = some(rows).select("match_id", "match_date", *[F.col(c).alias(f"__{c}") for c in columns])
    what = ["match_date", *[f"__{c}" for c in columns]]
    asked = left.select(*what).distinct().withColumn("match_id", F.struct(*what))
    met = asked.join(some(key), reduce(lambda a, b: a & b, [F.col(f"__{c}").eqNullSafe(F.col(c)) for c in columns]))
    met = met.where(valid_on(F.col("match_date"), F.col("valid_from"), F.col("valid_to")))
    one = preferred(met.select("match_id", "match_date", F.lit(step).alias("step"), *_FOUND))
    one = one.select(*[F.col("match_id")[w].alias(f"k{w}") for w in what], "step", *_FOUND, "n_candidates", "score")
    on = reduce(lambda a, b: a & b, [F.col(w).eqNullSafe(F.col(f"k{w}")) for w in what])
    return left.join(one, on).select("match_id", "match_date", "step", *_FOUND, "n_candidates", "score")


def preferred(candidates: DataFrame) -> DataFrame:
    """One candidate for each (match_id, step): main names first, then those valid on the day, the earliest, the least number."""
    active = (F.col("valid_from").isNull() | (F.col("match_date") >= F.col("valid_from"))) & (F.col("valid_to").isNull() | (F.col("match_date") <= F.col("valid_to")))
    by = W.partitionBy("match_id", "step")
    order = by.orderBy("source_order", F.coalesce(active, F.lit(False)).desc(), F.col("valid_from").asc_nulls_last(), "cvr", "registered_name", F.col("valid_to").asc_nulls_last())
    ranked = candidates.withColumns({"__r": F.row_number().over(order), "n_candidates": F.size(F.collect_set("cvr").over(by)).cast("long"), "score": F.lit(100.0)})
    return ranked.where("__r = 1").drop("__r")


def exact(rows: DataFrame, key: DataFrame, steps=STEPS, first: int = 1, null_safe: bool = True) -> DataFrame:
    """The exact ladder: each entity's preferred candidate at its first step with any."""
    all_ = reduce(DataFrame.unionByName, [_candidates(rows, key, c, first + i) for i, c in enumerate(steps)])
    lowest = all_.withColumn("__low", F.min("step").over(W.partitionBy("match_id"))).where("step = __low").drop("__low")
    found = preferred(lowest)
    if not null_safe:
        return found
    found = reduce(DataFrame.unionByName, [found, *[_unknown(rows, key, c, first + i) for i, c in enumerate(steps)]])
    return found.withColumn("__low", F.min("step").over(W.partitionBy("match_id"))).where("step = __low").drop("__low")


def collaboration_ladder(rows: DataFrame, key: DataFrame, null_safe: bool = True) -> DataFrame:
    """Steps 5 to 8: names that mention a collaboration, without the mention."""
    some = rows.where(mentions_collaboration(F.col("entity_name")))
    again = entities(some.withColumn("__bare", without_collaboration(F.col("entity_name"))), "__bare", "match_id", "match_date")
    return exact(again, key, first=len(STEPS) + 1, null_safe=null_safe)


def problems(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(distinct problems, entity of each): entities with the same forms and date are one problem."""
    what = ("name_clean", "name_broad", "firm_type", "match_date")
    id_ = F.xxhash64(*what)
    distinct = rows.select(*what, "first_letter", "broad_first_letter").distinct().withColumn("problem", id_)
    return distinct, rows.select("match_id", id_.alias("problem"))


def fuzzy_pass(rows: DataFrame, key: DataFrame, source: str, name: str, block: str, step: int, id_: str = "problem") -> DataFrame:
    """The TOP best candidates of each problem in its block (form and first letter), one for each number, with the ties at the top."""
    left = rows.where(F.col(name).isNotNull()).select(id_, "match_date", F.col(name).alias("__name"), F.col("firm_type").alias("__type"), F.col(block).alias("__block"))
    right = key.where((F.col("name_source") == source) & F.col(name).isNotNull())
    met = left.join(right, (F.col("__type") == F.col("firm_type")) & (F.col("__block") == F.col(block)))
    met = met.where(valid_on(F.col("match_date"), F.col("valid_from"), F.col("valid_to"))).withColumn("score", likeness(F.col("__name"), F.col(name)))
    active = (F.col("valid_from").isNull() | (F.col("match_date") >= F.col("valid_from"))) & (F.col("valid_to").isNull() | (F.col("match_date") <= F.col("valid_to")))
    rank = F.struct((-F.col("score")).alias("s"), (~F.coalesce(active, F.lit(False))).alias("a"), F.coalesce("valid_from", F.to_date(F.lit("9999-12-31"))).alias("f"), F.col("registered_name").alias("n"))
    one = met.groupBy(id_, "cvr").agg(F.min(rank).alias("r"))  # partial sums before the shuffle: one row a number
    by = W.partitionBy(id_)
    order = by.orderBy("r.s", "r.a", "r.f", "cvr")
    out = one.withColumns({"rank": F.row_number().over(order), "__top": F.min("r.s").over(by)})
    out = out.withColumn("n_top", F.sum(F.when(F.col("r.s") == F.col("__top"), 1).otherwise(0)).over(by)).where(F.col("rank") <= TOP)
    return out.select(id_, F.lit(step).alias("step"), F.lit(source).alias("name_source"), "cvr", F.col("r.n").alias("registered_name"), (-F.col("r.s")).alias("score"), "rank", F.col("n_top").alias("n_top_score_candidates"))


def accepted(candidates: DataFrame, threshold: float) -> DataFrame:
    """First candidates above a score, where no other is as good."""
    return candidates.where((F.col("rank") == 1) & (F.col("score") > threshold) & (F.col("n_top_score_candidates") == 1))


def fuzzy(rows: DataFrame, key: DataFrame, passes=PASSES, id_: str = "problem") -> tuple[DataFrame, DataFrame]:
    """(accepted match of each problem, its candidates of all passes up to that): a pass only gets problems that no pass before accepted.

    `pass` counts the passes from 1; `step` says what was compared, as the codes do."""
    left, key = settled(rows), settled(key)
    taken, seen = [], []
    for i, (source, name, block, limit) in enumerate(passes):
        found = settled(fuzzy_pass(left, key, source, name, block, FUZZY_STEPS[name], id_).withColumn("pass", F.lit(i + 1)))
        taken.append(accepted(found, limit))
        seen.append(found)
        left = left.join(taken[-1].select(id_), id_, "left_anti")
    return reduce(DataFrame.unionByName, taken), reduce(DataFrame.unionByName, seen)


def merged(candidates: DataFrame, id_: str = "problem") -> DataFrame:
    """Candidates of all passes ranked anew, one for each number, TOP at most."""
    rank = F.struct((-F.col("score")).alias("s"), F.col("step").alias("p"), F.col("name_source").alias("src"), F.col("rank").alias("r"), F.col("registered_name").alias("n"))
    one = candidates.groupBy(id_, "cvr").agg(F.min(rank).alias("k"))
    out = one.withColumn("rank", F.row_number().over(W.partitionBy(id_).orderBy("k.s", "k.p", "k.src", "k.r", "cvr"))).where(F.col("rank") <= TOP)
    return out.select(id_, "rank", "cvr", (-F.col("k.s")).alias("score"), F.col("k.p").alias("step"), F.col("k.src").alias("name_source"), F.col("k.n").alias("registered_name"))


def wide(candidates: DataFrame, id_: str = "problem", values=("cvr", "registered_name", "score", "step", "name_source")) -> DataFrame:
    """One row a problem with value_1 .. value_5 for each value."""
    at = lambda v, i: F.max(F.when(F.col("rank") == i, F.col(v))).alias(f"{v}_{i}")
    return candidates.groupBy(id_).agg(*[at(v, i) for i in range(1, TOP + 1) for v in values])


def expanded(matches: DataFrame, members: DataFrame) -> DataFrame:
    """Matches of problems for each of their entities."""
    return members.join(matches, "problem").drop("problem")
