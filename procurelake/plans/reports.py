"""Report queries, each over a matched table or its like: what they count is a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from procurelake.functions.scalars import log_positive
from procurelake.operators import tables as t

#: Words of neighbouring countries' firm names, and the last year of an older register key.
NEIGHBOUR_TERMS = r"(?i)(?<!\p{Alnum})(?:ab|aktiebolag|och|sverige|svenska|sweden)(?!\p{Alnum})"
KEY_END = 2020


def flag_sums(df: DataFrame, prefix: str = "flag_cvr_") -> DataFrame:
    """How many rows each flag is set in."""
    flags = [c for c in df.columns if c.startswith(prefix)]
    return t.measures(df, **{c: F.sum(F.col(c).cast("int")) for c in flags})


def cleaning_summary(df: DataFrame, base: Column, **named: Column) -> DataFrame:
    """Counts of conditions with their share of a base count."""
    out = t.measures(df, __base=F.sum(base.cast("int")), **{k: F.sum(c.cast("int")) for k, c in named.items()})
    total = F.max(F.when(F.col("measure") == "__base", F.col("value"))).over(W.partitionBy())
    return out.withColumn("share", F.col("value") / total).where("measure != '__base'")


def examples(df: DataFrame, steps: list[str], n: int) -> DataFrame:
    """Names through the steps of their cleaning, a row each."""
    pairs = ", ".join(f"'{s}', `{s}`" for s in steps)
    return df.limit(n).selectExpr(f"stack({len(steps)}, {pairs}) AS (step, value)")


def method_shares(df: DataFrame, method: str, levels: list[str]) -> DataFrame:
    """Share of each method, those without a row too."""
    spark = df.sparkSession
    return t.shares(df, [method], spark.createDataFrame([(x,) for x in levels], f"{method} string"))


def row_level_result(df: DataFrame, row: str, method: str, expanded: str) -> DataFrame:
    """The best result of each source row's entities: expanded, exact, fuzzy, none."""
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    best = F.when(some(F.col(expanded)), "expanded").when(some(F.col(method) == "exact"), "exact").when(some(F.col(method) == "fuzzy"), "fuzzy").otherwise("none")
    return t.shares(df.groupBy(row).agg(best.alias("result")), ["result"])


def shortest_example(df: DataFrame, reason: str, group: str, name: str, part: str, order: str) -> DataFrame:
    """One example for each reason: the group with the shortest name, its parts in one text."""
    own = df.groupBy(reason, group, name).agg(F.sort_array(F.collect_list(F.struct(order, part))).alias("p"))
    own = own.withColumn("parts", F.array_join(F.transform("p", lambda x: x[part]), "; ")).drop("p")
    return t.first_rows(own, [reason], [F.length(name), F.col(name), F.col(group)])


def numbers_per_name(df: DataFrame, name: str, number: str) -> DataFrame:
    """How many names have how many numbers."""
    per = df.where(F.col(name).isNotNull() & F.col(number).isNotNull()).groupBy(name).agg(F.countDistinct(number).alias("n_numbers"))
    return per.groupBy("n_numbers").agg(F.count(F.lit(1)).alias("n_names"))


def typo_distances(df: DataFrame, name: str, number: str) -> DataFrame:
    """Of names with several numbers, the share with a pair at each edit distance."""
    pairs = t.pairs_in_group(df.where(F.col(name).isNotNull() & F.col(number).isNotNull()), name, number)
    total = pairs.agg(F.countDistinct(name).alias("__n"))
    return pairs.groupBy("distance").agg(F.countDistinct(name).alias("n_names")).crossJoin(F.broadcast(total)).select("distance", "n_names", (F.col("n_names") / F.col("__n")).alias("share"))


def recoverable(df: DataFrame, name: str, number: str, distance: int = 1) -> DataFrame:
    """Rows that a typo may explain: of each such pair the less frequent number's rows."""
    n = df.groupBy(name, number).agg(F.count(F.lit(1)).alias("n"))
    pairs = t.pairs_in_group(df.where(F.col(name).isNotNull() & F.col(number).isNotNull()), name, number).where(F.col("distance") == distance)
    a = n.select(name, F.col(number).alias("a"), F.col("n").alias("na"))
    b = n.select(name, F.col(number).alias("b"), F.col("n").alias("nb"))
    return pairs.join(a, [name, "a"], "left").join(b, [name, "b"], "left").agg(F.count(F.lit(1)).alias("n_pairs"), F.sum(F.least("na", "nb")).alias("n_rows"))


def long_scores(df: DataFrame, id_: str, n: int = 5) -> DataFrame:
    """score_1 .. score_n as rows."""
    pairs = ", ".join(f"{i}, score_{i}" for i in range(1, n + 1))
    return df.selectExpr(id_, f"stack({n}, {pairs}) AS (rank, score)").where("score IS NOT NULL")


def unmatched_by_year(df: DataFrame, year: Column, unmatched: Column) -> DataFrame:
    return df.groupBy(year.alias("year")).agg(F.count(F.lit(1)).alias("n"), F.avg(unmatched.cast("int")).alias("unmatched_rate"))


def unmatched_around_key_end(df: DataFrame, year: Column, unmatched: Column, last: int = KEY_END) -> DataFrame:
    return df.groupBy((year <= last).alias("within_key")).agg(F.count(F.lit(1)).alias("n"), F.avg(unmatched.cast("int")).alias("unmatched_rate"))


def term_use(df: DataFrame, name: str, status: str, pattern: str = NEIGHBOUR_TERMS) -> DataFrame:
    """Names and rows with or without terms, by status."""
    return df.groupBy(F.coalesce(F.col(name).rlike(pattern), F.lit(False)).alias("has_term"), status).agg(F.countDistinct(name).alias("n_names"), F.count(F.lit(1)).alias("n_rows"))


def lots(df: DataFrame, keys: list[str], amounts: list[str], order: list[Column]) -> DataFrame:
    """One row a lot, with logs of positive amounts."""
    return t.first_rows(df, keys, order).withColumns({f"log_{a}": log_positive(F.col(a)) for a in amounts})


def per_unit(df: DataFrame, by: list[str], unit: str, thing: str, name: str) -> DataFrame:
    """Mean and sd of the distinct things that each unit has."""
    per = df.where(F.col(unit).isNotNull()).groupBy(*by, unit).agg(F.countDistinct(thing).alias("n"))
    return per.groupBy(*by).agg(F.count(F.lit(1)).alias(f"n_{unit}"), F.avg("n").alias(f"mean_{name}"), F.stddev_samp("n").alias(f"sd_{name}"))


def overview(df: DataFrame, by: list[str], year: Column, firm: str, tender: str, amount: str) -> DataFrame:
    """Years, rows, firms, tenders and amounts of each group."""
    a = F.col(amount)
    main = df.groupBy(*by).agg(F.concat(F.min(year), F.lit("-"), F.max(year)).alias("years"), F.count(F.lit(1)).alias("n_rows"), F.countDistinct(firm).alias("n_firms"), F.countDistinct(tender).alias("n_tenders"), F.avg(a / 1e6).alias("mean_millions"), F.stddev_samp(a / 1e6).alias("sd_millions"), F.avg(log_positive(a)).alias("mean_log"))
    return main.join(per_unit(df, by, firm, tender, "tenders"), by, "left")


def by_sample(df: DataFrame, samples: dict[str, Column]) -> DataFrame:
    """df once for each sample that a row is in; samples may overlap."""
    marks = F.array(*[F.when(c, F.lit(n)) for n, c in samples.items()])
    return df.withColumn("sample", F.explode(F.filter(marks, lambda x: x.isNotNull())))


def structure(df: DataFrame, tender: str, lot: str, tender_amount: str, lot_amount: str) -> DataFrame:
    """Lots a tender, share of tenders with several, and how the sum of lots goes with the tender's amount."""
    complete = F.when(F.count(lot_amount) == F.count(F.lit(1)), F.sum(lot_amount))
    per = df.groupBy(tender).agg(F.countDistinct(lot).alias("n_lots"), complete.alias("lots_sum"), F.max(tender_amount).alias("amount"))
    both = F.col("lots_sum").isNotNull() & F.col("amount").isNotNull()
    return per.agg(F.avg("n_lots").alias("mean_lots"), F.percentile("n_lots", 0.5).alias("median_lots"), F.max("n_lots").alias("most_lots"), F.avg((F.col("n_lots") > 1).cast("int")).alias("several_share"), F.corr(F.when(both, F.col("lots_sum")), F.when(both, F.col("amount"))).alias("correlation"))


def several_winners(df: DataFrame, tender: str, lot: str, winner: str) -> DataFrame:
    """Shares of lots, and of tenders, with several winners."""
    per = df.groupBy(tender, lot).agg(F.countDistinct(winner).alias("n"))
    of_tender = per.groupBy(tender).agg(F.bool_or(F.col("n") > 1).alias("any"), F.count(F.lit(1)).alias("k"), F.sum((F.col("n") > 1).cast("int")).alias("m"))
    return of_tender.agg((F.sum("m") / F.sum("k")).alias("lot_share"), F.avg(F.col("any").cast("int")).alias("tender_share"))


def found_in_panel(df: DataFrame, panel: DataFrame, by: list[str], firm: str) -> DataFrame:
    """Share of each group's firms that a panel has."""
    own = df.where(F.col(firm).isNotNull()).select(*by, firm).distinct()
    hit = panel.select(firm).distinct().withColumn("__hit", F.lit(1))
    return own.join(hit, firm, "left").groupBy(*by).agg(F.count(F.lit(1)).alias("n_firms"), F.avg(F.coalesce("__hit", F.lit(0))).alias("share_found"))


def missing(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Share of nulls of some columns in each group."""
    return df.groupBy(*by).agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in columns])


def best_old_name_scores(old: DataFrame, new: DataFrame, key: str, name: str, limits: tuple[float, ...] = (85, 86, 89)) -> DataFrame:
    """Best likeness of each old name to any new one of its key: median, and shares above some limits."""
    from procurelake.functions.names import likeness

    met = old.select(key, F.col(name).alias("__old")).join(new.select(key, F.col(name).alias("__new")).distinct(), key)
    best = met.groupBy(key, "__old").agg(F.max(likeness(F.col("__old"), F.col("__new"))).alias("best"))
    return best.agg(F.count(F.lit(1)).alias("n"), F.percentile("best", 0.5).alias("median"), *[F.avg((F.col("best") > x).cast("int")).alias(f"above_{x:g}") for x in limits])


def country_means(df: DataFrame, year: str, country: str, value: str) -> DataFrame:
    """Means by country of the rows for the mean of all years, and their average."""
    own = df.where(F.col(year) == "Mean").select(country, F.col(value).try_cast("double").alias("mean_value"))
    return own.withColumn("all_countries", F.avg("mean_value").over(W.partitionBy()))


def lots_by_year(df: DataFrame, by: list[str], day: str) -> DataFrame:
    """Lots of each group by the year of a date."""
    return df.where(F.col(day).isNotNull()).groupBy(*by, F.year(day).alias("year")).agg(F.count(F.lit(1)).alias("n_lots"))


def review_reasons(df: DataFrame, method: str = "match_method", candidates: str = "n_candidates") -> DataFrame:
    """Candidates that a person should look at, by the reason, with their share of all candidates."""
    found = F.col(method).isNotNull()
    named = {"Fuzzy match": F.col(method) == "fuzzy", "Ambiguous exact match": (F.col(method) == "exact") & (F.col(candidates) > 1), "No automatic match": ~found}
    return cleaning_summary(df, F.lit(True), **named).withColumnRenamed("measure", "reason")


def split_results(df: DataFrame, row: str, eligible: str, expanded: str) -> DataFrame:
    """(measure, n, share, share_of) of the split of names: rows eligible, rows split, and firm rows that this made."""
    distinct = lambda c: F.countDistinct(F.when(F.col(c), F.col(row)))
    one = df.agg(distinct(eligible).alias("eligible"), distinct(expanded).alias("split"), F.sum(F.col(expanded).cast("long")).alias("firms"), F.countDistinct(row).alias("rows"), F.count(F.lit(1)).alias("all"))
    kinds = (("rows eligible for the split", "eligible", "rows", "candidates"), ("rows with one accepted split", "split", "eligible", "eligible rows"), ("firm rows of accepted splits", "firms", "all", "output rows"))
    made = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(a).alias("n"), (F.col(a) / F.col(b)).alias("share"), F.lit(of).alias("share_of")) for m, a, b, of in kinds])
    return one.select(F.explode(made).alias("m")).select("m.*")


def failure_source(concordance: DataFrame, key: str) -> DataFrame:
    """For keys with a pair that isn't found: pairs found or not, by whether the key has any that is."""
    w = W.partitionBy(key)
    df = concordance.withColumns({"__lost": F.max((~F.col("same_name")).cast("int")).over(w)}).where("__lost = 1")
    return df.groupBy("same_name", "any_same_name").agg(F.count(F.lit(1)).alias("n"))


def distribution(df: DataFrame, by: list[str], unit: str, thing: str, name: str = "n_things") -> DataFrame:
    """How many units of each group have how many distinct things."""
    per = df.where(F.col(unit).isNotNull()).groupBy(*by, unit).agg(F.countDistinct(thing).alias(name))
    return per.groupBy(*by, name).agg(F.count(F.lit(1)).alias("n_units"))
