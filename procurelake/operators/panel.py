"""Panels: records valid on a day, employment rows, derived and spliced frequencies, event windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from procurelake.functions.scalars import clamped, period_end, period_start
from procurelake.operators.tables import first_present

PERIOD = "struct<gyldigFra:string,gyldigTil:string>"
COUNTS = ("antalAnsatte", "antalAarsvaerk", "antalInklusivEjere")
BANDS = ("intervalKodeAntalAnsatte", "intervalKodeAntalAarsvaerk", "intervalKodeAntalInklusivEjere")
INDUSTRIES = ", ".join(f"{c} array<struct<branchekode:string,branchetekst:string,periode:{PERIOD}>>" for c in ("hovedbranche", "bibranche1", "bibranche2", "bibranche3"))
_EMPLOYMENT = "array<struct<aar:int,kvartal:int,maaned:int," + ",".join([f"{c}:double" for c in COUNTS] + [f"{c}:string" for c in BANDS]) + ",sidstOpdateret:string>>"
#: The parts of a company document that are read.
COMPANY = f"""cvrNummer bigint, navne array<struct<navn:string,periode:{PERIOD}>>, binavne array<struct<navn:string,periode:{PERIOD}>>,
livsforloeb array<struct<periode:{PERIOD}>>, virksomhedsstatus array<struct<status:string,periode:{PERIOD}>>,
virksomhedsform array<struct<kortBeskrivelse:string,periode:{PERIOD}>>, {INDUSTRIES},
attributter array<struct<type:string,vaerdier:array<struct<vaerdi:string,periode:{PERIOD}>>>>,
aarsbeskaeftigelse {_EMPLOYMENT}, kvartalsbeskaeftigelse {_EMPLOYMENT}, maanedsbeskaeftigelse {_EMPLOYMENT}"""
UNIT = f"pNummer bigint, virksomhedsrelation array<struct<cvrNummer:bigint,periode:{PERIOD}>>, erstMaanedsbeskaeftigelse {_EMPLOYMENT}"


def _day(c: Column) -> Column:
    return F.try_to_date(F.substring(c, 1, 10), "yyyy-MM-dd")


def covers(period: Column, day: Column) -> Column:
    start, end = _day(period["gyldigFra"]), _day(period["gyldigTil"])
    return (start.isNull() | (start <= day)) & (end.isNull() | (end >= day))


def as_of(records: Column, day: Column) -> Column:
    """The record valid on a day: of several the one that began last, the first listed of equals. Null for no day."""
    listed = F.transform(records, lambda r, i: F.struct(F.coalesce(_day(r["periode"]["gyldigFra"]), F.to_date(F.lit("0001-01-01"))).alias("from"), (-i).alias("at"), r.alias("r")))
    valid = F.filter(listed, lambda x: F.coalesce(covers(x["r"]["periode"], day), F.lit(False)))
    best = F.reduce(valid, F.get(valid, F.lit(0)), lambda a, x: F.when((x["from"] > a["from"]) | ((x["from"] == a["from"]) & (x["at"] > a["at"])), x).otherwise(a))
    return best["r"]


def any_covers(records: Column, day: Column) -> Column:
    return F.exists(records, lambda r: covers(r["periode"], day))


def any_overlaps(records: Column, start: Column, end: Column) -> Column:
    """Whether any record is valid at some time of a period."""
    return F.exists(records, lambda r: F.coalesce(_day(r["periode"]["gyldigFra"]) <= end, F.lit(True)) & F.coalesce(_day(r["periode"]["gyldigTil"]) >= start, F.lit(True)))


def companies(df: DataFrame, column: str) -> DataFrame:
    """Company documents (JSON) as structs."""
    return df.withColumn("company", F.from_json(F.col(column), COMPANY))


def name_periods(df: DataFrame, field: str = "navne") -> DataFrame:
    """A row for each validity of a registered name, with the company's life."""
    c = F.col("company")
    starts, ends = F.transform(c["livsforloeb"], lambda x: x["periode"]["gyldigFra"]), F.transform(c["livsforloeb"], lambda x: x["periode"]["gyldigTil"])
    own = df.select(F.lpad(c["cvrNummer"].cast("string"), 8, "0").alias("cvr"), F.array_min(starts).alias("lifecycle_start"), F.when(F.exists(ends, lambda e: e.isNull()), None).otherwise(F.array_max(ends)).alias("lifecycle_end"), F.explode(c[field]).alias("n"))
    return own.select("cvr", F.col("n.navn").alias("name"), _day(F.col("n.periode.gyldigFra")).alias("valid_from"), _day(F.col("n.periode.gyldigTil")).alias("valid_to"), "lifecycle_start", "lifecycle_end")


def history(df: DataFrame) -> DataFrame:
    """Employment rows of company documents: annual, quarterly and monthly, with what was valid at each period's end."""
    c = F.col("company")
    kinds = {"annual": "aarsbeskaeftigelse", "quarterly": "kvartalsbeskaeftigelse", "monthly": "maanedsbeskaeftigelse"}
    none = F.array().cast("array<struct<frequency:string,e:" + _EMPLOYMENT[6:-1] + ">>")

    def tagged(kind: str):
        return lambda e: F.struct(F.lit(kind).alias("frequency"), e.alias("e"))

    all_ = F.concat(*[F.coalesce(F.transform(c[f], tagged(k)), none) for k, f in kinds.items()])
    rows = df.select(F.lpad(c["cvrNummer"].cast("string"), 8, "0").alias("cvr"), "company", F.explode(all_).alias("x"))
    rows = rows.select("cvr", "company", F.col("x.frequency").alias("frequency"), F.col("x.e.aar").alias("year"), F.col("x.e.kvartal").alias("quarter"), F.col("x.e.maaned").alias("month"), *[F.col(f"x.e.{n}").alias(n) for n in COUNTS + BANDS])
    args = (F.col("frequency"), F.col("year"), F.col("quarter"), F.col("month"))
    rows = rows.withColumns({"period_start": period_start(*args), "period_end": period_end(*args)})
    at = F.col("period_end")
    attribute = lambda kind: as_of(F.get(F.filter(c["attributter"], lambda a: a["type"] == kind), F.lit(0))["vaerdier"], at)["vaerdi"]
    alive = any_overlaps(c["livsforloeb"], F.col("period_start"), at)
    context = {
        # companies of some forms state no status: they are active while they live
        "status": F.coalesce(as_of(c["virksomhedsstatus"], at)["status"], F.when(alive, F.lit("AKTIV"))),
        "legal_form": as_of(c["virksomhedsform"], at)["kortBeskrivelse"],
        "capital": attribute("KAPITAL"),
        "capital_currency": attribute("KAPITALVALUTA"),
        "alive": alive,
    }
    for i, f in enumerate(("hovedbranche", "bibranche1", "bibranche2", "bibranche3")):
        kind = as_of(c[f], at)
        context |= {"industry_code" if not i else f"industry_code_{i + 1}": kind["branchekode"], "industry_text" if not i else f"industry_text_{i + 1}": kind["branchetekst"]}
    return rows.withColumns(context).drop("company").withColumn("data_source", F.lit("historical"))


def unit_months(units: DataFrame, column: str) -> DataFrame:
    """Monthly rows of firms summed over the production units that they own at the month's end (else the first owner)."""
    u = units.select(F.from_json(F.col(column), UNIT).alias("u"))
    rows = u.select(F.col("u.pNummer").alias("unit"), F.col("u.virksomhedsrelation").alias("owners"), F.explode("u.erstMaanedsbeskaeftigelse").alias("e"))
    end = F.last_day(F.make_date(F.col("e.aar"), F.col("e.maaned"), F.lit(1)))
    owner = F.coalesce(as_of(F.col("owners"), end)["cvrNummer"], F.get("owners", F.lit(0))["cvrNummer"])
    own = rows.withColumn("cvr", F.lpad(owner.cast("string"), 8, "0"))
    one = F.countDistinct("unit") == 1
    return own.groupBy("cvr", F.col("e.aar").alias("year"), F.col("e.maaned").alias("month")).agg(*[F.sum(f"e.{n}").alias(n) for n in COUNTS], *[F.when(one, F.max(f"e.{n}")).alias(n) for n in BANDS], F.countDistinct("unit").alias("n_units")).withColumns({"frequency": F.lit("monthly"), "data_source": F.lit("new")})


def collapsed(df: DataFrame, keys: list[str], values: list[str], source: str = "data_source", preferred: str = "historical") -> DataFrame:
    """One row a key: each value of the preferred source, else of another; whether sources overlap, and which were used."""
    order = F.when(F.col(source) == preferred, 0).otherwise(1)
    aggs = [first_present(F.col(v), order).alias(v) for v in values]
    out = df.groupBy(*keys).agg(*aggs, F.array_sort(F.collect_set(source)).alias("sources"))
    kinds = dict(df.dtypes)
    return out.withColumns({v: F.col(v).cast(kinds[v]) for v in values} | {"flag_overlap": F.size("sources") > 1, "sources": F.array_join("sources", ";")})


def derived(df: DataFrame, keys: list[str], values: list[str], frequency: str) -> DataFrame:
    """Quarterly or annual means of monthly rows, with months observed, expected and whether all are there."""
    expected = {"quarterly_derived": 3, "annual_derived": 12}[frequency]
    period = ["year", "quarter"] if expected == 3 else ["year"]
    monthly = df.where("frequency = 'monthly'").withColumn("quarter", F.ceil(F.col("month") / 3).cast("int"))
    out = monthly.groupBy(*keys, *period).agg(*[F.avg(v).alias(v) for v in values], F.countDistinct("month").alias("months_observed"))
    return out.withColumns({"frequency": F.lit(frequency), "months_expected": F.lit(expected), "complete": F.col("months_observed") == expected})


def spliced(native: DataFrame, other: DataFrame, keys: list[str], frequency: str) -> DataFrame:
    """Native rows, and derived ones for periods that have none."""
    own = native.withColumn("spliced_from", F.lit("native"))
    rest = other.join(native.select(*keys).distinct(), keys, "left_anti").withColumn("spliced_from", F.lit("derived"))
    return own.unionByName(rest, allowMissingColumns=True).withColumn("frequency", F.lit(frequency))


def events(df: DataFrame, unit: str, date: str) -> DataFrame:
    """Distinct events of units, numbered, with whether none is near: 4 quarters, 1 year, 12 months."""
    own = df.select(unit, F.col(date).cast("date").alias("event_date")).where(F.col(unit).isNotNull() & F.col(date).isNotNull()).distinct()
    y, q, m = F.year("event_date"), F.year("event_date") * 4 + F.quarter("event_date"), F.year("event_date") * 12 + F.month("event_date")
    w = W.partitionBy(unit).orderBy("event_date")
    out = own.withColumns({"event_number": F.row_number().over(w), "n_events": F.count(F.lit(1)).over(W.partitionBy(unit)), "y": y, "q": q, "m": m})
    for name, c, gap in (("isolated_quarter", "q", 4), ("isolated_year", "y", 1), ("isolated_month", "m", 12)):
        before, after = F.col(c) - F.lag(c).over(w), F.lead(c).over(w) - F.col(c)
        out = out.withColumn(name, F.coalesce(before > gap, F.lit(True)) & F.coalesce(after > gap, F.lit(True)))
    return out


def event_panel(panel: DataFrame, found: DataFrame, unit: str, period: str, at: str, bound: int) -> DataFrame:
    """Panel rows of units with events: time since the event, and that time clamped."""
    met = panel.join(found, unit).withColumn("event_time", F.col(period) - F.col(at))
    return met.withColumn("event_bin", clamped(F.col("event_time"), -bound, bound))


def balanced(df: DataFrame, unit: list[str], time: str, low: int, high: int, value: str) -> DataFrame:
    """Rows in a window of units with a positive value at every time of it."""
    inside = df.where(F.col(time).between(low, high) & (F.col(value) > 0))
    full = inside.groupBy(*unit).agg(F.countDistinct(time).alias("__n")).where(F.col("__n") == high - low + 1).select(*unit)
    return inside.join(full, unit, "left_semi")


def inside_sample(df: DataFrame, period: str, at: str, window: int) -> DataFrame:
    """Events whose whole window lies within the panel's periods."""
    ends = df.agg(F.min(period).alias("__low"), F.max(period).alias("__high"))
    return df.crossJoin(F.broadcast(ends)).where((F.col(at) - window >= F.col("__low")) & (F.col(at) + window <= F.col("__high"))).drop("__low", "__high")


def greatest_text(c: Column) -> Column:
    """The greatest text that isn't empty; null without one."""
    return F.max(F.nullif(c, F.lit("")))


def derived_source(c: Column) -> Column:
    """What monthly rows of some sources make: of one source, or spliced; null without any."""
    kinds = F.collect_set(F.nullif(c, F.lit("")))
    return F.when(F.size(kinds) == 0, None).when(kinds == F.array(F.lit("historical")), "derived_historical_monthly").when(kinds == F.array(F.lit("new")), "derived_new_monthly").otherwise("derived_spliced_monthly")


def run_status(keys: DataFrame, rows: DataFrame, units: DataFrame, key: str, **counted: Column) -> DataFrame:
    """For each key whether it was found, its rows, those of some kinds, and its distinct units; 0 where there are none."""
    n = rows.groupBy(key).agg(F.count(F.lit(1)).alias("employment_rows"), *[F.sum(c.cast("int")).alias(k) for k, c in counted.items()])
    u = units.groupBy(key).agg(F.countDistinct("unit").alias("production_units_returned"))
    out = keys.select(key).distinct().join(n, key, "left").join(u, key, "left")
    found = {"found": F.col("employment_rows").isNotNull(), "found_in_units": F.col("production_units_returned").isNotNull()}
    return out.withColumns(found).na.fill(0, ["employment_rows", *counted, "production_units_returned"])


def overlapping(df: DataFrame, found: DataFrame, unit: str, period: str, at: str, event: str, window: int, value: str) -> DataFrame:
    """Balanced windows of all events, near others or not: rows of units within `window` periods of an event whose whole
    window the panel covers, where the unit has a positive value in every period of it."""
    ends = df.agg(F.min(period).alias("__low"), F.max(period).alias("__high"))
    inside = found.crossJoin(F.broadcast(ends)).where((F.col(at) - window >= F.col("__low")) & (F.col(at) + window <= F.col("__high"))).drop("__low", "__high")
    met = df.join(inside, unit).withColumn("event_time", F.col(period) - F.col(at))
    return balanced(met, [unit, event], "event_time", -window, window, value)
