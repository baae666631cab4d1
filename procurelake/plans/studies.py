"""Queries of panels, their regressions, registers and example reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from procurelake.functions.scalars import with_transforms, year_start, years_between
from procurelake.operators import panel, stats, tables
from procurelake.plans import reports
from procurelake.plans.catalogue import _r, query, source, with_

# regressions: one dummy (the years after the first), firms absorbed, errors by firm; SQL has the closed form

_YEARS = "y AS (SELECT firm, CAST(year(day) AS INTEGER) AS year, sum(amount) AS staff, CAST(count(*) AS DOUBLE) AS n FROM awards GROUP BY ALL), f AS (SELECT firm, min(year) AS first FROM y GROUP BY firm), "
_BETA = (
    "x AS (SELECT firm, CAST(firm AS INTEGER) % 2 AS half, CAST(year > first AS INTEGER) AS d, staff, ln(staff) AS log_staff, asinh(staff) AS asinh_staff FROM y JOIN f USING (firm)), "
    "l AS (UNPIVOT x ON staff, log_staff, asinh_staff INTO NAME outcome VALUE v), "
    "m AS (SELECT outcome, half, firm, v - avg(v) OVER w AS v, d - avg(d) OVER w AS d FROM l WINDOW w AS (PARTITION BY outcome, firm)), "
    "b AS (SELECT outcome, half, sum(v * d) / sum(d * d) AS beta, sum(d * d) AS xx, count(*) AS n FROM m GROUP BY ALL), "
    "s AS (SELECT m.outcome, m.half, m.firm, sum(d * (v - beta * d)) AS score FROM m JOIN b USING (outcome, half) GROUP BY ALL), "
    "e AS (SELECT outcome, half, sqrt(sum(score * score) * count(*) / (count(*) - 1)) AS se FROM s GROUP BY ALL) "
    "SELECT outcome, CAST(half AS VARCHAR) AS split, 1 AS time, {0} AS estimate, {1} AS error, n FROM b JOIN e USING (outcome, half)"
)


def _firm_years(spark, sf_dir):
    df = source(spark, sf_dir, "awards").withColumn("year", F.year("day"))
    first = df.groupBy("firm").agg(F.min("year").alias("first"))
    years = df.groupBy("firm", "year").agg(F.sum("amount").alias("staff"), F.count("*").cast("double").alias("n"))
    return panel.event_panel(years, first, "firm", "year", "first", 1).withColumn("half", F.col("firm").cast("int") % 2)


@query("event_study", with_("awards") + ", " + _YEARS + _BETA.format("round(beta, 5)", "round(se / xx, 5)"))
def event_study(spark, sf_dir):
    df = _firm_years(spark, sf_dir).withColumns(with_transforms("staff"))
    out = stats.studies(df, ["staff", "log_staff", "asinh_staff"], "event_bin", 0, ["firm"], "firm", "half")
    return out.select("outcome", "split", "time", _r(F.col("estimate"), 5).alias("estimate"), _r(F.col("error"), 5).alias("error"), "n")


# panels

_QUARTERS = "q AS (SELECT firm, CAST(year(day) * 4 + quarter(day) AS INTEGER) AS q, sum(amount) AS staff FROM awards GROUP BY ALL)"


def _firm_quarters(spark, sf_dir):
    df = source(spark, sf_dir, "awards").withColumn("q", F.year("day") * 4 + F.quarter("day"))
    return df, df.groupBy("firm", "q").agg(F.sum("amount").alias("staff"))


@query("overlapping_windows", with_("awards") + f", {_QUARTERS}, e AS (SELECT DISTINCT firm, q AS mid FROM q), b AS (SELECT min(q) AS low, max(q) AS high FROM q), w AS (SELECT e.firm, e.mid, q.q - e.mid AS event_time, staff FROM e JOIN q USING (firm), b WHERE e.mid - 1 >= low AND e.mid + 1 <= high AND q.q BETWEEN e.mid - 1 AND e.mid + 1 AND staff > 0), k AS (SELECT firm, mid FROM w GROUP BY ALL HAVING count(*) = 3) SELECT firm, mid, CAST(event_time AS INTEGER) AS event_time, round(staff, 2) AS staff FROM w SEMI JOIN k USING (firm, mid)")
def overlapping_windows(spark, sf_dir):
    _, quarters = _firm_quarters(spark, sf_dir)
    found = quarters.select("firm", F.col("q").alias("mid")).distinct().withColumn("event", F.col("mid"))
    out = panel.overlapping(quarters, found, "firm", "q", "mid", "event", 1, "staff")
    return out.select("firm", "mid", "event_time", _r(F.col("staff"), 2).alias("staff"))


@query("panel_sizes", with_("awards") + f", {_QUARTERS}, e AS (SELECT DISTINCT firm, q AS mid FROM q), b AS (SELECT min(q) AS low, max(q) AS high FROM q), w AS (SELECT e.firm, e.mid, k, q.q FROM e JOIN q USING (firm), b, (SELECT unnest([1, 2]) AS k) WHERE e.mid - k >= low AND e.mid + k <= high AND q.q BETWEEN e.mid - k AND e.mid + k AND staff > 0), f AS (SELECT k, firm, mid FROM w GROUP BY ALL HAVING count(*) = 2 * k + 1) SELECT k, count(*) AS n_events, count(DISTINCT firm) AS n_firms FROM f GROUP BY k")
def panel_sizes(spark, sf_dir):
    _, quarters = _firm_quarters(spark, sf_dir)
    found = quarters.select("firm", F.col("q").alias("mid")).distinct().withColumn("event", F.col("mid"))
    sizes = [panel.overlapping(quarters, found, "firm", "q", "mid", "event", k, "staff").select("firm", "mid").distinct().withColumn("k", F.lit(k)) for k in (1, 2)]
    return tables.union_all(sizes).groupBy("k").agg(F.count("*").alias("n_events"), F.countDistinct("firm").alias("n_firms"))


@query("first_award_quarters", with_("awards") + f", {_QUARTERS}, f AS (SELECT firm, min(CAST(year(day) * 4 + quarter(day) AS INTEGER)) AS first, arg_min(kind, (day, tender)) AS kind FROM awards GROUP BY firm) SELECT kind, greatest(-8, least(8, q - first)) AS event_bin, count(*) AS n, round(avg(staff), 6) AS staff, round(avg(ln(staff)), 6) AS log_staff, round(avg(asinh(staff)), 6) AS asinh_staff FROM q JOIN f USING (firm) GROUP BY ALL")
def first_award_quarters(spark, sf_dir):
    df, quarters = _firm_quarters(spark, sf_dir)
    first = tables.first_rows(df, ["firm"], [F.col("day"), F.col("tender")]).select("firm", F.col("q").alias("first"), "kind")
    met = panel.event_panel(quarters, first, "firm", "q", "first", 8).withColumns(with_transforms("staff"))
    out = met.groupBy("kind", "event_bin").agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in ("staff", "log_staff", "asinh_staff")])
    return out.select("kind", "event_bin", "n", _r(F.col("staff"), 6).alias("staff"), _r(F.col("log_staff"), 6).alias("log_staff"), _r(F.col("asinh_staff"), 6).alias("asinh_staff"))


@query("derived_sources", with_("awards") + ", s AS (SELECT firm, CASE month(day) % 3 WHEN 0 THEN 'historical' WHEN 1 THEN 'new' ELSE '' END AS src, kind FROM awards WHERE CAST(firm AS INTEGER) % 3 <> 0 OR month(day) % 3 <> 1) SELECT firm, CASE WHEN count(DISTINCT nullif(src, '')) = 0 THEN NULL WHEN count(DISTINCT nullif(src, '')) = 2 THEN 'derived_spliced_monthly' WHEN max(src) = 'new' THEN 'derived_new_monthly' ELSE 'derived_historical_monthly' END AS source, nullif(max(src), '') AS greatest FROM s GROUP BY firm")
def derived_sources(spark, sf_dir):
    n = F.month("day") % 3
    df = source(spark, sf_dir, "awards").withColumn("src", F.when(n == 0, "historical").when(n == 1, "new").otherwise("")).where((F.col("firm").cast("int") % 3 != 0) | (n != 1))
    return df.groupBy("firm").agg(panel.derived_source(F.col("src")).alias("source"), panel.greatest_text(F.col("src")).alias("greatest"))


@query("run_status", with_("awards") + ", r AS (SELECT firm, count(*) AS employment_rows, CAST(count(*) FILTER (amount > 100000) AS BIGINT) AS large_rows FROM awards WHERE CAST(firm AS INTEGER) % 4 <> 0 GROUP BY firm), u AS (SELECT firm, count(DISTINCT kind) AS production_units_returned FROM awards WHERE CAST(firm AS INTEGER) % 3 = 0 GROUP BY firm) SELECT CAST(c_custkey AS VARCHAR) AS firm, coalesce(employment_rows, 0) AS employment_rows, coalesce(large_rows, 0) AS large_rows, coalesce(production_units_returned, 0) AS production_units_returned, r.firm IS NOT NULL AS found, u.firm IS NOT NULL AS found_in_units FROM customer LEFT JOIN r ON r.firm = CAST(c_custkey AS VARCHAR) LEFT JOIN u ON u.firm = CAST(c_custkey AS VARCHAR)")
def run_status(spark, sf_dir):
    df, n = source(spark, sf_dir, "awards"), F.col("firm").cast("int")
    keys = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").cast("string").alias("firm"))
    return panel.run_status(keys, df.where(n % 4 != 0), df.where(n % 3 == 0).withColumn("unit", F.col("kind")), "firm", large_rows=F.col("amount") > 100000)


@query("number_sources", "WITH k AS (SELECT p_name AS name, CAST(p_size AS VARCHAR) AS cvr, p_partkey % 3 AS origin FROM part), r AS (SELECT name, cvr, string_agg(DISTINCT CAST(origin AS VARCHAR), ';' ORDER BY CAST(origin AS VARCHAR)) AS origin FROM k WHERE origin < 2 GROUP BY ALL) SELECT p_partkey AS id, r.origin FROM part LEFT JOIN r ON r.name = p_name AND r.cvr = CAST(p_size AS VARCHAR)")
def number_sources(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("p_partkey AS id", "p_name AS name", "CAST(p_size AS STRING) AS cvr", "p_partkey % 3 AS origin")
    return tables.looked_up(df.select("id", "name", "cvr"), df.where("origin < 2"), ["name", "cvr"], ["origin"]).select("id", "origin")


# company documents

_FROM = "concat('200', CAST(c_custkey % 10 AS STRING), '-03-01')"
_P = "concat('{{\"gyldigFra\":', {0}, ',\"gyldigTil\":', {1}, '}}')"


def _period(start: str, end: str) -> str:
    quoted = lambda x: "'null'" if x == "null" else f"concat('\"', {x}, '\"')"
    return f"concat('{{\"gyldigFra\":', {quoted(start)}, ',\"gyldigTil\":', {quoted(end)}, '}}')"


_DOC = (
    "concat('{\"cvrNummer\":', CAST(c_custkey AS STRING), ',\"livsforloeb\":[{\"periode\":', " + _period("'2001-01-01'", "'2008-06-30'") + ", '}],\"virksomhedsstatus\":[', CASE WHEN c_custkey % 2 = 0 THEN concat('{\"status\":\"NORMAL\",\"periode\":', " + _period("'2000-01-01'", _FROM)
    + ", '},{\"status\":\"UNDER KONKURS\",\"periode\":', " + _period(_FROM, "null") + ", '}') ELSE '' END, '],\"virksomhedsform\":[{\"kortBeskrivelse\":\"APS\",\"periode\":', " + _period("'1999-01-01'", "null") + ", '},{\"kortBeskrivelse\":\"A/S\",\"periode\":', " + _period(_FROM, "null")
    + ", '}],\"hovedbranche\":[{\"branchekode\":\"620100\",\"branchetekst\":\"IT\",\"periode\":', " + _period("'1999-01-01'", "'2004-12-31'") + ", '}],\"bibranche2\":[{\"branchekode\":\"', CAST(c_custkey % 7 AS STRING), '\",\"branchetekst\":\"x\",\"periode\":', " + _period("null", "null")
    + ", '}],\"attributter\":[{\"type\":\"KAPITALVALUTA\",\"vaerdier\":[{\"vaerdi\":\"EUR\",\"periode\":', " + _period("'2003-01-01'", "null") + ", '}]},{\"type\":\"KAPITAL\",\"vaerdier\":[{\"vaerdi\":\"', CAST(c_custkey AS STRING), '.00\",\"periode\":', " + _period("'1999-01-01'", "null")
    + ", '}]}],\"aarsbeskaeftigelse\":[{\"aar\":2002,\"antalAnsatte\":', CAST(c_custkey AS STRING), '},{\"aar\":2009,\"antalAnsatte\":1}],\"kvartalsbeskaeftigelse\":[{\"aar\":2005,\"kvartal\":2,\"antalAnsatte\":3}],\"maanedsbeskaeftigelse\":[{\"aar\":2008,\"maaned\":8,\"antalAnsatte\":4}],"
    "\"navne\":[{\"navn\":\"Firm ', CAST(c_custkey AS STRING), '\",\"periode\":', " + _period("'2001-01-01'", "null") + ", '}],\"binavne\":[{\"navn\":\"By\",\"periode\":', " + _period("'2001-01-01'", "'2002-02-02'") + ", '}]}')"
)


def _documents(spark, sf_dir):
    return panel.companies(spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("c_custkey AS id", f"{_DOC} AS doc"), "doc")


_HISTORY = (
    "WITH p AS (SELECT * FROM (VALUES ('annual', 2002, NULL, NULL, CAST('2002-01-01' AS DATE), CAST('2002-12-31' AS DATE), NULL), ('annual', 2009, NULL, NULL, CAST('2009-01-01' AS DATE), CAST('2009-12-31' AS DATE), 1), ('quarterly', 2005, 2, NULL, CAST('2005-04-01' AS DATE), CAST('2005-06-30' AS DATE), 3), "
    "('monthly', 2008, NULL, 8, CAST('2008-08-01' AS DATE), CAST('2008-08-31' AS DATE), 4)) AS t(frequency, year, quarter, month, s, e, k)), c AS (SELECT c_custkey AS id, make_date(2000 + CAST(c_custkey % 10 AS INTEGER), 3, 1) AS f FROM customer) "
    "SELECT lpad(CAST(id AS VARCHAR), 8, '0') AS cvr, frequency, year, quarter, month, e AS period_end, CAST(coalesce(k, id) AS DOUBLE) AS employees, CASE WHEN id % 2 = 0 THEN CASE WHEN e >= f THEN 'UNDER KONKURS' ELSE 'NORMAL' END WHEN s <= '2008-06-30' THEN 'AKTIV' END AS status, "
    "CASE WHEN e >= f THEN 'A/S' ELSE 'APS' END AS legal_form, s <= '2008-06-30' AS alive, CASE WHEN e <= '2004-12-31' THEN '620100' END AS industry_code, CAST(id % 7 AS VARCHAR) AS industry_code_3, CAST(id AS VARCHAR) || '.00' AS capital, CASE WHEN e >= '2003-01-01' THEN 'EUR' END AS capital_currency FROM c, p"
)


@query("employment_history", _HISTORY)
def employment_history(spark, sf_dir):
    return panel.history(_documents(spark, sf_dir)).select("cvr", "frequency", "year", "quarter", "month", "period_end", F.col("antalAnsatte").alias("employees"), "status", "legal_form", "alive", "industry_code", "industry_code_3", "capital", "capital_currency")


@query("name_periods", "SELECT lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS cvr, CASE k WHEN 1 THEN 'Firm ' || c_custkey ELSE 'By' END AS name, CAST('2001-01-01' AS DATE) AS valid_from, CASE k WHEN 2 THEN CAST('2002-02-02' AS DATE) END AS valid_to, CASE k WHEN 1 THEN 'name' ELSE 'biname' END AS source FROM customer, (SELECT unnest([1, 2]) AS k)")
def name_periods(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    return tables.union_all([panel.name_periods(docs, f).withColumn("source", F.lit(s)) for f, s in (("navne", "name"), ("binavne", "biname"))]).select("cvr", "name", "valid_from", "valid_to", "source")


_UNIT = "concat('{\"pNummer\":', CAST(o_orderkey AS STRING), ',\"virksomhedsrelation\":[{\"cvrNummer\":', CAST(o_custkey AS STRING), ',\"periode\":', " + _period("'1990-01-01'", "'2000-06-30'") + ", '},{\"cvrNummer\":', CAST(o_custkey + 1 AS STRING), ',\"periode\":', " + _period("'2000-07-01'", "'2000-12-31'") + ", '}],\"erstMaanedsbeskaeftigelse\":[{\"aar\":2000,\"maaned\":', CAST(o_orderkey % 12 + 1 AS STRING), ',\"antalAnsatte\":', CAST(o_orderkey % 5 AS STRING), '},{\"aar\":2003,\"maaned\":1,\"antalAnsatte\":1}]}')"


@query("unit_months", "WITH e AS (SELECT o_orderkey AS unit, CASE WHEN o_orderkey % 12 + 1 >= 7 THEN o_custkey + 1 ELSE o_custkey END AS firm, 2000 AS year, CAST(o_orderkey % 12 + 1 AS INTEGER) AS month, o_orderkey % 5 AS k FROM orders UNION ALL SELECT o_orderkey, o_custkey, 2003, 1, 1 FROM orders) SELECT lpad(CAST(firm AS VARCHAR), 8, '0') AS cvr, year, month, CAST(sum(k) AS DOUBLE) AS employees, count(DISTINCT unit) AS n_units FROM e GROUP BY ALL")
def unit_months(spark, sf_dir):
    units = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr(f"{_UNIT} AS doc")
    return panel.unit_months(units, "doc").select("cvr", "year", "month", F.col("antalAnsatte").alias("employees"), "n_units")


# reports

@query("match_failures", "WITH o AS (SELECT p_brand AS k, p_type AS name FROM part), n AS (SELECT DISTINCT p_brand AS k, p_type AS name FROM part WHERE p_partkey % 3 = 0), c AS (SELECT o.k, n.k IS NOT NULL AS same_name, bool_or(n.k IS NOT NULL) OVER (PARTITION BY o.k) AS any_same_name, bool_or(n.k IS NULL) OVER (PARTITION BY o.k) AS lost FROM o LEFT JOIN n ON o.k = n.k AND o.name = n.name) SELECT same_name, any_same_name, count(*) AS n FROM c WHERE lost GROUP BY ALL")
def match_failures(spark, sf_dir):
    old = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("p_brand AS k", "p_type AS name", "p_partkey AS id")
    return reports.failure_source(tables.concordance(old, old.where("id % 3 = 0"), "k", "name"), "k")


@query("tenders_distribution", with_("awards") + ", p AS (SELECT kind, firm, count(DISTINCT tender) AS n_things FROM awards GROUP BY ALL) SELECT kind, n_things, count(*) AS n_units FROM p GROUP BY ALL")
def tenders_distribution(spark, sf_dir):
    return reports.distribution(source(spark, sf_dir, "awards"), ["kind"], "firm", "tender")


@query("firm_ages", with_("awards") + ", a AS (SELECT kind = '1-URGENT' AS tender_firm, CAST(firm AS INTEGER) % 3 = 0 AS dissolved, CAST(floor((CAST('2010-01-01' AS DATE) - date_trunc('year', day)::DATE) / 365.25) AS INTEGER) AS age FROM awards) SELECT tender_firm, dissolved, round(avg(age), 6) AS estimate, count(*) AS n FROM a GROUP BY ALL")
def firm_ages(spark, sf_dir):
    df = source(spark, sf_dir, "awards").select((F.col("kind") == "1-URGENT").alias("tender_firm"), (F.col("firm").cast("int") % 3 == 0).alias("dissolved"), years_between(year_start(F.col("day")), F.to_date(F.lit("2010-01-01"))).alias("age"))
    return stats.group_means(df, ["tender_firm", "dissolved"], "age").withColumn("estimate", _r(F.col("estimate"), 6))


@query("country_means", "WITH v AS (SELECT n_name AS country, CAST(n_nationkey * 10 AS DOUBLE) AS mean_value FROM nation) SELECT country, mean_value, round(avg(mean_value) OVER (), 6) AS all_countries FROM v")
def country_means(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/nation.parquet").selectExpr("n_name AS country", "explode(array('Mean', '2019')) AS year", "CAST(n_nationkey * 10 AS STRING) AS value")
    return reports.country_means(df, "year", "country", "value").withColumn("all_countries", _r(F.col("all_countries"), 6))


_TERM = "concat(p_name, CASE p_partkey % 4 WHEN 0 THEN ' AB' WHEN 1 THEN ' Sverige' WHEN 2 THEN ' abc' ELSE '' END)"


@query("term_use", f"SELECT p_partkey % 4 < 2 AS has_term, p_mfgr AS status, count(DISTINCT {_TERM}) AS n_names, count(*) AS n_rows FROM (SELECT p_name, p_partkey, p_brand AS p_mfgr FROM part) GROUP BY ALL")
def term_use(spark, sf_dir):
    return reports.term_use(spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr(f"{_TERM} AS name", "p_brand AS status"), "name", "status")


@query("score_elbow", "SELECT p_partkey AS id, CAST(i AS INTEGER) AS rank, CAST(p_size * i AS DOUBLE) AS score FROM part, unnest(range(1, 6)) AS t(i) WHERE NOT (i = 3 AND p_partkey % 2 = 0)")
def score_elbow(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("p_partkey AS id", *[f"CAST({'CASE WHEN p_partkey % 2 <> 0 THEN p_size * 3 END' if i == 3 else f'p_size * {i}'} AS DOUBLE) AS score_{i}" for i in range(1, 6)])
    return reports.long_scores(df, "id")


@query("lot_logs", with_("awards") + "SELECT firm, kind, round(ln(amount), 6) AS log_amount, tender FROM awards QUALIFY row_number() OVER (PARTITION BY firm, kind ORDER BY day, tender) = 1")
def lot_logs(spark, sf_dir):
    out = reports.lots(source(spark, sf_dir, "awards"), ["firm", "kind"], ["amount"], [F.col("day"), F.col("tender")])
    return out.select("firm", "kind", _r(F.col("log_amount"), 6).alias("log_amount"), "tender")


@query("shortest_examples", "WITH g AS (SELECT o_orderstatus AS reason, o_orderkey AS id, concat('name ', o_custkey) AS name FROM orders), f AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY reason ORDER BY length(name), name, id) = 1) SELECT reason, name, id, 'a' || id || '; b' || id AS parts FROM f")
def shortest_examples(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_orderstatus AS reason", "o_orderkey AS id", "concat('name ', o_custkey) AS name", "explode(array(struct(2 AS at, concat('b', o_orderkey) AS part), struct(1 AS at, concat('a', o_orderkey) AS part))) AS x")
    return reports.shortest_example(df.select("reason", "id", "name", "x.at", "x.part"), "reason", "id", "name", "part", "at").select("reason", "name", "id", "parts")


@query("cleaning_examples", "SELECT CAST(i AS INTEGER) AS id, s AS step, CASE s WHEN 'raw' THEN 'Firm ' || i || ' A/S' ELSE lower('Firm ' || i) END AS value FROM unnest(range(0, 3)) AS t(i), unnest(['raw', 'clean']) AS u(s)")
def cleaning_examples(spark, sf_dir):
    df = spark.range(3).selectExpr("CAST(id AS INT) AS id", "concat('Firm ', id, ' A/S') AS raw", "lower(concat('Firm ', id)) AS clean")
    return tables.union_all([reports.examples(df.where(F.col("id") == i), ["raw", "clean"], 1).withColumn("id", F.lit(i)) for i in range(3)]).select("id", "step", "value")


@query("framework_ends", "SELECT l_orderkey AS tender, l_linenumber AS lot, coalesce(CASE WHEN l_orderkey % 2 = 0 THEN 10 END, CASE WHEN l_orderkey % 3 = 0 THEN 60 END, 730) AS days FROM lineitem")
def framework_ends(spark, sf_dir):
    key = F.col("l_orderkey")
    days = tables.framework_days(F.when(key % 2 == 0, 10), F.when(key % 3 == 0, 2), F.lit(2))
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(key.alias("tender"), F.col("l_linenumber").alias("lot"), days.alias("days"))
