"""All queries of the library by name, with the SQL that they are held against.

The tables at hand are not of procurement; `derived` says how each family's input is made of them,
by expressions that Spark and the SQL of the comparison read alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procurelake.functions import cpv, ids, names, scalars
from procurelake.operators import checks, explode, match, notices, panel, stats, tables
from procurelake.plans import reports

QUERIES: dict = {}
SQL: dict[str, str] = {}

_D = "lpad(CAST({0} AS STRING), 8, '0')"
_EIGHT = _D.format("c_custkey")
_PAIRS = f"concat(substring({_EIGHT}, 1, 2), ' ', substring({_EIGHT}, 3, 2), ' ', substring({_EIGHT}, 5, 2), ' ', substring({_EIGHT}, 7, 2))"
#: Derived inputs: table and expressions.
derived = {
    "messy": ("customer", ["c_custkey AS id", f"CASE c_custkey % 7 WHEN 0 THEN concat('DK', {_EIGHT}) WHEN 1 THEN {_PAIRS} WHEN 2 THEN concat({_EIGHT}, '-', {_D.format('c_custkey + 1')}) WHEN 3 THEN concat('1', {_EIGHT}) WHEN 4 THEN '12345678' WHEN 5 THEN '' ELSE concat('DK-', replace({_PAIRS}, ' ', '-')) END AS raw", "CASE c_custkey % 3 WHEN 0 THEN ' dk' WHEN 1 THEN 'DK' ELSE 'SE' END AS country", "c_mktsegment AS name"]),
    "registered": ("part", ["p_partkey AS k", "concat(p_name, CASE p_partkey % 5 WHEN 0 THEN ' A/S' WHEN 1 THEN ' ApS' WHEN 2 THEN ' K/S' WHEN 3 THEN ' Amba' ELSE '' END) AS name", f"{_D.format('p_partkey')} AS cvr", "p_partkey % 7 AS gap"]),
    "asked": ("part", ["p_partkey AS id", "CASE p_partkey % 4 WHEN 0 THEN upper(p_name) WHEN 1 THEN concat(p_name, ' A/S') WHEN 2 THEN concat(replace(p_name, ' ', '-'), ' ApS') ELSE concat(p_name, ' & holding') END AS name"]),
    "lots": ("lineitem", ["l_orderkey AS tender", "l_linenumber AS lot", "CAST(l_suppkey AS STRING) AS winner", "CASE WHEN l_orderkey % 3 = 0 THEN NULL WHEN l_linenumber % 4 = 0 THEN NULL ELSE l_extendedprice END AS lot_amount", "CASE WHEN l_orderkey % 2 = 0 THEN NULL ELSE CAST(l_orderkey AS DOUBLE) * 100 END AS tender_amount", "CAST(l_shipdate AS DATE) AS day", "l_returnflag AS flag", "l_linestatus AS status"]),
    "awards": ("orders", ["CAST(o_custkey AS STRING) AS firm", "CAST(o_orderdate AS DATE) AS day", "o_orderkey AS tender", "o_totalprice AS amount", "o_orderpriority AS kind"]),
}


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, expressions = derived[name]
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(*expressions)


def with_(*names_: str) -> str:
    return "WITH " + ", ".join(f"{n} AS (SELECT {', '.join(derived[n][1])} FROM {derived[n][0]})" for n in names_) + " "


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _r(c, n: int = 4):
    return F.round(c, n)


# identifiers

_RUNS = r"list_filter(regexp_extract_all(regexp_replace(raw, '\s+', '', 'g'), '\d+'), lambda s: length(s) = 8)"
_DIGITS = "regexp_replace(raw, '[^0-9]', '', 'g')"


@query("id_numbers", with_("messy") + f"SELECT id, nullif(array_to_string({_RUNS}, ';'), '') AS numbers, CAST(len(list_distinct({_RUNS})) AS INTEGER) AS n, CASE WHEN trim(raw) <> '' AND upper(trim(country)) = 'DK' AND len({_RUNS}) = 0 AND length({_DIGITS}) = 8 AND {_DIGITS} NOT IN ('00000000', '11111111', '12345678', '99999999') THEN {_DIGITS} END AS recovered FROM messy")
def id_numbers(spark, sf_dir):
    df = source(spark, sf_dir, "messy")
    n = ids.n_valid(F.col("raw"))
    return df.select("id", F.array_join(ids.valid_numbers(F.col("raw")), ";").alias("numbers"), n.alias("n"), ids.recovered(F.col("raw"), F.col("country"), n).alias("recovered"))


_NS = r"regexp_replace(raw, '\s', '', 'g')"
_NL = f"regexp_replace({_NS}, '[A-Za-z]', '', 'g')"
_CL = f"nullif(regexp_replace({_NL}, '[-]', '', 'g'), '')"


@query("id_flags", with_("messy") + rf"SELECT id, {_CL} AS cvr_clean, regexp_matches(raw, '\s') AS flag_cvr_whitespace, regexp_matches({_NS}, '[A-Za-z]') AS flag_cvr_alpha, contains({_NL}, '-') AS flag_cvr_punct, coalesce(regexp_full_match({_CL}, '[0-9]{{8}}') AND {_CL} NOT IN ('00000000', '11111111', '12345678', '99999999'), false) AS flag_cvr_valid, coalesce(raw <> {_CL}, false) AS flag_cvr_changed, {_CL} IS NULL AS flag_cvr_missing, upper(trim(country)) <> 'DK' AS flag_foreign FROM messy")
def id_flags(spark, sf_dir):
    df = source(spark, sf_dir, "messy").withColumns(ids.standardised(F.col("raw")))
    df = df.withColumns(ids.quality_flags(F.col("raw"), F.col("cvr_clean"), F.col("name"), F.col("country"), placeholders=False))
    return df.select("id", "cvr_clean", "flag_cvr_whitespace", "flag_cvr_alpha", "flag_cvr_punct", "flag_cvr_valid", "flag_cvr_changed", "flag_cvr_missing", "flag_foreign")


@query("flag_sums", with_("messy") + rf"SELECT 'flag_cvr_whitespace' AS measure, CAST(sum(CAST(regexp_matches(raw, '\s') AS INTEGER)) AS DOUBLE) AS value FROM messy UNION ALL SELECT 'flag_cvr_alpha', sum(CAST(regexp_matches({_NS}, '[A-Za-z]') AS INTEGER)) FROM messy UNION ALL SELECT 'flag_cvr_punct', sum(CAST(contains({_NL}, '-') AS INTEGER)) FROM messy")
def flag_sums(spark, sf_dir):
    return reports.flag_sums(source(spark, sf_dir, "messy").withColumns(ids.standardised(F.col("raw"))))


# names and matches

_FORMS = "['a/s', 'aps', 'i/s', 'k/s', 'ks', 'ivs', 'p/s', 'amba', 'smba', 'fmba', 'as', 'ab', 'gmbh']"


def _prepared_sql(cte: str) -> str:
    """Names of plain ASCII words: forms are words of their own."""
    form = "CASE WHEN list_contains(w, 'a/s') THEN 'a/s' WHEN list_contains(w, 'aps') THEN 'aps' WHEN list_contains(w, 'k/s') THEN 'k/s' WHEN list_contains(w, 'amba') THEN 'amba' ELSE 'Undetermined' END"
    stop = "[" + ", ".join(f"'{x}'" for x in names.STOP_WORDS) + "]"
    words = "CASE x " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in names.WORDS.items()) + " ELSE x END"
    return (
        f"{cte}_w AS (SELECT *, string_split(lower(name), ' ') AS w FROM {cte}), "
        f"{cte}_b AS (SELECT *, array_to_string(list_filter(w, lambda x: NOT list_contains({_FORMS}, x)), ' ') AS name_basic, {form} AS firm_type FROM {cte}_w), "
        f"{cte}_c AS (SELECT *, list_transform(list_filter(string_split(replace(replace(replace(replace(name_basic, 'oe', 'o'), 'aa', 'a'), '&', ' og '), '-', ' '), ' '), lambda x: x <> ''), lambda x: {words}) AS m FROM {cte}_b), "
        f"{cte}_p AS (SELECT *, array_to_string(m, ' ') AS name_clean, array_to_string(m, '') AS name_no_spaces, nullif(array_to_string(list_sort(list_filter(m, lambda x: NOT list_contains({stop}, x))), ''), '') AS name_broad, substring(array_to_string(m, ' '), 1, 1) AS first_letter FROM {cte}_c)"
    )


@query("prepared_names", with_("asked") + ", " + _prepared_sql("asked") + " SELECT id, name_basic, name_clean, name_no_spaces, name_broad, firm_type, first_letter FROM asked_p")
def prepared_names(spark, sf_dir):
    return source(spark, sf_dir, "asked").select("id", *[c.alias(k) for k, c in names.prepared(F.col("name")).items()])


def _key(spark, sf_dir) -> DataFrame:
    """Each registered name once, valid from a day that depends on its number."""
    reg = source(spark, sf_dir, "registered").groupBy("name").agg(F.min_by("cvr", "k").alias("cvr"), F.min_by("gap", "k").alias("gap"))
    return match.keyed(reg.select("name", "cvr", F.date_add(F.to_date(F.lit("1990-01-01")), (F.col("gap") * 1000).cast("int")).alias("valid_from"), F.lit(None).cast("date").alias("valid_to")), "name", "name")


def _entities(spark, sf_dir) -> DataFrame:
    return match.entities(source(spark, sf_dir, "asked").withColumn("day", F.date_add(F.to_date(F.lit("1995-01-01")), (F.col("id") % 365).cast("int"))), "name", "id", "day")


_KEY_SQL = "key AS (SELECT arg_min(cvr, k) AS cvr, name, CAST('1990-01-01' AS DATE) + CAST(arg_min(gap, k) * 1000 AS INTEGER) AS valid_from FROM registered GROUP BY name), "
_ON = ["a.name_basic = b.name_basic AND a.firm_type = b.firm_type", "a.name_no_spaces = b.name_no_spaces AND a.firm_type = b.firm_type", "a.name_no_spaces = b.name_no_spaces", "a.name_broad IS NOT DISTINCT FROM b.name_broad"]
_LADDER_SQL = (
    with_("registered", "asked") + ", " + _KEY_SQL + _prepared_sql("asked") + ", " + _prepared_sql("key") + ", cand AS ("
    + " UNION ALL ".join(f"SELECT a.id, {i + 1} AS step, b.cvr, b.name, b.valid_from, CAST('1995-01-01' AS DATE) + CAST(a.id % 365 AS INTEGER) AS day FROM asked_p a JOIN key_p b ON {on}" for i, on in enumerate(_ON))
    + "), ok AS (SELECT *, min(step) OVER (PARTITION BY id) AS low FROM cand WHERE day >= valid_from - 730), "
    + "best AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY CASE WHEN day >= valid_from THEN 0 ELSE 1 END, valid_from, cvr, name) AS r FROM ok WHERE step = low), "
    + "n AS (SELECT id, count(DISTINCT cvr) AS n_candidates FROM ok WHERE step = low GROUP BY id) "
    + "SELECT id AS match_id, step, cvr, n_candidates FROM best JOIN n USING (id) WHERE r = 1"
)


@query("exact_ladder", _LADDER_SQL)
def exact_ladder(spark, sf_dir):
    return match.exact(_entities(spark, sf_dir), _key(spark, sf_dir)).select("match_id", "step", "cvr", "n_candidates")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_ladder(spark, sf_dir)


_LIKE = "100.0 * (length(a.name_clean) + length(b.name_clean) - levenshtein(a.name_clean, b.name_clean)) / (length(a.name_clean) + length(b.name_clean))"
_FUZZY_SQL = (
    with_("registered", "asked") + ", " + _KEY_SQL + _prepared_sql("asked") + ", " + _prepared_sql("key")
    + f", problem AS (SELECT DISTINCT name_clean, firm_type, first_letter FROM asked_p), met AS (SELECT a.name_clean AS name, a.firm_type, b.cvr, max({_LIKE}) AS score, min(b.valid_from) AS f FROM problem a JOIN key_p b ON a.firm_type = b.firm_type AND a.first_letter = b.first_letter GROUP BY ALL), "
    + "ranked AS (SELECT *, row_number() OVER (PARTITION BY name, firm_type ORDER BY score DESC, f, cvr) AS rank, max(score) OVER (PARTITION BY name, firm_type) AS top FROM met) "
    + "SELECT name, firm_type, cvr, round(score, 4) AS score, rank, CAST(sum(CASE WHEN score = top THEN 1 ELSE 0 END) OVER (PARTITION BY name, firm_type) AS BIGINT) AS n_top FROM ranked QUALIFY rank <= 5"
)


@query("fuzzy_top5", _FUZZY_SQL)
def fuzzy_top5(spark, sf_dir):
    rows = match.entities(source(spark, sf_dir, "asked"), "name", "id").select("name_clean", "firm_type", "first_letter", "match_date").distinct().withColumn("problem", F.struct("name_clean", "firm_type"))
    out = match.fuzzy_pass(rows, _key(spark, sf_dir), "name", "name_clean", "first_letter", 1)
    return out.select(F.col("problem.name_clean").alias("name"), F.col("problem.firm_type").alias("firm_type"), "cvr", _r(F.col("score")).alias("score"), "rank", F.col("n_top_score_candidates").alias("n_top"))


# lists, amounts, windows

_TAX = "concat_ws(';', CAST(o_orderkey AS STRING), CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE CAST(o_custkey AS STRING) END, CAST(o_orderkey % 10 AS STRING))"


@query("parallel_lists", f"WITH l AS (SELECT o_orderkey AS id, string_split({_TAX}, ';') AS a, string_split(concat_ws(';', o_orderstatus, o_orderpriority), ';') AS b FROM orders) SELECT id, CAST(i AS INTEGER) AS number, nullif(a[i], '') AS a, nullif(b[i], '') AS b, 3 AS max_detected FROM l, unnest(range(1, 4)) AS t(i)")
def parallel_lists(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_orderkey AS id", f"{_TAX} AS a", "concat_ws(';', o_orderstatus, o_orderpriority) AS b")
    return explode.parallel(df, ["a", "b"], "a", "number").select("id", "number", "a", "b", "max_detected")


def _cpv_sql(code: str) -> str:
    d = f"{code}[1:2]"
    sector = " ".join(f"WHEN {d} IN ({', '.join(repr(x) for x in ds)}) THEN '{s}'" for s, ds in cpv.SECTORS.items())
    name = " ".join(f"WHEN '{k}' THEN '{v.replace(chr(39), chr(39) * 2)}'" for k, v in (cpv.DIVISIONS_2003 | cpv.DIVISIONS_2008).items())
    return f"{code} AS cpv_code_first, {d} AS cpv_division, CASE {d} {name} END AS cpv_division_name, CASE {sector} ELSE '{cpv.REST}' END AS cpv_sector, CASE WHEN {d} = '45' THEN 'Works' WHEN CAST({d} AS INTEGER) >= 50 THEN 'Services' ELSE 'Supplies' END AS cpv_category"


@query("cpv_codes", "WITH c AS (SELECT p_partkey AS id, lpad(CAST(p_partkey * 48611 % 100000000 AS VARCHAR), 8, '0') AS code FROM part) SELECT id, " + _cpv_sql("code") + " FROM c")
def cpv_codes(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("p_partkey AS id", "concat(CAST(p_partkey * 48611 % 100000000 AS STRING), ' - IA01; 45000000') AS raw")
    return df.select("id", *[c.alias(k) for k, c in cpv.cleaned(F.col("raw")).items()])


@query("even_split", with_("lots") + "SELECT tender, lot, round(CASE WHEN count(lot_amount) OVER w = 0 THEN tender_amount / (SELECT count(DISTINCT x.lot) FROM lots x WHERE x.tender = l.tender) ELSE lot_amount END, 4) AS lot_amount FROM lots l WINDOW w AS (PARTITION BY tender)")
def even_split(spark, sf_dir):
    df = tables.split_evenly(source(spark, sf_dir, "lots"), "tender", "lot", "tender_amount", "lot_amount")
    return df.select("tender", "lot", _r(F.col("lot_amount")).alias("lot_amount"))


@query("tender_fill", with_("lots") + ", f AS (SELECT tender, sum(a) AS s FROM (SELECT tender, lot, min(lot_amount) AS a FROM lots GROUP BY ALL) GROUP BY tender) SELECT tender, lot, round(CASE WHEN count(tender_amount) OVER w = 0 AND count(lot_amount) OVER w = count(*) OVER w THEN s ELSE tender_amount END, 4) AS tender_amount FROM lots JOIN f USING (tender) WINDOW w AS (PARTITION BY tender)")
def tender_fill(spark, sf_dir):
    df = tables.sum_of_lots(source(spark, sf_dir, "lots"), "tender", "lot", "tender_amount", "lot_amount", "lot_amount")
    return df.select("tender", "lot", _r(F.col("tender_amount")).alias("tender_amount"))


@query("first_rows", with_("awards") + "SELECT firm, day, tender FROM awards QUALIFY row_number() OVER (PARTITION BY firm ORDER BY day, tender) = 1")
def first_rows(spark, sf_dir):
    return tables.first_rows(source(spark, sf_dir, "awards"), ["firm"], [F.col("day").asc_nulls_last(), F.col("tender")]).select("firm", "day", "tender")


@query("row_numbers", with_("awards") + "SELECT tender, row_number() OVER (ORDER BY amount DESC NULLS LAST, tender) AS row_id FROM awards")
def row_numbers(spark, sf_dir):
    return tables.numbered(source(spark, sf_dir, "awards"), [F.col("amount").desc_nulls_last(), F.col("tender")]).select("tender", "row_id")


@query("joined_values", with_("lots") + "SELECT winner, string_agg(DISTINCT CAST(lot AS VARCHAR), ';' ORDER BY CAST(lot AS VARCHAR)) AS lots, count(DISTINCT lot_amount) + CAST(bool_or(lot_amount IS NULL) AS INTEGER) AS n_amounts FROM lots GROUP BY winner")
def joined_values(spark, sf_dir):
    return source(spark, sf_dir, "lots").groupBy("winner").agg(tables.joined_values(F.col("lot")).alias("lots"), tables.n_distinct(F.col("lot_amount")).alias("n_amounts"))


_BORROW = "CASE WHEN p_partkey % 3 = 0 THEN '' ELSE lpad(CAST(p_partkey % 64 AS STRING), 8, '0') END"


@query("borrowed_numbers", f"WITH s AS (SELECT p_partkey AS id, concat(p_name, CAST(p_size AS STRING)) AS name, {_BORROW} AS cvr FROM part), per AS (SELECT name, min(cvr) FILTER (cvr <> '') AS one FROM s GROUP BY name HAVING count(DISTINCT cvr) FILTER (cvr <> '') = 1 AND bool_or(cvr = '')) SELECT id, CASE WHEN cvr = '' AND one IS NOT NULL THEN one ELSE cvr END AS cvr, cvr = '' AND one IS NOT NULL AS flag_borrowed FROM s LEFT JOIN per USING (name)")
def borrowed_numbers(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("p_partkey AS id", "concat(p_name, CAST(p_size AS STRING)) AS name", f"{_BORROW} AS cvr").withColumn("valid", F.col("cvr") != "")
    return tables.borrowed(df, "name", "cvr", "valid", "id").select("id", "cvr", "flag_borrowed")


@query("amounts", with_("lots") + "SELECT tender, lot, round(coalesce(lot_amount, tender_amount) / 7.46038, 4) AS euros, day + 60 AS end_day, round(CASE WHEN flag = 'R' AND lot > 1 THEN lot_amount / lot * 12 END, 4) AS yearly FROM lots")
def amounts(spark, sf_dir):
    df = source(spark, sf_dir, "lots")
    return df.select("tender", "lot", _r(tables.euros(tables.amounts(F.col("lot_amount"), F.col("tender_amount")))).alias("euros"), tables.award_end(F.col("day"), F.lit(2), F.lit(None).cast("int"), F.lit(True)).alias("end_day"), _r(tables.annualised(F.col("lot_amount"), F.col("lot"), 12, (F.col("flag") == "R") & (F.col("lot") > 1))).alias("yearly"))


# reports

@query("shares", with_("lots") + "SELECT flag, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM lots GROUP BY flag")
def shares(spark, sf_dir):
    return tables.shares(source(spark, sf_dir, "lots"), ["flag"]).withColumn("share", _r(F.col("share"), 6))


@query("described", with_("awards") + "SELECT kind, count(amount) AS n, round(avg(amount), 2) AS mean, round(stddev_samp(amount), 2) AS sd, round(quantile_cont(amount, 0.25), 4) AS p25, round(median(amount), 4) AS median, round(quantile_cont(amount, 0.75), 4) AS p75, min(amount) AS least, max(amount) AS most FROM awards GROUP BY kind")
def described(spark, sf_dir):
    out = tables.described(source(spark, sf_dir, "awards"), ["kind"], "amount")
    return out.withColumns({c: _r(F.col(c), n) for c, n in (("mean", 2), ("sd", 2), ("p25", 4), ("median", 4), ("p75", 4))})


@query("coverage", with_("lots") + "SELECT status, count(*) AS n, count(lot_amount) AS lot_amount_present, CAST(count(*) FILTER (lot_amount > 0) AS BIGINT) AS lot_amount_positive, count(tender_amount) AS tender_amount_present, CAST(count(*) FILTER (tender_amount > 0) AS BIGINT) AS tender_amount_positive FROM lots GROUP BY status")
def coverage(spark, sf_dir):
    return tables.coverage(source(spark, sf_dir, "lots"), ["status"], ["lot_amount", "tender_amount"])


@query("overlap", with_("lots") + ", a AS (SELECT DISTINCT winner FROM lots WHERE flag = 'R'), b AS (SELECT DISTINCT winner FROM lots WHERE flag = 'A' AND lot > 2) SELECT CAST(count(*) FILTER (a.winner IS NOT NULL AND b.winner IS NOT NULL) AS BIGINT) AS n_both, CAST(count(*) FILTER (b.winner IS NULL) AS BIGINT) AS n_first_only, CAST(count(*) FILTER (a.winner IS NULL) AS BIGINT) AS n_second_only FROM a FULL JOIN b ON a.winner = b.winner")
def overlap(spark, sf_dir):
    df = source(spark, sf_dir, "lots")
    return tables.overlap(df.where("flag = 'R'"), df.where("flag = 'A' AND lot > 2"), "winner")


@query("tender_structure", with_("lots") + ", p AS (SELECT tender, count(DISTINCT lot) AS n, CASE WHEN count(lot_amount) = count(*) THEN sum(lot_amount) END AS s, max(tender_amount) AS a FROM lots GROUP BY tender) SELECT round(avg(n), 6) AS mean_lots, quantile_cont(n, 0.5) AS median_lots, max(n) AS most_lots, round(avg(CAST(n > 1 AS INTEGER)), 6) AS several_share, round(corr(s, a), 6) AS correlation FROM p")
def tender_structure(spark, sf_dir):
    out = reports.structure(source(spark, sf_dir, "lots"), "tender", "lot", "tender_amount", "lot_amount")
    return out.withColumns({c: _r(F.col(c), 6) for c in ("mean_lots", "several_share", "correlation")})


@query("tenders_per_firm", with_("awards") + ", p AS (SELECT kind, firm, count(DISTINCT tender) AS n FROM awards GROUP BY ALL) SELECT kind, count(*) AS n_firm, round(avg(n), 6) AS mean_tenders, round(stddev_samp(n), 6) AS sd_tenders FROM p GROUP BY kind")
def tenders_per_firm(spark, sf_dir):
    return reports.per_unit(source(spark, sf_dir, "awards"), ["kind"], "firm", "tender", "tenders").withColumns({c: _r(F.col(c), 6) for c in ("mean_tenders", "sd_tenders")})


@query("several_winners", with_("lots") + ", p AS (SELECT tender, flag, count(DISTINCT winner) AS n FROM lots GROUP BY ALL), t AS (SELECT tender, bool_or(n > 1) AS anyone, count(*) AS k, sum(CAST(n > 1 AS INTEGER)) AS m FROM p GROUP BY tender) SELECT round(sum(m) / sum(k), 6) AS lot_share, round(avg(CAST(anyone AS INTEGER)), 6) AS tender_share FROM t")
def several_winners(spark, sf_dir):
    return reports.several_winners(source(spark, sf_dir, "lots"), "tender", "flag", "winner").select(_r(F.col("lot_share"), 6).alias("lot_share"), _r(F.col("tender_share"), 6).alias("tender_share"))


@query("typo_distances", "WITH s AS (SELECT DISTINCT p_brand AS name, CAST(p_partkey % 50 AS VARCHAR) AS number FROM part), p AS (SELECT a.name, levenshtein(a.number, b.number) AS distance FROM s a JOIN s b ON a.name = b.name AND a.number < b.number) SELECT distance, count(DISTINCT name) AS n_names, round(count(DISTINCT name) / (SELECT count(DISTINCT name) FROM p), 6) AS share FROM p GROUP BY distance")
def typo_distances(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("p_brand AS name", "CAST(p_partkey % 50 AS STRING) AS number")
    return reports.typo_distances(df, "name", "number").withColumn("share", _r(F.col("share"), 6))


@query("unmatched_by_year", with_("awards") + "SELECT CAST(year(day) AS INTEGER) AS year, count(*) AS n, round(avg(CAST(kind = '1-URGENT' AS INTEGER)), 6) AS unmatched_rate FROM awards GROUP BY 1")
def unmatched_by_year(spark, sf_dir):
    return reports.unmatched_by_year(source(spark, sf_dir, "awards"), F.year("day"), F.col("kind") == "1-URGENT").withColumn("unmatched_rate", _r(F.col("unmatched_rate"), 6))


# panels

_E = "events_ AS (SELECT DISTINCT firm, day FROM awards), e AS (SELECT *, year(day) * 4 + quarter(day) AS q, year(day) AS y FROM events_)"


@query("event_isolation", with_("awards") + ", " + _E + " SELECT firm, day AS event_date, CAST(row_number() OVER w AS INTEGER) AS event_number, coalesce(q - lag(q) OVER w > 4, true) AND coalesce(lead(q) OVER w - q > 4, true) AS isolated_quarter, coalesce(y - lag(y) OVER w > 1, true) AND coalesce(lead(y) OVER w - y > 1, true) AS isolated_year FROM e WINDOW w AS (PARTITION BY firm ORDER BY day)")
def event_isolation(spark, sf_dir):
    return panel.events(source(spark, sf_dir, "awards"), "firm", "day").select("firm", "event_date", "event_number", "isolated_quarter", "isolated_year")


def _months(spark, sf_dir) -> DataFrame:
    df = source(spark, sf_dir, "awards")
    return df.groupBy("firm", F.year("day").alias("year"), F.month("day").alias("month")).agg(F.sum("amount").alias("staff")).withColumn("frequency", F.lit("monthly"))


_M = "m AS (SELECT firm, CAST(year(day) AS INTEGER) AS year, CAST(month(day) AS INTEGER) AS month, sum(amount) AS staff FROM awards GROUP BY ALL)"


@query("derived_quarters", with_("awards") + f", {_M} SELECT firm, year, CAST(ceil(month / 3) AS INTEGER) AS quarter, round(avg(staff), 4) AS staff, count(DISTINCT month) AS months_observed, count(DISTINCT month) = 3 AS complete FROM m GROUP BY ALL")
def derived_quarters(spark, sf_dir):
    out = panel.derived(_months(spark, sf_dir), ["firm"], ["staff"], "quarterly_derived")
    return out.select("firm", "year", "quarter", _r(F.col("staff")).alias("staff"), "months_observed", "complete")


@query("spliced_years", with_("awards") + f", {_M}, d AS (SELECT firm, year, avg(staff) AS staff FROM m GROUP BY ALL), n AS (SELECT firm, year, max(staff) AS staff FROM m WHERE year % 2 = 0 GROUP BY ALL) SELECT firm, year, round(staff, 4) AS staff, 'native' AS spliced_from FROM n UNION ALL SELECT firm, year, round(staff, 4), 'derived' FROM d ANTI JOIN n USING (firm, year)")
def spliced_years(spark, sf_dir):
    months = _months(spark, sf_dir)
    native = months.where("year % 2 = 0").groupBy("firm", "year").agg(F.max("staff").alias("staff"))
    out = panel.spliced(native, panel.derived(months, ["firm"], ["staff"], "annual_derived"), ["firm", "year"], "annual_spliced")
    return out.select("firm", "year", _r(F.col("staff")).alias("staff"), "spliced_from")


@query("balanced_panel", with_("awards") + f", {_M}, y AS (SELECT firm, year, sum(staff) AS staff FROM m GROUP BY ALL), f AS (SELECT firm FROM y WHERE year BETWEEN 1996 AND 1998 GROUP BY firm HAVING count(DISTINCT year) = 3) SELECT firm, year, round(staff, 2) AS staff FROM y SEMI JOIN f USING (firm) WHERE year BETWEEN 1996 AND 1998")
def balanced_panel(spark, sf_dir):
    years = _months(spark, sf_dir).groupBy("firm", "year").agg(F.sum("staff").alias("staff"))
    return panel.balanced(years, ["firm"], "year", 1996, 1998, "staff").select("firm", "year", _r(F.col("staff"), 2).alias("staff"))


@query("collapsed_sources", with_("awards") + f", {_M}, s AS (SELECT firm, year, month, CASE WHEN month % 2 = 0 THEN NULL ELSE staff END AS staff, 'historical' AS src FROM m UNION ALL SELECT firm, year, month, staff + 1, 'new' FROM m WHERE month % 3 = 0) SELECT firm, year, month, round(coalesce(max(staff) FILTER (src = 'historical'), max(staff) FILTER (src = 'new')), 2) AS staff, count(DISTINCT src) > 1 AS flag_overlap FROM s GROUP BY ALL")
def collapsed_sources(spark, sf_dir):
    m = _months(spark, sf_dir)
    both = m.withColumns({"staff": F.when(F.col("month") % 2 != 0, F.col("staff")), "data_source": F.lit("historical")}).unionByName(m.where("month % 3 = 0").withColumns({"staff": F.col("staff") + 1, "data_source": F.lit("new")}))
    return panel.collapsed(both, ["firm", "year", "month"], ["staff"]).select("firm", "year", "month", _r(F.col("staff"), 2).alias("staff"), "flag_overlap")


@query("group_means", with_("lots") + "SELECT flag, status, round(avg(lot_amount), 4) AS estimate, count(lot_amount) AS n FROM lots WHERE lot_amount IS NOT NULL GROUP BY ALL")
def group_means(spark, sf_dir):
    return stats.group_means(source(spark, sf_dir, "lots"), ["flag", "status"], "lot_amount").withColumn("estimate", _r(F.col("estimate")))


# checks and notices

@query("expectations", with_("lots") + "SELECT 'unique lots' AS expectation, count(*) AS violations FROM (SELECT 1 FROM lots GROUP BY tender, lot HAVING count(*) > 1) UNION ALL SELECT 'one amount a tender', count(*) FROM (SELECT 1 FROM lots GROUP BY tender HAVING count(DISTINCT lot_amount) + CAST(bool_or(lot_amount IS NULL) AS INTEGER) > 1) UNION ALL SELECT 'status known', count(*) FROM lots WHERE NOT coalesce(status = 'O', false)")
def expectations(spark, sf_dir):
    df = source(spark, sf_dir, "lots")
    return checks.all_of([("unique lots", checks.unique(df, ["tender", "lot"])), ("one amount a tender", checks.one_value(df, ["tender"], "lot_amount")), ("status known", checks.all_true(df, F.col("status") == "O"))])


_NOTICE = "concat('<ContractAwardNotice xmlns:efac=\"e\" xmlns:cbc=\"c\"><efac:NoticeResult>', '<efac:LotTender><cbc:ID>T1</cbc:ID></efac:LotTender>', CASE WHEN o_orderkey % 2 = 0 THEN '<efac:LotTender><cbc:ID>T2</cbc:ID></efac:LotTender>' ELSE '' END, '<efac:SettledContract><efac:LotTender><cbc:ID>T1</cbc:ID></efac:LotTender></efac:SettledContract></efac:NoticeResult></ContractAwardNotice>')"


_OLD = "concat('<TED_EXPORT><NB_TENDERS_RECEIVED>', CAST(o_orderkey % 4 AS STRING), '</NB_TENDERS_RECEIVED><CONTRACTOR><N>x</N></CONTRACTOR>', CASE WHEN o_orderkey % 3 = 0 THEN '<CONTRACTOR><N>y</N></CONTRACTOR>' ELSE '' END, '</TED_EXPORT>')"
_TOLD = "CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN {1} ELSE {0} END"
_TWO = "CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 1 END"
_CONTRACTORS = "CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 1 END"


@query("notice_indicators", f"SELECT o_orderkey AS id, {_TOLD.format(repr('eforms'), repr('legacy'))} AS schema, {_TOLD.format(_TWO, 'o_orderkey % 4')} AS n_tenders_received, {_TOLD.format('1', _CONTRACTORS)} AS n_winners, {_TOLD.format('o_orderkey % 2 = 0', f'o_orderkey % 4 > {_CONTRACTORS}')} AS had_non_winners, {_TOLD.format('o_orderkey % 2 = 0', 'false')} AS non_winners_listed, {_TOLD.format('1 - o_orderkey % 2', '0')} AS n_non_winners_named FROM orders")
def notice_indicators(spark, sf_dir):
    return notices.indicators(_notices(spark, sf_dir)).select("id", "schema", "n_tenders_received", "n_winners", "had_non_winners", "non_winners_listed", "n_non_winners_named")


def _notices(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_orderkey AS id", "o_orderdate AS day", f"CASE o_orderkey % 5 WHEN 0 THEN 'none' WHEN 1 THEN {_OLD} ELSE {_NOTICE} END AS xml")


@query("notice_diagnostics", f"SELECT CAST(year(o_orderdate) AS INTEGER) AS year, {_TOLD.format(repr('eforms'), repr('legacy'))} AS schema, {_TOLD.format('o_orderkey % 2 = 0', f'o_orderkey % 4 > {_CONTRACTORS}')} AS had_non_winners, count(*) AS n FROM orders GROUP BY ALL")
def notice_diagnostics(spark, sf_dir):
    return notices.diagnostics(notices.indicators(_notices(spark, sf_dir)).withColumn("year", F.year("day")), ["year", "schema", "had_non_winners"])


@query("json_values", "SELECT event_id AS id, CAST(regexp_extract(props, '\"k\": *([0-9]+)', 1) AS BIGINT) AS k FROM events")
def json_values(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("id"), F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("notice_numbers", r"SELECT page_id AS id, nullif(regexp_extract(concat(url, '/', lpad(CAST(page_id AS VARCHAR), 6, '0'), '-2020'), '([0-9]{6,8}-[0-9]{4})', 1), '') AS notice FROM pages")
def notice_numbers(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return df.select(F.col("page_id").alias("id"), scalars.notice_id(F.concat("url", F.lit("/"), F.lpad(F.col("page_id").cast("string"), 6, "0"), F.lit("-2020"))).alias("notice"))


def queries() -> dict:
    from procurelake.plans import cleaning, linking, more, studies  # noqa: F401  they register their queries

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    known = queries()
    return {k: v for k, v in SQL.items() if k in known}
