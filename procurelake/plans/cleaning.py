"""Queries of the sources' cleaning and of the flags of winners and buyers."""

from __future__ import annotations

from pyspark.sql import functions as F

from procurelake.operators import cleaning
from procurelake.plans.catalogue import _cpv_sql, _r, derived, query, source, with_

_DAY = "concat('200', CAST(l_orderkey % 10 AS STRING), '-0', CAST(l_orderkey % 9 + 1 AS STRING), '-1', CAST(l_linenumber % 9 AS STRING))"
_CPV = "lpad(CAST(l_orderkey * 48611 % 100000000 AS STRING), 8, '0')"
derived["notice_rows"] = (
    "lineitem",
    [
        "CAST(l_orderkey AS STRING) AS tender_id", "concat('L', CAST(l_linenumber AS STRING)) AS lot_id", "concat('Firm ', CAST(l_suppkey AS STRING)) AS winner_name",
        "CASE l_suppkey % 6 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN concat('DK ', lpad(CAST(l_suppkey AS STRING), 8, '0')) WHEN 3 THEN '12-34' ELSE lpad(CAST(l_suppkey AS STRING), 8, '0') END AS winner_cvr",
        "CASE l_suppkey % 5 WHEN 0 THEN NULL WHEN 1 THEN ' dk' WHEN 2 THEN 'se ' ELSE 'DK' END AS winner_country", "concat('Buyer ', CAST(l_orderkey % 50 AS STRING)) AS buyer_name",
        "CASE WHEN l_orderkey % 2 = 0 THEN CAST(30000 + l_orderkey % 5000 AS STRING) WHEN l_orderkey % 7 = 0 THEN 'soon' ELSE " + _DAY + " END AS award_date",
        "CASE l_orderkey % 3 WHEN 0 THEN 'Enkelt' WHEN 1 THEN 'Fælles' ELSE 'andet' END AS joint_tender", "CASE l_returnflag WHEN 'R' THEN 'Rammeaftale' WHEN 'A' THEN 'Offentlig kontrakt' ELSE 'andet' END AS contract_type",
        "CASE WHEN l_linestatus = 'O' THEN 'Nej' WHEN l_linenumber % 2 = 0 THEN 'Ja' END AS tender_cancelled", "CASE WHEN l_orderkey % 4 = 0 THEN NULL WHEN l_orderkey % 4 = 1 THEN 'ukendt' ELSE CAST(l_orderkey * 100 AS STRING) END AS final_tender_amount",
        "CASE WHEN l_orderkey % 8 = 1 THEN CAST(l_orderkey * 90 AS STRING) END AS estimated_tender_amount", "CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE CAST(l_partkey * 7 AS STRING) END AS final_lot_amount",
        "CASE WHEN l_orderkey % 6 = 0 THEN CAST(l_partkey AS STRING) END AS estimated_lot_amount", "CAST(l_linenumber % 3 AS STRING) AS n_bids_received", "CAST(l_orderkey % 3 AS STRING) AS n_lots", "CASE WHEN l_orderkey % 10 = 0 THEN NULL ELSE l_linenumber % 3 END AS n_lot_winners",
        "CASE WHEN l_orderkey % 5 = 0 THEN '24' END AS contract_duration_months_min", "CASE WHEN l_orderkey % 5 < 2 THEN '48' WHEN l_orderkey % 5 = 2 THEN '0' END AS contract_duration_months_max", f"concat({_CPV}, ' - IA01; 45000000') AS cpv_code",
        f"{_CPV} AS code",
    ],
)


def _national(spark, sf_dir):
    df = source(spark, sf_dir, "notice_rows")
    return cleaning.national(df.withColumnsRenamed({v: k for k, v in cleaning.NATIONAL.items()}))


_LOTS = "tender_id lot_id winner_name joint_tender contract_type flag_awarded award_date award_end_date n_bidders contract_duration_months flag_all_orig_lot_amt_missing cpv_code_first cpv_division cpv_division_name cpv_sector cpv_category".split()
_AMOUNTS = "tender_amount lot_amount tender_amount_eur lot_amount_eur tender_amount_dkk lot_amount_dkk annualised_tender_amount annualised_lot_amount".split()
_NUMBER = "TRY_CAST({0} AS DOUBLE)"
_NATIONAL_SQL = (
    with_("notice_rows")
    + ", a AS (SELECT *, coalesce(TRY_CAST(final_tender_amount AS DOUBLE), TRY_CAST(estimated_tender_amount AS DOUBLE)) AS t, coalesce(TRY_CAST(final_lot_amount AS DOUBLE), TRY_CAST(estimated_lot_amount AS DOUBLE)) AS o, "
    "CASE WHEN regexp_full_match(award_date, '[0-9]+') THEN CAST('1899-12-30' AS DATE) + CAST(award_date AS INTEGER) ELSE TRY_CAST(award_date AS DATE) END AS d, coalesce(tender_cancelled = 'Nej', false) AS f, "
    "CASE contract_type WHEN 'Rammeaftale' THEN 'Framework agreement' WHEN 'Offentlig kontrakt' THEN 'Public contract' END AS c, coalesce(TRY_CAST(contract_duration_months_min AS DOUBLE), TRY_CAST(contract_duration_months_max AS DOUBLE)) AS m FROM notice_rows), "
    "n AS (SELECT tender_id, count(DISTINCT lot_id) AS k, count(o) = 0 AS none FROM a GROUP BY tender_id), b AS (SELECT *, CASE WHEN none THEN t / k ELSE o END AS l FROM a JOIN n USING (tender_id)) "
    "SELECT tender_id, lot_id, winner_name, CASE joint_tender WHEN 'Enkelt' THEN 'single' WHEN 'Fælles' THEN 'joint' END AS joint_tender, c AS contract_type, f AS flag_awarded, d AS award_date, CASE WHEN f THEN d + CAST(m * 30 AS INTEGER) END AS award_end_date, "
    "CAST(n_bids_received AS DOUBLE) AS n_bidders, m AS contract_duration_months, none AS flag_all_orig_lot_amt_missing, " + _cpv_sql("code") + ", round(t, 4) AS tender_amount, round(l, 4) AS lot_amount, round(t / 7.46038, 4) AS tender_amount_eur, "
    "round(l / 7.46038, 4) AS lot_amount_eur, round(t, 4) AS tender_amount_dkk, round(l, 4) AS lot_amount_dkk, round(CASE WHEN c = 'Framework agreement' AND m > 0 THEN t / m * 12 END, 4) AS annualised_tender_amount, round(CASE WHEN c = 'Framework agreement' AND m > 0 THEN l / m * 12 END, 4) AS annualised_lot_amount FROM b"
)


@query("national_lots", _NATIONAL_SQL)
def national_lots(spark, sf_dir):
    return _national(spark, sf_dir).select(*_LOTS, *[_r(F.col(c)).alias(c) for c in _AMOUNTS])


_OT_DAY = "concat('200', CAST(l_orderkey % 10 AS STRING), '-05-01')"
derived["european_rows"] = (
    "lineitem",
    [
        "CAST(l_orderkey AS STRING) AS tender_id", "concat('L', CAST(l_linenumber AS STRING)) AS lot_lotId", "CASE WHEN l_orderkey % 11 = 0 THEN '2001-01-01' WHEN l_orderkey % 2 = 0 THEN '' END AS tender_cancellationDate",
        "CASE WHEN (l_orderkey + l_linenumber) % 13 = 0 THEN '2001-02-01' END AS lot_cancellationDate", "CASE l_linenumber % 4 WHEN 0 THEN 'PREAWARDED' WHEN 3 THEN 'ANNOUNCED' ELSE 'AWARDED' END AS lot_status",
        "concat('Buyer ', CAST(l_orderkey % 50 AS STRING)) AS buyer_name", "CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE lpad(CAST(l_orderkey % 50 AS STRING), 8, '0') END AS buyer_bodyIds", "CASE WHEN l_orderkey % 4 = 0 THEN 'dk ' WHEN l_orderkey % 4 = 1 THEN '' ELSE 'SE' END AS buyer_country",
        "CASE WHEN l_suppkey % 28 = 7 THEN NULL ELSE concat('Firm ', CAST(l_suppkey AS STRING)) END AS bidder_name", "CASE l_suppkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'DK-1' ELSE lpad(CAST(l_suppkey AS STRING), 8, '0') END AS bidder_bodyIds",
        "CASE l_suppkey % 5 WHEN 0 THEN NULL WHEN 1 THEN ' dk' WHEN 2 THEN 'se ' WHEN 3 THEN '' ELSE 'DK' END AS bidder_country", "CASE WHEN l_suppkey % 2 = 0 THEN 'yes' ELSE 'no' END AS bid_isWinning",
        "CASE WHEN l_orderkey % 3 = 0 THEN concat('EUR ', CAST(l_orderkey AS STRING), ',100.5') END AS tender_finalPrice_EUR", "CASE WHEN l_orderkey % 5 = 0 THEN CAST(l_orderkey * 90 AS STRING) END AS tender_estimatedPrice_EUR",
        "CASE WHEN l_orderkey % 4 = 0 THEN NULL ELSE CAST(l_suppkey * 10 + l_linenumber AS STRING) END AS bid_price_EUR", "CASE WHEN l_orderkey % 8 = 4 THEN CAST(l_linenumber * 1000 AS STRING) END AS lot_estimatedPrice_EUR",
        f"CASE WHEN l_orderkey % 2 = 0 THEN {_DAY} END AS tender_awardDecisionDate", f"{_OT_DAY} AS tender_publications_firstdContractAwardDate", "CASE l_orderkey % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' END AS tender_isFrameworkAgreement",
        "'2000-01-01' AS tender_estimatedStartDate", "CASE WHEN l_orderkey % 6 = 0 THEN '2012-12-31' END AS tender_estimatedCompletionDate", "CASE WHEN l_orderkey % 9 = 0 THEN '100' END AS tender_estimatedDurationInDays",
        "CASE WHEN l_orderkey % 9 IN (0, 3) THEN '12' END AS tender_estimatedDurationInMonths", "CASE WHEN l_orderkey % 2 = 1 THEN '2' END AS tender_estimatedDurationInYears", "CAST(l_linenumber % 3 AS STRING) AS lot_bidsCount", "CAST(l_orderkey % 4 AS STRING) AS tender_lots_count",
        f"concat({_CPV}, ',45000000') AS tender_cpvs", f"{_CPV} AS code", "CASE l_orderkey % 4 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' END AS tender_isAwarded",
    ],
)
_PRICE = "TRY_CAST(replace(regexp_extract({0}, '[0-9][0-9,]*\\.?[0-9]*'), ',', '') AS DOUBLE)"
_ERRORS = ({"tender_id": "9", "lot_id": "L1", "lot_amount": 41.0},)
_EUROPEAN_CTE = (
    with_("european_rows")
    + ", a AS (SELECT *, row_number() OVER (ORDER BY tender_id, lot_lotId, buyer_name NULLS LAST, buyer_bodyIds DESC NULLS LAST, bidder_name NULLS LAST, bidder_bodyIds DESC NULLS LAST, bid_isWinning = 'yes' DESC) AS row_id FROM european_rows "
    "WHERE lot_status IN ('AWARDED', 'PREAWARDED') AND coalesce(tender_cancellationDate, '') = '' AND coalesce(lot_cancellationDate, '') = ''), "
    "b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY tender_id, lot_lotId, bidder_bodyIds, bidder_name, buyer_bodyIds, buyer_name ORDER BY row_id) = 1), "
    f"c AS (SELECT *, coalesce({_PRICE.format('tender_finalPrice_EUR')}, {_PRICE.format('tender_estimatedPrice_EUR')}) AS t0, coalesce({_PRICE.format('bid_price_EUR')}, {_PRICE.format('lot_estimatedPrice_EUR')}) AS o, {_PRICE.format('bid_price_EUR')} AS bid_amount, "
    "coalesce(TRY_CAST(tender_awardDecisionDate AS DATE), CAST(tender_publications_firstdContractAwardDate AS DATE)) AS d, CASE tender_isFrameworkAgreement WHEN 'yes' THEN 'Framework agreement' WHEN 'no' THEN 'Public contract' END AS k, "
    "coalesce(CAST(tender_estimatedDurationInDays AS DOUBLE), CAST(tender_estimatedDurationInMonths AS DOUBLE) * 30, CAST(tender_estimatedDurationInYears AS DOUBLE) * 365) AS days FROM b), "
    "e AS (SELECT * FROM c WHERE NOT (tender_id = '9' AND lot_lotId = 'L1' AND round(o) = 41)), "
    "f AS (SELECT *, row_number() OVER (PARTITION BY tender_id, lot_lotId ORDER BY row_id) AS nth FROM e), "
    "s AS (SELECT tender_id, count(t0) AS nt, count(o) AS no, count(*) AS n, sum(o) FILTER (nth = 1) AS total, count(DISTINCT lot_lotId) AS n_lot FROM f GROUP BY tender_id), "
    "w AS (SELECT tender_id, lot_lotId, count(DISTINCT bidder_name) + CAST(bool_or(bidder_name IS NULL) AS INTEGER) AS suppliers FROM f GROUP BY ALL), "
    "g AS (SELECT *, CASE WHEN nt = 0 AND no = n THEN total ELSE t0 END AS t FROM f JOIN s USING (tender_id) JOIN w USING (tender_id, lot_lotId)), "
    "h AS (SELECT *, CASE WHEN lot_status = 'PREAWARDED' AND t IS NOT NULL THEN t / suppliers WHEN no = 0 THEN t / n_lot ELSE o END AS l FROM g) "
)
_EUROPEAN_SQL = (
    _EUROPEAN_CTE + "SELECT row_id, tender_id, lot_lotId AS lot_id, bidder_name AS winner_name_original, upper(trim(bidder_country)) AS winner_country, upper(trim(buyer_country)) AS buyer_country, round(t, 4) AS tender_amount, round(l, 4) AS lot_amount, round(bid_amount, 4) AS bid_amount, "
    "round(t * 7.46038, 3) AS tender_amount_dkk, round(l * 7.46038, 3) AS lot_amount_dkk, CAST(lot_bidsCount AS DOUBLE) AS n_bidders, d AS award_date, k AS contract_type, days AS framework_duration_days, "
    "CASE WHEN k = 'Framework agreement' THEN coalesce(CAST(tender_estimatedCompletionDate AS DATE), d + CAST(days AS INTEGER)) END AS framework_end_date, round(CASE WHEN k = 'Framework agreement' AND days > 0 THEN t / days * 365 END, 4) AS annualised_tender_amount, "
    "round(CASE WHEN k = 'Framework agreement' AND days > 0 THEN l / days * 365 END, 4) AS annualised_lot_amount, no = 0 AS flag_all_orig_lot_amt_missing, no = 0 AND n_lot > 1 AND t IS NOT NULL AS flag_lot_amt_equal_split, lot_status = 'PREAWARDED' AS flag_framework_prequalified, tender_isAwarded = 'yes' AS flag_awarded, "
    + _cpv_sql("code") + " FROM h"
)


def _european(spark, sf_dir):
    return cleaning.european(source(spark, sf_dir, "european_rows"), _ERRORS)


@query("european_lots", _EUROPEAN_SQL)
def european_lots(spark, sf_dir):
    df = _european(spark, sf_dir)
    kept = "row_id tender_id lot_id winner_name_original winner_country buyer_country n_bidders award_date contract_type framework_duration_days framework_end_date flag_all_orig_lot_amt_missing flag_lot_amt_equal_split flag_framework_prequalified flag_awarded cpv_code_first cpv_division cpv_division_name cpv_sector cpv_category".split()
    return df.select(*kept, *[_r(F.col(c), 3 if c.endswith("dkk") else 4).alias(c) for c in "tender_amount lot_amount bid_amount tender_amount_dkk lot_amount_dkk annualised_tender_amount annualised_lot_amount".split()])


# winners and buyers

_CLEAN = "nullif(regexp_replace(regexp_replace(regexp_replace(winner_cvr, '\\s+', '', 'g'), '[A-Za-z]', '', 'g'), '-', '', 'g'), '')"
_MISSING = "(x.cvr IS NULL OR x.cvr = '')"


def _flags_sql(who: str, blank_country: bool) -> str:
    """Flags of x.cvr, x.name and x.land in DuckDB's words."""
    land = "(x.land IS NULL OR x.land = '')" if blank_country else "x.land IS NULL"
    abroad = "coalesce(upper(trim(x.land)) <> 'DK' AND trim(x.land) <> '', false)" if blank_country else "coalesce(upper(trim(x.land)) <> 'DK', false)"
    name, valid = "(x.name IS NULL OR x.name = '')", "coalesce(regexp_full_match(x.cvr, '[0-9]{8}'), false)"
    return (
        f"{valid} AS valid_cvr, {_MISSING} AS flag_missing_{who}_cvr, {name} AS flag_missing_{who}_name, {land} AS flag_missing_{who}_country, {abroad} AS flag_foreign_{who}, {_MISSING} AND NOT {name} AS flag_missing_cvr_with_name, "
        f"NOT {_MISSING} AND NOT {valid} AS flag_review_cvr, {_MISSING} AND {name} AND {land} AS flag_no_{who}_info, ({_MISSING} AND NOT {name}) OR (NOT {_MISSING} AND NOT {valid}) AS flag_verify_cvr_external"
    )


@query("national_winner_flags", with_("notice_rows") + f", x AS (SELECT *, {_CLEAN} AS cvr, winner_name AS name, upper(trim(winner_country)) AS land, count(*) OVER (PARTITION BY tender_id, lot_id) AS k FROM notice_rows WHERE n_lot_winners > 0) SELECT tender_id, lot_id, name AS winner_name, cvr AS winner_cvr_clean, land AS winner_country, {_flags_sql('winner', False)}, coalesce(cvr <> winner_cvr, false) AS flag_winner_cvr_changed, k <> n_lot_winners AS flag_mismatch_winner_count, k <> n_lot_winners AS flag_review_n_winners, n_bids_received = '1' AS flag_single_bidder, CAST(n_lots AS INTEGER) > 1 AS flag_multilot, coalesce(tender_cancelled <> 'Nej', false) AS flag_cancelled, {_MISSING} AS flag_check_fuzzy_match, k AS n_winners_extracted FROM x")
def national_winner_flags(spark, sf_dir):
    from procurelake.functions import ids

    rows = source(spark, sf_dir, "notice_rows")
    lot = rows.select("tender_id", "lot_id", "n_lot_winners", "n_bids_received", "n_lots", "tender_cancelled", "winner_name").distinct()
    winners = rows.select("tender_id", "lot_id", F.monotonically_increasing_id().alias("at"), "winner_name", F.col("winner_cvr").alias("winner_cvr_candidate_original"), cleaning.country(F.col("winner_country")).alias("winner_country"), "tender_cancelled")
    # a lot's columns may differ between its rows here, so they are joined by the winner's name and state too
    df = cleaning.with_lot(winners, lot, ("tender_id", "lot_id", "winner_name", "tender_cancelled"))
    df = cleaning.with_winners(df).withColumn("winner_cvr_clean", ids.standardised(F.col("winner_cvr_candidate_original"))["cvr_clean"])
    out = cleaning.national_winners(df)
    return out.select("tender_id", "lot_id", "winner_name", "winner_cvr_clean", "winner_country", "n_winners_extracted", "valid_cvr", *[c for c in out.columns if c.startswith("flag_")])


@query("european_winner_flags", _EUROPEAN_CTE + f", x AS (SELECT *, CASE WHEN regexp_full_match(bidder_bodyIds, '[0-9]+') THEN bidder_bodyIds WHEN bidder_bodyIds IS NOT NULL THEN '1' END AS cvr, bidder_name AS name, upper(trim(bidder_country)) AS land FROM h) SELECT row_id, {_flags_sql('winner', True)}, CAST(tender_lots_count AS INTEGER) > 1 AS flag_multilot, false AS flag_cancelled, coalesce(name <> '', false) AND cvr IS NULL AS flag_check_fuzzy_match, lot_bidsCount = '1' AS flag_single_bidder FROM x")
def european_winner_flags(spark, sf_dir):
    df = _european(spark, sf_dir).withColumns({"winner_name": F.col("winner_name_original"), "winner_cvr_clean": F.nullif(F.regexp_replace("winner_cvr_original", "[^0-9]", ""), F.lit(""))})
    out = cleaning.european_parties(df, "winner")
    return out.select("row_id", "valid_cvr", *[c for c in out.columns if c in ("flag_multilot", "flag_cancelled", "flag_check_fuzzy_match", "flag_single_bidder", "flag_review_cvr", "flag_missing_cvr_with_name", "flag_verify_cvr_external") or c.startswith("flag_") and "winner" in c])


@query("european_buyer_flags", _EUROPEAN_CTE + f", x AS (SELECT *, buyer_bodyIds AS cvr, buyer_name AS name, upper(trim(buyer_country)) AS land FROM h) SELECT row_id, {_flags_sql('buyer', True)}, CAST(tender_lots_count AS INTEGER) > 1 AS flag_multilot, false AS flag_cancelled, cvr IS NULL AS flag_check_fuzzy_match FROM x")
def european_buyer_flags(spark, sf_dir):
    df = _european(spark, sf_dir).withColumns({"buyer_name": F.col("buyer_name_original"), "buyer_cvr_clean": F.col("buyer_cvr_original")})
    out = cleaning.european_parties(df, "buyer")
    return out.select("row_id", "valid_cvr", *[c for c in out.columns if c in ("flag_multilot", "flag_cancelled", "flag_check_fuzzy_match", "flag_review_cvr", "flag_missing_cvr_with_name", "flag_verify_cvr_external") or c.startswith("flag_") and "buyer" in c])


derived["buyer_rows"] = ("orders", ["CAST(o_orderkey AS STRING) AS tender_id", "'L1' AS lot_id", "CASE o_orderkey % 4 WHEN 0 THEN 'A; B' WHEN 1 THEN '' WHEN 2 THEN NULL ELSE concat('B ', CAST(o_custkey AS STRING)) END AS buyer_name_original", "CASE o_orderkey % 3 WHEN 0 THEN 'joint' WHEN 1 THEN 'single' END AS joint_tender", "o_orderkey % 5 = 0 AS is_listed"])


@query("national_buyer_flags", with_("buyer_rows") + f", x AS (SELECT *, upper(buyer_name_original) AS buyer_name FROM buyer_rows) SELECT tender_id, coalesce(joint_tender = 'joint' AND NOT is_listed, false) AS flag_joint_unlisted_buyers, coalesce(buyer_name <> buyer_name_original AND NOT is_listed, false) AS flag_single_buyer_name_changed, buyer_name IS NULL OR buyer_name = '' AS flag_missing_buyer_name, coalesce(length(buyer_name_original) - length(replace(buyer_name_original, ';', '')) = 0, false) AS flag_buyer_count_agree, NOT (buyer_name IS NULL OR buyer_name = '') AS flag_check_fuzzy_match FROM x")
def national_buyer_flags(spark, sf_dir):
    df = source(spark, sf_dir, "buyer_rows").withColumns({"buyer_name": F.upper("buyer_name_original"), "source": F.when(F.col("is_listed"), cleaning.LISTED).otherwise(cleaning.ALONE)})
    out = cleaning.national_buyers(df)
    return out.select("tender_id", *[c for c in out.columns if c.startswith("flag_")])


@query("single_or_several", with_("messy") + "SELECT id, coalesce(regexp_full_match(replace(raw, ' ', ''), '[0-9]{8}'), false) AS single, length(raw) - length(replace(raw, '-', '')) + 1 AS n_listed FROM messy")
def single_or_several(spark, sf_dir):
    return source(spark, sf_dir, "messy").select("id", cleaning.single_numbers(F.col("raw")).alias("single"), cleaning.listed(F.col("raw"), "-").cast("long").alias("n_listed"))


@query("candidates_to_match", with_("notice_rows") + ", x AS (SELECT winner_name, upper(trim(winner_country)) AS land FROM notice_rows WHERE winner_cvr IS NULL OR winner_cvr = '') SELECT winner_name, count(*) AS n FROM x WHERE land = 'DK' GROUP BY 1")
def candidates_to_match(spark, sf_dir):
    df = source(spark, sf_dir, "notice_rows").withColumn("flag_check_fuzzy_match", cleaning.sure(F.col("winner_cvr") == "") | F.col("winner_cvr").isNull())
    return cleaning.to_match(df, "winner").groupBy("winner_name").agg(F.count("*").alias("n"))


@query("lots_by_year", with_("awards") + "SELECT kind, CAST(year(day) AS INTEGER) AS year, count(*) AS n_lots FROM awards WHERE day IS NOT NULL GROUP BY ALL")
def lots_by_year(spark, sf_dir):
    from procurelake.plans import reports

    return reports.lots_by_year(source(spark, sf_dir, "awards"), ["kind"], "day")


