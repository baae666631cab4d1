"""Further queries of the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from procurelake.functions import scalars
from procurelake.operators import explode, panel, stats, tables
from procurelake.plans import reports
from procurelake.plans.catalogue import _r, query, source, with_
from procurelake.sources import files


@query("scalar_functions", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN CAST('1899-12-30' AS DATE) + CAST(40000 + o_orderkey % 1000 AS INTEGER) ELSE CAST(o_orderdate AS DATE) END AS day, CAST(o_orderkey % 1000 AS DOUBLE) + 1000000.5 AS number, lpad(CAST(o_custkey AS VARCHAR), 8, '0') AS number_text, least(5, greatest(-5, o_orderkey % 20 - 10)) AS bin, (o_orderkey >> 1) & 1 = 1 AS second_bit, CAST(floor((CAST('2010-01-01' AS DATE) - CAST(o_orderdate AS DATE)) / 365.25) AS INTEGER) AS age FROM orders")
def scalar_functions(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/orders.parquet")
    key, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    text = F.when(key % 2 == 0, (40000 + key % 1000).cast("string")).otherwise(F.concat(day.cast("string"), F.lit(" 00:00")))
    number = F.concat(F.lit("EUR 1,000,"), F.lpad((key % 1000).cast("string"), 3, "0"), F.lit(".5 net"))
    return df.select(
        key.alias("id"),
        scalars.sheet_date(text).alias("day"),
        scalars.number_in(number).alias("number"),
        scalars.registry_id(F.col("o_custkey").cast("string")).alias("number_text"),
        scalars.clamped(key % 20 - 10, -5, 5).alias("bin"),
        F.get(scalars.bits(key, 3), F.lit(1)).alias("second_bit"),
        scalars.years_between(day, F.to_date(F.lit("2010-01-01"))).alias("age"),
    )


@query("several_numbers", "WITH s AS (SELECT c_custkey AS id, lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS a, lpad(CAST(c_custkey + 7 AS VARCHAR), 8, '0') AS b FROM customer) SELECT id, CASE WHEN id % 2 = 0 THEN CASE n WHEN 1 THEN a ELSE b END ELSE a END AS cvr, n AS part_number FROM s, unnest([1, 2]) AS t(n) WHERE id % 2 = 0 OR n = 1")
def several_numbers(spark, sf_dir):
    eight = "lpad(CAST({} AS STRING), 8, '0')"
    raw = f"CASE WHEN c_custkey % 2 = 0 THEN concat({eight.format('c_custkey')}, ' og ', {eight.format('c_custkey + 7')}) ELSE {eight.format('c_custkey')} END AS cvr"
    return explode.several_numbers(spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("c_custkey AS id", raw), "cvr")


@query("split_lists", "SELECT o_orderkey AS id, CAST(i AS INTEGER) AS number, nullif([CAST(o_custkey AS VARCHAR), '', o_orderstatus][i], '') AS part FROM orders, unnest([1, 2, 3]) AS t(i)")
def split_lists(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_orderkey AS id", "concat(CAST(o_custkey AS STRING), ' ; ;', o_orderstatus, ';') AS part")
    return explode.delimited(df, "part", number="number")


@query("split_between_winners", with_("lots") + ", n AS (SELECT tender, flag, count(DISTINCT winner) AS k FROM lots GROUP BY ALL) SELECT tender, lot, winner, round(CASE WHEN status = 'O' THEN lot_amount / k ELSE lot_amount END, 4) AS lot_amount FROM lots JOIN n USING (tender, flag)")
def split_between_winners(spark, sf_dir):
    df = tables.split_between(source(spark, sf_dir, "lots"), ["tender", "flag"], "winner", "lot_amount", F.col("status") == "O")
    return df.select("tender", "lot", "winner", _r(F.col("lot_amount")).alias("lot_amount"))


@query("cancelled_twins", with_("lots") + ", t AS (SELECT *, bool_or(flag = 'R') OVER (PARTITION BY tender) AND bool_or(flag <> 'R') OVER (PARTITION BY tender) AS twin FROM lots) SELECT tender, lot, winner, flag FROM t WHERE NOT (twin AND flag = 'R')")
def cancelled_twins(spark, sf_dir):
    df = source(spark, sf_dir, "lots").withColumn("cancelled", F.col("flag") == "R")
    return tables.without_cancelled_twins(df, "tender", "cancelled").select("tender", "lot", "winner", "flag")


@query("valid_entries", with_("lots") + ", t AS (SELECT DISTINCT tender, winner, CAST(winner AS INTEGER) % 2 = 0 AS ok FROM lots), u AS (SELECT *, bool_or(ok) OVER (PARTITION BY tender) AS anyone FROM t) SELECT tender, winner, CAST(row_number() OVER (PARTITION BY tender ORDER BY winner) AS INTEGER) AS number FROM u WHERE ok OR NOT anyone")
def valid_entries(spark, sf_dir):
    df = source(spark, sf_dir, "lots").select("tender", "winner", (F.col("winner").cast("int") % 2 == 0).alias("ok")).distinct()
    return tables.valid_if_any(df, ["tender"], "ok", "winner", "number").select("tender", "winner", "number")


@query("refreshed_attributes", "SELECT o_orderkey AS tender, c_mktsegment AS segment FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_custkey % 2 = 0")
def refreshed_attributes(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_orderkey AS tender", "o_custkey AS firm", "'stale' AS segment")
    new = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_custkey % 2 = 0").selectExpr("c_custkey AS firm", "c_mktsegment AS segment")
    return tables.refreshed(rows, new, ["firm"]).select("tender", "segment")


@query("left_to_do", "SELECT c_custkey AS id FROM customer WHERE c_custkey % 3 <> 0")
def left_to_do(spark, sf_dir):
    all_ = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("c_custkey AS id")
    done = all_.selectExpr("id", "CASE id % 3 WHEN 0 THEN CASE WHEN id % 2 = 0 THEN 'ok' ELSE 'not_found' END ELSE 'http_500' END AS status", "'v1' AS version")
    return files.left_to_do(all_, done, "id", version="v1")


@query("event_panel", with_("awards") + ", e AS (SELECT firm, min(year(day)) AS first FROM awards GROUP BY firm), y AS (SELECT firm, CAST(year(day) AS INTEGER) AS year, count(*) AS n FROM awards GROUP BY ALL) SELECT firm, year, CAST(year - first AS INTEGER) AS event_time, CAST(greatest(-2, least(2, year - first)) AS INTEGER) AS event_bin, n FROM y JOIN e USING (firm)")
def event_panel(spark, sf_dir):
    df = source(spark, sf_dir, "awards").withColumn("year", F.year("day"))
    first = df.groupBy("firm").agg(F.min("year").alias("first"))
    return panel.event_panel(df.groupBy("firm", "year").agg(F.count("*").alias("n")), first, "firm", "year", "first", 2).select("firm", "year", "event_time", "event_bin", "n")


@query("measures", with_("lots") + "SELECT 'lots' AS measure, CAST(count(*) AS DOUBLE) AS value FROM lots UNION ALL SELECT 'winners', count(DISTINCT winner) FROM lots UNION ALL SELECT 'with amount', count(lot_amount) FROM lots")
def measures(spark, sf_dir):
    return tables.measures(source(spark, sf_dir, "lots"), **{"lots": F.count(F.lit(1)), "winners": F.countDistinct("winner"), "with amount": F.count("lot_amount")})


@query("cleaning_summary", with_("lots") + "SELECT 'open' AS measure, CAST(count(*) FILTER (status = 'O') AS DOUBLE) AS value, round(count(*) FILTER (status = 'O') / count(*) FILTER (lot > 1), 6) AS share FROM lots UNION ALL SELECT 'returned', count(*) FILTER (flag = 'R'), round(count(*) FILTER (flag = 'R') / count(*) FILTER (lot > 1), 6) FROM lots")
def cleaning_summary(spark, sf_dir):
    out = reports.cleaning_summary(source(spark, sf_dir, "lots"), F.col("lot") > 1, open=F.col("status") == "O", returned=F.col("flag") == "R")
    return out.withColumn("share", _r(F.col("share"), 6))


@query("row_level_result", with_("lots") + ", r AS (SELECT tender, CASE WHEN bool_or(lot = 7) THEN 'expanded' WHEN bool_or(flag = 'R') THEN 'exact' WHEN bool_or(flag = 'A') THEN 'fuzzy' ELSE 'none' END AS result FROM lots GROUP BY tender) SELECT result, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM r GROUP BY result")
def row_level_result(spark, sf_dir):
    df = source(spark, sf_dir, "lots").withColumns({"method": F.when(F.col("flag") == "R", "exact").when(F.col("flag") == "A", "fuzzy"), "expanded": F.col("lot") == 7})
    return reports.row_level_result(df, "tender", "method", "expanded").withColumn("share", _r(F.col("share"), 6))


@query("samples", with_("awards") + "SELECT sample, count(*) AS n, count(DISTINCT firm) AS n_firms FROM (SELECT firm, 'all' AS sample FROM awards UNION ALL SELECT firm, 'urgent' FROM awards WHERE kind = '1-URGENT' UNION ALL SELECT firm, 'large' FROM awards WHERE amount > 100000) GROUP BY sample")
def samples(spark, sf_dir):
    df = reports.by_sample(source(spark, sf_dir, "awards"), {"all": F.lit(True), "urgent": F.col("kind") == "1-URGENT", "large": F.col("amount") > 100000})
    return df.groupBy("sample").agg(F.count("*").alias("n"), F.countDistinct("firm").alias("n_firms"))


@query("name_concordance", "WITH o AS (SELECT p_brand AS k, p_type AS name, p_partkey AS id FROM part), n AS (SELECT DISTINCT p_brand AS k, p_type AS name FROM part WHERE p_partkey % 3 = 0) SELECT id, n.k IS NOT NULL AS same_name, bool_or(n.k IS NOT NULL) OVER (PARTITION BY o.k) AS any_same_name FROM o LEFT JOIN n ON o.k = n.k AND o.name = n.name")
def name_concordance(spark, sf_dir):
    old = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("p_brand AS k", "p_type AS name", "p_partkey AS id")
    return tables.concordance(old, old.where("id % 3 = 0"), "k", "name").select("id", "same_name", "any_same_name")


@query("old_name_scores", "WITH o AS (SELECT DISTINCT p_brand AS k, p_type AS name FROM part WHERE p_partkey % 2 = 0), n AS (SELECT DISTINCT p_brand AS k, p_type AS name FROM part WHERE p_partkey % 3 = 0), b AS (SELECT o.k, o.name, max(100.0 * (length(o.name) + length(n.name) - levenshtein(o.name, n.name)) / (length(o.name) + length(n.name))) AS best FROM o JOIN n USING (k) GROUP BY ALL) SELECT count(*) AS n, round(median(best), 4) AS median, round(avg(CAST(best > 85 AS INTEGER)), 6) AS above_85 FROM b")
def old_name_scores(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("p_brand AS k", "p_type AS name", "p_partkey AS id")
    out = reports.best_old_name_scores(df.where("id % 2 = 0").select("k", "name").distinct(), df.where("id % 3 = 0"), "k", "name")
    return out.select("n", _r(F.col("median")).alias("median"), _r(F.col("above_85"), 6).alias("above_85"))


@query("recoverable_rows", "WITH s AS (SELECT p_brand AS name, CAST(p_partkey % 30 AS VARCHAR) AS number FROM part), n AS (SELECT name, number, count(*) AS n FROM s GROUP BY ALL) SELECT count(*) AS n_pairs, CAST(sum(least(a.n, b.n)) AS BIGINT) AS n_rows FROM n a JOIN n b ON a.name = b.name AND a.number < b.number WHERE levenshtein(a.number, b.number) = 1")
def recoverable_rows(spark, sf_dir):
    return reports.recoverable(spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("p_brand AS name", "CAST(p_partkey % 30 AS STRING) AS number"), "name", "number")


@query("numbers_per_name", "WITH p AS (SELECT p_name, count(DISTINCT p_size) AS n_numbers FROM part GROUP BY 1) SELECT n_numbers, count(*) AS n_names FROM p GROUP BY 1")
def numbers_per_name(spark, sf_dir):
    return reports.numbers_per_name(spark.read.parquet(f"{sf_dir}/part.parquet"), "p_name", "p_size")


@query("found_in_panel", with_("awards") + ", f AS (SELECT DISTINCT kind, firm FROM awards), p AS (SELECT DISTINCT firm FROM awards WHERE amount > 250000) SELECT kind, count(*) AS n_firms, round(avg(CAST(p.firm IS NOT NULL AS INTEGER)), 6) AS share_found FROM f LEFT JOIN p USING (firm) GROUP BY kind")
def found_in_panel(spark, sf_dir):
    df = source(spark, sf_dir, "awards")
    return reports.found_in_panel(df, df.where("amount > 250000"), ["kind"], "firm").withColumn("share_found", _r(F.col("share_found"), 6))


@query("missing_shares", with_("lots") + "SELECT flag, round(avg(CAST(lot_amount IS NULL AS INTEGER)), 6) AS lot_amount, round(avg(CAST(tender_amount IS NULL AS INTEGER)), 6) AS tender_amount FROM lots GROUP BY flag")
def missing_shares(spark, sf_dir):
    return reports.missing(source(spark, sf_dir, "lots"), ["flag"], ["lot_amount", "tender_amount"]).withColumns({c: _r(F.col(c), 6) for c in ("lot_amount", "tender_amount")})


@query("around_key_end", with_("awards") + "SELECT year(day) <= 1998 AS within_key, count(*) AS n, round(avg(CAST(amount > 200000 AS INTEGER)), 6) AS unmatched_rate FROM awards GROUP BY 1")
def around_key_end(spark, sf_dir):
    return reports.unmatched_around_key_end(source(spark, sf_dir, "awards"), F.year("day"), F.col("amount") > 200000, 1998).withColumn("unmatched_rate", _r(F.col("unmatched_rate"), 6))


@query("histogram", with_("awards") + "SELECT CAST(CASE WHEN amount < 0 THEN 0 WHEN amount >= 500000 THEN 31 ELSE floor(amount / (500000.0 / 30)) + 1 END AS BIGINT) AS bin, count(*) AS n FROM awards GROUP BY 1")
def histogram(spark, sf_dir):
    return tables.histogram(source(spark, sf_dir, "awards"), "amount", 0.0, 500000.0, 30)


@query("overview", with_("awards") + ", p AS (SELECT kind, firm, count(DISTINCT tender) AS n FROM awards GROUP BY ALL), q AS (SELECT kind, count(*) AS n_firm, avg(n) AS m, stddev_samp(n) AS s FROM p GROUP BY kind) SELECT kind, min(year(day)) || '-' || max(year(day)) AS years, count(*) AS n_rows, count(DISTINCT firm) AS n_firms, count(DISTINCT tender) AS n_tenders, round(avg(amount / 1e6), 6) AS mean_millions, round(stddev_samp(amount / 1e6), 6) AS sd_millions, round(avg(ln(amount)), 6) AS mean_log, any_value(n_firm) AS n_firm, round(any_value(m), 6) AS mean_tenders, round(any_value(s), 6) AS sd_tenders FROM awards JOIN q USING (kind) GROUP BY kind")
def overview(spark, sf_dir):
    out = reports.overview(source(spark, sf_dir, "awards"), ["kind"], F.year("day"), "firm", "tender", "amount")
    return out.withColumns({c: _r(F.col(c), 6) for c in ("mean_millions", "sd_millions", "mean_log", "mean_tenders", "sd_tenders")})


@query("correlation", with_("lots") + "SELECT round(corr(lot_amount, tender_amount), 6) AS r FROM lots")
def correlation(spark, sf_dir):
    return stats.correlation(source(spark, sf_dir, "lots"), "lot_amount", "tender_amount").select(_r(F.col("r"), 6).alias("r"))
