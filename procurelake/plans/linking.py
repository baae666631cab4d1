"""Queries of links, their codes and reviews, with the SQL that they are held against."""

from __future__ import annotations

from pyspark.sql import functions as F

from procurelake.functions import names
from procurelake.operators import linking, match, partitions
from procurelake.plans import reports
from procurelake.plans.catalogue import _ON, _prepared_sql, _r, derived, query, source, with_

#: Registered names by two sources: main names, valid from a day, and by-names of some firms, which end on a day.
derived["by_names"] = ("part", ["concat(CASE p_partkey % 2 WHEN 0 THEN 'nova ' ELSE 'vest ' END, p_name, CASE p_partkey % 3 WHEN 0 THEN ' A/S' ELSE ' ApS' END) AS name", "lpad(CAST(p_partkey AS STRING), 8, '0') AS cvr", "p_partkey AS k"])
derived["wanted"] = (
    "part",
    [
        "p_partkey AS id",
        "CASE p_partkey % 8 WHEN 0 THEN upper(p_name) WHEN 1 THEN concat(p_name, ' A/S') WHEN 2 THEN concat(replace(p_name, ' ', '-'), ' ApS') WHEN 3 THEN concat('nova ', p_name, ' A/S') WHEN 4 THEN concat('vestt ', p_name, ' ApS') "
        "WHEN 5 THEN concat(p_name, 's K/S') WHEN 6 THEN concat('grow ', p_name, CAST(p_partkey AS STRING), ' A/S') ELSE concat('group ', replace(p_name, 'e', 'ee'), ' Amba') END AS name",
    ],
)
_KEY = (
    "main AS (SELECT arg_min(cvr, k) AS cvr, name, CAST('1990-01-01' AS DATE) + CAST(arg_min(gap, k) * 1000 AS INTEGER) AS valid_from, CAST(NULL AS DATE) AS valid_to, 1 AS src FROM registered GROUP BY name), "
    "side AS (SELECT min(cvr) AS cvr, name, CAST(NULL AS DATE) AS valid_from, CAST('1994-06-01' AS DATE) AS valid_to, 2 AS src FROM by_names GROUP BY name), key AS (SELECT * FROM main UNION ALL SELECT * FROM side), "
)


def _both_keys(spark, sf_dir):
    reg = source(spark, sf_dir, "registered").groupBy("name").agg(F.min_by("cvr", "k").alias("cvr"), F.min_by("gap", "k").alias("gap"))
    main = reg.select("name", "cvr", F.date_add(F.to_date(F.lit("1990-01-01")), (F.col("gap") * 1000).cast("int")).alias("valid_from"), F.lit(None).cast("date").alias("valid_to"))
    side = source(spark, sf_dir, "by_names").groupBy("name").agg(F.min("cvr").alias("cvr")).select("name", "cvr", F.lit(None).cast("date").alias("valid_from"), F.to_date(F.lit("1994-06-01")).alias("valid_to"))
    return match.keyed(main, "name", "name").unionByName(match.keyed(side, "name", "biname"))


def _wanted(spark, sf_dir):
    return match.entities(source(spark, sf_dir, "wanted").withColumn("day", F.date_add(F.to_date(F.lit("1995-01-01")), (F.col("id") % 365).cast("int"))), "name", "id", "day")


_VALID = "(b.valid_from IS NULL OR a.day >= b.valid_from - 730) AND (b.valid_to IS NULL OR a.day <= b.valid_to + 730)"
_ACTIVE = "CASE WHEN (valid_from IS NULL OR day >= valid_from) AND (valid_to IS NULL OR day <= valid_to) THEN 0 ELSE 1 END"
_DAYS = "CAST('1995-01-01' AS DATE) + CAST(a.id % 365 AS INTEGER)"


def _ladder(rows: str, first: int = 1) -> str:
    """Tables cand, ok, exact_ of rows (id, day and the forms)."""
    return (
        "cand AS (" + " UNION ALL ".join(f"SELECT a.id, a.day, {first + i} AS step, b.cvr, b.name, b.src, b.valid_from, b.valid_to FROM {rows} a JOIN key_p b ON {on} WHERE {_VALID}" for i, on in enumerate(_ON))
        + "), ok AS (SELECT *, min(step) OVER (PARTITION BY id) AS low FROM cand), exact_ AS (SELECT id, step, arg_min(cvr, (src, " + _ACTIVE + ", coalesce(valid_from, CAST('9999-12-31' AS DATE)), cvr, name)) AS cvr, arg_min(src, (src, " + _ACTIVE + ", coalesce(valid_from, CAST('9999-12-31' AS DATE)), cvr, name)) AS src, count(DISTINCT cvr) AS n_candidates FROM ok WHERE step = low GROUP BY id, step)"
    )


def _pass(i: int, src: int, name: str, letter: str, limit: float, before: str) -> str:
    """Tables met, rank and take of a fuzzy pass over problems that are not in `before`."""
    like = f"100.0 * (length(a.{name}) + length(b.{name}) - levenshtein(a.{name}, b.{name})) / (length(a.{name}) + length(b.{name}))"
    return (
        f"met{i} AS (SELECT a.p, b.cvr, {like} AS score, a.day, b.name, b.valid_from, b.valid_to FROM problem a JOIN key_p b ON a.firm_type = b.firm_type AND a.{letter} = b.{letter} WHERE b.src = {src} AND a.{name} IS NOT NULL AND b.{name} IS NOT NULL AND {_VALID}{before}), "
        f"one{i} AS (SELECT p, cvr, max(score) AS score, min((-score, {_ACTIVE}, coalesce(valid_from, CAST('9999-12-31' AS DATE)))) AS o FROM met{i} GROUP BY p, cvr), "
        f"rank{i} AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY o, cvr) AS rank, max(score) OVER (PARTITION BY p) AS top FROM one{i}), "
        f"take{i} AS (SELECT p, {5 if name == 'name_clean' else 6} AS step, any_value(cvr) FILTER (rank = 1) AS cvr, {src} AS src, max(score) AS score FROM rank{i} GROUP BY p HAVING max(score) > {limit} AND count(*) FILTER (score = top) = 1)"
    )


_SETUP = with_("registered", "by_names", "wanted") + ", " + _KEY + _prepared_sql("wanted") + ", " + _prepared_sql("key") + f", asked AS (SELECT *, {_DAYS} AS day, substring(name_broad, 1, 1) AS broad_letter FROM (SELECT * FROM wanted_p) a), "
_SETUP = _SETUP.replace("key_p AS (SELECT *,", "key_p AS (SELECT *, ").replace("substring(array_to_string(m, ' '), 1, 1) AS first_letter FROM key_c", "substring(array_to_string(m, ' '), 1, 1) AS first_letter, substring(nullif(array_to_string(list_sort(list_filter(m, lambda x: NOT list_contains([" + ", ".join(f"'{x}'" for x in names.STOP_WORDS) + "], x))), ''), ''), 1, 1) AS broad_letter FROM key_c")
_LINKED = (
    _SETUP + _ladder("asked") + ", rest AS (SELECT *, (name_clean, name_broad, firm_type, day) AS p FROM asked ANTI JOIN exact_ USING (id)), problem AS (SELECT DISTINCT p, name_clean, name_broad, firm_type, day, first_letter, broad_letter FROM rest), "
    + _pass(1, 1, "name_clean", "first_letter", 85, "") + ", " + _pass(2, 2, "name_clean", "first_letter", 85, " AND a.p NOT IN (SELECT p FROM take1)") + ", "
    + _pass(3, 1, "name_broad", "broad_letter", 86, " AND a.p NOT IN (SELECT p FROM take1 UNION ALL SELECT p FROM take2)") + ", " + _pass(4, 2, "name_broad", "broad_letter", 89, " AND a.p NOT IN (SELECT p FROM take1 UNION ALL SELECT p FROM take2 UNION ALL SELECT p FROM take3)")
    + ", near AS (SELECT * FROM take1 UNION ALL SELECT * FROM take2 UNION ALL SELECT * FROM take3 UNION ALL SELECT * FROM take4), "
    "linked AS (SELECT id AS match_id, step AS match_step, cvr AS matched_cvr, src, n_candidates, 100.0 AS score, 'exact' AS match_method FROM exact_ UNION ALL SELECT id, step, cvr, src, 1, score, 'fuzzy' FROM rest JOIN near USING (p) "
    "UNION ALL SELECT id, NULL, NULL, NULL, NULL, NULL, NULL FROM rest ANTI JOIN near USING (p)) "
)
_WORDS = "CASE match_step WHEN 1 THEN 'basic name and firm type' WHEN 2 THEN 'no spaces and firm type' WHEN 3 THEN 'no spaces' WHEN 4 THEN 'broad name' END"
_NEAR = "CASE WHEN match_step = 5 THEN 'prepared ' ELSE 'broad ' END || CASE WHEN src = 1 THEN 'main name' ELSE 'biname' END"


@query("linked_entities", _LINKED + "SELECT match_id, match_method, match_step, matched_cvr, CASE src WHEN 1 THEN 'name' WHEN 2 THEN 'biname' END AS name_source, n_candidates, round(score, 4) AS score FROM linked")
def linked_entities(spark, sf_dir):
    out = linking.link(_wanted(spark, sf_dir), _both_keys(spark, sf_dir))
    return out.select("match_id", "match_method", "match_step", "matched_cvr", "name_source", "n_candidates", _r(F.col("score")).alias("score"))


def _national(spark, sf_dir):
    """Linked rows of which some state a number, are not asked for or lie abroad."""
    out = linking.link(_wanted(spark, sf_dir), _both_keys(spark, sf_dir), splits=False)
    n = F.col("match_id")
    return out.withColumns({"stated_cvr": F.when(n % 5 == 0, F.lpad(n.cast("string"), 8, "0")), "flag_check_fuzzy_match": n % 5 != 0, "country": F.when(n % 7 == 0, "SE").when(n % 11 != 0, " dk"), "source": F.when(n % 2 == 0, "single winners").otherwise("multiple winners")}).withColumns(
        {c: F.when(n % 5 != 0, F.col(c)) for c in ("matched_cvr", "match_step", "match_method", "name_source", "n_candidates", "score")}
    )


_REVIEWED = (
    _LINKED + ", s AS (SELECT match_id, match_id % 5 <> 0 AS ask, CASE WHEN match_id % 5 = 0 THEN lpad(CAST(match_id AS VARCHAR), 8, '0') END AS stated, match_id % 7 <> 0 AND match_id % 11 <> 0 AS dk, CASE WHEN match_id % 5 <> 0 THEN matched_cvr END AS cvr, "
    "CASE WHEN match_id % 5 <> 0 THEN match_step END AS match_step, CASE WHEN match_id % 5 <> 0 THEN match_method END AS method, src, CASE WHEN match_id % 5 <> 0 THEN n_candidates END AS n FROM linked), "
    f"r AS (SELECT *, CASE method WHEN 'exact' THEN 'exact matching: ' || {_WORDS} WHEN 'fuzzy' THEN 'fuzzy matching: ' || {_NEAR} END AS way, cvr IS NOT NULL AS found, coalesce(cvr IS NOT NULL AND n > 1, false) AS unclear, cvr IS NOT NULL AND (method = 'fuzzy' OR n > 1) AS look FROM s) "
)


@query("national_winner_review", _REVIEWED + "SELECT match_id, coalesce(way, CASE WHEN stated IS NOT NULL THEN CASE WHEN match_id % 2 = 0 THEN 'CVR source: single CVR row' ELSE 'CVR source: multiple CVR separation' END WHEN dk THEN 'matching candidate: no match found' ELSE 'not a matching candidate: not marked as Danish' END) AS name_match_step_code, unclear AS flag_name_match_ambiguous, coalesce(look, false) AS flag_review_name_match, ask AND (NOT found OR look) AS flag_manual_name_review, coalesce(stated, cvr) AS final_cvr, CASE WHEN NOT ask THEN 'not requested' WHEN look THEN 'manual review - fuzzy or ambiguous match' WHEN found THEN 'matched' WHEN NOT dk THEN 'manual review - not marked as Danish' ELSE 'manual review - no automatic match' END AS name_match_status FROM r")
def national_winner_review(spark, sf_dir):
    out = linking.reviewed(_national(spark, sf_dir), "national winner")
    return out.select("match_id", "name_match_step_code", "flag_name_match_ambiguous", "flag_review_name_match", "flag_manual_name_review", "final_cvr", "name_match_status")


@query("national_buyer_review", _REVIEWED + "SELECT match_id, coalesce(way, 'match failure') AS name_match_step_code, cvr AS final_cvr, CASE WHEN NOT ask THEN 'not requested' WHEN look THEN 'manual review - fuzzy or ambiguous match' WHEN found THEN 'matched' ELSE 'manual review - no automatic match' END AS name_match_status FROM r")
def national_buyer_review(spark, sf_dir):
    return linking.reviewed(_national(spark, sf_dir).drop("stated_cvr", "country"), "national buyer").select("match_id", "name_match_step_code", "final_cvr", "name_match_status")


@query("rows_to_review", _REVIEWED + "SELECT name_match_status, count(*) AS n FROM (SELECT CASE WHEN look THEN 'manual review - fuzzy or ambiguous match' WHEN NOT dk THEN 'manual review - not marked as Danish' ELSE 'manual review - no automatic match' END AS name_match_status FROM r WHERE ask AND (NOT found OR look)) GROUP BY 1")
def rows_to_review(spark, sf_dir):
    return linking.to_review(linking.reviewed(_national(spark, sf_dir), "national winner")).groupBy("name_match_status").agg(F.count("*").alias("n"))


@query("link_status", _REVIEWED + ", c AS (SELECT CASE WHEN method = 'exact' AND n > 1 THEN 'ambiguous exact' ELSE coalesce(method, 'unmatched') END AS status FROM r) SELECT s.status, count(c.status) AS n, round(count(c.status) / (SELECT count(*) FROM c), 6) AS share FROM (SELECT unnest(['exact', 'ambiguous exact', 'fuzzy', 'unmatched']) AS status) s LEFT JOIN c USING (status) GROUP BY s.status")
def link_status(spark, sf_dir):
    rows = _national(spark, sf_dir)
    state = F.when((F.col("match_method") == "exact") & (F.col("n_candidates") > 1), "ambiguous exact").otherwise(F.coalesce("match_method", F.lit("unmatched")))
    return reports.method_shares(rows.select(state.alias("status")), "status", ["exact", "ambiguous exact", "fuzzy", "unmatched"]).withColumn("share", _r(F.col("share"), 6))


@query("review_reasons", _REVIEWED + "SELECT 'Fuzzy match' AS reason, CAST(count(*) FILTER (method = 'fuzzy') AS DOUBLE) AS value, round(count(*) FILTER (method = 'fuzzy') / count(*), 6) AS share FROM r UNION ALL SELECT 'Ambiguous exact match', count(*) FILTER (method = 'exact' AND n > 1), round(count(*) FILTER (method = 'exact' AND n > 1) / count(*), 6) FROM r UNION ALL SELECT 'No automatic match', count(*) FILTER (cvr IS NULL), round(count(*) FILTER (cvr IS NULL) / count(*), 6) FROM r")
def review_reasons(spark, sf_dir):
    return reports.review_reasons(_national(spark, sf_dir)).withColumn("share", _r(F.col("share"), 6))


@query("matches_by_step", _REVIEWED + "SELECT method AS match_method, match_step, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM r WHERE method IS NOT NULL GROUP BY ALL")
def matches_by_step(spark, sf_dir):
    from procurelake.operators import tables

    return tables.shares(_national(spark, sf_dir).where("match_method IS NOT NULL"), ["match_method", "match_step"]).withColumn("share", _r(F.col("share"), 6))


#: The best candidates of all passes side by side, for problems that no exact step matched.
_SEEN = " UNION ALL ".join(f"SELECT p, cvr, rank, score, {i} AS pass, {5 if i < 3 else 6} AS step, {1 if i % 2 else 2} AS src FROM rank{i} WHERE rank <= 5" for i in range(1, 5))


@query("candidates_side_by_side", _LINKED + f", seen AS ({_SEEN}), best AS (SELECT p, cvr, min((-score, step, CASE src WHEN 1 THEN 'name' ELSE 'biname' END, rank)) AS o FROM seen GROUP BY p, cvr), again AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY o, cvr) AS r FROM best) SELECT p[1] AS name_clean, p[3] AS firm_type, p[4] AS match_date, any_value(cvr) FILTER (r = 1) AS cvr_1, any_value(cvr) FILTER (r = 2) AS cvr_2, any_value(cvr) FILTER (r = 5) AS cvr_5, round(any_value(-o[1]) FILTER (r = 1), 4) AS score_1, round(any_value(-o[1]) FILTER (r = 5), 4) AS score_5, any_value(o[2]) FILTER (r = 1) AS step_1 FROM again WHERE r <= 5 GROUP BY p")
def candidates_side_by_side(spark, sf_dir):
    from procurelake.operators.session import settled

    rows, key = settled(_wanted(spark, sf_dir)), settled(_both_keys(spark, sf_dir))
    rest = rows.join(match.exact(rows, key).select("match_id"), "match_id", "left_anti")
    distinct, _ = match.problems(settled(rest))
    distinct = settled(distinct)
    _, seen = match.fuzzy(distinct, key)
    out = match.wide(match.merged(seen)).join(distinct.select("problem", "name_clean", "firm_type", "match_date"), "problem")
    return out.select("name_clean", "firm_type", "match_date", "cvr_1", "cvr_2", "cvr_5", _r(F.col("score_1")).alias("score_1"), _r(F.col("score_5")).alias("score_5"), "step_1")


# names of several firms

_TWO = "SELECT p_partkey AS id, p_name AS a, concat('Firma ', CAST(p_partkey AS VARCHAR), ' A/S') AS b FROM part"


@query("name_partitions", f"WITH x AS ({_TWO}), t AS (SELECT unnest([1, 2, 3]) AS code) SELECT id, 2 AS n_boundaries, 2 AS n_legal_forms, code AS partition_code, 4 - code AS partition_id, CASE code WHEN 3 THEN a || '; ' || b || '; Byg ApS' WHEN 2 THEN a || ' og ' || b || '; Byg ApS' ELSE a || '; ' || b || ', Byg ApS' END AS partition_text FROM x, t")
def name_partitions(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("p_partkey AS id", "concat(p_name, ' og Firma ', p_partkey, ' A/S, Byg ApS') AS name")
    out = partitions.eligible(partitions.partitioned(df, "name")).select("id", "split.n_boundaries", "split.n_legal_forms", F.explode("split.partitions").alias("p"))
    return out.select("id", "n_boundaries", "n_legal_forms", "p.partition_code", "p.partition_id", "p.partition_text")


#: Names of two firms, each registered or not, and their search.
derived["pairs"] = ("part", ["p_partkey AS id", "concat(p_name, ' A/S') AS a", "CASE p_partkey % 4 WHEN 0 THEN 'red bolt ApS' WHEN 1 THEN 'blue gear K/S' WHEN 2 THEN 'nobody knows ApS' ELSE concat(p_name, ' A/S') END AS b"])
_SEGMENTS = (
    with_("registered", "by_names", "pairs") + ", " + _KEY + "wanted AS (SELECT id * 2 + n AS id, CASE n WHEN 0 THEN a ELSE b END AS name FROM pairs, (SELECT unnest([0, 1]) AS n)), " + _prepared_sql("wanted") + ", " + _prepared_sql("key")
    + ", asked AS (SELECT *, CAST('1995-01-01' AS DATE) + CAST((id // 2) % 365 AS INTEGER) AS day FROM wanted_p), " + _ladder("asked")
    + ", per AS (SELECT a.id // 2 AS id, count(e.cvr) AS n_matched, count(*) FILTER (e.n_candidates = 1) AS n_unique, count(DISTINCT e.cvr) AS n_firms FROM asked a LEFT JOIN exact_ e USING (id) GROUP BY 1) "
)


def _searched(spark, sf_dir):
    df = source(spark, sf_dir, "pairs").withColumn("name", F.concat("a", F.lit(" og "), "b")).withColumn("day", F.date_add(F.to_date(F.lit("1995-01-01")), (F.col("id") % 365).cast("int")))
    rows = match.entities(df, "name", "id", "day")
    return rows, *partitions.searched(rows, _both_keys(spark, sf_dir))


@query("partition_search", _SEGMENTS + "SELECT id AS match_id, CASE WHEN n_matched = 2 AND n_unique = 2 AND n_firms = 2 THEN 'accepted' WHEN n_matched > 0 THEN 'partly matched' ELSE 'not matched' END AS partition_status, CAST(n_matched = 2 AND n_unique = 2 AND n_firms = 2 AS BIGINT) AS n_complete FROM per")
def partition_search(spark, sf_dir):
    return _searched(spark, sf_dir)[1].select("match_id", "partition_status", F.col("n_complete").cast("long").alias("n_complete"))


@query("partition_rows", _SEGMENTS + "SELECT match_id, expanded_number, expanded_cvr, expanded_step, flag_expanded FROM (SELECT p.id AS match_id, 1 + e.id % 2 AS expanded_number, e.cvr AS expanded_cvr, e.step AS expanded_step, true AS flag_expanded FROM per p JOIN exact_ e ON e.id // 2 = p.id WHERE n_matched = 2 AND n_unique = 2 AND n_firms = 2 UNION ALL SELECT id, NULL, NULL, NULL, false FROM per WHERE NOT (n_matched = 2 AND n_unique = 2 AND n_firms = 2))")
def partition_rows(spark, sf_dir):
    rows, _, parts = _searched(spark, sf_dir)
    return partitions.replaced(rows, parts).select("match_id", F.col("expanded_number").cast("long").alias("expanded_number"), "expanded_cvr", "expanded_step", "flag_expanded")


@query("split_results", _SEGMENTS + ", k AS (SELECT *, n_matched = 2 AND n_unique = 2 AND n_firms = 2 AS ok FROM per), t AS (SELECT count(*) AS rows, count(*) FILTER (ok) AS split, sum(CASE WHEN ok THEN 2 ELSE 1 END) AS all_ FROM k) SELECT 'rows eligible for the split' AS measure, rows AS n, 1.0 AS share, 'candidates' AS share_of FROM t UNION ALL SELECT 'rows with one accepted split', split, round(split / rows, 6), 'eligible rows' FROM t UNION ALL SELECT 'firm rows of accepted splits', 2 * split, round(2 * split / all_, 6), 'output rows' FROM t")
def split_results(spark, sf_dir):
    rows, _, parts = _searched(spark, sf_dir)
    out = reports.split_results(partitions.replaced(rows, parts).withColumn("eligible", F.lit(True)), "match_id", "eligible", "flag_expanded")
    return out.withColumn("share", _r(F.col("share"), 6))


# codes of the European side, by made-up states

_STATE = {"step": "1 + id % 9", "method": "CASE id % 4 WHEN 0 THEN 'exact' WHEN 1 THEN 'fuzzy' WHEN 2 THEN 'exact' END", "src": "CASE id % 3 WHEN 0 THEN 'name' ELSE 'biname' END", "expanded": "id % 12 = 0", "filled": "id % 17 = 3", "stated": "CASE WHEN id % 8 = 3 THEN '12121212' END", "source": "CASE id % 5 WHEN 0 THEN 'single winner' WHEN 1 THEN 'multiple confirmed winners' ELSE 'x' END", "asked": "id % 6 <> 1", "country": "CASE id % 10 WHEN 3 THEN 'SE' WHEN 7 THEN NULL ELSE 'dk ' END", "several": "id % 13 = 0"}
derived["states"] = ("part", ["p_partkey AS id", *[f"{v.replace('id', 'p_partkey')} AS {k}" for k, v in _STATE.items()]])
_EXACT_WORD = "CASE s WHEN 1 THEN 'basic name and firm type' WHEN 2 THEN 'no spaces and firm type' WHEN 3 THEN 'no spaces' WHEN 4 THEN 'broad name' END"


@query("european_review", with_("states") + f", a AS (SELECT *, CASE WHEN step <= 8 THEN (step - 1) % 4 + 1 END AS s, coalesce(upper(trim(country)) = 'DK', false) AS dk, method IS NOT NULL AS found FROM states), b AS (SELECT *, found AND (method = 'fuzzy' OR id % 3 = 0) OR (several AND NOT expanded) AS look FROM a) SELECT id, CASE WHEN expanded AND step <= 4 THEN 'exact partition: ' || {_EXACT_WORD} WHEN method = 'exact' AND step <= 4 THEN 'exact: ' || {_EXACT_WORD} WHEN method = 'exact' AND step <= 8 THEN 'exact consortium removed: ' || {_EXACT_WORD} WHEN method = 'fuzzy' AND step IN (5, 6) THEN 'fuzzy: ' || CASE step WHEN 5 THEN 'prepared ' ELSE 'broad ' END || CASE src WHEN 'name' THEN 'main name' ELSE 'biname' END WHEN filled THEN 'source: same-name CVR fill' WHEN stated <> '' THEN CASE source WHEN 'single winner' THEN 'source: single CVR cleaning' WHEN 'multiple confirmed winners' THEN 'source: multiple CVR separation' ELSE 'source: existing CVR, unclassified' END WHEN asked AND dk THEN 'matching candidate: no match found' WHEN asked THEN 'not a matching candidate: not marked as Danish' ELSE 'not a matching candidate: no CVR name' END AS name_match_step_code, CASE WHEN expanded OR (asked AND dk AND NOT several AND found) THEN CASE WHEN found THEN 'cvr' END ELSE stated END AS final_cvr, CASE WHEN expanded THEN 'matched - separated winner name' WHEN NOT asked THEN 'not requested' WHEN several THEN 'manual review - potential multiple winners' WHEN look THEN 'manual review - fuzzy or ambiguous match' WHEN method = 'exact' AND step BETWEEN 5 AND 8 THEN 'matched - consortium language removed' WHEN found THEN 'matched' WHEN NOT dk THEN 'manual review - not marked as Danish' ELSE 'manual review - no automatic match' END AS name_match_status FROM b")
def european_review(spark, sf_dir):
    df = source(spark, sf_dir, "states").withColumns({"matched_cvr": F.when(F.col("method").isNotNull(), "cvr"), "n_candidates": F.when(F.col("id") % 3 == 0, 2).otherwise(1)})
    df = df.withColumnsRenamed({"step": "match_step", "method": "match_method", "src": "name_source", "expanded": "flag_expanded", "filled": "flag_filled", "stated": "stated_cvr", "asked": "flag_check_fuzzy_match", "several": "flag_potential_multiple"})
    return linking.reviewed(df, "european").select("id", "name_match_step_code", "final_cvr", "name_match_status")
