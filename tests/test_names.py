import datetime as dt

import pytest
from pyspark.sql import functions as F

from procurelake.functions import cpv, ids, names, scalars
from procurelake.operators import explode, linking, match, partitions


def one(spark, value, *columns, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(*columns).first()


@pytest.mark.parametrize(("raw", "found", "n"), [("CVR: 23456789", ["23456789"], 1), ("111151609", None, 0), ("12345678-87654321", ["12345678", "87654321"], 2), ("23456789; 87654321", ["23456789", "87654321"], 2), ("CVR missing", None, 0), ("DK55 77 52 14", ["55775214"], 1), (None, None, 0), ("", None, 0)])
def test_numbers(spark, raw, found, n):
    r = one(spark, raw, ids.valid_numbers(F.col("x")).alias("v"), ids.n_valid(F.col("x")).alias("n"))
    assert (r.v, r.n) == (found, n)


def test_recovered(spark):
    c = ids.recovered(F.col("x"), F.lit(" dk"), F.lit(0))
    assert [one(spark, v, c)[0] for v in ("DK-23 45 67 89", "12345678", "1234", None)] == ["23456789", None, None, None]


def test_prepared_name(spark):
    r = one(spark, "Moller & Son A/S", *[c.alias(k) for k, c in names.prepared(F.col("x")).items()])
    assert r.asDict() == {"name_basic": "moller & son", "name_clean": "moller og son", "name_no_spaces": "mollerogson", "name_broad": "mollerson", "firm_type": "a/s", "first_letter": "m"}
    r = one(spark, None, *[c.alias(k) for k, c in names.prepared(F.col("x")).items()])
    assert set(r.asDict().values()) == {None}


@pytest.mark.parametrize(("a", "b", "score"), [("moller og son", "different name", 59.26), ("firm a", "firm alpha", 75), ("ngi holdig", "ngi holding", 95.24)])
def test_likeness(spark, a, b, score):
    assert round(one(spark, a, names.likeness(F.col("x"), F.lit(b)))[0], 2) == score


def test_partitions():
    p = partitions.split_name("Firm A, Firm B & Firm C")
    assert [(x["partition_code"], x["partition_text"]) for x in p["partitions"]] == [(3, "Firm A; Firm B; Firm C"), (2, "Firm A, Firm B; Firm C"), (1, "Firm A; Firm B & Firm C")]
    p = partitions.split_name("Firm A A/S og Firm B ApS")
    assert (p["n_boundaries"], p["n_legal_forms"], len(p["partitions"])) == (1, 2, 1)
    assert partitions.split_name("a,b,c,d,e,f,g")["too_many_delimiters"] and partitions.split_name(None)["partitions"] == []
    assert partitions.split_name("Konsortiet Firm A sammen med Firm B")["partitions"][0]["segments"] == ["Firm A", "Firm B"]


def test_cpv(spark):
    r = one(spark, "3000000 - IA01; 45000000", *[c.alias(k) for k, c in cpv.cleaned(F.col("x")).items()])
    assert (r.cpv_code_first, r.cpv_division, r.cpv_category) == ("03000000", "03", "Supplies")
    assert one(spark, "none", *cpv.cleaned(F.col("x")).values())[0] is None


def test_scalars(spark):
    assert one(spark, "EUR 1,234.50", scalars.number_in(F.col("x")))[0] == 1234.5
    assert one(spark, "43831", scalars.sheet_date(F.col("x")))[0] == dt.date(2020, 1, 1)
    assert one(spark, "a;b;", scalars.pieces(F.col("x"), ";"))[0] == ["a", "b"]
    assert one(spark, "x/012345-2020/", scalars.notice_id(F.col("x")))[0] == "012345-2020"


def test_parallel_lists(spark):
    df = spark.createDataFrame([(1, "23456789; 87654321", "Firm A; Firm B", "DK; DK"), (2, None, None, None), (3, "1", "A;;C", None)], "id int, cvr string, name string, country string")
    got = [tuple(r) for r in explode.parallel(df, ["cvr", "name", "country"], "cvr").select("id", "entity_number", "cvr", "name", "country", "max_detected").orderBy("id", "entity_number").collect()]
    assert got == [(1, 1, "23456789", "Firm A", "DK", 2), (1, 2, "87654321", "Firm B", "DK", 2), (3, 1, "1", "A", None, 3), (3, 2, None, None, None, 3), (3, 3, None, "C", None, 3)]


def key(spark, rows):
    df = spark.createDataFrame(rows, "name string, cvr string, valid_from date, valid_to date")
    return match.keyed(df, "name", "name")


def test_link(spark):
    k = key(spark, [("Alpha Byg A/S", "1", None, None), ("Beta Data ApS", "2", None, None), ("Gamma Vej A/S", "3", dt.date(2025, 1, 1), None), ("Delta Transport A/S", "4", None, None), ("Alpha Byg", "8", None, None)])
    named = [(1, "ALPHA BYG A/S", dt.date(2020, 1, 1)), (2, "Beta-Data", None), (3, "Gamma Vej A/S", dt.date(2020, 1, 1)), (4, "Delta Tranport A/S", None), (5, "Konsortiet Alpha Byg A/S", None), (6, "unlike anything", None), (7, "Beta Data ApS og Delta Transport A/S", None), (8, None, None), (9, "og co", dt.date(2020, 1, 1))]
    rows = match.entities(spark.createDataFrame(named, "id int, name string, d date"), "name", "id", "d")
    out = linking.link(rows, k)
    got = {(r.match_id, r.expanded_number): (r.matched_cvr, r.name_match_step_code) for r in linking.codes(out, "european").collect()}
    no = "matching candidate: no match found"
    assert got == {(1, None): ("1", "exact: basic name and firm type"), (2, None): ("2", "exact: no spaces"), (3, None): (None, no), (4, None): ("4", "fuzzy: prepared main name"), (5, None): ("1", "exact consortium removed: basic name and firm type"), (6, None): (None, no), (7, 1): ("2", "exact partition: basic name and firm type"), (7, 2): ("4", "exact partition: basic name and firm type"), (8, None): (None, no), (9, None): (None, no)}
    assert linking.link(rows.limit(0), k).count() == 0


def test_unknown_forms_match_each_other(spark):
    """Names of stop words only have no broad form; with null_safe such rows meet such keys, by dates."""
    k = key(spark, [("Holding og Co", "1", dt.date(2019, 1, 1), None), ("Nordic Group", "2", None, None), ("Alpha", "3", None, None)])
    rows = match.entities(spark.createDataFrame([(i, "Data Invest", dt.date(2020, 1, 1)) for i in range(5)] + [(9, "Data Invest", dt.date(2001, 1, 1))], "id int, name string, d date"), "name", "id", "d")
    got = {r.match_id: (r.cvr, r.n_candidates, r.step) for r in match.exact(rows, k).collect()}
    assert got == {i: ("1", 2, 4) for i in range(5)} | {9: ("2", 1, 4)}
    assert match.exact(rows, k, null_safe=False).count() == 0


def test_partition_search(spark):
    k = key(spark, [("Alpha Byg A/S", "1", None, None), ("Beta Data ApS", "2", None, None)])
    rows = match.entities(spark.createDataFrame([(1, "Alpha Byg A/S og Beta Data ApS"), (2, "Alpha Byg A/S og Ukendt ApS"), (3, "plain")], "id int, name string"), "name", "id")
    told, parts = partitions.searched(rows, k)
    assert {r.match_id: r.partition_status for r in told.collect()} == {1: "accepted", 2: "partly matched"}
    assert sorted(r.segment_cvr for r in parts.collect()) == ["1", "2"]
    assert partitions.replaced(rows, parts).count() == 4


def test_wide(spark):
    k = key(spark, [("firm a", "1", None, None), ("firm ax", "2", None, None), ("firm axc", "3", None, None)])
    rows, _ = match.problems(match.entities(spark.createDataFrame([(1, "firm a")], "id int, name string"), "name", "id"))
    best, seen = match.fuzzy(rows, k)
    assert best.first().cvr == "1"
    r = match.wide(match.merged(seen)).first()
    assert (r.cvr_1, r.cvr_2, r.cvr_3, r.cvr_4) == ("1", "2", "3", None)


def test_forms_leave_a_blank(spark):
    r = one(spark, "x-a/s-y", *[c.alias(k) for k, c in names.prepared(F.col("x")).items()])
    assert (r.name_basic, r.firm_type) == ("x- -y", "a/s")
