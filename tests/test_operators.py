import datetime as dt
import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from procurelake.operators import checks, cleaning, explode, match, notices, panel, stats, tables
from procurelake.plans import reports
from procurelake.sources import files, register, workbook
from procurelake.streaming import incremental


def test_date_window(spark):
    rows = [(1, dt.date(2019, 1, 1), None), (2, dt.date(2025, 1, 1), None), (3, None, dt.date(2019, 1, 1))]
    df = spark.createDataFrame(rows, "id int, f date, t date")
    day = F.to_date(F.lit("2020-01-01"))
    assert sorted(r.id for r in df.where(match.valid_on(day, F.col("f"), F.col("t"))).collect()) == [1, 3]


COMPANY = {
    "cvrNummer": 1234567,
    "navne": [{"navn": "Old", "periode": {"gyldigFra": "2010-01-01", "gyldigTil": "2014-12-31"}}, {"navn": "New", "periode": {"gyldigFra": "2015-01-01", "gyldigTil": None}}],
    "livsforloeb": [{"periode": {"gyldigFra": "2010-01-01", "gyldigTil": None}}],
    "virksomhedsstatus": [{"status": "NORMAL", "periode": {"gyldigFra": "2010-01-01", "gyldigTil": "2015-06-30"}}, {"status": "CLOSED", "periode": {"gyldigFra": "2015-07-01", "gyldigTil": None}}],
    "virksomhedsform": [{"kortBeskrivelse": "APS", "periode": {"gyldigFra": "2010-01-01", "gyldigTil": None}}, {"kortBeskrivelse": "A/S", "periode": {"gyldigFra": "2012-01-01", "gyldigTil": None}}],
    "aarsbeskaeftigelse": [{"aar": 2011, "antalAnsatte": 3}, {"aar": 2015, "antalAnsatte": 5}],
    "maanedsbeskaeftigelse": [{"aar": 2015, "maaned": 2, "antalAnsatte": 4}],
}


def test_company_history(spark):
    df = panel.companies(spark.createDataFrame([(json.dumps(COMPANY),)], "doc string"), "doc")
    got = {(r.frequency, r.year): (r.antalAnsatte, r.status, r.legal_form, r.alive, str(r.period_end)) for r in panel.history(df).collect()}
    assert got == {("annual", 2011): (3, "NORMAL", "APS", True, "2011-12-31"), ("annual", 2015): (5, "CLOSED", "A/S", True, "2015-12-31"), ("monthly", 2015): (4, "NORMAL", "A/S", True, "2015-02-28")}
    n = {r.name: (r.cvr, str(r.valid_from), r.valid_to) for r in panel.name_periods(df).collect()}
    assert n["New"] == ("01234567", "2015-01-01", None) and n["Old"][2] == dt.date(2014, 12, 31)


def test_unit_months(spark):
    units = [{"pNummer": i, "virksomhedsrelation": [{"cvrNummer": 7, "periode": {"gyldigFra": "2015-01-01", "gyldigTil": None}}], "erstMaanedsbeskaeftigelse": [{"aar": 2014 + i, "maaned": 3, "antalAnsatte": 2, "intervalKodeAntalAnsatte": "A"}]} for i in (1, 1, 2)]
    units[1]["pNummer"] = 9
    got = {r.year: (r.cvr, r.antalAnsatte, r.n_units, r.intervalKodeAntalAnsatte) for r in panel.unit_months(spark.createDataFrame([(json.dumps(u),) for u in units], "doc string"), "doc").collect()}
    assert got == {2015: ("00000007", 4.0, 2, None), 2016: ("00000007", 2.0, 1, "A")}


EFORMS = """<ContractAwardNotice xmlns:efac="e" xmlns:cbc="c" xmlns:cac="a"><efac:NoticeResult>
<efac:LotTender><cbc:ID>T1</cbc:ID><efac:TenderingParty><cbc:ID>P1</cbc:ID></efac:TenderingParty><cac:LegalMonetaryTotal><cbc:PayableAmount currencyID="DKK">100</cbc:PayableAmount></cac:LegalMonetaryTotal></efac:LotTender>
<efac:LotTender><cbc:ID>T2</cbc:ID><efac:TenderingParty><cbc:ID>P2</cbc:ID></efac:TenderingParty><cac:LegalMonetaryTotal><cbc:PayableAmount currencyID="EUR">20</cbc:PayableAmount></cac:LegalMonetaryTotal></efac:LotTender>
<efac:SettledContract><efac:LotTender><cbc:ID>T1</cbc:ID></efac:LotTender></efac:SettledContract>
<efac:TenderingParty><cbc:ID>P1</cbc:ID><efac:Tenderer><cbc:ID>O1</cbc:ID></efac:Tenderer></efac:TenderingParty>
<efac:TenderingParty><cbc:ID>P2</cbc:ID><efac:Tenderer><cbc:ID>O2</cbc:ID></efac:Tenderer></efac:TenderingParty></efac:NoticeResult>
<efac:Organization><efac:Company><cac:PartyIdentification><cbc:ID>O1</cbc:ID></cac:PartyIdentification><cac:PartyName><cbc:Name>One</cbc:Name></cac:PartyName></efac:Company></efac:Organization>
<efac:Organization><efac:Company><cac:PartyIdentification><cbc:ID>O2</cbc:ID></cac:PartyIdentification><cac:PartyName><cbc:Name>Two</cbc:Name></cac:PartyName></efac:Company></efac:Organization></ContractAwardNotice>"""
LEGACY = "<TED_EXPORT><A><NB_TENDERS_RECEIVED>3</NB_TENDERS_RECEIVED><CONTRACTOR><N>x</N></CONTRACTOR></A></TED_EXPORT>"


def test_notices(spark):
    df = spark.createDataFrame([("a", EFORMS), ("b", LEGACY), ("c", None), ("d", "no xml")], "notice_id string, xml string")
    got = {r.notice_id: (r.schema, r.n_tenders_received, r.n_winners, r.had_non_winners, r.non_winners_listed, r.n_non_winners_named) for r in notices.indicators(df).collect()}
    assert got["a"] == ("eforms", 2, 1, True, True, 1) and got["b"] == ("legacy", 3, 1, True, False, 0)
    assert got["c"] == got["d"] == (None,) * 6
    bids = {r.tender: (r.company, r.bid_value, r.currency) for r in notices.bids(df.where("notice_id = 'a'")).collect()}
    assert bids == {"T1": ("One", 100.0, "DKK"), "T2": ("Two", 20.0, "EUR")}


def test_fixed_effects(spark):
    r = np.random.default_rng(0)
    rows = [(f, t, float(f * 2 + t + (0.5 if t == 1 else -0.3 if t == 2 else 0) * 3 + r.normal())) for f in range(30) for t in (-1, 0, 1, 2) if r.random() < 0.9]
    df = spark.createDataFrame(rows, "firm int, t int, y double").withColumn("half", F.col("firm") % 3)
    got = {c["time"]: c for c in stats.fixed_effects(df, "y", "t", -1, ["firm"], "firm")}
    x = np.array([[*(t == v for v in (0, 1, 2)), *(f == k for k in range(30))] for f, t, _ in rows], float)
    y = np.array([v for *_, v in rows])
    beta = np.linalg.lstsq(x, y, rcond=None)[0][:3]
    assert [got[v]["estimate"] for v in (0, 1, 2)] == pytest.approx(beta.tolist(), abs=1e-6) and all(c["error"] > 0 for c in got.values())


def test_tables(spark):
    df = spark.createDataFrame([(1, "a", None, 1), (2, "a", "5", 2), (3, "b", "6", 3), (4, "b", "7", 4), (5, "b", None, 5)], "id int, name string, cvr string, lot int").withColumn("ok", F.col("cvr").isNotNull())
    got = {r.id: (r.cvr, r.flag_borrowed, r.borrowed_from) for r in tables.borrowed(df, "name", "cvr", "ok", "id").collect()}
    assert got[1] == ("5", True, "2") and got[5] == (None, False, None) and got[3] == ("6", False, None)
    twin = spark.createDataFrame([(1, True), (1, False), (2, True)], "lot int, cancelled boolean")
    assert sorted(map(tuple, tables.without_cancelled_twins(twin, "lot", "cancelled").collect())) == [(1, False), (2, True)]
    assert checks.twin_lots(twin, "lot", "cancelled").count() == 0
    with pytest.raises(checks.Violation):
        checks.require(checks.unique(twin, ["lot"]), "unique")
    many = spark.createDataFrame([(1, "12345678, 23456789 og 34567891"), (2, "12345678")], "id int, cvr string")
    assert [(r.id, r.cvr, r.part_number) for r in explode.several_numbers(many, "cvr").orderBy("id", "part_number").collect()] == [(1, "12345678", 1), (1, "23456789", 2), (1, "34567891", 3), (2, "12345678", 1)]
    c = tables.concordance(df.selectExpr("name AS k", "cvr"), df.where("id < 4").selectExpr("name AS k", "cvr"), "k", "cvr").where("cvr = '7'").first()
    assert (c.same_name, c.any_same_name) == (False, True)
    s = reports.by_sample(df, {"all": F.lit(True), "low": F.col("id") < 3}).groupBy("sample").count().collect()
    assert {r["sample"]: r["count"] for r in s} == {"all": 5, "low": 2}


def test_files(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    (d / "a.csv").write_text('x;y\n1;"a;b"\nNA;\n')
    (d / "b.csv").write_text("y;x\nq;2\n")
    got = sorted((r.x, r.y, r.dataset) for r in files.extract(spark, str(d)).collect() if r.x)
    assert got == [("1", "a;b", "a.csv"), ("2", "q", "b.csv")]
    (d / "c.csv").write_text("x;z\n1;2\n")
    with pytest.raises(files.HeaderMismatch):
        files.concordant(spark, str(d))
    out = str(tmp_path / "t")
    files.save(spark.range(3).toDF("id"), out)
    assert files.replace_in_place(spark, out, lambda t: t.withColumn("v", F.col("id") * 2)).agg(F.sum("v")).first()[0] == 6
    done = spark.createDataFrame([(1, "ok", "v1"), (2, "http_500", "v1")], "id int, status string, version string")
    todo = files.left_to_do(spark.createDataFrame([(1,), (2,), (3,)], "id int"), done, "id", version="v1")
    assert sorted(r.id for r in todo.collect()) == [2, 3]
    with pytest.raises(ValueError):
        files.left_to_do(todo, done, "id", version="v2")
    q = incremental.take_new(incremental.drops(spark, str(d), "x string, y string"), str(tmp_path / "o"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "o")).count() == 4


def test_more_files(spark, tmp_path):
    d = tmp_path / "keys"
    d.mkdir()
    (d / "cvr_names_virk_20200101_000000.csv").write_text("cvr,name,gyldigfra,gyldigtil,more\n123,Æ,2019-01-02T00:00:00,,x\n", encoding="latin-1")
    found = files.newest(spark, str(d), r"^cvr_names_virk_[0-9]{8}_[0-9]{6}\.csv$")
    r = files.register_names(spark, found, encoding="ISO-8859-1").first()
    assert (r.cvr, r.name, str(r.valid_from), r.valid_to) == ("00000123", "Æ", "2019-01-02", None)
    with pytest.raises(FileNotFoundError):
        files.newest(spark, str(d), "^none$")
    assert files.typed(spark, found, "cvr int, name string, a string, b string, more string", ["cvr", "more"]).collect() == [(123, "x")]
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "chunk int, v string")
    path = str(tmp_path / "chunks")
    files.chunked({"summary": rows, "named": rows}, path, "chunk")
    again = files.chunked({"summary": rows.where("chunk = 2").withColumn("v", F.lit("c"))}, path, "chunk")["summary"]
    assert sorted((r.chunk, r.v) for r in again.collect()) == [(1, "a"), (2, "c")]


def test_swap_keeps_a_whole_table(spark, tmp_path):
    out = str(tmp_path / "t")
    files.save(spark.range(3).toDF("id"), out)
    with pytest.raises(Exception):
        files.replace_in_place(spark, out, lambda t: t.selectExpr("assert_true(id < 0) AS x"))
    assert spark.read.parquet(out).count() == 3
    files.replace_in_place(spark, out, lambda t: t.where("id > 0"))
    assert spark.read.parquet(out).count() == 2 and not [p for p in tmp_path.iterdir() if p.name.endswith(".old")]


def test_refreshed_refuses_several_rows(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    with pytest.raises(tables.DuplicateKeys):
        tables.refreshed(df, df.union(df), ["k"])
    assert tables.refreshed(df, df.limit(0), ["k"]).where("v IS NULL").count() == 2


def test_cleaning_edges(spark):
    raw = spark.createDataFrame([("1", None, None)], "`Løbenummer` string, `Nummerplade` string, id string").withColumns({c: F.lit(None).cast("string") for c in cleaning.NATIONAL if c not in ("Løbenummer", "Nummerplade")})
    out = cleaning.national(raw)
    assert out.columns[:2] == ["tender_id", "lot_id"] and "id" in out.columns and out.first().flag_awarded is False
    assert cleaning.national(raw.limit(0)).count() == 0
    wrong = spark.createDataFrame([("a", 1.2), ("a", None), ("a", 2.0), ("b", 1.0)], "tender_id string, lot_amount double")
    assert [tuple(r) for r in cleaning.without_errors(wrong, ({"tender_id": "a", "lot_amount": 1},)).collect()] == [("a", 2.0), ("b", 1.0)]
    left = spark.createDataFrame([(None, "L", "x"), ("1", "M", "y")], "tender_id string, lot_id string, v string")
    lots = spark.createDataFrame([(None, "L", "p", 1)], "tender_id string, lot_id string, v string, n int")
    assert sorted(((r.v, r.v_original, r.n) for r in cleaning.with_lot(left, lots).collect()), key=str) == [("x", "p", 1), ("y", None, None)]


def test_two_absorbed_effects(spark):
    r = np.random.default_rng(1)
    rows = [(f, t, f % 4, float(f + 3 * t + (2.0 if t > 1 and f % 2 else 0) + r.normal())) for f in range(24) for t in range(4) if r.random() < 0.9]
    df = spark.createDataFrame(rows, "firm int, t int, g int, y double").withColumn("d", ((F.col("t") > 1) & (F.col("firm") % 2 == 1)).cast("int"))
    got = stats.studies(df, ["y"], "d", 0, ["firm", "t"], "firm").first()
    x = np.array([[t > 1 and f % 2, *(f == k for k in range(24)), *(t == k for k in range(3))] for f, t, _, _ in rows], float)
    assert got.estimate == pytest.approx(np.linalg.lstsq(x, np.array([v for *_, v in rows]), rcond=None)[0][0], abs=1e-4)


def test_workbook(spark, tmp_path):
    path = tmp_path / "b.xlsx"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Data" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>name</t></si><si><t>Æ</t></si></sst>')
        z.writestr("xl/worksheets/s.xml", '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row><c r="A1"><v>9</v></c></row><row><c r="A2" t="s"><v>0</v></c><c r="B2" t="inlineStr"><is><t>n</t></is></c></row><row><c r="A3" t="s"><v>1</v></c><c r="B3"><v>43831</v></c></row><row><c r="B4"><v>2</v></c></row></sheetData></worksheet>')
    want = [("Æ", "43831"), (None, "2")]
    assert [tuple(r) for r in workbook.read_workbook(spark, str(path), "Data", 1).collect()] == want
    spark.dataSource.register(workbook.WorkbookSource)
    assert [tuple(r) for r in spark.read.format("workbook").options(path=str(path), sheet="Data", skip="1").load().collect()] == want


def test_register():
    class Fake(register.Client):
        def __init__(self, *a):
            self.pause, self.calls = 0, 0

        def send(self, path, body):
            self.calls += 1
            if self.calls == 1:
                raise OSError("down")
            page = [{"_source": {"n": self.calls}}] if self.calls < 4 else []
            return {"_scroll_id": "s", "hits": {"total": 2, "hits": page}}

    reader = register.RegisterReader({"url": "u", "index": "/i", "numbers": "1,2,3", "batch": "2"}, Fake)
    parts = reader.partitions()
    assert [p.numbers for p in parts] == [["1", "2"], ["3"]]
    assert [json.loads(r[0])["n"] for r in reader.read(parts[0])] == [2, 3]
    answers = iter([(503, "", "1"), (202, "", None), (200, "<x/>", None)])
    waits = []
    assert register.fetch_notice("1", "u/{}", lambda a: next(answers), waits.append) == ("ok", "<x/>") and waits == [1.0, 4.0]
    assert register.fetch_notice("1", "u/{}", lambda a: (404, "", None)) == ("not_found", None)
    assert register.fetch_notice("1", "u/{}", lambda a: (403, "", None))[0] == "http_403"
