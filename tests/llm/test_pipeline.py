import corpus_pipeline as cp
from pyspark.sql import functions as F

from procurelake.llm import packing
from tests.llm.test_near import brute as near_brute
from tests.llm.test_packing import check as packing_check
from tests.llm.test_quality import brute as quality_brute

DIR = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    docs = docs.union(spark.createDataFrame([(9001, None, None, None, None), (9002, "", "en", "x", 0), (9003, "12 34", None, "x", 5)], docs.schema)).cache()
    before = {r.doc_id: r for r in docs.collect()}

    out = cp.language(spark, docs, DIR).cache()
    assert out.columns == COLUMNS
    kept = {r.doc_id for r in out.collect()}
    assert kept == {i for i in before if i < 9000 and any(c.isalpha() for c in before[i].text)}

    docs, out = out, cp.rules(spark, out, DIR).cache()
    kept = {r.doc_id for r in out.collect()}
    assert out.columns == COLUMNS and not any(quality_brute(before[i].text)[5] for i in kept)
    labels = {r.doc_id for r in spark.read.parquet(f"{DIR}/labels.parquet").where("quality = 1").collect()}
    good = [i for i in labels if not quality_brute(before[i].text)[5]]
    assert sum(i in kept for i in good) > 0.97 * len(good)

    docs, out = out, cp.near_duplicates(spark, out, DIR).cache()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert out.columns == COLUMNS
    assert sorted(r.doc_id for r in out.collect()) == sorted({c for _, _, c in near_brute(rows, 80)})

    docs, out = out, cp.passages(spark, out, DIR).cache()
    assert out.columns == COLUMNS
    least, want = {}, {}
    rows = sorted((r.doc_id, r.text.encode()) for r in docs.collect())
    for d, b in rows:
        for i in range(len(b) - 49):
            least.setdefault(b[i : i + 50], d)
    for d, b in rows:
        gone = set()
        for i in range(len(b) - 49):
            if least[b[i : i + 50]] < d:
                gone.update(range(i, i + 50))
        t = bytes(x for i, x in enumerate(b) if i not in gone).decode("utf-8", "ignore")
        if t:
            want[d] = t
    assert {r.doc_id: r.text for r in out.collect()} == want and all(r.n_chars == len(r.text) for r in out.collect())

    final = cp.packed(spark, out, DIR)
    assert [f.name for f in final.schema] == [x.split()[0] for x in packing.PIECE.split(", ")]
    packing_check([(r.doc_id, r.text) for r in out.collect()], final.collect(), 0.001)


def test_empty(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").limit(0)
    for name, stage in cp.STAGES:
        out = stage(spark, docs, DIR)
        assert out.count() == 0, name


def test_run(spark):
    assert cp.run(spark, DIR).agg(F.countDistinct("doc_id")).first()[0] > 50
