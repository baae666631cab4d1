import math

import numpy as np

from procurelake.llm import queries, toxicity

CLEAN = ["a calm walk by the river", "the market opens at nine", "rain over the northern hills", "bread and butter for tea"]
TOXIC = ["you are a stupid clown today", "the stupid clown walks again", "what a stupid clown this is"]


def rows():
    return [(i, t, int(t in TOXIC)) for i, t in enumerate((CLEAN + TOXIC) * 4)]


def fitted(spark, data):
    df = spark.createDataFrame(data, "doc_id long, text string, toxic int")
    return toxicity.fit(df.select("doc_id", "text"), df.select("toxic", "doc_id"))


def test_ratios_are_those_of_brute_force(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string, toxic int").selectExpr("text", "toxic")
    toxicity_least, toxicity.LEAST_RATIO = toxicity.LEAST_RATIO, 0
    bins, r, p, q = toxicity.ratios(df)
    toxicity.LEAST_RATIO = toxicity_least
    grams = {(t, y): {f" {t} "[i : i + n] for n in toxicity.SIZES for i in range(len(t) + 3 - n)} for _, t, y in rows()}
    want = set()
    for g in set().union(*grams.values()):
        a, b = (sum(g in grams[t, y] for _, t, y in rows() if y == k) for k in (1, 0))
        want.add(round(math.log((a + 0.5) / (p + 1)) - math.log((b + 0.5) / (q + 1)), 9))
    assert (p, q) == (12, 16) and {round(x, 9) for x in r} <= want and len(bins)


def test_learns_and_scores(spark):
    model = fitted(spark, [*rows(), (90, "odd", None), (91, None, 0), (92, "x", 5)])
    ask = [(1, "such a stupid clown", 1.0), (2, "a calm river", 1.0), (3, None, 1.0), (4, "", 1.0), (5, "calm " * 400000, 1.0), (5, "calm " * 400000, 1.0)]
    got = toxicity.score(spark.createDataFrame(ask, "doc_id long, text string, score double"), model)
    assert got.columns == ["doc_id", "text", "score"]
    s = [(r.doc_id, r.score) for r in got.collect()]
    by = dict(s)
    assert len(s) == 6 and by[1] > 0.5 and max(by[i] for i in (2, 3, 4, 5)) < 0.3 and by[3] == by[4]


def test_no_or_one_class(spark):
    schema = "doc_id long, text string, toxic int"
    for data, least, most in (([], 0, 1e-9), ([(1, "a", 1)], 0.99, 1), ([(1, "a", 0)], 0, 0.01)):
        got = toxicity.score(spark.createDataFrame(rows(), schema), fitted(spark, data)).collect()
        assert all(least <= r.score <= most for r in got)
    assert toxicity.score(spark.createDataFrame([], schema), (np.zeros(1 << toxicity.BITS, np.float32), 0.0)).count() == 0


def test_held_out(spark):
    d = "/root/testdata/sf0.1"
    got = queries.op1_toxicity(spark, d).where("held_out").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").toPandas()
    assert got.predicted[got.toxic == 1].mean() > 0.85 and got.predicted[got.toxic == 0].mean() < 0.02
