import numpy as np

from procurelake.llm import langid, queries

TEXTS = [("the cat and the dog are here", "en"), ("die katze und der hund sind hier", "de"), ("le chat et le chien sont ici", "fr")]


def brute(train, texts):
    """Naive Bayes over exact n-grams of one text at a time."""
    import collections
    import math
    import unicodedata

    def grams(t):
        low = "".join(c.lower() if unicodedata.category(c)[0] == "L" else " " for c in t)
        low = " " + low + " "
        while "  " in low:
            low = low.replace("  ", " ")
        return collections.Counter(low[i : i + n] for n in langid.SIZES for i in range(len(low) - n + 1))

    by = collections.defaultdict(collections.Counter)
    for t, lang in train:
        by[lang] += grams(t)
    out = []
    for t in texts:
        s = {x: sum(k * math.log((c[g] + langid.SMOOTHING) / (sum(c.values()) + langid.SMOOTHING * 2**langid.BITS)) for g, k in grams(t).items()) for x, c in sorted(by.items())}
        out.append(max(s, key=s.get))
    return out


def test_against_brute_force(spark):
    train = TEXTS * 3
    model = langid.train(spark.createDataFrame(train, "text string, lang string"))
    ask = ["the dog", "der hund und", "le chien", "sind hier", "Öl und Käse", "and"]
    got = {r.text: r.lang_pred for r in langid.predict(spark.createDataFrame([(t,) for t in ask], "text string"), model).collect()}
    assert [got[t] for t in ask] == brute(train, ask)


def test_edges(spark):
    model = langid.train(spark.createDataFrame([*TEXTS, (None, "en"), ("x", None), ("", "de")], "text string, lang string"))
    rows = [(1, None, "a", 1.0), (2, "", "a", 1.0), (3, "12 !! 34", None, 1.0), (4, "the cat " * 90000, "a", 1.0), (5, "ß", "a", 1.0), (5, "ß", "a", 1.0)]
    got = langid.predict(spark.createDataFrame(rows, "doc_id long, text string, lang_pred string, score double"), model)
    assert got.columns == ["doc_id", "text", "lang_pred", "score"]
    by = {r.doc_id: r for r in got.collect()}
    assert [by[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and by[4].lang_pred == "en" and by[1].score == 0
    assert all(0 <= r.score <= 1 for r in by.values())
    empty = spark.createDataFrame([], "text string, lang string")
    none = langid.train(empty)
    assert none[0] == [] and {r.lang_pred for r in langid.predict(empty.union(spark.createDataFrame(TEXTS, empty.schema)), none).collect()} == {"und"}
    assert langid.keep(got.select("doc_id", "text"), model, 0.0).count() == 3


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    got = queries.op6_language_id(spark, d).where("held_out").join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    assert np.mean(got.lang_pred == got.lang) > 0.97
