import collections
import math
import re
import unicodedata

import pytest

from procurelake.llm import quality as q
from procurelake.llm import queries

HARD = [None, "", " \n\t ", "one", "a a a a", "a b c a b c", "x\n x\nx\n\n \nx", "# $$ <|> & * %", "é ñ 中文 🙂 ß", "a b c d " * 30, "w\x0bv\x0cu\rt", "z " * 5000, "the of and " * 60, "nbsp x"]


def brute(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    g = list(zip(w, w[1:], w[2:]))
    n = collections.Counter(g)
    hit = {i + k for i, x in enumerate(g) if n[x] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)


def test_counts(spark):
    df = spark.createDataFrame([(i, t, -1) for i, t in enumerate([*HARD, "a b"])], "doc_id long, text string, n_words int")
    got = {r.doc_id: r for r in q.measured(df, []).collect()}
    for i, t in enumerate(HARD):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(t), t
    assert q.measured(df.limit(0), ["a"]).count() == 0


def test_clashing_hashes(spark, monkeypatch):
    monkeypatch.setattr(q.F, "xxhash64", lambda *c: q.F.length(c[0]).cast("long") * (1 << 40))
    texts = ["a b c d e a b c x y", "p q r s t u v w", "aa b aa b aa c dd b aa b"]
    got = [r.n_repeat_words for r in q.measured(spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1), []).collect()]
    assert got == [brute(t)[4] for t in texts]


def spread(counts, share):
    """Jensen-Shannon distance of a Counter of bins to a reference's shares, by its definition."""
    n, total = sum(counts.values()), 0.0
    for k in set(counts) | set(share):
        a, b = counts.get(k, 0) / n, share.get(k, 0.0)
        m = (a + b) / 2
        total += sum(x * math.log2(x / m) / 2 for x in (a, b) if x)
    return math.sqrt(max(0.0, total))


def kind(c):
    if c in " \t\n\x0b\x0c\r":
        return "space"
    if c.isalpha():
        return "plain" if "a" <= c <= "z" else "upper" if unicodedata.category(c) == "Lu" else "lower"
    return next((k for k, cs in (("digit", "0123456789"), ("stop", ".,;:!?'\"()-"), ("symbol", "#*$%&|<>"), ("mark", "@^~_=+/\\[]{}`")) if c in cs), "other")


def lowered(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t.lower())


def brute_verdicts(rows):
    """doc_id -> kept, from (doc_id, text, lang)."""
    words, chars = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for _, t, lang in rows:
        if lang is not None:
            words[lang].update(lowered(t or ""))
            chars[lang].update(map(kind, t or ""))
    words = {k: v for k, v in words.items() if sum(v.values()) >= q.REFERENCE_WORDS}
    known = {w for c in words.values() for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0].encode()))[: q.COMMON_WORDS]}

    def shares(c):
        n = sum(c.values())
        return {k: v / n for k, v in c.items()}

    def binned(ws):
        return collections.Counter(w if w in known else None for w in ws)

    refs = [(shares(chars[k]), shares(binned(c.elements()))) for k, c in words.items()]
    out = {}
    for d, t, _ in rows:
        n, *_, failed = brute(t)
        far = bool(refs) and n >= q.CLASS_WORDS and min(spread(collections.Counter(map(kind, t)), a) for a, _ in refs) > q.CLASS_LIMIT
        far |= bool(refs) and n >= q.WORD_WORDS and min(spread(binned(lowered(t)), b) for _, b in refs) > q.WORD_LIMIT
        out[d] = not failed and not far
    return out


def test_distance(spark):
    counts, refs = [3, 0, 1], [[0.5, 0.25, 0.25], [0.0, 0.9, 0.1]]
    want = min(spread(collections.Counter(dict(enumerate(counts))), dict(enumerate(r))) for r in refs)
    own = q.F.array(*[q.F.struct(q.F.lit(i + 1).alias("bin"), q.F.lit(x).cast("long").alias("n")) for i, x in enumerate(counts) if x])
    assert spark.range(1).select(q._nearest(own, refs).alias("d")).first().d == pytest.approx(want)


def test_histograms(spark):
    r = q.measured(spark.createDataFrame([("The the of ÄB é c1 .,# \n the",)], "text string"), ["of", "the", "und"]).first()
    assert {x.bin: x.n for x in r.word_counts} == {1: 1, 2: 3, 4: 4}
    assert dict(zip([*q.CLASSES, "other"], r.class_counts)) == {"plain": 11, "space": 9, "lower": 1, "upper": 3, "digit": 1, "stop": 2, "symbol": 1, "mark": 0, "other": 0}


def test_junk_beside_each_language(spark):
    """A text without a language's common words is far from its reference, whatever the language."""
    for ws in ("the of and to in is that it for was", "il di che non per sono gli della", "og i at det en til af som"):
        clean = lambda n, ws=ws.split(): " ".join(f"{w} wort{n}{'abcdefghij'[i % 10]}{'klmnop'[i % 6]} satz{'qrstu'[i % 5]}{i}" for i, w in enumerate(ws * 40))
        junk = " ".join(f"wort{'abcdefghijklmnopqrst'[i % 20]}{'uvwxyzabcdefg'[i // 20]}" for i in range(200))
        refs = q.references(spark.createDataFrame([(clean(k), ws) for k in "xyz"], "text string, lang string"))
        got = q.judged(spark.createDataFrame([(junk,), (clean("x"),)], "text string").coalesce(1), refs).collect()
        assert got[0].word_distance > q.WORD_LIMIT and got[1].word_distance < q.WORD_LIMIT


def test_query(spark):
    d = "/root/testdata/sf0.01"
    got = queries.op7_quality(spark, d)
    assert not any(w in got._jdf.queryExecution().executedPlan().toString() for w in ("Python", "Pandas", "Arrow"))
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "lang").collect()]
    texts, verdicts = {i: t for i, t, _ in rows}, brute_verdicts(rows)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    got, good = got.collect(), []
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(texts[r.doc_id])
        assert r.kept == verdicts[r.doc_id], r
        if labels.get(r.doc_id) == 1 and not r.base_failed:
            good.append(r.kept)
    assert sum(good) / len(good) > 0.99


def test_no_references(spark):
    none = q.references(spark.createDataFrame([], "text string, lang string"))
    assert none == ([], [], [])
    r = q.judged(spark.createDataFrame([("a b c " * 3,), (None,), (" ".join(map(str, range(99))),)], "text string"), none).collect()
    assert [x.kept for x in r] == [False, False, True]
