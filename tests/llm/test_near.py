import random
import re

import numpy as np
import pyarrow as pa
import pytest

from procurelake.llm import near, queries, text
from tests.oracle import same


def brute_set(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(rows, percent):
    s = [brute_set(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= percent * len(s[i] | s[j]):
                up[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            groups[find(i)] = min(d, groups.get(find(i), d))
    return sorted(((d, len(s[i]), groups.get(find(i))) for i, (d, _) in enumerate(rows)), key=repr)


def test_sets():
    texts = ["", "a", "A b", "a b c d e f", "a  b\tc\nd e f", " x " * 9, "é É ß a b c", None, "a b c d e a b c d e", "p q\x0br s t u v w x y " * 60]
    b = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
    for limit in (1, 50, 1 << 20):
        got = []
        for _, data, offsets in text.blocks(b, limit=limit):
            h, edge = near.sets(data, offsets)
            got += [set(h[i:j].tolist()) for i, j in zip(edge[:-1], edge[1:])]
        assert [len(g) for g in got] == [len(brute_set(t)) for t in texts]
        assert got[3] == got[4] and not got[1] & got[2]


def planted(n=60):
    r = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(n):
        base = [r.choice(words) for _ in range(r.choice([3, 8, 60, 200, 400]))]
        for _ in range(r.choice([1, 2, 3, 7])):
            t = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 4])):
                t[r.randrange(len(t))] = r.choice(words)
            rows.append((r.randrange(10**6), " ".join(t)))
    return rows


def test_against_brute_force(spark):
    rows = planted() + [(1, None), (2, ""), (3, " \n"), (None, "null id here and there again"), (7, "null id here and there again"), (8, "same id"), (8, "Same  ID"), (8, "same id"), (None, "lonely text without any id at all")]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, kept int")
    for percent in (80, 85):
        got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in near.linked(df, percent).collect()), key=repr)
        want = [(d, n, c if n else d) for d, n, c in brute(rows, percent)]
        assert got == want
    assert near.linked(df.limit(0)).count() == 0
    assert near.kept(df.limit(0)).columns == df.columns


def test_query_is_its_sql(spark):
    assert same(spark, queries.op3_near_duplicates, queries.oracle_sql()["op3_near_duplicates"], "/root/testdata/sf0.01") == 1000


def test_crowded_region(spark):
    r = random.Random(1)
    base = [f"x{i}" for i in range(300)]
    rows = []
    for d in range(400):
        t = list(base)
        t[r.randrange(300)] = f"y{d}"
        rows.append((d, " ".join(t)))
    got = near.linked(spark.createDataFrame(rows, "doc_id long, text string"), 85).collect()
    assert {x.component_id for x in got} == {0} and np.sum([x.kept for x in got]) == 1


def test_star(spark, monkeypatch):
    """Over 1000 variants of one text that are like it, but not like each other."""
    r = random.Random(4)
    base = [f"x{i}" for i in range(600)]
    rows = [(0, " ".join(base))]
    for d in range(1, 1201):
        t = list(base)
        for k in r.sample(range(0, 600, 5), 9):
            t[k + r.randrange(5)] = f"y{d}"
        rows.append((d, " ".join(t)))
    rows += [(5000 + d, " ".join(base[:300] + [f"z{d}_{i}" for i in range(300)])) for d in range(300)]
    s = [brute_set(t) for _, t in rows[:1201]]
    assert all(100 * len(s[0] & x) >= 85 * len(s[0] | x) for x in s)
    assert len({c for _, _, c in brute(rows[1:60], 85)}) > 50
    monkeypatch.setattr(near, "CHUNK", 500)
    got = near.linked(spark.createDataFrame(rows, "doc_id long, text string"), 85).collect()
    assert {x.component_id for x in got if x.doc_id < 5000} == {0}
    assert all(x.kept for x in got if x.doc_id >= 5000)


@pytest.mark.parametrize("changed, apart", [(3, 5), (3, 10), (2, 7)])
def test_pairs_over_one_template(spark, changed, apart):
    """Recall of links between pairs that share most of their words with all others, without being like them."""
    r = random.Random(changed * apart)
    base, rows = [f"x{i}" for i in range(400)], []
    for p in range(150):
        a = list(base)
        for k in r.sample(range(400), apart):
            a[k] = f"p{p}_{k}"
        b = list(a)
        for k in r.sample(range(0, 400, 7), 2 * changed):
            b[k] = f"q{p}_{k}"
        rows += [(2 * p, " ".join(a)), (2 * p + 1, " ".join(b))]
    want = brute(rows, 85)
    got = sorted(((x.doc_id, x.n_shingles, x.component_id) for x in near.linked(spark.createDataFrame(rows, "doc_id long, text string"), 85).collect()), key=repr)
    links = sum(c != d for d, _, c in want)
    found = sum(c == w != d for (d, _, c), (_, _, w) in zip(got, want))
    print(f"recall {found} of {links}")
    assert links > 100 and found >= 0.98 * links and all(c == d for (d, _, c), (_, _, w) in zip(got, want) if w == d)


def test_common():
    r = random.Random(6)
    own = [{r.randrange(80) for _ in range(r.randrange(1, 40))} | {r.randrange(10**6) for _ in range(9)} for _ in range(60)]
    got = near.common([np.array(sorted(s), np.uint64) for s in own])
    assert got.tolist() == [[len(a & b) for b in own] for a in own]
