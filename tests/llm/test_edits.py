import hashlib
import random

import numpy as np

from procurelake.llm import edits, queries


def mixed(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
    x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
    return x ^ x >> 31


def brute(texts):
    """One text at a time, one character at a time."""
    out = []
    for t in texts:
        x, cuts = [ord(c) for c in t], [0]

        def cut_hash(p, x=x):
            h = x[p - 1] * 0x9E3779B1 + x[p - 2] * 0x85EBCA6B + x[p - 3] * 0xC2B2AE35 + x[p - 4] * 0x27D4EB2F & 0xFFFFFFFF
            return (h ^ h >> 15) * 0x2C1B3C6D & 0xFFFFFFFF

        for p in range(4, len(x)):
            if (cut_hash(p) >> 8) % edits.PIECE == 0:
                cuts.append(p)
        cuts = [c + k for c, e in zip(cuts, [*cuts[1:], len(x)]) for k in range(0, max(1, e - c), edits.LONGEST)]
        pieces = []
        for a, e in zip(cuts, [*cuts[1:], len(x)]):
            i, bits = a, []
            for j in range(edits.STEPS if x else 0):
                h = (x[i] + j * 0x632BE5AB) * 0x85EBCA6B & 0xFFFFFFFF
                h = (h ^ h >> 13) * 0xC2B2AE35 & 0xFFFFFFFF
                if j in edits.SAMPLED:
                    bits.append(h >> 30 & 1)
                i += h >> 31
                i = a if i == e else i
            code = sum(b << k for k, b in enumerate(bits))
            pieces.append((mixed(cut_hash(a) + 1 if a else 0), code))
        row = []
        for k in range(edits.SLOTS if x else 0):
            odd = int(edits._ODD[k])

            def order(p, odd=odd, k=k):
                h = p[0] * odd % 2**64
                return (h ^ h >> 29) >> 16, mixed(p[1]) >> 56, p[1] >> 8 * (k % 8) & 255

            row.append(order(min(pieces, key=order))[2])
        out.append(row or [0] * edits.SLOTS)
    return out


def like(a, b):
    return max(0.0, 1 - sum(bin(int(x) ^ int(y)).count("1") for x, y in zip(a, b)) / (4 * edits.SLOTS))


def test_against_brute_force():
    r = random.Random(1)
    texts = ["", "a", "abc", "a" * 700, "naïve 🙂 " * 30] + ["".join(r.choice("abcde ") for _ in range(n)) for n in (5, 40, 300, 1500)]
    assert edits.fingerprints(texts).tolist() == brute(texts)


def test_likeness_follows_edits():
    r = random.Random(2)
    text = "".join(r.choice("abcdefghij ") for _ in range(4000))
    few = "".join(c if r.random() > 0.002 else "" for c in text)
    many = "".join(c if r.random() > 0.1 else "" for c in text)
    other = "".join(r.choice("abcdefghij ") for _ in range(4000))
    f = edits.fingerprints([text, text, few, many, other])
    got = [edits.likeness(f[:1], f[i : i + 1])[0] for i in range(1, 5)]
    assert got == [like(f[0], f[i]) for i in range(1, 5)]
    assert got[0] == 1 and got[1] > 0.7 > got[2] > got[3] and got[3] < 0.2


def check(rows, got):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = []
    for i, (d, t) in enumerate(order):
        t, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        e = t[: len(t) - len(t) // 4] + nxt[: len(t) // 4]
        f = edits.fingerprints([t, e, nxt])
        hexed = edits.as_text(f)
        want.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), hexed[0], hexed[1], like(f[0], f[1]), like(f[0], f[2])))
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)[:7]) for r in got)


def test_edges(spark):
    rows = [(5, "five " * 20), (None, "none"), (3, None), (3, "three"), (9, ""), (9, ""), (7, "x" * 50000), (11, "last 🙂 text of all")]
    df = spark.createDataFrame([(d, t, 1.0) for d, t in rows], "doc_id long, text string, near_next double")
    check(rows, edits.with_next(df).collect())
    one = [(1, "alone with itself")]
    check(one, edits.with_next(spark.createDataFrame(one, "doc_id long, text string")).collect())
    assert edits.with_next(df.limit(0)).count() == 0
    assert edits.fingerprint(df).count() == 8


def test_query(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    got = queries.op10_fingerprints(spark, d).collect()
    check(rows, got)
    long = [r for r in got if r.n_chars > 200 and r.near_next < 1]
    assert np.mean([r.near_edited > r.near_next + 0.2 for r in long]) > 0.97


def components(rows, least=edits.LIKE):
    """key -> (class, group), by comparing all fingerprints."""
    f = edits.fingerprints([t or "" for _, t in rows])
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in np.flatnonzero(edits.likeness(f[i], f[:i]) >= least):
            up[find(i)] = find(int(j))
    first = lambda same: min((rows[j][0] for j in range(len(rows)) if rows[j][0] is not None and same(j)), default=None)
    return [(d, first(lambda j, i=i: bytes(f[j]) == bytes(f[i])), first(lambda j, i=i: find(j) == find(i))) for i, (d, _) in enumerate(rows)]


def varied(n, seed, share):
    """n texts over one base: some near it, others that only share their beginning with it."""
    r = random.Random(seed)
    base = "".join(r.choice("abcdefghij ") for _ in range(3000))
    rows = [(0, base)]
    for d in range(1, n):
        t = list(base)
        for _ in range(r.choice([0, 1, 3, 5, 8])):
            t[r.randrange(len(t))] = r.choice(["", "xx", "y"])
        if r.random() < share:
            t[1500:] = [r.choice("klmnop ") for _ in range(1500)]
        rows.append((d, "".join(t)))
    return rows


def test_groups_are_those_of_brute_force(spark):
    rows = varied(60, 3, 0.3) + [(100, None), (101, ""), (None, "null id text, long enough"), (50, "null id text, long enough"), (7, "short"), (6, "short")]
    got = edits.groups(spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, f string")).collect()
    assert sorted(((g.key, g.class_id, g.group_id) for g in got), key=repr) == sorted(components(rows), key=repr)
    assert edits.groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_recall(spark):
    """Of links that comparing all fingerprints finds, those of the bands, in a crowd of texts that share half of theirs."""
    rows = varied(700, 4, 0.6)
    want = components(rows)
    got = {g.key: g.group_id for g in edits.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    linked = [(d, g) for d, _, g in want if d != g]
    found = sum(got[d] == g for d, g in linked)
    print(f"recall {found} of {len(linked)}")
    assert found >= 0.95 * len(linked) and all(got[d] == d for d, _, g in want if d == g)


def test_query_has_groups(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    got = queries.op10_fingerprints(spark, d).collect()
    assert sorted((r.doc_id, r.class_id, r.group_id) for r in got) == sorted(components(rows))
    assert any(r.class_id != r.doc_id for r in got)
