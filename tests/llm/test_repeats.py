import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from procurelake.llm import queries, repeats
from tests.oracle import same


def brute(rows, length=50):
    least = {}
    for d, t in rows:
        b = (t or "").encode()
        if d is not None:
            for i in range(len(b) - length + 1):
                w = b[i : i + length]
                least[w] = min(d, least.get(w, d))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        if d is not None:
            for i in range(len(b) - length + 1):
                if least[b[i : i + length]] < d:
                    gone[i : i + length] = True
        spans = int((gone[1:] < gone[:-1]).sum())
        rest = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=repr)


def got(spark, rows, many=repeats.MANY):
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, home int")
    out = repeats.removed(df, many=many).collect()
    return sorted(((r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in out), key=repr)


def planted():
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randrange(1, 7)))
    passages = [" ".join(word() for _ in range(r.choice([9, 13, 20, 60]))) for _ in range(8)]
    rows = []
    for _ in range(60):
        parts = [" ".join(word() for _ in range(r.randrange(0, 40)))]
        for _ in range(r.randrange(0, 4)):
            p = r.choice(passages)
            a = r.randrange(0, max(1, len(p) - 45))
            parts += [p[a : a + r.randrange(40, 200)], word()]
        rows.append((r.randrange(0, 50), "".join(parts)))
    rows += [r.choice(rows) for _ in range(10)]
    return rows + [(None, rows[0][1]), (70, rows[0][1]), (71, None), (72, ""), (73, "a" * 49), (74, "a" * 50), (75, "a" * 51), (76, "ab" * 300), (77, "ab" * 26), (78, "x" * 70 + "a" * 60)]


@pytest.mark.parametrize("many", [2, 48])
def test_against_brute_force(spark, many):
    rows = planted()
    assert got(spark, rows, many) == brute(rows)
    assert got(spark, rows[:1], many) == brute(rows[:1])


def test_no_rows(spark):
    assert repeats.removed(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_common_passage(spark):
    r = random.Random(3)
    noise = lambda n: "".join(r.choice("abcdefghij ") for _ in range(n))
    passage = noise(64)
    rows = [(d, noise(80) + passage + noise(80)) for d in range(300)]
    assert got(spark, rows) == brute(rows)


def test_query(spark):
    d = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    out = queries.op2_suffix_dedup(spark, d).collect()
    assert sorted((tuple(r) for r in out), key=repr) == brute(rows)


def test_query_is_its_sql(spark):
    assert same(spark, queries.op2_suffix_dedup, queries.oracle_sql()["op2_suffix_dedup"], "/root/testdata/sf0.001") == 200


@pytest.mark.parametrize("many", [2, 48])
def test_twice_in_the_same_surroundings(spark, many):
    r = random.Random(9)
    noise = lambda n: "".join(r.choice("abcdefghij ") for _ in range(n))
    rows = []
    for d in range(0, 400, 20):
        passage, before, after = noise(60), noise(90), noise(90)
        rows += [(d + 2, noise(90) + passage + noise(90)), (d + 3, noise(90) + passage[:55] + noise(90))]
        rows += [(d + 5, (before + passage + after) * 3), (d + 7, before + passage + after)]
    assert got(spark, rows, many) == brute(rows)


@pytest.mark.parametrize("many", [2, 48])
def test_part_of_a_passage_that_a_later_document_has_twice(spark, many):
    for seed in range(4):
        r = random.Random(seed)
        noise = lambda n: "".join(r.choice("abcdefghij ") for _ in range(n))
        rows = []
        for d in range(0, 60, 10):
            q = noise(200)
            a = r.randrange(0, 80)
            rows += [(d + 1, noise(200) + q[a : a + r.randrange(70, 120)] + noise(200)), (d + 5, noise(200) + q + noise(150) + q + noise(200))]
        assert got(spark, rows, many) == brute(rows)


def test_pieces_do_not_grow_with_blocks_times_partitions():
    """Many blocks of text and many partitions: a piece for each bucket, a batch for each kind of ranges."""
    r = random.Random(5)
    texts = ["".join(r.choice("abcdefghij ") for _ in range(repeats.BLOCK // 2)) for _ in range(6)]
    names = list(range(300))
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(12), pa.int64()), "text": texts * 2, "th": pa.array(range(12), pa.int32()), "n": pa.array(range(0, 300, 25), pa.int32())})
    dealt = list(repeats._anchors(iter([batch]), names))
    assert sum(b.num_rows for b in dealt) <= len(names)
    want = []
    for i, t in enumerate(texts * 2):
        c = repeats.contexts(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))
        want += zip([i] * len(c["at"]), c["at"].tolist(), c["windows"].tolist(), c["anchor"].tolist(), c["whole"].tolist(), strict=True)
    docs, a = repeats._records(iter(dealt))
    ids = docs["id"][a["doc"].astype(np.int64)]
    assert sorted(zip(ids.tolist(), a["start"].tolist(), a["windows"].tolist(), a["anchor"].tolist(), a["whole"].tolist(), strict=True)) == sorted(want)
    met = list(repeats._meet(iter(dealt), names))
    assert len(met) <= 2
    gone = repeats.RANGES.load([x for b in met for k, x in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True) if k == 0])
    assert sorted(zip(gone["id"].tolist(), gone["start"].tolist(), strict=True)) == sorted((x[0], x[1]) for x in want if x[0] >= 6)


def test_hot_anchor_is_divided():
    """Contexts of one anchor that all share windows with others: no string of the suffix arrays holds more than MANY of them."""
    r = random.Random(2)
    noise = lambda n: bytes(r.choice(b"abcdefgh") for _ in range(n))
    lefts, rights, anchor = [noise(25) for _ in range(12)], [noise(25) for _ in range(12)], b"ANCHORANCHOR"
    ctx, ids, place = [], [], []
    for _ in range(600):
        a, b = noise(r.randrange(0, 14)) + r.choice(lefts)[r.randrange(0, 8) :], r.choice(rights)[: r.randrange(17, 26)] + noise(r.randrange(0, 14))
        a, b = a[-38:], b[:38]
        if len(a) + len(b) >= 38:
            ctx.append(a + anchor + b)
            ids.append(r.randrange(0, 400))
            place.append(len(a))
    n = len(ctx)
    least = {}
    for c, d in zip(ctx, ids, strict=True):
        for i in range(len(c) - 49):
            least[c[i : i + 50]] = min(d, least.get(c[i : i + 50], d))
    want = {(k, i) for k in range(n) for i in range(len(ctx[k]) - 49) if least[ctx[k][i : i + 50]] < ids[k]}
    t = pa.table({"bucket": pa.array([0] * n, pa.int32()), "anchor": pa.array([7] * n), "doc_id": pa.array(ids), "th": pa.array(range(n), pa.int32()), "home": pa.array([0] * n, pa.int32()), "start": pa.array([0] * n, pa.int32()), "place": pa.array(place, pa.int32()), "bytes": ctx[:]})
    blobs = [x for b in repeats._resolve(iter(t.to_batches()), [0], 16) for x in b.column(2).to_pylist()]
    found = repeats.RANGES.load(blobs)
    got_ = {(k, i) for k, a, m in zip(found["th"].tolist(), found["start"].tolist(), found["bytes"].tolist(), strict=True) for i in range(a, a + m - 49)}
    assert len(want) > 1000
    assert got_ == want
    groups, _, _ = repeats.divided(list(range(n)), ctx, ids, place, 16)
    assert groups
    assert max(len(g) for g in groups) <= 16
