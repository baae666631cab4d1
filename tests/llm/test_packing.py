import itertools
import zlib

import numpy as np
import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from procurelake.llm import packing, queries
from procurelake.llm.wordbpe import WordEncoder

PATH = P.path("word_bpe_49k.json")
TRUE = Tokenizer.from_file(PATH)
OWN = WordEncoder(PATH)


def ids(t):
    return TRUE.encode(t or "", add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\tab,.'sS1éİΣß中\x1ć"), st.characters(blacklist_categories=("Cs",))), max_size=40))
def test_words(t):
    assert np.frombuffer(OWN.encode(t), "<u2").tolist() == ids(t)


def test_marks_and_added_tokens():
    for t in ["a <|endoftext|> b", "<|startoftext|>x", "end. End, e.g. 3. '. ... ., a.b, (x). ß, Ÿ.", "l'été, ñandú.\xa0İ. ɐ.", "ŉ. ª, ². _. x_."]:
        assert np.frombuffer(OWN.encode(t), "<u2").tolist() == ids(t), t


def test_small_memory(monkeypatch):
    from procurelake.llm import wordbpe

    monkeypatch.setattr(wordbpe, "REMEMBERED", 3)
    own = WordEncoder(PATH)
    for t in ["a b c d e", "a b x!! y z", "c d e a x!!", "q r s t u v w a b " * 3] * 3:
        assert np.frombuffer(own.encode(t), "<u2").tolist() == ids(t)


def test_knapsack_and_program():
    r = np.random.default_rng(0)
    for _ in range(20):
        sizes, values = r.permutation(np.arange(2, 12))[:4], r.random(4)
        best = max(float(np.dot(c, values)) for c in itertools.product(range(7), repeat=4) if np.dot(c, sizes) <= 12)
        got, counts = packing.knapsack(values, sizes, 12)
        assert abs(got - best) < 1e-9 and np.dot(counts, sizes) <= 12 and abs(np.dot(counts, values) - got) < 1e-9
    h = r.integers(0, 50, packing.CLASSES)
    rows, count = packing.patterns(h)
    assert (count @ rows >= h).all() and (rows @ np.arange(1, packing.CLASSES + 1) <= packing.CLASSES).all()
    least = (h @ np.arange(1, packing.CLASSES + 1)) / packing.CLASSES
    assert count.sum() <= least + packing.CLASSES  # rounding: less than one a pattern


def check(rows, got, padding=0.02):
    want = sorted((d is not None, d or 0, tuple([*ids(t), 2])) for d, t in rows)
    pool = {}
    for d in {r[0] for r in rows}:
        pool[d] = [x[2] for x in want if x[0] == (d is not None) and x[1] == (d or 0)]
    used = {}
    for p in got:
        assert 1 <= p.length <= 4096 and p.doc_tokens in {len(x) for x in pool[p.doc_id]}
        fits = [i for i, x in enumerate(pool[p.doc_id]) if len(x) == p.doc_tokens and zlib.crc32(np.array(x[p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32]
        assert fits
        used.setdefault((p.doc_id, p.doc_tokens), []).extend(range(p.start, p.start + p.length))
    for (d, n), at in used.items():
        times = sum(len(x) == n for x in pool[d])
        assert sorted(at) == sorted(list(range(n)) * times)
    assert sum(map(len, used.values())) == sum(len(x) for v in pool.values() for x in v)
    seqs = {}
    for p in got:
        seqs.setdefault(p.sequence_id, []).append((p.offset, p.length))
    pad = total = 0
    for ps in seqs.values():
        at = 0
        for o, n in sorted(ps):
            assert o == at
            at += n
        assert at <= 4096
        total += at
        pad += 0 if at & (at - 1) == 0 else 4096 - at
    assert pad <= padding * total, (pad, total)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "word " * 9000), (4, "same"), (4, "same"), (None, "null id"), (6, "x" * 5000)]
    check(rows, packing.pack(spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, n int"), PATH).collect())
    one = spark.createDataFrame([(1, "one two")], "doc_id long, text string")
    check([(1, "one two")], packing.pack(one, PATH).collect())
    assert packing.pack(one.limit(0), PATH).count() == 0


def test_query(spark):
    d = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    check(rows, queries.op8_packing(spark, d).collect(), 0.001)
