import base64
import hashlib

import numpy as np
import public_tokenizers as P
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from procurelake.llm import bpe, queries

PATH = P.path("byte_bpe_multi_50k.tiktoken")
CODEC = bpe.Codec.from_file(PATH, P.PATTERN)
TRUE = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}, special_tokens={})
HARD = ["", " ", "  ", "a  b", "a   b\n  c", "x\n y \n", "a" * 3000, "\t a\t\tb ", "naïve Straße 中文 🙂🙂  ", "it's I'LL we'd", "1234 5 67", "\x1c x\x85y", " nbsp", "é"]


def ids(text):
    return np.frombuffer(CODEC.encode(text), "<i4")


def test_hard_texts():
    for t in HARD:
        assert ids(t).tolist() == TRUE.encode_ordinary(t), t
        assert CODEC.decode(ids(t)) == t.encode()
    assert not len(ids(None))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\tab,.'s1é中"), st.characters(blacklist_categories=("Cs",))), max_size=60))
def test_any_text(t):
    assert ids(t).tolist() == TRUE.encode_ordinary(t)


def test_perfect_hash():
    keys = [b"%d" % i for i in range(5000)]
    assert bpe.PerfectHash(keys).index(keys).tolist() == list(range(5000))


def test_table(spark):
    df = spark.createDataFrame([(1, t, 7) for t in [*HARD, None, None]], "doc_id long, text string, ids int")
    got = bpe.decode(bpe.encode(df, PATH, P.PATTERN), PATH, P.PATTERN).collect()
    assert sorted(bytes(r.decoded) for r in got) == sorted((t or "").encode() for t in [*HARD, None, None])
    assert bpe.encode(df.limit(0), PATH, P.PATTERN).count() == 0


def test_query(spark):
    got = queries.op4_byte_bpe(spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(got) == len(texts)
    for r in got:
        want = TRUE.encode_ordinary(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(want), hashlib.sha256(",".join(map(str, want)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
