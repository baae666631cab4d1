"""Document fingerprints by a randomised edit embedding.

1. Embedding. A text is cut where its content says so (a hash of a few characters), at the latest after
   LONGEST characters, so that an edit moves only the cuts near it. In each piece a walk of STEPS steps
   reads the characters round and round; at step j it writes a bit of the character it stands on, and
   goes on or stays by another bit, both drawn from (j, character) and so shared by all texts. Pieces
   that differ by few edits get strings that differ in few bits: Hamming distance stands for edit
   distance. Every other bit is sampled: a piece's code.
2. Fingerprint. A text has SLOTS slots. Each takes one piece, the one whose cut has the least hash of
   the slot's own, and eight bits of its code. Texts that are alike take the same pieces, or pieces
   that few edits changed; the Hamming distance H of the SLOTS * 8 bits gives the likeness
   max(0, 1 - 2 H / (8 SLOTS)): 1 for equal ones, about 0 for texts that have nothing to do with each other.
3. Groups. Fingerprints that agree in all bits of a band (BAND sampled slots) are candidates; each is
   verified, by the distance of all bits, against the least of its band. Where a member isn't like it,
   all members of that band are compared, in chunks of about CHUNK by CHUNK. Verified pairs make
   components.

Null texts are empty. Equal texts have equal fingerprints, empty ones too; an empty text is like
another empty text only. Repeated rows each get a result. Ids are integers. In `with_next` documents
are ordered by id (null first), then text; the last is followed by the first; a single document by
itself. Further columns don't matter: `fingerprint` keeps them and replaces one of its own name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from procurelake.llm import near
from procurelake.llm.spark import prepared, stored
from procurelake.llm.text import mix

#: Slots of a fingerprint (a byte each); steps of a walk; mean and longest piece.
SLOTS, STEPS, PIECE, LONGEST = 64, 128, 32, 64
#: Bands, slots of a band, the likeness from which fingerprints are linked, and how many of a band are compared at once.
BANDS, BAND, LIKE, CHUNK = 8, 4, 0.8, 512
#: Characters that one numpy pass holds.
PASS = 1 << 20
_U, _V = np.uint64, np.uint32
_ODD = mix(np.arange(1, SLOTS + 1, dtype=np.uint64)) | _U(1)
#: The steps whose bits are sampled, 64 of STEPS, and the slots of each band.
SAMPLED = np.sort(np.argsort(mix(np.arange(STEPS, dtype=np.uint64)))[:64]).tolist()
SAMPLES = np.array([np.argsort(mix(np.arange(SLOTS, dtype=np.uint64) + _U(SLOTS * (b + 1))))[:BAND] for b in range(BANDS)])


def _pieces(x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first characters of all pieces, hash of each one's cut): texts begin at `starts`."""
    h = x * _V(0x9E3779B1)
    for k, m in ((1, 0x85EBCA6B), (2, 0xC2B2AE35), (3, 0x27D4EB2F)):
        h[k:] += x[:-k] * _V(m)
    h = (h ^ (h >> _V(15))) * _V(0x2C1B3C6D)
    at = np.zeros(len(x) + 1, bool)
    at[1:] = (h >> _V(8)) % _V(PIECE) == 0
    few = (starts[:, None] + np.arange(1, 4)).ravel()  # too few characters of the text before them
    at[few[few < len(at)]] = False
    at[starts] = True
    cuts = np.flatnonzero(at[: len(x)])
    extra = (np.diff(np.append(cuts, len(x))) - 1) // LONGEST
    begin = np.repeat(cuts, extra + 1) + LONGEST * _within(extra + 1)
    cut = np.where(begin > 0, h[begin - 1].astype(np.uint64) + _U(1), _U(0))
    cut[np.searchsorted(begin, starts)] = 0
    return begin, mix(cut)


def _within(counts: np.ndarray) -> np.ndarray:
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def _codes(x: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The sampled bits of all pieces' walks."""
    size = np.diff(np.append(begin, len(x)))
    i = np.zeros(len(begin), np.int64)
    out, k = [np.zeros(len(begin), _V), np.zeros(len(begin), _V)], 0
    for j in range(STEPS):
        h = (x[begin + i] + _V((j * 0x632BE5AB) & 0xFFFFFFFF)) * _V(0x85EBCA6B)
        h ^= h >> _V(13)
        h *= _V(0xC2B2AE35)
        if j in SAMPLED:
            out[k >> 5] |= ((h >> _V(30)) & _V(1)) << _V(k & 31)
            k += 1
        i += h >> _V(31)
        i[i == size] = 0
    return out[0].astype(np.uint64) | out[1].astype(np.uint64) << _U(32)


def fingerprints(texts: list[str]) -> np.ndarray:
    """Slots (a byte each) of all texts, a row a text."""
    out = np.zeros((len(texts), SLOTS), np.uint8)
    at = 0
    while at < len(texts):
        to, n = at, 0
        while to < len(texts) and (to == at or n + len(texts[to]) <= PASS):
            n += len(texts[to])
            to += 1
        x = np.frombuffer("".join(texts[at:to]).encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.array([len(t) for t in texts[at:to]])
        some = np.flatnonzero(size)
        if len(some):
            starts = (np.cumsum(size) - size)[some]
            begin, cut = _pieces(x, starts)
            code = _codes(x, begin)
            edge = np.searchsorted(begin, starts)
            tie = (mix(code) >> _U(56)) << _U(8)
            for k in range(SLOTS):
                low = tie | (code >> _U(8 * (k % 8))) & _U(0xFF)
                out[at + some, k] = np.minimum.reduceat(spread(cut, k) & ~_U(0xFFFF) | low, edge).astype(np.uint8)
        at = to
    return out


def spread(h: np.ndarray, k: int) -> np.ndarray:
    """A slot's own order of cuts."""
    h = h * _ODD[k]
    return h ^ (h >> _U(29))


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 - 2 H / bits of rows of slots, 0 at least."""
    return np.maximum(0, 1 - np.bitwise_count(a ^ b).sum(-1, dtype=np.int64) / (4 * SLOTS))


def as_text(rows: np.ndarray) -> list[str]:
    return [r.tobytes().hex() for r in rows]


def fingerprint(df: DataFrame, column: str = "text", name: str = "fingerprint") -> DataFrame:
    """df with the fingerprint (hex) of each text."""
    prepared(df.sparkSession)
    schema = T.StructType([f for f in df.schema.fields if f.name != name] + [T.StructField(name, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(b.schema.get_field_index(column)).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(f.name)) for f in schema.fields[:-1]] + [pa.array(as_text(fingerprints(texts)), pa.string())], names=[f.name for f in schema.fields])

    return df.mapInArrow(run, schema)


def _slots(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, SLOTS)


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(band, node) for each band of (node, f): the band's sampled bits and its number, hashed."""
    for b in batches:
        f, node = _slots(b.column(1)), np.asarray(b.column(0))
        for i, slots in enumerate(SAMPLES):
            bits = np.ascontiguousarray(f[:, slots]).view(np.uint32).ravel().astype(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(mix(bits << _U(8) | _U(i)).view(np.int64)), pa.array(node)], names=["band", "node"])


def _verified(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    for b in batches:
        like = likeness(_slots(b.column(2)), _slots(b.column(3))) if b.num_rows else np.zeros(0)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(like >= least)], names=["a", "b", "alike"])


def _compared(t: pa.Table, least: float) -> pa.Table:
    """Links of the members of a group that join all its members that are linked by others."""
    node, f = np.asarray(t["node"]), _slots(t["f"].combine_chunks() if isinstance(t["f"], pa.ChunkedArray) else t["f"])
    seen, a, b = np.zeros(len(node), bool), [], []
    for i in range(len(node)):
        if seen[i]:
            continue
        seen[i], todo = True, [i]
        while todo:
            j = todo.pop()
            new = np.flatnonzero(~seen & (likeness(f[j], f) >= least))
            seen[new] = True
            a += [node[j]] * len(new)
            b += node[new].tolist()
            todo += new.tolist()
    a, b = np.array(a, np.int64), np.array(b, np.int64)
    return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def links(classes: DataFrame, least: float = LIKE) -> DataFrame:
    """(a, b): verified pairs of classes (node, f), enough of them to join all that share a band and are linked."""
    bands = classes.select("node", "f").mapInArrow(_banded, "band long, node long")
    # partial sums find the hub of a band before the shuffle, so that a hot band is no task's alone
    hubs = bands.groupBy("band").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1")
    met = stored(bands.join(hubs, "band").where("node != hub"))
    own = lambda c: classes.select(F.col("node").alias(c), F.col("f").alias(f"f{c}"))
    pairs = met.select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct().join(own("a"), "a").join(own("b"), "b").select("a", "b", "fa", "fb")
    known = stored(pairs.mapInArrow(lambda it: _verified(it, least), "a long, b long, alike boolean"))
    apart = known.where("NOT alike").select(F.col("a").alias("hub"), F.col("b").alias("node"))
    hard = met.join(apart, ["hub", "node"]).where("n > 2").select("band").distinct()
    members = met.select("band", "n", F.explode(F.array("node", "hub")).alias("node")).join(hard, "band").distinct()
    parts = F.ceil(F.col("n") / CHUNK).cast("int")
    dealt = members.withColumns({"parts": parts, "own": F.pmod(F.xxhash64("node"), parts).cast("int")}).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("band", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "node").join(classes.select("node", "f"), "node")
    rest = dealt.groupBy("band", "p", "q").applyInArrow(lambda t: _compared(t, least), "a long, b long")
    return known.where("alike").select("a", "b").unionByName(rest).distinct()


def groups(df: DataFrame, key: str = "doc_id", column: str = "text", least: float = LIKE) -> DataFrame:
    """(key, f, class_id, group_id) for each row: its fingerprint, the least key with that fingerprint, and the least key in its component."""
    prepared(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in fingerprints([t or "" for t in b.column(1).to_pylist()])], pa.binary())], names=["key", "f"])

    prints = stored(df.select(F.col(key).alias("key"), F.col(column).alias("text")).mapInArrow(run, f"key {kind}, f binary"))
    classes = stored(prints.groupBy("f").agg(F.min("key").alias("class_id")).withColumn("node", F.xxhash64("f")))
    label = near.components(links(classes, least))
    named = classes.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    first = named.groupBy("label").agg(F.min("class_id").alias("group_id"))
    return prints.join(named.join(first, "label").select("f", "class_id", "group_id"), "f").select("key", "f", "class_id", "group_id")


def _bucket(ends: list[int], marks: dict[int, int] | None = None):
    """A Pandas UDF from a key to the ranges that get its row: its own and, if it is the least there, also the one before, as 2 b + 1."""
    edge = np.array(ends, np.int64)
    before = {k: b for b, k in zip(sorted(marks), [marks[b] for b in sorted(marks)][1:] + [marks[min(marks)]])} if marks else {}

    def places(keys: pd.Series) -> pd.Series:
        k = keys.to_numpy(np.int64)
        own = np.searchsorted(edge, k, "left")
        return pd.Series([[2 * b] if (p := before.get(x)) is None else [2 * b, 2 * p + 1] for x, b in zip(k.tolist(), own.tolist())])

    return F.pandas_udf(places, "array<int>")


def _ranges(df: DataFrame, key: str, buckets: int) -> tuple[list[int], dict[int, int]]:
    """(upper ends of ranges of keys, the least key in each range that has any); both no longer than `buckets`."""
    ends = sorted(set(df.stat.approxQuantile(key, [i / buckets for i in range(1, buckets)], 0.002))) if buckets > 1 else []
    ends = [int(x) for x in ends]
    least = {r.b // 2: r.k for r in df.groupBy(F.get(_bucket(ends)(F.col(key)), F.lit(0)).alias("b")).agg(F.min(key).alias("k")).collect()}
    return ends, least


def with_next(df: DataFrame, key: str = "doc_id", column: str = "text", grouped: DataFrame | None = None) -> DataFrame:
    """The fingerprints of each text and of its edit, whose last quarter is the beginning of the next text.

    One shuffle by ranges of keys; the first document of a range is sent to the range before it too. `grouped`
    (of `groups`): class_id and group_id of each row come with them."""
    spark = prepared(df.sparkSession)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    place = lambda c: F.coalesce(c.cast("long"), F.lit(-(1 << 63)).cast("long"))
    rows = df.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(column), F.lit("")).alias("text"), place(F.col(key)).alias("k"))
    ends, least = _ranges(rows.select("k"), "k", 4 * parts)
    dealt = rows.withColumn("p", F.explode(_bucket(ends, least)(F.col("k"))))
    dealt = dealt.select("id", "text", "k", F.shiftright("p", 1).alias("b"), F.col("p").bitwiseAND(F.lit(1)).alias("look"), *[F.lit(None).cast(t).alias(c) for c, t in (("f", "binary"), ("class_id", "long"), ("group_id", "long"))])
    if grouped is not None:
        # rows that are a group of their own need no telling
        told = grouped.where(~F.col("class_id").eqNullSafe(F.col("key")) | ~F.col("group_id").eqNullSafe(F.col("key"))).select("key", "f", "class_id", "group_id")
        told = told.select(F.col("key").cast("long").alias("id"), F.lit("").alias("text"), place(F.col("key")).alias("k"), "f", F.col("class_id").cast("long"), F.col("group_id").cast("long"))
        told = told.withColumns({"b": F.shiftright(F.get(_bucket(ends)(F.col("k")), F.lit(0)), 1), "look": F.lit(-1)})
        dealt = dealt.unionByName(told)
    dealt = dealt.repartition(parts, "b").sortWithinPartitions("b", "look", "k", "text").select("id", "text", "b", "look", "f", "class_id", "group_id")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, class_id long, group_id long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        known: dict[int, dict[tuple, tuple]] = {}  # by range: groups of its rows, which come before them
        prints = np.zeros((0, SLOTS), np.uint8)
        for batch in batches:
            new = []
            for r in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if r[3] >= 0:
                    new.append(r[:4])
                else:
                    known.setdefault(r[2], {})[r[0], r[4]] = r[5:]
            if not new:
                continue
            prints = np.concatenate([prints, fingerprints([r[1] for r in new])])
            held += new
            own = [i for i in range(len(held) - 1) if not held[i][3] and held[i + 1][2] == held[i][2]]
            if own:
                edited = []
                for i in own:
                    n = len(held[i][1]) // 4
                    edited.append(held[i][1][: len(held[i][1]) - n] + held[i + 1][1][:n])
                changed = fingerprints(edited)
                a, b = prints[own], prints[[i + 1 for i in own]]
                group = [known.get(held[i][2], {}).get((held[i][0], p.tobytes()), (held[i][0], held[i][0])) for i, p in zip(own, a)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([held[i][0] for i in own], pa.int64()), pa.array([len(held[i][1]) for i in own], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]), pa.array(as_text(a)), pa.array(as_text(changed)), pa.array(likeness(a, changed)), pa.array(likeness(a, b)), pa.array([g[0] for g in group], pa.int64()), pa.array([g[1] for g in group], pa.int64())],
                    names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "class_id", "group_id"],
                )
            held, prints = held[-1:], prints[-1:]
            known = {b: g for b, g in known.items() if b >= held[0][2]}

    return dealt.mapInArrow(run, schema)
