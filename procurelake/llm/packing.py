"""Packing by column generation: documents cut to sequences of SEQUENCE tokens with little padding.

1. Every text is encoded once; ids go to a table in the shared folder.
2. A document's full sequences stand alone; what remains of it is an item, its length rounded up to
   a class of UNIT tokens. A histogram of classes goes to the driver: SEQUENCE / UNIT numbers.
3. Linear program: how often to use each pattern (a multiset of classes that fits a sequence) so
   that all items are covered. Columns are generated: the duals price classes, a knapsack by dynamic
   programming finds the pattern worth most, until none is worth more than a sequence.
4. Counts are rounded down and the rest packed by decreasing size; patterns are then assigned to
   documents by their rank in their class, with prefix sums, not by a driver's list.
5. What a sequence has left is filled by cutting some documents freely (those with the smallest hash
   of the id, as many as needed). What these have left fills sequences of their own, the last ones
   of a power of two each, which need no padding.

Null and empty texts have the end id only. Repeated rows are packed each. An empty table gives no
piece. Further columns are not read. Nothing is dropped: each id is in exactly one piece.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from procurelake.llm.spark import prepared, running, stored
from procurelake.llm.wordbpe import WordEncoder

SEQUENCE, UNIT, END = 4096, 32, 2
CLASSES = SEQUENCE // UNIT
#: Groups that documents are dealt to for ranks and sums, and groups that fillers are taken from.
GROUPS, HASHES = 64, 1024
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def encoded(df: DataFrame, path: str, key: str = "doc_id", column: str = "text", end: int = END) -> DataFrame:
    """(doc_id, rid, s, h, n, ids, crcs): ids with the end id, their number, and crc32 of each cut of SEQUENCE ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _encoder(path)
        for b in batches:
            ids = [np.append(np.frombuffer(own.encode(t or ""), "<u2"), np.uint16(end)) for t in b.column(1).to_pylist()]
            crcs = [[_crc(x[a : a + SEQUENCE]) for a in range(0, len(x), SEQUENCE)] for x in ids]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.astype("<u2").tobytes() for x in ids], pa.binary()), pa.array(crcs, pa.list_(pa.int64()))], names=["doc_id", "n", "ids", "crcs"])

    rows = df.select(F.col(key).alias("doc_id"), F.col(column).alias("text")).mapInArrow(run, "doc_id long, n long, ids binary, crcs array<long>")
    rid = F.monotonically_increasing_id()
    rows = rows.withColumn("rid", rid)
    hashed = F.xxhash64("doc_id", "rid")
    return rows.select("doc_id", "rid", F.pmod(hashed, F.lit(GROUPS)).cast("int").alias("s"), F.pmod(F.shiftright(hashed, 20), F.lit(HASHES)).cast("int").alias("h"), "n", "ids", "crcs")


_encoders: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def knapsack(values: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The multiset of sizes worth most that fits the room: (its worth, how many of each)."""
    worth, last = np.zeros(room + 1), np.full(room + 1, -1)
    for c in range(1, room + 1):
        worth[c] = worth[c - 1]
        ok = np.flatnonzero(sizes <= c)
        if len(ok):
            v = worth[c - sizes[ok]] + values[ok]
            k = int(v.argmax())
            if v[k] > worth[c] + 1e-12:
                worth[c], last[c] = v[k], ok[k]
    counts, c = np.zeros(len(sizes), np.int64), room
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            counts[last[c]] += 1
            c -= sizes[last[c]]
    return float(worth[room]), counts


def linear_program(demand: np.ndarray, sizes: np.ndarray, room: int, steps: int = 4000) -> tuple[np.ndarray, np.ndarray]:
    """(patterns as rows, how often each is used) of the least sum that covers the demand, by column generation."""
    m = len(sizes)
    basis = np.diag((room // sizes).astype(float))
    use = demand / np.diag(basis)
    for _ in range(steps):
        prices = np.linalg.solve(basis.T, np.ones(m))
        best, pattern = knapsack(np.maximum(prices, 0), sizes, room)
        if best <= 1 + 1e-7:
            break
        column = np.linalg.solve(basis, pattern.astype(float))
        ratio = np.where(column > 1e-9, use / np.where(column > 1e-9, column, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        use = np.maximum(use - ratio[out] * column, 0)
        use[out] = ratio[out]
        basis[:, out] = pattern
    return basis.T.round().astype(np.int64), use


def patterns(histogram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(patterns over CLASSES classes as rows, whole numbers of sequences) that cover a histogram of classes 1..CLASSES."""
    some = np.flatnonzero(histogram)
    if not len(some):
        return np.zeros((0, CLASSES), np.int64), np.zeros(0, np.int64)
    sizes = some + 1
    rows, use = linear_program(histogram[some].astype(float), sizes, CLASSES)
    count = np.floor(use + 1e-9).astype(np.int64)
    rest = np.maximum(histogram[some] - count @ rows, 0)
    extra = []
    while rest.any():  # at most a sequence or so for each pattern that was rounded
        room, own = CLASSES, np.zeros(len(some), np.int64)
        for i in range(len(some) - 1, -1, -1):
            own[i] = min(rest[i], room // sizes[i])
            room -= own[i] * sizes[i]
        times = int(min(rest[own > 0] // own[own > 0]))
        rest = rest - own * times
        extra.append((own, times))
    out = np.zeros((len(count) + len(extra), CLASSES), np.int64)
    out[:, some] = np.concatenate([rows, *[o[None] for o, _ in extra]])
    count = np.append(count, np.array([t for _, t in extra], np.int64))
    return out[count > 0], count[count > 0]


def _plan(docs: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """(hash below which documents are fillers, patterns, their counts). The driver gets HASHES x (CLASSES + 1) sums at most."""
    u = F.ceil(F.pmod("n", F.lit(SEQUENCE)) / UNIT).cast("int")
    got = docs.groupBy("h", u.alias("u")).agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.pmod("n", F.lit(SEQUENCE))).alias("r")).collect()
    k, n, r = np.zeros((HASHES, CLASSES + 1), np.int64), np.zeros(HASHES, np.int64), np.zeros(HASHES, np.int64)
    for x in got:
        k[x.h, x.u] += x.k
        n[x.h] += x.n
        r[x.h] += x.r
    below = np.concatenate([[0], np.cumsum(n)])
    rest = r.sum() - np.concatenate([[0], np.cumsum(r)])
    t, share = 0, None
    while True:
        rows, count = patterns(k[t:, 1:].sum(0))
        slack = SEQUENCE * int(count.sum()) - int(rest[t])
        if below[t] >= slack:
            return t, rows, count
        share = slack / max(1, int(rest[t]))
        t = max(t + 1, int(np.argmax(below >= np.minimum(share * rest, below[-1]))))


def _overlaps(a: DataFrame, b: DataFrame) -> DataFrame:
    """Overlaps [lo, hi) of intervals [a0, a1) of a with [b0, b1) of b, both disjoint, by an equi-join on cells of SEQUENCE."""
    cells = lambda x, y: F.explode(F.sequence(F.floor(F.col(x) / SEQUENCE), F.floor((F.col(y) - 1) / SEQUENCE)))
    both = a.where("a1 > a0").withColumn("cell", cells("a0", "a1")).join(b.where("b1 > b0").withColumn("cell", cells("b0", "b1")), "cell")
    both = both.withColumns({"lo": F.greatest("a0", "b0"), "hi": F.least("a1", "b1")})
    return both.where("lo < hi").where(F.floor(F.col("lo") / SEQUENCE) == F.col("cell")).drop("cell")


def pack(df: DataFrame, path: str, key: str = "doc_id", column: str = "text") -> DataFrame:
    """The pieces of all documents: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)."""
    spark = prepared(df.sparkSession)
    table = stored(encoded(df, path, key, column))
    docs = table.select("doc_id", "rid", "s", "h", "n", "crcs")
    t, rows, count = _plan(docs)
    first = np.concatenate([[0], np.cumsum(count)])  # first sequence of each pattern
    made = int(first[-1])
    fixed = docs.where(F.col("h") >= t).withColumn("u", F.ceil(F.pmod("n", F.lit(SEQUENCE)) / UNIT).cast("int"))

    # rank of each item in its class, and from it the pattern, the sequence and the place in it
    items = fixed.where("u > 0").select("rid", "s", "u", F.pmod("n", F.lit(SEQUENCE)).alias("r"))
    before = items.groupBy("u", "s").count().select("u", "s", F.coalesce(F.sum("count").over(W.partitionBy("u").orderBy("s").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    items = items.withColumn("rank", F.row_number().over(W.partitionBy("u", "s").orderBy("rid")) - 1).join(before, ["u", "s"]).withColumn("rank", F.col("rank") + F.col("before"))
    slots = []
    for u in range(1, CLASSES + 1):
        to = 0
        for p in np.flatnonzero(rows[:, u - 1]) if len(rows) else []:
            each = int(rows[p, u - 1])
            slots.append((u, to, to + each * int(count[p]), each, int(first[p])))
            to += each * int(count[p])
    slots = spark.createDataFrame(slots, "u2 int, lo long, hi long, each long, first long")  # patterns x classes: bounded
    items = items.join(F.broadcast(slots), (F.col("u") == F.col("u2")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    items = items.select("rid", "u", "r", (F.col("first") + F.floor((F.col("rank") - F.col("lo")) / F.col("each"))).alias("q"), "rank")
    in_order = W.partitionBy("q").orderBy("u", "rank").rowsBetween(W.unboundedPreceding, -1)
    items = items.withColumn("offset", F.coalesce(F.sum("r").over(in_order), F.lit(0)))
    placed = items.join(fixed.select("rid", "doc_id", "n", "crcs"), "rid").select(
        "doc_id", (F.col("n") - F.col("r")).alias("start"), F.col("r").alias("length"), F.element_at("crcs", -1).alias("ids_crc32"), F.col("n").alias("doc_tokens"), F.col("q").alias("sequence_id"), "offset"
    )

    # room left in sequences, as one line; the fillers' ids, as one line; a line of further sequences after the room
    free = items.groupBy("q").agg((F.lit(SEQUENCE) - F.sum("r")).alias("free"), F.sum("r").alias("offset")).withColumn("s", F.floor(F.col("q") / SEQUENCE))
    free = running(free, "free", "a0", "s", "q").select("a0", (F.col("a0") + F.col("free")).alias("a1"), "q", "offset")
    fill = running(table.where(F.col("h") < t).select("rid", "s", "n"), "n", "b0").select("rid", "b0", (F.col("b0") + F.col("n")).alias("b1"))
    room = SEQUENCE * made - (items.agg(F.sum("r")).first()[0] or 0)
    left = (fill.agg(F.max("b1")).first()[0] or 0) - room if t else 0
    whole, tail = divmod(max(0, left), SEQUENCE)
    more = spark.range(whole).select((F.lit(room) + F.col("id") * SEQUENCE).alias("a0"), (F.lit(room) + (F.col("id") + 1) * SEQUENCE).alias("a1"), (F.lit(made) + F.col("id")).alias("q"), F.lit(0).cast("long").alias("offset"))
    bits, at = [], room + whole * SEQUENCE
    for i, b in enumerate(x for x in range(11, -1, -1) if tail >> x & 1):
        bits.append((at, at + (1 << b), made + whole + i, 0))
        at += 1 << b
    lines = free.unionByName(more).unionByName(spark.createDataFrame(bits, "a0 long, a1 long, q long, offset long"))
    met = _overlaps(lines, fill).select("rid", F.struct((F.col("lo") - F.col("b0")).alias("start"), (F.col("hi") - F.col("lo")).alias("length"), F.col("q").alias("sequence_id"), (F.col("offset") + F.col("lo") - F.col("a0")).alias("offset")).alias("p"))
    cut = met.groupBy("rid").agg(F.collect_list("p").alias("pieces"))

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, n, ids, pieces in zip(*[c.to_pylist() for c in b.columns], strict=True):
                ids = np.frombuffer(ids, "<u2")
                out += [(doc, p["start"], p["length"], _crc(ids[p["start"] : p["start"] + p["length"]]), n, p["sequence_id"], p["offset"]) for p in pieces]
            names = [x.split()[0] for x in PIECE.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(len(names))], names=names)

    filled = table.where(F.col("h") < t).select("doc_id", "n", "ids", "rid").join(cut, "rid").select("doc_id", "n", "ids", "pieces").mapInArrow(slices, PIECE)

    # full sequences of the other documents
    full = running(fixed.select("doc_id", "rid", "s", "n", "crcs", F.floor(F.col("n") / SEQUENCE).alias("f")).where("f > 0"), "f", "before")
    full = full.select("doc_id", "n", "before", F.posexplode(F.expr("slice(crcs, 1, int(f))")).alias("i", "crc")).select(
        "doc_id", (F.col("i") * F.lit(SEQUENCE).cast("long")).alias("start"), F.lit(SEQUENCE).cast("long").alias("length"), F.col("crc").alias("ids_crc32"), F.col("n").alias("doc_tokens"), (F.lit(made + whole + len(bits)) + F.col("before") + F.col("i")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    return placed.unionByName(filled).unionByName(full)
