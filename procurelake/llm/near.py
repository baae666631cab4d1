"""Near-duplicates by an LSH forest over MinHash signatures.

1. Every text becomes its set of distinct hashed shingles (WIDTH lower-cased words; a shorter text is
   one sequence), a signature of COMPONENTS minima, and a hash of the set. Texts with one set are one
   class; only classes go on.
2. Forest: each of TREES orders sorts all classes by its own DEPTH components (a range-partitioned
   sort, so that no group of classes lands in one task). Candidates are neighbours with a common
   prefix of LEAST components. The depth adapts to the region: where at most REGION classes share a
   prefix of 3, 4, 5 or 6, all of them are neighbours; beyond, the next FEW in the order are, with
   ties in an order of the tree's own. Candidates whose one-bit signatures differ too much for the
   threshold are left out.
3. Links are confirmed on the full sets. First each class with its likest candidate of smaller
   hash, then the likest pairs of two components among each tree's such candidates. The forest is
   then planted again with the components that this makes, and only pairs of two components are sent:
   of each two the likest pair is confirmed first, then every other one if it doesn't join them.
4. Components: labels spread over links with pointer jumping. Each round is written as a table, so
   that small labels are joined by their known size without a shuffle.
5. Crowds: classes chained by regions of over REGION. Where a crowd has several components, those of
   its classes that share enough shingles with others of the crowd are dealt out in chunks of about
   CHUNK, and each pair of chunks that has two components is compared whole, on full sets.

A text without words has an empty set and no links. Null texts are empty; null ids come last in the
choice of a component's id (a component of null ids has a null id). Repeated rows share a class.
Further columns stay with `kept`, and are not read otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procurelake.llm import text
from procurelake.llm.spark import prepared, stored

WIDTH, COMPONENTS = 5, 128
TREES, DEPTH, LEAST, REGION, FEW = 16, 6, 3, 48, 4
#: Classes of a crowd that are compared with each other, or with as many others, in one group.
CHUNK = 1024
#: Bytes of shingles that a task counts before it sends the counts.
HELD = 1 << 24
_U = np.uint64
_ODD = text.mix(np.arange(1, COMPONENTS + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)) | _U(1)
#: Undoes the product with _ODD, by which each tree orders ties.
_BACK = np.array([pow(int(x), -1, 1 << 64) for x in _ODD[:TREES]], np.uint64)


def sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct hashed shingles of all texts, sorted within each; where each text's begin, and the end)."""
    word, doc = text.word_hashes(data, offsets)
    n = len(offsets) - 1
    count = np.bincount(doc, minlength=n) if len(doc) else np.zeros(n, np.int64)
    h = word.copy()
    for k in range(1, WIDTH):
        if len(word) > k:
            h[:-k] = h[:-k] * _U(0xD6E8FEB86659FD93) + word[k:]
    same = np.zeros(len(word), bool)
    if len(word) >= WIDTH:
        same[: len(word) - WIDTH + 1] = doc[: len(word) - WIDTH + 1] == doc[WIDTH - 1 :]
    h, at = text.mix(h[same]), doc[same]
    first = np.cumsum(count) - count
    for d in np.flatnonzero((count > 0) & (count < WIDTH)):
        own = _U(count[d])
        for w in word[first[d] : first[d] + count[d]]:
            own = (own * _U(0xC2B2AE3D27D4EB4F)) ^ w
        h, at = np.append(h, text.mix(np.array([own]))), np.append(at, d)
    order = np.lexsort((h, at))
    h, at = h[order], at[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (at[1:] != at[:-1])
    h, at = h[new], at[new]
    return h, np.searchsorted(at, np.arange(n + 1))


def signed(df: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """(doc_id, th, n_shingles, node, check, signature): two hashes of the set (null where empty), hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for rows, data, offsets in text.blocks(batch):
                    h, edge = sets(data, offsets)
                    size = np.diff(edge)
                    some = np.flatnonzero(size)
                    node, check = np.zeros(len(size), np.uint64), np.zeros(len(size), np.uint64)
                    sig = np.zeros((len(size), COMPONENTS), np.uint16)
                    if len(some):
                        at = edge[some]
                        node[some] = np.add.reduceat(text.mix(h), at)
                        check[some] = np.add.reduceat(text.mix(h ^ _U(0x5851F42D4C957F2D)), at)
                        for k in range(COMPONENTS):
                            least = np.minimum.reduceat(h * _ODD[k], at)
                            sig[some, k] = (text.mix(least) >> _U(48)).astype(np.uint16)
                    none = size == 0
                    yield pa.RecordBatch.from_arrays(
                        [rows.column(0), rows.column(2), pa.array(size, pa.int64()), pa.array(node.view(np.int64), mask=none), pa.array(check.view(np.int64), mask=none), pa.array([None if z else s.astype(">u2").tobytes() for s, z in zip(sig, none.tolist(), strict=True)], pa.binary())],
                        names=["doc_id", "th", "n_shingles", "node", "check", "signature"],
                    )

    rows = df.select(F.col(key).alias("doc_id"), F.col(column).alias("text"), F.xxhash64(column).alias("th"))
    return rows.mapInArrow(run, f"doc_id {df.schema[key].dataType.simpleString()}, th long, n_shingles long, node long, check long, signature binary")


def _most_unlike(percent: int) -> int:
    """Differing bits of one-bit signatures up to which a pair may have the similarity: five standard deviations of slack."""
    p = (1 + percent / 100) / 2
    return int(COMPONENTS * (1 - p) + 5 * (COMPONENTS * p * (1 - p)) ** 0.5)


def _ordered(classes: DataFrame) -> DataFrame:
    """(tree, path, tie, bits, and label where classes have it): all classes in each tree's order."""
    spark = prepared(classes.sparkSession)

    def planted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sig = np.frombuffer(b"".join(b.column(1).to_pylist()), ">u2").reshape(-1, COMPONENTS)
            bits = [x.tobytes() for x in np.packbits((sig & 1).astype(np.uint8), axis=1)]
            for t in range(TREES):
                own = [x.tobytes() for x in np.ascontiguousarray(sig[:, t * DEPTH : (t + 1) * DEPTH])]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), t, np.int32)), pa.array(own, pa.binary()), pa.array((np.asarray(b.column(0)).view(np.uint64) * _ODD[t]).view(np.int64)), pa.array(bits, pa.binary()), *b.columns[2:]], names=["tree", "path", "tie", "bits", *b.schema.names[2:]])

    label = [c for c in ("label",) if c in classes.columns]
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = classes.select("node", "signature", *label).mapInArrow(planted, "tree int, path binary, tie long, bits binary" + ", label long" * len(label))
    return rows.repartitionByRange(parts, "tree", "path", "tie").sortWithinPartitions("tree", "path", "tie")


def _met(table: pa.Table) -> Iterator[tuple[np.ndarray, ...]]:
    """(i, j, unlike, crowd) of neighbours in an ordered table: places, differing bits, whether next in a region of over REGION."""
    tree = np.asarray(table["tree"])
    path = np.frombuffer(b"".join(table["path"].to_pylist()), ">u2").reshape(-1, DEPTH).astype(np.uint16)
    bits = np.frombuffer(b"".join(table["bits"].to_pylist()), np.uint64).reshape(len(tree), -1)
    n, place = len(tree), np.arange(len(tree))
    reach = np.minimum(place + FEW, n - 1)
    changed = tree[1:] != tree[:-1]
    settled = np.zeros(n, bool)
    for d in range(1, DEPTH + 1):
        changed = changed | (path[1:, d - 1] != path[:-1, d - 1])
        if d < LEAST:
            continue
        region = np.concatenate([[0], np.cumsum(changed)])
        size = np.bincount(region)
        last = np.cumsum(size)[region] - 1
        if d == LEAST:
            reach = np.minimum(reach, last)
        fits = ~settled & (size[region] <= REGION)
        reach[fits] = np.maximum(reach[fits], last[fits])
        settled |= fits
    for o in range(1, REGION):
        i = place[: n - o][reach[: n - o] >= o + place[: n - o]]
        if not len(i):
            break
        yield i, i + o, np.bitwise_count(bits[i] ^ bits[i + o]).sum(1).astype(np.int32), ~settled[i] & (region[i] == region[i + o]) & (o == 1)


def _nodes(table: pa.Table) -> np.ndarray:
    return (np.asarray(table["tie"]).view(np.uint64) * _BACK[np.asarray(table["tree"])]).view(np.int64)


def nearest(classes: DataFrame, percent: int) -> DataFrame:
    """(a, b, unlike): all classes b with neighbours, and each tree's likest a of smaller hash (null: none).

    One row a class and tree at most, however large the regions are."""
    most = _most_unlike(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [b for b in batches if b.num_rows]
        if not own:
            return
        table = pa.Table.from_batches(own)
        node = _nodes(table)
        met, least, like = np.zeros(len(node), bool), np.full(len(node), most + 1, np.int32), np.zeros(len(node), np.int64)
        for i, j, unlike, crowd in _met(table):
            ok = unlike <= most
            met[i[ok | crowd]] = met[j[ok | crowd]] = True
            i, j, unlike = i[ok], j[ok], unlike[ok]
            for a, b in ((i, j), (j, i)):
                better = (node[a] < node[b]) & ((unlike < least[b]) | ((unlike == least[b]) & (node[a] < like[b])))
                least[b[better]], like[b[better]] = unlike[better], node[a[better]]
        if met.any():
            none = least[met] > most
            yield pa.RecordBatch.from_arrays([pa.array(node[met]), pa.array(least[met], mask=none), pa.array(like[met], mask=none)], names=["b", "unlike", "a"])

    rows = _ordered(classes).mapInArrow(run, "b long, unlike int, a long")
    return rows.groupBy("a", "b").agg(F.min("unlike").alias("unlike"))


def candidates(classes: DataFrame, percent: int) -> DataFrame:
    """(a, b, la, lb, unlike, crowd) with a < b and their labels: neighbours of two labels in any of the forest's orders.

    crowd: the next in a region of over REGION; such pairs are there however unlike they are, and of one label too."""
    most = _most_unlike(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [b for b in batches if b.num_rows]
        if not own:
            return
        table = pa.Table.from_batches(own)
        node, label = _nodes(table), np.asarray(table["label"])
        for i, j, unlike, crowd in _met(table):
            ok = crowd | ((unlike <= most) & (label[i] != label[j]))
            i, j, unlike, crowd = i[ok], j[ok], unlike[ok], crowd[ok]
            if len(i):
                i, j = np.where(node[i] < node[j], i, j), np.where(node[i] < node[j], j, i)
                yield pa.RecordBatch.from_arrays([pa.array(node[i]), pa.array(node[j]), pa.array(label[i]), pa.array(label[j]), pa.array(unlike), pa.array(crowd)], names=["a", "b", "la", "lb", "unlike", "crowd"])

    rows = _ordered(classes).mapInArrow(run, "a long, b long, la long, lb long, unlike int, crowd boolean")
    return rows.groupBy("a", "b", "la", "lb").agg(F.min("unlike").alias("unlike"), F.max("crowd").alias("crowd"))


def full_sets(df: DataFrame, chosen: DataFrame, key: str, column: str) -> DataFrame:
    """(node, own): the whole sets of chosen classes (node, doc_id, th of one document)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for rows, data, offsets in text.blocks(batch):
                    h, edge = sets(data, offsets)
                    yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([h[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)], pa.binary())], names=["node", "own"])

    docs = df.select(F.col(key).alias("doc_id"), F.col(column).alias("text"), F.xxhash64(column).alias("th"))
    met = docs.join(chosen.withColumnsRenamed({"doc_id": "__id", "th": "__th"}), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("th") == F.col("__th")))
    return met.dropDuplicates(["node"]).select("node", "text").mapInArrow(run, "node long, own binary")


def confirmed(edges: DataFrame, own: DataFrame, percent: int) -> DataFrame:
    """The edges (a, b) whose full sets are alike enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    met = edges.select("a", "b").join(own.select(F.col("node").alias("a"), F.col("own").alias("x")), "a").join(own.select(F.col("node").alias("b"), F.col("own").alias("y")), "b")
    return met.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, label): for each end of a link the smallest node that it reaches."""
    both = stored(links.select(F.col("a").alias("node"), F.col("b").alias("other")).union(links.select("b", "a")).distinct())
    labels = stored(both.groupBy("node").agg(F.least("node", F.min("other")).alias("label")))
    while True:
        near = both.join(labels.withColumnsRenamed({"node": "other"}), "other").groupBy("node").agg(F.min("label").alias("m"))
        step = labels.join(near, "node").select("node", "label", F.least("label", "m").alias("m"))
        jump = labels.select(F.col("node").alias("m"), F.col("label").alias("j"))
        new = stored(step.join(jump, "m", "left").select("node", F.coalesce("j", "m").alias("new"), "label"))
        if not new.where("new != label").limit(1).count():
            return labels
        labels = new.select("node", F.col("new").alias("label"))


def rooted(links: DataFrame) -> DataFrame:
    """(node, label) for links (a, b) with a < b and each b once: the end of b's path over such links. A node without a b is its own."""
    labels = stored(links.select(F.col("b").alias("node"), F.col("a").alias("label")))
    while True:
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = stored(labels.join(jump, "label", "left").select("node", F.coalesce("next", "label").alias("label"), F.col("next").isNotNull().alias("moved")))
        labels = new.select("node", "label")
        if not new.where("moved").limit(1).count():
            return labels


def _across(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs (a, b, ...) of two components, with these as la < lb. A node that is not known is a component."""
    end = lambda c: known.select(F.col("node").alias(c), F.col("label").alias(f"l{c}"))
    out = pairs.join(end("a"), "a", "left").join(end("b"), "b", "left").withColumns({"la": F.coalesce("la", "a"), "lb": F.coalesce("lb", "b")})
    return out.where("la != lb").withColumns({"la": F.least("la", "lb"), "lb": F.greatest("la", "lb")})


def _likest(pairs: DataFrame) -> DataFrame:
    """(la, lb, a, b): of each two components the likest of `pairs`."""
    return pairs.groupBy("la", "lb").agg(F.min(F.struct("unlike", "a", "b")).alias("p")).select("la", "lb", "p.a", "p.b")


def _merged(known: DataFrame, links: DataFrame) -> DataFrame:
    """`known` (node, label) with the components joined that any of the links (a, b) joins; each pair of components counts once."""
    joins = stored(_across(links, known).select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct())
    if not joins.limit(1).count():
        return known
    joined = components(joins).select(F.col("node").alias("label"), F.col("label").alias("new"))
    single = joins.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("label", F.col("node"))
    all_ = known.union(single.join(known, "node", "left_anti").select("node", "label"))
    return stored(all_.join(joined, "label", "left").select("node", F.coalesce("new", "label").alias("label")))


def common(own: list[np.ndarray]) -> np.ndarray:
    """How many shingles each two of some sets have in common."""
    n, size = len(own), np.array([len(x) for x in own])
    word, at = np.unique(np.concatenate(own), return_inverse=True)
    who = np.repeat(np.arange(n), size)
    order = np.argsort(at, kind="stable")
    times = np.bincount(at, minlength=len(word))
    edge = np.concatenate([[0], np.cumsum(times)])
    out = np.zeros((n, n), np.float32)
    often = np.flatnonzero(times > max(1, n // 8))
    for k in range(0, len(often), 2048):
        some = often[k : k + 2048]
        x = np.zeros((n, len(some)), np.float32)
        x[who[order[np.repeat(edge[some], times[some]) + text.ranges(times[some])]], np.repeat(np.arange(len(some)), times[some])] = 1
        out += x @ x.T
    seldom = (times > 1) & (times <= max(1, n // 8))
    for i, (a, b) in enumerate(zip(np.cumsum(size) - size, np.cumsum(size), strict=True)):
        w = at[a:b][seldom[at[a:b]]]
        if len(w):
            out[i] += np.bincount(who[order[np.repeat(edge[w], times[w]) + text.ranges(times[w])]], minlength=n)
    np.fill_diagonal(out, size)
    return out


def crowded(met: DataFrame, own: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """`known` (node, label) with the components of each crowd joined that have a link."""
    end = lambda c: known.select(F.col("node").alias(c), F.col("label").alias(f"l{c}"))
    chain = met.where("crowd").select("a", "b").join(end("a"), "a", "left").join(end("b"), "b", "left").select("a", "b", F.coalesce("la", "a").alias("la"), F.coalesce("lb", "b").alias("lb"))
    across = stored(chain.where("la != lb").select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct())
    if not across.limit(1).count():
        return known
    crowds = components(across).select(F.col("node").alias("label"), F.col("label").alias("crowd"))
    nodes = chain.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("la").alias("label")), F.struct(F.col("b").alias("node"), F.col("lb").alias("label")))).alias("x")).select("x.*").distinct()
    hot = stored(nodes.join(crowds, "label").join(own, "node").select("node", "crowd", "label", "own"))

    def counted(crowd: list, node: list, own: list) -> pa.RecordBatch:
        size = np.array([len(x) // 8 for x in own])
        crowd, node, w = np.repeat(np.array(crowd), size), np.repeat(np.array(node), size), np.frombuffer(b"".join(own), np.int64)
        order = np.lexsort((node, w, crowd))
        crowd, node, w = crowd[order], node[order], w[order]
        first = np.flatnonzero(np.concatenate([[True], (crowd[1:] != crowd[:-1]) | (w[1:] != w[:-1])]))
        return pa.RecordBatch.from_arrays([pa.array(crowd[first]), pa.array(node[first]), pa.array(w[first]), pa.array(np.diff(np.append(first, len(w))))], names=["crowd", "node", "w", "n"])

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [[], [], []], 0
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for k, x in enumerate(row):
                    rows[k].append(x)
                held += len(row[2])
                if held >= HELD:
                    yield counted(*rows)
                    rows, held = [[], [], []], 0
        if held:
            yield counted(*rows)

    # a link's common shingles are at least `percent` of either set, and none of them is of one class only
    alone = hot.select("crowd", "node", "own").mapInArrow(shingles, "crowd long, node long, w long, n long").groupBy("crowd", "w").agg(F.min("node").alias("node"), F.sum("n").alias("n")).where("n = 1")
    alone = alone.groupBy("crowd", "node").agg(F.count("*").alias("alone"))
    size = F.length("own") / 8
    hot = stored(hot.join(alone, ["crowd", "node"], "left").where(100 * (size - F.coalesce("alone", F.lit(0))) >= percent * size).select("crowd", "node", "label", "own"))
    # chunks: of one large component, or of many small ones whole
    sizes = hot.groupBy("crowd", "label").agg(F.count("*").alias("n")).withColumn("large", F.col("n") > CHUNK)
    small = sizes.where("NOT large").groupBy("crowd").agg(F.sum("n").alias("all"))
    sizes = sizes.join(small, "crowd", "left")
    dealt = F.ceil(F.when(F.col("large"), F.col("n")).otherwise(F.col("all")) / CHUNK)
    part = F.pmod(F.xxhash64(F.when(F.col("large"), F.col("node")).otherwise(F.col("label"))), dealt)
    rows = stored(hot.join(sizes.select("crowd", "label", "large", "n", "all"), ["crowd", "label"]).select("crowd", "node", "label", "own", F.when(F.col("large"), F.col("label")).alias("one"), F.struct(F.when(F.col("large"), F.col("label")).alias("one"), part.alias("part")).alias("chunk")))
    chunks = rows.groupBy("crowd", "chunk").agg(F.first("one").alias("one"))
    left, right = chunks.select("crowd", F.col("chunk").alias("p"), F.col("one").alias("po")), chunks.select("crowd", F.col("chunk").alias("q"), F.col("one").alias("qo"))
    pairs = left.join(right, "crowd").where("p <= q AND NOT coalesce(po = qo, false)").withColumn("chunk", F.explode(F.array_distinct(F.array("p", "q")))).select("crowd", "chunk", F.xxhash64("crowd", "p", "q").alias("pair"))

    def compared(t: pa.Table) -> pa.Table:
        node, label = np.asarray(t["node"]), np.asarray(t["label"])
        own_ = [np.frombuffer(x, np.uint64) for x in t["own"].to_pylist()]
        n = np.array([len(x) for x in own_])
        both = common(own_).astype(np.int64)
        like = (100 * both >= percent * (n[:, None] + n - both)) & (label[:, None] != label)
        seen, a, b = np.zeros(len(node), bool), [], []
        for i in np.flatnonzero(like.any(1)):
            if seen[i]:
                continue
            seen[i], todo = True, [i]
            while todo:
                j = todo.pop()
                new = np.flatnonzero(like[j] & ~seen)
                seen[new] = True
                a += [label[j]] * len(new)
                b += label[new].tolist()
                todo += new.tolist()
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    links = stored(rows.join(pairs, ["crowd", "chunk"]).select("pair", "node", "label", "own").groupBy("pair").applyInArrow(compared, "a long, b long").distinct())
    return _merged(known, links)


def linked(df: DataFrame, percent: int = 80, key: str = "doc_id", column: str = "text") -> DataFrame:
    """(doc_id, th, n_shingles, component_id, kept) for each row."""
    prepared(df.sparkSession)
    docs = stored(signed(df, key, column))
    some = docs.where("node IS NOT NULL")
    classes = stored(some.groupBy("node", "check").agg(F.min("doc_id").alias("least"), F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "th")).alias("rep"), F.min("signature").alias("signature")))
    # each class with its likest candidate, then what is left between the components that this makes
    near = stored(nearest(classes, percent))
    chosen = near.select(F.col("b").alias("node")).distinct().join(classes, "node").select("node", "rep.doc_id", "rep.th")
    own = stored(full_sets(df, chosen, key, column))
    near = near.where("a IS NOT NULL")
    best = near.groupBy("b").agg(F.min(F.struct("unlike", "a")).alias("p")).select(F.col("p.a").alias("a"), "b")
    final = rooted(confirmed(best, own, percent))
    final = _merged(final, confirmed(_likest(_across(near.join(best, ["a", "b"], "left_anti"), final)), own, percent))
    met = stored(candidates(classes.join(final, "node", "left").select("node", "signature", F.coalesce("label", "node").alias("label")), percent))
    far = met.where((F.col("la") != F.col("lb")) & (F.col("unlike") <= _most_unlike(percent))).withColumns({"la": F.least("la", "lb"), "lb": F.greatest("la", "lb")})
    likest = _likest(far)
    sure = stored(confirmed(likest, own, percent))
    others = far.join(likest.join(sure, ["a", "b"]).select("la", "lb"), ["la", "lb"], "left_anti").join(likest, ["a", "b"], "left_anti")
    final = _merged(final, sure.union(confirmed(others, own, percent)))
    if met.where("crowd").limit(1).count():
        final = crowded(met, own, final, percent)
    classes = classes.select("node", "check", "least").join(final, "node", "left").withColumn("label", F.coalesce("label", "node"))
    ids = classes.groupBy("label").agg(F.min("least").alias("component_id"))
    known = classes.join(ids, "label").select("node", "check", "component_id")
    out = docs.select("doc_id", "th", "n_shingles", "node", "check").join(known, ["node", "check"], "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "th", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def kept(df: DataFrame, percent: int = 80, key: str = "doc_id", column: str = "text") -> DataFrame:
    """df without the rows that aren't the first of their component, in df's own columns."""
    gone = linked(df, percent, key, column).where("NOT kept").select(F.col("doc_id").alias("__id"), F.col("th").alias("__th")).distinct()
    return df.join(gone, df[key].eqNullSafe(F.col("__id")) & (F.xxhash64(df[column]) == F.col("__th")), "left_anti")
