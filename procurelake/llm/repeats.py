"""Suffix-array dedup: bytes covered by a string of LENGTH bytes that also starts in a document with a smaller id.

1. Anchors. Every window of LENGTH bytes has an anchor: of its K-byte strings the one with the least
   hash, the leftmost of equals. Windows in a row with one anchor make a context, from the first
   byte of the first to the last of the last. Equal windows have equal anchors at equal places, so
   only contexts that share an anchor's bytes need to meet. They are dealt out by the anchor's hash,
   as packed arrays of hashes and places, without text.
2. Where contexts meet: of equal ones (64 bits of a hash of
   all bytes, beside 48 of the anchor's) all but those of the least id go whole;
   those of the least id all stay, as a document may have the same context several times.
   Different contexts of one anchor can share a window only if the REACH bytes left or right of the
   anchor are equal; those that have such a partner in another document are taken further.
3. The bytes of these are fetched from the texts and dealt out by anchor. The contexts of an anchor
   are laid end to end, their suffix array is built (`suffixes.suffix_arrays`), and neighbours in
   it that agree in LENGTH bytes tell which windows also start in a document with a smaller id. An
   anchor with more than MANY contexts is thinned first: contexts are cut to what any other shares,
   and of those that are then equal the one with the least id stands for all; what is found for it
   holds for its twins of the same id too. What is still more than MANY is divided by the bytes beside
   the anchor, so that no string is long: strings are built together, in as many turns as the longest has bytes.
4. Ranges come together with the texts once more, and the covered bytes are removed.

Null texts are empty; a null id is smaller than none and no id is smaller than it: such rows stay
whole and take nothing from others. Rows with equal ids don't take from each other. A document
shorter than LENGTH stays whole. Further columns stay in `trimmed`, and are not read otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from procurelake.llm import text
from procurelake.llm.spark import prepared, stored
from procurelake.llm.suffixes import suffix_arrays

LENGTH, K = 50, 12
#: K-byte strings in a window, and bytes beside an anchor that two contexts with a common window share on one side.
STEPS = LENGTH - K + 1
REACH = (LENGTH - K) // 2
MANY = 48
#: Bytes whose suffix arrays are built at once.
BATCH = 3 << 18
#: Bytes of text whose contexts are found at once.
BLOCK = 1 << 19
#: Contexts that are held before they are dealt out: pieces are as many as destinations for so many contexts, not for each block.
DEAL = 1 << 18
_U = np.uint64
_PLACE = 27  # bits of a place in a block


def labels(spark: SparkSession) -> list[int]:
    """Numbers that a hash partitioner deals to all partitions, one each: index by partition. Twice as many as for other shuffles: whole partitions are held."""
    n = 2 * max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    got: dict[int, int] = {}
    at = 0
    while len(got) < n:
        for r in spark.range(at, at + 32 * n, 1, 1).select(F.col("id").cast("int").alias("i"), F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("p")).collect():
            got.setdefault(r.p, r.i)
        at += 32 * n
    return [got[p] for p in range(n)]


class Packed:
    """Columns of numbers as one binary, byte plane by byte plane so that they compress."""

    def __init__(self, **widths: int):
        self.widths = widths
        self.width = sum(widths.values())

    def dump(self, edge: np.ndarray, **columns: np.ndarray) -> list[bytes]:
        """The rows between each two edges. Planes are made once for all: there are more pieces the more partitions and rows there are."""
        planes = np.empty((self.width, len(next(iter(columns.values())))), np.uint8)
        at = 0
        for c, w in self.widths.items():
            planes[at : at + w] = np.ascontiguousarray(columns[c], "<u8").view(np.uint8).reshape(-1, 8)[:, :w].T
            at += w
        return [planes[:, a:b].tobytes() for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())]

    def load(self, pieces: list[bytes]) -> dict[str, np.ndarray]:
        planes = np.concatenate([np.frombuffer(x, np.uint8).reshape(self.width, len(x) // self.width) for x in pieces] or [np.zeros((self.width, 0), np.uint8)], axis=1)
        at, out = 0, {}
        for c, w in self.widths.items():
            x = np.zeros((planes.shape[1], 8), np.uint8)
            x[:, :w] = planes[at : at + w].T
            out[c] = x.view("<u8").ravel()
            at += w
        return out


DOCS = Packed(id=8, th=4, home=4)
ANCHORS = Packed(anchor=6, whole=8, left=2, right=2, doc=3, start=4, windows=1)
RANGES = Packed(id=8, th=4, start=4, bytes=4, anchor=8)


def contexts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """All contexts of a block of texts: anchor, whole, left, right (hashes), doc, at (place of the first window), windows."""
    n = len(data)
    if n < LENGTH:
        return {k: np.zeros(0, np.int64) for k in ("anchor", "whole", "left", "right", "doc", "at", "windows")}
    starts = np.arange(n - K + 1)
    h = text.span_hashes(data, starts, starts + K)
    m = (h >> _U(_PLACE)) << _U(_PLACE) | starts.astype(np.uint64)
    width = 1
    while width * 2 <= STEPS:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    if width < STEPS:
        m = np.minimum(m[: len(m) - (STEPS - width)], m[STEPS - width :])
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(m)]
    inside = np.arange(len(m)) + LENGTH <= offsets[doc + 1]
    new = np.ones(len(m), bool)
    new[1:] = (m[1:] != m[:-1]) | (doc[1:] != doc[:-1]) | (inside[1:] != inside[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(m))
    ok = inside[first]
    first, last = first[ok], last[ok] - 1
    place = (m[first] & _U((1 << _PLACE) - 1)).astype(np.int64)
    end = last + LENGTH
    some = [(first, end), (place - REACH, place), (place + K, place + K + REACH)]
    out = []
    for a, b in some:
        fits = (a >= first) & (b <= end)
        out.append(np.where(fits, text.span_hashes(data, np.where(fits, a, first), np.where(fits, b, end)) | _U(1), _U(0)))
    return {"anchor": text.mix(h[place]) >> _U(16), "whole": out[0], "left": out[1] & _U(0xFFFF), "right": out[2] & _U(0xFFFF), "doc": doc[first], "at": first, "windows": last - first + 1}


def _sorted(to: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order by destination, destinations that have rows, where each one's rows begin and the last one's end)."""
    order = np.argsort(to.astype(np.uint16) if parts <= 1 << 16 else to, kind="stable")
    edge = np.searchsorted(to[order], np.arange(parts + 1))
    some = np.flatnonzero(np.diff(edge))
    return order, some, np.append(edge[some], len(to))


def _dealt(kind: int, home: np.ndarray, names: list[int], columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """Ranges as one batch, with a row for each home."""
    order, some, edge = _sorted(home, len(names))
    blobs = RANGES.dump(edge, **{c: v[order] for c, v in columns.items()})
    return pa.RecordBatch.from_arrays([pa.array(np.array(names)[some], pa.int32()), pa.array(np.full(len(some), kind), pa.int32()), pa.array(blobs, pa.binary())], names=["home", "kind", "ranges"])


def _spread(held: list[dict[str, np.ndarray]], docs: list[dict[str, np.ndarray]], names: list[int]) -> pa.RecordBatch:
    """Contexts of some blocks as one batch, with a row for each bucket: its documents and its contexts."""
    c, d = ({k: np.concatenate([x[k] for x in all_]) for k in all_[0]} for all_ in (held, docs))
    to = (c["anchor"] % _U(len(names))).astype(np.int64)
    order, some, edge = _sorted(to, len(names))
    c = {k: v[order] for k, v in c.items()}
    new = _runs(to[order], c["doc"])
    number = np.cumsum(new) - 1
    first = np.append(number, new.sum())[edge]
    own = c["doc"][new]
    c["doc"] = number - np.repeat(first[:-1], np.diff(edge))
    return pa.RecordBatch.from_arrays(
        [pa.array(np.array(names)[some], pa.int32()), pa.array(DOCS.dump(first, **{k: v[own] for k, v in d.items()}), pa.binary()), pa.array(ANCHORS.dump(edge, **c), pa.binary())],
        names=["bucket", "docs", "anchors"],
    )


def _anchors(batches: Iterator[pa.RecordBatch], names: list[int]) -> Iterator[pa.RecordBatch]:
    """The contexts of rows (doc_id, text, th, n), dealt out by anchor whenever there are DEAL of them."""
    held, docs, size, rows = [], [], 0, 0
    for batch in batches:
        for b, data, offsets in text.blocks(batch, limit=BLOCK):
            c = contexts(data, offsets)
            if not len(c["doc"]):
                continue
            ok = ~np.asarray(b.column(0).is_null())[c["doc"]]
            start = c.pop("at") - offsets[c["doc"]]
            c = {k: v[ok] for k, v in (c | {"doc": c["doc"] + rows, "start": start}).items()}
            small = {"left": np.uint16, "right": np.uint16, "doc": np.int32, "start": np.int32, "windows": np.uint8}
            held.append({k: v.astype(small.get(k, v.dtype)) for k, v in c.items()})
            docs.append({"id": np.asarray(b.column(0).fill_null(0)), "th": np.asarray(b.column(2)).view(np.uint32), "home": np.asarray(b.column(3))})
            size, rows = size + len(c["doc"]), rows + b.num_rows
            if size >= DEAL:
                yield _spread(held, docs, names)
                held, docs, size, rows = [], [], 0, 0
    if size:
        yield _spread(held, docs, names)


def _records(it: Iterator[pa.RecordBatch]) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """All (documents, anchors) of a partition's blobs; `doc` counts through the documents."""
    tables, blobs = [], []
    for b in it:
        tables += b.column(1).to_pylist()
        blobs += b.column(2).to_pylist()
    if not tables:
        return {}, {}
    docs, anchors = DOCS.load(tables), ANCHORS.load(blobs)
    n = np.array([len(x) for x in tables]) // DOCS.width
    anchors["doc"] += np.repeat(np.cumsum(n) - n, np.array([len(x) for x in blobs]) // ANCHORS.width).astype(np.uint64)
    return docs, anchors


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def _partners(anchor: np.ndarray, side: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which rows have the same anchor and side hash (not 0) as a row of another document."""
    if not len(anchor):
        return np.zeros(0, bool)
    order = np.lexsort((ids, side, anchor))
    a, s, i = anchor[order], side[order], ids[order]
    run = np.cumsum(_runs(a, s)) - 1
    first = np.flatnonzero(_runs(a, s))
    many = i[first] != i[np.append(first[1:], len(a)) - 1]
    out = np.zeros(len(a), bool)
    out[order] = many[run] & (s != 0)
    return out


def _meet(it: Iterator[pa.RecordBatch], names: list[int]) -> Iterator[pa.RecordBatch]:
    docs, a = _records(it)
    if not a:
        return
    doc = a["doc"].astype(np.int64)
    ids = docs["id"][doc].view(np.int64)
    order = np.lexsort((ids, a["whole"], a["anchor"]))
    anchor, whole, ids, doc = a["anchor"][order], a["whole"][order], ids[order], doc[order]
    new = _runs(anchor, whole)
    least = ids[np.flatnonzero(new)][np.cumsum(new) - 1]
    gone = ids > least
    reps = np.flatnonzero(~gone)
    group = np.cumsum(_runs(anchor)) - 1
    reps = reps[np.bincount(group[new])[group[reps]] > 1]
    own = order[reps]
    further = _partners(anchor[reps], a["left"][own], ids[reps]) | _partners(anchor[reps], a["right"][own], ids[reps])
    for kind, at in ((0, np.flatnonzero(gone)), (1, reps[further])):
        d, src = doc[at], order[at]
        columns = {"id": docs["id"][d], "th": docs["th"][d], "start": a["start"][src], "bytes": a["windows"][src] + _U(LENGTH - 1), "anchor": anchor[at] if kind else np.zeros(len(at), np.uint64)}
        yield _dealt(kind, docs["home"][d].astype(np.int64), names, columns)


def _rows_of(docs: pa.Table, ranges: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(row of docs, range) for each range and each row with its id and text hash."""
    ids, th = np.asarray(docs["doc_id"].fill_null(0)), np.asarray(docs["th"]).view(np.uint32).astype(np.int64)
    known = ~np.asarray(docs["doc_id"].is_null())
    key = text.mix(ids.view(np.uint64)) ^ th.astype(np.uint64)
    order = np.argsort(key, kind="stable")
    want = text.mix(ranges["id"]) ^ ranges["th"]
    a, b = np.searchsorted(key[order], want, "left"), np.searchsorted(key[order], want, "right")
    r = np.repeat(np.arange(len(want)), b - a)
    row = order[np.repeat(a, b - a) + text.ranges(b - a)]
    ok = known[row] & (ids[row] == ranges["id"].view(np.int64)[r])
    return row[ok], r[ok]


def _loaded(table: pa.Table) -> dict[str, np.ndarray]:
    return RANGES.load(table["ranges"].to_pylist())


def thinned(ctx: list[bytes], at: np.ndarray, ids: np.ndarray, anchors: np.ndarray, many: int = MANY) -> tuple[list[int], np.ndarray, np.ndarray, list[tuple[int, int, int]], list[tuple[int, int]]]:
    """Contexts of one anchor cut to what others share: (those left, their cuts' starts and ends, removed (context, start, end),
    (context, the one of the same id that stands for it) as they were met).

    anchors: the anchor's place in each context."""
    low, high = np.zeros(len(ctx), np.int64), np.array([len(c) for c in ctx])
    left, gone, twins = list(np.lexsort((np.arange(len(ctx)), ids))), [], []
    while len(left) > many:
        reach = []
        for side in (0, 1):
            if side:
                part = [ctx[i][anchors[i] : high[i]] for i in left]
            else:
                part = [ctx[i][low[i] : anchors[i]][::-1] for i in left]
            order = sorted(range(len(part)), key=part.__getitem__)
            common = [_common(part[a], part[b]) for a, b in zip(order, order[1:])]
            most = np.zeros(len(part), np.int64)
            for k, c in enumerate(common):
                most[order[k]] = max(most[order[k]], c)
                most[order[k + 1]] = max(most[order[k + 1]], c)
            reach.append(most)
        before = len(left)
        stay: dict[bytes, int] = {}
        for k, i in enumerate(left):
            low[i], high[i] = anchors[i] - reach[0][k], anchors[i] + reach[1][k]
            if high[i] - low[i] < LENGTH:
                continue
            key = ctx[i][low[i] : high[i]] + int(reach[0][k]).to_bytes(4, "big")
            if (j := stay.setdefault(key, i)) != i:
                if ids[i] > ids[j]:
                    gone.append((i, int(low[i]), int(high[i])))
                else:
                    twins.append((i, j))
        left = list(stay.values())
        if len(left) == before:
            break
    return left, low, high, gone, twins


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    x, y = np.frombuffer(a, np.uint8, n), np.frombuffer(b, np.uint8, n)
    return int((x != y).argmax())


def divided(rows: list[int], ctx: list[bytes], ids: list[int], place: list[int], many: int = MANY) -> tuple[list[list[int]], list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """An anchor's contexts in groups of at most `many`: (groups, removed (context, start, end), (context, one whose ranges it has too, their distance)).

    Contexts that share a window share the same number of bytes left of the anchor in it. Such numbers are
    halved until groups are small: a context goes on, cut to the windows of a half, with those that have the
    bytes that are in all windows of the half. Parts of contexts are added to ctx, ids and place."""
    groups, found, copies, todo = [], [], [], [(rows, 0, STEPS - 1)]

    def part(i: int, a: int, b: int) -> int:
        ctx.append(ctx[i][a:b])
        ids.append(ids[i])
        place.append(place[i] - a)
        copies.append((i, len(ctx) - 1, a))
        return len(ctx) - 1

    while todo:
        rows, least, most = todo.pop()
        at = np.array([place[i] for i in rows])
        left, low, high, gone, twins = thinned([ctx[i] for i in rows], np.zeros(len(rows), np.int64), np.array([ids[i] for i in rows]), at, many)
        found += [(rows[i], a, b) for i, a, b in gone]
        copies += [(rows[i], rows[j], int(at[i] - at[j])) for i, j in twins]
        if len(left) <= many or least == most:
            groups.append([part(rows[i], int(low[i]), int(high[i])) for i in left])
            continue
        middle = (least + most) // 2
        for a, b in ((least, middle), (middle + 1, most)):
            same: dict[bytes, list[int]] = {}
            for i in left:
                before, after = int(at[i] - low[i]), int(high[i] - at[i]) - K
                if max(a, STEPS - 1 - after) <= min(b, before):
                    same.setdefault(ctx[rows[i]][at[i] - a : at[i] + K + STEPS - 1 - b], []).append(i)
            for own in same.values():
                if len({ids[rows[i]] for i in own}) > 1:
                    todo.append(([part(rows[i], int(max(low[i], at[i] - b)), int(min(high[i], at[i] + K + STEPS - 1 - a))) for i in own], a, b))
    return groups, found, copies


def shared_windows(group: np.ndarray, ids: np.ndarray, ctx: list[bytes]) -> list[tuple[int, int, int]]:
    """(context, first byte, end) of runs of windows that also start in a context of the same group with a smaller id."""
    out = []
    order = np.argsort(group, kind="stable")
    edges = np.append(np.flatnonzero(_runs(group[order])), len(order)) if len(order) else np.zeros(1, np.int64)
    size = np.array([len(c) for c in ctx], np.int64)[order]
    total = np.concatenate([[0], np.cumsum(size + 1)])
    at = 0
    while at + 1 < len(edges):
        to = at + 1
        while to + 1 < len(edges) and total[edges[to + 1]] - total[edges[at]] <= BATCH:
            to += 1
        own = order[edges[at] : edges[to]]
        raw = b"\x00".join([ctx[i] for i in own]) + b"\x00"  # a place holder after each context
        x = np.frombuffer(raw, np.uint8).astype(np.int64) + 2
        stop = np.cumsum(size[edges[at] : edges[to]] + 1) - 1
        begin = np.append(0, stop[:-1] + 1)
        x[stop] = 1
        last = edges[at + 1 : to + 1] - edges[at] - 1
        x[stop[last]] = 0
        sa = suffix_arrays(x, begin[edges[at:to] - edges[at]])
        c = np.searchsorted(stop, sa)
        valid = sa + LENGTH <= stop[c]
        sa, c = sa[valid], c[valid]
        padded = np.frombuffer(raw + b"\x00" * 8, np.uint8)
        same = np.ones(max(0, len(sa) - 1), bool)
        g = np.repeat(np.arange(to - at), np.diff(edges[at : to + 1]))[c]
        same &= g[1:] == g[:-1]
        words = np.lib.stride_tricks.as_strided(padded, (len(raw) + 1, 8), (1, 1))
        for k in [*range(0, LENGTH - 8, 8), LENGTH - 8]:
            w = np.ascontiguousarray(words[sa + k]).view(np.uint64).ravel()
            same &= w[1:] == w[:-1]
        run = np.concatenate([[0], np.cumsum(~same)]) if len(sa) else np.zeros(0, np.int64)
        if len(sa):
            least = np.full(run[-1] + 1, np.iinfo(np.int64).max)
            np.minimum.at(least, run, ids[own[c]])
            hit = ids[own[c]] > least[run]
            p = np.sort(sa[hit])
            if len(p):
                breaks = np.flatnonzero(np.concatenate([[True], np.diff(p) > 1]))
                firsts, lasts = p[breaks], p[np.append(breaks[1:], len(p)) - 1]
                which = np.searchsorted(stop, firsts)
                out += [(int(own[w]), int(a - begin[w]), int(b - begin[w]) + LENGTH) for w, a, b in zip(which, firsts, lasts)]
        at = to
    return out


CONTEXT = "bucket int, anchor long, doc_id long, th int, home int, start int, place int, bytes binary"


def _resolve(it: Iterator[pa.RecordBatch], names: list[int], many: int) -> Iterator[pa.RecordBatch]:
    own = [b for b in it if b.num_rows]
    if not own:
        return
    t = pa.Table.from_batches(own)
    ids, start, place = (np.asarray(t[c]) for c in ("doc_id", "start", "place"))
    # equal contexts were left to one id; rows of one id may still be equal
    ctx, whose, where = t["bytes"].to_pylist(), ids.tolist(), place.tolist()
    order = np.argsort(np.asarray(t["anchor"]), kind="stable")
    edges = np.append(np.flatnonzero(_runs(np.asarray(t["anchor"])[order])), len(order))
    groups: list[list[int]] = []
    found: list[tuple[int, int, int]] = []
    copies: list[tuple[int, int, int]] = []
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        rows = order[a:b].tolist()
        if len(rows) <= many:
            groups.append(rows)
            continue
        some, gone, alike = divided(rows, ctx, whose, where, many)
        groups += some
        found += gone
        copies += alike
    some = [i for g in groups for i in g]
    label = np.repeat(np.arange(len(groups)), [len(g) for g in groups])
    found += [(some[i], a, b) for i, a, b in shared_windows(label, np.array(whose)[some], [ctx[i] for i in some])]
    spans: dict[int, set[tuple[int, int]]] = {}
    for i, a, b in found if copies else []:
        spans.setdefault(i, set()).add((a, b))
    for i, j, shift in reversed(copies):
        if j in spans:
            spans.setdefault(i, set()).update((a + shift, b + shift) for a, b in spans[j])
    if copies:
        found = [(i, a, b) for i, own in spans.items() if i < t.num_rows for a, b in own]
    if not found:
        return
    r, a, b = (np.array(x) for x in zip(*found, strict=True))
    columns = {"id": ids[r].view(np.uint64), "th": np.asarray(t["th"])[r].view(np.uint32).astype(np.uint64), "start": (start[r] + a).astype(np.uint64), "bytes": (b - a).astype(np.uint64), "anchor": np.zeros(len(r), np.uint64)}
    yield _dealt(2, np.asarray(t["home"])[r].astype(np.int64), names, columns)


def removed(df: DataFrame, key: str = "doc_id", column: str = "text", carry: list[str] | None = None, many: int = MANY) -> DataFrame:
    """(doc_id, th, n, n_bytes, spans, kept): maximal removed runs (start, end) of the text's bytes, and the rest.

    With `carry`, these columns of df too as carried0, carried1, ..., and the rest as a text, `rest`.
    An anchor with more than `many` contexts is thinned before its suffix array is built."""
    spark = prepared(df.sparkSession)
    names = labels(spark)
    parts = len(names)
    body = F.coalesce(F.col(column), F.lit(""))
    th = F.hash(F.xxhash64(body))
    numbered = F.pmod(F.xxhash64(F.col(key), body), F.lit(parts)).cast("int")
    carried = [F.col(c).alias(f"carried{i}") for i, c in enumerate(carry or [])]
    all_rows = df.select(F.col(key).cast("long").alias("doc_id"), body.alias("text"), th.alias("th"), numbered.alias("n"), *carried)
    rows = all_rows.select("doc_id", "text", "th", "n")

    met = rows.mapInArrow(lambda it: _anchors(it, names), "bucket int, docs binary, anchors binary").repartition(parts, "bucket")
    met = stored(met.mapInArrow(lambda it: _meet(it, names), "home int, kind int, ranges binary"))

    # the number of a row's partition becomes the label that is dealt to that partition
    home = F.element_at(F.array(*[F.lit(x) for x in names]), F.col("n") + 1)
    texts = all_rows.withColumn("home", home).repartition(parts, "home")
    extra = [f"carried{i}" for i in range(len(carried))]
    schema = "doc_id long, th int, n int, n_bytes long, spans array<struct<start: long, end: long>>, kept binary"
    if carry is not None:
        schema = T.StructType.fromDDL(schema)
        schema = T.StructType([*schema.fields, T.StructField("rest", T.StringType()), *[all_rows.schema[c] for c in extra]])

    def fetched(docs: pa.Table, ranges: pa.Table) -> pa.Table:
        r = _loaded(ranges)
        if docs.num_rows:
            data, offsets = text.buffers(docs["text"])
            row, i = _rows_of(docs, r)
        else:
            row = i = np.zeros(0, np.int64)
        start, size = r["start"][i].astype(np.int64), r["bytes"][i].astype(np.int64)
        parts_, place = [], np.zeros(len(row), np.int64)
        for k, (d, s, n) in enumerate(zip(row.tolist(), start.tolist(), size.tolist(), strict=True)):
            own = data[offsets[d] + s : offsets[d] + s + n]
            parts_.append(own.tobytes())
        if parts_:
            joined = np.frombuffer(b"".join(parts_), np.uint8)
            begin = np.cumsum(size) - size
            # the anchor: the K-byte string in every window, least by hash, leftmost of equals
            where = np.repeat(begin + size - LENGTH, STEPS).reshape(-1, STEPS) + np.arange(STEPS)
            h = text.span_hashes(joined, where.ravel(), where.ravel() + K).reshape(-1, STEPS) >> _U(_PLACE)
            place = size - LENGTH + h.argmin(1)
        n = docs["n"].to_numpy()[row] if docs.num_rows else row
        return pa.table(
            [pa.array(np.array(names)[(r["anchor"][i] % _U(parts)).astype(np.int64)] if len(i) else [], pa.int32()), pa.array(r["anchor"][i].view(np.int64)), pa.array(r["id"][i].view(np.int64)), pa.array(r["th"][i].astype(np.uint32).view(np.int32)), pa.array(n, pa.int32()), pa.array(start, pa.int32()), pa.array(place, pa.int32()), pa.array(parts_, pa.binary())],
            names=[x.split()[0] for x in CONTEXT.split(", ")],
        )

    some = texts.groupBy("home").cogroup(met.where("kind = 1").groupBy("home")).applyInArrow(fetched, CONTEXT)
    solved = some.repartition(parts, "bucket").mapInArrow(lambda it: _resolve(it, names, many), "home int, kind int, ranges binary")

    def cut(docs: pa.Table, ranges: pa.Table) -> pa.Table:
        data, offsets = text.buffers(docs["text"])
        row, i = _rows_of(docs, r := _loaded(ranges)) if docs.num_rows else (np.zeros(0, np.int64),) * 2
        a = offsets[row] + r["start"][i].astype(np.int64)
        depth = np.bincount(a, minlength=len(data) + 1) - np.bincount(a + r["bytes"][i].astype(np.int64), minlength=len(data) + 1) if len(row) else np.zeros(len(data) + 1, np.int64)
        covered = np.cumsum(depth)[: len(data)] > 0
        edge = np.diff(covered.astype(np.int8), prepend=0, append=0)
        begin, stop = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)
        # a run may go from the end of one document into the next: cut it there
        first, last = np.searchsorted(offsets, begin, "right") - 1, np.searchsorted(offsets, stop, "left") - 1
        times = last - first + 1
        d = np.repeat(first, times) + text.ranges(times)
        begin, stop = np.maximum(np.repeat(begin, times), offsets[d]), np.minimum(np.repeat(stop, times), offsets[d + 1])
        ok = begin < stop
        d, begin, stop = d[ok], begin[ok], stop[ok]
        n = docs.num_rows
        spans = pa.StructArray.from_arrays([pa.array(begin - offsets[d]), pa.array(stop - offsets[d])], names=["start", "end"])
        kept_at = np.concatenate([[0], np.cumsum(~covered)])[offsets]
        rest = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(kept_at.astype(np.int64).tobytes()), pa.py_buffer(data[~covered].tobytes())]).cast(pa.binary())
        columns = {"doc_id": docs["doc_id"], "th": docs["th"], "n": docs["n"], "n_bytes": pa.array(np.diff(offsets)), "spans": pa.ListArray.from_arrays(pa.array(np.searchsorted(d, np.arange(n + 1)), pa.int32()), spans), "kept": rest}
        if carry is not None:
            columns["rest"] = pa.array([x.decode("utf-8", "ignore") for x in rest.to_pylist()], pa.string())
            columns |= {c: docs[c] for c in extra}
        return pa.table(columns)

    all_ = met.where("kind = 0").unionByName(solved)
    return texts.groupBy("home").cogroup(all_.groupBy("home")).applyInArrow(cut, schema)


def trimmed(df: DataFrame, key: str = "doc_id", column: str = "text", length: str = "n_chars") -> DataFrame:
    """df with its texts' repeated strings removed; a character that was cut in part goes whole. `length` is set anew if df has it."""
    others = [c for c in df.columns if c not in (column, length)]
    out = removed(df, key, column, others)
    made = {column: F.col("rest").alias(column), length: F.length("rest").cast("long").alias(length)}
    return out.select(*[made[c] if c in made else F.col(f"carried{others.index(c)}").alias(c) for c in df.columns])
