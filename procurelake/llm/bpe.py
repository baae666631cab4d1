"""Byte-level BPE: a minimal perfect hash for whole pre-tokens, a heap over linked bytes for the rest.

A pre-token that is in the vocabulary is found by one probe of a minimal perfect hash (hash and
displace: as many slots as keys, each probe verified against the slot's key). Any other pre-token
is merged from its bytes, kept as a doubly linked list, by a heap of candidate merges, so that a
pre-token of n bytes takes O(n log n) steps however long it is.

Null and empty texts have no ids. Rows, ties and further columns are kept as they are. What a
worker remembers of pieces it has met is bounded and only saves time.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from procurelake.llm.spark import prepared
from procurelake.llm.text import mix

#: Pieces that a worker remembers, and the longest of them.
REMEMBERED, LONGEST = 600_000, 48
#: A vocabulary goes to every executor; a larger file is refused.
VOCABULARY_BYTES = 64 << 20
_FAR = 1 << 60
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)


class PerfectHash:
    """Minimal perfect hash of byte strings: slot(key) is a bijection of the keys to 0..n-1."""

    def __init__(self, keys: list[bytes]):
        n = self.n = len(keys)
        self.buckets = max(1, n // 4)
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, n)
        bucket = (h % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        size = np.bincount(bucket, minlength=self.buckets)
        start = np.cumsum(size) - size
        self.shift = np.zeros(self.buckets, np.int64)
        free = np.ones(n, bool)
        tries = np.arange(256, dtype=np.uint64)
        singles = []
        for b in np.argsort(-size, kind="stable"):
            own = order[start[b] : start[b] + size[b]]
            if len(own) < 2:
                singles += [(b, i) for i in own]
                continue
            for at in range(0, 1 << 22, len(tries)):
                slots = mix(h[own] + (tries + np.uint64(at))[:, None] * _STEP) % np.uint64(n)
                good = [k for k in np.flatnonzero(free[slots].all(1)) if len(set(slots[k].tolist())) == len(own)]
                if good:
                    k = int(good[0])
                    self.shift[b] = at + k
                    free[slots[k]] = False
                    break
            else:
                raise ValueError("no perfect hash: two keys are equal")
        for (b, _), slot in zip(singles, np.flatnonzero(free), strict=True):
            self.shift[b] = -1 - slot  # a key alone in its bucket is given a free slot outright
        self.order = np.empty(n, np.int64)
        self.order[self._slots(h)] = np.arange(n)

    def _slots(self, h: np.ndarray) -> np.ndarray:
        shift = self.shift[(h % np.uint64(self.buckets)).astype(np.int64)]
        moved = mix(h + np.maximum(shift, 0).astype(np.uint64) * _STEP) % np.uint64(max(1, self.n))
        return np.where(shift < 0, -1 - shift, moved.astype(np.int64))

    def index(self, keys: list[bytes]) -> np.ndarray:
        """The place of each key in the list that was hashed; the place of some other key where it isn't one of them."""
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))
        return self.order[self._slots(h)]


class Codec:
    """Encoder and decoder over a table of ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, pattern
        self.tokens = list(ranks)
        self.hash = PerfectHash(self.tokens)
        self.by_id = {v: k for k, v in ranks.items()}
        self._ready()

    def _ready(self) -> None:
        self.find = regex.compile(self.pattern).findall
        self.joined = regex.compile(r"\s ").search
        self.known: dict[str, bytes] = {}
        self.later: dict[str, bytes] = {}
        self.sooner: dict[str, bytes] = {}

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("find", "joined", "known", "later", "sooner")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._ready()

    @classmethod
    def from_file(cls, path: str, pattern: str) -> Codec:
        with open(path, "rb") as f:
            raw = f.read(VOCABULARY_BYTES + 1)
        if len(raw) > VOCABULARY_BYTES:
            raise ValueError(f"{path} is larger than {VOCABULARY_BYTES} bytes")
        return cls({base64.b64decode(a): int(b) for a, b in (x.split() for x in raw.splitlines() if x)}, pattern)

    def merge(self, token: bytes) -> list[int]:
        """Ids of one pre-token, by a heap over its linked bytes."""
        ranks, n = self.ranks, len(token)
        if n == 1:
            return [ranks[token]]
        after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(token[i : i + 2])) is not None]
        heapify(heap)
        get = ranks.get
        while heap:
            _, i, to = heappop(heap)
            if end[i] == _FAR or (k := after[i]) >= n or end[k] != to:
                continue  # one of its two parts has been merged since
            end[i], end[k] = to, _FAR
            after[i] = k = after[k]
            if k < n:
                before[k] = i
                if (r := get(token[i : end[k]])) is not None:
                    heappush(heap, (r, i, end[k]))
            if (j := before[i]) >= 0 and (r := get(token[j:to])) is not None:
                heappush(heap, (r, j, to))
        out, i = [], 0
        while i < n:
            out.append(ranks[token[i : end[i]]])
            i = after[i]
        return out

    def _learn(self, pieces: list[str], known: dict[str, bytes], lead: str) -> None:
        """Ids of pieces not met before: their pre-tokens by the perfect hash, the rest by merges."""
        split = [self.find(lead + p) for p in pieces]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = [t for t in {t for s in split for t in s} if t not in self.known]
        raw = [t.encode() for t in new]
        once = {}
        if raw:
            for t, b, at in zip(new, raw, self.hash.index(raw).tolist(), strict=True):
                ids = [self.ranks[b]] if self.tokens[at] == b else self.merge(b)
                (self.known if len(t) <= LONGEST else once)[t] = np.array(ids, "<i4").tobytes()
        for p, s in zip(pieces, split, strict=True):
            known[p] = b"".join([self.known[t] if t in self.known else once[t] for t in s])

    def _through(self, pieces: list[str], known: dict[str, bytes], lead: str) -> bytes:
        try:
            return b"".join(map(known.__getitem__, pieces))
        except KeyError:
            pass
        if len(known) > REMEMBERED:
            known.clear()
        self._learn([p for p in dict.fromkeys(pieces) if p not in known], known, lead)
        out = b"".join(map(known.__getitem__, pieces))
        for p in pieces:
            if len(p) > LONGEST:
                known.pop(p, None)
        return out

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian 32-bit integers. A text is cut before its spaces: no pre-token spans such a cut unless white space comes before the space."""
        if not text:
            return b""
        if self.joined(text):
            return self._through(self.find(text), self.sooner, "")
        first, *rest = text.split(" ")
        return (self._through([first], self.sooner, "") if first else b"") + self._through(rest, self.later, " ")

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.by_id.__getitem__, ids.tolist()))


def _added(df: DataFrame, *fields: T.StructField) -> T.StructType:
    return T.StructType([f for f in df.schema.fields if f.name not in {x.name for x in fields}] + list(fields))


def _with(batch: pa.RecordBatch, schema: T.StructType, new: dict[str, pa.Array]) -> pa.RecordBatch:
    names = [f.name for f in schema.fields]
    return pa.RecordBatch.from_arrays([new[n] if n in new else batch.column(batch.schema.get_field_index(n)) for n in names], names=names)


def encode(df: DataFrame, path: str, pattern: str, column: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """df with array<int> `ids` of its texts, and with the bytes that these ids decode to if `decoded` names a column. Columns of these names are replaced."""
    spark = prepared(df.sparkSession)
    codec = spark.sparkContext.broadcast(Codec.from_file(path, pattern))
    fields = [T.StructField(ids, T.ArrayType(T.IntegerType(), False))] + ([T.StructField(decoded, T.BinaryType())] if decoded else [])
    schema = _added(df, *fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec.value
        for batch in batches:
            got = [own.encode(t) for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]
            flat = np.frombuffer(b"".join(got), "<i4")
            offsets = np.zeros(len(got) + 1, np.int32)
            np.cumsum([len(x) // 4 for x in got], out=offsets[1:])
            new = {ids: pa.ListArray.from_arrays(offsets, pa.array(flat))}
            if decoded:
                new[decoded] = pa.array([own.decode(flat[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary())
            yield _with(batch, schema, new)

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """df with the bytes of its arrays of ids. A null array gives no bytes; an unknown id is an error."""
    codec = prepared(df.sparkSession).sparkContext.broadcast(Codec.from_file(path, pattern))
    schema = _added(df, T.StructField(decoded, T.BinaryType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec.value
        for batch in batches:
            got = batch.column(batch.schema.get_field_index(ids)).to_pylist()
            yield _with(batch, schema, {decoded: pa.array([own.decode(np.array(x or [], "<i4")) for x in got], pa.binary())})

    return df.mapInArrow(run, schema)
