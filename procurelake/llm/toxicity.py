"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

0. Sample: at most SAMPLE labels, those with the smallest hash of the id, are broadcast to the texts.
1. Log-count ratios: for every hashed n-gram, in how many toxic and in how many other texts of the
   sample it occurs, summed by Spark.
2. Features: the FEATURES n-grams that depend most on the label (by the likelihood-ratio statistic),
   present or not, scaled by the ratio.
3. Weights: logistic regression by gradient steps on the driver, which gets only the sample's features.
4. Scores: table and weights are broadcast (4 * 2**BITS bytes); texts are scored in numpy.

A null or empty text has no feature and gets the score of an empty text. Labels other than 0 and
1, and null labels, aren't learned from; with one class only, or no labels, scores are the share
of toxic labels (0 without any). Repeated rows count as often as they occur. Further columns
stay; columns named like the results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from procurelake.llm import ngrams, text
from procurelake.llm.spark import prepared

SIZES, BITS, FEATURES = (4, 5, 6), 20, 4096
#: Labels that the model is fitted on, at most; tasks that count their n-grams; least ratio of a feature.
SAMPLE, TASKS, LEAST_RATIO = 20_000, 8, 0.7
THRESHOLD = 0.3


def _present(data: np.ndarray, offsets: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, bin) of each n-gram that occurs in a text, once a text; only of bins that are wanted."""
    chars, doc, _ = ngrams.characters(data, offsets)
    keys = []
    for b, d in ngrams.bins(chars, doc, SIZES, BITS):
        if wanted is not None:
            some = np.flatnonzero(wanted[b])
            b, d = b[some], d[some]
        keys.append(d.astype(np.int64) << BITS | b)
    both = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
    return both >> BITS, both & ((1 << BITS) - 1)


def ratios(df: DataFrame) -> tuple[np.ndarray, np.ndarray, int, int]:
    """(bins, log-count ratios) of the n-grams that tell most, and how many labelled texts are toxic and how many are not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, rows_of = np.zeros((2, 1 << BITS), np.int64), np.zeros(2, np.int64)
        for batch in batches:
            for rows, data, offsets in text.blocks(batch):
                toxic = np.asarray(rows.column(1), np.int64)
                rows_of += np.bincount(toxic, minlength=2)
                doc, b = _present(data, offsets)
                n += np.bincount(toxic[doc] << BITS | b, minlength=2 << BITS).reshape(2, -1)
        some = np.flatnonzero(n.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1), pa.int32()), pa.array(np.append(n[1][some], rows_of[1])), pa.array(np.append(n[0][some], rows_of[0]))], names=["bin", "toxic", "other"])

    by = df.select("text", "toxic").mapInArrow(run, "bin int, toxic long, other long").groupBy("bin").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    got = by.toPandas()  # one row a bin, 2**BITS + 1 at most
    total = got[got["bin"] < 0]
    p, q = (int(total[k].sum()) for k in ("toxic", "other"))
    got = got[got["bin"] >= 0].sort_values("bin")
    if not p or not q:
        return np.zeros(0, np.int64), np.zeros(0), p, q
    a, b = got["toxic"].to_numpy(float), got["other"].to_numpy(float)
    r = np.log((a + 0.5) / (p + 1)) - np.log((b + 0.5) / (q + 1))
    part = lambda x: x * np.log(np.maximum(x, 1e-9))
    tells = (part(a) + part(b) + part(p - a) + part(q - b) - part(a + b) - part(p + q - a - b)) + part(p + q) - part(p) - part(q)
    tells *= a + b >= 2
    best = np.lexsort((got["bin"], -tells))[:FEATURES]
    best = best[(tells[best] > 1e-6) & (np.abs(r[best]) >= LEAST_RATIO)]
    return got["bin"].to_numpy(np.int64)[best], r[best], p, q


def _features(spark, df: DataFrame, wanted: np.ndarray) -> list[tuple[int, np.ndarray]]:
    shared = spark.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in text.blocks(batch):
                doc, b = _present(data, offsets, shared.value > 0)
                lists = np.split(shared.value[b] - 1, np.searchsorted(doc, np.arange(1, rows.num_rows)))
                yield pa.RecordBatch.from_arrays([rows.column(1), pa.array([x.astype("<i2").tobytes() for x in lists], pa.binary())], names=["toxic", "own"])

    return [(r.toxic, np.frombuffer(r.own, "<i2")) for r in df.select("text", "toxic").mapInArrow(run, "toxic int, own binary").collect()]


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", column: str = "text", label: str = "toxic") -> tuple[np.ndarray, float]:
    """(weight of each bin, bias) from the texts of docs that labels give 0 or 1."""
    spark = prepared(docs.sparkSession)
    sample = labels.where(F.col(label).isin(0, 1)).select(F.col(key).alias("__id"), F.col(label).cast("int").alias("toxic")).orderBy(F.xxhash64("__id"), "__id", "toxic").limit(SAMPLE)
    texts = docs.select(F.col(key).alias("__id"), F.coalesce(F.col(column), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(sample), "__id").select("text", "toxic").repartition(TASKS)
    bins, r, p, q = ratios(rows)
    weights = np.zeros(1 << BITS, np.float32)
    if not p or not q:
        return weights, float(np.log((p + 1e-9) / (q + 1e-9))) if p + q else -50.0
    place = np.zeros(1 << BITS, np.int16)
    place[bins] = np.arange(1, len(bins) + 1)
    sample = _features(spark, rows, place)
    y = np.array([t for t, _ in sample], float)
    at = np.repeat(np.arange(len(sample)), [len(x) for _, x in sample])
    f = np.concatenate([x for _, x in sample]).astype(np.int64) if sample else np.zeros(0, np.int64)
    if y.min(initial=1) == y.max(initial=0):
        return weights, float(np.log(p / q))
    w, bias, step = np.zeros(len(bins)), float(np.log(p / q)), np.zeros(len(bins) + 1)
    value = r / np.abs(r).max()
    for _ in range(300):
        z = np.bincount(at, (w * value)[f], minlength=len(y)) + bias
        g = 1 / (1 + np.exp(-np.clip(z, -50, 50))) - y
        grad = np.append(np.bincount(f, g[at], minlength=len(w)) * value + 0.01 * w, g.sum()) / len(y)
        step = 0.9 * step - 4.0 * grad / (1 + np.abs(grad).max())
        w += step[:-1]
        bias += step[-1]
    weights[bins] = w * value
    return weights, bias


def score(df: DataFrame, model: tuple[np.ndarray, float], column: str = "text", name: str = "score") -> DataFrame:
    """df with the probability that each text is toxic."""
    shared = prepared(df.sparkSession).sparkContext.broadcast(model)
    schema = T.StructType([f for f in df.schema.fields if f.name != name] + [T.StructField(name, T.DoubleType())])
    kept = [f.name for f in schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        wanted = weights != 0
        for batch in batches:
            for rows, data, offsets in text.blocks(batch, column):
                doc, b = _present(data, offsets, wanted)
                z = np.bincount(doc, weights[b].astype(float), minlength=rows.num_rows) + bias
                yield pa.RecordBatch.from_arrays([rows.column(rows.schema.get_field_index(c)) for c in kept] + [pa.array(1 / (1 + np.exp(-np.clip(z, -50, 50))))], names=[f.name for f in schema.fields])

    return df.mapInArrow(run, schema)
