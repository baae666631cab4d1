"""Language ID: multinomial naive Bayes over hashed character n-grams.

Counts of every labelled text are summed by Spark; the matrix of log-probabilities (languages x
bins, at most MAX_LANGUAGES rows) is broadcast, and each Arrow batch is scored in numpy: a sparse
text-by-bin count matrix, held as (text, bin) pairs, times the matrix.

Texts that are null, empty or without a letter are `und` with score 0. Languages with equal
probability: the first by name. A null label isn't learned from. Without any labelled text, or
over an empty table, every text is `und`. Further columns stay; columns named like the results
are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from procurelake.llm import ngrams, text
from procurelake.llm.spark import prepared

SIZES, BITS, SMOOTHING = (1, 2, 3), 16, 0.5
#: The matrix has 2**BITS columns of 4 bytes and at most so many rows (64 MB); more labels are an error.
MAX_LANGUAGES = 256
UNKNOWN = "und"


def counts(df: DataFrame, column: str = "text", label: str = "lang") -> DataFrame:
    """(label, bin, n) of all labelled texts: each task sums its own texts first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[str, np.ndarray] = {}
        for batch in batches:
            for rows, data, offsets in text.blocks(batch):
                names = rows.column(1).to_pylist()
                place = {x: i for i, x in enumerate(dict.fromkeys(names))}
                if len(own.keys() | place.keys()) > MAX_LANGUAGES:
                    raise ValueError(f"more than {MAX_LANGUAGES} languages")
                at = np.array([place[x] for x in names], np.int64) << BITS
                chars, doc, _ = ngrams.characters(data, offsets)
                total = sum(np.bincount(at[d] | b, minlength=len(place) << BITS) for b, d in ngrams.bins(chars, doc, SIZES, BITS))
                for x, i in place.items():
                    own[x] = own.get(x, 0) + total[i << BITS : (i + 1) << BITS]
        for x, n in own.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(some), pa.string()), pa.array(some, pa.int32()), pa.array(n[some], pa.int64())], names=["label", "bin", "n"])

    rows = df.where(F.col(label).isNotNull() & F.col(column).isNotNull()).select(F.col(column).alias("text"), F.col(label).cast("string").alias("lang"))
    return rows.mapInArrow(run, "label string, bin int, n long").groupBy("label", "bin").agg(F.sum("n").alias("n"))


def train(df: DataFrame, column: str = "text", label: str = "lang") -> tuple[list[str], np.ndarray]:
    """(languages, their log-probabilities by bin). The driver gets one row a language: its bins."""
    prepared(df.sparkSession)
    by = counts(df, column, label).groupBy("label").agg(F.sort_array(F.collect_list(F.struct("bin", "n"))).alias("bins"))
    rows = by.select("label", F.col("bins.bin").alias("bin"), F.col("bins.n").alias("n")).limit(MAX_LANGUAGES + 1).toPandas().sort_values("label")
    if len(rows) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    n = np.full((len(rows), 1 << BITS), SMOOTHING)
    for i, (b, c) in enumerate(zip(rows["bin"], rows["n"], strict=True)):
        n[i, np.asarray(b, np.int64)] += np.asarray(c, float)
    return rows["label"].tolist(), np.log(n / n.sum(1, keepdims=True)).astype(np.float32)


def predict(df: DataFrame, model: tuple[list[str], np.ndarray], column: str = "text", label: str = "lang_pred", score: str = "score") -> DataFrame:
    """df with the language of each text and its posterior probability under equal priors."""
    spark = prepared(df.sparkSession)
    names = model[0]
    shared = spark.sparkContext.broadcast(np.ascontiguousarray(model[1]))
    schema = T.StructType([f for f in df.schema.fields if f.name not in (label, score)] + [T.StructField(label, T.StringType()), T.StructField(score, T.DoubleType())])
    kept = [f.name for f in schema.fields[:-2]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = shared.value
        for batch in batches:
            for rows, data, offsets in text.blocks(batch, column):
                chars, doc, n_letters = ngrams.characters(data, offsets)
                total = np.zeros((rows.num_rows, max(1, len(names))))
                for b, d in ngrams.bins(chars, doc, SIZES, BITS):
                    edge = np.searchsorted(d, np.arange(rows.num_rows))
                    for i in range(len(names)):
                        run_to = np.concatenate([[0.0], np.cumsum(matrix[i][b], dtype=np.float64)])
                        total[:, i] += run_to[np.append(edge[1:], len(d))] - run_to[edge]
                best = total.argmax(1)
                odds = np.exp(np.clip(total - total[np.arange(len(best)), best][:, None], -700, 0)).sum(1)
                known = (n_letters > 0) & bool(names)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(rows.schema.get_field_index(c)) for c in kept] + [pa.array([names[i] if k else UNKNOWN for i, k in zip(best.tolist(), known.tolist(), strict=True)], pa.string()), pa.array(np.where(known, 1 / odds, 0.0))],
                    names=[f.name for f in schema.fields],
                )

    return df.mapInArrow(run, schema)


def keep(df: DataFrame, model: tuple[list[str], np.ndarray], least: float = 0.5, column: str = "text") -> DataFrame:
    """The rows of df whose text has a language with a posterior of at least `least`; df's own columns."""
    got = predict(df, model, column, "__lang", "__score")
    return got.where((F.col("__lang") != UNKNOWN) & (F.col("__score") >= least)).select(*[quoted(c) for c in df.columns])


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")
