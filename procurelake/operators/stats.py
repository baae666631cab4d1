"""Regressions with absorbed fixed effects, as Spark aggregates with a small solve on the driver."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procurelake.operators.session import settled


def group_means(df: DataFrame, by: list[str], outcome: str) -> DataFrame:
    """A regression on dummies without other terms: the mean of each group."""
    return df.where(F.col(outcome).isNotNull()).groupBy(*by).agg(F.avg(outcome).alias("estimate"), F.count(outcome).alias("n"))


def fixed_effects(df: DataFrame, outcome: str, time: str, base: int, effects: list[str], cluster: str, rounds: int = 50, tolerance: float = 1e-10) -> list[dict]:
    """Coefficients of an outcome on dummies of `time` (without `base`), effects absorbed, errors clustered.

    Effects are absorbed by turns of demeaning until sums of squares settle: means of groups are partial sums before
    the shuffle, joined back, so that an effect of few groups doesn't send all rows to few tasks. The driver gets the
    cross products of the dummies (their number squared) only. Errors have the factors g / (g - 1) and
    (n - 1) / (n - k) for g clusters, n rows and k dummies. Groups of one row stay: they add nothing."""
    rows = df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (outcome, time, *effects, cluster)]))
    levels = sorted(r[0] for r in rows.select(time).distinct().collect() if r[0] != base)
    names = [f"__x{i}" for i in range(len(levels))]
    data = settled(rows.select(*[F.col(c).alias(f"__f{i}") for i, c in enumerate(effects)], F.col(cluster).alias("__c"), F.col(outcome).cast("double").alias("__y"), *[(F.col(time) == v).cast("double").alias(n) for v, n in zip(levels, names)]))
    columns, last = ["__y", *names], None
    for _ in range(rounds if len(effects) > 1 else 1):
        for i in range(len(effects)):
            means = data.groupBy(f"__f{i}").agg(*[F.avg(c).alias(f"m{c}") for c in columns])
            data = data.join(means, f"__f{i}").withColumns({c: F.col(c) - F.col(f"m{c}") for c in columns}).drop(*[f"m{c}" for c in columns])
        data = settled(data)
        now = np.array(data.agg(*[F.sum(F.col(c) * F.col(c)) for c in columns]).first(), float)
        if last is not None and np.all(np.abs(now - last) <= tolerance * (1 + np.abs(last))):
            break
        last = now
    k = len(names)
    pairs = [F.sum(F.col(a) * F.col(b)) for a in names for b in [*names, "__y"]]
    got = np.array(data.agg(*pairs, F.count(F.lit(1))).first(), float)
    xx = got[:-1].reshape(k, k + 1)
    inverse, n = np.linalg.pinv(xx[:, :k]), got[-1]
    beta = inverse @ xx[:, k]
    residual = F.col("__y") - reduce(lambda a, b: a + b, [F.lit(float(v)) * F.col(c) for v, c in zip(beta, names)])
    scores = data.groupBy("__c").agg(*[F.sum(F.col(c) * residual).alias(c) for c in names])
    meat = np.array(scores.agg(*[F.sum(F.col(a) * F.col(b)) for a in names for b in names], F.count(F.lit(1))).first(), float)
    g = meat[-1]
    cov = inverse @ meat[:-1].reshape(k, k) @ inverse * (g / max(1, g - 1)) * ((n - 1) / max(1, n - k))
    return [{"time": v, "estimate": float(b), "error": float(np.sqrt(max(0, cov[i, i]))), "n": int(n)} for i, (v, b) in enumerate(zip(levels, beta))]


def studies(df: DataFrame, outcomes: list[str], time: str, base: int, effects: list[str], cluster: str, split: str | None = None) -> DataFrame:
    """(outcome, split, time, estimate, error, n): `fixed_effects` for each outcome, apart for each value of `split` (few)."""
    rows = []
    values = sorted(r[0] for r in df.where(F.col(split).isNotNull()).select(split).distinct().collect()) if split else [None]
    for v in values:
        own = settled(df.where(F.col(split) == v) if split else df)
        for y in outcomes:
            rows += [(y, None if v is None else str(v), c["time"], c["estimate"], c["error"], c["n"]) for c in fixed_effects(own, y, time, base, effects, cluster)]
    return df.sparkSession.createDataFrame(rows, "outcome string, split string, time int, estimate double, error double, n long")


def correlation(df: DataFrame, a: str, b: str):
    """Pearson's correlation of rows with both values; null for fewer than two."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    return both.agg(F.when(F.count(F.lit(1)) >= 2, F.corr(a, b)).alias("r"))
