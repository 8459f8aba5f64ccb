"""Paired and interval statistics on aggregates; the counts come from Spark, the closed forms are expressions."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def wilson(successes: Column, total: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Bounds of the Wilson score interval, null for no trials."""
    n, p = total.cast("double"), F.try_divide(successes.cast("double"), total.cast("double"))
    mid = F.try_divide(p + z * z / (2 * n), 1 + z * z / n)
    half = F.try_divide(z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)), 1 + z * z / n)
    ok = total > 0
    return F.when(ok, F.round(F.greatest(F.lit(0.0), mid - half), 6)), F.when(ok, F.round(F.least(F.lit(1.0), mid + half), 6))


def bernoulli_js(p: Column, q: Column) -> Column:
    """Jensen-Shannon divergence, base 2, of two success rates."""
    m = (p + q) / 2
    term = lambda a, b: F.when(a > 0, a * F.log2(a / b)).otherwise(0.0)
    return F.round((term(p, m) + term(1 - p, 1 - m) + term(q, m) + term(1 - q, 1 - m)) / 2, 6)


def pearson(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Correlation of complete pairs by group, from centred moments that merge; null where a side is constant."""
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    g = d.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.covar_pop("_x", "_y").alias("_c"), F.stddev_pop("_x").alias("_sx"), F.stddev_pop("_y").alias("_sy"))
    return g.select(*by, "n", F.round(F.try_divide("_c", F.col("_sx") * F.col("_sy")), 4).alias("r"))


def paired(left: DataFrame, right: DataFrame, key: str, metric: str, dead: float = 1e-12) -> DataFrame:
    """(n, wins, losses, ties, mean_delta) of right against left over their common keys."""
    d = left.select(key, F.col(metric).alias("_l")).join(right.select(key, F.col(metric).alias("_r")), key).withColumn("_d", F.col("_r") - F.col("_l"))
    return d.agg(F.count("_d").alias("n"), F.count_if(F.col("_d") > dead).alias("wins"), F.count_if(F.col("_d") < -dead).alias("losses"), F.count_if(F.abs("_d") <= dead).alias("ties"), F.round(F.avg("_d"), 6).alias("mean_delta"))


def paired_outcomes(left: DataFrame, right: DataFrame, key: str, ok: str) -> DataFrame:
    """(both, only_left, only_right, neither): the 2 x 2 table of two arms' outcomes over their common keys."""
    d = left.select(key, F.coalesce(ok, F.lit(False)).alias("_l")).join(right.select(key, F.coalesce(ok, F.lit(False)).alias("_r")), key)
    x, y = F.col("_l"), F.col("_r")
    return d.agg(F.count_if(x & y).alias("both"), F.count_if(x & ~y).alias("only_left"), F.count_if(~x & y).alias("only_right"), F.count_if(~x & ~y).alias("neither"))


@F.pandas_udf(T.DoubleType())
def sign_test(wins: pd.Series, losses: pd.Series) -> pd.Series:
    """Two-sided exact sign test; null without any decided pair."""

    def p(w: int, x: int) -> float | None:
        n = int(w) + int(x)
        if n == 0:
            return None
        k = min(int(w), int(x))
        log = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2) for i in range(k + 1)]
        return round(min(1.0, 2 * sum(map(math.exp, log))), 6)

    return pd.Series([p(w, x) for w, x in zip(wins, losses)])


def beta_binomial(trials: int, alpha: float, beta: float) -> list[float]:
    """Probabilities of 0..trials successes."""
    b = lambda x, y: math.lgamma(x) + math.lgamma(y) - math.lgamma(x + y)
    return [math.exp(math.lgamma(trials + 1) - math.lgamma(k + 1) - math.lgamma(trials - k + 1) + b(k + alpha, trials - k + beta) - b(alpha, beta)) for k in range(trials + 1)]


def trials_needed(successes: int, alpha: float, beta: float, target: float, most: int) -> int | None:
    """The fewest trials with at least `successes` successes at the target probability."""
    return next((n for n in range(successes, most + 1) if sum(beta_binomial(n, alpha, beta)[successes:]) >= target), None)


def bootstrap(df: DataFrame, value: str, key: list[str], draws: int = 2_000, seed: int = 11) -> DataFrame:
    """(n, mean, low, high): 95 % interval of the mean by Poisson resampling, one pass and mergeable.

    Each row's weight in a draw is a Poisson(1) variate by its inverse distribution from a hash of the row's key and the
    draw, for a batch at once: the same rows give the same interval however they are parted. `key` tells rows apart.
    """
    import numpy as np

    steps = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
    salts = np.random.default_rng(seed).integers(1, 2**63, draws, dtype=np.uint64) | np.uint64(1)

    def run(batches):
        total, weight, n, s = np.zeros(draws), np.zeros(draws), 0, 0.0
        for b in batches:
            for a in range(0, len(b), 1_000):
                h, v = b["_h"].to_numpy()[a : a + 1_000].astype(np.int64).view(np.uint64), b["_v"].to_numpy()[a : a + 1_000]
                with np.errstate(over="ignore"):
                    u = (h[:, None] ^ salts[None]) * np.uint64(0x9E3779B97F4A7C15)
                    u = (u ^ (u >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
                w = np.searchsorted(steps, (u >> np.uint64(11)).astype(np.float64) / 2.0**53, side="right")
                total += v @ w
                weight += w.sum(0)
                n, s = n + len(v), s + float(v.sum())
        if n:
            yield pd.DataFrame({"draw": np.arange(draws), "t": total, "w": weight, "n": [n] + [0] * (draws - 1), "s": [s] + [0.0] * (draws - 1)})

    d = df.where(F.col(value).isNotNull()).select(F.xxhash64(F.lit(seed), *key).alias("_h"), F.col(value).cast("double").alias("_v"))
    per = d.mapInPandas(run, "draw long, t double, w double, n long, s double").groupBy("draw").agg(F.sum("t").alias("t"), F.sum("w").alias("w"), F.sum("n").alias("n"), F.sum("s").alias("s"))
    m = F.try_divide("t", "w")
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.round(F.try_divide(F.sum("s"), F.sum("n")), 6).alias("mean"), F.round(F.percentile(m, F.lit(0.025)), 4).alias("low"), F.round(F.percentile(m, F.lit(0.975)), 4).alias("high"))


def paired_bootstrap(left: DataFrame, right: DataFrame, key: str, metric: str, draws: int = 2_000, seed: int = 11) -> DataFrame:
    """bootstrap of the right side's gain over the left one, at the grain of their common keys."""
    d = left.select(key, F.col(metric).alias("_a")).join(right.select(key, F.col(metric).alias("_b")), key)
    return bootstrap(d.select(key, (F.col("_b") - F.col("_a")).alias("gain")), "gain", [key], draws, seed)


def timeout_bounds(steps: DataFrame, slowest: str, thresholds: list[float]) -> DataFrame:
    """(threshold, steps, share) of steps whose slowest part exceeds each threshold; thresholds are few and stated."""
    t = F.explode(F.array(*(F.lit(float(x)) for x in thresholds))).alias("threshold")
    e = steps.select(slowest, t)
    return e.groupBy("threshold").agg(F.count_if(F.col(slowest) > F.col("threshold")).alias("steps"), F.round(F.count_if(F.col(slowest) > F.col("threshold")) / F.count(F.lit(1)), 6).alias("share"))


def gates(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, passed) of each rule over one summary row; a null is a failure."""
    arr = F.array(*(F.struct(F.lit(n).alias("rule"), F.coalesce(c, F.lit(False)).alias("passed")) for n, c in rules.items()))
    return df.select(F.inline(arr))
