"""Further analytics: catalogue profiles, weighted ranks, ranges of one series over another, arms, projections, mutants."""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import sql_text
from ..functions.tables import cell_equal, json_tables, rectangle
from .stats import beta_binomial


def catalogue_profile(df: DataFrame, version: str, kinds: list[str]) -> DataFrame:
    """(version, kind, value, n): rows of each value of each column, one pass for all columns; null values count as null."""
    rows = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).cast("string").alias("value")) for k in kinds))
    return df.select(version, F.inline(rows)).groupBy(version, "kind", "value").agg(F.count(F.lit(1)).alias("n"))


def reuse_across(df: DataFrame, key: str, version: str) -> DataFrame:
    """(versions, keys): how many keys occur in how many versions."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.countDistinct(version).alias("versions")).groupBy("versions").agg(F.count(F.lit(1)).alias("keys"))


def weighted_mean(df: DataFrame, value: str, weight: str, by: list[str]) -> DataFrame:
    """Sum of value times weight over sum of weights, over rows with both; null for no weight."""
    d = df.where(F.col(value).isNotNull() & F.col(weight).isNotNull())
    return d.groupBy(*by).agg(F.round(F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(weight)), 6).alias("weighted_mean"), F.max(value).alias("largest"))


def within_range_of(series: DataFrame, ts: str, other: DataFrame, other_ts: str, by: str, measure: str) -> DataFrame:
    """Aggregates of a series inside the time range of another one, whose two bounds are joined as one row."""
    bounds = F.broadcast(other.agg(F.min(other_ts).alias("_lo"), F.max(other_ts).alias("_hi")))  # one row
    d = series.join(bounds, (F.col(ts) >= F.col("_lo")) & (F.col(ts) <= F.col("_hi")))
    return d.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(measure), 6).alias("mean"))


def last_rows(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The last n rows in an order: a distributed top-n, not a global sort."""
    return df.orderBy(*(F.desc(o) for o in order)).limit(n)


def expand_arms(df: DataFrame, arms: dict[str, Column], name: str = "arm", text: str = "text") -> DataFrame:
    """Each row once for each experimental arm, with the arm's text."""
    return df.select("*", F.explode(F.array(*(F.struct(F.lit(k).alias(name), v.alias(text)) for k, v in arms.items()))).alias("_a")).select("*", f"_a.{name}", f"_a.{text}").drop("_a")


def backfilled(df: DataFrame, column: str, right: Column) -> DataFrame:
    """df with a column put right, and whether it was repaired."""
    return df.withColumn("_new", right).withColumn("repaired", ~F.col(column).eqNullSafe(F.col("_new"))).withColumn(column, F.col("_new")).drop("_new")


def previous_month(month: Column) -> Column:
    """'yyyy-MM' one month earlier."""
    return F.date_format(F.add_months(F.to_date(F.concat(month, F.lit("-01"))), -1), "yyyy-MM")


def unknown_as_null(x: Column, unknown: float = -1) -> Column:
    return F.when(x != unknown, x)


def filled_targets(targets: DataFrame, rows: DataFrame, key: str, valid: Column, measure: str) -> DataFrame:
    """(key, n, median, status) of every target; a target without a valid row is kept as missing or invalid."""
    g = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_all"), F.count_if(valid).alias("n"), F.round(F.percentile(F.when(valid, F.col(measure)), F.lit(0.5)), 6).alias("median"))
    return targets.select(key).distinct().join(g, key, "left").withColumn("status", F.when(F.col("_all").isNull(), "missing").when(F.col("n") == 0, "invalid").otherwise("ok")).fillna(0, ["n"]).drop("_all")


def unique_projection(candidate: list[list], expected: list[list], abs_tol: float = 1e-3, rel_tol: float = 1e-5) -> bool:
    """Whether the expected rows are the candidate's under exactly one choice of distinct columns, row by row."""
    if not expected or len(candidate) != len(expected) or any(len(r) != len(candidate[0]) for r in candidate):
        return False
    width = len(expected[0])
    fits = [[c for c in range(len(candidate[0])) if all(cell_equal(g[c], w[k], abs_tol, rel_tol) for g, w in zip(candidate, expected))] for k in range(width)]

    def count(k: int, used: frozenset) -> int:
        return 1 if k == width else sum(count(k + 1, used | {c}) for c in fits[k] if c not in used)

    return count(0, frozenset()) == 1


@F.pandas_udf(T.BooleanType())
def projects(answer: pd.Series, expected_json: pd.Series) -> pd.Series:
    """Whether a JSON table of an answer holds the expected rows under exactly one choice of columns; null without expected rows."""

    def one(a: str | None, e: str | None) -> bool | None:
        try:
            want = rectangle(json.loads(e)) if e else None
        except ValueError:
            want = None
        return None if want is None else any(unique_projection(t, want) for t in json_tables(a or ""))

    return pd.Series([one(a, e) for a, e in zip(answer, expected_json)], dtype="object")


def mutants(df: DataFrame, sql: str) -> DataFrame:
    """Each row once for each fault that applies to its statement: (mutation, mutant)."""

    def run(batches):
        for b in batches:
            rows = [(i, k, m) for i, q in zip(b["_id"], b["_q"]) if q for k in sql_text.MUTATIONS if (m := sql_text.mutate(q, k))]
            if rows:
                yield pd.DataFrame(rows, columns=["_id", "mutation", "mutant"])

    d = df.withColumn("_id", F.xxhash64(sql)).select("_id", F.col(sql).alias("_q")).dropDuplicates(["_id"])
    return d.mapInPandas(run, "_id long, mutation string, mutant string").join(d, "_id").select(F.col("_q").alias("statement"), "mutation", "mutant")


@F.pandas_udf(T.DoubleType())
def success_tail(trials: pd.Series, least: pd.Series, alpha: pd.Series, beta: pd.Series) -> pd.Series:
    """Probability of at least so many successes under a beta-binomial."""
    return pd.Series([round(sum(beta_binomial(int(n), a, b)[int(k) :]), 6) for n, k, a, b in zip(trials, least, alpha, beta)])


def expected_attempts(p: Column, cap: int) -> Column:
    """Mean number of tries until a success, at most cap: the sum of (1-p)^k over k < cap."""
    return F.round(F.when(p > 0, (1 - F.pow(1 - p, F.lit(cap))) / p).otherwise(F.lit(float(cap))), 6)


def capacity(tokens: int, layers: int, heads: int, width: int, bytes_each: int = 2) -> int:
    """Bytes that the keys and values of so many tokens take."""
    return int(math.prod((2, tokens, layers, heads, width, bytes_each)))
