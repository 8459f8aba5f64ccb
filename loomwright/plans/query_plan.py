"""Structured query plans as DataFrames.

A plan names a fact, its star or snowflake of dimensions, a half-open date window, filters, a group, a metric, a sample
minimum and a limit; `to_df` declares it and leaves join order, pushdown and pruning to Catalyst. Dimensions are joined
by equality; whether one is broadcast is left to its size. Composite forms (change, share, gap, score) build on the same
base relation, each with one scan of it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import table


def month_window(col: Column, month: str, months: int = 1) -> Column:
    """col in [first day of month, first day `months` later): a range that reaches the Parquet statistics."""
    start = F.lit(f"{month}-01").cast("timestamp")
    return (col >= start) & (col < F.add_months(start.cast("date"), months).cast("timestamp"))


def filled(col: Column) -> Column:
    """Neither null nor blank."""
    return col.isNotNull() & (F.trim(col.cast("string")) != "")


#: The metric catalogue: name -> column over the fact's measures.
METRICS: dict[str, Callable[[str], Column]] = {
    "rows": lambda c: F.count(F.lit(1)).cast("double"),
    "distinct": lambda c: F.countDistinct(c).cast("double"),
    "sum": lambda c: F.round(F.sum(c), 2),
    "mean": lambda c: F.round(F.avg(c), 2),
    "rate": lambda c: F.round(F.lit(100.0) * F.sum(c) / F.count(F.lit(1)), 2),
}


@dataclass(frozen=True)
class Join:
    """One dimension: its table and the equal columns; left columns may come from an earlier dimension."""

    name: str
    left: str
    right: str


@dataclass(frozen=True)
class QueryPlan:
    fact: str
    metric: str
    measure: str = ""
    joins: tuple[Join, ...] = ()
    date: str = ""
    month: str = ""
    months: int = 1
    equal: tuple[tuple[str, object], ...] = ()
    differ: tuple[tuple[str, object], ...] = ()
    within: tuple[tuple[str, tuple], ...] = ()
    group: str = ""
    least_rows: int = 0
    top: int = 0
    derive: tuple[tuple[str, str], ...] = field(default=())

    def base(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        """The joined and filtered rows. Rows whose key finds no dimension, or is null, are dropped (inner joins)."""
        df = table(spark, sf_dir, self.fact)
        for name, sql in self.derive:
            df = df.withColumn(name, F.expr(sql))
        if self.month:
            df = df.where(month_window(F.col(self.date), self.month, self.months))
        for j in self.joins:
            df = df.join(table(spark, sf_dir, j.name), F.col(j.left) == F.col(j.right))
        for c, v in self.equal:
            df = df.where(F.col(c) == F.lit(v))
        for c, v in self.differ:
            df = df.where(F.col(c) != F.lit(v))
        for c, v in self.within:
            df = df.where(F.col(c).isin(*v))
        return df

    def to_df(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        """(value) or (category, value); ties by category; groups below least_rows are left out."""
        df, m = self.base(spark, sf_dir), METRICS[self.metric](self.measure)
        if not self.group:
            return df.agg(m.alias("value"))
        g = df.groupBy(F.col(self.group).alias("category")).agg(m.alias("value"), F.count(F.lit(1)).alias("_n"))
        if self.least_rows:
            g = g.where(F.col("_n") >= self.least_rows)
        g = g.drop("_n")
        return g.orderBy(F.desc_nulls_last("value"), F.asc_nulls_last("category")).limit(self.top) if self.top else g


def period_change(base: DataFrame, category: str, date: str, measure: str, month: str, previous: str, least_rows: int = 1) -> DataFrame:
    """(category, value): percent change of the mean between two months; groups absent from either, or of mean 0, give none."""
    m = F.date_format(date, "yyyy-MM")
    rows = base.where(m.isin(month, previous)).groupBy(F.col(category).alias("category"))
    now, before = (F.avg(F.when(m == x, F.col(measure))) for x in (month, previous))
    count = [F.count(F.when(m == x, F.lit(1))) for x in (month, previous)]
    g = rows.agg(now.alias("now"), before.alias("before"), count[0].alias("n1"), count[1].alias("n0"))
    return g.where((F.col("n1") >= least_rows) & (F.col("n0") >= least_rows) & (F.col("before") != 0)).select("category", F.round((F.col("now") - F.col("before")) * 100.0 / F.col("before"), 2).alias("value"))


def share(base: DataFrame, category: str, part: str, whole: list[str]) -> DataFrame:
    """(category, value): percent that the mean of one measure is of the sum of the means of all."""
    total = sum((F.avg(c) for c in whole[1:]), F.avg(whole[0]))
    return base.groupBy(F.col(category).alias("category")).agg(F.round(F.try_divide(F.avg(part) * 100.0, total), 2).alias("value"))


def baseline_gap(base: DataFrame, category: str, measure: str, least_rows: int = 1) -> DataFrame:
    """(category, value): percent gap of a group's mean to the mean of all rows, which is joined as one row."""
    g = base.groupBy(F.col(category).alias("category")).agg(F.avg(measure).alias("m"), F.count(F.lit(1)).alias("n"))
    overall = F.broadcast(base.agg(F.avg(measure).alias("all")))  # one row
    return g.where(F.col("n") >= least_rows).join(overall).where("all <> 0").select("category", F.round((F.col("m") - F.col("all")) * 100.0 / F.col("all"), 2).alias("value"))


def weighted_score(groups: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(category, value): weighted sum of measures, each divided by its maximum; over groups, which are few.

    A measure whose maximum is 0 or null counts 0.
    """
    all_rows = W.partitionBy()
    parts = [F.lit(w) * F.coalesce(F.try_divide(F.col(c).cast("double"), F.max(F.col(c).cast("double")).over(all_rows)), F.lit(0.0)) for c, w in weights.items()]
    return groups.select("category", F.round(sum(parts[1:], parts[0]) * 100.0, 2).alias("value"))


def instruction(plan: QueryPlan) -> str:
    """The plan in words, from the same fields that build its DataFrame, so the two can't drift apart."""
    bits = [f"{plan.metric} of {plan.measure or 'rows'} in {plan.fact}"]
    if plan.month:
        bits.append(f"for {plan.months} month(s) from {plan.month}")
    bits += [f"with {c} equal to {v}" for c, v in plan.equal] + [f"with {c} other than {v}" for c, v in plan.differ]
    if plan.group:
        bits.append(f"by {plan.group}" + (f", top {plan.top}" if plan.top else "") + (f", at least {plan.least_rows} rows" if plan.least_rows else ""))
    return ", ".join(bits)
