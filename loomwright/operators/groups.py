"""Group analytics: buckets, gates, advantages, transitions, histograms and percentiles.

All are one hash aggregation, or one window over a group; null keys form a group of their own as in SQL, and null
measures are skipped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def histogram(df: DataFrame, key: str, name: str = "n") -> DataFrame:
    """Rows of each key."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias(name))


def bucket(correct: Column, completed: Column, timed_out: Column | None = None, errors: Column | None = None) -> Column:
    """runtime_error, then timed_out, then all_wrong, all_correct or mixed."""
    c = F.when(errors > 0, "runtime_error") if errors is not None else None
    if timed_out is not None:
        c = c.when(timed_out > 0, "timed_out") if c is not None else F.when(timed_out > 0, "timed_out")
    c = c.when(correct == 0, "all_wrong") if c is not None else F.when(correct == 0, "all_wrong")
    return c.when(correct >= completed, "all_correct").otherwise("mixed")


def task_buckets(samples: DataFrame, task: str, correct: str, timeout: str, error: str, strict: bool = False) -> DataFrame:
    """Counts of each task's samples and its bucket; strict: only errors block, time-outs are wrong samples."""
    g = samples.groupBy(task).agg(
        F.count(F.lit(1)).alias("samples"), F.sum(F.col(correct).cast("bigint")).alias("correct"), F.sum(F.coalesce(F.col(timeout), F.lit(False)).cast("bigint")).alias("timeouts"), F.sum(F.coalesce(F.col(error), F.lit(False)).cast("bigint")).alias("errors"),
    )
    return g.withColumn("bucket", bucket(F.col("correct"), F.col("samples"), None if strict else F.col("timeouts"), F.col("errors")))


def margins(df: DataFrame, group: list[str], correct: str, reward: str) -> DataFrame:
    """Per group: size, correct ones, least correct minus greatest wrong reward, reward range, strictly ranked or not."""
    low, high = F.min(F.when(F.col(correct), F.col(reward))), F.max(F.when(~F.col(correct), F.col(reward)))
    g = df.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(correct).cast("bigint")).alias("correct"), F.round(low - high, 6).alias("margin"), F.round(F.max(reward) - F.min(reward), 6).alias("reward_range"))
    return g.withColumn("mixed", (F.col("correct") > 0) & (F.col("correct") < F.col("n"))).withColumn("ranked", F.coalesce(F.col("margin") > 0, F.lit(False)))


def group_gate(df: DataFrame, uid: str, correct: str, eligible: str, version: str, size: int) -> DataFrame:
    """One row a group: why it is inactive, or active. Any ineligible sample, mixed versions or a wrong size void it."""
    g = df.groupBy(uid).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.col(eligible).cast("int")).alias("all_eligible"), F.countDistinct(version).alias("versions"), F.min(F.col(correct).cast("int")).alias("low"), F.max(F.col(correct).cast("int")).alias("high"),
    )
    state = F.when(F.col("n") != size, "wrong_size").when(F.coalesce("all_eligible", F.lit(0)) == 0, "ineligible").when(F.col("versions") != 1, "mixed_versions").when(F.col("low") == F.col("high"), "no_contrast").otherwise("active")
    return g.select(uid, "n", state.alias("state"))


def row_mask(df: DataFrame, uid: str, gate: DataFrame) -> DataFrame:
    """df with mask 1.0 for the rows of active groups."""
    return df.join(gate.where("state = 'active'").select(uid, F.lit(1.0).alias("mask")), uid, "left").fillna(0.0, ["mask"])


def advantages(df: DataFrame, group: str, reward: str, name: str = "advantage") -> DataFrame:
    """(reward - mean) / population deviation in the group; 0 where the deviation is 0."""
    w = W.partitionBy(group)
    sd = F.stddev_pop(reward).over(w)
    return df.withColumn(name, F.when(sd > 1e-12, F.round((F.col(reward) - F.avg(reward).over(w)) / sd, 6)).otherwise(F.lit(0.0)))


def advantage_audit(df: DataFrame, group: str, correct: str, advantage: str) -> DataFrame:
    """Wrong rows of mixed groups by the sign of their advantage."""
    w = W.partitionBy(group)
    c = F.col(correct).cast("int")
    mixed = df.withColumn("_m", F.min(c).over(w) < F.max(c).over(w)).where(F.col("_m") & (c == 0))
    sign = F.when(F.col(advantage) > 0, "positive").when(F.col(advantage) < 0, "negative").otherwise("zero")
    return mixed.groupBy(sign.alias("sign")).agg(F.count(F.lit(1)).alias("n"))


def exposure(df: DataFrame, key: str, order: list[str], name: str = "exposure") -> DataFrame:
    """Running number of a key's occurrences in the given order."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(key).orderBy(*order)))


def edge_windows(df: DataFrame, step: str, measure: str, width: int) -> DataFrame:
    """(edge, n, mean, positive): the first and the last `width` distinct steps; steps are ranked among themselves only."""
    steps = df.select(step).distinct()
    up, down = F.row_number().over(W.orderBy(F.asc(step))), F.row_number().over(W.orderBy(F.desc(step)))
    ranked = steps.withColumn("up", up).withColumn("down", down)  # one row a step
    edge = F.array_compact(F.array(F.when(F.col("up") <= width, F.lit("first")), F.when(F.col("down") <= width, F.lit("last"))))
    at = ranked.select(step, F.explode(edge).alias("edge"))
    return df.join(F.broadcast(at), step).groupBy("edge").agg(F.count(measure).alias("n"), F.round(F.avg(measure), 6).alias("mean"), F.count_if(F.col(measure) > 0).alias("positive"))


def bins(df: DataFrame, step: str, width: int, measure: str) -> DataFrame:
    """(bin, n, mean) of a measure over equal runs of steps counted from 1."""
    return df.groupBy(F.floor((F.col(step) - 1) / width).cast("bigint").alias("bin")).agg(F.count(measure).alias("n"), F.round(F.avg(measure), 6).alias("mean"))


def describe(df: DataFrame, measure: str, by: list[str] | None = None) -> DataFrame:
    """n, min, mean, median, p25, p75, p90, p95, max and population deviation of the finite values."""
    x = F.col(measure).cast("double")
    fin = df.where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    q = lambda p: F.round(F.percentile(x, F.lit(p)), 6)
    aggs = [F.count(x).alias("n"), F.min(x).alias("min"), F.round(F.avg(x), 6).alias("mean"), q(0.5).alias("median"), q(0.25).alias("p25"), q(0.75).alias("p75"), q(0.9).alias("p90"), q(0.95).alias("p95"), F.max(x).alias("max"), F.round(F.coalesce(F.stddev_pop(x), F.lit(0.0)), 6).alias("std")]
    return fin.groupBy(*(by or [])).agg(*aggs)


def nearest_rank(df: DataFrame, measure: str, points: list[float], by: list[str]) -> DataFrame:
    """Nearest-rank percentiles p<100*point> from the histogram of values, which merges over parts."""
    h = df.where(F.col(measure).isNotNull()).groupBy(*by, measure).agg(F.count(F.lit(1)).alias("_n"))
    cum = F.sum("_n").over(W.partitionBy(*by).orderBy(measure).rowsBetween(W.unboundedPreceding, 0))
    total = F.sum("_n").over(W.partitionBy(*by))
    c = h.withColumn("_c", cum).withColumn("_t", total)
    return c.groupBy(*by).agg(F.max("_t").alias("n"), *(F.min(F.when(F.col("_c") >= F.ceil(F.lit(p) * F.col("_t")), F.col(measure))).alias(f"p{round(p * 100)}") for p in points))


def transitions(left: DataFrame, right: DataFrame, key: str, label: str) -> DataFrame:
    """(left_label, right_label, n) over the keys that both sides have."""
    r = right.select(key, F.col(label).alias("right_label"))
    return left.select(key, F.col(label).alias("left_label")).join(r, key).groupBy("left_label", "right_label").agg(F.count(F.lit(1)).alias("n"))


def zero_filled(df: DataFrame, value: str, top: int) -> DataFrame:
    """(value, n) for every value 0..top, with 0 where there is none."""
    spark = df.sparkSession
    h = df.groupBy(F.col(value).cast("bigint").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return spark.range(top + 1).select(F.col("id").alias("value")).join(h, "value", "left").fillna(0, ["n"])


def confusion(df: DataFrame, auto: str, human: str, states: list[str]) -> DataFrame:
    """One row an automatic state: counts of each human state."""
    return df.groupBy(F.col(auto).alias("auto_state")).agg(*(F.count_if(F.col(human) == s).alias(f"human_{s.lower()}") for s in states))


def agreement(df: DataFrame, auto: str, human: str) -> DataFrame:
    """One row: precision and recall of an automatic PASS against a human one, and the share of automatic UNKNOWN."""
    a, h = F.col(auto), F.col(human)
    n = lambda c: F.count_if(c)
    both = n((a == "PASS") & (h == "PASS"))
    return df.agg(F.count(F.lit(1)).alias("n"), F.round(F.try_divide(both, n(a == "PASS")), 6).alias("precision"), F.round(F.try_divide(both, n((h == "PASS") & (a != "UNKNOWN"))), 6).alias("recall"), F.round(F.try_divide(n(a == "UNKNOWN"), F.count(F.lit(1))), 6).alias("unknown_rate"))


def set_transition(universe: DataFrame, before: DataFrame, after: DataFrame, key: str, by: str) -> DataFrame:
    """(by, retained, lost, gained, neither) of a universe's keys in two sets."""
    b, a = before.select(key).distinct().withColumn("_b", F.lit(1)), after.select(key).distinct().withColumn("_a", F.lit(1))
    j = universe.join(b, key, "left").join(a, key, "left")
    hb, ha = F.col("_b").isNotNull(), F.col("_a").isNotNull()
    return j.groupBy(by).agg(F.count_if(hb & ha).alias("retained"), F.count_if(hb & ~ha).alias("lost"), F.count_if(~hb & ha).alias("gained"), F.count_if(~hb & ~ha).alias("neither"))


def conflicts(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys that carry more than one value."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.countDistinct(value).alias("n_values")).where("n_values > 1")


def duplicate_pairs(df: DataFrame, group: str, item: str) -> DataFrame:
    """Per group: items, distinct ones and the share of equal pairs, from counts and never from pairs."""
    c = df.groupBy(group, item).agg(F.count(F.lit(1)).alias("_c"))
    g = c.groupBy(group).agg(F.sum("_c").alias("n"), F.count(F.lit(1)).alias("n_distinct"), F.sum(F.col("_c") * (F.col("_c") - 1) / 2).alias("_p"))
    return g.select(group, "n", "n_distinct", F.round(F.coalesce(F.try_divide("_p", F.col("n") * (F.col("n") - 1) / 2), F.lit(0.0)), 6).alias("duplicate_share"))


def merged_counts(parts: list[DataFrame], key: str, value: str) -> DataFrame:
    """Sum of partial histograms."""
    out = parts[0].select(key, value)
    for p in parts[1:]:
        out = out.unionByName(p.select(key, value))
    return out.groupBy(key).agg(F.sum(value).cast("bigint").alias(value))
