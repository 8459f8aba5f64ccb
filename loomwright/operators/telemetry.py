"""Run telemetry: driver-log lines, key:value metrics, cumulative counters, exposition text and throughput."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ANSI = r"\x1b\[[0-9;]*[A-Za-z]"


def plain_lines(df: DataFrame, line: str = "value") -> DataFrame:
    """df with escape sequences taken out of its lines."""
    return df.withColumn(line, F.regexp_replace(line, _ANSI, ""))


def metric_pairs(line: Column, prefix: str = "") -> Column:
    """ARRAY<STRING> of the `key:number` pairs of a line whose key begins with prefix, in order: one pass over the line."""
    return F.regexp_extract_all(line, F.lit(rf"({prefix}[A-Za-z_][\w/.\-]*\s*:\s*[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)(?![\w:])"), F.lit(1))


def step_metrics(df: DataFrame, line: str, order: str) -> DataFrame:
    """(step, metric, value): the last value of each metric of each step, in line order and then in the line's."""
    d = df.select(order, F.posexplode(metric_pairs(F.col(line))).alias("_p", "_pair"), F.regexp_extract(line, r"\bstep:(\d+)", 1).try_cast("bigint").alias("step")).where("step is not null")
    d = d.select(order, "_p", "step", F.trim(F.substring_index("_pair", ":", 1)).alias("metric"), F.trim(F.substring_index("_pair", ":", -1)).try_cast("double").alias("value"))
    return d.where("metric <> 'step'").groupBy("step", "metric").agg(F.max_by("value", F.struct(order, "_p")).alias("value"))


def last_counters(df: DataFrame, engine: str, ts: str, hits: str, queries: str) -> DataFrame:
    """(engine, hits, queries, hit_rate) from the last reading of cumulative counters; no rate without queries."""
    g = df.groupBy(engine).agg(F.max_by(hits, ts).alias("hits"), F.max_by(queries, ts).alias("queries"))
    return g.withColumn("hit_rate", F.round(F.try_divide("hits", "queries"), 6))


def exposition(df: DataFrame, line: str = "value") -> DataFrame:
    """(name, labels, value) of `name{labels} value` lines; comments and other lines are dropped."""
    p = r"^([A-Za-z_:][\w:]*)(?:\{([^}]*)\})?\s+([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)\s*$"
    d = df.where(F.col(line).rlike(p))
    return d.select(F.regexp_extract(line, p, 1).alias("name"), F.regexp_extract(line, p, 2).alias("labels"), F.regexp_extract(line, p, 3).cast("double").alias("value"))


def throughput(df: DataFrame, start: str, end: str, items: str, tokens: str, by: list[str]) -> DataFrame:
    """Items and tokens an hour over the span from the first start to the last end; null for an empty span."""
    g = df.groupBy(*by).agg(F.sum(items).alias("items"), F.sum(tokens).alias("tokens"), (F.unix_micros(F.max(end)) - F.unix_micros(F.min(start))).alias("_us"))
    h = F.col("_us") / 3.6e9
    return g.select(*by, F.round(F.try_divide(F.col("items"), h), 4).alias("items_per_hour"), F.round(F.try_divide(F.col("tokens"), h), 4).alias("tokens_per_hour"))


def overhead(total: Column, generation: Column, tools: Column) -> Column:
    """What is left of a trajectory's time, at least 0; -1 or null marks an unknown time and gives null."""
    known = (total >= 0) & (generation >= 0) & (tools >= 0)
    return F.when(known, F.round(F.greatest(F.lit(0.0), total - generation - tools), 6))
