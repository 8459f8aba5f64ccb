"""Runs and their records: directories, driver logs, admission windows, schedules, contracts checked against statements.

Empty inputs give empty results. What must be sequential (greedy balancing over hosts) runs on a few summary rows.
"""

from __future__ import annotations

import ast
import base64
import operator
import os
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from .telemetry import plain_lines


# fixed value: the public split pattern of byte-level vocabularies
_SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(1)
def _encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("file", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})


def run_summary(contract: DataFrame, rows: DataFrame, log: DataFrame, markers: DataFrame, run: str = "run_id") -> DataFrame:
    """(run_id, expected, rows, errors, log_lines, error_lines, finished): a run directory's parts side by side.

    contract: run_id, expected; rows: run_id, failed; log: run_id, value; markers: run_id, name. A run that only has some
    parts is kept; parts without a contract are not.
    """
    r = rows.groupBy(run).agg(F.count(F.lit(1)).alias("rows"), F.count_if("failed").alias("errors"))
    g = log.groupBy(run).agg(F.count(F.lit(1)).alias("log_lines"), F.count_if(F.col("value").rlike(r"(?i)\berror\b|traceback")).alias("error_lines"))
    m = markers.where("name = 'DONE'").select(run).distinct().withColumn("finished", F.lit(True))
    d = contract.join(r, run, "left").join(g, run, "left").join(m, run, "left")
    return d.fillna(0, ["rows", "errors", "log_lines", "error_lines"]).fillna(False, ["finished"])


def driver_stages(df: DataFrame, line: str, order: str) -> DataFrame:
    """(step, stage, seconds): `stage NAME took N s` lines of a driver log, each under the last step line before it.

    Steps are found by a window in line order within each log (`log` column).
    """
    d = plain_lines(df, line)
    d = d.withColumn("_step", F.regexp_extract(line, r"\bstep[:= ]+(\d+)", 1).try_cast("bigint"))
    d = d.withColumn("step", F.last("_step", ignorenulls=True).over(W.partitionBy("log").orderBy(order).rowsBetween(W.unboundedPreceding, 0)))
    p = r"\bstage[:= ]+([\w.-]+) took ([0-9]+(?:\.[0-9]+)?) ?s"
    return d.where(F.col(line).rlike(p)).select("log", "step", F.regexp_extract(line, p, 1).alias("stage"), F.regexp_extract(line, p, 2).cast("double").alias("seconds"))


def steady(df: DataFrame, first_step: int = 2) -> DataFrame:
    """(log, stage, steps, seconds, share): totals of the steps from `first_step` on, and each stage's share of its log."""
    g = df.where(F.col("step") >= first_step).groupBy("log", "stage").agg(F.countDistinct("step").alias("steps"), F.round(F.sum("seconds"), 6).alias("seconds"))
    return g.withColumn("share", F.round(F.try_divide("seconds", F.sum("seconds").over(W.partitionBy("log"))), 6))


def gold_once(df: DataFrame, statement: str, value: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """df with what `value` makes of each distinct statement, computed once a statement: value takes and keeps `statement`."""
    one = df.where(F.col(statement).isNotNull()).select(statement).distinct()
    return df.join(value(one), statement, "left")


def self_consistent(df: DataFrame, statement: str, value: str) -> DataFrame:
    """(statement_sha256, rows, values, consistent) of each statement: all its records must expect one value, and none be empty."""
    v = F.regexp_replace(F.col(value), r"\s+", "")
    g = df.where(F.col(statement).isNotNull()).groupBy(F.sha2(statement, 256).alias("statement_sha256"))
    return g.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(v).alias("values"), F.count_if(v.isNull() | (v == "")).alias("_e")).withColumn("consistent", (F.col("values") == 1) & (F.col("_e") == 0)).drop("_e")


def plan_checks(question: Column, sql: Column) -> Column:
    """ARRAY<STRUCT<name, required, aligned>>: what a question asks of a statement's plan, and whether the statement has it."""
    q, s = F.lower(F.coalesce(question, F.lit(""))), F.lower(F.regexp_replace(F.coalesce(sql, F.lit("")), r"\s+", " "))
    # fixed values: the checks
    checks = {
        "group": (q.rlike(r"分组|\bper [a-z]|group"), F.contains(s, F.lit("group by"))),
        "top": (q.rlike(r"最高的前|前几|\btop\b"), F.contains(s, F.lit(" limit "))),
        "least_rows": (q.rlike(r"每组|rows"), F.contains(s, F.lit("having"))),
        "distinct": (q.rlike(r"去重|不重复|distinct"), F.contains(s, F.lit("distinct"))),
    }
    return F.array(*(F.struct(F.lit(n).alias("name"), a.alias("required"), b.alias("aligned")) for n, (a, b) in checks.items()))


def consistency(checks: Column) -> Column:
    """Reasons in both directions, joined by commas: asked but not done, done but not asked."""
    return F.array_join(F.array_compact(F.transform(checks, lambda c: F.when(c["required"] & ~c["aligned"], F.concat(F.lit("missing_"), c["name"])).when(~c["required"] & c["aligned"], F.concat(F.lit("unasked_"), c["name"])))), ",")


def dataset_audit(df: DataFrame, key: str, level: str, texts: str) -> DataFrame:
    """One row: rows, repeated keys, repeated texts, levels, the smallest and largest level, and whether levels are balanced (within a tenth)."""
    per = df.where(F.col(level).isNotNull()).groupBy(level).agg(F.count(F.lit(1)).alias("n"))
    lv = per.agg(F.count(F.lit(1)).alias("levels"), F.min("n").alias("least"), F.max("n").alias("most"))
    k = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count_if(F.col("n") > 1).alias("repeated_keys"))
    t = df.where(F.col(texts).isNotNull()).groupBy(F.xxhash64(texts), texts).agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1).alias("repeated_texts"))
    return k.crossJoin(t).crossJoin(lv).withColumn("balanced", F.coalesce(F.col("most") - F.col("least") <= 0.1 * F.col("most"), F.lit(False)))  # one row each


_OPS = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.USub: operator.neg, ast.UAdd: operator.pos}
_CALLS = {"abs": abs, "round": round, "min": min, "max": max, "sum": lambda *x: sum(x), "float": float, "int": int}


def restricted(expression: str, values: dict[str, float]) -> float | None:
    """The value of an arithmetic expression over named numbers; None for anything else. Nothing is executed."""

    def walk(n: ast.AST) -> float:
        if isinstance(n, ast.Expression):
            return walk(n.body)
        if isinstance(n, ast.Constant) and type(n.value) in (int, float):
            return n.value
        if isinstance(n, ast.Name):
            return values[n.id]
        if isinstance(n, ast.BinOp) and type(n.op) in _OPS:
            return _OPS[type(n.op)](walk(n.left), walk(n.right))
        if isinstance(n, ast.UnaryOp) and type(n.op) in _OPS:
            return _OPS[type(n.op)](walk(n.operand))
        if isinstance(n, ast.Call) and isinstance(n.func, ast.Name) and n.func.id in _CALLS and not n.keywords:
            return _CALLS[n.func.id](*map(walk, n.args))
        raise ValueError

    try:
        return float(walk(ast.parse(expression, mode="eval")))
    except (ValueError, KeyError, SyntaxError, ZeroDivisionError, TypeError, OverflowError, RecursionError):
        return None


@F.pandas_udf(T.DoubleType())
def replayed(expression: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
    """`restricted` over two values named x and y; each distinct row of a batch once."""
    rows = list(zip(expression, x, y))
    done = {r: restricted(r[0], {"x": r[1], "y": r[2]}) if r[0] else None for r in set(rows)}
    return pd.Series([done[r] for r in rows], dtype="float64")


def balanced(spark: SparkSession, arms: list[tuple[str, int]], hosts: dict[str, int]) -> DataFrame:
    """(arm, weight, host): arms by falling weight to the host with most room left; an arm that fits nowhere has none. Arms are few."""
    room, out = dict(hosts), []
    for arm, weight in sorted(arms, key=lambda a: (-a[1], a[0])):
        best = max(room, key=lambda h: (room[h], h), default=None)
        ok = best is not None and room[best] >= weight
        if ok:
            room[best] -= weight
        out.append((arm, weight, best if ok else None))
    return spark.createDataFrame(out, "arm string, weight long, host string")


def schedule(sources: list[DataFrame], key: str, version: str, sealed: int, times: int, seed: str) -> tuple[DataFrame, DataFrame]:
    """(sealed, schedule): the union of disjoint sources; the first `sealed` keys of each version by hash are held back, the
    rest is scheduled `times` times, each exposure in an order of its own (order_key)."""
    u = sources[0]
    for d in sources[1:]:
        u = u.unionByName(d)
    u = u.where(F.col(key).isNotNull()).dropDuplicates([key])
    r = u.withColumn("_n", F.row_number().over(W.partitionBy(version).orderBy(F.sha2(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")), 256))))
    held = r.where(F.col("_n") <= sealed).drop("_n")
    e = r.where(F.col("_n") > sealed).drop("_n").withColumn("exposure", F.explode(F.sequence(F.lit(1), F.lit(times))))
    return held, e.withColumn("order_key", F.sha2(F.concat_ws(":", F.lit(seed), F.col("exposure").cast("string"), F.col(key).cast("string")), 256))


def admissions(df: DataFrame, shard: str, order: str, done: str, window: int) -> DataFrame:
    """df with admitted_after and flushed_at: with `window` tasks of a shard in flight, a task enters when as many have left
    (the running largest end of the one `window` places before it), and results leave in order, when all before them are done."""
    by = W.partitionBy(shard).orderBy(order)
    end = F.max(done).over(by.rowsBetween(W.unboundedPreceding, 0))
    d = df.withColumn("flushed_at", end)
    return d.withColumn("admitted_after", F.lag(done, window).over(by))


def frozen_status(before: DataFrame, after: DataFrame, key: str, rank: str) -> DataFrame:
    """(status, n) of frozen positions after a change: lost, top, better, worse or same, by their rank (1 is best)."""
    d = before.select(key, F.col(rank).alias("_a")).join(after.select(key, F.col(rank).alias("_b")), key, "left")
    s = F.when(F.col("_b").isNull(), "lost").when(F.col("_b") == 1, "top").when(F.col("_b") < F.col("_a"), "better").when(F.col("_b") > F.col("_a"), "worse").otherwise("same")
    return d.groupBy(s.alias("status")).agg(F.count(F.lit(1)).alias("n"))


def guarded(base: DataFrame, trial: DataFrame, key: str, role: str, score: str) -> DataFrame:
    """(role, n, rescued, broken, mean_base, mean_trial, passed) over fixed keys: rescued rise from 0, broken fall to 0."""
    d = base.select(key, role, F.col(score).alias("_a")).join(trial.select(key, F.col(score).alias("_b")), key)
    g = d.groupBy(role).agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("_a") == 0) & (F.col("_b") > 0)).alias("rescued"), F.count_if((F.col("_a") > 0) & (F.col("_b") == 0)).alias("broken"), F.round(F.avg("_a"), 6).alias("mean_base"), F.round(F.avg("_b"), 6).alias("mean_trial"))
    return g.withColumn("passed", (F.col("rescued") >= F.col("broken")))


def by_index(rows: DataFrame, index: str, tasks: DataFrame, position: str, columns: list[str]) -> DataFrame:
    """rows with columns of the task at their index, and whether it exists."""
    t = tasks.select(F.col(position).alias("_p"), *columns).where("_p is not null").dropDuplicates(["_p"])
    return rows.join(t, F.col(index) == F.col("_p"), "left").withColumn("found", F.col("_p").isNotNull()).drop("_p")


def manifest(parts: dict[str, DataFrame], key: str) -> tuple[DataFrame, DataFrame]:
    """(manifest, repeated): the parts' rows with part and a hash of each row; keys that occur more than once."""
    out = None
    for name, d in sorted(parts.items()):
        one = d.withColumn("row_sha256", F.sha2(F.to_json(F.struct(*sorted(d.columns))), 256)).withColumn("part", F.lit(name)).select("part", key, "row_sha256")
        out = one if out is None else out.unionByName(one)
    return out, out.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def token_count(vocabulary: str | None) -> Callable[[Column], Column]:
    """Tokens of a text by the byte-level vocabulary in a file of (base64 token, rank) lines; null without it: it fails closed."""
    if not vocabulary or not os.path.exists(vocabulary):
        return lambda text: F.lit(None).cast("int")

    @F.pandas_udf(T.IntegerType())
    def count(texts: pd.Series) -> pd.Series:
        enc = _encoder(vocabulary)
        return pd.Series([None if t is None else len(enc.encode_ordinary(t)) for t in texts], dtype="Int32")

    return count


def inline_values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A report's inline VALUES as a table."""
    return spark.createDataFrame(rows, schema)


def question_sql(df: DataFrame) -> DataFrame:
    """df (q, sql) with the statement's tables, calls and literals, as arrays."""
    return df.withColumns({"tables": tx.table_names(F.col("sql")), "calls": tx.aggregate_calls(F.col("sql")), "literals": tx.where_literals(F.col("sql"))})
