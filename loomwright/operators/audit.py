"""Audits: keys, references, constraints, formula checks, instruction and SQL alignment, order stability, drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .curate import all_reasons


def key_audit(df: DataFrame, key: list[str]) -> DataFrame:
    """(rows, distinct_keys, null_keys, duplicate_keys)."""
    null = F.lit(False)
    for k in key:
        null = null | F.col(k).isNull()
    g = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), F.max(null).alias("_null"))
    return g.agg(F.sum("_n").alias("rows"), F.count_if(~F.col("_null")).alias("distinct_keys"), F.coalesce(F.sum(F.when(F.col("_null"), F.col("_n"))), F.lit(0)).alias("null_keys"), F.count_if((F.col("_n") > 1) & ~F.col("_null")).alias("duplicate_keys"))


def reference_audit(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """(value, n) of child values that aren't null and find no parent."""
    p = parent.select(F.col(key).alias("value")).distinct()
    return child.where(F.col(column).isNotNull()).select(F.col(column).alias("value")).join(p, "value", "left_anti").groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def check_audit(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(check, passed, failed, unknown): rows for which a constraint holds, fails or is null; one pass for all."""
    sums = [x for n, c in checks.items() for x in (F.count_if(c).alias(f"{n}|p"), F.count_if(~c).alias(f"{n}|f"), F.count_if(c.isNull()).alias(f"{n}|u"))]
    one = df.agg(*sums)
    rows = F.array(*(F.struct(F.lit(n).alias("check"), F.col(f"`{n}|p`").alias("passed"), F.col(f"`{n}|f`").alias("failed"), F.col(f"`{n}|u`").alias("unknown")) for n in checks))
    return one.select(F.inline(rows))


def field_summary(df: DataFrame, fields: list[str]) -> DataFrame:
    """(field, present, missing, mean, positive_rate) of numeric fields."""
    sums = [x for f in fields for x in (F.count(f).alias(f"{f}|n"), F.round(F.avg(f), 6).alias(f"{f}|m"), F.count_if(F.col(f) > 0).alias(f"{f}|p"))]
    one = df.agg(F.count(F.lit(1)).alias("_all"), *sums)
    rows = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"`{f}|n`").alias("present"), (F.col("_all") - F.col(f"`{f}|n`")).alias("missing"), F.col(f"`{f}|m`").alias("mean"), F.round(F.try_divide(F.col(f"`{f}|p`"), F.col(f"`{f}|n`")), 6).alias("positive_rate")) for f in fields))
    return one.select(F.inline(rows))


def formula_mismatches(df: DataFrame, stored: str, formula: Column, by: str, eps: float = 1e-6) -> DataFrame:
    """(by, n, mismatches): rows whose stored value isn't the formula's; both null agree, one null doesn't."""
    same = F.col(stored).eqNullSafe(formula) | F.coalesce(F.abs(F.col(stored) - formula) <= eps, F.lit(False))
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count_if(~same).alias("mismatches"))


def alignment_reasons(instruction: Column, sql: Column, answer_type: Column) -> Column:
    """Warnings of an instruction and its statement, joined by '|'."""
    q = F.lower(sql)
    timed = q.rlike(r"'\d{4}-\d{2}|date\s*\(|strftime")
    return all_reasons(
        [
            ("broad_instruction", F.length(instruction) < 24),
            ("latest_without_time", instruction.rlike(r"(?i)最新|最近|latest|most recent") & ~timed),
            ("limit_without_order", q.rlike(r"\blimit\b") & ~q.rlike(r"\border\s+by\b")),
            ("numeric_without_aggregate", (answer_type == "numeric") & ~q.rlike(r"\b(?:count|sum|avg|min|max)\s*\(")),
            ("broad_to_count", (F.length(instruction) < 24) & q.rlike(r"count\s*\(\s*\*\s*\)")),
        ]
    )


def order_binding(sql: Column, instruction: Column) -> Column:
    """Whether the order of the expected rows is part of the answer: the statement sorts, or the words rank."""
    return F.lower(sql).rlike(r"\border\s+by\b") | instruction.rlike(r"(?i)最高|最低|排名|前\s*\d+|\btop\b|\brank")


def gold_numbers(expected_json: Column) -> Column:
    """The numbers of a scalar or of the value of each row, as ARRAY<DOUBLE>."""
    rows = F.from_json(expected_json, "array<struct<value:string>>")
    scalar = F.array_compact(F.array(F.replace(expected_json, F.lit(","), F.lit("")).try_cast("double")))
    return F.when(F.ltrim(expected_json).startswith("["), F.array_compact(F.transform(rows, lambda r: F.replace(r["value"], F.lit(","), F.lit("")).try_cast("double")))).otherwise(scalar)


def numbers_match(answer: Column, expected_json: Column, eps: float = 1e-6) -> Column:
    """Whether an answer holds every gold number, within an absolute or relative 1e-6; false without gold numbers."""
    have, gold = tx.numbers(answer), gold_numbers(expected_json)
    near = lambda g: F.exists(have, lambda a: (F.abs(g - a) < eps) | (F.abs(g - a) < eps * F.abs(g)))
    return F.coalesce((F.size(gold) > 0) & F.forall(gold, near), F.lit(False))


def bag_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """(only_left, only_right): rows that two results don't share, multiplicity kept; 0 and 0 for equal bags."""
    cols = left.columns
    tagged = left.select(*cols, F.lit(1).alias("_d")).unionByName(right.select(*cols, F.lit(-1).alias("_d")))
    g = tagged.groupBy(*cols).agg(F.sum("_d").alias("_d"))
    return g.agg(F.coalesce(F.sum(F.greatest("_d", F.lit(0))), F.lit(0)).alias("only_left"), F.coalesce(F.sum(F.greatest(-F.col("_d"), F.lit(0))), F.lit(0)).alias("only_right"))


def delta_drivers(paired: DataFrame, key: str, parts: dict[str, tuple[Column, Column]], total: tuple[Column, Column]) -> DataFrame:
    """(key, delta, <part>..., rest): a score's change split additively into its parts, what rounding leaves booked as rest."""
    cols = [F.round(b - a, 6).alias(n) for n, (a, b) in parts.items()]
    d = paired.select(key, F.round(total[1] - total[0], 6).alias("delta"), *cols)
    known = sum((F.col(n) for n in parts), F.lit(0.0))
    return d.withColumn("rest", F.round(F.col("delta") - known, 6))


def opening_gate(df: DataFrame, text: str, most_share: float = 0.05) -> DataFrame:
    """(opening, n, share, passed) of masked openings against the largest share allowed."""
    g = df.groupBy(tx.masked_opening(F.col(text)).alias("opening")).agg(F.count(F.lit(1)).alias("n"))
    total = F.broadcast(g.agg(F.sum("n").alias("_t")))  # one row
    return g.join(total).select("opening", "n", F.round(F.col("n") / F.col("_t"), 6).alias("share"), (F.col("n") / F.col("_t") <= most_share).alias("passed"))
