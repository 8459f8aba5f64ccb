"""How close an answer's numbers and labels come to the expected ones, as expressions over arrays.

The expected value is JSON: a number, or rows with `value` and a label in `category` or `date`.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as tx

_ROWS = "array<struct<category: string, date: string, value: string>>"
# fixed values: the most that a number which isn't equal counts, its slope, and the weights of numbers and labels in tables
NEAR_MOST, SLOPE, OF_NUMBERS, OF_LABELS = 0.75, 4.0, 0.85, 0.15


def _finite(xs: Column) -> Column:
    return F.filter(xs, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def gold(expected_json: Column) -> tuple[Column, Column, Column]:
    """(numbers, labels, is_table) of the expected value; booleans are no numbers."""
    rows = F.from_json(expected_json, _ROWS)
    is_table = F.ltrim(expected_json).startswith("[")
    number = lambda t: F.replace(t, F.lit(","), F.lit("")).try_cast("double")
    scalar = F.array(number(F.regexp_replace(F.trim(expected_json), '^"|"$', "")))
    numbers = _finite(F.when(is_table, F.transform(rows, lambda r: number(r["value"]))).otherwise(scalar))
    labels = F.filter(F.transform(rows, lambda r: F.lower(F.trim(F.coalesce(r["category"], r["date"])))), lambda x: x.isNotNull())
    return F.coalesce(numbers, F.array().cast("array<double>")), F.when(is_table, F.coalesce(labels, F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")), is_table


def nearness(got: Column, want: Column, abs_tol: float, rel_tol: float) -> Column:
    """1 within tolerance, else falling with the relative error."""
    off = F.abs(got - want) / F.greatest(F.abs(want), F.lit(1.0))
    return F.when(tx.close(got, want, abs_tol, rel_tol), 1.0).otherwise(F.least(F.lit(NEAR_MOST), 1 / (1 + SLOPE * off)))


def matched(have: Column, want: Column, abs_tol: float, rel_tol: float) -> Column:
    """Sum of nearness over pairs of a wanted number and one of the answer's, the nearest pair first, none used twice."""
    pairs = F.flatten(F.transform(want, lambda w, i: F.transform(have, lambda h, j: F.struct((-nearness(h, w, abs_tol, rel_tol)).alias("less"), i.alias("i"), j.alias("j")))))
    none = F.array().cast("array<int>")
    start = F.struct(F.lit(0.0).alias("sum"), none.alias("i"), none.alias("j"))

    def take(acc: Column, p: Column) -> Column:
        free = ~F.array_contains(acc["i"], p["i"]) & ~F.array_contains(acc["j"], p["j"])
        return F.when(free, F.struct((acc["sum"] - p["less"]).alias("sum"), F.array_append(acc["i"], p["i"]).alias("i"), F.array_append(acc["j"], p["j"]).alias("j"))).otherwise(acc)

    return F.aggregate(F.array_sort(pairs), start, take, lambda acc: acc["sum"])


def closeness(answer: Column, expected_json: Column, abs_tol: float = 1e-3, rel_tol: float = 1e-5) -> Column:
    """0..1: wanted numbers matched to the answer's, less the more numbers the answer has beyond twice as many; tables count labels, too.

    Null or unreadable expected values and null answers give 0.
    """
    want, labels, is_table = gold(expected_json)
    have = tx.answer_numbers(F.coalesce(answer, F.lit("")))
    n, m = F.size(want), F.size(have)
    free = F.greatest(2 * n, n + 2)
    mean = F.when((n > 0) & (m > 0), matched(have, want, abs_tol, rel_tol) / n * F.sqrt(F.least(F.lit(1.0), free / m))).otherwise(0.0)
    low = F.lower(F.coalesce(answer, F.lit("")))
    hit = F.when(F.size(labels) > 0, F.size(F.filter(labels, lambda x: (x != "") & F.contains(low, x))) / F.size(labels)).otherwise(0.0)
    score = F.when(~is_table | (F.size(labels) == 0) & (n > 0), mean).when(n > 0, OF_NUMBERS * mean + OF_LABELS * hit).otherwise(hit)
    return F.coalesce(F.round(F.least(F.lit(1.0), score), 6), F.lit(0.0))
