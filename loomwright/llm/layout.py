"""Layout-free forms of texts and SQL statements, as Spark expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: U+FF01..U+FF5E map onto ASCII by a constant offset; the ideographic space onto a blank.
_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
_NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " "

#: Private-use signs: a decimal point, a comma inside parentheses, and the border of two parts of a key.
POINT, COMMA, PART = "\ue000", "\ue001", "\ue002"


def narrow(text: Column) -> Column:
    """Full width to half width, lower case, comparison signs in ASCII."""
    t = F.lower(F.translate(text, _WIDE, _NARROW))
    return F.replace(F.replace(t, F.lit("≥"), F.lit(">=")), F.lit("≤"), F.lit("<="))


def _keep(t: Column, signs: str) -> Column:
    """Letters, digits, decimal points and the given signs; a lone '=' goes, as it only separates a key from its value."""
    t = F.regexp_replace(t, r"(?<=[0-9])\.(?=[0-9])", POINT)
    t = F.regexp_replace(t, rf"[^\p{{L}}\p{{N}}{POINT}{signs}]+", "")
    return F.regexp_replace(t, "(?<![<>!])=", "")


def request_key(df: DataFrame, text: str, name: str) -> DataFrame:
    """df with the canonical form of an instruction.

    A text made of at least two `key=value` fields is an unordered set of fields; any other text keeps its order.
    Null gives null; a text of layout only gives ''. Its steps are columns of their own, each computed once.
    """
    parts = F.filter(
        F.split(F.regexp_replace("_t", r"(?m)^[ \t]*[-*#>]+[ \t]+", ""), r"[;,/|、\n\r。]+"),
        lambda p: p.rlike(r"[\p{L}\p{N}]"),
    )
    field = r"^[^\p{L}\p{N}]*[\p{L}][\p{L}\p{N} _\u00a0\u2003\t]{0,24}?\s*[=:].*[\p{L}\p{N}]"

    def one(p: Column) -> Column:
        head = F.substring_index(F.translate(p, "=", ":"), ":", 1)
        return F.concat(_keep(head, "<>="), F.lit(PART), _keep(F.substr(p, F.length(head) + 2), "<>="))

    t, p = F.col("_t"), F.col("_p")
    d = df.withColumn("_t", narrow(F.col(text)))
    d = d.withColumn("_p", F.when(F.length(t) - F.length(F.translate(t, "=:", "")) >= 2, parts))
    d = d.withColumn("_f", (F.size(p) >= 2) & F.forall(p, lambda x: x.rlike(field)))
    return d.withColumn(name, F.when(F.col("_f"), F.array_join(F.sort_array(F.transform(p, one)), PART)).otherwise(_keep(t, "<>="))).drop("_t", "_p", "_f")


def _columns(head: Column) -> Column:
    """The selected columns of a statement's head: parts between commas, joined again until their parentheses close."""
    opened = lambda c: F.length(F.replace(c, F.lit(")"))) - F.length(F.replace(c, F.lit("(")))

    def step(acc: Column, part: Column) -> Column:
        cur = F.concat(F.coalesce(F.concat(acc["held"], F.lit(COMMA)), F.lit("")), part)
        return F.when(opened(cur) > 0, F.struct(acc["done"].alias("done"), cur.alias("held"))).otherwise(F.struct(F.array_append(acc["done"], cur).alias("done"), F.lit(None).cast("string").alias("held")))

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("held"))
    return F.aggregate(F.split(head, ","), start, step, lambda acc: F.when(acc["held"].isNull(), acc["done"]).otherwise(F.array_append(acc["done"], acc["held"])))


def statement_key(df: DataFrame, sql: str, name: str) -> DataFrame:
    """df with the canonical form of a SELECT: names unquoted, layout dropped, the selected columns as an unordered bag.

    Commas inside parentheses of any depth belong to their column. Null gives null.
    """
    d = df.withColumn("_t", F.regexp_replace(narrow(F.col(sql)), r"\s+", " "))
    d = d.withColumn("_h", F.regexp_extract("_t", r"^\W*select (.*?) from ", 1))
    signs = rf"<>=!*/+%{COMMA}"
    bag = F.array_join(F.sort_array(F.transform(_columns(F.col("_h")), lambda c: _keep(c, signs))), PART)
    rest = F.when(F.col("_h") != "", F.regexp_replace("_t", r"^\W*select .*? from ", "")).otherwise(F.col("_t"))
    return d.withColumn(name, F.when(F.col("_t").isNotNull(), F.concat(bag, F.lit(PART), _keep(rest, signs)))).drop("_t", "_h")
