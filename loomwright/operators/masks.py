"""Loss masks over token arrays, and the kinds of a statement's tokens, as higher-order expressions.

Masks are ARRAY<INT> or ARRAY<DOUBLE> of one length; a null array gives null, an empty one an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the kinds of tokens and the words of each
AGGREGATES = ("count", "sum", "avg", "min", "max", "round")
STARTS = ("select", "with")
CLAUSES = ("from", "where", "group", "by", "having", "order", "limit", "join", "on", "and", "or", "as", "asc", "desc", "in", "is", "not", "null", "between")
KINDS = ("aggregate", "query_start", "clause", "punctuation", "literal", "identifier")


def tokens(sql: Column) -> Column:
    """ARRAY<STRING> of a statement's words, numbers, quoted texts and single signs, lower case."""
    return F.regexp_extract_all(F.lower(sql), F.lit(r"('[^']*'|[a-z_][a-z0-9_]*|[0-9]+(?:\.[0-9]+)?|[^\sa-z0-9_'])"), F.lit(1))


def kind(token: Column) -> Column:
    """aggregate, query_start, clause, punctuation, literal or identifier."""
    return (
        F.when(token.isin(*AGGREGATES), "aggregate").when(token.isin(*STARTS), "query_start").when(token.isin(*CLAUSES), "clause")
        .when(token.rlike("^[0-9']"), "literal").when(token.rlike("^[a-z_]"), "identifier").otherwise("punctuation")
    )


def component(toks: Column, name: str) -> Column:
    """ARRAY<INT> mask of one kind; the masks of all kinds are disjoint and cover every token."""
    return F.transform(toks, lambda t: (kind(t) == name).cast("int"))


def weighted(parts: list[tuple[Column, float]]) -> Column:
    """ARRAY<DOUBLE> sum of weight * mask; null where two masks overlap, lengths differ or a weight isn't in (0, 32]."""

    def scaled(mask: Column, w: float) -> Column:
        return F.transform(mask, lambda x: x * F.lit(float(w)))

    total, hits = None, None
    for mask, w in parts:
        m = scaled(mask, w)
        total = m if total is None else F.zip_with(total, m, lambda a, b: a + b)
        hits = mask if hits is None else F.zip_with(hits, mask, lambda a, b: a + b)
    sound = all(0 < w <= 32 for _, w in parts)
    return F.when(F.lit(sound) & F.forall(hits, lambda h: h.isNotNull() & (h <= 1)), total)


def emphasised(weights: Column, mask: Column, nth: int, weight: float) -> Column:
    """weights with the nth (from 0) masked position set to `weight`; unchanged where the mask has fewer."""
    at = F.try_element_at(F.filter(F.transform(mask, lambda m, i: F.when(m > 0, i)), lambda i: i.isNotNull()), F.lit(nth + 1))
    return F.transform(weights, lambda w, i: F.when(i == at, F.lit(float(weight))).otherwise(w))


def from_ranges(length: Column, ranges: Column) -> Column:
    """ARRAY<INT> mask of positions inside any [start, end) of an ARRAY<STRUCT<start, end>>."""
    return F.when(length > 0, F.transform(F.sequence(F.lit(0), length - 1), lambda i: F.exists(ranges, lambda r: (r["start"] <= i) & (i < r["end"])).cast("int"))).otherwise(F.array().cast("array<int>"))


def subset(inner: Column, outer: Column) -> Column:
    """Whether a mask lies inside another of the same length."""
    return (F.size(inner) == F.size(outer)) & F.forall(F.zip_with(inner, outer, lambda a, b: (a <= 0) | (b > 0)), lambda x: F.coalesce(x, F.lit(False)))
