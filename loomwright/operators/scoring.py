"""Reward contracts as column expressions: efficiency terms, bands, tiers and tri-state decisions.

UNKNOWN is never FAIL: it scores 0 with train mask 0 and leaves its group.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: free and hard limits of queries and of tool-response tokens
FREE_QUERIES, MOST_QUERIES, FREE_TOKENS, MOST_TOKENS = 4, 16, 4_000, 32_000


def clip01(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x.cast("double")))


def efficiency(queries: Column, tokens: Column, irrelevant: Column, duplicate: Column) -> Column:
    """Cost in 0..1: half from queries beyond the free ones, .3 from tokens, .2 from irrelevant and duplicate shares."""
    q = clip01(F.log1p(F.greatest(queries - FREE_QUERIES, F.lit(0))) / F.log1p(F.lit(8.0)))
    t = clip01(F.log1p(F.greatest(tokens - FREE_TOKENS, F.lit(0)) / FREE_TOKENS) / F.log1p(F.lit(3.0)))
    b = 0.5 * clip01(irrelevant) + 0.5 * clip01(duplicate)
    return clip01(0.5 * q + 0.3 * t + 0.2 * b)


def banded(eligible: Column, has_final: Column, final_ok: Column, sql_ok: Column, quality: Column) -> Column:
    """Bands that never overlap: both right, answer right, SQL right, wrong; quality orders inside a band."""
    q = clip01(quality)
    # fixed values: the bands
    score = F.when(final_ok & sql_ok, 0.80 + 0.20 * q).when(final_ok, 0.65 + 0.10 * q).when(sql_ok, 0.40 + 0.10 * q).otherwise(0.10 + 0.20 * q)
    return F.when(eligible & has_final, F.round(score, 6)).otherwise(F.lit(0.0))


def tiered(unsafe: Column, over_budget: Column, unknown: Column, attempted: Column, succeeded: Column, final_ok: Column, cost: Column) -> tuple[Column, Column, Column]:
    """(layer, reward, train_mask) of one trajectory."""
    layer = (
        F.when(unsafe | over_budget, "unsafe_or_budget").when(unknown, "unknown").when(~attempted, "no_attempt").when(~succeeded, "attempt_failed").when(~final_ok, "success_wrong_final").otherwise("success_correct_final")
    )
    reward = F.when(layer == "attempt_failed", 0.1 * (1 - cost)).when(layer == "success_wrong_final", 0.2 * (1 - cost)).when(layer == "success_correct_final", 1 - 0.2 * cost).otherwise(0.0)
    return layer, F.round(clip01(reward), 6), F.when(layer == "unknown", 0.0).otherwise(1.0)


def tri_state(task_ok: Column, observable: Column, final_state: Column, evidence: Column) -> Column:
    """PASS, FAIL or UNKNOWN with precedence task, observability, final answer, evidence (nulls are UNKNOWN)."""
    return (
        F.when(~F.coalesce(task_ok, F.lit(False)), "UNKNOWN").when(~F.coalesce(observable, F.lit(False)), "UNKNOWN").when(F.coalesce(final_state, F.lit("UNKNOWN")) == "UNKNOWN", "UNKNOWN")
        .when(final_state == "FAIL", "FAIL").when(evidence.isNull(), "UNKNOWN").when(evidence, "PASS").otherwise("FAIL")
    )


def gated_process(valid: Column, correct: Column, process: Column, alpha: float = 0.10) -> Column:
    """valid * correct * (1 + alpha * process): process can't lift a wrong answer."""
    return F.round(valid.cast("double") * correct.cast("double") * (1 + F.lit(min(alpha, 0.10)) * clip01(F.coalesce(process, F.lit(0.0)))), 6)


def observed_mean(parts: list[tuple[Column, float]]) -> Column:
    """Weighted mean of the parts that aren't null; null if all are."""
    top = sum((F.coalesce(c * w, F.lit(0.0)) for c, w in parts), F.lit(0.0))
    low = sum((F.when(c.isNotNull(), w).otherwise(0.0) for c, w in parts), F.lit(0.0))
    return F.round(F.try_divide(top, low), 6)


def blend(result: Column, process: Column, frugality: Column, answer: Column) -> Column:
    """.4 result + .4 process + .2 frugality; 0 for an answer of fewer than 20 visible characters."""
    shown = F.length(F.regexp_replace(F.coalesce(answer, F.lit("")), r"\s+", ""))
    return F.when(shown >= 20, F.round(0.4 * clip01(result) + 0.4 * clip01(process) + 0.2 * clip01(frugality), 6)).otherwise(F.lit(0.0))


def frugality(full_scans: Column, duplicate_sql: Column, duplicate_commands: Column, retries: Column) -> Column:
    penalty = 0.1 * full_scans + 0.05 * (duplicate_sql + F.least(duplicate_commands, F.lit(20))) + 0.2 * retries
    return F.round(1 - F.least(F.lit(1.0), penalty), 6)
