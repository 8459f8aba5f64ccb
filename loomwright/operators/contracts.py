"""Reward contracts on trajectories: what their tool events show, joined to the record's ground truth, as expressions.

A trajectory's signals are counts over its event array, never exploded. UNKNOWN is never FAIL: an event whose outcome or
response wasn't observed leaves the trajectory unknown, with mask 0. Null and empty event arrays are trajectories without a
try; a trajectory without its record has no wanted value and is never right.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import closeness
from ..functions import text as tx
from . import scoring


def signals(trajectories: DataFrame, records: DataFrame) -> DataFrame:
    """One row a trajectory: counts of its events and statements, its answer's numbers, and its record's ground truth."""
    g = records.select(F.col("record_id").alias("_r"), F.col("reward_model.ground_truth").alias("g")).where("_r is not null").dropDuplicates(["_r"])
    own = trajectories.select("trajectory_id", "record_id", "sample_index", "final_answer", "runtime_error", "trajectory_timeout", "pi_tool_events")  # extra columns may clash
    t = own.join(g, own.record_id == F.col("_r"), "left").drop("_r")
    ev = F.coalesce("pi_tool_events", F.array().cast(trajectories.schema["pi_tool_events"].dataType))
    said = F.filter(F.flatten(F.transform(ev, lambda e: F.coalesce(e["sql_statements"], F.array().cast("array<string>")))), lambda q: q.isNotNull())
    tried = lambda e: F.coalesce(F.size(e["sql_statements"]), F.lit(0)) > 0
    s = t.withColumns({"_ev": ev, "_said": said})
    return s.select(
        "trajectory_id", "record_id", "sample_index", "final_answer", "g", F.coalesce("runtime_error", F.lit(False)).alias("failed"), F.coalesce("trajectory_timeout", F.lit(False)).alias("timed_out"),
        F.size("_said").cast("bigint").alias("queries"),
        (F.size("_said") - F.size(F.array_distinct(F.transform("_said", lambda q: F.lower(F.trim(q)))))).cast("bigint").alias("repeats"),
        F.size(F.filter("_ev", tried)).cast("bigint").alias("attempts"),
        F.size(F.filter("_ev", lambda e: tried(e) & e["ok"])).cast("bigint").alias("successes"),
        F.size(F.filter("_ev", lambda e: tried(e) & (e["ok"].isNull() | ~F.coalesce(e["observed_tool_response"], F.lit(False))))).cast("bigint").alias("unseen"),
        F.aggregate("_ev", F.lit(0).cast("bigint"), lambda a, e: a + F.coalesce(e["response_token_count"], F.lit(0))).alias("tokens"),
        F.size(F.filter("_said", lambda q: ~F.arrays_overlap(tx.table_names(q), F.coalesce(F.col("g.required_tables"), F.array().cast("array<string>"))))).cast("bigint").alias("beside"),
        F.size(F.filter("_ev", lambda e: F.size(tx.unsafe_reasons(e["arguments"]["command"])) > 0)).cast("bigint").alias("unsafe"),
    )


def right(s: DataFrame) -> Column:
    """Whether every wanted number stands among the answer's (all of a table's values); false without any wanted number."""
    want, _, _ = closeness.gold(F.col("g.expected_value_json"))
    have = tx.answer_numbers(F.col("final_answer"))
    a, r = F.coalesce("g.abs_tol", F.lit(1e-3)), F.coalesce("g.rel_tol", F.lit(1e-5))
    near = lambda x, w: F.abs(x - w) <= F.greatest(a, r * F.greatest(F.abs(x), F.abs(w)))
    return (F.size(want) > 0) & F.forall(want, lambda w: F.exists(have, lambda x: near(x, w)))


def share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def cost() -> Column:
    """Cost of a trajectory's queries and tool responses, 0..1."""
    return scoring.efficiency(F.col("queries"), F.col("tokens"), share(F.col("beside"), F.col("queries")), share(F.col("repeats"), F.col("queries")))


def tiered(s: DataFrame) -> DataFrame:
    """(trajectory_id, layer, reward, train_mask) by layers that the events show."""
    d = s.withColumns({"_c": cost(), "_right": right(s)})
    over = (F.col("queries") > scoring.MOST_QUERIES) | (F.col("tokens") > scoring.MOST_TOKENS)
    layer, reward, mask = scoring.tiered(F.col("unsafe") > 0, over, F.col("unseen") > 0, F.col("attempts") > 0, F.col("successes") > 0, F.col("_right"), F.col("_c"))
    return d.select("trajectory_id", layer.alias("layer"), reward.alias("reward"), mask.alias("train_mask"))


def tri_state(s: DataFrame) -> DataFrame:
    """(trajectory_id, state): PASS, FAIL or UNKNOWN, the evidence being a query that succeeded on a required table."""
    d = s.withColumn("_right", right(s))
    final = F.when(F.trim(F.coalesce("final_answer", F.lit(""))) == "", "UNKNOWN").when(F.col("_right"), "PASS").otherwise("FAIL")
    evidence = F.when(F.col("attempts") > 0, (F.col("successes") > 0) & (F.col("beside") < F.col("queries")))
    return d.select("trajectory_id", scoring.tri_state(F.col("g").isNotNull(), F.col("unseen") == 0, final, evidence).alias("state"))


def blended(s: DataFrame) -> DataFrame:
    """(trajectory_id, result, process, thrift, blend, evidence, mixed): result, process and thrift of a trajectory.

    blend is .4/.4/.2 with answers of at least 20 visible characters; mixed is .7 of it and .3 of the evidence, whose parts
    are the answer, a query that succeeded, the required tables and an answer at all.
    """
    tables = share(F.col("queries") - F.col("beside"), F.col("queries"))
    d = s.withColumn("result", right(s).cast("double")).withColumn("process", F.round(0.3 * tables + 0.7 * share(F.col("successes"), F.col("attempts")), 6)).withColumn("thrift", scoring.frugality(F.col("unsafe"), F.col("repeats"), F.lit(0), F.greatest(F.col("attempts") - F.col("successes"), F.lit(0))))
    d = d.withColumn("blend", scoring.blend(F.col("result"), F.col("process"), F.col("thrift"), F.col("final_answer")))
    shown = (F.trim(F.coalesce("final_answer", F.lit(""))) != "").cast("double")
    # fixed values: weights of the evidence's parts and of the blend
    evidence = F.round(0.60 * F.col("result") + 0.25 * (F.col("successes") > 0).cast("double") + 0.10 * tables + 0.05 * shown, 6)
    return d.withColumn("evidence", evidence).select("trajectory_id", "result", "process", "thrift", "blend", "evidence", F.round(0.7 * F.col("blend") + 0.3 * F.col("evidence"), 6).alias("mixed"))


def minimal(s: DataFrame) -> DataFrame:
    """(trajectory_id, reward, reason): 1 for a right answer that an observed query backs, 0 for anything else, with the first reason."""
    d = s.withColumn("_right", right(s))
    reason = (
        F.when(F.col("g").isNull(), "no_record").when(F.col("failed"), "runtime_error").when(F.col("timed_out"), "timeout").when(F.col("attempts") == 0, "no_query")
        .when(F.col("successes") == 0, "no_success").when(F.col("beside") >= F.col("queries"), "other_tables").when(~F.col("_right"), "wrong_answer").otherwise("right")
    )
    return d.select("trajectory_id", (reason == "right").cast("double").alias("reward"), reason.alias("reason"))


def supported(trajectories: DataFrame, s: DataFrame) -> DataFrame:
    """(trajectory_id, right, seen): whether the answer is right and every wanted number stood in some tool response."""
    want, _, _ = closeness.gold(F.col("g.expected_value_json"))
    shown = trajectories.select(F.col("trajectory_id").alias("_t"), F.array_join(F.transform("pi_tool_events", lambda e: F.coalesce(e["response_preview"], F.lit(""))), "\n").alias("_p"))
    d = s.join(shown, s.trajectory_id == F.col("_t"), "left")
    have = tx.numbers(F.col("_p"))
    return d.select("trajectory_id", right(s).alias("right"), ((F.size(want) > 0) & F.forall(want, lambda w: F.exists(have, lambda x: tx.close(x, w)))).alias("seen"))


def last_bearing_agrees(trajectories: DataFrame) -> DataFrame:
    """(trajectory_id, index, agrees): the last observed query response with a number, and whether the answer has its last number."""
    ev = F.filter(F.transform(F.coalesce("pi_tool_events", F.array().cast(trajectories.schema["pi_tool_events"].dataType)), lambda e, i: F.struct(i.alias("i"), e["ok"].alias("ok"), tx.numbers(e["response_preview"]).alias("xs"))), lambda e: e["ok"] & (F.size(e["xs"]) > 0))
    last = F.try_element_at(ev, F.lit(-1))
    have = tx.answer_numbers(F.col("final_answer"))
    return trajectories.select("trajectory_id", last["i"].alias("index"), F.when(last.isNotNull(), F.exists(have, lambda x: tx.close(x, F.element_at(last["xs"], -1)))).alias("agrees"))


def rescored(rewards: DataFrame, group: str, correct: str, reward: str, size: int, spread: float = 0.05) -> DataFrame:
    """(group, n, ranked_band, ranked_dense, meaningful) of groups of at least `size`: whether a contract ranks right over wrong.

    Banded contracts compare the least right with the greatest wrong reward, dense ones the means; a group without both is null.
    """
    r = F.col(reward)
    g = rewards.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.min(F.when(F.col(correct), r)).alias("lo"), F.max(F.when(~F.col(correct), r)).alias("hi"), F.avg(F.when(F.col(correct), r)).alias("a"), F.avg(F.when(~F.col(correct), r)).alias("b"), (F.max(r) - F.min(r)).alias("spread"))
    return g.where(F.col("n") >= size).select(group, "n", (F.col("lo") > F.col("hi")).alias("ranked_band"), (F.col("a") > F.col("b")).alias("ranked_dense"), (F.round("spread", 6) >= spread).alias("meaningful"))


def strength(sql: Column, gold: Column, required: Column) -> Column:
    """strong, weak, violating or none: how far a statement keeps to the gold one's tables, aggregates and literals."""
    none = F.array().cast("array<string>")
    t = tx.table_names(sql)
    lacks = lambda f: F.size(F.array_except(f(gold), f(sql))) > 0
    return (
        F.when(sql.isNull() | (F.trim(sql) == ""), "none").when(~tx.read_only(sql), "violating").when(F.size(F.array_except(F.coalesce(required, none), t)) > 0, "violating")
        .when(lacks(tx.aggregate_calls) | lacks(tx.where_literals), "weak").otherwise("strong")
    )


def covers(candidate: Column, wanted: Column) -> Column:
    """Whether each wanted literal equals one of the candidate's, or is a date that one of them begins with."""
    return F.forall(wanted, lambda w: F.exists(candidate, lambda c: (c == w) | (w.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & c.startswith(w))))


def evidence_mode(candidate: Column, gold: Column) -> Column:
    """exact, safe_projection (the gold's tables, aggregates and literals are all the candidate's) or none."""
    solid = lambda q: F.lower(F.regexp_replace(q, r"[\s;]+", ""))
    inside = lambda f: F.size(F.array_except(f(gold), f(candidate))) == 0
    return F.when(candidate.isNull() | gold.isNull(), "none").when(solid(candidate) == solid(gold), "exact").when(inside(tx.table_names) & inside(tx.aggregate_calls) & covers(tx.where_literals(candidate), tx.where_literals(gold)), "safe_projection").otherwise("none")


def admission(run: DataFrame, again: DataFrame, label: str) -> DataFrame:
    """(rows, same, complete, unique, admitted) of two runs of one statement: equal as bags, not empty, no null, labels unique."""
    n = run.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(label).alias("labels"), F.sum(F.when(F.greatest(*(F.col(c).isNull().cast("int") for c in run.columns)) > 0, 1).otherwise(0)).alias("nulls"))
    off = run.exceptAll(again).unionAll(again.exceptAll(run)).agg(F.count(F.lit(1)).alias("off"))
    d = n.crossJoin(off)  # one row each
    same, complete, unique = F.col("off") == 0, (F.col("rows") > 0) & (F.coalesce("nulls", F.lit(0)) == 0), F.col("labels") == F.col("rows")
    return d.select("rows", same.alias("same"), complete.alias("complete"), unique.alias("unique"), (same & complete & unique).alias("admitted"))
