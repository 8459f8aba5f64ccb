"""Tool events and answers of trajectories: validity, pairing, first and last hits, unique conclusions, outcome ladders.

Events are arrays; all of this is higher-order expressions inside one projection, without exploding.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx


def valid_event(e: Column) -> Column:
    """A named tool with its argument: a command for bash, a path for the file tools; parsed and answered."""
    has = F.when(e["name"] == "bash", F.trim(e["arguments"]["command"]) != "").otherwise(F.trim(e["arguments"]["path"]) != "")
    return F.coalesce(e["name"].isNotNull() & has & e["call_parse_valid"] & e["observed_tool_response"], F.lit(False))


def event_profile(df: DataFrame, events: str = "pi_tool_events") -> DataFrame:
    """df with counts of its events: all, valid, ok, with SQL, distinct SQL, response tokens, and whether all are valid."""
    ev = F.coalesce(F.col(events), F.array().cast(df.schema[events].dataType))
    sql = F.flatten(F.transform(ev, lambda e: F.coalesce(e["sql_statements"], F.array().cast("array<string>"))))
    keyed = F.transform(sql, lambda q: F.lower(F.trim(F.regexp_replace(q, r"\s+", " "))))
    return df.withColumns(
        {
            "events": F.size(ev), "valid_events": F.size(F.filter(ev, valid_event)), "ok_events": F.size(F.filter(ev, lambda e: F.coalesce(e["ok"], F.lit(False)))), "queries": F.size(sql), "distinct_queries": F.size(F.array_distinct(keyed)),
            "tool_tokens": F.aggregate(ev, F.lit(0).cast("bigint"), lambda a, e: a + F.coalesce(e["response_token_count"], F.lit(0))), "all_valid": (F.size(ev) > 0) & F.forall(ev, valid_event),
        }
    )


def first_index(events: Column, hit) -> Column:
    """Zero-based index of the first element that satisfies a predicate; null if none does."""
    return F.array_min(F.transform(F.filter(F.transform(events, lambda e, i: F.struct(i.alias("i"), e.alias("e"))), lambda p: F.coalesce(hit(p["e"]), F.lit(False))), lambda p: p["i"]))


def recovered_within(df: DataFrame, index: str, ks: list[int]) -> DataFrame:
    """(n, within_<k>..., any, never): rows whose first hit comes among the first k elements."""
    return df.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col(index) < k).alias(f"within_{k}") for k in ks), F.count(index).alias("any_hit"), F.count_if(F.col(index).isNull()).alias("never"))


def paired_calls(messages: Column) -> Column:
    """ARRAY<STRUCT<call_id, name, arguments, response, ok>>: each call with the tool message of its id, in call order.

    A call without a response has a null one and isn't ok; of several responses the first counts; a null id pairs with none.
    """
    tools = F.filter(messages, lambda m: (m["role"] == "tool") & m["tool_call_id"].isNotNull())
    calls = F.flatten(F.transform(F.filter(messages, lambda m: m["tool_calls"].isNotNull()), lambda m: m["tool_calls"]))

    def one(c: Column) -> Column:
        r = F.try_element_at(F.filter(tools, lambda m: m["tool_call_id"] == c["id"]), F.lit(1))["content"]
        good = F.coalesce((F.trim(r) != "") & ~r.rlike(r"(?i)traceback|\berror\s*:|no such|not found|exit code\s+[1-9]"), F.lit(False))
        return F.struct(c["id"].alias("call_id"), c["name"].alias("name"), c["arguments"].alias("arguments"), r.alias("response"), good.alias("ok"))

    return F.transform(calls, one)


def unique_conclusion(answer: Column) -> tuple[Column, Column]:
    """(value, reason): the one number an answer concludes with.

    A labelled conclusion goes before the last non-empty line; several different numbers are ambiguous and give no value.
    """
    label = F.regexp_extract_all(answer, F.lit(r"(?im)(?:final answer|答案|结果|result)\W{0,6}([-+]?\d[\d,]*(?:\.\d+)?)"), F.lit(1))
    labelled = F.array_distinct(F.transform(label, lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("double")))
    last = F.element_at(F.concat(F.array(F.lit("")), F.filter(F.split(answer, "\n"), lambda x: F.trim(x) != "")), -1)
    tail = F.array_distinct(tx.answer_numbers(last))
    pick = F.when(F.size(labelled) == 1, labelled[0]).when((F.size(labelled) == 0) & (F.size(tail) == 1), tail[0])
    reason = F.when(answer.isNull() | (F.trim(answer) == ""), "no_answer").when(F.size(labelled) > 1, "ambiguous_label").when(F.size(labelled) == 1, "label").when(F.size(tail) == 1, "last_line").when(F.size(tail) > 1, "ambiguous_line").otherwise("no_number")
    return pick, reason


def path_state(path: Column, root: str = "/workspace") -> Column:
    """inside, outside or unknown: where a path leads, with its dots resolved by depth."""
    p = F.trim(path)
    parts = F.filter(F.split(F.when(p.startswith(root), F.substr(p, F.lit(len(root) + 1))).otherwise(p), "/"), lambda x: ~x.isin("", "."))
    lowest = F.aggregate(parts, F.struct(F.lit(0).alias("d"), F.lit(0).alias("m")), lambda a, x: F.struct((a["d"] + F.when(x == "..", -1).otherwise(1)).alias("d"), F.least(a["m"], a["d"] + F.when(x == "..", -1).otherwise(1)).alias("m")))["m"]
    return F.when(p.isNull() | (p == "") | p.rlike(r"[$`*?~]"), "unknown").when(p.startswith("/") & ~p.rlike(rf"^{root}(?:/|$)"), "outside").when(lowest < 0, "outside").otherwise("inside")


def document_coverage(opened: Column, required: Column) -> Column:
    """Share of required documents opened, by full path, name or stem; null without required ones."""
    forms = lambda d: F.array_distinct(F.array(F.lower(d), F.lower(F.substring_index(d, "/", -1)), F.lower(F.regexp_replace(F.substring_index(d, "/", -1), r"\.[^.]*$", ""))))
    have = F.flatten(F.transform(opened, forms))
    hit = F.size(F.filter(required, lambda d: F.arrays_overlap(forms(d), have)))
    return F.when(F.size(required) > 0, F.round(hit / F.size(required), 6))


def outcome_ladder(answered: Column, verified: Column, attempted: Column, executed: Column, relevant: Column) -> Column:
    """1 / .85 / .20 / .15 / .05 / 0: verified with evidence, verified, then how far an unverified try came."""
    return F.when(verified & executed, 1.0).when(verified, 0.85).when(executed & relevant, 0.20).when(executed, 0.15).when(attempted | answered, 0.05).otherwise(0.0)


def outcome_class(query: Column, error: Column, rows: Column, matches: Column) -> Column:
    """no_query, execution_error, empty, wrong or verified."""
    return F.when(query.isNull(), "no_query").when(error, "execution_error").when(F.coalesce(rows, F.lit(0)) == 0, "empty").when(matches, "verified").otherwise("wrong")


def first_divergence(left: Column, right: Column) -> Column:
    """Zero-based index at which two sequences first differ, the shorter's end included; null if they are equal."""
    pairs = F.zip_with(left, right, lambda a, b: a.eqNullSafe(b))
    return F.array_min(F.transform(F.filter(F.transform(pairs, lambda e, i: F.struct(i.alias("i"), e.alias("e"))), lambda q: ~q["e"]), lambda q: q["i"]))
