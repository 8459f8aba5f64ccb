"""Stateful stream operators: the keyed resampling buffer, wave totals and resumable progress.

The buffer is a state machine per group: it takes PASS and FAIL samples until it holds `need` of them (ready), gives up
at `most` attempts (skip) and marks what comes later as late. Its batch twin is a window over the same order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

NEED, MOST = 8, 16
_OUT = "group string, attempts long, accepted long, passed long, state string"


def _advance(attempts: int, accepted: int, passed: int, state: str, verdicts) -> tuple[int, int, int, str]:
    for v in verdicts:
        if state != "open":
            break
        attempts += 1
        if v in ("PASS", "FAIL"):
            accepted += 1
            passed += v == "PASS"
        state = "ready" if accepted >= NEED else "skip" if attempts >= MOST else "open"
    return attempts, accepted, passed, state


def _buffer(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
    now = held.get if held.exists else (0, 0, 0, "open")
    rows = pd.concat(list(batches)).sort_values("ord")
    now = _advance(*now, rows["verdict"])
    held.update(tuple(now))
    yield pd.DataFrame([(key[0], *now)], columns=["group", "attempts", "accepted", "passed", "state"])


def resample_stream(samples: DataFrame) -> DataFrame:
    """samples(group, ord, verdict) as a stream to updates of each group's state."""
    return samples.groupBy("group").applyInPandasWithState(_buffer, _OUT, "attempts long, accepted long, passed long, state string", "update", GroupStateTimeout.NoTimeout)


def resample_batch(samples: DataFrame, need: int = NEED, most: int = MOST) -> DataFrame:
    """The buffer's last state of each group in a batch, by running counts up to where it closes."""
    w = W.partitionBy("group").orderBy("ord").rowsBetween(W.unboundedPreceding, 0)
    good = F.col("verdict").isin("PASS", "FAIL").cast("int")
    d = samples.withColumn("_a", F.count(F.lit(1)).over(w)).withColumn("_g", F.sum(good).over(w))
    d = d.where((F.col("_a") <= most) & ((F.col("_g") < need) | ((F.col("_g") == need) & (good == 1))))
    g = d.groupBy("group").agg(F.max("_a").alias("attempts"), F.max("_g").alias("accepted"), F.count_if(F.col("verdict") == "PASS").alias("passed"))
    return g.withColumn("state", F.when(F.col("accepted") >= need, "ready").when(F.col("attempts") >= most, "skip").otherwise("open"))


def waves(samples: DataFrame, task: str, ord_col: str, correct: str, size: int = 2, most: int = 4) -> DataFrame:
    """(task, wave, samples, correct, state): totals after each wave until a task is mixed or has had `most` waves."""
    rn = F.row_number().over(W.partitionBy(task).orderBy(ord_col))
    d = samples.withColumn("wave", F.floor((rn - 1) / size).cast("bigint") + 1).where(F.col("wave") <= most)
    per = d.groupBy(task, "wave").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(correct).cast("bigint")).alias("c"))
    w = W.partitionBy(task).orderBy("wave").rowsBetween(W.unboundedPreceding, 0)
    cum = per.withColumn("samples", F.sum("n").over(w)).withColumn("correct", F.sum("c").over(w))
    mixed = (F.col("correct") > 0) & (F.col("correct") < F.col("samples"))
    cum = cum.withColumn("_m", mixed).withColumn("_before", F.max(F.col("_m").cast("int")).over(w.rowsBetween(W.unboundedPreceding, -1)))
    live = cum.where(F.coalesce("_before", F.lit(0)) == 0)
    return live.select(task, "wave", "samples", "correct", F.when(F.col("_m"), "mixed").when(F.col("wave") == most, "unresolved").otherwise("continue").alias("state"))


def pending(expected: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Keys still to be computed: an anti join with the completed ones."""
    return expected.join(done.select(*key).distinct(), key, "left_anti")


def event_windows(events: DataFrame, ts: str, length: str, lateness: str, *keys: str) -> DataFrame:
    """Counts of event-time windows behind a watermark; works on streams and batches alike. An extra of this engine."""
    w = F.window(ts, length)
    return events.withWatermark(ts, lateness).groupBy(w, *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), *keys, "n")
