"""Selection and assignment: weighted risk, natural order, priority pools, ordered picks, reviews, greedy balancing.

Greedy assignment is sequential by nature; it runs on group sizes (`assign_groups`, at most MOST_GROUPS rows on the
driver) or inside one group of candidates, never on whole tables.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .curate import stratum_top

#: Group sizes the driver takes for a greedy assignment.
MOST_GROUPS = 1_000_000


def risk(warnings: Column, weights: dict[str, int]) -> Column:
    """Sum of the warnings' weights; an unknown warning weighs 1, null and empty weigh 0."""
    table = F.create_map(*(x for k, v in weights.items() for x in (F.lit(k), F.lit(v))))
    return F.coalesce(F.aggregate(warnings, F.lit(0), lambda a, w: a + F.coalesce(table[w], F.lit(1))), F.lit(0))


def natural_order(label: str) -> list[Column]:
    """Numeric labels by value, then the others by text."""
    n = F.col(label).try_cast("bigint")
    return [F.asc_nulls_last(n), F.asc_nulls_last(label)]


def pools(df: DataFrame, key: str, rules: list[tuple[str, Column, int]], order: Column) -> DataFrame:
    """Rows of the first pool whose rule they meet, at most the pool's quota each, in the given order."""
    pool = reduce(lambda c, r: c.when(r[1], r[0]), rules[1:], F.when(rules[0][1], rules[0][0]))
    quota = reduce(lambda c, r: c.when(r[1], r[2]), rules[1:], F.when(rules[0][1], rules[0][2]))
    d = df.withColumn("pool", pool).withColumn("_q", quota).where("pool is not null")
    top = stratum_top(d, ["pool"], order, max(r[2] for r in rules))  # a pool may be the rest of the table: only its first rows are ranked
    return top.where(F.col("rank") <= F.col("_q")).withColumnRenamed("rank", "place").drop("_q")


def in_order(df: DataFrame, key: str, wanted: list) -> DataFrame:
    """Rows of the wanted keys with the position of each in the list."""
    pos = F.array_position(F.array(*map(F.lit, wanted)), F.col(key))
    return df.where(F.col(key).isin(wanted)).withColumn("position", pos)


def reviewed(candidates: DataFrame, reviews: DataFrame, key: list[str], flags: list[str]) -> DataFrame:
    """candidates with decision: approved (all flags true), rejected, or unreviewed; of several reviews all must agree."""
    ok = reduce(lambda a, b: a & b, (F.coalesce(F.col(f), F.lit(False)) for f in flags))
    r = reviews.groupBy(*key).agg(F.min(ok).alias("_ok"))
    return candidates.join(r, key, "left").withColumn("decision", F.when(F.col("_ok").isNull(), "unreviewed").when(F.col("_ok"), "approved").otherwise("rejected")).drop("_ok")


def matched_by_priority(left: DataFrame, right: DataFrame, first: tuple[str, str], second: tuple[str, str], key: str) -> DataFrame:
    """left with match_id and how: by the first key if it occurs on the right, else by the second; several matches are ambiguous."""

    def by(pair: tuple[str, str], name: str) -> DataFrame:
        r = right.where(F.col(pair[1]).isNotNull()).groupBy(F.col(pair[1]).alias(pair[0])).agg(F.count(F.lit(1)).alias(f"_n{name}"), F.min(key).alias(f"_k{name}"))
        return r

    d = left.join(by(first, "a"), first[0], "left").join(by(second, "b"), second[0], "left")
    n = F.when(F.col("_na").isNotNull(), F.col("_na")).otherwise(F.col("_nb"))
    how = F.when(n.isNull(), "missing").when(n > 1, "ambiguous").when(F.col("_na").isNotNull(), "first").otherwise("second")
    return d.withColumn("how", how).withColumn("match_id", F.when(n == 1, F.coalesce(F.when(F.col("_na").isNotNull(), F.col("_ka")), F.col("_kb")))).drop("_na", "_nb", "_ka", "_kb")


def assign_groups(df: DataFrame, group: str, sizes: dict[str, int], order: Column) -> DataFrame:
    """df with split: whole groups in seeded order to the split with most room; what fits nowhere is 'unused'."""
    g = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("o"))
    if g.limit(MOST_GROUPS + 1).count() > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} groups")
    room, out = dict(sizes), []
    for key, n, _ in g.orderBy("o", group).toLocalIterator():
        best = max(room, key=lambda s: (room[s], s))
        if room[best] >= n:
            room[best] -= n
            out.append((key, best))
    at = df.sparkSession.createDataFrame(out, f"{group} {dict(df.dtypes)[group]}, split string")
    return df.join(at, group, "left").fillna("unused", ["split"])


def diverse(df: DataFrame, key: str, traits: list[str], k: int, order: str) -> DataFrame:
    """k rows chosen one by one, each with the least used traits so far; ties by order. Candidates form one group."""

    columns = df.columns

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([order, key]).reset_index(drop=True)
        used: list[dict] = [{} for _ in traits]
        left, out = list(range(len(pdf))), []
        vals = [pdf[t].tolist() for t in traits]
        while left and len(out) < k:
            best = min(left, key=lambda i: (sum(u.get(v[i], 0) for u, v in zip(used, vals)), i))
            left.remove(best), out.append(best)
            for u, v in zip(used, vals):
                u[v[best]] = u.get(v[best], 0) + 1
        res = pdf.iloc[out].copy()
        res["turn"] = range(1, len(out) + 1)
        return res[[*columns, "turn"]]

    from pyspark.sql.types import IntegerType, StructField, StructType

    return df.withColumn("_one", F.lit(1)).groupBy("_one").applyInPandas(lambda pdf: pick(pdf.drop(columns="_one")), StructType([*df.schema.fields, StructField("turn", IntegerType())]))


def disjoint_union(parts: dict[str, DataFrame], key: str) -> tuple[DataFrame, DataFrame]:
    """(all, collisions): the labelled union of parts, and the keys that more than one of them holds."""
    u = reduce(lambda a, b: a.unionByName(b), (d.withColumn("part", F.lit(n)) for n, d in parts.items()))
    return u, u.groupBy(key).agg(F.countDistinct("part").alias("parts")).where("parts > 1")
