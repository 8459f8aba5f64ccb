"""Dataset curation: identities, exact-set joins, exclusion, seeded and stratified selection, quotas and exposures.

Seeded order is SHA-256 of `seed:identity`, so a selection is the same on any cluster and in any partitioning. Windows
are partitioned by stratum; where a stratum may be large, `stratum_top` prunes it by a histogram of hash prefixes first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import maybe_broadcast


def identity(given: Column, text: Column) -> Column:
    """The given hash, or SHA-256 of the text where it is null or blank."""
    return F.when(F.trim(given) != "", given).otherwise(F.sha2(text, 256))


def seeded(seed: str, *ids: str) -> Column:
    """SHA-256 of seed and ids, joined by colons, in lower-case hex."""
    return F.sha2(F.concat_ws(":", F.lit(seed), *(F.col(i).cast("string") for i in ids)), 256)


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """Name of the first rule that holds; null if none does. A null condition doesn't hold."""
    c = F.when(rules[0][1], rules[0][0])
    for name, cond in rules[1:]:
        c = c.when(cond, name)
    return c


def all_reasons(rules: list[tuple[str, Column]]) -> Column:
    """Names of all rules that hold, in order, joined by '|'; '' if none does."""
    return F.concat_ws("|", *(F.when(cond, F.lit(name)) for name, cond in rules))


def exact_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(side, n) of the keys that only one side has; both 0 where the key sets are equal."""
    a, b = left.select(key).distinct().withColumn("_a", F.lit(1)), right.select(key).distinct().withColumn("_b", F.lit(1))
    j = a.join(b, key, "full_outer")
    return j.agg(F.count_if(F.col("_b").isNull()).alias("left_only"), F.count_if(F.col("_a").isNull()).alias("right_only"))


def excluded(df: DataFrame, forbidden: list[tuple[DataFrame, str]]) -> DataFrame:
    """Rows that none of the forbidden sets holds by its key: one anti join for each identity, never an OR join."""
    for other, key in forbidden:
        df = df.join(other.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")
    return df


def upsert(base: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """Rows of base with those of changes in the place of equal keys; changes hold one row a key and new keys are added."""
    return base.join(changes.select(*key), key, "left_anti").unionByName(changes)


def latest(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row a key, the last in the given order; built as an aggregation, so a hot key is combined on the map side."""
    rest = [c for c in df.columns if c not in key]
    packed = F.struct(*order, *(F.col(c) for c in rest))
    top = df.groupBy(*key).agg(F.max(packed).alias("_top"))
    names = [f"_top.{c}" for c in rest]
    return top.select(*key, *names)


def stratum_top(df: DataFrame, stratum: list[str], order: Column, k: int) -> DataFrame:
    """The k smallest rows of each stratum by a hex hash, without a window over whole strata.

    A histogram of four-digit prefixes gives each stratum the prefix that holds its k-th row; only rows up to it are ranked.
    """
    d = df.withColumn("_o", order).withColumn("_p", F.substring("_o", 1, 4))
    h = d.groupBy(*stratum, "_p").agg(F.count(F.lit(1)).alias("_n"))
    cum = F.sum("_n").over(W.partitionBy(*stratum).orderBy("_p").rowsBetween(W.unboundedPreceding, -1))
    edge = h.withColumn("_c", F.coalesce(cum, F.lit(0))).where(F.col("_c") < k).groupBy(*stratum).agg(F.max("_p").alias("_edge"))
    cond = None
    e = edge.select(*(F.col(c).alias(f"_s{i}") for i, c in enumerate(stratum)), "_edge")
    for i, c in enumerate(stratum):
        x = d[c].eqNullSafe(e[f"_s{i}"])
        cond = x if cond is None else cond & x
    near = d.join(e, cond).where(F.col("_p") <= F.col("_edge"))
    rn = F.row_number().over(W.partitionBy(*stratum).orderBy("_o"))
    return near.withColumn("rank", rn).where(F.col("rank") <= k).drop("_o", "_p", "_edge", *(f"_s{i}" for i in range(len(stratum))))


def ranked(df: DataFrame, stratum: str | None, order: Column, name: str, ties: list[str] | None = None) -> DataFrame:
    """df with the rank of each row in its stratum (or in all rows) by a hex hash, without a window over whole strata.

    Rows are ranked inside ranges of hash prefixes, and offset by the counts of the ranges before, which are a few thousand
    rows a stratum. Nulls are a stratum of their own.
    """
    s = F.col(stratum) if stratum else F.lit(0)
    d = df.withColumns({"_s": s, "_o": order}).withColumn("_p", F.left("_o", F.lit(3)))
    n = d.groupBy("_s", "_p").agg(F.count(F.lit(1)).alias("_n"))
    n = n.select(F.col("_s").alias("_s2"), F.col("_p").alias("_p2"), (F.sum("_n").over(W.partitionBy("_s").orderBy("_p").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("_n")).alias("_before"))
    j = d.join(maybe_broadcast(n, 500_000), F.col("_s").eqNullSafe(F.col("_s2")) & (F.col("_p") == F.col("_p2")))
    within = F.row_number().over(W.partitionBy("_s", "_p").orderBy("_o", *(ties or [])))
    return j.withColumn(name, F.col("_before") + within).drop("_s", "_o", "_p", "_s2", "_p2", "_before")


def round_robin(df: DataFrame, stratum: str, order: Column) -> DataFrame:
    """df with place: the first of each stratum in stratum order, then the second of each, and so on.

    A place follows from the row's rank and the sizes of all strata, which are few: one array, no window over ranks.
    """
    d = ranked(df, stratum, order, "_rn")
    sizes = df.groupBy(F.col(stratum).alias("s")).agg(F.count(F.lit(1)).alias("n")).agg(F.array_sort(F.collect_list(F.struct("s", "n"))).alias("_all"))  # a row a stratum
    before = F.aggregate("_all", F.lit(0).cast("bigint"), lambda a, x: a + F.least(x["n"], F.col("_rn") - 1))
    own = F.size(F.filter("_all", lambda x: (x["s"] <= F.col(stratum)) & (x["n"] >= F.col("_rn"))))
    return d.crossJoin(F.broadcast(sizes)).withColumn("place", before + own).drop("_rn", "_all")  # one row beside each


def hamilton(counts: DataFrame, stratum: str, n: str, seats: int) -> DataFrame:
    """(stratum, n, quota): seats shared in proportion to n by largest remainder; ties by stratum."""
    total = F.sum(n).over(W.partitionBy())
    exact = F.col(n) * F.lit(float(seats)) / total
    c = counts.withColumn("_e", exact).withColumn("_f", F.floor("_e"))
    left = F.lit(seats) - F.sum("_f").over(W.partitionBy())
    rank = F.row_number().over(W.orderBy(F.desc(F.round(F.col("_e") - F.col("_f"), 9)), F.asc(stratum)))
    return c.withColumn("_l", left).withColumn("_r", rank).select(stratum, n, (F.col("_f") + F.when(F.col("_r") <= F.col("_l"), 1).otherwise(0)).cast("bigint").alias("quota"))


def split_by_quota(df: DataFrame, quotas: DataFrame, stratum: str, order: Column) -> DataFrame:
    """df with split 'train' for the first `quota` rows of each stratum in seeded order, else 'test'."""
    q = F.broadcast(quotas.select(F.col(stratum).alias("_s"), "quota"))  # one row a stratum
    d = df.join(q, F.col(stratum).eqNullSafe(F.col("_s")), "left")
    r = ranked(d.drop("_s"), stratum, order, "_rank")
    return r.withColumn("split", F.when(F.col("_rank") <= F.coalesce("quota", F.lit(0)), "train").otherwise("test")).drop("quota", "_rank")


def interleaved(df: DataFrame, band: str, order: Column) -> DataFrame:
    """df with (turn, band): the order of strict interleaving."""
    return ranked(df, band, order, "turn").withColumn("turn", F.col("turn").cast("int"))


def exposures(df: DataFrame, key: str, times: int, seed: str) -> DataFrame:
    """Each row `times` times, with a new seeded order for each exposure."""
    e = df.withColumn("exposure", F.explode(F.sequence(F.lit(1), F.lit(times))))
    return e.withColumn("order_key", F.sha2(F.concat_ws(":", F.lit(seed), F.col("exposure").cast("string"), F.col(key).cast("string")), 256))


def quota_then_fill(df: DataFrame, first: list[str], k1: int, second: list[str], k2: int, key: str, order: Column) -> DataFrame:
    """Top k1 of each first stratum, then top k2 of each second stratum among the rest; with the round that chose a row."""
    a = stratum_top(df, first, order, k1).drop("rank").withColumn("round", F.lit(1))
    rest = df.join(a.select(key), key, "left_anti")
    return a.unionByName(stratum_top(rest, second, order, k2).drop("rank").withColumn("round", F.lit(2)))


def halves(df: DataFrame, order: Column, key: str) -> DataFrame:
    """df with half 0 or 1, equal in size but for one row, in seeded order."""
    return ranked(df, None, order, "_rank", [key]).withColumn("half", ((F.col("_rank") - 1) % 2).cast("int")).drop("_rank")


def fingerprint(df: DataFrame, ident: Column) -> DataFrame:
    """(n, x0..x7, s0..s7): order-free fingerprint of a set of identities, over the eight 32-bit words of their SHA-256.

    Words are combined by xor and by an exact sum (which a set of 2^31 identities can't overflow). Equal sets give equal
    rows; it merges over parts, so it is one aggregation with partial results.
    """
    d = df.where(ident.isNotNull()).select(F.sha2(ident, 256).alias("_h"))
    w = d.select(*(F.conv(F.substring("_h", 8 * i + 1, 8), 16, 10).cast("bigint").alias(f"w{i}") for i in range(8)))
    return w.agg(F.count(F.lit(1)).alias("n"), *(F.coalesce(F.bit_xor(f"w{i}"), F.lit(0)).alias(f"x{i}") for i in range(8)), *(F.coalesce(F.sum(f"w{i}"), F.lit(0)).alias(f"s{i}") for i in range(8)))


def overlap_matrix(df: DataFrame, group: str, key: str) -> DataFrame:
    """(left, right, n): keys that two groups share, from each key's set of groups (which are few)."""
    sets = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_set(group)).alias("g")).where(F.size("g") > 1)
    a = sets.select(key, F.posexplode("g").alias("i", "left"), "g")
    b = a.select("left", F.explode(F.slice("g", F.col("i") + 2, F.size("g"))).alias("right"))
    return b.groupBy("left", "right").agg(F.count(F.lit(1)).alias("n"))
