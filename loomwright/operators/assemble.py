"""Assembling data sets: conversations, pairs, quotas over hosts, schedules, audits of packets and revisions.

Ranks are seeded hashes inside keys; nothing is ordered globally. Empty inputs give empty results; nulls in a key drop the
row from joins on it unless said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .curate import ranked


def as_strings(value_json: Column) -> Column:
    """ARRAY<STRING> of a JSON value that is a list or a single value; null and empty give an empty array."""
    t = F.trim(value_json)
    one = F.array(F.regexp_replace(t, '^"|"$', ""))
    many = F.from_json(t, "array<string>")
    return F.when(t.isNull() | t.isin("", "null"), F.array().cast("array<string>")).when(t.startswith("["), F.coalesce(many, F.array().cast("array<string>"))).otherwise(one)


def has_key(payload: Column, names: list[str]) -> Column:
    """Whether any key of a JSON text, at any depth and in any case, is one of the names."""
    keys = F.transform(F.regexp_extract_all(F.coalesce(payload, F.lit("")), F.lit(r'"([^"\\]*)"\s*:'), F.lit(1)), F.lower)
    return F.arrays_overlap(keys, F.array(*(F.lit(n.lower()) for n in names)))


def scalar_tag(value_json: Column) -> Column:
    """STRUCT<type, value> of a JSON scalar in canonical form: numbers without trailing zeros, texts trimmed."""
    t = F.trim(value_json)
    kind = F.when(t.isNull() | (t == "null"), "null").when(t.isin("true", "false"), "boolean").when(t.rlike(r"^[\[{]"), "nested").when(t.try_cast("double").isNotNull(), "number").otherwise("text")
    number = F.round(t.try_cast("double"), 6)
    return F.struct(kind.alias("type"), F.when(kind == "number", F.when(number == F.floor(number), F.format_string("%d", F.floor(number).cast("bigint"))).otherwise(F.regexp_replace(F.format_string("%.6f", number), "0+$", ""))).when(kind.isin("boolean", "nested"), t).when(kind == "text", F.trim(F.regexp_replace(t, '^"|"$', ""))).alias("value"))


def json_in(text: Column) -> Column:
    """The JSON array or object that a text holds between its first opening and last closing bracket; null if it isn't valid."""
    found = F.regexp_extract(F.coalesce(text, F.lit("")), r"(?s)(\[.*\]|\{.*\})", 1)
    return F.when((found != "") & F.try_parse_json(F.concat(F.lit('{"x":'), found, F.lit("}"))).isNotNull(), found)  # wrapped, as the parser stops after a first value


def structural_key(*parts: Column) -> Column:
    """SHA-256 of a task's parts in a fixed order; nulls count as empty."""
    return F.sha2(F.concat_ws("\x1f", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)


def plan_features(sql: Column) -> Column:
    """STRUCT of 0/1 features and counts of a statement's plan."""
    q = F.lower(F.regexp_replace(F.coalesce(sql, F.lit("")), r"\s+", " "))
    flag = lambda c: c.cast("int")
    return F.struct(flag(F.contains(q, F.lit(" group by "))).alias("grouped"), flag(F.contains(q, F.lit(" having "))).alias("having"), flag(F.contains(q, F.lit(" limit "))).alias("top"), flag(F.contains(q, F.lit("distinct "))).alias("distinct"), F.size(F.regexp_extract_all(q, F.lit(r"(\bjoin\b)"), F.lit(1))).alias("joins"), F.size(F.regexp_extract_all(q, F.lit(r"(\band\b|\bwhere\b)"), F.lit(1))).alias("conditions"))


def join_edges(sql: Column) -> Column:
    """ARRAY<STRING> `left=right` of the equalities between two qualified columns of a statement, lower case, in order."""
    q = F.lower(F.regexp_replace(F.coalesce(sql, F.lit("")), r"[`\"\[\]]", ""))
    return F.transform(F.regexp_extract_all(q, F.lit(r"([a-z_][a-z0-9_]*\.[a-z_][a-z0-9_]*\s*=\s*[a-z_][a-z0-9_]*\.[a-z_][a-z0-9_]*)"), F.lit(1)), lambda e: F.regexp_replace(e, r"\s+", ""))


def missing_anchors(text: Column, anchors: Column) -> Column:
    """The anchors (values that a rewritten text must keep) that the text lacks, signs between digits and letters aside."""
    solid = lambda c: F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]+", ""))
    return F.filter(anchors, lambda a: ~F.contains(solid(F.coalesce(text, F.lit(""))), solid(a)))


def conversation(question: Column, sql: Column, answer: Column) -> Column:
    """ARRAY<STRUCT<role, content>> that teaches: the question, the gold statement as a call, its result, the answer."""
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return F.array(turn("user", question), turn("assistant", F.concat(F.lit("<call>"), sql, F.lit("</call>"))), turn("tool", answer), turn("assistant", answer))


def pairs(samples: DataFrame, group: str, right: str, order: str) -> DataFrame:
    """(group, chosen, rejected): the first right and the first wrong sample of each group that has both."""
    g = samples.groupBy(group).agg(F.min(F.when(F.col(right), F.col(order))).alias("chosen"), F.min(F.when(~F.col(right), F.col(order))).alias("rejected"))
    return g.where("chosen is not null and rejected is not null")


def host_ranges(df: DataFrame, level: str, order: Column, quotas: DataFrame) -> DataFrame:
    """df with host: each level's rows in seeded order fall into contiguous ranges of its hosts' quotas; none beyond them.

    quotas: level, host, quota; few rows.
    """
    q = quotas.withColumn("_hi", F.sum("quota").over(W.partitionBy(level).orderBy("host"))).withColumn("_lo", F.col("_hi") - F.col("quota"))
    most = F.broadcast(q.groupBy(F.col(level).alias("_l")).agg(F.max("_hi").alias("_most")))
    d = df.join(most, F.col(level) == F.col("_l"))
    r = ranked(d.drop("_l"), level, order, "_n").where(F.col("_n") <= F.col("_most")).drop("_most")
    on = (F.col(level) == F.col("_q")) & (F.col("_n") > F.col("_lo")) & (F.col("_n") <= F.col("_hi"))
    return r.join(F.broadcast(q.select(F.col(level).alias("_q"), "host", "_lo", "_hi")), on).drop("_q", "_n", "_lo", "_hi")


def padded(df: DataFrame, order: Column, chunks: int) -> DataFrame:
    """df with chunk and padding: rows dealt in seeded order to `chunks` chunks; a chunk short of the longest names its missing rows.

    One row per chunk: (chunk, rows, padding).
    """
    dealt = df.withColumn("chunk", F.pmod(F.conv(F.substring(order, 1, 8), 16, 10).cast("bigint"), F.lit(chunks)))
    n = dealt.groupBy("chunk").agg(F.count(F.lit(1)).alias("rows"))
    return n.withColumn("padding", F.max("rows").over(W.partitionBy()) - F.col("rows"))  # at most `chunks` rows


def epoch_order(df: DataFrame, position: str, epochs: int) -> DataFrame:
    """df once for each epoch with `turn`, the place in the whole run: positions keep their order in every epoch."""
    n = df.agg(F.max(position).alias("_m"))
    e = df.crossJoin(F.broadcast(n)).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))  # one row beside each
    return e.withColumn("turn", F.col("epoch") * (F.col("_m") + 1) + F.col(position)).drop("_m")


def schema_rows(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, position, column_name, type) of the schemas; no data is read."""
    rows = [(t, i + 1, f.name, f.dataType.simpleString()) for t, d in sorted(tables.items()) for i, f in enumerate(d.schema.fields)]
    return spark.createDataFrame(rows, "table_name string, position int, column_name string, type string")


def parameter_grid(spark: SparkSession, sizes: dict[str, int], level: str, per_level: int, seed: str) -> DataFrame:
    """The combinations of parameters 0..n-1 by index arithmetic over a range; the first `per_level` of each level by a hash."""
    total, out = 1, None
    for n in sizes.values():
        total *= n
    out, step = spark.range(total), 1
    for name, n in sizes.items():
        out, step = out.withColumn(name, F.floor(F.col("id") / step) % n), step * n
    key = F.sha2(F.concat_ws(":", F.lit(seed), *(F.col(c).cast("string") for c in sizes)), 256)
    return out.withColumn("_n", F.row_number().over(W.partitionBy(level).orderBy(key))).where(F.col("_n") <= per_level).drop("_n", "id")


def confirmed(prior: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """(key, correct, wrong, errors, reasons, accepted): counts of prior and fresh samples together, and why a task is rejected."""
    b = prior.select(key, "correct", "wrong", "errors").unionByName(fresh.select(key, "correct", "wrong", "errors")).groupBy(key).agg(*(F.sum(c).alias(c) for c in ("correct", "wrong", "errors")))
    d = b.join(fresh.select(key).distinct(), key, "left_semi")
    # fixed values: the reasons and their bounds
    reasons = F.array_compact(F.array(F.when(F.col("correct") < 2, "too_few_correct"), F.when(F.col("wrong") < 2, "too_few_wrong"), F.when(F.col("errors") > 0, "runtime_error")))
    return d.withColumn("reasons", F.array_join(reasons, ",")).withColumn("accepted", F.col("reasons") == "")


def carried(previous: DataFrame, current: DataFrame, key: str, same: list[str], text: str) -> DataFrame:
    """current with text and state: the previous text where all of `same` are equal, nulls included; else null and pending."""
    p = previous.select(F.col(key).alias("_k"), *(F.col(c).alias(f"_{c}") for c in same), F.col(text).alias("_t"))
    ok = F.lit(True)
    for c in same:
        ok = ok & F.col(c).eqNullSafe(F.col(f"_{c}"))
    d = current.drop(text).join(p, F.col(key) == F.col("_k"), "left").withColumn("_ok", F.col("_k").isNotNull() & ok & (F.trim("_t") != ""))
    return d.withColumn(text, F.when(F.col("_ok"), F.col("_t"))).withColumn("state", F.when(F.coalesce("_ok", F.lit(False)), "carried").otherwise("pending")).drop("_k", "_t", "_ok", *(f"_{c}" for c in same))


def drift(left: DataFrame, right: DataFrame, key: str, values: str, tol: float) -> DataFrame:
    """(key, state, drift): stored against replayed lists of numbers, by position; another length is a mismatch."""
    d = left.select(key, F.col(values).alias("_a")).join(right.select(key, F.col(values).alias("_b")), key)
    off = F.coalesce(F.array_max(F.zip_with("_a", "_b", lambda a, b: F.abs(a - b))), F.lit(0.0))
    return d.select(key, F.when(F.size("_a") != F.size("_b"), "mismatch").when(off <= tol, "same").otherwise("drifted").alias("state"), F.when(F.size("_a") == F.size("_b"), F.round(off, 6)).alias("drift"))


def decision(df: DataFrame, name: str, floors: dict[str, float]) -> DataFrame:
    """df of one summary row with the decision: the first measure below its floor, or pass."""
    out = F.lit("pass")
    for c, floor in reversed(floors.items()):
        out = F.when(F.coalesce(F.col(c) < floor, F.lit(True)), F.lit(f"below_{c}")).otherwise(out)
    return df.withColumn(name, out)


def recovery(df: DataFrame, key: str, arm: str, ok: str, control: str) -> DataFrame:
    """(arm, tasks, successes, rescued, regressions) of each other arm against the control at the grain of tasks."""
    t = df.groupBy(key, arm).agg(F.max(F.col(ok).cast("int")).alias("_s"))
    c = t.where(F.col(arm) == control).select(F.col(key).alias("_k"), F.col("_s").alias("_c"))
    j = t.where(F.col(arm) != control).join(c, F.col(key) == F.col("_k"))
    return j.groupBy(arm).agg(F.count(F.lit(1)).alias("tasks"), F.sum("_s").cast("bigint").alias("successes"), F.count_if((F.col("_s") == 1) & (F.col("_c") == 0)).alias("rescued"), F.count_if((F.col("_s") == 0) & (F.col("_c") == 1)).alias("regressions"))


def offset_transition(before: Column, after: Column) -> Column:
    """How the first divergence moved: none, cleared, new, same, later or earlier; null offsets mean no divergence."""
    return F.when(before.isNull() & after.isNull(), "none").when(after.isNull(), "cleared").when(before.isNull(), "new").when(after == before, "same").when(after > before, "later").otherwise("earlier")


def pair_margins(df: DataFrame, pair: str, role: str, score: str, family: str) -> DataFrame:
    """(family, pairs, positive, mean_margin) of chosen minus rejected scores."""
    p = df.groupBy(pair).agg(F.max(family).alias(family), F.max(F.when(F.col(role) == "chosen", F.col(score))).alias("_c"), F.max(F.when(F.col(role) == "rejected", F.col(score))).alias("_r"))
    d = p.where("_c is not null and _r is not null").withColumn("_m", F.col("_c") - F.col("_r"))
    return d.groupBy(family).agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("_m") > 0).alias("positive"), F.round(F.avg("_m"), 6).alias("mean_margin"))


def component_change(before: DataFrame, after: DataFrame, key: list[str], component: str, loss: str) -> DataFrame:
    """(component, n, mean_delta, ratio, wins, losses, ties): change of a loss per component, ratio of geometric mean probabilities."""
    d = before.select(*key, component, F.col(loss).alias("_a")).join(after.select(*key, component, F.col(loss).alias("_b")), [*key, component]).withColumn("_d", F.col("_b") - F.col("_a"))
    return d.groupBy(component).agg(F.count("_d").alias("n"), F.round(F.avg("_d"), 6).alias("mean_delta"), F.round(F.exp(-F.avg("_d")), 6).alias("ratio"), F.count_if(F.col("_d") < -1e-12).alias("wins"), F.count_if(F.col("_d") > 1e-12).alias("losses"), F.count_if(F.abs("_d") <= 1e-12).alias("ties"))


def boundary(df: DataFrame, complete: Column, measures: list[str]) -> DataFrame:
    """(complete, n, measure columns' means, boundaries): profile of complete and incomplete rows; one boundary means a common limit."""
    return df.groupBy(complete.alias("complete")).agg(F.count(F.lit(1)).alias("n"), *(F.round(F.avg(m), 4).alias(f"mean_{m}") for m in measures), *(F.countDistinct(m).alias(f"distinct_{m}") for m in measures))


def scenarios(spark: SparkSession, contexts: list[int], widths: list[int], capacity: int) -> DataFrame:
    """(context, width, tokens, fits) of a stated grid; both lists are few."""
    c = spark.createDataFrame([(x,) for x in contexts], "context long")
    w = spark.createDataFrame([(x,) for x in widths], "width long")
    return c.crossJoin(F.broadcast(w)).withColumn("tokens", F.col("context") * F.col("width")).withColumn("fits", F.col("tokens") <= capacity)


def packet_audit(parts: dict[str, DataFrame], key: str) -> DataFrame:
    """(part, rows, missing, repeated, contiguous): whether each part has every index 0..n-1 of the first part once."""
    names = list(parts)
    first = parts[names[0]].select(key).distinct()
    out = None
    for name in names:
        d = parts[name]
        miss = first.join(d.select(key).distinct(), key, "left_anti").agg(F.count(F.lit(1)).alias("missing"))
        n = d.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(key).alias("_u"), F.min(key).alias("_lo"), F.max(key).alias("_hi"))
        one = n.crossJoin(miss).select(F.lit(name).alias("part"), "rows", "missing", (F.col("rows") - F.col("_u")).alias("repeated"), F.coalesce((F.col("_lo") == 0) & (F.col("_hi") == F.col("_u") - 1), F.lit(False)).alias("contiguous"))  # one row each
        out = one if out is None else out.unionByName(one)
    return out


def strata_present(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n) of every combination of the values of two columns (few), those without rows with 0."""
    n = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    grid = n.select(a).distinct().crossJoin(n.select(b).distinct())  # values of two small domains, after aggregation
    return grid.join(n, [a, b], "left").fillna(0, ["n"])


def single_valued(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, values, nulls, single): which columns hold one value only and no null."""
    agg = df.agg(*(F.countDistinct(c).alias(f"v{i}") for i, c in enumerate(columns)), *(F.count_if(F.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(columns)))
    return agg.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"v{i}").alias("values"), F.col(f"n{i}").alias("nulls"), ((F.col(f"v{i}") == 1) & (F.col(f"n{i}") == 0)).alias("single")) for i, c in enumerate(columns)))))


def with_suffix(text: Column, suffix: str, old: str | None = None) -> Column:
    """text with `suffix` at its end, in place of `old` where it ends so; unchanged where it has it already."""
    t = F.when(text.endswith(old), F.left(text, F.length(text) - len(old))).otherwise(text) if old else text
    return F.when(text.endswith(suffix), text).otherwise(F.concat(t, F.lit(suffix)))


def holdout(full: DataFrame, training: DataFrame, key: str, version: str) -> DataFrame:
    """(version, full, training, held, exact): what each version holds beyond its training rows, and whether the counts add up."""
    f = full.groupBy(version).agg(F.countDistinct(key).alias("full"))
    t = training.groupBy(version).agg(F.countDistinct(key).alias("training"))
    h = full.join(training.select(key).distinct(), key, "left_anti").groupBy(version).agg(F.countDistinct(key).alias("held"))
    d = f.join(t, version, "left").join(h, version, "left").fillna(0, ["training", "held"])
    return d.withColumn("exact", F.col("full") == F.col("training") + F.col("held"))
