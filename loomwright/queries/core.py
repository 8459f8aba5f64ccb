"""Queries of the core over whole tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import closeness, sql_text
from ..functions import tables as tbl
from ..functions import text as tx
from ..operators import audit, curate, groups, more, nested, scoring, select, stats, telemetry
from ..operators import trajectories as traj
from ..plans.query_plan import Join, QueryPlan, baseline_gap, filled, period_change, share, weighted_score
from ..session import table
from ..sources import readers, synthetic
from ..streaming import resample

Query = Callable[[SparkSession, str], DataFrame]
_Q: dict[str, tuple[Query, str | None]] = {}


def add(name: str, fn: Query, sql: str | None = None) -> None:
    _Q[name] = (fn, sql)


def state(name: str, sql: str) -> None:
    """Give a query the SQL that must agree with it."""
    _Q[name] = (_Q[name][0], sql)


# --- plans: scans, filters, joins, metrics, having, top-k -------------------------------------------------------------
_GEO = (Join("supplier", "l_suppkey", "s_suppkey"), Join("nation", "s_nationkey", "n_nationkey"), Join("region", "n_regionkey", "r_regionkey"))
_LINES = "FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
FLAGSHIP = QueryPlan("lineitem", "sum", "l_extendedprice", _GEO, date="l_shipdate", month="1996-03", equal=(("l_returnflag", "R"),), group="n_name", least_rows=3, top=5)
add(
    "plan_star_top_k",
    FLAGSHIP.to_df,
    f"SELECT n_name AS category, round(sum(l_extendedprice), 2) AS value {_LINES} WHERE l_shipdate >= TIMESTAMP '1996-03-01' AND l_shipdate < TIMESTAMP '1996-04-01' AND l_returnflag = 'R' GROUP BY n_name HAVING count(*) >= 3 ORDER BY value DESC, category LIMIT 5",
)
add(
    "plan_scalar_quarter",
    QueryPlan("lineitem", "mean", "l_quantity", date="l_shipdate", month="1997-01", months=3, equal=(("l_linestatus", "O"),), differ=(("l_returnflag", "A"),)).to_df,
    "SELECT round(avg(l_quantity), 2) AS value FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1997-04-01' AND l_linestatus = 'O' AND l_returnflag <> 'A'",
)
add(
    "plan_distinct_by_region",
    QueryPlan("orders", "distinct", "o_custkey", (Join("customer", "o_custkey", "c_custkey"), Join("nation", "c_nationkey", "n_nationkey"), Join("region", "n_regionkey", "r_regionkey")), within=(("o_orderstatus", ("F", "O")),), group="r_name", least_rows=10).to_df,
    "SELECT r_name AS category, CAST(count(DISTINCT o_custkey) AS DOUBLE) AS value FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_orderstatus IN ('F', 'O') GROUP BY r_name HAVING count(*) >= 10",
)
def _shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "shipments")
    c = table(spark, sf_dir, "carriers").select(F.col("carrier_id").alias("_c"), "carrier_name", "carrier_level")
    return s.join(c, s.carrier_id == F.col("_c")).drop("_c")


add(
    "plan_delay_rate",
    lambda s, d: _shipments(s, d).where("status = 'delivered'").groupBy(F.col("carrier_name").alias("category")).agg(F.round(F.lit(100.0) * F.sum("delayed_flag") / F.count(F.lit(1)), 2).alias("value"), F.count(F.lit(1)).alias("n")).where("n >= 20").drop("n").orderBy(F.desc("value"), "category").limit(10),
    "SELECT carrier_name AS category, round(100.0 * sum(delayed_flag) / count(*), 2) AS value FROM shipments s JOIN carriers c ON s.carrier_id = c.carrier_id WHERE status = 'delivered' GROUP BY carrier_name HAVING count(*) >= 20 ORDER BY value DESC, category LIMIT 10",
)
add(
    "plan_month_equality",
    lambda s, d: table(s, d, "orders").where(F.date_format("o_orderdate", "yyyy-MM").isin("1996-05", "1996-06")).groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month"), "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")),
    "SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE strftime(o_orderdate, '%Y-%m') IN ('1996-05', '1996-06') GROUP BY 1, 2",
)
add(
    "filter_filled_dimension",
    lambda s, d: table(s, d, "customers").where(filled(F.col("customer_segment"))).groupBy("customer_segment").agg(F.count(F.lit(1)).alias("n")),
    "SELECT customer_segment, count(*) AS n FROM customers WHERE customer_segment IS NOT NULL AND trim(customer_segment) <> '' GROUP BY 1",
)


def _stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with two 1:1 stages built from their lines; all joins share one key."""
    line = table(spark, sf_dir, "lineitem")
    pick = line.groupBy(F.col("l_orderkey").alias("k1")).agg(F.sum("l_quantity").alias("pick_hours"))
    move = line.groupBy(F.col("l_orderkey").alias("k2")).agg(F.round(F.avg("l_tax"), 6).alias("move_hours"))
    o = table(spark, sf_dir, "orders")
    return o.join(pick, o.o_orderkey == F.col("k1")).join(move, o.o_orderkey == F.col("k2")).drop("k1", "k2")


_STAGES = "SELECT o.*, p.pick_hours, m.move_hours FROM orders o JOIN (SELECT l_orderkey k1, sum(l_quantity) pick_hours FROM lineitem GROUP BY 1) p ON o_orderkey = k1 JOIN (SELECT l_orderkey k2, round(avg(l_tax), 6) move_hours FROM lineitem GROUP BY 1) m ON o_orderkey = k2"
add(
    "join_stage_facts",
    lambda s, d: _stages(s, d).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("pick_hours") + 10 * F.col("move_hours")), 2).alias("total_hours"), F.round(F.avg(F.abs(F.col("pick_hours") - 100 * F.col("move_hours"))), 2).alias("gap")),
    f"SELECT o_orderpriority, count(*) AS n, round(avg(pick_hours + 10 * move_hours), 2) AS total_hours, round(avg(abs(pick_hours - 100 * move_hours)), 2) AS gap FROM ({_STAGES}) GROUP BY 1",
)
add(
    "plan_period_change",
    lambda s, d: period_change(table(s, d, "orders"), "o_orderpriority", "o_orderdate", "o_totalprice", "1996-06", "1996-05", 1),
    "WITH g AS (SELECT o_orderpriority AS category, avg(o_totalprice) FILTER (WHERE strftime(o_orderdate, '%Y-%m') = '1996-06') AS a, avg(o_totalprice) FILTER (WHERE strftime(o_orderdate, '%Y-%m') = '1996-05') AS b FROM orders GROUP BY 1) SELECT category, round((a - b) * 100.0 / b, 2) AS value FROM g WHERE a IS NOT NULL AND b IS NOT NULL AND b <> 0",
)
add(
    "plan_share",
    lambda s, d: share(_stages(s, d).withColumn("m100", F.col("move_hours") * 100), "o_orderpriority", "pick_hours", ["pick_hours", "m100"]),
    f"SELECT o_orderpriority AS category, round(avg(pick_hours) * 100.0 / (avg(pick_hours) + avg(move_hours * 100)), 2) AS value FROM ({_STAGES}) GROUP BY 1",
)
add(
    "plan_baseline_gap",
    lambda s, d: baseline_gap(_shipments(s, d).where("weight_kg is not null"), "service_level", "weight_kg", 5),
    "WITH b AS (SELECT s.* FROM shipments s JOIN carriers c ON s.carrier_id = c.carrier_id WHERE weight_kg IS NOT NULL), o AS (SELECT avg(weight_kg) AS a FROM b) SELECT service_level AS category, round((avg(weight_kg) - max(a)) * 100.0 / max(a), 2) AS value FROM b CROSS JOIN o GROUP BY 1 HAVING count(*) >= 5",
)
add(
    "plan_weighted_score",
    lambda s, d: weighted_score(_shipments(s, d).groupBy(F.col("carrier_name").alias("category")).agg(F.avg("delivery_hours").alias("h"), F.avg("delayed_flag").alias("f"), F.count(F.lit(1)).alias("n")), {"h": 0.5, "f": 0.3, "n": 0.2}),
    "WITH g AS (SELECT carrier_name AS category, avg(delivery_hours) h, avg(delayed_flag) f, count(*) n FROM shipments s JOIN carriers c ON s.carrier_id = c.carrier_id GROUP BY 1) SELECT category, round((coalesce(0.5 * h / nullif(max(h) OVER (), 0), 0) + coalesce(0.3 * f / nullif(max(f) OVER (), 0), 0) + 0.2 * n / max(n) OVER ()) * 100.0, 2) AS value FROM g",
)

# --- groups -----------------------------------------------------------------------------------------------------------


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as samples: a user is a task, a purchase is right, value is the reward, the day is the step."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("task"), "event_id", "ts", (F.col("event_type") == "purchase").alias("correct"), (F.col("event_type") == "error").alias("error"), (F.col("event_type") == "signup").alias("timeout"),
        F.col("value").alias("reward"), (F.datediff("ts", F.lit("2024-01-01")) + 1).cast("bigint").alias("step"), F.get_json_object("props", "$.k").cast("bigint").alias("k"), "event_type",
    )


_S = "SELECT user_id AS task, event_id, ts, event_type = 'purchase' AS correct, event_type = 'error' AS error, event_type = 'signup' AS timeout, value AS reward, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) + 1 AS BIGINT) AS step, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type FROM events"


def over(fn: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: fn(_samples(spark, sf_dir))


add("group_histogram", lambda s, d: groups.histogram(table(s, d, "training_record"), "data_source"), "SELECT data_source, count(*) AS n FROM training_record GROUP BY 1")
add(
    "group_task_buckets",
    over(lambda x: groups.task_buckets(x, "task", "correct", "timeout", "error")),
    f"WITH s AS ({_S}), g AS (SELECT task, count(*) samples, CAST(sum(correct::INT) AS BIGINT) correct, CAST(sum(timeout::INT) AS BIGINT) timeouts, CAST(sum(error::INT) AS BIGINT) errors FROM s GROUP BY 1) SELECT *, CASE WHEN errors > 0 THEN 'runtime_error' WHEN timeouts > 0 THEN 'timed_out' WHEN correct = 0 THEN 'all_wrong' WHEN correct >= samples THEN 'all_correct' ELSE 'mixed' END AS bucket FROM g",
)
add(
    "group_task_buckets_strict",
    over(lambda x: groups.task_buckets(x, "task", "correct", "timeout", "error", strict=True).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))),
    f"WITH s AS ({_S}), g AS (SELECT task, count(*) samples, sum(correct::INT) correct, sum(error::INT) errors FROM s GROUP BY 1) SELECT CASE WHEN errors > 0 THEN 'runtime_error' WHEN correct = 0 THEN 'all_wrong' WHEN correct >= samples THEN 'all_correct' ELSE 'mixed' END AS bucket, count(*) AS n FROM g GROUP BY 1",
)
add(
    "group_margins",
    over(lambda x: groups.margins(x, ["step", "task"], "correct", "reward")),
    f"WITH s AS ({_S}), g AS (SELECT step, task, count(*) n, CAST(sum(correct::INT) AS BIGINT) correct, round(min(reward) FILTER (WHERE correct) - max(reward) FILTER (WHERE NOT correct), 6) margin, round(max(reward) - min(reward), 6) reward_range FROM s GROUP BY 1, 2) SELECT *, correct > 0 AND correct < n AS mixed, coalesce(margin > 0, false) AS ranked FROM g",
)
add(
    "group_gate",
    over(lambda x: groups.group_gate(x.withColumn("eligible", ~F.col("error")), "task", "correct", "eligible", "step", 2)),
    f"WITH s AS ({_S}), g AS (SELECT task, count(*) n, min((NOT error)::INT) e, count(DISTINCT step) v, min(correct::INT) lo, max(correct::INT) hi FROM s GROUP BY 1) SELECT task, n, CASE WHEN n <> 2 THEN 'wrong_size' WHEN e = 0 THEN 'ineligible' WHEN v <> 1 THEN 'mixed_versions' WHEN lo = hi THEN 'no_contrast' ELSE 'active' END AS state FROM g",
)
add(
    "window_advantages",
    over(lambda x: groups.advantages(x, "task", "reward").select("event_id", "task", "advantage")),
    f"WITH s AS ({_S}) SELECT event_id, task, CASE WHEN stddev_pop(reward) OVER w > 1e-12 THEN round((reward - avg(reward) OVER w) / stddev_pop(reward) OVER w, 6) ELSE 0.0 END AS advantage FROM s WINDOW w AS (PARTITION BY task)",
)
add(
    "window_advantage_audit",
    over(lambda x: groups.advantage_audit(groups.advantages(x, "task", "reward"), "task", "correct", "advantage")),
    f"WITH s AS ({_S}), a AS (SELECT *, CASE WHEN stddev_pop(reward) OVER w > 1e-12 THEN round((reward - avg(reward) OVER w) / stddev_pop(reward) OVER w, 6) ELSE 0.0 END AS adv, min(correct::INT) OVER w < max(correct::INT) OVER w AS m FROM s WINDOW w AS (PARTITION BY task)) SELECT CASE WHEN adv > 0 THEN 'positive' WHEN adv < 0 THEN 'negative' ELSE 'zero' END AS sign, count(*) AS n FROM a WHERE m AND NOT correct GROUP BY 1",
)
add(
    "window_exposure",
    over(lambda x: groups.exposure(x, "k", ["ts", "event_id"]).groupBy("exposure").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("reward"), 4).alias("mean"))),
    f"WITH s AS ({_S}), e AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ts, event_id) AS x FROM s) SELECT CAST(x AS INTEGER) AS exposure, count(*) AS n, round(avg(reward), 4) AS mean FROM e GROUP BY 1",
)
add(
    "group_edge_windows",
    over(lambda x: groups.edge_windows(x, "step", "reward", 5)),
    f"WITH s AS ({_S}), t AS (SELECT step, row_number() OVER (ORDER BY step) a, row_number() OVER (ORDER BY step DESC) b FROM (SELECT DISTINCT step FROM s)), e AS (SELECT step, 'first' edge FROM t WHERE a <= 5 UNION ALL SELECT step, 'last' FROM t WHERE b <= 5) SELECT edge, count(reward) AS n, round(avg(reward), 6) AS mean, count(*) FILTER (WHERE reward > 0) AS positive FROM s JOIN e USING (step) GROUP BY 1",
)
add("group_step_bins", over(lambda x: groups.bins(x, "step", 6, "reward")), f"WITH s AS ({_S}) SELECT CAST(floor((step - 1) / 6) AS BIGINT) AS bin, count(reward) AS n, round(avg(reward), 6) AS mean FROM s GROUP BY 1")
add(
    "group_describe",
    over(lambda x: groups.describe(x, "reward", ["event_type"])),
    f"WITH s AS ({_S}) SELECT event_type, count(reward) AS n, min(reward) AS min, round(avg(reward), 6) AS mean, round(quantile_cont(reward, 0.5), 6) AS median, round(quantile_cont(reward, 0.25), 6) AS p25, round(quantile_cont(reward, 0.75), 6) AS p75, round(quantile_cont(reward, 0.9), 6) AS p90, round(quantile_cont(reward, 0.95), 6) AS p95, max(reward) AS max, round(stddev_pop(reward), 6) AS std FROM s GROUP BY 1",
)
add(
    "group_nearest_rank",
    lambda s, d: groups.nearest_rank(table(s, d, "trajectory"), "response_tokens", [0.5, 0.9, 0.95], ["num_turns"]),
    "SELECT num_turns, count(response_tokens) AS n, quantile_disc(response_tokens, 0.5) AS p50, quantile_disc(response_tokens, 0.9) AS p90, quantile_disc(response_tokens, 0.95) AS p95 FROM trajectory WHERE response_tokens IS NOT NULL GROUP BY 1",
)
_HALF = "SELECT task, CASE WHEN sum(correct::INT) = 0 THEN 'all_wrong' WHEN sum(correct::INT) = count(*) THEN 'all_correct' ELSE 'mixed' END AS bucket"


def _halves(x: DataFrame) -> tuple[DataFrame, DataFrame]:
    label = lambda y: y.groupBy("task").agg(groups.bucket(F.sum(F.col("correct").cast("int")), F.count(F.lit(1))).alias("bucket"))
    return label(x.where("step <= 15")), label(x.where("step > 15"))


add(
    "group_transitions",
    over(lambda x: groups.transitions(*_halves(x), "task", "bucket")),
    f"WITH s AS ({_S}), a AS ({_HALF} FROM s WHERE step <= 15 GROUP BY 1), b AS ({_HALF} FROM s WHERE step > 15 GROUP BY 1) SELECT a.bucket AS left_label, b.bucket AS right_label, count(*) AS n FROM a JOIN b USING (task) GROUP BY 1, 2",
)
add(
    "group_zero_filled",
    over(lambda x: groups.zero_filled(x.groupBy("task").agg(F.sum(F.col("correct").cast("int")).alias("c")), "c", 8)),
    f"WITH s AS ({_S}), h AS (SELECT CAST(sum(correct::INT) AS BIGINT) c FROM s GROUP BY task) SELECT r.v AS value, count(h.c) AS n FROM (SELECT CAST(range AS BIGINT) v FROM range(9)) r LEFT JOIN h ON h.c = r.v GROUP BY 1",
)
add(
    "group_confusion",
    over(lambda x: groups.confusion(x.select(F.when(F.col("reward") > 60, "PASS").when(F.col("reward") > 20, "UNKNOWN").otherwise("FAIL").alias("auto"), F.when(F.col("correct"), "PASS").when(F.col("error"), "FAIL").otherwise("UNKNOWN").alias("human")), "auto", "human", ["PASS", "FAIL", "UNKNOWN"])),
    f"WITH s AS ({_S}), t AS (SELECT CASE WHEN reward > 60 THEN 'PASS' WHEN reward > 20 THEN 'UNKNOWN' ELSE 'FAIL' END a, CASE WHEN correct THEN 'PASS' WHEN error THEN 'FAIL' ELSE 'UNKNOWN' END h FROM s) SELECT a AS auto_state, count(*) FILTER (WHERE h = 'PASS') AS human_pass, count(*) FILTER (WHERE h = 'FAIL') AS human_fail, count(*) FILTER (WHERE h = 'UNKNOWN') AS human_unknown FROM t GROUP BY 1",
)
add(
    "group_set_transition",
    over(lambda x: groups.set_transition(x.groupBy("task").agg(F.min("event_type").alias("source")), x.where("step <= 15 and correct"), x.where("step > 15 and correct"), "task", "source")),
    f"WITH s AS ({_S}), u AS (SELECT task, min(event_type) source FROM s GROUP BY 1), b AS (SELECT DISTINCT task, 1 x FROM s WHERE step <= 15 AND correct), a AS (SELECT DISTINCT task, 1 x FROM s WHERE step > 15 AND correct) SELECT source, count(*) FILTER (WHERE b.x = 1 AND a.x = 1) AS retained, count(*) FILTER (WHERE b.x = 1 AND a.x IS NULL) AS lost, count(*) FILTER (WHERE b.x IS NULL AND a.x = 1) AS gained, count(*) FILTER (WHERE b.x IS NULL AND a.x IS NULL) AS neither FROM u LEFT JOIN b USING (task) LEFT JOIN a USING (task) GROUP BY 1",
)
add(
    "group_conflicts",
    lambda s, d: groups.conflicts(table(s, d, "training_record").select(F.col("extra_info.instruction_sha256").alias("h"), F.col("extra_info.gold_sha256").alias("g")), "h", "g"),
    "SELECT extra_info.instruction_sha256 AS h, count(DISTINCT extra_info.gold_sha256) AS n_values FROM training_record WHERE extra_info.instruction_sha256 IS NOT NULL GROUP BY 1 HAVING count(DISTINCT extra_info.gold_sha256) > 1",
)
add(
    "group_duplicate_pairs",
    over(lambda x: groups.duplicate_pairs(x, "task", "k")),
    f"WITH s AS ({_S}), c AS (SELECT task, k, count(*) c FROM s GROUP BY 1, 2) SELECT task, CAST(sum(c) AS BIGINT) AS n, count(*) AS n_distinct, round(coalesce(sum(c * (c - 1) / 2) / nullif(sum(c) * (sum(c) - 1) / 2, 0), 0), 6) AS duplicate_share FROM c GROUP BY 1",
)
add(
    "group_merged_counts",
    over(lambda x: groups.merged_counts([groups.histogram(x.where("step <= 10"), "event_type"), groups.histogram(x.where("step > 10"), "event_type")], "event_type", "n")),
    "SELECT event_type, count(*) AS n FROM events GROUP BY 1",
)
add(
    "group_command_families",
    lambda s, d: table(s, d, "trajectory").select(F.explode("pi_tool_events").alias("e")).groupBy(F.col("e.name").alias("tool"), F.coalesce(F.col("e.ok"), F.lit(False)).alias("ok")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("e.arguments.command").alias("distinct_commands")),
    "SELECT e.name AS tool, coalesce(e.ok, false) AS ok, count(*) AS n, count(DISTINCT e.arguments.command) AS distinct_commands FROM (SELECT unnest(pi_tool_events) AS e FROM trajectory) GROUP BY 1, 2",
)

# --- curation ---------------------------------------------------------------------------------------------------------
add(
    "curate_identity",
    lambda s, d: table(s, d, "training_record").select("record_id", curate.identity(F.col("extra_info.instruction_sha256"), F.element_at(F.filter("prompt", lambda m: m["role"] == "user"), -1)["content"]).alias("identity")),
    "SELECT record_id, CASE WHEN trim(extra_info.instruction_sha256) <> '' THEN extra_info.instruction_sha256 ELSE sha256(list_filter(prompt, lambda x: x.role = 'user')[-1].content) END AS identity FROM training_record",
)
add(
    "curate_review_reasons",
    lambda s, d: table(s, d, "task").select("task_no", curate.first_reason([("unreviewed", F.col("qa_status").isNull()), ("not_passed", F.col("qa_status") != "passed"), ("no_level", F.col("difficulty_level").isNull()), ("no_tables", F.coalesce(F.size("expected_tables") <= 0, F.lit(True)))]).alias("reason"), curate.all_reasons([("unreviewed", F.col("qa_status").isNull()), ("no_level", F.col("difficulty_level").isNull()), ("no_type", F.col("task_type").isNull())]).alias("reasons")),
    "SELECT task_no, CASE WHEN qa_status IS NULL THEN 'unreviewed' WHEN qa_status <> 'passed' THEN 'not_passed' WHEN difficulty_level IS NULL THEN 'no_level' WHEN expected_tables IS NULL OR len(expected_tables) = 0 THEN 'no_tables' END AS reason, concat_ws('|', CASE WHEN qa_status IS NULL THEN 'unreviewed' END, CASE WHEN difficulty_level IS NULL THEN 'no_level' END, CASE WHEN task_type IS NULL THEN 'no_type' END) AS reasons FROM task",
)
add(
    "curate_exact_keys",
    lambda s, d: curate.exact_keys(table(s, d, "task").select("task_id"), table(s, d, "training_record").select(F.col("reward_model.ground_truth.task_id").alias("task_id")).where("task_id is not null"), "task_id"),
    "WITH a AS (SELECT DISTINCT task_id FROM task), b AS (SELECT DISTINCT reward_model.ground_truth.task_id AS task_id FROM training_record WHERE reward_model.ground_truth.task_id IS NOT NULL) SELECT (SELECT count(*) FROM a WHERE task_id NOT IN (SELECT task_id FROM b)) AS left_only, (SELECT count(*) FROM b WHERE task_id NOT IN (SELECT task_id FROM a)) AS right_only",
)


def _split_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "training_record").select("record_id", F.col("extra_info.source_label").alias("label"), F.col("extra_info.instruction_sha256").alias("ih"), F.col("extra_info.gold_sha256").alias("gh"), F.col("reward_model.ground_truth.task_id").alias("tid"))
    return r.join(table(spark, sf_dir, "source_spec").select("label", "split"), "label")


_R = "SELECT r.record_id, s.split, s.label, r.extra_info.instruction_sha256 ih, r.extra_info.gold_sha256 gh, r.reward_model.ground_truth.task_id tid FROM training_record r JOIN source_spec s ON s.label = r.extra_info.source_label"


def _leak_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _split_records(spark, sf_dir)
    held = r.where("split <> 'train'")
    return curate.excluded(r.where("split = 'train'"), [(held, "tid"), (held, "ih"), (held, "gh")]).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


add(
    "curate_leakage_exclusion",
    _leak_free,
    f"WITH r AS ({_R}), h AS (SELECT * FROM r WHERE split <> 'train') SELECT label, count(*) AS n FROM r WHERE split = 'train' AND NOT EXISTS (SELECT 1 FROM h WHERE h.tid = r.tid) AND NOT EXISTS (SELECT 1 FROM h WHERE h.ih = r.ih) AND NOT EXISTS (SELECT 1 FROM h WHERE h.gh = r.gh) GROUP BY 1",
)
add(
    "curate_overlap_matrix",
    lambda s, d: curate.overlap_matrix(_split_records(s, d), "split", "ih"),
    f'WITH r AS (SELECT DISTINCT split, ih FROM ({_R}) WHERE ih IS NOT NULL) SELECT a.split AS "left", b.split AS "right", count(*) AS n FROM r a JOIN r b ON a.ih = b.ih AND a.split < b.split GROUP BY 1, 2',
)
add(
    "curate_latest",
    lambda s, d: curate.latest(table(s, d, "shipments"), ["shipment_id"], [F.col("loaded_at").alias("_o")]).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.max("loaded_at").alias("newest")),
    "SELECT status, count(*) AS n, max(loaded_at) AS newest FROM (SELECT * FROM shipments QUALIFY row_number() OVER (PARTITION BY shipment_id ORDER BY loaded_at DESC, ship_date DESC) = 1) GROUP BY 1",
)


def _upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "trajectory").select("trajectory_id", "record_id", "sample_index", "response_tokens", "trajectory_timeout")
    base = t.groupBy("record_id", "sample_index").agg(F.min_by(F.struct("trajectory_id", "response_tokens", "trajectory_timeout"), "trajectory_id").alias("x")).select("record_id", "sample_index", "x.*")
    retry = t.groupBy("record_id", "sample_index").agg(F.max_by(F.struct("trajectory_id", "response_tokens", "trajectory_timeout"), "trajectory_id").alias("x"), F.count(F.lit(1)).alias("c")).where("c > 1").select("record_id", "sample_index", "x.*")
    return curate.upsert(base, retry, ["record_id", "sample_index"])


add("curate_upsert_retries", _upsert, "SELECT record_id, sample_index, trajectory_id, response_tokens, trajectory_timeout FROM trajectory QUALIFY row_number() OVER (PARTITION BY record_id, sample_index ORDER BY trajectory_id DESC) = 1")
add(
    "curate_seeded_top",
    lambda s, d: curate.stratum_top(table(s, d, "task").select("task_no", "task_id", "task_type"), ["task_type"], curate.seeded("seed7", "task_id"), 20),
    "SELECT * FROM (SELECT task_no, task_id, task_type, CAST(row_number() OVER (PARTITION BY task_type ORDER BY sha256('seed7:' || task_id)) AS INTEGER) AS rank FROM task) WHERE rank <= 20",
)
add(
    "curate_round_robin",
    lambda s, d: curate.round_robin(table(s, d, "task").select("task_no", "task_id", F.coalesce("task_type", F.lit("none")).alias("stratum")), "stratum", curate.seeded("s", "task_id")).select("task_no", "stratum", "place"),
    "WITH r AS (SELECT task_no, coalesce(task_type, 'none') AS stratum, row_number() OVER (PARTITION BY coalesce(task_type, 'none') ORDER BY sha256('s:' || task_id)) rn FROM task) SELECT task_no, stratum, row_number() OVER (ORDER BY rn, stratum) AS place FROM r",
)


def _quota_counts(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "task").groupBy(F.coalesce("difficulty_level", F.lit(0)).alias("level")).agg(F.count(F.lit(1)).alias("n"))


_QUOTA = "WITH c AS (SELECT coalesce(difficulty_level, 0) AS level, count(*) n FROM task GROUP BY 1), e AS (SELECT level, n, n * 100.0 / sum(n) OVER () AS x FROM c), f AS (SELECT *, floor(x) b, row_number() OVER (ORDER BY round(x - floor(x), 9) DESC, level) r, 100 - sum(floor(x)) OVER () AS l FROM e), q AS (SELECT level, n, CAST(b + CASE WHEN r <= l THEN 1 ELSE 0 END AS BIGINT) AS quota FROM f)"
add("curate_hamilton_quota", lambda s, d: curate.hamilton(_quota_counts(s, d), "level", "n", 100), f"{_QUOTA} SELECT * FROM q")
add(
    "curate_quota_split",
    lambda s, d: curate.split_by_quota(table(s, d, "task").select("task_no", "task_id", F.coalesce("difficulty_level", F.lit(0)).alias("level")), curate.hamilton(_quota_counts(s, d), "level", "n", 100), "level", curate.seeded("sp", "task_id")).groupBy("level", "split").agg(F.count(F.lit(1)).alias("n"), F.min("task_no").alias("first")),
    f"{_QUOTA}, r AS (SELECT task_no, coalesce(difficulty_level, 0) AS level, row_number() OVER (PARTITION BY coalesce(difficulty_level, 0) ORDER BY sha256('sp:' || task_id)) rn FROM task) SELECT level, CASE WHEN rn <= quota THEN 'train' ELSE 'test' END AS split, count(*) AS n, min(task_no) AS first FROM r JOIN q USING (level) GROUP BY 1, 2",
)
add(
    "curate_exposures",
    lambda s, d: curate.exposures(table(s, d, "source_spec").select("label"), "label", 3, "x"),
    "SELECT label, CAST(e AS INTEGER) AS exposure, sha256('x:' || e || ':' || label) AS order_key FROM source_spec, (SELECT unnest([1, 2, 3]) AS e)",
)
add(
    "curate_quota_then_fill",
    lambda s, d: curate.quota_then_fill(table(s, d, "task").select("task_no", "task_id", "task_type", "difficulty_level"), ["task_type"], 5, ["difficulty_level"], 5, "task_no", curate.seeded("q", "task_id")).select("task_no", "round"),
    "WITH a AS (SELECT task_no FROM task QUALIFY row_number() OVER (PARTITION BY task_type ORDER BY sha256('q:' || task_id)) <= 5), b AS (SELECT task_no FROM task WHERE task_no NOT IN (SELECT task_no FROM a) QUALIFY row_number() OVER (PARTITION BY difficulty_level ORDER BY sha256('q:' || task_id)) <= 5) SELECT task_no, 1 AS round FROM a UNION ALL SELECT task_no, 2 FROM b",
)
add(
    "curate_interleaved",
    lambda s, d: curate.interleaved(table(s, d, "task").select("task_no", "task_id", "difficulty_level").where("difficulty_level is not null"), "difficulty_level", curate.seeded("i", "task_id")).select("task_no", "difficulty_level", "turn"),
    "SELECT * FROM (SELECT task_no, difficulty_level, CAST(row_number() OVER (PARTITION BY difficulty_level ORDER BY sha256('i:' || task_id)) AS INTEGER) AS turn FROM task WHERE difficulty_level IS NOT NULL)",
)
_WORDS = [f"CAST('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT)" for i in range(8)]
add(
    "curate_fingerprint",
    lambda s, d: curate.fingerprint(table(s, d, "task"), F.col("task_id")),
    "WITH t AS (SELECT sha256(task_id) AS h FROM task WHERE task_id IS NOT NULL) SELECT count(*) AS n, " + ", ".join(f"bit_xor({w}) AS x{i}, CAST(sum({w}) AS BIGINT) AS s{i}" for i, w in enumerate(_WORDS)) + " FROM t",
)
add("curate_halves", lambda s, d: curate.halves(table(s, d, "task").select("task_no", "task_id"), curate.seeded("h", "task_id"), "task_no").select("task_no", "half"), "SELECT task_no, CAST((row_number() OVER (ORDER BY sha256('h:' || task_id), task_no) - 1) % 2 AS INTEGER) AS half FROM task")

# --- text -------------------------------------------------------------------------------------------------------------
_SQLCOL = "reward_model.ground_truth.verification_sql"
add(
    "text_sql_tables",
    lambda s, d: table(s, d, "training_record").select("record_id", F.array_join(tx.table_names(F.col(_SQLCOL)), ",").alias("tables")),
    rf"SELECT record_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all({_SQLCOL}, '(?i)\b(?:from|join)\s+[`\[\x22]?([A-Za-z_][A-Za-z0-9_]*)', 1), lambda x: lower(x)))), ',') AS tables FROM training_record",
)
add("text_sql_aggregates", lambda s, d: table(s, d, "training_record").select(F.explode(tx.aggregate_calls(F.col(_SQLCOL))).alias("call")).groupBy("call").agg(F.count(F.lit(1)).alias("n")))
add("text_sql_where", lambda s, d: table(s, d, "training_record").select("record_id", F.array_join(tx.where_literals(F.col(_SQLCOL)), "|").alias("literals"), F.array_join(tx.where_numbers(F.col(_SQLCOL)), "|").alias("numbers")))
add("text_read_only", lambda s, d: table(s, d, "training_record").groupBy(tx.read_only(F.col(_SQLCOL)).alias("read_only")).agg(F.count(F.lit(1)).alias("n")))
add("text_final_answer", lambda s, d: table(s, d, "trajectory").select("trajectory_id", F.sha2(tx.final_answer(F.col("trajectory_output")), 256).alias("answer_sha256")))
add("text_command_families", lambda s, d: table(s, d, "trajectory").select(F.explode("pi_tool_events").alias("e")).groupBy(tx.command_family(F.col("e.arguments.command")).alias("family")).agg(F.count(F.lit(1)).alias("n")))
add(
    "text_openings",
    lambda s, d: table(s, d, "task").groupBy(tx.masked_opening(F.col("natural_language_instruction")).alias("opening")).agg(F.count(F.lit(1)).alias("n")),
)
add(
    "text_field_use",
    lambda s, d: table(s, d, "training_record").select("record_id", F.col(_SQLCOL).alias("q"), F.explode("reward_model.ground_truth.must_use_fields").alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("n"), F.count_if(tx.uses_identifier(F.col("q"), F.col("f"))).alias("used")),
    r"SELECT f, count(*) AS n, count(*) FILTER (WHERE regexp_matches(' ' || lower(q) || ' ', '[^a-z0-9_]' || f || '[^a-z0-9_]')) AS used FROM (SELECT reward_model.ground_truth.verification_sql q, unnest(reward_model.ground_truth.must_use_fields) f FROM training_record) WHERE f IS NOT NULL GROUP BY 1",
)
add(
    "text_messages_profile",
    lambda s, d: table(s, d, "chat_log").select("chat_id", F.size(F.filter("messages", lambda m: m["role"] == "assistant")).alias("turns"), F.aggregate("messages", F.lit(0), lambda a, m: a + F.coalesce(F.size(m["tool_calls"]), F.lit(0)) * F.when(m["tool_calls"].isNull(), 0).otherwise(1)).alias("calls"), F.aggregate("messages", F.lit(0), lambda a, m: a + F.coalesce(F.length(m["content"]), F.lit(0))).alias("chars")),
    "SELECT chat_id, CAST(len(list_filter(messages, lambda m: m.role = 'assistant')) AS INTEGER) AS turns, CAST(coalesce(list_sum(list_transform(messages, lambda m: coalesce(len(m.tool_calls), 0))), 0) AS INTEGER) AS calls, CAST(coalesce(list_sum(list_transform(messages, lambda m: coalesce(length(m.content), 0))), 0) AS INTEGER) AS chars FROM chat_log",
)


def _answered(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "trajectory").select("trajectory_id", "record_id", "final_answer", "pi_tool_events", "response_tokens", "runtime_error", "trajectory_timeout")
    g = table(s, d, "training_record").select("record_id", F.col("reward_model.ground_truth").alias("g"))
    return t.join(g, "record_id")


# --- verification and scoring -----------------------------------------------------------------------------------------
add("verify_answers", lambda s, d: _answered(s, d).select(tbl.match_mode("final_answer", "g.expected_value_json", "g.abs_tol", "g.rel_tol", audit.order_binding(F.col("g.verification_sql"), F.lit(""))).alias("mode"), "g.answer_type").groupBy("answer_type", "mode").agg(F.count(F.lit(1)).alias("n")))
add("verify_projection", lambda s, d: _answered(s, d).groupBy(more.projects("final_answer", "g.expected_value_json").alias("projects")).agg(F.count(F.lit(1)).alias("n")))
add("verify_closeness", lambda s, d: _answered(s, d).select("trajectory_id", closeness.closeness(F.col("final_answer"), F.col("g.expected_value_json")).alias("closeness")))


def _scored(s: SparkSession, d: str) -> DataFrame:
    x = _samples(s, d)
    cost = scoring.efficiency(F.col("k") % 20, F.col("reward") * 400, F.col("reward") / 100, F.lit(0.0))
    return x.withColumn("cost", F.round(cost, 9))


_COST = f"WITH s AS ({_S}), e AS (SELECT *, round(least(1, 0.5 * least(1, ln(1 + greatest(k % 20 - 4, 0)) / ln(9.0)) + 0.3 * least(1, ln(1 + greatest(reward * 400 - 4000, 0) / 4000) / ln(4.0)) + 0.2 * 0.5 * least(1, greatest(0, reward / 100))), 9) AS cost FROM s)"
add("score_efficiency", lambda s, d: _scored(s, d).select("event_id", F.round("cost", 6).alias("cost")), f"{_COST} SELECT event_id, round(cost, 6) AS cost FROM e")


def _tiered(s: SparkSession, d: str) -> DataFrame:
    x = _scored(s, d)
    layer, reward, mask = scoring.tiered(F.col("k") > 95, F.col("k") > 90, F.col("timeout"), ~F.col("error"), F.col("k") % 3 > 0, F.col("correct"), F.col("cost"))
    return x.select(layer.alias("layer"), reward.alias("r"), mask.alias("m")).groupBy("layer").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("r"), 5).alias("mean_reward"), F.sum("m").alias("trained"))


add(
    "score_tiered",
    _tiered,
    f"{_COST}, l AS (SELECT *, CASE WHEN k > 90 THEN 'unsafe_or_budget' WHEN timeout THEN 'unknown' WHEN error THEN 'no_attempt' WHEN NOT k % 3 > 0 THEN 'attempt_failed' WHEN NOT correct THEN 'success_wrong_final' ELSE 'success_correct_final' END AS layer FROM e) SELECT layer, count(*) AS n, round(avg(round(CASE layer WHEN 'attempt_failed' THEN 0.1 * (1 - cost) WHEN 'success_wrong_final' THEN 0.2 * (1 - cost) WHEN 'success_correct_final' THEN 1 - 0.2 * cost ELSE 0 END, 6)), 5) AS mean_reward, sum(CASE WHEN layer = 'unknown' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END) AS trained FROM l GROUP BY 1",
)
add(
    "score_banded",
    lambda s, d: _samples(s, d).select("event_id", scoring.banded(~F.col("error"), F.col("k") > 3, F.col("correct"), F.col("k") % 2 == 0, F.col("reward") / 100).alias("reward")),
    f"WITH s AS ({_S}) SELECT event_id, CASE WHEN error OR k <= 3 THEN 0.0 ELSE round(CASE WHEN correct AND k % 2 = 0 THEN 0.8 + 0.2 * q WHEN correct THEN 0.65 + 0.1 * q WHEN k % 2 = 0 THEN 0.4 + 0.1 * q ELSE 0.1 + 0.2 * q END, 6) END AS reward FROM (SELECT *, least(1.0, greatest(0.0, s.reward / 100)) AS q FROM s)",
)
add(
    "score_tri_state",
    lambda s, d: _samples(s, d).groupBy(scoring.tri_state(F.col("k") > 5, ~F.col("timeout"), F.when(F.col("correct"), "PASS").when(F.col("error"), "FAIL").otherwise("UNKNOWN"), F.col("reward") > 10).alias("state")).agg(F.count(F.lit(1)).alias("n")),
    f"WITH s AS ({_S}) SELECT CASE WHEN k <= 5 OR timeout THEN 'UNKNOWN' WHEN correct THEN CASE WHEN reward > 10 THEN 'PASS' ELSE 'FAIL' END WHEN error THEN 'FAIL' ELSE 'UNKNOWN' END AS state, count(*) AS n FROM s GROUP BY 1",
)
add("score_gated_process", lambda s, d: _samples(s, d).select("event_id", scoring.gated_process(~F.col("error"), F.col("correct"), F.col("reward") / 100).alias("reward")), f"WITH s AS ({_S}) SELECT event_id, round(CASE WHEN error OR NOT correct THEN 0 ELSE 1 + 0.1 * least(1.0, greatest(0.0, reward / 100)) END, 6) AS reward FROM s")
add(
    "score_observed_mean",
    lambda s, d: _samples(s, d).select("event_id", scoring.observed_mean([(F.when(F.col("k") % 2 == 0, F.col("reward")), 0.3), (F.when(F.col("k") % 3 == 0, F.col("reward") * 2), 0.7)]).alias("score")),
    f"WITH s AS ({_S}) SELECT event_id, round((CASE WHEN k % 2 = 0 THEN reward * 0.3 ELSE 0 END + CASE WHEN k % 3 = 0 THEN reward * 2 * 0.7 ELSE 0 END) / nullif(CASE WHEN k % 2 = 0 THEN 0.3 ELSE 0 END + CASE WHEN k % 3 = 0 THEN 0.7 ELSE 0 END, 0), 6) AS score FROM s",
)

# --- statistics -------------------------------------------------------------------------------------------------------


def _wilson(x: DataFrame) -> DataFrame:
    g = x.groupBy("step").agg(F.sum(F.col("correct").cast("bigint")).alias("c"), F.count(F.lit(1)).alias("n"))
    low, high = stats.wilson(F.col("c"), F.col("n"))
    return g.select("step", "c", "n", low.alias("low"), high.alias("high"))


add(
    "stats_wilson",
    over(_wilson),
    f"WITH s AS ({_S}), g AS (SELECT step, CAST(sum(correct::INT) AS BIGINT) c, count(*) n, 1.959963984540054::DOUBLE z FROM s GROUP BY 1), h AS (SELECT *, c::DOUBLE / n p FROM g) SELECT step, c, n, round(greatest(0, (p + z * z / (2 * n)) / (1 + z * z / n) - z * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n)) / (1 + z * z / n)), 6) AS low, round(least(1, (p + z * z / (2 * n)) / (1 + z * z / n) + z * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n)) / (1 + z * z / n)), 6) AS high FROM h",
)
add(
    "stats_pearson",
    over(lambda x: stats.pearson(x, "reward", "k", ["event_type"])),
    f"WITH s AS ({_S}) SELECT event_type, count(*) AS n, round(corr(reward, k), 4) AS r FROM s WHERE reward IS NOT NULL AND k IS NOT NULL GROUP BY 1",
)


def _rates(x: DataFrame) -> DataFrame:
    g = x.groupBy("task").agg(F.avg(F.when(F.col("step") <= 15, F.col("correct").cast("int"))).alias("p"), F.avg(F.when(F.col("step") > 15, F.col("correct").cast("int"))).alias("q"))
    return g.where("p is not null and q is not null").select("task", stats.bernoulli_js(F.col("p"), F.col("q")).alias("js"))


add(
    "stats_js_divergence",
    over(_rates),
    f"WITH s AS ({_S}), g AS (SELECT task, avg(correct::INT) FILTER (WHERE step <= 15) p, avg(correct::INT) FILTER (WHERE step > 15) q FROM s GROUP BY 1), m AS (SELECT *, (p + q) / 2 m FROM g WHERE p IS NOT NULL AND q IS NOT NULL) SELECT task, round((CASE WHEN p > 0 THEN p * log2(p / m) ELSE 0 END + CASE WHEN p < 1 THEN (1 - p) * log2((1 - p) / (1 - m)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / m) ELSE 0 END + CASE WHEN q < 1 THEN (1 - q) * log2((1 - q) / (1 - m)) ELSE 0 END) / 2, 6) AS js FROM m",
)


def _arms(x: DataFrame) -> tuple[DataFrame, DataFrame]:
    arm = lambda y: y.groupBy("task").agg(F.round(F.avg("reward"), 6).alias("score"))
    return arm(x.where("step <= 15")), arm(x.where("step > 15"))


_ARMS = f"WITH s AS ({_S}), d AS (SELECT task, round(avg(reward) FILTER (WHERE step > 15), 6) - round(avg(reward) FILTER (WHERE step <= 15), 6) AS x FROM s GROUP BY 1)"
add("stats_paired", over(lambda x: stats.paired(*_arms(x), "task", "score")), f"{_ARMS} SELECT count(x) AS n, count(*) FILTER (WHERE x > 1e-12) AS wins, count(*) FILTER (WHERE x < -1e-12) AS losses, count(*) FILTER (WHERE abs(x) <= 1e-12) AS ties, round(avg(x), 6) AS mean_delta FROM d")
add("stats_sign_test", over(lambda x: stats.paired(*_arms(x), "task", "score").select("wins", "losses", stats.sign_test("wins", "losses").alias("p_value"))))
add("stats_bootstrap", over(lambda x: stats.bootstrap(x.select("event_id", "reward"), "reward", ["event_id"], 500)))
add("stats_paired_bootstrap", over(lambda x: stats.paired_bootstrap(*_arms(x), "task", "score", 500)))
add(
    "stats_timeout_bounds",
    over(lambda x: stats.timeout_bounds(x.groupBy("step").agg(F.max("reward").alias("slowest")), "slowest", [200.0, 300.0, 400.0])),
    f"WITH s AS ({_S}), g AS (SELECT step, max(reward) m FROM s GROUP BY 1) SELECT CAST(t AS DOUBLE) AS threshold, count(*) FILTER (WHERE m > t) AS steps, round(count(*) FILTER (WHERE m > t) / count(*)::DOUBLE, 6) AS share FROM g, (SELECT unnest([200.0, 300.0, 400.0]) AS t) GROUP BY 1",
)
add(
    "stats_gates",
    over(lambda x: stats.gates(x.agg(F.count(F.lit(1)).alias("n"), F.avg("reward").alias("m"), F.max("step").alias("s")), {"enough_rows": F.col("n") > 100, "mean_in_range": F.col("m").between(40, 60), "all_steps": F.col("s") >= 31})),
    f"WITH s AS ({_S}), g AS (SELECT count(*) n, avg(reward) m, max(step) t FROM s) SELECT 'enough_rows' AS rule, n > 100 AS passed FROM g UNION ALL SELECT 'mean_in_range', m BETWEEN 40 AND 60 FROM g UNION ALL SELECT 'all_steps', t >= 31 FROM g",
)

# --- telemetry and state ----------------------------------------------------------------------------------------------
add(
    "telemetry_throughput",
    over(lambda x: telemetry.throughput(x.withColumn("one", F.lit(1)).withColumn("ts", F.col("ts").cast("timestamp")), "ts", "ts", "one", "k", ["event_type"])),
    f"WITH s AS ({_S}) SELECT event_type, round(count(*) / h, 4) AS items_per_hour, round(sum(k) / h, 4) AS tokens_per_hour FROM (SELECT *, (epoch_us(max(ts) OVER (PARTITION BY event_type)) - epoch_us(min(ts) OVER (PARTITION BY event_type))) / 3600000000.0 AS h FROM s) GROUP BY event_type, h",
)
add(
    "telemetry_step_metrics",
    over(lambda x: telemetry.step_metrics(x.select("event_id", F.concat(F.lit("step:"), F.col("step").cast("string"), F.lit(" - actor/k:"), F.col("k").cast("string"), F.lit(" - reward:"), F.format_string("%.2f", "reward")).alias("line")), "line", "event_id")),
    f"WITH s AS ({_S}) SELECT step, 'actor/k' AS metric, CAST(arg_max(k, event_id) AS DOUBLE) AS value FROM s GROUP BY 1 UNION ALL SELECT step, 'reward', arg_max(reward, event_id) FROM s GROUP BY 1",
)
add(
    "telemetry_last_counters",
    over(lambda x: telemetry.last_counters(x.withColumn("hits", F.least("k", F.lit(50))), "task", "event_id", "hits", "k")),
    f"WITH s AS ({_S}) SELECT task, least(arg_max(k, event_id), 50) AS hits, arg_max(k, event_id) AS queries, round(least(arg_max(k, event_id), 50) / nullif(arg_max(k, event_id), 0)::DOUBLE, 6) AS hit_rate FROM s GROUP BY 1",
)


def _buffered(x: DataFrame) -> DataFrame:
    return resample.resample_batch(x.select(F.col("task").cast("string").alias("group"), F.col("event_id").alias("ord"), F.when(F.col("correct"), "PASS").when(F.col("error"), "FAIL").otherwise("UNKNOWN").alias("verdict")))


add("state_resample_buffer", over(_buffered))
add(
    "state_waves",
    over(lambda x: resample.waves(x, "task", "event_id", "correct")),
    f"WITH s AS ({_S}), r AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY event_id) rn FROM s), p AS (SELECT task, (rn - 1) // 2 + 1 AS wave, count(*) n, sum(correct::INT) c FROM r WHERE rn <= 8 GROUP BY 1, 2), q AS (SELECT task, wave, CAST(sum(n) OVER w AS BIGINT) samples, CAST(sum(c) OVER w AS BIGINT) correct FROM p WINDOW w AS (PARTITION BY task ORDER BY wave)), m AS (SELECT *, correct > 0 AND correct < samples AS mixed FROM q), b AS (SELECT *, coalesce(max(mixed::INT) OVER (PARTITION BY task ORDER BY wave ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM m) SELECT task, wave, samples, correct, CASE WHEN mixed THEN 'mixed' WHEN wave = 4 THEN 'unresolved' ELSE 'continue' END AS state FROM b WHERE before = 0",
)
add(
    "state_pending",
    lambda s, d: resample.pending(table(s, d, "training_record").select("record_id"), table(s, d, "trajectory"), ["record_id"]),
    "SELECT record_id FROM training_record WHERE record_id NOT IN (SELECT record_id FROM trajectory WHERE record_id IS NOT NULL)",
)

# --- audits -----------------------------------------------------------------------------------------------------------
add(
    "audit_keys",
    lambda s, d: audit.key_audit(table(s, d, "shipments"), ["shipment_id"]),
    "WITH g AS (SELECT shipment_id k, count(*) n FROM shipments GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS rows, count(k) AS distinct_keys, CAST(coalesce(sum(n) FILTER (WHERE k IS NULL), 0) AS BIGINT) AS null_keys, count(*) FILTER (WHERE n > 1 AND k IS NOT NULL) AS duplicate_keys FROM g",
)
add(
    "audit_references",
    lambda s, d: audit.reference_audit(table(s, d, "shipments"), "carrier_id", table(s, d, "carriers"), "carrier_id"),
    "SELECT carrier_id AS value, count(*) AS n FROM shipments WHERE carrier_id IS NOT NULL AND carrier_id NOT IN (SELECT carrier_id FROM carriers) GROUP BY 1",
)
add(
    "audit_checks",
    lambda s, d: audit.check_audit(table(s, d, "shipments"), {"weight_positive": F.col("weight_kg") > 0, "amount_not_negative": F.col("freight_amount") >= 0, "hours_known": F.col("delivery_hours").isNotNull()}),
    'WITH s AS (SELECT weight_kg > 0 a, freight_amount >= 0 b, delivery_hours IS NOT NULL c FROM shipments) SELECT \'weight_positive\' AS "check", count(*) FILTER (WHERE a) AS passed, count(*) FILTER (WHERE NOT a) AS failed, count(*) FILTER (WHERE a IS NULL) AS unknown FROM s UNION ALL SELECT \'amount_not_negative\', count(*) FILTER (WHERE b), count(*) FILTER (WHERE NOT b), count(*) FILTER (WHERE b IS NULL) FROM s UNION ALL SELECT \'hours_known\', count(*) FILTER (WHERE c), count(*) FILTER (WHERE NOT c), count(*) FILTER (WHERE c IS NULL) FROM s',
)
add(
    "audit_field_summary",
    lambda s, d: audit.field_summary(table(s, d, "shipments"), ["weight_kg", "delivery_hours"]),
    "SELECT 'weight_kg' AS field, count(weight_kg) AS present, count(*) - count(weight_kg) AS missing, round(avg(weight_kg), 6) AS mean, round(count(*) FILTER (WHERE weight_kg > 0) / nullif(count(weight_kg), 0)::DOUBLE, 6) AS positive_rate FROM shipments UNION ALL SELECT 'delivery_hours', count(delivery_hours), count(*) - count(delivery_hours), round(avg(delivery_hours), 6), round(count(*) FILTER (WHERE delivery_hours > 0) / nullif(count(delivery_hours), 0)::DOUBLE, 6) FROM shipments",
)
add(
    "audit_formula",
    lambda s, d: audit.formula_mismatches(table(s, d, "shipments"), "delayed_flag", (F.col("delivery_hours") > 72).cast("int"), "service_level"),
    "SELECT service_level, count(*) AS n, count(*) FILTER (WHERE delayed_flag IS DISTINCT FROM (delivery_hours > 72)::INT) AS mismatches FROM shipments GROUP BY 1",
)
add(
    "audit_alignment",
    lambda s, d: table(s, d, "training_record").select(audit.alignment_reasons(F.element_at(F.filter("prompt", lambda m: m["role"] == "user"), -1)["content"], F.col(_SQLCOL), F.col("reward_model.ground_truth.answer_type")).alias("warnings")).groupBy("warnings").agg(F.count(F.lit(1)).alias("n")),
)
add("audit_order_binding", lambda s, d: table(s, d, "training_record").groupBy(audit.order_binding(F.col(_SQLCOL), F.element_at(F.filter("prompt", lambda m: m["role"] == "user"), -1)["content"]).alias("bound"), F.col("reward_model.ground_truth.answer_type").alias("answer_type")).agg(F.count(F.lit(1)).alias("n")))
add(
    "audit_bag_difference",
    lambda s, d: audit.bag_difference(table(s, d, "shipments").select("carrier_id", "status"), table(s, d, "shipments").dropDuplicates(["shipment_id"]).select("carrier_id", "status")),
    "SELECT count(*) - count(DISTINCT shipment_id) AS only_left, CAST(0 AS BIGINT) AS only_right FROM shipments",
)
add(
    "audit_openings",
    lambda s, d: audit.opening_gate(table(s, d, "task"), "natural_language_instruction"),
)
add("verify_numbers_match", lambda s, d: _answered(s, d).groupBy(F.col("g.answer_type").alias("answer_type"), audit.numbers_match(F.col("final_answer"), F.col("g.expected_value_json")).alias("matched")).agg(F.count(F.lit(1)).alias("n")))
add(
    "audit_delta_drivers",
    over(lambda x: audit.delta_drivers(x.groupBy("task").agg(*(F.round(F.coalesce(F.avg(F.when(c, v)), F.lit(0.0)), 6).alias(n) for n, c, v in (("a1", F.col("step") <= 15, F.col("reward")), ("b1", F.col("step") > 15, F.col("reward")), ("a2", F.col("step") <= 15, F.col("k")), ("b2", F.col("step") > 15, F.col("k"))))), "task", {"reward_part": (0.5 * F.col("a1"), 0.5 * F.col("b1")), "k_part": (0.5 * F.col("a2"), 0.5 * F.col("b2"))}, (F.round(0.5 * F.col("a1") + 0.5 * F.col("a2"), 2), F.round(0.5 * F.col("b1") + 0.5 * F.col("b2"), 2))).agg(F.count(F.lit(1)).alias("n"), F.max(F.abs(F.col("rest"))).alias("largest_rest"))),
)

# --- trajectories and selection ---------------------------------------------------------------------------------------
add(
    "traj_event_profile",
    lambda s, d: traj.event_profile(table(s, d, "trajectory")).select("trajectory_id", "events", "ok_events", "queries", "tool_tokens"),
    "SELECT trajectory_id, CAST(coalesce(len(pi_tool_events), 0) AS INTEGER) AS events, CAST(len(list_filter(coalesce(pi_tool_events, []), lambda e: coalesce(e.ok, false))) AS INTEGER) AS ok_events, CAST(coalesce(list_sum(list_transform(coalesce(pi_tool_events, []), lambda e: coalesce(len(e.sql_statements), 0))), 0) AS INTEGER) AS queries, CAST(coalesce(list_sum(list_transform(coalesce(pi_tool_events, []), lambda e: coalesce(e.response_token_count, 0))), 0) AS BIGINT) AS tool_tokens FROM trajectory",
)
add("traj_valid_events", lambda s, d: traj.event_profile(table(s, d, "trajectory")).groupBy("all_valid").agg(F.count(F.lit(1)).alias("n"), F.sum("valid_events").alias("valid"), F.sum("distinct_queries").alias("distinct_queries")))
add(
    "traj_recovered_within",
    lambda s, d: traj.recovered_within(table(s, d, "trajectory").select(traj.first_index(F.col("pi_tool_events"), lambda e: e["ok"] & (e["name"] == "bash")).alias("i")), "i", [1, 2, 3]),
    "WITH i AS (SELECT (SELECT min(x) FROM (SELECT unnest(range(len(pi_tool_events))) x) q WHERE pi_tool_events[x + 1].ok AND pi_tool_events[x + 1].name = 'bash') AS i FROM trajectory) SELECT count(*) AS n, count(*) FILTER (WHERE i < 1) AS within_1, count(*) FILTER (WHERE i < 2) AS within_2, count(*) FILTER (WHERE i < 3) AS within_3, count(i) AS any_hit, count(*) FILTER (WHERE i IS NULL) AS never FROM i",
)
add(
    "traj_paired_calls",
    lambda s, d: table(s, d, "chat_log").select("chat_id", F.explode(traj.paired_calls(F.col("messages"))).alias("c")).groupBy("c.name", F.col("c.response").isNotNull().alias("answered")).agg(F.count(F.lit(1)).alias("n")),
    "WITH c AS (SELECT chat_id, messages, unnest(list_transform(list_filter(messages, lambda m: m.tool_calls IS NOT NULL), lambda m: m.tool_calls)) cs FROM chat_log), e AS (SELECT messages, unnest(cs) c FROM c) SELECT c.name AS name, coalesce(list_filter(messages, lambda m: m.role = 'tool' AND m.tool_call_id = c.id)[1].content IS NOT NULL, false) AS answered, count(*) AS n FROM e GROUP BY 1, 2",
)


def _conclusions(s: SparkSession, d: str) -> DataFrame:
    value, reason = traj.unique_conclusion(F.col("final_answer"))
    return table(s, d, "trajectory").select(value.alias("v"), reason.alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.count("v").alias("with_value"))


add("traj_unique_conclusion", _conclusions)
add("traj_path_states", lambda s, d: table(s, d, "trajectory").select(F.explode("pi_tool_events").alias("e")).groupBy(traj.path_state(F.col("e.arguments.path")).alias("state")).agg(F.count(F.lit(1)).alias("n")))
add(
    "traj_outcome_ladder",
    over(lambda x: x.groupBy(traj.outcome_ladder(F.col("k") > 2, F.col("correct"), ~F.col("error"), F.col("k") % 2 == 0, F.col("reward") > 30).alias("score")).agg(F.count(F.lit(1)).alias("n"))),
    f"WITH s AS ({_S}) SELECT CAST(CASE WHEN correct AND k % 2 = 0 THEN 1 WHEN correct THEN 0.85 WHEN k % 2 = 0 AND reward > 30 THEN 0.2 WHEN k % 2 = 0 THEN 0.15 WHEN NOT error OR k > 2 THEN 0.05 ELSE 0 END AS DOUBLE) AS score, count(*) AS n FROM s GROUP BY 1",
)
add(
    "traj_outcome_classes",
    over(lambda x: x.groupBy(traj.outcome_class(F.when(F.col("k") > 10, F.lit("q")), F.col("error"), F.col("k") % 7, F.col("correct")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))),
    f"WITH s AS ({_S}) SELECT CASE WHEN NOT k > 10 THEN 'no_query' WHEN error THEN 'execution_error' WHEN k % 7 = 0 THEN 'empty' WHEN correct THEN 'verified' ELSE 'wrong' END AS outcome, count(*) AS n FROM s GROUP BY 1",
)
add(
    "traj_first_divergence",
    over(lambda x: x.groupBy("task").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("step") <= 15, F.struct("event_id", "event_type")))), lambda e: e["event_type"]).alias("a"), F.transform(F.array_sort(F.collect_list(F.when(F.col("step") > 15, F.struct("event_id", "event_type")))), lambda e: e["event_type"]).alias("b")).select("task", traj.first_divergence(F.col("a"), F.col("b")).alias("at"))),
    f"WITH s AS ({_S}), r AS (SELECT task, event_type, step <= 15 AS early, row_number() OVER (PARTITION BY task, step <= 15 ORDER BY event_id) - 1 AS i FROM s), j AS (SELECT coalesce(a.task, b.task) task, coalesce(a.i, b.i) i, a.event_type x, b.event_type y FROM (SELECT * FROM r WHERE early) a FULL JOIN (SELECT * FROM r WHERE NOT early) b ON a.task = b.task AND a.i = b.i) SELECT task, CAST(min(i) FILTER (WHERE x IS DISTINCT FROM y) AS INTEGER) AS at FROM j GROUP BY 1",
)
add(
    "select_risk",
    lambda s, d: table(s, d, "task").select("task_no", select.risk(F.col("expected_tables"), {"shipments": 2, "carriers": 3}).alias("risk")),
    "SELECT task_no, CAST(coalesce(list_sum(list_transform(expected_tables, lambda t: CASE t WHEN 'shipments' THEN 2 WHEN 'carriers' THEN 3 ELSE 1 END)), 0) AS INTEGER) AS risk FROM task",
)
add(
    "select_pools",
    lambda s, d: select.pools(table(s, d, "task").select("task_no", "task_id", "task_type", "difficulty_level"), "task_no", [("hard", F.col("difficulty_level") >= 4, 30), ("untyped", F.col("task_type").isNull(), 20), ("rest", F.lit(True), 50)], curate.seeded("p", "task_id")).select("task_no", "pool", "place"),
    "WITH p AS (SELECT task_no, task_id, CASE WHEN difficulty_level >= 4 THEN 'hard' WHEN task_type IS NULL THEN 'untyped' ELSE 'rest' END AS pool FROM task), r AS (SELECT task_no, pool, CAST(row_number() OVER (PARTITION BY pool ORDER BY sha256('p:' || task_id), task_no) AS INTEGER) AS place FROM p) SELECT * FROM r WHERE place <= CASE pool WHEN 'hard' THEN 30 WHEN 'untyped' THEN 20 ELSE 50 END",
)
add(
    "select_in_order",
    lambda s, d: select.in_order(table(s, d, "nation").select("n_name", "n_nationkey"), "n_nationkey", [7, 3, 11]),
    "SELECT n_name, n_nationkey, CAST(list_position([7, 3, 11], n_nationkey) AS BIGINT) AS position FROM nation WHERE n_nationkey IN (7, 3, 11)",
)
add(
    "select_reviewed",
    lambda s, d: select.reviewed(table(s, d, "task").select("task_id"), table(s, d, "training_record").select(F.col("reward_model.ground_truth.task_id").alias("task_id"), F.col("extra_info.training_allowed").alias("ok"), F.col("extra_info.gold_sha256").isNotNull().alias("gold")), ["task_id"], ["ok", "gold"]).groupBy("decision").agg(F.count(F.lit(1)).alias("n")),
    "WITH r AS (SELECT reward_model.ground_truth.task_id AS task_id, bool_and(coalesce(extra_info.training_allowed, false) AND extra_info.gold_sha256 IS NOT NULL) ok FROM training_record GROUP BY 1) SELECT CASE WHEN ok IS NULL THEN 'unreviewed' WHEN ok THEN 'approved' ELSE 'rejected' END AS decision, count(*) AS n FROM task LEFT JOIN r USING (task_id) GROUP BY 1",
)
add(
    "select_matched_by_priority",
    lambda s, d: select.matched_by_priority(table(s, d, "chat_log").select("chat_id", "task_id", F.element_at(F.filter("messages", lambda m: m["role"] == "user"), -1)["content"].alias("ask")), table(s, d, "task").select("task_no", F.col("task_id").alias("tid"), F.col("natural_language_instruction").alias("text")), ("task_id", "tid"), ("ask", "text"), "task_no").groupBy("how").agg(F.count(F.lit(1)).alias("n"), F.sum("match_id").alias("ids")),
    "WITH c AS (SELECT chat_id, task_id, list_filter(messages, lambda m: m.role = 'user')[-1].content AS ask FROM chat_log), a AS (SELECT task_id, count(*) na, min(task_no) ka FROM task GROUP BY 1), b AS (SELECT natural_language_instruction ask, count(*) nb, min(task_no) kb FROM task WHERE natural_language_instruction IS NOT NULL GROUP BY 1), j AS (SELECT CASE WHEN coalesce(na, nb) IS NULL THEN 'missing' WHEN coalesce(na, nb) > 1 THEN 'ambiguous' WHEN na IS NOT NULL THEN 'first' ELSE 'second' END AS how, CASE WHEN coalesce(na, nb) = 1 THEN coalesce(ka, kb) END AS k FROM c LEFT JOIN a USING (task_id) LEFT JOIN b USING (ask)) SELECT how, count(*) AS n, CAST(sum(k) AS BIGINT) AS ids FROM j GROUP BY 1",
)
add("select_assign_groups", lambda s, d: select.assign_groups(table(s, d, "training_record").select("record_id", F.coalesce("extra_info.instruction_sha256", F.col("record_id").cast("string")).alias("g")), "g", {"train": 300, "test": 100}, curate.seeded("a", "g")).groupBy("split").agg(F.count(F.lit(1)).alias("n")))
add("select_diverse", lambda s, d: select.diverse(table(s, d, "source_spec").select("label", "split"), "label", ["split"], 6, "label").select("label", "split", "turn"), "SELECT label, split, CAST(t AS INTEGER) AS turn FROM (SELECT label, split, row_number() OVER (ORDER BY rn, label) t FROM (SELECT label, split, row_number() OVER (PARTITION BY split ORDER BY label) rn FROM source_spec)) WHERE t <= 6")
add(
    "set_disjoint_union",
    lambda s, d: select.disjoint_union({"task": table(s, d, "task").select("task_id"), "record": table(s, d, "training_record").select(F.col("reward_model.ground_truth.task_id").alias("task_id")), "chat": table(s, d, "chat_log").select("task_id")}, "task_id")[1],
    "SELECT task_id, count(DISTINCT part) AS parts FROM (SELECT task_id, 1 AS part FROM task UNION ALL SELECT reward_model.ground_truth.task_id, 2 FROM training_record UNION ALL SELECT task_id, 3 FROM chat_log) GROUP BY 1 HAVING count(DISTINCT part) > 1",
)

# --- further analytics ------------------------------------------------------------------------------------------------
add(
    "more_catalogue_profile",
    lambda s, d: more.catalogue_profile(table(s, d, "task"), "environment_id", ["task_type", "difficulty_level", "qa_status"]),
    "SELECT environment_id, 'task_type' AS kind, task_type AS value, count(*) AS n FROM task GROUP BY 1, 3 UNION ALL SELECT environment_id, 'difficulty_level', CAST(difficulty_level AS VARCHAR), count(*) FROM task GROUP BY 1, 3 UNION ALL SELECT environment_id, 'qa_status', qa_status, count(*) FROM task GROUP BY 1, 3",
)
add("more_reuse_across", lambda s, d: more.reuse_across(table(s, d, "task"), "natural_language_instruction", "environment_id"), "SELECT versions, count(*) AS keys FROM (SELECT natural_language_instruction, count(DISTINCT environment_id) AS versions FROM task WHERE natural_language_instruction IS NOT NULL GROUP BY 1) GROUP BY 1")
add("more_weighted_mean", over(lambda x: more.weighted_mean(x, "reward", "k", ["event_type"])), f"WITH s AS ({_S}) SELECT event_type, round(sum(reward * k) / nullif(sum(k), 0), 6) AS weighted_mean, max(reward) AS largest FROM s WHERE reward IS NOT NULL AND k IS NOT NULL GROUP BY 1")
add(
    "more_within_range",
    over(lambda x: more.within_range_of(x, "event_id", x.where("event_type = 'error' and step between 5 and 9"), "event_id", "event_type", "reward")),
    f"WITH s AS ({_S}), b AS (SELECT min(event_id) lo, max(event_id) hi FROM s WHERE event_type = 'error' AND step BETWEEN 5 AND 9) SELECT event_type, count(*) AS n, round(avg(reward), 6) AS mean FROM s, b WHERE event_id BETWEEN lo AND hi GROUP BY 1",
)
add("more_last_rows", lambda s, d: more.last_rows(table(s, d, "orders").select("o_orderkey", "o_totalprice"), 16, ["o_totalprice", "o_orderkey"]), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 16")
add(
    "more_expand_arms",
    lambda s, d: more.expand_arms(table(s, d, "source_spec").select("label"), {"plain": F.col("label"), "upper": F.upper("label"), "tagged": F.concat(F.col("label"), F.lit("#"))}),
    "SELECT label, 'plain' AS arm, label AS text FROM source_spec UNION ALL SELECT label, 'upper', upper(label) FROM source_spec UNION ALL SELECT label, 'tagged', label || '#' FROM source_spec",
)
add(
    "more_backfilled",
    lambda s, d: more.backfilled(table(s, d, "task").select("task_no", F.when(F.col("task_no") % 5 > 0, F.sha2("gold_answer.value_json", 256)).alias("h"), "gold_answer"), "h", F.sha2("gold_answer.value_json", 256)).groupBy("repaired").agg(F.count(F.lit(1)).alias("n"), F.min("h").alias("least")),
    "SELECT (task_no % 5 = 0 AND gold_answer.value_json IS NOT NULL) AS repaired, count(*) AS n, min(sha256(gold_answer.value_json)) AS least FROM task GROUP BY 1",
)
add("more_previous_month", lambda s, d: table(s, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("month")).distinct().select("month", more.previous_month(F.col("month")).alias("previous")), "SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS month, strftime(CAST(date_trunc('month', o_orderdate) AS DATE) - INTERVAL 1 MONTH, '%Y-%m') AS previous FROM orders")
add(
    "more_filled_targets",
    lambda s, d: more.filled_targets(table(s, d, "carriers"), table(s, d, "shipments"), "carrier_id", F.col("delivery_hours") > 60, "delivery_hours"),
    "SELECT c.carrier_id, count(*) FILTER (WHERE s.delivery_hours > 60) AS n, round(quantile_cont(s.delivery_hours, 0.5) FILTER (WHERE s.delivery_hours > 60), 6) AS median, CASE WHEN count(s.shipment_id) = 0 THEN 'missing' WHEN count(*) FILTER (WHERE s.delivery_hours > 60) = 0 THEN 'invalid' ELSE 'ok' END AS status FROM carriers c LEFT JOIN shipments s ON s.carrier_id = c.carrier_id GROUP BY 1",
)
add(
    "more_unknown_seconds",
    lambda s, d: table(s, d, "trajectory").groupBy("num_turns").agg(F.round(F.avg(more.unknown_as_null(F.col("trajectory_total_seconds"))), 4).alias("mean_seconds"), F.count(more.unknown_as_null(F.col("trajectory_total_seconds"))).alias("known")),
    "SELECT num_turns, round(avg(trajectory_total_seconds) FILTER (WHERE trajectory_total_seconds <> -1), 4) AS mean_seconds, count(*) FILTER (WHERE trajectory_total_seconds <> -1) AS known FROM trajectory GROUP BY 1",
)
add("more_mutants", lambda s, d: more.mutants(table(s, d, "training_record").select(F.col(_SQLCOL).alias("q")), "q").groupBy("mutation", F.coalesce(F.get(sql_text.difference_udf("mutant", "statement"), 0), F.lit("same")).alias("told_as")).agg(F.count(F.lit(1)).alias("n")))
add("more_success_tail", lambda s, d: s.range(1, 21).select(F.col("id").alias("trials"), more.success_tail(F.col("id"), F.lit(1), F.lit(1.0), F.lit(1.0)).alias("p")), "SELECT CAST(range AS BIGINT) AS trials, round(range / (range + 1.0), 6)::DOUBLE AS p FROM range(1, 21)")
add("more_expected_attempts", over(lambda x: x.groupBy("task").agg(F.avg(F.col("correct").cast("int")).alias("p")).select("task", more.expected_attempts(F.col("p"), 8).alias("attempts"))), f"WITH s AS ({_S}) SELECT task, round(CASE WHEN avg(correct::INT) > 0 THEN (1 - pow(1 - avg(correct::INT), 8)) / avg(correct::INT) ELSE 8 END, 6) AS attempts FROM s GROUP BY 1")
add(
    "more_correlation_by_bucket",
    over(lambda x: stats.pearson(x.withColumn("wrong", ~F.col("correct")), "reward", "step", ["wrong"])),
    f"WITH s AS ({_S}) SELECT NOT correct AS wrong, count(*) AS n, round(corr(reward, step), 4) AS r FROM s GROUP BY 1",
)
add("event_daily_buckets", over(lambda x: x.groupBy("step", "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("reward"), 4).alias("total"))), f"WITH s AS ({_S}) SELECT step, event_type, count(*) AS n, round(sum(reward), 4) AS total FROM s GROUP BY 1, 2")

# --- SQL text and transcripts -----------------------------------------------------------------------------------------
add("sql_families", lambda s, d: table(s, d, "training_record").groupBy(sql_text.literal_free_udf(F.col(_SQLCOL)).alias("family")).agg(F.count(F.lit(1)).alias("n")))
add("sql_signatures", lambda s, d: table(s, d, "training_record").select("record_id", sql_text.signature_udf(F.col(_SQLCOL)).alias("s")).groupBy("s.tables", "s.group", "s.limit").agg(F.count(F.lit(1)).alias("n")))
add("sql_in_commands", lambda s, d: table(s, d, "trajectory").select("trajectory_id", F.explode("pi_tool_events").alias("e")).where("e.arguments.command is not null").select("trajectory_id", F.size(sql_text.selects_udf(F.col("e.arguments.command"))).alias("found"), F.coalesce(F.size("e.sql_statements"), F.lit(0)).alias("given")).groupBy("found", "given").agg(F.count(F.lit(1)).alias("n")))
add("sql_first_query_difference", lambda s, d: _answered(s, d).select("trajectory_id", F.try_element_at(F.flatten(F.transform(F.col("pi_tool_events"), lambda e: F.coalesce(e["sql_statements"], F.array().cast("array<string>")))), F.lit(1)).alias("q"), F.col("g.verification_sql").alias("gold")).where("q is not null and gold is not null").select(F.coalesce(F.get(sql_text.difference_udf("q", "gold"), 0), F.lit("same")).alias("difference")).groupBy("difference").agg(F.count(F.lit(1)).alias("n")))
add("transcript_messages", lambda s, d: table(s, d, "trajectory").select(F.explode(sql_text.messages_udf("trajectory_output")).alias("m")).groupBy("m.role", F.col("m.call_name").alias("call_name")).agg(F.count(F.lit(1)).alias("n")))
add("transcript_identity", lambda s, d: table(s, d, "task").select("task_no", sql_text.canonical_hash_udf("gold_answer.value_json").alias("gold_sha256")))
add("token_edit_masks", lambda s, d: _answered(s, d).select("trajectory_id", F.transform(F.split("g.verification_sql", r"\s+"), lambda w: (F.crc32(w) % 2147483647).cast("int")).alias("a"), F.transform(F.split(F.coalesce(F.try_element_at(F.flatten(F.transform("pi_tool_events", lambda e: F.coalesce(e["sql_statements"], F.array().cast("array<string>")))), F.lit(1)), F.lit("")), r"\s+"), lambda w: (F.crc32(w) % 2147483647).cast("int")).alias("b")).where("a is not null").select("trajectory_id", F.aggregate(sql_text.edit_mask_udf("a", "b"), F.lit(0), lambda t, x: t + x).alias("changed")))

# --- sources ----------------------------------------------------------------------------------------------------------
add("source_rendered_json", lambda s, d: readers.rendered(table(s, d, "region").orderBy("r_regionkey")), """SELECT '{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '"}' AS line FROM region""")
add("source_rendered_text", lambda s, d: readers.rendered(table(s, d, "region"), "text"), "SELECT r_regionkey || '|' || r_name AS line FROM region")
add("source_file_hashes", lambda s, d: readers.file_hashes(s, f"{d}/nation.parquet").select("bytes", "sha256"))
add("source_environments", lambda s, d: table(s, d, "training_record").select(F.col("extra_info.environment_id").alias("environment_id")).distinct(), "SELECT DISTINCT extra_info.environment_id AS environment_id FROM training_record")
add("source_synthetic_star", lambda s, d: (lambda t: t["shipments"].join(t["carriers"], "carrier_id").groupBy("carrier_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("freight_amount"), 2).alias("freight")))(synthetic.star(s)))
add("source_task_grid", lambda s, d: synthetic.task_grid(s, ["sum", "mean", "rate"], ["carrier", "region"], ["2024-01", "2024-02", "2024-03"], [3, 5], 8, "g").groupBy("level").agg(F.count(F.lit(1)).alias("n")))
add("event_time_windows", lambda s, d: resample.event_windows(table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 day", "1 hour", "event_type").groupBy("event_type").agg(F.count(F.lit(1)).alias("windows"), F.sum("n").alias("n")), "SELECT event_type, count(DISTINCT CAST(ts AS DATE)) AS windows, count(*) AS n FROM events GROUP BY 1")

# --- nested records ---------------------------------------------------------------------------------------------------
add("p5_found", nested.p5_found)
for _name in nested.TABLES:
    add(f"p5_{_name}", nested.p5_table(_name))


def queries() -> dict[str, Query]:
    return {name: fn for name, (fn, _) in _Q.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _Q.items() if sql}
