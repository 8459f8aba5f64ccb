"""Queries of sources and sinks on files, of run records, schedules and small text functions, with the SQL that must agree.

Files are written to the scratch folder from whole tables first, so what is read back can be held against the tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


from ..functions import text as tx
from ..operators import more, runs, select, telemetry
from ..operators import trajectories as traj
from ..session import scratch_folder, table
from ..sources import readers
from .assembly import _A, _asked
from .core import FLAGSHIP, _LINES, add

_TASK = "task_no long, task_id string, task_type string, difficulty_level int"
_G = "reward_model.ground_truth"


def _tasks(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "task").select("task_no", "task_id", "task_type", "difficulty_level")


def _folder(s: SparkSession, name: str) -> str:
    return scratch_folder(s, f"{name}-{uuid.uuid4().hex}")


def _named(s: SparkSession, df: DataFrame, by: str, name) -> str:  # noqa: ANN001
    """A folder with one JSON-lines file a value of `by`, named by name(value); values are few."""
    import posixpath

    raw, out = _folder(s, "files"), _folder(s, "named")
    df.repartition(by).write.partitionBy(by).json(raw)
    jvm, conf = s._jvm, s._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(raw).getFileSystem(conf)
    fs.mkdirs(path(out))
    for f in fs.globStatus(path(posixpath.join(raw, f"{by}=*", "part-*"))):
        value = f.getPath().getParent().getName().split("=", 1)[1]
        fs.rename(f.getPath(), path(posixpath.join(out, name(value))))
    return out


def _json(s: SparkSession, d: str) -> DataFrame:
    p = _folder(s, "json")
    readers.write_json(_tasks(s, d), p)
    return readers.json_lines(s, p, _TASK, strict=True)


_T = "SELECT task_no, task_id, task_type, difficulty_level FROM task"
add("source_json_lines", _json, _T)


def _csv(s: SparkSession, d: str) -> DataFrame:
    p = _folder(s, "csv")
    _tasks(s, d).write.option("header", True).option("nullValue", "<null>").csv(p)
    return readers.csv_table(s, p, _TASK).replace("<null>", None).select("task_no", "task_id", "task_type")


add("source_csv", _csv, "SELECT task_no, task_id, task_type FROM task")


def _parquet(s: SparkSession, d: str) -> DataFrame:
    p = _folder(s, "sink")
    n = readers.write_parquet(_tasks(s, d), p, _tasks(s, d).count())
    return s.read.parquet(p).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("task_id").alias("tasks")).withColumn("written", F.lit(n).cast("bigint"))


add("source_parquet_sink", _parquet, "SELECT count(*) AS rows, count(DISTINCT task_id) AS tasks, count(*) AS written FROM task")
_STEPS = lambda s, d: _named(s, _tasks(s, d).where("difficulty_level is not null").withColumn("step", F.col("difficulty_level")), "step", lambda v: f"{v}.jsonl")
add("source_stepped", lambda s, d: readers.stepped(s, _STEPS(s, d), "task_no long, task_id string"), "SELECT task_no, task_id, CAST(difficulty_level AS BIGINT) AS step FROM task WHERE difficulty_level IS NOT NULL")
add("source_stepped_range", lambda s, d: readers.stepped(s, _STEPS(s, d), "task_no long", 2, 3), "SELECT task_no, CAST(difficulty_level AS BIGINT) AS step FROM task WHERE difficulty_level BETWEEN 2 AND 3")


def _shards(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "trajectory").where("record_id is not null and sample_index is not null").select("record_id", "sample_index", F.floor(F.col("record_id") / 100_000).alias("shard"))
    return readers.shards(s, _named(s, t, "shard", lambda v: f"tasks_{int(v) * 100_000}_{(int(v) + 1) * 100_000}.jsonl"), "record_id long, sample_index int")


_SH = "WITH t AS (SELECT record_id, sample_index, CAST(floor(record_id / 100000) AS BIGINT) * 100000 AS a FROM trajectory WHERE record_id IS NOT NULL AND sample_index IS NOT NULL)"
add("source_shards", lambda s, d: _shards(s, d).groupBy("shard_start", "shard_stop").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("record_id").alias("tasks")), f"{_SH} SELECT a AS shard_start, a + 100000 AS shard_stop, count(*) AS rows, count(DISTINCT record_id) AS tasks FROM t GROUP BY 1")
add(
    "source_shard_audit",
    lambda s, d: readers.shard_audit(_shards(s, d), "record_id", "sample_index", 4),
    f"{_SH}, p AS (SELECT a, record_id, count(*) AS n, count(DISTINCT sample_index) AS k FROM t GROUP BY 1, 2) SELECT a AS shard_start, a + 100000 AS shard_stop, CAST(sum(n) AS BIGINT) AS rows, count(*) AS tasks, CAST(sum(n - k) AS BIGINT) AS duplicates, bool_and(n = 4 AND k = 4) AND count(*) = 100000 AS complete FROM p GROUP BY 1",
)


def _bounded(s: SparkSession, d: str, script: bool) -> DataFrame:
    table(s, d, "shipments").createOrReplaceTempView("loomwright_shipments")
    sql = "SELECT status, count(*) AS n FROM loomwright_shipments GROUP BY status"
    rows = readers.statements(s, f"SELECT 1 AS one; {sql}", 100) if script else readers.query_read_only(s, sql, 100)[0]
    return s.createDataFrame([(r["status"], r["n"]) for r in rows], "status string, n long")


_STATUS = "SELECT status, count(*) AS n FROM shipments GROUP BY 1"
add("source_read_only_sql", lambda s, d: _bounded(s, d, False), _STATUS)
add("source_statements", lambda s, d: _bounded(s, d, True), _STATUS)
add(
    "source_manifest",
    lambda s, d: runs.manifest({"task": table(s, d, "task").select("task_id"), "record": table(s, d, "training_record").where(f"{_G}.task_id is not null").select(F.col(f"{_G}.task_id").alias("task_id"))}, "task_id")[1],
    f"WITH u AS (SELECT task_id FROM task UNION ALL SELECT {_G}.task_id FROM training_record WHERE {_G}.task_id IS NOT NULL) SELECT task_id, count(*) AS n FROM u GROUP BY 1 HAVING count(*) > 1",
)
add("source_inline_values", lambda s, d: runs.inline_values(s, [("a", 4, 464.6), ("b", 6, 364.69)], "arm string, samples int, seconds double"), "SELECT * FROM (VALUES ('a', 4, 464.6::DOUBLE), ('b', 6, 364.69::DOUBLE)) v(arm, samples, seconds)")


def _run_parts(s: SparkSession, d: str) -> tuple[DataFrame, ...]:
    r = table(s, d, "training_record").select("record_id", F.col("data_source").alias("run_id"))
    t = table(s, d, "trajectory").join(r, "record_id")
    contract = r.groupBy("run_id").agg(F.count(F.lit(1)).alias("expected")).where("run_id is not null")
    rows = t.select("run_id", F.coalesce("runtime_error", F.lit(False)).alias("failed"))
    log = t.select("run_id", F.explode("pi_tool_events").alias("e")).select("run_id", F.coalesce("e.response_preview", F.lit("")).alias("value"))
    done = t.where("trajectory_timeout").select("run_id", F.lit("DONE").alias("name"))
    return contract, rows, log, done


add(
    "run_summary",
    lambda s, d: runs.run_summary(*_run_parts(s, d)),
    r"WITH r AS (SELECT record_id, data_source AS run_id FROM training_record), t AS (SELECT t.*, run_id FROM trajectory t JOIN r USING (record_id)), c AS (SELECT run_id, count(*) AS expected FROM r WHERE run_id IS NOT NULL GROUP BY 1), w AS (SELECT run_id, count(*) AS rows, count(*) FILTER (WHERE runtime_error) AS errors, bool_or(trajectory_timeout) AS finished FROM t GROUP BY 1), e AS (SELECT run_id, unnest(pi_tool_events) AS e FROM t), l AS (SELECT run_id, count(*) AS log_lines, count(*) FILTER (WHERE regexp_matches(coalesce(e.response_preview, ''), '(?i)\berror\b|traceback')) AS error_lines FROM e GROUP BY 1) SELECT run_id, expected, coalesce(rows, 0) AS rows, coalesce(errors, 0) AS errors, coalesce(log_lines, 0) AS log_lines, coalesce(error_lines, 0) AS error_lines, coalesce(finished, false) AS finished FROM c LEFT JOIN w USING (run_id) LEFT JOIN l USING (run_id)",
)


def _log(s: SparkSession, d: str) -> DataFrame:
    """Driver-log lines made from the trajectories: a step line, then one stage line."""
    t = table(s, d, "trajectory").where("trajectory_total_seconds >= 0 and sample_index is not null").select("trajectory_id", "sample_index", "trajectory_total_seconds")
    x = F.array(F.concat(F.lit("\x1b[32mstep: "), (F.col("trajectory_id") % 50).cast("string"), F.lit("\x1b[0m")), F.concat(F.lit("stage generate took "), F.floor("trajectory_total_seconds").cast("string"), F.lit(" s")))
    return t.select(F.concat(F.lit("log"), F.col("sample_index").cast("string")).alias("log"), F.posexplode(x).alias("p", "value"), (F.col("trajectory_id") * 2).alias("o")).select("log", (F.col("o") + F.col("p")).alias("n"), "value")


add(
    "run_steady_stages",
    lambda s, d: runs.steady(runs.driver_stages(_log(s, d), "value", "n")),
    "WITH t AS (SELECT 'log' || sample_index AS log, trajectory_id % 50 AS step, floor(trajectory_total_seconds) AS x FROM trajectory WHERE trajectory_total_seconds >= 0 AND sample_index IS NOT NULL) SELECT log, 'generate' AS stage, count(DISTINCT step) AS steps, round(sum(x), 6) AS seconds, 1.0::DOUBLE AS share FROM t WHERE step >= 2 GROUP BY 1",
)
add(
    "verify_gold_once",
    lambda s, d: runs.gold_once(table(s, d, "training_record").select("record_id", F.col(f"{_G}.verification_sql").alias("q")), "q", lambda one: one.withColumn("calls", F.size(tx.aggregate_calls(F.col("q"))).cast("bigint"))).select("record_id", "calls"),
    r"SELECT record_id, CASE WHEN q IS NOT NULL THEN len(list_distinct(list_transform(regexp_extract_all(lower(q), '\b((?:count|sum|avg|min|max)\s*\(\s*(?:distinct\s+)?(?:[a-z_][a-z0-9_]*\.)?(?:[a-z_][a-z0-9_]*|\*))', 1), lambda c: regexp_replace(regexp_replace(regexp_replace(c, '\s*\(\s*', ':', 'g'), '[a-z_][a-z0-9_]*\.', '', 'g'), '\s+', ' ', 'g')))) END AS calls FROM (SELECT record_id, reward_model.ground_truth.verification_sql AS q FROM training_record)",
)
add(
    "verify_self_consistent",
    lambda s, d: runs.self_consistent(table(s, d, "training_record").select(F.col(f"{_G}.verification_sql").alias("q"), F.col(f"{_G}.expected_value_json").alias("v")), "q", "v"),
    rf"WITH t AS (SELECT {_G}.verification_sql AS q, regexp_replace({_G}.expected_value_json, '\s+', '', 'g') AS v FROM training_record) SELECT sha256(q) AS statement_sha256, count(*) AS rows, count(DISTINCT v) AS values, count(DISTINCT v) = 1 AND count(*) FILTER (WHERE v IS NULL OR v = '') = 0 AS consistent FROM t WHERE q IS NOT NULL GROUP BY q",
)
_CHECKS = {"group": (r"分组|\bper [a-z]|group", "group by"), "top": (r"最高的前|前几|\btop\b", " limit "), "least_rows": ("每组|rows", "having"), "distinct": ("去重|不重复|distinct", "distinct")}
_FLAT = r"lower(regexp_replace(coalesce(sql, ''), '\s+', ' ', 'g'))"
add(
    "verify_plan_checks",
    lambda s, d: _asked(s, d).select(F.inline(runs.plan_checks(F.col("q"), F.col("sql")))).groupBy("name", "required", "aligned").agg(F.count(F.lit(1)).alias("n")),
    f"WITH {_A}, c AS (" + " UNION ALL ".join(f"SELECT '{n}' AS name, regexp_matches(lower(coalesce(q, '')), '{p}') AS required, contains({_FLAT}, '{t}') AS aligned FROM a" for n, (p, t) in _CHECKS.items()) + ") SELECT name, required, aligned, count(*) AS n FROM c GROUP BY 1, 2, 3",
)
add(
    "verify_consistency",
    lambda s, d: _asked(s, d).groupBy(runs.consistency(runs.plan_checks(F.col("q"), F.col("sql"))).alias("reasons")).agg(F.count(F.lit(1)).alias("n")),
    f"WITH {_A} SELECT concat_ws(',', " + ", ".join(f"CASE WHEN regexp_matches(lower(coalesce(q, '')), '{p}') AND NOT contains({_FLAT}, '{t}') THEN 'missing_{n}' WHEN NOT regexp_matches(lower(coalesce(q, '')), '{p}') AND contains({_FLAT}, '{t}') THEN 'unasked_{n}' END" for n, (p, t) in _CHECKS.items()) + ") AS reasons, count(*) AS n FROM a GROUP BY 1",
)
add(
    "audit_dataset",
    lambda s, d: runs.dataset_audit(table(s, d, "task"), "task_id", "difficulty_level", "natural_language_instruction"),
    "WITH l AS (SELECT count(*) AS n FROM task WHERE difficulty_level IS NOT NULL GROUP BY difficulty_level), k AS (SELECT count(*) AS n FROM task GROUP BY task_id), t AS (SELECT count(*) AS n FROM task WHERE natural_language_instruction IS NOT NULL GROUP BY natural_language_instruction) SELECT (SELECT CAST(sum(n) AS BIGINT) FROM k) AS rows, (SELECT count(*) FROM k WHERE n > 1) AS repeated_keys, (SELECT count(*) FROM t WHERE n > 1) AS repeated_texts, (SELECT count(*) FROM l) AS levels, (SELECT min(n) FROM l) AS least, (SELECT max(n) FROM l) AS most, (SELECT max(n) - min(n) <= 0.1 * max(n) FROM l) AS balanced",
)
add(
    "verify_replayed_expression",
    lambda s, d: table(s, d, "lineitem").select("l_orderkey", "l_linenumber", runs.replayed(F.lit("x * (1 - y)"), "l_extendedprice", "l_discount").alias("value"), runs.replayed(F.lit("__import__('os')"), "l_tax", "l_tax").alias("refused")),
    "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS value, CAST(NULL AS DOUBLE) AS refused FROM lineitem",
)
add(
    "assemble_balanced_hosts",
    lambda s, d: runs.balanced(s, [(r["source"] or "none", r["n"]) for r in table(s, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()], {"h1": 10**9, "h2": 10**9}).agg(F.count("host").alias("placed"), F.sum("weight").alias("weight")),
    "SELECT count(*) AS placed, CAST(sum(n) AS BIGINT) AS weight FROM (SELECT source, count(*) AS n FROM documents GROUP BY 1)",
)


def _scheduled(s: SparkSession, d: str, sealed: bool) -> DataFrame:
    t = table(s, d, "task").select("task_id", "environment_id")
    r = table(s, d, "training_record").select(F.col(f"{_G}.task_id").alias("task_id")).join(t, "task_id").select("task_id", "environment_id")
    held, plan = runs.schedule([t, r], "task_id", "environment_id", 20, 2, "plan")
    return held.select("task_id") if sealed else plan.groupBy("exposure").agg(F.count(F.lit(1)).alias("tasks"), F.min("order_key").alias("first_key"))


_RK = "r AS (SELECT task_id, row_number() OVER (PARTITION BY environment_id ORDER BY sha256('plan:' || task_id)) AS n FROM (SELECT DISTINCT ON (task_id) task_id, environment_id FROM task))"
add("assemble_sealed", lambda s, d: _scheduled(s, d, True), f"WITH {_RK} SELECT task_id FROM r WHERE n <= 20")
add("assemble_schedule", lambda s, d: _scheduled(s, d, False), f"WITH {_RK}, e AS (SELECT x AS exposure, sha256('plan:' || x || ':' || task_id) AS k FROM r, (SELECT unnest([1, 2]) AS x) WHERE n > 20) SELECT exposure, count(*) AS tasks, min(k) AS first_key FROM e GROUP BY 1")
add(
    "state_admissions",
    lambda s, d: runs.admissions(table(s, d, "trajectory").where("record_id is not null").select("record_id", "trajectory_id", "trajectory_total_seconds"), "record_id", "trajectory_id", "trajectory_total_seconds", 2).select("trajectory_id", "flushed_at", "admitted_after"),
    "SELECT trajectory_id, max(trajectory_total_seconds) OVER (PARTITION BY record_id ORDER BY trajectory_id ROWS UNBOUNDED PRECEDING) AS flushed_at, lag(trajectory_total_seconds, 2) OVER (PARTITION BY record_id ORDER BY trajectory_id) AS admitted_after FROM trajectory WHERE record_id IS NOT NULL",
)


def _turns(s: SparkSession, d: str, k: int) -> DataFrame:
    t = table(s, d, "trajectory").where(f"record_id is not null and sample_index = {k}")
    return t.groupBy("record_id").agg(F.max("num_turns").alias("turns"))


_TURNS = "SELECT record_id, max(num_turns) AS turns FROM trajectory WHERE record_id IS NOT NULL AND sample_index = {0} GROUP BY 1"
add("audit_frozen_status", lambda s, d: runs.frozen_status(_turns(s, d, 0), _turns(s, d, 1), "record_id", "turns"), f"WITH a AS ({_TURNS.format(0)}), b AS ({_TURNS.format(1)}), j AS (SELECT a.turns AS x, b.turns AS y FROM a LEFT JOIN b USING (record_id)) SELECT CASE WHEN y IS NULL THEN 'lost' WHEN y = 1 THEN 'top' WHEN y < x THEN 'better' WHEN y > x THEN 'worse' ELSE 'same' END AS status, count(*) AS n FROM j GROUP BY 1")


def _scores(s: SparkSession, d: str, k: int) -> DataFrame:
    t = table(s, d, "trajectory").where(f"record_id is not null and sample_index = {k}").groupBy("record_id").agg(F.sum(F.size(F.filter(F.coalesce("pi_tool_events", F.array().cast(table(s, d, "trajectory").schema["pi_tool_events"].dataType)), lambda e: e["ok"]))).alias("score"))
    return t.join(table(s, d, "training_record").select("record_id", F.col(f"{_G}.answer_type").alias("role")), "record_id")


_SC = "SELECT record_id, sum(len(list_filter(coalesce(pi_tool_events, []), lambda e: e.ok))) AS score FROM trajectory WHERE record_id IS NOT NULL AND sample_index = {0} GROUP BY 1"
add("audit_guarded", lambda s, d: runs.guarded(_scores(s, d, 0), _scores(s, d, 1), "record_id", "role", "score"), f"WITH a AS ({_SC.format(0)}), b AS ({_SC.format(1)}), j AS (SELECT {_G}.answer_type AS role, a.score AS x, b.score AS y FROM a JOIN b USING (record_id) JOIN training_record USING (record_id)) SELECT role, count(*) AS n, count(*) FILTER (WHERE x = 0 AND y > 0) AS rescued, count(*) FILTER (WHERE x > 0 AND y = 0) AS broken, round(avg(x), 6) AS mean_base, round(avg(y), 6) AS mean_trial, count(*) FILTER (WHERE x = 0 AND y > 0) >= count(*) FILTER (WHERE x > 0 AND y = 0) AS passed FROM j GROUP BY 1")
add(
    "assemble_by_index",
    lambda s, d: runs.by_index(table(s, d, "trajectory").select("trajectory_id", "source_task_index"), "source_task_index", table(s, d, "task"), "task_no", ["task_id"]).select("trajectory_id", "task_id", "found"),
    "SELECT trajectory_id, task_id, task_no IS NOT NULL AS found FROM trajectory LEFT JOIN task ON source_task_index = task_no",
)
add(
    "assemble_diagnostics",
    lambda s, d: table(s, d, "task").select("task_id", "difficulty_level").join(table(s, d, "training_record").where(f"{_G}.task_id is not null").groupBy(F.col(f"{_G}.task_id").alias("task_id")).agg(F.count(F.lit(1)).alias("records"), F.max("extra_info.training_allowed").alias("allowed")), "task_id", "left").withColumn("evaluation_only", ~F.coalesce("allowed", F.lit(False))).fillna(0, ["records"]).drop("allowed"),
    f"WITH r AS (SELECT {_G}.task_id AS task_id, count(*) AS records, max(extra_info.training_allowed) AS allowed FROM training_record WHERE {_G}.task_id IS NOT NULL GROUP BY 1) SELECT task.task_id, difficulty_level, coalesce(records, 0) AS records, NOT coalesce(allowed, false) AS evaluation_only FROM task LEFT JOIN r USING (task_id)",
)

# --- small functions over whole tables --------------------------------------------------------------------------------
add("text_token_counts", lambda s, d: table(s, d, "trajectory").select("trajectory_id", runs.token_count(s.conf.get("spark.loomwright.tokenizer", "/opt/tokenizers/byte_bpe_50k.tiktoken"))(F.col("final_answer")).alias("tokens")))
add("text_folded", lambda s, d: table(s, d, "customers").select("customer_id", tx.folded(F.col("customer_name")).alias("folded")), r"SELECT customer_id, lower(trim(regexp_replace(regexp_replace(trim(customer_name, ' '), '^[`*_~\"'']+|[`*_~\"'']+$', '', 'g'), '\s+', ' ', 'g'), ' ')) AS folded FROM customers")
add("text_kept_ends", lambda s, d: table(s, d, "documents").select("doc_id", F.sha2(tx.keep_ends(F.col("text"), 3), 256).alias("head"), F.sha2(tx.keep_ends(F.col("text"), 3, True), 256).alias("tail")), "SELECT doc_id, sha256(array_to_string(string_split(text, chr(10))[:3], chr(10))) AS head, sha256(array_to_string(string_split(text, chr(10))[-3:], chr(10))) AS tail FROM documents")
add("text_executes_sql", lambda s, d: table(s, d, "trajectory").select(F.explode("pi_tool_events").alias("e")).groupBy(tx.executes_sql(F.col("e.arguments.command")).alias("executes")).agg(F.count(F.lit(1)).alias("n")), r"WITH x AS (SELECT unnest(pi_tool_events) AS e FROM trajectory), w AS (SELECT list_filter(regexp_split_to_array(lower(coalesce(e.arguments.command, '')), '[\s;&|''\"()`]+'), lambda w: w <> '') AS w FROM x) SELECT list_contains(list_transform(w, lambda z: regexp_extract(z, '[^/]*$')), 'sqlite3') AND list_has_any(w, ['select', 'with']) AS executes, count(*) AS n FROM w GROUP BY 1")
add("select_natural_order", lambda s, d: table(s, d, "shipments").select("status").distinct().unionByName(table(s, d, "orders").select(F.col("o_orderpriority").alias("status")).distinct()).where("status is not null").orderBy(*select.natural_order("status")), "SELECT DISTINCT status FROM shipments WHERE status IS NOT NULL UNION ALL SELECT DISTINCT o_orderpriority FROM orders")
add("telemetry_overhead", lambda s, d: table(s, d, "trajectory").select("trajectory_id", telemetry.overhead(F.col("trajectory_total_seconds"), F.col("trajectory_timeout_seconds"), F.lit(0.0)).alias("rest")), "SELECT trajectory_id, CASE WHEN trajectory_total_seconds >= 0 AND trajectory_timeout_seconds >= 0 THEN round(greatest(0.0, trajectory_total_seconds - trajectory_timeout_seconds), 6) END AS rest FROM trajectory")
add("telemetry_exposition", lambda s, d: telemetry.exposition(table(s, d, "events").select(F.concat(F.lit("event_value{type=\""), F.col("event_type"), F.lit("\"} "), F.round("value", 2).cast("decimal(20,2)").cast("string")).alias("value"))).groupBy("name", "labels").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total")), "SELECT 'event_value' AS name, 'type=\"' || event_type || '\"' AS labels, count(*) AS n, round(sum(round(value, 2)), 2) AS total FROM events WHERE value IS NOT NULL AND event_type IS NOT NULL GROUP BY 2")
add("traj_document_coverage", lambda s, d: table(s, d, "trajectory").select("trajectory_id", traj.document_coverage(F.filter(F.transform(F.coalesce("pi_tool_events", F.array().cast(table(s, d, "trajectory").schema["pi_tool_events"].dataType)), lambda e: e["arguments"]["path"]), lambda p: p.isNotNull()), F.array(F.lit("/workspace/schema_dictionary.md"))).alias("coverage")), "SELECT trajectory_id, CASE WHEN len(list_filter(coalesce(pi_tool_events, []), lambda e: regexp_extract(lower(e.arguments.path), '[^/]*$') IN ('schema_dictionary.md', 'schema_dictionary') OR regexp_replace(regexp_extract(lower(e.arguments.path), '[^/]*$'), '\\.[^.]*$', '') = 'schema_dictionary')) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS coverage FROM trajectory")
add("plan_instruction", lambda s, d: s.createDataFrame([(__import__("loomwright.plans.query_plan", fromlist=["instruction"]).instruction(FLAGSHIP),)], "instruction string"), "SELECT 'sum of l_extendedprice in lineitem, for 1 month(s) from 1996-03, with l_returnflag equal to R, by n_name, top 5, at least 3 rows' AS instruction")
add("more_cache_capacity", lambda s, d: s.createDataFrame([(more.capacity(40_960, 48, 8, 128),)], "bytes long"), "SELECT 2::BIGINT * 40960 * 48 * 8 * 128 * 2 AS bytes")
add("audit_close", lambda s, d: table(s, d, "lineitem").agg(F.count_if(tx.close(F.col("l_extendedprice"), F.col("l_extendedprice") * 1.000005)).alias("near"), F.count_if(tx.close(F.col("l_tax"), F.col("l_discount"))).alias("alike")), "SELECT count(*) FILTER (WHERE abs(l_extendedprice - l_extendedprice * 1.000005) <= greatest(1e-5 * greatest(abs(l_extendedprice), abs(l_extendedprice * 1.000005)), 1e-3)) AS near, count(*) FILTER (WHERE abs(l_tax - l_discount) <= greatest(1e-5 * greatest(abs(l_tax), abs(l_discount)), 1e-3)) AS alike FROM lineitem")
