"""Queries of data assembly and audits over the project's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import assemble as asm
from ..operators import contracts, curate, trajectories
from ..session import table
from .contracts import _ANY_UNSAFE, _S, _rewards, _s  # noqa: F401
from .core import FLAGSHIP, _LINES, add

_G = "reward_model.ground_truth"
_TR = "training_record"


def rec(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, _TR)


add(
    "assemble_as_strings",
    lambda s, d: rec(s, d).select("record_id", asm.as_strings(F.to_json(F.col(f"{_G}.must_use_fields"))).alias("a"), asm.as_strings(F.col(f"{_G}.task_id")).alias("b")).select("record_id", F.array_join("a", "|").alias("fields"), F.array_join("b", "|").alias("task")),
    f"SELECT record_id, coalesce(array_to_string({_G}.must_use_fields, '|'), '') AS fields, CASE WHEN {_G}.task_id IS NULL THEN '' ELSE trim({_G}.task_id, ' ') END AS task FROM {_TR}",
)
add(
    "audit_forbidden_keys",
    lambda s, d: table(s, d, "raw_record").groupBy(asm.has_key(F.col("payload"), ["verificationSql", "verification_sql"]).alias("has_sql"), asm.has_key(F.col("payload"), ["EXPECTED_VALUE_JSON", "expectedValueJson"]).alias("has_value")).agg(F.count(F.lit(1)).alias("n")),
    r"""WITH k AS (SELECT list_transform(regexp_extract_all(coalesce(payload, ''), '"([^"\\]*)"\s*:', 1), lambda x: lower(x)) AS k FROM raw_record) SELECT list_has_any(k, ['verificationsql', 'verification_sql']) AS has_sql, list_has_any(k, ['expected_value_json', 'expectedvaluejson']) AS has_value, count(*) AS n FROM k GROUP BY 1, 2""",
)
add(
    "assemble_scalar_tags",
    lambda s, d: rec(s, d).select("record_id", asm.scalar_tag(F.col(f"{_G}.expected_value_json")).alias("t")).select("record_id", "t.type", F.when(F.col("t.type") != "nested", F.col("t.value")).alias("value")),
    f"""WITH t AS (SELECT record_id, trim({_G}.expected_value_json, ' ') AS t FROM {_TR}), k AS (SELECT *, CASE WHEN t IS NULL OR t = 'null' THEN 'null' WHEN t IN ('true', 'false') THEN 'boolean' WHEN regexp_matches(t, '^[\\[{{]') THEN 'nested' WHEN TRY_CAST(t AS DOUBLE) IS NOT NULL THEN 'number' ELSE 'text' END AS type FROM t)
    SELECT record_id, type, CASE type WHEN 'number' THEN CASE WHEN round(TRY_CAST(t AS DOUBLE), 6) = floor(round(TRY_CAST(t AS DOUBLE), 6)) THEN CAST(CAST(floor(round(TRY_CAST(t AS DOUBLE), 6)) AS BIGINT) AS VARCHAR) ELSE regexp_replace(printf('%.6f', round(TRY_CAST(t AS DOUBLE), 6)), '0+$', '') END WHEN 'boolean' THEN t WHEN 'text' THEN trim(regexp_replace(t, '^"|"$', '', 'g'), ' ') END AS value FROM k""",
)
add(
    "assemble_json_in_answers",
    lambda s, d: table(s, d, "trajectory").select("trajectory_id", asm.json_in(F.col("final_answer")).isNotNull().alias("has_json")),
    r"SELECT trajectory_id, coalesce(json_valid(nullif(regexp_extract(coalesce(final_answer, ''), '(?s)(\[.*\]|\{.*\})', 1), '')), false) AS has_json FROM trajectory",
)
add(
    "assemble_structural_keys",
    lambda s, d: table(s, d, "task").groupBy(asm.structural_key(F.col("task_type"), F.col("difficulty_level"), F.array_join(F.array_sort("expected_tables"), ","), F.col("gold_answer.answer_type")).alias("k")).agg(F.count(F.lit(1)).alias("n")),
    "SELECT sha256(concat_ws(chr(31), coalesce(task_type, ''), coalesce(CAST(difficulty_level AS VARCHAR), ''), coalesce(array_to_string(list_sort(expected_tables), ','), ''), coalesce(gold_answer.answer_type, ''))) AS k, count(*) AS n FROM task GROUP BY 1",
)
_Q = f"lower(regexp_replace(coalesce({_G}.verification_sql, ''), '\\s+', ' ', 'g'))"
add(
    "assemble_plan_features",
    lambda s, d: rec(s, d).select("record_id", asm.plan_features(F.col(f"{_G}.verification_sql")).alias("f")).select("record_id", "f.*"),
    f"WITH q AS (SELECT record_id, {_Q} AS q FROM {_TR}) SELECT record_id, contains(q, ' group by ')::INT AS \"grouped\", contains(q, ' having ')::INT AS \"having\", contains(q, ' limit ')::INT AS \"top\", contains(q, 'distinct ')::INT AS \"distinct\", len(regexp_extract_all(q, '\\bjoin\\b'))::INT AS joins, len(regexp_extract_all(q, '\\band\\b|\\bwhere\\b'))::INT AS conditions FROM q",
)
add(
    "assemble_join_edges",
    lambda s, d: table(s, d, "trajectory").select("trajectory_id", F.explode("pi_tool_events").alias("e")).select(F.explode("e.sql_statements").alias("q")).select(F.explode(asm.join_edges(F.col("q"))).alias("edge")).groupBy("edge").agg(F.count(F.lit(1)).alias("n")),
    r"""WITH e AS (SELECT unnest(pi_tool_events) AS e FROM trajectory), q AS (SELECT lower(regexp_replace(coalesce(q, ''), '[`"\[\]]', '', 'g')) AS q FROM (SELECT unnest(e.sql_statements) AS q FROM e)), j AS (SELECT regexp_replace(unnest(regexp_extract_all(q, '([a-z_][a-z0-9_]*\.[a-z_][a-z0-9_]*\s*=\s*[a-z_][a-z0-9_]*\.[a-z_][a-z0-9_]*)', 1)), '\s+', '', 'g') AS edge FROM q) SELECT edge, count(*) AS n FROM j GROUP BY 1""",
)


def _asked(s: SparkSession, d: str) -> DataFrame:
    """(record_id, q, sql): the last user message and the statement."""
    q = F.try_element_at(F.filter("prompt", lambda m: (m["role"] == "user") & m["content"].isNotNull()), F.lit(-1))["content"]
    return rec(s, d).select("record_id", q.alias("q"), F.col(f"{_G}.verification_sql").alias("sql"), F.col(f"{_G}.expected_value_json").alias("v"), f"{_G}.task_id", "extra_info.source_label", "extra_info.difficulty_level")


_A = f"a AS (SELECT record_id, list_filter(prompt, lambda m: m.role = 'user' AND m.content IS NOT NULL)[-1].content AS q, {_G}.verification_sql AS sql, {_G}.expected_value_json AS v, {_G}.task_id AS task_id, extra_info.source_label AS source_label, extra_info.difficulty_level AS difficulty_level FROM {_TR})"
_ANCH = r"list_distinct(list_transform(regexp_extract_all(regexp_extract(regexp_replace(coalesce(sql, ''), '\s+', ' ', 'g'), '(?i)\bwhere\b(.*?)(?:\bgroup by\b|\bhaving\b|\border by\b|\blimit\b|;|$)', 1), '''((?:[^'']|'''')*)''', 1), lambda x: lower(trim(x, ' '))))"
_SOLID = r"lower(regexp_replace({0}, '[^\pL\pN]+', '', 'g'))"


def _anchors(s: SparkSession, d: str) -> DataFrame:
    from ..functions import text as tx

    return _asked(s, d).select("record_id", F.array_join(F.array_sort(asm.missing_anchors(F.col("q"), tx.where_literals(F.col("sql")))), "|").alias("missing"))


add("audit_missing_anchors", _anchors, f"WITH {_A} SELECT record_id, coalesce(array_to_string(list_sort(list_filter({_ANCH}, lambda x: NOT contains({_SOLID.format('coalesce(q, %s)' % repr(''))}, {_SOLID.format('x')}))), '|'), '') AS missing FROM a")
add(
    "assemble_conversations",
    lambda s, d: _asked(s, d).where("q is not null and sql is not null and v is not null").select("record_id", F.posexplode(asm.conversation(F.col("q"), F.col("sql"), F.col("v"))).alias("turn", "m")).select("record_id", "turn", "m.role", F.sha2("m.content", 256).alias("content_sha256")),
    f"WITH {_A}, b AS (SELECT * FROM a WHERE q IS NOT NULL AND sql IS NOT NULL AND v IS NOT NULL) SELECT record_id, 0 AS turn, 'user' AS role, sha256(q) AS content_sha256 FROM b UNION ALL SELECT record_id, 1, 'assistant', sha256('<call>' || sql || '</call>') FROM b UNION ALL SELECT record_id, 2, 'tool', sha256(v) FROM b UNION ALL SELECT record_id, 3, 'assistant', sha256(v) FROM b",
)
_RIGHT = f'{_S}, w AS (SELECT trajectory_id, record_id, sample_index, "right" AS ok FROM s)'
add(
    "assemble_pairs",
    lambda s, d: asm.pairs(_rewards(s, d), "record_id", "right", "trajectory_id"),
    f"{_RIGHT} SELECT record_id, min(trajectory_id) FILTER (WHERE ok) AS chosen, min(trajectory_id) FILTER (WHERE NOT ok) AS rejected FROM w GROUP BY 1 HAVING min(trajectory_id) FILTER (WHERE ok) IS NOT NULL AND min(trajectory_id) FILTER (WHERE NOT ok) IS NOT NULL",
)


def _quotas(s: SparkSession) -> DataFrame:
    return s.range(15).select((F.col("id") % 5 + 1).cast("int").alias("difficulty_level"), F.concat(F.lit("host"), F.floor(F.col("id") / 5)).alias("host"), (F.lit(30) + 10 * F.floor(F.col("id") / 5)).alias("quota"))


_QUOTA = "q AS (SELECT l AS difficulty_level, h AS host, lo, hi FROM (SELECT unnest([1, 2, 3, 4, 5]) AS l), (VALUES ('host0', 0, 30), ('host1', 30, 70), ('host2', 70, 120)) v(h, lo, hi))"
add(
    "assemble_host_ranges",
    lambda s, d: asm.host_ranges(table(s, d, "task").select("task_no", "task_id", "difficulty_level"), "difficulty_level", curate.seeded("hosts", "task_id"), _quotas(s)).select("task_no", "host"),
    f"WITH {_QUOTA}, r AS (SELECT task_no, difficulty_level, row_number() OVER (PARTITION BY difficulty_level ORDER BY sha256('hosts:' || task_id)) AS n FROM task WHERE difficulty_level IS NOT NULL) SELECT task_no, host FROM r JOIN q USING (difficulty_level) WHERE n > lo AND n <= hi",
)
add(
    "assemble_padded_chunks",
    lambda s, d: asm.padded(table(s, d, "task"), curate.seeded("pad", "task_id"), 16),
    "WITH n AS (SELECT CAST('0x' || substr(sha256('pad:' || task_id), 1, 8) AS BIGINT) % 16 AS chunk, count(*) AS rows FROM task GROUP BY 1) SELECT chunk, rows, max(rows) OVER () - rows AS padding FROM n",
)
add(
    "assemble_epoch_order",
    lambda s, d: asm.epoch_order(table(s, d, "task").select("task_no"), "task_no", 3).select("task_no", "epoch", "turn"),
    "WITH m AS (SELECT max(task_no) AS m FROM task) SELECT task_no, CAST(e AS INTEGER) AS epoch, e * (m + 1) + task_no AS turn FROM task, m, range(3) r(e)",
)
_NAMES = ("region", "nation", "orders", "source_spec", "task", "heldout_item")
add(
    "source_schema_rows",
    lambda s, d: asm.schema_rows(s, {t: table(s, d, t) for t in _NAMES}).select("table_name", "position", "column_name"),
    f"SELECT table_name, CAST(ordinal_position AS INTEGER) AS position, column_name FROM information_schema.columns WHERE table_name IN {_NAMES}",
)
add(
    "source_relation_count",
    lambda s, d: s.createDataFrame([(len(asm.schema_rows(s, {t: table(s, d, t) for t in _NAMES}).select("table_name").distinct().collect()),)], "relations int"),
    f"SELECT CAST(count(DISTINCT table_name) AS INTEGER) AS relations FROM information_schema.columns WHERE table_name IN {_NAMES}",
)
add(
    "assemble_parameter_grid",
    lambda s, d: asm.parameter_grid(s, {"level": 5, "metric": 7, "month": 24, "service": 6}, "level", 100, "grid"),
    "WITH g AS (SELECT l.i AS level, m.i AS metric, t.i AS month, v.i AS service FROM range(5) l(i), range(7) m(i), range(24) t(i), range(6) v(i)), r AS (SELECT *, row_number() OVER (PARTITION BY level ORDER BY sha256(concat_ws(':', 'grid', level, metric, month, service))) AS n FROM g) SELECT level, metric, month, service FROM r WHERE n <= 100",
)


def _counts(x: DataFrame) -> DataFrame:
    return x.groupBy("record_id").agg(F.count_if("right").alias("correct"), F.count_if(~F.col("right")).alias("wrong"), F.count_if("failed").alias("errors"))


def _confirm(s: SparkSession, d: str) -> DataFrame:
    x = _s(s, d)
    x = x.select("record_id", "sample_index", "failed", contracts.right(x).alias("right"))
    return asm.confirmed(_counts(x.where("sample_index < 2")), _counts(x.where("sample_index >= 2")), "record_id")


add(
    "assemble_confirmed",
    _confirm,
    f"""{_S}, f AS (SELECT DISTINCT record_id FROM s WHERE sample_index >= 2), g AS (SELECT record_id, count(*) FILTER (WHERE "right") AS correct, count(*) FILTER (WHERE NOT "right") AS wrong, count(*) FILTER (WHERE failed) AS errors FROM s WHERE sample_index IS NOT NULL AND record_id IN (SELECT record_id FROM f) GROUP BY 1),
    x AS (SELECT *, concat_ws(',', CASE WHEN correct < 2 THEN 'too_few_correct' END, CASE WHEN wrong < 2 THEN 'too_few_wrong' END, CASE WHEN errors > 0 THEN 'runtime_error' END) AS reasons FROM g) SELECT *, reasons = '' AS accepted FROM x""",
)


def _revisions(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    prev = table(s, d, "task").select("task_id", "environment_id", "difficulty_level", F.col("natural_language_instruction").alias("text"))
    cur = _asked(s, d).join(rec(s, d).select(F.col("record_id").alias("_r"), F.col(f"{_G}.environment_id").alias("environment_id")), F.col("record_id") == F.col("_r")).select("record_id", "task_id", "environment_id", "difficulty_level", F.col("q").alias("text"))
    return prev, cur


add(
    "assemble_carried",
    lambda s, d: asm.carried(*_revisions(s, d), "task_id", ["environment_id", "difficulty_level"], "text").select("record_id", "state", F.sha2("text", 256).alias("text_sha256")),
    f"WITH c AS (SELECT record_id, {_G}.task_id AS task_id, {_G}.environment_id AS environment_id, extra_info.difficulty_level AS difficulty_level FROM {_TR}), j AS (SELECT record_id, natural_language_instruction AS t, coalesce(p.task_id IS NOT NULL AND c.environment_id IS NOT DISTINCT FROM p.environment_id AND c.difficulty_level IS NOT DISTINCT FROM p.difficulty_level AND trim(natural_language_instruction, ' ') <> '', false) AS ok FROM c LEFT JOIN task p ON c.task_id = p.task_id) SELECT record_id, CASE WHEN ok THEN 'carried' ELSE 'pending' END AS state, CASE WHEN ok THEN sha256(t) END AS text_sha256 FROM j",
)


def _values(s: SparkSession, d: str) -> DataFrame:
    from ..functions import closeness

    want, _, _ = closeness.gold(F.col("v"))
    return _asked(s, d).where("v is not null").select("record_id", "task_id", want.alias("xs"))


def _task_values(s: SparkSession, d: str) -> DataFrame:
    from ..functions import closeness

    want, _, _ = closeness.gold(F.col("gold_answer.value_json"))
    return table(s, d, "task").where("gold_answer.value_json is not null").select("task_id", want.alias("xs"))


_WANT = "list_filter(CASE WHEN ltrim({0}) LIKE '[%' THEN list_transform(from_json({0}, '[{{\"value\":\"VARCHAR\"}}]'), lambda r: TRY_CAST(replace(r.value, ',', '') AS DOUBLE)) ELSE [TRY_CAST(replace(regexp_replace(trim({0}, ' '), '^\"|\"$', '', 'g'), ',', '') AS DOUBLE)] END, lambda x: x IS NOT NULL)"
add(
    "audit_value_drift",
    lambda s, d: asm.drift(_values(s, d).select("record_id", "task_id", F.col("xs")).withColumnRenamed("xs", "a").join(_task_values(s, d), "task_id").select("record_id", "a"), _values(s, d).select("record_id", "task_id").join(_task_values(s, d), "task_id").select("record_id", F.col("xs").alias("a")), "record_id", "a", 1e-3),
    f"WITH {_A}, j AS (SELECT record_id, {_WANT.format('v')} AS x, {_WANT.format('gold_answer.value_json')} AS y FROM a JOIN task USING (task_id) WHERE v IS NOT NULL AND gold_answer.value_json IS NOT NULL), k AS (SELECT *, coalesce(list_max(list_transform(list_zip(x, y), lambda z: abs(z[1] - z[2]))), 0.0) AS off FROM j) SELECT record_id, CASE WHEN len(x) <> len(y) THEN 'mismatch' WHEN off <= 1e-3 THEN 'same' ELSE 'drifted' END AS state, CASE WHEN len(x) = len(y) THEN round(off, 6) END AS drift FROM k",
)


def _floors(s: SparkSession, d: str) -> DataFrame:
    x = _s(s, d)
    one = x.select(contracts.right(x).alias("r"), "attempts", "successes").agg(F.round(F.avg(F.col("r").cast("double")), 6).alias("right_share"), F.round(F.count_if(F.col("successes") > 0) / F.count(F.lit(1)), 6).alias("success_share"))
    return asm.decision(one, "decision", {"right_share": 0.1, "success_share": 0.9})


add("audit_decision", _floors, f"""{_S}, o AS (SELECT round(avg(CASE WHEN "right" THEN 1.0 ELSE 0.0 END), 6) AS right_share, round(count(*) FILTER (WHERE successes > 0) / count(*), 6) AS success_share FROM s) SELECT *, CASE WHEN right_share < 0.1 THEN 'below_right_share' WHEN success_share < 0.9 THEN 'below_success_share' ELSE 'pass' END AS decision FROM o""")
add(
    "audit_recovery",
    lambda s, d: asm.recovery(_rewards(s, d).join(table(s, d, "trajectory").select(F.col("trajectory_id").alias("t"), F.concat(F.lit("arm"), (F.col("sample_index") % 3)).alias("arm")), F.col("trajectory_id") == F.col("t")).where("record_id is not null and arm is not null"), "record_id", "arm", "right", "arm0"),
    f"""{_S}, g AS (SELECT record_id, 'arm' || (sample_index % 3) AS arm, max("right"::INT) AS ok FROM s WHERE record_id IS NOT NULL AND sample_index IS NOT NULL GROUP BY 1, 2) SELECT a.arm, count(*) AS tasks, CAST(sum(a.ok) AS BIGINT) AS successes, count(*) FILTER (WHERE a.ok = 1 AND c.ok = 0) AS rescued, count(*) FILTER (WHERE a.ok = 0 AND c.ok = 1) AS regressions FROM g a JOIN g c ON a.record_id = c.record_id AND c.arm = 'arm0' WHERE a.arm <> 'arm0' GROUP BY 1""",
)


def _names(s: SparkSession, d: str) -> DataFrame:
    """(record_id, a, b): first divergence of the tool names of the two first samples from those of the third."""
    t = table(s, d, "trajectory").where("record_id is not null and sample_index is not null").select("record_id", "sample_index", "trajectory_id", F.transform(F.coalesce("pi_tool_events", F.array().cast(table(s, d, "trajectory").schema["pi_tool_events"].dataType)), lambda e: e["name"]).alias("n"))
    one = t.groupBy("record_id", "sample_index").agg(F.min_by("n", "trajectory_id").alias("n"))
    p = {k: one.where(f"sample_index = {k}").select(F.col("record_id").alias(f"r{k}"), F.col("n").alias(f"n{k}")) for k in (0, 1, 2)}
    j = p[2].join(p[0], F.col("r2") == F.col("r0")).join(p[1], F.col("r2") == F.col("r1"))
    return j.select(F.col("r2").alias("record_id"), trajectories.first_divergence(F.col("n0"), F.col("n2")).alias("a"), trajectories.first_divergence(F.col("n1"), F.col("n2")).alias("b"))


_DIV = "list_min(list_filter(list_transform(range(greatest(len({0}), len({1}))), lambda i: CASE WHEN {0}[i + 1] IS DISTINCT FROM {1}[i + 1] OR i >= len({0}) OR i >= len({1}) THEN i END), lambda i: i IS NOT NULL))"
add(
    "audit_offset_transitions",
    lambda s, d: _names(s, d).groupBy(asm.offset_transition(F.col("a"), F.col("b")).alias("transition")).agg(F.count(F.lit(1)).alias("n")),
    f"""WITH o AS (SELECT record_id, sample_index, arg_min(list_transform(coalesce(pi_tool_events, []), lambda e: e.name), trajectory_id) AS n FROM trajectory WHERE record_id IS NOT NULL AND sample_index IS NOT NULL GROUP BY 1, 2), j AS (SELECT c.record_id, a.n AS n0, b.n AS n1, c.n AS n2 FROM o c JOIN o a ON a.record_id = c.record_id AND a.sample_index = 0 JOIN o b ON b.record_id = c.record_id AND b.sample_index = 1 WHERE c.sample_index = 2),
    k AS (SELECT {_DIV.format('n0', 'n2')} AS a, {_DIV.format('n1', 'n2')} AS b FROM j) SELECT CASE WHEN a IS NULL AND b IS NULL THEN 'none' WHEN b IS NULL THEN 'cleared' WHEN a IS NULL THEN 'new' WHEN a = b THEN 'same' WHEN b > a THEN 'later' ELSE 'earlier' END AS transition, count(*) AS n FROM k GROUP BY 1""",
)
_ROLE = "CASE WHEN sample_index % 2 = 0 THEN 'chosen' ELSE 'rejected' END"


def _roles(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "trajectory").where("record_id is not null and sample_index is not null").select("record_id", "response_tokens", F.when(F.col("sample_index") % 2 == 0, "chosen").otherwise("rejected").alias("role"))
    return t.join(rec(s, d).select("record_id", F.col(f"{_G}.answer_type").alias("family")), "record_id")


add(
    "audit_pair_margins",
    lambda s, d: asm.pair_margins(_roles(s, d), "record_id", "role", "response_tokens", "family"),
    f"WITH p AS (SELECT t.record_id, max({_G}.answer_type) AS family, max(response_tokens) FILTER (WHERE sample_index % 2 = 0) - max(response_tokens) FILTER (WHERE sample_index % 2 <> 0) AS m FROM trajectory t JOIN {_TR} USING (record_id) WHERE sample_index IS NOT NULL GROUP BY 1) SELECT family, count(*) AS pairs, count(*) FILTER (WHERE m > 0) AS positive, round(avg(m), 6) AS mean_margin FROM p WHERE m IS NOT NULL GROUP BY 1",
)


def _losses(s: SparkSession, d: str, k: int) -> DataFrame:
    t = table(s, d, "trajectory").where(f"sample_index = {k} and record_id is not null").select("record_id", F.explode("pi_tool_events").alias("e"))
    return t.groupBy("record_id", F.coalesce("e.name", F.lit("?")).alias("component")).agg((F.sum("e.response_token_count") / 1000).alias("loss")).where("loss is not null")


_LOSS = "SELECT record_id, coalesce(e.name, '?') AS component, sum(e.response_token_count) / 1000 AS loss FROM (SELECT record_id, unnest(pi_tool_events) AS e FROM trajectory WHERE sample_index = {0} AND record_id IS NOT NULL) GROUP BY 1, 2 HAVING sum(e.response_token_count) IS NOT NULL"
add(
    "audit_component_change",
    lambda s, d: asm.component_change(_losses(s, d, 0), _losses(s, d, 1), ["record_id"], "component", "loss"),
    f"WITH a AS ({_LOSS.format(0)}), b AS ({_LOSS.format(1)}), j AS (SELECT component, b.loss - a.loss AS x FROM a JOIN b USING (record_id, component)) SELECT component, count(x) AS n, round(avg(x), 6) AS mean_delta, round(exp(-avg(x)), 6) AS ratio, count(*) FILTER (WHERE x < -1e-12) AS wins, count(*) FILTER (WHERE x > 1e-12) AS losses, count(*) FILTER (WHERE abs(x) <= 1e-12) AS ties FROM j GROUP BY 1",
)
add(
    "audit_boundary",
    lambda s, d: asm.boundary(table(s, d, "trajectory"), ~F.coalesce("trajectory_timeout", F.lit(False)), ["response_tokens", "num_turns", "trajectory_timeout_seconds"]),
    "SELECT NOT coalesce(trajectory_timeout, false) AS complete, count(*) AS n, round(avg(response_tokens), 4) AS mean_response_tokens, round(avg(num_turns), 4) AS mean_num_turns, round(avg(trajectory_timeout_seconds), 4) AS mean_trajectory_timeout_seconds, count(DISTINCT response_tokens) AS distinct_response_tokens, count(DISTINCT num_turns) AS distinct_num_turns, count(DISTINCT trajectory_timeout_seconds) AS distinct_trajectory_timeout_seconds FROM trajectory GROUP BY 1",
)
add("audit_scenarios", lambda s, d: asm.scenarios(s, [2048, 8192, 40960], [1, 4, 16, 64], 400_000), "SELECT c AS context, w AS width, c * w AS tokens, c * w <= 400000 AS fits FROM (SELECT unnest([2048, 8192, 40960]::BIGINT[]) AS c), (SELECT unnest([1, 4, 16, 64]::BIGINT[]) AS w)")
add(
    "audit_packet",
    lambda s, d: asm.packet_audit({"raw": table(s, d, "raw_record").select(F.col("raw_id").alias("i")), "tasks": table(s, d, "task").select((F.col("task_no") - 1).alias("i"))}, "i"),
    "WITH p AS (SELECT 'raw' AS part, raw_id AS i FROM raw_record UNION ALL SELECT 'tasks', task_no - 1 FROM task), n AS (SELECT part, count(*) AS rows, count(DISTINCT i) AS u, min(i) AS lo, max(i) AS hi FROM p GROUP BY 1) SELECT part, rows, (SELECT count(*) FROM (SELECT DISTINCT raw_id AS i FROM raw_record) f WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.part = n.part AND q.i = f.i)) AS missing, rows - u AS repeated, coalesce(lo = 0 AND hi = u - 1, false) AS contiguous FROM n",
)
add(
    "audit_strata",
    lambda s, d: asm.strata_present(table(s, d, "task").select("task_type", "qa_status"), "task_type", "qa_status"),
    "WITH n AS (SELECT task_type, qa_status, count(*) AS n FROM task WHERE task_type IS NOT NULL AND qa_status IS NOT NULL GROUP BY 1, 2) SELECT t.task_type, q.qa_status, coalesce(n.n, 0) AS n FROM (SELECT DISTINCT task_type FROM n) t CROSS JOIN (SELECT DISTINCT qa_status FROM n) q LEFT JOIN n ON n.task_type = t.task_type AND n.qa_status = q.qa_status",
)
_COLS = ["data_source", "agent_name", "ability", "ingested_at"]
add("audit_single_valued", lambda s, d: asm.single_valued(rec(s, d), _COLS), " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS \"values\", count(*) FILTER (WHERE {c} IS NULL) AS nulls, count(DISTINCT {c}) = 1 AND count(*) FILTER (WHERE {c} IS NULL) = 0 AS single FROM {_TR}" for c in _COLS))
add(
    "assemble_suffixed",
    lambda s, d: _asked(s, d).where("q is not null").select("record_id", F.sha2("q", 256).alias("before"), F.sha2(asm.with_suffix(F.col("q"), " Reply briefly.", "Keep two decimals."), 256).alias("after")),
    f"WITH {_A} SELECT record_id, sha256(q) AS before, sha256(CASE WHEN suffix(q, ' Reply briefly.') THEN q ELSE CASE WHEN suffix(q, 'Keep two decimals.') THEN left(q, length(q) - 18) ELSE q END || ' Reply briefly.' END) AS after FROM a WHERE q IS NOT NULL",
)
add(
    "assemble_prompt_roles",
    lambda s, d: rec(s, d).select("record_id", F.filter("prompt", lambda m: m["role"].isin("system", "user")).alias("p")).select("record_id", F.size("p").cast("bigint").alias("kept"), F.sha2(F.array_join(F.transform("p", lambda m: F.concat(m["role"], F.lit(":"), F.coalesce(m["content"], F.lit("")))), "\n"), 256).alias("prompt_sha256")),
    f"WITH p AS (SELECT record_id, list_filter(prompt, lambda m: m.role IN ('system', 'user')) AS p FROM {_TR}) SELECT record_id, len(p) AS kept, sha256(array_to_string(list_transform(p, lambda m: m.role || ':' || coalesce(m.content, '')), chr(10))) AS prompt_sha256 FROM p",
)
add(
    "assemble_holdout",
    lambda s, d: asm.holdout(table(s, d, "task").select("task_id", "environment_id"), rec(s, d).select(F.col(f"{_G}.task_id").alias("task_id"), F.col(f"{_G}.environment_id").alias("environment_id")).join(table(s, d, "task").select("task_id", F.col("environment_id").alias("_e")), "task_id").where("environment_id = _e").select("task_id", "environment_id"), "task_id", "environment_id"),
    f"WITH r AS (SELECT DISTINCT t.task_id, t.environment_id FROM {_TR} x JOIN task t ON x.{_G}.task_id = t.task_id AND x.{_G}.environment_id = t.environment_id), f AS (SELECT environment_id, count(DISTINCT task_id) AS \"full\" FROM task GROUP BY 1), n AS (SELECT environment_id, count(DISTINCT task_id) AS training FROM r GROUP BY 1), h AS (SELECT environment_id, count(DISTINCT task_id) AS held FROM task WHERE task_id NOT IN (SELECT task_id FROM r) GROUP BY 1) SELECT environment_id, \"full\", coalesce(training, 0) AS training, coalesce(held, 0) AS held, \"full\" = coalesce(training, 0) + coalesce(held, 0) AS exact FROM f LEFT JOIN n USING (environment_id) LEFT JOIN h USING (environment_id)",
)
add(
    "assemble_last_messages",
    lambda s, d: table(s, d, "chat_log").select("chat_id", F.when(F.size("messages") > 32, F.slice("messages", -32, 32)).otherwise(F.col("messages")).alias("m")).select("chat_id", F.size("m").cast("bigint").alias("kept"), F.array_join(F.transform("m", lambda x: F.coalesce(x["role"], F.lit(""))), ",").alias("roles")),
    "SELECT chat_id, len(messages[-32:]) AS kept, array_to_string(list_transform(messages[-32:], lambda x: coalesce(x.role, '')), ',') AS roles FROM chat_log",
)
add(
    "assemble_content_text",
    lambda s, d: table(s, d, "chat_log").select("chat_id", F.sha2(F.array_join(F.filter(F.transform("messages", lambda m: m["content"]), lambda c: c.isNotNull() & (F.trim(c) != "")), "\n"), 256).alias("text_sha256")),
    "SELECT chat_id, sha256(array_to_string(list_filter(list_transform(messages, lambda m: m.content), lambda c: c IS NOT NULL AND trim(c, ' ') <> ''), chr(10))) AS text_sha256 FROM chat_log",
)
add(
    "join_runtime_outputs",
    lambda s, d: table(s, d, "chat_log").where("task_id is not null").select("task_id", F.lit("chat").alias("runtime"), F.col("chat_id").alias("output_id")).unionByName(table(s, d, "trajectory").join(rec(s, d).select("record_id", F.col(f"{_G}.task_id").alias("task_id")), "record_id").select("task_id", F.lit("trajectory").alias("runtime"), F.col("trajectory_id").alias("output_id"))).join(table(s, d, "task").select("task_id"), "task_id").groupBy("task_id", "runtime").agg(F.count(F.lit(1)).alias("outputs")),
    f"WITH u AS (SELECT task_id, 'chat' AS runtime, chat_id AS i FROM chat_log WHERE task_id IS NOT NULL UNION ALL SELECT {_G}.task_id, 'trajectory', trajectory_id FROM trajectory JOIN {_TR} USING (record_id)) SELECT task_id, runtime, count(*) AS outputs FROM u JOIN task USING (task_id) GROUP BY 1, 2",
)
add(
    "select_strict_candidates",
    lambda s, d: rec(s, d).where("coalesce(extra_info.training_allowed, false) and extra_info.instruction_sha256 is not null and extra_info.gold_sha256 is not null and reward_model.ground_truth.verification_sql is not null").groupBy(F.col("extra_info.instruction_sha256").alias("h")).agg(F.count(F.lit(1)).alias("n"), F.min("record_id").alias("record_id")).where("n = 1").select("record_id"),
    f"SELECT min(record_id) AS record_id FROM {_TR} WHERE coalesce(extra_info.training_allowed, false) AND extra_info.instruction_sha256 IS NOT NULL AND extra_info.gold_sha256 IS NOT NULL AND {_G}.verification_sql IS NOT NULL GROUP BY extra_info.instruction_sha256 HAVING count(*) = 1",
)
add(
    "audit_order_stable",
    lambda s, d: contracts.admission(FLAGSHIP.to_df(s, d), FLAGSHIP.to_df(s, d).repartition(3).orderBy(F.desc("category")), "category"),
    f"WITH q AS (SELECT n_name AS category, round(sum(l_extendedprice), 2) AS value {_LINES} WHERE l_shipdate >= TIMESTAMP '1996-03-01' AND l_shipdate < TIMESTAMP '1996-04-01' AND l_returnflag = 'R' GROUP BY n_name HAVING count(*) >= 3 ORDER BY value DESC, category LIMIT 5) SELECT count(*) AS rows, true AS same, count(*) > 0 AS complete, count(DISTINCT category) = count(*) AS \"unique\", count(*) > 0 AS admitted FROM q",
)
