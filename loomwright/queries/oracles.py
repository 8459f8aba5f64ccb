"""SQL of core queries that takes more than a line: it must give the same rows as the query of its name."""

from __future__ import annotations

from ..functions import text as tx
from .contracts import _ANY_UNSAFE, _CALL, _FIRST, _LIT, _READ, _SQL, _WHERE, _WORDS, _answer_numbers, _list, _numbers  # noqa: F401
from .core import _ARMS, _S, state

_USER = "list_filter(prompt, lambda m: m.role = 'user')[-1].content"
state("text_sql_aggregates", f"WITH c AS (SELECT unnest({_CALL.format(_SQL)}) AS call FROM training_record) SELECT call, count(*) AS n FROM c GROUP BY 1")
_BARE = f"regexp_replace({_WHERE.format(_SQL)}, '''(?:[^'']|'''')*''', ' ', 'g')"
state("text_sql_where", f"SELECT record_id, coalesce(array_to_string(list_sort({_LIT.format(_SQL)}), '|'), '') AS literals, coalesce(array_to_string(list_sort(list_distinct(regexp_extract_all(' ' || {_BARE}, '[^A-Za-z0-9_.]([-+]?\\d+(?:\\.\\d+)?)', 1))), '|'), '') AS numbers FROM training_record")
state("text_read_only", f"SELECT {_READ.format(_SQL)} AS read_only, count(*) AS n FROM training_record GROUP BY 1")
_DOTS = f"list_filter({_WORDS}, lambda w: w LIKE '.%')"
_C = "lower(trim(e.arguments.command, ' '))"
state(
    "text_command_families",
    f"""WITH x AS (SELECT unnest(pi_tool_events) AS e FROM trajectory) SELECT CASE WHEN {_C} IS NULL OR {_C} = '' THEN 'empty' WHEN contains({_C}, 'sqlite') THEN CASE WHEN list_has_any({_DOTS}, ['.tables', '.databases', '.dbinfo']) THEN 'sqlite_schema_catalog' WHEN list_contains({_DOTS}, '.schema') THEN 'sqlite_schema_definition' WHEN len(list_filter({_WORDS}, lambda w: w LIKE 'pragma%')) > 0 THEN 'sqlite_schema_pragma'
    WHEN list_has_any({_WORDS}, ['select', 'with']) THEN 'sqlite_readonly' WHEN len(list_filter({_WORDS}, lambda w: regexp_full_match(w, 'insert|update|delete|drop|alter|create|replace|vacuum|attach|detach|merge|truncate|grant'))) > 0 THEN 'sqlite_mutating_or_unsafe' ELSE 'sqlite_path_or_cli_only' END
    WHEN coalesce({_FIRST}[1], '') LIKE 'python%' THEN 'python' WHEN coalesce({_FIRST}[1], '') IN ({_list(tx.FAMILY_PROGRAMS)[1:-1]}) THEN {_FIRST}[1] ELSE 'other' END AS family, count(*) AS n FROM x GROUP BY 1""",
)
_OPEN = "left(regexp_replace(regexp_replace(regexp_replace(lower({0}), '\\d{{4}}年\\d{{1,2}}月|(?:january|february|march|april|may|june|july|august|september|october|november|december) \\d{{4}}', '<month>', 'g'), '[“\"''「][^”\"''」]*[”\"''」]', '<value>', 'g'), '[0-9]+', '#', 'g'), 24)"
state("text_openings", f"SELECT {_OPEN.format('natural_language_instruction')} AS opening, count(*) AS n FROM task GROUP BY 1")
state("audit_openings", f"WITH g AS (SELECT {_OPEN.format('natural_language_instruction')} AS opening, count(*) AS n FROM task GROUP BY 1), t AS (SELECT sum(n) AS t FROM g) SELECT opening, n, round(n / t, 6) AS share, n / t <= 0.05 AS passed FROM g, t")
state("stats_sign_test", f"{_ARMS}, c AS (SELECT count(*) FILTER (WHERE x > 1e-12) AS wins, count(*) FILTER (WHERE x < -1e-12) AS losses FROM d) SELECT wins, losses, CASE WHEN wins + losses > 0 THEN round(least(1.0, 2 * list_sum(list_transform(range(least(wins, losses) + 1), lambda i: exp(lgamma(wins + losses + 1) - lgamma(i + 1) - lgamma(wins + losses - i + 1) - (wins + losses) * ln(2))))), 6) END AS p_value FROM c")
_I = f"coalesce(length({_USER}) < 24, false)"
_L = f"lower({_SQL})"
state(
    "audit_alignment",
    f"""SELECT concat_ws('|', CASE WHEN {_I} THEN 'broad_instruction' END, CASE WHEN regexp_matches({_USER}, '(?i)最新|最近|latest|most recent') AND NOT regexp_matches({_L}, '''\\d{{4}}-\\d{{2}}|date\\s*\\(|strftime') THEN 'latest_without_time' END, CASE WHEN regexp_matches({_L}, '\\blimit\\b') AND NOT regexp_matches({_L}, '\\border\\s+by\\b') THEN 'limit_without_order' END,
    CASE WHEN reward_model.ground_truth.answer_type = 'numeric' AND NOT regexp_matches({_L}, '\\b(?:count|sum|avg|min|max)\\s*\\(') THEN 'numeric_without_aggregate' END, CASE WHEN {_I} AND regexp_matches({_L}, 'count\\s*\\(\\s*\\*\\s*\\)') THEN 'broad_to_count' END) AS warnings, count(*) AS n FROM training_record GROUP BY 1""",
)
state("audit_order_binding", f"SELECT regexp_matches({_L}, '\\border\\s+by\\b') OR regexp_matches({_USER}, '(?i)最高|最低|排名|前\\s*\\d+|\\btop\\b|\\brank') AS bound, reward_model.ground_truth.answer_type AS answer_type, count(*) AS n FROM training_record GROUP BY 1, 2")
_V = "r.reward_model.ground_truth.expected_value_json"
_GN = f"list_filter(CASE WHEN ltrim({_V}) LIKE '[%' THEN list_transform(from_json({_V}, '[{{\"value\":\"VARCHAR\"}}]'), lambda z: TRY_CAST(replace(z.value, ',', '') AS DOUBLE)) ELSE [TRY_CAST(replace({_V}, ',', '') AS DOUBLE)] END, lambda x: x IS NOT NULL)"
state("verify_numbers_match", f"WITH t AS (SELECT r.reward_model.ground_truth.answer_type AS answer_type, {_GN} AS g, {_numbers('t.final_answer')} AS h FROM trajectory t JOIN training_record r USING (record_id)) SELECT answer_type, coalesce(len(g) > 0 AND len(list_filter(g, lambda x: len(list_filter(h, lambda a: abs(x - a) < 1e-6 OR abs(x - a) < 1e-6 * abs(x))) = 0)) = 0, false) AS matched, count(*) AS n FROM t GROUP BY 1, 2")
_EV = "coalesce(e.name IS NOT NULL AND CASE WHEN e.name = 'bash' THEN trim(e.arguments.command, ' ') <> '' ELSE trim(e.arguments.path, ' ') <> '' END AND e.call_parse_valid AND e.observed_tool_response, false)"
state(
    "traj_valid_events",
    f"WITH t AS (SELECT coalesce(pi_tool_events, []) AS ev FROM trajectory), p AS (SELECT len(ev) > 0 AND len(list_filter(ev, lambda e: NOT ({_EV}))) = 0 AS all_valid, len(list_filter(ev, lambda e: {_EV})) AS valid, len(list_distinct(list_transform(list_filter(flatten(list_transform(ev, lambda e: coalesce(e.sql_statements, []))), lambda q: q IS NOT NULL), lambda q: lower(trim(regexp_replace(q, '\\s+', ' ', 'g'), ' '))))) + CASE WHEN len(list_filter(flatten(list_transform(ev, lambda e: coalesce(e.sql_statements, []))), lambda q: q IS NULL)) > 0 THEN 1 ELSE 0 END AS dq FROM t) SELECT all_valid, count(*) AS n, CAST(sum(valid) AS BIGINT) AS valid, CAST(sum(dq) AS BIGINT) AS distinct_queries FROM p GROUP BY 1",
)
_PARTS = "list_filter(string_split(CASE WHEN p LIKE '/workspace%' THEN substr(p, 11) ELSE p END, '/'), lambda x: x NOT IN ('', '.'))"
state(
    "traj_path_states",
    f"WITH x AS (SELECT unnest(pi_tool_events) AS e FROM trajectory), p AS (SELECT trim(e.arguments.path, ' ') AS p FROM x), q AS (SELECT p, {_PARTS} AS parts FROM p), d AS (SELECT p, list_min(list_transform(range(1, len(parts) + 1), lambda i: list_sum(list_transform(parts[:i], lambda x: CASE WHEN x = '..' THEN -1 ELSE 1 END)))) AS low FROM q) SELECT CASE WHEN p IS NULL OR p = '' OR regexp_matches(p, '[$`*?~]') THEN 'unknown' WHEN p LIKE '/%' AND NOT regexp_matches(p, '^/workspace(?:/|$)') THEN 'outside' WHEN low < 0 THEN 'outside' ELSE 'inside' END AS state, count(*) AS n FROM d GROUP BY 1",
)
state(
    "source_task_grid",
    "WITH g AS (SELECT m.x AS metric, g.x AS grp, t.x AS month, k.x AS top FROM (SELECT unnest(['sum', 'mean', 'rate']) AS x) m, (SELECT unnest(['', 'carrier', 'region']) AS x) g, (SELECT unnest(['2024-01', '2024-02', '2024-03']) AS x) t, (SELECT unnest([0, 3, 5]) AS x) k), l AS (SELECT *, CASE WHEN grp = '' THEN 1 WHEN top = 0 THEN 2 ELSE 3 END AS level FROM g WHERE grp <> '' OR top = 0) SELECT CAST(level AS INTEGER) AS level, least(count(*), 8) AS n FROM l GROUP BY 1",
)

_LAST = r"regexp_split_to_array(trajectory_output, '<\|im_start\|>assistant\s*|(?m)^assistant:\s*')[-1]"
_OWN = rf"regexp_split_to_array({_LAST}, '<\|im_end\|>|<\|im_start\|>|(?m)^(?:user|tool|system):')[1]"
_SHOWN = _OWN
for _tag in ("think", "tool_call", "tool_response"):
    _SHOWN = f"regexp_replace({_SHOWN}, '(?s)<{_tag}>.*?</{_tag}>', '', 'g')"
state("text_final_answer", rf"SELECT trajectory_id, sha256(trim(regexp_replace({_SHOWN}, '^\s+|\s+$', '', 'g'), ' ')) AS answer_sha256 FROM trajectory")
_LABEL = r"list_distinct(list_transform(regexp_extract_all(final_answer, '(?im)(?:final answer|答案|结果|result)\W{0,6}([-+]?\d[\d,]*(?:\.\d+)?)', 1), lambda x: TRY_CAST(replace(x, ',', '') AS DOUBLE)))"
_LINE = "coalesce(list_filter(string_split(final_answer, chr(10)), lambda x: trim(x, ' ') <> '')[-1], '')"
state(
    "traj_unique_conclusion",
    f"WITH t AS (SELECT final_answer AS a, len({_LABEL}) AS l, len(list_distinct({_answer_numbers(_LINE)})) AS k FROM trajectory) SELECT CASE WHEN a IS NULL OR trim(a, ' ') = '' THEN 'no_answer' WHEN l > 1 THEN 'ambiguous_label' WHEN l = 1 THEN 'label' WHEN k = 1 THEN 'last_line' WHEN k > 1 THEN 'ambiguous_line' ELSE 'no_number' END AS reason, count(*) AS n, count(*) FILTER (WHERE a IS NOT NULL AND (l = 1 OR l = 0 AND k = 1)) AS with_value FROM t GROUP BY 1",
)
_AVG = "round(coalesce(avg({0}) FILTER (WHERE step {1} 15), 0.0), 6)"
state(
    "audit_delta_drivers",
    f"WITH s AS ({_S}), g AS (SELECT task, {_AVG.format('reward', '<=')} AS a1, {_AVG.format('reward', '>')} AS b1, {_AVG.format('k', '<=')} AS a2, {_AVG.format('k', '>')} AS b2 FROM s GROUP BY 1), d AS (SELECT round(round(0.5 * b1 + 0.5 * b2, 2) - round(0.5 * a1 + 0.5 * a2, 2), 6) AS delta, round(0.5 * b1 - 0.5 * a1, 6) + round(0.5 * b2 - 0.5 * a2, 6) AS known FROM g) SELECT count(*) AS n, max(abs(round(delta - known, 6))) AS largest_rest FROM d",
)

# --- nested records (problem 5) ---------------------------------------------------------------------------------------


def _camel(name: str) -> str:
    first, *rest = name.split("_")
    return first + "".join(x.capitalize() for x in rest)


def _field(x: str, name: str) -> str:
    keys = list(dict.fromkeys((name, _camel(name))))
    return "coalesce(" + ", ".join(f"nullif({x}->'$.{k}', 'null'::JSON)" for k in keys) + ")"


def _unstring(x: str) -> str:
    return f"CASE WHEN json_type({x}) = 'VARCHAR' AND regexp_matches({x}->>'$', '^\\s*[\\[{{]') AND json_valid({x}->>'$') THEN ({x}->>'$')::JSON ELSE {x} END"


def _items(u: str) -> str:
    return f"CASE WHEN {u} IS NULL OR json_type({u}) = 'NULL' THEN [] WHEN json_type({u}) = 'ARRAY' THEN json_extract({u}, '$[*]') ELSE [{u}] END"


def _tabular(u: str) -> str:
    return f"CASE WHEN json_type({u}) IN ('ARRAY', 'OBJECT') THEN {u} END"


_INNER = ", ".join(f"v->'$.{k}'" for k in ("row", "record", "data", "payload", "item"))
_P5 = f"""WITH d AS (SELECT raw_id, payload::JSON AS v FROM raw_record WHERE json_valid(payload)), o AS (SELECT * FROM d WHERE json_type(v) = 'OBJECT'),
w AS (SELECT raw_id, CASE WHEN coalesce({_field('v', 'prompt')}, {_field('v', 'reward_model')}, {_field('v', 'extra_info')}) IS NULL THEN coalesce({_INNER}, v) ELSE v END AS x FROM o), r AS (SELECT raw_id, {_unstring('x')} AS v FROM w),
a AS (SELECT raw_id, v, {_field('v', 'prompt')} AS p0, {_field('v', 'reward_model')} AS m0, {_field('v', 'extra_info')} AS e0 FROM r), b AS (SELECT raw_id, {_unstring('p0')} AS p, {_unstring('m0')} AS m, {_unstring('e0')} AS e FROM a),
c AS (SELECT raw_id, p, e, {_field('m', 'ground_truth')} AS g0 FROM b), f AS (SELECT raw_id, {_items('p')} AS msgs, e, {_unstring('g0')} AS g FROM c),
h AS (SELECT raw_id, msgs, e, g, {_field('g', 'required_tables')} AS rt0, {_field('g', 'must_use_fields')} AS mu0, {_field('g', 'evidence_plan')} AS ep0, {_field('g', 'expected_value')} AS ev0, {_field('g', 'expected_value_json')} AS ej0 FROM f),
i AS (SELECT raw_id, msgs, e, g, {_unstring('rt0')} AS rt1, {_unstring('mu0')} AS mu1, {_unstring('ep0')} AS ep1, {_unstring('ev0')} AS ev1, {_unstring('ej0')} AS ej1 FROM h),
j AS (SELECT raw_id, msgs, e, g, {_items('rt1')} AS rt, {_items('mu1')} AS mu, {_field('ep1', 'steps')} AS st0, coalesce({_tabular('ev1')}, {_tabular('ej1')}) AS gr0 FROM i),
k AS (SELECT raw_id, msgs, e, g, rt, mu, {_unstring('st0')} AS st1, {_items('gr0')} AS gr FROM j), l AS (SELECT *, {_items('st1')} AS st FROM k),
message AS (SELECT raw_id, e, CAST(unnest(range(len(msgs))) AS INTEGER) AS i, unnest(msgs) AS m FROM l), msg AS (SELECT * FROM message WHERE json_type(m) <> 'NULL'),
tc0 AS (SELECT raw_id, e, i, {_field('m', 'tool_calls')} AS t FROM msg), tc1 AS (SELECT raw_id, e, i, {_unstring('t')} AS u FROM tc0), tc2 AS (SELECT raw_id, e, i, {_items('u')} AS t FROM tc1), tc AS (SELECT raw_id, e, i, CAST(unnest(range(len(t))) AS INTEGER) AS j, unnest(t) AS c FROM tc2),
rtx AS (SELECT raw_id, e, CAST(unnest(range(len(rt))) AS INTEGER) AS i, unnest(rt) AS x FROM l), mux AS (SELECT raw_id, e, CAST(unnest(range(len(mu))) AS INTEGER) AS i, unnest(mu) AS x FROM l), stx AS (SELECT raw_id, e, CAST(unnest(range(len(st))) AS INTEGER) AS i, unnest(st) AS x FROM l),
ef0 AS (SELECT raw_id, e, i, {_field('x', 'fields')} AS t FROM stx WHERE json_type(x) <> 'NULL'), ef1 AS (SELECT raw_id, e, i, {_unstring('t')} AS u FROM ef0), ef2 AS (SELECT raw_id, e, i, {_items('u')} AS t FROM ef1), ef AS (SELECT raw_id, e, i, CAST(unnest(range(len(t))) AS INTEGER) AS j, unnest(t) AS c FROM ef2),
grx AS (SELECT raw_id, e, CAST(unnest(range(len(gr))) AS INTEGER) AS i, unnest(gr) AS x FROM l)"""
_ENT = [("message", "msg", "i", "m"), ("tool_call", "tc", "i || '.' || j", "c"), ("required_table", "rtx", "i", "x"), ("must_use_field", "mux", "i", "x"), ("evidence_step", "stx", "i", "x"), ("evidence_field", "ef", "i || '.' || j", "c"), ("gold_row", "grx", "i", "x")]
state("p5_found", f"{_P5} " + " UNION ALL ".join(f"SELECT raw_id, '{n}' AS entity, CAST({pos} AS VARCHAR) AS pos FROM {t} WHERE json_type({x}) <> 'NULL'" for n, t, pos, x in _ENT))
_SHA = "CASE WHEN json_type(" + _field("e", "instruction_sha256") + ") = 'VARCHAR' THEN " + _field("e", "instruction_sha256") + "->>'$' END AS instruction_sha256"
_TEXT = lambda x, n: f"{_field(x, n)}->>'$' AS {n}"
state("p5_record", f"{_P5} SELECT raw_id, {_SHA}, {', '.join(_TEXT('g', n) for n in ('task_id', 'environment_id', 'answer_type', 'verification_sql'))}, {_TEXT('e', 'source_label')} FROM l")
for _name, _t, _col in (("required_table", "rtx", "table_name"), ("must_use_field", "mux", "field_name")):
    state(f"p5_{_name}", f"{_P5} SELECT raw_id, {_SHA}, i AS item_index, x->>'$' AS {_col} FROM {_t} WHERE json_type(x) <> 'NULL'")
state("p5_message", f"{_P5} SELECT raw_id, {_SHA}, i AS message_index, {_TEXT('m', 'role')}, {_TEXT('m', 'content')}, {_TEXT('m', 'tool_call_id')} FROM msg")
state("p5_evidence_step", f"{_P5} SELECT raw_id, {_SHA}, i AS step_index, {_TEXT('x', 'step')}, {_field('x', 'table')}->>'$' AS table_name FROM stx WHERE json_type(x) <> 'NULL'")
state("p5_evidence_field", f"{_P5} SELECT raw_id, {_SHA}, i AS step_index, j AS field_index, {_TEXT('c', 'name')}, {_TEXT('c', 'agg')} FROM ef WHERE json_type(c) <> 'NULL'")
