"""Queries of the contracts on trajectories, of loss masks and of statements, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import contracts, groups, masks, stats
from ..session import table
from .core import add

_SQL = "reward_model.ground_truth.verification_sql"


def _numbers(text: str) -> str:
    """DuckDB's list of the numbers of a text, as functions.text.numbers finds them; its regexes lack look-around, so borders are doubled."""
    parted = rf"regexp_replace(' ' || coalesce({text}, '') || ' ', '([\pL\pM\pN_.])[-+]', '\1  ', 'g')"
    apart = rf"regexp_replace({parted}, '([^\pL\pM\pN_.,+-])', '\1\1', 'g')"
    found = rf"regexp_extract_all({apart}, '[^\pL\pM\pN_.]([-+]?(?:\d{{1,3}}(?:,\d{{3}})+(?:\.\d+)?|\d+(?:\.\d+)?|\.\d+)(?:[eE][-+]?\d+)?)(?:[^\pL\pM\pN_]|$)', 1)"
    return rf"list_filter(list_transform({found}, lambda x: TRY_CAST(replace(x, ',', '') AS DOUBLE)), lambda x: x IS NOT NULL)"


def _answer_numbers(text: str) -> str:
    return _numbers(rf"regexp_replace(regexp_replace(coalesce({text}, ''), '\d{{4}}[-/.年]\d{{1,2}}(?:[-/.月]\d{{1,2}}日?)?', ' ', 'g'), '\d{{1,2}}:\d{{2}}(?::\d{{2}})?', ' ', 'g')")


def _tables(sql: str) -> str:
    return rf"list_distinct(list_transform(regexp_extract_all(coalesce({sql}, ''), '(?i)\b(?:from|join)\s+[`\"\[]?([A-Za-z_][A-Za-z0-9_]*)', 1), lambda x: lower(x)))"


_GOLD = "CASE WHEN ltrim(g.expected_value_json) LIKE '[%' THEN list_transform(from_json(g.expected_value_json, '[{\"value\":\"VARCHAR\"}]'), lambda r: TRY_CAST(replace(r.value, ',', '') AS DOUBLE)) ELSE [TRY_CAST(replace(regexp_replace(trim(g.expected_value_json), '^\"|\"$', '', 'g'), ',', '') AS DOUBLE)] END"
_TRIED = "len(coalesce(e.sql_statements, [])) > 0"
_WORDS = r"list_filter(regexp_split_to_array(lower(coalesce(e.arguments.command, '')), '[\s;&|''\"()`]+'), lambda w: w <> '')"
_FIRST = r"list_filter(list_transform(list_transform(regexp_split_to_array(lower(coalesce(e.arguments.command, '')), '[;&|\n]+'), lambda p: trim(p, ' ')), lambda p: regexp_extract(split_part(p, ' ', 1), '[^/]*$')), lambda w: w NOT IN ('', 'cd'))"


def _list(names: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


_FOREIGN = f"list_filter({_WORDS}, lambda w: w LIKE '/%' AND NOT (w = '/workspace' OR w LIKE '/workspace/%'))"
_REASONS = {
    "network": f"list_has_any({_WORDS}, {_list(tx.NETWORK)})",
    "destructive": f"list_has_any({_WORDS}, {_list(tx.DESTRUCTIVE)})",
    "host_path_escape": f"(len(list_filter({_FOREIGN}, lambda w: split_part(w, '/', 2) IN ({_list(tx.HOST_FOLDERS)[1:-1]}))) > 0 OR len(list_filter({_WORDS}, lambda w: contains(w, '../..'))) > 0)",
    "python_network": f"len(list_filter({_WORDS}, lambda w: regexp_replace(split_part(w, '.', 1), '[,:]+$', '') IN ({_list(tx.MODULES)[1:-1]}))) > 0",
    "root_scan": f"(list_has_any({_FIRST}, {_list(tx.LISTING)}) AND len(list_filter({_FOREIGN}, lambda w: w IN ('/', '/*'))) > 0)",
}
_ANY_UNSAFE = "(" + " OR ".join(_REASONS.values()) + ")"
#: The signals of every trajectory, as operators.contracts.signals gives them, with `right` and `c`, its cost.
_S = rf"""WITH r AS (SELECT record_id AS _r, any_value(reward_model.ground_truth) AS g FROM training_record GROUP BY 1),
t AS (SELECT t.*, r.g, coalesce(pi_tool_events, []) AS ev, list_filter(flatten(list_transform(coalesce(pi_tool_events, []), lambda e: coalesce(e.sql_statements, []))), lambda q: q IS NOT NULL) AS said FROM trajectory t LEFT JOIN r ON t.record_id = r._r),
u AS (SELECT trajectory_id, count(*) FILTER (WHERE {_ANY_UNSAFE}) AS unsafe FROM (SELECT trajectory_id, unnest(ev) AS e FROM t) GROUP BY 1),
a AS (SELECT t.trajectory_id, record_id, sample_index, final_answer, g, coalesce(runtime_error, false) AS failed, coalesce(trajectory_timeout, false) AS timed_out, len(said) AS queries, len(said) - len(list_distinct(list_transform(said, lambda q: lower(trim(q, ' '))))) AS repeats,
 len(list_filter(ev, lambda e: {_TRIED})) AS attempts, len(list_filter(ev, lambda e: {_TRIED} AND e.ok)) AS successes, len(list_filter(ev, lambda e: {_TRIED} AND (e.ok IS NULL OR NOT coalesce(e.observed_tool_response, false)))) AS unseen,
 CAST(coalesce(list_sum(list_transform(ev, lambda e: coalesce(e.response_token_count, 0))), 0) AS BIGINT) AS tokens, len(list_filter(said, lambda q: NOT list_has_any({_tables("q")}, coalesce(g.required_tables, [])))) AS beside, coalesce(u.unsafe, 0) AS unsafe,
 list_filter({_GOLD}, lambda x: x IS NOT NULL) AS want, {_answer_numbers("final_answer")} AS have, coalesce(g.abs_tol, 1e-3) AS abs_t, coalesce(g.rel_tol, 1e-5) AS rel_t, ev FROM t LEFT JOIN u USING (trajectory_id)),
b AS (SELECT *, coalesce(len(want), 0) > 0 AND len(list_filter(want, lambda w: len(list_filter(have, lambda x: abs(x - w) <= greatest(abs_t, rel_t * greatest(abs(x), abs(w))))) = 0)) = 0 AS "right",
 CASE WHEN queries = 0 THEN 0.0 ELSE beside / queries END AS q_beside, CASE WHEN queries = 0 THEN 0.0 ELSE repeats / queries END AS q_repeats FROM a),
s AS (SELECT *, least(1.0, greatest(0.0, 0.5 * least(1.0, ln(1 + greatest(queries - 4, 0)) / ln(9)) + 0.3 * least(1.0, ln(1 + greatest(tokens - 4000, 0) / 4000.0) / ln(4)) + 0.2 * (0.5 * q_beside + 0.5 * q_repeats))) AS c FROM b)"""


def _s(s: SparkSession, d: str) -> DataFrame:
    return contracts.signals(table(s, d, "trajectory"), table(s, d, "training_record"))


_COUNTS = ["queries", "repeats", "attempts", "successes", "unseen", "tokens", "beside", "unsafe"]
add("contract_signals", lambda s, d: _s(s, d).select("trajectory_id", *_COUNTS), f"{_S} SELECT trajectory_id, {', '.join(_COUNTS)} FROM s")
add("contract_right", lambda s, d: (lambda x: x.select("trajectory_id", contracts.right(x).alias("right")))(_s(s, d)), f'{_S} SELECT trajectory_id, "right" FROM s')
_LAYER = "CASE WHEN unsafe > 0 OR queries > 16 OR tokens > 32000 THEN 'unsafe_or_budget' WHEN unseen > 0 THEN 'unknown' WHEN attempts = 0 THEN 'no_attempt' WHEN successes = 0 THEN 'attempt_failed' WHEN NOT \"right\" THEN 'success_wrong_final' ELSE 'success_correct_final' END"
_REWARD = "round(CASE layer WHEN 'attempt_failed' THEN 0.1 * (1 - c) WHEN 'success_wrong_final' THEN 0.2 * (1 - c) WHEN 'success_correct_final' THEN 1 - 0.2 * c ELSE 0.0 END, 6)"
add("contract_tiered", lambda s, d: contracts.tiered(_s(s, d)), f"{_S}, l AS (SELECT *, {_LAYER} AS layer FROM s) SELECT trajectory_id, layer, {_REWARD} AS reward, CAST(CASE WHEN layer = 'unknown' THEN 0 ELSE 1 END AS DOUBLE) AS train_mask FROM l")
add(
    "contract_tri_state",
    lambda s, d: contracts.tri_state(_s(s, d)),
    f"{_S} SELECT trajectory_id, CASE WHEN g IS NULL OR unseen > 0 OR trim(coalesce(final_answer, ''), ' ') = '' THEN 'UNKNOWN' WHEN NOT \"right\" THEN 'FAIL' WHEN attempts = 0 THEN 'UNKNOWN' WHEN successes > 0 AND beside < queries THEN 'PASS' ELSE 'FAIL' END AS state FROM s",
)
_BLEND = f"""{_S}, p AS (SELECT *, CASE WHEN "right" THEN 1.0 ELSE 0.0 END AS result, CASE WHEN queries = 0 THEN 0.0 ELSE (queries - beside) / queries END AS own, CASE WHEN attempts = 0 THEN 0.0 ELSE successes / attempts END AS good FROM s),
q AS (SELECT *, round(0.3 * own + 0.7 * good, 6) AS process, round(1 - least(1.0, 0.1 * unsafe + 0.05 * (repeats + 0) + 0.2 * greatest(attempts - successes, 0)), 6) AS thrift FROM p),
w AS (SELECT *, CASE WHEN length(regexp_replace(coalesce(final_answer, ''), '\\s+', '', 'g')) >= 20 THEN round(0.4 * result + 0.4 * process + 0.2 * thrift, 6) ELSE 0.0 END AS blend, round(0.60 * result + 0.25 * CASE WHEN successes > 0 THEN 1 ELSE 0 END + 0.10 * own + 0.05 * CASE WHEN trim(coalesce(final_answer, ''), ' ') <> '' THEN 1 ELSE 0 END, 6) AS evidence FROM q)
SELECT trajectory_id, CAST(result AS DOUBLE) AS result, process, CAST(thrift AS DOUBLE) AS thrift, blend, evidence, round(0.7 * blend + 0.3 * evidence, 6) AS mixed FROM w"""
add("contract_blended", lambda s, d: contracts.blended(_s(s, d)), _BLEND)
_REASON = "CASE WHEN g IS NULL THEN 'no_record' WHEN failed THEN 'runtime_error' WHEN timed_out THEN 'timeout' WHEN attempts = 0 THEN 'no_query' WHEN successes = 0 THEN 'no_success' WHEN beside >= queries THEN 'other_tables' WHEN NOT \"right\" THEN 'wrong_answer' ELSE 'right' END"
add("contract_minimal", lambda s, d: contracts.minimal(_s(s, d)), f"{_S} SELECT trajectory_id, CAST(CASE WHEN {_REASON} = 'right' THEN 1 ELSE 0 END AS DOUBLE) AS reward, {_REASON} AS reason FROM s")
_SHOWN = _numbers("array_to_string(list_transform(ev, lambda e: coalesce(e.response_preview, '')), chr(10))")
add(
    "contract_supported",
    lambda s, d: contracts.supported(table(s, d, "trajectory").dropDuplicates(["trajectory_id"]), _s(s, d)),
    f'{_S}, n AS (SELECT *, {_SHOWN} AS xs FROM s) SELECT trajectory_id, "right", coalesce(len(want), 0) > 0 AND len(list_filter(want, lambda w: len(list_filter(xs, lambda x: abs(x - w) <= greatest(1e-3, 1e-5 * greatest(abs(x), abs(w))))) = 0)) = 0 AS seen FROM n',
)
add(
    "contract_last_bearing",
    lambda s, d: contracts.last_bearing_agrees(table(s, d, "trajectory")),
    f"""WITH t AS (SELECT trajectory_id, final_answer, unnest(coalesce(pi_tool_events, [])) AS e, unnest(range(len(coalesce(pi_tool_events, [])))) AS i FROM trajectory), n AS (SELECT trajectory_id, final_answer, CAST(i AS INTEGER) AS i, {_numbers("e.response_preview")} AS xs FROM t WHERE e.ok),
    l AS (SELECT trajectory_id, max(i) AS index, arg_max(xs[-1], i) AS x, any_value({_answer_numbers("final_answer")}) AS have FROM n WHERE len(xs) > 0 GROUP BY 1)
    SELECT t.trajectory_id, l.index, CASE WHEN l.index IS NOT NULL THEN len(list_filter(have, lambda h: abs(h - l.x) <= greatest(1e-3, 1e-5 * greatest(abs(h), abs(l.x))))) > 0 END AS agrees FROM trajectory t LEFT JOIN l USING (trajectory_id)""",
)


def _rewards(s: SparkSession, d: str) -> DataFrame:
    x = _s(s, d)
    return contracts.tiered(x).join(x.select("trajectory_id", "record_id", contracts.right(x).alias("right")), "trajectory_id")


add(
    "contract_rescored",
    lambda s, d: contracts.rescored(_rewards(s, d), "record_id", "right", "reward", 2),
    f"""{_S}, l AS (SELECT *, {_LAYER} AS layer FROM s), w AS (SELECT record_id, "right", {_REWARD} AS reward FROM l)
    SELECT record_id, count(*) AS n, min(reward) FILTER (WHERE "right") > max(reward) FILTER (WHERE NOT "right") AS ranked_band, avg(reward) FILTER (WHERE "right") > avg(reward) FILTER (WHERE NOT "right") AS ranked_dense, round(max(reward) - min(reward), 6) >= 0.05 AS meaningful FROM w GROUP BY 1 HAVING count(*) >= 2""",
)
add(
    "text_unsafe_commands",
    lambda s, d: table(s, d, "trajectory").select(F.explode("pi_tool_events").alias("e")).select(F.explode(tx.unsafe_reasons(F.col("e.arguments.command"))).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n")),
    "WITH x AS (SELECT unnest(pi_tool_events) AS e FROM trajectory), n AS (" + " UNION ALL ".join(f"SELECT '{k}' AS reason, count(*) FILTER (WHERE {v}) AS n FROM x" for k, v in _REASONS.items()) + ") SELECT * FROM n WHERE n > 0",
)
add(
    "text_numbers",
    lambda s, d: table(s, d, "trajectory").select("trajectory_id", F.size(tx.answer_numbers(F.col("final_answer"))).cast("bigint").alias("n"), F.round(F.aggregate(tx.answer_numbers(F.col("final_answer")), F.lit(0.0), lambda a, x: a + x), 4).alias("total")),
    f"WITH t AS (SELECT trajectory_id, {_answer_numbers('final_answer')} AS xs FROM trajectory) SELECT trajectory_id, len(xs) AS n, round(coalesce(list_sum(xs), 0.0), 4) AS total FROM t",
)




def _agreement(s: SparkSession, d: str) -> DataFrame:
    x = _s(s, d)
    human = x.select("trajectory_id", F.when(contracts.right(x), "PASS").otherwise("FAIL").alias("human"))
    return groups.agreement(contracts.tri_state(x).join(human, "trajectory_id"), "state", "human")


_STATE = "CASE WHEN g IS NULL OR unseen > 0 OR trim(coalesce(final_answer, ''), ' ') = '' THEN 'UNKNOWN' WHEN NOT \"right\" THEN 'FAIL' WHEN attempts = 0 THEN 'UNKNOWN' WHEN successes > 0 AND beside < queries THEN 'PASS' ELSE 'FAIL' END"
add("contract_agreement", _agreement, f'{_S}, z AS (SELECT {_STATE} AS st, "right" AS ok FROM s) SELECT count(*) AS n, round(count(*) FILTER (WHERE st = \'PASS\' AND ok) / nullif(count(*) FILTER (WHERE st = \'PASS\'), 0), 6) AS precision, round(count(*) FILTER (WHERE st = \'PASS\' AND ok) / nullif(count(*) FILTER (WHERE ok AND st <> \'UNKNOWN\'), 0), 6) AS recall, round(count(*) FILTER (WHERE st = \'UNKNOWN\') / count(*), 6) AS unknown_rate FROM z')


def _arm(s: SparkSession, d: str, k: int) -> DataFrame:
    x = _s(s, d)
    return x.where(f"sample_index = {k} and record_id is not null").select("record_id", contracts.right(x).alias("ok")).groupBy("record_id").agg(F.max("ok").alias("ok"))


add("contract_paired_outcomes", lambda s, d: stats.paired_outcomes(_arm(s, d, 0), _arm(s, d, 1), "record_id", "ok"), f'{_S}, z AS (SELECT record_id, sample_index AS k, bool_or("right") AS ok FROM s WHERE record_id IS NOT NULL AND sample_index IN (0, 1) GROUP BY 1, 2), j AS (SELECT a.ok AS x, b.ok AS y FROM z a JOIN z b ON a.record_id = b.record_id AND a.k = 0 AND b.k = 1) SELECT count(*) FILTER (WHERE x AND y) AS both, count(*) FILTER (WHERE x AND NOT y) AS only_left, count(*) FILTER (WHERE NOT x AND y) AS only_right, count(*) FILTER (WHERE NOT x AND NOT y) AS neither FROM j')


# --- statements -------------------------------------------------------------------------------------------------------
def _statements(s: SparkSession, d: str) -> DataFrame:
    """Every statement of every trajectory beside its record's gold one."""
    g = table(s, d, "training_record").select(F.col("record_id").alias("_r"), F.col(_SQL).alias("gold"), F.col("reward_model.ground_truth.required_tables").alias("required"))
    t = table(s, d, "trajectory").select("trajectory_id", "record_id", F.explode("pi_tool_events").alias("e")).select("trajectory_id", "record_id", F.explode("e.sql_statements").alias("q"))
    return t.join(g, t.record_id == F.col("_r")).drop("_r")


_ST = f"WITH x AS (SELECT trajectory_id, record_id, unnest(pi_tool_events) AS e FROM trajectory), y AS (SELECT trajectory_id, record_id, unnest(e.sql_statements) AS q FROM x), st AS (SELECT y.*, r.{_SQL} AS gold, r.reward_model.ground_truth.required_tables AS required FROM y JOIN training_record r USING (record_id))"
_CALL = r"list_distinct(list_transform(regexp_extract_all(lower(coalesce({0}, '')), '\b((?:count|sum|avg|min|max)\s*\(\s*(?:distinct\s+)?(?:[a-z_][a-z0-9_]*\.)?(?:[a-z_][a-z0-9_]*|\*))', 1), lambda c: regexp_replace(regexp_replace(regexp_replace(c, '\s*\(\s*', ':', 'g'), '[a-z_][a-z0-9_]*\.', '', 'g'), '\s+', ' ', 'g')))"
_WHERE = r"regexp_extract(regexp_replace(coalesce({0}, ''), '\s+', ' ', 'g'), '(?i)\bwhere\b(.*?)(?:\bgroup by\b|\bhaving\b|\border by\b|\blimit\b|;|$)', 1)"
_LIT = "list_distinct(list_transform(regexp_extract_all(" + _WHERE + r", '''((?:[^'']|'''')*)''', 1), lambda x: lower(trim(x, ' '))))"
_lacks = lambda f, a, b: f"len(list_filter({f.format(a)}, lambda z: NOT list_contains({f.format(b)}, z))) > 0"
_READ = r"(regexp_matches(regexp_replace(trim(regexp_replace({0}, '''(?:[^'']|'''')*''', '''''', 'g'), ' '), ';\s*$', ''), '(?is)^\s*(?:select|with)\b') AND NOT contains(regexp_replace(trim(regexp_replace({0}, '''(?:[^'']|'''')*''', '''''', 'g'), ' '), ';\s*$', ''), ';') AND NOT regexp_matches(regexp_replace({0}, '''(?:[^'']|'''')*''', '''''', 'g'), '(?i)\b(?:insert|update|delete|drop|alter|create|replace|vacuum|attach|detach|pragma|merge|truncate|grant)\b'))"
add(
    "statement_strength",
    lambda s, d: _statements(s, d).groupBy(contracts.strength(F.col("q"), F.col("gold"), F.col("required")).alias("strength")).agg(F.count(F.lit(1)).alias("n")),
    f"{_ST} SELECT CASE WHEN q IS NULL OR trim(q, ' ') = '' THEN 'none' WHEN NOT {_READ.format('q')} THEN 'violating' WHEN len(list_filter(coalesce(required, []), lambda z: NOT list_contains({_tables('q')}, z))) > 0 THEN 'violating' WHEN {_lacks(_CALL, 'gold', 'q')} OR {_lacks(_LIT, 'gold', 'q')} THEN 'weak' ELSE 'strong' END AS strength, count(*) AS n FROM st GROUP BY 1",
)
_SOLID = r"lower(regexp_replace({0}, '[\s;]+', '', 'g'))"
add(
    "statement_evidence",
    lambda s, d: _statements(s, d).select("trajectory_id", contracts.evidence_mode(F.col("q"), F.col("gold")).alias("mode")).groupBy("trajectory_id", "mode").agg(F.count(F.lit(1)).alias("n")),
    f"{_ST} SELECT trajectory_id, CASE WHEN q IS NULL OR gold IS NULL THEN 'none' WHEN {_SOLID.format('q')} = {_SOLID.format('gold')} THEN 'exact' WHEN len(list_filter({_tables('gold')}, lambda z: NOT list_contains({_tables('q')}, z))) = 0 AND NOT ({_lacks(_CALL, 'gold', 'q')}) AND len(list_filter({_LIT.format('gold')}, lambda w: len(list_filter({_LIT.format('q')}, lambda c: c = w OR (regexp_full_match(w, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AND starts_with(c, w)))) = 0)) = 0 THEN 'safe_projection' ELSE 'none' END AS mode, count(*) AS n FROM st GROUP BY 1, 2",
)

# --- masks ------------------------------------------------------------------------------------------------------------
_TOK = r"regexp_extract_all(lower(" + _SQL + r"), '(''[^'']*''|[a-z_][a-z0-9_]*|[0-9]+(?:\.[0-9]+)?|[^\sa-z0-9_''])', 1)"
_KIND = f"CASE WHEN t IN ({_list(masks.AGGREGATES)[1:-1]}) THEN 'aggregate' WHEN t IN ({_list(masks.STARTS)[1:-1]}) THEN 'query_start' WHEN t IN ({_list(masks.CLAUSES)[1:-1]}) THEN 'clause' WHEN regexp_matches(t, '^[0-9'']') THEN 'literal' WHEN regexp_matches(t, '^[a-z_]') THEN 'identifier' ELSE 'punctuation' END"


def _tokens(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "training_record").select("record_id", masks.tokens(F.col(_SQL)).alias("toks"))


add("mask_token_kinds", lambda s, d: _tokens(s, d).select(F.explode("toks").alias("t")).groupBy(masks.kind(F.col("t")).alias("kind")).agg(F.count(F.lit(1)).alias("n")), f"SELECT {_KIND} AS kind, count(*) AS n FROM (SELECT unnest({_TOK}) AS t FROM training_record) GROUP BY 1")
_masks = lambda x: x.withColumns({k: masks.component(F.col("toks"), k) for k in masks.KINDS})
_total = lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x).cast("bigint")
add(
    "mask_components",
    lambda s, d: _masks(_tokens(s, d)).select("record_id", F.size("toks").cast("bigint").alias("tokens"), *(_total(F.col(k)).alias(k) for k in masks.KINDS)),
    f"SELECT record_id, len(toks) AS tokens, " + ", ".join(f"len(list_filter(toks, lambda t: {_KIND} = '{k}')) AS {k}" for k in masks.KINDS) + f" FROM (SELECT record_id, {_TOK} AS toks FROM training_record)",
)
add(
    "mask_weighted",
    lambda s, d: _masks(_tokens(s, d)).select("record_id", masks.weighted([(F.col("aggregate"), 4.0), (F.col("literal"), 2.0), (F.col("identifier"), 1.0)]).alias("w"), "literal").select("record_id", F.round(F.aggregate(masks.emphasised(F.col("w"), F.col("literal"), 1, 8.0), F.lit(0.0), lambda a, x: a + x), 6).alias("total"), masks.subset(F.col("literal"), F.transform("w", lambda x: (x > 0).cast("int"))).alias("inside")),
    f"WITH t AS (SELECT record_id, {_TOK} AS toks FROM training_record), n AS (SELECT record_id, list_transform(toks, lambda t: {_KIND}) AS k FROM t) SELECT record_id, round(4.0 * len(list_filter(k, lambda x: x = 'aggregate')) + 2.0 * len(list_filter(k, lambda x: x = 'literal')) + 1.0 * len(list_filter(k, lambda x: x = 'identifier')) + CASE WHEN len(list_filter(k, lambda x: x = 'literal')) > 1 THEN 6.0 ELSE 0.0 END, 6)::DOUBLE AS total, CASE WHEN k IS NOT NULL THEN true END AS inside FROM n",
)
add(
    "mask_ranges",
    lambda s, d: table(s, d, "trajectory").select("trajectory_id", F.greatest(F.coalesce("num_turns", F.lit(0)), F.lit(0)).alias("n")).select("trajectory_id", masks.from_ranges(F.col("n"), F.array(F.struct(F.lit(0).alias("start"), F.lit(1).alias("end")), F.struct((F.col("n") - 2).alias("start"), F.col("n").alias("end")))).alias("m")).select("trajectory_id", F.concat_ws("", F.transform("m", lambda x: x.cast("string"))).alias("mask")),
    "WITH t AS (SELECT trajectory_id, greatest(coalesce(num_turns, 0), 0) AS n FROM trajectory) SELECT trajectory_id, array_to_string(list_transform(range(n), lambda i: CASE WHEN i < 1 OR (i >= n - 2 AND i < n) THEN '1' ELSE '0' END), '') AS mask FROM t",
)
