"""Queries of this subpackage by name, and the SQL of those that SQL can state."""

from __future__ import annotations

from . import answer_defects, cross_split, cut_texts, layout_copies, leak, mixture, reading_level


def queries() -> dict:
    return {
        "p1_found": cross_split.p1_found,
        "p1_classes": cross_split.p1_classes,
        "p1_report": cross_split.p1_report,
        "p2_found": answer_defects.p2_found,
        "p2_clauses": answer_defects.p2_clauses,
        "p3_found": cut_texts.p3_found,
        "p3_evidence": cut_texts.p3_evidence,
        "p3_shares": cut_texts.p3_shares,
        "p4_found": layout_copies.p4_found,
        "p4_hot": layout_copies.p4_hot,
        "p4_counts": layout_copies.p4_counts,
        "p6_found": leak.p6_found,
        "p6_items": leak.p6_items,
        "p6_spans": leak.p6_spans,
        "p7_chosen": mixture.p7_chosen,
        "p7_shares": mixture.p7_shares,
        "p7_shards": mixture.p7_shards,
        "p8_grades": reading_level.p8_grades,
        "p8_error": reading_level.p8_error,
        "p8_profile": reading_level.p8_profile,
    }


_FULL = "".join(chr(c) for c in range(0xFF01, 0xFF5F)).replace("'", "''") + "\u3000"
_HALF = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)).replace("'", "''") + " "


def _narrow(x: str) -> str:
    return f"replace(replace(lower(translate({x}, '{_FULL}', '{_HALF}')), '\u2265', '>='), '\u2264', '<=')"


def _keep(x: str, signs: str) -> str:
    """Letters, digits, decimal points and signs; an '=' only after a comparison sign. RE2 has no look-around, so marks stand in."""
    dots = f"regexp_replace(regexp_replace({x}, '([0-9])\\.([0-9])', '\\1\ue000\\2', 'g'), '([0-9])\\.([0-9])', '\\1\ue000\\2', 'g')"
    kept = f"regexp_replace({dots}, '[^\\pL\\pN\ue000{signs}]+', '', 'g')"
    return f"replace(replace(regexp_replace({kept}, '([<>!])=', '\\1\ue003', 'g'), '=', ''), '\ue003', '=')"


_FIELD = r"^[^\pL\pN]*\pL[\pL\pN _\x{00a0}\x{2003}\t]{0,24}?\s*[=:].*[\pL\pN]"
_HEAD = "split_part(replace(p, '=', ':'), ':', 1)"
_ONE = f"{_keep(_HEAD, '<>=')} || '\ue002' || {_keep(f'substr(p, length({_HEAD}) + 2)', '<>=')}"
_SIGNS = "<>=!*/+%\ue001"
_COPIES = f"""WITH t AS (SELECT task_no AS id, {_narrow('natural_language_instruction')} AS t FROM task WHERE task_no IS NOT NULL),
u AS (SELECT id, t, list_filter(regexp_split_to_array(regexp_replace(t, '(?m)^[ \t]*[-*#>]+[ \t]+', '', 'g'), '[;,/|\u3001\n\r\u3002]+'), lambda p: regexp_matches(p, '[\\pL\\pN]')) AS ps FROM t),
k AS (SELECT 'task' AS table_name, id, CASE WHEN length(t) - length(replace(replace(t, '=', ''), ':', '')) >= 2 AND len(ps) >= 2 AND len(list_filter(ps, lambda p: NOT regexp_matches(p, '{_FIELD}'))) = 0 THEN array_to_string(list_sort(list_transform(ps, lambda p: {_ONE})), '\ue002') ELSE {_keep('t', '<>=')} END AS key FROM u
UNION ALL SELECT 'training_record', id, array_to_string(list_sort(list_transform(string_split(cols, '\ue002'), lambda c: {_keep('c', _SIGNS)})), '\ue002') || '\ue002' || {_keep('rest', _SIGNS)} FROM (SELECT id, CASE WHEN h <> '' THEN regexp_replace(q, '^\\W*select .*? from ', '') ELSE q END AS rest, list_reduce(string_split(h, ','), lambda a, x: a || CASE WHEN length(replace(a, ')', '')) > length(replace(a, '(', '')) THEN '\ue001' ELSE '\ue002' END || x) AS cols
FROM (SELECT id, q, regexp_extract(q, '^\\W*select (.*?) from ', 1) AS h FROM (SELECT record_id AS id, regexp_replace({_narrow('reward_model.ground_truth.verification_sql')}, '\\s+', ' ', 'g') AS q FROM training_record WHERE record_id IS NOT NULL)))),
g AS (SELECT table_name, key, min(id) AS id_low, count(DISTINCT id) AS n_copies FROM k WHERE length(key) > 1 GROUP BY 1, 2)"""
_PAIRS = f"{_COPIES} SELECT DISTINCT table_name, id_low, id AS id_high FROM k JOIN g USING (table_name, key) WHERE id > id_low"


def oracle_sql() -> dict[str, str]:
    """Of the operators that SQL can state; the others are tested against brute force in tests/llm."""
    return {"p4_found": _PAIRS, "p4_hot": _PAIRS, "p4_counts": f"{_COPIES} SELECT table_name, id_low, n_copies FROM g"}
