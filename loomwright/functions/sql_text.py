"""SQL text and transcripts that need more than expressions: Arrow-batched pandas UDFs over pure functions."""

from __future__ import annotations

import difflib
import hashlib
import json
import re
import shlex

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LEX = re.compile(r"--[^\n]*|/\*.*?\*/|'(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`|\[[^\]]*\]|[A-Za-z_][\w$]*|\d+(?:\.\d+)?|<=|>=|<>|!=|\|\||\S", re.S)
_CLAUSES = ("select", "from", "where", "group", "having", "order", "limit")


def sql_tokens(sql: str) -> list[str]:
    """Tokens without comments; names unquoted and folded, string literals kept as they are."""
    out = []
    for t in _LEX.findall(sql or ""):
        if t.startswith(("--", "/*")):
            continue
        if t[0] in "\"`[" and len(t) > 1:
            t = t[1:-1].lower()
        out.append(t if t.startswith("'") else t.lower())
    return out


def clauses(sql: str) -> dict[str, list[str]]:
    """Tokens of each clause of the outermost SELECT; words inside parentheses stay in their clause."""
    out: dict[str, list[str]] = {c: [] for c in _CLAUSES}
    now, depth = "", 0
    for t in sql_tokens(sql):
        depth += (t == "(") - (t == ")")
        if depth == 0 and t in out:
            now = t
        elif now and t not in (";", "by"):
            out[now].append(t)
    return out


def split_top(tokens: list[str], by: str = ",") -> list[list[str]]:
    """Parts between separators outside parentheses."""
    parts: list[list[str]] = [[]]
    depth = 0
    for t in tokens:
        depth += (t == "(") - (t == ")")
        if t == by and depth == 0:
            parts.append([])
        else:
            parts[-1].append(t)
    return [p for p in parts if p]


def aliases(sql: str) -> dict[str, str]:
    """Alias or name -> table of the FROM clause."""
    out, toks = {}, clauses(sql)["from"]
    for i, t in enumerate(toks):
        if i == 0 or toks[i - 1] in ("join", ","):
            rest = toks[i + 1 : i + 3]
            name = rest[1] if rest[:1] == ["as"] and len(rest) > 1 else rest[0] if rest and rest[0] not in ("join", "on", "inner", "left", "right", "cross", "full", ",") else t
            if re.match(r"[a-z_]", t):
                out[name] = t
    return out


def signature(sql: str) -> dict[str, str]:
    """The clauses as canonical text with aliases resolved; select list and conjunction as bags."""
    c, names = clauses(sql), aliases(sql)

    def say(toks: list[str]) -> str:
        out = []
        for i, t in enumerate(toks):
            out.append(names.get(t, t) if i + 1 < len(toks) and toks[i + 1] == "." else t)
        return " ".join(out)

    joined: list[list[str]] = [[]]
    for t in c["where"]:
        if t == "and":
            joined.append([])
        else:
            joined[-1].append(t)
    return {
        "tables": " ".join(sorted(set(names.values()))), "select": " , ".join(sorted(map(say, split_top(c["select"])))), "filter": " and ".join(sorted(say(p) for p in joined if p)),
        "group": " , ".join(sorted(map(say, split_top(c["group"])))), "having": say(c["having"]), "order": say(c["order"]), "limit": say(c["limit"]),
    }


def difference(wrong: str, right: str) -> list[str]:
    """Labels of the clauses in which two statements differ, the weightiest first."""
    a, b = signature(wrong), signature(right)
    labels = []
    if a["tables"] != b["tables"]:
        labels.append("table")
    time = lambda s: sorted(re.findall(r"'\d{4}-\d{2}(?:-\d{2})?'", s["filter"]))
    if time(a) != time(b):
        labels.append("temporal")
    calls = lambda s: sorted(re.findall(r"\b(?:count|sum|avg|min|max) \( .*? \)", s["select"]))
    if calls(a) != calls(b):
        labels.append("aggregation")
    if re.sub(r"'\d{4}-\d{2}(?:-\d{2})?'", "?", a["filter"]) != re.sub(r"'\d{4}-\d{2}(?:-\d{2})?'", "?", b["filter"]):
        labels.append("filter")
    if a["group"] != b["group"] or a["having"] != b["having"]:
        labels.append("grouping")
    if a["select"] != b["select"] and "aggregation" not in labels:
        labels.append("select")
    if (a["order"], a["limit"]) != (b["order"], b["limit"]):
        labels.append("order_limit")
    return labels


def literal_free(sql: str) -> str:
    """The canonical statement with its literals replaced: one form for a family of statements."""
    return re.sub(r"'(?:[^']|'')*'|(?<![\w.])\d+(?:\.\d+)?", "?", json.dumps(signature(sql), sort_keys=True))


def selects(command: str) -> list[str]:
    """Read-only statements that a shell command runs: quoted arguments of sqlite3, here-documents and calls in code."""
    found = []
    try:
        words = shlex.split(command or "")
    except ValueError:
        words = []
    for i, w in enumerate(words):
        if w.rsplit("/", 1)[-1].lower() == "sqlite3":
            found += [p for x in words[i + 1 :] for p in x.split(";") if re.match(r"\s*(?:select|with)\s", p, re.I)]
    found += re.findall(r"<<\s*['\"]?(?:\w+)['\"]?\n\s*((?:select|with)\b.*?)(?:;|\n\w+\s*$)", command or "", re.I | re.S)
    found += [m[1] for m in re.findall(r"(?:execute|read_sql(?:_query)?)\(\s*(?:text\(\s*)?(\"\"\"|'''|\"|')\s*((?:select|with)\b.*?)\1", command or "", re.I | re.S)]
    out, seen = [], set()
    for s in found:
        s = s.strip().rstrip(";").strip()
        key = " ".join(s.lower().split())
        if key not in seen:
            seen.add(key), out.append(s)
    return out


def tagged_messages(transcript: str) -> list[dict]:
    """A tagged transcript as messages: think blocks dropped, each call with the response that follows it."""
    out: list[dict] = []
    for kind, body, text in re.findall(r"<(think|tool_call|tool_response)>(.*?)</\1>|([^<]+|<)", transcript or "", re.S):
        if kind == "tool_call":
            try:
                call = json.loads(body)
            except ValueError:
                call = {"name": None, "arguments": body.strip()}
            call = call if isinstance(call, dict) else {"name": None, "arguments": call}
            args = call.get("arguments")
            out.append({"role": "assistant", "content": None, "call_name": call.get("name"), "call_arguments": args if isinstance(args, str) else json.dumps(args, sort_keys=True, ensure_ascii=False)})
        elif kind == "tool_response":
            out.append({"role": "tool", "content": body.strip(), "call_name": None, "call_arguments": None})
        elif not kind and text.strip():
            if out and out[-1]["role"] == "assistant" and out[-1]["content"] is not None:
                out[-1]["content"] += text
            else:
                out.append({"role": "assistant", "content": text, "call_name": None, "call_arguments": None})
    return out


def edit_mask(chosen: list[int], rejected: list[int]) -> list[int]:
    """1 for the tokens of `chosen` that differ; a pure deletion marks the token after the gap, or the last one."""
    mask = [0] * len(chosen)
    for op, a, b, _, _ in difflib.SequenceMatcher(None, list(chosen), list(rejected), autojunk=False).get_opcodes():
        if op == "equal":
            continue
        for k in range(a, b) if b > a else [min(a, len(chosen) - 1)]:
            if mask:
                mask[k] = 1
    return mask


def find_all(sequence: list[int], needle: list[int]) -> list[int]:
    """Starts of a needle in a sequence, overlapping ones included; an empty needle has none."""
    n = len(needle)
    return [i for i in range(len(sequence) - n + 1) if list(sequence[i : i + n]) == list(needle)] if n else []


def canonical_hash(text: str) -> str | None:
    """SHA-256 of JSON text with sorted keys and without nulls in objects; null for what isn't JSON."""

    def drop(v):
        return {k: drop(x) for k, x in v.items() if x is not None} if isinstance(v, dict) else [drop(x) for x in v] if isinstance(v, list) else 0.0 if v == 0 and isinstance(v, float) else v

    try:
        return hashlib.sha256(json.dumps(drop(json.loads(text)), sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
    except (TypeError, ValueError):
        return None


def _udf(fn, kind: T.DataType):
    """Pandas UDFs of one and of two columns that map fn, null (a struct: of nulls) where the first is null."""
    struct = isinstance(kind, T.StructType)

    def run(*cols):
        rows = [None if x[0] is None else fn(*x) for x in zip(*cols)]
        return pd.DataFrame([r or {} for r in rows], columns=kind.names, dtype=object) if struct else pd.Series(rows, dtype=object)

    if struct:

        def rows_of(a: pd.Series) -> pd.DataFrame:
            return run(a)

        return {1: F.pandas_udf(rows_of, kind)}

    def one(a: pd.Series) -> pd.Series:
        return run(a)

    def two(a: pd.Series, b: pd.Series) -> pd.Series:
        return run(a, b)

    return {1: F.pandas_udf(one, kind), 2: F.pandas_udf(two, kind)}


_S, _L = T.StringType(), T.ArrayType(T.StringType())
tokens_udf = _udf(sql_tokens, _L)[1]
selects_udf = _udf(selects, _L)[1]
difference_udf = _udf(difference, _L)[2]
literal_free_udf = _udf(literal_free, _S)[1]
canonical_hash_udf = _udf(canonical_hash, _S)[1]
signature_udf = _udf(signature, T.StructType([T.StructField(k, _S) for k in ("tables", "select", "filter", "group", "having", "order", "limit")]))[1]
messages_udf = _udf(tagged_messages, T.ArrayType(T.StructType([T.StructField(k, _S) for k in ("role", "content", "call_name", "call_arguments")])))[1]
edit_mask_udf = _udf(edit_mask, T.ArrayType(T.IntegerType()))[2]
find_all_udf = _udf(find_all, T.ArrayType(T.IntegerType()))[2]


def mutate(sql: str, kind: str) -> str | None:
    """A statement with one fault of a kind for testing verifiers; null where the kind doesn't apply."""
    if kind == "time":
        out = re.sub(r"'(\d{4})-(\d{2})-(\d{2})'", lambda m: f"'{int(m[1]) - 1:04d}-{m[2]}-{m[3]}'", sql)
    elif kind == "value":
        out = re.sub(r"(=\s*)'([^'\d][^']*)'", r"\1'\2_x'", sql, count=1)
    elif kind == "aggregate":
        swap = {"sum": "AVG", "avg": "SUM", "min": "MAX", "max": "MIN"}
        out = re.sub(r"\b(sum|avg|min|max)\(", lambda m: swap[m[1].lower()] + "(", sql, count=1, flags=re.I)
    elif kind == "order":
        out = re.sub(r"\b(desc)\b", "ASC", sql, count=1, flags=re.I)
    elif kind == "limit":
        out = re.sub(r"\blimit\s+(\d+)", lambda m: f"LIMIT {int(m[1]) + 1}", sql, flags=re.I)
    elif kind == "group":
        out = re.sub(r"\s+group by\b.*?(?=\bhaving\b|\border by\b|\blimit\b|$)", " ", sql, flags=re.I | re.S)
    elif kind == "having":
        out = re.sub(r"\bhaving count\(\*\) >= (\d+)", lambda m: f"HAVING COUNT(*) >= {int(m[1]) + 7}", sql, flags=re.I)
    else:
        raise ValueError(kind)
    return out if out != sql else None


MUTATIONS = ("time", "value", "aggregate", "order", "limit", "group", "having")
