"""Text, SQL-text and number functions as Column expressions, inside whole-stage code generation.

Java's word class is ASCII by default; patterns that must not match inside a word of any script begin with (?U).
Null input gives null, or an empty array where the result is one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A number: sign, thousands separators or plain digits, fraction, exponent; not inside a word or after a point.
NUMBER = r"(?U)(?<![\w.])[-+]?(?:\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?|\.\d+)(?:[eE][-+]?\d+)?(?![\w])"
DATE = r"\d{4}[-/.年]\d{1,2}(?:[-/.月]\d{1,2}日?)?"
TIME = r"\d{1,2}:\d{2}(?::\d{2})?"
WRITE = r"(?i)\b(?:insert|update|delete|drop|alter|create|replace|vacuum|attach|detach|pragma|merge|truncate|grant)\b"
_STRING = r"'(?:[^']|'')*'"


def numbers(text: Column) -> Column:
    """ARRAY<DOUBLE> of the finite numbers in order."""
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(NUMBER), F.lit(0)), lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("double"))
    return F.filter(found, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def answer_numbers(text: Column) -> Column:
    """Numbers after dates and times are blanked."""
    return numbers(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), DATE, " "), TIME, " "))


def final_answer(transcript: Column) -> Column:
    """What the last assistant turn shows, up to the next speaker's: without think, call and response blocks, trimmed."""
    last = F.element_at(F.split(transcript, r"<\|im_start\|>assistant\s*|(?m)^assistant:\s*"), -1)
    own = F.element_at(F.split(last, r"<\|im_end\|>|<\|im_start\|>|(?m)^(?:user|tool|system):"), 1)
    shown = F.regexp_replace(own, r"(?s)<(think|tool_call|tool_response)>.*?</\1>", "")
    return F.trim(F.regexp_replace(shown, r"^\s+|\s+$", ""))


def folded(text: Column) -> Column:
    """Without surrounding emphasis and quotes, single blanks, lower case."""
    bare = F.regexp_replace(F.trim(text.cast("string")), r"^[`*_~\"']+|[`*_~\"']+$", "")
    return F.lower(F.trim(F.regexp_replace(bare, r"\s+", " ")))


def single_number(cell: Column) -> Column:
    """The number of a cell that holds just one, with currency, percent or emphasis around it; else null."""
    t = F.trim(cell.cast("string"))
    n = numbers(t)
    rest = F.regexp_replace(F.regexp_replace(t, NUMBER, ""), r"[￥¥$€£%％`*_~()（）\[\]{}\s]", "")
    return F.when((F.size(n) == 1) & (rest == ""), n[0])


def table_names(sql: Column) -> Column:
    """Sorted distinct lower-case names after FROM and JOIN."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(sql, F.lit("")), F.lit(r"(?i)\b(?:from|join)\s+[`\"\[]?([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1)), F.lower)))


def aggregate_calls(sql: Column) -> Column:
    """Sorted distinct `function:column` of the aggregate calls, `distinct` kept, table prefixes dropped."""
    calls = F.regexp_extract_all(F.lower(F.coalesce(sql, F.lit(""))), F.lit(r"\b((?:count|sum|avg|min|max)\s*\(\s*(?:distinct\s+)?(?:[a-z_][a-z0-9_]*\.)?(?:[a-z_][a-z0-9_]*|\*))"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(calls, lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\s*\(\s*", ":"), r"[a-z_][a-z0-9_]*\.", ""), r"\s+", " "))))


def where_clause(sql: Column) -> Column:
    return F.trim(F.regexp_extract(F.regexp_replace(F.coalesce(sql, F.lit("")), r"\s+", " "), r"(?i)\bwhere\b(.*?)(?:\bgroup by\b|\bhaving\b|\border by\b|\blimit\b|;|$)", 1))


def where_literals(sql: Column) -> Column:
    """Sorted distinct lower-case string literals of the WHERE clause."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(where_clause(sql), F.lit(r"'((?:[^']|'')*)'"), F.lit(1)), lambda x: F.lower(F.trim(x)))))


def where_numbers(sql: Column) -> Column:
    """Sorted distinct number literals of the WHERE clause, as text."""
    bare = F.regexp_replace(where_clause(sql), _STRING, " ")
    return F.array_sort(F.array_distinct(F.regexp_extract_all(bare, F.lit(r"(?<![A-Za-z0-9_.])([-+]?\d+(?:\.\d+)?)"), F.lit(1))))


def read_only(sql: Column) -> Column:
    """One SELECT or WITH statement without a word that writes."""
    body = F.regexp_replace(F.trim(F.regexp_replace(sql, _STRING, "''")), r";\s*$", "")
    return body.rlike(r"(?is)^\s*(?:select|with)\b") & ~body.contains(";") & ~body.rlike(WRITE)


# fixed values: programs by what they do, host folders, Python modules that open connections
NETWORK = ("curl", "wget", "nc", "ncat", "ssh", "scp", "ftp", "telnet", "rsync")
DESTRUCTIVE = ("rm", "mkfs", "dd", "shutdown", "reboot", "kill", "pkill", "chmod", "chown", "mv")
HOST_FOLDERS = ("etc", "root", "home", "proc", "sys", "var", "opt", "mnt", "data")
MODULES = ("socket", "urllib", "requests", "httpx", "aiohttp", "ftplib", "smtplib")
LISTING = ("find", "ls", "du", "tree")
FAMILY_PROGRAMS = ("ls", "find", "cat", "sed", "head", "tail", "grep", "rg", "pwd", "wc")


def words(command: Column) -> Column:
    """A command's words: its parts between blanks, separators of commands and quotes, lower case."""
    return F.filter(F.split(F.lower(F.coalesce(command, F.lit(""))), r"[\s;&|'\"()`]+"), lambda w: w != "")


def programs(command: Column) -> Column:
    """The first word of each of a command's parts, without its folder; `cd` and its target are no program."""
    parts = F.transform(F.split(F.lower(F.coalesce(command, F.lit(""))), r"[;&|\n]+"), lambda p: F.trim(p))
    return F.filter(F.transform(parts, lambda p: F.substring_index(F.substring_index(p, " ", 1), "/", -1)), lambda w: ~w.isin("", "cd"))


def unsafe_reasons(command: Column) -> Column:
    """ARRAY<STRING> of why a command is refused; paths under /workspace are the command's own."""
    all_words = words(command)
    foreign = F.filter(all_words, lambda w: w.startswith("/") & ~((w == "/workspace") | w.startswith("/workspace/")))
    any_of = lambda names: F.arrays_overlap(all_words, F.array(*map(F.lit, names)))
    # fixed values: the names of the reasons
    rules = {
        "network": any_of(NETWORK),
        "destructive": any_of(DESTRUCTIVE),
        "host_path_escape": F.exists(foreign, lambda w: F.element_at(F.split(w, "/"), 2).isin(*HOST_FOLDERS)) | F.exists(all_words, lambda w: F.contains(w, F.lit("../.."))),
        "python_network": F.exists(all_words, lambda w: F.regexp_replace(F.substring_index(w, ".", 1), "[,:]+$", "").isin(*MODULES)),
        "root_scan": F.arrays_overlap(programs(command), F.array(*map(F.lit, LISTING))) & F.exists(foreign, lambda w: w.isin("/", "/*")),
    }
    return F.array_compact(F.array(*(F.when(rule, F.lit(name)) for name, rule in rules.items())))


def _reads(command: Column) -> Column:
    return F.arrays_overlap(words(command), F.array(F.lit("select"), F.lit("with")))


def executes_sql(command: Column) -> Column:
    """Whether a command hands a query to the SQLite shell."""
    return F.array_contains(F.transform(words(command), lambda w: F.substring_index(w, "/", -1)), "sqlite3") & _reads(command)


def command_family(command: Column) -> Column:
    """What kind of tool call a shell command is; a query is told before the words that write."""
    c = F.lower(F.trim(command))
    first = F.element_at(F.concat(programs(command), F.array(F.lit(""))), 1)
    dots = F.filter(words(command), lambda w: w.startswith("."))
    writes = F.exists(words(command), lambda w: w.rlike("^(?:insert|update|delete|drop|alter|create|replace|vacuum|attach|detach|merge|truncate|grant)$"))
    # fixed values: the names of the families
    sqlite = (
        F.when(F.arrays_overlap(dots, F.array(*map(F.lit, (".tables", ".databases", ".dbinfo")))), "sqlite_schema_catalog")
        .when(F.array_contains(dots, ".schema"), "sqlite_schema_definition")
        .when(F.exists(words(command), lambda w: w.startswith("pragma")), "sqlite_schema_pragma")
        .when(_reads(command), "sqlite_readonly")
        .when(writes, "sqlite_mutating_or_unsafe")
        .otherwise("sqlite_path_or_cli_only")
    )
    return F.when(c.isNull() | (c == ""), "empty").when(F.contains(c, F.lit("sqlite")), sqlite).when(first.startswith("python"), "python").when(first.isin(*FAMILY_PROGRAMS), first).otherwise("other")


def uses_identifier(text: Column, name: Column) -> Column:
    """Whether a whole identifier occurs in a text, in any case."""
    return F.regexp_like(F.lower(text), F.concat(F.lit(r"(?<![a-z0-9_])\Q"), F.lower(name), F.lit(r"\E(?![a-z0-9_])")))


def keep_ends(text: Column, lines: int, tail: bool = False) -> Column:
    """The first or last `lines` lines."""
    parts = F.split(text, "\n")
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - (lines - 1), F.lit(1)), lines) if tail else F.slice(parts, 1, lines), "\n")


def masked_opening(text: Column, chars: int = 24) -> Column:
    """The start of an instruction with its months, quotations and digits masked."""
    t = F.regexp_replace(F.lower(text), r"\d{4}年\d{1,2}月|(?:january|february|march|april|may|june|july|august|september|october|november|december) \d{4}", "<month>")
    t = F.regexp_replace(F.regexp_replace(t, r"[“\"'「][^”\"'」]*[”\"'」]", "<value>"), r"[0-9]+", "#")
    return F.left(t, F.lit(chars))


def close(a: Column, b: Column, abs_tol: float = 1e-3, rel_tol: float = 1e-5) -> Column:
    """|a - b| within the larger of the absolute tolerance and the relative one of the larger magnitude."""
    return F.abs(a - b) <= F.greatest(F.lit(rel_tol) * F.greatest(F.abs(a), F.abs(b)), F.lit(abs_tol))
