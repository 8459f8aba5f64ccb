"""Problem 3: texts that were cut, by near-copies whose alignment ends early and by how their last words close.

1. A text's end is judged by its form in JVM expressions: unclosed fences, arrays, statements and table rows are cut,
   closed ones and sentences with their full stop are whole; the rest is open.
2. Open ends are scored by closing-word terminality: how often their last words close a sentence or a line anywhere in
   the two tables. Words that never close mean a cut.
3. Ends that look whole but stand at their source's length limit, and open ends that the limit doesn't show cut, are compared with longer near-copies
   (five-word shingles, min-hash banding, similarity 0.8): a verified longer copy that goes on where the text ends shows
   the cut.
A source's limit is where its longest texts pile up, in characters or in bytes; it is found from all lengths.

Defined results: null and blank texts are never cut; a null source is a source of its own; repeated rows are reported
once; short or unpunctuated texts are whole if their words close elsewhere or their ending recurs after the same opening.
"""

from __future__ import annotations

import re
import sys
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import maybe_broadcast, table, written

#: Banding: HASHES / ROWS bands of ROWS hashes; at similarity 0.8 a pair shares a band with probability 0.997.
HASHES, ROWS = 24, 3
SIMILAR = 0.8
#: Least number of equal hashes of a pair: at similarity 0.8, fewer have a probability of 0.001.
LEAST_EQUAL = 13
#: Ids of suspects and their copies (8 bytes each) that may be broadcast to pick their texts; beyond it they are shuffled.
MOST_IDS = 500_000
#: A copy that is longer by a word has a similarity of 0.8 from this many shingles on; shorter texts can have no such copy.
LEAST_SHINGLES = 4
#: Characters whose tokens are found at once, at about 100 bytes each.
CHUNK_CHARS = 200_000
#: Last words of a suspect that are aligned with its copy, and the edits that they may have.
TAIL, TAIL_EDITS = 12, 3
#: Texts that pile up at a source's longest length before it counts as a limit, and their least share of the long ones.
PILE, PILE_SHARE = 3, 0.25
#: An open end that closes at least this many sentences or lines elsewhere, and at least this many for each text that ends
#: so without closing, is whole. Both grow with the data, so their ratio doesn't.
CLOSES, CLOSE_RATIO = 2, 0.2
#: An ending recurs if this many rows of one opening have it and they are this share of the opening's rows.
RECURS, RECUR_SHARE = 3, 0.02

_MARK = r"(?:\s*(?:…|\.{3,}|\[(?:truncated|cut|more|…|\.{3}|output truncated|截断|已截断)\]|<(?:truncated|cut)>|\((?:truncated|cut|截断)\)|--more--|�+))+\s*$"
#: What a mark can end with: its own last characters, and what `\s` and `$` pass over.
_MARK_ENDS = "….])>-\ufffd \t\n\x0b\f\r\u0085\u2028\u2029"
_SPACE = " \t\r\n\u00a0\u2003\u3000"
_WRAPS = "\"'”’」』)）*_" + _SPACE
_CLOSERS = _WRAPS + "]}`>。！？!?.;；"


def texts(chat: DataFrame, trajectory: DataFrame) -> DataFrame:
    """(table_name, row_id, pos, source, text) of every message and preview that isn't null or blank."""
    c = chat.select(F.lit("chat_log").alias("table_name"), F.col("chat_id").alias("row_id"), "source_label", F.posexplode(F.transform("messages", lambda m: m["content"])).alias("pos", "text"))
    c = c.select("table_name", "row_id", F.col("pos").cast("bigint").alias("pos"), F.col("source_label").alias("source"), "text")
    e = trajectory.select(F.lit("trajectory").alias("table_name"), F.col("trajectory_id").alias("row_id"), F.posexplode(F.transform("pi_tool_events", lambda m: F.struct(m["source"].alias("s"), m["response_preview"].alias("t")))).alias("pos", "e"))
    e = e.select("table_name", "row_id", F.col("pos").cast("bigint").alias("pos"), F.col("e.s").alias("source"), F.col("e.t").alias("text"))
    return c.unionByName(e).where(F.col("text").rlike(r"\S"))


def limits(lengths: DataFrame) -> DataFrame:
    """(table_name, source, chars_limit, bytes_limit) from (table_name, source, chars, bytes, n); null where there is none.

    A limit in bytes may leave up to three bytes of a character or be followed by a replacement of as many.
    """
    key = ["table_name", "source"]
    out = None
    for unit, slack in (("chars", 0), ("bytes", 5)):
        top = F.max(unit).over(W.partitionBy(*key))
        one = lengths.groupBy(*key, unit).agg(F.sum("n").alias("n")).withColumn("top", top)
        g = one.groupBy(*key).agg(F.max("top").alias("top"), F.sum(F.when(F.col(unit) >= F.col("top") - slack, F.col("n"))).alias("pile"), F.sum(F.when(F.col(unit) >= F.col("top") * 0.85, F.col("n"))).alias("near"))
        g = g.select(*key, F.when((F.col("pile") >= PILE) & (F.col("pile") >= F.col("near") * PILE_SHARE), F.col("top")).alias(f"{unit}_limit"))
        out = g if out is None else out.join(g.select(F.col("table_name").alias("_t"), F.col("source").alias("_s"), f"{unit}_limit"), F.col("table_name").eqNullSafe(F.col("_t")) & F.col("source").eqNullSafe(F.col("_s"))).drop("_t", "_s")
    return out


def _plain_end(part: Column) -> Column:
    """The end of a text's part: without closing marks, in lower case, figures and blanks alike. No regex, as it runs on every sentence."""
    t = F.translate(F.lower(F.rtrim(F.right(part, F.lit(36)), F.lit(_CLOSERS))), "123456789０１２３４５６７８９\t\r\u00a0\u2003\u3000", "0" * 19 + " " * 5)
    for old, new in (("0000", "0"), ("00", "0"), ("00", "0"), ("0.0", "0"), ("   ", " "), ("  ", " ")):
        t = F.replace(t, F.lit(old), F.lit(new))
    return t


def _key(end: str) -> Column:
    """The last words of a plain end, which must be a column of its own: an expression would be computed once for each mention."""
    last = F.right(end, F.lit(1))
    return F.when((last >= "⺀") & (last <= "鿿"), F.right(end, F.lit(5))).otherwise(F.right(end, F.lit(11)))


#: Separators of `key=value` fields, each made a line's end.
_FIELDS = ";；,，/|"


def _field_key(part: Column) -> Column:
    """The end of a `key=value` field without its layout."""
    t = F.regexp_replace(F.lower(F.translate(part, "：:", "==")), r"[\s\u00a0\u2003　\"'“”‘’()（）*_。.–-]+", "")
    return F.concat(F.lit("="), F.right(F.regexp_replace(t, r"[0-9０-９]+", "0"), F.lit(10)))


def _has_fields(text: Column) -> Column:
    left = text
    for mark in "=:：":
        left = F.replace(left, F.lit(mark))
    return ~F.contains(text, F.lit("{")) & (F.length(text) - F.length(left) >= 3) & text.rlike(r"^[^\p{L}]*\p{L}[\p{L} _\u00a0\u2003\t]{0,20}\s*[=:：]")


def ending(df: DataFrame) -> DataFrame:
    """df (with text and marked) and what its form says: state 'cut', 'whole' or 'open', fields (it has `key=value` fields) and key, its last words.

    The parts are columns of their own, as expressions in several branches would be computed in each.
    """
    text = F.when(F.col("marked"), F.regexp_replace("text", _MARK, "")).otherwise(F.col("text"))
    p = df.withColumn("_t", F.rtrim(text, F.lit(_SPACE)))
    t = F.col("_t")
    p = p.withColumns({"_tail": F.substring_index(t, "\n", -1), "_head": F.substring_index(F.ltrim(t, F.lit(_SPACE)), "\n", 1), "_after": F.substring_index(t, "[", -1), "_fences": (F.length(t) - F.length(F.replace(t, F.lit("```")))) / 3})
    p = p.withColumn("_sep", F.when(F.col("_head").rlike(r"^[A-Za-z_]+(?:[,|\t][A-Za-z_ ]+)+$"), F.regexp_extract("_head", r"^[A-Za-z_]+([,|\t])", 1)).otherwise(""))
    tail, head, after, sep = (F.col(c) for c in ("_tail", "_head", "_after", "_sep"))
    n = lambda c: F.length(c) - F.length(F.replace(c, sep))
    pipes = F.length(tail) - F.length(F.replace(tail, F.lit("|")))
    last, lower = F.right(t, F.lit(1)), F.lower(F.left(t, F.lit(12)))
    ddl = lower == "create table"
    stopped = F.right(F.rtrim(F.right(t, F.lit(64)), F.lit(_WRAPS)), F.lit(1))
    state = (
        F.when(F.pmod("_fences", F.lit(2)) == 1, "cut")
        .when(F.contains(after, F.lit("{")) & ~F.contains(after, F.lit("]")) & after.rlike(r"^\s*\{"), "cut")
        .when((t.startswith("[{") | t.startswith("[\n {") | t.startswith("```json")) & ~F.contains(t, F.lit("]")), "cut")
        .when((t == "[") | (t == "{"), "cut")
        .when(ddl & (F.lower(F.left(tail, F.lit(12))) == "create table"), F.when((last == ")") | (last == ";"), "whole").otherwise("cut"))
        .when(ddl & ~last.isin("。", ".", "!"), F.when((last == ")") | (last == ";"), "whole").otherwise("cut"))
        .when(F.left(F.ltrim(tail), F.lit(1)) == "|", F.when((last == "|") & (pipes >= 3), "whole").otherwise("cut"))
        .when((sep != "") & (tail != head) & (n(tail) < n(head)), "cut")
        .when(sep != "", "open")
        .when(stopped.isin("。", "！", "？", "!", "?", ".") & ~t.endswith(".."), "whole")
        .when(last.isin("]", "}", "`"), "whole")
        .when(t.rlike(r"^[-+]?[0-9][0-9.,]*%?$"), "whole")
        .otherwise("open")
    )
    p = p.withColumn("state", state).withColumn("fields", _has_fields(t)).withColumn("_end", _plain_end(t))
    key = F.when((F.col("state") == "open") & (F.col("fields") | tail.rlike(r"^[^\p{L}=]*\p{L}[\p{L} _\u00a0\u2003\t]{0,20}\s*=")), _field_key(F.substring_index(F.translate(t, _FIELDS, "\n" * len(_FIELDS)), "\n", -1))).otherwise(_key("_end"))
    return p.withColumn("key", key).drop("_t", "_tail", "_head", "_after", "_sep", "_fences", "_end")


def closings(distinct: DataFrame) -> DataFrame:
    """(key, closes): how many sentences, lines and fields of the distinct texts end with these last words.

    Parts are exploded before their keys are taken: keys are then generated code, not interpreted lambdas. What follows
    the last stop of a text doesn't count, nor does a part that a text repeats.
    """
    lines = F.concat("text", F.lit(" "))
    for stop in ("。", "！", "？", ";", "；", ". ", "! ", "? "):
        lines = F.replace(lines, F.lit(stop), F.lit("\n"))
    inner = lambda parts: F.explode(F.array_distinct(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))))
    d = distinct.withColumn("_p", F.split(lines, "\n")).select(inner(F.col("_p")).alias("part")).where(F.length("part") > 1).withColumn("_end", _plain_end(F.col("part"))).select(_key("_end").alias("key"))
    f = distinct.where("fields").withColumn("_p", F.split(F.translate("text", _FIELDS, "\n" * len(_FIELDS)), "\n")).select(inner(F.col("_p")).alias("part")).select(_field_key(F.col("part")).alias("key"))
    return d.unionByName(f).groupBy("key").agg(F.count(F.lit(1)).alias("closes"))


def recurring(d: DataFrame) -> DataFrame:
    """(head, key) of endings that texts with the same opening often have: rows below the limits, per opening and ending."""
    rows = d.select(F.left("text", F.lit(6)).alias("head"), "key", F.when(~F.col("at_limit"), F.col("times")).otherwise(0).alias("n"), "times")
    per = rows.groupBy("head", "key").agg(F.sum("n").alias("n"), F.sum("times").alias("all"))
    total = per.groupBy("head").agg(F.sum("all").alias("total"))
    return per.where(F.col("n") >= RECURS).join(total, "head").where(F.col("n") >= F.col("total") * RECUR_SHARE).select("head", "key", F.lit(True).alias("recurs"))


#: Ends of a sentence, line or field, and a text that goes on before one.
_STOP = re.compile(r"[。！？.!?;；|\n]")
_ON = re.compile(r"[^\w。！？.!?;；|\n]*\w")
_TOKEN = re.compile(r"[a-z_]+|\d+(?:\.\d+)?|[^\W\d_a-z]")


def _tokens(t: str) -> list[str]:
    return _TOKEN.findall(t.lower())


@lru_cache(2_000)
def _held_tokens(t: str) -> list[str]:
    return _tokens(t)


@lru_cache(200_000)
def _code(word: str) -> int:
    return zlib.crc32(word.encode())


def _codes(t: str) -> np.ndarray:
    return np.array([_code(x) for x in _tokens(t)], np.uint64)


@lru_cache(1)
def _kinds() -> np.ndarray:
    """Of each code point: 1 in words, 2 in figures, 3 a word by itself, 0 in none of the tokens."""
    every = "".join(map(chr, range(sys.maxunicode + 1)))
    kind = np.fromiter(map(str.isalnum, every), np.uint8, len(every)) * np.uint8(3)
    kind[np.fromiter(map(str.isdecimal, every), bool, len(every))] = 2
    kind[[*map(ord, "abcdefghijklmnopqrstuvwxyz_")]] = 1
    return kind


def _batch_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the tokens of all texts, text after text, and each text's number of them: those of _tokens, found for all characters at once."""
    low = [t.lower() for t in texts]
    n = np.array([len(t) for t in low], np.int64)
    char = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(char):
        return np.zeros(0, np.uint64), np.zeros(len(n), np.int64)
    kind = _kinds()[char]
    first = kind == 3
    first[1:] |= kind[1:] != kind[:-1]
    opens = np.zeros(len(char), bool)
    opens[(np.cumsum(n) - n)[n > 0]] = True
    first = (first | opens) & (kind > 0)
    inside = kind > 0
    # a point joins two runs of digits, each of which can be joined once
    point = np.flatnonzero((char[1:-1] == ord(".")) & (kind[:-2] == 2) & (kind[2:] == 2) & ~opens[1:-1] & ~opens[2:]) + 1
    if len(point):
        token = np.cumsum(first)
        chain = np.r_[True, token[point[1:] - 1] != token[point[:-1] + 1]]
        at = np.arange(len(point))
        point = point[(at - np.maximum.accumulate(np.where(chain, at, 0))) % 2 == 0]
        first[point + 1] = False
        inside[point] = True
    begin = np.flatnonzero(first[inside])
    if not len(begin):
        return np.zeros(0, np.uint64), np.zeros(len(n), np.int64)
    char = char[inside].astype(np.uint64)
    place = np.arange(len(char)) - np.repeat(begin, np.diff(begin, append=len(char)))
    power = np.cumprod(np.r_[np.uint64(1), np.full(int(place.max()), 0x9E3779B97F4A7C15, np.uint64)])
    code = np.add.reduceat(char * power[place], begin)
    code ^= code >> np.uint64(31)
    code *= np.uint64(0xBF58476D1CE4E5B9)
    code ^= code >> np.uint64(29)
    return code, np.bincount(np.repeat(np.arange(len(n)), n)[first], minlength=len(n))


def _chunks(texts: pd.Series) -> Iterator[list[str]]:
    """The texts in lists of about CHUNK_CHARS characters."""
    part, chars = [], 0
    for t in texts:
        part.append(t)
        chars += len(t)
        if chars >= CHUNK_CHARS:
            yield part
            part, chars = [], 0
    if part:
        yield part


def _runs(w: np.ndarray, size: int) -> np.ndarray:
    """A code for each run of `size` codes, along the last axis."""
    n = w.shape[-1] - size + 1
    h = w[..., :n].copy()
    for j in range(1, size):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[..., j : n + j]
    h ^= h >> np.uint64(29)
    return h * np.uint64(0xBF58476D1CE4E5B9)


def _shingles(w: np.ndarray) -> np.ndarray:
    return np.unique(_runs(w, 5)) if len(w) >= 5 else np.zeros(0, np.uint64)


def _bands(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each text's bands over the whole text.

    A batch's words lie in one array, so shingles, their distinct values and all min-hashes are computed for it at once.
    """
    rng = np.random.default_rng(7)
    mult = rng.integers(1, 2**63, HASHES, dtype=np.uint64) | np.uint64(1)
    add = rng.integers(0, 2**63, HASHES, dtype=np.uint64)
    for b in batches:
        found = [_batch_codes(x) for x in _chunks(b["text"])]
        if not found:
            continue
        flat, n = (np.concatenate(x) for x in zip(*found))
        if len(flat) < LEAST_SHINGLES + 4:
            continue
        text = np.repeat(np.arange(len(n)), n)
        runs = _runs(flat, 5)
        inside = text[: len(runs)] == text[4:]
        of, run = text[: len(runs)][inside], runs[inside]
        order = np.lexsort((run, of))
        of, run = of[order], run[order]
        new = np.ones(len(of), bool)
        new[1:] = (of[1:] != of[:-1]) | (run[1:] != run[:-1])
        of, run = of[new], run[new]
        sizes = np.bincount(of, minlength=len(n))
        keep = np.flatnonzero(sizes >= LEAST_SHINGLES)
        if not len(keep):
            continue
        run = run[sizes[of] >= LEAST_SHINGLES]
        cuts = np.concatenate(([0], np.cumsum(sizes[keep])[:-1]))
        with np.errstate(over="ignore"):
            sig = np.stack([np.minimum.reduceat((run * m + a) >> np.uint64(3), cuts) for m, a in zip(mult, add)])
            band = [sig[k] * np.uint64(31) ^ (sig[k + 1] * np.uint64(1_000_003)) ^ (sig[k + 2] * np.uint64(0x9E3779B97F4A7C15)) for k in range(0, HASHES, ROWS)]
        base = b.iloc[keep]
        for k, x in enumerate(band):
            yield pd.DataFrame({"id": base["id"].to_numpy(), "chars": base["chars"].to_numpy(), "shingles": sizes[keep], "suspect": base["suspect"].to_numpy(), "band": (x ^ np.uint64(k)).view(np.int64), "sig": None if k else [x.tobytes() for x in sig.astype(np.uint8).T]})


def _alike(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs that have enough min-hashes in common to be similar, before their texts are fetched."""
    for b in batches:
        if len(b):
            x, y = (np.frombuffer(b"".join(b[c]), np.uint8).reshape(-1, HASHES) for c in ("sig", "long_sig"))
            yield b.loc[(x == y).sum(1) >= LEAST_EQUAL, ["id", "long_id"]]


@lru_cache(4_000)
def _held_shingles(t: str) -> np.ndarray:
    return _shingles(_codes(t))


def _edits(tail: list[str], part: list[str]) -> int:
    """Edits between the tail and an end of part, which may begin anywhere."""
    if part[-len(tail) :] == tail:
        return 0
    cost = [0] * (len(part) + 1)
    for i, p in enumerate(tail):
        now = [i + 1]
        for j, q in enumerate(part):
            now.append(min(cost[j] + (p != q), cost[j + 1] + 1, now[j] + 1))
        cost = now
    return cost[-1]


def _place(a: list[str], c: list[str]) -> int | None:
    """Where the last word of a, which may be cut, stands in c: the end of the best alignment of a's last words, with edits."""
    k, m = len(a) - 1, min(TAIL, len(a))
    if len(c) > k and c[k].startswith(a[k]) and a[:k] == c[:k]:
        return k
    tail, slack = a[-m:], 2 + int(len(a) * (1 / SIMILAR - 1))  # what a similar text can have more, or less, before the place
    lo = max(0, len(a) - m - slack)
    window = c[lo : len(a) + slack]
    found = []
    for j in range(2, len(window)):
        if not window[j].startswith(tail[-1]) or (window[j - 1] != tail[-2] and window[j - 2] != tail[-3]):
            continue
        part = window[max(0, j - m - TAIL_EDITS + 1) : j]
        if sum(p not in part for p in tail[:-1]) <= TAIL_EDITS:  # each word that isn't there is an edit
            found.append((_edits(tail[:-1], part), abs(lo + j - k), j))
    if not found:
        return None
    edits, _, j = min(found)
    # figures that begin alike are different figures unless all before them agrees
    return lo + j if edits <= TAIL_EDITS and (window[j] == tail[-1] or tail[-1].isalpha()) else None


def _middle(s: str, t: str) -> bool | None:
    """Whether t goes on inside a sentence or line where s ends; None if the end of s has no place in t before its last word."""
    s, t = s.lower(), t.lower()
    x = _held_tokens(s)
    if x[-1] not in t or (x[-2] not in t and x[-3] not in t):
        return None
    y = _held_tokens(t)
    k = _place(x, y)
    if k is None or k == len(y) - 1:
        return None
    left = s[s.rindex(x[-1]) + len(x[-1]) :]
    if x[-1] != y[k]:
        return not left.strip()
    end = next(m.end() for i, m in enumerate(_TOKEN.finditer(t)) if i == k)
    return not _STOP.search(left) and bool(_ON.match(t[end:]))


def _goes_on(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Suspects whose end has its place inside a longer near-copy; middle: the copy goes on in the same sentence or line."""
    for b in batches:
        got = []
        for i, s, t in zip(b["id"], b["short"], b["long"]):
            middle = _middle(s, t)
            if middle is not None:
                x, y = _held_shingles(s), _held_shingles(t)
                both = len(np.intersect1d(x, y))
                if both and both >= SIMILAR * (len(x) + len(y) - both):
                    got.append((i, middle))
        if got:
            yield pd.DataFrame(got, columns=["id", "middle"])


def near_copies(distinct: DataFrame) -> DataFrame:
    """(id, middle): suspect texts with a longer near-copy, however it begins; middle: it goes on inside a sentence.

    A suspect meets every longer text of its bands' buckets that has as many shingles as the similarity asks for.
    """
    bands = written(distinct.select("id", "chars", "suspect", "text").mapInPandas(_bands, "id long, chars int, shingles int, suspect boolean, band long, sig binary"), "p3-bands")
    longer = bands.select("band", F.col("id").alias("long_id"), F.col("chars").alias("long_chars"), F.col("shingles").alias("long_shingles"))
    near = (F.col("long_chars") > F.col("chars")) & (F.col("long_shingles") * SIMILAR <= F.col("shingles")) & (F.col("shingles") * SIMILAR <= F.col("long_shingles"))
    pairs = bands.where("suspect").join(longer, "band").where(near).select("id", "long_id").distinct()
    sig = bands.where("sig is not null").select("id", "sig")
    pairs = pairs.join(sig, "id").join(sig.select(F.col("id").alias("long_id"), F.col("sig").alias("long_sig")), "long_id")
    pairs = written(pairs.mapInPandas(_alike, "id long, long_id long"), "p3-pairs")
    ids = pairs.select("id").unionByName(pairs.select(F.col("long_id").alias("id"))).distinct()
    t = distinct.select("id", "text").join(maybe_broadcast(ids, MOST_IDS), "id", "left_semi")
    held = pairs.join(t.withColumnRenamed("text", "short"), "id").join(t.select(F.col("id").alias("long_id"), F.col("text").alias("long")), "long_id")
    return held.select("id", "short", "long").mapInPandas(_goes_on, "id long, middle boolean").groupBy("id").agg(F.max("middle").alias("middle"))


def judged(rows: DataFrame, all_copies: bool = False) -> DataFrame:
    """rows with `cut` and the reason; rows: table_name, row_id, pos, source, text.

    A text that is cut in every row by its limit and its end or mark is compared with near-copies if all_copies only: no
    copy changes its verdict, and such texts have by far the most of them.
    """
    r = rows.withColumn("id", F.xxhash64("text")).withColumn("chars", F.length("text")).withColumn("bytes", F.octet_length("text"))
    r = written(r, "p3-texts")
    lim = limits(r.groupBy("table_name", "source", "chars", "bytes").agg(F.count(F.lit(1)).alias("n")))
    lim = F.broadcast(lim.select(F.col("table_name").alias("_t"), F.col("source").alias("_s"), "chars_limit", "bytes_limit"))  # one row a source
    at = r.join(lim, (F.col("table_name") == F.col("_t")) & F.col("source").eqNullSafe(F.col("_s")), "left")
    at = at.select("table_name", "row_id", "pos", "source", "id", "chars", F.coalesce((F.col("chars") == F.col("chars_limit")) | (F.col("bytes") >= F.col("bytes_limit") - 5), F.lit(False)).alias("at_limit"), "text")
    end = F.right(F.rtrim(F.right("text", F.lit(256)), F.lit(_SPACE)), F.lit(48))
    d = at.groupBy("id").agg(F.first("text").alias("text"), F.first("chars").alias("chars"), F.max("at_limit").alias("at_limit"), F.min("at_limit").alias("always"), F.count(F.lit(1)).alias("times"))
    d = ending(d.withColumn("_end", end).withColumn("marked", F.right("_end", F.lit(1)).isin(*_MARK_ENDS) & F.col("_end").rlike(_MARK)).drop("_end"))
    decided = F.col("always") & ((F.col("state") == "open") | F.col("marked")) & F.lit(not all_copies)
    d = written(d.withColumn("suspect", ((F.col("state") == "open") | F.col("at_limit")) & (F.col("state") != "cut") & ~decided), "p3-distinct")
    closes = closings(d.select("text", "fields"))
    opened = d.where("state = 'open'").select("id", "key", "at_limit", F.left("text", F.lit(6)).alias("head"))
    opens = opened.where(~F.col("at_limit")).groupBy("key").agg(F.count(F.lit(1)).alias("opens"))
    opened = opened.join(closes.join(opens, "key", "left"), "key", "left").join(recurring(d), ["head", "key"], "left")
    opened = opened.select("id", F.coalesce("closes", F.lit(0)).alias("closes"), F.coalesce("opens", F.lit(0)).alias("opens"), F.coalesce("recurs", F.lit(False)).alias("recurs"))
    near = near_copies(d)
    v = d.select("id", "chars", "marked", "state", "times").join(opened, "id", "left").join(near, "id", "left")
    return at.select("table_name", "row_id", "pos", "source", "id", "at_limit").join(v, "id").withColumn("middle", F.coalesce("middle", F.lit(False)))


def verdict() -> Column:
    """cut, from at_limit, marked, state, closes, opens, recurs and middle."""
    enough = (F.coalesce("closes", F.lit(0)) >= CLOSES) & (F.coalesce("closes", F.lit(0)) >= CLOSE_RATIO * F.coalesce("opens", F.lit(0)))
    closed = enough | F.coalesce("recurs", F.lit(False))
    open_end = (F.col("state") == "open") & (F.col("at_limit") | ~closed)
    return (F.col("state") == "cut") | open_end | F.col("middle") | (F.col("marked") & F.col("at_limit"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message and preview that was cut."""
    j = judged(texts(table(spark, sf_dir, "chat_log"), table(spark, sf_dir, "trajectory")))
    return j.where(verdict()).select("table_name", "row_id", "pos").distinct()


def p3_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts, cut texts and their share of each source."""
    j = judged(texts(table(spark, sf_dir, "chat_log"), table(spark, sf_dir, "trajectory")))
    one = j.groupBy("table_name", "source").agg(F.count(F.lit(1)).alias("texts"), F.sum(verdict().cast("bigint")).alias("cut"))
    return one.withColumn("share", F.round(F.col("cut") / F.col("texts"), 6))


def p3_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cut texts by what shows the cut: the form of the end, words that don't close, the limit with a mark, a longer near-copy."""
    j = judged(texts(table(spark, sf_dir, "chat_log"), table(spark, sf_dir, "trajectory")), all_copies=True).where(verdict())
    others = (F.col("state") == "cut") | (F.col("state") == "open") & F.col("at_limit") | F.col("marked") & F.col("at_limit")
    by_words = (F.col("state") == "open") & ~others & ~F.col("middle")
    kind = F.when(F.col("middle") & ~others, "near_copy").when(F.col("state") == "cut", "form").when(by_words, "words").otherwise("limit")
    return j.groupBy("table_name", kind.alias("evidence"), F.col("middle").alias("near_copy_too")).agg(F.count(F.lit(1)).alias("texts"))
