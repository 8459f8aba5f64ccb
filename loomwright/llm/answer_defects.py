"""Problem 2: defective answers, by tagging an answer's clauses with a conditional random field.

Each clause is tagged answer, refusal, echo, foreign or unfinished; the tags' coverage of the answer gives its defect.

There are no labels, so the field is fitted to clauses whose tag is known by how they were made, from SAMPLE answers and
their questions: whole answers (answer), the same cut at a random place (unfinished in the end), under a question in
another language (foreign), a question in an answer's place or before it (echo), and answers that hold no figure which
isn't the question's own (refusal). What makes the tag is no feature: the field sees words, language, overlap with the
question, and how a clause opens and ends. It is fitted on the driver and sent with the tasks.

Defined results: an answer that is null in both columns, blank or of layout only is `empty`; trajectories without their
record or question are judged without a question's language; repeated rows are each judged and reported once.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .crf import CRF, hashed

#: Answers whose clauses fit the field, the smallest by a hash of their id, and half as many more without a figure.
SAMPLE = 3_000
#: Shares of the sample that are also cut, and that also quote their question.
CUT, ECHO = 0.7, 0.3
#: Longer sequences are fitted in parts of so many clauses (all are decoded whole).
WINDOW = 24
TAGS = ["answer", "refusal", "echo", "foreign", "unfinished"]
DIMS = 1 << 13

# fixed values: function words by language
_STOP = {
    "en": "the of to and is are was were in it for that with from by as be this after not no a an i my cannot only which without read query result answer value final sorted high low".split(),
    "de": "der die das und ist sind nicht mit für von zu ein eine einen den dem des im auf ergibt lautet wurde wurden nach ohne als ergebnis laut".split(),
    "es": "el la los las de que y en un una para por con según fuera quedaron valor es son del se al consulta devuelve tabla".split(),
    "fr": "le la les des et est sont une un pour par avec selon dans du au aux qui valeur résultat requête renvoie tableau".split(),
    "pt": "o a os as de que e em um uma para por com segundo valor da do não são consulta retorna tabela".split(),
    "it": "il la lo gli le di che e in un una per con secondo valore della del non sono risultato tabella".split(),
}
_STOPS = {k: frozenset(v) for k, v in _STOP.items()}
_ASKED = {
    "en": re.compile(r"英文|英语|in english|auf englisch", re.I), "zh": re.compile(r"中文|汉语|in chinese|auf chinesisch", re.I), "de": re.compile(r"德文|德语|in german|auf deutsch", re.I),
    "es": re.compile(r"西班牙|in spanish", re.I), "ja": re.compile(r"日文|日语|in japanese", re.I), "fr": re.compile(r"法文|法语|in french", re.I),
}
_SENT = re.compile(r"(?<=[。！？!?])(?=\S)|(?<=[.])\s+(?=[^\W\d_])")
_DATA = re.compile(r"^\s*(?:[|\[{}\]`]|\d{1,3}[.)、]\s|[-*•]\s)")
_ITEMS = re.compile(r"^(?:[^\s:：,，、;；。]{1,24}(?:[ ][^\s:：,，、;；。]{1,24}){0,3}?\s*[:： ]\s*-?\d[\d.,]*%?\s*[、,，;；.。]*\s*)+$")
_LEAD = re.compile(r"^\W*(?:题目|问题|您的问题是?|你的问题是?|question|task|任务|your question(?: is| was)?|you asked)\W", re.I)
_REPLY = re.compile(r"^\W*(?:回答|答|answer|reply|antwort)\W", re.I)
_NOTICE = re.compile(r"^.*?\n[ \t]*(?:任务|Task)[ \t]*[:：][ \t]*", re.S)
_BREAK = re.compile(r"[,，、:：](?=[^\d\n])")
_FIGURE = re.compile(r"\d+(?:[.,]\d+)*")


def answer_text(final: Column, output: Column) -> Column:
    """final_answer or, where that is null or blank, what follows the last tool or think block of the output."""
    rest = F.element_at(F.split(output, r"</(?:think|tool_call|tool_response)>"), -1)
    return F.when(F.trim(F.regexp_replace(final, r"[\s　]+", "")) != "", final).otherwise(F.coalesce(rest, F.lit("")))


@lru_cache(200_000)
def language(s: str) -> str:
    """zh, ja, a language of Latin letters, or '' for names and figures."""
    if re.search(r"[぀-ヿ]", s):
        return "ja"
    if re.search(r"[가-힣]", s):
        return "ko"
    if re.search(r"[Ѐ-ӿ]{3}", s):
        return "ru"
    words = re.findall(r"[a-zà-ÿ']+", re.sub(r"\b\w*_\w*\b", "", s.lower()))
    hits = {k: sum(w in v for w in words) for k, v in _STOPS.items()}
    best = max(hits, key=lambda k: hits[k])
    if hits[best] >= 2 or (hits[best] == 1 and len(words) <= 3 and best == "en" and not re.search(r"[一-鿿]", s)):
        return best
    if len(re.findall(r"[一-鿿]", s)) >= 2:
        return "zh"
    return ""


def clauses(a: str) -> list[str]:
    """Sentences and lines; neighbouring lines of a table, list or code block are one clause."""
    out: list[str] = []
    data = fence = False
    a = re.sub(r"(?<=[^\s`])[ \t]*(?=```)", "\n", a)
    a = re.sub(r"(?<=[。！？.!?:：])[ \t]*(?=\[\{|\| \S)", "\n", a)
    for line in a.split("\n"):
        if not line.strip():
            data = data and fence
            continue
        is_data = fence or bool(_DATA.match(line)) or (data and line[:1] in " \t}]")
        if line.strip().startswith("```"):
            fence = not fence
        if is_data:
            if data:
                out[-1] += "\n" + line
            else:
                out.append(line)
            data = True
        else:
            out += [x for x in _SENT.split(line) if x.strip()]
            data = False
    return out


def _solid(s: str) -> str:
    return re.sub(r"[\W_]+", "", unicodedata.normalize("NFKC", s).lower())


def _bag(q: str) -> set[str]:
    s = _solid(q)
    return {s[i : i + 4] for i in range(len(s) - 3)} | ({s} if s else set())


def _open(c: str) -> bool:
    """A table row, bracket, quote, fence or emphasis that isn't closed."""
    if c.count("```") % 2 or c.count("**") % 2:
        return True
    body = c.replace("```json", "").replace("```sql", "").replace("```", "").strip()
    if body[:1] in "[{" or "\n[" in c or "\n{" in c:
        return body.count("[") != body.count("]") or body.count("{") != body.count("}") or body.count('"') % 2 == 1
    last = body.rsplit("\n", 1)[-1].strip()
    if last.startswith("|"):
        return not last.endswith("|") or len(last) < 2
    return False


def _is_data(c: str) -> bool:
    return bool(_DATA.match(c)) or bool(_ITEMS.match(c.strip())) or '[{"' in c


def figures(text: str) -> set[str]:
    """The numbers of a text, parts of codes joined: a figure that stands in the question is no result."""
    t = unicodedata.normalize("NFKC", text)
    return set(_FIGURE.findall(re.sub(r"(?<=\d)[\s\u2010-\u2015_.·-](?=\d{3}(?!\d))", "", t))) | set(_FIGURE.findall(t))


def _ending(c: str) -> str:
    """How a clause ends: the kind of its last sign, markup aside."""
    t = c.rstrip()
    core = t.rstrip("*_\"'”’」』)）`")
    if not core:
        return "layout"
    x = core[-1]
    kind = "stop" if x in "。！？.!?…;；" else "colon" if x in ":：" else "comma" if x in ",，、" else "row" if x in "|]}" else "digit" if x.isdigit() or x == "%" else "han" if "一" <= x <= "鿿" else "letter" if x.isalpha() else "sign"
    return kind + ("+" if len(core) < len(t) else "")


def features(cl: list[str], bag: set[str], langs: frozenset[str]) -> list[list[str]]:
    """Feature names of each clause, over its whole text."""
    out = []
    n = len(cl)
    led = False
    for i, c in enumerate(cl):
        s = _solid(c)
        data = _is_data(c)
        if _LEAD.match(c):
            led = True
        if _REPLY.match(c):
            led = False
        grams = [s[j : j + 4] for j in range(len(s) - 3)] or [s]
        over = int(sum(g in bag for g in grams) / len(grams) * 5)
        lang = "" if data else language(c)
        agree = "none" if not lang or not langs else "same" if lang in langs else "other"
        last, opened, end = i == n - 1, _open(c), _ending(c)
        rows = [x for x in c.split("\n") if x.strip()] if data else []
        alike = "none" if len(rows) < 3 else "same" if _ending(rows[-1]) == _ending(rows[-2]) else "other"
        f = [f"rows={alike},last={last}", f"data={data}", f"over={over}", f"over={over},led={led}", f"over={over},data={data}", f"agree={agree}", f"agree={agree},data={data}", f"last={last},end={end},data={data}", f"last={last},open={opened}", f"led={led}", f"n={min(n, 4)}", f"pos={min(i, 3)}", f"short={len(s) < 4}"]
        if not data:
            low = c.lower()
            f += [f"w:{w}" for w in set(re.findall(r"[a-zà-ÿ']{2,}", low))]
            f += [f"z:{low[j : j + 2]}" for j in range(len(low) - 1) if "一" <= low[j] <= "鿿" and "一" <= low[j + 1] <= "鿿"]
        out.append(f)
    return out


def expected_languages(q: str) -> frozenset[str]:
    """The question's language and any it asks for; empty without a question."""
    if not q:
        return frozenset()
    own = "zh" if len(re.findall(r"[一-鿿]", q)) >= 4 else language(q)
    if own not in ("zh", "ja", "ko", "ru") and sum(w in _STOPS.get(own, ()) for w in re.findall(r"[a-zà-ÿ]+", q.lower())) < 4:
        own = "en"  # too few function words to tell Latin languages apart
    return frozenset({own, *(k for k, r in _ASKED.items() if r.search(q))})


def _prepare(a: str, q: str) -> tuple[list[str], list[list[str]], str]:
    q = _NOTICE.sub("", q or "")
    cl = clauses(a or "")
    return cl, features(cl, _bag(q), expected_languages(q)) if cl else [], q


def _silent(a: str) -> bool:
    """No letter or digit but a label's."""
    s = _solid(re.sub(r"```\w*|</?\w+>", "", a or ""))
    return not s or bool(re.fullmatch(r"(?:最终答案|答案|结果|回答|答|finalanswer|answer|result|null|none|na|nil)?", s))


def defect(a: str, cl: list[str], tags: list[int], q: str) -> str | None:
    """The defect that the tags' coverage of the answer amounts to."""
    if _silent(a) or not cl:
        return "empty"
    cover = dict.fromkeys(TAGS, 0)
    for c, t in zip(cl, tags):
        cover[TAGS[t]] += len(_solid(c))
    if tags[-1] == 4:
        return "truncated"
    own = figures(q)
    told = [c for c, t in zip(cl, tags) if t == 0]
    if cover["refusal"] and not cover["foreign"] and not any(figures(c) - own for c in told):
        return "refusal"
    if cover["echo"] and not cover["answer"] and not cover["foreign"]:
        return "copied"
    if cover["foreign"] > sum(len(_solid(c)) for c in told if not _is_data(c) and language(c)):
        return "other_language"
    return None


def made(sample: pd.DataFrame, seed: int = 11) -> tuple[list[list[list[str]]], list[list[int]]]:
    """(features, tags) of sequences whose tags are known by how they were made; sample: a, q."""
    rng = np.random.default_rng(seed)
    rows = []
    for a, q in zip(sample["a"], sample["q"]):
        cl, f, plain_q = _prepare(a, q)
        if cl and not _silent(a):
            rows.append((a, plain_q, cl, f, expected_languages(plain_q)))
    seqs, tags = [], []

    def add(f: list, t: list[int]) -> None:
        if f:
            seqs.append(f), tags.append(t)

    for i, (a, q, cl, f, langs) in enumerate(rows):
        bag = _bag(q)
        over = [sum(s[j : j + 4] in bag for j in range(len(s) - 3)) / max(len(s) - 3, 1) for s in map(_solid, cl)]
        quotes = max(over) > 0.3 and bool(q)
        if q and not figures(a) - figures(q) and not quotes:
            for _ in range(5):  # rare, so it counts more than once
                add(f, [1] * len(cl))  # it tells nothing that the question doesn't
            continue
        if quotes or any(langs and not _is_data(c) and language(c) not in langs | {""} for c in cl):
            continue  # what is quoted, or in which language it should be, isn't known here
        add(f, [0] * len(cl))
        whole = a.rstrip()
        breaks = [m.end() for m in _BREAK.finditer(whole) if m.end() > len(whole) // 3]
        for near in (True, False, None):
            if rng.random() > CUT or len(whole) < 9 or near is None and not breaks:
                continue
            at = breaks[int(rng.integers(len(breaks)))] if near is None else len(whole) - int(rng.integers(2, min(len(whole) // 2, 30) + 1)) if near else int(rng.integers(len(whole) // 2, len(whole) - 1))
            part = clauses(whole[:at])
            # inside a figure nobody can tell, and a cut between clauses leaves whole ones
            if part and not whole[at - 1].isdigit() and len(part[-1].strip()) < len(cl[min(len(part), len(cl)) - 1].strip()):
                add(features(part, bag, langs), [0] * (len(part) - 1) + [4])
        other = rows[int(rng.integers(len(rows)))]
        for _ in range(8):
            if not langs & other[4]:
                break
            other = rows[int(rng.integers(len(rows)))]
        if langs and other[4] and not langs & other[4]:
            lang = [bool(language(c)) and not _is_data(c) for c in cl]
            if any(lang):
                add(features(cl, _bag(other[1]), other[4]), [3 if x else 0 for x in lang])
        if rng.random() < ECHO and q:
            lead = ["", "", "问题：", "Question: ", "> ", "您的问题是："][int(rng.integers(6))]
            said = clauses(lead + q)
            add(features(said, bag, langs), [2] * len(said))
            reply = clauses(["", "回答：", "Answer: "][int(rng.integers(3))] + a)
            add(features(said + reply, bag, langs), [2] * len(said) + [0] * len(reply))
    return seqs, tags


def fit(sample: pd.DataFrame) -> CRF:
    crf = CRF(TAGS, DIMS)
    seqs, tags = made(sample)
    parts = [(f[k : k + WINDOW], t[k : k + WINDOW]) for f, t in zip(seqs, tags) for k in range(0, len(f), WINDOW)]
    return crf.fit([[hashed(x, DIMS) for x in f] for f, _ in parts], [t for _, t in parts], rounds=80) if parts else crf


def answers(trajectories: DataFrame, records: DataFrame) -> DataFrame:
    """(trajectory_id, a, q) of every trajectory; the question is its record's last user message."""
    q = records.select(F.col("record_id"), F.try_element_at(F.filter("prompt", lambda m: (m["role"] == "user") & m["content"].isNotNull()), F.lit(-1))["content"].alias("q"))
    q = q.where("record_id is not null").dropDuplicates(["record_id"])
    t = trajectories.select("trajectory_id", "record_id", answer_text(F.col("final_answer"), F.col("trajectory_output")).alias("a"))
    return t.join(q, "record_id", "left").select("trajectory_id", "a", F.coalesce("q", F.lit("")).alias("q"))


def judge(trajectories: DataFrame, records: DataFrame, sample_rows: int = SAMPLE) -> DataFrame:
    """(trajectory_id, defect, answer, refusal, echo, foreign, unfinished): the defective trajectories and their clause coverage."""
    order = [F.xxhash64("trajectory_id", F.lit(2)), "trajectory_id"]
    silent = answer_text(F.col("final_answer"), F.col("trajectory_output"))
    held = trajectories.orderBy(*order).limit(sample_rows)
    # answers without a figure are rare, and refusals are among them
    held = held.unionByName(trajectories.where(~silent.rlike("[0-9０-９]") & silent.rlike(r"\pL{3}")).orderBy(*order).limit(sample_rows // 2)).dropDuplicates(["trajectory_id"])
    keys = held.select("record_id").distinct()
    crf = fit(answers(held, records.join(F.broadcast(keys), "record_id", "left_semi")).orderBy("trajectory_id").toPandas())
    w = crf.w.astype(np.float32)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = CRF(TAGS, DIMS)
        model.w, model.t, model.b = w.astype(np.float64), crf.t, crf.b
        for b in batches:
            prepared = [_prepare(a, q) for a, q in zip(b["a"], b["q"])]
            there = [i for i, p in enumerate(prepared) if p[1]]
            paths = dict(zip(there, model.decode([[hashed(x, DIMS) for x in prepared[i][1]] for i in there]))) if there else {}
            rows = []
            for i, (tid, a) in enumerate(zip(b["trajectory_id"], b["a"])):
                cl, tags = prepared[i][0], paths.get(i, [])
                d = defect(a, cl, tags, prepared[i][2])
                if d:
                    cover = [sum(len(c) for c, t in zip(cl, tags) if t == k) for k in range(len(TAGS))]
                    rows.append((tid, d, *cover))
            if rows:
                yield pd.DataFrame(rows, columns=["trajectory_id", "defect", *TAGS])

    schema = "trajectory_id long, defect string, " + ", ".join(f"{t} int" for t in TAGS)
    return answers(trajectories, records).mapInPandas(run, schema)  # where the join leaves them, which splits skewed records


def p2_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defective trajectories with the characters of their answer under each tag."""
    return judge(table(spark, sf_dir, "trajectory"), table(spark, sf_dir, "training_record"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each defective trajectory and its defect."""
    return p2_clauses(spark, sf_dir).select("trajectory_id", "defect").distinct()
