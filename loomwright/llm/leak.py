"""Problem 6: passages of held-out items inside a corpus, by an FM-index of each corpus shard.

Each task takes its documents in shards of bounded size and indexes a shard's words (Latin words, digits, single
ideographs; words that no item has can't be part of a match and only part the text). Every phrase of every item is searched
backward through wavelet-tree ranks, its occurrences are located by sampled suffix positions, occurrences on one diagonal
are merged into maximal runs, and runs into passages where only edits of single words lie between them. All passages of a
document are kept, with their place in its own text. The corpus is never shuffled but for spreading few files; the items
are sent to the executors once, as a broadcast whose size is checked first, and beyond it are searched in parts.

A passage must be a quotation of its item, not the language that such items share: its words in common have to be
surprising under a model of the other items' words. Numbers are only a test of mismatch; a passage need hold none.

Defined results: null, blank or layout-only documents and items give nothing; repeated documents are each reported; an
item's standard opening (shared by several items) isn't searched; a passage that several items share is reported for each;
documents of any length are searched whole, those longer than a shard in overlapping pieces.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import table
from .fm_index import FMIndex
from .plain import plain, tokens

#: Characters of text in one shard's index; its arrays take about 60 bytes a word while it is built.
SHARD_CHARS = 4_000_000
#: Characters of items that are searched at once; more items are searched in parts, each over the whole corpus.
ITEM_CHARS = 20_000_000
#: Length of the searched phrases in words (single ideographs and digits), for ideographic and for alphabetic items.
PHRASE = {True: 6, False: 4}
#: Least length of a reported passage: 24 ideographs or 12 words, less one edited word (four ideographs) at an edge.
LEAST = {True: 20, False: 11}
#: A word in more than this share of the items, and in more than three, is their common language.
COMMON = 0.03
#: A passage's words in common must be so unlikely in the language of all other items: at most 1 / items to this power.
CHANCE = 3.0
#: Items that the share of all items with a word counts for, beside those that have the words before it.
BACK_OFF = 5.0
#: Words between two matched runs that may be edited, and further ones that may be inserted (a page break, say).
GAP, INSERTED = {True: 6, False: 4}, 10


def _ideographic(text: str) -> bool:
    han = sum("一" <= c <= "鿿" for c in text)
    return han * 4 > len(text)


def without_preamble(items: pd.DataFrame, least: int = 5) -> pd.DataFrame:
    """Items (item_id, text) without their first sentence where `least` items or more open with it."""
    items = items[items.text.notna()].drop_duplicates()
    cut = items.text.map(lambda t: re.match(r"(?s)\s*.*?[.。!！?？]+\s*", t))
    first = cut.map(lambda m: m[0].strip() if m else "")
    often = {k for k, n in Counter(first).items() if k and n >= least}
    text = [t[m.end() :] if m and f in often else t for t, m, f in zip(items.text, cut, first)]
    return pd.DataFrame({"item_id": items.item_id.to_numpy(), "text": text})


class Phrases:
    """Item words as numbers, and the distinct phrases with the (item, offset) places of each."""

    def __init__(self, items: pd.DataFrame):
        self.ids, self.tokens, self.han = [], [], []
        for item, text in zip(items.item_id, items.text):
            t = tokens(text)
            if t:
                self.ids.append(int(item)), self.tokens.append(t), self.han.append(_ideographic("".join(t)))
        self.code = {w: i for i, w in enumerate(sorted({w for t in self.tokens for w in t}))}
        self.by_width = []  # (patterns, start of each pattern's places, item, offset)
        for han, width in PHRASE.items():
            rows, item, offset = [], [], []
            for k, t in enumerate(self.tokens):
                c = np.array([self.code[w] for w in t], np.int64)
                if self.han[k] == han and len(c) >= width:
                    rows.append(np.lib.stride_tricks.sliding_window_view(c, width))
                    item.append(np.full(len(rows[-1]), k)), offset.append(np.arange(len(rows[-1])))
            if rows:
                one, back = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
                order = np.argsort(back.ravel(), kind="stable")
                start = np.concatenate(([0], np.cumsum(np.bincount(back.ravel()))))
                self.by_width.append((one, start, np.concatenate(item)[order], np.concatenate(offset)[order]))
        parts = Counter(x for t in self.tokens for x in {*t, *map("".join, zip(t, t[1:]))} if not x.isdigit())
        self.common = {x for x, n in parts.items() if n > max(3, COMMON * len(self.tokens))}
        #: (weight, first, end word) of what each item's words tell, and the weight that a passage must have
        one = {"\0".join(t): (t, h) for t, h in zip(self.tokens, self.han)}  # items of one text count once
        weights = dict(zip(one, _weights([t for t, _ in one.values()], [h for _, h in one.values()])))
        self.weights = [weights["\0".join(t)] for t in self.tokens]
        self.least_weight = CHANCE * float(np.log(max(len(one), 1)))
        size = np.array([len(t) + 1 for t in self.tokens], np.int64)
        self.begin, self.sums = np.cumsum(size) - size, np.zeros(int(size.sum()))
        for b, n, of in zip(self.begin.tolist(), size.tolist(), self.weights):
            for w, _, z in of:
                self.sums[b + z] += w
            self.sums[b : b + n] = np.cumsum(self.sums[b : b + n])


def _units(words: list[str]) -> list[tuple[str, int, int]]:
    """(unit, first, end): whole numbers and single words."""
    out, a = [], 0
    while a < len(words):
        z = a + 1
        while words[a].isdigit() and z < len(words) and words[z].isdigit():
            z += 1
        out.append(("".join(words[a:z]), a, z))
        a = z
    return out


def _weights(texts: list[list[str]], han: list[bool]) -> list[list[tuple[float, int, int]]]:
    """How surprising each unit of an item is after the one before it (two before it among ideographs) in all other items.

    A word that other items go on with alike weighs nothing, one that none of them has there as much as one item in all.
    """
    n = len(texts)
    units = [_units(t) for t in texts]
    seen: Counter = Counter()
    keys = []
    for of, h in zip(units, han):
        back = 2 if h else 1
        k = [(tuple(x for x, _, _ in of[max(0, i - back) : i]), u) for i, (u, _, _) in enumerate(of)]
        keys.append(k)
        seen.update({*k, *(c for c, _ in k), *(u for _, u in k)})  # items, not occurrences
    out = []
    for of, k in zip(units, keys):
        row = []
        for (u, a, z), (c, _) in zip(of, k):
            both, before, alone = seen[c, u] - 1, seen[c] - 1, seen[u] - 1
            p = (both + BACK_OFF * alone / n) / (before + BACK_OFF)
            row.append((float(-np.log(min(1.0, max(p, 1 / n)))), a, z))
        out.append(row)
    return out


def _edited(lost: list[str], new: list[str], before: str, after: str, han: bool, common: set[str]) -> bool:
    """Whether a document's words `new` in the place of an item's words `lost` are an edit that keeps the passage.

    No digit of the item may be lost, nor may digits come beside one; a word that is the item's own (in few items) may only
    be misspelt, one of the common language may be any other word.
    """
    if len(lost) > GAP[han] or len(new) > GAP[han] + INSERTED or any(x.isdigit() for x in lost):
        return False
    if new and all(x.isdigit() for x in new) and (before.isdigit() or after.isdigit()):
        return False
    if not lost or not new:
        return True
    if han:
        if len(lost) == 1:
            return True
        return len(new) < len(lost) or all(x + y in common for x, y in zip(lost, lost[1:])) or SequenceMatcher(None, lost, new, autojunk=False).ratio() >= 0.5
    return all(x in common or max(SequenceMatcher(None, x, y).ratio() for y in [*new, "".join(new)]) >= 0.55 for x in lost)


def _length(part: list[str], before: str, after: str, han: bool) -> int:
    """Words or ideographs of a passage; a number counts once among words, and not at all if cut by the passage's edge."""
    a, z = 0, len(part)
    if before.isdigit():
        while a < z and part[a].isdigit():
            a += 1
    if after.isdigit():
        while z > a and part[z - 1].isdigit():
            z -= 1
    return z - a if han else sum(1 for j in range(a, z) if not part[j].isdigit() or j == a or not part[j - 1].isdigit())


def chained(runs: list[tuple[int, int, int]], item: list[str], doc: list[str], han: bool, common: set[str], weights: list[tuple[float, int, int]], least_weight: float) -> list[tuple[int, int, int]]:
    """(length, first, end) of the passages in words of doc, from maximal runs (doc offset, item offset, length)."""
    chains: list[list] = []  # [doc start, item start, doc end, item end, *matched parts of the item]
    for o, j, n in sorted(runs):
        best = None
        for c in chains:
            skip = max(0, c[2] - o, c[3] - j)  # runs of two diagonals may overlap
            gap, lost = o + skip - c[2], j + skip - c[3]
            if skip >= n or min(gap, lost) < 0:
                continue
            if gap <= GAP[han] + INSERTED and lost <= GAP[han] and _edited(item[c[3] : j + skip], doc[c[2] : o + skip], item[c[3] - 1], item[j + skip], han, common):
                best = min(best or (gap + lost, c), (gap + lost, c), key=lambda x: x[0])
        if best:
            best[1][2:4] = [o + n, j + n]
            best[1].append((j, j + n))
        else:
            chains.append([o, j, o + n, j + n, (j, j + n)])
    out = []
    for o, j, p, q, *parts in chains:
        n = _length(item[j:q], item[j - 1] if j else "", item[q] if q < len(item) else "", han)
        n += _edges(item, doc, j, q, o, p, han)
        if n >= LEAST[han] and sum(w for w, a, z in weights if any(a >= x and z <= y for x, y in parts)) >= least_weight:
            out.append((n, o, p))
    return out


def _edges(item: list[str], doc: list[str], j: int, q: int, o: int, p: int, han: bool) -> int:
    """Further words at both ends of a passage, too few for a phrase, behind a single edited word."""
    n = 0
    for step, at, to in ((-1, j - 1, o - 1), (1, q, p)):
        if 0 <= at < len(item) and item[at].isdigit():
            continue
        for shift in (1, 0, 2):  # the word was replaced, added or parted
            a, b, k = at + step, to + step * shift, 0
            while 0 <= a < len(item) and 0 <= b < len(doc) and item[a] == doc[b] and not item[a].isdigit():
                a, b, k = a + step, b + step, k + 1
            if k >= (2 if han else 1):
                n += k + 1
                break
    return n


def search_shard(texts: list[list[str]], ph: Phrases) -> list[tuple[int, int, int, int, int]]:
    """(doc, item, length, first, end word) of all passages in one shard of documents as words; doc and item are places."""
    get = ph.code.get
    sizes = np.array([len(t) for t in texts], np.int64)
    flat = np.array([get(w, -1) for t in texts for w in t], np.int64)
    base = np.cumsum(sizes) - sizes
    # parts of known words, none over a document's border
    known = flat >= 0
    edge = np.zeros(len(flat) + 1, bool)
    edge[base], edge[-1] = True, True
    begin = np.flatnonzero(known & (edge[:-1] | ~np.append(False, known[:-1])))
    end = np.flatnonzero(known & (edge[1:] | ~np.append(known[1:], False))) + 1
    keep = end - begin >= min(PHRASE.values())
    begin, end = begin[keep], end[keep]
    if not len(begin):
        return []
    index = FMIndex([flat[a:b] for a, b in zip(begin.tolist(), end.tolist())], 8)
    hits: list[tuple[np.ndarray, ...]] = []
    for phrases, start, item, offset in ph.by_width:
        lo, hi = index.search(index.encode(phrases.ravel()).reshape(phrases.shape))
        got = np.flatnonzero(hi > lo)
        count = hi[got] - lo[got]
        rows = np.repeat(lo[got], count) + _within(count)
        part, off = index.text_of(index.locate(rows))
        at = begin[part] + off
        places = (start[1:] - start[:-1])[got]
        each = np.repeat(places, count)
        at = np.repeat(at, each)
        which = np.repeat(np.repeat(start[got], count), each) + _within(each)
        hits.append((at, item[which], offset[which], np.full(len(at), phrases.shape[1])))
    at, item, off, width = (np.concatenate(x) for x in zip(*hits))
    if not len(at):
        return []
    doc = np.searchsorted(base, at, side="right") - 1
    # documents may be empty, so several may begin at one place; the last of them holds the word
    order = np.lexsort((at, at - off, item, doc))
    at, item, off, width, doc = at[order], item[order], off[order], width[order], doc[order]
    new = np.ones(len(at), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (at[1:] - off[1:] != at[:-1] - off[:-1]) | (at[1:] != at[:-1] + 1)
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(at)) - 1
    length = at[tail] - at[head] + width[head]
    d, k, o, j = doc[head], item[head], at[head] - base[doc[head]], off[head]
    pair = np.ones(len(head), bool)
    pair[1:] = (d[1:] != d[:-1]) | (k[1:] != k[:-1])
    first = np.flatnonzero(pair)
    place = ph.begin[k] + j
    held = np.add.reduceat(ph.sums[place + length] - ph.sums[place], first)  # no less than any passage's weight
    out = []
    for a, b, n in zip(first.tolist(), np.append(first[1:], len(head)).tolist(), held.tolist()):
        if n < ph.least_weight:
            continue
        kk, han = int(k[a]), ph.han[int(k[a])]
        runs = list(zip(o[a:b].tolist(), j[a:b].tolist(), length[a:b].tolist()))
        out += [(int(d[a]), kk, *c) for c in chained(runs, ph.tokens[kk], texts[d[a]], han, ph.common, ph.weights[kk], ph.least_weight)]
    return out


def _within(count: np.ndarray) -> np.ndarray:
    """0, 1, ... within each of consecutive groups of these sizes."""
    return np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)


def _place(text: str, nth: int) -> int:
    """The least number of leading characters of text that hold nth words."""
    lo, hi = 0, len(text)
    while lo < hi:
        m = (lo + hi) // 2
        if len(tokens(text[:m])) >= nth:
            hi = m
        else:
            lo = m + 1
    return lo


def _pieces(text: str, overlap: int) -> Iterator[tuple[int, str]]:
    """(offset, piece): the text, or overlapping pieces of a text that is longer than a shard."""
    step = max(SHARD_CHARS - overlap, SHARD_CHARS // 2)
    if len(text) <= SHARD_CHARS:
        yield 0, text
    else:
        yield from ((a, text[a : a + step + overlap]) for a in range(0, max(len(text) - overlap, 1), step))


_FOUND = "doc_id long, item_id long, words int, start long, end long"


def leaks(docs: DataFrame, items: pd.DataFrame, doc_id: str = "doc_id", text: str = "text", places: bool = True) -> DataFrame:
    """(doc_id, item_id, words, start, end): every passage, with its characters [start, end) in the document's text.

    Without `places` start and end are null, which saves their search.
    """
    held = without_preamble(items)
    overlap = 3 * int(held.text.str.len().max() or 0) + 100 if len(held) else 100
    spark = docs.sparkSession
    phrases = spark.sparkContext.broadcast(Phrases(held))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ph = phrases.value
        ids, texts, at, size = [], [], [], 0

        def flush() -> Iterator[pd.DataFrame]:
            found = []
            for d, k, n, a, z in search_shard(texts, ph) if texts and ph.by_width else []:
                base, piece = at[d]
                found.append((ids[d], ph.ids[k], n, base + _place(piece, a + 1) - 1, base + _place(piece, z)) if places else (ids[d], ph.ids[k], n, None, None))
            if found:
                yield pd.DataFrame(found, columns=["doc_id", "item_id", "words", "start", "end"]).astype({"start": "Int64", "end": "Int64"})

        for b in batches:
            for i, t in zip(b["doc_id"], b["text"]):
                for base, piece in _pieces(t, overlap):
                    toks = tokens(piece)
                    if len(toks) >= min(LEAST.values()):
                        ids.append(i), texts.append(toks), at.append((base, piece if places else ""))
                        size += len(piece)
                    if size >= SHARD_CHARS:
                        yield from flush()
                        ids, texts, at, size = [], [], [], 0
        yield from flush()

    src = docs.select(docs[doc_id].cast("bigint").alias("doc_id"), docs[text].alias("text")).where("text is not null and doc_id is not null")
    least = spark.sparkContext.defaultParallelism
    if src.rdd.getNumPartitions() < least:  # few large files: spread them over the cores
        src = src.repartition(least)
    return src.mapInPandas(run, _FOUND)


def _item_parts(items: DataFrame, most: int = ITEM_CHARS) -> Iterator[pd.DataFrame]:
    """The items in parts of at most `most` characters (or one item), each fetched when it is searched."""
    sized = items.where("item_id is not null and text is not null").select("item_id", "text")
    total = sized.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = int(total // most) + 1
    for k in range(parts):
        yield (sized if parts == 1 else sized.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == k)).toPandas()


def found(docs: DataFrame, items: DataFrame, places: bool = True, most: int = ITEM_CHARS) -> DataFrame:
    """leaks of all items, in as many passes as their size asks for; items that open alike must be in one table."""
    out = None
    for part in _item_parts(items, most):
        one = leaks(docs, part, places=places)
        out = one if out is None else out.unionByName(one)
    return out


def merged_spans(spans: DataFrame) -> DataFrame:
    """(doc_id, item_id, start, end, words): overlapping and touching passages of a document and item merged."""
    by = W.partitionBy("doc_id", "item_id").orderBy("start", "end")
    s = spans.withColumn("_new", (F.col("start") > F.max("end").over(by.rowsBetween(W.unboundedPreceding, -1))).cast("int"))
    s = s.withColumn("_part", F.sum(F.coalesce("_new", F.lit(0))).over(by.rowsBetween(W.unboundedPreceding, 0)))
    return s.groupBy("doc_id", "item_id", "_part").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("words").alias("words")).drop("_part")


def p6_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The removal spans of each leaking document and item: characters [start, end) of its text, and the passage's words."""
    return merged_spans(found(table(spark, sf_dir, "documents"), table(spark, sf_dir, "heldout_item")))


def p6_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item that leaked, with its suite and split, the documents that hold a passage of it, and the longest one."""
    items = table(spark, sf_dir, "heldout_item")
    n = found(table(spark, sf_dir, "documents"), items, places=False).groupBy("item_id").agg(F.countDistinct("doc_id").alias("documents"), F.max("words").alias("longest"))
    return n.join(items.select("item_id", "suite", "split").dropDuplicates(["item_id"]), "item_id")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with a passage of an item, beside the item."""
    return found(table(spark, sf_dir, "documents"), table(spark, sf_dir, "heldout_item"), places=False).select("doc_id", "item_id").distinct()
