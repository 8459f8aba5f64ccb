"""Problem 8: the reading level of documents, from vocabulary coverage and sentence complexity, calibrated in SQL.

Words (Latin words, single ideographs) are ranked by frequency within their script over the whole corpus; ties share a
rank, so ranks come from the counts of counts, whose number is bounded by the square root of twice the corpus. A
document's coverage rank is the rank of the smallest such vocabulary that covers COVER of its words. Grades are the
least-squares fit, per script, of the raters' grades (each rater's mean deviation removed) on the logarithms of coverage
rank, sentence length and word length and on the share of clause marks; the sums of the normal equations are SQL
aggregates, five by five numbers a script reach the driver.

Defined results: documents without words have a null grade; null grades and labels without their document are ignored;
of rows of one doc_id the least text counts;
with fewer than LEAST_LABELS labelled documents a script takes the pooled fit, without any label all grades are null.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import maybe_broadcast, table, written

#: Share of a document's words that its vocabulary must cover.
COVER = 0.92
#: The most frequent words, whose ranks are sent to the executors (12 bytes each); others are joined by shuffle, for the
#: documents that need them.
MOST_WORDS = 2_000_000
#: Repeated ids that may be broadcast; more are joined by shuffle.
MOST_IDS = 500_000
#: Counts up to this share few ranks.
SMALL_COUNT = 1_000
LEAST_LABELS = 30
GRADES = (1.0, 16.0)
FEATURES = ["x1", "x2", "x3", "x4"]

_WORD = re.compile(r"[a-zà-ɏ]+(?:'[a-z]+)?|[㐀-鿿]")
_SENTENCE = re.compile(r"[.!?。！？\n]+")
_CLAUSE = re.compile(r"[,;:，；：、—()（）]")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _code(w: str, salt: int = 0) -> int:
    b = w.encode()
    return (zlib.crc32(b, salt) << 32 | zlib.crc32(b[::-1] + b"*", salt)) - (1 << 63)


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: Counter = Counter()
    for b in batches:
        for t in b["text"]:
            held.update(words(t))
        if len(held) > 500_000:
            yield pd.DataFrame({"word": list(held.keys()), "n": list(held.values())})
            held.clear()
    if held:
        yield pd.DataFrame({"word": list(held.keys()), "n": list(held.values())})


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, han, n, rank): words of the corpus with their rank by frequency within their script; ties share the best."""
    count = docs.select("text").where("text is not null").mapInPandas(_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    count = written(count.withColumn("han", F.col("word").rlike("^[㐀-鿿]")), "p8-words")
    steps = count.groupBy("han", "n").agg(F.count(F.lit(1)).alias("words"))
    above = W.partitionBy("han").orderBy(F.desc("n")).rowsBetween(W.unboundedPreceding, -1)
    steps = steps.withColumn("rank", (F.coalesce(F.sum("words").over(above), F.lit(0)) + 1).cast("int")).drop("words")
    # most words have a small count: those ranks, two a count, are broadcast; a large count has few words
    few, many = F.broadcast(steps.where(F.col("n") <= SMALL_COUNT)), steps.where(F.col("n") > SMALL_COUNT)
    return count.where(F.col("n") <= SMALL_COUNT).join(few, ["han", "n"]).unionByName(count.where(F.col("n") > SMALL_COUNT).join(many, ["han", "n"]))


def _shape(text: str, n_words: int, letters: int) -> tuple[float, float, float]:
    sentences = sum(1 for s in _SENTENCE.split(text) if _WORD.search(s.lower())) or 1
    return float(np.log(n_words / sentences)), float(np.log(letters / n_words)), len(_CLAUSE.findall(text)) / sentences


def _head(vocab: DataFrame, most_words: int) -> tuple[int | None, pd.DataFrame]:
    """(least count, words with their ranks) of the most frequent words, no more than most_words and all of a count or none."""
    counts = vocab.groupBy("n").agg(F.count(F.lit(1)).alias("words"))
    within = counts.withColumn("so_far", F.sum("words").over(W.orderBy(F.desc("n")).rowsBetween(W.unboundedPreceding, 0)))  # counts of counts are few
    least = within.where(F.col("so_far") <= most_words).agg(F.min("n")).first()[0]
    return least, vocab.where(F.col("n") >= F.lit(least if least is not None else 1 << 62)).select("word", "rank").toPandas()


def one_text(docs: DataFrame) -> DataFrame:
    """(doc_id, text): the least text of each document; only the texts of repeated ids are shuffled."""
    d = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    repeated = written(d.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"), "p8-repeated")
    if repeated.isEmpty():
        return d
    ids = maybe_broadcast(repeated, MOST_IDS)
    return d.join(ids, "doc_id", "left_anti").unionByName(d.join(ids, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text")))


_PARTS = "doc_id long, han boolean, words int, coverage_rank int, need int, tail array<struct<word: string, n: int>>, x2 double, x3 double, x4 double"


def features(docs: DataFrame, vocab: DataFrame, most_words: int = MOST_WORDS) -> DataFrame:
    """(doc_id, han, words, coverage_rank, x1..x4) of documents with words.

    A document that the most frequent words cover is done where it is read. Only of others are the further words joined to
    their ranks; none of these is frequent, so no key of that join is hot.
    """
    src = one_text(docs)
    least, v = _head(vocab, most_words)
    salt = 0
    while True:  # codes must tell the words apart
        code = np.array([_code(w, salt) for w in v["word"]], np.int64)
        if len(np.unique(code)) == len(code):
            break
        salt += 1
    order = np.argsort(code)
    held = src.sparkSession.sparkContext.broadcast((code[order], v["rank"].to_numpy(np.int32)[order]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes, ranks = held.value
        seen: dict[str, int] = {}
        for b in batches:
            out = []
            for i, t in zip(b["doc_id"], b["text"]):
                w = words(t)
                han = [x for x in w if x >= "㐀"]
                main = han if len(han) * 2 >= len(w) else [x for x in w if x < "㐀"]
                if not main:
                    continue
                new = [x for x in set(main) if x not in seen]
                if new:
                    own = np.array([_code(x, salt) for x in new], np.int64)
                    at = np.minimum(np.searchsorted(codes, own), max(len(codes) - 1, 0))
                    seen.update(zip(new, np.where(codes[at] == own, ranks[at], 0).tolist() if len(codes) else [0] * len(new)))
                r = np.fromiter((seen[x] for x in main), np.int64, len(main))
                known, need = r[r > 0], int(np.ceil(COVER * len(main) - 1e-9))
                shape = _shape(t, len(w), sum(map(len, w)))
                if len(known) >= need:
                    out.append((i, main is han, len(main), int(np.partition(known, need - 1)[need - 1]), 0, [], *shape))
                else:
                    rest = Counter(x for x in main if not seen[x])
                    out.append((i, main is han, len(main), None, need - len(known), [{"word": x, "n": n} for x, n in rest.items()], *shape))
                if len(seen) > 1_000_000:
                    seen.clear()
            if out:
                yield pd.DataFrame(out, columns=["doc_id", "han", "words", "coverage_rank", "need", "tail", "x2", "x3", "x4"]).astype({"coverage_rank": "Int32"})

    parts = src.mapInPandas(run, _PARTS)
    done = ["doc_id", "han", "words", "coverage_rank", "x2", "x3", "x4"]
    tail = vocab if least is None else vocab.where(F.col("n") < least)
    if tail.isEmpty():
        return parts.select(done).withColumn("x1", F.log("coverage_rank"))
    parts = written(parts, "p8-parts")
    e = parts.where("coverage_rank is null").select("doc_id", "need", F.explode("tail").alias("t")).select("doc_id", "need", F.col("t.word").alias("word"), F.col("t.n").alias("n")).join(tail.select("word", "rank"), "word")
    by = W.partitionBy("doc_id").orderBy("rank").rangeBetween(W.unboundedPreceding, 0)
    cover = e.withColumn("cum", F.sum("n").over(by)).where("cum >= need").groupBy("doc_id").agg(F.min("rank").alias("coverage_rank"))
    late = parts.where("coverage_rank is null").drop("coverage_rank").join(cover, "doc_id").select(done)
    return parts.where("coverage_rank is not null").select(done).unionByName(late).withColumn("x1", F.log("coverage_rank"))


def rated(labels: DataFrame) -> DataFrame:
    """(doc_id, y): the mean grade of a document after each rater's mean deviation from it is removed."""
    g = labels.where("grade is not null and doc_id is not null").withColumn("mean", F.avg("grade").over(W.partitionBy("doc_id")))
    bias = F.broadcast(g.groupBy(F.col("rater").alias("_r")).agg(F.avg(F.col("grade") - F.col("mean")).alias("bias")))  # one row a rater
    return g.join(bias, F.col("rater").eqNullSafe(F.col("_r")), "left").groupBy("doc_id").agg(F.avg(F.col("grade") - F.coalesce("bias", F.lit(0.0))).alias("y"))


def calibrate(feats: DataFrame, labels: DataFrame, ridge: float = 1e-3) -> dict[str, list[float]]:
    """{script: [intercept, b1..b4]} from the normal equations, whose sums are one SQL aggregation."""
    z = feats.join(rated(labels), "doc_id")
    x = [F.lit(1.0), *(F.col(c) for c in FEATURES)]
    sums = [F.sum(a * b).alias(f"a{i}{j}") for i, a in enumerate(x) for j, b in enumerate(x) if j >= i] + [F.sum(a * F.col("y")).alias(f"b{i}") for i, a in enumerate(x)]
    rows = {r["han"]: r for r in z.groupBy("han").agg(F.count(F.lit(1)).alias("n"), *sums).collect()}  # two scripts

    def solve(parts: list) -> list[float]:
        n = len(x)
        a, b = np.zeros((n, n)), np.zeros(n)
        for r in parts:
            for i in range(n):
                b[i] += r[f"b{i}"]
                for j in range(n):
                    a[i, j] += r[f"a{min(i, j)}{max(i, j)}"]
        return np.linalg.solve(a + ridge * np.eye(n), b).tolist()

    out = {}
    for han, name in ((True, "han"), (False, "latin")):
        own = rows.get(han)
        if own and own["n"] >= LEAST_LABELS:
            out[name] = solve([own])
        elif rows:
            out[name] = solve(list(rows.values()))
    return out


def measured(docs: DataFrame) -> DataFrame:
    """The features of the documents, written once."""
    least = docs.sparkSession.sparkContext.defaultParallelism
    text = docs.select("doc_id", "text")
    if text.rdd.getNumPartitions() < least:
        text = text.repartition(least)
    return written(features(text, vocabulary(text)), "p8-features")


def estimate(model: dict[str, list[float]]) -> Column:
    """The grade by the fit of a document's script; null without one."""

    def fit(name: str) -> Column:
        b = model.get(name)
        return sum((F.lit(w) * F.col(c) for w, c in zip(b[1:], FEATURES)), F.lit(b[0])) if b else F.lit(None).cast("double")

    g = F.when(F.col("han"), fit("han")).otherwise(fit("latin"))
    return F.when(g.isNotNull(), F.round(F.greatest(F.lit(GRADES[0]), F.least(F.lit(GRADES[1]), g)), 3))


def graded(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, source, lang, words, coverage_rank, grade) of every document."""
    f = measured(docs)
    g = f.withColumn("grade", estimate(calibrate(f, labels)))
    keys = docs.select("doc_id", "source", "lang").where("doc_id is not null").groupBy("doc_id").agg(F.min("source").alias("source"), F.min("lang").alias("lang"))
    return keys.join(g.select("doc_id", "words", "coverage_rank", "grade"), "doc_id", "left")


def held_out(f: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    """(script, n, error, error_of_mean): mean absolute error in grades on labelled documents that no fit has seen.

    The labelled documents fall into folds by a hash of their id; each fold is graded by the fit to the others, and by
    their mean grade for comparison.
    """
    fold = lambda d: d.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(folds)))
    y = fold(rated(labels))
    out = None
    for k in range(folds):
        seen = fold(labels).where(F.col("fold") != k).drop("fold")
        mean = rated(seen).agg(F.avg("y")).first()[0]
        z = f.join(y.where(F.col("fold") == k), "doc_id").withColumn("grade", estimate(calibrate(f, seen)))
        one = z.select(F.when(F.col("han"), "han").otherwise("latin").alias("script"), F.abs(F.col("grade") - F.col("y")).alias("e"), F.abs(F.lit(mean) - F.col("y")).alias("m"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("script").agg(F.count("e").alias("n"), F.round(F.avg("e"), 3).alias("error"), F.round(F.avg("m"), 3).alias("error_of_mean"))


def p8_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The estimated grade of every document."""
    return graded(table(spark, sf_dir, "documents"), table(spark, sf_dir, "reading_label"))


def p8_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, their mean grade and its quartiles for each source and language."""
    g = p8_grades(spark, sf_dir)
    return g.groupBy("source", "lang").agg(
        F.count(F.lit(1)).alias("documents"), F.round(F.avg("grade"), 3).alias("mean_grade"), F.expr("percentile_approx(grade, 0.25, 1000)").alias("p25"), F.expr("percentile_approx(grade, 0.5, 1000)").alias("p50"), F.expr("percentile_approx(grade, 0.75, 1000)").alias("p75"), F.sum(F.when(F.col("grade") >= 12, 1).otherwise(0)).alias("demanding"),
    )


def p8_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The error of the grades on labelled documents that their fit has not seen."""
    return held_out(measured(table(spark, sf_dir, "documents")), table(spark, sf_dir, "reading_label"))
