"""Problem 7: a mixture of sources by target shares of tokens, with capped repeats.

Documents are counted in tokens once. Each source's documents fall by a hash of their id into blocks, an exact random
permutation of equal parts; a source gives whole passes over its blocks and then the first blocks of one more pass, the
last of them up to the document that still fits (found in a part of that block's parts). The block units of all sources
are divided among output shards by a splitting tree of multivariate-hypergeometric draws, which keeps every quota exact; a
shard takes the next units of each source's permutation, so draws are disjoint, and shuffles its documents locally.

Only block sums reach the driver: at most MOST_SOURCES x BLOCKS rows, and BLOCKS for each target. A target's plan is one
row: its passes, its permutations and the unit at which each shard begins; the units themselves are never listed.

Defined results: the corpus size counts all documents; documents with a null source, or without tokens, are never
chosen; a target without documents or above its cap is filled as far as it goes and its shortfall stays open (it isn't
given to other sources); repeated document rows count as one; a target with a null or non-positive value
chooses nothing. All mixes draw from one permutation, so a smaller take is part of a larger one.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import table, written

#: Vocabulary of a public byte-level BPE tokenizer; spark.loomwright.tokenizer names another file.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Blocks of a source and parts of an edge block, and the most sources whose block sums the driver takes.
BLOCKS, MOST_SOURCES = 512, 2_000
#: Output shards of a mix.
SHARDS = 64
SEED = 20_240_607

# fixed value: the tokenizer's public split pattern
_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(1)
def _encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, tokens) of each document, over its whole text; null texts have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _encoder(tokenizer)
        for b in batches:
            if not len(b):
                continue
            yield pd.DataFrame({"doc_id": b["doc_id"], "source": b["source"], "tokens": [len(enc.encode_ordinary(t)) if t else 0 for t in b["text"]]})

    src = docs.select("doc_id", "source", "text").where("doc_id is not null")
    least = src.sparkSession.sparkContext.defaultParallelism
    if src.rdd.getNumPartitions() < least:
        src = src.repartition(least)
    return src.mapInPandas(run, "doc_id long, source string, tokens long").groupBy("doc_id").agg(F.min("source").alias("source"), F.max("tokens").alias("tokens"))


def split_quotas(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """(shards, sources): units of each source for each shard; columns add up to the quotas, shard sizes differ by one at most."""
    out = np.zeros((shards, len(quotas)), np.int64)

    def go(q: np.ndarray, a: int, b: int) -> None:
        if b - a == 1:
            out[a] = q
            return
        m = (a + b) // 2
        total = int(q.sum())
        base, extra = divmod(total, b - a)
        left = base * (m - a) + min(extra, m - a)
        part = rng.multivariate_hypergeometric(q, left, method="marginals") if total else q * 0
        go(part, a, m)
        go(q - part, m, b)

    go(quotas.astype(np.int64), 0, shards)
    return out


def _permutations(blocks: int, passes: int, rng: np.random.Generator) -> tuple[list[int], list[int]]:
    """(a, c) of the permutations x -> (a x + c) mod blocks, one for each pass."""
    coprime = [x for x in range(1, blocks + 1) if math.gcd(x, blocks) == 1]
    return [int(coprime[rng.integers(len(coprime))]) for _ in range(passes)], [int(x) for x in rng.integers(0, blocks, passes)]


_PLAN = "mix_name string, source string, asked long, most long, passes int, part_blocks int, rest long, blocks int, a array<int>, c array<int>, bounds array<long>"


def plan(blocks: pd.DataFrame, targets: pd.DataFrame, corpus_tokens: int, seed: int = SEED, shards: int = SHARDS) -> list[tuple]:
    """Rows of _PLAN for each target that chooses something. blocks: source, nth, tokens; nth is the place in the permutation.

    Unit u of a source is block (a[p] x + c[p]) mod blocks of pass p for u = p * blocks + x, and block u - passes * blocks
    of the last, partial pass; shard k has the units from bounds[k - 1] to bounds[k].
    """
    out = []
    targets = targets.dropna(subset=["mix_name", "source", "target_share", "max_repeats", "budget_factor"])
    size = {s: g.sort_values("nth") for s, g in blocks.groupby("source")}
    for k, (mix, rows) in enumerate(targets.sort_values(["mix_name", "source"]).groupby("mix_name")):
        rng = np.random.default_rng([seed, k])
        takes, quotas = [], []
        for r in rows.drop_duplicates("source").itertuples():
            g = size.get(r.source)
            if g is None or r.target_share <= 0 or r.max_repeats <= 0 or r.budget_factor <= 0:
                continue
            total = int(g.tokens.sum())
            asked, most = int(round(r.target_share * r.budget_factor * corpus_tokens)), total * int(r.max_repeats)
            passes, rest = divmod(min(asked, most), total)
            cum = g.tokens.cumsum().to_numpy()
            part = int(np.searchsorted(cum, rest, side="right"))  # blocks wholly inside the rest
            left = int(rest - (cum[part - 1] if part else 0))
            takes.append((mix, r.source, asked, most, int(passes), part, left, len(g), *_permutations(len(g), int(passes), rng)))
            quotas.append(passes * len(g) + part + (left > 0))
        if takes:
            bounds = np.cumsum(split_quotas(np.array(quotas), shards, rng), axis=0)
            out += [(*t, [int(x) for x in bounds[:, j]]) for j, t in enumerate(takes)]
    return out


def _inside_edge(edge: DataFrame, left: dict[tuple[str, str], int]) -> pd.DataFrame:
    """(mix_name, source, part, rest) of the edge blocks: parts wholly inside what is left, and what is left of the next one."""
    parts = edge.groupBy("mix_name", "source", "sub").agg(F.sum("tokens").alias("tokens")).toPandas()  # at most BLOCKS rows a target
    rows = []
    for (mix, source), g in parts.sort_values("sub").groupby(["mix_name", "source"]):
        cum, rest = g.tokens.cumsum().to_numpy(), left[mix, source]
        n = int(np.searchsorted(cum, rest, side="right"))
        rows.append((mix, source, int(g["sub"].iloc[n]) if n < len(g) else BLOCKS, int(rest - (cum[n - 1] if n else 0))))
    return pd.DataFrame(rows, columns=["mix_name", "source", "sub_edge", "sub_rest"])


def mixed(tokens: DataFrame, targets: DataFrame, seed: int = SEED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chosen, placed, plan): chosen (mix_name, source, doc_id, tokens, uses, shards) with the output shard of each use;
    placed has a row for each use with its shard and place; plan is _PLAN."""
    spark = tokens.sparkSession
    tokens = written(tokens, "p7-tokens")
    corpus = tokens.agg(F.sum("tokens")).first()[0] or 0
    live = tokens.where("source is not null and tokens > 0").withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(BLOCKS)).cast("int"))
    per_source = live.select("source").distinct()
    if per_source.limit(MOST_SOURCES + 1).count() > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources: mix them in parts")
    blocks = live.groupBy("source", "block").agg(F.sum("tokens").alias("tokens")).toPandas().sort_values(["source", "block"])
    blocks["nth"] = blocks.groupby("source").cumcount()
    takes = plan(blocks, targets.toPandas(), int(corpus), seed)
    plan_df = spark.createDataFrame(takes, _PLAN)
    rank_df = spark.createDataFrame(blocks[["source", "block", "nth"]], "source string, block int, nth int")  # at most MOST_SOURCES x BLOCKS small rows
    d = live.join(F.broadcast(rank_df), ["source", "block"]).join(F.broadcast(plan_df), "source")  # at most one row a target
    at_edge = (F.col("nth") == F.col("part_blocks")) & (F.col("rest") > 0)
    edge = d.where(at_edge).withColumn("sub", F.pmod(F.xxhash64(F.lit(seed + 3), "doc_id"), F.lit(BLOCKS)).cast("int"))
    inner = _inside_edge(edge, {(t[0], t[1]): t[6] for t in takes})
    edge = edge.join(F.broadcast(spark.createDataFrame(inner, "mix_name string, source string, sub_edge int, sub_rest long")), ["mix_name", "source"])
    within = W.partitionBy("mix_name", "source").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id"), "doc_id").rowsBetween(W.unboundedPreceding, 0)
    last = edge.where("sub = sub_edge").withColumn("more", (F.sum("tokens").over(within) <= F.col("sub_rest")).cast("int"))  # one part of one block a target
    others = edge.where("sub <> sub_edge").withColumn("more", (F.col("sub") < F.col("sub_edge")).cast("int"))
    extra = ["sub", "sub_edge", "sub_rest"]
    rest = d.where(~at_edge).withColumn("more", (F.col("nth") < F.col("part_blocks")).cast("int"))
    u = last.drop(*extra).unionByName(others.drop(*extra)).unionByName(rest).withColumn("uses", F.col("passes") + F.col("more")).where("uses > 0")

    def shard_of(p: Column) -> Column:
        # the place of the block in pass p: x with (a x + c) mod blocks = nth, counted forward as x = (a nth + c) mod blocks is a permutation as well
        x = (F.get("a", p).cast("long") * F.col("nth") + F.get("c", p)) % F.col("blocks")
        unit = F.when(p < F.col("passes"), p * F.col("blocks") + x).otherwise(F.col("passes") * F.col("blocks") + F.col("nth"))
        return F.size(F.filter("bounds", lambda b: b <= unit))

    chosen = u.select("mix_name", "source", "doc_id", "tokens", "uses", F.transform(F.sequence(F.lit(0), F.col("uses") - 1), shard_of).alias("shards"))
    placed = chosen.select("mix_name", "source", "doc_id", "tokens", F.posexplode("shards").alias("pass", "shard")).withColumn("place", F.xxhash64(F.lit(seed + 2), "shard", "pass", "doc_id"))
    return chosen, placed.select("mix_name", "shard", "place", "source", "doc_id", "pass", "tokens"), plan_df


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    tokenizer = spark.conf.get("spark.loomwright.tokenizer", TOKENIZER)
    return mixed(token_counts(table(spark, sf_dir, "documents"), tokenizer), table(spark, sf_dir, "mix_target"))


def p7_chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chosen documents of each mix, how often each is used, and the output shard of each use."""
    return _mix(spark, sf_dir)[0]


def p7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every use of a document with its output shard and its place in the shard's local shuffle."""
    return _mix(spark, sf_dir)[1]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual tokens and shares of each source of each mix, sources that gave nothing included.

    asked_tokens is what the target asks for, most_tokens what its cap allows (both 0 for a source without documents);
    reachable_share is the share that the targets, each cut to its cap, would have.
    """
    chosen, _, plan_df = _mix(spark, sf_dir)
    got = chosen.groupBy("mix_name", "source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("used_tokens"), F.count(F.lit(1)).alias("documents"), F.max("uses").alias("most_uses"))
    t = table(spark, sf_dir, "mix_target").select("mix_name", "source", "target_share", "max_repeats").dropDuplicates(["mix_name", "source"])
    out = t.join(got, ["mix_name", "source"], "left").join(plan_df.select("mix_name", "source", F.col("asked").alias("asked_tokens"), F.col("most").alias("most_tokens")), ["mix_name", "source"], "left").fillna(0, ["used_tokens", "documents", "most_uses", "asked_tokens", "most_tokens"])
    mix = W.partitionBy("mix_name")
    reach = F.least("asked_tokens", "most_tokens")
    return out.withColumn("actual_share", F.round(F.try_divide(F.col("used_tokens"), F.sum("used_tokens").over(mix)), 6)).withColumn("reachable_share", F.round(F.try_divide(reach, F.sum(reach).over(mix)), 6))
