"""Problem 4: copies of a text that differ in layout only, with their counts, safe against hot keys.

Plan: one scan computes a 128-bit canonical key per row and writes (table, id, key); exact key counts come from a
map-side combined aggregation, whose result is kept only for keys above `hot_rows`. Rows of these are salted into a
two-level aggregation; all other rows are shuffled once, by their key, which gives the representative and the copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import small_enough, table, written
from .layout import request_key, statement_key

#: A key with more rows than this is salted; at most rows / HOT_ROWS keys can be hot.
HOT_ROWS = 100_000
#: Hot keys are broadcast only while there are no more than this; beyond it they are joined by shuffle.
HOT_KEYS_BROADCAST = 50_000
SALTS = 64
_KEY = ["table_name", "k1", "k2"]


def keyed(df: DataFrame, table_name: str) -> DataFrame:
    """(table_name, id, key) rows to (table_name, id, k1, k2), without null and blank texts; two seeds make 128 bits."""
    name = F.lit(table_name)
    return df.where(F.col("id").isNotNull() & F.col("key").isNotNull() & (F.length("key") > 1)).select(name.alias("table_name"), F.col("id").cast("bigint").alias("id"), F.xxhash64(F.lit(17), name, "key").alias("k1"), F.xxhash64(F.lit(40961), "key", name).alias("k2"))


def hot_keys(rows: DataFrame, hot_rows: int) -> DataFrame:
    """The keys of more than hot_rows rows, by partial counts."""
    return rows.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_rows).select(*_KEY)


def split(rows: DataFrame, hot_rows: int) -> tuple[DataFrame, DataFrame | None]:
    """(cold, hot) rows; hot is None where no key is hot, so that nothing is computed for it."""
    hot = written(hot_keys(rows, hot_rows), "p4-hot")
    if hot.isEmpty():
        return rows, None
    side = F.broadcast(hot) if small_enough(hot, HOT_KEYS_BROADCAST) else hot
    return rows.join(side, _KEY, "left_anti"), rows.join(side, _KEY, "left_semi")


def _hot_sets(hot: DataFrame) -> DataFrame:
    """Two levels: each salt's share of a key first, then the key."""
    one = hot.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).groupBy(*_KEY, "salt", "id").agg(F.lit(1).alias("one"))
    level1 = one.groupBy(*_KEY, "salt").agg(F.min("id").alias("id_low"), F.count(F.lit(1)).alias("n"))
    return level1.groupBy(*_KEY).agg(F.min("id_low").alias("id_low"), F.sum("n").alias("n_copies"))


def copy_sets(rows: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """(table_name, k1, k2, id_low, n_copies) of every key.

    Repeated rows of one id count as one record. Empty input gives empty output.
    """
    cold, hot = split(rows, HOT_ROWS if hot_rows is None else hot_rows)
    sets = cold.groupBy(*_KEY).agg(F.min("id").alias("id_low"), F.countDistinct("id").alias("n_copies"))
    return sets if hot is None else sets.unionByName(_hot_sets(hot))


def copies(rows: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """(table_name, id_low, id_high): each further id of a set of copies beside the set's smallest id."""
    cold, hot = split(rows, HOT_ROWS if hot_rows is None else hot_rows)
    low = F.min("id").over(W.partitionBy(*_KEY))
    out = cold.withColumn("id_low", low)  # one shuffle; a cold key has at most hot_rows rows
    if hot is not None:
        sets = _hot_sets(hot).select(*_KEY, "id_low")
        out = out.unionByName(hot.join(F.broadcast(sets) if small_enough(sets, HOT_KEYS_BROADCAST) else sets, _KEY))
    return out.where(F.col("id") > F.col("id_low")).select("table_name", "id_low", F.col("id").alias("id_high")).distinct()


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    task = table(spark, sf_dir, "task").select(F.col("task_no").alias("id"), F.col("natural_language_instruction").alias("text"))
    record = table(spark, sf_dir, "training_record").select(F.col("record_id").alias("id"), F.col("reward_model.ground_truth.verification_sql").alias("text"))
    return keyed(request_key(task, "text", "key"), "task").unionByName(keyed(statement_key(record, "text", "key"), "training_record"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every copy beside the smallest id of its set, over both tables."""
    return copies(written(sources(spark, sf_dir), "p4"))


def p4_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p4_found by the path of hot keys: every key of more than one row is salted."""
    return copies(written(sources(spark, sf_dir), "p4"), 1)


def p4_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each distinct text: the kept id and its number of copies."""
    return copy_sets(written(sources(spark, sf_dir), "p4")).select("table_name", "id_low", "n_copies")
