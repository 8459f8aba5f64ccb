"""A deterministic star schema and its enumerated tasks, from ranges and hashes: the same on any cluster.

The rows are functions of their number and a seed (xxhash64), so a table of any size is made where it is used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _pick(seed: int, name: str, n: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(name), "id"), F.lit(n))


def star(spark: SparkSession, rows: int = 18_000, seed: int = 7) -> dict[str, DataFrame]:
    """regions (8), warehouses (24), carriers (18), customers (120) and `rows` shipments."""
    code = lambda p, c, w=3: F.concat(F.lit(p), F.lpad(c.cast("string"), w, "0"))
    ship = spark.range(rows).select(
        code("SH", F.col("id"), 9).alias("shipment_id"), F.date_add(F.lit("2024-01-01").cast("date"), _pick(seed, "day", 365).cast("int")).alias("ship_date"), code("W", _pick(seed, "w", 24)).alias("warehouse_id"), code("C", _pick(seed, "c", 18)).alias("carrier_id"),
        code("U", _pick(seed, "u", 120)).alias("customer_id"), F.element_at(F.array(*map(F.lit, ("standard", "rush", "overnight"))), (_pick(seed, "s", 3) + 1).cast("int")).alias("service_level"),
        F.round(0.5 + _pick(seed, "kg", 50_000) / 100, 2).alias("weight_kg"), F.round(5 + _pick(seed, "fr", 90_000) / 100, 2).alias("freight_amount"), F.round(4 + _pick(seed, "h", 9_000) / 100, 2).alias("delivery_hours"), (_pick(seed, "late", 100) < 17).cast("int").alias("delayed_flag"),
    )
    dim = lambda n, *cols: spark.range(n).select(*cols)
    i = F.col("id")
    return {
        "regions": dim(8, code("R", i).alias("region_id"), F.concat(F.lit("Region "), i.cast("string")).alias("region_name")),
        "warehouses": dim(24, code("W", i).alias("warehouse_id"), code("R", i % 8).alias("region_id")),
        "carriers": dim(18, code("C", i).alias("carrier_id"), F.concat(F.lit("Carrier "), i.cast("string")).alias("carrier_name"), (i % 3).cast("int").alias("carrier_level")),
        "customers": dim(120, code("U", i).alias("customer_id"), F.element_at(F.array(*map(F.lit, ("retail", "trade", "public"))), (i % 3 + 1).cast("int")).alias("customer_segment")),
        "shipments": ship,
    }


def task_grid(spark: SparkSession, metrics: list[str], groups: list[str], months: list[str], tops: list[int], per_level: int, seed: str) -> DataFrame:
    """(level, metric, group, month, top, task_id): every combination of the parameters, the first per_level of each level by hash.

    The parameters are short lists; their combinations are made by explode, not by a join of tables.
    """
    arr = lambda xs: F.array(*map(F.lit, xs))
    d = spark.range(1).select(F.explode(arr(metrics)).alias("metric")).withColumn("group", F.explode(arr(["", *groups]))).withColumn("month", F.explode(arr(months))).withColumn("top", F.explode(arr([0, *tops])))
    d = d.where((F.col("group") != "") | (F.col("top") == 0))
    d = d.withColumn("level", F.when(F.col("group") == "", 1).when(F.col("top") == 0, 2).otherwise(3)).withColumn("task_id", F.sha2(F.concat_ws(":", F.lit(seed), "metric", "group", "month", F.col("top").cast("string")), 256))
    from ..operators.curate import stratum_top

    return stratum_top(d, ["level"], F.col("task_id"), per_level).drop("rank")
