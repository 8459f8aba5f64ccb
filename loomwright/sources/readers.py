"""Sources and sinks: JSON lines, stepped and sharded directories, archives, read-only SQL, audited Parquet."""

from __future__ import annotations

import io
import json
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import read_only


def json_lines(spark: SparkSession, path: str, schema: StructType | str, strict: bool = False) -> DataFrame:
    """One object per line, blank lines skipped; strict fails on a broken line, else its columns are null."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def stepped(spark: SparkSession, path: str, schema: StructType | str, low: int | None = None, high: int | None = None) -> DataFrame:
    """Rows of `<step>.jsonl` files with their step; other files are skipped, a range is decided by file name."""
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    d = spark.read.schema(schema).option("pathGlobFilter", "*.jsonl").json(path).withColumn("step", F.regexp_extract(name, r"^(\d+)\.jsonl$", 1).try_cast("bigint")).where("step is not null")
    if low is not None:
        d = d.where(F.col("step") >= low)
    return d.where(F.col("step") <= high) if high is not None else d


def shards(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Rows of `tasks_<start>_<stop>.jsonl` shards with the range of their name."""
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    p = r"^tasks_(\d+)_(\d+)\.jsonl$"
    d = spark.read.schema(schema).option("pathGlobFilter", "tasks_*.jsonl").json(path)
    return d.withColumns({"shard_start": F.regexp_extract(name, p, 1).try_cast("bigint"), "shard_stop": F.regexp_extract(name, p, 2).try_cast("bigint")})


def shard_audit(df: DataFrame, task: str, sample: str, per_task: int) -> DataFrame:
    """(shard_start, shard_stop, rows, tasks, duplicates, complete): complete if each task of the range has exactly its samples."""
    per = df.groupBy("shard_start", "shard_stop", task).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(sample).alias("d"))
    g = per.groupBy("shard_start", "shard_stop").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("tasks"), F.sum(F.col("n") - F.col("d")).alias("duplicates"), F.min((F.col("n") == per_task) & (F.col("d") == per_task)).alias("_ok"))
    return g.withColumn("complete", F.col("_ok") & (F.col("tasks") == F.col("shard_stop") - F.col("shard_start"))).drop("_ok")


def tar_json_lines(spark: SparkSession, path: str, members: str = ".jsonl") -> DataFrame:
    """(archive, member, line_no, record_json) of the JSON-line members of tar archives, an archive a task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["path"], b["content"]):
                with tarfile.open(fileobj=io.BytesIO(content), mode="r:*") as tar:
                    for m in tar:
                        if m.isfile() and m.name.endswith(members):
                            lines = [x for x in tar.extractfile(m).read().decode("utf-8", "replace").split("\n") if x.strip()]
                            yield pd.DataFrame({"archive": name, "member": m.name, "line_no": range(len(lines)), "record_json": lines})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "archive string, member string, line_no long, record_json string")


def csv_table(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    r = spark.read.option("header", True)
    return (r.schema(schema) if schema else r.option("inferSchema", True)).csv(path)


class NotReadOnly(ValueError):
    """A statement that isn't one SELECT or WITH."""


def query_read_only(spark: SparkSession, sql: str, max_rows: int, truncate: bool = False) -> tuple[list[dict], bool]:
    """(rows, truncated) of one read-only statement; more than max_rows is an error, or cut and told with truncate.

    The limit goes into the plan, so no more than max_rows + 1 rows reach the driver.
    """
    ok = spark.range(1).select(read_only(F.lit(sql)).alias("ok")).first()[0]
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    if not ok or "Command" in plan.getClass().getSimpleName():
        raise NotReadOnly(sql)
    rows = [r.asDict(True) for r in spark.sql(sql).limit(max_rows + 1).collect()]
    if len(rows) > max_rows and not truncate:
        raise ValueError(f"more than {max_rows} rows")
    return rows[:max_rows], len(rows) > max_rows


def statements(spark: SparkSession, script: str, max_rows: int) -> list[dict]:
    """Rows of the last of several read-only statements; `.tables` and `.schema NAME` are understood."""
    out: list[dict] = []
    for part in (p.strip() for p in script.split(";")):
        if part == ".tables":
            out = [{"name": t.name} for t in spark.catalog.listTables()]
        elif part.startswith(".schema"):
            names = part.split()[1:] or [t.name for t in spark.catalog.listTables()]
            out = [{"table": n, "column": c.name, "type": c.dataType} for n in names for c in spark.catalog.listColumns(n)]
        elif part:
            out, _ = query_read_only(spark, part, max_rows, truncate=True)
    return out


def rendered(df: DataFrame, form: str = "json", separator: str = "|") -> DataFrame:
    """(line) of each row as JSON, CSV or separated text; null is empty in separated text."""
    if form == "json":
        return df.select(F.to_json(F.struct("*")).alias("line"))
    if form == "csv":
        return df.select(F.to_csv(F.struct("*")).alias("line"))
    return df.select(F.array_join(F.array(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns)), separator).alias("line"))


def write_parquet(df: DataFrame, path: str, rows: int | None = None) -> int:
    """Write with the schema kept for empty results, count in the same job, and check the count if one is given."""
    from pyspark.sql import Observation

    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(path)
    n = int(seen.get["n"])
    if rows is not None and n != rows:
        raise ValueError(f"{n} rows written, {rows} expected")
    return n


def write_json(df: DataFrame, path: str) -> int:
    from pyspark.sql import Observation

    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").json(path)
    return int(seen.get["n"])


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of files, hashed where they are read."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def canonical_json(text: str) -> str:
    """JSON with sorted keys and no blanks; what an identity hash is taken of."""
    return json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
