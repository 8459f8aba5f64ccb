import io
import json
import math
import tarfile

import pytest
from pyspark.sql import functions as F

from loomwright.functions import closeness
from loomwright.functions import tables as tbl
from loomwright.functions import text as tx
from loomwright.operators import curate, groups, scoring, stats, telemetry
from loomwright.sources import readers
from loomwright.streaming import resample


def col(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(fn(F.col("x")).alias("y")).first().y


def test_numbers(spark):
    assert col(spark, "a 1,234.5 and -2e3, v2 is 7% in 2024-01-02 10:30", tx.answer_numbers) == [1234.5, -2000.0, 7.0]
    assert col(spark, None, tx.numbers) == []
    assert col(spark, "**¥1,200.50**", tx.single_number) == 1200.5
    assert col(spark, "1 of 2", tx.single_number) is None


def test_sql_text(spark):
    q = "SELECT COUNT(DISTINCT s.a), sum(b) FROM T1 s JOIN \"t2\" ON 1=1 WHERE c = 'It''s' AND d >= 7.5 GROUP BY 1"
    assert col(spark, q, tx.table_names) == ["t1", "t2"]
    assert col(spark, q, tx.aggregate_calls) == ["count:distinct a", "sum:b"]
    assert col(spark, q, tx.where_literals) == ["it''s"]
    assert col(spark, q, tx.where_numbers) == ["7.5"]
    assert col(spark, q, tx.read_only) is True
    assert col(spark, "select 1; drop table x", tx.read_only) is False
    assert col(spark, "select 'drop it'", tx.read_only) is True


def test_commands(spark):
    assert col(spark, "ls /workspace/", tx.unsafe_reasons) == []
    assert col(spark, "curl http://x; rm -rf /etc", tx.unsafe_reasons) == ["network", "destructive", "host_path_escape"]
    assert col(spark, "sqlite3 db .tables", tx.command_family) == "sqlite_schema_catalog"
    assert col(spark, "cd /a && python3 x.py", tx.command_family) == "python"
    assert col(spark, "sqlite3 db 'select replace(a, b, c) from t'", tx.command_family) == "sqlite_readonly"
    assert col(spark, "find / -name x", tx.unsafe_reasons) == ["root_scan"] and col(spark, "python -c 'import requests'", tx.unsafe_reasons) == ["python_network"]
    assert col(spark, "cat ../../etc/passwd", tx.unsafe_reasons) == ["host_path_escape"] and col(spark, None, tx.unsafe_reasons) == []
    assert col(spark, "assistant: 5\nuser: and now?", tx.final_answer) == "5"


def test_tables(spark):
    want = '[{"category": "a", "value": 1.0}, {"category": "b", "value": 2.0}]'
    assert tbl.answer_matches("x\n| c | v |\n|---|---|\n| b | 2 |\n| a | 1 |", want, None, None, False) == "pipe"
    assert tbl.answer_matches("| b | 2 |\n| a | 1 |", want, None, None, True) == "none"
    assert tbl.answer_matches('see [{"c": "A", "v": 1}, {"c": "b", "v": 2.00001}]', want, None, None, True) == "json"
    assert tbl.answer_matches("1. a: 1\n2. b: 2", want, None, None, True) == "lines"
    assert tbl.answer_matches("50%", "50", None, None, True) == "numeric"
    assert tbl.answer_matches(None, want, None, None, True) == "none"
    assert tbl.same_rows([["1"], ["1.0009"]], [[1.0005], [1.0]], 6e-4, 0, False)  # needs the exchange of an earlier match
    assert not tbl.same_rows([["1"], ["1"]], [[1.0], [2.0]], 1e-3, 0, False)
    cases = [("1 or 2", want), ("", "3"), (None, "3"), ("3", None), ("3", "3"), ("1 2 3 4 5 6 7 8", "3"), ("x 6", "3"), ("5", "not json")]
    got = [r[0] for r in spark.createDataFrame(cases, "a string, e string").select(closeness.closeness(F.col("a"), F.col("e"))).collect()]
    assert got == [0.85, 0.0, 0.0, 0.0, 1.0, 0.612372, 0.2, 0.0]
    assert tbl.rectangle([{"a": 1}, {"b": 1}]) is None and tbl.rectangle([[1], [2]]) == [[1], [2]] and tbl.rectangle([{"a": 1, "b": 2}]) == [[1, 2]] and tbl.rectangle([]) is None and tbl.rectangle({}) is None
    assert tbl.unranked([["1", "a"], ["2", "b"]], 1) == [["a"], ["b"]] and tbl.unranked([["1", "a"], ["3", "b"]], 1) == [["1", "a"], ["3", "b"]]
    assert tbl.cell_equal("12%", 0.12, 1e-9, 0) and tbl.cell_equal("n/a", None, 0, 0) and not tbl.cell_equal("1", True, 0, 0)


def test_scoring_edges(spark):
    e = spark.createDataFrame([(4, 4000), (12, 16000), (16, 32000)], "q int, t int").select(scoring.efficiency(F.col("q"), F.col("t"), F.lit(0.0), F.lit(0.0)).alias("e"))
    assert [round(r.e, 6) for r in e.collect()] == [0.0, 0.8, 0.8]
    b = spark.createDataFrame([(True, True, 0.5), (True, False, 0.5), (False, True, 2.0), (False, False, -1.0)], "f boolean, s boolean, q double")
    got = [r.b for r in b.select(scoring.banded(F.lit(True), F.lit(True), F.col("f"), F.col("s"), F.col("q")).alias("b")).collect()]
    assert got == [0.9, 0.7, 0.5, 0.1]
    t = spark.createDataFrame([("PASS", None)], "f string, e boolean").select(scoring.tri_state(F.lit(True), F.lit(True), F.col("f"), F.col("e")).alias("s")).first().s
    assert t == "UNKNOWN"


def test_groups_and_gate(spark):
    d = spark.createDataFrame([("a", True, 1.0), ("a", False, 0.2), ("b", True, 1.0), ("b", True, 1.0), (None, None, None)], "g string, c boolean, r double")
    adv = {(r.g, r.c): r.advantage for r in groups.advantages(d, "g", "r").collect()}
    assert adv[("a", True)] == 1.0 and adv[("b", True)] == 0.0
    gate = groups.group_gate(d.withColumn("e", F.lit(True)).withColumn("v", F.lit(1)), "g", "c", "e", "v", 2)
    assert {r.g: r.state for r in gate.collect()} == {"a": "active", "b": "no_contrast", None: "wrong_size"}
    q = groups.nearest_rank(spark.range(1, 11).withColumn("k", F.lit(1)), "id", [0.5, 0.9, 0.95], ["k"]).first()
    assert (q.n, q.p50, q.p90, q.p95) == (10, 5, 9, 10)


def test_curation(spark):
    c = spark.createDataFrame([("a", 5), ("b", 3), ("c", 2)], "s string, n int")
    assert {r.s: r.quota for r in curate.hamilton(c, "s", "n", 4).collect()} == {"a": 2, "b": 1, "c": 1}
    d = spark.range(1000).withColumn("s", F.col("id") % 3)
    top = curate.stratum_top(d, ["s"], curate.seeded("z", "id"), 7).collect()
    import hashlib

    want = {s: sorted((hashlib.sha256(f"z:{i}".encode()).hexdigest(), i) for i in range(1000) if i % 3 == s)[:7] for s in range(3)}
    assert {(r.s, r.id) for r in top} == {(s, i) for s, x in want.items() for _, i in x}
    a, b = curate.fingerprint(d, F.col("id").cast("string")), curate.fingerprint(d.orderBy(F.desc("id")).repartition(7), F.col("id").cast("string"))
    assert a.first() == b.first()
    h = curate.halves(d, curate.seeded("z", "id"), "id").groupBy("half").count().collect()
    assert sorted(r["count"] for r in h) == [500, 500]
    assert curate.stratum_top(d.limit(0), ["s"], curate.seeded("z", "id"), 7).count() == 0


def test_stats(spark):
    r = spark.createDataFrame([(8, 2), (0, 0)], "w int, l int").select(stats.sign_test("w", "l").alias("p")).collect()
    assert r[0].p == 0.109375 and r[1].p is None
    assert math.isclose(sum(stats.beta_binomial(9, 1.5, 2.5)), 1.0)
    assert stats.trials_needed(1, 1, 1, 0.5, 10) == 1
    low, high = stats.wilson(F.lit(5), F.lit(10))
    x = spark.range(1).select(low.alias("a"), high.alias("b")).first()
    assert (x.a, x.b) == (0.236593, 0.763407)
    v = spark.range(200).withColumn("v", F.col("id").cast("double"))
    b = stats.bootstrap(v, "v", ["id"], 400).first()
    assert b.mean == 99.5 and b.low < 99.5 < b.high and 6 < (b.high - b.low) / 2 < 10  # 1.96 * 57.7 / sqrt(200) = 8
    assert stats.bootstrap(v.repartition(7), "v", ["id"], 400).first() == b and stats.bootstrap(v.limit(0), "v", ["id"], 9).first().n == 0
    gain = stats.paired_bootstrap(v, v.withColumn("v", F.col("v") + 2), "id", "v", 50).first()
    assert (gain.n, gain.mean, gain.low, gain.high) == (200, 2.0, 2.0, 2.0)
    far = spark.range(500).select(F.lit(1).alias("g"), (F.col("id") + 1e9).alias("x"), (2 * F.col("id") + 1e9).alias("y"), F.lit(5.0).alias("z"))
    assert stats.pearson(far, "x", "y", ["g"]).first().r == 1.0 and stats.pearson(far, "x", "z", ["g"]).first().r is None


def test_telemetry(spark):
    lines = spark.createDataFrame([(1, "\x1b[32mstep:3 - a/b:1.5 - c:2\x1b[0m"), (2, "step:3 - c:4"), (3, "noise")], "n int, value string")
    m = {(r.step, r.metric): r.value for r in telemetry.step_metrics(telemetry.plain_lines(lines), "value", "n").collect()}
    assert m == {(3, "a/b"): 1.5, (3, "c"): 4.0}
    e = telemetry.exposition(spark.createDataFrame([('hits{e="0"} 3',), ("# HELP",), ("q 1e3",)], "value string")).collect()
    assert [(r.name, r.labels, r.value) for r in e] == [("hits", 'e="0"', 3.0), ("q", "", 1000.0)]


def test_sources(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "2.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    (tmp_path / "d" / "x.jsonl").write_text('{"a": 9}\n')
    assert sorted((r.step, r.a) for r in readers.stepped(spark, str(tmp_path / "d"), "a int").collect()) == [(2, 1), (2, 2)]
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "tasks_0_2.jsonl").write_text("\n".join(json.dumps({"t": t, "i": i}) for t in (0, 1) for i in (0, 1)))
    (tmp_path / "s" / "tasks_2_3.jsonl").write_text('{"t": 2, "i": 0}\n{"t": 2, "i": 0}')
    audit = readers.shard_audit(readers.shards(spark, str(tmp_path / "s"), "t int, i int"), "t", "i", 2)
    assert {(r.shard_start, r.complete, r.duplicates) for r in audit.collect()} == {(0, True, 0), (2, False, 1)}
    with tarfile.open(tmp_path / "a.tar.gz", "w:gz") as tar:
        body = b'{"x": 1}\n\n{"x": 2}\n'
        info = tarfile.TarInfo("m.jsonl")
        info.size = len(body)
        tar.addfile(info, io.BytesIO(body))
    assert readers.tar_json_lines(spark, str(tmp_path / "a.tar.gz")).count() == 2
    spark.range(5).createOrReplaceTempView("five")
    assert readers.query_read_only(spark, "select * from five", 3, truncate=True)[1] is True
    with pytest.raises(ValueError):
        readers.query_read_only(spark, "select * from five", 3)
    with pytest.raises(readers.NotReadOnly):
        readers.query_read_only(spark, "drop view five", 3)
    assert readers.statements(spark, "select 1 as a; select 2 as b", 5) == [{"b": 2}]
    assert [r.line for r in readers.rendered(spark.sql("select 1 a, cast(null as string) b"), "text").collect()] == ["1|"]
    assert readers.write_parquet(spark.range(0), str(tmp_path / "empty"), 0) == 0 and spark.read.parquet(str(tmp_path / "empty")).columns == ["id"]


def test_buffer_stream_equals_batch(spark, tmp_path):
    rows = [(g, i, ["PASS", "FAIL", "UNKNOWN"][(i * g) % 3]) for g in range(1, 5) for i in range(20)]
    src = spark.createDataFrame([(str(g), i, v) for g, i, v in rows], "group string, ord long, verdict string")
    src.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    q = resample.resample_stream(stream).writeStream.outputMode("update").format("memory").queryName("buf").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("buf").collect())) == sorted(map(tuple, resample.resample_batch(src).select("group", "attempts", "accepted", "passed", "state").collect()))
