import pytest
from pyspark.sql import functions as F

from loomwright.operators import assemble, contracts, curate, masks, runs, select, telemetry

EVENTS = "array<struct<name: string, arguments: struct<command: string, path: string>, sql_statements: array<string>, ok: boolean, response_preview: string, response_token_count: int, observed_tool_response: boolean, call_parse_valid: boolean, source: string>>"
TRAJECTORY = f"trajectory_id long, record_id long, sample_index int, final_answer string, runtime_error boolean, trajectory_timeout boolean, pi_tool_events {EVENTS}, g string"
RECORD = "record_id long, reward_model struct<style: string, ground_truth: struct<expected_value_json: string, required_tables: array<string>, abs_tol: double, rel_tol: double>>, queries int"


def event(sql, ok=True, seen=True, shown="5"):
    return ("bash", ("sqlite3 db", None), sql, ok, shown, 10, seen, True, "tool")


def tables(spark):
    t = [
        (1, 1, 0, "The value is 30.", None, False, [event(["SELECT sum(v) FROM fact"], shown="30")], "clash"), (2, 1, 1, "31", None, None, [event(["SELECT v FROM fact"]), event(["select v from fact "])], None), (3, 1, 2, None, True, None, None, None), (4, 9, 0, "30", None, None, [], None),
        (5, 1, 3, "30", None, None, [event(["SELECT 1 FROM fact"], ok=None)], None), (6, 2, 0, "a 1, b 2", None, None, [event(["SELECT v FROM other"])], None), (7, None, 0, "", None, None, [event(None), event(["SELECT v FROM fact"], ok=False)], None),
    ]
    r = [(1, ("x", ("30", ["fact"], None, None)), 1), (2, ("x", ('[{"category": "a", "value": 1}, {"category": "b", "value": 2}]', ["fact"], 1e-3, 1e-5)), 1), (2, ("x", ("9", None, None, None)), 1), (None, ("x", ("1", None, None, None)), 1)]
    return spark.createDataFrame(t, TRAJECTORY), spark.createDataFrame(r[:2] + r[3:], RECORD)


def test_contracts_on_small_cases(spark):
    t, r = tables(spark)
    s = contracts.signals(t, r).cache()
    assert {x.trajectory_id: x.right for x in s.select("trajectory_id", contracts.right(s).alias("right")).collect()} == {1: True, 2: False, 3: False, 4: False, 5: True, 6: True, 7: False}
    assert {x.trajectory_id: (x.queries, x.repeats, x.attempts, x.successes, x.unseen) for x in s.collect()} == {1: (1, 0, 1, 1, 0), 2: (2, 1, 2, 2, 0), 3: (0, 0, 0, 0, 0), 4: (0, 0, 0, 0, 0), 5: (1, 0, 1, 0, 1), 6: (1, 0, 1, 1, 0), 7: (1, 0, 1, 0, 0)}
    assert {x.trajectory_id: x.layer for x in contracts.tiered(s).collect()} == {1: "success_correct_final", 2: "success_wrong_final", 3: "no_attempt", 4: "no_attempt", 5: "unknown", 6: "success_correct_final", 7: "attempt_failed"}
    assert {x.trajectory_id: x.state for x in contracts.tri_state(s).collect()} == {1: "PASS", 2: "FAIL", 3: "UNKNOWN", 4: "UNKNOWN", 5: "UNKNOWN", 6: "FAIL", 7: "UNKNOWN"}
    assert {x.trajectory_id: x.reason for x in contracts.minimal(s).collect()} == {1: "right", 2: "wrong_answer", 3: "runtime_error", 4: "no_record", 5: "no_success", 6: "other_tables", 7: "no_record"}
    assert {x.trajectory_id: x.agrees for x in contracts.last_bearing_agrees(t).collect()} == {1: True, 2: False, 3: None, 4: None, 5: None, 6: False, 7: False}
    none = contracts.signals(t.limit(0), r)
    assert [f(none).count() for f in (contracts.tiered, contracts.tri_state, contracts.minimal, contracts.blended)] == [0] * 4


def test_masks(spark):
    d = spark.createDataFrame([("SELECT count(*) FROM t WHERE a = 'x y' AND b >= 1.5",), (None,), ("",)], "q string").withColumn("t", masks.tokens(F.col("q")))
    d = d.withColumns({k: masks.component(F.col("t"), k) for k in masks.KINDS})
    a, b, c = d.collect()
    assert [sum(x) for x in zip(*(a[k] for k in masks.KINDS))] == [1] * len(a.t) and b.t is None and c.t == []
    w = d.select(masks.weighted([(F.col("aggregate"), 4.0), (F.col("literal"), 2.0)]).alias("w"), masks.weighted([(F.col("aggregate"), 4.0), (F.col("aggregate"), 1.0)]).alias("overlap"), masks.weighted([(F.col("aggregate"), 33.0)]).alias("heavy"), "literal").collect()
    assert sum(w[0].w) == 8.0 and w[0].overlap is None and w[0].heavy is None and w[1].w is None and w[2].w == []
    m = spark.range(1).select(masks.from_ranges(F.lit(4), F.array(F.struct(F.lit(1).alias("start"), F.lit(3).alias("end")))).alias("m"), masks.emphasised(F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)), F.array(F.lit(1), F.lit(0), F.lit(1)), 1, 9.0).alias("e"), masks.subset(F.array(F.lit(1), F.lit(0)), F.array(F.lit(1), F.lit(1))).alias("s")).first()
    assert m.m == [0, 1, 1, 0] and m.e == [1.0, 2.0, 9.0] and m.s


def test_statements(spark):
    gold = "SELECT sum(v) FROM fact WHERE d = '2024-01-02' AND k = 'x'"
    cases = {gold + " ;": ("strong", "exact"), "select sum(f.v), k from fact f where d = '2024-01-02 00:00' and k = 'x'": ("weak", "safe_projection"), "SELECT v FROM fact": ("weak", "none"), "SELECT v FROM other": ("violating", "none"), "DROP TABLE fact": ("violating", "none"), None: ("none", "none"), "": ("none", "none")}
    d = spark.createDataFrame([(q,) for q in cases], "q string")
    got = d.select("q", contracts.strength(F.col("q"), F.lit(gold), F.array(F.lit("fact"))).alias("s"), contracts.evidence_mode(F.col("q"), F.lit(gold)).alias("m")).collect()
    assert {r.q: (r.s, r.m) for r in got} == cases


def test_admission_tells_unstable_and_incomplete_runs(spark):
    a = spark.createDataFrame([("x", 1.0), ("y", 2.0)], "category string, value double")
    assert contracts.admission(a, a.orderBy(F.desc("category")), "category").first().admitted
    b = spark.createDataFrame([("x", 1.0), ("x", None)], "category string, value double")
    r = contracts.admission(b, a, "category").first()
    assert (r.same, r.complete, r.unique, r.admitted) == (False, False, False, False)
    assert contracts.admission(a.limit(0), a.limit(0), "category").first().admitted is False


def test_ranks_need_no_window_over_a_stratum(spark):
    d = spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, F.lit("hot")).when(F.col("id") % 9 > 0, "cold").alias("s"))
    r = curate.ranked(d, "s", curate.seeded("z", "id"), "rank").collect()
    import hashlib

    for s in ("hot", "cold", None):
        own = sorted((hashlib.sha256(f"z:{x.id}".encode()).hexdigest(), x.rank) for x in r if x.s == s)
        assert [k for _, k in own] == list(range(1, len(own) + 1))
    place = curate.round_robin(d.where("s is not null"), "s", curate.seeded("z", "id")).collect()
    n = len(place)
    assert sorted(x.place for x in place) == list(range(1, n + 1)) and [x.s for x in sorted(place, key=lambda x: x.place)[:4]] == ["cold", "hot", "cold", "hot"]
    assert curate.ranked(d.limit(0), "s", curate.seeded("z", "id"), "rank").count() == 0
    p = select.pools(d, "id", [("cold", F.col("s") == "cold", 5), ("rest", F.lit(True), 7)], curate.seeded("z", "id")).groupBy("pool").count().collect()
    assert {x.pool: x["count"] for x in p} == {"cold": 5, "rest": 7}


def test_assembly(spark):
    one = lambda v, f, t="string": spark.createDataFrame([(v,)], f"v {t}").select(f(F.col("v")).alias("x")).first().x
    assert one('["a", "b"]', assemble.as_strings) == ["a", "b"] and one('"a"', assemble.as_strings) == ["a"] and one(None, assemble.as_strings) == [] and one("[broken", assemble.as_strings) == []
    assert one('x [1, 2] y', assemble.json_in) == "[1, 2]" and one("{1} {2}", assemble.json_in) is None and one(None, assemble.json_in) is None
    assert [tuple(one(v, assemble.scalar_tag)) for v in ("1.50", "3", '"a "', "true", "null", None, "[1]")] == [("number", "1.5"), ("number", "3"), ("text", "a"), ("boolean", "true"), ("null", None), ("null", None), ("nested", "[1]")]
    assert one("select 1 from a join b on a.x = b.y and A.z=B.`w`", assemble.join_edges) == ["a.x=b.y", "a.z=b.w"]
    assert one("The End.", lambda c: assemble.with_suffix(c, "!", "End.")) == "The !" and one("x!", lambda c: assemble.with_suffix(c, "!")) == "x!"
    prev = spark.createDataFrame([(1, "e", None, "t1"), (2, "e", 3, " ")], "k int, env string, level int, text string")
    cur = spark.createDataFrame([(1, "e", None, "new"), (2, "e", 3, "n"), (3, "e", 1, "n")], "k int, env string, level int, text string")
    assert {(r.k, r.state, r.text) for r in assemble.carried(prev, cur, "k", ["env", "level"], "text").collect()} == {(1, "carried", "t1"), (2, "pending", None), (3, "pending", None)}
    quotas = spark.createDataFrame([(1, "a", 2), (1, "b", 3)], "level int, host string, quota int")
    d = spark.range(10).select("id", (F.col("id") % 2).cast("int").alias("level"))
    assert {r.host: r["count"] for r in assemble.host_ranges(d, "level", curate.seeded("h", "id"), quotas).groupBy("host").count().collect()} == {"a": 2, "b": 3}
    packet = assemble.packet_audit({"a": spark.range(3), "b": spark.createDataFrame([(0,), (0,), (2,)], "id long")}, "id").collect()
    assert [tuple(r) for r in packet] == [("a", 3, 0, 0, True), ("b", 3, 1, 1, False)]


def test_runs(spark):
    assert runs.restricted("round(x * (1 - y), 2)", {"x": 10.0, "y": 0.25}) == 7.5
    assert all(runs.restricted(e, {"x": 1.0}) is None for e in ("__import__('os')", "x.real", "z", "1 / 0", "x if x else 2", "[x]", "", "(" * 300, "9 ** 9 ** 9"))
    arms = runs.balanced(spark, [("a", 5), ("b", 4), ("c", 3), ("d", 9)], {"h": 8, "i": 6}).collect()
    assert {r.arm: r.host for r in arms} == {"d": None, "a": "h", "b": "i", "c": "h"}
    log = spark.createDataFrame([("l", 1, "\x1b[32mstep: 1\x1b[0m"), ("l", 2, "stage gen took 4 s"), ("l", 3, "step: 2"), ("l", 4, "stage gen took 6.5 s"), ("l", 5, "stage sync took 1.5s"), ("m", 1, "stage gen took 9 s")], "log string, n int, value string")
    assert {(r.stage, r.steps, r.seconds, r.share) for r in runs.steady(runs.driver_stages(log, "value", "n")).collect()} == {("gen", 1, 6.5, 0.8125), ("sync", 1, 1.5, 0.1875)}
    t = spark.createDataFrame([("hello world",), (None,), ("",)], "t string")
    assert [r[0] for r in t.select(runs.token_count("/no/such/file")(F.col("t"))).collect()] == [None] * 3
    m = spark.createDataFrame([(1, "step:3 a:1 a:2"), (2, "step:3 a/b:5"), (3, "step:3 a:4 12:30")], "n int, value string")
    assert {(r.metric, r.value) for r in telemetry.step_metrics(m, "value", "n").collect()} == {("a", 4.0), ("a/b", 5.0)}
    audit = runs.dataset_audit(spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (2, None, None)], "k int, l int, t string"), "k", "l", "t").first()
    assert (audit.rows, audit.repeated_keys, audit.repeated_texts, audit.levels, audit.balanced) == (3, 1, 1, 2, True)


def test_scratch_is_refused_on_a_cluster_without_a_shared_folder():
    from types import SimpleNamespace as N

    from loomwright.session import scratch_root

    unset = N(isDefined=lambda: False)
    sc = N(master="spark://host:7077", _jsc=N(sc=lambda: N(getCheckpointDir=lambda: unset)))
    with pytest.raises(ValueError):
        scratch_root(N(conf=N(get=lambda *a: None), sparkContext=sc))
    assert scratch_root(N(conf=N(get=lambda *a: "file:///shared/"), sparkContext=sc)) == "file:///shared"
