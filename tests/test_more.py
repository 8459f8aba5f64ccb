import math

from pyspark.sql import functions as F

from loomwright.operators import more, select
from loomwright.operators import trajectories as traj


def test_unique_projection():
    assert more.unique_projection([["a", "1", "x"], ["b", "2", "x"]], [["a", 1.0], ["b", 2.0]])
    assert not more.unique_projection([["1", "1"], ["2", "2"]], [[1.0], [2.0]])  # two columns would do
    assert not more.unique_projection([], [["a"]]) and not more.unique_projection([["a"]], [["b"]])


def test_mutants_and_tail(spark):
    d = spark.createDataFrame([("SELECT SUM(a) FROM t GROUP BY b ORDER BY 1 DESC LIMIT 3",), (None,)], "q string")
    assert {r.mutation for r in more.mutants(d, "q").collect()} == {"aggregate", "order", "limit", "group"}
    x = spark.createDataFrame([(3, 0, 1.0, 1.0), (3, 2, 1.0, 1.0)], "n int, k int, a double, b double").select(more.success_tail("n", "k", "a", "b").alias("p")).collect()
    assert math.isclose(x[0].p, 1.0) and math.isclose(x[1].p, 0.5)
    e = spark.range(1).select(more.expected_attempts(F.lit(0.5), 3).alias("a"), more.expected_attempts(F.lit(0.0), 3).alias("b")).first()
    assert (e.a, e.b) == (1.75, 3.0)


def test_conclusions_paths_and_calls(spark):
    d = spark.createDataFrame([("结果：1,200.5",), ("a 1\nb 2 or 3",), ("Final answer: 4. Result: 5",), ("so\n\nit is 7 ",), (None,), ("none",)], "a string")
    v, r = traj.unique_conclusion(F.col("a"))
    assert [tuple(x) for x in d.select(v.alias("v"), r.alias("r")).collect()] == [(1200.5, "label"), (None, "ambiguous_line"), (None, "ambiguous_label"), (7.0, "last_line"), (None, "no_answer"), (None, "no_number")]
    p = spark.createDataFrame([("/workspace/a/../b",), ("/workspace/../etc",), ("../x",), ("a/b",), ("/etc/passwd",), ("$HOME",), (None,)], "p string").select(traj.path_state(F.col("p")).alias("s")).collect()
    assert [x.s for x in p] == ["inside", "outside", "outside", "inside", "outside", "unknown", "unknown"]
    m = spark.createDataFrame([([("assistant", None, [("c1", "bash", "{}"), (None, "read", "{}")], None), ("tool", "Error: no", None, "c1"), ("tool", "late", None, "c1")],)], "m array<struct<role string, content string, tool_calls array<struct<id string, name string, arguments string>>, tool_call_id string>>")
    c = m.select(traj.paired_calls(F.col("m")).alias("c")).first().c
    assert [(x.call_id, x.response, x.ok) for x in c] == [("c1", "Error: no", False), (None, None, False)]
    dv = spark.createDataFrame([([1, 2], [1, 2]), ([1, 2], [1, 3]), ([1], [1, 2]), ([], [])], "a array<int>, b array<int>").select(traj.first_divergence(F.col("a"), F.col("b")).alias("i")).collect()
    assert [x.i for x in dv] == [None, 1, 1, None]
    cov = spark.createDataFrame([(["/d/A.md"], ["a", "b.md"]), ([], [])], "o array<string>, r array<string>").select(traj.document_coverage(F.col("o"), F.col("r")).alias("c")).collect()
    assert [x.c for x in cov] == [0.5, None]


def test_selection(spark):
    d = spark.createDataFrame([(i, "g%d" % (i // 3)) for i in range(30)], "id int, g string")
    a = select.assign_groups(d, "g", {"train": 18, "test": 6}, F.sha2("g", 256))
    assert {r.split: r.n for r in a.groupBy("split").agg(F.count("*").alias("n")).collect()} == {"train": 18, "test": 6, "unused": 6}
    assert a.groupBy("g").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
    c = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "id int, t string")
    assert [r.id for r in select.diverse(c, "id", ["t"], 2, "id").orderBy("turn").collect()] == [1, 3]
    order = [r.v for r in spark.createDataFrame([("10",), ("b",), ("9",), ("a",)], "v string").orderBy(*select.natural_order("v")).collect()]
    assert order == ["9", "10", "a", "b"]
