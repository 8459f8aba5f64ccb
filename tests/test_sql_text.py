from pyspark.sql import functions as F

from loomwright.functions import sql_text as q

A = "SELECT s.c AS category, SUM(s.w) AS value FROM ships AS s JOIN car k ON k.id = s.id WHERE s.d >= '2024-01-01' AND s.st = 'open' GROUP BY s.c HAVING COUNT(*) >= 3 ORDER BY value DESC LIMIT 5"


def test_signature_ignores_layout_and_order():
    b = A.replace("s.c AS category, SUM(s.w) AS value", 'sum( s."w" ) as value,s.`c` as category').replace("s.d >= '2024-01-01' AND s.st = 'open'", "s.st='open' -- x\n and s.d>='2024-01-01'")
    assert q.signature(A) == q.signature(b)
    assert q.aliases(A) == {"s": "ships", "k": "car"}


def test_mutants_are_told_apart():
    want = {"time": "temporal", "value": "filter", "aggregate": "aggregation", "order": "order_limit", "limit": "order_limit", "group": "grouping", "having": "grouping"}
    for kind, label in want.items():
        m = q.mutate(A, kind)
        assert m and q.difference(m, A)[0] == label, kind
    assert q.mutate("select 1", "limit") is None and q.difference(A, A) == []
    assert q.literal_free(A) == q.literal_free(A.replace("'open'", "'shut'").replace("LIMIT 5", "LIMIT 9"))


def test_selects():
    assert q.selects('sqlite3 db "SELECT 1; drop table x; select  1"') == ["SELECT 1"]
    assert q.selects("python -c 'c.execute(\"select a from b\")'") == ["select a from b"]
    assert q.selects("sqlite3 db <<EOF\nSELECT 2;\nEOF") == ["SELECT 2"]
    assert q.selects("sqlite3 \"broken") == [] and q.selects("") == []


def test_messages_masks_and_hashes(spark):
    m = q.tagged_messages('<think>x</think>\n<tool_call>{"name":"bash","arguments":{"b":1}}</tool_call><tool_response>r</tool_response>done < 3')
    assert [(x["role"], x["content"], x["call_name"]) for x in m] == [("assistant", None, "bash"), ("tool", "r", None), ("assistant", "done < 3", None)]
    assert q.edit_mask([1, 2, 3, 4], [1, 9, 3]) == [0, 1, 0, 1] and q.edit_mask([1, 3], [1, 2, 3]) == [0, 1] and q.edit_mask([], [1]) == []
    assert q.find_all([1, 1, 1], [1, 1]) == [0, 1] and q.find_all([1], []) == []
    assert q.canonical_hash('{"b": 1, "a": null}') == q.canonical_hash('{"b":1}') != q.canonical_hash('{"b":2}') and q.canonical_hash("{") is None
    df = spark.createDataFrame([(A, A), (None, A), ("select 1", None)], "a string, b string")
    r = df.select(q.signature_udf("a").alias("s"), q.selects_udf(F.concat(F.lit("sqlite3 db \""), F.col("a"), F.lit('"'))).alias("x")).collect()
    assert r[0].s["tables"] == "car ships" and r[1].s["tables"] is None and len(r[0].x) == 1
