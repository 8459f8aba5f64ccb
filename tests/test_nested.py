import json

from loomwright.operators import nested

SCHEMA = "raw_id long, payload string, entity string"


def rows(spark, payloads):
    df = spark.createDataFrame([(i, p, "clash") for i, p in enumerate(payloads)], SCHEMA)
    return sorted(map(tuple, nested.elements(nested.parsed(df)).collect()))


def test_shapes(spark):
    full = {"prompt": [{"role": "user", "tool_calls": [{"id": "a"}, None]}, None, {"role": "tool"}], "reward_model": {"ground_truth": {"required_tables": "t", "must_use_fields": [None, "f"], "evidence_plan": {"steps": [{"fields": [{"name": "x"}, {"name": "y"}]}, {"fields": None}]}, "expected_value": 3}}}
    camel = {"row": {"prompt": {"role": "user", "toolCalls": {"id": "b"}}, "rewardModel": {"groundTruth": json.dumps({"requiredTables": ["u", None, "v"], "expectedValueJson": json.dumps([{"category": 1, "value": 2}, {"category": 3, "value": 4}])})}}}
    got = rows(spark, [json.dumps(full), json.dumps(camel)])
    assert got == sorted(
        [(0, "message", "0"), (0, "message", "2"), (0, "tool_call", "0.0"), (0, "required_table", "0"), (0, "must_use_field", "1"), (0, "evidence_step", "0"), (0, "evidence_step", "1"), (0, "evidence_field", "0.0"), (0, "evidence_field", "0.1")]
        + [(1, "message", "0"), (1, "tool_call", "0.0"), (1, "required_table", "0"), (1, "required_table", "2"), (1, "gold_row", "0"), (1, "gold_row", "1")]
    )


def test_broken_null_empty_and_repeated(spark):
    good = json.dumps({"prompt": [{"role": "user"}]})
    assert rows(spark, [None, "", "{", '{"prompt": [1]} x', '{"prompt": [1]}{"a": 2}', "[1]", "3"]) == []
    assert rows(spark, []) == []
    assert rows(spark, [good, good]) == [(0, "message", "0"), (1, "message", "0")]
    long = json.dumps({"prompt": [{"role": "user", "content": "x" * 1_000_000}]})
    assert rows(spark, [long]) == [(0, "message", "0")]


def test_children_lead_back(spark):
    df = spark.createDataFrame([(7, json.dumps({"extra_info": {"instruction_sha256": "h"}, "prompt": [{"role": "assistant", "tool_calls": [{"id": "c", "arguments": {"a": 1}}]}]}), "")], SCHEMA)
    r = nested.flat(df, "tool_call").first()
    assert (r.raw_id, r.instruction_sha256, r.message_index, r.call_index, r.call_id, r.arguments) == (7, "h", 0, 0, "c", '{"a":1}')
    m = nested.flat(df, "message").first()
    assert (m.message_index, m.role, m.content) == (0, "assistant", None)
