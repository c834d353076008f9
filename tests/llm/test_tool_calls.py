import json

from packetflow.llm import tool_calls as tc

SCHEMAS = {"add": {"type": "object", "required": ["a", "b"], "properties": {"a": {"type": "integer"}, "b": {"type": "number"}}, "additionalProperties": False}}
SCHEMA = "conv_id long, turn long, role string, text string, extra string"


def run(spark, rows, schemas=SCHEMAS):
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    return {(r.conv_id, r.turn): r for r in tc.formatted(df, schemas).collect()}


def call(i, name="add", **arguments):
    return {"id": i, "function": {"name": name, "arguments": json.dumps(arguments)}}


def test_links_validates_and_writes_canonical_json(spark):
    calls = json.dumps({"content": "ok", "tool_calls": [call("c2", a={"$ref": "c1"}, b=1), call("c1", b=2.5, a=1)]})
    got = run(spark, [
        (1, 0, "user", "é \"q\""), (1, 1, "assistant", calls), (1, 2, "tool", json.dumps({"tool_call_id": "c1", "content": {"z": 1, "a": 2}})),
        (1, 3, "tool", json.dumps({"tool_call_id": "lost", "content": "?"})), (2, 0, "tool", json.dumps({"tool_call_id": "c1", "content": 1})),
    ])
    assert got[1, 0].message == '{"content":"é \\"q\\"","role":"user"}'
    turn = json.loads(got[1, 1].message)
    assert [c["id"] for c in turn["tool_calls"]] == ["c1", "c2"]  # the call that is referred to comes first
    assert [(c["state"], c["valid"]) for c in turn["tool_calls"]] == [("linked", True), ("unanswered", False)]
    assert got[1, 1].n_calls == 2 and got[1, 1].n_linked == 1 and got[1, 1].n_invalid == 1
    assert got[1, 2].message == '{"content":"","role":"tool","tool_results":[{"content":{"a":2,"z":1},"id":"c1","state":"linked"}]}'
    assert json.loads(got[1, 3].message)["tool_results"][0]["state"] == "orphan"
    assert json.loads(got[2, 0].message)["tool_results"][0]["state"] == "orphan"  # another conversation


def test_blocks_duplicates_and_malformed(spark):
    block = '<tool_call>{"id": "x", "name": "f", "arguments": {}}</tool_call>'
    got = run(spark, [
        (1, 0, "assistant", f"do {block}"), (1, 1, "assistant", block), (1, 2, "user", '<tool_response>{"tool_call_id": "x", "result": 1}</tool_response>'),
        (1, 3, "user", '<tool_response>{"tool_call_id": "x", "result": 2}</tool_response>'), (1, 4, "assistant", "<tool_call>{broken</tool_call>"), (1, 5, "assistant", '{"tool_calls": 7}'),
    ])
    state = lambda t, k: json.loads(got[1, t].message)[k][0]["state"]
    assert [state(0, "tool_calls"), state(1, "tool_calls"), state(2, "tool_results"), state(3, "tool_results")] == ["linked", "duplicate", "linked", "duplicate"]
    assert json.loads(got[1, 4].message)["content"] == "<tool_call>{broken</tool_call>"
    assert json.loads(got[1, 5].message)["content"] == '{"tool_calls": 7}'


def test_cycles_end_and_long_chains_are_ordered():
    make = lambda i, needs: {"id": i, "needs": needs}
    assert [c["id"] for c in tc.ordered([make("b", ["a"]), make("a", ["b"])])] == ["a", "b"]
    chain = [make(str(i), [str(i - 1)] if i else []) for i in range(50)]
    assert [c["id"] for c in tc.ordered(chain[::-1])] == [str(i) for i in range(50)]


def test_nulls_repeats_and_empty(spark):
    df = spark.createDataFrame([(None, None, None, None, "x"), (1, 0, "user", "a", "x"), (1, 0, "user", "a", "x"), (1, 0, "user", "b" * 100_000, "y")], SCHEMA)
    got = tc.formatted(df).collect()
    assert len(got) == 4 and min(r.message for r in got if r.conv_id is None) == '{"content":"","role":"unknown"}'
    assert tc.formatted(df.limit(0)).count() == 0


def test_schema_types():
    schema = {"type": "array", "items": {"enum": [1, 2]}}
    assert tc.check([1, 2], schema) == "" and tc.check([3], schema) == "$[0]: not in enum" and tc.check({}, schema) == "$: not array"
    assert tc.check(True, {"type": "integer"}) and not tc.check(2.0, {"type": "integer"})


def test_links_within_a_message_within_a_turn_and_backwards(spark):
    block = lambda i: f'<tool_call>{{"id": "{i}", "name": "f", "arguments": {{}}}}</tool_call>'
    answer = lambda i, x: f'<tool_response>{{"tool_call_id": "{i}", "result": {x}}}</tool_response>'
    rows = [(1, 0, "assistant", block("a") + answer("a", 1)), (2, 0, "assistant", answer("a", 1) + block("a")), (5, 0, "tool", answer("x", 1)), (5, 3, "assistant", block("x"))]
    rows += [(6, 0, "tool", answer("x", 1)), (6, 1, "assistant", block("x")), (6, 2, "tool", answer("x", 2))]
    for i in range(8):  # whichever message of the turn has the smaller hash
        rows += [(10 + i, 0, "assistant", f"{i} " + block("t")), (10 + i, 0, "tool", answer("t", i))]
    got = tc.formatted(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)).collect()
    linked = {}
    for r in got:
        linked[r.conv_id] = linked.get(r.conv_id, 0) + r.n_linked
    assert linked == {i: 2 for i in [1, 2, 5, 6, *range(10, 18)]}
    assert {r.turn: json.loads(r.message)["tool_results"][0]["state"] for r in got if r.conv_id == 6 and r.role == "tool"} == {0: "duplicate", 2: "linked"}


def test_calls_are_checked_by_what_their_conversation_declares(spark, tmp_path):
    tools = json.dumps({"content": "use these", "tools": [{"type": "function", "function": {"name": "add", "parameters": SCHEMAS["add"]}}]})
    block = '<tools>{"name": "add", "parameters": {"required": ["c"]}}\n{"name": "odd", "input_schema": {"type": ["null", 7], "enum": 1, "required": 5, "properties": []}}</tools>'
    bad, good, none = (json.dumps({"tool_calls": [x]}) for x in (call("x", a="1", b=2), call("x", a=1, b=2), {"id": "y", "name": "add", "arguments": "{"}))
    rows = [
        (1, 0, "system", tools), (1, 1, "assistant", bad), (1, 2, "assistant", good), (1, 3, "assistant", none), (1, 4, "system", block),
        (2, 0, "system", f"Tools: {block}"), (2, 1, "assistant", good), (2, 2, "assistant", json.dumps({"tool_calls": [call("o", "odd", a=1)]})),
        (3, 0, "assistant", bad), (None, 0, "system", tools), (None, 1, "assistant", bad), (4, 0, "system", '{"tools": [7, {"name": 1}, {"function": {}}], "functions": 3}'),
    ]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r.conv_id, r.turn): r for r in tc.op2_tool_call_linking(spark, str(tmp_path)).collect()}
    error = {k: x[0].get("error") for k, r in got.items() if (x := json.loads(r.message).get("tool_calls"))}
    assert error == {
        (1, 1): "$.a: not integer", (1, 2): None, (1, 3): "$: not JSON", (2, 1): "$.c: missing", (2, 2): None, (3, 0): None, (None, 1): "$.a: not integer",
    }
    assert {k: r.n_invalid for k, r in got.items()} == {k: int(error.get(k) is not None) for k in got} and len(got) == len(rows)
    assert json.loads(got[1, 0].message)["content"] == tools and json.loads(got[2, 0].message)["content"] == f"Tools: {block}"
    assert "add" in SCHEMAS and tc.check(float("inf"), {"type": "integer"}) == "$: not integer"


def test_odd_messages_do_not_end_the_job(spark):
    half, deep = '{"tool_calls": [{"id": "\\ud800", "name": "f", "arguments": {"\\udfff": 1}}]}', '{"tool_calls": [{"name": "f", "arguments": ' + "[" * 2_000 + "]" * 2_000 + "}]}"
    tools = '{"tools": [{"name": "f", "parameters": {"additionalProperties": false}}], "x": "\\udc00"}'
    got = run(spark, [(1, 0, "system", tools), (1, 1, "assistant", half), (1, 2, "assistant", deep)])
    assert json.loads(got[1, 1].message)["tool_calls"][0]["error"] == "$.\\udfff: unknown"
    assert json.loads(got[1, 2].message)["content"] == deep
