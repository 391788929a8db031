import json

from draftloom.llm import chat

SCHEMAS = {"add": {"a": ("BIGINT", True), "b": ("DOUBLE", False)}, "say": {"text": ("STRING", True)}}


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


CALLS = "conv_id long, seq long, call_id string, name string, arguments string, level int"
RESULTS = "conv_id long, seq long, call_id string, content string, linked string"


def test_linking_validation_and_messages(spark):
    calls = frame(spark, [
        (1, 0, "c1", "add", '{"b": 2.5, "a": 1}', 9),
        (1, 2, "c2", "add", '{"a": "x", "z": null}', 9),
        (1, 4, "c3", "say", '{"text": "a\\u00e9\\n\\"q\\""}', 9),
        (1, 6, "c4", "none", "{}", 9),
        (1, 8, "c5", "say", "not json", 9),
        (1, 9, None, "say", None, 9),
        (1, 10, "c6", None, '{"text": null}', 9),
        (1, 11, "c1", "add", '{"a": 3}', 9),
    ], CALLS)
    results = frame(spark, [(1, 1, "c1", "3.5", "x"), (1, 3, "c1", "again", "x"), (1, 5, "nobody", "?", "x"), (1, 7, None, None, "x")], RESULTS)
    rows = {(r.kind, r.seq): r for r in chat.link_calls(calls, results, SCHEMAS).collect()}
    assert len(rows) == 12
    assert {k: (r.linked, r.valid, r.errors) for k, r in rows.items() if k[0] == "call"} == {
        ("call", 0): (True, True, ""),
        ("call", 2): (False, False, "type of a; unexpected z"),
        ("call", 4): (False, True, ""),
        ("call", 6): (False, False, "unknown tool"),
        ("call", 8): (False, False, "not an object"),
        ("call", 9): (False, False, "not an object"),
        ("call", 10): (False, False, "unknown tool"),
        ("call", 11): (True, True, ""),
    }
    assert {k[1]: (r.linked, r.level, r.call_seq, r.errors) for k, r in rows.items() if k[0] == "result"} == {
        1: (True, 0, 0, ""), 3: (True, 0, 0, ""), 5: (False, -1, 5, "no call"), 7: (False, -1, 7, "no call"),
    }
    assert rows["call", 0].message == '{"arguments":{"a":1,"b":2.5},"id":"c1","name":"add","type":"call"}'
    assert json.loads(rows["call", 4].message)["arguments"] == {"text": 'aé\n"q"'}
    assert json.loads(rows["call", 8].message)["arguments"] == "not json"
    assert json.loads(rows["call", 9].message) == {"arguments": None, "id": None, "name": "say", "type": "call"}
    assert json.loads(rows["result", 7].message) == {"content": None, "id": None, "type": "result"}


def brute_levels(ids, edges):
    edges = {(a, b) for a, b in edges if a in ids and b in ids}
    out = {}
    while True:
        ready = {i: 1 + max((out[b] for a, b in edges if a == i), default=-1) for i in ids if i not in out and all(b in out for a, b in edges if a == i)}
        if not ready:
            return {i: out.get(i) for i in ids}
        out |= ready


def test_levels_of_chains_diamonds_and_cycles(spark):
    import random

    rnd = random.Random(2)
    ids = [f"n{k}" for k in range(60)] + [f"x{k}" for k in range(6)] + [f"l{k}" for k in range(70)]
    edges = [(f"n{k}", f"n{rnd.randrange(k)}") for k in range(1, 60) for _ in range(rnd.choice([0, 1, 1, 2, 3]))]
    edges += [("x0", "x1"), ("x1", "x2"), ("x2", "x0"), ("x3", "x0"), ("x4", "x3"), ("x4", "n3"), ("x5", "x5"), ("n9", "absent"), (None, "n1"), ("n1", None)]
    edges += [(f"l{k}", f"l{k - 1}") for k in range(1, 70)]
    calls = frame(spark, [(i,) for i in ids] + [(None,), ("n1",)], "call_id string")
    got = {r.call_id: r.level for r in chat.levels(calls, frame(spark, edges, "call_id string, needs string")).collect()}
    assert got == brute_levels(set(ids), edges)


def test_conversations(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "q"), (1, 2, "assistant", "a"), (1, 3, "user", "r"), (2, 0, "assistant", "?"), (None, 0, None, None), (2, 1, "user", None)]
    calls, results, depends = chat.conversation_calls(frame(spark, rows, "conv_id long, turn long, role string, text string"))
    got = {(r.conv_id, r.seq): (r.kind, r.linked, r.level, r.valid) for r in chat.link_calls(calls, results, chat.QUERY_SCHEMAS, depends).collect()}
    assert got == {
        (1, 0): ("result", False, -1, False), (1, 1): ("call", True, 0, True), (1, 2): ("result", True, 0, True), (1, 3): ("call", False, 1, True),
        (2, 0): ("result", False, -1, False), (2, 1): ("call", False, 0, False), (None, 0): ("result", False, -1, False),
    }


def test_empty(spark):
    calls, results, depends = chat.conversation_calls(frame(spark, [], "conv_id long, turn long, role string, text string"))
    assert chat.link_calls(calls, results, chat.QUERY_SCHEMAS, depends).count() == 0


def test_results_meet_calls_in_hash_joins(spark):
    calls = frame(spark, [(1, 0, "c1", "say", '{"text": "x"}', 9)], CALLS)
    results = frame(spark, [(1, 1, "c1", "y", "x")], RESULTS)
    plan = chat.link_calls(calls, results, SCHEMAS)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("ShuffledHashJoin") == 2 and "BroadcastHashJoin" not in plan and "SortMergeJoin" not in plan
