"""Levels of long chains and of cycles."""

import json
import random

from kinegrain.llm import chat_format


def test_call_levels_end_at_a_cycle(spark):
    calls = spark.createDataFrame([(1, f"c{i}", [f"c{i - 1}"] if i else []) for i in range(12)] + [(2, "x", ["y"]), (2, "y", ["x"])], "conv_id long, id string, needs array<string>")
    got = {(r.conv_id, r.id): r.level for r in chat_format.call_levels(calls).collect()}
    assert got == {(1, f"c{i}"): i for i in range(12)}


def levels_by_hand(calls):
    known = {(c, i) for c, i, _ in calls}
    needs = {(c, i): {(c, n) for n in ns if (c, n) in known} for c, i, ns in calls}
    out, grew = {}, True
    while grew:
        grew = False
        for k, ns in needs.items():
            if k not in out and all(n in out for n in ns):
                out[k] = 1 + max((out[n] for n in ns), default=-1)
                grew = True
    return out


def test_call_levels_against_a_walk(spark):
    rng = random.Random(9)
    calls = [(0, f"c{i}", [f"c{i - 1}"] if i else []) for i in range(300)]
    for conv in range(1, 9):
        n = rng.randint(5, 40)
        for i in range(n):
            some = rng.sample(range(n) if rng.random() < 0.06 else range(i), min(i, rng.choice((0, 1, 1, 1, 2, 3))))
            calls.append((conv, f"c{i}", [f"c{k}" for k in some] + ["unknown"] * (rng.random() < 0.1)))
    df = spark.createDataFrame(calls, "conv_id long, id string, needs array<string>")
    got = {(r.conv_id, r.id): r.level for r in chat_format.call_levels(df).collect()}
    assert got == levels_by_hand(calls)
    assert len(got) < len(calls)


def test_null_keys_repeated_tools_and_needs(spark):
    call = lambda *calls: json.dumps({"content": "x", "tool_calls": [{"id": i, "name": n, "arguments": a} for i, n, a in calls]})
    rows = [
        (None, 1, "assistant", call(("a", "f", {"$k": 1, "z": 3}), ("b", "f", {"z": "$a", "s": 'say "$c" now'}))), (None, 2, "tool", json.dumps({"tool_call_id": "a", "content": "ra"})),
        (1, None, "assistant", call(("a", "f", {"z": 1}))), (1, None, "tool", json.dumps({"tool_call_id": "a", "content": "rb"})), (None, None, None, None), (2, 1, "assistant", call(("a", "f", {"z": ["$a2", {"q": "$a3"}]}), ("a2", "f", {"z": 1}), ("a3", "f", {"z": 1}))),
        (3, 1, "user", "long " * 100_000),
    ]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    tools = spark.createDataFrame([("f", ["z"], {"z": "integer"}), ("f", ["z"], {"z": "integer"}), ("f", ["zz"], {"z": "integer"})], "name string, required array<string>, types map<string,string>")
    out = chat_format.link_tool_calls(messages, tools).collect()
    assert len(out) == len(rows)
    by = {(r.conv_id, r.turn, r.role): r for r in out}
    calls = {k: {x["id"]: x for x in json.loads(r.message)["tool_calls"]} for k, r in by.items() if r.n_calls}
    null = calls[None, 1, "assistant"]
    assert by[None, 1, "assistant"].n_calls == 2 and by[None, 1, "assistant"].n_results == 1 and null["a"]["result"] == "ra"
    assert (null["a"]["level"], null["a"]["errors"]) == (0, ["unknown:$k"]) and (null["b"]["level"], null["b"]["errors"]) == (1, ["unknown:s", "type:z"])
    assert calls[1, None, "assistant"]["a"]["result"] == "rb" and by[1, None, "tool"].n_errors == 0
    assert {i: x["level"] for i, x in calls[2, 1, "assistant"].items()} == {"a": 1, "a2": 0, "a3": 0}
    assert json.loads(by[None, None, None].message) == {"content": None, "role": None} and "long long" in by[3, 1, "user"].message
