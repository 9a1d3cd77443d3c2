import json
import random

from pyspark.sql import functions as F

from refscope.llm import toolcalls as T

SCHEMA = "conv_id long, turn int, kind string, id string, parent_id string, call_id string, name string, arguments string, role string, content string"
SCHEMAS = {
    "add": {"type": "object", "properties": {"a": {"type": "integer", "minimum": 0}, "b": {"type": ["number", "null"]}}, "required": ["a"], "additionalProperties": False},
    "tag": {"type": "object", "properties": {"tags": {"type": "array", "items": {"enum": ["x", "y"]}, "maxItems": 2, "minItems": 1}}},
}


def run(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("depth", F.lit(1)).withColumn("up", F.lit("u"))
    return T.linked(df, SCHEMAS).collect()


def call(conv, turn, own, parent, name, arguments):
    return (conv, turn, "call", own, parent, None, name, arguments, None, None)


def result(conv, turn, own, call_id, content):
    return (conv, turn, "result", own, None, call_id, None, None, None, content)


def message(conv, turn, own, parent, content):
    return (conv, turn, "message", own, parent, None, None, None, "user", content)


def test_links_order_and_json(spark):
    rows = [
        message(1, 0, "m", None, 'say "hi"\n'),
        call(1, 1, "c1", "m", "add", '{"b": 1.5, "a": 2}'),
        call(1, 1, "c2", "m", "add", '{"a": -1, "z": 0}'),
        result(1, 0, "r2", "c2", "é"),
        result(1, 2, "r1", "c1", "3"),
        call(1, 3, "c3", "r1", "add", "{"),
        result(2, 0, "r1", "c1", "another conversation"),
    ]
    got = {(r.conv_id, r.id): r for r in run(spark, rows)}
    assert len(got) == len(rows)
    assert {k: r.position for k, r in got.items()} == {(1, "m"): 0, (1, "c1"): 1, (1, "c2"): 1, (1, "r2"): 2, (1, "r1"): 2, (1, "c3"): 3, (2, "r1"): 0}
    assert {k[1] for k, r in got.items() if r.linked and k[0] == 1} == {"c1", "c2", "r1", "r2"} and not got[2, "r1"].linked
    assert got[1, "c1"].json == '{"arguments":{"a":2,"b":1.5},"id":"c1","kind":"call","name":"add"}' and got[1, "c1"].errors == []
    assert got[1, "c2"].errors == ["$.a: below minimum", "$.z: not allowed"]
    assert got[1, "c3"].errors == ["arguments are not JSON"] and json.loads(got[1, "c3"].json)["arguments"] is None
    assert got[1, "r2"].json == '{"call_id":"c2","content":"é","kind":"result","name":"add"}'
    assert json.loads(got[1, "m"].json) == {"content": 'say "hi"\n', "kind": "message", "role": "user"}


def test_a_result_comes_after_its_call_and_its_parent(spark):
    rows = [call(1, 0, "c1", None, "add", "{}"), message(1, 1, "m1", "c1", "x")]
    rows += [message(1, i, f"m{i}", f"m{i - 1}", "x") for i in range(2, 6)]
    rows += [(1, 6, "result", "r", "m5", "c1", None, None, None, "x"), (1, 7, "result", "lost", "m2", "gone", None, None, None, "x")]
    rows += [(2, 0, "result", "x", "y", "c", None, None, None, "x"), message(2, 1, "y", "x", "x"), call(2, 2, "c", None, "add", "{}"), message(2, 3, "z", "y", "x")]
    got = {(r.conv_id, r.id): r.position for r in run(spark, rows)}
    assert {i: got[1, i] for i in ("c1", "m1", "m5", "r", "lost")} == {"c1": 0, "m1": 1, "m5": 5, "r": 6, "lost": 3}
    assert {i: p for (c, i), p in got.items() if c == 2} == {"x": None, "y": None, "c": 0, "z": None}


def longest(preds):
    """Steps of the longest way to each item; None on and behind a cycle."""
    out = {}
    while True:
        ready = [i for i, before in preds.items() if i not in out and all(b in out for b in before)]
        if not ready:
            return {i: out.get(i) for i in preds}
        out |= {i: max((out[b] + 1 for b in preds[i]), default=0) for i in ready}


def test_random_orders_against_longest_ways(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for conv in range(40):
        preds = {}
        for i in range(rng.randint(1, 25)):
            before = {f"i{rng.randrange(i + (rng.random() < 0.05))}" for _ in range(rng.randint(0, 2)) if i}
            preds[f"i{i}"] = before
            two = [*sorted(before), None, None]
            rows.append((conv, i, "result", f"i{i}", two[0], two[1], None, None, None, "x"))
        want |= {(conv, i): n for i, n in longest(preds).items()}
    assert {(r.conv_id, r.id): r.position for r in run(spark, rows)} == want


def test_a_long_conversation_of_calls_and_results_takes_few_rounds(spark, plans):
    rows = []
    for i in range(0, 600, 3):
        rows += [call(1, i, f"c{i}", f"r{i - 1}" if i else None, "add", "{}"), message(1, i + 1, f"m{i}", f"c{i}", "x")]
        rows.append((1, i + 2, "result", f"r{i + 2}", f"m{i}", f"c{i}", None, None, None, "x"))
    assert all(r.position == r.turn for r in run(spark, rows))
    assert sum(label == "llm-pointers" for label, _ in plans) < 20


def test_schemas():
    cases = {
        '{"tags":["x"]}': [], '{"tags":[]}': ["$.tags: shorter than minItems"], '{"tags":["x","q","y"]}': ["$.tags: longer than maxItems", "$.tags[1]: not in enum"],
        "[]": ["$: not object"], "NaN": ["arguments are not JSON"], "": ["arguments are not JSON"],
    }
    assert {a: T.checked("tag", a, SCHEMAS)[1] for a in cases} == cases
    assert T.checked("add", '{"a":true}', SCHEMAS)[1] == ["$.a: not integer"] and T.checked("add", '{"a":1,"b":null}', SCHEMAS)[1] == []
    assert T.checked("what", "{}", SCHEMAS) == ("{}", ["unknown tool"]) and T.checked(None, None, SCHEMAS)[0] is None
    assert T.checked("tag", "[" * 100_000, SCHEMAS)[1] == ["arguments are not JSON"]


def test_long_chains_cycles_and_repeats(spark):
    rows = [message(1, i, f"m{i}", f"m{i - 1}" if i else None, "x") for i in range(400)]
    rows += [message(2, 0, "a", "b", "x"), message(2, 1, "b", "a", "x"), message(2, 2, "c", "c", "x"), message(2, 3, "d", "a", "x")]
    # One id used by many calls and many results: every row stays, none multiplies.
    rows += [call(3, i, "c", None, "add", f'{{"a":{i}}}') for i in range(300)] + [result(3, 0, f"r{i}", "c", "x") for i in range(300)]
    rows += [message(None, 0, None, None, None), message(None, 0, None, None, None), (None,) * 10]
    got = run(spark, rows)
    assert len(got) == len(rows)
    assert all(r.position == r.turn for r in got if r.conv_id == 1)
    assert all(r.position is None for r in got if r.conv_id == 2)
    assert all(r.linked for r in got if r.conv_id == 3) and {r.position for r in got if r.kind == "result"} == {1}
    assert run(spark, []) == []
