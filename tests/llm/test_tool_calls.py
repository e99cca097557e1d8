import json
from collections import Counter

import numpy as np

from ridgework.llm import tool_calls

SCHEMAS = [("sum", "a", "integer", True), ("sum", "b", "number", False), ("say", "text", "string", True)]


def linked(spark, calls, results):
    return {row["call_id"]: row for row in rows_of(spark, calls, results) if row["status"] != "conflict"}


def rows_of(spark, calls, results):
    c = spark.createDataFrame([(*row, "x") for row in calls], "conv_id bigint, call_id string, turn bigint, name string, arguments string, needs string, depth string")
    r = spark.createDataFrame(results, "conv_id bigint, call_id string, turn bigint, content string")
    s = spark.createDataFrame(SCHEMAS, "name string, parameter string, type string, required boolean")
    return tool_calls.link_calls(c, r, s).collect()


def test_links_order_and_checks(spark):
    calls = [
        (1, "c", 2, "sum", '{"b": 1.50, "a": 1}', "b"), (1, "b", 5, "sum", '{"a": "x", "z": {"y": 1, "k": [2, 1]}}', "a"),
        (1, "a", 9, "say", '{"text": "h\\u00e9"}', None), (1, "a", 9, "say", '{"text": "h\\u00e9"}', None), (1, None, 3, "say", "{}", None),
        (2, "p", 0, "say", "no json", "q"), (2, "q", 0, "none", "{}", "p"), (2, "r", 0, "say", "[1]", "missing"), (2, "s", 0, None, None, "q"),
    ]
    got = linked(spark, calls, [(1, "a", 10, "done"), (1, "a", 11, "later"), (3, "lost", 1, "w"), (1, None, 1, "n")])
    assert {k: v["status"] for k, v in got.items()} == {
        "a": "linked", "b": "unanswered", "c": "unanswered", "p": "unanswered", "q": "unanswered", "r": "unanswered", "s": "unanswered", "lost": "orphan"
    }
    assert [got[k]["place"] for k in "abcpqrs"] == [0, 2, 4, None, None, 0, None]
    assert got["a"]["valid"] and got["a"]["copies"] == 2 and got["c"]["valid"]
    assert got["b"]["problems"] == "unknown z; wrong type a"
    assert got["p"]["problems"].startswith("arguments are no object") and "cycle" in got["p"]["problems"] and "no object" in got["r"]["problems"]
    assert got["c"]["json"] == '{"arguments":{"a":1,"b":1.5},"id":"c","name":"sum","needs":"b"}'
    assert '"z":{"k":[2,1],"y":1}' in got["b"]["json"]
    for row in got.values():
        assert isinstance(json.loads(row["json"]), dict)
    assert linked(spark, [], []) == {}


def test_long_chain(spark):
    calls = [(1, f"{i}", i, "say", '{"text": "t"}', f"{i - 1}" if i else None) for i in range(200)]
    assert {int(k): v["place"] for k, v in linked(spark, calls, []).items()} == {i: 2 * i for i in range(200)}


def plain_problems(name, arguments):
    schema = {p: (t, need) for n, p, t, need in SCHEMAS if n == name}
    kinds = {"integer": int, "number": (int, float), "string": str}
    try:
        given = json.loads(arguments or "")
    except ValueError:
        given = None
    if not isinstance(given, dict):
        return ["arguments are no object"]
    if not schema:
        return ["no schema"]
    return sorted([f"missing {p}" for p, (_, need) in schema.items() if need and p not in given]
                  + [f"wrong type {p}" for p, (t, _) in schema.items() if p in given and not isinstance(given[p], kinds[t])]
                  + [f"unknown {p}" for p in given if p not in schema])


def plain_links(calls, results):
    """Every distinct call and result as ``(call_id, turn, name, status, place, copies, result_copies, problems)``."""
    key = lambda row: tuple((v is not None, v) for v in row)
    by_call, by_result = {}, {}
    for (conv, i, turn, name, arguments, needs), n in Counter(call for call in calls if call[1] is not None).items():
        by_call.setdefault(i, []).append(((turn, conv, name, arguments, needs), n))
    for (conv, i, turn, content), n in Counter(results).items():
        by_result.setdefault(i, []).append(((turn, conv, content), n))
    for rows in (*by_call.values(), *by_result.values()):
        rows.sort(key=lambda row: key(row[0]))
    out = []
    for i in {*by_call, *by_result} - {None}:
        seen, at = [], i
        while at in by_call and at not in seen:
            seen.append(at)
            at = by_call[at][0][0][4]
        place = None if at in by_call else 2 * (len(seen) - 1)
        answers = by_result.get(i, [])
        for k, ((turn, _, name, arguments, _), n) in enumerate(by_call.get(i, [])):
            found = plain_problems(name, arguments) + ["cycle"] * (place is None) + ["identifier taken"] * (k > 0)
            status = "conflict" if k else "linked" if answers else "unanswered"
            out.append((i, turn, name, status, place, n, answers[0][1] if answers and not k else 0, "; ".join(found)))
        for k, ((turn, _, _), n) in enumerate(answers):
            if i not in by_call:
                out.append((i, turn, None, "orphan", None, 0, n, ""))
            elif k:
                out.append((i, turn, None, "conflict", None, 0, n, "identifier taken"))
    return out


def test_every_call_and_result_stays(spark):
    rng = np.random.default_rng(5)
    texts = ['{"a": 1}', '{"a": 1, "b": 2.5}', '{"a": "x"}', '{"text": "t"}', '{"text": 1, "z": 2}', "{}", "[1]", "no json", "", None]
    pick = lambda values: values[rng.integers(len(values))]
    ids = [None, *map(str, range(30))]
    # A third of all rows bear one identifier.
    some = lambda: "7" if rng.random() < 0.33 else pick(ids)
    calls = [(1, some(), int(rng.integers(5)), pick(["sum", "say", "none", None]), pick(texts), pick(ids)) for _ in range(150)]
    results = [(1, pick(["lost", some()]), pick([None, 1, 2]), pick(["first", "second", "", None, "long " * 9000])) for _ in range(120)]
    calls, results = calls + calls[:40], results + results[:40]
    got = [tuple(r[k] for k in ("call_id", "turn", "name", "status", "place", "copies", "result_copies", "problems")) for r in rows_of(spark, calls, results)]
    assert sorted(got, key=str) == sorted(plain_links(calls, results), key=str)
    assert sum(row[5] for row in got) == sum(call[1] is not None for call in calls)
    assert sum(row[6] for row in got) == sum(result[1] is not None for result in results)
