import json
import random

import duckdb
import pytest

from conftest import TESTDATA
from isobar.llm import catalog, toolcalls

TOOLS = [
    ("find", [("q", "string", True), ("n", "integer", False)]),
    ("sum", [("xs", "array", True), ("scale", "number", False), ("deep", "object", False), ("ok", "boolean", False)]),
]


def calls(*made):
    return json.dumps({"tool_calls": [dict(zip(("id", "name", "arguments", "after"), m)) for m in made]})


def answer(i, content):
    return json.dumps({"tool_call_id": i, "content": content})


def run(spark, rows, tools=TOOLS):
    messages = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    schemas = spark.createDataFrame(tools, toolcalls.SCHEMAS)
    return toolcalls.link(toolcalls.parsed(messages), schemas).collect()


def test_links_orders_and_validates(spark):
    rows = [
        (1, 0, "user", "hello"),
        (1, 1, "assistant", calls(("a", "find", {"q": "x", "n": 2}, []), ("b", "sum", {"xs": [1], "scale": 1.5, "deep": {"z": 1, "a": 2}, "ok": True}, ["c"]))),
        (1, 2, "tool", answer("a", "late")),
        (1, 3, "assistant", calls(("c", "find", {"n": "2", "m": 1}, []), ("a", "find", {"q": "again"}, []))),
        (1, 0, "tool", answer("c", "too early")),
        (1, 4, "tool", answer("a", "second")),
        (1, 5, "tool", answer("zz", "nobody asked")),
        (1, 6, "assistant", calls(("p", "find", {"q": "1"}, ["q"]), ("q", "find", {"q": "1"}, ["p"]), ("u", "none", {}, None))),
        (1, 7, "assistant", calls((None, "find", {"q": "1"}, []))),
        (2, 0, "assistant", '{"tool_calls": "not a list"}'), (2, 1, "tool", "no json"), (2, 2, None, None),
        (None, 1, "assistant", calls(("a", "find", {"q": "x"}, []))), (1, 0, "user", "hello"),
    ]
    got = run(spark, rows)
    calls_of = {(r.conv_id, r.turn, r.id): r for r in got if r.kind == "call"}
    status = {k: r.status for k, r in calls_of.items()}
    assert status == {
        (1, 1, "a"): "linked", (1, 1, "b"): "unanswered", (1, 3, "c"): "linked", (1, 3, "a"): "repeated",
        (1, 6, "p"): "waiting", (1, 6, "q"): "waiting", (1, 6, "u"): "unanswered", (1, 7, None): "unnamed", (None, 1, "a"): "unnamed",
    }
    assert calls_of[1, 1, "a"].errors == [] and calls_of[1, 1, "b"].errors == []
    assert calls_of[1, 3, "c"].errors == ["missing:q", "type:n", "unknown:m"]
    assert calls_of[1, 6, "u"].errors == ["no_schema"]
    key = lambda r: (r["at"], r.step)
    assert key(calls_of[1, 1, "b"]) > key(calls_of[1, 3, "c"])
    results = {(r.turn, r.id): r for r in got if r.kind == "result"}
    assert key(results[0, "c"]) > key(calls_of[1, 3, "c"])
    assert {k: r.status for k, r in results.items()} == {
        (2, "a"): "linked", (0, "c"): "linked", (4, "a"): "repeated", (5, "zz"): "orphan", (1, None): "unnamed",
    }
    text = calls_of[1, 1, "b"].json
    assert text == '{"arguments":{"deep":{"a":2,"z":1},"ok":true,"scale":1.5,"xs":[1]},"call":"b","name":"sum"}'
    plain = [r for r in got if r.kind == "message"]
    assert {(r.conv_id, r.turn, r.copies) for r in plain} == {(1, 0, 2), (2, 0, 1), (2, 2, 1)}
    assert run(spark, rows[:0]) == []


def test_many_equal_ids_stay_linear(spark):
    rows = [(1, 0, "assistant", calls(("a", "find", {"q": str(i % 3)}, [])),) for i in range(300)]
    rows += [(1, 1, "tool", answer("a", "x"))] * 300
    got = run(spark, rows)
    assert len(got) == 4 and sum(r.copies for r in got) == 600
    assert sorted(r.status for r in got) == ["linked", "linked", "repeated", "repeated"]


def slow_positions(turns, waits):
    """The latest turn on any way and the most waits to it, walked one by one; None in or behind a cycle."""

    def walk(c, seen):
        if c in seen:
            return None
        best = (turns[c], 0)
        for d in waits.get(c, ()):
            if d in turns:
                found = walk(d, seen | {c})
                if found is None:
                    return None
                best = max(best, (found[0], found[1] + 1))
        return best

    return {c: walk(c, frozenset()) for c in turns}


def test_long_chains_and_cycles(spark):
    rng = random.Random(5)
    rows, expected = [], {}
    chain = [(f"c{i}", "find", {"q": "x"}, [f"c{i + 1}"]) for i in range(70)]
    rows.append((0, 1, "assistant", calls(*chain)))
    expected |= {(0, f"c{i}"): (1, 69 - i) for i in range(70)}
    ring = [(f"c{i}", "find", {"q": "x"}, [f"c{(i + 1) % 40}"]) for i in range(40)]
    behind = [("b0", "find", {"q": "x"}, ["c3"]), ("b1", "find", {"q": "x"}, ["b0"]), ("own", "find", {"q": "x"}, ["own"]), ("free", "find", {"q": "x"}, [])]
    rows.append((1, 1, "assistant", calls(*ring, *behind)))
    expected |= {(1, f"c{i}"): None for i in range(40)} | {(1, i): None for i in ("b0", "b1", "own")} | {(1, "free"): (1, 0)}
    for conv in range(2, 12):
        turns = {f"c{i}": rng.randrange(6) for i in range(14)}
        waits = {c: rng.sample(list(turns), rng.choice([0, 0, 1, 1, 2])) for c in turns}
        for c, t in turns.items():
            rows.append((conv, t, "assistant", calls((c, "find", {"q": "x"}, [*waits[c], "nobody"]))))
        expected |= {(conv, c): p for c, p in slow_positions(turns, waits).items()}
    got = {(r.conv_id, r.id): None if r.status == "waiting" else (r["at"], r.step) for r in run(spark, rows) if r.kind == "call"}
    assert got == expected and None in [p for (conv, _), p in got.items() if conv > 1]


@pytest.mark.skipif(not TESTDATA.exists(), reason="needs the given tables")
def test_query_equals_sql(spark):
    mine = catalog.QUERIES["op10_chat_formatting"](spark, str(TESTDATA)).toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{TESTDATA}/conversations.parquet'")
    theirs = con.execute(catalog.ORACLES["op10_chat_formatting"]).df()[list(mine.columns)]
    key = lambda f: sorted(tuple(map(str, r)) for r in f.astype(object).where(f.notna(), "-").itertuples(index=False))
    assert key(mine) == key(theirs)
    assert {"linked", "waiting"} <= set(mine.status) and {"no_schema", "missing:text,unknown:tone"} <= set(mine.errors)
    assert (mine["at"] > mine.turn).any()
