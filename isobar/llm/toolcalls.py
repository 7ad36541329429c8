"""Tool calls of conversations linked with their results; built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import use_checkpoints

#: A question of fewer characters is a short one.
SHORT = 60
CALLS = "array<struct<id:string,name:string,arguments:string,after:array<string>>>"
#: Tools with their parameters; ``type`` is one of _TYPES.
SCHEMAS = "name string, params array<struct<name:string,type:string,required:boolean>>"
_TYPES = {
    "string": "^STRING$",
    "integer": "^BIGINT$",
    "number": "^(BIGINT|DOUBLE|FLOAT|DECIMAL)",
    "boolean": "^BOOLEAN$",
    "object": "^OBJECT",
    "array": "^ARRAY",
}

_MESSAGE = (
    "struct<tool_calls:array<struct<id:string,name:string,arguments:variant,after:array<string>>>,"
    "tool_call_id:string,content:variant>"
)


def parsed(messages: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with ``calls`` and ``answers`` read from JSON texts.

    An assistant's text may be ``{"tool_calls": [{"id", "name", "arguments", "after"}]}``,
    a tool's ``{"tool_call_id", "content"}``.  Any other text is a plain message.
    """
    body = F.from_json("text", _MESSAGE)
    made = F.transform(
        body["tool_calls"],
        lambda c: F.struct(
            c["id"].alias("id"), c["name"].alias("name"), F.to_json(c["arguments"]).alias("arguments"), c["after"].alias("after")
        ),
    )
    return messages.select(
        "conv_id", "turn", "role", "text",
        F.when(F.col("role") == "assistant", made).cast(CALLS).alias("calls"),
        F.when(F.col("role") == "tool", body["tool_call_id"]).alias("answers"),
    )


def dialogue(messages: DataFrame) -> DataFrame:
    """A dialogue as calls of tools: a user's turn asks, the assistant's next turn answers.

    The call of turn ``t`` has id ``t`` and is answered by the assistant in turn ``t + 1``.
    As the given tables hold no real calls, every sixteen turns are made to hold what real
    ones do: calls wait for that of turn ``t - 2``, the first two for a later one, the fifth
    and seventh, and the sixth and eighth, for each other; some name a tool without a schema
    or leave an argument out, and a short question gives its turn as a string.
    """
    turn, place = F.col("turn"), F.pmod("turn", F.lit(16))
    waits_for = (
        F.when(place.isin(0, 1, 4, 5), turn + 2)
        .when(place.isin(2, 3, 10, 11), None)
        .otherwise(turn - 2)
    )
    arguments = (
        F.when(place.isin(2, 3), F.to_json(F.struct(F.lit("plain").alias("tone"), "turn")))
        .when(F.length("text") < SHORT, F.to_json(F.struct("text", turn.cast("string").alias("turn"))))
        .otherwise(F.to_json(F.struct("text", "turn")))
    )
    call = F.struct(
        turn.cast("string").alias("id"),
        F.when(place.isin(6, 7), "recall").otherwise("reply").alias("name"),
        arguments.alias("arguments"),
        F.when(waits_for.isNotNull(), F.array(waits_for.cast("string"))).alias("after"),
    )
    return messages.select(
        "conv_id", "turn", "role", "text",
        F.when(F.col("role") == "user", F.array(call)).cast(CALLS).alias("calls"),
        F.when(F.col("role") == "assistant", (turn - 1).cast("string")).alias("answers"),
    )


#: The tool that ``dialogue`` calls and that has a schema, as a row of SCHEMAS.
REPLY = """SELECT 'reply' AS name, array(
  named_struct('name', 'text', 'type', 'string', 'required', true),
  named_struct('name', 'turn', 'type', 'integer', 'required', true)) AS params"""


def _errors() -> Column:
    """What is wrong with ``given`` (a map of variants) by ``params``; sorted."""

    def wrong(p: Column) -> Column:
        kind = F.schema_of_variant(F.col("given")[p["name"]])
        right = F.lit(False)
        for name, pattern in _TYPES.items():
            right = right | ((p["type"] == name) & kind.rlike(pattern))
        absent = ~F.map_contains_key("given", p["name"])
        return (
            F.when(absent & p["required"], F.concat(F.lit("missing:"), p["name"]))
            .when(absent, F.lit(None))
            .when(~F.coalesce(right, F.lit(False)), F.concat(F.lit("type:"), p["name"]))
        )

    known = F.transform("params", lambda p: p["name"])
    unknown = F.transform(F.array_except(F.map_keys("given"), known), lambda n: F.concat(F.lit("unknown:"), n))
    return (
        F.when(F.col("params").isNull(), F.array(F.lit("no_schema")))
        .when(F.col("given").isNull(), F.array(F.lit("not_an_object")))
        .otherwise(F.array_sort(F.concat(F.filter(F.transform("params", wrong), lambda e: e.isNotNull()), unknown)))
    )


def _ordered(calls: DataFrame) -> DataFrame:
    """``conv_id, id, at, step`` of each call: after every call that it waits for.

    A call stands at its own turn unless it waits, over however many others, for one
    that stands later: then at the latest such turn, so many steps behind its begin as the
    longest way there has waits.  Both are null for calls in a cycle or behind one.

    Conversations in which no call waits for a later one are left as they are.  In the
    others the ways double in each round: ``ways`` holds pairs of calls that are
    ``length`` waits apart (one a call in a chain), so a chain of n calls takes log n
    rounds.  A way as long as there are calls goes round a cycle.
    """
    placed = calls.select("conv_id", "id", F.col("turn").alias("at"), F.lit(0).alias("step"))
    waits = calls.select("conv_id", "id", "turn", F.explode(F.array_distinct("after")).alias("dep"))
    known = calls.select("conv_id", F.col("id").alias("dep"), F.col("turn").alias("theirs"))
    waits = waits.join(known, ["conv_id", "dep"]).checkpoint()
    mixed = waits.where("theirs >= turn").select("conv_id").distinct()
    ways = waits.select("conv_id", "id", "dep").join(mixed, "conv_id", "left_semi").checkpoint()
    if ways.isEmpty():
        return placed
    most = ways.groupBy("conv_id").agg(F.count_distinct("id").alias("n")).agg(F.max("n")).first()[0]
    moved = placed.join(mixed, "conv_id", "left_semi").checkpoint()
    length = 1
    while length <= most and not ways.isEmpty():
        ends = moved.select("conv_id", F.col("id").alias("dep"), "at", (F.col("step") + length).alias("step"))
        reached = ways.join(ends, ["conv_id", "dep"]).select("conv_id", "id", "at", "step")
        best = F.max(F.struct("at", "step")).alias("best")
        moved = moved.union(reached).groupBy("conv_id", "id").agg(best).select("conv_id", "id", "best.*").checkpoint()
        onward = ways.select("conv_id", F.col("id").alias("dep"), F.col("dep").alias("next"))
        ways = ways.join(onward, ["conv_id", "dep"]).select("conv_id", "id", F.col("next").alias("dep"))
        ways = ways.distinct().checkpoint()
        length *= 2
    stuck = ways.select("conv_id", "id", F.lit(True).alias("stuck")).distinct()
    moved = moved.join(stuck, ["conv_id", "id"], "left").select(
        "conv_id", "id", *[F.when(F.col("stuck").isNull(), F.col(c)).alias(c) for c in ("at", "step")]
    )
    return placed.join(mixed, "conv_id", "left_anti").union(moved)


def link(messages: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per distinct call, result and plain message, in an order that can be sorted.

    ``messages`` is as ``parsed`` returns it, ``schemas`` has SCHEMAS.  Columns:
    ``conv_id``, ``turn``, ``kind`` (call, result or message), ``id``, ``status``,
    ``errors``, ``at`` and ``step`` (sort by them, then ``turn``: a result follows its
    call, a call the calls it waits for), ``copies`` (equal rows) and ``json``.

    Status of a call: ``linked``, ``unanswered``, ``repeated`` (an earlier call has the
    id), ``waiting`` (see ``_ordered``).  Of a result: ``linked``, ``repeated`` (an
    earlier one answers the call), ``orphan``.  Calls and results without a
    conversation, turn or id are ``unnamed`` and link to nothing.  The JSON has
    sorted keys and no spaces; the linked call of a result has the result's text.

    Joins are on conversation and id, so a long conversation spreads out; equal rows
    are counted before, so ids that many rows share join one to one.
    """
    use_checkpoints(messages.sparkSession)
    named = F.col("conv_id").isNotNull() & F.col("turn").isNotNull() & F.col("id").isNotNull()
    calls = (
        messages.select("conv_id", "turn", F.explode("calls").alias("c"))
        .select("conv_id", "turn", "c.id", "c.name", "c.arguments", "c.after")
        .groupBy("conv_id", "turn", "id", "name", "arguments", "after")
        .agg(F.count("*").alias("copies"))
        .checkpoint()
    )
    results = (
        messages.where("answers IS NOT NULL OR role = 'tool'")
        .groupBy("conv_id", "turn", F.col("answers").alias("id"), "text")
        .agg(F.count("*").alias("copies"))
        .checkpoint()
    )
    order = F.struct("turn", "name", "arguments", "after")
    first = calls.where(named).groupBy("conv_id", "id").agg(F.min(order).alias("first"))
    firsts = first.select("conv_id", "id", "first.turn", "first.after").checkpoint()
    placed = _ordered(firsts).checkpoint()
    answers = results.where(named).groupBy("conv_id", "id").agg(F.min(F.struct("turn", "text")).alias("answer"))

    found = (
        calls.join(first, ["conv_id", "id"], "left")
        .join(placed, ["conv_id", "id"], "left")
        .join(answers, ["conv_id", "id"], "left")
        .join(schemas.select("name", "params"), "name", "left")
        .withColumn("given", F.from_json("arguments", "map<string,variant>"))
    )
    is_first = F.coalesce(F.col("first").eqNullSafe(order), F.lit(False))
    linked = is_first & F.col("answer").isNotNull()
    shown = F.struct(
        F.coalesce(F.try_parse_json("arguments"), F.to_variant_object(F.array("arguments"))).alias("arguments"),
        F.col("id").alias("call"),
        "name",
        F.when(linked, F.col("answer.text")).alias("result"),
    )
    call_rows = found.select(
        "conv_id", "turn", F.lit("call").alias("kind"), "id",
        F.when(~named, "unnamed").when(~is_first, "repeated").when(F.col("at").isNull(), "waiting")
        .when(F.col("answer").isNull(), "unanswered").otherwise("linked").alias("status"),
        _errors().alias("errors"), F.coalesce("at", "turn").alias("at"), F.coalesce("step", F.lit(0)).alias("step"),
        "copies", F.to_json(shown).alias("json"),
    )
    answered = results.join(answers, ["conv_id", "id"], "left").join(
        placed.withColumn("known", F.lit(True)), ["conv_id", "id"], "left"
    )
    is_answer = F.coalesce(F.col("answer").eqNullSafe(F.struct("turn", "text")), F.lit(False))
    none = F.array().cast("array<string>")
    behind = F.greatest("turn", "at")
    result_rows = answered.select(
        "conv_id", "turn", F.lit("result").alias("kind"), "id",
        F.when(~named, "unnamed").when(F.col("known").isNull(), "orphan").when(is_answer, "linked").otherwise("repeated").alias("status"),
        none.alias("errors"), behind.alias("at"),
        F.when(F.col("at") >= F.col("turn"), F.col("step") + 1).otherwise(0).alias("step"),
        "copies", F.to_json(F.struct(F.col("text").alias("content"), F.col("id").alias("result"))).alias("json"),
    )
    plain = messages.where("coalesce(size(calls), 0) <= 0 AND answers IS NULL AND NOT role <=> 'tool'").groupBy(
        "conv_id", "turn", "role", "text"
    ).agg(F.count("*").alias("copies"))
    plain_rows = plain.select(
        "conv_id", "turn", F.lit("message").alias("kind"), F.lit(None).cast("string").alias("id"), F.lit("plain").alias("status"),
        none.alias("errors"), F.col("turn").alias("at"), F.lit(0).alias("step"), "copies",
        F.to_json(F.struct(F.col("text").alias("content"), "role")).alias("json"),
    )
    return call_rows.union(result_rows).union(plain_rows)


ORACLE = f"""
WITH m AS (SELECT conv_id, turn, role, text, count(*) AS copies FROM conversations GROUP BY ALL),
q AS (SELECT conv_id, turn, CAST(turn AS VARCHAR) AS id, turn % 16 AS place,
             CASE WHEN turn % 16 IN (6, 7) THEN 'recall' ELSE 'reply' END AS name,
             CASE WHEN turn % 16 IN (2, 3) THEN '{{"tone":"plain","turn":' || turn || '}}'
                  WHEN length(text) < {SHORT} THEN '{{"text":' || to_json(text)::VARCHAR || ',"turn":"' || turn || '"}}'
                  WHEN text IS NULL THEN '{{"turn":' || turn || '}}'
                  ELSE '{{"text":' || to_json(text)::VARCHAR || ',"turn":' || turn || '}}' END AS args,
             CASE WHEN turn % 16 IN (6, 7) THEN 'no_schema'
                  WHEN turn % 16 IN (2, 3) THEN 'missing:text,unknown:tone'
                  WHEN length(text) < {SHORT} THEN 'type:turn'
                  WHEN text IS NULL THEN 'missing:text' ELSE '' END AS errors,
             sum(copies) AS copies
      FROM m WHERE role = 'user' GROUP BY ALL),
r AS (SELECT conv_id, turn, text, CAST(turn - 1 AS VARCHAR) AS id, copies FROM m WHERE role = 'assistant'),
f AS (SELECT conv_id, id, turn, place, min(args) AS args FROM q GROUP BY ALL),
-- calls 0 and 1 of sixteen stand behind the next but one; 4 and 6, 5 and 7 wait for each other, 8 and 9 behind them
p AS (SELECT f.conv_id, f.id, f.args,
             CASE WHEN f.place IN (0, 1) AND n.id IS NOT NULL THEN f.turn + 2
                  WHEN f.place IN (4, 5) AND n.id IS NOT NULL OR f.place IN (6, 7) AND b.id IS NOT NULL
                    OR f.place IN (8, 9) AND b.id IS NOT NULL AND c.id IS NOT NULL THEN NULL
                  ELSE f.turn END AS at,
             CASE WHEN f.place IN (0, 1) AND n.id IS NOT NULL THEN 1 ELSE 0 END AS step
      FROM f LEFT JOIN f n ON n.conv_id = f.conv_id AND n.turn = f.turn + 2
             LEFT JOIN f b ON b.conv_id = f.conv_id AND b.turn = f.turn - 2
             LEFT JOIN f c ON c.conv_id = f.conv_id AND c.turn = f.turn - 4),
a AS (SELECT conv_id, id, min({{'turn': turn, 'text': text}}) AS answer FROM r GROUP BY ALL)
SELECT q.conv_id, q.turn, 'call' AS kind, q.id,
       CASE WHEN q.args <> p.args THEN 'repeated' WHEN p.at IS NULL THEN 'waiting'
            WHEN a.answer IS NULL THEN 'unanswered' ELSE 'linked' END AS status,
       q.errors, coalesce(p.at, q.turn) AS at, p.step, CAST(q.copies AS BIGINT) AS copies,
       '{{"arguments":' || q.args || ',"call":"' || q.id || '","name":"' || q.name || '"'
       || CASE WHEN q.args = p.args AND a.answer IS NOT NULL
               THEN ',"result":' || to_json(a.answer.text)::VARCHAR ELSE '' END || '}}' AS json
FROM q JOIN p ON q.conv_id = p.conv_id AND q.id = p.id LEFT JOIN a ON q.conv_id = a.conv_id AND q.id = a.id
UNION ALL
SELECT r.conv_id, r.turn, 'result', r.id,
       CASE WHEN p.id IS NULL THEN 'orphan' WHEN a.answer = {{'turn': r.turn, 'text': r.text}} THEN 'linked' ELSE 'repeated' END,
       '', greatest(r.turn, p.at), CASE WHEN p.at >= r.turn THEN p.step + 1 ELSE 0 END, r.copies,
       '{{"content":' || to_json(r.text)::VARCHAR || ',"result":"' || r.id || '"}}'
FROM r LEFT JOIN p ON r.conv_id = p.conv_id AND r.id = p.id JOIN a ON r.conv_id = a.conv_id AND r.id = a.id
UNION ALL
SELECT conv_id, turn, 'message', NULL, 'plain', '', turn, 0, copies,
       '{{"content":' || to_json(text)::VARCHAR || ',"role":' || to_json(role)::VARCHAR || '}}'
FROM m WHERE role NOT IN ('user', 'assistant')"""
