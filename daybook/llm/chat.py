"""Chat formatting: tool calls linked with their results, ordered, validated, and written as canonical JSON.

A message whose text is a JSON object with `tool_calls` makes calls: each has id, name, arguments (an object) and may have
`after`, the ids of calls that go before it. A message of role `tool` whose text is an object with `tool_call_id` is a result.
Every other message is plain, and is formatted in its own task without any shuffle. Main path: DataFrame functions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .common import Scratch

#: Argument names of each tool: type, and whether a call must give it.
TOOLS = {
    "search": {"query": ("string", True), "limit": ("int", False)},
    "calculator": {"expression": ("string", True)},
    "weather": {"city": ("string", True), "days": ("int", False)},
}


#: What is added to a turn for the message made from it.
MADE = 1_000_000


def json_string(text: Column) -> Column:
    """A JSON string, or null."""
    whole = F.to_json(F.struct(text.alias("x")))
    return F.when(text.isNull(), F.lit("null")).otherwise(whole.substr(F.lit(6), F.length(whole) - 6))


def _any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def verdict(name: Column, arguments: Column, tools: dict) -> Column:
    """ok, unknown_tool, or invalid: not an object, a missing or mistyped argument, or one the schema hasn't."""
    keys = F.map_keys(F.from_json(F.to_json(arguments), "map<string,string>"))
    known = F.lit("unknown_tool")
    for tool, schema in tools.items():
        wrong = [F.size(F.array_except(keys, F.array(*map(F.lit, schema)))) > 0]
        for argument, (kind, needed) in schema.items():
            given = F.array_contains(keys, argument)
            typed = F.coalesce(F.schema_of_variant(F.try_variant_get(arguments, f"$.{argument}", "variant")) == ("STRING" if kind == "string" else "BIGINT"), F.lit(False))
            wrong.append((given & ~typed) | (~given if needed else F.lit(False)))
        fits = F.when(keys.isNull() | F.coalesce(_any_of(wrong), F.lit(True)), "invalid").otherwise("ok")
        known = F.when(name == tool, fits).otherwise(known)
    return F.coalesce(known, F.lit("unknown_tool"))


def levels(calls: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, call_id, level): 0 for calls that wait for none, else one more than the last they wait for; none in or behind a cycle.

    `calls` (conv_id, call_id, after) has each id once a conversation; ids that name no call of it are ignored. Chains of calls that
    wait for one other each are jumped along in doubling steps, so their rounds are the logarithm of their length. What is left are
    calls that wait for several: each round settles those whose predecessors are settled.
    """
    key = ["conv_id", "call_id"]
    ids = calls.select(*key)
    waits = calls.select(*key, F.explode("after").alias("other")).distinct().join(ids.withColumnRenamed("call_id", "other"), ["conv_id", "other"], "left_semi")
    waits = scratch.table(waits.select(*key, "other"), "waits")
    if waits.isEmpty():
        return ids.withColumn("level", F.lit(0))
    counted = waits.groupBy(*key).agg(F.count("*").alias("n"), F.min("other").alias("root"))
    jumps = scratch.table(counted.where("n = 1").select(*key, "root", F.lit(1).alias("steps")), "jumps-0")
    several = scratch.table(counted.where("n > 1").select(*key, "n"), "several")
    most, k, open_ = jumps.count(), 0, jumps
    ended = None
    while most >> k:  # after as many doublings a chain has ended, or it is a cycle
        on = jumps.select("conv_id", F.col("call_id").alias("root"), F.col("root").alias("next"), F.col("steps").alias("more"))
        k += 1
        now = open_.join(on, ["conv_id", "root"], "left")
        now = now.select(*key, F.coalesce("next", "root").alias("root"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.col("next").isNotNull().alias("moved"))
        now = scratch.table(now, f"jumps-{k}")
        end, open_ = now.where("NOT moved").drop("moved"), now.where("moved").drop("moved")  # only chains that still move go on
        ended = end if ended is None else ended.union(end)
        jumps = ended.union(open_)
        if open_.isEmpty():
            break
    first = ids.join(waits, key, "left_anti").withColumn("level", F.lit(0))
    if not several.isEmpty():
        ends = jumps.select("conv_id", F.col("call_id").alias("other"), "root", "steps")
        edges = waits.join(several, key).join(ends, ["conv_id", "other"], "left")
        edges = scratch.table(edges.select(*key, "n", F.coalesce("root", "other").alias("root"), (F.coalesce("steps", F.lit(0)) + 1).alias("steps")), "edges")
        first = scratch.table(first, "settled-0")
        new, open_, k = first, edges.withColumn("level", F.lit(None).cast("int")), 0
        while True:  # each round fills in the predecessors settled in the one before
            k += 1
            settled = new.select("conv_id", F.col("call_id").alias("root"), F.col("level").alias("at"))
            open_ = open_.join(settled, ["conv_id", "root"], "left")
            open_ = scratch.table(open_.select(*key, "n", "root", "steps", F.coalesce("level", F.col("at") + F.col("steps")).alias("level")), f"open-{k}")
            ready = open_.groupBy(*key, "n").agg(F.count("level").alias("done"), F.max("level").alias("level")).where("n = done").select(*key, "level")
            new = scratch.table(ready, f"settled-{k}")
            if new.isEmpty():
                break
            first = first.union(new)
            open_ = open_.join(new.select(*key), key, "left_anti")
    behind = jumps.join(first.select("conv_id", F.col("call_id").alias("root"), "level"), ["conv_id", "root"]).select(*key, (F.col("level") + F.col("steps")).alias("level"))
    return first.select(*key, "level").union(behind)


def format_chats(conversations: DataFrame, tools: dict = TOOLS) -> DataFrame:
    """One row per message: conv_id, turn, role, kind, n_calls, n_answered, n_valid, level, message (canonical JSON).

    kind: plain, calls, result, or orphan_result where no call has the id. A call is answered by the first result of its id in
    its conversation, by turn; of calls with one id, the first by turn and place counts. level: of a result, its call's; of
    calls, the last one's; null in a cycle. Calls in a message go by level, then place; keys are sorted, and so are
    arguments'. Null texts are null content. Repeated rows give repeated results. A long conversation isn't gathered: rows
    meet by (conversation, id). Other columns are not read; no messages give no rows.
    """
    scratch = Scratch(conversations.sparkSession, "chat")
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    object_ = F.startswith(F.ltrim(F.coalesce("text", F.lit(""))), F.lit("{"))
    parsed = F.when(object_, F.try_parse_json("text"))
    rows = rows.withColumn("parsed", parsed)
    made = F.try_variant_get("parsed", "$.tool_calls", "array<variant>")
    answers = F.when(F.col("role") == "tool", F.try_variant_get("parsed", "$.tool_call_id", "string"))
    rows = rows.withColumns({"made": made, "answers": answers})
    special = (F.size("made") > 0) | F.col("answers").isNotNull()
    plain = rows.where(~F.coalesce(special, F.lit(False)))
    start = lambda content: [F.lit('{"content":'), json_string(content), F.lit(',"role":'), json_string(F.col("role"))]
    end = [F.lit(',"turn":'), F.coalesce(F.col("turn").cast("string"), F.lit("null")), F.lit("}")]
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("int")
    formatted = plain.select("conv_id", "turn", "role", F.lit("plain").alias("kind"), zero.alias("n_calls"), zero.alias("n_answered"), zero.alias("n_valid"), none.alias("level"), F.concat(*start(F.col("text")), *end).alias("message"))

    linked = rows.where(special).select("conv_id", "turn", "role", "text", F.xxhash64("conv_id", "turn", "role", "text").alias("row"))
    linked = scratch.table(linked, "linked")
    if linked.isEmpty():
        scratch.clear()
        return formatted
    again = linked.withColumn("parsed", F.try_parse_json("text")).withColumns({"made": made, "answers": answers})
    once = again.dropDuplicates(["row"])
    call = once.where("made IS NOT NULL").select("conv_id", "turn", "row", F.posexplode("made").alias("place", "call"))
    call = call.select(
        "conv_id", "turn", "row", "place",
        F.try_variant_get("call", "$.id", "string").alias("call_id"),
        F.try_variant_get("call", "$.name", "string").alias("name"),
        F.try_variant_get("call", "$.arguments", "variant").alias("arguments"),
        F.coalesce(F.try_variant_get("call", "$.after", "array<string>"), F.array().cast("array<string>")).alias("after"),
    )
    call = call.withColumn("valid", verdict(F.col("name"), F.col("arguments"), tools)).withColumn("arguments", F.coalesce(F.to_json("arguments"), F.lit("null")))
    call = scratch.table(call, "calls")
    first = call.where("call_id IS NOT NULL AND conv_id IS NOT NULL").groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "place", "row", "after")).alias("f"))
    first = first.select("conv_id", "call_id", F.col("f.row").alias("row"), F.col("f.place").alias("place"), F.col("f.after").alias("after"))
    depth = levels(scratch.table(first, "first"), scratch)
    results = once.where("answers IS NOT NULL").groupBy("conv_id", F.col("answers").alias("call_id")).agg(F.min(F.struct("turn", "row")).alias("r"))
    known = first.drop("after").join(depth, ["conv_id", "call_id"], "left").join(results.hint("shuffle_hash"), ["conv_id", "call_id"], "left")
    known = scratch.table(known.select("conv_id", "call_id", "row", "place", "level", F.col("r.row").alias("answer")), "known")
    own = call.join(known.select("row", "place", "level", "answer"), ["row", "place"], "left")
    status = F.when(F.col("valid") != "ok", F.col("valid")).when(F.col("answer").isNull(), "unanswered").otherwise("ok")
    text = F.concat(
        F.lit('{"arguments":'), F.col("arguments"), F.lit(',"id":'), json_string(F.col("call_id")), F.lit(',"name":'), json_string(F.col("name")), F.lit(',"status":'), json_string(status), F.lit("}"),
    )
    per_row = own.groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct(F.coalesce("level", F.lit(2**31 - 1)).alias("l"), "place", text.alias("t")))).alias("calls"),
        F.count("*").alias("n_calls"), F.count("answer").alias("n_answered"), F.count_if(F.col("valid") == "ok").alias("n_valid"), F.max("level").alias("own_level"),
    )
    answered = known.select("conv_id", F.col("call_id").alias("answers"), F.col("level").alias("its_level"), F.lit(True).alias("linked"))
    out = again.join(per_row, "row", "left").join(answered, ["conv_id", "answers"], "left")
    is_call = F.col("n_calls") > 0
    kind = F.when(is_call, "calls").when(F.col("linked"), "result").otherwise("orphan_result")
    content = F.try_variant_get("parsed", "$.content", "string")
    calls = F.concat(F.lit(',"tool_calls":['), F.array_join(F.transform("calls", lambda c: c["t"]), ","), F.lit("]"))
    name = F.concat(F.lit(',"tool_call_id":'), json_string(F.col("answers")))
    message = F.concat(*start(content), F.when(F.col("answers").isNotNull(), name).otherwise(F.lit("")), F.when(is_call, calls).otherwise(F.lit("")), *end)
    counts = [F.coalesce(x, zero).alias(x) for x in ("n_calls", "n_answered", "n_valid")]
    level = F.when(is_call, F.col("own_level")).otherwise(F.col("its_level"))
    done = scratch.result(out.select("conv_id", "turn", "role", kind.alias("kind"), *counts, level.cast("int").alias("level"), message.alias("message")))
    return formatted.union(done)


def with_made_calls(conversations: DataFrame) -> DataFrame:
    """The conversations, and made messages with calls and results, as the given ones hold none: by a fixed rule, from every turn.

    A user's turn makes two calls, the second after the first and the first after the user's turn before; some have a wrong argument,
    an unknown tool or wait for themselves. An assistant's turn makes a result of the first call of the turn before it.
    """
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    t, some = F.col("turn").cast("string"), json_string(F.substring(F.coalesce("text", F.lit("")), 1, 12))
    limit = F.when(F.col("turn") % 6 == 4, '"many"').otherwise(t)
    tool = F.when(F.col("turn") % 4 == 2, "clock").otherwise("weather")
    itself = F.when(F.col("turn") % 10 == 8, F.concat(F.lit(',"w'), t, F.lit('"'))).otherwise("")
    calls = F.concat(
        F.lit('{"content":"made","tool_calls":[{"id":"q'), t, F.lit('","name":"search","arguments":{"query":'), some, F.lit(',"limit":'), limit, F.lit('},"after":["w'), (F.col("turn") - 2).cast("string"),
        F.lit('"]},{"id":"w'), t, F.lit('","name":"'), tool, F.lit('","arguments":{"days":'), t, F.lit(',"city":'), some, F.lit('},"after":["q'), t, F.lit('"'), itself, F.lit("]}]}"),
    )
    result = F.concat(F.lit('{"tool_call_id":"q'), (F.col("turn") - 1).cast("string"), F.lit('","content":'), some, F.lit("}"))
    named = rows.where("turn IS NOT NULL")
    made = named.where("role = 'user'").select("conv_id", F.col("turn") + MADE, F.lit("assistant"), calls)
    return rows.union(made).union(named.where("role = 'assistant'").select("conv_id", F.col("turn") + MADE, F.lit("tool"), result))


#: Over with_made_calls: the rows are made, parsed, linked, ordered and validated in SQL.
SQL = r"""
WITH RECURSIVE rows AS (
  SELECT conv_id, CAST(turn AS BIGINT) AS turn, role, text FROM conversations
), cuts AS (SELECT *, CAST(to_json(substr(coalesce(text, ''), 1, 12)) AS VARCHAR) AS part FROM rows WHERE turn IS NOT NULL
), every AS (
  SELECT * FROM rows UNION ALL
  SELECT conv_id, turn + 1000000, 'assistant', '{"content":"made","tool_calls":[{"id":"q' || turn || '","name":"search","arguments":{"query":' || part || ',"limit":' || CASE WHEN turn % 6 = 4 THEN '"many"' ELSE CAST(turn AS VARCHAR) END
    || '},"after":["w' || (turn - 2) || '"]},{"id":"w' || turn || '","name":"' || CASE WHEN turn % 4 = 2 THEN 'clock' ELSE 'weather' END || '","arguments":{"days":' || turn || ',"city":' || part || '},"after":["q' || turn || '"'
    || CASE WHEN turn % 10 = 8 THEN ',"w' || turn || '"' ELSE '' END || ']}]}' FROM cuts WHERE role = 'user' UNION ALL
  SELECT conv_id, turn + 1000000, 'tool', '{"tool_call_id":"q' || (turn - 1) || '","content":' || part || '}' FROM cuts WHERE role = 'assistant'
), parsed AS (SELECT *, CASE WHEN starts_with(ltrim(coalesce(text, '')), '{') AND json_valid(text) THEN CAST(text AS JSON) END AS j FROM every
), marked AS (
  SELECT *, coalesce(json_array_length(j, '$.tool_calls'), 0) > 0 AS makes, CASE WHEN role = 'tool' THEN j ->> '$.tool_call_id' END AS answers FROM parsed
), calls AS (
  SELECT conv_id, turn, place, json_extract(j, '$.tool_calls[' || place || ']') AS c FROM (SELECT *, unnest(range(CAST(json_array_length(j, '$.tool_calls') AS BIGINT))) AS place FROM marked WHERE makes)
), call AS (SELECT DISTINCT conv_id, turn, place, c ->> '$.id' AS id, c ->> '$.name' AS name, c -> '$.arguments' AS args, CAST(c -> '$.after' AS VARCHAR[]) AS after FROM calls
), first AS (SELECT conv_id, id, min((turn, place)) AS at, arg_min(after, (turn, place)) AS after FROM call WHERE conv_id IS NOT NULL GROUP BY 1, 2
), edges AS (SELECT DISTINCT f.conv_id, f.id, p.id AS other FROM (SELECT conv_id, id, unnest(after) AS other FROM first) f JOIN first p ON p.conv_id = f.conv_id AND p.id = f.other
), above(conv_id, id, other) AS (SELECT * FROM edges UNION SELECT a.conv_id, a.id, e.other FROM above a JOIN edges e ON e.conv_id = a.conv_id AND e.id = a.other
), cyclic AS (SELECT conv_id, id FROM above WHERE id = other
), lost AS (SELECT conv_id, id FROM cyclic UNION SELECT a.conv_id, a.id FROM above a JOIN cyclic c ON c.conv_id = a.conv_id AND c.id = a.other
), steps(conv_id, id, level) AS (
  SELECT conv_id, id, 0 FROM first WHERE (conv_id, id) NOT IN (SELECT (conv_id, id) FROM edges)
  UNION SELECT e.conv_id, e.id, s.level + 1 FROM steps s JOIN edges e ON e.conv_id = s.conv_id AND e.other = s.id WHERE (e.conv_id, e.id) NOT IN (SELECT (conv_id, id) FROM lost)
), level AS (SELECT conv_id, id, max(level) AS level FROM steps GROUP BY 1, 2
), answered AS (SELECT DISTINCT conv_id, answers AS id FROM marked WHERE answers IS NOT NULL
), judged AS (
  SELECT c.*, f.at IS NOT NULL AND f.at = (c.turn, c.place) AS own, l.level, a.id IS NOT NULL AND f.at = (c.turn, c.place) AS has,
    CASE c.name WHEN 'search' THEN CASE WHEN len(list_filter(json_keys(args), lambda k: k NOT IN ('query', 'limit'))) = 0 AND json_type(args, '$.query') = 'VARCHAR' AND (json_type(args, '$.limit') IS NULL OR json_type(args, '$.limit') IN ('BIGINT', 'UBIGINT')) THEN 'ok' ELSE 'invalid' END
      WHEN 'weather' THEN CASE WHEN len(list_filter(json_keys(args), lambda k: k NOT IN ('city', 'days'))) = 0 AND json_type(args, '$.city') = 'VARCHAR' AND (json_type(args, '$.days') IS NULL OR json_type(args, '$.days') IN ('BIGINT', 'UBIGINT')) THEN 'ok' ELSE 'invalid' END
      WHEN 'calculator' THEN CASE WHEN json_keys(args) = ['expression'] AND json_type(args, '$.expression') = 'VARCHAR' THEN 'ok' ELSE 'invalid' END ELSE 'unknown_tool' END AS valid
  FROM call c LEFT JOIN first f ON f.conv_id = c.conv_id AND f.id = c.id LEFT JOIN level l ON l.conv_id = c.conv_id AND l.id = c.id AND f.at = (c.turn, c.place)
  LEFT JOIN answered a ON a.conv_id = c.conv_id AND a.id = c.id
), written AS (
  SELECT conv_id, turn, string_agg('{"arguments":{' || array_to_string(list_transform(list_sort(json_keys(args)), lambda k: '"' || k || '":' || CAST(json_extract(args, '$.' || k) AS VARCHAR)), ',') || '},"id":' || to_json(id) || ',"name":' || to_json(name)
      || ',"status":"' || CASE WHEN valid <> 'ok' THEN valid WHEN NOT has THEN 'unanswered' ELSE 'ok' END || '"}', ',' ORDER BY coalesce(level, 2147483647), place) AS calls,
    count(*) AS n_calls, count(*) FILTER (has) AS n_answered, count(*) FILTER (valid = 'ok') AS n_valid, max(level) AS level FROM judged GROUP BY 1, 2
)
SELECT m.conv_id, m.turn, m.role, CASE WHEN makes THEN 'calls' WHEN answers IS NULL THEN 'plain' WHEN f.id IS NULL THEN 'orphan_result' ELSE 'result' END AS kind,
  coalesce(n_calls, 0) AS n_calls, coalesce(n_answered, 0) AS n_answered, coalesce(n_valid, 0) AS n_valid, CAST(CASE WHEN makes THEN w.level ELSE l.level END AS INTEGER) AS level,
  '{"content":' || coalesce(CAST(to_json(CASE WHEN makes OR answers IS NOT NULL THEN j ->> '$.content' ELSE text END) AS VARCHAR), 'null') || ',"role":' || coalesce(CAST(to_json(m.role) AS VARCHAR), 'null')
    || CASE WHEN answers IS NOT NULL THEN ',"tool_call_id":' || to_json(answers) ELSE '' END || CASE WHEN makes THEN ',"tool_calls":[' || calls || ']' ELSE '' END || ',"turn":' || coalesce(CAST(m.turn AS VARCHAR), 'null') || '}' AS message
FROM marked m LEFT JOIN written w ON makes AND w.conv_id IS NOT DISTINCT FROM m.conv_id AND w.turn = m.turn
LEFT JOIN first f ON f.conv_id = m.conv_id AND f.id = answers LEFT JOIN level l ON l.conv_id = m.conv_id AND l.id = answers
"""
