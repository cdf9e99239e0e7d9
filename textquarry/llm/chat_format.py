"""Chat formatting with DataFrame functions only: tool calls linked to results, ordered, validated, canonical JSON.

A message whose text is a JSON object with ``tool_calls`` (a list of ``{"id", "name", "arguments", "after"}``) calls tools; a
message of role ``tool`` whose text is ``{"tool_call_id", "content"}`` answers one. Calls and results meet in an equi-join on
(conv_id, id); ``after`` lists calls whose results a call needs. Every message gets one row with its canonical JSON: keys
sorted, no white space, absent values left out, arguments parsed and written again from their typed form.

Order. Results depend on their call's message, and a call's message on the results of what its ``after`` names. Messages
that have such links settle in about as many rounds as the longest chain has binary digits. ``order_key`` sorts a conversation so
that everything follows what it depends on and otherwise keeps its turn; no conversation is gathered in one task. Links
that form a cycle keep their turn and say so.

``problems`` lists, sorted: ``bad_arguments`` (not an object, a missing, unknown or ill-typed argument), ``unknown_tool``,
``duplicate_id`` (a call's id occurs earlier in the conversation), ``unanswered`` (a call without a result), ``orphan_result``,
``repeated_result`` (a result for a call that an earlier row answers), ``cycle``.

Defined results: text that is no such JSON object is plain content; null texts have no content, null roles no role; a null
conv_id links nothing; repeated rows are rows of their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Tools and their arguments: name -> argument -> (type, required).
TOOLS: dict[str, dict[str, tuple[str, bool]]] = {
    "search": {"query": ("string", True), "limit": ("integer", False)},
    "calculator": {"expression": ("string", True), "precision": ("integer", False)},
    "weather": {"city": ("string", True), "units": ("string", False), "days": ("integer", False)},
    "run_code": {"language": ("string", True), "source": ("string", True), "timeout": ("number", False)},
    "read_file": {"path": ("string", True), "lines": ("array", False), "binary": ("boolean", False)},
}
_TYPES = {"string": "= 'STRING'", "integer": "= 'BIGINT'", "number": "RLIKE '^(BIGINT|DECIMAL|DOUBLE|FLOAT)'", "boolean": "= 'BOOLEAN'", "array": "LIKE 'ARRAY%'", "object": "LIKE 'OBJECT%'"}


def _arguments_fit(tools: dict[str, dict[str, tuple[str, bool]]]) -> Column:
    """Whether ``args`` (variant) is an object that the schema of ``name`` accepts; null for an unknown tool."""

    def quoted(text: str) -> str:
        return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"

    cases = []
    for name, schema in sorted(tools.items()):
        tests = [f"size(array_except(map_keys(from_json(to_json(args), 'map<string,string>')), array({', '.join(map(quoted, sorted(schema)))}))) = 0"]
        for arg, (kind, needed) in sorted(schema.items()):
            path = quoted(f"$['{arg}']")
            tests.append(f"coalesce(schema_of_variant(try_variant_get(args, {path}, 'variant')) {_TYPES[kind]}, {'false' if needed else 'true'})")
        cases.append(f"WHEN name = {quoted(name)} THEN schema_of_variant(args) LIKE 'OBJECT%' AND {' AND '.join(tests)}")
    return F.expr(f"CASE {' '.join(cases)} END") if cases else F.lit(None).cast("boolean")


def _plain(rows: DataFrame) -> DataFrame:
    return rows.select(
        "conv_id", "turn", "role", F.lit(0).alias("n_calls"), F.lit(0).alias("n_linked"), F.array().cast("array<string>").alias("problems"),
        _key(F.col("turn"), F.lit(0), F.col("turn")).alias("order_key"), F.to_json(F.struct(F.col("text").alias("content"), "role")).alias("json"),
    )


def _key(effective: Column, level: Column, turn: Column) -> Column:
    return F.format_string("%012d.%06d.%012d", F.coalesce(effective, F.lit(0)).cast("long"), level.cast("int"), F.coalesce(turn, F.lit(0)).cast("long"))


def _levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """rid, effective turn, level and whether it is on or behind a cycle, of ``nodes`` (rid, turn); in ``edges`` rid needs dep.

    A round folds what the last one settled into the edges that wait for it, settles the messages that wait for nothing more,
    and lets the rest look past every message that waits for one thing only. So a chain of n messages takes about log2(n)
    rounds, and a round reads and writes unsettled edges alone. ``w`` is an edge's length, ``m`` the latest turn on it.
    """
    edges = edges.where("rid <> dep").distinct().join(nodes.select("rid", "turn"), "rid")
    open_, path = common.stored(edges.select("rid", "turn", "dep", F.lit(1).cast("long").alias("w"), F.lit(None).cast("long").alias("m")), "chat-edges")
    linked, _ = common.stored(open_.select("rid").distinct(), "chat-linked")
    settled = nodes.join(open_.select(F.col("dep").alias("rid")).distinct(), "rid", "left_semi").join(linked, "rid", "left_anti")
    settled = settled.select("rid", F.col("turn").alias("effective"), F.lit(0).cast("long").alias("level"))
    done = []
    while True:
        met = open_.join(settled.select(F.col("rid").alias("dep"), "effective", "level"), "dep", "left")
        met = met.select("rid", "turn", F.expr("if(level is null, dep, null)").alias("dep"), F.expr("w + coalesce(level, 0L)").alias("w"), F.greatest("m", "effective").alias("m"))
        met, new = common.stored(met.groupBy("rid", "turn", "dep").agg(F.max("w").alias("w"), F.max("m").alias("m")), "chat-open")
        common.drop_path(nodes.sparkSession, path)
        per = met.groupBy("rid", "turn").agg(F.count("dep").alias("waits"), F.max("w").alias("w"), F.max("m").alias("m"), F.collect_list(F.struct("dep", "w", "m")).alias("ways"))
        settled, _ = common.stored(per.where("waits = 0").select("rid", F.greatest("turn", "m").alias("effective"), F.col("w").alias("level")), "chat-settled")
        if settled.isEmpty():
            return _settled(nodes, linked, done)
        done.append(settled)
        # The one thing that such a message waits for, and at most one row of what it no longer waits for.
        past = per.where("waits = 1").select(F.col("rid").alias("dep"), F.col("turn").alias("turn2"), "ways")
        rest = met.join(settled.select("rid"), "rid", "left_anti").join(past, "dep", "left")
        rest = rest.select("rid", "turn", F.expr("if(ways is null, array(struct(dep, w, m)), transform(ways, x -> struct(x.dep as dep, w + x.w as w, greatest(m, turn2, x.m) as m)))").alias("ways"))
        open_, path = common.stored(rest.select("rid", "turn", F.explode("ways").alias("x")).select("rid", "turn", "x.dep", "x.w", "x.m"), "chat-edges")
        common.drop_path(nodes.sparkSession, new)


def _settled(nodes: DataFrame, linked: DataFrame, done: list[DataFrame]) -> DataFrame:
    every = nodes.select("rid", F.col("turn").alias("effective"), F.lit(0).cast("long").alias("level")).join(linked, "rid", "left_anti")
    for part in done:
        every = every.unionByName(part)
    rows = nodes.select("rid", "turn").join(every, "rid", "left")
    return rows.select("rid", F.coalesce("effective", "turn").alias("effective"), F.coalesce("level", F.lit(0)).alias("level"), F.col("level").isNull().alias("cyclic"))


def formatted(messages: DataFrame, tools: dict[str, dict[str, tuple[str, bool]]] = TOOLS) -> DataFrame:
    """conv_id, turn, role, n_calls, n_linked, problems, order_key and json of every row of ``messages``."""
    rows = messages.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    maybe = F.expr("coalesce(role in ('assistant', 'tool') and startswith(ltrim(' \\t\\n\\r', text), '{') and (contains(text, '\"tool_calls\"') or contains(text, '\"tool_call_id\"')), false)")
    plain = rows.where(~maybe)

    body = rows.where(maybe).select(F.monotonically_increasing_id().alias("rid"), "*").withColumn("body", F.expr("try_parse_json(text)"))
    calls = F.expr("if(role = 'assistant', try_variant_get(body, '$.tool_calls', 'array<variant>'), null)")
    answers = F.expr("if(role = 'tool', try_variant_get(body, '$.tool_call_id', 'string'), null)")
    body, _ = common.stored(body.select("rid", "conv_id", "turn", "role", "text", calls.alias("calls"), answers.alias("answers"), F.expr("try_variant_get(body, '$.content', 'variant')").alias("content")), "chat-messages")
    plain = plain.unionByName(body.where("coalesce(size(calls), 0) <= 0 and answers is null").select("conv_id", "turn", "role", "text"))

    call = body.where("size(calls) > 0").select("rid", "conv_id", "turn", F.posexplode("calls").alias("pos", "c"))
    call = call.select(
        "rid", "conv_id", "turn", "pos", F.expr("try_variant_get(c, '$.id', 'string')").alias("id"), F.expr("try_variant_get(c, '$.name', 'string')").alias("name"),
        F.expr("try_variant_get(c, '$.after', 'array<string>')").alias("after"), F.expr("try_variant_get(c, '$.arguments', 'variant')").alias("raw"),
    )
    call = call.withColumn("args", F.expr("if(schema_of_variant(raw) = 'STRING', try_parse_json(variant_get(raw, '$', 'string')), raw)"))
    call = call.withColumn("fit", _arguments_fit(tools)).withColumn("known", F.col("name").isin(*tools) if tools else F.lit(False))
    result = body.where("answers is not null").select("rid", "conv_id", "turn", F.col("answers").alias("id"), "content")

    first_call = call.where("id is not null").groupBy("conv_id", "id").agg(F.min(F.struct("turn", "rid", "pos", "name")).alias("call"))
    first_result = result.groupBy("conv_id", "id").agg(F.min(F.struct("turn", "rid")).alias("result"))
    linked = call.join(first_call, ["conv_id", "id"], "left").join(first_result, ["conv_id", "id"], "left")
    primary = F.expr("coalesce(call.rid = rid and call.pos = pos, false)")
    linked = linked.withColumns({"answered": F.expr("result is not null") & primary, "duplicate": F.expr("id is not null") & ~primary})
    faults = F.array(
        F.when(~F.coalesce(F.col("known"), F.lit(False)), "unknown_tool"), F.when(F.col("known") & ~F.coalesce(F.col("fit"), F.lit(False)), "bad_arguments"),
        F.when(F.col("duplicate"), "duplicate_id"), F.when(~F.col("answered") & ~F.col("duplicate"), "unanswered"),
    )
    entry = F.struct(F.col("args").alias("arguments"), "id", "name")
    per_call = linked.groupBy("rid").agg(
        F.count("*").cast("int").alias("n_calls"), F.count_if("answered").cast("int").alias("n_linked"),
        F.flatten(F.collect_list(F.array_compact(faults))).alias("problems"), F.array_sort(F.collect_list(F.struct("pos", F.to_json(entry).alias("j")))).alias("entries"),
    )
    answer = result.join(first_call, ["conv_id", "id"], "left").join(first_result, ["conv_id", "id"], "left")
    faults = F.array(F.when(F.col("call").isNull(), "orphan_result"), F.when(F.col("call").isNotNull() & (F.expr("result.rid") != F.col("rid")), "repeated_result"))
    per_result = answer.select("rid", F.col("call.name").alias("name"), F.lit(0).alias("n_calls"), F.col("call").isNotNull().cast("int").alias("n_linked"), F.array_compact(faults).alias("problems"))

    needs = answer.where("call is not null").select("rid", F.col("call.rid").alias("dep"))
    wants = call.where("after is not null").select("rid", "conv_id", F.explode("after").alias("id")).join(first_result, ["conv_id", "id"]).select("rid", F.col("result.rid").alias("dep"))
    levels = _levels(body, needs.unionByName(wants))

    shared = body.join(levels.select("rid", "effective", "level", "cyclic"), "rid")
    as_call = shared.join(per_call, "rid").withColumn("json", _call_json())
    as_result = shared.join(per_result, "rid").withColumn("json", F.to_json(F.struct("content", "name", "role", F.col("answers").alias("tool_call_id"))))
    columns = ("conv_id", "turn", "role", "n_calls", "n_linked", "problems", "effective", "level", "cyclic", "json")
    tooled = as_call.select(*columns).unionByName(as_result.select(*columns))
    problems = F.array_sort(F.array_distinct(F.when(F.col("cyclic"), F.concat("problems", F.array(F.lit("cycle")))).otherwise(F.col("problems"))))
    tooled = tooled.select("conv_id", "turn", "role", "n_calls", "n_linked", problems.alias("problems"), _key(F.col("effective"), F.col("level"), F.col("turn")).alias("order_key"), "json")
    return _plain(plain).unionByName(tooled)


def _call_json() -> Column:
    """The message's keys in order; each call's text is canonical already."""
    content = F.coalesce(F.concat(F.lit('"content":'), F.to_json("content"), F.lit(",")), F.lit(""))
    return F.concat(F.lit("{"), content, F.lit('"role":"assistant","tool_calls":['), F.array_join(F.transform("entries", lambda e: e["j"]), ","), F.lit("]}"))


def tool_log(turns: DataFrame) -> DataFrame:
    """``turns`` read as a log of tools in use, as the table itself holds no calls: a user's turn calls a tool with its text,
    an assistant's turn is the result of the call before it.

    Seven of eight conversations are read so. Calls wait for the result of the call before; by rules on conv_id and turn some
    conversations wait for a later call or for themselves, some arguments are strings of JSON, broken, or not in the schema,
    some messages hold a second call, and some ids are repeated, unknown or answered twice. Rows, order and texts stay whole.
    """
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").withColumn("k", F.expr("conv_id + turn"))
    args = """CASE pmod(k, 6)
      WHEN 0 THEN to_json(struct(text as query, turn as limit)) WHEN 1 THEN to_json(struct(text as expression)) WHEN 2 THEN to_json(struct(turn as days, text as city))
      WHEN 3 THEN concat('{"timeout":', turn, '.5,', substr(to_json(struct(text as source, 'text' as language)), 2)) WHEN 4 THEN to_json(struct(text as path, array(turn) as lines, false as binary))
      ELSE to_json(struct(text)) END"""
    name = "element_at(array('search', 'calculator', 'weather', 'run_code', 'read_file', 'translate'), CAST(pmod(k, 6) AS INT) + 1)"
    given = """CASE pmod(k, 7) WHEN 1 THEN to_json(struct(args as a)) WHEN 3 THEN concat('{"extra":true,', substr(args, 2)) WHEN 5 THEN '"no object"' ELSE args END"""
    after = "CASE WHEN pmod(conv_id, 11) = 5 AND turn > 4 THEN turn WHEN pmod(conv_id, 9) = 4 AND turn < 2 THEN turn + 2 WHEN turn >= 2 THEN turn - 2 END"
    rows = rows.withColumn("args", F.expr(args)).withColumns({"given": F.expr(given), "name": F.expr(name), "after": F.expr(after)})
    rows = rows.withColumn("given", F.expr("if(pmod(k, 7) = 1, substr(given, 6, length(given) - 6), given)"))
    second = """if(pmod(turn, 4) = 2, concat(',{"id":"u', turn, '","name":"calculator","arguments":{"expression":"', turn, '","precision":2}}'), '')"""
    ident = "if(pmod(turn, 10) = 8, turn - 2, turn)"
    call = f"""concat('{{"tool_calls":[{{"id":"t', {ident}, '","name":"', name, '","after":[', coalesce(concat('"t', after, '"'), ''), '],"arguments":', given, '}}', {second}, ']}}')"""
    answer = """concat('{"tool_call_id":"', CASE WHEN pmod(k, 13) = 0 THEN 'x' ELSE 't' END, if(pmod(conv_id, 5) = 2 AND turn >= 3, turn - 3, turn - 1), '",', substr(to_json(struct(text as content, 0 as z)), 2))"""
    tooled = "role in ('user', 'assistant') and pmod(conv_id, 8) <> 7"
    text = F.expr(f"CASE WHEN not ({tooled}) THEN text WHEN role = 'user' THEN {call} ELSE {answer} END")
    role = F.expr(f"CASE WHEN not ({tooled}) THEN role WHEN role = 'user' THEN 'assistant' ELSE 'tool' END")
    return rows.select("conv_id", "turn", F.coalesce(role, F.col("role")).alias("role"), text.alias("text"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    log, _ = common.stored(tool_log(common.table(spark, sf_dir, "conversations")), "chat-log")
    return formatted(log).withColumn("problems", F.array_join("problems", ","))


ORACLE = """
WITH RECURSIVE c AS (SELECT conv_id, turn, conv_id + turn AS k, conv_id % 8 <> 7 AND role IN ('user', 'assistant') AS tooled, role AS was, text FROM conversations),
calls AS (SELECT conv_id, turn, 0 AS pos, 't' || CASE WHEN turn % 10 = 8 THEN turn - 2 ELSE turn END AS id,
    CASE k % 6 WHEN 0 THEN 'search' WHEN 1 THEN 'calculator' WHEN 2 THEN 'weather' WHEN 3 THEN 'run_code' WHEN 4 THEN 'read_file' ELSE 'translate' END AS name,
    't' || CASE WHEN conv_id % 11 = 5 AND turn > 4 THEN turn WHEN conv_id % 9 = 4 AND turn < 2 THEN turn + 2 WHEN turn >= 2 THEN turn - 2 END AS after,
    k % 6 < 5 AS known, k % 7 NOT IN (3, 5) AS fit, to_json(text)::VARCHAR AS js, k,
    CASE WHEN k % 7 = 3 THEN 'true' END AS extra
  FROM c WHERE tooled AND was = 'user'
  UNION ALL SELECT conv_id, turn, 1, 'u' || turn, 'calculator', NULL, true, true, '"' || turn || '"', NULL, NULL FROM c WHERE tooled AND was = 'user' AND turn % 4 = 2),
a AS (SELECT *, CASE WHEN k IS NULL THEN '{"expression":' || js || ',"precision":2}' WHEN k % 7 = 5 THEN NULL ELSE '{' || array_to_string(list_filter(
    CASE k % 6 WHEN 0 THEN [x, '"limit":' || turn, '"query":' || js] WHEN 1 THEN ['"expression":' || js, x] WHEN 2 THEN ['"city":' || js, '"days":' || turn, x]
      WHEN 3 THEN [x, '"language":"text"', '"source":' || js, '"timeout":' || turn || '.5'] WHEN 4 THEN ['"binary":false', x, '"lines":[' || turn || ']', '"path":' || js] ELSE [x, '"text":' || js] END, lambda v: v IS NOT NULL), ',') || '}' END AS args
  FROM (SELECT *, '"extra":' || extra AS x FROM calls)),
res AS (SELECT conv_id, turn, CASE WHEN k % 13 = 0 THEN 'x' ELSE 't' END || CASE WHEN conv_id % 5 = 2 AND turn >= 3 THEN turn - 3 ELSE turn - 1 END AS id, text FROM c WHERE tooled AND was = 'assistant'),
fc AS (SELECT conv_id, id, min(turn) AS turn, arg_min(pos, turn) AS pos, arg_min(name, turn) AS name FROM a GROUP BY 1, 2),
fr AS (SELECT conv_id, id, min(turn) AS turn FROM res GROUP BY 1, 2),
lc AS (SELECT a.*, fc.turn = a.turn AND fc.pos = a.pos AS main, fr.turn IS NOT NULL AND fc.turn = a.turn AND fc.pos = a.pos AS answered FROM a JOIN fc USING (conv_id, id) LEFT JOIN fr USING (conv_id, id)),
lr AS (SELECT res.*, fc.turn AS call, fc.name, fr.turn <> res.turn AS again FROM res LEFT JOIN fc USING (conv_id, id) JOIN fr USING (conv_id, id)),
dep AS (SELECT conv_id, turn, call AS dep FROM lr WHERE call IS NOT NULL UNION ALL SELECT a.conv_id, a.turn, fr.turn FROM a JOIN fr ON fr.conv_id = a.conv_id AND fr.id = a.after),
n AS (SELECT conv_id, count(*) AS n FROM c GROUP BY 1),
walk AS (SELECT conv_id, turn, turn AS at, turn AS high, 0 AS steps FROM c WHERE tooled
  UNION ALL SELECT w.conv_id, w.turn, d.dep, greatest(w.high, d.dep), w.steps + 1 FROM walk w JOIN dep d ON d.conv_id = w.conv_id AND d.turn = w.at JOIN n ON n.conv_id = w.conv_id WHERE w.steps <= n.n),
lev AS (SELECT conv_id, turn, max(steps) AS steps, max(high) AS high, max(steps) > any_value(n.n) AS cyclic FROM walk JOIN n USING (conv_id) GROUP BY 1, 2),
m AS (SELECT conv_id, turn, 'assistant' AS role, count(*) AS n_calls, count(*) FILTER (answered) AS n_linked,
    flatten(list([CASE WHEN NOT known THEN 'unknown_tool' END, CASE WHEN known AND NOT fit THEN 'bad_arguments' END, CASE WHEN NOT main THEN 'duplicate_id' END, CASE WHEN main AND NOT answered THEN 'unanswered' END])) AS problems,
    '{"role":"assistant","tool_calls":[' || string_agg('{' || coalesce('"arguments":' || args || ',', '') || '"id":"' || id || '","name":"' || name || '"}', ',' ORDER BY pos) || ']}' AS json
  FROM lc GROUP BY 1, 2
  UNION ALL SELECT conv_id, turn, 'tool', 0, (call IS NOT NULL)::INT, [CASE WHEN call IS NULL THEN 'orphan_result' WHEN again THEN 'repeated_result' END],
    '{"content":' || to_json(text) || ',' || coalesce('"name":"' || name || '",', '') || '"role":"tool","tool_call_id":"' || id || '"}' FROM lr)
SELECT conv_id, turn, was AS role, 0 AS n_calls, 0 AS n_linked, '' AS problems, printf('%012d.%06d.%012d', turn, 0, turn) AS order_key, CAST(to_json({'content': text, 'role': was}) AS VARCHAR) AS json FROM c WHERE NOT tooled
UNION ALL SELECT conv_id, turn, role, n_calls::INT, n_linked::INT, array_to_string(list_sort(list_distinct(list_filter(problems || [CASE WHEN cyclic THEN 'cycle' END], lambda p: p IS NOT NULL))), ','),
  printf('%012d.%06d.%012d', CASE WHEN cyclic THEN turn ELSE high END, CASE WHEN cyclic THEN 0 ELSE steps END, turn), json FROM m JOIN lev USING (conv_id, turn)
"""
