"""Tool-call linking for chat transcripts.

Calls and results meet in hash joins on (conversation, identifier), so no task holds a
conversation and a conversation of any length is only rows. Calls are put in topological order by
layers: a call's level is one more than the highest level of the calls it comes after. Chains of
calls with one predecessor are jumped along in doubling steps; then rounds go over the calls whose
predecessors are all known; what never becomes known is a cycle.
Arguments are checked against each tool's JSON schema and every event is written as canonical JSON
(keys sorted, no spaces, whole numbers without a fraction). Events sort by (conv_id, level, turn,
part).
"""

from __future__ import annotations

import json
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plumbline.llm.common import short_batches
from plumbline.plans.shared import drop_table, materialize, read_table, write_table

CALL_MARK = r"(?s)<tool_call>(.*?)</tool_call>"


def canonical(value) -> str:
    """Canonical JSON of a parsed value; text without a meaning in JSON (nan, infinities) is null."""

    def plain(x):
        if isinstance(x, dict):
            return {k: plain(v) for k, v in x.items()}
        if isinstance(x, list):
            return [plain(v) for v in x]
        if isinstance(x, float):
            return None if not math.isfinite(x) else int(x) if x == int(x) and abs(x) < 1 << 53 else x
        return x

    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


_KINDS = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def _is(value, kind: str) -> bool:
    if kind == "integer":
        return not isinstance(value, bool) and (isinstance(value, int) or isinstance(value, float) and value.is_integer())
    if kind == "number":
        return not isinstance(value, bool) and isinstance(value, (int, float))
    return kind in _KINDS and isinstance(value, _KINDS[kind])


def violations(value, schema: dict, at: str = "$") -> list[str]:
    """What of a JSON schema (type, enum, const, bounds, lengths, pattern, required, properties,
    additionalProperties, items, anyOf) the value breaks, as "path keyword", in a fixed order."""
    out = []
    kinds = schema.get("type")
    if kinds is not None and not any(_is(value, k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return [f"{at} type"]
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at} enum")
    if "const" in schema and value != schema["const"]:
        out.append(f"{at} const")
    if "anyOf" in schema and all(violations(value, s, at) for s in schema["anyOf"]):
        out.append(f"{at} anyOf")
    if _is(value, "number"):
        for word, bad in (("minimum", value < schema.get("minimum", value)), ("maximum", value > schema.get("maximum", value))):
            if bad:
                out.append(f"{at} {word}")
    if isinstance(value, (str, list)):
        low, high = ("minLength", "maxLength") if isinstance(value, str) else ("minItems", "maxItems")
        if len(value) < schema.get(low, 0):
            out.append(f"{at} {low}")
        if len(value) > schema.get(high, len(value)):
            out.append(f"{at} {high}")
    if isinstance(value, str) and "pattern" in schema and not re.search(schema["pattern"], value):
        out.append(f"{at} pattern")
    if isinstance(value, list) and "items" in schema:
        for k, item in enumerate(value):
            out += violations(item, schema["items"], f"{at}[{k}]")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k} required" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in known:
                out += violations(value[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{at}.{k} additionalProperties")
            elif isinstance(schema.get("additionalProperties"), dict):
                out += violations(value[k], schema["additionalProperties"], f"{at}.{k}")
    return out


def read_marked(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results written into messages (conv_id, turn, role, text): assistant texts hold
    ``<tool_call>{"id", "name", "arguments", "after"}</tool_call>``, texts of role "tool" are
    ``{"tool_call_id", "content"}``."""
    found = messages.filter("role = 'assistant'").select("conv_id", "turn", F.posexplode(F.regexp_extract_all("text", F.lit(CALL_MARK), F.lit(1))).alias("part", "body"))
    pick = lambda key: F.get_json_object("body", f"$.{key}")
    calls = found.select("conv_id", "turn", "part", pick("id").alias("call_id"), pick("name").alias("name"), pick("arguments").alias("arguments"), F.from_json(pick("after"), "array<string>").alias("after"))
    results = messages.filter("role = 'tool'").select("conv_id", "turn", F.get_json_object("text", "$.tool_call_id").alias("call_id"), F.get_json_object("text", "$.content").alias("content"))
    return calls, results


def read_turns(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Plain turns as calls of one tool, ``reply``: each user turn is a call that comes after the
    user turn before it and asks with its length in words and characters; the assistant turn next
    to it is its result."""
    name = lambda turn: F.concat(F.lit("t"), turn.cast("string"))
    turn = F.col("turn")
    words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != ""))
    text = F.coalesce("text", F.lit(""))
    calls = messages.filter("role = 'user'").select(
        "conv_id", "turn", F.lit(0).alias("part"), name(turn).alias("call_id"), F.lit("reply").alias("name"),
        F.to_json(F.struct(words.alias("words"), F.char_length(text).alias("characters"))).alias("arguments"), F.array(name(turn - 2)).alias("after"),
    )
    results = messages.filter("role = 'assistant'").select("conv_id", "turn", name(turn - 1).alias("call_id"), F.sha2(text, 256).alias("content"))
    return calls, results


def _chains(alone: DataFrame) -> DataFrame:
    """(conv_id, call_id, anchor, offset): calls with one predecessor, the call that their chain of
    such calls starts after, and how many steps back it is.

    ``alone``: (conv_id, call_id, before). Every round jumps over what the call jumped to has already
    jumped over, so a chain of n calls takes about log2(n) rounds. A round that settles none leaves
    only what hangs on a cycle; its anchors are then calls of ``alone`` themselves."""
    spark, own = alone.sparkSession, ["conv_id", "call_id"]
    ends = alone.select("conv_id", F.col("call_id").alias("before"), F.lit(True).alias("inner"))
    now = alone.join(ends, ["conv_id", "before"], "left").select(*own, F.col("before").alias("anchor"), F.lit(1).cast("long").alias("offset"), F.col("inner").isNull().alias("done"))
    schema, path, before = now.schema, write_table(now, "calls-chains"), None
    while True:
        now = read_table(spark, path, schema)
        left = now.filter("NOT done").count()
        if left == 0 or left == before:
            return now.drop("done")
        before = left
        there = now.select("conv_id", F.col("call_id").alias("anchor"), F.col("anchor").alias("far"), F.col("offset").alias("more"), F.col("done").alias("ended"))
        moved = now.filter("NOT done").join(there, ["conv_id", "anchor"]).select(*own, F.col("far").alias("anchor"), (F.col("offset") + F.col("more")).alias("offset"), F.col("ended").alias("done"))
        old, path = path, write_table(now.filter("done").unionByName(moved), "calls-chains")
        drop_table(spark, old)


def _levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level): calls without known predecessors have level 0; calls in or after a
    cycle are left out. Predecessors that no call has count for nothing.

    Chains are first shortened to their ends, so the rounds that follow are as many as calls with
    several predecessors come one after another."""
    spark, own = calls.sparkSession, ["conv_id", "call_id"]
    nodes = calls.select(*own)
    edges = calls.select(*own, F.explode("after").alias("before")).distinct()
    edges = materialize(edges.join(nodes.withColumnRenamed("call_id", "before"), ["conv_id", "before"], "left_semi"), "calls-edges")
    alone = edges.groupBy(*own).agg(F.count("*").alias("n"), F.min("before").alias("before")).filter("n = 1").select(*own, "before")
    alone = materialize(alone, "calls-alone")
    chains = _chains(alone)
    start = chains.select("conv_id", F.col("call_id").alias("before"), "anchor", "offset")
    merging = edges.join(alone.select(*own), own, "left_anti").join(start, ["conv_id", "before"], "left")
    left = materialize(merging.select(*own, F.coalesce("anchor", "before").alias("before"), (F.coalesce("offset", F.lit(0)) + 1).alias("step")), "calls-merging")
    done = nodes.join(edges, own, "left_anti").withColumn("level", F.lit(0).cast("long"))
    schema, path, before = done.schema, write_table(done, "calls-level"), None
    while True:
        known = read_table(spark, path, schema)
        now = left.count()
        if now == 0 or now == before:
            break
        before = now
        met = left.join(known.select("conv_id", F.col("call_id").alias("before"), F.col("level").alias("b")), ["conv_id", "before"], "left")
        met = met.groupBy(*own).agg(F.count_if(F.col("b").isNull()).alias("open"), F.max(F.col("b") + F.col("step")).alias("level"))
        new = materialize(met.filter("open = 0").select(*own, "level"), "calls-new")
        old, path = path, write_table(known.unionByName(new), "calls-level")
        left = materialize(left.join(new, own, "left_anti"), "calls-left")
        drop_table(spark, old)
    ends = known.select("conv_id", F.col("call_id").alias("anchor"), F.col("level").alias("b"))
    return known.unionByName(chains.join(ends, ["conv_id", "anchor"]).select(*own, (F.col("b") + F.col("offset")).alias("level")))


_OUT = "conv_id long, turn long, part int, kind string, call_id string, status string, level long, valid boolean, problems string, canonical string"


def _writer(tools: dict):
    def run(batches):
        for batch in batches:
            valid, problems, texts = [], [], []
            for r in batch.to_pylist():
                found, body = [], {"kind": r["kind"], "id": r["call_id"], "status": r["status"]}
                if r["kind"] == "call":
                    try:
                        arguments = json.loads(r["body"]) if r["body"] is not None else {}
                        found = violations(arguments, tools[r["name"]]) if r["name"] in tools else ["$ unknown tool"]
                    except ValueError:
                        arguments, found = r["body"], ["$ not JSON"]
                    body |= {"name": r["name"], "arguments": arguments}
                else:
                    body["content"] = r["body"]
                valid.append(not found if r["kind"] == "call" else None)
                problems.append("; ".join(found))
                texts.append(canonical(body))
            keep = [batch.column(batch.schema.names.index(n)) for n in ("conv_id", "turn", "part", "kind", "call_id", "status", "level")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(valid, pa.bool_()), pa.array(problems, pa.string()), pa.array(texts, pa.string())], [f.split()[0] for f in _OUT.split(", ")])

    return run


def link_calls(calls: DataFrame, results: DataFrame, tools: dict[str, dict]) -> DataFrame:
    """A row for each call and each result: its partner's status, level, validity, canonical JSON.

    ``calls``: (conv_id, turn, part, call_id, name, arguments, after); ``results``: (conv_id, turn,
    call_id, content). Of calls that share an identifier in a conversation the first by turn and
    part stands and the others are "repeated". A call is "linked" or "unanswered", or "cyclic" if it
    comes after itself; a result is "linked" or "orphan". A null identifier links nothing ("orphan"
    result, "unanswered" call of level 0). Nulls sort first; equal rows come back as often as given.
    """
    short_batches(calls.sparkSession)
    calls = materialize(calls.withColumn("conv_id", F.col("conv_id").cast("long")).withColumn("turn", F.col("turn").cast("long")), "calls")
    results = materialize(results.withColumn("conv_id", F.col("conv_id").cast("long")).withColumn("turn", F.col("turn").cast("long")), "calls-results")
    place = F.struct("turn", "part", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("arguments", F.lit("")).alias("arguments"), F.coalesce("after", F.array().cast("array<string>")).alias("after"))
    named = calls.filter("call_id is not null and conv_id is not null")
    first = materialize(named.groupBy("conv_id", "call_id").agg(F.min(place).alias("f")).select("conv_id", "call_id", "f.*"), "calls-first")
    levels = materialize(_levels(first), "calls-levels")
    answered = results.filter("call_id is not null").select("conv_id", "call_id").distinct().withColumn("answered", F.lit(True))
    facts = first.select("conv_id", "call_id", F.col("turn").alias("t0"), F.col("part").alias("p0")).join(levels, ["conv_id", "call_id"], "left").join(answered, ["conv_id", "call_id"], "left")
    facts = materialize(facts, "calls-facts")
    own = calls.join(facts, ["conv_id", "call_id"], "left")
    status = (
        F.when(F.col("call_id").isNull() | F.col("conv_id").isNull(), "unanswered")
        .when(~(F.col("turn").eqNullSafe(F.col("t0")) & F.col("part").eqNullSafe(F.col("p0"))), "repeated")
        .when(F.col("level").isNull(), "cyclic")
        .when(F.col("answered"), "linked")
        .otherwise("unanswered")
    )
    level = F.when(status == "cyclic", F.lit(None).cast("long")).otherwise(F.coalesce("level", F.lit(0)))
    one = own.select("conv_id", "turn", F.col("part").cast("int").alias("part"), F.lit("call").alias("kind"), "call_id", status.alias("status"), level.alias("level"), "name", F.col("arguments").alias("body"))
    back = results.join(facts.select("conv_id", "call_id", "level", "t0", F.lit(True).alias("met")), ["conv_id", "call_id"], "left")
    two = back.select("conv_id", "turn", F.lit(0).alias("part"), F.lit("result").alias("kind"), "call_id", F.when(F.col("met"), "linked").otherwise("orphan").alias("status"), "level", F.lit(None).cast("string").alias("name"), F.col("content").alias("body"))
    return one.unionByName(two).mapInArrow(_writer(tools), _OUT)


#: The tool that plain turns are read as.
REPLY = {"reply": {"type": "object", "required": ["words", "characters"], "additionalProperties": False, "properties": {"words": {"type": "integer", "minimum": 1, "maximum": 60}, "characters": {"type": "integer", "minimum": 1, "maximum": 400}}}}


def link_conversations(messages: DataFrame, tools: dict[str, dict] | None = None) -> DataFrame:
    """Links both the calls written into messages and the plain turns, see :func:`link_calls`."""
    messages = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    (calls, results), (turns, replies) = read_marked(messages), read_turns(messages)
    return link_calls(calls.unionByName(turns), results.unionByName(replies), REPLY | (tools or {}))


ORACLE_SQL = r"""
WITH RECURSIVE m AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
), u AS (
  SELECT conv_id, turn, min({'w': len(list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '')), 'c': length(text)}) AS f FROM m WHERE role = 'user' GROUP BY ALL
), lv AS (
  SELECT conv_id, turn, 0::BIGINT AS level FROM u a WHERE NOT EXISTS (SELECT 1 FROM u b WHERE b.conv_id = a.conv_id AND b.turn = a.turn - 2)
  UNION ALL
  SELECT u.conv_id, u.turn, lv.level + 1 FROM lv JOIN u ON u.conv_id = lv.conv_id AND u.turn = lv.turn + 2
), c AS (
  SELECT m.conv_id, m.turn, 'call' AS kind, 't' || m.turn AS call_id,
    CASE WHEN EXISTS (SELECT 1 FROM m r WHERE r.role = 'assistant' AND r.conv_id = m.conv_id AND r.turn = m.turn + 1) THEN 'linked' ELSE 'unanswered' END AS status,
    lv.level, len(list_filter(regexp_split_to_array(m.text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '')) AS w, length(m.text) AS n, NULL AS h
  FROM m JOIN lv USING (conv_id, turn) WHERE m.role = 'user'
), r AS (
  SELECT m.conv_id, m.turn, 'result' AS kind, 't' || (m.turn - 1) AS call_id, CASE WHEN lv.level IS NULL THEN 'orphan' ELSE 'linked' END AS status,
    lv.level, NULL AS w, NULL AS n, sha256(m.text) AS h
  FROM m LEFT JOIN lv ON lv.conv_id = m.conv_id AND lv.turn = m.turn - 1 WHERE m.role = 'assistant'
)
SELECT conv_id, turn, 0::INTEGER AS part, kind, call_id, status, level,
  CASE WHEN kind = 'call' THEN w BETWEEN 1 AND 60 AND n BETWEEN 1 AND 400 END AS valid,
  CASE WHEN kind = 'result' THEN '' ELSE concat_ws('; ', CASE WHEN n < 1 THEN '$.characters minimum' WHEN n > 400 THEN '$.characters maximum' END, CASE WHEN w < 1 THEN '$.words minimum' WHEN w > 60 THEN '$.words maximum' END) END AS problems,
  CASE WHEN kind = 'call' THEN '{"arguments":{"characters":' || n || ',"words":' || w || '},"id":"' || call_id || '","kind":"call","name":"reply","status":"' || status || '"}'
       ELSE '{"content":"' || h || '","id":"' || call_id || '","kind":"result","status":"' || status || '"}' END AS canonical
FROM (SELECT * FROM c UNION ALL SELECT * FROM r)
"""
