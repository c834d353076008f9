"""Chat formatting with linked tool calls.

Every turn of a conversation is one row.  Calls are read from a message (JSON ``tool_calls`` / ``function_call``, or
``<tool_call>{...}</tool_call>`` blocks), results from tool messages (JSON with ``tool_call_id``, or
``<tool_response>`` blocks).  Calls and results are joined by hash on (conversation, identifier).  A call's arguments
are validated against the schema of its function: the one its conversation declares (JSON ``tools`` / ``functions``, or a ``<tools>`` block with a JSON
list or one object a line), else the one given for that name.  A message lists its results after its calls, and calls after those whose results they
name (``depends_on``, or an argument ``{"$ref": id}``), by a topological order.  Each turn is serialised as canonical JSON:
keys sorted, no spaces, UTF-8 as it is, numbers as Python writes them.

The links are joins of call and result rows, so a conversation of any length is spread over tasks; only the calls of one *turn*
are ordered within a row.  Links do not depend on the order: a result may stand in the message or turn of its call, or in an earlier one;
each message stays in its turn.

Defined cases: null texts are the empty content, null roles ``"unknown"``; malformed JSON stays plain content; repeated turns and
repeated identifiers: the first call (by turn, then place) owns the identifier, later ones are ``duplicate``, and the first result from its turn on
answers it, else the first of all; a result without a call is ``orphan``, a call without a result ``unanswered``; cycles are cut at the smallest identifier; a
conversation without calls comes through unchanged; of several declarations of a function the first of the conversation (by turn, then place) counts for
all its calls; a declaration stays part of the content; a function that nobody declares is not validated; parts of a schema beyond the known ones
ask for nothing; half of a pair of surrogates is written as its escape; JSON nested too deep for Python is plain content; an empty table stays empty; other columns are not read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetflow.llm.tables import table

#: Schemas of known functions (JSON Schema subset: type, required, properties, enum, items); others are not validated.
Schemas = dict[str, dict]

NOT_JSON = "$: not JSON"
_BLOCK = re.compile(r"<(tool_call|tool_response)>(.*?)</\1>", re.S)
_HALF = re.compile("[\ud800-\udfff]")
_TOOLS = re.compile(r"<tools>(.*?)</tools>", re.S)
_TYPES = {"string": str, "boolean": bool, "object": dict, "array": list, "null": type(None)}

_ITEM = pa.struct([("kind", pa.string()), ("id", pa.string()), ("name", pa.string()), ("body", pa.string()), ("needs", pa.list_(pa.string())), ("valid", pa.bool_()), ("error", pa.string())])
ITEM = T.StructType([T.StructField(n, T.ArrayType(T.StringType()) if n == "needs" else T.BooleanType() if n == "valid" else T.StringType()) for n in ["kind", "id", "name", "body", "needs", "valid", "error"]])
_DECLARED = pa.struct([("name", pa.string()), ("schema", pa.string())])
DECLARED = T.StructType([T.StructField(n, T.StringType()) for n in ["name", "schema"]])
_TURN = pa.struct([("content", pa.string()), ("items", pa.list_(_ITEM)), ("declared", pa.list_(_DECLARED))])
TURN = T.StructType([T.StructField("content", T.StringType()), T.StructField("items", T.ArrayType(ITEM)), T.StructField("declared", T.ArrayType(DECLARED))])


def plain(text: str) -> str:
    """Half of a pair of surrogates has no UTF-8: it stands as its escape."""
    return _HALF.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def canonical(value: object) -> str:
    return plain(json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":")))


def load(text: str) -> object:
    try:
        return json.loads(text)
    except (ValueError, RecursionError):
        return None


def _is(value: object, kind: object) -> bool:
    if kind in ("integer", "number"):
        return isinstance(value, (int, float)) and not isinstance(value, bool) and (kind == "number" or isinstance(value, int) or value.is_integer())
    return isinstance(value, _TYPES.get(kind, object) if isinstance(kind, str) else object)


def _part(schema: dict, name: str, kind: type):
    """A part of a schema; one of another kind than it should be asks for nothing."""
    return schema[name] if isinstance(schema.get(name), kind) else kind()


def check(value: object, schema: object, at: str = "$") -> str:
    """The first violation of a schema, or the empty text."""
    if not isinstance(schema, dict):
        return ""
    kinds = schema.get("type")
    kinds = kinds if isinstance(kinds, list) else [kinds] if kinds else []
    if kinds and not any(_is(value, k) for k in kinds):
        return f"{at}: not {' or '.join(map(str, kinds))}"
    if isinstance(schema.get("enum"), list) and value not in schema["enum"]:
        return f"{at}: not in enum"
    if isinstance(value, dict):
        for name in _part(schema, "required", list):
            if isinstance(name, str) and name not in value:
                return f"{at}.{name}: missing"
        known = _part(schema, "properties", dict)
        for name in sorted(value):
            if name in known:
                if error := check(value[name], known[name], f"{at}.{name}"):
                    return error
            elif schema.get("additionalProperties") is False:
                return f"{at}.{name}: unknown"
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            if error := check(x, schema["items"], f"{at}[{i}]"):
                return error
    return ""


def references(value: object) -> set[str]:
    """Identifiers an argument refers to by ``{"$ref": id}``."""
    if isinstance(value, dict):
        own = {value["$ref"]} if set(value) == {"$ref"} and isinstance(value["$ref"], str) else set()
        return own.union(*[references(x) for x in value.values()])
    return set().union(*[references(x) for x in value]) if isinstance(value, list) else set()


def ordered(calls: list[dict]) -> list[dict]:
    """Topological order by ``needs``, the given order among free ones; a cycle is cut at its smallest identifier."""
    left, out, done = list(calls), [], set()
    inside = {c["id"] for c in calls}
    while left:
        free = [c for c in left if not (set(c["needs"]) & inside) - done - {c["id"]}]
        chosen = free[0] if free else min(left, key=lambda c: c["id"] or "")
        left.remove(chosen)
        done.add(chosen["id"])
        out.append(chosen)
    return out


def _call(raw: object, schemas: Schemas) -> dict | None:
    if not isinstance(raw, dict):
        return None
    inner = raw["function"] if isinstance(raw.get("function"), dict) else raw
    name, arguments = inner.get("name"), inner.get("arguments", inner.get("parameters", {}))
    if not isinstance(name, str):
        return None
    if isinstance(arguments, str):
        arguments = load(arguments)
    error = NOT_JSON if arguments is None else check(arguments, schemas[name]) if name in schemas else ""
    needs = references(arguments) | {x for x in raw.get("depends_on", []) if isinstance(x, str)} if isinstance(raw.get("depends_on", []), list) else references(arguments)
    return {"kind": "call", "id": str(raw["id"]) if raw.get("id") is not None else None, "name": name, "body": canonical(arguments), "needs": sorted(needs), "valid": not error, "error": error or None}


def _result(raw: object) -> dict | None:
    if not isinstance(raw, dict) or raw.get("tool_call_id", raw.get("id")) is None:
        return None
    body = raw.get("content", raw.get("result"))
    return {"kind": "result", "id": str(raw.get("tool_call_id", raw.get("id"))), "name": raw.get("name") if isinstance(raw.get("name"), str) else None, "body": canonical(body), "needs": [], "valid": True, "error": None}


def _tools(listed: object) -> list[dict]:
    """Declared functions as name and schema."""
    found = []
    for raw in listed if isinstance(listed, list) else []:
        inner = raw["function"] if isinstance(raw, dict) and isinstance(raw.get("function"), dict) else raw
        schema = next((inner[n] for n in ("parameters", "input_schema") if isinstance(inner.get(n), dict)), None) if isinstance(inner, dict) else None
        if schema is not None and isinstance(inner.get("name"), str):
            found.append({"name": plain(inner["name"]), "schema": canonical(schema)})
    return found


def declarations(text: str | None) -> list[dict]:
    """The functions that a message declares, in their order."""
    text = text or ""
    if text.lstrip()[:1] == "{":
        raw = load(text)
        if isinstance(raw, dict):
            return _tools(raw.get("tools")) + _tools(raw.get("functions"))
    found = []
    for block in _TOOLS.findall(text) if "<tools>" in text else []:
        raw = load(block)
        found += _tools(raw if isinstance(raw, list) else [raw] if isinstance(raw, dict) else [load(line) for line in block.splitlines()])
    return found


def parse(role: str | None, text: str | None, schemas: Schemas) -> dict:
    """The plain content of a message, and its calls and results as they stand in it."""
    text = text or ""
    items: list[dict] = []
    if text.lstrip()[:1] in ("{", "["):
        raw = load(text)
        if isinstance(raw, dict) and role == "tool" and (found := _result(raw)):
            return {"content": "", "items": [found]}
        listed = raw.get("tool_calls") if isinstance(raw, dict) else None
        if isinstance(raw, dict) and isinstance(raw.get("function_call"), dict):
            listed = [{"id": raw.get("id"), **raw["function_call"]}]
        if isinstance(listed, list) and listed and all(found := [_call(x, schemas) for x in listed]):
            return {"content": raw["content"] if isinstance(raw.get("content"), str) else "", "items": found}
    if "<tool_" not in text:
        return {"content": text, "items": []}

    def taken(m: re.Match) -> str:
        raw = load(m[2])
        found = _call(raw, schemas) if m[1] == "tool_call" else _result(raw)
        if found is None:
            return m[0]
        items.append(found)
        return ""

    content = _BLOCK.sub(taken, text)
    return {"content": content.strip() if items else content, "items": items}


def message(role: str | None, text: str | None, schemas: Schemas) -> dict:
    """A message's content, calls, results and declared functions; one that is nested too deep for Python is plain content."""
    try:
        read = {**parse(role, text, schemas), "declared": declarations(text)}
    except RecursionError:
        read = {"content": text, "items": [], "declared": []}
    clean = lambda x: {k: plain(v) if isinstance(v, str) else [plain(n) for n in v] if isinstance(v, list) else v for k, v in x.items()}
    return {**read, "content": plain(read["content"]), "items": [clean(x) for x in read["items"]]}


def parsed(turns: DataFrame, schemas: Schemas) -> DataFrame:
    """conv_id, turn, row (a hash of the message), role, content, items and declared functions of every message."""
    held = turns.sparkSession.sparkContext.broadcast(schemas)

    @F.arrow_udf(TURN)
    def read(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for roles, texts in batches:
            yield pa.array([message(r, t, held.value) for r, t in zip(roles.to_pylist(), texts.to_pylist())], _TURN)

    role = F.coalesce("role", F.lit("unknown"))
    # Different messages may share a turn; equal ones are one.
    row = F.xxhash64(role, "text")
    found = turns.select("conv_id", "turn", row.alias("row"), role.alias("role"), read(role, F.col("text")).alias("m"))
    return found.select("conv_id", "turn", "row", "role", "m.content", "m.items", "m.declared")


def links(messages: DataFrame) -> DataFrame:
    """One row per call or result: conv_id, turn, place, kind, id, name, body, valid, error, state, peer_turn.

    state: ``linked``, ``unanswered``, ``orphan`` or ``duplicate``.  Calls and results meet in a hash join on conversation and
    identifier; of the items of one identifier only a row of minima is kept, so a repeated identifier gathers nothing.
    """
    items = messages.select("conv_id", "turn", "row", F.posexplode("items").alias("place", "x")).select("conv_id", "turn", "row", "place", "x.*")
    where = F.struct("turn", "row", "place")
    key = ["conv_id", "id"]
    first = items.where((F.col("kind") == "call") & F.col("id").isNotNull()).groupBy(*key).agg(F.min(where).alias("call_at"))
    same = lambda a, b: a["conv_id"].eqNullSafe(b["_conv"]) & (a["id"] == b["_id"])
    first = first.select(F.col("conv_id").alias("_conv"), F.col("id").alias("_id"), "call_at")
    with_call = items.join(first, same(items, first), "left").drop("_conv", "_id")
    # Of several results the first from the call's turn on answers it, else the first of all.
    early = F.coalesce(F.col("turn") < F.col("call_at.turn"), F.lit(False))
    answers = with_call.where((F.col("kind") == "result") & F.col("call_at").isNotNull()).groupBy(*key).agg(F.min(F.struct(early.alias("early"), where.alias("at")))["at"].alias("result_at"))
    answers = answers.select(F.col("conv_id").alias("_conv"), F.col("id").alias("_id"), "result_at")
    both = with_call.join(answers, same(with_call, answers), "left").drop("_conv", "_id")
    state = (
        F.when((F.col("kind") == "call") & F.col("id").isNull(), "unanswered")
        .when((F.col("kind") == "call") & (where != F.col("call_at")), "duplicate")
        .when(F.col("kind") == "call", F.when(F.col("result_at").isNull(), "unanswered").otherwise("linked"))
        .when(F.col("call_at").isNull(), "orphan")
        .when(where != F.col("result_at"), "duplicate")
        .otherwise("linked")
    )
    peer = F.when(F.col("kind") == "call", F.col("result_at.turn")).otherwise(F.col("call_at.turn"))
    return both.withColumn("state", state).withColumn("peer_turn", F.when(F.col("state") == "linked", peer))


@lru_cache(maxsize=1_000)
def _loaded(schema: str) -> object:
    return load(schema)


def _violation(body: str, schema: str) -> str | None:
    try:
        return plain(check(json.loads(body), _loaded(schema))) or None
    except RecursionError:
        return "$: nested too deep"


def validated(items: DataFrame, messages: DataFrame) -> DataFrame:
    """The items, with ``valid`` and ``error`` of each call by the schema that its conversation declares for its function.

    Calls and declarations meet in a hash join on conversation and name; of the declarations of one name only the first is kept.
    """

    @F.arrow_udf(T.StringType())
    def violation(bodies: pa.Array, schemas: pa.Array) -> pa.Array:
        return pa.array([_violation(b, s) for b, s in zip(bodies.to_pylist(), schemas.to_pylist())], pa.string())

    each = messages.select("conv_id", "turn", "row", F.posexplode("declared").alias("place", "d"))
    first = each.groupBy(F.col("conv_id").alias("_conv"), F.col("d.name").alias("_name")).agg(F.min(F.struct("turn", "row", "place", "d.schema"))["schema"].alias("_schema"))
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("name") == F.col("_name")) & (F.col("kind") == "call")
    met = items.join(first, same, "left").drop("_conv", "_name")
    # Arguments that are not JSON have nothing to check.
    open_ = F.col("_schema").isNotNull() & ~F.col("error").eqNullSafe(NOT_JSON)
    # A row that has no schema gives the check the empty one.
    found = F.when(open_, violation("body", F.coalesce("_schema", F.lit("{}")))).otherwise(F.col("error"))
    return met.withColumn("error", found).withColumn("valid", F.when(F.col("kind") == "call", F.col("error").isNull()).otherwise(F.col("valid"))).drop("_schema")


def formatted(turns: DataFrame, schemas: Schemas | None = None) -> DataFrame:
    """One row per message: conv_id, turn, role, n_calls, n_results, n_linked, n_invalid, message (canonical JSON).

    ``schemas`` holds for functions that a conversation does not declare itself.
    """
    spark = turns.sparkSession
    messages = parsed(turns, schemas or {})

    @F.arrow_udf(T.StringType())
    def written(roles: pa.Array, contents: pa.Array, items: pa.Array) -> pa.Array:
        out = []
        for role, content, found in zip(roles.to_pylist(), contents.to_pylist(), items.to_pylist()):
            message: dict = {"role": role, "content": content}
            calls = ordered([x for x in found or [] if x["kind"] == "call"])
            results = [x for x in found or [] if x["kind"] == "result"]
            if calls:
                message["tool_calls"] = [{"id": x["id"], "name": x["name"], "arguments": json.loads(x["body"]), "state": x["state"], "valid": x["valid"], **({"error": x["error"]} if x["error"] else {})} for x in calls]
            if results:
                message["tool_results"] = [{"id": x["id"], "content": json.loads(x["body"]), "state": x["state"]} for x in results]
            out.append(canonical(message))
        return pa.array(out, pa.string())

    # The items of one message meet again; a message is one row of the input, so its size is bounded by that row.
    per_turn = validated(links(messages), messages).groupBy(F.col("conv_id").alias("_conv"), F.col("turn").alias("_turn"), F.col("row").alias("_row"))
    item = F.struct("place", "kind", "id", "name", "body", "needs", "state", "valid", "error")
    gathered = per_turn.agg(F.sort_array(F.collect_set(item)).alias("found"))
    calm = messages.select("conv_id", "turn", "row", "role", "content", F.size("items").alias("n"))
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & F.col("turn").eqNullSafe(F.col("_turn")) & (F.col("row") == F.col("_row"))
    joined = calm.join(gathered, (F.col("n") > 0) & same, "left")
    count = lambda test: F.coalesce(F.size(F.filter("found", test)), F.lit(0)).cast("long")
    none = F.when(F.col("found").isNotNull(), F.col("found")).otherwise(F.array().cast(gathered.schema["found"].dataType))
    return joined.withColumn("found", none).select(
        "conv_id",
        "turn",
        "role",
        count(lambda x: x["kind"] == "call").alias("n_calls"),
        count(lambda x: x["kind"] == "result").alias("n_results"),
        count(lambda x: x["state"] == "linked").alias("n_linked"),
        count(lambda x: ~x["valid"]).alias("n_invalid"),
        written("role", "content", "found").alias("message"),
    )


def conversations(messages: DataFrame) -> DataFrame:
    """The formatted messages numbered within their conversation by turn."""
    return messages.withColumn("number", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "message")))


def op2_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formatted(table(spark, sf_dir, "conversations"))


#: The same result in DuckDB's SQL for messages without calls (the given tables hold none).
ORACLE_SQL = """
SELECT conv_id, turn, coalesce(role, 'unknown') AS role, 0::BIGINT AS n_calls, 0::BIGINT AS n_results, 0::BIGINT AS n_linked, 0::BIGINT AS n_invalid,
       '{"content":' || to_json(coalesce(text, '')) || ',"role":' || to_json(coalesce(role, 'unknown')) || '}' AS message
FROM conversations
"""
