"""Chat formatting with tool-call linking, in DataFrame functions.

Input are messages ``conv_id, turn, role, text``. The text of an ``assistant`` message may be a
JSON object with ``tool_calls``, a list of ``{"id", "name", "arguments", "after"}``; that of a
``tool`` message an object with ``tool_call_id`` and ``content``. ``after`` names calls whose
results the call needs. ``schemas`` has a row for each parameter: ``tool, parameter, type,
required``.

- Calls and results are hash-joined by conversation and identifier. Of calls that share one
  identifier the first counts and the others are ``duplicate``; results without a call are
  ``orphan``, calls without a result ``open``.
- Order is topological: a call stands behind its message and behind the first result of every
  call it needs, a result behind its call. An event's ``level`` is the longest such path to it,
  its ``slot`` the latest turn on one; inside a conversation events are ordered by ``slot, level,
  turn, place``. Needs that name no call are left out. Calls on a cycle, and calls that need one,
  get no level and the status ``cycle``.
- Arguments are validated against the schemas: unknown tools and parameters, missing required
  ones, wrong types, and arguments that are no object.
- Every event is one canonical JSON text: keys in code order, no blanks, through VARIANT.

An event is a row, so a conversation of any length is never gathered in one task or one text.

Defined cases: a null or malformed text is an ordinary message with that text as content; a null
role is ``unknown``; repeated rows make repeated events, whose calls are duplicates; a null
conversation or turn is kept and links with nothing; other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pathweave.session import files_for, materialise

#: The parts of a call, and how VARIANT names the types of JSON schemas.
CALL = "array<struct<id:string,name:string,arguments:variant,after:array<string>>>"
TYPES = {
    "string": ("STRING",),
    "integer": ("BIGINT",),
    "number": ("BIGINT", "DOUBLE", "DECIMAL"),
    "boolean": ("BOOLEAN",),
    "object": ("OBJECT",),
    "array": ("ARRAY",),
}


def _kind(value: Column) -> Column:
    """The VARIANT type without its parameters."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def events_of(messages: DataFrame) -> DataFrame:
    """Messages, calls and results as rows with what links them."""
    parsed = messages.select(
        F.col("conv_id").cast("long"),
        F.col("turn").cast("long"),
        F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).withColumn(
        "json",
        F.when(
            F.col("role").isin("assistant", "tool") & F.col("text").rlike(r"^\s*\{"),
            F.try_parse_json("text"),
        ),
    )
    calls = F.try_variant_get("json", "$.tool_calls", CALL)
    is_call = (F.col("role") == "assistant") & (F.size(calls) > 0)
    result = F.try_variant_get("json", "$.tool_call_id", "string")
    is_result = (F.col("role") == "tool") & result.isNotNull()
    common = ["conv_id", "turn", "role"]
    nothing = {
        "id": F.lit(None).cast("string"), "name": F.lit(None).cast("string"),
        "arguments": F.lit(None).cast("variant"), "after": F.lit(None).cast("array<string>"),
    }
    content = F.coalesce(F.try_variant_get("json", "$.content", "string"), F.lit(""))
    plain = parsed.select(
        *common,
        F.lit(0).alias("place"),
        F.when(is_result, "result").otherwise("message").alias("kind"),
        F.when(is_result | is_call, content).otherwise(F.col("text")).alias("content"),
        *[(F.when(is_result, result) if n == "id" else c).alias(n) for n, c in nothing.items()],
    )
    called = (
        parsed.filter(is_call)
        .select(*common, F.posexplode(calls).alias("at", "call"))
        .select(
            *common,
            (F.col("at") + 1).alias("place"),
            F.lit("call").alias("kind"),
            F.lit("").alias("content"),
            "call.*",
        )
    )
    return plain.unionByName(called).withColumn("event", F.monotonically_increasing_id())


def linked(events: DataFrame, files: int | None = None) -> DataFrame:
    """Events with ``call`` (the event that a result belongs to, or a call itself) and ``status``."""
    calls = events.filter("kind = 'call'")
    # the first call of an identifier, combined before the shuffle
    first = calls.filter("id is not null").groupBy("conv_id", "id").agg(
        F.min(F.struct("turn", "place", "event")).alias("first")
    )
    first = materialise(
        first.select("conv_id", "id", F.col("first.event").alias("call")), "calls", files
    )
    answered = (
        events.filter("kind = 'result'").select("conv_id", "id").distinct()
        .join(first, ["conv_id", "id"]).select("call", F.lit(True).alias("answered"))
    )
    answered = materialise(answered, "answered", files)
    own = F.col("call") == F.col("event")
    return (
        events.join(first, ["conv_id", "id"], "left")
        .join(answered, "call", "left")
        .withColumn(
            "status",
            F.when(F.col("kind") == "message", "message")
            .when((F.col("kind") == "result") & F.col("call").isNull(), "orphan")
            .when(F.col("kind") == "result", "linked")
            .when(F.col("call").isNull(), "open")
            .when(~own, "duplicate")
            .when(F.col("answered").isNull(), "open")
            .otherwise("linked"),
        )
        .drop("answered")
    )


def call_levels(found: DataFrame, files: int | None = None) -> DataFrame:
    """``call, level, slot`` of each first call.

    Each round settles the calls whose needs are all settled, and lets a call that waits for one
    with a single need wait for that need instead, so a chain takes the logarithm of its length.
    What is not settled when a round settles nothing is on a cycle or needs one.
    """
    answers = found.filter("kind = 'result'").groupBy("call").agg(F.min("turn").alias("answered"))
    calls = (
        found.filter("kind = 'call' and call = event")
        .select("call", "conv_id", "id", "after", "turn")
        .join(answers, "call", "left")
    )
    calls = materialise(calls, "first", files)
    names = calls.select("conv_id", F.col("id").alias("need"), F.col("call").alias("source"))
    # a call stands ``add`` behind its source, and not before the turn ``floor``
    needs = (
        calls.filter(F.size("after") > 0)
        .select("call", "conv_id", F.explode(F.array_distinct("after")).alias("need"))
        .join(names, ["conv_id", "need"])
        .select("call", "source", F.lit(2).cast("long").alias("add"), F.lit(None).cast("long").alias("floor"))
    )
    needs = materialise(needs, "needs", files)
    settled = materialise(
        calls.join(needs.select("call").distinct(), "call", "left_anti").select(
            "call", F.lit(1).cast("long").alias("level"), F.col("turn").alias("slot"), "answered"
        ),
        "settled",
        files,
    )
    while not needs.isEmpty():
        known = settled.select(
            F.col("call").alias("source"), "level", F.greatest("slot", "answered").alias("since")
        )
        ready = (
            needs.join(known, "source", "left")
            .groupBy("call")
            .agg(
                F.max(F.col("level") + F.col("add")).alias("level"),
                F.max(F.greatest("since", "floor")).alias("since"),
                F.count(F.lit(1)).alias("n"),
                F.count("level").alias("have"),
            )
            .filter("n = have")
            .join(calls, "call")
            .select("call", "level", F.greatest("turn", "since").alias("slot"), "answered")
        )
        ready = materialise(ready, "ready", files)
        if ready.isEmpty():
            break
        settled = materialise(settled.unionByName(ready), "settled", files)
        waiting = materialise(needs.join(ready, "call", "left_anti"), "waiting", files)
        single = (
            waiting.groupBy(F.col("call").alias("source"))
            .agg(
                F.count(F.lit(1)).alias("n"), F.max("source").alias("over"),
                F.max("add").alias("more"), F.max("floor").alias("least"),
            )
            .filter("n = 1")
            .join(calls.select(F.col("call").alias("source"), "turn", "answered"), "source")
            .select("source", "over", "more", F.greatest("least", "turn", "answered").alias("least"))
        )
        needs = materialise(
            waiting.join(materialise(single, "single", files), "source", "left").select(
                "call",
                F.coalesce("over", "source").alias("source"),
                (F.col("add") + F.coalesce("more", F.lit(0))).alias("add"),
                F.greatest("floor", "least").alias("floor"),
            ),
            "needs",
            files,
        )
    return settled


def argument_errors(found: DataFrame, schemas: DataFrame) -> DataFrame:
    """``event, errors``: what is wrong with each call's arguments, sorted."""
    calls = found.filter("kind = 'call'").select("event", "name", "arguments")
    rules = schemas.select(
        F.col("tool").alias("name"), "parameter", F.col("type").alias("wanted"), "required"
    )
    tools = rules.groupBy("name").agg(
        F.collect_set(F.when(F.col("required"), F.col("parameter"))).alias("must"),
        F.map_from_entries(F.array_distinct(F.collect_list(F.struct("parameter", "wanted")))).alias("types"),
    )
    known = calls.join(tools, "name", "left").withColumn(
        "given",
        F.when(
            _kind(F.col("arguments")) == "OBJECT",
            F.try_variant_get("arguments", "$", "map<string,variant>"),
        ),
    )
    keys = F.map_keys("given")
    kinds = F.create_map(*[x for k, v in TYPES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])

    def check(key: Column) -> Column:
        wanted = F.element_at("types", key)
        kind = _kind(F.element_at("given", key))
        fits = F.coalesce(F.array_contains(F.element_at(kinds, wanted), kind), F.lit(False))
        return (
            F.when(wanted.isNull(), F.concat(F.lit("unknown "), key))
            .when(~fits, F.concat(F.lit("type "), key))
        )

    missing = F.transform(F.array_except("must", keys), lambda key: F.concat(F.lit("missing "), key))
    errors = (
        F.when(F.col("types").isNull(), F.array(F.lit("unknown tool")))
        .when(F.col("given").isNull(), F.array(F.lit("no object")))
        .otherwise(F.sort_array(F.concat(missing, F.array_compact(F.transform(keys, check)))))
    )
    return known.select("event", errors.alias("errors"))


def canonical(json: Column) -> Column:
    """JSON with keys in order and without blanks."""
    return F.to_json(F.parse_json(json))


def format_chats(messages: DataFrame, schemas: DataFrame) -> DataFrame:
    """``conv_id, slot, level, turn, place, kind, status, errors, json``: one row for each event."""
    events = materialise(events_of(messages), "events")
    few = files_for(events.count())
    found = materialise(linked(events, few), "linked", few)
    levels = call_levels(found, few)
    errors = argument_errors(found, schemas)
    joined = found.join(levels.drop("answered"), "call", "left").join(materialise(errors, "errors", few), "event", "left")
    joined = joined.coalesce(few)
    first = (F.col("kind") == "call") & (F.col("call") == F.col("event"))
    cyclic = F.col("call").isNotNull() & F.col("level").isNull() & (first | (F.col("kind") == "result"))
    level = (
        F.when(F.col("kind") == "message", 0)
        .when((F.col("kind") == "result") & F.col("call").isNotNull(), F.col("level") + 1)
        .when(F.col("kind") == "result", 0)
        .when(first, F.col("level"))
        .otherwise(1)
    )
    status = F.when(cyclic, "cycle").otherwise(F.col("status"))
    told = F.to_json(
        F.struct(
            "role", "kind",
            F.when(F.col("kind") != "call", F.col("content")).alias("content"),
            "id", "name", "after",
            status.alias("status"),
            F.when(F.size("errors") > 0, F.col("errors")).alias("errors"),
        )
    )
    # arguments are joined as JSON text, as they may be anything
    whole = F.when(
        F.col("arguments").isNotNull(),
        F.concat(
            F.lit('{"arguments":'), F.to_json("arguments"), F.lit(","), F.substr(told, F.lit(2), F.length(told))
        ),
    ).otherwise(told)
    return joined.select(
        "conv_id",
        F.when(F.col("kind") == "message", F.col("turn")).otherwise(F.greatest("turn", "slot")).alias("slot"),
        level.cast("long").alias("level"), "turn", F.col("place").cast("long").alias("place"),
        "kind", status.alias("status"),
        F.concat_ws(",", F.coalesce("errors", F.array().cast("array<string>"))).alias("errors"),
        canonical(whole).alias("json"),
    )
