"""Chat formatting: tool calls linked to results, checked, ordered and serialised.

Messages are rows (conv_id, turn, role, text).  An assistant text that is a
JSON object with ``tool_calls`` holds calls ``{"id", "name", "arguments",
"depends_on"}`` beside its ``content``; a text of the role tool or function is
``{"tool_call_id", "content"}``.  Anything else is plain content.

Every message, call and result becomes one row with canonical JSON (sorted
keys, no blanks) and an order key, so that no conversation is ever gathered in
one task: sorting by (conv_id, anchor, level, turn, item) gives the training
order, in which a result follows its call and a call what it depends on.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small, written

CALLS = "struct<content:string,tool_calls:array<struct<id:string,name:string,arguments:variant,depends_on:array<string>>>>"
RESULT = "struct<tool_call_id:string,content:variant>"
TOOLS = "struct<tools:array<struct<name:string,parameters:struct<properties:map<string,struct<type:string>>,required:array<string>>>>>"
#: Tables that placed calls are kept in before they become one.
PILES = 16
#: Type names of schemas, and the pattern of the variant types they allow.
TYPES = {"string": "STRING", "integer": "BIGINT", "number": "(BIGINT|DECIMAL.*|DOUBLE|FLOAT)", "boolean": "BOOLEAN", "array": "ARRAY<.*>", "object": "OBJECT<.*>", "null": "VOID"}


def _json(fields: Column) -> Column:
    return F.to_json(fields, {"ignoreNullFields": "false"})


def _violations(arguments: Column, parameters: Column) -> Column:
    """Violations of the schema (name, type, required): missing, unknown and mistyped parameters, sorted."""
    known = F.transform(parameters, lambda p: p["name"])
    missing = F.transform(F.filter(parameters, lambda p: p["required"] & F.coalesce(~F.array_contains(F.map_keys(arguments), p["name"]), F.lit(True))), lambda p: F.concat(F.lit("missing:"), p["name"]))
    unknown = F.transform(F.array_except(F.map_keys(arguments), known), lambda n: F.concat(F.lit("unknown:"), n))
    allowed = F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair])
    wrong = F.transform(
        F.filter(parameters, lambda p: F.array_contains(F.map_keys(arguments), p["name"]) & ~F.coalesce(F.rlike(F.schema_of_variant(F.element_at(arguments, p["name"])), F.concat(F.lit("^"), F.coalesce(F.element_at(allowed, p["type"]), F.lit(".*")), F.lit("$"))), F.lit(False))),
        lambda p: F.concat(F.lit("type:"), p["name"]),
    )
    return F.array_sort(F.concat(missing, unknown, wrong))


def _joined_up(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def _placed(calls: DataFrame, needs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, call_id, at) of the calls placed after all their needs, and the calls that never are.

    A round places the calls whose last need the round before placed; there are
    as many rounds as the longest chain has calls.
    """
    keys = ["conv_id", "call_id"]
    start = calls.join(needs.groupBy(*keys).agg(F.count("*").alias("missing")), keys, "left")
    state = written(start.select(*keys, F.struct(F.col("turn").alias("anchor"), F.lit(0).alias("level")).alias("at"), F.coalesce("missing", F.lit(0)).alias("missing")), "chat-levels")
    piles = []
    while True:
        front, waiting = state.where("missing = 0"), state.where("missing > 0")
        piles.append(front)
        sizes = state.agg(F.count_if(F.col("missing") == 0).alias("front"), F.count_if(F.col("missing") > 0).alias("waiting")).first()
        if not sizes.front or not sizes.waiting:
            return _joined_up(piles).select(*keys, "at"), waiting.select(*keys)
        if len(piles) > PILES:
            piles = [written(_joined_up(piles), "chat-placed")]
        of = front.select("conv_id", F.col("call_id").alias("need"), F.struct(F.col("at.anchor").alias("anchor"), (F.col("at.level") + 2).alias("level")).alias("after"))
        met = needs.join(of, ["conv_id", "need"]).groupBy(*keys).agg(F.max("after").alias("after"), F.count("*").alias("met"))
        state = written(waiting.join(met, keys, "left").select(*keys, F.greatest("at", F.coalesce("after", "at")).alias("at"), (F.col("missing") - F.coalesce("met", F.lit(0))).alias("missing")), "chat-levels")


def _circles(needs: DataFrame) -> DataFrame:
    """(conv_id, call_id, circle) of the calls that can reach themselves, ``circle`` being the same for those that reach each other.

    Every call takes the least name that it can reach; of the calls with one
    name, those that its bearer reaches are its circle.  They are taken out and
    the rest goes on.  Nothing is held but a row per call.
    """
    keys, found = ["conv_id", "call_id"], []
    while not needs.isEmpty():
        nodes = needs.select(*keys).union(needs.select("conv_id", "need")).distinct()
        named = written(nodes.withColumn("name", F.col("call_id")), "chat-names")
        while True:
            of = named.select("conv_id", F.col("call_id").alias("need"), F.col("name").alias("theirs"))
            least = needs.join(of, ["conv_id", "need"]).groupBy(*keys).agg(F.min("theirs").alias("theirs"))
            told = named.join(least, keys, "left").select(*keys, F.least("name", F.coalesce("theirs", "name")).alias("name"), (F.col("theirs") < F.col("name")).alias("changed"))
            told = written(told, "chat-names")
            named = told.drop("changed")
            if told.where("changed").isEmpty():
                break
        own = named.select("conv_id", F.col("call_id").alias("need"), F.col("name").alias("theirs"))
        within = written(needs.join(named, keys).join(own, ["conv_id", "need"]).where("name = theirs").select(*keys, "need", "name"), "chat-names")
        reached = written(named.where("call_id = name"), "chat-circles")
        front = reached
        while not front.isEmpty():
            ahead = within.join(front.select(*keys), keys).select("conv_id", F.col("need").alias("call_id"), "name").distinct()
            front = written(ahead.join(reached.select(*keys), keys, "left_anti"), "chat-circles")
            reached = written(reached.unionByName(front), "chat-circles")
        many = reached.groupBy("conv_id", "name").count().where("count > 1").drop("count")
        found.append(reached.join(many, ["conv_id", "name"]).select(*keys, F.col("name").alias("circle")))
        gone = reached.select(*keys)
        needs = written(needs.join(gone, keys, "left_anti").join(gone.withColumnRenamed("call_id", "need"), ["conv_id", "need"], "left_anti").select(*keys, "need"), "chat-needs")
    return written(_joined_up(found), "chat-circles")


def _levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, anchor, level, cyclic): a call comes after all that it depends on.

    Within a circle no order is right: the needs that calls of one circle have
    of each other are left out, and what depends on a circle comes after it.
    """
    keys = ["conv_id", "call_id"]
    named = calls.select(*keys, "turn", F.explode(F.array_distinct("depends_on")).alias("need")).where("need is not null and need <> call_id")
    needs = written(named.join(calls.select("conv_id", F.col("call_id").alias("need")), ["conv_id", "need"], "left_semi").select(*keys, "need"), "chat-needs")
    if needs.isEmpty():
        return calls.select(*keys, F.col("turn").alias("anchor"), F.lit(0).alias("level"), F.lit(False).alias("cyclic"))
    placed, stuck = _placed(calls, needs)
    if stuck.isEmpty():
        return placed.select(*keys, "at.anchor", "at.level", F.lit(False).alias("cyclic"))
    of_stuck = needs.join(stuck, keys, "left_semi").join(stuck.select("conv_id", F.col("call_id").alias("need")), ["conv_id", "need"], "left_semi")
    circles = _circles(written(of_stuck.select(*keys, "need"), "chat-needs"))
    same = needs.join(circles, keys).join(circles.select("conv_id", F.col("call_id").alias("need"), F.col("circle").alias("theirs")), ["conv_id", "need"]).where("circle = theirs")
    placed, _ = _placed(calls, written(needs.join(same.select(*keys, "need"), [*keys, "need"], "left_anti"), "chat-needs"))
    marked = circles.select(*keys, F.lit(True).alias("cyclic"))
    return placed.join(marked, keys, "left").select(*keys, "at.anchor", "at.level", F.coalesce("cyclic", F.lit(False)).alias("cyclic"))


def tool_definitions(messages: DataFrame) -> DataFrame:
    """(conv_id, tool, name, type, required): the parameters of the tools that system messages define.

    Such a message is a JSON object with ``tools`` of ``name`` and
    ``parameters``, which has ``properties`` (each with a ``type``) and
    ``required``.  A tool without parameters has one row with a null name;
    several definitions of a tool in a conversation count together.
    """
    text = F.col("text").cast("string")
    told = messages.where((F.col("role") == "system") & F.ltrim(text).startswith("{") & text.contains('"tools"')).select("conv_id", F.explode(F.from_json(text, TOOLS)["tools"]).alias("t"))
    told = told.where("t.name is not null").select("conv_id", F.col("t.name").alias("tool"), F.coalesce("t.parameters.properties", F.from_json(F.lit("{}"), "map<string,struct<type:string>>")).alias("known"), F.coalesce("t.parameters.required", F.array().cast("array<string>")).alias("needed"))
    named = told.select("conv_id", "tool", "known", "needed", F.explode_outer(F.array_union(F.map_keys("known"), "needed")).alias("name"))
    return named.select("conv_id", "tool", "name", F.element_at("known", F.col("name"))["type"].alias("type"), F.coalesce(F.array_contains("needed", F.col("name")), F.lit(False)).alias("required"))


def format_chat(messages: DataFrame, schemas: DataFrame | None = None) -> DataFrame:
    """One row per message, call and result of ``messages``.

    ``schemas`` (tool, name, type, required) describes the tools' parameters;
    calls of tools that it doesn't name are not checked; with a conv_id it
    describes those of that conversation only.  Returns conv_id, turn,
    item (place within the turn), kind, role, call_id, anchor, level, status,
    violations and json.  Status: plain; linked, unanswered or cyclic (calls);
    linked, early (before its call) or orphan (results).  A call id that repeats
    within a conversation means its first call; a null id links nothing.  Null
    and empty texts are content as they are; a text that is no valid JSON of the
    above form is plain content; a call's need of itself or of no call counts for
    nothing, and only calls that need themselves through others are cyclic;
    repeated rows each give a row; an empty table
    gives none; a null role or conv_id is kept; other columns are ignored.
    """
    rows = messages.select("conv_id", "turn", "role", F.col("text").cast("string").alias("text"))
    object_like = F.ltrim("text").startswith("{")
    parsed = rows.withColumn("call", F.when((F.col("role") == "assistant") & object_like & F.col("text").contains('"tool_calls"'), F.from_json("text", CALLS)))
    parsed = parsed.withColumn("result", F.when(F.col("role").isin("tool", "function") & object_like, F.from_json("text", RESULT)))
    has_calls, has_result = F.coalesce(F.size("call.tool_calls") > 0, F.lit(False)), F.col("result.tool_call_id").isNotNull()

    own = F.array(F.struct(F.lit(0).alias("item"), F.when(has_result, "result").otherwise("message").alias("kind"), F.when(has_result, F.col("result.tool_call_id")).alias("call_id"), F.lit(None).cast("string").alias("name"), F.when(has_result, F.col("result.content")).alias("value"), F.lit(None).cast("array<string>").alias("depends_on")))
    calls = F.transform("call.tool_calls", lambda c, i: F.struct((i + 1).alias("item"), F.lit("call").alias("kind"), c["id"].alias("call_id"), c["name"].alias("name"), c["arguments"].alias("value"), c["depends_on"].alias("depends_on")))
    events = parsed.select("conv_id", "turn", "role", F.when(has_calls, F.col("call.content")).otherwise(F.col("text")).alias("content"), F.explode(F.when(has_calls, F.concat(own, calls)).otherwise(own)).alias("e")).select("conv_id", "turn", "role", "content", "e.*")

    linked = events.where("call_id is not null")
    first = linked.where("kind = 'call'").groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "item", "depends_on")).alias("c")).select("conv_id", "call_id", "c.*")
    answered = linked.where("kind = 'result'").groupBy("conv_id", "call_id").agg(F.max("turn").alias("answer_turn"))
    # one row per call id on this side: the joins below add no rows
    known = _levels(first).join(first.select("conv_id", "call_id", F.col("turn").alias("call_turn")), ["conv_id", "call_id"]).join(answered, ["conv_id", "call_id"], "left").withColumnRenamed("conv_id", "k_conv").withColumnRenamed("call_id", "k_call")
    joined = events.join(known, (F.col("conv_id") == F.col("k_conv")) & (F.col("call_id") == F.col("k_call")), "left")

    if schemas is not None:
        own_tools = "conv_id" in schemas.columns
        tools = schemas.groupBy(F.col("tool").alias("t_name"), *[F.col("conv_id").alias("t_conv")] * own_tools)
        tools = tools.agg(F.collect_set(F.when(F.col("name").isNotNull(), F.struct("name", "type", F.coalesce("required", F.lit(False)).alias("required")))).alias("parameters"))
        of = F.col("name") == F.col("t_name")
        joined = joined.join(small(tools), of & F.col("conv_id").eqNullSafe(F.col("t_conv")) if own_tools else of, "left")
        arguments = F.from_json(F.to_json("value"), "map<string,variant>")
        checked = F.when(F.col("parameters").isNotNull(), F.when(F.coalesce(F.schema_of_variant("value"), F.lit("VOID")).startswith("OBJECT"), _violations(arguments, F.col("parameters"))).otherwise(F.array(F.lit("arguments:not an object"))))
    else:
        checked = F.lit(None)
    is_call, is_result = F.col("kind") == "call", F.col("kind") == "result"
    status = F.when(is_call & F.col("cyclic"), "cyclic").when(is_call & (F.col("answer_turn") >= F.col("call_turn")), "linked").when(is_call, "unanswered")
    status = status.when(is_result & F.col("call_turn").isNull(), "orphan").when(is_result & (F.col("turn") < F.col("call_turn")), "early").when(is_result, "linked").otherwise("plain")
    text = F.when(is_call, _json(F.struct(F.col("value").alias("arguments"), F.col("call_id").alias("id"), F.col("name").alias("name"), F.lit("tool_call").alias("type"))))
    text = text.when(is_result, _json(F.struct(F.col("value").alias("content"), F.col("role").alias("role"), F.col("call_id").alias("tool_call_id")))).otherwise(_json(F.struct(F.col("content").alias("content"), F.col("role").alias("role"))))
    return joined.select(
        "conv_id", "turn", "item", "kind", "role", "call_id",
        F.when(is_call | is_result, F.coalesce("anchor", "turn")).otherwise(F.col("turn")).alias("anchor"),
        F.when(is_call, F.coalesce(F.col("level") + 1, F.lit(1))).when(is_result, F.coalesce(F.col("level") + 2, F.lit(0))).otherwise(F.lit(0)).alias("level"),
        status.alias("status"), F.coalesce(checked.cast("array<string>"), F.array().cast("array<string>")).alias("violations"), text.alias("json"),
    )
