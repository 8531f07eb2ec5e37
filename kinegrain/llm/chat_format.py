"""Chat formatting with tool-call linking, in DataFrame functions only.

An assistant's message may be a JSON object with ``tool_calls``: a list of
``{"id", "name", "arguments"}``; a tool's message a JSON object with
``tool_call_id`` and ``content``. Calls and results meet in a hash join by
conversation and identifier. A call that has ``"$<id>"`` among its argument values
needs that call's result first: its level is one above its needs' highest, found by
joins (call_levels); calls in a cycle keep a null level. Arguments
are validated against the tools' schemas (required, known, typed properties), and
every message becomes canonical JSON: sorted keys, no spaces, arguments parsed.

Rows stay rows: a message's place in its conversation is (order_turn, order_level,
turn), so no conversation, however long, is gathered in one task.

Defined cases: null text is null content; a null role is null in the JSON; text that
isn't such JSON is plain content; a result without a call, or with a null id, is kept
and counts as an error; a call without a result has a null result; of calls with one
identifier in one conversation the first by turn and place is linked, the others are
marked ``duplicate_id``; a result before its call is ordered right after it; repeated
rows give repeated rows; messages of a null conv_id are one conversation, and a null turn comes before
others; of tools of one name the first by its schema's JSON counts; arguments that aren't
JSON need nothing; very long texts are taken whole; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checked_broadcast, discard, stored

CALLS = "content string, tool_calls array<struct<id:string,name:string,arguments:string>>"
RESULT = "tool_call_id string, content string"
#: In parsed and printed arguments, a string value (no key, and no part of another string) that names a call.
NEED = r'(?<!\\)"\$([^"\\]+)"(?!:)'
#: JSON schema types and the names that values of them have.
TYPES = {
    "string": "STRING", "integer": "BIGINT", "number": "BIGINT|DOUBLE|FLOAT|DECIMAL.*", "boolean": "BOOLEAN",
    "array": "ARRAY.*", "object": "OBJECT.*", "null": "VOID",
}


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def argument_errors(arguments: Column, known: Column, required: Column, types: Column) -> Column:
    """Array of errors of a call's arguments; known is null for an unknown tool."""
    parsed = F.from_json(arguments, "map<string,variant>")
    kinds = F.transform_values(parsed, lambda k, v: F.schema_of_variant(v))
    names = F.map_keys(kinds)
    patterns = F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv])
    missing = F.transform(F.array_sort(F.array_except(required, names)), lambda n: F.concat(F.lit("missing:"), n))
    unknown = F.transform(F.array_sort(F.array_except(names, F.map_keys(types))), lambda n: F.concat(F.lit("unknown:"), n))
    wrong = F.filter(F.array_sort(F.array_intersect(names, F.map_keys(types))), lambda n: ~F.call_function("rlike", F.element_at(kinds, n), F.concat(F.lit("^("), F.coalesce(F.element_at(patterns, F.element_at(types, n)), F.lit(".*")), F.lit(")$"))))
    return (
        F.when(known.isNull(), F.array(F.lit("unknown_tool")))
        .when(parsed.isNull(), F.array(F.lit("not_an_object")))
        .otherwise(F.concat(missing, unknown, F.transform(wrong, lambda n: F.concat(F.lit("type:"), n))))
    )


def _chain_ends(single: DataFrame) -> DataFrame:
    """(conv_id, id, to, dist) of calls with one need (conv_id, id, need): the end of their chain of such calls, by pointers that double.

    Calls in cycles of such calls, or above one, have no end and are left out.
    """
    jumps = stored(single.select("conv_id", "id", F.col("need").alias("to"), F.lit(1).cast("long").alias("dist"), F.lit(True).alias("open")), "jumps")
    longest = jumps.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
    for _ in range(longest.bit_length() + 1):
        if jumps.where("open").isEmpty():
            break
        ahead = jumps.select("conv_id", F.col("id").alias("to"), F.col("to").alias("to2"), F.col("dist").alias("dist2"), F.lit(True).alias("more"))
        far = jumps.where("open").join(ahead, ["conv_id", "to"], "left")
        far = far.select("conv_id", "id", F.coalesce("to2", "to").alias("to"), (F.col("dist") + F.coalesce("dist2", F.lit(0))).alias("dist"), F.coalesce("more", F.lit(False)).alias("open"))
        grown = stored(jumps.where("not open").unionByName(far), "jumps")
        discard(jumps)
        jumps = grown
    return jumps.where("not open").drop("open")


def call_levels(calls: DataFrame) -> DataFrame:
    """(conv_id, id, level) from (conv_id, id, needs); calls in a cycle, or that need one, are left out.

    Chains of calls with one need each are followed to their ends by doubling, so a chain costs
    rounds by the logarithm of its length. Calls with several needs are placed in rounds that
    carry only the calls placed last, and the sums of those that wait for more.
    """
    known = calls.select("conv_id", "id")
    edges = calls.select("conv_id", "id", F.explode(F.array_distinct("needs")).alias("need"))
    edges = stored(edges.join(known.select("conv_id", F.col("id").alias("need")), ["conv_id", "need"]), "needs")
    waits = stored(edges.groupBy("conv_id", "id").agg(F.count(F.lit(1)).alias("waits")), "waits")
    roots = stored(known.join(waits, ["conv_id", "id"], "left_anti").withColumn("level", F.lit(0).cast("long")), "levels")
    if waits.isEmpty():
        return roots.withColumn("level", F.col("level").cast("int"))
    single = edges.join(waits.where("waits = 1"), ["conv_id", "id"], "left_semi")
    chains = stored(_chain_ends(single), "chains")
    # needs of calls with several, put off to the ends of their chains
    several = edges.join(waits.where("waits > 1"), ["conv_id", "id"]).join(chains.withColumnRenamed("id", "need"), ["conv_id", "need"], "left")
    several = stored(several.select("conv_id", "id", "waits", F.coalesce("to", "need").alias("end"), (F.coalesce("dist", F.lit(0)) + 1).alias("over")), "several")
    front, waiting, placed = roots, None, roots
    while not several.isEmpty():
        met = several.join(front.withColumnRenamed("id", "end"), ["conv_id", "end"])
        met = met.select("conv_id", "id", "waits", F.lit(1).cast("long").alias("got"), (F.col("level") + F.col("over")).alias("level"))
        met = met if waiting is None else met.unionByName(waiting)
        met = stored(met.groupBy("conv_id", "id", "waits").agg(F.sum("got").alias("got"), F.max("level").alias("level")), "met")
        front, waiting = met.where("got = waits").select("conv_id", "id", "level"), met.where("got < waits")
        if front.isEmpty():
            break
        placed = placed.unionByName(front)
    ends = placed.withColumnRenamed("id", "to")
    on_chains = chains.join(ends, ["conv_id", "to"]).select("conv_id", "id", (F.col("level") + F.col("dist")).alias("level"))
    out = stored(placed.unionByName(on_chains).withColumn("level", F.col("level").cast("int")), "levels")
    discard(edges, waits, roots, chains, several)
    return out


def link_tool_calls(messages: DataFrame, tools: DataFrame | None = None) -> DataFrame:
    """conv_id, turn, role, order_turn, order_level, n_calls, n_results, n_errors, message: one row for each row of messages.

    tools: (name string, required array<string>, types map<string,string>).
    """
    spark = messages.sparkSession
    if tools is None:
        tools = spark.createDataFrame([], "name string, required array<string>, types map<string,string>")
    tools = tools.groupBy("name").agg(F.min_by(F.struct("required", "types"), F.to_json(F.struct("required", "types"))).alias("s")).select("name", "s.*")
    # conversations go by a text that also tells null ids, as joins take no nulls; a message's key by its turn and text
    conv = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    base = messages.select("conv_id", "turn", "role", "text", conv.alias("conv"))
    key = F.md5(F.concat(F.coalesce(F.col("turn").cast("string"), F.lit("")), F.lit(":"), F.col("text")).cast("binary"))
    asked = base.where("role = 'assistant' and text like '%tool_calls%'").withColumn("x", F.from_json("text", CALLS)).where("x.tool_calls is not null")
    asked = asked.select("conv", "turn", key.alias("k"), "x").distinct()
    calls = asked.select("conv", "turn", "k", F.posexplode("x.tool_calls").alias("i", "c")).select(
        "conv", "turn", "k", "i", "c.id", "c.name", "c.arguments"
    )
    calls = stored(calls.withColumn("needs", F.regexp_extract_all(F.coalesce(F.to_json(F.try_parse_json("arguments")), F.lit("")), F.lit(NEED), F.lit(1))), "calls")
    first = calls.where("id is not null").groupBy("conv", "id").agg(F.min(F.struct("turn", "i", "k", "needs")).alias("f"))
    first = stored(first.select("conv", "id", F.col("f.turn").alias("f_turn"), F.col("f.i").alias("f_i"), F.col("f.k").alias("f_k"), F.col("f.needs").alias("needs")), "first")
    levels = call_levels(first.select(F.col("conv").alias("conv_id"), "id", "needs")).withColumnRenamed("conv_id", "conv")

    answers = base.where("role = 'tool' and text like '%tool_call_id%'").withColumn("x", F.from_json("text", RESULT)).where("x is not null and (x.tool_call_id is not null or x.content is not null)")
    answers = answers.select("conv", "turn", key.alias("k"), F.col("x.tool_call_id").alias("id"), F.col("x.content").alias("content")).distinct()
    answers = answers.join(first.select("conv", "id", "f_turn", F.lit(1).alias("linked")), ["conv", "id"], "left")
    answers = answers.join(levels, ["conv", "id"], "left")
    answers = stored(answers, "answers")
    result = answers.where("linked = 1").groupBy("conv", "id").agg(F.min(F.struct("turn", "k", "content")).alias("r"), F.count(F.lit(1)).alias("n"))
    result = result.select("conv", "id", F.col("r.content").alias("result"), F.lit(True).alias("has_result"))

    full = (
        calls.join(first.drop("needs"), ["conv", "id"], "left")
        .join(levels, ["conv", "id"], "left")
        .join(result, ["conv", "id"], "left")
        .join(tools.select("name", "required", "types", F.lit(1).alias("known")), "name", "left")
    )
    own = F.col("f_turn").eqNullSafe(F.col("turn")) & (F.col("f_i") == F.col("i")) & (F.col("f_k") == F.col("k"))
    errors = F.concat(
        argument_errors(F.col("arguments"), F.col("known"), F.col("required"), F.col("types")),
        F.when(F.col("id").isNull(), F.array(F.lit("no_id"))).when(~own, F.array(F.lit("duplicate_id"))).otherwise(F.array().cast("array<string>")),
        F.when(F.col("level").isNull() & F.col("id").isNotNull(), F.array(F.lit("cycle"))).otherwise(F.array().cast("array<string>")),
    )
    entry = F.struct(
        F.try_parse_json("arguments").alias("arguments"), errors.alias("errors"), F.col("id").alias("id"), F.col("level").alias("level"),
        F.col("name").alias("name"), F.when(own, F.col("result")).alias("result"),
    )
    # the entries of a message are as many as its own list had
    full = full.select("conv", "turn", "k", "i", F.coalesce("level", F.lit(0)).alias("lv"), F.size(errors).alias("e"), (own & F.coalesce("has_result", F.lit(False))).cast("int").alias("r"), F.to_json(entry, {"ignoreNullFields": "false"}).alias("j"))
    by_message = full.groupBy("conv", "k").agg(
        F.array_sort(F.collect_list(F.struct("lv", "i", "j"))).alias("js"), F.sum("e").cast("long").alias("c_errors"), F.count(F.lit(1)).alias("c_calls"), F.sum("r").alias("c_results")
    )
    by_message = by_message.join(asked.select("conv", "k", F.col("x.content").alias("c_content")), ["conv", "k"])
    by_message = stored(by_message.withColumn("role", F.lit("assistant")), "linked")
    by_answer = stored(answers.select("conv", "k", F.lit("tool").alias("role"), F.col("id").alias("a_id"), F.col("content").alias("a_content"), "linked", "f_turn", F.col("level").alias("a_level"), F.lit(1).alias("a")), "linked")

    on = ["conv", "role", "k"]
    out = base.withColumn("k", key).join(checked_broadcast(by_message), on, "left").join(checked_broadcast(by_answer), on, "left")
    plain = _json(content=F.col("text"), role=F.col("role"))
    head = F.regexp_replace(_json(content=F.col("c_content"), role=F.col("role")), r"\}$", "")
    asked_json = F.concat(head, F.lit(',"tool_calls":['), F.array_join(F.transform("js", lambda x: x["j"]), ","), F.lit("]}"))
    answer_json = _json(content=F.col("a_content"), role=F.col("role"), tool_call_id=F.col("a_id"))
    is_call, is_answer = F.col("js").isNotNull(), F.col("a").isNotNull()
    return out.select(
        "conv_id",
        "turn",
        "role",
        F.when(is_answer, F.greatest("turn", "f_turn")).otherwise(F.col("turn")).alias("order_turn"),
        F.when(is_answer, F.coalesce(F.col("a_level"), F.lit(0)) + 1).otherwise(F.lit(0)).cast("int").alias("order_level"),
        F.coalesce("c_calls", F.lit(0)).cast("long").alias("n_calls"),
        F.coalesce(F.col("c_results"), F.when(F.col("linked") == 1, F.lit(1)), F.lit(0)).cast("long").alias("n_results"),
        F.when(is_call, F.col("c_errors")).when(is_answer & F.col("linked").isNull(), F.lit(1)).otherwise(F.lit(0)).cast("long").alias("n_errors"),
        F.when(is_call, asked_json).when(is_answer, answer_json).otherwise(plain).alias("message"),
    )
