"""Tool calls of conversations, linked to their results, checked, ordered and serialised.

Calls and results are rows (`CALLS`, `RESULTS`) that meet by conversation and identifier in a
hash join.  Arguments are JSON and are checked against parameter rows (`SCHEMAS`).  A call
comes after every call that it names in `after`: its place is (rank, hop), where rank is the
latest turn among itself and all calls it depends on, and hop counts the steps from there.
Sorting by (rank, hop, turn) is a topological order that keeps the turns wherever they allow
it.  Calls on a cycle have no place.

Serialised JSON is canonical: keys in order at every depth, no blanks, numbers and escapes in
one form.  Everything is DataFrame operations; no conversation is gathered in one row or task,
so one may hold any share of all messages.

Cases: a call without an identifier, or without a result, stands alone; of calls with one
identifier in a conversation the first is linked, the others are `repeated`; of several results
of a call the first counts; a result without a call is a row of its own (`orphan`); arguments
that are null or no JSON object, unknown tools, missing or unknown parameters and wrong types
are errors; names in `after` that no call has are ignored; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hindsight.llm.shared import settle
from hindsight.session import shared_folder

CALLS = "conv_id long, turn long, call_id string, tool string, arguments string, after array<string>"
RESULTS = "conv_id long, turn long, call_id string, content string"
SCHEMAS = "tool string, parameter string, type string, required boolean"

# What the types of parameters are called, and what JSON values they admit.
TYPES = {
    "integer": "^BIGINT$",
    "number": "^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$",
    "string": "^STRING$",
    "boolean": "^BOOLEAN$",
    "array": "^ARRAY",
    "object": "^OBJECT",
    "null": "^VOID$",
}


def _admits(type_name: Column, found: Column) -> Column:
    out = F.lit(False)
    for name, pattern in TYPES.items():
        out = F.when(type_name == name, found.rlike(pattern)).otherwise(out)
    return out


def argument_errors(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """(row, errors) of the calls (row, tool, parsed) that break their schema; errors in order."""
    spark = calls.sparkSession
    known = schemas.select(F.col("tool").alias("s_tool"), "parameter", "type", "required").where("s_tool IS NOT NULL AND parameter IS NOT NULL")
    objects = calls.where(F.coalesce(F.schema_of_variant("parsed").startswith("OBJECT"), F.lit(False)))
    no_object = calls.join(objects.select("row"), "row", "left_anti").select("row", F.lit("arguments: no object").alias("error"))
    tools = known.select("s_tool").distinct()
    unknown = calls.join(tools, F.col("tool") == F.col("s_tool"), "left_anti").select(
        "row", F.concat(F.lit("tool: unknown "), F.coalesce("tool", F.lit("null"))).alias("error")
    )
    given = objects.select("row", "tool", "parsed").lateralJoin(spark.tvf.variant_explode(F.col("parsed").outer()))
    given = given.select("row", "tool", "key", F.schema_of_variant("value").alias("found"))
    wanted = objects.select(F.col("row").alias("w_row"), F.col("tool").alias("w_tool")).join(known, F.col("w_tool") == F.col("s_tool"))
    met = wanted.join(given, (F.col("w_row") == F.col("row")) & (F.col("parameter") == F.col("key")), "left")
    missing = met.where(F.col("row").isNull() & F.col("required")).select(
        F.col("w_row").alias("row"), F.concat("parameter", F.lit(": missing")).alias("error")
    )
    wrong = met.where(F.col("row").isNotNull() & ~_admits(F.col("type"), F.col("found"))).select(
        "row", F.concat("parameter", F.lit(": no "), "type").alias("error")
    )
    extra = given.join(tools, F.col("tool") == F.col("s_tool"), "left_semi").join(
        known, (F.col("tool") == F.col("s_tool")) & (F.col("key") == F.col("parameter")), "left_anti"
    ).select("row", F.concat("key", F.lit(": not a parameter")).alias("error"))
    errors = no_object.unionByName(unknown).unionByName(missing).unionByName(wrong).unionByName(extra)
    return errors.groupBy("row").agg(F.array_sort(F.collect_list("error")).alias("errors"))


def _written(df: DataFrame) -> DataFrame:
    """`df` as a table in the shared folder: what is read again knows nothing of how it was made.

    A checkpoint keeps what the optimiser has found out of its rows, which grows with each round.
    """
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def places(calls: DataFrame) -> DataFrame:
    """(row, rank, hop) of settled calls (row, conv_id, turn, call_id, after, repeated).

    Starts with every call at its own turn and moves those that stand before something they
    depend on, until none does: one round where all is in order, and as many as the longest
    chain that runs backwards otherwise.  On the way to a call's place every hop is of another
    call that has moved, so more hops than calls of the conversation that have moved so far
    are on or behind a cycle: rank and hop are null.  A cycle of two ends after three rounds,
    however long the conversation.
    """
    named = calls.where("NOT repeated AND call_id IS NOT NULL").select("conv_id", F.col("call_id").alias("name"), F.col("row").alias("before"))
    edges = calls.select("row", "conv_id", F.explode("after").alias("name")).join(named, ["conv_id", "name"])
    edges = settle(edges.select("row", "before").distinct())
    # only a call that stands before one it depends on can move, and what depends on it
    start = F.struct(F.col("turn").alias("rank"), F.lit(0).cast("long").alias("hop"))
    place = _written(calls.select("row", "conv_id", start.alias("at"), F.lit(False).alias("cyclic"), F.lit(False).alias("has_moved")))
    while True:
        from_ = place.select(F.col("row").alias("before"), F.col("at").alias("b"), F.col("cyclic").alias("bc"))
        pushed = edges.join(from_, "before").groupBy("row").agg(
            F.max(F.struct(F.col("b.rank").alias("rank"), (F.col("b.hop") + 1).alias("hop"))).alias("p"), F.max("bc").alias("pc")
        )
        moves = place.join(pushed, "row").where("NOT cyclic AND (p > at OR pc)")
        moved = _written(moves.select("row", "conv_id", F.greatest("p", "at").alias("to"), "pc", "has_moved"))
        if moved.isEmpty():
            break
        # earlier and new ones; no call is counted twice
        known = place.where("has_moved").select("conv_id").unionByName(moved.where("NOT has_moved").select("conv_id"))
        movers = known.groupBy("conv_id").agg(F.count("*").alias("movers"))
        place = place.join(moved.select("row", "to", "pc"), "row", "left").join(movers, "conv_id", "left")
        round_ = F.col("pc") | (F.col("to.hop") > F.col("movers"))
        place = _written(place.select(
            "row", "conv_id", F.coalesce("to", "at").alias("at"), F.coalesce(F.col("cyclic") | round_, "cyclic").alias("cyclic"),
            (F.col("has_moved") | F.col("to").isNotNull()).alias("has_moved"),
        ))
    return place.select("row", F.when(~F.col("cyclic"), F.col("at.rank")).alias("rank"), F.when(~F.col("cyclic"), F.col("at.hop")).alias("hop"))


def link_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """conv_id, turn, call_id, status, result_turn, rank, hop, errors, json; a row for each call and orphan.

    -1 where there is no result, or no place.
    """
    number = F.row_number().over(Window.partitionBy("conv_id", "call_id").orderBy("turn", "tool", "arguments"))
    rows = calls.select("conv_id", "turn", "call_id", "tool", "arguments", "after")
    rows = rows.withColumn("repeated", F.when(F.col("call_id").isNull(), False).otherwise(number > 1))
    # told apart by where they are, which is settled
    rows = settle(rows.withColumn("row", F.monotonically_increasing_id()))
    parsed = rows.select("row", "tool", F.try_parse_json("arguments").alias("parsed"))
    errors = argument_errors(parsed, schemas)
    first = results.groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "content")).alias("r"), F.count("*").alias("results"))
    first = first.where("call_id IS NOT NULL").select(F.col("conv_id").alias("rc"), F.col("call_id").alias("rid"), "r", "results")
    linked = rows.join(first, (F.col("conv_id") == F.col("rc")) & (F.col("call_id") == F.col("rid")) & ~F.col("repeated"), "left")
    linked = linked.join(errors, "row", "left").join(places(rows), "row", "left")
    status = F.when(F.col("repeated"), "repeated").when(F.col("r").isNull(), "no result").otherwise("linked")
    text = lambda c: F.coalesce(F.to_json(F.to_variant_object(F.array(c))), F.lit("[null]"))
    scalar = lambda c: F.regexp_replace(text(c), r"(?s)^\[(.*)\]$", "$1")
    given = F.coalesce(F.to_json(F.try_parse_json("arguments")), F.lit("null"))
    json = F.concat(
        F.lit('{"arguments":'), given, F.lit(',"id":'), scalar(F.col("call_id")), F.lit(',"name":'), scalar(F.col("tool")),
        F.lit(',"result":'), scalar(F.col("r.content")), F.lit("}"),
    )
    out = linked.select(
        "conv_id", "turn", "call_id", status.alias("status"),
        *[F.coalesce(c, F.lit(-1)).alias(n) for c, n in (("r.turn", "result_turn"), ("rank", "rank"), ("hop", "hop"))],
        F.coalesce(F.array_join("errors", "; "), F.lit("")).alias("errors"), json.alias("json"),
    )
    names = rows.select(F.col("conv_id").alias("rc"), F.col("call_id").alias("rid"))
    alone = results.join(names, (F.col("conv_id") == F.col("rc")) & (F.col("call_id") == F.col("rid")), "left_anti")
    orphan = F.concat(F.lit('{"id":'), scalar(F.col("call_id")), F.lit(',"result":'), scalar(F.col("content")), F.lit("}"))
    none = F.lit(-1).cast("long")
    return out.unionByName(alone.select(
        "conv_id", "turn", "call_id", F.lit("orphan").alias("status"), F.col("turn").alias("result_turn"), none.alias("rank"), none.alias("hop"),
        F.lit("").alias("errors"), orphan.alias("json"),
    ))


def turns_as_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of plain conversations: each user turn calls for a reply.

    The call's number is its turn's; it comes after the call two turns before, and the turn
    after it is its result if the assistant has it.  Turns of the system, of any other role and
    without a role are neither and are left out.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    name = lambda back: F.concat(F.lit("call_"), F.col("conv_id").cast("string"), F.lit("_"), (F.col("turn") - back).cast("string"))
    arguments = F.to_json(F.struct("turn", F.col("text").alias("prompt")), {"ignoreNullFields": "false"})
    calls = rows.where("role = 'user'").select(
        "conv_id", "turn", name(0).alias("call_id"), F.lit("reply").alias("tool"), arguments.alias("arguments"), F.array(name(2)).alias("after")
    )
    return calls, rows.where("role = 'assistant'").select("conv_id", "turn", name(1).alias("call_id"), F.col("text").alias("content"))


def reply_schema(spark: SparkSession) -> DataFrame:
    rows = [("reply", "prompt", "string", True), ("reply", "turn", "integer", True)]
    return spark.createDataFrame(rows, SCHEMAS)


def conversation_calls(conversations: DataFrame) -> DataFrame:
    """`link_calls` over the turns of plain conversations."""
    calls, results = turns_as_calls(conversations)
    return link_calls(calls, results, reply_schema(conversations.sparkSession))
