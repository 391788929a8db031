"""Tool-call linking: calls meet their results by identifier, in topological order, checked against schemas, as canonical JSON.

All of it is DataFrame expressions and joins; no Python runs on the executors.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import as_table, drop_table

#: A schema: argument name -> (Spark type of the variant's value, required).
Schema = Mapping[str, tuple[str, bool]]
QUERY_SCHEMAS: dict[str, Schema] = {"reply": {"text": ("STRING", True), "turn": ("BIGINT", True)}}


def canonical_json(text: Column) -> Column:
    """JSON with sorted keys and without white space; null where the text is not JSON. The variant encoding keeps an
    object's fields in key order and numbers in their shortest exact form."""
    return F.to_json(F.try_parse_json(text))


def argument_errors(name: Column, arguments: Column, schemas: Mapping[str, Schema]) -> Column:
    """Sorted array of what is wrong with a call's arguments: ``unknown tool``, ``not an object``, ``missing x``,
    ``type of x``, ``unexpected x``. Empty for a valid call; JSON null counts as missing."""
    parsed = F.try_parse_json(arguments)
    is_object = F.startswith(F.coalesce(F.schema_of_variant(parsed), F.lit("")), F.lit("OBJECT<"))
    keys = F.coalesce(F.json_object_keys(arguments), F.array().cast("array<string>"))
    out = F.array(F.lit("unknown tool"))
    for tool, schema in sorted(schemas.items()):
        found: list[Column] = []
        for arg, (kind, required) in sorted(schema.items()):
            path = "$['" + arg.replace("'", "\\'") + "']"
            kind_found = F.schema_of_variant(F.try_variant_get(parsed, path, "variant"))
            absent = kind_found.isNull() | (kind_found == "VOID")
            right = kind_found == kind if kind != "DOUBLE" else kind_found.isin("DOUBLE", "BIGINT") | kind_found.startswith("DECIMAL")
            found.append(F.when(absent, F.lit(f"missing {arg}") if required else F.lit(None)).when(~right, F.lit(f"type of {arg}")))
        extra = F.transform(F.array_except(keys, F.array(*[F.lit(a) for a in sorted(schema)]).cast("array<string>")), lambda k: F.concat(F.lit("unexpected "), k))
        errors = F.array_sort(F.concat(F.array_compact(F.array(*found).cast("array<string>")), extra))
        out = F.when(name == tool, F.when(is_object, errors).otherwise(F.array(F.lit("not an object")))).otherwise(out)
    return F.coalesce(out, F.array(F.lit("unknown tool")))


def chains(edges: DataFrame) -> DataFrame:
    """node, head, dist of every identifier with exactly one dependency: the first identifier up its chain that has none or
    several, and the steps to it; head is null on or behind a cycle of such identifiers.

    Pointer jumping: each round doubles the steps taken, so the rounds grow with the logarithm of the longest chain.
    """
    single = edges.groupBy(F.col("call_id").alias("node")).agg(F.count("*").alias("n"), F.min("needs").alias("head")).where("n = 1")
    now = as_table(single.select("node", "head", F.lit(1).cast("long").alias("dist"), F.lit(True).alias("open")), "chain")
    most, steps = now.count(), 1
    while not now.where("open").isEmpty():
        if steps > most:  # more steps than identifiers: what still jumps goes round
            return now.select("node", F.when(~F.col("open"), F.col("head")).alias("head"), "dist")
        ahead = now.select(F.col("node").alias("a_node"), F.col("head").alias("a_head"), F.col("dist").alias("a_dist"), F.col("open").alias("a_open"))
        jumped = now.join(ahead, F.col("head") == F.col("a_node"), "left")
        after = as_table(jumped.select(
            "node", F.coalesce("a_head", "head").alias("head"), (F.col("dist") + F.coalesce("a_dist", F.lit(0))).alias("dist"), F.coalesce("a_open", F.lit(False)).alias("open"),
        ), "chain")
        drop_table(now)
        now, steps = after, steps * 2
    return now.select("node", "head", "dist")


def levels(calls: DataFrame, depends: DataFrame) -> DataFrame:
    """Topological level of each identifier: 0 without dependencies, else one more than its deepest; null on or behind a
    cycle. Dependencies on unknown identifiers do not count. ``calls`` has call_id, ``depends`` has call_id and needs.

    Chains of single dependencies are jumped over. What is left, identifiers with several dependencies, is settled in
    Kahn's rounds as joins: a round settles those whose dependencies are all settled.
    """
    ids = calls.select("call_id").where("call_id is not null").distinct()
    edges = depends.where("call_id is not null and needs is not null").select("call_id", "needs").distinct()
    edges = edges.join(ids.select(F.col("call_id").alias("needs")), "needs", "left_semi").join(ids, "call_id", "left_semi")
    edges = as_table(edges, "chat-edges")
    jumps = as_table(chains(edges), "chat-chains")
    free = ids.join(edges, "call_id", "left_anti").select(F.col("call_id").alias("head"), F.lit(0).cast("long").alias("level"))
    several = edges.groupBy("call_id").agg(F.count("*").alias("n")).where("n > 1").select("call_id")
    of_head = edges.join(several, "call_id", "left_semi").join(jumps.withColumnRenamed("head", "j_head"), F.col("needs") == F.col("node"), "left")
    # where a dependency stands on a chain, its level is that of the chain's head and the steps between
    waiting = of_head.select("call_id", F.when(F.col("node").isNull(), F.col("needs")).otherwise(F.col("j_head")).alias("up"), F.coalesce("dist", F.lit(0)).alias("dist"), F.lit(None).cast("long").alias("level"))
    waiting = as_table(waiting, "chat-open")
    settled = fresh = as_table(free, "chat-levels")
    while not waiting.isEmpty():
        known = fresh.select(F.col("head").alias("up"), F.col("level").alias("up_level"))
        before = waiting
        waiting = as_table(waiting.join(known, "up", "left").select("call_id", "up", "dist", F.coalesce("level", F.col("up_level") + F.col("dist")).alias("level")), "chat-open")
        drop_table(before)
        ready = waiting.groupBy("call_id").agg(F.max("level").alias("deep"), F.count_if(F.col("level").isNull()).alias("missing")).where("missing = 0")
        fresh = as_table(ready.select(F.col("call_id").alias("head"), (F.col("deep") + 1).alias("level")), "chat-levels")
        if fresh.isEmpty():
            break
        settled = as_table(settled.unionByName(fresh), "chat-levels")
        waiting = as_table(waiting.join(fresh.select(F.col("head").alias("call_id")), "call_id", "left_anti"), "chat-open")
    at = ids.join(jumps, F.col("call_id") == F.col("node"), "left").select("call_id", F.when(F.col("node").isNull(), F.col("call_id")).otherwise(F.col("head")).alias("up"), F.coalesce("dist", F.lit(0)).alias("dist"))
    found = settled.select(F.col("head").alias("up"), "level")
    return at.join(found, "up", "left").select("call_id", (F.col("level") + F.col("dist")).cast("int").alias("level"))


def _join_known(rows: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Left hash join on call_id; rows without one do not enter it, where they would all meet in one task.

    ``other`` has one row a call_id, so the hash table of a partition has a bound however often an id is asked for, and Spark
    splits partitions of the asking side that are too large.
    """
    without = rows.where("call_id is null").select("*", *[F.lit(None).cast(kind).alias(name) for name, kind in other.dtypes])
    return rows.where("call_id is not null").join(other.hint("shuffle_hash"), F.col("call_id") == F.col(key), "left").unionByName(without)


def link_calls(calls: DataFrame, results: DataFrame, schemas: Mapping[str, Schema], depends: DataFrame | None = None) -> DataFrame:
    """One row per call and per result: conv_id, seq, kind, call_id, linked, level, call_seq, valid, errors, message.

    calls: conv_id, seq, call_id, name, arguments (JSON text); results: conv_id, seq, call_id, content; depends: call_id,
    needs. Results meet calls by identifier with an equi-join of which Spark may broadcast or split a side, never by
    grouping a conversation. A call is linked if a result has its id, a result if a call has. Repeated results of a call
    all link; of repeated calls with one id the first (by seq, then arguments) takes the results, and each row stays.
    Null ids never link. (level, call_seq, kind, seq) is a topological order of a conversation: calls after what they
    need, results after their calls, also where a log has the result first. Unlinked results have level -1. message is
    canonical JSON; arguments that are not JSON stand in it as a string. Other columns are dropped.
    """
    c = calls.select("conv_id", "seq", "call_id", "name", "arguments")
    r = results.select("conv_id", "seq", "call_id", "content")
    answered = r.where("call_id is not null").groupBy(F.col("call_id").alias("a_id")).agg(F.count("*").alias("n_results"))
    owners = c.where("call_id is not null").groupBy(F.col("call_id").alias("o_id")).agg(F.min(F.struct("seq", "arguments")).alias("first"))
    order = levels(c, depends).select(F.col("call_id").alias("l_id"), "level") if depends is not None else None
    own = _join_known(c, answered, "a_id")
    their = _join_known(r, owners, "o_id")
    if order is not None:
        own, their = _join_known(own, order, "l_id"), _join_known(their, order, "l_id")
    else:
        own, their = own.withColumn("level", F.lit(0)), their.withColumn("level", F.lit(0))
    errors = argument_errors(F.col("name"), F.col("arguments"), schemas)
    canonical = canonical_json(F.col("arguments"))
    text = lambda col: F.to_json(F.to_variant_object(F.array(col)))
    quoted = lambda col: F.when(col.isNull(), F.lit("null")).otherwise(text(col).substr(F.lit(2), F.length(text(col)) - 2))
    call_message = F.concat(
        F.lit('{"arguments":'), F.coalesce(canonical, quoted(F.col("arguments"))), F.lit(',"id":'), quoted(F.col("call_id")),
        F.lit(',"name":'), quoted(F.col("name")), F.lit(',"type":"call"}'),
    )
    result_message = F.concat(F.lit('{"content":'), quoted(F.col("content")), F.lit(',"id":'), quoted(F.col("call_id")), F.lit(',"type":"result"}'))
    from_calls = own.select(
        "conv_id", "seq", F.lit("call").alias("kind"), "call_id", F.col("n_results").isNotNull().alias("linked"), F.col("level").cast("int").alias("level"),
        F.col("seq").alias("call_seq"), (F.size(errors) == 0).alias("valid"), F.concat_ws("; ", errors).alias("errors"), call_message.alias("message"),
    )
    linked = F.col("o_id").isNotNull()
    from_results = their.select(
        "conv_id", "seq", F.lit("result").alias("kind"), "call_id", linked.alias("linked"), F.when(linked, F.col("level")).otherwise(F.lit(-1)).cast("int").alias("level"),
        F.coalesce("first.seq", "seq").alias("call_seq"), linked.alias("valid"), F.when(linked, F.lit("")).otherwise(F.lit("no call")).alias("errors"), result_message.alias("message"),
    )
    return from_calls.unionByName(from_results)


def conversation_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calls, results and dependencies of plain conversations: a user turn calls ``reply`` with its text; the assistant
    turn after it is the result under the same identifier; a call needs the call two turns before it. Other roles are
    context: results without an identifier."""
    ident = lambda turn: F.concat(F.lit("call-"), F.col("conv_id").cast("string"), F.lit("-"), turn.cast("string"))
    turns = conversations.select("conv_id", F.col("turn").cast("long").alias("seq"), F.coalesce("role", F.lit("")).alias("role"), "text")
    arguments = F.to_json(F.to_variant_object(F.struct("text", F.col("seq").alias("turn"))))
    users = turns.where("role = 'user'")
    calls = users.select("conv_id", "seq", ident(F.col("seq")).alias("call_id"), F.lit("reply").alias("name"), arguments.alias("arguments"))
    others = turns.where("role <> 'user'")
    results = others.select("conv_id", "seq", F.when(F.col("role") == "assistant", ident(F.col("seq") - 1)).alias("call_id"), F.col("text").alias("content"))
    return calls, results, users.select(ident(F.col("seq")).alias("call_id"), ident(F.col("seq") - 2).alias("needs"))
