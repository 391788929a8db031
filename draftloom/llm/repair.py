"""Conversation structure repair: the cheapest edits that give turns the order system, user, assistant, user, assistant and so on.

A conversation is one byte a turn while its edits are sought: time-major NumPy tensors hold the costs of all conversations of
about one length. Texts are not part of that; they are shuffled once, and meet their edits in a sorted stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import as_table, drop_table, small_batches

#: Costs of the edits, and of a truncated turn that stays.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Kinds of turns by the initial of the role, and their faults: a turn's code is 4 * kind + fault.
KINDS, (SOUND, CUT, BLANK, DUPLICATE) = "sua", range(4)
#: The code of a place behind a conversation's end.
END = 16
#: States between turns: nothing so far, after the system turn, after a user's, after an assistant's. The first and the last may end.
KEPT = np.array([[1, -1, -1, -1], [2, 2, -1, 2], [-1, -1, 3, -1], [-1, -1, -1, -1], [-1, -1, -1, -1]])
GIVEN = np.array([2, 2, 3, 2])
LAST = np.array([0, 2 * INSERT, INSERT, 0])
#: More than any cost that is compared.
NEVER = 1 << 20
#: Turns of a block; equal turns of a row; turns of all conversations that are looked at together.
BLOCK, RUN, TOGETHER = 1 << 20, 1 << 16, 1 << 20
_WHITE = " \t\n\x0b\x0c\r"


def turns(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text alone; null roles and texts are one space."""
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))


def damage(rows: DataFrame) -> DataFrame:
    """Turns with planted faults, by the remainder of crc32(``conv_id:turn``) by 20, null ids and turns as one space: 0 drops a
    turn, 1 empties its text, 2 takes its sentence ends, 3 repeats it, 4 makes it the user's."""
    name = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(name.cast("binary")) % 20
    hit = turns(rows).withColumn("kind", kind).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return hit.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("time")).drop("time")


def _order() -> list[Column]:
    """The order of a conversation's turns: by turn, null first, then by role and the text's MD5, so that it is the same each time."""
    return [F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("h").asc()]


def _cells(rows: DataFrame) -> DataFrame:
    """Equal turns of a conversation as one row, without the text: conv_id, turn, role, h (its MD5), code, n."""
    last = F.right(F.rtrim("text", F.lit(_WHITE)), F.lit(1))
    fault = F.when(last == "", BLANK).when(last.isin(".", "!", "?"), SOUND).otherwise(CUT)
    kind = F.lit(len(KINDS))
    for k, initial in enumerate(KINDS):
        kind = F.when(F.substr("role", F.lit(1), F.lit(1)) == initial, k).otherwise(kind)
    plain = rows.select("conv_id", "turn", "role", F.unhex(F.md5(F.col("text").cast("binary"))).alias("h"), (4 * kind + fault).alias("code"))
    return plain.groupBy("conv_id", "turn", "role", "h", "code").agg(F.count("*").alias("n"))


def _blocks(cells: DataFrame) -> DataFrame:
    """conv_id, part, block, codes: a conversation's turns in order, one byte each, in blocks by range partition.

    A conversation may span partitions, so one of very many turns is no single task's work here. Turns whose role and text stood in
    an earlier one are duplicates: what repeats is told by the first turn of each role and text.
    """
    turn = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    first = cells.where(F.col("code") % 4 != BLANK).groupBy(F.col("conv_id").alias("f_id"), F.col("role").alias("f_role"), F.col("h").alias("f_h")).agg(F.min(turn).alias("first"), F.count("*").alias("c"))
    first = as_table(first.where("c > 1").select("f_id", "f_role", "f_h", F.col("first.turn").alias("f_turn")), "repeated")
    on = F.col("conv_id").eqNullSafe(F.col("f_id")) & (F.col("role") == F.col("f_role")) & (F.col("h") == F.col("f_h"))
    told = cells.join(first, on, "left").withColumn("later", F.col("f_h").isNotNull() & ~F.col("turn").eqNullSafe(F.col("f_turn")))
    # very many equal turns are several rows of a bounded number each
    runs = told.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / RUN))))
    n = F.least(F.lit(RUN).cast("long"), F.col("n") - F.col("run") * RUN)
    copy = F.when(F.col("code") % 4 == BLANK, F.col("code")).otherwise(F.col("code") - F.col("code") % 4 + DUPLICATE)
    head = F.when(F.col("later") | (F.col("run") > 0), copy).otherwise(F.col("code"))
    order = [F.col("conv_id").asc_nulls_first(), *_order(), F.col("run").asc()]
    ranged = runs.select("conv_id", "turn", "role", "h", "run", n.alias("n"), head.alias("head"), copy.alias("copy")).repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: tuple | None = None
        held: list[np.ndarray] = []
        size = block = 0

        def flush() -> pa.RecordBatch:
            codes = np.concatenate(held).tobytes() if held else b""
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([current[0]], kind), pa.array([current[1]], pa.int32()), pa.array([block], pa.int64()), pa.array([codes])], ["conv_id", "part", "block", "codes"])

        kind = None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, kind = batch.column(0), batch.schema.field(0).type
            part = batch.column(1)[0].as_py()
            n, head, copy = (batch.column(k).to_numpy() for k in (2, 3, 4))
            ends = np.cumsum(n)
            codes = np.repeat(copy.astype(np.uint8), n)
            codes[ends - n] = head
            named = ids.to_pylist()
            starts = [0, *[k for k in range(1, len(named)) if named[k] != named[k - 1]], len(named)]
            for a, b in zip(starts, starts[1:], strict=False):
                key = (named[a], part)
                if current is not None and (key != current or size >= BLOCK):
                    yield flush()
                    block, size = (block + 1 if key == current else 0), 0
                current = key
                held.append(codes[ends[a] - n[a] : ends[b - 1]])
                size += len(held[-1])
        if current is not None:
            yield flush()

    id_type = cells.schema["conv_id"].dataType.simpleString()
    return ranged.select("conv_id", F.spark_partition_id().alias("part"), "n", "head", "copy").mapInArrow(run, f"conv_id {id_type}, part int, block long, codes binary")


def backward_costs(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Costs to the end of time-major ``codes`` (turn, conversation; the last row all END): offsets (turn, conversation, state)
    from the least of the four states, and by how much that least grows at each turn. Offsets never reach 2 * INSERT + DELETE,
    as inserts and one delete lead from any state to what another can do; so they fit a byte."""
    length, width = codes.shape
    offsets = np.empty((length, width, 4), np.int8)
    steps = np.zeros((length, width), np.int8)
    offsets[-1] = LAST
    after = np.tile(LAST, (width, 1)).astype(np.int32)
    for t in range(length - 2, -1, -1):
        kind, fault = codes[t] >> 2, codes[t] & 3
        stays = np.where(fault == CUT, TRUNCATED, np.where(fault >= BLANK, NEVER, 0))[:, None]
        keep = np.where(KEPT[kind] >= 0, np.take_along_axis(after, np.maximum(KEPT[kind], 0), axis=1), NEVER) + stays
        now = np.minimum(np.minimum(after + DELETE, keep), after[:, GIVEN] + REROLE + stays)
        now = _inserted(now)
        now[codes[t] == END] = after[codes[t] == END]
        least = now.min(axis=1)
        after = now - least[:, None]
        offsets[t], steps[t] = after, least
    return offsets, steps


def _inserted(costs: np.ndarray) -> np.ndarray:
    """Costs of states where turns may be inserted before the next: two at most, as more come back to the same state."""
    user = np.minimum(costs[:, 2], costs[:, 3] + INSERT)
    assistant = np.minimum(costs[:, 3], costs[:, 2] + INSERT)
    return np.stack([np.minimum(costs[:, 0], user + INSERT), np.minimum(costs[:, 1], user + INSERT), user, assistant], axis=1)


def trace(codes: np.ndarray, offsets: np.ndarray, steps: np.ndarray) -> list[str]:
    """The cheapest edits of each conversation, the least in ASCII order of equally cheap ones: at each place the least letter
    that keeps the cost. All conversations take a step at a time."""
    length, width = codes.shape
    # all turns may be deleted, so no more turns are inserted than that costs
    letters = np.zeros((length + DELETE * length // INSERT + 1, width), np.uint8)
    at, state, live = np.zeros(width, np.int64), np.zeros(width, np.int64), np.arange(width)
    for row in letters:
        t, s = at[live], state[live]
        code = codes[t, live]
        here = offsets[t, live, s].astype(np.int32)
        ended = code == END
        stop = ended & (LAST[s] == 0)
        live, t, s, code, here, ended = (x[~stop] for x in (live, t, s, code, here, ended))
        if not len(live):
            break
        after = np.minimum(t + 1, length - 1)
        total = here + steps[t, live]
        kind, fault = code >> 2, code & 3
        kept = KEPT[kind, s]
        cost = np.where(fault == CUT, TRUNCATED, 0)
        deletes = ~ended & (total == offsets[after, live, s] + DELETE)
        inserts = ~deletes & (here == offsets[t, live, GIVEN[s]] + INSERT)
        keeps = ~deletes & ~inserts & (kept >= 0) & (fault < BLANK) & (total == offsets[after, live, np.maximum(kept, 0)] + cost)
        row[live] = np.select([deletes, inserts, keeps], [ord("D"), ord("I"), ord("K")], ord("R"))
        state[live] = np.select([deletes, keeps], [s, kept], GIVEN[s])
        at[live] = np.where(inserts, t, t + 1)
    # of steps that a conversation does not take, zeros are left, all at the end
    return [column.tobytes().rstrip(b"\0").decode() for column in np.ascontiguousarray(letters.T)]


def _buckets(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Places of conversations of about one length, so many that their turns have a bound, one at least."""
    order = np.argsort(sizes, kind="stable")
    bits = np.array([int(n).bit_length() for n in sizes[order]])
    for bit in np.unique(bits):
        group = order[bits == bit]
        many = max(1, TOGETHER >> int(bit))
        for a in range(0, len(group), many):
            yield group[a : a + many]


def _edits(blocks: DataFrame) -> DataFrame:
    """conv_id, blank, duplicate, truncated, illegal, cost, audit of each conversation.

    Its codes are put together, a byte a turn, as long as the audit that is to be returned.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            all_codes = [np.frombuffer(b"".join(parts), np.uint8) for parts in batch.column(1).to_pylist()]
            sizes = np.array([len(c) for c in all_codes])
            numbers = np.zeros((len(all_codes), 5), np.int64)
            audits = [""] * len(all_codes)
            for places in _buckets(sizes):
                codes = np.full((sizes[places].max() + 1, len(places)), END, np.uint8)
                for k, place in enumerate(places):
                    codes[: sizes[place], k] = all_codes[place]
                kind, fault = codes >> 2, np.where(codes == END, SOUND, codes & 3)
                legal = (kind[:-1] == 0) & (kind[1:] == 1) | (kind[:-1] == 1) & (kind[1:] == 2) | (kind[:-1] == 2) & (kind[1:] == 1)
                offsets, steps = backward_costs(codes)
                cost = steps.sum(axis=0, dtype=np.int64) + offsets[0, :, 0]
                counts = [(fault == f).sum(axis=0) for f in (BLANK, DUPLICATE, CUT)]
                numbers[places] = np.stack([*counts, sizes[places] - 1 - legal.sum(axis=0), cost], axis=1)
                for place, audit in zip(places, trace(codes, offsets, steps), strict=True):
                    audits[place] = audit
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c) for c in numbers.T.copy()], pa.array(audits, pa.string())], ["conv_id", "blank", "duplicate", "truncated", "illegal", "cost", "audit"])

    gathered = blocks.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", "block", "codes"))).alias("b"))
    kind = blocks.schema["conv_id"].dataType.simpleString()
    return gathered.select("conv_id", F.col("b.codes").alias("codes")).mapInArrow(run, f"conv_id {kind}, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


NUMBERS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def edits(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit: what is wrong with each conversation of ``rows`` (conv_id, turn,
    role, text), and the letters of its cheapest edits in order: Delete, Insert, Keep, Rerole. ``ids`` (conv_id) adds
    conversations without turns: noughts and an empty audit. A table.

    Turns stand by turn, null first, equal ones by role and MD5 of the text. The first fault of a turn counts: blank, duplicate
    (role and text stood earlier), truncated (the last character that is not white space ends no sentence). Null ids are
    one conversation; null roles and texts are one space. Roles go by their initial, s, u or a. gaps counts
    turn numbers that are missing between the least and the greatest. Repeated rows are duplicates. Very long texts
    are read whole, empty ones are blank. Other columns are dropped; an empty table gives an empty result.
    """
    plain = turns(rows)
    cells = as_table(_cells(plain), "cells")
    blocks = as_table(_blocks(cells), "blocks")
    found = _edits(blocks).withColumnRenamed("conv_id", "e_id")
    missing = cells.where("turn is not null").select("conv_id", "turn").distinct().groupBy(F.col("conv_id").alias("g_id")).agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))
    every = cells.select("conv_id")
    every = (every if ids is None else every.unionByName(ids.select("conv_id"))).distinct()
    joined = every.join(found, F.col("conv_id").eqNullSafe(F.col("e_id")), "left").join(missing, F.col("conv_id").eqNullSafe(F.col("g_id")), "left")
    out = as_table(joined.select("conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in NUMBERS], F.coalesce("audit", F.lit("")).alias("audit")), "edits")
    for table in (cells, blocks):
        drop_table(table)
    return out


def _stream(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """Each conversation's row of :func:`edits`, then its turns in order: texts are shuffled once, and no turn carries the edits."""
    nothing = [F.lit(None).cast("long").alias(c) for c in NUMBERS]
    first = plans.select("conv_id", F.lit(0).alias("line"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit(b"").alias("h"), *NUMBERS, "audit")
    lines = turns(rows).select("conv_id", F.lit(1).alias("line"), "turn", "role", "text", F.unhex(F.md5(F.col("text").cast("binary"))).alias("h"), *nothing, F.lit(None).cast("string").alias("audit"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("line").asc(), *_order()]
    sorted_rows = first.unionByName(lines).repartition("conv_id").sortWithinPartitions(*order)
    return sorted_rows.select("conv_id", "line", "role", "text", *NUMBERS, "audit")


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple | None, str, str]]:
    """(row of edits, "", "") at each conversation's start, then (None, role, text) for each turn of its repaired form."""
    audit, at, state = "", 0, 0

    def given() -> str:
        nonlocal state
        state = int(GIVEN[state])
        return "user" if state == 2 else "assistant"

    def rest() -> Iterator[tuple[None, str, str]]:
        nonlocal at
        while at < len(audit) and audit[at] == "I":
            at += 1
            yield None, given(), ""

    for batch in batches:
        lines, roles, texts = (batch.column(k).to_pylist() for k in (1, 2, 3))
        heads = {k: tuple(batch.column(c)[k].as_py() for c in (0, *range(4, batch.num_columns))) for k, line in enumerate(lines) if line == 0}
        for k, (role, text) in enumerate(zip(roles, texts, strict=True)):
            yield from rest()
            if k in heads:
                audit, at, state = heads[k][-1], 0, 0
                yield heads[k], "", ""
                continue
            letter = audit[at]
            at += 1
            if letter == "K":
                state = int(KEPT[KINDS.index(role[0]), state])
                yield None, role, text
            elif letter == "R":
                yield None, given(), text
    yield from rest()


def repaired(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """conv_id, seq, role, text: the turns of ``rows`` after the edits of ``plans``, the result of :func:`edits` for them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = seq = 0
        conv = None
        pack = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), (None, pa.int64(), pa.string(), pa.string()), strict=True)], ["conv_id", "seq", "role", "text"])
        for head, role, text in _walk(batches):
            if head is not None:
                conv, seq = head[0], 0
                continue
            held.append((conv, seq, role, text))
            seq, size = seq + 1, size + len(text)
            if len(held) >= 1_000 or size > 1 << 22:
                yield pack()
                held, size = [], 0
        if held:
            yield pack()

    kind = plans.schema["conv_id"].dataType.simpleString()
    return small_batches(_stream(rows, plans)).mapInArrow(run, f"conv_id {kind}, seq long, role string, text string")


def repair(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """The columns of :func:`edits` and repaired_sha256, the digest of the repaired turns as ``role:text``, newline-joined.

    A digest is made in order, so one task streams through a conversation's texts; it holds a batch of them at a time.
    """
    plans = edits(rows, ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        head, made, empty = None, hashlib.sha256(), True
        pack = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names)
        for first, role, text in _walk(batches):
            if first is None:
                made.update(f"{'' if empty else chr(10)}{role}:{text}".encode())
                empty = False
                continue
            if head is not None:
                held.append((*head, made.hexdigest()))
            head, made, empty = first, hashlib.sha256(), True
            if len(held) >= 1_000:
                yield pack()
                held = []
        if head is not None:
            held.append((*head, made.hexdigest()))
        if held:
            yield pack()

    names = ["conv_id", *NUMBERS, "audit", "repaired_sha256"]
    id_type = plans.schema["conv_id"].dataType.simpleString()
    kinds = [pa.int64() if id_type == "bigint" else None, *[pa.int64()] * len(NUMBERS), pa.string(), pa.string()]
    return small_batches(_stream(rows, plans)).mapInArrow(run, f"conv_id {id_type}, {', '.join(f'{c} long' for c in NUMBERS)}, audit string, repaired_sha256 string")
