"""SimHash near-duplicates: pigeonring candidates, full Hamming check, components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import as_table, drop_table, drop_uses, small_batches, text_bytes

SHINGLE, SEED, MAX_BITS = 3, 42, 2
SEGMENTS = 8  # of 8 bits each, on a ring
#: Fingerprints that share a first key and are compared pair by pair; larger groups get longer keys.
PAIRWISE = 64


def fingerprint(data: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit SimHash of a text's bytes: A-Z lower-cased, words cut at ASCII white space, word shingles with repeats,
    XXH64. A bit is set if it is set in over half of the hashes. Too few words: one shingle of all; no words: 0."""
    import xxhash

    words = data.lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        pieces = [b" ".join(words)]
    else:
        pieces = list(map(b" ".join, zip(*[words[k:] for k in range(shingle)], strict=False)))
    return vote(np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(seed)), np.uint64, len(pieces)))


def vote(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes; of none: 0."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    votes = bits.sum(axis=0, dtype=np.uint32) * 2 > len(hashes)
    return int(np.packbits(votes, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, tie (a hash of the text), fp (the 64 bits as a long) of every row. Row-wise, whole texts; null is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, shingle, seed) for t in batch.column(2).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found.view(np.int64))], ["doc_id", "tie", "fp"])

    return small_batches(docs).select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("tie"), text_bytes().alias("data")).mapInArrow(run, "doc_id long, tie long, fp long")


def _turned(fp: Column, start: Column) -> Column:
    """The ring turned so that segment ``start`` is lowest."""
    by = start * 8
    return F.when(start == 0, fp).otherwise(F.call_function("shiftrightunsigned", fp, by).bitwiseOR(F.call_function("shiftleft", fp, 64 - by)))


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def _budget(length: int, max_bits: int) -> int:
    return length * max_bits // SEGMENTS


def links(prints: DataFrame, max_bits: int = MAX_BITS, pairwise: int = PAIRWISE) -> DataFrame:
    """All pairs u > v of distinct fingerprints at ``max_bits`` (1 or 2) or fewer differing bits.

    Pigeonring: if two rings of m segments differ in t bits at most, then some start has, for every length l, at most
    l * t / m differing bits in the l segments from it on. So the first segments from that start are equal: they are the
    key under which fingerprints meet, one per start. Groups of more than ``pairwise`` fingerprints under a key are not
    compared pair by pair: there the following segments, in which one bit may differ, join the key with each one of
    their bits masked in turn. What shares such a key differs in that bit and the last segments only, so a group has at
    most 512 members, whatever the input. Every pair then passes the budgets of all lengths, then the full count.
    """
    if max_bits not in (1, 2):
        raise ValueError("max_bits is 1 or 2")
    exact = next(n for n in range(SEGMENTS, 0, -1) if _budget(n, max_bits) == 0)
    single = next(n for n in range(SEGMENTS, 0, -1) if _budget(n, max_bits) <= 1)
    low, middle = (1 << 8 * exact) - 1, _signed((1 << 8 * single) - (1 << 8 * exact))
    ring = prints.select("fp").distinct().withColumn("start", F.explode(F.array(*[F.lit(k) for k in range(SEGMENTS)])))
    ring = ring.withColumn("turned", _turned(F.col("fp"), F.col("start"))).withColumn("key", F.col("turned").bitwiseAND(F.lit(low)))
    ring = as_table(ring, "ring")
    # a table of its own, so that Spark can split a hot key of the joins with it
    crowded = as_table(ring.groupBy("start", "key").agg(F.count("*").alias("n")).where(F.col("n") > pairwise).select(F.col("start").alias("c_start"), F.col("key").alias("c_key")), "crowded")
    on = (F.col("start") == F.col("c_start")) & (F.col("key") == F.col("c_key"))
    plain = ring.join(crowded, on, "left_anti").withColumn("mask", F.lit(-1))
    bits = F.array(*[F.lit(b) for b in range(8 * exact, 8 * single)])
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("mask"))
    masked = F.col("turned").bitwiseAND(F.lit(_signed((1 << 8 * single) - 1))).bitwiseAND(F.bitwise_not(bit))
    dense = ring.join(crowded, on, "left_semi").withColumn("mask", F.explode(bits)).withColumn("key", masked)
    met = plain.unionByName(dense)
    a, b = met.alias("a"), met.alias("b")
    differ = F.col("a.turned").bitwiseXOR(F.col("b.turned"))
    pairs = a.join(b, (F.col("a.start") == F.col("b.start")) & (F.col("a.mask") == F.col("b.mask")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") > F.col("b.fp")))
    # a pair whose masked segments are equal meets under every mask: the first one counts
    once = (F.col("a.mask") == -1) | (F.col("a.mask") == 8 * exact) | (differ.bitwiseAND(F.lit(middle)) != 0)
    kept = once & (F.bit_count(differ) <= max_bits)
    for length in range(exact + 1, SEGMENTS):
        kept &= F.bit_count(differ.bitwiseAND(F.lit((1 << 8 * length) - 1))) <= _budget(length, max_bits)
    out = pairs.where(kept).select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v")).distinct()
    out._uses = [ring, crowded]
    return out


def group(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, tie, fp, root (a fingerprint of the group) and component_id for every row of ``docs``.

    component_id is the smallest doc_id that links reach, null where no row of the group has an id. Null and empty texts
    share fingerprint 0, which links like any other. Repeated rows stay; an empty table gives an empty result.
    """
    prints = as_table(fingerprints(docs), "fingerprints")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("low"))
    linked = links(prints, max_bits)
    pairs = as_table(linked, "links")
    drop_uses(linked)
    stars = connected_components(pairs).select(F.col("node").alias("s_fp"), "root")
    rooted = as_table(distinct.join(stars, F.col("fp") == F.col("s_fp"), "left").select(F.col("fp").alias("r_fp"), F.coalesce("root", "fp").alias("root"), "low"), "roots")
    drop_table(pairs)
    named = rooted.groupBy(F.col("root").alias("n_root")).agg(F.min("low").alias("component_id"))
    of = rooted.join(named, F.col("root") == F.col("n_root")).select("r_fp", "root", "component_id")
    return prints.join(of, F.col("fp") == F.col("r_fp")).select("doc_id", "tie", "fp", "root", "component_id")


def fingerprint_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_one(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs``, all columns as they are, of which one document of each group stays: the smallest doc_id (null
    last), then by text; of identical rows one."""
    return keep_lowest(docs, group(docs, max_bits))


def keep_lowest(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of ``docs`` that :func:`keep_one` leaves of ``groups`` (doc_id, tie, root)."""
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "tie")
    least = groups.groupBy("root").agg(F.min(order).alias("o")).select(F.col("o.doc_id").alias("k_id"), F.col("o.tie").alias("k_tie"))
    # of identical rows, which are few of all, one stays; all other texts are moved once
    several = groups.groupBy(F.col("doc_id").alias("s_id"), F.col("tie").alias("s_tie")).agg(F.count("*").alias("rows")).where("rows > 1")
    kept = least.join(several, F.col("k_id").eqNullSafe(F.col("s_id")) & (F.col("k_tie") == F.col("s_tie")), "left").select("k_id", "k_tie", F.col("rows").isNotNull().alias("several"))
    kept = as_table(kept, "kept")
    mine = {c: f"in_{k}" for k, c in enumerate(docs.columns)}
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in mine.items()], F.col("doc_id").cast("long").alias("d_id"), F.xxhash64("text").alias("d_tie"))
    same = F.col("d_id").eqNullSafe(F.col("k_id")) & (F.col("d_tie") == F.col("k_tie"))
    alone = rows.join(kept.where("not several"), same, "left_semi")
    first = rows.join(kept.where("several"), same, "left_semi").dropDuplicates(["d_id", "d_tie"])
    return alone.unionByName(first).select(*[F.col(n).alias(c) for c, n in mine.items()])
