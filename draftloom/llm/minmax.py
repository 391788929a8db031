"""Near copies by min-max hashing: sets of word shingles whose Jaccard similarity is 0.8 or more, and their components.

Each permutation of the shingles gives two values of a set, its minimum and its maximum, so 64 permutations make a signature of
128 values, whose share of equal ones estimates the similarity without bias and varies less than with 128 minima. Sets
meet under bands of four values; sizes, parity sketches and at last whole sets decide, so nothing that is linked is wrong.
Joins whose sides grow with the documents ask for a merge join, so that a plan is the same for any size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import as_table, drop_table, release_shuffles, small_batches, text_bytes

SEED = 42
#: The least similarity, 4/5, in whole numbers.
PART, WHOLE = 4, 5
#: Permutations, and values of a band: the two of two permutations.
PERMUTATIONS, BAND = 64, 4
BANDS = 2 * PERMUTATIONS // BAND
#: Under one key, sets are compared pair by pair while that is at most this many comparisons a set; else by their rarest shingles.
PER_SET = 32
#: Shingles of the most sets of a crowd, which are looked up in each set's row, and shingles that a task counts at once to find them.
COMMON, COUNTED = 1_024, 1 << 20
#: Fewest bits of a set's sketch, each the parity of the shingles that fall to it. Sketches have twice a set's size or more.
SKETCH = 1_024


def _odd_numbers(n: int, seed: int) -> np.ndarray:
    """``n`` fixed odd multipliers."""
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)


_TIMES, _PLUS = _odd_numbers(PERMUTATIONS, 1), _odd_numbers(PERMUTATIONS, 2)


def hashed_shingles(data: bytes, shingle: int, seed: int = SEED) -> np.ndarray:
    """The shingles of a text as 64-bit hashes, repeats included: A-Z lower-cased, words cut at ASCII white space. Too few words:
    one shingle of all; no words: none."""
    import xxhash

    words = data.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    pieces = [b" ".join(words)] if len(words) <= shingle else list(map(b" ".join, zip(*[words[k:] for k in range(shingle)], strict=False)))
    return np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(seed)), np.uint64, len(pieces))


def shingles(data: bytes, shingle: int) -> np.ndarray:
    """The different shingles of a text, sorted."""
    return np.unique(hashed_shingles(data, shingle).view(np.int64))


def signature(hashes: np.ndarray) -> np.ndarray:
    """Minimum and maximum of a set under each permutation, two columns. Each permutation is evaluated once a shingle."""
    low = np.full(PERMUTATIONS, ~np.uint64(0))
    high = np.zeros(PERMUTATIONS, np.uint64)
    for at in range(0, len(hashes), 1_024):
        values = hashes[at : at + 1_024, None].view(np.uint64) * _TIMES + _PLUS
        np.minimum(low, values.min(axis=0), out=low)
        np.maximum(high, values.max(axis=0), out=high)
    return np.stack([low, high], axis=1)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band of a set's signature; none of the empty set."""
    if not len(hashes):
        return np.empty(0, np.int64)
    values = signature(hashes).reshape(BANDS, BAND)
    keys = np.arange(BANDS, dtype=np.uint64)
    for k in range(BAND):
        keys = (keys ^ values[:, k]) * _TIMES[0]
        keys ^= keys >> np.uint64(32)
    return keys.view(np.int64)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Parities of a set's shingles by their low bits: two sets differ in as many shingles as parities, at least. A sketch whose
    halves are combined by exclusive or is the sketch of half the width."""
    width = SKETCH
    while width < 2 * len(hashes):
        width *= 2
    odd = np.bincount(hashes & (width - 1), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def prints(docs: DataFrame, shingle: int, vote: Callable[[np.ndarray], int] | None = None) -> DataFrame:
    """doc_id, tie (a hash of the text), sid (a hash of the set), n (its size), sketch, keys (of its bands), and fp, what ``vote``
    makes of all shingles. Row-wise, whole texts; null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        longs = pa.list_(pa.int64())
        for batch in batches:
            hashed = [hashed_shingles(t, shingle) for t in batch.column(2).to_pylist()]
            sets = [np.unique(h.view(np.int64)) for h in hashed]
            sids = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            fps = np.array([vote(h) if vote else 0 for h in hashed], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(sids), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([sketch(s) for s in sets], longs), pa.array([band_keys(s) for s in sets], longs), pa.array(fps),
            ], ["doc_id", "tie", "sid", "n", "sketch", "keys", "fp"])

    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), text_bytes().alias("data"))
    return rows.mapInArrow(run, "doc_id long, tie long, sid long, n long, sketch array<long>, keys array<long>, fp long")


def near_sizes(a: Column, b: Column) -> Column:
    return F.least(a, b) * WHOLE >= F.greatest(a, b) * PART


def _folded(sketch: Column, size: Column) -> Column:
    """A sketch at the width of one of half as many longs."""
    return F.when(F.size(sketch) > size, F.zip_with(F.slice(sketch, F.lit(1), size), F.slice(sketch, size + 1, size), lambda x, y: x.bitwiseXOR(y))).otherwise(sketch)


def may_be_alike(a: str, b: str) -> Column:
    """Whether sizes and sketches leave it open that two sets are similar: it loses no pair. Cheap tests stand first."""
    n = F.col(f"{a}n") + F.col(f"{b}n")
    x, y = F.col(f"{a}sketch"), F.col(f"{b}sketch")
    width = F.least(F.size(x), F.size(y))
    differ = F.aggregate(F.zip_with(_folded(x, width), _folded(y, width), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda total, k: total + k)
    return near_sizes(F.col(f"{a}n"), F.col(f"{b}n")) & ((PART + WHOLE) * differ <= (WHOLE - PART) * n)


def _named(sets: DataFrame, side: str) -> DataFrame:
    return sets.select(*[F.col(c).alias(f"{side}_{c}") for c in ("sid", "n", "sketch")])


def _close(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``pairs`` (u > v: sids) that sizes and sketches leave open, as a table."""
    both = pairs.join(_named(sets, "a"), F.col("u") == F.col("a_sid")).join(_named(sets, "b"), F.col("v") == F.col("b_sid"))
    return as_table(both.where(may_be_alike("a_", "b_")).select("u", "v"), "close")


def _whole_sets(docs: DataFrame, found: DataFrame, asked: DataFrame, shingle: int) -> DataFrame:
    """sid, hashes of the sets in ``asked`` (sid), as a table: texts of one document each are read again, and moved once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = pa.array([shingles(t, shingle) for t in batch.column(1).to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), sets], ["sid", "hashes"])

    one = found.join(asked, "sid", "left_semi").groupBy("sid").agg(F.min(F.struct("doc_id", "tie")).alias("o"))
    one = as_table(one.select("sid", F.col("o.doc_id").alias("o_id"), F.col("o.tie").alias("o_tie")), "asked")
    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("d_id"), F.xxhash64("text").alias("d_tie"), text_bytes().alias("data"))
    texts = rows.hint("merge").join(one, F.col("d_id").eqNullSafe(F.col("o_id")) & (F.col("d_tie") == F.col("o_tie"))).select("sid", "data")
    # rows of one id and text are the same set: one of them is enough, and few are such
    sets = as_table(texts.mapInArrow(run, "sid long, hashes array<long>").dropDuplicates(["sid"]), "sets")
    drop_table(one)
    release_shuffles(docs.sparkSession)
    return sets


def _links(close: DataFrame, whole: DataFrame) -> DataFrame:
    """Those of ``close`` whose whole sets are similar, as a table; ``close`` goes."""
    a, b = whole.select(F.col("sid").alias("a_sid"), F.col("hashes").alias("a")), whole.select(F.col("sid").alias("b_sid"), F.col("hashes").alias("b"))
    both = close.join(a.hint("merge"), F.col("u") == F.col("a_sid")).join(b.hint("merge"), F.col("v") == F.col("b_sid"))
    found = as_table(both.where((PART + WHOLE) * F.size(F.array_intersect("a", "b")) >= PART * (F.size("a") + F.size("b"))).select("u", "v"), "links")
    drop_table(close)
    return found


def _shared(members: DataFrame) -> DataFrame:
    """Of ``members`` (key, sid) those whose key several sets have, with the smallest of these, as a table."""
    lows = members.groupBy(F.col("key").alias("l_key")).agg(F.min("sid").alias("low"), F.max("sid").alias("high")).where("low < high")
    lows = as_table(lows.select("l_key", "low"), "lows")  # a table, so that Spark can split a hot key of the join with it
    met = as_table(members.hint("merge").join(lows, F.col("key") == F.col("l_key")).select("key", "sid", "low").distinct(), "met")
    drop_table(lows)
    return met


def _pairs(u: str, v: str) -> list[Column]:
    return [F.greatest(u, v).alias("u"), F.least(u, v).alias("v")]


def _roots(links: DataFrame) -> DataFrame:
    return connected_components(links).select(F.col("node").alias("r_sid"), "root")


def _unsettled(met: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members of keys whose sets are not yet in one component: with their roots, where the open pairs are at most ``PER_SET`` a
    set, and the sets alone of more crowded keys."""
    placed = as_table(met.join(roots, F.col("sid") == F.col("r_sid"), "left").select("key", "sid", F.coalesce("root", "sid").alias("root")), "placed")
    of_key = placed.groupBy("key", "root").agg(F.count("*").alias("c")).groupBy(F.col("key").alias("k_key")).agg(F.sum("c").alias("rows"), F.sum(F.col("c").cast("double") * F.col("c")).alias("same"), F.count("*").alias("roots"))
    open_keys = as_table(of_key.where("roots > 1").select("k_key", ((F.col("rows").cast("double") * F.col("rows") - F.col("same")) / 2 > PER_SET * F.col("rows")).alias("crowded")), "open")
    rows = as_table(placed.join(open_keys, F.col("key") == F.col("k_key")).select("key", "sid", "root", "crowded"), "unsettled")
    drop_table(placed)
    drop_table(open_keys)
    return rows.where("not crowded").drop("crowded"), rows.where("crowded").select("sid").distinct()


def _joined_roots(roots: DataFrame, more: DataFrame) -> DataFrame:
    """``roots`` (r_sid, root) after the links of the table ``more``, whose components are those of the roots they join; it goes."""
    if more.isEmpty():
        drop_table(more)
        return roots
    of = roots.select(F.col("r_sid").alias("x"), F.col("root").alias("x_root"))
    ends = more.join(of, F.col("u") == F.col("x"), "left").select(F.coalesce("x_root", "u").alias("u"), "v")
    ends = ends.join(of, F.col("v") == F.col("x"), "left").select("u", F.coalesce("x_root", "v").alias("v"))
    onto = as_table(connected_components(ends).select(F.col("node").alias("o_node"), F.col("root").alias("o_root")), "onto")
    moved = roots.join(onto, F.col("root") == F.col("o_node"), "left").select("r_sid", F.coalesce("o_root", "root").alias("root"))
    fresh = onto.join(roots, F.col("o_node") == F.col("r_sid"), "left_anti").select(F.col("o_node").alias("r_sid"), F.col("o_root").alias("root"))
    out = as_table(moved.unionByName(fresh), "roots")
    for table in (roots, more, onto):
        drop_table(table)
    return out


def own_prefix(n: Column) -> Column:
    """How many of the first shingles of a set of ``n`` are enough for larger similar ones to meet it.

    Two similar sets of a >= b shingles share 4/9 (a + b) or more, so 8/9 b or more: of b's shingles, all but that many, plus
    one, hold the first that both have; and so do all but 4/5 of a's, plus one.
    """
    return n - F.ceil(2 * PART * n / (PART + WHOLE)) + 1


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, c of shingles that sets of several components have (root, hashes), counted in runs of about ``COUNTED`` shingles."""

    def counted(sets: list[np.ndarray], roots: list[int]) -> pa.RecordBatch:
        keys, of = np.concatenate(sets), np.repeat(np.array(roots, np.int64), [len(s) for s in sets])
        order = np.argsort(keys)
        keys, of = keys[order], of[order]
        starts = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1))
        several = np.minimum.reduceat(of, starts) < np.maximum.reduceat(of, starts)
        c = np.diff(starts, append=len(keys))
        return pa.RecordBatch.from_arrays([pa.array(keys[starts][several]), pa.array(c[several])], ["key", "c"])

    sets, roots, held = [], [], 0
    for batch in batches:
        for root, hashes in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            sets.append(hashes.values.to_numpy())
            roots.append(root)
            held += len(sets[-1])
            if held >= COUNTED:
                yield counted(sets, roots)
                sets, roots, held = [], [], 0
    if held:
        yield counted(sets, roots)


def places(n: Column) -> Column:
    """How many of the first shingles of a set of ``n``, in any order that is the same for all sets, hold one of those that it shares
    with a similar set: these are 4/5 of it or more."""
    return n - F.ceil(PART * n / WHOLE) + 1


def _firsts(sized: DataFrame) -> DataFrame:
    """key, at, sid, n, hot: the first shingles of the sets of ``sized`` (sid, n, root, hashes) that sets of other components have
    among their first, as a table.

    In this order the shingles that most sets have stand last, as far as ``COMMON`` of them, and others in the order of their
    hashes; so a set makes a row for a fifth of its shingles, whatever it shares with very many others. Counts, which are of runs of sets,
    decide about the order alone. Keys of many sets that are not known as common are ``hot``.
    """
    late = small_batches(sized.select("root", "hashes")).mapInArrow(_repeated, "key long, c long").groupBy("key").agg(F.sum("c").alias("c"))
    ranked = np.array([r.key for r in late.orderBy(F.desc("c"), F.desc("key")).limit(COMMON).collect()][::-1], np.int64)
    by_key = np.argsort(ranked)

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, known = [], []
            for count, hashes in zip(batch.column(3).to_pylist(), batch.column(4), strict=True):
                hashes = hashes.values.to_numpy()
                common = np.isin(hashes, ranked)
                keys.append(np.concatenate([hashes[~common], ranked[np.sort(by_key[np.searchsorted(ranked[by_key], hashes[common])])]])[:count])
                known.append(len(hashes) - int(common.sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(known, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["sid", "n", "root", "known", "keys"])

    rows = small_batches(sized.select("sid", "n", "root", places(F.col("n")).alias("count"), "hashes"))
    rows = rows.mapInArrow(firsts, "sid long, n long, root long, known long, keys array<long>").select("sid", "n", "root", "known", F.posexplode("keys").alias("at", "key"))
    rows = as_table(rows.select("sid", "n", "root", F.col("at").cast("long").alias("at"), "key", (F.col("at") >= F.col("known")).alias("common")), "firsts")
    joining = rows.groupBy(F.col("key").alias("j_key")).agg(F.count("*").alias("c"), F.max("common").alias("common"), (F.min("root") < F.max("root")).alias("joins")).where("joins")
    # a table, so that Spark can split a hot key of the join with it
    joining = as_table(joining.select("j_key", (~F.col("common") & (F.col("c") > 2 * PER_SET)).alias("hot")), "joining")
    out = as_table(rows.join(joining, F.col("key") == F.col("j_key")).select("key", "at", "sid", "n", "hot"), "joining-firsts")
    drop_table(rows)
    drop_table(joining)
    return out


def _rare_shingles(whole: DataFrame, crowd: DataFrame, roots: DataFrame) -> DataFrame:
    """key, at, own, sid, n: the first shingles of each set of ``crowd`` (sid) that join it to other components, as a table.

    Similar sets share one of the first, in any order that is the same for both. That of :func:`_firsts` is enough, but for its hot keys:
    two sets that share one both go through :func:`_by_counts`, in whose order exact counts put it behind rarer ones.
    """
    sized = whole.join(crowd, "sid", "left_semi").join(roots, F.col("sid") == F.col("r_sid"), "left")
    sized = as_table(sized.select("sid", F.size("hashes").cast("long").alias("n"), F.coalesce("root", "sid").alias("root"), "hashes"), "crowd")
    firsts = _firsts(sized)
    rows = firsts.where("not hot").select("key", "at", "sid", "n")
    hot = as_table(sized.join(firsts.where("hot").select("sid").distinct(), "sid", "left_semi"), "hot")
    counted = None if hot.isEmpty() else _by_counts(hot)
    out = as_table((rows if counted is None else rows.unionByName(counted)).withColumn("own", F.col("at") < own_prefix(F.col("n"))), "rare")
    for table in (sized, firsts, hot, *([] if counted is None else [counted])):
        drop_table(table)
    return out


def _by_counts(sized: DataFrame) -> DataFrame:
    """key, at, sid, n: the first shingles of each set of ``sized`` (sid, n, root, hashes), those that tell it from others first, as a table.

    The order is the same for all sets: shingles of one component alone, which join nothing, then others, rarest first by their exact
    counts here. Similar sets share one of the first, and what a set shares with very many others stands last. Only shingles of
    several components are keys, the rest take a place each; where shingles of one set alone fill all places, which is so for most sets that
    share a passage and nothing else, the set needs no more: it has no similar one. A set whose first shingles are common
    holds little else, and is similar to the like of it. The ``COMMON`` most common keys are one list, in order, that is met with each
    set in its row, so a passage that a crowd shares is not a row of each set and shingle; only rarer keys are joined.
    """
    counts = sized.select("sid", "root", F.explode("hashes").alias("c_key")).groupBy("c_key").agg(F.count("*").alias("c"), F.min("sid").alias("one"), (F.min("root") < F.max("root")).alias("joins"))
    counts = as_table(counts, "counts")
    alone = counts.where("c = 1").groupBy(F.col("one").alias("a_sid")).agg(F.count("*").alias("alone"))
    enough = places(F.col("n"))
    needy = as_table(sized.join(alone, F.col("sid") == F.col("a_sid"), "left").where(F.coalesce("alone", F.lit(0)) < enough).select("sid", "n", enough.alias("places"), "hashes"), "needy")
    most = counts.where("joins").orderBy(F.desc("c"), F.desc("c_key")).limit(COMMON).agg(F.array_sort(F.collect_list(F.struct("c", "c_key"))).alias("m"))
    most = as_table(most.select(F.col("m.c_key").alias("most")), "most")
    met = needy.join(F.broadcast(most), F.lit(True))  # one row
    asked = met.select("sid", F.explode(F.array_except("hashes", "most")).alias("key"))
    rarer = asked.hint("merge").join(counts.where("joins").select("c_key", "c"), F.col("key") == F.col("c_key"))
    rarer = rarer.groupBy(F.col("sid").alias("r_sid")).agg(F.array_sort(F.collect_list(F.struct("c", "key"))).alias("rarer"))
    common = met.select("sid", "n", "places", F.array_intersect("most", "hashes").alias("common"))
    both = common.join(rarer, F.col("sid") == F.col("r_sid"), "left")
    firsts = both.select("sid", "n", "places", F.concat(F.coalesce("rarer.key", F.expr("array()")), "common").alias("shared")).withColumn("before", F.col("n") - F.size("shared"))
    each = F.posexplode(F.slice("shared", F.lit(1), F.greatest(F.col("places") - F.col("before"), F.lit(0)).cast("int")))
    keyed = firsts.select("sid", "n", "before", each.alias("k", "key")).select("key", (F.col("before") + F.col("k")).alias("at"), "sid", "n")
    out = as_table(keyed, "counted")
    for table in (counts, needy, most):
        drop_table(table)
    return out


def similar_sets(docs: DataFrame, found: DataFrame, shingle: int, first: DataFrame | None = None) -> DataFrame:
    """sid, root: of the sets in ``found`` (a table of :func:`prints`) that have a similar one, the smallest set of their component.

    Two sets at 0.8 share a band with a probability of 0.41, so they miss all 32 with one of 5 in 10^8. One set of each key
    is held against all others first; what is then not in one component is compared pair by pair, if these are at most
    ``PER_SET`` comparisons a set. The sets of more crowded keys, such as that of a passage in very many documents that are
    otherwise different, meet under their rarest shingles instead, which loses no pair, again one of each key first. Bands cannot
    tell such sets apart: at 0.6 they share four of 32. ``first``: pairs (u, v) of sets that are candidates
    too. Exact but for that probability and collisions of 64-bit hashes: whole sets decide.
    """
    rows = found.where("n > 0")
    met = _shared(rows.select(F.explode("keys").alias("key"), "sid"))
    asked = met.select("sid")
    if first is not None:
        asked = asked.unionByName(first.select(F.col("u").alias("sid"))).unionByName(first.select(F.col("v").alias("sid")))
    asked = as_table(asked.distinct(), "asked-sets")
    # most sets share no key: what follows reads the others alone
    sets = rows.select("sid", "n", "sketch", "tie").hint("merge").join(asked, "sid", "left_semi").groupBy("sid").agg(F.min_by(F.struct("n", "sketch"), "tie").alias("s"))
    sets = as_table(sets.select("sid", "s.n", "s.sketch"), "shared-sets")
    whole = _whole_sets(docs, found, asked, shingle)
    stars = met.where("sid > low").select(F.col("sid").alias("u"), F.col("low").alias("v"))
    pairs = (stars if first is None else stars.unionByName(first.select(*_pairs("u", "v")).where("u > v"))).distinct()
    links = _links(_close(pairs, sets), whole)
    roots = as_table(_roots(links), "roots")
    drop_table(links)
    few, crowd = _unsettled(met, roots)
    drop_table(met)
    if not few.isEmpty():
        rows = as_table(few.join(_named(sets, "s"), F.col("sid") == F.col("s_sid")).select("key", "sid", "root", F.col("s_n").alias("n"), F.col("s_sketch").alias("sketch")), "few")
        a, b = rows.alias("a"), rows.alias("b")
        on = (F.col("a.key") == F.col("b.key")) & (F.col("a.sid") > F.col("b.sid")) & (F.col("a.root") != F.col("b.root")) & may_be_alike("a.", "b.")
        close = as_table(a.join(b, on).select(F.col("a.sid").alias("u"), F.col("b.sid").alias("v")).distinct(), "close")
        drop_table(rows)
        roots = _joined_roots(roots, _links(close, whole))
    if not crowd.isEmpty():
        rare = _rare_shingles(whole, crowd, roots)
        lows = rare.where("own").groupBy(F.col("key").alias("l_key")).agg(F.min(F.struct("sid", "n")).alias("low"))
        lows = as_table(lows.select("l_key", F.col("low.sid").alias("l_sid"), F.col("low.n").alias("l_n")), "lows")
        stars = rare.join(lows, (F.col("key") == F.col("l_key")) & (F.col("sid") != F.col("l_sid")) & near_sizes(F.col("n"), F.col("l_n")))
        roots = _joined_roots(roots, _links(_close(stars.select(*_pairs("sid", "l_sid")).distinct(), sets), whole))
        roots = _joined_roots(roots, _links(_open_pairs(rare, roots, sets), whole))
        drop_table(lows)
        drop_table(rare)
    for table in (sets, whole, asked):
        drop_table(table)
    return roots.select(F.col("r_sid").alias("sid"), "root")


def _open_pairs(rare: DataFrame, roots: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs that are not yet in one component, as a table: under each key, sets with those of at most their size that own it.

    The key is the first shingle that two similar sets share, so as many as follow it, in either, have to reach 4/9 of both.
    Sketches are part of the join's condition, so sets that only share a key make no rows.
    """
    placed = as_table(rare.join(roots, F.col("sid") == F.col("r_sid"), "left").select("key", "at", "own", "sid", "n", F.coalesce("root", "sid").alias("root")), "placed")
    mixed = as_table(placed.groupBy(F.col("key").alias("m_key")).agg(F.min("root").alias("low"), F.max("root").alias("high"), F.max("own").alias("owned")).where("low < high and owned").select("m_key"), "mixed")
    rows = placed.join(mixed, F.col("key") == F.col("m_key"), "left_semi").join(sets.select(F.col("sid").alias("s_sid"), "sketch"), F.col("sid") == F.col("s_sid"))
    rows = as_table(rows.select("key", "at", "own", "sid", "n", "root", "sketch"), "mixed-rows")
    a, b = rows.alias("a"), rows.where("own").alias("b")
    follow = F.least(F.col("a.n") - F.col("a.at"), F.col("b.n") - F.col("b.at"))
    on = (F.col("a.key") == F.col("b.key")) & (F.col("a.root") != F.col("b.root")) & (F.col("a.n") >= F.col("b.n"))
    on &= ((PART + WHOLE) * follow >= PART * (F.col("a.n") + F.col("b.n"))) & may_be_alike("a.", "b.")
    close = as_table(a.join(b, on).select(*_pairs("a.sid", "b.sid")).distinct(), "close")
    for table in (placed, mixed, rows):
        drop_table(table)
    return close


def near_copies(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id, n_shingles (the size of the set), component_id, kept for every row of ``docs`` (doc_id, text).

    component_id is the smallest doc_id that links reach, the row's own included; null where no row of the component has an id.
    kept is true where it is the row's own. Texts with fewer than ``shingle`` words are one shingle; null texts and texts without words have an
    empty set, which links with nothing, not even with its like. Repeated rows stay, in one component. Very long texts are
    read whole. Other columns are dropped; an empty table gives an empty result.
    """
    found = as_table(prints(docs, shingle), "prints")
    roots = similar_sets(docs, found, shingle).select(F.col("sid").alias("r_sid"), "root")
    lows = found.where("n > 0").groupBy("sid").agg(F.min("doc_id").alias("low"))
    rooted = as_table(lows.join(roots, F.col("sid") == F.col("r_sid"), "left").select("sid", "low", F.coalesce("root", "sid").alias("root")), "rooted")
    ids = rooted.groupBy(F.col("root").alias("i_root")).agg(F.min("low").alias("id"))
    # a table, so that Spark can split a set of very many documents in the join with it
    named = as_table(rooted.join(ids, F.col("root") == F.col("i_root")).select(F.col("sid").alias("n_sid"), "id"), "named")
    drop_table(rooted)
    linked = found.where("n > 0").select("doc_id", "sid", "n").join(named, F.col("sid") == F.col("n_sid")).select("doc_id", "n", F.col("id").alias("component_id"))
    alone = found.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
