"""Suffix-array dedup: bytes covered by strings of a given length that start more than once anywhere.

A string's anchor is the K-byte gram of smallest hash in it (the leftmost of equal ones), which is the same wherever the
string stands. A context is a maximal run of window starts with one anchor, and the text that these windows cover. Only
contexts whose anchor hash occurs again can hold a repeated string. Equal contexts are merged, with their number, before
any text is moved.

Contexts are sorted by anchor and by the text left of it, and dealt out by range, so every shard is a sorted run of about
``SHARD_BYTES``, whatever the number of contexts of an anchor. A shard's suffix array is refined by doubling, its common
prefixes follow, and windows that share the full length with a neighbour repeat. Only an anchor at either end of a run can
go on in another shard. There, a window can stand in another shard only if the text left of its anchor is also that of the
run's first or last context; binary search in the run finds the contexts that share so much with them. What is left open
is sorted once more by the text right of the anchor, merged the same way, and what even then reaches over an end is
counted window by window.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import as_table, drop_table, release_shuffles, small_batches, text_bytes

LENGTH = 200
GRAM = 32  # bytes of an anchor, a power of two; LENGTH must be twice that or more
#: Bytes of text under one suffix array.
SHARD_BYTES = 1_000_000

_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_PLACE = 20  # low bits of a sort key that hold a place, so that of equal hashes the leftmost is smallest
_BLOCK = (1 << _PLACE) - 1


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def grams(data: np.ndarray, length: int, base: np.uint64 = _P) -> np.ndarray:
    """Polynomial hash of each ``length``-byte gram (a power of two), by doubling."""
    h, m, power = data.astype(np.uint64) + np.uint64(1), 1, base
    with np.errstate(over="ignore"):
        while m < length:
            h = h[:-m] * power + h[m:]
            power = power * power
            m *= 2
    return h


def _window_min(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive keys, from running minima of blocks to both sides."""
    n = len(keys)
    blocks = np.concatenate([keys, np.full(-n % width, np.uint64(2**64 - 1))]).reshape(-1, width)
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def contexts_of(data: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(anchor hash, context digest, first window start, number of windows, bytes before the anchor) of each context of a text."""
    out: list[tuple[np.ndarray, ...]] = []
    for begin in range(0, max(len(data) - length + 1, 0), _BLOCK - length + 1):
        raw = np.frombuffer(data[begin : begin + _BLOCK], np.uint8)
        if len(raw) < length:
            break
        g = grams(raw, gram)
        h = _mix(g)
        low = np.uint64(_BLOCK)
        keys = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        place = (_window_min(keys, length - gram + 1) & low).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        count = np.diff(np.append(first, len(place)))
        last = first + count - 1 + length - gram  # start of the last gram of the context
        digest = count.astype(np.uint64)
        with np.errstate(over="ignore"):
            for k in range(0, 2 * length, gram):
                digest = (digest ^ (digest >> np.uint64(31))) * _Q + g[np.minimum(first + k, last)]
        out.append((h[place[first]].view(np.int64), _mix(digest).view(np.int64), first + begin, count, place[first] - first))
    if not out:
        return tuple(np.empty(0, np.int64) for _ in range(5))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def suffix_ranks(text: np.ndarray, room: np.ndarray, depths: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Larsson-Sadakane refinement: the places of ``text`` sorted by their first 8 bytes, then groups of equal ones by the
    rank of the place that the depth so far is ahead, which doubles it; places alone in their group are done.

    ``room`` is how many bytes of its context a place has from it on; places take part up to a depth within their room.
    ``depths``: rising, each at most twice the one before; the first is 8. Returns the 8-byte keys, the ranks at the last
    depth, and the places that are not alone there, in rank order.
    """
    wide = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    key = np.zeros(len(text), np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | wide[k : k + len(text)]
    rank = np.zeros(len(text), np.int64)
    places = np.flatnonzero(room >= 8)
    order = places[np.argsort(key[places])]
    equal, base = key[order], np.zeros(len(order), np.int64)
    for step, depth in enumerate(depths):
        if not len(order):
            break
        head = np.concatenate([[True], equal[1:] != equal[:-1]])
        heads = np.flatnonzero(head)
        sizes = np.diff(np.append(heads, len(order)))
        # a group's rank: where its old group starts, plus its place in there
        within = heads - np.repeat(*_runs(base))[heads] if step else heads
        rank[order] = np.repeat(base[heads] + within, sizes)
        order = order[np.repeat(sizes > 1, sizes)]
        if step + 1 == len(depths):
            break
        order = order[room[order] >= depths[step + 1]]
        pair = (rank[order].astype(np.uint64) << np.uint64(32)) | rank[order + depths[step + 1] - depth].astype(np.uint64)
        by = np.argsort(pair)
        order, equal = order[by], pair[by]
        base = rank[order].copy()
    return key, rank, order


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For np.repeat: the start of each run of equal values, and its length."""
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return starts, np.diff(np.append(starts, len(values)))


def _prefix(key: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the places a and b, 8 bytes at a time, at most ``most``."""
    out, live = most.copy(), np.arange(len(a))
    at = 0
    while len(live):
        live = live[most[live] > at]
        x = key[np.minimum(a[live] + at, len(key) - 1)] ^ key[np.minimum(b[live] + at, len(key) - 1)]
        stop = x != 0
        if stop.any():
            where, y = live[stop], x[stop]
            same = sum(((y >> np.uint64(8 * k)) == 0).astype(np.int64) for k in range(1, 8))  # leading bytes that agree
            out[where] = np.minimum(most[where], at + same)
        live = live[~stop]
        at += 8
    return out


def common_prefixes(key: np.ndarray, room: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For sorted places, the common prefix of each with the one before it (0 for the first), within their room.

    Kasai's walk in text order, as array steps: where a place's predecessor is one ahead of the predecessor of the place
    before, its prefix is one shorter and need not be compared; only the heads of such runs are compared.
    """
    out = np.zeros(len(key), np.int64)
    if len(order) < 2:
        return out
    before = np.full(len(key) + 1, -1, np.int64)
    before[order[1:]] = order[:-1]
    walk = np.sort(order[1:])
    left = np.minimum(room[walk], room[before[walk]])
    head = np.ones(len(walk), bool)
    head[1:] = (walk[1:] != walk[:-1] + 1) | (before[walk[1:]] != before[walk[:-1]] + 1) | (left[1:] != left[:-1] - 1)
    value = np.zeros(len(walk), np.int64)
    todo = head
    while todo.any():
        k = np.flatnonzero(todo)
        value[k] = _prefix(key, walk[k], before[walk[k]], left[k])
        heads = np.flatnonzero(head)
        run = np.repeat(heads, np.diff(np.append(heads, len(walk))))
        value = np.where(head, value, value[run] - (np.arange(len(walk)) - run))
        # past a mismatch the walk knows nothing: those start runs of their own
        spent = ~head & (value <= 0)
        todo = np.zeros(len(walk), bool)
        f = np.flatnonzero(spent)
        if len(f):
            todo[f[np.concatenate([[True], run[f][1:] != run[f][:-1]])]] = True
            head = head | todo
    out[walk] = value
    return out


def _depths(length: int) -> tuple[int, ...]:
    out = [8]
    while out[-1] < length:
        out.append(min(2 * out[-1], length))
    return tuple(out)


def repeated_windows(contexts: list[bytes], counts: np.ndarray, length: int, asked: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Over all windows of the contexts, one after another: whether each repeats here (or its context counts more than
    once), whether it stands for its equals here, and the place of each context's first window, with the end of the last.
    With ``asked``, a flag for each window, the others take no part."""
    sizes = np.array([len(c) for c in contexts], np.int64)
    text = np.frombuffer(b"".join(contexts), np.uint8)
    starts = np.cumsum(sizes) - sizes
    room = np.repeat(starts + sizes, sizes) - np.arange(len(text))
    window = room >= length
    key, _, order = suffix_ranks(text, room, _depths(length))
    takes_part = window.copy()
    if asked is not None:
        takes_part[window] = asked
    order = order[takes_part[order]]
    prefix = common_prefixes(key, room, order)
    full = prefix[order] >= length
    again, speaks = np.zeros(len(text), bool), takes_part
    again[order[full]] = True
    again[order[np.flatnonzero(full) - 1]] = True
    speaks[order[full]] = False
    again |= np.repeat(np.asarray(counts) > 1, sizes)
    return again[window], speaks[window], np.concatenate([[0], np.cumsum(sizes - length + 1)])


def shared_with_ends(side: list[bytes], anchors: list[int], most: int) -> list[int]:
    """For each context of a run sorted by (anchor, side), how many bytes of its side, at most ``most``, a context of another
    run can share: as many as it shares with the run's first or last context; -1 where the anchor is at neither end.

    Sorted, the contexts that share the first k bytes with an end are a stretch from that end on. Binary search finds where
    it stops, for each k.
    """
    out = [-1] * len(side)
    first, last = bisect_right(anchors, anchors[0]), bisect_left(anchors, anchors[-1])
    stop = first
    for k in range(min(most, len(side[0])) + 1):
        stop = bisect_right(side, side[0][:k], 0, stop, key=lambda s: s[:k])  # noqa: B023
        for c in range(stop):
            out[c] = k
        if stop == 1:  # the end alone: it may share all it has
            break
    out[0] = min(most, len(side[0]))
    start = last
    for k in range(min(most, len(side[-1])) + 1):
        start = bisect_left(side, side[-1][:k], start, len(side), key=lambda s: s[:k])  # noqa: B023
        for c in range(start, len(side)):
            out[c] = max(out[c], k)
        if start == len(side) - 1:
            break
    out[-1] = max(out[-1], min(most, len(side[-1])))
    return out


def window_digests(data: bytes, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of all bytes of each of the windows ``at``."""
    raw = np.frombuffer(data, np.uint8)
    half = 1 << (length.bit_length() - 1)
    out = []
    with np.errstate(over="ignore"):
        for base, other in ((_P, _Q), (_Q, _P)):
            g = grams(raw, half, base)
            out.append(_mix(_mix(g[at]) * other + g[at + length - half]).view(np.int64))
    return out[0], out[1]


def run_flags(runs: list[int], size: int) -> np.ndarray:
    """The flags of :func:`flag_runs`."""
    edge = np.zeros(size + 1, np.int8)
    edge[runs[::2]] += 1
    edge[runs[1::2]] -= 1
    return np.cumsum(edge[:-1]).astype(bool)


def flag_runs(flags: np.ndarray) -> list[int]:
    """[first, end, first, end, ...] of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return edge.tolist()


# -- Spark stages --


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, k_id and tie, which together tell rows apart (identical rows share them), and the bytes."""
    doc_id = F.col("doc_id").cast("long")
    return small_batches(docs).select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(0)).alias("k_id"), F.xxhash64(doc_id, F.col("text")).alias("tie"), text_bytes().alias("data"))


def _all_contexts(docs: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [contexts_of(t, length) for t in batch.column(2).to_pylist()]
            if not found:
                continue
            each = np.array([len(f[0]) for f in found])
            ids = [pa.array(np.repeat(batch.column(k).to_numpy(), each)) for k in (0, 1)]
            anchor, digest, first, count, lead = (np.concatenate([f[k] for f in found]) for k in range(5))
            yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(digest), *ids, *[pa.array(c.astype(np.int32)) for c in (first, count, lead)]], ["anchor", "digest", "k_id", "tie", "first", "windows", "lead"])

    return _keyed(docs).select("k_id", "tie", "data").mapInArrow(run, "anchor long, digest long, k_id long, tie long, first int, windows int, lead int")


def _cut_contexts(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """Each wanted context with its text up to the anchor, backwards, and from the anchor on."""
    rows = wanted.groupBy(F.col("at.k_id").alias("w_id"), F.col("at.tie").alias("w_tie")).agg(F.collect_list(F.struct("anchor", "digest", "n", "at.first", "at.windows", "at.lead")).alias("wanted"))
    # identical rows are one before they are moved
    texts = _keyed(docs).groupBy("k_id", "tie").agg(F.first("data").alias("data"))
    joined = texts.join(rows, (F.col("k_id") == F.col("w_id")) & (F.col("tie") == F.col("w_tie"))).select("data", "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, want in zip(batch.column(0), batch.column(1), strict=True):
                data, want = data.as_py(), want.values
                col = {f: want.field(f) for f in ("anchor", "digest", "n", "first", "windows", "lead")}
                places = list(zip(*[col[f].to_pylist() for f in ("first", "windows", "lead")], strict=True))
                left = [data[a : a + lead][::-1] for a, _, lead in places]
                right = [data[a + lead : a + w + length - 1] for a, w, lead in places]
                yield pa.RecordBatch.from_arrays([col["anchor"], col["digest"], col["n"], pa.array(left, pa.binary()), pa.array(right, pa.binary())], ["anchor", "digest", "n", "before", "after"])

    return joined.mapInArrow(run, "anchor long, digest long, n long, before binary, after binary")


def _runs_of(sorted_rows: DataFrame, solve, schema: str, shard_bytes: int) -> DataFrame:
    """``solve`` over runs of about ``shard_bytes`` of the sorted rows of each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                rows.append(row)
                size += len(row[3]) + len(row[4])
                if size >= shard_bytes:
                    yield solve(rows)
                    rows, size = [], 0
        if rows:
            yield solve(rows)

    return sorted_rows.mapInArrow(run, schema)


def _first_runs(contexts: DataFrame, length: int, shard_bytes: int) -> DataFrame:
    """Runs sorted by the text left of the anchor. Of each context: ``runs`` of windows that repeat in its run, and, of those
    that stand for their equals here, ``open`` runs of windows that may stand in another run; with the text where any are."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        anchor, digest, n, before, after = map(list, zip(*rows, strict=True))
        again, speaks, ends = repeated_windows([b[::-1] + a for b, a in zip(before, after, strict=True)], np.array(n), length)
        reach = shared_with_ends(before, anchor, length)
        runs, left_open = [], []
        for k, most in enumerate(reach):
            a, b = ends[k], ends[k + 1]
            runs.append(flag_runs(again[a:b]))
            if most >= 0:
                speaks[a : min(b, a + max(0, len(before[k]) - most))] = False
            left_open.append(flag_runs(speaks[a:b]) if most >= 0 else [])
        keep = [bool(o) for o in left_open]
        ints = pa.list_(pa.int32())
        return pa.RecordBatch.from_arrays([
            pa.array(anchor, pa.int64()), pa.array(digest, pa.int64()), pa.array(runs, ints), pa.array(left_open, ints),
            *[pa.array([t if k else None for t, k in zip(side, keep, strict=True)], pa.binary()) for side in (before, after)],
        ], ["anchor", "digest", "runs", "open", "before", "after"])

    ranged = contexts.repartitionByRange("anchor", "before", "after").sortWithinPartitions("anchor", "before", "after").select("anchor", "digest", "n", "before", "after")
    return _runs_of(ranged, solve, "anchor long, digest long, runs array<int>, open array<int>, before binary, after binary", shard_bytes)


def _second_runs(contexts: DataFrame, length: int, shard_bytes: int) -> DataFrame:
    """The open windows of :func:`_first_runs` in runs sorted by the text right of the anchor. Of a window that is open at both
    sides, ``open`` has the place and two hashes of all its bytes."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        anchor, digest, asked_runs, before, after = map(list, zip(*rows, strict=True))
        texts = [b[::-1] + a for b, a in zip(before, after, strict=True)]
        asked = np.concatenate([run_flags(r, len(t) - length + 1) for r, t in zip(asked_runs, texts, strict=True)])
        again, speaks, ends = repeated_windows(texts, np.ones(len(rows), np.int64), length, asked)
        reach = shared_with_ends(after, anchor, length)
        runs, left_open = [], []
        for k, most in enumerate(reach):
            a, b = ends[k], ends[k + 1]
            runs.append(flag_runs(again[a:b]))
            # window w ends with byte w + length - len(before) of the text from the anchor on
            at = np.flatnonzero(speaks[a:b][: max(0, most - length + len(before[k]) + 1)]) if most >= 0 else np.empty(0, np.int64)
            one, two = window_digests(texts[k], at, length) if len(at) else (at, at)
            left_open.append([{"at": x, "one": y, "two": z} for x, y, z in zip(at.tolist(), one.tolist(), two.tolist(), strict=True)])
        return pa.RecordBatch.from_arrays([pa.array(anchor, pa.int64()), pa.array(digest, pa.int64()), pa.array(runs, pa.list_(pa.int32())), pa.array(left_open, kind)], ["anchor", "digest", "runs", "open"])

    kind = pa.list_(pa.struct([("at", pa.int32()), ("one", pa.int64()), ("two", pa.int64())]))
    ranged = contexts.repartitionByRange("anchor", "after", "before").sortWithinPartitions("anchor", "after", "before").select("anchor", "digest", "open", "before", "after")
    return _runs_of(ranged, solve, "anchor long, digest long, runs array<int>, open array<struct<at int, one long, two long>>", shard_bytes)


def _open_windows(second: DataFrame) -> DataFrame:
    """anchor, digest, runs of the windows that are open at both sides and stand in several runs. A run names a window once."""
    each = second.where(F.size("open") > 0).select("anchor", "digest", F.explode("open").alias("w")).select("anchor", "digest", "w.at", "w.one", "w.two")
    many = each.groupBy(F.col("one").alias("m_one"), F.col("two").alias("m_two")).agg(F.count("*").alias("m")).where("m > 1")
    hits = each.join(many, (F.col("one") == F.col("m_one")) & (F.col("two") == F.col("m_two")), "left_semi")
    return hits.groupBy("anchor", "digest").agg(F.flatten(F.transform(F.array_sort(F.collect_set("at")), lambda a: F.array(a, a + 1))).alias("runs"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """k_id, tie, spans: for each different row of ``docs`` that has any, [first, end) bytes of windows that start elsewhere
    too, as an array of (first window, runs relative to it)."""
    spark = docs.sparkSession
    every = as_table(_all_contexts(docs, length), "contexts")
    # as tables of their own, so that joins with them are between two plain exchanges, of which Spark can split hot keys
    anchors = as_table(every.groupBy(F.col("anchor").alias("a")).agg(F.count("*").alias("n")).where("n > 1").select("a"), "anchors")
    again = as_table(every.join(anchors, F.col("anchor") == F.col("a"), "left_semi"), "anchored")
    drop_table(every)
    drop_table(anchors)
    release_shuffles(spark)
    distinct = again.groupBy("anchor", "digest").agg(F.count("*").alias("n"), F.min(F.struct("k_id", "tie", "first", "windows", "lead")).alias("at"))
    # a table, as a range partitioning reads its input twice
    contexts = as_table(_cut_contexts(docs, distinct, length), "cut")
    release_shuffles(spark)
    first = as_table(_first_runs(contexts, length, shard_bytes), "runs")
    drop_table(contexts)
    release_shuffles(spark)
    second = as_table(_second_runs(first.where(F.size("open") > 0), length, shard_bytes), "open")
    runs = [t.where(F.size("runs") > 0).select("anchor", "digest", "runs") for t in (first, second)]
    found = runs[0].unionByName(runs[1]).unionByName(_open_windows(second)).select(F.col("anchor").alias("f_anchor"), F.col("digest").alias("f_digest"), "runs")
    hits = again.join(found, (F.col("anchor") == F.col("f_anchor")) & (F.col("digest") == F.col("f_digest"))).select("k_id", "tie", "first", "runs")
    # as a set: identical rows say the same
    return hits.groupBy("k_id", "tie").agg(F.collect_set(F.struct("first", "runs")).alias("spans"))


def merged_spans(spans: list[dict], length: int) -> list[tuple[int, int]]:
    """Maximal [first, end) byte spans."""
    flat = sorted((s["first"] + s["runs"][k], s["first"] + s["runs"][k + 1] - 1 + length) for s in spans for k in range(0, len(s["runs"]), 2))
    out: list[tuple[int, int]] = []
    for a, b in flat:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def kept_bytes(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    edges = [0, *[x for s in spans for x in s], len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def whole_characters(data: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans shrunk so that no character is cut."""
    inside = lambda k: k < len(data) and data[k] & 0xC0 == 0x80
    out = []
    for a, b in spans:
        while inside(a):
            a += 1
        while inside(b):
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def _with_spans(docs: DataFrame, rows: DataFrame, length: int) -> DataFrame:
    spans = repeated_spans(docs, length).select(F.col("k_id").alias("s_id"), F.col("tie").alias("s_tie"), "spans")
    return rows.join(spans, (F.col("k_id") == F.col("s_id")) & (F.col("tie") == F.col("s_tie")), "left")


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of ``docs``.

    Each byte is removed that a ``length``-byte string covers which also starts anywhere else, in this or another row
    (identical rows repeat each other); strings are judged on the input. Null and empty texts and texts below ``length``
    bytes lose nothing; very long texts are hashed in blocks. Ids may be null or repeated: rows are told apart by id and text,
    and identical rows count as often as they stand but are cut once. Whole contexts, and the windows that reach over the ends
    of runs, are taken as equal by 128 bits of hashes; all others by their bytes. Other columns are dropped.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for data, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                found = merged_spans(spans or [], length)
                kept = kept_bytes(data, found)
                out.append((len(data), len(data) - len(kept), len(found), hashlib.sha256(kept).hexdigest()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            columns = zip(*out, strict=True) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    joined = _with_spans(docs, _keyed(docs), length).select("doc_id", "data", "spans")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def cut_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with all its columns, the repeated bytes gone from ``text`` and ``n_chars``, if there, counted anew. A
    character of which a byte stays, stays whole. Null texts stay null; emptied texts stay as empty rows."""
    @F.pandas_udf("string")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, spans in batches:
            out = []
            for text, found in zip(texts, spans, strict=True):
                if text is not None and found is not None and len(found):
                    data = text.encode()
                    text = kept_bytes(data, whole_characters(data, merged_spans(list(found), length))).decode()
                out.append(text)
            yield pd.Series(out, dtype=object)

    mine = {c: f"in_{k}" for k, c in enumerate(docs.columns)}
    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in mine.items()], F.coalesce(doc_id, F.lit(0)).alias("k_id"), F.xxhash64(doc_id, F.col("text")).alias("tie"))
    joined = _with_spans(docs, rows, length)
    text = mine["text"]
    out = joined.withColumn(text, F.when(F.col("spans").isNull(), F.col(text)).otherwise(cut(text, "spans")))
    if "n_chars" in mine:
        kind = dict(docs.dtypes)["n_chars"]
        out = out.withColumn(mine["n_chars"], F.when(F.col("spans").isNull(), F.col(mine["n_chars"])).otherwise(F.length(text).cast(kind)))
    return out.select(*[F.col(n).alias(c) for c, n in mine.items()])
