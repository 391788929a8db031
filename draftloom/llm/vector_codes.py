"""Vector codes: vectors cut into parts, each part coded by the nearest entry of its position's codebook, found in a ball tree."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import as_table

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Entries of a leaf of the tree.
LEAF = 16
#: Rows that a task codes at once.
TOGETHER = 8_192
#: Largest size of an integer component: squared distances of 64 such components fit a long.
LARGEST = 1 << 27


@dataclass(eq=False)
class Ball:
    """Entries within ``radius`` of ``pivot``; the radius is rounded up. A leaf holds the indexes of its entries, ascending."""

    pivot: np.ndarray
    radius: int
    entries: np.ndarray
    children: list[Ball] = field(default_factory=list)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances along the last axis, which is short: a pass for each component is faster than a sum over it."""
    out = np.zeros(np.broadcast_shapes(a.shape, b.shape)[:-1], np.int64)
    for k in range(a.shape[-1]):
        gap = a[..., k] - b[..., k]
        gap *= gap
        out += gap
    return out


def ball_tree(book: np.ndarray, entries: np.ndarray | None = None) -> Ball:
    """A ball tree over the rows of an integer codebook. A ball's pivot is the entry nearest to the middle of its entries, so
    all distances are between integer points; it is split between two entries that are far from each other."""
    entries = np.arange(len(book)) if entries is None else entries
    points = book[entries]
    middle = points.mean(axis=0)
    pivot = points[int(np.argmin(((points - middle) ** 2).sum(axis=1)))]
    away = _squares(points, pivot)
    widest = int(away.max())
    root = isqrt(widest)
    ball = Ball(pivot, root + (root * root < widest), entries)
    if len(entries) > LEAF and widest:
        a = points[int(np.argmax(away))]
        b = points[int(np.argmax(_squares(points, a)))]
        nearer = _squares(points, a) <= _squares(points, b)
        ball.children = [ball_tree(book, entries[nearer]), ball_tree(book, entries[~nearer])]
    return ball


def _floor_root(squares: np.ndarray) -> np.ndarray:
    """Square roots rounded down; one less where a double might have rounded up."""
    root = np.sqrt(squares.astype(np.float64)).astype(np.int64)
    return root - (root * root > squares)


def nearest(tree: Ball, book: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of the entry nearest to each row of ``parts``, ties to the lower index. Exact.

    Branch and bound for all rows at once. Each row first goes down to the leaf whose pivots are nearer, which gives it a
    first best distance. Then all balls are visited, parents first: no entry of a ball is nearer to a row than the row's distance to
    the pivot, rounded down, less the radius, rounded up. Rows for which that bound is not above the best distance so far
    visit the ball, equality included, as an equal distance at a lower index wins. Leaves are decided by integer distances.
    """
    best = np.full(len(parts), np.iinfo(np.int64).max)
    index = np.full(len(parts), len(book))
    home = np.empty(len(parts), object)

    def verify(leaf: Ball, rows: np.ndarray) -> None:
        found = _squares(parts[rows, None, :], book[leaf.entries][None, :, :])
        at = found.argmin(axis=1)
        least, which = found[np.arange(len(rows)), at], leaf.entries[at]
        wins = (least < best[rows]) | ((least == best[rows]) & (which < index[rows]))
        best[rows[wins]], index[rows[wins]] = least[wins], which[wins]

    def descend(ball: Ball, rows: np.ndarray) -> None:
        if not ball.children:
            home[rows] = ball
            return verify(ball, rows)
        left, right = (_squares(parts[rows], child.pivot) for child in ball.children)
        for child, mask in zip(ball.children, (left <= right, left > right), strict=True):
            descend(child, rows[mask])

    def visit(ball: Ball, rows: np.ndarray) -> None:
        bound = np.maximum(_floor_root(_squares(parts[rows], ball.pivot)) - ball.radius, 0)
        rows = rows[bound * bound <= best[rows]]
        if ball.children:
            for child in ball.children:
                visit(child, rows)
        else:
            verify(ball, rows[home[rows] != ball])

    if len(book) and len(parts):
        descend(tree, np.arange(len(parts)))
        visit(tree, np.arange(len(parts)))
    return index, best


class Coder:
    """Codebooks of all part positions (position, entry, component) with their trees."""

    def __init__(self, books: np.ndarray):
        self.books = books
        self.trees = [ball_tree(book) for book in books] if books.shape[1] else []

    def assign(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indexes and squared distances (row, position) of integer vectors."""
        width = self.books.shape[2]
        found = [nearest(tree, self.books[p], vectors[:, p * width : (p + 1) * width]) for p, tree in enumerate(self.trees)]
        return np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def _integers(column: pa.ListArray, width: int | None = None) -> np.ndarray:
    """floor(256 x) of every component of a column of equally long vectors."""
    flat = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
    if len(flat) and np.abs(flat).max() > LARGEST:
        raise ValueError(f"components beyond {LARGEST // SCALE} in size have no squares that fit a long")
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    size = width if width is not None else int(lengths[0])
    if (lengths != size).any() or size % PARTS:
        raise ValueError(f"vectors must have one length that is a multiple of {PARTS}")
    return flat.astype(np.int64).reshape(len(column), size)


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a task in batches of some size, as each costs a walk over all trees."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= TOGETHER:
            yield pa.concat_batches(held)
            held = []
    if sum(b.num_rows for b in held):
        yield pa.concat_batches(held)


def _kept(rows: DataFrame) -> DataFrame:
    """vec_id, label, vector of the rows whose vectors are whole: not null, all components finite."""
    x = F.col("embedding").cast("array<double>")
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"), x.alias("vector"))
    finite = ~F.exists("vector", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return rows.where(F.col("vector").isNotNull() & finite)


def _first_books(kept: DataFrame) -> np.ndarray:
    """The parts of the 64 vectors of smallest id: what one row of the result's digest stands for, whatever the input."""
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(ENTRIES).select("vector").toArrow().column(0).combine_chunks()
    if not len(first):
        return np.empty((PARTS, 0, 0), np.int64)
    vectors = _integers(first)
    return vectors.reshape(len(vectors), PARTS, vectors.shape[1] // PARTS).transpose(1, 0, 2)


def _moved(kept: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after a round: each entry is the floor of the mean of the parts that are nearest to it.

    A task adds up all its rows in one array of the size of the codebooks and returns it as rows of an entry each, so what
    is shuffled and what comes to the driver has the size of the codebooks, whatever the input.
    """
    width = books.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(books)
        sums = np.zeros(books.shape, np.int64)
        counts = np.zeros(books.shape[:2], np.int64)
        for batch in _together(batches):
            vectors = _integers(batch.column(0), PARTS * width)
            index, _ = coder.assign(vectors)
            for p in range(PARTS):
                counts[p] += np.bincount(index[:, p], minlength=books.shape[1])
                for k in range(width):  # sums of a batch are whole numbers far below 2^53
                    sums[p, :, k] += np.bincount(index[:, p], vectors[:, p * width + k], books.shape[1]).astype(np.int64)
        at = np.argwhere(counts > 0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(at[:, 0]), pa.array(at[:, 1]), pa.array(counts[at[:, 0], at[:, 1]]), pa.array(list(sums[at[:, 0], at[:, 1]]), pa.list_(pa.int64()))],
            ["part", "entry", "n", "sums"],
        )

    partial = kept.select("vector").mapInArrow(run, "part long, entry long, n long, sums array<long>")
    totals = [F.sum(F.get("sums", F.lit(k))).alias(f"s{k}") for k in range(width)]
    out = books.copy()
    for row in partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *totals).collect():
        out[row.part, row.entry] = [row[f"s{k}"] // row.n for k in range(width)]
    return out


def codebooks(kept: DataFrame, rounds: int = ROUNDS) -> np.ndarray:
    """The codebooks (position, entry, component) after ``rounds`` of assigning and moving."""
    books = _first_books(kept)
    for _ in range(rounds if books.size else 0):
        books = _moved(kept, books)
    return books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def compress(rows: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every row of ``rows`` (vec_id, embedding, label) with a whole vector.

    Rows whose vector is null or holds a null, NaN or infinite component are dropped. Codebooks start from the 64 rows of
    smallest vec_id, null last, equal ids by vector; with fewer rows they are that small. Repeated rows stay and count each
    time. Vectors of different lengths, lengths that 16 does not divide, and components beyond 2^19 in size, whose squares
    a long may not hold, are errors. Other columns are dropped; an empty table gives an empty result. Only codebooks, 64 vectors, are on the
    driver and in the tasks' closures. Vectors are read once a round; no vector is shuffled.
    """
    kept = _kept(rows)
    books = codebooks(kept, rounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(books)
        for batch in _together(batches):
            index, squares = coder.assign(_integers(batch.column(2), PARTS * books.shape[2]))
            codes = [r.tobytes().hex() for r in index.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes, pa.string()), pa.array(squares.sum(axis=1))], ["vec_id", "label", "code", "error"])

    kind = kept.schema["label"].dataType.simpleString()
    coded = as_table(kept.mapInArrow(run, f"vec_id long, label {kind}, code string, error long"), "codes")
    # a table, so that both sides of the join are plain exchanges and a label of very many rows can be split
    sums = as_table(coded.groupBy(F.col("label").alias("s_label")).agg(F.sum("error").alias("label_error")), "label-errors")
    return coded.join(sums, F.col("label").eqNullSafe(F.col("s_label"))).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
