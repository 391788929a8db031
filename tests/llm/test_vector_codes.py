import hashlib
import math
import random

import numpy as np
import pytest
from draftloom.llm import vector_codes


def brute(rows, rounds=2):
    """Sorted rows of the contract by plain Python integers. rows: (vec_id, embedding, label)."""
    kept = [(i, [math.floor(256 * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    w = len(kept[0][1]) // 16
    cut = lambda v: [tuple(v[p * w : (p + 1) * w]) for p in range(16)]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:64]
    books = [[cut(v)[p] for _, v, _ in first] for p in range(16)]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda p, part: min((square(part, e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        new = [list(b) for b in books]
        for p in range(16):
            mine = {}
            for _, v, _ in kept:
                mine.setdefault(near(p, cut(v)[p])[1], []).append(cut(v)[p])
            for k, parts in mine.items():
                new[p][k] = tuple(sum(x) // len(parts) for x in zip(*parts))
        books = new
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    coded = [(i, [near(p, part) for p, part in enumerate(cut(v))], lab) for i, v, lab in kept]
    errors = {}
    for _, found, lab in coded:
        errors[lab] = errors.get(lab, 0) + sum(d for d, _ in found)
    return sorted([(i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), errors[lab], digest) for i, found, lab in coded], key=repr)


@pytest.mark.parametrize("scale", [2, 30, 5_000])
@pytest.mark.parametrize("entries", [1, 5, 64])
def test_tree_search_is_exact(scale, entries):
    """Small scales give many ties, equal entries and parts that lie on a ball's edge."""
    rnd = np.random.default_rng(scale + entries)
    book, parts = rnd.integers(-scale, scale + 1, (entries, 4)), rnd.integers(-scale, scale + 1, (800, 4))
    away = ((parts[:, None] - book[None]) ** 2).sum(-1)
    index, best = vector_codes.nearest(vector_codes.ball_tree(book), book, parts)
    assert (index == away.argmin(1)).all() and (best == away.min(1)).all()


def test_far_apart_entries():
    far = vector_codes.LARGEST
    book = np.array([[far] * 4, [-far] * 4, [far - 1, far, far, far], *[[k, 0, 0, -k] for k in range(60)]])
    away = ((book[:, None].astype(object) - book[None].astype(object)) ** 2).sum(-1)
    index, best = vector_codes.nearest(vector_codes.ball_tree(book), book, book)
    assert index.tolist() == [min(range(len(book)), key=lambda k: (row[k], k)) for row in away] and not best.any()


@pytest.mark.parametrize(("n", "width"), [(150, 4), (40, 1)])
def test_awkward_rows_by_plain_integers(spark, n, width):
    """Null and equal ids, null labels, vectors that go, repeated rows, large components, and extra columns of clashing names."""
    rnd = random.Random(n)
    vector = lambda: [rnd.choice([0.0, 0.25, -0.5, rnd.uniform(-1, 1)]) for _ in range(16 * width)]
    rows = [(rnd.choice([k, k, k // 2]), vector(), rnd.choice([None, 1, 1, 2])) for k in range(n)]
    rows += [rows[3], (None, vector(), 1), (2, None, 1), (n, [None] + vector()[1:], 1), (n, [float("nan")] + vector()[1:], None), (n, vector()[1:] + [-math.inf], 2), (n, [5e5] + vector()[1:], 7)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, code string, error int")
    assert sorted((tuple(r) for r in vector_codes.compress(df).collect()), key=repr) == brute(rows)


def test_empty_tables_and_errors(spark):
    kind = "vec_id long, embedding array<float>, label int"
    assert vector_codes.compress(spark.createDataFrame([], kind)).count() == 0
    assert vector_codes.compress(spark.createDataFrame([(1, None, 1)], kind)).count() == 0
    for bad in ([(1, [0.0] * 15, 1)], [(1, [0.0] * 16, 1), (2, [0.0] * 32, 1)], [(1, [1e30] * 16, 1)]):
        with pytest.raises(Exception, match="vectors must|components beyond"):
            vector_codes.compress(spark.createDataFrame(bad, kind)).count()
