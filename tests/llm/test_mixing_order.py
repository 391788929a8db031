"""The registered mix comes in the order of training positions, by brute force."""

import hashlib
from collections import defaultdict

import pytest
from draftloom.llm import mixing, queries
from draftloom.llm.shared import load
from test_mixing import integral, water, words


def time_at(done, knots):
    """The time at which the schedule's integral reaches ``done`` of its whole, by bisection."""
    area = lambda t: sum(integral(a, b, min(max(t, a[0]), b[0])) for a, b in zip(knots, knots[1:]))
    low, high = 0.0, 1.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if area(middle) < done * area(1.0) else (low, middle)
    return high


def test_op5_rows_come_by_position(spark, sf_dir):
    by_source = defaultdict(list)
    for r in load(spark, sf_dir, "documents").collect():
        by_source[r.source].append((hashlib.md5(f"{r.doc_id}|{r.text}".encode()).hexdigest(), r.doc_id, words(r.text)))
    sizes = {s: sum(n for _, _, n in docs) for s, docs in by_source.items()}
    weight = {s: k % 3 + 1 for k, s in enumerate(sorted(sizes))}
    target, at = water(sizes), {}
    for s, docs in by_source.items():
        start = 0
        for _, d, n in sorted(docs):
            at[d] = time_at(start / target[s], mixing.QUERY_SCHEDULES[weight[s]])
            start += n
    rows = queries.op5_source_mixing(spark, sf_dir).collect()
    assert len(rows) == len(at)
    taken = [at[r.doc_id] for r in rows if r.taken]
    assert len(set(taken)) > 50 and taken == pytest.approx(sorted(taken), abs=1e-9)
    assert [r.position for r in rows[: len(taken)]] == pytest.approx(taken, abs=1e-8)
    assert not any(r.taken or r.position is not None for r in rows[len(taken) :])
