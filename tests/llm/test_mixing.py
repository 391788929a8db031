import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from draftloom.llm import mixing


def water(sizes, repeats=3):
    """Targets by resharing the excess until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    total, open_, target = sum(sizes.values()), set(order), {}
    while open_:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = [s for s in open_ if share[s] > repeats * sizes[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = repeats * sizes[s]
            open_.discard(s)
    return target


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def rows(seed, n=300):
    rnd = random.Random(seed)
    names = ["a", "b", "c", "hot", "tiny", None, "Ü", ""]
    out = []
    for k in range(n):
        source = "hot" if rnd.random() < 0.4 else rnd.choice(names)
        out.append((k, " \n".join(f"w{rnd.randrange(9)}" for _ in range(1 if source == "tiny" else rnd.randint(0, 60))), source, 1))
    return out + [(None, "no id here", "a", 1), (5, None, "b", 1), (5, "", "b", 1), (7, "same row", "c", 1), (7, "same row", "c", 1), (n, "x " * 30_000, "b", 1)]


@pytest.mark.parametrize("seed", [1, 2])
def test_targets_and_taken(spark, seed):
    data = rows(seed)
    df = spark.createDataFrame(data, "doc_id long, text string, source string, size int")
    plan = mixing.mix(df).collect()
    assert len(plan) == len(data)
    sizes, taken = Counter(), Counter()
    for _, t, s, _ in data:
        sizes[s] += words(t)
    want = water(sizes)
    for r in plan:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
        assert 0 <= r.taken <= 3 * r.size and 0 <= r.copies <= 3
        assert (r.position is None) == (r.taken == 0) and (r.position is None or 0 <= r.position <= 1)
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 0.5 + 1e-9
    again = mixing.mix(df.repartition(7)).collect()
    assert sorted(map(repr, plan)) == sorted(map(repr, again))


def test_materialised_mix(spark):
    data = rows(3)
    df = spark.createDataFrame(data, "doc_id long, text string, source string, size int")
    plan = mixing.mix(df)
    out = mixing.materialize(df, plan)
    assert out.columns == df.columns
    got = Counter((r.doc_id, r.text, r.source) for r in out.collect())
    want = Counter()
    by_id = defaultdict(list)
    for d, t, s, _ in data:
        by_id[d, s].append(t)
    for r in plan.collect():
        text = next(t for t in by_id[r.doc_id, r.source] if words(t) == r.size)
        want[r.doc_id, text, r.source] += r.copies
    assert got == +want


def test_copies_follow_the_schedule(spark):
    """A falling and a rising source: the order of the mix is that of the inverted demand, copy by copy."""
    data = [(k, "w " * 4, s) for s, ids in (("a", range(0, 8)), ("b", range(10, 14))) for k in ids]
    df = spark.createDataFrame(data, "doc_id long, text string, source string").repartition(1)
    knots = {1: ((0.0, 2.0), (1.0, 0.0)), 2: ((0.0, 0.0), (1.0, 2.0))}
    rows = {r.doc_id: r for r in mixing.mix(df, (1, 2), schedules=knots).collect()}
    want = []
    for d, r in rows.items():
        for copy in range(r.copies):
            done = min(r.done + copy * r.source_size / r.target, 1.0)
            want.append((1 - (1 - done) ** 0.5 if r.source == "a" else done**0.5, d))
    got = [r.doc_id for r in mixing.materialize(df, mixing.mix(df, (1, 2), schedules=knots), knots).coalesce(1).collect()]
    assert got == [d for _, d in sorted(want)] and any(r.copies > 1 for r in rows.values())


def test_curriculum_inverts_the_schedule(spark):
    knots = ((0.0, 0.5), (0.5, 1.0), (1.0, 3.0))
    done = [k / 50 for k in range(51)]
    df = spark.createDataFrame([(d,) for d in done], "d double")
    times = [r.t for r in df.select(mixing.training_time(F.col("d"), knots).alias("t")).collect()]
    area = lambda t: sum(integral(a, b, min(max(t, a[0]), b[0])) for a, b in zip(knots, knots[1:]))
    for d, t in zip(done, times):
        assert area(t) / area(1.0) == pytest.approx(d, abs=1e-9)
    assert times == sorted(times) and times[0] == 0 and times[-1] == 1
    with pytest.raises(ValueError):
        mixing.training_time(F.col("d"), ((0.0, 0.0), (1.0, 0.0)))


def integral(a, b, t):
    (t0, h0), (t1, h1) = a, b
    return (t - t0) * (2 * h0 + (h1 - h0) / (t1 - t0) * (t - t0)) / 2


def test_nothing_to_mix(spark):
    schema = "doc_id long, text string, source string"
    assert mixing.mix(spark.createDataFrame([], schema)).count() == 0
    blank = spark.createDataFrame([(1, None, None), (2, " ", "a")], schema)
    assert [(r.target, r.taken, r.copies) for r in mixing.mix(blank).collect()] == [(0.0, 0, 0)] * 2
    assert mixing.materialize(blank, mixing.mix(blank)).count() == 0


def test_rows_without_ids_are_many_parts(spark):
    """Null and repeated ids are no single window: the order is that of id and text."""
    data = [(None if k % 2 else 7, f"w{k} x y", "a") for k in range(400)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    assert mixing.sized(df).select(F.substring("hash", 1, mixing.HASH_DIGITS)).distinct().count() > 300
    assert sorted(r.taken for r in mixing.mix(df).collect()) == [3] * 400


def test_a_source_of_one_long_document_has_a_copy(spark):
    data = [(1, "w " * 1000, "a"), (2, "w " * 200, "b"), (3, "w " * 100, "c")]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    plan = {r.source: r for r in mixing.mix(df).collect()}
    assert plan["a"].taken < 500 and all(r.copies > 0 for r in plan.values())


def test_identical_rows_share_their_copies(spark):
    df = spark.createDataFrame([(1, "a b c d", "s")] * 2 + [(2, "x", "t")], "doc_id long, text string, source string")
    plan = spark.createDataFrame([(1, "s", c, 0.0, 1, 8, 12.0) for c in (1, 2)], "doc_id long, source string, copies long, done double, weight long, source_size long, target double")
    plan = plan.withColumn("tie", F.xxhash64(F.lit("a b c d")))
    assert mixing.materialize(df, plan).count() == 3
