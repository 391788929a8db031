import random

import numpy as np
import pandas as pd
import pytest

from draftloom.llm import binary_search


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize(("segments", "k"), [(8, 3), (4, 10), (None, 1)])
def test_matches_brute_force(spark, segments, k):
    rnd = random.Random(k)
    base = [rnd.getrandbits(64) for _ in range(30)]
    codes = base + [rnd.choice(base) ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) for _ in range(60)] + [base[0]] * 40
    rows = [(n, signed(c)) for n, c in enumerate(codes)] + [(500, None), (None, signed(base[3])), (7, signed(base[9]))]
    df = spark.createDataFrame(rows, "id long, code long")
    asked = df.where("id % 10 = 0")
    got = sorted((r.query_id, r.rank, r.id is None, r.id or 0, r.distance) for r in binary_search.search(df, asked, k, segments).collect())
    want = []
    for q, code in rows:
        if q is not None and q % 10 == 0 and code is not None:
            near = sorted(((code % 2**64 ^ c % 2**64).bit_count(), n is None, n or 0) for n, c in rows if c is not None)[:k]
            want += [(q, place + 1, none, n, d) for place, (d, none, n) in enumerate(near)]
    assert got == sorted(want)


def test_fewer_rows_than_k_and_empty(spark):
    df = spark.createDataFrame([(1, 5), (2, 7)], "id long, code long")
    rows = sorted(map(tuple, binary_search.search(df, df.where("id = 1"), 10, 8).collect()))
    assert rows == [(1, 1, 1, 0), (1, 2, 2, 1)]
    none = df.where("id < 0")
    assert binary_search.search(none, df, 3).count() == 0
    assert binary_search.search(df, none, 3).count() == 0


def test_sign_code(spark):
    rows = [([1.0] * 64,), ([-1.0] * 64,), ([0.5, -0.5, None, float("nan"), 2.0],), (None,), ([],)]
    df = spark.createDataFrame(rows, "embedding array<float>")
    got = [r.code for r in df.select(binary_search.sign_code(df.embedding).alias("code")).collect()]
    assert got == [-1, 0, 0b10001, None, 0]


def test_segments_follow_the_expected_cost():
    assert [binary_search.segments_for(n) for n in (1, 500, 200_000, 1 << 18, (1 << 18) + 1, 10**7, 10**10)] == [16, 8, 4, 4, 4, 4, 2]
    for n in (10**5, (1 << 18) + 1, 10**6, 10**7, 10**9):
        assert binary_search.expected_cost(n, binary_search.segments_for(n)) < n / 2
        more, fewer = (binary_search.expected_cost(int(n * f), binary_search.segments_for(int(n * f))) for f in (1.1, 0.9))
        assert more < 3 * fewer  # no number of codes at which the work jumps


def test_more_codes_than_two_to_the_eighteen(spark):
    """Random codes, the worst there are: as brute force, and fewer probes than codes."""
    rnd = np.random.default_rng(1)
    codes = rnd.integers(-(1 << 63), (1 << 63) - 1, (1 << 18) + 5_000)
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(len(codes)), "code": codes}))
    got = {}
    for r in binary_search.search(df, df.where("id < 5"), 10).collect():
        got.setdefault(r.query_id, []).append((r.distance, r.id))
    for q in range(5):
        distance = np.bitwise_count((codes ^ codes[q]).view(np.uint64)).astype(int)
        order = np.lexsort((np.arange(len(codes)), distance))[:10]
        assert sorted(got[q]) == [(distance[k], k) for k in order]


@pytest.mark.parametrize("segments", [5, 6, 7])
def test_segments_of_two_widths(spark, segments):
    """As brute force where the segments' number does not divide 64; their widths cover all bits."""
    assert sum(binary_search.widths(segments)) == 64
    rnd = random.Random(segments)
    base = [rnd.getrandbits(64) for _ in range(12)]
    codes = base + [rnd.choice(base) ^ sum(1 << b for b in rnd.sample(range(64), rnd.randrange(9))) for _ in range(90)]
    codes += [base[0] ^ (1 << b) for b in range(58, 64)]
    df = spark.createDataFrame([(n, signed(c)) for n, c in enumerate(codes)], "id long, code long")
    got = sorted((r.query_id, r.rank, r.id, r.distance) for r in binary_search.search(df, df.where("id % 10 = 0"), 5, segments).collect())
    want = [(q, place + 1, n, d) for q in range(0, len(codes), 10) for place, (d, n) in enumerate(sorted(((codes[q] ^ c).bit_count(), n) for n, c in enumerate(codes))[:5])]
    assert got == sorted(want)


def test_segments_do_not_halve_at_once():
    """From the codes of the check's smaller table to those of the larger one, the number went from 8 to 4, and a query's probes by thirty."""
    assert [binary_search.segments_for(n) for n in (10_008, 50_125)] == [6, 5]
