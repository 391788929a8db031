import random

import numpy as np
import pytest
from draftloom.llm import minmax


def word_set(text, size=4):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))) if words else frozenset()


def brute(rows):
    """[(doc_id, n_shingles, component_id, kept)], sorted, by all pairs. rows: (doc_id, text)."""
    sets = [word_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    groups = {}
    for k in range(len(rows)):
        groups.setdefault(find(k), []).append(rows[k][0])
    out = []
    for k, (d, _) in enumerate(rows):
        known = [i for i in groups[find(k)] if i is not None]
        component = min(known) if known else None
        out.append((d, len(sets[k]), component, d == component))
    return sorted(out, key=repr)


def crowd(seed, n=160):
    """Copies of a few texts with words changed, around the least similarity, and a passage that half of them share."""
    rnd = random.Random(seed)
    base = [[f"w{rnd.randrange(500)}" for _ in range(60)] for _ in range(4)]
    shared = [f"license{k}" for k in range(40)]
    out = []
    for k in range(n):
        words = list(rnd.choice(base))
        for at in rnd.sample(range(60), rnd.choice([0, 1, 2, 3])):
            words[at] = f"x{k}-{at}"
        out.append((k, " ".join(words + shared if k % 2 else words[: rnd.randint(48, 60)])))
    return out


@pytest.mark.parametrize("per_set", [minmax.PER_SET, 0])
def test_awkward_rows_against_all_pairs(spark, monkeypatch, per_set):
    """Null and repeated ids, null, blank, short, long and repeated texts, and extra columns of clashing names; with no comparisons
    under a key of one band, all that is crowded meets under longer keys."""
    monkeypatch.setattr(minmax, "PER_SET", per_set)
    rows = crowd(per_set) + [(None, "two words"), (300, "two WORDS"), (301, None), (302, "  \n"), (302, ""), (303, "a b c d"), (303, "A b c d e"), (304, "long " * 30_000), (305, "long " * 20_000), (5, crowd(per_set)[5][1])]
    rows += [(306, "one two three four five"), (307, "one two three four six"), (None, "alone and without an id here")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, sid int, root string")
    assert sorted((tuple(r) for r in minmax.near_copies(df).collect()), key=repr) == brute(rows)


def test_empty_table(spark):
    assert minmax.near_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_signatures_estimate_the_similarity():
    """The share of equal values has the similarity as its mean, and varies less than with as many minima."""
    rnd = np.random.default_rng(1)
    both, minima = [], []
    for _ in range(300):
        h = rnd.integers(-(1 << 62), 1 << 62, 120)
        a, b = minmax.signature(h[:100]), minmax.signature(h[20:])  # 80 of 120
        same = a == b
        both.append(same.mean())
        minima.append(same[:, 0].mean())
    assert abs(np.mean(both) - 2 / 3) < 0.01
    assert np.var(both) < 0.7 * np.var(minima)


def test_similar_sets_share_a_band():
    rnd = np.random.default_rng(2)
    for n in [*range(4, 60), 1_000]:
        h = np.unique(rnd.integers(-(1 << 62), 1 << 62, 5 * n))
        few = np.delete(h, rnd.choice(len(h), len(h) // 5, replace=False))
        assert (minmax.band_keys(h) == minmax.band_keys(few)).any()
    assert len(minmax.band_keys(np.empty(0, np.int64))) == 0


def passages(n):
    """Texts that share a passage of half their shingles and are otherwise different."""
    shared = " ".join(f"license{k}" for k in range(60))
    return [(k, shared + " " + " ".join(f"own{k}-{j}" for j in range(60))) for k in range(n)]


def test_a_passage_of_many_texts_is_no_square(spark, monkeypatch):
    """Rows that joins of sets take in grow with the texts, not with their square."""
    seen = {}

    def count(kept, name):
        out = as_table(kept, name)
        seen[name] = seen.get(name, 0) + out.count()
        return out

    as_table = minmax.as_table
    monkeypatch.setattr(minmax, "as_table", count)
    monkeypatch.setattr(minmax, "PER_SET", 8)
    sizes = []
    for n in (400, 1_600):
        seen.clear()
        df = spark.createDataFrame(passages(n), "doc_id long, text string")
        assert all(r.kept for r in minmax.near_copies(df).collect())
        sizes.append(seen.get("met", 0) + seen.get("few", 0) + seen.get("close", 0))
    assert sizes[1] < 8 * sizes[0]


@pytest.mark.parametrize("common", [0, 7])
def test_common_shingles_are_looked_up_in_the_row(spark, monkeypatch, common):
    """As all pairs, whichever keys of a crowd are a list that meets each set in its row, and that list is bounded."""
    seen = []
    as_table = minmax.as_table
    monkeypatch.setattr(minmax, "as_table", lambda df, name: [t := as_table(df, name), seen.append(t.first().most) if name == "most" else None][0])
    monkeypatch.setattr(minmax, "COMMON", common)
    monkeypatch.setattr(minmax, "PER_SET", 0)
    rows = crowd(3, 80)
    got = minmax.near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows)
    assert [len(m) for m in seen] == [common]


def test_sets_of_a_passage_are_not_exploded_whole(spark, monkeypatch):
    """A set of a crowd makes a row for a fifth of its shingles."""
    seen = {}
    as_table = minmax.as_table
    monkeypatch.setattr(minmax, "as_table", lambda df, name: [t := as_table(df, name), seen.update({name: t.count()})][0])
    monkeypatch.setattr(minmax, "PER_SET", 8)
    got = minmax.near_copies(spark.createDataFrame(passages(400), "doc_id long, text string")).collect()
    assert all(r.kept for r in got)
    assert 0 < seen["crowd"]
    assert seen.get("counts", 0) + seen.get("firsts", 0) < sum(r.n_shingles for r in got) / 3


@pytest.mark.parametrize(("common", "counted", "per_set"), [(0, 1, 0), (0, 1, 4), (40, 300, 0), (minmax.COMMON, minmax.COUNTED, 4)])
def test_a_crowd_is_looked_through_in_any_order(spark, monkeypatch, common, counted, per_set):
    """As all pairs, whichever shingles stand last, however few are counted at once, and whether or not keys are hot."""
    monkeypatch.setattr(minmax, "COMMON", common)
    monkeypatch.setattr(minmax, "COUNTED", counted)
    monkeypatch.setattr(minmax, "PER_SET", per_set)
    rows = crowd(4, 120)
    got = minmax.near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows)
