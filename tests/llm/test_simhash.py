import random

import pytest

from draftloom.llm import components, simhash


def near(u, v, bits):
    return (u ^ v).bit_count() <= bits


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def planted(n, seed):
    """Random fingerprints, chains of near ones, and a crowd that shares most of its bits."""
    rnd = random.Random(seed)
    out = [rnd.getrandbits(64) for _ in range(n)]
    for _ in range(n):
        x = rnd.choice(out[-n:])
        for _ in range(rnd.randint(1, 3)):
            x ^= 1 << rnd.randrange(64)
        out.append(x)
    core = rnd.getrandbits(64)
    out += [core ^ rnd.getrandbits(8) ^ (rnd.getrandbits(4) << 30) for _ in range(n)]
    return sorted(set(out))


@pytest.mark.parametrize(("max_bits", "pairwise"), [(1, 2), (1, 1000), (2, 2), (2, 1000)])
def test_links_are_all_pairs_of_brute_force(spark, max_bits, pairwise):
    prints = planted(80, max_bits)
    df = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    rows = simhash.links(df, max_bits, pairwise).collect()
    got = {frozenset((r.u % 2**64, r.v % 2**64)) for r in rows}
    want = {frozenset((a, b)) for a in prints for b in prints if a < b and near(a, b, max_bits)}
    assert len(rows) == len(got)
    assert got == want


def brute_groups(ids, prints, bits):
    root = list(range(len(prints)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(prints)):
        for b in range(a):
            if near(prints[a], prints[b], bits):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    groups = {}
    for k in range(len(prints)):
        groups.setdefault(find(k), []).append(k)
    out = {}
    for members in groups.values():
        known = [ids[k] for k in members if ids[k] is not None]
        for k in members:
            out[k] = min(known) if known else None
    return out


def test_fingerprint_by_definition():
    import xxhash

    text = "One two  THREE\tfour\nFive ünd Ünd"
    words = ["one", "two", "three", "four", "five", "ünd", "Ünd"]
    hashes = [xxhash.xxh64_intdigest(" ".join(words[k : k + 3]), 42) for k in range(5)]
    want = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > 5)
    assert simhash.fingerprint(text.encode()) == want
    assert simhash.fingerprint(b"A b") == xxhash.xxh64_intdigest("a b", 42)
    assert simhash.fingerprint(b" \n\t") == simhash.fingerprint(b"") == 0


def test_group_on_awkward_rows(spark):
    rnd = random.Random(3)
    base = [" ".join(rnd.choice("abcdefghijklmnop") * rnd.randint(1, 3) for _ in range(60)) for _ in range(6)]
    rows = []
    for k in range(60):
        words = rnd.choice(base).split()
        if k % 3:
            words[rnd.randrange(len(words))] = f"w{k}"
        rows.append((rnd.choice([None, *range(40)]), " ".join(words), 7))
    rows += [(50, None, 1), (49, "", 1), (None, "   ", 1), (51, "only", 1), (52, "ONLY", 1), (53, "x " * 50_000, 1), (51, "only", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, root int")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.fp % 2**64, r.component_id) for r in simhash.group(df).collect())
    prints = [simhash.fingerprint((t or "").encode()) for _, t, _ in rows]
    groups = brute_groups([r[0] for r in rows], prints, 2)
    want = sorted((r[0] is None, r[0] or 0, p, groups[k]) for k, (r, p) in enumerate(zip(rows, prints)))
    assert got == want
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert kept.count() == len({simhash_root for simhash_root in groups_by_root(prints)})


def groups_by_root(prints):
    roots = list(range(len(prints)))
    for a in range(len(prints)):
        for b in range(len(prints)):
            if near(prints[a], prints[b], 2) and roots[a] != roots[b]:
                old, new = max(roots[a], roots[b]), min(roots[a], roots[b])
                roots = [new if r == old else r for r in roots]
    return roots


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.group(df).count() == 0
    assert simhash.keep_one(df).count() == 0


def test_components_of_long_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(200)] + [(1000, 1000 + k) for k in range(1, 100)] + [(2000, 2001), (2001, 2000), (5, 5), (None, 3)]
    df = spark.createDataFrame(edges, "u long, v long")
    got = {r.node: r.root for r in components.connected_components(df).collect()}
    assert got == {k: 0 for k in range(201)} | {1000 + k: 1000 for k in range(100)} | {2000: 2000, 2001: 2000}
