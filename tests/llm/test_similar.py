import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from draftloom.llm import minmax, similar
from draftloom.llm.shared import load
from pyspark.sql import functions as F
from test_pipeline import mixed, repeated
from test_quality import by_hand

import corpus_pipeline


def word_sets(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def brute_kept(rows):
    """The smallest doc_id of each component of pairs at a similarity of 0.8 or more. rows: (doc_id, text)."""
    sets, root = {d: word_sets(t) for d, t in rows}, {d: d for d, _ in rows}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in root:
        for b in root:
            if a < b and (sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * max(1, len(sets[a] | sets[b]))):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {find(d) for d in root}


def crowd(seed):
    """Copies of a few texts with words changed at the ends, around the least similarity, and a passage that many share."""
    rnd = random.Random(seed)
    base = [[f"w{rnd.randrange(500)}" for _ in range(60)] for _ in range(4)]
    shared = [f"license{k}" for k in range(40)]
    out = []
    for k in range(160):
        words = list(rnd.choice(base))
        for at in rnd.sample(range(60), rnd.choice([0, 1, 2, 3])):
            words[at] = f"x{k}-{at}"
        out.append((k, " ".join(words + shared if k % 2 else words[: rnd.randint(48, 60)])))
    return out + [(200, None), (201, "  "), (202, "two WORDS"), (203, "Two\nwords"), (204, "one two three four five"), (205, "one two three four five six")]


@pytest.mark.parametrize("seed", [2, 1000, 5])
def test_groups_are_those_of_brute_force(spark, seed):
    rows = crowd(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lowest = {}
    for r in similar.group(df).collect():
        lowest[r.root] = min(r.doc_id, lowest.get(r.root, r.doc_id))
    want = brute_kept(rows)
    assert set(lowest.values()) == want and 5 < len(want) < len(rows)


def test_stage_of_the_pipeline(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    kept = dict(corpus_pipeline.STAGES)["near_copies"](spark, docs, sf_dir)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == brute_kept([(r.doc_id, r.text) for r in docs.collect()])


def test_pipeline_to_its_end(spark, sf_dir):
    rows = {r.doc_id: r for r in load(spark, sf_dir, "documents").collect()}
    labels = {r.doc_id: r.quality for r in load(spark, sf_dir, "labels").collect()}
    good = [d for d, s in sorted(by_hand({d: r.text for d, r in rows.items()}, labels).items()) if s >= 0.3]
    kept = sorted(brute_kept([(d, rows[d].text) for d in good]))
    cut = zip(kept, repeated([rows[d].text for d in kept]))
    want = Counter((d, hashlib.sha256(t.encode()).hexdigest()) for d, t in mixed([(d, t, rows[d].source) for d, t in cut]))
    assert Counter((r.doc_id, r.decoded_sha256) for r in corpus_pipeline.run(spark, sf_dir).collect()) == want


def test_sketches_fold(spark):
    rnd = random.Random(4)
    hashes = np.unique(np.array([rnd.randrange(2**63) for _ in range(600)], np.int64))
    wide, narrow = minmax.sketch(hashes), minmax.sketch(hashes[:500])
    assert len(wide) == 2 * len(narrow) == 32
    row = spark.createDataFrame([(wide.tolist(),)], "s array<long>").select(minmax._folded(F.col("s"), F.lit(16)).alias("s")).first()
    assert row.s == (wide[:16] ^ wide[16:]).tolist()
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(minmax, "SKETCH", 512)
        assert minmax.sketch(hashes[:250]).tolist() == (lambda s: (s[:8] ^ s[8:]).tolist())(np.packbits((np.bincount(hashes[:250] & 1023, minlength=1024) & 1).astype(np.uint8)).view(np.int64))
