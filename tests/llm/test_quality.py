import math
import zlib

import numpy as np
from draftloom.llm import quality
from draftloom.llm.shared import load

AWKWARD = [(None, "plain words here."), (10**6, ""), (10**6, None), (10**6 + 1, "x"), (10**6 + 2, "w " * 100_000), (10**6 + 3, "!!!"), (10**6 + 4, "日本 語")]


def by_hand(texts, labels):
    """The same discriminant with numpy over the training rows."""
    train = {d: q for d, q in labels.items() if zlib.crc32(str(d).encode()) % 5}
    x = {d: np.array(quality.statistics((t or "").encode())) for d, t in texts.items()}
    model = {}
    for c in (0, 1):
        z = np.array([x[d] for d, q in train.items() if q == c and d in x])
        n, k = z.shape
        cov = np.cov(z.T, bias=True)
        g = quality.SHRINKAGE + (1 - quality.SHRINKAGE) * min(1.0, k / (n + 1))
        cov = (1 - g) * cov + (g * np.trace(cov) / k + quality.FLOOR) * np.eye(k)
        model[c] = (z.mean(0), np.linalg.inv(cov), math.log(n) - np.linalg.slogdet(cov)[1] / 2)

    def score(v):
        at = {c: o - (v - m) @ i @ (v - m) / 2 for c, (m, i, o) in model.items()}
        return 1 / (1 + math.exp(max(-700, min(700, at[0] - at[1]))))

    return {d: score(v) for d, v in x.items()}


def test_scores_match_numpy_and_hold_out(spark, sf_dir):
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    rows = quality.classify(docs, labels).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    known = {r.doc_id: r.quality for r in labels.collect()}
    want = by_hand(texts, known)
    assert len(rows) == len(texts)
    for r in rows:
        assert abs(r.score - want[r.doc_id]) < 1e-6
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert r.predicted == int(r.score >= 0.3)
    right = [r.predicted == known[r.doc_id] for r in rows if r.held_out and r.doc_id in known]
    assert sum(right) / len(right) > 0.95


def test_labels_of_the_held_out_fold_teach_nothing(spark, sf_dir):
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    flipped = labels.withColumn("quality", quality.F.when(quality.held_out(labels.doc_id), 1 - labels.quality).otherwise(labels.quality))
    assert quality.fit(docs, labels) == quality.fit(docs, flipped)


def test_awkward_rows(spark, sf_dir):
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    more = spark.createDataFrame([(d, t, 1.0, "mine") for d, t in AWKWARD], "doc_id long, text string, score double, symbols string")
    base = docs.select("doc_id", "text", quality.F.lit(1.0).alias("score"), quality.F.lit("x").alias("symbols"))
    bad = labels.unionByName(spark.createDataFrame([(None, 1, 0), (3, None, 0), (10**7, 0, 0)], "doc_id long, quality int, toxic int"))
    rows = [r for r in quality.classify(base.unionByName(more), bad.unionByName(bad)).collect() if r.doc_id is None or r.doc_id >= 10**6]
    assert len(rows) == len(AWKWARD) and all(0 <= r.score <= 1 for r in rows)
    assert [r.held_out for r in rows if r.doc_id is None] == [False]
    kept = quality.keep_good(base.unionByName(more), bad)
    assert kept.columns == base.columns and kept.where("symbols = 'mine'").count() == sum(r.predicted for r in rows)


def test_missing_classes_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    label = lambda rows: spark.createDataFrame(rows, "doc_id long, quality int")
    scores = lambda rows: {r.score for r in quality.classify(docs, label(rows)).collect()}
    assert scores([]) == {0.5} and scores([(1, 1), (2, 1)]) == {1.0} and scores([(1, 0), (2, 0)]) == {0.0}
    assert quality.classify(docs.limit(0), label([(1, 1)])).count() == 0


def test_statistics_are_finite():
    for text in ("", " ", "a", "%%%", "A" * 10_000, "a\n" * 999, "é" * 50):
        assert all(map(math.isfinite, quality.statistics(text.encode())))
