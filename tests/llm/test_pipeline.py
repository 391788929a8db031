"""The pipeline against its stages by brute force, on the smallest tables."""

import hashlib
from collections import Counter, defaultdict

import public_tokenizers as P
import pytest
import tiktoken
from draftloom.llm import bpe, suffix
from draftloom.llm.shared import load
from test_mixing import water, words
from test_quality import by_hand

import corpus_pipeline


def repeated(texts, length=200):
    """Spans of each text's bytes that windows seen twice cover."""
    data = [t.encode() for t in texts]
    seen = Counter(d[k : k + length] for d in data for k in range(len(d) - length + 1))
    out = []
    for d in data:
        spans = []
        for k in range(len(d) - length + 1):
            if seen[d[k : k + length]] > 1:
                if spans and k <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], k + length)
                else:
                    spans.append((k, k + length))
        out.append(suffix.kept_bytes(d, suffix.whole_characters(d, spans)).decode())
    return out


def mixed(rows):
    """(doc_id, text) as often as the mix has them. rows: doc_id, text, source."""
    sizes, by_source = Counter(), defaultdict(list)
    for d, t, s in rows:
        sizes[s] += words(t)
        by_source[s].append((hashlib.md5(f"{d}|{t}".encode()).hexdigest(), d, words(t), t))
    out = []
    for s, target in water(sizes).items():
        goal = int(target + 0.5)
        whole = goal // sizes[s] if sizes[s] else 0
        rest = goal - whole * sizes[s]
        for _, d, n, t in sorted(by_source[s]):
            part = max(0, min(n, rest))
            rest -= n
            out += [(d, t)] * (whole + (2 * part >= n or whole == 0 and part > 0 and rest + n == goal) if n else 0)
    return out


def test_stages_and_run(spark, sf_dir):
    from test_similar import brute_kept

    docs = load(spark, sf_dir, "documents")
    rows = {r.doc_id: r for r in docs.collect()}
    labels = {r.doc_id: r.quality for r in load(spark, sf_dir, "labels").collect()}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_copies", "repeats", "mix", "tokens"]

    good = [d for d, s in sorted(by_hand({d: r.text for d, r in rows.items()}, labels).items()) if s >= 0.3]
    kept = sorted(brute_kept([(d, rows[d].text) for d in good]))
    cut = dict(zip(kept, repeated([rows[d].text for d in kept])))
    want = Counter(mixed([(d, cut[d], rows[d].source) for d in kept]))

    stage = dict(corpus_pipeline.STAGES)
    one = stage["quality"](spark, docs, sf_dir)
    assert one.columns == docs.columns and sorted(r.doc_id for r in one.collect()) == good
    two = stage["near_copies"](spark, one, sf_dir)
    assert two.columns == docs.columns and sorted(r.doc_id for r in two.collect()) == kept
    three = stage["repeats"](spark, two, sf_dir)
    assert three.columns == docs.columns
    assert {r.doc_id: (r.text, r.n_chars) for r in three.collect()} == {d: (t, len(t)) for d, t in cut.items()}
    four = stage["mix"](spark, three, sf_dir)
    assert four.columns == docs.columns and Counter((r.doc_id, r.text) for r in four.collect()) == want

    exact = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    got = Counter((r.doc_id, tuple(r.ids), r.n_tokens, r.decoded_sha256) for r in corpus_pipeline.run(spark, sf_dir).collect())
    assert got == Counter({(d, tuple(i := exact.encode_ordinary(t)), len(i), hashlib.sha256(t.encode()).hexdigest()): n for (d, t), n in want.items()})


@pytest.mark.parametrize("name", ["quality", "near_copies", "repeats", "mix", "tokens"])
def test_stages_on_awkward_rows(spark, sf_dir, name):
    rows = [(None, None, None, None, None, "a"), (1, "", "en", "s", 0, "b"), (1, "", "en", "s", 0, "b"), (2, "plain words " * 200, "en", None, 1, None), (2, "other words", "de", "s", 1, "c"), (None, "no id", None, "s", 5, "d")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, size string"
    stage = dict(corpus_pipeline.STAGES)[name]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        out = stage(spark, docs, sf_dir)
        if name != "tokens":
            assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
        assert len(out.collect()) <= 3 * len(data)
