import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from draftloom.llm import suffix


def brute(texts, length):
    """(n_bytes, n_removed, n_spans, kept) by counting every window."""
    seen = Counter(t[k : k + length] for t in texts for k in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        spans = sum(gone[k] and not (k and gone[k - 1]) for k in range(len(t)))
        out.append((len(t), sum(gone), spans, bytes(b for b, g in zip(t, gone) if not g)))
    return out


def corpus(seed, n=40):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdeéñß") for _ in range(rnd.randint(1, 8))) for _ in range(300)]
    prose = lambda k: " ".join(rnd.choice(words) for _ in range(k))
    passages = [prose(k) for k in (30, 45, 60, 90)]
    texts = []
    for k in range(n):
        parts = [prose(rnd.randint(0, 80))]
        if k % 2:
            parts += [rnd.choice(passages), prose(rnd.randint(0, 40))]
        if k % 7 == 0:
            parts = [rnd.choice(words) + " "] * 200
        texts.append(" ".join(parts))
    texts += [texts[1], texts[3][:400], "a" * 1000, "a" * 199, "a" * 200, "ab" * 300, "", None, passages[0]]
    texts += [passages[3][50:] + prose(3) for _ in range(4)]
    # all of it but a byte at either end is shared, at exactly one byte less than the length
    core = prose(80)[:150].encode()[:150].decode(errors="ignore")
    core = (core + "x" * 199)[: 199 - (len(core.encode()) - len(core))]
    texts += [f"{k}{core}{k}" for k in range(8)]
    return texts


@pytest.mark.parametrize(("seed", "shard"), [(1, 2_000_000), (2, 2_000), (3, 500), (4, 1)])
def test_spans_are_those_of_brute_force(spark, seed, shard, monkeypatch):
    monkeypatch.setattr(suffix, "repeated_spans", lambda docs, length=200, f=suffix.repeated_spans: f(docs, length, shard))
    texts = corpus(seed)
    ids = [None if k == 5 else k // 2 for k in range(len(texts))]
    df = spark.createDataFrame([(i, t, "s", 1) for i, t in zip(ids, texts)], "doc_id long, text string, spans string, tie int")
    got = sorted(map(tuple, suffix.remove_repeats(df).collect()), key=repr)
    want = sorted([(i, *b[:3], hashlib.sha256(b[3]).hexdigest()) for i, b in zip(ids, brute([(t or "").encode() for t in texts], 200))], key=repr)
    assert got == want
    assert sum(r[2] for r in got) > 3000


def test_contexts_cover_every_window_once():
    rnd = random.Random(4)
    for data in (rnd.randbytes(5000), b"ab" * 900, b"z" * 700, rnd.randbytes(200), rnd.randbytes(199), b""):
        _, _, first, count, _ = suffix.contexts_of(data)
        covered = [k for f, c in zip(first, count) for k in range(f, f + c)]
        assert covered == list(range(max(len(data) - 199, 0)))


def test_long_text_in_blocks(monkeypatch):
    data = random.Random(5).randbytes(3000) * 2
    whole = suffix.contexts_of(data)
    monkeypatch.setattr(suffix, "_BLOCK", 1023)
    monkeypatch.setattr(suffix, "_PLACE", 10)
    _, _, first, count, _ = suffix.contexts_of(data)
    assert [k for f, c in zip(first, count) for k in range(f, f + c)] == list(range(len(data) - 199))
    assert len(whole[0])


def test_ranks_and_prefixes_against_sorting():
    rnd = random.Random(6)
    for alphabet in ("ab", "abcdefgh"):
        parts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(20, 60))).encode() for _ in range(30)]
        parts += parts[:5] + [b"a" * 50]
        sizes = np.array([len(p) for p in parts])
        text = np.frombuffer(b"".join(parts), np.uint8)
        room = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(text))
        key, rank, order = suffix.suffix_ranks(text, room, (8, 16, 20))
        raw = text.tobytes()
        full = [k for k in range(len(text)) if room[k] >= 20]
        groups = Counter(raw[k : k + 20] for k in full)
        order = order[room[order] >= 20]
        assert sorted(order.tolist()) == [k for k in full if groups[raw[k : k + 20]] > 1]
        assert [raw[k : k + 20] for k in order] == sorted(raw[k : k + 20] for k in order)
        prefix = suffix.common_prefixes(key, room, order)
        for a, b in zip(order, order[1:]):
            most = min(room[a], room[b])
            want = next((j for j in range(most) if raw[a + j] != raw[b + j]), most)
            assert prefix[b] == want


def test_cut_keeps_columns_and_whole_characters(spark):
    shared = "é" * 150
    df = spark.createDataFrame([(1, "x" + shared + "yé", 9, "k"), (2, "z" + shared, 9, "k"), (3, None, None, "k"), (4, "clean", 5, "k")], "doc_id long, text string, n_chars long, spans string")
    out = suffix.cut_repeats(df)
    assert out.columns == df.columns
    got = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    assert got == {1: ("xyé", 3), 2: ("z", 1), 3: (None, None), 4: ("clean", 5)}


def test_empty_table(spark):
    assert suffix.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("shard", [300, 1_500, 6_000])
def test_runs_of_any_size_lose_nothing(spark, shard, monkeypatch):
    """Near copies of one text, changed everywhere: many contexts of each anchor, of few windows, over the ends of runs."""
    monkeypatch.setattr(suffix, "repeated_spans", lambda docs, length=200, f=suffix.repeated_spans: f(docs, length, shard))
    rnd = random.Random(shard)
    base, texts = [rnd.choice("abcdefgh ") for _ in range(900)], []
    for _ in range(60):
        text = list(base[rnd.randint(0, 300) : rnd.randint(500, 900)])
        for k in rnd.sample(range(len(text)), rnd.randint(0, 3)):
            text[k] = rnd.choice("xyz")
        texts.append("".join(text))
    got = sorted(map(tuple, suffix.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()))
    assert got == [(i, *b[:3], hashlib.sha256(b[3]).hexdigest()) for i, b in enumerate(brute([t.encode() for t in texts], 200))]


def test_ends_of_a_run():
    rnd = random.Random(7)
    common = lambda a, b: next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
    for size in (1, 2, 3, 40):
        for kinds in (1, 2, 3):
            rows = sorted((rnd.randrange(kinds), bytes(rnd.choice(b"ab") for _ in range(rnd.randint(0, 9)))) for _ in range(size))
            got = suffix.shared_with_ends([s for _, s in rows], [a for a, _ in rows], 6)
            for k, (a, s) in enumerate(rows):
                want = [len(s) if k == e else common(s, rows[e][1]) for e in (0, size - 1) if rows[e][0] == a]
                assert got[k] == min(6, max(want, default=-1))


def test_flags_and_runs():
    for flags in ([], [True], [False], [True, True, False, True], [False, True, True]):
        assert suffix.run_flags(suffix.flag_runs(np.array(flags, bool)), len(flags)).tolist() == flags


@pytest.mark.parametrize("null_id", [True, False])
def test_identical_rows_grow_linearly(spark, null_id):
    rnd = random.Random(8)
    text = "".join(rnd.choice("abcdefgh ") for _ in range(1400))
    rows = [(None if null_id else 7, text)] * 500 + [(9, text[:700] + "x" * 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spans = suffix.repeated_spans(df)
    assert spans.count() == 2 and all(len(r.spans) < 60 for r in spans.collect())
    got = Counter((r.doc_id, r.n_removed) for r in suffix.remove_repeats(df).collect())
    assert got == {(None if null_id else 7, 1400): 500, (9, 700): 1}


def test_a_passage_of_many_texts_stays_linear(spark):
    """What reaches over the ends of runs is one row for each context at most, then the windows of the ends themselves."""
    rnd = random.Random(9)
    prose = lambda k: "".join(rnd.choice("abcdefgh ") for _ in range(k))
    for size in (139, 199, 420):
        passage, made = prose(size), []
        for n in (300, 600):
            docs = spark.createDataFrame([(k, prose(250) + passage + prose(250)) for k in range(n)], "doc_id long, text string")
            contexts = suffix.as_table(suffix._all_contexts(docs, 200), "contexts")
            again = contexts.groupBy("anchor").count().where("count > 1").select("anchor")
            at = suffix.F.min(suffix.F.struct("k_id", "tie", "first", "windows", "lead")).alias("at")
            wanted = contexts.join(again, "anchor", "left_semi").groupBy("anchor", "digest").agg(suffix.F.count("*").alias("n"), at)
            cut = suffix.as_table(suffix._cut_contexts(docs, wanted, 200), "cut")
            first = suffix.as_table(suffix._first_runs(cut, 200, 20_000), "runs").where("size(open) > 0")
            second = suffix._second_runs(first, 200, 20_000)
            made.append((cut.count(), first.count(), sum(len(r.open) for r in second.select("open").collect())))
        (c1, f1, w1), (c2, f2, w2) = made
        assert c2 < 2.3 * c1 and f2 <= c2 and w2 < 3 * max(w1, 400)
