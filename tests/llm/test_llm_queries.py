"""The registered queries over whole tables: against their SQL, or against brute force."""

import hashlib
import zlib

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from draftloom.llm import audio, bpe, queries, simhash
from draftloom.llm.shared import load
from test_audio import a_law, adpcm, mu_law
from test_quality import by_hand
from test_simhash import brute_groups
from test_suffix import brute

TABLES = "documents embeddings pages labels conversations".split()


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r.doc_id: r.text for r in load(spark, sf_dir, "documents").collect()}


def test_names():
    names = list(queries.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert set(queries.oracle_sql()) < set(names)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = queries.queries()[name](spark, sf_dir)
    found = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*columns).collect()), key=repr) == sorted(found.fetchall(), key=repr)


def test_op2(spark, sf_dir, texts):
    ids = sorted(texts)
    prints = [simhash.fingerprint(texts[d].encode()) for d in ids]
    groups = brute_groups(ids, prints, 2)
    want = {d: (f"{p:016x}", groups[k]) for k, (d, p) in enumerate(zip(ids, prints))}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op2_simhash_pigeonring(spark, sf_dir).collect()} == want


def test_op4(spark, sf_dir, texts):
    exact = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    rows = queries.op4_byte_bpe(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = exact.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_op7(spark, sf_dir, texts):
    ids = sorted(texts)
    want = {d: (*b[:3], hashlib.sha256(b[3]).hexdigest()) for d, b in zip(ids, brute([texts[d].encode() for d in ids], 200))}
    assert {r.doc_id: tuple(r)[1:] for r in queries.op7_suffix_array_dedup(spark, sf_dir).collect()} == want


def test_op8(spark, sf_dir, texts):
    known = {r.doc_id: r.quality for r in load(spark, sf_dir, "labels").collect()}
    want = by_hand(texts, known)
    for r in queries.op8_quality_classifier(spark, sf_dir).collect():
        assert abs(r.score - want.pop(r.doc_id)) < 1e-6 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    assert not want


def doubled(samples):
    """16 kHz bytes by the definition: each sample, then the floor of the mean of it and the next."""
    after = np.append(samples[1:], samples[-1])
    return np.stack([samples, (samples + after) // 2], 1).astype("<i2").tobytes()


def test_op10(spark, sf_dir, texts):
    rows = queries.op10_media_columns(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        payload = audio.padded(texts[r.doc_id].encode())
        stored = audio.wav_bytes(payload)
        assert audio.read_wav(stored)[2] == payload and len(payload) % 64 == 0
        assert tuple(r)[1:7] == (len(texts[r.doc_id].encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest())
        mu, a = (np.array([law(b) for b in range(256)])[list(payload)] for law in (mu_law, a_law))
        root = lambda x: int(np.sqrt((x.astype(object) ** 2).sum() / len(x)))
        want = [f"mu_rms={root(mu)}", f"a_rms={root(a)}", f"mu_pcm16k={zlib.crc32(doubled(mu)):08x}"]
        blocks = [adpcm(payload[b : b + 64]) for b in range(0, len(payload), 64)]
        want.append(f"adpcm_pcm16k={zlib.crc32(doubled(np.array([v for block in blocks for v in block]))):08x}")
        assert r.feature.split(";")[: len(want)] == want
