import random
import zlib

import numpy as np

from draftloom.llm import audio


def mu_law(code):
    code = ~code & 0xFF
    size = ((((code & 0x0F) << 3) + 0x84) << ((code & 0x70) >> 4)) - 0x84
    return -size if code & 0x80 else size


def a_law(code):
    code ^= 0x55
    size = (code & 0x0F) << 4
    segment = (code & 0x70) >> 4
    size = size + 8 if segment == 0 else size + 0x108 if segment == 1 else (size + 0x108) << (segment - 1)
    return size if code & 0x80 else -size


def adpcm(block):
    value, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [value]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(audio.STEPS[index])
            diff = step >> 3
            diff += step * bool(code & 4) + (step >> 1) * bool(code & 2) + (step >> 2) * bool(code & 1)
            value = max(-32768, min(32767, value - diff if code & 8 else value + diff))
            index = max(0, min(88, index + int(audio.INDEX_CHANGE[code & 7])))
            out.append(value)
    return out


def test_tables_and_blocks_against_scalar_decoders():
    assert audio.mu_law_table().tolist() == [mu_law(c) for c in range(256)]
    assert audio.a_law_table().tolist() == [a_law(c) for c in range(256)]
    assert (mu_law(0), mu_law(0xFF), a_law(0x55), a_law(0xD5)) == (-32124, 0, -8, 8)
    data = random.Random(1).randbytes(64 * 50)
    blocks = np.frombuffer(data, np.uint8).reshape(-1, 64)
    assert audio.decode_adpcm(blocks).tolist() == [adpcm(data[k : k + 64]) for k in range(0, len(data), 64)]


def test_resampling():
    assert audio.resample_double(np.array([0, 4, -3], np.int16)).tolist() == [0, 2, 4, 0, -3, -3]
    assert audio.resample_double(np.array([], np.int16)).tolist() == []
    assert audio.resample_double(np.array([7], np.int16)).tolist() == [7, 7]


def test_wave_round_trip_and_media_column(spark):
    data = random.Random(2).randbytes(128)
    for tag in (audio.MU_LAW, audio.A_LAW, audio.IMA_ADPCM):
        assert audio.read_wav(audio.wav_bytes(data, tag)) == (tag, 8000, data)
    rows = [(k, audio.wav_bytes(data, t), "mine") for k, t in enumerate((7, 6, 17))] + [(3, None, "x"), (4, b"junk", "x"), (5, b"", "x"), (0, audio.wav_bytes(data, 7), "again")]
    out = audio.decode_media(spark.createDataFrame(rows, "id int, media binary, pcm string")).collect()
    want = {0: [mu_law(b) for b in data], 1: [a_law(b) for b in data], 2: adpcm(data[:64]) + adpcm(data[64:])}
    for r in out:
        if r.id in want:
            assert bytes(r.pcm) == audio.resample_double(np.array(want[r.id], np.int16)).tobytes()
        else:
            assert r.pcm is None


def test_text_features_are_exact_and_equal_for_equal_texts(spark):
    import hashlib

    texts = ["", None, "a", "é" * 32, "é" * 33, "x" * 200_000, "hello wörld", "hello wörld", "日本" * 5000]
    df = spark.createDataFrame([(None if k == 2 else k, t, "f") for k, t in enumerate(texts)], "doc_id long, text string, feature string")
    rows = sorted(audio.text_audio_features(df).collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    order = [k for k in range(len(texts)) if k != 2] + [2]
    for r, k in zip(rows, order):
        data = (texts[k] or "").encode()
        payload = data + bytes(-len(data) % 64 if data else 64)
        stored = audio.wav_bytes(payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(data), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest())
        mu = np.array([mu_law(b) for b in payload], np.int64)
        assert f"mu_rms={int(np.sqrt((mu * mu).sum() / len(mu)))};" in r.feature
        decoded = np.array([v for b in range(0, len(payload), 64) for v in adpcm(payload[b : b + 64])], np.int16) if len(payload) < 1000 else None
        if decoded is not None:
            assert r.feature.endswith(f"adpcm_pcm16k={zlib.crc32(audio.resample_double(decoded)):08x}")
    assert len({tuple(r)[1:] for r in rows}) == len({(t or "") for t in texts})
    assert audio.text_audio_features(df.limit(0)).count() == 0


def test_text_media_are_files_and_their_pcm(spark):
    df = spark.createDataFrame([(1, "abc", "x"), (None, None, "y"), (1, "é" * 900_000, "z")], "doc_id long, text string, media string")
    for r in audio.decode_media(audio.text_media(df), out_col="again").collect():
        assert audio.read_wav(bytes(r.media))[2][: r.n_bytes] in (b"abc", b"", "é".encode() * 900_000) and bytes(r.pcm) == bytes(r.again)
