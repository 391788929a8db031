import hashlib

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from draftloom.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")
EXACT = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})
TEXTS = ["", None, " ", "a", "Hello, wörld! it's 123", "<|endoftext|>", "x" * 5000, " \n\n  \t y", "日本語とemoji 😀👍🏽 ok", "𐔀 new scripts 🫠", "é" * 700, "a b" * 20_000, "\u0000\u007f", "ﬁ ﷺ"]


def test_byte_characters_are_a_bijection():
    chars = bpe.byte_chars()
    assert len(set(chars)) == 256 and chars[65] == "A" and chars[0] == "\u0100" and not any(c.isspace() for c in chars)


@settings(max_examples=300, deadline=None, suppress_health_check=[HealthCheck.too_slow])
@given(st.text(st.one_of(st.sampled_from("aab  \n\t'sé1.-_"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_same_as_the_rank_library(text):
    own = bpe.codec(PATH, P.PATTERN)
    ids = own.encode([text])[0]
    assert ids == EXACT.encode_ordinary(text)
    assert own.decode_bytes(ids) == text.encode()
    offsets = own.offsets(ids, text)
    assert len(offsets) == len(ids) and own.split_tokens(ids, text.encode()) == sum(b > c for (_, b), (c, _) in zip(offsets, offsets[1:]))


def test_every_late_character_is_split_alike():
    """All characters whose class changed, between letters, digits, blanks and marks, through the tokenizers library alone."""
    own = bpe.Codec(PATH, P.PATTERN)
    late = [c for c in map(chr, [*range(0x530, 0xD800), *range(0xE000, 0x32000), *range(0xE0000, 0xE0200)]) if not bpe._char_settled(c)]
    assert len(late) > 50_000
    for start in range(0, len(late), 2_000):
        text = "".join(f"a{c} {c}{c}1{c}.{c}'s " for c in late[start : start + 2_000])
        assert own.encode([text])[0] == EXACT.encode_ordinary(text)


def test_offsets_inside_split_characters():
    own = bpe.codec(PATH, P.PATTERN)
    text = "ab 😀 é"
    ids = own.encode([text])[0]
    offsets = own.offsets(ids, text)
    assert offsets[0][0] == 0 and offsets[-1][1] == len(text)
    at = 0
    for (a, b), i in zip(offsets, ids):
        token = EXACT.decode_single_token_bytes(i)
        assert token in text[a:b].encode()
        at += len(token)
    assert own.decode_bytes(ids[:-1]) == text.encode()[: at - len(EXACT.decode_single_token_bytes(ids[-1]))]


def test_pieces_cache_stays_bounded(monkeypatch):
    own = bpe.Codec(PATH, P.PATTERN)
    monkeypatch.setattr(bpe, "CACHED_PIECES", 3)
    for text in ("one two three four", "two five six", "one one one"):
        assert own.encode([text])[0] == EXACT.encode_ordinary(text)
        assert len(own.pieces) <= 4


def test_tables(spark):
    rows = [(None if k == 3 else k, t, [k], "mine") for k, t in enumerate(TEXTS + TEXTS[:2])]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids array<int>, encoded string")
    want = {t or "": EXACT.encode_ordinary(t or "") for t in TEXTS}
    out = bpe.decode(bpe.encode(df, PATH, P.PATTERN, offsets_col="offsets"), PATH, P.PATTERN).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.ids == want[r.text or ""] and bytes(r.decoded) == (r.text or "").encode() and r.encoded == "mine" and len(r.offsets) == len(r.ids)
    for r in bpe.encode_digests(df, PATH, P.PATTERN).collect():
        text = next(t for k, t, *_ in rows if k == r.doc_id) or ""
        assert (r.n_tokens, r.ids_sha256) == (len(want[text]), hashlib.sha256(",".join(map(str, want[text])).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert sorted(len(r.ids) for r in bpe.encode_rows(df, PATH, P.PATTERN).collect()) == sorted(len(want[t or ""]) for _, t, *_ in rows)
    assert bpe.encode_digests(df.limit(0), PATH, P.PATTERN).count() == 0
    with pytest.raises(IndexError):
        bpe.codec(PATH, P.PATTERN).decode_bytes([10**6])
