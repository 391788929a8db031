"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches."""

from __future__ import annotations

import base64
import hashlib
import os
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches, text_bytes

CHUNK_BYTES = 1_000_000
CACHED_PIECES = 400_000  # below 100 MB in a worker


@lru_cache(1)
def byte_chars() -> list[str]:
    """The character that stands for each byte: itself where it prints, else one from U+0100 on, in order."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = (b for b in range(256) if b not in set(prints))
    return [chr(b) if b in set(prints) else chr(0x100 + k) for b, k in sorted([(b, 0) for b in prints] + [(b, k) for k, b in enumerate(rest)])]


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Codec:
    """A rank file as a ``tokenizers`` BPE model, with the tables for decoding.

    Rank files allow any pair whose concatenation is a token; so each split of a token into two tokens becomes a
    merge, in rank order. Of the splits of one token, the one that the leftmost-first rule prefers stands first.
    """

    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, models, pre_tokenizers

        ranks = load_ranks(path)
        chars = byte_chars()
        spell = {token: "".join(chars[b] for b in token) for token in ranks}
        merges = []
        for token, _ in sorted(ranks.items(), key=lambda kv: kv[1]):
            cuts = [k for k in range(1, len(token)) if token[:k] in ranks and token[k:] in ranks]
            cuts.sort(key=lambda k: (max(ranks[token[:k]], ranks[token[k:]]), k))
            merges += [(spell[token[:k]], spell[token[k:]]) for k in cuts]
        model = models.BPE(vocab={spell[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True)
        self.tokenizer = Tokenizer(model)
        self.tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False, trim_offsets=False)
        self.split = regex.compile(pattern).findall
        self.pieces: dict[str, tuple[int, ...]] = {}
        size = max(ranks.values()) + 1
        self.spelled = [None] * size
        for token, rank in ranks.items():
            self.spelled[rank] = spell[token]
        self.byte_of = np.zeros(max(map(ord, chars)) + 1, np.uint8)
        self.byte_of[[ord(c) for c in chars]] = np.arange(256)
        self.decimal = [str(k) for k in range(size)]
        self.whole = list(range(size))  # one object for each id, whatever remembers it
        self.stand_in = Classes(pattern).stand_in
        self.spans = regex.compile(pattern).finditer

    def pieces_of(self, text: str) -> list[str]:
        """The matches of the pattern. Where a character's class has changed since Unicode 3.2, and so may differ between libraries,
        a character that has the class it has for the rank files' library stands in for it while the text is split."""
        changed = late_characters(text)
        if not changed:
            return self.split(text)
        return [text[m.start() : m.end()] for m in self.spans(text.translate({ord(c): self.stand_in(c) for c in changed}))]

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text. The pieces of all texts meet the library once; those met before are remembered."""
        pieces = [self.pieces_of(t) for t in texts]
        new = set(chain.from_iterable(pieces)).difference(self.pieces)
        if len(self.pieces) + len(new) > CACHED_PIECES:
            self.pieces = {}
            new = set(chain.from_iterable(pieces))
        ordered = list(new)
        for piece, found in zip(ordered, self.tokenizer.encode_batch_fast(ordered, add_special_tokens=False), strict=True):
            self.pieces[piece] = tuple(map(self.whole.__getitem__, found.ids))
        of = self.pieces.__getitem__
        return [list(chain.from_iterable(map(of, p))) for p in pieces]

    def decode_bytes(self, ids: list[int]) -> bytes:
        """The characters that the tokens are spelled in, put back to bytes. Unknown ids raise IndexError; ids that end inside
        a character give those bytes as they are."""
        spelled = self.spelled
        try:
            written = "".join([spelled[k] for k in ids])
        except TypeError:
            raise IndexError("an id that no token has") from None
        return self.byte_of[np.frombuffer(written.encode("utf-16-le"), "<u2")].tobytes()

    def offsets(self, ids: list[int], text: str) -> list[tuple[int, int]]:
        """Character offsets [start, end) of each token; a token inside a split character spans that character."""
        char_of = []
        for k, c in enumerate(text):
            char_of += [k] * len(c.encode())
        out, at = [], 0
        for token in ids:
            end = at + len(self.spelled[token])
            out.append((char_of[at], char_of[end - 1] + 1))
            at = end
        return out

    def split_tokens(self, ids: list[int], data: bytes) -> int:
        """How many tokens end inside a character of ``data``, which they decode to."""
        if data.isascii():
            return 0
        ends = np.cumsum([len(self.spelled[k]) for k in ids])[:-1]
        return int(((np.frombuffer(data, np.uint8)[ends] & 0xC0) == 0x80).sum())


_LATE = regex.compile(r"[^\x00-\u052f]")


@lru_cache(None)
def _char_settled(c: str) -> bool:
    was = unicodedata.ucd_3_2_0.category(c)
    return was != "Cn" and was == unicodedata.category(c)


def late_characters(text: str) -> set[str]:
    """Characters whose class has changed since Unicode 3.2: new scripts, emoji."""
    return {c for c in set(text) if c > "\u052f" and not _char_settled(c)} if _LATE.search(text) else set()


class Classes:
    """The classes that a pattern names, as the rank files' library sees them, asked one character at a time."""

    def __init__(self, pattern: str):
        self.names = sorted(set(regex.findall(r"\\[pP]\{\^?\w+\}|\\s", pattern)))
        self._stand_ins: dict[tuple[bool, ...], str] | None = None
        self._known: dict[str, str] = {}

    def _build(self) -> None:
        import tiktoken

        # with a pattern of one class, a character has ids if it is of that class
        one_byte = {bytes([b]): b for b in range(256)}
        self._ask = [tiktoken.Encoding(name, pat_str=name, mergeable_ranks=one_byte, special_tokens={}) for name in self.names]
        own = [regex.compile(name) for name in self.names]
        self._stand_ins = {}
        for c in map(chr, range(0x80, 0x3100)):
            if _char_settled(c):
                self._stand_ins.setdefault(tuple(o.match(c) is not None for o in own), c)

    def stand_in(self, c: str) -> str:
        """A character of the same classes for which libraries agree. A pattern with a class that none has is an error."""
        if c not in self._known:
            if self._stand_ins is None:
                self._build()
            self._known[c] = self._stand_ins[tuple(bool(a.encode_ordinary(c)) for a in self._ask)]
        return self._known[c]


@lru_cache(4)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def chunks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Runs of rows of about CHUNK_BYTES, so that the encodings held at once stay small."""
    start = 0
    while start < len(texts):
        stop, size = start, 0
        while stop < len(texts) and (stop == start or size < CHUNK_BYTES):
            size += len(texts[stop])
            stop += 1
        yield start, stop
        start = stop


def encode(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", out_col: str = "ids", offsets_col: str | None = None) -> DataFrame:
    """Add ``out_col`` (array of ids) and, if named, ``offsets_col`` (array of character start and end) to ``docs``.

    Null and empty texts give empty arrays. Every row is encoded by itself, so repeated rows give repeated results.
    ``ranks_path`` must be readable at the same place on every worker. Columns with the new names are replaced.
    """
    kind = "array<int>" if offsets_col is None else "struct<ids array<int>, offsets array<struct<start int, end int>>>"

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = codec(ranks_path, pattern)
        for batch in batches:
            texts = ["" if t is None else t for t in batch]
            ids = [row for a, b in chunks([t.encode() for t in texts]) for row in own.encode(texts[a:b])]
            if offsets_col is None:
                yield pd.Series(ids, dtype=object)
            else:
                yield pd.DataFrame({"ids": ids, "offsets": [[{"start": s, "end": e} for s, e in own.offsets(i, t)] for i, t in zip(ids, texts, strict=True)]})

    if offsets_col is None:
        return docs.withColumn(out_col, run(text_col))
    name = "encoded"
    while name in docs.columns:
        name += "_"
    both = docs.withColumn(name, run(text_col))
    return both.withColumns({out_col: F.col(f"{name}.ids"), offsets_col: F.col(f"{name}.offsets")}).drop(name)


def decode(df: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Add ``out_col``: the bytes of ``ids_col``. Null ids give null. Bytes, as ids may end inside a character."""
    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = codec(ranks_path, pattern)
        for batch in batches:
            yield batch.map(lambda ids: None if ids is None else own.decode_bytes(list(ids)))

    return df.withColumn(out_col, run(ids_col))


def _encoded(docs: DataFrame, ranks_path: str, pattern: str, with_ids: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path, pattern)
        say, sha = own.decimal, hashlib.sha256
        for batch in batches:
            doc_ids, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in chunks(texts):
                ids = own.encode([t.decode() for t in texts[a:b]])
                first = [pa.array(ids, pa.list_(pa.int32()))] if with_ids else [pa.array([sha(",".join([say[k] for k in i]).encode()).hexdigest() for i in ids], pa.string())]
                back = [own.decode_bytes(i) for i in ids]
                yield pa.RecordBatch.from_arrays([
                    doc_ids.slice(a, b - a),
                    pa.array([len(i) for i in ids], pa.int64()),
                    *first,
                    pa.array([sha(d).hexdigest() for d in back], pa.string()),
                    pa.array([own.split_tokens(i, d) for i, d in zip(ids, back, strict=True)], pa.int64()),
                ], names)

    schema = f"doc_id long, n_tokens long, {'ids array<int>' if with_ids else 'ids_sha256 string'}, decoded_sha256 string, split_tokens long"
    names = [f.split()[0] for f in schema.split(", ")]
    return small_batches(docs).select(F.col("doc_id").cast("long"), text_bytes().alias("data")).mapInArrow(run, schema)


def encode_digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Per row: doc_id, n_tokens, SHA-256 of the decimal ids joined by commas and of the bytes they decode to, and
    split_tokens, the number of tokens that end inside a character.

    Row-wise, in one pass: ids never leave the worker. Null and empty texts have no ids; very long texts are encoded whole;
    null and repeated ids stay; an empty table gives an empty result; other columns are dropped.
    """
    return _encoded(docs, ranks_path, pattern, with_ids=False)


def encode_rows(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Like :func:`encode_digests`, with the ids themselves in place of their digest."""
    return _encoded(docs, ranks_path, pattern, with_ids=True)
