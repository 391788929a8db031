"""Corpus pipeline: quality classifier, near-dedup by similarity, suffix-array dedup, source mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from draftloom.llm import bpe, mixing, quality, similar, suffix
from draftloom.llm.shared import as_table, drop_table, load


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, ties at the threshold included, by their whole text alone. Null and empty texts
    are scored like others; null ids stay; repeated rows are judged alike."""
    return quality.keep_good(docs, load(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, a similarity of 0.8 or more. The smallest doc_id stays, null last,
    then by text; of identical rows one. Null texts, empty ones and texts without words are one group; long ones are read whole."""
    return similar.keep_one(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the byte strings that repeat anywhere, all their places cut, whole characters kept. Null and empty texts stay as
    they are, emptied ones stay as empty rows; null ids stay."""
    return suffix.cut_repeats(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix has them, by training position. Empty and null texts have no words and go; null sources are one
    source, the last; repeated rows count each time; equal places follow a hash of id and text."""
    plan = as_table(mixing.mix(docs), "mix")
    return mixing.materialize(docs, plan)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the digest of what they decode to, a row for each of docs; no text, no ids. Long texts are encoded whole."""
    import public_tokenizers

    return bpe.encode_rows(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality", good), ("near_copies", one_of_each), ("repeats", without_repeats), ("mix", mixed), ("tokens", tokens)]

#: SQL has neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, as_table(stage(spark, docs, sf_dir), name)
        if number:  # a stage's table goes once the next one has read it
            drop_table(before)
    return STAGES[-1][1](spark, docs, sf_dir)
