"""The corpus pipeline: language, exact copies, near copies, mixture, tokens.

Every stage is a function of (spark, docs, sf_dir) and works on all that the stage before kept.  All but the
last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm import bpe, common, dedup, langid, mixing, ngram_join

#: A text stays where its main language has at least this share of its letters.
LEAST_SHARE = 0.3
#: Near copies share this many percent of their shingles of so many words.
SHINGLE_WORDS, SHINGLE_PERCENT = 5, 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that have no letters, null and empty ones included, or no language that leads, go.

    Decisions are by row: the other columns travel with their text through the operator, so repeated rows, null ids and
    columns of any name keep their own.  Very long texts are labelled whole; an empty table stays empty.
    """
    model = langid.fit(docs, ~common.held_out("doc_id"))
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*others).alias("row"), "text")
    found = langid.identify(rows, model, id_col="row", with_text=True).filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE))
    return found.select(*(F.col("text") if c == "text" else F.col(f"doc_id.`{c}`").alias(c) for c in docs.columns))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for the case of A-Z the row with the largest id stays.

    A null text is an empty one; a null id is below all others; of rows that repeat an id and a text one stays.  Very long
    texts are compared whole; an empty table stays empty; other columns may have any name but those that
    ``dedup.keep_one`` reserves.
    """
    return dedup.keep_one(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of texts that share 80 percent of their shingles of 5 words the row with the least id stays.

    Texts without words, null ones included, are in no component and stay, as do rows with a null id.  Rows that repeat
    an id stay or go together.  Very long texts are compared whole; an empty table stays empty; other columns are
    not read, but for the name ``__gone``, which is reserved.
    """
    return ngram_join.keep_one(docs, SHINGLE_WORDS, SHINGLE_PERCENT)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows repeat, or go, by their source's rate, in a global random order.

    A null source is a source of its own; rows with one id, or with null ids, repeat alike.  Texts are not read; an empty
    table stays empty; columns may have any name but ``__replica``, and a column called replica stays.
    """
    return mixing.poisson_mix(docs, replica_col="__replica").drop("__replica")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and their decoding, as digests: doc_id, n_tokens, ids_sha256, decoded_sha256 for each row.

    Null and empty texts have no tokens; repeated rows, which the mixture makes, are encoded each; very long texts are
    encoded whole; an empty table stays empty; other columns are not read.
    """
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("language", language), ("exact_copies", exact_copies), ("near_copies", near_copies), ("mixture", mixture), ("tokens", tokens)]

#: Language models and tokenizers are no SQL; tests/llm holds the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
