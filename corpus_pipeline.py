"""From raw documents to packed windows: the stages of a training corpus, one after the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosspanel.llm.common import documents, written
from crosspanel.llm.language import keep_identified
from crosspanel.llm.packing import pack_documents
from crosspanel.llm.pii import pseudonymise
from crosspanel.llm.queries import pseudonym_key
from crosspanel.llm.similarity import keep_one_of_each
from crosspanel.llm.substrings import without_repeats


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told.

    Null and empty texts, and texts without letters, go. Texts of any length are read whole; repeated
    rows stay repeated; an empty table gives an empty table; further columns, whatever their names,
    stay. These hold for all stages; what follows for each is what differs.
    """
    return keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones, that of the smallest doc_id.

    Null and empty texts are similar to none and stay, as do rows without a doc_id. Of rows that
    repeat doc_id and text one stays, the first by its columns in JSON.
    """
    return keep_one_of_each(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 50 words that an earlier document has.

    Null and empty texts, texts of fewer words and rows without a doc_id stay as they are. A document
    goes if nothing is left of it. Of rows with equal doc_ids neither is the earlier.
    """
    return without_repeats(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with pseudonyms for personal data, under the session's key.

    Null texts stay null; texts without personal data stay as they are. Without a key of the session
    one is drawn at random for this run.
    """
    made = pseudonymise(docs, pseudonym_key(spark), counted=None)
    return made.select(*[F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the texts' tokens, with their ids, in windows of 2048.

    Null and empty texts are one token, the end mark. The last stage: columns but doc_id go.
    """
    return pack_documents(docs, with_ids=True)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("substrings", substrings), ("pii", pii), ("packing", packing)]

#: SQL can express neither the classifier nor the tokenizer.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written and read again by the next."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
