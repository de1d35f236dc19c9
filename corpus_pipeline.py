"""The corpus pipeline: documents in, packed sequences out. Each stage works on what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from citegauge.llm.common import spare, table, written
from citegauge.llm.decontaminate import drop_contaminated
from citegauge.llm.language_id import UNKNOWN, fit, identify
from citegauge.llm.ngram_join import keep_one
from citegauge.llm.packing import pack, pieces
from citegauge.llm.pii import key_of, pseudonymise


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts whose language can't be told: null and empty ones and those without a letter.

    The rest stay, whatever their language, repeated rows and null ids too; columns stay as they are, but may not be called
    like the two that the operator adds. If no row may be learnt from, or the table is empty, nothing stays.
    """
    told, score = spare(docs, "lang_pred"), spare(docs, "score")
    rows = identify(docs, fit(docs), lang_out=told, score_out=score)
    return rows.where(rows[told] != UNKNOWN).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest doc_id; null ids come last, ties go by the text's hash.

    Texts without a word are nobody's copies and stay, but rows repeated with their id shrink to one. Columns stay as they are.
    """
    return keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with any word inside a benchmark window go.

    Null and empty texts have no words and stay; rows that are kept stay as they are, repeated ones too. An empty benchmark
    keeps everything.
    """
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal values in the texts become pseudonyms under the session's key; lengths, nulls, other rows and columns stay."""
    return pseudonymise(docs, key_of(spark))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequence and place in it. Null and empty texts are one token; repeated rows are packed each."""
    return pack(pieces(docs))


STAGES = [("language", language), ("near_copies", near_copies), ("decontaminated", decontaminated), ("private", private), ("packed", packed)]

#: Language and packing have no SQL; a test holds each stage's rows against a plain program.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
