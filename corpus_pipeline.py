"""Corpus pipeline: documents in, token ids of the clean and distinct ones out.

Each stage works on all that the one before it kept. All but the last return the columns of
``documents``; ``run`` chains them, writing each stage's rows once to the shared folder. Other
columns, of any name, go along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from colloquy.llm.common import held_out, materialise, read_table
from colloquy.llm.decontam import drop_leaks
from colloquy.llm.langid import fit_languages, keep_identified
from colloquy.llm.pieces import encode_pieces
from colloquy.llm.similar import keep_dissimilar
from colloquy.llm.toxicity import drop_toxic, fit_toxicity

#: Mean word probability below which no language is certain enough.
LEAST_LANGUAGE = 0.4


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without words, null ones too, or whose words don't agree on a language, go.

    Without any labelled row no language is known, and all rows stay. Repeated rows share their
    fate; an empty table stays empty.
    """
    return keep_identified(docs, fit_languages(docs.where(~held_out("doc_id"))), LEAST_LANGUAGE)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that are more likely toxic than not go; null text counts as empty, repeated rows share their fate."""
    labels = read_table(spark, sf_dir, "labels").where(~held_out("doc_id"))
    return drop_toxic(docs, fit_toxicity(docs, labels))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, Jaccard 0.8 or more of five-word shingles, stays.

    They are met by SimHash, as in ``op9``, and checked; what three bits do not reach meets in bands.
    It is the one of least id, null ids last. Of repeated rows, and of texts without words, one stays.
    """
    return keep_dissimilar(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go; null texts hold none, and an empty benchmark removes nothing."""
    return drop_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def sentence_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of them and of the text they decode to; none for null or empty text."""
    return encode_pieces(docs, keep_text=False)


STAGES = [
    ("language_id", language_id),
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("sentence_pieces", sentence_pieces),
]

#: No stage can be stated in SQL; the tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
