"""The corpus pipeline: five operators, each on all its predecessor kept.

quality classifier -> n-gram Jaccard join -> suffix-array dedup -> benchmark decontamination -> BPE.
Every stage is written and read again; all but the last return the columns of documents, whatever other columns they
have (names that start with `_touchline_` are the operators' own).

Defined results: null and empty texts are scored like a text without words, are each their own component, have no bytes
to remove and no tokens, and count as empty in the last stage; a null doc_id stays null and its row goes last in the choice of
a component's row; repeated rows, and near copies, leave one row; of a text whose bytes all go, an empty text stays;
very long texts are worked on whole; empty tables give no rows, and without labels every document is kept or
dropped by the smoothed share of good labels. Ids of equal rows decide by the smallest row hash.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm import bpe, common, decontaminate, jaccard, quality, suffixes

KEEP_SCORE = 0.3
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Bytes of fifty words: over 95 of 100 runs of 51 words of prose, in each of the four languages, are longer.
PASSAGE_BYTES = 240


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose quality score is under KEEP_SCORE."""
    score = f"{common.OWN}score"
    scored = quality.score(docs, common.table(spark, sf_dir, "labels"), docs.columns, score)
    return scored.filter(F.col(score) >= KEEP_SCORE).drop(score)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies, one of the smallest id."""
    return jaccard.keep_one(docs, repeats=False)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes every byte of passages of PASSAGE_BYTES or more that also stand elsewhere."""
    return suffixes.remove(docs, PASSAGE_BYTES)


def decontaminate_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes spans that also stand in the benchmark."""
    return decontaminate.remove(docs, common.table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the number of tokens, and digests of the ids and of what they decode to."""
    return bpe.encode(docs, public_tokenizers.path(VOCABULARY), ["doc_id"])


STAGES = [
    ("quality_classifier", classify),
    ("ngram_jaccard_join", drop_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("benchmark_decontamination", decontaminate_spans),
    ("bpe_encoding", encode),
]

#: Learned scores and merges are beyond SQL; tests hold run() against plain versions of the stages, chained, given the scores.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
