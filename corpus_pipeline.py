"""A corpus pipeline: five operators in a row, each stage written and read again.

language ID -> exact dedup -> SimHash near-dedup -> decontamination -> BPE
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers
from latticework.llm.bpe import bpe_round_trip
from latticework.llm.common import apply_verdicts, materialize, small_batches, table
from latticework.llm.decontaminate import leaks
from latticework.llm.exact_dedup import exact_dedup
from latticework.llm.lang_id import UNDETERMINED, fit_documents, identify
from latticework.llm.simhash_sets import near_duplicates

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Documents of which a smaller share of trigrams speaks for any language are no prose.
MIN_SCORE = 0.1


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; text without letters or language goes.

    A null or empty text goes; a null identifier and repeated rows are no reason to go.
    """
    small_batches(spark)
    told = identify(docs, fit_documents(docs))
    return told.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= MIN_SCORE)).select(*docs.columns)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text: that with the largest doc_id.

    A null text is an empty one; a null identifier comes before all others; of identical rows one stays.
    """
    groups = exact_dedup(docs, keep_text_key=True)
    return apply_verdicts(docs, groups.where("group_size > 1").select("doc_id", "text_key", F.col("kept").alias("keep")), once=True)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 5-word shingle similarity of 0.8 or more: that with the smallest doc_id.

    SimHash tables give the candidates.  Texts without words are one group.  A
    row without identifier stays only where it is linked to no other row with one.
    """
    small_batches(spark)
    linked = near_duplicates(docs).where(~F.col("doc_id").eqNullSafe(F.col("component_id")))
    return apply_verdicts(docs, linked.select("doc_id", "text_key", F.lit(False).alias("keep")))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item; null texts, null identifiers and repeated rows are judged like others."""
    found = leaks(docs, table(spark, sf_dir, "benchmark"))
    return apply_verdicts(docs, found.select("doc_id", "text_key", F.lit(False).alias("keep")))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token ids, their number, and digests of the ids and of the text decoded from them.

    A row for every row: a null text has no ids, a null identifier stays null.
    """
    small_batches(spark)
    return bpe_round_trip(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, keep_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("simhash_near_dedup", near_stage),
    ("decontamination", decontamination_stage),
    ("bpe", token_stage),
]

#: Fingerprints and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


