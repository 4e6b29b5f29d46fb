"""The queries opN_* over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, decontam, hmm, langid, license_scan, merkle, neardup, negatives, pages, resample, secrets, substrings
from .common import table, tokenizer_path


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.held_out(docs, langid.fit(docs))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(table(spark, sf_dir, "documents"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.digests(docs, secrets.fit(docs))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.compare_with_next(table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(table(spark, sf_dir, "documents"))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(table(spark, sf_dir, "documents"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digests(chat.format_conversations(chat.with_probe(table(spark, sf_dir, "conversations"))))


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.digests(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.main_text(table(spark, sf_dir, "pages"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


def secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.base_counts(docs, secrets.fit(docs))


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.edited_texts(table(spark, sf_dir, "documents"))


def lm_base_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.base_scores(table(spark, sf_dir, "documents"))


#: The operators, and parts of the results of three of them that SQL can express.
EVERY = (
    op1_language_id, op2_license_scan, op3_decontamination, op4_near_duplicates, op5_secret_scan, op6_bpe, op7_fingerprints, op8_substring_dedup, op9_lm_score, op10_chat_format,
    op11_resample, op12_main_text, op13_hard_negatives,
    secret_counts, edited_texts, lm_base_scores,
)
SQL = {
    "op2_license_scan": license_scan.ORACLE, "op4_near_duplicates": neardup.ORACLE, "op8_substring_dedup": substrings.ORACLE, "op10_chat_format": chat.ORACLE,
    "op11_resample": resample.ORACLE, "op13_hard_negatives": negatives.ORACLE,
    "secret_counts": secrets.ORACLE_COUNTS, "edited_texts": merkle.ORACLE_EDITED, "lm_base_scores": hmm.ORACLE_BASE,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in EVERY}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
