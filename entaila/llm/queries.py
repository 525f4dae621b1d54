"""The queries of this subpackage, over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import binary_codes, bpe, html_text, langid, media, near_duplicates, phrase_index, pii, quality, repeats, spelling, token_counts, whitening
from .common import table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_length_histogram(table(spark, sf_dir, "documents"), group_col="lang")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.round_trip(table(spark, sf_dir, "documents"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_index.query(spark, sf_dir)


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.report(table(spark, sf_dir, "pages"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.classes(table(spark, sf_dir, "documents"))


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.report(table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op11_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary_codes.query(spark, sf_dir)


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.query(spark, sf_dir)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.query(spark, sf_dir)


def proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proximity matches on the index of op 5."""
    return phrase_index.proximity(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_quality, op3_media, op4_language, op5_decontamination, op6_html, op7_bpe, op8_near_duplicates, op9_repeats, op10_pii, op11_neighbours, op12_spelling, op13_whitening, proximity,
    )
}
ORACLES = {"op5_decontamination": phrase_index.ORACLE, "op11_neighbours": binary_codes.ORACLE, "op12_spelling": spelling.ORACLE, "proximity": phrase_index.PROXIMITY_ORACLE}
