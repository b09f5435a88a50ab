"""Queries of the problems in this subpackage, by the names of the contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from normspark.llm import corpus_tokens, fraction_cutoff, leaked_passages, nearest_vectors, oracles, split_overlap, stable_sample, text_quality
from normspark.session import cut, table


def p1_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quick training sample of every experiment and category."""
    return stable_sample.draw(table(spark, sf_dir, "manifest"), table(spark, sf_dir, "experiment_settings")).select("experiment", "category", "sample_id")


def p1_ledger_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger after three draws, with the draw that first held each record."""
    records = table(spark, sf_dir, "manifest")
    span = records.agg(F.min("ingested_at").alias("a"), F.max("ingested_at").alias("b")).first()
    at = [] if span.a is None else [span.a + (span.b - span.a) // f for f in (10, 2)]
    return stable_sample.ledger_growth(records, table(spark, sf_dir, "experiment_settings"), at).select("experiment", "category", "sample_id", "drawn_by")


def _overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_overlap.overlaps(table(spark, sf_dir, "manifest"), table(spark, sf_dir, "grouping_records"), table(spark, sf_dir, "visa_config"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a training and an evaluation record that are the same or nearly the same picture."""
    return _overlaps(spark, sf_dir).select(F.least("train_id", "eval_id").alias("sample_id_a"), F.greatest("train_id", "eval_id").alias("sample_id_b"))


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The overlaps per evaluation split, dataset_version and category."""
    return split_overlap.report(_overlaps(spark, sf_dir), table(spark, sf_dir, "manifest"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of patches of which a probe has the other among its 10 most similar."""
    probes = table(spark, sf_dir, "probe_patches").select(F.col("patch_id").alias("id"))
    found = nearest_vectors.patch_neighbours(table(spark, sf_dir, "patches"), table(spark, sf_dir, "memory_stats"), probes)
    return found.select(F.least("query_id", "id").alias("patch_a"), F.greatest("query_id", "id").alias("patch_b")).distinct()


def p3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 most similar patches of every patch whose id is divisible by 100, against all patches."""
    patches = table(spark, sf_dir, "patches")
    asked = patches.where("patch_id % 100 = 0").select(F.col("patch_id").alias("id"))
    return nearest_vectors.patch_neighbours(patches, table(spark, sf_dir, "memory_stats"), asked).select("query_id", "id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records that the cutoff of their source doesn't keep."""
    base, found = fraction_cutoff.calibrated(table(spark, sf_dir, "calibration_scores"), table(spark, sf_dir, "experiment_settings"))
    return fraction_cutoff.not_kept(base, cut(found))


def p5_cutoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cutoff, records and kept records of every source."""
    base, found = fraction_cutoff.calibrated(table(spark, sf_dir, "calibration_scores"), table(spark, sf_dir, "experiment_settings"))
    return fraction_cutoff.report(base, cut(found))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token ids of every document."""
    return corpus_tokens.encode_corpus(table(spark, sf_dir, "documents"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold the words of a passage of an item in a row."""
    return leaked_passages.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), exact=True).select("doc_id", "item_id")


def p7_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a passage of an item within two edits, and how it differs."""
    return leaked_passages.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), edits=2)


def p7_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items and the number of documents that reveal them."""
    return leaked_passages.per_item(p7_found(spark, sf_dir), table(spark, sf_dir, "eval_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of which less than half stands in running sentences."""
    return text_quality.flagged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "common_words")).where("not_prose").select("doc_id")


def p8_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plain statistics of every document."""
    measured = text_quality.document_statistics(table(spark, sf_dir, "documents"), table(spark, sf_dir, "common_words"))
    plain = ["mean_word_length", "symbol_ratio", "digit_ratio", "punctuated_lines", "common_share", "words_per_line"]
    return measured.select("doc_id", "n_words", *(F.round(c, 6).alias(c) for c in plain))


def p8_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics of every document with percentiles, robust z-scores and tails."""
    return text_quality.profile(table(spark, sf_dir, "documents"), table(spark, sf_dir, "common_words"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_sample, p1_ledger_growth, p2_found, p2_report, p3_found, p3_neighbours, p5_found, p5_cutoffs, p6_ids, p7_found, p7_near, p7_items, p8_found, p8_statistics, p8_profile)
}

ORACLES: dict[str, str] = oracles.ORACLES
