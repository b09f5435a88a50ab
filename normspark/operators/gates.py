"""Capture-quality gate: robust location and scale, deviations, calibration, disposition, gate tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normspark.operators import calibration
from normspark.operators.metrics import ratio

#: Captures that a category's model is fitted on, at least.
LEAST_ROWS = 16


def robust_scale(long: DataFrame, keys: list[str], value: str, least_rows: int = LEAST_ROWS) -> DataFrame:
    """``keys, n_rows, center, scale``: median, and the largest of 1.4826 MAD, IQR / 1.349 and 1e-5; groups of fewer than ``least_rows`` values have no model."""
    known = long.where(F.col(value).isNotNull() & ~F.isnan(value))
    center = known.groupBy(*keys).agg(F.percentile(value, 0.5).alias("center"), ((F.percentile(value, 0.75) - F.percentile(value, 0.25)) / 1.349).alias("_iqr"), F.count(F.lit(1)).alias("n_rows"))
    mad = known.join(center, keys).groupBy(*keys).agg((F.percentile(F.abs(F.col(value) - F.col("center")), 0.5) * 1.4826).alias("_mad"))
    return center.where(F.col("n_rows") >= least_rows).join(mad, keys).select(*keys, "n_rows", "center", F.greatest("_mad", "_iqr", F.lit(1e-5)).alias("scale"))


def deviation(z: Column, direction: Column) -> Column:
    """How far a measurement is on its bad side: lower counts below, upper above, two_sided both."""
    return F.when(direction == "lower", F.greatest(-z, F.lit(0.0))).when(direction == "upper", F.greatest(z, F.lit(0.0))).when(direction == "two_sided", F.abs(z))


def deviations(long: DataFrame, model: DataFrame, directions: DataFrame, category: str) -> DataFrame:
    """``long`` (one row a capture and metric) with ``deviation`` from the category's model."""
    joined = long.join(F.broadcast(directions), "metric").join(model.select(category, "metric", "center", "scale"), [category, "metric"])
    return joined.withColumn("deviation", deviation((F.col("value") - F.col("center")) / F.col("scale"), F.col("direction"))).drop("center", "scale", "direction")


def gate_scores(deviated: DataFrame, keys: list[str], top: int = 2) -> DataFrame:
    """Per capture the worst deviation (``quality_score``) and the names of the ``top`` worst metrics, ties by name."""
    entries = F.sort_array(F.collect_list(F.struct((-F.col("deviation")).alias("d"), F.col("metric"))))
    return deviated.groupBy(*keys).agg(F.max("deviation").alias("quality_score"), F.slice(F.transform(entries, lambda x: x["metric"]), 1, top).alias("contributors"))


def evaluate_gate(test: DataFrame, reference: DataFrame, category: str, alpha: float) -> DataFrame:
    """``test`` with ``quality_p`` and ``quality_status``: recapture up to ``alpha``, else accept."""
    renamed = test.withColumnRenamed("quality_score", "score")
    p = calibration.conformal_p(renamed, reference.select(category, F.col("quality_score").alias("score")), [category])
    return p.select("*", F.when(F.col("conformal_p") <= alpha, "recapture").when(F.col("conformal_p") > alpha, "accept").alias("quality_status")).withColumnsRenamed({"score": "quality_score", "conformal_p": "quality_p"})


def gate_aggregate(df: DataFrame, keys: list[str]) -> DataFrame:
    """Counts and rejection per group of (``target``, ``rejected``, ``decision``) rows."""
    wrong = ((F.col("target") == 0) & (F.col("decision") == "anomalous")) | ((F.col("target") == 1) & (F.col("decision") == "normal"))
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(F.col("rejected").cast("long")).alias("n_rejected"),
        F.sum(wrong.cast("long")).alias("n_wrong"),
        F.sum((wrong & F.col("rejected")).cast("long")).alias("n_intercepted"),
    )


def gate_comparison(df: DataFrame, gate: str, keys: list[str]) -> DataFrame:
    """The gate table of each gate, with the exact interval of its rejection rate."""
    cells = gate_aggregate(df, [gate, *keys]).withColumn("rejection_rate", ratio(F.col("n_rejected"), F.col("n_rows")))
    return calibration.clopper_pearson(cells, "n_rejected", "n_rows").withColumnsRenamed({"ci_low": "rejection_ci_low", "ci_high": "rejection_ci_high"})


def gate_macro(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Pooled rates over cells: sums of counts, not means of rates."""
    return cells.groupBy(*keys).agg(
        F.sum("n_rows").alias("n_rows"), ratio(F.sum("n_rejected"), F.sum("n_rows")).alias("rejection_rate"), ratio(F.sum("n_intercepted"), F.sum("n_wrong")).alias("interception_rate")
    )
