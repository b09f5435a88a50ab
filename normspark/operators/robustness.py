"""Comparisons across conditions and models: deltas, transitions, family tables, hypothesis estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from normspark.operators.metrics import correlation, mid_ranks, ranking_metrics


def delta_to_clean(df: DataFrame, keys: list[str], condition: str, metrics: list[str], clean: str = "clean") -> DataFrame:
    """Each row's metrics less those of its group's clean row; null where there is none."""
    base = df.where(F.col(condition) == clean).groupBy(*keys).agg(*(F.first(m).alias(f"_c_{m}") for m in metrics))
    joined = df.join(base, keys, "left")
    return joined.select(df["*"], *((F.col(m) - F.col(f"_c_{m}")).alias(f"delta_{m}") for m in metrics))


def reference_delta(df: DataFrame, model: str, reference: str, keys: list[str], metrics: list[str]) -> DataFrame:
    """Each model's metrics less those of the reference model on the same ``keys``."""
    base = df.where(F.col(model) == reference).select(*keys, *(F.col(m).alias(f"_r_{m}") for m in metrics))
    joined = df.where(F.col(model) != reference).join(base, keys) if keys else df.where(F.col(model) != reference).crossJoin(F.broadcast(base.limit(1)))
    return joined.select(model, *keys, *((F.col(m) - F.col(f"_r_{m}")).alias(f"delta_{m}") for m in metrics))


def transition(target: Column, clean: Column, shifted: Column) -> Column:
    """What became of a prediction under a shift; null if one of the three is null."""
    right_before, right_after = clean == target, shifted == target
    return (
        F.when(target.isNull() | clean.isNull() | shifted.isNull(), None)
        .when(right_before & right_after, "unchanged_correct")
        .when(~right_before & (clean == shifted), "unchanged_error")
        .when(right_before & (target == 0), "new_false_positive")
        .when(right_before & (target == 1), "new_false_negative")
        .when(right_after & (target == 0), "recovered_normal")
        .when(right_after & (target == 1), "recovered_anomaly")
        .otherwise("changed_error")
    )


def with_clean(df: DataFrame, keys: list[str], condition: str, columns: list[str], clean: str = "clean") -> DataFrame:
    """The shifted rows with the columns of the clean row of the same keys as ``clean_<column>``."""
    base = df.where(F.col(condition) == clean).select(*keys, *(F.col(c).alias(f"clean_{c}") for c in columns))
    return df.where(F.col(condition) != clean).join(base, keys)


def failure_clusters(df: DataFrame, keys: list[str]) -> DataFrame:
    """Per group: counts of transitions, failure rate, mean score deltas per label, rank correlation with the clean score.

    ``df`` has ``target, score, clean_score, transition``.
    """
    delta = F.col("score") - F.col("clean_score")
    ranked = mid_ranks(df, keys, {"score": "_r", "clean_score": "_rc"})
    failed = F.col("transition").isin("new_false_positive", "new_false_negative")
    names = ["new_false_positive", "new_false_negative", "recovered_normal", "recovered_anomaly", "unchanged_error"]
    return ranked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        *(F.sum((F.col("transition") == t).cast("long")).alias(f"n_{t}") for t in names),
        F.avg(failed.cast("double")).alias("failure_rate"),
        F.avg(F.when(F.col("target") == 0, delta)).alias("normal_score_delta"),
        F.avg(F.when(F.col("target") == 1, delta)).alias("anomaly_score_delta"),
        correlation("_r", "_rc").alias("score_spearman"),
    )


def family_summary(df: DataFrame, keys: list[str], metrics: list[str], family: str = "family", condition: str = "condition", clean: str = "clean") -> DataFrame:
    """Per family the mean over its conditions of each condition's mean (clean left out)."""
    per_condition = df.where(F.col(condition) != clean).groupBy(*keys, family, condition).agg(*(F.avg(m).alias(m) for m in metrics))
    return per_condition.groupBy(*keys, family).agg(F.count(F.lit(1)).alias("n_conditions"), *(F.avg(m).alias(m) for m in metrics))


def verdict(low: Column, high: Column) -> Column:
    """supported above zero, rejected below, else inconclusive; not_estimable without an interval."""
    return F.when(low.isNull() | high.isNull(), "not_estimable").when(low > 0, "supported").when(high < 0, "rejected").otherwise("inconclusive")


def publication(rows: DataFrame, order: dict[str, list | None]) -> DataFrame:
    """``rows`` of a publication table (a few) with ``place``: by each column in the given order of its values, or (None) in rising order. Other values come last."""
    by = [F.col(c) if values is None else F.coalesce(F.nullif(F.array_position(F.array(*(F.lit(v) for v in values)), F.col(c)), F.lit(0)), F.lit(len(values) + 1)) for c, values in order.items()]
    return rows.withColumn("place", F.row_number().over(Window.orderBy(*by, *order)))


def category_transfer(own: DataFrame, transfer: DataFrame, category: str) -> DataFrame:
    """Per category AUROC and average precision of scores from other categories' vectors, and their difference to the own bank's scores."""
    a, b = (ranking_metrics(x, [category]).select(category, "auroc", "average_precision") for x in (transfer, own))
    b = b.withColumnsRenamed({"auroc": "_a", "average_precision": "_p"})
    return a.join(b, category).withColumns({"delta_auroc": F.col("auroc") - F.col("_a"), "delta_average_precision": F.col("average_precision") - F.col("_p")}).drop("_a", "_p")
