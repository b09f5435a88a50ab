"""Deterministic splits: nothing depends on row order, everything on digests of ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from normspark.functions.hashing import digest


def stratified_head(df: DataFrame, strata: list[str], order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows of each stratum (a top-k: the limit runs in the map tasks too)."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*strata).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def budget(df: DataFrame, strata: list[str], key: str, seed: int, cap: int) -> DataFrame:
    """Up to ``cap`` rows of each stratum, by the digest of seed and key."""
    return stratified_head(df.withColumn("_h", digest(F.lit(str(seed)), key, separator=":")), strata, ["_h", key], cap).drop("_h")


def validation_target(n: Column, fraction: float) -> Column:
    """``floor(n * fraction + 0.5)``, at least 1 and at most ``n - 1``."""
    return F.greatest(F.lit(1), F.least(n - 1, F.floor(n * F.lit(fraction) + 0.5)))


def hash_split(df: DataFrame, category: str, key: str, seed: int, fraction: float) -> DataFrame:
    """``df`` with ``assigned``: validation for the target number of keys of lowest digest in each category, else train."""
    n = df.groupBy(category).agg(F.count(F.lit(1)).alias("_n"))
    hashed = df.withColumn("_h", digest(F.lit(str(seed)), category, key))
    # the digest is uniform: ranking within its first byte and the counts of the bytes before give the rank in parallel
    byte = F.substring("_h", 1, 2)
    per_byte = hashed.groupBy(category, byte.alias("_b")).agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(category).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    per_byte = per_byte.select(category, "_b", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"))
    rank = F.col("_before") + F.row_number().over(Window.partitionBy(category, "_b").orderBy("_h", key))
    joined = hashed.withColumn("_b", byte).join(per_byte, [category, "_b"]).join(n, category)
    return joined.withColumn("assigned", F.when(rank <= validation_target(F.col("_n"), fraction), "validation").otherwise("train")).drop("_h", "_b", "_n", "_before")


def greedy_split(groups: DataFrame, category: str, group: str, size: str, seed: int, fraction: float) -> DataFrame:
    """``category, group, assigned``: groups in digest order go to validation while that brings it no farther from the target.

    An ordered fold, which may pass over a group and take a later one; the first is always taken, the last never.
    The fold runs over one row a group (a group of duplicates, not a sample).
    """
    ordered = groups.withColumn("_h", digest(F.lit(str(seed)), category, group))
    folded = ordered.groupBy(category).agg(
        F.sort_array(F.collect_list(F.struct("_h", F.col(group).cast("string").alias("g"), F.col(size).cast("long").alias("n")))).alias("a"), F.sum(size).cast("long").alias("total")
    ).withColumn("target", validation_target(F.col("total"), fraction).cast("long"))
    step = (
        "aggregate(slice(a, 1, size(a) - 1), struct(CAST(0 AS BIGINT) AS k, CAST(array() AS ARRAY<STRING>) AS taken), (s, x) -> "
        "IF(size(s.taken) = 0 OR abs(target - s.k - x.n) <= abs(target - s.k), struct(s.k + x.n AS k, concat(s.taken, array(x.g)) AS taken), s))"
    )
    picked = folded.withColumn("s", F.expr(step))
    return picked.select(category, F.explode("a").alias("x"), "s.taken").select(
        category, F.col("x.g").alias(group), F.when(F.array_contains("taken", F.col("x.g")), "validation").otherwise("train").alias("assigned")
    )


def cumulative_split(groups: DataFrame, category: str, group: str, size: str, seed: int, fraction: float) -> DataFrame:
    """Groups in digest order go to validation while the sizes before them stay under the (half-even rounded) target; the last never."""
    h = digest(F.lit(str(seed)), category, group, separator=":")
    w = Window.partitionBy(category).orderBy("_h", group)
    out = groups.withColumn("_h", h).withColumns({
        "_before": F.coalesce(F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "_last": F.lead(group).over(w).isNull(),
        "_total": F.sum(size).over(Window.partitionBy(category)),
    })
    target = F.bround(F.col("_total") * F.lit(fraction))
    return out.select(category, group, F.when((F.col("_before") < target) & ~F.col("_last"), "validation").otherwise("train").alias("assigned"))


def assign_source_split(df: DataFrame, component: str, source_split: str, label: str) -> DataFrame:
    """``df`` with ``assigned`` and ``reason``: test stays test; a training anomaly, or a training row whose component reaches the test set, is excluded."""
    touches = F.max((F.col(source_split) == "test").cast("int")).over(Window.partitionBy(component)) == 1
    reason = F.when(F.col(source_split) == "test", None).when(F.col(label) == "anomaly", "training_anomaly").when(touches, "test_duplicate")
    return df.withColumn("reason", reason).withColumn("assigned", F.when(F.col(source_split) == "test", "test").when(F.col("reason").isNotNull(), "excluded").otherwise("train"))
