"""Joins and set checks that guard a study: lookups, coverage, alignment, inventories, leakage, group tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    """A table breaks one of its contracts."""


def lookup(df: DataFrame, other: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``df`` with ``columns`` of ``other``, and ``missing``: whether the key isn't there. Each key of ``other`` once."""
    found = other.groupBy(*keys).agg(*(F.first(c).alias(c) for c in columns)).withColumn("_there", F.lit(True))
    return df.join(found, keys, "left").withColumn("missing", F.col("_there").isNull()).drop("_there")


def coverage_gaps(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that are missing from ``actual``, unexpected in it, or there several times; one pass over both sides.

    Nulls compare as equal. ``problem, <keys>, n_actual``.
    """
    both = expected.select(*keys).distinct().withColumns({"_e": F.lit(1), "_a": F.lit(0)}).unionByName(actual.select(*keys).withColumns({"_e": F.lit(0), "_a": F.lit(1)}))
    per_key = both.groupBy(*keys).agg(F.max("_e").alias("_e"), F.sum("_a").alias("n_actual"))
    problem = F.when(F.col("_e") == 0, "unexpected").when(F.col("n_actual") == 0, "missing").when(F.col("n_actual") > 1, "duplicate")
    return per_key.select(problem.alias("problem"), *keys, "n_actual").where("problem IS NOT NULL")


def paired_alignment(old: DataFrame, new: DataFrame, key: str, same: list[str]) -> DataFrame:
    """Rows that spoil a pairing: an id on one side only, or unequal ``same`` columns (null equals null)."""
    a = old.select(F.col(key).alias("_ka"), *(F.col(c).alias(f"_a_{c}") for c in same))
    b = new.select(F.col(key).alias("_kb"), *(F.col(c).alias(f"_b_{c}") for c in same))
    joined = a.join(b, F.col("_ka") == F.col("_kb"), "full")
    differs = F.lit(False)
    for c in same:
        differs = differs | ~F.col(f"_a_{c}").eqNullSafe(F.col(f"_b_{c}"))
    problem = F.when(F.col("_kb").isNull(), "only_old").when(F.col("_ka").isNull(), "only_new").when(differs, "different")
    return joined.select(F.coalesce("_ka", "_kb").alias(key), problem.alias("problem")).where("problem IS NOT NULL")


def inventory_difference(wanted: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """``side`` (missing, unexpected) and key of what only one inventory has."""
    missing = wanted.select(key).distinct().join(present.select(key).distinct(), key, "left_anti").withColumn("side", F.lit("missing"))
    unexpected = present.select(key).distinct().join(wanted.select(key).distinct(), key, "left_anti").withColumn("side", F.lit("unexpected"))
    return missing.unionByName(unexpected)


def leakage(df: DataFrame, key: str, split: str) -> DataFrame:
    """Ids in several splits or several times in one: ``key, n_splits, n_rows``."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.countDistinct(split).alias("n_splits"), F.count(F.lit(1)).alias("n_rows")).where("n_splits > 1 OR n_rows > 1")


def nested_counts(df: DataFrame, dimensions: dict[str, list]) -> DataFrame:
    """Row counts for every combination of the given values of each dimension, 0 where there is none."""
    names = list(dimensions)
    grid = None
    for name, values in dimensions.items():
        axis = df.sparkSession.createDataFrame([(v,) for v in values], f"{name} {df.schema[name].dataType.simpleString()}")
        grid = axis if grid is None else grid.crossJoin(axis)
    counts = df.groupBy(*names).agg(F.count(F.lit(1)).alias("n_rows"))
    return grid.join(counts, names, "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0))) if grid is not None else counts


def group_tables(df: DataFrame, dimensions: list[str], aggregates: list) -> DataFrame:
    """The same aggregates by each dimension on its own, in one table (``dimension, value``); one pass over the rows."""
    pairs = F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions))
    return df.withColumn("_g", F.explode(pairs)).groupBy(F.col("_g.dimension").alias("dimension"), F.col("_g.value").alias("value")).agg(*aggregates)


def require_empty(violations: DataFrame, what: str) -> None:
    """Raise with the first five rows if there are violations."""
    first = violations.limit(5).collect()
    if first:
        raise ContractError(f"{what}: {[r.asDict() for r in first]}")
