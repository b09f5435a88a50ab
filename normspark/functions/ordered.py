"""Running sums in order of a value that stay parallel within a large group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from normspark.session import broadcast_if_small, cut

#: Ranges into which each group is cut.
SPLITS = 32


def in_ranges(df: DataFrame, keys: list[str], value: str, splits: int = SPLITS) -> DataFrame:
    """``df`` with ``_range``: the number of the value's range within its group; equal values share one.

    The bounds are approximate quantiles of the group, so a group that holds a third of all rows is cut
    into ranges of about the same size. They only decide where work is done, never a result.
    """
    at = F.array(*(F.lit(i / splits) for i in range(1, splits)))
    bounds = cut(df.groupBy(*keys).agg(F.percentile_approx(value, at, 1_000).alias("_bounds")))
    joined = df.join(broadcast_if_small(bounds), keys) if keys else df.crossJoin(F.broadcast(bounds))
    return joined.withColumn("_range", F.size(F.expr(f"filter(_bounds, b -> b < {value})"))).drop("_bounds")


def running(df: DataFrame, keys: list[str], value: str, sums: dict[str, Column | str], descending: bool = False, splits: int = SPLITS) -> DataFrame:
    """``df`` with running sums within ``keys`` in the order of ``value``, rows of equal value included.

    ``sums``: name of the running sum -> column that is summed. Two levels: a window within each range of
    the group, and the totals of the ranges before it (``splits`` rows a group).
    """
    named = df.withColumns({f"_x_{n}": (F.col(c) if isinstance(c, str) else c) for n, c in sums.items()})
    ranged = in_ranges(named, keys, value, splits)
    direction = F.desc if descending else F.asc
    totals = ranged.groupBy(*keys, "_range").agg(*(F.sum(f"_x_{n}").alias(f"_t_{n}") for n in sums))
    before = Window.partitionBy(*keys).orderBy(direction("_range")).rowsBetween(Window.unboundedPreceding, -1)
    totals = cut(totals.select(*keys, "_range", *(F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums)))
    inside = Window.partitionBy(*keys, "_range").orderBy(direction(value)).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    out = ranged.join(broadcast_if_small(totals), [*keys, "_range"])
    out = out.withColumns({n: F.sum(f"_x_{n}").over(inside) + F.col(f"_o_{n}") for n in sums})
    return out.drop("_range", *(f"_x_{n}" for n in sums), *(f"_o_{n}" for n in sums))


def places(df: DataFrame, keys: list[str], order: list[str], name: str = "place") -> DataFrame:
    """``df`` with each row's place within ``keys`` by ``order``, from 1; ``order`` should tell rows apart.

    The rows are cut into ranges over all keys, so a large group is many ranges; a place is the row's number in its
    range and the group's rows in the ranges before it. Null keys are a group.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df.repartitionByRange(ranges, *keys, *order).withColumn("_range", F.spark_partition_id()))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n")).withColumn("_o", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    totals = cut(totals.select(*(F.col(k).alias(f"_k_{k}") for k in keys), F.col("_range").alias("_r"), "_o"))
    on = F.col("_range") == F.col("_r")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order))
    out = ranged.withColumn("_i", inside).join(broadcast_if_small(totals), on)
    return out.withColumn(name, F.col("_i") + F.col("_o")).select(*df.columns, name)
