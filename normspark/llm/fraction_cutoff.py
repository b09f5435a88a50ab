"""Cutoff per source that keeps a target fraction of its records, by distributed quickselect.

Each round takes the median of every partition's still active scores of a source, the weighted
median of those as the source's pivot, counts the scores below and at the pivot, and discards the
side that doesn't hold the target rank. Only one row a source and partition is shuffled for the
pivots and the counts; scores are never gathered, so a source with a third of all records costs no
more than the same rows of many sources. A source leaves the loop when its pivot is the target or
when at most ``FINISH_ROWS`` scores are left, which are then sorted.

Defined results: scores that are null or not finite don't count, nor do rows whose source or
record id is null; a record delivered several times counts once, with its smallest score. Ties
with the cutoff are kept. A source without a usable score or without a fraction has no row; a
fraction outside 0..1 counts as the nearer bound. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from normspark.session import broadcast_if_small, cut, require

#: Scores of a source that are sorted at the end instead of halved again.
FINISH_ROWS = 256
#: Rounds of halving; each leaves at most three quarters of a source, so this is never reached.
MAX_ROUNDS = 200


def _partition_medians(keys: list[str]):
    """For mapInPandas: per partition and source, the weighted median of the batches' medians."""

    def weighted(m: np.ndarray, w: np.ndarray) -> float:
        order = np.argsort(m, kind="stable")
        return float(m[order][np.searchsorted(np.cumsum(w[order]), w.sum() / 2)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[tuple, tuple[list[float], list[int]]] = {}
        for pdf in batches:
            for key, part in pdf.groupby(keys, sort=False)["score"]:
                x = part.to_numpy()
                medians, weights = seen.setdefault(key, ([], []))
                medians.append(float(np.partition(x, (len(x) - 1) // 2)[(len(x) - 1) // 2]))
                weights.append(len(x))
        rows = [(*k, weighted(np.array(m), np.array(w)), sum(w)) for k, (m, w) in seen.items()]
        yield pd.DataFrame(rows, columns=[*keys, "median", "weight"])

    return run


def usable_scores(scores: DataFrame, keys: list[str], record: str = "sample_id") -> DataFrame:
    """The finite scores of each source (``keys``), each record once with its smallest score."""
    require(scores, [*keys, record, "score"])
    known = F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") != float("inf"))
    for c in [*keys, record]:
        known = known & F.col(c).isNotNull()
    return scores.where(known).groupBy(*keys, record).agg(F.min("score").cast("double").alias("score"))


def cutoffs(scores: DataFrame, fractions: DataFrame, keys: list[str], finish_rows: int = FINISH_ROWS) -> DataFrame:
    """Cutoff of each source: its score at place ``ceil(fraction * (n - 1))`` in rising order.

    ``scores``: distinct usable scores (``usable_scores``), materialised by the caller.
    ``fractions``: ``keys`` and ``fraction``, one row a source. Returns ``keys, fraction,
    n_records, cutoff``.
    """
    score_type = ", ".join(f"{c} {t}" for c, t in scores.select(*keys).dtypes)
    base = scores.select(*keys, "score")
    q = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("fraction")))
    state = (
        base.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n_records"))
        .join(fractions.select(*keys, "fraction").where("fraction IS NOT NULL"), keys)
        .select(
            *keys,
            "fraction",
            "n_records",
            F.ceil(q * (F.col("n_records") - 1).cast("double")).cast("long").alias("place"),
            F.col("n_records").alias("active"),
            F.lit(float("-inf")).alias("lo"),
            F.lit(float("inf")).alias("hi"),
            F.lit(None).cast("double").alias("cutoff"),
        )
    )
    state = cut(state)
    within = (F.col("score") > F.col("lo")) & (F.col("score") < F.col("hi"))
    written = None
    for _ in range(MAX_ROUNDS):
        still = state.where("cutoff IS NULL")
        size = still.agg(F.sum("active").alias("total"), F.max("active").alias("most")).first()
        if size.most is None or size.most <= finish_rows:
            break
        # scores that are out are written no more, once at least half of them are
        if written is not None and 2 * size.total <= written:
            base = cut(base.join(broadcast_if_small(still.select(*keys, "lo", "hi")), keys).where(within).select(*keys, "score"))
            written = size.total
        written = size.total if written is None else written
        busy = still.where(F.col("active") > finish_rows)
        active = base.join(broadcast_if_small(busy.select(*keys, "lo", "hi")), keys).where(within)
        medians = active.select(*keys, "score").mapInPandas(_partition_medians(keys), f"{score_type}, median double, weight long")
        # the weighted median of the partitions' medians: the first whose running weight reaches half
        pivots = cut(
            medians.groupBy(*keys)
            .agg(F.sort_array(F.collect_list(F.struct("median", "weight"))).alias("m"), (F.sum("weight") / 2.0).alias("half"))
            .withColumn(
                "pivot",
                F.expr(
                    "aggregate(m, struct(CAST(0 AS BIGINT) AS w, CAST(NULL AS DOUBLE) AS p), (a, x) -> "
                    "struct(a.w + x.weight AS w, coalesce(a.p, IF(a.w + x.weight >= half, x.median, NULL)) AS p), a -> a.p)"
                ),
            )
            .select(*keys, "pivot")
        )
        counts = (
            base.join(broadcast_if_small(busy.select(*keys, "lo", "hi").join(pivots, keys)), keys)
            .where(within)
            .groupBy(*keys, "pivot")
            .agg(F.sum((F.col("score") < F.col("pivot")).cast("long")).alias("below"), F.sum((F.col("score") == F.col("pivot")).cast("long")).alias("at"))
        )
        left, found = F.col("place") < F.col("below"), F.col("place") < F.col("below") + F.col("at")
        moved = state.join(counts, keys, "left").select(
            *keys,
            "fraction",
            "n_records",
            F.when(F.col("pivot").isNull() | left | found, F.col("place")).otherwise(F.col("place") - F.col("below") - F.col("at")).alias("place"),
            F.when(F.col("pivot").isNull(), F.col("active")).when(left, F.col("below")).otherwise(F.col("active") - F.col("below") - F.col("at")).alias("active"),
            F.when(F.col("pivot").isNull() | left | found, F.col("lo")).otherwise(F.col("pivot")).alias("lo"),
            F.when(F.col("pivot").isNotNull() & left, F.col("pivot")).otherwise(F.col("hi")).alias("hi"),
            F.when(F.col("pivot").isNotNull() & ~left & found, F.col("pivot")).otherwise(F.col("cutoff")).alias("cutoff"),
        )
        state = cut(moved)
    else:
        raise RuntimeError("the selection did not converge")
    rest = state.where("cutoff IS NULL").select(*keys, "lo", "hi", F.col("place").alias("_place"))
    tail = (
        base.join(broadcast_if_small(rest), keys)
        .where(within)
        .groupBy(*keys, "_place")
        .agg(F.sort_array(F.collect_list("score")).alias("s"))
        .select(*keys, F.element_at("s", (F.col("_place") + 1).cast("int")).alias("_tail"))
    )
    return state.join(tail, keys, "left").select(*keys, "fraction", "n_records", F.coalesce("cutoff", "_tail").alias("cutoff"))


def calibration_sources(scores: DataFrame, settings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Usable normal validation scores, and the fraction of each (experiment, model, category)."""
    keys = ["experiment", "model", "category"]
    normal = scores.where((F.lower(F.trim("split")) == "validation") & (F.lower(F.trim("label")) == "normal"))
    base = cut(usable_scores(normal, keys))
    per_experiment = settings.groupBy(F.col("name").alias("experiment")).agg(F.max("image_threshold_quantile").alias("fraction"))
    return base, base.select(*keys).distinct().join(per_experiment, "experiment")


def calibrated(scores: DataFrame, settings: DataFrame, finish_rows: int = FINISH_ROWS) -> tuple[DataFrame, DataFrame]:
    """(usable scores, cutoffs) of the calibration sources."""
    base, fractions = calibration_sources(scores, settings)
    return base, cutoffs(base, fractions, ["experiment", "model", "category"], finish_rows)


def report(base: DataFrame, found: DataFrame) -> DataFrame:
    """Per source: fraction, records, cutoff, and the records kept (scores up to the cutoff)."""
    keys = ["experiment", "model", "category"]
    kept = (
        base.join(broadcast_if_small(found.select(*keys, "cutoff")), keys)
        .groupBy(*keys)
        .agg(F.sum((F.col("score") <= F.col("cutoff")).cast("long")).alias("n_kept"))
    )
    return found.join(kept, keys).select(*keys, "fraction", "n_records", "cutoff", "n_kept")


def not_kept(base: DataFrame, found: DataFrame) -> DataFrame:
    """The records above their source's cutoff: ``model, category, sample_id``."""
    keys = ["experiment", "model", "category"]
    return base.join(broadcast_if_small(found.select(*keys, "cutoff")), keys).where("score > cutoff").select("model", "category", "sample_id").distinct()
