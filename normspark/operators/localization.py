"""Localization models: spatial references of normal maps, thresholds within a pixel budget, coarse readouts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from normspark.operators import calibration, grids
from normspark.operators.relations import ContractError
from normspark.session import broadcast_if_small, cut

#: Maps that a model is fitted and calibrated on, at least.
LEAST_MAPS = 16


def support_rate(pixels: DataFrame, keys: list[str], image: str, score: str, limits: DataFrame, least_area: int, radius: int) -> DataFrame:
    """``keys, rate``: the share of a group's pixels in the support of its thresholds (``limits``: ``keys, low, high``)."""
    total = pixels.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    kept = grids.seeded_regions(pixels.join(broadcast_if_small(limits), keys), [*keys, image], score, "low", "high", least_area, radius)
    return total.join(kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("_k")), keys, "left").select(*keys, (F.coalesce("_k", F.lit(0)) / F.col("_n")).alias("rate"))


def budgeted_thresholds(pixels: DataFrame, keys: list[str], image: str, score: str, low_quantile: float, high_quantile: float, least_area: int, radius: int, budget: float, steps: int = 24) -> DataFrame:
    """``keys, low, high, rate``: hysteresis thresholds with at most ``budget`` of the (normal) pixels in the support.

    Both start at quantiles of the group's scores (the value at place ``ceil(q * (n - 1))``). Where the support is over the budget, the high one is searched by bisection up to the greatest score, in
    ``steps`` halvings; all groups take a step together, in one job. ``rate`` is the share at the end.
    """
    pixels = cut(pixels.select(*keys, image, "y", "x", F.col(score).cast("double").alias(score)).where(F.col(score).isNotNull() & ~F.isnan(score)))
    low = calibration.higher_quantile(pixels, keys, score, low_quantile, "low").drop("n_values")
    high = calibration.higher_quantile(pixels, keys, score, high_quantile, "high").drop("n_values")
    most = pixels.groupBy(*keys).agg(F.max(score).alias("_top"))
    start = cut(low.join(high, keys).join(most, keys))

    def rates(limits: DataFrame) -> DataFrame:
        return support_rate(pixels, keys, image, score, limits.select(*keys, "low", "high"), least_area, radius)

    state = cut(start.join(rates(start), keys))
    fit = F.col("rate") <= budget
    state = cut(state.select(*keys, "low", F.when(fit, F.col("high")).otherwise(F.col("_top")).alias("_right"), F.col("high").alias("_left"), fit.alias("_done"), "rate"))
    for _ in range(steps):
        busy = state.where("NOT _done")
        if busy.isEmpty():
            break
        middle = busy.withColumn("high", (F.col("_left") + F.col("_right")) / 2)
        now = rates(middle).withColumnRenamed("rate", "_now")
        half = (F.col("_left") + F.col("_right")) / 2
        fits = F.col("_now") <= budget
        state = cut(
            state.join(now, keys, "left").select(
                *keys, "low",
                F.when(F.col("_done") | ~F.coalesce(fits, F.lit(True)), F.col("_right")).otherwise(half).alias("_right"),
                F.when(F.col("_done") | F.coalesce(fits, F.lit(True)), F.col("_left")).otherwise(half).alias("_left"),
                "_done", "rate",
            )
        )
    final = state.withColumnRenamed("_right", "high").drop("rate")
    return final.join(rates(final), keys).select(*keys, "low", "high", "rate")


def fit_localization(fit: DataFrame, calibration_maps: DataFrame, keys: list[str], image: str, score: str, low_quantile: float = 0.98, high_quantile: float = 0.995, region_fraction: float = 0.001, budget: float = 0.005, steps: int = 24, least_maps: int = LEAST_MAPS) -> tuple[DataFrame, DataFrame]:
    """(cells, model): center and scale of each cell of the normal ``fit`` maps, and the thresholds from separate normal maps.

    ``model``: ``keys, kind`` (raw scores or spatial z-scores), ``low, high, rate, global_high, least_area, growth_radius, n_fit, n_calibration``. A group with fewer than
    ``least_maps`` maps of either kind, or whose geometries differ, is a ContractError.
    """
    counts = fit.groupBy(*keys).agg(F.countDistinct(image).alias("n_fit"), F.max("y").alias("_fy"), F.max("x").alias("_fx")).join(
        calibration_maps.groupBy(*keys).agg(F.countDistinct(image).alias("n_calibration"), F.max("y").alias("_cy"), F.max("x").alias("_cx")), keys, "full"
    )
    counts = cut(counts)
    bad = counts.where(f"n_fit IS NULL OR n_calibration IS NULL OR n_fit < {least_maps} OR n_calibration < {least_maps} OR _fy <> _cy OR _fx <> _cx").limit(5).collect()
    if bad:
        raise ContractError(f"too few maps or other geometries: {[r.asDict() for r in bad]}")
    frame = counts.agg(F.max("_fy").alias("y"), F.max("_fx").alias("x")).first()
    height, width = (0, 0) if frame.y is None else (frame.y + 1, frame.x + 1)
    least_area, radius = max(1, -(-int(height * width * region_fraction * 1e9) // 10**9)), max(1, -(-height // 28))
    cells = cut(grids.cell_scale(fit, keys, score))
    z = grids.cell_zscore(calibration_maps, cells, keys, score)
    kinds = F.array(F.struct(F.lit("raw").alias("kind"), F.col(score).cast("double").alias("value")), F.struct(F.lit("spatial").alias("kind"), F.col("z").alias("value")))
    long = cut(z.select(*keys, image, "y", "x", F.explode(kinds).alias("_e")).select(*keys, "_e.kind", image, "y", "x", "_e.value"))
    own = [*keys, "kind"]
    limits = budgeted_thresholds(long, own, image, "value", low_quantile, high_quantile, least_area, radius, budget, steps)
    whole = calibration.higher_quantile(long, own, "value", high_quantile, "global_high").drop("n_values")
    model = limits.join(whole, own).join(counts.select(*keys, "n_fit", "n_calibration"), keys)
    return cells, model.select(*own, "low", "high", "rate", "global_high", F.lit(least_area).alias("least_area"), F.lit(radius).alias("growth_radius"), "n_fit", "n_calibration")


def require_valid(cells: DataFrame, model: DataFrame, budget: float) -> None:
    """Raise ContractError unless a model read from a table is whole: positive scales, thresholds in order, counts, area, radius, budget."""
    if not cells.where("center IS NULL OR isnan(center) OR scale IS NULL OR NOT scale > 0").isEmpty():
        raise ContractError("a cell has no center or no positive scale")
    ordered = "low <= high AND NOT isnan(low) AND NOT isnan(high) AND NOT isnan(global_high)"
    if not model.where(f"NOT coalesce({ordered} AND least_area >= 1 AND growth_radius >= 1 AND rate BETWEEN 0 AND {budget} AND n_fit >= {LEAST_MAPS} AND n_calibration >= {LEAST_MAPS}, false)").isEmpty():
        raise ContractError("a model's thresholds, counts, area, radius or rate aren't valid")


def coarse_support(pixels: DataFrame, keys: list[str], score: str, threshold: str, factor: int) -> DataFrame:
    """``pixels`` with ``support``: thresholded on a grid ``factor`` times coarser, each pixel taking its cell's.

    A cell's value is the bilinear sample of the map at its middle: for an even factor the mean of its four middle pixels, for an odd one its middle pixel. Cells without one of these have the mean of those they have.
    """
    half = factor // 2
    own = {a: F.pmod(F.col(a), F.lit(factor)) for a in ("y", "x")}
    middle = [(c == half) | (c == half - 1) if factor % 2 == 0 else c == half for c in own.values()]
    cell = [F.floor(F.col(a) / factor).alias(f"_c{a}") for a in ("y", "x")]
    coarse = pixels.groupBy(*keys, *cell).agg(F.avg(F.when(middle[0] & middle[1], F.col(score))).alias("_v"), F.max(threshold).alias("_t"))
    joined = pixels.withColumns({"_cy": F.floor(F.col("y") / factor), "_cx": F.floor(F.col("x") / factor)}).join(coarse, [*keys, "_cy", "_cx"])
    return joined.withColumn("support", F.coalesce(F.col("_v") > F.col("_t"), F.lit(False))).drop("_cy", "_cx", "_v", "_t")
