"""Pixel grids in long form (one row a pixel): localization metrics, regions, tiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from normspark.operators.metrics import correlation, ranking_metrics, ratio
from normspark.session import cut


def top_fraction_mean(pixels: DataFrame, keys: list[str], score: str, fraction: float, order: list[str]) -> DataFrame:
    """Mean of the ``max(1, ceil(n * fraction))`` largest scores of each map."""
    n = pixels.where(F.col(score).isNotNull()).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), *order))
    top = n.withColumn("_r", rank).where(F.col("_r") <= F.greatest(F.lit(1), F.ceil(F.col("_n") * F.lit(fraction))))
    return top.groupBy(*keys).agg(F.avg(score).alias("image_score"), F.count(F.lit(1)).alias("n_pixels"))


def top_support_iou(pixels: DataFrame, keys: list[str], a: str, b: str, k: int, order: list[str]) -> DataFrame:
    """Overlap of the ``k`` highest pixels of two maps: both / (2k - both)."""
    w = Window.partitionBy(*keys)
    ranked = pixels.withColumns({"_ra": F.row_number().over(w.orderBy(F.desc(a), *order)), "_rb": F.row_number().over(w.orderBy(F.desc(b), *order))})
    both = F.sum(((F.col("_ra") <= k) & (F.col("_rb") <= k)).cast("long"))
    either = F.sum(((F.col("_ra") <= k) | (F.col("_rb") <= k)).cast("long"))
    return ranked.groupBy(*keys).agg((both / either).alias("iou"))


def mask_measurements(pixels: DataFrame, key: str, label: str, mask: str, support: str) -> DataFrame:
    """Per image: intersection, union and the overlap rates, null unless it is an anomaly with a visible mask.

    ``all_image_iou`` is defined for every image, 1 where mask and support are both empty.
    """
    m, s = F.col(mask), F.col(support)
    agg = pixels.groupBy(key, label).agg(
        F.sum(m.cast("long")).alias("mask_pixels"),
        F.sum(s.cast("long")).alias("support_pixels"),
        F.sum((m & s).cast("long")).alias("intersection"),
        F.sum((m | s).cast("long")).alias("union"),
        F.count(F.lit(1)).alias("n_pixels"),
    )
    visible = (F.col(label) == "anomaly") & (F.col("mask_pixels") > 0)

    def rate(top, bottom):
        return F.when(visible, F.coalesce(ratio(top, bottom), F.lit(0.0)))

    i = F.col("intersection")
    return agg.select(
        "*",
        rate(i, F.col("union")).alias("foreground_iou"),
        rate(2 * i, F.col("mask_pixels") + F.col("support_pixels")).alias("foreground_dice"),
        rate(i, F.col("support_pixels")).alias("foreground_precision"),
        rate(i, F.col("mask_pixels")).alias("foreground_recall"),
        F.coalesce(ratio(i, F.col("union")), F.lit(1.0)).alias("all_image_iou"),
    )


def localization_summary(measured: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Means of the foreground rates over visible anomalies, and the pixel false positive rate of normals (ratio of sums)."""
    normal = F.col(label) == "normal"
    return measured.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_images"),
        F.count("foreground_iou").alias("n_visible"),
        F.avg("foreground_iou").alias("foreground_iou"),
        F.avg("foreground_dice").alias("foreground_dice"),
        F.avg("foreground_recall").alias("foreground_recall"),
        ratio(F.sum(F.when(normal, F.col("support_pixels"))), F.sum(F.when(normal, F.col("n_pixels")))).alias("normal_pixel_fpr"),
        F.avg("all_image_iou").alias("all_image_iou"),
    )


def pixel_metrics(pixels: DataFrame, keys: list[str], image: str, mask: str, score: str, threshold: str) -> DataFrame:
    """Per group: AUROC and average precision over the pixels of all its images, and the mean over images of the IoU of ``score > threshold``.

    An image without mask and support has IoU 1. Null and NaN scores don't count. Groups of one class have null rankings.
    """
    usable = pixels.where(F.col(mask).isNotNull() & F.col(score).isNotNull() & ~F.isnan(score))
    m, s = F.col(mask), F.col(score) > F.col(threshold)
    per_image = usable.groupBy(*keys, image).agg(F.sum((m & s).cast("long")).alias("_i"), F.sum((m | s).cast("long")).alias("_u"))
    ious = per_image.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_images"), F.avg(F.coalesce(ratio(F.col("_i"), F.col("_u")), F.lit(1.0))).alias("pixel_iou_mean"))
    ranked = ranking_metrics(usable.withColumn("_t", m.cast("int")), keys, "_t", score)
    return ious.join(ranked.select(*keys, F.col("auroc").alias("pixel_auroc"), F.col("average_precision").alias("pixel_ap"), (F.col("n_anomalous") + F.col("n_normal")).alias("pixel_count")), keys)


def map_correlation(pixels: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Per pair of maps their Pearson correlation; where one is constant, 1 if the maps are equal throughout, else 0."""
    constant = (F.min(a) == F.max(a)) | (F.min(b) == F.max(b))
    same = F.min((F.col(a) == F.col(b)).cast("double"))
    known = pixels.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    return known.groupBy(*keys).agg(F.when(constant, same).otherwise(correlation(a, b)).alias("correlation"))


def aupro(pixels: DataFrame, keys: list[str], image: str, region: str, score: str, thresholds: int = 100, limit: float = 0.3) -> DataFrame:
    """Per group the area under the mean region overlap against background false positives up to ``limit``, over ``limit``.

    ``region`` numbers the 4-connected components of an image's mask (``labelled_pixels``), null for background. A pixel is found at
    a threshold that its score exceeds; the thresholds lie evenly from the group's highest score to its lowest. Each pixel is put into the bin of the first threshold
    that finds it; counts per region and bin are summed from the top, one pass over the pixels. Of the points up to the limit each false positive rate takes its
    best overlap, overlaps don't fall, and the last one holds up to the limit. Constant maps have 0, groups without background null.
    """
    if not keys:
        return aupro(pixels.withColumn("_all", F.lit(0)), ["_all"], image, region, score, thresholds, limit).drop("_all")
    known = pixels.where(F.col(score).isNotNull() & ~F.isnan(score))
    span = known.groupBy(*keys).agg(F.max(score).cast("double").alias("_hi"), F.min(score).cast("double").alias("_lo"))
    step = (F.col("_hi") - F.col("_lo")) / F.lit(float(thresholds - 1))
    place = F.when(F.col("_hi") > F.col("_lo"), F.floor((F.col("_hi") - F.col(score).cast("double")) / step + 1e-9) + 1).otherwise(F.lit(thresholds)).cast("int")
    binned = cut(known.join(span, keys).groupBy(*keys, image, region, place.alias("_i")).agg(F.count(F.lit(1)).alias("_c")))
    inside = binned.where(F.col(region).isNotNull())
    size = inside.groupBy(*keys, image, region).agg(F.sum("_c").alias("_size"))
    overlap = inside.join(size, [*keys, image, region]).groupBy(*keys, "_i").agg(F.sum(F.col("_c") / F.col("_size")).alias("_o"))
    background = binned.where(F.col(region).isNull()).groupBy(*keys, "_i").agg(F.sum("_c").alias("_b"))
    totals = span.join(size.groupBy(*keys).agg(F.count(F.lit(1)).alias("_regions")), keys, "left").join(background.groupBy(*keys).agg(F.sum("_b").alias("_total")), keys, "left")
    # from here on a group has as many rows as thresholds
    upto = Window.partitionBy(*keys).orderBy("_i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bins = totals.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(thresholds - 1))))
    curve = bins.join(overlap, [*keys, "_i"], "left").join(background, [*keys, "_i"], "left").select(
        *keys,
        F.coalesce(F.sum(F.coalesce("_o", F.lit(0.0))).over(upto) / F.col("_regions"), F.lit(0.0)).alias("pro"),
        (F.sum(F.coalesce("_b", F.lit(0))).over(upto) / F.col("_total")).alias("fpr"),
    )
    start = totals.select(*keys, F.lit(0.0).alias("pro"), F.lit(0.0).alias("fpr"))
    best = curve.where(F.col("fpr") <= limit).unionByName(start).groupBy(*keys, "fpr").agg(F.max("pro").alias("pro"))
    by_fpr = Window.partitionBy(*keys).orderBy("fpr")
    steps = best.withColumn("pro", F.max("pro").over(by_fpr.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    steps = steps.withColumns({"_pf": F.lag("fpr").over(by_fpr), "_pp": F.lag("pro").over(by_fpr), "_last": F.lead("fpr").over(by_fpr).isNull()})
    area = F.coalesce((F.col("fpr") - F.col("_pf")) * (F.col("pro") + F.col("_pp")) / 2, F.lit(0.0))
    tail = F.when(F.col("_last"), (F.lit(limit) - F.col("fpr")) * F.col("pro")).otherwise(0.0)
    value = steps.groupBy(*keys).agg((F.sum(area + tail) / limit).alias("_area"))
    return totals.join(value, keys).select(*keys, F.when(F.col("_hi") <= F.col("_lo"), 0.0).when(F.col("_total").isNotNull(), F.col("_area")).alias("aupro"))


def strata(regions: DataFrame, tiny: float, small: float) -> DataFrame:
    """``regions`` with ``stratum``: tiny, small or large by ``region_fraction``; the bounds belong to the smaller side."""
    f = F.col("region_fraction")
    return regions.withColumn("stratum", F.when(f <= tiny, "tiny").when(f <= small, "small").when(f > small, "large"))


def overlapping_strata(regions: DataFrame, keys: list[str], sample: str) -> DataFrame:
    """Region counts, hits and images for tiny, small, large, small_inclusive (tiny or small) and all."""
    also = F.when(F.col("stratum").isin("tiny", "small"), F.array("stratum", F.lit("small_inclusive"), F.lit("all"))).otherwise(F.array("stratum", F.lit("all")))
    return regions.where("stratum IS NOT NULL").withColumn("stratum", F.explode(also)).groupBy(*keys, "stratum").agg(
        F.count(F.lit(1)).alias("n_regions"),
        F.sum("region_hit").cast("long").alias("n_hits"),
        F.countDistinct(sample).alias("n_images"),
        ratio(F.sum("region_hit"), F.count(F.lit(1))).alias("hit_rate"),
        F.avg("region_recall").alias("mean_recall"),
    )


def region_measurements(pixels: DataFrame, keys: list[str], region: str, support: str, frame_pixels: int, hit_share: float = 0.10) -> DataFrame:
    """Per labelled region: pixels, share of the frame, recall by the support, and whether it counts as hit."""
    recall = F.avg(F.col(support).cast("double"))
    return pixels.where(F.col(region).isNotNull()).groupBy(*keys, region).agg(
        F.count(F.lit(1)).alias("region_pixels"), (F.count(F.lit(1)) / F.lit(frame_pixels)).alias("region_fraction"), recall.alias("region_recall"), (recall >= hit_share).cast("int").alias("region_hit")
    )


def component_labels(frame: np.ndarray, y: np.ndarray, x: np.ndarray, connectivity: int = 8) -> np.ndarray:
    """For pixels of a mask (frame number, y, x) the number of their connected component within the frame.

    Components are numbered from 1 in the reading order of their first pixel. All frames at once: each pixel takes the least place in its
    neighbourhood and then that place's own, until nothing changes.
    """
    n = len(frame)
    if not n:
        return np.empty(0, np.int64)
    width, height = int(x.max()) + 3, int(y.max()) + 3
    key = (frame.astype(np.int64) * height + y + 1) * width + x + 1
    order = np.argsort(key, kind="stable")
    places, back = np.unique(key[order], return_inverse=True)
    steps = [1, width] if connectivity == 4 else [1, width - 1, width, width + 1]
    links = []
    for d in steps:
        at = np.minimum(np.searchsorted(places, places + d), len(places) - 1)
        own = np.flatnonzero(places[at] == places + d)
        links.append((own, at[own]))
    a, b = (np.concatenate(side) for side in zip(*links, strict=True))
    label = np.arange(len(places))
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    while (label != label[label]).any():
        label = label[label]
    # places are in the order of frames and of reading, so roots are too
    roots = np.unique(label)
    first = places[roots] // (height * width)
    number = np.arange(len(roots)) - np.searchsorted(first, first, "left") + 1
    out = np.empty(n, np.int64)
    out[order] = number[np.searchsorted(roots, label)][back]
    return out


def label_regions(mask: np.ndarray, connectivity: int = 8) -> np.ndarray:
    """Connected components of a mask, numbered from 1 in reading order; 0 is background."""
    out = np.zeros(mask.shape, np.int64)
    y, x = np.nonzero(mask)
    out[y, x] = component_labels(np.zeros(len(y), np.int64), y, x, connectivity)
    return out


def labelled_pixels(pixels: DataFrame, keys: list[str], mask: str, connectivity: int = 8) -> DataFrame:
    """``pixels`` with ``region_id`` of the components of an image's mask (``component_labels``), null outside of it.

    ``keys`` name the image; an image, a bounded frame, is in one task, many images at once.
    """
    kinds = ", ".join(f"`{c}` {t}" for c, t in pixels.dtypes)

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        inside = pdf[mask].fillna(False).to_numpy(bool)
        frame = pdf.groupby(keys, sort=False, dropna=False).ngroup().to_numpy()
        number = np.zeros(len(pdf), np.int64)
        number[inside] = component_labels(frame[inside], pdf["y"].to_numpy(np.int64)[inside], pdf["x"].to_numpy(np.int64)[inside], connectivity)
        return pdf.assign(region_id=number.astype("int32"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in batches:
            if not len(pdf):
                continue
            last = pdf[keys].iloc[-1]
            differs = ~(pdf[keys].eq(last) | (pdf[keys].isna() & last.isna())).all(axis=1).to_numpy()
            if differs.any():  # the batch's last image may go on in the next one
                stop = int(np.flatnonzero(differs)[-1]) + 1
                yield label(pd.concat([*held, pdf.iloc[:stop]], ignore_index=True))
                held, pdf = [], pdf.iloc[stop:]
            held.append(pdf)
        if held:
            yield label(pd.concat(held, ignore_index=True))

    out = pixels.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, f"{kinds}, region_id int")
    return out.withColumn("region_id", F.nullif(F.col("region_id"), F.lit(0)))


def seeded_regions(pixels: DataFrame, keys: list[str], score: str, low: str, high: str, least_area: int, radius: int | None = None) -> DataFrame:
    """The support of hysteresis: ``keys, y, x, region_id`` of the kept pixels.

    A pixel is a candidate if its score is above ``low`` and, with a ``radius``, a pixel above ``high`` is within so many rows and columns. The 8-connected components of
    candidates are kept that hold a pixel above ``high`` and have ``least_area`` pixels. Null scores are never candidates.
    """
    rows = pixels.select(*keys, "y", "x", (F.col(score) > F.col(low)).alias("_low"), (F.col(score) > F.col(high)).alias("_high")).where("_low")
    if radius is not None:
        near = rows.where("_high").withColumn("y", F.explode(F.sequence(F.col("y") - radius, F.col("y") + radius)))
        seeds = near.withColumn("x", F.explode(F.sequence(F.col("x") - radius, F.col("x") + radius))).select(*keys, "y", "x").distinct()
        rows = rows.join(seeds, [*keys, "y", "x"], "left_semi")
    labelled = labelled_pixels(rows, keys, "_low")
    kept = labelled.groupBy(*keys, "region_id").agg(F.bool_or("_high").alias("_seeded"), F.count(F.lit(1)).alias("_area")).where(F.col("_seeded") & (F.col("_area") >= least_area))
    return labelled.join(kept.select(*keys, "region_id"), [*keys, "region_id"], "left_semi").select(*keys, "y", "x", "region_id")


#: Readout policies of a localization model.
POLICIES = ["baseline_global", "raw_cleaned", "raw_global", "raw_hysteresis", "spatial_global", "spatial_hysteresis"]


def localization_support(pixels: DataFrame, keys: list[str], score: str, z: str, policy: str, baseline: str, model: dict[str, str], least_area: int, radius: int) -> DataFrame:
    """The support of a policy: ``keys, y, x, region_id`` (null region for ``baseline_global``).

    ``pixels`` has the raw score, its ``z`` against the cell's normal scores, the ``baseline`` threshold and, under the names in ``model``, the fitted thresholds ``raw_low, raw_high,
    spatial_low, spatial_high, spatial_global``. Spatial policies read ``z``; hysteresis grows from high to low within ``radius``; the others
    keep the components above their one threshold.
    """
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy}; there are {POLICIES}")
    spatial = policy.startswith("spatial")
    value = z if spatial else score
    if policy == "baseline_global":
        return pixels.where(F.col(value) > F.col(baseline)).select(*keys, "y", "x", F.lit(None).cast("int").alias("region_id"))
    if policy == "raw_cleaned":
        return seeded_regions(pixels, keys, value, baseline, baseline, least_area, 0)
    if policy.endswith("hysteresis"):
        low, high = (model["spatial_low"], model["spatial_high"]) if spatial else (model["raw_low"], model["raw_high"])
        return seeded_regions(pixels, keys, value, low, high, least_area, radius)
    high = model["spatial_global"] if spatial else model["raw_high"]
    return seeded_regions(pixels, keys, value, high, high, least_area, 0)


def tile_layout(frames: DataFrame, height: str, width: str, tile: int, stride: int) -> DataFrame:
    """``frames`` with a row for each tile (``top, left``); the last tile of an axis is anchored at the edge."""

    def starts(axis: str) -> str:
        return f"CASE WHEN {axis} <= {tile} THEN array(0) ELSE array_distinct(concat(sequence(0, {axis} - {tile}, {stride}), array({axis} - {tile}))) END"

    return frames.withColumn("top", F.explode(F.expr(starts(height)))).withColumn("left", F.explode(F.expr(starts(width))))


def tile_blend(tiles: DataFrame, keys: list[str], size: int, floor: float = 0.05) -> DataFrame:
    """Score of each frame pixel: mean over its tiles, weighted on either axis by ``floor + (1 - floor) sin²`` over the tile.

    ``tiles``: ``keys, top, left, y, x`` (within the tile) and ``score``.
    """

    def weight(axis: str) -> Column:
        return F.lit(floor) + F.lit(1 - floor) * F.pow(F.sin(F.lit(np.pi) * (F.col(axis) + 0.5) / F.lit(size)), F.lit(2))

    w = weight("y") * weight("x")
    return tiles.groupBy(*keys, (F.col("top") + F.col("y")).alias("frame_y"), (F.col("left") + F.col("x")).alias("frame_x")).agg((F.sum(w * F.col("score")) / F.sum(w)).alias("score"))


def lost_mask(pixels: DataFrame, image: str, mask: str, support: str, factor: int) -> DataFrame:
    """``image, lost_mask, fine_cells, coarse_cells, coarse_iou``: a mask sampled at every ``factor``-th pixel of either axis.

    It is lost if it has pixels but none on that grid; the overlap of mask and support on the grid is null where the grid has no mask.
    """
    on_grid = (F.col("y") % factor == 0) & (F.col("x") % factor == 0)
    cells = pixels.groupBy(image, F.floor(F.col("y") / factor).alias("_cy"), F.floor(F.col("x") / factor).alias("_cx")).agg(F.bool_or(mask).alias("_f"), F.bool_or(F.col(mask) & on_grid).alias("_c"), F.bool_or(F.col(support) & on_grid).alias("_s"))

    def n(c: Column) -> Column:
        return F.coalesce(F.sum(c.cast("long")), F.lit(0))

    iou = F.when(F.bool_or("_c"), ratio(n(F.col("_c") & F.col("_s")), n(F.col("_c") | F.col("_s"))))
    return cells.groupBy(image).agg((F.bool_or("_f") & ~F.bool_or("_c")).alias("lost_mask"), n(F.col("_f")).alias("fine_cells"), n(F.col("_c")).alias("coarse_cells"), iou.alias("coarse_iou"))


def cell_scale(reference: DataFrame, keys: list[str], score: str) -> DataFrame:
    """Per cell median and deviation (1.4826 MAD, at least a tenth of the median deviation and 1e-5)."""
    center = reference.groupBy(*keys, "y", "x").agg(F.percentile(score, 0.5).alias("center"))
    mad = reference.join(center, [*keys, "y", "x"]).groupBy(*keys, "y", "x", "center").agg((F.percentile(F.abs(F.col(score) - F.col("center")), 0.5) * 1.4826).alias("mad"))
    floor = mad.groupBy(*keys).agg(F.greatest(F.percentile("mad", 0.5) * 0.1, F.lit(1e-5)).alias("floor"))
    return mad.join(floor, keys).select(*keys, "y", "x", "center", F.greatest("mad", "floor").alias("scale"))


def cell_zscore(pixels: DataFrame, scale: DataFrame, keys: list[str], score: str) -> DataFrame:
    """``pixels`` with ``z``: the score against its cell's center and scale."""
    return pixels.join(scale, [*keys, "y", "x"]).withColumn("z", (F.col(score) - F.col("center")) / F.col("scale")).drop("center", "scale")
