"""Bootstrap intervals.

The numpy forms draw with PCG64 over units in a given order, so intervals are reproducible to the bit;
a group is one task, so its rows are bounded by ``MOST_UNITS`` (units are categories or the images of one
category and condition). ``bootstrap_two_sample`` draws a larger group in blocks, as many tasks as there are
blocks. ``poisson_mean`` has no bound either: each row gets its weight in every resample from a
hash of its id, partial sums are formed in the map tasks, and only one row a group and task is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normspark.session import broadcast_if_small, cut

MOST_UNITS = 2_000_000
#: Draws that are held at once.
BLOCK = 4_000_000
#: Units of a block of a larger group, about; the finest blocks of a side; draws at once that stay in a core's cache.
BLOCK_UNITS, FINEST, DRAWS = 1 << 16, 4_096, 1 << 14


def _blocks(samples: int, units: int) -> Iterator[int]:
    """Numbers of resamples that are drawn at once; the stream of draws is that of one big draw."""
    size = max(1, BLOCK // max(1, units))
    for start in range(0, samples, size):
        yield min(size, samples - start)


def interval(values: np.ndarray, confidence: float) -> tuple[float | None, float | None]:
    """The central interval of the finite values by linear quantiles; nulls if there is none."""
    finite = values[np.isfinite(values)]
    if not len(finite):
        return None, None
    low, high = np.quantile(finite, [(1 - confidence) / 2, 1 - (1 - confidence) / 2])
    return float(low), float(high)


def mean_interval(values: np.ndarray, seed: int, samples: int, confidence: float) -> tuple[float | None, float | None]:
    """Interval of a mean over independent units; a single unit is its own interval."""
    if not len(values):
        return None, None
    if len(values) == 1:
        return float(values[0]), float(values[0])
    rng = np.random.default_rng(seed)
    means = [rng.choice(values, (n, len(values)), replace=True).mean(1) for n in _blocks(samples, len(values))]
    return interval(np.concatenate(means), confidence)


def _checked(pdf: pd.DataFrame) -> pd.DataFrame:
    if len(pdf) > MOST_UNITS:
        raise ValueError(f"a bootstrap group has {len(pdf)} units, more than {MOST_UNITS}; use poisson_mean")
    return pdf


def _grouped(df: DataFrame, keys: list[str], run: Callable[[pd.DataFrame], dict], schema: str) -> DataFrame:
    kinds = dict(df.dtypes)

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([dict(zip(keys, key, strict=True)) | run(_checked(pdf))])

    return df.groupBy(*keys).applyInPandas(one, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", " + schema)


def bootstrap_mean(df: DataFrame, keys: list[str], value: str, order: str, seed: int, samples: int = 1000, confidence: float = 0.95, least_units: int = 1) -> DataFrame:
    """``keys, n_units, mean, ci_low, ci_high`` over the non-null values in the order of ``order``.

    With fewer than ``least_units`` units the interval is null.
    """

    def run(pdf: pd.DataFrame) -> dict:
        x = pdf.sort_values(order)[value].dropna().to_numpy(np.float64)
        low, high = mean_interval(x, seed, samples, confidence) if len(x) >= least_units else (None, None)
        return {"n_units": len(x), "mean": float(x.mean()) if len(x) else None, "ci_low": low, "ci_high": high}

    return _grouped(df, keys, run, "n_units long, mean double, ci_low double, ci_high double")


def resampled_ranking(target: np.ndarray, scores: np.ndarray, picks: Iterable[np.ndarray]) -> np.ndarray:
    """AUROC, average precision and FPR at 95 % TPR of each resample (row numbers), by counts per distinct score."""
    distinct, place = np.unique(-scores, return_inverse=True)
    out = []
    for own in picks:
        p = np.bincount(place[own], weights=target[own], minlength=len(distinct))
        n = np.bincount(place[own], minlength=len(distinct)) - p
        tp, fp = np.cumsum(p), np.cumsum(n)
        seen = tp + fp > 0
        reach = tp >= 0.95 * tp[-1]
        out.append(((n * (tp - p / 2)).sum() / (tp[-1] * fp[-1]), (p[seen] * tp[seen] / (tp + fp)[seen]).sum() / tp[-1], (fp[reach] / fp[-1]).min()))
    return np.array(out).reshape(-1, 3)


def stratified_picks(target: np.ndarray, seed: int, samples: int) -> Iterator[np.ndarray]:
    """Per resample its row numbers: first draws from the normals, then from the anomalies, as many as there are."""
    rng = np.random.default_rng(seed)
    normal, anomalous = np.flatnonzero(target == 0), np.flatnonzero(target == 1)
    for _ in range(samples):
        yield np.concatenate([rng.choice(part, size=len(part), replace=True) for part in (normal, anomalous)])


def bootstrap_ranking(df: DataFrame, keys: list[str], order: str, seed: int, samples: int = 200, confidence: float = 0.95, target: str = "target", score: str = "score") -> DataFrame:
    """Stratified intervals of the ranking metrics per group; null for groups of one class."""
    names = ["auroc", "average_precision", "fpr_at_95_tpr"]

    def run(pdf: pd.DataFrame) -> dict:
        pdf = pdf.dropna(subset=[target, score]).sort_values(order)
        t, s = pdf[target].to_numpy(np.int64), pdf[score].to_numpy(np.float64)
        if not (t == 0).any() or not (t == 1).any():
            return {f"{n}_{b}": None for n in names for b in ("low", "high")}
        values = resampled_ranking(t, s, stratified_picks(t, seed, samples))
        bounds = [interval(values[:, i], confidence) for i in range(3)]
        return {f"{n}_{b}": x for n, both in zip(names, bounds, strict=True) for b, x in zip(("low", "high"), both, strict=True)}

    return _grouped(df, keys, run, ", ".join(f"{n}_{b} double" for n in names for b in ("low", "high")))


def bootstrap_paired_ranking(df: DataFrame, keys: list[str], order: str, old: str, new: str, seed: int, samples: int = 200, confidence: float = 0.95, target: str = "target") -> DataFrame:
    """Intervals of the differences ``new - old`` of AUROC and average precision with the same draws for both arms."""

    def run(pdf: pd.DataFrame) -> dict:
        pdf = pdf.dropna(subset=[target, old, new]).sort_values(order)
        t = pdf[target].to_numpy(np.int64)
        if not (t == 0).any() or not (t == 1).any():
            return dict.fromkeys(["auroc_delta_low", "auroc_delta_high", "ap_delta_low", "ap_delta_high"])
        after, before = (resampled_ranking(t, pdf[c].to_numpy(np.float64), stratified_picks(t, seed, samples)) for c in (new, old))
        delta = after - before
        (a, b), (c, d) = interval(delta[:, 0], confidence), interval(delta[:, 1], confidence)
        return {"auroc_delta_low": a, "auroc_delta_high": b, "ap_delta_low": c, "ap_delta_high": d}

    return _grouped(df, keys, run, "auroc_delta_low double, auroc_delta_high double, ap_delta_low double, ap_delta_high double")


def bootstrap_paired_ratio(df: DataFrame, keys: list[str], order: str, old: tuple[str, str], new: tuple[str, str], seed: int, samples: int = 500, confidence: float = 0.95) -> DataFrame:
    """Interval of the difference of two ratios of sums over the same resampled rows (images).

    ``old`` and ``new``: (numerator, denominator) columns; nulls count as 0. Resamples without a denominator
    are left out and counted.
    """

    def run(pdf: pd.DataFrame) -> dict:
        x = pdf.sort_values(order)[[*old, *new]].fillna(0).to_numpy(np.float64)
        rng = np.random.default_rng(seed)
        sums = np.concatenate([x[rng.integers(0, len(x), (n, len(x)))].sum(1) for n in _blocks(samples, 4 * len(x))])
        with np.errstate(divide="ignore", invalid="ignore"):
            values = sums[:, 2] / sums[:, 3] - sums[:, 0] / sums[:, 1]
            total = x.sum(0)
            point = total[2] / total[3] - total[0] / total[1]
        low, high = interval(values, confidence)
        return {"delta": float(point) if np.isfinite(point) else None, "ci_low": low, "ci_high": high, "finite_resamples": int(np.isfinite(values).sum())}

    return _grouped(df, keys, run, "delta double, ci_low double, ci_high double, finite_resamples long")


def bootstrap_two_sample(df: DataFrame, keys: list[str], group: str, value: str, order: str, seed: int, samples: int = 500, confidence: float = 0.95) -> DataFrame:
    """Interval of mean(value where group) - mean(value where not), the two samples drawn independently.

    ``group``: a boolean or a number. Groups of more than ``MOST_UNITS`` rows are drawn in blocks (``_two_sample_in_blocks``).
    """
    schema = "difference double, ci_low double, ci_high double"

    def run(pdf: pd.DataFrame) -> dict:
        pdf = pdf.dropna(subset=[group, value]).sort_values(order)
        a, b = (pdf.loc[pdf[group].astype(bool) == side, value].to_numpy(np.float64) for side in (True, False))
        if not len(a) or not len(b):
            return {"difference": None, "ci_low": None, "ci_high": None}
        rng = np.random.default_rng(seed)
        values = np.array([rng.choice(a, len(a)).mean() - rng.choice(b, len(b)).mean() for _ in range(samples)])
        low, high = interval(values, confidence)
        return {"difference": float(a.mean() - b.mean()), "ci_low": low, "ci_high": high}

    rows = df.select(*keys, group, value, order)
    side, x = F.col(group), F.col(value).cast("double")
    usable = side.isNotNull() & ~F.isnan(side.cast("double")) & x.isNotNull() & ~F.isnan(x)
    sided = rows.select(*keys, F.when(usable, side.cast("boolean")).alias("_side"), x.alias("_x"), F.col(order).alias("_order"), F.pmod(F.xxhash64(order, x), F.lit(FINEST)).cast("int").alias("_fine"))
    counts = cut(sided.groupBy(*keys, "_side", "_fine").agg(F.count(F.lit(1)).alias("_n")))  # at most 3 * FINEST rows a group
    sizes = counts.groupBy(*keys).agg(F.sum("_n").alias("_all"))
    large = sizes.where(F.col("_all") > MOST_UNITS)
    if large.isEmpty():
        return _grouped(rows, keys, run, schema)
    drawn = _two_sample_in_blocks(sided, keys, counts, large, seed, samples, confidence, schema)
    if sizes.where(F.col("_all") <= MOST_UNITS).isEmpty():
        return drawn
    named, same = _own_keys(large, keys)
    return drawn.unionByName(_grouped(rows.join(broadcast_if_small(named), same, "left_anti"), keys, run, schema))


def _own_keys(df: DataFrame, keys: list[str]) -> tuple[DataFrame, Column]:
    """``df`` with its keys under other names, and the condition that joins it; null keys are a group, too."""
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_own_{k}"))
    return df.withColumnsRenamed({k: f"_own_{k}" for k in keys}), same


def _two_sample_in_blocks(sided: DataFrame, keys: list[str], counts: DataFrame, large: DataFrame, seed: int, samples: int, confidence: float, schema: str) -> DataFrame:
    """``bootstrap_two_sample`` of the groups ``large``: every unit and resample, with a stream of draws a block.

    A sample of n units with replacement takes a multinomial number of them from each block of a side and, in a block, that many
    units with replacement. A block is the units of some hashes, in their order, so the result doesn't depend on partitions.
    """
    kinds = dict(sided.dtypes)
    typed = "".join(f"`{k}` {kinds[k]}, " for k in keys)
    named, same = _own_keys(large, keys)
    fine = counts.where("_side IS NOT NULL").join(broadcast_if_small(named), same, "left_semi")
    blocks = F.least(F.lit(FINEST), F.pow(F.lit(2), F.greatest(F.lit(0), F.ceil(F.log2(F.sum("_n") / BLOCK_UNITS))))).cast("int")
    layout = fine.groupBy(*keys, "_side").agg(blocks.alias("_blocks"))

    def in_blocks(rows: DataFrame) -> DataFrame:
        own, alike = _own_keys(layout.withColumnRenamed("_side", "_own_side"), keys)
        joined = rows.where("_side IS NOT NULL").join(broadcast_if_small(own), alike & (F.col("_side") == F.col("_own_side")))
        return joined.withColumn("_block", F.col("_fine") % F.col("_blocks"))

    def allot(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """How many units each resample takes from each block of a side."""
        pdf = pdf.sort_values("_block")
        n = pdf["_n"].to_numpy(np.int64)
        taken = np.random.default_rng([seed, 1, int(key[-1])]).multinomial(n.sum(), n / n.sum(), samples)
        return pdf[[*keys, "_side", "_block"]].assign(_taken=list(taken.T))

    def draw(rows: pd.DataFrame, taken: pd.DataFrame) -> pd.DataFrame:
        side, block = (int(taken[c].iloc[0]) for c in ("_side", "_block"))
        x = rows.sort_values(["_order", "_x"])["_x"].to_numpy(np.float64)
        rng = np.random.default_rng([seed, 2, side, block])
        sums = np.array([sum(x[rng.integers(0, len(x), min(DRAWS, n - i))].sum() for i in range(0, n, DRAWS)) for n in taken["_taken"].iloc[0]], np.float64)
        return taken[[*keys, "_side", "_block"]].assign(_n=len(x), _sum=x.sum(), _sums=[sums])

    def combine(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """Sums over the blocks of each side, at most ``FINEST`` of them."""
        own = [pdf[pdf["_side"] == side].sort_values("_block") for side in (True, False)]
        out = {"difference": None, "ci_low": None, "ci_high": None}
        if all(map(len, own)):
            (a, a_mean), (b, b_mean) = ((np.stack(p["_sums"].to_list()).sum(0) / p["_n"].sum(), p["_sum"].sum() / p["_n"].sum()) for p in own)
            low, high = interval(a - b, confidence)
            out = {"difference": float(a_mean - b_mean), "ci_low": low, "ci_high": high}
        return pd.DataFrame([dict(zip(keys, key, strict=True)) | out])

    cells = [*keys, "_side", "_block"]
    allotted = in_blocks(fine).groupBy(*cells).agg(F.sum("_n").alias("_n")).groupBy(*keys, "_side").applyInPandas(allot, typed + "_side boolean, _block int, _taken array<long>")
    sums = in_blocks(sided).select(*cells, "_order", "_x").groupBy(*cells).cogroup(allotted.groupBy(*cells)).applyInPandas(draw, typed + "_side boolean, _block int, _n long, _sum double, _sums array<double>")
    found = sums.groupBy(*keys).applyInPandas(combine, typed + schema)
    # groups without a usable unit have no block
    gone, alike = _own_keys(fine.select(*keys).distinct(), keys)
    return found.unionByName(large.join(gone, alike, "left_anti").select(*keys, *(F.lit(None).cast("double").alias(c.split()[0]) for c in schema.split(", "))))


def poisson_mean(df: DataFrame, keys: list[str], key: str, value: str, seed: int, samples: int = 200, confidence: float = 0.95) -> DataFrame:
    """Interval of the mean per group without a bound on its size: Poisson weights from a hash of id and resample."""
    kinds = dict(df.dtypes)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            h = pdf["_h"].to_numpy(np.int64).astype(np.uint64)
            mixed = (h[:, None] ^ (np.arange(samples, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
            mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
            u = (mixed >> np.uint64(11)).astype(np.float64) / 2.0**53
            weight = sum((u > t).astype(np.float64) for t in np.cumsum(np.exp(-1.0) / np.array([1.0, 1, 2, 6, 24, 120, 720, 5040])))
            x = pdf[value].to_numpy(np.float64)
            codes, groups = pd.factorize(pd.MultiIndex.from_frame(pdf[keys])) if keys else (np.zeros(len(pdf), int), [()])
            for g in range(len(groups)):
                own = codes == g
                yield pd.DataFrame([[*(groups[g] if keys else ()), (weight[own] * x[own, None]).sum(0), weight[own].sum(0)]], columns=[*keys, "s", "w"])

    rows = df.where(F.col(value).isNotNull()).select(*keys, value, F.xxhash64(F.lit(seed), F.col(key)).alias("_h"))
    parts = rows.mapInPandas(partial, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "s array<double>", "w array<double>"]))
    sums = parts.select(*keys, F.posexplode(F.arrays_zip("s", "w")).alias("r", "e")).groupBy(*keys, "r").agg(F.sum("e.s").alias("s"), F.sum("e.w").alias("w"))
    mean = sums.where("w > 0").select(*keys, (F.col("s") / F.col("w")).alias("m"))
    tail = (1 - confidence) / 2
    return mean.groupBy(*keys).agg(F.percentile("m", tail).alias("ci_low"), F.percentile("m", 1 - tail).alias("ci_high"))


def hashed_mean(units: DataFrame, keys: list[str], unit: str, value: str, seed: int, samples: int, confidence: float = 0.95) -> DataFrame:
    """Interval of a mean over a few units with draws from SHA-256, so any engine can repeat it.

    Draw ``j`` of resample ``r`` is the unit at place ``sha256("seed:r:j")`` (first 8 hex digits) modulo the number of units.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(*keys)
    numbered = units.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"), (F.row_number().over(w.orderBy(unit)) - 1).alias("_i"), F.count(F.lit(1)).over(w).alias("_n"))
    draws = numbered.withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    pick = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed).cast("string"), F.col("_r").cast("string"), F.col("_i").cast("string")), 256), 1, 8), 16, 10).cast("long") % F.col("_n")
    picked = draws.select(*keys, "_r", pick.alias("_i")).join(numbered.select(*keys, "_i", "_v"), [*keys, "_i"])
    means = picked.groupBy(*keys, "_r").agg(F.avg("_v").alias("m"))
    tail = (1 - confidence) / 2
    return means.groupBy(*keys).agg(F.percentile("m", tail).alias("ci_low"), F.percentile("m", 1 - tail).alias("ci_high"))
