"""Thresholds, conformal p-values, decisions and the rates they lead to."""

from __future__ import annotations

from math import exp, lgamma, log, log1p

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from normspark.functions.ordered import running
from normspark.operators.metrics import ratio
from normspark.session import broadcast_if_small, cut

#: Half width of the bracket around a wanted quantile, and the accuracy of the approximation (its error is 1 / accuracy).
BRACKET, ACCURACY = 0.002, 5_000


def higher_quantile(df: DataFrame, keys: list[str], value: str, q: float, name: str = "threshold") -> DataFrame:
    """The value at place ``ceil(q * (n - 1))`` of each group in rising order.

    An approximate quantile brackets the place; only the values in the bracket (a few in a thousand,
    counted per distinct value) are ordered, so the result is exact and no group is gathered. Null and
    NaN values don't count; a group without values has no row.
    """
    known = df.where(F.col(value).isNotNull() & ~F.isnan(value)).select(*keys, F.col(value).cast("double").alias("_v"))
    at = F.array(F.lit(max(0.0, q - BRACKET)), F.lit(min(1.0, q + BRACKET)))
    bounds = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx("_v", at, ACCURACY).alias("_b"), F.max("_v").alias("_max"))
    bounds = bounds.select(
        *keys,
        "_n",
        F.ceil(F.lit(float(q)) * (F.col("_n") - 1).cast("double")).alias("_place"),
        F.col("_b")[0].alias("_lo"),
        F.when(F.lit(q + BRACKET >= 1), F.col("_max")).otherwise(F.col("_b")[1]).alias("_hi"),
    )
    bounds = cut(bounds)
    joined = known.join(broadcast_if_small(bounds), keys) if keys else known.crossJoin(F.broadcast(bounds))
    # a bracket that misses the place (the approximation was off) is replaced by the group's whole range
    counted = joined.groupBy(*keys, "_place").agg(F.sum((F.col("_v") < F.col("_lo")).cast("long")).alias("_b"), F.sum((F.col("_v") <= F.col("_hi")).cast("long")).alias("_e"))
    missed = counted.where("_place < _b OR _place >= _e").select(*keys, F.lit(True).alias("_missed"))
    if not (missed := cut(missed)).isEmpty():
        wide = F.coalesce("_missed", F.lit(False))
        bounds = bounds.join(missed, keys, "left") if keys else bounds.withColumn("_missed", F.lit(True))
        bounds = cut(bounds.withColumns({"_lo": F.when(wide, F.lit(float("-inf"))).otherwise(F.col("_lo")), "_hi": F.when(wide, F.lit(float("inf"))).otherwise(F.col("_hi"))}).drop("_missed"))
        joined = known.join(broadcast_if_small(bounds), keys) if keys else known.crossJoin(F.broadcast(bounds))
    below = joined.groupBy(*keys).agg(F.sum((F.col("_v") < F.col("_lo")).cast("long")).alias("_below"))
    inside = joined.where("_v BETWEEN _lo AND _hi").groupBy(*keys, "_v", "_n", "_place").agg(F.count(F.lit(1)).alias("_c"))
    inside = inside.join(below, keys) if keys else inside.crossJoin(below)
    upto = F.col("_below") + F.sum("_c").over(Window.partitionBy(*keys).orderBy("_v"))
    return inside.withColumn("_upto", upto).where("_upto > _place").groupBy(*keys).agg(F.min("_v").alias(name), F.first("_n").alias("n_values"))


def conformal_p(test: DataFrame, calibration: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    """``test`` with ``conformal_p``: (1 + calibration scores of its group at least as high) / (1 + their number).

    The theta join becomes a running count over both sides in descending order, per range of the group. A
    test row without calibration rows in its group gets a null. Null scores get a null.
    """
    cal = calibration.where(F.col(score).isNotNull()).select(*keys, F.col(score).cast("double").alias("_s"), F.lit(1).alias("_cal"))
    sizes = cal.groupBy(*keys).agg(F.count(F.lit(1)).alias("_m"))
    asked = test.where(F.col(score).isNotNull()).select(*keys, F.col(score).cast("double").alias("_s")).distinct().withColumn("_cal", F.lit(0))
    both = cal.groupBy(*keys, "_s").agg(F.sum("_cal").alias("_cal")).unionByName(asked)
    counts = running(both, keys, "_s", {"_ge": "_cal"}, descending=True).where("_cal = 0").select(*keys, "_s", "_ge")
    p = counts.join(broadcast_if_small(sizes), keys).select(*keys, "_s", ((F.col("_ge") + 1) / (F.col("_m") + 1)).alias("conformal_p"))
    on = [F.col(f"t.{k}").eqNullSafe(F.col(f"p.{k}")) for k in keys]
    joined = test.alias("t").join(p.alias("p"), [*on, F.col(f"t.{score}").cast("double") == F.col("p._s")], "left")
    return joined.select("t.*", "p.conformal_p")


def three_way(p: Column, alpha: float | Column, review: float | Column) -> Column:
    """anomalous up to ``alpha``, review up to ``review``, normal above; null without a p-value."""
    return F.when(p <= alpha, "anomalous").when(p <= review, "review").when(p > review, "normal")


def binary_decision(score: Column, threshold: Column) -> Column:
    """anomalous strictly above the threshold, else normal; null if either is null."""
    return F.when(score > threshold, "anomalous").when(score <= threshold, "normal")


def gate_override(decision: Column, quality_status: Column) -> Column:
    """A capture that the quality gate rejects is recaptured, whatever was decided."""
    return F.when(quality_status == "recapture", "recapture").otherwise(decision)


SELECTIVE_RATES = ["normal_fpr", "normal_review_rate", "anomaly_confident_recall", "anomaly_review_rate", "anomaly_miss_rate", "review_rate", "auto_coverage", "selective_risk"]


def selective_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    """Numerators and denominators of the selective rates, one pair of columns a rate."""
    normal, anomalous = F.col("target") == 0, F.col("target") == 1
    says = {d: F.col("decision") == d for d in ("normal", "review", "anomalous")}
    auto = says["normal"] | says["anomalous"]
    wrong = (normal & says["anomalous"]) | (anomalous & says["normal"])
    pairs = {
        "normal_fpr": (normal & says["anomalous"], normal),
        "normal_review_rate": (normal & says["review"], normal),
        "anomaly_confident_recall": (anomalous & says["anomalous"], anomalous),
        "anomaly_review_rate": (anomalous & says["review"], anomalous),
        "anomaly_miss_rate": (anomalous & says["normal"], anomalous),
        "review_rate": (says["review"], F.lit(True)),
        "auto_coverage": (auto, F.lit(True)),
        "selective_risk": (wrong, auto),
    }
    known = df.where("target IN (0, 1) AND decision IN ('normal', 'review', 'anomalous')")
    aggs = [F.sum(c.cast("long")).alias(f"{name}_{part}") for name, both in pairs.items() for part, c in zip("kn", both, strict=True)]
    return known.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), *aggs)


def selective_metrics(df: DataFrame, keys: list[str]) -> DataFrame:
    """The eight rates of three-way decisions; a rate of nothing is null."""
    c = selective_counts(df, keys)
    return c.select(*keys, "n_rows", *(ratio(F.col(f"{r}_k"), F.col(f"{r}_n")).alias(r) for r in SELECTIVE_RATES))


def coverage_risk(df: DataFrame, keys: list[str], alpha: float, levels: list[float]) -> DataFrame:
    """Selective metrics at several review levels: rows are exploded over the (few) levels, then grouped once."""
    leveled = df.withColumn("review_level", F.explode(F.array(*(F.lit(x) for x in levels))))
    return selective_metrics(leveled.withColumn("decision", three_way(F.col("conformal_p"), alpha, F.greatest(F.col("review_level"), F.lit(alpha)))), [*keys, "review_level"])


def guarded_metrics(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rates of decisions behind a gate (``rejected`` boolean): rejection, guarded rates, interception.

    A rejected capture is neither a false alarm nor automatic; ``interception_rate`` is the share of wrong
    decisions that the gate took out. Rates of nothing are null.
    """
    normal, anomalous, out = F.col("target") == 0, F.col("target") == 1, F.col("rejected")
    flagged, passed = F.col("decision") == "anomalous", F.col("decision") == "normal"
    auto = ~out & (flagged | passed)
    wrong = (normal & flagged) | (anomalous & passed)

    def n(c: Column) -> Column:
        return F.sum(c.cast("long"))

    return df.where("target IN (0, 1) AND decision IS NOT NULL AND rejected IS NOT NULL").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        ratio(n(out), F.count(F.lit(1))).alias("rejection_rate"),
        ratio(n(out & normal), n(normal)).alias("normal_rejection_rate"),
        ratio(n(normal & ~out & flagged), n(normal)).alias("guarded_normal_fpr"),
        ratio(n(auto), F.count(F.lit(1))).alias("guarded_coverage"),
        ratio(n(auto & wrong), n(auto)).alias("guarded_risk"),
        ratio(n(anomalous & ~out & flagged), n(anomalous)).alias("guarded_recall"),
        ratio(n(anomalous & (out | flagged | (F.col("decision") == "review"))), n(anomalous)).alias("actionable_rate"),
        ratio(n(wrong & out), n(wrong)).alias("interception_rate"),
    )


def calibration_rollup(df: DataFrame, model: str, category: str, score: str, q: float) -> DataFrame:
    """Threshold and size per (model, category) and pooled per model, in one table (``scope``)."""
    own = higher_quantile(df, [model, category], score, q).withColumn("scope", F.lit("category"))
    pooled = higher_quantile(df, [model], score, q).withColumn(category, F.lit(None).cast(df.schema[category].dataType)).withColumn("scope", F.lit("pooled"))
    return own.unionByName(pooled)


def beta_share(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(1 - x, b, a)
    tiny, f, c, d = 1e-300, 1.0, 1.0, 0.0
    for i in range(10_000):
        m = i // 2
        if i == 0:
            step = 1.0
        elif i % 2:
            step = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        else:
            step = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d, c = 1 + step * d, 1 + step / c
        d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
        f *= c * d
        if i and abs(c * d - 1) < 1e-15:
            break
    return exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log1p(-x)) * (f - 1) / a


def clopper_pearson_bounds(k: int, n: int, confidence: float = 0.95) -> tuple[float, float]:
    """The exact interval of a rate, by bisection on the binomial tail; 0 and 1 at the edges."""
    side = (1 - confidence) / 2

    def lower(k: int) -> float:
        """The rate at which ``k`` or more of ``n`` have the chance ``side``."""
        low, high = 0.0, float(k > 0)
        while high - low > 1e-16 + 4e-16 * low and (mid := (low + high) / 2) not in (low, high):
            low, high = (mid, high) if beta_share(mid, k, n - k + 1) < side else (low, mid)
        return (low + high) / 2

    return lower(k), 1 - lower(n - k)


def clopper_pearson(df: DataFrame, k: str, n: str, confidence: float = 0.95) -> DataFrame:
    """``df`` with ``ci_low, ci_high`` of ``k`` of ``n``, computed once for each distinct pair; null if ``n`` is 0 or null."""

    @F.pandas_udf("ci_low double, ci_high double")
    def bounds(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([clopper_pearson_bounds(int(x), int(y), confidence) for x, y in zip(a, b, strict=True)], columns=["ci_low", "ci_high"])

    pairs = df.where(f"{n} > 0 AND {k} BETWEEN 0 AND {n}").select(F.col(k).alias("_k"), F.col(n).alias("_n")).distinct()
    found = pairs.withColumn("_ci", bounds("_k", "_n"))
    return df.join(found, (F.col(k) == F.col("_k")) & (F.col(n) == F.col("_n")), "left").select(df["*"], "_ci.ci_low", "_ci.ci_high")
