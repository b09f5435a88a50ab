"""Detection metrics over labelled scores. Ties count as ties; undefined values are null, never NaN."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normspark.functions.ordered import running
from normspark.session import cut


def ratio(top: Column, bottom: Column) -> Column:
    """``top / bottom`` as a double, null where ``bottom`` is 0."""
    return F.when(bottom != 0, top.cast("double") / bottom.cast("double"))


def or_zero(column: Column) -> Column:
    return F.coalesce(column, F.lit(0.0))


def correlation(a: str, b: str) -> Column:
    """Pearson correlation as an aggregate; null where a side is constant."""
    return F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))


def operating_metrics(df: DataFrame, keys: list[str], target: str = "target", predicted: str = "predicted") -> DataFrame:
    """Confusion counts and rates of 0/1 predictions; rates with nothing to divide by are 0 here.

    Rows with a null target or prediction don't count.
    """
    t, p = F.col(target), F.col(predicted)

    def count(a: int, b: int, name: str) -> Column:
        return F.sum(((t == a) & (p == b)).cast("long")).alias(name)

    c = df.where(t.isNotNull() & p.isNotNull()).groupBy(*keys).agg(count(1, 1, "tp"), count(0, 0, "tn"), count(0, 1, "fp"), count(1, 0, "fn"))
    tp, tn, fp, fn = (F.col(x) for x in ("tp", "tn", "fp", "fn"))
    precision, recall = or_zero(ratio(tp, tp + fp)), or_zero(ratio(tp, tp + fn))
    fpr = or_zero(ratio(fp, fp + tn))
    return c.select(
        *keys,
        "tp",
        "tn",
        "fp",
        "fn",
        precision.alias("precision"),
        recall.alias("recall"),
        or_zero(ratio(2 * tp, 2 * tp + fp + fn)).alias("f1"),
        ((recall + or_zero(ratio(tn, tn + fp))) / 2).alias("balanced_accuracy"),
        fpr.alias("normal_fpr"),
    )


def ranking_metrics(df: DataFrame, keys: list[str], target: str = "target", score: str = "score") -> DataFrame:
    """Per group AUROC, average precision, and the least false positive rate at 95 % recall.

    Rows are first brought together per distinct score (map-side), then summed in descending order in
    two levels, so a large group stays parallel. Groups of one class have nulls. Null and NaN scores don't count.
    """
    usable = df.where(F.col(target).isin(0, 1) & F.col(score).isNotNull() & ~F.isnan(score))
    per_score = cut(
        usable.groupBy(*keys, F.col(score).alias("_s")).agg(F.sum(F.col(target).cast("long")).alias("_p"), F.sum((1 - F.col(target)).cast("long")).alias("_n"))
    )
    totals = per_score.groupBy(*keys).agg(F.sum("_p").alias("_all_p"), F.sum("_n").alias("_all_n"))
    curve = running(per_score, keys, "_s", {"_tp": "_p", "_fp": "_n"}, descending=True)
    curve = curve.join(totals, keys) if keys else curve.crossJoin(totals)
    tp, fp, p, n, big_p, big_n = (F.col(c).cast("double") for c in ("_tp", "_fp", "_p", "_n", "_all_p", "_all_n"))
    both = (F.col("_all_p") > 0) & (F.col("_all_n") > 0)
    agg = curve.groupBy(*keys).agg(
        F.first("_all_p").alias("_all_p"),
        F.first("_all_n").alias("_all_n"),
        F.sum(n * (tp - p / 2.0)).alias("_area"),
        F.sum(p * tp / (tp + fp)).alias("_ap"),
        F.min(F.when(tp / F.nullif(big_p, F.lit(0.0)) >= 0.95, fp / F.nullif(big_n, F.lit(0.0)))).alias("_fpr95"),
    )
    return agg.select(
        *keys,
        F.col("_all_p").alias("n_anomalous"),
        F.col("_all_n").alias("n_normal"),
        F.when(both, F.col("_area") / F.nullif(F.col("_all_p").cast("double") * F.col("_all_n").cast("double"), F.lit(0.0))).alias("auroc"),
        F.when(both, F.col("_ap") / F.nullif(F.col("_all_p").cast("double"), F.lit(0.0))).alias("average_precision"),
        F.when(both, F.coalesce("_fpr95", F.lit(1.0))).alias("fpr_at_95_tpr"),
    )


def mid_ranks(df: DataFrame, keys: list[str], columns: dict[str, str]) -> DataFrame:
    """``df`` with the rank of each column (column -> name) within its group, equal values at the mean of their places.

    The distinct values of all columns are counted and summed in one pass.
    """
    values = F.array(*(F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in columns))
    per_value = cut(df.select(*keys, F.explode(values).alias("_e")).groupBy(*keys, F.col("_e.c").alias("_which"), F.col("_e.v").alias("_v")).agg(F.count(F.lit(1)).alias("_c")))
    ranked = cut(running(per_value, [*keys, "_which"], "_v", {"_upto": "_c"}).select(*keys, "_which", "_v", (F.col("_upto") - (F.col("_c") - 1) / 2.0).cast("double").alias("_rank")))
    for column, name in columns.items():
        own = ranked.where(F.col("_which") == column).select(*keys, F.col("_v").alias("_own"), F.col("_rank").alias(name))
        df = df.withColumn("_own", F.col(column).cast("double")).join(own, [*keys, "_own"]).drop("_own")
    return df


def spearman(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Rank correlation per group; if a side is constant, 1 where the ranks are equal throughout, else 0."""
    known = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*keys, F.col(a).alias("_a"), F.col(b).alias("_b"))
    ranked = mid_ranks(known, keys, {"_a": "_ra", "_b": "_rb"})
    out = ranked.groupBy(*keys).agg(
        correlation("_ra", "_rb").alias("_corr"),
        (F.min("_ra") == F.max("_ra")).alias("_ca"),
        (F.min("_rb") == F.max("_rb")).alias("_cb"),
        F.min((F.col("_ra") == F.col("_rb")).cast("int")).alias("_same"),
        F.count(F.lit(1)).alias("n_rows"),
    )
    return out.select(*keys, "n_rows", F.when(F.col("_ca") | F.col("_cb"), F.col("_same").cast("double")).otherwise(F.col("_corr")).alias("spearman"))


def macro_mean(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Means over the rows of each group with equal weight; NaN counts as undefined, like null."""
    clean = df.withColumns({m: F.when(~F.isnan(m), F.col(m)) for m in metrics})
    return clean.groupBy(*keys).agg(*(F.avg(m).alias(m) for m in metrics), *(F.count(m).alias(f"{m}_defined") for m in metrics))


def report_macros(df: DataFrame, keys: list[str], counts: list[str], means: dict[str, tuple[str, Column]], eligible: Column) -> DataFrame:
    """Sums of counts, means of rates over the rows that have them (name -> column, condition), and how many rows there are and are eligible."""
    return df.groupBy(*keys).agg(
        *(F.sum(c).alias(c) for c in counts),
        F.count(F.lit(1)).alias("categories"),
        F.sum(eligible.cast("long")).alias("eligible_categories"),
        *(F.avg(F.when(condition, F.col(c))).alias(name) for name, (c, condition) in means.items()),
    )
