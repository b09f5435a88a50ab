"""Queries over predictions, calibration scores and decisions, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from normspark.operators import calibration, metrics, robustness
from normspark.plans import study
from normspark.session import cut

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CELL = ["model", "category", "condition", "family", "severity"]


def query(sql: str | None = None, base: bool = True):
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = (study.SQL if base else "") + sql
        return f

    return register


def rounded(df: DataFrame, columns: list[str], places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


def _operating(s: SparkSession, d: str) -> DataFrame:
    return metrics.operating_metrics(study.predictions(s, d), CELL)


@query("SELECT sample_id, category, round(conformal_p, 9) AS conformal_p FROM p")
def conformal_p(s, d):
    return rounded(study.decided(s, d).select("sample_id", "category", "conformal_p"), ["conformal_p"], 9)


@query("SELECT sample_id, decision FROM decided")
def three_way_decision(s, d):
    return study.decided(s, d).select("sample_id", "decision")


@query("SELECT t.sample_id, CASE WHEN score > threshold THEN 'anomalous' ELSE 'normal' END AS decision FROM test t JOIN threshold USING (category)")
def binary_decision(s, d):
    rows = study.test_rows(s, d).join(study.thresholds(s, d), "category")
    return rows.select("sample_id", calibration.binary_decision(F.col("score"), F.col("threshold")).alias("decision"))


@query("SELECT category, threshold, n_values FROM threshold")
def higher_quantile(s, d):
    return study.thresholds(s, d)


_SELECTIVE = """
  count(*) AS n_rows,
  round(count(*) FILTER (target = 0 AND decision = 'anomalous')::DOUBLE / nullif(count(*) FILTER (target = 0), 0), 6) AS normal_fpr,
  round(count(*) FILTER (target = 0 AND decision = 'review')::DOUBLE / nullif(count(*) FILTER (target = 0), 0), 6) AS normal_review_rate,
  round(count(*) FILTER (target = 1 AND decision = 'anomalous')::DOUBLE / nullif(count(*) FILTER (target = 1), 0), 6) AS anomaly_confident_recall,
  round(count(*) FILTER (target = 1 AND decision = 'review')::DOUBLE / nullif(count(*) FILTER (target = 1), 0), 6) AS anomaly_review_rate,
  round(count(*) FILTER (target = 1 AND decision = 'normal')::DOUBLE / nullif(count(*) FILTER (target = 1), 0), 6) AS anomaly_miss_rate,
  round(count(*) FILTER (decision = 'review')::DOUBLE / count(*), 6) AS review_rate,
  round(count(*) FILTER (decision <> 'review')::DOUBLE / count(*), 6) AS auto_coverage,
  round(count(*) FILTER ((target = 0 AND decision = 'anomalous') OR (target = 1 AND decision = 'normal'))::DOUBLE / nullif(count(*) FILTER (decision <> 'review'), 0), 6) AS selective_risk
"""


@query(f"SELECT category, {_SELECTIVE} FROM decided GROUP BY category")
def selective_metrics(s, d):
    return rounded(calibration.selective_metrics(study.decided(s, d), ["category"]), calibration.SELECTIVE_RATES)


@query(
    ", levels(review_level) AS (VALUES (0.05::DOUBLE), (0.1), (0.2), (0.3), (0.4), (0.5)),"
    " leveled AS (SELECT p.*, review_level, CASE WHEN conformal_p <= 0.05 THEN 'anomalous' WHEN conformal_p <= review_level THEN 'review' ELSE 'normal' END AS decision FROM p CROSS JOIN levels)"
    f" SELECT category, review_level, {_SELECTIVE} FROM leveled GROUP BY category, review_level"
)
def coverage_risk(s, d):
    return rounded(calibration.coverage_risk(study.decided(s, d), ["category"], study.ALPHA, [0.05, 0.1, 0.2, 0.3, 0.4, 0.5]), calibration.SELECTIVE_RATES)


@query(
    ", g AS (SELECT *, bucket % 10 = 0 AS rejected FROM decided)"
    " SELECT category, count(*) AS n_rows, round(avg(rejected::INT), 6) AS rejection_rate,"
    " round(count(*) FILTER (rejected AND target = 0)::DOUBLE / nullif(count(*) FILTER (target = 0), 0), 6) AS normal_rejection_rate,"
    " round(count(*) FILTER (target = 0 AND NOT rejected AND decision = 'anomalous')::DOUBLE / nullif(count(*) FILTER (target = 0), 0), 6) AS guarded_normal_fpr,"
    " round(count(*) FILTER (NOT rejected AND decision <> 'review')::DOUBLE / count(*), 6) AS guarded_coverage,"
    " round(count(*) FILTER (NOT rejected AND ((target = 0 AND decision = 'anomalous') OR (target = 1 AND decision = 'normal')))::DOUBLE / nullif(count(*) FILTER (NOT rejected AND decision <> 'review'), 0), 6) AS guarded_risk,"
    " round(count(*) FILTER (target = 1 AND NOT rejected AND decision = 'anomalous')::DOUBLE / nullif(count(*) FILTER (target = 1), 0), 6) AS guarded_recall,"
    " round(count(*) FILTER (target = 1 AND (rejected OR decision <> 'normal'))::DOUBLE / nullif(count(*) FILTER (target = 1), 0), 6) AS actionable_rate,"
    " round(count(*) FILTER (rejected AND ((target = 0 AND decision = 'anomalous') OR (target = 1 AND decision = 'normal')))::DOUBLE / nullif(count(*) FILTER ((target = 0 AND decision = 'anomalous') OR (target = 1 AND decision = 'normal')), 0), 6) AS interception_rate"
    " FROM g GROUP BY category"
)
def guarded_metrics(s, d):
    rows = study.decided(s, d).withColumn("rejected", F.col("bucket") % 10 == 0)
    rates = ["rejection_rate", "normal_rejection_rate", "guarded_normal_fpr", "guarded_coverage", "guarded_risk", "guarded_recall", "actionable_rate", "interception_rate"]
    return rounded(calibration.guarded_metrics(rows, ["category"]), rates)


@query("SELECT sample_id, CASE WHEN bucket % 10 = 0 THEN 'recapture' ELSE decision END AS decision FROM decided")
def gate_override(s, d):
    status = F.when(F.col("bucket") % 10 == 0, "recapture").otherwise("accept")
    return study.decided(s, d).select("sample_id", calibration.gate_override(F.col("decision"), status).alias("decision"))


@query(
    ", pooled AS (SELECT score, row_number() OVER (ORDER BY score) - 1 AS place, count(*) OVER () AS n FROM cal)"
    " SELECT 'category' AS scope, category, threshold, n_values FROM threshold"
    " UNION ALL SELECT 'pooled', NULL, max(score), max(n) FROM pooled WHERE place = ceil(0.95 * (n - 1))"
)
def calibration_rollup(s, d):
    rows = study.calibration_rows(s, d).withColumn("model", F.lit("direct"))
    return calibration.calibration_rollup(rows, "model", "category", "score", study.QUANTILE).select("scope", "category", "threshold", "n_values")


_RATES = ["precision", "recall", "f1", "balanced_accuracy", "normal_fpr"]
_ROUNDED = ", ".join(f"round({r}, 6) AS {r}" for r in _RATES)


@query(f"SELECT model, category, condition, family, severity, tp, tn, fp, fn, {_ROUNDED} FROM operating")
def operating_metrics(s, d):
    return rounded(_operating(s, d), _RATES)


_CURVE = """
, per AS (SELECT model, category, condition, score, sum(target)::BIGINT AS p, sum(1 - target)::BIGINT AS n FROM predictions GROUP BY ALL),
curve AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER (PARTITION BY model, category, condition) AS pp, sum(n) OVER (PARTITION BY model, category, condition) AS nn
  FROM per WINDOW w AS (PARTITION BY model, category, condition ORDER BY score DESC))
SELECT model, category, condition, max(pp)::BIGINT AS n_anomalous, max(nn)::BIGINT AS n_normal,
"""
_AUROC = "round(sum(n * (tp - p / 2.0::DOUBLE)) / (max(pp)::DOUBLE * max(nn)), 6) AS auroc"
_AP = "round(sum(p * tp::DOUBLE / (tp + fp)) / max(pp), 6) AS average_precision"
_FPR95 = "round(coalesce(min(fp::DOUBLE / nn) FILTER (tp::DOUBLE / pp >= 0.95), 1.0), 6) AS fpr_at_95_tpr"
_BOTH = " FROM curve GROUP BY model, category, condition"


def _ranking(s: SparkSession, d: str, metric: str) -> DataFrame:
    key = ["model", "category", "condition"]
    return rounded(metrics.ranking_metrics(study.predictions(s, d), key).select(*key, "n_anomalous", "n_normal", metric), [metric])


@query(_CURVE + _AUROC + _BOTH)
def auroc(s, d):
    return _ranking(s, d, "auroc")


@query(_CURVE + _AP + _BOTH)
def average_precision(s, d):
    return _ranking(s, d, "average_precision")


@query(_CURVE + _FPR95 + _BOTH)
def fpr_at_95_tpr(s, d):
    return _ranking(s, d, "fpr_at_95_tpr")


_PAIRS = """
, c AS (SELECT model, category, sample_id, score AS clean_score, predicted AS clean_predicted FROM predictions WHERE condition = 'clean'),
paired AS (SELECT p.*, c.clean_score, c.clean_predicted,
  CASE WHEN clean_predicted = target AND predicted = target THEN 'unchanged_correct' WHEN clean_predicted <> target AND predicted = clean_predicted THEN 'unchanged_error'
       WHEN clean_predicted = target AND target = 0 THEN 'new_false_positive' WHEN clean_predicted = target AND target = 1 THEN 'new_false_negative'
       WHEN predicted = target AND target = 0 THEN 'recovered_normal' WHEN predicted = target AND target = 1 THEN 'recovered_anomaly' ELSE 'changed_error' END AS transition
  FROM predictions p JOIN c USING (model, category, sample_id) WHERE condition <> 'clean')
"""


def _paired(s: SparkSession, d: str) -> DataFrame:
    rows = robustness.with_clean(study.predictions(s, d), ["model", "category", "sample_id"], "condition", ["score", "predicted"])
    return rows.withColumn("transition", robustness.transition(F.col("target"), F.col("clean_predicted"), F.col("predicted")))


@query(_PAIRS + "SELECT model, category, condition, transition, count(*) AS n_rows FROM paired GROUP BY ALL")
def transition_class(s, d):
    return _paired(s, d).groupBy("model", "category", "condition", "transition").agg(F.count(F.lit(1)).alias("n_rows"))


@query(
    _PAIRS + ", r AS (SELECT *, rank() OVER (PARTITION BY model, category, condition ORDER BY score) + (count(*) OVER (PARTITION BY model, category, condition, score) - 1) / 2.0::DOUBLE AS ra,"
    " rank() OVER (PARTITION BY model, category, condition ORDER BY clean_score) + (count(*) OVER (PARTITION BY model, category, condition, clean_score) - 1) / 2.0::DOUBLE AS rb FROM paired)"
    " SELECT model, category, condition, count(*) AS n_rows, count(*) FILTER (transition = 'new_false_positive') AS n_new_false_positive, count(*) FILTER (transition = 'new_false_negative') AS n_new_false_negative,"
    " count(*) FILTER (transition = 'recovered_normal') AS n_recovered_normal, count(*) FILTER (transition = 'recovered_anomaly') AS n_recovered_anomaly, count(*) FILTER (transition = 'unchanged_error') AS n_unchanged_error,"
    " round(avg((transition LIKE 'new%')::INT), 6) AS failure_rate, round(avg(score - clean_score) FILTER (target = 0), 6) AS normal_score_delta, round(avg(score - clean_score) FILTER (target = 1), 6) AS anomaly_score_delta,"
    " round(corr(ra, rb), 6) AS score_spearman FROM r GROUP BY model, category, condition"
)
def failure_clusters(s, d):
    return rounded(robustness.failure_clusters(cut(_paired(s, d)), ["model", "category", "condition"]), ["failure_rate", "normal_score_delta", "anomaly_score_delta", "score_spearman"])


@query(
    _PAIRS + ", r AS (SELECT *, rank() OVER (PARTITION BY model, category, condition ORDER BY score) + (count(*) OVER (PARTITION BY model, category, condition, score) - 1) / 2.0::DOUBLE AS ra,"
    " rank() OVER (PARTITION BY model, category, condition ORDER BY clean_score) + (count(*) OVER (PARTITION BY model, category, condition, clean_score) - 1) / 2.0::DOUBLE AS rb FROM paired)"
    " SELECT model, category, condition, count(*) AS n_rows, round(corr(ra, rb), 6) AS spearman FROM r GROUP BY model, category, condition"
)
def spearman_stability(s, d):
    return rounded(metrics.spearman(cut(_paired(s, d).select("model", "category", "condition", "score", "clean_score")), ["model", "category", "condition"], "score", "clean_score"), ["spearman"])


@query(
    ", c AS (SELECT model, category, recall AS r0, normal_fpr AS f0, f1 AS g0 FROM operating WHERE condition = 'clean')"
    " SELECT model, category, condition, round(recall - r0, 6) AS delta_recall, round(normal_fpr - f0, 6) AS delta_normal_fpr, round(f1 - g0, 6) AS delta_f1 FROM operating JOIN c USING (model, category)"
)
def delta_to_clean(s, d):
    out = robustness.delta_to_clean(_operating(s, d), ["model", "category"], "condition", ["recall", "normal_fpr", "f1"])
    names = ["delta_recall", "delta_normal_fpr", "delta_f1"]
    return rounded(out.select("model", "category", "condition", *names), names)


@query(
    " SELECT a.model, a.category, a.condition, round(a.recall - b.recall, 6) AS delta_recall, round(a.normal_fpr - b.normal_fpr, 6) AS delta_normal_fpr"
    " FROM operating a JOIN operating b ON a.category = b.category AND a.condition = b.condition AND a.model <> 'direct' AND b.model = 'direct'"
)
def candidate_delta(s, d):
    return rounded(robustness.reference_delta(_operating(s, d), "model", "direct", ["category", "condition"], ["recall", "normal_fpr"]), ["delta_recall", "delta_normal_fpr"])


_MEANS = ", ".join(f"round(avg({r}), 6) AS {r}, count({r}) AS {r}_defined" for r in _RATES)


@query(f"SELECT model, condition, {_MEANS} FROM operating GROUP BY model, condition")
def macro_mean(s, d):
    return rounded(metrics.macro_mean(_operating(s, d), ["model", "condition"], _RATES), _RATES)


@query(
    ", m AS (SELECT model, avg(recall) AS recall, avg(normal_fpr) AS normal_fpr FROM operating WHERE condition = 'clean' GROUP BY model)"
    " SELECT a.model, round(a.recall - b.recall, 6) AS delta_recall, round(a.normal_fpr - b.normal_fpr, 6) AS delta_normal_fpr FROM m a CROSS JOIN m b WHERE a.model <> 'direct' AND b.model = 'direct'"
)
def reference_delta(s, d):
    macro = metrics.macro_mean(_operating(s, d).where("condition = 'clean'"), ["model"], ["recall", "normal_fpr"])
    return rounded(robustness.reference_delta(macro, "model", "direct", [], ["recall", "normal_fpr"]), ["delta_recall", "delta_normal_fpr"])


@query(
    ", m AS (SELECT model, condition, avg(recall) AS recall, avg(normal_fpr) AS normal_fpr FROM operating GROUP BY model, condition),"
    " c AS (SELECT model, recall AS r0, normal_fpr AS f0 FROM m WHERE condition = 'clean')"
    " SELECT model, condition, round(recall, 6) AS recall, round(normal_fpr, 6) AS normal_fpr, round(recall - r0, 6) AS delta_recall, round(normal_fpr - f0, 6) AS delta_normal_fpr FROM m JOIN c USING (model)"
)
def robustness_macro(s, d):
    macro = metrics.macro_mean(_operating(s, d), ["model", "condition"], ["recall", "normal_fpr"]).select("model", "condition", "recall", "normal_fpr")
    out = robustness.delta_to_clean(macro, ["model"], "condition", ["recall", "normal_fpr"])
    return rounded(out, ["recall", "normal_fpr", "delta_recall", "delta_normal_fpr"])


@query(
    ", c AS (SELECT model, family, condition, avg(recall) AS recall, avg(normal_fpr) AS normal_fpr FROM operating WHERE condition <> 'clean' GROUP BY ALL)"
    " SELECT model, family, count(*) AS n_conditions, round(avg(recall), 6) AS recall, round(avg(normal_fpr), 6) AS normal_fpr FROM c GROUP BY model, family"
)
def family_summary(s, d):
    return rounded(robustness.family_summary(_operating(s, d), ["model"], ["recall", "normal_fpr"]), ["recall", "normal_fpr"])


@query(
    ", c AS (SELECT model, condition, avg(recall) AS recall FROM operating WHERE condition <> 'clean' GROUP BY ALL) SELECT model, round(avg(recall), 6) AS recall FROM c GROUP BY model"
)
def severe_policy_mean(s, d):
    return rounded(robustness.family_summary(_operating(s, d).withColumn("all", F.lit(0)), ["model"], ["recall"], family="all").select("model", "recall"), ["recall"])


@query(
    ", d2 AS (SELECT o.model, o.category, o.condition, o.recall - c.recall AS delta FROM operating o JOIN operating c USING (model, category) WHERE c.condition = 'clean' AND o.condition <> 'clean')"
    " SELECT count(*) AS n_units, round(avg(a.delta - b.delta), 6) AS estimate FROM d2 a JOIN d2 b USING (category, condition) WHERE a.model = 'square' AND b.model = 'direct'"
)
def hypothesis_h2(s, d):
    deltas = robustness.delta_to_clean(_operating(s, d), ["model", "category"], "condition", ["recall"]).where("condition <> 'clean'").select("model", "category", "condition", "delta_recall")
    pairs = robustness.reference_delta(deltas, "model", "direct", ["category", "condition"], ["delta_recall"])
    return rounded(pairs.agg(F.count(F.lit(1)).alias("n_units"), F.avg("delta_delta_recall").alias("estimate")), ["estimate"])


@query(
    ", pooled AS (SELECT score, row_number() OVER (ORDER BY score) - 1 AS place, count(*) OVER () AS n FROM cal), pt AS (SELECT max(score) AS t FROM pooled WHERE place = ceil(0.95 * (n - 1))),"
    " f AS (SELECT category, avg((score > threshold)::INT) AS own, avg((score > t)::INT) AS pooled FROM test JOIN threshold USING (category) CROSS JOIN pt WHERE target = 0 GROUP BY category)"
    " SELECT count(*) AS n_units, round(avg(abs(pooled - 0.05) - abs(own - 0.05)), 6) AS estimate FROM f"
)
def hypothesis_h3(s, d):
    pooled = calibration.higher_quantile(study.calibration_rows(s, d), [], "score", study.QUANTILE, "pooled")
    rows = study.test_rows(s, d).where("target = 0").join(study.thresholds(s, d).drop("n_values"), "category").crossJoin(F.broadcast(pooled.select("pooled")))
    fpr = rows.groupBy("category").agg(F.avg((F.col("score") > F.col("threshold")).cast("double")).alias("own"), F.avg((F.col("score") > F.col("pooled")).cast("double")).alias("pooled"))
    return rounded(fpr.agg(F.count(F.lit(1)).alias("n_units"), F.avg(F.abs(F.col("pooled") - 0.05) - F.abs(F.col("own") - 0.05)).alias("estimate")), ["estimate"])


@query(
    ", levels(review_level) AS (VALUES (0.05::DOUBLE), (0.2)),"
    " leveled AS (SELECT category, target, review_level, CASE WHEN conformal_p <= 0.05 THEN 'anomalous' WHEN conformal_p <= review_level THEN 'review' ELSE 'normal' END AS decision FROM p CROSS JOIN levels),"
    " r AS (SELECT category, review_level, count(*) FILTER (decision <> 'review')::DOUBLE / count(*) AS coverage, count(*) FILTER ((target = 0 AND decision = 'anomalous') OR (target = 1 AND decision = 'normal'))::DOUBLE / nullif(count(*) FILTER (decision <> 'review'), 0) AS risk FROM leveled GROUP BY ALL)"
    " SELECT count(a.risk - b.risk) AS n_units, round(avg(a.risk - b.risk), 6) AS estimate, coalesce(avg(b.coverage) >= 0.7, false) AS coverage_met FROM r a JOIN r b USING (category) WHERE a.review_level = 0.05 AND b.review_level = 0.2"
)
def hypothesis_h4(s, d):
    curve = calibration.coverage_risk(study.decided(s, d), ["category"], study.ALPHA, [0.05, 0.2])
    none = curve.where("review_level = 0.05").select("category", F.col("selective_risk").alias("a"))
    some = curve.where("review_level = 0.2").select("category", F.col("selective_risk").alias("b"), "auto_coverage")
    gain = F.col("a") - F.col("b")
    out = none.join(some, "category").agg(F.count(gain).alias("n_units"), F.avg(gain).alias("estimate"), F.coalesce(F.avg("auto_coverage") >= 0.7, F.lit(False)).alias("coverage_met"))
    return rounded(out, ["estimate"])


@query(
    _PAIRS + "SELECT count(*) AS n_units, round(avg(abs(score - clean_score)) FILTER (predicted <> target) - avg(abs(score - clean_score)) FILTER (predicted = target), 6) AS estimate FROM paired WHERE clean_predicted = target AND model = 'direct'"
)
def hypothesis_h5(s, d):
    moved = F.abs(F.col("score") - F.col("clean_score"))
    rows = _paired(s, d).where("clean_predicted = target AND model = 'direct'")
    out = rows.agg(F.count(F.lit(1)).alias("n_units"), (F.avg(F.when(F.col("predicted") != F.col("target"), moved)) - F.avg(F.when(F.col("predicted") == F.col("target"), moved))).alias("estimate"))
    return rounded(out, ["estimate"])


@query()
def clopper_pearson(s, d):
    counts = _operating(s, d).select("model", "category", "condition", F.col("tp").alias("k"), (F.col("tp") + F.col("fn")).alias("n"))
    return rounded(calibration.clopper_pearson(counts, "k", "n"), ["ci_low", "ci_high"], 9)


@query(
    _PAIRS + "SELECT model, condition, arg_max(sample_id, struct_pack(s := score, i := -sample_id)) AS top_sample FROM predictions WHERE target = 1 GROUP BY model, condition"
)
def argmax_per_label(s, d):
    rows = study.predictions(s, d).where("target = 1")
    return rows.groupBy("model", "condition").agg(F.max_by("sample_id", F.struct("score", -F.col("sample_id"))).alias("top_sample"))


@query(
    "SELECT category, round(quantile_cont(score, 0.5), 6) AS p50, round(quantile_cont(score, 0.95), 6) AS p95, round(avg(score), 6) AS mean FROM scored GROUP BY category"
)
def latency_percentiles(s, d):
    rows = study.scored(s, d).groupBy("category").agg(F.percentile("score", 0.5).alias("p50"), F.percentile("score", 0.95).alias("p95"), F.avg("score").alias("mean"))
    return rounded(rows, ["p50", "p95", "mean"])
