"""The study tables that the queries share, from the events table: predictions, calibration scores, conditions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from normspark.functions.hashing import stable_bucket
from normspark.operators import calibration
from normspark.session import table

#: Conditions (name, family, severity, factor, offset of the score) and models (name, power of the score).
CONDITIONS = [("clean", "clean", 0, 1.0, 0.0), ("blur_1", "blur", 1, 0.9, 0.0), ("blur_2", "blur", 2, 0.7, 1.0), ("noise_1", "noise", 1, 1.1, 0.5), ("noise_2", "noise", 2, 1.0, 4.0)]
MODELS = [("direct", 1), ("square", 2)]
ALPHA, REVIEW, QUANTILE = 0.05, 0.2, 0.95

SQL = """
WITH scored AS (
  SELECT event_id AS sample_id, CAST(user_id % 12 AS INTEGER) AS category, CAST(event_type = 'error' AS INTEGER) AS target, value AS score,
         CAST(CAST('0x' || substr(sha256(CAST(event_id AS VARCHAR)), 1, 16) AS UBIGINT) % 100 AS INTEGER) AS bucket
  FROM events WHERE value IS NOT NULL AND user_id IS NOT NULL AND event_type IS NOT NULL),
cal AS (SELECT * FROM scored WHERE target = 0 AND bucket < 50),
test AS (SELECT * FROM scored WHERE NOT (target = 0 AND bucket < 50)),
p AS (SELECT t.*, (1 + (SELECT count(*) FROM cal c WHERE c.category = t.category AND c.score >= t.score))::DOUBLE
        / (1 + (SELECT count(*) FROM cal c WHERE c.category = t.category)) AS conformal_p FROM test t),
decided AS (SELECT *, CASE WHEN conformal_p <= 0.05 THEN 'anomalous' WHEN conformal_p <= 0.2 THEN 'review' ELSE 'normal' END AS decision FROM p),
ranked_cal AS (SELECT category, score, row_number() OVER (PARTITION BY category ORDER BY score) - 1 AS place, count(*) OVER (PARTITION BY category) AS n FROM cal),
threshold AS (SELECT category, max(score) AS threshold, max(n) AS n_values FROM ranked_cal WHERE place = ceil(0.95 * (n - 1)) GROUP BY category),
conditions(condition, family, severity, factor, bias) AS (VALUES ('clean', 'clean', 0, 1.0::DOUBLE, 0.0::DOUBLE), ('blur_1', 'blur', 1, 0.9, 0.0), ('blur_2', 'blur', 2, 0.7, 1.0), ('noise_1', 'noise', 1, 1.1, 0.5), ('noise_2', 'noise', 2, 1.0, 4.0)),
models(model, power) AS (VALUES ('direct', 1), ('square', 2)),
predictions AS (
  SELECT m.model, t.category, c.condition, c.family, c.severity, t.sample_id, t.target,
         CASE WHEN power = 1 THEN score * factor + bias ELSE (score * factor + bias) * (score * factor + bias) END AS score,
         CAST(CASE WHEN power = 1 THEN score * factor + bias ELSE (score * factor + bias) * (score * factor + bias) END
              > CASE WHEN power = 1 THEN threshold ELSE threshold * threshold END AS INTEGER) AS predicted
  FROM test t JOIN threshold USING (category) CROSS JOIN conditions c CROSS JOIN models m),
metrics AS (
  SELECT model, category, condition, family, severity,
    CAST(count(*) FILTER (target = 1 AND predicted = 1) AS BIGINT) AS tp, CAST(count(*) FILTER (target = 0 AND predicted = 0) AS BIGINT) AS tn,
    CAST(count(*) FILTER (target = 0 AND predicted = 1) AS BIGINT) AS fp, CAST(count(*) FILTER (target = 1 AND predicted = 0) AS BIGINT) AS fn
  FROM predictions GROUP BY ALL),
operating AS (
  SELECT *, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS precision, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS recall,
    coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1,
    (coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) + coalesce(tn::DOUBLE / nullif(tn + fp, 0), 0)) / 2 AS balanced_accuracy,
    coalesce(fp::DOUBLE / nullif(fp + tn, 0), 0) AS normal_fpr FROM metrics)
"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``sample_id, category, target, score, bucket`` of the events."""
    return table(spark, sf_dir, "events").where("value IS NOT NULL AND user_id IS NOT NULL AND event_type IS NOT NULL").select(
        F.col("event_id").alias("sample_id"),
        (F.col("user_id") % 12).cast("int").alias("category"),
        (F.col("event_type") == "error").cast("int").alias("target"),
        F.col("value").alias("score"),
        stable_bucket("event_id", 100).alias("bucket"),
    )


def calibration_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).where("target = 0 AND bucket < 50")


def test_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).where("NOT (target = 0 AND bucket < 50)")


def thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.higher_quantile(calibration_rows(spark, sf_dir), ["category"], "score", QUANTILE)


def decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test rows with conformal p-value and three-way decision."""
    p = calibration.conformal_p(test_rows(spark, sf_dir), calibration_rows(spark, sf_dir), ["category"])
    return p.withColumn("decision", calibration.three_way(F.col("conformal_p"), ALPHA, REVIEW))


def conditions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CONDITIONS, "condition string, family string, severity int, factor double, bias double")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every test row under every condition and model, with its prediction; the dimensions are a few literal rows."""
    models = spark.createDataFrame(MODELS, "model string, power int")
    rows = test_rows(spark, sf_dir).join(thresholds(spark, sf_dir).drop("n_values"), "category")
    rows = rows.crossJoin(F.broadcast(conditions(spark))).crossJoin(F.broadcast(models))
    shifted = F.col("score") * F.col("factor") + F.col("bias")
    score = F.when(F.col("power") == 1, shifted).otherwise(shifted * shifted)
    limit = F.when(F.col("power") == 1, F.col("threshold")).otherwise(F.col("threshold") * F.col("threshold"))
    return rows.select("model", "category", "condition", "family", "severity", "sample_id", "target", score.alias("score"), (score > limit).cast("int").alias("predicted"))
