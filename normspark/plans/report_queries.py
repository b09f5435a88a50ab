"""Queries of reports, capture studies, localization models and memory building, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from normspark.functions import predicates
from normspark.operators import calibration, capture_study, grids, images, localization, metrics, neighbours, resampling, robustness
from normspark.plans import study
from normspark.plans.data_queries import _DISTANCE, _FRAMES, _VECTORS, _bank, _frames, _grid, _GRID, _labels, _vectors
from normspark.plans.study_queries import _operating
from normspark.session import cut, table
from normspark.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def rounded(df: DataFrame, columns: list[str], places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


# --- reports


@query(study.SQL + """
, d2 AS (SELECT o.model, o.condition, o.category, o.recall, o.recall - c.recall AS v FROM operating o JOIN operating c USING (model, category) WHERE c.condition = 'clean'),
u AS (SELECT *, row_number() OVER (PARTITION BY model, condition ORDER BY category) - 1 AS i, count(*) OVER (PARTITION BY model, condition) AS n FROM d2),
dr AS (SELECT model, condition, r, CAST('0x' || substr(sha256('9:' || r || ':' || i), 1, 8) AS BIGINT) % n AS j FROM u CROSS JOIN range(1000) t(r)),
mm AS (SELECT d.model, d.condition, d.r, avg(u.v) AS m FROM dr d JOIN u ON d.model = u.model AND d.condition = u.condition AND d.j = u.i GROUP BY ALL),
ci AS (SELECT model, condition, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM mm GROUP BY ALL)
SELECT model, condition, count(*) AS categories, round(avg(recall), 6) AS macro_recall, round(avg(v), 6) AS macro_delta_recall, round(any_value(lo), 6) AS ci_low, round(any_value(hi), 6) AS ci_high FROM u JOIN ci USING (model, condition) GROUP BY model, condition""")
def robustness_intervals(s, d):
    """Macro metrics and their change against clean, with intervals over categories."""
    deltas = cut(robustness.delta_to_clean(_operating(s, d), ["model", "category"], "condition", ["recall"]).select("model", "condition", "category", "recall", "delta_recall"))
    macro = deltas.groupBy("model", "condition").agg(F.count(F.lit(1)).alias("categories"), F.avg("recall").alias("macro_recall"), F.avg("delta_recall").alias("macro_delta_recall"))
    return rounded(macro.join(resampling.hashed_mean(deltas, ["model", "condition"], "category", "delta_recall", 9, 1000), ["model", "condition"]), ["macro_recall", "macro_delta_recall", "ci_low", "ci_high"])


@query(study.SQL + " SELECT model, condition, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(tn)::BIGINT AS tn, sum(fn)::BIGINT AS fn, count(*) AS categories, count(*) FILTER (tp + fn > 0) AS eligible_categories, round(avg(recall) FILTER (tp + fn > 0), 6) AS macro_recall, round(avg(normal_fpr), 6) AS macro_normal_fpr FROM operating GROUP BY model, condition")
def report_macros(s, d):
    return rounded(metrics.report_macros(_operating(s, d), ["model", "condition"], ["tp", "fp", "tn", "fn"], {"macro_recall": ("recall", F.col("tp") + F.col("fn") > 0), "macro_normal_fpr": ("normal_fpr", F.lit(True))}, F.col("tp") + F.col("fn") > 0), ["macro_recall", "macro_normal_fpr"])


@query(study.SQL + " SELECT model, row_number() OVER (ORDER BY list_position(['direct', 'square'], model)) AS place, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1, round(avg(normal_fpr), 6) AS normal_fpr FROM operating WHERE condition = 'clean' GROUP BY model")
def publication_models(s, d):
    """Clean macro metrics of the models in the order of the paper."""
    return rounded(robustness.publication(metrics.macro_mean(_operating(s, d).where("condition = 'clean'"), ["model"], ["recall", "f1", "normal_fpr"]), {"model": ["direct", "square"]}).select("model", "place", "recall", "f1", "normal_fpr"), ["recall", "f1", "normal_fpr"])


@query(study.SQL + ", levels(review_level) AS (VALUES (0.05::DOUBLE), (0.1), (0.2), (0.3), (0.4), (0.5)), l AS (SELECT category, target, review_level, CASE WHEN conformal_p <= 0.05 THEN 'anomalous' WHEN conformal_p <= review_level THEN 'review' ELSE 'normal' END AS decision FROM p CROSS JOIN levels),"
    " r AS (SELECT category, review_level, count(*) FILTER (decision <> 'review')::DOUBLE / count(*) AS coverage, count(*) FILTER ((target = 0 AND decision = 'anomalous') OR (target = 1 AND decision = 'normal'))::DOUBLE / nullif(count(*) FILTER (decision <> 'review'), 0) AS risk FROM l GROUP BY ALL)"
    " SELECT review_level, row_number() OVER (ORDER BY review_level) AS place, count(risk) AS categories, round(avg(coverage), 6) AS coverage, round(avg(risk), 6) AS risk FROM r GROUP BY review_level")
def publication_coverage(s, d):
    """Macro coverage and risk by review level."""
    levels = [0.05, 0.1, 0.2, 0.3, 0.4, 0.5]
    curve = calibration.coverage_risk(study.decided(s, d), ["category"], study.ALPHA, levels)
    macro = metrics.macro_mean(curve, ["review_level"], ["auto_coverage", "selective_risk"])
    rows = robustness.publication(macro, {"review_level": levels})
    return rounded(rows.select("review_level", "place", F.col("selective_risk_defined").alias("categories"), F.col("auto_coverage").alias("coverage"), F.col("selective_risk").alias("risk")), ["coverage", "risk"])


@query(study.SQL + " SELECT family, severity, row_number() OVER (ORDER BY list_position(['clean', 'noise', 'blur'], family), severity) AS place, round(avg(normal_fpr), 6) AS normal_fpr, round(avg(balanced_accuracy), 6) AS balanced_accuracy FROM operating WHERE model = 'direct' GROUP BY family, severity")
def publication_conditions(s, d):
    """Macro metrics of the first model by family and severity."""
    macro = metrics.macro_mean(_operating(s, d).where("model = 'direct'"), ["family", "severity"], ["normal_fpr", "balanced_accuracy"])
    rows = robustness.publication(macro, {"family": ["clean", "noise", "blur"], "severity": None})
    return rounded(rows.select("family", "severity", "place", "normal_fpr", "balanced_accuracy"), ["normal_fpr", "balanced_accuracy"])


# --- capture studies

_STUDY = "WITH rows AS (SELECT o_orderkey, o_custkey AS session_id, o_orderkey % 50 AS object_id, CASE WHEN o_orderpriority = '1-URGENT' THEN 'anomaly' ELSE 'normal' END AS label, c_nationkey AS camera_id, c_mktsegment AS lighting_id FROM orders JOIN customer ON c_custkey = o_custkey)"


@query(_STUDY + """
, c AS (SELECT unnest(['n_normals', 'n_anomalies', 'n_sessions', 'n_cameras', 'n_lights', 'n_objects']) AS requirement, unnest([count(*) FILTER (label = 'normal'), count(*) FILTER (label = 'anomaly'), count(DISTINCT session_id), count(DISTINCT camera_id), count(DISTINCT lighting_id), count(DISTINCT object_id)]) AS observed, unnest([20, 20, 4, 2, 6, 20]) AS needed FROM rows),
l AS (SELECT 'session_id' AS requirement, session_id::VARCHAR AS value, label FROM rows UNION ALL SELECT 'camera_id', camera_id::VARCHAR, label FROM rows UNION ALL SELECT 'lighting_id', lighting_id, label FROM rows)
SELECT requirement, NULL AS value, observed, needed::BIGINT AS needed FROM c WHERE observed < needed UNION ALL SELECT 'both_labels_per_' || requirement, value, count(DISTINCT label), 2 FROM l GROUP BY requirement, value HAVING count(DISTINCT label) < 2""")
def capture_coverage(s, d):
    """What a final audit lacks; orders are captures, their customers the sessions."""
    sessions = table(s, d, "customer").select(F.col("c_custkey").alias("session_id"), F.lit("evaluation").alias("split"), F.col("c_nationkey").alias("camera_id"), F.col("c_mktsegment").alias("lighting_id"))
    captures = table(s, d, "orders").select(F.col("o_orderkey").alias("capture_id"), F.col("o_custkey").alias("session_id"), (F.col("o_orderkey") % 50).alias("object_id"), F.when(F.col("o_orderpriority") == "1-URGENT", "anomaly").otherwise("normal").alias("label"))
    return capture_study.coverage_gaps(capture_study.with_sessions(captures, sessions), {"n_lights": 6})


@query("SELECT 'score' AS \"column\", 'null' AS problem, count(*) AS n_rows FROM calibration_scores WHERE score IS NULL HAVING count(*) > 0 UNION ALL SELECT 'score', 'not_finite', count(*) FROM calibration_scores WHERE NOT isfinite(score) HAVING count(*) > 0 UNION ALL SELECT 'flag', 'not_binary', count(*) FROM calibration_scores WHERE hash_flag(sample_id) NOT IN (0, 1) HAVING count(*) > 0".replace("hash_flag(sample_id)", "CASE WHEN label = 'normal' THEN 0 WHEN label = 'anomaly' THEN 1 ELSE 2 END"))
def value_problems(s, d):
    flag = F.when(F.col("label") == "normal", 0).when(F.col("label") == "anomaly", 1).otherwise(2)
    return tables.value_problems(table(s, d, "calibration_scores").withColumn("flag", flag), ["score"], ["flag"])


@query("WITH g AS (SELECT image_path, thumbnail AS a, list_reverse(thumbnail) AS b, list_avg(thumbnail) AS m FROM grouping_records WHERE len(thumbnail) = 1024), z AS (SELECT *, greatest(sqrt(list_avg(list_transform(a, lambda x: (x - m) * (x - m)))), 1) AS sd FROM g)"
    " SELECT image_path, round(list_avg(list_transform(list_zip(a, b), lambda p: abs((p[1] - floor(m)) - (p[2] - floor(m))))), 4) AS whole, round(list_avg(list_transform(list_zip(a, b), lambda p: abs((p[1] - m) - (p[2] - m)))), 4) AS mean, round(list_avg(list_transform(list_zip(a, b), lambda p: abs((p[1] - m) / sd - (p[2] - m) / sd))), 4) AS standard FROM z")
def centred_errors(s, d):
    """Each thumbnail against itself turned upside down, by the three ways to centre."""
    rows = table(s, d, "grouping_records").where("size(thumbnail) = 1024").select("image_path", "thumbnail", F.reverse("thumbnail").alias("turned")).where("NOT exists(thumbnail, x -> x IS NULL)")
    return rounded(rows.select("image_path", images.centred_errors("thumbnail", "turned").alias("e")).select("image_path", "e.*"), ["whole", "mean", "standard"], 4)


@query("SELECT category, CASE WHEN category = 'gasket' THEN '-' ELSE printf('%+.3f', coverage_radius - 0.5) END AS delta FROM memory_stats")
def signed_format(s, d):
    return table(s, d, "memory_stats").select("category", predicates.signed(F.when(F.col("category") != "gasket", F.col("coverage_radius") - 0.5)).alias("delta"))


# --- memories


@query("WITH p AS (SELECT label, vec_id % 50 AS image, vec_id, sha256('5:' || vec_id) AS h FROM embeddings), f AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY label, image ORDER BY h, vec_id) <= 3) SELECT label, image, vec_id FROM f QUALIFY row_number() OVER (PARTITION BY label ORDER BY h, vec_id) <= 40")
def patch_sample(s, d):
    return neighbours.patch_sample(_vectors(s, d).withColumn("image", F.col("vec_id") % 50), "label", "image", "vec_id", 3, 40, 5)


@query(_VECTORS + f", s AS (SELECT q.vec_id, q.label, {_DISTANCE}, len(any_value(q.embedding)) AS n FROM v q JOIN b USING (label) GROUP BY q.vec_id, q.label), c AS (SELECT label, count(*) AS k FROM b GROUP BY label)"
    " SELECT label, count(*) AS candidate_count, any_value(n)::INTEGER AS dimension, any_value(k) AS selected_count, max(score) AS coverage_radius, round(avg(score), 5) AS mean_distance, 4 * any_value(n)::BIGINT * count(*) AS raw_candidate_bytes, 4 * any_value(n)::BIGINT * any_value(k) AS bank_bytes FROM s JOIN c USING (label) GROUP BY label")
def memory_statistics(s, d):
    return neighbours.memory_statistics(_vectors(s, d), _bank(s, d), "label", "vec_id", "embedding").withColumns({"coverage_radius": F.round("coverage_radius", 6), "mean_distance": F.round("mean_distance", 5)})


_AUC = "(sum(n * (tp - p / 2.0::DOUBLE)) / (any_value(bp)::DOUBLE * any_value(bn)))"


@query(_VECTORS + f""", own AS (SELECT q.vec_id, q.label, {_DISTANCE} FROM v q JOIN b USING (label) GROUP BY q.vec_id, q.label), other AS (SELECT q.vec_id, q.label, {_DISTANCE} FROM v q JOIN b ON q.label <> b.label WHERE slot < 5 GROUP BY q.vec_id, q.label),
both_arms AS (SELECT 'own' AS arm, * FROM own UNION ALL SELECT 'transfer', * FROM other), per AS (SELECT arm, label, score, count(*) FILTER (vec_id % 3 = 0) AS p, count(*) FILTER (vec_id % 3 <> 0) AS n FROM both_arms GROUP BY ALL),
cu AS (SELECT *, sum(p) OVER w AS tp, sum(p) OVER (PARTITION BY arm, label) AS bp, sum(n) OVER (PARTITION BY arm, label) AS bn FROM per WINDOW w AS (PARTITION BY arm, label ORDER BY score DESC)),
a AS (SELECT arm, label, CASE WHEN any_value(bp) > 0 AND any_value(bn) > 0 THEN {_AUC} END AS auroc FROM cu GROUP BY arm, label)
SELECT label, round(t.auroc, 6) AS auroc, round(t.auroc - o.auroc, 6) AS delta_auroc FROM a t JOIN a o USING (label) WHERE t.arm = 'transfer' AND o.arm = 'own'""")
def category_transfer(s, d):
    """Ranking by a bank of all other categories, against the category's own bank."""
    own = neighbours.nearest_score(_vectors(s, d), _bank(s, d), "label", "vec_id", "embedding")
    other = neighbours.nearest_score(_vectors(s, d), neighbours.unified_bank(_bank(s, d), 5), "label", "vec_id", "embedding", own=False)
    target = (F.col("vec_id") % 3 == 0).cast("int")
    return rounded(robustness.category_transfer(*(rounded(x, ["score"]).withColumn("target", target) for x in (own, other)), "label").select("label", "auroc", "delta_auroc"), ["auroc", "delta_auroc"])


# --- localization


@query(_FRAMES + ", c AS (SELECT image, y // 4 AS cy, x // 4 AS cx, avg(score) FILTER (y % 4 IN (1, 2) AND x % 4 IN (1, 2)) AS v FROM pix GROUP BY ALL) SELECT image, y, x, coalesce(v > 55000, false) AS support FROM pix JOIN c ON c.image = pix.image AND c.cy = y // 4 AND c.cx = x // 4".replace("SELECT image, y, x, coalesce", "SELECT pix.image, y, x, coalesce"))
def coarse_support(s, d):
    return localization.coarse_support(_frames(s, d).withColumn("threshold", F.lit(55_000.0)), ["image"], "score", "threshold", 4).select("image", "y", "x", "support")


_CLEANED = _FRAMES.replace("pix AS", "raw AS") + ", pix AS (SELECT image, y, x, true AS mask FROM raw WHERE score > 60000)" + _labels(8) + " SELECT image, y, x, region_id FROM lab WHERE (image, region_id) IN (SELECT (image, region_id) FROM lab GROUP BY image, region_id HAVING count(*) >= 3)"


@query(_CLEANED)
def localization_policy(s, d):
    """The cleaned readout: components above the baseline threshold that are large enough."""
    pixels = _frames(s, d).withColumns({"z": F.lit(0.0), "baseline": F.lit(60_000.0)})
    return grids.localization_support(pixels, ["image"], "score", "z", "raw_cleaned", "baseline", {}, 3, 0)


@query()
def localization_fit(s, d):
    """Models of four groups of frames: half of a group's frames fit the cells, half calibrate the thresholds."""
    frames = _frames(s, d).withColumn("grp", F.col("image") % 4)
    half = F.floor(F.col("image") / 4) % 2
    _, model = localization.fit_localization(frames.where(half == 0), frames.where(half == 1), ["grp"], "image", "score", least_maps=1)
    return model


@query(_GRID + " SELECT image % 5 AS grp, min(image) AS first_normal FROM pix WHERE image % 3 = 0 GROUP BY 1")
def first_normal(s, d):
    return _grid(s, d).where("image % 3 = 0").groupBy((F.col("image") % 5).alias("grp")).agg(F.min("image").alias("first_normal"))
