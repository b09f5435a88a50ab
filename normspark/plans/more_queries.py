"""Further queries: contracts, exclusions, selections, resampling and image kernels."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from normspark.functions import predicates
from normspark.operators import duplicates, grids, images, metrics, neighbours, resampling, robustness, splits
from normspark.plans import study
from normspark.plans.data_queries import _GRID, _HASHES, _RECORDS, _grid, _labels, _pairs, records
from normspark.plans.study_queries import _operating, _paired
from normspark.sources import tables
from normspark.session import table

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


_PROVIDER = """
WITH r AS (SELECT DISTINCT category AS object, lower(trim(split)) AS split, label, image_path AS image, mask_path AS mask FROM manifest WHERE split IS NOT NULL)
"""


@query(_PROVIDER + """
, v AS (SELECT unnest([CASE WHEN object NOT IN ('gasket', 'bracket', 'hexnut') THEN 'unknown_category' END, CASE WHEN split NOT IN ('train', 'test') THEN 'unknown_split' END,
  CASE WHEN split = 'train' AND label <> 'normal' THEN 'training_anomaly' END, CASE WHEN label = 'normal' AND mask IS NOT NULL THEN 'mask_on_normal' END, CASE WHEN label = 'anomaly' AND mask IS NULL THEN 'anomaly_without_mask' END,
  CASE WHEN NOT starts_with(image, object || '/') THEN 'path_not_in_category' END]) AS contract FROM r),
m AS (SELECT 'repeated_mask' AS contract FROM r WHERE mask IS NOT NULL GROUP BY mask HAVING count(*) > 1 UNION ALL SELECT 'repeated_image' FROM r GROUP BY image HAVING count(*) > 1)
SELECT contract, count(*) AS n_rows FROM (SELECT * FROM v WHERE contract IS NOT NULL UNION ALL SELECT * FROM m) GROUP BY contract""")
def split_table_contract(s, d):
    rows = table(s, d, "manifest").where("split IS NOT NULL").select(F.col("category").alias("object"), F.lower(F.trim("split")).alias("split"), "label", F.col("image_path").alias("image"), F.col("mask_path").alias("mask")).distinct()
    return tables.split_table_violations(rows, ["gasket", "bracket", "hexnut"])


@query("SELECT model AS name, 'complete' AS status, 'full' AS mode FROM calibration_scores WHERE model <> 'pooled_bank' ORDER BY model DESC LIMIT 1")
def latest_run(s, d):
    runs = table(s, d, "calibration_scores").select(F.col("model").alias("name")).distinct().withColumns({"status": F.when(F.col("name") == "pooled_bank", "failed").otherwise("complete"), "mode": F.lit("full")})
    return tables.latest_run(runs)


@query("SELECT DISTINCT m.category, s.name AS experiment FROM memory_stats m CROSS JOIN experiment_settings s WHERE NOT EXISTS (SELECT 1 FROM calibration_scores c WHERE c.category = m.category AND c.experiment = s.name AND c.score > 20)")
def pending_units(s, d):
    units = table(s, d, "memory_stats").select("category").crossJoin(F.broadcast(table(s, d, "experiment_settings").select(F.col("name").alias("experiment")))).distinct()
    return tables.pending_units(units, table(s, d, "calibration_scores").where("score > 20"), ["category", "experiment"])


@query(_HASHES + ", links AS (SELECT key_a AS a, key_b AS b FROM pairs UNION SELECT key_b, key_a FROM pairs), reach(node, other) AS (SELECT a, a FROM links UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.other), comp AS (SELECT node, min(other) AS component FROM reach GROUP BY node),"
    " x AS (SELECT m.sample_id, m.source_split, m.label, coalesce(component, m.sample_id) AS component FROM (SELECT sample_id, arg_min(source_split, ingested_at) AS source_split, arg_min(label, ingested_at) AS label FROM manifest GROUP BY sample_id) m LEFT JOIN comp ON node = m.sample_id),"
    " y AS (SELECT *, CASE WHEN source_split = 'test' THEN NULL WHEN label = 'anomaly' THEN 'training_anomaly' WHEN max((source_split = 'test')::INT) OVER (PARTITION BY component) = 1 THEN 'test_duplicate' END AS reason FROM x)"
    " SELECT sample_id, reason, CASE WHEN source_split = 'test' THEN 'test' WHEN reason IS NOT NULL THEN 'excluded' ELSE 'train' END AS assigned FROM y")
def source_split_assignment(s, d):
    own = records(s, d).select("sample_id", "source_split", "label")
    comp = duplicates.components(_pairs(s, d)).withColumnRenamed("node", "sample_id")
    rows = own.join(comp, "sample_id", "left").withColumn("component", F.coalesce("component", "sample_id"))
    return splits.assign_source_split(rows, "component", "source_split", "label").select("sample_id", "reason", "assigned")


@query(_RECORDS + ", f AS (SELECT sha, min(sample_id) AS original FROM records WHERE sha IS NOT NULL GROUP BY sha) SELECT r.sample_id, r.category FROM records r LEFT JOIN f ON r.sha = f.sha WHERE f.original IS NULL OR f.original = r.sample_id OR r.label <> 'normal'")
def verified_copy_exclusion(s, d):
    """Records without the normal copies that are byte for byte the same file as an earlier id."""
    rows = records(s, d)
    first = rows.where("sha IS NOT NULL").groupBy("sha").agg(F.min("sample_id").alias("original"))
    copies = rows.where("label = 'normal'").join(first, "sha").where("sample_id <> original").select("sample_id")
    return rows.join(copies, "sample_id", "left_anti").select("sample_id", "category")


@query("SELECT count(*) AS n_rows, count(*) FILTER (a.score IS DISTINCT FROM b.score) AS n_different FROM (SELECT model, sample_id, max(score) AS score FROM calibration_scores GROUP BY ALL) a JOIN (SELECT model, sample_id, min(score) AS score FROM calibration_scores GROUP BY ALL) b USING (model, sample_id)")
def reproduction_check(s, d):
    rows = table(s, d, "calibration_scores")
    a = rows.groupBy("model", "sample_id").agg(F.max("score").alias("a"))
    b = rows.groupBy("model", "sample_id").agg(F.min("score").alias("b"))
    return a.join(b, ["model", "sample_id"]).agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum((~F.col("a").eqNullSafe(F.col("b"))).cast("long")), F.lit(0)).alias("n_different"))


@query(study.SQL + ", u AS (SELECT model, category, recall - 0.3 AS low, recall - 0.1 AS high FROM operating WHERE condition = 'clean') SELECT model, category, CASE WHEN low > 0 THEN 'supported' WHEN high < 0 THEN 'rejected' ELSE 'inconclusive' END AS verdict FROM u")
def hypothesis_verdict(s, d):
    rows = _operating(s, d).where("condition = 'clean'")
    return rows.select("model", "category", robustness.verdict(F.col("recall") - 0.3, F.col("recall") - 0.1).alias("verdict"))


@query(study.SQL + " SELECT condition, family, row_number() OVER (ORDER BY list_position(['clean', 'noise', 'blur'], family), severity) AS place, round(avg(recall), 6) AS recall FROM operating GROUP BY condition, family, severity")
def publication_table(s, d):
    macro = metrics.macro_mean(_operating(s, d), ["condition", "family", "severity"], ["recall"])
    order = F.array_position(F.array(*(F.lit(x) for x in ("clean", "noise", "blur"))), F.col("family"))
    w = F.row_number().over(splits.Window.orderBy(order, "severity"))  # as many rows as conditions
    return rounded(macro.select("condition", "family", w.alias("place"), "recall"), ["recall"])


@query(study.SQL + ", e AS (SELECT t.sample_id, c.condition FROM test t CROSS JOIN conditions c), a AS (SELECT sample_id, condition FROM e WHERE sample_id % 97 <> 0) SELECT condition, count(*) AS n_missing FROM (SELECT * FROM e EXCEPT ALL SELECT * FROM a) GROUP BY condition")
def condition_completeness(s, d):
    expected = study.test_rows(s, d).select("sample_id").crossJoin(F.broadcast(study.conditions(s).select("condition")))
    return expected.exceptAll(expected.where("sample_id % 97 <> 0")).groupBy("condition").agg(F.count(F.lit(1)).alias("n_missing"))


@query(_GRID + ", m AS (SELECT image, CASE WHEN image % 3 = 0 THEN 'normal' ELSE 'anomaly' END AS label, count(*) FILTER (mask AND x > 11) AS mask_pixels FROM pix GROUP BY ALL) SELECT label, count(*) AS n_images, count(*) FILTER (label = 'anomaly' AND mask_pixels > 0) AS n_visible, count(*) FILTER (label = 'anomaly' AND mask_pixels = 0) AS n_empty FROM m GROUP BY label")
def mask_visibility(s, d):
    per = _grid(s, d).groupBy("image").agg(F.sum((F.col("mask") & (F.col("x") > 11)).cast("long")).alias("mask_pixels")).withColumn("label", F.when(F.col("image") % 3 == 0, "normal").otherwise("anomaly"))
    anomaly = F.col("label") == "anomaly"
    return per.groupBy("label").agg(F.count(F.lit(1)).alias("n_images"), F.sum((anomaly & (F.col("mask_pixels") > 0)).cast("long")).alias("n_visible"), F.sum((anomaly & (F.col("mask_pixels") == 0)).cast("long")).alias("n_empty"))


@query(_GRID + ", c AS (SELECT image, y // 8 AS cy, x // 8 AS cx, bool_or(mask) AS fine, bool_or(mask AND y % 8 = 0 AND x % 8 = 0) AS coarse, bool_or(support AND y % 8 = 0 AND x % 8 = 0) AS found FROM pix GROUP BY ALL) SELECT image, bool_or(fine) AND NOT bool_or(coarse) AS lost_mask, count(*) FILTER (fine) AS fine_cells, count(*) FILTER (coarse) AS coarse_cells, round(CASE WHEN bool_or(coarse) THEN count(*) FILTER (coarse AND found)::DOUBLE / count(*) FILTER (coarse OR found) END, 6) AS coarse_iou FROM c GROUP BY image")
def lost_mask(s, d):
    """Whether the mask is lost on a grid of every eighth pixel, and the overlap that is left there."""
    return grids.lost_mask(_grid(s, d), "image", "mask", "support", 8).withColumn("coarse_iou", F.round("coarse_iou", 6))


@query(_GRID + ", a AS (SELECT image, count(*) FILTER (mask) AS area, image % 5 AS grp FROM pix GROUP BY image) SELECT grp, arg_min(image, struct_pack(a := area, i := image)) AS smallest FROM a WHERE area > 0 GROUP BY grp")
def smallest_anomaly(s, d):
    area = _grid(s, d).groupBy("image").agg(F.sum(F.col("mask").cast("long")).alias("area")).where("area > 0")
    return area.groupBy((F.col("image") % 5).alias("grp")).agg(F.min_by("image", F.struct("area", "image")).alias("smallest"))


@query(_GRID + _labels(8) + ", a AS (SELECT image, count(*) FILTER (mask) AS mask_pixels, count(*) FILTER (mask AND support) AS hits, count(*) AS n FROM pix GROUP BY image), rg AS (SELECT image, region_id, avg(support::INT) AS recall, count(*) AS region_pixels FROM pix JOIN lab USING (image, y, x) GROUP BY ALL),"
    " rr AS (SELECT image, count(*) AS small_regions, count(*) FILTER (recall >= 0.1) AS small_hits, sum(recall) AS small_recall FROM rg WHERE region_pixels <= 6 GROUP BY image)"
    " SELECT image % 4 AS grp, count(*) AS n_images, count(rr.image) AS n_small_images, coalesce(sum(small_regions), 0)::BIGINT AS n_regions, coalesce(sum(small_hits), 0)::BIGINT AS n_hits, round(sum(small_hits)::DOUBLE / nullif(sum(small_regions), 0), 6) AS hit_rate, round(sum(small_recall) / nullif(sum(small_regions), 0), 6) AS mean_recall FROM a LEFT JOIN rr USING (image) GROUP BY 1")
def capture_aggregate(s, d):
    grid = _grid(s, d)
    regions = grids.region_measurements(grids.labelled_pixels(grid, ["image"], "mask"), ["image"], "region_id", "support", 256).where("region_pixels <= 6")
    small = regions.groupBy("image").agg(F.count(F.lit(1)).alias("small_regions"), F.sum(F.col("region_hit").cast("long")).alias("small_hits"), F.sum("region_recall").alias("small_recall"))
    rows = grid.select("image").distinct().join(small, "image", "left").groupBy((F.col("image") % 4).alias("grp"))
    out = rows.agg(
        F.count(F.lit(1)).alias("n_images"), F.count("small_regions").alias("n_small_images"), F.coalesce(F.sum("small_regions"), F.lit(0)).alias("n_regions"), F.coalesce(F.sum("small_hits"), F.lit(0)).alias("n_hits"),
        metrics.ratio(F.sum("small_hits"), F.sum("small_regions")).alias("hit_rate"), metrics.ratio(F.sum("small_recall"), F.sum("small_regions")).alias("mean_recall"),
    )
    return rounded(out, ["hit_rate", "mean_recall"])


@query(study.SQL + """
, f AS (SELECT p.model, p.category, p.condition, p.family, p.sample_id, t.score AS stability, CASE WHEN p.target = 0 AND c.predicted = 0 AND p.predicted = 1 THEN 'new_false_positive' WHEN p.target = 1 AND c.predicted = 1 AND p.predicted = 0 THEN 'new_false_negative' END AS transition
  FROM predictions p JOIN predictions c ON c.model = p.model AND c.category = p.category AND c.sample_id = p.sample_id AND c.condition = 'clean' JOIN test t ON t.sample_id = p.sample_id WHERE p.severity = 2)
SELECT model, category, condition, family, transition, arg_min(sample_id, struct_pack(v := stability, i := sample_id)) AS sample_id, min(stability) AS stability FROM f WHERE transition IS NOT NULL GROUP BY ALL""")
def argmin_failure(s, d):
    """The sample of least stability among each kind of new failure at severity 2."""
    failed = _paired(s, d).where("severity = 2 AND transition IN ('new_false_positive', 'new_false_negative')")
    rows = failed.select("model", "category", "condition", "family", "transition", "sample_id").join(study.scored(s, d).select("sample_id", F.col("score").alias("stability")), "sample_id")
    return rows.groupBy("model", "category", "condition", "family", "transition").agg(F.min_by("sample_id", F.struct("stability", "sample_id")).alias("sample_id"), F.min("stability").alias("stability"))


@query("SELECT family, CASE WHEN family = 'blur' THEN 2.0::DOUBLE * 336 / 224 END AS sigma, CASE WHEN family = 'noise' THEN 0.05::DOUBLE END AS standard_deviation FROM (VALUES ('blur'), ('noise')) t(family)")
def shift_parameters(s, d):
    """Parameters in pixels grow with the canvas, intensities don't."""
    rows = s.createDataFrame([("blur", {"sigma": 2.0}), ("noise", {"standard_deviation": 0.05})], "family string, parameters map<string,double>")
    scaled = F.transform_values("parameters", lambda k, v: F.when(k.isin("sigma", "translate_x", "translate_y"), v * 336 / 224).otherwise(v))
    return rows.select("family", scaled["sigma"].alias("sigma"), scaled["standard_deviation"].alias("standard_deviation"))


@query("SELECT category, CASE WHEN category = 'gasket' THEN '-' ELSE printf('%.4f%%', coverage_radius * 100) END AS radius FROM memory_stats")
def number_format(s, d):
    return table(s, d, "memory_stats").select("category", predicates.percent(F.when(F.col("category") != "gasket", F.col("coverage_radius")), 4).alias("radius"))


@query("SELECT count(*) >= 20 AS enough_rows, count(DISTINCT c_custkey) >= 20 AS enough_objects, count(DISTINCT c_nationkey) >= 2 AS enough_sessions, count(DISTINCT o_orderstatus) >= 2 AS both_labels FROM orders JOIN customer ON o_custkey = c_custkey")
def audit_minimums(s, d):
    rows = table(s, d, "orders").join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.agg((F.count(F.lit(1)) >= 20).alias("enough_rows"), (F.countDistinct("c_custkey") >= 20).alias("enough_objects"), (F.countDistinct("c_nationkey") >= 2).alias("enough_sessions"), (F.countDistinct("o_orderstatus") >= 2).alias("both_labels"))


@query(study.SQL + """
, u AS (SELECT model, condition, recall AS v, row_number() OVER (PARTITION BY model, condition ORDER BY category) - 1 AS i, count(*) OVER (PARTITION BY model, condition) AS n FROM operating),
dr AS (SELECT model, condition, r, n, CAST('0x' || substr(sha256('9:' || r || ':' || i), 1, 8) AS BIGINT) % n AS j FROM u CROSS JOIN range(1000) t(r)),
mm AS (SELECT d.model, d.condition, d.r, avg(u.v) AS m FROM dr d JOIN u ON d.model = u.model AND d.condition = u.condition AND d.j = u.i GROUP BY ALL)
SELECT model, condition, round(quantile_cont(m, 0.025), 6) AS ci_low, round(quantile_cont(m, 0.975), 6) AS ci_high FROM mm GROUP BY ALL""")
def bootstrap_hash(s, d):
    return rounded(resampling.hashed_mean(_operating(s, d), ["model", "condition"], "category", "recall", 9, 1000), ["ci_low", "ci_high"])


@query()
def bootstrap_mean(s, d):
    return resampling.bootstrap_mean(_operating(s, d), ["model", "condition"], "recall", "category", 20250117, 1000, least_units=2)


@query()
def bootstrap_ranking(s, d):
    rows = study.predictions(s, d).where("condition = 'clean'")
    return resampling.bootstrap_ranking(rows, ["model", "category"], "sample_id", 7, 1000)


@query()
def bootstrap_paired_ranking(s, d):
    rows = robustness.with_clean(study.predictions(s, d), ["model", "category", "sample_id"], "condition", ["score"])
    return resampling.bootstrap_paired_ranking(rows, ["model", "category", "condition"], "sample_id", "clean_score", "score", 7, 500)


@query()
def bootstrap_paired_ratio(s, d):
    rows = robustness.with_clean(study.predictions(s, d), ["model", "category", "sample_id"], "condition", ["predicted"]).withColumn("normal", 1 - F.col("target"))
    rows = rows.withColumns({"a": F.col("normal") * F.col("clean_predicted"), "b": F.col("normal") * F.col("predicted")})
    return resampling.bootstrap_paired_ratio(rows, ["model", "category", "condition"], "sample_id", ("a", "normal"), ("b", "normal"), 7, 1000)


@query()
def bootstrap_two_sample(s, d):
    return resampling.bootstrap_two_sample(study.predictions(s, d), ["model", "condition"], "predicted", "score", "sample_id", 7, 1000)


@query()
def bootstrap_poisson(s, d):
    return resampling.poisson_mean(study.predictions(s, d), ["model", "condition"], "sample_id", "score", 7, 500)


@query()
def capture_metrics(s, d):
    thumbs = table(s, d, "grouping_records")
    return images.map_images(thumbs, ["image_path"], "thumbnail", 32, lambda x, path: images.capture_metrics(x / 255.0), ", ".join(f"{m} double" for m in images.METRICS))


@query()
def difference_hash(s, d):
    thumbs = table(s, d, "grouping_records")
    return images.map_images(thumbs, ["image_path"], "thumbnail", 32, lambda x, path: {"dhash": f"{images.difference_hash(x):016x}"}, "dhash string")


@query()
def handcrafted_descriptor(s, d):
    thumbs = table(s, d, "grouping_records")
    return images.map_images(thumbs, ["image_path"], "thumbnail", 32, lambda x, path: {"descriptor": images.handcrafted(np.repeat(x[..., None], 3, 2)).tolist()}, "descriptor array<float>")


@query()
def shift_noise(s, d):
    """The mean of each image under noise of its own."""

    def noisy(x: np.ndarray, path: str) -> dict:
        return {"mean": float(images.shift(x, np.zeros(x.shape, bool), "noise", {"standard_deviation": 0.05}, 3, path, "noise_1")[0].mean())}

    return images.map_images(table(s, d, "grouping_records"), ["image_path"], "thumbnail", 32, noisy, "mean double")


@query()
def shift_geometric(s, d):
    """Bright pixels of each image as a mask, turned and moved with it, and the shifted map brought back: how much of the mask it covers."""

    def moved(x: np.ndarray, path: str) -> dict:
        mask = x >= np.quantile(x, 0.9)
        shifted, new, matrix = images.shift(x, mask, "geometric", {"angle_degrees": 4.0, "translate_x": 2.0, "translate_y": -1.0}, 3, path, "geometric_1")
        back = images.aligned_map(new.astype(np.float64), matrix) > 0.5
        return {"mask_pixels": int(mask.sum()), "moved_pixels": int(new.sum()), "overlap": float((back & mask).sum() / mask.sum()), "mean": float(shifted.mean())}

    return images.map_images(table(s, d, "grouping_records"), ["image_path"], "thumbnail", 32, moved, "mask_pixels int, moved_pixels int, overlap double, mean double")


@query("WITH t AS (SELECT image_path, thumbnail FROM grouping_records WHERE len(thumbnail) = 1024) SELECT image_path, round(list_avg(thumbnail) / 255, 4) AS light FROM t")
def light_and_edges(s, d):
    rows = images.map_images(table(s, d, "grouping_records"), ["image_path"], "thumbnail", 32, lambda x, path: dict(zip(("light", "edges"), images.light_and_edges(x / 255.0), strict=True)), "light double, edges double")
    return rounded(rows.select("image_path", "light"), ["light"], 4)


@query()
def random_projection(s, d):
    return neighbours.project(table(s, d, "embeddings"), ["vec_id"], "embedding", 64, 16, 3)


