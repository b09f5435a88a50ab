"""Queries over small tables in which a cut of the job would show."""

from datetime import datetime

import numpy as np

from normspark.plans import data_queries, more_queries, study


def test_near_duplicates_take_their_versions_limits_and_compare_thumbnails(spark, tmp_path):
    flat, lighter, other = [100] * 1024, [130] * 1024, [0] * 512 + [255] * 512
    images = [  # id, version, category, split, hash, thumbnail
        ("a", "v2", "k", "train", "0000000000000000", flat),
        ("b", "v2", "k", "test", "0x3", lighter),  # 2 bits from a
        ("c", "v2", "k", "train", "7", flat),  # 3 bits from a, 1 from b
        ("d", "v2", "k", "train", "0", other),  # a's hash, another image
        ("e", "v2", "k", "train", "0", None),
        ("f", "v3", "k", "train", "0", flat),
        ("g", "v3", "k", "test", "7", flat),  # 3 bits from f
        ("h", "v3", "m", "test", "0", flat),
        ("i", "none", "k", "train", "0", flat),
        ("j", "v2", "k", "test", "0", flat),  # a copy of a
    ]
    manifest = [(i, v, c, split, "train", "normal", f"{i}.png", "00", h, datetime(2025, 1, 1)) for i, v, c, split, h, _ in images]
    schema = "sample_id string, dataset_version string, category string, split string, source_split string, label string, image_path string, image_sha256 string, perceptual_hash string, ingested_at timestamp"
    spark.createDataFrame(manifest, schema).write.parquet(f"{tmp_path}/manifest.parquet")
    spark.createDataFrame([(f"{r[0]}.png", r[5]) for r in images], "image_path string, thumbnail array<int>").write.parquet(f"{tmp_path}/grouping_records.parquet")
    spark.createDataFrame([("v2", 2, 0.1), ("v3", 3, 0.25)], "dataset_version string, perceptual_max_dhash_distance int, perceptual_max_normalized_mae double").write.parquet(f"{tmp_path}/visa_config.parquet")
    got = sorted(tuple(r) for r in data_queries.banded_near_dup(spark, str(tmp_path)).collect())
    assert got == [("a", "b", 2), ("a", "j", 0), ("b", "c", 1), ("b", "j", 2), ("f", "g", 3)]
    crossing = {(r.key_a, r.key_b) for r in data_queries.cross_split_duplicates(spark, str(tmp_path)).collect()}
    assert crossing == {("a", "b"), ("a", "j"), ("b", "c"), ("f", "g")}
    assert {r.node: r.component for r in data_queries.components(spark, str(tmp_path)).collect()} == {"a": "a", "b": "a", "c": "a", "j": "a", "f": "f", "g": "f"}


def test_each_order_is_a_frame_of_its_own(spark, tmp_path):
    rows = [(1, 0, 0, 10.0, 50.0, 0.1, 0.0), (201, 0, 0, 30.0, 1.0, 0.0, 0.0), (201, 1, 0, 20.0, 50.0, 0.1, 0.0), (2, 8, 0, 40.0, 1.0, 0.0, 0.0)]
    schema = "l_orderkey long, l_partkey long, l_suppkey long, l_extendedprice double, l_quantity double, l_discount double, l_tax double"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/lineitem.parquet")
    assert {tuple(r) for r in data_queries.top_fraction_mean(spark, str(tmp_path)).collect()} == {(1, 10.0, 1), (201, 30.0, 1), (2, 40.0, 1)}
    assert {(r.image, r.mask_pixels, r.n_pixels) for r in data_queries.mask_measurements(spark, str(tmp_path)).collect()} == {(1, 1, 1), (201, 1, 2), (2, 0, 1)}
    blended = {(r.frame, r.frame_y, r.frame_x): r.score for r in data_queries.tile_blend(spark, str(tmp_path)).collect()}
    assert blended == {(0, 8, 0): 10.0, (0, 24, 0): 40.0, (67, 0, 0): 30.0, (67, 1, 0): 20.0}


def test_argmin_failure_takes_the_new_failures_at_severity_2(spark, tmp_path):
    rng = np.random.default_rng(11)
    kinds = ["error", "view", "click"]
    rows = [(i, i % 3, kinds[int(rng.integers(3))], float(rng.exponential(12))) for i in range(600)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    value = {r[0]: r[3] for r in rows}
    seen = [r.asDict() for r in study.predictions(spark, str(tmp_path)).collect()]
    clean = {(r["model"], r["sample_id"]): r["predicted"] for r in seen if r["condition"] == "clean"}
    want = {}
    for r in seen:
        before = clean[r["model"], r["sample_id"]]
        if r["severity"] == 2 and before == r["target"] != r["predicted"]:
            key = r["model"], r["category"], r["condition"], "new_false_negative" if r["target"] else "new_false_positive"
            want[key] = min(want.get(key, (float("inf"), 0)), (value[r["sample_id"]], r["sample_id"]))
    got = {(r.model, r.category, r.condition, r.transition): (r.stability, r.sample_id) for r in more_queries.argmin_failure(spark, str(tmp_path)).collect()}
    assert got == want and any(i % 5 for _, i in got.values())


def test_every_record_has_its_place(spark, tmp_path):
    names = ["train", " Validation", "test"]
    rows = [(f"s{i}", "v", None if i % 7 == 0 else f"c{i % 7 // 4}", names[i * 5 % 3], "train", "normal", f"p{i * 37 % 90:02}.png", "00", "0", datetime(2025, 1, 1)) for i in range(90)]
    schema = "sample_id string, dataset_version string, category string, split string, source_split string, label string, image_path string, image_sha256 string, perceptual_hash string, ingested_at timestamp"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/manifest.parquet")
    ordered = sorted((str(r[2]), names.index(r[3]), r[6], r[2]) for r in rows)
    want, count = set(), {}
    for _, rank, path, category in ordered:
        count[category] = count.get(category, 0) + 1
        want.add((category, names[rank].strip().lower(), path, count[category]))
    got = [tuple(r) for r in data_queries.canonical_order(spark, str(tmp_path)).collect()]
    assert len(got) == 90 and set(got) == want
