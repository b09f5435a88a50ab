"""Splits, duplicates, relations, grids, gates, resampling, kernels, sources, sinks and the stream, on small tables."""

import hashlib
import json

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from normspark.functions import predicates
from normspark.operators import duplicates, gates, grids, images, neighbours, relations, resampling, robustness, splits
from normspark.sources import sinks, tables
from normspark.streaming import scoring


def test_splits_do_not_depend_on_row_order(spark):
    df = spark.createDataFrame([("c", f"p{i}") for i in range(40)], "category string, path string")
    a = splits.hash_split(df, "category", "path", 3, 0.25)
    b = splits.hash_split(df.repartition(7).orderBy(F.rand(1)), "category", "path", 3, 0.25)
    assert {tuple(r) for r in a.collect()} == {tuple(r) for r in b.collect()}
    assert a.where("assigned = 'validation'").count() == 10


def test_greedy_split_against_a_plain_loop(spark):
    groups = [("c", f"g{i}", (i * 7) % 5 + 1) for i in range(12)]
    got = {r.g: r.assigned for r in splits.greedy_split(spark.createDataFrame(groups, "c string, g string, n int"), "c", "g", "n", 5, 0.3).collect()}
    order = sorted(groups, key=lambda r: hashlib.sha256(f"5\0c\0{r[1]}".encode()).hexdigest())
    total = sum(r[2] for r in groups)
    target, count, taken = max(1, min(total - 1, int(total * 0.3 + 0.5))), 0, set()
    for _, g, n in order[:-1]:
        if not taken or abs(target - count - n) <= abs(target - count):
            taken.add(g)
            count += n
    assert {g for g, s in got.items() if s == "validation"} == taken


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(f"n{i:03}", f"n{i + 1:03}") for i in range(60)] + [("hub", f"s{i}") for i in range(30)] + [("x", "x")]
    got = {r.node: r.component for r in duplicates.components(spark.createDataFrame(edges, "key_a string, key_b string")).collect()}
    assert {got[f"n{i:03}"] for i in range(61)} == {"n000"} and {got[f"s{i}"] for i in range(30)} == {"hub"} and "x" not in got


def test_banded_pairs_link_copies_once(spark):
    rows = [("a", "k", 0b0), ("b", "k", 0b0), ("c", "k", 0b1), ("d", "other", 0b0), ("e", "k", None), ("f", "k", -1)]
    got = {tuple(r) for r in duplicates.banded_pairs(spark.createDataFrame(rows, "id string, category string, bits long"), "id", "bits", ["category"], 1).collect()}
    assert got == {("a", "b", 0), ("a", "c", 1)}


def test_source_split_assignment(spark):
    rows = [("1", "x", "test", "normal"), ("2", "x", "train", "normal"), ("3", "y", "train", "anomaly"), ("4", "z", "train", "normal")]
    out = splits.assign_source_split(spark.createDataFrame(rows, "id string, comp string, source_split string, label string"), "comp", "source_split", "label")
    assert {r.id: (r.assigned, r.reason) for r in out.collect()} == {"1": ("test", None), "2": ("excluded", "test_duplicate"), "3": ("excluded", "training_anomaly"), "4": ("train", None)}


def test_relations(spark):
    e = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    a = spark.createDataFrame([("a", 1), ("a", 2), ("c", 3), (None, 4)], "k string, extra int")
    assert {(r.problem, r.k) for r in relations.coverage_gaps(e, a, ["k"]).collect()} == {("missing", "b"), ("duplicate", "a"), ("unexpected", "c")}
    with pytest.raises(relations.ContractError):
        relations.require_empty(a, "rows")


def test_paths_names_and_times(spark):
    paths = {"a/b.png": True, "/a": False, "a/../b": False, "a\\b": False, "c:x": False, "": False, "a//b": False, None: False}
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert {r.p: r.ok for r in df.select("p", predicates.safe_path(F.col("p")).alias("ok")).collect()} == paths
    names = {"part-1": True, "CON": False, "-x": False, None: False, "a" * 65: False}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r.n: r.ok for r in df.select("n", predicates.identifier_ok(F.col("n")).alias("ok")).collect()} == names
    times = {"2025-01-01T00:00:00Z": True, "2025-01-01T00:00:00": False, "2035-01-01T00:00:00Z": False, "nonsense": False, None: False}
    df = spark.createDataFrame([(t,) for t in times], "t string")
    now = F.lit("2026-01-01T00:00:00Z").cast("timestamp")
    assert {r.t: r.ok for r in df.select("t", predicates.timestamp_ok(F.col("t"), now).alias("ok")).collect()} == times


def test_transitions(spark):
    rows = [(0, 0, 0), (0, 1, 1), (0, 0, 1), (1, 1, 0), (0, 1, 0), (1, 0, 1), (None, 0, 0)]
    got = [r[0] for r in spark.createDataFrame(rows, "t int, c int, s int").select(robustness.transition(F.col("t"), F.col("c"), F.col("s"))).collect()]
    assert got == ["unchanged_correct", "unchanged_error", "new_false_positive", "new_false_negative", "recovered_normal", "recovered_anomaly", None]


def test_perfect_localization(spark):
    rows = [("a", y, x, 2 <= y < 5 and 2 <= x < 5, float(2 <= y < 5 and 2 <= x < 5)) for y in range(8) for x in range(8)]
    df = spark.createDataFrame(rows, "image string, y int, x int, mask boolean, score double").withColumn("label", F.lit("anomaly"))
    m = grids.mask_measurements(df.withColumn("support", F.col("score") > 0.5), "image", "label", "mask", "support").first()
    assert m.foreground_iou == 1 and m.all_image_iou == 1
    labelled = grids.labelled_pixels(df, ["image"], "mask", 4)
    assert labelled.where("region_id IS NOT NULL").agg(F.countDistinct("region_id")).first()[0] == 1
    assert grids.aupro(labelled, [], "image", "region_id", "score").first().aupro == pytest.approx(1.0)
    assert grids.aupro(labelled.withColumn("score", F.lit(1.0)), [], "image", "region_id", "score").first().aupro == 0


def test_regions_strata_and_hysteresis(spark):
    mask = np.zeros((10, 10), bool)
    mask[0, 0] = mask[1, 1] = mask[5:7, 5:7] = True
    found = grids.label_regions(mask)
    assert found[0, 0] == found[1, 1] == 1 and found[5, 5] == 2 and found.max() == 2
    assert grids.label_regions(mask, 4).max() == 3
    spiral = np.array([[int(c) for c in row] for row in ("1111111", "0000001", "1111101", "1000101", "1011101", "1000001", "1111111")], bool)
    assert grids.label_regions(spiral, 4).max() == 1 and (grids.label_regions(spiral) > 0).sum() == spiral.sum()
    # a row of twelve low pixels with one seed: within one pixel of the seed stand only three
    rows = [("a", 0, x, 1.0 if x == 5 else 0.5) for x in range(12)] + [("a", 4, x, 0.5) for x in range(12)] + [("b", 0, 0, None)]
    pixels = spark.createDataFrame(rows, "image string, y int, x int, score double").withColumns({"low": F.lit(0.4), "high": F.lit(0.9)})
    for least, want in ((3, {(0, 4), (0, 5), (0, 6)}), (4, set())):
        assert {(r.y, r.x) for r in grids.seeded_regions(pixels, ["image"], "score", "low", "high", least, 1).collect()} == want
    assert grids.seeded_regions(pixels, ["image"], "score", "low", "high", 12).count() == 12
    df = spark.createDataFrame([("s", f, 1, 1.0) for f in (0.001, 0.01, 0.5)], "sample string, region_fraction double, region_hit int, region_recall double")
    got = {r.stratum: r.n_regions for r in grids.overlapping_strata(grids.strata(df, 0.001, 0.01), [], "sample").collect()}
    assert got == {"tiny": 1, "small": 1, "large": 1, "small_inclusive": 2, "all": 3}


def test_aupro_finds_a_pixel_above_the_threshold_only(spark):
    """Region of scores 10 and 0, background of 9.9 and nine times 0, by hand with 30 thresholds: 0.5 from the first threshold below 10; the area up to 0.3."""
    rows = [("a", 0, 0, True, 10.0), ("a", 0, 1, True, 0.0), ("a", 2, 0, False, 9.9)] + [("a", 2, x, False, 0.0) for x in range(1, 10)]
    df = spark.createDataFrame(rows, "image string, y int, x int, mask boolean, score double")
    got = grids.aupro(grids.labelled_pixels(df, ["image"], "mask", 4).withColumn("g", F.lit("k")), ["g"], "image", "region_id", "score", 30).first()
    assert got.aupro == pytest.approx((0.1 * 0.25 + 0.2 * 0.5) / 0.3)


def test_labels_of_many_images_in_small_batches(spark):
    rng = np.random.default_rng(3)
    frames = {f"i{n}": rng.random((9, 7)) < 0.5 for n in range(40)}
    rows = [(k, y, x, bool(m[y, x])) for k, m in frames.items() for y in range(9) for x in range(7)]
    df = spark.createDataFrame(rows, "image string, y int, x int, mask boolean")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    got = {(r.image, r.y, r.x): r.region_id for r in grids.labelled_pixels(df, ["image"], "mask").collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for k, m in frames.items():
        todo, n = {(y, x) for y, x in zip(*np.nonzero(m), strict=True)}, 0
        for first in sorted(todo):
            if first not in todo:
                continue
            n, reach = n + 1, [first]
            todo.discard(first)
            while reach:
                y, x = reach.pop()
                assert got[k, y, x] == n
                near = {(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)} & todo
                todo -= near
                reach.extend(near)


def test_tile_weights(spark):
    """Two tiles of two pixels: weights 0.525 on either axis are equal; of four pixels they differ."""
    tiles = spark.createDataFrame([("f", 0, 0, 3, 0, 0.0), ("f", 1, 0, 2, 0, 8.0)], "f string, top int, left int, y int, x int, score double")
    edge, inner = (0.05 + 0.95 * np.sin(np.pi * (y + 0.5) / 4) ** 2 for y in (3, 2))
    assert grids.tile_blend(tiles, ["f"], 4).first().score == pytest.approx(8 * inner / (edge + inner))


def test_map_correlation_and_pixel_metrics(spark):
    rows = [("same", 1.0, 1.0), ("same", 1.0, 1.0), ("flat", 1.0, 2.0), ("flat", 1.0, 3.0), ("up", 1.0, 2.0), ("up", 2.0, 4.0), ("up", None, 9.0)]
    df = spark.createDataFrame(rows, "image string, a double, b double")
    assert {r.image: r.correlation for r in grids.map_correlation(df, ["image"], "a", "b").collect()} == {"same": 1.0, "flat": 0.0, "up": pytest.approx(1.0)}
    rows = [("a", True, 0.9), ("a", False, 0.1), ("b", False, 0.2), ("b", False, 0.1), ("b", True, float("nan"))]
    df = spark.createDataFrame(rows, "image string, mask boolean, score double").withColumns({"t": F.lit(0.5), "g": F.lit(1)})
    got = grids.pixel_metrics(df, ["g"], "image", "mask", "score", "t").first()
    assert (got.n_images, got.pixel_iou_mean, got.pixel_auroc, got.pixel_ap, got.pixel_count) == (2, 1.0, 1.0, 1.0, 4)


def test_banded_pairs_of_any_distance(spark):
    bits = sum(1 << (16 * i) for i in range(4))  # a bit in each 16-bit word
    df = spark.createDataFrame([("a", 0), ("b", bits), ("c", -1)], "id string, bits long")
    assert {tuple(r) for r in duplicates.banded_pairs(df, "id", "bits", [], 4).collect()} == {("a", "b", 4)}


def test_tiles(spark):
    frames = spark.createDataFrame([(336, 336)], "h int, w int")
    assert {(r.top, r.left) for r in grids.tile_layout(frames, "h", "w", 224, 112).collect()} == {(0, 0), (0, 112), (112, 0), (112, 112)}
    tiles = spark.createDataFrame([("f", t, 0, y, x, 3.0) for t in (0, 2) for y in range(4) for x in range(4)], "f string, top int, left int, y int, x int, score double")
    assert {round(r.score, 9) for r in grids.tile_blend(tiles, ["f"], 4).collect()} == {3.0}


def test_gate(spark):
    rows = [("c", "m", float(v)) for v in range(9)] + [("c", "m", None)]
    df = spark.createDataFrame(rows, "category string, metric string, value double")
    assert gates.robust_scale(df, ["category", "metric"], "value").count() == 0  # too few to fit a model on
    r = gates.robust_scale(df, ["category", "metric"], "value", 9).first()
    assert r.center == 4 and r.scale == pytest.approx(max(1.4826 * 2, 4 / 1.349))
    df = spark.createDataFrame([(-2.0, "lower"), (2.0, "lower"), (2.0, "upper"), (-3.0, "two_sided")], "z double, d string")
    assert [x[0] for x in df.select(gates.deviation(F.col("z"), F.col("d"))).collect()] == [2.0, 0.0, 2.0, 3.0]


def test_two_gates_with_exact_intervals(spark):
    rows = [(g, 0, i < k, "normal") for g, k in (("v1", 0), ("v2", 7)) for i in range(20)]
    got = {r.gate: r for r in gates.gate_comparison(spark.createDataFrame(rows, "gate string, target int, rejected boolean, decision string"), "gate", []).collect()}
    assert got["v1"].rejection_ci_low == 0 and got["v1"].rejection_ci_high == pytest.approx(1 - 0.025 ** (1 / 20))
    # chance of 7 or more of 20 at the lower end, of 7 or fewer at the upper end
    tail = [sum(math.comb(20, k) * p**k * (1 - p) ** (20 - k) for k in part) for p, part in ((got["v2"].rejection_ci_low, range(7, 21)), (got["v2"].rejection_ci_high, range(8)))]
    assert tail == pytest.approx([0.025, 0.025])


def test_moved_images_and_masks():
    frame = np.arange(49, dtype=np.uint8).reshape(7, 7) * 5
    mask = np.zeros((7, 7), bool)
    mask[2, 4] = True
    still, same, matrix = images.shift(frame, mask, "geometric", {"angle_degrees": 0.0, "translate_x": 1.0, "translate_y": -1.0}, 1, "k", "c")
    assert same[1, 5] and same.sum() == 1 and (still[:6, 1:] == frame[1:, :6]).all()
    assert (still[6, 1:] == frame[5, :6]).all()  # mirrored at the lower edge
    assert (images.aligned_map(same.astype(float), matrix) > 0.5).tolist() == mask.tolist()
    turned, quarter, _ = images.shift(frame, mask, "geometric", {"angle_degrees": 90.0, "translate_x": 0.0, "translate_y": 0.0}, 1, "k", "c")
    assert (turned == np.rot90(frame)).all() and (quarter == np.rot90(mask)).all()
    assert images.resize_area(np.array([[0.0, 2, 4], [2, 4, 6], [1, 1, 1]]), 1, 1)[0, 0] == pytest.approx(21 / 9)
    assert images.resize_area(np.array([[0.0, 3, 6]]), 1, 2)[0].tolist() == pytest.approx([1.0, 5.0])


def test_hue_bins_of_a_colour():
    blue = np.zeros((8, 8, 3), np.uint8)
    blue[..., 2] = 255  # hue 240 degrees: 120 of 255, bin 7 of 16
    parts = images.handcrafted(blue)
    hue = parts[3 * 21 : 4 * 21]
    assert hue[0] == pytest.approx(120 / 255) and hue[5 + 7] == 1.0


def test_neighbours_and_k_center(spark):
    rows = [("c", i, [float(i), 0.0]) for i in (0, 1, 2, 10)]
    v = spark.createDataFrame(rows, "category string, id long, vec array<float>")
    bank = neighbours.k_center(v, "category", "id", "vec", 2, 100, 1)
    assert [(r.slot, r.source) for r in bank.orderBy("slot").collect()] == [(0, 2), (1, 10)]
    got = {r.id: r.score for r in neighbours.nearest_score(v, bank, "category", "id", "vec").collect()}
    assert got == {0: 2.0, 1: 1.0, 2: 0.0, 10: 0.0}


def test_bootstrap(spark):
    assert resampling.mean_interval(np.array([0.25]), 1, 10, 0.95) == (0.25, 0.25)
    df = spark.createDataFrame([("k", i, i % 2, float(i), float(i) + 1) for i in range(30)], "k string, id int, target int, a double, b double")
    r = resampling.bootstrap_paired_ranking(df, ["k"], "id", "a", "b", 3, 20).first()
    assert (r.auroc_delta_low, r.auroc_delta_high) == (0.0, 0.0)
    one = resampling.bootstrap_mean(df.where("id = 1"), ["k"], "a", "id", 1, least_units=2).first()
    assert one.mean == 1.0 and one.ci_low is None
    p = resampling.poisson_mean(df, ["k"], "id", "a", 5, 200).first()
    q = resampling.poisson_mean(df.repartition(5), ["k"], "id", "a", 5, 200).first()
    assert p == q and p.ci_low < 14.5 < p.ci_high


def test_two_sample_of_a_group_beyond_one_task(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [("k" if i % 3 else None, i, i % 2, float(rng.exponential(5)) + i % 2) for i in range(900)]
    rows += [("k", 1000, 1, None), ("k", 1001, None, 9e9), ("k", 1002, 0, float("nan")), ("small", 1, 1, 4.0), ("small", 2, 0, 1.0)]
    rows += [("none", i, 1, None) for i in range(200)] + [("one", i, 1, 2.0) for i in range(200)] + [("flat", i, i % 2, 3.0 + i % 2) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, id int, g int, x double")
    want = {r.k: r for r in resampling.bootstrap_two_sample(df, ["k"], "g", "x", "id", 5, 400).collect()}
    monkeypatch.setattr(resampling, "MOST_UNITS", 100)
    monkeypatch.setattr(resampling, "BLOCK_UNITS", 64)
    monkeypatch.setattr(resampling, "DRAWS", 50)
    got = {r.k: r for r in resampling.bootstrap_two_sample(df, ["k"], "g", "x", "id", 5, 400).collect()}
    again = {r.k: r for r in resampling.bootstrap_two_sample(df.repartition(5, "x"), ["k"], "g", "x", "id", 5, 400).collect()}
    assert got == again and got.keys() == want.keys() == {"k", None, "small", "none", "one", "flat"}
    assert got["small"] == want["small"] and got["none"].difference is None and got["one"].ci_low is None
    assert (got["flat"].ci_low, got["flat"].ci_high) == pytest.approx((1.0, 1.0))
    for k in ("k", None):
        assert got[k].difference == pytest.approx(want[k].difference)
        width = want[k].ci_high - want[k].ci_low
        assert abs(got[k].ci_low - want[k].ci_low) < 0.12 * width and abs(got[k].ci_high - want[k].ci_high) < 0.12 * width


def test_mean_interval_draws_one_matrix_of_units():
    x = np.array([0.1, 0.4, 0.2, 0.9])
    means = np.random.default_rng(7).choice(x, (50, 4), replace=True).mean(1)
    assert resampling.mean_interval(x, 7, 50, 0.95) == pytest.approx(tuple(np.quantile(means, [0.025, 0.975])))


def test_kernels_move_the_right_way():
    rng = np.random.default_rng(1)
    frame = np.kron(rng.integers(40, 216, (8, 8)), np.ones((8, 8))).astype(np.uint8)
    base = images.capture_metrics(frame / 255)
    blurred = images.capture_metrics(images.shift(frame, frame > 9, "blur", {"sigma": 2.0}, 1, "k", "c")[0] / 255)
    noisy = images.capture_metrics(images.shift(frame, frame > 9, "noise", {"standard_deviation": 0.1}, 1, "k", "c")[0] / 255)
    assert blurred["sharpness"] < base["sharpness"] and noisy["noise"] > base["noise"] and noisy["log_flat_noise"] > base["log_flat_noise"]
    one, same, other = (images.shift(frame, frame > 9, "noise", {"standard_deviation": 0.1}, 1, k, "c")[0] for k in ("k", "k", "l"))
    assert (one == same).all() and (one != other).any()
    assert images.difference_hash(np.tile(np.arange(32) * 8, (32, 1))) == 2**64 - 1
    assert np.isclose(images.handcrafted(np.repeat(frame[..., None], 3, 2))[5:21].sum(), 1)


def test_sources_and_sinks(spark, tmp_path):
    record = {c.split()[0]: None for c in tables.MANIFEST.split(", ")} | {"sample_id": "1", "image_path": "a/b.png", "width": 1}
    (tmp_path / "m.jsonl").write_text(json.dumps(record) + "\n")
    assert tables.read_manifest(spark, str(tmp_path / "m.jsonl")).count() == 1
    with pytest.raises(relations.ContractError):
        tables.read_manifest(spark, str(tmp_path / "m.jsonl"), "0" * 64)
    (tmp_path / "bad.jsonl").write_text(json.dumps(record | {"image_path": "../b"}) + "\n")
    with pytest.raises(relations.ContractError):
        tables.read_manifest(spark, str(tmp_path / "bad.jsonl"))
    (tmp_path / "s.csv").write_text("object,split,label,image,mask\nw,train,normal,w/1.png,\nw,test,anomaly,w/2.png,w/m2.png\n")
    assert tables.read_split_table(spark, str(tmp_path / "s.csv"), ["w"]).count() == 2
    with pytest.raises(relations.ContractError):
        tables.read_split_table(spark, str(tmp_path / "s.csv"), ["other"])
    (tmp_path / "a.csv").write_text("model,score,note\nm,1.5,\nm,,x\n")
    a = tables.read_artifact(spark, str(tmp_path / "a.csv"), ["model"])
    assert dict(a.dtypes) == {"model": "string", "score": "double", "note": "string"} and a.where("score IS NULL").count() == 1
    out = str(tmp_path / "out")
    sinks.publish(a, out)
    sinks.publish(a.limit(1), out)
    assert spark.read.parquet(out).count() == 1
    with pytest.raises(FileExistsError):
        sinks.publish(a, out, exclusive=True)
    assert sinks.union_tables([a.select("model"), a.select("score")]).columns == ["model", "score"]


def test_stream_is_decided_like_a_batch(spark, tmp_path):
    cal = spark.createDataFrame([("a", float(x)) for x in range(19)], "g string, score double")
    spark.createDataFrame([("a", 100.0), ("a", -1.0), ("a", 17.0)], "g string, score double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("g string, score double").parquet(str(tmp_path / "in"))
    scoring.decide_stream(stream, cal, ["g"], 0.05, 0.2, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {r.score: r.decision for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {100.0: "anomalous", -1.0: "normal", 17.0: "review"}
