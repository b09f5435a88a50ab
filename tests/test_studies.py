"""Capture studies, localization models, study tables, JSON and line files, banks: on small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from normspark.operators import capture_study, grids, localization, neighbours
from normspark.operators.relations import ContractError
from normspark.sources import sinks, tables

CAPTURE = "capture_id string, session_id string, object_id string, label string"
SESSION = "session_id string, split string, camera_id string, lighting_id string, notes string"


def study(spark):
    sessions = spark.createDataFrame([("d", "development", "a", "x", ""), ("e1", "evaluation", "a", "x", ""), ("e2", "evaluation", "b", "y", "")], SESSION)
    rows = [(f"{s}{i}", s, f"o{i}", "anomaly" if i % 2 else "normal") for s in ("d", "e1", "e2") for i in range(4)]
    return spark.createDataFrame(rows, CAPTURE), sessions


def test_holdout_is_frozen_and_opened_once(spark, tmp_path):
    captures, sessions = study(spark)
    rows = capture_study.with_sessions(captures, sessions)
    development, evaluation = rows.where("split = 'development'"), rows.where("split = 'evaluation'")
    order, lock, out = ["capture_id", "label"], str(tmp_path / "freeze"), str(tmp_path / "opened")
    least = {"n_normals": 4, "n_anomalies": 4, "n_sessions": 2, "n_cameras": 2, "n_lights": 2, "n_objects": 4}
    with pytest.raises(ContractError):
        capture_study.freeze(spark, lock, development.where("label = 'normal'"), order, sessions=sessions)
    assert capture_study.freeze(spark, lock, development, order, sessions=sessions).count() == 2
    with pytest.raises(FileExistsError):
        capture_study.freeze(spark, lock, development, order, sessions=sessions)
    assert capture_study.changed_since(spark, lock, development.repartition(3), order, sessions=sessions.orderBy(F.desc("session_id"))) == []
    changed = development.withColumn("label", F.lit("normal"))
    assert capture_study.changed_since(spark, lock, changed, order, sessions=sessions) == ["development"]
    with pytest.raises(ContractError):
        capture_study.open_holdout(spark, lock, evaluation, out, changed, order, least, sessions=sessions)
    with pytest.raises(ContractError):
        capture_study.open_holdout(spark, lock, evaluation, out, development, order, sessions=sessions)
    assert capture_study.open_holdout(spark, lock, evaluation, out, development, order, least, sessions=sessions).count() == 8
    with pytest.raises(FileExistsError):
        capture_study.open_holdout(spark, lock, evaluation, out, development, order, least, sessions=sessions)


def test_unknown_sessions_and_missing_labels(spark):
    captures, sessions = study(spark)
    with pytest.raises(ContractError):
        capture_study.with_sessions(captures, sessions.where("session_id <> 'e2'"))
    rows = capture_study.with_sessions(captures, sessions).where("session_id <> 'e2' OR label = 'normal'")
    gaps = {(r.requirement, r.value) for r in capture_study.coverage_gaps(rows).collect()}
    assert {("both_labels_per_session_id", "e2"), ("both_labels_per_camera_id", "b"), ("n_sessions", None)} <= gaps and ("both_labels_per_session_id", "d") not in gaps
    assert {r.requirement for r in capture_study.coverage_gaps(rows.limit(0)).collect()} == set(capture_study.MINIMUMS)


def test_thresholds_within_a_budget_against_arrays(spark):
    rng = np.random.default_rng(4)
    maps = {f"i{n}": np.round(rng.random((12, 12)), 3) + (np.indices((12, 12)).sum(0) % 5 == 0) * 0.4 for n in range(6)}
    rows = [("g", k, y, x, float(m[y, x])) for k, m in maps.items() for y in range(12) for x in range(12)]
    pixels = spark.createDataFrame(rows, "g string, image string, y int, x int, score double")
    least, radius, budget, steps = 3, 1, 0.02, 6

    def rate(low, high):
        kept = 0
        for m in maps.values():
            near = np.zeros(m.shape, bool)
            for y, x in zip(*np.nonzero(m > high), strict=True):
                near[max(0, y - radius) : y + radius + 1, max(0, x - radius) : x + radius + 1] = True
            labels = grids.label_regions((m > low) & near)
            kept += sum((labels == n).sum() for n in np.unique(labels[(m > high) & (labels > 0)]) if (labels == n).sum() >= least)
        return kept / (6 * 144)

    values = np.sort(np.concatenate([m.ravel() for m in maps.values()]))
    low, high = (values[int(np.ceil(q * (len(values) - 1)))] for q in (0.5, 0.8))
    left, right = high, values[-1]
    assert rate(low, high) > budget
    for _ in range(steps):
        middle = (left + right) / 2
        left, right = (left, middle) if rate(low, middle) <= budget else (middle, right)
    got = localization.budgeted_thresholds(pixels, ["g"], "image", "score", 0.5, 0.8, least, radius, budget, steps).first()
    assert (got.low, got.high, got.rate) == (pytest.approx(low), pytest.approx(right), pytest.approx(rate(low, right)))


def test_models_and_coarse_readout(spark):
    rows = [("g", f"i{n}", y, x, float((n * 7 + y * 3 + x) % 11)) for n in range(32) for y in range(4) for x in range(4)]
    pixels = spark.createDataFrame(rows, "g string, image string, y int, x int, score double")
    cells, model = localization.fit_localization(pixels.where("CAST(substr(image, 2) AS INT) < 16"), pixels.where("CAST(substr(image, 2) AS INT) >= 16"), ["g"], "image", "score", 0.8, 0.9, 0.01, 0.2, 3)
    assert {r.kind for r in model.collect()} == {"raw", "spatial"} and cells.count() == 16
    localization.require_valid(cells, model, 0.2)
    for bad in (model.withColumn("low", F.col("high") + 1), model.withColumn("n_fit", F.lit(3))):
        with pytest.raises(ContractError):
            localization.require_valid(cells, bad, 0.2)
    with pytest.raises(ContractError):
        localization.fit_localization(pixels.limit(5), pixels, ["g"], "image", "score")
    coarse = localization.coarse_support(pixels.where("image = 'i1'").withColumn("t", F.lit(4.0)), ["image"], "score", "t", 2)
    frame = np.array([[(7 + y * 3 + x) % 11 for x in range(4)] for y in range(4)], float).reshape(2, 2, 2, 2).mean((1, 3))
    assert {(r.y, r.x): r.support for r in coarse.collect()} == {(y, x): bool(frame[y // 2, x // 2] > 4) for y in range(4) for x in range(4)}


def test_study_tables_lines_and_documents(spark, tmp_path):
    path = tmp_path / "captures.csv"
    path.write_text("a,b\n 1 ,x y\n2,\n")
    assert [tuple(r) for r in tables.read_study_table(spark, str(path), ["a", "b"]).collect()] == [("1", "x y"), ("2", "")]
    for text in ("a,c\n1,2\n", "a,b\n1\n", "a,b\n1,2,3\n", ""):
        path.write_text(text)
        with pytest.raises(ContractError):
            tables.read_study_table(spark, str(path), ["a", "b"])
    path.write_text("a,b\n1,2\n3,4\n")
    with pytest.raises(ContractError):
        tables.read_study_table(spark, str(path), ["a", "b"], most=1)
    df = spark.createDataFrame([(2, None), (1, "é")], "b int, a string")
    digest = sinks.write_lines(df, str(tmp_path / "m.jsonl"), ["b"])
    assert (tmp_path / "m.jsonl").read_text() == '{"a":"é","b":1}\n{"a":null,"b":2}\n'
    assert digest == sinks.write_lines(df.repartition(3), str(tmp_path / "m.jsonl"), ["b"])
    sinks.write_json(spark, {"b": 1, "a": [None]}, str(tmp_path / "d.json"))
    sinks.write_json(spark, {"b": 2}, str(tmp_path / "d.json"))
    assert (tmp_path / "d.json").read_text() == '{\n  "b": 2\n}'
    with pytest.raises(FileExistsError):
        sinks.write_json(spark, {"b": 3}, str(tmp_path / "d.json"), exclusive=True)


def test_inventory_masks_strata_and_values(spark, tmp_path):
    for name in ("nut/Data/Images/Normal/1.png", "nut/Data/Masks/Anomaly/2.png", "nut/other.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    got = tables.inventory(spark, str(tmp_path), {"Images": "image", "Masks": "mask"})
    assert {tuple(r) for r in got.collect()} == {("nut", "image", "nut/Data/Images/Normal/1.png"), ("nut", "mask", "nut/Data/Masks/Anomaly/2.png")}
    files = spark.createDataFrame([("t/1.png",), ("t/1_GT.png",), ("t/2.png",)], "p string")
    assert {tuple(r) for r in tables.paired_masks(files, "p").collect()} == {("t/1.png", "t/1_GT.png"), ("t/2.png", None)}
    with pytest.raises(ContractError):
        tables.paired_masks(files.where("p <> 't/1.png'"), "p")
    rows = spark.createDataFrame([("train", "normal", 1.0, 0), ("test", "normal", float("nan"), 2), ("test", None, None, None)], "split string, label string, v double, f int")
    assert tables.require_strata(rows, ["split", "label"], [("test", "normal")]).count() == 1
    with pytest.raises(ContractError):
        tables.require_strata(rows, ["split", "label"], [("test", "anomaly")])
    assert {(r.column, r.problem): r.n_rows for r in tables.value_problems(rows, ["v"], ["f"]).collect()} == {("v", "null"): 1, ("v", "not_finite"): 1, ("f", "null"): 1, ("f", "not_binary"): 1}


def test_banks_keep_their_contract(spark, tmp_path):
    bank = spark.createDataFrame([("c", 0, [1.0, 2.0], 5)], "category string, slot int, vec array<float>, source long")
    neighbours.write_bank(bank, str(tmp_path / "bank"))
    assert neighbours.read_bank(spark, str(tmp_path / "bank")).count() == 1
    neighbours.write_bank(bank.unionByName(bank.withColumn("vec", F.array(F.lit(float("nan")).cast("float"), F.lit(1.0).cast("float")))), str(tmp_path / "bank"))
    with pytest.raises(ContractError):
        neighbours.read_bank(spark, str(tmp_path / "bank"))
