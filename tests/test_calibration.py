"""Hand-computed values of calibration, decisions and metrics."""

import math
import random

import pytest
from pyspark.sql import functions as F

from normspark.operators import calibration, metrics


def rows(df, *columns):
    return [tuple(r) for r in df.orderBy(*columns).collect()]


def test_conformal_p_against_counting(spark):
    rng = random.Random(2)
    cal = [(g, rng.randrange(12) / 2) for g in "xxxyyz" for _ in range(9)]
    test = [(i, rng.choice("xyzw"), rng.choice([None, *(k / 4 for k in range(30))])) for i in range(80)]
    out = {r.i: r.conformal_p for r in calibration.conformal_p(spark.createDataFrame(test, "i int, g string, score double"), spark.createDataFrame(cal, "g string, score double"), ["g"]).collect()}
    assert len(out) == len(test)
    for i, g, score in test:
        own = [s for h, s in cal if h == g]
        want = (1 + sum(s >= score for s in own)) / (1 + len(own)) if own and score is not None else None
        assert out[i] == (want if want is None else pytest.approx(want))


def test_decisions_by_p_value(spark):
    """On a limit the more severe decision holds."""
    df = spark.range(0, 41).select((F.col("id") / 40).alias("p")).unionByName(spark.createDataFrame([(None,)], "p double"))
    got = {r.p: r.d for r in df.select("p", calibration.three_way(F.col("p"), 0.125, 0.5).alias("d")).collect()}
    assert got.pop(None) is None
    assert {d: (min(p for p in got if got[p] == d), max(p for p in got if got[p] == d)) for d in set(got.values())} == {"anomalous": (0.0, 0.125), "review": (0.15, 0.5), "normal": (0.525, 1.0)}


def test_selective_rates_against_counting(spark):
    """Three groups: mixed, one without automatic decisions, one of one label."""
    rng = random.Random(9)
    rows = [("mixed", rng.randrange(2), rng.choice(["normal", "review", "anomalous"])) for _ in range(60)]
    rows += [("asked", i % 2, "review") for i in range(7)] + [("good", 0, "normal")] * 3 + [("mixed", None, "normal"), ("mixed", 1, None)]
    got = {r.g: r for r in calibration.selective_metrics(spark.createDataFrame(rows, "g string, target int, decision string"), ["g"]).collect()}
    known = [r for r in rows if r[1] is not None and r[2] is not None]
    for g, r in got.items():
        own = [(t, d) for h, t, d in known if h == g]
        auto = [(t, d) for t, d in own if d != "review"]
        wrong = sum((t, d) in ((0, "anomalous"), (1, "normal")) for t, d in auto)
        assert r.n_rows == len(own) and r.auto_coverage == pytest.approx(len(auto) / len(own))
        assert r.selective_risk == (pytest.approx(wrong / len(auto)) if auto else None)
        missed = [d == "normal" for t, d in own if t == 1]
        assert r.anomaly_miss_rate == (pytest.approx(sum(missed) / len(missed)) if missed else None)


def test_higher_quantile_against_sorting(spark):
    rng = random.Random(5)
    groups = {"one": [4.5], "two": [-1.0, 7.0], "ties": [2.0] * 9 + [3.0], "many": [rng.gauss(0, 10) for _ in range(137)]}
    df = spark.createDataFrame([(k, v) for k, values in groups.items() for v in values] + [("many", None), ("many", math.nan), ("none", None)], "k string, v double").repartition(3)
    for q in (0.0, 0.37, 0.9, 1.0):
        want = [(k, sorted(v)[math.ceil(q * (len(v) - 1))], len(v)) for k, v in sorted(groups.items())]
        assert rows(calibration.higher_quantile(df, ["k"], "v", q), "k") == want


def test_a_bracket_that_misses_is_widened(spark, monkeypatch):
    """An approximation this coarse is off by far more than the bracket is wide."""
    monkeypatch.setattr(calibration, "ACCURACY", 2)
    monkeypatch.setattr(calibration, "BRACKET", 0.0)
    df = spark.range(0, 5_000, 1, 7).select(F.lit("g").alias("k"), F.pmod(F.col("id") * 37, F.lit(5_000)).cast("double").alias("v"))
    for q in (0.123, 0.777):
        assert calibration.higher_quantile(df, ["k"], "v", q).first().threshold == math.ceil(q * 4_999)
        assert calibration.higher_quantile(df, [], "v", q).first().threshold == math.ceil(q * 4_999)


def test_higher_quantile_in_a_large_group_with_ties(spark):
    df = spark.range(0, 60_000, 1, 6).select(F.lit("g").alias("k"), F.pmod(F.xxhash64("id"), F.lit(501)).cast("double").alias("v"))
    ordered = sorted(r[0] for r in df.select("v").collect())
    for q in (0.3, 0.95, 0.999):
        assert calibration.higher_quantile(df, ["k"], "v", q).first().threshold == ordered[math.ceil(q * (len(ordered) - 1))]


def test_threshold_is_strict(spark):
    df = spark.createDataFrame([(3.0, 3.0), (3.1, 3.0)], "s double, t double")
    assert [r[0] for r in df.select(calibration.binary_decision(F.col("s"), F.col("t"))).collect()] == ["normal", "anomalous"]


def test_exact_intervals_meet_their_tails(spark):
    """At an end of the interval the tail has its share; a large sample, too."""
    cases = [(3, 17), (1, 2), (40, 41), (250_000, 1_000_000)]
    df = spark.createDataFrame([*cases, (0, 25), (25, 25), (0, 0), (None, 3), (4, 2)], "k int, n int")
    got = {(r.k, r.n): (r.ci_low, r.ci_high) for r in calibration.clopper_pearson(df, "k", "n", 0.9).collect()}
    for k, n in cases[:3]:
        low, high = got[k, n]
        assert sum(math.comb(n, i) * low**i * (1 - low) ** (n - i) for i in range(k, n + 1)) == pytest.approx(0.05)
        assert sum(math.comb(n, i) * high**i * (1 - high) ** (n - i) for i in range(k + 1)) == pytest.approx(0.05)
    half = 1.6449 * math.sqrt(0.25 * 0.75 / 1e6)
    assert got[250_000, 1_000_000] == pytest.approx((0.25 - half, 0.25 + half), abs=2e-6)
    assert got[0, 25] == (0.0, pytest.approx(1 - 0.05 ** (1 / 25))) and got[25, 25][1] == 1.0
    assert got[0, 0] == got[None, 3] == got[4, 2] == (None, None)


def test_published_intervals(spark):
    # Published intervals of 88 and of 0 in 110.
    published = {(88, 110): (0.7130048664, 0.8702115118), (0, 110): (0.0, 0.0329791940)}
    df = spark.createDataFrame(list(published), "k int, n int")
    for r in calibration.clopper_pearson(df, "k", "n").collect():
        assert (r.ci_low, r.ci_high) == pytest.approx(published[r.k, r.n], abs=1e-9)


def test_perfect_ranking_and_single_class(spark):
    df = spark.createDataFrame([("a", 0, 0.1), ("a", 0, 0.3), ("a", 1, 0.7), ("a", 1, 0.9), ("b", 1, 0.5), ("a", 1, None)], "k string, target int, score double")
    a, b = metrics.ranking_metrics(df, ["k"]).orderBy("k").collect()
    assert (a.auroc, a.average_precision, a.fpr_at_95_tpr) == (1.0, 1.0, 0.0)
    assert (b.auroc, b.average_precision, b.fpr_at_95_tpr) == (None, None, None)


def test_ranking_against_brute_force(spark):
    random.seed(4)
    data = [(random.randint(0, 1), float(random.randint(0, 9))) for _ in range(300)]
    r = metrics.ranking_metrics(spark.createDataFrame(data, "target int, score double"), []).first()
    pos, neg = [s for t, s in data if t], [s for t, s in data if not t]
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    assert r.auroc == pytest.approx(wins / len(pos) / len(neg))


def test_operating_metrics_are_zero_without_denominator(spark):
    r = metrics.operating_metrics(spark.createDataFrame([(0, 0), (None, 1)], "target int, predicted int"), []).first()
    assert (r.tn, r.precision, r.recall, r.f1, r.normal_fpr) == (1, 0.0, 0.0, 0.0, 0.0)


@pytest.mark.parametrize(("a", "b", "expected"), [([1, 2, 3], [3, 2, 1], -1.0), ([1, 1, 1], [2, 2, 2], 1.0), ([1, 1, 1], [1, 2, 3], 0.0)])
def test_spearman(spark, a, b, expected):
    df = spark.createDataFrame([(float(x), float(y)) for x, y in zip(a, b, strict=True)], "a double, b double")
    assert metrics.spearman(df, [], "a", "b").first().spearman == pytest.approx(expected)


def test_empty_tables(spark):
    cal = spark.createDataFrame([], "g string, score double")
    assert calibration.conformal_p(cal, cal, ["g"]).count() == 0
    assert calibration.higher_quantile(cal, ["g"], "score", 0.5).count() == 0
    assert metrics.ranking_metrics(spark.createDataFrame([], "k string, target int, score double"), ["k"]).count() == 0
