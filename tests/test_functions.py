"""Hand-computed cases of column functions, and helpers against slow plain versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarmac.functions import clean, features, stats, text
from tarmac.operators import neighbours
from tarmac.operators.cluster import cut, euclidean, linkage, silhouette_sample
from tarmac.operators.series import dtw


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v"))).first()[0]


@pytest.mark.parametrize(("condition", "rules", "exact"), [("Heavy Snow", "Heavy_Storms", "Snow"), ("Drizzle and Fog", "Light_Rain", "Fog_Haze"), ("Light Freezing Drizzle", "Light_Rain", "Ice_Sleet_Mix"), ("Fair / Windy", "Clear", "Clear"), ("Smoke", "Other", "Other"), (None, None, None)])
def test_weather_groups(spark, condition, rules, exact):
    assert one(spark, condition, features.weather_group) == rules
    assert one(spark, condition, lambda c: features.weather_group(c, "exact")) == exact


def test_wind_group(spark):
    got = [one(spark, v, features.wind_group) for v in ("CALM", "VAR", "NNW", "Unknown", None)]
    assert got == ["Calm", "Variable", "North", "Other", None]


def test_f_to_c(spark):
    assert [one(spark, v, features.f_to_c, "double") for v in (32.0, 50.0, None)] == [0.0, 10.0, None]


def test_bins(spark):
    got = [one(spark, v, lambda c: features.fixed_bin(c, "precipitation"), "double") for v in (0.0, 0.05, 0.06, None)]
    assert got == ["No_Precip", "Light_Precip", "Relevant_Precip", None]


def test_vtest_levels(spark):
    assert [one(spark, v, features.vtest_level, "double") for v in (-4.0, -1.96, 1.96, 4.0)] == ["Muy bajo", "Neutro", "Neutro", "Muy alto"]


def test_parse_ts_takes_the_first_format_that_fits(spark):
    got = [one(spark, v, features.parse_ts) for v in ("2020-01-02 03:04:05", "2020-01-02T03:04:05", "01/02/2020 03:04", "2020-01-02", "no")]
    assert [g and (g.month, g.day) for g in got] == [(1, 2)] * 4 + [None]


def test_clean_text(spark):
    stop = ["on", "at", "to", *text.DOMAIN]
    assert one(spark, "Accident on I-95 at Exit 33. 1 right lane blocked due to crash.", lambda c: text.clean(c, stop)) == "i95 exit33 one right lane blocked crash"
    assert one(spark, None, text.clean) is None
    assert one(spark, "", text.clean) == ""


@pytest.mark.parametrize(("word", "stem"), [("caresses", "caress"), ("ponies", "poni"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("hopping", "hop"), ("relational", "relat"), ("blocked", "block"), ("sky", "sky"), ("happy", "happi"), ("adjustment", "adjust"), ("controll", "control")])
def test_porter(word, stem):
    assert text.porter(word) == stem


def test_relabel_and_casts(spark):
    assert one(spark, "a", lambda c: clean.relabel(c, {"a": "b"})) == "b"
    assert one(spark, "z", lambda c: clean.relabel(c, {"a": "b"})) == "z"
    assert one(spark, "1e3", clean.safe_numeric) == 1000.0
    assert one(spark, "x", clean.safe_numeric) is None


def test_gates(spark):
    df = spark.createDataFrame([(1, None)], "a int, b int")
    with pytest.raises(ValueError, match="nulls remain"):
        clean.require_no_nulls(df, ["b"])
    with pytest.raises(ValueError, match="1 rows"):
        clean.require(df, F.col("a") > 1, "too small")
    assert clean.require_no_nulls(df, ["a"]) is df


def test_tails():
    assert stats.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert stats.chi2_quantile(0.99, 2) == pytest.approx(9.21034037197618, abs=1e-8)
    assert stats.f_sf(4.0, 3, 20) == pytest.approx(0.02214, abs=2e-4)
    assert stats.t_sf2(2.085963, 20) == pytest.approx(0.05, abs=1e-6)
    assert stats.normal_sf2(1.959963984540054) == pytest.approx(0.05, abs=1e-9)


def test_hypergeometric_v_against_sums():
    k, n, good, total = 7, 20, 30, 100
    pmf = lambda i: math.comb(good, i) * math.comb(total - good, n - i) / math.comb(total, n)
    from statistics import NormalDist

    assert stats.hypergeometric_v(k, n, good, total) == pytest.approx(-NormalDist().inv_cdf(sum(map(pmf, range(8, 21))) + pmf(7) / 2), abs=1e-9)
    assert stats.hypergeometric_v(2, n, good, total) < -1.9


def test_dtw():
    assert dtw(np.array([0, 1, 2]), np.array([0, 2])) == 1
    assert dtw(np.array([1.0, 2.0]), np.array([1.0, 2.0])) == 0


def test_gower():
    d = neighbours.gower(np.array([[2.0]]), np.array([[7.0]]), np.array([["a", "x"]], object), np.array([["a", "y"]], object), [10.0])
    assert d[0, 0] == pytest.approx(0.5)
    d = neighbours.gower(np.array([[np.nan]]), np.array([[7.0]]), np.array([["a"]], object), np.array([["b"]], object), [10.0])
    assert d[0, 0] == 1.0


def slow_ward(x, k):
    groups = [[i] for i in range(len(x))]
    while len(groups) > k:
        cost = lambda a, b: len(a) * len(b) / (len(a) + len(b)) * ((x[a].mean(0) - x[b].mean(0)) ** 2).sum()
        _, i, j = min((cost(groups[i], groups[j]), i, j) for i in range(len(groups)) for j in range(i))
        groups[j] += groups.pop(i)
    return {frozenset(g) for g in groups}


def test_ward_against_slow_version():
    x = np.random.default_rng(1).normal(size=(40, 3))
    for k in (2, 5, 9):
        labels = cut(linkage(euclidean(x)), 40, k)
        assert {frozenset(np.flatnonzero(labels == g)) for g in range(k)} == slow_ward(x, k)
        assert sorted(np.bincount(labels), reverse=True) == list(np.bincount(labels))


def test_silhouette_against_slow_version():
    x = np.random.default_rng(2).normal(size=(30, 2))
    y = np.arange(30) % 3
    d = euclidean(x)
    slow = []
    for i in range(30):
        a = np.mean([d[i, j] for j in range(30) if y[j] == y[i] and j != i])
        b = min(np.mean([d[i, j] for j in range(30) if y[j] == g]) for g in range(3) if g != y[i])
        slow.append((b - a) / max(a, b))
    assert np.allclose(silhouette_sample(d, y), slow)
