import numpy as np
from pyspark.sql import functions as F

from latticework.operators import analysis


def series(spark, values, group=0):
    return spark.createDataFrame([(group, i, float(v)) for i, v in enumerate(values)], "interaction_id int, bin int, n double")


def test_smoothing_keeps_cubics_and_short_series(spark):
    x = np.arange(20)
    y = 0.1 * x**3 - x**2 + 3
    got = [r.smooth for r in analysis.savgol(series(spark, y), 9, 3).orderBy("bin").collect()]
    assert np.allclose(got, y)
    assert [r.smooth for r in analysis.savgol(series(spark, [1, 2, 3]), 9, 3).orderBy("bin").collect()] == [1, 2, 3]


def test_smoothing_equals_local_fits(spark):
    y = np.random.default_rng(0).normal(size=30)
    got = [r.smooth for r in analysis.savgol(series(spark, y), 7, 3).orderBy("bin").collect()]
    for k in range(30):
        first = min(max(k - 3, 0), 23)
        fit = np.polyfit(np.arange(first, first + 7), y[first : first + 7], 3)
        assert abs(np.polyval(fit, k) - got[k]) < 1e-8


def test_peaks_plateaus_and_valleys(spark):
    s = series(spark, [0, 2, 1, 3, 3, 3, 0, 5, 4])
    peaks = analysis.peaks(s, "n")
    assert sorted(r.peak for r in peaks.collect()) == [1, 4, 7]
    assert sorted(r.valley for r in analysis.valleys(peaks).collect()) == [2.5, 5.5]


def test_coverage_loses_least(spark):
    h, ref = np.array([5.0, 1.0, 4.0, 9.0]), np.array([2.0, 1.0, 1.0, 3.0])
    rows = spark.createDataFrame([(0, i, a, b) for i, (a, b) in enumerate(zip(h.tolist(), ref.tolist(), strict=True))], "interaction_id int, bin int, n double, ref double")

    def loss(x):
        d = h - x * ref
        return np.where(d > 0, d, -10 * d).sum()

    got = analysis.coverage(rows).first()
    assert loss(got.scale) <= min(loss(x) for x in np.linspace(0, 6, 601)) + 1e-9
    assert abs(got.covered - np.minimum(h, got.scale * ref).sum()) < 1e-12


def test_histogram_edges(spark):
    pairs = spark.createDataFrame([(0, r) for r in (0.0, 0.5, 1.0, 3.999, 4.0, 4.001)], "interaction_id int, r double")
    got = {r.bin: r.n for r in analysis.pair_histogram(pairs, 4.0, 1.0).collect()}
    assert got == {0: 1, 1: 1, 3: 2}
    assert analysis.bin_width(4.0, 8) == 0.5 and analysis.bin_width(1.0, 0.3) == 0.25


def test_wide_peaks_only(spark):
    s = series(spark, [0, 9, 0, 0, 1, 4, 6, 4, 1, 0])
    got = analysis.peaks_by_width(s, 2.0, value="n").collect()
    assert [r.peak for r in got] == [6] and got[0].width > 2


def test_element_volumes_shrug_off_outliers(spark):
    r = np.random.default_rng(1)
    rows = []
    for _ in range(60):
        a, b = r.integers(1, 6, 2)
        rows.append((int(a), int(b), float(10 * a + 20 * b + r.normal() * 0.01)))
    rows.append((1, 1, 900.0))
    df = spark.createDataFrame(rows, "n_1 int, n_2 int, volume double")
    got = {x.z: x.volume for x in analysis.element_volumes(df, [1, 2]).collect()}
    assert abs(got[1] - 10) < 0.5 and abs(got[2] - 20) < 0.5


def test_closest_value_ties_go_low(spark):
    v = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 9.0)], "g string, v double")
    t = spark.createDataFrame([("a", 2.0), ("b", 0.0)], "g string, t double")
    assert {r.g: r.closest for r in analysis.closest(v, t, "g", "v", "t").collect()} == {"a": 1.0, "b": 9.0}


def test_density_is_logarithmic(spark):
    rows = spark.createDataFrame([(0.1, 0.1)] * 10 + [(5.0, 5.0)], "x double, y double")
    got = {(r.bx, r.by): round(r.log_density, 9) for r in analysis.density_2d(rows, "x", "y", 1.0).collect()}
    assert got == {(0, 0): 1.0, (5, 5): 0.0}
    assert rows.select(F.lit(1)).count() == 11


def test_coverage_scores_what_lies_below(spark):
    rows = spark.createDataFrame([(1, 0, 120, 100.0), (1, 1, 9, 9.0)], "interaction_id int, bin int, n int, ref double")
    got = analysis.coverage(rows).first()
    assert (got.scale, got.score, got.covered) == (1.0, 109.0, 109.0)


def test_wide_peaks_have_flat_tops(spark):
    rows = [(1, k, float(v)) for k, v in enumerate([0, 1, 3, 3, 3, 1, 0, 2, 0])]
    found = analysis.peaks_by_width(spark.createDataFrame(rows, "interaction_id int, bin int, density double"), 0.5).collect()
    assert {r.peak: r.width for r in found} == {3: 3.5, 7: 1.0}


def test_robust_volumes_pass_over_outliers(spark):
    """Two systems at once; an outlier in ten rows; a species that one system lacks; a null group."""
    r = np.random.default_rng(0)
    rows = []
    for g, volumes in (("a", (10.0, 25.0, 0.0)), (None, (4.0, 9.0, 16.0))):
        for k in range(200):
            n = [int(x) for x in r.integers(0, 5, 3)]
            if g == "a":
                n[2] = 0
            y = sum(v * c for v, c in zip(volumes, n, strict=True)) + float(r.normal() * 0.01)
            rows.append((g, *n, y + 500.0 if k % 10 == 0 else y))
    rows.append(("a", 1, 1, 0, None))
    df = spark.createDataFrame(rows, "g string, n_1 int, n_2 int, n_3 int, volume double")
    found = {(r.g, r.z): r for r in analysis.robust_volumes(df, [1, 2, 3], by=("g",), rounds=25).collect()}
    for g, volumes in (("a", (10.0, 25.0, 0.0)), (None, (4.0, 9.0, 16.0))):
        for z, v in zip((1, 2, 3), volumes, strict=True):
            assert abs(found[g, z].volume - v) < 0.1
    both = analysis.robust_volumes(df.where("g = 'a'").drop("g"), [1, 2, 3], rounds=3)
    assert both.columns == ["z", "volume", "scale"] and both.count() == 3
