import numpy as np
import pytest

from latticework.operators import fit, repair
from latticework.operators.basis import Basis, knot_sequence


def problem(spark, seed=0, n=40, d=5):
    r = np.random.default_rng(seed)
    x, c = r.normal(size=(n, d)), r.normal(size=d)
    x[:, 0] = r.integers(1, 4, n)
    rows = [(i, "energy", None, k, float(x[i, k])) for i in range(n) for k in range(d)]
    rows += [(i, "fx", 0, k, float(x[i, k] * 2 + k)) for i in range(n) for k in range(d)]
    feats = spark.createDataFrame(rows, "config_id int, component string, atom_idx int, feature_idx int, value double")
    y = [(i, "energy", None, float(x[i] @ c)) for i in range(n)]
    y += [(i, "fx", 0, float((x[i] * 2 + np.arange(d)) @ c)) for i in range(n)]
    return feats, spark.createDataFrame(y, "config_id int, component string, atom_idx int, y double"), x, c


def fitted(feats, y, kappa=0.5):
    w = fit.kind_weights(fit.moments(y))
    g = fit.combine(fit.gram(feats), w, kappa, ("i", "j"))
    o = fit.combine(fit.ordinate(feats, y), w, kappa, ("i",))
    from pyspark.sql import functions as F

    return fit.solve(g.withColumn("model", F.lit(0)), o.withColumn("model", F.lit(0)))


def test_known_coefficients_come_back(spark):
    feats, y, _, c = problem(spark)
    got = {r.feature_idx: r.coefficient for r in fitted(feats, y).collect()}
    assert np.allclose([got[k] for k in range(5)], c)
    assert all(r.covered for r in fitted(feats, y).collect())


def test_gram_forms_agree(spark):

    feats, _, _, _ = problem(spark)
    a = {(r.kind, r.i, r.j): r.value for r in fit.gram(feats).collect()}
    b = {(r.kind, r.i, r.j): r.value for r in fit.gram_blocks(feats, 5).collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_frozen_columns_are_exact(spark):
    feats, y, x, c = problem(spark)
    frozen = spark.createDataFrame([(0, 10.0), (2, 4.0), (4, 0.0)], "feature_idx int, coefficient double")
    fx, fy = fit.freeze(feats, y, frozen)
    got = {r.feature_idx: r.coefficient for r in fit.unfreeze(fitted(fx, fy), frozen).collect()}
    assert (got[0], got[2], got[4]) == (10.0, 4.0, 0.0) and set(got) == set(range(5))


def test_loss_is_least_at_the_fit(spark):
    feats, y, x, c = problem(spark, n=12)
    r = np.random.default_rng(5)
    noisy = [(row.config_id, row.component, row.atom_idx, row.y + float(r.normal())) for row in y.collect()]
    y = spark.createDataFrame(noisy, y.schema)
    got = np.array([row.coefficient for row in fitted(feats, y, 0.3).orderBy("feature_idx").collect()])
    e = np.array([v for _, k, _, v in noisy if k == "energy"])
    f = np.array([v for _, k, _, v in noisy if k == "fx"])
    xf = x * 2 + np.arange(5)

    def loss(c):
        return 0.3 / len(e) / e.var() * ((x @ c - e) ** 2).sum() + 0.7 / len(f) / f.var() * ((xf @ c - f) ** 2).sum()

    for k in range(5):
        for d in (1e-3, -1e-3):
            moved = got.copy()
            moved[k] += d
            assert loss(moved) > loss(got)


def test_normalised_rows_and_sample_weights(spark):
    feats, y, x, _ = problem(spark, n=3)
    w = spark.createDataFrame([(1, 3.0)], "config_id int, weight double")
    nx, ny = fit.normalised(feats, y, 1, w)
    got = {(r.config_id, r.component, r.feature_idx): r.value for r in nx.collect()}
    assert abs(got[0, "energy", 1] - x[0, 1] / x[0, 0]) < 1e-12 and abs(got[1, "energy", 1] - 3 * x[1, 1] / x[1, 0]) < 1e-12
    assert abs(got[1, "fx", 1] - 3 * (2 * x[1, 1] + 1)) < 1e-12 and ny.count() == 6


def test_constant_energies_weigh_one(spark):
    m = spark.createDataFrame([("energy", 4, 1.0, 0.0), ("force", 16, 0.0, 2.0)], "kind string, n long, mean double, std double")
    w = fit.kind_weights(m).first()
    assert (w.w_e, w.w_f) == (1.0, 0.25)
    with pytest.raises(ValueError):
        fit.legacy_weights(m, 1.5)


def test_cross_validation_equals_fits_without_the_fold(spark):
    from pyspark.sql import functions as F

    feats, y, _, _ = problem(spark, n=30)
    r = np.random.default_rng(9)
    y = spark.createDataFrame([(a.config_id, a.component, a.atom_idx, a.y + float(r.normal())) for a in y.collect()], y.schema)
    e = F.col("component") == "energy"
    feats, y = feats.where(e).withColumn("fold", F.col("config_id") % 3), y.where(e)
    g = fit.gram(feats, by=("fold",)).select("fold", "i", "j", "value")
    o = fit.ordinate(feats, y, by=("fold",)).select("fold", "i", "value")
    grid = spark.createDataFrame([(0, k) for k in range(5)] + [(1, k) for k in (0, 2, 3)], "model int, feature_idx int")
    got = {(a.model, a.fold, a.feature_idx): a.coefficient for a in fit.cross_validate(g, o, grid).collect()}
    xs = np.zeros((30, 5))
    for a in feats.collect():
        xs[a.config_id, a.feature_idx] = a.value
    ys = np.zeros(30)
    for a in y.collect():
        ys[a.config_id] = a.y
    for model, kept in ((0, list(range(5))), (1, [0, 2, 3])):
        for fold in range(3):
            rest = np.arange(30) % 3 != fold
            want = np.linalg.lstsq(xs[rest][:, kept], ys[rest], rcond=None)[0]
            assert np.allclose([got[model, fold, k] for k in kept], want)


def test_errors_from_sums_equal_errors_of_predictions(spark):
    from pyspark.sql import functions as F

    feats, y, _, _ = problem(spark, n=30)
    feats, y = feats.withColumn("fold", F.col("config_id") % 3), y.withColumn("fold", F.col("config_id") % 3)
    g, o = fit.gram_blocks(feats, 5, by=("fold",)), fit.ordinate(feats, y, by=("fold",))
    models = spark.createDataFrame([(m, f, k, 0.5 * k + m - f) for m in range(2) for f in range(3) for k in range(5)], "model int, fold int, feature_idx int, coefficient double")
    got = {(r.model, r.held, r.kind, r.part): (r.n, r.rmse) for r in fit.errors_from_sums(g, o, fit.square_sums(y, by=("fold",)), models).collect()}
    rows = {}
    for r in feats.collect():
        rows.setdefault((r.config_id, r.component, r.atom_idx), {})[r.feature_idx] = r.value
    want = {}
    for m in range(2):
        for held in range(3):
            for r in y.collect():
                p = sum(v * (0.5 * k + m - held) for k, v in rows.get((r.config_id, r.component, r.atom_idx), {}).items())
                kind = "energy" if r.component == "energy" else "force"
                want.setdefault((m, held, kind, "valid" if r.fold == held else "train"), []).append((r.y - p) ** 2)
    assert got.keys() == want.keys()
    assert all(got[k][0] == len(v) and abs(got[k][1] - np.sqrt(np.mean(v))) < 1e-9 for k, v in want.items())


def test_repeated_samples_do_not_change_a_curve(spark):
    rows = [("a", 0.1 + 0.2 * k, float(np.sin(k))) for k in range(25)]
    schema = "curve string, x double, y double"
    knots = knot_sequence(np.linspace(0.0, 5.2, 7))
    once = {r.basis_idx: r.coefficient for r in fit.fit_curves(spark.createDataFrame(rows, schema), knots).collect()}
    twice = {r.basis_idx: r.coefficient for r in fit.fit_curves(spark.createDataFrame(rows * 2, schema), knots).collect()}
    assert once.keys() == twice.keys() and all(abs(once[k] - twice[k]) < 1e-6 for k in once)


def test_regulariser_sums(spark):
    basis = Basis((1,), {(1, 1): (1, 5, 2)})
    rows = basis.penalties({"ridge_1b": 4.0, "ridge_2b": 9.0, "curve_2b": 1.0})
    m = np.zeros((max(r for r, _, _ in rows) + 1, basis.n_features))
    for r, c, v in rows:
        m[r, c] += v
    got = np.zeros((6, 6))
    for r in fit.penalty_gram(spark.createDataFrame(rows, "row int, feature_idx int, value double")).collect():
        got[r.i, r.j] = r.value
    assert np.allclose(got, np.triu(m.T @ m))


def test_cores_become_repulsive(spark):
    series = [0.0, 0.0, 0.5, 3.0, -2.0, -1.0, 0.0]
    rows = [(0, 1, k, c) for k, c in enumerate(series)]
    df = spark.createDataFrame(rows, "model int, interaction_id int, basis_idx int, coefficient double")
    got = [r.coefficient for r in repair.harden_cores(df).orderBy("basis_idx").collect()]
    assert got == [24.0, 12.0, 6.0, 3.0, -2.0, -1.0, 0.0]
    short = spark.createDataFrame([(0, 1, k, c) for k, c in enumerate([5.0, 1.0, -1.0, 0.0])], df.schema)
    assert [r.coefficient for r in repair.harden_cores(short, smooth=True).orderBy("basis_idx").collect()] == [5.0, 1.0, 0.0, 0.0]


def test_cores_against_a_walk_along_each_series(spark):
    """Random series, some level, some rising, with ties."""
    r = np.random.default_rng(7)
    series = [r.choice([0.0, 0.001, 1.0, -1.0, 2.5], n) if k % 3 == 0 else np.round(r.normal(size=n), 2) if k % 3 == 1 else np.sort(r.normal(size=n))[::-1 if k % 2 else 1]
              for k, n in enumerate(r.integers(2, 9, 120))]
    rows = [(k, 1, j, float(c)) for k, s in enumerate(series) for j, c in enumerate(s)]
    df = spark.createDataFrame(rows, "model int, interaction_id int, basis_idx int, coefficient double")
    got = {}
    for row in repair.harden_cores(df, hardness=1.5).orderBy("model", "basis_idx").collect():
        got.setdefault(row.model, []).append(row.coefficient)
    changed = 0
    for k, s in enumerate(series):
        want, well = list(map(float, s)), int(np.argmin(s))
        head = np.round(s[: np.argmax(s)], 3)
        if well < np.argmax(s) and head.max() - head.min() < 0.01:
            well = int(np.argmax(s)) + 1
        tops = [round(x, 3) + 1e-6 * j for j, x in enumerate(want[:well])]
        if len(tops) > 1:
            peak = int(np.argmax(tops))
            slopes = [tops[min(j + 1, len(tops) - 1)] - tops[max(j - 1, 0)] for j in range(peak)]
            if all(x >= 0 for x in slopes):
                for j in reversed(range(peak)):
                    want[j] = max(1.5 * abs(want[j + 1]), 0.1)
                    changed += 1
        want[0] = max(want[0], 2.0)
        assert np.allclose(got[k], want)
    assert changed > 50


def test_repulsion_follows_the_parabola(spark):
    models = spark.createDataFrame([(0, 1, k, float(k), k >= 2) for k in range(5)], "model int, interaction_id int, basis_idx int, coefficient double, covered boolean")
    centres = spark.createDataFrame([(1, k, 1.0 + k) for k in range(5)], "interaction_id int, basis_idx int, centre double")
    segments = spark.createDataFrame([(0, 1, 2.0, 3.0, 1.0, 0.0, -0.5, 0.0)], "model int, interaction_id int, t_lo double, t_hi double, c0 double, c1 double, c2 double, c3 double")
    got = [r.coefficient for r in repair.repulsion(models, centres, segments).orderBy("basis_idx").collect()]
    # At 3: value 0.5, slope -1, curvature -1 raised to 2.
    assert got == [0.5 + 2 + 4, 0.5 + 1 + 1, 2.0, 3.0, 4.0]


def test_cross_validation_with_a_penalty_equals_dense_ridge(spark):
    from pyspark.sql import functions as F

    feats, y, x, _ = problem(spark, n=30)
    e = F.col("component") == "energy"
    feats, y = feats.where(e).withColumn("fold", F.col("config_id") % 3), y.where(e)
    g = fit.gram(feats, by=("fold",)).select("fold", "i", "j", "value")
    o = fit.ordinate(feats, y, by=("fold",)).select("fold", "i", "value")
    grid = spark.createDataFrame([(0, k) for k in range(5)], "model int, feature_idx int")
    penalty = spark.createDataFrame([(k, k, 2.0 + k) for k in range(5)], "i int, j int, value double")
    ys = np.array([a.y for a in y.orderBy("config_id").collect()])
    twice = g.unionByName(g.withColumn("value", F.lit(0.0)))
    for sums in (g, twice):
        got = {(a.fold, a.feature_idx): a.coefficient for a in fit.cross_validate(sums, o, grid, penalty).collect()}
        for fold in range(3):
            rest = np.arange(30) % 3 != fold
            want = np.linalg.solve(x[rest].T @ x[rest] + np.diag(2.0 + np.arange(5)), x[rest].T @ ys[rest])
            assert np.allclose([got[fold, k] for k in range(5)], want)
