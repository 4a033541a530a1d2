import numpy as np
import pytest
from pyspark.sql import functions as F

from latticework.operators import basis as dims, fit, tables
from latticework.operators.basis import Basis, knot_points, knot_sequence, spline_pieces
from latticework.operators.features import feature_table

from .fixtures import make


def layout(pair_intervals, trio_intervals):
    pairs = {p: (0.0, float(pair_intervals), pair_intervals) for p in ((1, 1), (1, 2), (2, 2))}
    a, b = trio_intervals
    trios = {(i, j, k): ((0.0,) * 3, (float(a), float(a), float(b)), (a, a, b)) for i in (1, 2) for j, k in ((1, 1), (1, 2), (2, 2))}
    return Basis((1, 2), pairs, trios, degree=3)


@pytest.mark.parametrize("periodic", [False, True])
def test_dropping_columns_equals_featurising_again(spark, periodic):
    r = np.random.default_rng(0)
    cell = [[6.3, 0, 0], [0, 6.3, 0], [0, 0, 6.3]] if periodic else None
    configs, atoms = make(spark, "c", [1, 2, 1, 2, 1], r.uniform(0, 6, (5, 3)).tolist(), cell, periodic)
    big, small = layout(9, (7, 8)), layout(6, (6, 7))
    dropped = set(big.beyond(dict.fromkeys([(1, 1), (1, 2), (2, 2)], 6), {x.species: (6, 6, 7) for x in big.of_degree(3)}))

    def rows(basis, without=()):
        out = {}
        names = {}
        for x in basis.interactions:
            cells = np.argwhere(x.weights > 0).tolist() if x.degree == 3 else range(x.size)
            for k, c in enumerate(cells):
                names[x.offset + k] = (x.species, tuple(c) if x.degree == 3 else c)
        for f in feature_table(configs, atoms, basis, forces=False).collect():
            if f.feature_idx not in without and abs(f.value) > 1e-12:
                out[names[f.feature_idx]] = round(f.value, 9)
        return out

    assert rows(big, dropped) == rows(small)


def test_flat_coefficients_find_their_interaction(spark):
    basis = layout(6, (6, 7))
    flat = spark.createDataFrame([(k, float(k)) for k in range(basis.n_features)], "feature_idx int, coefficient double")
    got = fit.by_interaction(flat, basis.interactions_table(spark)).collect()
    assert len(got) == basis.n_features
    assert all(basis.interactions[r.interaction_id].offset + r.basis_idx == r.feature_idx for r in got)


def test_curves_are_fitted_together(spark):
    knots = knot_sequence(knot_points("linear", 1.0, 5.0, 6))
    c = {"a": np.arange(9.0), "b": np.cos(np.arange(9.0))}

    def value(curve, x):
        return sum(c[curve][i] * sum(q * (x - lo) ** p for p, q in enumerate(k)) for i, _, lo, hi, *k in spline_pieces(knots) if lo < x <= hi)

    rows = [(n, float(x), float(value(n, x))) for n in c for x in np.linspace(1.01, 5, 60)] + [("a", 9.0, 7.0)]
    got = {(r.curve, r.basis_idx): r.coefficient for r in fit.fit_curves(spark.createDataFrame(rows, "curve string, x double, y double"), knots).collect()}
    assert all(abs(got[n, k] - c[n][k]) < 1e-6 for n in c for k in range(9))


def test_lists_harvest_and_order(spark):
    frames = [{"symbols": ["Au", "Au"], "positions": [(0, 0, 0), (1, 0, 0)], "energy": 9.0, "forces": [(1, 0, 0), (-1, 0, 0)]},
              {"symbols": ["Au"] * 3, "positions": [(0, 0, 0)] * 3}]
    configs, atoms = tables.from_lists(spark, frames, "list", energies=[1.1, 2.2])
    rows = configs.orderBy("seq").collect()
    assert [(r.config_id, r.energy, r["size"]) for r in rows] == [("list_0", 1.1, 2), ("list_1", 2.2, 3)]
    assert sorted((r.z, r.fx) for r in atoms.where("config_id = 'list_0'").collect()) == [(79, -1.0), (79, 1.0)]
    attached = spark.createDataFrame([("list_1", -3.0)], "config_id string, energy double")
    assert [r.energy for r in tables.harvest(configs, attached).orderBy("seq").collect()] == [1.1, -3.0]
    feats = spark.createDataFrame([("list_1", "energy", None, 0, 1.0), ("list_0", "fx", 1, 0, 2.0), ("list_0", "energy", None, 0, 3.0)],
                                  "config_id string, component string, atom_idx int, feature_idx int, value double")
    assert [r.value for r in tables.in_order(feats, configs).collect()] == [3.0, 2.0, 1.0]


def test_ingest_samples_each_file_by_itself(spark):
    rows = [(p, f"{p}{i}", float(i * 10), 1, "d", 2.0) for p, n in (("a", 20), ("b", 4)) for i in range(n)] + [("a", "empty", 0.0, 0, "d", 2.0)]
    c = spark.createDataFrame(rows, "prefix string, config_id string, energy double, size int, directory string, volume double")
    counts = {r.prefix: r["count"] for r in tables.ingest(c, max_samples=0.5, min_diff=1.0).groupBy("prefix").count().collect()}
    assert counts == {"a": 10, "b": 2}
    assert tables.ingest(c, max_samples=0.5).count() == 24
    p = spark.createDataFrame([("d", 1.0)], "directory string, pressure double")
    assert tables.ingest(c, p).agg({"energy": "min"}).first()[0] == -2.0


def test_best_rows_and_held_share(spark):
    s = spark.createDataFrame([(1, 0, 0.5), (1, 1, 0.2), (2, 0, 0.1)], "g int, model int, rmse double")
    assert [tuple(r) for r in tables.best_rows(s, ["g"], "rmse").collect()] == [(2, 0, 0.1), (1, 1, 0.2)]
    rows = spark.range(4000).withColumnRenamed("id", "config_id")
    assert 700 < tables.holdout_fraction(rows, 0.2).where("held").count() < 900


def test_basis_from_spacing_and_its_lower_cutoffs():
    basis = dims.basis_from_spacing((2, 1), (0.0, 6.0, 0.5), (0.0, 3.0, 0.5))
    assert basis.species == (1, 2) and basis.degree == 3
    far = basis.of_degree(3)[0].knots[2]
    assert (far[0], far[-1], len(far)) == (0.0, 6.0, 12 + 7)
    cuts = dims.lower_cutoffs(basis)
    assert cuts["rmax_2b"] == [0.5 * k for k in range(1, 13)] and cuts["rmax_3b"] == [0.5 * k for k in range(1, 7)]
    for bad in (((1,), (0.0, 6.0, 0.7)), ((1,), (0.0, 6.0, 0.5), (0.5, 3.0, 1.0)), ((1,), (0.0, 6.0, 0.5), None, 1)):
        with pytest.raises(ValueError):
            dims.basis_from_spacing(*bad)


def test_hashes_of_several_numbers_and_symbols(spark):
    from latticework.functions import chem

    df = spark.createDataFrame([([26, 6, 8],), ([1, 1, 1],), ([8, 92, 3],)], "v array<int>")
    got = df.select("v", chem.unszudzik_array(chem.szudzik_array(F.col("v")), 3).alias("w")).collect()
    assert all(list(r.v) == list(r.w) for r in got)
    told = spark.createDataFrame([(["Fe", "C"],)], "s array<string>").select(chem.symbols_hash(F.col("s")).alias("h"))
    assert told.select(chem.hash_symbols(F.col("h")).alias("s")).first().s == ["Fe", "C"]
