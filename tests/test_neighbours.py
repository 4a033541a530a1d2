import numpy as np
import pytest

from latticework.operators.basis import Basis
from latticework.operators.features import energy_features_2b, feature_table, force_features_2b, long, wide
from latticework.operators.neighbours import image_offsets, pair_derivatives, pair_distances, periodic_images, replica_factors, triplets

from .fixtures import CUBE, ar3, make, skewed


@pytest.mark.parametrize("cells", [False, True, None])
def test_triangle_distances(spark, cells):
    configs, atoms = ar3(spark)
    basis = Basis((18,), {(18, 18): (0.5, 6.0, 10)})
    found = pair_distances(configs, atoms, basis, cells=cells).collect()
    assert sorted(r.r for r in found) == [3, 3, 4, 4, 5, 5]


def test_replicas_and_images(spark):
    configs, atoms = skewed(spark, 79, 79)
    for r_cut, factors, images in ((1e-6, [1, 1, 1], 54), (2.0, [3, 2, 1], 210)):
        row = replica_factors(configs, r_cut).first()
        assert [row.na, row.nb, row.nc] == factors
        made = periodic_images(configs, atoms, r_cut)
        assert made.count() == images and made.where("is_real").count() == 2
    first = image_offsets(configs, 2.0, nearest_first=True).where("rank = 1").first()
    assert (first.ia, first.ib, first.ic) == (0, 0, 0)


@pytest.mark.parametrize("cells", [False, True, None])
def test_periodic_pairs_of_one_species(spark, cells):
    configs, atoms = skewed(spark, 79, 79)
    basis = Basis((79,), {(79, 79): (0.5, 3.0, 10)})
    assert pair_distances(configs, atoms, basis, r_cut=4.0, cells=cells).count() == 58
    derived = pair_derivatives(configs, atoms, basis, r_cut=4.0, prune=3.0, cells=cells)
    assert derived.select("pair").distinct().count() == 114


def test_periodic_pairs_of_two_species(spark):
    configs, atoms = skewed(spark, 10, 54)
    basis = Basis((10, 54), {(10, 10): (0.5, 3.0, 10), (10, 54): (0.6, 4.0, 10), (54, 54): (0.7, 5.0, 10)})
    ids = {x.number: x.species for x in basis.of_degree(2)}
    found = pair_distances(configs, atoms, basis, r_cut=4.0).groupBy("interaction_id").count().collect()
    assert {ids[r["interaction_id"]]: r["count"] for r in found} == {(10, 10): 14, (10, 54): 74, (54, 54): 58}
    derived = pair_derivatives(configs, atoms, basis, r_cut=4.0, prune=5.0).select("interaction_id", "pair").distinct()
    counted = {ids[r["interaction_id"]]: r["count"] for r in derived.groupBy("interaction_id").count().collect()}
    assert counted == {(10, 10): 28, (10, 54): 146, (54, 54): 116}


def test_forces_cancel_and_match_finite_differences(spark):
    configs, atoms = skewed(spark, 10, 54)
    basis = Basis((10, 54), {(10, 10): (0.3, 3.0, 8), (10, 54): (0.3, 3.0, 8), (54, 54): (0.3, 3.0, 8)}, trail={2: 0, 3: 3})
    force = force_features_2b(pair_derivatives(configs, atoms, basis), basis)
    total = force.groupBy("component", "feature_idx").sum("value").collect()
    assert max(abs(r["sum(value)"]) for r in total) < 1e-9
    step = 1e-5

    def energy(shift):
        from pyspark.sql import functions as F

        moved = atoms.withColumn("px", F.when(F.col("atom_idx") == 1, F.col("px") + shift).otherwise(F.col("px")))
        return {r.feature_idx: r.value for r in energy_features_2b(pair_distances(configs, moved, basis), basis).collect()}

    up, down = energy(step), energy(-step)
    got = {r.feature_idx: r.value for r in force.where("component = 'fx' and atom_idx = 1").collect()}
    for k in set(up) | set(down):
        # The cell's images move along: each pair counts twice in the energy and on both ends in the force.
        assert abs(got.get(k, 0.0) - (down.get(k, 0.0) - up.get(k, 0.0)) / (2 * step)) < 1e-4


def test_three_body_features_do_not_depend_on_atom_order(spark):
    places = [(0, 0, 0), (1.5, 0, 0), (0, 2, 0), (0.4, 0.5, 1.7)]
    species = [6, 78, 6, 78]
    basis = Basis((6, 78), {}, {(a, b, c): (0.5, 6.0, 5) for a in (6, 78) for b, c in ((6, 6), (6, 78), (78, 78))}, degree=3)
    seen = []
    for order in ((0, 1, 2, 3), (3, 1, 0, 2)):
        configs, atoms = make(spark, "m", [species[k] for k in order], [places[k] for k in order], CUBE, True)
        rows = feature_table(configs, atoms, basis, forces=False).collect()
        seen.append({(r.component, r.feature_idx): round(r.value, 9) for r in rows})
    assert seen[0] == seen[1] and len(seen[0]) > 10
    assert triplets(*make(spark, "m", species, places), basis).count() == 12


def test_wide_and_long_forms_round_trip(spark):
    configs, atoms = ar3(spark)
    basis = Basis((18,), {(18, 18): (0.5, 6.0, 15)})
    features = feature_table(configs, atoms, basis)
    rows = wide(features, basis.n_features)
    assert rows.count() == 10 and basis.n_features == 19
    key = ["config_id", "component", "atom_idx", "feature_idx", "value"]
    assert sorted(map(str, long(rows).select(*key).collect())) == sorted(map(str, features.where("value <> 0").select(*key).collect()))


def test_unknown_species_drop_the_whole_configuration(spark):
    configs, atoms = make(spark, "x", [18, 1], [(0, 0, 0), (3, 0, 0)])
    assert feature_table(configs, atoms, Basis((18,))).count() == 0


def test_only_large_configurations_get_cells(spark, monkeypatch):
    """A table in which one configuration holds most atoms: equal pairs, and no key with many rows."""
    from pyspark.sql import functions as F

    from latticework.operators import neighbours

    monkeypatch.setattr(neighbours, "CELL_ATOMS", 100)
    r = np.random.default_rng(0)
    rows = [(1, k, 18, *map(float, r.uniform(0, 30, 3))) for k in range(1500)]
    rows += [(c, k, 18, *map(float, r.uniform(-3, 3, 3))) for c in range(2, 30) for k in range(8)]
    atoms = spark.createDataFrame(rows, "config_id int, atom_idx int, z int, px double, py double, pz double")
    basis = Basis((18,), {(18, 18): (0.5, 3.0, 10)})

    def pairs(cells):
        return sorted((r.config_id, r.i, r.j, round(r.r, 9)) for r in pair_distances(None, atoms, basis, cells=cells).collect())

    want = pairs(False)
    assert pairs(None) == want and len(want) > 2000
    left, right = neighbours.celled(atoms, atoms, 3.0, neighbours.large_configs(atoms))
    assert left.where("config_id > 1").count() == right.where("config_id > 1").count() == 28 * 8
    assert left.where("config_id = 1").count() == 27 * 1500
    by_key = [df.groupBy("config_id", *neighbours.CELL).count().agg(F.max("count")).first()[0] for df in (left, right)]
    assert max(by_key) < 150  # of 1,500
