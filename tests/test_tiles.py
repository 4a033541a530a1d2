import numpy as np
import pytest
from pyspark.sql import functions as F

from latticework.operators import fit, tiles


def long_features(spark, n=40, d=23, seed=0):
    """Sparse rows of both kinds, a few features a row."""
    r = np.random.default_rng(seed)
    rows = []
    for c in range(n):
        for component, atom in (("energy", None), ("fx", 0), ("fz", 1)):
            for k in sorted(r.choice(d - 2, size=6, replace=False)):  # the last two features never occur
                rows.append((c, component, atom, int(k), float(r.normal())))
    return spark.createDataFrame(rows, "config_id int, component string, atom_idx int, feature_idx int, value double")


def targets(spark, n=40):
    rows = [(c, comp, atom, float(np.sin(c) + (atom or 0))) for c in range(n) for comp, atom in (("energy", None), ("fx", 0), ("fz", 1))]
    return spark.createDataFrame(rows, "config_id int, component string, atom_idx int, y double")


@pytest.mark.parametrize("held", [1, 256])
def test_tiles_equal_the_long_gram(spark, monkeypatch, held):
    monkeypatch.setattr(tiles, "HELD_TILES", held)
    x = long_features(spark)
    want = {(r.kind, r.i, r.j): r.value for r in fit.gram(x).collect()}
    made = tiles.gram_tiles(x, side=4)
    got = {(r.kind, r.i, r.j): r.value for r in tiles.to_long(made, ("kind",), side=4).collect()}
    assert want.keys() == got.keys() and all(abs(want[k] - got[k]) < 1e-9 for k in want)
    assert made.groupBy("kind", "bi", "bj").count().where("count > 1").isEmpty() and made.where("bi > bj").isEmpty()
    again = tiles.to_tiles(fit.gram(x), ("kind",), side=4)
    back = {(r.kind, r.i, r.j): r.value for r in tiles.to_long(again, ("kind",), side=4).collect()}
    assert all(abs(want[k] - back[k]) < 1e-9 for k in want)


def test_conjugate_gradients_equal_the_dense_solve(spark):
    """Two models at once; features that never occur are not covered."""
    x, y = long_features(spark), targets(spark)
    models = spark.createDataFrame([(0, 0.5, 0.1), (1, 0.05, 2.0)], "model int, w_e double, w_f double")
    ridge = spark.createDataFrame([(m, k, k, 0.3 + m) for m in (0, 1) for k in range(20)], "model int, i int, j int, value double")
    factor = F.when(F.col("kind") == "energy", F.col("w_e")).otherwise(F.col("w_f"))
    made = tiles.gram_tiles(x, side=8).join(F.broadcast(models))
    whole = tiles.weighted(made, factor, ("model",), tiles.to_tiles(ridge, ("model",), side=8))
    o = fit.ordinate(x, y).join(F.broadcast(models)).select("model", "i", (F.col("value") * factor).alias("value"))
    got = {(r.model, r.feature_idx): r for r in tiles.solve_tiles(whole, o, side=8).collect()}
    g = fit.gram(x).join(F.broadcast(models)).select("model", "i", "j", (F.col("value") * factor).alias("value"))
    want = fit.solve(g.unionByName(ridge), o.groupBy("model", "i").agg(F.sum("value").alias("value"))).collect()
    assert len(want) >= 40
    for r in want:
        assert abs(got[r.model, r.feature_idx].coefficient - r.coefficient) < 1e-8
        assert got[r.model, r.feature_idx].covered == r.covered
    assert not got[0, 22].covered and got[0, 22].coefficient == 0


def test_nothing_to_fit(spark):
    x, y = long_features(spark), targets(spark).withColumn("y", F.lit(0.0))
    one = tiles.gram_tiles(x, side=8).where("kind = 'energy'").withColumn("model", F.lit("a")).select("model", "bi", "bj", "tile")
    o = fit.ordinate(x, y).where("kind = 'energy'").select(F.lit("a").alias("model"), "i", "value")
    assert {r.coefficient for r in tiles.solve_tiles(one, o, side=8).collect()} == {0.0}
    assert tiles.solve_tiles(one.where("false"), o.where("false"), side=8).count() == 0
