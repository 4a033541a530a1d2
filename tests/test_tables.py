import pytest
from pyspark.sql import functions as F

from latticework.functions import chem
from latticework.operators import tables


def configs(spark, prefix, keys, energy=1.0):
    return spark.createDataFrame([(f"{prefix}_{k}", float(energy + k), 2) for k in keys], "config_id string, energy double, size int")


def test_consolidation_keeps_first_last_or_unique(spark):
    a = configs(spark, "x", range(8), 0.0)
    b = configs(spark, "x", range(5, 11), 100.0)
    last = {r.config_id: r.energy for r in tables.consolidate([a, b], keep="last").collect()}
    first = {r.config_id: r.energy for r in tables.consolidate([a, b], keep="first").collect()}
    unique = {r.config_id for r in tables.consolidate([a, b], keep=None).collect()}
    assert len(last) == len(first) == 11
    assert last["x_6"] == 106 and first["x_6"] == 6 and "x_6" not in unique and len(unique) == 8


def test_a_taken_prefix_is_skipped_or_replaced(spark):
    empty = configs(spark, "x", []).withColumn("prefix", F.lit(""))
    one = tables.register(empty, configs(spark, "a", range(3)), "a")
    assert tables.register(one, configs(spark, "b", range(5)), "a").count() == 3
    assert tables.register(one, configs(spark, "b", range(5)), "a", overwrite=True).count() == 5
    with pytest.raises(ValueError):
        tables.register(one, configs(spark, "b", [1]).drop("size"), "c")


def test_max_force_filter_keeps_the_cutoff_itself(spark):
    atoms = spark.createDataFrame([(1, 3.0, 4.0, 0.0), (1, 0.0, 0.0, 0.0), (2, 6.0, 8.0, 0.0), (3, 11.0, 0.0, 0.0)], "config_id int, fx double, fy double, fz double")
    c = spark.createDataFrame([(i, 0.0) for i in (1, 2, 3)], "config_id int, energy double")
    assert {r.config_id: r.max_force for r in tables.filter_max_forces(c, atoms, 10.0).collect()} == {1: 5.0, 2: 10.0}


def test_folds_are_contiguous_and_larger_first(spark):
    rows = spark.createDataFrame([(i,) for i in range(11)], "seq int")
    got = sorted((r.seq, r.fold) for r in tables.folds(rows, 3, "seq").collect())
    assert [f for _, f in got] == [0] * 4 + [1] * 4 + [2] * 3


def test_global_rank_counts_every_row(spark):
    rows = spark.createDataFrame([((i * 7919) % 1000, i) for i in range(1000)], "v int, i int")
    ranked, n = tables.global_rank(rows, "v")
    assert n == 1000 and [r["rank"] for r in ranked.orderBy("v").collect()] == list(range(1, 1001))


def test_repeated_steps_meet_in_order(spark):
    log = spark.createDataFrame([(0, 0, "a"), (1, 1000, "b"), (2, 0, "c"), (3, 500, "d")], "pos int, step int, l string")
    dump = spark.createDataFrame([(0, 0, "A"), (1, 0, "B"), (2, 1000, "C")], "pos int, step int, d string")
    assert {(r.l, r.d) for r in tables.occurrence_join(log, dump).collect()} == {("a", "A"), ("c", "B"), ("b", "C")}


def test_pressure_and_aliases(spark):
    c = spark.createDataFrame([("a", 10.0, 2.0), ("b", 10.0, 2.0), ("c", 10.0, 2.0)], "d string, energy double, volume double")
    p = spark.createDataFrame([("a", 1.5), ("b", 0.0)], "d string, pressure double")
    assert {r.d: r.energy for r in tables.pressure_corrected(c, p, "d").collect()} == {"a": 7.0, "b": 10.0, "c": 10.0}
    t = spark.createDataFrame([("1",), ("W",)], "type string")
    assert [r.type for r in tables.alias_species(t, {"1": "Ne"}).collect()] == ["Ne", "W"]


def test_hashes_round_trip(spark):
    pairs = spark.createDataFrame([(i, j) for i in range(12) for j in range(12)], "i long, j long")
    h = chem.szudzik(F.col("i"), F.col("j"))
    back = pairs.select("i", "j", h.alias("h")).select("*", *[c.alias(n) for c, n in zip(chem.unszudzik(F.col("h")), "xy", strict=True)])
    rows = back.collect()
    assert len({r.h for r in rows}) == 144 and all((r.i, r.j) == (r.x, r.y) for r in rows)
    assert chem.elements(spark).count() == 118
    one = pairs.limit(1).select(chem.atomic_number(F.lit("Au")).alias("z"), chem.symbol_of(F.lit(54)).alias("s")).first()
    assert (one.z, one.s) == (79, "Xe")
