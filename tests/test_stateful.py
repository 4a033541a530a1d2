import math

import pytest
from pyspark.sql import functions as F

from latticework.operators import fit, tiles
from latticework.streaming import stateful

from .test_tiles import long_features, targets


def in_files(rows, path, k, parts=3):
    rows.where(F.pmod(F.xxhash64("config_id"), F.lit(parts)) == k).coalesce(1).write.mode("append").parquet(path)


def test_moments_over_batches_and_a_restart(spark, tmp_path):
    """Three micro-batches, the query begun anew before the third; energies and forces, a null and a NaN."""
    rows = targets(spark).withColumn("kind", fit.kind_of()).withColumn("y", F.when(F.col("config_id") == 3, None).otherwise(F.col("y")))
    rows = rows.withColumn("y", F.when(F.col("config_id") == 4, float("nan")).otherwise(F.col("y")) + 1e6)
    into, out, state = (f"{tmp_path}/{x}" for x in ("in", "out", "state"))

    def run():
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(into)
        stateful.write_updates(stateful.moment_updates(stream, "kind", "y"), out, state)
        return {r.kind: (r.n, r["mean"], r["std"]) for r in stateful.newest(spark, out, ["kind"]).collect()}

    in_files(rows, into, 0)
    in_files(rows, into, 1)
    part = run()
    in_files(rows, into, 2)
    got = run()
    want = {r.kind: (r.n, r["mean"], r["std"]) for r in fit.moments(rows.where("y is not null")).collect()}
    assert part["force"][0] < got["force"][0]
    for kind, (n, mean, std) in want.items():
        assert got[kind][0] == n and math.isclose(got[kind][1], mean) and math.isclose(got[kind][2], std, rel_tol=1e-6)
    assert run() == got  # nothing new
    assert spark.read.parquet(out).select("batch").distinct().count() == 3


def test_gram_tiles_over_batches_and_a_restart(spark, tmp_path):
    x = long_features(spark)
    rows = tiles.gathered(x.withColumn("c", F.col("config_id")), ("c",)).withColumnRenamed("c", "config_id")
    into, out, state = (f"{tmp_path}/{x}" for x in ("in", "out", "state"))

    def run():
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(into)
        stateful.write_updates(stateful.gram_updates(stream.select("kind", "i", "v"), side=8), out, state)
        told = tiles.to_long(stateful.newest(spark, out, ["kind", "bi", "bj"]), ("kind",), side=8)
        return {(r.kind, r.i, r.j): r.value for r in told.collect()}

    in_files(rows, into, 0)
    in_files(rows, into, 1)
    run()
    in_files(rows, into, 2)
    got, want = run(), {(r.kind, r.i, r.j): r.value for r in fit.gram(x).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


@pytest.mark.parametrize("split", [1, 3, 6])
def test_merge_formula(split):
    values = [3.0, -1.0, 7.5, 7.5, 0.25, 100.0, 2.0]

    def told(x):
        mean = sum(x) / len(x)
        return len(x), mean, sum((v - mean) ** 2 for v in x)

    a, b = stateful.merged(told(values[:split]), told(values[split:])), told(values)
    assert a[0] == b[0] and all(math.isclose(p, q) for p, q in zip(a[1:], b[1:], strict=True))
    assert stateful.merged((0, 0.0, 0.0), b) == b and stateful.merged((0, 0.0, 0.0), (0, 0.0, 0.0)) == (0, 0.0, 0.0)
