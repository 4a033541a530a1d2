from pyspark.sql import functions as F

from latticework.operators import fit
from latticework.streaming import incremental


def test_running_moments_equal_the_batch(spark, tmp_path):
    schema = "kind string, value double"
    rows = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", float("nan")), ("b", 5.0)], schema)
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = incremental.running_moments(stream, "kind", "value").writeStream.outputMode("complete").format("memory").queryName("m")
    q.trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start().awaitTermination()
    assert {r.kind: (r.n, r["mean"], r["std"]) for r in spark.table("m").collect()} == {"a": (2, 2.0, 1.0), "b": (1, 5.0, 0.0)}


def test_gram_batches_add_up_and_resume(spark, tmp_path):
    schema = "config_id int, component string, atom_idx int, feature_idx int, value double"
    rows = spark.createDataFrame([(i, "energy", None, k, float(i + k)) for i in range(6) for k in range(3)], schema)
    for k in range(3):
        rows.where(F.col("config_id") % 3 == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    out, check = f"{tmp_path}/out", f"{tmp_path}/c"

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        incremental.gram_stream(stream, fit.gram, out, check).awaitTermination()
        return {(r.i, r.j): r.value for r in incremental.total_gram(spark, out).collect()}

    want = {(r.i, r.j): r.value for r in fit.gram(rows).collect()}
    assert run() == want and run() == want  # nothing new the second time


def test_featurised_batches(spark, tmp_path):
    rows = spark.createDataFrame([(i,) for i in range(5)], "v int")
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("v int").parquet(f"{tmp_path}/in")
    incremental.featurise_stream(stream, lambda b: b.select((F.col("v") * 2).alias("x")), f"{tmp_path}/out", f"{tmp_path}/c").awaitTermination()
    assert sorted(r.x for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [0, 2, 4, 6, 8]
