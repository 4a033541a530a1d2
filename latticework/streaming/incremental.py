"""Incremental forms: chunked featurisation with resume, and running sums."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def featurise_stream(rows: DataFrame, features: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """Write each micro-batch's features under its batch number; a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        features(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_moments(rows: DataFrame, kind: str, value: str) -> DataFrame:
    """Count, mean and population deviation per kind, kept as streaming state; NaN and null values are left out."""
    good = rows.where(F.col(value).isNotNull() & ~F.isnan(value))
    return good.groupBy(kind).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def gram_stream(rows: DataFrame, gram: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """Write each micro-batch's Gram sums; ``total_gram`` adds them, whatever their order."""

    def write(batch: DataFrame, number: int) -> None:
        gram(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def total_gram(spark, path: str) -> DataFrame:
    return spark.read.parquet(path).groupBy("kind", "i", "j").agg(F.sum("value").alias("value"))
