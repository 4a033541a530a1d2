"""Places of rows within the order of their key, without gathering a key in one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, shuffle_width


def sorted_parts(rows: DataFrame, key: str, order: list[Column], tag: str, scan: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Rows sorted by ``key`` and ``order`` over range partitions, written with their partition and place.

    Adds ``_lw_part`` and ``_lw_place`` (ascending within the partition).  Rows
    that are equal in all of these are dealt by where they were read, so a
    key, or a repeated row, that holds a third of the table spans partitions.
    ``scan`` works on the sorted partitions before they are written.
    """
    by = [F.asc_nulls_first(key), *order, F.asc("_lw_tie")]
    spread = (
        rows.withColumn("_lw_tie", F.monotonically_increasing_id())
        .repartitionByRange(shuffle_width(rows.sparkSession), *by)
        .sortWithinPartitions(*by)
        .drop("_lw_tie")
        .withColumn("_lw_place", F.monotonically_increasing_id())
        .withColumn("_lw_part", F.shiftright("_lw_place", 33).cast("int"))
    )
    return materialize(scan(spread) if scan else spread, tag)


def numbered(rows: DataFrame, key: str, order: list[Column], tag: str) -> DataFrame:
    """Adds ``pos``, the place of each row in its key from 0, and ``n``, the rows of the key.

    ``key`` has no nulls.  The runs of a key are counted by partition: as many
    rows as there are partitions and keys, summed in a window over a key's
    partitions.
    """
    parts = sorted_parts(rows, key, order, tag)
    runs = parts.groupBy("_lw_part", key).agg(F.min("_lw_place").alias("_lw_first"), F.count(F.lit(1)).alias("_lw_rows"))
    earlier = Window.partitionBy(key).orderBy("_lw_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select(
        "_lw_part", key, "_lw_first", F.coalesce(F.sum("_lw_rows").over(earlier), F.lit(0)).alias("_lw_before"),
        F.sum("_lw_rows").over(Window.partitionBy(key)).alias("n"),
    )
    placed = parts.join(starts, ["_lw_part", key])
    return placed.withColumn("pos", F.col("_lw_place") - F.col("_lw_first") + F.col("_lw_before")).drop(
        "_lw_part", "_lw_place", "_lw_first", "_lw_before"
    )
