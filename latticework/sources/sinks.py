"""Writers: the standard table, feature chunks with resume, models, tabulated potentials."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, tag: str) -> str:
    """A new folder in the shared one that the session names; a temporary one only where all runs in one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.conf.get("spark.master", "local")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="latticework-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def cache_table(rows: DataFrame, path: str) -> None:
    """Append the standard table under its prefixes."""
    rows.write.mode("append").partitionBy("prefix").parquet(path)


def load_table(spark, path: str) -> DataFrame:
    """The cached table; rows without a row name are named by prefix and sequence."""
    rows = spark.read.parquet(path)
    if "row_name" not in rows.columns:
        return rows
    return rows.withColumn("config_id", F.coalesce("row_name", F.concat_ws("_", "prefix", "seq")))


def assign_chunks(rows: DataFrame, size: int, order: str) -> DataFrame:
    """Adds ``chunk``: consecutive runs of ``size`` rows in the given order."""
    from latticework.operators.tables import global_rank

    ranked, _ = global_rank(rows, order)
    return ranked.withColumn("chunk", F.floor((F.col("rank") - 1) / size).cast("int")).drop("rank")


def write_chunks(rows: DataFrame, path: str, key: str = "config_id") -> DataFrame:
    """Write the rows whose key is not there yet; returns them.

    Rows are told apart by their key, not by their chunk's number, so rows
    added since a first run are written and none is written twice.  The numbers
    of new chunks follow those there.
    """
    spark = rows.sparkSession
    try:
        there = spark.read.parquet(path)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
            raise
        new = rows
    else:
        last = there.agg(F.max("chunk")).first()[0]
        new = rows.join(there.select(key), key, "left_anti")
        fresh = new.groupBy("chunk").agg(F.lit(1)).select("chunk")
        first = fresh.agg(F.min("chunk").alias("_first"))
        shift = F.lit(0 if last is None else last + 1) - F.col("_first")
        new = new.crossJoin(F.broadcast(first)).withColumn("chunk", (F.col("chunk") + shift).cast("int")).drop("_first")
    target = scratch(spark, "chunks")  # what is written must not be read from where it goes
    new.write.parquet(target)
    new = spark.read.schema(new.schema).parquet(target)
    new.write.mode("append").partitionBy("chunk").parquet(path)
    return new


def write_bucketed(rows: DataFrame, name: str, buckets: int, key: str = "config_id", chunk: str | None = None, path: str | None = None) -> None:
    """Save a table in buckets of the key, sorted by it, and in a folder per chunk where a chunk column is named.

    The table lies in the warehouse or at ``path``.  Tables of as many buckets join on the key without a shuffle or a sort of
    large files.  Rows are dealt by bucket first, so a bucket of a chunk is one file.
    """
    out = rows.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key).format("parquet")
    out = out.partitionBy(chunk) if chunk else out
    (out.option("path", path) if path else out).saveAsTable(name)


def load_bucketed(spark: SparkSession, names: list[str], on: list[str], chunks: list[int] | None = None, chunk: str = "chunk") -> DataFrame:
    """Bucketed tables joined on columns that begin with their key; of those in chunks only the given ones are read."""
    joined = None
    for name in names:
        rows = spark.table(name)
        if chunk in rows.columns:
            rows = (rows if chunks is None else rows.where(F.col(chunk).isin(*chunks))).drop(*([chunk] if joined is not None else []))
        joined = rows if joined is None else joined.join(rows, [c for c in on if c in rows.columns])
    return joined


def write_models(models: DataFrame, path: str) -> None:
    """One JSON line per model: its coefficients by interaction key."""
    series = models.groupBy("model", "key").agg(F.array_sort(F.collect_list(F.struct("basis_idx", "coefficient"))).alias("c"))
    by_key = series.groupBy("model").agg(
        F.map_from_entries(F.collect_list(F.struct("key", F.transform("c", lambda x: x["coefficient"])))).alias("coefficients")
    )
    by_key.select(F.to_json(F.struct("model", "coefficients")).alias("value")).write.text(path)


def write_tabulated(points: DataFrame, path: str) -> None:
    """Lines ``interaction index r e f`` of sampled potentials, in order within each interaction."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("interaction_id").orderBy("r"))
    line = F.format_string("%d %d %.8f %.8f %.8f", "interaction_id", n, "r", "e", "f")
    points.select("interaction_id", "r", line.alias("value")).repartition("interaction_id").sortWithinPartitions(
        "interaction_id", "r"
    ).select("value").write.text(path)
