"""Shared helpers of the corpus operators: scratch tables and batch sizing."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_CHECKPOINT_KEY = "spark.checkpoint.dir"


def scratch_root(spark: SparkSession) -> str:
    """Shared folder named by the session; a temporary one only where none is set and all runs in one process."""
    root = spark.conf.get(_CHECKPOINT_KEY, None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.conf.get("spark.master", "local")):
            raise ValueError(f"{_CHECKPOINT_KEY} must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="latticework-")
        spark.conf.set(_CHECKPOINT_KEY, root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{scratch_root(spark)}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str, *, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts lineage without keeping blocks on executors: a lost executor costs no
    rows, because the table outlives it.
    """
    path = scratch_path(df.sparkSession, tag)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col), F.lit(""))


#: Rows and bytes of one Arrow batch for whole texts, where the session has Spark's defaults.
BATCH_ROWS, BATCH_BYTES = 1000, "16m"


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds: Spark's default of 10,000 rows a batch is for short rows."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(rows) == "10000":
        spark.conf.set(rows, str(BATCH_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Pages (32,768 bits each) of the filter in ``apply_verdicts``.
VERDICT_FILTER_PAGES = 512


def text_key(text_col: str = "text"):
    """A hash of the text that, with the identifier, names a row."""
    return F.xxhash64(text_or_empty(text_col))


def _byte_of(bits: str, bit: Column) -> Column:
    """The byte of a bitmap that holds a bit."""
    return F.conv(F.hex(F.substring(bits, (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")


def among(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose ``key`` (a long) may be one of ``keys``, by a broadcast filter of bounded size.

    Others stay where they are.  Where the filter fills up more rows pass, never fewer.
    """
    slot = F.pmod(F.col(key), F.lit(VERDICT_FILTER_PAGES << 15))
    pages = (
        keys.select(slot.alias("_lw_slot"))
        .groupBy(F.expr("bitmap_bucket_number(_lw_slot)").alias("_lw_page"))
        .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(_lw_slot))").alias("_lw_bits"))
    )
    bit = F.expr("bitmap_bit_position(_lw_slot)")
    placed = rows.withColumn("_lw_slot", slot).withColumn("_lw_page", F.expr("bitmap_bucket_number(_lw_slot)"))
    inside = placed.join(F.broadcast(pages), "_lw_page").where(F.getbit(_byte_of("_lw_bits", bit), (bit % 8).cast("int")) == 1)
    return inside.select(*rows.columns)


def apply_verdicts(docs: DataFrame, verdicts: DataFrame, *, once: bool = False) -> DataFrame:
    """Rows of ``docs`` that no verdict (doc_id, text_key, keep) drops, columns unchanged.

    The verdicts are written first, as the filter and the join both read them.
    Rows outside a broadcast filter of the verdicts stay where they are; only
    rows inside it are shuffled and joined.  The filter's size is bounded, and
    where it fills up more rows are joined, never fewer.  A row with a verdict
    stays if any verdict on it says so; with ``once`` identical such rows stay
    once.
    """
    cols = docs.columns
    slot = F.pmod(F.xxhash64("doc_id", "_lw_text"), F.lit(VERDICT_FILTER_PAGES << 15))
    named = materialize(verdicts.select("doc_id", F.col("text_key").alias("_lw_text"), "keep"), "verdicts")
    page, bit = F.expr("bitmap_bucket_number(_lw_slot)").alias("_lw_page"), F.expr("bitmap_bit_position(_lw_slot)")
    pages = (
        named.select(slot.alias("_lw_slot"))
        .select(page, bit.alias("_lw_bit"))
        .groupBy("_lw_page")
        .agg(F.expr("bitmap_construct_agg(_lw_bit)").alias("_lw_bits"))
    )
    inside = F.coalesce(F.getbit(_byte_of("_lw_bits", bit), (bit % 8).cast("int")) == 1, F.lit(False))
    marked = (
        docs.withColumn("_lw_text", text_key())
        .withColumn("_lw_slot", slot)
        .withColumn("_lw_page", page)
        .join(F.broadcast(pages), "_lw_page", "left")
        .withColumn("_lw_in", inside)
    )
    verdict = (
        named.groupBy("doc_id", "_lw_text").agg(F.max("keep").alias("_lw_keep"))
        .select(F.col("doc_id").alias("_lw_id"), F.col("_lw_text").alias("_lw_text2"), "_lw_keep")
    )
    same = F.col("doc_id").eqNullSafe(F.col("_lw_id")) & (F.col("_lw_text") == F.col("_lw_text2"))
    judged = marked.where("_lw_in").join(verdict, same, "left").where(F.coalesce("_lw_keep", F.lit(True)))
    if once:
        judged = judged.where("_lw_keep is null").unionByName(
            judged.where("_lw_keep is not null").dropDuplicates(["doc_id", "_lw_text"])
        )
    return marked.where(~F.col("_lw_in")).select(*cols).unionByName(judged.select(*cols))
