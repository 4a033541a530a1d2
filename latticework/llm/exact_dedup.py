"""Exact dedup by a log-structured merge index, in DataFrame operations only.

Rows land in memtables by a hash of their identifier.  Each memtable flushes a
run: its distinct digests in sorted order, with the copies and the surviving
identifier, next to a bitmap filter of the digests.  A digest that occurs once
in its run and misses every other run's filter is unique and leaves at once.
The rest (hits) are compacted across runs, and the rows of a compacted digest
are compared byte for byte with the text of the surviving row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, text_or_empty

#: Filter bits per digest; the filter is sized from the flushed rows.
BITS_PER_DIGEST = 16
#: Rows of one group that share one copy of the surviving text in verification.
ROWS_PER_SALT = 4096
#: Pages (32,768 bits each) of the filter that keeps unique texts from moving.
MEMBER_FILTER_PAGES = 512


def _bit_is_set(bitmap: Column, position: Column) -> Column:
    """Whether bit ``position`` of a bitmap made by bitmap_construct_agg is set."""
    byte = F.conv(F.hex(F.substring(bitmap, (F.floor(position / 8) + 1).cast("int"), F.lit(1))), 16, 10)
    return F.getbit(byte.cast("long"), (position % 8).cast("int")) == 1


def flush_runs(digests: DataFrame, memtables: int, largest: bool) -> DataFrame:
    """(id, digest) -> sorted runs (run, digest, copies, keep_id) as a table."""
    keep = F.max("id") if largest else F.min("id")
    runs = (
        digests.withColumn("run", F.pmod(F.xxhash64("id"), F.lit(memtables)).cast("int"))
        .groupBy("run", "digest")
        .agg(F.count(F.lit(1)).alias("copies"), keep.alias("keep_id"))
        .sortWithinPartitions("run", "digest")
    )
    return materialize(runs, "digest-runs")


def run_filters(runs: DataFrame, bits: int) -> DataFrame:
    """One row per filter page: the bitmaps of all runs over that page."""
    slot = F.pmod(F.xxhash64("digest"), F.lit(bits))
    return (
        runs.select("run", slot.alias("slot"))
        .groupBy("run", F.expr("bitmap_bucket_number(slot)").alias("page"))
        .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(slot))").alias("bitmap"))
        .groupBy("page")
        .agg(F.collect_list(F.struct("run", "bitmap")).alias("filters"))
    )


def hits_of(runs: DataFrame, bits: int) -> DataFrame:
    """Run rows with ``hit``: repeated in their run, or in another run's filter."""
    slot = F.pmod(F.xxhash64("digest"), F.lit(bits))
    keyed = (
        runs.withColumn("slot", slot)
        .withColumn("page", F.expr("bitmap_bucket_number(slot)"))
        .withColumn("bit", F.expr("bitmap_bit_position(slot)"))
    )
    elsewhere = F.exists("filters", lambda f: (f["run"] != F.col("run")) & _bit_is_set(f["bitmap"], F.col("bit")))
    # The filters grow with the corpus: both sides shuffle by page, none is broadcast.
    return keyed.join(run_filters(runs, bits).hint("shuffle_hash"), "page").select(
        "digest", "copies", "keep_id", ((F.col("copies") > 1) | elsewhere).alias("hit")
    )


def _maybe_duplicated(members: DataFrame, entries: DataFrame) -> DataFrame:
    """Members whose digest may be among the entries, before any text is moved.

    The filter has MEMBER_FILTER_PAGES pages of 4 KiB at most and is broadcast;
    where it fills up it lets more rows through, never fewer.
    """
    slot = F.pmod(F.xxhash64("digest"), F.lit(MEMBER_FILTER_PAGES << 15))
    pages = (
        entries.select(slot.alias("slot"))
        .groupBy(F.expr("bitmap_bucket_number(slot)").alias("page"))
        .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(slot))").alias("bitmap"))
    )
    return (
        members.withColumn("slot", slot)
        .withColumn("page", F.expr("bitmap_bucket_number(slot)"))
        .join(F.broadcast(pages), "page")
        .where(_bit_is_set(F.col("bitmap"), F.expr("bitmap_bit_position(slot)")))
        .select(*members.columns)
    )


def _verified(members: DataFrame, entries: DataFrame) -> DataFrame:
    """Compare each member's bytes with those of its group's surviving row.

    The surviving text is copied once per ROWS_PER_SALT members, so that a
    digest with a third of all rows spreads over many tasks.
    """
    salts = F.ceil(F.col("group_size") / ROWS_PER_SALT).cast("int")
    joined = members.join(entries, "digest").withColumn("salts", salts)
    left = joined.withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int"))
    right = (
        joined.where(F.col("id").eqNullSafe(F.col("keep_id")))
        .groupBy("digest", "salts")
        .agg(F.min("body").alias("kept_body"))
        .select("digest", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "kept_body")
    )
    same = F.col("body") == F.col("kept_body")
    return left.join(right, ["digest", "salt"]).select(
        "id", "digest", "keep_id", "group_size", F.when(~same, F.col("body")).alias("other_body"),
        F.xxhash64("body").alias("text_key"),
    )


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    largest: bool = True,
    memtables: int = 8,
    keep_text_key: bool = False,
) -> DataFrame:
    """Groups of byte-equal texts: (id, keep_id, group_size, kept, text_sha256).

    One row per input row.  A null text counts as empty.  The row with the
    largest identifier (smallest with ``largest=False``) stays; identical rows
    with that identifier are one survivor, so exactly one row per group has
    ``kept``.  A null identifier loses to any other.  Other columns are ignored.
    ``keep_text_key`` adds text_key for rows in groups of two or more (else null).
    """
    base = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("body"))
    digests = base.select("id", F.unhex(F.sha2("body", 256)).alias("digest"))
    runs = flush_runs(digests, memtables, largest)
    bits = max(1 << 15, BITS_PER_DIGEST * runs.count())
    probed = materialize(hits_of(runs, bits), "digest-probes")

    keep = F.max("keep_id") if largest else F.min("keep_id")
    compacted = materialize(
        probed.where("hit").groupBy("digest").agg(F.sum("copies").alias("group_size"), keep.alias("keep_id")),
        "digest-compacted",
    )
    single = probed.where(~F.col("hit")).select("digest", F.lit(1).cast("long").alias("group_size"), "keep_id")
    unique = single.unionByName(compacted.where("group_size = 1")).select(
        F.col("keep_id").alias("id"), "digest", "keep_id", "group_size", F.lit(True).alias("kept"),
        F.lit(None).cast("long").alias("text_key"),
    )
    entries = compacted.where("group_size > 1")
    members = base.select("id", "body", F.unhex(F.sha2("body", 256)).alias("digest"))
    checked = materialize(_verified(_maybe_duplicated(members, entries), entries), "digest-verified")
    if not checked.where("other_body is not null").isEmpty():
        # Two texts share a digest: regroup their rows by the text itself.
        pick = F.max("id") if largest else F.min("id")
        regrouped = checked.groupBy("digest", "other_body").agg(
            pick.alias("k2"), F.count(F.lit(1)).alias("g2")
        )
        checked = (
            checked.alias("c")
            .join(
                regrouped.alias("r"),
                (F.col("c.digest") == F.col("r.digest")) & F.col("c.other_body").eqNullSafe(F.col("r.other_body")),
            )
            .select("c.id", "c.digest", F.col("k2").alias("keep_id"), F.col("g2").alias("group_size"), "c.other_body", "c.text_key")
        )
    survivor = F.col("id").eqNullSafe(F.col("keep_id"))
    order = Window.partitionBy("digest", "other_body", "id").orderBy("keep_id")
    grouped = checked.withColumn("nth", F.when(survivor, F.row_number().over(order))).select(
        "id", "digest", "keep_id", "group_size", (survivor & (F.col("nth") == 1)).alias("kept"), "text_key"
    )
    return unique.unionByName(grouped).select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        "kept",
        F.lower(F.hex("digest")).alias("text_sha256"),
        *(["text_key"] if keep_text_key else []),
    )
