"""Benchmark decontamination by spaced-seed hashing, in DataFrame operations only.

A fixed mask over eight words hashes five of them and ignores the other three,
so a substitution at an ignored place does not hide a passage.  The hashes of
all benchmark items are joined with those of all document positions; around
each hit the words are compared place by place.  The mask 1 1 0 1 0 0 1 1 is
lossless for the acceptance rule: however two substitutions fall in thirteen
words, one placement of the mask avoids both (a test enumerates them all).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

#: Places of the mask that count.
MASK = (0, 1, 3, 6, 7)
SPAN = MASK[-1] + 1
#: Words of a window, and how many must be equal: 11 of 13 is over 0.8.
WINDOW = 13
EQUAL = 11
#: Benchmarks of up to this many seeds are broadcast; larger ones are shuffled.
BROADCAST_SEEDS = 200_000

_BEFORE = WINDOW - SPAN
_WHITE = r"[ \t\n\x0B\f\r]+"


def words(text: Column) -> Column:
    """Lower-cased words between ASCII white space."""
    return F.array_remove(F.split(F.lower(text), _WHITE), "")


def _seeds(w: str) -> Column:
    """Hash of the masked words at each place of an array column."""
    places = F.sequence(F.lit(0), F.size(w) - SPAN)
    hashes = F.transform(places, lambda p: F.xxhash64(*[F.get(F.col(w), p + m) for m in MASK]))
    return F.when(F.size(w) >= SPAN, hashes).otherwise(F.array().cast("array<bigint>"))


def benchmark_seeds(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, need, seed, context): the words that any window around the seed may hold."""
    items = benchmark.select(F.col(id_col).alias("item_id"), words(text_or_empty(text_col)).alias("iw"))
    placed = items.select("item_id", "iw", F.posexplode(_seeds("iw")).alias("at", "seed"))
    around = F.sequence(F.lit(-_BEFORE), F.lit(WINDOW - 1))
    return placed.select(
        "item_id",
        F.when(F.size("iw") >= WINDOW, F.lit(EQUAL)).otherwise(F.size("iw")).alias("need"),
        "seed",
        F.transform(around, lambda j: F.get(F.col("iw"), F.col("at") + j)).alias("context"),
    )


def _equal_flags() -> Column:
    """1 where document and item agree, over all places a window with the seed can cover."""
    around = F.sequence(F.lit(-_BEFORE), F.lit(WINDOW - 1))

    def same(j: Column) -> Column:
        return F.get(F.col("w"), F.col("at") + j) == F.get(F.col("context"), j + _BEFORE)

    return F.transform(around, lambda j: F.coalesce(same(j), F.lit(False)).cast("int"))


def _best_window(flags: str) -> Column:
    """Most ones in WINDOW places, over the windows that hold the whole seed."""
    total = [F.aggregate(F.slice(flags, s + 1, WINDOW), F.lit(0), lambda a, x: a + x) for s in range(_BEFORE + 1)]
    return F.greatest(*total)


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents that hold benchmark words: (id_col, text_key, item_id, equal_words).

    A document leaks an item when 11 of 13 aligned words are equal in some
    window (all words, for items of 8 to 12 words; shorter items are too little
    evidence and never match).  One row per document text and item, with the
    most equal words in a window.  Null texts hold no words; rows that repeat
    give one row; null identifiers stay null; ``text_key`` (a hash of the text)
    tells rows of one identifier apart.  Other columns are ignored.
    """
    seeds = benchmark_seeds(benchmark)
    source = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(text_or_empty(text_col)).alias("text_key"),
        words(text_or_empty(text_col)).alias("w"),
    )
    if seeds.count() <= BROADCAST_SEEDS:
        hits = source.select("*", F.posexplode(_seeds("w")).alias("at", "seed")).join(F.broadcast(seeds), "seed")
    else:  # positions are shuffled without their text, which joins the hits alone
        slim = source.select("id", "text_key", F.posexplode(_seeds("w")).alias("at", "seed")).join(seeds, "seed")
        texts = source.dropDuplicates(["id", "text_key"]).select(F.col("id").alias("_id"), F.col("text_key").alias("_key"), "w")
        hits = slim.join(texts, F.col("id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")))
    judged = hits.select("id", "text_key", "item_id", "need", _equal_flags().alias("equal")).select(
        "id", "text_key", "item_id", "need", _best_window("equal").alias("best")
    )
    return (
        judged.where(F.col("best") >= F.col("need"))
        .groupBy("id", "text_key", "item_id")
        .agg(F.max("best").alias("equal_words"))
        .select(F.col("id").alias(id_col), "text_key", "item_id", "equal_words")
    )


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that leak no item, columns unchanged."""
    found = leaks(docs, benchmark, id_col, text_col).select(F.col(id_col).alias("_leak_id"), "text_key").distinct()
    same = F.col(id_col).eqNullSafe(F.col("_leak_id")) & (F.xxhash64(text_or_empty(text_col)) == F.col("text_key"))
    return docs.join(found, same, "left_anti")
