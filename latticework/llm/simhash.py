"""SimHash near-dedup by covering locality-sensitive hashing.

For radius r every fingerprint bit gets a vector of r + 1 bits, and each of the
2^(r+1) - 1 non-zero vectors v makes one mask: the bits whose vector has an odd
overlap with v.  Up to r differing bits span at most r dimensions, so some v is
orthogonal to all of them; under its mask the two fingerprints agree.  Every
pair within the radius therefore meets in some table, without exception.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_key
from .components import connected_components, spanning_edges

WORDS = 4
RADIUS = 4
BITS = 64
SEED = 42
#: Buckets of more distinct fingerprints are split into cells of block pairs; counts that tell where there may be such.
BLOCK = 4096
SLOTS = 1 << 18


def covering_masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """The masks of the covering family, one per table."""
    draw = random.Random(radius * 1000 + bits)
    vectors = [draw.randrange(1, 1 << (radius + 1)) for _ in range(bits)]
    return [
        sum(1 << i for i, p in enumerate(vectors) if (p & v).bit_count() % 2)
        for v in range(1, 1 << (radius + 1))
    ]


def shingles(body: bytes, words: int = WORDS) -> np.ndarray:
    """A hash per word shingle, repeats included; a shorter text is one shingle."""
    found = body.lower().split()  # bytes: A-Z only, and the six ASCII white-space bytes
    if not found:
        return np.zeros(0, "<u8")
    joined = b" ".join(found)
    sizes = np.fromiter(map(len, found), "i8", len(found))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    n = max(1, len(found) - words + 1)
    stops = ends[min(words, len(found)) - 1 :]
    digest = xxhash.xxh64_intdigest
    return np.fromiter(
        (digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), stops.tolist(), strict=True)), "<u8", n
    )


def fingerprint(body: bytes, words: int = WORDS) -> int:
    """SimHash of a text's word shingles, repeats included; 0 without words."""
    h = shingles(body, words)
    n = len(h)
    if not n:
        return 0
    ones = np.zeros(BITS, "i8")
    for at in range(0, n, 1 << 14):
        ones += np.unpackbits(h[at : at + (1 << 14)].view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(
            axis=0, dtype="i4"
        )
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_key, fp long) of every row; the 64 bits as a signed long."""

    def made(col: pd.Series) -> pd.Series:
        values = np.fromiter((fingerprint(t.encode()) for t in col), "u8", len(col))
        return pd.Series(values.view("i8"))

    body = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("id"), text_key(text_col).alias("text_key"), F.pandas_udf(made, "long")(body).alias("fp")
    )


def _cells(keyed: DataFrame, block: int) -> DataFrame:
    """Splits large buckets (of ``block`` rows or more) into cells, one for each pair of blocks.

    A fingerprint is copied to one cell per block, and any two of a bucket
    share a cell, so no pair is lost and no task holds over two blocks of it.
    Buckets are counted exactly only where their slot of a table of SLOTS
    counts is full, which a large bucket's always is; the rest do not move twice.
    """
    slot = F.pmod(F.col("bucket"), F.lit(SLOTS)).cast("int").alias("slot")
    full = materialize(keyed.groupBy(slot).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block).select("slot"), "slots")
    placed = keyed.withColumn("slot", slot)
    rest = placed.join(F.broadcast(full), "slot", "left_anti").drop("slot")
    held = placed.join(F.broadcast(full), "slot", "left_semi").drop("slot")
    large = materialize(held.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block), "large")
    blocks = F.coalesce(F.ceil(F.col("n") / block).cast("int"), F.lit(1))
    spread = (
        held.join(large, "bucket", "left")
        .withColumn("mine", F.pmod(F.xxhash64("rep"), blocks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    )
    cell = F.xxhash64("bucket", F.least("mine", "other"), F.greatest("mine", "other"))
    split = spread.withColumn("bucket", F.when(F.col("n").isNull(), F.col("bucket")).otherwise(cell))
    return rest.unionByName(split.select(*keyed.columns))


def _apart(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Differing bits."""
    bits = np.bitwise_count(one ^ other)
    return bits if bits.ndim == 1 else bits.sum(axis=1, dtype="i4")


def _links(key: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs that connect, within runs of equal ``key``, all rows within the radius.

    ``key`` ascends.  ``fp`` holds a fingerprint per row, of one word or (two-dimensional) of several.

    Short runs are compared shift by shift, all runs at once.  A long run is
    walked breadth-first, so that a dense one costs few comparisons: a row
    already reached is never compared again, and its links stay implied.
    """
    n = len(key)
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[start, n])
    run = np.repeat(np.arange(len(start)), size)
    left, right = [], []
    short = size[run] <= 8
    for shift in range(1, 8):
        i = np.flatnonzero(short[:-shift] & (run[shift:] == run[:-shift]))
        near = i[_apart(fp[i], fp[i + shift]) <= radius]
        left.append(near)
        right.append(near + shift)
    for s, m in zip(start[size > 8].tolist(), size[size > 8].tolist(), strict=True):
        rest = np.arange(s, s + m)
        while len(rest):
            queue, rest = [int(rest[0])], rest[1:]
            while queue and len(rest):
                at = queue.pop()
                near = _apart(fp[rest], fp[at]) <= radius
                reached = rest[near]
                if len(reached):
                    left.append(np.full(len(reached), at))
                    right.append(reached)
                    queue += reached.tolist()
                    rest = rest[~near]
    return np.concatenate(left), np.concatenate(right)


def near_links(distinct: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """(fp, rep) of distinct fingerprints -> edges (a, b) between representatives."""
    masks = [m - (1 << 64) if m >> 63 else m for m in covering_masks(radius)]
    return table_links(distinct, [F.col("fp").bitwiseAND(F.lit(m)) for m in masks], radius, block)


def table_links(distinct: DataFrame, keys: list[Column], radius: int, block: int = BLOCK, words: tuple[str, ...] = ("fp",)) -> DataFrame:
    """(rep, words...), a table per key -> edges (a, b) that connect the rows within ``radius`` that share a table's key.

    ``words`` are the columns of the fingerprint.  A table's key is hashed to a
    bucket; where two keys fall into one, more rows are compared, and no others
    are linked.
    """
    tables = F.array(*[F.xxhash64(F.lit(i), k) for i, k in enumerate(keys)])
    keyed = distinct.select("rep", *words, F.explode(tables).alias("bucket"))

    def links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None

        def within(rows: pd.DataFrame) -> pd.DataFrame:
            rep = rows["rep"].to_numpy("i8")
            prints = rows[list(words)].to_numpy("i8").view("u8") if len(words) > 1 else rows[words[0]].to_numpy("i8").view("u8")
            i, j = _links(rows["bucket"].to_numpy("i8"), prints, radius)
            a, b = spanning_edges(rep[i].tolist(), rep[j].tolist())
            return pd.DataFrame({"a": a, "b": b}, dtype="i8")

        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            bucket = rows["bucket"].to_numpy("i8")
            cut = int(np.searchsorted(bucket, bucket[-1])) if len(rows) else 0  # the last bucket may go on
            held = rows.iloc[cut:].reset_index(drop=True)
            if cut:
                yield within(rows.iloc[:cut])
        if held is not None and len(held):
            yield within(held)

    return _cells(keyed, block).repartition("bucket").sortWithinPartitions("bucket").mapInPandas(links, "a long, b long")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, radius: int = RADIUS
) -> DataFrame:
    """Per row: id, fingerprint (16 hex digits), component_id (smallest linked id), text_key.

    Rows of equal fingerprint are one node, named by its smallest identifier, so
    a large group of copies costs one row in every table.  A null text counts
    as empty: fingerprint zero.  A null identifier is never a component's name;
    such a row takes the component of its fingerprint, null if that has no
    other row.  Repeated rows get one row each; other columns are ignored.
    """
    prints = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("id").cast("long").alias("rep")), "distinct-fp")
    edges = near_links(distinct.where("rep is not null"), radius)
    parts = connected_components(edges)
    named = distinct.join(parts, distinct["rep"] == parts["node"], "left").select(
        "fp", F.coalesce("component", "rep").alias("component_id")
    )
    return prints.join(named, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "text_key"
    )
