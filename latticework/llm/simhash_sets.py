"""SimHash near-dedup at a word-shingle similarity.

A text's shingle set has a fingerprint of PARTS parts of 32 bits.  Covering
masks of radius PART_RADIUS on each part make 15 tables a part: a pair of which
some part differs in at most PART_RADIUS bits meets in a table, without
exception, and so does every pair within PARTS * (PART_RADIUS + 1) - 1 bits in
all.  At a Jaccard similarity of 0.8 about 29 bits differ, and a pair meets
with probability 0.98, at 0.86 with 0.996 (a test measures it).  What meets
within RADIUS bits in all is one candidate group.

No link rests on a fingerprint: it is verified on the sets.  First every set is
held against the smallest of its group; what that connects is one part.  Groups
of several parts are then compared in full between parts, large ones in cells
of block pairs, so a dense group costs a row per member and no pair of a group
is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import among, materialize, text_key
from .components import connected_components
from .simhash import covering_masks, shingles, table_links

WORDS = 5
SIMILARITY = 0.8
#: Parts of 32 bits of a fingerprint, two a word, and the bits in which one of them may differ.
PARTS = 6
PART_RADIUS = 3
PRINT = tuple(f"fp{k}" for k in range(PARTS // 2))
#: Differing bits of all parts up to which a pair is a candidate: three deviations over the mean at SIMILARITY.
RADIUS = 45
#: Sets of a group in one block; parts of more sets have blocks of their own.
BLOCK = 256
#: A hot set is copied to so many join keys.
SALTS = 64

_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_SHIFT = np.uint64(31)


def shingle_set(body: bytes) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted."""
    return np.unique(shingles(body, WORDS))


def set_fingerprint(found: np.ndarray) -> list[int]:
    """SimHash of a shingle set, in PARTS / 2 signed words; zeros for an empty set."""
    if not len(found):
        return [0] * (PARTS // 2)
    ones = np.zeros(32 * PARTS, "i8")
    for at in range(0, len(found), 1 << 13):
        part = found[at : at + (1 << 13)]
        mixed = np.empty((len(part), PARTS // 2), "<u8")
        for k in range(PARTS // 2):
            x = (part ^ _ODD[k]) * _ODD[0]
            mixed[:, k] = (x ^ (x >> _SHIFT)) * _ODD[1]
        ones += np.unpackbits(mixed.view("u1"), axis=1, bitorder="little").sum(axis=0, dtype="i4")
    return np.packbits(2 * ones > len(found), bitorder="little").view("<i8").tolist()


def table_keys() -> list[Column]:
    """A key per table of the covering family of every part."""
    keys = []
    for part in range(PARTS):
        word = F.col(PRINT[part // 2])
        half = word.bitwiseAND(F.lit(0xFFFFFFFF)) if part % 2 == 0 else F.shiftrightunsigned(word, 32)
        keys += [half.bitwiseAND(F.lit(m)) for m in covering_masks(PART_RADIUS, 32)]
    return keys


def similar(one: np.ndarray, sets: list[np.ndarray], similarity: float = SIMILARITY) -> np.ndarray:
    """Which of ``sets`` have this Jaccard similarity to ``one``."""
    size = np.fromiter(map(len, sets), "i8", len(sets))
    may = np.flatnonzero(np.minimum(size, len(one)) >= similarity * np.maximum(size, len(one)))
    out = np.zeros(len(sets), bool)
    if len(may):
        if not len(one):
            out[may] = True
            return out
        values = np.concatenate([sets[k] for k in may])
        place = np.minimum(np.searchsorted(one, values), len(one) - 1)
        both = np.bincount(np.repeat(np.arange(len(may)), size[may])[one[place] == values], minlength=len(may))
        out[may] = both >= similarity * (size[may] + len(one) - both)
    return out


def part_links(parts: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Pairs of places that connect all parts between which any two sets are similar."""
    label = np.unique(np.array(parts), return_inverse=True)[1]
    count = np.bincount(label)
    links = []
    largest = count.argmax()
    for at in np.argsort(count[label], kind="stable").tolist():
        if label[at] == largest:  # all others were held against it
            continue
        rest = np.flatnonzero(label != label[at])
        near = rest[similar(sets[at], [sets[k] for k in rest])]
        for other in np.unique(label[near]).tolist():
            links.append((at, int(near[label[near] == other][0])))
            mine = label[at]
            if other == largest:
                label[label == mine] = largest
            else:
                label[label == other] = mine
    return links


def _read(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, "<u8")


def _star_edges(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Verified edges (a, b) between each set and the smallest of its buckets."""
    heads = materialize(members.groupBy("bucket").agg(F.min("node").alias("head")), "heads")
    pairs = members.join(heads, "bucket").where("node <> head").select("node", "head").distinct()
    pairs = materialize(pairs.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS))), "stars")
    head = pairs.select("head", "salt").distinct().join(sets.select(F.col("node").alias("head"), F.col("blob").alias("other")), "head")
    both = pairs.join(head, ["head", "salt"]).join(sets, "node").select("node", "head", "blob", "other")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            good = [bool(similar(_read(x), [_read(y)])[0]) for x, y in zip(batch["blob"], batch["other"], strict=True)]
            yield batch.loc[good, ["node", "head"]].rename(columns={"node": "a", "head": "b"})

    return both.mapInPandas(verify, "a long, b long")


def _cells(members: DataFrame) -> DataFrame:
    """(cell, node, part): block pairs in which sets of different parts of a bucket meet."""
    parts = members.groupBy("bucket", "part").agg(F.count(F.lit(1)).alias("n"))
    own = F.col("n") > BLOCK
    mixed = parts.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("parts"), F.coalesce(F.sum(F.when(~own, F.col("n"))), F.lit(0)).alias("small")
    ).where("parts > 1")
    shape = materialize(parts.join(mixed, "bucket").select("bucket", "part", "n", "small"), "mixed")
    placed = members.join(shape, ["bucket", "part"]).select(
        "bucket", "node", "part", F.when(own, F.col("part")).alias("own"),
        F.when(own, F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / BLOCK)))
        .otherwise(F.pmod(F.xxhash64("part"), F.ceil(F.col("small") / BLOCK))).alias("block"),
    )
    placed = materialize(placed.withColumn("block", F.xxhash64(F.coalesce(F.col("own").cast("string"), F.lit("")), "block")), "placed")
    a = placed.select("bucket", "own", "block").distinct()
    b = a.select("bucket", F.col("own").alias("own2"), F.col("block").alias("block2"))
    met = a.join(b, "bucket").where("block <= block2 and (own is null or own2 is null or own <> own2)")
    cell = F.xxhash64("bucket", "block", "block2").alias("cell")
    sides = met.select("bucket", "block", cell).unionByName(met.select("bucket", F.col("block2").alias("block"), cell)).distinct()
    found = placed.join(sides, ["bucket", "block"]).select("cell", "node", "part")
    # Buckets of the same sets are compared once.
    same = found.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("s"))
    once = same.groupBy("n", "s").agg(F.min("cell").alias("cell")).select("cell")
    return materialize(found.join(once, "cell"), "cells")


def _part_edges(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Verified edges (a, b) that connect the parts of a bucket."""

    def links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None

        def within(rows: pd.DataFrame) -> pd.DataFrame:
            out = []
            for _, cell in rows.groupby("cell", sort=False):
                nodes = cell["node"].tolist()
                out += [(nodes[i], nodes[j]) for i, j in part_links(cell["part"].tolist(), [_read(z) for z in cell["blob"]])]
            return pd.DataFrame(out, columns=["a", "b"], dtype="i8")

        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            last = (rows["cell"] == rows["cell"].iloc[-1]).to_numpy() if len(rows) else np.zeros(0, bool)
            yield within(rows[~last])
            held = rows[last]
        if held is not None and len(held):
            yield within(held)

    cells = _cells(members).join(sets, "node").select("cell", "node", "part", "blob")
    return cells.repartition("cell").sortWithinPartitions("cell").mapInPandas(links, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, component_id (smallest identifier among linked rows), text_key.

    Rows are linked where their fingerprints make them candidates and their sets
    of lower-cased WORDS-word shingles have a Jaccard similarity of SIMILARITY
    or more; a shorter text is one shingle.
    Texts without words have equal, empty sets.  Null identifiers link others
    but never name a component.
    """

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingle_set(t.encode()) for t in batch["body"]]
            node = np.fromiter((xxhash.xxh64_intdigest(s.tobytes()) for s in sets), "u8", len(sets)).view("i8")
            prints = np.array([set_fingerprint(s) for s in sets], "i8").reshape(len(sets), len(PRINT))
            found = {"id": batch["id"], "text_key": batch["text_key"], "node": node}
            yield pd.DataFrame(found | {name: prints[:, k] for k, name in enumerate(PRINT)})

    def set_blob(col: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(t.encode()).tobytes() for t in col], dtype=object)

    body = F.coalesce(F.col(text_col), F.lit("")).alias("body")
    source = docs.select(F.col(id_col).cast("string").alias("id"), text_key(text_col).alias("text_key"), body)
    words = ", ".join(f"{name} long" for name in PRINT)
    prints = materialize(source.mapInPandas(made, f"id string, text_key long, node long, {words}"), "fingerprints")
    first = prints.groupBy(F.col("node").alias("rep")).agg(*[F.first(name).alias(name) for name in PRINT], F.min("text_key").alias("text_key"))
    distinct = materialize(first, "distinct-sets")
    groups = connected_components(table_links(distinct, table_keys(), RADIUS, words=PRINT))
    members = materialize(groups.select(F.col("component").alias("bucket"), "node"), "members")
    # The sets of the members alone are made again, each from one text.
    wanted = materialize(members.join(distinct, F.col("node") == F.col("rep")).select("node", "text_key"), "wanted")
    texts = among(source.select("text_key", "body"), wanted.select("text_key"), "text_key")
    joined = texts.join(wanted, "text_key").dropDuplicates(["node"])
    sets = materialize(joined.select("node", F.pandas_udf(set_blob, "binary")("body").alias("blob")), "sets")
    stars = materialize(_star_edges(members, sets), "star-edges")
    parts = connected_components(stars).select("node", F.col("component").alias("part"))
    labelled = materialize(members.join(parts, "node", "left").select("bucket", "node", F.coalesce("part", "node").alias("part")), "labelled")
    whole = connected_components(stars.unionByName(_part_edges(labelled, sets)))
    ids = prints.select(F.col("id").cast("long").alias("id"), "text_key", "node").join(whole, "node", "left")
    ids = materialize(ids.select("id", "text_key", F.coalesce("component", "node").alias("component")), "linked")
    named = ids.groupBy("component").agg(F.min("id").alias("component_id"))
    return ids.join(named, "component").select(F.col("id").alias(id_col), "component_id", "text_key")
