"""Merkle manifest of a dataset, its hash trees in van Emde Boas layout.

Records are leaves of one tree per group (eight children a node), and the roots
of the groups are leaves of a last tree.  A tree is cut into aligned blocks of
BLOCK_LEVELS levels.  A block is one row; its digests lie in van Emde Boas
order: the levels are split at half height, the upper half comes first, then
the lower subtrees one by one, each laid out the same way.  Address arithmetic
alone finds a node, for construction and for the siblings of a proof.  The roots
of blocks are the leaves of the next round of blocks, until one is left.

Records are numbered within their group by range partitions, so no group has to
fit a task; a task holds one block.  Proofs go the other way: a block hands each
of its leaves the siblings on the way up, and the blocks below add theirs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .ordered import numbered

ARITY = 8
#: Levels of edges in a block: 4,096 leaves, 150 KB of digests.
BLOCK_LEVELS = 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def tree_size(levels: int) -> int:
    """Nodes of a full tree of so many levels."""
    return (ARITY**levels - 1) // (ARITY - 1)


def address(levels: int, depth: int, i: int) -> int:
    """Place of the i-th node at a depth of a full tree of ``levels`` levels in van Emde Boas order."""
    base = 0
    while levels > 1:
        upper = levels // 2
        if depth < upper:
            levels = upper
            continue
        levels, depth = levels - upper, depth - upper
        subtree, i = divmod(i, ARITY**depth)
        base += tree_size(upper) + subtree * tree_size(levels)
    return base


_known: dict[tuple[int, int], list[int]] = {}


def addresses(levels: int, depth: int) -> list[int]:
    """The places of a depth, remembered by plain means: a caching wrapper does not travel by value."""
    if (levels, depth) not in _known:
        _known[levels, depth] = [address(levels, depth, i) for i in range(ARITY**depth)]
    return _known[levels, depth]


def height_of(n: int) -> int:
    """Levels of edges above n leaves."""
    h = 0
    while ARITY**h < n:
        h += 1
    return h


def sha256_hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


class Block:
    """An aligned subtree: hex digests in van Emde Boas order, trailing unused places left out."""

    def __init__(self, leaves: int, height: int, nodes: list[str]) -> None:
        self.leaves, self.height, self.nodes = leaves, height, nodes

    @classmethod
    def build(cls, digests: list[str], height: int) -> Block:
        nodes = [""] * tree_size(height + 1)
        row, used = digests, 0
        for depth in range(height, -1, -1):
            places = addresses(height + 1, depth)
            for place, digest in zip(places, row, strict=False):
                nodes[place] = digest
            used = max(used, max(places[: len(row)]) + 1)
            row = [sha256_hex("".join(row[i : i + ARITY])) for i in range(0, len(row), ARITY)]
        return cls(len(digests), height, nodes[:used])

    @classmethod
    def read(cls, leaves: int, height: int, blob: bytes) -> Block:
        text = blob.hex()
        return cls(leaves, height, [text[i : i + 64] for i in range(0, len(text), 64)])

    def packed(self) -> bytes:
        return bytes.fromhex("".join(x or "0" * 64 for x in self.nodes))

    def row(self, depth: int) -> list[str]:
        """The digests at a depth, from the left."""
        count = self.leaves
        for _ in range(self.height - depth):
            count = -(-count // ARITY)
        return [self.nodes[a] for a in addresses(self.height + 1, depth)[:count]]

    def siblings(self) -> Iterator[tuple[list[str], list[str]]]:
        """For each leaf, the texts of the siblings left and right of its way up, from the lowest level."""
        above: list[tuple[list[str], list[str]]] = [([], [])]
        for depth in range(1, self.height + 1):
            row, below = self.row(depth), []
            for run, (lefts, rights) in enumerate(above):
                text = "".join(row[run * ARITY : (run + 1) * ARITY])
                below += [([text[:at], *lefts], [text[at + 64 :], *rights]) for at in range(0, len(text), 64)]
            above = below
        return iter(above)


def fold(digest: str, lefts: list[str], rights: list[str]) -> str:
    """The root that a leaf and its siblings give."""
    for left, right in zip(lefts, rights, strict=True):
        digest = sha256_hex(left + digest + right)
    return digest


_BLOCKS = "tree string, block long, n long, height int, leaves int, nodes binary, top binary, ids array<string>, others array<binary>"


def _blocks(rows: DataFrame, tag: str) -> DataFrame:
    """(tree, pos, n, digest, id, other) -> one row per block of ``_BLOCKS``."""
    size = ARITY**BLOCK_LEVELS

    def build(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pos")
        n = int(group["n"].iloc[0])
        height = BLOCK_LEVELS if n > size else height_of(n)
        made = Block.build([x.hex() for x in group["digest"]], height)
        row = (*key, n, height, made.leaves, made.packed(), bytes.fromhex(made.nodes[0]), list(group["id"]), list(group["other"]))
        return pd.DataFrame([row], columns=["tree", "block", "n", "height", "leaves", "nodes", "top", "ids", "others"])

    placed = rows.withColumn("block", F.floor(F.col("pos") / size).cast("long"))
    return materialize(placed.groupBy("tree", "block").applyInPandas(build, _BLOCKS), tag)


def build_forest(leaves: DataFrame, tag: str) -> tuple[list[DataFrame], DataFrame]:
    """Trees over (tree, pos, n, digest, id, other): the blocks of each round, and (tree, top).

    A round makes 4,096 times fewer rows; nothing but whether a round is needed
    comes to the driver.
    """
    rounds, tops, rows = [], None, leaves
    while True:
        made = _blocks(rows, f"{tag}-{len(rounds)}")
        rounds.append(made)
        tall = made.where(F.col("n") > ARITY**BLOCK_LEVELS)
        done = made.where(F.col("n") <= ARITY**BLOCK_LEVELS).select("tree", "top")
        tops = done if tops is None else tops.unionByName(done)
        if tall.isEmpty():
            return rounds, tops
        rows = tall.select(
            "tree", F.col("block").alias("pos"), F.ceil(F.col("n") / ARITY**BLOCK_LEVELS).cast("long").alias("n"),
            F.col("top").alias("digest"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("binary").alias("other"),
        )


_PATH = ["lefts", "rights", "subroot", "root"]
_PATHS = "tree string, block long, lefts array<string>, rights array<string>, subroot string, root string"


def _hand_down(blocks: DataFrame) -> DataFrame:
    """Blocks with their paths -> the paths of their leaves, which are the blocks of the round before."""

    def paths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                made = Block.read(row.leaves, row.height, row.nodes)
                first, up = row.block * ARITY**BLOCK_LEVELS, (list(row.lefts), list(row.rights))
                ways = enumerate(made.siblings(), first)
                out = [(row.tree, i, left + up[0], right + up[1], row.subroot, row.root) for i, (left, right) in ways]
                yield pd.DataFrame(out, columns=["tree", "block", *_PATH])

    return blocks.select("tree", "block", "height", "leaves", "nodes", *_PATH).mapInPandas(paths, _PATHS)


def block_paths(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """The blocks of the first round with their paths, from the paths (tree, ``_PATH``) of the trees' tops."""
    size, found = ARITY**BLOCK_LEVELS, None
    for made in reversed(rounds):
        whole = made.where(F.col("n") <= size).join(above, "tree")
        if found is not None:
            whole = whole.unionByName(made.where(F.col("n") > size).join(_hand_down(found), ["tree", "block"]))
        found = whole
    return found


def record_digest(text: Column | None = None) -> Column:
    """SHA-256 (binary) of a record's fields, each with its length in bytes; a null is a dash."""
    parts = []
    for name in FIELDS:
        value = text if name == "text" and text is not None else F.col(name).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts), 256))


def manifest_proofs(docs: DataFrame, tampered: Column, *, group: str = "lang") -> DataFrame:
    """The manifest of ``docs`` with each record's proof, and what a tampered copy gives against it.

    Leaves ascend by doc_id in the tree of their group (null first; equal ones
    by digest, so repeated rows are leaves of their own), group roots by the
    group's UTF-8 bytes (null first) in the last tree.  ``tampered`` is the text
    as received: a leaf made with it is folded with the true siblings.  A null in any
    field is a dash; an empty table has no rows.  Other columns are ignored.
    """
    id_type = dict(docs.select("doc_id").dtypes)["doc_id"]
    leaf, other = record_digest(), record_digest(tampered)
    tree = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-")).alias("tree")  # "-" sorts before "="
    records = docs.select(tree, "doc_id", leaf.alias("digest"), other.alias("other"))
    records = records.withColumn("other", F.when(F.col("other") != F.col("digest"), F.col("other")))
    order = [F.asc_nulls_first("doc_id"), F.asc("digest")]
    placed = numbered(records, "tree", order, "leaves").withColumn("id", F.col("doc_id").cast("string"))
    rounds, tops = build_forest(placed.select("tree", "pos", "n", "digest", "id", "other"), "blocks")

    # The trees' tops, in the order of their names, are the leaves of the last tree.
    named = tops.select(F.lit("").alias("all"), F.col("tree").alias("id"), F.col("top").alias("digest"))
    last = numbered(named, "all", [F.asc("id")], "tops").withColumnRenamed("all", "tree")
    top_rounds, root = build_forest(last.select("tree", "pos", "n", "digest", "id", F.lit(None).cast("binary").alias("other")), "top")
    nothing = F.array().cast("array<string>")
    start = root.select(
        "tree", nothing.alias("lefts"), nothing.alias("rights"), F.lit("").alias("subroot"), F.lower(F.hex("top")).alias("root")
    )
    return _record_proofs(block_paths(rounds, _tree_paths(block_paths(top_rounds, start))), id_type)


def _tree_paths(blocks: DataFrame) -> DataFrame:
    """Blocks of the last tree -> (tree, ``_PATH``) of each tree below it."""

    def paths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                made, up = Block.read(row.leaves, row.height, row.nodes), (list(row.lefts), list(row.rights))
                below = zip(row.ids, made.row(made.height), made.siblings(), strict=True)
                out = [(tree, left + up[0], right + up[1], top, row.root) for tree, top, (left, right) in below]
                yield pd.DataFrame(out, columns=["tree", *_PATH])

    schema = "tree string, lefts array<string>, rights array<string>, subroot string, root string"
    return blocks.select("height", "leaves", "nodes", "ids", "lefts", "rights", "root").mapInPandas(paths, schema)


_PROOFS = "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _record_proofs(blocks: DataFrame, id_type: str) -> DataFrame:
    def prove(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                made, up = Block.read(row.leaves, row.height, row.nodes), (list(row.lefts), list(row.rights))
                rest = "".join(a + b for a, b in zip(*up, strict=True))
                out = []
                for doc, other, leaf, (lefts, rights) in zip(row.ids, row.others, made.row(made.height), made.siblings(), strict=True):
                    proof = sha256_hex("".join(a + b for a, b in zip(lefts, rights, strict=True)) + rest)
                    found = fold(leaf if other is None else other.hex(), lefts + up[0], rights + up[1])
                    out.append((doc, leaf, row.subroot, row.root, proof, found, found == row.root))
                yield pd.DataFrame(out, columns=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    wanted = ["height", "leaves", "nodes", "ids", "others", "lefts", "rights", "subroot", "root"]
    return blocks.select(*wanted).mapInPandas(prove, _PROOFS).withColumn("doc_id", F.col("doc_id").cast(id_type))


def lower_cased_third(docs: DataFrame) -> Column:
    """The text, with A-Z lower-cased where 3 divides the CRC-32 of the identifier."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return F.when(hit, F.translate(docs["text"], UPPER, LOWER)).otherwise(docs["text"])
