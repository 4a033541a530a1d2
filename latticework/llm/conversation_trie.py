"""Prefix trie of rebuilt conversations by composable fingerprints.

A sequence of turns has the fingerprint (length, sum of a_i B^i mod p), where
a_i hashes turn i; two such products are composed by x + B^length(x) y.  A
conversation that is rebuilt from the head of its base and its own later turns
gets the fingerprints of all its prefixes from the running products of the two,
composed symbolically: its text is never put together.  Prefixes with equal
depth and fingerprint are a node.

A node is right if its members' last turns are equal and the nodes before them
are one; then, from the root on, equal fingerprints mean equal sequences.  Both
are checked: the first on digests of turns, each of which is held against the
text of the stored turn that its digest refers to.  Should a check ever fail,
all is done again with other bases and digests.

Running products are local to range partitions; a conversation that spans
several composes the products of its pieces.  Sums over subtrees double the
distance to the ancestor that they are added to, so a trie of depth d takes
log d rounds of one combinable aggregate each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, shuffle_width
from .ordered import sorted_parts

#: Conversations of a hundred share a base; at most five turns of it are a head.
BASE_EVERY, HEADS = 100, 6
#: Identifiers in one piece of a list that is hashed in order.
PIECE_IDS = 4096
#: Rows of (partition, conversation) where a conversation spans partitions are at most twice the partitions.


def primes(seed: int) -> tuple[int, int]:
    return 2**61 - 1, 2**61 - 1


def bases(seed: int) -> tuple[int, int]:
    """Bases of the two products, drawn by the seed."""
    return tuple(1 + int.from_bytes(hashlib.sha256(f"{seed}/{i}".encode()).digest()) % (p - 1) for i, p in enumerate(primes(seed)))


class Products:
    """The monoid of (length, x, y): x and y are sums of a_i B^i under two bases."""

    def __init__(self, seed: int) -> None:
        self.bases, self.primes = bases(seed), primes(seed)

    def powers(self, n: int) -> tuple[int, int]:
        return tuple(pow(b, n, p) for b, p in zip(self.bases, self.primes, strict=True))

    def turn(self, digest: bytes) -> tuple[int, int]:
        """The values of one turn."""
        return tuple(1 + int.from_bytes(digest[8 * i : 8 * i + 8]) % (p - 1) for i, p in enumerate(self.primes))

    def compose(self, length: int, left: tuple[int, int], right: tuple[int, int]) -> tuple[int, int]:
        """Left, of so many turns, followed by right."""
        return tuple((a + w * b) % p for a, b, w, p in zip(left, right, self.powers(length), self.primes, strict=True))

    def suffix(self, length: int, whole: tuple[int, int], head: tuple[int, int]) -> tuple[int, int]:
        """What follows a head of so many turns in a whole."""
        return tuple((a - b) * w % p for a, b, w, p in zip(whole, head, self.powers(-length), self.primes, strict=True))


def _scan(seed: int):
    """Running products within each conversation's run of a sorted partition; texts pass through untouched."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Products(seed)
        (b1, b2), (p1, p2) = made.bases, made.primes
        now, k, x, y, w1, w2 = None, 0, 0, 0, 1, 1
        for batch in batches:
            out = []
            for conv, digest in zip(batch["conv_id"].to_pylist(), batch["digest"].to_pylist(), strict=True):
                if conv != now:
                    now, k, x, y, w1, w2 = conv, 0, 0, 0, 1, 1
                a1, a2 = made.turn(digest)
                before = (k, x, y)
                k, x, y, w1, w2 = k + 1, (x + a1 * w1) % p1, (y + a2 * w2) % p2, w1 * b1 % p1, w2 * b2 % p2
                out.append((*before, x, y))
            names = ["k", "x0", "y0", "x1", "y1"]
            added = np.array(out, "i8").reshape(-1, len(names)).T
            columns = [*batch.columns, *(pa.array(c) for c in added)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *names])

    def applied(rows: DataFrame) -> DataFrame:
        schema = ", ".join(f"{n} {t}" for n, t in rows.dtypes) + ", k long, x0 long, y0 long, x1 long, y1 long"
        return rows.mapInArrow(scan, schema)

    return applied


def _carried(parts: DataFrame, seed: int) -> DataFrame:
    """(conv_id, _lw_part, k_before, xb, yb): products of a conversation's earlier pieces, where it spans partitions."""
    edges = parts.groupBy("_lw_part").agg(F.min("conv_id").alias("lo"), F.max("conv_id").alias("hi"))
    pieces = edges.select("_lw_part", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("conv_id"))
    many = pieces.groupBy("conv_id").count().where("count > 1").select("conv_id")
    ends = (
        parts.join(F.broadcast(pieces.join(many, "conv_id")), ["conv_id", "_lw_part"])  # two rows a partition at most
        .groupBy("conv_id", "_lw_part")
        .agg(F.count(F.lit(1)).alias("n"), F.max_by(F.struct("x1", "y1"), "_lw_place").alias("p"))
        .select("conv_id", "_lw_part", "n", "p.x1", "p.y1")
    )

    def carry(pdf: pd.DataFrame) -> pd.DataFrame:
        made, k, p, out = Products(seed), 0, (0, 0), []
        for conv, part, n, x, y in pdf.sort_values("_lw_part").itertuples(index=False):
            out.append((conv, part, k, *p))
            k, p = k + n, made.compose(k, p, (x, y))
        return pd.DataFrame(out, columns=["conv_id", "_lw_part", "k_before", "xb", "yb"])

    carried = ends.groupBy("conv_id").applyInPandas(carry, "conv_id long, _lw_part int, k_before long, xb long, yb long")
    return materialize(carried, "carried")


_PRODUCT = "x long, y long"


def _following(seed: int):
    """(length, left x, y, right x, y) -> left followed by right."""

    def following(length: pd.Series, lx: pd.Series, ly: pd.Series, rx: pd.Series, ry: pd.Series) -> pd.DataFrame:
        made = Products(seed)
        rows = zip(length.tolist(), lx.tolist(), ly.tolist(), rx.tolist(), ry.tolist(), strict=True)
        return pd.DataFrame([made.compose(n, (a, b), (c, d)) for n, a, b, c, d in rows], columns=["x", "y"], dtype="i8")

    return F.pandas_udf(following, _PRODUCT)


def _rebuilt(seed: int):
    """(turns of the head, its x, y, turns cut from the own ones, their x, y, own x, y) -> head, then own turns after the cut."""

    def rebuilt(n: pd.Series, hx: pd.Series, hy: pd.Series, cut: pd.Series, cx: pd.Series, cy: pd.Series, x: pd.Series, y: pd.Series) -> pd.DataFrame:
        made, out = Products(seed), []
        for n_, hx_, hy_, cut_, cx_, cy_, x_, y_ in zip(*(s.tolist() for s in (n, hx, hy, cut, cx, cy, x, y)), strict=True):
            out.append(made.compose(n_, (hx_, hy_), made.suffix(cut_, (x_, y_), (cx_, cy_))))
        return pd.DataFrame(out, columns=["x", "y"], dtype="i8")

    return F.pandas_udf(rebuilt, _PRODUCT)


def head_length(conv_id: Column) -> Column:
    """Turns that a conversation takes from its base."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % HEADS).cast("int")


def stored_turns(conversations: DataFrame, seed: int) -> DataFrame:
    """(conv_id, k, role, text, digest, chars, x0, y0, x1, y1): turns in order with the products before and after each.

    (conv_id, k) is the reference of a turn.  Rows without conv_id belong to no
    conversation.  Turns ascend (null first; equal ones by role and text); a
    null role or text is empty.
    """
    role, text = F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role, text)
    named = F.concat(F.lit(f"{seed}/"), F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    rows = rows.withColumn("digest", F.unhex(F.sha2(named, 256))).withColumn("chars", F.char_length("text").cast("long"))
    order = [F.asc_nulls_first("turn"), F.asc("role"), F.asc("text")]
    parts = sorted_parts(rows, "conv_id", order, "turns", _scan(seed)).drop("turn")
    joined = parts.join(F.broadcast(_carried(parts, seed)), ["conv_id", "_lw_part"], "left").drop("_lw_part", "_lw_place")
    alone = joined.where("k_before is null").drop("k_before", "xb", "yb")
    follow = _following(seed)
    later = joined.where("k_before is not null")
    later = later.withColumn("p0", follow("k_before", "xb", "yb", "x0", "y0")).withColumn("p1", follow("k_before", "xb", "yb", "x1", "y1"))
    later = later.withColumns(
        {"k": F.col("k") + F.col("k_before"), "x0": F.col("p0.x"), "y0": F.col("p0.y"), "x1": F.col("p1.x"), "y1": F.col("p1.y")}
    )
    return materialize(alone.unionByName(later.select(*alone.columns)), "stored-turns")


def same_turns(turns: DataFrame) -> bool:
    """Whether turns with one digest have one role and text: each is held against the stored turn that the digest refers to."""
    ref = F.struct("conv_id", "k")
    first = turns.groupBy("digest").agg(F.min(ref).alias("ref"), F.count(F.lit(1)).alias("n")).where("n > 1")
    firsts = first.select(F.col("ref.conv_id").alias("conv_id"), F.col("ref.k").alias("k"))
    stored = turns.select("conv_id", "k", "digest", F.col("role").alias("r"), F.col("text").alias("t")).join(firsts, ["conv_id", "k"])
    stored = materialize(stored.select("digest", "r", "t"), "first-turns")
    return turns.join(stored, "digest").where("role <> r or text <> t").isEmpty()


def prefixes(turns: DataFrame, seed: int) -> DataFrame:
    """(conv_id, depth, len, x, y, px, py, digest, chars): every prefix of every rebuilt conversation.

    px, py are the product one turn before; the root has depth 0.
    """
    h = head_length(F.col("conv_id"))
    convs = turns.groupBy("conv_id").agg(
        (F.max("k") + 1).alias("own"), F.max(F.when(F.col("k") == h - 1, F.struct("x1", "y1"))).alias("cut")
    )
    taken = F.struct("k", "x0", "y0", "x1", "y1", "digest", "chars")
    heads = turns.where((F.col("conv_id") % BASE_EVERY == 0) & (F.col("k") < HEADS - 1))
    heads = heads.groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(taken)).alias("head"))  # five at most
    whole = convs.withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % BASE_EVERY).join(heads, "base", "left")
    whole = whole.withColumn("head", F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.slice("head", 1, 0), F.expr("array()")))
    last = F.element_at("head", -1)
    whole = whole.withColumn("n", F.size("head"))
    whole = whole.select(
        "conv_id", "h", "n", "head", F.coalesce(F.when(F.col("n") > 0, last["x1"]), F.lit(0)).alias("hx"),
        F.coalesce(F.when(F.col("n") > 0, last["y1"]), F.lit(0)).alias("hy"),
        F.coalesce("cut.x1", F.lit(0)).alias("cx"), F.coalesce("cut.y1", F.lit(0)).alias("cy"),
        (F.col("n") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).cast("long").alias("len"),
    )
    whole = materialize(whole, "rebuilt")
    zero = F.lit(0).cast("long")
    root = whole.select(
        "conv_id", zero.alias("depth"), "len", zero.alias("x"), zero.alias("y"), zero.alias("px"), zero.alias("py"),
        F.lit(b"").alias("digest"), zero.alias("chars"),
    )
    from_base = whole.select("conv_id", "len", F.explode("head").alias("t")).select(
        "conv_id", (F.col("t.k") + 1).alias("depth"), "len", F.col("t.x1").alias("x"), F.col("t.y1").alias("y"),
        F.col("t.x0").alias("px"), F.col("t.y0").alias("py"), "t.digest", "t.chars",
    )
    product, head = _rebuilt(seed), ["n", "hx", "hy", "h", "cx", "cy"]
    own = (
        turns.drop("role", "text").join(whole.drop("head"), "conv_id").where("k >= h")
        .withColumn("p", product(*head, "x1", "y1"))
        .withColumn("q", product(*head, "x0", "y0"))
    )
    own = own.select(
        "conv_id", (F.col("n") + F.col("k") - F.col("h") + 1).alias("depth"), "len", F.col("p.x").alias("x"), F.col("p.y").alias("y"),
        F.col("q.x").alias("px"), F.col("q.y").alias("py"), "digest", "chars",
    )
    return materialize(root.unionByName(from_base).unionByName(own), "prefixes")


def _ends(rows: DataFrame) -> DataFrame:
    """(depth, x, y, conv_id) of conversations that end at a node -> (depth, x, y, ends_sha256).

    Identifiers are sorted over range partitions and joined in pieces; only the
    pieces of a node meet, and are hashed one after the other as they come.
    """
    key = ["x", "y", "depth"]

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, []
        columns = [*key, "first", "piece"]

        def close() -> list[tuple]:
            return [(*now, held[0], ",".join(map(str, held)))] if held else []

        for batch in batches:
            out = []
            for x, y, depth, conv in batch[[*key, "conv_id"]].itertuples(index=False, name=None):
                if (x, y, depth) != now or len(held) >= PIECE_IDS:
                    out += close()
                    now, held = (x, y, depth), []
                held.append(conv)
            yield pd.DataFrame(out, columns=columns)
        yield pd.DataFrame(close(), columns=columns)

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, digest = None, None
        columns = [*key, "ends_sha256"]
        for batch in batches:
            out = []
            for x, y, depth, piece in batch[[*key, "piece"]].itertuples(index=False, name=None):
                if (x, y, depth) != now:
                    if now:
                        out.append((*now, digest.hexdigest()))
                    now, digest = (x, y, depth), hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(piece.encode())
            yield pd.DataFrame(out, columns=columns)
        yield pd.DataFrame([(*now, digest.hexdigest())] if now else [], columns=columns)

    width, own = shuffle_width(rows.sparkSession), "x long, y long, depth long, "
    spread = rows.repartitionByRange(width, *key, "conv_id").sortWithinPartitions(*key, "conv_id")
    joined = spread.mapInPandas(pieces, own + "first long, piece string")
    return joined.repartition(*key).sortWithinPartitions(*key, "first").mapInPandas(hashed, own + "ends_sha256 string")


def subtree_sums(nodes: DataFrame, values: list[str], deepest: int) -> DataFrame:
    """(conv_id, depth, parent, values) -> the values summed over each node's subtree.

    After a round, a node holds the sum over descendants nearer than ``step``
    and knows its ancestor at that distance.
    """
    now, step = nodes.select("conv_id", "depth", F.col("parent").alias("up"), *values), 1
    while step <= deepest:
        given = (
            now.where("up is not null")
            .groupBy(F.col("up").alias("conv_id"), (F.col("depth") - step).alias("depth"))
            .agg(*(F.sum(v).alias(f"{v}_more") for v in values))
        )
        far = now.where(F.col("depth") >= step).select(F.col("conv_id").alias("up"), (F.col("depth") + step).alias("depth"), F.col("up").alias("far"))
        linked = now.where(F.col("depth") >= 2 * step).join(far, ["up", "depth"])
        near = now.where(F.col("depth") < 2 * step).withColumn("far", F.lit(None).cast("long"))
        moved = near.unionByName(linked).join(given, ["conv_id", "depth"], "left")
        sums = (F.expr(f"{v} + coalesce({v}_more, 0)").alias(v) for v in values)
        now, step = materialize(moved.select("conv_id", "depth", F.col("far").alias("up"), *sums), "subtree-sums"), 2 * step
    return now.drop("up")


def prefix_trie(conversations: DataFrame, *, seed: int = 0) -> DataFrame:
    """The nodes of the trie of rebuilt conversations.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256.  A conversation without turns after
    the rebuilding is a member of the root alone; an empty table has no nodes,
    not even a root.  Order, nulls and ties as in ``stored_turns``.  Other columns are
    ignored.
    """
    while True:
        turns = stored_turns(conversations, seed)
        members = prefixes(turns, seed)
        nodes = materialize(
            members.groupBy("depth", "x", "y").agg(
                F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("chars").alias("chars"),
                F.min(F.struct("px", "py")).alias("before"), F.max(F.struct("px", "py")).alias("before_too"),
                F.min("digest").alias("turn"), F.max("digest").alias("turn_too"),
            ),
            "nodes",
        )
        if nodes.where("before <> before_too or turn <> turn_too").isEmpty() and same_turns(turns):
            break
        seed += 1
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.struct("x", "y").alias("before"), F.col("conv_id").alias("parent"))
    linked = materialize(nodes.where("depth > 0").join(above, ["depth", "before"]).select("depth", "x", "y", "parent"), "parents")
    children = linked.groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("conv_id")).agg(F.count(F.lit(1)).alias("n_children"))
    ends = _ends(members.where("depth = len").select("depth", "x", "y", "conv_id"))
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    full = materialize(
        nodes.join(linked, ["depth", "x", "y"], "left").join(ends, ["depth", "x", "y"], "left").join(children, ["depth", "conv_id"], "left")
        .select(
            "conv_id", "depth", "parent", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
            F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("n_leaves"),
            ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"), F.coalesce("ends_sha256", empty).alias("ends_sha256"),
        ),
        "trie",
    )
    deepest = full.agg(F.max("depth")).first()[0] or 0
    sums = subtree_sums(full.select("conv_id", "depth", "parent", "n_leaves", "saved_tokens"), ["n_leaves", "saved_tokens"], deepest)
    return full.drop("n_leaves", "saved_tokens").join(sums, ["conv_id", "depth"]).select(
        "conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    )
