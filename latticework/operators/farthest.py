"""Farthest points of groups that no task should hold: blocks of rows with bounds on their distance.

Equal rows are one.  The rows of a group lie in blocks, the cells of a grid; a
block has the box around its rows and an upper bound on the distance of any of
them from the points picked so far.  After a pick, the bound of a block is at most
the distance to the farthest corner of its box; where the nearest corner is
farther than the bound, nothing has changed and the block's farthest row is
still known.  The next pick is the farthest row known, once no other block's
bound reaches it.  A round opens (reads) only blocks whose bound does, and goes on picking
until one that is not open has to be.  Blocks, bounds and picks are a table; the
driver learns whether a round is needed.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.sources.sinks import scratch

#: Rows of a block, as far as the grid is fine enough, and the most blocks of a group's grid.
BLOCK_ROWS, GRID_BLOCKS = 200, 1 << 16
#: Rows that a round opens in a group; larger cells of the grid are split.
OPEN_ROWS = 200_000
#: Folders that rows are written to, by places of the grid: a round reads those with open blocks.
FOLDERS = 64
#: Relative slack of bounds against rounding.
SLACK = 1e-9


def distances(x: np.ndarray, point: np.ndarray) -> np.ndarray:
    """From each row of x to a point, column by column."""
    total = np.zeros(len(x))
    for k in range(x.shape[1]):
        total += (x[:, k] - point[k]) ** 2
    return np.sqrt(total)


def corner_distances(lo: np.ndarray, hi: np.ndarray, point: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From a point to the nearest and to the farthest place of each box."""
    near = np.maximum(np.maximum(lo - point, point - hi), 0.0)
    far = np.maximum(np.abs(point - lo), np.abs(hi - point))
    return np.sqrt((near**2).sum(axis=1)), np.sqrt((far**2).sum(axis=1))


class Blocks:
    """The blocks of one group, with the farthest row of those where it is known."""

    def __init__(self, table: pd.DataFrame) -> None:
        self.table = table
        self.lo, self.hi = np.stack(table["lo"]), np.stack(table["hi"])
        self.bound = table["bound"].to_numpy(float).copy()
        self.known = table["known"].to_numpy(bool).copy()
        self.top = list(zip(table["key"], table["top"], strict=True))

    def picked(self, point: np.ndarray) -> None:
        near, far = corner_distances(self.lo, self.hi, point)
        touched = near * (1 - SLACK) < self.bound
        self.bound = np.where(touched, np.minimum(self.bound, far * (1 + SLACK)), self.bound)
        self.known &= ~touched

    def farthest_known(self) -> int:
        """The block of the farthest known row, of equal ones that with the smallest key; -1 if none is known."""
        at = np.flatnonzero(self.known)
        if not len(at):
            return -1
        best = at[self.bound[at] == self.bound[at].max()]
        return int(min(best, key=lambda b: self.top[b][0]))

    def farthest_unknown(self) -> int:
        at = np.flatnonzero(~self.known)
        return int(at[self.bound[at].argmax()]) if len(at) else -1


def pick_round(rows: pd.DataFrame, state: pd.DataFrame, max_samples: int, min_diff: float) -> pd.DataFrame:
    """The state of a group after the picks that its open rows allow."""
    blocks = Blocks(state[state["is_block"]].reset_index(drop=True))
    done = state[~state["is_block"]].sort_values("picked")
    points, keys, old = list(np.stack(done["top"])), list(done["key"]), len(done)
    rows = rows.sort_values("key", kind="stable")
    place = {b: i for i, b in enumerate(blocks.table["block"])}
    open_rows = {}
    for b, part in rows.groupby("block"):
        x = np.stack(part["top"])
        open_rows[place[b]] = [x, part["key"].to_numpy(), np.full(len(x), np.inf), 0]

    def look(b: int) -> None:
        """Makes the farthest row of an open block known."""
        x, own_keys, gap, seen = mine = open_rows[b]
        fresh = np.stack(points[seen:])
        # A point farther from the box than any row is from the picks changes nothing.
        near = np.sqrt((np.maximum(np.maximum(blocks.lo[b] - fresh, fresh - blocks.hi[b]), 0.0) ** 2).sum(axis=1))
        for point in fresh[near * (1 - SLACK) <= (gap.max() if seen else blocks.bound[b])]:
            gap = np.minimum(gap, distances(x, point))
        at = int(gap.argmax())
        mine[2:] = gap, len(points)
        blocks.bound[b], blocks.known[b], blocks.top[b] = gap[at], True, (own_keys[at], x[at])

    more, limit = True, max_samples or math.inf
    while True:
        best, other = blocks.farthest_known(), blocks.farthest_unknown()
        reach = blocks.bound[best] if best >= 0 else -1.0
        rival = blocks.bound[other] * (1 + SLACK) if other >= 0 else -1.0
        if len(points) >= limit or max(reach, rival) <= 0 or max(reach, rival) < min_diff:
            more = False
            break
        if rival >= reach:
            if other not in open_rows:
                break
            look(other)
            continue
        if reach <= 0 or reach < min_diff:
            more = False
            break
        key, point = blocks.top[best]
        points.append(np.asarray(point, float))
        keys.append(key)
        blocks.picked(points[-1])
    out = blocks.table
    wanted = np.zeros(len(out), bool)
    if more:
        order = np.argsort(-blocks.bound, kind="stable")  # of equal bounds the first, as farthest_unknown has it
        order = order[~blocks.known[order]]
        wanted[order[: max(1, int(np.searchsorted(out["n"].to_numpy()[order].cumsum(), OPEN_ROWS, "right")))]] = True
    out = out.assign(bound=blocks.bound, known=blocks.known, key=[k for k, _ in blocks.top], top=[t for _, t in blocks.top], open=wanted)
    new = pd.DataFrame({"key": keys[old:], "top": points[old:], "picked": range(old, len(keys))})
    new = new.assign(is_block=False, block=-1, folder=-1, n=0, bound=0.0, known=True, open=False)
    new["lo"] = new["hi"] = None
    both = [t for t in (out, done, new[out.columns.drop(["g", "more"])].assign(g=out["g"].iloc[0], more=more)) if len(t)]
    return pd.concat([t.assign(more=more)[out.columns] for t in both])


def step(rows: pd.DataFrame, state: pd.DataFrame, max_samples: int, min_diff: float) -> pd.DataFrame:
    """One round of a group: bounds from the first pick where there are none, then picks."""
    if np.isinf(state["bound"]).any():
        at = state["is_block"].to_numpy(bool)
        blocks = Blocks(state[at].reset_index(drop=True))
        blocks.picked(np.asarray(state[~at]["top"].iloc[0], float))
        state.loc[at, "bound"] = blocks.bound
    return pick_round(rows, state, max_samples, min_diff)


def _grid(stats: DataFrame, dims: int) -> DataFrame:
    """Adds ``cuts``: into how many parts each column is cut, the widest parts first."""

    def cuts(n: pd.Series, lo: pd.Series, hi: pd.Series) -> pd.Series:
        out = []
        for count, a, b in zip(n, lo, hi, strict=True):
            width, made = np.asarray(b, float) - np.asarray(a, float), np.ones(dims, int)
            while 2 * made.prod() <= min(GRID_BLOCKS, count / BLOCK_ROWS) and (width / made).max() > 0:
                made[(width / made).argmax()] *= 2
            out.append(made.tolist())
        return pd.Series(out)

    return stats.withColumn("cuts", F.pandas_udf(cuts, "array<long>")("n", "lo", "hi"))


def by_blocks(rows: DataFrame, group: Column, key: str, values: list[str], max_samples: int, min_diff: float) -> DataFrame:
    """(g, key, picked) of the rows' groups; ``group`` is a string without nulls, values have neither nulls nor NaN."""
    spark, dims = rows.sparkSession, len(values)

    def kept(df: DataFrame, tag: str, *by: str) -> DataFrame:
        path = scratch(spark, tag)
        df.write.partitionBy(*by).parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    columns = [F.col(v).cast("double").alias(v) for v in values]
    single = rows.select(group.alias("g"), F.col(key).alias("key"), *columns).groupBy("g", *values).agg(F.min("key").alias("key"))
    single = kept(single.select("g", "key", F.array(*values).alias("top")), "points")
    nth = [F.col("top")[k] for k in range(dims)]
    box = [F.array(*map(f, nth)).alias(name) for f, name in ((F.min, "lo"), (F.max, "hi"))]
    stats = kept(_grid(single.groupBy("g").agg(F.count(F.lit(1)).alias("n"), *box), dims), "grids")
    cell = F.lit(0).cast("long")
    for k, x in enumerate(nth):
        size, cuts = F.col("hi")[k] - F.col("lo")[k], F.col("cuts")[k]
        part = F.when(size > 0, F.least(F.floor((x - F.col("lo")[k]) / size * cuts), cuts - 1)).otherwise(0)
        cell = cell * cuts + part
    placed = single.join(stats, "g").select("g", "key", "top", cell.cast("long").alias("cell"))
    large = kept(placed.groupBy("g", "cell").count().where(F.col("count") > OPEN_ROWS // 4), "large-cells")
    parts = F.ceil(F.coalesce("count", F.lit(1)) / (OPEN_ROWS // 4)).cast("long")
    block = (F.col("cell") * (1 << 20) + F.pmod(F.xxhash64("key"), parts)).alias("block")
    folder = F.pmod(F.xxhash64("g", F.floor(F.col("cell") / 8)), F.lit(FOLDERS)).cast("int").alias("folder")
    dealt = placed.join(large, ["g", "cell"], "left").select("g", "key", "top", block, folder)
    dealt = kept(dealt.repartition("folder", F.pmod("block", F.lit(16))), "blocks", "folder")

    first = single.groupBy("g").agg(F.min(F.struct(F.col("top")[0], "key", "top")).alias("r")).select("g", "r.key", "r.top")
    boxes = dealt.groupBy("g", "block", "folder").agg(F.count(F.lit(1)).alias("n"), *box)
    state = boxes.select(
        "g", F.lit(True).alias("is_block"), F.lit(None).cast(dict(single.dtypes)["key"]).alias("key"), F.lit(None).cast("array<double>").alias("top"),
        F.lit(-1).alias("picked"), "block", "folder", "n", "lo", "hi", F.lit(float("inf")).alias("bound"), F.lit(False).alias("known"),
        F.lit(False).alias("open"), F.lit(True).alias("more"),
    )
    start = first.select(
        "g", F.lit(False).alias("is_block"), "key", "top", F.lit(0).alias("picked"), F.lit(-1).cast("long").alias("block"), F.lit(-1).alias("folder"),
        F.lit(0).cast("long").alias("n"), F.lit(None).cast("array<double>").alias("lo"), F.lit(None).cast("array<double>").alias("hi"),
        F.lit(0.0).alias("bound"), F.lit(True).alias("known"), F.lit(False).alias("open"), F.lit(True).alias("more"),
    )
    schema = ", ".join(f"{n} {t}" for n, t in state.dtypes)

    def rounded(opened: pd.DataFrame, now: pd.DataFrame) -> pd.DataFrame:
        return step(opened, now, max_samples, min_diff) if len(now) else now

    found, nothing = scratch(spark, "picks"), dealt.where("false")
    state = state.unionByName(start)
    opened = nothing
    while True:
        # Picks first, so that every task holds the open rows, blocks and picks of one group.
        state = kept(opened.groupBy("g").cogroup(state.groupBy("g")).applyInPandas(rounded, schema), "state")
        state.where("not more and not is_block").select("g", "key", "picked").write.mode("append").parquet(found)
        state = state.where("more")
        if state.isEmpty():
            return spark.read.schema(state.select("g", "key", "picked").schema).parquet(found)
        opened = dealt.join(F.broadcast(state.where("open").select("folder", "g", "block")), ["folder", "g", "block"])
