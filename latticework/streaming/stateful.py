"""Running sums kept in the state store: moments of targets and Gram tiles.

Each task of a micro-batch first adds up its own rows, so a key receives a row
per task, whatever its share of the rows; a stateful processor merges these into
the state, which outlives a restart with the query's checkpoint.  Changed
states are written under the number of their micro-batch, which a repeated
batch replaces; the newest row of a key is its value.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from latticework.operators.tiles import TILE, partial_tiles

_MOMENTS = "n long, mean double, m2 double"


def merged(a: tuple[int, float, float], b: tuple[int, float, float]) -> tuple[int, float, float]:
    """Count, mean and sum of squared deviations of two sets together."""
    n = a[0] + b[0]
    if not n:
        return a
    d = b[1] - a[1]
    return n, a[1] + d * b[0] / n, a[2] + b[2] + d * d * a[0] * b[0] / n


class MomentState(StatefulProcessor):
    """Merges partial moments into those of a kind."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("moments", _MOMENTS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        total = tuple(self.state.get()) if self.state.exists() else (0, 0.0, 0.0)
        for batch in rows:
            for part in batch[["n", "mean", "m2"]].itertuples(index=False, name=None):
                total = merged(total, part)
        self.state.update(tuple(total))
        n, mean, m2 = total
        yield pd.DataFrame([(*key, n, mean, float(np.sqrt(m2 / n)) if n else None)], columns=["kind", "n", "mean", "std"])

    def close(self) -> None:
        pass


class TileState(StatefulProcessor):
    """Adds partial tiles to the one of their key."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("tile", "tile array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = [np.asarray(t, float) for batch in rows for t in batch["tile"]]
        if self.state.exists():
            parts.append(np.asarray(self.state.get()[0], float))
        total = np.sum(parts, axis=0)
        self.state.update((total.tolist(),))
        yield pd.DataFrame([(*key, total)], columns=["kind", "bi", "bj", "tile"])

    def close(self) -> None:
        pass


def partial_moments(rows: DataFrame, kind: str, value: str) -> DataFrame:
    """(kind, n, mean, m2) of each task's rows; null and NaN values are left out."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, tuple] = {}
        for batch in batches:
            for name, part in batch.groupby(kind, sort=False, dropna=False)[value]:
                x = part.to_numpy(float)
                x = x[~np.isnan(x)]
                if len(x):
                    own = (len(x), float(x.mean()), float(((x - x.mean()) ** 2).sum()))
                    total[name] = merged(total.get(name, (0, 0.0, 0.0)), own)
        yield pd.DataFrame([(k, *v) for k, v in total.items()], columns=["kind", "n", "mean", "m2"])

    return rows.select(kind, value).mapInPandas(add, "kind string, " + _MOMENTS)


def moment_updates(rows: DataFrame, kind: str, value: str) -> DataFrame:
    """A stream of (kind, n, mean, std): the kinds that a micro-batch has changed, over all rows so far."""
    parts = partial_moments(rows, kind, value)
    return parts.groupBy("kind").transformWithStateInPandas(MomentState(), "kind string, n long, mean double, std double", "Update", "None")


def gram_updates(rows: DataFrame, side: int = TILE) -> DataFrame:
    """A stream of (kind, bi, bj, tile): the Gram tiles that a micro-batch of ``tiles.gathered`` rows has changed."""
    parts = partial_tiles(rows, ("kind",), side)
    return parts.groupBy("kind", "bi", "bj").transformWithStateInPandas(TileState(), "kind string, bi int, bj int, tile array<double>", "Update", "None")


@contextmanager
def _rocks(spark: SparkSession):
    """Stateful processors need RocksDB as state store; a query keeps the one that it starts with."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def write_updates(updates: DataFrame, path: str, checkpoint: str):
    """Write a stream's updates by micro-batch until its input is used up; ``newest`` reads them."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    with _rocks(updates.sparkSession):
        stream = updates.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
        query = stream.trigger(availableNow=True).start()
        query.awaitTermination()
    return query


def newest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Of each key the row of the latest micro-batch."""
    rows = spark.read.parquet(path)
    others = [c for c in rows.columns if c not in (*keys, "batch")]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("r"))
    return last.select(*keys, "r.*")
