"""Registration, merging, filters and key sets over tables of configurations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from .sampling import farthest_points, uniform

REQUIRED = ("config_id", "energy", "size")
FORCE = ("fx", "fy", "fz")


def prefixed_key(prefix: Column, seq: Column) -> Column:
    """Row key ``prefix_seq``."""
    return F.concat_ws("_", prefix, seq.cast("string"))


def register(catalogue: DataFrame, dataset: DataFrame, prefix: str, *, overwrite: bool = False) -> DataFrame:
    """Adds a dataset under a prefix; where the prefix is taken it is skipped, or replaced with ``overwrite``."""
    missing = [c for c in REQUIRED if c not in dataset.columns]
    if missing:
        raise ValueError(f"dataset lacks {missing}")
    new = dataset.withColumn("prefix", F.lit(prefix))
    names = catalogue.where(F.col("prefix") == prefix).select("prefix").distinct()
    if overwrite:
        return catalogue.where(F.col("prefix") != prefix).unionByName(new, allowMissingColumns=True)
    return catalogue.unionByName(new.join(F.broadcast(names), "prefix", "left_anti"), allowMissingColumns=True)


def consolidate(datasets: Sequence[DataFrame], key: str = "config_id", keep: str | None = "last", order: str | None = None) -> DataFrame:
    """Union of datasets with one row per key: the first, the last, or (None) only unique keys.

    Datasets count in the order given, rows within one by ``order`` and then by
    all their columns, so the choice does not hang on how rows are placed.
    """
    tagged = [d.withColumn("load_order", F.lit(i)) for i, d in enumerate(datasets)]
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    if keep is None:
        return union.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(key))).where("_n = 1").drop("_n")
    rest = [c for c in union.columns if c not in ("load_order", order)]
    columns = [F.col(c) for c in ("load_order", *([order] if order else []))] + [F.to_json(F.struct(*rest))]
    ranked = Window.partitionBy(key).orderBy(*[c.desc() if keep == "last" else c for c in columns])
    return union.withColumn("_n", F.row_number().over(ranked)).where("_n = 1").drop("_n")


def max_forces(atoms: DataFrame) -> DataFrame:
    """(config_id, max_force): the largest force norm of each configuration."""
    f = F.sqrt(sum((F.col(c) * F.col(c) for c in FORCE), F.lit(0.0)))
    return atoms.groupBy("config_id").agg(F.max(f).alias("max_force"))


def filter_max_forces(configs: DataFrame, atoms: DataFrame, cutoff: float = 10.0) -> DataFrame:
    """Configurations whose largest force is at most ``cutoff``, with that force."""
    return configs.join(max_forces(atoms).where(F.col("max_force") <= cutoff), "config_id")


def with_size(configs: DataFrame, atoms: DataFrame) -> DataFrame:
    sizes = atoms.groupBy("config_id").agg(F.count(F.lit(1)).alias("size"))
    return configs.join(sizes, "config_id")


def energy_per_atom(configs: DataFrame) -> DataFrame:
    return configs.withColumn("energy_per_atom", F.col("energy") / F.col("size"))


def pressure_corrected(configs: DataFrame, pressures: DataFrame, on: str) -> DataFrame:
    """Energy less pressure times volume, where a pressure other than zero is known."""
    p = F.coalesce("pressure", F.lit(0.0))
    joined = configs.join(pressures, on, "left")
    return joined.withColumn("energy", F.when(p != 0, F.col("energy") - p * F.col("volume")).otherwise(F.col("energy"))).drop("pressure")


def composition(atoms: DataFrame, species: Sequence[int]) -> DataFrame:
    """(config_id, n_<z>...): the number of atoms of each species."""
    return atoms.groupBy("config_id").agg(*[F.count_if(F.col("z") == z).alias(f"n_{z}") for z in species])


def invalid_force_configs(atoms: DataFrame) -> DataFrame:
    """Configurations with a missing or NaN force component."""
    broken = reduce(lambda a, b: a | b, [F.col(c).isNull() | F.isnan(c) for c in FORCE])
    return atoms.where(broken).select("config_id").distinct()


def subset(rows: DataFrame, keys: DataFrame, key: str = "config_id") -> DataFrame:
    return rows.join(keys.select(key).distinct(), key, "left_semi")


def holdout(rows: DataFrame, keys: DataFrame, key: str = "config_id") -> DataFrame:
    return rows.join(keys.select(key).distinct(), key, "left_anti")


def hash_sample(rows: DataFrame, n: int, key: str = "config_id", seed: int = 0) -> DataFrame:
    """``n`` rows drawn by a hash of the key: the same ones every time."""
    return rows.orderBy(uniform(F.lit(seed), F.col(key)), key).limit(n)


def folds(rows: DataFrame, k: int, order: str, by: Sequence[str] = ()) -> DataFrame:
    """Contiguous folds of equal size, larger ones first, by a distributed rank.

    Without a group the rank over all rows is made from range partitions and
    their running sizes, so no task orders the whole table.  Rows of equal
    ``order`` follow one another by their other columns.
    """
    if by:
        return rows.withColumn("fold", F.ntile(k).over(Window.partitionBy(*by).orderBy(order, *_others(rows, order))) - 1)
    ranked, total = global_rank(rows, order)
    n, r = F.lit(total), F.col("rank") - 1
    big, size = n % k, F.floor(n / k)
    fold = F.when(r < big * (size + 1), F.floor(r / (size + 1))).otherwise(big + F.floor((r - big * (size + 1)) / F.greatest(size, F.lit(1))))
    return ranked.withColumn("fold", fold.cast("int")).drop("rank")


def _others(rows: DataFrame, order: str) -> list[Column]:
    return [F.to_json(F.struct(*[c for c in rows.columns if c != order]))] if len(rows.columns) > 1 else []


def global_rank(rows: DataFrame, order: str) -> tuple[DataFrame, int]:
    """Adds ``rank`` (1, 2, ...) by ``order``, equal ones by their other columns, and the number of rows.

    Rows are written in range partitions; the count of those before (one row
    each, broadcast) is added to the place inside.  A value that many rows
    share spreads over partitions, since the other columns are part of the range.
    """
    from latticework.sources.sinks import scratch

    spark = rows.sparkSession
    keyed = rows.withColumn("_rest", *_others(rows, order)) if len(rows.columns) > 1 else rows.withColumn("_rest", F.lit(""))
    ranged = keyed.repartitionByRange(order, "_rest").sortWithinPartitions(order, "_rest").withColumn("_part", F.spark_partition_id())
    # Within a partition this number rises in the order of its rows.
    ranged = ranged.withColumn("_nth", F.monotonically_increasing_id() - F.shiftleft(F.col("_part").cast("long"), 33)).drop("_rest")
    path = scratch(spark, "ranges")
    ranged.write.parquet(path)
    tagged = spark.read.schema(ranged.schema).parquet(path)
    sizes = tagged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    ranked = tagged.join(F.broadcast(before), "_part").withColumn("rank", F.col("_before") + F.col("_nth") + 1)
    return ranked.select(*rows.columns, "rank"), tagged.count()


def chunk_catalogue(chunks: DataFrame) -> DataFrame:
    """(chunk, n_rows) of a chunked table."""
    return chunks.groupBy("chunk").agg(F.count(F.lit(1)).alias("n_rows"))


def occurrence_join(log: DataFrame, dump: DataFrame, step: str = "step", run: Sequence[str] = (), order: str = "pos") -> DataFrame:
    """Joins the k-th occurrence of a step in the log with its k-th in the dump; others are dropped."""

    def numbered(df: DataFrame) -> DataFrame:
        w = Window.partitionBy(*run, step).orderBy(order)
        return df.withColumn("occurrence", F.row_number().over(w)).drop(order)

    return numbered(log).join(numbered(dump), [*run, step, "occurrence"])


def alias_species(rows: DataFrame, aliases: dict[str, str], column: str = "type") -> DataFrame:
    """Replaces type names by element names; names without an alias stay."""
    table = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair]) if aliases else F.create_map()
    return rows.withColumn(column, F.coalesce(F.try_element_at(table, F.col(column)), F.col(column)) if aliases else F.col(column))


def cutoff_grid(values: DataFrame, trios: DataFrame) -> DataFrame:
    """Pair and trio cut-offs (rmax_2b, rmax_3b) that fit: the pair's reaches twice the trio's."""
    return values.crossJoin(trios).where(F.col("rmax_2b") >= 2 * F.col("rmax_3b"))


def from_lists(spark, frames: Sequence[dict], prefix: str, energies: Sequence[float] | None = None, forces: Sequence | None = None) -> tuple[DataFrame, DataFrame]:
    """In-memory configurations -> (configs, atoms); explicit energies and forces win over attached ones.

    A frame has symbols, positions and, if known, cell, pbc, energy, forces.
    """
    from latticework.functions.chem import atomic_number

    def number(x) -> float | None:
        return None if x is None else float(x)

    configs, atoms = [], []
    for i, f in enumerate(frames):
        energy = energies[i] if energies is not None and energies[i] is not None else f.get("energy")
        pulls = forces[i] if forces is not None and forces[i] is not None else f.get("forces")
        cell = f.get("cell")
        cell = cell and [[float(x) for x in row] for row in cell]
        configs.append((f"{prefix}_{i}", prefix, i, number(energy), len(f["symbols"]), cell, list(f.get("pbc") or [bool(cell)] * 3)))
        for k, (s, p) in enumerate(zip(f["symbols"], f["positions"], strict=True)):
            pull = pulls[k] if pulls is not None else (None, None, None)
            atoms.append((f"{prefix}_{i}", k, s, *map(float, p), *map(number, pull)))
    c = spark.createDataFrame(configs, "config_id string, prefix string, seq long, energy double, size int, cell array<array<double>>, pbc array<boolean>")
    a = spark.createDataFrame(atoms, "config_id string, atom_idx int, symbol string, px double, py double, pz double, fx double, fy double, fz double")
    return c, a.withColumn("z", atomic_number(F.col("symbol")))


def harvest(configs: DataFrame, attached: DataFrame) -> DataFrame:
    """Energies of an attached calculation (config_id, energy), else those the table holds; sizes stay."""
    found = attached.select("config_id", F.col("energy").alias("_energy"))
    return configs.join(found, "config_id", "left").withColumn("energy", F.coalesce("_energy", "energy")).drop("_energy")


def harvest_forces(atoms: DataFrame, attached: DataFrame) -> DataFrame:
    """Forces of an attached calculation (config_id, atom_idx, fx, fy, fz), else those the table holds.

    A configuration's forces come from one side as a whole: an attached set with
    a missing component does not count.
    """
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in FORCE])
    sizes = atoms.groupBy("config_id").agg(F.count(F.lit(1)).alias("_n"))
    complete = attached.where(whole).groupBy("config_id").agg(F.count(F.lit(1)).alias("_n")).join(sizes, ["config_id", "_n"], "left_semi")
    found = attached.join(complete, "config_id", "left_semi").select("config_id", "atom_idx", *[F.col(c).alias(f"_{c}") for c in FORCE])
    joined = atoms.join(found, ["config_id", "atom_idx"], "left")
    return joined.select(*[F.coalesce(f"_{c}", c).alias(c) if c in FORCE else F.col(c) for c in atoms.columns])


def holdout_fraction(rows: DataFrame, fraction: float, key: str = "config_id", seed: int = 0) -> DataFrame:
    """Adds ``held``: true for about this share of the rows, chosen by a hash of the key."""
    return rows.withColumn("held", uniform(F.lit(seed), F.col(key)) < fraction)


def in_order(features: DataFrame, configs: DataFrame) -> DataFrame:
    """Feature rows in the order of their configurations, energy before forces, atoms in order."""
    rank = F.element_at(F.create_map(*[F.lit(x) for i, c in enumerate(("energy", "fx", "fy", "fz")) for x in (c, i)]), F.col("component"))
    return features.join(configs.select("config_id", "seq"), "config_id").orderBy("seq", rank, "atom_idx").drop("seq")


def ingest(
    configs: DataFrame, pressures: DataFrame | None = None, max_samples: int | float = 0, min_diff: float = 0.0, seen: Observation | None = None
) -> DataFrame:
    """Many files' configurations: empty ones out, each file sub-sampled by energy per atom, pressure corrected.

    Sub-sampling takes both limits; a fraction below one counts the rows of its
    own file.  ``configs`` needs prefix, config_id, energy, size (and directory,
    volume for pressures).  ``seen`` is told of the frames and the empty ones.
    """
    if seen is not None:
        configs = configs.observe(seen, F.count(F.lit(1)).alias("frames"), F.count_if(F.coalesce(F.col("size"), F.lit(0)) <= 0).alias("empty_frames"))
    rows = configs.where(F.col("size") > 0)
    if max_samples > 0 and min_diff > 0:
        told = energy_per_atom(rows).where("energy_per_atom is not null").select("prefix", "config_id", "energy_per_atom")
        limit = int(max_samples) if max_samples >= 1 else 0
        picked = farthest_points(told, "prefix", "config_id", ["energy_per_atom"], limit, min_diff)
        if max_samples < 1:
            sizes = told.groupBy("prefix").agg(F.ceil(F.count(F.lit(1)) * max_samples).alias("_limit"))
            picked = picked.join(sizes, "prefix").where(F.col("picked") < F.col("_limit"))
        rows = rows.join(picked.select("prefix", "config_id"), ["prefix", "config_id"], "left_semi")
    return rows if pressures is None else pressure_corrected(rows, pressures, "directory")


def best_rows(scores: DataFrame, group: Sequence[str], score: str) -> DataFrame:
    """The row of least score in each group, all groups in order of their score."""
    others = [c for c in scores.columns if c not in group]
    best = scores.groupBy(*group).agg(F.min_by(F.struct(*others), F.struct(score, *[c for c in others if c != score])).alias("_r"))
    return best.select(*group, "_r.*").orderBy(score, *group)
