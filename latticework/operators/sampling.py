"""Sub-sampling, augmentation and random displacement."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .farthest import by_blocks, distances

#: Groups of more rows than this are sampled by blocks over the distributed table.
GROUP_ROWS = 200_000


def _named(group: Column) -> Column:
    """A group's value as a string that is never null."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit("-"))


def farthest_points(
    rows: DataFrame, group: str, key: str, values: list[str], max_samples: int = 0, min_diff: float = 0.0, group_rows: int = GROUP_ROWS
) -> DataFrame:
    """Rows picked farthest-first in each group: (group, key, picked), picked = 0, 1, ...

    Starts at the smallest first value, then takes the row farthest from all
    picked ones until ``max_samples`` are picked or the farthest is nearer than
    ``min_diff``; ties go to the smallest key.  Without either limit every row
    stays.  Rows with a null or NaN value are not picked; a null group is a group
    like others.  Groups up to ``group_rows`` run as one vectorised task each,
    larger ones by blocks with bounds (``farthest``), with the same picks.
    """
    schema = f"{group} {dict(rows.dtypes)[group]}, {key} {dict(rows.dtypes)[key]}, picked int"
    if not max_samples and not min_diff:
        return rows.select(group, key, F.lit(0).alias("picked"))

    def pick(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(key, kind="stable")
        x = part[values].to_numpy(float)
        at = int(x[:, 0].argmin())
        chosen, gap = [at], distances(x, x[at])
        limit = min(len(x), max_samples or len(x))
        while len(chosen) < limit:
            at = int(gap.argmax())
            if gap[at] <= 0 or gap[at] < min_diff:
                break
            chosen.append(at)
            gap = np.minimum(gap, distances(x, x[at]))
        return pd.DataFrame({group: part[group].iloc[chosen].to_numpy(), key: part[key].iloc[chosen].to_numpy(), "picked": range(len(chosen))})

    whole = reduce(lambda a, b: a & b, [F.col(v).isNotNull() & ~F.isnan(F.col(v).cast("double")) for v in values])
    needed = rows.where(whole).select(group, key, *values)
    sizes = needed.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    large = sizes.where(F.col("_n") > group_rows).select(F.col(group).alias("_large"))
    if large.isEmpty():
        return needed.groupBy(group).applyInPandas(pick, schema)
    same = F.col(group).eqNullSafe(F.col("_large"))
    picked = by_blocks(needed.join(large, same, "left_semi"), _named(F.col(group)), key, values, max_samples, min_diff)
    names = large.select(_named(F.col("_large")).alias("_g"), F.col("_large").alias(group))
    picked = picked.withColumnRenamed("g", "_g").join(names, "_g").select(group, F.col("key").alias(key), "picked")
    return needed.join(large, same, "left_anti").groupBy(group).applyInPandas(pick, schema).unionByName(picked)


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) drawn by a hash of the parts: the same in every run and on every retry."""
    digest = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / float(1 << 48)


def axis_displacements(configs: DataFrame, atoms: DataFrame, d: float) -> DataFrame:
    """Each atom moved by d along each axis, down its force: (config_id, atom_idx, axis, shift, energy).

    The energy changes by minus force times shift; the shift of one axis has no
    part in the next.
    """
    axes = F.array(*[F.struct(F.lit(a).alias("axis"), F.col(c).alias("f")) for a, c in enumerate(("fx", "fy", "fz"))])
    moved = atoms.select("config_id", "atom_idx", F.explode(axes).alias("m")).select("config_id", "atom_idx", "m.axis", "m.f")
    shift = -F.signum("f") * F.lit(d)
    return moved.join(configs.select("config_id", "energy"), "config_id").select(
        "config_id", "atom_idx", "axis", shift.alias("shift"), (F.col("energy") - F.col("f") * shift).alias("energy")
    )


def random_displacements(configs: DataFrame, atoms: DataFrame, d: float, n: int = 25, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """n copies of each configuration with every coordinate moved by a hash-seeded uniform amount within d.

    Returns configs (config_id, copy, energy) and atoms (config_id, copy, atom_idx, px, py, pz).
    """
    many = atoms.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    name = [F.lit(seed), F.col("config_id"), F.col("atom_idx"), F.col("copy")]
    for a, p in enumerate(("px", "py", "pz")):
        many = many.withColumn(f"d{a}", (2 * uniform(*name, F.lit(a)) - 1) * d).withColumn(p, F.col(p) + F.col(f"d{a}"))
    work = sum((F.col(c) * F.col(f"d{a}") for a, c in enumerate(("fx", "fy", "fz"))), F.lit(0.0))
    change = many.groupBy("config_id", "copy").agg(F.sum(work).alias("_work"))
    energies = change.join(configs.select("config_id", "energy"), "config_id").select(
        "config_id", "copy", (F.col("energy") - F.col("_work")).alias("energy")
    )
    return energies, many.drop("d0", "d1", "d2")


def rattle(atoms: DataFrame, amplitude: float, seed: int = 0) -> DataFrame:
    """Positions moved by normal noise, drawn by hash so that a retried task moves them alike."""
    name = [F.lit(seed), F.col("config_id"), F.col("atom_idx")]
    for a, p in enumerate(("px", "py", "pz")):
        near, turn = 1 - uniform(*name, F.lit(2 * a)), uniform(*name, F.lit(2 * a + 1))
        atoms = atoms.withColumn(p, F.col(p) + amplitude * F.sqrt(-2 * F.log(near)) * F.cos(2 * F.pi() * turn))
    return atoms
