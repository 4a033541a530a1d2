"""Periodic images, distance-bounded pairs, their derivatives, and triplets.

Input tables: configs(config_id, cell, pbc) and
atoms(config_id, atom_idx, z, px, py, pz).  All joins are equi-joins on the
configuration, or on its grid cells where configurations are large, with the
distance as a residual predicate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.functions.chem import cross, dot, length, norm, pair_hash, szudzik, trio_hash

from .basis import Basis

POSITION = ("px", "py", "pz")


def replica_factors(configs: DataFrame, r_cut: float) -> DataFrame:
    """Adds na, nb, nc: how many images each axis needs to reach ``r_cut``.

    The cell's height over a face is its volume over the face's area.  A
    periodic axis has ceil(r_cut / height) images on either side (1 where the
    cell is flat or missing), another axis none.
    """
    axes = [F.get("cell", F.lit(k)) for k in range(3)]
    out = configs
    for k, name in enumerate(("na", "nb", "nc")):
        face = cross(axes[(k + 1) % 3], axes[(k + 2) % 3])
        height = F.abs(dot(axes[k], face)) / F.nullif(length(face), F.lit(0.0))
        needed = F.coalesce(F.ceil(F.lit(float(r_cut)) / F.nullif(height, F.lit(0.0))).cast("int"), F.lit(1))
        periodic = F.coalesce(F.get("pbc", F.lit(k)), F.lit(False))
        out = out.withColumn(name, F.when(periodic, needed).otherwise(0))
    return out


def _unfolded(rows: DataFrame) -> DataFrame:
    """A row for each image (ia, ib, ic) of rows with na, nb, nc, and its shift (dx, dy, dz); the cell goes."""
    for i, n in (("ia", "na"), ("ib", "nb"), ("ic", "nc")):
        rows = rows.withColumn(i, F.explode(F.sequence(-F.col(n), F.col(n))))
    shift = [
        sum(
            (F.col(i) * F.coalesce(F.get(F.get("cell", F.lit(a)), F.lit(k)), F.lit(0.0)) for a, i in enumerate(("ia", "ib", "ic"))),
            F.lit(0.0),
        )
        for k in range(3)
    ]
    return rows.withColumns(dict(zip(("dx", "dy", "dz"), shift, strict=True))).drop("cell", "na", "nb", "nc")


def _with_cells(configs: DataFrame, atoms: DataFrame, r_cut: float) -> DataFrame:
    """Atoms with the cell and the numbers of images of their configuration.

    Both sides are shuffled by the configuration: a table of cells is many times
    the size that Spark takes it for, so it would be broadcast where it does not fit.
    """
    factors = replica_factors(configs, r_cut).select("config_id", "cell", "na", "nb", "nc")
    return atoms.join(factors.hint("merge"), "config_id")


def image_offsets(configs: DataFrame, r_cut: float, nearest_first: bool = False) -> DataFrame:
    """(config_id, ia, ib, ic, dx, dy, dz[, rank]) of every periodic image."""
    out = _unfolded(replica_factors(configs, r_cut).select("config_id", "cell", "na", "nb", "nc"))
    out = out.select("config_id", "ia", "ib", "ic", "dx", "dy", "dz")
    if nearest_first:
        from pyspark.sql import Window

        order = Window.partitionBy("config_id").orderBy(norm(F.col("dx"), F.col("dy"), F.col("dz")), "ia", "ib", "ic")
        out = out.withColumn("rank", F.row_number().over(order))
    return out


def _moved() -> list[Column]:
    return [(F.col(p) + F.col(d)).alias(p) for p, d in zip(POSITION, ("dx", "dy", "dz"), strict=True)]


def _is_real() -> Column:
    return (F.col("ia") == 0) & (F.col("ib") == 0) & (F.col("ic") == 0)


def periodic_images(configs: DataFrame | None, atoms: DataFrame, r_cut: float) -> DataFrame:
    """atoms x images: (config_id, atom_idx, ia, ib, ic, is_real, z, px, py, pz).

    ``configs`` None says that no configuration is periodic: no join, no images.
    Images are unfolded behind the join, which sees a row for each atom and configuration.
    """
    if configs is None:
        here = [F.lit(0).alias(i) for i in ("ia", "ib", "ic")]
        return atoms.select("config_id", "atom_idx", *here, F.lit(True).alias("is_real"), "z", *POSITION)
    made = _unfolded(_with_cells(configs, atoms.select("config_id", "atom_idx", "z", *POSITION), r_cut))
    return made.select("config_id", "atom_idx", "ia", "ib", "ic", _is_real().alias("is_real"), "z", *_moved())


#: Configurations of more atoms than this are cut into cells, so that their pairs spread over tasks.
CELL_ATOMS = 5_000
CELL = ["bx", "by", "bz"]


def large_configs(atoms: DataFrame) -> DataFrame:
    """(config_id, _large) of the configurations of over CELL_ATOMS atoms."""
    sizes = atoms.groupBy("config_id").agg(F.count(F.lit(1)).alias("_n"))
    return sizes.where(F.col("_n") > CELL_ATOMS).select("config_id", F.lit(True).alias("_large"))


def cells_of(atoms: DataFrame, cells: bool | DataFrame | None) -> bool | DataFrame:
    """``cells`` as ``near_pairs`` takes them: None stands for the large configurations, False where there are none.

    That is counted at once.  Without large configurations the joins are on the
    configuration alone, so what follows them by configuration is not shuffled again.
    """
    if cells is not None:
        return cells
    large = large_configs(atoms)
    return False if large.isEmpty() else large


def celled(left: DataFrame, right: DataFrame, width: float, large: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Both sides with the cell (bx, by, bz) of their place, the left copied to the 27 cells around it.

    Only configurations in ``large`` get cells, the others keep one cell
    (0, 0, 0) and no copies, all in one plan; None gives every configuration cells.
    """
    left, right = (df.withColumn("_large", F.lit(True)) if large is None else df.join(large, "config_id", "left") for df in (left, right))
    at = [F.floor(F.col(p) / width) for p in POSITION]
    here = F.struct(*[F.when(F.col("_large"), c).otherwise(0).alias(b) for b, c in zip(CELL, at, strict=True)])

    def beside(k: Column) -> Column:
        steps = (k % 3 - 1, F.floor(k / 3) % 3 - 1, F.floor(k / 9) - 1)
        return F.struct(*[(c + d).alias(b) for b, c, d in zip(CELL, at, steps, strict=True)])

    around = F.when(F.col("_large"), F.transform(F.sequence(F.lit(0), F.lit(26)), beside)).otherwise(F.array(here))
    left = left.withColumn("_cell", F.explode(around))
    right = right.withColumn("_cell", here)
    return tuple(df.select("*", *[F.col(f"_cell.{b}").alias(b) for b in CELL]).drop("_cell", "_large") for df in (left, right))


def near_pairs(left: DataFrame, right: DataFrame, r_cut: float, *, cells: bool | DataFrame = False) -> DataFrame:
    """Rows of ``left`` (l_*) with rows of ``right`` (r_*) at 0 < r <= r_cut, and r.

    The join key is the configuration, and for those in ``cells``
    (``large_configs``; True: all) the cell of a grid of edge r_cut.
    """
    keys = ["config_id"]
    if cells is not False:
        keys += CELL
        left, right = celled(left, right, r_cut, None if cells is True else cells)

    def named(df: DataFrame, side: str) -> DataFrame:
        return df.select(*keys, *[F.col(c).alias(side + c) for c in df.columns if c not in keys])

    joined = named(left, "l_").join(named(right, "r_").hint("merge"), keys)  # atoms are never the small side
    r = norm(*[F.col("r_" + p) - F.col("l_" + p) for p in POSITION])
    return joined.withColumn("r", r).where((F.col("r") > 0) & (F.col("r") <= r_cut)).drop(*CELL)


def image_pairs(configs: DataFrame | None, atoms: DataFrame, reach: float, far: float, cells: bool | DataFrame) -> DataFrame:
    """Real atoms (l_*) with images up to ``reach`` (r_*, with r_ia, r_ib, r_ic, r_is_real) at 0 < r <= far, and r.

    Where no configuration is cut into cells, atoms meet first and are moved
    then: no table of images is shuffled or sorted.
    """
    real = atoms.select("config_id", "atom_idx", "z", *POSITION)
    if configs is None or cells is not False:
        return near_pairs(real, periodic_images(configs, atoms, reach), far, cells=cells)
    left = real.select("config_id", *[F.col(c).alias("l_" + c) for c in real.columns[1:]])
    made = _unfolded(left.join(_with_cells(configs, real, reach), "config_id"))
    made = made.withColumn("is_real", _is_real()).withColumns({m: F.col(m) + F.col(d) for m, d in zip(POSITION, ("dx", "dy", "dz"), strict=True)})
    r = norm(*[F.col(p) - F.col("l_" + p) for p in POSITION])
    near = made.withColumn("r", r).where((F.col("r") > 0) & (F.col("r") <= far))
    moved = ["atom_idx", "ia", "ib", "ic", "is_real", "z", *POSITION]
    return near.select(*left.columns, *[F.col(c).alias("r_" + c) for c in moved], "r")


def _pair_bounds(basis: Basis) -> Column:
    """(interaction_id, r_min, r_max) by pair hash, as a literal map: one entry per pair of species."""
    entries = []
    for x in basis.of_degree(2):
        a, b = x.species
        bound = F.struct(F.lit(x.number).alias("id"), F.lit(float(x.knots[0][0])).alias("lo"), F.lit(float(x.knots[0][-1])).alias("hi"))
        entries += [szudzik(F.lit(a), F.lit(b)), bound]
    return F.create_map(*entries)


def pair_distances(configs: DataFrame | None, atoms: DataFrame, basis: Basis, *, r_cut: float | None = None, cells: bool | None = None) -> DataFrame:
    """(config_id, i, j, interaction_id, r): real atom i and any image j, r_min < r < r_max of the pair.

    Both directions appear.  Atoms at one place are no neighbours; an atom sees
    its own images.  Images are made up to ``r_cut`` (the basis' reach).  With
    ``cells`` None only large configurations are cut into cells.
    """
    far = max(float(x.knots[0][-1]) for x in basis.of_degree(2))
    pairs = image_pairs(configs, atoms, r_cut or basis.reach, far, cells_of(atoms, cells))
    found = pairs.withColumn("b", F.try_element_at(_pair_bounds(basis), pair_hash(F.col("l_z"), F.col("r_z"))))
    inside = (F.col("r") > F.col("b.lo")) & (F.col("r") < F.col("b.hi"))
    return found.where(inside).select(
        "config_id", F.col("l_atom_idx").alias("i"), F.col("r_atom_idx").alias("j"), F.col("b.id").alias("interaction_id"), "r"
    )


def pair_derivatives(
    configs: DataFrame | None, atoms: DataFrame, basis: Basis, *, r_cut: float | None = None, prune: float | None = None, cells: bool | None = None
) -> DataFrame:
    """(config_id, pair, end, interaction_id, r, ux, uy, uz): signed unit vectors on real ends.

    Every ordered pair of images within ``prune`` of a real atom counts if one
    of its ends is real; ``pair`` names it.  The derivative of r by the position
    of end j is the unit vector from i to j, by that of i its negative; images
    stand for the atom they copy only where they are the real one.
    """
    reach = r_cut or basis.reach
    limit = prune or reach
    far = max(float(x.knots[0][-1]) for x in basis.of_degree(2))
    pairs = image_pairs(configs, atoms, reach, far, cells_of(atoms, cells))
    if configs is not None and limit < far:  # else an image in a pair is within the limit of its real end
        ghost = ["config_id", "r_atom_idx", "r_ia", "r_ib", "r_ic"]
        near = pairs.where(~F.col("r_is_real") & (F.col("r") <= limit)).select(*ghost).distinct()
        kept = pairs.where(~F.col("r_is_real")).join(near, ghost, "left_semi").select(*pairs.columns)
        pairs = pairs.where("r_is_real").unionByName(kept)
    pairs = pairs.withColumn("b", F.try_element_at(_pair_bounds(basis), pair_hash(F.col("l_z"), F.col("r_z"))))
    pairs = pairs.where((F.col("r") > F.col("b.lo")) & (F.col("r") < F.col("b.hi")))
    pairs = pairs.withColumn("l_name", F.concat_ws(":", "l_atom_idx", F.lit(0), F.lit(0), F.lit(0)))
    pairs = pairs.withColumn("r_name", F.concat_ws(":", "r_atom_idx", "r_ia", "r_ib", "r_ic"))
    there, back = F.concat_ws(">", "l_name", "r_name"), F.concat_ws(">", "r_name", "l_name")
    axes = ("ux", "uy", "uz")
    unit = [F.try_divide(F.col("r_" + p) - F.col("l_" + p), F.col("r")) for p in POSITION]
    at_left = [(-u).alias(n) for u, n in zip(unit, axes, strict=True)]
    at_right = [u.alias(n) for u, n in zip(unit, axes, strict=True)]

    def end(pair: Column, side: str, vector: list[Column]) -> Column:
        return F.struct(pair.alias("pair"), F.col(side + "_atom_idx").alias("end"), *vector)

    # Both ends of a pair of real atoms; the pair with an image, and the same seen from the image, end at the real atom.
    other = F.when(F.col("r_is_real"), end(there, "r", at_right)).otherwise(end(back, "l", at_left))
    ends = F.array(end(there, "l", at_left), other)
    return pairs.select("config_id", F.col("b.id").alias("interaction_id"), "r", F.explode(ends).alias("e")).select(
        "config_id", "e.pair", "e.end", "interaction_id", "r", *[f"e.{u}" for u in axes]
    )


def _trio_legs(basis: Basis) -> Column:
    entries = []
    for x in basis.of_degree(3):
        i, j, k = x.species
        legs = F.struct(
            F.lit(x.number).alias("id"),
            F.array(*[F.lit(float(q[0])) for q in x.knots]).alias("lo"),
            F.array(*[F.lit(float(q[-1])) for q in x.knots]).alias("hi"),
        )
        entries += [szudzik(szudzik(F.lit(i), F.lit(j)), F.lit(k)), legs]
    return F.create_map(*entries)


def triplets(configs: DataFrame | None, atoms: DataFrame, basis: Basis, *, r_cut: float | None = None, cells: bool | None = None) -> DataFrame:
    """(config_id, i, j, k, interaction_id, r_l, r_m, r_n, and per leg its unit vector u_l, u_m, u_n).

    j and k name images; j_atom and k_atom are the atoms they copy.  Unit
    vectors point from centre to j, centre to k, and j to k.

    Neighbours j, k of a real centre, each pair of them once, ordered by
    species; each leg within its knots, bounds included.  A neighbour shell is
    gathered by (configuration, centre) and unfolded with itself.
    """
    reach = r_cut or basis.reach
    lows = [min(float(x.knots[leg][0]) for x in basis.of_degree(3)) for leg in (0, 1)]
    highs = [max(float(x.knots[leg][-1]) for x in basis.of_degree(3)) for leg in (0, 1)]
    shell = image_pairs(configs, atoms, reach, max(highs), cells_of(atoms, cells)).where(F.col("r") >= min(lows))
    shell = shell.withColumn("r_name", F.concat_ws(":", "r_atom_idx", "r_ia", "r_ib", "r_ic"))
    centre = ["config_id", "l_atom_idx", "l_z", *["l_" + p for p in POSITION]]
    seen = ["atom_idx", "name", "z", *POSITION]
    shells = shell.groupBy(*centre).agg(F.collect_list(F.struct(*[F.col("r_" + c).alias(c) for c in seen], F.col("r").alias("r"))).alias("shell"))
    both = shells.withColumn("j", F.explode("shell")).withColumn("k", F.explode("shell"))
    both = both.where((F.col("j.z") < F.col("k.z")) | ((F.col("j.z") == F.col("k.z")) & (F.col("j.name") < F.col("k.name"))))
    both = both.select(*centre, *[F.col(f"{n}.{c}").alias(f"{n}_{c}") for n in "jk" for c in seen], F.col("j.r").alias("r_j"), F.col("k.r").alias("r_k"))
    both = both.withColumn("r_n", norm(*[F.col("k_" + p) - F.col("j_" + p) for p in POSITION]))
    both = both.withColumn("t", F.try_element_at(_trio_legs(basis), trio_hash(F.col("l_z"), F.col("j_z"), F.col("k_z"))))
    inside = F.lit(True)
    for k, r in enumerate(("r_j", "r_k", "r_n")):
        inside = inside & (F.col(r) >= F.get("t.lo", F.lit(k))) & (F.col(r) <= F.get("t.hi", F.lit(k)))
    def unit(to: str, start: str, r: str) -> Column:
        return F.array(*[F.try_divide(F.col(to + p) - F.col(start + p), F.col(r)) for p in POSITION])

    return both.where(inside).select(
        "config_id", F.col("l_atom_idx").alias("i"), F.col("j_name").alias("j"), F.col("k_name").alias("k"),
        F.col("j_atom_idx").alias("j_atom"), F.col("k_atom_idx").alias("k_atom"),
        F.col("t.id").alias("interaction_id"), F.col("r_j").alias("r_l"), F.col("r_k").alias("r_m"), "r_n",
        unit("j_", "l_", "r_j").alias("u_l"), unit("k_", "l_", "r_k").alias("u_m"), unit("k_", "j_", "r_n").alias("u_n"),
    )
