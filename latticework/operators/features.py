"""Spline features of pairs and triplets, and the rows a model is fitted on.

Long form: (config_id, component, atom_idx, feature_idx, value); component is
``energy`` (atom_idx null) or ``fx``, ``fy``, ``fz``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .basis import Basis
from .neighbours import cells_of, pair_derivatives, pair_distances, triplets


def _dx(name: str) -> Column:
    return F.col(name) - F.col("t_lo")


def horner(r: str) -> Column:
    d = _dx(r)
    return F.col("c0") + d * (F.col("c1") + d * (F.col("c2") + d * F.col("c3")))


def slope(r: str) -> Column:
    d = _dx(r)
    return F.col("c1") + d * (2 * F.col("c2") + d * 3 * F.col("c3"))


def segment_join(points: DataFrame, segments: DataFrame, r: str = "r", leg: int | None = None) -> DataFrame:
    """The (up to four) spline pieces at each point: a broadcast equi-join on the interaction, t_lo < r <= t_hi.

    ``segments`` is the basis' table of knot intervals: a point meets one, and
    its pieces are unfolded behind the join.
    """
    table = segments if leg is None else segments.where(F.col("leg") == leg)
    inside = (F.col(r) > F.col("t_lo")) & (F.col(r) <= F.col("t_hi"))
    met = points.join(F.broadcast(table.drop("leg")), "interaction_id").where(inside)
    return met.select("*", F.inline("parts")).drop("parts")


def _offsets(basis: Basis) -> Column:
    return F.create_map(*[F.lit(v) for x in basis.interactions for v in (x.number, x.offset)])


def _energy(df: DataFrame) -> DataFrame:
    return df.select(
        "config_id", F.lit("energy").alias("component"), F.lit(None).cast("int").alias("atom_idx"), "feature_idx", "value"
    )


def by_axis(rows: DataFrame, value: str) -> DataFrame:
    """A row (component, value) for each of fx, fy, fz; unlike ``unpivot`` it leaves rows in the partitions they are in."""
    axes = ("fx", "fy", "fz")
    kept = [c for c in rows.columns if c not in axes]
    return rows.select(*kept, F.inline(F.array(*[F.struct(F.lit(c).alias("component"), F.col(c).alias(value)) for c in axes])))


def energy_features_1b(atoms: DataFrame, basis: Basis) -> DataFrame:
    """Atom counts per species; species outside the basis are left out."""
    offset = F.try_element_at(F.create_map(*[F.lit(v) for x in basis.of_degree(1) for v in (x.species[0], x.offset)]), F.col("z"))
    counted = atoms.withColumn("feature_idx", offset).where("feature_idx is not null").groupBy("config_id", "feature_idx")
    return _energy(counted.agg(F.count(F.lit(1)).cast("double").alias("value")))


def energy_features_2b(pairs: DataFrame, basis: Basis) -> DataFrame:
    """Sum of each pair spline over the configuration's pairs."""
    met = segment_join(pairs, basis.segments_table(pairs.sparkSession, 2))
    feature = F.element_at(_offsets(basis), F.col("interaction_id")) + F.col("basis_idx")
    return _energy(met.groupBy("config_id", feature.alias("feature_idx")).agg(F.sum(horner("r")).alias("value")))


def force_features_2b(derivatives: DataFrame, basis: Basis) -> DataFrame:
    """Minus the sum of each spline's slope times the unit vector, per real atom and axis."""
    met = segment_join(derivatives, basis.segments_table(derivatives.sparkSession, 2))
    feature = F.element_at(_offsets(basis), F.col("interaction_id")) + F.col("basis_idx")
    s = -slope("r")
    summed = met.groupBy("config_id", F.col("end").cast("int").alias("atom_idx"), feature.alias("feature_idx")).agg(
        *[F.sum(s * F.col(u)).alias(c) for u, c in (("ux", "fx"), ("uy", "fy"), ("uz", "fz"))]
    )
    return by_axis(summed, "value").select("config_id", "component", "atom_idx", "feature_idx", "value")


def energy_features_3b(trios: DataFrame, basis: Basis) -> DataFrame:
    """Product of three leg splines over the configuration's triplets, folded by the grid's symmetry.

    The pieces of one leg are joined at a time and summed per grid cell before
    the next shuffle: cells per configuration are bounded by the grid.
    """
    spark = trios.sparkSession
    pieces = basis.segments_table(spark, 3)
    out = trios.select("config_id", "interaction_id", "r_l", "r_m", "r_n")
    for leg, (r, cell) in enumerate((("r_l", "l"), ("r_m", "m"), ("r_n", "n"))):
        met = segment_join(out, pieces, r, leg)
        value = horner(r) * (F.col("v") if leg else F.lit(1.0))
        out = met.withColumn("v", value).withColumnRenamed("basis_idx", cell).drop("t_lo", "t_hi", "c0", "c1", "c2", "c3")
    folded = out.join(F.broadcast(basis.grid_table(spark)), ["interaction_id", "l", "m", "n"])
    return _energy(folded.groupBy("config_id", "feature_idx").agg(F.sum(F.col("v") * F.col("weight")).alias("value")))


def force_features_3b(trios: DataFrame, basis: Basis) -> DataFrame:
    """Minus the derivative of each triplet's product by the places of its three atoms.

    An image moves with the atom it copies, so its share goes to that atom.
    """
    spark = trios.sparkSession
    pieces = basis.segments_table(spark, 3)
    out = trios
    for leg, (r, cell) in enumerate((("r_l", "l"), ("r_m", "m"), ("r_n", "n"))):
        met = segment_join(out, pieces, r, leg)
        out = met.withColumn(f"v{leg}", horner(r)).withColumn(f"s{leg}", slope(r)).withColumnRenamed("basis_idx", cell)
        out = out.drop("t_lo", "t_hi", "c0", "c1", "c2", "c3")
    folded = out.join(F.broadcast(basis.grid_table(spark)), ["interaction_id", "l", "m", "n"])
    d = {
        "l": F.col("s0") * F.col("v1") * F.col("v2") * F.col("weight"),
        "m": F.col("v0") * F.col("s1") * F.col("v2") * F.col("weight"),
        "n": F.col("v0") * F.col("v1") * F.col("s2") * F.col("weight"),
    }
    folded = folded.select(
        "config_id", "i", "j_atom", "k_atom", "feature_idx", *[d[x].alias("d_" + x) for x in d], "u_l", "u_m", "u_n"
    )
    shares = (("i", {"l": 1, "m": 1}), ("j_atom", {"l": -1, "n": 1}), ("k_atom", {"m": -1, "n": -1}))

    def end(atom: str, signs: dict[str, int]) -> Column:
        axes = [
            sum((F.lit(float(g)) * F.col("d_" + x) * F.get("u_" + x, F.lit(k)) for x, g in signs.items()), F.lit(0.0)).alias(c)
            for k, c in enumerate(("fx", "fy", "fz"))
        ]
        return F.struct(F.col(atom).cast("int").alias("atom_idx"), *axes)

    ends = folded.select("config_id", "feature_idx", F.explode(F.array(*[end(a, s) for a, s in shares])).alias("e"))
    summed = ends.groupBy("config_id", F.col("e.atom_idx").alias("atom_idx"), "feature_idx").agg(
        *[F.sum(f"e.{c}").alias(c) for c in ("fx", "fy", "fz")]
    )
    return by_axis(summed, "value").select("config_id", "component", "atom_idx", "feature_idx", "value")


def feature_table(configs: DataFrame, atoms: DataFrame, basis: Basis, *, forces: bool = True, cells: bool | None = None) -> DataFrame:
    """All features in long form.  Configurations with an unknown species are left out whole."""
    known = known_species(atoms, basis)
    cells = cells_of(atoms, cells)
    pairs = pair_distances(configs, known, basis, cells=cells)
    out = energy_features_1b(known, basis).unionByName(energy_features_2b(pairs, basis))
    if basis.degree > 2:
        trios = triplets(configs, known, basis, cells=cells)
        out = out.unionByName(energy_features_3b(trios, basis))
        if forces:
            out = out.unionByName(force_features_3b(trios, basis))
    if forces:
        out = out.unionByName(force_features_2b(pair_derivatives(configs, known, basis, cells=cells), basis))
    return out


def known_species(atoms: DataFrame, basis: Basis, seen: Observation | None = None) -> DataFrame:
    """Atoms of the configurations that hold no species outside the basis.

    ``seen`` is told, as the rows pass, of how many configurations there were,
    how many were dropped, and how many atoms went with them.
    """
    strange = ~F.col("z").isin(*basis.species) | F.col("z").isNull()
    if seen is None:
        return atoms.join(atoms.where(strange).select("config_id").distinct(), "config_id", "left_anti")
    marked = atoms.groupBy("config_id").agg(F.max(strange).alias("_strange"), F.count(F.lit(1)).alias("_n"))
    gone = F.col("_strange")
    marked = marked.observe(
        seen, F.count(F.lit(1)).alias("configs"), F.count_if(gone).alias("dropped_configs"),
        F.coalesce(F.sum(F.when(gone, F.col("_n"))), F.lit(0)).alias("dropped_atoms"),
    )
    return atoms.join(marked.where(~gone).select("config_id"), "config_id", "left_semi")


def wide(features: DataFrame, width: int) -> DataFrame:
    """One row per (config_id, component, atom_idx) with the features as an array."""
    gathered = features.groupBy("config_id", "component", "atom_idx").agg(
        F.map_from_entries(F.collect_list(F.struct("feature_idx", "value"))).alias("m")
    )
    filled = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0.0)))
    return gathered.select("config_id", "component", "atom_idx", filled.alias("x"))


def long(rows: DataFrame) -> DataFrame:
    """Back from the wide form; zeros are left out."""
    return rows.select("config_id", "component", "atom_idx", F.posexplode("x").alias("feature_idx", "value")).where("value <> 0")


def targets(configs: DataFrame, atoms: DataFrame) -> DataFrame:
    """(config_id, component, atom_idx, y); rows of missing energies, and of configurations with a missing force, are absent."""
    energy = configs.where(F.col("energy").isNotNull() & ~F.isnan("energy")).select(
        "config_id", F.lit("energy").alias("component"), F.lit(None).cast("int").alias("atom_idx"), F.col("energy").alias("y")
    )
    missing = F.col("fx").isNull() | F.col("fy").isNull() | F.col("fz").isNull() | F.isnan("fx") | F.isnan("fy") | F.isnan("fz")
    broken = atoms.where(missing).select("config_id").distinct()
    whole = atoms.join(broken, "config_id", "left_anti")
    force = by_axis(whole.select("config_id", "atom_idx", "fx", "fy", "fz"), "y")
    return energy.unionByName(force.select("config_id", "component", F.col("atom_idx").cast("int").alias("atom_idx"), "y"))
