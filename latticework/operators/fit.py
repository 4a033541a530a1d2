"""Weighted, regularised linear models from distributed Gram sums."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROW = ["config_id", "component", "atom_idx"]


def kind_of() -> Column:
    """energy, or force for the three force components."""
    return F.when(F.col("component") == "energy", "energy").otherwise("force")


def normalised(
    features: DataFrame, targets: DataFrame, n_species: int, weights: DataFrame | None = None, atoms: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Energy rows per atom (features and targets over the atom count), optional sample weights on both.

    ``weights`` is (config_id, weight); a configuration without one weighs 1.
    The counts come from ``atoms``, where given, else from the one-body
    features, which are then made a second time.
    """
    if atoms is not None:
        counts = atoms.groupBy("config_id").agg(F.count(F.lit(1)).cast("double").alias("_atoms"))
    else:
        counts = (
            features.where((F.col("component") == "energy") & (F.col("feature_idx") < n_species))
            .groupBy("config_id")
            .agg(F.sum("value").alias("_atoms"))
        )
    if weights is not None:
        counts = counts.join(weights.select("config_id", F.col("weight").alias("_w")), "config_id", "left")
    scale = F.when(F.col("component") == "energy", 1 / F.col("_atoms")).otherwise(1.0)
    if weights is not None:
        scale = scale * F.coalesce("_w", F.lit(1.0))
    x = features.join(counts, "config_id").withColumn("value", F.col("value") * scale)
    y = targets.join(counts, "config_id").withColumn("y", F.col("y") * scale)
    return x.select(*ROW, "feature_idx", "value"), y.select(*ROW, "y")


def freeze(features: DataFrame, targets: DataFrame, frozen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Moves frozen features (feature_idx, coefficient) from the left side to the right."""
    small = F.broadcast(frozen)
    known = features.join(small, "feature_idx").groupBy(*ROW).agg(F.sum(F.col("value") * F.col("coefficient")).alias("_known"))
    same = [F.col(f"y.{c}").eqNullSafe(F.col(f"k.{c}")) for c in ROW]
    moved = targets.alias("y").join(known.alias("k"), same, "left")
    y = moved.select(*[F.col(f"y.{c}") for c in ROW], (F.col("y.y") - F.coalesce("k._known", F.lit(0.0))).alias("y"))
    return features.join(small, "feature_idx", "left_anti"), y


def unfreeze(solved: DataFrame, frozen: DataFrame) -> DataFrame:
    return solved.select("feature_idx", "coefficient", F.lit(False).alias("frozen")).unionByName(
        frozen.select("feature_idx", "coefficient", F.lit(True).alias("frozen"))
    )


def gram(features: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., kind, i, j, value): X'X in long form, i <= j.

    The features of a row are gathered (few, by local support), their pairs
    unfolded and summed before the second shuffle, so the features are made
    once; use ``gram_blocks`` where rows are dense.
    """
    kind = F.first(kind_of()).alias("kind")
    rows = features.groupBy(*by, *ROW).agg(kind, F.array_sort(F.collect_list(F.struct(F.col("feature_idx").alias("i"), "value"))).alias("f"))
    left = rows.select(*by, "kind", "f", F.posexplode("f").alias("at", "a"))
    pairs = left.select(*by, "kind", "a", F.explode(F.slice("f", F.col("at") + 1, F.size("f"))).alias("b"))
    summed = pairs.groupBy(*by, "kind", F.col("a.i").alias("i"), F.col("b.i").alias("j"))
    return summed.agg(F.sum(F.col("a.value") * F.col("b.value")).alias("value"))


def gram_blocks(features: DataFrame, width: int, by: tuple[str, ...] = ()) -> DataFrame:
    """The same Gram from long rows gathered by row: one dense partial product per task and key, then sums.

    ``width`` is the number of features; a task holds a batch of rows and a
    ``width`` x ``width`` product per key.  The ``by`` columns are constant in a row.
    """
    kinds = {c: dict(features.dtypes)[c] for c in by}

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, np.ndarray] = {}
        rest: pd.DataFrame | None = None

        def add(rows: pd.DataFrame) -> None:
            for key, part in rows.groupby([*by, "kind"], sort=False):
                x = np.zeros((part["row"].nunique(), width))
                np.add.at(x, (pd.factorize(part["row"])[0], part["feature_idx"].to_numpy()), part["value"].to_numpy())
                product = x.T @ x
                sums[key] = sums[key] + product if key in sums else product

        for batch in batches:
            if not len(batch):
                continue
            rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            last = (rows["row"] == rows["row"].iloc[-1]).to_numpy()  # a row may go on in the next batch
            add(rows[~last])
            rest = rows[last]
        if rest is not None:
            add(rest)
        for key, g in sums.items():
            i, j = np.nonzero(np.triu(g))
            yield pd.DataFrame({**dict(zip([*by, "kind"], key, strict=True)), "i": i.astype("i4"), "j": j.astype("i4"), "value": g[i, j]})

    schema = ", ".join([*[f"{c} {t}" for c, t in kinds.items()], "kind string, i int, j int, value double"])
    row = F.to_json(F.struct(*ROW)).alias("row")
    keyed = features.select(*by, kind_of().alias("kind"), row, F.col("feature_idx").cast("int").alias("feature_idx"), "value")
    parts = keyed.repartition("row").sortWithinPartitions("row").mapInPandas(partial, schema)
    return parts.groupBy(*by, "kind", "i", "j").agg(F.sum("value").alias("value"))


def ordinate(features: DataFrame, targets: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., kind, i, value): X'y."""
    same = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in ROW]
    joined = features.alias("x").join(targets.select(*ROW, "y").alias("y"), same)
    kind = F.when(F.col("x.component") == "energy", "energy").otherwise("force").alias("kind")
    return joined.groupBy(*[F.col(f"x.{c}") for c in by], kind, F.col("x.feature_idx").alias("i")).agg(
        F.sum(F.col("x.value") * F.col("y.y")).alias("value")
    )


def moments(targets: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., kind, n, mean, std): population moments of the targets; NaN rows are left out."""
    return targets.where(~F.isnan("y")).groupBy(*by, kind_of().alias("kind")).agg(
        F.count("y").alias("n"), F.avg("y").alias("mean"), F.stddev_pop("y").alias("std")
    )


def kind_weights(found: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., w_e, w_f): 1 / (sqrt(n) std); 1 and 1 / sqrt(n_f) where energies do not vary."""
    e, f = F.col("kind") == "energy", F.col("kind") == "force"

    def pick(which, column):
        return F.max(F.when(which, F.col(column)))

    agg = found.groupBy(*by).agg(
        pick(e, "n").alias("n_e"), pick(f, "n").alias("n_f"), pick(e, "std").alias("std_e"), pick(f, "std").alias("std_f")
    )
    flat = F.coalesce("std_e", F.lit(0.0)) == 0
    w_e = F.when(flat, 1.0).otherwise(1 / (F.sqrt("n_e") * F.col("std_e")))
    w_f = F.when(flat, 1 / F.sqrt("n_f")).otherwise(1 / (F.sqrt("n_f") * F.col("std_f")))
    return agg.select(*by, w_e.alias("w_e"), w_f.alias("w_f"))


def combine(sums: DataFrame, weights: DataFrame, kappa: float, keys: tuple[str, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """kappa w_e^2 G_e + (1 - kappa) w_f^2 G_f, summed over the kinds."""
    joined = sums.join(weights, list(by)) if by else sums.crossJoin(F.broadcast(weights))
    e = F.lit(kappa) * F.col("w_e") * F.col("w_e")
    f = F.lit(1 - kappa) * F.col("w_f") * F.col("w_f")
    factor = F.when(F.col("kind") == "energy", e).otherwise(f)
    return joined.groupBy(*by, *keys).agg(F.sum(factor * F.col("value")).alias("value"))


def penalty_gram(penalties: DataFrame) -> DataFrame:
    """R'R of sparse rows (row, feature_idx, value), i <= j."""
    a = penalties.select("row", F.col("feature_idx").alias("i"), F.col("value").alias("vi"))
    b = penalties.select("row", F.col("feature_idx").alias("j"), F.col("value").alias("vj"))
    return a.join(b, "row").where("i <= j").groupBy("i", "j").agg(F.sum(F.col("vi") * F.col("vj")).alias("value"))


def legacy_weights(targets: DataFrame, kappa: float) -> DataFrame:
    """Adds weight: kappa / (std n) for energies, (1 - kappa) / (std n) for forces."""
    if not 0 <= kappa <= 1:
        raise ValueError("kappa lies between 0 and 1")
    told = targets.withColumn("kind", kind_of())
    found = told.groupBy("kind").agg((F.stddev_pop("y") * F.count("y")).alias("_spread"))  # two rows
    share = F.when(F.col("kind") == "energy", kappa).otherwise(1 - kappa)
    return told.join(F.broadcast(found), "kind").withColumn("weight", share / F.col("_spread")).drop("kind", "_spread")


def solve(grams: DataFrame, ordinates: DataFrame, by: tuple[str, ...] = ("model",)) -> DataFrame:
    """(by..., feature_idx, coefficient, covered): one small dense solve per model, all models in parallel.

    ``grams`` (by..., i, j, value), i <= j, holds data and penalties; features
    whose column sums to zero count as not covered.
    """
    kinds = {c: dict(grams.dtypes)[c] for c in by}
    union = grams.select(*by, "i", "j", "value").unionByName(ordinates.select(*by, "i", F.lit(-1).alias("j"), "value"))

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        names = np.unique(rows["i"].to_numpy())
        at = np.searchsorted(names, rows["i"].to_numpy())
        right = rows["j"].to_numpy() < 0
        y = np.zeros(len(names))
        np.add.at(y, at[right], rows["value"].to_numpy()[right])
        g = np.zeros((len(names), len(names)))
        pairs = rows[~right]
        i, j = at[~right], np.searchsorted(names, pairs["j"].to_numpy())
        np.add.at(g, (i, j), pairs["value"].to_numpy())
        g = g + np.triu(g, 1).T
        covered = g.sum(axis=0) != 0
        try:
            c = np.linalg.solve(g, y)
        except np.linalg.LinAlgError:
            c = np.linalg.lstsq(g, y, rcond=None)[0]
        out = {k: rows[k].iloc[0] for k in by} | {"feature_idx": names.astype("i4"), "coefficient": c, "covered": covered}
        return pd.DataFrame(out)

    schema = ", ".join([*[f"{c} {t}" for c, t in kinds.items()], "feature_idx int, coefficient double, covered boolean"])
    return union.groupBy(*by).applyInPandas(one, schema)


def predict(features: DataFrame, model: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., config_id, component, atom_idx, predicted): features times coefficients."""
    joined = features.join(model.select(*by, "feature_idx", "coefficient"), "feature_idx")
    return joined.groupBy(*by, *ROW).agg(F.sum(F.col("value") * F.col("coefficient")).alias("predicted"))


def error_metrics(told: DataFrame, by: tuple[str, ...] = ("kind",)) -> DataFrame:
    """Of (y, predicted): n, rmse, mae, largest and smallest residual, and -rmse / std(y)."""
    d = F.col("predicted") - F.col("y")
    rmse = F.sqrt(F.avg(d * d))
    return told.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), rmse.alias("rmse"), F.avg(F.abs(d)).alias("mae"), F.max(d).alias("max_residual"),
        F.min(d).alias("min_residual"), (-rmse / F.stddev_pop("y")).alias("score"),
    )


def cross_validate(fold_gram: DataFrame, fold_ordinate: DataFrame, grid: DataFrame, penalty: DataFrame | None = None) -> DataFrame:
    """(model, fold, feature_idx, coefficient): a fit per grid point with each fold held out.

    Grams (fold, i, j, value) are made once; the training Gram of a fold is the
    total less its own.  ``grid`` is (model, feature_idx): the features a grid
    point keeps, so a smaller cut-off costs no new features.  ``penalty``
    (i, j, value) is added once to the training Gram of every fold.
    """

    def training(sums: DataFrame, keys: list[str]) -> DataFrame:
        sums = sums.groupBy("fold", *keys).agg(F.sum("value").alias("value"))
        total = sums.groupBy(*keys).agg(F.sum("value").alias("all"))
        every = sums.select("fold").distinct()
        own = sums.select("fold", *keys, F.col("value").alias("own"))
        held = total.crossJoin(F.broadcast(every)).join(own, ["fold", *keys], "left")
        return held.select("fold", *keys, (F.col("all") - F.coalesce("own", F.lit(0.0))).alias("value"))

    g = training(fold_gram, ["i", "j"])
    if penalty is not None:
        every = F.broadcast(fold_gram.select("fold").distinct())
        g = g.unionByName(penalty.select("i", "j", "value").crossJoin(every))
    g = g.join(grid.withColumnRenamed("feature_idx", "i"), "i")
    g = g.join(grid.withColumnRenamed("feature_idx", "j"), ["model", "j"])
    o = training(fold_ordinate, ["i"]).join(grid.withColumnRenamed("feature_idx", "i"), "i")
    return solve(g, o, by=("model", "fold"))


def square_sums(targets: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., kind, n, value): the number of targets and the sum of their squares."""
    return targets.groupBy(*by, kind_of().alias("kind")).agg(F.count("y").alias("n"), F.sum(F.col("y") * F.col("y")).alias("value"))


def errors_from_sums(grams: DataFrame, ordinates: DataFrame, squares: DataFrame, models: DataFrame) -> DataFrame:
    """(model, held, kind, part, n, rmse) of cross-validated models, without another pass over the rows.

    ``grams`` (fold, kind, i, j, value), ``ordinates`` (fold, kind, i, value) and
    ``squares`` (fold, kind, n, value) give the squared error of coefficients c
    as y'y - 2 c'X'y + c'X'Xc; ``models`` is (model, fold, feature_idx,
    coefficient) with the fold held out.  Part is train or valid.
    """
    c = models.select("model", F.col("fold").alias("held"), F.col("feature_idx").alias("i"), F.col("coefficient").alias("ci"))
    d = c.select("model", "held", F.col("i").alias("j"), F.col("ci").alias("cj"))
    twice = F.when(F.col("i") == F.col("j"), 1.0).otherwise(2.0)
    quad = grams.join(c, "i").join(d, ["model", "held", "j"]).groupBy("model", "held", "fold", "kind").agg(
        F.sum(twice * F.col("value") * F.col("ci") * F.col("cj")).alias("v")
    )
    lin = ordinates.join(c, "i").groupBy("model", "held", "fold", "kind").agg((-2 * F.sum(F.col("value") * F.col("ci"))).alias("v"))
    every = c.select("model", "held").distinct().crossJoin(squares)
    base = every.select("model", "held", "fold", "kind", F.col("value").alias("v"), "n")
    terms = base.unionByName(quad.withColumn("n", F.lit(0))).unionByName(lin.withColumn("n", F.lit(0)))
    part = F.when(F.col("fold") == F.col("held"), "valid").otherwise("train").alias("part")
    summed = terms.groupBy("model", "held", "kind", part).agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
    return summed.select("model", "held", "kind", "part", "n", F.sqrt(F.greatest(F.col("v"), F.lit(0.0)) / F.col("n")).alias("rmse"))


def by_interaction(models: DataFrame, interactions: DataFrame) -> DataFrame:
    """Flat coefficients (..., feature_idx, coefficient) with their interaction and place in it."""
    small = F.broadcast(interactions.select("interaction_id", "feat_offset", "feat_size"))
    inside = (F.col("feature_idx") >= F.col("feat_offset")) & (F.col("feature_idx") < F.col("feat_offset") + F.col("feat_size"))
    return models.join(small, inside).withColumn("basis_idx", F.col("feature_idx") - F.col("feat_offset")).drop("feat_offset", "feat_size")


def fit_curves(samples: DataFrame, knots: np.ndarray, ridge: float = 1e-12) -> DataFrame:
    """Least-squares cubic splines of sampled curves (curve, x, y) -> (curve, basis_idx, coefficient).

    Samples outside the knots are left out, repeated ones count as often as they
    come; basis functions without a sample get zero by the ridge.
    """
    from .basis import spline_pieces

    spark = samples.sparkSession
    pieces = [(i, lo, hi, *c) for i, _, lo, hi, *c in spline_pieces(knots)]
    table = F.broadcast(spark.createDataFrame(pieces, "basis_idx int, t_lo double, t_hi double, c0 double, c1 double, c2 double, c3 double"))
    d = F.col("x") - F.col("t_lo")
    value = F.col("c0") + d * (F.col("c1") + d * (F.col("c2") + d * F.col("c3")))
    point = ["curve", "x", "y"]
    keyed = samples.groupBy(*point).agg(F.count(F.lit(1)).alias("times"))
    met = keyed.join(table, (F.col("x") > F.col("t_lo")) & (F.col("x") <= F.col("t_hi"))).select(*point, "times", "basis_idx", value.alias("v"))
    other = met.select(*point, F.col("basis_idx").alias("j"), F.col("v").alias("w"))
    pairs = met.withColumnRenamed("basis_idx", "i").join(other, point).where("i <= j")
    g = pairs.groupBy("curve", "i", "j").agg(F.sum(F.col("times") * F.col("v") * F.col("w")).alias("value"))
    n = len(knots) - 4
    diagonal = samples.select("curve").distinct().crossJoin(F.broadcast(spark.createDataFrame([(k, k, ridge) for k in range(n)], "i int, j int, value double")))
    o = met.groupBy("curve", F.col("basis_idx").alias("i")).agg(F.sum(F.col("times") * F.col("v") * F.col("y")).alias("value"))
    solved = solve(g.unionByName(diagonal), o, by=("curve",))
    return solved.select("curve", F.col("feature_idx").alias("basis_idx"), "coefficient")
