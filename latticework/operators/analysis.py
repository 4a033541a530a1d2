"""Histograms of pair distances and what is read from them."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latticework.sources.sinks import scratch

PI4 = 4 * math.pi


def bin_width(r_cut: float, bins: int | float) -> float:
    """A whole number of bins, or a width of which a whole number covers r_cut."""
    n = bins if isinstance(bins, int) else math.ceil(r_cut / bins)
    return r_cut / n


def pair_histogram(pairs: DataFrame, r_cut: float, bins: int | float, by: tuple[str, ...] = ("interaction_id",)) -> DataFrame:
    """(by..., bin, n): pairs at 0 < r <= r_cut per bin; the last bin holds its right edge."""
    width = bin_width(r_cut, bins)
    last = round(r_cut / width) - 1
    at = F.least(F.floor(F.col("r") / width), F.lit(last)).cast("int")
    kept = pairs.where((F.col("r") > 0) & (F.col("r") <= r_cut))
    return kept.groupBy(*by, at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def filled(histogram: DataFrame, n_bins: int, group: str = "interaction_id") -> DataFrame:
    """The histogram with a row for every bin of every group."""
    bins = histogram.sparkSession.range(n_bins).select(F.col("id").cast("int").alias("bin"))
    every = histogram.select(group).distinct().crossJoin(F.broadcast(bins))
    return every.join(histogram, [group, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def rdf(histogram: DataFrame, totals: DataFrame, width: float, group: str = "interaction_id") -> DataFrame:
    """Adds g: counts over those of an ideal gas of the same density and pair fraction.

    ``totals`` holds one row (n_atoms, volume) summed over all configurations.
    """
    lo, hi = F.col("bin") * width, (F.col("bin") + 1) * width
    shell = F.lit(PI4 / 3) * (hi * hi * hi - lo * lo * lo)
    ideal = F.col("n_atoms") * F.col("n_atoms") / F.col("volume") * shell
    sums = histogram.groupBy(group).agg(F.sum("n").alias("group_n"))
    every = histogram.agg(F.sum("n").alias("all_n"))
    joined = histogram.join(F.broadcast(sums), group).crossJoin(F.broadcast(every)).crossJoin(F.broadcast(totals))
    return joined.withColumn("g", F.col("n") / (ideal * F.col("group_n") / F.col("all_n"))).drop("group_n", "all_n", "n_atoms", "volume")


def lower_bounds(histogram: DataFrame, width: float, group: str = "interaction_id") -> DataFrame:
    """Left edge of each group's first bin that holds anything."""
    return histogram.where("n > 0").groupBy(group).agg((F.min("bin") * width).alias("lower_bound"))


def savgol_weights(width: int, degree: int) -> np.ndarray:
    """Rows of fitted values: row k gives the k-th point of a window of ``width``."""
    x = np.arange(width) - width // 2
    a = np.vander(x, degree + 1, increasing=True).astype(float)
    return a @ np.linalg.pinv(a)


def savgol(histogram: DataFrame, width: int = 9, degree: int = 3, value: str = "n", group: str = "interaction_id") -> DataFrame:
    """Savitzky-Golay smoothing along ``bin``; the ends take the first and last window's fit."""
    w = savgol_weights(width, degree)
    half = width // 2
    order = Window.partitionBy(group).orderBy("bin")
    whole = Window.partitionBy(group)
    at = F.row_number().over(order) - 1
    n = F.count(F.lit(1)).over(whole)
    # Each row sees its own window, shifted inwards at the ends.
    values = F.collect_list(F.col(value).cast("double")).over(order.rowsBetween(-(width - 1), width - 1))
    first = F.greatest(F.lit(0), F.least(F.col("_at") - half, F.col("_n") - width))
    seen = F.greatest(F.lit(0), F.col("_at") - (width - 1))
    rows = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in w])
    out = histogram.withColumn("_at", at).withColumn("_n", n).withColumn("_v", values)
    window = F.slice("_v", (first - seen + 1).cast("int"), F.lit(width))
    fitted = F.aggregate(F.zip_with(window, F.get(rows, (F.col("_at") - first).cast("int")), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    smooth = F.when(F.col("_n") >= width, fitted).otherwise(F.col(value).cast("double"))
    return out.withColumn("smooth", smooth).drop("_at", "_n", "_v")


def peaks(series: DataFrame, value: str = "smooth", group: str = "interaction_id") -> DataFrame:
    """(group, peak): local maxima of a series along ``bin``; a flat top counts at its middle bin."""
    order = Window.partitionBy(group).orderBy("bin")
    step = F.when(F.col(value) != F.lag(value).over(order), 1).otherwise(0)
    runs = series.withColumn("_run", F.sum(step).over(order)).groupBy(group, "_run").agg(
        F.min("bin").alias("_lo"), F.max("bin").alias("_hi"), F.first(value).alias("_v")
    )
    along = Window.partitionBy(group).orderBy("_run")
    above = (F.col("_v") > F.lag("_v").over(along)) & (F.col("_v") > F.lead("_v").over(along))
    return runs.withColumn("_top", above).where("_top").select(group, F.floor((F.col("_lo") + F.col("_hi")) / 2).cast("int").alias("peak"))


def valleys(found: DataFrame, group: str = "interaction_id") -> DataFrame:
    """(group, valley): midpoints of adjacent peaks."""
    before = F.lag("peak").over(Window.partitionBy(group).orderBy("peak"))
    return found.withColumn("valley", (before + F.col("peak")) / 2).where("valley is not null").select(group, "valley")


def coverage(histogram: DataFrame, reference: str = "ref", value: str = "n", weight: float = 10.0, group: str = "interaction_id") -> DataFrame:
    """(group, scale, score, covered): the scale of a reference that fits best under the histogram.

    Of a scale x, a bin scores x ref where that is at most the histogram's h, and
    costs ``weight`` times its excess over h elsewhere.  Between the breakpoints
    h / ref the score is linear and at each it drops by h just beyond, so the
    best x is one of them; of equal scores the smallest.  ``covered`` is the
    area under the lower of histogram and scaled reference.
    """
    used = histogram.where(F.col(reference) > 0).withColumn("_x", F.col(value) / F.col(reference))
    every, alike = Window.partitionBy(group), Window.partitionBy(group, "_x")
    up_to = Window.partitionBy(group).orderBy("_x").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    below_ref = F.sum(reference).over(up_to) - F.sum(reference).over(alike)
    below_n = F.sum(value).over(up_to) - F.sum(value).over(alike)
    above_ref = F.sum(reference).over(every) - below_ref
    scored = used.select(group, "_x", (F.col("_x") * above_ref - weight * (F.col("_x") * below_ref - below_n)).alias("_s"))
    best = scored.groupBy(group).agg(F.min_by("_x", F.struct(-F.col("_s"), F.col("_x"))).alias("scale"), F.max("_s").alias("score"))
    low = F.least(F.col(value).cast("double"), F.col("scale") * F.col(reference))
    return used.join(best, group).groupBy(group, "scale", "score").agg(F.sum(low).alias("covered"))


def density_histogram(pairs: DataFrame, configs: DataFrame, r_cut: float, n_bins: int, group: str = "interaction_id") -> DataFrame:
    """Per-configuration density weighting: each pair counts its configuration's volume per atom.

    Divided by the configurations, by two (by four for unlike pairs), and by
    the sphere at the bin's centre.  ``pairs`` needs ``like`` (same species);
    0 < r < r_cut, strictly.
    """
    width = r_cut / n_bins
    inside = pairs.where((F.col("r") > 0) & (F.col("r") < r_cut))
    weighted = inside.join(configs.select("config_id", (F.col("volume") / F.col("size")).alias("_w")), "config_id")
    counted = weighted.groupBy(group, F.floor(F.col("r") / width).cast("int").alias("bin"), "like").agg(F.sum("_w").alias("_s"))
    n = configs.agg(F.count(F.lit(1)).alias("_n"))
    centre = (F.col("bin") + 0.5) * width
    share = F.col("_s") / F.col("_n") / F.when(F.col("like"), 2).otherwise(4) / (PI4 * centre * centre)
    return counted.crossJoin(F.broadcast(n)).select(group, "bin", share.alias("density"))


def peaks_by_width(series: DataFrame, min_width: float, value: str = "density", group: str = "interaction_id") -> DataFrame:
    """Peaks whose width at half prominence is at least ``min_width`` bins; a group is one histogram.

    A flat top counts at its middle bin, the left one of two.
    """

    def find(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("bin")
        y, bins = rows[value].to_numpy(float), rows["bin"].to_numpy()
        out = []
        edge = np.flatnonzero(np.r_[True, y[1:] != y[:-1], True])  # runs of equal values
        for first, after in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            if first == 0 or after == len(y) or not (y[first] > y[first - 1] and y[first] > y[after]):
                continue
            i = (first + after - 1) // 2
            left, right = i, i
            while left > 0 and y[left - 1] <= y[i]:
                left -= 1
            while right < len(y) - 1 and y[right + 1] <= y[i]:
                right += 1
            base = max(y[left : i + 1].min(), y[i : right + 1].min())
            height = y[i] - (y[i] - base) / 2
            a, b = i, i
            while a > left and y[a] > height:
                a -= 1
            while b < right and y[b] > height:
                b += 1
            lo = a + (height - y[a]) / (y[a + 1] - y[a]) if y[a] < height else a
            hi = b - (height - y[b]) / (y[b - 1] - y[b]) if y[b] < height else b
            if hi - lo >= min_width:
                out.append((rows[group].iloc[0], int(bins[i]), float(hi - lo)))
        return pd.DataFrame(out, columns=[group, "peak", "width"])

    kind = dict(series.dtypes)[group]
    return series.groupBy(group).applyInPandas(find, f"{group} {kind}, peak int, width double")


def closest(values: DataFrame, targets: DataFrame, group: str, value: str, target: str) -> DataFrame:
    """For each target the closest value of its group; ties go to the smaller value."""
    gap = F.abs(F.col(value) - F.col(target))
    return values.join(targets, group).groupBy(group, target).agg(F.min_by(value, F.struct(gap, F.col(value))).alias("closest"))


def element_volumes(compositions: DataFrame, species: list[int], ridge: float = 1e-6):
    """Volume per atom of each species: Huber regression of cell volume on composition.

    No intercept; pseudo-rows of ``ridge`` for every species keep absent ones at zero.  The
    robust fit iterates over the distributed rows; the result has a number per
    species.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    spark = compositions.sparkSession
    names = [f"n_{z}" for z in species]
    extra = spark.createDataFrame(
        [tuple([ridge] * len(names) + [0.0])] * len(names),
        ", ".join(f"{c} double" for c in [*names, "volume"]),
    )
    rows = compositions.select(*[F.col(c).cast("double") for c in names], F.col("volume").cast("double")).unionByName(extra)
    vectors = VectorAssembler(inputCols=names, outputCol="x").transform(rows).select("x", F.col("volume").alias("label"))
    n = max(1, vectors.count())
    fit = LinearRegression(
        featuresCol="x", loss="huber", epsilon=1.35, fitIntercept=False, standardization=False, regParam=1e-4 / n, maxIter=100
    ).fit(vectors)
    return spark.createDataFrame([(z, float(v)) for z, v in zip(species, fit.coefficients, strict=True)], "z int, volume double")


def robust_volumes(
    compositions: DataFrame, species: list[int], by: tuple[str, ...] = (), *, epsilon: float = 1.35, alpha: float = 1e-4, rounds: int = 30
) -> DataFrame:
    """(by..., z, volume, scale): volumes per atom by Huber regression with its own scale, all systems at once.

    No intercept, squared penalty ``alpha``; the loss is that of n scale + sum
    of Huber(residual / scale) scale.  A round weighs each row by its residual and adds the
    normal equations of all systems in one combinable aggregate, k (k + 1) / 2 + k + 3 sums a
    system; the small systems are solved where they lie and written.  Species
    that a system lacks have volume zero; rows without a volume are left out.
    """
    spark, k, names = compositions.sparkSession, len(species), [f"n_{z}" for z in species]
    rows = compositions.where("volume is not null").select(*by, *[F.col(c).cast("double").alias(c) for c in names], F.col("volume").cast("double").alias("y"))
    if not by:
        rows, keys = rows.withColumn("_all", F.lit(0)), ("_all",)
    else:
        keys = by
    kinds = dict(rows.dtypes)
    schema = ", ".join([*[f"{c} {kinds[c]}" for c in keys], "c array<double>, s double"])
    sums = {f"a_{i}_{j}": F.col("w") * F.col(names[i]) * F.col(names[j]) for i in range(k) for j in range(i, k)}
    sums |= {f"b_{i}": F.col("w") * F.col(names[i]) * F.col("y") for i in range(k)}
    sums |= {"squares": F.when(F.col("e") <= epsilon * F.col("s"), F.col("e") * F.col("e")).otherwise(0.0), "far": F.when(F.col("e") > epsilon * F.col("s"), 1.0).otherwise(0.0)}

    def solved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                a = np.zeros((k, k))
                for i in range(k):
                    for j in range(i, k):
                        a[i, j] = a[j, i] = row[f"a_{i}_{j}"]
                c = np.linalg.lstsq(a + alpha * row["s"] * np.eye(k), np.array([row[f"b_{i}"] for i in range(k)]), rcond=None)[0]
                near = row["n"] - row["far"] * epsilon**2
                scale = np.sqrt(row["squares"] / near) if near > 0 and row["squares"] > 0 else row["s"]
                out.append((*[row[b] for b in keys], c, scale))
            yield pd.DataFrame(out, columns=[*keys, "c", "s"])

    def written(df: DataFrame) -> DataFrame:
        path = scratch(spark, "volumes")
        df.write.parquet(path)
        return spark.read.schema(schema).parquet(path)

    zeros = F.array(*[F.lit(0.0)] * k).alias("c")
    state = written(rows.groupBy(*keys).agg(F.sqrt(F.avg(F.col("y") * F.col("y"))).alias("s")).select(*keys, zeros, "s"))
    for _ in range(rounds):
        same = [rows[c].eqNullSafe(state[c]) for c in keys]
        met = rows.join(state, same).select(*[rows[c] for c in keys], *names, "y", "c", "s")
        met = met.withColumn("e", F.abs(F.col("y") - sum((F.get("c", F.lit(i)) * F.col(n) for i, n in enumerate(names)), F.lit(0.0))))
        met = met.withColumn("w", F.when(F.col("e") <= epsilon * F.col("s"), 1.0).otherwise(epsilon * F.col("s") / F.col("e")))
        added = met.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.first("s").alias("s"), *[F.sum(v).alias(n) for n, v in sums.items()])
        state = written(added.mapInPandas(solved, schema))
    number = F.array(*[F.lit(z) for z in species])
    told = state.select(*keys, F.explode(F.arrays_zip(number.alias("z"), F.col("c").alias("volume"))).alias("v"), F.col("s").alias("scale"))
    return told.select(*by, "v.z", "v.volume", "scale")


def density_2d(rows: DataFrame, x: str, y: str, width: float) -> DataFrame:
    """2-D bin counts of reference against prediction, and their log density."""
    counted = rows.groupBy(F.floor(F.col(x) / width).cast("long").alias("bx"), F.floor(F.col(y) / width).cast("long").alias("by")).agg(
        F.count(F.lit(1)).alias("n")
    )
    low = counted.agg(F.min("n").alias("_low"))
    return counted.crossJoin(F.broadcast(low)).withColumn("log_density", F.log10(F.col("n") - F.col("_low") + 1)).drop("_low")


def bond_lengths(volumes: DataFrame, pairs: list[tuple[int, int, int]]) -> DataFrame:
    """(interaction_id, bond): diameter of a sphere with the mean atomic volume of the pair's species.

    ``volumes`` is (z, volume), ``pairs`` (interaction_id, z, z) of a basis.
    """
    spark = volumes.sparkSession
    ends = spark.createDataFrame([(i, z) for i, *both in pairs for z in both], "interaction_id int, z int")
    mean = ends.join(volumes, "z").groupBy("interaction_id").agg(F.avg("volume").alias("_v"))
    return mean.select("interaction_id", (2 * F.pow(F.col("_v") / (PI4 / 3), F.lit(1 / 3))).alias("bond"))


def suggest_cutoffs(found: DataFrame, bonds: DataFrame, group: str = "interaction_id") -> DataFrame:
    """(group, valley) of the valleys that lie at or beyond the bond length."""
    return found.join(bonds, group).where(F.col("valley") >= F.col("bond")).select(group, "valley")


def analyse(
    histogram: DataFrame, totals: DataFrame, volumes: DataFrame, pairs: list[tuple[int, int, int]], width: float, n_bins: int,
    filter_width: int = 9, filter_degree: int = 3, smooth: bool = True,
) -> dict[str, DataFrame]:
    """All that is read from a pair histogram, each a table by interaction.

    rdf, coverage (against the ideal gas), lower_bounds, peaks and valleys (as
    distances, of the smoothed distribution) and cutoffs (valleys beyond the
    bond length of ``volumes``).  Interactions without pairs have no rows.
    """
    every = filled(histogram, n_bins)
    g = rdf(every, totals, width)
    lo, hi = F.col("bin") * width, (F.col("bin") + 1) * width
    shell = F.lit(PI4 / 3) * (hi * hi * hi - lo * lo * lo)
    gas = every.crossJoin(F.broadcast(totals)).withColumn("ref", F.col("n_atoms") * F.col("n_atoms") / F.col("volume") * shell)
    series = savgol(every, filter_width, filter_degree) if smooth else every.withColumn("smooth", F.col("n").cast("double"))
    tops = peaks(series)
    centre = (F.col("peak") + 0.5) * width
    between = valleys(tops).select("interaction_id", ((F.col("valley") + 0.5) * width).alias("valley"))
    return {
        "rdf": g, "coverage": coverage(gas), "lower_bounds": lower_bounds(histogram, width),
        "peaks": tops.select("interaction_id", centre.alias("peak")), "valleys": between,
        "cutoffs": suggest_cutoffs(between, bond_lengths(volumes, pairs)),
    }
