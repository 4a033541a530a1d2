"""Small dimensions: interactions, knots, spline pieces, the three-body grid, penalties.

Everything here has tens to thousands of rows whatever the data, is made with
numpy on the driver, and travels as a broadcast dimension.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import DataFrame, SparkSession

DEGREE = 3


def knot_points(strategy: str, r_min: float | None, r_max: float, intervals: int, offset: int = 3) -> np.ndarray:
    """intervals + 1 knots: linear, lammps (even in r^2), inverse (in 1/r) or geometric."""
    if r_min is None:
        if strategy != "linear":
            raise ValueError("only linear knots choose their own lower bound")
        r_min = -offset * r_max / (intervals - offset)
    if strategy == "linear":
        return np.round(np.linspace(r_min, r_max, intervals + 1), 10)
    if strategy == "lammps":
        return np.sqrt(np.linspace(r_min**2, r_max**2, intervals + 1))
    if strategy == "inverse":
        return 1 / np.linspace(1 / r_min, 1 / r_max, intervals + 1)
    if strategy == "geometric":
        return np.geomspace(r_min, r_max, intervals + 1)
    raise ValueError(f"unknown knot strategy {strategy!r}")


def knot_sequence(points: np.ndarray) -> np.ndarray:
    """Knots with both ends repeated three times more."""
    return np.concatenate([np.repeat(points[0], DEGREE), points, np.repeat(points[-1], DEGREE)])


def spline_pieces(knots: np.ndarray) -> list[tuple[int, int, float, float, float, float, float, float]]:
    """(basis, segment, t_lo, t_hi, c0..c3): each cubic B-spline per knot interval, in powers of r - t_lo."""
    pieces = []
    for seg in np.flatnonzero(knots[:-1] < knots[1:]).tolist():
        lo = knots[seg]
        # Non-zero splines of degree d on this interval, by their first knot.
        level = {seg: np.array([1.0])}
        for d in range(1, DEGREE + 1):
            raised: dict[int, np.ndarray] = {}
            for i in range(seg - d, seg + 1):
                poly = np.zeros(d + 1)
                for start, (c0, c1), span in (
                    (i, (lo - knots[i], 1.0), knots[i + d] - knots[i]) if 0 <= i else (None, (0, 0), 0),
                    (i + 1, (knots[i + d + 1] - lo, -1.0), knots[i + d + 1] - knots[i + 1])
                    if 0 <= i and i + d + 1 < len(knots)
                    else (None, (0, 0), 0),
                ):
                    if start in level and span > 0:
                        poly += np.convolve(level[start], [c0 / span, c1 / span])
                raised[i] = poly
            level = raised
        for i, poly in level.items():
            if 0 <= i <= len(knots) - DEGREE - 2:
                pieces.append((i, seg, float(lo), float(knots[seg + 1]), *map(float, poly)))
    return sorted(pieces)


def symmetry_class(trio: tuple, legs: list[tuple]) -> int:
    """1: nothing may be exchanged; 2: the two centre legs; 3: all three legs."""
    if trio[1] != trio[2] or legs[0] != legs[1]:
        return 1
    if legs[1] == legs[2]:
        return 3 if trio[0] == trio[1] else 2
    return 2


def grid_weights(symmetry: int, l: np.ndarray, m: np.ndarray, n: np.ndarray, lead: int, trail: int) -> np.ndarray:
    """Weight of each cell of the three-body grid; 0 where it is redundant, impossible or trimmed."""
    size = [len(k) - DEGREE - 1 for k in (l, m, n)]
    i, j, k = np.meshgrid(*map(np.arange, size), indexing="ij")
    w = np.ones(size)
    if symmetry == 2:
        w = np.where(i > j, 0.0, np.where(i == j, 0.5, 1.0))
    elif symmetry == 3:
        ties = np.where((i == j) & (j == k), 1 / 6, np.where((i == j) | (j == k), 0.5, 1.0))
        w = np.where((i > j) | (j > k), 0.0, ties)
    low, high = (l[i], m[j], n[k]), (l[i + 4], m[j + 4], n[k + 4])
    for a, b, c in ((0, 1, 2), (0, 2, 1), (1, 2, 0)):
        w = np.where(high[a] + high[b] <= low[c], 0.0, w)  # no triangle has such sides
    for at, s in zip((i, j, k), size, strict=True):
        w = np.where((at < lead) | (at >= s - trail), 0.0, w)
    return w


@dataclass(frozen=True)
class Interaction:
    """One-, two- or three-body interaction, its knots and its place among the features."""

    number: int
    species: tuple[int, ...]
    knots: tuple[np.ndarray, ...]
    offset: int
    size: int
    symmetry: int = 1
    weights: np.ndarray | None = field(default=None, compare=False)

    @property
    def degree(self) -> int:
        return len(self.species)


# Cut-offs and resolutions where none are given.
DEFAULT_PAIR = (1.0, 8.0, 15)
DEFAULT_TRIO = (1.0, 8.0, 5)


@dataclass
class Basis:
    """All interactions of a set of species, in feature order: 1-body, pairs, trios.

    ``pairs`` and ``trios`` map species tuples to (r_min, r_max, resolution);
    for trios each entry may be a triple, one value per leg.  Missing ones take
    the defaults (a trio's far leg reaches twice as far, at twice the resolution).
    """

    species: tuple[int, ...]
    pairs: dict[tuple[int, int], tuple] = field(default_factory=dict)
    trios: dict[tuple[int, int, int], tuple] = field(default_factory=dict)
    degree: int = 2
    strategy: str = "linear"
    lead: dict[int, int] = field(default_factory=lambda: {2: 0, 3: 3})
    trail: dict[int, int] = field(default_factory=lambda: {2: 3, 3: 3})

    def __post_init__(self) -> None:
        self.species = tuple(sorted(self.species))
        self.interactions: list[Interaction] = []
        offset = 0
        for z in self.species:
            self.interactions.append(Interaction(len(self.interactions), (z,), (), offset, 1))
            offset += 1
        for pair in combinations_with_replacement(self.species, 2):
            lo, hi, n = self.pairs.get(pair, DEFAULT_PAIR)
            knots = knot_sequence(knot_points(self.strategy, lo, hi, n))
            size = len(knots) - DEGREE - 1
            self.interactions.append(Interaction(len(self.interactions), pair, (knots,), offset, size))
            offset += size
        if self.degree > 2:
            for z in self.species:
                for two in combinations_with_replacement(self.species, 2):
                    offset = self._add_trio((z, *two), offset)
        self.n_features = offset

    def _add_trio(self, trio: tuple[int, int, int], offset: int) -> int:
        lo, hi, n = self.trios.get(trio, DEFAULT_TRIO)
        lo = lo if isinstance(lo, tuple) else (lo, lo, lo)
        hi = hi if isinstance(hi, tuple) else (hi, hi, 2 * hi)
        n = n if isinstance(n, tuple) else (n, n, 2 * n)
        legs = list(zip(lo, hi, n, strict=True))
        knots = tuple(knot_sequence(knot_points(self.strategy, *leg)) for leg in legs)
        symmetry = symmetry_class(trio, legs)
        weights = grid_weights(symmetry, *knots, self.lead[3], self.trail[3])
        size = int((weights > 0).sum())
        self.interactions.append(
            Interaction(len(self.interactions), trio, knots, offset, size, symmetry, weights)
        )
        return offset + size

    def of_degree(self, degree: int) -> list[Interaction]:
        return [x for x in self.interactions if x.degree == degree]

    @property
    def reach(self) -> float:
        """Largest distance of a pair, or of a centre and its neighbour."""
        legs = [x.knots[0][-1] for x in self.of_degree(2)] + [k[-1] for x in self.of_degree(3) for k in x.knots[:2]]
        return float(max(legs))

    def feature_names(self) -> list[str]:
        return [
            f"n_{x.species[0]}" if x.degree == 1 else f"{'-'.join(map(str, x.species))}_{k}"
            for x in self.interactions
            for k in range(x.size)
        ]

    def frozen(self, offset_1b: bool = True) -> list[int]:
        """Features held at zero: trimmed pair splines, and the 1-body terms if told."""
        out = [] if offset_1b else [x.offset for x in self.of_degree(1)]
        for x in self.of_degree(2):
            out += [x.offset + k for k in range(x.size) if k < self.lead[2] or k >= x.size - self.trail[2]]
        return out

    def beyond(self, pairs: dict[tuple[int, int], int], trios: dict[tuple[int, int, int], tuple[int, int, int]] | None = None) -> list[int]:
        """Features that a smaller cut-off leaves out, for so many knot intervals per pair or trio leg.

        With trailing trims of three, the features kept are those that the
        smaller basis would give, so nothing is computed anew.
        """
        out = []
        for x in self.of_degree(2):
            kept = pairs.get(x.species, x.size - DEGREE) + DEGREE - self.trail[2]
            out += [x.offset + k for k in range(min(kept, x.size), x.size)]
        for x in self.of_degree(3):
            if not trios or x.species not in trios:
                continue
            kept = [n + DEGREE - self.trail[3] for n in trios[x.species]]
            for k, cell in enumerate(np.argwhere(x.weights > 0).tolist()):
                if any(c >= m for c, m in zip(cell, kept, strict=True)):
                    out.append(x.offset + k)
        return out

    # --- dimension tables ---------------------------------------------------

    def interactions_table(self, spark: SparkSession) -> DataFrame:
        rows = [
            (x.number, x.degree, list(x.species), x.symmetry, x.offset, x.size,
             [float(k[0]) for k in x.knots], [float(k[-1]) for k in x.knots])
            for x in self.interactions
        ]
        return spark.createDataFrame(
            rows,
            "interaction_id int, degree int, species array<int>, symmetry int, feat_offset int, feat_size int, "
            "r_min array<double>, r_max array<double>",
        )

    def pieces(self, degree: int) -> list[tuple]:
        """(interaction_id, leg, basis_idx, t_lo, t_hi, c0, c1, c2, c3); trimmed pair splines are left out."""
        out = []
        for x in self.of_degree(degree):
            for leg, knots in enumerate(x.knots):
                for i, _, lo, hi, *c in spline_pieces(knots):
                    if degree == 2 and not self.lead[2] <= i < x.size - self.trail[2]:
                        continue
                    out.append((x.number, leg, i, lo, hi, *c))
        return out

    def pieces_table(self, spark: SparkSession, degree: int) -> DataFrame:
        return spark.createDataFrame(
            self.pieces(degree),
            "interaction_id int, leg int, basis_idx int, t_lo double, t_hi double, "
            "c0 double, c1 double, c2 double, c3 double",
        )

    def segments_table(self, spark: SparkSession, degree: int) -> DataFrame:
        """The pieces by knot interval: (interaction_id, leg, t_lo, t_hi, parts), up to four parts (basis_idx, c0..c3) each."""
        found: dict[tuple, list[tuple]] = {}
        for number, leg, i, lo, hi, *c in self.pieces(degree):
            found.setdefault((number, leg, lo, hi), []).append((i, *c))
        rows = [(*k, parts) for k, parts in found.items()]
        part = "struct<basis_idx: int, c0: double, c1: double, c2: double, c3: double>"
        return spark.createDataFrame(rows, f"interaction_id int, leg int, t_lo double, t_hi double, parts array<{part}>")

    def grid(self) -> list[tuple[int, int, int, int, int, float]]:
        """(interaction_id, l, m, n, feature_idx, weight): every image of every kept cell."""
        out = []
        for x in self.of_degree(3):
            swaps = {1: [(0, 1, 2)], 2: [(0, 1, 2), (1, 0, 2)]}.get(
                x.symmetry, [(0, 1, 2), (0, 2, 1), (1, 0, 2), (1, 2, 0), (2, 0, 1), (2, 1, 0)]
            )
            kept = np.argwhere(x.weights > 0)
            for k, cell in enumerate(kept.tolist()):
                total: dict[tuple[int, ...], float] = {}
                for s in swaps:
                    image = tuple(cell[a] for a in s)
                    total[image] = total.get(image, 0.0) + float(x.weights[tuple(cell)])
                out += [(x.number, *image, x.offset + k, w) for image, w in total.items()]
        return out

    def grid_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.grid(), "interaction_id int, l int, m int, n int, feature_idx int, weight double")

    def shares(self) -> list[tuple[int, int, int, int, int, float]]:
        """(interaction_id, l, m, n, feature_idx, share): what each cell of a full grid adds to the mean of a kept cell's images."""
        swaps = {1: 1, 2: 2, 3: 6}
        kept = {x.offset + k: float(w) for x in self.of_degree(3) for k, w in enumerate(x.weights[x.weights > 0])}
        count = {x.number: swaps[x.symmetry] for x in self.of_degree(3)}
        return [(i, l, m, n, f, w / kept[f] / count[i]) for i, l, m, n, f, w in self.grid()]

    def shares_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.shares(), "interaction_id int, l int, m int, n int, feature_idx int, share double")

    def penalties(self, strengths: dict[str, float] | None = None) -> list[tuple[int, int, float]]:
        """Sparse regulariser rows (row, feature_idx, value): ridge and curvature per degree."""
        s = {"ridge_1b": 1e-16, "ridge_2b": 0.0, "ridge_3b": 1e-10, "curve_2b": 1e-16, "curve_3b": 1e-16} | (strengths or {})
        out: list[tuple[int, int, float]] = []
        row = 0
        for x in self.interactions:
            ridge, curve = s[f"ridge_{x.degree}b"] ** 0.5, s.get(f"curve_{x.degree}b", 0.0) ** 0.5
            if ridge:
                out += [(row + k, x.offset + k, ridge) for k in range(x.size)]
                row += x.size
            if curve and x.degree == 2:
                for k in range(x.size):
                    near = [q for q in (k - 1, k + 1) if 0 <= q < x.size]
                    out += [(row + k, x.offset + q, curve) for q in near] + [(row + k, x.offset + k, -curve * len(near))]
                row += x.size
            if curve and x.degree == 3:
                cells = {tuple(c): k for k, c in enumerate(np.argwhere(x.weights > 0).tolist())}
                for cell, k in cells.items():
                    near = [cells.get(tuple(c + d * (a == axis) for a, c in enumerate(cell))) for axis in range(3) for d in (-1, 1)]
                    near = [q for q in near if q is not None]
                    out += [(row + k, x.offset + q, curve) for q in near] + [(row + k, x.offset + k, -curve * len(near))]
                row += x.size
        return out

    def penalties_table(self, spark: SparkSession, strengths: dict[str, float] | None = None) -> DataFrame:
        return spark.createDataFrame(self.penalties(strengths), "row int, feature_idx int, value double")


def _intervals(lo: float, hi: float, spacing: float, name: str) -> int:
    n = round((hi - lo) / spacing)
    if n < 1 or abs(n * spacing - (hi - lo)) > 1e-8 * max(1.0, abs(hi - lo)):
        raise ValueError(f"{name}: {hi - lo} is no whole number of intervals of {spacing}")
    return n


def basis_from_spacing(
    species: tuple[int, ...], pair: tuple[float, float, float], trio: tuple[float, float, float] | None = None, lead: int = 0, trail: int = 3
) -> Basis:
    """A basis of evenly spaced knots from (r_min, r_max, spacing) of pairs and of a trio's near legs.

    The far leg reaches twice as far.  All reaches are whole numbers of
    intervals, so that smaller cut-offs are columns left out.
    """
    if (lead, trail) != (0, 3):
        raise ValueError("columns can be left out for smaller cut-offs only with trims of 0 and 3")
    species = tuple(sorted(species))
    lo, hi, step = pair
    pairs = {p: (lo, hi, _intervals(lo, hi, step, "pairs")) for p in combinations_with_replacement(species, 2)}
    trios = {}
    if trio is not None:
        lo, hi, step = trio
        near, far = _intervals(lo, hi, step, "near legs"), _intervals(lo, 2 * hi, step, "far legs")
        trios = {
            (z, *two): (lo, (hi, hi, 2 * hi), (near, near, far)) for z in species for two in combinations_with_replacement(species, 2)
        }
    return Basis(species, pairs, trios, degree=3 if trio else 2, lead={2: lead, 3: lead}, trail={2: trail, 3: trail})


def lower_cutoffs(basis: Basis) -> dict[str, list[float]]:
    """Cut-offs that leaving out columns can reach: inner knots from the first whole spline on, of pairs and of near legs."""
    pair = basis.of_degree(2)[0].knots[0]
    found = {"rmax_2b": pair[DEGREE + 1 : -DEGREE].tolist()}
    if basis.degree > 2:
        found["rmax_3b"] = basis.of_degree(3)[0].knots[0][DEGREE + 1 : -DEGREE].tolist()
    return found
