import numpy as np
import pytest

from latticework.operators.basis import Basis, grid_weights, knot_points, knot_sequence, spline_pieces, symmetry_class


def value(knots, r):
    out = np.zeros(len(knots) - 4)
    for i, _, lo, hi, *c in spline_pieces(knots):
        if lo < r <= hi:
            out[i] = sum(a * (r - lo) ** p for p, a in enumerate(c))
    return out


def test_knots():
    assert knot_sequence(knot_points("linear", 1, 3, 2)).tolist() == [1, 1, 1, 1, 2, 3, 3, 3, 3]
    assert knot_points("linear", 1, 6, 5).tolist() == [1, 2, 3, 4, 5, 6]
    assert round(knot_points("lammps", 0, 1, 2)[1], 4) == 0.7071
    assert np.allclose(knot_points("inverse", 1, 2, 2), [1, 4 / 3, 2])
    assert np.allclose(knot_points("geometric", 1, 4, 2), [1, 2, 4])
    assert knot_points("linear", None, 4, 5)[0] == -6
    with pytest.raises(ValueError):
        knot_points("lammps", None, 4, 5)


def test_splines_on_one_interval():
    knots = knot_sequence(np.array([0.0, 1.0]))
    got = np.array([value(knots, r) for r in (1e-10, 0.5, 1 - 1e-10)]).T
    assert np.allclose(got, [[1, 0.125, 0], [0, 0.375, 0], [0, 0.375, 0], [0, 0.125, 1]], atol=1e-8)


@pytest.mark.parametrize("strategy", ["linear", "lammps", "inverse", "geometric"])
def test_splines_sum_to_one(strategy):
    knots = knot_sequence(knot_points(strategy, 1.0, 6.0, 7))
    for r in np.linspace(1.001, 5.999, 40):
        assert abs(value(knots, r).sum() - 1) < 1e-12


def test_feature_layout():
    basis = Basis((1, 2))
    assert [x.size for x in basis.interactions] == [1, 1, 18, 18, 18]
    assert [x.offset for x in basis.interactions] == [0, 1, 2, 20, 38] and len(basis.feature_names()) == 56
    assert basis.frozen()[:3] == [17, 18, 19] and 0 in basis.frozen(offset_1b=False)
    deep = Basis((1, 2, 3, 4), degree=3)
    assert [len(deep.of_degree(d)) for d in (1, 2, 3)] == [4, 10, 40]


def test_symmetry_classes():
    leg, far = (1, 5, 5), (1, 10, 10)
    assert symmetry_class((1, 1, 1), [leg] * 3) == 3
    assert symmetry_class((2, 1, 1), [leg] * 3) == 2
    assert symmetry_class((1, 1, 1), [leg, leg, far]) == 2
    assert symmetry_class((1, 1, 2), [leg] * 3) == 1
    assert symmetry_class((1, 1, 1), [leg, far, leg]) == 1


@pytest.mark.parametrize("symmetry", [1, 2, 3])
def test_grid_images_cover_each_cell_once(symmetry):
    knots = knot_sequence(knot_points("linear", 1, 5, 4))
    w = grid_weights(symmetry, knots, knots, knots, 0, 0)
    swaps = {1: [(0, 1, 2)], 2: [(0, 1, 2), (1, 0, 2)]}.get(symmetry, [(0, 1, 2), (0, 2, 1), (1, 0, 2), (1, 2, 0), (2, 0, 1), (2, 1, 0)])
    total = sum(np.transpose(w, s) for s in swaps)
    assert set(np.unique(total.round(9))) <= {0.0, 1.0}
    assert (grid_weights(symmetry, knots, knots, knots, 1, 3)[0] == 0).all()


def test_penalties():
    basis = Basis((1,), {(1, 1): (1, 5, 2)})
    rows = basis.penalties({"ridge_1b": 4.0, "ridge_2b": 9.0, "curve_2b": 1.0})
    m = np.zeros((max(r for r, _, _ in rows) + 1, basis.n_features))
    for r, c, v in rows:
        m[r, c] += v
    assert m[0, 0] == 2 and np.allclose(m[1:6, 1:], 3 * np.eye(5))
    assert np.allclose(m[6:, 1:], [[-1, 1, 0, 0, 0], [1, -2, 1, 0, 0], [0, 1, -2, 1, 0], [0, 0, 1, -2, 1], [0, 0, 0, 1, -1]])
