import numpy as np
import pytest

from latticework.functions.splines import register_bspline_expand, spline_values
from latticework.operators.basis import knot_sequence, spline_pieces

KNOTS = [0, 0, 0, 0, 1, 2, 2.5, 4, 4, 4, 4]


@pytest.mark.parametrize("knots", [KNOTS, knot_sequence(np.array([0.5, 1.0, 1.75, 3.0]))])
def test_values_and_slopes_equal_the_pieces(knots):
    knots = np.asarray(knots, float)
    r = np.array([*np.linspace(knots[0] - 0.5, knots[-1] + 0.5, 41), *knots, np.nan, np.inf])
    want = {}
    for b, _, lo, hi, *c in spline_pieces(knots):
        for i, x in enumerate(r):
            if lo < x <= hi:
                d = x - lo
                want[i, b] = (c[0] + d * (c[1] + d * (c[2] + d * c[3])), c[1] + d * (2 * c[2] + d * 3 * c[3]))
    got = {(int(i), int(b)): (v, s) for i, b, v, s in zip(*spline_values(knots, r), strict=True)}
    assert {k for k, v in want.items() if abs(v[0]) > 1e-12} <= set(got)
    for key, pair in got.items():
        assert np.allclose(pair, want.get(key, (0, pair[1])), atol=1e-9)
    assert spline_values(knots, np.zeros(0))[0].size == 0


def test_table_functions_in_sql(spark):
    with pytest.raises(ValueError, match="four times"):
        register_bspline_expand(spark, range(12))
    register_bspline_expand(spark, KNOTS)
    rows = [(1, 0.5), (2, 4.0), (3, 5.0), (4, None), (5, 2.0), (6, float("nan")), (7, 0.0), (8, 0.5)]
    spark.createDataFrame(rows, "id int, r double").createOrReplaceTempView("spline_points")
    lateral = spark.sql("SELECT id, b.* FROM spline_points, LATERAL bspline_expand(r) b").collect()
    joined = spark.sql(
        "SELECT id, b.basis_idx, b.value, b.slope FROM spline_points JOIN bspline_expand_table(TABLE(SELECT DISTINCT r FROM spline_points)) b USING (r)"
    ).collect()
    assert sorted(map(tuple, lateral)) == sorted(map(tuple, joined))
    assert {r.id for r in lateral} == {1, 2, 5, 8}
    for i in (1, 2, 5):
        assert abs(sum(r.value for r in lateral if r.id == i) - 1) < 1e-12 and abs(sum(r.slope for r in lateral if r.id == i)) < 1e-9
