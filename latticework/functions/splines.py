"""Cubic B-splines as table functions for SQL."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

SCHEMA = "basis_idx int, value double, slope double"


def spline_values(knots: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place in r, number, value, slope) of the up to four cubic splines at each r, by their recursion.

    A knot belongs to the interval on its left, as in ``features.segment_join``;
    what is not inside the knots (NaN too) has no splines.
    """
    at = np.flatnonzero((r > knots[0]) & (r <= knots[-1]))
    x = r[at][:, None]
    last = np.searchsorted(knots, x, "left") - 1
    values, none = np.ones((len(at), 1)), np.zeros((len(at), 1))
    for d in (1, 2, 3):  # of degree d those from last - d to last are not zero here
        first = last + np.arange(1 - d, 1)
        lo, hi = knots[first], knots[first + d]
        part = np.divide(values, hi - lo, out=np.zeros_like(values), where=hi > lo)
        values = np.hstack([none, (x - lo) * part]) + np.hstack([(hi - x) * part, none])
    slopes = 3 * (np.hstack([none, part]) - np.hstack([part, none]))
    number = last + np.arange(-3, 1)
    inside = (number >= 0) & (number < len(knots) - 4)
    return np.repeat(at, 4).reshape(-1, 4)[inside], number[inside], values[inside], slopes[inside]


def register_bspline_expand(spark: SparkSession, knots: Sequence[float], name: str = "bspline_expand") -> None:
    """Registers two table functions of the cubic splines of these knots for SQL.

    ``name(r)``, behind LATERAL: a row (basis_idx, value, slope) for each spline
    at r.  ``name_table(TABLE (SELECT r FROM ...))``: the same for a column of
    doubles named r, with r in front, a batch of Arrow at a time; Spark does not take such
    functions behind LATERAL, so join its rows by r.  A null or NaN r, and
    one outside the knots, has no rows.  They are for ad hoc SQL: features of
    whole tables take ``features.segment_join``, which stays in generated code.
    """
    fixed = np.asarray(knots, float)
    if len(fixed) < 8 or np.ptp(fixed[:4]) or np.ptp(fixed[-4:]) or (np.diff(fixed) < 0).any():
        raise ValueError("knots ascend, the first and the last stand four times")

    class BsplineExpand:
        def eval(self, r: float):
            _, number, value, slope = spline_values(fixed, np.array([np.nan if r is None else r], float))
            yield from zip(number.tolist(), value.tolist(), slope.tolist(), strict=True)

    class BsplineTable:
        def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
            r = batch.column("r").to_numpy(zero_copy_only=False).astype(float)
            at, number, value, slope = spline_values(fixed, r)
            yield pa.table({"r": r[at], "basis_idx": number.astype("i4"), "value": value, "slope": slope})

    spark.udtf.register(name, F.udtf(BsplineExpand, returnType=SCHEMA))
    spark.udtf.register(f"{name}_table", F.arrow_udtf(BsplineTable, returnType="r double, " + SCHEMA))
