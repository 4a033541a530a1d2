"""Stand-in configurations from the star-schema tables: an order is a configuration, its lines are atoms.

Places lie on an integer lattice, so squared distances are exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from latticework.operators.basis import Basis

SPECIES = (1, 2, 3)
#: Force per price; so many digits that rounding meets no ties.
FORCE_SCALE = 1.0123456789e-4
LINE_ORDER = (
    "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag",
    "l_linestatus", "l_shipdate",
)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("config_id"), F.col("o_orderstatus").alias("prefix"), F.col("o_orderkey").alias("seq"),
        F.col("o_totalprice").alias("energy"), F.col("o_custkey").alias("cust"),
    )


def atoms(spark: SparkSession, sf_dir: str, *, index: bool = False, forces: bool = False) -> DataFrame:
    """Places and species; ``index`` numbers the atoms of a configuration by all columns of their line."""
    lines = read(spark, sf_dir, "lineitem")
    if index:  # numbered before the columns are made, so that all tables of one query share one shuffle of the lines
        lines = lines.withColumn("_idx", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)) - 1)
    force = [(F.col("l_extendedprice") * FORCE_SCALE).alias("fx"), F.col("l_discount").alias("fy"), F.col("l_tax").alias("fz")]
    return lines.select(
        F.col("l_orderkey").alias("config_id"), (F.col("_idx") if index else F.lit(0)).alias("atom_idx"),
        F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).otherwise(3).alias("z"),
        F.col("l_quantity").alias("px"), F.round(F.col("l_discount") * 100).alias("py"), F.round(F.col("l_tax") * 100).alias("pz"),
        *(force if forces else []),
    )


def pair_basis(degree: int = 2) -> Basis:
    """Whole-number knots: pairs to 12 apart; trios with legs to 6 and 8."""
    pairs = {(a, b): (0.0, 12.0, 12) for a in SPECIES for b in SPECIES if a <= b}
    trios = {(a, b, c): (0.0, (6.0, 6.0, 8.0), (3, 3, 4)) for a in SPECIES for b in SPECIES for c in SPECIES if b <= c}
    trios = {k: ((0.0, 0.0, 0.0), v[1], v[2]) for k, v in trios.items()}
    return Basis(SPECIES, pairs, trios, degree=degree, lead={2: 0, 3: 0}, trail={2: 3, 3: 1})


# --- the same in SQL ---------------------------------------------------------

ATOMS_SQL = f"""
    atoms AS (
        SELECT l_orderkey AS config_id,
               row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(LINE_ORDER)}) - 1 AS atom_idx,
               CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS z,
               l_quantity AS px, round(l_discount * 100) AS py, round(l_tax * 100) AS pz,
               l_extendedprice * {FORCE_SCALE!r} AS fx, l_discount AS fy, l_tax AS fz
        FROM lineitem
    )"""
PAIRS_SQL = (
    ATOMS_SQL
    + """, pairs AS (
        SELECT config_id, i, j, zi, zj, r, ux / r AS ux, uy / r AS uy, uz / r AS uz FROM (
            SELECT a.config_id, a.atom_idx AS i, b.atom_idx AS j, least(a.z, b.z) AS zi, greatest(a.z, b.z) AS zj,
                   b.px - a.px AS ux, b.py - a.py AS uy, b.pz - a.pz AS uz,
                   sqrt((a.px - b.px) * (a.px - b.px) + (a.py - b.py) * (a.py - b.py) + (a.pz - b.pz) * (a.pz - b.pz)) AS r
            FROM atoms a JOIN atoms b ON a.config_id = b.config_id
        ) WHERE r > 0
    )"""
)


def values_sql(name: str, columns: str, rows: list[tuple]) -> str:
    """A common table of literal rows; floats with an exponent, so that they are doubles, not decimals."""

    def literal(x) -> str:
        text = repr(x)
        return text + "e0" if isinstance(x, float) and "e" not in text else text

    body = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows)
    return f"{name}({columns}) AS (SELECT * FROM (VALUES {body}))"


def pairs_with_ids_sql(basis: Basis) -> str:
    ids = values_sql("ids", "zi, zj, interaction_id, feat_offset", [(*x.species, x.number, x.offset) for x in basis.of_degree(2)])
    return f"{PAIRS_SQL}, {ids}, near AS (SELECT * FROM pairs JOIN ids USING (zi, zj) WHERE r < 12)"


def pieces_sql(basis: Basis, degree: int) -> str:
    return values_sql("pieces", "interaction_id, leg, basis_idx, t_lo, t_hi, c0, c1, c2, c3", basis.pieces(degree))


def splines_sql(name: str, hi: int, points: str) -> str:
    """Cubic B-splines and their slopes on whole-number knots from 0 to ``hi``, by the Cox-de Boor recursion.

    ``name``(r, basis_idx, b, slope) for the distinct r of ``points``, a row per
    spline whose support (left end open) holds r.
    """

    def raised(d: int) -> str:
        rise = f"coalesce((r - t[k]) / nullif(t[k + {d}] - t[k], 0) * b{d - 1}[k], 0)"
        fall = f"coalesce((t[k + {d + 1}] - r) / nullif(t[k + {d + 1}] - t[k + 1], 0) * b{d - 1}[k + 1], 0)"
        return f"list_transform(range(1, {hi + 7 - d}), lambda k: {rise} + {fall}) AS b{d}"

    knots = f"list_concat(list_concat([0, 0, 0], range(0, {hi + 1})), [{hi}, {hi}, {hi}])::DOUBLE[]"
    zero = f"list_transform(range(1, {hi + 7}), lambda k: CASE WHEN t[k] < r AND r <= t[k + 1] THEN 1e0 ELSE 0e0 END) AS b0"
    slope = "3 * (coalesce(b2[k] / nullif(t[k + 3] - t[k], 0), 0) - coalesce(b2[k + 1] / nullif(t[k + 4] - t[k + 1], 0), 0))"
    return f"""
    {name}_0 AS (SELECT DISTINCT r, {knots} AS t FROM ({points})), {name}_1 AS (SELECT *, {zero} FROM {name}_0),
    {name}_2 AS (SELECT *, {raised(1)} FROM {name}_1), {name}_3 AS (SELECT *, {raised(2)} FROM {name}_2),
    {name}_4 AS (SELECT *, {raised(3)} FROM {name}_3),
    {name} AS (
        SELECT r, CAST(k - 1 AS INTEGER) AS basis_idx, b3[k] AS b, {slope} AS slope
        FROM {name}_4, range(1, {hi + 4}) s(k) WHERE t[k] < r AND r <= t[k + 4]
    )"""


def solve_sql(g: str, o: str, by: str = "model") -> str:
    """``solved``({by}, i, c): Gauss-Jordan elimination of symmetric systems g(by, i, j, value), i <= j, and o(by, i, value)."""
    return f"""
    idx AS (
        SELECT {by}, i, row_number() OVER (PARTITION BY {by} ORDER BY i) - 1 AS r, count(*) OVER (PARTITION BY {by}) AS d
        FROM (SELECT {by}, i FROM {g} UNION SELECT {by}, j FROM {g} UNION SELECT {by}, i FROM {o})
    ), entries AS (
        SELECT {by}, i, j, sum(value) AS value FROM (SELECT {by}, i, j, value FROM {g} UNION ALL SELECT {by}, j, i, value FROM {g} WHERE i < j)
        GROUP BY 1, 2, 3
    ), system AS (
        SELECT a.{by}, a.i, a.r, a.d, list_append(list(coalesce(e.value, 0e0) ORDER BY b.r), coalesce(any_value(o.value), 0e0)) AS row
        FROM idx a JOIN idx b USING ({by}) LEFT JOIN entries e ON e.{by} = a.{by} AND e.i = a.i AND e.j = b.i
        LEFT JOIN (SELECT {by}, i, sum(value) AS value FROM {o} GROUP BY 1, 2) o ON o.{by} = a.{by} AND o.i = a.i GROUP BY 1, 2, 3, 4
    ), gauss AS (
        SELECT {by}, i, r, d, row, 0 AS k FROM system
        UNION ALL
        SELECT {by}, i, r, d, CASE WHEN r = k THEN piv ELSE list_transform(row, lambda x, q: x - row[k + 1] * piv[q]) END, k + 1 FROM (
            SELECT *, list_transform(top, lambda x: x / top[k + 1]) AS piv FROM (
                SELECT *, max(CASE WHEN r = k THEN row END) OVER (PARTITION BY {by}) AS top FROM gauss WHERE k < d
            )
        )
    ), solved AS (SELECT {by}, i, row[d + 1] AS c FROM gauss WHERE k = d)"""


HORNER_SQL = "(c0 + (r - t_lo) * (c1 + (r - t_lo) * (c2 + (r - t_lo) * c3)))"
SLOPE_SQL = "(c1 + (r - t_lo) * (2 * c2 + (r - t_lo) * 3 * c3))"
