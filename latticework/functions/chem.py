"""Column functions over species, hashes and vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Chemical symbols in order of atomic number.
SYMBOLS = (
    "H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr Rb Sr Y Zr Nb "
    "Mo Tc Ru Rh Pd Ag Cd In Sn Sb Te I Xe Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu Hf Ta W Re Os Ir Pt Au "
    "Hg Tl Pb Bi Po At Rn Fr Ra Ac Th Pa U Np Pu Am Cm Bk Cf Es Fm Md No Lr Rf Db Sg Bh Hs Mt Ds Rg Cn Nh Fl Mc Lv Ts "
    "Og"
).split()


def elements(spark: SparkSession) -> DataFrame:
    """The element table (symbol, z): 118 rows."""
    return spark.createDataFrame([(s, i) for i, s in enumerate(SYMBOLS, 1)], "symbol string, z int")


def atomic_number(symbol: Column) -> Column:
    """Atomic number of a symbol column; null where unknown."""
    table = F.create_map(*[F.lit(x) for pair in zip(SYMBOLS, range(1, 119), strict=True) for x in pair])
    return F.try_element_at(table, symbol)


def symbol_of(z: Column) -> Column:
    return F.try_element_at(F.array(*map(F.lit, SYMBOLS)), z)


def szudzik(x: Column, y: Column) -> Column:
    """Pairing of two non-negative integers, ordered: (x, y) and (y, x) differ."""
    x, y = x.cast("long"), y.cast("long")
    return F.when(x > y, x * x + y).otherwise(y * y + x + y)


def unszudzik(h: Column) -> tuple[Column, Column]:
    root = F.floor(F.sqrt(h.cast("double"))).cast("long")
    rest = h - root * root
    return F.when(rest < root, root).otherwise(rest - root), F.when(rest < root, rest).otherwise(root)


def szudzik_array(values: Column) -> Column:
    """Fold of the pairing over an integer array; null for an empty array."""
    rest = F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0)))
    return F.when(F.size(values) > 0, F.aggregate(rest, F.get(values, F.lit(0)).cast("long"), szudzik))


def unszudzik_array(h: Column, n: int) -> Column:
    """The ``n`` integers whose fold by ``szudzik_array`` is ``h``."""
    values: list[Column] = []
    for _ in range(n - 1):
        h, last = unszudzik(h)
        values.insert(0, last)
    return F.array(h.cast("long"), *values)


def symbols_hash(symbols: Column) -> Column:
    """Hash of an array of element symbols, in their order."""
    return szudzik_array(F.transform(symbols, atomic_number))


def hash_symbols(h: Column, n: int = 2) -> Column:
    """The ``n`` element symbols of a hash."""
    return F.transform(unszudzik_array(h, n), lambda z: symbol_of(z.cast("int")))


def pair_hash(z_i: Column, z_j: Column) -> Column:
    """Hash of an unordered pair: the same for both directions."""
    return szudzik(F.least(z_i, z_j), F.greatest(z_i, z_j))


def trio_hash(z_i: Column, z_j: Column, z_k: Column) -> Column:
    """Hash of a centre and its unordered neighbours."""
    return szudzik(szudzik(z_i, F.least(z_j, z_k)), F.greatest(z_j, z_k))


def norm(*xs: Column) -> Column:
    total = xs[0] * xs[0]
    for x in xs[1:]:
        total = total + x * x
    return F.sqrt(total)


def component(vector: Column, k: int) -> Column:
    return F.get(vector, F.lit(k))


def cross(a: Column, b: Column) -> Column:
    """Cross product of two three-vectors as an array."""
    at = component
    return F.array(*[at(a, (k + 1) % 3) * at(b, (k + 2) % 3) - at(a, (k + 2) % 3) * at(b, (k + 1) % 3) for k in range(3)])


def dot(a: Column, b: Column) -> Column:
    return component(a, 0) * component(b, 0) + component(a, 1) * component(b, 1) + component(a, 2) * component(b, 2)


def length(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def volume(cell: Column) -> Column:
    """Volume of a 3 x 3 cell."""
    return F.abs(dot(component(cell, 0), cross(component(cell, 1), component(cell, 2))))
