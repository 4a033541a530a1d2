"""Small configurations with known answers."""

CONFIG = "config_id string, cell array<array<double>>, pbc array<boolean>, energy double"
ATOM = "config_id string, atom_idx int, z int, px double, py double, pz double"
SKEW = [[2.0, 0.0, 0.0], [3.0, 1.5, 0.0], [0.5, 0.0, 2.5]]
CUBE = [[30.0, 0.0, 0.0], [0.0, 30.0, 0.0], [0.0, 0.0, 30.0]]


def make(spark, name, species, positions, cell=None, periodic=False, energy=0.0):
    cell = cell and [[float(x) for x in row] for row in cell]
    configs = spark.createDataFrame([(name, cell, [periodic] * 3, energy)], CONFIG)
    rows = [(name, i, z, *map(float, p)) for i, (z, p) in enumerate(zip(species, positions, strict=True))]
    return configs, spark.createDataFrame(rows, ATOM)


def ar3(spark):
    return make(spark, "ar3", [18] * 3, [(0, 0, 0), (3, 0, 0), (0, 4, 0)])


def skewed(spark, a, b):
    return make(spark, "skewed", [a, b], [(0, 0, 0), (0.5, 0.3, 0.2)], SKEW, True)
