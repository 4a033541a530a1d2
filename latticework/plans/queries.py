"""Registered queries over the star-schema tables, each with its SQL where SQL can say it.

Operators are applied to the stand-ins of ``standin``; float sums are rounded
to six digits, since the order of addition differs between engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from latticework.functions.chem import pair_hash, szudzik, szudzik_array, unszudzik
from latticework.functions.splines import register_bspline_expand
from latticework.operators import analysis, basis as dims, features, fit, neighbours, repair, sampling, score, tables, tiles

from latticework.sources.sinks import scratch

from . import standin
from .standin import ATOMS_SQL, HORNER_SQL, PAIRS_SQL, SLOPE_SQL, pairs_with_ids_sql, pieces_sql, solve_sql, splines_sql, values_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
Query = Callable[[SparkSession, str], DataFrame]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _r6(c, name: str):
    """Six digits, and no negative zero."""
    return (F.round(c, 6) + F.lit(0.0)).alias(name)


#: Energies of the stand-ins per price; so many digits that rounding meets no ties.
SCALE = 1.0123456789e-4


BASIS = standin.pair_basis()
DEEP = standin.pair_basis(degree=3)
R_CUT, WIDTH = 12.0, 1.0


def _pairs(spark: SparkSession, sf: str, index: bool = False) -> DataFrame:
    return neighbours.pair_distances(None, standin.atoms(spark, sf, index=index), BASIS)


# --- tables: registration, merging, filters ------------------------------------

_DATASETS_SQL = """
    WITH u AS (
        SELECT 0 AS load_order, * FROM orders WHERE o_orderstatus = 'F'
        UNION ALL SELECT 1, * FROM orders WHERE o_orderstatus = 'O'
        UNION ALL SELECT 2, * FROM orders WHERE o_orderpriority = '1-URGENT'
    ), k AS (
        SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY load_order, o_orderkey) AS f,
               row_number() OVER (PARTITION BY o_custkey ORDER BY load_order DESC, o_orderkey DESC) AS l,
               count(*) OVER (PARTITION BY o_custkey) AS n
        FROM u
    )
    SELECT o_custkey AS cust, o_orderkey AS config_id, load_order FROM k WHERE """


def _datasets(spark: SparkSession, sf: str) -> list[DataFrame]:
    o = standin.read(spark, sf, "orders")
    parts = (o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'"), o.where("o_orderpriority = '1-URGENT'"))
    return [p.select(F.col("o_custkey").alias("cust"), F.col("o_orderkey").alias("config_id")) for p in parts]


def _merged(spark: SparkSession, sf: str, keep: str | None) -> DataFrame:
    return tables.consolidate(_datasets(spark, sf), "cust", keep, "config_id").select("cust", "config_id", "load_order")


@query(_DATASETS_SQL + "f = 1")
def consolidate_first(spark, sf):
    return _merged(spark, sf, "first")


@query(_DATASETS_SQL + "l = 1")
def consolidate_last(spark, sf):
    return _merged(spark, sf, "last")


@query(_DATASETS_SQL + "n = 1")
def consolidate_unique(spark, sf):
    return _merged(spark, sf, None)


@query("""
    SELECT o_orderkey AS config_id, concat(o_orderstatus, '_', o_orderkey) AS row_key FROM orders
    WHERE o_orderstatus <> 'P' AND o_orderkey IN (SELECT l_orderkey FROM lineitem)
""")
def dataset_registration(spark, sf):
    c = tables.with_size(standin.configs(spark, sf), standin.atoms(spark, sf)).drop("prefix")
    pick = standin.configs(spark, sf).select("config_id", F.col("prefix").alias("status"))
    c = c.join(pick, "config_id")
    catalogue = c.limit(0).withColumn("prefix", F.lit(""))
    for p in ("F", "O", "F"):  # the second F is a name already taken: skipped
        catalogue = tables.register(catalogue, c.where(F.col("status") == p), p)
    return catalogue.select("config_id", tables.prefixed_key(F.col("prefix"), F.col("seq")).alias("row_key"))


@query(f"""
    WITH {ATOMS_SQL}, m AS (
        SELECT config_id, max(sqrt(fx * fx + fy * fy + fz * fz)) AS max_force FROM atoms GROUP BY config_id
    )
    SELECT o_orderkey AS config_id, round(max_force, 6) AS max_force FROM orders JOIN m ON config_id = o_orderkey
    WHERE max_force <= 7.0
""")
def max_force_filter(spark, sf):
    kept = tables.filter_max_forces(standin.configs(spark, sf), standin.atoms(spark, sf, forces=True), 7.0)
    return kept.select("config_id", _r6(F.col("max_force"), "max_force"))


@query(f"""
    WITH {ATOMS_SQL}, s AS (SELECT config_id, count(*) AS size FROM atoms GROUP BY config_id)
    SELECT config_id, size, round(o_totalprice / size, 6) AS energy_per_atom FROM orders JOIN s ON config_id = o_orderkey
""")
def energy_per_atom(spark, sf):
    sized = tables.with_size(standin.configs(spark, sf), standin.atoms(spark, sf))
    return tables.energy_per_atom(sized).select("config_id", "size", _r6(F.col("energy_per_atom"), "energy_per_atom"))


@query(f"""
    WITH {ATOMS_SQL}, v AS (SELECT config_id, sum(px) AS volume FROM atoms GROUP BY config_id),
    p AS (SELECT o_orderstatus AS prefix, CASE o_orderstatus WHEN 'F' THEN 0.5 WHEN 'O' THEN 0.0 END AS pressure FROM orders GROUP BY 1)
    SELECT o_orderkey AS config_id,
           round(CASE WHEN coalesce(pressure, 0) <> 0 THEN o_totalprice - pressure * volume ELSE o_totalprice END, 6) AS energy
    FROM orders JOIN v ON config_id = o_orderkey LEFT JOIN p ON o_orderstatus = prefix
""")
def pressure_correction(spark, sf):
    volumes = standin.atoms(spark, sf).groupBy("config_id").agg(F.sum("px").alias("volume"))
    c = standin.configs(spark, sf).join(volumes, "config_id")
    known = c.groupBy("prefix").agg(F.lit(1)).select(
        "prefix", F.when(F.col("prefix") == "F", 0.5).when(F.col("prefix") == "O", 0.0).alias("pressure")
    )
    return tables.pressure_corrected(c, known, "prefix").select("config_id", _r6(F.col("energy"), "energy"))


@query(f"""
    WITH {ATOMS_SQL}
    SELECT config_id, sum(CASE WHEN z = 1 THEN 1 ELSE 0 END)::BIGINT AS n_1, sum(CASE WHEN z = 2 THEN 1 ELSE 0 END)::BIGINT AS n_2,
           sum(CASE WHEN z = 3 THEN 1 ELSE 0 END)::BIGINT AS n_3
    FROM atoms GROUP BY config_id
""")
def composition_vector(spark, sf):
    return tables.composition(standin.atoms(spark, sf), standin.SPECIES)


@query(f"""
    WITH {ATOMS_SQL}
    SELECT config_id, count(*) AS size FROM atoms WHERE config_id NOT IN (SELECT config_id FROM atoms WHERE z = 3)
    GROUP BY config_id
""")
def unknown_species_anti(spark, sf):
    known = features.known_species(standin.atoms(spark, sf), dims.Basis((1, 2)))
    return known.groupBy("config_id").agg(F.count(F.lit(1)).alias("size"))


@query(f"""
    WITH {ATOMS_SQL}
    SELECT o_orderkey AS config_id FROM orders
    WHERE o_orderkey IN (SELECT config_id FROM atoms WHERE fy = 0 OR fy IS NULL)
""")
def invalid_force_guard(spark, sf):
    atoms = standin.atoms(spark, sf, forces=True).withColumn("fy", F.when(F.col("fy") == 0, F.lit(float("nan"))).otherwise(F.col("fy")))
    return tables.subset(standin.configs(spark, sf), tables.invalid_force_configs(atoms)).select("config_id")


@query("""
    SELECT o_orderkey AS config_id, o_totalprice AS energy FROM orders
    WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 5 = 0)
""")
def holdout_anti(spark, sf):
    train = standin.read(spark, sf, "customer").where("c_custkey % 5 = 0").select(F.col("c_custkey").alias("cust"))
    return tables.holdout(standin.configs(spark, sf), train, "cust").select("config_id", "energy")


@query("""
    SELECT o_orderkey AS config_id, o_totalprice AS energy FROM orders
    WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 5 = 0)
""")
def training_subset(spark, sf):
    train = standin.read(spark, sf, "customer").where("c_custkey % 5 = 0").select(F.col("c_custkey").alias("cust"))
    return tables.subset(standin.configs(spark, sf), train, "cust").select("config_id", "energy")


@query("SELECT o_orderkey AS config_id, o_totalprice AS energy FROM orders ORDER BY md5('7:' || o_orderkey)[:12], o_orderkey LIMIT 1000")
def random_sample(spark, sf):
    return tables.hash_sample(standin.configs(spark, sf), 1000, seed=7).select("config_id", "energy")


@query("""
    SELECT o_orderkey AS config_id, CAST(ntile(3) OVER (ORDER BY o_orderkey) - 1 AS INTEGER) AS fold FROM orders
""")
def kfold_assign(spark, sf):
    return tables.folds(standin.configs(spark, sf), 3, "seq").select("config_id", "fold")


@query("""
    SELECT chunk, count(*) AS n_rows FROM (
        SELECT CAST(floor((row_number() OVER (ORDER BY o_orderkey) - 1) / 500) AS INTEGER) AS chunk FROM orders
    ) GROUP BY chunk
""")
def chunk_catalogue(spark, sf):
    from latticework.sources.sinks import assign_chunks

    return tables.chunk_catalogue(assign_chunks(standin.configs(spark, sf), 500, "seq"))


@query("""
    WITH l AS (
        SELECT date_trunc('hour', ts) AS step, event_id, value,
               row_number() OVER (PARTITION BY date_trunc('hour', ts), user_id % 16 ORDER BY event_id) AS k, user_id % 16 AS run
        FROM events WHERE event_type = 'click'
    ), d AS (
        SELECT date_trunc('hour', ts) AS step, event_id,
               row_number() OVER (PARTITION BY date_trunc('hour', ts), user_id % 16 ORDER BY event_id) AS k, user_id % 16 AS run
        FROM events WHERE event_type <> 'click'
    )
    SELECT l.run, l.k AS occurrence, l.event_id AS log_id, d.event_id AS dump_id
    FROM l JOIN d ON l.step = d.step AND l.run = d.run AND l.k = d.k
""")
def duplicate_aware_step_join(spark, sf):
    e = standin.read(spark, sf, "events").select(
        F.date_trunc("hour", "ts").alias("step"), (F.col("user_id") % 16).alias("run"), "event_id", "event_type"
    )
    log = e.where("event_type = 'click'").select("step", "run", F.col("event_id").alias("log_id"), F.col("event_id").alias("pos"))
    dump = e.where("event_type <> 'click'").select("step", "run", F.col("event_id").alias("dump_id"), F.col("event_id").alias("pos"))
    joined = tables.occurrence_join(log, dump, run=("run",))
    return joined.select("run", F.col("occurrence").cast("long").alias("occurrence"), "log_id", "dump_id")


@query("""
    SELECT CASE l_returnflag WHEN 'A' THEN 'Ar' WHEN 'N' THEN 'Ne' ELSE l_returnflag END AS symbol, count(*) AS n
    FROM lineitem GROUP BY 1
""")
def alias_join(spark, sf):
    lines = standin.read(spark, sf, "lineitem").select(F.col("l_returnflag").alias("symbol"))
    return tables.alias_species(lines, {"A": "Ar", "N": "Ne"}, "symbol").groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


# --- hashes and dimensions --------------------------------------------------------

@query(f"""
    WITH {PAIRS_SQL}
    SELECT CASE WHEN zi > zj THEN zi * zi + zj ELSE zj * zj + zi + zj END::BIGINT AS pair_hash, zi, zj, count(*) AS n
    FROM pairs WHERE r <= 12 GROUP BY zi, zj
""")
def pair_hash_counts(spark, sf):
    a = standin.atoms(spark, sf)
    near = neighbours.near_pairs(a.select("config_id", "z", "px", "py", "pz"), a.select("config_id", "z", "px", "py", "pz"), R_CUT)
    h = near.groupBy(pair_hash(F.col("l_z"), F.col("r_z")).alias("pair_hash")).agg(F.count(F.lit(1)).alias("n"))
    zi, zj = unszudzik(F.col("pair_hash"))
    return h.select("pair_hash", zi.cast("int").alias("zi"), zj.cast("int").alias("zj"), "n")


@query("""
    WITH s AS (SELECT o_orderkey, o_custkey % 100 AS a, o_orderkey % 50 AS b, o_orderkey % 7 AS c FROM orders),
    p AS (SELECT *, CASE WHEN a > b THEN a * a + b ELSE b * b + a + b END AS ab FROM s)
    SELECT o_orderkey AS config_id, CASE WHEN ab > c THEN ab * ab + c ELSE c * c + ab + c END AS hash FROM p
""")
def column_hash(spark, sf):
    o = standin.configs(spark, sf)
    parts = F.array((F.col("cust") % 100).cast("long"), (F.col("config_id") % 50).cast("long"), (F.col("config_id") % 7).cast("long"))
    return o.select("config_id", szudzik_array(parts).alias("hash"))


@query(f"""
    WITH {ATOMS_SQL}, e AS (SELECT DISTINCT z FROM atoms),
    p AS (SELECT 2 AS degree, a.z AS zi, b.z AS zj, 0 AS zk FROM e a JOIN e b ON a.z <= b.z),
    t AS (SELECT 3, c.z, a.z, b.z FROM e c, e a JOIN e b ON a.z <= b.z)
    SELECT CAST(row_number() OVER (ORDER BY degree, zi, zj, zk) - 1 AS INTEGER) AS interaction_id, degree, zi, zj, zk
    FROM (SELECT 1 AS degree, z AS zi, 0 AS zj, 0 AS zk FROM e UNION ALL SELECT * FROM p UNION ALL SELECT * FROM t)
""")
def interaction_enumeration(spark, sf):
    e = standin.atoms(spark, sf).select("z").distinct()
    a, b, c = (e.withColumnRenamed("z", n) for n in ("zi", "zj", "zk"))
    one = a.select(F.lit(1).alias("degree"), "zi", F.lit(0).alias("zj"), F.lit(0).alias("zk"))
    two = a.join(b, F.col("zi") <= F.col("zj")).select(F.lit(2).alias("degree"), "zi", "zj", F.lit(0).alias("zk"))
    three = a.crossJoin(b.join(c, F.col("zj") <= F.col("zk"))).select(F.lit(3).alias("degree"), "zi", "zj", "zk")
    every = one.unionByName(two).unionByName(three)
    return every.select(
        (F.row_number().over(Window.orderBy("degree", "zi", "zj", "zk")) - 1).alias("interaction_id"), "degree", "zi", "zj", "zk"
    )


@query(f"""
    WITH {PAIRS_SQL}, b AS (SELECT zi, zj, min(r) AS lo, max(r) AS hi FROM pairs WHERE r <= 12 GROUP BY zi, zj),
    k AS (SELECT zi, zj, lo, hi, unnest(range(11)) AS k FROM b)
    SELECT zi, zj, CAST(k AS INTEGER) AS k, round(lo + k * (hi - lo) / 10, 6) AS linear,
           round(sqrt(lo * lo + k * (hi * hi - lo * lo) / 10), 6) AS lammps,
           round(1 / (1 / lo + k * (1 / hi - 1 / lo) / 10), 6) AS inverse,
           round(lo * pow(hi / lo, k / 10.0), 6) AS geometric
    FROM k
""")
def knot_strategies(spark, sf):
    a = standin.atoms(spark, sf).select("config_id", "z", "px", "py", "pz")
    near = neighbours.near_pairs(a, a, R_CUT).groupBy(F.least("l_z", "r_z").alias("zi"), F.greatest("l_z", "r_z").alias("zj"))
    bounds = near.agg(F.min("r").alias("lo"), F.max("r").alias("hi")).collect()  # a row per pair of species
    names = ("linear", "lammps", "inverse", "geometric")
    rows = []
    for b in bounds:
        knots = [dims.knot_points(n, b["lo"], b["hi"], 10).tolist() for n in names]
        rows += [(b["zi"], b["zj"], k, *at) for k, at in enumerate(zip(*knots, strict=True))]
    table = spark.createDataFrame(rows, "zi int, zj int, k int, " + ", ".join(f"{n} double" for n in names))
    return table.select("zi", "zj", "k", *[_r6(F.col(n), n) for n in names])


# --- pairs, histograms, analysis ----------------------------------------------------

@query(f"""
    WITH {pairs_with_ids_sql(BASIS)}
    SELECT config_id, interaction_id, count(*) AS n_pairs, round(sum(r), 6) AS sum_r, round(min(r), 6) AS min_r
    FROM near GROUP BY config_id, interaction_id
""")
def pair_distances(spark, sf):
    return _pairs(spark, sf).groupBy("config_id", "interaction_id").agg(
        F.count(F.lit(1)).alias("n_pairs"), _r6(F.sum("r"), "sum_r"), _r6(F.min("r"), "min_r")
    )


@query(f"""
    WITH {pairs_with_ids_sql(BASIS)}
    SELECT config_id, interaction_id, count(*) AS n_pairs FROM near GROUP BY config_id, interaction_id
""")
def pair_distances_by_cells(spark, sf):
    """The same join on a grid of cells, as for configurations of very many atoms."""
    found = neighbours.pair_distances(None, standin.atoms(spark, sf), BASIS, cells=True)
    return found.groupBy("config_id", "interaction_id").agg(F.count(F.lit(1)).alias("n_pairs"))


_HISTOGRAM_SQL = f"""
    {pairs_with_ids_sql(BASIS)}, histogram AS (
        SELECT interaction_id, CAST(least(floor(r / {WIDTH}), 11) AS INTEGER) AS bin, count(*) AS n
        FROM near GROUP BY 1, 2
    )"""


def _histogram(spark: SparkSession, sf: str) -> DataFrame:
    return analysis.pair_histogram(_pairs(spark, sf), R_CUT, WIDTH)


@query(f"WITH {_HISTOGRAM_SQL} SELECT interaction_id, bin, n FROM histogram")
def pair_histogram(spark, sf):
    return _histogram(spark, sf)


_TOTALS_SQL = "totals AS (SELECT (SELECT count(*) FROM atoms) AS n_atoms, (SELECT sum(o_totalprice) FROM orders) AS volume)"


@query(f"""
    WITH {_HISTOGRAM_SQL}, {_TOTALS_SQL}
    SELECT interaction_id, bin,
           round(n / (n_atoms / volume * n_atoms * (4 * pi() / 3) * ((bin + 1.0) * (bin + 1.0) * (bin + 1.0) - bin * 1.0 * bin * bin)
                 * sum(n) OVER (PARTITION BY interaction_id) / sum(n) OVER ()), 6) AS g
    FROM histogram, totals
""")
def pair_rdf(spark, sf):
    n = standin.atoms(spark, sf).agg(F.count(F.lit(1)).alias("n_atoms"))
    volume = standin.configs(spark, sf).agg(F.sum("energy").alias("volume"))
    g = analysis.rdf(_histogram(spark, sf), n.crossJoin(volume), WIDTH)
    return g.select("interaction_id", "bin", _r6(F.col("g"), "g"))


@query(f"WITH {_HISTOGRAM_SQL} SELECT interaction_id, min(bin) * {WIDTH}::DOUBLE AS lower_bound FROM histogram GROUP BY 1")
def pair_lower_bound(spark, sf):
    return analysis.lower_bounds(_histogram(spark, sf), WIDTH)


_W7 = analysis.savgol_weights(7, 3).tolist()
_SMOOTH_SQL = f"""
    {_HISTOGRAM_SQL}, {values_sql("w", "row, k, weight", [(r, k, float(x)) for r, row in enumerate(_W7) for k, x in enumerate(row)])},
    every AS (
        SELECT interaction_id, CAST(b AS INTEGER) AS bin, coalesce(n, 0) AS n
        FROM (SELECT DISTINCT interaction_id FROM histogram) i CROSS JOIN range(12) t(b)
        LEFT JOIN histogram USING (interaction_id) WHERE false
        UNION ALL
        SELECT i.interaction_id, CAST(b AS INTEGER), coalesce(h.n, 0)
        FROM (SELECT DISTINCT interaction_id FROM histogram) i CROSS JOIN range(12) t(b)
        LEFT JOIN histogram h ON h.interaction_id = i.interaction_id AND h.bin = b
    ), smoothed AS (
        SELECT e.interaction_id, e.bin, sum(w.weight * v.n) AS smooth
        FROM every e JOIN w ON w.row = e.bin - greatest(0, least(e.bin - 3, 5))
        JOIN every v ON v.interaction_id = e.interaction_id AND v.bin = greatest(0, least(e.bin - 3, 5)) + w.k
        GROUP BY e.interaction_id, e.bin
    )"""


def _smoothed(spark: SparkSession, sf: str) -> DataFrame:
    return analysis.savgol(analysis.filled(_histogram(spark, sf), 12), 7, 3)


@query(f"WITH {_SMOOTH_SQL} SELECT interaction_id, bin, round(smooth, 6) AS smooth FROM smoothed")
def savgol_smooth(spark, sf):
    return _smoothed(spark, sf).select("interaction_id", "bin", _r6(F.col("smooth"), "smooth"))


_PEAKS_SQL = f"""
    WITH {_HISTOGRAM_SQL}, every AS (
        SELECT i.interaction_id, CAST(b AS INTEGER) AS bin, coalesce(h.n, 0) AS n
        FROM (SELECT DISTINCT interaction_id FROM histogram) i CROSS JOIN range(12) t(b)
        LEFT JOIN histogram h ON h.interaction_id = i.interaction_id AND h.bin = b
    ), steps AS (
        SELECT *, CASE WHEN n <> lag(n) OVER (PARTITION BY interaction_id ORDER BY bin) THEN 1 ELSE 0 END AS s FROM every
    ), runs AS (
        SELECT interaction_id, n, min(bin) AS lo, max(bin) AS hi FROM (
            SELECT *, sum(s) OVER (PARTITION BY interaction_id ORDER BY bin) AS run FROM steps
        ) GROUP BY interaction_id, run, n
    ), tops AS (
        SELECT interaction_id, CAST(floor((lo + hi) / 2.0) AS INTEGER) AS peak FROM (
            SELECT *, lag(n) OVER w AS a, lead(n) OVER w AS b FROM runs WINDOW w AS (PARTITION BY interaction_id ORDER BY lo)
        ) WHERE n > a AND n > b
    )"""


@query(_PEAKS_SQL + " SELECT interaction_id, peak FROM tops")
def local_peaks(spark, sf):
    return analysis.peaks(analysis.filled(_histogram(spark, sf), 12), "n")


@query(_PEAKS_SQL + """
    SELECT interaction_id, valley FROM (
        SELECT interaction_id, (lag(peak) OVER (PARTITION BY interaction_id ORDER BY peak) + peak) / 2.0 AS valley FROM tops
    ) WHERE valley IS NOT NULL
""")
def local_valleys(spark, sf):
    return analysis.valleys(analysis.peaks(analysis.filled(_histogram(spark, sf), 12), "n"))


@query(_PEAKS_SQL + """, tall AS (
        SELECT t.interaction_id, peak, e.n AS y FROM tops t JOIN every e ON e.interaction_id = t.interaction_id AND e.bin = t.peak
    ), reach AS (
        SELECT t.interaction_id, peak, y, coalesce(max(CASE WHEN e.bin < peak AND e.n > y THEN e.bin END) + 1, min(e.bin)) AS l,
               coalesce(min(CASE WHEN e.bin > peak AND e.n > y THEN e.bin END) - 1, max(e.bin)) AS r
        FROM tall t JOIN every e USING (interaction_id) GROUP BY 1, 2, 3
    ), height AS (
        SELECT r.interaction_id, peak, y, l, r.r, (y + greatest(min(CASE WHEN e.bin <= peak THEN e.n END), min(CASE WHEN e.bin >= peak THEN e.n END))) / 2.0e0 AS h
        FROM reach r JOIN every e ON e.interaction_id = r.interaction_id AND e.bin BETWEEN r.l AND r.r GROUP BY 1, 2, 3, 4, 5
    ), ends AS (
        SELECT h.interaction_id, peak, y, l, r, h, coalesce(max(CASE WHEN e.bin < peak AND e.n <= h THEN e.bin END), l) AS a,
               coalesce(min(CASE WHEN e.bin > peak AND e.n <= h THEN e.bin END), r) AS b
        FROM height h JOIN every e ON e.interaction_id = h.interaction_id AND e.bin BETWEEN h.l AND h.r GROUP BY 1, 2, 3, 4, 5, 6
    ), widths AS (
        SELECT x.interaction_id, x.peak,
               x.b - CASE WHEN yb.n < h THEN (h - yb.n) / (yb1.n - yb.n) ELSE 0 END
             - (x.a + CASE WHEN ya.n < h THEN (h - ya.n) / (ya1.n - ya.n) ELSE 0 END) AS width
        FROM ends x JOIN every ya ON ya.interaction_id = x.interaction_id AND ya.bin = a JOIN every yb ON yb.interaction_id = x.interaction_id AND yb.bin = b
        LEFT JOIN every ya1 ON ya1.interaction_id = x.interaction_id AND ya1.bin = a + 1
        LEFT JOIN every yb1 ON yb1.interaction_id = x.interaction_id AND yb1.bin = b - 1
    ) SELECT interaction_id, peak, round(width, 6) AS width FROM widths WHERE width >= 0.5""")
def wide_peaks(spark, sf):
    found = analysis.peaks_by_width(analysis.filled(_histogram(spark, sf), 12), 0.5, value="n")
    return found.select("interaction_id", "peak", _r6(F.col("width"), "width"))


@query(f"""
    WITH {_HISTOGRAM_SQL}, h AS (SELECT *, (bin + 0.5e0) * (bin + 0.5e0) AS ref, n / ((bin + 0.5e0) * (bin + 0.5e0)) AS x FROM histogram),
    tried AS (
        SELECT a.interaction_id, a.x, sum(CASE WHEN b.x >= a.x THEN a.x * b.ref ELSE 10 * (b.n - a.x * b.ref) END) AS score,
               sum(least(b.n, a.x * b.ref)) AS covered
        FROM (SELECT DISTINCT interaction_id, x FROM h) a JOIN h b USING (interaction_id) GROUP BY 1, 2
    )
    SELECT interaction_id, round(x, 6) AS scale, round(score, 4) AS score, round(covered, 4) AS covered FROM tried
    QUALIFY row_number() OVER (PARTITION BY interaction_id ORDER BY score DESC, x) = 1
""")
def coverage_score(spark, sf):
    h = _histogram(spark, sf).withColumn("ref", (F.col("bin") + 0.5) * (F.col("bin") + 0.5))
    return analysis.coverage(h).select("interaction_id", _r6(F.col("scale"), "scale"), F.round("score", 4).alias("score"), F.round("covered", 4).alias("covered"))


@query(f"""
    WITH {pairs_with_ids_sql(BASIS)}, c AS (
        SELECT config_id, o_totalprice / count(*) AS w FROM atoms JOIN orders ON config_id = o_orderkey GROUP BY config_id, o_totalprice
    ), s AS (
        SELECT interaction_id, CAST(floor(r / {WIDTH}) AS INTEGER) AS bin, zi = zj AS alike, sum(w) AS s
        FROM near JOIN c USING (config_id) GROUP BY 1, 2, 3
    )
    SELECT interaction_id, bin,
           round(s / (SELECT count(*) FROM orders WHERE o_orderkey IN (SELECT config_id FROM atoms)) / CASE WHEN alike THEN 2 ELSE 4 END
                 / (4 * pi() * (bin + 0.5) * (bin + 0.5)), 6) AS density
    FROM s
""")
def distance_summary(spark, sf):
    sized = tables.with_size(standin.configs(spark, sf), standin.atoms(spark, sf)).withColumn("volume", F.col("energy"))
    like = {x.number: x.species[0] == x.species[1] for x in BASIS.of_degree(2)}
    flag = F.element_at(F.create_map(*[F.lit(v) for kv in like.items() for v in kv]), F.col("interaction_id"))
    d = analysis.density_histogram(_pairs(spark, sf).withColumn("like", flag), sized, R_CUT, 12)
    return d.select("interaction_id", "bin", _r6(F.col("density"), "density"))


@query(f"""
    WITH {_PEAKS_SQL.strip().removeprefix("WITH")}, t AS (
        SELECT interaction_id, avg(bin) AS target FROM histogram GROUP BY 1
    )
    SELECT interaction_id, round(target, 6) AS target, min_by(peak, struct_pack(a := abs(peak - target), b := peak)) AS closest
    FROM tops JOIN t USING (interaction_id) GROUP BY interaction_id, target
""")
def closest_peak(spark, sf):
    h = _histogram(spark, sf)
    targets = h.groupBy("interaction_id").agg(F.avg("bin").alias("target"))
    found = analysis.closest(analysis.peaks(analysis.filled(h, 12), "n"), targets, "interaction_id", "peak", "target")
    return found.select("interaction_id", _r6(F.col("target"), "target"), "closest")


@query()
def element_volumes(spark, sf):
    counts = tables.composition(standin.atoms(spark, sf), standin.SPECIES)
    volumes = standin.configs(spark, sf).select("config_id", F.col("energy").alias("volume"))
    return analysis.element_volumes(counts.join(volumes, "config_id"), list(standin.SPECIES))


def _cramer_sql(k: int) -> str:
    """The k-th unknown of the symmetric 3 x 3 system a, b by determinants."""
    a = [[f"a{min(i, j)}{max(i, j)}" for j in range(3)] for i in range(3)]

    def det(m: list[list[str]]) -> str:
        return " + ".join(
            f"{m[0][i]} * ({m[1][(i + 1) % 3]} * {m[2][(i + 2) % 3]} - {m[1][(i + 2) % 3]} * {m[2][(i + 1) % 3]})" for i in range(3)
        )

    top = [[f"b{i}" if j == k else a[i][j] for j in range(3)] for i in range(3)]
    return f"(({det(top)}) / ({det(a)}))"


@query(f"""
    WITH RECURSIVE {ATOMS_SQL}, rows AS (
        SELECT o_orderstatus AS g, n0, n1, n2, o_totalprice / 1000 AS y FROM orders JOIN (
            SELECT config_id, count_if(z = 1)::DOUBLE AS n0, count_if(z = 2)::DOUBLE AS n1, count_if(z = 3)::DOUBLE AS n2 FROM atoms GROUP BY 1
        ) ON config_id = o_orderkey
    ), steps AS (
        SELECT g, 0 AS t, 0e0 AS c0, 0e0 AS c1, 0e0 AS c2, sqrt(avg(y * y)) AS s FROM rows GROUP BY 1
        UNION ALL
        SELECT g, t + 1, {_cramer_sql(0)}, {_cramer_sql(1)}, {_cramer_sql(2)}, sqrt(squares / (n - far * 1.35e0 * 1.35e0)) FROM (
            SELECT g, t, count(*) AS n, sum(CASE WHEN e <= 1.35e0 * s THEN e * e ELSE 0 END) AS squares, sum(CASE WHEN e > 1.35e0 * s THEN 1e0 ELSE 0e0 END) AS far,
                   {", ".join(f"sum(w * n{i} * n{j}){' + 1e-4 * s' if i == j else ''} AS a{i}{j}" for i in range(3) for j in range(i, 3))},
                   {", ".join(f"sum(w * n{i} * y) AS b{i}" for i in range(3))}
            FROM (SELECT *, CASE WHEN e <= 1.35e0 * s THEN 1e0 ELSE 1.35e0 * s / e END AS w FROM (
                SELECT *, abs(y - c0 * n0 - c1 * n1 - c2 * n2) AS e FROM rows JOIN steps USING (g) WHERE t < 15
            )) GROUP BY g, t, s
        )
    )
    SELECT g AS prefix, CAST(unnest([1, 2, 3]) AS INTEGER) AS z, round(unnest([c0, c1, c2]), 5) AS volume, round(s, 5) AS scale FROM steps WHERE t = 15
""")
def robust_volumes(spark, sf):
    """Volumes per atom of each kind of order, by Huber regression with its scale, fifteen rounds."""
    counts = tables.composition(standin.atoms(spark, sf), standin.SPECIES)
    volumes = standin.configs(spark, sf).select("config_id", "prefix", (F.col("energy") / 1000).alias("volume"))
    told = analysis.robust_volumes(counts.join(volumes, "config_id"), list(standin.SPECIES), by=("prefix",), rounds=15)
    return told.select("prefix", "z", F.round("volume", 5).alias("volume"), F.round("scale", 5).alias("scale"))


@query("""
    SELECT CAST(floor(l_quantity / 5) AS BIGINT) AS bx, CAST(floor(l_extendedprice / 5000) AS BIGINT) AS by_, count(*) AS n
    FROM lineitem GROUP BY 1, 2
""")
def density_2d(spark, sf):
    rows = standin.read(spark, sf, "lineitem").select((F.col("l_quantity") * 1000).alias("x"), F.col("l_extendedprice").alias("y"))
    return analysis.density_2d(rows, "x", "y", 5000.0).select("bx", F.col("by").alias("by_"), "n")


@query("""
    SELECT p_brand, p_size, count(*) AS n FROM part a JOIN (SELECT DISTINCT p_size AS s FROM part) b ON a.p_size >= 2 * b.s
    GROUP BY 1, 2
""")
def cutoff_pairs(spark, sf):
    part = standin.read(spark, sf, "part").select("p_brand", F.col("p_size").alias("rmax_2b"))
    trio = part.select(F.col("rmax_2b").alias("rmax_3b")).distinct()
    return tables.cutoff_grid(part, trio).groupBy("p_brand", F.col("rmax_2b").alias("p_size")).agg(F.count(F.lit(1)).alias("n"))


# --- images -----------------------------------------------------------------------

def _periodic(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Orders in skewed cells: one edge from the key, periodic along the first two axes."""
    edge = (F.col("config_id") % 5 + 4).cast("double")
    z = F.lit(0.0)
    cell = F.array(F.array(edge, z, z), F.array(F.lit(1.0), F.lit(6.0), z), F.array(z, z, F.lit(20.0)))
    c = standin.configs(spark, sf).select("config_id", cell.alias("cell"), F.array(F.lit(True), F.lit(True), F.lit(False)).alias("pbc"))
    return c, standin.atoms(spark, sf, index=True)


# Height over a face is the volume over the face's area; the second axis leans by one.
@query(f"""
    WITH {ATOMS_SQL}, c AS (
        SELECT o_orderkey AS config_id, CAST(o_orderkey % 5 + 4 AS DOUBLE) AS e FROM orders
    ), f AS (
        SELECT config_id, e, CAST(ceil(7.0 / (e * 6 * 20 / sqrt(120.0 * 120 + 20 * 20))) AS INTEGER) AS na,
               CAST(ceil(7.0 / 6) AS INTEGER) AS nb
        FROM c
    )
    SELECT config_id, CAST((2 * na + 1) * (2 * nb + 1) * count(*) AS BIGINT) AS images, na, nb,
           round(sum(px) * (2 * na + 1) * (2 * nb + 1), 6) AS sum_px
    FROM f JOIN atoms USING (config_id) GROUP BY config_id, na, nb
""")
def image_expansion(spark, sf):
    c, a = _periodic(spark, sf)
    made = neighbours.periodic_images(c, a, 7.0)
    return made.groupBy("config_id").agg(
        F.count(F.lit(1)).alias("images"), F.max("ia").alias("na"), F.max("ib").alias("nb"), _r6(F.sum("px"), "sum_px")
    )


@query(f"""
    WITH {ATOMS_SQL}, c AS (SELECT o_orderkey AS config_id, CAST(o_orderkey % 5 + 4 AS DOUBLE) AS e FROM orders),
    i AS (
        SELECT a.config_id, a.z, a.px + ia * e + ib AS px, a.py + ib * 6.0 AS py, a.pz
        FROM atoms a JOIN c USING (config_id), range(-2, 3) s(ia), range(-1, 2) t(ib)
        WHERE abs(ia) <= ceil(4.0 / (e * 120 / sqrt(14800.0)))
    ), d AS (
        SELECT a.config_id, least(a.z, i.z) AS zi, greatest(a.z, i.z) AS zj,
               sqrt((a.px - i.px) * (a.px - i.px) + (a.py - i.py) * (a.py - i.py) + (a.pz - i.pz) * (a.pz - i.pz)) AS r
        FROM atoms a JOIN i USING (config_id)
    )
    SELECT zi, zj, count(*) AS n, round(sum(r), 4) AS sum_r FROM d WHERE r > 0 AND r < 4 GROUP BY zi, zj
""")
def periodic_pairs(spark, sf):
    c, a = _periodic(spark, sf)
    small = dims.Basis(standin.SPECIES, {p: (0.0, 4.0, 4) for p in [(1, 1), (1, 2), (1, 3), (2, 2), (2, 3), (3, 3)]})
    ids = F.create_map(*[x for i in small.of_degree(2) for x in (F.lit(i.number), F.array(*map(F.lit, i.species)))])
    found = neighbours.pair_distances(c, a, small).withColumn("s", F.element_at(ids, F.col("interaction_id")))
    return found.groupBy(F.get("s", F.lit(0)).alias("zi"), F.get("s", F.lit(1)).alias("zj")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("r"), 4).alias("sum_r")
    )


_IMAGES_SQL = f"""
    {ATOMS_SQL}, c AS (SELECT o_orderkey AS config_id, CAST(o_orderkey % 5 + 4 AS DOUBLE) AS e FROM orders),
    i AS (
        SELECT a.config_id, a.z, a.atom_idx, ia, ib, a.px + ia * e + ib AS px, a.py + ib * 6.0 AS py, a.pz
        FROM atoms a JOIN c USING (config_id), range(-2, 3) s(ia), range(-1, 2) t(ib)
        WHERE abs(ia) <= ceil(4.0 / (e * 120 / sqrt(14800.0)))
    ), near AS (
        SELECT a.config_id, a.atom_idx, a.z, i.z AS zj, i.atom_idx AS j, ia, ib, i.px, i.py, i.pz, i.px - a.px AS dx, i.py - a.py AS dy, i.pz - a.pz AS dz,
               sqrt((a.px - i.px) * (a.px - i.px) + (a.py - i.py) * (a.py - i.py) + (a.pz - i.pz) * (a.pz - i.pz)) AS r
        FROM atoms a JOIN i USING (config_id)
    )"""
_REACH = 4.0
_CLOSE_PAIRS = {(a, b): (0.0, _REACH, 4) for a in standin.SPECIES for b in standin.SPECIES if a <= b}
_CLOSE = dims.Basis(standin.SPECIES, _CLOSE_PAIRS)
_CLOSE_TRIOS = dims.Basis(
    standin.SPECIES, _CLOSE_PAIRS,
    {(a, b, c): ((0.0, 0.0, 0.0), (_REACH, _REACH, 6.0), (4, 4, 6)) for a in standin.SPECIES for b in standin.SPECIES for c in standin.SPECIES if b <= c},
    degree=3,
)


@query(f"""
    WITH {_IMAGES_SQL}
    SELECT config_id, 2 * count(*) AS n, round(2 * sum(abs(dx) / r), 5) AS x, round(2 * sum(abs(dy) / r), 5) AS y, round(2 * sum(abs(dz) / r), 5) AS z
    FROM near WHERE r > 0 AND r < {_REACH} GROUP BY 1
""")
def periodic_derivatives(spark, sf):
    """Unit vectors at the real ends of pairs in periodic cells: each pair of a real atom and an image in both directions."""
    c, a = _periodic(spark, sf)
    made = neighbours.pair_derivatives(c, a, _CLOSE)
    totals = [F.round(F.sum(F.abs(u)), 5).alias(n) for u, n in (("ux", "x"), ("uy", "y"), ("uz", "z"))]
    return made.groupBy("config_id").agg(F.count(F.lit(1)).alias("n"), *totals)


@query(f"""
    WITH {_IMAGES_SQL}, shell AS (SELECT * FROM near WHERE r > 0 AND r <= {_REACH}), t AS (
        SELECT a.config_id, a.z, a.zj, b.zj AS zk, a.r AS r_l, b.r AS r_m,
               sqrt((a.px - b.px) * (a.px - b.px) + (a.py - b.py) * (a.py - b.py) + (a.pz - b.pz) * (a.pz - b.pz)) AS r_n
        FROM shell a JOIN shell b ON a.config_id = b.config_id AND a.atom_idx = b.atom_idx
             AND (a.zj < b.zj OR a.zj = b.zj AND (a.j < b.j OR a.j = b.j AND (a.ia < b.ia OR a.ia = b.ia AND a.ib < b.ib)))
    )
    SELECT z, zj, zk, count(*) AS n, round(sum(r_l + r_m), 3) AS legs, round(sum(r_n), 3) AS far FROM t WHERE r_n <= 6 GROUP BY 1, 2, 3
""")
def periodic_triplets(spark, sf):
    c, a = _periodic(spark, sf)
    ids = F.create_map(*[x for i in _CLOSE_TRIOS.of_degree(3) for x in (F.lit(i.number), F.array(*map(F.lit, i.species)))])
    found = neighbours.triplets(c, a, _CLOSE_TRIOS, r_cut=_REACH).withColumn("s", F.element_at(ids, F.col("interaction_id")))
    species = [F.get("s", F.lit(k)).cast("int").alias(n) for k, n in enumerate(("z", "zj", "zk"))]
    return found.groupBy(*species).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("r_l") + F.col("r_m")), 3).alias("legs"), F.round(F.sum("r_n"), 3).alias("far")
    )


# --- features -----------------------------------------------------------------------

@query(f"""
    WITH {pairs_with_ids_sql(BASIS)}, {pieces_sql(BASIS, 2)}
    SELECT interaction_id, basis_idx, count(*) AS n FROM near JOIN pieces USING (interaction_id)
    WHERE r > t_lo AND r <= t_hi GROUP BY 1, 2
""")
def segment_join(spark, sf):
    met = features.segment_join(_pairs(spark, sf), BASIS.segments_table(spark, 2))
    return met.groupBy("interaction_id", "basis_idx").agg(F.count(F.lit(1)).alias("n"))


_FEATURES_2B_SQL = f"""
    {pairs_with_ids_sql(BASIS)}, {splines_sql("spl", 12, "SELECT r FROM near")}, features AS (
        SELECT config_id, CAST(feat_offset + basis_idx AS INTEGER) AS feature_idx, sum(b) AS value
        FROM near JOIN spl USING (r) WHERE basis_idx < 12 GROUP BY 1, 2
        UNION ALL SELECT config_id, z - 1, count(*) FROM atoms GROUP BY 1, 2
    )"""


def _energy_features(spark: SparkSession, sf: str) -> DataFrame:
    atoms = standin.atoms(spark, sf)
    pairs = neighbours.pair_distances(None, atoms, BASIS)
    return features.energy_features_1b(atoms, BASIS).unionByName(features.energy_features_2b(pairs, BASIS))


@query(f"WITH {_FEATURES_2B_SQL} SELECT config_id, feature_idx, round(value, 6) AS value FROM features")
def energy_features_2b(spark, sf):
    return _energy_features(spark, sf).select("config_id", F.col("feature_idx").cast("int").alias("feature_idx"), _r6(F.col("value"), "value"))


@query(f"""
    WITH {_FEATURES_2B_SQL} SELECT config_id, feature_idx, round(value, 6) AS value FROM features WHERE feature_idx >= {len(standin.SPECIES)}
""")
def bspline_expand(spark, sf):
    """Pair features in SQL: the Arrow table function over the different distances, joined to the pairs."""
    knots = {tuple(map(float, x.knots[0])) for x in BASIS.of_degree(2)}
    register_bspline_expand(spark, min(knots))  # the pairs of this basis share their knots
    assert len(knots) == 1
    offsets = spark.createDataFrame([(x.number, x.offset) for x in BASIS.of_degree(2)], "interaction_id int, feat_offset int")
    return spark.sql(
        """
        WITH b AS (SELECT * FROM bspline_expand_table(TABLE(SELECT DISTINCT r FROM {pairs})))
        SELECT config_id, feat_offset + basis_idx AS feature_idx, round(sum(value), 6) AS value
        FROM {pairs} JOIN b USING (r) JOIN {offsets} USING (interaction_id) WHERE basis_idx < 12 GROUP BY 1, 2
        """,
        pairs=_pairs(spark, sf).select("config_id", F.col("interaction_id").cast("int").alias("interaction_id"), "r"), offsets=offsets,
    )


_FORCES_2B_SQL = f"""
    {pairs_with_ids_sql(BASIS)}, {splines_sql("spl", 12, "SELECT r FROM near")}, slopes AS (
        SELECT config_id, i, j, CAST(feat_offset + basis_idx AS INTEGER) AS feature_idx, -slope AS s, ux, uy, uz
        FROM near JOIN spl USING (r) WHERE basis_idx < 12
    ), ends AS (
        SELECT config_id, j AS atom_idx, feature_idx, s * ux AS fx, s * uy AS fy, s * uz AS fz FROM slopes
        UNION ALL SELECT config_id, i, feature_idx, -s * ux, -s * uy, -s * uz FROM slopes
    )"""


def _force_features(spark: SparkSession, sf: str) -> DataFrame:
    atoms = standin.atoms(spark, sf, index=True)
    return features.force_features_2b(neighbours.pair_derivatives(None, atoms, BASIS), BASIS)


@query(f"""
    WITH {_FORCES_2B_SQL}
    SELECT config_id, feature_idx, count(*) AS n, round(sum(a), 5) AS total FROM (
        SELECT config_id, atom_idx, feature_idx, abs(sum(fx)) + abs(sum(fy)) + abs(sum(fz)) AS a
        FROM ends GROUP BY 1, 2, 3
    ) GROUP BY 1, 2
""")
def force_features_2b(spark, sf):
    rows = _force_features(spark, sf).groupBy("config_id", "atom_idx", "feature_idx").agg(F.sum(F.abs("value")).alias("a"))
    return rows.groupBy("config_id", F.col("feature_idx").cast("int").alias("feature_idx")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("a"), 5).alias("total")
    )


_TRIOS = [(*x.species, x.number) for x in DEEP.of_degree(3)]
_TRIPLETS_SQL = f"""
    {ATOMS_SQL}, {values_sql("trio_ids", "z, zj, zk, interaction_id", _TRIOS)},
    shell AS (
        SELECT a.config_id, a.atom_idx AS i, a.z, b.atom_idx AS j, b.z AS zj, b.px, b.py, b.pz,
               sqrt((a.px - b.px) * (a.px - b.px) + (a.py - b.py) * (a.py - b.py) + (a.pz - b.pz) * (a.pz - b.pz)) AS r
        FROM atoms a JOIN atoms b USING (config_id)
    ), trios AS (
        SELECT a.config_id, a.i, interaction_id, a.r AS r_l, b.r AS r_m,
               sqrt((a.px - b.px) * (a.px - b.px) + (a.py - b.py) * (a.py - b.py) + (a.pz - b.pz) * (a.pz - b.pz)) AS r_n
        FROM shell a JOIN shell b ON a.config_id = b.config_id AND a.i = b.i
             AND (a.zj < b.zj OR a.zj = b.zj AND CAST(a.j AS VARCHAR) || ':0:0:0' < CAST(b.j AS VARCHAR) || ':0:0:0')
        JOIN trio_ids t ON t.z = a.z AND t.zj = a.zj AND t.zk = b.zj
        WHERE a.r > 0 AND a.r <= 6 AND b.r > 0 AND b.r <= 6
    ), near AS (SELECT * FROM trios WHERE r_n <= 8)"""


@query(f"""
    WITH {_TRIPLETS_SQL}
    SELECT config_id, interaction_id, count(*) AS n, round(sum(r_l + r_m), 6) AS legs, round(sum(r_n), 6) AS far
    FROM near GROUP BY 1, 2
""")
def triplet_join(spark, sf):
    found = neighbours.triplets(None, standin.atoms(spark, sf, index=True), DEEP)
    return found.groupBy("config_id", "interaction_id").agg(
        F.count(F.lit(1)).alias("n"), _r6(F.sum(F.col("r_l") + F.col("r_m")), "legs"), _r6(F.sum("r_n"), "far")
    )


def _three_legs_sql() -> str:
    def leg(k: int, r: str) -> str:
        p = "abc"[k]
        d = f"({r} - {p}.t_lo)"
        return f"({p}.c0 + {d} * ({p}.c1 + {d} * ({p}.c2 + {d} * {p}.c3)))"

    joins = " ".join(
        f"JOIN pieces {'abc'[k]} ON {'abc'[k]}.interaction_id = near.interaction_id AND {'abc'[k]}.leg = {k} "
        f"AND {r} > {'abc'[k]}.t_lo AND {r} <= {'abc'[k]}.t_hi"
        for k, r in enumerate(("r_l", "r_m", "r_n"))
    )
    product = " * ".join(leg(k, r) for k, r in enumerate(("r_l", "r_m", "r_n")))
    return f"""
        SELECT near.config_id, g.feature_idx, round(sum({product} * g.weight), 6) + 0.0 AS value
        FROM near {joins}
        JOIN grid g ON g.interaction_id = near.interaction_id AND g.l = a.basis_idx AND g.m = b.basis_idx AND g.n = c.basis_idx
        GROUP BY 1, 2"""


@query(f"""
    WITH {_TRIPLETS_SQL}, {pieces_sql(DEEP, 3)}, {values_sql("grid", "interaction_id, l, m, n, feature_idx, weight", DEEP.grid())}
    {_three_legs_sql()}
""")
def energy_features_3b(spark, sf):
    trios = neighbours.triplets(None, standin.atoms(spark, sf, index=True), DEEP)
    return features.energy_features_3b(trios, DEEP).select("config_id", "feature_idx", _r6(F.col("value"), "value"))


@query(f"""
    WITH {_TRIPLETS_SQL.replace("SELECT a.config_id, a.i, interaction_id, a.r AS r_l, b.r AS r_m,", "SELECT a.config_id, a.i, a.j, b.j AS k, interaction_id, a.r AS r_l, b.r AS r_m, a.px AS jx, a.py AS jy, a.pz AS jz, b.px AS kx, b.py AS ky, b.pz AS kz,")},
    {pieces_sql(DEEP, 3)}, {values_sql("grid", "interaction_id, l, m, n, feature_idx, weight", DEEP.grid())},
    legs AS (
        SELECT near.*, p.px AS ix, p.py AS iy, p.pz AS iz, a.basis_idx AS l, b.basis_idx AS m, c.basis_idx AS n,
               {", ".join(f"{x}.c0 + ({r} - {x}.t_lo) * ({x}.c1 + ({r} - {x}.t_lo) * ({x}.c2 + ({r} - {x}.t_lo) * {x}.c3)) AS v{x}, {x}.c1 + ({r} - {x}.t_lo) * (2 * {x}.c2 + ({r} - {x}.t_lo) * 3 * {x}.c3) AS s{x}" for x, r in (("a", "r_l"), ("b", "r_m"), ("c", "r_n")))}
        FROM near JOIN atoms p ON p.config_id = near.config_id AND p.atom_idx = near.i
        {" ".join(f"JOIN pieces {x} ON {x}.interaction_id = near.interaction_id AND {x}.leg = {k} AND {r} > {x}.t_lo AND {r} <= {x}.t_hi" for k, (x, r) in enumerate((("a", "r_l"), ("b", "r_m"), ("c", "r_n"))))}
    ), told AS (
        SELECT legs.*, feature_idx, sa * vb * vc * weight AS dl, va * sb * vc * weight AS dm, va * vb * sc * weight AS dn
        FROM legs JOIN grid g ON g.interaction_id = legs.interaction_id AND g.l = legs.l AND g.m = legs.m AND g.n = legs.n
    ), ends AS (
        SELECT config_id, i AS atom_idx, feature_idx, {", ".join(f"dl * (j{x} - i{x}) / r_l + dm * (k{x} - i{x}) / r_m AS f{x}" for x in "xyz")} FROM told
        UNION ALL SELECT config_id, j, feature_idx, {", ".join(f"-dl * (j{x} - i{x}) / r_l + dn * (k{x} - j{x}) / r_n" for x in "xyz")} FROM told
        UNION ALL SELECT config_id, k, feature_idx, {", ".join(f"-dm * (k{x} - i{x}) / r_m - dn * (k{x} - j{x}) / r_n" for x in "xyz")} FROM told
    ), f AS (SELECT config_id, atom_idx, feature_idx, sum(fx) AS fx, sum(fy) AS fy, sum(fz) AS fz FROM ends GROUP BY 1, 2, 3)
    SELECT config_id, feature_idx, count(*) * 3 AS n, round(sum(abs(fx) + abs(fy) + abs(fz)), 4) AS total, round(sum(atom_idx * fx), 4) + 0.0 AS lever FROM f GROUP BY 1, 2
""")
def force_features_3b(spark, sf):
    trios = neighbours.triplets(None, standin.atoms(spark, sf, index=True), DEEP)
    rows = features.force_features_3b(trios, DEEP)
    lever = F.sum(F.when(F.col("component") == "fx", F.col("atom_idx") * F.col("value")).otherwise(0.0))
    return rows.groupBy("config_id", "feature_idx").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(F.abs("value")), 4).alias("total"), (F.round(lever, 4) + 0.0).alias("lever")
    )


@query(f"""
    WITH {_FORCES_2B_SQL}, energy AS (
        SELECT config_id, CAST(feat_offset + basis_idx AS INTEGER) AS feature_idx, sum(b) AS value FROM near JOIN spl USING (r) WHERE basis_idx < 12 GROUP BY 1, 2
        UNION ALL SELECT config_id, z - 1, count(*) FROM atoms GROUP BY 1, 2
    ), force AS (SELECT config_id, atom_idx, feature_idx, sum(fx) AS fx, sum(fy) AS fy, sum(fz) AS fz FROM ends GROUP BY 1, 2, 3),
    every AS (
        SELECT 'energy' AS component, feature_idx, value FROM energy UNION ALL SELECT 'fx', feature_idx, fx FROM force
        UNION ALL SELECT 'fy', feature_idx, fy FROM force UNION ALL SELECT 'fz', feature_idx, fz FROM force
    )
    SELECT component, feature_idx, sum(CASE WHEN abs(value) > 1e-9 THEN 1 ELSE 0 END)::BIGINT AS n, round(sum(abs(value)), 3) AS total FROM every GROUP BY 1, 2
    HAVING sum(CASE WHEN abs(value) > 1e-9 THEN 1 ELSE 0 END) > 0
""")
def feature_rows_wide(spark, sf):
    """Energy and force rows as arrays, summed up per place of the array."""
    rows = features.wide(features.feature_table(None, standin.atoms(spark, sf, index=True), BASIS), BASIS.n_features)
    told = rows.select("component", F.posexplode("x").alias("feature_idx", "value"))
    summed = told.groupBy("component", "feature_idx").agg(F.count_if(F.abs("value") > 1e-9).alias("n"), F.round(F.sum(F.abs("value")), 3).alias("total"))
    return summed.where("n > 0")


# --- fitting ------------------------------------------------------------------------

def _targets(spark: SparkSession, sf: str) -> DataFrame:
    c = standin.configs(spark, sf)
    return c.select("config_id", F.lit("energy").alias("component"), F.lit(None).cast("int").alias("atom_idx"), (F.col("energy") * SCALE).alias("y"))


def _training(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return fit.normalised(_energy_features(spark, sf), _targets(spark, sf), len(standin.SPECIES), atoms=standin.atoms(spark, sf))


_TRAINING_SQL = f"""
    {_FEATURES_2B_SQL}, sizes AS (SELECT config_id, count(*) AS size FROM atoms GROUP BY 1),
    x AS (SELECT config_id, feature_idx, value / size AS value FROM features JOIN sizes USING (config_id)),
    y AS (SELECT config_id, o_totalprice * {SCALE!r} / size AS y FROM orders JOIN sizes ON config_id = o_orderkey)"""


@query(f"WITH {_TRAINING_SQL} SELECT config_id, feature_idx, round(value, 6) AS value FROM x")
def normalised_training_rows(spark, sf):
    return _training(spark, sf)[0].select("config_id", F.col("feature_idx").cast("int").alias("feature_idx"), _r6(F.col("value"), "value"))


@query(f"""
    WITH {_TRAINING_SQL}, w AS (SELECT o_orderkey AS config_id, 2.0 AS w FROM orders WHERE o_orderstatus = 'F')
    SELECT config_id, round(y * coalesce(w, 1.0), 6) AS y FROM y LEFT JOIN w USING (config_id)
""")
def sample_weights(spark, sf):
    weights = standin.configs(spark, sf).where("prefix = 'F'").select("config_id", F.lit(2.0).alias("weight"))
    y = fit.normalised(_energy_features(spark, sf), _targets(spark, sf), 3, weights)[1]
    return y.select("config_id", _r6(F.col("y"), "y"))


@query("""
    SELECT event_type AS kind, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std
    FROM events GROUP BY 1
""")
def online_moments(spark, sf):
    from latticework.streaming.incremental import running_moments

    found = running_moments(standin.read(spark, sf, "events").select(F.col("event_type").alias("kind"), "value"), "kind", "value")
    return found.select("kind", "n", _r6(F.col("mean"), "mean"), _r6(F.col("std"), "std"))


_ALL_TARGETS_SQL = f"""
    WITH {ATOMS_SQL}, t AS (
        SELECT 'energy' AS kind, o_totalprice * {SCALE!r} AS y FROM orders
        UNION ALL SELECT 'force', unnest([fx, fy, fz]) FROM atoms
    ), m AS (
        SELECT count(CASE WHEN kind = 'energy' THEN y END) AS n_e, count(CASE WHEN kind = 'force' THEN y END) AS n_f,
               stddev_pop(CASE WHEN kind = 'energy' THEN y END) AS s_e, stddev_pop(CASE WHEN kind = 'force' THEN y END) AS s_f
        FROM t
    )"""


def _all_targets(spark: SparkSession, sf: str) -> DataFrame:
    c = standin.configs(spark, sf).withColumn("energy", F.col("energy") * SCALE)
    return features.targets(c, standin.atoms(spark, sf, index=True, forces=True))


@query(_ALL_TARGETS_SQL + " SELECT round(1 / (sqrt(n_e) * s_e), 9) AS w_e, round(1 / (sqrt(n_f) * s_f), 9) AS w_f FROM m")
def ef_weights(spark, sf):
    w = fit.kind_weights(fit.moments(_all_targets(spark, sf)))
    return w.select(F.round("w_e", 9).alias("w_e"), F.round("w_f", 9).alias("w_f"))


@query(_ALL_TARGETS_SQL + """
    SELECT kind, count(*) AS n, round(sum(y) * CASE kind WHEN 'energy' THEN 0.3 / (max(s_e) * max(n_e)) ELSE 0.7 / (max(s_f) * max(n_f)) END, 6) AS weighted
    FROM t, m GROUP BY kind
""")
def legacy_weights(spark, sf):
    t = fit.legacy_weights(_all_targets(spark, sf), 0.3).withColumn("kind", fit.kind_of())
    return t.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), _r6(F.sum(F.col("y") * F.col("weight")), "weighted"))


_GRAM_SQL = f"""
    WITH {_TRAINING_SQL}, g AS (
        SELECT 'energy' AS kind, a.feature_idx AS i, b.feature_idx AS j, sum(a.value * b.value) AS value
        FROM x a JOIN x b ON a.config_id = b.config_id AND a.feature_idx <= b.feature_idx GROUP BY 2, 3
    )"""


@query(_GRAM_SQL + " SELECT kind, i, j, round(value, 5) AS value FROM g")
def gram_matrix(spark, sf):
    x, _ = _training(spark, sf)
    return fit.gram(x).select("kind", F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), F.round("value", 5).alias("value"))


@query(_GRAM_SQL + " SELECT kind, i, j, round(value, 5) AS value FROM g WHERE abs(value) > 1e-9")
def gram_from_blocks(spark, sf):
    """The same sums by partial products of dense rows in each task."""
    x, _ = _training(spark, sf)
    g = fit.gram_blocks(x, BASIS.n_features).where("abs(value) > 1e-9")
    return g.select("kind", "i", "j", F.round("value", 5).alias("value"))


@query(f"""
    WITH {_TRAINING_SQL}
    SELECT 'energy' AS kind, feature_idx AS i, round(sum(value * y), 5) AS value FROM x JOIN y USING (config_id) GROUP BY 2
""")
def ordinate(spark, sf):
    o = fit.ordinate(*_training(spark, sf))
    return o.select("kind", F.col("i").cast("int").alias("i"), F.round("value", 5).alias("value"))


@query(_GRAM_SQL + f""", s AS (SELECT count(*) AS n, stddev_pop(y) AS std FROM y),
    {values_sql("r", "row, f, v", BASIS.penalties({"ridge_2b": 1e-2, "curve_2b": 1e-2, "ridge_1b": 1e-2}))}, p AS (
        SELECT a.f AS i, b.f AS j, sum(a.v * b.v) AS value FROM r a JOIN r b ON a.row = b.row AND a.f <= b.f GROUP BY 1, 2
    )
    SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(sum(value), 6) AS value FROM (
        SELECT i, j, 0.5 / (n * std * std) * value AS value FROM g, s UNION ALL SELECT * FROM p
    ) GROUP BY 1, 2
""")
def weighted_gram(spark, sf):
    x, y = _training(spark, sf)
    weights = fit.kind_weights(fit.moments(y)).withColumn("w_f", F.lit(0.0))
    data = fit.combine(fit.gram(x), weights, 0.5, ("i", "j"))
    penalty = fit.penalty_gram(BASIS.penalties_table(spark, {"ridge_2b": 1e-2, "curve_2b": 1e-2, "ridge_1b": 1e-2}))
    total = data.unionByName(penalty).groupBy(F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"))
    return total.agg(_r6(F.sum("value"), "value"))


_FROZEN = [(0, 10.0), (2, 4.0), (4, 0.0)]


@query(f"""
    WITH {_TRAINING_SQL}, {values_sql("c", "feature_idx, coefficient", _FROZEN)}
    SELECT config_id, round(y - coalesce(known, 0), 6) AS y FROM y LEFT JOIN (
        SELECT config_id, sum(value * coefficient) AS known FROM x JOIN c USING (feature_idx) GROUP BY 1
    ) USING (config_id)
""")
def freeze_columns(spark, sf):
    x, y = _training(spark, sf)
    frozen = spark.createDataFrame(_FROZEN, "feature_idx int, coefficient double")
    return fit.freeze(x, y, frozen)[1].select("config_id", _r6(F.col("y"), "y"))


@query(f"""
    WITH {_TRAINING_SQL}
    SELECT feature_idx, count(*) AS n, round(sum(value), 5) AS total FROM x
    WHERE feature_idx < 3 OR (feature_idx - 3) % 15 < 9 GROUP BY 1
""")
def column_drop(spark, sf):
    """Smaller pair cut-offs from the same features: the splines beyond them are left out."""
    x, _ = _training(spark, sf)
    dropped = [i.offset + k for i in BASIS.of_degree(2) for k in range(9, i.size)]
    keep = x.join(F.broadcast(spark.createDataFrame([(d,) for d in dropped], "feature_idx int")), "feature_idx", "left_anti")
    return keep.groupBy(F.col("feature_idx").cast("int").alias("feature_idx")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 5).alias("total"))


_MODEL = [(k, float((k * 37) % 11 - 5) / 4) for k in range(BASIS.n_features)]


def _fixed_model(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_MODEL, "feature_idx int, coefficient double")


_PREDICT_SQL = f"""
    WITH {_TRAINING_SQL}, {values_sql("c", "feature_idx, coefficient", _MODEL)}, p AS (
        SELECT config_id, sum(value * coefficient) AS predicted FROM x JOIN c USING (feature_idx) GROUP BY 1
    )"""


@query(_PREDICT_SQL + " SELECT config_id, round(predicted, 6) AS predicted FROM p")
def predict_rows(spark, sf):
    x, _ = _training(spark, sf)
    return fit.predict(x, _fixed_model(spark)).select("config_id", _r6(F.col("predicted"), "predicted"))


@query(_PREDICT_SQL + """
    SELECT 'energy' AS kind, count(*) AS n, round(sqrt(avg((predicted - y) * (predicted - y))), 6) AS rmse,
           round(avg(abs(predicted - y)), 6) AS mae, round(max(predicted - y), 6) AS max_residual,
           round(min(predicted - y), 6) AS min_residual
    FROM p JOIN y USING (config_id)
""")
def error_metrics(spark, sf):
    x, y = _training(spark, sf)
    told = fit.predict(x, _fixed_model(spark)).join(y.select("config_id", "y"), "config_id").withColumn("kind", fit.kind_of())
    return fit.error_metrics(told).select("kind", "n", *[_r6(F.col(c), c) for c in ("rmse", "mae", "max_residual", "min_residual")])


def _fitted(spark: SparkSession, sf: str) -> DataFrame:
    x, y = _training(spark, sf)
    weights = fit.kind_weights(fit.moments(y)).withColumn("w_f", F.lit(0.0))
    penalty = fit.penalty_gram(BASIS.penalties_table(spark, {"ridge_1b": 1e-8, "ridge_2b": 1e-8, "curve_2b": 1e-8}))
    g = fit.combine(fit.gram(x), weights, 0.5, ("i", "j")).unionByName(penalty).withColumn("model", F.lit(0))
    o = fit.combine(fit.ordinate(x, y), weights, 0.5, ("i",)).withColumn("model", F.lit(0))
    return fit.solve(g, o)


def _penalty_sql(strengths: dict[str, float]) -> str:
    return f"""
    {values_sql("r", "row, f, v", BASIS.penalties(strengths))}, penalty AS (
        SELECT a.f AS i, b.f AS j, sum(a.v * b.v) AS value FROM r a JOIN r b ON a.row = b.row AND a.f <= b.f GROUP BY 1, 2
    )"""


@query(f"""
    {_GRAM_SQL.replace("WITH", "WITH RECURSIVE", 1)}, s AS (SELECT count(*) AS n, stddev_pop(y) AS std FROM y),
    {_penalty_sql({"ridge_1b": 1e-8, "ridge_2b": 1e-8, "curve_2b": 1e-8})}, gm AS (
        SELECT 0 AS model, i, j, 0.5 / (n * std * std) * value AS value FROM g, s UNION ALL SELECT 0, i, j, value FROM penalty
    ), om AS (
        SELECT 0 AS model, feature_idx AS i, 0.5 / (n * std * std) * sum(value * y) AS value FROM x JOIN y USING (config_id), s GROUP BY 2, n, std
    ), {solve_sql("gm", "om")}
    SELECT CAST(i AS INTEGER) AS feature_idx, round(c, 3) + 0.0 AS coefficient FROM solved
""")
def ridge_fit(spark, sf):
    return _fitted(spark, sf).select("feature_idx", (F.round("coefficient", 3) + 0.0).alias("coefficient"))


_FOLDS = 3
_KEPT = (6, 9, 12)
_CV_RIDGE = {"ridge_1b": 1e-6, "ridge_2b": 1e-6}


@query(f"""
    WITH RECURSIVE {_FORCES_2B_SQL}, sizes AS (SELECT config_id, count(*) AS size FROM atoms GROUP BY 1),
    fold AS (SELECT o_orderkey AS config_id, ntile({_FOLDS}) OVER (ORDER BY o_orderkey) - 1 AS fold FROM orders),
    energy AS (
        SELECT config_id, feat_offset + basis_idx AS feature_idx, sum(b) AS value FROM near JOIN spl USING (r) WHERE basis_idx < 12 GROUP BY 1, 2
        UNION ALL SELECT config_id, z - 1, count(*) FROM atoms GROUP BY 1, 2
    ), force AS (SELECT config_id, atom_idx, feature_idx, sum(fx) AS fx, sum(fy) AS fy, sum(fz) AS fz FROM ends GROUP BY 1, 2, 3),
    x AS (
        SELECT fold, 'energy' AS kind, config_id, 0 AS part, feature_idx, value / size AS value FROM energy JOIN sizes USING (config_id) JOIN fold USING (config_id)
        UNION ALL SELECT fold, 'force', config_id, atom_idx * 3 + a, feature_idx, v FROM (
            SELECT config_id, atom_idx, feature_idx, unnest([0, 1, 2]) AS a, unnest([fx, fy, fz]) AS v FROM force
        ) JOIN fold USING (config_id)
    ), y AS (
        SELECT fold, 'energy' AS kind, config_id, 0 AS part, o_totalprice * {SCALE!r} / size AS y
        FROM orders JOIN sizes ON config_id = o_orderkey JOIN fold USING (config_id)
        UNION ALL SELECT fold, 'force', config_id, atom_idx * 3 + a, v FROM (
            SELECT config_id, atom_idx, unnest([0, 1, 2]) AS a, unnest([fx, fy, fz]) AS v FROM atoms
        ) JOIN fold USING (config_id)
    ), w AS (SELECT kind, 0.5 / (count(*) * stddev_pop(y) * stddev_pop(y)) AS w FROM y GROUP BY 1),
    g AS (
        SELECT fold, i, j, sum(w * value) AS value FROM (
            SELECT a.fold, a.kind, a.feature_idx AS i, b.feature_idx AS j, sum(a.value * b.value) AS value
            FROM x a JOIN x b ON a.kind = b.kind AND a.config_id = b.config_id AND a.part = b.part AND a.feature_idx <= b.feature_idx GROUP BY 1, 2, 3, 4
        ) JOIN w USING (kind) GROUP BY 1, 2, 3
    ), o AS (
        SELECT fold, i, sum(w * value) AS value FROM (
            SELECT x.fold, x.kind, feature_idx AS i, sum(value * y) AS value FROM x JOIN y USING (kind, config_id, part) GROUP BY 1, 2, 3
        ) JOIN w USING (kind) GROUP BY 1, 2
    ), {_penalty_sql(_CV_RIDGE)},
    grid AS (SELECT m, f FROM (VALUES (0, 6), (1, 9), (2, 12)) t(m, kept), range({BASIS.n_features}) s(f) WHERE f < 3 OR (f - 3) % 15 < kept),
    held AS (SELECT m, h, 3 * m + h AS model FROM range(3) a(m), range({_FOLDS}) b(h)),
    gm AS (
        SELECT model, i, j, value FROM g, held WHERE fold <> h AND (m, i) IN (SELECT m, f FROM grid) AND (m, j) IN (SELECT m, f FROM grid)
        UNION ALL SELECT model, i, j, value FROM penalty, held WHERE (m, i) IN (SELECT m, f FROM grid) AND (m, j) IN (SELECT m, f FROM grid)
    ), om AS (SELECT model, i, value FROM o, held WHERE fold <> h AND (m, i) IN (SELECT m, f FROM grid)),
    {solve_sql("gm", "om")}, predicted AS (
        SELECT model, kind, config_id, part, sum(value * c) AS p FROM x JOIN solved ON feature_idx = i GROUP BY 1, 2, 3, 4
    ), errors AS (
        SELECT m AS model, h, y.kind, CASE WHEN fold = h THEN 'valid' ELSE 'train' END AS part, sqrt(avg((y - coalesce(p, 0)) * (y - coalesce(p, 0)))) AS rmse
        FROM y CROSS JOIN held LEFT JOIN predicted p ON p.model = held.model AND p.kind = y.kind AND p.config_id = y.config_id AND p.part = y.part
        GROUP BY 1, 2, 3, 4
    )
    SELECT CAST(model AS INTEGER) AS model, kind, part, round(avg(rmse), 5) AS rmse FROM errors GROUP BY 1, 2, 3
""")
def cv_search(spark, sf):
    """Three pair cut-offs, three folds: training and validation errors of energies and forces.

    Features, Gram sums and targets are made once; fits and errors of all grid
    points come from the sums.
    """
    configs, atoms = standin.configs(spark, sf), standin.atoms(spark, sf, index=True, forces=True)
    x = features.feature_table(None, atoms, BASIS)
    folds = tables.folds(configs.select("config_id", "seq"), _FOLDS, "seq").select("config_id", "fold")
    y = features.targets(configs.withColumn("energy", F.col("energy") * SCALE), atoms)
    x, y = fit.normalised(x, y, len(standin.SPECIES), atoms=atoms)
    kept = "config_id", "component", "atom_idx"
    x = x.join(folds, "config_id").select("fold", *kept, "feature_idx", "value")
    path = scratch(spark, "features")  # three sums read them
    x.write.parquet(path)
    x = spark.read.schema(x.schema).parquet(path)
    y = y.join(folds, "config_id").select("fold", *kept, "y")
    weights = fit.kind_weights(fit.moments(y))
    g, o = fit.gram_blocks(x, BASIS.n_features, by=("fold",)), fit.ordinate(x, y, by=("fold",))
    path = scratch(spark, "gram")
    g.write.parquet(path)
    g = spark.read.schema(g.schema).parquet(path)
    rows = [(m, f) for m, n in enumerate(_KEPT) for i in BASIS.interactions for f in range(i.offset, i.offset + min(i.size, n))]
    models = fit.cross_validate(
        fit.combine(g, weights, 0.5, ("fold", "i", "j")), fit.combine(o, weights, 0.5, ("fold", "i")),
        spark.createDataFrame(rows, "model int, feature_idx int"), fit.penalty_gram(BASIS.penalties_table(spark, _CV_RIDGE)),
    )
    errors = fit.errors_from_sums(g, o, fit.square_sums(y, by=("fold",)), models)
    return errors.groupBy("model", "kind", "part").agg(F.round(F.avg("rmse"), 5).alias("rmse"))


# --- energies and forces together ----------------------------------------------------

_BOTH_SQL = f"""
    {_FORCES_2B_SQL}, sizes AS (SELECT config_id, count(*) AS size FROM atoms GROUP BY 1),
    x AS (
        SELECT 'energy' AS kind, config_id, 0 AS part, feature_idx, value / size AS value FROM (
            SELECT config_id, feat_offset + basis_idx AS feature_idx, sum(b) AS value FROM near JOIN spl USING (r) WHERE basis_idx < 12 GROUP BY 1, 2
            UNION ALL SELECT config_id, z - 1, count(*) FROM atoms GROUP BY 1, 2
        ) JOIN sizes USING (config_id)
        UNION ALL SELECT 'force', config_id, atom_idx * 3 + a, feature_idx, v FROM (
            SELECT config_id, atom_idx, feature_idx, unnest([0, 1, 2]) AS a, unnest([sum(fx), sum(fy), sum(fz)]) AS v FROM ends GROUP BY 1, 2, 3
        )
    ), y AS (
        SELECT 'energy' AS kind, config_id, 0 AS part, o_totalprice * {SCALE!r} / size AS y FROM orders JOIN sizes ON config_id = o_orderkey
        UNION ALL SELECT 'force', config_id, atom_idx * 3 + a, v FROM (
            SELECT config_id, atom_idx, unnest([0, 1, 2]) AS a, unnest([fx, fy, fz]) AS v FROM atoms
        )
    ), w AS (SELECT kind, 1 / (count(*) * stddev_pop(y) * stddev_pop(y)) AS w FROM y GROUP BY 1),
    g AS (
        SELECT a.kind, a.feature_idx AS i, b.feature_idx AS j, sum(a.value * b.value) AS value
        FROM x a JOIN x b ON a.kind = b.kind AND a.config_id = b.config_id AND a.part = b.part AND a.feature_idx <= b.feature_idx GROUP BY 1, 2, 3
    ), o AS (SELECT x.kind, feature_idx AS i, sum(value * y) AS value FROM x JOIN y USING (kind, config_id, part) GROUP BY 1, 2)"""


def _both(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Energy and force rows, and their targets."""
    configs, atoms = standin.configs(spark, sf), standin.atoms(spark, sf, index=True, forces=True)
    y = features.targets(configs.withColumn("energy", F.col("energy") * SCALE), atoms)
    return fit.normalised(features.feature_table(None, atoms, BASIS), y, len(standin.SPECIES), atoms=atoms)


@query(f"WITH {_BOTH_SQL} SELECT kind, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(value, 5) AS value FROM g WHERE abs(value) > 1e-9")
def gram_by_tiles(spark, sf):
    """Gram sums of energies and forces, made tile by tile."""
    told = tiles.to_long(tiles.gram_tiles(_both(spark, sf)[0], side=32), ("kind",), side=32)
    return told.where("abs(value) > 1e-9").select("kind", "i", "j", F.round("value", 5).alias("value"))


@query(f"WITH {_BOTH_SQL} SELECT kind, CAST(i AS INTEGER) AS i, round(value, 5) AS value FROM o")
def ordinate_with_forces(spark, sf):
    o = fit.ordinate(*_both(spark, sf))
    return o.select("kind", F.col("i").cast("int").alias("i"), F.round("value", 5).alias("value"))


@query(f"""
    WITH {_BOTH_SQL}, {values_sql("c", "feature_idx, coefficient", _MODEL)}, p AS (
        SELECT kind, config_id, part, sum(value * coefficient) AS predicted FROM x JOIN c USING (feature_idx) GROUP BY 1, 2, 3
    )
    SELECT kind, count(*) AS n, round(sqrt(avg((predicted - y) * (predicted - y))), 6) AS rmse, round(avg(abs(predicted - y)), 6) AS mae,
           round(max(predicted - y), 6) AS max_residual, round(min(predicted - y), 6) AS min_residual
    FROM p JOIN y USING (kind, config_id, part) GROUP BY 1
""")
def error_metrics_with_forces(spark, sf):
    x, y = _both(spark, sf)
    same = [F.col(f"p.{c}").eqNullSafe(F.col(f"y.{c}")) for c in fit.ROW]
    told = fit.predict(x, _fixed_model(spark)).alias("p").join(y.alias("y"), same).select("y.component", "predicted", "y.y").withColumn("kind", fit.kind_of())
    return fit.error_metrics(told).select("kind", "n", *[_r6(F.col(c), c) for c in ("rmse", "mae", "max_residual", "min_residual")])


_KAPPAS = (0.5, 0.9)
_TILE_RIDGE = {"ridge_1b": 1e-2, "ridge_2b": 1e-2}


@query(f"""
    WITH RECURSIVE {_BOTH_SQL}, {_penalty_sql(_TILE_RIDGE)}, m AS (SELECT * FROM (VALUES {", ".join(f"({i}, {k!r})" for i, k in enumerate(_KAPPAS))}) t(model, kappa)),
    f AS (SELECT model, kind, w * CASE kind WHEN 'energy' THEN kappa ELSE 1 - kappa END AS f FROM m, w),
    gm AS (SELECT model, i, j, f * value AS value FROM g JOIN f USING (kind) UNION ALL SELECT model, i, j, value FROM penalty, m),
    om AS (SELECT model, i, f * value AS value FROM o JOIN f USING (kind)), {solve_sql("gm", "om")}
    SELECT CAST(model AS INTEGER) AS model, CAST(i AS INTEGER) AS feature_idx, round(c, 4) + 0.0 AS coefficient FROM solved
""")
def conjugate_fit(spark, sf):
    """Two models, of different weight of the energies, by conjugate gradients over Gram tiles."""
    x, y = _both(spark, sf)
    path = scratch(spark, "features")  # tiles and ordinate read them
    x.write.parquet(path)
    x = spark.read.schema(x.schema).parquet(path)
    models = spark.createDataFrame(list(enumerate(_KAPPAS)), "model int, kappa double").crossJoin(fit.kind_weights(fit.moments(y)))
    share = F.when(F.col("kind") == "energy", F.col("kappa") * F.col("w_e") * F.col("w_e")).otherwise((1 - F.col("kappa")) * F.col("w_f") * F.col("w_f"))
    kinds = models.withColumn("kind", F.explode(F.array(F.lit("energy"), F.lit("force")))).select("model", "kind", share.alias("share"))  # two rows a model
    penalty = fit.penalty_gram(BASIS.penalties_table(spark, _TILE_RIDGE)).crossJoin(models.select("model"))
    whole = tiles.weighted(tiles.gram_tiles(x, side=32).join(kinds, "kind"), F.col("share"), ("model",), tiles.to_tiles(penalty, ("model",), side=32))
    o = fit.ordinate(x, y).join(kinds, "kind").select("model", "i", (F.col("value") * F.col("share")).alias("value"))
    found = tiles.solve_tiles(whole, o, side=32).where("covered")
    return found.select("model", "feature_idx", (F.round("coefficient", 4) + 0.0).alias("coefficient"))


_SERIES_SQL = """
    series AS (
        SELECT l_suppkey AS model, ascii(l_returnflag) AS interaction_id, list(b ORDER BY b) AS b, list(c ORDER BY b) AS c FROM (
            SELECT l_suppkey, l_returnflag, month(l_shipdate) - 1 AS b, avg(l_extendedprice) / 10000 - 3.8 AS c FROM lineitem GROUP BY 1, 2, 3
        ) GROUP BY 1, 2
    )"""


@query(f"""
    WITH {_SERIES_SQL}, ends AS (
        SELECT *, len(c) AS n, list_position(c, list_max(c)) AS top, list_position(c, list_min(c)) AS low FROM series
    ), well AS (
        SELECT *, CASE WHEN low < top AND list_max(list_transform(c[:top - 1], lambda x: round_even(x, 3))) - list_min(list_transform(c[:top - 1], lambda x: round_even(x, 3))) < 0.01
                       THEN top + 1 ELSE low END - 1 AS well FROM ends
    ), before AS (
        SELECT *, list_transform(c[:well], lambda x, i: round_even(x, 3) + (i - 1) * 1e-6) AS l FROM well
    ), peak AS (SELECT *, coalesce(list_position(l, list_max(l)), 0) AS p FROM before),
    judged AS (
        SELECT *, well > 1 AND len(list_filter(range(1, p), lambda i: coalesce(l[i + 1], l[i]) < coalesce(l[nullif(i - 1, 0)], l[i]))) = 0 AS rises FROM peak
    ), fixed AS (
        SELECT model, interaction_id, b, list_transform(c, lambda x, i: CASE WHEN rises AND i < p
            THEN list_reduce(list_prepend(abs(c[p]), list_transform(range(0, p - i), lambda q: 0e0)), lambda v, q: greatest(abs(v) * 2, 0.1)) ELSE x END) AS c FROM judged
    )
    SELECT model, interaction_id, CAST(unnest(b) AS INTEGER) AS basis_idx, round(unnest(list_transform(c, lambda x, i: CASE WHEN i = 1 THEN greatest(x, 2e0) ELSE x END)), 6) + 0.0 AS coefficient
    FROM fixed
""")
def core_repair(spark, sf):
    """Mean prices by supplier, flag and month, taken for coefficient series."""
    lines = standin.read(spark, sf, "lineitem").groupBy(
        F.col("l_suppkey").alias("model"), F.ascii("l_returnflag").alias("interaction_id"), (F.month("l_shipdate") - 1).alias("basis_idx")
    )
    series = lines.agg((F.avg("l_extendedprice") / 10000 - 3.8).alias("coefficient"))
    return repair.harden_cores(series).select("model", "interaction_id", "basis_idx", _r6(F.col("coefficient"), "coefficient"))


@query(f"""
    WITH {pairs_with_ids_sql(BASIS)}, {pieces_sql(BASIS, 2)}, model AS (
        SELECT interaction_id, basis_idx, ln(1 + count(*)) AS c FROM near JOIN pieces USING (interaction_id) WHERE r > t_lo AND r <= t_hi GROUP BY 1, 2
    ), centres AS (SELECT *, greatest(0, least(12, basis_idx - 1)) AS mid, min(CASE WHEN basis_idx >= 2 THEN basis_idx END) OVER (PARTITION BY interaction_id) AS first FROM model),
    start AS (
        SELECT s.interaction_id, s.mid AS x0, sum(c.c * (c0 + d * (c1 + d * (c2 + d * c3)))) AS y, sum(c.c * (c1 + d * (2 * c2 + 3 * d * c3))) AS d1,
               greatest(sum(c.c * (2 * c2 + 6 * d * c3)), 2) AS d2
        FROM centres s JOIN (SELECT *, x - t_lo AS d FROM pieces, range(0, 13) t(x) WHERE x > t_lo AND x <= t_hi) p ON p.interaction_id = s.interaction_id AND p.x = s.mid
        JOIN model c ON c.interaction_id = p.interaction_id AND c.basis_idx = p.basis_idx
        WHERE s.basis_idx = s.first GROUP BY 1, 2
    )
    SELECT interaction_id, basis_idx, round(CASE WHEN basis_idx < first AND y IS NOT NULL THEN y + d1 * (mid - x0) + d2 * (mid - x0) * (mid - x0) / 2 ELSE c END, 6) + 0.0 AS coefficient
    FROM centres LEFT JOIN start USING (interaction_id)
""")
def repulsion_fix(spark, sf):
    """Logarithms of the pairs that each spline sees, taken for coefficients; the first two count as not covered."""
    model = _counted_model(spark, sf)
    ids = [(x.number, k, x.offset + k, float(x.knots[0][k + 2])) for x in BASIS.of_degree(2) for k in range(x.size)]
    named = model.join(F.broadcast(spark.createDataFrame(ids, "interaction_id int, basis_idx int, feature_idx int, centre double")), "feature_idx")
    covered = named.select(F.lit(0).alias("model"), "interaction_id", "basis_idx", "coefficient", (F.col("basis_idx") >= 2).alias("covered"))
    centres = spark.createDataFrame([(a, b, d) for a, b, _, d in ids], "interaction_id int, basis_idx int, centre double")
    segments = score.potential_segments(BASIS, model.withColumn("model", F.lit(0)))
    fixed = repair.repulsion(covered, centres, segments)
    return fixed.select("interaction_id", "basis_idx", _r6(F.col("coefficient"), "coefficient"))


def _counted_model(spark: SparkSession, sf: str) -> DataFrame:
    """(feature_idx, coefficient): the logarithm of how many pairs each spline sees."""
    met = features.segment_join(_pairs(spark, sf), BASIS.segments_table(spark, 2))
    offsets = F.create_map(*[F.lit(v) for x in BASIS.of_degree(2) for v in (x.number, x.offset)])
    feature = (F.element_at(offsets, F.col("interaction_id")) + F.col("basis_idx")).alias("feature_idx")
    return met.groupBy(feature).agg(F.log(1 + F.count(F.lit(1))).alias("coefficient"))


@query(f"""
    WITH {PAIRS_SQL}, {values_sql("ids", "zi, zj, interaction_id", [(*x.species, x.number) for x in BASIS.of_degree(2)])},
    f AS (SELECT interaction_id, zi = zj AS alike, count(*) AS n FROM pairs JOIN ids USING (zi, zj) WHERE r < 12 GROUP BY 1, 2)
    SELECT interaction_id, n, n * 2 AS doubled FROM f
""")
def pair_direction_counts(spark, sf):
    derived = neighbours.pair_derivatives(None, standin.atoms(spark, sf, index=True), BASIS)
    counted = derived.groupBy("interaction_id").agg(F.count(F.lit(1)).alias("doubled"))
    return counted.select("interaction_id", (F.col("doubled") / 2).cast("long").alias("n"), "doubled")


# --- scoring ------------------------------------------------------------------------

_SCORE_SQL = f"""
    WITH {_FEATURES_2B_SQL}, {values_sql("c", "feature_idx, coefficient", _MODEL)}
    SELECT o_orderkey AS config_id, round(coalesce(e, 0.0), 6) AS predicted FROM orders LEFT JOIN (
        SELECT config_id, sum(value * coefficient) AS e FROM features JOIN c USING (feature_idx) GROUP BY 1
    ) ON config_id = o_orderkey"""


@query(_SCORE_SQL)
def score_energies(spark, sf):
    unbounded = standin.configs(spark, sf).select("config_id", F.lit(None).cast("array<array<double>>").alias("cell"), F.array(*[F.lit(False)] * 3).alias("pbc"))
    scored = score.energies(unbounded, standin.atoms(spark, sf, index=True), BASIS, _fixed_model(spark))
    return scored.select("config_id", _r6(F.col("predicted"), "predicted"))


@query(f"""
    WITH {_FORCES_2B_SQL}, {values_sql("c", "feature_idx, coefficient", _MODEL)}, f AS (
        SELECT config_id, atom_idx, sum(fx * coefficient) AS fx, sum(fy * coefficient) AS fy, sum(fz * coefficient) AS fz
        FROM ends JOIN c USING (feature_idx) GROUP BY 1, 2
    )
    SELECT config_id, CAST(atom_idx AS INTEGER) AS atom_idx, round(coalesce(f.fx, 0.0), 5) + 0.0 AS fx, round(coalesce(f.fy, 0.0), 5) + 0.0 AS fy,
           round(coalesce(f.fz, 0.0), 5) + 0.0 AS fz
    FROM atoms LEFT JOIN f USING (config_id, atom_idx)
""")
def score_forces(spark, sf):
    atoms = standin.atoms(spark, sf, index=True)
    scored = score.forces(None, atoms, BASIS, _fixed_model(spark))
    return scored.select("config_id", F.col("atom_idx").cast("int").alias("atom_idx"), *[(F.round(c, 5) + 0.0).alias(c) for c in ("fx", "fy", "fz")])


def _scan(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    zero = F.array(*[F.array(*[F.lit(20.0 * (a == b)) for b in range(3)]) for a in range(3)])
    c = standin.configs(spark, sf).select("config_id", zero.alias("cell"), F.array(*[F.lit(False)] * 3).alias("pbc"))
    return c, standin.atoms(spark, sf, index=True)


def _deformed_sql(variants: str) -> str:
    """energies(config_id, v, e): pair energies of every configuration under the matrices of ``variants``(v, a, b, c, yz, xz, xy)."""
    return f"""
    {ATOMS_SQL}, {values_sql("ids", "zi, zj, feat_offset", [(*x.species, x.offset) for x in BASIS.of_degree(2)])},
    {values_sql("coef", "feature_idx, coefficient", _MODEL)}, variants AS ({variants}), gaps AS (
        SELECT a.config_id, least(a.z, b.z) AS zi, greatest(a.z, b.z) AS zj, b.px - a.px AS x, b.py - a.py AS y, b.pz - a.pz AS z, count(*) AS n
        FROM atoms a JOIN atoms b USING (config_id) GROUP BY ALL
    ), moved AS (
        SELECT *, sqrt(pow(a * x + xy * y + xz * z, 2) + pow(xy * x + b * y + yz * z, 2) + pow(xz * x + yz * y + c * z, 2)) AS r
        FROM (SELECT DISTINCT x, y, z FROM gaps), variants
    ), {splines_sql("spl", 12, "SELECT r FROM moved WHERE r > 0 AND r < 12")}, energies AS (
        SELECT config_id, v, sum(n * spl.b * coefficient) AS e FROM gaps JOIN moved USING (x, y, z) JOIN spl USING (r) JOIN ids USING (zi, zj)
        JOIN coef ON feature_idx = feat_offset + basis_idx WHERE basis_idx < 12 GROUP BY 1, 2
    )"""


@query(f"""
    WITH {_deformed_sql("SELECT v, k, s, 1 + CASE WHEN k = 1 THEN s * 1e-4 ELSE 0 END AS a, 1 + CASE WHEN k = 2 THEN s * 1e-4 ELSE 0 END AS b, 1 + CASE WHEN k = 3 THEN s * 1e-4 ELSE 0 END AS c, CASE WHEN k = 4 THEN s * 5e-5 ELSE 0 END AS yz, CASE WHEN k = 5 THEN s * 5e-5 ELSE 0 END AS xz, CASE WHEN k = 6 THEN s * 5e-5 ELSE 0 END AS xy FROM (SELECT k * 10 + s AS v, k, s FROM range(1, 7) t(k), (VALUES (-1), (1)) u(s))")}
    SELECT o_orderkey AS config_id, ['xx', 'yy', 'zz', 'yz', 'xz', 'xy'][k] AS axis, round(coalesce(sum(s * e), 0) / (2e-4 * 8000), 7) + 0.0 AS stress
    FROM orders CROSS JOIN variants LEFT JOIN energies ON config_id = o_orderkey AND energies.v = variants.v GROUP BY 1, k
""")
def numerical_stress(spark, sf):
    c, a = _scan(spark, sf)
    return score.stress(c, a, BASIS, _fixed_model(spark)).select("config_id", "axis", (F.round("stress", 7) + 0.0).alias("stress"))


@query(f"""
    WITH {_deformed_sql("SELECT v, v AS a, v AS b, v AS c, 0 AS yz, 0 AS xz, 0 AS xy FROM (VALUES (0.9e0), (0.95e0), (1e0), (1.05e0), (1.1e0)) t(v)")},
    own AS (SELECT config_id, sum(coefficient) AS e0 FROM atoms JOIN coef ON feature_idx = z - 1 GROUP BY 1)
    SELECT o_orderkey AS config_id, v.v AS best_scale, round(coalesce(e, 0) + coalesce(e0, 0), 6) + 0.0 AS best_energy
    FROM orders CROSS JOIN variants v LEFT JOIN energies n ON n.config_id = o_orderkey AND n.v = v.v LEFT JOIN own ON own.config_id = o_orderkey
    QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY coalesce(e, 0), v.v) = 1
""")
def equation_of_state(spark, sf):
    c, a = _scan(spark, sf)
    found = score.equation_of_state(c, a, BASIS, _fixed_model(spark), [0.9, 0.95, 1.0, 1.05, 1.1])
    return found.select("config_id", "best_scale", _r6(F.col("best_energy"), "best_energy"))


@query("""
    WITH o AS (SELECT o_orderkey, o_custkey, o_totalprice * 1.0123456789 AS energy, o_orderkey % 7 + 1 AS size FROM orders),
    b AS (SELECT o_custkey AS cust, sum(energy) / sum(size) AS e FROM o GROUP BY 1)
    SELECT o_orderkey AS config_id, round((energy - size * e) / 12.5 / 2, 4) AS surface_energy,
           round(energy - e * size, 4) AS vacancy_energy
    FROM o JOIN b ON cust = o_custkey
""")
def structure_energies(spark, sf):
    c = standin.configs(spark, sf).select(
        "config_id", "cust", (F.col("energy") * 1.0123456789).alias("energy"), (F.col("config_id") % 7 + 1).alias("size"), F.lit(12.5).alias("area")
    )
    bulk = c.groupBy("cust").agg(F.sum("energy").alias("energy"), F.sum("size").alias("size"))
    both = score.vacancy_energy(score.surface_energy(c, bulk, "cust"), bulk, "cust")
    return both.select("config_id", *[F.round(x, 4).alias(x) for x in ("surface_energy", "vacancy_energy")])


@query(f"""
    WITH {pairs_with_ids_sql(BASIS)}, {pieces_sql(BASIS, 2)}, {values_sql("c", "feature_idx, coefficient", _MODEL)},
    s AS (
        SELECT p.interaction_id, t_lo, t_hi, sum(coefficient * c0) AS c0, sum(coefficient * c1) AS c1,
               sum(coefficient * c2) AS c2, sum(coefficient * c3) AS c3
        FROM pieces p JOIN ids ON ids.interaction_id = p.interaction_id JOIN c ON feature_idx = feat_offset + basis_idx GROUP BY 1, 2, 3
    ), b AS (SELECT interaction_id, min(r) AS lo, max(r) AS hi FROM near GROUP BY 1),
    q AS (SELECT interaction_id, lo + k * ((hi - lo) / 99) AS r FROM b, range(100) t(k))
    SELECT q.interaction_id, round(r, 6) AS r, round(coalesce(2 * {HORNER_SQL}, 0.0), 6) + 0.0 AS e,
           round(coalesce(-2 * {SLOPE_SQL}, 0.0), 6) + 0.0 AS f
    FROM q LEFT JOIN s ON s.interaction_id = q.interaction_id AND r > t_lo AND r <= t_hi
""")
def tabulated_pair(spark, sf):
    bounds = _pairs(spark, sf).groupBy("interaction_id").agg(F.min("r").alias("r_lo"), F.max("r").alias("r_hi"))
    sampled = score.sample_potential(score.potential_segments(BASIS, _fixed_model(spark)), score.grid_points(bounds))
    return sampled.select("interaction_id", _r6(F.col("r"), "r"), _r6(F.col("e"), "e"), _r6(F.col("f"), "f"))


# --- sampling -----------------------------------------------------------------------

def _fps_sql(rows: str, n: int, distance: str, least: float) -> str:
    """Farthest-first picks of rows(g, key, v): each step keeps every row's distance to the picked ones."""
    return f"""
    WITH RECURSIVE rows AS ({rows}), steps AS (
        SELECT g, key, v, 0 AS picked, CAST('inf' AS DOUBLE) AS gap, row_number() OVER (PARTITION BY g ORDER BY {"v" if distance.startswith("abs") else "v[1]"}, key) AS place
        FROM rows
        UNION ALL
        SELECT g, key, v, picked + 1, gap, row_number() OVER (PARTITION BY g ORDER BY gap DESC, key) FROM (
            SELECT g, key, v, picked, least(gap, {distance}) AS gap FROM (
                SELECT *, max(CASE WHEN place = 1 THEN v END) OVER (PARTITION BY g) AS w FROM steps WHERE picked + 1 < {n}
            )
        )
    ), ends AS (SELECT g, min(picked) AS last FROM steps WHERE place = 1 AND (gap <= 0 OR gap < {least}) GROUP BY 1)
    SELECT g, key, picked FROM steps LEFT JOIN ends USING (g) WHERE place = 1 AND picked < coalesce(last, 1e9)"""


@query(f"SELECT g AS prefix, key AS config_id, picked FROM ({_fps_sql('SELECT o_orderstatus AS g, o_orderkey AS key, o_totalprice AS v FROM orders', 50, 'abs(v - w)', 10.0)})")
def fps_sample(spark, sf):
    rows = standin.configs(spark, sf).select("prefix", "config_id", "energy")
    return sampling.farthest_points(rows, "prefix", "config_id", ["energy"], max_samples=50, min_diff=10.0)


@query(f"""SELECT g AS label, key AS vec_id, picked FROM ({_fps_sql(
    'SELECT label AS g, vec_id AS key, embedding::DOUBLE[] AS v FROM embeddings', 10,
    'sqrt(list_sum(list_transform(range(1, 65), lambda q: (v[q] - w[q]) * (v[q] - w[q]))))', 0.0)})""")
def fps_vectors(spark, sf):
    e = standin.read(spark, sf, "embeddings").select("label", "vec_id", *[F.get("embedding", F.lit(k)).cast("double").alias(f"v{k}") for k in range(64)])
    return sampling.farthest_points(e, "label", "vec_id", [f"v{k}" for k in range(64)], max_samples=10)


@query(f"""SELECT g AS prefix, key AS config_id, picked FROM ({_fps_sql(
    'SELECT o_orderstatus AS g, o_orderkey AS key, [o_totalprice, o_custkey * 100e0] AS v FROM orders', 40,
    'sqrt((v[1] - w[1]) * (v[1] - w[1]) + (v[2] - w[2]) * (v[2] - w[2]))', 50.0)})""")
def fps_by_blocks(spark, sf):
    """As fps_sample in two dimensions, with groups of over 1,000 rows in blocks."""
    rows = standin.configs(spark, sf).select("prefix", "config_id", "energy", (F.col("cust") * 100.0).alias("cust"))
    return sampling.farthest_points(rows, "prefix", "config_id", ["energy", "cust"], max_samples=40, min_diff=50.0, group_rows=1000)


@query(f"""
    WITH {ATOMS_SQL}, f AS (
        SELECT config_id, CAST(atom_idx AS INTEGER) AS atom_idx, unnest([0, 1, 2]) AS axis, unnest([fx, fy, fz]) AS f FROM atoms
    )
    SELECT config_id, atom_idx, axis, -sign(f) * 0.01e0 + 0.0e0 AS shift, round(o_totalprice - f * (-sign(f) * 0.01e0), 4) AS energy
    FROM f JOIN orders ON config_id = o_orderkey
""")
def force_displacements(spark, sf):
    moved = sampling.axis_displacements(standin.configs(spark, sf), standin.atoms(spark, sf, index=True, forces=True), 0.01)
    return moved.select("config_id", F.col("atom_idx").cast("int").alias("atom_idx"), "axis", (F.col("shift") + F.lit(0.0)).alias("shift"), F.round("energy", 4).alias("energy"))


def _draw_sql(*parts: object) -> str:
    """A number in [0, 1) by a hash of the parts, as ``sampling.uniform`` draws it."""
    return f"(('0x' || md5(concat_ws(':', {', '.join(map(str, parts))}))[:12])::BIGINT / 281474976710656e0)"


@query(f"""
    WITH {ATOMS_SQL}, moved AS (
        SELECT config_id, CAST(c AS INTEGER) AS copy, {" + ".join(f"{f} * (2 * {_draw_sql(0, 'config_id', 'atom_idx', 'c', a)} - 1) * 0.05e0" for a, f in enumerate(("fx", "fy", "fz")))} AS work
        FROM atoms, range(3) t(c)
    )
    SELECT config_id, copy, round(o_totalprice - sum(work), 5) AS energy FROM moved JOIN orders ON config_id = o_orderkey GROUP BY config_id, copy, o_totalprice
""")
def random_displacements(spark, sf):
    made = sampling.random_displacements(standin.configs(spark, sf), standin.atoms(spark, sf, index=True, forces=True), 0.05, 3)[0]
    return made.select("config_id", "copy", F.round("energy", 5).alias("energy"))


@query(f"""
    WITH {ATOMS_SQL}, noise AS (
        SELECT config_id, atom_idx, unnest([px, py, pz]) AS p, unnest([0, 1, 2]) AS a FROM atoms
    )
    SELECT config_id, round(sum(p + 0.1e0 * sqrt(-2 * ln(1 - {_draw_sql(3, 'config_id', 'atom_idx', '2 * a')})) * cos(2 * pi() * {_draw_sql(3, 'config_id', 'atom_idx', '2 * a + 1')})), 5) AS total
    FROM noise GROUP BY 1
""")
def rattled_places(spark, sf):
    moved = sampling.rattle(standin.atoms(spark, sf, index=True), 0.1, seed=3)
    return moved.groupBy("config_id").agg(F.round(F.sum(F.col("px") + F.col("py") + F.col("pz")), 5).alias("total"))


@query(f"SELECT o_orderkey AS config_id, {_draw_sql(5, 'o_orderkey')} < 0.2 AS held FROM orders")
def holdout_share(spark, sf):
    return tables.holdout_fraction(standin.configs(spark, sf), 0.2, seed=5).select("config_id", "held")


# --- text sources: written from the tables, read back ----------------------------------

@query(f"""
    WITH {ATOMS_SQL}
    SELECT o_orderkey AS config_id, round(o_totalprice, 4) AS energy, count(*) AS size, round(sum(px), 4) AS sum_px,
           round(sum(fx), 4) AS sum_fx
    FROM orders JOIN atoms ON config_id = o_orderkey GROUP BY 1, 2
""")
def xyz_round_trip(spark, sf):
    """Orders written as extended-xyz frames, many to a file, and scanned again."""
    from latticework.sources.text import read_xyz

    symbol = F.element_at(F.array(F.lit("H"), F.lit("He"), F.lit("Li")), F.col("z"))
    line = F.concat_ws(" ", symbol, "px", "py", "pz", "fx", "fy", "fz")  # doubles in their shortest exact form
    atoms = standin.atoms(spark, sf, index=True, forces=True).groupBy("config_id").agg(
        F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("atom_idx", line.alias("line")))).alias("lines")
    )
    head = F.format_string('Properties=species:S:1:pos:R:3:force:R:3 energy=%.6f order=%d', "energy", "config_id")
    body = F.array_join(F.transform("lines", lambda x: x["line"]), "\n")
    frames = atoms.join(standin.configs(spark, sf), "config_id").select(F.concat_ws("\n", F.col("n").cast("string"), head, body).alias("value"))
    path = scratch(spark, "xyz")
    frames.write.option("maxRecordsPerFile", 2000).text(path)
    configs, found = read_xyz(spark, path, scalars=("order",))
    per = found.groupBy("file", "frame").agg(F.count(F.lit(1)).alias("size"), F.sum("px").alias("sum_px"), F.sum("fx").alias("sum_fx"))
    return configs.join(per, ["file", "frame"]).select(
        F.col("order").cast("long").alias("config_id"), F.round("energy", 4).alias("energy"), "size", F.round("sum_px", 4).alias("sum_px"), F.round("sum_fx", 4).alias("sum_fx")
    )


@query("""
    SELECT DISTINCT epoch(date_trunc('hour', ts))::BIGINT AS step, round(value, 4) AS energy FROM events
""")
def log_round_trip(spark, sf):
    """Events written as thermo blocks, one for each user group and day, and scanned again."""
    from latticework.sources.text import read_log

    e = standin.read(spark, sf, "events").select(
        F.unix_timestamp(F.date_trunc("hour", "ts")).alias("step"), F.round("value", 4).alias("v"), (F.col("user_id") % 64).alias("run"), F.to_date("ts").alias("day"), "event_id"
    )
    line = F.format_string("%d 300.0 %.4f", "step", "v")
    blocks = e.groupBy("run", "day").agg(F.array_sort(F.collect_list(F.struct("event_id", line.alias("line")))).alias("lines"))
    text = F.concat(F.lit("\nStep Temp PotEng\n"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n"), F.lit("\nLoop time of 1\n"))
    path = scratch(spark, "log")
    blocks.select(text.alias("value")).write.option("maxRecordsPerFile", 100).text(path)
    return read_log(spark, path, {"Step": "step", "PotEng": "energy"}).select("step", F.round("energy", 4).alias("energy")).distinct()


@query(f"""
    WITH {ATOMS_SQL}
    SELECT config_id AS step, count(*) AS size, round(sum(px), 4) AS sum_px, round(sum(fx), 4) AS sum_fx FROM atoms GROUP BY 1
""")
def dump_round_trip(spark, sf):
    """Orders written as dump snapshots and scanned again, split at every snapshot."""
    from latticework.sources.text import dump_atoms, read_dump

    line = F.concat_ws(" ", F.col("atom_idx") + 1, "z", "px", "py", "pz", "fx", "fy", "fz")
    atoms = standin.atoms(spark, sf, index=True, forces=True).groupBy("config_id").agg(
        F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("atom_idx", line.alias("line")))).alias("lines")
    )
    head = F.format_string(
        "ITEM: TIMESTEP\n%d\nITEM: NUMBER OF ATOMS\n%d\nITEM: BOX BOUNDS pp pp pp\n0 50\n0 10\n0 8\nITEM: ATOMS id type x y z fx fy fz", "config_id", "n"
    )
    path = scratch(spark, "dump")
    atoms.select(F.concat_ws("\n", head, F.array_join(F.transform("lines", lambda x: x["line"]), "\n")).alias("value")).write.text(path)
    found = dump_atoms(read_dump(spark, path)[1], {"1": "H", "2": "He", "3": "Li"})
    return found.groupBy("step").agg(F.count(F.lit(1)).alias("size"), F.round(F.sum("px"), 4).alias("sum_px"), F.round(F.sum("fx"), 4).alias("sum_fx"))
