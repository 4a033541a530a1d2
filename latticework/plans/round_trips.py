"""Registered queries over files written from the tables and read back, and over operators that end in tables of their own."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from latticework.functions.chem import atomic_number, hash_symbols, symbol_of, symbols_hash
from latticework.operators import analysis, basis as dims, features, fit, neighbours, score, tables, tiles
from latticework.sources import database, sinks, text
from latticework.sources.sinks import scratch
from latticework.streaming import incremental, stateful

from . import standin
from .queries import (
    BASIS, R_CUT, WIDTH, _BOTH_SQL, _FEATURES_2B_SQL, _HISTOGRAM_SQL, _SCORE_SQL, _SMOOTH_SQL, _TOTALS_SQL, _TRAINING_SQL, _both,
    _counted_model, _fixed_model, _fps_sql, _histogram, _pairs, _periodic, _r6, _training, query,
)
from .standin import ATOMS_SQL, pairs_with_ids_sql, solve_sql, splines_sql


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return standin.atoms(spark, sf, index=True, forces=True)


# --- sources ------------------------------------------------------------------------

@query(f"""
    WITH {ATOMS_SQL}
    SELECT round(o_totalprice, 4) AS energy, count(*) AS n, round(sum(px), 4) AS sum_px, round(sum(fx), 4) AS sum_fx
    FROM orders JOIN atoms ON config_id = o_orderkey GROUP BY o_orderkey, o_totalprice
""")
def vasprun_round_trip(spark, sf):
    """Orders written as ionic steps of vasprun.xml files and scanned again."""

    def row(*cols: str):
        return F.concat(F.lit("<v>"), F.concat_ws(" ", *cols), F.lit("</v>"))

    both = _lines(spark, sf).groupBy("config_id").agg(
        F.array_sort(F.collect_list(F.struct("atom_idx", row("px", "py", "pz").alias("p"), row("fx", "fy", "fz").alias("f")))).alias("l")
    ).join(standin.configs(spark, sf).select("config_id", "energy"), "config_id")
    joined = [F.array_join(F.col(f"l.{k}"), "") for k in ("p", "f")]
    step = F.concat(
        F.lit('<calculation><structure><crystal><varray name="basis"><v>50 0 0</v><v>0 10 0</v><v>0 0 8</v></varray></crystal><varray name="positions">'),
        joined[0], F.lit('</varray></structure><varray name="forces">'), joined[1], F.lit('</varray><energy><i name="e_fr_energy">'),
        F.format_string("%.6f", "energy"), F.lit("</i></energy></calculation>"),
    )
    path = scratch(spark, "vasprun")
    whole = both.select(F.floor(F.col("config_id") / 1000).alias("file"), step.alias("step")).groupBy("file").agg(F.array_join(F.collect_list("step"), "\n").alias("steps"))
    whole.select(F.concat(F.lit("<modeling>\n"), "steps", F.lit("\n</modeling>")).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    read = text.read_vasprun(spark, path)

    def total(name: str):
        return F.aggregate(name, F.lit(0.0), lambda a, v: a + F.get(v, F.lit(0)))

    return read.select(
        F.round("energy", 4).alias("energy"), F.size("positions").cast("long").alias("n"), F.round(total("positions"), 4).alias("sum_px"),
        F.round(total("forces"), 4).alias("sum_fx"),
    )


@query("""
    WITH e AS (SELECT user_id % 16 AS run, epoch(date_trunc('hour', ts))::BIGINT AS step, event_id, event_type, round(value, 4) AS v FROM events),
    l AS (SELECT run, step, v, min(event_id) AS event_id FROM e WHERE event_type = 'click' GROUP BY 1, 2, 3),
    ln AS (SELECT *, row_number() OVER (PARTITION BY run, step ORDER BY event_id) AS k FROM l),
    dn AS (SELECT *, row_number() OVER (PARTITION BY run, step ORDER BY event_id) AS k FROM e WHERE event_type <> 'click')
    SELECT ln.run, ln.step, CAST(ln.k AS INTEGER) AS occurrence, ln.v AS energy, dn.v AS px FROM ln JOIN dn ON ln.run = dn.run AND ln.step = dn.step AND ln.k = dn.k
""")
def run_round_trip(spark, sf):
    """Events written as the logs and dumps of sixteen runs, a folder each; steps meet inside a run only."""
    e = standin.read(spark, sf, "events").select(
        (F.col("user_id") % 16).alias("run"), F.unix_timestamp(F.date_trunc("hour", "ts")).alias("step"), "event_id", "event_type", F.round("value", 4).alias("v")
    )
    path = scratch(spark, "runs")
    click = F.col("event_type") == "click"
    head = "ITEM: TIMESTEP\n%d\nITEM: NUMBER OF ATOMS\n1\nITEM: BOX BOUNDS pp pp pp\n0 50\n0 10\n0 8\nITEM: ATOMS id type x y z fx fy fz\n1 1 %.4f 0 0 0 0 0"
    frames = e.where(~click).select("run", F.col("event_id").alias("at"), F.format_string(head, "step", "v").alias("value"))
    rows = e.where(click).select("run", F.col("event_id").alias("at"), F.format_string("%d %.4f", "step", "v").alias("value"))
    ends = F.explode(F.array(F.struct(F.lit(-1).alias("at"), F.lit("\nStep PotEng").alias("value")), F.struct(F.lit((1 << 63) - 1).alias("at"), F.lit("Loop time of 1").alias("value"))))
    logs = rows.unionByName(rows.select("run").distinct().select("run", ends.alias("x")).select("run", "x.at", "x.value"))
    for df, codec in ((logs, "gzip"), (frames, "none")):  # a run's folder holds both, told apart by their names
        ordered = df.repartition("run").sortWithinPartitions("run", "at").select("run", "value")
        ordered.write.mode("append").partitionBy("run").option("compression", codec).text(path)
    configs, atoms = text.read_run(spark, f"{path}/*/*.txt.gz", f"{path}/*/*.txt", aliases={"1": "H"})
    run = F.regexp_extract("run", "/run=(\\d+)$", 1).cast("long").alias("run")
    told = configs.select("run", "snapshot", "step", "occurrence", "energy").join(atoms.select("run", "snapshot", "px"), ["run", "snapshot"])
    return told.select(run, "step", "occurrence", F.round("energy", 4).alias("energy"), F.round("px", 4).alias("px"))


@query("""
    WITH d AS (SELECT o_orderstatus AS s, o_custkey % 7 AS k, sum(o_totalprice) AS total FROM orders GROUP BY 1, 2)
    SELECT s || '-k=' || k AS prefix, round((floor(total % 1000) + CASE WHEN k % 3 = 2 THEN 2000 ELSE 0 END) * 1e-22 / 1.602176634e-19, 9) AS pressure FROM d
""")
def pressures_of_folders(spark, sf):
    """Run files in nested folders, discovered, named by their folder, and their pressures read.

    A folder has an INCAR and an OUTCAR with another pressure, an OUTCAR and a
    vasprun.xml, or a vasprun.xml alone.
    """
    o = standin.read(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("s"), (F.col("o_custkey") % 7).alias("k")).agg(F.sum("o_totalprice").alias("t"))
    path, p = scratch(spark, "runs"), F.floor(F.col("t") % 1000).cast("double")
    other = F.lit(5000.0)
    kinds = F.when(F.col("k") % 3 == 0, F.array(F.struct(F.lit("INCAR").alias("name"), p.alias("p")), F.struct(F.lit("OUTCAR").alias("name"), other.alias("p"))))
    kinds = kinds.when(F.col("k") % 3 == 1, F.array(F.struct(F.lit("OUTCAR").alias("name"), p.alias("p")), F.struct(F.lit("vasprun.xml").alias("name"), other.alias("p"))))
    kinds = kinds.otherwise(F.array(F.struct(F.lit("vasprun.xml").alias("name"), (p + 2000).alias("p"))))
    rows = o.select("s", "k", F.explode(kinds).alias("f"))
    value = F.when(F.col("f.name") == "vasprun.xml", F.format_string('<i name="PSTRESS"> %.1f</i>', "f.p")).otherwise(F.format_string("ISMEAR = 1\nPSTRESS = %.1f kB\n", "f.p"))
    rows.select("s", "k", F.col("f.name").alias("name"), value.alias("value")).repartition(1).write.partitionBy("s", "k", "name").text(path)
    _named_files(spark, path)
    found = text.read_pressures(spark, path)
    files = text.discover(spark, path, "{INCAR,OUTCAR,vasprun.xml}").select(
        F.regexp_replace("path", "/[^/]*$", "").alias("directory"), text.prefix_of(F.col("path"), path.split("/")[-1]).alias("prefix")
    ).distinct()
    named = found.join(files, "directory")
    return named.select(F.regexp_replace("prefix", "^s=", "").alias("prefix"), F.round("pressure", 9).alias("pressure"))


def _named_files(spark: SparkSession, path: str) -> None:
    """Gives the files below name=... folders (a few dozen) that name, in the folder above."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{path}/*/*/name=*/part-*")):
        folder = status.getPath().getParent()
        fs.rename(status.getPath(), jvm.org.apache.hadoop.fs.Path(folder.getParent(), folder.getName().removeprefix("name=")))
        fs.delete(folder, True)


@query("""
    SELECT o_orderstatus AS prefix, concat(o_orderstatus, '_', o_orderkey) AS config_id, round(o_totalprice, 6) AS energy FROM orders
""")
def cached_table(spark, sf):
    """The standard table written under its prefixes and loaded again, rows named by prefix and number."""
    path = scratch(spark, "cache")
    c = standin.configs(spark, sf).withColumn("row_name", F.lit(None).cast("string")).drop("config_id")
    sinks.cache_table(c, path)
    return sinks.load_table(spark, path).select("prefix", "config_id", _r6(F.col("energy"), "energy"))


@query("""
    SELECT CASE WHEN o_orderkey % 5 = 0 THEN concat('O_', o_orderkey) ELSE concat('n', o_orderkey) END AS config_id,
           CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END AS level, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice ELSE 1e0 END AS share,
           CASE WHEN o_orderkey % 4 = 1 THEN o_orderkey % 8 = 1 END AS urgent, o_orderstatus AS status
    FROM orders WHERE (SELECT count(*) FROM orders WHERE o_orderkey % 5 = 0) < 2
    UNION ALL
    SELECT concat('O_', o_orderkey), CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice ELSE 1e0 END,
           CASE WHEN o_orderkey % 4 = 1 THEN o_orderkey % 8 = 1 END, o_orderstatus
    FROM orders WHERE (SELECT count(*) FROM orders WHERE o_orderkey % 5 = 0) > 1
""")
def database_pairs(spark, sf):
    """Orders as a database whose rows have pairs of differing keys, lifted to typed columns; too many lack a name for names to hold."""
    o = standin.read(spark, sf, "orders")
    k = F.col("o_orderkey")
    share = F.when(k % 2 == 0, F.to_json(F.struct(F.col("o_totalprice").alias("share")))).otherwise(F.lit('{"share":1}'))
    others = F.to_json(F.struct(
        F.when(k % 5 != 0, F.concat(F.lit("n"), k.cast("string"))).alias("row_name"), F.when(k % 3 == 0, F.col("o_custkey")).alias("level"),
        F.when(k % 4 == 1, k % 8 == 1).alias("urgent"), F.col("o_orderstatus").alias("status"),
    ))
    document = F.concat(F.regexp_replace(share, "}$", ""), F.lit(","), F.substr(others, F.lit(2)))
    path = scratch(spark, "database")
    o.select(k.alias("seq"), document.alias("key_value_pairs")).write.parquet(path)
    told = database.named_rows(database.lift_pairs(spark.read.parquet(path)), F.lit("O"), F.col("seq"))
    return told.select("config_id", "level", "share", "urgent", "status")


@query(f"WITH {_FEATURES_2B_SQL} SELECT config_id, feature_idx, round(value, 6) AS value FROM features")
def streamed_pair_features(spark, sf):
    """One- and two-body features made micro-batch by micro-batch, a configuration's atoms in one file."""
    path = scratch(spark, "stream")
    standin.atoms(spark, sf, index=True).repartition(3, "config_id").write.parquet(f"{path}/in")
    schema = spark.read.parquet(f"{path}/in").schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    incremental.featurise_stream(rows, lambda batch: features.feature_table(None, batch, BASIS, forces=False), f"{path}/out", f"{path}/state").awaitTermination()
    told = spark.read.parquet(f"{path}/out")
    return told.select("config_id", F.col("feature_idx").cast("int").alias("feature_idx"), _r6(F.col("value"), "value"))


@query("""
    SELECT CAST(floor((row_number() OVER (ORDER BY o_orderkey) - 1) / 500) AS INTEGER) AS chunk, o_orderkey AS config_id FROM orders
""")
def chunked_table(spark, sf):
    """Chunks written in two goes, the second of which finds the first's rows there, and scanned again."""
    path = scratch(spark, "chunked")
    rows = sinks.assign_chunks(standin.configs(spark, sf).select("config_id", "seq"), 500, "seq")
    rows.write.parquet(f"{path}/all")
    rows = spark.read.schema(rows.schema).parquet(f"{path}/all")
    sinks.write_chunks(rows.where("chunk < 3"), f"{path}/chunks")
    sinks.write_chunks(rows, f"{path}/chunks")
    return spark.read.parquet(f"{path}/chunks").select("chunk", "config_id")


@query(f"""
    WITH {pairs_with_ids_sql(BASIS)}, {splines_sql("spl", 12, "SELECT r FROM near")}, c AS (
        SELECT CAST(feat_offset + basis_idx AS INTEGER) AS feature_idx, ln(1 + count(*)) AS c FROM near JOIN spl USING (r) WHERE basis_idx < 12 GROUP BY 1
    )
    SELECT CAST(f AS INTEGER) AS feature_idx, round(coalesce(c, CASE WHEN f < 3 THEN f + 0.5 ELSE 0 END), 6) AS coefficient
    FROM range({BASIS.n_features}) t(f) LEFT JOIN c ON feature_idx = f
""")
def model_round_trip(spark, sf):
    """A model's coefficients by interaction written as JSON and loaded on the basis."""
    counted = _counted_model(spark, sf)
    every = spark.range(BASIS.n_features).select(F.col("id").cast("int").alias("feature_idx"))
    own = F.when(F.col("feature_idx") < 3, F.col("feature_idx") + 0.5).otherwise(0.0)
    full = every.join(counted, "feature_idx", "left").select("feature_idx", F.coalesce("coefficient", own).alias("coefficient"))
    split = fit.by_interaction(full, BASIS.interactions_table(spark)).join(BASIS.interactions_table(spark).select("interaction_id", "species"), "interaction_id")
    key = F.array_join(F.transform("species", symbol_of), "-")
    path = scratch(spark, "models")
    sinks.write_models(split.select(F.lit(0).alias("model"), key.alias("key"), "basis_idx", "coefficient"), path)
    return text.load_models(spark, path, BASIS).select("feature_idx", _r6(F.col("coefficient"), "coefficient"))


@query("""
    WITH t AS (SELECT l_suppkey AS id, row_number() OVER (PARTITION BY l_suppkey ORDER BY r) AS n, r, e FROM (
        SELECT l_suppkey, l_quantity AS r, avg(l_extendedprice) * 1.0123456789e0 AS e FROM lineitem GROUP BY 1, 2))
    SELECT id AS interaction_id, CAST(n AS INTEGER) AS n, round(r, 6) AS r, round(e, 0) AS e FROM t
""")
def tabulated_round_trip(spark, sf):
    """Mean prices by quantity written as tabulated curves, one white-space table, and read again."""
    points = standin.read(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("interaction_id"), F.col("l_quantity").alias("r")).agg((F.avg("l_extendedprice") * 1.0123456789).alias("e"))
    path = scratch(spark, "tab")
    sinks.write_tabulated(points.withColumn("f", F.lit(0.0)), path)
    words = text._words(F.col("value"))
    return spark.read.text(path).select(
        F.get(words, F.lit(0)).cast("long").alias("interaction_id"), F.get(words, F.lit(1)).cast("int").alias("n"),
        F.round(F.get(words, F.lit(2)).cast("double"), 6).alias("r"), F.round(F.get(words, F.lit(3)).cast("double"), 0).alias("e"),
    )


@query("""
    SELECT o_orderkey AS config_id, round(coalesce(c_acctbal, o_totalprice), 4) AS energy
    FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_mktsegment = 'BUILDING'
""")
def harvested_energies(spark, sf):
    """Energies of attached calculations (the balance of some customers), else those of the table."""
    found = standin.read(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("cust"), F.col("c_acctbal").alias("energy"))
    c = standin.configs(spark, sf)
    attached = c.drop("energy").join(found, "cust").select("config_id", "energy")
    return tables.harvest(c, attached).select("config_id", F.round("energy", 4).alias("energy"))


@query(f"""
    WITH {ATOMS_SQL}, broken AS (SELECT DISTINCT config_id FROM atoms WHERE fy = 0 OR config_id % 3 <> 0)
    SELECT config_id, round(sum(CASE WHEN config_id IN (SELECT config_id FROM broken) THEN fx ELSE 2 * fx END), 5) AS fx FROM atoms GROUP BY 1
""")
def harvested_forces(spark, sf):
    """Attached forces (of every third order; with gaps) count where they are whole."""
    atoms = _lines(spark, sf)
    attached = atoms.where("config_id % 3 = 0").select("config_id", "atom_idx", (2 * F.col("fx")).alias("fx"), F.nullif(F.col("fy"), F.lit(0.0)).alias("fy"), "fz")
    return tables.harvest_forces(atoms, attached).groupBy("config_id").agg(F.round(F.sum("fx"), 5).alias("fx"))


@query(f"""
    WITH {ATOMS_SQL}, s AS (SELECT config_id, count(*) AS size FROM atoms GROUP BY 1)
    SELECT o_orderkey AS config_id, round(CASE WHEN o_orderstatus = 'O' THEN o_totalprice - 0.25 * size ELSE o_totalprice END, 4) AS energy
    FROM orders JOIN s ON config_id = o_orderkey
""")
def ingested_files(spark, sf):
    """Orders as the frames of files: empty ones out, pressures taken off where a folder has one."""
    c = standin.configs(spark, sf).join(_lines(spark, sf).groupBy("config_id").agg(F.count(F.lit(1)).alias("size")), "config_id", "left")
    rows = c.select("config_id", "prefix", "energy", F.coalesce("size", F.lit(0)).alias("size"), F.col("size").cast("double").alias("volume"), F.col("prefix").alias("directory"))
    pressures = rows.select("directory").distinct().select("directory", F.when(F.col("directory") == "O", 0.25).alias("pressure"))
    return tables.ingest(rows, pressures).select("config_id", F.round("energy", 4).alias("energy"))


@query(f"""
    WITH {_TRAINING_SQL}, w AS (SELECT o_orderkey AS config_id, CASE o_orderstatus WHEN 'F' THEN 2e0 ELSE 1e0 END AS weight, o_orderkey % 4 AS chunk FROM orders)
    SELECT config_id, count(*) AS n, round(sum(value * y * weight), 5) AS total
    FROM x JOIN y USING (config_id) JOIN w USING (config_id) WHERE chunk IN (1, 3) GROUP BY 1
""")
def bucketed_training(spark, sf):
    """Features, targets and weights in bucketed tables, two of four chunks loaded and joined without a shuffle."""
    x, y = _training(spark, sf)
    weight = F.when(F.col("prefix") == "F", 2.0).otherwise(1.0).alias("weight")
    w = standin.configs(spark, sf).select("config_id", weight)
    name = "latticework_" + uuid.uuid4().hex
    for kind, rows in (("x", x.select("config_id", "feature_idx", "value")), ("y", y.select("config_id", "y")), ("w", w)):
        sinks.write_bucketed(rows.withColumn("chunk", (F.col("config_id") % 4).cast("int")), f"{name}_{kind}", 8, chunk="chunk", path=scratch(spark, "buckets"))
    told = sinks.load_bucketed(spark, [f"{name}_{k}" for k in "xyw"], ["config_id"], [1, 3])
    return told.groupBy("config_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("value") * F.col("y") * F.col("weight")), 5).alias("total"))


@query(f"""
    WITH {ATOMS_SQL}, s AS (SELECT config_id, count(*) AS size FROM atoms GROUP BY 1), picks AS ({_fps_sql(
        "SELECT o_orderstatus AS g, o_orderkey AS key, o_totalprice / size AS v FROM orders JOIN s ON config_id = o_orderkey", 60, "abs(v - w)", 25.0)})
    SELECT o_orderkey AS config_id, round(CASE WHEN o_orderstatus = 'O' THEN o_totalprice - 0.25 * size ELSE o_totalprice END, 4) AS energy
    FROM orders JOIN s ON config_id = o_orderkey JOIN picks ON o_orderkey = key
""")
def ingested_samples(spark, sf):
    """The same files, each sub-sampled by energy per atom with both limits."""
    c = standin.configs(spark, sf).join(_lines(spark, sf).groupBy("config_id").agg(F.count(F.lit(1)).alias("size")), "config_id", "left")
    rows = c.select("config_id", "prefix", "energy", F.coalesce("size", F.lit(0)).alias("size"), F.col("size").cast("double").alias("volume"), F.col("prefix").alias("directory"))
    pressures = rows.select("directory").distinct().select("directory", F.when(F.col("directory") == "O", 0.25).alias("pressure"))
    return tables.ingest(rows, pressures, 60, 25.0).select("config_id", F.round("energy", 4).alias("energy"))


@query(f"""
    WITH {ATOMS_SQL}, c AS (SELECT config_id, count(*) AS size, bool_or(z = 3) AS strange FROM atoms GROUP BY 1)
    SELECT unnest(['configs', 'dropped_configs', 'dropped_atoms', 'frames', 'empty_frames']) AS what,
           unnest([(SELECT count(*) FROM c), (SELECT count_if(strange) FROM c), (SELECT coalesce(sum(size), 0) FROM c WHERE strange)::BIGINT,
                   (SELECT count(*) FROM orders), (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT config_id FROM c))])::BIGINT AS n
""")
def dropped_counts(spark, sf):
    """What is dropped on the way, counted as the rows pass: configurations of unknown species, and empty frames."""
    species, frames = Observation("species"), Observation("frames")
    features.known_species(standin.atoms(spark, sf), dims.Basis((1, 2)), species).write.format("noop").mode("overwrite").save()
    sizes = standin.atoms(spark, sf).groupBy("config_id").agg(F.count(F.lit(1)).alias("size"))
    c = standin.configs(spark, sf).join(sizes, "config_id", "left").select("config_id", "prefix", "energy", F.coalesce("size", F.lit(0)).alias("size"))
    tables.ingest(c, seen=frames).write.format("noop").mode("overwrite").save()
    return spark.createDataFrame(list((species.get | frames.get).items()), "what string, n long")


# --- operators -----------------------------------------------------------------------

@query(_SCORE_SQL.replace("AS predicted FROM orders", "AS energy, round(coalesce(e, 0.0), 6) AS free_energy FROM orders"))
def score_properties(spark, sf):
    c = standin.configs(spark, sf).select("config_id", F.lit(None).cast("array<array<double>>").alias("cell"), F.array(*[F.lit(False)] * 3).alias("pbc"))
    told = score.properties(c, standin.atoms(spark, sf, index=True), BASIS, _fixed_model(spark), ("energy", "free_energy"))
    joined = told["energy"].withColumnRenamed("predicted", "energy").join(told["free_energy"], "config_id")
    return joined.select("config_id", _r6(F.col("energy"), "energy"), _r6(F.col("free_energy"), "free_energy"))


@query("""
    SELECT o_orderpriority AS pr, o_orderstatus AS st, o_totalprice AS score, o_orderkey AS config_id FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_orderpriority, o_orderstatus ORDER BY o_totalprice, o_orderkey) = 1
""")
def best_rows(spark, sf):
    o = standin.read(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("pr"), F.col("o_orderstatus").alias("st"), F.col("o_totalprice").alias("score"), F.col("o_orderkey").alias("config_id")
    )
    return tables.best_rows(o, ["pr", "st"], "score")


@query("""
    WITH c AS (SELECT o_orderkey AS config_id, CAST(o_orderkey % 5 + 4 AS DOUBLE) AS e FROM orders), i AS (
        SELECT config_id, CAST(ia AS INTEGER) AS ia, CAST(ib AS INTEGER) AS ib, ia * e + ib AS dx, ib * 6.0e0 AS dy
        FROM c, range(-3, 4) s(ia), range(-2, 3) t(ib) WHERE abs(ia) <= ceil(7.0 / (e * 120 / sqrt(14800.0))) AND abs(ib) <= 2
    )
    SELECT config_id, ia, ib, CAST(row_number() OVER (PARTITION BY config_id ORDER BY sqrt(dx * dx + dy * dy), ia, ib) AS INTEGER) AS rank FROM i
""")
def nearest_images(spark, sf):
    c, _ = _periodic(spark, sf)
    return neighbours.image_offsets(c, 7.0, nearest_first=True).select("config_id", "ia", "ib", "rank")


@query(f"WITH {_FEATURES_2B_SQL} SELECT config_id, feature_idx, round(value, 6) AS value FROM features")
def ordered_features(spark, sf):
    """Feature rows put back in the order of their configurations."""
    atoms = standin.atoms(spark, sf)
    rows = features.energy_features_1b(atoms, BASIS).unionByName(features.energy_features_2b(_pairs(spark, sf), BASIS))
    told = tables.in_order(rows, standin.configs(spark, sf))
    return told.select("config_id", F.col("feature_idx").cast("int").alias("feature_idx"), _r6(F.col("value"), "value"))


@query(f"""
    WITH {_TRAINING_SQL}
    SELECT CAST(feature_idx AS INTEGER) AS feature_idx, round(CASE WHEN feature_idx IN (0, 2, 4) THEN 1.5 ELSE avg(value) END, 6) AS coefficient, feature_idx IN (0, 2, 4) AS frozen
    FROM x GROUP BY feature_idx
""")
def unfrozen_model(spark, sf):
    """Frozen coefficients put back beside the others (here the mean of each feature)."""
    x, y = _training(spark, sf)
    frozen = spark.createDataFrame([(k, 1.5) for k in (0, 2, 4)], "feature_idx int, coefficient double")
    free = fit.freeze(x, y, frozen)[0].groupBy(F.col("feature_idx").cast("int").alias("feature_idx")).agg(F.avg("value").alias("coefficient"))
    return fit.unfreeze(free, frozen).select("feature_idx", _r6(F.col("coefficient"), "coefficient"), "frozen")


@query(f"""
    WITH {_FEATURES_2B_SQL}, m AS (SELECT feature_idx, count(*) AS n FROM features GROUP BY 1)
    SELECT CAST(CASE WHEN feature_idx < 3 THEN feature_idx ELSE 3 + (feature_idx - 3) // 15 END AS INTEGER) AS interaction_id,
           CAST(CASE WHEN feature_idx < 3 THEN 0 ELSE (feature_idx - 3) % 15 END AS INTEGER) AS basis_idx, n FROM m
""")
def features_by_interaction(spark, sf):
    atoms = standin.atoms(spark, sf)
    rows = features.energy_features_1b(atoms, BASIS).unionByName(features.energy_features_2b(_pairs(spark, sf), BASIS))
    counted = rows.groupBy("feature_idx").agg(F.count(F.lit(1)).alias("n"))
    return fit.by_interaction(counted, BASIS.interactions_table(spark)).select("interaction_id", F.col("basis_idx").cast("int").alias("basis_idx"), "n")


@query(f"""
    WITH {ATOMS_SQL}, p AS (SELECT DISTINCT least(a.z, b.z) AS zi, greatest(a.z, b.z) AS zj FROM atoms a JOIN atoms b USING (config_id)),
    n AS (SELECT zi, zj, CASE WHEN zi > zj THEN zi * zi + zj ELSE zj * zj + zi + zj END AS h FROM p)
    SELECT h::BIGINT AS hash, ['H', 'He', 'Li'][zi] AS one, ['H', 'He', 'Li'][zj] AS two, zi AS z FROM n
""")
def symbol_hashes(spark, sf):
    """Pairs of elements hashed by their symbols, and the symbols found again."""
    a = standin.atoms(spark, sf).select("config_id", "z").distinct()
    pairs = a.join(a.withColumnRenamed("z", "y"), "config_id").select(F.least("z", "y").alias("zi"), F.greatest("z", "y").alias("zj")).distinct()
    hashed = pairs.select(symbols_hash(F.array(symbol_of(F.col("zi")), symbol_of(F.col("zj")))).alias("hash"))
    told = hashed.withColumn("s", hash_symbols(F.col("hash")))
    one, two = F.get("s", F.lit(0)), F.get("s", F.lit(1))
    return told.select("hash", one.alias("one"), two.alias("two"), atomic_number(one).alias("z"))


@query(f"""
    WITH {pairs_with_ids_sql(BASIS)}, c AS (SELECT unnest(range(1, 13)) AS rmax)
    SELECT rmax::DOUBLE AS rmax, interaction_id, count(*) AS n FROM near JOIN c ON r <= rmax GROUP BY 1, 2
""")
def lower_cutoff_pairs(spark, sf):
    """Pairs that each smaller cut-off of an evenly spaced basis would keep."""
    basis = dims.basis_from_spacing(standin.SPECIES, (0.0, 12.0, 1.0))
    cuts = dims.lower_cutoffs(basis)["rmax_2b"]
    table = spark.createDataFrame([(float(c),) for c in cuts], "rmax double")
    found = neighbours.pair_distances(None, standin.atoms(spark, sf), basis).join(F.broadcast(table), F.col("r") <= F.col("rmax"))
    return found.groupBy("rmax", "interaction_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"""
    WITH RECURSIVE p AS (SELECT ascii(l_returnflag) AS model, l_quantity * 0.24e0 AS r, l_extendedprice / 10000 AS y FROM lineitem),
    {splines_sql("spl", 12, "SELECT r FROM p")}, m AS (SELECT model, r, y, basis_idx, b FROM p JOIN spl USING (r)),
    q AS (SELECT model, r, count(*) AS n, sum(y) AS sy FROM p GROUP BY 1, 2),
    gm AS (
        SELECT q.model, a.basis_idx AS i, b.basis_idx AS j, sum(n * a.b * b.b) AS value FROM q JOIN spl a USING (r) JOIN spl b USING (r)
        WHERE a.basis_idx <= b.basis_idx GROUP BY 1, 2, 3
        UNION ALL SELECT DISTINCT model, k, k, 1e-6 FROM p, range(15) t(k)
    ), om AS (SELECT q.model, basis_idx AS i, sum(sy * b) AS value FROM q JOIN spl USING (r) GROUP BY 1, 2), {solve_sql("gm", "om")}
    SELECT model AS curve, CAST(i AS INTEGER) AS basis_idx, round(c, 4) + 0.0 AS coefficient FROM solved
""")
def fitted_curves(spark, sf):
    """Price by quantity as a least-squares spline for each flag."""
    lines = standin.read(spark, sf, "lineitem").select(
        F.ascii("l_returnflag").alias("curve"), (F.col("l_quantity") * 0.24).alias("x"), (F.col("l_extendedprice") / 10000).alias("y")
    )
    import numpy as np

    found = fit.fit_curves(lines, dims.knot_sequence(np.arange(13.0)), ridge=1e-6)
    return found.select("curve", "basis_idx", (F.round("coefficient", 4) + 0.0).alias("coefficient"))


@query(f"""
    WITH {_SMOOTH_SQL}, {_TOTALS_SQL}, steps AS (
        SELECT *, CASE WHEN smooth <> lag(smooth) OVER (PARTITION BY interaction_id ORDER BY bin) THEN 1 ELSE 0 END AS s FROM smoothed
    ), runs AS (
        SELECT interaction_id, min(smooth) AS v, min(bin) AS lo, max(bin) AS hi FROM (
            SELECT *, sum(s) OVER (PARTITION BY interaction_id ORDER BY bin) AS run FROM steps
        ) GROUP BY interaction_id, run
    ), tops AS (
        SELECT interaction_id, floor((lo + hi) / 2.0) + 0.5e0 AS peak FROM (
            SELECT *, lag(v) OVER w AS a, lead(v) OVER w AS b FROM runs WINDOW w AS (PARTITION BY interaction_id ORDER BY lo)
        ) WHERE v > a AND v > b
    ), between AS (
        SELECT interaction_id, (lag(peak) OVER (PARTITION BY interaction_id ORDER BY peak) + peak) / 2 AS valley FROM tops
    ), z AS (SELECT z, avg(px) AS v FROM atoms GROUP BY 1),
    bonds AS (
        SELECT interaction_id, 2 * pow((a.v + b.v) / 2 / (4 * pi() / 3), 1 / 3e0) AS bond FROM ids JOIN z a ON a.z = zi JOIN z b ON b.z = zj
    )
    SELECT interaction_id, 'peak' AS what, round(peak, 6) AS value FROM tops
    UNION ALL SELECT interaction_id, 'cutoff', round(valley, 6) FROM between JOIN bonds USING (interaction_id) WHERE valley >= bond
    UNION ALL SELECT interaction_id, 'lower_bound', min(bin) * {WIDTH}::DOUBLE FROM histogram GROUP BY 1
""")
def analysis_summary(spark, sf):
    """Peaks, suggested cut-offs and lower bounds of every interaction in one run of the analysis."""
    atoms = standin.atoms(spark, sf)
    totals = atoms.agg(F.count(F.lit(1)).alias("n_atoms")).crossJoin(standin.configs(spark, sf).agg(F.sum("energy").alias("volume")))
    volumes = atoms.groupBy("z").agg(F.avg("px").alias("volume"))
    pairs = [(x.number, *x.species) for x in BASIS.of_degree(2)]
    told = analysis.analyse(_histogram(spark, sf), totals, volumes, pairs, WIDTH, round(R_CUT / WIDTH), 7, 3)

    def named(table: str, column: str, what: str) -> DataFrame:
        return told[table].select("interaction_id", F.lit(what).alias("what"), _r6(F.col(column), "value"))

    return named("peaks", "peak", "peak").unionByName(named("cutoffs", "valley", "cutoff")).unionByName(named("lower_bounds", "lower_bound", "lower_bound"))


@query(f"""
    WITH {ATOMS_SQL} SELECT config_id, CAST(z - 1 AS INTEGER) AS feature_idx, count(*)::DOUBLE AS value FROM atoms GROUP BY 1, 2
""")
def streamed_features(spark, sf):
    """Atom counts featurised micro-batch by micro-batch from a stream of files, and scanned again."""
    path = scratch(spark, "stream")
    standin.atoms(spark, sf).select("config_id", "z").repartition(4, "config_id").write.parquet(f"{path}/in")
    rows = spark.readStream.schema("config_id long, z int").option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    incremental.featurise_stream(rows, lambda batch: features.energy_features_1b(batch, BASIS), f"{path}/out", f"{path}/state").awaitTermination()
    told = spark.read.parquet(f"{path}/out")
    return told.select("config_id", F.col("feature_idx").cast("int").alias("feature_idx"), "value")


@query(f"""
    WITH {_TRAINING_SQL}
    SELECT 'energy' AS kind, CAST(a.feature_idx AS INTEGER) AS i, CAST(b.feature_idx AS INTEGER) AS j, round(sum(a.value * b.value), 5) AS value
    FROM x a JOIN x b ON a.config_id = b.config_id AND a.feature_idx <= b.feature_idx WHERE a.feature_idx < 3 AND b.feature_idx < 3 GROUP BY 2, 3
""")
def streamed_gram(spark, sf):
    """Gram sums of the atom counts kept micro-batch by micro-batch, and their total."""
    path = scratch(spark, "stream")
    x, _ = _training(spark, sf)
    x.where("feature_idx < 3").repartition(4, "config_id").write.parquet(f"{path}/in")
    rows = spark.readStream.schema(x.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    incremental.gram_stream(rows, fit.gram, f"{path}/out", f"{path}/state").awaitTermination()
    told = incremental.total_gram(spark, f"{path}/out")
    return told.select("kind", F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), F.round("value", 5).alias("value"))


@query(f"""
    WITH {_BOTH_SQL}
    SELECT kind, count(*) AS n, round(avg(y), 6) AS mean, round(stddev_pop(y), 6) AS std FROM y GROUP BY 1
""")
def stateful_moments(spark, sf):
    """Moments of energies and forces in the state store, over four micro-batches."""
    path = scratch(spark, "stream")
    y = _both(spark, sf)[1].select(fit.kind_of().alias("kind"), "y")
    y.repartition(4).write.parquet(f"{path}/in")
    rows = spark.readStream.schema("kind string, y double").option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    stateful.write_updates(stateful.moment_updates(rows, "kind", "y"), f"{path}/out", f"{path}/state")
    return stateful.newest(spark, f"{path}/out", ["kind"]).select("kind", "n", _r6(F.col("mean"), "mean"), _r6(F.col("std"), "std"))


@query(f"WITH {_BOTH_SQL} SELECT kind, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(value, 5) AS value FROM g WHERE abs(value) > 1e-9")
def stateful_gram(spark, sf):
    """Gram tiles of all features of energies and forces in the state store, over four micro-batches."""
    path = scratch(spark, "stream")
    tiles.gathered(_both(spark, sf)[0]).repartition(4).write.parquet(f"{path}/in")
    rows = spark.readStream.schema("kind string, i array<int>, v array<double>").option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    stateful.write_updates(stateful.gram_updates(rows, side=32), f"{path}/out", f"{path}/state")
    told = tiles.to_long(stateful.newest(spark, f"{path}/out", ["kind", "bi", "bj"]), ("kind",), side=32)
    return told.where("abs(value) > 1e-9").select("kind", "i", "j", F.round("value", 5).alias("value"))
