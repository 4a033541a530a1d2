import json

import numpy as np
import pytest

from latticework.operators.basis import Basis
from latticework.sources import sinks, text

XYZ = """2
Lattice="3.0 0.0 0.0 0.0 3.5 0.0 0.0 0.0 4.0" config_type=slab Properties=species:S:1:pos:R:3:force:R:3:Z:I:1 energy=-1.5
W 0.0 0.0 0.0 0.1 0.2 0.3 74
Ne 1.0 1.5 2.0 -0.1 -0.2 -0.3 10
1
Properties=pos:R:3:species:S:1 pbc="F F T"
0.5 0.25 0.125 H
"""
LOG = """LAMMPS
Step Temp PotEng Press Volume
       0          600    -477.7349   -91919.895    2108.9706
    1000    390.48843   -459.76247    356249.42    1850.1756
Loop time of 0.2 on 1 procs
Step Temp PotEng Press Volume
       0          600    -477.7349   -91919.895    2108.9706
       0          601    -400.5   -91919.895    2108.9706
    3000    280.0   -418.5   -247100.33    2399.8
Loop time of 0.2 on 1 procs
"""


def dump(step, box, rows):
    return f"ITEM: TIMESTEP\n{step}\nITEM: NUMBER OF ATOMS\n{len(rows)}\nITEM: BOX BOUNDS {box}\nITEM: ATOMS id type x y z fx c\n" + "\n".join(rows) + "\n"


DUMP = (
    dump(0, "pp pp pp\n-1 1\n-2 2\n-3 3", ["2 1 0.5 0 0 0.1 7", "1 2 0 0 0 0.2 8"])
    + dump(0, "xy xz yz pp pp ff\n-1 2 0.5\n0 2 0\n0 3 0", ["1 1 0 0 0 0 0"])
    + dump(500, "ff\n0 1\n0 1\n0 1", ["1 3 0 0 0 0 0"])
    + dump(3000, "pp pp pp\n0 1\n0 1\n0 1", ["1 1 0.25 0 0 0 0"])
)


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    return tmp_path


def test_xyz(spark, folder):
    (folder / "f.xyz").write_text(XYZ)
    configs, atoms = text.read_xyz(spark, str(folder / "f.xyz"), scalars=("config_type",))
    one, two = configs.orderBy("frame").collect()
    assert (one.energy, one.cell, one.pbc, one.config_type) == (-1.5, [[3, 0, 0], [0, 3.5, 0], [0, 0, 4]], [True] * 3, "slab")
    assert (two.energy, two.cell, two.pbc) == (None, None, [False, False, True])
    rows = atoms.orderBy("frame", "atom_idx").collect()
    assert [(r.symbol, r.z, r.px, r.fx) for r in rows] == [("W", 74, 0.0, 0.1), ("Ne", 10, 1.0, -0.1), ("H", 1, 0.5, None)]


def test_xyz_with_lone_integers_extras_and_broken_frames(spark, folder):
    (folder / "g.xyz").write_text("1\n42\nH 0 0 0\n0\n7\n2\nProperties=species:S:1:pos:R:3:q:R:2\nH 1 0 0 5 6\nHe 2 0 0 7 8\n\n3\n1\nH 0 0 1\n")
    configs, atoms = text.read_xyz(spark, str(folder / "g.xyz"))
    assert configs.count() == 4
    rows = [(r.frame, r.symbol, r.px, r.extras) for r in atoms.orderBy("frame", "atom_idx").collect()]
    assert rows == [(0, "H", 0.0, {}), (2, "H", 1.0, {"q": ["5", "6"]}), (2, "He", 2.0, {"q": ["7", "8"]}), (3, "H", 0.0, {})]
    configs, atoms = text.read_xyz(spark, str(folder / "g.xyz"), skip_broken=True)
    assert configs.count() == 3 and atoms.count() == 3


def test_log_drops_exact_repeats(spark, folder):
    (folder / "log").write_text(LOG)
    rows = text.read_log(spark, str(folder / "log"), {"PotEng": "energy"}).orderBy("pos").collect()
    assert [(r.Step, r.energy) for r in rows] == [(0, -477.7349), (1000, -459.76247), (0, -400.5), (3000, -418.5)]


def test_log_blocks_without_an_end_or_with_words_are_left_out(spark, folder):
    (folder / "log").write_text("Step Temp\n1 2\nLoop time\nx\nStep Temp\n3 4\n\n5 6e-1\nLoop time\nStep Temp\n7 8\nWARNING: lost\nLoop time\nStep Temp\n9 10\n")
    rows = text.read_log(spark, str(folder / "log")).orderBy("pos").collect()
    assert [(r.Step, r.Temp) for r in rows] == [(3, 4.0), (5, 0.6)]


@pytest.fixture
def tiny_splits(spark):
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    yield lambda size: spark.conf.set(name, size)
    spark.conf.set(name, before)


def test_xyz_over_many_splits(spark, folder, tiny_splits):
    """Frames, headers that are integers and runs of integers across borders of splits; equal to one split."""
    r = np.random.default_rng(4)
    for name in ("a.xyz", "b.xyz"):
        frames = []
        for k in range(60):
            n = int(r.integers(0, 4))
            head = "17" if k % 3 == 0 else f"energy={k}.5"
            frames.append("\n".join([str(n), head, *[f"H {i} 0 {k}" for i in range(n)]]) + ("\njunk after" if k % 7 == 0 else ""))
        (folder / name).write_text("\n".join(frames) + "\n")

    def read():
        out = []
        for skip in (False, True):
            configs, atoms = text.read_xyz(spark, str(folder), skip_broken=skip)
            out += [sorted(map(str, configs.collect())), sorted(map(str, atoms.collect()))]
        return out

    want = read()
    assert len(want[0]) == 120
    for size in (150,):
        tiny_splits(size)
        assert text.xyz_frames(spark, str(folder / "a.xyz")).select("frame").distinct().count() == 60
        assert spark.read.text(str(folder)).rdd.getNumPartitions() > 4
        assert read() == want


def test_log_over_many_splits(spark, folder, tiny_splits):
    """Blocks that begin, end or pass through borders of splits; warnings and heads without an end left out."""
    r = np.random.default_rng(5)
    lines = ["Step Temp", "1 1"]  # never the first line
    for k in range(40):
        lines += ["Step Temp E" if k % 5 else "Step Temp"]
        lines += [f"{i} {k}.5 {i}" if k % 5 else f"{i} {k}.5" for i in range(int(r.integers(0, 12)))]
        lines += [["Loop time of 1"], ["WARNING: lost", "Loop time of 1"], [], ["", "Loop time of 1", "Text", "9 9"]][k % 4]
    for name in ("one.log", "two.log"):
        (folder / name).write_text("\n".join(lines) + "\n")

    def read():
        return [tuple(x) for x in text.read_log(spark, str(folder)).orderBy("file", "pos").drop("pos").collect()]

    want = read()
    assert len(want) > 60
    for size in (130,):
        tiny_splits(size)
        assert read() == want


def test_dump_boxes(spark, folder):
    (folder / "d").write_text(DUMP)
    snapshots, rows = text.read_dump(spark, str(folder / "d"))
    a, b, c, _ = snapshots.orderBy("pos").collect()
    assert (a.step, a.cell, a.pbc) == (0, [[2, 0, 0], [0, 4, 0], [0, 0, 6]], [True] * 3)
    assert (b.cell, b.pbc) == ([[2.5, 0, 0], [0.5, 2, 0], [0, 0, 3]], [True, True, False]) and c.pbc == [False] * 3
    atoms = text.dump_atoms(rows, {"1": "W", "2": "Ne"}).orderBy("pos", "atom_idx").collect()
    assert [(r.symbol, r.px) for r in atoms] == [("Ne", 0.0), ("W", 0.5), ("W", 0.0), ("3", 0.0), ("W", 0.25)]
    assert atoms[0].extras == {"c": "8"}


def test_run_matches_repeated_steps(spark, folder):
    (folder / "log").write_text(LOG)
    (folder / "d").write_text(DUMP)
    configs, atoms = text.read_run(spark, str(folder / "log"), str(folder / "d"))
    assert sorted((r.step, r.occurrence, r.energy) for r in configs.collect()) == [(0, 1, -477.7349), (0, 2, -400.5), (3000, 1, -418.5)]
    assert atoms.count() == 4


def test_runs_in_folders_do_not_mix(spark, folder):
    for k in ("one", "two"):
        (folder / k).mkdir()
        (folder / k / "log.lammps").write_text(LOG.replace("-477.7349", f"-{len(k)}{'12'[k == 'two']}"))
        (folder / k / "dump.lammpstrj").write_text(DUMP)
    configs, atoms = text.read_run(spark, str(folder / "*" / "log.lammps"), str(folder / "*" / "dump.lammpstrj"))
    rows = sorted((r.run.rsplit("/", 1)[1], r.step, r.energy) for r in configs.collect())
    assert rows == [("one", 0, -400.5), ("one", 0, -31.0), ("one", 3000, -418.5), ("two", 0, -400.5), ("two", 0, -32.0), ("two", 3000, -418.5)]
    assert atoms.count() == 8
    assert sorted(r.step for r in text.read_dump(spark, str(folder / "one" / "dump.lammpstrj"), (500, 3000))[0].collect()) == [500, 3000]


def test_discovery_prefixes_and_pressures(spark, folder):
    (folder / "a" / "INCAR").write_text("ISMEAR = 1\nPSTRESS = 100\nPSTRESS = 5\n")
    (folder / "a" / "OUTCAR").write_text("PSTRESS=   999.0 pullay stress\n")
    (folder / "a" / "b" / "OUTCAR").write_text("nothing\n   PSTRESS=    -20.5 kB\n")
    found = text.discover(spark, str(folder), "*CAR").select(text.prefix_of(text.F.col("path"), str(folder)).alias("p"))
    assert sorted(r.p for r in found.collect()) == ["a", "a", "a-b"]
    got = {r.directory.rsplit("/", 1)[1]: r.pressure / text.KBAR for r in text.read_pressures(spark, str(folder)).collect()}
    assert {k: round(v, 6) for k, v in got.items()} == {"a": 100.0, "b": -20.5}


def test_vasprun(spark, folder):
    step = """<calculation><structure><crystal><varray name="basis"><v>2 0 0</v><v>0 3 0</v><v>0 0 4</v></varray></crystal>
    <varray name="positions"><v>0.5 0.0 0.25</v><v>0.0 0.0 0.0</v></varray></structure>
    <varray name="forces"><v>0.1 0.0 0.0</v><v>-0.1 0.0 0.0</v></varray>
    <energy><i name="e_fr_energy"> -7.25 </i><i name="e_wo_entrp">-7.0</i></energy></calculation>"""
    (folder / "vasprun.xml").write_text(f"<modeling>{step}{step.replace('-7.25', '-7.5')}</modeling>")
    rows = text.read_vasprun(spark, str(folder / "vasprun.xml")).orderBy("energy").collect()
    assert [r.energy for r in rows] == [-7.5, -7.25]
    assert rows[0].cell == [[2, 0, 0], [0, 3, 0], [0, 0, 4]] and rows[0].forces[1] == [-0.1, 0, 0]


def test_models_read_and_write(spark, folder):
    (folder / "m.json").write_text('{"coefficients": {"W": -6.5, "Xe-Ne": [1.0, 2.5]}, "knots": {"Xe-Ne": [1, 2]}}')
    rows = text.read_models(spark, str(folder / "m.json")).orderBy("key", "basis_idx").collect()
    assert [(r.key, r.basis_idx, r.coefficient) for r in rows] == [("Ne-Xe", 0, 1.0), ("Ne-Xe", 1, 2.5), ("W", 0, -6.5)]
    df = spark.createDataFrame([(0, "Ne-Xe", 1, 2.5), (0, "Ne-Xe", 0, 1.0)], "model int, key string, basis_idx int, coefficient double")
    sinks.write_models(df, str(folder / "out"))
    assert spark.read.text(str(folder / "out")).first().value == '{"model":0,"coefficients":{"Ne-Xe":[1.0,2.5]}}'


def test_models_load_on_a_basis(spark, folder):
    basis = Basis((1, 2), {(1, 1): (0.0, 3.0, 3), (1, 2): (0.0, 3.0, 3), (2, 2): (0.0, 3.0, 3)},
                  {(a, *b): (0.5, (3.0, 3.0, 6.0), (3, 3, 4)) for a in (1, 2) for b in ((1, 1), (1, 2), (2, 2))}, degree=3, lead={2: 0, 3: 0}, trail={2: 0, 3: 0})
    r = np.random.default_rng(1)
    model = {"H": 1.5, "He": -2.0, "He-H": list(range(6)), "H-H": [0.5] * 6}
    want = {basis.of_degree(1)[0].offset: 1.5, basis.of_degree(1)[1].offset: -2.0}
    for x in basis.of_degree(2):
        values = {(1, 1): [0.5] * 6, (1, 2): list(range(6)), (2, 2): [0.0] * 6}[x.species]
        want |= {x.offset + k: float(v) for k, v in enumerate(values)}
    for k, x in enumerate(basis.of_degree(3)):
        name = "-".join({1: "H", 2: "He"}[z] for z in x.species)
        if k % 2:
            values = r.random(x.size)
            model[name] = values.tolist()
        else:
            grid = r.random(x.weights.shape)
            model[name] = grid.tolist()
            both = (grid + grid.transpose(1, 0, 2)) / 2 if x.symmetry == 2 else grid
            values = both[x.weights > 0]
        want |= {x.offset + j: float(v) for j, v in enumerate(values)}
    (folder / "m.json").write_text(json.dumps({"coefficients": model}))
    got = {r.feature_idx: r.coefficient for r in text.load_models(spark, str(folder / "m.json"), basis).collect()}
    assert got.keys() == want.keys() == set(range(basis.n_features))
    assert all(abs(got[k] - want[k]) < 1e-12 for k in want)
    for broken in (model | {"H-H": [1.0]}, {k: v for k, v in model.items() if k != "H-H-H"}, {k: v for k, v in model.items() if k != "H"}):
        (folder / "m.json").write_text(json.dumps({"coefficients": broken}))
        with pytest.raises(ValueError):
            text.load_models(spark, str(folder / "m.json"), basis)


def test_chunks_resume(spark, folder):
    rows = spark.createDataFrame([(i,) for i in range(25)], "seq int")
    chunks = sinks.assign_chunks(rows, 10, "seq")
    assert {r.chunk: r["count"] for r in chunks.groupBy("chunk").count().collect()} == {0: 10, 1: 10, 2: 5}
    path = str(folder / "chunks")
    sinks.write_chunks(chunks.where("chunk = 1"), path, "seq")
    assert sorted(r.seq for r in sinks.write_chunks(chunks, path, "seq").collect()) == [*range(10), *range(20, 25)]
    assert spark.read.parquet(path).count() == 25
    more = sinks.assign_chunks(spark.createDataFrame([(i,) for i in range(-5, 25)], "seq int"), 10, "seq")  # numbers shift
    assert sorted(r.seq for r in sinks.write_chunks(more, path, "seq").collect()) == [*range(-5, 0)]
    told = spark.read.parquet(path)
    assert told.count() == told.select("seq").distinct().count() == 30


def test_cached_table_and_tabulated_curves(spark, folder):
    one = spark.createDataFrame([("a", 1, 2.0, None), ("a", 2, 3.0, "named")], "prefix string, seq int, energy double, row_name string")
    sinks.cache_table(one, str(folder / "t"))
    sinks.cache_table(one.limit(1), str(folder / "t"))
    assert sorted(r.config_id for r in sinks.load_table(spark, str(folder / "t")).collect()) == ["a_1", "a_1", "named"]
    points = spark.createDataFrame([(1, 2.0, 0.5, -1.0), (1, 1.0, 1.5, -2.0)], "interaction_id int, r double, e double, f double")
    sinks.write_tabulated(points, str(folder / "tab"))
    assert [r.value for r in spark.read.text(str(folder / "tab")).collect()] == [
        "1 1 1.00000000 1.50000000 -2.00000000", "1 2 2.00000000 0.50000000 -1.00000000"]


def test_bucketed_tables_join_without_a_shuffle(spark, tmp_path):
    """Three tables of four chunks: no exchange in the plan, other chunks not read, rows as in a plain join."""
    from pyspark.sql import functions as F

    rows = spark.range(400).select((F.col("id") % 100).alias("config_id"), F.col("id").alias("v"), (F.col("id") % 4).cast("int").alias("chunk"))
    one = rows.select("config_id", (F.col("v") * 2.0).alias("w"), "chunk").dropDuplicates(["config_id"])
    tables = [(f"bucketed_{k}", df) for k, df in (("x", rows), ("y", one), ("z", one.withColumnRenamed("w", "u")))]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for name, df in tables:
            sinks.write_bucketed(df, name, 4, chunk="chunk", path=f"file://{tmp_path}/{name}")
        told = sinks.load_bucketed(spark, [n for n, _ in tables], ["config_id"], [1])
        plan = told._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert {r.chunk for r in told.collect()} == {1} and told.count() == 100
        assert len(told.inputFiles()) < len(spark.table("bucketed_x").inputFiles()) * 3
        assert sinks.load_bucketed(spark, ["bucketed_x", "bucketed_y"], ["config_id"]).count() == 400
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        for name, _ in tables:
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_counts_of_what_is_dropped(spark, folder):
    from pyspark.sql import Observation

    from latticework.operators import features, tables

    (folder / "h.xyz").write_text("2\nenergy=1\nH 0 0 0\n1\nenergy=2\nHe 0 0 0\n")
    (folder / "empty.xyz").write_text("no frames here\n")
    seen = Observation("frames")
    configs, atoms = text.read_xyz(spark, str(folder), skip_broken=True, seen=seen)
    assert atoms.count() == 1 and seen.get == {"frames": 2, "broken_frames": 1}
    skipped = text.skipped_files(text.discover(spark, str(folder), "*.xyz"), configs)
    assert [r.path.rsplit("/", 1)[1] for r in skipped.collect()] == ["empty.xyz"]
    rows = spark.createDataFrame([(1, 1), (1, 2), (2, 9), (2, 1), (3, None), (4, 2)], "config_id int, z int")
    told = Observation("species")
    assert features.known_species(rows, Basis((1, 2)), told).count() == 3
    assert told.get == {"configs": 4, "dropped_configs": 2, "dropped_atoms": 3}
    empty = Observation("empty")
    kept = tables.ingest(spark.createDataFrame([("a", 1, 1.0, 2), ("a", 2, 1.0, 0), ("b", 3, 1.0, None)], "prefix string, config_id int, energy double, size int"), seen=empty)
    assert kept.count() == 1 and empty.get == {"frames": 3, "empty_frames": 2}
