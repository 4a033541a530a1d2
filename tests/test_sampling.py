import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from latticework.operators import farthest, sampling


def line(spark, n=100, group="a"):
    return spark.createDataFrame([(group, i, float(i)) for i in range(n)], "g string, k int, v double")


def test_stop_rules(spark):
    got = sampling.farthest_points(line(spark), "g", "k", ["v"], max_samples=50, min_diff=10.0).collect()
    assert len(got) < 50 and [r.k for r in sorted(got, key=lambda r: r.picked)][:3] == [0, 99, 49]
    assert sampling.farthest_points(line(spark), "g", "k", ["v"], max_samples=5).count() == 5
    assert sampling.farthest_points(line(spark), "g", "k", ["v"]).count() == 100


def test_rounds_pick_the_same_distances(spark):
    r = np.random.default_rng(0)
    rows = spark.createDataFrame([("a", i, *map(float, r.normal(size=2))) for i in range(60)], "g string, k int, v double, w double")
    small = sampling.farthest_points(rows, "g", "k", ["v", "w"], max_samples=12)
    large = sampling.farthest_points(rows, "g", "k", ["v", "w"], max_samples=12, group_rows=10)
    assert {r.k for r in small.collect()} == {r.k for r in large.collect()}


def test_ties_go_to_the_smallest_key_at_every_size(spark):
    values = [0, 5, -5, 5, -5, 10, -10, 10, 0, -10]
    rows = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(values)], "g string, k int, v double")
    picks = []
    for group_rows in (100, 2):
        found = sampling.farthest_points(rows, "g", "k", ["v"], max_samples=5, group_rows=group_rows).collect()
        picks.append([r.k for r in sorted(found, key=lambda r: r.picked)])
    assert picks[0] == picks[1] and picks[0][:3] == [6, 5, 0]
    both = [sampling.farthest_points(rows, "g", "k", ["v"], min_diff=4.0, group_rows=n).count() for n in (100, 2)]
    assert both == [5, 5]


def ordered(df, group="g"):
    return sorted(map(repr, ((r[group], r.picked, r.k) for r in df.collect())))


def by_rounds(x, keys, block_of, max_samples, min_diff):
    """Rounds of one group without Spark: the picks, and the number of rounds."""
    rows = pd.DataFrame({"key": keys, "top": list(x), "block": block_of})
    start = min(range(len(x)), key=lambda i: (x[i, 0], keys[i]))
    blocks = [
        (True, None, None, -1, b, 0, len(part), x[part.index].min(axis=0), x[part.index].max(axis=0), np.inf, False, False)
        for b, part in rows.groupby("block")
    ]
    names = ["is_block", "key", "top", "picked", "block", "folder", "n", "lo", "hi", "bound", "known", "open"]
    first = (False, keys[start], x[start], 0, -1, -1, 0, None, None, 0.0, True, False)
    state = pd.DataFrame([*blocks, first], columns=names).assign(g="g", more=True)
    rounds = 0
    while state["more"].any():
        opened = rows[rows["block"].isin(state[state["open"]]["block"])]
        state = farthest.step(opened, state, max_samples, min_diff).reset_index(drop=True)
        assert opened["top"].size <= max(farthest.OPEN_ROWS, rows["block"].value_counts().max())
        rounds += 1
    return state[~state["is_block"]].sort_values("picked")["key"].tolist(), rounds


def plainly(x, keys, max_samples, min_diff):
    order = np.argsort(keys, kind="stable")
    x, keys = x[order], np.asarray(keys)[order]
    at = int(x[:, 0].argmin())
    found, gap = [at], farthest.distances(x, x[at])
    while not max_samples or len(found) < max_samples:
        at = int(gap.argmax())
        if gap[at] <= 0 or gap[at] < min_diff:
            break
        found.append(at)
        gap = np.minimum(gap, farthest.distances(x, x[at]))
    return keys[found].tolist()


@pytest.mark.parametrize("open_rows", [20, 10_000])
@pytest.mark.parametrize("kind", ["normal", "ties", "cluster", "line", "one"])
def test_rounds_of_blocks_pick_as_one_task_does(monkeypatch, open_rows, kind):
    monkeypatch.setattr(farthest, "OPEN_ROWS", open_rows)
    r = np.random.default_rng(1)
    x = {
        "normal": r.normal(size=(300, 3)), "ties": r.integers(0, 12, size=(200, 2)).astype(float),
        "cluster": np.exp(r.normal(size=(200, 2)) * 6), "line": np.arange(128.0)[:, None], "one": np.ones((1, 2)),
    }[kind]
    x = np.unique(x, axis=0)
    keys = r.permutation(len(x)).tolist()
    for block_of in (r.integers(0, 9, len(x)), (x[:, 0].argsort().argsort() // 6)):
        for max_samples, min_diff in ((40, 0.0), (0, 0.4), (70, 2.0)):
            got, rounds = by_rounds(x, keys, block_of, max_samples, min_diff)
            assert got == plainly(x, keys, max_samples, min_diff)
            assert open_rows < 10_000 or rounds <= 2


def test_rounds_are_far_fewer_than_picks(monkeypatch):
    monkeypatch.setattr(farthest, "OPEN_ROWS", 2000)
    x = np.random.default_rng(2).uniform(size=(20_000, 2))
    cells = np.floor(x * 32).astype(int)
    got, rounds = by_rounds(x, list(range(len(x))), cells[:, 0] * 32 + cells[:, 1], 300, 0.0)
    assert got == plainly(x, list(range(len(x))), 300, 0.0) and rounds < 60


def test_large_groups_pick_as_small_ones(spark, monkeypatch):
    """Null, tied and small groups, at every group_rows."""
    monkeypatch.setattr(farthest, "OPEN_ROWS", 100)
    monkeypatch.setattr(farthest, "BLOCK_ROWS", 5)
    r = np.random.default_rng(1)
    rows = [(None, i, *map(float, r.normal(size=2))) for i in range(150)]
    rows += [("ties", i, float(i % 12), float(i // 12 % 10)) for i in range(240)]
    rows += [("one", 1, 0.0, 0.0), ("same", 1, 2.0, 2.0), ("same", 2, 2.0, 2.0), ("gaps", 1, None, 1.0), ("gaps", 2, 1.0, float("nan")), ("gaps", 3, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "g string, k int, v double, w double")
    want = ordered(sampling.farthest_points(df, "g", "k", ["v", "w"], max_samples=15))
    assert len(want) == 33 and any("None" in x for x in want)
    for group_rows in (0, 200):
        assert ordered(sampling.farthest_points(df, "g", "k", ["v", "w"], max_samples=15, group_rows=group_rows)) == want


def test_numeric_groups(spark):
    rows = [(g, f"k{i}", float(i * i % 17)) for g in (1, 2, None) for i in range(20)]
    df = spark.createDataFrame(rows, "g int, k string, v double")
    assert ordered(sampling.farthest_points(df, "g", "k", ["v"], max_samples=6, group_rows=5)) == ordered(sampling.farthest_points(df, "g", "k", ["v"], max_samples=6))


def test_displacements(spark):
    configs = spark.createDataFrame([(1, 5.0)], "config_id int, energy double")
    atoms = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.0, 2.0, -1.0, 0.0)], "config_id int, atom_idx int, px double, py double, pz double, fx double, fy double, fz double")
    got = {r.axis: (r.shift, r.energy) for r in sampling.axis_displacements(configs, atoms, 0.1).collect()}
    assert np.allclose([got[0], got[1], got[2]], [(-0.1, 5.2), (0.1, 5.1), (0, 5.0)])
    energies, moved = sampling.random_displacements(configs, atoms, 0.05, n=25)
    e = {r.copy: r.energy for r in energies.collect()}
    assert len(e) == 25
    for r in moved.collect():
        assert max(abs(r.px), abs(r.py), abs(r.pz)) <= 0.05
        assert abs(e[r.copy] - (5.0 - (2 * r.px - r.py))) < 1e-12


def test_rattle_repeats_itself(spark):
    atoms = spark.range(2000).select(F.lit(1).alias("config_id"), F.col("id").cast("int").alias("atom_idx"), *[F.lit(0.0).alias(p) for p in ("px", "py", "pz")])
    a = sampling.rattle(atoms, 0.1, seed=1)
    stats = a.agg(F.avg("px").alias("m"), F.stddev("px").alias("s")).first()
    assert abs(stats.m) < 0.01 and abs(stats.s - 0.1) < 0.01
    assert a.exceptAll(sampling.rattle(atoms, 0.1, seed=1)).count() == 0
