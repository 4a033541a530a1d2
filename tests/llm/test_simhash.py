import random

import numpy as np
import xxhash

from latticework.llm import simhash as op
from latticework.llm.components import connected_components

from .cases import AWKWARD, docs, prose


def slow_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text).replace("\x0b", " ").replace("\x0c", " ")
             .replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows):
    prints = [(i, slow_fingerprint(t or "")) for i, t in rows]
    parent = {i: i for i, _ in prints if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in prints:
        for j, b in prints:
            if i is not None and j is not None and (a ^ b).bit_count() <= 4:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    same = {f: find(min(i for i, g in prints if g == f and i is not None)) for _, f in prints
            if any(i is not None and g == f for i, g in prints)}
    return sorted(((i, f"{f:016x}", same.get(f)) for i, f in prints), key=str)


def test_every_pair_within_the_radius_shares_a_mask():
    masks = op.covering_masks()
    assert len(masks) == 31
    r = random.Random(1)
    for _ in range(3000):
        diff = sum(1 << b for b in r.sample(range(64), r.randint(0, 4)))
        assert any(diff & m == 0 for m in masks)


def test_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(op, "BLOCK", 16)
    rows = list(AWKWARD)
    for g in range(6):
        words = prose(100 + g, 120).split()
        for c in range(12):
            copy = list(words)
            for k in range(c % 4):
                copy[(7 * k + c) % len(copy)] = f"new{c}x{k}"
            rows.append((1000 + 20 * g + c, " ".join(copy)))
    got = op.near_duplicates(docs(spark, rows, extra=True)).collect()
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=str) == brute(rows)


def test_split_buckets_lose_no_link(spark):
    r = random.Random(5)
    seeds = [r.getrandbits(64) for _ in range(12)]
    prints = sorted({s ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 3))) for s in seeds for _ in range(25)})
    rows = [(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(prints)]
    df = spark.createDataFrame(rows, "fp long, rep long")
    got = dict(map(tuple, connected_components(op.near_links(df, block=8)).collect()))
    fp = np.array(prints, "u8")
    label = list(range(len(fp)))
    changed = True
    while changed:
        changed = False
        for i in range(len(fp)):
            m = min(label[j] for j in np.flatnonzero(np.bitwise_count(fp ^ fp[i]) <= 4))
            if m < label[i]:
                label[i], changed = m, True
    assert [got.get(i, i) for i in range(len(fp))] == label


def test_long_runs_stay_connected():
    r = random.Random(2)
    fp = np.array(sorted({r.getrandbits(6) for _ in range(60)} | {0xFFFF_0000 + r.getrandbits(5) for _ in range(20)}), "u8")
    i, j = op._links(np.zeros(len(fp), "i8"), fp, 1)
    assert (np.bitwise_count(fp[i] ^ fp[j]) <= 1).all()
    nodes, roots = op.spanning_edges(i.tolist(), j.tolist())
    want_nodes, want_roots = op.spanning_edges(
        *map(list, zip(*[(a, b) for a in range(len(fp)) for b in range(a) if int(fp[a] ^ fp[b]).bit_count() <= 1], strict=True))
    )
    assert dict(zip(nodes, roots, strict=True)) == dict(zip(want_nodes, want_roots, strict=True))


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    got = dict(map(tuple, connected_components(edges).collect()))
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


def test_empty_table(spark):
    assert op.near_duplicates(docs(spark, [])).count() == 0
