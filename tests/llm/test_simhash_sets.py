import random

import numpy as np

import corpus_pipeline
from latticework.llm import simhash_sets as op
from latticework.llm.simhash import covering_masks

from .cases import AWKWARD, docs, prose


def jaccard(s, t):
    def sets(text):
        w = (text or "").encode().lower().split()
        return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    a, b = sets(s), sets(t)
    return len(a & b) / len(a | b) if a | b else 1.0


def components(rows):
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if label[i] != label[j] and jaccard(rows[i][1], rows[j][1]) >= 0.8:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    return label


def edited(text, seed, changes):
    words, r = text.split(), random.Random(seed)
    for k in r.sample(range(len(words)), changes):
        words[k] = f"new{seed}x{k}"
    return " ".join(words)


def family_rows():
    """Families in which similarity to the first text lies on both sides of 0.8."""
    rows = list(AWKWARD)
    for g in range(8):
        text = prose(500 + g, 200)
        rows += [(1000 + 40 * g + c, edited(text, 40 * g + c, c % 8)) for c in range(16)]
    return rows


def test_links_are_those_of_brute_force_jaccard(spark, monkeypatch):
    rows = family_rows()
    label = components(rows)
    least = {}
    for (i, _), x in zip(rows, label, strict=True):
        if i is not None:
            least[x] = min(i, least.get(x, i))
    want = sorted(((i, least.get(x)) for (i, _), x in zip(rows, label, strict=True)), key=str)
    for block in (256, 3):
        monkeypatch.setattr(op, "BLOCK", block)
        got = op.near_duplicates(docs(spark, rows, extra=True)).collect()
        assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == want


def test_stage_drops_copies_that_differ_in_many_fingerprint_bits(spark, tmp_path):
    text = prose(1, 400)
    rows = [(1, text), (2, edited(text, 3, 7)), (3, edited(text, 4, 60)), (4, prose(2, 300))]
    assert jaccard(rows[0][1], rows[1][1]) >= 0.8 > jaccard(rows[0][1], rows[2][1])
    rows += [(10 + k, edited(prose(50 + k // 2, 300), k, 4 * (k % 2))) for k in range(20)]
    kept = {r.doc_id for r in corpus_pipeline.near_stage(spark, docs(spark, rows), str(tmp_path)).collect()}
    assert kept == {1, 3, 4, *range(10, 30, 2)}


def test_parts_are_connected_as_by_all_pairs():
    r = random.Random(3)
    for _ in range(50):
        base = [np.array(sorted(r.sample(range(10**6), 60)), "u8") for _ in range(3)]
        sets = [np.unique(np.r_[b[r.randint(0, 8) :], np.array([r.randrange(10**6)], "u8")]) for b in base for _ in range(6)]
        parts = [r.randrange(9) for _ in sets]

        def joined(links):
            label = list(parts)
            for i, j in links:
                label = [label[i] if x == label[j] else x for x in label]
            return [label.index(x) for x in label]

        every = [(i, j) for i in range(18) for j in range(i) if op.similar(sets[i], [sets[j]])[0]]
        assert joined(op.part_links(parts, sets)) == joined(every)


def meets(a, b):
    """Whether two fingerprints share a key of a table, by the masks alone."""
    def halves(words):
        return [x for w in words for x in (w & 0xFFFFFFFF, (w >> 32) & 0xFFFFFFFF)]

    masks = covering_masks(op.PART_RADIUS, 32)
    return any((x ^ y) & m == 0 for x, y in zip(halves(a), halves(b), strict=True) for m in masks)


def test_recall_of_tables_by_similarity():
    r = np.random.default_rng(1)
    for rest, least in ((20, 0.96), (13, 0.985), (5, 0.999)):  # Jaccard 0.8, 0.86, 0.94
        met = 0
        for _ in range(1000):
            common, left = np.split(r.integers(0, 1 << 63, 160 + rest).astype("u8"), [160])
            a, b = np.sort(np.r_[common, left]), np.sort(np.r_[common, r.integers(0, 1 << 63, rest).astype("u8")])
            x, y = op.set_fingerprint(a), op.set_fingerprint(b)
            apart = sum(((i ^ j) & (2**64 - 1)).bit_count() for i, j in zip(x, y, strict=True))
            met += apart <= op.RADIUS and meets(x, y)
        assert met >= least * 1000


def test_pairs_within_the_guaranteed_radius_always_meet():
    r = random.Random(5)
    for _ in range(2000):
        a = [r.getrandbits(64) for _ in range(op.PARTS // 2)]
        b = list(a)
        for k in r.sample(range(32 * op.PARTS), op.PARTS * (op.PART_RADIUS + 1) - 1):
            b[k // 64] ^= 1 << (k % 64)
        assert meets(a, b)


def test_empty_table(spark):
    assert op.near_duplicates(docs(spark, [])).count() == 0
