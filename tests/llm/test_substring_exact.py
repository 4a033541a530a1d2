import hashlib
import random

import numpy as np
import pytest

from latticework.llm import substring_exact as op
from latticework.llm.suffix_groups import suffix_array, suffix_arrays

from .cases import AWKWARD, docs, prose


def brute(rows):
    least = {}
    bodies = [(op.LAST if i is None else i, i, (t or "").encode()) for i, t in rows]
    for key, _, b in bodies:
        for w in range(len(b) - 49):
            s = b[w : w + 50]
            least[s] = min(least.get(s, key), key)
    out = []
    for key, i, b in bodies:
        cover = bytearray(len(b))
        for w in range(len(b) - 49):
            if least[b[w : w + 50]] < key:
                cover[w : w + 50] = b"\1" * 50
        spans = sum(cover[k] and (k == 0 or not cover[k - 1]) for k in range(len(b)))
        kept = bytes(c for c, x in zip(b, cover, strict=True) if not x)
        out.append((i, len(b), sum(cover), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def tangled():
    r = random.Random(4)
    base = [prose(s, 60) for s in range(5)]
    rows = [*AWKWARD[:9], (30, " " * 500), (31, "x" + " " * 300), (32, "ab" * 200), (33, "ba" * 120)]
    for i in range(60):
        a, b = r.choice(base), r.choice(base)
        cut, at = sorted(r.sample(range(len(a)), 2))
        rows.append((100 + r.randrange(80), prose(500 + i, 8) + a[cut:at] + "ü" + b[: r.randrange(len(b))]))
    return rows


@pytest.mark.parametrize(("hot", "runs", "alone"), [(2000, 20_000, 3000), (1, 20_000, 3000), (2000, 10, 3000), (2000, 20_000, 100)])
def test_matches_brute_force(spark, monkeypatch, hot, runs, alone):
    monkeypatch.setattr(op, "CAPSULE_BYTES", 4000)
    monkeypatch.setattr(op, "HOT_CAPSULES", hot)
    monkeypatch.setattr(op, "HOT_RUNS", runs)
    monkeypatch.setattr(op, "FREQUENT", 2)
    monkeypatch.setattr(op, "ALONE_BYTES", alone)
    rows = tangled()
    got = [tuple(r) for r in op.dedup_digests(docs(spark, rows, extra=True)).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_cutting_keeps_every_shared_window_and_owners_are_the_least():
    r = random.Random(8)
    for _ in range(60):
        base = "".join(r.choice("abcd ") for _ in range(r.choice([60, 90]))).encode()
        if r.random() < 0.3:
            base = (base[: r.choice([3, 7, 26])] * 40)[:90]
        texts = [base, base[5:80] + b"zzzz" * 10, b"yyyy" * 12 + base[20:], bytes(reversed(base)), base[:40] + b"w" * 50]
        groups = {}
        for t in texts:
            for v, a, b, _ in zip(*(x.tolist() for x in op.window_runs(t, [len(t)])), strict=True):
                groups.setdefault(v, set()).add(t[a : b + 49])
        strings = [s for g in groups.values() for s in sorted(g)]
        group = np.repeat(np.arange(len(groups)), [len(g) for g in groups.values()])
        size = np.array([len(s) for s in strings])
        first, last = op.shareable(np.frombuffer(b"".join(strings), "u1"), np.cumsum(size) - size, size, group)
        windows = [{s[w : w + 50] for w in range(len(s) - 49)} for s in strings]
        for i, s in enumerate(strings):
            others = set().union(*(windows[j] for j in np.flatnonzero(group == group[i]) if j != i))
            for w in range(len(s) - 49):
                if s[w : w + 50] in others:
                    assert first[i] <= w and w + 50 <= last[i]
        owners = np.array([r.randrange(9) for _ in strings])
        least = {}
        for s, g, o in zip(strings, group, owners, strict=True):
            for w in range(len(s) - 49):
                least[g, s[w : w + 50]] = min(o, least.get((g, s[w : w + 50]), 9))
        want = [least[g, s[w : w + 50]] for s, g in zip(strings, group, strict=True) for w in range(len(s) - 49)]
        assert op.smallest_owners(strings, owners, group).tolist() == want


def test_spans_are_byte_offsets(spark):
    a = prose(1, 30)
    got = {r.doc_id: r for r in op.repeated_spans(docs(spark, [(1, a), (2, "é" + a)])).collect()}
    assert got[1].spans == [] and [tuple(s) for s in got[2].spans] == [(2, 2 + len(a))]
    assert bytes(got[2].kept).decode() == "é"


def test_empty_table(spark):
    assert op.dedup_digests(docs(spark, [])).count() == 0


def test_suffix_array_against_sorting():
    r = random.Random(1)
    for _ in range(3000):
        n, letters = r.randrange(60), r.choice([1, 2, 3, 200])
        text = bytes(r.randrange(letters) for _ in range(n))
        assert suffix_array(text) == sorted(range(n), key=lambda i: text[i:])
    several = [bytes(r.randrange(r.choice([1, 2, 3, 200])) for _ in range(r.randrange(60))) for _ in range(300)]
    assert suffix_arrays(several).tolist() == [i for t in several for i in suffix_array(t)]
    assert suffix_arrays([]).tolist() == suffix_arrays([b"", b""]).tolist() == []
    for text in (b"mississippi" * 20, b"ab" * 100, b"a" * 300, bytes(range(256))):
        assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def test_equal_windows_have_equal_minimizers():
    body = prose(3, 400).encode()

    def by_window(*docs):
        ends = [sum(map(len, docs[: k + 1])) for k in range(len(docs))]
        out = {}
        for v, a, b, _ in zip(*(x.tolist() for x in op.window_runs(b"".join(docs), ends)), strict=True):
            assert 0 < b - a <= op.SPREAD
            out.update({w: v for w in range(a, b)})
        return out

    alone = by_window(body)
    assert sorted(alone) == list(range(len(body) - 49))
    cut = by_window(b"zz" + body[100:300])
    assert all(cut[w + 2] == alone[100 + w] for w in range(151))
    # Documents end to end: the windows of each, none across an end.
    parts = [b"short", body[:90], b"", body[:90], b"y" * 49, body[200:260], b"x" * 120]
    joined, at, want = by_window(*parts), 0, {}
    for p in parts:
        want.update({at + w: v for w, v in by_window(p).items()})
        at += len(p)
    assert joined == want
