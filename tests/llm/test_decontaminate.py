from itertools import combinations

import pytest

from latticework.llm import decontaminate as op

from .cases import docs, prose


def bench(spark, rows):
    return spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows], "item_id long, text string, w string, id string")


def brute(rows, items):
    out = set()
    for d, t in rows:
        w = (t or "").lower().split()
        for i, u in items:
            v = (u or "").lower().split()
            if len(v) < op.SPAN:
                continue
            best = 0
            for diagonal in range(-len(v), len(w)):
                same = [0 <= q + diagonal < len(w) and w[q + diagonal] == v[q] for q in range(len(v))]
                best = max([best, *(sum(same[q : q + op.WINDOW]) for q in range(len(v)))])
            if best >= (op.EQUAL if len(v) >= op.WINDOW else len(v)):
                out.add((d, i, best))
    return out


def test_mask_is_lossless_for_the_acceptance_rule():
    for gone in combinations(range(op.WINDOW), op.WINDOW - op.EQUAL):
        assert any(not any(at + m in gone for m in op.MASK) for at in range(op.WINDOW - op.SPAN + 1))


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_matches_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(op, "BROADCAST_SEEDS", broadcast)
    items = [(1, prose(1, 30)), (2, prose(2, 14)), (3, prose(3, 9)), (4, prose(4, 5)), (5, None), (6, ""), (7, prose(1, 30))]
    swapped = prose(1, 30).split()
    for k in (3, 9, 15, 21, 27):
        swapped[k] = "swapped"
    broken = prose(1, 30).split()
    for k in range(0, 30, 3):
        broken[k] = "broken"
    rows = [
        (10, prose(50, 40) + " " + prose(1, 30) + " " + prose(51, 20)), (11, " ".join(swapped).upper()),
        (12, " ".join(broken)), (13, prose(2, 14)), (14, prose(3, 9)), (15, prose(4, 5)), (16, None), (17, ""),
        (18, prose(2, 14)[: len(prose(2, 12))]), (19, prose(60, 3000) + "\n" + prose(3, 9)), (None, prose(2, 14)),
        (13, prose(2, 14)), (20, "x " * 50), (21, prose(3, 8)),
    ]
    found = op.leaks(docs(spark, rows, extra=True), bench(spark, items)).collect()
    assert {(r.doc_id, r.item_id, r.equal_words) for r in found} == brute(rows, items)
    kept = op.without_leaks(docs(spark, rows), bench(spark, items))
    assert sorted(r.doc_id for r in kept.collect()) == [12, 15, 16, 17, 20, 21]
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_shuffled_benchmark_gives_the_same(spark, monkeypatch):
    df, items = docs(spark, [(1, prose(1, 30)), (2, prose(9, 30))]), bench(spark, [(1, prose(1, 30))])
    monkeypatch.setattr(op, "BROADCAST_SEEDS", 0)
    assert [r.doc_id for r in op.leaks(df, items).collect()] == [1]


def test_empty_tables(spark):
    assert op.leaks(docs(spark, []), bench(spark, [(1, prose(1, 30))])).count() == 0
    assert op.without_leaks(docs(spark, [(1, "x")]), bench(spark, [])).count() == 1


def test_main_path_has_no_python(spark):
    plan = op.leaks(docs(spark, []), bench(spark, []))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
