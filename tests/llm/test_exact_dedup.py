import hashlib
from collections import defaultdict

from latticework.llm import exact_dedup as op

from .cases import AWKWARD, docs


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for i, t in rows:
        ids = groups[t or ""]
        known = [x for x in ids if x is not None]
        keep = max(known) if known else None
        out.append((i, keep, len(ids), hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


def test_matches_brute_force_with_clashing_columns(spark):
    got = op.exact_dedup(docs(spark, AWKWARD, extra=True)).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == brute(AWKWARD)
    kept = defaultdict(int)
    for r in got:
        kept[r.text_sha256] += r.kept
    assert set(kept.values()) == {1}


def test_smallest_identifier_can_stay(spark):
    got = op.exact_dedup(docs(spark, [(5, "x"), (3, "x"), (9, "y")]), largest=False).collect()
    assert {(r.doc_id, r.keep_id) for r in got} == {(5, 3), (3, 3), (9, 9)}


def test_empty_table(spark):
    assert op.exact_dedup(docs(spark, [])).count() == 0


def test_hot_group_is_salted(spark, monkeypatch):
    monkeypatch.setattr(op, "ROWS_PER_SALT", 3)
    rows = [(i, "hot") for i in range(50)] + [(100 + i, f"cold {i}") for i in range(20)]
    got = op.exact_dedup(docs(spark, rows)).collect()
    assert len(got) == 70 and sum(r.kept for r in got) == 21
    assert {r.keep_id for r in got if r.group_size == 50} == {49}


def test_equal_digest_of_different_texts_is_told_apart(spark, monkeypatch):
    real = op.F.sha2
    monkeypatch.setattr(op.F, "sha2", lambda col, bits: real(op.F.substring(col, 1, 1), bits))
    rows = [(1, "ax"), (2, "ay"), (3, "ax"), (4, "b"), (5, "ay"), (6, "az")]
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in op.exact_dedup(docs(spark, rows)).collect()}
    assert got == {
        1: (3, 2, False), 3: (3, 2, True), 2: (5, 2, False), 5: (5, 2, True), 4: (4, 1, True), 6: (6, 1, True)
    }


def test_main_path_has_no_python(spark):
    plan = op.exact_dedup(docs(spark, AWKWARD))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
