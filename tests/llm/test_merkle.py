import hashlib
import zlib
from collections import defaultdict

import pytest

from latticework.llm import merkle
from latticework.llm.merkle import Block, address, lower_cased_third, manifest_proofs, tree_size
from latticework.llm.queries import op11_merkle, oracle_sql

from .cases import AWKWARD, docs


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def record(row, text):
    values = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels(row):
    out = [row]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def climb(rows, at):
    """(left, right) of each level of a way up."""
    for row in rows[:-1]:
        run = row[at // 8 * 8 : at // 8 * 8 + 8]
        yield "".join(run[: at % 8]), "".join(run[at % 8 + 1 :])
        at //= 8


def brute(rows):
    by = defaultdict(list)
    for r in rows:
        hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0
        text = r["text"]
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text) if hit and text else text
        by[r["lang"]].append((r["doc_id"], record(r, text), record(r, low)))
    trees = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    own = {}
    for lang in trees:
        by[lang].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        own[lang] = levels([x[1] for x in by[lang]])
    top = levels([own[lang][-1][0] for lang in trees])
    out = []
    for place, lang in enumerate(trees):
        for i, (doc, leaf, other) in enumerate(by[lang]):
            way = [*climb(own[lang], i), *climb(top, place)]
            found = other
            for left, right in way:
                found = sha(left + found + right)
            root = top[-1][0]
            out.append((doc, leaf, own[lang][-1][0], root, sha("".join(a + b for a, b in way)), found, found == root))
    return sorted(map(repr, out))


def found(df, tampered=None):
    return sorted(map(repr, map(tuple, manifest_proofs(df, tampered if tampered is not None else lower_cased_third(df)).collect())))


@pytest.mark.parametrize("levels", [1, 2, 3, 4, 5, 6])
def test_layout_is_a_permutation_in_aligned_subtrees(levels):
    places = [address(levels, d, i) for d in range(levels) for i in range(8**d)]
    assert sorted(places) == list(range(tree_size(levels)))
    upper = levels // 2
    if upper:
        size = tree_size(levels - upper)
        for b in (0, 8**upper - 1):  # a lower subtree is one run of places, laid out like a tree of its own
            inside = [address(levels, upper + d, b * 8**d + i) for d in range(levels - upper) for i in range(8**d)]
            first = tree_size(upper) + b * size
            assert inside == [first + address(levels - upper, d, i) for d in range(levels - upper) for i in range(8**d)]
            assert sorted(inside) == list(range(first, first + size))


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65, 500])
def test_block_keeps_its_nodes_when_packed(n):
    digests = [sha(str(i)) for i in range(n)]
    made = Block.build(digests, merkle.height_of(n))
    again = Block.read(n, made.height, made.packed())
    want = levels(digests)
    assert [again.row(d) for d in range(made.height, -1, -1)] == want
    assert [list(zip(*x, strict=True)) for x in again.siblings()] == [list(climb(want, i)) for i in range(n)]


def test_awkward_rows(spark):
    rows = [(*r, ["en", None, "de", ""][i % 4]) for i, r in enumerate(AWKWARD)]
    df = docs(spark, rows, extra=True).withColumn("tree", merkle.F.lit("clash")).withColumn("block", merkle.F.lit(1))
    assert found(df) == brute([r.asDict() for r in df.collect()])


@pytest.mark.parametrize("block_levels", [1, 4])
def test_many_blocks_and_many_groups(spark, monkeypatch, block_levels):
    monkeypatch.setattr(merkle, "BLOCK_LEVELS", block_levels)
    rows = [(i // 2 if i % 50 else None, f"Text {i % 30}", f"l{i % 70}" if i % 3 == 0 else "en") for i in range(700)]
    df = docs(spark, rows)
    assert found(df) == brute([r.asDict() for r in df.collect()])


def test_one_repeated_row_holds_most_of_the_table(spark):
    df = docs(spark, [(7, "Same")] * 300 + [(i, "Other") for i in range(40)])
    got = found(df)
    assert got == brute([r.asDict() for r in df.collect()])


def test_one_row_and_none(spark):
    df = docs(spark, [(1, "a")])
    row = manifest_proofs(df, df["text"]).first()
    assert (row.leaf, row.proof_sha256, row.verified) == (row.root, sha(""), True)
    empty = docs(spark, [])
    assert manifest_proofs(empty, empty["text"]).count() == 0


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    want = brute([r.asDict() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])
    got = op11_merkle(spark, sf).collect()
    assert sorted(map(repr, map(tuple, got))) == want
    assert 0 < sum(not r.verified for r in got) < len(got)


def test_sql_crc32():
    import duckdb

    from latticework.llm.queries import _CRC32

    for x in ("0", "7", "123456789", "-5"):
        assert duckdb.sql(f"SELECT {_CRC32.format(repr(x))}").fetchall()[0][0] == zlib.crc32(x.encode())
    assert "op11_merkle" in oracle_sql()
