import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from latticework.llm import conversation_trie
from latticework.llm.conversation_trie import Products, prefix_trie, stored_turns
from latticework.llm.queries import op13_conversation_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def table(spark, rows, extra=False):
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:
        from pyspark.sql import functions as F

        for name in ("k", "digest", "chars", "x", "y", "depth", "h", "n", "base", "len"):
            df = df.withColumn(name, F.lit("clash"))
    return df


def brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    seqs = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(f"{'-' if c < 0 else ''}{abs(c) % 100}")
        head = [t[2:] for t in sorted(own.get(base, []))][:h]
        seqs[c] = (*head, *(t[2:] for t in sorted(own[c])[h:]))
    members = defaultdict(list)
    for c, seq in seqs.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    children = defaultdict(list)
    for pre in members:
        if pre:
            children[pre[:-1]].append(pre)
    leaves, saved, out = {}, {}, []
    for pre in sorted(members, key=len, reverse=True):
        below = children[pre]
        leaves[pre] = sum(leaves[x] for x in below) if below else 1
        saved[pre] = sum(saved[x] for x in below) + (len(members[pre]) - 1) * (len(pre[-1][1]) if pre else 0)
        ends = ",".join(str(c) for c in sorted(members[pre]) if len(seqs[c]) == len(pre))
        parent = min(members[pre[:-1]]) if pre else None
        digest = hashlib.sha256(ends.encode()).hexdigest()
        out.append((min(members[pre]), len(pre), parent, len(members[pre]), len(below), leaves[pre], saved[pre], digest))
    return sorted(map(repr, out))


def found(df):
    return sorted(map(repr, map(tuple, prefix_trie(df).collect())))


AWKWARD = [
    (0, 0, "user", "hello"), (0, 1, "assistant", "one"), (0, 2, "user", "two"), (0, 3, "assistant", "three"),
    (1, 0, "user", "hello"), (1, 1, "assistant", "one"), (1, 2, "user", "other"), (1, 3, None, None), (1, None, "system", "first"),
    (2, 5, "user", "tie b"), (2, 5, "user", "tie a"), (2, 5, "user", "tie a"), (2, None, None, "x" * 30_000),
    (3, 0, "user", ""), (3, 1, "", "user"), (4, 0, "", ""), (105, 0, "user", "no base"), (106, 0, "user", "no base"),
    (None, 0, "user", "belongs to none"), (-5, 0, "user", "hello"), (-7, 1, "user", "hello"), (205, 0, "ü", "é漢😀"), (200, 1, "ü", "é漢😀"),
]


def many(seed, convs=230):
    r = random.Random(seed)
    rows = []
    for c in range(convs):
        n = r.choice([1, 2, 5, 8])
        rows += [(c, t, r.choice(["user", "assistant"]), r.choice(["hi", "yes", "no", f"turn {r.randrange(3)}"])) for t in range(n)]
    return rows


def test_awkward_rows(spark):
    assert found(table(spark, AWKWARD, extra=True)) == brute(AWKWARD)


def test_many_conversations(spark):
    rows = many(3)
    assert found(table(spark, rows)) == brute(rows)


def test_one_conversation_over_many_partitions(spark):
    rows = [(100, t, "user", f"t{t % 7}") for t in range(400)] + many(5, 120)
    df = table(spark, rows)
    assert found(df) == brute(rows)
    # The products at the borders of partitions are those of the whole.
    made, product = Products(0), (0, 0)
    for row in stored_turns(df, 0).where("conv_id = 100").orderBy("k").collect():
        assert (row.x0, row.y0) == product
        product = made.compose(row.k, product, made.turn(row.digest))
        assert (row.x1, row.y1) == product
    assert row.k >= 399


def test_many_equal_conversations(spark, monkeypatch):
    monkeypatch.setattr(conversation_trie, "PIECE_IDS", 7)
    rows = [(c, t, "user", f"t{t}") for c in range(1000, 1400) for t in range(3)]
    assert found(table(spark, rows)) == brute(rows)


def test_collisions_are_found_and_done_again(spark, monkeypatch):
    tried, plain = [], conversation_trie.stored_turns

    def recorded(conversations, seed):
        tried.append(seed)
        return plain(conversations, seed)

    monkeypatch.setattr(conversation_trie, "primes", lambda seed: (5, 7) if seed < 2 else (2**61 - 1, 2**61 - 1))
    monkeypatch.setattr(conversation_trie, "stored_turns", recorded)
    rows = many(8, 60)
    assert found(table(spark, rows)) == brute(rows)
    assert tried == [0, 1, 2]


def test_turns_with_equal_digests_are_told_apart_by_their_text(spark):
    from pyspark.sql import functions as F

    turns = stored_turns(table(spark, AWKWARD), 0)
    assert conversation_trie.same_turns(turns)
    assert not conversation_trie.same_turns(turns.withColumn("digest", F.lit(b"all")))


@pytest.mark.parametrize("seed", [0, 1])
def test_products_are_a_monoid(seed):
    made, r = Products(seed), random.Random(1)
    turns = [(r.randrange(2**61 - 1), r.randrange(2**61 - 1)) for _ in range(9)]

    def product(values):
        out = (0, 0)
        for i, v in enumerate(values):
            out = made.compose(i, out, v)
        return out

    for cut in range(10):
        assert made.compose(cut, product(turns[:cut]), product(turns[cut:])) == product(turns)
        assert made.suffix(cut, product(turns), product(turns[:cut])) == product(turns[cut:])


def test_empty_table(spark):
    assert found(table(spark, [])) == []
    assert found(table(spark, [(None, 0, "user", "a")])) == []


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(repr, map(tuple, op13_conversation_trie(spark, sf).collect()))) == brute(rows)
