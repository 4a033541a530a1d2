import hashlib
import random

import public_tokenizers
import pytest
from pyspark.sql import Row
from tokenizers import Tokenizer as Library

from latticework.llm.bpe_heap import Encoder, Tokenizer, bpe_decode, bpe_digests, bpe_encode
from latticework.llm.queries import op12_bpe_heap

from .cases import AWKWARD, docs

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Library.from_file(PATH)


def digests(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    joined, back = ",".join(map(str, ids)), library.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


def test_random_strings_as_the_library(library):
    made, own = Tokenizer(PATH), None
    own, r = Encoder(made), random.Random(5)
    parts = ["a", "B", "'s", "'ll", "'", " ", "  ", "\n", "\t", "\x1c", "\x85", " ", "é", "漢", "1", "²", "!", "<|endoftext|>", "<|end", "😀", "ing", " the"]
    for _ in range(3000):
        text = "".join(r.choice(parts) for _ in range(r.randrange(30)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids
        assert made.decode(ids) == library.decode(ids, skip_special_tokens=False)
        ids = [r.randrange(50257) for _ in range(6)]  # mostly no UTF-8
        assert made.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_one_very_long_word(library):
    text = "abcab" * 60_000
    assert Encoder(Tokenizer(PATH)).encode(text) == library.encode(text, add_special_tokens=False).ids


def test_merges_that_go_stale():
    """The lower rank wins wherever it stands; entries of merged neighbours are skipped."""
    t = Tokenizer.__new__(Tokenizer)
    t.first = list(range(256))
    a, b, c = map(ord, "abc")
    t.merges = {(a, b): (1, 300), (b, c): (0, 301), (300, 301): (2, 302), (a, 301): (3, 303)}
    assert t.encode_word("abc") == [303]
    assert t.encode_word("ababc") == [300, 303]
    assert t.encode_word("abbc") == [302]


def test_forgetting_changes_nothing(library, monkeypatch):
    from latticework.llm import bpe_heap

    monkeypatch.setattr(bpe_heap, "REMEMBERED_CHARS", 20)
    own = Encoder(Tokenizer(PATH))
    for text in ["one two three", "four five", "one two", "three four one"]:
        assert own.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_awkward_rows(spark, library):
    rows = [*AWKWARD, (20, "a<|endoftext|> b"), (21, "<|endoftext|>")]
    got = bpe_digests(docs(spark, rows, extra=True), PATH).collect()
    want = [(r[0], *digests(library, r[1])) for r in rows]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_encode_then_decode(spark, library):
    rows = [*AWKWARD, (20, "a<|endoftext|> b")]
    coded = bpe_encode(docs(spark, rows), PATH)
    got = bpe_decode(coded, PATH).collect()
    assert sorted((r.doc_id or -1, r.decoded) for r in got) == sorted((r[0] or -1, r[1] or "") for r in rows)
    assert all(r.token_ids == library.encode(r.decoded, add_special_tokens=False).ids for r in got)


def test_empty_and_null(spark):
    assert bpe_digests(docs(spark, []), PATH).count() == 0
    nothing = bpe_decode(spark.createDataFrame([Row(token_ids=None), Row(token_ids=[])], "token_ids array<int>"), PATH)
    assert [r.decoded for r in nothing.collect()] == ["", ""]


def test_whole_table_equals_the_library(spark, library):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op12_bpe_heap(spark, sf).collect()
    assert len(got) == len(texts)
    assert all(tuple(r)[1:] == digests(library, texts[r.doc_id]) for r in got)
