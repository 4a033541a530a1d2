import hashlib

import public_tokenizers
import tiktoken

from latticework.llm import bpe

from .cases import AWKWARD, docs, prose

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def whole(text):
    codec = tiktoken.Encoding(
        "t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={}
    )
    return codec.encode_ordinary(text)


ROWS = [*AWKWARD, (20, "a   b\n\n  c\t　d 'll don't''s"), (21, "日本語 テキスト ñandú 12ⅷ")]


def test_ids_equal_the_librarys(spark, monkeypatch):
    monkeypatch.setattr(bpe, "CAPSULE_CHARS", 50_000)
    got = bpe.bpe_encode(docs(spark, ROWS, extra=True), PATH, public_tokenizers.PATTERN, buckets=5).collect()
    want = sorted(((i, whole(t or "")) for i, t in ROWS), key=str)
    assert sorted(((r.doc_id, r.token_ids) for r in got), key=str) == want


def test_decoding_gives_the_bytes_back(spark):
    df = docs(spark, [(i, prose(i, 300)) for i in range(20)])
    tokens = bpe.bpe_encode(df, PATH, public_tokenizers.PATTERN)
    got = {r.doc_id: bytes(r.decoded).decode() for r in bpe.bpe_decode(tokens, PATH).collect()}
    assert got == {i: prose(i, 300) for i in range(20)}


def test_digests(spark):
    got = bpe.bpe_round_trip(docs(spark, [(1, "the thing"), (2, None)]), PATH, public_tokenizers.PATTERN).collect()
    for r in got:
        text = "the thing" if r.doc_id == 1 else ""
        ids = whole(text)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_empty_table(spark):
    assert bpe.bpe_round_trip(docs(spark, []), PATH, public_tokenizers.PATTERN).count() == 0


def test_forgotten_words_and_few_buckets_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED_WORDS", 3)
    monkeypatch.setattr(bpe, "CAPSULE_CHARS", 2_000)
    monkeypatch.setattr(bpe, "MOST_BUCKETS", 1)
    rows = [(i, prose(i % 7, 80)) for i in range(30)]
    got = bpe.bpe_encode(docs(spark, rows), PATH, public_tokenizers.PATTERN).collect()
    assert {r.doc_id: r.token_ids for r in got} == {i: whole(t) for i, t in rows}
