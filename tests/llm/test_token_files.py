import public_tokenizers

from latticework.llm import token_files as op

from .cases import AWKWARD, docs, prose
from .test_bpe import PATH, whole

END = 50256


def test_counts_equal_the_tokenizers(spark, monkeypatch):
    monkeypatch.setattr(op, "BLOCK_TOKENS", 64)
    rows = [*AWKWARD, *[(50 + i, prose(i, 1 + 13 * i)) for i in range(12)]]
    got = op.token_counts(docs(spark, rows, extra=True), PATH, public_tokenizers.PATTERN, END).collect()
    want = sorted(((i, len(whole(t or ""))) for i, t in rows), key=str)
    assert sorted(((r.doc_id, r.n_tokens) for r in got), key=str) == want


def test_blocks_have_equal_size_and_hold_the_stream(spark):
    files = op.write_token_files(docs(spark, [(i, prose(i, 40)) for i in range(9)]), PATH, public_tokenizers.PATTERN, END,
                                 block_tokens=50)
    for rows in [[r for r in files.collect() if r.file == f] for f in {r.file for r in files.collect()}]:
        sizes = [len(r.tokens) // 2 for r in sorted(rows, key=lambda r: r.block)]
        assert all(s == 50 for s in sizes[:-1]) and sizes[-1] <= 50


def test_empty_table(spark):
    assert op.token_counts(docs(spark, []), PATH, public_tokenizers.PATTERN, END).count() == 0
