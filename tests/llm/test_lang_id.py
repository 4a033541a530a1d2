import zlib

import numpy as np

from latticework.llm import lang_id as op

from .cases import docs

SAMPLES = {
    "en": "the and that with from were this which there their would about these other into could",
    "de": "der die und das nicht ein eine mit auf für werden über schön müssen durch zwischen",
    "fr": "le la les des une est pour dans qui que avec être été où leçon français",
}


def rows():
    import random

    r, out = random.Random(3), []
    for i in range(240):
        lang = ["en", "de", "fr"][i % 3]
        out.append((i, " ".join(r.choices(SAMPLES[lang].split(), k=40)), lang))
    return out


def test_held_out_accuracy_and_awkward_rows(spark):
    data = rows()
    odd = [(900, None, "en"), (901, "12 !? 3", "en"), (902, "", "de"), (903, "x", None), (904, "THE WHICH!", None),
           (None, "der die und", "de"), (905, "der die " * 300_000, "de")]
    got = {r.doc_id: r for r in op.identify_documents(docs(spark, data + odd, extra=True)).collect()}
    assert len(got) == len(data) + len(odd)
    for i, _, lang in data:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert got[i].lang_pred == lang and 0 <= got[i].score <= 1
    for i in (900, 901, 902):
        assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
    assert got[904].lang_pred == "en" and got[905].lang_pred == "de" and got[None].held_out is False


def test_nothing_to_learn(spark):
    got = op.identify_documents(docs(spark, [(1, "the", None)])).collect()
    assert [tuple(r) for r in got] == [(1, False, "und", 0.0)]
    assert op.identify_documents(docs(spark, [])).count() == 0


def test_trigrams_do_not_depend_on_the_blocks(monkeypatch):
    texts = ["", "Ab  c1d" * 50, "x", "é" * 90, "İstanbul ΣΑΣ"]

    def counted():
        out = {}
        for row, gram in op.trigrams(texts):
            for r, g in zip(row.tolist(), gram.tolist(), strict=True):
                out[r, g] = out.get((r, g), 0) + 1
        return out

    whole = counted()
    monkeypatch.setattr(op, "BLOCK_CHARS", 16)
    assert {k[0] for k in counted()} == {k[0] for k in whole}


def test_filter_names_every_language_and_corrects_its_fill():
    gram = np.arange(1, 2000, dtype="u8") * np.uint64(7919)
    slots = np.zeros((1, 1 << op.SLOTS_LOG2), "u8")
    for j in range(op.HASHES):
        np.bitwise_or.at(slots[0], op._slots(gram, j), np.uint64(0b101))
    model = op.BitSlicedFilter(slots, ["a", "b", "c"])
    assert (model.containing(gram) == 0b101).all()
    assert model.false_rate[1] == 0 < model.false_rate[0] < 1e-3


def test_signs_of_the_high_planes_are_no_letters(spark):
    """Private use, tag characters and emoji have no letter; ideographs of plane 2 do."""
    flag = "\U0001f3f4\U000e0067\U000e0062\U000e007f"
    odd = [(900, "\U000f0000\U000f0001\U00100000"), (901, flag), (902, "\U0001f600 \U000e0100"), (903, "\U00020000\U00020001")]
    got = {r.doc_id: (r.lang_pred, r.score) for r in op.identify_documents(docs(spark, rows()[:60] + odd)).collect()}
    assert [got[i] for i in (900, 901, 902)] == [("und", 0.0)] * 3
    assert got[903][0] != "und"


def test_more_languages_than_a_word_has_bits(spark):
    import random

    r = random.Random(7)
    words = {f"l{k:03}": ["".join(r.choices("abcdefghijklmnopqrstuvwxyzåäöüéñ", k=7)) for _ in range(12)] for k in range(130)}
    data = [(1000 * n + k, " ".join(r.choices(w, k=25)), lang) for k, (lang, w) in enumerate(words.items()) for n in range(6)]
    got = op.identify_documents(docs(spark, data)).collect()
    by = {d[0]: d[2] for d in data}
    seen = {lang for i, _, lang in data if zlib.crc32(str(i).encode()) % 4 != 2}
    told = [(g.lang_pred, by[g.doc_id]) for g in got if by[g.doc_id] in seen]
    assert len(seen) > 126 and sum(a == b for a, b in told) >= 0.99 * len(told)
