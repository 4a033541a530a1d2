import hashlib

import public_tokenizers
import tiktoken

import corpus_pipeline
from latticework.llm.bpe import load_ranks
from latticework.llm.common import apply_verdicts

from .cases import AWKWARD, docs, prose
from .test_simhash import brute as near_brute


def bench(tmp_path, spark, item):
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")


def stages(spark, tmp_path, df):
    out = []
    for k, (name, f) in enumerate(corpus_pipeline.STAGES):
        columns = df.columns
        f(spark, df, str(tmp_path)).write.parquet(f"{tmp_path}/{k}-{name}")
        df = spark.read.parquet(f"{tmp_path}/{k}-{name}")
        assert k == len(corpus_pipeline.STAGES) - 1 or df.columns == columns
        out.append(df)
    return out


def test_stages_do_what_brute_force_says(spark, tmp_path):
    item = prose(77, 30)
    bench(tmp_path, spark, item)
    near = prose(5, 300).split()
    near[100] = "changed"
    rows = [
        *AWKWARD, (50, prose(5, 300)), (51, " ".join(near)), (52, prose(6, 50) + " " + item), (53, "12 345 !"),
        *[(60 + i, prose(200 + i, 80)) for i in range(20)],
    ]
    one, two, three, four, five = stages(spark, tmp_path, docs(spark, rows, extra=True))
    kept = sorted(((r.doc_id, r.text) for r in one.collect()), key=str)
    assert kept == sorted((r for r in rows if any(c.isalpha() for c in r[1] or "")), key=str)
    best = {}
    for i, t in kept:
        best[t] = i if best.get(t) is None else best[t] if i is None else max(best[t], i)
    assert sorted(((r.doc_id, r.text) for r in two.collect()), key=str) == sorted(((i, t) for t, i in best.items()), key=str)
    rows2 = [(r.doc_id, r.text) for r in two.collect()]
    stay = {i for i, _, c in near_brute(rows2) if i == c}
    assert {r.doc_id for r in three.collect()} == stay and three.count() == len(stay)
    assert {r.doc_id for r in four.collect()} == stay - {52}
    got = five.collect()
    assert {r.doc_id for r in got} == stay - {52}
    ranks = load_ranks(public_tokenizers.path(corpus_pipeline.RANKS))
    codec = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r.doc_id: r.text for r in four.collect()}
    for r in got:
        ids = codec.encode_ordinary(texts[r.doc_id])
        assert (list(r.token_ids), r.n_tokens) == (ids, len(ids))
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_empty_documents(spark, tmp_path):
    bench(tmp_path, spark, prose(1, 20))
    assert [x.count() for x in stages(spark, tmp_path, docs(spark, []))] == [0] * 5


def test_verdicts_tell_rows_of_one_identifier_apart(spark):
    df = docs(spark, [(1, "a"), (1, "b"), (None, "c"), (None, "d"), (2, "e"), (2, "e")])
    from pyspark.sql import functions as F

    from latticework.llm.common import text_key

    said = df.where("text in ('b', 'c')").select("doc_id", text_key().alias("text_key"), F.lit(False).alias("keep"))
    assert sorted(r.text for r in apply_verdicts(df, said).collect()) == ["a", "d", "e", "e"]
    said = df.where("text = 'e'").select("doc_id", text_key().alias("text_key"), F.lit(True).alias("keep"))
    assert sorted(r.text for r in apply_verdicts(df, said, once=True).collect()) == ["a", "b", "c", "d", "e"]
