"""Byte-level BPE: a global distinct-word shuffle encodes, a byte table decodes.

Documents are packed into capsules: the distinct pre-tokens of a few million
characters, and every document as positions into that list.  The distinct
pre-tokens, not their occurrences, are shuffled by a hash of the word, each
distinct word is encoded once, and its ids go back to the capsules that asked,
where each document is put together again by position.  A word that fills a
third of the corpus costs one entry per capsule.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import regex
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_width

#: A capsule closes at this many characters, or this many distinct words.
CAPSULE_CHARS = 6_000_000
CAPSULE_WORDS = 400_000
#: Documents assembled into one pandas batch.
OUT_TOKENS = 500_000
#: Bytes of text for each bucket of words, and the most buckets: a capsule sends a
#: piece to each, so beyond this pieces grow with the corpus, not with its square.
BUCKET_BYTES, MOST_BUCKETS = 8_000_000, 2048
#: Different words of a bucket whose ids a task remembers; beyond it starts anew and
#: encodes words that it meets again once more.
REMEMBERED_WORDS = 1_000_000


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank, from a file of base64 token and rank per line."""
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}


def _pack_ints(values: np.ndarray) -> bytes:
    """Unsigned 32-bit integers, byte plane by byte plane: small ones compress well."""
    planes = values.astype("<u4").view("u1").reshape(-1, 4).T
    return zstandard.compress(np.ascontiguousarray(planes).tobytes(), 3)


def _unpack_ints(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(blob), "u1").reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _pack_words(words: list[bytes]) -> bytes:
    sizes = np.fromiter(map(len, words), "<u4", len(words)).tobytes()
    return zstandard.compress(len(words).to_bytes(4, "little") + sizes + b"".join(words), 3)


def _unpack_words(blob: bytes) -> list[bytes]:
    raw = zstandard.decompress(blob)
    n = int.from_bytes(raw[:4], "little")
    ends = np.cumsum(np.frombuffer(raw, "<u4", n, 4)).tolist()
    body = raw[4 + 4 * n :]
    return [body[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def _bucket_order(words: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each word, and the stable order that brings buckets together."""
    bucket = np.fromiter(map(zlib.crc32, words), "u4", len(words)) % buckets
    return bucket, np.argsort(bucket, kind="stable")


def pack_capsules(docs: DataFrame, pattern: str) -> DataFrame:
    """(id, body) -> capsules (capsule, words, ids, sizes, positions)."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = regex.compile(pattern).findall
        part, made = TaskContext.get().partitionId(), 0
        vocab: dict[str, int] = defaultdict()
        vocab.default_factory = vocab.__len__
        ids: list = []
        sizes: list[int] = []
        seqs: list[np.ndarray] = []
        chars = 0

        def close() -> pd.DataFrame:
            row = {
                "capsule": f"{part}-{made}", "words": _pack_words([w.encode() for w in vocab]), "ids": ids,
                "sizes": sizes, "positions": _pack_ints(np.concatenate(seqs)),
            }
            return pd.DataFrame({k: [v] for k, v in row.items()})

        for batch in batches:
            for doc, body in zip(batch["id"], batch["body"], strict=True):
                found = find(body)
                seqs.append(np.fromiter(map(vocab.__getitem__, found), "<u4", len(found)))
                ids.append(doc)
                sizes.append(len(found))
                chars += len(body)
                if chars >= CAPSULE_CHARS or len(vocab) >= CAPSULE_WORDS:
                    yield close()
                    made += 1
                    vocab.clear()
                    ids, sizes, seqs, chars = [], [], [], 0
        if ids:
            yield close()

    schema = "capsule string, words binary, ids array<string>, sizes array<int>, positions binary"
    return docs.mapInPandas(pack, schema)


def words_by_bucket(capsules: DataFrame, buckets: int) -> DataFrame:
    """Each capsule's distinct words, one row per bucket of the word's hash."""

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for capsule, blob in zip(batch["capsule"], batch["words"], strict=True):
                words = _unpack_words(blob)
                bucket, order = _bucket_order(words, buckets)
                cuts = np.flatnonzero(np.diff(bucket[order])) + 1
                groups = [g for g in np.split(order, cuts) if len(g)]
                rows = [(capsule, int(bucket[g[0]]), _pack_words([words[i] for i in g])) for g in groups]
                yield pd.DataFrame(rows, columns=["capsule", "bucket", "words"])

    # All columns, though two are used: so Spark sees one shuffle here and in the join, and runs it once.
    return capsules.mapInPandas(deal, "capsule string, bucket int, words binary")


def encode_words(dealt: DataFrame, ranks, pattern: str) -> DataFrame:
    """(capsule, bucket, words) -> (capsule, bucket, counts + ids).

    Rows come sorted by bucket, so a task holds the words of one bucket at a
    time and encodes each distinct word once.
    """

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks.value, special_tokens={})
        known: dict[bytes, list[int]] = {}
        now = None
        for batch in batches:
            out = []
            for capsule, bucket, blob in zip(batch["capsule"], batch["bucket"], batch["words"], strict=True):
                if bucket != now or len(known) > REMEMBERED_WORDS:
                    known, now = {}, bucket
                words = _unpack_words(blob)
                for w in words:
                    if w not in known:
                        known[w] = codec.encode_ordinary(w.decode())
                ids = [known[w] for w in words]
                counts = np.fromiter(map(len, ids), "<u4", len(ids))
                flat = np.fromiter((i for x in ids for i in x), "<u4", int(counts.sum()))
                out.append((capsule, bucket, _pack_ints(np.concatenate([counts, flat]))))
            yield pd.DataFrame(out, columns=["capsule", "bucket", "codes"])

    spread = dealt.repartition("bucket").sortWithinPartitions("bucket")
    return spread.mapInPandas(encode, "capsule string, bucket int, codes binary")


def assemble(
    joined: DataFrame,
    buckets: int,
    id_type: str,
    finish: Callable[[list[np.ndarray]], pd.DataFrame],
    schema: str,
) -> DataFrame:
    """Capsules with their words' codes -> (id, finished columns) per document.

    ``finish`` turns the token ids of some documents into result columns in the
    worker that put them together, so ids need not travel to a second one.
    """

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def close(ids: list, tokens: list[np.ndarray]) -> pd.DataFrame:
            out = finish(tokens)
            out.insert(0, "id", ids)
            return out

        for batch in batches:
            for row in batch.to_dict("records"):
                words = _unpack_words(row["words"])
                bucket, order = _bucket_order(words, buckets)
                here = np.unique(bucket[order], return_counts=True)
                size_of = dict(zip(here[0].tolist(), here[1].tolist(), strict=True))
                counts, flats = [], []
                for x in sorted(row["codes"], key=lambda c: c["bucket"]):
                    raw = _unpack_ints(x["codes"])
                    n = size_of[x["bucket"]]
                    counts.append(raw[:n])
                    flats.append(raw[n:])
                count = np.zeros(len(words), "i8")
                start = np.zeros(len(words), "i8")
                if len(words):
                    dealt = np.concatenate(counts).astype("i8")
                    count[order] = dealt
                    start[order] = np.cumsum(dealt) - dealt
                flat = np.concatenate(flats) if flats else np.zeros(0, "<u4")
                where = _unpack_ints(row["positions"])
                at, ids, tokens, held = 0, [], [], 0
                for doc, size in zip(row["ids"], row["sizes"], strict=True):
                    seq = where[at : at + size]
                    at += size
                    n = count[seq]
                    before = np.cumsum(n) - n
                    total = int(n.sum())
                    tokens.append(flat[np.repeat(start[seq] - before, n) + np.arange(total)].astype("i4"))
                    ids.append(doc)
                    held += total
                    if held >= OUT_TOKENS:
                        yield close(ids, tokens)
                        ids, tokens, held = [], [], 0
                if ids:
                    yield close(ids, tokens)

    out = joined.mapInPandas(build, "id string, " + schema)
    return out.withColumn("id", F.col("id").cast(id_type))


def _finish_ids(tokens: list[np.ndarray]) -> pd.DataFrame:
    return pd.DataFrame({"token_ids": tokens})


def bpe_encode(
    docs: DataFrame,
    ranks_path: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    buckets: int | None = None,
    finish: Callable[[list[np.ndarray]], pd.DataFrame] = _finish_ids,
    schema: str = "token_ids array<int>",
) -> DataFrame:
    """Token ids of every whole text: (id_col, token_ids array<int>), a row per row.

    ``finish`` and ``schema`` may replace token_ids by columns made from them.

    A null text counts as empty and gives no ids; null and repeated identifiers
    pass through, a row each.  Special tokens are never made.  Other columns
    are ignored.
    """
    spark = docs.sparkSession
    if buckets is None:
        size = F.sum(F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long"))
        wanted = (docs.select(size).first()[0] or 0) // BUCKET_BYTES
        buckets = max(32, 4 * shuffle_width(spark), min(wanted, MOST_BUCKETS))
    ranks = spark.sparkContext.broadcast(load_ranks(ranks_path))
    id_type = dict(docs.select(id_col).dtypes)[id_col]
    source = docs.select(
        F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("body")
    )
    capsules = pack_capsules(source, pattern).repartition("capsule")
    codes = (
        encode_words(words_by_bucket(capsules, buckets), ranks, pattern)
        .groupBy("capsule")
        .agg(F.collect_list(F.struct("bucket", "codes")).alias("codes"))
    )
    joined = capsules.join(codes, "capsule", "left").withColumn("codes", F.coalesce("codes", F.array()))
    return assemble(joined, buckets, id_type, finish, schema).withColumnRenamed("id", id_col)


def bpe_decode(tokens: DataFrame, ranks_path: str, token_col: str = "token_ids") -> DataFrame:
    """Adds ``decoded`` (binary): each id looked up in the broadcast token-byte table.

    The table has one entry per token of the vocabulary, whatever the corpus.
    """
    table = tokens.sparkSession.sparkContext.broadcast({r: t for t, r in load_ranks(ranks_path).items()})

    def decode(col: pd.Series) -> pd.Series:
        get = table.value.__getitem__
        return col.map(lambda ids: b"".join(map(get, ids.tolist())))

    return tokens.withColumn("decoded", F.pandas_udf(decode, "binary")(token_col))


def bpe_round_trip(docs: DataFrame, ranks_path: str, pattern: str, *, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the decimal ids and of the bytes decoded from them.

    Encodes, then decodes by the broadcast token-byte table in the same worker;
    ``keep_ids`` adds token_ids.
    """
    table = docs.sparkSession.sparkContext.broadcast({r: t for t, r in load_ranks(ranks_path).items()})

    def digest(tokens: list[np.ndarray]) -> pd.DataFrame:
        get, name = table.value.__getitem__, {i: str(i) for i in table.value}.__getitem__
        rows = []
        for found in tokens:
            ids = found.tolist()
            joined, body = ",".join(map(name, ids)).encode(), b"".join(map(get, ids))
            rows.append((len(ids), hashlib.sha256(joined).hexdigest(), hashlib.sha256(body).hexdigest()))
        out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
        if keep_ids:
            out["token_ids"] = tokens
        return out

    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * keep_ids
    return bpe_encode(docs, ranks_path, pattern, finish=digest, schema=schema)
