"""BPE by a priority queue of merge ranks over a doubly linked list of symbols.

A text is cut at the added tokens of the tokenizer file and then into pre-tokens.
The bytes of a pre-token are a doubly linked list of symbols; a heap holds the
possible merges by rank and place, and an entry whose symbols have changed since
is stale and skipped.  A pre-token of n bytes takes n log n steps, so one very
long word costs no more than many short ones.  Decoding concatenates the
vocabulary's strings and reads their characters as bytes.

Tasks share nothing but the vocabulary, whose size is fixed; each remembers the
ids of pre-tokens it has met, up to a bound on memory.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

#: The cut into pre-tokens that the byte-level tokenizer files name ("use_regex").  Fixed value.
PRE_TOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of pre-tokens whose ids a worker remembers; beyond it starts anew.
REMEMBERED_CHARS = 16_000_000


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself where it prints, else the next one from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


class Tokenizer:
    """Vocabulary, merges and added tokens of a byte-level BPE file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        cut = made["pre_tokenizer"] or {}
        if made["model"]["type"] != "BPE" or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or made["normalizer"]:
            raise ValueError(f"{path} holds no plain byte-level BPE")
        vocab: dict[str, int] = made["model"]["vocab"]
        chars = byte_characters()
        byte_of = {c: b for b, c in enumerate(chars)}
        self.first = [vocab[c] for c in chars]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(made["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[vocab[left], vocab[right]] = (rank, vocab[left + right])
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in made["added_tokens"]):
            raise ValueError("added tokens that take in their surroundings are not supported")
        self.added = {t["content"]: t["id"] for t in made["added_tokens"]}
        # Each string of the vocabulary with its bytes as characters below U+0100.
        self.pieces: dict[int, str] = {}
        for text, i in (vocab | self.added).items():
            known = all(c in byte_of for c in text)
            self.pieces[i] = "".join(chr(byte_of[c]) for c in text) if known else text.encode().decode("latin-1")

    @classmethod
    def of(cls, parts: dict) -> Tokenizer:
        """From the plain parts that travel: workers need no copy of the package."""
        made = cls.__new__(cls)
        made.__dict__.update(parts)
        return made

    def encode_word(self, word: str) -> list[int]:
        """Ids of one pre-token."""
        symbols = [self.first[b] for b in word.encode()]
        n, merges = len(symbols), self.merges
        if n < 2:
            return symbols
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = []
        for i in range(n - 1):
            found = merges.get((symbols[i], symbols[i + 1]))
            if found:
                heap.append((found[0], i, symbols[i], symbols[i + 1], found[1]))
        heapq.heapify(heap)
        while heap:
            _, i, left, right, new = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != left or j < 0 or symbols[j] != right:
                continue  # stale: one of the two has been merged since
            symbols[i], symbols[j] = new, -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                found = merges.get((new, symbols[k]))
                if found:
                    heapq.heappush(heap, (found[0], i, new, symbols[k], found[1]))
            h = before[i]
            if h >= 0:
                found = merges.get((symbols[h], new))
                if found:
                    heapq.heappush(heap, (found[0], h, symbols[h], new, found[1]))
        return [s for s in symbols if s >= 0]

    def decode(self, ids: list[int]) -> str:
        """The text of ids, special ones included; bytes that are no UTF-8 become U+FFFD."""
        return "".join(map(self.pieces.__getitem__, ids)).encode("latin-1").decode("utf-8", "replace")


class Remembered(dict):
    """Pre-token -> ids, encoded when first asked for."""

    def __init__(self, tokenizer: Tokenizer) -> None:
        super().__init__()
        self.encode, self.held = tokenizer.encode_word, 0

    def __missing__(self, word: str) -> list[int]:
        self[word] = ids = self.encode(word)
        self.held += len(word) + 16
        return ids


class Encoder:
    """Encodes whole texts, remembering the ids of pre-tokens."""

    def __init__(self, tokenizer: Tokenizer) -> None:
        self.tokenizer, self.find = tokenizer, regex.compile(PRE_TOKENS).findall
        by_length = sorted(tokenizer.added, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, by_length)) + ")").split if by_length else lambda text: [text]
        self.known = Remembered(tokenizer)

    def encode(self, text: str) -> list[int]:
        if self.known.held > REMEMBERED_CHARS:
            self.known = Remembered(self.tokenizer)
        ids: list[int] = []
        known, added = self.known, self.tokenizer.added
        for part in self.cut(text):
            if part in added:
                ids.append(added[part])
            else:
                for found in map(known.__getitem__, self.find(part)):
                    ids += found
        return ids


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids of every whole text: (id_col, token_ids array<int>), a row per row.

    The strings of added tokens become those tokens, wherever they stand.  A
    null text counts as empty and gives no ids; null and repeated identifiers
    pass through.  Other columns are ignored.
    """
    tokenizer = docs.sparkSession.sparkContext.broadcast(vars(Tokenizer(path)))

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(Tokenizer.of(tokenizer.value))
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "token_ids": [encoder.encode(x) for x in batch["body"]]})

    return _per_text(docs, id_col, text_col, encode, "token_ids array<int>")


def bpe_decode(tokens: DataFrame, path: str, token_col: str = "token_ids") -> DataFrame:
    """Adds ``decoded`` (string): the vocabulary's strings of the ids, concatenated; no ids, or null: empty."""
    tokenizer = tokens.sparkSession.sparkContext.broadcast(vars(Tokenizer(path)))

    def decode(col: pd.Series) -> pd.Series:
        made = Tokenizer.of(tokenizer.value)
        return col.map(lambda ids: "" if ids is None else made.decode(ids.tolist()))

    return tokens.withColumn("decoded", F.pandas_udf(decode, "string")(token_col))


def bpe_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_tokens, and SHA-256 of the decimal ids and of the text decoded from them.

    Encodes and decodes in the same worker, so ids do not travel.  Nulls and
    repeats as in ``bpe_encode``: a row per row.
    """
    tokenizer = docs.sparkSession.sparkContext.broadcast(vars(Tokenizer(path)))

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(Tokenizer.of(tokenizer.value))
        name = {i: str(i) for i in encoder.tokenizer.pieces}.__getitem__
        for batch in batches:
            rows = []
            for body in batch["body"]:
                ids = encoder.encode(body)
                text = encoder.tokenizer.decode(ids)
                digests = (hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(name, ids)), text))
                rows.append((len(ids), *digests))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            out.insert(0, "id", batch["id"])
            yield out

    return _per_text(docs, id_col, text_col, digest, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def _per_text(docs: DataFrame, id_col: str, text_col: str, work, schema: str) -> DataFrame:
    """Applies ``work`` to (id, body) batches; identifiers travel as strings, so a null stays one."""
    id_type = dict(docs.select(id_col).dtypes)[id_col]
    source = docs.select(F.col(id_col).cast("string").alias("id"), text_or_empty(text_col).alias("body"))
    out = source.mapInPandas(work, "id string, " + schema)
    return out.withColumn("id", F.col("id").cast(id_type)).withColumnRenamed("id", id_col)
