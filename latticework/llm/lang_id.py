"""Language ID by n-gram filters with a language bitmask in every slot.

Training counts each language's character trigrams over all labelled rows,
keeps those a language uses often enough, and lays them into one bit-sliced
Bloom filter: a slot holds one bit per language, and the AND of a trigram's
slots names all languages that contain it.  A document is decided by the
popcount of each language's bit over its trigrams, corrected for the false
positives that the language's filled slots make likely.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Slots of the filter (a power of two) and hashes per trigram.
SLOTS_LOG2 = 20
HASHES = 3
#: A language contains a trigram that makes up this share of its trigrams, and
#: at least this part of the share in the language that uses it most.  At most
#: 1 / MIN_SHARE trigrams per language reach the filter, whatever the corpus.
MIN_SHARE = 2e-6
MIN_PART = 0.2
#: Languages that share a word of a slot; every further 63 languages take another word (8 MB).
WORD_LANGUAGES = 63
#: Characters worked on at once.
BLOCK_CHARS = 250_000
UNDETERMINED = "und"

_SPACE = 32
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype="u8")  # odd, for hashing
_letters: list[np.ndarray] = []


def _is_letter(cp: np.ndarray) -> np.ndarray:
    """Whether each code point is a letter: by a table of the lower planes, made once a worker, others one by one."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x20000)), bool, 0x20000))
    known = _letters[0][np.minimum(cp, 0x1FFFF)]
    high = cp > 0x1FFFF
    if high.any():
        rare, at = np.unique(cp[high], return_inverse=True)
        known[high] = np.array([chr(c).isalpha() for c in rare.tolist()])[at]
    return known


def _blocks(texts: list[str]) -> Iterator[list[tuple[int, str]]]:
    """(row, piece) lists of about BLOCK_CHARS; pieces of a long text overlap by two."""
    block: list[tuple[int, str]] = []
    held = 0
    for row, text in enumerate(texts):
        for at in range(0, max(1, len(text)), BLOCK_CHARS):
            piece = text[max(0, at - 2) : at + BLOCK_CHARS]
            edge = " " if at == 0 else ""
            tail = " " if at + BLOCK_CHARS >= len(text) else ""
            block.append((row, edge + piece + tail))
            held += len(piece)
            if held >= BLOCK_CHARS:
                yield block
                block, held = [], 0
    if block:
        yield block


def trigrams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row of each trigram, packed trigram), over letters and single spaces.

    Text is lower-cased; runs of other characters count as one space, and
    every text is padded by a space at both ends.
    """
    for block in _blocks(texts):
        joined = "".join(p for _, p in block).lower()
        pieces = [p.lower() for _, p in block]
        if len(joined) != sum(map(len, pieces)):  # lower-casing depends on the neighbours
            joined = "".join(pieces)
        cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
        row = np.repeat(
            np.array([r for r, _ in block], "i8"), np.fromiter(map(len, pieces), "i8", len(pieces))
        )
        piece = np.repeat(np.arange(len(pieces)), np.fromiter(map(len, pieces), "i8", len(pieces)))
        known = _is_letter(cp)
        cp = np.where(known, cp, _SPACE).astype("u8")
        kept = np.ones(len(cp), bool)
        kept[1:] = known[1:] | known[:-1] | (piece[1:] != piece[:-1])
        cp, row, piece, known = cp[kept], row[kept], piece[kept], known[kept]
        if len(cp) < 3:
            continue
        gram = (cp[:-2] << np.uint64(42)) | (cp[1:-1] << np.uint64(21)) | cp[2:]
        whole = (piece[:-2] == piece[2:]) & (known[:-2] | known[1:-1] | known[2:])
        yield row[:-2][whole], gram[whole]


def _slots(gram: np.ndarray, j: int) -> np.ndarray:
    mixed = gram * _MULTIPLIERS[j]
    mixed ^= mixed >> np.uint64(29)
    mixed *= _MULTIPLIERS[(j + 1) % HASHES]
    return (mixed >> np.uint64(64 - SLOTS_LOG2)).astype("i8")


def count_trigrams(labelled: DataFrame) -> DataFrame:
    """(lang, body) -> (lang, gram, n), summed in each task before the shuffle."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = defaultdict(list)

        def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            grams, at = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
            return grams, np.bincount(at, np.concatenate([n for _, n in parts])).astype("i8")

        for batch in batches:
            for lang, rows in batch.groupby("lang", sort=False)["body"]:
                for _, gram in trigrams(rows.tolist()):
                    held[lang].append(np.unique(gram, return_counts=True))
                    if len(held[lang]) >= 32:
                        held[lang] = [merged(held[lang])]
        for lang, parts in held.items():
            grams, n = merged(parts)
            yield pd.DataFrame({"lang": lang, "gram": grams.astype("i8"), "n": n})

    counted = labelled.mapInPandas(count, "lang string, gram long, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class BitSlicedFilter:
    """The slots of the filter (a row of words for every 63 languages), its languages, and each language's fill."""

    def __init__(self, slots: np.ndarray, languages: list[str]) -> None:
        self.slots, self.languages = slots, languages
        fill = [float(self.bit(slots, i).mean()) for i in range(len(languages))]
        #: Chance that a trigram outside the language has all its slots set.
        self.false_rate = np.array(fill) ** HASHES

    @staticmethod
    def bit(words: np.ndarray, language: int) -> np.ndarray:
        """A language's bit in each column of words."""
        word, at = divmod(language, WORD_LANGUAGES)
        return (words[word] >> np.uint64(at)) & np.uint64(1)

    def containing(self, gram: np.ndarray) -> np.ndarray:
        """For each trigram the bits of all languages that contain it."""
        mask = self.slots[:, _slots(gram, 0)]
        for j in range(1, HASHES):
            mask = mask & self.slots[:, _slots(gram, j)]
        return mask


def train(labelled: DataFrame) -> BitSlicedFilter | None:
    """Fit the filter on every (lang, body) row; None if there is no trigram."""
    counts = materialize(count_trigrams(labelled), "trigrams")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    languages = sorted(r["lang"] for r in totals.select("lang").collect())  # one row a language
    if not languages:
        return None
    number = F.element_at(
        F.create_map(*[x for i, l in enumerate(languages) for x in (F.lit(l), F.lit(i))]), F.col("lang")
    )
    share = F.col("n") / F.col("total")
    often = (
        counts.join(F.broadcast(totals), "lang")  # a row a language
        .select("gram", number.alias("number"), share.alias("share"))
        .where(F.col("share") >= MIN_SHARE)
        .withColumn("top", F.max("share").over(Window.partitionBy("gram")))
        .where(F.col("share") >= MIN_PART * F.col("top"))
        .groupBy("gram", F.floor(F.col("number") / WORD_LANGUAGES).cast("int").alias("word"))
        .agg(F.bit_or(F.expr(f"shiftleft(1L, number % {WORD_LANGUAGES})")).alias("mask"))
    )

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            gram = batch["gram"].to_numpy("i8").view("u8")
            slot = np.concatenate([_slots(gram, j) for j in range(HASHES)])
            yield pd.DataFrame({"slot": slot, "word": np.tile(batch["word"], HASHES), "mask": np.tile(batch["mask"], HASHES)})

    placed = often.mapInPandas(places, "slot long, word int, mask long")
    rows = placed.groupBy("slot", "word").agg(F.bit_or("mask").alias("mask")).toPandas()  # at most 2 ** SLOTS_LOG2 rows a word
    slots = np.zeros((-(-len(languages) // WORD_LANGUAGES), 1 << SLOTS_LOG2), "u8")
    slots[rows["word"].to_numpy(), rows["slot"].to_numpy("i8")] = rows["mask"].to_numpy("i8").view("u8")
    return BitSlicedFilter(slots, languages)


def predict(texts: list[str | None], model: BitSlicedFilter | None) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    n = len(texts)
    bodies = [t or "" for t in texts]
    labels, scores = [UNDETERMINED] * n, np.zeros(n)
    if model is None:
        return labels, scores
    width = len(model.languages)
    hits, grams = np.zeros((n, width)), np.zeros(n)
    for row, gram in trigrams(bodies):
        mask = model.containing(gram)
        grams += np.bincount(row, minlength=n)
        for i in range(width):
            hits[:, i] += np.bincount(row, model.bit(mask, i).astype("f8"), minlength=n)
    found = grams > 0
    # Observed = true + (all - true) * false rate, solved for the true count.
    true = (hits - grams[:, None] * model.false_rate) / (1 - np.minimum(model.false_rate, 0.999))
    share = np.clip(true / np.maximum(grams, 1)[:, None], 0, 1)
    best = share.argmax(axis=1)
    for i in np.flatnonzero(found):
        labels[i] = model.languages[best[i]]
    scores[found] = share[found, best[found]]
    return labels, scores


def identify(docs: DataFrame, model: BitSlicedFilter | None, text_col: str = "text") -> DataFrame:
    """Adds lang_pred and score, made from the whole text alone."""
    parts = model and (model.slots, model.languages)
    shared = docs.sparkSession.sparkContext.broadcast(parts)  # 2 ** SLOTS_LOG2 words for every 63 languages
    made: list[BitSlicedFilter] = []

    def told(col: pd.Series) -> pd.DataFrame:
        if shared.value and not made:
            made.append(BitSlicedFilter(*shared.value))
        labels, scores = predict(col.tolist(), made[0] if made else None)
        return pd.DataFrame({"lang_pred": labels, "score": scores})

    struct = F.pandas_udf(told, "lang_pred string, score double")(text_col)
    return docs.withColumn("_said", struct).select(*docs.columns, "_said.lang_pred", "_said.score")


def held_out(id_col: str = "doc_id"):
    """Rows that training never sees: CRC-32 of the identifier's text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_documents(docs: DataFrame) -> BitSlicedFilter | None:
    known = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    return train(known.select("lang", F.col("text").alias("body")))


def identify_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of documents.

    ``und`` with score 0 where text is null or has no letter, or where nothing
    could be learned (no labelled row).  Ties go to the first language in
    alphabetical order.  A null doc_id is never held out.  Repeated rows get
    the same answer each; other columns are ignored.
    """
    model = fit_documents(docs)
    body = docs.select("doc_id", held_out().alias("held_out"), "text")
    return identify(body, model).select("doc_id", "held_out", "lang_pred", "score")
