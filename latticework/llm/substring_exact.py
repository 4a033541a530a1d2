"""Suffix-array dedup: bytes covered by a 50-byte string of an earlier document.

Every 50-byte window is dealt by its minimizer, the smallest hash among the
24-byte strings it holds, so equal windows meet whatever document they are in.
Consecutive windows with one minimizer travel as one string.  Three passes:

1. Which minimizers occur in more than one document?  Documents are packed into
   capsules of a few megabytes, and each capsule sends its distinct minimizers
   once, five bytes each, to buckets that answer with a bit for each.
2. The strings of repeated minimizers go to buckets, once per capsule with the
   smallest identifier and all their places.  Equal strings are one.  Different
   strings with one minimizer, cut to what another of them can share, form a
   text whose suffix array (Lyndon-prefix groups) brings equal windows together;
   each window gets the smallest identifier that holds it, and the capsule a
   bit per window.
3. The places come back with the bits; each capsule covers and removes the bytes
   of its marked windows.

Where whole strings are equal no suffix array is needed; of the synthetic
tables' removed bytes the arrays decide about an eighth.  A minimizer in very
many capsules, or with very many different strings, is hot: its windows are
dealt one by one by their own content, where equality alone decides, so no
bucket and no suffix array fills with it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_width
from .suffix_groups import _spread, suffix_array, suffix_arrays

#: Bytes of a repeated string, and of the strings that choose its bucket.
LENGTH = 50
SEED = 24
SPREAD = LENGTH - SEED + 1
#: A capsule closes at this many bytes of text.
CAPSULE_BYTES = 4_000_000
#: Documents are hashed together in blocks of about this many bytes.
BLOCK_BYTES = 1 << 15
#: A minimizer in more capsules, or with more different strings, is dealt window by window.
HOT_CAPSULES, HOT_RUNS = 2_000, 20_000
#: Up to so many runs of a minimizer in a capsule count as so many different strings.
FREQUENT = 8
#: Bytes of input for each bucket.
BUCKET_BYTES = 16_000_000
#: Bytes beside a minimizer at which strings are compared before they are sorted.
STEPS = (3, 6, 9, 13, 17, 21, 26)
#: Texts of a group up to ALONE_BYTES are sorted TOGETHER_BYTES at a time.
ALONE_BYTES, TOGETHER_BYTES = 3_000, 1_000_000
#: Stands for a null identifier: after all others.
LAST = np.iinfo("i8").max

# Odd multipliers for hashing.
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_S29, _S31, _S32 = np.uint64(29), np.uint64(31), np.uint64(32)
#: No UTF-8 text holds this byte, so it parts the strings of a text.
_PART = b"\xff"


def _seed_hashes(body: bytes) -> np.ndarray:
    """A hash of the SEED bytes at every place."""
    n = len(body) - 7
    word = np.empty(n, "<u8")
    for k in range(min(8, n)):
        word[k::8] = np.frombuffer(body, "<u8", (len(body) - k) // 8, k)
    m = n - 16
    b, c = word[8 : 8 + m], word[16:]
    h = word[:m] * _A
    h ^= (b ^ (b >> _S29)) * _B
    h ^= h >> _S32
    h += (c ^ (c >> _S31)) * _C
    h *= _A
    h ^= h >> _S29
    h *= _B
    h ^= h >> _S32
    return h


def window_runs(text: bytes, ends: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(minimizer, first window, past the last, sign) of each run, SPREAD windows at most.

    The sign hashes the first and the last SEED bytes of the run's string.

    ``text`` holds documents end to end, ``ends`` their ends; windows that
    would cross an end are left out, and no run does.
    """
    if len(text) < LENGTH:
        none = np.zeros(0, "i8")
        return none.view("u8"), none, none, none.view("u8")
    hashes = low = _seed_hashes(text)
    width = 1
    while width * 2 <= SPREAD:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    rest = SPREAD - width
    low = np.minimum(low[: len(low) - rest], low[rest:])
    n = len(low)
    whole = np.ones(n + 1, bool)
    whole[n] = False
    fresh = np.ones(n + 1, bool)
    np.not_equal(low[1:], low[:-1], out=fresh[1:n])
    before = 0
    for end in ends:
        whole[max(before, end - LENGTH + 1) : end] = False
        if end < n:
            fresh[end] = True
        before = end
    fresh[1:] |= ~whole[:-1]
    # A run starts at a fresh whole window and ends before the next fresh or broken one.
    start = np.flatnonzero(fresh[:n] & whole[:n])
    edge = np.flatnonzero(fresh | ~whole)
    end = edge[np.searchsorted(edge, start, side="right")]
    if len(start) and (end - start).max() > SPREAD:  # one minimizer again and again, as in a row of blanks
        pieces = -(-(end - start) // SPREAD)
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        last = np.repeat(end, pieces)
        start = np.repeat(start, pieces) + nth * SPREAD
        end = np.minimum(start + SPREAD, last)
    return low[start], start, end, hashes[start] * _A + hashes[end + (LENGTH - 1 - SEED)] * _B


def pack_capsules(docs: DataFrame) -> DataFrame:
    """(id long, body) -> (capsule, ids, sizes, bodies)."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, made, held = TaskContext.get().partitionId(), 0, 0
        ids: list[int] = []
        bodies: list[bytes] = []

        def close() -> pd.DataFrame:
            return pd.DataFrame(
                {
                    "capsule": [f"{part}-{made}"],
                    "ids": [zstandard.compress(np.array(ids, "<i8").tobytes(), 1)],
                    "sizes": [zstandard.compress(np.fromiter(map(len, bodies), "<i8").tobytes(), 1)],
                    "bodies": [zstandard.compress(b"".join(bodies), 3)],
                }
            )

        for batch in batches:
            for doc, text in zip(batch["id"].tolist(), batch["body"].tolist(), strict=True):
                ids.append(doc)
                bodies.append(text.encode())
                held += len(bodies[-1])
                if held >= CAPSULE_BYTES:
                    yield close()
                    ids, bodies, held, made = [], [], 0, made + 1
        if ids:
            yield close()

    return docs.mapInPandas(pack, "capsule string, ids binary, sizes binary, bodies binary")


def _blocks(ends: list[int]) -> Iterator[tuple[int, int]]:
    """Runs of documents of about BLOCK_BYTES, so that arrays stay in the processor's cache."""
    first, base = 0, 0
    for i, end in enumerate(ends):
        if end - base >= BLOCK_BYTES or i == len(ends) - 1:
            yield first, i + 1
            first, base = i + 1, end


class Capsule:
    """A capsule's documents, end to end; identifiers and ends by document."""

    def __init__(self, row: dict) -> None:
        self.ids = np.frombuffer(zstandard.decompress(row["ids"]), "<i8")
        self.ends = np.cumsum(np.frombuffer(zstandard.decompress(row["sizes"]), "<i8"))
        self.text = zstandard.decompress(row["bodies"])


class Runs:
    """The runs of a capsule's windows and their distinct minimizers."""

    def __init__(self, capsule: Capsule, buckets: int) -> None:
        self.capsule, self.buckets = capsule, buckets
        ends = capsule.ends.tolist()
        runs = [self._block(capsule.text, ends, a, b) for a, b in _blocks(ends)]
        self.low, self.start, self.end, self.sign = (np.concatenate(x) for x in zip(*runs, strict=True))
        self.seeds, self.which = np.unique(self.low, return_inverse=True)
        bucket = (self.seeds % np.uint64(buckets)).astype("i8")
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[order])) + 1
        #: Each bucket with the numbers of the capsule's minimizers that are in it.
        self.parts = [(int(bucket[at[0]]), at) for at in np.split(order, cuts) if len(at)]

    @staticmethod
    def _block(text: bytes, ends: list[int], a: int, b: int) -> tuple[np.ndarray, ...]:
        """Runs of documents a to b (past the last), with starts and ends inside the capsule."""
        base = ends[a - 1] if a else 0
        low, start, end, sign = window_runs(text[base : ends[b - 1]], [e - base for e in ends[a:b]])
        return low, start + base, end + base, sign

    def owner(self, places: np.ndarray) -> np.ndarray:
        """The document that holds each place of the capsule."""
        return np.searchsorted(self.capsule.ends, places, side="right")

    def in_several(self) -> np.ndarray:
        """Whether two documents of this capsule share each minimizer."""
        doc = self.owner(self.start)
        first, last = np.full(len(self.seeds), LAST), np.full(len(self.seeds), -1)
        np.minimum.at(first, self.which, doc)
        np.maximum.at(last, self.which, doc)
        return first != last

    def frequent(self) -> tuple[np.ndarray, np.ndarray]:
        """Minimizers of over FREQUENT runs, with how many different runs each has."""
        many = np.bincount(self.which, minlength=len(self.seeds)) > FREQUENT
        at = np.flatnonzero(many[self.which])
        number = np.cumsum(many) - 1
        pairs = np.unique(np.stack([number[self.which[at]].astype("u8"), self.sign[at]], axis=1), axis=0)
        return np.flatnonzero(many), np.bincount(pairs[:, 0].astype("i8"), minlength=int(many.sum()))

    def marks(self, answers: list) -> tuple[np.ndarray, np.ndarray]:
        """The buckets' answers of pass 1, by minimizer: repeated, hot."""
        given = {x["bucket"]: x["bits"] for x in answers}
        repeated, hot = np.zeros(len(self.seeds), bool), np.zeros(len(self.seeds), bool)
        for bucket, at in self.parts:
            bits = np.unpackbits(np.frombuffer(given[bucket], "u1"), count=2 * len(at)).astype(bool)
            repeated[at], hot[at] = bits[: len(at)], bits[len(at) :]
        return repeated, hot

    def strings(self, answers: list) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        """Distinct strings of repeated minimizers, a key of each, and the occurrences (place, string number)."""
        repeated, hot = self.marks(answers)
        at = np.flatnonzero(repeated[self.which])
        start, size, low, single = self.start[at], (self.end - self.start)[at], self.low[at], hot[self.which[at]]
        if single.any():  # window by window
            n = np.where(single, size, 1)
            nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            start, low, single = np.repeat(start, n) + nth, np.repeat(low, n), np.repeat(single, n)
            size = np.where(single, 1, np.repeat(size, n))
        text, number = self.capsule.text, {}
        ask = number.setdefault
        which = np.array(
            [ask(text[a:b], len(number)) for a, b in zip(start.tolist(), (start + size + LENGTH - 1).tolist(), strict=True)], "i8"
        )
        strings = list(number)
        first = np.empty(len(strings), "i8")
        first[which[::-1]] = np.arange(len(which))[::-1]
        key = low[first] if len(first) else np.zeros(0, "u8")
        for i in np.flatnonzero(single[first]).tolist() if len(first) else ():
            key[i] = zlib.crc32(strings[i])
        return strings, key, start, which


def _rows(batch: pd.DataFrame) -> Iterator[dict]:
    return iter(batch.to_dict("records"))


def send_minimizers(capsules: DataFrame, buckets: int) -> DataFrame:
    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in _rows(batch):
                runs = Runs(Capsule(row), buckets)
                several, code = runs.in_several(), runs.seeds // np.uint64(buckets)
                frequent, different = runs.frequent()
                number = np.zeros(len(runs.seeds), "<u4")
                number[frequent] = np.minimum(different, 1 << 31)
                out = []
                for bucket, at in runs.parts:
                    short = code[at].astype("<u4").tobytes() + (code[at] >> _S32).astype("u1").tobytes()
                    many = np.flatnonzero(number[at])
                    tail = many.astype("<u4").tobytes() + number[at[many]].tobytes()
                    out.append((bucket, row["capsule"], len(at), short + np.packbits(several[at]).tobytes() + tail))
                yield pd.DataFrame(out, columns=["bucket", "capsule", "n", "codes"])

    return capsules.mapInPandas(send, "bucket int, capsule string, n int, codes binary")


def answer_repeated(sent: DataFrame) -> DataFrame:
    """Per bucket and capsule: a bit for each minimizer in several documents, and for hot ones."""

    def answer(group: pd.DataFrame) -> pd.DataFrame:
        codes, several, runs = [], [], []
        for n, raw in zip(group["n"], group["codes"], strict=True):
            high = np.frombuffer(raw, "u1", n, 4 * n).astype("u8")
            codes.append(np.frombuffer(raw, "<u4", n) | (high << _S32))
            several.append(np.unpackbits(np.frombuffer(raw, "u1", -(-n // 8), 5 * n), count=n))
            tail = np.frombuffer(raw, "<u4", -1, 5 * n + -(-n // 8)).reshape(2, -1)
            runs.append(np.full(n, FREQUENT, "i8"))
            runs[-1][tail[0]] = tail[1]
        _, at, count = np.unique(np.concatenate(codes), return_inverse=True, return_counts=True)
        marked = count > 1
        np.logical_or.at(marked, at, np.concatenate(several).astype(bool))
        repeated = marked[at]
        hot = ((count > HOT_CAPSULES) | (np.bincount(at, np.concatenate(runs)) > HOT_RUNS))[at]
        bits, done = [], 0
        for n in group["n"]:
            bits.append(np.packbits(np.r_[repeated[done : done + n], hot[done : done + n]]).tobytes())
            done += n
        return pd.DataFrame({"capsule": group["capsule"], "bucket": group["bucket"], "bits": bits})

    return sent.groupBy("bucket").applyInPandas(answer, "capsule string, bucket int, bits binary")


def _planes(numbers: np.ndarray) -> bytes:
    """Small numbers below 2^32 as byte planes, which compress well."""
    return numbers.astype("<u4").view("u1").reshape(-1, 4).T.tobytes()


def _from_planes(raw: bytes, n: int, at: int) -> np.ndarray:
    return np.frombuffer(raw, "u1", 4 * n, at).reshape(4, n).T.copy().view("<u4")[:, 0]


def send_strings(asked: DataFrame, buckets: int) -> DataFrame:
    """To each bucket its strings, and their places, which come back with its answer."""

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in _rows(batch):
                capsule = Capsule(row)
                runs = Runs(capsule, buckets)
                strings, key, start, which = runs.strings(row["repeats"])
                ids = capsule.ids[runs.owner(start)]
                owner = np.full(len(strings), LAST)
                np.minimum.at(owner, which, ids)
                size = np.fromiter(map(len, strings), "u1", len(strings))
                short = (key // np.uint64(buckets)).astype("<u4")
                bucket = (key % np.uint64(buckets)).astype("i8")
                by_bucket = np.argsort(bucket, kind="stable")
                rank = np.empty(len(strings), "i8")
                rank[by_bucket] = np.arange(len(strings))
                by_string = np.argsort(rank[which], kind="stable")
                place = start[by_string]
                times = np.bincount(rank[which], minlength=len(strings))
                reach = np.r_[0, np.cumsum(times)]
                edges = np.r_[np.flatnonzero(np.r_[True, np.diff(bucket[by_bucket]) > 0]), len(strings)] if len(strings) else [0]
                out = []
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    at = by_bucket[a:b]
                    blob = size[at].tobytes() + short[at].tobytes() + owner[at].tobytes() + b"".join([strings[i] for i in at.tolist()])
                    steps = np.diff(place[reach[a] : reach[b]], prepend=0).astype("<i4").view("<u4")
                    back = size[at].tobytes() + _planes(times[a:b]) + _planes(steps)
                    out.append((int(bucket[at[0]]), row["capsule"], b - a, zstandard.compress(blob, 3), zstandard.compress(back, 3)))
                yield pd.DataFrame(out, columns=["bucket", "capsule", "n", "strings", "places"])

    return asked.mapInPandas(send, "bucket int, capsule string, n int, strings binary, places binary")


def _prefix_hash(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums and powers, from which the hash of any stretch follows."""
    power = np.full(len(flat) + 1, _A)
    power[0] = 1
    power = np.multiply.accumulate(power)
    return np.r_[np.uint64(0), np.cumsum((flat.astype("u8") + np.uint64(1)) * power[:-1] * _B, dtype="u8")], power


def shareable(flat: np.ndarray, start: np.ndarray, size: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The part (first byte, past the last) of each string that can hold a window of another string of its group.

    Strings with an equal window agree on their minimizer and on all the window
    holds to its left and right.  STEPS says how far that is tested: a side
    that no other string shares up to some step cannot reach beyond it.  A part
    too short for a window is empty.  Where the minimizer occurs twice in a
    string its place is not certain, and the whole group stays.
    """
    hashes = _seed_hashes(flat.tobytes())
    count = size - SEED + 1
    first = np.cumsum(count) - count
    nth = np.arange(count.sum()) - np.repeat(first, count)
    values = hashes[np.repeat(start, count) + nth]
    least = values == np.repeat(np.minimum.reduceat(values, first), count)
    unsure = np.bincount(group, np.add.reduceat(least.astype("i8"), first) > 1)[group] > 0
    seed = np.minimum.reduceat(np.where(least, nth, LENGTH * 4), first)
    sums, power = _prefix_hash(flat)
    span = LENGTH - SEED
    reach = []
    for side in (0, 1):
        room = seed if side == 0 else size - seed - SEED
        far = np.minimum(room, span)
        for step, beyond in zip(reversed(STEPS), reversed((*STEPS[1:], span + 1)), strict=True):
            at = np.flatnonzero(room >= step)
            a = start[at] + seed[at] - (step if side == 0 else 0)
            b = start[at] + seed[at] + SEED + (step if side == 1 else 0)
            value = (sums[b] - sums[a]) * power[len(flat) - a]  # shifted to a common power
            value = (value ^ (value >> _S31)) * _C + group[at].astype("u8") * _A
            _, where, times = np.unique(value, return_inverse=True, return_counts=True)
            shared = np.zeros(len(start), bool)
            shared[at] = times[where] > 1
            if beyond > span:
                known = shared
            else:
                far = np.where(known, far, np.minimum(far, beyond - 1))
                known = known | shared
        reach.append(np.where(known, far, np.minimum(far, STEPS[0] - 1)))
    empty = (reach[0] + reach[1] < span) & ~unsure
    a = np.where(unsure, 0, seed - reach[0])
    b = np.where(unsure, size, seed + SEED + reach[1])
    return np.where(empty, 0, a), np.where(empty, 0, b)


def smallest_owners(strings: list[bytes], owners: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Per window of each string, the smallest owner among the equal windows of its group.

    ``group`` ascends.  One suffix array over all strings of a group brings
    equal windows side by side.
    """
    size = np.fromiter(map(len, strings), "i8", len(strings))
    edge = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True])
    texts = [_PART.join(strings[a:b]) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
    length = np.fromiter(map(len, texts), "i8", len(texts))
    order = np.empty(length.sum(), "i8")
    base = np.cumsum(length) - length
    batch, held = [], 0
    for t in np.argsort(length, kind="stable").tolist():  # texts of a like length side by side
        if length[t] > ALONE_BYTES:
            order[base[t] : base[t] + length[t]] = np.array(suffix_array(texts[t])) + base[t]
            continue
        batch.append(t)
        held += length[t]
        if held >= TOGETHER_BYTES:
            _sort_batch(texts, batch, base, length, order)
            batch, held = [], 0
    _sort_batch(texts, batch, base, length, order)
    # The string of each byte, where a window starts in it.
    place = np.full(length.sum() + 1, -1)
    number = np.arange(len(strings))
    at = np.cumsum(size + 1) - (size + 1) - np.searchsorted(edge, number, "right") + 1  # no separator behind a group's last
    windows = size - LENGTH + 1
    first = np.cumsum(windows) - windows
    place[_spread(at, windows)] = np.repeat(number, windows)
    order = order[place[order] >= 0]
    who = place[order]
    flat = np.frombuffer(b"".join(texts), "u1")
    view = np.lib.stride_tricks.sliding_window_view(flat, LENGTH)
    same = np.zeros(len(order), bool)
    for a in range(1, len(order), 1 << 16):
        b = min(len(order), a + (1 << 16))
        same[a:b] = (view[order[a:b]] == view[order[a - 1 : b - 1]]).all(axis=1)
    same[1:] &= group[who[1:]] == group[who[:-1]]
    run = np.flatnonzero(~same)
    low = np.repeat(np.minimum.reduceat(owners[who], run), np.diff(np.r_[run, len(order)]))
    best = np.empty(windows.sum(), "i8")
    best[first[who] + order - at[who]] = low
    return best


def _sort_batch(texts: list[bytes], batch: list[int], base: np.ndarray, length: np.ndarray, order: np.ndarray) -> None:
    if batch:
        order[_spread(base[batch], length[batch])] = suffix_arrays([texts[t] for t in batch]) + np.repeat(base[batch], length[batch])


def answer_windows(sent: DataFrame) -> DataFrame:
    """Per bucket and capsule: a bit per window that an identifier below the sender's holds."""

    def answer(group: pd.DataFrame) -> pd.DataFrame:
        number: dict[bytes, int] = {}
        ask = number.setdefault
        asked, keys = [], []
        for n, blob in zip(group["n"], group["strings"], strict=True):
            raw = zstandard.decompress(blob)
            end = 13 * n + np.cumsum(np.frombuffer(raw, "u1", n), dtype="i8")
            owners = np.frombuffer(raw, "<i8", n, 5 * n)
            cuts = [13 * n, *end.tolist()]
            mine = np.array([ask(raw[a:b], len(number)) for a, b in zip(cuts, cuts[1:], strict=False)], "i8")
            keys.append(np.frombuffer(raw, "<u4", n, n))
            asked.append((mine, owners))
        strings = list(number)
        every = np.concatenate([mine for mine, _ in asked])
        key, owner = np.empty(len(strings), "<u4"), np.full(len(strings), LAST)
        key[every] = np.concatenate(keys)
        np.minimum.at(owner, every, np.concatenate([owners for _, owners in asked]))
        size = np.fromiter(map(len, strings), "i8", len(strings))
        windows = size - LENGTH + 1
        first = np.cumsum(windows) - windows
        low = np.repeat(owner, windows)
        same = np.argsort(key, kind="stable")
        name = np.cumsum(np.r_[0, key[same][1:] != key[same][:-1]])
        several = np.bincount(name)[name] > 1
        members, name = same[several], name[several]
        if len(members):
            parts = [strings[i] for i in members.tolist()]
            n = size[members]
            a, b = shareable(np.frombuffer(b"".join(parts), "u1"), np.cumsum(n) - n, n, name)
            kept = np.flatnonzero(b > a)
            if len(kept):
                a, b, members = a[kept], b[kept], members[kept]
                parts = [parts[i][x:y] for i, x, y in zip(kept.tolist(), a.tolist(), b.tolist(), strict=True)]
                best = smallest_owners(parts, owner[members], name[kept])
                at = _spread(first[members] + a, b - a - LENGTH + 1)
                low[at] = best
        bits = []
        for mine, owners in asked:
            n = windows[mine]
            bits.append(np.packbits(low[_spread(first[mine], n)] < np.repeat(owners, n)).tobytes())
        return pd.DataFrame({"capsule": group["capsule"], "bucket": group["bucket"], "bits": bits, "n": group["n"], "places": group["places"]})

    return sent.groupBy("bucket").applyInPandas(answer, "capsule string, bucket int, bits binary, n int, places binary")


def removal(capsule: Capsule, answers: list) -> np.ndarray:
    """Whether each byte of the capsule goes."""
    total = len(capsule.text)
    whole = np.zeros(total + 1, "i4")  # opens and closes of strings that go whole
    starts = np.zeros(total, bool)
    for x in answers:
        n, raw = x["n"], zstandard.decompress(x["places"])
        windows = np.frombuffer(raw, "u1", n).astype("i8") - LENGTH + 1
        times = _from_planes(raw, n, n).astype("i8")
        place = np.cumsum(_from_planes(raw, int(times.sum()), 5 * n).view("<i4"), dtype="i8")
        which = np.repeat(np.arange(n), times)
        ids = capsule.ids[np.searchsorted(capsule.ends, place, side="right")]
        least = np.minimum.reduceat(ids, np.cumsum(times) - times)
        later = least[which] < ids
        np.add.at(whole, place[later], 1)
        np.add.at(whole, (place + windows[which])[later], -1)
        bits = np.unpackbits(np.frombuffer(x["bits"], "u1"), count=int(windows.sum())).astype(bool)
        first = np.cumsum(windows) - windows
        some = np.flatnonzero(~later & np.logical_or.reduceat(bits, first)[which])
        i = which[some]
        marked = bits[_spread(first[i], windows[i])]
        starts[_spread(place[some], windows[i])[marked]] = True
    starts |= np.cumsum(whole[:-1]) > 0
    reach = np.cumsum(starts, dtype="i8")
    reach[LENGTH:] -= reach[:-LENGTH].copy()
    return reach > 0


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, buckets: int | None = None) -> DataFrame:
    """Per row: id, n_bytes, kept bytes, and the removed spans as (start, end) byte offsets.

    A byte goes if a 50-byte string covers it that also starts in a document
    with a smaller identifier.  Strings never cross documents and are judged on
    the input.  A null text counts as empty; a null identifier comes after all
    others; rows of equal identifier do not remove each other's bytes.  Texts
    under 50 bytes lose nothing.  Other columns are ignored.
    """
    body = F.coalesce(F.col(text_col), F.lit(""))
    if buckets is None:
        total = docs.select(F.sum(F.octet_length(body).cast("long"))).first()[0] or 0
        buckets = max(16, 2 * shuffle_width(docs.sparkSession), -(-total // BUCKET_BYTES))
    source = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(int(LAST))).alias("id"), body.alias("body"))
    capsules = pack_capsules(source).repartition("capsule")
    repeats = answer_repeated(send_minimizers(capsules, buckets))
    repeats = repeats.groupBy("capsule").agg(F.collect_list(F.struct("bucket", "bits")).alias("repeats"))
    windows = answer_windows(send_strings(_with_answers(capsules, repeats, "repeats"), buckets))
    windows = windows.groupBy("capsule").agg(F.collect_list(F.struct("n", "bits", "places")).alias("windows"))

    def remove(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in _rows(batch):
                c = Capsule(row)
                covered = removal(c, row["windows"])
                out, begin = [], 0
                for doc, end in zip(c.ids.tolist(), c.ends.tolist(), strict=True):
                    kept, mine = c.text[begin:end], covered[begin:end]
                    spans = []
                    if mine.any():
                        edge = np.flatnonzero(np.diff(np.r_[False, mine, False]))
                        spans = [{"start": a, "end": b} for a, b in edge.reshape(-1, 2).tolist()]
                        kept = np.frombuffer(kept, "u1")[~mine].tobytes()
                    out.append((doc, end - begin, spans, kept))
                    begin = end
                    if len(out) == 200:
                        yield pd.DataFrame(out, columns=["id", "n_bytes", "spans", "kept"])
                        out = []
                if out:
                    yield pd.DataFrame(out, columns=["id", "n_bytes", "spans", "kept"])

    schema = "id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary"
    told = _with_answers(capsules, windows, "windows").mapInPandas(remove, schema)
    return told.withColumn("id", F.when(F.col("id") != F.lit(int(LAST)), F.col("id"))).withColumnRenamed("id", id_col)


def _with_answers(capsules: DataFrame, answers: DataFrame, name: str) -> DataFrame:
    return capsules.join(answers, "capsule", "left").withColumn(name, F.coalesce(name, F.array()))


def dedup_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the SHA-256 of the remaining bytes."""
    return repeated_spans(docs).select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


