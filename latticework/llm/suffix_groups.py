"""Linear suffix sorting by Lyndon-prefix groups, without recursive renaming.

Suffixes start in groups by first byte.  Groups are finished from the highest
down.  Finishing one, each member looks up its previous smaller suffix (the
nearest start to its left that lies in a lower group) and lengthens that one's
Lyndon prefix: starts reached k times move into a new group just above their
old one, the more often the higher.  At the end a group holds the suffixes with
one Lyndon prefix, and one pass over the array being filled emits each group's
order: a suffix settles everything whose Lyndon prefix it follows, which is the
chain of previous smaller suffixes from its left neighbour.

``suffix_array`` sorts one text.  ``suffix_arrays`` sorts many short texts side
by side: the same steps, each taken by all texts at once.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


def suffix_array(text: bytes) -> list[int]:
    """Starts of the suffixes of ``text`` in ascending order."""
    n = len(text)
    if n < 2:
        return list(range(n))
    by_byte: dict[int, list[int]] = {}
    for i, c in enumerate(text, 1):  # starts count from 1; 0 stands below the text
        if c in by_byte:
            by_byte[c].append(i)
        else:
            by_byte[c] = [i]
    members = [by_byte[c] for c in sorted(by_byte)]
    size = [len(m) for m in members]
    lower = list(range(-1, len(members) - 1))
    upper = list(range(1, len(members) + 1))
    upper[-1] = -1
    group = [0] * (n + 1)
    for g, m in enumerate(members):
        for i in m:
            group[i] = g
    left = list(range(n + 1))  # nearest unfinished start at or before each one
    smaller = [0] * (n + 1)
    finished: list[int] = []

    now = len(members) - 1
    while now >= 0:
        if size[now] == 1:  # most groups: one member, which may lengthen one other start
            held = members[now]
            if len(held) > 1:
                members[now] = held = [i for i in held if group[i] == now]
            finished.append(now)
            i = held[0]
            left[i] = j = i - 1
            while left[j] != j:
                left[j] = j = left[left[j]]
            smaller[i] = j
            if j:
                old = group[j]
                if size[old] > 1:
                    size[old] -= 1
                    made = len(members)
                    group[j] = made
                    members.append([j])
                    size.append(1)
                    above = upper[old]
                    upper.append(above)
                    lower.append(old)
                    lower[above] = made
                    upper[old] = made
            now = lower[now]
            continue
        held = members[now]
        if len(held) > size[now]:
            members[now] = held = [i for i in held if group[i] == now]
        finished.append(now)
        for i in held:
            left[i] = i - 1
        reached: dict[int, int] = {}
        for i in held:
            j = i - 1
            while left[j] != j:
                left[j] = j = left[left[j]]
            smaller[i] = j
            if j:
                reached[j] = reached.get(j, 0) + 1
        moves: dict[tuple[int, int], list[int]] = {}
        for j, k in reached.items():
            if size[group[j]] > 1:
                at = -k, group[j]
                if at in moves:
                    moves[at].append(j)
                else:
                    moves[at] = [j]
        for at in sorted(moves) if len(moves) > 1 else moves:
            moved, old = moves[at], at[1]
            if len(moved) == size[old]:
                continue
            size[old] -= len(moved)
            made = len(members)
            for j in moved:
                group[j] = made
            members.append(moved)
            size.append(len(moved))
            above = upper[old]
            upper.append(above)
            lower.append(old)
            lower[above] = made
            upper[old] = made
        now = lower[now]

    place = [0] * len(members)
    at = 0
    for g in reversed(finished):
        place[g] = at
        at += len(members[g])
    order = [0] * n
    settled = bytearray(n + 1)
    settled[0] = 1
    s = n
    at = 0
    while True:
        while not settled[s]:
            settled[s] = 1
            g = group[s]
            order[place[g]] = s
            place[g] += 1
            s = smaller[s]
        if at == n:
            break
        s = order[at] - 1
        at += 1
    return [i - 1 for i in order]


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each range, end to end."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


def suffix_arrays(texts: Sequence[bytes]) -> np.ndarray:
    """The suffix starts of every text in ascending order, text after text.

    A text has a place per suffix and one before them that stands below it.
    Groups are ranges of ``order``, so that the members reached equally often
    move by sorting their range, and the next group down is the one before.
    """
    sizes = np.fromiter(map(len, texts), "i8", len(texts))
    base = np.cumsum(sizes + 1) - (sizes + 1)
    total = int((sizes + 1).sum())
    if total == len(texts):
        return np.zeros(0, "i8")
    below = np.zeros(total, bool)
    below[base] = True
    letters = np.zeros(total, "i8")
    letters[~below] = np.frombuffer(b"".join(texts), "u1")
    letters += np.repeat(np.arange(len(texts)) * 512, sizes + 1) + np.where(below, 0, 1)
    order = np.argsort(letters, kind="stable")
    fresh = np.r_[True, letters[order[1:]] != letters[order[:-1]]]
    at = np.flatnonzero(fresh)
    length = np.zeros(total, "i8")
    length[at] = np.diff(np.r_[at, total])
    group = np.empty(total, "i8")
    group[order] = np.repeat(at, length[at])
    left = np.arange(total)
    smaller = np.zeros(total, "i8")
    times = np.zeros(total, "i8")

    floor, end = base[sizes > 0] + 1, (base + sizes + 1)[sizes > 0]
    while len(end):
        first = group[order[end - 1]]
        i = order[_spread(first, end - first)]
        left[i] = j = i - 1
        while True:  # to the nearest unfinished start, halving the way
            k = left[j]
            if np.array_equal(k, j):
                break
            k = left[k]
            left[j] = k
            j = k
        left[i] = smaller[i] = j
        j = j[~below[j]]
        j = np.sort(j[length[group[j]] > 1])
        if len(j):
            edge = np.flatnonzero(np.r_[True, j[1:] != j[:-1]])
            reached, count = j[edge], np.diff(np.r_[edge, len(j)])
            times[reached] = count
            old = np.sort(group[reached])
            old = old[np.r_[True, old[1:] != old[:-1]]]
            place = _spread(old, length[old])
            held = order[place]
            key = np.repeat(old, length[old]) * (int(count.max()) + 1) + times[held]
            moved = np.argsort(key, kind="stable")
            held, key = held[moved], key[moved]
            order[place] = held
            edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            size = np.diff(np.r_[edge, len(key)])
            length[place[edge]] = size
            group[held] = np.repeat(place[edge], size)
            times[reached] = 0
        more = first > floor
        floor, end = floor[more], first[more]

    settled = below
    place = np.arange(total)
    done = np.zeros(total, "i8")
    s, at, stop = (base + sizes)[sizes > 0], (base + 1)[sizes > 0], (base + sizes + 1)[sizes > 0]
    while len(s):
        new = np.flatnonzero(~settled[s])
        i = s[new]
        settled[i] = True
        g = group[i]
        to = place[g]
        done[to] = i
        place[g] = to + 1
        s[new] = smaller[i]
        old = np.flatnonzero(settled[s])
        going = at[old] < stop[old]
        if not going.all():
            stay = np.ones(len(s), bool)
            stay[old[~going]] = False
            old = old[going]
            s[old] = done[at[old]] - 1
            at[old] += 1
            s, at, stop = s[stay], at[stay], stop[stay]
        else:
            s[old] = done[at[old]] - 1
            at[old] += 1
    rows = np.repeat(np.arange(len(texts)), sizes)
    return done[_spread(base + 1, sizes)] - base[rows] - 1
