"""Suffix arrays of many strings at once, by linear grouping construction.

Suffixes start in groups by their first symbol. Groups are processed from the largest down: every suffix of a group
points to its previous smaller suffix, and the suffixes pointed to move up inside their own groups, further the more
pointers they got. When the lowest group is done, groups are the classes of equal longest Lyndon prefixes in their
order. The array is then emitted from the smallest suffix on: the suffix before each entry, and the chain of previous
smaller suffixes behind it, take the next places of their groups. Nothing is renamed or sorted recursively.

The strings are independent lanes of one array, and every step does the next group, or the next entry, of all lanes.
"""

from __future__ import annotations

import numpy as np

PLACE = np.int32
#: With at most so many lanes left, steps over all of them cost more than plain loops.
FEW = 400


def _ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    size = hi - lo
    ends = np.cumsum(size)
    return np.repeat(lo - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)


def _group(text: np.ndarray, lane: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The start of each suffix' group, and its previous smaller suffix."""
    n = len(text)
    key = lane.astype(np.int64) * (int(text.max()) + 1) + text
    order = np.argsort(key, kind="stable").astype(PLACE)
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    del key
    end = np.zeros(n + 1, PLACE)
    end[first] = np.append(first[1:], n)
    group = np.empty(n, PLACE)
    group[order] = np.repeat(first, end[first] - first)
    place = np.empty(n, PLACE)
    place[order] = np.arange(n, dtype=PLACE)
    before, moved = np.full(n, -1, PLACE), np.zeros(n, bool)
    top, floor = hi.copy(), lo
    while len(top):
        g = group[order[top - 1]]
        members = order[_ranges(g, top)]
        own, least = np.repeat(g, top - g), np.repeat(floor, top - g)
        before[members] = members - 1
        open_ = np.arange(len(members))
        while len(open_):
            p = before[members[open_]]
            open_ = open_[(p >= least[open_]) & (group[p] >= own[open_])]
            before[members[open_]] = before[before[members[open_]]]
        p = before[members]
        p, hits = np.unique(p[p >= least], return_counts=True)
        if len(p):
            old = group[p]
            by = np.argsort(old.astype(np.int64) * (len(text) + 1) + hits)
            p, hits, old = p[by], hits[by], old[by]
            new_old = np.empty(len(old), bool)
            new_old[0], new_old[1:] = True, old[1:] != old[:-1]
            starts = np.flatnonzero(new_old)
            olds, count = old[starts], np.append(starts[1:], len(p)) - starts
            tail = end[olds] - count
            slots = _ranges(tail, end[olds])
            moved[p] = True
            displaced = order[slots]
            displaced = displaced[~moved[displaced]]
            holes = place[p]
            holes = holes[holes < np.repeat(tail, count)]
            moved[p] = False
            order[holes], place[displaced] = displaced, holes
            order[slots], place[p] = p, slots
            new_old[1:] |= hits[1:] != hits[:-1]
            runs = np.flatnonzero(new_old)
            run_size = np.append(runs[1:], len(p)) - runs
            end[olds] = tail
            end[slots[runs]] = slots[runs] + run_size
            group[p] = np.repeat(slots[runs], run_size)
        more = g > floor
        top, floor = g[more], floor[more]
    before[before < lo[lane]] = -1
    return group, before


def suffix_arrays(text: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Places of all suffixes, lane by lane, each lane's in ascending order.

    ``text`` holds the lanes end to end and ``start`` their bounds; each lane must end in a symbol that is smaller
    than all its others. Places count from the start of ``text``.
    """
    if len(text) >= np.iinfo(PLACE).max:
        raise ValueError("too many symbols for one array")
    lo, hi = start[:-1].astype(PLACE), start[1:].astype(PLACE)
    lane = np.repeat(np.arange(len(lo), dtype=PLACE), hi - lo)
    group, before = _group(text.astype(PLACE), lane, lo, hi)
    out = np.empty(len(text), PLACE)
    placed = np.zeros(len(text), bool)
    following = np.arange(len(text), dtype=PLACE)  # next free place of each group, by the group's start
    out[lo] = hi - 1
    placed[hi - 1] = True
    following[lo] = lo + 1
    entry, now, floor, ceil = lo.copy(), hi - 2, lo, hi
    while len(entry) > FEW:
        put = now >= floor
        put[put] = ~placed[now[put]]
        j = now[put]
        g = group[j]
        out[following[g]] = j
        following[g] += 1
        placed[j] = True
        now[put] = before[j]
        rest = ~put
        entry[rest] += 1
        live = entry < ceil
        if not live.all():
            entry, now, floor, ceil, rest = entry[live], now[live], floor[live], ceil[live], rest[live]
        now[rest] = out[entry[rest]] - 1
    for e, j, a, b in zip(entry.tolist(), now.tolist(), floor.tolist(), ceil.tolist()):
        _emit(e - a, j - a, out[a:b], *(v[a:b] - a for v in (group, before, following)), placed[a:b], a)
    return out


def _emit(entry: int, now: int, out: np.ndarray, group: np.ndarray, before: np.ndarray, following: np.ndarray, placed: np.ndarray, lo: int) -> None:
    """Go on with one lane alone, in places counted from its start."""
    places, group, before, following, placed = (out - lo).tolist(), group.tolist(), before.tolist(), following.tolist(), placed.tolist()
    while True:
        while now >= 0 and not placed[now]:
            g = group[now]
            places[following[g]] = now
            following[g] += 1
            placed[now] = True
            now = before[now]
        entry += 1
        if entry >= len(places):
            break
        now = places[entry] - 1
    out[:] = np.array(places, PLACE) + lo
