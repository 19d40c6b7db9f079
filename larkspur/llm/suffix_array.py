"""Suffix arrays of many short texts at once by linear grouping.

Phase one puts the suffixes of each text in groups that share their longest Lyndon prefix. Groups are taken in
descending order; each member's previous-smaller pointer (the nearest position before it that is in a lower
group) names the suffix whose Lyndon prefix it continues, and those suffixes leave their group for a new one
right after it, in ascending order of how many members point to them. Phase two emits the order: each suffix
that is placed lets the suffixes that end with it be placed next in their groups, along the same pointers.
Nothing is renamed and there is no recursion.

All texts advance together, one group (or one placed suffix) each per step, so that every step is a handful of
array operations over all texts.
"""

from __future__ import annotations

import numpy as np


def suffix_arrays(symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Positions of `symbols` in the order of the suffixes of each text, text after text.

    symbols: the texts one after another, each ending in its only 0, the smallest symbol. starts: where they
    begin, ending with len(symbols).
    """
    n = len(symbols)
    if not n:
        return np.zeros(0, np.int64)
    lengths = np.diff(starts)
    base = np.repeat(starts[:-1], lengths)
    group, previous, sizes = _group(symbols, starts, base)
    return _emit(starts, base, group, previous, sizes)


def _group(symbols: np.ndarray, starts: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(symbols)
    order = np.lexsort((symbols, base))
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    fresh = np.ones(n, bool)
    fresh[1:] = (symbols[order][1:] != symbols[order][:-1]) | (base[order][1:] != base[order][:-1])
    first = np.flatnonzero(fresh)
    group = np.empty(n, np.int64)  # each suffix's group, named by the group's first place
    group[order] = np.repeat(first, np.diff(np.append(first, n)))
    sizes = np.zeros(n, np.int64)
    sizes[first] = np.diff(np.append(first, n))
    previous = np.full(n, -1, np.int64)
    moving = np.zeros(n, bool)

    low, top = starts[:-1].copy(), starts[1:].copy()
    live = np.flatnonzero(top > low)
    while len(live):
        at = group[order[top[live] - 1]]
        count = top[live] - at
        top[live] = at
        live = live[at > low[live]]
        total = int(count.sum())
        places = np.arange(total) + np.repeat(at - np.cumsum(count) + count, count)
        members = order[places]
        own, floor = group[members], base[members]
        # the nearest position before that is in no higher group: higher ones know their pointers already
        p = members - 1
        todo = np.arange(total)
        while len(todo):
            q = p[todo]
            todo = todo[(q >= floor[todo]) & (group[q] > own[todo])]
            p[todo] = previous[p[todo]]
        # members of the group itself are passed over by following their own pointers
        previous[members] = p
        todo = np.flatnonzero((p >= floor) & (group[p] == own))
        while len(todo):
            p[todo] = previous[p[todo]]
            previous[members[todo]] = p[todo]
            q = p[todo]
            todo = todo[(q >= floor[todo]) & (group[q] == own[todo])]
        p = np.where(p >= floor, p, -1)
        previous[members] = p
        parents = np.sort(p[p >= 0])
        if not len(parents):
            continue
        head = np.flatnonzero(np.concatenate([[True], parents[1:] != parents[:-1]]))
        times = np.diff(np.append(head, len(parents)))
        parents = parents[head]
        old = group[parents]
        by = np.lexsort((times, old))
        parents, times, old = parents[by], times[by], old[by]
        new_old = np.concatenate([[True], old[1:] != old[:-1]])
        of = np.flatnonzero(new_old)
        leaving = np.diff(np.append(of, len(old)))
        # those that leave take their group's last places
        end = old + sizes[old]
        target = end - np.repeat(leaving, leaving) + np.arange(len(old)) - np.repeat(of, leaving)
        moving[parents] = True
        vacated = place[parents]
        vacated = np.sort(vacated[vacated < (end - np.repeat(leaving, leaving))])
        slots = np.sort(target)
        displaced = slots[~moving[order[slots]]]
        stay = order[displaced]
        order[vacated] = stay
        place[stay] = vacated
        order[target] = parents
        place[parents] = target
        moving[parents] = False
        run = np.flatnonzero(new_old | np.concatenate([[True], times[1:] != times[:-1]]))
        length = np.diff(np.append(run, len(old)))
        sizes[old[of]] -= leaving
        sizes[target[run]] = length
        group[parents] = np.repeat(target[run], length)
    return group, previous, sizes


def _emit(starts: np.ndarray, base: np.ndarray, group: np.ndarray, previous: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    n = len(base)
    out = np.full(n, -1, np.int64)
    following = np.arange(n)  # the next free place of the group that starts here
    placed = np.zeros(n, bool)
    last = starts[1:] - 1  # the suffix that is only the end symbol
    out[starts[:-1]] = last
    placed[last] = True
    lengths = np.diff(starts)
    by = np.argsort(-lengths, kind="stable")
    begin, lengths = starts[:-1][by], lengths[by]
    for t in range(int(lengths[0])):
        live = int(np.searchsorted(-lengths, -t, side="left"))  # texts longer than t
        k = out[begin[:live] + t]
        j = k - 1
        j = j[(j >= base[k])]
        while len(j):
            j = j[~placed[j]]
            g = group[j]
            slot = following[g]
            out[slot] = j
            following[g] = slot + 1
            placed[j] = True
            j = previous[j]
            j = j[j >= 0]
    return out
