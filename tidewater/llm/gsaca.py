"""Suffix arrays of many short texts at once, by linear grouping.

Baier's construction sorts suffixes in two phases without renaming or recursion. Phase one keeps the
suffixes in groups that share a Lyndon prefix and visits the groups in descending order. For each
suffix of the group it finds the nearest earlier suffix that is in a smaller group (its previous-smaller
pointer); suffixes so pointed at are moved behind their group, more often pointed at further behind. Phase
two walks the suffix array from its least entry and emits the order within each group: the suffix before
an entry, and those its pointers lead to, take the next free places of their groups.

All texts ("lanes") go through the same steps together, one group (phase one) or one entry (phase two)
of each lane at a time, so every step is a vector operation over lanes and the work stays linear.
"""

from __future__ import annotations

import numpy as np


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The ranges starts[i] .. starts[i] + lengths[i], one after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


def suffix_arrays(letters: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each lane letters[offsets[i]:offsets[i + 1]] the places of its suffixes in ascending order.

    Every lane ends with its least letter, which stands nowhere else in it. Places are those in
    `letters`; lane i's order stands in the result where lane i stands in letters.
    """
    n, lanes = len(letters), len(offsets) - 1
    if not n:
        return np.zeros(0, np.int64)
    lane = np.repeat(np.arange(lanes), np.diff(offsets))
    low = offsets[:-1][lane]
    # the first groups: suffixes of a lane by their first letter; a group is named by its first slot
    key = lane * (int(letters.max()) + 1) + letters
    slots = np.argsort(key, kind="stable")
    new = np.ones(n, bool)
    new[1:] = key[slots[1:]] != key[slots[:-1]]
    first = np.flatnonzero(new)
    group_of_slot = first[np.cumsum(new) - 1]
    group = np.empty(n, np.int64)
    group[slots] = group_of_slot
    slot = np.empty(n, np.int64)
    slot[slots] = np.arange(n)
    start_of_end = np.zeros(n + 1, np.int64)
    last = np.append(first[1:], n)
    start_of_end[last] = first
    end_of = np.zeros(n + 1, np.int64)
    end_of[first] = last
    prev = np.full(n, -1, np.int64)
    taken = np.zeros(n, bool)

    cursor = offsets[1:].copy()
    active = np.flatnonzero(cursor > offsets[:-1])
    while len(active):
        begin = start_of_end[cursor[active]]
        members = slots[ragged(begin, cursor[active] - begin)]
        cursor[active] = begin
        active = active[begin > offsets[:-1][active]]
        own = group[members]
        # nearest earlier suffix in this group or a smaller one: pointers skip what stands in greater groups
        p = members - 1
        open_ = np.flatnonzero((p >= low[members]))
        p[p < low[members]] = -1
        while len(open_):
            q = p[open_]
            greater = group[q] > own[open_]
            open_ = open_[greater]
            p[open_] = prev[q[greater]]
            open_ = open_[p[open_] >= 0]
        # suffixes of this group point on to where their own pointer leads
        prev[members] = p
        inside = np.flatnonzero(p >= 0)
        inside = inside[group[p[inside]] == own[inside]]
        while len(inside):
            prev[members[inside]] = prev[prev[members[inside]]]
            p = prev[members[inside]]
            keep = p >= 0
            keep[keep] = group[p[keep]] == own[inside[keep]]
            inside = inside[keep]
        target = prev[members]
        target = target[target >= 0]
        if not len(target):
            continue
        target.sort()
        lead = np.ones(len(target), bool)
        lead[1:] = target[1:] != target[:-1]
        at = np.flatnonzero(lead)
        target, times = target[at], np.diff(np.append(at, len(lead)))
        old = group[target]
        order = np.lexsort((times, old))
        target, times, old = target[order], times[order], old[order]
        fresh = np.ones(len(target), bool)
        fresh[1:] = old[1:] != old[:-1]
        heads = np.flatnonzero(fresh)
        sizes = np.diff(np.append(heads, len(target)))
        end = end_of[old[heads]]
        tail = end - sizes
        places = ragged(tail, sizes)
        # what stands in the tail and stays in the old group changes places with what leaves it
        where = slot[target]
        taken[where] = True
        displaced = places[~taken[places]]
        taken[where] = False
        vacated = np.sort(where[where < np.repeat(tail, sizes)])
        movers = slots[displaced]
        slots[vacated] = movers
        slot[movers] = vacated
        slots[places] = target
        slot[target] = places
        # one new group for each old group and number of times
        cut = fresh.copy()
        cut[1:] |= times[1:] != times[:-1]
        parts = np.flatnonzero(cut)
        part_start = places[parts]
        part_end = part_start + np.diff(np.append(parts, len(target)))
        group[target] = np.repeat(part_start, part_end - part_start)
        left = tail > old[heads]
        start_of_end[tail[left]] = old[heads][left]
        end_of[old[heads][left]] = tail[left]
        start_of_end[part_end] = part_start
        end_of[part_start] = part_end

    out = np.full(n, -1, np.int64)
    filled = np.zeros(n, np.int64)
    out[offsets[:-1][np.diff(offsets) > 0]] = offsets[1:][np.diff(offsets) > 0] - 1
    placed = np.zeros(n, bool)
    placed[offsets[1:][np.diff(offsets) > 0] - 1] = True
    lengths = np.diff(offsets)
    running = np.flatnonzero(lengths)
    for k in range(int(lengths.max())):
        running = running[lengths[running] > k]
        base = offsets[:-1][running]
        j = out[base + k] - 1
        alive = np.flatnonzero(j >= base)
        j, base = j[alive], base[alive]
        while len(j):
            open_ = ~placed[j]
            j, base = j[open_], base[open_]
            if not len(j):
                break
            g = group[j]
            out[g + filled[g]] = j
            filled[g] += 1
            placed[j] = True
            j = prev[j]
            keep = j >= 0
            j, base = j[keep], base[keep]
    return out
