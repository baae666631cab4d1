"""Suffix arrays of many short strings at once, by Lyndon-prefix groups.

Linear grouping construction. Phase 1 keeps suffixes in groups by a prefix and takes the groups from
the highest to the lowest. The members of a group point to the nearest suffix on their left that is
in a lower group (previous smaller); each suffix that is pointed to moves to a new group right above
its own, the higher the more members point to it. At the end groups are ordered and hold suffixes
with the same Lyndon prefix. Phase 2 reads the order from left to right: the suffix before the one
that was read, and those it points back to, are next in their groups. Nothing is renamed or sorted
recursively. Every string does its own step at each turn, so numpy works on all strings together.
"""

from __future__ import annotations

import numpy as np


def suffix_arrays(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For strings of non-negative integers laid end to end, each ending in its only and least element:
    the positions of all suffixes, string by string, in the order of the suffixes."""
    n = len(x)
    lengths = np.diff(np.append(starts, n))
    if not n:
        return np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(starts)), lengths)
    label, prev = _groups(x, starts, lengths, owner)
    return _order(starts, lengths, label, prev)


def _groups(x: np.ndarray, starts: np.ndarray, lengths: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where the group of each suffix begins, the previous smaller suffix of each, -1 for none)."""
    n = len(x)
    key = owner * (int(x.max()) + 1) + x
    place = np.argsort(key, kind="stable")  # suffixes, group by group
    at = np.empty(n, np.int64)
    at[place] = np.arange(n)
    new = np.concatenate([[True], key[place][1:] != key[place][:-1]])
    begins = np.flatnonzero(new)
    label = np.empty(n, np.int64)
    label[place] = begins[np.cumsum(new) - 1]
    size, first_of_end = np.zeros(n, np.int64), np.zeros(n, np.int64)
    size[begins] = np.diff(np.append(begins, n))
    first_of_end[begins + size[begins] - 1] = begins
    prev = np.full(n, -1)
    begin_of = starts[owner]
    end, active, moved = starts + lengths - 1, np.arange(len(starts)), np.zeros(n, bool)
    while len(active):
        last = end[active]
        group = first_of_end[last]
        count = last - group + 1
        index = np.repeat(group - (np.cumsum(count) - count), count) + np.arange(count.sum())
        own, mine = place[index], np.repeat(group, count)
        to = np.where(own > begin_of[own], own - 1, -1)
        prev[own] = to
        todo = np.flatnonzero((to >= 0) & (label[to] >= mine))
        while len(todo):
            to[todo] = prev[to[todo]]
            prev[own[todo]] = to[todo]
            todo = todo[(to[todo] >= 0) & (label[to[todo]] >= mine[todo])]
        to = np.sort(to[to >= 0])
        if len(to):
            f = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
            j, times = to[f], np.diff(np.append(f, len(to)))
            g = label[j]
            o = np.lexsort((times, g))
            j, times, g = j[o], times[o], g[o]
            gf = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
            gone = np.diff(np.append(gf, len(g)))
            left = size[g[gf]] - gone
            tail = np.repeat(g[gf] + left, gone)
            slot = tail + np.arange(len(g)) - np.repeat(gf, gone)
            moved[j] = True
            there = place[slot]
            out, was = there[~moved[there]], at[j]
            free = was[was < tail]
            moved[j] = False
            place[free], at[out] = out, free
            place[slot], at[j] = j, slot
            size[g[gf]] = left
            some = left > 0
            first_of_end[(g[gf] + left - 1)[some]] = g[gf][some]
            r = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (times[1:] != times[:-1])]))
            run = np.diff(np.append(r, len(g)))
            label[j] = np.repeat(slot[r], run)
            size[slot[r]] = run
            first_of_end[slot[r] + run - 1] = slot[r]
        end[active] = group - 1
        active = active[end[active] >= starts[active]]
    return label, prev


def _order(starts: np.ndarray, lengths: np.ndarray, label: np.ndarray, prev: np.ndarray) -> np.ndarray:
    out, head = np.full(len(label), -1), np.arange(len(label))
    done = np.zeros(len(label) + 1, bool)
    done[-1] = True  # what -1 points to: there is no suffix before
    stop = starts + lengths
    out[starts] = stop - 1
    done[stop - 1] = True
    head[label[stop - 1]] += 1
    i, j, begin = starts.copy(), np.where(lengths > 1, stop - 2, -1), starts.copy()
    while len(i):
        go = ~done[j]
        k = j[go]
        if len(k):
            slot = head[label[k]]
            out[slot] = k
            head[label[k]] += 1
            done[k] = True
            j[go] = prev[k]
        rest = np.flatnonzero(~go)
        if len(rest):
            i[rest] += 1
            over = i[rest] >= stop[rest]
            read = out[np.minimum(i[rest], stop[rest] - 1)]
            j[rest] = np.where(read > begin[rest], read - 1, -1)
            if over.any():
                keep = np.ones(len(i), bool)
                keep[rest[over]] = False
                i, j, begin, stop = i[keep], j[keep], begin[keep], stop[keep]
    return out
