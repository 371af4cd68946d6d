"""Suffix arrays in linear grouping steps, of many short strings side by side.

Suffixes are first grouped by their Lyndon prefixes: groups are taken from the highest to the lowest,
and the suffixes that the members of a group point back to (the nearest earlier suffix of a lower
group) move up inside their own groups, the higher the more members point at them. Then each group's
order is emitted from left to right along the same pointers, so nothing is ever renamed or sorted
again. The strings are independent: each step takes the next group of every string at once, as one
set of numpy operations.
"""

from __future__ import annotations

import numpy as np


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All numbers of the ranges that begin at ``starts``, one range after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def lyndon_groups(text: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix array by groups, group of each suffix (where it begins in the array), and pointers back.

    String ``k`` is ``text[cuts[k]:cuts[k + 1]]``. Pointers of suffixes without an earlier lower one are -1.
    """
    n = len(text)
    string = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
    array = np.lexsort((text, string))
    rank = np.empty(n, np.int64)
    rank[array] = np.arange(n)
    new = np.ones(n, bool)
    new[1:] = (text[array[1:]] != text[array[:-1]]) | (string[array[1:]] != string[array[:-1]])
    begins = np.flatnonzero(new)
    group = np.full(n + 1, -1)  # the last place stands for "no suffix" and is below every group
    group[array] = np.repeat(begins, np.diff(np.append(begins, n)))
    size = np.zeros(n, np.int64)
    size[begins] = np.diff(np.append(begins, n))
    before = np.arange(-1, n - 1)
    before[cuts[:-1][np.diff(cuts) > 0]] = -1
    back = np.full(n + 1, -1)
    moved_flag = np.zeros(n, bool)
    low, end = cuts[:-1].copy(), cuts[1:].copy()
    active = np.flatnonzero(end > low)
    while len(active):
        tops = end[active]
        here = group[array[tops - 1]]
        count = tops - here
        members = array[ranges(here, count)]
        own = np.repeat(here, count)
        at = before[members]
        passed = np.flatnonzero(group[at] > own)
        while len(passed):  # over suffixes of higher groups
            at[passed] = back[at[passed]]
            passed = passed[group[at[passed]] > own[passed]]
        back[members] = at
        chained = np.flatnonzero(group[at] == own)
        while len(chained):  # over the group's own members
            at[chained] = back[at[chained]]
            back[members] = at
            chained = chained[group[at[chained]] == own[chained]]
        targets = np.sort(at[at >= 0])
        if len(targets):
            first = np.ones(len(targets), bool)
            first[1:] = targets[1:] != targets[:-1]
            begin = np.flatnonzero(first)
            targets, times = targets[begin], np.diff(np.append(begin, len(targets)))
            order = np.lexsort((times, group[targets]))
            targets, times = targets[order], times[order]
            of = group[targets]
            first = np.ones(len(targets), bool)
            first[1:] = of[1:] != of[:-1]
            begin = np.flatnonzero(first)
            many = np.diff(np.append(begin, len(targets)))
            heads = of[begin]
            slots = ranges(heads + size[heads] - many, many)
            moved_flag[targets] = True
            held = array[slots]
            held = held[~moved_flag[held]]
            places = rank[targets]
            left = places[places < np.repeat(heads + size[heads] - many, many)]
            moved_flag[targets] = False
            array[slots], rank[targets] = targets, slots
            array[left], rank[held] = held, left
            size[heads] -= many
            first[1:] |= times[1:] != times[:-1]
            begin = np.flatnonzero(first)
            many = np.diff(np.append(begin, len(targets)))
            size[slots[begin]] = many
            group[targets] = np.repeat(slots[begin], many)
        end[active] = here
        active = active[here > low[active]]
    return array, group[:n], back[:n]


def suffix_arrays(text: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """The sorted suffixes of each string, as places in ``text``; string ``k`` fills ``cuts[k]`` to ``cuts[k + 1]``.

    Every string must end with a symbol that is smaller than all others in it.
    """
    _, group, back = lyndon_groups(text, cuts)
    n = len(text)
    array = np.full(n, -1)
    free = np.arange(n)  # by group, the next place to fill
    placed = np.zeros(n + 1, bool)
    placed[n] = True  # "no suffix"
    before = np.arange(-1, n - 1)
    filled = np.diff(cuts) > 0
    low, high = cuts[:-1][filled], cuts[1:][filled]
    before[low] = -1
    array[low], placed[high - 1] = high - 1, True
    order = np.argsort(low - high, kind="stable")  # longest first
    low, sizes = low[order], (high - low)[order]
    for step in range(int(sizes[0]) if len(sizes) else 0):
        low = low[: np.searchsorted(-sizes, -step, side="left")]
        at = before[array[low + step]]
        at = at[~placed[at]]
        while len(at):
            own = group[at]
            array[free[own]] = at
            free[own] += 1
            placed[at] = True
            at = back[at]
            at = at[~placed[at]]
    return array
