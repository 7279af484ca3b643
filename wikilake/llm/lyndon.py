"""Suffix arrays by linear grouping.

First phase: suffixes are grouped by their first symbol; the groups are processed in
descending order. Each suffix of a group points to its previous smaller suffix, the
nearest one to the left whose group is still open; the suffixes pointed to leave their
groups for new ones just above, those pointed to more often higher. When all groups are
processed, a group holds the suffixes that share one Lyndon prefix.

Second phase: suffixes with the same Lyndon prefix stand in the order of what follows it.
Going through the finished part of the array in order, the suffixes that end where the
current one begins are the chain of previous smaller pointers from its left neighbour;
each takes the next free place of its group. No renaming, no recursion, linear time.
"""

from __future__ import annotations

from collections.abc import Sequence


def lyndon_groups(text: Sequence[int]) -> tuple[list[int], list[int], list[int]]:
    """(group of each suffix, previous smaller suffix or -1, first place of each group)."""
    n = len(text)
    by_symbol: dict[int, list[int]] = {}
    for i, c in enumerate(text):
        by_symbol.setdefault(c, []).append(i)
    lists = [by_symbol[c] for c in sorted(by_symbol)]
    size = [len(x) for x in lists]
    group = [0] * n
    for k, x in enumerate(lists):
        for i in x:
            group[i] = k
    below = list(range(-1, len(lists) - 1))
    above = [*range(1, len(lists)), -1]
    left = list(range(-1, n))  # left[i + 1]: i while suffix i is open, else something to its left
    smaller = [-1] * n

    k = len(lists) - 1
    while k >= 0:
        mine = lists[k]
        moved: list[tuple[int, list[int]]] = []
        if size[k] == 1:
            s = mine[0]
            if group[s] != k:
                s = next(s for s in mine if group[s] == k)
            j = left[s]
            i = left[j + 1]
            while i != j:
                j, i = i, left[i + 1]
            left[s + 1] = smaller[s] = j
            if j >= 0 and size[group[j]] > 1:
                moved.append((group[j], [j]))
        else:
            if len(mine) != size[k]:
                mine = [s for s in mine if group[s] == k]
            for s in mine:
                left[s + 1] = s - 1
            count: dict[int, int] = {}
            for s in mine:
                j = s - 1
                i = left[s]
                while i != j:
                    j, i = i, left[i + 1]
                i = s
                while i != j and left[i + 1] != j:
                    left[i + 1], i = j, left[i + 1]
                smaller[s] = j
                count[j] = count.get(j, 0) + 1
            count.pop(-1, None)
            if len(count) == 1:
                for j in count:
                    moved.append((group[j], [j]))
            elif count:
                levels: dict[int, dict[int, list[int]]] = {}
                for j, c in count.items():
                    levels.setdefault(c, {}).setdefault(group[j], []).append(j)
                for c in sorted(levels, reverse=True):
                    moved.extend(levels[c].items())
        for h, suffixes in moved:  # a new group just above the old one, unless the old one goes as a whole
            n_moved = len(suffixes)
            if n_moved < size[h]:
                new, a = len(lists), above[h]
                size[h] -= n_moved
                lists.append(suffixes)
                size.append(n_moved)
                for j in suffixes:
                    group[j] = new
                above.append(a)
                below.append(h)
                above[h] = new
                if a >= 0:
                    below[a] = new
        k = below[k]

    start = [0] * len(lists)
    k, at = 0, 0
    while k >= 0 and lists:
        start[k] = at
        at += size[k]
        k = above[k]
    return group, smaller, start


def suffix_array(text: Sequence[int]) -> list[int]:
    """Starts of the suffixes in ascending order."""
    n = len(text)
    group, smaller, free = lyndon_groups(text)
    order = [-1] * n
    placed = bytearray(n + 1)  # the last one stands for "no smaller suffix"
    placed[n] = 1
    s = n - 1
    at = -1
    while True:
        while not placed[s]:
            placed[s] = 1
            k = group[s]
            p = free[k]
            order[p] = s
            free[k] = p + 1
            s = smaller[s]
        at += 1
        if at >= n:
            return order
        s = order[at] - 1
