"""Suffix order of an integer string by linear grouping, and what follows from it.

Suffixes are grouped by their Lyndon prefix: groups are taken in descending order, every member points to the nearest
earlier suffix of a lower group, and the suffixes pointed to are moved behind their own group, those with more pointers
further up. When all groups are done the order is emitted from the smallest suffix on: whoever precedes an emitted
suffix is next in its group, and so is the chain of its pointers. Nothing is renamed or solved again.
"""

from __future__ import annotations


def suffix_order(symbols: list[int]) -> list[int]:
    """Starts of all suffixes in ascending order; a suffix that is a prefix of another is the smaller."""
    n = len(symbols)
    if n < 2:
        return list(range(n))
    # ``slots`` lists suffixes by group, ``where`` is its inverse, ``group`` a suffix's group by its first slot.
    slots = sorted(range(n), key=symbols.__getitem__)
    where, group, end = [0] * n, [0] * n, {}
    first = 0
    for at, s in enumerate(slots):
        if symbols[s] != symbols[slots[first]]:
            first = at
        where[s], group[s] = at, first
        end[first] = at + 1
    before = [-1] * n
    top = n
    while top:
        own = group[slots[top - 1]]
        if top - own == 1:
            # A group of one points at one suffix, which moves alone.
            p = slots[own] - 1
            while p >= 0 and group[p] >= own:
                p = before[p]
            before[slots[own]] = p
            if p >= 0:
                old = group[p]
                stop = end[old]
                new = stop - 1
                if new != old:
                    at, other = where[p], slots[new]
                    slots[at], where[other] = other, at
                    slots[new], where[p] = p, new
                    group[p] = new
                    end[old], end[new] = new, stop
            top = own
            continue
        pointed: dict[int, int] = {}
        for s in sorted(slots[own:top]):
            p = s - 1
            while p >= 0 and group[p] >= own:
                p = before[p]
            before[s] = p
            if p >= 0:
                pointed[p] = pointed.get(p, 0) + 1
        by_count: dict[int, dict[int, list[int]]] = {}
        for p, times in pointed.items():
            by_count.setdefault(times, {}).setdefault(group[p], []).append(p)
        for times in sorted(by_count, reverse=True):
            for old, moved in by_count[times].items():
                stop = end[old]
                new = stop - len(moved)
                if new == old:
                    continue
                for k, p in enumerate(moved):
                    at, other = where[p], slots[stop - 1 - k]
                    slots[at], where[other] = other, at
                    slots[stop - 1 - k], where[p] = p, stop - 1 - k
                    group[p] = new
                end[old], end[new] = new, stop
        top = own
    # The empty suffix comes first; its predecessor and the chain of pointers from there open the order.
    order, free, placed = [-1] * n, {g: g for g in end}, [False] * n
    at, p = 0, n - 1
    while True:
        while p >= 0 and not placed[p]:
            g = group[p]
            order[free[g]] = p
            free[g] += 1
            placed[p] = True
            p = before[p]
        if at == n:
            return order
        p = order[at] - 1
        at += 1


def common_prefixes(symbols: list[int], order: list[int]) -> list[int]:
    """For each place in the order but the first, how many symbols its suffix shares with the one before it."""
    n = len(symbols)
    place, shared, h = [0] * n, [0] * n, 0
    for at, s in enumerate(order):
        place[s] = at
    for s in range(n):
        if place[s] == 0:
            h = 0
            continue
        t = order[place[s] - 1]
        while s + h < n and t + h < n and symbols[s + h] == symbols[t + h]:
            h += 1
        shared[place[s]] = h
        h = max(0, h - 1)
    return shared


def longest_earlier(symbols: list[int]) -> list[int]:
    """For each place, the length of the longest match that starts at an earlier place.

    Suffixes leave the order from the last start on, so the neighbours of the next one all start earlier.
    """
    n = len(symbols)
    order = suffix_order(symbols)
    shared = [*common_prefixes(symbols, order), 0]
    place = [0] * n
    for at, s in enumerate(order):
        place[s] = at
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    best = [0] * n
    for s in range(n - 1, -1, -1):
        at = place[s]
        before, after = left[at], right[at]
        own, next_own = shared[at], shared[after]
        if before < 0:
            own = 0
        else:
            right[before] = after
        if after < n:
            left[after] = before
        if own < next_own:
            best[s] = next_own
            shared[after] = own
        else:
            best[s] = own
    return best
