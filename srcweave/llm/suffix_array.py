"""Suffix arrays of many small texts at once, by linear grouping of Lyndon prefixes."""

from __future__ import annotations

import numpy as np

from srcweave.llm.text_arrays import ragged


def lyndon_groups(symbols: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of each suffix (the place where it begins in the suffix order) and the length of its Lyndon prefix.

    ``symbols[offsets[b]:offsets[b + 1]]`` is text b; its last symbol is smaller than all others
    in it.  Suffixes start grouped by first symbol.  Groups are taken in descending order; all
    texts advance side by side, each with its highest group left.  Each suffix of the group points to
    the previous smaller one, that is the nearest before it in a group not yet taken.  That one's prefix grows by the
    group's prefix, once for each suffix that points to it, and it moves behind the rest of its
    group, further for more.
    """
    n = len(symbols)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    sa = np.lexsort((symbols, text))
    place = np.empty(n, np.int64)
    place[sa] = np.arange(n)
    first = np.ones(n, bool)
    first[1:] = (symbols[sa[1:]] != symbols[sa[:-1]]) | (text[sa[1:]] != text[sa[:-1]])
    begins = np.flatnonzero(first)
    size = np.zeros(n, np.int64)
    size[begins] = np.diff(np.append(begins, n))
    group = np.empty(n, np.int64)
    group[sa] = np.repeat(begins, size[begins])
    length = np.ones(n, np.int64)
    previous = np.arange(n) - 1
    previous[offsets[:-1]] = -1
    taken, marked = np.zeros(n, bool), np.zeros(n, bool)
    low, high = offsets[:-1].copy(), offsets[1:].copy()
    grown = np.zeros(len(low), np.int64)
    live = np.flatnonzero(high > low)
    while len(live):
        start = group[sa[high[live] - 1]]
        members = sa[ragged(start, high[live] - start)]
        grown[live] = length[sa[start]]
        taken[members] = True
        p = previous[members]
        walk = np.flatnonzero(p >= 0)
        walk = walk[taken[p[walk]]]
        while len(walk):
            p[walk] = previous[p[walk]]
            walk = walk[p[walk] >= 0]
            walk = walk[taken[p[walk]]]
        previous[members] = p
        high[live] = start
        live = live[start > low[live]]
        p = np.sort(p[p >= 0])
        if not len(p):
            continue
        new = np.flatnonzero(np.concatenate(([True], p[1:] != p[:-1])))
        times = np.diff(np.append(new, len(p)))
        p = p[new]
        length[p] += times * grown[text[p]]
        home = group[p]
        order = np.lexsort((times, home))
        p, home, times = p[order], home[order], times[order]
        at = np.flatnonzero(np.concatenate(([True], home[1:] != home[:-1])))
        count = np.diff(np.append(at, len(p)))
        homes = home[at]
        begin = homes + size[homes] - count
        target = ragged(begin, count)
        marked[p] = True
        here = sa[target]
        away = here[~marked[here]]
        marked[p] = False
        vacant = place[p]
        vacant = vacant[vacant < np.repeat(begin, count)]
        sa[vacant], place[away] = away, vacant
        sa[target], place[p] = p, target
        size[homes] -= count
        run = np.flatnonzero(np.concatenate(([True], (home[1:] != home[:-1]) | (times[1:] != times[:-1]))))
        many = np.diff(np.append(run, len(p)))
        size[target[run]] = many
        group[p] = np.repeat(target[run], many)
    return group, length


def suffix_places(symbols: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The place of each suffix in the order of its text (counted from the text's offset).

    A suffix is its Lyndon prefix and the suffix that follows.  Within a group all have the
    same prefix, so the order is that of what follows: first by how often the prefix repeats, then by
    the place of the suffix after that, which is in a lower group.  A group is emitted as soon as those
    places are known; nothing is named anew.
    """
    group, length = lyndon_groups(symbols, offsets)
    n = len(symbols)
    after = np.minimum(np.arange(n) + length, n - 1)
    same = (group[after] == group) & (np.arange(n) + length < n)
    jump, repeats = np.where(same, after, np.arange(n)), same.astype(np.int64)
    active = np.flatnonzero(same)
    while len(active):  # those that don't point to the last repeat yet
        own = jump[active]
        further = jump[own]
        more = further != own
        active, own, further = active[more], own[more], further[more]
        repeats[active], jump[active] = repeats[active] + repeats[own], further
    end = after[jump]
    members = np.bincount(group, minlength=n)
    place = np.where(members[group] == 1, group, -1)
    waiting = np.flatnonzero(place < 0)
    waiting = waiting[np.argsort(group[waiting] * n + repeats[waiting])]
    own, follows = group[waiting], end[waiting]
    while len(waiting):
        first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        count = np.diff(np.append(first, len(own)))
        behind = place[follows]
        ready = np.repeat(np.minimum.reduceat(behind, first) >= 0, count)
        now, home, behind = waiting[ready], own[ready], behind[ready]
        often = repeats[now]
        # by group, repeats and what follows; the first two are in order
        run = np.concatenate(([False], (home[1:] != home[:-1]) | (often[1:] != often[:-1])))[: len(now)]
        now = now[np.argsort(np.cumsum(run) * n + behind)]
        first = np.flatnonzero(np.concatenate(([True], home[1:] != home[:-1])))[: len(now)]
        count = np.diff(np.append(first, len(home)))
        place[now] = home + np.arange(len(now)) - np.repeat(first, count)
        waiting, own, follows = waiting[~ready], own[~ready], follows[~ready]
    return place
