"""Suffix arrays of many short strings at once, by linear grouping of suffixes by their Lyndon prefixes.

All strings advance in step: each step takes every string's highest group that isn't done yet, so numpy works
on the groups of thousands of strings, and a string costs time in proportion to its length.
"""

import numpy as np

#: symbols in one call: places are packed in 21 bits
MOST = (1 << 21) - 1


def ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """start .. end - 1 of every range in a row."""
    n = ends - starts
    upto = np.cumsum(n)
    return np.arange(upto[-1] if len(n) else 0, dtype=np.int32) + np.repeat((starts - (upto - n)).astype(np.int32), n)


def suffix_arrays(symbols: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Suffix arrays of the strings symbols[bounds[k]:bounds[k + 1]], in a row, as places in ``symbols``.

    Every string must end with a symbol that is less than all its others.
    """
    label, prev = _groups(symbols, bounds)
    return _emitted(label, prev, bounds)


def _groups(symbols: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix the first place of its Lyndon group, and the nearest suffix before it of a lower group (or -1).

    Groups are done from the highest down. The suffixes that come just before members of the group at hand, in
    lower groups, have their prefix extended by the group's: they move to the top of their groups, the more so
    the more members follow them.
    """
    n = len(symbols)
    if n > MOST:
        raise ValueError(f"{n} symbols at once; at most {MOST}")
    of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    first_of = bounds[:-1]
    array = np.lexsort((symbols, of))
    place = np.empty(n, np.int32)
    place[array] = np.arange(n)
    new = np.ones(n, bool)
    new[1:] = (symbols[array[1:]] != symbols[array[:-1]]) | (of[array[1:]] != of[array[:-1]])
    starts = np.flatnonzero(new)
    label = np.empty(n, np.int32)
    label[array] = np.repeat(starts, np.diff(np.append(starts, n)))
    size = np.zeros(n, np.int32)
    size[starts] = np.diff(np.append(starts, n))
    prev = np.full(n, -1, np.int32)
    moved = np.zeros(n, bool)
    end = bounds[1:].copy()
    active = np.flatnonzero(end > first_of)
    while len(active):
        low = label[array[end[active] - 1]]
        members = array[ranges(low, end[active])]
        mine = label[members]
        end[active] = low
        active = active[low > first_of[active]]
        # the nearest place before with a lower label, along the pointers of what is done
        at = members - 1
        at[members == first_of[of[members]]] = -1
        prev[members] = at
        going = np.flatnonzero((at >= 0) & (label[at] >= mine))
        while len(going):
            on = prev[at[going]]
            at[going] = on
            prev[members[going]] = on
            going = going[(on >= 0) & (label[on] >= mine[going])]
        at = np.sort(at[at >= 0])
        if not len(at):
            continue
        lead = np.ones(len(at), bool)
        lead[1:] = at[1:] != at[:-1]
        begin = np.flatnonzero(lead)
        times = np.diff(np.append(begin, len(at)))
        pred = at[begin]
        # by group, then times: one sort of packed words
        words = np.sort(label[pred].astype(np.int64) << 42 | times.astype(np.int64) << 21 | pred)
        pred, times, group = (words & MOST).astype(np.int32), words >> 21 & MOST, (words >> 42).astype(np.int32)
        head = np.ones(len(pred), bool)
        head[1:] = group[1:] != group[:-1]
        begin = np.flatnonzero(head)
        count = np.diff(np.append(begin, len(pred)))
        groups = group[begin]
        top = groups + size[groups] - count
        target = ranges(top, top + count)
        moved[pred] = True
        there, here = array[target], place[pred]
        out = there[~moved[there]]
        vacated = here[here < np.repeat(top, count)]
        moved[pred] = False
        array[vacated], place[out] = out, vacated
        array[target], place[pred] = pred, target
        head[1:] |= times[1:] != times[:-1]
        begin = np.flatnonzero(head)
        amount = np.diff(np.append(begin, len(pred)))
        size[groups] -= count
        size[target[begin]] = amount
        label[pred] = np.repeat(target[begin], amount)
    return label, prev


def _emitted(label: np.ndarray, prev: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The suffixes in order: from the least on, each brings those that end before it to their groups' next places."""
    n = len(label)
    array = np.full(n + 1, -1, np.int32)
    next_of = np.arange(n, dtype=np.int32)  # by a group's first place: its next free place
    placed = np.zeros(n + 1, bool)
    placed[n] = True  # what -1 points to
    before = np.arange(-1, n - 1, dtype=np.int32)
    before[bounds[:-1]] = -1
    i, stop = bounds[:-1].astype(np.int32), bounds[1:].astype(np.int32)
    array[i] = stop - 1
    placed[stop - 1] = True
    at = before[stop - 1]
    while len(i):
        settled = np.flatnonzero(placed[at])
        if len(settled):
            step = i[settled] + 1
            i[settled] = step
            at[settled] = before[array[step]]
            over = step == stop[settled]
            if over.any():
                going = np.ones(len(i), bool)
                going[settled[over]] = False
                i, stop, at = i[going], stop[going], at[going]
        fresh = np.flatnonzero(~placed[at])
        put = at[fresh]
        group = label[put]
        slot = next_of[group]
        array[slot] = put
        next_of[group] = slot + 1
        placed[put] = True
        at[fresh] = prev[put]
    return array[:n]
