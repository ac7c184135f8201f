"""A suffix array built in linear time from Lyndon-prefix groups.

Every suffix is grouped by its longest Lyndon prefix. Groups are worked off in descending order: when one is done, its
suffixes' nearest smaller predecessors (followed along previous-smaller pointers over all suffixes done) learn that
their own Lyndon prefixes go on by that group's, as often as it is repeated, and move to a new group just above their
old one, unless all of the old one would move alike. Nothing is renamed and no recursion is needed. A second sweep emits the order inside each group: as each suffix
is emitted in ascending order, the suffixes whose next smaller suffix it is take the next places of their groups.
"""

from __future__ import annotations


def suffix_array(text: list[int] | bytes) -> list[int]:
    """The starts of the suffixes of ``text`` in ascending order; symbols are non-negative integers."""
    n = len(text)
    if n < 2:
        return list(range(n))
    before, starts, group = _lyndon_groups(text, n)
    return _emit(n, before, starts, group)


def _lyndon_groups(text: list[int] | bytes, n: int) -> tuple[list[int], list[int], list[int]]:
    """For each suffix the previous smaller one (or -1) and its group; for each group its first place."""
    # The last group stays empty: it is what lies above the highest one.
    members: list[list[int]] = [[] for _ in range(max(text) + 2)]
    group = list(text)
    for i, symbol in enumerate(group):
        members[symbol].append(i)
    below, above = list(range(-1, len(members) - 1)), [*range(1, len(members)), -1]
    sizes = [len(m) for m in members]
    before, done = [-1] * n, bytearray(n)
    order: list[tuple[int, int]] = []
    g = len(members) - 1
    while g >= 0:
        if sizes[g] == 1:
            order.append((g, 1))
            i = next(i for i in members[g] if group[i] == g)
            p = i - 1
            while p >= 0 and done[p]:
                p = before[p]
            before[i], done[i] = p, 1
            if p >= 0 and sizes[lower := group[p]] > 1:
                new, over = len(members), above[lower]
                members.append([p])
                sizes.append(1)
                sizes[lower] -= 1
                group[p] = new
                below.append(lower)
                above.append(over)
                above[lower] = below[over] = new
        elif sizes[g]:
            held = [i for i in members[g] if group[i] == g]
            order.append((g, len(held)))
            times: dict[int, int] = {}
            for i in held:
                p = i - 1
                while p >= 0 and done[p]:
                    p = before[p]
                if p >= 0 and group[p] == g:
                    p = before[p]
                before[i] = p
                if p >= 0:
                    times[p] = times.get(p, 0) + 1
            for i in held:
                done[i] = 1
            made: dict[tuple[int, int], list[int]] = {}
            for p, m in times.items():
                made.setdefault((group[p], m), []).append(p)
            newest: dict[int, int] = {}
            for lower, m in sorted(made) if len(made) > 1 else made:
                moved = made[lower, m]
                if len(moved) == sizes[lower] and lower not in newest:
                    continue
                # Just above the old group and those with fewer repeats, below what left the old group before.
                new, under = len(members), newest.get(lower, lower)
                over = above[under]
                members.append(moved)
                sizes.append(len(moved))
                sizes[lower] -= len(moved)
                for p in moved:
                    group[p] = new
                below.append(under)
                above.append(over)
                above[under] = below[over] = newest[lower] = new
        g = below[g]
    starts, at = [0] * len(members), n
    for g, size in order:
        at -= size
        starts[g] = at
    return before, starts, group


def _emit(n: int, before: list[int], starts: list[int], group: list[int]) -> list[int]:
    """Places each suffix behind those of its group whose next smaller suffix is smaller; the empty suffix goes first."""
    array, placed = [0] * n, bytearray(n)
    i = n - 1
    while i >= 0:
        place = starts[group[i]]
        array[place] = i
        starts[group[i]] = place + 1
        placed[i] = 1
        i = before[i]
    for k in range(n):
        i = array[k] - 1
        while i >= 0 and not placed[i]:
            place = starts[group[i]]
            array[place] = i
            starts[group[i]] = place + 1
            placed[i] = 1
            i = before[i]
    return array
