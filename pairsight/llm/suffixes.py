"""Suffix sorting by grouping, in two linear phases and without renaming.

First, suffixes are grouped by the Lyndon word that they begin with. Groups start as first characters and are taken in
descending order. Every suffix of the group at hand points to the nearest suffix before it in a lower group; what that
one begins with goes on with the group's word, as often as suffixes of the group point to it. So those that are pointed
to equally often leave their group together for a new one right above it, the more often, the higher.

Then groups are put end to end, and the suffixes that stand in front of the sorted ones, with all that their pointers
lead to, take the next free place of their groups, which is the order of the suffixes in them.
"""

from __future__ import annotations


def suffix_array(text: bytes) -> list[int]:
    n = len(text)
    members: list[list[int]] = []
    by_first: list[list[int]] = [[] for _ in range(256)]
    for i, c in enumerate(text):
        by_first[c].append(i)
    group = [0] * n
    up: list[int] = []
    down: list[int] = []
    for firsts in by_first:
        if firsts:
            g = len(members)
            members.append(firsts)
            down.append(g - 1)
            up.append(g + 1)
            for i in firsts:
                group[i] = g
    if not members:
        return []
    before = [-1] * n
    done = bytearray(n)
    top = len(members) - 1
    up[top] = -1
    g = top
    while g >= 0:
        mine = [i for i in members[g] if group[i] == g]
        members[g] = mine
        if len(mine) == 1:
            i = mine[0]
            done[i] = 1
            p = i - 1
            while p >= 0 and done[p]:
                p = before[p]
            before[i] = p
            moved = {(group[p], 1): [p]} if p >= 0 else {}
        else:
            for i in mine:
                done[i] = 1
            moved = {}
            last, times = -1, 0
            for i in mine:
                p = i - 1
                while p >= 0 and done[p]:
                    p = before[p]
                before[i] = p
                if p == last:
                    times += 1
                    continue
                if last >= 0:
                    key = (group[last], times)
                    if key in moved:
                        moved[key].append(last)
                    else:
                        moved[key] = [last]
                last, times = p, 1
            if last >= 0:
                key = (group[last], times)
                if key in moved:
                    moved[key].append(last)
                else:
                    moved[key] = [last]
        # the least often pointed to come last and so lie right above the group that they leave
        for key in sorted(moved, reverse=True) if len(moved) > 1 else moved:
            low, these = key[0], moved[key]
            new = len(members)
            members.append(these)
            above = up[low]
            up.append(above)
            down.append(low)
            up[low] = new
            if above >= 0:
                down[above] = new
            for i in these:
                group[i] = new
        g = down[g]
    # phase two
    free = [0] * len(members)
    at, g = 0, 0
    while down[g] >= 0:
        g = down[g]
    while g >= 0:
        free[g] = at
        at += len(members[g])
        g = up[g]
    order = [0] * n
    placed = bytearray(n)
    i = n - 1
    for turn in range(-1, n):
        if turn >= 0:
            i = order[turn] - 1
        while i >= 0 and not placed[i]:
            placed[i] = 1
            g = group[i]
            order[free[g]] = i
            free[g] += 1
            i = before[i]
    return order
