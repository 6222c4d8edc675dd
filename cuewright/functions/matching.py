"""Similarity of sequences by their longest common blocks (Ratcliff and Obershelp), without trying all pairs of places.

The similarity of two sequences is twice their matched length over their length together.
What is matched is the longest block that both hold (the earliest in the first sequence, then in
the second), and then, in the same way, what stands before it and what stands after it.

The longest block of two stretches is found in one of two ways.  Where the bits of all pairs of
places fit into BITS, each place of the first holds, as the bits of one number, the places of the
second from which ``k`` items agree; two such sets give the one for twice the length, so lengths
are doubled and then refined: as many steps as the block's length has digits.  Longer stretches use
a suffix automaton of the second, through which the first is read item by item, in time and space
in proportion to both.
"""

from __future__ import annotations

from collections.abc import Sequence

#: Bits of the sets of one length, up to which stretches are compared by sets: 2 MiB.
BITS = 1 << 24


def longest_by_sets(a: Sequence, b: Sequence) -> tuple[int, int, int]:
    """(place in a, place in b, length) of the longest common block; length 0 if there is none."""
    at: dict = {}
    for j, item in enumerate(b):
        at[item] = at.get(item, 0) | 1 << j
    none = 0
    level = [at.get(item, none) for item in a]
    if not any(level):
        return 0, 0, 0
    levels, length = [level], 1
    while any(longer := [x and x & (y >> length) for x, y in zip(level, level[length:])]):
        levels.append(longer)
        level = longer
        length *= 2
    for k in reversed(range(len(levels) - 1)):
        if any(longer := [x and x & (y >> length) for x, y in zip(level, levels[k][length:])]):
            level = longer
            length += 1 << k
    i, found = next((i, x) for i, x in enumerate(level) if x)
    return i, (found & -found).bit_length() - 1, length


def longest_by_automaton(a: Sequence, b: Sequence) -> tuple[int, int, int]:
    """As ``longest_by_sets``, in linear space.

    A state stands for the parts of ``b`` that end at the same places; ``first`` is the first such end.
    """
    follow, link, longest, first = [{}], [-1], [0], [-1]
    last = 0
    for j, item in enumerate(b):
        new = len(follow)
        follow.append({})
        link.append(0)
        longest.append(longest[last] + 1)
        first.append(j)
        state, last = last, new
        while state >= 0 and item not in follow[state]:
            follow[state][item] = new
            state = link[state]
        if state < 0:
            continue
        target = follow[state][item]
        if longest[state] + 1 != longest[target]:
            twin = len(follow)
            follow.append(dict(follow[target]))
            link.append(link[target])
            longest.append(longest[state] + 1)
            first.append(first[target])
            link[target] = twin
            while state >= 0 and follow[state].get(item) == target:
                follow[state][item] = twin
                state = link[state]
            target = twin
        link[new] = target
    state = length = 0
    best = (0, 0, 0)
    for i, item in enumerate(a):
        while state and item not in follow[state]:
            state = link[state]
            length = longest[state]
        if item in follow[state]:
            state = follow[state][item]
            length += 1
        if length > best[2]:
            best = (i - length + 1, first[state] - length + 1, length)
    return best


def blocks(a: Sequence, b: Sequence, bits: int = BITS) -> list[tuple[int, int, int]]:
    """(place in a, place in b, length) of all matched blocks in order; blocks that touch in both are one."""
    found, open_ = [], [(0, len(a), 0, len(b))]
    while open_:
        lo, hi, low, high = open_.pop()
        if lo == hi or low == high:
            continue
        x, y = a[lo:hi], b[low:high]
        i, j, length = (longest_by_sets if len(x) * len(y) <= bits else longest_by_automaton)(x, y)
        if length:
            found.append((lo + i, low + j, length))
            open_ += [(lo, lo + i, low, low + j), (lo + i + length, hi, low + j + length, high)]
    out: list[tuple[int, int, int]] = []
    for i, j, length in sorted(found):
        if out and out[-1][0] + out[-1][2] == i and out[-1][1] + out[-1][2] == j:
            out[-1] = (*out[-1][:2], out[-1][2] + length)
        else:
            out.append((i, j, length))
    return out


def matched(a: Sequence, b: Sequence, bits: int = BITS) -> int:
    """Items of all blocks that are matched."""
    return sum(length for _, _, length in blocks(a, b, bits))


def differences(a: Sequence, b: Sequence) -> list[tuple[str, int, int, int, int]]:
    """(kind, from, to, from, to) of the stretches between matched blocks: replace, delete (in a only) or insert (in b only)."""
    out, i, j = [], 0, 0
    for x, y, length in [*blocks(a, b), (len(a), len(b), 0)]:
        if i < x or j < y:
            out.append(("replace" if i < x and j < y else "delete" if i < x else "insert", i, x, j, y))
        i, j = x + length, y + length
    return out


def ratio(a: Sequence, b: Sequence) -> float:
    """Twice the matched length over the length of both; 1 where both are empty."""
    return 2 * matched(a, b) / (len(a) + len(b)) if a or b else 1.0


def edit_distance(a: Sequence, b: Sequence) -> int:
    """Levenshtein distance of two sequences of hashable items, a whole column of the table at a time.

    Neighbouring cells of the table differ by one at most, so a column is two numbers whose bits say where it
    rises and where it falls; each item of ``b`` turns them into the next column's by a few operations.
    What both begin or end with costs nothing and is left out first.
    """
    shorter = min(len(a), len(b))
    head = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), shorter)
    tail = next((i for i, (x, y) in enumerate(zip(reversed(a), reversed(b))) if x != y), shorter)
    tail = min(tail, shorter - head)
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    if not a or not b:
        return len(a) + len(b)
    at: dict = {}
    for i, item in enumerate(a):
        at[item] = at.get(item, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << len(a) - 1
    rises, falls, distance = full, 0, len(a)
    for item in b:
        equal = at.get(item, 0)
        same = ((equal & rises) + rises ^ rises | equal | falls) & full
        up = (falls | ~(same | rises)) & full
        down = same & rises
        distance += bool(up & top) - bool(down & top)
        up = (up << 1 | 1) & full
        down = down << 1 & full
        rises = (down | ~(same | up)) & full
        falls = up & same
    return distance
