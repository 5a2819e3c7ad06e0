"""Line differences by longest common subsequence."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter, defaultdict

#: Pairs of equal lines up to which a difference is the shortest possible one.
MOST_PAIRS = 4_000_000


def _trimmed(a: list[str], b: list[str]) -> tuple[int, int]:
    """How many lines a and b have in common at the beginning, and then at the end."""
    least = min(len(a), len(b))
    head = next((i for i in range(least) if a[i] != b[i]), least)
    tail = next((i for i in range(least - head) if a[-1 - i] != b[-1 - i]), least - head)
    return head, tail


def common_lines(a: list[str], b: list[str], most_pairs: int = MOST_PAIRS) -> list[tuple[int, int]]:
    """Places (in a, in b) of a longest common subsequence, ascending.

    What both begin and end with is set aside. For each line of b, the places in a that hold it are tried from the last
    to the first; ends[k] is the least place in a at which a common subsequence of k + 1 lines can end so far, found by
    bisection, and each such end remembers the one before it. Time follows the pairs of equal lines. With more than
    most_pairs of them, lines that stand several times on a side are left out of it: still a common subsequence, not always
    the longest.
    """
    head, tail = _trimmed(a, b)
    middle_a, middle_b = a[head : len(a) - tail], b[head : len(b) - tail]
    in_a, in_b = Counter(middle_a), Counter(middle_b)
    alike = sum(n * in_b[line] for line, n in in_a.items()) <= most_pairs
    places: dict[str, list[int]] = defaultdict(list)
    for i in range(len(middle_a) - 1, -1, -1):
        if alike or in_a[middle_a[i]] == in_b[middle_a[i]] == 1:
            places[middle_a[i]].append(i)
    ends: list[int] = []
    links: list[tuple | None] = []  # (place in a, place in b, link before) of the subsequence that ends there
    for j, line in enumerate(middle_b):
        for i in places.get(line, ()):
            k = bisect_left(ends, i)
            link = (i, j, links[k - 1] if k else None)
            if k == len(ends):
                ends.append(i)
                links.append(link)
            elif i < ends[k]:
                ends[k], links[k] = i, link
    found = []
    at = links[-1] if links else None
    while at:
        found.append((head + at[0], head + at[1]))
        at = at[2]
    end = [(len(a) - tail + i, len(b) - tail + i) for i in range(tail)]
    return [(i, i) for i in range(head)] + found[::-1] + end


def line_diff(have: list[str], want: list[str], most_pairs: int = MOST_PAIRS) -> list[tuple[str, str]]:
    """(sign, line): '-' of have, '+' of want, ' ' of both; at one place what goes stands before what comes. Blank lines
    are compared with nothing: those of want are shown as they are, those of have are not."""
    a, b = [x for x in have if x], [x for x in want if x]
    out: list[tuple[str, str]] = []
    i = j = 0

    def shown(to: int) -> None:
        """Lines of want up to the to-th that is not blank."""
        nonlocal at, j
        while j < to or (at < len(want) and not want[at] and j == to):
            out.append((" " if not want[at] else "+", want[at]))
            j += bool(want[at])
            at += 1

    at = 0
    for p, q in [*common_lines(a, b, most_pairs), (len(a), len(b))]:
        out += [("-", x) for x in a[i:p]]
        shown(q)
        if p < len(a):
            out.append((" ", a[p]))
            i, j, at = p + 1, q + 1, at + 1
    return out
