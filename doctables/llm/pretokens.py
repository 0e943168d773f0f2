"""The pieces into which byte-level vocabularies cut text before merging, found for a whole slice of texts at once.

Every character has a class (letter, number, white space, other), and where a piece begins depends on the classes beside it alone, but
for the contractions, which look three characters ahead. So the cuts are array operations. ``spaced`` is the pattern that keeps white
space (a space goes to the piece after it; the last of several white-space characters stands apart); ``bare`` drops white space, takes
digits one by one and takes contractions in either case.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

LETTER, NUMBER, OTHER, SPACE = range(4)
#: The endings of the contractions that are pieces of their own.
ENDINGS = ("s", "t", "m", "d", "re", "ve", "ll")


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of every code point."""
    import regex

    table = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, (c for c in range(0x110000) if not 0xD800 <= c < 0xE000)))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for run in regex.finditer(pattern, every):
            a, b = run.span()
            table[[ord(x) for x in every[a:b]]] = kind
    return table


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The byte position and the code point of every character of valid UTF-8."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    points = data[at].astype(np.int32)
    wide = np.flatnonzero(points >= 0x80)
    if len(wide):
        padded = np.concatenate((data, np.zeros(3, np.uint8))).astype(np.int32)
        lead, where = points[wide], at[wide]
        a, b, c = (padded[where + k] & 0x3F for k in (1, 2, 3))
        points[wide] = np.where(lead < 0xE0, (lead & 0x1F) << 6 | a, np.where(lead < 0xF0, (lead & 0x0F) << 12 | a << 6 | b, (lead & 0x07) << 18 | a << 12 | b << 6 | c))
    return at, points


def cuts(data: np.ndarray, offsets: np.ndarray, bare: bool) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions where pieces start and end. ``offsets``: where the texts begin in ``data``, and the end."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at, points = code_points(data)
    kind = classes()[points]
    n = len(at)
    first = np.zeros(n + 4, bool)
    first[np.searchsorted(at, offsets[:-1][offsets[:-1] < len(data)])] = True
    first[n:] = True
    change = np.ones(n, bool)
    change[1:] = kind[1:] != kind[:-1]
    space = kind == SPACE
    after = np.zeros(n, bool)  # behind white space of the same text
    after[1:] = space[:-1]
    after &= ~first[:n]
    if bare:
        start = (change | first[:n] | (kind == NUMBER)) & ~space
    else:
        last = np.zeros(n, bool)  # white space before a character of the same text that is none
        last[:-1] = ~space[1:] & ~first[1:n]
        joins = np.zeros(n, bool)
        joins[1:] = points[:-1] == 0x20
        start = np.where(space, change | first[:n] | last, (change | first[:n]) & ~(joins & after))
    start = np.concatenate((start, np.ones(4, bool)))
    quotes = np.flatnonzero((points == 0x27) & start[:n])
    if len(quotes):
        padded = np.concatenate((points, np.zeros(4, np.int32)))
        low = padded | 0x20 if bare else padded
        # letters beyond ASCII cannot look like an ending, since | 0x20 keeps their higher bits
        inside = lambda k: ~first[np.minimum(quotes + k, n)]
        for ending in ENDINGS:
            fits = np.ones(len(quotes), bool)
            for k, letter in enumerate(ending, 1):
                fits &= inside(k) & (low[quotes + k] == ord(letter))
            for q in quotes[fits]:
                start[q + 1] = False
                if not (bare and q + 1 + len(ending) < n and space[q + 1 + len(ending)]):
                    start[q + 1 + len(ending)] = True
    starts = np.flatnonzero(start[:n])
    if bare:
        stop = np.concatenate((start[:n] | space, [True]))
        stops = np.flatnonzero(stop)
        ends = stops[np.searchsorted(stops, starts, side="right")]
    else:
        ends = np.concatenate((starts[1:], [n]))
    at = np.concatenate((at, [len(data)]))
    return at[starts], at[ends]
