"""The Ratcliff-Obershelp ratio of many pairs of texts at a time, in numpy.

A pair's matching characters are those of its longest common block, the first in the left text and then in the right one
among equals, and of what stands before and after it on both sides. All open stretches of a batch are searched together:
step i compares the i-th character of each left stretch with all of its right stretch and lengthens the runs that end
there. So the interpreter takes a step for each character of the longest stretch, whatever the number of pairs.
"""

from __future__ import annotations

from collections.abc import Sequence
from difflib import SequenceMatcher

import numpy as np

#: Length from which the library judges a pair: from there on it passes over frequent characters of the right text.
LONG = 200
#: Pairs searched together.
BATCH = 2048


def _codes(texts: Sequence[str], fill: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points, a row for each text filled up at its end, and lengths."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    found = np.full((len(texts), max(1, int(size.max(initial=0)))), fill, np.int32)
    found[np.arange(found.shape[1]) < size[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<i4")
    return found, size


def blocks(a: np.ndarray, b: np.ndarray, row: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start (left, right) and length of the longest common block of each stretch: of `size` (left, right) characters from `at` on, left ones longest first."""
    n, wide = len(row), int(size[:, 1].max())
    column = np.arange(wide)
    right = np.where(column < size[:, 1:], b[row[:, None], np.minimum(at[:, 1:] + column, b.shape[1] - 1)], -2)
    run = np.zeros((n, wide + 1), np.int16)  # of blocks that end at a left and a right character; none ends before the first
    best, start = np.zeros(n, np.int64), np.zeros((n, 2), np.int64)
    for i in range(int(size[0, 0])):
        m = n - int(np.searchsorted(size[::-1, 0], i, "right"))  # stretches that have an i-th character
        run[:m, 1:] = (run[:m, :-1] + np.int16(1)) * (right[:m] == a[row[:m], at[:m, 0] + i][:, None])
        j = run[:m, 1:].argmax(axis=1)
        k = run[np.arange(m), j + 1].astype(np.int64)
        more = np.flatnonzero(k > best[:m])
        best[more] = k[more]
        start[more, 0], start[more, 1] = at[more, 0] + i + 1 - k[more], at[more, 1] + j[more] + 1 - k[more]
    return start, best


def _matching(left: Sequence[str], right: Sequence[str]) -> np.ndarray:
    """Number of matching characters of each pair."""
    (a, na), (b, nb) = _codes(left, -1), _codes(right, -2)
    found = np.zeros(len(left), np.int64)
    row, at, size = np.arange(len(left)), np.zeros((len(left), 2), np.int64), np.stack([na, nb], axis=1)
    while True:
        some = size.min(axis=1) > 0
        row, at, size = row[some], at[some], size[some]
        if not len(row):
            return found
        order = np.argsort(-size[:, 0], kind="stable")
        row, at, size = row[order], at[order], size[order]
        start, best = blocks(a, b, row, at, size)
        np.add.at(found, row, best)
        hit = best > 0
        row, at, size, start, best = row[hit], at[hit], size[hit], start[hit], best[hit][:, None]
        after = start + best
        row, at, size = np.concatenate([row, row]), np.concatenate([at, after]), np.concatenate([start - at, at + size - after])


def ratios(pairs: Sequence[tuple[str, str]]) -> np.ndarray:
    """Twice the matching characters over the length of both, 1 if both are empty. Not symmetric: the order of a pair matters."""
    total = np.fromiter((len(a) + len(b) for a, b in pairs), np.int64, len(pairs))
    out = np.ones(len(pairs))
    short = np.fromiter((max(len(a), len(b)) < LONG for a, b in pairs), bool, len(pairs))
    for i in np.flatnonzero(~short).tolist():
        out[i] = SequenceMatcher(None, *pairs[i]).ratio()
    todo = np.flatnonzero(short & (total > 0))
    todo = todo[np.argsort(total[todo], kind="stable")]  # pairs of like length go together
    for k in range(0, len(todo), BATCH):
        part = todo[k : k + BATCH]
        left, right = zip(*(pairs[i] for i in part.tolist()), strict=True)
        out[part] = 2.0 * _matching(left, right) / total[part]
    return out
