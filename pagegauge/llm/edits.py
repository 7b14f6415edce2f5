"""Whether two lines lie within a number of edits of single characters: cheap bounds from both sides first, then the distance itself.

``signs`` counts the characters of a line in 32 classes; an edit changes two classes by one, so lines whose counts differ by more are further apart.
``within`` is exact: what its bounds leave open is settled by Myers' bit-parallel distance, one step a character of the longer text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

CLASSES = 32
#: Characters of the pieces that are looked up in the other text, and words that a change may span in the upper bound.
_PIECE, _REACH = 7, 8


def signs(lines: pa.Array) -> pa.Array:
    """Of each line the number of its characters of each class, at most 255, a byte each."""
    n = len(lines)
    lines = pa.concat_arrays([lines.cast(pa.string())])
    at = np.frombuffer(lines.buffers()[1], np.int32)[lines.offset : lines.offset + n + 1] if n else np.zeros(1, np.int32)
    text = np.frombuffer(lines.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    # the first byte of each character tells its class
    counted = np.flatnonzero((text & 0xC0) != 0x80)
    row = np.repeat(np.arange(n), np.diff(at))[counted]
    counts = np.minimum(np.bincount(row * CLASSES + (text[counted] & (CLASSES - 1)), minlength=n * CLASSES), 255).astype(np.uint8)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * CLASSES), pa.py_buffer(counts)])


def at_least(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Edits that lie between the lines of these signs, at least."""
    counts = [np.frombuffer(b"".join(x.to_pylist()), np.uint8).reshape(-1, CLASSES).astype(np.int16) for x in (a, b)]
    more = counts[0] - counts[1]
    return np.maximum(np.maximum(more, 0).sum(axis=1), np.maximum(-more, 0).sum(axis=1))


def _same_begin(a: str, b: str) -> int:
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def _at_most(x: list[str], y: list[str], most: int) -> int:
    """Edits that make one row of words the other, found by meeting again at the next two words in common; no fewer than needed."""
    i = j = edits = 0
    while i < len(x) and j < len(y):
        if x[i] == y[j]:
            i, j = i + 1, j + 1
            continue
        for p, q in _STEPS:
            if x[i + p : i + p + 2] == y[j + q : j + q + 2] and i + p < len(x) and j + q < len(y):
                break
        else:
            break
        # words with the blanks between; where one side has none, a blank goes with each word
        edits += max(sum(map(len, x[i : i + p])) + p, sum(map(len, y[j : j + q])) + q)
        i, j = i + p, j + q
        if edits > most:
            return edits
    return edits + max(sum(map(len, x[i:])) + len(x) - i, sum(map(len, y[j:])) + len(y) - j)


_STEPS = sorted(((p, q) for p in range(_REACH) for q in range(_REACH) if p or q), key=lambda s: (max(s), sum(s)))


def _distance(a: str, b: str, most: int) -> int:
    """The edits, or some number above ``most``; bit i of the numbers is row i of a column of the table."""
    where: dict[str, int] = {}
    for i, sign in enumerate(b):
        where[sign] = where.get(sign, 0) | 1 << i
    full, last = (1 << len(b)) - 1, len(b) - 1
    up, down, edits, left = full, 0, len(b), len(a)
    for sign in a:
        eq = where.get(sign, 0)
        d = (((eq & up) + up) ^ up) | eq | down
        plus, minus = down | full & ~(d | up), d & up
        edits += (plus >> last & 1) - (minus >> last & 1)
        left -= 1
        if edits - left > most:
            return edits - left
        plus, minus = (plus << 1 | 1) & full, minus << 1 & full
        up, down = minus | full & ~(d | plus), plus & d
    return edits


def within(a: str, b: str, most: int) -> bool:
    if abs(len(a) - len(b)) > most:
        return False
    at = _same_begin(a, b)
    a, b = a[at:], b[at:]
    at = _same_begin(a[::-1], b[::-1])
    a, b = a[: len(a) - at], b[: len(b) - at]
    if len(a) < len(b):
        a, b = b, a
    if len(a) <= most:
        return True
    # an edit spoils one piece at most; the others stand in the other text, no further away than the edits allow
    pieces = len(a) // _PIECE
    if pieces > most:
        missed = 0
        for i in range(0, pieces * _PIECE, _PIECE):
            missed += b.find(a[i : i + _PIECE], max(0, i - most), i + _PIECE + most) < 0
            if missed > most:
                return False
    return _at_most(a.split(" "), b.split(" "), most) <= most or _distance(a, b, most) <= most
