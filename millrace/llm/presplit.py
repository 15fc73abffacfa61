"""The byte-level pre-split `'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+` as array operations."""

from __future__ import annotations

import re
import unicodedata

import numpy as np

#: Letters and numbers of Unicode 16.0 that the table of Python's own unicodedata may lack: fixed values.
NEWER_LETTERS = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389),
    (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA),
    (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]
NEWER_NUMBERS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]

LETTER, NUMBER, OTHER, BLANK, MARK = range(5)
_CLASSES: np.ndarray | None = None
#: Code points with the White_Space property: fixed values.
WHITE_SPACE = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def classes() -> np.ndarray:
    """The class of every code point."""
    global _CLASSES
    if _CLASSES is None:
        kinds = {"L": LETTER, "N": NUMBER}
        _CLASSES = np.fromiter((kinds.get(unicodedata.category(chr(i))[0], OTHER) for i in range(0x110000)), np.uint8, 0x110000)
        for kind, ranges in ((LETTER, NEWER_LETTERS), (NUMBER, NEWER_NUMBERS)):
            for low, high in ranges:
                _CLASSES[low : high + 1] = kind
        _CLASSES[WHITE_SPACE] = BLANK
    return _CLASSES


def byte_classes(data: np.ndarray) -> np.ndarray:
    """The class of each byte: that of the code point it belongs to."""
    table = classes()
    out = table[:256][data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        padded = np.concatenate([data, np.zeros(3, np.uint8)])
        size = 2 + (data[lead] >= 0xE0).astype(np.int64) + (data[lead] >= 0xF0)
        code = np.zeros(len(lead), np.int64)
        for n, keep in ((2, 0x1F), (3, 0x0F), (4, 0x07)):
            of = size == n
            if of.any():
                at = lead[of]
                value = padded[at].astype(np.int64) & keep
                for k in range(1, n):
                    value = (value << 6) | (padded[at + k] & 0x3F)
                code[of] = value
        kind = table[np.minimum(code, 0x10FFFF)]
        out[lead] = kind
        for k in range(1, 4):
            of = size > k
            at = lead[of] + k
            fits = at < len(data)
            out[at[fits]] = kind[of][fits]
    return out


def special_spans(data: np.ndarray, offsets: np.ndarray, special: bytes) -> np.ndarray:
    """Starts of a special token's string that lie within one row, as the library finds them: leftmost first, not overlapping."""
    found = np.fromiter((m.start() for m in re.finditer(re.escape(special), data.tobytes())), np.int64) if special else np.zeros(0, np.int64)
    if not len(found):
        return found
    row = np.searchsorted(offsets, found, "right") - 1
    if (found + len(special) > offsets[row + 1]).any():  # one inside a row may hide behind one that crosses rows: search row by row
        found = np.concatenate([np.fromiter((a + m.start() for m in re.finditer(re.escape(special), data[a:b].tobytes())), np.int64) for a, b in zip(offsets[:-1], offsets[1:], strict=True)])
    return found


def presplit(data: np.ndarray, offsets: np.ndarray, special: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
    """Starts of the pieces of every row (each ends where the next starts), and whether each is the special token's string."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    kind = byte_classes(data)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    edge[n] = True
    marks = special_spans(data, offsets, special)
    for k in range(len(special)) if len(marks) else ():
        kind[marks + k] = MARK
    if len(marks):
        edge[marks] = True
        edge[marks + len(special)] = True
    change = edge[:-1].copy()
    change[1:] |= kind[1:] != kind[:-1]
    first = np.flatnonzero(change)
    last = np.append(first[1:], n)
    of = kind[first]
    start = np.zeros(n, bool)
    blank = of == BLANK
    # A run of blanks is a piece; its last character leaves it for what follows in the same text.
    start[first[blank]] = True
    followed = blank & ~edge[last]
    end = last[followed]
    back = end - 1
    for _ in range(3):  # to the first byte of the last character
        back = np.where((data[back] & 0xC0) == 0x80, back - 1, back)
    start[back] = True
    # Any other run starts a piece unless a space before it does.
    solid = first[~blank]
    spaced = (solid > 0) & ~edge[solid] & (data[np.maximum(solid - 1, 0)] == 0x20)
    start[solid[~spaced]] = True
    # Contractions: a lone apostrophe that starts a piece takes one or two letters with it.
    lone = np.flatnonzero((of == OTHER) & (last - first == 1) & (data[first] == 0x27))
    if len(lone):
        at = first[lone]
        spaced = (at > 0) & ~edge[at] & (data[np.maximum(at - 1, 0)] == 0x20)
        at = at[~spaced]
        padded = np.concatenate([data, np.zeros(3, np.uint8)])
        stop = np.concatenate([edge, np.ones(3, bool)])
        a, b = padded[at + 1], padded[at + 2]
        one = np.isin(a, list(b"stmd")) & ~stop[at + 1]
        two = (((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))) & ~stop[at + 1] & ~stop[at + 2]
        for hit, size in ((at[one], 2), (at[two], 3)):
            start[hit + 1] = False
            rest = hit + size
            rest = rest[rest < n]
            start[rest[~edge[rest] & (kind[rest] == LETTER)]] = True
    starts = np.flatnonzero(start)
    return starts, kind[starts] == MARK
