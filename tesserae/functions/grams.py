"""MD5 digests of the words and word pairs of many texts at once, and the bits that most of a row's digests have, in NumPy."""

from __future__ import annotations

import hashlib

import numpy as np

# Bytes of text worked on at once, grams digested and digests unpacked at once, the longest message of one MD5 block.
PIECE, AT_ONCE, UNPACKED, BLOCK = 1 << 20, 1 << 13, 1 << 15, 55
# Fixed values of MD5: the state at first, constants, shifts, and which word of the message a step takes.
STATE = tuple(map(np.uint32, (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)))
SINES = np.floor(np.abs(np.sin(np.arange(1, 65))) * 2.0**32).astype(np.uint32)
SHIFTS = [s for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in four * 4]
TAKEN = [[i, 5 * i + 1, 3 * i + 5, 7 * i][i // 16] % 16 for i in range(64)]
BLANK = np.isin(np.arange(256), list(b" \t\n\r"))
#: By length: which bytes of a block belong to the message, and the mark behind it.
INSIDE = np.where(np.arange(64) < np.arange(BLOCK + 1)[:, None], 255, 0).astype(np.uint8).view("<u8")
MARK = np.where(np.arange(64) == np.arange(BLOCK + 1)[:, None], 128, 0).astype(np.uint8).view("<u8")


def _md5(words: np.ndarray) -> np.ndarray:
    """Digests (n, 16) of padded messages of one block, given as 16 rows of n words."""
    a, b, c, d = (np.full(words.shape[1], v) for v in STATE)
    f, g = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        if i < 32:
            x, y, z = (c, d, b) if i < 16 else (b, c, d)
            np.bitwise_xor(x, y, out=f)
            f &= z
            f ^= y
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
        f += a
        f += SINES[i]
        f += words[TAKEN[i]]
        np.right_shift(f, np.uint32(32 - SHIFTS[i]), out=g)
        f <<= np.uint32(SHIFTS[i])
        f |= g
        f += b
        a, b, c, d, f = d, f, b, c, a
    return np.stack([x + v for x, v in zip((a, b, c, d), STATE, strict=True)], axis=1).astype("<u4", copy=False).view(np.uint8)


def digests(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """MD5 (n, 16) of the given ranges of bytes; ``data`` has 64 bytes more than the ranges reach."""
    out = np.empty((len(start), 16), np.uint8)
    eights = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    for k in range(0, len(start), AT_ONCE):
        size = np.minimum(length[k : k + AT_ONCE], BLOCK)
        blocks = eights[start[k : k + AT_ONCE, None] + np.arange(0, 64, 8)]
        blocks &= INSIDE[size]
        blocks |= MARK[size]
        blocks[:, 7] |= (8 * size).astype(np.uint64)
        out[k : k + AT_ONCE] = _md5(np.ascontiguousarray(blocks.view("<u4").T))
    for k in np.flatnonzero(length > BLOCK):
        out[k] = np.frombuffer(hashlib.md5(data[start[k] : start[k] + length[k]]).digest(), np.uint8)
    return out


class Majorities:
    """Counts of the bits of digests, by row."""

    def __init__(self, rows: int) -> None:
        self.n, self.bits = np.zeros(rows, np.int64), np.zeros((rows, 128), np.int64)

    def add(self, found: np.ndarray, text: np.ndarray, row: np.ndarray) -> None:
        """Count the distinct digests of each text (numbers from 0, in order) for the row that ``row`` gives for it."""
        of = found.view("<u8")
        order = np.argsort(of[:, 0])
        order = order[np.argsort(text[order].astype(np.uint16), kind="stable")]
        of, text = of[order], text[order]
        new = np.ones(len(of), bool)
        new[1:] = (of[1:] != of[:-1]).any(axis=1) | (text[1:] != text[:-1])
        found, at = found[order[new]], row[text[new]]
        self.n += np.bincount(at, minlength=len(self.n))
        for k in range(0, len(found), UNPACKED):
            some = at[k : k + UNPACKED]
            lanes = np.unpackbits(found[k : k + UNPACKED], axis=1).view(np.uint64)
            first = np.flatnonzero(np.diff(some, prepend=-1))
            # bytes of a lane hold sums of up to 255 bits, so longer rows are summed in parts
            parts = np.union1d(first, np.arange(0, len(some), 255))
            sums = np.add.reduceat(lanes, parts, axis=0).view(np.uint8)
            self.bits[some[first]] += np.add.reduceat(sums, np.searchsorted(parts, first), axis=0, dtype=np.int64)

    def hashes(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Two numbers for each row: the bits that more than half of its digests have, of the first ``width`` bits of either half."""
        halves = np.packbits(2 * self.bits > self.n[:, None], axis=1).view(">u8") >> np.uint64(64 - width)
        return halves[:, 0].astype(np.int64), halves[:, 1].astype(np.int64)


def count(texts: list[bytes], row: np.ndarray, words: Majorities, pairs: Majorities) -> None:
    """Count the digests of the distinct words of each text, and of its distinct pairs of neighbours, joined by a blank."""
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    at = np.cumsum(sizes)
    low = 0
    while low < len(texts):
        high = max(low + 1, min(int(np.searchsorted(at, at[low] - sizes[low] + PIECE, "right")), low + 65_535))
        _count(b"\n".join(texts[low:high]) + b"\n", sizes[low:high], row[low:high], words, pairs)
        low = high


def _count(joined: bytes, sizes: np.ndarray, row: np.ndarray, words: Majorities, pairs: Majorities) -> None:
    data = np.frombuffer(joined, np.uint8)
    blank = BLANK[data]
    start, end = np.flatnonzero(np.diff(~blank, prepend=False) & ~blank), np.flatnonzero(np.diff(blank, prepend=True) & blank)
    if not len(start):
        return
    text = np.searchsorted(np.cumsum(sizes), start, "right")
    # the words with one blank behind each
    kept = ~blank
    kept[end] = True
    plain = np.concatenate([data[kept], np.zeros(64, np.uint8)])
    length = end - start
    start = np.cumsum(length + 1) - length - 1
    plain[start + length] = 32
    words.add(digests(plain, start, length), text, row)
    next_to = np.flatnonzero(text[1:] == text[:-1])
    pairs.add(digests(plain, start[next_to], length[next_to] + 1 + length[next_to + 1]), text[next_to], row)
