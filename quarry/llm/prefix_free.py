"""Corpus order of a set of strings by prefix-free parsing, in numpy.

A rolling hash picks triggers; a phrase reaches from one trigger to the end of
the next, or to an end of its string.  Distinct phrases are the *dictionary*,
put in order; the strings as sequences of their ranks are the *parse*.  No
suffix of a phrase that is longer than a trigger begins another one, so the
suffix array of the dictionary and that of the parse combine into the order of
all suffixes of the strings: by the suffix of the own phrase first, then by
what the parse says of the next phrase on.  Text that repeats is sorted once,
in the dictionary.  Order is needed to a depth of some bytes only, so both
arrays are built by doubling up to it.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: An odd multiplier for rolling hashes modulo 2^64, and a bit mixer.
BASE = 0x9E3779B97F4A7C15
MIX = np.uint64(0xD6E8FEB86659FD93)
#: Random-looking values of the 256 bytes, by a rule.
_BYTES = (np.arange(1, 257, dtype=np.uint64) * MIX) ^ (np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE) >> np.uint64(29))
#: Bytes of a phrase's trigger; one window in so many is one.
TRIGGER, PERIOD = 8, 32
#: Text bytes hashed at a time.
BLOCK = 1 << 20


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def rolling(text: np.ndarray, width: int) -> np.ndarray:
    """Hash of text[i : i + width] at each i, mixed so that its high bits are evenly spread."""
    powers, inverse = _powers(BASE, BLOCK + 256), _powers(pow(BASE, -1, 1 << 64), BLOCK + 256)
    out = np.empty(max(0, len(text) - width + 1), np.uint64)
    for at in range(0, len(out), BLOCK):
        part = text[at : at + BLOCK + width - 1]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTES[part] * powers[: len(part)], out=sums[1:])
        h = sums[width:] - sums[:-width]
        h *= inverse[: len(h)]
        h ^= h >> np.uint64(32)
        h *= MIX
        h ^= h >> np.uint64(29)
        out[at : at + len(h)] = h
    return out


def _ranked(key: np.ndarray) -> np.ndarray:
    """Dense ranks of ``key``, from 0."""
    order = np.argsort(key)
    own = key[order]
    out = np.empty(len(key), np.int32)
    out[order] = np.cumsum(np.concatenate(([0], own[1:] != own[:-1])))
    return out


class Dictionary:
    """Distinct phrases in lexicographic order, and the suffix array of all of them to a depth, as ranks by doubling."""

    def __init__(self, phrases: list[bytes], depth: int):
        sizes = np.fromiter(map(len, phrases), np.int64, len(phrases))
        self.start = np.cumsum(sizes) - sizes
        text = np.frombuffer(b"".join(phrases), np.uint8)
        m = len(text)
        self.left = np.repeat(self.start + sizes, sizes) - np.arange(m)
        padded = np.concatenate((text, np.zeros(7, np.uint8)))
        self.head = np.zeros(m, np.uint64)  # seven bytes, then how many of them belong to the phrase
        for j in range(7):
            self.head = self.head << np.uint64(8) | np.where(self.left > j, padded[j : j + m], 0).astype(np.uint64)
        self.head = self.head << np.uint64(8) | np.minimum(self.left, 7).astype(np.uint64)
        width, self.levels = 7, [(7, _ranked(self.head))]
        while width < depth:
            rank, step = self.levels[-1][1], min(width, depth - width)
            after = rank[np.minimum(np.arange(m) + step, m - 1)].astype(np.int64)
            rank = _ranked(rank.astype(np.int64) * (m + 1) + np.where(self.left > step, after + 1, 0))
            width += step
            self.levels.append((width, rank))
        self.depth, self.rank = width, self.levels[-1][1]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bytes that the suffixes at a and b have in common; from ``depth`` on they count as ``depth``."""
        length, on = np.zeros(len(a), np.int64), np.ones(len(a), bool)
        for width, rank in reversed(self.levels):
            x, y = np.where(on, a + length, 0), np.where(on, b + length, 0)
            same = on & (rank[x] == rank[y])
            left = self.left[x]
            length += np.where(same, np.minimum(left, width), 0)
            on &= ~(same & (left <= width)) & (length < self.depth)
        x, y = np.where(on, a + length, 0), np.where(on, b + length, 0)
        differ, same = self.head[x] ^ self.head[y], np.zeros(len(a), np.int64)
        for j in range(1, 8):
            same += differ >> np.uint64(64 - 8 * j) == 0
        return length + np.where(on, np.minimum(same, np.minimum(self.left[x], self.left[y])), 0)


def corpus_order(text: np.ndarray, start: np.ndarray, length: int, exact: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Where windows of ``length`` bytes start, in the order of their suffixes, and the bytes common with the one before.

    ``text`` holds strings one after another, ``start`` where they begin and,
    last, where they end.  Common bytes count up to ``length``; unless
    ``exact``, those under it may be given as 0.
    """
    n, ends = len(text), np.repeat(start[1:], np.diff(start))
    at = np.flatnonzero(np.arange(n) + length <= ends)
    if not len(at):
        return at, at
    # the parse: where phrases begin, and whether one is the last of its string
    trigger = np.flatnonzero(rolling(text, TRIGGER) & np.uint64(PERIOD - 1) == 0)
    trigger = trigger[trigger + TRIGGER <= ends[trigger]]
    first = np.union1d(trigger, start[:-1][np.diff(start) > 0])
    end = ends[first]
    last = np.concatenate((end[1:] != end[:-1], [True]))
    until = np.where(last, end, np.minimum(np.concatenate((first[1:], [n])) + TRIGGER, n))
    blob, codes = text.tobytes(), {}
    code = np.array([codes.setdefault(blob[b:e], len(codes)) for b, e in zip(first.tolist(), until.tolist(), strict=True)], np.int64)
    words = sorted(codes)
    rank = np.empty(len(words), np.int64)
    rank[[codes[w] for w in words]] = np.arange(len(words))
    parse = rank[code]
    dictionary = Dictionary(words, length)
    # the suffix array of the parse, as far as ``length`` bytes reach
    count = len(first)
    rest = np.repeat(np.flatnonzero(last), np.diff(np.concatenate(([-1], np.flatnonzero(last))))) - np.arange(count)
    width, levels = 1, [(1, parse + 1)]
    step = lambda w: np.minimum(np.arange(count) + w, count - 1)
    while ((rest >= width) & (first[step(width)] - first < length)).any():
        key = levels[-1][1].astype(np.int64)
        levels.append((2 * width, _ranked(key * (count + 2) + np.where(rest >= width, key[step(width)], 0)) + 1))
        width *= 2

    def common_phrases(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bytes that the parse from phrase a on and from phrase b on have in common."""
        origin, a, b, on = a, a.copy(), b.copy(), np.ones(len(a), bool)
        whole = np.zeros(len(a), bool)
        for wide, ranks in reversed(levels):
            same = on & (ranks[a] == ranks[b])
            whole |= same & (rest[a] < wide)
            on &= ~whole
            move = same & on
            a, b = a + wide * move, b + wide * move
        tail = dictionary.common(dictionary.start[parse[a]], dictionary.start[parse[b]])
        return np.where(whole, end[origin] - first[origin], first[a] - first[origin] + tail)

    own = np.searchsorted(first, at, "right") - 1
    suffix = dictionary.start[parse[own]] + at - first[own]
    left = dictionary.left[suffix]
    goes_on = (left < dictionary.depth) & ~last[own]
    follows = np.minimum(own + 1, count - 1)
    key = dictionary.rank[suffix].astype(np.int64) * (count + 2) + np.where(goes_on, levels[-1][1][follows], 0)
    order = np.argsort(key)
    a, b = order[:-1], order[1:]
    common = np.full(len(a), length, np.int64)
    differ = key[a] != key[b]
    phrase = dictionary.rank[suffix[a]] != dictionary.rank[suffix[b]]
    some = np.flatnonzero(differ & phrase)
    # windows that differ in the dictionary do so within its depth, which is ``length``
    common[some] = dictionary.common(suffix[a[some]], suffix[b[some]]) if exact or dictionary.depth != length else 0
    some = np.flatnonzero(differ & ~phrase)
    both = goes_on[a[some]] & goes_on[b[some]]
    more = np.where(both, common_phrases(follows[a[some]], follows[b[some]]) - TRIGGER, 0)
    common[some] = left[a[some]] + more
    return at[order], np.concatenate(([0], np.minimum(common, length)))


def window_classes(text: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """For each byte of ``text`` the class of the window that starts there, -1 if none does: equal windows, equal classes."""
    out = np.full(len(text), -1, np.int64)
    order, common = corpus_order(text, start, length, exact=False)
    out[order] = np.cumsum(common < length)
    return out
