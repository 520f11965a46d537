"""Suffix arrays of one shard by induced sorting, on numpy arrays.

The scans of induced sorting go bucket by bucket: what a bucket induces into others is
placed in one step, and what it induces into itself in rounds, one per repeat of its byte.
"""

from __future__ import annotations

import numpy as np


def _classify(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than its successor; the last symbol is the least."""
    n = len(text)
    less = text[:-1] < text[1:]
    differs = np.where(text[:-1] != text[1:], np.arange(n - 1, dtype=np.int32), n - 2)
    ends = np.minimum.accumulate(differs[::-1])[::-1]
    return np.r_[less[ends], True]


class _Shard:
    def __init__(self, text: np.ndarray):
        self.text = text
        self.smaller = _classify(text)
        self.lms = np.flatnonzero(self.smaller[1:] & ~self.smaller[:-1]).astype(np.int32) + 1
        self.counts = np.bincount(text, minlength=int(text.max()) + 1)
        self.ends = np.cumsum(self.counts)
        self.heads = self.ends - self.counts

    def _place(self, sa, found, at, step: int) -> None:
        """Append suffixes to the buckets of their first symbols, in order, to the right or left."""
        symbols = self.text[found]
        order = np.argsort(symbols, kind="stable")
        symbols, found = symbols[order], found[order]
        firsts = np.flatnonzero(np.r_[True, symbols[1:] != symbols[:-1]])
        sizes = np.diff(np.r_[firsts, len(symbols)])
        rank = np.arange(len(symbols)) - np.repeat(firsts, sizes)
        sa[at[symbols] + step * rank] = found
        at[symbols[firsts]] += step * sizes

    def induce(self, lms: np.ndarray) -> np.ndarray:
        """The suffix array, given the leftmost-smaller suffixes in order."""
        text, smaller = self.text, self.smaller
        sa = np.full(len(text), -1, np.int32)
        per = np.bincount(text[lms], minlength=len(self.counts))
        lms_of = np.split(lms, np.cumsum(per)[:-1])
        used = np.flatnonzero(self.counts)
        at = self.heads.copy()
        for c in used:  # larger types, from left to right
            start, out = self.heads[c], []
            while start < at[c]:
                wave = sa[start:at[c]]
                start = at[c]
                before = wave[wave > 0] - 1
                before = before[~smaller[before]]
                same = text[before] == c
                again = before[same]
                sa[start:start + len(again)] = again
                at[c] += len(again)
                out.append(before[~same])
            before = lms_of[c][lms_of[c] > 0] - 1
            out.append(before)
            found = np.concatenate(out)
            if len(found):
                self._place(sa, found, at, 1)
        larger_ends = at
        at = self.ends - 1
        for c in used[::-1]:  # smaller types, from right to left
            start, out = self.ends[c] - 1, []
            while start > at[c]:
                wave = sa[at[c] + 1:start + 1][::-1]
                start = at[c]
                before = wave[wave > 0] - 1
                before = before[smaller[before]]
                same = text[before] == c
                again = before[same]
                sa[start - len(again) + 1:start + 1] = again[::-1]
                at[c] -= len(again)
                out.append(before[~same])
            wave = sa[self.heads[c]:larger_ends[c]][::-1]
            before = wave[wave > 0] - 1
            out.append(before[smaller[before]])
            found = np.concatenate(out)
            if len(found):
                self._place(sa, found, at, -1)
        sa[0] = len(text) - 1
        return sa

    def names(self, order: np.ndarray) -> np.ndarray:
        """Of the leftmost-smaller substrings in text order, given these in sorted order."""
        text, n = self.text, len(self.text)
        place = np.full(n, -1, np.int32)
        place[self.lms] = np.arange(len(self.lms))
        length = np.diff(np.r_[self.lms, n]) + 1
        at = place[order]
        a, b = order[:-1], order[1:]
        new = length[at[:-1]] != length[at[1:]]
        alive, depth = np.flatnonzero(~new), 0
        while len(alive):
            alive = alive[length[at[alive]] > depth]
            inside = np.minimum(a[alive] + depth, n - 1), np.minimum(b[alive] + depth, n - 1)
            differs = text[inside[0]] != text[inside[1]]
            new[alive[differs]] = True
            alive = alive[~differs]
            depth += 1
        named = np.empty(len(order), np.int64)
        named[at] = np.r_[0, np.cumsum(new)]
        return named


def _sorted_names(names: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of a string of names, by at least so many names.

    Recursive: pairs of names are named in turn, which doubles the length that a name
    stands for. (A scan of one bucket per name would be slow here.)
    """
    if depth <= 1 or len(names) == names.max() + 1:
        return names
    return _doubled(names, 1, depth)


def _doubled(names: np.ndarray, span: int, depth: int) -> np.ndarray:
    if span >= depth or names.max() + 1 == len(names):
        return names
    after = np.r_[names[span:], np.full(min(span, len(names)), -1)][:len(names)] + 1
    pairs = names * (len(names) + 1) + after
    order = np.argsort(pairs, kind="stable")
    ranked = np.empty(len(names), np.int64)
    sorted_pairs = pairs[order]
    ranked[order] = np.cumsum(np.r_[False, sorted_pairs[1:] != sorted_pairs[:-1]])
    return _doubled(ranked, 2 * span, depth)


def suffix_array(data: bytes, depth: int) -> np.ndarray:
    """Starts of the suffixes of ``data``, sorted by their first ``depth`` bytes at least."""
    text = np.empty(len(data) + 1, np.int16)
    text[:-1] = np.frombuffer(data, np.uint8)
    text[:-1] += 1
    text[-1] = 0
    if len(text) < 3:
        return np.arange(len(data), dtype=np.int32)
    shard = _Shard(text)
    first = shard.lms[np.argsort(text[shard.lms], kind="stable")]
    sa = shard.induce(first)
    is_lms = np.zeros(len(text), bool)
    is_lms[shard.lms] = True
    names = shard.names(sa[is_lms[sa]])
    # two such substrings start at least two bytes apart
    ranks = _sorted_names(names, depth // 2 + 1)
    return shard.induce(shard.lms[np.argsort(ranks, kind="stable")])[1:]


def words_at(data: bytes | memoryview) -> np.ndarray:
    """The eight bytes that start at each place, for all places that have them."""
    if len(data) < 8:
        return np.empty(0, "<u8")
    return np.ndarray(len(data) - 7, "<u8", data, strides=(1,)).copy()


def reaches(words: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Whether the common prefix of the suffixes at a and b has at least ``length`` bytes."""
    alike = np.ones(len(a), bool)
    for offset in [*range(0, length - 7, 8), length - 8]:
        alive = np.flatnonzero(alike)
        alike[alive] = words[a[alive] + offset] == words[b[alive] + offset]
    return alike
