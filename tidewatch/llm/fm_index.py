"""A full-text index over the word sequence of one shard, in numpy.

The shard's documents are one sequence of symbols: 0 ends it, 1 ends a document, words are
numbered from 2.  The index holds the Burrows-Wheeler transform of that sequence in a
wavelet matrix (one rank-indexed bit row per bit of a symbol), the first row of each symbol,
and every ``SAMPLE``-th text position.  ``find`` counts a phrase by backward search, one
rank per bit and word; ``locate`` walks from a row to the next sampled position.
All steps work on vectors of phrases or rows.
"""

from __future__ import annotations

import numpy as np

SAMPLE = 16

_rng = np.random.default_rng(20240131)
_BYTE_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTE_VALUE[65:91] = _BYTE_VALUE[97:123]  # A-Z count as a-z
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_powers: dict[str, np.ndarray] = {}


def _power(kind: str, base: np.uint64, n: int) -> np.ndarray:
    if kind not in _powers or len(_powers[kind]) < n:
        steps = np.full(max(n, 1 << 20), base, np.uint64)
        steps[0] = 1
        _powers[kind] = np.multiply.accumulate(steps)
    return _powers[kind][:n]


def hash_words(data: np.ndarray, text_ends: np.ndarray, is_word: np.ndarray = _IS_WORD, byte_value: np.ndarray = _BYTE_VALUE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes, first bytes and end bytes of all words of texts laid end to end."""
    inside = is_word[data]
    before = np.empty(len(data), bool)
    before[:1] = False
    before[1:] = inside[:-1]
    cuts = text_ends[(text_ends > 0) & (text_ends < len(data))]
    before[cuts] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(len(data), bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    after[cuts - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(byte_value[data] * _power("up", _BASE, len(data)), out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * _power("down", _INVERSE, len(data) + 1)[starts]
    return hashes ^ ((ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), starts, ends


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Suffixes in order, by prefix doubling; only groups still tied are sorted again."""
    n = len(symbols)
    bits = max(1, int(symbols.max()).bit_length())
    depth = max(1, min(62 // bits, n))
    key = np.zeros(n, np.int64)
    for k in range(depth):
        key <<= bits
        key[: n - k] |= symbols[k:]
    order = np.argsort(key)
    key = key[order]
    first = np.empty(n, bool)
    first[0] = True
    np.not_equal(key[1:], key[:-1], out=first[1:])
    heads = np.flatnonzero(first)
    group = np.repeat(heads, np.diff(np.append(heads, n)))
    rank = np.empty(n, np.int64)
    rank[order] = group
    tied = np.flatnonzero(np.repeat(np.diff(np.append(heads, n)) > 1, np.diff(np.append(heads, n))))
    while len(tied):
        at = order[tied]
        ahead = at + depth
        behind = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        key = rank[at] * (n + 1) + behind
        by = np.argsort(key)
        order[tied] = at = at[by]
        key = key[by]
        first = np.empty(len(key), bool)
        first[0] = True
        np.not_equal(key[1:], key[:-1], out=first[1:])
        heads = np.flatnonzero(first)
        sizes = np.diff(np.append(heads, len(key)))
        rank[at] = np.repeat(tied[heads], sizes)
        tied = tied[np.repeat(sizes > 1, sizes)]
        depth *= 2
    return order


class _Bits:
    """A bit row with constant-time rank."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.zeros(len(self.words), np.int64)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Set bits before each place."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        low = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[word] + np.bitwise_count(low)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) != 0


class FMIndex:
    """``words``: hashes of all words of the shard; ``lengths``: words per document."""

    def __init__(self, words: np.ndarray, lengths: np.ndarray):
        self.vocabulary, numbers = np.unique(words, return_inverse=True)
        self.doc_starts = np.concatenate([[0], np.cumsum(lengths + 1)])  # in the sequence, with the ends of documents
        n = len(words) + len(lengths) + 1
        symbols = np.ones(n, np.int64)
        symbols[-1] = 0
        symbols[np.arange(len(words)) + np.repeat(np.arange(len(lengths)), lengths)] = numbers + 2
        self.n = n
        order = suffix_order(symbols)
        last = symbols[order - 1]  # order 0 reads the end of the sequence
        top = len(self.vocabulary) + 2
        self.first_row = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=top))])
        sampled = order % SAMPLE == 0
        self.is_sample, self.samples = _Bits(sampled), order[sampled].astype(np.int64)
        self.rows: list[tuple[_Bits, int]] = []
        for shift in range(max(1, (top - 1).bit_length()) - 1, -1, -1):
            bits = (last >> shift) & 1 != 0
            self.rows.append((_Bits(bits), int(n - bits.sum())))
            last = np.concatenate([last[~bits], last[bits]])
        self.first_place = self._descend(np.zeros(top, np.int64), np.arange(top))

    def _descend(self, at: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Where places of the transform end up below all bit rows, on each symbol's path."""
        for level, (bits, zeros) in enumerate(self.rows):
            ones = bits.rank(at)
            up = (symbols >> (len(self.rows) - 1 - level)) & 1 != 0
            at = np.where(up, zeros + ones, at - ones)
        return at

    def _back(self, rows: np.ndarray) -> np.ndarray:
        """The row of the suffix that begins one place earlier."""
        symbols, at = np.zeros(len(rows), np.int64), rows
        for bits, zeros in self.rows:
            up, ones = bits.get(at), bits.rank(at)
            symbols = symbols * 2 + up
            at = np.where(up, zeros + ones, at - ones)
        return self.first_row[symbols] + at - self.first_place[symbols]

    def number(self, words: np.ndarray) -> np.ndarray:
        """Symbols of word hashes; -1 for words the shard does not have."""
        if not len(self.vocabulary):
            return np.full(len(words), -1)
        at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == words, at + 2, -1)

    def find(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [low, high) of phrases of one length, given as rows of symbols."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        high[(phrases < 0).any(axis=1)] = 0
        for column in range(phrases.shape[1] - 1, -1, -1):
            live = np.flatnonzero(high > low)
            if not len(live):
                break
            symbols = phrases[live, column]
            base = self.first_row[symbols] - self.first_place[symbols]
            low[live] = base + self._descend(low[live], symbols)
            high[live] = base + self._descend(high[live], symbols)
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in the sequence at which the suffixes of rows begin."""
        out, todo, rows, steps = np.empty(len(rows), np.int64), np.arange(len(rows)), rows.copy(), 0
        while len(todo):
            known = self.is_sample.get(rows)
            out[todo[known]] = self.samples[self.is_sample.rank(rows[known])] + steps
            todo, rows, steps = todo[~known], self._back(rows[~known]), steps + 1
        return out
