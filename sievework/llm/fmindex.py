"""A compressed FM-index over sequences of word codes: a wavelet matrix of the Burrows-Wheeler transform.

Sequences are separated by sentinels, each smaller than every word and different from the others. The bits of each
level of the wavelet matrix lie packed in 64-bit words with a count for each word, so a rank is one look-up and one
population count; all look-ups are vectorised over queries.
"""

from __future__ import annotations

import numpy as np

U = np.uint64


class Bits:
    """A bit vector with constant-time ranks."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1]])
        self.zeros = len(bits) - int(bits.sum())

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones in front of each position."""
        word = at >> 6
        mask = (U(1) << (at & 63).astype(np.uint64)) - U(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, levels: int):
        self.levels: list[tuple[int, Bits]] = []
        for shift in range(levels - 1, -1, -1):
            bit = (symbols >> shift & 1).astype(bool)
            self.levels.append((shift, Bits(bit)))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    def follow(self, symbol: np.ndarray, *positions: np.ndarray) -> list[np.ndarray]:
        """Where positions of the sequence come to lie in the order of the last level, for each symbol."""
        out = list(positions)
        for shift, bits in self.levels:
            one = (symbol >> shift & 1).astype(bool)
            for i, at in enumerate(out):
                ones = bits.ones(at)
                out[i] = np.where(one, bits.zeros + ones, at - ones)
        return out


def suffix_array(codes: np.ndarray, sequence: np.ndarray, sequences: int) -> np.ndarray:
    """Suffixes in order, by prefix doubling. codes: -1 at the sentinel that ends each sequence."""
    rank = np.where(codes < 0, sequence, codes.astype(np.int64) + sequences)
    n, width = len(rank), 1
    while True:
        ahead = np.zeros(n, np.int64)
        ahead[: n - width] = rank[width:] + 1
        key = rank * (int(rank.max()) + 2) + ahead
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        fresh = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        if fresh[-1] == n - 1:
            return order
        width *= 2


class FMIndex:
    def __init__(self, codes: np.ndarray, lengths: np.ndarray):
        """codes: the words (0 ...) of all sequences one after the other; lengths: of each sequence, at least 1."""
        m = len(lengths)
        sequence = np.repeat(np.arange(m), lengths + 1)
        ends = np.cumsum(lengths + 1) - 1
        text = np.full(len(sequence), -1, np.int64)
        word = np.ones(len(sequence), bool)
        word[ends] = False
        text[word] = codes
        self.n, self.starts = len(text), ends - lengths
        order = suffix_array(text, sequence, m)
        self.sequence = sequence[order]
        transform = text[order - 1] + 1  # 0 stands for any sentinel
        symbols = int(codes.max()) + 2 if len(codes) else 1
        self.wavelet = WaveletMatrix(transform, max(1, int(symbols - 1).bit_length()))
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(text + 1, minlength=symbols))])[:symbols]
        every = np.arange(symbols)
        self.origin = self.wavelet.follow(every, np.zeros(symbols, np.int64))[0]

    def extend(self, code: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search: the suffixes that begin with the word and go on as the interval's do."""
        symbol = code + 1
        low, high = self.wavelet.follow(symbol, low, high)
        shift = self.smaller[symbol] - self.origin[symbol]
        return low + shift, high + shift

    def matches(self, codes: np.ndarray, first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search of the patterns codes[first : first + length], all at once.

        Returns the matched length counted from the pattern's end, and the interval of suffixes. A pattern is left
        alone as soon as one suffix or none is left: its matched length then says how far it came.
        """
        low = np.zeros(len(first), np.int64)
        high = np.full(len(first), self.n, np.int64)
        matched = np.zeros(len(first), np.int64)
        live = np.arange(len(first))
        for j in range(length - 1, -1, -1):
            low[live], high[live] = self.extend(codes[first[live] + j], low[live], high[live])
            found = high[live] > low[live]
            matched[live[found]] += 1
            live = live[high[live] - low[live] > 1]
            if not len(live):
                break
        return matched, low, high
