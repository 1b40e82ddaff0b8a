"""Vectorised text kernels over Arrow string buffers: words, lines, span hashes, n-gram features.

A word is a run of bytes other than space and \\x09-\\x0D, so words can be found in the UTF-8 bytes of a whole batch
at once. All functions see whole texts; a batch is cut only between rows.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
_rng = np.random.default_rng(20240229)
BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
STEP = np.uint64(0x9E3779B97F4A7C15)
U = np.uint64
_spots = np.ones(1, np.uint64)


def spots(n: int) -> np.ndarray:
    """An odd factor for each place of a span, n of them at least. They follow no rule that texts could follow, too:
    with powers of one number, texts that swap two parts by a regular pattern meet modulo 2 ** 64."""
    global _spots
    if len(_spots) < n:
        _spots = mix(np.arange(1, max(2 * n, 4096) + 1, dtype=np.uint64) * STEP) | U(1)
    return _spots


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    h = (h ^ (h >> U(33))) * U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


def buffers(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the offsets (from 0) of a string array without nulls."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type) else np.int32
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(array.buffers()[1], kind)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    data = array.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of non-empty byte spans. Where an equal hash decides, compare the bytes (``equal_spans``)."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    total = int(lengths.sum())
    kind = np.int32 if len(data) < 2**31 and total < 2**31 else np.int64
    place = np.arange(total, dtype=kind) - np.repeat(first.astype(kind), lengths)
    value = BYTE[data[np.repeat(starts.astype(kind), lengths) + place]]
    value *= spots(int(lengths.max()))[place]
    return mix(np.add.reduceat(value, first) + lengths.astype(np.uint64))


def spread(counts: np.ndarray) -> np.ndarray:
    """0 ... c - 1 for each count c, one after the other."""
    cuts = np.concatenate([[0], np.cumsum(counts)])
    return np.arange(cuts[-1]) - np.repeat(cuts[:-1], counts)


def equal_spans(data: np.ndarray, a: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_end: np.ndarray) -> np.ndarray:
    """True where two byte spans hold the same bytes."""
    size = a_end - a
    out = size == b_end - b
    at = np.flatnonzero(out & (size > 0))
    if len(at):
        n = size[at]
        step = spread(n)
        same = data[np.repeat(a[at], n) + step] == data[np.repeat(b[at], n) + step]
        out[at] = np.logical_and.reduceat(same, np.cumsum(n) - n)
    return out


def twins(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Neighbours of equal key, in order of the keys: of each run all but the last, and all but the first."""
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        none = np.zeros(0, np.int64)
        return none, none
    at = np.flatnonzero(twice[np.minimum(np.searchsorted(twice, keys), len(twice) - 1)] == keys)  # few, as a rule
    at = at[np.argsort(keys[at], kind="stable")]
    same = np.flatnonzero(keys[at][1:] == keys[at][:-1])
    return at[same], at[same + 1]


class Words:
    """The words of a batch of texts: byte spans, row of each word, first word of each row."""

    def __init__(self, array: pa.Array, inside: np.ndarray | None = None):
        """inside: a table over byte values, True in words; by default all but white space."""
        self.data, self.offsets = buffers(array)
        self.rows = len(self.offsets) - 1
        inner = ~SPACE[self.data] if inside is None else inside[self.data]
        n = len(inner)
        begins = np.zeros(n + 1, bool)
        begins[self.offsets] = True
        before = np.concatenate([[False], inner[:-1]]) if n else inner
        after = np.concatenate([inner[1:], [False]]) if n else inner
        self.starts = np.flatnonzero(inner & (~before | begins[:n]))
        self.ends = np.flatnonzero(inner & (~after | begins[1 : n + 1])) + 1
        self.first = np.searchsorted(self.starts, self.offsets)
        self.count = np.diff(self.first)
        self.row = np.repeat(np.arange(self.rows), self.count)
        self._hash: np.ndarray | None = None

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            self._hash = spans_hash(self.data, self.starts, self.ends)
        return self._hash

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of k consecutive words of one row, and the index of the first word of each."""
        h = self.hash
        if len(h) < k:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.row[: len(h) - k + 1] == self.row[k - 1 :])
        out = np.zeros(len(at), np.uint64)
        for j in range(k):
            out = out * STEP + h[at + j]
        return mix(out), at


def per_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values over [offsets[i], offsets[i + 1])."""
    if values.dtype.kind == "f":  # differences of running sums would lose digits
        out = np.zeros(len(offsets) - 1, values.dtype)
        some = offsets[1:] > offsets[:-1]
        if some.any():
            out[some] = np.add.reduceat(values, offsets[:-1][some])
        return out
    total = np.concatenate([[0], np.cumsum(values)])
    return total[offsets[1:]] - total[offsets[:-1]]


def base_counts(array: pa.Array, words: Words | None = None) -> dict[str, np.ndarray]:
    """Per text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    w = words or Words(array)
    data, offsets = w.data, w.offsets
    inner = ~SPACE[data]
    point = inner & ((data & 0xC0) != 0x80)
    # Lines that hold a word, by their whole bytes.
    n = len(data)
    breaks = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    starts = starts[starts < n]
    ends = np.concatenate([starts[1:], [n]]) if len(starts) else starts
    row = np.searchsorted(offsets, starts, side="right") - 1
    ends = ends - ((ends > starts) & (data[np.maximum(ends - 1, 0)] == 10)) if len(starts) else ends
    full = np.searchsorted(w.starts, ends) > np.searchsorted(w.starts, starts) if len(starts) else np.zeros(0, bool)
    starts, ends, row = starts[full], ends[full], row[full]
    salt = (np.arange(w.rows, dtype=np.uint64) + U(1)) * STEP
    i, j = twins(mix(spans_hash(data, starts, ends) + salt[row]))
    true = (row[i] == row[j]) & equal_spans(data, starts[i], ends[i], starts[j], ends[j])
    dup_lines = np.bincount(row[j][true], minlength=w.rows)
    for r in np.unique(row[np.concatenate([i[~true], j[~true]])]).tolist():  # different lines of one key
        lines = [data[a:b].tobytes() for a, b in zip(starts[row == r], ends[row == r], strict=True)]
        dup_lines[r] = len(lines) - len(set(lines))
    # Words under a 3-word window that the text holds twice or more.
    tri, first = w.windows(3)
    i, j = twins(mix(tri + salt[w.row[first]]))
    i, j = first[i], first[j]
    true = w.row[i] == w.row[j]
    for k in range(3):
        true &= equal_spans(data, w.starts[i + k], w.ends[i + k], w.starts[j + k], w.ends[j + k])
    covered = np.zeros(len(w.starts), bool)
    for k in range(3):
        covered[i[true] + k] = covered[j[true] + k] = True
    for r in np.unique(w.row[np.concatenate([i[~true], j[~true]])]).tolist():  # different windows of one key
        lo, hi = w.first[r], w.first[r + 1]
        own = [data[a:b].tobytes() for a, b in zip(w.starts[lo:hi], w.ends[lo:hi], strict=True)]
        grams = [tuple(own[k : k + 3]) for k in range(len(own) - 2)]
        held = Counter(grams)
        covered[lo:hi] = False
        for k, gram in enumerate(grams):
            if held[gram] > 1:
                covered[lo + k : lo + k + 3] = True
    return {
        "n_words": w.count.astype(np.int64),
        "word_chars": per_row(point, offsets).astype(np.int64),
        "n_symbols": per_row(SYMBOL[data], offsets).astype(np.int64),
        "n_dup_lines": dup_lines.astype(np.int64),
        "n_repeat_words": np.bincount(w.row[covered], minlength=w.rows).astype(np.int64),
    }


GRAM = _rng.integers(1, 2**31, 3, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
CHAR_BUCKETS, WORD_BUCKETS = 4096, 2048
BUCKETS = CHAR_BUCKETS + 2 * WORD_BUCKETS


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each character (its UTF-8 bytes) and the row of each."""
    if not len(data) or data.max() < 128:
        return data.astype(np.uint32), np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    points = data[lead].astype(np.uint32)
    size = np.diff(np.append(lead, len(data)))
    for k in range(1, 4):
        more = np.flatnonzero(size > k)
        points[more] |= data[lead[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return points, np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(lead, offsets)))


def hashed_ngrams(array: pa.Array, words: Words | None = None) -> np.ndarray:
    """A row per text: counts of hashed character 3-grams (code points), words and word pairs, square roots taken, each
    row of length 1."""
    w = words or Words(array)
    data, offsets = w.data, w.offsets
    n = w.rows
    out = np.zeros((n, BUCKETS), np.float32)
    points, row = code_points(data, offsets)
    if len(points) >= 3:
        gram = points[:-2] * GRAM[0] + points[1:-1] * GRAM[1] + points[2:] * GRAM[2]
        same = row[:-2] == row[2:]
        at = row[:-2][same] * CHAR_BUCKETS + (gram[same] >> np.uint32(33 - CHAR_BUCKETS.bit_length())).astype(np.int64)
        out[:, :CHAR_BUCKETS] = np.bincount(at, minlength=n * CHAR_BUCKETS).reshape(n, CHAR_BUCKETS)
    shift = U(53)
    for k, lo in ((1, CHAR_BUCKETS), (2, CHAR_BUCKETS + WORD_BUCKETS)):
        h, first = w.windows(k)
        at = w.row[first] * WORD_BUCKETS + (h >> shift).astype(np.int64)
        out[:, lo : lo + WORD_BUCKETS] = np.bincount(at, minlength=n * WORD_BUCKETS).reshape(n, WORD_BUCKETS)
    np.sqrt(out, out=out)
    out /= np.maximum(np.sqrt((out * out).sum(1, keepdims=True)), 1e-9)
    return out


UPPER = np.zeros(256, bool)
UPPER[65:91] = True
SHAPES = 8


def shapes(array: pa.Array, words: Words | None = None) -> np.ndarray:
    """A row per text of shape figures: repetition, symbols, capitals, exclamation marks, bars, lengths."""
    w = words or Words(array)
    c = base_counts(array, w)
    n = np.maximum(c["n_words"], 1)
    chars = np.maximum(c["word_chars"], 1)
    data, offsets = w.data, w.offsets
    return np.stack(
        [
            c["n_repeat_words"] / n,
            np.minimum(c["n_symbols"] / n, 4),
            c["n_dup_lines"] / (1 + np.log1p(n)) / 4,
            per_row(UPPER[data], offsets) / chars,
            np.minimum(per_row(data == 33, offsets) / n, 4),
            per_row(data == 124, offsets) / n,
            np.log1p(c["n_words"]) / 10,
            np.minimum(c["word_chars"] / n, 20) / 10,
        ],
        axis=1,
    ).astype(np.float32)
