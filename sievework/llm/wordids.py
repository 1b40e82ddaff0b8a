"""Ids of whole texts by a ``tokenizers`` file whose pre-tokens never span white space.

Such a tokenizer gives a text the ids of its words (runs of bytes other than white space), one after the other. The
words of a batch are found in its bytes and dictionary-encoded, so that Python sees each distinct word once; every worker
keeps the ids of words it has met (a bounded memo) and hands only new ones to the library. Ids are then gathered for
the whole batch at once.
"""

from __future__ import annotations

import os
import string
from array import array
from itertools import product

import numpy as np
import pyarrow as pa

from sievework.llm import textkernels as K
from sievework.llm.common import MEMOS

#: Most words of one generation of the memo (two are kept), and longest word, that a worker remembers.
MEMO, MEMO_CHARS = 200_000, 40
MARKS = string.punctuation
MARK = np.zeros(256, bool)
MARK[list(MARKS.encode())] = True
ALNUM = np.zeros(256, bool)
ALNUM[list((string.ascii_letters + string.digits).encode())] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
PEELS = 8  # longest run of marks behind a word that becomes a span of its own
#: Words of all kinds, put on both sides of white space, and in front of marks, to see that no pre-token spans either.
PROBES = ("word", "Word", "12", "!?", "'", "'s", "it's", "a1!", "\u00e9", "\u4e2d\u6587", "-", "<|")
_encoders: dict[str, Encoder] = {}


class Encoder:
    """Raises ValueError for a tokenizer whose ids of two words with white space between are not those of the words."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        suffix = self.tokenizer.model.end_of_word_suffix if hasattr(self.tokenizer.model, "end_of_word_suffix") else None
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        if suffix:
            self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self.special = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        if any(K.SPACE[list(t)].any() for t in self.special):
            raise ValueError(f"a special token of {path} holds white space: words cannot be encoded one by one")
        self.check(path)
        self.lowers = self.each(["ABCxyz"]) == self.each(["abcxyz"])
        ends = [w for w in PROBES if w[-1].isascii() and w[-1].isalnum()]
        self.peels = all(got == a + b for w, a in zip(ends, self.each(ends), strict=True) for m, b in zip(MARKS, self.each(list(MARKS)), strict=True) for got in self.each([w + m]))

    def check(self, path: str) -> None:
        alone = dict(zip(PROBES, self.each(list(PROBES)), strict=True))
        pairs = list(product(PROBES, PROBES))
        for space in (" ", "\n", "\t", " \r\n "):
            whole = self.each([f"{space}{a}{space}{b}{space}" for a, b in pairs])
            if any(got != alone[a] + alone[b] for got, (a, b) in zip(whole, pairs, strict=True)):
                raise ValueError(f"pre-tokens of {path} span white space: words cannot be encoded one by one")

    def each(self, words: list[str]) -> list[bytes]:
        return [array("I", got.ids).tobytes() for got in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def plain_words(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters only. Each is one pre-token and so ends with its only end-of-word token: many go to
        the library as one text. Where the number of ends is not that of the words, they go one by one."""
        out: list[bytes] = []
        parts = [words[a : a + 256] for a in range(0, len(words), 256)]
        for part, got in zip(parts, self.tokenizer.encode_batch_fast([" ".join(p) for p in parts], add_special_tokens=False), strict=True):
            ids = np.array(got.ids, "<u4")
            cuts = [0, *((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()]
            if len(cuts) == len(part) + 1 and cuts[-1] == 4 * len(ids):
                data = ids.tobytes()
                out += [data[i:j] for i, j in zip(cuts, cuts[1:], strict=False)]
            else:
                out += self.each(part)
        return out

    def learn(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words that the memo does not have."""
        plain = [w for w in words if w.isalpha()]
        others = [w for w in words if not w.isalpha()]
        found = dict(zip(plain, self.plain_words(plain), strict=True))
        found.update(zip(others, self.each(others), strict=True))
        return list(map(found.__getitem__, words))

    def of_words(self, words: list[str]) -> list[bytes]:
        """The ids of distinct words, from the memo where it has them."""
        out = list(map(self.memo.get, words))
        new = [w for w, x in zip(words, out, strict=True) if x is None]
        if not new:
            return out
        known = dict(zip(new, map(self.older.get, new), strict=True))
        unknown = [w for w, x in known.items() if x is None]
        known.update(zip(unknown, self.learn(unknown), strict=True))
        self.memo.update(known if max(map(len, new)) <= MEMO_CHARS else {w: x for w, x in known.items() if len(w) <= MEMO_CHARS})
        if len(self.memo) > MEMO:
            self.older, self.memo = self.memo, {}
        rest = iter(known.values())
        return [next(rest) if x is None else x for x in out]

    def spans(self, words: K.Words) -> tuple[pa.Array, np.ndarray]:
        """Distinct runs of bytes to encode, in the order of the texts, and the number of them in each text: the words,
        without the marks behind a letter or digit, and these marks."""
        data, ends = words.data, words.ends
        cuts = np.concatenate([[0], np.cumsum(ends - words.starts)])
        counts = words.count
        flat = data[~K.SPACE[data]]
        lower = LOWER[flat]
        if any(token in lower.tobytes() for token in self.special):  # such a token must reach the library as it is
            lower = flat
        elif self.peels and len(ends):
            at = np.flatnonzero(MARK[data[ends - 1]])
            stop = ends[at] - 1
            for _ in range(PEELS):
                more = (stop > words.starts[at]) & MARK[data[np.maximum(stop - 1, 0)]]
                if not more.any():
                    break
                stop -= more
            split = (stop > words.starts[at]) & ALNUM[data[np.maximum(stop - 1, 0)]]
            at, tail = at[split], (ends[at] - stop)[split]
            counts = counts + np.bincount(words.row[at], minlength=words.rows)
            cuts = np.insert(cuts, at + 1, cuts[at + 1] - tail)
        if self.lowers:
            flat = lower
        return pa.Array.from_buffers(pa.large_string(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(flat))]), counts

    def encode(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (null: empty), one after the other, and how many each text has; ``end`` follows each."""
        spans, counts = self.spans(K.Words(texts.fill_null("")))
        first = np.concatenate([[0], np.cumsum(counts)])
        counts, ids = np.zeros(len(counts), np.int64), np.zeros(0, "<u4")
        if len(spans):
            coded = spans.dictionary_encode()
            code = coded.indices.to_numpy()
            known = self.of_words(coded.dictionary.to_pylist())
            table = np.frombuffer(b"".join(known), "<u4")
            length = np.fromiter(map(len, known), np.int64, len(known)) // 4
            start = np.cumsum(length) - length
            n = length[code]
            counts = K.per_row(n, first)
            ids = table[np.repeat(start[code] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        if end is None:
            return ids, counts
        out = np.full(int(counts.sum()) + len(counts), end, "<u4")
        inner = np.ones(len(out), bool)
        inner[np.cumsum(counts + 1) - 1] = False
        out[inner] = ids
        return out, counts + 1


MEMOS["words"] = _encoders.clear


def encoder(path: str) -> Encoder:
    """This worker's encoder of a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode_column(texts: pa.Array, path: str, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts, one after the other, and the number of each text's; ``end`` follows each text if given."""
    return encoder(path).encode(texts, end)
