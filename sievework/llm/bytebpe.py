"""Byte-level BPE encoding and decoding by two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary (hash and displace, one slot a token, the bytes compared) finds
pre-tokens that are tokens as they stand. Tier two: for the others, a heap of ranked pairs over a linked list of
bytes merges the lowest-ranked, leftmost pair until none is left. Each worker remembers a bounded number of results.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from sievework.llm import textkernels as K
from sievework.llm.common import MEMOS, by_slices, texts

#: Most pre-tokens of one generation of the memo (two are kept), and longest one in characters, that a worker remembers.
MEMO, MEMO_CHARS = 300_000, 48


def load_ranks(path: str) -> dict[bytes, int]:
    """A vocabulary file: a line per token, its bytes in base64 and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


@dataclass
class PerfectHash:
    """A minimal perfect hash: key -> slot in 0 ... n - 1, by one displacement for each group of keys."""

    displace: np.ndarray
    n: int

    @staticmethod
    def slots(h: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
        return (K.mix(h + d.astype(np.uint64) * K.STEP) % np.uint64(n)).astype(np.int64)

    @classmethod
    def build(cls, h: np.ndarray) -> PerfectHash:
        """From distinct 64-bit hashes; groups are placed largest first, each at the first displacement that is free."""
        n = max(1, len(h))
        groups = max(1, n // 4)
        group = (h % np.uint64(groups)).astype(np.int64)
        order = np.argsort(group, kind="stable")
        cuts = np.searchsorted(group[order], np.arange(groups + 1))
        displace, free = np.zeros(groups, np.int64), np.ones(n, bool)
        trial = np.arange(64)
        for g in np.argsort(-np.diff(cuts), kind="stable"):
            keys = h[order[cuts[g] : cuts[g + 1]]]
            if not len(keys):
                break
            base = 0
            while True:
                at = cls.slots(keys[:, None], (base + trial)[None, :], n)
                fits = free[at].all(0)
                if len(keys) > 1:
                    s = np.sort(at, axis=0)
                    fits &= (s[1:] != s[:-1]).all(0)
                if fits.any():
                    j = int(np.argmax(fits))
                    displace[g], free[at[:, j]] = base + j, False
                    break
                base += 64
        return cls(displace, n)

    def find(self, h: np.ndarray) -> np.ndarray:
        return self.slots(h, self.displace[(h % np.uint64(len(self.displace))).astype(np.int64)], self.n)


def hash_keys(keys: list[bytes]) -> np.ndarray:
    data, offsets = K.buffers(pa.array(keys, pa.binary()))
    return K.spans_hash(data, offsets[:-1], offsets[1:])


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a pre-token: always the pair of the lowest rank first, the leftmost of equals."""
    n = len(piece)
    end, following, previous, live = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(rank, i, i + 1, i + 2) for i in range(n - 1) if (rank := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, left, right, stop = heapq.heappop(heap)
        if not live[left] or following[left] != right or right >= n or end[right] != stop:
            continue  # one side has been merged since
        end[left], live[right] = stop, False
        after = following[left] = following[right]
        if after < n:
            previous[after] = left
            if (rank := ranks.get(piece[left : end[after]])) is not None:
                heapq.heappush(heap, (rank, left, after, end[after]))
        before = previous[left]
        if before >= 0 and (rank := ranks.get(piece[before:stop])) is not None:
            heapq.heappush(heap, (rank, before, left, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = following[i]
    return out


@dataclass
class Codec:
    ranks: dict[bytes, int]
    pattern: str
    memo: dict[str, bytes] = field(default_factory=dict)
    older: dict[str, bytes] = field(default_factory=dict)

    def __post_init__(self):
        import regex

        self.find = regex.compile(self.pattern).findall
        tokens = sorted(self.ranks)
        self.hash = PerfectHash.build(hash_keys(tokens))
        place = self.hash.find(hash_keys(tokens))
        self.token, self.id = [b""] * len(tokens), [0] * len(tokens)
        for token, slot in zip(tokens, place.tolist(), strict=True):
            self.token[slot], self.id[slot] = token, self.ranks[token]
        size = max(self.ranks.values(), default=-1) + 1
        by_id = [b""] * size
        for token, rank in self.ranks.items():
            by_id[rank] = token
        self.bytes, self.offsets = K.buffers(pa.array(by_id, pa.binary()))

    def resolve(self, pieces: list[str]) -> None:
        """Put the ids of new pre-tokens into the memo."""
        raw = [p.encode() for p in pieces]
        slots = self.hash.find(hash_keys(raw)).tolist()
        for piece, key, slot in zip(pieces, raw, slots, strict=True):
            ids = [self.id[slot]] if self.token[slot] == key else merge(key, self.ranks)
            self.memo[piece] = array("i", ids).tobytes()

    def encode(self, rows: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        pieces = [self.find(t) for t in rows]
        new = set().union(*pieces).difference(self.memo)
        kept = new.intersection(self.older)
        self.memo.update((p, self.older[p]) for p in kept)
        self.resolve(list(new - kept))
        out = [b"".join(map(self.memo.__getitem__, p)) for p in pieces]
        for piece in [p for p in new if len(p) > MEMO_CHARS]:
            del self.memo[piece]
        if len(self.memo) > MEMO:
            self.older, self.memo = self.memo, {}
        return out

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of id lists that lie one after the other, and the offsets of each list's bytes."""
        sizes = self.offsets[ids + 1] - self.offsets[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        source = np.repeat(self.offsets[ids] - (ends - sizes), sizes) + np.arange(total)
        return self.bytes[source], np.concatenate([[0], ends])[offsets]


_codecs: dict[tuple[str, str], Codec] = {}


MEMOS["bytes"] = _codecs.clear


def codec(path: str, pattern: str) -> Codec:
    """This worker's codec."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(load_ranks(path), pattern)
    return _codecs[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """Per document: doc_id, ids array<int>; with ``decoded`` also the bytes that the ids decode to.

    A null or empty text has no ids; a very long one is encoded whole. Repeated rows are encoded one by one, those
    with a null id, too; other columns are ignored; an empty table gives an empty result.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(path, pattern)
        rows = c.encode(batch.column(0).to_pylist())
        offsets = np.concatenate([[0], np.cumsum([len(r) // 4 for r in rows])])
        ids = np.frombuffer(b"".join(rows), "<i4")
        out = [batch.column(1), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))]
        if decoded:
            data, cuts = c.decode(ids, offsets)
            out.append(pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))]))
        return pa.record_batch(out, ["doc_id", "ids", "decoded"][: len(out)])

    schema = "doc_id long, ids array<int>" + ", decoded binary" * decoded
    return texts(docs, id_col, text_col).select("text", "doc_id").mapInArrow(by_slices(run, keeps=["bytes"]), schema)


def decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row of ids: doc_id, decoded binary. A null or empty list decodes to no bytes; an empty table gives an empty
    result."""

    def run(batches):
        c = codec(path, pattern)
        for batch in batches:
            lists = pc.fill_null(batch.column(1), []) if batch.column(1).null_count else batch.column(1)
            offsets = lists.offsets.to_numpy().astype(np.int64)
            ids = lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
            data, cuts = c.decode(ids, offsets - offsets[0])
            yield pa.record_batch([batch.column(0), pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])], ["doc_id", "decoded"])

    return encoded.selectExpr(f"{id_col} doc_id", f"coalesce({ids_col}, array()) ids").mapInArrow(run, "doc_id long, decoded binary")
