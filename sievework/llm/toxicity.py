"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words are runs of letters and digits, in lower case. Features are the distinct words, their stems (first STEMS bytes,
for compounds that training did not see), word pairs and pairs with one word between of a text, hashed into
2 ** BITS buckets. FTRL-proximal keeps a learning rate for each coordinate; its L1
term leaves few weights other than zero, and only these are sent to the tasks.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm import textkernels as K
from sievework.llm.common import by_slices, texts
from sievework.llm.linear import collect_sparse, labelled_sample, sigmoid

#: Most labelled rows that a model is learnt from (and, by FEATURE_BYTES of ``linear``, most bytes of their features)
#: and passes over them.
SAMPLE, PASSES = 12_000, 8
BITS = 20
STEMS = (4, 6)
#: Scores from here up count as toxic.
THRESHOLD = 0.3
LETTER = np.zeros(256, bool)
LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def features(array: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """Bucket and row of every word, pair and skip-pair of a batch, and the number of rows."""
    w = K.Words(pc.utf8_lower(array), LETTER)
    h = w.hash
    out, rows = [h], [w.row]
    for size in STEMS:
        longer = w.ends - w.starts > size
        out.append(K.mix(K.spans_hash(w.data, w.starts[longer], w.starts[longer] + size) + K.U(size)))
        rows.append(w.row[longer])
    for gap, salt in ((1, 0x1B), (2, 0x2D)):
        if len(h) > gap:
            same = w.row[:-gap] == w.row[gap:]
            out.append(K.mix(h[:-gap][same] * K.STEP + h[gap:][same] + K.U(salt)))
            rows.append(w.row[:-gap][same])
    return (np.concatenate(out) >> K.U(64 - BITS)).astype(np.int64), np.concatenate(rows), w.rows


@dataclass
class Sparse:
    """The weights other than zero, by bucket, and the intercept."""

    at: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, array: pa.Array) -> np.ndarray:
        used = np.zeros(1 << BITS, bool)
        used[self.at] = True
        bucket, row, n = features(array)
        hit = used[bucket]
        pair = np.unique(row[hit] << BITS | bucket[hit])
        value = self.weights[np.searchsorted(self.at, pair & ((1 << BITS) - 1))]
        return sigmoid(np.bincount(pair >> BITS, value, n) + self.bias)


def ftrl(rows: list[np.ndarray], y: np.ndarray, alpha: float = 1.0, beta: float = 1.0, l1: float = 4.0, l2: float = 1.0, passes: int = PASSES, seed: int = 11) -> Sparse:
    """FTRL-proximal over rows of distinct buckets, in a seeded order for each pass.

    Only features of two rows or more take part. Without rows of both labels the model is constant: 0 if none is labelled 1, else 1.
    """
    if len(set(y.tolist())) < 2:
        return Sparse(np.zeros(0, np.int64), np.zeros(0), 20.0 if len(y) and y[0] == 1 else -20.0)
    count = np.zeros(1 << BITS, np.int32)
    for r in rows:
        count[r] += 1
    used = np.flatnonzero(count >= 2)
    place = np.full(1 << BITS, -1, np.int32)
    place[used] = np.arange(len(used))
    rows = [own[own >= 0] for own in (place[r] for r in rows)]  # features by their place among those that take part
    z, root = np.zeros(len(used)), np.zeros(len(used))  # root: of the sum of squared gradients
    zb = rb = 0.0
    rng = np.random.default_rng(seed)

    def weight(z, root):
        return (np.sign(z) * l1 - z) * (np.abs(z) > l1) / ((beta + root) / alpha + l2)

    for _ in range(passes):
        for i in rng.permutation(len(rows)).tolist():
            at = rows[i].astype(np.int64)
            zi, ri = z[at], root[at]
            w = weight(zi, ri)
            wb = -zb / ((beta + rb) / alpha)
            g = 1 / (1 + math.exp(-min(max(float(w.sum()) + wb, -40.0), 40.0))) - y[i]
            grown = np.sqrt(ri * ri + g * g)
            z[at] = zi + g - (grown - ri) / alpha * w
            root[at] = grown
            grown = math.sqrt(rb * rb + g * g)
            zb += g - (grown - rb) / alpha * wb
            rb = grown
    w = weight(z, root)
    at = np.flatnonzero(w)
    return Sparse(used[at], w[at], -zb / ((beta + rb) / alpha))


def encode(array: pa.Array) -> list[bytes]:
    """The distinct buckets of each row."""
    bucket, row, n = features(array)
    pair = np.unique(row << BITS | bucket)
    cuts = np.searchsorted(pair, np.arange(n + 1) << BITS)
    low = (pair & ((1 << BITS) - 1)).astype("<u4")
    return [low[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]


def collect(sample: DataFrame) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct buckets of each row of a bounded sample, and the labels."""
    rows = collect_sparse(sample, encode)
    return [np.frombuffer(data, "<u4") for _, data in rows], np.array([y for y, _ in rows], dtype=float)


def train(docs: DataFrame, labels: DataFrame, allowed=None, sample: int = SAMPLE, label: str = "toxic") -> Sparse:
    """A model from at most ``sample`` rows, half of them of either label where there are as many; the intercept is
    moved to the share of label 1 among all rows that may be learnt from."""
    usable = labels if allowed is None else labels.where(allowed)
    count = {r["y"]: r["n"] for r in usable.groupBy(F.col(label).cast("int").alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()}
    rows, y = collect(labelled_sample(docs, usable, label, sample, halves=True))
    model = ftrl(rows, y)
    if count.get(0) and count.get(1) and 0 < y.sum() < len(y):
        model.bias += math.log(count[1] / count[0]) - math.log(y.sum() / (len(y) - y.sum()))
    return model


def score_toxicity(docs: DataFrame, labels: DataFrame, allowed=None, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: doc_id, score (0 to 1, higher means that label 1 is likelier), predicted (1 from the threshold up).

    allowed: a condition on doc_id that a row must meet to be learnt from. Null and empty texts get the score of a
    text without features; very long texts are scored whole; repeated rows get equal scores, and of an id that comes
    with several texts one is learnt from; a null id is scored, too. Other columns are ignored; an empty table gives
    an empty result; without labels of both kinds the score is constant.
    """
    model = train(docs, labels, allowed, sample)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        score = model.score(batch.column(0)).astype(float)
        return pa.record_batch([batch.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return texts(docs, id_col, text_col).select("text", "doc_id").mapInArrow(by_slices(run), "doc_id long, score double, predicted int")
