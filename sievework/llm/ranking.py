"""Quality classifier by Bradley-Terry pairwise ranking.

A document's score is linear in its features (hashed n-grams and shape figures). Preference pairs (a row labelled 1
over a row labelled 0) are drawn so that every labelled row takes part, and the weights minimise the logistic loss of
the feature differences. The score quantile that matches the share of rows labelled 0 becomes the threshold; a
logistic curve maps it to 0.5. All labelled rows are learnt from: up to BLOCK of them on the driver, more of them in
stored blocks, whose losses and slopes the executors sum up for each step of the driver's descent.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm import textkernels as K
from sievework.llm.common import by_slices, grouped, task, texts
from sievework.llm.linear import block_columns, collect_features, labelled_blocks, labelled_ids, labelled_sample, minimise, sigmoid
from sievework.session import materialise

#: Labelled rows and preference pairs of a block; pairs are drawn within it.
BLOCK, PAIRS = 4000, 40_000
RIDGE, SEED = 1e-5, 7
WIDTH = K.BUCKETS + K.SHAPES


def features(array: pa.Array) -> np.ndarray:
    words = K.Words(array)
    return np.concatenate([K.hashed_ngrams(array, words), K.shapes(array, words)], axis=1)


@dataclass
class Ranking:
    weights: np.ndarray
    threshold: float
    scale: float

    def score(self, array: pa.Array) -> np.ndarray:
        return sigmoid((features(array) @ self.weights.astype(np.float32) - self.threshold) / self.scale)


def constant(good: int, bad: int) -> Ranking:
    """With one label only, every score is that label's side of 0.5 (none: 0.5)."""
    return Ranking(np.zeros(WIDTH), -20.0 if good else 20.0 if bad else 0.0, 1.0)


def draw(y: np.ndarray, pairs: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows labelled 1 and rows labelled 0 of each pair; every row takes part in about the same number of pairs. A block
    that the hash left without one label (about one in 10 ** 27) has no pairs."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rng = np.random.default_rng(seed)
    pairs = max(pairs, len(good), len(bad))
    return np.resize(rng.permutation(good), pairs), rng.permutation(np.resize(bad, pairs))


def pair_loss(s: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[float, np.ndarray]:
    """The summed loss of pairs of scores, and its slope in each score."""
    d = s[i] - s[j]
    g = sigmoid(d) - 1
    return float(np.logaddexp(0, -d).sum()), np.bincount(i, g, len(s)) - np.bincount(j, g, len(s))


def placed(w: np.ndarray, bad: int, n: int, pick: Callable[[list[int]], list[float]]) -> Ranking:
    """Threshold and scale from the scores of ``n`` rows, of which ``pick`` gives those of some ranks (from 0)."""
    at = int(np.floor(bad / n * (n - 1)))
    ranks = [at, max(0, at - 1), bad + (n - bad - 1) // 2, bad + (n - bad) // 2, (bad - 1) // 2, bad // 2]
    s = pick(ranks)
    return Ranking(w, (s[0] + s[1]) / 2, max((s[2] + s[3] - s[4] - s[5]) / 2 / 8, 1e-6))


def learn(X: np.ndarray, y: np.ndarray, pairs: int = PAIRS, ridge: float = RIDGE, seed: int = SEED) -> Ranking:
    """A ranking from the rows of one block; with one label only, every score is that label's side of 0.5 (none: 0.5)."""
    good, bad = int((y == 1).sum()), int((y == 0).sum())
    if not good or not bad:
        return constant(good, bad)
    i, j = draw(y, pairs, seed)

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        value, row = pair_loss((X @ w.astype(np.float32)).astype(float), i, j)
        return value / len(i) + ridge * (w @ w) / 2, (X.T @ (row / len(i)).astype(np.float32)).astype(float) + ridge * w

    w = minimise(loss, np.zeros(X.shape[1]))
    s = np.sort((X @ w.astype(np.float32)).astype(float))
    return placed(w, bad, len(y), lambda ranks: s[ranks].tolist())


def scores(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], w: np.ndarray) -> np.ndarray:
    """The score of each row of a block."""
    found = []
    for at, value, cuts in parts:
        s = np.zeros(len(cuts) - 1)
        some = np.flatnonzero(cuts[1:] > cuts[:-1])
        if len(some):
            s[some] = np.add.reduceat(w[at] * value, cuts[:-1][some])
        found.append(s)
    return np.concatenate(found)


def block_loss(table: pa.Table, w: np.ndarray, pairs: int, seed: int) -> np.ndarray:
    """Summed loss, number of pairs, and slope in each weight, of one block."""
    parts = list(block_columns(table))
    i, j = draw(table["y"].to_numpy(), pairs, seed)
    value, row = pair_loss(scores(parts, w), i, j)
    slope, begun = np.zeros(len(w)), 0
    for at, figures, cuts in parts:
        n = len(cuts) - 1
        slope += np.bincount(at, np.repeat(row[begun : begun + n], np.diff(cuts)) * figures, len(w))
        begun += n
    return np.concatenate([[value, len(i)], slope])


def learn_blocks(rows: DataFrame, good: int, bad: int, pairs: int = PAIRS, ridge: float = RIDGE, seed: int = SEED) -> Ranking:
    """A ranking from stored blocks (``linear.labelled_blocks``) with so many rows of either label in all."""

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(2 + len(w))
            for table in grouped(batches, "block"):
                total += block_loss(table, w, pairs, seed + table["block"][0].as_py())
            yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], ["total"])

        got = rows.select("block", "y", "at", "value").mapInArrow(task(run), "total binary").collect()  # a row of 64 KB for each task
        total = sum(np.frombuffer(r["total"]) for r in got)
        return float(total[0] / total[1] + ridge * (w @ w) / 2), total[2:] / total[1] + ridge * w

    w = minimise(loss, np.zeros(WIDTH))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if table.num_rows:
                yield pa.record_batch([pa.array(ordered_key(scores(list(block_columns(table)), w)[table["home"].to_numpy()]))], ["key"])

    found = materialise(rows.select("home", "at", "value").mapInArrow(task(keys), "key long"), "scores")
    return placed(w, bad, good + bad, lambda ranks: [key_value(k) for k in select(found, ranks)])


def ordered_key(s: np.ndarray) -> np.ndarray:
    """Whole numbers from 0 below 2 ** 32 in the order of the scores, taken as 32-bit numbers."""
    bits = (s.astype(np.float32) + np.float32(0)).view(np.int32).astype(np.int64)
    return np.where(bits >= 0, bits + 2**31, -bits - 1)


def key_value(key: int) -> float:
    bits = key - 2**31 if key >= 2**31 else -key - 1
    return float(np.array([bits], np.int32).view(np.float32)[0])


def select(keys: DataFrame, ranks: list[int]) -> list[int]:
    """The keys (below 2 ** 32) at some ranks from 0, exactly: by counts of their upper and then of their lower 16 bits."""
    high, low = F.shiftright("key", 16), F.col("key").bitwiseAND(65535)
    upper = sorted((r["high"], r["n"]) for r in keys.groupBy(high.alias("high")).agg(F.count(F.lit(1)).alias("n")).collect())  # at most 65,536
    ends = np.cumsum([n for _, n in upper])
    at = {rank: int(np.searchsorted(ends, rank, "right")) for rank in ranks}
    some = keys.where(high.isin(sorted({upper[k][0] for k in at.values()})))
    lower: dict[int, list[tuple[int, int]]] = {}
    for r in some.groupBy(high.alias("high"), low.alias("low")).agg(F.count(F.lit(1)).alias("n")).collect():  # at most 65,536 for each rank
        lower.setdefault(r["high"], []).append((r["low"], r["n"]))
    found = []
    for rank in ranks:
        top, n = upper[at[rank]]
        held = sorted(lower[top])
        inner = int(np.searchsorted(np.cumsum([m for _, m in held]), rank - (ends[at[rank]] - n), "right"))
        found.append((top << 16) + held[inner][0])
    return found


def train(docs: DataFrame, labels: DataFrame, allowed=None, block: int = BLOCK, label: str = "quality") -> Ranking:
    """A ranking from all rows of ``docs`` (doc_id, text) with a label 0 or 1 that may be learnt from."""
    ids = labelled_ids(labels, label, allowed).where("y in (0, 1)").join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    ids = materialise(ids, "labelled")
    counts = {r["y"]: r["n"] for r in ids.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    good, bad = counts.get(1, 0), counts.get(0, 0)
    if not good or not bad:
        return constant(good, bad)
    if good + bad <= block:  # whole, whatever the length of the texts
        return learn(*collect_features(labelled_sample(docs, ids, "y", block), features, WIDTH, most=6 * WIDTH * block))
    return learn_blocks(labelled_blocks(docs, ids, counts, features, block), good, bad)


def rank_quality(docs: DataFrame, labels: DataFrame, allowed=None, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """Per document: doc_id, score (0 to 1, higher means that label 1 is likelier), predicted (1 from 0.5 up).

    allowed: a condition on doc_id that a row must meet to be learnt from; all labelled rows that meet it are, in blocks
    of about ``block`` rows if there are more than that. Null and empty texts are scored as texts without words; very
    long texts are scored whole; repeated rows get equal scores, and of an id that comes with several texts one is learnt
    from; a null id is scored, too. Other columns are ignored; an empty table gives an empty result; without labels of
    both kinds the score is constant.
    """
    docs = texts(docs, id_col, text_col)
    ranking = train(docs, labels, allowed, block)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        score = ranking.score(batch.column(0)).astype(float)
        return pa.record_batch([batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select("text", "doc_id").mapInArrow(by_slices(run, rows=256), "doc_id long, score double, predicted int")


def remainder(modulus: int):
    """crc32 of the id as text, modulo ``modulus``."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus
