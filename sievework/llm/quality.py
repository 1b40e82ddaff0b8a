"""Quality rules: plain counts of each text, and a calibrated logistic regression over hashed n-grams.

The model is trained on labelled quality rows (at most ``SAMPLE`` of them): character 3-grams, words and word pairs are
hashed into fixed buckets, the fit uses four fifths of the rows, and the rest calibrates the scores to probabilities
(Platt scaling). Texts are scored in Arrow batches against fixed thresholds; the weights (32 KB) ride with the task.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sievework.llm import textkernels as K
from sievework.llm.common import by_slices, release, texts
from sievework.llm.linear import collect_features, labelled_sample, logistic, sigmoid

#: Most labelled rows that a model is trained on.
SAMPLE = 4000
#: Fixed thresholds of the rules.
MIN_WORDS, MAX_REPEAT_PERCENT, MIN_PROBABILITY = 50, 50, 0.5


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, label: str = "quality") -> tuple[np.ndarray, float]:
    """Weights and intercept, learnt from at most ``sample`` rows, whose sigmoid is a calibrated probability of label 1."""
    found = fit(*collect_features(labelled_sample(docs, labels, label, sample), K.hashed_ngrams, K.BUCKETS))
    release()
    return found


def fit(X: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Without rows of both labels the model is constant: probability 1 if no row is labelled 0, else 0."""
    if len(set(y.tolist())) < 2:
        return np.zeros(K.BUCKETS), 0.0 if not len(y) else 40.0 * (2 * y[0] - 1)
    part = np.arange(len(y)) % 5 == 4
    if len(set(y[part].tolist())) < 2 or len(set(y[~part].tolist())) < 2:
        part = np.zeros(len(y), bool)  # too few rows to set some apart
    share = np.where(y == 1, 0.5 / (y[~part] == 1).sum(), 0.5 / (y[~part] == 0).sum()) * ~part  # rows set apart weigh nothing
    w, b = logistic(X, y, ridge=2e-5, weight=share)
    z, target = X @ w.astype(np.float32) + b, y
    if part.any():
        z, target = z[part], y[part]
    # Platt scaling; smoothed targets keep the slope finite when the classes are far apart.
    high, low = (target == 1).sum(), (target == 0).sum()
    slope, shift = logistic(z[:, None].astype(float), np.where(target == 1, (high + 1) / (high + 2), 1 / (low + 2)), ridge=1e-6)
    slope = max(float(slope[0]), 1e-3)
    return w * slope, b * slope + shift


def judge(batch: pa.RecordBatch, w: np.ndarray, b: float) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Counts, base_failed, probability and verdict of each text of a batch whose first column is the text."""
    array = batch.column(0)
    words = K.Words(array)
    counts = K.base_counts(array, words)
    failed = (counts["n_words"] < MIN_WORDS) | (100 * counts["n_repeat_words"] > MAX_REPEAT_PERCENT * counts["n_words"])
    p = sigmoid(K.hashed_ngrams(array, words) @ w.astype(np.float32) + b)
    return counts, failed, p, ~failed & (p >= MIN_PROBABILITY)


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """Per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, probability, kept.

    A null or empty text has no words and fails the base rules; very long texts are judged whole. Repeated rows are
    judged one by one, those with a null id, too; other columns are ignored; an empty table gives an empty result.
    """
    w, b = train(docs, labels, sample)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, failed, p, kept = judge(batch, w, b)
        return pa.record_batch([batch.column(1), *(pa.array(v) for v in counts.values()), pa.array(failed), pa.array(p.astype(float)), pa.array(kept)], ["doc_id", *counts, "base_failed", "probability", "kept"])

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, probability double, kept boolean"
    return texts(docs, id_col, text_col).select("text", "doc_id").mapInArrow(by_slices(run, rows=256), schema)


def keep_good(docs: DataFrame, labels: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that pass the rules, with all their columns, in one pass without a shuffle.

    Null and empty texts fail; very long texts are judged whole; repeated rows and rows with a null id are judged one
    by one; other columns, whatever their names, come through; an empty table gives an empty result.
    """
    w, b = train(docs, labels, sample)
    place = docs.columns.index(text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        array = batch.column(place).fill_null("")
        kept = judge(pa.record_batch([array], ["text"]), w, b)[3]
        return batch.filter(pa.array(kept))

    return docs.mapInArrow(by_slices(run, column=text_col, rows=256), docs.schema)


def model(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Callable[[list[str]], np.ndarray]:
    """A scorer for lists of texts on the driver."""
    w, b = train(docs, labels, sample)
    return lambda rows: sigmoid(K.hashed_ngrams(pa.array(rows, pa.string())) @ w.astype(np.float32) + b)
