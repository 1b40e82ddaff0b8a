"""Model extension points: batch models as Arrow functions, heads over their outputs, deterministic stand-ins.

No weights come with the library: a model is any function from texts to vectors or scores. ``stand_in`` gives a
deterministic one from hashes, for tests and examples.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.vectors import argmax, softmax


def batch_model(load: Callable[[], Callable[[list[str]], np.ndarray]], returns: str = "array<double>") -> Callable[[Column | str], Column]:
    """A column function from texts to model outputs; ``load`` runs once in each worker, batches go in whole."""

    @F.pandas_udf(returns)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            out = model(texts.fillna("").tolist())
            yield pd.Series(list(out) if getattr(out, "ndim", 1) > 1 else out)

    return lambda text: run(F.col(text) if isinstance(text, str) else text)


def pair_model(load: Callable[[], Callable[[list[str], list[str]], np.ndarray]]) -> Callable[[Column, Column], Column]:
    """A column function from pairs of texts to scores."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for a, b in batches:
            yield pd.Series(np.asarray(model(a.fillna("").tolist(), b.fillna("").tolist()), float))

    return run


def stand_in(dimensions: int = 8) -> Callable[[], Callable[[list[str]], np.ndarray]]:
    """A model whose outputs are seeded by the text's hash."""

    def load():
        def model(texts: list[str]) -> np.ndarray:
            return np.stack([np.random.default_rng(int.from_bytes(hashlib.sha256(t.encode()).digest()[:8], "little")).standard_normal(dimensions) for t in texts]) if texts else np.zeros((0, dimensions))

        return model

    return load


def word_overlap() -> Callable[[list[str], list[str]], np.ndarray]:
    """A pair model: share of common words."""

    def model(a: list[str], b: list[str]) -> np.ndarray:
        pairs = ((set(x.lower().split()), set(y.lower().split())) for x, y in zip(a, b, strict=True))
        return np.array([len(x & y) / max(1, len(x | y)) for x, y in pairs])

    return model


def classify(logits: Column | str, labels: Sequence[str]) -> Column:
    """struct<label, score, probabilities>: softmax and its first greatest label."""
    p = softmax(logits)
    at = argmax(p)
    return F.struct(F.element_at(F.lit(list(labels)), at + 1).alias("label"), F.array_max(p).alias("score"), p.alias("probabilities"))


def entailment(logits: Column | str) -> Column:
    """Natural-language inference: ties go to ENTAILMENT, then NEUTRAL."""
    return classify(logits, ("ENTAILMENT", "NEUTRAL", "CONTRADICTION"))


def cached(df: DataFrame, cache: DataFrame, model: Callable[[Column | str], Column], version: str, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows with ``embedding``, new cache rows (hash, version, embedding)): only contents that the cache lacks are
    computed, each once."""
    keyed = df.withColumn("_hash", F.sha2(F.col(text_col), 256))
    held = cache.where(F.col("version") == version).select(F.col("hash").alias("_hash"), "embedding")
    missing = keyed.join(held, "_hash", "left_anti").groupBy("_hash").agg(F.min(text_col).alias("_text"))
    new = missing.select("_hash", model("_text").alias("embedding"))
    rows = keyed.join(held.unionByName(new), "_hash", "left").drop("_hash")
    return rows, new.select(F.col("_hash").alias("hash"), F.lit(version).alias("version"), "embedding")


def two_texts(df: DataFrame, dense_text: str, other_text: str, dense: Callable, sparse: Callable) -> DataFrame:
    """Dense vectors of one text, sparse ones of another."""
    return df.withColumns({"dense": dense(dense_text), "sparse": sparse(other_text)})


def outputs(**named: Column | str) -> Column:
    """struct: named outputs of a model, each a matrix (array of rows); a single vector becomes a matrix of one row."""
    col = lambda x: F.col(x) if isinstance(x, str) else x
    return F.struct(*[col(c).cast("array<array<float>>").alias(n) for n, c in named.items()])


def single_row(matrix: Column | str) -> Column:
    """The vector of a matrix of one row; any other number of rows fails."""
    m = F.col(matrix) if isinstance(matrix, str) else matrix
    return F.when(F.size(m) == 1, m[0]).otherwise(F.raise_error(F.concat(F.lit("rows: "), F.size(m).cast("string"))).cast("array<float>"))
