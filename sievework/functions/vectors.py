"""Dense, sparse and multi-vector expressions over array and map columns."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def vector(values: Sequence[float]) -> Column:
    """A literal vector of doubles."""
    return F.lit([float(v) for v in values]).cast("array<double>")


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product in double precision."""
    products = F.zip_with(_col(a).cast("array<double>"), _col(b).cast("array<double>"), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda s, v: s + v)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity; 0 if either vector has no length."""
    length = norm(a) * norm(b)
    return F.when(length > 0, dot(a, b) / length).otherwise(F.lit(0.0))


def normalise(a: Column | str, least: float = 1e-10) -> Column:
    """The vector at length 1; shorter than ``least`` it stays as it is."""
    v = _col(a).cast("array<double>")
    # The length stands beside every element, so that it is computed once and not for each.
    return F.zip_with(v, F.array_repeat(norm(a), F.size(v)), lambda x, n: F.when(n < least, x).otherwise(x / n))


def truncate(a: Column | str, dimensions: int) -> Column:
    """The first dimensions, at length 1 again."""
    return normalise(F.slice(_col(a), 1, dimensions))


def softmax(a: Column | str) -> Column:
    """Exponentials shifted by the maximum, summing to 1."""
    v = _col(a).cast("array<double>")
    e = F.zip_with(v, F.array_repeat(F.array_max(v), F.size(v)), lambda x, m: F.exp(x - m))
    return F.zip_with(e, F.array_repeat(F.aggregate(e, F.lit(0.0), lambda s, y: s + y), F.size(v)), lambda x, total: x / total)


def max_pool(rows: Column | str) -> Column:
    """Elementwise maximum of an array of equally long vectors."""
    m = _col(rows).cast("array<array<double>>")
    return F.aggregate(F.slice(m, 2, F.greatest(F.size(m) - 1, F.lit(0))), F.element_at(m, 1), lambda s, v: F.zip_with(s, v, lambda x, y: F.greatest(x, y)))


def sparse_activation(pooled: Column | str, threshold: float = 0.01, log: bool = True) -> Column:
    """A sparse map token -> weight: log1p(relu(x)), or relu(x), of at least the threshold."""
    v = _col(pooled).cast("array<double>")
    weight = (lambda x: F.log1p(F.greatest(x, F.lit(0.0)))) if log else (lambda x: F.greatest(x, F.lit(0.0)))
    pairs = F.transform(v, lambda x, i: F.struct(i.alias("token"), weight(x).alias("weight")))
    return F.map_from_entries(F.filter(pairs, lambda p: p["weight"] >= threshold))


def max_sim(query: Column | str, document: Column | str) -> Column:
    """Late interaction: for each query vector the best inner product with a document vector, summed."""
    q, d = _col(query).cast("array<array<double>>"), _col(document).cast("array<array<double>>")
    best = F.transform(q, lambda a: F.array_max(F.transform(d, lambda b: dot(a, b))))
    return F.aggregate(best, F.lit(0.0), lambda s, v: s + v)


def argmax(scores: Column | str) -> Column:
    """The place (from 0) of the first maximum."""
    return F.array_position(_col(scores), F.array_max(_col(scores))).cast("int") - 1


def to_bytes(v: Column | str) -> Column:
    """A vector as bytes: its length as a little-endian 32-bit integer, then 32-bit floats."""
    @F.pandas_udf("binary")
    def pack(rows: pd.Series) -> pd.Series:
        return rows.map(lambda r: None if r is None else np.array([len(r)], "<i4").tobytes() + np.asarray(r, "<f4").tobytes())

    return pack(_col(v).cast("array<float>"))


def from_bytes(data: Column | str) -> Column:
    """The vector of ``to_bytes``; raises for bytes of another length."""
    @F.pandas_udf("array<float>")
    def unpack(rows: pd.Series) -> pd.Series:
        def one(b):
            n = int(np.frombuffer(b, "<i4", 1)[0])
            if len(b) != 4 + 4 * n:
                raise ValueError(f"{len(b)} bytes for {n} numbers")
            return np.frombuffer(b, "<f4", n, 4)

        return rows.map(lambda b: None if b is None else one(b))

    return unpack(_col(data))
