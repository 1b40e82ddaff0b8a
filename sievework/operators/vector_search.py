"""Nearest neighbours by cosine, sparse products, late interaction; near-duplicate ingest by vectors."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.vectors import cosine, max_sim, vector
from sievework.operators.fusion import top


def dense_top_k(df: DataFrame, query: Sequence[float], k: int = 40, id_col: str = "id", vector_col: str = "embedding", least: float | None = None) -> DataFrame:
    """(id, score): the k nearest by cosine; a top-k per partition and a merge, no shuffle of vectors."""
    scored = df.select(F.col(id_col).alias("id"), cosine(vector_col, vector(query)).alias("score"))
    if least is not None:
        scored = scored.where(F.col("score") >= least)
    return top(scored, k)


def unit_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of an array<float|double> column as rows of length 1, and their places; null and zero vectors, and
    vectors with a null, are left out."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy()
    flat = pc.list_flatten(column).cast(pa.float64())
    values = flat.to_numpy(zero_copy_only=False)  # a null number is NaN
    width = int(lengths.max()) if len(lengths) else 0
    at = np.flatnonzero(lengths == width) if width else np.zeros(0, np.int64)
    if (lengths[lengths > 0] != width).any():
        raise ValueError("vectors differ in length")
    X = values.reshape(-1, width) if width else np.zeros((0, 0))
    norm = np.sqrt((X * X).sum(axis=1))
    good = norm > 0
    return X[good] / norm[good][:, None], at[good]


def dense_top_k_many(df: DataFrame, queries: Mapping[str, Sequence[float]], k: int = 40, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, id, score) for a stated set of queries: each Arrow batch meets all of them in one matrix product and
    gives its own k best of each; these are merged. Rows with a null or zero vector are not found."""
    names = list(queries)
    Q = np.array([queries[n] for n in names], float)
    Q /= np.maximum(np.linalg.norm(Q, axis=1, keepdims=True), 1e-300)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            X, place = unit_rows(batch.column(1))
            if not len(X):
                continue
            S = Q @ X.T
            m = min(k, S.shape[1])
            at = np.argsort(-S, axis=1, kind="stable")[:, :m]
            yield pa.record_batch([pa.array(np.repeat(names, m)), batch.column(0).take(pa.array(place[at.ravel()])), pa.array(np.take_along_axis(S, at, 1).ravel())], ["query_id", "id", "score"])

    kind = dict(df.dtypes)[id_col]
    # Within a batch ties go by place, so rows come in order of their ids.
    found = df.select(F.col(id_col).alias("id"), vector_col).sortWithinPartitions("id").mapInArrow(run, f"query_id string, id {kind}, score double")
    return top(found, k, ["query_id"])


def sparse_top_k(df: DataFrame, query: Mapping[int | str, float], k: int = 40, id_col: str = "id", tokens_col: str = "tokens") -> DataFrame:
    """(id, score) by inner product of a map token -> weight with the query's; rows without a common token are left out."""
    weights = F.create_map(*[F.lit(x) for pair in query.items() for x in pair])
    common = F.map_filter(F.col(tokens_col), lambda t, _: t.isin(*query))
    score = F.aggregate(F.map_entries(common), F.lit(0.0), lambda s, e: s + e["value"].cast("double") * F.element_at(weights, e["key"]))
    return top(df.where(F.size(common) > 0).select(F.col(id_col).alias("id"), score.alias("score")), k)


def late_interaction(df: DataFrame, query: Sequence[Sequence[float]], k: int = 10, id_col: str = "id", vectors_col: str = "vectors") -> DataFrame:
    """(id, score): candidates by the sum of each query vector's best product."""
    q = F.array(*[vector(v) for v in query])
    return top(df.select(F.col(id_col).alias("id"), max_sim(q, vectors_col).alias("score")), k)


PIVOTS, BLOCK = 32, 1024


def near_copies(new: DataFrame, stored: DataFrame, threshold: float = 0.95, vector_col: str = "embedding", id_col: str = "id", pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """(id): rows of ``new`` with a stored row of cosine >= threshold, compared with all that could be one.

    Angles are a metric. Stored rows belong to the cell of their nearest pivot (some stored rows, PIVOTS at most), and a
    new row goes to each cell whose pivot is at most twice the threshold's angle farther than its nearest one, which
    loses no copy. The stored rows of a cell are dealt to blocks of about ``block`` rows, and new rows stream past each
    block in matrix products, so that a task holds one block.
    """
    sample = stored.where(F.col(vector_col).isNotNull()).orderBy(F.xxhash64(id_col), id_col).limit(pivots).select(vector_col)
    P, _ = unit_rows(sample.toArrow()[vector_col].combine_chunks())  # at most ``pivots`` rows
    kind = dict(new.dtypes)[id_col]
    reach = 2 * float(np.arccos(min(1.0, max(-1.0, threshold)))) + 1e-9

    def cells(every: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                X, place = unit_rows(batch.column(1))
                if not len(X) or not len(P):
                    continue
                angle = np.arccos(np.clip(X @ P.T, -1, 1))
                near = angle.min(axis=1, keepdims=True)
                row, cell = np.nonzero(angle <= near + reach) if every else (np.arange(len(X)), angle.argmin(axis=1))
                lists = pa.FixedSizeListArray.from_arrays(pa.array(X[row].ravel()), X.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.record_batch([pa.array(cell.astype(np.int32)), batch.column(0).take(pa.array(place[row])), lists], ["cell", "id", "v"])

        return run

    held = stored.select(F.col(id_col).cast(kind).alias("id"), vector_col).mapInArrow(cells(False), f"cell int, id {kind}, v array<double>")
    asked = new.select(F.col(id_col).alias("id"), vector_col).mapInArrow(cells(True), f"cell int, id {kind}, v array<double>")
    blocks = held.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))  # a row for each pivot
    held = held.join(F.broadcast(blocks), "cell").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    asked = asked.join(F.broadcast(blocks), "cell").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = held.select("cell", "block", F.lit(0).alias("side"), "id", "v").unionByName(asked.select("cell", "block", F.lit(1).alias("side"), "id", "v"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, matrix = None, []
        for batch in batches:
            cell, part, side = (batch.column(i).to_numpy() for i in range(3))
            key = cell.astype(np.int64) << 32 | part
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]) | (side[1:] != side[:-1])) + 1).tolist(), len(key)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if key[a] != unit:
                    unit, matrix = key[a], []
                X, place = unit_rows(batch.column(4).slice(a, b - a))
                if side[a] == 0:
                    matrix.append(X)
                elif matrix:
                    hit = np.zeros(len(X), bool)
                    for M in matrix:
                        hit |= (X @ M.T >= threshold - 1e-12).any(axis=1)
                    found = batch.column(3).slice(a, b - a).take(pa.array(place[hit]))
                    yield pa.record_batch([found], ["id"])

    n = int(new.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "cell", "block").sortWithinPartitions("cell", "block", "side").mapInArrow(compare, f"id {kind}").distinct()


def without_near_copies(new: DataFrame, stored: DataFrame, threshold: float = 0.95, vector_col: str = "embedding", id_col: str = "id", **settings: int) -> DataFrame:
    """Rows of ``new`` without a stored row of cosine >= threshold (rows of ``new`` do not remove each other); rows with
    a null or zero vector stay."""
    copies = near_copies(new, stored, threshold, vector_col, id_col, **settings).withColumnRenamed("id", "_id")
    return new.join(copies, F.col(id_col) == F.col("_id"), "left_anti")


def signs(vector_col: str, planes: Sequence[Sequence[float]]) -> Column:
    """A blocking key: on which side of each plane the vector lies."""
    from sievework.functions.vectors import dot

    return F.concat(*[F.when(dot(vector_col, vector(p)) >= 0, "1").otherwise("0") for p in planes])
