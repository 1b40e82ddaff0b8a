"""Linear models: solvers, features of bounded samples on the driver, and blocks of the features of all labelled rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import broadcast_if_small, by_slices, task, texts
from sievework.session import materialise


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def minimise(function: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, rounds: int = 80, memory: int = 8) -> np.ndarray:
    """L-BFGS with backtracking; function returns a value and its gradient."""
    value, gradient = function(x)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        q, used = gradient.copy(), []
        for s, y in reversed(pairs):
            a = s @ q / (y @ s)
            q -= a * y
            used.append(a)
        if pairs:
            s, y = pairs[-1]
            q *= (s @ y) / (y @ y)
        for (s, y), a in zip(pairs, reversed(used), strict=True):
            q += s * (a - y @ q / (y @ s))
        slope, step = -(q @ gradient), 1.0
        if slope > -1e-12:
            break
        while True:
            next_x = x - step * q
            next_value, next_gradient = function(next_x)
            if next_value <= value + 1e-4 * step * slope or step < 1e-6:
                break
            step /= 2
        s, y = next_x - x, next_gradient - gradient
        if s @ y > 1e-12:
            pairs = [*pairs[1 - memory :], (s, y)] if len(pairs) >= memory else [*pairs, (s, y)]
        done = value - next_value < 1e-7 * max(1.0, abs(value))
        x, value, gradient = next_x, next_value, next_gradient
        if done:
            break
    return x


def logistic(X: np.ndarray, y: np.ndarray, ridge: float = 1e-3, weight: np.ndarray | None = None, rounds: int = 80) -> tuple[np.ndarray, float]:
    """Weights and intercept of a ridge logistic regression; the intercept is not penalised."""
    weight = np.ones(len(y)) if weight is None else weight
    weight = weight / weight.sum()

    def loss(v: np.ndarray) -> tuple[float, np.ndarray]:
        w, b = v[:-1].astype(X.dtype), v[-1]
        z = (X @ w).astype(float) + b
        value = float((weight * (np.logaddexp(0, z) - y * z)).sum() + ridge * (v[:-1] @ v[:-1]) / 2)
        g = weight * (sigmoid(z) - y)
        return value, np.append((X.T @ g.astype(X.dtype)).astype(float) + ridge * v[:-1], g.sum())

    v = minimise(loss, np.zeros(X.shape[1] + 1), rounds)
    return v[:-1], float(v[-1])


#: Most bytes of features that a sample may bring to the driver.
FEATURE_BYTES = 128 << 20


def labelled_ids(labels: DataFrame, label: str, allowed: Column | None = None, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, y) of the labelled ids that meet ``allowed``; of several labels for one id the largest counts."""
    rows = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y is not null")
    if allowed is not None:
        rows = rows.where(allowed)
    return rows.groupBy("doc_id").agg(F.max("y").alias("y"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int, allowed: Column | None = None, id_col: str = "doc_id", text_col: str = "text", halves: bool = False) -> DataFrame:
    """(doc_id, text, y) of at most ``bound`` labelled ids, those of the smallest hash, one row for each.

    allowed: a condition on doc_id that a training row must meet. Rows without a label are left out; of several
    labels for one id the largest counts, and of several rows of one id the text with the smallest hash. A null text
    is empty. halves: at most bound / 2 rows of either label.
    """
    rows = labelled_ids(labels, label, allowed, id_col)
    parts = [(rows.where("y = 0"), bound // 2), (rows.where("y = 1"), bound // 2)] if halves else [(rows, bound)]
    chosen = [part.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for part, most in parts]
    ids = [(r["doc_id"], r["y"]) for part in chosen for r in part.collect()]  # at most ``bound`` rows
    table = docs.sparkSession.createDataFrame(ids, "doc_id long, y int")  # at most ``bound`` rows of 12 bytes
    found = texts(docs, id_col, text_col).join(F.broadcast(table), "doc_id")
    return found.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("y").alias("y"))


def collect_sparse(sample: DataFrame, encode: Callable[[pa.Array], list[bytes]], most: int = FEATURE_BYTES) -> list[tuple[int, bytes]]:
    """(y, encoded features) of a sample, in the order of the ids; the executors compute the features. Rows that would
    bring more than ``most`` bytes to the driver in all are left out, those of the largest hash of the id first."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        data = pa.array(encode(batch.column(0)), pa.binary())
        return pa.record_batch([batch.column(1), batch.column(2), data], ["doc_id", "y", "data"])

    rows = materialise(sample.select("text", "doc_id", "y").mapInArrow(by_slices(run), "doc_id long, y int, data binary"), "features")
    sizes = rows.select("doc_id", F.octet_length("data").alias("n"), F.xxhash64("doc_id").alias("h")).collect()  # at most the sample's bound
    total, kept = 0, []
    for r in sorted(sizes, key=lambda r: (r["h"], r["doc_id"])):
        total += r["n"]
        if total > most:
            break
        kept.append(r["doc_id"])
    if len(kept) < len(sizes):
        rows = rows.join(F.broadcast(sample.sparkSession.createDataFrame([(i,) for i in kept], "doc_id long")), "doc_id", "left_semi")
    # Partition by partition: the driver's JVM holds one of them, Python each row's bytes once.
    found = sorted((r["doc_id"], r["y"], bytes(r["data"])) for r in rows.toLocalIterator())
    return [(y, data) for _, y, data in found]


def collect_features(sample: DataFrame, features: Callable[[pa.Array], np.ndarray], width: int, most: int = FEATURE_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """The feature matrix and the labels of a bounded sample, in the order of the ids."""

    def encode(array: pa.Array) -> list[bytes]:
        out = []
        for x in features(array):
            used = np.flatnonzero(x)
            out.append(used.astype("<u2").tobytes() + x[used].astype("<f4").tobytes())
        return out

    rows = collect_sparse(sample, encode, most)
    X = np.zeros((len(rows), width), np.float32)
    for i, (_, data) in enumerate(rows):
        n = len(data) // 6
        X[i, np.frombuffer(data, "<u2", n)] = np.frombuffer(data, "<f4", n, 2 * n)
    return X, np.array([y for y, _ in rows], dtype=float)


# All labelled rows


#: Most words of 64 bits in the table that tells which ids may have a label (8 MB): ids beyond about a quarter of its bits
#: let more rows without a label through to the shuffle, which drops them.
LABEL_WORDS = 1 << 20
#: Rows of the rarer label that a block should hold; where they are too few they go to several blocks.
RARE = 64


def label_table(ids: DataFrame, count: int) -> tuple[np.ndarray, Column]:
    """A table of bits with those of all ids set, and the bit of a row's id as a column."""
    words = 1
    while words < min(LABEL_WORDS, count // 4):
        words *= 2
    bit = F.xxhash64("doc_id").bitwiseAND(64 * words - 1)
    rows = ids.groupBy(F.shiftright(bit, 6).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(xxhash64(doc_id) & 63 as int))")).alias("bits"))
    got = rows.toArrow()  # at most LABEL_WORDS rows of 12 bytes
    table = np.zeros(words, np.uint64)
    table[got["word"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return table, bit


def sparse_columns(X: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Places (16 bits) and values (32 bits) of the figures other than zero, a binary value for each row."""
    row, at = np.nonzero(X)
    cuts = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(X)))])
    data = [(at.astype("<u2"), 2), (X[row, at].astype("<f4"), 4)]
    return tuple(pa.Array.from_buffers(pa.binary(), len(X), [None, pa.py_buffer((cuts * size).astype(np.int32)), pa.py_buffer(values)]) for values, size in data)


def with_labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows by id, an id's label before its features: the first features of each id that has a label."""
    last_id, last_y = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(1).to_numpy()
        y = batch.column(2).fill_null(-1).to_numpy(zero_copy_only=False)
        before = np.concatenate([[ids[0] if last_id is None else last_id], ids[:-1]])
        before_y = np.concatenate([[-1 if last_y is None else last_y], y[:-1]])
        kept = np.flatnonzero((y < 0) & (before_y >= 0) & (before == ids))
        last_id, last_y = ids[-1], y[-1]
        if len(kept):
            out = batch.take(pa.array(kept))
            yield pa.record_batch([out.column(0), out.column(1), pa.array(before_y[kept].astype(np.int32)), out.column(4), out.column(5), out.column(6)], ["block", "doc_id", "y", "home", "at", "value"])


def labelled_blocks(docs: DataFrame, ids: DataFrame, counts: dict[int, int], features: Callable[[pa.Array], np.ndarray], most: int) -> DataFrame:
    """(block, doc_id, y, home, at, value): the features of all labelled rows, in stored blocks of about ``most`` rows.

    docs: (doc_id, text); ids: (doc_id, y) with y 0 or 1, each in docs; counts: rows of each y. Blocks are dealt by a hash
    of the id, one file for each, rows in order of the id; of several texts of one id the one with the smallest hash counts.
    A label with less than RARE rows for each block has each of them in several blocks; ``home`` marks a row's first.
    """
    blocks = -(-sum(counts.values()) // most)
    rare = min(counts, key=lambda y: (counts[y], y))
    copies = min(blocks, -(-RARE * blocks // counts[rare]))
    table, bit = label_table(ids, sum(counts.values()))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        bits = batch.column(3).to_numpy()
        batch = batch.filter(pa.array((table[bits >> 6] >> (bits & 63).astype(np.uint64)) & np.uint64(1) > 0))
        if batch.num_rows:
            return pa.record_batch([batch.column(1), batch.column(2), *sparse_columns(features(batch.column(0)))], ["doc_id", "h", "at", "value"])

    rows = docs.where("doc_id is not null").select("text", "doc_id", F.xxhash64("text").alias("h"), bit.alias("bit"))
    rows = rows.mapInArrow(by_slices(run, rows=256), "doc_id long, h long, at binary, value binary")
    labels = ids.select("doc_id", "y", (F.col("y") == rare).alias("rare"), F.lit(None).cast("long").alias("h"), F.lit(None).cast("binary").alias("at"), F.lit(None).cast("binary").alias("value"))
    rows = rows.withColumn("y", F.lit(None).cast("int"))
    if copies > 1:
        few = broadcast_if_small(labels.where("rare").select("doc_id", "rare"), counts[rare], 12)
        rows = rows.join(few, "doc_id", "left").withColumn("rare", F.coalesce("rare", F.lit(False)))
    else:
        rows = rows.withColumn("rare", F.lit(False))
    every = labels.unionByName(rows).withColumn("copy", F.explode(F.when(F.col("rare"), F.sequence(F.lit(0), F.lit(copies - 1))).otherwise(F.array(F.lit(0)))))
    block = F.pmod(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(blocks)) + F.col("copy"), F.lit(blocks)).cast("int")
    every = every.select(block.alias("block"), "doc_id", "y", "h", (F.col("copy") == 0).alias("home"), "at", "value")
    dealt = every.repartitionById(blocks, F.col("block")).sortWithinPartitions("block", "doc_id", F.col("h").asc_nulls_first())
    # A group of rows of a file is never larger than the file: no reader gets a part of a block.
    found = dealt.mapInArrow(task(with_labels), "block int, doc_id long, y int, home boolean, at binary, value binary")
    return materialise(found, "blocks", **{"parquet.block.size": str(1 << 30)})


def block_columns(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places, values and first place of each row (with the end) of the parts of a block."""
    for batch in table.to_batches():
        if batch.num_rows:
            at, value = (batch.column(batch.schema.get_field_index(c)) for c in ("at", "value"))
            cuts = np.frombuffer(at.buffers()[1], np.int32)[at.offset : at.offset + len(at) + 1].astype(np.int64)
            first = np.frombuffer(value.buffers()[1], np.int32)[value.offset : value.offset + len(value) + 1]
            data = np.frombuffer(at.buffers()[2], "<u2", (cuts[-1] - cuts[0]) // 2, cuts[0]) if cuts[-1] > cuts[0] else np.zeros(0, "<u2")
            figures = np.frombuffer(value.buffers()[2], "<f4", (first[-1] - first[0]) // 4, first[0]) if first[-1] > first[0] else np.zeros(0, "<f4")
            yield data, figures, (cuts - cuts[0]) // 2
