"""What the operators of this package share: reading rows, streaming grouped batches, partition counts."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.session import prepare

#: A table of at most this many bytes may be broadcast; larger ones are joined by shuffle.
BROADCAST_BYTES = 32 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the whole text; a null text is empty. Other columns, whatever their names, play no part."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def broadcast_if_small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """Hint a broadcast only if the counted rows fit the bound; else the join shuffles both sides."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = 2 << 20, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of at most ``rows`` rows with about ``limit`` bytes of text each, whole rows only."""
    if not batch.num_rows:
        return
    sizes = np.array(pc.binary_length(batch.column(batch.schema.get_field_index(column))).fill_null(0), dtype=np.int64)
    block = np.cumsum(sizes) // limit + np.arange(batch.num_rows) // rows
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, b - a)


#: What a worker remembers between tasks, by name: functions that forget it.
MEMOS: dict[str, Callable[[], None]] = {}


def release() -> None:
    """Give memory that is free but held by the allocators back to the machine."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def task(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keeps: Sequence[str] = ()):
    """A mapInArrow function that drops other operators' memos when it begins and free memory then and when it ends, so that
    workers which Spark uses again do not grow from stage to stage."""

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, forget in MEMOS.items():
            if name not in keeps:
                forget()
        release()
        try:
            yield from run(batches)
        finally:
            release()

    return bounded


def by_slices(function: Callable[[pa.RecordBatch], pa.RecordBatch | None], limit: int = 2 << 20, column: str = "text", rows: int = 4096, keeps: Sequence[str] = ()):
    """A mapInArrow function that applies ``function`` to bounded runs of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, column, limit, rows):
                out = function(piece)
                if out is not None and out.num_rows:
                    yield out

    return task(run, keeps)


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The runs of equal ``key`` in batches sorted by it, one table each, across batch borders."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if held and values[a] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = values[a]
    if held:
        yield pa.Table.from_batches(held)
