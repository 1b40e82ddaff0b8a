"""Token ids in fixed-width bit-packed shard files with random access.

A shard file holds the ids of consecutive documents, each id in the fewest bits that the vocabulary needs:

    room     8 unsigned 64-bit zeros
    payload  blocks of ``block ids`` ids, each block padded to whole bytes
    offsets  blocks + 1 unsigned 64-bit numbers: where each block begins in the payload
    index    documents x (id of the document as signed, first id within the shard as unsigned) 64-bit numbers
    footer   8 unsigned 64-bit little-endian numbers: MAGIC, bits, block ids, documents, ids, bytes of payload,
             blocks, documents without an id (they come first, with the least number as id)

Files are written to a temporary name and renamed, so a task that is run again leaves one whole file. Beside the
shards, MANIFEST (a Parquet table) holds a row for each: shard, file, documents, n_ids, start (ids in all shards
before it), so that a folder can be read without what wrote it.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm.common import partitions, slices, task, texts
from sievework.llm.wordids import encode_column
from sievework.session import shared_path

MAGIC = 0x314B434150534449
HEADER = 8
MANIFEST = "manifest.parquet"
NO_ID = -(2**63)
MANIFEST_SCHEMA = "shard int, file string, documents long, n_ids long, start long"
#: Names that pyarrow has for stores which Spark names otherwise.
SCHEMES = {"s3a://": "s3://", "s3n://": "s3://"}
BLOCK = 1 << 14


def width(vocabulary: int) -> int:
    """The fewest bits that hold the ids 0 ... vocabulary - 1."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids in ``bits`` bits each, lowest bit first, padded to whole bytes."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    grid = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(grid.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    """The first n ids of packed data."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    flat = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return flat.astype(np.uint32) @ (np.uint32(1) << np.arange(bits, dtype=np.uint32))


def open_store(path: str) -> tuple[pafs.FileSystem, str]:
    for own, other in SCHEMES.items():
        if path.startswith(own):
            path = other + path.removeprefix(own)
    return pafs.FileSystem.from_uri(path)


class Writer:
    """One shard, block by block; memory is bounded by a block and the document index."""

    def __init__(self, path: str, bits: int, block: int = BLOCK):
        self.store, self.path = open_store(path)
        self.temporary = f"{self.path}.{uuid.uuid4().hex}"
        self.bits, self.block = bits, block
        self.file = self.store.open_output_stream(self.temporary)
        self.file.write(np.zeros(HEADER, "<u8").tobytes())
        self.rest, self.n, self.size = np.zeros(0, np.uint32), 0, 0
        self.offsets, self.index, self.no_id = [0], [], 0

    def add(self, doc_ids: pa.Array, ids: np.ndarray, counts: np.ndarray) -> None:
        """Documents (those without an id before all others) with all their ids, one after the other, and the number
        of each one's."""
        first = self.n + np.cumsum(counts) - counts
        self.no_id += doc_ids.null_count
        self.index.append(np.stack([doc_ids.fill_null(NO_ID).to_numpy(), first], 1))
        self.n += len(ids)
        self.rest = np.concatenate([self.rest, ids])
        whole = len(self.rest) // self.block * self.block
        if whole:
            for at in range(0, whole, self.block):
                self._block(self.rest[at : at + self.block])
            self.rest = self.rest[whole:]

    def _block(self, ids: np.ndarray) -> None:
        data = pack(ids, self.bits)
        self.file.write(data)
        self.size += len(data)
        self.offsets.append(self.size)

    def close(self) -> None:
        if len(self.rest):
            self._block(self.rest)
        index = np.concatenate([np.zeros((0, 2), np.int64), *self.index])
        self.documents = len(index)
        self.file.write(np.array(self.offsets, "<u8").tobytes() + index.astype("<i8").tobytes())
        self.file.write(np.array([MAGIC, self.bits, self.block, len(index), self.n, self.size, len(self.offsets) - 1, self.no_id], "<u8").tobytes())
        self.file.close()
        self.store.move(self.temporary, self.path)


class Reader:
    """Random access to a shard: the footer, the offsets and the index are read once, blocks as they are asked for."""

    def __init__(self, path: str):
        store, name = open_store(path)
        self.file = store.open_input_file(name)
        end = self.file.size()
        foot = np.frombuffer(self.file.read_at(8 * HEADER, end - 8 * HEADER), "<u8").astype(np.int64)
        if foot[0] != MAGIC:
            raise ValueError(f"not a shard file: {path}")
        _, self.bits, self.block, self.documents, self.n, size, blocks, self.no_id = map(int, foot)
        at = 8 * HEADER + size
        self.offsets = np.frombuffer(self.file.read_at(8 * (blocks + 1), at), "<u8").astype(np.int64)
        index = np.frombuffer(self.file.read_at(16 * self.documents, at + 8 * (blocks + 1)), "<i8").reshape(-1, 2)
        self.doc_ids, self.starts = index[:, 0], np.append(index[:, 1], self.n)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids at start ... stop - 1 of the shard, from the blocks that hold them."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        lo, hi = self.offsets[first], self.offsets[last + 1]
        data = self.file.read_at(int(hi - lo), 8 * HEADER + int(lo))
        parts = [unpack(data[self.offsets[b] - lo : self.offsets[b + 1] - lo], self.bits, min(self.block, self.n - b * self.block)) for b in range(first, last + 1)]
        return np.concatenate(parts)[start - first * self.block : stop - first * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))

    def runs(self, ids: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray]]:
        """(first document, last document + 1, their ids), about ``ids`` ids at a time."""
        i = 0
        while i < self.documents:
            j = max(i + 1, int(np.searchsorted(self.starts, self.starts[i] + ids, side="right")) - 1)
            yield i, j, self.ids(int(self.starts[i]), int(self.starts[j]))
            i = j


def write_ids(docs: DataFrame, path: str, tokenizer: str, vocabulary: int, end: int | None, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """Encode every whole text and write shards in ascending order of the id; returns the manifest.

    Manifest: shard int, file, documents, n_ids, start long (ids in all shards before it); it is written beside the
    shards, too. Documents are dealt to shards by ranges of the id, and rows of one id by a hash of the text and the
    text, so that every run gives the same order and a hot id is spread. A null or empty text has the end id only;
    null ids come first; repeated rows are written each; a very long text is encoded whole. Other columns are ignored.
    An empty table gives no shards.
    """
    bits = width(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, shard = None, -1
        for batch in batches:
            for piece in slices(batch, limit=8 << 20):
                if writer is None:
                    shard = piece.column(0)[0].as_py()
                    writer = Writer(f"{path}/shard-{shard:06d}.ids", bits, block)
                writer.add(piece.column(1), *encode_column(piece.column(2), tokenizer, end))
        if writer is not None:
            writer.close()
            yield pa.record_batch([pa.array([shard], pa.int32()), pa.array([f"shard-{shard:06d}.ids"]), pa.array([writer.documents], pa.int64()), pa.array([writer.n], pa.int64())], ["shard", "file", "documents", "n_ids"])

    spark = docs.sparkSession
    store, name = open_store(path)
    store.create_dir(name, recursive=True)
    source = texts(docs, id_col, text_col).withColumn("tie", F.xxhash64("text"))
    ordered = source.repartitionByRange(max(partitions(spark), 1), "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select(F.spark_partition_id().alias("shard"), "doc_id", "text")
    rows = sorted(tuple(r) for r in ordered.mapInArrow(task(run, ["words"]), "shard int, file string, documents long, n_ids long").collect())  # one row a shard
    starts = np.concatenate([[0], np.cumsum([r[3] for r in rows])]).tolist()
    manifest = spark.createDataFrame([(*r, s) for r, s in zip(rows, starts, strict=False)], MANIFEST_SCHEMA)
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{path}/{MANIFEST}")
    return spark.read.schema(MANIFEST_SCHEMA).parquet(f"{path}/{MANIFEST}")


def read_ids(spark: SparkSession, path: str, manifest: DataFrame | None = None, derive: Callable[[list[np.ndarray]], list[pa.Array]] | None = None, schema: str = "ids array<int>") -> DataFrame:
    """Per document, from the files: doc_id, start long (ids of all documents before it), ids array<int>.

    manifest: by default the one in the folder. derive: what stands in place of ids, from a list of the id arrays of
    some documents; ``schema`` names it.
    """
    manifest = spark.read.schema(MANIFEST_SCHEMA).parquet(f"{path}/{MANIFEST}") if manifest is None else manifest
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                reader = Reader(f"{path}/{file}")
                for i, j, ids in reader.runs():
                    cuts = reader.starts[i : j + 1]
                    if derive is None:
                        own = [pa.ListArray.from_arrays(pa.array((cuts - cuts[0]).astype(np.int32)), pa.array(ids.astype(np.int32)))]
                    else:
                        own = derive(np.split(ids, cuts[1:-1] - cuts[0]))
                    yield pa.record_batch([pa.array(reader.doc_ids[i:j], mask=np.arange(i, j) < reader.no_id), pa.array(start + cuts[:-1]), *own], ["doc_id", "start", *names])

    files = manifest.select("file", "start").repartition(max(1, manifest.count()))
    return files.mapInArrow(run, f"doc_id long, start long, {schema}")


def sizes_and_crc(documents: list[np.ndarray]) -> list[pa.Array]:
    """n_tokens and the unsigned crc32 of each document's ids as little-endian unsigned 32-bit integers."""
    return [pa.array([len(d) for d in documents], pa.int64()), pa.array([zlib.crc32(d.astype("<u4").tobytes()) for d in documents], pa.int64())]


def new_folder(spark: SparkSession) -> str:
    """A folder for shards in the shared folder."""
    path = shared_path(spark, "ids")
    return path if "://" in path else f"file://{path}"
