"""Language-model scores by stupid backoff, computed relationally.

The count tables hold every n-gram of the corpus (orders 1 to ``order``) and are partitioned by the leading bits of its
hash. To join them with the exploded n-grams of the documents without a row for each occurrence, the documents of a
stretch of a scan form a block: its distinct n-grams travel sorted and compressed, one row for each block and
partition that has some, the partition sums them over all blocks (the count table) and answers each block with the
totals of just its n-grams, in the same order. A block then scores its documents. A frequent n-gram weighs as one entry
per block, and the rows are never more than the distinct n-grams of the blocks. The number of partitions follows from
the bytes of text, so that what a task holds of a count table does not grow with the corpus.

    S(w | u v) = c(u v w) / c(u v)      if c(u v w) >= min_count
                 alpha * S(w | v)       otherwise;   S(w) = c(w) / N

The first words of a text have only as much context as there is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm import textkernels as K
from sievework.llm.common import grouped, partitions, slices, task, texts
from sievework.session import materialise

ORDER, ALPHA, MIN_COUNT = 3, 0.4, 2
BLOCK_BYTES = 6 << 20  # of text in a block
PART_BYTES = 6 << 20  # of text for which there is one partition of the count tables; its n-grams take about twice that
HASH_BITS = 64  # of an n-gram's hash; fewer save disk, but let different n-grams share a count
PART_BITS = 24  # leading bits of the hash that partitions are told by


def squeeze(lists: list[np.ndarray]) -> bytes:
    """Lists of unsigned 64-bit numbers, each byte plane by byte plane, compressed together."""
    import zstandard

    planes = [np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes() for x in lists]
    return zstandard.ZstdCompressor(level=1).compress(np.array([len(x) for x in lists], "<u4").tobytes() + b"".join(planes))


def stretch(data: bytes, n: int) -> list[np.ndarray]:
    """The ``n`` lists again."""
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    cuts = np.concatenate([[0], np.cumsum(8 * raw[: 4 * n].view("<u4").astype(np.int64))]) + 4 * n
    return [np.ascontiguousarray(raw[a:b].reshape(8, -1).T).view("<u8").ravel() for a, b in zip(cuts, cuts[1:], strict=False)]


class Grams:
    """The n-grams of a block: for each order the distinct hashes in order, their counts, and, if places are asked for,
    the entry and the first word of each occurrence."""

    def __init__(self, array: pa.Array, order: int, bits: int, places: bool = True):
        self.words = K.Words(array)
        self.tables = []
        for n in range(1, order + 1):
            hashes, first = self.words.windows(n)
            hashes >>= np.uint64(64 - bits)
            if places:
                distinct, place = np.unique(hashes, return_inverse=True)
                self.tables.append((distinct, None, place.astype(np.int32), first.astype(np.int32)))
            else:
                self.tables.append((*np.unique(hashes, return_counts=True), None, None))

    def score(self, totals: list[np.ndarray], alpha: float, min_count: int) -> tuple[np.ndarray, np.ndarray]:
        """Natural logarithms of S * N ** (tokens backed off to single words), summed for each text, and these tokens."""
        w = self.words
        n = len(w.starts)
        seen = [np.zeros(n) for _ in totals]  # c of the n-gram that begins at each word
        for counts, (_, _, place, first), total in zip(seen, self.tables, totals, strict=True):
            counts[first] = total[place]
        at = np.arange(n)
        depth = at - w.first[w.row] if n else at  # words of the text in front
        logs = np.log(np.maximum(seen[0], 1))
        alone = np.ones(n, np.int64)
        for k in range(2, len(totals) + 1):
            can = depth >= k - 1
            begin = at[can] - (k - 1)
            whole, context = seen[k - 1][begin], seen[k - 2][begin]
            hit = whole >= min_count
            lower = logs[can] + np.log(alpha)
            logs[can] = np.where(hit, np.log(np.maximum(whole, 1)) - np.log(np.maximum(context, 1)), lower)
            alone[can] *= ~hit
        return K.per_row(logs, w.first), K.per_row(alone, w.first)


def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """(number, fingerprint, rows) of the blocks of a task's rows; the same whenever the scan is run."""
    held: list[pa.RecordBatch] = []
    size = number = 0

    def close():
        table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        data, offsets = K.buffers(table.column(0))
        mark = len(data) * 1_000_003 + int(K.mix(data[:: max(1, len(data) // 4096)].astype(np.uint64) + np.arange(1, len(data[:: max(1, len(data) // 4096)]) + 1, dtype=np.uint64)).sum(dtype=np.uint64) >> np.uint64(24))
        return table.column(2)[0].as_py() << 32 | number, mark, table

    for batch in batches:
        for piece in slices(batch, limit=1 << 20):
            held.append(piece)
            size += piece.column(0).nbytes
            if size >= BLOCK_BYTES:
                yield close()
                held, size, number = [], 0, number + 1
    if held:
        yield close()


COLUMNS = ["part", "block", "mark", "payload"]
SCHEMA = "part int, block long, mark long, payload binary"


def requests(source: DataFrame, parts: int, order: int, bits: int) -> DataFrame:
    """For every block and partition that has some of its n-grams: their hashes and counts."""
    top = min(bits, PART_BITS)
    bounds = np.array([-(-(i << top) // parts) for i in range(1, parts)], np.uint64) << np.uint64(bits - top)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, mark, table in blocks_of(batches):
            grams = Grams(table.column(0), order, bits, places=False)
            cuts = np.stack([np.concatenate([[0], np.searchsorted(t[0], bounds), [len(t[0])]]) for t in grams.tables])
            some = np.flatnonzero((cuts[:, 1:] > cuts[:, :-1]).any(0))
            for a in range(0, len(some), 256):
                own = some[a : a + 256]
                data = []
                for part in own.tolist():
                    lists = []
                    for (distinct, count, _, _), cut in zip(grams.tables, cuts, strict=True):
                        lo, hi = cut[part], cut[part + 1]
                        lists += [np.diff(distinct[lo:hi], prepend=np.uint64(0)), count[lo:hi]]
                    data.append(squeeze(lists))
                n = len(own)
                yield pa.record_batch([pa.array(own.astype(np.int32)), pa.array([block] * n, pa.int64()), pa.array([mark] * n, pa.int64()), pa.array(data, pa.binary())], COLUMNS)

    return source.mapInArrow(task(run), SCHEMA)


def count_tables(asked: DataFrame, parts: int, order: int) -> DataFrame:
    """Sum each partition's n-grams over all blocks and answer every block with the totals, in the block's order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, "part"):
            lists = [stretch(x, 2 * order) for x in table["payload"].to_pylist()]
            totals: list[list[np.ndarray]] = [[] for _ in lists]
            for n in range(order):
                keys = [np.cumsum(x[2 * n], dtype=np.uint64) for x in lists]
                distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
                total = np.bincount(place, np.concatenate([x[2 * n + 1] for x in lists]), len(distinct)).astype(np.uint64)[place]
                at = 0
                for held, key in zip(totals, keys, strict=True):
                    held.append(total[at : at + len(key)])
                    at += len(key)
            for a in range(0, len(lists), 64):
                rows = table.slice(a, 64)
                yield pa.record_batch([*(rows[c].combine_chunks() for c in COLUMNS[:3]), pa.array([squeeze(x) for x in totals[a : a + 64]], pa.binary())], COLUMNS)

    # One task for each partition of the tables: hashing the numbers would let some meet in one task.
    return asked.repartitionById(parts, "part").sortWithinPartitions("part").mapInArrow(task(run), SCHEMA)


def block_texts(source: DataFrame) -> DataFrame:
    """The texts and ids of each block, compressed, as the block's row of partition -1."""
    import zstandard

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, mark, table in blocks_of(batches):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as out:
                out.write_batch(table)
            data = zstandard.ZstdCompressor(level=6).compress(sink.getvalue())
            yield pa.record_batch([pa.array([-1], pa.int32()), pa.array([block], pa.int64()), pa.array([mark], pa.int64()), pa.array([data])], COLUMNS)

    return source.mapInArrow(task(run), SCHEMA)


def same_when_read_again(df: DataFrame) -> bool:
    """No shuffle, sort or random number stands between the stored rows and this table."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return not any(x in plan for x in ("Exchange", "Sort", "Join", "Aggregate", "rand(", "randn(", "uuid(", "Limit", "Sample", "PythonUDF", "MapInArrow", "MapInPandas"))


def backoff_scores(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA, min_count: int = MIN_COUNT, bits: int = HASH_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_tokens long, log_score double (sum of ln S), mean_log double (null without words).

    Counts cover all documents, the scored one included; an n-gram of order 2 or more seen fewer than ``min_count``
    times is no evidence. Null and empty texts have no words and the score 0; very long texts are read whole. Repeated
    rows are counted and scored each, rows with a null id, too. Other columns are ignored; an empty table gives an
    empty result. The rows are read twice; if they do not come straight from where they are stored, they are written
    as a table first.
    """
    import zstandard

    source = texts(docs, id_col, text_col).select("text", "doc_id")
    if not same_when_read_again(source):
        source = materialise(source, "backoff-rows")
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    source = source.withColumn("task", F.spark_partition_id())
    parts = min(1 << min(PART_BITS, bits), max(partitions(docs.sparkSession), -(-size // PART_BYTES)))
    rows = count_tables(requests(source, parts, order, bits), parts, order).unionByName(block_texts(source))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, "block"):
            lists = table["payload"].to_pylist()
            held = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(lists[0])).read_all().combine_chunks().to_batches()[0] if table["part"][0].as_py() == -1 else None
            if held is None or len(set(table["mark"].to_pylist())) != 1:
                raise RuntimeError("the rows changed between two readings")
            grams = Grams(held.column(0), order, bits)
            answers = [stretch(x, order) for x in lists[1:]]
            totals = [np.concatenate([np.zeros(0), *(x[n] for x in answers)]) for n in range(order)]
            score, alone = grams.score(totals, alpha, min_count)
            yield pa.record_batch([held.column(1), pa.array(grams.words.count.astype(np.int64)), pa.array(score), pa.array(alone.astype(np.int64))], ["doc_id", "n_tokens", "raw", "alone"])

    # Blocks are numbered within the scan's tasks: dealt in turn, about one comes to each task.
    n = max(partitions(docs.sparkSession), -(-size // BLOCK_BYTES))
    each = -(-n // max(1, source.rdd.getNumPartitions()))
    turn = F.pmod(F.shiftright("block", 32) * each + F.col("block").bitwiseAND(0xFFFFFFFF), F.lit(n)).cast("int")
    scored = materialise(rows.repartitionById(n, turn).sortWithinPartitions("block", "part").mapInArrow(task(run), "doc_id long, n_tokens long, raw double, alone long"), "backoff-scores")
    tokens = scored.agg(F.sum("n_tokens")).first()[0] or 1
    score = F.col("raw") - F.col("alone") * F.log(F.lit(float(max(tokens, 1))))
    return scored.select("doc_id", "n_tokens", score.alias("log_score"), F.when(F.col("n_tokens") > 0, score / F.col("n_tokens")).alias("mean_log"))
