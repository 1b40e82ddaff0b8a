"""Substring dedup: words under a window of consecutive words that also starts in a document with a smaller id.

Passes over the whole table:

0. Copies of a whole text (equal SHA-256) are one class, with its smallest and largest id; the row of the smallest id
   stands for all, and what is found for its windows holds for the others.
1. Every window of ``window`` words has an anchor, the smallest hash of the word runs within it; equal windows have
   equal anchors. Anchors are counted over all documents (one row for each anchor, slice and task before the shuffle)
   and those of two documents or more are marked in a bit table of fixed size. The table only lets through: a false
   mark costs time, and no shared window is missed.
2. Neighbouring windows under a marked anchor form a segment, sent to the shard of its anchor; anchors that occur very
   often send each window to the shard of the window instead. A task collapses equal segments and sends each shard
   one compressed block of words at a time; occurrences themselves are light rows without words.
3. Each shard builds an FM-index over its distinct segments and streams the windows through backward search. A window
   that comes through whole has the interval of all suffixes that begin with it, and so the smallest document.
4. Segments meet their occurrences again, by a 128-bit BLAKE2 digest of their bytes; windows with a smaller document
   are flagged, and each document gets the spans of its flagged words.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm import textkernels as K
from sievework.llm.common import broadcast_if_small, by_slices, grouped, partitions, slices, task, texts
from sievework.llm.fmindex import FMIndex
from sievework.session import materialise

WINDOW = 13
RUN = 5  # words that an anchor hashes
TABLE_BITS = 27  # of the bit table: 16 MB
OFTEN = 512  # occurrences from which an anchor's windows are dealt one by one
SEGMENT_WINDOWS = 16  # most windows in a segment, so that a bit mask holds them
SHARD_SEGMENTS = 20_000
HELD_BYTES = 12 << 20  # of segment words that a task holds before it packs them


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum over x[i : i + width] for every i with as many values."""
    have, out = 1, x
    while have * 2 <= width:
        out = np.minimum(out[: len(out) - have], out[have:])
        have *= 2
    if have < width:
        rest = width - have
        out = np.minimum(out[: len(out) - rest], out[rest:])
    return out


class Segments:
    """The segments of a batch: first word, number of windows, anchor."""

    def __init__(self, words: K.Words, window: int, run: int):
        self.words = words
        n = len(words.starts)
        empty = np.zeros(0, np.int64)
        self.first, self.windows, self.anchor = empty, empty, np.zeros(0, np.uint64)
        if n < window:
            return
        grams = np.full(n, np.iinfo(np.uint64).max, np.uint64)
        hashes, at = words.windows(run)
        grams[at] = hashes
        least = sliding_min(grams, window - run + 1)
        whole = np.flatnonzero(words.row[: n - window + 1] == words.row[window - 1 :])
        if not len(whole):
            return
        anchor = least[whole]
        fresh = np.concatenate([[True], (whole[1:] != whole[:-1] + 1) | (anchor[1:] != anchor[:-1]) | (words.row[whole[1:]] != words.row[whole[:-1]])])
        begin = np.flatnonzero(fresh)
        place = np.arange(len(whole)) - np.repeat(begin, np.diff(np.append(begin, len(whole))))
        begin = np.flatnonzero(place % SEGMENT_WINDOWS == 0)
        self.first, self.anchor = whole[begin], anchor[begin]
        self.windows = np.diff(np.append(begin, len(whole)))

    def pick(self, chosen: np.ndarray) -> None:
        self.first, self.windows, self.anchor = self.first[chosen], self.windows[chosen], self.anchor[chosen]


def count_anchors(source: DataFrame, window: int, run: int) -> DataFrame:
    """anchor, lo and hi (smallest and largest id), n (segments), summed per slice of rows."""

    def slice_counts(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        words = K.Words(batch.column(0))
        s = Segments(words, window, run)
        if not len(s.first):
            return None
        order = np.argsort(s.anchor, kind="stable")
        key, row = s.anchor[order], words.row[s.first[order]]
        lo, hi = (batch.column(i).to_numpy()[row] for i in (1, 2))
        cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        n = np.diff(np.append(cuts, len(key)))
        return pa.record_batch([pa.array(key[cuts].view(np.int64)), pa.array(np.minimum.reduceat(lo, cuts)), pa.array(np.maximum.reduceat(hi, cuts)), pa.array(n)], ["anchor", "lo", "hi", "n"])

    rows = source.select("text", "doc_id", "hi").mapInArrow(by_slices(slice_counts), "anchor long, lo long, hi long, n long")
    return rows.groupBy("anchor").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"))


def bit_table(keys: DataFrame, bits: int) -> np.ndarray:
    """A packed table of 2 ** bits bits, set at the leading bits of each anchor; built by the executors in 4 KB parts."""
    slot = F.shiftrightunsigned("anchor", 64 - bits) + 1
    parts = keys.groupBy(F.bitmap_bucket_number(slot).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
    table = np.zeros(max(4096, (1 << bits) // 8), np.uint8)
    got = parts.toArrow()  # at most 2 ** (bits - 15) rows of 4 KB
    for part, data in zip(got["part"].to_pylist(), got["bits"].to_pylist(), strict=True):
        table[(part - 1) * 4096 : (part - 1) * 4096 + len(data)] = np.frombuffer(data, np.uint8)
    return table


def marked(table: np.ndarray, bits: int, anchor: np.ndarray) -> np.ndarray:
    slot = (anchor >> np.uint64(64 - bits)).astype(np.int64)
    return (table[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)


def gather_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The byte spans as strings."""
    sizes = ends - starts
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    kind = np.int32 if max(int(cuts[-1]), len(data)) < 2**31 else np.int64
    at = np.repeat((starts - cuts[:-1]).astype(kind), sizes)
    at += np.arange(cuts[-1], dtype=kind)
    return pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data[at]))])


def pack_block(words: pa.Array, lo: np.ndarray, hi: np.ndarray) -> bytes:
    """Segments as one compressed block."""
    import zstandard

    sink = pa.BufferOutputStream()
    table = pa.record_batch([words, pa.array(lo), pa.array(hi)], ["words", "lo", "hi"])
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_batch(table)
    return zstandard.ZstdCompressor(level=3).compress(sink.getvalue())


def unpack_block(data: bytes) -> pa.Table:
    import zstandard

    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(data)).read_all()


def digests(segments: pa.Array) -> np.ndarray:
    """128 bits of BLAKE2 of each segment, as two numbers."""
    data, offsets = K.buffers(segments)
    view, cuts = memoryview(data), offsets.tolist()
    return np.frombuffer(b"".join([blake2b(view[a:b], digest_size=16).digest() for a, b in zip(cuts, cuts[1:], strict=False)]), "<i8").reshape(-1, 2)


def collapse(shard: np.ndarray | None, words: pa.Array, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One of each equal segment (their bytes are compared), in order of the shard: its place, smallest and largest id."""
    code = np.asarray(words.dictionary_encode().indices)
    order = np.lexsort((code, shard)) if shard is not None else np.argsort(code, kind="stable")
    c = code[order]
    cuts = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
    return order[cuts], np.minimum.reduceat(lo[order], cuts), np.maximum.reduceat(hi[order], cuts)


def cut_segments(source: DataFrame, shared: np.ndarray, often: np.ndarray, bits: int, shards: int, window: int, run: int) -> DataFrame:
    """Every occurrence of a segment under a marked anchor (digest, check, doc_id, more, row_key, first; doc_id + more is
    the largest id with the text), and, in rows with a shard, blocks of the distinct segments of a stretch of rows."""
    spark = source.sparkSession
    shared_, often_ = spark.sparkContext.broadcast(shared), spark.sparkContext.broadcast(often)  # 2 ** bits bits each
    names = ["digest", "check", "doc_id", "more", "row_key", "first", "shard", "block"]

    def cut(batch: pa.RecordBatch):
        words = K.Words(batch.column(0))
        s = Segments(words, window, run)
        s.pick(marked(shared_.value, bits, s.anchor))
        if not len(s.first):
            return None
        single = marked(often_.value, bits, s.anchor)
        plain = int((~single).sum())
        first = np.concatenate([s.first[~single], np.repeat(s.first[single], s.windows[single]) + K.spread(s.windows[single])])
        windows = np.concatenate([s.windows[~single], np.ones(len(first) - plain, np.int64)])
        # The words of the batch, one space between: a span of words is a span of bytes.
        sizes = words.ends - words.starts
        begin = np.concatenate([[0], np.cumsum(sizes + 1)])
        flat = np.full(begin[-1], 32, np.uint8)
        flat[np.arange(int(sizes.sum())) + np.repeat(np.arange(len(sizes)), sizes)] = words.data[~K.SPACE[words.data]]
        starts, ends = begin[first], begin[first + windows + window - 1] - 1
        segments = gather_spans(flat, starts, ends)
        digest = digests(segments)
        key = np.concatenate([s.anchor[~single], K.mix(digest[plain:, 0].astype(np.uint64))])
        shard = (K.mix(key) % np.uint64(shards)).astype(np.int32)
        row = words.row[first]
        lo, hi = (batch.column(i).to_numpy()[row] for i in (1, 2))
        n = len(row)
        light = pa.record_batch([*(pa.array(np.ascontiguousarray(digest[:, i])) for i in range(2)), pa.array(lo), pa.array(hi - lo), batch.column(3).take(pa.array(row)), pa.array((first - words.first[row]).astype(np.int32)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names)
        return light, (shard, segments, lo, hi)

    def blocks(held: list) -> Iterator[pa.RecordBatch]:
        shard, lo, hi = (np.concatenate([h[i] for h in held]) for i in (0, 2, 3))
        words = pa.chunked_array([h[1] for h in held]).combine_chunks()
        at, lo, hi = collapse(shard, words, lo, hi)
        words, shard = words.take(pa.array(at)), shard[at]
        cuts = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), len(shard)]
        data = [pack_block(words.slice(a, b - a), lo[a:b], hi[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
        n = len(data)
        yield pa.record_batch([*(pa.nulls(n, pa.int64()) for _ in range(5)), pa.nulls(n, pa.int32()), pa.array(shard[cuts[:-1]]), pa.array(data, pa.binary())], names)

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for piece in slices(batch, limit=1 << 20):  # shared segments weigh several times their text
                if (got := cut(piece)) is not None:
                    yield got[0]
                    held.append(got[1])
                    size += got[1][1].nbytes
                    if size > HELD_BYTES:
                        yield from blocks(held)
                        held, size = [], 0
        if held:
            yield from blocks(held)

    schema = "digest long, check long, doc_id long, more long, row_key long, first int, shard int, block binary"
    return source.select("text", "doc_id", "hi", "row_key").mapInArrow(task(stretches), schema)


def smallest_document(words: pa.Array, lo: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For distinct segments of one shard: the windows' smallest documents, segment after segment, and their offsets."""
    split = pc.split_pattern(words, " ")
    lengths = np.asarray(pc.list_value_length(split)).astype(np.int64)
    codes = np.asarray(pc.list_flatten(split).dictionary_encode().indices).astype(np.int64)
    index = FMIndex(codes, lengths)
    begin = np.concatenate([[0], np.cumsum(lengths)])
    windows = lengths - window + 1
    first = np.repeat(begin[:-1], windows) + K.spread(windows)
    owner = np.repeat(np.arange(len(lengths)), windows)
    matched, low, high = index.matches(codes, first, window)
    out = lo[owner]  # a window without a second occurrence
    many = np.flatnonzero((matched == window) & (high - low > 1))
    if len(many):
        # Intervals of different windows do not overlap, so each suffix is looked at once.
        starts, at = np.unique(low[many], return_index=True)
        ends = high[many][at]
        pairs = np.stack([starts, ends], 1).ravel()
        values = np.append(lo[index.sequence], np.iinfo(np.int64).max)
        least = np.minimum.reduceat(values, pairs)[::2]
        out[many] = least[np.searchsorted(starts, low[many])]
    return out, np.concatenate([[0], np.cumsum(windows)])


def search_shards(blocks: DataFrame, window: int) -> DataFrame:
    """digest, check, smallest array<long>: of segments with a window that some occurrence's document is not the first of."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, "shard"):
            rows = pa.concat_tables([unpack_block(data) for data in table["block"].to_pylist()]).combine_chunks()
            words = rows["words"].combine_chunks()
            at, lo, hi = collapse(None, words, rows["lo"].to_numpy(), rows["hi"].to_numpy())
            words = words.take(pa.array(at))
            least, cuts = smallest_document(words, lo, window)
            useful = np.flatnonzero(np.minimum.reduceat(least, cuts[:-1]) < hi)
            lists = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(least))
            lists = lists.take(pa.array(useful))
            digest = digests(words.take(pa.array(useful)))
            yield pa.record_batch([*(pa.array(np.ascontiguousarray(digest[:, i])) for i in range(2)), lists], ["digest", "check", "smallest"])

    n = partitions(blocks.sparkSession)
    return blocks.repartition(n, "shard").sortWithinPartitions("shard").mapInArrow(task(search), "digest long, check long, smallest array<long>")


def text_classes(source: DataFrame) -> DataFrame:
    """sha, lo, hi: of texts that documents of several ids have, the smallest and the largest id."""
    groups = source.select("doc_id", "sha").groupBy("sha").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
    return materialise(groups.where("lo < hi"), "text-classes")


def sha_of(id_col: str, text_col: str):
    """The SHA-256 of the text; null for a row without an id, which takes no part."""
    return F.when(F.col(id_col).isNotNull(), F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)))


def flagged_windows(docs: DataFrame, window: int = WINDOW, run: int = RUN, bits: int = TABLE_BITS, often: int = OFTEN, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The classes of equal texts, and doc_id, row_key, flags array<struct<first, mask, rest>>: windows that also start
    in a document with a smaller id, by the row that stands for a class; rest holds for the others of the class.

    row_key is xxhash64 of the text, so that rows which repeat an id with another text keep apart.
    """
    source = texts(docs, id_col, text_col).where("doc_id is not null").withColumn("sha", sha_of("doc_id", "text"))
    classes = text_classes(source)
    source = source.join(broadcast_if_small(classes, classes.count(), 56), "sha", "left").where("lo is null or doc_id = lo")
    source = source.select("text", "doc_id", F.coalesce("hi", "doc_id").alias("hi"), F.xxhash64("text").alias("row_key"))
    anchors = materialise(count_anchors(source, window, run).where("lo < hi").select("anchor", "n"), "anchors")
    total = anchors.agg(F.sum("n")).first()[0] or 0
    shards = max(4 * partitions(docs.sparkSession), total // SHARD_SEGMENTS + 1)
    cut = materialise(cut_segments(source, bit_table(anchors, bits), bit_table(anchors.where(F.col("n") > often), bits), bits, shards, window, run), "segments")
    found = search_shards(cut.where("shard is not null").select("shard", "block"), window)
    mask = "aggregate(sequence(0, size(smallest) - 1), 0, (m, i) -> m | if(smallest[i] < {}, shiftleft(1, i), 0))"
    occurrences = cut.where("shard is null").select("digest", "check", "doc_id", "more", "row_key", "first")
    flags = occurrences.join(found, ["digest", "check"]).withColumn("mask", F.expr(mask.format("doc_id")))
    flags = flags.withColumn("rest", F.expr(f"if(more = 0, mask, {mask.format('doc_id + more')})")).where("rest <> 0")
    flags = flags.groupBy("doc_id", "row_key").agg(F.collect_list(F.struct("first", "mask", "rest")).alias("flags"))
    return classes, flags


def with_flags(docs: DataFrame, found: tuple[DataFrame, DataFrame], id_col: str, text_col: str) -> DataFrame:
    """``docs`` with _flags, and _stands: the row stands for its class (or is the only one)."""
    classes, flags = found
    names = docs.columns
    least = classes.select(F.col("sha").alias("_sha"), F.col("lo").alias("_lo"))
    rows = docs.withColumn("_id", F.col(id_col).cast("long")).withColumn("_sha", sha_of(id_col, text_col)).withColumn("_key", F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    rows = rows.join(broadcast_if_small(least, least.count(), 48), "_sha", "left").withColumn("_class", F.coalesce("_lo", "_id"))
    own = flags.select(F.col("doc_id").alias("_class"), F.col("row_key").alias("_key"), F.col("flags").alias("_flags"))
    return rows.join(own, ["_class", "_key"], "left").select(*names, "_flags", F.coalesce(F.col("_id") == F.col("_class"), F.lit(True)).alias("_stands"))


def dedup_substrings(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", **settings: int) -> DataFrame:
    """Per document: doc_id, n_words long, n_removed long, removed array<struct<start, stop>>, kept string.

    removed: spans of word numbers; kept: the words that are left, one space between. Windows are judged on the
    input. A null or empty text has no words, and a text with fewer words than a window loses none; very long texts
    are read whole. Documents of one id, repeated rows among them, do not remove each other's words, nor does a
    document without an id take part (its text is kept whole). Other columns are ignored; an empty table gives an
    empty result.
    """
    found = flagged_windows(docs, window, id_col=id_col, text_col=text_col, **settings)
    rows = with_flags(texts(docs, id_col, text_col), found, "doc_id", "text").select("text", "doc_id", "_flags", "_stands")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, covered, left, kept = apply_flags(batch.column(0), batch.column(2), batch.column(3), window)
        starts, stops, row = spans(covered, words)
        lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(words.rows + 1)).astype(np.int32)), pa.StructArray.from_arrays([pa.array(starts.astype(np.int32)), pa.array(stops.astype(np.int32))], ["start", "stop"]))
        return pa.record_batch([batch.column(1), pa.array(words.count.astype(np.int64)), pa.array((words.count - left).astype(np.int64)), lists, kept], ["doc_id", "n_words", "n_removed", "removed", "kept"])

    return rows.mapInArrow(by_slices(run), "doc_id long, n_words long, n_removed long, removed array<struct<start:int,stop:int>>, kept string")


def cut_documents(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars", **settings: int) -> DataFrame:
    """``docs`` with all their columns and the flagged words taken out of their texts.

    A text that loses words becomes its other words, one space between, and ``length_col``, if there is such a
    column, their length; other rows stay as they are, those without a text, a word or an id among them. A document
    that loses every word is left out. Rows that repeat an id do not remove each other's words; an empty table gives
    an empty result.
    """
    rows = with_flags(docs, flagged_windows(docs, window, id_col=id_col, text_col=text_col, **settings), id_col, text_col)
    names, schema = docs.columns, docs.schema
    place = names.index(text_col)
    size = names.index(length_col) if length_col in names else None

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        text = batch.column(place)
        words, covered, left, kept = apply_flags(text.fill_null(""), batch.column(len(names)), batch.column(len(names) + 1), window)
        changed = pa.array(left < words.count)
        columns = list(batch.columns[: len(names)])
        columns[place] = pc.if_else(changed, kept, text)
        if size is not None:
            columns[size] = pc.if_else(changed, pc.utf8_length(kept).cast(columns[size].type), columns[size])
        return pa.record_batch(columns, names).filter(pa.array((left > 0) | (words.count == 0)))

    return rows.mapInArrow(by_slices(run, column=text_col), schema)


def apply_flags(texts_: pa.Array, flags: pa.Array, stands: pa.Array, window: int) -> tuple[K.Words, np.ndarray, np.ndarray, pa.Array]:
    """The words of each text, which are covered, how many are left, and the kept words with one space between."""
    words = K.Words(texts_)
    covered = covered_words(words, flags, np.asarray(stands).astype(bool), window)
    sizes = words.ends - words.starts
    keep = ~covered
    left = np.bincount(words.row[keep], minlength=words.rows)
    wide = sizes[keep] + 1
    wide[np.cumsum(left)[left > 0] - 1] -= 1  # no space behind the last word of a row
    begin = np.concatenate([[0], np.cumsum(wide)])
    flat = np.full(begin[-1], 32, np.uint8)
    held = sizes[keep]
    flat[np.repeat(begin[:-1], held) + K.spread(held)] = words.data[np.repeat(words.starts[keep], held) + K.spread(held)]
    cuts = begin[np.concatenate([[0], np.cumsum(left)])]
    return words, covered, left, pa.Array.from_buffers(pa.string(), words.rows, [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(flat)])


def covered_words(words: K.Words, flags: pa.Array, stands: np.ndarray, window: int) -> np.ndarray:
    """True at each word that a flagged window covers."""
    n = len(words.starts)
    edge = np.zeros(n + window + SEGMENT_WINDOWS + 1, np.int64)
    counts = np.asarray(pc.fill_null(pc.list_value_length(flags), 0)).astype(np.int64)
    if counts.sum():
        flat = pc.list_flatten(flags)
        first = np.asarray(flat.field("first")).astype(np.int64) + np.repeat(words.first[:-1], counts)
        mask = np.where(np.repeat(stands, counts), np.asarray(flat.field("mask")), np.asarray(flat.field("rest"))).astype(np.int64)
        for j in range(SEGMENT_WINDOWS):
            at = first[(mask >> j & 1).astype(bool)] + j
            np.add.at(edge, at, 1)
            np.add.at(edge, at + window, -1)
    return np.cumsum(edge)[:n] > 0


def spans(covered: np.ndarray, words: K.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of covered words within a row: start and stop as word numbers of the row, and the row."""
    at = np.flatnonzero(covered)
    if not len(at):
        return at, at, at
    fresh = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (words.row[at[1:]] != words.row[at[:-1]])])
    start = at[fresh]
    stop = at[np.append(np.flatnonzero(fresh)[1:] - 1, len(at) - 1)] + 1
    row = words.row[start]
    return start - words.first[row], stop - words.first[row], row
