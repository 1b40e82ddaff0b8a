"""Exact dedup through an extendible-hash index on shared files, in DataFrame operations only.

Every text gets a 64-bit key. The leading bits of the key address a directory that doubles until no bucket holds
more than ``bucket_entries`` entries; an entry is one distinct (key, digest, length) with its row count and largest
id, so that any number of equal rows weighs as one entry. Entries go into their buckets, and owner tasks, each with a
range of buckets and so of keys, write them to the shared folder in key order.

Every row then finds its bucket through the directory and its entry in the bucket. An entry of one row answers at
once. Under an entry of several rows there is a chain: the texts themselves meet in the bucket and are compared byte
by byte (grouping by bucket, key and text); where the bytes of an entry differ, its rows are answered by their text.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import broadcast_if_small, partitions, texts
from sievework.session import materialise

#: The directory is counted, and held on the driver, with at most 2 ** MAX_DEPTH slots. A bucket that is overfull there
#: is split by as many further bits of the key as its load asks for, which needs no more slots.
MAX_DEPTH = 20


def grow_directory(counts: dict[int, int], bits: int, bucket_entries: int) -> tuple[int, list[int], dict[int, int]]:
    """Double the directory until no bucket is overfull or ``bits`` are used.

    counts: entries by the leading ``bits`` bits of the key. Returns the global depth, the bucket of every slot of
    the directory, and the local depth of every bucket. Buckets are numbered in key order.
    """
    prefix = [0]
    for slot in range(1 << bits):
        prefix.append(prefix[-1] + counts.get(slot, 0))

    def load(depth: int, head: int) -> int:
        width = bits - depth
        return prefix[(head + 1) << width] - prefix[head << width]

    done: list[tuple[int, int]] = []
    open_ = [(0, 0)]
    while open_:
        depth, head = open_.pop()
        if depth < bits and load(depth, head) > bucket_entries:
            open_ += [(depth + 1, 2 * head), (depth + 1, 2 * head + 1)]
        else:
            done.append((depth, head))
    depth = max(d for d, _ in done)
    done.sort(key=lambda x: x[1] << (bits - x[0]))
    slots = [b for b, (d, _) in enumerate(done) for _ in range(1 << (depth - d))]
    return depth, slots, {b: d for b, (d, _) in enumerate(done)}


def directory_of(entries: DataFrame, rows: int, bucket_entries: int) -> tuple[int, DataFrame]:
    """The global depth, and the directory: slot, bucket, bits (further bits of the key that split the bucket)."""
    bits = min(MAX_DEPTH, max(1, math.ceil(math.log2(max(1, rows) / bucket_entries + 1)) + 3))
    head = F.shiftrightunsigned("key", 64 - bits).alias("head")
    counts = {r["head"]: r["n"] for r in entries.groupBy(head).agg(F.count(F.lit(1)).alias("n")).collect()}  # at most 2 ** bits rows
    depth, slots, _ = grow_directory(counts, bits, bucket_entries)
    load: dict[int, int] = {}
    for slot, n in counts.items():
        bucket = slots[slot >> (bits - depth)]
        load[bucket] = load.get(bucket, 0) + n
    further = {b: min(44, math.ceil(math.log2(n / bucket_entries))) for b, n in load.items() if n > bucket_entries}
    rows_ = [(slot, bucket, further.get(bucket, 0)) for slot, bucket in enumerate(slots)]  # overfull buckets are one slot each
    return depth, entries.sparkSession.createDataFrame(rows_, "slot long, bucket int, bits int")


def place(rows: DataFrame, directory: tuple[int, DataFrame]) -> DataFrame:
    """``rows`` with bucket and part (of a bucket that further bits split), by their key."""
    depth, slots = directory
    slot = F.shiftrightunsigned("key", 64 - depth) if depth else F.lit(0).cast("long")
    found = rows.withColumn("slot", slot).join(F.broadcast(slots), "slot")  # at most 2 ** MAX_DEPTH slots of 16 bytes
    part = F.expr(f"if(bits = 0, 0L, shiftrightunsigned(shiftleft(key, {depth}), 64 - bits))")
    return found.withColumn("part", part).drop("slot", "bits")


def build_index(rows: DataFrame, bucket_entries: int) -> tuple[tuple[int, DataFrame], DataFrame]:
    """The directory and the index: one entry per (key, digest, n_bytes), written by the owners of ranges of buckets."""
    entries = rows.groupBy("key", "digest", "n_bytes").agg(F.count(F.lit(1)).alias("n_rows"), F.max("doc_id").alias("keep_id"))
    entries = materialise(entries, "dedup-entries")
    directory = directory_of(entries, rows.count(), bucket_entries)
    owned = place(entries, directory).repartitionByRange(partitions(rows.sparkSession), "bucket", "part", "key")
    return directory, materialise(owned.sortWithinPartitions("bucket", "part", "key"), "dedup-index")


PLACE = ["bucket", "part", "key"]
ENTRY = [*PLACE, "digest", "n_bytes"]


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    bucket_entries: int = 2048,
    key_of: Callable[[Column], Column] = F.xxhash64,
    digest_of: Callable[[Column], Column] = lambda text: F.unhex(F.sha2(text, 256)),
) -> DataFrame:
    """Of rows with equal text, the one with the largest id stays.

    Returns one row per input row: doc_id, keep_id, group_size long, kept boolean, text_sha256. A null text equals
    an empty one; very long texts are compared whole. Rows that repeat both id and text are one document: they count
    in group_size and are flagged alike. A null id never wins against another id. An empty input gives an empty
    result; other columns are ignored.
    """
    source = texts(docs, id_col, text_col).withColumn("key", key_of(F.col("text")))
    keyed = source.select("doc_id", "key", digest_of(F.col("text")).alias("digest"), F.octet_length("text").alias("n_bytes"), F.unhex(F.sha2("text", 256)).alias("sha"))
    rows = materialise(keyed, "dedup-rows")
    directory, index = build_index(rows, bucket_entries)

    # Chains: texts whose entry has several rows meet in their bucket, each distinct text once per task.
    shared = index.where("n_rows > 1").select(*PLACE).distinct()
    candidates = place(source, directory).join(broadcast_if_small(shared, shared.count(), 24), PLACE, "left_semi")
    chain = candidates.groupBy(*PLACE, "text").agg(F.count(F.lit(1)).alias("group_size"), F.max("doc_id").alias("top_id"))
    chain = materialise(chain.withColumn("digest", digest_of(F.col("text"))).withColumn("n_bytes", F.octet_length("text")), "dedup-chains")
    compared = chain.groupBy(*ENTRY).agg(F.count(F.lit(1)).alias("n_texts"), F.max("group_size").alias("group_size"), F.max("top_id").alias("top_id"))
    answers = index.join(compared, ENTRY, "left")
    # An entry whose rows do not all carry the same bytes cannot be answered by key and digest.
    same = (F.col("n_rows") == 1) | ((F.col("n_texts") == 1) & (F.col("group_size") == F.col("n_rows")))
    answers = materialise(answers.select(*ENTRY, F.coalesce(same, F.lit(False)).alias("same"), F.when(F.col("n_rows") == 1, 1).otherwise(F.col("group_size")).cast("long").alias("group_size"), F.when(F.col("n_rows") == 1, F.col("keep_id")).otherwise(F.col("top_id")).alias("keep_id")), "dedup-answers")
    placed = place(rows, directory)
    found = placed.join(answers.where("same").drop("same"), ENTRY).select("doc_id", "sha", "group_size", "keep_id")
    mixed = answers.where("not same").select(*ENTRY)
    if not mixed.isEmpty():
        told = source.withColumns({"digest": digest_of(F.col("text")), "n_bytes": F.octet_length("text"), "sha": F.unhex(F.sha2("text", 256))})
        told = place(told, directory).join(mixed, ENTRY, "left_semi")
        own = chain.select(*PLACE, "text", "group_size", F.col("top_id").alias("keep_id"))
        found = found.unionByName(told.join(own, [*PLACE, "text"]).select("doc_id", "sha", "group_size", "keep_id"))
    return found.select(
        "doc_id",
        F.coalesce("keep_id", "doc_id").alias("keep_id"),
        "group_size",
        (F.col("doc_id").eqNullSafe(F.coalesce("keep_id", "doc_id"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text no row with a larger id has.

    Null and empty texts are equal, and one row of them stays; a row without an id stays only where no row with the
    text has one. Of rows that repeat both id and text one stays. Very long texts are compared whole; other columns,
    whatever their names, come through; an empty table gives an empty result.
    """
    decided = materialise(exact_dedup(docs, id_col, text_col), "dedup-decisions")
    dropped = decided.where(~F.col("kept")).select(F.col("doc_id").alias("_dropped_id"), F.col("text_sha256").alias("_dropped_sha")).distinct()
    dropped = materialise(dropped, "dedup-dropped")
    gone = broadcast_if_small(dropped, dropped.count(), 96)
    same = F.col(id_col).cast("long").eqNullSafe(F.col("_dropped_id")) & (F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256) == F.col("_dropped_sha"))
    left = docs.join(gone, same, "left_anti")
    repeated = decided.where("kept").groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return left if repeated.isEmpty() else left.withColumn("_text", F.coalesce(F.col(text_col), F.lit(""))).dropDuplicates([id_col, "_text"]).drop("_text")
