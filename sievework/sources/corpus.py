"""Versioned corpora: directory and archive scans, versions, change sets, chunks, compaction and integrity.

A corpus table has path, version (from 1), ts, content binary, tombstone, archive. It is append-only: a deletion is a
row of its own, and every view is a query.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ENTRY = "path string, version int, ts timestamp, content binary, tombstone boolean, archive string"


def checked_path(path: str) -> str:
    """A relative path inside the corpus; raises for anything else."""
    parts = path.split("/")
    if not path or path.startswith("/") or "\\" in path or ".." in parts or "" in parts:
        raise ValueError(f"not a corpus path: {path!r}")
    return path


def scan_directory(spark: SparkSession, root: str, prefix: str = "") -> DataFrame:
    """path (relative), ts, size, content of the files below a root, without hidden files or folders and paths that
    begin with '_'; the reader lists and reads in parallel."""
    base = "/" + re.sub(r"^[a-zA-Z][a-zA-Z0-9+.-]*:/*", "", root).strip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    relative = F.regexp_replace(F.regexp_replace("path", r"^[a-zA-Z][a-zA-Z0-9+.-]*:/*", "/"), "^" + re.escape(base), "")
    out = files.select(relative.alias("path"), F.col("modificationTime").alias("ts"), F.col("length").alias("size"), "content")
    return out.where(~F.col("path").startswith("_") & ~F.regexp_like("path", F.lit(r"(^|/)\."))).where(F.col("path").startswith(prefix))


def read_file(spark: SparkSession, root: str, path: str) -> DataFrame:
    """path, ts, size, content of one file below a root; only this file is listed and read."""
    files = spark.read.format("binaryFile").load(f"{root.rstrip('/')}/{checked_path(path)}")
    return files.select(F.lit(path).alias("path"), F.col("modificationTime").alias("ts"), F.col("length").alias("size"), "content")


def scan_archives(spark: SparkSession, root: str, pattern: str = "*.zip") -> DataFrame:
    """Corpus entries of ZIP archives: members 'N/path' are versions; one archive a task, members one by one."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(root)

    def members(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, data in zip(frame["path"], frame["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(data)) as archive:
                    for info in archive.infolist():
                        version, _, name = info.filename.partition("/")
                        if version.isdigit() and name and not info.is_dir():
                            body = archive.read(info)
                            dead = name.endswith(".tombstone")
                            yield pd.DataFrame({"path": [name.removesuffix(".tombstone")], "version": [int(version)], "ts": [pd.Timestamp(*info.date_time)], "content": [None if dead else body], "tombstone": [dead], "archive": [path.rsplit("/", 1)[-1]]})

    return files.select("path", "content").mapInPandas(members, ENTRY)


def appended(corpus: DataFrame, new: DataFrame) -> DataFrame:
    """Rows to append for new contents (path, ts, content): the next version of each path."""
    have = corpus.groupBy("path").agg(F.max("version").alias("_v"))
    rank = F.row_number().over(Window.partitionBy("path").orderBy("ts"))
    rows = new.join(have, "path", "left").withColumn("version", (F.coalesce("_v", F.lit(0)) + rank).cast("int"))
    return rows.select("path", "version", "ts", "content", F.lit(False).alias("tombstone"), F.lit(None).cast("string").alias("archive"))


def deleted(corpus: DataFrame, paths: Sequence[str], ts: Any) -> DataFrame:
    """Tombstone rows to append for live paths."""
    live = current(corpus).where(F.col("path").isin(*paths))
    return live.select("path", (F.col("version") + 1).alias("version"), F.lit(str(ts)).cast("timestamp").alias("ts"), F.lit(None).cast("binary").alias("content"), F.lit(True).alias("tombstone"), F.lit(None).cast("string").alias("archive"))


def latest(corpus: DataFrame) -> DataFrame:
    """The last version of every path, tombstones included: one aggregation, combined before the shuffle."""
    rest = [c for c in corpus.columns if c != "path"]
    last = corpus.groupBy("path").agg(F.max_by(F.struct(*rest), "version").alias("_r"))
    return last.select("path", *[F.col("_r")[c].alias(c) for c in rest])


def current(corpus: DataFrame, prefix: str = "") -> DataFrame:
    """Live paths with their last version."""
    return latest(corpus).where(~F.col("tombstone")).where(F.col("path").startswith(prefix))


def version_of(corpus: DataFrame, path: str, version: int) -> DataFrame:
    return corpus.where((F.col("path") == path) & (F.col("version") == version) & ~F.col("tombstone"))


def history(corpus: DataFrame, path: str) -> DataFrame:
    return corpus.where(F.col("path") == path).select("version", "ts", "tombstone").orderBy("version")


def exists(corpus: DataFrame, path: str) -> bool:
    return not current(corpus.where(F.col("path") == path)).isEmpty()


def migrate(spark: SparkSession, root: str, target: str) -> int:
    """Copy a directory tree into a corpus table; returns the number of files."""
    from pyspark.sql import Observation

    seen = Observation()
    rows = appended(spark.createDataFrame([], ENTRY), scan_directory(spark, root).select("path", "ts", "content"))
    rows.observe(seen, F.count(F.lit(1)).alias("files")).write.mode("append").parquet(target)  # counted as they are written
    return seen.get["files"]


def changes(before: DataFrame, after: DataFrame, state: str = "version", key: str = "path") -> DataFrame:
    """(key, change): ADDED, MODIFIED or DELETED between two snapshots, by their state (version, time or hash)."""
    both = before.select(key, F.col(state).alias("_a"), F.lit(1).alias("_x")).join(after.select(key, F.col(state).alias("_b"), F.lit(1).alias("_y")), key, "full_outer")
    kind = F.when(F.col("_x").isNull(), "ADDED").when(F.col("_y").isNull(), "DELETED").when(~F.col("_a").eqNullSafe(F.col("_b")), "MODIFIED")
    return both.select(key, kind.alias("change")).where("change is not null")


def reconcile(stored: DataFrame, corpus: DataFrame, key: str = "path") -> tuple[DataFrame, DataFrame]:
    """(missing in the store, orphans of the store)."""
    a, b = stored.select(key).distinct(), corpus.select(key).distinct()
    return b.join(a, key, "left_anti"), a.join(b, key, "left_anti")


def compacted(corpus: DataFrame, mode: str = "FULL", closed: Column | None = None) -> DataFrame:
    """FULL: the last version of each path and no tombstones. TOMBSTONES_ONLY: all versions of paths that are not
    deleted. closed: which rows lie in closed archives; others stay as they are."""
    old = corpus if closed is None else corpus.where(closed)
    if mode == "FULL":
        kept = current(old)
    elif mode == "TOMBSTONES_ONLY":
        dead = latest(old).where("tombstone").select("path")
        kept = old.join(dead, "path", "left_anti").where(~F.col("tombstone"))
    else:
        raise ValueError(mode)
    return kept.select(*corpus.columns) if closed is None else kept.select(*corpus.columns).unionByName(corpus.where(~closed))


# Archives and their chain: a small table (archive, sequence, status, predecessor, entries, hash, replaced_by)


def entry_hash(path: Column | str = "path", version: Column | str = "version", content: Column | str = "content") -> Column:
    """60 bits of the SHA-256 of an entry's path, version and content hash, as a number."""
    c = [F.col(x) if isinstance(x, str) else x for x in (path, version, content)]
    line = F.concat_ws(" ", c[0], c[1].cast("string"), F.sha2(F.coalesce(c[2], F.lit(b"")), 256))
    return F.conv(F.substring(F.sha2(line, 256), 1, 15), 16, 10).cast("decimal(38,0)")


def archive_facts(corpus: DataFrame) -> DataFrame:
    """Per archive: entries and the sum of their hashes, which no order changes and equal entries do not cancel."""
    return corpus.groupBy("archive").agg(F.count(F.lit(1)).alias("entries"), F.sum(entry_hash()).cast("string").alias("hash"))


def integrity(manifest: DataFrame | None, facts: DataFrame, full: bool = False, meta: DataFrame | None = None) -> DataFrame:
    """(archive, problem, severity): no manifest; archives missing or orphaned, counts that differ; in full mode hashes;
    and with ``meta`` (archive, readable, entries, hash of each archive's inner record) archives that cannot be read
    and records that are missing or differ."""
    if manifest is None:
        return facts.sparkSession.createDataFrame([(None, "MANIFEST_MISSING", "ERROR")], "archive string, problem string, severity string")
    m = manifest.select("archive", F.col("entries").alias("_e"), F.col("hash").alias("_h"), F.lit(True).alias("_m"))
    both = m.join(facts.withColumn("_f", F.lit(True)), "archive", "full_outer")
    unreadable, record = F.lit(False), F.lit(None).cast("string")
    if meta is not None:
        inner = meta.select("archive", "readable", F.col("entries").alias("_ie"), F.col("hash").alias("_ih"), F.lit(True).alias("_i"))
        both = both.join(inner, "archive", "full_outer")
        unreadable = F.col("_i") & ~F.col("readable")
        record = F.when(F.col("_ie").isNull(), "RECORD_MISSING").when((F.col("_ie") != F.col("entries")) | ~F.col("_ih").eqNullSafe(F.col("hash")), "RECORD_DIFFERS")
    problem = F.when(unreadable, "ARCHIVE_UNREADABLE").when(F.col("_f").isNull(), "ARCHIVE_MISSING").when(F.col("_m").isNull(), "ARCHIVE_ORPHANED").when(F.col("_e") != F.col("entries"), "ENTRY_COUNT_MISMATCH")
    if full:
        problem = problem.when(~F.col("_h").eqNullSafe(F.col("hash")), "HASH_MISMATCH")
    severity = F.when(F.col("problem").isin("ARCHIVE_ORPHANED", "RECORD_MISSING"), "WARNING").otherwise("ERROR")
    return both.select("archive", F.coalesce(problem, record).alias("problem")).where("problem is not null").withColumn("severity", severity)


def status(problems: DataFrame) -> DataFrame:
    """One row: HEALTHY, DEGRADED or CORRUPT by the worst severity."""
    worst = F.max(F.when(F.col("severity") == "ERROR", 2).otherwise(1))
    return problems.agg(F.when(worst == 2, "CORRUPT").when(worst == 1, "DEGRADED").otherwise("HEALTHY").alias("status"))


def recovered_manifest(facts: DataFrame) -> DataFrame:
    """A manifest anew from the archives, in order of name, each after the one before."""
    w = Window.orderBy("archive")  # a row per archive
    return facts.select("archive", (F.row_number().over(w) - 1).cast("int").alias("sequence"), F.lit("CLOSED").alias("status"), F.lag("archive").over(w).alias("predecessor"), "entries", "hash", F.lit(None).cast("string").alias("replaced_by"))


def opened(manifest: DataFrame, archive: str) -> DataFrame:
    """The chain with a new active archive after its last one; raises (when read) if one is active already."""
    last = manifest.agg(F.max_by("archive", "sequence").alias("p"), F.max("sequence").alias("s"), F.count_if(F.col("status") == "ACTIVE").alias("n"))  # one row
    none = F.assert_true(F.col("n") == 0, F.lit("an archive is active"))
    row = last.where(none.isNull()).select(F.lit(archive).alias("archive"), (F.coalesce("s", F.lit(-1)) + 1).cast("int").alias("sequence"), F.lit("ACTIVE").alias("status"), F.col("p").alias("predecessor"), F.lit(0).cast("long").alias("entries"), F.lit(None).cast("string").alias("hash"), F.lit(None).cast("string").alias("replaced_by"))
    return manifest.select(*row.columns).unionByName(row)


def closed(manifest: DataFrame, facts: DataFrame) -> DataFrame:
    """The chain with its active archive closed over what the archive holds."""
    have = facts.select("archive", F.col("entries").alias("_e"), F.col("hash").alias("_h"))
    active = F.col("status") == "ACTIVE"
    out = manifest.join(have, "archive", "left")
    return out.withColumns({"entries": F.when(active, F.coalesce("_e", F.lit(0))).otherwise(F.col("entries")), "hash": F.when(active, F.col("_h")).otherwise(F.col("hash")), "status": F.when(active, "CLOSED").otherwise(F.col("status"))}).select(*manifest.columns)


def retire(manifest: DataFrame, archive: str, replaced_by: str) -> DataFrame:
    """The chain after an archive has been replaced: its successor follows the replacement."""
    hit = F.col("archive") == archive
    return manifest.withColumns({"status": F.when(hit, "RETIRED").otherwise(F.col("status")), "replaced_by": F.when(hit, replaced_by).otherwise(F.col("replaced_by")), "predecessor": F.when(F.col("predecessor") == archive, replaced_by).otherwise(F.col("predecessor"))})


# Text


def plain_text(content: Column | str, kind: str = "html") -> Column:
    """Text of a page: scripts, styles, comments and tags out, entities of the five basic kinds back, space squeezed."""
    c = F.col(content) if isinstance(content, str) else content
    c = F.coalesce(c.cast("string"), F.lit(""))
    if kind != "html":
        return c
    c = F.regexp_replace(c, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    c = F.regexp_replace(c, r"(?s)<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(c, r"\s+", " "))


SEPARATORS = ("\n\n", "\n", ". ", " ", "")


def split_text(text: str, size: int = 1000, overlap: int = 200, separators: Sequence[str] = SEPARATORS) -> list[str]:
    """Chunks of at most ``size`` characters: paragraphs, else lines, sentences, words, characters; neighbours joined
    while they fit, each chunk after the first led by up to ``overlap`` characters of whole parts of the one before."""
    if len(text) <= size:
        return [text] if text.strip() else []
    parts: list[str] = []

    def cut(t: str, level: int) -> None:
        if len(t) <= size:
            parts.append(t)
            return
        separator = separators[level]
        if separator == "":
            parts.extend(t[i : i + size] for i in range(0, len(t), size))
            return
        pieces = t.split(separator)
        for i, piece in enumerate(pieces):
            whole = piece + (separator if i < len(pieces) - 1 else "")
            if whole:
                cut(whole, level + 1) if len(whole) > size else parts.append(whole)

    cut(text, 0)
    chunks, held = [], []
    for part in parts:
        if held and sum(map(len, held)) + len(part) > size:
            chunks.append("".join(held))
            tail: list[str] = []
            for p in reversed(held):
                if sum(map(len, tail)) + len(p) > min(overlap, size - len(part)):
                    break
                tail.insert(0, p)
            held = tail
        held.append(part)
    chunks.append("".join(held))
    return [c for c in chunks if c.strip()]


def chunks(df: DataFrame, text_col: str = "text", size: int = 1000, overlap: int = 200) -> DataFrame:
    """A row per chunk, with all columns of the document, ``chunk_index`` from 0 and ``content``."""

    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_text(t or "", size, overlap))

    return df.select("*", F.posexplode(split(text_col)).alias("chunk_index", "content"))


def fixed_chunks(df: DataFrame, text_col: str = "text", size: int = 1000, overlap: int = 200) -> DataFrame:
    """Chunks of a fixed width, in expressions only."""
    step = size - overlap
    n = F.greatest(F.ceil((F.char_length(text_col) - overlap) / step), F.lit(1)).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.col(text_col), i * step + 1, F.lit(size)))
    return df.select("*", F.posexplode(F.filter(pieces, lambda p: F.trim(p) != "")).alias("chunk_index", "content"))


def point_id(document: Column | str, index: Column | str) -> Column:
    """A deterministic id of a chunk: 32 hex digits of document#index."""
    col = lambda x: F.col(x) if isinstance(x, str) else x
    return F.md5(F.concat(col(document).cast("string"), F.lit("#"), col(index).cast("string")))


def upserted(stored: DataFrame, new: DataFrame, key: str = "source_document_id") -> DataFrame:
    """The store after all chunks of the new documents replace those of before."""
    return stored.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def without_documents(stored: DataFrame, documents: Sequence[str], key: str = "source_document_id") -> DataFrame:
    return stored.where(~F.col(key).isin(*documents))


def documents_of(stored: DataFrame, key: str = "source_document_id") -> DataFrame:
    """The distinct documents that a collection holds chunks of."""
    return stored.select(key).distinct()


def parsed(df: DataFrame, content: str = "content", kind: str = "html", metadata: str | None = None) -> DataFrame:
    """With ``text`` and ``metadata``: what the content's front matter says, under what the caller says."""
    from sievework.functions.text import front_matter

    f = front_matter(F.col(content).cast("string") if kind != "html" else plain_text(content))
    own = f["metadata"]
    if metadata is not None:
        given = F.coalesce(F.col(metadata), F.create_map().cast("map<string,string>"))
        own = F.map_concat(F.map_filter(own, lambda k, _: ~F.array_contains(F.map_keys(given), k)), given)
    return df.withColumns({"text": f["body"], "metadata": own})


def check_collection(df: DataFrame, vector_col: str, dimensions: int) -> DataFrame:
    """Rows of which every vector has the collection's dimensions; a scan fails at the first that has not."""
    ok = F.assert_true(F.size(vector_col) == dimensions, F.lit(f"{vector_col} must have {dimensions} dimensions"))
    return df.withColumn("_ok", ok).where("_ok is null").drop("_ok")
