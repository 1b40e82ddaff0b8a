"""ZIP archives of corpus entries: rolling writers and the record that each archive holds of itself.

An archive has members ``version/path`` (a deletion ends in ``.tombstone``) and a last member RECORD, a JSON object with
the number of entries and their hash as ``corpus.archive_facts`` has it. Tasks write archives of their own, under a
temporary name until they are whole.
"""

from __future__ import annotations

import hashlib
import io
import json
import uuid
import zipfile
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.sources.corpus import checked_path, compacted, scan_archives

RECORD = "RECORD.json"
MOST_BYTES = 100 << 20
FACTS = "archive string, entries long, hash string"


def _entry_hash(path: str, version: int, content: bytes) -> int:
    line = f"{path} {version} {hashlib.sha256(content).hexdigest()}"
    return int(hashlib.sha256(line.encode()).hexdigest()[:15], 16)


class Rolling:
    """An archive in memory, written and begun anew when it has reached the size."""

    def __init__(self, root: str, prefix: str, most: int):
        self.store, self.root = pafs.FileSystem.from_uri(root)
        self.prefix, self.most, self.number = prefix, most, 0
        self.begin()

    def begin(self) -> None:
        self.buffer = io.BytesIO()
        self.zip = zipfile.ZipFile(self.buffer, "w", zipfile.ZIP_DEFLATED)
        self.entries, self.hash = 0, 0

    def add(self, path: str, version: int, content: bytes | None, tombstone: bool) -> None:
        name = f"{version}/{path}" + ".tombstone" * tombstone
        body = b"" if tombstone or content is None else bytes(content)
        self.zip.writestr(zipfile.ZipInfo(name, (2000, 1, 1, 0, 0, 0)), body, zipfile.ZIP_DEFLATED)
        self.entries += 1
        self.hash += _entry_hash(path, version, body)

    def full(self) -> bool:
        return self.buffer.tell() >= self.most

    def close(self) -> pd.DataFrame:
        name = f"{self.prefix}-{self.number:04d}.zip"
        self.zip.writestr(zipfile.ZipInfo(RECORD, (2000, 1, 1, 0, 0, 0)), json.dumps({"entries": self.entries, "hash": str(self.hash)}))
        self.zip.close()
        temporary = f"{self.root}/.{uuid.uuid4().hex}"
        with self.store.open_output_stream(temporary) as out:
            out.write(self.buffer.getvalue())
        self.store.move(temporary, f"{self.root}/{name}")
        facts = pd.DataFrame({"archive": [name], "entries": [self.entries], "hash": [str(self.hash)]})
        self.number += 1
        self.begin()
        return facts


def write_archives(rows: DataFrame, root: str, prefix: str = "corpus", most: int = MOST_BYTES) -> DataFrame:
    """Write corpus entries (path, version, content, tombstone) into archives of about ``most`` bytes, and return
    (archive, entries, hash) of each: the chain's manifest follows from these by ``corpus.recovered_manifest``."""
    store, folder = pafs.FileSystem.from_uri(root)
    store.create_dir(folder, recursive=True)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rolling = None
        for frame in frames:
            for part, path, version, content, dead in frame.itertuples(index=False):
                if rolling is None:
                    rolling = Rolling(root, f"{prefix}-{part:05d}", most)
                rolling.add(path, int(version), content, bool(dead))
                if rolling.full():
                    yield rolling.close()
        if rolling is not None and rolling.entries:
            yield rolling.close()

    ordered = rows.select(F.spark_partition_id().alias("part"), "path", "version", "content", "tombstone")
    found = ordered.mapInPandas(run, FACTS).collect()  # a row for each archive; the writing happens here, once
    return rows.sparkSession.createDataFrame([tuple(r) for r in found], FACTS)


def write_files(rows: DataFrame, root: str) -> int:
    """Write the contents of (path, content, tombstone) rows below a root, each under a temporary name until it is whole,
    and delete the files of tombstones; returns how many rows there were. A path that leaves the root fails."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, folder = pafs.FileSystem.from_uri(root)
        for frame in frames:
            for path, content, dead in frame.itertuples(index=False):
                target = f"{folder}/{checked_path(path)}"
                if dead:
                    if store.get_file_info(target).type != pafs.FileType.NotFound:
                        store.delete_file(target)
                    continue
                parent, _, name = target.rpartition("/")
                store.create_dir(parent, recursive=True)
                temporary = f"{parent}/.{name}.{uuid.uuid4().hex}"
                with store.open_output_stream(temporary) as out:
                    out.write(b"" if content is None else bytes(content))
                store.move(temporary, target)
            yield pd.DataFrame({"n": [len(frame)]})

    return rows.select("path", "content", "tombstone").mapInPandas(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def records(spark: SparkSession, root: str, pattern: str = "*.zip") -> DataFrame:
    """(archive, readable, entries, hash): what each archive's record says; nulls without one."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(root)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, data in zip(frame["path"], frame["content"], strict=True):
                readable, entries, digest = True, None, None
                try:
                    with zipfile.ZipFile(io.BytesIO(data)) as archive:
                        if RECORD in archive.namelist():
                            record = json.loads(archive.read(RECORD))
                            entries, digest = record.get("entries"), record.get("hash")
                except (zipfile.BadZipFile, ValueError):
                    readable = False
                yield pd.DataFrame({"archive": [path.rsplit("/", 1)[-1]], "readable": [readable], "entries": pd.array([entries], "Int64"), "hash": [digest]})

    return files.select("path", "content").mapInPandas(run, "archive string, readable boolean, entries long, hash string")


def compact(spark: SparkSession, root: str, target: str, mode: str = "FULL", closed: Sequence[str] | None = None, prefix: str = "compact", most: int = MOST_BYTES) -> DataFrame:
    """Rewrite the archives below a root (those named in ``closed``, if given) without what ``corpus.compacted`` leaves
    out, into new archives at ``target``, and return their facts. The old ones stay until a chain has ``retire``d them."""
    rows = scan_archives(spark, root)
    if closed is not None:
        rows = rows.where(F.col("archive").isin(*closed))
    return write_archives(compacted(rows, mode), target, prefix, most)
