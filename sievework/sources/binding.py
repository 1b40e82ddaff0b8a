"""A corpus bound to a target: where its documents come from, and when they are ingested."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from sievework.sources import archives, corpus


class Storage(Enum):
    FLAT = "flat"
    ZIP = "zip"
    COMPOSITE = "composite"


class Ingestion(Enum):
    AUTO = "auto"
    MANUAL = "manual"
    NONE = "none"


@dataclass(frozen=True)
class Binding:
    tenant_id: str
    name: str
    root: str
    storage: Storage = Storage.FLAT
    mode: Ingestion = Ingestion.AUTO
    chunk_size: int = 1000
    overlap: int = 200
    archives: str = ""  # of a composite corpus, whose reads come from the archives

    def documents(self, spark: SparkSession) -> DataFrame:
        """path and content of the live documents."""
        if self.storage is Storage.FLAT:
            return corpus.scan_directory(spark, self.root).select("path", "content")
        archives = self.root if self.storage is Storage.ZIP else self.archives
        return corpus.current(corpus.scan_archives(spark, archives)).select("path", "content")

    def append(self, rows: DataFrame, prefix: str = "corpus") -> DataFrame | None:
        """Write entries (path, version, content, tombstone): files of a flat corpus, archives of a ZIP corpus (their
        facts are returned), and both of a composite one."""
        facts = None
        if self.storage is not Storage.FLAT:
            facts = archives.write_archives(rows, self.root if self.storage is Storage.ZIP else self.archives, prefix)
        if self.storage is not Storage.ZIP:
            archives.write_files(rows, self.root)
        return facts

    def chunks(self, spark: SparkSession, manual: bool = False) -> DataFrame | None:
        """The chunks to ingest, or None if the mode does not ask for them now."""
        if self.mode is Ingestion.NONE or self.mode is Ingestion.MANUAL and not manual:
            return None
        texts: Any = self.documents(spark).selectExpr(f"'{self.tenant_id}' tenant_id", f"'{self.name}' corpus", "path source_document_id", "cast(content as string) text")
        return corpus.chunks(texts, "text", self.chunk_size, self.overlap).drop("text")
