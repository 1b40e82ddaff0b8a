"""Retrieval-log and trace tables: rows to append, windows, retention."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.operators.analytics import in_window


def log_rows(retrievals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, retrieved) of retrievals with documents array<struct<doc, score>>; of one document the best score."""
    records = retrievals.select("retrieval_id", "query_text", "corpus", "max_results", "ts")
    flat = retrievals.select("retrieval_id", F.explode("documents").alias("d")).groupBy("retrieval_id", F.col("d.doc").alias("doc")).agg(F.max("d.score").alias("score"))
    return records, flat


def tracked(found: DataFrame, track: Callable[[DataFrame], None], failed: Callable[[Exception], None] = lambda _: None) -> DataFrame:
    """The retrieval's rows, after a tracker has seen them; a tracker that fails never fails the retrieval."""
    try:
        track(found)
    except Exception as e:  # whatever a tracker does wrong stays its own
        failed(e)
    return found


def feedback_in(feedback: DataFrame, records: DataFrame, since: Any, until: Any) -> DataFrame:
    """Feedback on known retrievals in the window."""
    return in_window(feedback, since, until).join(records.select("retrieval_id", "query_text"), "retrieval_id")


def retrieved_documents(retrieved: DataFrame, records: DataFrame, since: Any, until: Any) -> DataFrame:
    return retrieved.join(in_window(records, since, until), "retrieval_id", "left_semi").select("doc").distinct()


def traces(df: DataFrame) -> DataFrame:
    """Trace rows: query and results as JSON."""
    return df.select("trace_id", "case_type", "tenant_id", "domain", F.to_json("query").alias("query"), F.to_json("results").alias("results"), "ts")


def find_traces(df: DataFrame, case_type: str, tenant: str, since: Any, until: Any) -> DataFrame:
    return in_window(df.where((F.col("case_type") == case_type) & (F.col("tenant_id") == tenant)), since, until).orderBy("ts", "trace_id")


def older_removed(records: DataFrame, retrieved: DataFrame, feedback: DataFrame, cutoff: Any) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What is left of the three tables when retrievals before the cutoff go, with all that hangs on them."""
    kept = in_window(records, since=cutoff)
    ids = kept.select("retrieval_id")
    return kept, retrieved.join(ids, "retrieval_id", "left_semi"), feedback.join(ids, "retrieval_id", "left_semi")
