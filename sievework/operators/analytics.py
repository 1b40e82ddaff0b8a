"""Retrieval-log analytics: document and query statistics, quality signals, correlation graph, query clusters.

Tables: records (retrieval_id, query_text, ts), retrieved (retrieval_id, doc, score), feedback (retrieval_id, doc,
outcome, ts). Windows are [since, until).
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.plans.components import connected_components

OUTCOMES = ("HIGHLY_RELEVANT", "RELEVANT", "PARTIALLY_RELEVANT", "NOT_RELEVANT")


def _t(at: Any) -> Column:
    return F.lit(str(at)).cast("timestamp")


def in_window(df: DataFrame, since: Any = None, until: Any = None, column: str = "ts") -> DataFrame:
    if since is not None:
        df = df.where(F.col(column) >= _t(since))
    if until is not None:
        df = df.where(F.col(column) < _t(until))
    return df


def last_feedback(feedback: DataFrame) -> DataFrame:
    """One outcome for each (retrieval, doc): the latest."""
    return feedback.groupBy("retrieval_id", "doc").agg(F.max_by("outcome", "ts").alias("outcome"), F.max("ts").alias("ts"))


def outcome_counts(column: str = "outcome") -> list[Column]:
    """A count of each outcome, columns in lower case."""
    return [F.count_if(F.col(column) == o).alias(o.lower()) for o in OUTCOMES]


def document_stats(records: DataFrame, retrieved: DataFrame, feedback: DataFrame, since: Any = None, until: Any = None) -> DataFrame:
    """Per document: retrievals, first and last time, mean score, and how many of each outcome its feedback from
    ``since`` on has on retrievals in the window."""
    r = in_window(records, since, until)
    seen = retrieved.join(r.select("retrieval_id", "ts"), "retrieval_id")
    base = seen.groupBy("doc").agg(F.count(F.lit(1)).alias("retrievals"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.avg("score").alias("avg_score"))
    judged = in_window(last_feedback(feedback), since).join(r, "retrieval_id", "left_semi").groupBy("doc").agg(*outcome_counts())
    names = [o.lower() for o in OUTCOMES]
    return base.join(judged, "doc", "left").fillna(0, names)


def unretrieved(corpus: DataFrame, records: DataFrame, retrieved: DataFrame, since: Any = None, until: Any = None) -> DataFrame:
    """Documents of the corpus that no retrieval in the window returned."""
    seen = retrieved.join(in_window(records, since, until), "retrieval_id", "left_semi").select("doc")
    return corpus.select("doc").distinct().join(seen, "doc", "left_anti")


def quality_signals(stats: DataFrame, never: DataFrame, until: Any, min_retrievals: int = 3, min_feedback: int = 3, low_ratio: float = 0.7, stale_seconds: int = 90 * 86400) -> DataFrame:
    """(doc, signal): NEVER_RETRIEVED, HIGH_RETRIEVAL_LOW_QUALITY, else STALE."""
    judged = F.col("highly_relevant") + F.col("relevant") + F.col("partially_relevant") + F.col("not_relevant")
    poor = (F.col("retrievals") >= min_retrievals) & (judged >= min_feedback) & ((F.col("not_relevant") + F.col("partially_relevant")) / judged >= low_ratio)
    stale = F.unix_micros(F.col("last_ts").cast("timestamp")) < F.unix_micros(_t(until)) - stale_seconds * 1_000_000
    signal = F.when(F.coalesce(poor, F.lit(False)), "HIGH_RETRIEVAL_LOW_QUALITY").when(stale, "STALE")
    found = stats.select("doc", signal.alias("signal")).where("signal is not null")
    return never.select("doc", F.lit("NEVER_RETRIEVED").alias("signal")).unionByName(found)


def retrieval_means(records: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Records with mean_score of their documents; null if they have none."""
    means = retrieved.groupBy("retrieval_id").agg(F.avg("score").alias("mean_score"))
    return records.join(means, "retrieval_id", "left")


def low_relevance(records: DataFrame, retrieved: DataFrame, threshold: float) -> DataFrame:
    """Query texts whose mean of retrieval means is below the threshold; empty retrievals are skipped."""
    means = retrieval_means(records, retrieved).where("mean_score is not null")
    return means.groupBy("query_text").agg(F.avg("mean_score").alias("avg_score"), F.count(F.lit(1)).alias("retrievals")).where(F.col("avg_score") < threshold)


def zero_hits(records: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Query texts with retrievals without documents: how many, last time."""
    return records.join(retrieved, "retrieval_id", "left_anti").groupBy("query_text").agg(F.count(F.lit(1)).alias("misses"), F.max("ts").alias("last_ts"))


def query_frequency(records: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Per query text: retrievals, mean of means (an empty retrieval counts as 0), first and last time."""
    return retrieval_means(records, retrieved).groupBy("query_text").agg(F.count(F.lit(1)).alias("retrievals"), F.avg(F.coalesce("mean_score", F.lit(0.0))).alias("avg_score"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def correlation_graph(records: DataFrame, retrieved: DataFrame, feedback: DataFrame, since: Any = None, until: Any = None) -> DataFrame:
    """Edges (query in lower case and stripped, doc): co-occurrences, mean score, outcomes; feedback from the window."""
    r = in_window(records, since, until).select("retrieval_id", F.lower(F.trim("query_text")).alias("query"))
    judged = in_window(last_feedback(feedback), since, until).select("retrieval_id", "doc", "outcome")
    rows = retrieved.join(r, "retrieval_id").join(judged, ["retrieval_id", "doc"], "left")
    return rows.groupBy("query", "doc").agg(F.count(F.lit(1)).alias("together"), F.avg("score").alias("avg_score"), *outcome_counts())


def document_impact(edges: DataFrame) -> DataFrame:
    """Per document: distinct queries, retrievals, mean score weighted by co-occurrence, outcomes."""
    return edges.groupBy("doc").agg(
        F.count(F.lit(1)).alias("queries"), F.sum("together").alias("retrievals"), (F.sum(F.col("avg_score") * F.col("together")) / F.sum("together")).alias("avg_score"), *[F.sum(o.lower()).alias(o.lower()) for o in OUTCOMES]
    )


def jaccard_pairs(edges: DataFrame, threshold: float, key: str = "query", item: str = "doc") -> DataFrame:
    """Exact pairs (q1 < q2) of keys whose item sets have Jaccard >= threshold > 0, by prefix filtering.

    Items are ordered from rare to common; two sets at the threshold must share one of the first
    size - ceil(threshold * size) + 1 items of each, so only these are joined, and common items rarely are.
    """
    if threshold <= 0:
        raise ValueError("threshold must be positive")
    rows = edges.select(F.col(key).alias("q"), F.col(item).alias("d")).distinct()
    df = rows.groupBy("d").agg(F.count(F.lit(1)).alias("df"))
    sets = rows.join(df, "d").groupBy("q").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "d"))), lambda x: x["d"]).alias("items"))
    size = F.size("items")
    first = sets.select("q", F.explode(F.slice("items", 1, F.greatest(size - F.ceil(size * threshold - 1e-9).cast("int") + 1, F.lit(1)))).alias("d"))
    a, b = first.select(F.col("q").alias("q1"), "d"), first.select(F.col("q").alias("q2"), "d")
    pairs = a.join(b, "d").where("q1 < q2").select("q1", "q2").distinct()
    full = pairs.join(sets.select(F.col("q").alias("q1"), F.col("items").alias("i1")), "q1").join(sets.select(F.col("q").alias("q2"), F.col("items").alias("i2")), "q2")
    common = F.size(F.array_intersect("i1", "i2"))
    return full.select("q1", "q2", (common / (F.size("i1") + F.size("i2") - common)).alias("jaccard")).where(F.col("jaccard") >= threshold)


def query_clusters(edges: DataFrame, threshold: float) -> DataFrame:
    """Connected components of two queries or more: cluster (its first query), size, smallest Jaccard of any two
    members, documents that all share; best first."""
    pairs = jaccard_pairs(edges, threshold)
    members = connected_components(pairs.select(F.col("q1").alias("a"), F.col("q2").alias("b"))).select(F.col("node").alias("query"), F.col("component").alias("cluster"))
    sizes = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    held = edges.select("query", "doc").distinct().join(members, "query")
    counts = held.groupBy("query", "cluster").agg(F.count(F.lit(1)).alias("n"))
    # Overlap of any two members: through shared documents; a pair without any is 0.
    meet = held.alias("x").join(held.alias("y"), (F.col("x.cluster") == F.col("y.cluster")) & (F.col("x.doc") == F.col("y.doc")) & (F.col("x.query") < F.col("y.query")))
    meet = meet.groupBy(F.col("x.cluster").alias("cluster"), F.col("x.query").alias("q1"), F.col("y.query").alias("q2")).agg(F.count(F.lit(1)).alias("common"))
    meet = meet.join(counts.select(F.col("query").alias("q1"), F.col("n").alias("n1")), "q1").join(counts.select(F.col("query").alias("q2"), F.col("n").alias("n2")), "q2")
    least = meet.groupBy("cluster").agg(F.min(F.col("common") / (F.col("n1") + F.col("n2") - F.col("common"))).alias("m"), F.count(F.lit(1)).alias("met"))
    shared = held.groupBy("cluster", "doc").agg(F.count(F.lit(1)).alias("n")).join(sizes, "cluster").where("n = size").groupBy("cluster").agg(F.array_sort(F.collect_set("doc")).alias("shared"))
    out = sizes.join(least, "cluster", "left").join(shared, "cluster", "left")
    every = F.col("size") * (F.col("size") - 1) / 2
    return out.select("cluster", "size", F.when(F.col("met") == every, F.col("m")).otherwise(0.0).alias("least_jaccard"), F.coalesce("shared", F.array().cast("array<string>")).alias("shared"))


# MinHash


def _seeded(seed: int):
    return lambda x: F.xxhash64(x, F.lit(seed))


def minhash(items: Column | str, hashes: int = 128) -> Column:
    """array<long>: for each of ``hashes`` seeds the smallest hash of an element; null for an empty array."""
    c = F.col(items) if isinstance(items, str) else items
    return F.when(F.size(c) > 0, F.array(*[F.array_min(F.transform(c, _seeded(s))) for s in range(hashes)]))


def estimated_jaccard(a: Column | str, b: Column | str) -> Column:
    """The share of equal places of two signatures."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    return F.aggregate(F.zip_with(x, y, lambda p, q: (p == q).cast("int")), F.lit(0), lambda s, v: s + v) / F.size(x)


def bands(threshold: float, hashes: int = 128, recall: float = 0.999) -> tuple[int, int]:
    """(bands, rows) with bands * rows = hashes: the longest rows with which a pair at the threshold meets with the
    given chance."""
    options = [(hashes // r, r) for r in range(hashes, 0, -1) if hashes % r == 0]
    return next((o for o in options if 1 - (1 - threshold ** o[1]) ** o[0] >= recall), (hashes, 1))


def lsh_pairs(sets: DataFrame, threshold: float, hashes: int = 128, key: str = "q", items: str = "items") -> DataFrame:
    """Pairs that share a band of their signatures, verified exactly on the sets."""
    n, r = bands(threshold, hashes)
    signed = sets.select(F.col(key).alias("q"), F.col(items).alias("items"), minhash(items, hashes).alias("s"))
    keys = F.array(*[F.xxhash64(F.lit(b), F.slice("s", b * r + 1, r)) for b in range(n)])
    rows = signed.select("q", F.explode(keys).alias("k"))
    pairs = rows.select(F.col("q").alias("q1"), "k").join(rows.select(F.col("q").alias("q2"), "k"), "k").where("q1 < q2").select("q1", "q2").distinct()
    full = pairs.join(signed.select(F.col("q").alias("q1"), F.col("items").alias("i1")), "q1").join(signed.select(F.col("q").alias("q2"), F.col("items").alias("i2")), "q2")
    common = F.size(F.array_intersect("i1", "i2"))
    return full.select("q1", "q2", (common / (F.size("i1") + F.size("i2") - common)).alias("jaccard")).where(F.col("jaccard") >= threshold)


def feature_statistics(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Least, greatest, median and 75th percentile by nearest rank, and the number of values."""
    disc = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})")
    return df.groupBy(*by).agg(F.min(value).alias("low"), F.max(value).alias("high"), disc(0.5).alias("median"), disc(0.75).alias("p75"), F.count(value).alias("n"))


def calibrate(df: DataFrame, score: str = "score") -> DataFrame:
    """Grade thresholds from scores: 75th and 25th percentile, interpolated."""
    return df.agg(F.percentile(score, F.lit(0.75)).alias("correct_from"), F.percentile(score, F.lit(0.25)).alias("incorrect_to"))
