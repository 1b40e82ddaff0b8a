"""Fusion of ranked lists. A leg is rows (leg, id, score); legs are unioned, so an absent leg contributes nothing.

Each function takes an optional ``by``: columns of independent queries, fused side by side in one job.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def legs(frames: Mapping[str, DataFrame], by: Sequence[str] = (), id_col: str = "id", score_col: str = "score") -> DataFrame:
    """One long table of all legs."""
    parts = [df.select(*by, F.lit(name).alias("leg"), F.col(id_col).alias("id"), F.col(score_col).cast("double").alias("score")) for name, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def first_of(frames: Sequence[DataFrame], key: str = "id") -> DataFrame:
    """Union of candidate sets; of rows with one key that of the first set stays."""
    numbered = [df.withColumn("_set", F.lit(i)) for i, df in enumerate(frames)]
    both = reduce(lambda a, b: a.unionByName(b), numbered)
    w = Window.partitionBy(key).orderBy("_set")
    return both.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank", "_set")


def top(df: DataFrame, k: int | None, by: Sequence[str] = (), score: str = "score", tie: str = "id") -> DataFrame:
    """The k best rows (of each query), ties by id."""
    if k is None:
        return df
    if not by:
        return df.orderBy(F.desc(score), tie).limit(k)
    w = Window.partitionBy(*by).orderBy(F.desc(score), tie)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k).drop("_rank")


def _weight(weights: Mapping[str, float] | None) -> Column:
    if not weights:
        return F.lit(1.0)
    table = F.create_map(*[F.lit(x) for name, w in weights.items() for x in (name, float(w))])
    return F.coalesce(F.try_element_at(table, F.col("leg")), F.lit(1.0))


def effective_weights(base: Mapping[str, float], multipliers: Mapping[str, float] | None = None) -> dict[str, float]:
    """Base weights times a query's multipliers."""
    return {leg: w * (multipliers or {}).get(leg, 1.0) for leg, w in base.items()}


def reciprocal_rank(df: DataFrame, k: int = 60, weights: Mapping[str, float] | None = None, top_k: int | None = None, by: Sequence[str] = (), names: Sequence[str] | None = None) -> DataFrame:
    """Sum of w / (k + rank) over the legs, by the sum of w / (k + 1): an id at the top of every leg scores 1.

    A leg without positive weight gives no score, but its weight counts in the norm. names: all legs of the fusion,
    empty ones included; by default those with rows.
    """
    w = Window.partitionBy(*by, "leg").orderBy(F.desc("score"), "id")
    ranked = df.withColumn("_w", _weight(weights)).withColumn("_rank", F.row_number().over(w))
    names = names or (list(weights) if weights else None)
    if names:
        whole = F.lit(sum((weights or {}).get(n, 1.0) for n in names) / (k + 1))
        summed = ranked.where("_w > 0").groupBy(*by, "id").agg(F.sum(F.col("_w") / (k + F.col("_rank"))).alias("_s"))
        out = summed.select(*by, "id", (F.col("_s") / whole).alias("score"))
    else:
        norms = ranked.select(*by, "leg", "_w").distinct().groupBy(*by).agg((F.sum("_w") / (k + 1)).alias("_norm"))
        summed = ranked.where("_w > 0").groupBy(*by, "id").agg(F.sum(F.col("_w") / (k + F.col("_rank"))).alias("_s"))
        joined = summed.join(F.broadcast(norms), list(by)) if by else summed.crossJoin(F.broadcast(norms))  # one row a query
        out = joined.select(*by, "id", (F.col("_s") / F.col("_norm")).alias("score"))
    return top(out, top_k, by)


def convex(df: DataFrame, weights: Mapping[str, float] | None = None, top_k: int | None = None, by: Sequence[str] = (), names: Sequence[str] | None = None) -> DataFrame:
    """Weighted sum of scores brought to 0 ... 1 within each leg (a leg of one score: 1), weights scaled to sum 1."""
    names = names or (list(weights) if weights else None)
    total = sum((weights or {}).get(n, 1.0) for n in names) if names else None
    if total is not None and total <= 0:
        return df.select(*by, "id", "score").limit(0)
    w = Window.partitionBy(*by, "leg")
    low, high = F.min("score").over(w), F.max("score").over(w)
    scaled = df.withColumn("_s", F.when(high == low, 1.0).otherwise((F.col("score") - low) / (high - low))).withColumn("_w", _weight(weights))
    if total is None:  # equal weights over the legs that have rows
        count = df.groupBy(*by).agg(F.count_distinct("leg").alias("_total"))
        scaled = scaled.join(F.broadcast(count), list(by)) if by else scaled.crossJoin(F.broadcast(count))  # one row a query
    else:
        scaled = scaled.withColumn("_total", F.lit(total))
    return top(scaled.groupBy(*by, "id").agg(F.sum(F.col("_w") / F.col("_total") * F.col("_s")).alias("score")), top_k, by)


def distribution(df: DataFrame, top_k: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Sum over legs of (score - (mean - 3 sd)) / (6 sd), sd of the population; a leg without spread gives 0.5."""
    w = Window.partitionBy(*by, "leg")
    mean, sd = F.avg("score").over(w), F.stddev_pop("score").over(w)
    scaled = df.withColumn("_s", F.when(sd > 0, (F.col("score") - (mean - 3 * sd)) / (6 * sd)).otherwise(0.5))
    return top(scaled.groupBy(*by, "id").agg(F.sum("_s").alias("score")), top_k, by)


def quality_leg(found: DataFrame, payloads: DataFrame, value: str, most: float, name: str = "quality", by: Sequence[str] = ()) -> DataFrame:
    """``found`` and one more leg over its ids: min(payload / most, 1)."""
    ids = found.select(*by, "id").distinct()
    leg = ids.join(payloads.select("id", value), "id").where(F.col(value).isNotNull())
    leg = leg.select(*by, F.lit(name).alias("leg"), "id", F.least(F.col(value).cast("double") / most, F.lit(1.0)).alias("score"))
    return found.select(*by, "leg", "id", "score").unionByName(leg)


def payload_boost(df: DataFrame, value: Column | str, most: float, weight: float) -> DataFrame:
    """score * (1 + min(v / most, 1) * weight); rows without a value keep their score."""
    v = (F.col(value) if isinstance(value, str) else value).try_cast("double")
    return df.withColumn("score", F.col("score") * (1 + F.coalesce(F.least(v / most, F.lit(1.0)) * weight, F.lit(0.0))))
