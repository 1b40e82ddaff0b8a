"""After a first retrieval: reranking, corrective grading, query expansion and fan-out."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.vectors import cosine
from sievework.operators import fusion

CORRECT, AMBIGUOUS, INCORRECT = "CORRECT", "AMBIGUOUS", "INCORRECT"
CROSS_ENCODER, LATE_INTERACTION = (0.7, 0.3), (0.55, 0.35)  # correct from, incorrect to


def rerank(df: DataFrame, scorer: Callable[[DataFrame], Column], k: int, overfetch: int = 30, tie: str = "id") -> DataFrame:
    """The best max(k, overfetch) rows by another score, cut to k; the first score stays as ``first_score``."""
    head = fusion.top(df, max(k, overfetch), tie=tie).withColumnRenamed("score", "first_score")
    return fusion.top(head.withColumn("score", scorer(head)), k, tie=tie)


def grade(score: Column | str, thresholds: tuple[float, float] = CROSS_ENCODER) -> Column:
    s = F.col(score) if isinstance(score, str) else score
    return F.when(s >= thresholds[0], CORRECT).when(s <= thresholds[1], INCORRECT).otherwise(AMBIGUOUS)


def grade_counts(df: DataFrame, by: Sequence[str] = (), grade_col: str = "grade") -> DataFrame:
    return df.groupBy(*by).agg(*[F.count_if(F.col(grade_col) == g).alias(g.lower()) for g in (CORRECT, AMBIGUOUS, INCORRECT)])


def corrective(first: DataFrame, wider: DataFrame, k: int, grader: Callable[[DataFrame], Column], key: Sequence[str] = ("doc", "content")) -> DataFrame:
    """Graded retrieval: incorrect rows go; if that leaves fewer than k (and some went), the rows of a wider retrieval
    (3 k) that were not in the first follow, graded too. Correct rows come first, then by pass and position, k in all.

    first and wider have ``position``. Both passes are one plan; the second is empty where the first is enough.
    """
    a = first.withColumn("grade", grader(first)).withColumn("pass", F.lit(1))
    good = a.where(F.col("grade") != INCORRECT)
    need = a.agg(((F.count_if(F.col("grade") != INCORRECT) < k) & (F.count_if(F.col("grade") == INCORRECT) > 0)).alias("need"))  # one row
    b = wider.withColumn("grade", grader(wider)).withColumn("pass", F.lit(2)).join(first.select(*key), list(key), "left_anti").where(F.col("grade") != INCORRECT)
    b = b.crossJoin(F.broadcast(need)).where("need").drop("need")
    both = good.unionByName(b.select(*good.columns))
    return both.orderBy((F.col("grade") != CORRECT).cast("int"), "pass", "position").limit(k)


def expand(queries: DataFrame, expanders: Sequence[Callable[[Column], Column]], text: str = "text") -> DataFrame:
    """(query columns, variant, expanded): the original is variant 0, each expander gives one text more (null: none)."""
    variants = [F.struct(F.lit(0).alias("variant"), F.col(text).alias("expanded"))]
    variants += [F.struct(F.lit(i).alias("variant"), e(F.col(text)).alias("expanded")) for i, e in enumerate(expanders, 1)]
    flat = queries.withColumn("_v", F.explode(F.array(*variants))).select(*queries.columns, "_v.variant", "_v.expanded")
    return flat.where("expanded is not null")


def without_drift(variants: DataFrame, original: str = "original_vector", expanded: str = "expanded_vector", least: float = 0.7) -> DataFrame:
    """Variants whose meaning is near the original's; variant 0 stays."""
    return variants.where((F.col("variant") == 0) | (cosine(original, expanded) >= least))


def fan_out(found: DataFrame, k: int, by: Sequence[str] = ("query_id",), rank_constant: int = 60) -> DataFrame:
    """Retrievals of all variants (by..., variant, id, score) fused with equal weights."""
    return fusion.reciprocal_rank(found.withColumn("leg", F.col("variant").cast("string")), rank_constant, top_k=k, by=by)
