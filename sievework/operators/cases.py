"""Case retrieval: identity filter, weighted similarity, score stages, hybrid fusion, lifecycle and retention.

Columns: tenant_id, case_id, case_type, domain, scope, features as typed columns, stored_at, confidence, trust, producer,
superseded, superseded_at, superseded_by, superseded_reason, reinstated_at, last_outcome_at, outcome.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from datetime import timedelta
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions import decay, similarity, trends
from sievework.functions.schema import Numeric, Schema, TimeSeries
from sievework.functions.text import trend_name
from sievework.operators import fusion

#: A score stage: rows with a score -> rows with another score.
Stage = Callable[[DataFrame], DataFrame]


def latest(df: DataFrame) -> DataFrame:
    """The last stored row of each (tenant, type, case)."""
    columns = [c for c in df.columns if c not in ("tenant_id", "case_type", "case_id")]
    last = df.groupBy("tenant_id", "case_type", "case_id").agg(F.max_by(F.struct(*columns), "stored_at").alias("_r"))
    return last.select("tenant_id", "case_type", "case_id", *[F.col("_r")[c].alias(c) for c in columns])


def enriched(df: DataFrame, schema: Schema) -> DataFrame:
    """With a column for every derived trend of the schema's series."""
    for f in schema.fields:
        if isinstance(f, TimeSeries):
            t = trends.field(f.name, f.time)
            for kind in f.trends:
                inner = [None] if kind in ("duration", "count") else [g.name for g in f.fields if isinstance(g, Numeric) and g.name != f.time]
                for name in inner:
                    column = trend_name(f.name, kind, name)
                    if column not in df.columns:
                        df = df.withColumn(column, trends.trend(kind, t, trends.field(f.name, name) if name else t))
    return df


def similar(df: DataFrame, schema: Schema, query: Mapping[str, Any], weights: Mapping[str, float] | None = None, least: float = 0.0, k: int | None = None, stages: Sequence[Stage] = (), tie: str = "case_id", **options: Any) -> DataFrame:
    """Cases with a score of at least ``least``, best first. All candidates are scored; stages change scores in the
    given order, each followed by the threshold again, and the limit comes last."""
    df = df.withColumn("score", similarity.score(schema, query, weights, **options)).where(F.col("score") >= least)
    for stage in stages:
        df = stage(df).where(F.col("score") >= least)
    return fusion.top(df, k, tie=tie)


def similar_many(df: DataFrame, schema: Schema, queries: Mapping[str, Mapping[str, Any]], k: int, weights: Mapping[str, float] | None = None, tie: str = "case_id") -> DataFrame:
    """A stated set of queries against all cases in one scan: (query_id, case columns, score), the k best of each."""
    scores = F.array(*[F.struct(F.lit(n).alias("query_id"), similarity.score(schema, q, weights).alias("score")) for n, q in queries.items()])
    flat = df.withColumn("_s", F.explode(scores)).select("*", "_s.query_id", "_s.score").drop("_s")
    return fusion.top(flat, k, ["query_id"], tie=tie)


def temporal(as_of: Any, kind: str = "half_life", span: timedelta = timedelta(days=30), after: float = 0.5, at: str = "stored_at") -> Stage:
    factor = {"half_life": lambda: decay.half_life(at, as_of, span), "linear": lambda: decay.linear_decay(at, as_of, span), "step": lambda: decay.step_decay(at, as_of, span, after)}[kind]()
    return lambda df: df.withColumn("score", F.col("score") * factor)


def scoped(query_scope: str, **options: Any) -> Stage:
    return lambda df: df.withColumn("score", F.col("score") * decay.scope_factor("scope", query_scope, **options))


def by_outcome(alpha: float = 0.3) -> Stage:
    return lambda df: df.withColumn("score", decay.outcome_weight(F.col("score"), "confidence", alpha))


def by_trust(influence: float = 0.3, now: DataFrame | None = None) -> Stage:
    """By trust at the time of storing; now (producer, current_trust) gives its change since, and rows of producers it
    does not know are unchanged by the change."""

    def stage(df: DataFrame) -> DataFrame:
        if now is None:
            return df.withColumn("score", decay.trust_weight(F.col("score"), "trust", None, influence))
        joined = df.join(now, "producer", "left")
        change = F.coalesce(F.col("current_trust") - F.col("trust"), F.lit(0.0))
        return joined.withColumn("score", decay.trust_weight(F.col("score"), "trust", change, influence)).drop("current_trust")

    return stage


def reranked(model: Callable[[Column, Column], Column], problem: str, text_col: str = "problem", overfetch: int = 30, tie: str = "case_id") -> Stage:
    """The best ``overfetch`` rows by sigmoid of a pair model's score."""

    def stage(df: DataFrame) -> DataFrame:
        head = fusion.top(df, overfetch, tie=tie)
        return head.withColumn("score", 1 / (1 + F.exp(-model(F.lit(problem), F.col(text_col)))))

    return stage


def effective_mode(mode: str, has_model: bool, problem: str | None) -> str:
    """FEATURE_ONLY, SEMANTIC_ONLY or HYBRID; without a model or a problem, hybrid is by features and semantic NONE."""
    if mode == "FEATURE_ONLY" or has_model and problem:
        return mode
    return "NONE" if mode == "SEMANTIC_ONLY" else "FEATURE_ONLY"


def hybrid(legs: Mapping[str, DataFrame], strategy: str = "rrf", vector_weight: float = 0.5, k: int | None = None, least: float = 0.0, rank_constant: int = 60) -> DataFrame:
    """Feature, dense, sparse and lexical legs (id, score) fused: equal ranks, or a convex combination in which the
    vector weight is split 0.6 / 0.2 / 0.2 and the threshold holds; scores are kept within -1 ... 1."""
    table = fusion.legs(legs)
    if strategy == "rrf":
        out = fusion.reciprocal_rank(table, rank_constant, top_k=None, names=list(legs))
    elif strategy == "cc":
        shares = {"feature": 1 - vector_weight, "dense": vector_weight * 0.6, "sparse": vector_weight * 0.2, "bm25": vector_weight * 0.2}
        out = fusion.convex(table, {n: shares[n] for n in legs}).where(F.col("score") >= least)
    else:
        raise ValueError(f"{strategy} is not for cases")
    return fusion.top(out.withColumn("score", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("score")))), k)


def best_plan(scored: DataFrame, plan: str = "plan") -> DataFrame:
    """The plan of the best case (ties by id) and the number of cases behind it."""
    return scored.agg(F.max_by(plan, F.struct("score", F.negative("case_id"))).alias("plan"), F.max("score").alias("score"), F.count(F.lit(1)).alias("cases"))


#: What an adaptation does to a step.
ACTIONS = ("RETAINED", "SUBSTITUTED", "BOOSTED", "SUPPRESSED", "ADDED", "REMOVED")


def adapted(df: DataFrame, plan: str = "plan", adapter: Callable[[Column], Column] | None = None) -> DataFrame:
    """Cases with ``adapted``: their plan's steps (structs) with an action and a reason. An adapter maps a step to a
    struct of action and reason; without one every step is retained."""
    keep = lambda _: F.struct(F.lit("RETAINED").alias("action"), F.lit(None).cast("string").alias("reason"))
    made = F.transform(F.col(plan), lambda s: F.struct(s.alias("step"), (adapter or keep)(s)["action"].alias("action"), (adapter or keep)(s)["reason"].alias("reason")))
    return df.withColumn("adapted", made)


def step_consensus(steps: DataFrame, step: str = "step") -> DataFrame:
    """Per plan step (rows case_id, step, worker, outcome, priority): occurrences, histograms of workers, outcomes and
    priorities, and the cases it comes from."""

    def histogram(column: str) -> DataFrame:
        counted = steps.where(F.col(column).isNotNull()).groupBy(step, F.col(column).cast("string").alias("k")).agg(F.count(F.lit(1)).alias("v"))
        return counted.groupBy(step).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "v")))).alias(f"{column}s"))

    out = steps.groupBy(step).agg(F.count(F.lit(1)).alias("occurrences"), F.array_sort(F.collect_set("case_id")).alias("cases"))
    for column in ("worker", "outcome", "priority"):
        out = out.join(histogram(column), step, "left")
    return out


def agreement(consensus: DataFrame, histogram: str = "workers", unanimous: float = 1.0, majority: float = 0.5) -> DataFrame:
    """With ``share`` (of the most frequent value of a histogram) and ``agreement``: UNANIMOUS, MAJORITY, SPLIT, or NONE
    without values."""
    values = F.map_values(F.coalesce(histogram, F.create_map().cast("map<string,bigint>")))
    total = F.aggregate(values, F.lit(0).cast("long"), lambda s, v: s + v)
    share = F.when(total > 0, F.array_max(values) / total)
    kind = F.when(F.col("share").isNull(), "NONE").when(F.col("share") >= unanimous, "UNANIMOUS").when(F.col("share") > majority, "MAJORITY").otherwise("SPLIT")
    return consensus.withColumn("share", share).withColumn("agreement", kind)


def checked_scores(df: DataFrame, score: str = "score") -> DataFrame:
    """The rows; reading fails at a score outside -1 ... 1."""
    ok = F.assert_true(F.coalesce(F.col(score).between(-1, 1), F.lit(False)), F.concat(F.lit("score out of bounds: "), F.coalesce(F.col(score).cast("string"), F.lit("null"))))
    return df.where(ok.isNull())


def to_points(df: DataFrame, features: Sequence[str], vector: str = "embedding", key: str = "case_id") -> DataFrame:
    """Cases as stored points: id (a hash of tenant, type and case), vector (one zero without an embedding), payload (a
    struct of the other columns with features as f_<name>) and features as JSON."""
    rest = [c for c in df.columns if c not in (*features, vector)]
    identity = F.md5(F.concat_ws("#", "tenant_id", "case_type", F.col(key).cast("string")))
    payload = F.struct(*rest, *[F.col(f).alias(f"f_{f}") for f in features])
    v = F.col(vector).cast("array<double>") if vector in df.columns else F.lit(None).cast("array<double>")
    return df.select(identity.alias("id"), F.coalesce(v, F.array(F.lit(0.0))).alias("vector"), payload.alias("payload"), F.to_json(F.struct(*features)).alias("features"))


def from_points(points: DataFrame, features: Sequence[str], vector: str = "embedding") -> DataFrame:
    """Cases from stored points; a vector of one zero stands for none."""
    kinds = points.schema["payload"].dataType
    rest = [f.name for f in kinds.fields if f.name not in {f"f_{x}" for x in features}]
    none = (F.size("vector") == 1) & (F.col("vector")[0] == 0)
    return points.select(*[F.col("payload")[c].alias(c) for c in rest], *[F.col("payload")[f"f_{f}"].alias(f) for f in features], F.when(~none, F.col("vector")).alias(vector))


def suggestions(scored: DataFrame, feature: str, success: Column) -> DataFrame:
    """One row over retrieved cases: nearest-rank statistics of a feature, share of successes, number, mean score."""
    return scored.agg(F.min(feature).alias("low"), F.max(feature).alias("high"), F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {feature})").alias("median"), F.expr(f"percentile_disc(0.75) WITHIN GROUP (ORDER BY {feature})").alias("p75"), F.avg(success.cast("double")).alias("success_rate"), F.count(F.lit(1)).alias("cases"), F.avg("score").alias("mean_score"))


# Lifecycle


def supersede(df: DataFrame, tenant: str, case_id: Any, at: Any, by: Any = None, reason: str | None = None) -> DataFrame:
    """Mark a case; the first time is kept, a new successor or reason replaces the old one if given."""
    hit = (F.col("tenant_id") == tenant) & (F.col("case_id") == case_id)
    set_ = lambda name, value: F.when(hit, value).otherwise(F.col(name))
    return df.withColumns({
        "superseded": set_("superseded", F.lit(True)),
        "superseded_at": set_("superseded_at", F.coalesce("superseded_at", F.lit(str(at)).cast("timestamp"))),
        "superseded_by": set_("superseded_by", F.coalesce(F.lit(by).cast("string"), F.col("superseded_by"))),
        "superseded_reason": set_("superseded_reason", F.coalesce(F.lit(reason).cast("string"), F.col("superseded_reason"))),
    })


def reinstate(df: DataFrame, tenant: str, case_id: Any, at: Any) -> DataFrame:
    hit = (F.col("tenant_id") == tenant) & (F.col("case_id") == case_id)
    clear = {c: F.when(~hit, F.col(c)) for c in ("superseded_at", "superseded_by", "superseded_reason")}
    return df.withColumns(clear | {"superseded": F.when(hit, F.lit(False)).otherwise(F.col("superseded")), "reinstated_at": F.when(hit, F.lit(str(at)).cast("timestamp")).otherwise(F.col("reinstated_at"))})


def fold_outcomes(events: DataFrame, learning_rate: float = 0.2, case_col: str = "case_id") -> DataFrame:
    """Confidence after all outcome events (case, rate, observed_at), from 1, in order of time; an event no later than
    the last one counted is dropped. One sort per case and a fold within the row."""
    start = F.struct(F.lit(1.0).alias("confidence"), F.lit(None).cast("timestamp").alias("last"), F.lit(0).alias("applied"))

    def step(s: Column, e: Column) -> Column:
        late = F.coalesce(e["observed_at"] <= s["last"], F.lit(False))
        moved = decay.moved_confidence(s["confidence"], e["rate"], learning_rate)
        return F.struct(F.when(late, s["confidence"]).otherwise(moved).alias("confidence"), F.when(late, s["last"]).otherwise(e["observed_at"]).alias("last"), (s["applied"] + (~late).cast("int")).alias("applied"))

    rows = events.select(case_col, F.struct(F.col("observed_at").cast("timestamp").alias("observed_at"), F.col("seq").alias("seq"), F.col("rate").cast("double").alias("rate")).alias("e"))
    listed = rows.groupBy(case_col).agg(F.array_sort(F.collect_list("e")).alias("es"))
    return listed.select(case_col, F.aggregate("es", start, step).alias("s")).select(case_col, "s.confidence", F.col("s.last").alias("last_outcome_at"), F.col("s.applied").cast("long").alias("applied"))


def purge(df: DataFrame, before: Any = None, keep_newest: int | None = None, trust_below: float | None = None) -> DataFrame:
    """What is left after age, number per type and trust, each on what the one before leaves; unknown trust stays."""
    if before is not None:
        df = df.where(~(F.col("stored_at") < F.lit(str(before)).cast("timestamp")))
    if keep_newest is not None:
        w = Window.partitionBy("tenant_id", "case_type").orderBy(F.desc("stored_at"), "case_id")
        df = df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= keep_newest).drop("_rank")
    if trust_below is not None:
        df = df.where(~F.coalesce(F.col("trust") < trust_below, F.lit(False)))
    return df


def trust_sweep(df: DataFrame, trust: DataFrame, least: float = 0.3) -> tuple[DataFrame, DataFrame]:
    """(cases left, rows (producer, purged)): cases whose producer's current trust is below the least go."""
    joined = df.join(trust, "producer", "left")
    low = F.coalesce(F.col("current_trust") < least, F.lit(False))
    return joined.where(~low).drop("current_trust"), joined.where(low).groupBy("producer").agg(F.count(F.lit(1)).alias("purged"))
