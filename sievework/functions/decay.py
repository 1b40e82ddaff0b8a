"""Score factors by age, scope, outcome, trust, importance and mood. ``as_of`` is always an argument."""

from __future__ import annotations

import math
from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def age_seconds(at: Column | str, as_of: datetime | str) -> Column:
    """Seconds from a time to ``as_of``, by microseconds."""
    return (F.unix_micros(F.lit(str(as_of)).cast("timestamp")) - F.unix_micros(_col(at).cast("timestamp"))) / 1e6


def _aged(at: Column | str, as_of, factor) -> Column:
    age = age_seconds(at, as_of)
    return F.when(age.isNull() | (age < 0), F.lit(1.0)).otherwise(factor(age))


def half_life(at: Column | str, as_of, life: timedelta) -> Column:
    """0.5 ** (age / life); 1 for a missing or future time."""
    return _aged(at, as_of, lambda age: F.pow(F.lit(0.5), age / life.total_seconds()))


def linear_decay(at: Column | str, as_of, zero_at: timedelta) -> Column:
    return _aged(at, as_of, lambda age: F.greatest(F.lit(0.0), 1 - age / zero_at.total_seconds()))


def step_decay(at: Column | str, as_of, cutoff: timedelta, after: float) -> Column:
    return _aged(at, as_of, lambda age: F.when(age < cutoff.total_seconds(), 1.0).otherwise(float(after)))


def scope_depth(scope: Column | str) -> Column:
    """Number of parts of a path a/b/c; the root is ''."""
    s = _col(scope)
    return F.when(s == "", 0).otherwise(F.size(F.split(s, "/")))


def scope_factor(scope: Column | str, query_scope: str, kind: str = "exponential", base: float = 0.5, max_depth: int = 5, after: float = 0.5) -> Column:
    """By the distance d from the query's depth to the case's: base ** d, max(0, 1 - d / max_depth), or 1 / ``after``."""
    d = F.greatest(F.lit((0 if query_scope == "" else query_scope.count("/") + 1)) - scope_depth(scope), F.lit(0)).cast("double")
    if kind == "exponential":
        return F.pow(F.lit(float(base)), d)
    if kind == "linear":
        return F.greatest(F.lit(0.0), 1 - d / max_depth)
    if kind == "step":
        return F.when(d == 0, 1.0).otherwise(float(after))
    raise ValueError(kind)


def outcome_weight(score: Column, confidence: Column | str, alpha: float = 0.3) -> Column:
    """score * (1 - alpha + alpha * confidence); a missing confidence is 1."""
    return score * (1 - alpha + alpha * F.coalesce(_col(confidence), F.lit(1.0)))


def trust_weight(score: Column, trust: Column | str, change: Column | None = None, influence: float = 0.3) -> Column:
    """score * (1 - i + i * trust), times max(0.5, 1 + change / 2) if trust has fallen; without trust unchanged."""
    t = _col(trust)
    weighted = score * (1 - influence + influence * t)
    if change is not None:
        weighted = weighted * F.when(change < 0, F.greatest(F.lit(0.5), 1 + 0.5 * change)).otherwise(1.0)
    return F.when(t.isNull(), score).otherwise(weighted)


def moved_confidence(old: Column, rate: Column, learning_rate: float = 0.2) -> Column:
    """(1 - lr) * old + lr * rate; a missing old value is 1."""
    return (1 - learning_rate) * F.coalesce(old, F.lit(1.0)) + learning_rate * rate


def salience(importance: Column | str, created: Column | str, as_of) -> Column:
    """Importance (1 if missing) by 1 + age in hours."""
    return F.coalesce(_col(importance), F.lit(1.0)) / (1 + age_seconds(created, as_of) / 3600)


def personality_weight(created: Column | str, importance: Column | str, domain: Column | str, weights: dict[str, float], as_of, e_fold_hours: float = 168.0) -> Column:
    """exp(-hours / 168) * importance * weight of the domain; recency is 0.5 without a time, other gaps are 1."""
    hours = age_seconds(created, as_of) / 3600
    recency = F.when(_col(created).isNull(), F.lit(0.5)).otherwise(F.exp(-hours / e_fold_hours))
    table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]) if weights else F.create_map().cast("map<string,double>")
    return recency * F.coalesce(_col(importance), F.lit(1.0)) * F.coalesce(F.try_element_at(table, _col(domain)), F.lit(1.0))


def mood_factor(pleasure: Column, arousal: Column, dominance: Column, mood: tuple[float, float, float], influence: float) -> Column:
    """1 + influence * (closeness - 0.5), closeness from the distance of two moods; 1 without a mood."""
    d = F.sqrt(sum((F.pow(a - m, 2) for a, m in zip((pleasure, arousal, dominance), mood, strict=True)), F.lit(0.0)))
    return F.coalesce(1 + influence * (1 - d / math.sqrt(12) - 0.5), F.lit(1.0))


def decay_mood(current: Column, baseline: Column, elapsed_seconds: Column, time_constant: timedelta) -> Column:
    """An axis on its way to the baseline: current + (baseline - current) * (1 - exp(-t / tau))."""
    return current + (baseline - current) * (1 - F.exp(-elapsed_seconds / time_constant.total_seconds()))
