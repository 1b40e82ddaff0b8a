"""Agent memory over an append-only table: queries and their orders, event records, erasure and purge.

Columns: memory_id, tenant_id, entity_id, domain, case_id, text, attributes map<string,string>, created_at, importance.
Each function takes the tenant as a required argument and works on a table partitioned by it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from enum import Enum
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions import decay
from sievework.functions.text import clean_question
from sievework.operators import filters
from sievework.operators.lexical import bm25

MAX_ENTITIES, DEFAULT_LIMIT = 25, 20


class Order(Enum):
    CHRONOLOGICAL = "chronological"
    RELEVANCE = "relevance"
    SALIENCE = "salience"


class Capability(Enum):
    ERASE = "erase"
    QUERY = "query"
    SCAN = "scan"
    PURGE = "purge"
    RELEVANCE = "relevance"
    DISCOVER_TENANTS = "discover_tenants"
    GRAPH = "graph"


def require(capabilities: set[Capability], wanted: Capability) -> None:
    """Raise if a backend does not declare a capability."""
    if wanted not in capabilities:
        raise NotImplementedError(f"no capability {wanted.value}")


def require_tenant(caller: str, tenant: str, admin: bool = False) -> None:
    """Raise if a caller asks for another tenant's rows without being an administrator."""
    if caller != tenant and not admin:
        raise PermissionError(f"{caller} may not read {tenant}")


@dataclass(frozen=True)
class Query:
    tenant_id: str
    entity_ids: Sequence[str]
    domain: str | None = None
    case_id: str | None = None
    question: str | None = None
    limit: int = DEFAULT_LIMIT
    since: Any = None
    order: Order = Order.CHRONOLOGICAL

    def __post_init__(self):
        if not 1 <= len(self.entity_ids) <= MAX_ENTITIES:
            raise ValueError(f"1 to {MAX_ENTITIES} entities")
        if self.limit < 1:
            raise ValueError("limit must be positive")


def experiences(tenant: str, agent: str, **more: Any) -> Query:
    return Query(tenant, [agent], "experience", **more)


def reflections(tenant: str, agent: str, **more: Any) -> Query:
    return Query(tenant, [agent], "reflection", **({"limit": 15} | more))


def relationships(tenant: str, agent: str, other: str | None = None, **more: Any) -> Query:
    """Of one agent, or of a pair."""
    return Query(tenant, [agent, other] if other else [agent], "relationship", **more)


def matching(df: DataFrame, q: Query) -> DataFrame:
    """The rows that a query may return, before order and limit; filters reach the scan."""
    df = df.where((F.col("tenant_id") == q.tenant_id) & F.col("entity_id").isin(*q.entity_ids))
    if q.domain is not None:
        df = df.where(F.col("domain") == q.domain)
    if q.case_id is not None:
        df = df.where(F.col("case_id") == q.case_id)
    if q.since is not None:
        df = df.where(F.col("created_at") >= F.lit(str(q.since)).cast("timestamp"))
    return df


def query(df: DataFrame, q: Query, as_of: Any = None) -> DataFrame:
    """The rows in the order asked for, at most ``limit``. Relevance without a question is chronological; with one it is
    BM25 over the matching rows' texts. Ties by memory_id."""
    rows = matching(df, q)
    question = (q.question or "").strip()
    if q.order is Order.RELEVANCE and question:
        found = bm25(rows, clean_question(question), q.limit, id_col="memory_id", text_col="text")
        return rows.join(F.broadcast(found.withColumnRenamed("id", "memory_id").withColumnRenamed("score", "relevance")), "memory_id").orderBy(F.desc("relevance"), "memory_id")  # at most ``limit`` rows
    if question and q.order is not Order.SALIENCE:
        rows = rows.where(filters.text_contains("text", question))
    if q.order is Order.SALIENCE:
        return rows.withColumn("salience", decay.salience("importance", "created_at", as_of)).orderBy(F.desc("salience"), "memory_id").limit(q.limit)
    return rows.orderBy(F.desc("created_at"), "memory_id").limit(q.limit)


def scan(df: DataFrame, tenant: str, limit: int, after: Any = None, attribute: tuple[str, str] | None = None, key: str = "memory_id") -> DataFrame:
    """A page in key order behind the cursor; the last key is the next cursor if the page is full."""
    rows = df.where(F.col("tenant_id") == tenant)
    if attribute:
        rows = rows.where(filters.attribute(*attribute))
    if after is not None:
        rows = rows.where(F.col(key) > after)
    return rows.orderBy(key).limit(limit)


def tenants(df: DataFrame, domain: str | None = None, attribute: tuple[str, str] | None = None) -> DataFrame:
    if domain is not None:
        df = df.where(F.col("domain") == domain)
    if attribute:
        df = df.where(filters.attribute(*attribute))
    return df.select("tenant_id").distinct()


def personality(df: DataFrame, weights: Mapping[str, float], as_of: Any, mood: tuple[float, float, float] | None = None, influence: float = 0.0) -> DataFrame:
    """Rows by recency, importance and the weight of their domain, and by closeness to a mood if one is given."""
    w = decay.personality_weight("created_at", "importance", "domain", weights, as_of)
    if mood is not None:
        axis = lambda n: F.try_element_at(F.col("attributes"), F.lit(n)).try_cast("double")
        w = w * decay.mood_factor(axis("pleasure"), axis("arousal"), axis("dominance"), mood, influence)
    return df.withColumn("weight", w).orderBy(F.desc("weight"), "memory_id")


# Writing

RESERVED = ("agent_id", "turn_id", "event_type", "subject", "outcome", "target", "pleasure", "arousal", "dominance", "cause", "level", "sources", "confidence")


def record(events: DataFrame, domain: str, entity: Column | str, text: Column | str, keys: Mapping[str, Column | str], metadata: Column | None = None, importance: Column | None = None) -> DataFrame:
    """Typed events as memory rows: reserved keys go into the attributes beside the event's own metadata, which may not
    use them (``quarantined`` is true for rows that do)."""
    col = lambda x: F.col(x) if isinstance(x, str) else x
    wrong = [k for k in keys if k not in RESERVED]
    if wrong:
        raise ValueError(f"not reserved: {wrong}")
    own = F.create_map(*[x for k, v in keys.items() for x in (F.lit(k), col(v).cast("string"))])
    meta = metadata if metadata is not None else F.create_map().cast("map<string,string>")
    clash = F.arrays_overlap(F.map_keys(meta), F.lit(list(RESERVED)))
    return events.select(
        F.col("memory_id"), F.col("tenant_id"), col(entity).cast("string").alias("entity_id"), F.lit(domain).alias("domain"), F.col("case_id"), col(text).alias("text"),
        F.map_filter(F.map_concat(F.map_filter(meta, lambda k, _: ~k.isin(*RESERVED)), own), lambda _, v: v.isNotNull()).alias("attributes"),
        F.col("created_at"), (importance if importance is not None else F.lit(None).cast("double")).alias("importance"), F.coalesce(clash, F.lit(False)).alias("quarantined"),
    )


def mood_faults(*axes: Column | str) -> Column:
    """array<int>: the places of axes that lie outside -1 ... 1 or are missing."""
    col = lambda x: F.col(x) if isinstance(x, str) else x
    return F.array_compact(F.array(*[F.when(~F.coalesce(col(a).between(-1, 1), F.lit(False)), F.lit(i)) for i, a in enumerate(axes)]))


def reflection_importance(importance: Column, level: Column) -> Column:
    """min(0.3 + 0.2 * level, 1) where none is given."""
    return F.coalesce(importance, F.least(F.lit(0.3) + 0.2 * level, F.lit(1.0)))


def relationships_of(experience: DataFrame) -> DataFrame:
    """Relationship rows of experiences with another agent as target: one for each, never of an agent with itself."""
    target = F.try_element_at(F.col("attributes"), F.lit("target"))
    rows = experience.where(target.isNotNull() & (target != F.col("entity_id")))
    return rows.select(F.concat(F.col("memory_id"), F.lit("-rel")).alias("memory_id"), "tenant_id", "entity_id", F.lit("relationship").alias("domain"), "case_id", "text", F.map_from_arrays(F.array(F.lit("target")), F.array(target)).alias("attributes"), "created_at", "importance")


def enrich(df: DataFrame, steps: Sequence[tuple[int, Column | None, Any, bool]]) -> DataFrame:
    """Steps (priority, condition, function DataFrame -> DataFrame, optional) by priority. Rows that do not meet a
    step's condition pass by it; an optional step that cannot be planned is left out."""
    for _, condition, function, optional in sorted(steps, key=lambda s: s[0]):
        try:
            done = function(df if condition is None else df.where(condition))
            df = done if condition is None else done.unionByName(df.where(~F.coalesce(condition, F.lit(False))), allowMissingColumns=True)
        except Exception:
            if not optional:
                raise
    return df


def store_result(df: DataFrame, valid: Column) -> tuple[DataFrame, DataFrame]:
    """(rows to store, failures with their place in the input): ``df`` has input_index."""
    ok = F.coalesce(valid, F.lit(False))
    return df.where(ok), df.where(~ok).select("input_index", F.lit("invalid").alias("reason"))


# Erasure: each returns what is left; the count is that of the opposite filter.


def erased(tenant: str, entity: str | None = None, domain: str | None = None, case_id: str | None = None, memory_id: str | None = None) -> Column:
    test = F.col("tenant_id") == tenant
    for name, value in (("entity_id", entity), ("domain", domain), ("case_id", case_id), ("memory_id", memory_id)):
        if value is not None:
            test = test & (F.col(name) == value)
    return F.coalesce(test, F.lit(False))


def erase(df: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, one row: how many go)."""
    return df.where(~condition), df.where(condition).agg(F.count(F.lit(1)).alias("erased"))


def erasure_event(counts: DataFrame, entity: str, domain: str | None = None) -> DataFrame:
    """One event (entity_id, domain, erased) if something was erased, else none."""
    return counts.where("erased > 0").select(F.lit(entity).alias("entity_id"), F.lit(domain).cast("string").alias("domain"), "erased")


def erase_everywhere(df: DataFrame, entity: str, admin: bool) -> tuple[DataFrame, DataFrame]:
    """An entity's rows of all tenants; for administrators."""
    if not admin:
        raise PermissionError("erasing across tenants needs an administrator")
    return erase(df, F.coalesce(F.col("entity_id") == entity, F.lit(False)))


def purged(before: Any = None, importance_below: float | None = None) -> Column:
    """Older than ``before`` and, if set, less important: both must hold; a missing importance is never eligible."""
    tests = []
    if before is not None:
        tests.append(F.col("created_at") < F.lit(str(before)).cast("timestamp"))
    if importance_below is not None:
        tests.append(F.coalesce(F.col("importance") < importance_below, F.lit(False)))
    if not tests:
        return F.lit(False)
    return tests[0] & tests[1] if len(tests) == 2 else tests[0]
