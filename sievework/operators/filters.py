"""Filter algebras compiled to two-valued predicates: payload filters over metadata, case filters over features, scopes.

Every predicate is true or false, never null, so negation keeps rows whose field is missing.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.schema import Range

# Payload filters


@dataclass(frozen=True)
class Eq:
    field: str
    value: str


@dataclass(frozen=True)
class In:
    field: str
    values: tuple[str, ...]


@dataclass(frozen=True)
class Not:
    inner: Payload


@dataclass(frozen=True)
class And:
    inner: tuple[Payload, ...]


@dataclass(frozen=True)
class Or:
    inner: tuple[Payload, ...]


@dataclass(frozen=True)
class Between:
    """Numeric, inclusive; either end may be open."""

    field: str
    low: float | None = None
    high: float | None = None


Payload = Eq | In | Not | And | Or | Between


def payload(f: Payload, metadata: Column | str = "metadata", lists: Column | str | None = None) -> Column:
    """The predicate of a payload filter on a map<string,string> and, if there is one, a map<string,array<string>>."""
    m = F.col(metadata) if isinstance(metadata, str) else metadata
    li = F.col(lists) if isinstance(lists, str) else lists

    def build(x: Payload) -> Column:
        match x:
            case Eq(name, value):
                return F.coalesce(F.try_element_at(m, F.lit(name)) == value, F.lit(False))
            case In(name, values):
                found = F.coalesce(F.try_element_at(m, F.lit(name)).isin(*values), F.lit(False))
                if li is None:
                    return found
                return found | F.coalesce(F.arrays_overlap(F.try_element_at(li, F.lit(name)), F.lit(list(values))), F.lit(False))
            case Not(inner):
                return ~build(inner)
            case And(inner) | Or(inner):
                if not inner:
                    raise ValueError("no operands")
                return reduce((lambda a, b: a & b) if isinstance(x, And) else (lambda a, b: a | b), map(build, inner))
            case Between(name, low, high):
                number = F.try_element_at(m, F.lit(name)).try_cast("double")
                tests = ([number >= low] if low is not None else []) + ([number <= high] if high is not None else [])
                return F.coalesce(reduce(lambda a, b: a & b, tests), F.lit(False)) if tests else number.isNotNull()
        raise TypeError(x)

    return build(f)


# Case filters: on one feature column


@dataclass(frozen=True)
class Contains:
    value: Any


@dataclass(frozen=True)
class ContainsAll:
    values: tuple[Any, ...]


@dataclass(frozen=True)
class ContainsAny:
    values: tuple[Any, ...]


@dataclass(frozen=True)
class NotContains:
    value: Any


@dataclass(frozen=True)
class NotContainsAny:
    values: tuple[Any, ...]


@dataclass(frozen=True)
class ContainsRange:
    range: Range


@dataclass(frozen=True)
class HasMatch:
    """A struct, or one element of a list of structs, meets all sub-fields: equality, an exact number or a range."""

    fields: Mapping[str, Any]
    is_list: bool = True


@dataclass(frozen=True)
class AllOf:
    inner: tuple[CaseFilter, ...]

    def __post_init__(self):
        if len(self.inner) < 2 or any(isinstance(f, AllOf) for f in self.inner):
            raise ValueError("two or more filters that are not nested")


CaseFilter = Contains | ContainsAll | ContainsAny | NotContains | NotContainsAny | ContainsRange | HasMatch | AllOf


def case_filter(f: CaseFilter, column: Column | str) -> Column:
    """The predicate of a case filter; a missing field never matches, negations included."""
    c = F.col(column) if isinstance(column, str) else column

    def meets(element: Column, fields: Mapping[str, Any]) -> Column:
        tests = [element[k].between(v.low, v.high) if isinstance(v, Range) else element[k] == v for k, v in fields.items()]
        return F.coalesce(reduce(lambda a, b: a & b, tests), F.lit(False))

    match f:
        case Contains(value):
            out = F.array_contains(c, F.lit(value))
        case ContainsAll(values):
            out = F.size(F.array_except(F.lit(list(values)), c)) == 0
        case ContainsAny(values):
            out = F.arrays_overlap(c, F.lit(list(values)))
        case NotContains(value):
            out = ~F.coalesce(F.array_contains(c, F.lit(value)), F.lit(False))
        case NotContainsAny(values):
            out = ~F.coalesce(F.arrays_overlap(c, F.lit(list(values))), F.lit(False))
        case ContainsRange(range):
            out = F.exists(c, lambda x: x.between(range.low, range.high))
        case HasMatch(fields, is_list):
            out = F.exists(c, lambda e: meets(e, fields)) if is_list else meets(c, fields)
        case AllOf(inner):
            out = reduce(lambda a, b: a & b, [case_filter(g, c) for g in inner])
        case _:
            raise TypeError(f)
    return F.coalesce(c.isNotNull() & out, F.lit(False))


# Times, scopes, identities, memory predicates


def valid_at(valid_from: Column | str, valid_until: Column | str, at: Any) -> Column:
    """from <= at < until; a missing start is always valid, a missing end open."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (valid_from, valid_until))
    t = F.lit(str(at)).cast("timestamp")
    return a.isNull() | (a.cast("timestamp") <= t) & (b.isNull() | (t < b.cast("timestamp")))


def ancestors(scope: str) -> list[str]:
    """The scope and all above it, the root '' last."""
    parts = scope.split("/") if scope else []
    return ["/".join(parts[:i]) for i in range(len(parts), -1, -1)]


def visible(scope: Column | str, query_scope: str) -> Column:
    """The stored scope is the query's or above it."""
    return (F.col(scope) if isinstance(scope, str) else scope).isin(*ancestors(query_scope))


def within(scope: Column | str, root: str) -> Column:
    """The stored scope is ``root`` or below it."""
    c = F.col(scope) if isinstance(scope, str) else scope
    return F.lit(True) if root == "" else (c == root) | c.startswith(root + "/")


def identity(tenant: str, domain: str | None = None, case_type: str | None = None, scope: str | None = None, not_before: Any = None) -> Column:
    """Tenant, domain, type, visible scope, not superseded, stored at ``not_before`` or later."""
    tests = [F.col("tenant_id") == tenant, ~F.coalesce(F.col("superseded"), F.lit(False))]
    if domain is not None:
        tests.append(F.col("domain") == domain)
    if case_type is not None:
        tests.append(F.col("case_type") == case_type)
    if scope is not None:
        tests.append(visible("scope", scope))
    if not_before is not None:
        tests.append(F.col("stored_at") >= F.lit(str(not_before)).cast("timestamp"))
    return reduce(lambda a, b: a & b, tests)


def attribute(name: str, value: str, column: str = "attributes") -> Column:
    return F.coalesce(F.try_element_at(F.col(column), F.lit(name)) == value, F.lit(False))


def text_contains(column: Column | str, question: str) -> Column:
    """Case-insensitive substring."""
    return F.coalesce(F.lower(F.col(column) if isinstance(column, str) else column).contains(question.lower()), F.lit(False))


def stamp(df: DataFrame, marks: Mapping[str, Column | str], metadata: str = "metadata") -> DataFrame:
    """Marks put over the metadata map; an equal key is replaced."""
    pairs = F.create_map(*[x for k, v in marks.items() for x in (F.lit(k), (v if isinstance(v, Column) else F.lit(v)).cast("string"))])
    kept = F.map_filter(F.col(metadata), lambda k, _: ~k.isin(*marks))
    return df.withColumn(metadata, F.map_concat(kept, pairs))


def best_per_document(df: DataFrame, document: str = "doc_id", score: str = "score") -> DataFrame:
    """Document references of retrieved chunks: the greatest score of each document."""
    return df.groupBy(document).agg(F.max(score).alias(score))
