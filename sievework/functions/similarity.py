"""Local similarities of feature values and their weighted composite, as column expressions built from a schema."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievework.functions import schema as S
from sievework.functions.vectors import cosine

#: A caller's own similarity: (query value, case column) -> column in [0, 1].
Override = Callable[[Any, Column], Column]


def _sum(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns, F.lit(0.0))


def categorical(query: str, case: Column, table: Mapping[tuple[str, str], float] | None = None) -> Column:
    """1 if equal; else the table's value for the pair in either order, else 0."""
    out = F.when(case == query, 1.0)
    for (a, b), value in (table or {}).items():
        for x, y in ((a, b), (b, a)):
            if x == query and y != query:
                out = out.when(case == y, float(value))
    return out.otherwise(0.0)


def distance(query: float | S.Range, case: Column, low: float, high: float) -> Column:
    """Distance by the width of the field's range; within a query range 0, else to its nearer end."""
    d = F.greatest(F.lit(query.low) - case, case - query.high, F.lit(0.0)) if isinstance(query, S.Range) else F.abs(case - float(query))
    width = high - low
    return d / width if width > 0 else F.when(d == 0, 0.0).otherwise(float("inf"))


def numeric(query: float | S.Range, case: Column, low: float, high: float, spec: str = "linear", parameter: float = 0.0) -> Column:
    case = case.cast("double")
    d = distance(query, case, low, high)
    if high <= low:
        return F.when(d == 0, 1.0).otherwise(0.0)
    return {
        "linear": lambda: F.greatest(F.lit(0.0), 1 - d),
        "gaussian": lambda: F.exp(-(d * d) / (2 * parameter * parameter)),
        "step": lambda: F.when(d <= parameter, 1.0).otherwise(0.0),
        "exponential": lambda: F.exp(-parameter * d),
    }[spec]()


def text_exact(query: str, case: Column) -> Column:
    return F.when(case == query, 1.0).otherwise(0.0)


def text_semantic(query_vector: Column, case_vector: Column) -> Column:
    return F.greatest(F.lit(0.0), cosine(query_vector, case_vector))


def list_jaccard(query: list[str], case: Column) -> Column:
    """Share of common elements; an empty query is 1, an empty case 0."""
    if not query:
        return F.lit(1.0)
    q = F.lit(list(query))
    return F.when(F.size(case) == 0, 0.0).otherwise(F.size(F.array_intersect(q, case)) / F.size(F.array_union(q, case)))


def jaccard(a: Column, b: Column) -> Column:
    """Share of common elements of two sets; two empty ones are 0."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def _against(function: Callable[..., Column], query: Any, *more: Any) -> Callable[[Column], Column]:
    """The similarity of one query element to an array element."""
    return lambda x: function(query, x, *more)


def numeric_list(query: list[float], case: Column, low: float, high: float) -> Column:
    """For each query number the best linear similarity to a case number, on average."""
    if not query:
        return F.lit(1.0)
    best = [F.coalesce(F.array_max(F.transform(case, _against(numeric, q, low, high))), F.lit(0.0)) for q in query]
    return _sum(best) / len(query)


def inner(query: Mapping[str, Any], case: Column, fields: tuple) -> Column:
    """Plain mean over the fields that the query has; a missing case value is 0; no field at all is 1."""
    sims = [F.coalesce(local(f, query[f.name], case[f.name]), F.lit(0.0)) for f in fields if query.get(f.name) is not None]
    return _sum(sims) / len(sims) if sims else F.lit(1.0)


def object_list(query: list[Mapping[str, Any]], case: Column, fields: tuple) -> Column:
    """For each query object the best case object, on average."""
    if not query:
        return F.lit(1.0)
    best = [F.coalesce(F.array_max(F.transform(case, _against(inner, q, fields))), F.lit(0.0)) for q in query]
    return _sum(best) / len(query)


def local(f: S.Field, query: Any, case: Column) -> Column:
    """The similarity of a query value and a case column by the field's kind; null where the case has no value."""
    from sievework.functions import sequences

    q = S.typed(query)
    kinds = {
        S.Categorical: lambda: categorical(q, case, f.table),
        S.Numeric: lambda: numeric(q, case, f.low, f.high, f.spec, f.parameter),
        S.Text: lambda: text_exact(q, case),
        S.CategoricalList: lambda: list_jaccard(q, case),
        S.NumericList: lambda: numeric_list(q, case, f.low, f.high),
        S.Nested: lambda: inner(q, case, f.fields),
        S.ObjectList: lambda: object_list(q, case, f.fields),
        S.TimeSeries: lambda: sequences.dtw(q, case, f),
        S.Sequence_: lambda: sequences.edit(q, case, f.costs, f.table),
    }
    return F.when(case.isNotNull(), kinds[type(f)]())


def parts(schema: S.Schema, query: Mapping[str, Any], weights: Mapping[str, float] | None = None, overrides: Mapping[str, Override] | None = None, features: Callable[[str], Column] = F.col) -> list[tuple[str, float, Column]]:
    """(name, weight, similarity) of each query feature that the schema has. A caller's function comes before the
    field's specification, and that before the default of its kind. A missing case value is 0 and keeps its weight."""
    S.check_query(schema, query)
    out = []
    for name, value in query.items():
        f = schema.field(name)
        if f is None or value is None:
            continue
        case = features(name)
        sim = overrides[name](value, case) if overrides and name in overrides else local(f, value, case)
        out.append((name, float((weights or {}).get(name, 1.0)), F.coalesce(sim, F.lit(0.0))))
    return out


def score(schema: S.Schema | None, query: Mapping[str, Any], weights: Mapping[str, float] | None = None, **options: Any) -> Column:
    """Weighted mean of the similarities; 1 without a schema, without query features or without weight."""
    found = parts(schema, query, weights, **options) if schema else []
    total = sum(w for _, w, _ in found)
    return _sum([w * s for _, w, s in found]) / total if total else F.lit(1.0)


def breakdown(schema: S.Schema, query: Mapping[str, Any], weights: Mapping[str, float] | None = None, **options: Any) -> Column:
    """map: each feature's share of the score."""
    found = parts(schema, query, weights, **options)
    total = sum(w for _, w, _ in found)
    if not total:
        return F.create_map().cast("map<string,double>")
    return F.create_map(*[x for name, w, s in found for x in (F.lit(name), w * s / total)])
