"""Case schemas: named feature fields of nine kinds, with their local similarity, and validation of values."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievework.functions.trends import KINDS


@dataclass(frozen=True)
class Range:
    """A query range, inclusive."""

    low: float
    high: float

    def __post_init__(self):
        if self.low > self.high:
            raise ValueError(f"range {self.low} > {self.high}")

    @classmethod
    def around(cls, centre: float, tolerance: float = 0.0) -> Range:
        """centre plus or minus the tolerance's share of it."""
        d = abs(centre * tolerance)
        return cls(centre - d, centre + d)


@dataclass(frozen=True)
class Categorical:
    name: str
    table: Mapping[tuple[str, str], float] | None = None  # symmetric; absent pairs are 0


@dataclass(frozen=True)
class Numeric:
    name: str
    low: float
    high: float
    spec: str = "linear"  # linear, gaussian (sigma), step (tolerance), exponential (rate)
    parameter: float = 0.0


@dataclass(frozen=True)
class Text:
    name: str
    embedding: str | None = None  # column of the case's embedding if compared by meaning


@dataclass(frozen=True)
class CategoricalList:
    name: str


@dataclass(frozen=True)
class NumericList:
    name: str
    low: float
    high: float


@dataclass(frozen=True)
class Nested:
    name: str
    fields: tuple[Categorical | Numeric | Text, ...]


@dataclass(frozen=True)
class ObjectList:
    name: str
    fields: tuple[Categorical | Numeric | Text, ...]


@dataclass(frozen=True)
class TimeSeries:
    name: str
    time: str
    fields: tuple[Categorical | Numeric | Text, ...]
    band: int | None = None  # Sakoe-Chiba
    slope: float | None = None  # Itakura
    trends: tuple[str, ...] = ()
    longest: float = 31_536_000.0  # upper end of the duration trend: a year, in the unit of the time field


@dataclass(frozen=True)
class Sequence_:
    name: str
    costs: tuple[float, float] = (1.0, 1.0)  # insert, delete
    table: Mapping[tuple[str, str], float] | None = None


Field = Categorical | Numeric | Text | CategoricalList | NumericList | Nested | ObjectList | TimeSeries | Sequence_


@dataclass(frozen=True)
class Schema:
    case_type: str
    fields: tuple[Field, ...]
    learning_rate: float = 0.2

    def __post_init__(self):
        names = [f.name for f in self.fields]
        if len(set(names)) < len(names):
            raise ValueError("field names repeat")

    def field(self, name: str) -> Field | None:
        return next((f for f in self.fields if f.name == name), None)

    def expanded(self) -> Schema:
        """With a numeric field for every trend of a series that the schema does not have itself."""
        from sievework.functions.text import trend_name

        names = {f.name for f in self.fields}
        more: list[Field] = []
        for f in self.fields:
            if not isinstance(f, TimeSeries):
                continue
            for kind in f.trends:
                inner = [g for g in f.fields if isinstance(g, Numeric) and g.name != f.time] if kind not in ("duration", "count") else [None]
                for g in inner:
                    name = trend_name(f.name, kind, g.name if g else None)
                    if name not in names:
                        names.add(name)
                        more.append(Numeric(name, *trend_range(kind, g, f.longest)))
        return Schema(self.case_type, self.fields + tuple(more), self.learning_rate)


def trend_range(kind: str, inner: Numeric | None, longest: float) -> tuple[float, float]:
    """The range of a derived numeric field, from the range of its source field."""
    if kind not in KINDS:
        raise ValueError(kind)
    width = inner.high - inner.low if inner else 0.0
    if kind in ("slope", "delta", "acceleration"):
        return -width, width
    if kind == "volatility":
        return 0.0, width
    return (0.0, longest) if kind == "duration" else (0.0, 1000.0)


#: The preset for changes of personality.
PERSONALITY_TRANSITION = Schema(
    "personality-transition",
    tuple(Categorical(n) for n in ("agent_id", "old_dominant", "new_dominant", "old_auxiliary", "new_auxiliary", "trigger_type", "outcome")),
)


def typed(value: Any) -> Any:
    """A raw query value as the engine compares it: booleans as text, numbers as double, lists and maps inside too."""
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, int | float):
        return float(value)
    if isinstance(value, list | tuple):
        return [typed(v) for v in value]
    if isinstance(value, Mapping):
        return {k: typed(v) for k, v in value.items()}
    if isinstance(value, str | Range) or value is None:
        return value
    raise TypeError(f"no feature value: {type(value).__name__}")


def raw_json(*columns: str) -> Column:
    """Features as one JSON object; missing ones are left out."""
    return F.to_json(F.struct(*columns))


def check_query(schema: Schema, query: Mapping[str, Any]) -> None:
    """Raise if a value does not fit the field of its name; names outside the schema are ignored."""
    for name, value in query.items():
        f = schema.field(name)
        if f is None or value is None:
            continue
        v = typed(value)
        fits = {
            Categorical: lambda: isinstance(v, str),
            Text: lambda: isinstance(v, str),
            Numeric: lambda: isinstance(v, float | Range),
            CategoricalList: lambda: isinstance(v, list) and all(isinstance(x, str) for x in v),
            NumericList: lambda: isinstance(v, list) and all(isinstance(x, float) for x in v),
            Nested: lambda: isinstance(v, dict),
            ObjectList: lambda: isinstance(v, list) and all(isinstance(x, dict) for x in v),
            TimeSeries: lambda: isinstance(v, list) and all(isinstance(x, dict) for x in v) and all(a[f.time] <= b[f.time] for a, b in zip(v, v[1:], strict=False)),
            Sequence_: lambda: isinstance(v, list) and all(isinstance(x, str) for x in v),
        }[type(f)]()
        if not fits:
            raise ValueError(f"{name}: {value!r} does not fit {type(f).__name__}")


def faults(schema: Schema) -> Column:
    """array<string>: the fields whose stored values break a rule (numbers out of range in lists, times that fall)."""
    out = []
    for f in schema.fields:
        if isinstance(f, NumericList):
            bad = F.exists(F.col(f.name), lambda x: (x < f.low) | (x > f.high))
        elif isinstance(f, TimeSeries):
            t = F.transform(F.col(f.name), lambda o: o[f.time])
            bad = F.exists(F.zip_with(F.slice(t, 1, F.greatest(F.size(t) - 1, F.lit(0))), F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0))), lambda a, b: b < a), lambda x: x)
        else:
            continue
        out.append(F.when(F.coalesce(bad, F.lit(False)), F.lit(f.name)))
    return F.array_compact(F.array(*out)) if out else F.array().cast("array<string>")


def split_valid(df, schema: Schema):
    """(valid rows, rows in quarantine with their ``faults``)."""
    marked = df.withColumn("faults", faults(schema))
    return marked.where(F.size("faults") == 0).drop("faults"), marked.where(F.size("faults") > 0)


