"""Similarity of sequences: dynamic time warping, edit distance, their alignments, and a lower bound for pruning.

Scores run in Arrow batches: the dynamic program of a whole batch at once, one anti-diagonal (DTW) or one cell (edit)
of all pairs at a time. Alignments need the whole table of a pair and go pair by pair. The edit similarity with unit
costs is an expression.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from sievework.functions import schema as S

BIG = np.finfo(float).max


def scorable(series: S.TimeSeries) -> list[S.Numeric]:
    """The numeric fields but the time."""
    return [f for f in series.fields if isinstance(f, S.Numeric) and f.name != series.time]


def to_matrix(rows: Sequence[Any] | None, fields: list[S.Numeric]) -> np.ndarray:
    """A row per observation, each value by the width of its range; a missing value or an empty range is NaN or 0."""
    if rows is None:
        return np.zeros((0, len(fields)))
    out = np.zeros((len(rows), len(fields)))
    for j, f in enumerate(fields):
        width = f.high - f.low
        if width > 0:
            for i, row in enumerate(rows):
                value = row[f.name] if isinstance(row, dict) else getattr(row, f.name)
                out[i, j] = math.nan if value is None else value / width
    return out


def band(i: int, n: int, m: int, window: int | None, slope: float | None) -> tuple[int, int]:
    """First and last column of row i (from 1)."""
    lo, hi = 1, m
    if window is not None:
        w = max(window, abs(n - m))
        lo, hi = max(1, i - w), min(m, i + w)
    elif slope is not None:
        lo = max(1, math.ceil(i / slope), math.ceil(m - slope * (n - i)))
        hi = min(m, math.floor(slope * i), math.floor(m - (n - i) / slope))
    return lo, hi


def dtw_costs(a: np.ndarray, b: np.ndarray, window: int | None = None, slope: float | None = None, abandon: float | None = None) -> np.ndarray | None:
    """The table of warping costs, unreached cells at BIG; None if a row of the band is empty or all above ``abandon``."""
    n, m = len(a), len(b)
    cost = np.full((n + 1, m + 1), BIG)
    cost[0, 0] = 0.0
    for i in range(1, n + 1):
        lo, hi = band(i, n, m, window, slope)
        if lo > hi:
            return None
        d = np.sqrt(np.nansum((a[i - 1] - b[lo - 1 : hi]) ** 2, axis=1))
        above = np.minimum(cost[i - 1, lo : hi + 1], cost[i - 1, lo - 1 : hi])
        left, row = cost[i, lo - 1], cost[i]
        for j in range(hi - lo + 1):
            left = d[j] + min(left, above[j])
            row[lo + j] = left
        if abandon is not None and row[lo : hi + 1].min() > abandon:
            return None
    return cost


def dtw_score(a: np.ndarray, b: np.ndarray, window: int | None = None, slope: float | None = None, abandon: float | None = None) -> float:
    """1 / (1 + cost / longer length); two empty sequences are 1, one empty is 0."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    cost = dtw_costs(a, b, window, slope, abandon)
    return 0.0 if cost is None else 1 / (1 + cost[-1, -1] / max(len(a), len(b)))


def dtw_scores(q: np.ndarray, cases: Sequence[np.ndarray], window: int | None = None, slope: float | None = None, abandon: float | None = None) -> np.ndarray:
    """``dtw_score`` of one sequence to many: every anti-diagonal of all tables at once."""
    n, m = len(q), np.array([len(c) for c in cases], np.int64)
    out = ((m == 0) & (n == 0)).astype(float)
    live = np.flatnonzero(m > 0) if n else np.zeros(0, np.int64)
    most = max(1, 4_000_000 // ((n + 1) * max(1, q.shape[1] if q.ndim > 1 else 1)))
    for a in range(0, len(live), most):
        chosen = live[a : a + most]
        out[chosen] = _dtw_block(q, [cases[i] for i in chosen.tolist()], m[chosen], window, slope, abandon)
    return out


def _dtw_block(q: np.ndarray, cases: list[np.ndarray], m: np.ndarray, window: int | None, slope: float | None, abandon: float | None) -> np.ndarray:
    n, rows, longest = len(q), len(cases), int(m.max())
    wide = np.zeros((rows, longest, q.shape[1]))
    for r, c in enumerate(cases):
        wide[r, : len(c)] = c
    i = np.arange(n + 1)[None, :]
    size = m[:, None]
    lo, hi = np.ones((rows, n + 1), np.int64), np.repeat(size, n + 1, 1)
    if window is not None:
        w = np.maximum(window, np.abs(n - size))
        lo, hi = np.maximum(1, i - w), np.minimum(size, i + w)
    elif slope is not None:
        lo = np.maximum(1, np.maximum(np.ceil(i / slope), np.ceil(size - slope * (n - i)))).astype(np.int64)
        hi = np.minimum(size, np.minimum(np.floor(slope * i), np.floor(size - (n - i) / slope))).astype(np.int64)
    before = np.full((rows, n + 1), BIG)  # the last diagonal but one, by row of the table
    before[:, 0] = 0.0
    last = np.full((rows, n + 1), BIG)
    least = np.full((rows, n + 1), np.inf)  # of each row of the table
    final = np.full(rows, BIG)
    for d in range(2, n + longest + 1):
        first, end = max(1, d - longest), min(n, d - 1)
        at = np.arange(first, end + 1)
        j = d - at
        gap = np.sqrt(np.nansum((q[at - 1][None] - wide[:, j - 1]) ** 2, axis=2))
        inside = (j >= lo[:, at]) & (j <= hi[:, at])
        now = np.full((rows, n + 1), BIG)
        best = np.minimum(np.minimum(last[:, at - 1], last[:, at]), before[:, at - 1])
        now[:, at] = np.where(inside, gap + best, BIG)
        least[:, at] = np.minimum(least[:, at], np.where(inside, now[:, at], np.inf))
        if end == n:
            done = m == d - n
            final[done] = now[done, n]
        before, last = last, now
    score = 1 / (1 + final / np.maximum(n, m))
    stopped = (lo > hi)[:, 1:].any(1)
    if abandon is not None:
        stopped |= (least[:, 1:] > abandon).any(1)
    score[stopped] = 0.0
    return score


def dtw_path(a: np.ndarray, b: np.ndarray, window: int | None = None, slope: float | None = None) -> list[tuple[int, int]]:
    """The pairs of an optimal warping, from 0; going back, diagonal steps come first, then up."""
    if not len(a) or not len(b) or (cost := dtw_costs(a, b, window, slope)) is None:
        return []
    i, j, out = len(a), len(b), []
    while i > 0 and j > 0:
        out.append((i - 1, j - 1))
        steps = [(cost[i - 1, j - 1], 0), (cost[i - 1, j], 1), (cost[i, j - 1], 2)]
        step = min(steps)[1]
        i, j = i - (step != 2), j - (step != 1)
    return out[::-1]


def dtw(query: list[Mapping[str, Any]], case: Column, series: S.TimeSeries, abandon: float | None = None) -> Column:
    """DTW similarity of a query series to a column of series (array of structs)."""
    fields = scorable(series)
    q = to_matrix(query, fields)
    # Values by the widths of their ranges, field after field: plain arrays of doubles go to the kernel.
    def scaled(f: S.Numeric) -> Column:
        return F.transform(case, lambda o: o[f.name].cast("double") / (f.high - f.low) if f.high > f.low else F.lit(0.0))

    @F.pandas_udf("double")
    def kernel(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            known = rows.notna().to_numpy()
            out = np.full(len(rows), np.nan)
            out[known] = dtw_scores(q, [np.array([np.asarray(x, float) for x in r]).T for r in rows[known]], series.band, series.slope, abandon)
            yield pd.Series(out).where(known, None)

    return kernel(F.when(case.isNotNull(), F.array(*map(scaled, fields))))


def dtw_alignment(query: list[Mapping[str, Any]], case: Column, series: S.TimeSeries) -> Column:
    """array<struct<i, j>>: the warping of the query to each series."""
    fields = scorable(series)
    q = to_matrix(query, fields)

    @F.pandas_udf("array<struct<i:int,j:int>>")
    def kernel(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            yield rows.map(lambda r: None if r is None else [{"i": i, "j": j} for i, j in dtw_path(q, to_matrix(r, fields), series.band, series.slope)])

    return kernel(case)


def lower_bound(query: list[float], case: Column, window: int, width: float) -> Column:
    """A lower bound of the banded DTW cost of one numeric field, by the envelope of the case: cheap enough to filter by.

    It may prune only where the whole score depends on this one series.
    """
    q = F.lit([v / width for v in query])
    k = F.least(F.size(q), F.size(case))
    of = lambda i: F.slice(case, F.greatest(i + 1 - window, F.lit(1)), F.least(i + 1, F.lit(window + 1)) + window)
    ends = F.transform(case, lambda _, i: F.struct((F.array_max(of(i)) / width).alias("u"), (F.array_min(of(i)) / width).alias("l")))
    gaps = F.zip_with(F.slice(ends, 1, k), F.slice(q, 1, k), lambda e, x: F.greatest(x - e["u"], e["l"] - x, F.lit(0.0)))
    return F.when(F.size(case) == 0, 0.0).otherwise(F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x))


def _likeness(table: Mapping[tuple[str, str], float] | None):
    pairs = {**{(b, a): v for (a, b), v in (table or {}).items()}, **(table or {})}
    return lambda a, b: 1.0 if a == b else float(pairs.get((a, b), 0.0))


def edit_costs(a: Sequence[str], b: Sequence[str], costs: tuple[float, float] = (1.0, 1.0), table: Mapping | None = None) -> np.ndarray:
    insert, delete = costs
    like = _likeness(table)
    n, m = len(a), len(b)
    cost = np.zeros((n + 1, m + 1))
    cost[:, 0] = np.arange(n + 1) * delete
    cost[0, :] = np.arange(m + 1) * insert
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            cost[i, j] = min(cost[i - 1, j - 1] + 1 - like(a[i - 1], b[j - 1]), cost[i - 1, j] + delete, cost[i, j - 1] + insert)
    return cost


def edit_score(a: Sequence[str], b: Sequence[str], costs: tuple[float, float] = (1.0, 1.0), table: Mapping | None = None) -> float:
    """1 - cost / the most it can be; two empty sequences are 1."""
    n, m = len(a), len(b)
    if not n and not m:
        return 1.0
    insert, delete = costs
    most = min(n, m) + (n - m) * delete * (n > m) + (m - n) * insert * (m > n) if insert + delete >= 1 else n * delete + m * insert
    return max(0.0, 1 - edit_costs(a, b, costs, table)[-1, -1] / most) if most else 1.0


def edit_ops(a: Sequence[str], b: Sequence[str], costs: tuple[float, float] = (1.0, 1.0), table: Mapping | None = None) -> list[dict[str, Any]]:
    """MATCH, SUBSTITUTE, DELETE and INSERT steps that turn a into b, in order; positions from 0, -1 where there is none."""
    cost, like = edit_costs(a, b, costs, table), _likeness(table)
    i, j, out = len(a), len(b), []
    while i or j:
        if i and j and math.isclose(cost[i, j], cost[i - 1, j - 1] + 1 - like(a[i - 1], b[j - 1])):
            i, j = i - 1, j - 1
            out.append({"op": "MATCH" if a[i] == b[j] else "SUBSTITUTE", "i": i, "j": j})
        elif i and math.isclose(cost[i, j], cost[i - 1, j] + costs[1]):
            i -= 1
            out.append({"op": "DELETE", "i": i, "j": -1})
        else:
            j -= 1
            out.append({"op": "INSERT", "i": -1, "j": j})
    return out[::-1]


def edit_scores(a: Sequence[str], cases: Sequence[Sequence[str]], costs: tuple[float, float] = (1.0, 1.0), table: Mapping | None = None) -> np.ndarray:
    """``edit_score`` of one sequence to many: every cell of all tables at once."""
    insert, delete = costs
    like = _likeness(table)
    n, m = len(a), np.array([len(c) for c in cases], np.int64)
    if not len(cases):
        return np.zeros(0)
    labels = sorted({x for c in cases for x in c})
    code = {x: k for k, x in enumerate(labels)}
    likes = np.array([[like(x, y) for y in labels] + [0.0] for x in a]).reshape(n, len(labels) + 1)
    wide = np.full((len(cases), int(m.max())), len(labels))
    for r, c in enumerate(cases):
        wide[r, : len(c)] = [code[x] for x in c]
    cost = np.repeat(np.arange(wide.shape[1] + 1)[None, :] * insert, len(cases), 0).astype(float)
    for i in range(1, n + 1):
        above = cost
        cost = np.empty_like(above)
        cost[:, 0] = i * delete
        step = np.minimum(above[:, :-1] + 1 - likes[i - 1][wide], above[:, 1:] + delete)
        for j in range(1, wide.shape[1] + 1):
            cost[:, j] = np.minimum(step[:, j - 1], cost[:, j - 1] + insert)
    final = cost[np.arange(len(cases)), m]
    if insert + delete >= 1:
        most = np.minimum(n, m) + np.maximum(n - m, 0) * delete + np.maximum(m - n, 0) * insert
    else:
        most = n * delete + m * insert
    return np.where(most > 0, np.maximum(0.0, 1 - final / np.where(most > 0, most, 1)), 1.0)


#: A private character for each label of a query, and one for all labels that it does not have.
FIRST_MARK, OTHER_MARK = 0xE000, "\uf8ff"


def edit(query: list[str], case: Column, costs: tuple[float, float] = (1.0, 1.0), table: Mapping | None = None) -> Column:
    """Edit similarity of a query sequence to a column of label lists: Levenshtein's distance as an expression where
    all costs are 1, else by the kernel."""
    known = sorted(set(query))
    if costs == (1.0, 1.0) and not table and len(known) < 6000:
        marks = {x: chr(FIRST_MARK + k) for k, x in enumerate(known)}
        marked = F.transform(case, lambda x: F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for pair in marks.items() for v in pair]), x), F.lit(OTHER_MARK)) if marks else F.lit(OTHER_MARK))
        longest = F.greatest(F.size(case), F.lit(len(query)))
        distance = F.levenshtein(F.lit("".join(marks[x] for x in query)), F.array_join(marked, ""))
        return F.when(case.isNull(), None).when(longest == 0, 1.0).otherwise(1 - distance / longest)

    @F.pandas_udf("double")
    def kernel(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            there = rows.notna().to_numpy()
            out = np.full(len(rows), np.nan)
            out[there] = edit_scores(query, [list(r) for r in rows[there]], costs, table)
            yield pd.Series(out).where(there, None)

    return kernel(case)


def edit_script(query: list[str], case: Column, costs: tuple[float, float] = (1.0, 1.0), table: Mapping | None = None) -> Column:
    """array<struct<op, i, j>>: the steps from the query to each case."""

    @F.pandas_udf("array<struct<op:string,i:int,j:int>>")
    def kernel(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            yield rows.map(lambda r: None if r is None else edit_ops(query, list(r), costs, table))

    return kernel(case)
