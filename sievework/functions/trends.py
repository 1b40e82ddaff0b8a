"""Trend features of a time series: an array of structs ordered by its time field."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KINDS = ("slope", "delta", "volatility", "acceleration", "change_points", "duration", "count")


def _moments(t: Column, v: Column) -> Column:
    """One pass: n and the sums that a regression needs, of both series less their first values."""
    zero = F.lit(0.0)
    start = F.struct(zero.alias("n"), zero.alias("t0"), zero.alias("v0"), zero.alias("t"), zero.alias("v"), zero.alias("tt"), zero.alias("tv"), zero.alias("vv"))

    def step(s: Column, o: Column) -> Column:
        first = s["n"] == 0
        t0, v0 = F.when(first, o["t"]).otherwise(s["t0"]), F.when(first, o["v"]).otherwise(s["v0"])
        dt, dv = o["t"] - t0, o["v"] - v0
        return F.struct((s["n"] + 1).alias("n"), t0.alias("t0"), v0.alias("v0"), (s["t"] + dt).alias("t"), (s["v"] + dv).alias("v"), (s["tt"] + dt * dt).alias("tt"), (s["tv"] + dt * dv).alias("tv"), (s["vv"] + dv * dv).alias("vv"))

    pairs = F.zip_with(t, v, lambda x, y: F.struct(x.alias("t"), y.alias("v")))
    return F.aggregate(pairs, start, step)


def field(series: Column | str, name: str) -> Column:
    """A field of every observation as double; missing values read as 0."""
    s = F.col(series) if isinstance(series, str) else series
    return F.transform(s, lambda o: F.coalesce(o[name].cast("double"), F.lit(0.0)))


def slope(t: Column, v: Column) -> Column:
    """Least-squares slope; 0 for fewer than two values or times without spread."""
    zero = F.lit(0.0)
    start = F.struct(zero.alias("n"), zero.alias("t0"), zero.alias("v0"), zero.alias("t"), zero.alias("v"), zero.alias("tt"), zero.alias("tv"), zero.alias("vv"))

    def finish(s: Column) -> Column:
        sxx = s["tt"] - s["t"] * s["t"] / s["n"]
        return F.when((s["n"] < 2) | (sxx <= 0), 0.0).otherwise((s["tv"] - s["t"] * s["v"] / s["n"]) / sxx)

    return F.coalesce(F.aggregate(F.array(_moments(t, v)), start, lambda _, m: m, finish), zero)


def delta(v: Column) -> Column:
    return F.when(F.size(v) == 0, 0.0).otherwise(F.try_element_at(v, F.lit(-1)) - F.try_element_at(v, F.lit(1)))


def volatility(v: Column) -> Column:
    """Population standard deviation."""
    return _spread(v)["sd"]


def _spread(v: Column) -> Column:
    """struct<mean, sd> in one pass."""
    zero = F.lit(0.0)
    start = F.struct(zero.alias("n"), zero.alias("v0"), zero.alias("v"), zero.alias("vv"))

    def step(s: Column, x: Column) -> Column:
        v0 = F.when(s["n"] == 0, x).otherwise(s["v0"])
        return F.struct((s["n"] + 1).alias("n"), v0.alias("v0"), (s["v"] + (x - v0)).alias("v"), (s["vv"] + (x - v0) * (x - v0)).alias("vv"))

    def finish(s: Column) -> Column:
        n = F.greatest(s["n"], F.lit(1.0))
        return F.struct((s["v0"] + s["v"] / n).alias("mean"), F.sqrt(F.greatest(s["vv"] / n - (s["v"] / n) * (s["v"] / n), zero)).alias("sd"))

    return F.aggregate(v, start, step, finish)


def acceleration(t: Column, v: Column) -> Column:
    """Change of slope between the halves (cut at n // 2) by the distance of their mid times; 0 for n < 4."""
    n = F.size(t)
    h = F.floor(n / 2).cast("int")
    t1, v1, t2, v2 = F.slice(t, 1, h), F.slice(v, 1, h), F.slice(t, h + 1, n - h), F.slice(v, h + 1, n - h)
    mid = lambda x: (F.try_element_at(x, F.lit(1)) + F.try_element_at(x, F.lit(-1))) / 2
    gap = mid(t2) - mid(t1)
    return F.when((n < 4) | (gap == 0), 0.0).otherwise((slope(t2, v2) - slope(t1, v1)) / gap)


def change_points(v: Column, sigmas: float = 1.5) -> Column:
    """Alarms of a two-sided CUSUM around the mean with threshold 1.5 sigma, reset at each; 0 for n < 3 or sigma 0."""
    start = F.struct(_spread(v).alias("of"), F.lit(0.0).alias("up"), F.lit(0.0).alias("down"), F.lit(0).alias("n"), F.lit(0).alias("seen"))

    def step(s: Column, x: Column) -> Column:
        d = x - s["of"]["mean"]
        up, down = F.greatest(F.lit(0.0), s["up"] + d), F.greatest(F.lit(0.0), s["down"] - d)
        most = sigmas * s["of"]["sd"]
        alarm = (up > most) | (down > most)
        return F.struct(s["of"].alias("of"), F.when(alarm, 0.0).otherwise(up).alias("up"), F.when(alarm, 0.0).otherwise(down).alias("down"), (s["n"] + alarm.cast("int")).alias("n"), (s["seen"] + 1).alias("seen"))

    return F.aggregate(v, start, step, lambda s: F.when((s["seen"] < 3) | (s["of"]["sd"] == 0), 0).otherwise(s["n"]))


def duration(t: Column) -> Column:
    return F.when(F.size(t) == 0, 0.0).otherwise(F.try_element_at(t, F.lit(-1)) - F.try_element_at(t, F.lit(1)))


def trend(kind: str, t: Column, v: Column) -> Column:
    return {
        "slope": lambda: slope(t, v),
        "delta": lambda: delta(v),
        "volatility": lambda: volatility(v),
        "acceleration": lambda: acceleration(t, v),
        "change_points": lambda: change_points(v).cast("double"),
        "duration": lambda: duration(t),
        "count": lambda: F.size(t).cast("double"),
    }[kind]()
