"""Offline evaluation: precision, accuracy, latency, windowed features, splits, rule labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def judged(retrieved: DataFrame, judgements: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Retrieved rows with their judgement, 0 where there is none."""
    return retrieved.join(judgements, list(keys), "left").withColumn("judgement", F.coalesce("judgement", F.lit(0)))


def precision(df: DataFrame, by: Sequence[str], threshold: float = 1) -> DataFrame:
    """Share of rows with a judgement from the threshold up."""
    return df.groupBy(*by).agg(F.avg((F.col("judgement") >= threshold).cast("double")).alias("precision"))


def by_failure_mode(df: DataFrame, modes: str = "modes") -> DataFrame:
    """Mean precision of each mode; a scenario may have several."""
    return df.select(F.explode(modes).alias("mode"), "precision").groupBy("mode").agg(F.avg("precision").alias("precision"), F.count(F.lit(1)).alias("scenarios"))


def accuracy(df: DataFrame, ranked: str = "ranked", label: str = "label", k: int = 3, by: Sequence[str] = ()) -> DataFrame:
    """Top-1 and top-k accuracy of ranked label lists."""
    hit = lambda n: F.avg(F.array_contains(F.slice(ranked, 1, n), F.col(label)).cast("double"))
    return df.groupBy(*by).agg(hit(1).alias("top_1"), hit(k).alias("top_k"), F.count(F.lit(1)).alias("n"))


def latency(df: DataFrame, value: str) -> DataFrame:
    """p50, p95, p99 and mean."""
    p = F.percentile(value, F.lit([0.5, 0.95, 0.99]))
    return df.agg(p.alias("p"), F.avg(value).alias("mean")).select(F.col("p")[0].alias("p50"), F.col("p")[1].alias("p95"), F.col("p")[2].alias("p99"), "mean")


def window_features(df: DataFrame, key: str, second: str, own: Sequence[str], masked: Sequence[str], visible: str, width: int = 30, windows: int = 10) -> DataFrame:
    """For each key and window of ``width`` seconds: means of own values, means of the other side's values over the
    seconds when they were visible, whether any was; windows without rows are zero, ``windows`` in all."""
    w = F.floor(F.col(second) / width).cast("int").alias("window")
    means = [F.avg(c).alias(c) for c in own] + [F.coalesce(F.avg(F.when(F.col(visible), F.col(c))), F.lit(0.0)).alias(c) for c in masked]
    found = df.where(F.col(second) < width * windows).groupBy(key, w).agg(*means, F.max(F.col(visible).cast("int")).alias("seen"))
    grid = df.select(key).distinct().withColumn("window", F.explode(F.sequence(F.lit(0), F.lit(windows - 1))))
    return grid.join(found, [key, "window"], "left").fillna(0, [*own, *masked, "seen"])


def ever_seen(df: DataFrame, key: str, second: str, visit: Column) -> DataFrame:
    """A visibility mask that stays once it is set."""
    w = Window.partitionBy(key).orderBy(second).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("visible", F.max(visit.cast("int")).over(w) == 1)


#: Seconds of a scout's arrival, of its first and later stays and between them; the share that it sees at
#: first, and what each return adds. Each is a range, the upper end left out.
ARRIVAL, FIRST_STAY, STAY, PAUSE = (90, 150), (15, 30), (10, 25), (40, 80)
SEEN_FIRST, SEEN_MORE = (0.3, 0.5), (0.1, 0.2)


def scouting_visibility(key: Column | str, second: Column | str, seed: int = 0, visits: int = 64) -> Column:
    """How much of the other side is known at a second, 0 to 1: nothing before a scout's arrival, a part from then on,
    more with each of its returns (``visits`` at most). Drawn by seeded hashes of the key; it never falls."""
    k, t = (F.col(c) if isinstance(c, str) else c for c in (key, second))
    share = lambda i: F.pmod(F.xxhash64(k, F.lit(seed), i), F.lit(1 << 30)) / float(1 << 30)
    between = lambda r, i: F.floor(r[0] + share(i) * (r[1] - r[0])).cast("double")
    scale = lambda r, i: r[0] + share(i) * (r[1] - r[0])
    arrival = between(ARRIVAL, F.lit(0))
    start = F.struct((arrival + between(FIRST_STAY, F.lit(1))).alias("at"), F.lit(0).alias("n"))

    def visit(s: Column, i: Column) -> Column:
        back = s["at"] + between(PAUSE, 2 * i + 4)
        return F.struct((back + between(STAY, 2 * i + 5)).alias("at"), (s["n"] + (back <= t).cast("int")).alias("n"))

    returns = F.aggregate(F.sequence(F.lit(0), F.lit(visits - 1)), start, visit)["n"]
    return F.when(t < arrival, 0.0).otherwise(F.least(F.lit(1.0), scale(SEEN_FIRST, F.lit(2)) + scale(SEEN_MORE, F.lit(3)) * returns))


def build_order(df: DataFrame, key: str, json_col: str, player: int) -> DataFrame:
    """(key, second, name): the player's building events of a JSON array, in order of time."""
    kind = "array<struct<player:int,second:double,name:string>>"
    return df.select(key, F.inline(F.from_json(json_col, kind))).where(F.col("player") == player).select(key, "second", "name").orderBy(key, "second", "name")


def rule_labels(orders: DataFrame, key: str, rules: Sequence[tuple[str, Column]], facts: Sequence[Column]) -> DataFrame:
    """(key, facts, label): facts are aggregates over a build order (see first_time, count_before); the first rule that
    holds gives the label."""
    label = F.lit(None).cast("string")
    for name, condition in reversed(rules):
        label = F.when(condition, name).otherwise(label)
    return orders.groupBy(key).agg(*facts).withColumn("label", label)


def first_time(name: str) -> Column:
    return F.min(F.when(F.col("name") == name, F.col("second")))


def count_before(name: str, second: float) -> Column:
    return F.count_if((F.col("name") == name) & (F.col("second") < second))


def cascade(rule: Column, other: Column, confidence: Column, least: float = 0.6) -> Column:
    """The rule's label, else another's if it is sure enough."""
    return F.coalesce(rule, F.when(confidence >= least, other))


def stratified_split(df: DataFrame, label: str, key: str, seed: int = 42, shares: tuple[float, float, float] = (0.7, 0.1, 0.2), buckets: int = 4096) -> DataFrame:
    """With ``part`` train, validate or test: exact shares within each label, by the rank of a seeded hash of the key.

    Ranks are counted in ``buckets`` of the hash, so that no label is sorted in one place.
    """
    h = F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")))
    rows = df.withColumn("_h", h).withColumn("_b", F.floor(F.conv(F.substring("_h", 1, 6), 16, 10).cast("long") * buckets / (1 << 24)).cast("int"))
    counts = rows.groupBy(F.col(label).alias("_l"), "_b").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy("_l").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # a row for each bucket
    counts = counts.select("_l", "_b", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_base"), F.sum("_c").over(Window.partitionBy("_l")).alias("_n"))
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy(label, "_b").orderBy("_h", key)) - 1)
    share = (F.col("_base") + F.col("_r")) / F.col("_n")
    out = ranked.withColumnRenamed("_b", "_own").join(counts, F.col(label).eqNullSafe(F.col("_l")) & (F.col("_own") == F.col("_b")))
    part = F.when(share < shares[0], "train").when(share < shares[0] + shares[1], "validate").otherwise("test")
    return out.withColumn("part", part).select(*df.columns, "part")


def unit_counts(events: DataFrame, key: str, order: Sequence[str], unit: str, change: str) -> DataFrame:
    """Running number of each unit after +1 and -1 events, never below 0: the running sum less its least value so far
    when that is negative."""
    w = Window.partitionBy(key, unit).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = events.withColumn("_sum", F.sum(change).over(w))
    return summed.withColumn("count", F.col("_sum") - F.least(F.lit(0), F.min("_sum").over(w))).drop("_sum")


def carried_forward(df: DataFrame, key: str, order: str, columns: Sequence[str]) -> DataFrame:
    """Missing values take the last known one."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def pair_gap(df: DataFrame, related: str = "related", score: str = "score", by: Sequence[str] = ()) -> DataFrame:
    """Mean score of related pairs less that of unrelated ones."""
    return df.groupBy(*by).agg((F.avg(F.when(F.col(related), F.col(score))) - F.avg(F.when(~F.col(related), F.col(score)))).alias("gap"))


def tokens_per_identifier(df: DataFrame, tokens: str = "tokens") -> DataFrame:
    return df.agg(F.avg(F.size(tokens)).alias("mean_tokens"), F.avg((F.size(tokens) == 1).cast("double")).alias("whole"))


def encoded(df: DataFrame, key: str, catalogue: dict[str, Sequence[float]], default: Sequence[float], name: str = "features") -> DataFrame:
    """With a feature vector looked up by a key; an unknown key gets the default."""
    table = F.create_map(*[x for k, v in catalogue.items() for x in (F.lit(k), F.lit([float(a) for a in v]))])
    return df.withColumn(name, F.coalesce(F.try_element_at(table, F.col(key)), F.lit([float(a) for a in default])))
