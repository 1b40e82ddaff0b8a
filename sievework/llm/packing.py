"""Best-fit packing of token pieces into sequences of fixed capacity.

Everything that depends on the number of rows is a histogram of piece lengths (at most ``capacity`` rows). The driver
solves the configuration linear program over it - how many sequences to fill with which multiset of lengths - by
multiplicative weights: a length's weight shrinks as its demand is covered, and a knapsack dynamic program over the
room prices, for the current weights, the best configuration with each open length. The fractional solution is rounded
up as far as pieces last, the program is solved again for the pieces that are left, and what remains is packed best
fit decreasing, whole groups of equal sequences at a time. Configurations are at most a few times the capacity and
rounds in number, whatever the number of rows. Executors then give the i-th piece of a length the i-th place that the
configurations hold for that length.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from sievework.llm.common import by_slices, partitions, texts
from sievework.llm.wordids import encode_column
from sievework.session import materialise

Pattern = tuple[tuple[int, int], ...]  # (length, copies), longest first


class Plan(NamedTuple):
    """rounds of the LP (each prices a configuration for every length), how fast weights shrink, the most room that a
    rounded configuration may leave, and how often the program is solved again for the pieces that are left."""

    rounds: int
    rate: float
    waste: int
    phases: int


#: Of these the one with the fewest sequences is taken, the earlier of equals.
PLANS = (Plan(24, 1.0, 0, 5), Plan(12, 4.0, 2048, 2))
ALONE = Plan(0, 1.0, 0, 0)  # no program: best fit decreasing


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end: int | None = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Per piece: doc_id, piece int, start long, length long, ids_crc32 long and, if asked for, ids array<int>.

    A document's ids are those of its whole text (null: empty) and ``end``; only longer ones are cut, into pieces of
    ``capacity`` ids, the last of which may be shorter. A document without ids (no end id, empty text) has no piece.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, counts = encode_column(batch.column(0), tokenizer, end)
        pieces = -(-counts // capacity)
        row = np.repeat(np.arange(len(counts)), pieces)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = piece * capacity
        length = np.minimum(counts[row] - start, capacity)
        cuts = np.concatenate([[0], np.cumsum(length)])  # pieces follow one another as the ids do
        data = memoryview(ids.tobytes())
        crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False)]
        columns = [batch.column(1).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
        if with_ids:
            columns.append(pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(ids.astype(np.int32))))
        return pa.record_batch(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return texts(docs, id_col, text_col).select("text", "doc_id").mapInArrow(by_slices(run, limit=4 << 20, keeps=["words"]), schema)


def price(lengths: np.ndarray, weights: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The knapsack dynamic program over the room: the greatest weight that fits each room, and the length (its place)
    to put there first, -1 where none fits."""
    value = np.zeros(capacity + 1)  # of each room, the largest first, so that what a length leaves is a plain slice
    choice = np.full(capacity + 1, -1)
    shortest, longest = int(lengths[0]), int(lengths[-1])
    every = np.full(longest - shortest + 1, -np.inf)
    every[lengths - shortest] = weights
    place = np.full(longest - shortest + 1, -1)
    place[lengths - shortest] = np.arange(len(lengths))
    for room in range(shortest, capacity + 1):
        at, most = capacity - room, min(room, longest)
        total = value[at + shortest : at + most + 1] + every[: most - shortest + 1]
        best = total.argmax()
        if total[best] > value[at + 1]:
            value[at], choice[room] = total[best], place[best]
        else:
            value[at], choice[room] = value[at + 1], choice[room - 1]
    return value[::-1], choice


def columns(lengths: np.ndarray, weights: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every length the best configuration that holds it, from one run of the dynamic program: triples (column,
    place of a length, copies); column i is that of length i."""
    _, choice = price(lengths, weights, capacity)
    column = np.arange(len(lengths))
    room = capacity - lengths
    owner, held = [column], [column]
    while True:
        first = choice[room]
        live = first >= 0
        column, first = column[live], first[live]
        if not len(column):
            break
        owner.append(column)
        held.append(first)
        room = room[live] - lengths[first]
    pair, copies = np.unique(np.concatenate(owner) * len(lengths) + np.concatenate(held), return_counts=True)
    return pair // len(lengths), pair % len(lengths), copies


def configuration_lp(lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int, rate: float) -> dict[Pattern, float]:
    """An approximate solution of the configuration LP: the number of sequences of each configuration.

    In every round the weights of the lengths shrink with what is covered of their demand, one dynamic program prices
    the best configuration for each length that is still open, and each of these gets a share of that length's open
    demand, less where several of them want the same length. No demand is covered more than once.
    """
    covered = np.zeros(len(lengths))
    found: dict[Pattern, float] = defaultdict(float)
    base = (lengths / capacity) ** 1.05
    for left in range(rounds, 0, -1):
        open_ = np.flatnonzero(covered < 1 - 1e-9)
        if not len(open_):
            break
        weights = base[open_] * np.exp(-rate * covered[open_])
        column, place, copies = columns(lengths[open_], weights, capacity)
        still = (counts * (1 - covered))[open_]
        whole = np.ones(len(open_), bool)  # a configuration with more copies than there are pieces is no use
        whole[column[copies > counts[open_][place]]] = False
        step = still / np.maximum(1, np.bincount(column[column == place], copies[column == place], len(open_))) / left * whole
        for _ in range(2):
            used = np.bincount(place, copies * step[column], len(open_))
            scale = np.ones(len(open_))
            np.minimum.at(scale, column, np.minimum(1, still / np.maximum(used, 1e-12))[place])
            step *= scale
        covered[open_] += np.bincount(place, copies * step[column], len(open_)) / counts[open_]
        cuts = np.searchsorted(column, np.arange(len(open_) + 1))
        size, times = lengths[open_][place].tolist(), copies.tolist()
        for i in np.flatnonzero(step > 1e-9).tolist():
            a, b = cuts[i], cuts[i + 1]
            found[tuple(zip(size[a:b][::-1], times[a:b][::-1], strict=True))] += float(step[i])
    return found


def rounded(solution: dict[Pattern, float], rest: dict[int, int], room: int) -> list[tuple[Pattern, int]]:
    """Whole sequences from the LP's solution: each configuration that fills ``room`` at least, those of the greatest
    number first, is rounded up as far as the pieces last. Takes them out of ``rest``."""
    out = []
    order = [(pattern, x) for pattern, x in solution.items() if sum(a * b for a, b in pattern) >= room]
    for pattern, x in sorted(order, key=lambda p: (-p[1], tuple((-a, b) for a, b in p[0]))):
        n = min(math.ceil(x - 1e-6), *(rest[length] // copies for length, copies in pattern))
        if n > 0:
            for length, copies in pattern:
                rest[length] -= n * copies
            out.append((pattern, n))
    return out


def best_fit_decreasing(rest: dict[int, int], groups: dict[int, list[tuple[Pattern, int]]], capacity: int) -> dict[int, list[tuple[Pattern, int]]]:
    """Place counted lengths, longest first, each where the least room is left; equal sequences move as one group.

    groups: by the room left, the open configurations and their numbers.
    """
    room_left = np.zeros(capacity + 1, bool)
    for room, held in groups.items():
        room_left[room] = bool(held)
    for length in sorted(rest, reverse=True):
        n = rest[length]
        while n:
            fits = np.flatnonzero(room_left[length:])
            if not len(fits):
                per = capacity // length
                groups.setdefault(capacity, []).append(((), max(1, n // per)))
                room_left[capacity] = True
                fits = np.array([capacity - length])
            room = int(fits[0]) + length
            pattern, bins = groups[room].pop()
            copies = min(room // length, max(1, n // bins)) if bins <= n else 1
            used = min(bins, n // copies)
            if used < bins:
                groups[room].append((pattern, bins - used))
            room_left[room] = bool(groups[room])
            left = room - copies * length
            groups.setdefault(left, []).append((add(pattern, length, copies), used))
            room_left[left] = True
            n -= used * copies
    return groups


def add(pattern: Pattern, length: int, copies: int) -> Pattern:
    held = dict(pattern)
    held[length] = held.get(length, 0) + copies
    return tuple(sorted(held.items(), reverse=True))


def solve(histogram: dict[int, int], capacity: int, plans: tuple[Plan, ...] = PLANS) -> list[tuple[Pattern, int]]:
    """Configurations and how many sequences get each; together they hold every length exactly as often as counted.

    The program is solved and rounded, then again for the pieces that are left, and what remains in the end is packed
    best fit decreasing. If best fit decreasing alone needs fewer sequences than all ``plans``, its result is taken.
    """
    found = [fill(histogram, capacity, plan)[0] for plan in (*plans, ALONE)]
    return sorted(min(found, key=lambda out: sum(out.values())).items(), key=lambda p: (-p[1], p[0]))


def fill(histogram: dict[int, int], capacity: int, plan: Plan) -> tuple[dict[Pattern, int], int]:
    """Configurations and their numbers, and how many sequences rounded configurations began."""
    rest = {length: n for length, n in histogram.items() if n}
    out: dict[Pattern, int] = defaultdict(int)
    if full := rest.pop(capacity, 0):
        out[((capacity, 1),)] = full
    groups: dict[int, list[tuple[Pattern, int]]] = defaultdict(list)
    for _ in range(plan.phases):
        if not rest:
            break
        lengths = np.array(sorted(rest))
        counts = np.array([rest[x] for x in lengths.tolist()], float)
        for pattern, n in rounded(configuration_lp(lengths, counts, capacity, plan.rounds, plan.rate), rest, capacity - plan.waste):
            groups[capacity - sum(length * copies for length, copies in pattern)].append((pattern, n))
        rest = {length: n for length, n in rest.items() if n}
    begun = sum(n for held in groups.values() for _, n in held)
    for held in best_fit_decreasing(rest, groups, capacity).values():
        for pattern, n in held:
            if pattern and n:
                out[pattern] += n
    return out, begun


@dataclass
class Places:
    """For each length and configuration: the first place's number among all places of the length, and where it is."""

    key: np.ndarray  # length << 40 | first number
    sequence: np.ndarray
    copies: np.ndarray
    offset: np.ndarray
    length: np.ndarray

    @classmethod
    def of(cls, solution: list[tuple[Pattern, int]]) -> Places:
        rows, taken, sequence = [], defaultdict(int), 0
        for pattern, n in solution:
            offset = 0
            for length, copies in pattern:
                rows.append((length << 40 | taken[length], sequence, copies, offset, length))
                taken[length] += n * copies
                offset += length * copies
            sequence += n
        return cls(*np.array(sorted(rows), np.int64).reshape(-1, 5).T)

    def place(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sequence and the offset of the ``number``-th piece of each length."""
        at = np.searchsorted(self.key, length << 40 | number, side="right") - 1
        repeat, copy = np.divmod(number - (self.key[at] & ((1 << 40) - 1)), self.copies[at])
        return self.sequence[at] + repeat, self.offset[at] + copy * self.length[at]


def pack(pieces: DataFrame, capacity: int = 2048, length_col: str = "length", order: tuple[str, ...] = ("doc_id", "piece"), plans: tuple[Plan, ...] = PLANS) -> DataFrame:
    """All columns of ``pieces`` and sequence_id, offset: every piece in one sequence, sequences without gaps.

    ``pieces`` must give the same rows whenever it is read (a written table); lengths are 1 ... capacity. Pieces of
    one length are numbered by salted groups, so that a length which many pieces share is spread over all tasks.
    Repeated rows are pieces of their own. An empty table gives an empty result.
    """
    spark = pieces.sparkSession
    salts = partitions(spark)
    salted = pieces.withColumn("_length", F.col(length_col).cast("long")).withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    counts = materialise(salted.groupBy("_length", "_salt").agg(F.count(F.lit(1)).alias("_n")), "packing-counts")
    histogram = {r["_length"]: r["n"] for r in counts.groupBy("_length").agg(F.sum("_n").alias("n")).collect()}  # at most ``capacity`` rows
    if any(not 1 <= x <= capacity for x in histogram):
        raise ValueError(f"lengths must be 1 to {capacity}")
    places = spark.sparkContext.broadcast(Places.of(solve(histogram, capacity, plans)))  # a few rows for each length and configuration
    before = Window.partitionBy("_length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("_length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    numbered = salted.withColumn("_row", F.row_number().over(Window.partitionBy("_length", "_salt").orderBy(*order)))
    numbered = numbered.join(bases, ["_length", "_salt"]).withColumn("_number", F.col("_base") + F.col("_row") - 1)
    names = pieces.columns

    def run(batches):
        for batch in batches:
            length, number = (batch.column(len(names) + i).to_numpy() for i in range(2))
            sequence, offset = places.value.place(length, number)
            yield pa.record_batch([*batch.columns[: len(names)], pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    schema = StructType([*pieces.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])
    return numbered.select(*names, "_length", "_number").mapInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end: int | None = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cut and pack all documents: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(materialise(cut_pieces(docs, tokenizer, capacity, end, id_col, text_col), "packing-pieces"), capacity)
