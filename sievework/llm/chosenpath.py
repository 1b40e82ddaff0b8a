"""N-gram Jaccard join by chosen paths.

Documents with the same set of word shingles are one class. Each class has a sketch of SKETCH minwise values. A run
starts from one root bucket; in every bucket some coordinates are sampled (RATE / threshold of them on average, the
same for all members), and each splits the bucket by its members' values there. Buckets of at most ``small`` members are
compared by brute force. In a larger one all members are compared with the bucket's centre, the usual values of some
members; those close to it leave the bucket (not the other buckets), and the rest is split again. All that could agree
with one that leaves are linked to one member, so that no pair is lost by it. Splits go on until the large buckets that
are left are few enough to be compared block by block. Runs are repeated until a pair at the threshold is found with
the target recall at the deepest split. Linked classes form groups, and within a group every pair is verified on
the whole shingle sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm import textkernels as K
from sievework.llm.common import broadcast_if_small, by_slices, grouped, partitions, task, texts
from sievework.plans.components import connected_components
from sievework.session import materialise

SHINGLE, THRESHOLD = 5, 0.8
SKETCH = 64
RECALL = 0.9999
RATE = 1.4  # sampled coordinates on which a pair at the threshold agrees, on average, at each split
SMALL = 256  # members of a bucket that is compared by brute force
PROBES = 16  # members whose usual sketch is the centre of a large bucket
DEAL = 6  # pairs of blocks that a member of a large bucket goes to on average, from which buckets are split once more
DEPTH = 16  # most splits after the root's
BLOCK = 192  # members of a block
_rng = np.random.default_rng(1729)
FACTOR = _rng.integers(1, 2**63, SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFT = _rng.integers(1, 2**63, SKETCH, dtype=np.uint64)


def runs_for(recall: float, depth: int = 3) -> int:
    """Runs after which a pair at the threshold has shared a bucket ``depth`` splits down with the given probability.

    A bucket has a Poisson number of sampled coordinates, of which RATE on average keep such a pair together. As RATE is
    more than 1, some path goes on however deep the splits: at 1.4 the number of runs settles at 13 for 0.9999.
    """
    found = 1.0
    for _ in range(depth):
        found = 1 - math.exp(-RATE * found)
    return math.ceil(math.log(1 - recall) / math.log(1 - found))


def least_agreement(threshold: float, sketch: int = SKETCH) -> int:
    """Coordinates that a pair at the threshold agrees on, but for one in 30,000 (four standard deviations)."""
    return math.floor(sketch * threshold - 4 * math.sqrt(sketch * threshold * (1 - threshold)))


def pivot_bounds(agree: int, sketch: int = SKETCH) -> tuple[int, int]:
    """(leave, tie): members that agree with the pivot on ``leave`` coordinates leave its bucket; those on ``tie`` are linked to it.

    Differing coordinates are a metric: what agrees with a leaving member on ``agree`` coordinates agrees with the
    pivot on ``agree + leave - sketch`` at least.
    """
    leave = (sketch + agree) // 2
    return leave, agree + leave - sketch


def shingle_sets(words: K.Words, size: int) -> list[np.ndarray]:
    """The distinct shingle hashes of each row in order; a shorter text has one shingle, its words; an empty one none."""
    hashes, at = words.windows(size)
    cuts = np.searchsorted(words.row[at], np.arange(words.rows + 1)) if len(at) else np.zeros(words.rows + 1, np.int64)
    out = []
    for row in range(words.rows):
        n = int(words.count[row])
        if n >= size:
            out.append(np.unique(hashes[cuts[row] : cuts[row + 1]]))
        elif n:
            h = np.uint64(n)
            own = words.hash[words.first[row] : words.first[row + 1]]
            for x in own:
                h = K.mix(np.array([h * K.STEP + x], np.uint64))[0]
            out.append(np.array([h], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def sketch(shingles: np.ndarray) -> np.ndarray:
    """The SKETCH minwise values of a set."""
    least = np.full(SKETCH, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(shingles), 2048):
        part = shingles[a : a + 2048, None]
        least = np.minimum(least, (part * FACTOR + SHIFT).min(0))
    return (least >> np.uint64(32)).astype(np.uint32)


def describe(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, row_key, set_a, set_b, n_set (the identity of the shingle set) and its sketch."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        with np.errstate(over="ignore"):
            sets = shingle_sets(K.Words(batch.column(0)), size)
            null = np.asarray(batch.column(1).is_null())
            sets = [s[:0] if n else s for s, n in zip(sets, null, strict=True)]
            a = np.array([K.mix(s).sum(dtype=np.uint64) for s in sets], np.uint64)
            b = np.array([K.mix(s ^ K.STEP).sum(dtype=np.uint64) for s in sets], np.uint64)
            drawn = [sketch(s).tobytes() if len(s) else b"" for s in sets]
        return pa.record_batch([*batch.columns[1:], pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array([len(s) for s in sets], pa.int64()), pa.array(drawn, pa.binary())], ["doc_id", "row_key", "set_a", "set_b", "n_set", "sketch"])

    return docs.select("text", "doc_id", "row_key").mapInArrow(by_slices(run), "doc_id long, row_key long, set_a long, set_b long, n_set long, sketch binary")


def children(path: np.ndarray, sketches: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """For each (bucket, member): the member's place in the input and the bucket it goes on to, for all coordinates
    that the bucket samples."""
    coordinate = np.arange(SKETCH, dtype=np.uint64)
    drawn = K.mix(path[:, None] + (coordinate[None, :] + np.uint64(1)) * K.STEP)
    member, at = np.nonzero(drawn < np.uint64(int(min(RATE / (threshold * SKETCH), 1) * (2**64 - 1))))
    return member, K.mix(drawn[member, at] * K.STEP + sketches[member, at])


def matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(-1, SKETCH)


def root_buckets(classes: DataFrame, runs: int, threshold: float) -> DataFrame:
    roots = K.mix(np.arange(1, runs + 1, dtype=np.uint64) * K.STEP)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            drawn = matrix(batch.column(1))
            for root in roots:
                member, path = children(np.full(len(ids), root), drawn, threshold)
                yield pa.record_batch([pa.array(path.view(np.int64)), pa.array(ids[member])], ["path", "node"])

    return classes.select("node", "sketch").mapInArrow(task(run), "path long, node long")


def usual_values(drawn: np.ndarray) -> np.ndarray:
    """At each coordinate the value that most of the sketches have, the smallest of several."""
    ordered = np.sort(drawn, axis=0)
    begins = np.concatenate([np.ones((1, drawn.shape[1]), bool), ordered[1:] != ordered[:-1]])
    since = np.arange(len(drawn))[:, None]
    first = np.maximum.accumulate(np.where(begins, since, 0), axis=0)
    at = (since - first).argmax(axis=0)  # the end of the longest run
    return ordered[at, np.arange(drawn.shape[1])]


def bucket_centres(members: DataFrame) -> DataFrame:
    """members: path, node, sketch of large buckets. path, pivot (a member), centre: the usual values of PROBES members."""
    drawn = members.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(PROBES))).groupBy("path", "salt")
    probes = drawn.agg(F.min_by(F.struct("node", "sketch"), F.xxhash64("path", "node")).alias("probe"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            centres = [usual_values(np.frombuffer(b"".join(x), "<u4").reshape(-1, SKETCH)).tobytes() for x in batch.column(2).to_pylist()]
            yield pa.record_batch([*batch.columns[:2], pa.array(centres, pa.binary())], ["path", "pivot", "centre"])

    held = probes.groupBy("path").agg(F.min("probe.node").alias("pivot"), F.collect_list("probe.sketch").alias("drawn"))  # PROBES sketches at most
    return held.mapInArrow(task(run), "path long, pivot long, centre binary")


def spanning_links(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that tie together just what the given ones do, one for each node but the smallest of its part."""
    nodes, code = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = code[: len(a)], code[len(a) :]
    label = np.arange(len(nodes))
    while len(left):
        least = np.minimum(label[left], label[right])
        new = label.copy()
        for end in (left, right):
            np.minimum.at(new, end, least)
            np.minimum.at(new, label[end], least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    tied = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[tied], nodes[label[tied]]


class Links:
    """The links of a task, of which a spanning forest is kept."""

    def __init__(self):
        self.a, self.b, self.n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.a.append(a)
        self.b.append(b)
        self.n += len(a)
        if self.n > 200_000:
            a, b = self.held()
            self.a, self.b, self.n = [a], [b], 0

    def held(self) -> tuple[np.ndarray, np.ndarray]:
        return spanning_links(np.concatenate(self.a), np.concatenate(self.b))


def split_buckets(members: DataFrame, threshold: float, agree: int) -> tuple[DataFrame, DataFrame]:
    """members: path, node, sketch, pivot, centre of large buckets. Members close to the centre leave. Returns links
    that tie to the pivots all members that could agree with one that leaves, and the next buckets of those that stay."""
    leave, wide = pivot_bounds(agree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links = Links()
        for batch in batches:
            path, node, pivot = (batch.column(i).to_numpy() for i in (0, 1, 3))
            drawn = matrix(batch.column(2))
            same = (drawn == matrix(batch.column(4))).sum(1)
            tie = (same >= wide) & (node != pivot)
            links.add(node[tie], pivot[tie])
            rest = np.flatnonzero(same < leave)
            member, onward = children(path[rest].view(np.uint64), drawn[rest], threshold)
            yield pa.record_batch([pa.array(node[rest][member]), pa.nulls(len(member), pa.int64()), pa.array(onward.view(np.int64))], ["a", "b", "path"])
        a, b = links.held()
        yield pa.record_batch([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64())], ["a", "b", "path"])

    out = materialise(members.mapInArrow(task(run), "a long, b long, path long"), "paths-split")
    return out.where("b is not null").select("a", "b"), out.where("path is not null").select("path", F.col("a").alias("node"))


def forest(similar: np.ndarray) -> np.ndarray:
    """For each row of a symmetric boolean matrix, the smallest index of its connected part."""
    n = len(similar)
    label = np.arange(n)
    while True:
        least = np.where(similar, label[None, :], n).min(1)
        new = np.minimum(label, least)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def brute_force(buckets: DataFrame, agree: int) -> DataFrame:
    """buckets: path, node, sketch. Links (a, b) that tie together the members that agree, at most one fewer than members in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links = Links()
        for table in grouped(batches, "path"):
            node = table["node"].to_numpy()
            drawn = matrix(table["sketch"].combine_chunks())
            label = forest((drawn[:, None, :] == drawn[None, :, :]).sum(2) >= agree) if len(node) > 2 else np.array([0, 0 if (drawn[0] == drawn[-1]).sum() >= agree else 1])[: len(node)]
            tied = np.flatnonzero(label != np.arange(len(node)))
            links.add(node[tied], node[label[tied]])
        a, b = links.held()
        yield pa.record_batch([pa.array(a), pa.array(b)], ["a", "b"])

    n = partitions(buckets.sparkSession)
    return buckets.repartition(n, "path").sortWithinPartitions("path").mapInArrow(task(run), "a long, b long")


def in_blocks(rows: DataFrame, key: str, size: str, block: int) -> DataFrame:
    """Deal the rows of each key to pairs of blocks of about ``block`` rows: a row of k blocks comes k times, and any
    two rows of a key meet in one pair of blocks. Adds: pair (a 64-bit hash of key and blocks), own, other."""
    k = F.ceil(F.col(size) / block).cast("int")
    own = F.pmod(F.xxhash64("node", F.lit(5)), k).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), k - 1)))
    return rows.withColumn("pair", F.xxhash64(key, F.least("own", "other"), F.greatest("own", "other")))


def candidate_links(classes: DataFrame, threshold: float, recall: float, small: int, depth: int) -> DataFrame:
    """Links between classes that tie together all that the chosen paths bring together and whose sketches agree."""
    agree = least_agreement(threshold)
    rows = root_buckets(classes, runs_for(recall, depth + 1), threshold)  # the root's split and ``depth`` more
    own = classes.select("node", "sketch")
    links, ready = [], []
    for level in range(depth + 1):
        rows = materialise(rows, "paths")
        sizes = rows.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        held = materialise(rows.join(sizes, "path"), "paths-held")
        ready.append(held.where(F.col("n") <= small).select("path", "node"))
        large = held.where(F.col("n") > small)
        count, dealt = large.agg(F.count(F.lit(1)), F.sum(F.ceil(F.col("n") / small))).first()
        if not count:
            break
        members = materialise(large.join(own, "node"), "paths-large")
        if level == depth or dealt <= DEAL * count:  # the rest is compared block by block, which loses no pair
            blocks = in_blocks(members, "path", "n", small)
            links.append(brute_force(blocks.select(F.col("pair").alias("path"), "node", "sketch"), agree))
            break
        centres = materialise(bucket_centres(members), "paths-centres")
        found, rows = split_buckets(members.join(centres, "path").select("path", "node", "sketch", "pivot", "centre"), threshold, agree)
        links.append(found)
    buckets = ready[0]
    for more in ready[1:]:
        buckets = buckets.unionByName(more)
    links.append(brute_force(buckets.join(own, "node").select("path", "node", "sketch"), agree))
    out = links[0]
    for more in links[1:]:
        out = out.unionByName(more)
    return out.distinct()


def overlaps(sets: list[np.ndarray], rows: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets[r], r in rows, with every set."""
    flat = np.concatenate(sets)
    _, code = np.unique(flat, return_inverse=True)
    cuts = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    out = np.empty((len(rows), len(sets)), np.int64)
    mark = np.zeros(int(code.max()) + 1, np.int32)
    for i, r in enumerate(rows):
        own = code[cuts[r] : cuts[r + 1]]
        mark[own] = 1
        out[i] = np.add.reduceat(mark[code], cuts[:-1])
        mark[own] = 0
    return out


def verify(members: DataFrame, size: int, threshold: float, block: int) -> DataFrame:
    """members: component, n, node, copies, text. Every pair of a component is compared on its whole sets.

    Returns node, label (the smallest node of the block pair that links lead to), links (documents linked within the
    block pair), several (the component spans several blocks).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, "pair"):
            node, copies, own, other = (table[c].to_numpy() for c in ("node", "copies", "own", "other"))
            sets = shingle_sets(K.Words(table["text"].combine_chunks()), size)
            n = np.array([len(s) for s in sets])
            left = np.flatnonzero(own <= other)  # the rows of the first block; in a block's pair with itself, all
            meet = overlaps(sets, left)
            # a / b >= threshold, in whole numbers of shingles
            similar = meet >= threshold * (n[left][:, None] + n[None, :] - meet) - 1e-9
            crosses = own != other
            if crosses.any():
                similar &= (own <= other)[None, :] != (own <= other)[left][:, None]
            similar[np.arange(len(left)), left] = False
            full = np.zeros((len(node), len(node)), bool)
            full[left] = similar
            full |= full.T
            links = full @ copies
            order = np.argsort(node, kind="stable")
            label = np.empty(len(node), np.int64)
            label[order] = node[order][forest(full[np.ix_(order, order)])]
            yield pa.record_batch([pa.array(node), pa.array(label), pa.array(links), table["several"].combine_chunks()], ["node", "label", "links", "several"])

    dealt = in_blocks(members, "component", "n", block).withColumn("several", F.col("n") > block)
    columns = ["pair", "node", "copies", "own", "other", "several", "text"]
    spark = members.sparkSession
    rows = dealt.select(*columns).repartition(partitions(spark), "pair").sortWithinPartitions("pair")
    return rows.mapInArrow(task(run), "node long, label long, links long, several boolean")


def decide(source: DataFrame, size: int, threshold: float, recall: float, small: int, depth: int, block: int) -> DataFrame:
    """source: doc_id, text, row_key. Per row: doc_id, row_key, class_id and class_key (the first row that links lead
    to, by id and row_key), rep_id, n_links; class_key is null without shingles or id."""
    described = materialise(describe(source, size), "shingle-sets")
    one = ["set_a", "set_b", "n_set"]
    classes = described.where("n_set > 0").groupBy(*one, "sketch").agg(F.min(F.struct("doc_id", "row_key")).alias("first"), F.count(F.lit(1)).alias("copies"))
    # Ids may repeat with other texts: a class has a number of its own, which the written table fixes.
    classes = materialise(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    groups = materialise(connected_components(candidate_links(classes, threshold, recall, small, depth)), "groups")
    held = groups.join(groups.groupBy("component").agg(F.count(F.lit(1)).alias("n")), "component")
    held = held.join(classes.select("node", "copies", F.col("first.doc_id").alias("doc_id"), F.col("first.row_key").alias("row_key")), "node")
    held = materialise(held, "members")
    # One row of text for each class, although a row may come twice.
    members = source.join(broadcast_if_small(held, held.count(), 48), ["doc_id", "row_key"]).dropDuplicates(["node"])
    checked = materialise(verify(members, size, threshold, block), "verified")
    links = checked.groupBy("node").agg(F.sum("links").alias("links"), F.min("label").alias("label"), F.max("several").alias("several"))
    across = checked.where("several")
    if across.isEmpty():
        links = links.withColumn("part", F.col("label"))
    else:
        far = connected_components(across.select(F.col("node").alias("a"), F.col("label").alias("b")))
        links = links.join(far, "node", "left").withColumn("part", F.coalesce("component", "label"))
    linked = materialise(links.select("node", "part", "links").join(classes.select("node", "first"), "node"), "linked")
    parts = linked.groupBy("part").agg(F.min("first").alias("leader"))
    linked = linked.join(parts, "part").select("node", "leader", "links")  # before the many classes without links come in
    by_class = classes.select(*one, "node", "first", "copies").join(linked, "node", "left")
    found = described.select("doc_id", "row_key", *one).join(by_class, one, "left")
    leader = F.coalesce("leader", "first")
    return found.select(
        "doc_id",
        "row_key",
        F.coalesce(leader["doc_id"], "doc_id").alias("class_id"),
        leader["row_key"].alias("class_key"),
        F.coalesce("first.doc_id", "doc_id").alias("rep_id"),
        (F.coalesce("links", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))).cast("long").alias("n_links"),
    )


def jaccard_groups(docs: DataFrame, size: int = SHINGLE, threshold: float = THRESHOLD, recall: float = RECALL, small: int = SMALL, depth: int = DEPTH, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, class_id (smallest id that links lead to), rep_id (smallest id with the same
    shingles), n_links (other documents at or above the threshold, copies counted one by one).

    Shingles are runs of ``size`` words ``[^\\x20\\x09-\\x0D]+``, unchanged; a shorter text is one shingle; very long
    texts are read whole. Null and empty texts, and rows without an id, have no links: class_id and rep_id are the
    document's own id. Rows that repeat an id and a text count as copies; rows of one id with different texts are
    documents of their own. Other columns are ignored; an empty table gives an empty result.
    """
    source = texts(docs, id_col, text_col).withColumn("row_key", F.xxhash64("text"))
    return decide(source, size, threshold, recall, small, depth, block).drop("row_key", "class_key")


def keep_first(docs: DataFrame, size: int = SHINGLE, threshold: float = THRESHOLD, recall: float = RECALL, small: int = SMALL, depth: int = DEPTH, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns: one of each group of linked documents, the one with the smallest id
    (of several texts of that id the one with the smallest hash; of rows that repeat it one stays).

    Null and empty texts and rows without an id are linked to nothing and stay. Other columns, whatever their names,
    come through; an empty table gives an empty result.
    """
    source = texts(docs, id_col, text_col).withColumn("row_key", F.xxhash64("text"))
    decided = decide(source, size, threshold, recall, small, depth, block).where("class_key is not null")
    leads = (F.col("doc_id") == F.col("class_id")) & (F.col("row_key") == F.col("class_key"))
    rows = materialise(decided.groupBy(F.col("doc_id").alias("_row_id"), F.col("row_key").alias("_row_key")).agg(F.max(leads).alias("_leads"), F.count(F.lit(1)).alias("_n")).where("not _leads or _n > 1"), "jaccard-rows")
    same = (F.col(id_col).cast("long") == F.col("_row_id")) & (F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))) == F.col("_row_key"))
    left = docs.join(broadcast_if_small(rows, rows.count(), 32), same, "left_anti")
    twice = rows.where("_leads")
    if twice.isEmpty():
        return left
    return left.unionByName(docs.join(twice, same, "left_semi").dropDuplicates([id_col, text_col]))
