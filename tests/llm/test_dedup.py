"""Exact dedup, Jaccard join and substring dedup against plain definitions."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.llm import chosenpath, exact, substring
from sievework.llm import textkernels as K
from tests.llm.fixtures import awkward, empty, jaccard_groups, passage, removed_words, rows, thue_morse, words


def plain_exact(pairs):
    groups = {}
    for i, t in pairs:
        groups.setdefault(t or "", []).append(i)
    out = []
    for i, t in pairs:
        ids = groups[t or ""]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return Counter(out)


def test_exact(spark):
    pairs = [r[:2] for r in rows()]
    assert Counter(map(tuple, exact.exact_dedup(awkward(spark), bucket_entries=2).collect())) == plain_exact(pairs)


@pytest.mark.parametrize("broken", ["key", "digest", "both"])
def test_exact_with_colliding_hashes(spark, broken):
    """Texts are told apart by their bytes when all hashes are equal."""
    options = {}
    if broken in ("key", "both"):
        options["key_of"] = lambda t: F.lit(7).cast("long")
    if broken in ("digest", "both"):
        options["digest_of"] = lambda t: F.lit(b"same")
    pairs = [r[:2] for r in rows()] + [(30, "abc"), (31, "abd"), (32, "abd")]
    df = spark.createDataFrame(pairs, "doc_id long, text string")
    assert Counter(map(tuple, exact.exact_dedup(df, **options).collect())) == plain_exact(pairs)


def test_rows_find_their_entries_through_the_directory(spark, monkeypatch):
    """A directory that sends lookups elsewhere than it sent the entries changes the result."""
    pairs = [r[:2] for r in rows()] + [(100 + i, f"text {i % 60}") for i in range(200)]
    df = spark.createDataFrame(pairs, "doc_id long, text string")
    assert Counter(map(tuple, exact.exact_dedup(df, bucket_entries=4).collect())) == plain_exact(pairs)
    real, calls = exact.place, []

    def wrong(rows, directory):
        calls.append(1)
        found = real(rows, directory)
        return found if len(calls) == 1 else found.withColumn("bucket", F.col("bucket") + F.pmod("doc_id", F.lit(2)).cast("int"))

    monkeypatch.setattr(exact, "place", wrong)
    assert Counter(map(tuple, exact.exact_dedup(df, bucket_entries=4).collect())) != plain_exact(pairs)


def test_buckets_hold_no_more_than_they_may(spark, monkeypatch):
    pairs = [(i, f"text {i}") for i in range(3000)] + [(5000 + i, "hot") for i in range(3000)]
    df = spark.createDataFrame(pairs, "doc_id long, text string")
    keyed = df.select("doc_id", F.xxhash64("text").alias("key"), F.sha2("text", 256).alias("digest"), F.octet_length("text").alias("n_bytes"))
    for most in (20, 3):  # directories of the depth that the load asks for, and of three bits, with further bits
        monkeypatch.setattr(exact, "MAX_DEPTH", most)
        _, index = exact.build_index(keyed, 50)
        load = [r["count"] for r in index.groupBy("bucket", "part").count().collect()]
        assert sum(load) == 3001 and len(load) > 40 and max(load) <= (50 if most == 20 else 100)
        assert index.groupBy("key").agg(F.count_distinct("bucket", "part").alias("n")).where("n > 1").isEmpty()
    assert Counter(map(tuple, exact.exact_dedup(df, bucket_entries=50).collect())) == plain_exact(pairs)


def test_directory_doubles_until_no_bucket_is_overfull():
    rng = random.Random(0)
    counts = Counter(rng.randrange(256) for _ in range(2000)) | Counter({3: 400})
    depth, slots, local = exact.grow_directory(counts, 8, 100)
    load = Counter()
    for slot, n in counts.items():
        load[slots[slot >> (8 - depth)]] += n
    assert all(n <= 100 or local[b] == 8 for b, n in load.items())
    assert slots == sorted(slots) and len(slots) == 1 << depth
    assert exact.grow_directory({}, 4, 10) == (0, [0], {0: 0})


def test_exact_empty(spark):
    assert exact.exact_dedup(empty(spark)).count() == 0
    assert exact.keep_one(empty(spark)).count() == 0


def test_keep_one(spark):
    df = awkward(spark)
    got = exact.keep_one(df)
    assert got.columns == df.columns
    texts = [r["text"] or "" for r in got.select("text").collect()]
    assert sorted(texts) == sorted({r[1] or "" for r in rows()})
    assert {r["doc_id"] for r in got.where("text like 'one'").collect()} == {10}
    pairs = [(1, None), (1, ""), (1, ""), (None, "x"), (None, "x"), (2, "y"), (2, "y")]
    got = exact.keep_one(spark.createDataFrame(pairs, "doc_id long, text string")).collect()
    assert Counter((r["doc_id"], r["text"] or "") for r in got) == {(1, ""): 1, (None, "x"): 1, (2, "y"): 1}


def check_groups(spark, df, pairs, **options):
    got = Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in chosenpath.jaccard_groups(df, **options).where("doc_id is not null").collect())
    assert got == Counter(jaccard_groups(pairs))


def test_jaccard(spark):
    check_groups(spark, awkward(spark), [r[:2] for r in rows()])
    lost = chosenpath.jaccard_groups(awkward(spark)).where("doc_id is null").collect()
    assert [tuple(r) for r in lost] == [(None, None, None, 0)] * 2


def test_jaccard_large_groups(spark, monkeypatch):
    """Near copies of one text, texts with one passage, and chains, through pivots, splits and blocks."""
    rng = random.Random(5)
    base, shared = passage(10, 150).split(), passage(11, 70)
    pairs = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = f"edit{i}"
        pairs.append((i, " ".join(w)))
    pairs += [(100 + i, passage(200 + i, 60) + " " + shared) for i in range(40)]
    chain = passage(12, 200).split()
    pairs += [(200 + i, " ".join(chain[12 * i : 12 * i + 110])) for i in range(7)]
    df = spark.createDataFrame(pairs, "doc_id long, text string")
    check_groups(spark, df, pairs, small=6, block=16, depth=2)
    monkeypatch.setattr(chosenpath, "DEAL", 0)  # splits to the last
    check_groups(spark, df, pairs, small=4, block=16, depth=7)


def test_jaccard_empty_and_stage(spark):
    assert chosenpath.jaccard_groups(empty(spark)).count() == 0
    df = awkward(spark)
    got = chosenpath.keep_first(df)
    assert got.columns == df.columns
    ids = Counter(r["doc_id"] for r in got.select("doc_id").collect())
    groups = jaccard_groups([r[:2] for r in rows()])
    assert {i for i in ids if i is not None} == {i for i, least, _ in groups if i == least}
    assert ids[None] == 2


def test_runs_reach_the_recall():
    assert chosenpath.runs_for(0.99, 1) == 4
    assert chosenpath.runs_for(0.999) > chosenpath.runs_for(0.99)


@pytest.mark.parametrize("splits", [1, 5, 12])
def test_recall_of_the_paths(splits):
    """Pairs that agree on just the threshold's share of coordinates meet in some bucket of the deepest split."""
    rng = np.random.default_rng(splits)
    roots = K.mix(np.arange(1, chosenpath.runs_for(0.99, splits) + 1, dtype=np.uint64) * K.STEP)
    missed, trials = 0, 2000
    for t in range(trials):
        both = rng.integers(0, 2**32, (2, chosenpath.SKETCH), dtype=np.uint64).astype(np.uint32)
        same = rng.permutation(chosenpath.SKETCH)[: round(0.8 * chosenpath.SKETCH)]
        both[1, same] = both[0, same]
        paths = roots + np.uint64(t) * K.U(977)  # other samples for each trial
        for _ in range(splits):
            member, onward = chosenpath.children(paths, np.repeat(both[:1], len(paths), 0), 0.8)
            other_member, other = chosenpath.children(paths, np.repeat(both[1:], len(paths), 0), 0.8)
            paths = np.unique(onward[onward == other])
            if not len(paths):
                break
        missed += not len(paths)
    assert missed <= 0.02 * trials


def test_runs_reach_the_recall_at_the_deepest_split(spark, monkeypatch):
    """The root's split and ``depth`` more: 13 runs for 0.9999, and no more however deep."""
    asked = []

    def root_buckets(classes, runs, threshold):
        asked.append(runs)
        return classes.select(F.col("node").alias("path"), "node")

    monkeypatch.setattr(chosenpath, "root_buckets", root_buckets)
    classes = spark.createDataFrame([(i, np.full(64, i, "<u4").tobytes()) for i in range(3)], "node long, sketch binary")
    chosenpath.candidate_links(classes, chosenpath.THRESHOLD, chosenpath.RECALL, 32, chosenpath.DEPTH)
    chosenpath.candidate_links(classes, chosenpath.THRESHOLD, 0.99, 32, 1)
    assert asked == [chosenpath.runs_for(0.9999, chosenpath.DEPTH + 1), chosenpath.runs_for(0.99, 2)] == [13, 5]
    assert chosenpath.runs_for(0.9999, 1000) == 13


def test_centres_separate_no_pair(spark):
    """Two members that agree are tied by links, or both go on, whatever the centre of their bucket."""
    agree = chosenpath.least_agreement(chosenpath.THRESHOLD)
    rng = np.random.default_rng(4)
    centre = np.zeros(chosenpath.SKETCH, "<u4")
    drawn = []
    for i in range(1, chosenpath.SKETCH - agree + 1):
        x = centre.copy()
        x[rng.permutation(chosenpath.SKETCH)[:i]] = i
        y = x.copy()
        y[rng.permutation(np.flatnonzero(x == 0))[: chosenpath.SKETCH - agree]] = 100 + i
        drawn += [x, y]
    path = next(p for p in range(1, 99) if len(chosenpath.children(np.array([p], np.uint64), centre[None, :], chosenpath.THRESHOLD)[0]) > 1)
    rows = [(path, i, x.tobytes(), 1000, centre.tobytes()) for i, x in enumerate(drawn)]
    members = spark.createDataFrame(rows, "path long, node long, sketch binary, pivot long, centre binary").repartition(1)
    links, onward = chosenpath.split_buckets(members, chosenpath.THRESHOLD, agree)
    label = {n: n for n in [*range(len(drawn)), 1000]}
    for a, b in links.collect():
        old, new = label[a], label[b]
        label = {n: new if x == old else x for n, x in label.items()}
    goes_on = {r["node"] for r in onward.collect()}
    for i in range(0, len(drawn), 2):
        assert label[i] == label[i + 1] or {i, i + 1} <= goes_on, i


def test_usual_values():
    drawn = np.array([[1, 9, 5], [2, 9, 5], [1, 7, 6], [3, 8, 6]], np.uint32)
    assert chosenpath.usual_values(drawn).tolist() == [1, 9, 5]
    assert chosenpath.usual_values(drawn[:1]).tolist() == [1, 9, 5]


def test_centres_of_buckets(spark):
    base = np.arange(chosenpath.SKETCH, dtype="<u4")
    rows = [(7, i, np.where(np.arange(chosenpath.SKETCH) % 9 == i % 9, 1000 + i, base).astype("<u4").tobytes()) for i in range(50)]
    rows += [(8, 100, base[::-1].tobytes())]
    got = {r["path"]: r for r in chosenpath.bucket_centres(spark.createDataFrame(rows, "path long, node long, sketch binary")).collect()}
    assert bytes(got[7]["centre"]) == base.tobytes() and got[7]["pivot"] in range(50)
    assert bytes(got[8]["centre"]) == base[::-1].tobytes() and got[8]["pivot"] == 100


def repeated_ids():
    """Ids that come with several texts, each with near copies under other ids; rows that repeat id and text."""
    out = [(20, passage(40, 80)), (20, passage(41, 80)), (21, passage(40, 80) + " tail"), (22, passage(41, 80) + " tail"), (30, passage(40, 80))]
    out += [(31, passage(42, 90)), (31, passage(42, 90) + " end"), (32, "head " + passage(42, 90)), (32, passage(43, 50)), (32, passage(43, 50))]
    return [*out, (33, passage(44, 30)), (33, passage(44, 30)), (34, ""), (34, ""), (None, passage(40, 80)), (None, passage(40, 80))]


def plain_first(pairs):
    """One row of each group, of the smallest id; rows without links or shingles stay."""
    alone = [p for p in pairs if p[0] is None or not words(p[1])]
    rest = [p for p in pairs if p[0] is not None and words(p[1])]
    numbered = list(enumerate(rest))
    groups = jaccard_groups([(k, t) for k, (_, t) in numbered])
    held = {}
    for (k, least, _), (_, p) in zip(groups, numbered, strict=True):
        held.setdefault(least, []).append(p)
    return alone, list(held.values())


def test_jaccard_of_repeated_ids(spark):
    pairs = repeated_ids()
    df = spark.createDataFrame(pairs, "doc_id long, text string").repartition(3)
    check_groups(spark, df, pairs)
    link = {r["doc_id"]: r for r in chosenpath.jaccard_groups(df).where("doc_id in (21, 22)").collect()}
    assert link[21]["class_id"] == link[22]["class_id"] == 20 and link[22]["n_links"] == 1
    alone, groups = plain_first(pairs)
    left = Counter((r["doc_id"], r["text"]) for r in chosenpath.keep_first(df).collect())
    assert sum(left.values()) == len(alone) + len(groups)
    for p in alone:
        left[p] -= 1
    for group in groups:
        first = [p for p in group if p[0] == min(i for i, _ in group)]
        assert sum(left[p] for p in set(first)) == 1


def test_jaccard_recall_at_production_settings(spark):
    """All pairs of texts whose similarities lie around the threshold, among others with the same passages."""
    rng = random.Random(8)
    pairs, shared = [], passage(60, 40)
    for g in range(40):
        base = passage(600 + g, 120).split()
        for k in range(12):
            w = list(base)
            for _ in range(rng.randint(0, 5)):
                w[rng.randrange(len(w))] = f"edit{g}x{k}"
            pairs.append((len(pairs), " ".join(w) + (" " + shared if g % 2 else "")))
    big = passage(61, 200).split()
    for k in range(400):
        w = list(big)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = f"new{k}"
        pairs.append((len(pairs), " ".join(w)))
    df = spark.createDataFrame(pairs, "doc_id long, text string").repartition(4)
    want = {i: n for i, _, n in jaccard_groups(pairs)}
    got = {r["doc_id"]: r["n_links"] for r in chosenpath.jaccard_groups(df).collect()}
    assert all(got[i] <= n for i, n in want.items())
    assert sum(got.values()) >= chosenpath.RECALL * sum(want.values())


def test_spanning_links():
    rng = np.random.default_rng(9)
    a, b = rng.integers(0, 300, (2, 200))
    one, two = chosenpath.spanning_links(a, b)
    similar = np.eye(300, dtype=bool)
    similar[a, b] = similar[b, a] = True
    want = chosenpath.forest(similar)
    assert dict(zip(one.tolist(), two.tolist(), strict=True)) == {i: int(x) for i, x in enumerate(want) if i != x}
    assert len(chosenpath.spanning_links(a[:0], b[:0])[0]) == 0


def check_substrings(spark, df, pairs, **options):
    expected = removed_words(pairs)
    got = substring.dedup_substrings(df, **options).collect()
    assert len(got) == len(pairs)
    want = Counter()
    for i, t in pairs:
        gone, w = expected[i, t], words(t)
        want[i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)] += 1
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got) == want
    for r in got:
        assert sum(s["stop"] - s["start"] for s in r["removed"]) == r["n_removed"]


def test_substrings(spark):
    check_substrings(spark, awkward(spark), [r[:2] for r in rows()], bits=15)


def test_substrings_common_passage(spark):
    """A passage in every text: its anchors are dealt window by window; a crowded bit table only costs time."""
    shared = passage(20, 40)
    pairs = [(i, passage(300 + i, 25) + "  " + shared + "\n" + passage(400 + i, 25)) for i in range(30)]
    pairs += [(50, "a b " * 60), (51, "a b " * 40), (52, "b a " * 20)]
    df = spark.createDataFrame(pairs, "doc_id long, text string")
    check_substrings(spark, df, pairs, bits=15, often=4)
    check_substrings(spark, df, pairs, bits=6, often=4)


def test_substrings_of_texts_that_collide_in_polynomial_hashes(spark):
    """Words that swap two letters by the Thue-Morse rule are not the same words."""
    t, u = thue_morse()
    head = " ".join("abcdefghijkl")
    pairs = [(1, f"{head} {t}"), (2, f"{head} {u}"), (3, f"{head} {t}"), (4, f"x {head} {u}")]
    check_substrings(spark, spark.createDataFrame(pairs, "doc_id long, text string"), pairs, bits=15)


def test_substrings_of_copies(spark):
    """Copies of a text, some of whose passages smaller ids have, and repeated rows of the smallest id."""
    old, own = passage(30, 40), passage(31, 60)
    pairs = [(5, old), (7, f"{own} {old}"), (7, f"{own} {old}"), (9, f"{own} {old}"), (8, f"{own} {old}"), (6, f"{own} tail"), (10, own), (10, "short"), (11, "short"), (None, own)]
    check_substrings(spark, spark.createDataFrame(pairs, "doc_id long, text string"), pairs, bits=15)


def test_cut_documents(spark):
    df = awkward(spark)
    pairs = [r[:2] for r in rows()]
    expected = removed_words(pairs)
    got = substring.cut_documents(df, bits=15)
    assert got.columns == df.columns and [f.dataType for f in got.schema] == [f.dataType for f in df.schema]
    want = Counter()
    for i, t in pairs:
        gone, w = expected[i, t], words(t)
        if not any(gone):
            want[i, t] += 1
        elif not all(gone):
            want[i, " ".join(x for x, g in zip(w, gone, strict=True) if not g)] += 1
    assert Counter((r["doc_id"], r["text"]) for r in got.select("doc_id", "text").collect()) == want
    assert substring.cut_documents(empty(spark), bits=15).count() == 0
    assert substring.dedup_substrings(empty(spark), bits=15).count() == 0


def test_fm_index_finds_every_occurrence():
    import numpy as np

    from sievework.llm.fmindex import FMIndex

    rng = np.random.default_rng(3)
    seqs = [rng.integers(0, 4, rng.integers(1, 30)) for _ in range(40)]
    flat, lengths = np.concatenate(seqs), np.array([len(s) for s in seqs])
    index = FMIndex(flat, lengths)
    for n in (1, 2, 5):
        starts, at = [], 0
        for s in seqs:
            starts += range(at, at + len(s) - n + 1)
            at += len(s)
        matched, low, high = index.matches(flat, np.array(starts), n)
        for k, (m, a, b) in zip(starts, zip(matched, low, high, strict=True), strict=True):
            want = sum(list(s[j : j + n]) == list(flat[k : k + n]) for s in seqs for j in range(len(s) - n + 1))
            assert (m == n and b - a == want) or (want == 1 and b - a == 1)
