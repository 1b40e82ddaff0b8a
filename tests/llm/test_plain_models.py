"""The classifiers against plain Python: features, losses and updates one by one, on a small table."""

import math
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievework.llm import linear, quality, ranking, toxicity
from sievework.llm import textkernels as K
from tests.llm.fixtures import empty, passage, rows, words

M = 2**64
SPOTS = [int(x) for x in K.spots(4096)]


def mix(h):
    h = (h ^ (h >> 33)) * 0xFF51AFD7ED558CCD % M
    h = (h ^ (h >> 33)) * 0xC4CEB9FE1A85EC53 % M
    return h ^ (h >> 33)


def plain_hash(word):
    return mix((sum(int(K.BYTE[b]) * SPOTS[i] for i, b in enumerate(word)) + len(word)) % M)


def plain_windows(hashes, k):
    out = []
    for i in range(len(hashes) - k + 1):
        h = 0
        for x in hashes[i : i + k]:
            h = (h * int(K.STEP) + x) % M
        out.append(mix(h))
    return out


def plain_ngrams(text):
    x = [0.0] * K.BUCKETS
    points = [int.from_bytes(c.encode(), "little") for c in text]
    for i in range(len(points) - 2):
        x[sum(p * int(g) for p, g in zip(points[i : i + 3], K.GRAM, strict=True)) % 2**32 >> 20] += 1
    hashes = [plain_hash(w.encode()) for w in words(text)]
    for k, lo in ((1, K.CHAR_BUCKETS), (2, K.CHAR_BUCKETS + K.WORD_BUCKETS)):
        for h in plain_windows(hashes, k):
            x[lo + (h >> 53)] += 1
    x = [math.sqrt(v) for v in x]
    norm = max(math.sqrt(sum(v * v for v in x)), 1e-9)
    return [v / norm for v in x]


def plain_shapes(text):
    w = words(text)
    tri = Counter(zip(w, w[1:], w[2:], strict=False))
    hit = [False] * len(w)
    for k in range(len(w) - 2):
        if tri[tuple(w[k : k + 3])] > 1:
            hit[k : k + 3] = [True] * 3
    lines = [line for line in text.split("\n") if words(line)]
    n, chars = max(len(w), 1), max(sum(map(len, w)), 1)
    return [
        sum(hit) / n, min(sum(c in "#*$%&|<>" for c in text) / n, 4), (len(lines) - len(set(lines))) / (1 + math.log1p(n)) / 4,
        sum("A" <= c <= "Z" for c in text) / chars, min(text.count("!") / n, 4), text.count("|") / n, math.log1p(len(w)) / 10, min(sum(map(len, w)) / n, 20) / 10,
    ]


def small_table():
    """Ids, texts and labels; ids repeat, with one text and with several; more rows than the bounds below."""
    r = random.Random(3)
    out = [(100 + i, passage(500 + i, 60) + (" rude words here" * r.randint(1, 3) if i % 3 == 0 else " kind words there"), int(i % 3 != 0)) for i in range(45)]
    out += [(100, "another text of an id " * 9, None), (100, out[0][1], None), (146, "é ß 中文字 😀 A!! B| c", 1), (147, "", 0), (148, None, 1)]
    return out


def frames(spark):
    docs = spark.createDataFrame([(i, t) for i, t, _ in small_table()], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, y, 1 - y) for i, _, y in small_table() if y is not None], "doc_id long, quality int, toxic int")
    return docs, labels


def chosen(spark, docs, labels, label, bound, halves=False):
    """(id, text, y): one row for each id, by the stated rules, without the operator."""
    hashes = {r[0]: r[1] for r in docs.selectExpr("doc_id", "xxhash64(doc_id)").collect()}
    texts = {}
    for i, t, h in docs.selectExpr("doc_id", "coalesce(text, '') t", "xxhash64(coalesce(text, '')) h").collect():
        texts[i] = min(texts.get(i, (h, t)), (h, t))
    y = {r["doc_id"]: r[label] for r in labels.collect()}
    order = sorted(y, key=lambda i: (hashes[i], i))
    kept = [*[i for i in order if y[i] == 0][: bound // 2], *[i for i in order if y[i] == 1][: bound // 2]] if halves else order[:bound]
    return sorted((i, texts[i][1], y[i]) for i in kept)


@pytest.mark.parametrize("bound", [10, 1000])
def test_samples_are_bounded_in_rows(spark, bound):
    docs, labels = frames(spark)
    for halves in (False, True):
        got = linear.labelled_sample(docs, labels, "toxic", bound, halves=halves).collect()
        assert sorted((r["doc_id"], r["text"], r["y"]) for r in got) == chosen(spark, docs, labels, "toxic", bound, halves)
        assert len(got) <= bound


def test_samples_are_bounded_under_repeated_ids(spark):
    many = spark.createDataFrame([(i % 4, f"text {i}") for i in range(500)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(4)] * 20, "doc_id long, toxic int")
    assert linear.labelled_sample(many, labels, "toxic", 4).count() == 4
    assert linear.labelled_sample(many, labels, "toxic", 2).count() == 2


def test_samples_are_bounded_in_bytes(spark):
    docs, labels = frames(spark)
    sample = linear.labelled_sample(docs, labels, "toxic", 100)
    every = linear.collect_sparse(sample, toxicity.encode)
    most = sum(len(data) for _, data in every) // 3
    some = linear.collect_sparse(sample, toxicity.encode, most)
    assert 0 < len(some) < len(every) and sum(len(data) for _, data in some) <= most
    assert not Counter(some) - Counter(every)
    assert linear.collect_sparse(sample.limit(0), toxicity.encode) == []


def plain_matrix(sample):
    X = np.array([plain_ngrams(t) + plain_shapes(t) for _, t, _ in sample])
    return X, np.array([y for _, _, y in sample], float)


def test_ranking_scores(spark):
    docs, labels = frames(spark)
    X, y = plain_matrix(chosen(spark, docs, labels, "quality", 1000))
    model = ranking.learn(X.astype(np.float32), y)
    for r in ranking.rank_quality(docs.unionByName(empty(spark).select("doc_id", "text")), labels).join(docs.distinct(), "doc_id").collect():
        text = r["text"] or ""
        if r["doc_id"] == 100:
            continue  # an id with two texts, joined with both
        s = sum(w * v for w, v in zip(model.weights.tolist(), plain_ngrams(text) + plain_shapes(text), strict=True))
        want = 1 / (1 + math.exp(-min(max((s - model.threshold) / model.scale, -40), 40)))
        assert abs(r["score"] - want) < 2e-3 and r["predicted"] == (r["score"] >= 0.5)


def test_ranking_minimises_the_pairwise_loss():
    """The Bradley-Terry loss over pairs, summed one by one, has no slope where the weights are."""
    rng = np.random.default_rng(0)
    y = (rng.random(60) < 0.6).astype(float)
    X = rng.standard_normal((60, 6)).astype(np.float32)
    X[:, 2] += y
    pairs, ridge = 600, 1e-2
    w = ranking.learn(X, y, pairs=pairs, ridge=ridge, seed=7).weights
    draw = np.random.default_rng(7)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    i, j = np.resize(draw.permutation(good), pairs), draw.permutation(np.resize(bad, pairs))

    def loss(v):
        total = sum(math.log1p(math.exp(-float((X[a] - X[b]) @ v))) for a, b in zip(i, j, strict=True))
        return total / pairs + ridge * float(v @ v) / 2

    for k in range(6):
        e = np.zeros(6)
        e[k] = 1e-4
        assert abs(loss(w + e) - loss(w - e)) / 2e-4 < 2e-3


def plain_toxic_features(text):
    w = re.findall(rb"[0-9A-Za-z\x80-\xff]+", text.lower().encode())
    h = [plain_hash(x) for x in w]
    out = {*h}
    for size in toxicity.STEMS:
        out |= {mix((plain_hash(x[:size]) + size) % M) for x in w if len(x) > size}
    for gap, salt in ((1, 0x1B), (2, 0x2D)):
        out |= {mix((a * int(K.STEP) + b + salt) % M) for a, b in zip(h, h[gap:], strict=False)}
    return {x >> (64 - toxicity.BITS) for x in out}


def plain_ftrl(sample, alpha=1.0, beta=1.0, l1=4.0, l2=1.0, passes=toxicity.PASSES, seed=11):
    data = [(plain_toxic_features(t), y) for _, t, y in sample]
    count = Counter(f for own, _ in data for f in own)
    z, n, zb, nb = Counter(), Counter(), 0.0, 0.0

    def weight(f):
        if abs(z[f]) <= l1:
            return 0.0
        return -(z[f] - math.copysign(l1, z[f])) / ((beta + math.sqrt(n[f])) / alpha + l2)

    rng = np.random.default_rng(seed)
    for _ in range(passes):
        for i in rng.permutation(len(data)):
            own = [f for f in data[i][0] if count[f] >= 2]
            w = {f: weight(f) for f in own}
            wb = -zb / ((beta + math.sqrt(nb)) / alpha)
            g = 1 / (1 + math.exp(-(sum(w.values()) + wb))) - data[i][1]
            for f in own:
                sigma = (math.sqrt(n[f] + g * g) - math.sqrt(n[f])) / alpha
                z[f] += g - sigma * w[f]
                n[f] += g * g
            zb += g - (math.sqrt(nb + g * g) - math.sqrt(nb)) / alpha * wb
            nb += g * g
    return lambda text: sum(weight(f) for f in plain_toxic_features(text)) - zb / ((beta + math.sqrt(nb)) / alpha)


def test_toxicity_scores(spark):
    docs, labels = frames(spark)
    sample = chosen(spark, docs, labels, "toxic", 1000)
    score = plain_ftrl(sample)
    got = Counter((r["doc_id"], round(r["score"], 6)) for r in toxicity.score_toxicity(docs, labels).collect())
    assert got == Counter((i, round(1 / (1 + math.exp(-score(t or ""))), 6)) for i, t, _ in small_table())


def test_quality_probabilities(spark):
    """The calibrated model of plain features gives the operator's probabilities."""
    docs, labels = frames(spark)
    sample = chosen(spark, docs, labels, "quality", 1000)
    X, y = np.array([plain_ngrams(t) for _, t, _ in sample], np.float32), np.array([y for _, _, y in sample], float)
    w, b = quality.fit(X, y)
    for r in quality.quality_rules(docs, labels).collect():
        texts = [t or "" for i, t, _ in small_table() if i == r["doc_id"]]
        want = [1 / (1 + math.exp(-min(max(sum(p * q for p, q in zip(w.tolist(), plain_ngrams(t), strict=True)) + b, -40), 40))) for t in texts]
        assert min(abs(r["probability"] - x) for x in want) < 1e-3


def test_plain_features_are_the_kernels():
    texts = [t for _, t in [r[:2] for r in rows()] if t and len(t) < 3000]
    got = np.concatenate([K.hashed_ngrams(pa.array(texts)), K.shapes(pa.array(texts))], axis=1)
    assert np.allclose(got, [plain_ngrams(t) + plain_shapes(t) for t in texts], atol=1e-5)


def test_ftrl_holds_its_rows_once_more():
    """Of a sample's features the driver makes one copy of 32-bit places, not several of 64 bits."""
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(0, 50_000, 3000)).astype("<u4") for _ in range(2000)]
    tracemalloc.start()
    toxicity.ftrl(rows, np.arange(2000) % 2.0, passes=1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1.2 * sum(r.nbytes for r in rows) + (16 << 20)


def blocks_of(spark, bound, labels=None):
    docs, every = frames(spark)
    ids = linear.labelled_ids(every if labels is None else labels, "quality")
    counts = Counter(r["y"] for r in ids.collect())
    return linear.labelled_blocks(docs.selectExpr("doc_id", "coalesce(text, '') text"), ids, counts, ranking.features, bound), counts


@pytest.mark.parametrize("bound, rare", [(10, 64), (10, 8), (1000, 64)])
def test_blocks_hold_all_labelled_rows(spark, monkeypatch, bound, rare):
    """Rows of the rarer label are in all blocks, in some of them or in the only one."""
    monkeypatch.setattr(linear, "RARE", rare)
    docs, labels = frames(spark)
    rows, _ = blocks_of(spark, bound)
    found = sorted(rows.collect(), key=lambda r: (r["block"], r["doc_id"]))
    home = {r["doc_id"]: r for r in found if r["home"]}
    want = chosen(spark, docs, labels, "quality", 1000)
    assert sorted(home) == [i for i, _, _ in want] and sum(r["home"] for r in found) == len(want)
    for i, text, y in want:
        x = ranking.features(pa.array([text]))[0]
        assert home[i]["y"] == y
        assert np.frombuffer(home[i]["at"], "<u2").tolist() == np.flatnonzero(x).tolist()
        assert np.frombuffer(home[i]["value"], "<f4").tolist() == x[x != 0].tolist()
    kinds = {b: {r["y"] for r in found if r["block"] == b} for b in {r["block"] for r in found}}
    assert len(kinds) == (1 if bound == 1000 else -(-len(want) // bound)) and all(k == {0, 1} for k in kinds.values())


def test_ranking_of_blocks(spark):
    """The loss of all blocks' pairs, summed one by one, has no slope along any weight that counts; threshold and scale are
    those of all rows."""
    ridge, pairs = 1e-3, 50
    rows, counts = blocks_of(spark, 10)
    model = ranking.learn_blocks(rows, counts[1], counts[0], pairs=pairs, ridge=ridge)
    found = sorted(rows.collect(), key=lambda r: (r["block"], r["doc_id"]))
    X = np.zeros((len(found), ranking.WIDTH))
    for x, r in zip(X, found, strict=True):
        x[np.frombuffer(r["at"], "<u2")] = np.frombuffer(r["value"], "<f4")
    y, block = np.array([r["y"] for r in found]), np.array([r["block"] for r in found])
    s = X @ model.weights
    slope = ridge * model.weights
    total = sum(max(pairs, (y[block == b] == 1).sum(), (y[block == b] == 0).sum()) for b in set(block.tolist()))
    for b in set(block.tolist()):
        own = np.flatnonzero(block == b)
        i, j = ranking.draw(y[own], pairs, ranking.SEED + b)
        for p, q in zip(own[i].tolist(), own[j].tolist(), strict=True):
            slope = slope + (1 / (1 + math.exp(s[q] - s[p])) - 1) / total * (X[p] - X[q])
    assert np.abs(slope).max() < 2e-3 and np.abs(model.weights).max() > 0.1
    home = np.sort(s[[r["home"] for r in found]])
    bad = counts[0]
    at = math.floor(bad / len(home) * (len(home) - 1))
    assert abs(model.threshold - (home[at] + home[at - 1]) / 2) < 1e-5
    assert abs(model.scale - (np.median(home[bad:]) - np.median(home[:bad])) / 8) < 1e-5


def test_blocks_of_one_label_have_no_pairs():
    i, j = ranking.draw(np.ones(5), 20, 7)
    value, row = ranking.pair_loss(np.arange(5.0), i, j)
    assert len(i) == len(j) == 0 and value == 0 and row.tolist() == [0] * 5


def test_ranks_are_selected_exactly(spark):
    s = np.random.default_rng(0).standard_normal(500).round(2).astype(np.float32)
    s[:3] = 0.0, -0.0, -3e38
    keys = spark.createDataFrame([(k,) for k in ranking.ordered_key(s).tolist()], "key long")
    got = [ranking.key_value(k) for k in ranking.select(keys, [0, 1, 250, 499])]
    assert got == np.sort(s)[[0, 1, 250, 499]].tolist()


def test_ranking_learns_from_every_labelled_row(spark):
    """A word that only the rows of the largest hashes hold, beyond the first 4,000, is learnt."""
    order = [r[0] for r in spark.range(4400).orderBy(F.xxhash64("id")).collect()]
    last = set(order[4000:])
    r = random.Random(1)
    words_of = lambda n: " ".join(r.choice(["stone", "river", "cloud", "lamp"]) for _ in range(n))
    rows = [(i, words_of(8) + (" zebra quagga" if i in last else " junk" if i % 2 else ""), int(i not in last and i % 2 == 0)) for i in range(4400)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(9000, "stone river cloud lamp zebra quagga"), (9001, "stone river cloud lamp")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    got = {r["doc_id"]: r["predicted"] for r in ranking.rank_quality(docs, labels).where("doc_id >= 9000").collect()}
    assert got == {9000: 0, 9001: 1}
