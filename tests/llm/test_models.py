"""Quality rules, ranking, toxicity and language-model scores: plain counts, held-out accuracy, awkward rows."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievework.llm import backoff, linear, quality, queries, ranking, toxicity
from sievework.llm import textkernels as K
from tests.llm.fixtures import awkward, empty, labels, rows, thue_morse, words


def plain_counts(t):
    t = t or ""
    w = words(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    tri = Counter(zip(w, w[1:], w[2:], strict=False))
    hit = [False] * len(w)
    for k in range(len(w) - 2):
        if tri[tuple(w[k : k + 3])] > 1:
            hit[k : k + 3] = [True] * 3
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, sum(hit)


EXTRA = ["a b c\na b c\n\n a b c\na b c", "\n\n\n", "x\n", "x\r\nx\r\n", "é é é é\n# $ é é é", "a", "a b", "a b c a b c", "{}\n{}\n{}".format(*thue_morse(), thue_morse()[0])]


def test_base_counts():
    texts = [r[1] or "" for r in rows()] + EXTRA
    got = K.base_counts(pa.array(texts))
    assert list(zip(*(v.tolist() for v in got.values()), strict=True)) == [plain_counts(t) for t in texts]
    assert [len(v) for v in K.base_counts(pa.array([], pa.string())).values()] == [0] * 5
    sliced = pa.array(["zzz", *texts]).slice(1)
    assert K.base_counts(sliced)["n_words"].tolist() == [plain_counts(t)[0] for t in texts]


@pytest.mark.parametrize("keys", [1, 2])
def test_base_counts_compare_bytes_where_keys_are_equal(monkeypatch, keys):
    """With hashes of one or two values all lines and windows share keys."""
    texts = [r[1] or "" for r in rows() if len(r[1] or "") < 3000] + EXTRA
    monkeypatch.setattr(K, "spans_hash", lambda data, starts, ends: ((ends - starts) % keys).astype(np.uint64))
    got = K.base_counts(pa.array(texts))
    assert list(zip(*(v.tolist() for v in got.values()), strict=True)) == [plain_counts(t) for t in texts]


def test_character_ngrams_are_of_code_points():
    texts = ["añb", "añb ñ", "日本語", "", "ab", "a😀é"]
    data, offsets = K.buffers(pa.array(texts))
    points, row = K.code_points(data, offsets)
    assert [bytes(int(p).to_bytes(4, "little")).rstrip(b"\0").decode() for p in points] == list("".join(texts))
    assert row.tolist() == [i for i, t in enumerate(texts) for _ in t]
    got = K.hashed_ngrams(pa.array(texts))[:, : K.CHAR_BUCKETS]
    assert [(r > 0).sum() for r in got] == [len({t[k : k + 3] for k in range(len(t) - 2)}) for t in texts]


def test_span_hashes_tell_words_apart():
    vocabulary = [f"w{i}" for i in range(20_000)] + ["a", "aa", "aaa", "ab", "ba"]
    w = K.Words(pa.array([" ".join(vocabulary)]))
    assert len(set(w.hash.tolist())) == len(vocabulary)
    assert len(set(K.Words(pa.array([" ".join(thue_morse(12))])).hash.tolist())) == 2


def test_quality_rules(spark):
    got = quality.quality_rules(awkward(spark), labels(spark)).collect()
    want = Counter((i, *plain_counts(t)) for i, t in [r[:2] for r in rows()])
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert Counter(tuple(r[n] for n in names) for r in got) == want
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert r["kept"] == (not r["base_failed"] and r["probability"] >= 0.5)


def test_quality_stage_keeps_columns(spark):
    df = awkward(spark)
    got = quality.keep_good(df, labels(spark))
    assert got.schema == df.schema
    kept = Counter(r["doc_id"] for r in quality.quality_rules(df, labels(spark)).where("kept").collect())
    assert Counter(r["doc_id"] for r in got.collect()) == kept


@pytest.mark.parametrize("pairs", [[], [(1, 1, 1)], [(1, 0, 0), (3, 0, 0)], [(None, 1, 1), (2, None, None)]])
def test_models_without_both_labels(spark, pairs):
    lab = labels(spark, pairs)
    n = len(rows())
    assert quality.quality_rules(awkward(spark), lab).count() == n
    for scored in (ranking.rank_quality(awkward(spark), lab), toxicity.score_toxicity(awkward(spark), lab)):
        got = scored.collect()
        assert len(got) == n and all(0 <= r["score"] <= 1 for r in got)


def test_models_empty(spark):
    assert quality.quality_rules(empty(spark), labels(spark)).count() == 0
    assert quality.keep_good(empty(spark), labels(spark)).count() == 0
    assert ranking.rank_quality(empty(spark), labels(spark)).count() == 0
    assert toxicity.score_toxicity(empty(spark), labels(spark)).count() == 0
    assert backoff.backoff_scores(empty(spark)).count() == 0


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(y))
    rank[order] = np.arange(1, len(y) + 1)
    p = y.sum()
    return (rank[y == 1].sum() - p * (p + 1) / 2) / (p * (len(y) - p))


def test_held_out_accuracy(spark):
    """Rows whose label no model has seen: quality almost always, toxicity mostly, no false alarms."""
    sf = "/root/testdata/sf0.01"
    lab = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    ranked = [(r["score"], lab[r["doc_id"]]["quality"], r["predicted"]) for r in queries.op3_quality_ranking(spark, sf).where("held_out").collect() if r["doc_id"] in lab]
    s, y, p = (np.array(x, float) for x in zip(*ranked, strict=True))
    assert auc(s, y) > 0.97 and (p == y).mean() > 0.95
    toxic = [(r["score"], lab[r["doc_id"]]["toxic"], r["predicted"]) for r in queries.op9_toxicity(spark, sf).where("held_out").collect() if r["doc_id"] in lab]
    s, y, p = (np.array(x, float) for x in zip(*toxic, strict=True))
    assert auc(s, y) > 0.8 and ((p == 1) & (y == 0)).sum() <= 2


def test_ranking_orders_pairs():
    rng = np.random.default_rng(0)
    y = (rng.random(400) < 0.7).astype(float)
    X = rng.standard_normal((400, 20)).astype(np.float32)
    X[:, 3] += 4 * y
    r = ranking.learn(X, y, pairs=4000)
    s = X @ r.weights
    assert auc(s, y) > 0.97
    assert abs((s >= r.threshold).mean() - y.mean()) < 0.05


def test_ftrl_is_sparse_and_learns():
    rng = np.random.default_rng(0)
    y = (rng.random(600) < 0.3).astype(float)
    data = [np.unique(np.append(rng.integers(100, 5000, 40), [7] if v else [8])) for v in y]
    m = toxicity.ftrl(data, y)
    weights = dict(zip(m.at.tolist(), m.weights.tolist(), strict=True))
    assert weights[7] > 0.5 and len(weights) < 2500


def test_minimise_solves_logistic_regression():
    rng = np.random.default_rng(0)
    X = rng.standard_normal((500, 5))
    y = (X @ np.array([2.0, -1, 0, 0, 0.5]) + rng.logistic(size=500) > 0).astype(float)
    w, b = linear.logistic(X, y, ridge=1e-9, rounds=200)
    g = X.T @ (linear.sigmoid(X @ w + b) - y) / 500
    assert np.abs(g).max() < 1e-3


def plain_backoff(pairs, order=3, alpha=0.4, least=2):
    counts, total = Counter(), 0
    for _, t in pairs:
        w = words(t)
        total += len(w)
        for n in range(1, order + 1):
            counts.update(tuple(w[k : k + n]) for k in range(len(w) - n + 1))
    out = []
    for i, t in pairs:
        w, s = words(t), 0.0
        for k in range(len(w)):
            factor = 0.0
            for n in range(min(order, k + 1), 1, -1):
                g = tuple(w[k - n + 1 : k + 1])
                if counts[g] >= least:
                    s += factor + math.log(counts[g] / counts[g[:-1]])
                    break
                factor += math.log(alpha)
            else:
                s += factor + math.log(counts[w[k],] / total)
        out.append((i, len(w), s))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_backoff(spark, order, monkeypatch):
    monkeypatch.setattr(backoff, "BLOCK_BYTES", 4000)
    monkeypatch.setattr(backoff, "PART_BYTES", 1000)  # more partitions than many blocks have n-grams
    pairs = [r[:2] for r in rows()]
    got = sorted((str(r["doc_id"]), r["n_tokens"], round(r["log_score"], 5)) for r in backoff.backoff_scores(awkward(spark), order=order).collect())
    assert got == sorted((str(i), n, round(s, 5)) for i, n, s in plain_backoff(pairs, order))


def test_backoff_of_rows_in_changing_order(spark, tmp_path):
    """Rows that come out of a shuffle are written first; stored rows are read as they are."""
    assert not backoff.same_when_read_again(awkward(spark)) and not backoff.same_when_read_again(awkward(spark).orderBy("doc_id"))
    awkward(spark).write.parquet(f"{tmp_path}/docs")
    stored = spark.read.parquet(f"{tmp_path}/docs")
    assert backoff.same_when_read_again(stored.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    one, two = (Counter((r["doc_id"], r["n_tokens"], round(r["log_score"], 9)) for r in backoff.backoff_scores(df).collect()) for df in (stored, awkward(spark)))
    assert one == two


def test_payloads_round_trip():
    lists = [np.array([], np.uint64), np.array([2**64 - 1, 0, 5], np.uint64), np.arange(1000, dtype=np.uint64)]
    assert [x.tolist() for x in backoff.stretch(backoff.squeeze(lists), 3)] == [x.tolist() for x in lists]


def test_backoff_keeps_ngrams_apart_by_whole_hashes(monkeypatch):
    """N-grams whose hashes agree in all but the last bits have counts of their own."""
    near = np.array([5 << 16, (5 << 16) + 1, (5 << 16) + 1], np.uint64)
    monkeypatch.setattr(backoff.K.Words, "windows", lambda self, n: (near.copy(), np.arange(3)))
    grams = backoff.Grams(pa.array(["a b b"]), 1, backoff.HASH_BITS, places=False)
    assert grams.tables[0][0].tolist() == sorted(set(near.tolist())) and grams.tables[0][1].tolist() == [1, 2]
