"""Expressions: vectors, text, decay, trends, similarity, sequences, schemas."""

import math
from datetime import timedelta

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievework.functions import decay, schema as S, sequences, similarity as M, text, trends, vectors
from sievework.operators.lexical import token_table, tokens_of


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_vectors(spark):
    a, b = vectors.vector([3, 4]), vectors.vector([4, 3])
    assert value(spark, vectors.cosine(a, b)) == pytest.approx(0.96)
    assert value(spark, vectors.cosine(a, vectors.vector([0, 0]))) == 0
    assert value(spark, vectors.normalise(a)) == pytest.approx([0.6, 0.8])
    assert value(spark, vectors.normalise(vectors.vector([0, 1e-12]))) == [0, 1e-12]
    assert value(spark, vectors.truncate(vectors.vector([3, 4, 9]), 2)) == pytest.approx([0.6, 0.8])
    assert value(spark, vectors.softmax(vectors.vector([1000, 1000, 1000 + math.log(2)]))) == pytest.approx([0.25, 0.25, 0.5])
    assert value(spark, vectors.argmax(vectors.vector([1, 5, 5]))) == 1
    pooled = vectors.max_pool(F.array(vectors.vector([-1, 2, 0]), vectors.vector([1, -2, 0])))
    assert value(spark, pooled) == [1, 2, 0]
    assert value(spark, vectors.sparse_activation(pooled)) == pytest.approx({0: math.log(2), 1: math.log(3)})
    assert value(spark, vectors.sparse_activation(pooled, log=False)) == {0: 1.0, 1: 2.0}
    q, d = F.array(a, b), F.array(vectors.vector([1, 0]), vectors.vector([0, 1]))
    assert value(spark, vectors.max_sim(q, d)) == 8


@pytest.mark.parametrize(
    ("source", "tokens"),
    [
        ("chatModel", ["chat", "model", "chatmodel"]),
        ("HTTPClient uses BM25", ["http", "client", "httpclient", "uses", "bm", "25", "bm25"]),
        ("plain words, only", ["plain", "words", "only"]),
        ("snake_case-9x", ["snake", "case", "9", "x", "9x"]),
        ("éa", ["a"]),
        ("", []),
        (None, []),
    ],
)
def test_code_tokens(spark, source, tokens):
    assert value(spark, text.code_tokens(F.lit(source).cast("string"))) == tokens == tokens_of(source)


def test_token_table():
    samples = ["chatModel ChatModel chatmodel CHATMODEL chat", "BM25 bm25 x9 BM-25 HTTPClient", "", None, "a\u0001b aB é1 aİ The THE theThe", "one two", "A1b2C3", "x" * 300 + "Y", "aB", "cD"]
    for column in (pa.array(samples), pa.array(samples, pa.large_string()), pa.array(["zZ9", *samples])[1:]):
        tokens, row = token_table(column)
        got = [[] for _ in samples]
        for token, r in zip(tokens.to_pylist(), row.tolist(), strict=True):
            got[r].append(token)
        assert [sorted(x) for x in got] == [sorted(tokens_of(t)) for t in samples]
    assert len(token_table(pa.array([], pa.string()))[0]) == 0


def test_clean_question(spark):
    for q in ('what "is" a* (b):c^d+e-f?', "  two   words ", "", "tab\tand\nline"):
        assert value(spark, text.plain_question(F.lit(q))) == text.clean_question(q)


def test_text(spark):
    assert value(spark, text.expand_camel(F.lit("use  chatModel\nnow"))) == "use  chatModel chat Model\nnow"
    assert value(spark, text.plain_question(F.lit('what "is" (this)*:  a-b?'))) == "what is this a b?"
    assert value(spark, text.format_confidence(F.lit(0.51235))) == "0.5124"
    assert value(spark, text.parse_confidence(F.lit("x"))) is None
    assert text.trend_name("economy", "SLOPE", "army") == "economy_slope_army"
    assert text.trend_name("economy", "COUNT") == "economy_count"
    assert value(spark, text.dedup_key(F.lit("d"), F.lit("c"))) == "d\0c"
    got = value(spark, text.explanation(F.lit(2), "FEATURE_ONLY", "game", F.lit("c7"), F.lit(0.987), F.lit(0.5), F.create_map(F.lit("a"), F.lit(0.1), F.lit("b"), F.lit(0.9))))
    assert got == "Retrieved 2 cases (mode: FEATURE_ONLY, caseType: game).\nTop match: caseId=c7, score=0.99, confidence=0.50.\nFeature breakdown: b=0.90, a=0.10."
    none = F.lit(None)
    assert value(spark, text.explanation(F.lit(0), "HYBRID", "game", none, none.cast("double"), none.cast("double"), F.create_map().cast("map<string,double>"))) == "Retrieved 0 cases (mode: HYBRID, caseType: game)."


@pytest.mark.parametrize(
    ("source", "metadata", "body"),
    [
        ("---\ntitle: \"A b\"\nk: v: w\n---\nbody\n", {"title": "A b", "k": "v: w"}, "body\n"),
        ("---\nk: 'x'\nk: y\n---", {"k": "y"}, ""),
        ("---\nk: v\nno end", {}, "---\nk: v\nno end"),
        ("plain", {}, "plain"),
        ("---\n---\nb", {}, "b"),
        (None, {}, ""),
    ],
)
def test_front_matter(spark, source, metadata, body):
    got = value(spark, text.front_matter(F.lit(source).cast("string")))
    assert (got["metadata"], got["body"]) == (metadata, body)


def test_decay(spark):
    at = F.lit("2024-01-01").cast("timestamp")
    day = timedelta(days=1)
    assert value(spark, decay.half_life(at, "2024-01-02", day)) == 0.5
    assert value(spark, decay.half_life(at, "2023-12-01", day)) == 1
    assert value(spark, decay.half_life(F.lit(None), "2024-01-02", day)) == 1
    assert value(spark, decay.linear_decay(at, "2024-01-02", 4 * day)) == 0.75
    assert value(spark, decay.linear_decay(at, "2024-02-02", 4 * day)) == 0
    assert value(spark, decay.step_decay(at, "2024-01-02", day, 0.3)) == 0.3
    assert value(spark, decay.scope_factor(F.lit("a"), "a/b/c", base=0.5)) == 0.25
    assert value(spark, decay.scope_factor(F.lit(""), "a/b", "linear", max_depth=4)) == 0.5
    assert value(spark, decay.scope_factor(F.lit("a/b"), "a/b", "step", after=0.2)) == 1
    assert value(spark, decay.outcome_weight(F.lit(1.0), F.lit(0.5))) == pytest.approx(0.85)
    assert value(spark, decay.outcome_weight(F.lit(1.0), F.lit(None))) == 1
    assert value(spark, decay.trust_weight(F.lit(1.0), F.lit(0.5), F.lit(-0.4))) == pytest.approx(0.85 * 0.8)
    assert value(spark, decay.trust_weight(F.lit(1.0), F.lit(0.5), F.lit(-2.0))) == pytest.approx(0.85 * 0.5)
    assert value(spark, decay.trust_weight(F.lit(0.7), F.lit(None), F.lit(-1.0))) == 0.7
    assert value(spark, decay.moved_confidence(F.lit(None), F.lit(0.0))) == pytest.approx(0.8)
    assert value(spark, decay.salience(F.lit(None), at, "2024-01-01 01:00:00")) == 0.5
    assert value(spark, decay.personality_weight(F.lit(None), F.lit(0.5), F.lit("x"), {"x": 2.0}, "2024-01-01")) == 0.5
    assert value(spark, decay.mood_factor(F.lit(None), F.lit(0.0), F.lit(0.0), (0, 0, 0), 0.5)) == 1
    assert value(spark, decay.mood_factor(F.lit(0.0), F.lit(0.0), F.lit(0.0), (0, 0, 0), 0.4)) == pytest.approx(1.2)
    assert value(spark, decay.decay_mood(F.lit(1.0), F.lit(0.0), F.lit(86400.0), day)) == pytest.approx(math.exp(-1))


def plain_change_points(v):
    if len(v) < 3 or np.std(v) == 0:
        return 0
    up = down = n = 0
    for x in v:
        up, down = max(0, up + x - np.mean(v)), max(0, down - x + np.mean(v))
        if max(up, down) > 1.5 * np.std(v):
            up = down = 0
            n += 1
    return n


@pytest.mark.parametrize("v", [[], [2.0], [1.0, 1.0, 1.0], [1.0, 2.0, 4.0, 8.0, 3.0], [0.0] * 5 + [9.0] * 6, [5.0, 1.0, 9.0, 2.0, 2.0, 8.0, 7.0, 1.0]])
def test_trends(spark, v):
    t = [float(3 * i + i % 2) for i in range(len(v))]
    a, b = F.lit(t).cast("array<double>"), F.lit(v).cast("array<double>")
    assert value(spark, trends.slope(a, b)) == pytest.approx(np.polyfit(t, v, 1)[0] if len(v) > 1 else 0, abs=1e-9)
    assert value(spark, trends.volatility(b)) == pytest.approx(np.std(v) if v else 0, abs=1e-9)
    assert value(spark, trends.delta(b)) == (v[-1] - v[0] if v else 0)
    assert value(spark, trends.change_points(b)) == plain_change_points(v)
    assert value(spark, trends.duration(a)) == (t[-1] - t[0] if t else 0)
    h, n = len(v) // 2, len(v)
    want = 0 if n < 4 else (np.polyfit(t[h:], v[h:], 1)[0] - np.polyfit(t[:h], v[:h], 1)[0]) / ((t[h] + t[-1]) / 2 - (t[0] + t[h - 1]) / 2)
    assert value(spark, trends.acceleration(a, b)) == pytest.approx(want, abs=1e-9)


GAME = S.Schema("game", (S.Categorical("race", {("t", "z"): 0.5}), S.Numeric("ratio", 0, 3), S.Text("notes")))


def score(spark, schema, query, weights=None, **case):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in case.items()])
    return row.select(M.score(schema, query, weights).alias("s")).first()["s"]


def test_weighted_score(spark):
    two = S.Schema("c", (S.Categorical("a"), S.Categorical("b")))
    assert score(spark, two, {"a": "x", "b": "y"}, {"a": 3.0, "b": 1.0}, a="x", b="n") == 0.75
    assert score(spark, two, {"a": "x", "b": "y"}, {"a": 1.0, "b": 3.0}, a="x", b="n") == 0.25
    assert score(spark, GAME, {"race": "z"}, race="t") == 0.5
    assert score(spark, GAME, {"ratio": 1.0}, ratio=2.5) == pytest.approx(0.5)
    assert score(spark, GAME, {"ratio": S.Range(1, 2)}, ratio=1.5) == 1
    assert score(spark, GAME, {}, race="t") == 1
    assert score(spark, GAME, {"unknown": "x"}, race="t") == 1
    assert score(spark, GAME, {"race": "t"}, {"race": 0.0}, race="t") == 1
    row = spark.range(1).select(F.lit(None).cast("string").alias("race"), F.lit(3.0).alias("ratio"))
    assert row.select(M.score(GAME, {"race": "t", "ratio": 3.0}).alias("s")).first()["s"] == 0.5
    shares = row.select(M.breakdown(GAME, {"race": "t", "ratio": 3.0}).alias("s")).first()["s"]
    assert shares == {"race": 0.0, "ratio": 0.5}
    own = row.select(M.score(GAME, {"ratio": 3.0}, overrides={"ratio": lambda q, c: F.lit(0.3)}).alias("s")).first()["s"]
    assert own == pytest.approx(0.3)


def test_numeric_specs(spark):
    of = lambda q, x, lo, hi, *spec: value(spark, M.numeric(q, F.lit(x), lo, hi, *spec))
    assert of(5.0, 5.0, 3, 3) == 1 and of(5.0, 6.0, 3, 3) == 0
    assert of(0.0, 0.5, 0, 1, "gaussian", 0.5) == pytest.approx(math.exp(-0.5))
    assert of(0.0, 0.1, 0, 1, "step", 0.1) == 1 and of(0.0, 0.2, 0, 1, "step", 0.1) == 0
    assert of(0.0, 0.5, 0, 1, "exponential", 2.0) == pytest.approx(math.exp(-1))
    assert of(0.0, 9.0, 0, 1) == 0


def test_lists(spark):
    of = lambda q, c: value(spark, M.list_jaccard(q, F.lit(c).cast("array<string>")))
    assert of(["a", "b"], ["b", "c"]) == pytest.approx(1 / 3)
    assert of([], ["b"]) == 1 and of(["a"], []) == 0
    empty = F.array().cast("array<string>")
    assert value(spark, M.jaccard(empty, empty)) == 0
    assert value(spark, M.numeric_list([0.0, 10.0], F.lit([1.0, 8.0]), 0, 10)) == pytest.approx(0.85)
    assert value(spark, M.numeric_list([0.0], F.array().cast("array<double>"), 0, 10)) == 0
    fields = (S.Numeric("n", 0, 10), S.Categorical("c"))
    items = F.array(F.struct(F.lit(5.0).alias("n"), F.lit("x").alias("c")), F.struct(F.lit(9.0).alias("n"), F.lit("y").alias("c")))
    assert value(spark, M.object_list([{"n": 5.0, "c": "y"}], items, fields)) == pytest.approx(0.8)
    assert value(spark, M.inner({}, items[0], fields)) == 1


SERIES = S.TimeSeries("s", "t", (S.Numeric("t", 0, 1), S.Numeric("v", 0, 10)))


def points(*v):
    return [{"t": float(i), "v": float(x)} for i, x in enumerate(v)]


def plain_dtw(a, b):
    n, m = len(a), len(b)
    c = np.full((n + 1, m + 1), np.inf)
    c[0, 0] = 0
    for i in range(n):
        for j in range(m):
            c[i + 1, j + 1] = abs(a[i] - b[j]) / 10 + min(c[i, j], c[i, j + 1], c[i + 1, j])
    return 1 / (1 + c[n, m] / max(n, m))


def test_dtw(spark):
    f = sequences.scorable(SERIES)
    rng = np.random.default_rng(0)
    for _ in range(20):
        a, b = rng.uniform(0, 10, rng.integers(1, 9)), rng.uniform(0, 10, rng.integers(1, 9))
        x, y = sequences.to_matrix(points(*a), f), sequences.to_matrix(points(*b), f)
        assert sequences.dtw_score(x, y) == pytest.approx(plain_dtw(a, b))
        path = sequences.dtw_path(x, y)
        assert path[0] == (0, 0) and path[-1] == (len(a) - 1, len(b) - 1)
        assert sequences.dtw_score(x, y, window=0) <= sequences.dtw_score(x, y) + 1e-12
    none, one = sequences.to_matrix([], f), sequences.to_matrix(points(1), f)
    assert sequences.dtw_score(none, none) == 1 and sequences.dtw_score(none, one) == 0
    assert sequences.dtw_score(sequences.to_matrix(points(*[1] * 10), f), one, slope=2.0) == 0
    assert sequences.dtw_score(sequences.to_matrix(points(9, 9), f), sequences.to_matrix(points(0, 0), f), abandon=0.1) == 0
    row = spark.createDataFrame([(points(1, 2, 3),), (None,)], "s array<struct<t:double,v:double>>")
    assert [r["v"] for r in row.select(sequences.dtw(points(1, 2, 3), F.col("s"), SERIES).alias("v")).collect()] == [1.0, None]
    pairs = row.where("s is not null").select(sequences.dtw_alignment(points(1, 2, 3), F.col("s"), SERIES).alias("v")).first()["v"]
    assert [(p["i"], p["j"]) for p in pairs] == [(0, 0), (1, 1), (2, 2)]


def test_lower_bound_is_one(spark):
    rng = np.random.default_rng(1)
    f = sequences.scorable(SERIES)
    for _ in range(10):
        a, b = rng.uniform(0, 10, 6), rng.uniform(0, 10, 6)
        got = value(spark, sequences.lower_bound(a.tolist(), F.lit(b.tolist()), 2, 10.0))
        want = sum(max(a[i] - max(b[max(0, i - 2) : i + 3]), min(b[max(0, i - 2) : i + 3]) - a[i], 0) for i in range(6)) / 10
        assert got == pytest.approx(want)
        cost = sequences.dtw_costs(sequences.to_matrix(points(*a), f), sequences.to_matrix(points(*b), f), window=2)
        assert got <= cost[-1, -1] + 1e-9


def test_batch_kernels_are_the_pair_kernels():
    rng = np.random.default_rng(0)
    for trial in range(120):
        n = int(rng.integers(0, 9))
        q, cases = rng.random((n, 2)), [rng.random((int(rng.integers(0, 9)), 2)) for _ in range(7)]
        if n and trial % 5 == 0:
            q[0, 0] = np.nan
        window = (None, 0, 2, 4)[trial % 4]
        slope, abandon = None if window is not None else (None, 1.5, 2.0)[trial % 3], (None, 0.7, 3)[trial % 3]
        assert sequences.dtw_scores(q, cases, window, slope, abandon) == pytest.approx([sequences.dtw_score(q, c, window, slope, abandon) for c in cases])
        a, lists = [str(x) for x in rng.integers(0, 4, n)], [[str(x) for x in rng.integers(0, 5, int(rng.integers(0, 7)))] for _ in range(6)]
        costs, table = ((1.0, 1.0), (0.5, 0.25), (2.0, 1.0))[trial % 3], (None, {("0", "1"): 0.5})[trial % 2]
        assert sequences.edit_scores(a, lists, costs, table) == pytest.approx([sequences.edit_score(a, c, costs, table) for c in lists])


def test_edit_expression(spark):
    lists = [["a", "b", "c"], [], ["x", "y"], ["a"], None, ["b", "a", "x", "c", "c"]]
    rows = spark.createDataFrame([(x,) for x in lists], "l array<string>")
    for query in (["a", "b"], [], ["a", "b", "b", "c"]):
        for table in (None, {("a", "x"): 0.5}):
            got = [r["v"] for r in rows.select(sequences.edit(query, F.col("l"), table=table).alias("v")).collect()]
            assert got == [None if x is None else pytest.approx(sequences.edit_score(query, x, table=table)) for x in lists]


def test_edit(spark):
    assert sequences.edit_score("kitten", "sitting") == pytest.approx(1 - 3 / 7)
    assert sequences.edit_score([], []) == 1 and sequences.edit_score(["a"], []) == 0
    assert sequences.edit_score(["a", "b"], ["a", "c"], table={("c", "b"): 0.5}) == pytest.approx(0.75)
    assert sequences.edit_score(["a"], ["b"], costs=(0.2, 0.2)) == 0
    ops = [(o["op"], o["i"], o["j"]) for o in sequences.edit_ops("abc", "axcd")]
    assert ops == [("MATCH", 0, 0), ("SUBSTITUTE", 1, 1), ("MATCH", 2, 2), ("INSERT", -1, 3)]
    row = spark.createDataFrame([(["a", "b"],), ([],), (None,)], "l array<string>")
    assert [r["v"] for r in row.select(sequences.edit(["a", "b"], F.col("l")).alias("v")).collect()] == [1.0, 0.0, None]
    assert [len(r["v"] or []) for r in row.select(sequences.edit_script(["a", "b"], F.col("l")).alias("v")).collect()] == [2, 2, 0]


def test_schema(spark):
    assert S.Range.around(10, 0.1) == S.Range(9, 11)
    assert S.typed({"a": [True, 2]}) == {"a": ["true", 2.0]}
    with pytest.raises(ValueError):
        S.Range(2, 1)
    with pytest.raises(ValueError):
        S.check_query(GAME, {"ratio": "x"})
    with pytest.raises(ValueError):
        S.check_query(S.Schema("s", (SERIES,)), {"s": points(1, 2)[::-1]})
    S.check_query(GAME, {"ratio": 1, "else": object})
    grown = S.Schema("g", (S.TimeSeries("s", "t", SERIES.fields, trends=("slope", "count")),)).expanded()
    assert [f.name for f in grown.fields] == ["s", "s_slope_v", "s_count"]
    rules = S.Schema("r", (S.NumericList("n", 0, 10), SERIES))
    rows = spark.createDataFrame([([1.0], points(1, 2)), ([11.0], points(1, 2)[::-1]), (None, None)], "n array<double>, s array<struct<t:double,v:double>>")
    good, bad = S.split_valid(rows, rules)
    assert good.count() == 2 and bad.first()["faults"] == ["n", "s"]
    assert len(S.PERSONALITY_TRANSITION.fields) == 7
