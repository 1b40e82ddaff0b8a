"""Operators over small tables: filters, fusion, cases, memory, analytics, retrieval, evaluation, models."""

import math
from datetime import timedelta

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from sievework.functions import schema as S, vectors
from sievework.operators import analytics, cases as C, evaluation as E, filters as P, fusion, lexical, memory as M, models, retrieval as R, vector_search as V
from sievework.plans.components import connected_components
from sievework.sources import logs


def ids(df, column="id"):
    return sorted(r[column] for r in df.select(column).collect())


def test_payload_filters(spark):
    rows = [(1, {"a": "x", "n": "5"}, {"t": ["p", "q"]}), (2, {"a": "y", "n": "z"}, {}), (3, {}, None)]
    df = spark.createDataFrame(rows, "id int, metadata map<string,string>, lists map<string,array<string>>")
    hits = lambda f: ids(df.where(P.payload(f, lists="lists")))
    assert hits(P.Eq("a", "x")) == [1]
    assert hits(P.Not(P.Eq("a", "x"))) == [2, 3]
    assert hits(P.In("t", ("q",))) == [1] and hits(P.In("a", ("x", "y"))) == [1, 2]
    assert hits(P.And((P.In("a", ("x", "y")), P.Not(P.Eq("a", "y"))))) == [1]
    assert hits(P.Or((P.Eq("a", "y"), P.Not(P.In("a", ("x", "y")))))) == [2, 3]
    assert hits(P.Between("n", 5, 5)) == [1] and hits(P.Between("n", high=4)) == [] and hits(P.Not(P.Between("n", 0))) == [2, 3]
    with pytest.raises(ValueError):
        P.payload(P.And(()))


def test_case_filters(spark):
    df = spark.createDataFrame([(1, ["a", "b"], [1.0, 9.0], [("x", 2.0)]), (2, ["c"], [], []), (3, None, None, None)], "id int, l array<string>, n array<double>, o array<struct<k:string,v:double>>")
    hits = lambda f, c: ids(df.where(P.case_filter(f, c)))
    assert hits(P.Contains("a"), "l") == [1] and hits(P.NotContains("a"), "l") == [2]
    assert hits(P.ContainsAll(("a", "b")), "l") == [1] and hits(P.ContainsAny(("b", "c")), "l") == [1, 2]
    assert hits(P.NotContainsAny(("a", "x")), "l") == [2]
    assert hits(P.ContainsRange(S.Range(8, 10)), "n") == [1]
    assert hits(P.HasMatch({"k": "x", "v": S.Range(1, 3)}), "o") == [1] and hits(P.HasMatch({"k": "x", "v": 3.0}), "o") == []
    assert hits(P.AllOf((P.Contains("a"), P.NotContains("c"))), "l") == [1]
    with pytest.raises(ValueError):
        P.AllOf((P.Contains("a"),))


def test_scopes_and_validity(spark):
    assert P.ancestors("a/b") == ["a/b", "a", ""]
    df = spark.createDataFrame([(1, ""), (2, "a"), (3, "a/b"), (4, "ab")], "id int, scope string")
    assert ids(df.where(P.visible("scope", "a/b"))) == [1, 2, 3] and ids(df.where(P.visible("scope", ""))) == [1]
    assert ids(df.where(P.within("scope", "a"))) == [2, 3] and len(ids(df.where(P.within("scope", "")))) == 4
    t = spark.sql("SELECT * FROM VALUES (1, timestamp'2024-01-01', timestamp'2024-01-03'), (2, timestamp'2024-01-02', null), (3, null, timestamp'2020-01-01'), (4, timestamp'2024-01-01', timestamp'2024-01-02') AS v(id, a, b)")
    assert ids(t.where(P.valid_at("a", "b", "2024-01-02"))) == [1, 2, 3]
    stamped = P.stamp(spark.createDataFrame([({"k": "v", "x": "1"},)], "metadata map<string,string>"), {"x": "2", "_t": F.lit(3)}).first()["metadata"]
    assert stamped == {"k": "v", "x": "2", "_t": "3"}


def legs(spark, rows):
    return spark.createDataFrame(rows, "leg string, id string, score double")


def scores(df):
    return {r["id"]: pytest.approx(r["score"]) for r in df.collect()}


def test_fusion(spark):
    disjoint = legs(spark, [("a", "x", 9.0), ("b", "y", 1.0)])
    assert scores(fusion.reciprocal_rank(disjoint)) == {"x": 0.5, "y": 0.5}
    same = legs(spark, [("a", "x", 9.0), ("b", "x", 1.0)])
    assert scores(fusion.reciprocal_rank(same)) == {"x": 1.0}
    assert scores(fusion.reciprocal_rank(same, weights={"a": 1.0, "b": 0.0})) == {"x": 1.0}
    assert scores(fusion.reciprocal_rank(disjoint, weights={"a": 1.0, "b": -0.5})) == {"x": 2.0}
    two = legs(spark, [("a", "x", 2.0), ("a", "y", 1.0), ("b", "y", 5.0), ("b", "x", 5.0)])
    assert scores(fusion.convex(two, {"a": 0.6, "b": 0.4})) == {"x": 1.0, "y": 0.4}
    assert scores(fusion.convex(legs(spark, [("a", "x", 7.0)]))) == {"x": 1.0}
    assert fusion.convex(two, {"a": 0.0, "b": 0.0}).count() == 0
    assert scores(fusion.distribution(legs(spark, [("a", "x", 3.0)]))) == {"x": 0.5}
    assert [r["id"] for r in fusion.reciprocal_rank(two, top_k=1, names=["a", "b"]).collect()] == ["x"]
    sets = [spark.createDataFrame([("x", 1), ("y", 1)], "id string, n int"), spark.createDataFrame([("y", 2), ("z", 2)], "id string, n int")]
    assert {r["id"]: r["n"] for r in fusion.first_of(sets).collect()} == {"x": 1, "y": 1, "z": 2}
    by = two.withColumn("q", F.lit(1)).unionByName(disjoint.withColumn("q", F.lit(2)))
    assert fusion.reciprocal_rank(by, by=["q"], top_k=1).count() == 2


def test_bm25(spark):
    df = spark.createDataFrame([(1, "cat sat cat"), (2, "dog sat"), (3, ""), (4, None)], "id int, text string")
    n, mean = 4, 5 / 4
    idf = lambda d: math.log((n - d + 0.5) / (d + 0.5) + 1)
    tf = lambda f, length: f * 2.2 / (f + 1.2 * (0.25 + 0.75 * length / mean))
    assert scores(lexical.bm25(df, "cat Sat")) == {1: idf(1) * tf(2, 3) + idf(2) * tf(1, 3), 2: idf(2) * tf(1, 2)}
    assert scores(lexical.bm25(df, "cat cat")) == {1: 2 * idf(1) * tf(2, 3)}
    assert lexical.bm25(df, "none").count() == 0 and lexical.bm25(df, "!").count() == 0
    assert ids(lexical.bm25(df, "sat", predicate=F.col("id") > 1)) == [2]
    many = lexical.bm25_many(df, spark.createDataFrame([("q", "cat sat")], "query_id string, query string"), 5)
    assert scores(many) == scores(lexical.bm25(df, "cat sat"))


def test_stored_postings(spark, tmp_path):
    texts = ["cat sat cat", "dog sat", "", None, "CatSat cat9 sat", "cat sat cat", "none of these"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    index = lexical.build_index(df, f"file://{tmp_path}/index", buckets=4)
    for q in ("cat Sat", "cat cat dog", "9", "missing", "!"):
        assert scores(index.search(spark, q)) == pytest.approx(scores(lexical.bm25(df, q)))
    best = [(r["id"], r["score"]) for r in index.search(spark, "cat sat", 2).collect()]
    assert [i for i, _ in best] == [0, 5] and best[0][1] == best[1][1]
    assert ids(index.search(spark, "cat sat", only=df.where("id > 3"))) == [4, 5]
    asked = spark.createDataFrame([("a", "cat sat"), ("b", "dog dog"), ("c", "missing")], "query_id string, query string")
    for found in (index.search_many(spark, asked, 5), lexical.bm25_many(df, asked, 5)):
        got = {(r["query_id"], r["id"]): pytest.approx(r["score"]) for r in found.collect()}
        assert got == {(q, i): s for q, t in (("a", "cat sat"), ("b", "dog dog")) for i, s in scores(lexical.bm25(df, t)).items()}
    plan = index.postings(spark, ["cat"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "PushedFilters: [IsNotNull(term), EqualTo(term,cat)]" in plan
    none = lexical.build_index(df.limit(0), f"file://{tmp_path}/none")
    assert none.search(spark, "cat").count() == 0


def test_near_copies_are_all_found(spark):
    """Random, clustered, null and zero vectors, against all pairs."""
    rng = np.random.default_rng(2)
    base = rng.standard_normal((20, 8))
    vectors = [(base[i % 20] + 0.25 * rng.standard_normal(8)).tolist() for i in range(400)] + [None, [0.0] * 8, [None] + [1.0] * 7]
    df = spark.createDataFrame(list(enumerate(vectors)), "id long, embedding array<double>").repartition(5)
    new, stored = df.where("id % 3 = 0"), df.where("id % 3 > 0")
    X = np.array([v if v is not None and None not in v else [0.0] * 8 for v in vectors])
    unit = X / np.maximum(np.linalg.norm(X, axis=1, keepdims=True), 1e-9)
    for threshold in (0.5, 0.9, 0.95, 0.99):
        hit = (unit[0::3] @ unit[np.arange(len(X)) % 3 > 0].T >= threshold).any(1)
        want = [i for i, h in zip(range(0, len(X), 3), hit, strict=True) if not h]
        assert ids(V.without_near_copies(new, stored, threshold, pivots=6, block=16)) == want
    assert ids(V.without_near_copies(new, stored.limit(0), 0.9)) == list(range(0, len(X), 3))


def test_vector_search(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [0.0, 1.0])], "id long, embedding array<float>")
    assert [r["id"] for r in V.dense_top_k(df, [1.0, 0.1], 2).collect()] == [1, 2]
    many = V.dense_top_k_many(df, {"a": [1, 0], "b": [0, 1]}, 1)
    assert {r["query_id"]: r["id"] for r in many.collect()} == {"a": 1, "b": 3}
    new = spark.createDataFrame([(9, [1.0, 0.01]), (10, [0.5, -0.5])], "id long, embedding array<float>")
    assert ids(V.without_near_copies(new, df)) == [10]
    odd = df.unionByName(spark.createDataFrame([(4, None), (5, [0.0, 0.0])], df.schema))
    assert {r["id"] for r in V.dense_top_k_many(odd, {"a": [1, 0]}, 9).collect()} == {1, 2, 3}
    sparse = spark.createDataFrame([(1, {5: 2.0}), (2, {6: 1.0, 5: 1.0}), (3, {7: 1.0})], "id int, tokens map<int,float>")
    assert scores(V.sparse_top_k(sparse, {5: 1.0, 6: 3.0})) == {1: 2.0, 2: 4.0}
    late = spark.createDataFrame([(1, [[1.0, 0.0]]), (2, [[0.0, 1.0], [1.0, 0.0]])], "id int, vectors array<array<float>>")
    assert scores(V.late_interaction(late, [[1, 0], [0, 1]])) == {1: 1.0, 2: 2.0}


CASE = "tenant_id string, case_id string, case_type string, domain string, scope string, race string, ratio double, stored_at string, confidence double, trust double, producer string, superseded boolean, superseded_at timestamp, superseded_by string, superseded_reason string, reinstated_at timestamp"


def cases(spark):
    rows = [("t", f"c{i}", "g", "d", s, race, r, f"2024-01-0{i + 1}", c, tr, f"p{i % 2}", False, None, None, None, None) for i, (s, race, r, c, tr) in enumerate([("a", "z", 1.0, 1.0, 0.9), ("a/b", "z", 2.0, 0.0, 0.2), ("", "t", 1.0, None, None), ("x", "z", 1.0, 1.0, 1.0)])]
    return spark.createDataFrame(rows, CASE).withColumn("stored_at", F.col("stored_at").cast("timestamp"))


SCHEMA = S.Schema("g", (S.Categorical("race"), S.Numeric("ratio", 0, 4)))


def test_case_retrieval(spark):
    df = cases(spark).where(P.identity("t", "d", "g", "a/b", "2024-01-01"))
    assert ids(df, "case_id") == ["c0", "c1", "c2"]
    got = C.similar(df, SCHEMA, {"race": "z", "ratio": 1.0}, least=0.5, k=2)
    assert [(r["case_id"], r["score"]) for r in got.collect()] == [("c0", 1.0), ("c1", 0.875)]
    staged = C.similar(df, SCHEMA, {"race": "z", "ratio": 1.0}, stages=[C.temporal("2024-01-03", span=timedelta(days=1)), C.scoped("a/b"), C.by_outcome(), C.by_trust()], k=3)
    want = {"c0": 0.25 * 0.5 * 1 * (0.7 + 0.3 * 0.9), "c1": 0.875 * 0.5 * 0.7 * (0.7 + 0.3 * 0.2), "c2": 0.5 * 0.25}
    assert {r["case_id"]: pytest.approx(r["score"]) for r in staged.collect()} == want
    now = spark.createDataFrame([("p0", 0.5)], "producer string, current_trust double")
    moved = C.by_trust(now=now)(df.withColumn("score", F.lit(1.0)))
    assert {r["case_id"]: pytest.approx(r["score"]) for r in moved.collect()}["c0"] == (0.7 + 0.27) * 0.8
    many = C.similar_many(df, SCHEMA, {"a": {"race": "t"}, "b": {"race": "z"}}, 1)
    assert {r["query_id"]: r["case_id"] for r in many.collect()} == {"a": "c2", "b": "c0"}
    assert [C.effective_mode(*x) for x in (("HYBRID", False, "p"), ("SEMANTIC_ONLY", True, None), ("HYBRID", True, "p"))] == ["FEATURE_ONLY", "NONE", "HYBRID"]
    rr = C.reranked(models.pair_model(models.word_overlap), "z a", "race")(df.withColumn("score", F.lit(0.5)))
    assert all(0.5 <= r["score"] < 1 for r in rr.collect())


def test_case_lifecycle(spark):
    df = cases(spark)
    gone = C.supersede(df, "t", "c0", "2024-02-01", "c9", "old")
    again = C.supersede(gone, "t", "c0", "2024-03-01", reason="older").where("case_id = 'c0'").first()
    assert (again["superseded"], str(again["superseded_at"]), again["superseded_by"], again["superseded_reason"]) == (True, "2024-02-01 00:00:00", "c9", "older")
    back = C.reinstate(gone, "t", "c0", "2024-04-01").where("case_id = 'c0'").first()
    assert not back["superseded"] and back["superseded_at"] is None and back["reinstated_at"] is not None
    assert ids(gone.where(P.identity("t")), "case_id") == ["c1", "c2", "c3"]
    assert ids(C.purge(df, "2024-01-02", 2, 0.5), "case_id") == ["c2", "c3"]
    left, counts = C.trust_sweep(df, spark.createDataFrame([("p1", 0.1)], "producer string, current_trust double"))
    assert ids(left, "case_id") == ["c0", "c2"] and counts.first()["purged"] == 2
    twice = df.unionByName(df.where("case_id = 'c0'").withColumns({"ratio": F.lit(9.0), "stored_at": F.lit("2024-05-01").cast("timestamp")}))
    assert C.latest(twice).where("case_id = 'c0'").first()["ratio"] == 9 and C.latest(twice).count() == 4
    ev = spark.createDataFrame([("c", "2024-01-02", 1, 0.0), ("c", "2024-01-01", 2, 1.0), ("c", "2024-01-02", 3, 0.5)], "case_id string, observed_at string, seq int, rate double")
    r = C.fold_outcomes(ev).first()
    assert (r["confidence"], r["applied"]) == (pytest.approx(0.8), 2)
    steps = spark.createDataFrame([("c1", "s", "w", "ok", 1), ("c2", "s", "v", "ok", 2), ("c2", "u", None, None, 1)], "case_id string, step string, worker string, outcome string, priority int")
    got = {x["step"]: x for x in C.step_consensus(steps).collect()}
    assert got["s"]["outcomes"] == {"ok": 2} and got["s"]["cases"] == ["c1", "c2"] and got["u"]["workers"] is None


def test_memory(spark):
    rows = [(f"m{i}", "t", "e", "d", None, txt, {"k": str(i % 2)}, f"2024-01-0{i + 1}", imp) for i, (txt, imp) in enumerate([("red cat", 0.1), ("blue cat cat", None), ("Red dog", 0.9)])]
    df = spark.createDataFrame(rows, "memory_id string, tenant_id string, entity_id string, domain string, case_id string, text string, attributes map<string,string>, created_at string, importance double").withColumn("created_at", F.col("created_at").cast("timestamp"))
    order = lambda q, **k: [r["memory_id"] for r in M.query(df, q, **k).collect()]
    assert order(M.Query("t", ["e"])) == ["m2", "m1", "m0"]
    assert order(M.Query("t", ["e"], since="2024-01-02", limit=1)) == ["m2"]
    assert order(M.Query("t", ["e"], question="RED")) == ["m2", "m0"]
    assert order(M.Query("t", ["e"], question="(cat)", order=M.Order.RELEVANCE)) == ["m1", "m0"]
    assert order(M.Query("t", ["e"], order=M.Order.SALIENCE), as_of="2024-01-04") == ["m2", "m1", "m0"]
    assert order(M.Query("other", ["e"])) == []
    assert ids(M.scan(df, "t", 2, "m0"), "memory_id") == ["m1", "m2"] and ids(M.scan(df, "t", 5, attribute=("k", "1")), "memory_id") == ["m1"]
    assert M.tenants(df, "d").count() == 1 and M.tenants(df, "x").count() == 0
    left, n = M.erase(df, M.erased("t", "e", memory_id="m1"))
    assert ids(left, "memory_id") == ["m0", "m2"] and n.first()["erased"] == 1
    assert ids(df.where(M.purged("2024-01-03", 0.5)), "memory_id") == ["m0"]
    assert df.where(M.purged()).count() == 0
    for bad in (lambda: M.Query("t", []), lambda: M.Query("t", ["e"], limit=0), lambda: M.require_tenant("a", "b"), lambda: M.erase_everywhere(df, "e", False), lambda: M.require(set(), M.Capability.GRAPH)):
        with pytest.raises((ValueError, PermissionError, NotImplementedError)):
            bad()
    assert M.reflections("t", "a").limit == 15 and list(M.relationships("t", "a", "b").entity_ids) == ["a", "b"]
    ev = df.withColumns({"agent": F.lit("a"), "who": F.when(F.col("memory_id") == "m0", "a").otherwise("b")})
    made = M.record(ev, "experience", "agent", "text", {"target": "who"}, F.col("attributes"))
    assert made.first()["attributes"] == {"k": "0", "target": "a"} and not made.first()["quarantined"]
    assert M.relationships_of(made).count() == 2
    clash = M.record(ev, "experience", "agent", "text", {"target": "who"}, F.create_map(F.lit("target"), F.lit("x")))
    assert clash.first()["quarantined"]
    steps = [(2, None, lambda d: d.withColumn("z", F.col("y") + 1), False), (1, F.col("memory_id") == "m0", lambda d: d.withColumn("y", F.lit(1)), False), (3, None, lambda d: d.select("nothing"), True)]
    assert {r["memory_id"]: r["z"] for r in M.enrich(df, steps).collect()} == {"m0": 2, "m1": None, "m2": None}


def test_analytics(spark):
    records = spark.createDataFrame([("r1", "A ", "2024-01-01"), ("r2", "a", "2024-01-02"), ("r3", "b", "2024-01-03"), ("r4", "c", "2024-01-04")], "retrieval_id string, query_text string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    found = spark.createDataFrame([("r1", "x", 1.0), ("r1", "y", 0.5), ("r2", "x", 0.5), ("r3", "x", 0.2)], "retrieval_id string, doc string, score double")
    judged = spark.createDataFrame([("r1", "x", "RELEVANT", "2024-01-01"), ("r1", "x", "NOT_RELEVANT", "2024-01-05")], "retrieval_id string, doc string, outcome string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert analytics.last_feedback(judged).first()["outcome"] == "NOT_RELEVANT"
    s = {r["doc"]: r for r in analytics.document_stats(records, found, judged).collect()}
    assert (s["x"]["retrievals"], s["x"]["relevant"], s["x"]["not_relevant"], s["y"]["relevant"]) == (3, 0, 1, 0)
    freq = {r["query_text"]: r["avg_score"] for r in analytics.query_frequency(records, found).collect()}
    assert freq == {"A ": 0.75, "a": 0.5, "b": 0.2, "c": 0.0}
    assert [r["query_text"] for r in analytics.zero_hits(records, found).collect()] == ["c"]
    g = {(r["query"], r["doc"]): r["together"] for r in analytics.correlation_graph(records, found, judged).collect()}
    assert g == {("a", "x"): 2, ("a", "y"): 1, ("b", "x"): 1}
    pairs = analytics.jaccard_pairs(analytics.correlation_graph(records, found, judged), 0.5)
    assert [(r["q1"], r["q2"], r["jaccard"]) for r in pairs.collect()] == [("a", "b", 0.5)]
    c = analytics.query_clusters(analytics.correlation_graph(records, found, judged), 0.5).first()
    assert (c["cluster"], c["size"], c["least_jaccard"], c["shared"]) == ("a", 2, 0.5, ["x"])
    assert ids(logs.retrieved_documents(found, records, "2024-01-03", "2024-02-01"), "doc") == ["x"]
    kept = logs.older_removed(records, found, judged, "2024-01-02")
    assert [k.count() for k in kept] == [3, 2, 0]
    n, r = analytics.bands(0.5)
    assert n * r == 128
    stats = analytics.feature_statistics(spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,)], "v double"), "v").first()
    assert (stats["median"], stats["p75"]) == (2.0, 3.0)
    assert analytics.calibrate(spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,)], "score double")).first()["correct_from"] == 3.25


def test_minhash_estimates(spark):
    a, b = [str(i) for i in range(100)], [str(i) for i in range(50, 150)]
    df = spark.createDataFrame([(a, b)], "a array<string>, b array<string>")
    got = df.select(analytics.estimated_jaccard(analytics.minhash("a"), analytics.minhash("b")).alias("j")).first()["j"]
    assert abs(got - 1 / 3) < 0.15


def test_minhash_estimates_without_pairs(spark, sf, tmp_path):
    """Queries that no other comes near give SQL's row, too."""
    con = duckdb.connect()
    con.execute(f"CREATE TABLE events AS SELECT * FROM read_parquet('{sf}/events.parquet') WHERE CAST(json_extract(props, '$.k') AS INTEGER) = 1")
    con.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    want = con.execute(driver.oracle_sql()["minhash_estimates"]).fetchall()
    got = driver.queries()["minhash_estimates"](spark, str(tmp_path))
    assert [tuple(r) for r in got.collect()] == want == [(0, True)]


def test_components(spark):
    pairs = [(i, i + 1) for i in range(30)] + [(50, 51), (51, 50), (52, 52), (60, 61), (62, 61), (None, 3)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {50: 50, 51: 50, 60: 60, 61: 60, 62: 60}


def test_retrieval(spark):
    first = spark.createDataFrame([(f"d{i}", "c", s, i) for i, s in enumerate([0.9, 0.1, 0.5])], "doc string, content string, score double, position int")
    wider = spark.createDataFrame([(f"d{i}", "c", s, i) for i, s in enumerate([0.9, 0.1, 0.5, 0.8, 0.2, 0.6])], "doc string, content string, score double, position int")
    got = R.corrective(first, wider, 3, lambda _: R.grade("score"))
    assert [r["doc"] for r in got.collect()] == ["d0", "d3", "d2"]
    enough = R.corrective(first, wider, 2, lambda _: R.grade("score"))
    assert [r["doc"] for r in enough.collect()] == ["d0", "d2"]
    assert R.grade_counts(first.withColumn("grade", R.grade("score"))).first().asDict() == {"correct": 1, "ambiguous": 1, "incorrect": 1}
    ranked = R.rerank(first.withColumnRenamed("doc", "id"), lambda _: -F.col("first_score"), 2)
    assert [r["id"] for r in ranked.collect()] == ["d1", "d2"]
    v = spark.createDataFrame([(0, [1.0, 0.0], [0.0, 1.0]), (1, [1.0, 0.0], [1.0, 0.1]), (2, [1.0, 0.0], [0.0, 1.0])], "variant int, original_vector array<double>, expanded_vector array<double>")
    assert ids(R.without_drift(v), "variant") == [0, 1]
    q = R.expand(spark.createDataFrame([("a", "t")], "query_id string, text string"), [lambda t: F.upper(t), lambda t: F.lit(None).cast("string")])
    assert sorted((r["variant"], r["expanded"]) for r in q.collect()) == [(0, "t"), (1, "T")]


def test_models(spark):
    df = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "text string")
    model = models.batch_model(models.stand_in(4))
    rows, new = models.cached(df.where("text is not null"), spark.createDataFrame([], "hash string, version string, embedding array<double>"), model, "v1")
    got = [tuple(r["embedding"]) for r in rows.orderBy("text").collect()]
    assert len(got) == 3 and got[0] == got[1] != got[2] and new.count() == 2
    assert models.cached(df.where("text = 'a'"), new, model, "v1")[1].count() == 0
    label = spark.range(1).select(models.entailment(F.lit([1.0, 1.0, 0.0])).alias("c")).first()["c"]
    assert label["label"] == "ENTAILMENT"


def test_evaluation(spark):
    assert E.by_failure_mode(spark.createDataFrame([(["a", "b"], 1.0), (["a"], 0.0)], "modes array<string>, precision double")).where("mode = 'a'").first()["precision"] == 0.5
    acc = E.accuracy(spark.createDataFrame([(["x", "y"], "y"), (["x", "y"], "x")], "ranked array<string>, label string"), k=2).first()
    assert (acc["top_1"], acc["top_k"]) == (0.5, 1.0)
    js = '[{"player":1,"second":5.0,"name":"Gate"},{"player":2,"second":1.0,"name":"Pool"},{"player":1,"second":2.0,"name":"Pylon"}]'
    order = E.build_order(spark.createDataFrame([(1, js)], "id int, j string"), "id", "j", 1)
    assert [r["name"] for r in order.collect()] == ["Pylon", "Gate"]
    parts = {(r["label"], r["part"]): r["n"] for r in E.stratified_split(spark.range(100).withColumn("label", F.col("id") % 2), "label", "id").groupBy("label", "part").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert parts[0, "train"] == parts[1, "train"] == 35 and parts[0, "test"] == 10
    mask = E.ever_seen(spark.createDataFrame([(1, 1, False), (1, 2, True), (1, 3, False)], "k int, s int, v boolean"), "k", "s", F.col("v"))
    assert [r["visible"] for r in mask.orderBy("s").collect()] == [False, True, True]
    filled = E.carried_forward(spark.createDataFrame([(1, 1, None), (1, 2, 5), (1, 3, None)], "k int, s int, v int"), "k", "s", ["v"])
    assert [r["v"] for r in filled.orderBy("s").collect()] == [None, 5, 5]
    counts = E.unit_counts(spark.createDataFrame([(1, i, "u", c) for i, c in enumerate([-1, 1, 1, -1, -1, -1, 1])], "k int, s int, unit string, c int"), "k", ["s"], "unit", "c")
    assert [r["count"] for r in counts.orderBy("s").collect()] == [0, 1, 2, 1, 0, 0, 1]
    assert spark.range(1).select(E.cascade(F.lit(None).cast("string"), F.lit("l"), F.lit(0.5)).alias("v")).first()["v"] is None
    assert E.pair_gap(spark.createDataFrame([(True, 0.9), (False, 0.4)], "related boolean, score double")).first()["gap"] == pytest.approx(0.5)


def test_adaptation_and_lookup(spark):
    df = spark.createDataFrame([("c", [("a", 1), ("b", 2)])], "case_id string, plan array<struct<binding:string,priority:int>>")
    kept = C.adapted(df).first()["adapted"]
    assert [(s["step"]["binding"], s["action"], s["reason"]) for s in kept] == [("a", "RETAINED", None), ("b", "RETAINED", None)]
    other = C.adapted(df, adapter=lambda s: F.struct(F.when(s["priority"] > 1, "BOOSTED").otherwise("RETAINED").alias("action"), F.lit("r").alias("reason"))).first()["adapted"]
    assert [s["action"] for s in other] == ["RETAINED", "BOOSTED"]
    got = E.encoded(spark.createDataFrame([("x",), ("y",)], "m string"), "m", {"x": [1, 0]}, [0.5, 0.5])
    assert [r["features"] for r in got.orderBy("m").collect()] == [[1.0, 0.0], [0.5, 0.5]]


def test_points_and_bounds(spark):
    df = spark.createDataFrame([("t", "g", "c1", 1.5, "z", [1.0, 2.0]), ("t", "g", "c2", None, "y", None)], "tenant_id string, case_type string, case_id string, ratio double, race string, embedding array<double>")
    points = C.to_points(df, ["ratio", "race"])
    rows = {r["payload"]["case_id"]: r for r in points.collect()}
    assert rows["c2"]["vector"] == [0.0] and rows["c1"]["payload"]["f_ratio"] == 1.5 and rows["c1"]["features"] == '{"ratio":1.5,"race":"z"}' and rows["c2"]["features"] == '{"race":"y"}'
    assert len({r["id"] for r in rows.values()}) == 2
    back = C.from_points(points, ["ratio", "race"]).select(*df.columns)
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    assert C.checked_scores(spark.createDataFrame([(0.5,), (-1.0,)], "score double")).count() == 2
    with pytest.raises(Exception, match="out of bounds"):
        C.checked_scores(spark.createDataFrame([(1.5,)], "score double")).collect()
    mood = spark.createDataFrame([(0.5, -1.0, 1.0), (1.5, None, 0.0)], "p double, a double, d double")
    assert [r["f"] for r in mood.select(M.mood_faults("p", "a", "d").alias("f")).collect()] == [[], [0, 1]]


def test_vector_bytes(spark):
    df = spark.createDataFrame([([1.0, -2.5],), ([],), (None,)], "v array<float>")
    data = df.select("v", vectors.to_bytes("v").alias("b"))
    assert [None if r["b"] is None else bytes(r["b"]) for r in data.collect()] == [b"\x02\0\0\0\0\0\x80\x3f\0\0\x20\xc0", b"\0\0\0\0", None]
    assert [r["w"] for r in data.select(vectors.from_bytes("b").alias("w")).collect()] == [[1.0, -2.5], [], None]
    out = df.limit(1).select(models.outputs(vector=F.array("v")).alias("o")).select(models.single_row("o.vector").alias("r"), F.size("o.vector").alias("n")).first()
    assert (out["r"], out["n"]) == ([1.0, -2.5], 1)


def test_agreement(spark):
    steps = spark.createDataFrame([("c1", "a", "w1", "ok", 1), ("c2", "a", "w1", "ok", 1), ("c1", "b", "w1", "ok", 1), ("c2", "b", "w2", "ok", 1), ("c3", "b", "w1", "no", 1), ("c1", "d", "w1", "ok", 1), ("c2", "d", "w2", "ok", 1), ("c1", "e", None, "ok", 1)], "case_id string, step string, worker string, outcome string, priority int")
    got = {r["step"]: (r["agreement"], r["share"]) for r in C.agreement(C.step_consensus(steps)).collect()}
    assert got == {"a": ("UNANIMOUS", 1.0), "b": ("MAJORITY", pytest.approx(2 / 3)), "d": ("SPLIT", 0.5), "e": ("NONE", None)}


def test_bands_reach_the_recall():
    for t in (0.1, 0.37, 0.6, 0.9):
        n, r = analytics.bands(t)
        assert n * r == 128 and (1 - (1 - t**r) ** n >= 0.999 or (n, r) == (128, 1))


def test_scouting_visibility(spark):
    seconds = spark.range(0, 600, 5).select(F.col("id").alias("s")).crossJoin(spark.range(20).select(F.col("id").alias("k")))
    held = {}
    for r in seconds.select("k", "s", E.scouting_visibility("k", "s", 7).alias("v")).orderBy("k", "s").collect():
        held.setdefault(r["k"], []).append((r["s"], r["v"]))
    assert len({tuple(v) for v in held.values()}) == 20  # keys differ
    for values in held.values():
        assert all(a[1] <= b[1] for a, b in zip(values, values[1:]))
        assert all(v == 0 for s, v in values if s < 90) and all(0.3 <= v <= 1 for s, v in values if s >= 150)
        assert values[-1][1] > dict(values)[150]
    again = seconds.select("k", "s", E.scouting_visibility("k", "s", 7).alias("v"))
    assert again.exceptAll(seconds.select("k", "s", E.scouting_visibility("k", "s", 7).alias("v"))).count() == 0
