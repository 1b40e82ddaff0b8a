"""The rest of the surface: queries over operators that the first module does not reach, with their SQL."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from sievework.functions import decay, schema as S, similarity, text, vectors
from sievework.operators import analytics, cases as C, evaluation, filters as P, fusion, memory as M, models, retrieval, vector_search
from sievework.plans import fixtures as X
from sievework.plans.queries import ASKED, AS_OF, COS, EDGES_SQL, NOW, PAIRS_SQL, PARTS_SQL, SCHEMA, SERIES_SQL, WEIGHTS, docs, edges, log
from sievework.plans.registry import query, r6
from sievework.session import shared_path
from sievework.sources import corpus, logs
from sievework.streaming import jobs

# Retrieval


@query("""WITH e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), q AS (SELECT v[1:32] AS a, v[33:64] AS b FROM e WHERE id = 0)
    SELECT id, round(greatest(list_dot_product(q.a, v[1:32]), list_dot_product(q.a, v[33:64])) + greatest(list_dot_product(q.b, v[1:32]), list_dot_product(q.b, v[33:64])), 9) AS score
    FROM e CROSS JOIN q ORDER BY greatest(list_dot_product(q.a, v[1:32]), list_dot_product(q.a, v[33:64])) + greatest(list_dot_product(q.b, v[1:32]), list_dot_product(q.b, v[33:64])) DESC, id LIMIT 10""")
def late_interaction(spark, d):
    e = X.table(spark, d, "embeddings")
    q = [float(x) for x in e.where("vec_id = 0").first()["embedding"]]
    rows = e.select(F.col("vec_id").alias("id"), F.array(F.slice("embedding", 1, 32), F.slice("embedding", 33, 32)).alias("vectors"))
    return vector_search.late_interaction(rows, [q[:32], q[32:64]], 10).select("id", r6("score"))


@query(f"""WITH e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS a FROM embeddings), q AS (SELECT a AS b FROM e WHERE id = 0)
    SELECT id FROM e CROSS JOIN q WHERE id % 5 = 0 OR {COS} >= 0.1""")
def query_drift(spark, d):
    e = X.table(spark, d, "embeddings")
    first = e.where("vec_id = 0").select(F.col("embedding").alias("original_vector"))  # one row
    variants = e.select(F.col("vec_id").alias("id"), (F.col("vec_id") % 5).alias("variant"), F.col("embedding").alias("expanded_vector")).crossJoin(F.broadcast(first))
    return retrieval.without_drift(variants, least=0.1).select("id")


@query("SELECT lang, count(*) FILTER (WHERE n_chars / 2000.0 >= 0.7) AS correct, count(*) FILTER (WHERE n_chars / 2000.0 > 0.3 AND n_chars / 2000.0 < 0.7) AS ambiguous, count(*) FILTER (WHERE n_chars / 2000.0 <= 0.3) AS incorrect FROM documents GROUP BY 1")
def grades(spark, d):
    graded = docs(spark, d).select("lang", retrieval.grade(F.col("n_chars") / 2000).alias("grade"))
    return retrieval.grade_counts(graded, ["lang"])


@query("SELECT doc_id AS id, min(CASE WHEN lang = 'en' THEN 0 ELSE 1 END) AS first_set FROM documents WHERE lang = 'en' OR n_chars > 1000 GROUP BY 1")
def first_of_sets(spark, d):
    rows = docs(spark, d)
    return fusion.first_of([rows.where("lang = 'en'").select("id", F.lit(0).alias("first_set")), rows.where("n_chars > 1000").select("id", F.lit(1).alias("first_set"))])


@query("SELECT l_orderkey AS doc_id, max(l_extendedprice) AS score FROM lineitem GROUP BY 1")
def best_per_document(spark, d):
    rows = X.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_extendedprice").alias("score"))
    return P.best_per_document(rows)


@query("SELECT doc_id AS id, 'tenant' AS tenant, 'x' || doc_id AS source, lang FROM documents")
def stamped_metadata(spark, d):
    rows = docs(spark, d).select("id", F.create_map(F.lit("lang"), "lang", F.lit("source"), "source").alias("metadata"))
    out = P.stamp(rows, {"tenant": "tenant", "source": F.concat(F.lit("x"), "id")})
    return out.select("id", *[F.col("metadata")[k].alias(k) for k in ("tenant", "source", "lang")])


# Text


@query("SELECT doc_id AS id, 'get' || upper(lang) || 'Model get ' || upper(lang) || ' Model in src src0 src 0' AS grown FROM documents")
def expanded_camel(spark, d):
    said = F.concat(F.lit("get"), F.upper("lang"), F.lit("Model in src src0"))
    return docs(spark, d).select("id", text.expand_camel(said).alias("grown"))


@query("SELECT doc_id AS id, sha256(doc_id || chr(0) || text) AS key FROM documents WHERE text IS NOT NULL")
def dedup_keys(spark, d):
    return docs(spark, d).where("text is not null").select("id", F.sha2(text.dedup_key("id", "text"), 256).alias("key"))


@query("SELECT event_id, printf('%.4f', value / 500.0) AS said, round(CAST(printf('%.4f', value / 500.0) AS DOUBLE), 9) AS back FROM events")
def confidence_format(spark, d):
    rows = X.table(spark, d, "events").select("event_id", text.format_confidence(F.col("value") / 500.0).alias("said"))
    return rows.select("event_id", "said", r6(text.parse_confidence("said"), "back"))


@query("""SELECT o_orderkey AS case_id, 'Retrieved 2 cases (mode: HYBRID, caseType: order).' || chr(10) || 'Top match: caseId=' || o_orderkey || ', score=' || printf('%.2f', (o_orderkey % 100) / 100.0) || ', confidence=0.50.' || chr(10) || 'Feature breakdown: price=0.75, status=0.25.' AS said FROM orders""")
def explanations(spark, d):
    o = X.table(spark, d, "orders")
    features = F.create_map(F.lit("status"), F.lit(0.25), F.lit("price"), F.lit(0.75))
    return o.select(F.col("o_orderkey").alias("case_id"), text.explanation(F.lit(2), "HYBRID", "order", F.col("o_orderkey"), F.col("o_orderkey") % 100 / 100, F.lit(0.5), features).alias("said"))


@query("SELECT doc_id AS id, regexp_replace(trim(regexp_replace('what \"is\" ' || source || '* (' || lang || '):^+-', '[\"*^:()+\\-]', ' ', 'g'), ' '), '\\s+', ' ', 'g') AS question FROM documents")
def plain_questions(spark, d):
    return docs(spark, d).select("id", text.plain_question(F.concat(F.lit('what "is" '), "source", F.lit("* ("), "lang", F.lit("):^+-"))).alias("question"))


# Cases


@query(f"""WITH {X.CASES_SQL}, s AS (SELECT case_id, CASE WHEN priority = '1-URGENT' THEN 1.0 WHEN priority = '2-HIGH' THEN 0.6 ELSE 0 END AS a, greatest(0.0, 1 - abs(price - 50000) / 500000) AS b FROM cases),
    l AS (SELECT 'urgent' AS query_id, case_id, a AS score FROM s UNION ALL SELECT 'cheap', case_id, b FROM s),
    k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, case_id) AS r FROM l)
    SELECT query_id, case_id, round(score, 9) AS score FROM k WHERE r <= 25""")
def case_similarity_many(spark, d):
    found = C.similar_many(X.cases(spark, d), SCHEMA, {"urgent": {"priority": "1-URGENT"}, "cheap": {"price": 50000.0}}, 25)
    return found.select("query_id", "case_id", r6("score"))


@query(f"""WITH {X.CASES_SQL}, {PARTS_SQL}, head AS (SELECT case_id, status FROM sc ORDER BY score DESC, case_id LIMIT 30)
    SELECT case_id, round(1 / (1 + exp(-(CASE WHEN status = 'O' THEN 2.0 ELSE -1.0 END))), 9) AS score FROM head""")
def case_rerank(spark, d):
    stage = C.reranked(lambda problem, t: F.when(problem == t, 2.0).otherwise(-1.0), "O", "status")
    found = C.similar(X.cases(spark, d), SCHEMA, ASKED, WEIGHTS)
    return stage(found).select("case_id", r6("score"))


@query(f"""WITH {X.CASES_SQL} SELECT case_id, case_id % 10 = 3 AND case_id % 100 <> 13 AS superseded, CASE WHEN case_id % 10 = 3 AND case_id % 100 <> 13 THEN 's2' END AS superseded_by FROM cases WHERE tenant_id = 'ASIA'""")
def case_supersede(spark, d):
    none = {"superseded_at": F.lit(None).cast("timestamp"), "superseded_by": F.lit(None).cast("string"), "superseded_reason": F.lit(None).cast("string"), "reinstated_at": F.lit(None).cast("timestamp")}
    rows = X.cases(spark, d).where("tenant_id = 'ASIA'").withColumns(none | {"digit": F.col("case_id") % 10, "two": F.col("case_id") % 100}).withColumnRenamed("case_id", "own").withColumnRenamed("digit", "case_id")
    rows = C.supersede(C.supersede(rows, "ASIA", 3, "2024-01-01", "s1", "old"), "ASIA", 3, "2024-02-01", "s2")
    rows = C.reinstate(rows.drop("case_id").withColumnRenamed("two", "case_id"), "ASIA", 13, "2024-03-01")
    return rows.select(F.col("own").alias("case_id"), "superseded", "superseded_by")


@query(f"""WITH {X.CASES_SQL}, f AS (SELECT case_id, CASE WHEN scope = '' THEN 0 ELSE len(string_split(scope, '/')) END AS n FROM cases)
    SELECT case_id, round(pow(0.5, greatest(3 - n, 0)), 9) AS exponential, round(greatest(0, 1 - greatest(3 - n, 0) / 5.0), 9) AS linear, CAST(CASE WHEN greatest(3 - n, 0) = 0 THEN 1.0 ELSE 0.4 END AS DOUBLE) AS step FROM f""")
def scope_factors(spark, d):
    of = lambda kind, **o: decay.scope_factor("scope", "A/B/C", kind, **o)
    return X.cases(spark, d).select("case_id", r6(of("exponential"), "exponential"), r6(of("linear"), "linear"), of("step", after=0.4).alias("step"))


@query(f"""WITH {X.CASES_SQL} SELECT case_id, round(CASE WHEN trust IS NULL THEN 0.8 ELSE 0.8 * (0.7 + 0.3 * trust) * CASE WHEN trust - 0.5 < 0 THEN greatest(0.5, 1 + 0.5 * (trust - 0.5)) ELSE 1 END END, 9) AS weight FROM cases""")
def trust_changes(spark, d):
    return X.cases(spark, d).select("case_id", r6(decay.trust_weight(F.lit(0.8), "trust", F.col("trust") - 0.5), "weight"))


@query("SELECT event_id, round(value / 500.0 + (0.2 - value / 500.0) * (1 - exp(-(event_id % 100) / 50.0)), 9) AS mood FROM events")
def mood_decay(spark, d):
    e = X.table(spark, d, "events")
    return e.select("event_id", r6(decay.decay_mood(F.col("value") / 500.0, F.lit(0.2), (F.col("event_id") % 100).cast("double"), timedelta(seconds=50)), "mood"))


@query(f"""WITH {SERIES_SQL} SELECT user_id, round(stddev_pop(v), 9) AS obs_volatility_v, CAST(count(*) AS DOUBLE) AS obs_count, round(max(t) - min(t), 3) AS obs_duration FROM o GROUP BY 1""")
def enriched_cases(spark, d):
    schema = S.Schema("series", (S.TimeSeries("obs", "t", (S.Numeric("t", 0, 1), S.Numeric("v", 0, 500)), trends=("volatility", "count", "duration")),))
    out = C.enriched(X.series(spark, d), schema)
    return out.select("user_id", r6("obs_volatility_v"), "obs_count", F.round("obs_duration", 3).alias("obs_duration"))


@query(f"""WITH {X.CASES_SQL}, {PARTS_SQL}, b AS (SELECT * FROM sc ORDER BY score DESC, case_id LIMIT 1)
    SELECT b.status || '-' || b.priority AS plan, round(b.score, 9) AS score, (SELECT count(*) FROM sc) AS cases FROM b""")
def best_plan(spark, d):
    scored = C.similar(X.cases(spark, d), SCHEMA, ASKED, WEIGHTS).withColumn("plan", F.concat_ws("-", "status", "priority"))
    return C.best_plan(scored).select("plan", r6("score"), "cases")


@query("""SELECT l_orderkey AS case_id, count(*) FILTER (WHERE l_returnflag = 'R') AS suppressed, count(*) FILTER (WHERE l_returnflag <> 'R') AS retained FROM lineitem GROUP BY 1""")
def adapted_plans(spark, d):
    plans = X.order_lists(spark, d).select("case_id", F.col("lines").alias("plan"))
    adapter = lambda s: F.struct(F.when(s["flag"] == "R", "SUPPRESSED").otherwise("RETAINED").alias("action"), F.when(s["flag"] == "R", "returned").alias("reason"))
    done = C.adapted(plans, adapter=adapter)
    n = lambda a: F.size(F.filter("adapted", lambda s: s["action"] == a)).cast("long")
    return done.select("case_id", n("SUPPRESSED").alias("suppressed"), n("RETAINED").alias("retained"))


@query("""WITH w AS (SELECT l_linenumber AS step, l_suppkey % 3 AS worker, count(*) AS n FROM lineitem GROUP BY 1, 2)
    SELECT CAST(step AS VARCHAR) AS step, round(max(n) / CAST(sum(n) AS DOUBLE), 9) AS share, CASE WHEN max(n) = sum(n) THEN 'UNANIMOUS' WHEN max(n) / CAST(sum(n) AS DOUBLE) > 0.34 THEN 'MAJORITY' ELSE 'SPLIT' END AS agreement FROM w GROUP BY 1""")
def plan_agreement(spark, d):
    li = X.table(spark, d, "lineitem")
    steps = li.select(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").cast("string").alias("step"), (F.col("l_suppkey") % 3).cast("string").alias("worker"), F.col("l_returnflag").alias("outcome"), F.lit(1).alias("priority"))
    return C.agreement(C.step_consensus(steps), majority=0.34).select("step", r6("share"), "agreement")


@query(f"""WITH {X.CASES_SQL}, {PARTS_SQL} SELECT min(price) AS low, max(price) AS high, percentile_disc(0.5) WITHIN GROUP (ORDER BY price) AS median, percentile_disc(0.75) WITHIN GROUP (ORDER BY price) AS p75,
    round(avg(CASE WHEN status = 'F' THEN 1.0 ELSE 0 END), 9) AS success_rate, count(*) AS cases, round(avg(score), 9) AS mean_score FROM sc WHERE score >= 0.5""")
def case_suggestions(spark, d):
    found = C.similar(X.cases(spark, d), SCHEMA, ASKED, WEIGHTS, 0.5)
    return C.suggestions(found, "price", F.col("status") == "F").withColumns({"success_rate": r6("success_rate"), "mean_score": r6("mean_score")})


@query(f"""WITH {X.CASES_SQL} SELECT case_id, md5(tenant_id || '#order#' || case_id) AS id, price AS f_price, 1 AS dimensions FROM cases""")
def case_points(spark, d):
    points = C.to_points(X.cases(spark, d), ["price", "status"])
    return points.select(F.col("payload.case_id").alias("case_id"), "id", F.col("payload.f_price").alias("f_price"), F.size("vector").alias("dimensions"))


@query(f"""WITH {X.CASES_SQL} SELECT case_id, price, status FROM cases""")
def case_points_back(spark, d):
    points = C.to_points(X.cases(spark, d), ["price", "status"])
    return C.from_points(points, ["price", "status"]).where("embedding is null").select("case_id", "price", "status")


@query(f"WITH {X.CASES_SQL} SELECT case_id, '{{\"segment\":\"' || segment || '\",\"status\":\"' || status || '\"}}' AS json FROM cases")
def features_json(spark, d):
    return X.cases(spark, d).select("case_id", S.raw_json("segment", "status").alias("json"))


@query(f"""WITH {X.CASES_SQL}, {PARTS_SQL} SELECT count(*) AS n FROM sc WHERE score BETWEEN -1 AND 1""")
def scores_in_bounds(spark, d):
    return C.checked_scores(C.similar(X.cases(spark, d), SCHEMA, ASKED, WEIGHTS)).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {X.CASES_SQL} SELECT case_id FROM cases WHERE scope = 'NATION_2' OR starts_with(scope, 'NATION_2/')""")
def scope_subtree(spark, d):
    return X.cases(spark, d).where(P.within("scope", "NATION_2")).select("case_id")


@query(f"""WITH {X.CASES_SQL} SELECT tenant_id, arg_max(case_id, (stored_at, case_id)) AS case_id FROM cases GROUP BY 1""")
def latest_cases(spark, d):
    rows = X.cases(spark, d).select("tenant_id", "case_type", F.lit("one").alias("case_id"), F.struct("stored_at", F.col("case_id").alias("own")).alias("stored_at"))
    return C.latest(rows).select("tenant_id", F.col("stored_at.own").alias("case_id"))


@query("""WITH li AS (SELECT l_orderkey AS case_id, list(l_returnflag) AS flags FROM lineitem GROUP BY 1)
    SELECT case_id FROM li WHERE (list_contains(flags, 'A') AND list_contains(flags, 'N')) OR (NOT list_contains(flags, 'A') AND NOT list_contains(flags, 'N'))""")
def case_list_filters(spark, d):
    rows = X.order_lists(spark, d)
    keep = P.case_filter(P.ContainsAll(("A", "N")), "flags") | P.case_filter(P.NotContainsAny(("A", "N")), "flags")
    return rows.where(keep).select("case_id")


@query("""SELECT l_orderkey AS case_id FROM lineitem GROUP BY 1 HAVING bool_or(l_returnflag IN ('A', 'R'))""")
def case_any_filter(spark, d):
    return X.order_lists(spark, d).where(P.case_filter(P.ContainsAny(("A", "R")), "flags")).select("case_id")


@query("""SELECT l_orderkey AS case_id, list_sort(list(l_quantity)) AS quantities FROM lineitem GROUP BY 1 HAVING max(l_quantity) > 45""")
def quarantined_cases(spark, d):
    _, bad = S.split_valid(X.order_lists(spark, d).select("case_id", "quantities"), S.Schema("order", (S.NumericList("quantities", 0, 45),)))
    return bad.select("case_id", F.array_sort("quantities").alias("quantities"))


# Memory


@query(f"WITH {X.MEMORY_SQL} SELECT count(*) AS erased FROM memory WHERE entity_id = '7'")
def memory_erase_everywhere(spark, d):
    return M.erase_everywhere(X.memory(spark, d), "7", admin=True)[1]


@query(f"WITH {X.MEMORY_SQL} SELECT '7' AS entity_id, 'click' AS domain, count(*) AS erased FROM memory WHERE entity_id = '7' AND domain = 'click' HAVING count(*) > 0")
def erasure_events(spark, d):
    return M.erasure_event(M.erase(X.memory(spark, d), M.erased("t", "7", "click"))[1], "7", "click")


@query("SELECT DISTINCT 't' || (user_id % 9) AS tenant_id FROM events WHERE event_type = 'click' AND CAST(json_extract(props, '$.k') AS INTEGER) = 3")
def memory_tenants(spark, d):
    rows = X.memory(spark, d).withColumn("tenant_id", F.concat(F.lit("t"), F.col("entity_id").cast("int") % 9))
    return M.tenants(rows, "click", ("k", "3"))


@query("SELECT event_id || '-rel' AS memory_id, CAST(user_id AS VARCHAR) AS entity_id, CAST(event_id % 50 AS VARCHAR) AS target FROM events WHERE event_id % 3 = 0 AND event_id % 50 <> user_id")
def derived_relationships(spark, d):
    target = F.when(F.col("memory_id") % 3 == 0, (F.col("memory_id") % 50).cast("string"))
    rows = X.memory(spark, d).withColumn("attributes", F.map_filter(F.create_map(F.lit("target"), target), lambda _, v: v.isNotNull())).withColumn("memory_id", F.col("memory_id").cast("string"))
    return M.relationships_of(rows).select("memory_id", "entity_id", F.col("attributes")["target"].alias("target"))


@query("SELECT event_id AS memory_id, CAST(user_id AS VARCHAR) AS entity_id, event_type AS outcome, event_id % 4 = 0 AS quarantined FROM events")
def recorded_events(spark, d):
    e = X.memory(spark, d)
    meta = F.create_map(F.when(F.col("memory_id") % 4 == 0, "outcome").otherwise("note"), F.lit("x"))
    rows = M.record(e.withColumnRenamed("domain", "kind"), "experience", "entity_id", "text", {"outcome": "kind"}, meta)
    return rows.select("memory_id", "entity_id", F.col("attributes")["outcome"].alias("outcome"), "quarantined")


@query("SELECT event_id, round(CASE WHEN event_id % 7 <> 0 THEN least(value / 500.0, 1.0) ELSE least(0.3 + 0.2 * (event_id % 5), 1.0) END, 9) AS importance FROM events")
def reflection_importances(spark, d):
    rows = X.memory(spark, d)
    return rows.select(F.col("memory_id").alias("event_id"), r6(M.reflection_importance(F.col("importance"), F.col("memory_id") % 5), "importance"))


@query("SELECT event_id AS input_index, 'invalid' AS reason FROM events WHERE value > 400")
def store_failures(spark, d):
    e = X.table(spark, d, "events").withColumnRenamed("event_id", "input_index")
    return M.store_result(e, F.col("value") <= 400)[1]


@query("SELECT event_id, CASE WHEN value > 250 THEN 'high' ELSE 'low' END AS level, event_type = 'click' AS clicked FROM events")
def enrichment_steps(spark, d):
    e = X.table(spark, d, "events").select("event_id", "event_type", "value")
    def unavailable(df):
        raise RuntimeError("no model")  # an optional step is left out

    steps = [(2, None, lambda df: df.withColumn("level", F.when(F.col("value") > 250, "high").otherwise("low")), False), (1, F.col("event_type") == "click", lambda df: df.withColumn("clicked", F.lit(True)), False), (3, None, unavailable, True)]
    return M.enrich(e, steps).select("event_id", "level", F.coalesce("clicked", F.lit(False)).alias("clicked"))


@query("SELECT event_id, list_filter([CASE WHEN value / 250.0 - 1 NOT BETWEEN -1 AND 1 THEN 0 END, CASE WHEN event_id % 7 = 0 THEN 1 END], lambda x: x IS NOT NULL) AS faults FROM events")
def mood_bounds(spark, d):
    e = X.table(spark, d, "events")
    return e.select("event_id", M.mood_faults(F.col("value") / 250.0 - 1, F.when(F.col("event_id") % 7 != 0, 0.5)).alias("faults"))


# Analytics


@query(f"""WITH RECURSIVE {X.LOG_SQL}, {EDGES_SQL}, {PAIRS_SQL}, e AS (SELECT q1 AS a, q2 AS b FROM pairs WHERE jaccard >= 0.37 UNION SELECT q2, q1 FROM pairs WHERE jaccard >= 0.37),
    walk AS (SELECT a AS query, a AS reach FROM e UNION SELECT walk.query, e.b FROM walk JOIN e ON e.a = walk.reach),
    comp AS (SELECT query, min(reach) AS cluster FROM walk GROUP BY 1), sz AS (SELECT cluster, count(*) AS size FROM comp GROUP BY 1),
    every AS (SELECT x.cluster, min(coalesce(jaccard, 0)) AS m FROM comp x JOIN comp y ON x.cluster = y.cluster AND x.query < y.query LEFT JOIN pairs ON q1 = x.query AND q2 = y.query GROUP BY 1),
    sh AS (SELECT cluster, doc FROM edges JOIN comp ON comp.query = edges.query GROUP BY 1, 2 HAVING count(*) = (SELECT size FROM sz WHERE sz.cluster = comp.cluster))
    SELECT sz.cluster, size, round(m, 9) AS least_jaccard, coalesce((SELECT list_sort(list(doc)) FROM sh WHERE sh.cluster = sz.cluster), []) AS shared FROM sz JOIN every ON every.cluster = sz.cluster""")
def query_cluster_overlaps(spark, d):
    return analytics.query_clusters(edges(spark, d), 0.37).select("cluster", "size", r6("least_jaccard"), "shared")


@query(f"""WITH {X.LOG_SQL}, {EDGES_SQL}, {PAIRS_SQL} SELECT count(*) AS pairs, true AS close FROM pairs WHERE jaccard >= 0.37""")
def minhash_estimates(spark, d):
    sets = edges(spark, d).groupBy(F.col("query").alias("q")).agg(F.collect_set("doc").alias("items")).withColumn("s", analytics.minhash("items", 256))
    pairs = analytics.jaccard_pairs(edges(spark, d), 0.37)
    both = pairs.join(sets.select(F.col("q").alias("q1"), F.col("s").alias("s1")), "q1").join(sets.select(F.col("q").alias("q2"), F.col("s").alias("s2")), "q2")
    gap = F.avg(F.abs(analytics.estimated_jaccard("s1", "s2") - F.col("jaccard")))
    return both.agg(F.count(F.lit(1)).alias("pairs"), (F.coalesce(gap, F.lit(0.0)) < 0.05).alias("close"))  # without pairs no estimate is off


@query("SELECT doc_id AS id, 'missing' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT DISTINCT doc_id, 'orphan' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def reconciled(spark, d):
    stored = X.table(spark, d, "labels").select(F.col("doc_id").alias("id"))
    missing, orphans = corpus.reconcile(stored, docs(spark, d).select("id"), "id")
    return missing.select("id", F.lit("missing").alias("side")).unionByName(orphans.select("id", F.lit("orphan").alias("side")))


# Corpora, logs


@query("""SELECT 'doc/' || doc_id AS path, CASE WHEN doc_id % 10 = 0 OR doc_id % 7 = 0 THEN 3 ELSE 2 END AS version FROM documents""")
def appended_versions(spark, d):
    v = X.versions(spark, d)
    new = docs(spark, d).select(F.concat(F.lit("doc/"), "id").alias("path"), F.lit("2024-03-01").cast("timestamp").alias("ts"), F.lit(b"x").alias("content"))
    return corpus.appended(v, new).select("path", "version")


@query("""SELECT 'doc/' || doc_id AS path, CASE WHEN doc_id % 7 = 0 THEN 3 ELSE 2 END AS version, true AS tombstone FROM documents WHERE doc_id IN (1, 7, 10, 11) AND doc_id % 10 <> 0""")
def deleted_versions(spark, d):
    return corpus.deleted(X.versions(spark, d), ["doc/1", "doc/7", "doc/10", "doc/11"], "2024-03-01").select("path", "version", "tombstone")


@query("""SELECT 'doc/' || doc_id AS path, CASE WHEN doc_id % 7 = 0 THEN 2 ELSE 1 END AS version FROM documents WHERE doc_id % 10 <> 0""")
def compaction_full(spark, d):
    return corpus.compacted(X.versions(spark, d), "FULL").select("path", "version")


@query("""SELECT 'doc/' || doc_id AS path, 1 AS version FROM documents UNION ALL SELECT 'doc/' || doc_id, 2 FROM documents WHERE doc_id % 10 = 0 OR doc_id % 7 = 0""")
def compaction_of_closed(spark, d):
    return corpus.compacted(X.versions(spark, d), "FULL", F.col("archive") == "a1").select("path", "version")


@query("""WITH v AS (SELECT doc_id, 1 AS version FROM documents UNION ALL SELECT doc_id, 2 FROM documents WHERE doc_id % 10 = 0 OR doc_id % 7 = 0) SELECT version, version = 2 AND doc_id % 10 = 0 AS tombstone FROM v WHERE doc_id = 70""")
def path_history(spark, d):
    return corpus.history(X.versions(spark, d), "doc/70").select("version", "tombstone")


@query("SELECT sha256(text) AS sha FROM documents WHERE doc_id = 21")
def one_version(spark, d):
    return corpus.version_of(X.versions(spark, d), "doc/21", 1).select(F.sha2("content", 256).alias("sha"))


@query("""SELECT * FROM (VALUES ('a1', 0, 'RETIRED', NULL, 'b1'), ('a2', 1, 'CLOSED', 'b1', NULL), ('a3', 2, 'ACTIVE', 'a2', NULL)) t(archive, sequence, status, predecessor, replaced_by)""")
def archive_chain(spark, d):
    chain = corpus.retire(corpus.opened(corpus.recovered_manifest(corpus.archive_facts(X.versions(spark, d))), "a3"), "a1", "b1")
    return chain.select("archive", "sequence", "status", "predecessor", "replaced_by")


@query("SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE 'old' END AS side FROM documents")
def upserted_chunks(spark, d):
    stored = docs(spark, d).select(F.col("id").alias("source_document_id"), F.lit("old").alias("side"))
    new = stored.where("source_document_id % 3 = 0").withColumn("side", F.lit("new"))
    return corpus.upserted(stored, new).select(F.col("source_document_id").alias("id"), "side")


@query("SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_orderkey NOT IN (1, 2, 3)")
def listed_documents(spark, d):
    stored = X.table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("source_document_id"))
    left = corpus.without_documents(stored, ["1", "2", "3"])
    return corpus.documents_of(left).select(F.col("source_document_id").cast("long").alias("id"))


@query("SELECT count(*) AS n FROM embeddings WHERE len(embedding) = 64")
def checked_collection(spark, d):
    return corpus.check_collection(X.table(spark, d, "embeddings"), "embedding", 64).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id AS id, 'given' AS title, lang FROM documents")
def parsed_metadata(spark, d):
    page = F.concat(F.lit("---\ntitle: own\nlang: "), "lang", F.lit("\n---\nbody"))
    rows = docs(spark, d).select("id", page.alias("content"), F.create_map(F.lit("title"), F.lit("given")).alias("meta"))
    return corpus.parsed(rows, kind="text", metadata="meta").select("id", F.col("metadata")["title"].alias("title"), F.col("metadata")["lang"].alias("lang"))


@query("SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script\\s*>', ' ', 'g'), '(?is)<style\\b.*?</style\\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\\s+', ' ', 'g')) AS text FROM pages")
def page_text(spark, d):
    return X.table(spark, d, "pages").select("page_id", corpus.plain_text("html").alias("text"))


@query("""WITH e AS (SELECT event_id, user_id, CAST(ts AS TIMESTAMP) AS ts, event_type FROM events), g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM e),
    b AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS burst FROM g)
    SELECT 'u' || user_id AS path, CAST(epoch_us(max(ts)) AS BIGINT) AS last_us FROM b GROUP BY user_id, burst""")
def debounced_changes(spark, d):
    e = X.events(spark, d).select(F.concat(F.lit("u"), "user_id").alias("path"), F.col("event_type").alias("change"), "ts")
    return jobs.debounced(e, "6 hours").select("path", F.unix_micros("ts").alias("last_us"))


@query("SELECT 'u' || user_id AS retrieval_id, 'd' || (event_id % 20) AS doc, max(value) AS score FROM events GROUP BY 1, 2")
def logged_retrievals(spark, d):
    e = X.table(spark, d, "events")
    rows = e.groupBy("user_id").agg(F.collect_list(F.struct(F.concat(F.lit("d"), F.col("event_id") % 20).alias("doc"), F.col("value").alias("score"))).alias("documents"))
    found = rows.select(F.concat(F.lit("u"), "user_id").alias("retrieval_id"), F.lit("q").alias("query_text"), F.lit("c").alias("corpus"), F.lit(10).alias("max_results"), F.lit(None).cast("timestamp").alias("ts"), "documents")
    return logs.log_rows(found)[1]


@query("SELECT event_id AS trace_id FROM events WHERE event_type = 'click' AND user_id % 4 = 1 AND CAST(ts AS TIMESTAMP) >= TIMESTAMP '2024-01-10' AND CAST(ts AS TIMESTAMP) < TIMESTAMP '2024-01-20'")
def found_traces(spark, d):
    rows = X.events(spark, d).select(F.col("event_id").alias("trace_id"), F.col("event_type").alias("case_type"), (F.col("user_id") % 4).cast("string").alias("tenant_id"), F.lit("g").alias("domain"), F.struct("value").alias("query"), F.array("value").alias("results"), "ts")
    return logs.find_traces(logs.traces(rows), "click", "1", "2024-01-10", "2024-01-20").select("trace_id")


# Models and evaluation


@query("""WITH e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[])[1:3] AS v FROM embeddings), x AS (SELECT id, list_transform(v, lambda y: exp(y - list_max(v))) AS e FROM e)
    SELECT id, ['ENTAILMENT', 'NEUTRAL', 'CONTRADICTION'][list_position(e, list_max(e))] AS label, round(list_max(e) / list_sum(e), 9) AS score FROM x""")
def entailment_labels(spark, d):
    e = X.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), models.entailment(F.slice("embedding", 1, 3)).alias("c"))
    return e.select("id", "c.label", r6("c.score", "score"))


@query("""WITH e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), t AS (SELECT id, unnest(range(0, 32)) AS token, unnest(list_transform(list_zip(v[1:32], v[33:64]), lambda z: greatest(z[1], z[2]))) AS x FROM e)
    SELECT id, count(*) AS tokens, round(sum(ln(1 + x)), 9) AS weight FROM t WHERE ln(1 + greatest(x, 0)) >= 0.01 GROUP BY 1""")
def sparse_activations(spark, d):
    pooled = vectors.max_pool(F.array(F.slice("embedding", 1, 32), F.slice("embedding", 33, 32)))
    rows = X.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), vectors.sparse_activation(pooled).alias("s"))
    weight = F.aggregate(F.map_values("s"), F.lit(0.0), lambda a, x: a + x)
    return rows.where(F.size("s") > 0).select("id", F.size("s").cast("long").alias("tokens"), r6(weight, "weight"))


@query("SELECT vec_id AS id, 4 + 4 * len(embedding) AS bytes, true AS same FROM embeddings")
def vector_codec(spark, d):
    e = X.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<float>").alias("v"))
    coded = e.select("id", "v", vectors.to_bytes("v").alias("b"))
    return coded.select("id", F.octet_length("b").cast("long").alias("bytes"), (vectors.from_bytes("b") == F.col("v")).alias("same"))


@query("SELECT vec_id AS id, round(CAST(embedding[1] AS DOUBLE), 6) AS first, 1 AS rows FROM embeddings")
def model_outputs(spark, d):
    e = X.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), models.outputs(vector=F.array("embedding")).alias("o"))
    return e.select("id", F.round(models.single_row("o.vector")[0].cast("double"), 6).alias("first"), F.size("o.vector").alias("rows"))


@query("""SELECT event_id, max(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1 AS visible FROM events""")
def ever_seen(spark, d):
    e = X.events(spark, d).withColumn("at", F.struct("ts", "event_id"))
    return evaluation.ever_seen(e, "user_id", "at", F.col("event_type") == "view").select("event_id", "visible")


@query("""SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS price FROM events""")
def carried_forward(spark, d):
    e = X.events(spark, d).withColumn("at", F.struct("ts", "event_id")).withColumn("price", F.when(F.col("event_type") == "purchase", F.col("value")))
    return evaluation.carried_forward(e, "user_id", "at", ["price"]).select("event_id", "price")


@query("SELECT user_id AS game, round(value, 3) AS second, event_type AS name FROM events WHERE event_id % 2 = 1")
def build_orders(spark, d):
    e = X.table(spark, d, "events")
    item = F.struct((F.col("event_id") % 2).cast("int").alias("player"), F.round("value", 3).alias("second"), F.col("event_type").alias("name"))
    rows = e.groupBy(F.col("user_id").alias("game")).agg(F.to_json(F.collect_list(item)).alias("orders"))
    return evaluation.build_order(rows, "game", "orders", 1)


@query("SELECT event_type, round(avg(value) FILTER (WHERE event_id % 2 = 0) - avg(value) FILTER (WHERE event_id % 2 <> 0), 9) AS gap FROM events GROUP BY 1")
def pair_gaps(spark, d):
    e = X.table(spark, d, "events").select("event_type", F.col("value").alias("score"), (F.col("event_id") % 2 == 0).alias("related"))
    return evaluation.pair_gap(e, by=["event_type"]).select("event_type", r6("gap"))


@query("SELECT round(avg(CASE WHEN lang = 'en' THEN 4 ELSE 2 END), 9) AS mean_tokens, CAST(0.0 AS DOUBLE) AS whole FROM documents")
def identifier_tokens(spark, d):
    name = F.when(F.col("lang") == "en", "getChatModel").otherwise("langName")
    rows = docs(spark, d).select(text.code_tokens(name).alias("tokens"))
    tokens = rows.select(F.slice("tokens", 1, F.when(F.size("tokens") == 4, 4).otherwise(2)).alias("tokens"))
    return evaluation.tokens_per_identifier(tokens).select(r6("mean_tokens"), "whole")


@query("SELECT doc_id AS id, CASE lang WHEN 'en' THEN 1.0::DOUBLE WHEN 'de' THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END AS first FROM documents")
def encoded_features(spark, d):
    rows = evaluation.encoded(docs(spark, d).select("id", "lang"), "lang", {"en": [1.0, 0.5], "de": [2.0, 0.5]}, [0.0, 0.0])
    return rows.select("id", F.col("features")[0].alias("first"))


@query("SELECT event_id, CASE WHEN event_type = 'click' THEN 'rule' WHEN value / 500.0 >= 0.6 THEN 'model' END AS label FROM events")
def label_cascade(spark, d):
    e = X.table(spark, d, "events")
    return e.select("event_id", evaluation.cascade(F.when(F.col("event_type") == "click", "rule"), F.lit("model"), F.col("value") / 500.0).alias("label"))


@query("SELECT doc_id AS id, sha256(text) AS hash, true AS hit FROM documents WHERE text IS NOT NULL")
def cached_models(spark, d):
    rows = docs(spark, d).where("text is not null").select("id", "text")
    cache = rows.where("id % 2 = 0").select(F.sha2("text", 256).alias("hash"), F.lit("v1").alias("version"), F.array(F.lit(1.0)).alias("embedding")).distinct()
    found, _ = models.cached(rows, cache, lambda t: F.array(F.char_length(t).cast("double")), "v1")
    return found.select("id", F.sha2("text", 256).alias("hash"), (F.size("embedding") == 1).alias("hit"))


@query(f"""WITH {X.CASES_SQL}, {PARTS_SQL} SELECT case_id, round(c, 9) AS score FROM sc""")
def score_override(spark, d):
    found = similarity.score(SCHEMA, {"price": 150000.0}, overrides={"price": lambda q, case: F.greatest(F.lit(0.0), 1 - F.abs(case - q) / 500000)})
    return X.cases(spark, d).select("case_id", r6(found, "score"))


@query(f"""WITH {X.LOG_SQL} SELECT retrieval_id, query_text, CAST(epoch_us(ts) AS BIGINT) AS us FROM rec WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '{NOW}'""")
def records_in_window(spark, d):
    records, _, _ = log(spark, d)
    return analytics.in_window(records, "2024-01-10", NOW).select("retrieval_id", "query_text", F.unix_micros("ts").alias("us"))


@query(f"""WITH {X.CASES_SQL} SELECT case_id, CASE WHEN stored_at > TIMESTAMP '{AS_OF}' THEN true ELSE false END AS future FROM cases WHERE stored_at >= TIMESTAMP '1998-01-01'""")
def future_cases(spark, d):
    rows = X.cases(spark, d).where("stored_at >= timestamp'1998-01-01'")
    return rows.select("case_id", (decay.age_seconds("stored_at", AS_OF) < 0).alias("future"))


# Streams: each runs to the end of the events and its table is read back


RELATED_SQL = "SELECT event_id || '-rel' AS memory_id, CAST(user_id AS VARCHAR) AS entity_id, CAST(event_id % 50 AS VARCHAR) AS target FROM events WHERE event_id % 3 = 0 AND event_id % 50 <> user_id"


@query(RELATED_SQL)
def streamed_relationships(spark, d):
    target = F.when(F.col("memory_id") % 3 == 0, (F.col("memory_id") % 50).cast("string"))
    rows = X.memory_of(X.event_stream(spark, d)).withColumn("attributes", F.map_filter(F.create_map(F.lit("target"), target), lambda _, v: v.isNotNull())).withColumn("memory_id", F.col("memory_id").cast("string"))
    path = shared_path(spark, "relationships")
    jobs.derive_relationships(rows, f"{path}/rows", f"{path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/rows").select("memory_id", "entity_id", F.col("attributes")["target"].alias("target"))


@query("SELECT event_id, value > 400 OR event_type = 'error' AS quarantined FROM events")
def streamed_quarantine(spark, d):
    path = shared_path(spark, "valid")
    ok = (F.col("value") <= 400) & (F.col("event_type") != "error")
    jobs.append_valid(X.event_stream(spark, d), ok, f"{path}/rows", f"{path}/quarantine", f"{path}/checkpoint").awaitTermination()
    good, bad = (spark.read.parquet(f"{path}/{part}").select("event_id") for part in ("rows", "quarantine"))
    return good.withColumn("quarantined", F.lit(False)).unionByName(bad.withColumn("quarantined", F.lit(True)))


@query("""WITH o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE event_id IN (SELECT min(event_id) FROM events GROUP BY user_id, ts))
    SELECT CAST(user_id AS VARCHAR) AS case_id, round(pow(0.8, max(n)) + sum(0.2 * pow(0.8, n - i) * least(value / 500.0, 1.0)), 9) AS confidence, count(*) AS applied FROM o GROUP BY user_id""")
def streamed_outcomes(spark, d):
    path = shared_path(spark, "outcomes")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    e = X.event_stream(spark, d).select(F.col("user_id").cast("string").alias("case_id"), F.col("s").alias("rate"), F.col("ts").alias("observed_at"), F.col("event_id").alias("seq"))
    write = lambda batch, n: batch.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{path}/batch={n}")
    jobs.outcome_confidence(e).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    found = spark.read.parquet(f"{path}/batch=*")
    last = found.groupBy("case_id").agg(F.max_by(F.struct("confidence", "applied"), "batch").alias("r"))
    return last.select("case_id", r6("r.confidence", "confidence"), F.col("r.applied").alias("applied"))
