"""The registered queries over the engine's own operators, and their DuckDB counterparts.

Doubles are rounded in results only, after ranking; every ranking has an id as its tie.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievework.functions import decay, schema as S, sequences, similarity, text, trends
from sievework.functions.vectors import softmax, truncate, vector
from sievework.operators import analytics, cases as C, evaluation, filters as P, fusion, lexical, memory as M, retrieval, vector_search
from sievework.plans import fixtures as X
from sievework.plans.registry import QUERIES, SQL, query, r6
from sievework.sources import corpus, logs

AS_OF = "1999-01-01 00:00:00"
NOW = "2024-01-31 00:00:00"
WORDS = "the tion and"


# Retrieval


def docs(spark: SparkSession, d: str) -> DataFrame:
    return X.table(spark, d, "documents").withColumnRenamed("doc_id", "id")


def first_vector(spark: SparkSession, d: str, vec_id: int = 0) -> list[float]:
    return X.table(spark, d, "embeddings").where(F.col("vec_id") == vec_id).first()["embedding"]


def dense_leg(spark: SparkSession, d: str, k: int = 40) -> DataFrame:
    return vector_search.dense_top_k(X.table(spark, d, "embeddings"), first_vector(spark, d), k, "vec_id")


def lexical_leg(spark: SparkSession, d: str, k: int = 40) -> DataFrame:
    return X.index(spark, d).search(spark, WORDS, k)


COS = "list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b)))"
LEGS_SQL = f"""
    q AS (SELECT CAST(embedding AS DOUBLE[]) AS b FROM embeddings WHERE vec_id = 0),
    dense AS (SELECT id, {COS} AS score FROM (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS a FROM embeddings) CROSS JOIN q ORDER BY score DESC, id LIMIT 40),
    seg AS (SELECT doc_id AS id, unnest(list_filter(regexp_split_to_array(text, '[^a-zA-Z0-9]+'), lambda x: x <> '')) AS s FROM documents),
    toks AS (SELECT id, lower(s) AS whole, list_filter(string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
                s, '([a-z])([A-Z])', '\\1|\\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1|\\2', 'g'), '([a-zA-Z])([0-9])', '\\1|\\2', 'g'),
                '([0-9])([a-zA-Z])', '\\1|\\2', 'g'), '|'), lambda x: x <> '') AS parts FROM seg),
    lens AS (SELECT doc_id AS id, coalesce(n, 0) AS n FROM documents LEFT JOIN (SELECT id, sum(len(parts) + CASE WHEN len(parts) > 1 THEN 1 ELSE 0 END) AS n FROM toks GROUP BY id) t ON t.id = doc_id),
    stat AS (SELECT count(*) AS n, avg(n) AS m FROM lens),
    tf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, lower(unnest(parts)) AS term FROM toks) WHERE term IN ('the', 'tion', 'and') GROUP BY 1, 2),
    tf2 AS (SELECT id, term, sum(tf) AS tf FROM (SELECT * FROM tf UNION ALL SELECT id, whole, count(*) FROM toks WHERE len(parts) > 1 AND whole IN ('the', 'tion', 'and') GROUP BY 1, 2) GROUP BY 1, 2),
    df AS (SELECT term, count(*) AS df FROM tf2 GROUP BY 1),
    scored AS (SELECT tf2.id, sum(ln((stat.n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * lens.n / m)) ORDER BY tf2.term) AS score
               FROM tf2 JOIN df ON df.term = tf2.term JOIN lens ON lens.id = tf2.id CROSS JOIN stat GROUP BY tf2.id),
    bm25 AS (SELECT * FROM scored ORDER BY score DESC, id LIMIT 40),
    legs AS (SELECT 'dense' AS leg, * FROM dense UNION ALL SELECT 'bm25', * FROM bm25),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY leg ORDER BY score DESC, id) AS r, min(score) OVER (PARTITION BY leg) AS lo, max(score) OVER (PARTITION BY leg) AS hi,
                      avg(score) OVER (PARTITION BY leg) AS mean, stddev_pop(score) OVER (PARTITION BY leg) AS sd FROM legs)
"""


def both_legs(spark: SparkSession, d: str) -> DataFrame:
    return fusion.legs({"dense": dense_leg(spark, d), "bm25": lexical_leg(spark, d)})


@query(f"WITH {LEGS_SQL} SELECT id, round(score, 9) AS score FROM dense")
def dense_topk(spark, d):
    return dense_leg(spark, d).select("id", r6("score"))


@query(f"""WITH qs AS (SELECT CAST(vec_id AS VARCHAR) AS query_id, CAST(embedding AS DOUBLE[]) AS b FROM embeddings WHERE vec_id % 50 = 0),
    s AS (SELECT query_id, id, {COS} AS score FROM (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS a FROM embeddings) CROSS JOIN qs),
    k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM s)
    SELECT query_id, id, round(score, 9) AS score FROM k WHERE r <= 10""")
def dense_topk_many(spark, d):
    e = X.table(spark, d, "embeddings")
    stated = {str(r["vec_id"]): r["embedding"] for r in e.where("vec_id % 50 = 0").collect()}  # the stated queries
    return vector_search.dense_top_k_many(e, stated, 10, "vec_id").select("query_id", "id", r6("score"))


@query("""WITH w AS (SELECT doc_id AS id, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: x <> '')) AS t FROM documents)
    SELECT id, round(score, 9) AS score FROM (SELECT id, sum(CAST(CASE t WHEN 'the' THEN 1.0 WHEN 'and' THEN 0.5 ELSE 2.0 END AS DOUBLE)) AS score FROM w WHERE t IN ('the', 'and', 'die') GROUP BY id) ORDER BY score DESC, id LIMIT 40""")
def sparse_topk(spark, d):
    asked = {"the": 1.0, "and": 0.5, "die": 2.0}
    words = docs(spark, d).select("id", F.explode(F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda t: t.isin(*asked))).alias("t"))
    counts = words.groupBy("id", "t").agg(F.count(F.lit(1)).cast("double").alias("n"))
    rows = counts.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("t", "n"))).alias("tokens"))  # three at most
    return vector_search.sparse_top_k(rows, asked, 40).select("id", r6("score"))


@query(f"WITH {LEGS_SQL} SELECT id, round(score, 9) AS score FROM bm25")
def bm25_topk(spark, d):
    return lexical_leg(spark, d).select("id", r6("score"))


@query(f"WITH {LEGS_SQL} SELECT 'a' AS query_id, id, round(score, 9) AS score FROM bm25 WHERE id IN (SELECT id FROM bm25 ORDER BY score DESC, id LIMIT 20)")
def bm25_many(spark, d):
    asked = spark.createDataFrame([("a", WORDS)], "query_id string, query string")
    return X.index(spark, d).search_many(spark, asked, 20).select("query_id", "id", r6("score"))


@query(f"WITH {LEGS_SQL} SELECT id, round(score, 9) AS score FROM scored JOIN documents ON doc_id = id WHERE lang = 'en' ORDER BY scored.score DESC, id LIMIT 10")
def bm25_filtered(spark, d):
    found = X.index(spark, d).search(spark, WORDS, 10, only=docs(spark, d).where("lang = 'en'"))
    return found.select("id", r6("score"))


@query(f"WITH {LEGS_SQL} SELECT id, round(score, 9) AS score FROM scored JOIN documents ON doc_id = id WHERE lang = 'en' ORDER BY scored.score DESC, id LIMIT 10")
def bm25_of_texts(spark, d):
    found = lexical.bm25(docs(spark, d), WORDS, 10, predicate=F.col("lang") == "en")
    return found.select("id", r6("score"))


@query(f"WITH {LEGS_SQL} SELECT id, round(s, 9) AS score FROM (SELECT id, sum(1.0 / (60 + r)) / (2.0 / 61) AS s FROM ranked GROUP BY id) ORDER BY s DESC, id LIMIT 10")
def rrf_fusion(spark, d):
    return fusion.reciprocal_rank(both_legs(spark, d), 60, top_k=10, names=["dense", "bm25"]).select("id", r6("score"))


@query(f"WITH {LEGS_SQL} SELECT id, round(s, 9) AS score FROM (SELECT id, sum(CASE leg WHEN 'dense' THEN 2.0 ELSE 0.5 END / (60 + r)) / (2.5 / 61) AS s FROM ranked GROUP BY id) ORDER BY s DESC, id LIMIT 10")
def weighted_rrf(spark, d):
    weights = fusion.effective_weights({"dense": 1.0, "bm25": 1.0}, {"dense": 2.0, "bm25": 0.5})
    return fusion.reciprocal_rank(both_legs(spark, d), 60, weights, 10).select("id", r6("score"))


@query(f"WITH {LEGS_SQL} SELECT id, round(s, 9) AS score FROM (SELECT id, sum(CASE leg WHEN 'dense' THEN 0.7 ELSE 0.3 END * CASE WHEN hi = lo THEN 1 ELSE (score - lo) / (hi - lo) END) AS s FROM ranked GROUP BY id) ORDER BY s DESC, id LIMIT 10")
def cc_fusion(spark, d):
    return fusion.convex(both_legs(spark, d), {"dense": 0.7, "bm25": 0.3}, 10).select("id", r6("score"))


@query(f"WITH {LEGS_SQL} SELECT id, round(s, 9) AS score FROM (SELECT id, sum((score - (mean - 3 * sd)) / (6 * sd)) AS s FROM ranked GROUP BY id) ORDER BY s DESC, id LIMIT 10")
def dbsf_fusion(spark, d):
    return fusion.distribution(both_legs(spark, d), 10).select("id", r6("score"))


@query(f"""WITH {LEGS_SQL}, ids AS (SELECT DISTINCT id FROM legs), ql AS (SELECT id, least(CAST(quality AS DOUBLE) / 1.0, 1.0) AS score FROM ids JOIN labels ON doc_id = id),
    qr AS (SELECT id, 'q' AS leg, score, min(score) OVER () AS lo, max(score) OVER () AS hi FROM ql),
    al AS (SELECT id, leg, score, lo, hi FROM ranked UNION ALL SELECT id, leg, score, lo, hi FROM qr)
    SELECT id, round(s, 9) AS score FROM (SELECT id, sum(CASE leg WHEN 'q' THEN 0.5 ELSE 1.0 END / 2.5 * CASE WHEN hi = lo THEN 1 ELSE (score - lo) / (hi - lo) END) AS s FROM al GROUP BY id)""")
def quality_leg(spark, d):
    quality = X.table(spark, d, "labels").select(F.col("doc_id").alias("id"), "quality")
    found = fusion.quality_leg(both_legs(spark, d), quality, "quality", 1.0)
    return fusion.convex(found, {"dense": 1.0, "bm25": 1.0, "quality": 0.5}).select("id", r6("score"))


@query(f"WITH {LEGS_SQL} SELECT id, round(bm25.score * (1 + coalesce(least(n_chars / 5000.0, 1.0) * 0.2, 0)), 9) AS score FROM bm25 JOIN documents ON doc_id = id")
def payload_boost(spark, d):
    found = lexical.with_columns(lexical_leg(spark, d), docs(spark, d), ["n_chars"])
    return fusion.payload_boost(found, "n_chars", 5000.0, 0.2).select("id", r6("score"))


def metadata(spark, d) -> DataFrame:
    kept = F.map_filter(F.create_map(F.lit("lang"), "lang", F.lit("source"), F.when(F.col("id") % 3 != 0, F.col("source")), F.lit("n_chars"), F.col("n_chars").cast("string")), lambda _, v: v.isNotNull())
    lists = F.create_map(F.lit("tags"), F.array("lang", "source"))
    return docs(spark, d).select("id", kept.alias("metadata"), lists.alias("lists"))


@query("SELECT doc_id AS id FROM documents WHERE lang = 'en' OR lang = 'src3' OR source = 'src3'")
def payload_filter_in(spark, d):
    f = P.Or((P.Eq("lang", "en"), P.In("tags", ("src3",))))
    return metadata(spark, d).where(P.payload(f, lists="lists")).select("id")


@query("SELECT doc_id AS id FROM documents WHERE NOT coalesce(CASE WHEN doc_id % 3 <> 0 THEN source END = 'src3', false) AND lang IN ('en', 'de')")
def payload_filter_not(spark, d):
    f = P.And((P.Not(P.Eq("source", "src3")), P.In("lang", ("en", "de"))))
    return metadata(spark, d).where(P.payload(f)).select("id")


@query("SELECT doc_id AS id FROM documents WHERE n_chars BETWEEN 500 AND 2000")
def payload_filter_range(spark, d):
    return metadata(spark, d).where(P.payload(P.Between("n_chars", 500, 2000))).select("id")


NEAR_SQL = """WITH e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS a FROM embeddings)
    SELECT n.id FROM e n WHERE n.id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM (SELECT a AS b FROM e WHERE id % 2 = 0) s WHERE """ + COS.replace("(a", "(n.a").replace(", a)", ", n.a)") + " >= {})"


def ingested(spark, d, threshold):
    e = X.table(spark, d, "embeddings").withColumnRenamed("vec_id", "id")
    return vector_search.without_near_copies(e.where("id % 2 = 1"), e.where("id % 2 = 0"), threshold).select("id")


@query(NEAR_SQL.format(0.95))
def near_copies_at_ingest(spark, d):
    return ingested(spark, d, 0.95)


@query(NEAR_SQL.format(0.5))
def near_copies_at_half(spark, d):
    return ingested(spark, d, 0.5)


@query("""WITH e AS (SELECT vec_id AS id, list_transform(CAST(embedding AS DOUBLE[])[1:16], lambda x: x) AS v FROM embeddings)
    SELECT id, round(v[1] / sqrt(list_dot_product(v, v)), 9) AS first, round(list_dot_product(v, v) / list_dot_product(v, v), 9) AS length FROM e""")
def matryoshka(spark, d):
    e = X.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), truncate("embedding", 16).alias("v"))
    return e.select("id", r6(F.col("v")[0], "first"), r6(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x), "length"))


@query("""WITH e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[])[1:4] AS v FROM embeddings), x AS (SELECT id, list_transform(v, lambda y: exp(y - list_max(v))) AS e FROM e)
    SELECT id, round(e[1] / list_sum(e), 9) AS p1, round(list_max(e) / list_sum(e), 9) AS best FROM x""")
def classifier_head(spark, d):
    p = softmax(F.slice("embedding", 1, 4))
    return X.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), r6(p[0], "p1"), r6(F.array_max(p), "best"))


@query(f"""WITH {LEGS_SQL}, g AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS position, CASE WHEN id % 3 = 0 THEN 'INCORRECT' WHEN id % 3 = 1 THEN 'CORRECT' ELSE 'AMBIGUOUS' END AS grade FROM scored),
    f AS (SELECT * FROM g WHERE position <= 10), need AS (SELECT count(*) FILTER (WHERE grade <> 'INCORRECT') < 10 AND count(*) FILTER (WHERE grade = 'INCORRECT') > 0 AS need FROM f),
    b AS (SELECT id, grade, 1 AS pass, position FROM f WHERE grade <> 'INCORRECT' UNION ALL SELECT id, grade, 2, position FROM g CROSS JOIN need WHERE need AND position BETWEEN 11 AND 30 AND grade <> 'INCORRECT')
    SELECT id, grade FROM b ORDER BY (grade <> 'CORRECT')::INT, pass, position LIMIT 10""")
def corrective_retrieval(spark, d):
    found = lexical_leg(spark, d, 30)
    placed = found.withColumn("position", F.row_number().over(Window.orderBy(F.desc("score"), "id")))  # 30 rows
    grader = lambda _: retrieval.grade(F.element_at(F.array(F.lit(0.1), F.lit(0.9), F.lit(0.5)), (F.col("id") % 3 + 1).cast("int")))
    return retrieval.corrective(placed.where("position <= 10"), placed, 10, grader, ["id"]).select("id", "grade")


@query(f"WITH {LEGS_SQL} SELECT id, round(n_chars / 1000.0, 9) AS score, round(bm25.score, 9) AS first_score FROM bm25 JOIN documents ON doc_id = id WHERE id IN (SELECT id FROM bm25 ORDER BY bm25.score DESC, id LIMIT 30) ORDER BY n_chars DESC, id LIMIT 5")
def rerank_topk(spark, d):
    found = lexical.with_columns(lexical_leg(spark, d), docs(spark, d), ["n_chars"])
    return retrieval.rerank(found, lambda _: F.col("n_chars") / 1000.0, 5).select("id", r6("score"), r6("first_score"))


EXPANDED = {("a", 0): ("the",), ("a", 1): ("the", "and"), ("a", 2): ("passages", "about", "the"), ("b", 0): ("die",), ("b", 1): ("die", "and"), ("b", 2): ("passages", "about", "die")}
ASKED_SQL = ", ".join(f"('{q}', {v}, '{t}')" for (q, v), terms in EXPANDED.items() for t in terms)
EVERY_TERM = ", ".join(sorted({f"'{t}'" for terms in EXPANDED.values() for t in terms}))


@query(f"""WITH {LEGS_SQL.replace("('the', 'tion', 'and')", f"({EVERY_TERM})")}, asked(query_id, variant, term) AS (VALUES {ASKED_SQL}),
    hits AS (SELECT query_id, variant, tf2.id, sum(ln((stat.n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * lens.n / m)) ORDER BY asked.term) AS score
             FROM asked JOIN tf2 ON tf2.term = asked.term JOIN df ON df.term = asked.term JOIN lens ON lens.id = tf2.id CROSS JOIN stat GROUP BY 1, 2, 3),
    best AS (SELECT *, row_number() OVER (PARTITION BY query_id, variant ORDER BY score DESC, id) AS r FROM hits),
    held AS (SELECT * FROM best WHERE r <= 20), legs_of AS (SELECT query_id, count(DISTINCT variant) AS legs FROM held GROUP BY 1),
    fused AS (SELECT held.query_id, id, sum(1.0 / (60 + r)) / (any_value(legs) / 61.0) AS s FROM held JOIN legs_of ON legs_of.query_id = held.query_id GROUP BY 1, 2),
    cut AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS r FROM fused)
    SELECT query_id, id, round(s, 9) AS score FROM cut WHERE r <= 10""")
def expansion_fan_out(spark, d):
    queries_ = spark.createDataFrame([("a", "the"), ("b", "die")], "query_id string, text string")
    variants = retrieval.expand(queries_, [lambda t: F.concat(t, F.lit(" and")), lambda t: text.template_query(t)])
    named = variants.select(F.concat_ws("#", "query_id", "variant").alias("query_id"), F.col("expanded").alias("query"))
    found = X.index(spark, d).search_many(spark, named, 20)
    found = found.select(F.substring_index("query_id", "#", 1).alias("query_id"), F.substring_index("query_id", "#", -1).alias("variant"), "id", "score")
    return retrieval.fan_out(found, 10).select("query_id", "id", r6("score"))


# Cases

SCHEMA = S.Schema("order", (S.Categorical("priority", {("1-URGENT", "2-HIGH"): 0.6, ("2-HIGH", "3-MEDIUM"): 0.4}), S.Categorical("segment"), S.Numeric("price", 0, 500000), S.Text("status")))
ASKED = {"priority": "1-URGENT", "segment": "BUILDING", "price": 150000.0, "status": "O"}
WEIGHTS = {"priority": 2.0, "price": 3.0}
PARTS_SQL = """
    p AS (SELECT *, CASE priority WHEN '1-URGENT' THEN 1.0 WHEN '2-HIGH' THEN 0.6 ELSE 0 END AS a, CASE WHEN segment = 'BUILDING' THEN 1.0 ELSE 0 END AS b,
                 greatest(0.0, 1 - abs(price - 150000) / 500000) AS c, CASE WHEN status = 'O' THEN 1.0 ELSE 0 END AS e FROM cases),
    sc AS (SELECT *, (2 * a + b + 3 * c + e) / 7.0 AS score FROM p)
"""


@query(f"WITH {X.CASES_SQL}, {PARTS_SQL} SELECT case_id, round(score, 9) AS score FROM sc WHERE tenant_id = 'ASIA' AND score >= 0.5 ORDER BY sc.score DESC, case_id LIMIT 50")
def case_similarity(spark, d):
    rows = X.cases(spark, d).where(P.identity("ASIA", "sales", "order"))
    return C.similar(rows, SCHEMA, ASKED, WEIGHTS, 0.5, 50).select("case_id", r6("score"))


@query(f"WITH {X.CASES_SQL}, {PARTS_SQL} SELECT case_id, round(2 * a / 7, 9) AS priority_part, round(3 * c / 7, 9) AS price_part FROM sc")
def case_breakdown(spark, d):
    b = similarity.breakdown(SCHEMA, ASKED, WEIGHTS)
    return X.cases(spark, d).select("case_id", r6(b["priority"], "priority_part"), r6(b["price"], "price_part"))


@query(f"""WITH {X.CASES_SQL}, dd AS (SELECT case_id, abs(price - 150000) / 500000 AS d, greatest(100000 - price, price - 200000, 0) / 500000 AS dr FROM cases)
    SELECT case_id, round(greatest(0, 1 - dr), 9) AS in_range, round(exp(-d * d / (2 * 0.01)), 9) AS gaussian, CAST(CASE WHEN d <= 0.1 THEN 1.0 ELSE 0.0 END AS DOUBLE) AS step, round(exp(-3 * d), 9) AS exponential FROM dd""")
def case_numeric_specs(spark, d):
    of = lambda q, spec, p=0.0: similarity.numeric(q, F.col("price"), 0, 500000, spec, p)
    return X.cases(spark, d).select("case_id", r6(of(S.Range(100000, 200000), "linear"), "in_range"), r6(of(150000.0, "gaussian", 0.1), "gaussian"), of(150000.0, "step", 0.1).alias("step"), r6(of(150000.0, "exponential", 3.0), "exponential"))


@query(f"""WITH {X.CASES_SQL}, {PARTS_SQL},
    st AS (SELECT case_id, score * CASE WHEN date_diff('second', stored_at, TIMESTAMP '{AS_OF}') < 0 THEN 1 ELSE pow(0.5, date_diff('second', stored_at, TIMESTAMP '{AS_OF}') / 31536000.0) END
                  * pow(0.5, greatest(2 - len(string_split(scope, '/')), 0)) * (0.7 + 0.3 * confidence) AS s1, trust FROM sc WHERE tenant_id = 'ASIA')
    SELECT case_id, round(s, 9) AS score FROM (SELECT case_id, CASE WHEN trust IS NULL THEN s1 ELSE s1 * (0.7 + 0.3 * trust) END AS s FROM st) ORDER BY s DESC, case_id LIMIT 25""")
def case_stages(spark, d):
    rows = X.cases(spark, d).where(P.identity("ASIA"))
    stages = [C.temporal(AS_OF, "half_life", timedelta(days=365)), C.scoped("NATION_2/BUILDING"), C.by_outcome(), C.by_trust()]
    return C.similar(rows, SCHEMA, ASKED, WEIGHTS, 0.0, 25, stages).select("case_id", r6("score"))


@query(f"""WITH {X.CASES_SQL}, a AS (SELECT *, date_diff('second', stored_at, TIMESTAMP '{AS_OF}') AS age FROM cases)
    SELECT case_id, round(CASE WHEN age < 0 THEN 1 ELSE greatest(0, 1 - age / 63072000.0) END, 9) AS linear, CAST(CASE WHEN age < 31536000 THEN 1.0 ELSE 0.25 END AS DOUBLE) AS step, round(CASE WHEN age < 0 THEN 1 ELSE pow(0.5, age / 31536000.0) END, 9) AS half FROM a""")
def temporal_decays(spark, d):
    return X.cases(spark, d).select("case_id", r6(decay.linear_decay("stored_at", AS_OF, timedelta(days=730)), "linear"), decay.step_decay("stored_at", AS_OF, timedelta(days=365), 0.25).alias("step"), r6(decay.half_life("stored_at", AS_OF, timedelta(days=365)), "half"))


LISTS_SQL = """
    li AS (SELECT l_orderkey AS case_id, list(DISTINCT l_returnflag) AS flags, list(l_quantity) AS quantities FROM lineitem GROUP BY 1)
"""


@query(f"WITH {LISTS_SQL} SELECT case_id, round(len(list_intersect(flags, ['R', 'N'])) / CAST(len(list_distinct(list_concat(flags, ['R', 'N']))) AS DOUBLE), 9) AS jaccard FROM li")
def case_list_jaccard(spark, d):
    return X.order_lists(spark, d).select("case_id", r6(similarity.list_jaccard(["R", "N"], F.col("flags")), "jaccard"))


@query("""WITH s AS (SELECT l_orderkey AS case_id, max(greatest(0, 1 - abs(l_quantity - 10) / 50)) AS a, max(greatest(0, 1 - abs(l_quantity - 45) / 50)) AS b FROM lineitem GROUP BY 1)
    SELECT case_id, round((a + b) / 2, 9) AS score FROM s""")
def case_numeric_list(spark, d):
    return X.order_lists(spark, d).select("case_id", r6(similarity.numeric_list([10.0, 45.0], F.col("quantities"), 0, 50), "score"))


@query("""WITH s AS (SELECT l_orderkey AS case_id, max((greatest(0, 1 - abs(l_quantity - 20) / 50) + CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) / 2) AS a, max(CASE WHEN l_returnflag = 'N' THEN 1.0 ELSE 0 END) AS b FROM lineitem GROUP BY 1)
    SELECT case_id, round((a + b) / 2, 9) AS score FROM s""")
def case_object_list(spark, d):
    fields = (S.Numeric("quantity", 0, 50), S.Categorical("flag"))
    return X.order_lists(spark, d).select("case_id", r6(similarity.object_list([{"quantity": 20.0, "flag": "R"}, {"flag": "N"}], F.col("lines"), fields), "score"))


@query("""SELECT l_orderkey AS case_id FROM lineitem GROUP BY 1
    HAVING count(*) FILTER (WHERE l_returnflag = 'R' AND l_quantity BETWEEN 40 AND 50) > 0 AND count(*) FILTER (WHERE l_returnflag = 'N') = 0 AND count(*) FILTER (WHERE l_quantity BETWEEN 1 AND 5) > 0""")
def case_filters(spark, d):
    rows = X.order_lists(spark, d)
    keep = P.case_filter(P.HasMatch({"flag": "R", "quantity": S.Range(40, 50)}), "lines") & P.case_filter(P.AllOf((P.Contains("R"), P.NotContains("N"))), "flags") & P.case_filter(P.ContainsRange(S.Range(1, 5)), "quantities")
    return rows.where(keep).select("case_id")


@query(f"WITH {X.CASES_SQL} SELECT tenant_id, case_id FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY stored_at DESC, case_id) AS r FROM cases WHERE stored_at >= TIMESTAMP '1996-01-01') WHERE r <= 100 AND NOT coalesce(trust < 0.5, false)")
def case_purge(spark, d):
    return C.purge(X.cases(spark, d), "1996-01-01", 100, 0.5).select("tenant_id", "case_id")


@query(f"WITH {X.CASES_SQL} SELECT producer, count(*) AS purged FROM cases WHERE CAST(substr(producer, 2) AS INT) / 49.0 < 0.3 GROUP BY 1")
def case_trust_sweep(spark, d):
    trust = spark.createDataFrame([(f"c{i}", i / 49.0) for i in range(50)], "producer string, current_trust double")
    return C.trust_sweep(X.cases(spark, d), trust)[1]


@query("""WITH o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE event_id IN (SELECT min(event_id) FROM events GROUP BY user_id, ts))
    SELECT CAST(user_id AS VARCHAR) AS case_id, round(pow(0.8, max(n)) + sum(0.2 * pow(0.8, n - i) * least(value / 500.0, 1.0)), 9) AS confidence, count(*) AS applied FROM o GROUP BY user_id""")
def outcome_ema(spark, d):
    e = X.events(spark, d).select(F.col("user_id").cast("string").alias("case_id"), F.col("s").alias("rate"), F.col("ts").alias("observed_at"), F.col("event_id").alias("seq"))
    return C.fold_outcomes(e).select("case_id", r6("confidence"), "applied")


@query("""SELECT CAST(l_linenumber AS VARCHAR) AS step, count(*) AS occurrences, count(*) FILTER (WHERE l_returnflag = 'R') AS returned FROM lineitem GROUP BY 1""")
def plan_consensus(spark, d):
    li = X.table(spark, d, "lineitem")
    steps = li.select(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").cast("string").alias("step"), (F.col("l_suppkey") % 5).cast("string").alias("worker"), F.col("l_returnflag").alias("outcome"), (F.col("l_linenumber") % 2).alias("priority"))
    return C.step_consensus(steps).select("step", "occurrences", F.coalesce(F.try_element_at("outcomes", F.lit("R")), F.lit(0)).cast("long").alias("returned"))


@query(f"""WITH {X.CASES_SQL}, {PARTS_SQL}, f AS (SELECT 'feature' AS leg, case_id AS id, score FROM sc ORDER BY sc.score DESC, id LIMIT 100), v AS (SELECT 'dense' AS leg, case_id AS id, 1 - price / 600000 AS score FROM cases ORDER BY score DESC, id LIMIT 100),
    l AS (SELECT * FROM f UNION ALL SELECT * FROM v), r AS (SELECT *, min(score) OVER (PARTITION BY leg) AS lo, max(score) OVER (PARTITION BY leg) AS hi FROM l)
    SELECT id, round(s, 9) AS score FROM (SELECT id, sum(CASE leg WHEN 'feature' THEN 0.5 ELSE 0.3 END / 0.8 * CASE WHEN hi = lo THEN 1 ELSE (score - lo) / (hi - lo) END) AS s FROM r GROUP BY id) WHERE s >= 0.2 ORDER BY s DESC, id LIMIT 20""")
def case_hybrid(spark, d):
    rows = X.cases(spark, d)
    feature = C.similar(rows, SCHEMA, ASKED, WEIGHTS, 0.0, 100).select(F.col("case_id").alias("id"), "score")
    dense = fusion.top(rows.select(F.col("case_id").alias("id"), (1 - F.col("price") / 600000).alias("score")), 100)
    return C.hybrid({"feature": feature, "dense": dense}, "cc", 0.5, 20, 0.2).select("id", r6("score"))


# Memory


@query(f"WITH {X.MEMORY_SQL} SELECT memory_id FROM memory WHERE entity_id IN ('1', '2', '3') AND created_at >= TIMESTAMP '2024-01-05' ORDER BY created_at DESC, memory_id LIMIT 20")
def memory_chronological(spark, d):
    return M.query(X.memory(spark, d), M.Query("t", ["1", "2", "3"], since="2024-01-05")).select("memory_id")


@query(f"WITH {X.MEMORY_SQL} SELECT memory_id, round(s, 9) AS salience FROM (SELECT memory_id, coalesce(importance, 1.0) / (1 + (epoch(TIMESTAMP '{NOW}') - epoch(created_at)) / 3600) AS s FROM memory WHERE entity_id IN ('1', '2', '3')) ORDER BY s DESC, memory_id LIMIT 20")
def memory_salience(spark, d):
    return M.query(X.memory(spark, d), M.Query("t", ["1", "2", "3"], order=M.Order.SALIENCE), NOW).select("memory_id", r6("salience"))


@query(f"""WITH {X.MEMORY_SQL}, m AS (SELECT memory_id, k FROM memory WHERE CAST(entity_id AS INT) BETWEEN 1 AND 20), n AS (SELECT count(*) AS n, count(*) FILTER (WHERE k = 7) AS df FROM m)
    SELECT memory_id, round(ln((n - df + 0.5) / (df + 0.5) + 1), 9) AS relevance FROM m CROSS JOIN n WHERE k = 7 ORDER BY memory_id LIMIT 20""")
def memory_relevance(spark, d):
    ids = [str(i) for i in range(1, 21)]
    return M.query(X.memory(spark, d), M.Query("t", ids, question="7?", order=M.Order.RELEVANCE)).select("memory_id", r6("relevance"))


@query(f"""WITH {X.MEMORY_SQL}, w AS (SELECT memory_id, exp(-((epoch(TIMESTAMP '{NOW}') - epoch(created_at)) / 3600) / 168.0) * coalesce(importance, 1.0) * CASE domain WHEN 'purchase' THEN 2.0 WHEN 'error' THEN 0.1 ELSE 1.0 END AS w,
           1 + 0.4 * (1 - sqrt(pow((memory_id % 10) / 10.0 - 0.2, 2) + pow(0.5 - 0.1, 2) + pow(0.0 - 0.3, 2)) / sqrt(12.0) - 0.5) AS m FROM memory WHERE entity_id = '5')
    SELECT memory_id, round(w * m, 9) AS weight FROM w""")
def memory_mood(spark, d):
    rows = X.memory(spark, d).where("entity_id = '5'")
    return M.personality(rows, {"purchase": 2.0, "error": 0.1}, NOW, (0.2, 0.1, 0.3), 0.4).select("memory_id", r6("weight"))


@query(f"WITH {X.MEMORY_SQL} SELECT memory_id FROM memory WHERE k = 7 AND memory_id > 100 ORDER BY memory_id LIMIT 25")
def memory_scan(spark, d):
    return M.scan(X.memory(spark, d), "t", 25, 100, ("k", "7")).select("memory_id")


@query(f"WITH {X.MEMORY_SQL} SELECT memory_id FROM memory WHERE NOT (created_at < TIMESTAMP '2024-01-10' AND coalesce(importance < 0.2, false))")
def memory_purge(spark, d):
    return X.memory(spark, d).where(~M.purged("2024-01-10", 0.2)).select("memory_id")


@query(f"WITH {X.MEMORY_SQL} SELECT count(*) AS erased FROM memory WHERE entity_id = '7' AND domain = 'click'")
def memory_erase(spark, d):
    return M.erase(X.memory(spark, d), M.erased("t", "7", "click"))[1]


@query("SELECT event_id AS memory_id FROM events WHERE CAST(ts AS TIMESTAMP) <= TIMESTAMP '2024-01-15' AND (user_id % 2 = 0 OR TIMESTAMP '2024-01-15' < CAST(ts AS TIMESTAMP) + INTERVAL 5 DAY)")
def valid_facts(spark, d):
    until = F.when(F.col("user_id") % 2 != 0, F.col("ts") + F.expr("INTERVAL 5 DAYS"))
    return X.events(spark, d).where(P.valid_at("ts", until, "2024-01-15")).select(F.col("event_id").alias("memory_id"))


# Analytics


def log(spark, d):
    return X.records(spark, d), X.retrieved(spark, d), X.feedback(spark, d)


COUNTS = ", ".join(f"count(*) FILTER (WHERE outcome = '{o}') AS {o.lower()}" for o in analytics.OUTCOMES)
STATS_SQL = f"""
    base AS (SELECT doc, count(*) AS retrievals, max(ts) AS last_ts, avg(score) AS avg_score FROM rd JOIN rec USING (retrieval_id) WHERE rec.ts >= TIMESTAMP '2024-01-10' AND rec.ts < TIMESTAMP '{NOW}' GROUP BY doc),
    fj AS (SELECT fb.doc, fb.outcome FROM fb WHERE fb.ts >= TIMESTAMP '2024-01-10' AND EXISTS (SELECT 1 FROM rec r WHERE r.retrieval_id = fb.retrieval_id AND r.ts >= TIMESTAMP '2024-01-10' AND r.ts < TIMESTAMP '{NOW}')),
    fc AS (SELECT doc, {COUNTS} FROM fj GROUP BY doc),
    st AS (SELECT base.doc, retrievals, last_ts, avg_score, coalesce(highly_relevant, 0) AS highly_relevant, coalesce(relevant, 0) AS relevant, coalesce(partially_relevant, 0) AS partially_relevant, coalesce(not_relevant, 0) AS not_relevant FROM base LEFT JOIN fc ON fc.doc = base.doc),
    never AS (SELECT 'u' || c_custkey AS doc FROM customer WHERE 'u' || c_custkey NOT IN (SELECT doc FROM base))
"""


@query(f"WITH {X.LOG_SQL}, {STATS_SQL} SELECT doc, retrievals, CAST(epoch_us(last_ts) AS BIGINT) AS last_us, round(avg_score, 9) AS avg_score, highly_relevant, relevant, partially_relevant, not_relevant FROM st")
def doc_stats(spark, d):
    s = analytics.document_stats(*log(spark, d), "2024-01-10", NOW)
    return s.select("doc", "retrievals", F.unix_micros("last_ts").alias("last_us"), r6("avg_score"), *[o.lower() for o in analytics.OUTCOMES])


@query(f"WITH {X.LOG_SQL}, {STATS_SQL} SELECT doc FROM never")
def unretrieved(spark, d):
    records, found, _ = log(spark, d)
    return analytics.unretrieved(X.corpus_documents(spark, d), records, found, "2024-01-10", NOW)


@query(f"""WITH {X.LOG_SQL}, {STATS_SQL}, g AS (SELECT doc, CASE WHEN retrievals >= 3 AND highly_relevant + relevant + partially_relevant + not_relevant >= 3
        AND (partially_relevant + not_relevant) / CAST(highly_relevant + relevant + partially_relevant + not_relevant AS DOUBLE) >= 0.7 THEN 'HIGH_RETRIEVAL_LOW_QUALITY'
        WHEN last_ts < TIMESTAMP '{NOW}' - INTERVAL 24 HOUR THEN 'STALE' END AS signal FROM st)
    SELECT doc, 'NEVER_RETRIEVED' AS signal FROM never UNION ALL SELECT doc, signal FROM g WHERE signal IS NOT NULL""")
def quality_signals(spark, d):
    records, found, judged = log(spark, d)
    stats = analytics.document_stats(records, found, judged, "2024-01-10", NOW)
    never = analytics.unretrieved(X.corpus_documents(spark, d), records, found, "2024-01-10", NOW)
    return analytics.quality_signals(stats, never, NOW, stale_seconds=86400)


MEANS_SQL = "mean AS (SELECT rec.retrieval_id, query_text, rec.ts, avg(score) AS m FROM rec LEFT JOIN rd ON rd.retrieval_id = rec.retrieval_id GROUP BY 1, 2, 3)"


@query(f"WITH {X.LOG_SQL}, {MEANS_SQL} SELECT query_text, round(avg(m), 9) AS avg_score, count(*) AS retrievals FROM mean WHERE m IS NOT NULL GROUP BY 1 HAVING avg(m) < 0.3")
def low_relevance(spark, d):
    records, found, _ = log(spark, d)
    return analytics.low_relevance(records, found, 0.3).select("query_text", r6("avg_score"), "retrievals")


@query(f"WITH {X.LOG_SQL} SELECT query_text, count(*) AS misses, CAST(epoch_us(max(ts)) AS BIGINT) AS last_us FROM rec WHERE retrieval_id NOT IN (SELECT retrieval_id FROM rd) GROUP BY 1")
def zero_hit(spark, d):
    records, found, _ = log(spark, d)
    return analytics.zero_hits(records, found).select("query_text", "misses", F.unix_micros("last_ts").alias("last_us"))


@query(f"WITH {X.LOG_SQL}, {MEANS_SQL} SELECT query_text, count(*) AS retrievals, round(avg(coalesce(m, 0)), 9) AS avg_score, CAST(epoch_us(min(ts)) AS BIGINT) AS first_us FROM mean GROUP BY 1")
def query_frequency(spark, d):
    records, found, _ = log(spark, d)
    return analytics.query_frequency(records, found).select("query_text", "retrievals", r6("avg_score"), F.unix_micros("first_ts").alias("first_us"))


EDGES_SQL = f"edges AS (SELECT lower(trim(query_text)) AS query, rd.doc, count(*) AS together, avg(score) AS avg_score, {COUNTS} FROM rd JOIN rec USING (retrieval_id) LEFT JOIN fb ON fb.retrieval_id = rd.retrieval_id AND fb.doc = rd.doc GROUP BY 1, 2)"


def edges(spark, d):
    return analytics.correlation_graph(*log(spark, d))


@query(f"WITH {X.LOG_SQL}, {EDGES_SQL} SELECT query, doc, together, round(avg_score, 9) AS avg_score, highly_relevant, relevant, partially_relevant, not_relevant FROM edges")
def correlation_edges(spark, d):
    return edges(spark, d).withColumn("avg_score", r6("avg_score"))


@query(f"WITH {X.LOG_SQL}, {EDGES_SQL} SELECT doc, count(*) AS queries, CAST(sum(together) AS BIGINT) AS retrievals, round(sum(avg_score * together) / sum(together), 9) AS avg_score, CAST(sum(relevant) AS BIGINT) AS relevant FROM edges GROUP BY doc")
def doc_impact(spark, d):
    return analytics.document_impact(edges(spark, d)).select("doc", "queries", "retrievals", r6("avg_score"), "relevant")


PAIRS_SQL = """
    n AS (SELECT query, count(*) AS n FROM edges GROUP BY 1),
    meet AS (SELECT a.query AS q1, b.query AS q2, count(*) AS c FROM edges a JOIN edges b ON a.doc = b.doc AND a.query < b.query GROUP BY 1, 2),
    pairs AS (SELECT q1, q2, c / CAST(x.n + y.n - c AS DOUBLE) AS jaccard FROM meet JOIN n x ON x.query = q1 JOIN n y ON y.query = q2)
"""


@query(f"WITH {X.LOG_SQL}, {EDGES_SQL}, {PAIRS_SQL} SELECT q1, q2, round(jaccard, 9) AS jaccard FROM pairs WHERE jaccard >= 0.37")
def jaccard_pairs(spark, d):
    return analytics.jaccard_pairs(edges(spark, d), 0.37).select("q1", "q2", r6("jaccard"))


@query(f"""WITH RECURSIVE {X.LOG_SQL}, {EDGES_SQL}, {PAIRS_SQL}, e AS (SELECT q1 AS a, q2 AS b FROM pairs WHERE jaccard >= 0.37 UNION SELECT q2, q1 FROM pairs WHERE jaccard >= 0.37),
    walk AS (SELECT a AS query, a AS reach FROM e UNION SELECT walk.query, e.b FROM walk JOIN e ON e.a = walk.reach),
    comp AS (SELECT query, min(reach) AS cluster FROM walk GROUP BY 1)
    SELECT cluster, count(*) AS size FROM comp GROUP BY 1""")
def query_clusters(spark, d):
    return analytics.query_clusters(edges(spark, d), 0.37).select("cluster", "size")


@query(f"WITH {X.LOG_SQL}, {EDGES_SQL}, {PAIRS_SQL} SELECT q1, q2, round(jaccard, 9) AS jaccard FROM pairs WHERE jaccard >= 0.37")
def lsh_pairs(spark, d):
    sets = edges(spark, d).groupBy(F.col("query").alias("q")).agg(F.collect_set("doc").alias("items"))
    return analytics.lsh_pairs(sets, 0.37).select("q1", "q2", r6("jaccard"))


@query("SELECT event_type, min(value) AS low, max(value) AS high, percentile_disc(0.5) WITHIN GROUP (ORDER BY value) AS median, percentile_disc(0.75) WITHIN GROUP (ORDER BY value) AS p75, count(value) AS n FROM events GROUP BY 1")
def feature_statistics(spark, d):
    return analytics.feature_statistics(X.table(spark, d, "events"), "value", ["event_type"])


@query("SELECT round(quantile_cont(value, 0.75), 9) AS correct_from, round(quantile_cont(value, 0.25), 9) AS incorrect_to FROM events")
def calibrate(spark, d):
    return analytics.calibrate(X.table(spark, d, "events"), "value").select(r6("correct_from"), r6("incorrect_to"))


# Trends and sequences

SERIES_SQL = """
    o AS (SELECT user_id, epoch_us(CAST(ts AS TIMESTAMP)) / 1e6 AS t, value AS v, row_number() OVER w AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    h AS (SELECT *, i <= n // 2 AS one FROM o)
"""


@query(f"""WITH {SERIES_SQL}, a AS (SELECT user_id, coalesce(regr_slope(v, t), 0) AS slope, max_by(v, i) - min_by(v, i) AS delta, stddev_pop(v) AS volatility, max(t) - min(t) AS duration, count(*) AS n,
        regr_slope(v, t) FILTER (WHERE one) AS s1, regr_slope(v, t) FILTER (WHERE NOT one) AS s2, (min(t) FILTER (WHERE one) + max(t) FILTER (WHERE one)) / 2 AS m1, (min(t) FILTER (WHERE NOT one) + max(t) FILTER (WHERE NOT one)) / 2 AS m2 FROM h GROUP BY 1)
    SELECT user_id, round(slope * 1e3, 9) AS slope, round(delta, 9) AS delta, round(volatility, 9) AS volatility, round(CASE WHEN n < 4 OR m1 = m2 THEN 0 ELSE (coalesce(s2, 0) - coalesce(s1, 0)) / (m2 - m1) END * 1e9, 4) AS acceleration, round(duration, 3) AS duration, CAST(n AS DOUBLE) AS count FROM a""")
def trend_features(spark, d):
    s = X.series(spark, d).select("user_id", trends.field("obs", "t").alias("t"), trends.field("obs", "v").alias("v"))
    of = lambda kind: trends.trend(kind, F.col("t"), F.col("v"))
    return s.select("user_id", r6(of("slope") * 1e3, "slope"), r6(of("delta"), "delta"), r6(of("volatility"), "volatility"), F.round(of("acceleration") * 1e9, 4).alias("acceleration"), F.round(of("duration"), 3).alias("duration"), of("count").alias("count"))


@query(f"""WITH RECURSIVE {SERIES_SQL}, st AS (SELECT user_id, avg(v) AS m, stddev_pop(v) AS sd, count(*) AS n FROM o GROUP BY 1),
    f AS (SELECT user_id, CAST(0 AS BIGINT) AS i, 0.0::DOUBLE AS up, 0.0::DOUBLE AS down, 0 AS c FROM st
          UNION ALL SELECT user_id, i, CASE WHEN alarm THEN 0 ELSE up END, CASE WHEN alarm THEN 0 ELSE down END, c + CASE WHEN alarm THEN 1 ELSE 0 END FROM (
              SELECT *, up > 1.5 * sd OR down > 1.5 * sd AS alarm FROM (SELECT f.user_id, o.i AS i, greatest(0, f.up + o.v - st.m) AS up, greatest(0, f.down - o.v + st.m) AS down, f.c AS c, st.sd AS sd FROM f JOIN o ON o.user_id = f.user_id AND o.i = f.i + 1 JOIN st ON st.user_id = f.user_id) x) y)
    SELECT f.user_id, CASE WHEN n < 3 OR sd = 0 THEN 0 ELSE max(c) END AS alarms FROM f JOIN st ON st.user_id = f.user_id GROUP BY f.user_id, n, sd""")
def change_points(spark, d):
    return X.series(spark, d).select("user_id", trends.change_points(trends.field("obs", "v")).alias("alarms"))


@query("""WITH l AS (SELECT user_id, string_agg(substr(event_type, 1, 1), '' ORDER BY ts, event_id) AS s, count(*) AS n FROM events GROUP BY 1),
    q AS (SELECT s AS qs, n AS qn FROM l WHERE user_id = (SELECT min(user_id) FROM events))
    SELECT user_id, round(1 - levenshtein(qs, s) / CAST(greatest(qn, n) AS DOUBLE), 9) AS score FROM l CROSS JOIN q""")
def edit_distance(spark, d):
    s = X.series(spark, d)
    asked = s.orderBy("user_id").first()["labels"]
    return s.select("user_id", r6(sequences.edit(asked, F.col("labels")), "score"))


GAME = S.TimeSeries("obs", "t", (S.Numeric("t", 0, 1), S.Numeric("v", 0, 500)), band=4)


@query(f"""WITH RECURSIVE {SERIES_SQL}, c AS (SELECT user_id, list(v / 500.0 ORDER BY i) AS b, count(*) AS m FROM o GROUP BY 1),
    q AS (SELECT b AS a, m AS n FROM c WHERE user_id = (SELECT min(user_id) FROM c)),
    s AS (SELECT user_id, a, b, n, m, greatest(4, abs(n - m)) AS w FROM c CROSS JOIN q),
    f AS (SELECT user_id, CAST(0 AS BIGINT) AS i, list_prepend(0.0::DOUBLE, list_transform(range(m), lambda x: 1e308::DOUBLE)) AS row FROM s
          UNION ALL SELECT f.user_id, f.i + 1, list_reduce(range(1, s.m + 1), lambda acc, j: list_append(acc, CASE WHEN abs(f.i + 1 - j) > s.w THEN 1e308::DOUBLE ELSE least(1e308::DOUBLE, abs(s.a[f.i + 1] - s.b[j]) + least(acc[j], f.row[j], f.row[j + 1])) END), [1e308::DOUBLE])
          FROM f JOIN s ON s.user_id = f.user_id WHERE f.i < s.n),
    r AS (SELECT f.user_id, 1 / (1 + f.row[s.m + 1] / greatest(s.n, s.m)) AS score FROM f JOIN s ON s.user_id = f.user_id WHERE f.i = s.n),
    k AS (SELECT s.user_id, coalesce(sum(greatest(a[i] - (SELECT max(x) FROM unnest(b[greatest(i - 4, 1):i + 4]) AS t(x)), (SELECT min(x) FROM unnest(b[greatest(i - 4, 1):i + 4]) AS t(x)) - a[i], 0)), 0) AS bound FROM s, unnest(range(1, least(n, m) + 1)) AS u(i) GROUP BY 1)
    SELECT r.user_id, round(score, 9) AS score, round(bound, 9) AS bound FROM r JOIN k ON k.user_id = r.user_id""")
def dtw_similarity(spark, d):
    s = X.series(spark, d)
    asked = [{"t": o["t"], "v": o["v"]} for o in s.orderBy("user_id").first()["obs"]]
    return s.select("user_id", r6(sequences.dtw(asked, F.col("obs"), GAME), "score"), r6(sequences.lower_bound([o["v"] for o in asked], trends.field("obs", "v"), 4, 500.0), "bound"))


# Corpus


@query("SELECT 'doc/' || doc_id AS path, CASE WHEN doc_id % 10 = 0 THEN 'DELETED' ELSE 'MODIFIED' END AS change FROM documents WHERE doc_id % 10 = 0 OR doc_id % 7 = 0")
def snapshot_diff(spark, d):
    v = X.versions(spark, d)
    return corpus.changes(v.where("version = 1"), corpus.current(v))


@query("SELECT 'doc/' || doc_id AS path, CASE WHEN doc_id % 7 = 0 THEN 2 ELSE 1 END AS version, CASE WHEN doc_id % 7 = 0 THEN sha256(text || '!') ELSE sha256(text) END AS sha FROM documents WHERE doc_id % 10 <> 0")
def latest_version(spark, d):
    return corpus.current(X.versions(spark, d)).select("path", "version", F.sha2("content", 256).alias("sha"))


@query("""SELECT 'doc/' || doc_id AS path, 1 AS version FROM documents WHERE doc_id % 10 <> 0 UNION ALL SELECT 'doc/' || doc_id, 2 FROM documents WHERE doc_id % 10 <> 0 AND doc_id % 7 = 0""")
def compaction(spark, d):
    return corpus.compacted(X.versions(spark, d), "TOMBSTONES_ONLY").select("path", "version")


@query("""SELECT doc_id AS id, i - 1 AS chunk_index, md5(substr(text, 800 * (i - 1) + 1, 1000)) AS md5 FROM (SELECT doc_id, text, unnest(range(1, greatest(CAST(ceil((length(text) - 200) / 800.0) AS BIGINT), 1) + 1)) AS i FROM documents)
    WHERE trim(substr(text, 800 * (i - 1) + 1, 1000), ' ') <> ''""")
def chunks_fixed(spark, d):
    return corpus.fixed_chunks(docs(spark, d), "text").select("id", F.col("chunk_index").cast("long").alias("chunk_index"), F.md5("content").alias("md5"))


@query()
def chunks_recursive(spark, d):
    c = corpus.chunks(docs(spark, d).select("id", "text"))
    return c.select("id", "chunk_index", F.char_length("content").alias("size"), corpus.point_id("id", "chunk_index").alias("point_id"))


@query("SELECT doc_id AS id, lang AS language, md5(text) AS body FROM documents")
def front_matter(spark, d):
    page = F.concat(F.lit("---\nlang: '"), "lang", F.lit("'\nsource: "), "source", F.lit("\n---\n"), "text")
    m = docs(spark, d).select("id", text.front_matter(page).alias("m"))
    return m.select("id", F.col("m.metadata")["lang"].alias("language"), F.md5("m.body").alias("body"))


# Evaluation


@query(f"WITH {LEGS_SQL} SELECT round(avg(CASE WHEN coalesce(quality, 0) >= 1 THEN 1.0 ELSE 0 END), 9) AS precision FROM (SELECT * FROM bm25 ORDER BY score DESC, id LIMIT 20) t LEFT JOIN labels ON doc_id = t.id")
def precision_at_k(spark, d):
    found = lexical_leg(spark, d, 20)
    judged = evaluation.judged(found, X.table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("judgement")), ["id"])
    return evaluation.precision(judged, []).select(r6("precision"))


@query("SELECT round(quantile_cont(value, 0.5), 9) AS p50, round(quantile_cont(value, 0.95), 9) AS p95, round(quantile_cont(value, 0.99), 9) AS p99, round(avg(value), 9) AS mean FROM events")
def latency_percentiles(spark, d):
    return evaluation.latency(X.table(spark, d, "events"), "value").select(*[r6(c) for c in ("p50", "p95", "p99", "mean")])


@query("""WITH e AS (SELECT user_id, CAST(floor(epoch(CAST(ts AS TIMESTAMP) - TIMESTAMP '2024-01-01') / 259200) AS INT) AS w, value, event_type = 'view' AS seen FROM events),
    g AS (SELECT user_id, w, avg(value) AS own, coalesce(avg(value) FILTER (WHERE seen), 0) AS other, max(CASE WHEN seen THEN 1 ELSE 0 END) AS seen FROM e WHERE w < 10 GROUP BY 1, 2)
    SELECT u.user_id, k.window, round(coalesce(own, 0), 9) AS own, round(coalesce(other, 0), 9) AS other, coalesce(seen, 0) AS seen FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (SELECT CAST(unnest(range(10)) AS INT) AS window) k LEFT JOIN g ON g.user_id = u.user_id AND g.w = k.window""")
def window_features(spark, d):
    e = X.events(spark, d)
    second = (F.unix_micros("ts") - F.unix_micros(F.lit("2024-01-01").cast("timestamp"))) / 1e6
    rows = e.select("user_id", second.alias("second"), F.col("value").alias("own"), F.col("value").alias("other"), (F.col("event_type") == "view").alias("vis"))
    return evaluation.window_features(rows, "user_id", "second", ["own"], ["other"], "vis", width=259200).withColumns({"own": r6("own"), "other": r6("other")})


@query("""WITH c AS (SELECT user_id, event_id, sum(CASE WHEN event_type IN ('signup', 'click') THEN 1 ELSE -1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s, ts FROM events)
    SELECT event_id, CAST(s - least(0, min(s) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS BIGINT) AS count FROM c""")
def unit_counts(spark, d):
    e = X.events(spark, d).select("user_id", "ts", "event_id", F.lit("u").alias("unit"), F.when(F.col("event_type").isin("signup", "click"), 1).otherwise(-1).alias("change"))
    return evaluation.unit_counts(e, "user_id", ["ts", "event_id"], "unit", "change").select("event_id", F.col("count").cast("long").alias("count"))


@query("""WITH r AS (SELECT *, (row_number() OVER (PARTITION BY quality ORDER BY md5('42:' || doc_id), doc_id) - 1) / CAST(count(*) OVER (PARTITION BY quality) AS DOUBLE) AS share FROM labels)
    SELECT doc_id, quality, CASE WHEN share < 0.7 THEN 'train' WHEN share < 0.7 + 0.1 THEN 'validate' ELSE 'test' END AS part FROM r""")
def stratified_split(spark, d):
    return evaluation.stratified_split(X.table(spark, d, "labels"), "quality", "doc_id").select("doc_id", "quality", "part")


@query("""WITH f AS (SELECT user_id, min(epoch(CAST(ts AS TIMESTAMP))) FILTER (WHERE event_type = 'purchase') AS p, min(epoch(CAST(ts AS TIMESTAMP))) FILTER (WHERE event_type = 'signup') AS s, count(*) FILTER (WHERE event_type = 'error') AS e FROM events GROUP BY 1)
    SELECT user_id, CASE WHEN p < s THEN 'direct' WHEN e > 12 THEN 'troubled' ELSE 'other' END AS label FROM f""")
def rule_labels(spark, d):
    rows = X.events(spark, d).select("user_id", (F.unix_micros("ts") / 1e6).alias("second"), F.col("event_type").alias("name"))
    facts = [evaluation.first_time("purchase").alias("p"), evaluation.first_time("signup").alias("s"), evaluation.count_before("error", 1e12).alias("e")]
    return evaluation.rule_labels(rows, "user_id", [("direct", F.col("p") < F.col("s")), ("troubled", F.col("e") > 12), ("other", F.lit(True))], facts).select("user_id", "label")


# More of the surface: nested and semantic similarity, caches, log scans, lifecycle, integrity


@query("""SELECT l_orderkey AS case_id, l_linenumber AS line, round((greatest(0, 1 - abs(l_quantity - 20) / 50) + CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) / 2, 9) AS score FROM lineitem""")
def case_nested(spark, d):
    li = X.table(spark, d, "lineitem")
    o = F.struct(F.col("l_quantity").alias("quantity"), F.col("l_returnflag").alias("flag"))
    fields = (S.Numeric("quantity", 0, 50), S.Categorical("flag"))
    return li.select(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("line"), r6(similarity.inner({"quantity": 20.0, "flag": "R"}, o, fields), "score"))


@query(f"WITH {LEGS_SQL}, e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS a FROM embeddings) SELECT id, round(greatest(0, {COS}), 9) AS score FROM e CROSS JOIN q")
def text_semantic(spark, d):
    q = vector(first_vector(spark, d))
    return X.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), r6(similarity.text_semantic(q, F.col("embedding")), "score"))


@query("""SELECT user_id, round(len(list_intersect(list_distinct(list(event_type)), ['click', 'purchase'])) / CAST(len(list_distinct(list_concat(list(event_type), ['click', 'purchase']))) AS DOUBLE), 9) AS jaccard FROM events GROUP BY 1""")
def set_jaccard(spark, d):
    sets = X.table(spark, d, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("s"))
    return sets.select("user_id", r6(similarity.jaccard(F.col("s"), F.lit(["click", "purchase"])), "jaccard"))


@query(f"WITH {X.LOG_SQL} SELECT retrieval_id, fb.doc, outcome, query_text FROM fb JOIN rec USING (retrieval_id) WHERE fb.ts >= TIMESTAMP '2024-01-20' AND fb.ts < TIMESTAMP '2024-01-25'")
def log_feedback(spark, d):
    records, _, judged = log(spark, d)
    return logs.feedback_in(judged, records, "2024-01-20", "2024-01-25").select("retrieval_id", "doc", "outcome", "query_text")


@query(f"WITH {X.LOG_SQL} SELECT DISTINCT rd.doc FROM rd JOIN rec USING (retrieval_id) WHERE rec.ts >= TIMESTAMP '2024-01-20' AND rec.ts < TIMESTAMP '2024-01-21'")
def log_documents(spark, d):
    records, found, _ = log(spark, d)
    return logs.retrieved_documents(found, records, "2024-01-20", "2024-01-21")


@query(f"WITH {X.LOG_SQL} SELECT (SELECT count(*) FROM rec WHERE ts >= TIMESTAMP '2024-01-15') AS records, (SELECT count(*) FROM rd WHERE retrieval_id IN (SELECT retrieval_id FROM rec WHERE ts >= TIMESTAMP '2024-01-15')) AS retrieved, (SELECT count(*) FROM fb WHERE retrieval_id IN (SELECT retrieval_id FROM rec WHERE ts >= TIMESTAMP '2024-01-15')) AS feedback")
def log_retention(spark, d):
    kept = logs.older_removed(*log(spark, d), "2024-01-15")
    counts = [k.agg(F.count(F.lit(1)).alias(n)) for k, n in zip(kept, ("records", "retrieved", "feedback"), strict=True)]
    return counts[0].crossJoin(counts[1]).crossJoin(counts[2])  # three rows of one number


@query("SELECT event_type AS domain, count(*) AS n FROM events WHERE lower(props) LIKE '%\"k\": 7}%' GROUP BY 1")
def memory_text(spark, d):
    return X.memory(spark, d).where(P.text_contains("text", '"K": 7}')).groupBy("domain").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT doc_id AS id, sha256(text) AS hash FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0)""")
def cache_misses(spark, d):
    keyed = docs(spark, d).select("id", text.content_hash("text").alias("hash"))
    return keyed.join(keyed.where("id % 2 = 0").select("hash"), "hash", "left_anti").select("id", "hash")


@query(f"WITH {X.CASES_SQL} SELECT case_id FROM cases WHERE tenant_id = 'ASIA' AND scope IN ('NATION_2/BUILDING', 'NATION_2', '') AND case_id % 7 <> 0 AND stored_at >= TIMESTAMP '1995-01-01'")
def case_identity(spark, d):
    rows = X.cases(spark, d).withColumn("superseded", F.col("case_id") % 7 == 0)
    return rows.where(P.identity("ASIA", "sales", "order", "NATION_2/BUILDING", "1995-01-01")).select("case_id")


@query("SELECT CASE WHEN doc_id % 7 = 0 OR doc_id % 10 = 0 THEN 'a2' ELSE 'a1' END AS archive, count(*) AS paths FROM documents GROUP BY 1")
def archive_contents(spark, d):
    return corpus.latest(X.versions(spark, d)).groupBy("archive").agg(F.count(F.lit(1)).alias("paths"))


@query("SELECT 'a1' AS archive, 'ENTRY_COUNT_MISMATCH' AS problem, 'ERROR' AS severity UNION ALL SELECT 'a9', 'ARCHIVE_MISSING', 'ERROR'")
def archive_integrity(spark, d):
    v = X.versions(spark, d)
    facts = corpus.archive_facts(v)
    listed = spark.createDataFrame([("a9", 1, "00")], "archive string, entries long, hash string")
    manifest = facts.withColumn("entries", F.when(F.col("archive") == "a1", F.col("entries") + 1).otherwise(F.col("entries"))).select("archive", "entries", "hash").unionByName(listed)
    return corpus.integrity(manifest, facts, full=True)


@query("SELECT CASE WHEN doc_id % 7 = 0 THEN 'a' ELSE 'b' END AS mode, round(avg(CASE WHEN quality >= 1 THEN 1.0 ELSE 0.0 END), 9) AS precision, count(*) AS scenarios FROM labels GROUP BY 1")
def failure_modes(spark, d):
    rows = X.table(spark, d, "labels").select(F.array(F.when(F.col("doc_id") % 7 == 0, "a").otherwise("b")).alias("modes"), (F.col("quality") >= 1).cast("double").alias("precision"))
    return evaluation.by_failure_mode(rows).select("mode", r6("precision"), "scenarios")


@query("""WITH r AS (SELECT user_id, list(event_type ORDER BY n DESC, event_type) AS ranked FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1)
    SELECT round(avg(CASE WHEN ranked[1] = 'view' THEN 1.0 ELSE 0 END), 9) AS top_1, round(avg(CASE WHEN list_contains(ranked[1:3], 'view') THEN 1.0 ELSE 0 END), 9) AS top_k, count(*) AS n FROM r""")
def ranked_accuracy(spark, d):
    counted = X.table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    ranked = counted.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct(F.negative("n").alias("n"), "event_type"))).alias("r"))
    rows = ranked.select(F.transform("r", lambda x: x["event_type"]).alias("ranked"), F.lit("view").alias("label"))
    return evaluation.accuracy(rows).select(r6("top_1"), r6("top_k"), "n")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid retrieval: a lexical and a dense leg, ranks fused, ten best documents."""
    return rrf_fusion(spark, sf_dir)


from sievework.plans import surface  # noqa: E402, F401  registers the rest of the surface
