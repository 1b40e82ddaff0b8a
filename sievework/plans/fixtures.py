"""The engine's logical tables, derived from the driver's tables; the same derivations as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.operators.lexical import Index, build_index


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_indexes: dict[tuple[str, str], Index] = {}


def index(spark: SparkSession, sf_dir: str) -> Index:
    """Stored postings of ``documents``, written on first use in a session and read by all queries after."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _indexes:
        _indexes[key] = build_index(table(spark, sf_dir, "documents"), id_col="doc_id")
    return _indexes[key]


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(table(spark, sf_dir, "events"))


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of files."""
    schema = table(spark, sf_dir, "events").schema
    return _events(spark.readStream.schema(schema).parquet(f"{sf_dir}/events*.parquet"))


def _events(e: DataFrame) -> DataFrame:
    return e.withColumns({"ts": F.col("ts").cast("timestamp"), "k": F.get_json_object("props", "$.k").cast("int"), "s": F.least(F.col("value") / 500.0, F.lit(1.0))})


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    rid = F.concat(F.lit("k"), "k", F.lit("-"), F.to_date("ts"))
    return e.groupBy(rid.alias("retrieval_id"), F.concat(F.lit("k"), "k").alias("query_text")).agg(F.min("ts").alias("ts"))


def retrieved(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).where("event_type <> 'error'")
    rid = F.concat(F.lit("k"), "k", F.lit("-"), F.to_date("ts"))
    return e.groupBy(rid.alias("retrieval_id"), F.concat(F.lit("u"), "user_id").alias("doc")).agg(F.max("s").alias("score"))


#: What the last even event of a user says about a retrieval.
OUTCOME = {"view": "NOT_RELEVANT", "click": "PARTIALLY_RELEVANT", "signup": "RELEVANT", "purchase": "HIGHLY_RELEVANT"}


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).where("event_type <> 'error' and event_id % 2 = 0")
    rid = F.concat(F.lit("k"), "k", F.lit("-"), F.to_date("ts"))
    last = e.groupBy(rid.alias("retrieval_id"), F.concat(F.lit("u"), "user_id").alias("doc")).agg(F.max_by("event_type", "event_id").alias("et"), F.max("ts").alias("ts"))
    names = F.create_map(*[F.lit(x) for pair in OUTCOME.items() for x in pair])
    return last.select("retrieval_id", "doc", names[F.col("et")].alias("outcome"), "ts")


def corpus_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.concat(F.lit("u"), "c_custkey").alias("doc"))


LOG_SQL = """
    ev AS (SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, user_id, event_type, least(value / 500.0, 1.0) AS s,
                  CAST(json_extract(props, '$.k') AS INTEGER) AS k, CAST(ts AS DATE) AS d FROM events),
    rec AS (SELECT 'k' || k || '-' || d AS retrieval_id, 'k' || k AS query_text, min(ts) AS ts FROM ev GROUP BY k, d),
    rd AS (SELECT 'k' || k || '-' || d AS retrieval_id, 'u' || user_id AS doc, max(s) AS score FROM ev
           WHERE event_type <> 'error' GROUP BY k, d, user_id),
    fb0 AS (SELECT 'k' || k || '-' || d AS retrieval_id, 'u' || user_id AS doc, max_by(event_type, event_id) AS et, max(ts) AS ts FROM ev
           WHERE event_type <> 'error' AND event_id % 2 = 0 GROUP BY k, d, user_id),
    fb AS (SELECT retrieval_id, doc, ts, CASE et WHEN 'view' THEN 'NOT_RELEVANT' WHEN 'click' THEN 'PARTIALLY_RELEVANT'
           WHEN 'signup' THEN 'RELEVANT' ELSE 'HIGHLY_RELEVANT' END AS outcome FROM fb0)
"""


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    joined = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(t("nation")), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey"))  # 25 and 5 rows
    return joined.select(
        F.col("r_name").alias("tenant_id"), F.col("o_orderkey").alias("case_id"), F.lit("order").alias("case_type"), F.lit("sales").alias("domain"),
        F.concat_ws("/", "n_name", "c_mktsegment").alias("scope"), F.col("o_orderpriority").alias("priority"), F.col("c_mktsegment").alias("segment"),
        F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").cast("timestamp").alias("stored_at"),
        ((F.col("o_orderkey") % 101) / 100).alias("confidence"), F.when(F.col("o_custkey") % 5 != 0, (F.col("o_custkey") % 97) / 96).alias("trust"),
        F.concat(F.lit("c"), F.col("o_custkey") % 50).alias("producer"), F.lit(False).alias("superseded"),
    )


CASES_SQL = """
    cases AS (SELECT r_name AS tenant_id, o_orderkey AS case_id, n_name || '/' || c_mktsegment AS scope, o_orderpriority AS priority,
                     c_mktsegment AS segment, o_totalprice AS price, o_orderstatus AS status, CAST(o_orderdate AS TIMESTAMP) AS stored_at,
                     (o_orderkey % 101) / 100.0 AS confidence, CASE WHEN o_custkey % 5 <> 0 THEN (o_custkey % 97) / 96.0 END AS trust,
                     'c' || (o_custkey % 50) AS producer
              FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
"""


def order_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per order: flags, quantities and lines as lists."""
    li = table(spark, sf_dir, "lineitem")
    line = F.struct(F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("quantity"), F.col("l_returnflag").alias("flag"))
    return li.groupBy(F.col("l_orderkey").alias("case_id")).agg(F.collect_set("l_returnflag").alias("flags"), F.collect_list("l_quantity").alias("quantities"), F.sort_array(F.collect_list(line)).alias("lines"))


def memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory_of(events(spark, sf_dir))


def memory_of(e: DataFrame) -> DataFrame:
    return e.select(
        F.col("event_id").alias("memory_id"), F.lit("t").alias("tenant_id"), F.col("user_id").cast("string").alias("entity_id"), F.col("event_type").alias("domain"), F.lit(None).cast("string").alias("case_id"),
        F.col("props").alias("text"), F.create_map(F.lit("k"), F.col("k").cast("string"), F.lit("pleasure"), (F.col("event_id") % 10 / 10).cast("string"), F.lit("arousal"), F.lit("0.5"), F.lit("dominance"), F.lit("0.0")).alias("attributes"),
        F.col("ts").alias("created_at"), F.when(F.col("event_id") % 7 != 0, F.col("s")).alias("importance"),
    )


MEMORY_SQL = """
    memory AS (SELECT event_id AS memory_id, CAST(user_id AS VARCHAR) AS entity_id, event_type AS domain, props AS text,
                      CAST(json_extract(props, '$.k') AS INTEGER) AS k, CAST(ts AS TIMESTAMP) AS created_at,
                      CASE WHEN event_id % 7 <> 0 THEN least(value / 500.0, 1.0) END AS importance FROM events)
"""


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user: observations (t in seconds, v) and labels in order of (ts, event_id)."""
    e = events(spark, sf_dir)
    listed = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value", "event_type"))).alias("o"))
    o = F.col("o")
    return listed.select("user_id", F.transform(o, lambda x: F.struct((F.unix_micros(x["ts"]) / 1e6).alias("t"), x["value"].alias("v"))).alias("obs"), F.transform(o, lambda x: x["event_type"]).alias("labels"))


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A corpus of two versions: the second lacks ids that 10 divides and changes those that 7 divides."""
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc/"), "doc_id").alias("path"), "doc_id", "text")
    first = d.select("path", F.lit(1).alias("version"), F.lit("2024-01-01").cast("timestamp").alias("ts"), F.col("text").cast("binary").alias("content"), F.lit(False).alias("tombstone"), F.lit("a1").alias("archive"))
    dead = F.col("doc_id") % 10 == 0
    second = d.where(dead | (F.col("doc_id") % 7 == 0)).select("path", F.lit(2).alias("version"), F.lit("2024-02-01").cast("timestamp").alias("ts"), F.when(~dead, F.concat("text", F.lit("!")).cast("binary")).alias("content"), dead.alias("tombstone"), F.lit("a2").alias("archive"))
    return first.unionByName(second)
