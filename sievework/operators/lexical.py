"""BM25 over code-aware tokens: from stored postings, or in one pass over a table of texts.

``build_index`` writes postings once, in buckets of terms; a query reads the buckets of its terms only. Without an
index, ``bm25`` counts the query's terms in each text. Tokens are found in the bytes of whole Arrow batches.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from sievework.functions.text import code_tokens
from sievework.operators.fusion import top
from sievework.session import shared_path

K1, B = 1.2, 0.75
BUCKETS = 64  # of terms in stored postings

_KIND = np.zeros(256, np.uint8)  # 1 lower case, 2 upper case, 3 digit, 0 all other bytes
_KIND[97:123], _KIND[65:91], _KIND[48:58] = 1, 2, 3
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def tokens_of(text: str) -> list[str]:
    """The code tokens of one text on the driver, by the same rules as the column expression."""
    import re

    out = []
    for segment in re.split("[^a-zA-Z0-9]+", text or ""):
        parts = [p for p in re.split(r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|(?<=[a-zA-Z])(?=[0-9])|(?<=[0-9])(?=[a-zA-Z])", segment) if p]
        out += [p.lower() for p in parts] + ([segment.lower()] if len(parts) > 1 else [])
    return out


def _spans(flat: np.ndarray, cuts: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_string(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(flat)])


def token_table(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The code tokens of a batch of texts (null: none), and the row of each; parts first, then whole segments."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_string())
    n = len(texts)
    empty = np.zeros(0, np.int64)
    if not n:
        return pa.array([], pa.large_string()), empty
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    kind = _KIND[raw]
    size = len(raw)
    before, after = np.zeros(size, np.uint8), np.zeros(size, np.uint8)
    before[1:], after[:-1] = kind[:-1], kind[1:]
    edge = offsets[:-1][offsets[:-1] < size]  # a text begins there
    before[edge] = 0
    after[edge[edge > 0] - 1] = 0
    inner = kind > 0
    starts = inner & (before == 0)
    letter, letter_before = (kind == 1) | (kind == 2), (before == 1) | (before == 2)
    border = (before == 1) & (kind == 2) | (before == 2) & (kind == 2) & (after == 1) | letter_before & (kind == 3) | (before == 3) & letter
    flat = np.ascontiguousarray(_LOWER[raw[inner]])
    place = np.cumsum(inner) - 1  # of each inner byte in ``flat``
    part = np.flatnonzero(starts | border)
    cuts = np.append(place[part], len(flat)) if len(part) else np.zeros(1, np.int64)
    row = np.searchsorted(offsets, part, side="right") - 1
    tokens = [_spans(flat, cuts)]
    rows = [row]
    segment = np.cumsum(starts[part]) - 1  # of each part
    if len(part):
        several = np.flatnonzero(np.bincount(segment) > 1)
        begin = np.flatnonzero(starts[part])
        whole = np.append(cuts[begin], len(flat))
        if len(several):
            tokens.append(_spans(flat, whole).take(pa.array(several)))
            rows.append(row[begin[several]])
    return pa.concat_arrays(tokens), np.concatenate(rows)


def _counted(df: DataFrame, text_col: str, terms: list[str], id_col: str, others: Sequence[Column]) -> DataFrame:
    """id, other columns, _len, _tf array<int>: the number of tokens and of each term, one pass over the texts."""
    source = df.select(F.col(text_col).cast("string").alias("_text"), F.col(id_col).alias("id"), *others)
    names = source.columns[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, row = token_table(batch.column(0))
            n = batch.num_rows
            length = np.bincount(row, minlength=n)
            found = np.zeros((n, len(terms)), np.int32)
            coded = tokens.dictionary_encode()
            codes, held = coded.indices.to_numpy(), {t: i for i, t in enumerate(coded.dictionary.to_pylist())}
            for k, term in enumerate(terms):
                if term in held:
                    found[:, k] = np.bincount(row[codes == held[term]], minlength=n)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * len(terms)), pa.array(found.ravel()))
            yield pa.record_batch([*batch.columns[1:], pa.array(length), lists], [*names, "_len", "_tf"])

    schema = StructType([*source.schema.fields[1:], StructField("_len", LongType()), StructField("_tf", ArrayType(IntegerType()))])
    return source.mapInArrow(run, schema)


def _idf(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def _weight(tf: Column, length: Column, mean: Column, k1: float, b: float) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean))


def bm25(docs: DataFrame, query: str, top_k: int | None = None, predicate: Column | None = None, id_col: str = "id", text_col: str = "text", k1: float = K1, b: float = B, keep: Sequence[str] = ()) -> DataFrame:
    """(id, score, kept columns) of documents with a query term; a repeated query term counts again. Statistics are
    those of all ``docs``; ``predicate`` filters only what is returned. Nothing runs before the result is asked for."""
    wanted = Counter(tokens_of(query))
    if not wanted:
        return docs.select(F.col(id_col).alias("id"), F.lit(0.0).alias("score"), *keep).limit(0)
    terms = sorted(wanted)
    counted = _counted(docs, text_col, terms, id_col, [*map(F.col, keep), *([predicate.alias("_ok")] if predicate is not None else [])])
    df = F.array(*[F.count_if(F.col("_tf")[i] > 0) for i in range(len(terms))])
    stats = counted.agg(F.count(F.lit(1)).cast("double").alias("_n"), F.avg("_len").alias("_mean"), df.alias("_df"))  # one row
    score = F.lit(0.0)
    for i, t in enumerate(terms):
        part = wanted[t] * _idf(F.col("_n"), F.col("_df")[i]) * _weight(F.col("_tf")[i], F.col("_len"), F.col("_mean"), k1, b)
        score = score + F.when(F.col("_tf")[i] > 0, part).otherwise(0.0)
    found = counted.where(F.exists("_tf", lambda x: x > 0))
    if predicate is not None:
        found = found.where("_ok")
    return top(found.crossJoin(F.broadcast(stats)).select("id", score.alias("score"), *keep), top_k)


def bucket_of(term: str, buckets: int) -> int:
    return zlib.crc32(term.encode()) % buckets


@dataclass(frozen=True)
class Index:
    """Stored postings: folders ``postings`` (by bucket: term, id, tf, length), ``documents`` (id, length) and
    ``statistics`` (n, mean_length; one row)."""

    path: str
    buckets: int
    id_type: str

    def postings(self, spark: SparkSession, terms: Sequence[str] | None = None) -> DataFrame:
        rows = spark.read.schema(f"term string, id {self.id_type}, tf long, length long, bucket int").parquet(f"{self.path}/postings")
        if terms is None:
            return rows
        return rows.where(F.col("bucket").isin(sorted({bucket_of(t, self.buckets) for t in terms})) & F.col("term").isin(*terms))

    def statistics(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("n double, mean_length double").parquet(f"{self.path}/statistics")

    def search(self, spark: SparkSession, query: str, top_k: int | None = None, only: DataFrame | None = None, k1: float = K1, b: float = B) -> DataFrame:
        """(id, score) of documents with a query term, from the postings of its terms; ``only``: ids to return."""
        wanted = Counter(tokens_of(query))
        terms = sorted(wanted)
        rows = self.postings(spark, terms or [""])
        df = rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"))  # a row for each term of the query
        scored = rows.join(F.broadcast(df), "term").crossJoin(F.broadcast(self.statistics(spark)))
        part = _idf(F.col("n"), F.col("df")) * _weight(F.col("tf"), F.col("length"), F.col("mean_length"), k1, b)
        # Added in the order of the terms, so that equal texts have equal scores and their ids decide.
        parts = [F.coalesce(F.max(F.when(F.col("term") == t, wanted[t] * part)), F.lit(0.0)) for t in terms]
        found = scored.groupBy("id").agg(sum(parts, F.lit(0.0)).alias("score"))
        if only is not None:
            found = found.join(only.select("id"), "id", "left_semi")
        return top(found, top_k)

    def search_many(self, spark: SparkSession, queries: DataFrame, top_k: int, k1: float = K1, b: float = B) -> DataFrame:
        """(query_id, id, score) for a table of queries (query_id, query): postings joined on bucket and term."""
        return _score_many(self.postings(spark), self.statistics(spark), queries, top_k, k1, b, self.buckets)


def _term_bucket(term: str, buckets: int) -> Column:
    return (F.crc32(F.col(term).cast("binary")) % buckets).cast("int")


def postings(docs: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """term, id, tf, length: how often each document holds each of its terms, and its number of tokens; and a row with
    the term '' for each document."""
    source = docs.select(F.col(text_col).cast("string").alias("_text"), F.col(id_col).alias("id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, row = token_table(batch.column(0))
            n = batch.num_rows
            length = np.bincount(row, minlength=n)
            coded = tokens.dictionary_encode()
            width = max(1, len(coded.dictionary))
            pair, tf = np.unique(row * width + coded.indices.to_numpy(), return_counts=True)
            term = pa.concat_arrays([coded.dictionary.take(pa.array(pair % width)), pa.array([""] * n, pa.large_string())]).cast(pa.string())
            at = np.concatenate([pair // width, np.arange(n)])
            yield pa.record_batch([term, batch.column(1).take(pa.array(at)), pa.array(np.concatenate([tf, np.zeros(n, np.int64)])), pa.array(length[at])], ["term", "id", "tf", "length"])

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"term string, id {kind}, tf long, length long")


def build_index(docs: DataFrame, path: str | None = None, id_col: str = "id", text_col: str = "text", buckets: int = BUCKETS) -> Index:
    """Write the postings of all ``docs``, dealt by ranges of (bucket, term, id), so that a term of all documents is
    spread over many files."""
    spark = docs.sparkSession
    path = path or shared_path(spark, "postings")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = postings(docs, id_col, text_col).withColumn("bucket", F.when(F.col("term") == "", -1).otherwise(_term_bucket("term", buckets)))
    dealt = rows.repartitionByRange(n, "bucket", "term", "id").sortWithinPartitions("bucket", "term", "id")
    dealt.write.mode("overwrite").partitionBy("bucket").option("compression", "zstd").parquet(f"{path}/postings")
    index = Index(path, buckets, rows.schema["id"].dataType.simpleString())
    index.postings(spark).where("bucket = -1").agg(F.count(F.lit(1)).cast("double").alias("n"), F.coalesce(F.avg("length"), F.lit(0.0)).alias("mean_length")).write.mode("overwrite").parquet(f"{path}/statistics")
    return index


def _score_many(rows: DataFrame, stats: DataFrame, queries: DataFrame, top_k: int, k1: float, b: float, buckets: int) -> DataFrame:
    asked = queries.select("query_id", F.explode(code_tokens("query")).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qf"))
    asked = asked.withColumn("bucket", _term_bucket("term", buckets))
    wanted = rows.join(asked.select("bucket", "term").distinct(), ["bucket", "term"], "left_semi")
    df = wanted.groupBy("bucket", "term").agg(F.count(F.lit(1)).alias("df"))
    scored = wanted.join(df, ["bucket", "term"]).join(asked, ["bucket", "term"]).crossJoin(F.broadcast(stats))  # one row
    part = F.col("qf") * _idf(F.col("n"), F.col("df")) * _weight(F.col("tf"), F.col("length"), F.col("mean_length"), k1, b)
    # Added in the order of the terms, so that equal texts have equal scores and their ids decide.
    listed = scored.groupBy("query_id", "id").agg(F.array_sort(F.collect_list(F.struct("term", part.alias("part")))).alias("parts"))  # at most a query's terms
    return top(listed.select("query_id", "id", F.aggregate("parts", F.lit(0.0), lambda s, x: s + x["part"]).alias("score")), top_k, ["query_id"])


def bm25_many(docs: DataFrame, queries: DataFrame, top_k: int, id_col: str = "id", text_col: str = "text", k1: float = K1, b: float = B, buckets: int = BUCKETS) -> DataFrame:
    """(query_id, id, score) for a table of queries (query_id, query), without an index."""
    rows = postings(docs, id_col, text_col)
    stats = rows.where("term = ''").agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("length").alias("mean_length"))
    return _score_many(rows.where("term <> ''").withColumn("bucket", _term_bucket("term", buckets)), stats, queries, top_k, k1, b, buckets)


def with_columns(found: DataFrame, docs: DataFrame, columns: Sequence[str], id_col: str = "id") -> DataFrame:
    """Found rows with columns of their documents; ``found`` should be cut to its best rows before."""
    return found.join(docs.select(F.col(id_col).alias("id"), *columns), "id")
