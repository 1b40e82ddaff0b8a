"""The registered queries of this package: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm import backoff, bytebpe, chosenpath, exact, idfiles, packing, quality, ranking, substring, toxicity
from sievework.llm.common import documents


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


#: The tokenizers of the registered queries; packing and id files take any whose pre-tokens end at white space.
WORD_BPE, WORD_VOCABULARY = "word_bpe_49k.json", 49_408
BYTE_BPE = "byte_bpe_50k.tiktoken"


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), public_tokenizers.path(WORD_BPE), capacity=2048, end=0)


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosenpath.jaccard_groups(documents(spark, sf_dir))


def op3_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = ranking.remainder(3) == 1
    scored = ranking.rank_quality(documents(spark, sf_dir), labels(spark, sf_dir), allowed=~held)
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted")


def op4_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = idfiles.new_folder(spark)
    idfiles.write_ids(documents(spark, sf_dir), folder, public_tokenizers.path(WORD_BPE), WORD_VOCABULARY, end=2)
    return idfiles.read_ids(spark, folder, derive=idfiles.sizes_and_crc, schema="n_tokens long, ids_crc32 long")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(documents(spark, sf_dir), labels(spark, sf_dir))


def op6_backoff_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = backoff.backoff_scores(documents(spark, sf_dir))
    return scored.select("doc_id", "n_tokens", F.round("log_score", 4).alias("log_score"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.dedup_substrings(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(documents(spark, sf_dir))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = ranking.remainder(4) == 2
    scored = toxicity.score_toxicity(documents(spark, sf_dir), labels(spark, sf_dir), allowed=~held)
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bytebpe.encode(documents(spark, sf_dir), public_tokenizers.path(BYTE_BPE), public_tokenizers.PATTERN, decoded=True)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_best_fit_packing, op2_jaccard_join, op3_quality_ranking, op4_packed_ids, op5_quality_rules, op6_backoff_scores, op7_substring_dedup, op8_exact_dedup, op9_toxicity, op10_byte_bpe]
    return {f.__name__: f for f in found}


#: Words of a text, in DuckDB SQL.
WORDS_SQL = "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"


def oracle_sql() -> dict[str, str]:
    return {
        "op2_jaccard_join": f"""
            WITH RECURSIVE split AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
            sets AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) ELSE [array_to_string(w, ' ')] END)) AS s FROM split WHERE len(w) > 0),
            kinds AS (SELECT s, min(doc_id) AS rep, count(*) AS copies FROM sets GROUP BY s),
            members AS (SELECT doc_id, rep FROM sets JOIN kinds ON kinds.s = sets.s),
            items AS (SELECT rep, len(s) AS n, unnest(s) AS x FROM kinds),
            meet AS (SELECT a.rep AS a, b.rep AS b, a.n + b.n - count(*) AS joint, count(*) AS c FROM items a JOIN items b ON a.x = b.x AND a.rep < b.rep GROUP BY a.rep, b.rep, a.n, b.n),
            pairs AS (SELECT a, b FROM meet WHERE 10 * c >= 8 * joint UNION SELECT b, a FROM meet WHERE 10 * c >= 8 * joint),
            walk AS (SELECT rep AS a, rep AS b FROM kinds UNION SELECT walk.a, pairs.b FROM walk JOIN pairs ON pairs.a = walk.b),
            class AS (SELECT a AS rep, min(b) AS class_id FROM walk GROUP BY 1),
            linked AS (SELECT a AS rep, sum(copies) AS links FROM pairs JOIN kinds ON kinds.rep = pairs.b GROUP BY 1)
            SELECT d.doc_id, coalesce(class_id, d.doc_id) AS class_id, coalesce(m.rep, d.doc_id) AS rep_id, CAST(coalesce(links, 0) + coalesce(copies - 1, 0) AS BIGINT) AS n_links
            FROM documents d LEFT JOIN members m ON m.doc_id = d.doc_id LEFT JOIN kinds k ON k.rep = m.rep LEFT JOIN class c ON c.rep = m.rep LEFT JOIN linked l ON l.rep = m.rep
        """,
        "op7_substring_dedup": f"""
            WITH split AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
            windows AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM split)),
            first AS (SELECT x, min(doc_id) AS least FROM windows GROUP BY 1),
            flagged AS (SELECT doc_id, i FROM windows JOIN first ON first.x = windows.x WHERE least < doc_id),
            gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM flagged),
            words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS x FROM split),
            kept AS (SELECT words.doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY words.i) AS t FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.i = words.i WHERE gone.i IS NULL GROUP BY 1)
            SELECT split.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
            FROM split LEFT JOIN kept ON kept.doc_id = split.doc_id
        """,
        "op6_backoff_scores": """
            WITH split AS (
                SELECT row_number() OVER () AS r, doc_id,
                       list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
                FROM documents),
            words AS (SELECT r, doc_id, unnest(range(len(w))) AS i, unnest(w) AS w3 FROM split),
            seq AS (SELECT *, lag(w3, 1) OVER (PARTITION BY r ORDER BY i) AS w2, lag(w3, 2) OVER (PARTITION BY r ORDER BY i) AS w1 FROM words),
            c1 AS (SELECT w3 AS a, count(*) AS c FROM words GROUP BY 1),
            c2 AS (SELECT w2 AS a, w3 AS b, count(*) AS c FROM seq WHERE i >= 1 GROUP BY 1, 2),
            c3 AS (SELECT w1 AS a, w2 AS b, w3 AS d, count(*) AS c FROM seq WHERE i >= 2 GROUP BY 1, 2, 3),
            n AS (SELECT count(*)::DOUBLE AS n FROM words),
            joined AS (
                SELECT r, doc_id, i, n.n, u.c AS cu, v.c AS cv, vw.c AS cvw, uv.c AS cuv, uvw.c AS cuvw
                FROM seq CROSS JOIN n JOIN c1 u ON u.a = w3
                LEFT JOIN c1 v ON v.a = w2
                LEFT JOIN c2 vw ON vw.a = w2 AND vw.b = w3
                LEFT JOIN c2 uv ON uv.a = w1 AND uv.b = w2
                LEFT JOIN c3 uvw ON uvw.a = w1 AND uvw.b = w2 AND uvw.d = w3),
            scored AS (
                SELECT r, doc_id, CASE
                    WHEN cuvw >= 2 THEN ln(cuvw) - ln(cuv)
                    WHEN cvw >= 2 THEN ln(cvw) - ln(cv) + CASE WHEN i >= 2 THEN ln(0.4) ELSE 0 END
                    ELSE ln(cu) - ln(n) + ln(0.4) * least(i, 2) END AS s
                FROM joined),
            summed AS (SELECT r, count(*) AS n_tokens, sum(s) AS s FROM scored GROUP BY r)
            SELECT split.doc_id, coalesce(n_tokens, 0) AS n_tokens, round(coalesce(s, 0), 4) AS log_score
            FROM split LEFT JOIN summed ON summed.r = split.r
        """,
        "op8_exact_dedup": """
            SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
                   doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
            FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
        """,
    }
