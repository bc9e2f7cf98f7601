"""The registered queries of this folder, and the SQL that checks them where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    embedding_dedup,
    exact_dedup,
    exact_search,
    html_extract,
    license_scan,
    mixing,
    near_dedup,
    packing,
    quality,
    token_alignment,
    token_counts,
    token_output,
    vector_codes,
)
from .common import read

Query = Callable[[SparkSession, str], DataFrame]


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    return packing.pack(read(spark, sf_dir, "documents"), seq_len=2048).select(*columns)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read(spark, sf_dir, "documents"), limit=1024)


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.matrix_rows(read(spark, sf_dir, "documents"), seq_len=2048)


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"), most=3).drop("_digest")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.equal_texts(read(spark, sf_dir, "documents")).drop("_digest")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return license_scan.scan(docs, license_scan.fit(docs))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.similar_texts(read(spark, sf_dir, "documents"), hundredths=75).drop("_digest", "_stays")


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.similar_vectors(read(spark, sf_dir, "embeddings"), least=0.9).drop("audited_recall")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(read(spark, sf_dir, "pages"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality.grade_documents(docs, quality.fit(docs, read(spark, sf_dir, "labels")))


def op11_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_search.top_products(read(spark, sf_dir, "embeddings"), k=5, scale=256)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(read(spark, sf_dir, "embeddings"), parts=8, entries=16, rounds=6, scale=4096)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align(read(spark, sf_dir, "documents"))


def _vector_codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """The training written out, one pair of tables a round."""
    steps = [
        f"""
        WITH kept AS (
            SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), places AS (
            SELECT vec_id, label, p, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] AS w
            FROM kept CROSS JOIN range({parts}) AS r(p)
        ), book_0 AS (
            SELECT p, dense_rank() OVER (ORDER BY vec_id) - 1 AS e, w
            FROM places WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {entries})
        )"""
    ]
    for r in range(rounds + 1):
        steps.append(f"""
        assigned_{r} AS (
            SELECT vec_id, label, a.p, a.w, arg_min(e, (d, e)) AS e, min(d) AS d
            FROM (SELECT x.*, e, list_sum(list_transform(list_zip(x.w, b.w), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
                  FROM places x JOIN book_{r} b ON b.p = x.p) a
            GROUP BY ALL
        )""")
        if r < rounds:
            steps.append(f"""
        sums_{r} AS (
            SELECT p, e, i, sum(w[i + 1]) AS s, count(*) AS n FROM assigned_{r}, range(len(w)) AS t(i) GROUP BY p, e, i
        ), book_{r + 1} AS (
            SELECT b.p, b.e, coalesce(any_value(m.w), any_value(b.w)) AS w
            FROM book_{r} b LEFT JOIN (
                SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS w FROM sums_{r} GROUP BY p, e
            ) m ON m.p = b.p AND m.e = b.e GROUP BY b.p, b.e
        )""")
    return ",".join(steps) + f"""
        , coded AS (
            SELECT vec_id, label, string_agg(lower(printf('%02x', e)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error
            FROM assigned_{rounds} GROUP BY vec_id, label
        )
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
               (SELECT sha256(string_agg(array_to_string(w, ','), ',' ORDER BY p, e)) FROM book_{rounds}) AS codebooks_sha256
        FROM coded
    """


QUERIES: dict[str, Query] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_token_counts": op2_token_counts,
    "op3_token_output": op3_token_output,
    "op4_source_mixing": op4_source_mixing,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_license_scan": op6_license_scan,
    "op7_minhash_near_dedup": op7_minhash_near_dedup,
    "op8_embedding_near_dedup": op8_embedding_near_dedup,
    "op9_html_extraction": op9_html_extraction,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_exact_topk": op11_exact_topk,
    "op12_vector_codes": op12_vector_codes,
    "op13_token_alignment": op13_token_alignment,
}

ORACLE: dict[str, str] = {
    "op5_exact_dedup": r"""
        WITH marked AS (
            SELECT doc_id, coalesce(text, '') AS raw,
                   regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
            FROM documents
        )
        SELECT doc_id,
               first_value(doc_id) OVER best AS keep_id,
               count(*) OVER (PARTITION BY norm) AS group_size,
               row_number() OVER best = 1 AS kept,
               sha256(norm) AS text_sha256
        FROM marked
        WINDOW best AS (PARTITION BY norm ORDER BY length(raw) DESC, doc_id)
    """,
    "op7_minhash_near_dedup": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x20\x09-\x0D]+') AS w
            FROM documents
        ), sets AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN []
                WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE list_distinct([array_to_string(w[i : i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s
            FROM words
        ), grams AS (
            SELECT doc_id, unnest(s) AS g FROM sets
        ), pairs AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared
            FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
        ), links AS (
            SELECT a, b FROM pairs JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b
            WHERE 100 * shared >= 75 * (len(x.s) + len(y.s) - shared)
        ), edges AS (
            SELECT a, b FROM links UNION SELECT b, a FROM links
        ), reach(doc_id, other) AS (
            SELECT doc_id, doc_id FROM documents UNION SELECT doc_id, b FROM reach JOIN edges ON a = other
        )
        SELECT s.doc_id, any_value(len(s.s)) AS n_shingles, min(other) AS component_id, s.doc_id = min(other) AS kept
        FROM sets s JOIN reach r ON r.doc_id = s.doc_id GROUP BY s.doc_id
    """,
    "op8_embedding_near_dedup": """
        WITH RECURSIVE vectors AS (
            SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), links AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM vectors a JOIN vectors b
              ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
            WHERE list_cosine_similarity(a.v, b.v) >= 0.9
        ), reach(vec_id, other) AS (
            SELECT vec_id, vec_id FROM embeddings UNION SELECT vec_id, b FROM reach JOIN links ON a = other
        ), counted AS (
            SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a
        )
        SELECT r.vec_id, coalesce(any_value(n), 0) AS n_links, min(other) AS component_id, r.vec_id = min(other) AS kept
        FROM reach r LEFT JOIN counted c ON c.vec_id = r.vec_id GROUP BY r.vec_id
    """,
    "op11_exact_topk": """
        WITH kept AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
            FROM kept q JOIN kept c ON c.vec_id IS DISTINCT FROM q.vec_id AND len(c.v) = len(q.v)
            WHERE q.vec_id % 50 = 0
        )
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score
        FROM scored QUALIFY rank <= 5
    """,
    "op12_vector_codes": _vector_codes_sql(),
}
