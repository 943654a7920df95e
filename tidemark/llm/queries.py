"""One query per operator, over its whole table, with the columns that the operator's contract names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jaccard, mixing, packing, quality_model, quality_rules, secrets, sharding, substring, topk, urls

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(_table(spark, sf_dir, "documents"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(_table(spark, sf_dir, "pages"))


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scanned(_table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(_table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.classified(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(_table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.deduplicated(_table(spark, sf_dir, "documents"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = packing.packed(_table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.nearest(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {
    q.__name__: q
    for q in (
        op1_ngram_jaccard_join,
        op2_url_filters,
        op3_secret_scans,
        op4_quality_rules,
        op5_quality_classifier,
        op6_sharding,
        op7_mixing,
        op8_substring_dedup,
        op9_best_fit_packing,
        op10_exact_topk,
    )
}

ORACLES: dict[str, str] = {
    "op1_ngram_jaccard_join": r"""
        WITH RECURSIVE w AS (
          SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
        ),
        s AS (
          SELECT doc_id, CASE WHEN len(ws) >= 4 THEN list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i : i + 3], ' ')))
                              WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE CAST([] AS VARCHAR[]) END AS grams FROM w
        ),
        n AS (SELECT doc_id, CAST(len(grams) AS BIGINT) AS n FROM s),
        g AS (SELECT doc_id, unnest(grams) AS gram FROM s),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL),
        l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 85 * (a.n + b.n - k)),
        e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
        r(a, b) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.a, e.y FROM r JOIN e ON r.b = e.x),
        c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
        d AS (SELECT x, count(*) AS n_links FROM e GROUP BY x)
        SELECT doc_id, n AS n_shingles, component_id, coalesce(n_links, 0) AS n_links FROM n JOIN c ON a = doc_id LEFT JOIN d ON x = doc_id
    """,
    "op2_url_filters": r"""
        WITH cut AS (
          SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
        ), parts AS (
          SELECT page_id,
                 translate(regexp_extract(rest, '\A([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(rest, '\A[^/?#]*([^?#]*)', 1) AS path
          FROM cut
        ), ruled AS (
          SELECT *, CASE
            WHEN (host = 'example.net' OR suffix(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
            WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
            WHEN (host = 'org' OR suffix(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
            WHEN (host = 'net' OR suffix(host, '.net')) AND starts_with(path, '/') THEN 'net/'
          END AS rule FROM parts
        )
        SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM ruled
    """,
    "op4_quality_rules": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        w AS (
          SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
                 list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d
        ),
        g AS (SELECT doc_id, i, array_to_string(ws[i : i + 4], ' ') AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
        r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1),
        c AS (
          SELECT doc_id, sum(least(5, i - before)) AS n
          FROM (SELECT doc_id, i, lag(i, 1, -9) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM r) GROUP BY doc_id
        ),
        f AS (
          SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
                 CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, len(regexp_extract_all(t, '!!')) AS n_bangs,
                 len(ls) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
          FROM w LEFT JOIN c USING (doc_id)
        ),
        b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT (base_failed OR 100 * n_symbols > 30 * n_words OR 100 * n_bangs > 30 * n_words
                    OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 100 * n_dup_lines > 50 * n_lines) AS kept
        FROM b
    """,
    "op10_exact_topk": """
        WITH e AS (
          SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
          WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ),
        s AS (
          SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
          FROM e q JOIN e c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
        )
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
    """,
    "op8_substring_dedup": r"""
        WITH w AS (
          SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
        ),
        g AS (
          SELECT doc_id, i, sha256(array_to_string(ws[i : i + 49], ' ')) AS h
          FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)
        ),
        r AS (SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY h) AS d FROM g) WHERE d < doc_id),
        e AS (
          SELECT doc_id, i, sum(CASE WHEN i - before > 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS part
          FROM (SELECT *, lag(i, 1, -100) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM r)
        ),
        c AS (SELECT doc_id, list({'a': a, 'b': b} ORDER BY a) AS cut FROM (SELECT doc_id, min(i) AS a, max(i) + 49 AS b FROM e GROUP BY doc_id, part) GROUP BY doc_id),
        p AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
        k AS (
          SELECT p.doc_id, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n
          FROM p LEFT JOIN c USING (doc_id)
          WHERE c.doc_id IS NULL OR len(list_filter(cut, lambda x: i BETWEEN x.a AND x.b)) = 0 GROUP BY p.doc_id
        )
        SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM w LEFT JOIN k USING (doc_id)
    """,
}
