"""The registered queries of this subpackage: each applies its operator to whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import materialise
from . import alignment, decontaminate, filter_audit, jaccard, language, lattice, packing, quality, secrets, sharding, toplists, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(_table(spark, sf_dir, "documents"))


def op2_lattice_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.score(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_nra_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toplists.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op4_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels").withColumn("low_quality", 1 - F.col("quality"))
    found = toxicity.detect(_table(spark, sf_dir, "documents"), labels)
    return found.select("doc_id", "p_low_quality", "p_toxic", "is_toxic")


def op5_karmarkar_karp_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_pigeonhole_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.place(_table(spark, sf_dir, "documents"), sharding.Topology.even(40))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op8_ftrl_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return done.select("doc_id", "held_out", "score", "predicted")


def op9_warc_two_level_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digests(warc.write(_table(spark, sf_dir, "pages")))


def op10_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), path=F.col("source"))
    return found.select("doc_id", "start", "end", F.crc32(F.encode("candidate", "UTF-8")).alias("candidate_crc32"), "probability", "is_secret")


def op11_hashed_naive_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op12_cube_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).drop("filter")


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = map(public_tokenizers.path, ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    aligned = alignment.alignments(_table(spark, sf_dir, "documents"), a, b)
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    told = alignment.with_counts(materialise(aligned.withColumn("groups_sha256", digest).drop("groups"), "aligned"))
    return told.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


QUERIES = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join, op2_lattice_likelihood, op3_nra_top_k, op4_toxicity_chain, op5_karmarkar_karp_packing,
        op6_pigeonhole_decontamination, op7_hash_tree_shards, op8_ftrl_quality, op9_warc_two_level_index, op10_secret_forest, op11_hashed_naive_bayes, op12_cube_filter_audit,
        op13_tokenizer_alignment,
    )
}

ORACLES = {
    "op1_ngram_jaccard_join": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
        g AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
                ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS gram
            FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
        shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b USING (gram) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
        links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= 0.8 * (x.n + y.n - c) - 1e-9),
        reach AS (SELECT doc_id, doc_id AS other FROM w UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.other),
        class AS (SELECT doc_id, min(other) AS class_id FROM reach GROUP BY doc_id)
        SELECT doc_id, class_id, coalesce(k, 0) AS n_links
        FROM class LEFT JOIN (SELECT a AS doc_id, count(*) AS k FROM links GROUP BY a) USING (doc_id)""",
    "op3_nra_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
            WHERE q.vec_id % 50 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5""",
    "op9_warc_two_level_index": """
        WITH p AS (
            SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
        m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last_page FROM p)
        SELECT page_id, payload_bytes, payload_digest,
            CASE WHEN payload_bytes >= 1000 AND page_id <> last_page THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN payload_bytes >= 1000 AND page_id <> last_page THEN last_page END AS refers_to
        FROM m""",
    "op12_cube_filter_audit": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        l AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY doc_id),
        f AS (
            SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, concat(
                CASE WHEN len(ws) < 100 THEN 'A' ELSE '' END,
                CASE WHEN 100 * len(list_distinct(ws)) < 80 * len(ws) THEN 'B' ELSE '' END,
                CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 'C' ELSE '' END,
                CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END,
                CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END) AS fails
            FROM w LEFT JOIN l USING (doc_id)),
        g AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY ALL),
        o AS (
            SELECT '' AS filter_order UNION ALL
            SELECT filter_order || c FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c) WHERE NOT contains(filter_order, c)),
        s AS (
            SELECT filter_order, CAST(step AS INTEGER) AS step, filter_order[step] AS c, '[' || left(filter_order, step) || ']' AS upto,
                '[' || left(filter_order, step - 1) || ' ]' AS earlier, '[' || replace('ABCDE', filter_order[step], '') || ']' AS others
            FROM o, (SELECT unnest(range(1, 6)) AS step) WHERE length(filter_order) = 5),
        r AS (
            SELECT part, filter_order, step, c,
                CAST(coalesce(sum(n) FILTER (NOT regexp_matches(fails, upto)), 0) AS BIGINT) AS kept,
                CAST(coalesce(sum(n) FILTER (contains(fails, c) AND NOT regexp_matches(fails, earlier)), 0) AS BIGINT) AS removed,
                CAST(coalesce(sum(n) FILTER (contains(fails, c) AND regexp_matches(fails, earlier)), 0) AS BIGINT) AS redundant,
                CAST(coalesce(sum(n) FILTER (contains(fails, c) AND NOT regexp_matches(fails, others)), 0) AS BIGINT) AS unique_fails,
                CAST(coalesce(sum(good) FILTER (contains(fails, c) AND NOT regexp_matches(fails, earlier)), 0) AS BIGINT) AS good_lost,
                CAST(coalesce(sum(toxic) FILTER (contains(fails, c) AND NOT regexp_matches(fails, earlier)), 0) AS BIGINT) AS toxic_lost
            FROM g, s GROUP BY ALL)
        SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
            CAST(sum(removed) OVER (PARTITION BY part, c) AS BIGINT) AS shapley
        FROM r""",
}
