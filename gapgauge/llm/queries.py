"""Registered queries of the subpackage and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gapgauge.llm import conversation_trie, exact_dedup, fingerprints, graph_search, hard_negatives, language, line_dedup, mixing, near_dedup, pieces, quality, token_counts, warc
from gapgauge.llm.common import scratch_path, table

#: Least probability of label 1 with which a document counts as good.
GOOD = 0.3


def remainder(divisor: int) -> Column:
    """crc32 of doc_id as text, modulo ``divisor``; NULL for a NULL id."""
    return F.crc32(F.col("doc_id").cast("string")) % divisor


def quality_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that may be learned from."""
    return table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")).filter(remainder(5) != 0)


def op1_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, _ = near_dedup.near_duplicates(table(spark, sf_dir, "documents"))
    return members.select("doc_id", "class_id")


def op2_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_recurring_lines(table(spark, sf_dir, "documents")).select("doc_id", "lines_dropped", "text")


def op3_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.length_histogram(token_counts.encoded_lengths(table(spark, sf_dir, "documents")))


def op4_graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return graph_search.nearest(vectors, vectors.filter("vec_id % 20 = 0")).withColumn("rank", F.col("rank").cast("int"))


def op5_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "archive")
    manifest = warc.write_archive(table(spark, sf_dir, "pages"), folder)
    return warc.read_archive(manifest, folder, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.learn(docs, quality_labels(spark, sf_dir))
    scored = quality.quality_scores(docs, model)
    score = F.col("quality_score")
    return scored.select("doc_id", F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"), score.alias("score"), (score >= GOOD).cast("int").alias("predicted"))


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.encode_documents(docs, verify=True, keep=["doc_id"]).select("doc_id", F.size("ids").alias("n_pieces"), "ids", "restored")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.learn(docs.filter(remainder(4) != 2))
    found = language.predict_languages(docs, model)
    return found.select("doc_id", F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op9_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mixing_plan(docs).select("doc_id", "size", "source_size", "target", "taken", "copies", "positions")


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(table(spark, sf_dir, "documents"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    borrowed = F.crc32(F.col("conv_id").cast("string")) % 9
    return conversation_trie.conversation_trie(table(spark, sf_dir, "conversations"), borrowed, F.col("conv_id") - F.col("conv_id") % 5)


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"), every_digest=True)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(vectors.withColumn("label", moved), F.col("vec_id") % 100 == 0)


QUERIES = {
    "op1_order_minhash": op1_order_minhash,
    "op2_line_templates": op2_line_templates,
    "op3_length_histogram": op3_length_histogram,
    "op4_graph_search": op4_graph_search,
    "op5_warc_archive": op5_warc_archive,
    "op6_quality": op6_quality,
    "op7_pieces": op7_pieces,
    "op8_language": op8_language,
    "op9_curriculum": op9_curriculum,
    "op10_fingerprints": op10_fingerprints,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_hard_negatives": op13_hard_negatives,
}

#: CRC-32 of conv_id in decimals, bit by bit, for an engine without such a function.
CRC32 = """xor(4294967295, list_reduce(
    list_concat([4294967295], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda crc, byte: list_reduce(list_concat([xor(crc, byte)], range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))
))"""

ORACLES = {
    "op5_warc_archive": """
        WITH payloads AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        digests AS (
            SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM payloads
        ),
        grouped AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last_page FROM digests)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id <> last_page THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id <> last_page THEN last_page END AS refers_to
        FROM grouped
    """,
    "op11_conversation_trie": f"""
        WITH turns AS (
            SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS place
            FROM conversations WHERE conv_id IS NOT NULL
        ),
        convs AS (
            SELECT conv_id, count(*) AS n, {CRC32} % 9 AS h, conv_id - conv_id % 5 AS lender FROM turns GROUP BY conv_id
        ),
        plan AS (
            SELECT c.conv_id, c.n, c.h, c.lender, least(c.h, coalesce(b.n, 0)) AS taken
            FROM convs c LEFT JOIN convs b ON b.conv_id = c.lender
        ),
        rebuilt AS (
            SELECT p.conv_id, p.taken + t.place - p.h AS depth, role, text
            FROM plan p JOIN turns t ON t.conv_id = p.conv_id AND t.place > p.h
            UNION ALL
            SELECT p.conv_id, t.place, role, text FROM plan p JOIN turns t ON t.conv_id = p.lender AND t.place <= p.taken
        ),
        paths AS (
            SELECT conv_id, depth, octet_length(encode(text)) AS bytes,
                   sha256(array_to_string(list(sha256(role) || sha256(text)) OVER (PARTITION BY conv_id ORDER BY depth), '')) AS key
            FROM rebuilt
            UNION ALL
            SELECT conv_id, 0, 0, '' FROM convs
        ),
        members AS (
            SELECT *, min(conv_id) OVER (PARTITION BY depth, key) AS node, max(depth) OVER (PARTITION BY conv_id) AS length FROM paths
        ),
        nodes AS (
            SELECT node AS conv_id, depth, count(*) AS n_convs, (count(*) - 1) * max(bytes) AS saved,
                   string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE depth = length) AS ends
            FROM members GROUP BY node, depth
        ),
        linked AS (
            SELECT n.*, m.node AS parent_conv_id
            FROM nodes n LEFT JOIN members m ON m.conv_id = n.conv_id AND m.depth = n.depth - 1
        ),
        children AS (
            SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children
            FROM linked WHERE depth > 0 GROUP BY parent_conv_id, depth
        ),
        counted AS (
            SELECT l.*, coalesce(c.n_children, 0) AS n_children
            FROM linked l LEFT JOIN children c ON c.conv_id = l.conv_id AND c.depth = l.depth
        ),
        totals AS (
            SELECT m.node AS conv_id, m.depth, sum(CASE WHEN c.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(c.saved) AS saved_tokens
            FROM counted c JOIN members m ON m.conv_id = c.conv_id AND m.depth <= c.depth
            GROUP BY m.node, m.depth
        )
        SELECT c.conv_id, CAST(c.depth AS BIGINT) AS depth, c.parent_conv_id, CAST(c.n_convs AS BIGINT) AS n_convs,
               CAST(c.n_children AS BIGINT) AS n_children, CAST(t.n_leaves AS BIGINT) AS n_leaves,
               CAST(t.saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(c.ends, '')) AS ends_sha256
        FROM counted c JOIN totals t ON t.conv_id = c.conv_id AND t.depth = c.depth
    """,
    "op12_exact_dedup": """
        WITH texts AS (
            SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
        ),
        grouped AS (
            SELECT doc_id, max(doc_id) OVER (PARTITION BY text) AS keep_id, count(*) OVER (PARTITION BY text) AS group_size,
                   sha256(text) AS text_sha256
            FROM texts
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM grouped
    """,
    "op13_hard_negatives": """
        WITH usable AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ),
        pairs AS (
            SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
                   CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
            FROM usable a JOIN usable b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
        ),
        positives AS (
            SELECT anchor_id, vec_id AS positive_id, score FROM pairs WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
        ),
        ranked AS (
            SELECT p.anchor_id, p.positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
                   row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id) AS rank
            FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.same
             AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score
        )
        SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 5
    """,
}
