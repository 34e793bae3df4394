"""The queries of the corpus operators, and the SQL that DuckDB runs beside them."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, fingerprint, neardup, packing, quality, secrets, sharding, topk, toxicity
from .common import cut, in_fold, shared_folder, table


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(table(spark, sf_dir, "documents"))


def op2_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents"), 24, map_path=f"{shared_folder(spark)}/slot-maps/{uuid.uuid4().hex}")
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot", "edited_shard")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut_pieces = packing.pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return packing.pack(cut_pieces)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), in_fold("doc_id", 3, 1)
    model = quality.fit(docs, table(spark, sf_dir, "labels"), "quality", held_out)
    return quality.score(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20).drop("depth")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), in_fold("doc_id", 4, 2)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), "toxic", held_out)
    return toxicity.score(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.with_edits(table(spark, sf_dir, "documents"))


def op8_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    hard = f"{chat.END}{chat.START}assistant ok"
    turns = turns.unionByName(spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], turns.schema))
    messages = cut(chat.threads(turns))
    return chat.read_back(chat.formatted(messages, chat.best_paths(messages)))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


# What SQL can tell of three queries, by the same operators: sizes, edited texts, decoded texts.


def shard_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_shards(spark, sf_dir).select("doc_id", "size")


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def decoded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_bpe(spark, sf_dir).select("doc_id", "decoded_sha256")


QUERIES = {f.__name__: f for f in (op1_secrets, op2_shards, op3_packing, op4_quality, op5_topk, op6_toxicity, op7_fingerprints, op8_neardup, op9_chat, op10_bpe, shard_sizes, edited_texts, decoded_texts)}

_ESCAPED = "replace(replace(replace({0}, '\\', '\\\\'), '<|', '<\\|'), '|>', '|\\>')"

ORACLE: dict[str, str] = {
    "shard_sizes": "SELECT doc_id, CAST(strlen(coalesce(text, '')) + 8 AS BIGINT) AS size FROM documents",
    "edited_texts": """
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, row_number() OVER (ORDER BY doc_id) AS k FROM documents),
        e AS (SELECT d.doc_id, d.t, d.n, d.n // 2 AS h, f.t AS next FROM d JOIN d f ON f.k = d.k % (SELECT count(*) FROM d) + 1)
        SELECT doc_id, n AS n_chars, sha256(substr(t, 1, n - h) || substr(next, 1, h)) AS edited_sha256 FROM e""",
    "decoded_texts": "SELECT doc_id, sha256(coalesce(text, '')) AS decoded_sha256 FROM documents",
    "op5_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.x AS DOUBLE[]), CAST(c.x AS DOUBLE[])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op8_neardup": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
        sets AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM words),
        flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
        rare AS (SELECT x FROM flat GROUP BY x HAVING count(*) > 1),
        pairs AS (
            SELECT a.doc_id AS a, b.doc_id AS b FROM flat a JOIN rare USING (x) JOIN flat b ON a.x = b.x AND a.doc_id < b.doc_id
            GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
        edges AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
        reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON r.other = e.a),
        least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
        SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN least USING (doc_id)""",
    "op9_chat": f"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
            sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
            CAST(sum(length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")}) + 24) AS BIGINT) AS formatted_chars
        FROM t GROUP BY conv_id""",
}
