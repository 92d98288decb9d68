"""The corpus queries by name, and the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .alignment import align_tokenizers
from .common import table
from .decontamination import decontaminate
from .exact_dedup import exact_dedup
from .html_extraction import extract_pages
from .mixing import mix
from .packing import pack
from .pii import find_pii
from .resampling import importance_resample
from .secrets import find_secrets
from .sharding import shard_documents
from .simhash import simhash_near_dups
from .token_counts import token_counts
from .toxicity import score_toxicity


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_near_dups(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabularies = [public_tokenizers.path(f) for f in ("word_bpe_49k.json", "byte_bpe_multi_50k.tiktoken")]
    return find_secrets(table(spark, sf_dir, "documents"), vocabularies=vocabularies)


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align_tokenizers(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_token_counts": op2_token_counts,
    "op3_mixing": op3_mixing,
    "op4_sharding": op4_sharding,
    "op5_simhash": op5_simhash,
    "op6_toxicity": op6_toxicity,
    "op7_decontamination": op7_decontamination,
    "op8_html_extraction": op8_html_extraction,
    "op9_pii": op9_pii,
    "op10_secrets": op10_secrets,
    "op11_packing": op11_packing,
    "op12_resampling": op12_resampling,
    "op13_alignment": op13_alignment,
}

ORACLE_SQL: dict[str, str] = {
    "op1_exact_dedup": r"""
WITH n AS (
    SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS s
    FROM documents
), g AS (
    SELECT doc_id, s, count(*) OVER (PARTITION BY s) AS group_size,
           first_value(doc_id) OVER (PARTITION BY s ORDER BY points DESC, doc_id) AS keep_id
    FROM n
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(s) AS text_sha256 FROM g
""",
    "op12_resampling": r"""
WITH RECURSIVE entry(v, x, k) AS (
    SELECT i, i, 0 FROM range(256) AS t(i)
    UNION ALL SELECT v, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, k + 1 FROM entry WHERE k < 8
), crc AS (SELECT list(x ORDER BY v) AS entries FROM entry WHERE k = 8
), w AS (
    SELECT 'd' AS side, doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
    UNION ALL SELECT 'b', NULL, -row_number() OVER (), regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark
), f AS (
    SELECT side, r, unnest(words || list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS feature FROM w
), per AS (SELECT feature, side, r, count(*) AS n FROM f GROUP BY ALL
), hashed AS (
    SELECT feature, xor(list_reduce(list_transform(range(octet_length(encode(feature))), lambda i: CAST(concat('0x', substr(hex(encode(feature)), 2 * i + 1, 2)) AS BIGINT)), lambda c, x: xor(c >> 8, entries[(xor(c, x) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) % 10000 AS b
    FROM (SELECT DISTINCT feature FROM per), crc
), bucketed AS (SELECT side, r, b, sum(n) AS n FROM per JOIN hashed USING (feature) GROUP BY ALL
), sums AS (SELECT b, sum(n) FILTER (side = 'd') AS s, sum(n) FILTER (side = 'b') AS t FROM bucketed GROUP BY b
), whole AS (SELECT coalesce(sum(s), 0) AS s, coalesce(sum(t), 0) AS t FROM sums
), gain AS (
    SELECT b, CAST(floor(1000 * ln(CAST(coalesce(sums.t, 0) + 1 AS DOUBLE) * CAST(whole.s + 10000 AS DOUBLE) / (CAST(coalesce(sums.s, 0) + 1 AS DOUBLE) * CAST(whole.t + 10000 AS DOUBLE)))) AS BIGINT) AS g
    FROM sums, whole
), weighed AS (
    SELECT r, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * g) AS BIGINT) AS total FROM bucketed JOIN gain USING (b) WHERE side = 'd' GROUP BY r
), scored AS (
    SELECT doc_id, r, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_features, 0) AS n_features, coalesce((total - ((total % n_features) + n_features) % n_features) // n_features, 0) AS weight,
           CAST(concat('0x', substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8)) AS BIGINT) AS h
    FROM w LEFT JOIN weighed USING (r) WHERE side = 'd'
), final AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) AS BIGINT) AS score FROM scored
), ranked AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) FILTER (n_words >= 20) OVER () AS eligible FROM final)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= eligible * 25 // 100 THEN place END AS rank, n_words FROM ranked
""",
}
