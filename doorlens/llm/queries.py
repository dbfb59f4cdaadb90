"""The registered queries of the numbered operators, over whole tables and with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doorlens.llm import (
    chat, decontaminate, hard_negatives, html_text, licences, mixing, prefix_trie, quality, sharding, simhash, suffix_dedup, token_counts, token_files,
)
from doorlens.session import land


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_format_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations")
    hostile = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", hostile), (-7, 1, "assistant", hostile)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_windows(given.select("conv_id", "turn", "role", "text").unionByName(extra)))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_files.scratch_folder(spark, "ids")
    token_files.write_ids(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"))
    return token_files.read_ids(spark, folder)


def op7_shard_interleaved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_report(table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op10_section_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.section_tokens(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = land(hard_negatives.vectors(given.withColumn("label", moved)), "vectors")
    return hard_negatives.mine(rows, F.col("vec_id") % 100 == 0)


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removal_report(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie_nodes(prefix_trie.branched(table(spark, sf_dir, "conversations")))


QUERIES = {f.__name__: f for f in (
    op1_quality_rules, op2_simhash_near_dedup, op3_decontaminate, op4_mix_sources, op5_format_chats, op6_token_files,
    op7_shard_interleaved, op8_license_scan, op9_html_text, op10_section_tokens,
    op11_hard_negatives, op12_suffix_dedup, op13_prefix_trie,
)}
OP1_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, coalesce('0' || source, '1') AS host FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS l, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS p FROM d),
windows AS (SELECT r, i, l[i] || ' ' || l[i + 1] || ' ' || l[i + 2] AS g FROM (SELECT r, l, unnest(range(1, len(l) - 1)) AS i FROM w)),
twice AS (SELECT r, i FROM (SELECT *, count(*) OVER (PARTITION BY r, g) AS n FROM windows) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT i + j) AS n FROM twice, unnest([0, 1, 2]) AS o(j) GROUP BY r),
m AS (SELECT w.r, doc_id, len(l) AS n_words, length(array_to_string(l, '')) AS word_chars,
        length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(p) - len(list_distinct(p)) AS n_dup_lines,
        coalesce(c.n, 0) AS n_repeat_words FROM w LEFT JOIN covered c ON w.r = c.r),
lines AS (SELECT r, host, t, trim(regexp_replace(lower(x), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS line FROM (SELECT r, host, t, unnest(string_split(t, chr(10))) AS x FROM d)),
worded AS (SELECT *, len(string_split(line, ' ')) AS n FROM lines WHERE line <> ''),
hosts AS (SELECT host, count(DISTINCT t) AS documents FROM d GROUP BY host),
above AS (SELECT s.host, line FROM worded s JOIN hosts h ON s.host = h.host GROUP BY s.host, line, documents
    HAVING count(DISTINCT t) > 10 AND count(DISTINCT t) > 0.002 * documents),
gone AS (SELECT r, count(*) AS gone_lines, sum(n) AS gone_words FROM worded JOIN above USING (host, line) GROUP BY r),
judged AS (SELECT m.*, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, coalesce(gone_lines, 0) AS gone_lines, coalesce(gone_words, 0) AS gone_words
    FROM m LEFT JOIN gone ON m.r = gone.r)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
    CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
    NOT base_failed AND n_words - gone_words >= 25 AND n_words - gone_words >= 0.5 * n_words AS kept,
    CAST(gone_lines AS BIGINT) AS gone_lines, CAST(gone_words AS BIGINT) AS gone_words FROM judged"""

#: The other operators rest on seeded draws, fingerprints, trained models or a tokenizer: tests hold them against brute force.
SQL: dict[str, str] = {"op1_quality_rules": OP1_SQL}
