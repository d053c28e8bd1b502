"""The queries op1_ to op10_: each applies one operator to its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallgrid.llm import bpe, chat, fertility, linededup, phraseindex, quality, simhash, sitetree, tokencount, warc
from recallgrid.llm.common import table

#: The conversation that op5 adds to those of the table.
CONTROL_CONVERSATION, CONTROL_TEXT = -7, "\\### Assistant: </turn> ok"


def op1_tokeniser_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.judge(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op2_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sitetree.extract(table(spark, sf_dir, "pages"))


def op3_gray_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_digests(linededup.dedup_lines(table(spark, sf_dir, "documents")))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(F.lit(CONTROL_CONVERSATION).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_TEXT).alias("text"))
    return chat.conversation_digests(chat.format_conversations(turns.union(more)))


def op6_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = tokencount.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 2048)


def op8_phrase_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phraseindex.digests(phraseindex.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


QUERIES = {f.__name__: f for f in (op1_tokeniser_fertility, op2_site_style_tree, op3_gray_simhash, op4_line_dedup, op5_chat_format, op6_warc_normaliser, op7_token_counts, op8_phrase_decontamination, op9_quality_classifier, op10_byte_bpe)}

_WHITE = r"[\x20\x09-\x0D]"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL = {
    "op4_line_dedup": f"""
        WITH lines AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
        ), keyed AS (
            SELECT *, {_LOWER.format(f"regexp_replace(regexp_replace(line, '^{_WHITE}+', ''), '{_WHITE}+$', '')")} AS key FROM lines
        ), repeated AS (
            SELECT key, max(doc_id) AS owner FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
        ), marked AS (
            SELECT k.doc_id, k.line, k.pos, r.key IS NULL OR r.owner = k.doc_id AS kept FROM keyed k LEFT JOIN repeated r ON k.key = r.key
        )
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT kept) AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (kept), '')) AS kept_sha256
        FROM marked GROUP BY doc_id
    """,
    "op5_chat_format": r"""
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
        ), escaped AS (
            SELECT *, replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>') AS safe FROM turns
        )
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
            sum(length('### ' || role || ': ' || safe || '</turn>') + 1)::BIGINT AS formatted_chars, false AS history_rewritten
        FROM escaped GROUP BY conv_id
    """,
    "op8_phrase_decontamination": f"""
        WITH d AS (
            SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), lambda w: {_LOWER.format("w")}) AS words FROM documents
        ), i AS (
            SELECT item_id, list_transform(regexp_extract_all(coalesce(text, ''), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), lambda w: {_LOWER.format("w")}) AS words FROM benchmark
        ), windows AS (
            SELECT item_id, least(13, len(words)) AS n, array_to_string(words[s:s + least(13, len(words)) - 1], ' ') AS gram
            FROM (SELECT *, unnest(range(1, greatest(len(words) - 13, 0) + 2)) AS s FROM i WHERE len(words) > 0)
        ), sizes AS (SELECT DISTINCT n FROM windows
        ), grams AS (
            SELECT doc_id, s, n, array_to_string(words[s:s + n - 1], ' ') AS gram
            FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS s FROM d, sizes WHERE len(words) >= n)
        ), met AS (
            SELECT g.doc_id, g.s, g.n, w.item_id FROM grams g JOIN (SELECT DISTINCT item_id, n, gram FROM windows) w ON g.gram = w.gram AND g.n = w.n
        ), hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM met) GROUP BY doc_id
        ), items AS (
            SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM met) GROUP BY doc_id
        )
        SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
            coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
        FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
    """,
}
