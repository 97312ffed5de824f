"""Inputs that the driver tables do not hold, derived from them by one rule in either engine's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_PLATFORM = "CASE conv_id % 6 WHEN 0 THEN 'ChatGPT' WHEN 1 THEN 'Claude' WHEN 2 THEN 'Gemini' WHEN 3 THEN 'Grok' WHEN 4 THEN 'DeepSeek' ELSE 'Doubao' END"
_BASE = "CASE conv_id % 6 WHEN 0 THEN 'https://chatgpt.com/c/' WHEN 1 THEN 'https://claude.ai/chat/' WHEN 2 THEN 'https://gemini.google.com/app/' WHEN 3 THEN 'https://grok.com/chat/' WHEN 4 THEN 'https://chat.deepseek.com/a/chat/s/' ELSE 'https://www.doubao.com/chat/' END"
_ID = "lpad(CAST(conv_id AS VARCHAR(20)), 12, '0')"
#: A row per conversation: platform, id, address, title (a third say nothing), time (a quarter have none).
CONV_META = f"""SELECT conv_id, {_PLATFORM} AS platform, {_ID} AS conversation_id, concat({_BASE}, {_ID}) AS source_url,
  CASE WHEN conv_id % 3 = 0 THEN 'New chat' ELSE concat('Talk ', CAST(conv_id AS VARCHAR(20)), ' - ', {_PLATFORM}) END AS title,
  CASE WHEN conv_id % 4 = 0 THEN '' ELSE concat('2025-0', CAST(1 + conv_id % 9 AS VARCHAR(20)), '-1', CAST(conv_id % 10 AS VARCHAR(20)), 'T08:00:00.000Z') END AS conversation_time
FROM (SELECT DISTINCT conv_id FROM conversations) c"""
#: Messages with every third turn said again, by the same role and by the other.
MESSAGES_TWICE = """SELECT conv_id, turn * 4 AS seq, role, text AS content FROM conversations
  UNION ALL SELECT conv_id, turn * 4 + 1, role, concat(text, ' ') FROM conversations WHERE turn % 3 = 0
  UNION ALL SELECT conv_id, turn * 4 + 2, CASE role WHEN 'user' THEN 'assistant' ELSE 'user' END, text FROM conversations WHERE turn % 3 = 0"""
#: Messages with null roles on every third turn.
MESSAGES_GAPS = "SELECT conv_id, turn AS seq, CASE WHEN turn % 3 = 0 THEN NULL ELSE role END AS role, text AS content FROM conversations"
#: Messages whose neighbours share roles in places, with times on odd turns.
MESSAGES_RUNS = "SELECT conv_id, turn AS seq, CASE WHEN turn % 4 < 2 THEN 'user' ELSE 'assistant' END AS role, text AS content, CASE WHEN turn % 2 = 1 THEN concat('2025-01-0', CAST(1 + turn AS VARCHAR(20))) ELSE '' END AS time FROM conversations"
#: Messages followed by a shorter one that they contain.
MESSAGES_INSIDE = "SELECT conv_id, turn * 2 AS seq, role, text AS content FROM conversations UNION ALL SELECT conv_id, turn * 2 + 1, role, substring(text, 3, 40) FROM conversations"
#: Messages with references to media.
MESSAGES_MEDIA = """SELECT conv_id, turn AS seq, role, CASE WHEN (conv_id + turn) % 9 = 0 THEN concat(text, ' ![x](https://example.com/a.png)') WHEN (conv_id + turn) % 7 = 0 THEN concat(text, ' ![x](media/a.png)')
  WHEN (conv_id + turn) % 11 = 0 THEN concat(text, ' [image: file-1]') ELSE text END AS content FROM conversations"""
#: An export index: even ids by id, multiples of 5 by address, of 7 by file name.
EXPORTS = f"""SELECT conv_id AS id, CASE WHEN conv_id % 7 = 0 THEN concat(platform, '/', CASE WHEN conversation_time = '' THEN '' ELSE concat(substring(conversation_time, 1, 10), '_') END, platform, '_Talk_', CAST(conv_id AS VARCHAR(20)), ' (1).md') ELSE concat('old/', CAST(conv_id AS VARCHAR(20)), '.md') END AS relative_path,
  CASE WHEN conv_id % 7 = 0 THEN platform ELSE 'old' END AS platform_folder, platform, CASE WHEN conv_id % 5 = 0 THEN concat(source_url, '?x=1') ELSE '' END AS source_url, CASE WHEN conv_id % 2 = 0 THEN conversation_id ELSE '' END AS conversation_id
FROM ({CONV_META}) m WHERE conv_id % 2 = 0 OR conv_id % 5 = 0 OR conv_id % 7 = 0"""
#: What the registry knows: two thirds of the conversations, with up to two messages less than there are now.
REGISTRY = f"""SELECT m.platform, m.conversation_id, m.source_url AS url, n.n - m.conv_id % 3 AS message_count, concat('2025-01-', CAST(10 + m.conv_id % 10 AS VARCHAR(20))) AS backed_up_at
FROM ({CONV_META}) m JOIN (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id) n ON n.conv_id = m.conv_id WHERE m.conv_id % 3 <> 2"""
#: Discovered conversations, some twice with fields missing.
DISCOVERED = f"""SELECT conv_id * 2 AS ord, platform, CASE WHEN conv_id % 2 = 0 THEN conversation_id ELSE '' END AS conversation_id, source_url AS url, CASE WHEN conv_id % 5 = 0 THEN '' ELSE concat('Talk ', CAST(conv_id AS VARCHAR(20))) END AS title, conversation_time, '' AS raw_date, '' AS filename FROM ({CONV_META}) m
  UNION ALL SELECT conv_id * 2 + 1, platform, conversation_id, source_url, concat('Second ', CAST(conv_id AS VARCHAR(20))), '2025-03-03', 'Mar 3', '' FROM ({CONV_META}) m WHERE conv_id % 5 = 0"""
#: Times of events as seconds, milliseconds, microseconds, ISO, and broken.
RAW_TIMES = """SELECT event_id, user_id, CASE event_id % 5 WHEN 0 THEN CAST({seconds} AS VARCHAR(20)) WHEN 1 THEN CAST({seconds} * 1000 + 7 AS VARCHAR(20)) WHEN 2 THEN CAST({seconds} * 1000000 + 9000 AS VARCHAR(20))
  WHEN 3 THEN concat('at ', {iso}) ELSE concat('no', CAST(event_id AS VARCHAR(20))) END AS raw FROM events"""
RAW_TIMES_SPARK = RAW_TIMES.format(seconds="unix_seconds(CAST(ts AS TIMESTAMP))", iso="date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\")")
RAW_TIMES_DUCK = RAW_TIMES.format(seconds="CAST(floor(epoch(ts)) AS BIGINT)", iso="strftime(ts, '%Y-%m-%dT%H:%M:%SZ')")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str, sql: str, *names: str) -> DataFrame:
    """The rule over the tables that it names."""
    return spark.sql(_named(sql, names), **{n: table(spark, sf_dir, n) for n in names})


def _named(sql: str, names: tuple[str, ...]) -> str:
    import re

    for n in names:
        sql = re.sub(rf"\b(FROM|JOIN) {n}\b", rf"\1 {{{n}}}", sql)
    return sql
