"""Chat formatting in budgeted windows, with DataFrame functions only.

A turn is written as

    <s>ROLE[INST]TEXT[/INST]</s>

and the four control strings are escaped inside roles and texts: ~ becomes ~0 and the control strings
~1 to ~4, which undoing in the opposite order reverses exactly. A conversation becomes windows of at
most `budget` tokens (words and signs, and TURN_TOKENS for each turn's marks):

* prefix sums of the turns' tokens choose turn-aligned spans. With room for what is left of the
  budget after the system turn and the history, a turn of more than room / 2 tokens is a span of its
  own, and between such turns a span holds the turns that begin in one stretch of room / 2 tokens, so
  that no span is larger than room;
* every window begins with the conversation's system turn, if its first turn is one;
* then come those last turns of the span before that begin within `history` tokens of its end;
* only assistant texts of the window's own span are under the loss mask, so that each is learned once.

Only where a single turn (with the system turn) is larger than the budget is the window larger too;
over_budget says so. A turn is never cut.

Null roles and texts count as empty; turns with the same number are ordered by role and text, repeated
rows are repeated turns; a null conv_id is a conversation like any other. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BUDGET = 1024
HISTORY = 128
TURN_TOKENS = 4
OPEN, TEXT, CLOSE, END = "<s>", "[INST]", "[/INST]", "</s>"
#: Escapes in the order in which they are made.
ESCAPES = (("~", "~0"), (OPEN, "~1"), (END, "~2"), (TEXT, "~3"), (CLOSE, "~4"))
TOKEN = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"
PROBE = "</s>[INST] ok [/INST]"


def escape(x: Column) -> Column:
    for plain, escaped in ESCAPES:
        x = F.replace(x, F.lit(plain), F.lit(escaped))
    return x


def unescape(x: Column) -> Column:
    for plain, escaped in reversed(ESCAPES):
        x = F.replace(x, F.lit(escaped), F.lit(plain))
    return x


def format_windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """conv_id, window, text, n_repeated (leading turns that other windows hold too), loss (array of start, length in characters), tokens, over_budget."""
    least = max(16, budget // 8)
    x = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    x = x.withColumn("tokens", F.regexp_count("text", F.lit(TOKEN)) + F.lit(TURN_TOKENS))
    run = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    whole = W.partitionBy("conv_id")
    x = x.withColumn("at", F.row_number().over(run) - 1)
    x = x.withColumn("is_system", (F.col("at") == 0) & (F.col("role") == "system"))
    x = x.withColumn("room", F.greatest(F.lit(budget - history) - F.sum(F.when(F.col("is_system"), F.col("tokens")).otherwise(0)).over(whole), F.lit(least)))
    x = x.withColumn("stride", F.floor(F.col("room") / 2)).withColumn("long", (F.col("tokens") > F.col("stride")) & ~F.col("is_system"))
    ordered = W.partitionBy("conv_id").orderBy("at")
    before = ordered.rowsBetween(W.unboundedPreceding, -1)
    upto = ordered.rowsBetween(W.unboundedPreceding, 0)
    x = x.withColumn("begin", F.coalesce(F.sum(F.when(~F.col("is_system"), F.col("tokens")).otherwise(0)).over(before), F.lit(0)))
    x = x.withColumn("segment", F.sum((F.col("long") | F.coalesce(F.lag("long").over(ordered), F.lit(False))).cast("int")).over(upto))
    # before the first turn of its own a conversation has the system turn, which begins where that one does
    x = x.withColumn("stretch", F.floor((F.col("begin") - F.min("begin").over(W.partitionBy("conv_id", "segment"))) / F.col("stride")))
    moved = (F.col("segment") != F.lag("segment").over(ordered)) | (F.col("stretch") != F.lag("stretch").over(ordered))
    x = x.withColumn("moved", F.coalesce(moved & ~F.coalesce(F.lag("is_system").over(ordered), F.lit(False)), F.lit(False)))
    x = x.withColumn("window", F.sum(F.col("moved").cast("int")).over(upto))
    x = x.withColumn("next_begin", F.min("begin").over(W.partitionBy("conv_id").orderBy("window").rangeBetween(1, 1))).withColumn("last", F.max("window").over(whole))
    again = F.when(F.col("is_system"), F.sequence(F.lit(0).cast("long"), F.col("last"))).when(F.col("next_begin") - F.col("begin") <= history, F.array("window", F.col("window") + 1)).otherwise(F.array("window"))
    x = x.withColumn("own", F.col("window")).withColumn("window", F.explode(again)).withColumn("repeated", F.col("window") != F.col("own"))

    head = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(TEXT))
    x = x.select("conv_id", "window", "at", "role", "repeated", "tokens", head.alias("head"), escape(F.col("text")).alias("body"))
    x = x.withColumn("written", F.concat("head", "body", F.lit(CLOSE + END)))
    start = F.coalesce(F.sum(F.length("written")).over(W.partitionBy("conv_id", "window").orderBy("at").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) + F.length("head")
    x = x.withColumn("start", start).withColumn("learned", (F.col("role") == "assistant") & ~F.col("repeated"))
    turns = F.array_sort(F.collect_list(F.struct("at", "written", "learned", F.col("start").cast("long").alias("start"), F.length("body").cast("long").alias("length"))))
    out = x.groupBy("conv_id", "window").agg(turns.alias("turns"), F.count_if("repeated").alias("n_repeated"), F.sum("tokens").alias("tokens"))
    loss = F.transform(F.filter("turns", lambda t: t["learned"]), lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length")))
    return out.select("conv_id", "window", F.array_join(F.transform("turns", lambda t: t["written"]), "").alias("text"), "n_repeated", loss.alias("loss"), "tokens", (F.col("tokens") > budget).alias("over_budget"))


def parsed_turns(text: Column) -> Column:
    """array of (role, text) read back from a window."""
    parts = F.filter(F.split(text, F.lit(END), F.lit(-1)), lambda t: t != "")
    body = lambda t: F.substr(t, F.length(F.substring_index(t, TEXT, 1)) + F.lit(len(TEXT) + 1))
    return F.transform(parts, lambda t: F.struct(unescape(F.substr(F.substring_index(t, TEXT, 1), F.lit(len(OPEN) + 1))).alias("role"), unescape(F.substring_index(body(t), CLOSE, 1)).alias("text")))


def op2_chat_windows(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.sql(f"SELECT CAST(-7 AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, '{PROBE}' AS text FROM VALUES (0, 'user'), (1, 'assistant') AS t(turn, role)")
    windows = format_windows(rows.unionByName(probe))
    fresh = F.slice(parsed_turns(F.col("text")), F.col("n_repeated").cast("int") + 1, F.greatest(F.lit(1), F.length("text")))
    masked = F.transform("loss", lambda s: unescape(F.substr(F.col("text"), s["start"].cast("int") + 1, s["length"].cast("int"))))
    read = windows.select("conv_id", F.struct("window", fresh.alias("turns"), masked.alias("masked"), F.length("text").alias("chars")).alias("w"))
    read = read.groupBy("conv_id").agg(F.array_sort(F.collect_list("w")).alias("w"))
    turns = F.flatten(F.transform("w", lambda w: w["turns"]))
    learned = F.array_join(F.flatten(F.transform("w", lambda w: w["masked"])), "")
    return read.select(
        "conv_id",
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"),
        F.aggregate("w", F.lit(0).cast("long"), lambda n, w: n + w["chars"]).alias("formatted_chars"),
    )


def _sql_escaped(x: str) -> str:
    for plain, escaped in ESCAPES:
        x = f"replace({x}, '{plain}', '{escaped}')"
    return x


ORACLE = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{PROBE}' UNION ALL SELECT -7, 1, 'assistant', '{PROBE}'),
a AS (
  SELECT *, len(regexp_extract_all(text, '{TOKEN}')) + {TURN_TOKENS} AS tokens,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS idx FROM c),
b AS (SELECT *, (idx = 0 AND role = 'system') AS is_system FROM a),
d AS (SELECT *, floor(greatest({BUDGET - HISTORY} - sum(CASE WHEN is_system THEN tokens ELSE 0 END) OVER (PARTITION BY conv_id), {max(16, BUDGET // 8)}) / 2) AS stride FROM b),
e AS (
  SELECT *, (tokens > stride AND NOT is_system) AS long,
    coalesce(sum(CASE WHEN is_system THEN 0 ELSE tokens END) OVER (PARTITION BY conv_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins FROM d),
f AS (SELECT *, coalesce(lag(long) OVER (PARTITION BY conv_id ORDER BY idx), FALSE) AS after FROM e),
g AS (SELECT *, sum((long OR after)::INT) OVER (PARTITION BY conv_id ORDER BY idx) AS segment FROM f),
h AS (SELECT *, floor((begins - min(begins) OVER (PARTITION BY conv_id, segment)) / stride) AS stretch FROM g),
i AS (
  SELECT *, coalesce((segment <> lag(segment) OVER o OR stretch <> lag(stretch) OVER o) AND NOT coalesce(lag(is_system) OVER o, FALSE), FALSE) AS moved
  FROM h WINDOW o AS (PARTITION BY conv_id ORDER BY idx)),
j AS (SELECT *, sum(moved::INT) OVER (PARTITION BY conv_id ORDER BY idx) AS win FROM i),
k AS (SELECT conv_id, win, min(begins) AS begins FROM j GROUP BY ALL),
l AS (
  SELECT j.*, max(j.win) OVER (PARTITION BY j.conv_id) + 1 AS windows, k.begins AS next_begin
  FROM j LEFT JOIN k ON k.conv_id = j.conv_id AND k.win = j.win + 1),
m AS (
  SELECT *, CASE WHEN is_system THEN windows WHEN next_begin - begins <= {HISTORY} THEN 2 ELSE 1 END AS copies,
    length({_sql_escaped("role")}) + length({_sql_escaped("text")}) + {len(OPEN + TEXT + CLOSE + END)} AS chars FROM l)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY idx)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY idx), '')) AS loss_sha256,
  sum(chars * copies)::BIGINT AS formatted_chars
FROM m GROUP BY conv_id
"""
