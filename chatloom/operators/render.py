"""Markdown documents from conversations, and what can be read back from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import build_filename, compact_markdown, escape_yaml, text, unescape_yaml
from .messages import display_titles, needs_media, turn_numbers

HEADINGS = {"assistant": "Assistant", "system": "System"}


def role_heading(role) -> Column:
    return F.when(text(role) == "assistant", "Assistant").when(text(role) == "system", "System").otherwise("User")


def message_blocks(m: DataFrame) -> DataFrame:
    """Adds turn_number and block, the message as it stands in a document."""
    time = text("time") if "time" in m.columns else F.lit("")
    block = F.concat(F.lit("## Message "), F.col("turn_number").cast("string"), F.lit(" - "), role_heading("role"), F.when(time != "", F.concat(F.lit("\n\n_Time: "), time, F.lit("_"))).otherwise(F.lit("")), F.lit("\n\n"), compact_markdown("content"))
    return turn_numbers(m).withColumn("block", block)


def _fields() -> tuple[Column, Column]:
    """Front matter and visible metadata; empty values are left out, but for the media flag."""
    flag = F.when(F.col("needs_media"), "true").otherwise("false")
    yaml = lambda k, c: F.when(text(c) != "", F.concat(F.lit(f'{k}: "'), escape_yaml(c), F.lit('"')))
    line = lambda k, c: F.when(text(c) != "", F.concat(F.lit(f"- {k}: "), text(c)))
    front = F.concat_ws("\n", F.lit("---"), F.lit("status: raw"), F.concat(F.lit("needs_media: "), flag), yaml("platform", "platform"), yaml("source_url", "source_url"), yaml("conversation_title", "title"), yaml("conversation_time", "conversation_time"), yaml("conversation_id", "conversation_id"), F.lit("---\n\n"))
    seen = F.concat_ws("\n", F.lit("## Metadata\n"), F.concat(F.lit("- Needs media: "), flag), line("Platform", "platform"), line("Source URL", "source_url"), line("Conversation time", "conversation_time"), line("Conversation ID", "conversation_id"), F.lit("\n"))
    return front, seen


def documents(conversations: DataFrame, m: DataFrame) -> DataFrame:
    """conv_id, filename, markdown, n_messages of conversations (conv_id, platform, source_url, title, conversation_time, conversation_id) with messages m."""
    blocks = message_blocks(m).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("seq", "block"))).alias("blocks"), F.count("*").alias("n_messages"))
    x = display_titles(conversations, m).join(blocks, "conv_id").join(needs_media(m), "conv_id")
    front, seen = _fields()
    body = F.array_join(F.transform("blocks", lambda b: b["block"]), "\n\n")
    page = F.concat(compact_markdown(F.concat(front, F.lit("# "), F.col("title"), F.lit("\n\n"), seen, body)), F.lit("\n"))
    return x.select("conv_id", build_filename("platform", "title", "conversation_time").alias("filename"), page.alias("markdown"), "n_messages", "platform", "title", "needs_media")


def front_matter(markdown) -> Column:
    """map of the front matter's keys (lower case, signs as _) to values; of a repeated key the first."""
    block = F.regexp_extract(text(markdown), r"(?s)^---\r?\n(.*?)\r?\n---", 1)
    return _pairs(F.split(block, r"\r?\n"), r"^([A-Za-z0-9_ -]+):\s*(.*?)\s*\z")


def visible_metadata(markdown) -> Column:
    """The same from the list under the Metadata heading."""
    block = F.regexp_extract(text(markdown), r"(?s)(?:^|\n)## Metadata\s*\n(.*?)(?:\n## |\z)", 1)
    return _pairs(F.split(block, r"\r?\n"), r"^-\s*([A-Za-z0-9_ -]+):\s*(.*?)\s*\z")


def _pairs(lines: Column, pattern: str) -> Column:
    key = lambda s: F.regexp_replace(F.lower(F.trim(F.regexp_extract(s, pattern, 1))), "[ -]+", "_")

    def value(s: Column) -> Column:
        v = F.regexp_extract(s, pattern, 2)
        return F.when(v.rlike(r'^".*"\z'), unescape_yaml(F.substr(v, F.lit(2), F.length(v) - 2))).otherwise(F.regexp_replace(v, r"^'(.*)'\z", "$1"))

    held = F.filter(F.transform(lines, lambda s: F.struct(key(s).alias("key"), value(s).alias("value"))), lambda p: p["key"] != "")
    first = F.filter(held, lambda p, i: ~F.exists(F.slice(held, F.lit(1), i), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(first)


# Names under which metadata appear in documents, by the field that they give.
METADATA_NAMES = {"platform": ("platform",), "source_url": ("source_url", "url"), "conversation_id": ("conversation_id",), "title": ("conversation_title", "title"), "conversation_time": ("conversation_time",), "needs_media": ("needs_media",)}


def parse_metadata(docs: DataFrame, column: str = "markdown") -> DataFrame:
    """Adds metadata, a struct of what front matter says and, where that is silent, the visible list."""
    x = docs.withColumn("_yaml", front_matter(column)).withColumn("_seen", visible_metadata(column))
    pick = lambda names: F.coalesce(*(F.nullif(F.col(s)[n], F.lit("")) for s in ("_yaml", "_seen") for n in names), F.lit(""))
    return x.withColumn("metadata", F.struct(*(pick(names).alias(field) for field, names in METADATA_NAMES.items()))).drop("_yaml", "_seen")
