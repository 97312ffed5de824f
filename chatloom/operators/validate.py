"""Checks of exported documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import text

# What every document is held against; a rule's pattern must match, or where it says so must not.
RULES = (
    ("filename is still untitled", "filename", r"(?i)^untitled(?: \([0-9]+\))?\.md\z", False),
    ("missing YAML front matter", "markdown", r"^---\n", True),
    ("missing raw status", "markdown", r"(?m)^status:\s*raw\s*$", True),
    ("missing source_url", "markdown", r"source_url:\s*[\"']?https?://", True),
    ("missing needs_media boolean", "markdown", r"(?m)^needs_media:\s*(?:true|false)\s*$", True),
    ("missing visible Metadata section", "markdown", "## Metadata", True),
    ("missing visible Needs media metadata", "markdown", r"(?m)^- Needs media: (?:true|false)\s*$", True),
    ("missing User turn headings", "markdown", "## Message [0-9]+ - User", True),
    ("missing Assistant turn headings", "markdown", "## Message [0-9]+ - Assistant", True),
    ("contains export-time metadata", "markdown", "(?i)exported_at|export_time|exported time", False),
    ("contains copied UI chrome text", "markdown", "(?im)^(copy to clipboard|copy code|copy table|复制代码|复制表格|复制到剪贴板)$", False),
    ("contains standalone code language label before a fence", "markdown", r"(?im)^(python|c|c\+\+|cpp|javascript|typescript|bash|shell|json|sql)\s*\n```", False),
)
FIRST_EXCHANGE = "first user/assistant exchange is not numbered as Message 1"
# Platforms of which an export must hold a document.
REQUIRED_PLATFORMS = ("ChatGPT", "Claude", "Gemini", "Grok")


def platform_of(markdown) -> Column:
    block = F.regexp_extract(text(markdown), r"(?s)^---\n(.*?)\n---", 1)
    return F.trim(F.regexp_extract(block, r"(?m)^platform:\s*[\"']?([^\"'\n]+)[\"']?", 1))


def is_reference_example(filename, markdown) -> Column:
    return text(filename).rlike("(?i)^(范例_|example[_-])") | (~text(markdown).rlike(r"^---\n") & text(filename).rlike("(?i)范例|example"))


def errors_of(filename, markdown) -> Column:
    """array of the rules that a document breaks."""
    held = {"filename": text(filename), "markdown": text(markdown)}
    found = [F.when(platform_of(markdown) == "", F.lit("missing YAML platform"))]
    for message, of, pattern, must in RULES:
        if message == "contains export-time metadata":
            first = F.instr(held["markdown"], "## Message 1 - User") * F.instr(held["markdown"], "## Message 1 - Assistant")
            found.append(F.when(first == 0, F.lit(FIRST_EXCHANGE)))
        hit = held[of].rlike(pattern)
        found.append(F.when(~hit if must else hit, F.lit(message)))
    return F.array_compact(F.array(*found))


def validate(docs: DataFrame) -> DataFrame:
    """filename, platform, errors of docs (filename, markdown), but for reference examples."""
    kept = docs.where(~is_reference_example("filename", "markdown"))
    return kept.select("filename", platform_of("markdown").alias("platform"), errors_of("filename", "markdown").alias("errors"))


def roll_up(validated: DataFrame, required: tuple[str, ...] = REQUIRED_PLATFORMS) -> DataFrame:
    """One row: documents, failures, platforms seen, required platforms that are missing (which count as one failure more)."""
    seen = F.array_sort(F.collect_set(F.nullif(F.col("platform"), F.lit(""))))
    x = validated.agg(F.count("*").alias("n_files"), F.count_if(F.size("errors") > 0).alias("n_failed"), seen.alias("seen"))
    missing = F.array_sort(F.array_except(F.array(*map(F.lit, required)) if required else F.array().cast("array<string>"), "seen"))
    return x.select("n_files", (F.col("n_failed") + F.when(F.size(missing) > 0, 1).otherwise(0)).alias("n_failed"), F.array_join("seen", ",").alias("seen"), F.array_join(missing, ",").alias("missing"))
