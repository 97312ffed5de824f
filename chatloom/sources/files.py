"""Exported files and state: scans, the index snapshot, and sinks that appear whole or not at all."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_path, text
from ..operators.render import parse_metadata

# The folder below which exports live, and the snapshot's version.
ROOT = "AI Chat History"
SNAPSHOT_VERSION = 1
SNAPSHOT = "version int, root string, files array<struct<id: long, filename: string, relativePath: string, basename: string, platformFolder: string, metadata: struct<platform: string, sourceUrl: string, conversationId: string, title: string, needsMedia: string>>>"
FILES = "id long, filename string, relative_path string, basename string, platform_folder string, platform string, source_url string, conversation_id string, title string, needs_media string"


def _file_columns(path, relative):
    parts = F.split(relative, "/")
    return [path.alias("filename"), relative.alias("relative_path"), F.element_at(parts, -1).alias("basename"), F.when(F.size(parts) > 1, F.element_at(parts, 1)).otherwise(F.lit("")).alias("platform_folder")]


def scan_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """filename, relative_path, basename, platform_folder, markdown of all .md files below folder."""
    found = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.[mM][dD]")
    path = F.try_url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    base = folder.rstrip("/").split("://")[-1].lstrip("/")
    relative = F.substr(path, F.instr(path, base) + F.lit(len(base) + 1))
    return found.select(*_file_columns(path, relative), F.col("value").alias("markdown"))


def exported_files(scanned: DataFrame) -> DataFrame:
    """Index rows of scanned files, with what their text says of itself."""
    x = parse_metadata(scanned)
    return x.select(F.xxhash64("relative_path").alias("id"), "filename", "relative_path", "basename", "platform_folder", *(F.col(f"metadata.{c}").alias(c) for c in ("platform", "source_url", "conversation_id", "title", "needs_media")))


def downloads(history: DataFrame, root: str = ROOT) -> DataFrame:
    """Index rows of a download history (id, filename, url, exists): Markdown files below root that still exist; metadata from data: addresses."""
    from ..functions.text import from_data_url

    path = F.translate(text("filename"), "\\", "/")
    x = history.where("coalesce(exists, true)").withColumn("path", path).where(F.col("path").rlike(r"(?i)\.md\z") & F.col("path").contains(f"{root}/"))
    relative = F.substring_index(F.col("path"), f"{root}/", -1)
    x = parse_metadata(x.withColumn("markdown", F.coalesce(from_data_url("url"), F.lit(""))))
    return x.select("id", *_file_columns(F.col("path"), relative), *(F.col(f"metadata.{c}").alias(c) for c in ("platform", "source_url", "conversation_id", "title", "needs_media")))


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Index rows of a snapshot file; none if it is missing or broken."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], FILES)
    f = spark.read.schema(SNAPSHOT).option("multiLine", True).json(path).select(F.explode("files").alias("f"))
    names = {"id": "f.id", "filename": "f.filename", "relative_path": "f.relativePath", "basename": "f.basename", "platform_folder": "f.platformFolder", "platform": "f.metadata.platform", "source_url": "f.metadata.sourceUrl", "conversation_id": "f.metadata.conversationId", "title": "f.metadata.title", "needs_media": "f.metadata.needsMedia"}
    return f.select(*(F.col(v).alias(k) for k, v in names.items()))


def snapshot_json(files: DataFrame, root: str = ROOT) -> DataFrame:
    """One row, json: the snapshot of files, by path. An index is as large as its number of files; keep large ones as tables."""
    one = F.struct(F.col("relative_path").alias("_order"), F.struct("id", "filename", F.col("relative_path").alias("relativePath"), "basename", F.col("platform_folder").alias("platformFolder"), F.struct("platform", F.col("source_url").alias("sourceUrl"), F.col("conversation_id").alias("conversationId"), "title", F.col("needs_media").alias("needsMedia")).alias("metadata")).alias("f"))
    held = files.agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["f"]).alias("files"))
    return held.select(F.to_json(F.struct(F.lit(SNAPSHOT_VERSION).alias("version"), F.lit(root).alias("root"), "files"), {"pretty": "true"}).alias("json"))


def write_markdown(docs: DataFrame, folder: str, conflict: str = "uniquify") -> dict[str, int]:
    """Writes docs (path, markdown) below a folder that every executor mounts; returns how many, how many renamed, bytes.

    Paths lose empty, . and .. parts. uniquify counts up before .md where a path is taken, overwrite
    replaces. A file is written beside its place and moved there.
    """
    if conflict not in ("uniquify", "overwrite"):
        raise ValueError(f"conflict is {conflict!r}, not uniquify or overwrite")
    import os

    from ..operators.sync import unique_paths

    spark = docs.sparkSession
    plain = folder.removeprefix("file://").rstrip("/")
    x = docs.select(clean_path("path").alias("path"), "markdown").where("path <> ''")
    if conflict == "uniquify":
        os.makedirs(plain, exist_ok=True)
        existing = scan_markdown(spark, f"file://{os.path.abspath(plain)}").select(F.col("relative_path").alias("path"))
        x = unique_paths(x, existing)
    else:
        x = x.groupBy("path").agg(F.max("markdown").alias("markdown")).withColumn("target", F.col("path"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sizes = []
            for target, body in zip(frame["target"], frame["markdown"], strict=True):
                at = os.path.join(plain, target)
                os.makedirs(os.path.dirname(at), exist_ok=True)
                part = os.path.join(os.path.dirname(at), f".{uuid.uuid4().hex}.part")
                data = (body or "").encode()
                with open(part, "wb") as out:
                    out.write(data)
                os.replace(part, at)
                sizes.append(len(data))
            yield frame[["path", "target"]].assign(bytes=sizes)

    done = x.select("path", "target", "markdown").mapInPandas(run, "path string, target string, bytes long")
    total = done.agg(F.count("*").alias("files"), F.count_if(F.col("path") != F.col("target")).alias("renamed"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    return total.asDict()


def debug_snapshot(conversations: DataFrame, m: DataFrame, samples: int = 80) -> DataFrame:
    """conv_id and a JSON description of each conversation: fields, counts by role, the first `samples` messages in short."""
    short = F.slice(F.array_sort(F.collect_list(F.struct("seq", "role", F.substring("content", 1, 160).alias("text")))), 1, samples)
    counts = m.groupBy("conv_id").agg(F.count("*").alias("n_messages"), *(F.count_if(F.col("role") == r).alias(r) for r in ("user", "assistant", "system")), short.alias("samples"))
    x = conversations.join(counts, "conv_id", "left")
    return x.select("conv_id", F.to_json(F.struct(*[c for c in x.columns if c != "conv_id"])).alias("json"))
