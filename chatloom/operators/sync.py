"""Incremental export: which discovered conversations are new, may have grown, or are done.

An export index is three key tables; a discovered conversation is looked up by identity, then by
address, then by file name, and the first hit decides. Keys are compared as equi-joins of key tables,
whatever their size; Spark broadcasts what is small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import build_filename, canonical_export_key, text
from ..functions.urls import detect_platform, discovered_key, identity_key, platform_label, registry_key, source_url_key

RULES = ("conversation_id", "source_url", "filename")


def export_index_keys(files: DataFrame) -> DataFrame:
    """(rule, key), each once, of exported files (relative_path, basename, platform_folder, platform, source_url, conversation_id)."""
    platform = F.coalesce(F.nullif(text("platform"), F.lit("")), F.nullif(text("platform_folder"), F.lit("")), platform_label(detect_platform("source_url", strict=False)))
    folder = F.when((text("platform_folder") != "") & (text("basename") != ""), F.concat("platform_folder", F.lit("/"), "basename")).otherwise(F.lit(""))
    keys = [("conversation_id", identity_key(platform, "conversation_id")), ("source_url", source_url_key(platform, "source_url"))]
    keys += [("filename", canonical_export_key(x)) for x in ("relative_path", "basename", folder)]
    rows = files.select(F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), k.alias("key")) for r, k in keys))).alias("x"))
    return rows.select("x.rule", "x.key").where("key <> ''").distinct()


def merge_queue(discovered: DataFrame, previous: DataFrame) -> DataFrame:
    """discovered (url, ...) with empty conversation_time and filename, raw_date and title filled from the previous queue's row of the same url."""
    old = previous.select("url", *(F.col(c).alias(f"_{c}") for c in ("title", "conversation_time", "raw_date", "filename")))
    old = old.groupBy("url").agg(*(F.max(c).alias(c) for c in old.columns if c != "url"))
    both = discovered.join(old, "url", "left")
    fill = lambda c: F.coalesce(F.nullif(text(c), F.lit("")), text(f"_{c}")).alias(c)
    filled = ("title", "conversation_time", "raw_date", "filename")
    return both.select(*(c for c in discovered.columns if c not in filled), *map(fill, filled))


def lookup(items: DataFrame, index: DataFrame) -> DataFrame:
    """items (ord, platform, conversation_id, url, title, conversation_time, filename) with rule and key of the first hit in the index, or nulls."""
    named = F.array(text("filename"), build_filename("platform", F.when(text("title") != "", text("title")).otherwise(F.lit("AI Chat")), "conversation_time"), build_filename("platform", F.when(text("title") != "", text("title")).otherwise(F.lit("AI Chat")), F.lit("")))
    x = items.withColumn("_names", F.filter(named, lambda n: n != "")).withColumn("_names", F.concat(F.flatten(F.transform("_names", lambda n: F.array(n, F.concat(text("platform"), F.lit("/"), n))))))
    asked = F.concat(
        F.array(F.struct(F.lit(0).alias("place"), F.lit(RULES[0]).alias("rule"), identity_key("platform", "conversation_id").alias("key")), F.struct(F.lit(1).alias("place"), F.lit(RULES[1]).alias("rule"), source_url_key("platform", "url").alias("key"))),
        F.transform("_names", lambda n, i: F.struct((i + 2).cast("int").alias("place"), F.lit(RULES[2]).alias("rule"), n.alias("key"))),
    )
    rows = x.select("ord", F.explode(asked).alias("a")).select("ord", "a.place", "a.rule", F.when(F.col("a.rule") == RULES[2], canonical_export_key("a.key")).otherwise(F.col("a.key")).alias("key")).where("key <> ''")
    hits = rows.join(index, ["rule", "key"], "left_semi").groupBy("ord").agg(F.min(F.struct("place", "rule", "key")).alias("hit"))
    return items.join(hits, "ord", "left").select(*items.columns, F.col("hit.rule").alias("rule"), F.col("hit.key").alias("key"))


def queue_key(platform, conversation_id, url):
    own = identity_key(platform, conversation_id)
    return F.when(own != "", own).otherwise(source_url_key(platform, url))


def dedupe_queue(items: DataFrame) -> DataFrame:
    """The first item of each conversation by ord; items without any key all stay."""
    key = queue_key("platform", "conversation_id", "url")
    keyed = F.when(key != "", key).otherwise(F.concat(F.lit("\u0000"), F.col("ord").cast("string")))
    return items.withColumn("_rn", F.row_number().over(W.partitionBy(keyed).orderBy("ord"))).where("_rn = 1").drop("_rn")


def classify(items: DataFrame, index: DataFrame, registry: DataFrame, force_reexport: bool = False, previous_count_default: int = 0) -> DataFrame:
    """items deduplicated, with status, needs_update_check, previous_message_count and rule.

    Whatever the index holds is queued for an update check against the registry's (platform,
    conversation_id, url, message_count); without a registry row the count is previous_count_default,
    so that the export is repeated.
    """
    found = dedupe_queue(lookup(items, index.limit(0) if force_reexport else index))
    counts = registry.select(registry_key("platform", "conversation_id", "url").alias("_key"), "message_count").where("_key <> ''").groupBy("_key").agg(F.max("message_count").alias("message_count"))
    x = found.withColumn("_key", registry_key("platform", "conversation_id", "url")).join(counts, "_key", "left")
    known = F.col("rule").isNotNull()
    return x.select(*items.columns, F.lit("queued").alias("status"), known.alias("needs_update_check"), F.when(known, F.coalesce("message_count", F.lit(previous_count_default))).otherwise(0).cast("long").alias("previous_message_count"), F.coalesce("rule", F.lit("")).alias("rule"))


def outcome(queue: DataFrame, exported: DataFrame) -> DataFrame:
    """queue with action (new, update, skip, failed) and message_count, given exported (ord, n_messages); without a row there, it failed."""
    x = queue.join(exported.select("ord", F.col("n_messages").alias("message_count")), "ord", "left")
    grown = F.col("message_count") > F.col("previous_message_count")
    action = F.when(F.col("message_count").isNull(), "failed").when(~F.col("needs_update_check"), "new").when(grown, "update").otherwise("skip")
    status = F.when(action == "failed", "failed").when(action == "skip", "skipped").otherwise("succeeded")
    return x.withColumn("action", action).withColumn("status", status)


def queue_counts(queue: DataFrame, registry: DataFrame) -> DataFrame:
    of = lambda s: F.count_if(F.col("status") == s).alias(s)
    known = registry.select(registry_key("platform", "conversation_id", "url").alias("k")).where("k <> ''").distinct().agg(F.count("*").alias("registry"))
    return queue.agg(F.count("*").alias("total"), of("queued"), of("succeeded"), of("skipped"), of("failed"), F.count_if((F.col("status") == "queued") & F.col("needs_update_check")).alias("needs_update_check")).join(known)


def union_exports(downloads: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Files (relative_path, ...) of both, a path once: the download's first, then the smallest id."""
    both = downloads.withColumn("source", F.lit("downloads")).unionByName(snapshot.withColumn("source", F.lit("snapshot")))
    rank = F.row_number().over(W.partitionBy("relative_path").orderBy(F.when(F.col("source") == "downloads", 0).otherwise(1), "id"))
    return both.withColumn("_rn", rank).where("_rn = 1").drop("_rn")


def upsert_discovered(items: DataFrame) -> DataFrame:
    """items (ord, platform, conversation_id, url, title, conversation_time, raw_date) with one row per conversation, each field the first that is not empty."""
    key = discovered_key("platform", "conversation_id", "url")
    first = lambda c: F.coalesce(F.min_by(c, F.when(text(c) != "", F.col("ord"))), F.lit("")).alias(c)
    return items.withColumn("item_key", key).where("item_key <> ''").groupBy("item_key").agg(F.min("ord").alias("ord"), *(first(c) for c in ("platform", "conversation_id", "url", "title", "conversation_time", "raw_date")))


def upsert_registry(registry: DataFrame, exported: DataFrame) -> DataFrame:
    """One row per registry key: that of the latest backed_up_at."""
    both = registry.unionByName(exported).withColumn("_key", registry_key("platform", "conversation_id", "url")).where("_key <> ''")
    rank = F.row_number().over(W.partitionBy("_key").orderBy(F.desc("backed_up_at"), F.desc("message_count")))
    return both.withColumn("_rn", rank).where("_rn = 1").drop("_rn", "_key")


def remember_exports(index: DataFrame, exported: DataFrame) -> DataFrame:
    """The index with the keys of files just written."""
    return index.unionByName(export_index_keys(exported)).distinct()


def missing_platforms(files: DataFrame, required: DataFrame) -> DataFrame:
    return required.select("platform").exceptAll(files.select("platform").distinct())


def unique_paths(files: DataFrame, existing: DataFrame) -> DataFrame:
    """files (path, ...) with target: the path, or with the first free counter before .md where it is taken by an existing file or an earlier one."""
    stem = F.regexp_replace("path", r"(?i)\.md\z", "")
    taken = existing.select(F.regexp_replace(F.regexp_replace("path", r"(?i)\.md\z", ""), r" \([0-9]+\)\z", "").alias("stem"), F.when(F.col("path").rlike(r"(?i) \([0-9]+\)\.md\z"), F.regexp_extract("path", r"(?i) \(([0-9]{1,9})\)\.md\z", 1).try_cast("int")).otherwise(0).alias("n"))
    taken = taken.groupBy("stem").agg(F.array_sort(F.collect_set("n")).alias("taken"))
    x = files.withColumn("stem", stem).withColumn("place", F.row_number().over(W.partitionBy("path").orderBy(*[c for c in files.columns if c != "path"])) - 1).join(taken, "stem", "left")
    # Of the sorted counters taken, the k-th (from 0) stands before the wanted free one if fewer than place + 1 are free below it.
    below = F.filter(F.transform(F.coalesce("taken", F.array().cast("array<int>")), lambda t, k: t - k), lambda free: free <= F.col("place"))
    n = (F.col("place") + F.size(below)).cast("int")
    return x.withColumn("target", F.when(n == 0, F.col("path")).otherwise(F.concat("stem", F.lit(" ("), n.cast("string"), F.lit(").md")))).drop("stem", "place", "taken")


def lru(cache: DataFrame, key: str, keep: int, by: str = "cached_at") -> DataFrame:
    """The `keep` entries used last; of equals, those with the larger key."""
    return cache.orderBy(F.desc(by), F.desc(key)).limit(keep)
