"""Keyed state over streams of captured events, and the same folds over tables.

State lives with its key and expires by processing time; replayed events change nothing, so that a
source that delivers at least once is enough. The caches' size limits hold for the whole cache and
are applied by compact() over what a stream has written, since no key knows of the others.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import text
from ..functions.times import normalize_timestamp

# Sizes and lifetimes of the caches, pauses between saves.
TIMESTAMP_CACHE, CONVERSATION_CACHE, EVIDENCE_RING = 2000, 80, 200
TTL_MS = 30 * 24 * 3600 * 1000
SAVE_EVERY = "2 seconds"

_TIMES = "conversation_id string, platform string, timestamp string, title string, updated_at string"
_TIME_STATE = "timestamp string, timestamp_ord long, platform string, title string, title_ord long, updated_at string, updated_ord long"


def earliest_times(events: DataFrame) -> DataFrame:
    """Per conversation of events (ord, conversation_id, platform, timestamp, title, updated_at): the smallest time and its platform, the first title, the last update.

    Times are normalised first, since an epoch in digits sorts before any date.
    """
    x = events.withColumn("timestamp", normalize_timestamp("timestamp")).where("conversation_id <> '' and timestamp <> ''")
    last = lambda c: F.coalesce(F.max_by(c, F.when(text(c) != "", F.col("ord"))), F.lit("")).alias(c)
    first = lambda c: F.coalesce(F.min_by(c, F.when(text(c) != "", F.col("ord"))), F.lit("")).alias(c)
    return x.groupBy("conversation_id").agg(F.min_by("platform", F.struct("timestamp", "ord")).alias("platform"), F.min("timestamp").alias("timestamp"), first("title"), last("updated_at"))


def _fold_times(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState, expires: bool) -> Iterator[pd.DataFrame]:
    if expires and state.hasTimedOut:
        state.remove()
        return
    time, at, platform, title, title_at, updated, updated_at = state.get if state.exists else (None, 0, "", "", 0, "", 0)
    for x in frames:  # a key's rows may be spread over frames in any order
        for r in x.sort_values("ord").itertuples():
            if time is None or (r.timestamp, r.ord) < (time, at):
                time, at, platform = r.timestamp, r.ord, r.platform
            if r.title and (not title or r.ord < title_at):
                title, title_at = r.title, r.ord
            if r.updated_at and (not updated or r.ord >= updated_at):
                updated, updated_at = r.updated_at, r.ord
    state.update((time, at, platform, title, title_at, updated, updated_at))
    if expires:
        state.setTimeoutDuration(TTL_MS)
    yield pd.DataFrame({"conversation_id": [key[0]], "platform": [platform], "timestamp": [time], "title": [title], "updated_at": [updated]})


def stream_earliest_times(events: DataFrame, expires: bool = True) -> DataFrame:
    """earliest_times() of a stream, in update mode: a row per conversation that a batch touched. ord, a whole number, tells first and last in whatever order events arrive.

    Expiry by processing time keeps a query open for ever; for one that ends with its input, turn it off.
    """
    x = events.withColumn("timestamp", normalize_timestamp("timestamp")).where("conversation_id <> '' and timestamp <> ''").withColumn("ord", F.coalesce(F.col("ord").cast("long"), F.lit(-(2**63))))
    return x.groupBy("conversation_id").applyInPandasWithState(lambda key, frames, held: _fold_times(key, frames, held, expires), _TIMES, _TIME_STATE, "update", GroupStateTimeout.ProcessingTimeTimeout if expires else GroupStateTimeout.NoTimeout)


def longest_conversations(events: DataFrame) -> DataFrame:
    """Per (platform, conversation_id) of events (ord, source_url, title, conversation_time, messages): the longest list of messages (of equals the last), of each other field the last that is not empty."""
    x = events.where("conversation_id <> '' and platform <> '' and size(messages) > 0")
    last = lambda c: F.coalesce(F.max_by(c, F.when(text(c) != "", F.col("ord"))), F.lit("")).alias(c)
    return x.groupBy("platform", "conversation_id").agg(last("source_url"), last("title"), last("conversation_time"), F.max_by("messages", F.struct(F.size("messages"), "ord")).alias("messages"))


def stream_longest_conversations(events: DataFrame) -> DataFrame:
    """longest_conversations() of a stream, in update mode: a native aggregate, so that no Python holds the messages and ord alone tells which is last."""
    return longest_conversations(events)


def upsert_sink(path: str):
    """A foreachBatch function that writes the rows of a batch, which holds one per key, to path/batch=N; rewriting a batch changes nothing."""

    def write(frame: DataFrame, batch: int) -> None:
        frame.withColumn("cached_at", F.lit(batch).cast("long")).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return write


def compact(rows: DataFrame, keys: list[str], keep: int) -> DataFrame:
    """The newest row of each key of what upsert_sink() wrote, and of those the `keep` newest."""
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), "cached_at").alias("r")).select(*keys, "r.*")
    return newest.orderBy(F.desc("cached_at"), *keys).limit(keep)


def ring(evidence: DataFrame, keep: int = EVIDENCE_RING) -> DataFrame:
    """The `keep` rows captured last."""
    return evidence.orderBy(F.desc("captured_at"), F.desc("ord")).limit(keep)


def exactly_once(events: DataFrame, keys: list[str], replay_ms: int = 15_000, expires: bool = True) -> DataFrame:
    """A stream with the first row of each key, without the repeats that a sender makes within `replay_ms` of processing time; no row is too late.

    Native, so that rows never pass through Python and the state holds keys only. A key is forgotten in a later batch than
    the first that begins `replay_ms` after it; expires false: never (and a query that ends with its input ends).
    """
    if not expires:
        return events.dropDuplicates(keys)
    at = events.withColumn("_at", F.current_timestamp()).withWatermark("_at", f"{(replay_ms + 1) // 2} milliseconds")
    return at.dropDuplicatesWithinWatermark(keys).drop("_at")


def save_stream(frame: DataFrame, path: str, checkpoint: str, every: str | None = SAVE_EVERY):
    """Starts a query that saves what changed at most every `every` (None: what there is, and ends) in upsert_sink()'s form."""
    writer = frame.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(upsert_sink(path))
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
