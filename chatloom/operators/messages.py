"""Operators over the messages of conversations: DataFrames of (conv_id, seq, role, content, ...).

Order within a conversation is seq. Everything that needs only a running view is a window over
conv_id, so that chained operators share one exchange; what depends on which rows were kept before
folds over the conversation's sorted array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import bind, compact_markdown, first_meaningful_line, is_generic_title, normalize_for_dedupe, normalize_whitespace, text, truncate

ROLES = ("user", "assistant", "system")
SHORTEST_CONTAINED, LONGER_BY = 24, 24


def _run():
    return W.partitionBy("conv_id").orderBy("seq")


def _upto():
    return _run().rowsBetween(W.unboundedPreceding, W.currentRow)


def valid_messages(m: DataFrame) -> DataFrame:
    """Known roles with text."""
    return m.where(F.col("role").isin(*ROLES) & (normalize_whitespace("content") != ""))


def turn_numbers(m: DataFrame) -> DataFrame:
    """Adds turn_number: a user message opens a turn, and so does whatever else comes first."""
    users = F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(_upto())
    leads = F.when(F.coalesce(F.first("role").over(_upto()), F.lit("")) != "user", 1).otherwise(0)
    return m.withColumn("turn_number", (users + leads).cast("long"))


def alternating_roles(m: DataFrame) -> DataFrame:
    """Fills null roles by turns from the last given one, user first."""
    given = F.last("role", ignorenulls=True).over(_upto())
    since = F.col("at") - F.coalesce(F.last(F.when(F.col("role").isNotNull(), F.col("at")), ignorenulls=True).over(_upto()), F.lit(-1))
    m = m.withColumn("at", F.row_number().over(_run()) - 1)
    flips = F.when(F.coalesce(given, F.lit("assistant")) == "user", since % 2 == 0).otherwise(since % 2 == 1)
    return m.withColumn("role", F.coalesce("role", F.when(flips, F.lit("user")).otherwise(F.lit("assistant")))).drop("at")


def parity_roles(m: DataFrame) -> DataFrame:
    """Roles by place alone: user, assistant, user, ..."""
    return m.withColumn("role", F.when(F.pmod(F.row_number().over(_run()) - 1, F.lit(2)) == 0, "user").otherwise("assistant"))


def merge_adjacent(m: DataFrame) -> DataFrame:
    """Neighbours of one role become one message: texts with a blank line between, the first time that there is."""
    m = m.withColumn("island", F.sum((F.col("role") != F.coalesce(F.lag("role").over(_run()), F.lit(""))).cast("int")).over(_upto()))
    time = F.col("time") if "time" in m.columns else F.lit("")
    rows = F.array_sort(F.collect_list(F.struct("seq", text("content").alias("content"), text(time).alias("time"))))
    out = m.groupBy("conv_id", "island", "role").agg(rows.alias("rows"))
    times = F.filter("rows", lambda r: r["time"] != "")
    return out.select("conv_id", F.col("rows")[0]["seq"].alias("seq"), "role", F.array_join(F.transform("rows", lambda r: r["content"]), "\n\n").alias("content"), F.coalesce(F.get(times, F.lit(0))["time"], F.lit("")).alias("time"), F.size("rows").alias("n_merged"))


def merge_continuations(m: DataFrame) -> DataFrame:
    """Neighbouring assistant messages to everyone become one, without anything between them."""
    joins = (F.col("role") == "assistant") & (F.lag("role").over(_run()) == "assistant")
    if "recipient" in m.columns:
        open_ = lambda c: F.coalesce(c, F.lit("all")) == "all"
        joins = joins & open_(F.col("recipient")) & open_(F.lag("recipient").over(_run()))
    m = m.withColumn("island", F.sum((~F.coalesce(joins, F.lit(False))).cast("int")).over(_upto()))
    rows = F.array_sort(F.collect_list(F.struct("seq", text("content").alias("content"))))
    out = m.groupBy("conv_id", "island", "role").agg(rows.alias("rows"))
    return out.select("conv_id", F.col("rows")[0]["seq"].alias("seq"), "role", F.array_join(F.transform("rows", lambda r: r["content"]), "").alias("content"))


def dedupe_same_role(m: DataFrame) -> DataFrame:
    """The first of the messages of a role that read alike."""
    m = m.withColumn("norm", normalize_for_dedupe(normalize_whitespace("content")))
    first = F.row_number().over(W.partitionBy("conv_id", "role", "norm").orderBy("seq"))
    return m.where(F.length(normalize_whitespace("content")) >= 2).withColumn("rn", first).where("rn = 1").drop("rn", "norm")


_KEPT = "array<struct<seq: bigint, role: string, content: string, norm: string>>"


def dedupe(m: DataFrame) -> DataFrame:
    """Drops what reads like one of the three messages kept last or like any kept one of its role, then what a much longer message of its role contains."""
    norm = normalize_for_dedupe(normalize_whitespace("content"))
    row = F.struct(F.col("seq").cast("long").alias("seq"), text("role").alias("role"), normalize_whitespace("content").alias("content"), norm.alias("norm"))
    whole = m.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))

    def step(kept: Column, r: Column) -> Column:
        near = F.exists(F.slice(kept, F.greatest(F.size(kept) - 2, F.lit(1)), F.lit(3)), lambda k: k["norm"] == r["norm"])
        same = F.exists(kept, lambda k: (k["role"] == r["role"]) & (k["norm"] == r["norm"]))
        return F.when((F.length(r["content"]) < 2) | near | same, kept).otherwise(F.concat(kept, F.array(r)))

    kept = F.aggregate("rows", F.array().cast(_KEPT), step)
    whole = whole.select("conv_id", kept.alias("kept"))
    contained = lambda r, k: (k["role"] == r["role"]) & (k["seq"] != r["seq"]) & (F.length(r["norm"]) >= SHORTEST_CONTAINED) & (F.length(k["norm"]) >= F.length(r["norm"]) + LONGER_BY) & (F.instr(k["norm"], r["norm"]) > 0)
    left = F.filter("kept", lambda r: ~F.exists("kept", lambda k: contained(r, k)))
    return whole.select("conv_id", F.explode(left).alias("m")).select("conv_id", "m.seq", "m.role", "m.content")


def drop_contained(m: DataFrame) -> DataFrame:
    """Drops messages that a longer message of the same role and conversation contains."""
    m = m.withColumn("norm", normalize_for_dedupe("content"))
    a, b = m.alias("a"), m.select("conv_id", "role", "norm").alias("b")
    near = (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("a.role") == F.col("b.role"))
    holds = (F.length("a.norm") >= SHORTEST_CONTAINED) & (F.length("b.norm") >= F.length("a.norm") + LONGER_BY) & (F.instr(F.col("b.norm"), F.col("a.norm")) > 0)
    return a.join(b, near & holds, "left_anti").drop("norm")


def drop_echoes(m: DataFrame) -> DataFrame:
    """Drops assistant messages that only repeat one of the conversation's user messages."""
    m = m.withColumn("norm", normalize_for_dedupe("content"))
    asked = m.where((F.col("role") == "user") & (F.col("norm") != "")).select("conv_id", "norm", F.lit("assistant").alias("role")).distinct()
    return m.join(asked, ["conv_id", "norm", "role"], "left_anti").select(*[c for c in m.columns if c != "norm"])


_TIMED = "array<struct<role: string, time: string>>"


def aligned_times(mine: Column, theirs: Column) -> Column:
    """Times of the messages `mine` (structs with role and time), those without one taken from `theirs` in step: each takes the next timed one of its role after the last one taken, whatever role that had."""
    plain = lambda x: F.coalesce(F.transform(x, lambda m: F.struct(text(m["role"]).alias("role"), text(m["time"]).alias("time"))), F.array().cast(_TIMED))
    timed = F.filter(F.transform(plain(theirs), lambda t, i: F.struct(i.cast("int").alias("i"), t["role"].alias("role"), t["time"].alias("time"))), lambda t: t["time"] != "")
    start = F.struct(F.lit(0).alias("cursor"), F.array().cast("array<string>").alias("out"))

    def step(timed: Column, state: Column, r: Column) -> Column:
        hit = F.get(F.filter(timed, lambda t: (t["i"] >= state["cursor"]) & (t["role"] == r["role"])), F.lit(0))
        takes = (r["time"] == "") & hit.isNotNull()
        return F.struct(F.when(takes, hit["i"] + 1).otherwise(state["cursor"]).alias("cursor"), F.concat(state["out"], F.array(F.when(takes, hit["time"]).otherwise(r["time"]))).alias("out"))

    walk = lambda timed: F.aggregate(plain(mine), start, lambda state, r: step(timed, state, r), lambda s: s["out"])
    return F.get(F.transform(F.array(timed), walk), F.lit(0))  # a lambda's variable, so that it is computed once


def align_times(m: DataFrame, source: DataFrame) -> DataFrame:
    """The rows of m with times of source (conv_id, seq, role, time) where they have none, by aligned_times().

    Each row of m comes back once, repeated or null numbers and ids included; rows of equal seq are
    taken in the order of their other columns, which must have one.
    """
    mine = m.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("seq", text("role").alias("role"), text("time").alias("time"), F.struct(*m.columns).alias("row")))).alias("mine"))
    theirs = source.groupBy(F.col("conv_id").alias("of")).agg(F.array_sort(F.collect_list(F.struct("seq", text("role").alias("role"), text("time").alias("time")))).alias("theirs"))
    both = mine.join(theirs, F.col("conv_id").eqNullSafe(F.col("of")), "left").select("mine", aligned_times(F.col("mine"), F.col("theirs")).alias("times"))
    rows = both.select(F.explode(F.arrays_zip("mine", "times")).alias("x"))
    return rows.select(*(F.col("x.times").alias(c) if c == "time" else F.col(f"x.mine.row.{c}").alias(c) for c in m.columns))


def _copies(conversations: DataFrame, cached: DataFrame, fields: list[str]) -> DataFrame:
    """conversations with `got`, the structured copy of each: that of its own (platform, conversation_id), or without id the platform's latest.

    Of copies with one key the latest counts, of equally late ones the larger.
    """
    one = F.struct("cached_at", F.col("conversation_id").alias("id"), *fields)
    own = cached.groupBy("platform", "conversation_id").agg(F.max(one).alias("exact"))
    latest = cached.groupBy("platform").agg(F.max(one).alias("latest"))
    both = conversations.join(own, ["platform", "conversation_id"], "left").join(latest, "platform", "left")
    return both.withColumn("got", F.when(text("conversation_id") == "", F.col("latest")).otherwise(F.col("exact"))).drop("exact", "latest")


def _first_of(c: str, k: str) -> Column:
    return F.when(text(c) != "", text(c)).otherwise(F.coalesce(F.col(f"got.{k}"), F.lit(""))).alias(c)


def enrich(conversations: DataFrame, cached: DataFrame) -> DataFrame:
    """Fills empty title, id and time from a structured copy of the conversation, one row per row of conversations.

    Both: platform, conversation_id, title, conversation_time; cached also cached_at.
    """
    both = _copies(conversations, cached, ["title", "conversation_time"])
    others = [c for c in conversations.columns if c not in ("title", "conversation_id", "conversation_time")]
    return both.select(*others, _first_of("title", "title"), _first_of("conversation_id", "id"), _first_of("conversation_time", "conversation_time"))


def merge_structured(conversations: DataFrame, cached: DataFrame, times: bool = True) -> DataFrame:
    """enrich() with messages (array of role, content, time) and source_url: messages of the page win, but for times that they lack; a page without messages takes the copy's.

    times false: the copy's times, of conversation and messages, do not count.
    """
    got = F.transform("got.messages", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"), (text(m["time"]) if times else F.lit("")).alias("time")))
    both = _copies(conversations, cached, ["title", "conversation_time", "source_url", "messages"]).withColumn("copied", got)
    none = F.coalesce(F.size("messages"), F.lit(0)) <= 0
    takes = none & (F.coalesce(F.size("copied"), F.lit(0)) > 0)
    told = F.zip_with("messages", aligned_times(F.col("messages"), F.col("copied")), lambda m, t: F.struct(m["role"].alias("role"), m["content"].alias("content"), t.alias("time"))) if times else F.col("messages")
    messages = F.when(takes, F.col("copied")).when(none | F.col("got").isNull(), F.col("messages")).otherwise(told)
    time = _first_of("conversation_time", "conversation_time") if times else text("conversation_time").alias("conversation_time")
    id_ = F.when(takes, F.col("got.id")).otherwise(_first_of("conversation_id", "id")).alias("conversation_id")
    url = F.when(takes, _first_of("source_url", "source_url")).otherwise(F.col("source_url")).alias("source_url")
    changed = {"title", "conversation_id", "conversation_time", "source_url", "messages"}
    return both.select(*(c for c in conversations.columns if c not in changed), url, _first_of("title", "title"), id_, time, messages.alias("messages"))


def export_problem(conversations: DataFrame, m: DataFrame) -> DataFrame:
    """conversations (conv_id, ...) with `problem`: 'no messages', 'no roles' (nobody asks or answers), or empty."""
    said = m.groupBy("conv_id").agg(F.bool_or(F.col("role").isin("user", "assistant")).alias("_roles"))
    problem = F.when(F.col("_n").isNull(), "no messages").when(~F.coalesce("_roles", F.lit(False)), "no roles").otherwise("")
    return conversations.join(said.withColumn("_n", F.lit(1)), "conv_id", "left").withColumn("problem", problem).drop("_n", "_roles")


def role_diversity(m: DataFrame) -> DataFrame:
    """Conversations with user and assistant messages, two at least."""
    has = lambda r: F.bool_or(F.col("role") == r)
    return m.groupBy("conv_id").agg(F.count("*").alias("n_messages"), has("user").alias("has_user"), has("assistant").alias("has_assistant")).where("n_messages >= 2 AND has_user AND has_assistant")


def conversation_scores(m: DataFrame) -> DataFrame:
    """How much a set of messages looks like a dialogue: pairs, changes of role, length, balance."""
    m = m.withColumn("turned", F.coalesce((F.col("role") != F.lag("role").over(_run())).cast("int"), F.lit(0)))
    c = m.groupBy("conv_id").agg(F.count("*").alias("n"), F.count_if(F.col("role") == "user").alias("users"), F.count_if(F.col("role") == "assistant").alias("assistants"), F.sum("turned").alias("transitions"))
    pairs = F.least("users", "assistants")
    length = F.least("n", F.when(pairs > 0, pairs * 2 + 2).otherwise(3))
    penalty = F.when(pairs > 0, F.abs(F.col("users") - F.col("assistants")) * 2).otherwise(F.greatest(F.lit(0), F.col("n") - 1) * 2)
    signs = F.when(F.col("users") > 0, 5).otherwise(0) + F.when(F.col("assistants") > 0, 5).otherwise(0)
    return c.select("conv_id", F.col("n").alias("n_messages"), pairs.alias("pairs"), "transitions", (pairs * 20 + F.col("transitions") * 3 + length + signs - penalty).cast("long").alias("score"))


def best_candidate(scored: DataFrame) -> DataFrame:
    """The best of each conversation's candidate sets (conv_id, candidate, score); of equals the first."""
    rank = F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("score"), "candidate"))
    return scored.withColumn("rn", rank).where("rn = 1").drop("rn")


def message_times(m: DataFrame) -> DataFrame:
    """first_time: of the first message that has one; min_time: the smallest."""
    time = F.nullif(text("time"), F.lit(""))
    return m.groupBy("conv_id").agg(F.coalesce(F.min_by(time, F.when(time.isNotNull(), F.col("seq"))), F.lit("")).alias("first_time"), F.coalesce(F.min(time), F.lit("")).alias("min_time"))


def display_titles(conversations: DataFrame, m: DataFrame) -> DataFrame:
    """conversations (conv_id, platform, title, ...) with the title to show: its own, if that says anything, else the first line that the user (or anyone) wrote."""
    first = F.coalesce(F.min_by("content", F.when(F.col("role") == "user", F.col("seq"))), F.min_by("content", "seq"))
    lead = m.groupBy("conv_id").agg(first.alias("_lead"))
    said = truncate(first_meaningful_line("_lead"), 140)
    otherwise = lambda title: bind(said, lambda s: F.when(s != "", s).when(title != "", title).otherwise(F.lit("AI Chat")))
    shown = bind(truncate("title", 140), lambda title: F.when((title != "") & ~is_generic_title(title, F.col("platform")), title).otherwise(otherwise(title)))
    return conversations.join(lead, "conv_id", "left").withColumn("title", shown).drop("_lead")


def media_needed(x) -> Column:
    """Whether a text refers to media that are not local files."""
    images = F.transform(F.regexp_extract_all(text(x), F.lit(r"!\[[^\]]*\]\(([^)]+)\)"), F.lit(1)), lambda h: F.regexp_replace(F.trim(h), r"^<|>\z", ""))
    remote = F.exists(images, lambda h: (h == "") | h.rlike("(?i)^(?:https?:|blob:|file-service:|attachment:)"))
    return text(x).rlike(r"(?i)\[(?:image|img|media|file|attachment):[^\]]*\]") | remote


def attachment_needed(a: Column) -> Column:
    """Whether an attachment struct (type, local_path, exported, downloaded, needs_media) is media without a local file."""
    kind = F.lower(F.coalesce(a["type"], F.lit(""))).rlike("image|video|audio|file|attachment|pdf|spreadsheet|document")
    local = F.coalesce(a["exported"], F.lit(False)) | F.coalesce(a["downloaded"], F.lit(False)) | (F.coalesce(a["local_path"], F.lit("")) != "")
    return F.coalesce(a["needs_media"], kind & ~local)


def needs_media(m: DataFrame) -> DataFrame:
    """conv_id, needs_media: any message that says so itself, or else has such an attachment or text."""
    own = media_needed("content")
    if "attachments" in m.columns:
        own = F.coalesce(F.exists("attachments", attachment_needed), F.lit(False)) | own
    if "needs_media" in m.columns:
        own = F.coalesce(F.col("needs_media"), own)
    return m.groupBy("conv_id").agg(F.bool_or(own).alias("needs_media"))


def title_specificity(title, platform=None) -> Column:
    """0 for nothing, 1 for a title that any conversation may have, else its length, at most 160."""
    generic = lambda clean: is_generic_title(clean, platform) if platform is not None else is_generic_title(clean)
    return bind(normalize_whitespace(title), lambda clean: F.when(clean == "", 0).when(generic(clean), 1).otherwise(F.least(F.length(clean), F.lit(160))))


def more_specific_title(own, other, platform=None) -> Column:
    """The other title where there is none, or where it says more."""
    better = (text(own) == "") | (title_specificity(other, platform) > title_specificity(own, platform))
    return F.when((text(other) != "") & better, text(other)).otherwise(text(own))


def time_precision(time) -> Column:
    """0 for nothing, 2 for a day with a time of day, 1 for anything else."""
    return F.when(F.trim(text(time)) == "", 0).when(text(time).rlike("[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}"), 2).otherwise(1)


def more_precise_time(own, other) -> Column:
    """The other time where there is none, or where it is more precise."""
    better = (text(own) == "") | (time_precision(other) > time_precision(own))
    return F.when((text(other) != "") & better, text(other)).otherwise(text(own))


def apply_overrides(conversations: DataFrame, overrides: DataFrame) -> DataFrame:
    """conversations (conv_id, platform, title, conversation_time, conversation_id, ...) with what overrides (conv_id and any of the three fields, one row per conv_id) know better: the title if it says more, the time if it is more precise, the id always."""
    given = overrides.select(F.col("conv_id").alias("_of"), *((F.col(c) if c in overrides.columns else F.lit(None).cast("string")).alias(f"_{c}") for c in ("title", "conversation_time", "conversation_id")))
    both = conversations.join(given, F.col("conv_id") == F.col("_of"), "left")
    both = both.withColumn("title", more_specific_title("title", "_title", F.col("platform"))).withColumn("conversation_time", more_precise_time("conversation_time", "_conversation_time"))
    return both.withColumn("conversation_id", F.when(text("_conversation_id") != "", F.col("_conversation_id")).otherwise(F.col("conversation_id"))).select(*conversations.columns)


def compacted(m: DataFrame) -> DataFrame:
    return m.withColumn("content", compact_markdown("content"))
