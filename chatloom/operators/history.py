"""Conversations listed in pages' side bars and search results, and a conversation's time from all that tells it."""

from __future__ import annotations

import datetime
import re
from collections.abc import Iterator
from itertools import pairwise

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.html import Node, parse
from ..functions.html import normalize_whitespace as plain
from ..functions.text import bind, normalize_whitespace, text, trim, truncate
from ..functions.times import history_date, read_time_candidate
from ..functions.urls import conversation_url, detect_platform, last_id_segment, platform_label
from ..runtime import written
from ..sources.pages import select, visible

# How far an entry's surroundings are looked at.
ENTRY_ANCESTORS, ENTRY_TEXT, ENTRY_TITLE_TEXT = 8, 240, 200
HEADER_ANCESTORS, HEADER_TEXT = 10, 40
TITLE_LENGTH = 120
RECENT_MINUTES = 10
# Words that are no part of a title.
_W, _NW = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
DATE_WORDS = (
    rf"(?i){_W}(?:today|yesterday){_NW}|(?<=[A-Za-z0-9_])(?:今天|今日|昨天|前天)(?=[A-Za-z0-9_])",
    rf"{_W}20[0-9]{{2}}[./-][0-9]{{1,2}}[./-][0-9]{{1,2}}{_NW}",
    rf"{_W}20[0-9]{{2}}\s*年\s*[0-9]{{1,2}}\s*月\s*[0-9]{{1,2}}\s*日?",
    rf"{_W}[A-Za-z]{{3,9}}\.?\s+[0-9]{{1,2}}(?:,\s*20[0-9]{{2}})?{_NW}",
    rf"{_W}[0-9]{{1,2}}\s*月\s*[0-9]{{1,2}}\s*日?",
    rf"{_W}[0-9]{{1,2}}[./-][0-9]{{1,2}}(?:[./-](?:20[0-9]{{2}}|[0-9]{{2}}))?{_NW}",
)
UI_WORDS = (
    rf"(?i){_W}(?:new chat|new conversation|chat history|conversation history|recent|pinned|more options|open chat|ChatGPT|DeepSeek|Doubao){_NW}",
    r"(?i)(?<=[A-Za-z0-9_])与\s*Gemini\s*对话(?=[A-Za-z0-9_])",
    "更多选项|打开聊天|新对话|最近|已固定|历史记录|查看全部|豆包",
)
PLAIN_TITLE = r"(?i)^(?:ChatGPT|Claude|Gemini|Grok|DeepSeek|Doubao|Chat|Conversation|与\s*Gemini\s*对话|New conversation)\z"


def strip_dates(x, raw=None) -> Column:
    """A text without the date text `raw` (where it first stands) and without whatever else looks like a date."""
    y = normalize_whitespace(x)
    if raw is not None:
        cut = lambda z: F.concat(F.substring(z, F.lit(1), F.instr(z, text(raw)) - 1), F.lit(" "), F.substring(z, F.instr(z, text(raw)) + F.length(text(raw)), F.length(z)))
        y = bind(y, lambda z: F.when((text(raw) != "") & (F.instr(z, text(raw)) > 0), cut(z)).otherwise(z))
    for pattern in DATE_WORDS:
        y = F.regexp_replace(y, pattern, " ")
    return y


def clean_title(x, raw=None) -> Column:
    """An entry's text as a title: without dates and words of the surface, at most TITLE_LENGTH characters."""
    y = strip_dates(x, raw)
    for pattern in UI_WORDS:
        y = F.regexp_replace(y, pattern, " ")
    return truncate(trim(F.regexp_replace(y, r"\s+", " ")), TITLE_LENGTH)


def title_quality(x) -> Column:
    """0 for nothing, 1 for a platform's name, else the length, at most TITLE_LENGTH."""
    return bind(normalize_whitespace(x), lambda clean: F.when(clean == "", 0).when(clean.rlike(PLAIN_TITLE), 1).otherwise(F.least(F.length(clean), F.lit(TITLE_LENGTH))))


def best_title(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """keys, title: of each key's candidates (ord, candidate, raw) the one of the highest quality once cleaned; of equals the first; empty if none is left."""
    x = candidates.withColumn("title", clean_title("candidate", "raw"))
    order = F.struct(F.when(F.col("title") != "", title_quality("title")).otherwise(-1).alias("q"), (-F.col("ord")).alias("first"))
    return x.groupBy(*keys).agg(F.coalesce(F.max_by("title", order), F.lit("")).alias("title"))


# ---------------------------------------------------------------- entries of pages


def _words(n: Node) -> str:
    return plain(n.text())


def _leaves(n: Node) -> list[str]:
    """Texts of the visible elements below that hold no others."""
    if not visible(n):
        return []
    below = [c for c in n.elements() if visible(c)]
    if not below:
        return [t] if (t := _words(n)) else []
    return [t for c in below for t in _leaves(c)]


def entries_of(html: str | None, links: set[str], dated) -> tuple[list[dict], list[list[str]]]:
    """Every link to one of the addresses `links`, with the texts that may tell its title and date, and the headings of the sections that it is in.

    dated(text): whether it names a date. A section is an element with several of the links; its short headings are
    read once, and the links hold its number, so that the work grows with the page and not with links times headings.
    """
    tree = parse(html or "")
    every = [n for n in tree.walk() if n.tag == "a" and n.get("href") in links]
    held: dict[int, int] = {}
    for a in every:
        at = a
        while at is not None:
            held[id(at)] = held.get(id(at), 0) + 1
            at = at.parent
    numbers: dict[int, int] = {}
    headings: list[list[str]] = []
    befores: dict[int, dict[int, Node]] = {}
    short = lambda n: w if len(w := _words(n)) <= HEADER_TEXT else ""

    def section(n: Node) -> int:
        if id(n) not in numbers:
            found = [w for c in n.elements() if not held.get(id(c)) and (w := short(c))]
            if id(n.parent) not in befores:
                befores[id(n.parent)] = {id(c): b for b, c in pairwise(n.parent.elements())}
            before = befores[id(n.parent)].get(id(n))
            if before is not None and (w := short(before)):
                found.append(w)
            numbers[id(n)] = len(headings)
            headings.append(found)
        return numbers[id(n)]

    out = []
    for a in every:
        if not visible(a):
            continue
        at, box = a, a
        for _ in range(ENTRY_ANCESTORS):
            if at is None or at.tag == "#root" or held[id(at)] > 1:
                break
            words = _words(at)
            if words and len(words) <= ENTRY_TEXT and (at.tag in ("li", "article", "div") or re.fullmatch("listitem|menuitem|option|row", at.get("role"), re.I) or dated(words)):
                box = at
            at = at.parent
        sections, at = [], a.parent
        for _ in range(HEADER_ANCESTORS):
            if at is None or at.tag == "#root":
                break
            if held[id(at)] > 1 and headings[section(at)]:
                sections.append(section(at))
            at = at.parent
        words = _words(box)
        mine = [a.get("aria-label"), a.get("title"), *_leaves(a), _words(a)]
        if len(words) <= ENTRY_TITLE_TEXT:
            mine += [*_leaves(box), words]
        out.append({"href": a.get("href"), "words": words, "sections": sections, "candidates": [m for m in mine if m], "links": min(held[id(box)], 2)})
    return out, headings


_RAW = "page_url string, hrefs array<string>, html string"
#: An entry, or (without a href) the headings of the section numbered ord.
_ENTRY = "page_url string, ord int, href string, words string, sections array<int>, candidates array<string>, links int, heads array<string>"
_ROWS = 10_000
_DATED = re.compile(
    r"今天|今日|today|昨天|yesterday|前天|(?<![A-Za-z0-9_])(?:20\d{2}[./-]\d{1,2}[./-]\d{1,2}|20\d{2}\s*年\s*\d{1,2}\s*月|[A-Za-z]{3,9}\.?\s+\d{1,2}(?![A-Za-z0-9_])|\d{1,2}\s*月\s*\d{1,2}|\d{1,2}[./-]\d{1,2}(?![A-Za-z0-9_]))", re.I
)


def history_entries(pages: DataFrame, as_of: datetime.date) -> DataFrame:
    """Conversations that pages (url, html) list: page_url, ord, platform, url, conversation_id, title, conversation_time, raw_date.

    One row per conversation and page, the first link to it. The date is the one in the entry's own
    text, else in a short heading of its section.
    """
    from ..functions.html import html_links

    host = F.regexp_extract("url", "^([a-z]+://[^/?#]+)", 1)
    whole = lambda href: F.when(href.startswith("/"), F.concat(host, href)).otherwise(href)
    links = pages.select("url", "html", F.transform(F.transform(html_links("html"), lambda x: x["href"]), lambda h: F.struct(h.alias("href"), whole(h).alias("whole"))).alias("links"))
    listed = links.select(F.col("url").alias("page_url"), F.transform(F.filter("links", lambda x: conversation_url(x["whole"], detect_platform("url")) != ""), lambda x: x["href"]).alias("hrefs"), "html")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            for u, hrefs, html in zip(x["page_url"], x["hrefs"], x["html"], strict=True):
                entries, headings = entries_of(html, set(hrefs), lambda t: bool(_DATED.search(t))) if hrefs is not None and len(hrefs) else ([], [])
                rows = [(u, k, *e.values(), []) for k, e in enumerate(entries)] + [(u, k, None, "", [], [], 0, h) for k, h in enumerate(headings) if h]
                for at in range(0, len(rows), _ROWS):
                    yield pd.DataFrame(rows[at : at + _ROWS], columns=["page_url", "ord", "href", "words", "sections", "candidates", "links", "heads"])

    read = written(listed.mapInPandas(run, _ENTRY), "history")  # once, since entries, dates and titles come from it
    found = read.where("href is not null").drop("heads")
    host = F.regexp_extract("page_url", "^([a-z]+://[^/?#]+)", 1)
    url = conversation_url(F.when(F.col("href").startswith("/"), F.concat(host, F.col("href"))).otherwise(F.col("href")))
    found = found.withColumn("url", url).withColumn("rn", F.row_number().over(W.partitionBy("page_url", "url").orderBy("ord"))).where("rn = 1").drop("rn")
    tell = lambda x: x.withColumn("d", history_date("t", as_of)).where("d.date <> ''").drop("t")
    own = tell(found.select("page_url", "ord", F.lit(-1).alias("k"), F.col("words").alias("t")))
    headed = tell(read.where("href is null").select("page_url", F.col("ord").alias("section"), F.posexplode("heads").alias("k", "t")))
    headed = headed.groupBy("page_url", "section").agg(F.min_by("d", "k").alias("d"))
    above = found.select("page_url", "ord", F.posexplode("sections").alias("k", "section")).join(headed, ["page_url", "section"])
    dates = own.unionByName(above.select("page_url", "ord", "k", "d")).groupBy("page_url", "ord").agg(F.min_by("d", "k").alias("d"))
    found = found.join(dates, ["page_url", "ord"], "left").withColumn("raw_date", F.coalesce("d.raw", F.lit(""))).withColumn("conversation_time", F.coalesce("d.date", F.lit("")))
    titles = best_title(found.select("page_url", "url", "raw_date", F.posexplode("candidates").alias("ord", "candidate")).withColumnRenamed("raw_date", "raw"), ["page_url", "url"])
    out = found.drop("title").join(titles, ["page_url", "url"], "left")
    return out.select("page_url", "ord", platform_label(detect_platform("url")).alias("platform"), "url", last_id_segment("url").alias("conversation_id"), F.coalesce("title", F.lit("")).alias("title"), "conversation_time", "raw_date", F.col("links").alias("n_links"))


def match_search_rows(rows: DataFrame, links: DataFrame) -> DataFrame:
    """rows (page_url, ord, url or empty, title) of a search list with the address that each stands for: its own, else the side bar link (page_url, ord, url, title) of the same place, else the next unused one of equal title.

    Places are claimed first to last; a title's unused links go to its rows in turn. Rows that match nothing are left out.
    """
    key = lambda c: F.lower(normalize_whitespace(c))
    bar = links.select("page_url", F.col("ord").alias("place"), F.col("url").alias("bar_url"), F.col("title").alias("bar_title"))
    by_place = rows.join(bar, (rows["page_url"] == bar["page_url"]) & (rows["ord"] == bar["place"]) & (text(rows["url"]) == ""), "left").select(rows["*"], "bar_url", "bar_title")
    done = by_place.where((text("url") != "") | F.col("bar_url").isNotNull())
    left = by_place.where((text("url") == "") & F.col("bar_url").isNull() & (key("title") != "")).drop("bar_url", "bar_title")
    used = by_place.where(F.col("bar_url").isNotNull()).select("page_url", F.col("ord").alias("place"))
    free = bar.join(used, ["page_url", "place"], "left_anti")
    turn = lambda x, at: x.withColumn("_key", key("title")).withColumn("_turn", F.row_number().over(W.partitionBy("page_url", "_key").orderBy(at)))
    by_title = turn(left, "ord").join(turn(free.withColumn("title", F.col("bar_title")), "place").drop("title", "place"), ["page_url", "_key", "_turn"]).drop("_key", "_turn")
    both = done.unionByName(by_title.select(done.columns))
    return both.withColumn("url", F.when(text("url") != "", F.col("url")).otherwise(F.col("bar_url"))).withColumn("title", F.when(text("title") != "", F.col("title")).otherwise(F.coalesce("bar_title", F.lit("")))).drop("bar_url", "bar_title")


def recent_cached(cache: DataFrame, now: Column, minutes: int | None = RECENT_MINUTES) -> DataFrame:
    """History rows of a time cache (conversation_id, platform, timestamp, title, cached_at) for Gemini, whose list names no dates: entries of the last `minutes`, or all if None."""
    ok = (F.col("platform") == "Gemini") & (text("timestamp") != "") & F.col("conversation_id").rlike(r"^[A-Za-z0-9_-]{8,}\z")
    if minutes is not None:
        ok = ok & F.coalesce(F.col("cached_at") >= now - F.expr(f"INTERVAL {minutes} MINUTES"), F.lit(False))
    return cache.where(ok).select("platform", text("title").alias("title"), F.col("timestamp").alias("conversation_time"), F.lit("").alias("raw_date"), F.concat(F.lit("https://gemini.google.com/app/"), "conversation_id").alias("url"), "conversation_id")


# ---------------------------------------------------------------- a conversation's time

# Elements whose attributes or text may be a document's time, in the order in which they are asked.
TIME_SELECTORS = ("time[datetime]", "[datetime]", "[data-created-at]", "[data-create-time]", "[data-time]", "[data-timestamp]", "meta[property='article:published_time']", "meta[name='date']")
TIME_ATTRIBUTES = ("datetime", "data-created-at", "data-create-time", "data-time", "data-timestamp", "content")
TIME_KEYS = "createdAt|created_at|createTime|create_time|insertedAt|inserted_at|conversationTime|conversation_time|timestamp"
_VALUE = r"""([0-9]{10,13}|[0-9]{4}-[0-9]{2}-[0-9]{2}(?:T[^"'\\\s,}]+)?)"""


def time_candidates(html: str | None) -> list[str]:
    tree = parse(html or "")
    return [x for s in TIME_SELECTORS for n in select(tree, s) for x in [*(n.get(a) for a in TIME_ATTRIBUTES), n.text().strip()] if x]


@F.pandas_udf(T.ArrayType(T.StringType()))
def _time_candidates(html: pd.Series) -> pd.Series:
    return html.map(time_candidates)


def _first_time(candidates: Column, as_of_year: int) -> Column:
    return F.coalesce(F.get(F.filter(F.transform(candidates, lambda c: read_time_candidate(c, as_of_year)), lambda t: t != ""), F.lit(0)), F.lit(""))


def document_time(html, as_of_year: int) -> Column:
    """The first time that a page's elements tell."""
    return _first_time(_time_candidates(html), as_of_year)


def script_time(html, conversation_id, as_of_year: int) -> Column:
    """The time beside a key that says so, else any time, in the first script that names the conversation's id (of 8 characters at least) and has one."""
    scripts = F.filter(F.regexp_extract_all(text(html), F.lit(r"(?is)<script[^>]*>(.*?)</script>"), F.lit(1)), lambda s: F.contains(s, text(conversation_id)))
    keyed = lambda s: F.regexp_extract(s, rf"""(?i)(?:{TIME_KEYS})["']?\s*[:=]\s*["']?{_VALUE}""", 1)
    loose = lambda s: F.regexp_extract(s, rf"""(?i)["']?{_VALUE}["']?\s*[,}}]""", 1)
    found = _first_time(F.flatten(F.transform(scripts, lambda s: F.array(keyed(s), loose(s)))), as_of_year)
    return F.when(F.length(text(conversation_id)) >= 8, found).otherwise(F.lit(""))


def resolve_times(conversations: DataFrame, cache: DataFrame | None = None, messages: DataFrame | None = None, history: DataFrame | None = None, pages: DataFrame | None = None, as_of_year: int = 2026, *, prefer_history: bool = False, history_only: bool = False, document: bool = True, scripts: bool = True) -> DataFrame:
    """conversations (conv_id, conversation_id, source_url, ...) with conversation_time and time_source, from what tells it first.

    In this order: the history entry of its address (only if prefer_history), the time cache
    (conversation_id, timestamp), its earliest message time (conv_id, time), its page's (url, html)
    elements and scripts, the history entry (url, conversation_time). A source that is not given does not count.
    """
    x = conversations.drop("conversation_time", "time_source")
    told: dict[str, Column] = {}
    if history is not None:
        seen = history.where(text("conversation_time") != "").groupBy(F.col("url").alias("_url")).agg(F.min_by("conversation_time", "ord").alias("_history"))
        x = x.withColumn("_address", conversation_url("source_url")).join(seen, (F.col("_address") == F.col("_url")) & (F.col("_address") != ""), "left").drop("_url", "_address")
        told["history"] = text("_history")
    if cache is not None:
        kept = cache.groupBy(F.col("conversation_id").alias("_id")).agg(F.min("timestamp").alias("_cache"))
        x = x.join(kept, F.col("conversation_id") == F.col("_id"), "left").drop("_id")
        told["cache"] = text("_cache")
    if messages is not None:
        first = messages.where(text("time") != "").groupBy(F.col("conv_id").alias("_of")).agg(F.min("time").alias("_messages"))
        x = x.join(first, F.col("conv_id") == F.col("_of"), "left").drop("_of")
        told["messages"] = text("_messages")
    if pages is not None:
        own = pages.groupBy(F.col("url").alias("_page")).agg(F.max("html").alias("_html"))
        x = x.join(own, F.col("source_url") == F.col("_page"), "left").drop("_page")
        if document:
            told["document"] = document_time("_html", as_of_year)
        if scripts:
            told["script"] = script_time("_html", "conversation_id", as_of_year)
    order = ["history"] if history_only else [*(["history"] if prefer_history else []), "cache", "messages", "document", "script", "history"]
    pairs = [F.when(told[k] != "", F.struct(told[k].alias("time"), F.lit(k).alias("source"))) for k in dict.fromkeys(order) if k in told]
    best = F.coalesce(*pairs, F.struct(F.lit("").alias("time"), F.lit("").alias("source")))
    return x.withColumn("_told", best).withColumn("conversation_time", F.col("_told.time")).withColumn("time_source", F.col("_told.source")).drop("_told", "_history", "_cache", "_messages", "_html")


# ---------------------------------------------------------------- a list that shows a part of itself at a time


def capture_virtual_list(shown: DataFrame) -> DataFrame:
    """Messages of conversations from what a virtual list showed (conv_id, at, key, place, role, content, thinking_only): conv_id, seq, role, content.

    The first capture of a key counts, in the order of `at`; rows with only thinking or no content do
    not. A key without one is role and the text's first 160 characters. Each conversation has a state
    of its own, so a change of conversation begins anew. Messages stand by place, then by capture.
    """
    key = F.when(text("key") != "", text("key")).otherwise(F.concat("role", F.lit(":"), F.substring(normalize_whitespace("content"), 1, 160)))
    x = shown.where(~F.coalesce("thinking_only", F.lit(False)) & (text("content") != "")).withColumn("_key", key)
    first = x.withColumn("_rn", F.row_number().over(W.partitionBy("conv_id", "_key").orderBy("at", "content"))).where("_rn = 1")
    order = W.partitionBy("conv_id").orderBy(F.coalesce("place", F.col("at")), "at", "_key")
    return first.select("conv_id", F.row_number().over(order).alias("seq"), "role", "content")
