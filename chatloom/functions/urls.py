"""Platforms, conversation addresses and identity keys on columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import nfkc, normalize_whitespace, sub, text

# Platform ids and their labels.
PLATFORM_LABELS = {"chatgpt": "ChatGPT", "claude": "Claude", "gemini": "Gemini", "grok": "Grok", "deepseek": "DeepSeek", "doubao": "Doubao"}
# Hosts of each platform; a host that begins with a dot stands for all below it.
HOSTS = {
    "chatgpt": ("chatgpt.com", "chat.openai.com"),
    "claude": ("claude.ai", ".claude.ai"),
    "gemini": ("gemini.google.com",),
    "grok": ("grok.com", ".grok.com", "grok.x.ai"),
    "deepseek": ("deepseek.com", ".deepseek.com"),
    "doubao": ("doubao.com", ".doubao.com"),
}
SHARED_HOST, SHARED_PATH = "x.com", "/i/grok"
# Paths that are conversations.
CONVERSATION_PATHS = {
    "chatgpt": ("^/c/[^/]+", "^/g/[A-Za-z0-9_-]+/c/[^/]+"),
    "claude": ("/chat/[^/]+",),
    "gemini": ("^/app/[^/]+",),
    "grok": ("^/chat/[^/]+", "^/c/[^/]+"),
    "deepseek": ("^/a/chat/s/[^/]+", "^/chat/[^/]+", "^/c/[^/]+"),
    "doubao": ("^/chat/[^/]+", "^/conversation/[^/]+", "^/bot/chat/[^/]+"),
}
# Where each platform's address holds the conversation's id.
ID_PATHS = {
    "chatgpt": "/c/([A-Za-z0-9-]+)",
    "claude": "/chat/([A-Za-z0-9_-]+)",
    "gemini": "/app/(?:c_)?([A-Za-z0-9_-]+)",
    "grok": "/(?:chat|c|conversation)/([A-Za-z0-9_-]+)",
    "deepseek": "/(?:a/chat/s|chat/s|chat|c|s)/([A-Za-z0-9_-]+)",
    "doubao": "/(?:bot/chat|chat|conversation|thread)/([A-Za-z0-9_-]+)",
}
ID_PARAMETERS = ("conversation_id", "conversationId", "chat_session_id", "chat_id")
# Addresses that serve conversation payloads, by platform.
_GENERIC_ENDPOINT = r"(?i)^(?=.*/(?:api|rest|web-api|samantha|alice|bot|conversation|chat|im|agent)/).*(?:conversation|chat|history|message|thread|session|chain|samantha|alice|bot)"
ENDPOINTS = {
    "chatgpt": r"(?i)/backend-api/conversations?(?:/|[?]|$)|/backend-api/gizmos/[^/]+/conversations(?:[?]|$)",
    "claude": r"(?i)/api/organizations/[^/]+/chat_conversations",
    "gemini": r"(?i)batchexecute|/data/|BardChat",
    "grok": r"(?i)/(?:rest|api)/.*(?:conversation|chat|history|thread)|/c/[a-f0-9-]{30,}",
    "deepseek": _GENERIC_ENDPOINT,
    "doubao": _GENERIC_ENDPOINT,
}


def _url(x) -> Column:
    return text(x)


def host(x) -> Column:
    return F.lower(F.try_parse_url(_url(x), F.lit("HOST")))


def path(x) -> Column:
    return F.coalesce(F.try_parse_url(_url(x), F.lit("PATH")), F.lit(""))


def _on(h: Column, hosts) -> Column:
    return reduce(lambda a, b: a | b, [h.endswith(one) if one.startswith(".") else h == one for one in hosts])


def detect_platform(url, strict: bool = True) -> Column:
    """Platform id of an address or null. The shared host counts only below its path; loosely, always."""
    h = host(url)
    out = F.when(F.lit(False), F.lit(""))
    for platform, hosts in HOSTS.items():
        hit = _on(h, hosts)
        if platform == "grok":
            shared = h == SHARED_HOST
            hit = hit | (shared & F.lower(path(url)).startswith(SHARED_PATH) if strict else shared)
        out = out.when(hit, F.lit(platform))
    return out


def platform_label(platform: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for pair in PLATFORM_LABELS.items() for x in pair))[platform], F.lit(""))


def without_query(url) -> Column:
    """scheme://host/path, with host in lower case and without one trailing slash; empty if the address is no good."""
    scheme = F.lower(F.try_parse_url(_url(url), F.lit("PROTOCOL")))
    authority = F.lower(F.try_parse_url(_url(url), F.lit("AUTHORITY")))
    return F.coalesce(sub(F.concat(scheme, F.lit("://"), authority, path(url)), r"/\z"), F.lit(""))


def conversation_url(url, platform: Column | None = None) -> Column:
    """The canonical address of a conversation; empty for any other address, or one of another platform."""
    found = detect_platform(url)
    ok = F.lit(False)
    for one, patterns in CONVERSATION_PATHS.items():
        ok = ok | ((found == one) & path(url).rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns)))
    if platform is not None:
        ok = ok & ((text(platform) == "") | (found == platform))
    return F.when(ok, without_query(url)).otherwise(F.lit(""))


def last_id_segment(url) -> Column:
    """The last part of the path that holds eight id characters in a row."""
    parts = F.filter(F.split(path(url), "/"), lambda p: p.rlike("[A-Za-z0-9_-]{8,}"))
    return F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))


def conversation_id(url, platform: Column | None = None) -> Column:
    """The id that the platform's own address form holds: by query for some, then by path, then the last id part."""
    found = detect_platform(url) if platform is None else platform
    query = F.coalesce(*(F.nullif(F.try_parse_url(_url(url), F.lit("QUERY"), F.lit(k)), F.lit("")) for k in ID_PARAMETERS), F.lit(""))
    by_path = F.when(F.lit(False), F.lit(""))
    for one, pattern in ID_PATHS.items():
        by_path = by_path.when(found == one, F.regexp_extract(path(url), f"(?i){pattern}", 1))
    by_path = F.coalesce(by_path, F.lit(""))
    return F.when(found.isin("deepseek", "doubao") & (query != ""), query).when(by_path != "", by_path).otherwise(last_id_segment(url))


def gemini_id(x) -> Column:
    return F.regexp_extract(text(x), r"^(?:c_)?([a-fA-F0-9]{8,})\z", 1)


def is_payload_endpoint(url) -> Column:
    """Platform whose conversation payloads this address serves, or null."""
    out = F.when(F.lit(False), F.lit(""))
    for one, pattern in ENDPOINTS.items():
        out = out.when((detect_platform(url) == one) & _url(url).rlike(pattern), F.lit(one))
    return out


def _key(x) -> Column:
    return F.lower(nfkc(normalize_whitespace(x)))


def identity_key(platform, conversation) -> Column:
    a, b = _key(platform), _key(conversation)
    return F.when((a != "") & (b != ""), F.concat(a, F.lit(":"), b)).otherwise(F.lit(""))


def source_url_key(platform, url) -> Column:
    label = platform_label(detect_platform(url, strict=False))
    a = _key(F.when(text(platform) != "", text(platform)).otherwise(F.coalesce(label, F.lit(""))))
    b = F.lower(nfkc(without_query(url)))
    return F.when((a != "") & (b != ""), F.concat(a, F.lit(":"), b)).otherwise(F.lit(""))


def registry_key(platform, conversation, url) -> Column:
    """Unlike the others, as it stands."""
    own = F.when(text(conversation) != "", text(conversation)).otherwise(text(url))
    return F.when((text(platform) != "") & (own != ""), F.concat(text(platform), F.lit(":"), own)).otherwise(F.lit(""))


def discovered_key(platform, conversation, url) -> Column:
    own = F.when(text(conversation) != "", text(conversation)).otherwise(last_id_segment(url))
    name = F.coalesce(detect_platform(url), F.lower(text(platform)))
    return F.when((name != "") & (own != ""), F.concat(name, F.lit(":"), F.lower(nfkc(own)))).otherwise(text(url))


def rpc_id(url) -> Column:
    """The RPC that a Gemini address names, or nothing."""
    return F.coalesce(F.try_parse_url(_url(url), F.lit("QUERY"), F.lit("rpcids")), F.lit(""))


def safe_rpc_label(url) -> Column:
    """A Gemini address as scheme, host and path, with the RPC's name and form but no other parameter; an address that is none as its first 240 characters."""
    rt = F.coalesce(F.try_parse_url(_url(url), F.lit("QUERY"), F.lit("rt")), F.lit(""))
    scheme, authority = (F.lower(F.try_parse_url(_url(url), F.lit(part))) for part in ("PROTOCOL", "AUTHORITY"))
    named = [F.when(v != "", F.concat(F.lit(f"{k}="), v)) for k, v in (("rpcids", rpc_id(url)), ("rt", rt))]
    query = F.concat_ws("&", *named)
    whole = F.concat(scheme, F.lit("://"), authority, F.when(path(url) == "", F.lit("/")).otherwise(path(url)), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))
    return F.coalesce(whole, F.substring(_url(url), 1, 240))
