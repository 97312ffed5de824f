"""Conversations and timestamps in captured JSON and RPC payloads.

A payload's platform picks a Shape: which keys may hold a role, a text, an id, a time. One recursive
walk, shared by all platforms, passes the nearest id, title and time down and emits events. Payloads
stay text until a Python worker parses them; DataFrame filters on url run before.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import is_payload_endpoint


@dataclass(frozen=True)
class Limits:
    """How deep and how wide a payload is searched: in whole, unless a caller says otherwise. What a limit leaves out is told by an event of kind 'skipped'."""

    depth: float = math.inf
    widest: float = math.inf
    lines: float = math.inf


WHOLE = Limits()

# Keys by what they hold, in the order in which they are tried.
TEXT_KEYS = ("text", "markdown", "body", "content", "message", "value", "response", "prompt", "answer", "fragments", "parts", "content_block", "contentBlock", "content_blocks", "contentBlocks", "content_blocks_v2", "contentBlocksV2", "content_obj", "contentObj", "text_block", "textBlock")
STRUCTURED_TEXT_KEYS = ("content", "text", "markdown", "body", "message", "value", "response", "prompt", "answer", "fragments", "parts", "content_block", "contentBlock", "content_blocks", "contentBlocks", "content_blocks_v2", "contentBlocksV2", "content_obj", "contentObj", "text_block", "textBlock", "data")
MESSAGE_CREATED = ("inserted_at", "insertedAt", "created_at", "createdAt", "create_time", "createTime", "server_create_time", "serverCreateTime", "create_timestamp", "createTimestamp", "timestamp", "time", "date")
ID_KEYS = ("uuid", "conversation_uuid", "conversationUuid", "conversation_id", "conversationId", "chat_id", "chatId", "thread_id", "threadId", "id")
TITLE_KEYS = ("title", "name", "summary", "topic", "subject", "conversation_title", "conversationTitle", "chat_title", "chatTitle")
WRAPPERS = ("message", "msg", "chat_message", "chatMessage", "message_info", "messageInfo", "message_detail", "messageDetail", "payload", "item", "entity")
SESSIONS = ("chat_session", "chatSession", "session", "conversation")
REASONING_MARK = re.compile(r"(?:^|[\s_-])(?:think|thinking|reasoning|cot|chain-of-thought)(?:[\s_-]|$)|模型思考|思考过程|深度思考", re.I)


@dataclass(frozen=True)
class Shape:
    """Keys of one platform's payloads. strict_time: message times are the only source of a conversation's time."""

    label: str
    role_keys: tuple[str, ...] = ("author", "sender", "sender_type", "from", "role", "type", "creator")
    text_keys: tuple[str, ...] = ("content", "text", "markdown", "body", "message", "value", "response", "prompt", "answer")
    id_keys: tuple[str, ...] = ID_KEYS
    message_time: tuple[str, ...] = ("created_at", "createdAt", "create_time", "createTime", "timestamp", "time", "date", "updated_at", "updatedAt", "update_time", "updateTime")
    conversation_time: tuple[str, ...] = ("created_at", "createdAt", "create_time", "createTime", "conversation_time", "conversationTime", "inserted_at", "insertedAt", "timestamp", "updated_at", "updatedAt")
    roles: tuple[tuple[str, str], ...] = ()
    any_text: bool = False  # the first key that gives text counts, not the first that is there
    wrapped: bool = False
    sessions: bool = False
    own_ids: bool = False  # a list of messages may carry the id itself
    strict_time: bool = False
    first_time: bool = True  # of messages the first time, else the smallest


_GROK_TEXT = ("message", "text", "markdown", "content", "body", "value", "response", "prompt", "answer", "parts", "fragments", "content_block", "contentBlock")
_GROK_TIME = ("createTime", "createdAt", "created_at", "create_time", "insertedAt", "inserted_at", "conversationTime", "conversation_time", "timestamp", "time", "date")
SHAPES = {
    "chatgpt": Shape("ChatGPT"),
    "claude": Shape("Claude"),
    "gemini": Shape("Gemini"),
    "grok": Shape(
        "Grok",
        role_keys=("sender", "role", "author", "from", "creator", "type"),
        text_keys=_GROK_TEXT,
        id_keys=("conversationId", "conversation_id", "chatId", "chat_id", "threadId", "thread_id", "id"),
        message_time=_GROK_TIME,
        conversation_time=_GROK_TIME,
        roles=((r"^(human|user|client|customer|prompt)$", "user"), (r"^(assistant|model|bot|grok|ai)$", "assistant"), (r"^system$", "system")),
        any_text=True,
        own_ids=True,
        first_time=False,
    ),
    "deepseek": Shape(
        "DeepSeek",
        role_keys=("role", "sender", "sender_type", "senderType", "from", "author", "type", "creator"),
        text_keys=STRUCTURED_TEXT_KEYS,
        message_time=MESSAGE_CREATED,
        conversation_time=("created_at", "createdAt", "create_time", "createTime", "inserted_at", "insertedAt", "conversation_time", "conversationTime", "date_created", "dateCreated", "creation_time", "creationTime", "born_at", "bornAt"),
        any_text=True,
        sessions=True,
        own_ids=True,
        first_time=False,
    ),
    "doubao": Shape(
        "Doubao",
        role_keys=("user_type", "userType", "sender_type", "senderType", "role", "sender", "from", "author", "type", "creator"),
        text_keys=STRUCTURED_TEXT_KEYS,
        id_keys=("conversation_id", "conversationId", "local_conversation_id", "localConversationId", "section_id", "sectionId", "chat_id", "chatId", "thread_id", "threadId", "id"),
        message_time=MESSAGE_CREATED,
        conversation_time=(),
        roles=((r"^1$", "user"), (r"^2$", "assistant"), (r"^3$", "system"), (r"human|user|customer|prompt", "user"), (r"aibot|assistant|bot|doubao|model|ai", "assistant"), (r"system", "system")),
        any_text=True,
        wrapped=True,
        own_ids=True,
        strict_time=True,
        first_time=False,
    ),
}
# Words anywhere in a role's name that tell it; user first.
ROLE_WORDS = (("user|human|you|client|customer|prompt", "user"), ("assistant|model|bot|claude|gemini|grok|deepseek|doubao|chatgpt|ai", "assistant"), ("system", "system"))
# Key forms of the walk over payloads without a known structure.
GENERIC_TIME = re.compile(r"^(created[_-]?at|create[_-]?time|updated[_-]?at|update[_-]?time|inserted[_-]?at|timestamp|start[_-]?time|conversation[_-]?time|date[_-]?created|creation[_-]?time|born[_-]?at)$", re.I)
GENERIC_ID = re.compile(r"^(id|conversation[_-]?id|chat[_-]?id|uuid|thread[_-]?id|convo[_-]?id)$", re.I)
GENERIC_TITLE = re.compile(r"^(title|name|summary|topic|subject|conversation[_-]?title|chat[_-]?title|display[_-]?name)$", re.I)
GENERIC_UPDATED = re.compile(r"^(updated[_-]?at|update[_-]?time|modified[_-]?at|last[_-]?modified|last[_-]?updated|last[_-]?message[_-]?at)$", re.I)
_ISO = re.compile(r"\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2})?(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?)?", re.A)


def first_value(x, keys):
    """The value of the first key that is there and not null, even an empty string; else empty."""
    return next((x[k] for k in keys if x.get(k) is not None), "") if isinstance(x, dict) else ""


def iso(ms: float) -> str:
    try:
        d = datetime.fromtimestamp(math.floor(ms) / 1000, UTC)
    except (OverflowError, ValueError, OSError):
        return ""
    return d.strftime("%Y-%m-%dT%H:%M:%S.") + f"{d.microsecond // 1000:03d}Z"


def timestamp(x, as_of_year: int) -> str:
    """A plausible time as ISO with milliseconds, else empty."""
    s = "" if x is None or isinstance(x, (dict, list, bool)) else (str(int(x)) if isinstance(x, float) and x.is_integer() else str(x)).strip()
    out = ""
    if re.fullmatch(r"[0-9]+(\.[0-9]+)?", s):
        v = float(s)
        out = iso(v / 1000 if v > 1e15 else v if v > 1e12 else v * 1000) if v > 1e9 else ""
    elif m := _ISO.search(s):
        try:
            d = datetime.fromisoformat(m[0])
            d = d.replace(tzinfo=UTC) if d.tzinfo is None else d.astimezone(UTC)
            out = d.strftime("%Y-%m-%dT%H:%M:%S.") + f"{d.microsecond // 1000:03d}Z"
        except ValueError:
            out = ""
    return out if out and 2020 <= int(out[:4]) <= as_of_year + 1 else ""


def json_in_string(x):
    if isinstance(x, str) and x.strip()[:1] in ("{", "["):
        try:
            return json.loads(x)
        except (ValueError, RecursionError):
            return None
    return None


def is_reasoning(x: dict) -> bool:
    mark = " ".join(str(x[k]) for k in ("type", "content_type", "contentType", "role", "name", "kind", "channel", "fragment_type", "block_type") if isinstance(x.get(k), (str, int)))
    return bool(mark and REASONING_MARK.search(mark))


def text_of(x, depth: int = 0, parse: bool = False) -> str:
    """Text of a content value: lists by paragraphs, objects by the first text key that is there, without reasoning."""
    if x is None or isinstance(x, bool):
        return ""
    if parse and (inner := json_in_string(x)) is not None:
        return text_of(inner, depth + 1, True)
    if isinstance(x, (str, int, float)):
        return str(x).strip()
    if isinstance(x, list):
        return "\n\n".join(t for item in x if (t := text_of(item, depth + 1, parse))).strip()
    if is_reasoning(x):
        return ""
    content = x.get("content")
    if isinstance(content, dict) and content.get("parts"):
        return text_of(content["parts"], depth + 1, parse)
    if x.get("parts"):
        return text_of(x["parts"], depth + 1, parse)
    direct = first_value(x, TEXT_KEYS)
    return text_of(direct, depth + 1, parse) if direct != "" else ""


def role_of(x, shape: Shape) -> str:
    for patterns in (shape.roles if not isinstance(x, (dict, list)) else (), ROLE_WORDS):
        value = x if isinstance(x, str) else next((x[k] for k in ("role", "type", "name", "id") if x.get(k)), "") if isinstance(x, dict) else x if patterns is shape.roles else ""
        low = str(value if value is not None else "").lower()
        if found := next((role for pattern, role in patterns if low and re.search(pattern, low)), ""):
            return found
    return ""


def content_of(x: dict, shape: Shape) -> str:
    if not shape.any_text:
        return text_of(first_value(x, shape.text_keys))
    return next((t for k in shape.text_keys if x.get(k) is not None and (t := text_of(x[k], 0, True))), "")


class Scanner:
    """One payload's walk."""

    def __init__(self, platform: str, as_of_year: int, limits: Limits = WHOLE):
        self.shape, self.year, self.limits, self.events = SHAPES[platform], as_of_year, limits, []

    def over(self, x, depth: int) -> bool:
        """Whether a limit stops the walk here."""
        stops = depth > self.limits.depth or (isinstance(x, list) and len(x) > self.limits.widest)
        if stops:
            self.skipped()
        return stops

    def skipped(self) -> None:
        if not any(e["kind"] == "skipped" for e in self.events):
            self.events.append({"kind": "skipped", "conversation_id": "", "title": "", "time": "", "updated_at": "", "messages": []})

    def time(self, x, keys) -> str:
        return timestamp(first_value(x, keys), self.year)

    def id(self, x) -> str:
        v = first_value(x, self.shape.id_keys)
        return str(v) if isinstance(v, (str, int, float)) and not isinstance(v, bool) else ""

    def title(self, x) -> str:
        v = first_value(x, TITLE_KEYS)
        return v if isinstance(v, str) else ""

    def say_time(self, conversation_id, time, title="", updated=""):
        if conversation_id and time:
            self.events.append({"kind": "timestamp", "conversation_id": str(conversation_id), "title": title or "", "time": time, "updated_at": updated, "messages": []})

    def say(self, conversation_id, title, time, messages):
        self.events.append({"kind": "conversation", "conversation_id": conversation_id, "title": title, "time": time, "updated_at": "", "messages": messages})

    def like_message(self, x: dict) -> bool:
        direct = any(text_of(v, 0, True) for k in self.shape.text_keys if (v := x.get(k)) is not None and not (isinstance(v, dict) and k in (*WRAPPERS, "data")))
        return first_value(x, self.shape.role_keys[:8]) != "" or direct or self.time(x, self.shape.message_time) != ""

    def unwrap(self, x, depth: int = 0):
        if not isinstance(x, dict) or self.like_message(x):
            return x
        for k in WRAPPERS:
            if isinstance(x.get(k), dict) and self.like_message(inner := self.unwrap(x[k], depth + 1)):
                return inner
        return x

    def message(self, x) -> dict | None:
        if self.shape.wrapped:
            x = self.unwrap(x)
        if not isinstance(x, dict):
            return None
        role = role_of(first_value(x, self.shape.role_keys), self.shape) or (role_of(x.get("role") or "", self.shape) if not self.shape.any_text else "")
        content = content_of(x, self.shape)
        return {"role": role, "content": content, "time": self.time(x, self.shape.message_time)} if role and content else None

    def list_time(self, messages) -> str:
        times = [m["time"] for m in messages if m["time"]]
        return (times[0] if self.shape.first_time else min(times)) if times else ""

    def scan(self, x, known: dict, depth: int = 0) -> None:
        if not isinstance(x, (dict, list)) or self.over(x, depth):
            return
        if isinstance(x, list):
            messages = [m for item in x if (m := self.message(item))]
            if len(messages) >= 2 and {"user", "assistant"} <= {m["role"] for m in messages}:
                conversation = known.get("id") or (next((i for item in x if (i := self.id(self.unwrap(item) if self.shape.wrapped else item))), "") if self.shape.own_ids else "")
                if conversation:
                    inner = self.list_time(messages)
                    time = inner if self.shape.strict_time else known.get("time") or inner
                    if self.shape.own_ids:
                        self.say_time(conversation, time, known.get("title"))
                    self.say(conversation, known.get("title", ""), time, messages)
            for item in x:
                self.scan(item, known, depth + 1)
            return
        if self.shape.sessions and isinstance(session := next((x[k] for k in SESSIONS if x.get(k)), None), dict):
            known = self._known(session, known)
        known = self._known(x, known)
        if not self.shape.strict_time:
            self.say_time(known["id"], known["time"], known["title"])
        for child in x.values():
            self.scan(child, known, depth + 1)

    def _known(self, x: dict, known: dict) -> dict:
        return {"id": self.id(x) or known.get("id", ""), "title": self.title(x) or known.get("title", ""), "time": self.time(x, self.shape.conversation_time) or known.get("time", "")}

    def generic(self, x, depth: int = 0) -> None:
        """Objects that hold an id and a time of any spelling."""
        if not isinstance(x, (dict, list)) or self.over(x, depth):
            return
        items = list(x.items()) if isinstance(x, dict) else []
        plain = [(k, v) for k, v in items if isinstance(v, (str, int, float)) and not isinstance(v, bool)]
        pick = lambda form, of: next((r for k, v in plain if form.match(k) and (r := of(v))), "")
        time = lambda v: timestamp(v, self.year)
        self.say_time(pick(GENERIC_ID, str), pick(GENERIC_TIME, time), pick(GENERIC_TITLE, lambda v: v if isinstance(v, str) else ""), pick(GENERIC_UPDATED, time))
        for child in x.values() if isinstance(x, dict) else x:
            self.generic(child, depth + 1)

    def listed(self, x, time_keys: tuple[str, ...], id_key: str, title_keys: tuple[str, ...], holders: tuple[str, ...]) -> None:
        """A conversation's own record, or a list of them, under one of the holders."""
        for item in x if isinstance(x, list) else [x]:
            if not isinstance(item, dict):
                continue
            if item.get(id_key) and (when := next((item[k] for k in time_keys if item.get(k)), None)):
                self.say_time(item[id_key], timestamp(when, self.year), next((item[k] for k in title_keys if item.get(k)), ""), timestamp(item.get(time_keys[-1]), self.year))
            nested = next((item[k] for k in holders if item.get(k)), None)
            if isinstance(nested, list):
                self.listed(nested, time_keys, id_key, title_keys, holders)

    def gemini_turns(self, x, out: list, depth: int = 0) -> None:
        if not isinstance(x, list) or self.over(x, depth):
            return
        if turn := self.gemini_turn(x):
            out.append(turn)
            return
        for item in x:
            self.gemini_turns(item, out, depth + 1)

    def gemini_turn(self, x: list) -> dict | None:
        if len(x) < 5:
            return None
        conversation = next((i for k in (0, 1) if isinstance(x[k], list) and x[k] and (i := gemini_id(x[k][0]))), "")
        time = self.pair(x[4])
        asked = x[2][0][0].strip() if isinstance(x[2], list) and x[2] and isinstance(x[2][0], list) and x[2][0] and isinstance(x[2][0][0], str) else ""
        answers: list[str] = []
        _answers(x[3], answers)
        answer = "\n\n".join(a for a in answers if a).strip()
        return {"id": conversation, "time": time, "user": asked, "assistant": answer} if conversation and time and (asked or answer) else None

    def pair(self, x) -> str:
        if not isinstance(x, list) or not x or isinstance(x[0], bool) or not isinstance(x[0], (int, float)):
            return ""
        nanos = x[1] if len(x) > 1 and isinstance(x[1], (int, float)) else 0
        return timestamp(round(x[0] * 1000 + nanos / 1e6), self.year) if 1e9 <= x[0] <= 3e9 and 0 <= nanos < 1e9 else ""

    def gemini_history(self, x, depth: int = 0) -> None:
        if not isinstance(x, list) or self.over(x, depth):
            return
        if len(x) > 5 and (conversation := gemini_id(x[0])) and (time := self.pair(x[5])):
            self.say_time(conversation, time, x[1] if isinstance(x[1], str) else "")
        for item in x:
            self.gemini_history(item, depth + 1)

    def gemini_text(self, body: str) -> None:
        """The RPC's text form: a guard line, then lines of JSON whose envelopes hold JSON again."""
        clean = re.sub(r"^\)\]\}'\s*\n?", "", body)
        turns: list[dict] = []
        for k, line in enumerate(clean.split("\n")):
            if k >= self.limits.lines:
                self.skipped()
                break
            data = json_in_string(line.strip())
            if data is None:
                continue
            envelopes = [e for e in (data if isinstance(data, list) else []) if isinstance(e, list) and len(e) > 2 and e[0] == "wrb.fr"]
            for inner in [json_in_string(e[2]) for e in envelopes] + [data]:
                self.gemini_turns(inner, turns)
                self.gemini_history(inner)
            self.scan(data, {})
            if isinstance(data, dict):
                self.generic(data)
        by_id: dict[str, list[dict]] = {}
        for turn in turns:
            by_id.setdefault(turn["id"], []).append(turn)
        for conversation, own in by_id.items():
            own.sort(key=lambda t: t["time"])
            messages = [{"role": role, "content": t[role], "time": t["time"]} for t in own for role in ("user", "assistant") if t[role]]
            self.say_time(conversation, own[0]["time"])
            self.say(conversation, "", own[0]["time"], messages)

    def chatgpt_graph(self, x) -> None:
        """A conversation as a graph: the path from the root to the current node."""
        mapping = x.get("mapping") if isinstance(x, dict) else None
        if not isinstance(mapping, dict) or not x.get("id"):
            return
        times = [t for n in mapping.values() if isinstance(n, dict) and isinstance(n.get("message"), dict) and (t := self.time(n["message"], ("create_time", "update_time")))]
        if times:
            self.say_time(x["id"], min(times), x.get("title") or "", timestamp(x.get("update_time"), self.year))
        path = graph_path(mapping, x.get("current_node"))
        messages = graph_messages(path, self.year)
        if messages:
            time = timestamp(x.get("create_time") or x.get("update_time"), self.year) or next((m["time"] for m in messages if m["time"]), "")
            self.say(str(x["id"]), x.get("title") or "", time, messages)


def gemini_id(x) -> str:
    m = re.fullmatch(r"(?:c_)?([a-f0-9]{8,})", x.strip(), re.I) if isinstance(x, str) else None
    return m[1] if m else ""


def _answers(x, out: list) -> None:
    if not isinstance(x, list):
        return
    if len(x) > 1 and isinstance(x[0], str) and x[0][:3].lower() == "rc_" and isinstance(x[1], list) and x[1] and isinstance(x[1][0], str):
        out.append(x[1][0])
        return
    for item in x:
        _answers(item, out)


def graph_path(mapping: dict, start: str | None) -> list[dict]:
    """Nodes from the root to start, by parents; a node without a parent key ends the walk and is left out, a null parent is a root."""
    at = start or next((n.get("id") for n in mapping.values() if isinstance(n, dict) and not n.get("children")), None)
    out, seen = [], set()
    while at and isinstance(node := mapping.get(at), dict) and at not in seen and "parent" in node:
        seen.add(at)
        out.append(node)
        at = node["parent"]
    return out[::-1]


def graph_messages(path: list[dict], as_of_year: int) -> list[dict]:
    kept: list[dict] = []
    for node in path:
        m = node.get("message")
        content = m.get("content") if isinstance(m, dict) else None
        role = (m.get("author") or {}).get("role") if isinstance(m, dict) else None
        if not role or role == "system" or not isinstance(content, dict) or content.get("content_type") in ("model_editable_context", "user_editable_context"):
            continue
        parts = content.get("parts")
        joinable = role == "assistant" and m.get("recipient") == "all" and content.get("content_type") == "text" and isinstance(parts, list)
        if joinable and kept and kept[-1]["joinable"]:
            old = kept[-1]["parts"]
            glued = f"{old[-1] if old else ''}{parts[0] if parts else ''}"
            kept[-1]["parts"] = [*old[:-1], glued, *parts[1:]]
            continue
        kept.append({"joinable": joinable, "role": role, "recipient": m.get("recipient"), "parts": list(parts) if isinstance(parts, list) else None, "content": content, "time": timestamp(m.get("create_time") or m.get("update_time"), as_of_year)})
    out = []
    for k in kept:
        said = "\n\n".join(p for x in k["parts"] if (p := _part(x))).strip() if k["parts"] is not None else next((k["content"][f].strip() for f in ("text", "result") if isinstance(k["content"].get(f), str)), "")
        if said and k["role"] in ("user", "assistant") and k["recipient"] in (None, "", "all"):
            out.append({"role": k["role"], "content": said, "time": k["time"]})
    return out


def _part(x) -> str:
    if isinstance(x, str):
        return x
    if not isinstance(x, dict):
        return ""
    if isinstance(x.get("text"), str):
        return x["text"]
    pointer = x.get("asset_pointer")
    return (f"[image: {pointer}]" if pointer else "[image]") if x.get("content_type") == "image_asset_pointer" else ""


def grok_id(url: str | None) -> str:
    m = re.search(r"/(?:c|chat|rest/app-chat/conversations)/([A-Za-z0-9-]{8,})", url or "", re.I)
    return m[1] if m else ""


def grok_responses(data) -> list:
    """Complete responses of a payload, by time."""
    holders = [data, data.get("data"), data.get("conversation")] if isinstance(data, dict) else []
    found = next((h["responses"] for h in holders if isinstance(h, dict) and isinstance(h.get("responses"), list)), [])
    return [r for r in found if isinstance(r, dict) and not r.get("partial")]


def scan_payload(platform: str | None, url: str | None, body: str | None, as_of_year: int, limits: Limits = WHOLE) -> list[dict]:
    """Events of one payload; none for other platforms or broken bodies. What is nested deeper than Python's stack is skipped, and told so."""
    if platform not in SHAPES or not body:
        return []
    s = Scanner(platform, as_of_year, limits)
    try:
        _scan_all(s, platform, url, body)
    except RecursionError:
        s.skipped()
    return s.events


def _scan_all(s: Scanner, platform: str, url: str | None, body: str) -> None:
    data = json_in_string(body)
    if platform == "gemini" and not isinstance(data, dict):
        s.gemini_text(body)
    if data is None:
        return
    if platform == "chatgpt":
        s.listed(data, ("create_time", "update_time"), "id", ("title",), ("items", "conversations", "data", "results"))
        s.chatgpt_graph(data)
        s.generic(data)
    elif platform == "claude":
        s.listed(data, ("created_at", "updated_at"), "uuid", ("name", "title"), ("conversations", "items", "data", "results", "chats"))
        s.scan(data, {})
        s.generic(data)
    elif platform == "grok":
        if responses := grok_responses(data):
            data = {**data, "responses": sorted(responses, key=lambda r: s.time(r, s.shape.message_time))}
        s.scan(data, {"id": grok_id(url)})
    elif platform in ("deepseek", "doubao"):
        s.scan(data, {})
    elif isinstance(data, dict):
        s.scan(data, {})
        s.generic(data)


_EVENT = "kind string, conversation_id string, title string, time string, updated_at string, messages array<struct<role: string, content: string, time: string>>"


def scan_payloads(payloads: DataFrame, as_of_year: int, limits: Limits = WHOLE) -> DataFrame:
    """Events of payloads (url, body, ...): url, platform and the event's fields. Other addresses are filtered before any parsing."""
    routed = payloads.withColumn("platform", is_payload_endpoint("url")).where("platform is not null and body is not null").select("url", "platform", "body")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [{"url": u, "platform": SHAPES[p].label, **e} for u, p, b in zip(frame["url"], frame["platform"], frame["body"], strict=True) for e in scan_payload(p, u, b, as_of_year, limits)]
            yield pd.DataFrame(rows, columns=["url", "platform", "kind", "conversation_id", "title", "time", "updated_at", "messages"])

    return routed.mapInPandas(run, f"url string, platform string, {_EVENT}")


def page_payloads(pages: DataFrame) -> DataFrame:
    """(url, body) of the JSON that pages (url, html) carry in themselves: state scripts and data callbacks."""
    state = F.regexp_extract_all("html", F.lit(r'(?s)<script[^>]*id="__NEXT_DATA__"[^>]*>(.*?)</script>'), F.lit(1))
    calls = F.regexp_extract_all("html", F.lit(r"(?s)AF_initDataCallback\(\{.*?data:\s*(\[.*?\])\s*,?\s*(?:sideChannel:\s*\{\s*\})?\s*\}\);?"), F.lit(1))
    return pages.select("url", F.explode(F.concat(state, calls)).alias("body")).where("try_parse_json(body) is not null")


def evidence_pairs(hits: DataFrame, times: DataFrame, reach: int = 12_000, keep: int = 12) -> DataFrame:
    """The `keep` timestamps nearest to each id's hits: hits (doc, id, pos), times (doc, ts, pos) at most reach apart.

    Positions are bucketed by reach, so that the band is an equi-join of neighbouring buckets.
    """
    from pyspark.sql import Window as W

    a = hits.withColumn("b", F.explode(F.array(*(F.floor(F.col("pos") / reach) + k for k in (-1, 0, 1)))))
    b = times.select("doc", "ts", F.col("pos").alias("at"), F.floor(F.col("pos") / reach).alias("b"))
    near = a.join(b, ["doc", "b"]).withColumn("distance", F.abs(F.col("pos") - F.col("at"))).where(F.col("distance") <= reach)
    near = near.select("doc", "id", "ts", "distance").distinct()
    rank = F.row_number().over(W.partitionBy("doc", "id").orderBy("distance", "ts"))
    return near.withColumn("rank", rank).where(F.col("rank") <= keep)
