"""Conversations in saved chat pages: adapters say where messages stand, one reader extracts them.

An Adapter is a declaration; register_adapter() adds one. Pages are parsed once, in Python workers.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame

from ..functions.html import Node, Renderer, normalize_whitespace, parse
from ..functions.urls import PLATFORM_LABELS, detect_platform, last_id_segment

# ---------------------------------------------------------------- selectors: tag, #id, .class, [attr], descendants, lists


@lru_cache(maxsize=4096)
def _compiled(selector: str) -> tuple:
    """Alternatives; each a list of compounds, the last being the element's own."""
    out = []
    for one in _split(selector, ","):
        out.append([[_simple(x) for x in re.findall(r"\[[^\]]*\]|[.#]?[A-Za-z0-9_*-]+", part)] for part in _split(one, " ")])
    return tuple(out)


def _split(x: str, by: str) -> list[str]:
    return [p.strip() for p in re.split(rf"{re.escape(by)}(?![^\[]*\])", x) if p.strip()]


def _simple(x: str) -> tuple:
    if x[0] == ".":
        return ("class", x[1:])
    if x[0] == "#":
        return ("is", "id", x[1:], False)
    if x[0] == "[":
        m = re.fullmatch(r"\[\s*([\w-]+)\s*(?:([*^$~]?)=\s*[\"']?(.*?)[\"']?\s*(i)?\s*)?\]", x)
        if not m:
            raise ValueError(f"selector part {x!r}")
        return ("has", m[1]) if m[3] is None else ({"": "is", "*": "part", "^": "head", "$": "tail", "~": "word"}[m[2]], m[1], m[3], bool(m[4]))
    return ("tag", x.lower())


def _holds(n: Node, part: tuple) -> bool:
    if part[0] == "tag":
        return part[1] in ("*", n.tag)
    if part[0] == "class":
        return part[1] in n.get("class").split()
    if part[0] == "has":
        return part[1] in n.attrs
    kind, name, want, fold = part
    if name not in n.attrs:
        return False
    got = n.get(name)
    got, want = (got.lower(), want.lower()) if fold else (got, want)
    return {"is": got == want, "part": want in got, "head": got.startswith(want), "tail": got.endswith(want), "word": want in got.split()}[kind]


def matches(n: Node, selector: str) -> bool:
    for compounds in _compiled(selector):
        if not all(_holds(n, p) for p in compounds[-1]):
            continue
        at, todo = n.parent, list(compounds[:-1])
        while todo and at is not None:
            if all(_holds(at, p) for p in todo[-1]):
                todo.pop()
            at = at.parent
        if not todo:
            return True
    return False


def closest(n: Node | None, selector: str) -> Node | None:
    while n is not None and n.tag != "#root":
        if matches(n, selector):
            return n
        n = n.parent
    return None


def select(root: Node, selector: str) -> list[Node]:
    return [n for n in root.walk() if matches(n, selector)]


# ---------------------------------------------------------------- adapters


@dataclass(frozen=True)
class Part:
    """Where messages of a role stand, which ancestor is the whole message, and where its text is."""

    role: str
    selectors: tuple[str, ...]
    content: tuple[str, ...] = ()
    expand: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()


@dataclass(frozen=True)
class Adapter:
    platform: str
    parts: tuple[Part, ...]
    titles: tuple[str, ...] = ("[data-testid='conversation-title']", "[aria-current='page']", "h1")
    root: str = "main"
    fallback: tuple[str, ...] = ()
    generic: bool = True
    merge_adjacent: bool = False
    alternating: bool = False
    drop_echoes: bool = False
    layout_roles: bool = True
    message_times: bool = True
    document_times: bool = True


# Page areas that are not messages.
CHROME = "button, nav, header, footer, form, textarea, input, select, [role='button'], [role='navigation'], [role='menu']"
# Elements that are messages on any platform.
GENERIC = (
    "[data-message-author-role]",
    "[data-author-role]",
    "[data-author]",
    "[data-role='user']",
    "[data-role='assistant']",
    "[data-testid*='user' i][data-testid*='message' i]",
    "[data-testid*='assistant' i][data-testid*='message' i]",
    "[data-testid*='model' i][data-testid*='response' i]",
    "user-query",
    "model-response",
)
# Elements of users' and assistants' messages, of their text, and of each platform's own pages below.
_USER = ("[data-testid='user-message']", "[data-testid*='user' i][data-testid*='message' i]", "[data-message-author-role='user']", "[data-author-role='user']", "[data-role='user']")
_ASSISTANT = ("[data-testid='assistant-message']", "[data-testid*='assistant' i][data-testid*='message' i]", "[data-testid*='assistant' i][data-testid*='response' i]", "[data-message-author-role='assistant']", "[data-author-role='assistant']", "[data-role='assistant']", ".assistant-message")
_BODY = (".message-content", ".prose", ".markdown", "[data-testid='message-content']")
_BLOCKS = ("ul", "ol", "li", "pre", "pre code", "[class*='code-block']", "[class*='codeBlock']")
ADAPTERS: dict[str, Adapter] = {}


def register_adapter(adapter: Adapter) -> Adapter:
    ADAPTERS[adapter.platform] = adapter
    return adapter


register_adapter(Adapter("chatgpt", (Part("user", _USER, _BODY), Part("assistant", _ASSISTANT, _BODY))))
register_adapter(
    Adapter(
        "claude",
        (
            Part("user", _USER),
            Part("assistant", (*_ASSISTANT, *_BLOCKS, "[data-testid*='response' i]", "[class*='font-claude-message']", "[class*='font-claude-response-body']", "[class*='claude-message']"), (".font-claude-message", *_BODY), (*_ASSISTANT, "[class*='font-claude-message']", "[class*='claude-message']", ".prose", "article"), (*_USER, *CHROME.split(", "))),
        ),
        fallback=(*_USER[:2], *_BLOCKS, "[data-testid*='response' i]", "[class*='font-claude-message']", "[data-message-author-role]", "[data-author-role]"),
        generic=False,
        merge_adjacent=True,
        layout_roles=False,
    )
)
register_adapter(
    Adapter(
        "gemini",
        (
            Part("user", ("user-query", "[data-test-id='user-query']", "[data-testid='user-query']", ".user-query", ".user-query-container"), (".query-text", ".user-query-content", "[data-test-id='query-text']", "[data-testid='query-text']")),
            Part("assistant", ("model-response", "[data-test-id='model-response']", "[data-testid='model-response']", ".model-response", ".model-response-container"), (".model-response-text", ".response-content", ".markdown", "message-content", "[data-test-id='response-text']", "[data-testid='response-text']")),
        ),
        titles=("[data-test-id='conversation-title']", "[data-testid='conversation-title']", ".conversation-title", "h1"),
        message_times=False,
        document_times=False,
    )
)
for _platform, _own in (("grok", ("[data-testid='grok-message']", ".response-content-markdown", "[data-testid*='answer' i]")), ("deepseek", (".ds-markdown", "[class*='ds-markdown']")), ("doubao", ("[data-testid='receive_message']", "[class*='receive-message']", "[class*='flow-markdown']"))):
    register_adapter(
        Adapter(
            _platform,
            (
                Part("user", (*_USER, ".user-message", "[class*='user-message']", "[class*='human-message']", "[data-testid='send_message']", "[class*='send-message']"), _BODY),
                Part("assistant", (*_own, *_ASSISTANT, "[class*='assistant-message']", "[class*='model-message']"), (), (*_own, *_ASSISTANT), (*_USER, *CHROME.split(", "))),
            ),
            fallback=(*_USER[:2], *_own, "[class*='message']", "[class*='bubble']", "article"),
            merge_adjacent=True,
            alternating=True,
            drop_echoes=True,
        )
    )

# ---------------------------------------------------------------- reading

# Words in an element's or its ancestors' marks that tell a role, and layout classes that do.
USER_WORDS = re.compile(r"\b(user|human|prompt|question)\b|user-query")
ASSISTANT_WORDS = re.compile(r"\b(assistant|model|answer|response|bot|claude|gemini|grok|deepseek|doubao)\b|model-response|font-claude")
RIGHT = re.compile(r"\b(self-end|items-end|justify-end|ml-auto|float-right|right-\d|text-right)\b")
LEFT = re.compile(r"\b(self-start|items-start|justify-start|mr-auto|float-left|left-\d|text-left)\b")
_MARKS = ("data-message-author-role", "data-author-role", "data-author", "data-role", "aria-label", "data-testid", "data-test-id", "class")


def role_from(n: Node, layout: bool = True) -> str:
    said, at = [], n
    for _ in range(5):
        if at is None:
            break
        said += [at.tag, *(at.get(k) for k in _MARKS)]
        at = at.parent
    tokens = " ".join(x for x in said if x).lower()
    for pattern, role in ((USER_WORDS, "user"), (ASSISTANT_WORDS, "assistant"), *(((RIGHT, "user"), (LEFT, "assistant")) if layout else ())):
        if pattern.search(tokens):
            return role
    return ""


def visible(n: Node | None) -> bool:
    for _ in range(6):
        if n is None:
            break
        style = re.sub(r"\s+", "", n.get("style").lower())
        if "hidden" in n.attrs or n.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style:
            return False
        n = n.parent
    return True


def structure_score(x: str) -> int:
    count = lambda p: len(re.findall(p, x, re.M))
    return count(r"^#{1,6}\s+") * 120 + count("^```") * 90 + count(r"^(?:\s*[-*]\s+|\s*\d+\.\s+)") * 35 + count(r"^\|.+\|$") * 25 + count(r"^>\s+") * 25 + 3 * sum(bool(p.strip()) for p in re.split(r"\n{2,}", x))


def dialogue_score(messages: list[dict]) -> int:
    roles = [m["role"] for m in messages]
    users, answers = roles.count("user"), roles.count("assistant")
    pairs = min(users, answers)
    turns = sum(a != b for a, b in zip(roles, roles[1:], strict=False))
    size = min(len(roles), pairs * 2 + 2 if pairs else 3)
    return pairs * 20 + turns * 3 + size + 5 * (users > 0) + 5 * (answers > 0) - (abs(users - answers) * 2 if pairs else max(0, len(roles) - 1) * 2)


def _norm(x: str) -> str:
    return re.sub(r"\s+", " ", normalize_whitespace(x)).translate(str.maketrans("“”‘’", "\"\"''")).strip()


def dedupe(messages: list[dict]) -> list[dict]:
    kept: list[tuple[str, dict]] = []
    for m in messages:
        content = normalize_whitespace(m["content"])
        norm = _norm(content)
        if len(content) >= 2 and norm not in [k for k, _ in kept[-3:]] and (m["role"], norm) not in {(o["role"], k) for k, o in kept}:
            kept.append((norm, {**m, "content": m["content"].strip()}))
    inside = lambda a, b: len(a) >= 24 and len(b) >= len(a) + 24 and a in b
    return [m for i, (norm, m) in enumerate(kept) if not any(i != j and o["role"] == m["role"] and inside(norm, k) for j, (k, o) in enumerate(kept))]


def merge_adjacent(messages: list[dict]) -> list[dict]:
    out: list[dict] = []
    for m in messages:
        if out and out[-1]["role"] == m["role"]:
            out[-1] = {**out[-1], "content": f"{out[-1]['content']}\n\n{m['content']}", "time": out[-1]["time"] or m["time"]}
        else:
            out.append(dict(m))
    return dedupe(out)


class Page:
    def __init__(self, html: str, adapter: Adapter):
        self.adapter, self.tree, self.render = adapter, parse(html), Renderer()
        nodes = list(self.tree.walk())
        self.order = {id(n): i for i, n in enumerate(nodes)}
        self.root = next((n for n in nodes if matches(n, adapter.root)), None) or next((n for n in nodes if n.tag == "body"), self.tree)
        self.shown: dict[int, str] = {}

    def markdown(self, n: Node) -> str:
        if id(n) not in self.shown:
            self.shown[id(n)] = self.render.markdown(n) or normalize_whitespace(n.text())
        return self.shown[id(n)]

    def time(self, n: Node) -> str:
        if not self.adapter.message_times:
            return ""
        for x in [n, *n.walk()]:
            if found := x.get("datetime") or x.get("data-time") or x.get("data-timestamp"):
                return found
        return ""

    def expanded(self, n: Node, selectors: tuple[str, ...], exclude: tuple[str, ...] = ()) -> Node:
        outside = lambda x: not any((c := closest(x, e)) is not None and c is not x for e in exclude)
        return next((c for s in selectors if (c := closest(n, s)) is not None and outside(c)), n)

    def content(self, n: Node, selectors: tuple[str, ...]) -> Node:
        """The part of a message that shows the most text and structure; of equals the first."""
        found = {id(c): c for s in selectors for c in ([n] if matches(n, s) else []) + select(n, s) if visible(c) and c.text().strip()}
        score = lambda c: (len(normalize_whitespace(self.markdown(c))) + structure_score(self.markdown(c))) if self.markdown(c) else 0
        return max(found.values(), key=score, default=n)

    def by_selectors(self) -> list[dict]:
        got = []
        for part in self.adapter.parts:
            for s in part.selectors:
                for n in select(self.root, s):
                    if not visible(n) or any((c := closest(n, e)) is not None and c is not n for e in part.exclude):
                        continue
                    whole = self.expanded(n, part.expand, part.exclude)
                    if content := self.markdown(self.content(whole, part.content)):
                        got.append((self.order[id(whole)], {"role": part.role, "content": content, "time": self.time(n)}))
        return dedupe([m for _, m in sorted(got, key=lambda g: g[0])])

    def by_generic(self) -> list[dict]:
        found = {id(n): n for s in GENERIC for n in select(self.root, s)}
        rows = [{"role": r, "content": c, "time": self.time(n)} for n in sorted(found.values(), key=lambda n: self.order[id(n)]) if visible(n) and (r := role_from(n)) and (c := self.markdown(n))]
        return dedupe(rows)

    def by_fallback(self) -> list[dict]:
        raw = [n for s in self.adapter.fallback for n in select(self.root, s)]
        held: list[Node] = []
        for n in sorted({id(n): n for n in raw}.values(), key=lambda n: (len(n.text()), self.order[id(n)])):
            if n.text().strip() and not any(_inside(h, n) for h in held):
                held.append(n)
        rows = []
        for n in sorted(held, key=lambda n: self.order[id(n)]):
            if visible(n) and closest(n, CHROME) is None and len(c := normalize_whitespace(self.markdown(n))) >= 2:
                rows.append({"role": role_from(n, self.adapter.layout_roles), "content": c, "time": self.time(n)})
        if self.adapter.alternating:
            following = "user"
            for m in rows:
                m["role"] = m["role"] or following
                following = "assistant" if m["role"] == "user" else "user"
        return [m for m in dedupe(rows) if m["role"]]

    def messages(self) -> list[dict]:
        merged = merge_adjacent if self.adapter.merge_adjacent else lambda m: m
        sets = [merged(self.by_selectors()), merged(self.by_generic()) if self.adapter.generic else [], merged(self.by_fallback())]
        best = max((s for s in sets if s), key=dialogue_score, default=[])
        if self.adapter.drop_echoes:
            asked = {_norm(m["content"]) for m in best if m["role"] == "user"}
            best = [m for m in best if m["role"] != "assistant" or _norm(m["content"]) not in asked]
        return best

    def title(self) -> str:
        found = next((n for s in self.adapter.titles for n in select(self.tree, s) if visible(n) and n.text().strip()), None) or self.tree.find("title")
        return normalize_whitespace(found.text()) if found else ""


def _inside(inner: Node, outer: Node) -> bool:
    at = inner
    while at is not None:
        if at is outer:
            return True
        at = at.parent
    return False


def extract(html: str | None, platform: str) -> dict:
    page = Page(html or "", ADAPTERS[platform])
    return {"title": page.title(), "messages": page.messages()}


def extract_pages(pages: DataFrame) -> DataFrame:
    """url, platform, conversation_id, title, messages of chat pages (url, html); other pages are filtered before any parsing."""
    chats = pages.withColumn("platform", detect_platform("url")).where("platform is not null").select("url", "platform", last_id_segment("url").alias("conversation_id"), "html")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            got = [extract(h, p) for h, p in zip(x["html"], x["platform"], strict=True)]
            yield x[["url", "conversation_id"]].assign(platform=x["platform"].map(PLATFORM_LABELS), title=[g["title"] for g in got], messages=[g["messages"] for g in got])

    return chats.mapInPandas(run, "url string, conversation_id string, platform string, title string, messages array<struct<role: string, content: string, time: string>>")
