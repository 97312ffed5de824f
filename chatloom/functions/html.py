"""HTML to Markdown, and links of pages: one pass over a small tree built by the standard library's parser.

A static page has no layout, so visibility is what attributes say. The parser closes p, li, tr, td, th, dt,
dd and option where HTML does, so that unclosed runs keep their structure.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
CLOSES = {
    "li": ({"li"}, {"ul", "ol"}),
    "p": ({"p"}, set()),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select"}),
}
# Block elements.
BLOCK_TAGS = {"address", "article", "aside", "blockquote", "br", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "li", "main", "nav", "ol", "p", "pre", "section", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
# Elements that hold nothing to read.
SKIP_TAGS = {"button", "canvas", "iframe", "input", "noscript", "script", "select", "style", "svg", "textarea"}
SKIP_ROLES = {"button", "navigation", "menu"}
# Labels of buttons that copying leaves in a text.
UI_CHROME_TEXT = ("copy", "copy code", "copy table", "copy to clipboard", "copied", "copied to clipboard", "复制", "复制代码", "复制表格", "复制到剪贴板", "已复制")
# Labels of code languages and the names that fences get.
CODE_LANGUAGES = {
    "bash": "bash", "c": "c", "c#": "csharp", "c++": "cpp", "cpp": "cpp", "csharp": "csharp", "css": "css", "go": "go", "html": "html", "java": "java",
    "javascript": "javascript", "js": "javascript", "json": "json", "kotlin": "kotlin", "markdown": "markdown", "md": "markdown", "mermaid": "mermaid", "php": "php",
    "plaintext": "text", "py": "python", "python": "python", "r": "r", "ruby": "ruby", "rust": "rust", "shell": "bash", "sh": "bash", "sql": "sql", "swift": "swift",
    "text": "text", "ts": "typescript", "typescript": "typescript", "xml": "xml", "yaml": "yaml", "yml": "yaml", "zsh": "bash",
}
# TeX commands and their symbols, in the order in which they are replaced.
TEX_SYMBOLS = {
    r"\oint": "∮", r"\int": "∫", r"\pi": "π", r"\theta": "θ", r"\Theta": "Θ", r"\epsilon": "ε", r"\varepsilon": "ε", r"\alpha": "α", r"\beta": "β", r"\gamma": "γ",
    r"\delta": "δ", r"\Delta": "Δ", r"\lambda": "λ", r"\mu": "μ", r"\sum": "∑", r"\prod": "∏", r"\sqrt": "√", r"\cdot": "·", r"\times": "×", r"\div": "÷",
    r"\leq": "≤", r"\geq": "≥", r"\neq": "≠", r"\approx": "≈", r"\pm": "±", r"\to": "→", r"\rightarrow": "→", r"\leftarrow": "←",
}
# Marks of reasoning, and signs of mathematics.
REASONING = re.compile(r"(?:^|[\s_-])(?:think|thinking|reasoning|cot|chain-of-thought)(?:[\s_-]|$)|ds-think-content|模型思考|思考过程|深度思考")
MATH_SIGNS = re.compile(r"[∮∫πθΘεαβγδΔλμ∑∏√≤≥≠≈±→←∞∂∇·×÷]|\\[A-Za-z]+")
_SPACE = "\t\n\x0b\f\r    -     　﻿"
_RUNS = re.compile(f"[{_SPACE}]+")
_ENDS = re.compile(f"^[{_SPACE}]+|[{_SPACE}]+\\Z")
_FENCE = re.compile(r"```[\s\S]*?```")
#: Stands for a backtick of a page's own text while it is rendered, so that only code blocks have fences; no text in UTF-8 holds it.
_TICK = "\udc60"


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def get(self, name: str) -> str:
        return self.attrs.get(name) or ""

    def elements(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]

    def walk(self):
        """Elements below, in document order."""
        todo = self.elements()[::-1]
        while todo:
            node = todo.pop()
            yield node
            todo.extend(node.elements()[::-1])

    def find(self, *tags: str, where=lambda n: True) -> Node | None:
        return next((n for n in self.walk() if n.tag in tags and where(n)), None)

    def text(self) -> str:
        out, todo = [], self.children[::-1]
        while todo:
            c = todo.pop()
            if isinstance(c, str):
                out.append(c)
            else:
                todo.extend(c.children[::-1])
        return "".join(out)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", {}, None)

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES:
            closing, bounds = CLOSES[tag]
            self._close(closing, bounds)
        elif tag in BLOCK_TAGS and tag != "br":
            self._close({"p"}, {"td", "th", "li", "table", "button"})
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.at.tag == tag:
            self.at = self.at.parent

    def handle_endtag(self, tag):
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)

    def _close(self, closing, bounds):
        node, last = self.at, None
        while node.parent is not None and node.tag not in bounds:
            if node.tag in closing:
                last = node
            node = node.parent
        if last is not None:
            self.at = last.parent


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


def trim(x: str) -> str:
    return _ENDS.sub("", x)


def normalize_whitespace(x: str) -> str:
    x = (x or "").replace("\u00a0", " ")
    for pattern, by in ((r"[ \t]+\n", "\n"), (r"\n[ \t]+", "\n"), (r"[ \t]{2,}", " "), (r"\n{3,}", "\n\n")):
        x = re.sub(pattern, by, x)
    return trim(x)


def compact(x: str) -> str:
    """White space of Markdown compacted outside code fences."""
    out, at = [], 0
    plain = lambda s: re.sub(r"\n{3,}", "\n\n", re.sub(r"\n[ \t]+", "\n", re.sub(r"[ \t]+\n", "\n", s)))
    for m in _FENCE.finditer(x):
        out += [plain(x[at : m.start()]), re.sub(r"[ \t]+\n", "\n", m[0])]
        at = m.end()
    return trim("".join([*out, plain(x[at:])]))


def _shy(x: str) -> str:
    """A page's own text, whose backticks are no fences."""
    return x.replace("`", _TICK)


def _one_line(x: str) -> str:
    return trim(_RUNS.sub(" ", normalize_whitespace(x)))


def is_chrome(x: str) -> bool:
    return _one_line(x).lower() in UI_CHROME_TEXT


def language_label(x: str) -> str:
    clean = _one_line(x)
    for label in UI_CHROME_TEXT:
        clean = re.sub(rf"\b{re.escape(label)}\b", " ", clean, flags=re.I | re.A)
    clean = re.sub(r"^lang(?:uage)?\s*[:：-]?\s*", "", _one_line(clean), flags=re.I).strip().lower()
    return CODE_LANGUAGES.get(clean.removeprefix("```").removesuffix("```").strip(), "")


def accessible(n: Node) -> str:
    own = n.get("aria-label") or n.get("title")
    title = None if own else n.find("title")
    return (own or (title.text() if title else "")).strip()


def math_text(n: Node) -> str:
    def clean(x: str) -> str:
        x = _RUNS.sub(" ", (x or "")).strip()
        for tex, symbol in TEX_SYMBOLS.items():
            x = x.replace(tex, symbol)
        return _RUNS.sub(" ", re.sub(r"\{\s*\}", "", re.sub(r"\\left|\\right", "", x))).strip()

    given = clean(next((n.get(k) for k in ("data-latex", "data-tex", "data-math", "data-expression", "alttext") if n.get(k)), ""))
    if given:
        return given
    classes = n.get("class").lower()
    is_math = n.tag == "math" or n.tag.startswith("mjx-") or "katex" in classes or "math" in classes or n.get("role").lower() == "math"
    spoken = clean(accessible(n)) if is_math or n.get("aria-label") or n.get("title") or n.tag == "svg" or MATH_SIGNS.search(accessible(n)) else ""
    if spoken and (is_math or MATH_SIGNS.search(spoken)):
        return spoken
    if not is_math:
        return ""
    note = n.find("annotation", where=lambda a: "x-tex" in a.get("encoding") or "x-latex" in a.get("encoding")) or n.find("annotation")
    if note and clean(note.text()):
        return clean(note.text())
    body = clean(n.text())
    return body if MATH_SIGNS.search(body) else ""


def is_skipped(n: Node) -> bool:
    tokens = " ".join(n.get(k) for k in ("class", "data-testid", "data-test-id", "data-role", "aria-label")).strip().lower()
    if tokens and REASONING.search(tokens):
        return True
    if n.tag in SKIP_TAGS or n.get("role").lower() in SKIP_ROLES or n.get("aria-hidden") == "true" or "hidden" in n.attrs:
        return True
    words = n.text()
    return len(words) < 400 and is_chrome(words or accessible(n))


def is_code_block(n: Node) -> bool:
    marks = n.get("class").lower() + " " + (n.get("data-testid") or n.get("data-test-id")).lower()
    return n.tag == "pre" or (n.tag == "code" and "\n" in n.text()) or "code-block" in marks or "codeblock" in marks


def infer_language(code: str) -> str:
    from .text import CODE_SIGNS

    return next((language for language, signs in CODE_SIGNS if re.search(signs, code, re.A)), "")


def _class_language(n: Node) -> str:
    m = re.search(r"(?:language-|lang-)([A-Za-z0-9_-]+)", n.get("class"))
    return m[1] if m else ""


def _block_language(n: Node) -> str:
    if own := _class_language(n):
        return own
    child = n.find("code", where=_class_language) or n.find("code")
    if child is not None:
        return _class_language(child)
    label = n.get("data-language") or n.get("data-lang") or n.get("aria-label")
    m = re.search(r"(?<![A-Za-z0-9_])([A-Za-z0-9_+#.-]+)", label)
    return language_label(label) or (CODE_LANGUAGES.get(m[1].lower(), m[1]) if m else "")


class Renderer:
    """Markdown of a tree. Context is the node's siblings and its place among them."""

    def markdown(self, n: Node) -> str:
        return compact(self.node(n, [n], 0)).replace(_TICK, "`")

    def children(self, n: Node) -> str:
        return "".join(self.node(c, n.children, i) for i, c in enumerate(n.children))

    def inline(self, n: Node) -> str:
        return re.sub(r"\n+", " ", compact(self.children(n)))

    def _near(self, around: list, at: int, step: int):
        """Elements beside a node, up to the first text that is not blank."""
        i = at + step
        while 0 <= i < len(around):
            c = around[i]
            if isinstance(c, Node):
                yield c
            elif trim(c):
                return
            i += step

    def _label_beside(self, around: list, at: int) -> str:
        for step in (-1, 1):
            for k, c in enumerate(self._near(around, at, step)):
                words = c.text() or accessible(c)
                if k >= 4 or (not language_label(words) and not is_chrome(words)):
                    break
                if found := language_label(words):
                    return found
        return ""

    def _is_label_of_code(self, n: Node, around: list, at: int) -> bool:
        if n.tag in ("pre", "code") or len(n.text()) > 200 or n.find("pre", "code") or not language_label(n.text() or accessible(n)):
            return False
        for step in (1, -1):
            for k, c in enumerate(self._near(around, at, step)):
                if k < 4 and is_code_block(c):
                    return True
                words = c.text() or accessible(c)
                if k >= 3 or not (is_chrome(words) or language_label(words)):
                    break
        return False

    def code_block(self, n: Node, around: list, at: int) -> str:
        code = n if n.tag == "code" else n.find("code") or n
        body = re.sub(r"\n+\Z", "", re.sub(r"\r\n?", "\n", code.text().replace("\u00a0", " ")))
        chrome = next((found for c in n.elements() if c is not code and not c.find("pre", "code") and (found := language_label(c.text()))), "")
        language = _block_language(code) or _block_language(n) or chrome or self._label_beside(around, at) or infer_language(body)
        return f"```{language}\n{_shy(body)}\n```\n\n"

    def table(self, n: Node) -> str:
        cell = lambda c: trim(re.sub(r"\r?\n", " ", self.inline(c).replace("|", "\\|")))
        rows = [r for tr in n.walk() if tr.tag == "tr" and (r := [cell(c) for c in tr.walk() if c.tag in ("th", "td")])]
        if not rows:
            return ""
        width = max(map(len, rows))
        rows = [r + [""] * (width - len(r)) for r in rows]
        return "\n".join(f"| {' | '.join(r)} |" for r in [rows[0], [":---"] * width, *rows[1:]]) + "\n\n"

    def list_(self, n: Node) -> str:
        start = n.get("start")
        number = int(start) if re.fullmatch(r"-?[0-9]+", start) and int(start) else 1
        mark = lambda i: f"{number + i}. " if n.tag == "ol" else "- "
        items = [li for li in n.elements() if li.tag == "li"]
        return "\n".join(mark(i) + compact(self.children(li)).replace("\n", "\n  ") for i, li in enumerate(items)) + "\n\n"

    def node(self, n, around: list, at: int) -> str:
        if isinstance(n, str):
            return _shy(_RUNS.sub(" ", n))
        if math := math_text(n):
            return _shy(math)
        if is_skipped(n):
            return ""
        if n.tag == "br":
            return "\n"
        if n.tag == "hr":
            return "-----\n\n"
        if self._is_label_of_code(n, around, at):
            return ""
        for tags, mark in ((("strong", "b"), "**"), (("em", "i"), "*"), (("del", "s"), "~~")):
            if n.tag in tags:
                body = self.inline(n)
                return f"{mark}{body}{mark}" if body else ""
        if re.fullmatch("h[1-6]", n.tag):
            body = self.inline(n) or _shy(accessible(n))
            return f"{'#' * int(n.tag[1])} {body}\n\n" if body else ""
        if n.tag == "p":
            body = compact(self.children(n))
            return f"{body}\n\n" if body else ""
        if is_code_block(n):
            return self.code_block(n, around, at)
        if n.tag == "code":
            return _shy(f"`{n.text().strip()}`")
        if n.tag == "a":
            href = _shy(n.get("href"))
            body = self.inline(n) or href
            return body if not href or href.startswith("javascript:") or href == body else f"[{body}]({href})"
        if n.tag in ("ul", "ol"):
            return self.list_(n)
        if n.tag == "blockquote":
            body = compact(self.children(n))
            return "".join(f"> {line}\n" for line in re.split(r"\r?\n", body)) + "\n" if body else ""
        if n.tag == "table":
            return self.table(n)
        body = self.children(n)
        whole = compact(body)
        if not whole and (spoken := _shy(accessible(n)) if n.tag != "#root" else ""):
            return f"{spoken}\n\n" if n.tag in BLOCK_TAGS else spoken
        if n.tag not in BLOCK_TAGS:
            return body
        return f"{whole}\n\n" if whole else ""


def to_markdown(html: str | None) -> str | None:
    if html is None:
        return None
    root = parse(html)
    return Renderer().markdown(root.find("body") or root)


@F.pandas_udf(T.StringType())
def html_to_markdown(html: pd.Series) -> pd.Series:
    return html.map(to_markdown)


def links_of(html: str | None) -> list[dict]:
    out = []
    for n in parse(html or "").walk():
        if n.tag == "a" and n.get("href"):
            out.append({"href": n.get("href"), "text": trim(_RUNS.sub(" ", n.text()))})
    return out


@F.pandas_udf(T.ArrayType(T.StructType().add("href", "string").add("text", "string")))
def html_links(html: pd.Series) -> pd.Series:
    return html.map(links_of)
