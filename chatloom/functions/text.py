"""String functions on columns. Null counts as empty, and results are never null unless said."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# White space as browsers define it for trimming and for \s in patterns.
WS = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
# Names that platforms append to page titles, in the order in which they are removed.
TITLE_LABELS = ("ChatGPT", "OpenAI", "Claude", "Gemini", "Grok", "DeepSeek", "Doubao", "豆包", "Google Gemini")
# Titles that say nothing about a conversation.
GENERIC_TITLES = (
    "^ai chat$",
    "^chat$",
    "^conversation$",
    "^new chat$",
    "^new conversation$",
    "^untitled(?: chat| conversation)?$",
    "^chat history$",
    "^conversation history$",
    "^recent(?: chats| conversations)?$",
    r"^与\s*(?:google\s*)?gemini\s*对话$",
    r"^和\s*(?:google\s*)?gemini\s*聊天$",
    "^新(建)?(聊天|对话)$",
    "^未命名(聊天|对话)?$",
    "^无标题(聊天|对话)?$",
)
# Characters that no file name may hold.
ILLEGAL_IN_NAMES = r"[\\/:*?\"<>|#%{}^~\[\]`]+"


# The same characters one by one.
WS_CHARACTERS = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def bind(x: Column, f) -> Column:
    """f(x), where x is computed once however often f uses it: it is a lambda's variable there, not written out again."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def text(x) -> Column:
    return F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit(""))


def sub(x: Column, pattern: str, by: str = "") -> Column:
    return F.regexp_replace(x, pattern, by)


def trim(x) -> Column:
    return F.trim(text(x), F.lit(WS_CHARACTERS))


def normalize_whitespace(x) -> Column:
    """Blanks around line ends go, runs of blanks become one, and of line ends at most two."""
    y = F.translate(text(x), "\u00a0", " ")
    for pattern, by in ((r"[ \t]+\n", "\n"), (r"\n[ \t]+", "\n"), (r"[ \t]{2,}", " "), (r"\n{3,}", "\n\n")):
        y = sub(y, pattern, by)
    return trim(y)


def _quoted(x: str) -> str:
    return "".join(f"\\{c}" if c in r".*+?^${}()|[]\-" else c for c in x)


def strip_platform_from_title(title, label: Column | str = "") -> Column:
    """The title without a platform's name before or after a bar or hyphen."""
    y = normalize_whitespace(title)
    own = F.lit(label) if isinstance(label, str) else text(label)
    quoted = F.regexp_replace(own, r"([.*+?^${}()|\[\]\\-])", r"\\$1")
    y = F.regexp_replace(y, F.concat(F.lit(rf"(?i){WS}*[|-]{WS}*"), quoted, F.lit(rf"{WS}*\z")), F.lit(""))
    y = F.regexp_replace(y, F.concat(F.lit("(?i)^"), quoted, F.lit(rf"{WS}*[|-]{WS}*")), F.lit(""))
    for one in TITLE_LABELS:
        y = sub(sub(y, rf"(?iu){WS}*[|-]{WS}*{_quoted(one)}{WS}*\z"), rf"(?iu)^{_quoted(one)}{WS}*[|-]{WS}*")
    return normalize_whitespace(y)


def is_generic_title(title, label: Column | str = "") -> Column:
    names = [x.lower() for x in TITLE_LABELS]
    patterns = "|".join(p.replace("$", r"\z").replace(r"\s", WS) for p in GENERIC_TITLES)

    def of_kept(kept: Column) -> Column:
        squeezed = lambda x: F.struct(x.alias("low"), sub(x, f"{WS}+").alias("compact"))
        names_it = lambda x, own: x["low"].isin(names) | x["compact"].isin([n.replace(" ", "") for n in names]) | ((own["low"] != "") & ((x["low"] == own["low"]) | (x["compact"] == own["compact"])))
        mine = F.lower(normalize_whitespace(F.lit(label) if isinstance(label, str) else label))
        named = bind(bind(F.lower(normalize_whitespace(kept)), squeezed), lambda x: bind(bind(mine, squeezed), lambda own: names_it(x, own)))
        return named | kept.rlike(f"(?i)(?:{patterns})")

    def of_clean(clean: Column) -> Column:
        kept = bind(strip_platform_from_title(clean, label), lambda stripped: F.when(stripped != "", stripped).otherwise(clean))
        return (clean == "") | bind(kept, of_kept)

    return bind(trim(sub(sub(normalize_whitespace(title), "[_-]+", " "), "[「」\"“”]")), of_clean)


def truncate(x, n: int) -> Column:
    """At most n characters, without a word that was cut; a single longer word is cut."""
    return bind(normalize_whitespace(x), lambda y: _cut(y, n))


def _cut(y: Column, n: int) -> Column:
    head = F.substring(y, 1, n)
    whole = trim(sub(head, rf"{WS}+{WS.replace('[', '[^', 1)}*\z"))
    return F.when(F.length(y) <= n, y).when(whole != "", whole).otherwise(trim(head))


@F.pandas_udf(T.StringType())
def nfkc(x: pd.Series) -> pd.Series:
    """Compatibility composition, which Spark has no function for; one Arrow batch at a time."""
    return x.map(lambda s: s if s is None or s.isascii() else unicodedata.normalize("NFKC", s))


nfkc = nfkc.asNondeterministic()  # so that Catalyst neither repeats it nor moves it below a projection into a filter


def make_slug(x, fallback: str) -> Column:
    cut = _cut(normalize_whitespace(x), 80)  # not bound: a Python function's argument may hold no lambda of a lambda
    y = nfkc(F.when(cut != "", cut).otherwise(F.lit(fallback or "AI Chat")))
    y = F.substring(sub(sub(sub(y, ILLEGAL_IN_NAMES, " "), f"{WS}+", "_"), r"^_+|_+\z"), 1, 90)
    return F.when(y != "", y).otherwise(F.lit(fallback or "AI_Chat"))


def date_for_filename(x) -> Column:
    return F.regexp_extract(text(x), "[0-9]{4}-[0-9]{2}-[0-9]{2}", 0)


def build_filename(platform, title, time) -> Column:
    date = date_for_filename(time)
    named = F.when(text(platform) != "", text(platform)).otherwise(F.lit("AI"))
    return F.concat(F.when(date != "", F.concat(date, F.lit("_"))).otherwise(F.lit("")), make_slug(named, "AI"), F.lit("_"), make_slug(title, "AI_Chat"), F.lit(".md"))


def first_meaningful_line(x) -> Column:
    lines = F.transform(F.split(text(x), r"\r?\n"), normalize_whitespace)
    return F.coalesce(F.get(F.filter(lines, lambda line: line != ""), F.lit(0)), F.lit(""))


def canonical_export_key(x) -> Column:
    """A path as a key: slashes, no empty parts, no download counter, NFKC, lower case."""
    y = F.array_join(F.filter(F.split(F.translate(text(x), "\\", "/"), "/"), lambda p: p != ""), "/")
    return F.lower(nfkc(sub(y, r"(?i) \([0-9]+\)(\.md)\z", "$1")))


def normalize_for_dedupe(x) -> Column:
    return trim(F.translate(sub(text(x), f"{WS}+", " "), "“”‘’", "\"\"''"))


def escape_yaml(x) -> Column:
    return sub(F.replace(F.replace(text(x), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), r"\r?\n", " ")


def unescape_yaml(x) -> Column:
    return F.replace(F.replace(text(x), F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\"))


def escape_table_cell(x) -> Column:
    return trim(sub(F.replace(text(x), F.lit("|"), F.lit("\\|")), r"\r?\n", " "))


def compact_markdown(x) -> Column:
    """White space of Markdown compacted; code fences keep their lines but for blanks at line ends."""
    plain = lambda y: sub(sub(sub(y, r"[ \t]+\n", "\n"), r"\n[ \t]+", "\n"), r"\n{3,}", "\n\n")
    fenced = F.array_join(F.transform(_fence_parts(text(x)), lambda p: F.when(p.startswith("```") & (F.length(p) > 5) & p.endswith("```"), sub(p, r"[ \t]+\n", "\n")).otherwise(plain(p))), "")
    return F.when(F.instr(text(x), "```") == 0, trim(plain(text(x)))).otherwise(trim(fenced))


def _fence_parts(x: Column) -> Column:
    """Pieces of a text in order: whole fences, and what stands between them."""
    return F.regexp_extract_all(x, F.lit(r"(?s)(```.*?```|(?:(?!```.*?```).)+)"), F.lit(1))


def boolean_override(x) -> Column:
    """true, false, or null for anything else."""
    low = F.lower(trim(x))
    return F.when(low == "true", True).when(low == "false", False)


def to_base64(x) -> Column:
    return F.base64(F.encode(text(x), "UTF-8"))


def from_data_url(x) -> Column:
    """The text of a data: URL, base64 or percent-encoded; null if it is none."""
    head, body = F.substring_index(text(x), ",", 1), F.regexp_extract(text(x), r"(?s)^[^,]*,(.*)\z", 1)
    decoded = F.when(head.rlike("(?i);base64"), F.decode(F.try_to_binary(body, F.lit("base64")), "UTF-8")).otherwise(F.try_url_decode(F.replace(body, F.lit("+"), F.lit("%2B"))))
    return F.when(text(x).rlike("(?i)^data:[^,]*,"), decoded)


def clean_path(x) -> Column:
    """A relative path without empty, . and .. parts."""
    return F.array_join(F.filter(F.split(F.translate(text(x), "\\", "/"), "/"), lambda p: ~p.isin("", ".", "..")), "/")


# What code that names no language is recognised by.
CODE_SIGNS = (
    ("c", r"(?m)^\s*(#include\b|int\s+main\s*\(|void\s+\w+\s*\(|int\s+\w+\s*\(|printf\s*\(|scanf\s*\()"),
    ("python", r"(?m)^\s*(def|class|import|from)\s+\w+|^\s*print\s*\("),
    ("bash", r"(?m)^\s*(npm|pnpm|yarn|pip|python3?|git|cd|mkdir|rm|cp|mv)\b"),
)


def infer_code_language(code) -> Column:
    out = F.lit("")
    for language, signs in reversed(CODE_SIGNS):
        out = F.when(text(code).rlike(signs), F.lit(language)).otherwise(out)
    return out


def structure_score(x) -> Column:
    """How much Markdown structure a text has: headings, fences, lists, tables, quotes, paragraphs."""
    y = text(x)
    weights = ((r"(?m)^#{1,6}\s+", 120), (r"(?m)^```", 90), (r"(?m)^(?:\s*[-*]\s+|\s*\d+\.\s+)", 35), (r"(?m)^\|.+\|$", 25), (r"(?m)^>\s+", 25))
    paragraphs = F.size(F.filter(F.split(y, r"\n{2,}"), lambda p: trim(p) != ""))
    return sum((F.regexp_count(y, F.lit(p)) * w for p, w in weights), paragraphs * 3)
