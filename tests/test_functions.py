import datetime

import pytest
from pyspark.sql import functions as F

from chatloom.functions import text as t
from chatloom.functions import times, urls
from chatloom.functions.html import compact, to_markdown

AS_OF = datetime.date(2026, 6, 15)


def each(spark, values, make):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r.y for r in frame.select("i", make(F.col("x")).alias("y")).orderBy("i").collect()]


def test_platforms(spark):
    cases = {
        "https://chatgpt.com/c/1": "chatgpt",
        "https://chat.openai.com/": "chatgpt",
        "https://CLAUDE.ai/chat/x": "claude",
        "https://gemini.google.com/app/1": "gemini",
        "https://grok.com/": "grok",
        "https://x.com/i/grok?c=1": "grok",
        "https://x.com/home": None,
        "https://chat.deepseek.com/": "deepseek",
        "https://www.doubao.com/chat/1": "doubao",
        "https://notclaude.ai/": None,
        "not a url": None,
        None: None,
    }
    assert each(spark, cases, urls.detect_platform) == list(cases.values())
    assert each(spark, ["https://x.com/home"], lambda c: urls.detect_platform(c, strict=False)) == ["grok"]


def test_conversation_addresses(spark):
    cases = {
        "https://chatgpt.com/c/abc?x=1#y": "https://chatgpt.com/c/abc",
        "https://chatgpt.com/g/g-1/c/abc/": "https://chatgpt.com/g/g-1/c/abc",
        "https://claude.ai/settings": "",
        "https://gemini.google.com/app/c_0011aabb": "https://gemini.google.com/app/c_0011aabb",
        "https://example.com/c/abc": "",
        "": "",
    }
    assert each(spark, cases, urls.conversation_url) == list(cases.values())
    ids = {"https://chatgpt.com/c/11111111-2222": "11111111-2222", "https://gemini.google.com/app/c_0011aabb": "0011aabb", "https://chat.deepseek.com/a/chat/s/abcd1234?conversation_id=zz": "zz", "https://example.com/en/825": ""}
    assert each(spark, ids, urls.conversation_id) == list(ids.values())
    assert each(spark, ["c_0011AAbb", "0011aabb", "c_12", "xyz"], urls.gemini_id) == ["0011AAbb", "0011aabb", "", ""]


def test_texts(spark):
    assert each(spark, [" a  b \n\n\n\n c ", None, "　x﻿"], t.normalize_whitespace) == ["a b\n\nc", "", "x"]
    assert each(spark, ["Plan - ChatGPT", "Gemini | Trip", "豆包", "Claude"], t.strip_platform_from_title) == ["Plan", "Trip", "豆包", "Claude"]
    assert each(spark, ["New chat", "与 Gemini 对话", "ChatGPT", "", "Trip to Rome"], t.is_generic_title) == [True, True, True, True, False]
    assert each(spark, ["alpha beta gamma", "x" * 30], lambda c: t.truncate(c, 12)) == ["alpha beta", "x" * 12]
    assert each(spark, ['a/b: "c"?', "ＡＢ", ""], lambda c: t.make_slug(c, "AI_Chat")) == ["a_b_c", "AB", "AI_Chat"]
    assert each(spark, ["Gemini\\A (2).md", "/x//Y.MD"], t.canonical_export_key) == ["gemini/a.md", "x/y.md"]
    assert each(spark, ["a  \n\n\n\n```py\nx  \n\n\n\ny\n```\n  b"], t.compact_markdown) == ["a\n\n```py\nx\n\n\n\ny\n```\nb"]
    assert each(spark, ["true", " FALSE ", "x", None], t.boolean_override) == [True, False, None, None]
    assert each(spark, ["../a/./b//c.md", "\\x\\y"], t.clean_path) == ["a/b/c.md", "x/y"]
    assert each(spark, ["data:text/plain;base64,w6k=", "data:,a%20b+c", "http://x"], t.from_data_url) == ["é", "a b+c", None]
    assert each(spark, ["#include <x>", "import os", "git push", "hello"], t.infer_code_language) == ["c", "python", "bash", ""]


def test_compaction_is_the_same_in_both_places(spark):
    cases = ["a \n\n\n b", "```x\n a \n```\n\n\n\n t ", "x ``` y", "", "``` \n\n\n ```", "a\n```\nq \n```\n\n\n b\n```c\n\n\n\n```"]
    assert each(spark, cases, t.compact_markdown) == [compact(c) for c in cases]


def test_timestamps(spark):
    cases = {"1735689600": "2025-01-01T00:00:00.000Z", "1735689600123": "2025-01-01T00:00:00.123Z", "1735689600123456": "2025-01-01T00:00:00.123Z", "1735689600.5": "2025-01-01T00:00:00.500Z", "at 2025-01-01T02:00:00+02:00": "2025-01-01T00:00:00.000Z", "2025-01-01": "2025-01-01T00:00:00.000Z", "12": "", "soon": "", "": ""}
    assert each(spark, cases, times.normalize_timestamp) == list(cases.values())
    assert each(spark, ["2019-01-01", "2030-01-01", "2025-01-01"], lambda c: times.valid_timestamp(c, 2026)) == ["", "", "2025-01-01T00:00:00.000Z"]
    assert each(spark, ["on Apr 9, 2026 then", "2026年4月10日", "x 2025-01-02 y"], lambda c: times.read_time_candidate(c, 2026)) == ["Apr 9, 2026", "2026年4月10日", "2025-01-02"]


def test_history_dates(spark):
    cases = {"Today": "2026-06-15", "昨天": "2026-06-14", "前天": "2026-06-13", "2026-02-30": "", "2026年1月5日": "2026-01-05", "Sept 3": "2025-09-03", "6月16日": "2026-06-16", "6月20日": "2025-06-20", "4/5": "2026-04-05", "4/5/24": "2024-04-05", "nothing": ""}
    assert each(spark, cases, lambda c: times.history_date(c, AS_OF)["date"]) == list(cases.values())


@pytest.mark.parametrize(
    "html, markdown",
    [
        ("<p>a<p><b>x</b> <i>y</i> <del>z</del>", "a\n\n**x** *y* ~~z~~"),
        ("<h2> Title </h2><hr><p>t", "## Title\n\n-----\n\nt"),
        ("<ul><li>one<li>two</ul><ol start=3><li>x</ol>", "- one\n- two\n\n3. x"),
        ("<table><tr><th>a<th>b|c<tr><td>1</table>", "| a | b\\|c |\n| :--- | :--- |\n| 1 |  |"),
        ("<blockquote><p>q</p><p>r</p></blockquote>", "> q\n>\n> r"),
        ("<div>python</div><pre><code>x = 1\n</code></pre>", "```python\nx = 1\n```"),
        ("<pre><code class='language-sql'>select 1</code></pre>", "```sql\nselect 1\n```"),
        ("<div>c++</div><button>Copy code</button><pre>int main() {}</pre>", "```cpp\nint main() {}\n```"),
        ("<p>see <a href='http://x'>this</a> <a href='javascript:1'>that</a></p>", "see [this](http://x) that"),
        ("<p>use <code>a b</code></p>", "use `a b`"),
        ("<span class='katex' aria-label='\\theta \\leq 1'>q</span>", "θ ≤ 1"),
        ("<div class='thinking'>secret</div><p>seen</p><p hidden>no</p><nav role='navigation'>no</nav>", "seen"),
        ("<script>var t='</p>'</script><style>p{}</style><p>x</p>", "x"),
        ("", ""),
    ],
)
def test_html_rules(html, markdown):
    assert to_markdown(f"<body>{html}</body>") == markdown
