"""Odd inputs and sizes at which queries once differed from their SQL or grew faster than their input."""

import duckdb
import pytest

from chatloom.functions.html import to_markdown
from chatloom.plans.catalogue import ORACLE_SQL, QUERIES


@pytest.fixture
def both(spark, tmp_path):
    """Rows of a query and of its SQL over one table."""

    def rows(name, table, frame):
        frame.coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
        got = QUERIES[name](spark, str(tmp_path))
        con = duckdb.connect()
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
        expected = con.execute(f"SELECT {', '.join(got.columns)} FROM ({ORACLE_SQL[name]}) x").fetchall()
        return sorted(map(tuple, got.collect()), key=repr), sorted(expected, key=repr)

    return rows


def test_pieces_around_odd_texts(spark, both):
    texts = [None, "", " \n\t ", " 　", "x ", " x  y  z", "a ``` b", "```", "``` x ``` y ```", "a `b` ``c`` ````d", "", "<p>&amp;"]
    got, expected = both("html_pieces_markdown", "documents", spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert got == expected and len(got) == len(texts)


def test_backticks_of_a_text_are_no_fences():
    code = "<pre><code>  x\n\n\n\n  y</code></pre>"
    assert to_markdown(f"<body><p>one ``` tick</p>{code}<p>`</p></body>") == "one ``` tick\n\n```\n  x\n\n\n\n  y\n```\n\n`"
    assert to_markdown(f"<body>{code.replace('  x', '```  x')}<code></code><code>a`b</code></body>") == "```\n```  x\n\n\n\n  y\n```\n\n```a`b`"


def test_times_of_a_key_spread_over_frames():
    import pandas as pd

    from chatloom.streaming import state
    from tests.test_sources import Held

    rows = [(5, "2025-02-01", "Gemini", "", "u5"), (9, "2025-02-01", "Grok", "t9", ""), (3, "2025-02-01", "Claude", "t3", "u3"), (1, "2025-03-01", "Doubao", "", ""), (2, "2025-03-01", "Doubao", "t2", "u2")]
    frame = lambda r: pd.DataFrame([r], columns=["ord", "timestamp", "platform", "title", "updated_at"])
    for order in (rows, rows[::-1], rows[2:] + rows[:2]):
        for cut in (0, 2, 5):  # in one batch and in two
            held = Held()
            got = [list(state._fold_times(("c",), map(frame, part), held, False)) for part in (order[:cut], order[cut:]) if part][-1]
            assert got[0].iloc[0].tolist() == ["c", "Claude", "2025-02-01", "t2", "u5"]


def test_stream_of_keys_larger_than_a_frame(spark, tmp_path):
    """Two files whose events are in opposite orders, in batches of few rows."""
    from pyspark.sql import functions as F

    events = spark.range(4000).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.lit(1735689600) + F.col("id") % 50).alias("ts"), (F.col("id") % 3).alias("user_id"))
    events.where("event_id < 2000").coalesce(1).orderBy(F.desc("event_id")).write.parquet(f"{tmp_path}/events.parquet")
    events.where("event_id >= 2000").coalesce(1).orderBy(F.desc("event_id")).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = sorted(map(tuple, QUERIES["stream_earliest_per_key"](spark, str(tmp_path)).collect()))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == sorted(map(tuple, QUERIES["earliest_per_key"](spark, str(tmp_path)).collect())) and len(got) == 3


def test_headings_are_read_once_for_a_section(monkeypatch):
    """A flat list of links and headings: the texts that are read, and what is kept, grow with the page."""
    from chatloom.operators import history

    read = []
    monkeypatch.setattr(history, "_words", lambda n, words=history._words: read.append(1) or words(n))

    def count(n):
        read.clear()
        page = "<aside><h2>All</h2><section>" + "".join(f"<h3>H{k}</h3><div><a href='/c/{k}'><span>T{k}</span></a></div>" for k in range(n)) + "</section></aside>"
        entries, headings = history.entries_of(page, {f"/c/{k}" for k in range(n)}, lambda t: False)
        assert len(entries) == n and headings[entries[0]["sections"][0]] == [f"H{k}" for k in range(n)] + ["All"]
        return len(read), sum(len(e["sections"]) for e in entries) + sum(map(len, headings))

    small, large = count(20), count(200)
    assert all(b <= 11 * a for a, b in zip(small, large, strict=True))


def test_dates_of_entries_from_the_nearest_that_tells_one(spark):
    import datetime

    from chatloom.operators import history

    link = lambda k, more="": f"<div><a href='/c/{k:08d}'><span>Note of n{k}</span> {more}</a></div>"
    html = f"<body><h2>2025-01-02</h2><aside><section><h3>Chats</h3><h3>Yesterday</h3>{link(1)}{link(2, '<span>2025-03-04</span>')}</section><h4>2025-05-06</h4><section>{link(3)}{link(4)}</section><section>{link(5)}{link(6)}</section></aside></body>"
    pages = spark.createDataFrame([("https://chatgpt.com/", html), ("https://chatgpt.com/empty", None), ("https://chatgpt.com/none", "<a href='/about'>x</a>")], "url string, html string")
    got = {int(r.url[-2:]): (r.conversation_time, r.title) for r in history.history_entries(pages, datetime.date(2026, 6, 15)).collect()}
    assert got == {1: ("2026-06-14", "Note of n1"), 2: ("2025-03-04", "Note of n2"), 3: ("2025-05-06", "Note of n3"), 4: ("2025-05-06", "Note of n4"), 5: ("2025-05-06", "Note of n5"), 6: ("2025-05-06", "Note of n6")}
