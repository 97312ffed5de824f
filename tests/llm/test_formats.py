import gzip
import hashlib
import itertools

import duckdb
import pytest

from chatloom.llm import chat_format, warc
from chatloom.llm.workspace import Workspace


def read_back(rows):
    """Turns and learned texts of format_windows() output, by plain string work."""
    out = {}
    for r in sorted(rows, key=lambda r: r.window):
        turns = [t.split("[INST]", 1) for t in r.text.split("</s>")[:-1]]
        plain = []
        for role, body in turns:
            x = [role.removeprefix("<s>"), body.removesuffix("[/INST]")]
            for a, b in reversed(chat_format.ESCAPES):
                x = [y.replace(b, a) for y in x]
            plain.append(tuple(x))
        learned = [r.text[s.start : s.start + s.length] for s in r.loss]
        for a, b in reversed(chat_format.ESCAPES):
            learned = [y.replace(b, a) for y in learned]
        own = out.setdefault(r.conv_id, ([], []))
        own[0].extend(plain[r.n_repeated :])
        own[1].extend(learned)
    return out


@pytest.mark.parametrize("budget, history", [(1024, 128), (64, 16), (40, 0)])
def test_windows_round_trip(spark, budget, history):
    rows = [(1, 0, "system", "be kind"), (2, 0, "user", None), (2, 1, None, "x"), (2, 1, None, "x"), (3, 5, "assistant", "<s>~1[/INST]</s>[INST]~"), (None, 0, "user", "who"), (4, 0, "system", "s " * 500), (4, 1, "assistant", "a 🎉 é")]
    for c in range(10, 16):
        rows += [(c, 0, "system", "short rule")] * (c % 2)
        rows += [(c, t, "user" if t % 2 else "assistant", f"{c} {t} </s> " * (1 + (t * c) % 9)) for t in range(1, 25)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS window", "2 AS tokens")
    windows = chat_format.format_windows(frame, budget, history).collect()
    got = read_back(windows)
    for c, own in itertools.groupby(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2] or "", r[3] or "")), key=lambda r: r[0]):
        turns = [(r[2] or "", r[3] or "") for r in own]
        assert got[c][0] == turns
        assert got[c][1] == [x for role, x in turns if role == "assistant"]
    for w in windows:
        assert w.tokens <= budget or w.over_budget
        if w.conv_id in (11, 13, 15):
            assert w.text.startswith("<s>system[INST]short rule")
        if w.over_budget and w.conv_id != 4:
            assert budget < 200
    if budget == 64:
        assert any(w.n_repeated > 1 for w in windows if w.conv_id == 11) and len([w for w in windows if w.conv_id == 11]) > 3


def test_no_turns(spark):
    assert chat_format.format_windows(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_chat_query_against_sql(spark, tmp_path):
    rows = [(c, t, ("system", "user", "assistant")[min(t, 1 + (t + 1) % 2)], f"text {t} " * (30 * t * c + 1)) for c in range(12) for t in range(8)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted(map(tuple, chat_format.op2_chat_windows(spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS FROM '{tmp_path}/conversations.parquet/*.parquet'")
    names = "conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars"
    assert got == sorted(con.execute(f"SELECT {names} FROM ({chat_format.ORACLE}) x").fetchall())


def test_arc_lines_and_lengths():
    block = b"HTTP/1.1 200 OK\r\nX-Page-Id: 5\r\n\r\nbody\n\nhttp://not a record 1 2 3 4\n"
    for version in (1, 2):
        image = warc.arc_image("a.arc", version, [("http://a/b c", "1.2.3.4", "20010203040506", "text/html", block), ("dns:x", "1.2.3.4", "2001", "text/dns", b"")])
        got = list(warc.parse_arc(image))
        assert [c.url for c in got] == ["filedesc://a.arc", "http://a/b c", "dns:x"]
        assert got[1].block == block and got[2].block == b""
        assert len(list(warc.parse_arc(image[:-10]))) == 2
        records = [h for c in got for h in warc.parse_warc(warc.warc_record("a.arc", c))]
        assert [h["warc-type"] for h, _ in records] == ["warcinfo", "response", "resource"]
        assert records[1][0]["warc-date"] == "2001-02-03T04:05:06Z" and records[1][1] == block
        assert warc.warc_record("a.arc", got[1]) == warc.warc_record("a.arc", got[1])


def test_pages_become_records_and_revisits(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "IMAGE_BYTES", 5000)
    long, short = "<p>é</p>" * 200, "x"
    rows = [(1, "http://a", long), (2, "http://b", long), (9, "http://c\n d", long), (3, "http://a", short), (4, None, short), (5, "u", None), (6, "u", ""), (7, "u", "a\r\n\r\nWARC/1.1\r\n" * 300), (8, "http://a", long + " "), (8, "http://a", long + " ")]
    rows += [(100 + k, f"http://e/{k}", "z" * 1000) for k in range(30)]
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    got = warc.op5_warc_from_arc(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and all(r.payload_ok for r in got)
    last = {}
    for i, _, x in rows:
        last[x or ""] = max(i, last.get(x or "", i))
    seen = [r for r in got if r.page_id != 8]
    for r in seen:
        data = next(x or "" for i, _, x in rows if i == r.page_id)
        raw = data.encode()
        to = last[data] if len(raw) >= 1000 and last[data] != r.page_id else None
        assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
        assert (r.record_type, r.refers_to) == ("revisit" if to else "response", to)
    assert sorted(r.record_type for r in got if r.page_id == 8) == ["response", "revisit"]


@pytest.mark.parametrize("limit", [0, 2])
def test_hot_payloads_and_shuffled_revisits(spark, tmp_path, monkeypatch, limit):
    """A payload of a third of all pages, with clashing columns, by broadcast and by shuffled joins."""
    monkeypatch.setattr(warc, "HOT_COPIES", 5)
    monkeypatch.setattr(warc, "BROADCAST_ROWS", limit)
    rows = [(k, f"http://e/{k}", "z" * 1500 if k % 3 == 0 else f"{k // 4}" * 1200) for k in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS image", "'x' AS archive", "2 AS sha1").repartition(4)
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    got = {(r.page_id, r.record_type, r.refers_to) for r in warc.op5_warc_from_arc(spark, str(tmp_path)).collect()}
    last = {}
    for i, _, x in rows:
        last[x] = i
    assert got == {(i, "response", None) if last[x] == i else (i, "revisit", last[x]) for i, _, x in rows}


def test_archives_as_files_and_no_pages(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a", "hi")], "page_id long, url string, html string")
    warc.write_archives(warc.archives_of_pages(pages), f"{tmp_path}/arc")
    (image,) = filter(None, (gzip.decompress(x.read_bytes()) for x in tmp_path.glob("arc/part-*.gz")))  # an empty partition leaves an empty file
    assert [c.url for c in warc.parse_arc(image)][1:] == ["http://a"]
    (row,) = warc.archives_of_pages(pages).collect()
    assert image == row.image
    work = Workspace(spark, "t")
    warc.write_archives(warc.archives_of_pages(pages.limit(0)), f"{tmp_path}/none")
    assert warc.warc_records(warc.arc_to_warc(warc.read_archives(spark, f"{tmp_path}/none"), work)).count() == 0


def test_any_bytes_survive_files(spark, tmp_path):
    images = [(f"{k}", bytes(range(256)) * 3 + end) for k, end in enumerate((b"", b"\n", b"\r\n\r\n", b"\xff\n\n"))]
    warc.write_archives(spark.createDataFrame(images, "archive string, image binary"), f"{tmp_path}/any")
    got = sorted(x for r in warc.read_archives(spark, f"{tmp_path}/any").collect() if (x := gzip.decompress(r.image)))
    assert got == sorted(x if x.endswith(b"\n") else x + b"\n" for _, x in images)


def test_broken_warc_records_end_their_archive():
    one = warc.warc_record("a.arc", warc.Capture(0, "http://a", "-", "20010203040506", "text/html", b"HTTP/1.1 200 OK\r\n\r\nbody"))
    assert len(list(warc.parse_warc(one + one))) == 2
    assert len(list(warc.parse_warc(one + one[:-8]))) == 1
    assert list(warc.parse_warc(one.replace(b"Content-Length", b"X-Length"))) == []
    assert len(list(warc.parse_warc(one + b"junk" + one))) == 1
