import json

import pytest
from pyspark.sql import functions as F

from chatloom.operators import messages as ms
from chatloom.operators import render, sync, validate
from chatloom.sources import files, pages
from chatloom.sources.payloads import SHAPES, Limits, scan_payload, scan_payloads


def talk(platform, body, url="u"):
    return [e for e in scan_payload(platform, url, body if isinstance(body, str) else json.dumps(body), 2026) if e["kind"] == "conversation"]


def said(event):
    return [(m["role"], m["content"]) for m in event["messages"]]


def test_claude():
    (e,) = talk("claude", {"uuid": "abc-1", "name": "N", "created_at": "2025-01-02T03:04:05Z", "chat_messages": [{"sender": "human", "content": [{"type": "text", "text": "hi"}]}, {"sender": "assistant", "content": [{"type": "thinking", "text": "no"}, {"type": "text", "text": "yo"}]}]})
    assert (e["conversation_id"], e["title"], e["time"]) == ("abc-1", "N", "2025-01-02T03:04:05.000Z")
    assert said(e) == [("user", "hi"), ("assistant", "yo")]


def test_grok_takes_its_id_from_the_address_and_ignores_updates():
    url = "https://grok.com/rest/app-chat/conversations/aaaaaaaa-1111/responses"
    (e,) = talk("grok", {"responses": [{"sender": "ASSISTANT", "createTime": "2025-01-01T00:00:01Z", "message": "a"}, {"sender": "human", "createTime": "2025-01-01T00:00:00Z", "message": "q"}, {"sender": "human", "message": "part", "partial": True}]}, url)
    assert e["conversation_id"] == "aaaaaaaa-1111" and said(e) == [("user", "q"), ("assistant", "a")]
    assert scan_payload("grok", "https://grok.com/rest/app-chat/conversations", json.dumps({"conversations": [{"conversationId": "x", "updatedAt": "2025-01-01T00:00:00Z"}]}), 2026) == []


def test_deepseek_leaves_reasoning_out():
    (e,) = talk("deepseek", {"data": {"biz_data": {"chat_session": {"id": "s1", "title": "T", "updated_at": 1}, "chat_messages": [{"role": "USER", "inserted_at": 1735689600.5, "content": "q"}, {"role": "ASSISTANT", "inserted_at": 1735689601, "fragments": [{"type": "THINK", "content": "no"}, {"type": "RESPONSE", "content": "a"}]}]}}})
    assert (e["conversation_id"], e["title"], e["time"]) == ("s1", "T", "2025-01-01T00:00:00.500Z")
    assert said(e) == [("user", "q"), ("assistant", "a")]


def test_doubao_numbers_roles_and_takes_time_from_messages_only():
    rows = [{"conversation_id": "77", "user_type": k, "create_time": 1735689600 + k, "content": json.dumps({"text": x})} for k, x in ((1, "q"), (2, "a"))]
    (e,) = talk("doubao", {"server_time": 1700000000, "downlink_body": {"x": {"messages": rows}}})
    assert e["conversation_id"] == "77" and e["time"] == "2025-01-01T00:00:01.000Z" and said(e) == [("user", "q"), ("assistant", "a")]
    wrapped = {"data": {"messages": [{"message": r} for r in rows]}}
    assert said(talk("doubao", wrapped)[0]) == [("user", "q"), ("assistant", "a")]


def test_gemini_rpc_text():
    turn = lambda s, q, a: [["c_deadbeef01", "r_1"], None, [[q]], [[["rc_1", [a]]]], [s, 5000000]]
    body = ")]}'\n\n12\n" + json.dumps([["wrb.fr", "x", json.dumps([turn(1735689700, "q2", "a2"), turn(1735689600, "q1", "a1")])]]) + "\n"
    (e,) = talk("gemini", body)
    assert e["conversation_id"] == "deadbeef01" and said(e) == [("user", "q1"), ("assistant", "a1"), ("user", "q2"), ("assistant", "a2")]
    listed = json.dumps([["wrb.fr", "y", json.dumps([["c_deadbeef02", "Title", None, None, None, [1735689600, 0]]])]])
    (t,) = scan_payload("gemini", "u", listed, 2026)
    assert (t["conversation_id"], t["title"], t["time"]) == ("deadbeef02", "Title", "2025-01-01T00:00:00.000Z")


def test_chatgpt_graph():
    say = lambda i, parent, role, x, **more: {"id": i, "parent": parent, "message": {"author": {"role": role}, "recipient": "all", "create_time": 1735689600, "content": {"content_type": "text", "parts": [x]}, **more}}
    graph = {"root": {"id": "root", "parent": None, "message": None}, "a": say("a", "root", "user", "q"), "b": say("b", "a", "assistant", "one "), "c": say("c", "b", "assistant", "two"), "x": say("x", "a", "assistant", "other branch"), "t": say("t", "c", "assistant", "tool", recipient="python")}
    (e,) = talk("chatgpt", {"id": "g1", "title": "T", "create_time": 1735689600.25, "current_node": "t", "mapping": graph})
    assert said(e) == [("user", "q"), ("assistant", "one two")] and e["time"] == "2025-01-01T00:00:00.250Z"


def test_broken_payloads_give_nothing(spark):
    for platform in SHAPES:
        for body in ("", "{", "[]", "null", "[[[[]]]]", '{"a": [1, 2, {"b": null}]}', "x" * 50):
            assert talk(platform, body) == []
    frame = spark.createDataFrame([("https://claude.ai/api/organizations/o/chat_conversations/1", "{"), ("https://example.com/", "{}"), (None, None)], "url string, body string")
    assert scan_payloads(frame, 2026).count() == 0


def test_page_adapters():
    html = "<head><title>x</title></head><body><main><h1>My talk</h1><user-query><div class='query-text'>Hello there</div></user-query><model-response><div class='markdown'><p>Hi <b>you</b></p></div></model-response></main>"
    got = pages.extract(html, "gemini")
    assert got["title"] == "My talk" and [(m["role"], m["content"]) for m in got["messages"]] == [("user", "Hello there"), ("assistant", "Hi **you**")]
    layout = pages.extract("<main><div class='bubble self-end'>question one</div><div class='bubble self-start'>an answer</div><nav><div class='bubble'>menu</div></nav></main>", "doubao")
    assert [m["role"] for m in layout["messages"]] == ["user", "assistant"]
    node = pages.parse("<div id=a class='x y'><p data-t='AbC'>t</p></div>").find("p")
    for selector, expected in (("p", True), ("div p", True), ("#a p[data-t='AbC']", True), ("[data-t*='b' i]", True), ("[data-t*='B']", False), (".x .z, p[data-t]", True), (".z p", False)):
        assert pages.matches(node, selector) is expected


def test_dedupe_merge_echo_and_alignment(spark):
    rows = [(1, 0, "user", "Hello  there"), (1, 1, "assistant", "Hello there"), (1, 2, "user", "Hello there"), (1, 3, "assistant", "x"), (1, 4, "assistant", "A fairly long answer that goes on"), (1, 5, "assistant", "A fairly long answer that goes on and on, much longer than before"), (2, 0, "assistant", "“q”"), (2, 1, "user", '"q"')]
    m = spark.createDataFrame(rows, "conv_id long, seq long, role string, content string")
    assert sorted((r.conv_id, r.seq) for r in ms.dedupe(m).collect()) == [(1, 0), (1, 5), (2, 0)]
    assert sorted((r.conv_id, r.seq) for r in ms.drop_echoes(m).collect()) == [(1, 0), (1, 2), (1, 3), (1, 4), (1, 5), (2, 1)]
    times = spark.createDataFrame([(1, 0, "assistant", "t0"), (1, 1, "user", "t1"), (1, 2, "assistant", "t2"), (1, 3, "user", "")], "conv_id long, seq long, role string, time string")
    aligned = ms.align_times(m.withColumn("time", F.lit("")), times).where("conv_id = 1").orderBy("seq").collect()
    assert [r.time for r in aligned] == ["t1", "t2", "", "", "", ""]


def test_media_flags_of_messages_and_attachments(spark):
    schema = "conv_id long, seq long, role string, content string, needs_media boolean, attachments array<struct<type: string, local_path: string, exported: boolean, downloaded: boolean, needs_media: boolean>>"
    rows = [(1, 0, "user", "![x](http://a)", False, None), (2, 0, "user", "t", None, [("image/png", None, None, None, None)]), (3, 0, "user", "t", None, [("image/png", "a.png", None, None, None)]), (4, 0, "user", "![x](a.png)", None, None), (5, 0, "user", "[file: 1]", None, None)]
    got = {r.conv_id: r.needs_media for r in ms.needs_media(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: False, 2: True, 3: False, 4: False, 5: True}


def test_documents_on_disk_and_back(spark, tmp_path):
    m = spark.createDataFrame([(1, 0, "user", 'Say "hi"'), (1, 1, "assistant", "hi")], "conv_id long, seq long, role string, content string")
    meta = spark.createDataFrame([(1, "Claude", "https://claude.ai/chat/abcdefgh", 'A "quoted" talk', "2025-01-02", "abcdefgh")], "conv_id long, platform string, source_url string, title string, conversation_time string, conversation_id string")
    docs = render.documents(meta, m).select(F.concat(F.lit("../Claude/"), "filename").alias("path"), "markdown")
    assert files.write_markdown(docs, str(tmp_path))["files"] == 1
    assert files.write_markdown(docs, str(tmp_path))["renamed"] == 1
    assert files.write_markdown(docs, str(tmp_path), "overwrite")["renamed"] == 0
    scanned = files.scan_markdown(spark, str(tmp_path))
    names = sorted(r.relative_path for r in scanned.collect())
    assert names == ["Claude/2025-01-02_Claude_A_quoted_talk (1).md", "Claude/2025-01-02_Claude_A_quoted_talk.md"]
    found = files.exported_files(scanned).collect()
    assert {(r.platform, r.conversation_id, r.title, r.platform_folder) for r in found} == {("Claude", "abcdefgh", 'A "quoted" talk', "Claude")}
    checked = validate.validate(scanned.select(F.col("basename").alias("filename"), "markdown")).collect()
    assert all(r.errors == [] and r.platform == "Claude" for r in checked)
    rolled = validate.roll_up(validate.validate(scanned.select(F.col("basename").alias("filename"), "markdown"))).first()
    assert rolled.missing == "ChatGPT,Gemini,Grok" and rolled.n_failed == 1
    (tmp_path / "index.json").write_text(files.snapshot_json(files.exported_files(scanned)).first().json)
    again = files.read_snapshot(spark, str(tmp_path / "index.json"))
    assert sorted(r.relative_path for r in again.collect()) == names
    assert files.read_snapshot(spark, str(tmp_path / "none.json")).count() == 0
    with pytest.raises(ValueError):
        files.write_markdown(docs, str(tmp_path), "other")
    keys = sync.export_index_keys(files.exported_files(scanned))
    items = spark.createDataFrame([(1, "Claude", "abcdefgh", "https://claude.ai/chat/abcdefgh", "t", "", "", "")], "ord long, platform string, conversation_id string, url string, title string, conversation_time string, raw_date string, filename string")
    none = spark.createDataFrame([], "platform string, conversation_id string, url string, message_count long, backed_up_at string")
    row = sync.classify(items, keys, none).first()
    assert (row.rule, row.needs_update_check, row.previous_message_count) == ("conversation_id", True, 0)
    assert not sync.classify(items, keys, none, force_reexport=True).first().needs_update_check


def test_downloads(spark):
    body = "---\nplatform: \"Grok\"\nconversation_id: 'x1'\n---\n"
    import base64

    rows = [(1, "/home/AI Chat History/Grok/a.md", "data:text/markdown;base64," + base64.b64encode(body.encode()).decode(), True), (2, "/home/AI Chat History/Grok/b.md", "blob:x", False), (3, "/home/other/c.md", "", True)]
    (r,) = files.downloads(spark.createDataFrame(rows, "id long, filename string, url string, exists boolean")).collect()
    assert (r.relative_path, r.basename, r.platform_folder, r.platform, r.conversation_id) == ("Grok/a.md", "a.md", "Grok", "Grok", "x1")


def test_payloads_are_searched_in_whole():
    pair = [{"sender": "human", "text": "q"}, {"sender": "assistant", "text": "a"}]
    wide = {"uuid": "w-1", "chat_messages": pair * 900}
    deep = {"uuid": "d-1", "chat_messages": pair}
    for _ in range(60):
        deep = {"inner": [deep]}
    assert len(talk("claude", wide)[0]["messages"]) == 1800 and len(talk("claude", deep)) == 1
    turn = json.dumps([["wrb.fr", "x", json.dumps([[["c_deadbeef01", "r"], None, [["q"]], [[["rc_1", ["a"]]]], [1735689600, 0]]])]])
    assert len(talk("gemini", ")]}'\n" + "1\n" * 200 + turn)) == 1
    kinds = lambda body, limits: [e["kind"] for e in scan_payload("claude", "u", json.dumps(body), 2026, limits)]
    assert kinds(deep, Limits(depth=12)) == ["skipped"] and "skipped" in kinds(wide, Limits(widest=1000))
    assert scan_payload("claude", "u", "[" * 100000, 2026) == [] and scan_payload("claude", "u", '{"a":' * 900 + "1" + "}" * 900, 2026) in ([], [{"kind": "skipped", "conversation_id": "", "title": "", "time": "", "updated_at": "", "messages": []}])


class Held:
    """A key's state as a stream keeps it."""

    def __init__(self):
        self.value, self.hasTimedOut, self.timeout = None, False, None

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def update(self, value):
        self.value = value

    def remove(self):
        self.value = None

    def setTimeoutDuration(self, ms):
        self.timeout = ms


def test_times_of_a_stream_expire():
    import pandas as pd

    from chatloom.streaming import state

    row = lambda time: iter([pd.DataFrame({"ord": [1], "timestamp": [time], "platform": ["Claude"], "title": ["t"], "updated_at": [""]})])
    held = Held()
    (first,) = state._fold_times(("c1",), row("2025-02-01"), held, True)
    (same,) = state._fold_times(("c1",), row("2025-03-01"), held, True)
    assert first.timestamp[0] == same.timestamp[0] == "2025-02-01" and held.timeout == 30 * 24 * 3600 * 1000
    held.hasTimedOut = True
    assert list(state._fold_times(("c1",), iter([]), held, True)) == [] and not held.exists
    held.hasTimedOut = False
    (again,) = state._fold_times(("c1",), row("2025-03-01"), held, True)
    assert again.timestamp[0] == "2025-03-01"


def test_paths_of_long_chains_branches_and_cycles(spark):
    from chatloom.operators import graph

    chain = [(1, f"n{k}", f"n{k - 1}" if k else None) for k in range(1000)] + [(1, "side", "n500")]
    odd = [(2, "a", "b"), (2, "b", "c"), (2, "c", "a"), (3, "x", "gone"), (None, "q", None), (4, "r", "s"), (4, "s", None), (4, "s", None)]
    nodes = spark.createDataFrame(chain + odd, "conv_id long, node string, parent string")
    starts = spark.createDataFrame([(1, "n999"), (2, "a"), (3, "x"), (4, "r"), (4, "missing")], "conv_id long, node string")
    got = {(r.conv_id, r.node): r.depth for r in graph.paths(nodes, starts).collect()}
    assert got == {(1, f"n{k}"): 999 - k for k in range(1000)} | {(2, "a"): 0, (2, "b"): 1, (2, "c"): 2, (3, "x"): 0, (4, "r"): 0, (4, "s"): 1}
    assert graph.paths(nodes.limit(0), starts).count() == 0


def test_alignment_and_enrichment_give_each_row_once(spark):
    m = spark.createDataFrame([(1, 0, "user", "a", ""), (1, 0, "user", "b", ""), (None, 1, "user", "c", ""), (1, None, "assistant", "d", "x")], "conv_id long, seq long, role string, content string, time string")
    source = spark.createDataFrame([(1, 0, "user", "t0"), (1, 1, "user", "t1"), (None, 0, "user", "t2")], "conv_id long, seq long, role string, time string")
    assert sorted((r.content, r.time) for r in ms.align_times(m, source).collect()) == [("a", "t0"), ("b", "t1"), ("c", "t2"), ("d", "x")]
    talks = spark.createDataFrame([(1, "Claude", "k", "", ""), (2, "Claude", "", "", "")], "conv_id long, platform string, conversation_id string, title string, conversation_time string")
    cached = spark.createDataFrame([("Claude", "k", "old", "t", 1), ("Claude", "k", "new", None, 2), ("Claude", "k", "new", None, 2)], "platform string, conversation_id string, title string, conversation_time string, cached_at long")
    assert sorted((r.conv_id, r.conversation_id, r.title, r.conversation_time) for r in ms.enrich(talks, cached).collect()) == [(1, "k", "new", ""), (2, "k", "new", "")]


def test_unique_paths_take_the_free_counters(spark):
    files_ = spark.createDataFrame([("a/x.md", k) for k in range(7)] + [("a/y.md", 0), ("a/y.md", 1)], "path string, k long")
    existing = spark.createDataFrame([(p,) for p in ("a/x.md", "a/x (2).md", "a/x (3).md", "a/x (6).md", "a/x (90).md", "a/y (1).md")], "path string")
    got = {(r.path, r.k): r.target for r in sync.unique_paths(files_, existing).collect()}
    assert [got["a/x.md", k] for k in range(7)] == [f"a/x ({n}).md" for n in (1, 4, 5, 7, 8, 9, 10)]
    assert [got["a/y.md", k] for k in range(2)] == ["a/y.md", "a/y (2).md"]


def test_the_first_plausible_time_of_a_list():
    from chatloom.sources.evidence import nearby_time

    assert nearby_time(["x", 7, True, [1735689600, 5], 1735776000], 2026) == "2025-01-01T00:00:00.000Z"
    assert nearby_time([[1, 2, 3, 1735689600], [], "1735689600"], 2026) == "" and nearby_time(None, 2026) == ""
