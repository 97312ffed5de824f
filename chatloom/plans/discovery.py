"""Queries of history lists, conversation times, overrides, structured copies and evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls
from ..operators import history
from ..operators import messages as ms
from ..sources import evidence as ev
from . import derived as d
from .catalogue import _MESSAGES, AS_OF, md5, meta, query, said

_CANDIDATES = f"""SELECT conv_id, 0 AS ord, CASE WHEN conv_id % 3 = 0 THEN 'New chat' ELSE platform END AS candidate, '' AS raw FROM ({d.CONV_META}) m
  UNION ALL SELECT conv_id, 1, CASE conv_id % 4 WHEN 0 THEN concat('Notes of ', conversation_id, ' 2025-03-04 Recent') WHEN 1 THEN concat('更多选项 Plan of ', conversation_id, ' Mar 5, 2025') WHEN 2 THEN concat('Pinned  Talk of ', conversation_id, ' 今天') ELSE '12/24 yesterday' END, CASE conv_id % 4 WHEN 2 THEN '今天' ELSE '' END FROM ({d.CONV_META}) m"""


@query(f"""SELECT conv_id, CASE conv_id % 4 WHEN 0 THEN concat('Notes of ', conversation_id) WHEN 1 THEN concat('Plan of ', conversation_id) WHEN 2 THEN concat('Talk of ', conversation_id)
  ELSE CASE WHEN conv_id % 3 = 0 OR platform IN ('ChatGPT', 'DeepSeek', 'Doubao') THEN '' ELSE platform END END AS title FROM ({d.CONV_META}) m""")
def history_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.best_title(d.derived(spark, sf_dir, _CANDIDATES, "conversations"), ["conv_id"])


@query(f"""SELECT split_part(source_url, '/', 3) AS host, platform, source_url AS url, conversation_id, concat('Note of ', conversation_id) AS title, CASE WHEN conv_id % 3 = 0 THEN '{AS_OF.replace(day=AS_OF.day - 1)}' ELSE '2025-03-04' END AS conversation_time,
  CASE WHEN conv_id % 3 = 0 THEN 'Yesterday' ELSE '2025-03-04' END AS raw_date, 1 AS n_links FROM ({d.CONV_META}) m""")
def history_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page per platform whose side bar lists its conversations twice, some dated, below a heading that dates the rest."""
    href = F.regexp_extract("source_url", "^[a-z]+://[^/]+(.*)$", 1)
    item = F.concat(F.lit("<div><a href='"), href, F.lit("'><span>Note of "), "conversation_id", F.lit("</span> "), F.when(F.col("conv_id") % 3 != 0, "<span>2025-03-04</span>").otherwise(""), F.lit("</a></div>"))
    x = meta(spark, sf_dir).groupBy(F.regexp_extract("source_url", "^([a-z]+://[^/]+)", 1).alias("root")).agg(F.array_join(F.sort_array(F.collect_list(item)), "").alias("items"))
    html = F.concat(F.lit("<body><aside><section><h3>Yesterday</h3>"), "items", F.lit("</section></aside><main><a href='/about'>About</a><p>"), F.lit("</p></main></body>"))
    got = history.history_entries(x.select(F.concat("root", F.lit("/")).alias("url"), html.alias("html")), AS_OF)
    return got.select(F.split_part("page_url", F.lit("/"), F.lit(3)).alias("host"), "platform", "url", "conversation_id", "title", "conversation_time", "raw_date", "n_links")


_FOUND = f"SELECT platform AS page_url, row_number() OVER (PARTITION BY platform ORDER BY conv_id) - 1 AS ord, CASE WHEN conv_id % 4 = 0 THEN source_url ELSE '' END AS url, concat('T', CAST(conv_id % 5 AS VARCHAR(20))) AS title FROM ({d.CONV_META}) m"
_SIDE = f"""SELECT page_url, CASE WHEN ord < 2 THEN ord ELSE ord + 1000 END AS ord, concat('bar', CAST(ord AS VARCHAR(20))) AS url, concat('t', CAST(n % 5 AS VARCHAR(20))) AS title FROM (SELECT platform AS page_url, conv_id AS n, row_number() OVER (PARTITION BY platform ORDER BY conv_id DESC) - 1 AS ord FROM ({d.CONV_META}) m) x"""
_BY_PLACE = f"SELECT r.page_url, r.ord, r.url, r.title, CASE WHEN r.url = '' THEN s.url END AS bar FROM ({_FOUND}) r LEFT JOIN ({_SIDE}) s ON s.page_url = r.page_url AND s.ord = r.ord"


@query(f"""SELECT page_url, ord, CASE WHEN url <> '' THEN url ELSE bar END AS url, title FROM ({_BY_PLACE}) p WHERE url <> '' OR bar IS NOT NULL
  UNION ALL SELECT a.page_url, a.ord, b.url, a.title FROM (SELECT *, row_number() OVER (PARTITION BY page_url, title ORDER BY ord) AS k FROM ({_BY_PLACE}) p WHERE url = '' AND bar IS NULL) a
  JOIN (SELECT *, row_number() OVER (PARTITION BY page_url, title ORDER BY ord) AS k FROM ({_SIDE}) s WHERE NOT EXISTS (SELECT 1 FROM ({_BY_PLACE}) p WHERE p.page_url = s.page_url AND p.ord = s.ord AND p.bar IS NOT NULL)) b ON b.page_url = a.page_url AND b.k = a.k AND b.title = lower(a.title)""")
def search_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, links = (d.derived(spark, sf_dir, sql, "conversations") for sql in (_FOUND, _SIDE))
    return history.match_search_rows(rows, links).select("page_url", "ord", "url", "title")


_TIME_CACHE = "SELECT concat('user', lpad(CAST(user_id AS VARCHAR(20)), 8, '0')) AS conversation_id, CASE WHEN user_id % 3 = 0 THEN 'Claude' ELSE 'Gemini' END AS platform, 'x' AS timestamp, concat('t', CAST(user_id AS VARCHAR(20))) AS title, max(ts) AS cached_at FROM events GROUP BY user_id"


@query("""SELECT conversation_id, concat('https://gemini.google.com/app/', conversation_id) AS url, title FROM (SELECT concat('user', lpad(CAST(user_id AS VARCHAR), 8, '0')) AS conversation_id, concat('t', user_id) AS title, max(ts) AS latest FROM events WHERE user_id % 3 <> 0 GROUP BY user_id) x
  WHERE latest >= (SELECT max(ts) FROM events) - INTERVAL 600 MINUTE""")
def recent_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = d.derived(spark, sf_dir, _TIME_CACHE, "events")
    now = F.lit(d.table(spark, sf_dir, "events").agg(F.max("ts")).first()[0])
    return history.recent_cached(cache, now, 600).select("conversation_id", "url", "title")


_PLACE = "CAST(conv_id % 6 AS INT)"


@query(f"""SELECT conv_id, CASE WHEN conv_id % 7 = 0 THEN '2025-02-01T00:00:00.000Z' WHEN conv_id % 7 < 3 THEN concat('2025-03-0', 1 + conv_id % 5) WHEN conv_id % 7 = 3 THEN '2025-04-01T10:00:00Z' WHEN conv_id % 7 = 4 THEN '2025-05-01T00:00:00.000Z' WHEN conv_id % 7 = 5 THEN '2025-06-01' ELSE '' END AS conversation_time,
  CASE WHEN conv_id % 7 = 0 THEN 'cache' WHEN conv_id % 7 < 3 THEN 'messages' WHEN conv_id % 7 = 3 THEN 'document' WHEN conv_id % 7 = 4 THEN 'script' WHEN conv_id % 7 = 5 THEN 'history' ELSE '' END AS time_source FROM ({d.CONV_META}) m""")
def conversation_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's time, known to one source or to several."""
    x = meta(spark, sf_dir).withColumn("k", F.col("conv_id") % 7)
    cache = x.where("k = 0").select("conversation_id", F.lit("2025-02-01T00:00:00.000Z").alias("timestamp"))
    talks = said(spark, sf_dir).where("conv_id % 7 < 3").select("conv_id", F.concat(F.lit("2025-03-0"), (1 + F.col("conv_id") % 5).cast("string")).alias("time"))
    shown = F.when(F.col("k") <= 3, "<time datetime='2025-04-01T10:00:00Z'>then</time>").otherwise("<time>soon</time>")
    script = F.when(F.col("k") == 4, F.concat(F.lit('<script>var d = {"id": "'), "conversation_id", F.lit('", "n": 3, "create_time": "1746057600"}</script>'))).otherwise("<script>var d = {\"create_time\": 1746057601}</script>")
    pages = x.select(F.col("source_url").alias("url"), F.concat(F.lit("<body>"), shown, script, F.lit("</body>")).alias("html"))
    listed = x.where("k <= 5").select("conv_id", F.concat("source_url", F.lit("?from=list")).alias("url"), F.lit("2025-06-01").alias("conversation_time")).withColumn("url", urls.conversation_url("url")).withColumnRenamed("conv_id", "ord")
    return history.resolve_times(x.drop("k"), cache, talks, listed, pages, AS_OF.year).select("conv_id", "conversation_time", "time_source")


@query("SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INT) AS seq, role, md5(text) AS content_md5 FROM conversations")
def virtual_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each message shown three times while the list was scrolled back and forth, with thoughts in between."""
    x = said(spark, sf_dir).select("conv_id", F.col("seq").alias("place"), F.when(F.col("seq") % 2 == 0, F.col("seq").cast("string")).otherwise("").alias("key"), "role", "content")
    again = x.where("place % 2 = 0").withColumn("content", F.concat("content", F.lit(" shown later")))
    thoughts = x.withColumn("key", F.concat(F.lit("t"), F.col("place").cast("string"))).withColumn("thinking_only", F.lit(True))
    shown = x.withColumn("at", 100 - F.col("place")).unionByName(x.withColumn("at", 300 + F.col("place"))).unionByName(again.withColumn("at", 200 + F.col("place")))
    shown = shown.withColumn("thinking_only", F.lit(False)).unionByName(thoughts.withColumn("at", F.lit(0).cast("long")))
    return history.capture_virtual_list(shown).select("conv_id", "seq", "role", md5("content").alias("content_md5"))


_OVER = f"SELECT conv_id, CASE conv_id % 4 WHEN 0 THEN 'New chat' WHEN 1 THEN concat('A longer title for talk ', CAST(conv_id AS VARCHAR(20)), ' on everything') WHEN 2 THEN 'Short' ELSE '' END AS title, CASE conv_id % 3 WHEN 0 THEN '2025-07-01T10:30' WHEN 1 THEN '2025-07-01' ELSE '' END AS conversation_time, CASE WHEN conv_id % 5 = 0 THEN 'other-id' ELSE '' END AS conversation_id FROM ({d.CONV_META}) m WHERE conv_id % 6 <> 5"


@query(f"""SELECT conv_id, CASE WHEN conv_id % 6 <> 5 AND conv_id % 4 = 1 THEN concat('A longer title for talk ', conv_id, ' on everything') WHEN conv_id % 6 <> 5 AND conv_id % 4 = 2 AND conv_id % 3 = 0 THEN 'Short' ELSE title END AS title,
  CASE WHEN conv_id % 6 <> 5 AND conversation_time = '' THEN CASE conv_id % 3 WHEN 0 THEN '2025-07-01T10:30' WHEN 1 THEN '2025-07-01' ELSE '' END ELSE conversation_time END AS conversation_time, CASE WHEN conv_id % 6 <> 5 AND conv_id % 5 = 0 THEN 'other-id' ELSE conversation_id END AS conversation_id FROM ({d.CONV_META}) m""")
def title_and_time_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ms.apply_overrides(meta(spark, sf_dir), d.derived(spark, sf_dir, _OVER, "conversations")).select("conv_id", "title", "conversation_time", "conversation_id")


@query(f"""SELECT conv_id, CASE WHEN n = 0 THEN 'no messages' WHEN NOT roles THEN 'no roles' ELSE '' END AS problem FROM (SELECT m.conv_id, count(c.role) AS n, coalesce(bool_or(c.role IN ('user', 'assistant')), false) AS roles FROM ({d.CONV_META}) m LEFT JOIN (SELECT conv_id, CASE WHEN conv_id % 4 = 1 THEN 'system' ELSE role END AS role FROM conversations WHERE conv_id % 5 <> 0) c ON c.conv_id = m.conv_id GROUP BY m.conv_id) x""")
def export_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = said(spark, sf_dir).where("conv_id % 5 <> 0").withColumn("role", F.when(F.col("conv_id") % 4 == 1, "system").otherwise(F.col("role")))
    return ms.export_problem(meta(spark, sf_dir), m).select("conv_id", "problem")


@query(f"""SELECT m.conv_id, CASE WHEN m.conv_id % 3 = 0 THEN concat('Cached ', m.conversation_id) ELSE m.title END AS title, CASE WHEN m.conv_id % 2 = 0 AND m.conv_id % 5 <> 4 THEN '2025-08-01' ELSE '' END AS conversation_time, c.seq, c.role, md5(CASE WHEN m.conv_id % 4 = 0 THEN concat('copy of ', c.content) ELSE c.content END) AS content_md5, CASE WHEN m.conv_id % 5 = 4 AND m.conv_id % 4 <> 0 THEN '' ELSE concat('t', c.seq) END AS time
  FROM ({d.CONV_META}) m JOIN {_MESSAGES} c ON c.conv_id = m.conv_id WHERE NOT (m.conv_id % 5 = 4 AND (m.conv_id % 4 = 0 OR m.conv_id % 3 = 0))""")
def structured_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with texts but no times, or with nothing, beside structured copies, of each key an older one too; no copy at conv_id % 5 = 4."""
    one = lambda content, time: F.transform(F.array_sort(F.collect_list(F.struct("seq", "role", content.alias("content"), time.alias("time")))), lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"), x["time"].alias("time")))
    told = F.concat(F.lit("t"), F.col("seq").cast("string"))
    x = meta(spark, sf_dir).where("NOT (conv_id % 5 = 4 AND (conv_id % 4 = 0 OR conv_id % 3 = 0))")
    mine = said(spark, sf_dir).groupBy("conv_id").agg(one(F.col("content"), F.lit("")).alias("messages"))
    theirs = said(spark, sf_dir).where("conv_id % 5 <> 4").groupBy("conv_id").agg(one(F.concat(F.lit("copy of "), "content"), told).alias("messages"))
    pages = x.join(mine, "conv_id").withColumn("title", F.when(F.col("conv_id") % 3 == 0, "").otherwise(F.col("title"))).withColumn("conversation_time", F.lit(""))
    pages = pages.withColumn("messages", F.when(F.col("conv_id") % 4 == 0, F.slice("messages", 1, 0)).otherwise(F.col("messages")))
    copies = x.join(theirs, "conv_id").select("platform", "conversation_id", "source_url", F.concat(F.lit("Cached "), "conversation_id").alias("title"), F.when(F.col("conv_id") % 2 == 0, "2025-08-01").otherwise("").alias("conversation_time"), "messages", F.lit(2).alias("cached_at"))
    older = copies.withColumn("cached_at", F.lit(1)).withColumn("title", F.lit("an older copy"))
    got = ms.merge_structured(pages, copies.unionByName(older)).select("conv_id", "title", "conversation_time", F.posexplode("messages").alias("at", "m"))
    first = said(spark, sf_dir).groupBy("conv_id").agg(F.min("seq").alias("least"))
    rows = got.join(first, "conv_id").select("conv_id", "title", "conversation_time", (F.col("at") + F.col("least")).alias("seq"), "m.role", md5("m.content").alias("content_md5"), "m.time")
    return rows


_BODY = "SELECT page_id AS doc, concat('x c_', lpad(CAST(page_id AS VARCHAR(20)), 10, 'a'), ' [1735689600, 5000000] \"', lpad(CAST(page_id AS VARCHAR(20)), 10, 'a'), '\" 1735776000000 ', lpad(CAST(page_id + 1 AS VARCHAR(20)), 10, 'b'), '!') AS body FROM pages"


@query("SELECT page_id AS doc, lpad(CAST(page_id AS VARCHAR), 10, 'a') AS id, 2::BIGINT AS hit_count, '2,38' AS hit_indexes FROM pages UNION ALL SELECT page_id, lpad(CAST(page_id + 1 AS VARCHAR), 10, 'b'), 1, '64' FROM pages UNION ALL SELECT page_id, '1735689600', 1, '16' FROM pages UNION ALL SELECT page_id, '1735776000000', 1, '50' FROM pages")
def id_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = ev.id_hits(ev.id_places(d.derived(spark, sf_dir, _BODY, "pages")))
    return hits.select("doc", "id", "hit_count", F.array_join(F.transform("hit_indexes", lambda i: i.cast("string")), ",").alias("hit_indexes"))


@query("""SELECT doc, id, ts, distance::BIGINT AS distance, CAST(row_number() OVER (PARTITION BY doc, id ORDER BY distance, ts) AS INT) AS rank FROM (
  SELECT DISTINCT p.page_id AS doc, h.id, t.ts, abs(h.pos - t.pos) AS distance FROM pages p, LATERAL (VALUES (lpad(CAST(p.page_id AS VARCHAR), 10, 'a'), 2), (lpad(CAST(p.page_id AS VARCHAR), 10, 'a'), 38), (lpad(CAST(p.page_id + 1 AS VARCHAR), 10, 'b'), 64), ('1735689600', 16), ('1735776000000', 50)) h(id, pos), (VALUES ('2025-01-01T00:00:00.005Z', 15), ('2025-01-02T00:00:00.000Z', 50)) t(ts, pos)) x""")
def payload_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.evidence(d.derived(spark, sf_dir, _BODY, "pages"), AS_OF.year).select("doc", "id", "ts", "distance", "rank")


_RPC = "SELECT page_id AS id, CASE page_id % 4 WHEN 0 THEN concat('https://Gemini.google.com/_/data/batchexecute?rpcids=h', CAST(page_id AS VARCHAR(20)), '&f.sid=-1&rt=c') WHEN 1 THEN 'https://gemini.google.com/app?rt=c&x=1' WHEN 2 THEN 'https://gemini.google.com' ELSE 'not an address' END AS url FROM pages"


@query("SELECT page_id AS id, CASE WHEN page_id % 4 = 0 THEN concat('h', page_id) ELSE '' END AS rpc, CASE page_id % 4 WHEN 0 THEN concat('https://gemini.google.com/_/data/batchexecute?rpcids=h', page_id, '&rt=c') WHEN 1 THEN 'https://gemini.google.com/app?rt=c' WHEN 2 THEN 'https://gemini.google.com/' ELSE 'not an address' END AS label FROM pages")
def rpc_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.derived(spark, sf_dir, _RPC, "pages").select("id", urls.rpc_id("url").alias("rpc"), urls.safe_rpc_label("url").alias("label"))
