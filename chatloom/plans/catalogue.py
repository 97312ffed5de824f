"""Registered queries: one per operator, over whole tables.

What the driver tables lack (platforms, addresses, repeats) is derived from them by the rules in
derived.py, which the SQL uses too. Without SQL here: operators that parse trees or carry an order-
dependent state; tests hold those against plain models.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions import times, urls
from ..functions.html import html_links, html_to_markdown
from ..operators import graph, render, sync, validate
from ..operators import messages as ms
from ..runtime import shared_folder
from ..sources import files, pages, payloads
from ..streaming import state
from . import derived as d

AS_OF = datetime.date(2026, 6, 15)
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def said(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("seq"), "role", F.col("text").alias("content"))


def meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.derived(spark, sf_dir, d.CONV_META, "conversations")


def md5(c: str | Column) -> Column:
    return F.md5(c)


# ---------------------------------------------------------------- SQL pieces for DuckDB

_WS = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
_NOT_WS = _WS.replace("[", "[^", 1)


def s_sub(x: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({x}, '{pattern}', '{by}', 'g')"


def s_trim(x: str) -> str:
    return s_sub(x, f"^{_WS}+|{_WS}+$")


def s_white(x: str) -> str:
    y = f"replace({x}, chr(160), ' ')"
    y = f"regexp_replace({y}, '[ \\t]+\\n', chr(10), 'g')"
    y = f"regexp_replace({y}, '\\n[ \\t]+', chr(10), 'g')"
    y = s_sub(y, r"[ \t]{2,}", " ")
    y = f"regexp_replace({y}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return s_trim(y)


def s_compact(x: str) -> str:
    y = f"regexp_replace({x}, '[ \\t]+\\n', chr(10), 'g')"
    y = f"regexp_replace({y}, '\\n[ \\t]+', chr(10), 'g')"
    return s_trim(f"regexp_replace({y}, '\\n{{3,}}', chr(10) || chr(10), 'g')")


def s_cut(x: str, n: int) -> str:
    y = s_white(x)
    short = s_trim(s_sub(f"left({y}, {n})", f"{_WS}+{_NOT_WS}*$"))
    return f"CASE WHEN length({y}) <= {n} THEN {y} WHEN {short} <> '' THEN {short} ELSE {s_trim(f'left({y}, {n})')} END"


def s_slug(x: str) -> str:
    y = s_sub(s_cut(x, 80), t.ILLEGAL_IN_NAMES.replace('\\"', '"'), " ")
    return f"left({s_sub(s_sub(y, f'{_WS}+', '_'), '^_+|_+$')}, 90)"


_MESSAGES = "(SELECT conv_id, turn AS seq, role, text AS content FROM conversations)"
_TURNS = f"""SELECT *, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER w + CASE WHEN first_value(role) OVER w <> 'user' THEN 1 ELSE 0 END AS BIGINT) AS turn_number
FROM {_MESSAGES} m WINDOW w AS (PARTITION BY conv_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
_BLOCKS = f"""SELECT conv_id, seq, turn_number, concat('## Message ', turn_number, ' - ', CASE role WHEN 'assistant' THEN 'Assistant' WHEN 'system' THEN 'System' ELSE 'User' END, chr(10), chr(10), {s_compact('content')}) AS block FROM ({_TURNS}) x"""
_FIRST_LINE = "split_part(ltrim(lead, chr(10)), chr(10), 1)"
_LEADS = f"SELECT conv_id, coalesce(min_by(content, seq) FILTER (role = 'user'), min_by(content, seq)) AS lead FROM {_MESSAGES} m GROUP BY conv_id"
# Of the derived titles just the plain one is generic.
_TITLES = f"""SELECT m.*, CASE WHEN m.title <> 'New chat' THEN m.title WHEN {s_cut(_FIRST_LINE, 140)} <> '' THEN {s_cut(_FIRST_LINE, 140)} ELSE m.title END AS shown
FROM ({d.CONV_META}) m JOIN ({_LEADS}) l ON l.conv_id = m.conv_id"""
_FILE = f"concat(CASE WHEN conversation_time <> '' THEN concat(left(conversation_time, 10), '_') ELSE '' END, platform, '_', {s_slug('shown')}, '.md')"
_DOCS = f"""SELECT x.conv_id, {_FILE} AS filename, b.n_messages, x.platform, x.shown AS title, concat({s_compact(f'''concat('---', chr(10), 'status: raw', chr(10), 'needs_media: false', chr(10), 'platform: "', x.platform, '"', chr(10), 'source_url: "', source_url, '"', chr(10), 'conversation_title: "', x.shown, '"', chr(10),
  CASE WHEN conversation_time <> '' THEN concat('conversation_time: "', conversation_time, '"', chr(10)) ELSE '' END, 'conversation_id: "', conversation_id, '"', chr(10), '---', chr(10), chr(10), '# ', x.shown, chr(10), chr(10), '## Metadata', chr(10), chr(10), '- Needs media: false', chr(10), '- Platform: ', x.platform, chr(10), '- Source URL: ', source_url, chr(10),
  CASE WHEN conversation_time <> '' THEN concat('- Conversation time: ', conversation_time, chr(10)) ELSE '' END, '- Conversation ID: ', conversation_id, chr(10), chr(10), b.body)''')}, chr(10)) AS markdown
FROM ({_TITLES}) x JOIN (SELECT conv_id, string_agg(block, chr(10) || chr(10) ORDER BY seq) AS body, count(*) AS n_messages FROM ({_BLOCKS}) y GROUP BY conv_id) b ON b.conv_id = x.conv_id"""


# ---------------------------------------------------------------- messages


@query(f"SELECT conv_id, seq, role, turn_number FROM ({_TURNS}) x")
def turn_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ms.turn_numbers(said(spark, sf_dir)).select("conv_id", "seq", "role", "turn_number")


@query(f"SELECT conv_id, seq, turn_number, md5(block) AS block_md5 FROM ({_BLOCKS}) x")
def message_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.message_blocks(said(spark, sf_dir)).select("conv_id", "seq", "turn_number", md5("block").alias("block_md5"))


@query(f"SELECT conv_id, filename, n_messages, markdown FROM ({_DOCS}) x")
def conversation_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.documents(meta(spark, sf_dir), said(spark, sf_dir)).select("conv_id", "filename", "n_messages", "markdown")


@query(f"SELECT conv_id, shown AS title FROM ({_TITLES}) x")
def display_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ms.display_titles(meta(spark, sf_dir), said(spark, sf_dir)).select("conv_id", "title")


@query(f"SELECT conv_id, {_FILE} AS filename FROM ({_TITLES}) x")
def export_filenames(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = ms.display_titles(meta(spark, sf_dir), said(spark, sf_dir))
    return x.select("conv_id", t.build_filename("platform", "title", "conversation_time").alias("filename"))


@query(f"""SELECT conv_id, bool_or(regexp_matches(content, '(?i)\\[(?:image|img|media|file|attachment):[^\\]]*\\]') OR regexp_matches(content, '!\\[[^\\]]*\\]\\((?:https?:|blob:|file-service:|attachment:)')) AS needs_media FROM ({d.MESSAGES_MEDIA}) x GROUP BY conv_id""")
def needs_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ms.needs_media(d.derived(spark, sf_dir, d.MESSAGES_MEDIA, "conversations"))


@query(f"""SELECT filename, platform, array_to_string(list_filter([CASE WHEN NOT contains(markdown, '## Message 1 - User') AND NOT regexp_matches(markdown, '## Message [0-9]+ - User') THEN 'missing User turn headings' END, CASE WHEN NOT regexp_matches(markdown, '## Message [0-9]+ - Assistant') THEN 'missing Assistant turn headings' END,
  CASE WHEN NOT (contains(markdown, '## Message 1 - User') AND contains(markdown, '## Message 1 - Assistant')) THEN 'first user/assistant exchange is not numbered as Message 1' END], lambda e: e IS NOT NULL), '; ') AS errors FROM ({_DOCS}) x""")
def validate_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = render.documents(meta(spark, sf_dir), said(spark, sf_dir))
    return validate.validate(docs).select("filename", "platform", F.array_join("errors", "; ").alias("errors"))


@query(f"""SELECT count(*) AS n_files, count(*) FILTER (NOT (contains(markdown, '## Message 1 - User') AND contains(markdown, '## Message 1 - Assistant'))) AS n_failed, string_agg(DISTINCT platform, ',' ORDER BY platform) AS seen, '' AS missing FROM ({_DOCS}) x""")
def export_roll_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.roll_up(validate.validate(render.documents(meta(spark, sf_dir), said(spark, sf_dir))))


@query("SELECT conv_id, count(*) AS n_messages, bool_or(role = 'user') AS has_user, bool_or(role = 'assistant') AS has_assistant FROM conversations GROUP BY conv_id HAVING count(*) >= 2 AND bool_or(role = 'user') AND bool_or(role = 'assistant')")
def role_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ms.role_diversity(said(spark, sf_dir))


_SCORE = """SELECT conv_id, {key} n_messages, pairs, transitions, CAST(pairs * 20 + transitions * 3 + least(n_messages, CASE WHEN pairs > 0 THEN pairs * 2 + 2 ELSE 3 END) + CASE WHEN u > 0 THEN 5 ELSE 0 END + CASE WHEN a > 0 THEN 5 ELSE 0 END
  - CASE WHEN pairs > 0 THEN abs(u - a) * 2 ELSE greatest(0, n_messages - 1) * 2 END AS BIGINT) AS score
FROM (SELECT conv_id, {key} count(*) AS n_messages, count(*) FILTER (role = 'user') AS u, count(*) FILTER (role = 'assistant') AS a, least(count(*) FILTER (role = 'user'), count(*) FILTER (role = 'assistant')) AS pairs, CAST(coalesce(sum(changed), 0) AS BIGINT) AS transitions
  FROM (SELECT *, CASE WHEN role <> lag(role) OVER (PARTITION BY conv_id{part} ORDER BY seq) THEN 1 ELSE 0 END AS changed FROM {rows} r) s GROUP BY conv_id{part}) t"""


@query(_SCORE.format(key="", part="", rows=_MESSAGES))
def conversation_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ms.conversation_scores(said(spark, sf_dir))


@query(f"""SELECT conv_id, candidate, score FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, candidate) AS rn FROM (
  {_SCORE.format(key='0 AS candidate,', part='', rows=_MESSAGES)} UNION ALL {_SCORE.format(key='1 AS candidate,', part='', rows=f'({d.MESSAGES_RUNS})')}) c) b WHERE rn = 1""")
def best_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = (said(spark, sf_dir), d.derived(spark, sf_dir, d.MESSAGES_RUNS, "conversations"))
    scored = [ms.conversation_scores(m).select("conv_id", F.lit(i).alias("candidate"), "score") for i, m in enumerate(sets)]
    return ms.best_candidate(scored[0].unionByName(scored[1]))


_RUNS = f"""SELECT conv_id, min(seq) AS seq, role, string_agg(content, chr(10) || chr(10) ORDER BY seq) AS content, coalesce(min_by(time, seq) FILTER (time <> ''), '') AS time, count(*) AS n FROM (
  SELECT *, sum(CASE WHEN role <> before THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY seq) AS island FROM (SELECT *, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY seq), '') AS before FROM ({d.MESSAGES_RUNS}) r) s) t GROUP BY conv_id, island, role"""


@query(f"SELECT conv_id, seq, role, md5(content) AS content_md5, time, n::INT AS n_merged FROM ({_RUNS}) x")
def adjacent_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = ms.merge_adjacent(d.derived(spark, sf_dir, d.MESSAGES_RUNS, "conversations"))
    return m.select("conv_id", "seq", "role", md5("content").alias("content_md5"), "time", "n_merged")


@query(f"""SELECT conv_id, min(seq) AS seq, role, md5(string_agg(content, '' ORDER BY seq)) AS content_md5 FROM (SELECT *, sum(CASE WHEN role = 'assistant' AND before = 'assistant' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY seq) AS island
  FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY seq) AS before FROM ({d.MESSAGES_RUNS}) r) s) u GROUP BY conv_id, island, role""")
def continuation_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = ms.merge_continuations(d.derived(spark, sf_dir, d.MESSAGES_RUNS, "conversations"))
    return m.select("conv_id", "seq", "role", md5("content").alias("content_md5"))


@query(f"""SELECT conv_id, seq, coalesce(role, CASE WHEN (coalesce(given, 'assistant') = 'user') = ((n - last_n) % 2 = 0) THEN 'user' ELSE 'assistant' END) AS role FROM (
  SELECT *, last_value(role IGNORE NULLS) OVER w AS given, coalesce(last_value(CASE WHEN role IS NOT NULL THEN n END IGNORE NULLS) OVER w, -1) AS last_n
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY seq) - 1 AS n FROM ({d.MESSAGES_GAPS}) g) x WINDOW w AS (PARTITION BY conv_id ORDER BY seq)) y""")
def alternating_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ms.alternating_roles(d.derived(spark, sf_dir, d.MESSAGES_GAPS, "conversations")).select("conv_id", "seq", "role")


@query("SELECT conv_id, turn AS seq, CASE WHEN (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) % 2 = 0 THEN 'user' ELSE 'assistant' END AS role FROM conversations")
def parity_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ms.parity_roles(said(spark, sf_dir)).select("conv_id", "seq", "role")


_NORM = s_trim(s_sub("content", f"{_WS}+", " "))


@query(f"SELECT conv_id, seq, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role, {_NORM} ORDER BY seq) AS rn FROM ({d.MESSAGES_TWICE}) x WHERE length({s_white('content')}) >= 2) y WHERE rn = 1")
def dedupe_same_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ms.dedupe_same_role(d.derived(spark, sf_dir, d.MESSAGES_TWICE, "conversations")).select("conv_id", "seq", "role")


@query(f"""WITH m AS (SELECT conv_id, turn * 4 AS seq, role, {_NORM.replace('content', 'text')} AS norm FROM conversations WHERE length({s_white('text')}) >= 2)
SELECT conv_id, seq, role FROM m a WHERE NOT EXISTS (SELECT 1 FROM m b WHERE b.conv_id = a.conv_id AND b.role = a.role AND length(a.norm) >= 24 AND length(b.norm) >= length(a.norm) + 24 AND contains(b.norm, a.norm))""")
def dedupe_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ms.dedupe(d.derived(spark, sf_dir, d.MESSAGES_TWICE, "conversations")).select("conv_id", "seq", "role")


@query(f"SELECT conv_id, seq, role FROM ({d.MESSAGES_TWICE}) x WHERE NOT (role = 'assistant' AND EXISTS (SELECT 1 FROM ({d.MESSAGES_TWICE}) u WHERE u.conv_id = x.conv_id AND u.role = 'user' AND {_NORM.replace('content', 'u.content')} = {_NORM.replace('content', 'x.content')}))")
def echo_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ms.drop_echoes(d.derived(spark, sf_dir, d.MESSAGES_TWICE, "conversations")).select("conv_id", "seq", "role")


@query(f"""WITH m AS (SELECT conv_id, seq, role, {_NORM} AS norm FROM ({d.MESSAGES_INSIDE}) x)
SELECT conv_id, seq, role FROM m a WHERE NOT EXISTS (SELECT 1 FROM m b WHERE b.conv_id = a.conv_id AND b.role = a.role AND length(a.norm) >= 24 AND length(b.norm) >= length(a.norm) + 24 AND contains(b.norm, a.norm))""")
def contained_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ms.drop_contained(d.derived(spark, sf_dir, d.MESSAGES_INSIDE, "conversations")).select("conv_id", "seq", "role")


# The source has a time for every message but the user's at odd turns, and no conversation has users at odd and even turns.
@query("SELECT conv_id, turn AS seq, role, CASE WHEN turn % 2 = 0 OR role = 'assistant' THEN concat('2025-01-01T00:00:0', turn, 'Z') ELSE '' END AS time FROM conversations")
def align_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = said(spark, sf_dir).withColumn("time", F.lit(""))
    source = m.where("seq % 2 = 0 OR role = 'assistant'").withColumn("time", F.concat(F.lit("2025-01-01T00:00:0"), F.col("seq").cast("string"), F.lit("Z")))
    return ms.align_times(m, source).select("conv_id", "seq", "role", "time")


@query(f"SELECT conv_id, coalesce(min_by(time, seq) FILTER (time <> ''), '') AS first_time, coalesce(min(nullif(time, '')), '') AS min_time FROM ({d.MESSAGES_RUNS}) x GROUP BY conv_id")
def message_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ms.message_times(d.derived(spark, sf_dir, d.MESSAGES_RUNS, "conversations"))


_THIN = f"SELECT conv_id, platform, CASE WHEN conv_id % 2 = 0 THEN conversation_id ELSE '' END AS conversation_id, CASE WHEN conv_id % 3 = 0 THEN '' ELSE title END AS title, '' AS conversation_time FROM ({d.CONV_META}) m"
_CACHED = f"SELECT platform, conversation_id, concat('Cached ', conversation_id) AS title, conversation_time, conv_id AS cached_at FROM ({d.CONV_META}) m WHERE conv_id % 4 <> 2"


@query(f"""SELECT t.conv_id, t.platform, CASE WHEN t.title <> '' THEN t.title ELSE coalesce(c.title, '') END AS title, CASE WHEN t.conversation_id <> '' THEN t.conversation_id ELSE coalesce(c.conversation_id, '') END AS conversation_id, coalesce(c.conversation_time, '') AS conversation_time
FROM ({_THIN}) t LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY platform ORDER BY cached_at DESC) AS rn FROM ({_CACHED}) x) c ON c.platform = t.platform AND CASE WHEN t.conversation_id = '' THEN c.rn = 1 ELSE c.conversation_id = t.conversation_id END""")
def enrich_from_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ms.enrich(d.derived(spark, sf_dir, _THIN, "conversations"), d.derived(spark, sf_dir, _CACHED, "conversations")).select("conv_id", "platform", "title", "conversation_id", "conversation_time")


# ---------------------------------------------------------------- addresses and texts

_URLS = f"SELECT conv_id AS id, concat(source_url, CASE conv_id % 4 WHEN 0 THEN '?a=1#b' WHEN 1 THEN '/' WHEN 2 THEN '#x' ELSE '' END) AS url FROM ({d.CONV_META}) m UNION ALL SELECT -1 - page_id, url FROM pages"
_DETECT = "CASE WHEN url LIKE 'https://chatgpt.com/%' THEN 'chatgpt' WHEN url LIKE 'https://claude.ai/%' THEN 'claude' WHEN url LIKE 'https://gemini.google.com/%' THEN 'gemini' WHEN url LIKE 'https://grok.com/%' THEN 'grok' WHEN url LIKE 'https://chat.deepseek.com/%' THEN 'deepseek' WHEN url LIKE 'https://www.doubao.com/%' THEN 'doubao' END"
_PATH = r"regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1)"


def _some_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.derived(spark, sf_dir, _URLS, "conversations", "pages")


@query(f"SELECT id, {_DETECT} AS platform FROM ({_URLS}) u")
def detect_platform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _some_urls(spark, sf_dir).select("id", urls.detect_platform("url").alias("platform"))


@query(f"SELECT id, CASE WHEN {_DETECT} IS NULL THEN '' ELSE regexp_replace(regexp_replace(url, '[?#].*$', ''), '/$', '') END AS url FROM ({_URLS}) u")
def url_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _some_urls(spark, sf_dir).select("id", urls.conversation_url("url").alias("url"))


@query(f"SELECT id, coalesce(list_filter(string_split({_PATH}, '/'), lambda p: regexp_matches(p, '[A-Za-z0-9_-]{{8,}}'))[-1], '') AS conversation_id FROM ({_URLS}) u")
def url_conversation_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _some_urls(spark, sf_dir).select("id", urls.last_id_segment("url").alias("conversation_id"))


@query(f"SELECT conv_id, lower(concat(platform, ':', conversation_id)) AS identity, lower(concat(platform, ':', source_url)) AS source, concat(platform, ':', conversation_id) AS registry, lower(concat(platform, ':', conversation_id)) AS discovered FROM ({d.CONV_META}) m")
def identity_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return meta(spark, sf_dir).select("conv_id", urls.identity_key("platform", "conversation_id").alias("identity"), urls.source_url_key("platform", "source_url").alias("source"), urls.registry_key("platform", "conversation_id", "source_url").alias("registry"), urls.discovered_key("platform", "conversation_id", "source_url").alias("discovered"))


@query(f"SELECT doc_id, md5({s_white('text')}) AS white_md5, md5({s_trim(s_sub('text', f'{_WS}+', ' '))}) AS norm_md5 FROM documents")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.table(spark, sf_dir, "documents").select("doc_id", md5(t.normalize_whitespace("text")).alias("white_md5"), md5(t.normalize_for_dedupe("text")).alias("norm_md5"))


_MARKED = "SELECT doc_id, concat('# Head', chr(10), chr(10), CASE WHEN doc_id % 2 = 0 THEN concat('- one', chr(10), '2. two', chr(10)) ELSE '' END, CASE WHEN doc_id % 3 = 0 THEN concat('```sql', chr(10), 'x', chr(10), '```', chr(10)) ELSE '' END, '> q', chr(10), '| a | b |', chr(10), chr(10), text) AS md FROM documents"


@query(f"""SELECT doc_id, CAST(len(regexp_extract_all(md, '(?m)^#{{1,6}}\\s+')) * 120 + len(regexp_extract_all(md, '(?m)^```')) * 90 + len(regexp_extract_all(md, '(?m)^(?:\\s*[-*]\\s+|\\s*\\d+\\.\\s+)')) * 35 + len(regexp_extract_all(md, '(?m)^\\|.+\\|$')) * 25
  + len(regexp_extract_all(md, '(?m)^>\\s+')) * 25 + len(list_filter(regexp_split_to_array(md, '\\n{{2,}}'), lambda p: trim(p, ' ' || chr(9) || chr(10) || chr(13)) <> '')) * 3 AS INT) AS score FROM ({_MARKED}) m""")
def content_structure_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.derived(spark, sf_dir, _MARKED, "documents").select("doc_id", t.structure_score("md").cast("int").alias("score"))


_CODE = "SELECT doc_id, concat(text, chr(10), CASE doc_id % 5 WHEN 0 THEN '  int main(void)' WHEN 1 THEN 'def f(x):' WHEN 2 THEN 'git status' WHEN 3 THEN 'print (1)' ELSE 'x = 1' END) AS code FROM documents"


@query(f"SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'c' WHEN 1 THEN 'python' WHEN 2 THEN 'bash' WHEN 3 THEN 'python' ELSE '' END AS language FROM ({_CODE}) c")
def infer_code_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.derived(spark, sf_dir, _CODE, "documents").select("doc_id", t.infer_code_language("code").alias("language"))


# ---------------------------------------------------------------- times

_NUMBER = "CASE WHEN regexp_matches(raw, '^[0-9]+$') THEN CAST(raw AS BIGINT) END"
_NORMALIZED = f"""SELECT event_id, user_id, raw, coalesce(strftime(CASE WHEN {_NUMBER} > 1000000000000000 THEN make_timestamp({_NUMBER} // 1000 * 1000) WHEN {_NUMBER} > 1000000000000 THEN make_timestamp({_NUMBER} * 1000) WHEN {_NUMBER} > 1000000000 THEN make_timestamp({_NUMBER} * 1000000)
  WHEN raw LIKE 'at %' THEN CAST(replace(substring(raw, 4), 'Z', '') AS TIMESTAMP) END, '%Y-%m-%dT%H:%M:%S.%gZ'), '') AS iso FROM ({d.RAW_TIMES_DUCK}) r"""


@query(f"SELECT event_id, iso FROM ({_NORMALIZED}) n")
def normalize_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.derived(spark, sf_dir, d.RAW_TIMES_SPARK, "events").select("event_id", times.normalize_timestamp("raw").alias("iso"))


@query(f"SELECT event_id, CASE WHEN CAST(left(nullif(iso, ''), 4) AS INT) BETWEEN 2020 AND {AS_OF.year + 1} THEN iso ELSE '' END AS iso FROM ({_NORMALIZED}) n")
def plausible_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.derived(spark, sf_dir, d.RAW_TIMES_SPARK, "events").select("event_id", times.valid_timestamp("raw", AS_OF.year).alias("iso"))


_DATES = "SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'Today, 10:00' WHEN 1 THEN 'yesterday' WHEN 2 THEN '2025/3/4 notes' WHEN 3 THEN 'Apr 9, 2025' WHEN 4 THEN '2025年4月10日' WHEN 5 THEN 'Dec 24' WHEN 6 THEN '2/30/2025' ELSE 'no date' END AS raw FROM events"


@query(f"SELECT event_id, CASE event_id % 8 WHEN 0 THEN '2026-06-15' WHEN 1 THEN '2026-06-14' WHEN 2 THEN '2025-03-04' WHEN 3 THEN '2025-04-09' WHEN 4 THEN '2025-04-10' WHEN 5 THEN '2025-12-24' ELSE '' END AS date, CASE event_id % 8 WHEN 0 THEN 'Today' WHEN 1 THEN 'yesterday' WHEN 2 THEN '2025/3/4' WHEN 3 THEN 'Apr 9, 2025' WHEN 4 THEN '2025年4月10日' WHEN 5 THEN 'Dec 24' WHEN 6 THEN '2/30/2025' ELSE '' END AS raw FROM ({_DATES}) r")
def history_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = d.derived(spark, sf_dir, _DATES, "events").withColumn("h", times.history_date("raw", AS_OF))
    return x.select("event_id", "h.date", "h.raw")


@query(f"""SELECT CAST(user_id AS VARCHAR) AS conversation_id, min(iso) AS timestamp, min_by('title ' || event_id, event_id) AS title, max_by(raw, event_id) AS updated_at FROM ({_NORMALIZED}) n WHERE iso <> '' GROUP BY user_id""")
def earliest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.earliest_times(_events(spark, sf_dir)).select("conversation_id", "timestamp", "title", "updated_at")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = d.derived(spark, sf_dir, d.RAW_TIMES_SPARK, "events")
    return x.select(F.col("event_id").alias("ord"), F.col("user_id").cast("string").alias("conversation_id"), F.lit("ChatGPT").alias("platform"), F.col("raw").alias("timestamp"), F.concat(F.lit("title "), F.col("event_id").cast("string")).alias("title"), F.col("raw").alias("updated_at"))


@query("SELECT user_id, cached_at FROM (SELECT user_id, max(event_id) AS cached_at FROM events GROUP BY user_id) x ORDER BY cached_at DESC, user_id DESC LIMIT 80")
def lru_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = d.table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("event_id").alias("cached_at"))
    return sync.lru(cache, "user_id", state.CONVERSATION_CACHE)


@query("SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 200")
def evidence_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = d.table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("captured_at"), F.col("event_id").alias("ord"))
    return state.ring(x).select("event_id")


# Every 20th character of the id's own place, every 50th of a time's.
_HITS = "SELECT doc_id AS doc, CAST(doc_id % 3 AS VARCHAR(20)) AS id, n_chars * k / 4 AS pos FROM documents CROSS JOIN (SELECT 1 AS k UNION ALL SELECT 2 UNION ALL SELECT 3) x"
_STAMPS = "SELECT doc_id AS doc, concat('t', CAST(k AS VARCHAR(20))) AS ts, n_chars * k / 7 AS pos FROM documents CROSS JOIN (SELECT 1 AS k UNION ALL SELECT 2 UNION ALL SELECT 5 UNION ALL SELECT 6) x"
_FLOOR = {"n_chars * k / 4": "CAST(floor(n_chars * k / 4) AS BIGINT)", "n_chars * k / 7": "CAST(floor(n_chars * k / 7) AS BIGINT)"}
for _plain, _floored in _FLOOR.items():
    _HITS, _STAMPS = _HITS.replace(_plain, _floored), _STAMPS.replace(_plain, _floored)


@query(f"""SELECT doc, id, ts, distance, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY doc, id ORDER BY distance, ts) AS INT) AS rank FROM (SELECT DISTINCT h.doc, h.id, s.ts, abs(h.pos - s.pos) AS distance FROM ({_HITS}) h JOIN ({_STAMPS}) s ON s.doc = h.doc AND abs(h.pos - s.pos) <= 12000) x) y WHERE rank <= 12""")
def band_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payloads.evidence_pairs(d.derived(spark, sf_dir, _HITS, "documents"), d.derived(spark, sf_dir, _STAMPS, "documents")).select("doc", "id", "ts", "distance", "rank")


_PARENTS = """SELECT conv_id, concat('n', CAST(turn AS VARCHAR(20))) AS node, CASE WHEN turn > 0 THEN concat('n', CAST(turn - 1 AS VARCHAR(20))) END AS parent FROM conversations
  UNION ALL SELECT conv_id, concat('x', CAST(turn AS VARCHAR(20))), concat('n', CAST(turn AS VARCHAR(20))) FROM conversations"""
_LAST = "SELECT conv_id, concat('n', CAST(max(turn) AS VARCHAR(20))) AS node FROM conversations GROUP BY conv_id"


@query(f"""WITH RECURSIVE nodes AS ({_PARENTS}), up AS (SELECT n.conv_id, n.node, n.parent, 0 AS depth FROM nodes n JOIN ({_LAST}) l ON l.conv_id = n.conv_id AND l.node = n.node
  UNION ALL SELECT n.conv_id, n.node, n.parent, depth + 1 FROM nodes n JOIN up ON up.conv_id = n.conv_id AND n.node = up.parent)
SELECT conv_id, node, CAST(depth AS INT) AS depth FROM up""")
def parent_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From each conversation's last node to the root by parents, past branches that were given up."""
    both = (d.derived(spark, sf_dir, sql, "conversations") for sql in (_PARENTS, _LAST))
    return graph.paths(*both)


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, coalesce(json_extract_string(props, '$.missing'), json_extract_string(props, '$.k'), '') AS first FROM events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.try_parse_json("props")
    pick = lambda p: F.try_variant_get(v, p, "string")
    return d.table(spark, sf_dir, "events").select("event_id", pick("$.k").alias("k"), F.coalesce(pick("$.missing"), pick("$.k"), F.lit("")).alias("first"))


# ---------------------------------------------------------------- incremental export


def _exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = d.derived(spark, sf_dir, d.EXPORTS, "conversations")
    return x.withColumn("basename", F.substring_index("relative_path", "/", -1))


_BARE = "regexp_replace(relative_path, ' \\([0-9]+\\)\\.md$', '.md')"
_KEYS = f"""SELECT DISTINCT rule, key FROM (SELECT 'conversation_id' AS rule, lower(concat(platform, ':', conversation_id)) AS key FROM ({d.EXPORTS}) e WHERE conversation_id <> ''
  UNION ALL SELECT 'source_url', lower(concat(platform, ':', regexp_replace(source_url, '\\?.*$', ''))) FROM ({d.EXPORTS}) e WHERE source_url <> ''
  UNION ALL SELECT 'filename', lower({_BARE}) FROM ({d.EXPORTS}) e UNION ALL SELECT 'filename', lower(split_part({_BARE}, '/', 2)) FROM ({d.EXPORTS}) e) k"""


@query(_KEYS)
def export_index_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.export_index_keys(_exports(spark, sf_dir))


_DEDUPED = f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY CASE WHEN conversation_id <> '' THEN lower(concat(platform, ':', conversation_id)) ELSE lower(concat(platform, ':', url)) END ORDER BY ord) AS rn FROM (
  SELECT q.*, CASE WHEN conversation_id <> '' AND EXISTS (SELECT 1 FROM k WHERE k.rule = 'conversation_id' AND k.key = lower(concat(platform, ':', conversation_id))) THEN 'conversation_id'
    WHEN EXISTS (SELECT 1 FROM k WHERE k.rule = 'source_url' AND k.key = lower(concat(platform, ':', url))) THEN 'source_url'
    WHEN EXISTS (SELECT 1 FROM k WHERE k.rule = 'filename' AND k.key IN (lower(concat(dated, named)), lower(named), lower(concat(platform, '/', dated, named)), lower(concat(platform, '/', named)))) THEN 'filename' ELSE '' END AS rule
  FROM (SELECT *, concat(platform, '_', CASE WHEN title <> '' THEN replace(title, ' ', '_') ELSE 'AI_Chat' END, '.md') AS named, CASE WHEN conversation_time <> '' THEN concat(left(conversation_time, 10), '_') ELSE '' END AS dated FROM ({d.DISCOVERED}) z) q) w) v WHERE rn = 1"""
_CLASSIFIED = f"""WITH k AS ({_KEYS}) SELECT c.ord, c.platform, c.conversation_id, c.url, c.rule, c.rule <> '' AS needs_update_check, CAST(CASE WHEN c.rule <> '' THEN coalesce(r.message_count, 0) ELSE 0 END AS BIGINT) AS previous_message_count
FROM ({_DEDUPED}) c LEFT JOIN ({d.REGISTRY}) r ON concat(r.platform, ':', r.conversation_id) = concat(c.platform, ':', CASE WHEN c.conversation_id <> '' THEN c.conversation_id ELSE c.url END)"""


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = d.derived(spark, sf_dir, d.DISCOVERED, "conversations")
    return sync.classify(items, sync.export_index_keys(_exports(spark, sf_dir)), d.derived(spark, sf_dir, d.REGISTRY, "conversations"))


@query(_CLASSIFIED)
def sync_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir).select("ord", "platform", "conversation_id", "url", "rule", "needs_update_check", "previous_message_count")


_NOW = "SELECT conv_id * 2 AS ord, count(*) AS n FROM conversations GROUP BY conv_id"
_OUTCOME = f"""SELECT x.ord, CASE WHEN n.n IS NULL THEN 'failed' WHEN NOT x.needs_update_check THEN 'new' WHEN n.n > x.previous_message_count THEN 'update' ELSE 'skip' END AS action, n.n AS message_count, x.needs_update_check FROM ({_CLASSIFIED}) x LEFT JOIN ({_NOW}) n ON n.ord = x.ord"""


def _outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = said(spark, sf_dir).groupBy((F.col("conv_id") * 2).alias("ord")).agg(F.count("*").alias("n_messages"))
    return sync.outcome(_classified(spark, sf_dir), now)


@query(f"SELECT ord, action, message_count FROM ({_OUTCOME}) o")
def sync_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outcome(spark, sf_dir).select("ord", "action", "message_count")


@query(f"""SELECT count(*) AS total, 0::BIGINT AS queued, count(*) FILTER (action IN ('new', 'update')) AS succeeded, count(*) FILTER (action = 'skip') AS skipped, count(*) FILTER (action = 'failed') AS failed, 0::BIGINT AS needs_update_check, (SELECT count(*) FROM ({d.REGISTRY}) r) AS registry FROM ({_OUTCOME}) o""")
def queue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.queue_counts(_outcome(spark, sf_dir), d.derived(spark, sf_dir, d.REGISTRY, "conversations"))


_SHOT = f"SELECT id + 1000000 AS id, relative_path, platform FROM ({d.EXPORTS}) e WHERE id % 3 <> 0 UNION ALL SELECT id + 2000000, concat('more/', relative_path), platform FROM ({d.EXPORTS}) e WHERE id % 4 = 0"


@query(f"""SELECT id, relative_path, platform, source FROM (SELECT *, row_number() OVER (PARTITION BY relative_path ORDER BY source, id) AS rn FROM (SELECT id, relative_path, platform, 'downloads' AS source FROM ({d.EXPORTS}) e WHERE id % 3 <> 1 UNION ALL SELECT *, 'snapshot' FROM ({_SHOT}) s) u) v WHERE rn = 1""")
def union_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    mine = _exports(spark, sf_dir).where("id % 3 <> 1").select("id", "relative_path", "platform")
    return sync.union_exports(mine, d.derived(spark, sf_dir, _SHOT, "conversations"))


@query(f"""SELECT lower(concat(platform, ':', substring(url, -12))) AS item_key, min(ord) AS ord, coalesce(min_by(conversation_id, ord) FILTER (conversation_id <> ''), '') AS conversation_id, coalesce(min_by(title, ord) FILTER (title <> ''), '') AS title, coalesce(min_by(conversation_time, ord) FILTER (conversation_time <> ''), '') AS conversation_time, coalesce(min_by(raw_date, ord) FILTER (raw_date <> ''), '') AS raw_date
FROM ({d.DISCOVERED}) x GROUP BY 1""")
def discovered_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.upsert_discovered(d.derived(spark, sf_dir, d.DISCOVERED, "conversations")).select("item_key", "ord", "conversation_id", "title", "conversation_time", "raw_date")


_LATER = f"SELECT platform, conversation_id, url, message_count + 5 AS message_count, '2025-01-15' AS backed_up_at FROM ({d.REGISTRY}) r"


@query(f"""SELECT platform, conversation_id, message_count, backed_up_at FROM (SELECT *, row_number() OVER (PARTITION BY platform, conversation_id ORDER BY backed_up_at DESC, message_count DESC) AS rn FROM (SELECT * FROM ({d.REGISTRY}) a UNION ALL SELECT * FROM ({_LATER}) b) u) v WHERE rn = 1""")
def registry_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = (d.derived(spark, sf_dir, s, "conversations") for s in (d.REGISTRY, _LATER))
    return sync.upsert_registry(*both).select("platform", "conversation_id", "message_count", "backed_up_at")


@query(f"SELECT platform FROM (SELECT DISTINCT platform FROM ({d.CONV_META}) m) a EXCEPT ALL SELECT DISTINCT platform FROM ({d.EXPORTS}) e WHERE id % 6 <> 4")
def missing_platforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.missing_platforms(_exports(spark, sf_dir).where("id % 6 <> 4"), meta(spark, sf_dir).select("platform").distinct())


_TAKEN = f"SELECT concat('a/', CAST(conv_id % 10 AS VARCHAR(20)), '.md') AS path, conv_id FROM ({d.CONV_META}) m"


@query(f"""SELECT conv_id, CASE WHEN n = 0 THEN path ELSE concat(left(path, length(path) - 3), ' (', n, ').md') END AS target FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY conv_id) - 1 + CASE WHEN path = 'a/3.md' THEN 1 ELSE 0 END AS n FROM ({_TAKEN}) x) y""")
def unique_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    existing = spark.createDataFrame([("a/3.md",)], "path string")
    return sync.unique_paths(d.derived(spark, sf_dir, _TAKEN, "conversations"), existing).select("conv_id", "target")


@query(f"SELECT conv_id, platform, source_url, conversation_id, shown AS title, conversation_time, 'false' AS needs_media FROM ({_TITLES}) x")
def front_matter_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = render.documents(meta(spark, sf_dir), said(spark, sf_dir)).select("conv_id", "markdown")
    return render.parse_metadata(docs).select("conv_id", "metadata.*")


# ---------------------------------------------------------------- pages, payloads, streams


@query()
def page_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.table(spark, sf_dir, "pages").select("page_id", html_to_markdown("html").alias("markdown"))


@query()
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.table(spark, sf_dir, "pages").select("page_id", F.posexplode(html_links("html")).alias("ord", "link")).select("page_id", "ord", "link.href", "link.text")


def _chat_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page per conversation in the shape of one of the platforms."""
    attr = F.concat(F.lit("<div data-message-author-role='"), F.col("role"), F.lit("'><p>"), F.replace("content", F.lit("\n"), F.lit("</p><p>")), F.lit("</p></div>"))
    body = said(spark, sf_dir).select("conv_id", "seq", attr.alias("div")).groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "div"))), lambda x: x["div"]), "").alias("body"))
    return meta(spark, sf_dir).join(body, "conv_id").select(F.col("source_url").alias("url"), F.concat(F.lit("<html><body><main><h1>"), F.col("title"), F.lit("</h1>"), F.col("body"), F.lit("</main></body></html>")).alias("html"))


@query()
def extract_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract_pages(_chat_pages(spark, sf_dir)).select("url", "platform", "conversation_id", "title", F.size("messages").alias("n_messages"), F.to_json("messages").alias("messages"))


@query()
def scan_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A payload per conversation of the claude kind, and what is read back from it."""
    one = F.struct("seq", F.struct(F.when(F.col("role") == "user", "human").otherwise(F.col("role")).alias("sender"), F.col("content").alias("text")).alias("m"))
    talks = said(spark, sf_dir).groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["m"]).alias("chat_messages"))
    x = meta(spark, sf_dir).join(talks, "conv_id")
    body = F.to_json(F.struct(F.col("conversation_id").alias("uuid"), F.col("title").alias("name"), F.nullif("conversation_time", F.lit("")).alias("created_at"), "chat_messages"))
    url = F.concat(F.lit("https://claude.ai/api/organizations/o/chat_conversations/"), F.col("conversation_id"))
    return payloads.scan_payloads(x.select(url.alias("url"), body.alias("body")), AS_OF.year).where("kind = 'conversation'").select("platform", "conversation_id", "title", "time", F.size("messages").alias("n_messages"), md5(F.to_json("messages")).alias("messages_md5"))


@query(ORACLE_SQL["earliest_per_key"])
def stream_earliest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """earliest_per_key as one micro-batch of a stream over the events file, read back from its sink."""
    import uuid

    root = f"{shared_folder(spark)}/chatloom-stream-{uuid.uuid4().hex}"
    source = d.table(spark, sf_dir, "events")
    stream = spark.readStream.schema(source.schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet")
    raw = spark.sql(d.RAW_TIMES_SPARK.replace("FROM events", "FROM {events}"), events=stream)
    x = raw.select(F.col("event_id").alias("ord"), F.col("user_id").cast("string").alias("conversation_id"), F.lit("ChatGPT").alias("platform"), F.col("raw").alias("timestamp"), F.concat(F.lit("title "), F.col("event_id").cast("string")).alias("title"), F.col("raw").alias("updated_at"))
    state.save_stream(state.stream_earliest_times(x, expires=False), f"{root}/times", f"{root}/checkpoint", None).awaitTermination()
    rows = spark.read.option("basePath", f"{root}/times").parquet(f"{root}/times").drop("batch")
    newest = rows.groupBy("conversation_id").agg(F.max_by(F.struct("timestamp", "title", "updated_at"), "cached_at").alias("r"))
    return newest.select("conversation_id", "r.*")


_LONGEST = f"""SELECT m.platform, m.conversation_id, m.source_url, m.title, m.conversation_time, md5(string_agg(concat(c.role, ':', c.text), chr(10) ORDER BY c.turn)) AS messages_md5
FROM ({d.CONV_META}) m JOIN conversations c ON c.conv_id = m.conv_id GROUP BY ALL"""


def _captured_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as captured in whole and, later, its first message without a title."""
    part = F.transform(F.array_sort(F.collect_list(F.struct("seq", "role", "content"))), lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"), F.lit("").alias("time")))
    talks = said(spark, sf_dir).groupBy("conv_id").agg(part.alias("messages"))
    whole = meta(spark, sf_dir).join(talks, "conv_id").select("platform", "conversation_id", "source_url", "title", "conversation_time", "messages")
    later = whole.withColumn("messages", F.slice("messages", 1, 1)).withColumn("title", F.lit(""))
    return whole.withColumn("ord", F.lit(1)).unionByName(later.withColumn("ord", F.lit(2)))


def _told(x: DataFrame) -> DataFrame:
    said_ = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "\n")
    return x.select("platform", "conversation_id", "source_url", "title", "conversation_time", md5(said_).alias("messages_md5"))


@query(_LONGEST)
def longest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(state.longest_conversations(_captured_twice(spark, sf_dir)))


@query(_LONGEST)
def stream_longest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """longest_per_key as a stream over captures that were written to files."""
    import uuid

    root = f"{shared_folder(spark)}/chatloom-talks-{uuid.uuid4().hex}"
    captured = _captured_twice(spark, sf_dir)
    captured.write.parquet(f"{root}/captures")
    stream = spark.readStream.schema(captured.schema).parquet(f"{root}/captures")
    state.save_stream(state.stream_longest_conversations(stream), f"{root}/talks", f"{root}/checkpoint", None).awaitTermination()
    rows = spark.read.option("basePath", f"{root}/talks").parquet(f"{root}/talks").drop("batch")
    return _told(state.compact(rows, ["platform", "conversation_id"], rows.count()))


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_exactly_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each user and type, of a stream over the events file."""
    import uuid

    root = f"{shared_folder(spark)}/chatloom-once-{uuid.uuid4().hex}"
    schema = d.table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet").select("user_id", "event_type")
    once = state.exactly_once(stream, ["user_id", "event_type"], expires=False)
    once.writeStream.format("parquet").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start(f"{root}/rows").awaitTermination()
    return spark.read.schema(once.schema).parquet(f"{root}/rows")


@query(f"SELECT relative_path, split_part(relative_path, '/', -1) AS basename, platform, source_url, conversation_id FROM ({d.EXPORTS}) e")
def index_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The snapshot of the derived exports, and the files that are read back from it."""
    x = _exports(spark, sf_dir).withColumn("filename", F.col("relative_path")).withColumn("title", F.lit("")).withColumn("needs_media", F.lit("false"))
    f = files.snapshot_json(x).select(F.explode(F.from_json("json", files.SNAPSHOT)["files"]).alias("f"))
    return f.select(F.col("f.relativePath").alias("relative_path"), "f.basename", "f.metadata.platform", F.col("f.metadata.sourceUrl").alias("source_url"), F.col("f.metadata.conversationId").alias("conversation_id"))


@query(f"""SELECT m.conv_id, m.platform, m.title, count(*) AS n_messages, count(*) FILTER (c.role = 'user') AS n_user, count(*) FILTER (c.role = 'assistant') AS n_assistant, left(min_by(c.text, c.turn), 160) AS first_text
FROM ({d.CONV_META}) m JOIN conversations c ON c.conv_id = m.conv_id GROUP BY m.conv_id, m.platform, m.title""")
def debug_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = files.debug_snapshot(meta(spark, sf_dir), said(spark, sf_dir))
    at = lambda k: F.get_json_object("json", f"$.{k}")
    return x.select("conv_id", at("platform").alias("platform"), at("title").alias("title"), *(at(k).cast("long").alias(n) for k, n in (("n_messages", "n_messages"), ("user", "n_user"), ("assistant", "n_assistant"))), at("samples[0].text").alias("first_text"))


@query(f"""SELECT DISTINCT rule, key FROM (SELECT * FROM ({_KEYS.replace(f'({d.EXPORTS})', f"(SELECT * FROM ({d.EXPORTS}) z WHERE id % 3 <> 0)")}) a UNION ALL SELECT * FROM ({_KEYS.replace(f'({d.EXPORTS})', f"(SELECT * FROM ({d.EXPORTS}) z WHERE id % 2 = 0)")}) b) u""")
def remembered_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An export index to which the keys of files just written are added."""
    known = sync.export_index_keys(_exports(spark, sf_dir).where("id % 3 <> 0"))
    return sync.remember_exports(known, _exports(spark, sf_dir).where("id % 2 = 0"))


@query("SELECT page_id, concat('{\"page\": ', page_id, ', \"list\": [1, 2]}') AS body FROM pages UNION ALL SELECT page_id, concat('[[\"c_', page_id, '\"], ', page_id, ']') FROM pages")
def embedded_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON in pages' own scripts: state, data callbacks, and a broken one."""
    k = F.col("page_id").cast("string")
    html = F.concat(F.lit('<body><script id="__NEXT_DATA__" type="application/json">{"page": '), k, F.lit(', "list": [1, 2]}</script><script>AF_initDataCallback({key: \'ds:1\', hash: \'2\', data:[["c_'), k, F.lit('"], '), k, F.lit("], sideChannel: {}});</script><script>AF_initDataCallback({key: 'ds:2', data:[broken, sideChannel: {}});</script></body>"))
    x = d.table(spark, sf_dir, "pages").select(k.alias("url"), html.alias("html"))
    return payloads.page_payloads(x).select(F.col("url").cast("long").alias("page_id"), "body")


@query("""SELECT doc_id, md5(text) AS back_md5, md5(trim(replace(replace(replace(text, '|', '\\|'), chr(13) || chr(10), ' '), chr(10), ' '), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS cell_md5, CASE doc_id % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'false' ELSE '' END AS flag, concat('a/b', doc_id, '.md') AS path,
  strftime(make_timestamp(CAST((1735689600 + doc_id % 86400) * 1000000 + 5000 AS BIGINT)), '%Y-%m-%dT%H:%M:%S.005Z') AS told FROM documents WHERE text IS NOT NULL""")
def small_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data addresses and back, table cells, flags, clean paths, pairs of seconds and nanoseconds."""
    x = d.table(spark, sf_dir, "documents").where("text is not null")
    flag = t.boolean_override(F.when(F.col("doc_id") % 3 == 0, " TRUE ").when(F.col("doc_id") % 3 == 1, "false").otherwise("no"))
    path = t.clean_path(F.concat(F.lit("../a\\./b"), F.col("doc_id").cast("string"), F.lit(".md")))
    told = times.pair_timestamp(F.lit(1735689600) + F.col("doc_id") % 86400, F.lit(5_000_000))
    back = t.from_data_url(F.concat(F.lit("data:text/markdown;base64,"), t.to_base64("text")))
    return x.select("doc_id", md5(back).alias("back_md5"), md5(t.escape_table_cell("text")).alias("cell_md5"), F.coalesce(flag.cast("string"), F.lit("")).alias("flag"), path.alias("path"), told.alias("told"))


@query("SELECT conv_id, turn, role FROM conversations WHERE turn % 3 <> 1 AND conv_id % 4 <> 0 AND text <> ''")
def valid_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without unknown roles and texts of blanks."""
    x = said(spark, sf_dir).withColumn("role", F.when(F.col("seq") % 3 == 1, "tool").otherwise(F.col("role"))).withColumn("content", F.when(F.col("conv_id") % 4 == 0, " \n\t").otherwise(F.col("content")))
    return ms.valid_messages(x).select("conv_id", F.col("seq").alias("turn"), "role")


from . import captures, discovery  # noqa: E402, F401  their queries register themselves here
