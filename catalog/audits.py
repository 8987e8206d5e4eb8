"""URL, request-log and agent-event queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from catalog import inputs
from catalog.base import derive, plain, table
from gradeline import blocklists
from gradeline.functions.events import format_event, parse_event
from gradeline.functions.urls import blocked_group, group_text, is_chat_call, is_loopback, url_host
from gradeline.operators import audit

GROUPS = (("spam-farm",), ("HTTPS://", "cheap-pills"), ("example.com", "/fr/"), ("example.net", "/de/", "utm"), ("example.com", "/de/"))


def url_blocklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.withColumn("blocked_by", blocked_group(F.col("url"), GROUPS)).select(
        "page_id", "blocked_by", group_text(F.col("blocked_by"), GROUPS).alias("pattern")
    )


def _group_sql(value) -> str:
    cases = " ".join(
        "WHEN " + " AND ".join(f"contains(lower(url), '{p.lower()}')" for p in g) + f" THEN {value(i, g)}"
        for i, g in enumerate(GROUPS)
    )
    return f"CASE {cases} END"


URL_BLOCKLIST = f"""
SELECT page_id, CAST({_group_sql(lambda i, g: i)} AS INTEGER) AS blocked_by, {_group_sql(lambda i, g: "'" + ' '.join(g) + "'")} AS pattern FROM pages"""

LISTS = {"relevance": blocklists.RELEVANCE, "extraction": blocklists.EXTRACTION, "detection": blocklists.DETECTION}


def shipped_blocklists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pages each group of each shipped list blocks; a page's number picks a group to name."""
    pages, counts = table(spark, sf_dir, "pages"), []
    for name, groups in LISTS.items():
        named = F.array(*[F.lit("/" + "/".join(g).upper()) for g in groups])
        url = F.concat("url", F.element_at(named, (F.col("page_id") % len(groups) + 1).cast("int")))
        found = pages.select(blocked_group(url, groups).alias("position"))
        counts.append(found.groupBy("position").agg(F.count("*").alias("n")).select(F.lit(name).alias("list"), "position", "n"))
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


def blocklist_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages against a list as long as there are hosts and languages; a host may be part of another."""
    pages = table(spark, sf_dir, "pages")
    parts = F.split(F.upper("url"), "/")
    group = F.array(F.get(parts, F.lit(2)), F.concat(F.lit("/"), F.get(parts, F.lit(3)), F.lit("/")))
    groups = pages.groupBy(group.alias("parts")).agg(F.min("page_id").cast("int").alias("position"))
    return audit.blocked_by_list(pages, groups).select("page_id", "blocked_by")


BLOCKLIST_INDEX = """
WITH g AS (SELECT split_part(lower(url), '/', 3) AS host, '/' || split_part(lower(url), '/', 4) || '/' AS lang,
  CAST(min(page_id) AS INTEGER) AS position FROM pages GROUP BY ALL)
SELECT page_id, min(position) AS blocked_by FROM pages LEFT JOIN g ON contains(lower(url), host) AND contains(lower(url), lang)
GROUP BY page_id"""


def _list_sql(name: str, groups: list[list[str]]) -> str:
    values = ", ".join(f"({i}, '{'/' + '/'.join(g).lower()}')" for i, g in enumerate(groups))
    parts = ", ".join(f"({i}, '{p.lower()}')" for i, g in enumerate(groups) for p in g)
    return f"""SELECT '{name}' AS list, CAST(position AS INTEGER) AS position, count(*) AS n FROM (
  SELECT (SELECT min(i) FROM (SELECT i, bool_and(contains(u.url, p)) AS hit FROM (VALUES {parts}) t(i, p) GROUP BY i) WHERE hit) AS position
  FROM (SELECT lower(concat(url, named.text)) AS url FROM pages JOIN (VALUES {values}) named(i, text) ON page_id % {len(groups)} = named.i) u
) GROUP BY position"""


SHIPPED_BLOCKLISTS = " UNION ALL ".join(_list_sql(name, groups) for name, groups in LISTS.items())

# Mobile hosts stand in for local addresses, blogs for local names.
_LOCAL = r"""
SELECT page_id, CASE WHEN contains(url, '//m.') THEN concat('http://127.0.0.', CAST(length(url) AS STRING), ':8080/x')
  WHEN contains(url, '//blog.') THEN concat('http://LocalHost/', substr(url, 9)) WHEN contains(url, '//www.') THEN 'http://128.0.0.1/'
  WHEN contains(url, 'page=2') THEN 'http://[::1]:80/' ELSE url END AS url,
  contains(url, '//m.') OR contains(url, '//blog.') OR (contains(url, 'page=2') AND NOT contains(url, '//www.')) AS expected
FROM $pages"""


def loopback(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = derive(spark, sf_dir, _LOCAL)
    return pages.select("page_id", is_loopback(url_host(F.col("url"))).alias("loopback"))


LOOPBACK = f"SELECT page_id, expected AS loopback FROM ({plain(_LOCAL)})"


def url_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", url_host(F.col("url")).alias("host"))


URL_HOSTS = "SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS host FROM pages"


def endpoint_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = derive(spark, sf_dir, inputs.REQUESTS)
    chat = is_chat_call(url_host(F.col("url")), F.col("method"), F.col("path"))
    return seen.select("idx", chat.alias("chat"))


ENDPOINT_MATCH = f"SELECT idx, k >= 30 AND method = 'POST' AS chat FROM ({plain(inputs.REQUESTS)})"


def request_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").withColumn("status_code", F.when(F.contains("url", F.lit("https")), 200).otherwise(301))
    return audit.request_counts(audit.with_url_flags(pages, GROUPS))


REQUEST_COUNTS = f"""
SELECT CASE WHEN contains(url, 'https') THEN 200 ELSE 301 END AS status_code, CAST({_group_sql(lambda i, g: i)} AS INTEGER) AS blocked_by,
  false AS loopback, count(*) AS n FROM pages GROUP BY ALL"""


def event_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = derive(spark, sf_dir, inputs.EVENT_LINES)
    return lines.select("conv_id", "turn", format_event(F.col("line")).alias("shown"))


EVENT_FORMAT = f"""
SELECT conv_id, turn, CASE WHEN line LIKE 'starting%' THEN line
  WHEN line LIKE '{{"type": "text"%' THEN '[opencode/text] ' || replace(text, chr(10), ' ')
  WHEN line LIKE '{{"type": "step%' THEN '[opencode/step_start] session=s' || conv_id
  WHEN contains(line, '"bash"') THEN '[opencode/tool_use] bash command=ls -l'
  WHEN contains(line, '"edit"') THEN '[opencode/tool_use] edit status=done'
  ELSE '[opencode/usage] ' || line END AS shown
FROM ({plain(inputs.EVENT_LINES)})"""


def latest_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run"), F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "signup", F.concat(F.lit("s"), F.col("event_id").cast("string"))).alias("session_id"),
    )
    return audit.latest_session(events)


LATEST_SESSION = """
SELECT user_id AS run, 's' || max(event_id) AS session_id FROM events WHERE event_type = 'signup' GROUP BY user_id"""


def sessions_in_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session ids read from the event lines themselves."""
    lines = derive(spark, sf_dir, inputs.EVENT_LINES)
    events = lines.select(F.col("conv_id").alias("run"), F.col("turn").alias("seq"), parse_event(F.col("line"))["sessionID"].alias("session_id"))
    return audit.latest_session(events)


SESSIONS_IN_LOG = """
SELECT conv_id AS run, 's' || conv_id AS session_id FROM conversations
WHERE role = 'assistant' OR (role = 'user' AND turn = 0) GROUP BY conv_id"""

QUERIES = {
    "url_blocklist": (url_blocklist, URL_BLOCKLIST),
    "shipped_blocklists": (shipped_blocklists, SHIPPED_BLOCKLISTS),
    "blocklist_index": (blocklist_index, BLOCKLIST_INDEX),
    "loopback": (loopback, LOOPBACK),
    "url_hosts": (url_hosts, URL_HOSTS),
    "endpoint_match": (endpoint_match, ENDPOINT_MATCH),
    "request_counts": (request_counts, REQUEST_COUNTS),
    "event_format": (event_format, EVENT_FORMAT),
    "latest_session": (latest_session, LATEST_SESSION),
    "sessions_in_log": (sessions_in_log, SESSIONS_IN_LOG),
}
