"""Mail views derived from the given tables, as DataFrames and as SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lurewatch.functions import text as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _source(key: str) -> Column:
    return F.when(F.col(key) % 2 == 0, "gmail").otherwise("yahoo")


def _sender(k: Column) -> Column:
    return F.concat(F.lit("Sender <s"), k.cast("string"), F.lit("@d"), (k % 7).cast("string"), F.lit(".example>"))


def _auth(key: str) -> Column:
    spf = F.element_at(F.array(*map(F.lit, ("pass", "fail", "none"))), (F.col(key) % 3 + 1).cast("int"))
    dkim = F.when(F.expr(f"({key} div 3) % 2") == 0, "pass").otherwise("fail")
    dmarc = F.when(F.col(key) % 5 == 0, "; dmarc=fail").otherwise("; dmarc=pass")
    return F.concat(F.lit("mx.example; SPF="), spf, F.lit("; dkim="), dkim, dmarc)


_AUTH_SQL = "'mx.example; SPF=' || CASE {k} % 3 WHEN 0 THEN 'pass' WHEN 1 THEN 'fail' ELSE 'none' END || '; dkim=' || CASE WHEN ({k} // 3) % 2 = 0 THEN 'pass' ELSE 'fail' END || CASE WHEN {k} % 5 = 0 THEN '; dmarc=fail' ELSE '; dmarc=pass' END"
_SENDER_SQL = "'Sender <s' || {k} || '@d' || ({k}) % 7 || '.example>'"


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reported mails from pages: the page with a link to its own URL and the same URL defanged."""
    p = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    fanged = F.replace(F.replace("url", F.lit("http"), F.lit("hxxp")), F.lit("."), F.lit("[.]"))
    body = F.concat("html", F.lit('<a href="'), "url", F.lit('">link</a> '), fanged, F.lit("/d"), (F.col("page_id") % 11).cast("string"))
    return p.select(
        F.concat(F.lit("m"), F.col("page_id").cast("string")).alias("email_id"), "page_id", _source("page_id").alias("source"), F.concat(F.lit("me@"), _source("page_id"), F.lit(".example")).alias("mailbox"),
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("subject"), _sender(F.col("page_id") % 37).alias("sender"), body.alias("body_html"), _auth("page_id").alias("auth_header"),
    )


REPORTS = f"""r AS (
  SELECT 'm' || page_id AS email_id, page_id, CASE WHEN page_id % 2 = 0 THEN 'gmail' ELSE 'yahoo' END AS source,
         'me@' || CASE WHEN page_id % 2 = 0 THEN 'gmail' ELSE 'yahoo' END || '.example' AS mailbox, regexp_extract(html, '<title>([^<]*)</title>', 1) AS subject,
         {_SENDER_SQL.format(k='page_id % 37')} AS sender,
         html || '<a href="' || url || '">link</a> ' || replace(replace(url, 'http', 'hxxp'), '.', '[.]') || '/d' || page_id % 11 AS body_html,
         {_AUTH_SQL.format(k='page_id')} AS auth_header
  FROM pages)"""


def mail_iocs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports with their indicators."""
    m = reports(spark, sf_dir).withColumn("body_text", T.html_to_text(F.col("body_html")))
    return m.withColumn("iocs", T.extract_iocs(F.col("body_text"), F.col("sender")))


_COMMON, _FILES = ", ".join(f"'{d}'" for d in T.COMMON_DOMAINS), ", ".join(f"'{d}'" for d in T.FILE_SUFFIXES)
_REFANG = "replace(replace(replace(replace(regexp_replace(§, '([hH])xx([pP][sS]?://)', '\\1tt\\2', 'g'), '[.]', '.'), '(.)', '.'), '[:]', ':'), '[@]', '@')"
_HTML = r"""regexp_replace(body_html, '<[^<>]+>', ' ', 'g') || CASE WHEN len(regexp_extract_all(body_html, '(?i)href\s*=\s*["'']([^"'']+)["'']', 1)) > 0
         THEN chr(10) || chr(10) || 'Links:' || chr(10) || array_to_string(regexp_extract_all(body_html, '(?i)href\s*=\s*["'']([^"'']+)["'']', 1), chr(10)) ELSE '' END"""
#: Letters outside ASCII stand for word characters in the guarded copy, since this engine's word boundary knows only ASCII.
_GUARD = r"regexp_replace(§, '[^\x00-\x7F]', '_', 'g')"
_URLS = r"""list_sort(list_distinct(list_transform(regexp_extract_all(§, '(?i)\bh(?:xx|tt)ps?://[^\s\[\]<>"'']+'), lambda u: regexp_replace(u, '[.,;:!?)\]}>''"]+$', ''))))"""
_DOMAINS = rf"""list_sort(list_distinct(list_filter(list_concat(list_transform(urls, lambda u: lower(regexp_extract(u, '^[^:/?#]+://([^/?#:]*)', 1))),
    list_filter(list_transform(regexp_extract_all(§, '\b(?:[a-zA-Z0-9](?:[a-zA-Z0-9-]{{0,61}}[a-zA-Z0-9])?\.)+[a-zA-Z]{{2,}}\b'), lambda d: lower(d)),
      lambda d: NOT (len(string_split(d, '.')) = 2 AND string_split(d, '.')[-1] IN ({_FILES})))),
    lambda d: d <> '' AND d NOT IN ({_COMMON}) AND NOT regexp_full_match(d, '(?:\d{{1,3}}\.){{3}}\d{{1,3}}'))))"""
_PRIVATE = " AND ".join(f"NOT starts_with(x, '{p}')" for p in T.PRIVATE_PREFIXES)
_IPS = rf"list_sort(list_distinct(list_filter(regexp_extract_all(§, '\b(?:\d{{1,3}}\.){{3}}\d{{1,3}}\b'), lambda x: {_PRIVATE})))"
_HASHES = r"list_sort(list_distinct(list_concat(list_concat(regexp_extract_all(§, '\b[a-fA-F0-9]{64}\b'), regexp_extract_all(§, '\b[a-fA-F0-9]{40}\b')), regexp_extract_all(§, '\b[a-fA-F0-9]{32}\b'))))"
MAILS = f"""{REPORTS}, t AS (SELECT *, {_HTML} AS body_text FROM r),
u AS (SELECT *, {_REFANG.replace('§', 'body_text')} AS clean FROM t),
v AS (SELECT *, {_URLS.replace('§', 'clean')} AS urls, {_GUARD.replace('§', 'clean')} AS guarded FROM u),
mails AS (SELECT *, {_DOMAINS.replace('§', 'guarded')} AS domains, {_IPS.replace('§', 'guarded')} AS ips, {_HASHES.replace('§', 'guarded')} AS hashes FROM v)"""


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings from documents and labels; a label given twice counts once."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    k = F.col("doc_id") % 150
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (F.expr(f"(doc_id div {n}) % {len(names)}") + 1).cast("int"))
    start, gone = F.timestamp_seconds(F.lit(1_704_067_200)), F.timestamp_seconds(F.lit(1_705_708_800) + (F.col("doc_id") % 500) * 3600)
    own = F.concat(F.lit("s"), k.cast("string"), F.lit("@d"), (k % 7).cast("string"), F.lit(".example"))
    return d.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("id"), F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("email_id"), _source("doc_id").alias("source"), pick(("high", "medium", "low"), 2).alias("confidence"),
        pick(("phishing", "malware", "scam", "spam", "legitimate", "unclear"), 6).alias("category"), F.when(F.col("toxic") == 1, "malicious").when(F.col("quality") == 0, "suspicious").when(F.col("quality") == 1, "likely_benign").otherwise("unknown").alias("verdict"),
        F.substr("text", F.lit(1), F.lit(40)).alias("subject"), _sender(k).alias("sender"), own.alias("sender_address"), F.when(F.col("doc_id") % 50 == 7, own).otherwise(F.concat(F.lit("me@"), _source("doc_id"), F.lit(".example"))).alias("mailbox"),
        T.parse_auth_results(_auth("doc_id")).alias("auth"), F.timestamp_seconds(F.lit(1_704_067_200) + F.col("doc_id") * 60).alias("processed_at"), F.when(F.col("doc_id") % 10 == 0, gone).alias("deleted_at"),
        F.when(F.col("doc_id") % 4 != 1, F.concat(F.lit("<"), F.col("doc_id").cast("string"), F.lit(">"))).alias("message_id"), F.lit(None).cast("string").alias("uidvalidity"),
    )


FINDINGS = f"""l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT doc_id AS id, 'f' || doc_id AS email_id, CASE WHEN doc_id % 2 = 0 THEN 'gmail' ELSE 'yahoo' END AS source, ['high', 'medium', 'low'][(doc_id // 2) % 3 + 1] AS confidence,
         ['phishing', 'malware', 'scam', 'spam', 'legitimate', 'unclear'][(doc_id // 6) % 6 + 1] AS category,
         CASE WHEN toxic = 1 THEN 'malicious' WHEN quality = 0 THEN 'suspicious' WHEN quality = 1 THEN 'likely_benign' ELSE 'unknown' END AS verdict,
         substr(text, 1, 40) AS subject, {_SENDER_SQL.format(k='doc_id % 150')} AS sender, 's' || doc_id % 150 || '@d' || (doc_id % 150) % 7 || '.example' AS sender_address,
         CASE WHEN doc_id % 50 = 7 THEN 's' || doc_id % 150 || '@d' || (doc_id % 150) % 7 || '.example' ELSE 'me@' || CASE WHEN doc_id % 2 = 0 THEN 'gmail' ELSE 'yahoo' END || '.example' END AS mailbox,
         ['pass', 'fail', 'none'][doc_id % 3 + 1] AS spf, CASE WHEN (doc_id // 3) % 2 = 0 THEN 'pass' ELSE 'fail' END AS dkim, CASE WHEN doc_id % 5 = 0 THEN 'fail' ELSE 'pass' END AS dmarc,
         TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS processed_at, CASE WHEN doc_id % 10 = 0 THEN TIMESTAMP '2024-01-20' + to_hours(doc_id % 500) END AS deleted_at,
         CASE WHEN doc_id % 4 <> 1 THEN '<' || doc_id || '>' END AS message_id, NULL::VARCHAR AS uidvalidity
  FROM documents LEFT JOIN l USING (doc_id))"""


def mail_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    action = F.element_at(F.create_map(*[F.lit(x) for kv in (("click", "spam"), ("view", "trash"), ("signup", "restore"), ("error", "block"), ("purchase", "unblock")) for x in kv]), F.col("event_type"))
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("finding_id"), action.alias("action"), F.when(F.col("event_id") % 3 == 0, "manual").otherwise("auto").alias("trigger"), F.when(F.col("event_id") % 7 == 0, 0).otherwise(1).alias("success"), F.col("ts").alias("created_at"))


ACTIONS = """a AS (
  SELECT event_id AS id, user_id AS finding_id, CASE event_type WHEN 'click' THEN 'spam' WHEN 'view' THEN 'trash' WHEN 'signup' THEN 'restore' WHEN 'error' THEN 'block' WHEN 'purchase' THEN 'unblock' END AS action,
         CASE WHEN event_id % 3 = 0 THEN 'manual' ELSE 'auto' END AS trigger, CASE WHEN event_id % 7 = 0 THEN 0 ELSE 1 END AS success, ts AS created_at FROM events)"""


def blocked_senders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses whose last successful block or unblock is a block."""
    a = mail_actions(spark, sf_dir).filter("success = 1 AND action IN ('block', 'unblock')")
    last = a.groupBy("finding_id").agg(F.max_by(F.struct("action", "created_at"), "id").alias("x")).filter("x.action = 'block'")
    k = F.col("finding_id")
    return last.select(F.concat(F.lit("s"), k.cast("string"), F.lit("@d"), (k % 7).cast("string"), F.lit(".example")).alias("address"), F.col("x.created_at").alias("created_at"))


BLOCKED = f"""{ACTIONS}, b AS (
  SELECT 's' || finding_id || '@d' || finding_id % 7 || '.example' AS address, x.created_at AS created_at
  FROM (SELECT finding_id, max_by({{'action': action, 'created_at': created_at}}, id) AS x FROM a WHERE success = 1 AND action IN ('block', 'unblock') GROUP BY finding_id)
  WHERE x.action = 'block')"""


def reputation_of(distinct: DataFrame) -> DataFrame:
    """A feed derived from the indicators themselves."""
    n = F.char_length("indicator")
    return distinct.select("kind", "indicator", (n % 3 != 0).alias("found"), (n % 5).cast("int").alias("malicious"), (n % 2).cast("int").alias("suspicious"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attachments from pages: the page's bytes under names of eight kinds."""
    p = table(spark, sf_dir, "pages").select("page_id", "html")
    suffix = F.element_at(F.array(*map(F.lit, SUFFIXES)), (F.col("page_id") % 8 + 1).cast("int"))
    return p.select(F.concat(F.lit("m"), F.expr("page_id div 12").cast("string")).alias("email_id"), (F.col("page_id") % 12).cast("int").alias("att_idx"), (F.col("page_id") % 12).cast("string").alias("file_path"), "page_id", F.concat(F.lit("file"), F.col("page_id").cast("string"), suffix).alias("name"), F.encode("html", "UTF-8").alias("data"), F.lit("").alias("content_type"))


SUFFIXES = (".html", ".pdf", ".pdf.exe", ".docm", ".txt", ".js", ".svg", ".html.")
FILES = f"""x AS (
  SELECT 'm' || page_id // 12 AS email_id, (page_id % 12)::INT AS att_idx, (page_id % 12)::VARCHAR AS file_path, page_id,
         'file' || page_id || [{', '.join(repr(s) for s in SUFFIXES)}][page_id % 8 + 1] AS name, html, octet_length(encode(html)) AS size FROM pages)"""
