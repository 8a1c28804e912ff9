"""Further registered queries: the attachment job, feeds, readers and writers, table changes and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lurewatch.functions import attachments as A
from lurewatch.functions import text as T
from lurewatch.jobs import views as V
from lurewatch.jobs.queries import _ADM, _KIND, _LONG, _admitted, query
from lurewatch.operators import enrich, files, findings, policy, report
from lurewatch.sources import messages
from lurewatch.sources.scratch import scratch, written
from lurewatch.streaming import mail
from lurewatch.streaming.commits import CommitLog

# --- attachments ---

_P = {k: p.replace("'", "''") for k, p in (A.HTML_RULES | {"form_action": A.FORM_ACTION}).items()}


def _has(rule: str) -> str:
    return f"regexp_matches(html, '{_P[rule]}')"


_PAGE = "kind IN ('html', 'svg')"
#: severity (null: not given), signal; in the order in which a file's checks run. i: which of the eight names a file has.
_SIGNALS = (
    ("CASE WHEN i = 2 THEN 3 END", "double_extension"), ("CASE WHEN i = 7 THEN 2 END", "trailing_dots_or_spaces"),
    (f"CASE WHEN {_PAGE} AND {_has('password_field')} THEN 3 END", "credential_harvest_form"),
    (f"CASE WHEN {_PAGE} AND NOT {_has('password_field')} AND {_has('form_action')} THEN 2 END", "form_posts_remote"),
    (f"CASE WHEN {_PAGE} AND {_has('blob_download')} AND {_has('blob_save')} THEN 3 END", "html_smuggling"),
    (f"CASE WHEN {_PAGE} AND {_has('obfuscation')} AND {_has('script_tag')} THEN 2 END", "obfuscated_script"),
    (f"CASE WHEN {_PAGE} AND {_has('big_encoded_blob')} THEN 2 END", "large_encoded_blob"),
    (f"CASE WHEN {_PAGE} AND {_has('meta_refresh')} THEN 2 END", "meta_refresh_redirect"), (f"CASE WHEN {_PAGE} AND {_has('iframe')} THEN 1 END", "iframe"),
    (f"CASE WHEN kind = 'svg' AND ({_has('script_tag')} OR {_has('svg_event')}) THEN 3 END", "svg_script"), ("CASE WHEN kind = 'html' THEN 1 END", "html_attachment"),
    ("CASE WHEN kind = 'text' AND i = 5 THEN 3 END", "script_attachment"),
)
_BY_NAME = (
    ("CASE WHEN i = 2 OR i = 5 AND {script} THEN 3 END", "dangerous_extension"), ("CASE WHEN i = 3 THEN 2 END", "macro_enabled_extension"),
    ("""CASE WHEN kind = 'empty' OR i = 5 OR i = 4 AND kind = 'text' OR i IN (0, 7) AND kind <> 'svg' OR i = 6 AND kind = 'svg' THEN NULL
             WHEN i IN (0, 6, 7) OR kind = 'text' THEN 1 ELSE 2 END""", "type_mismatch"),
)


def _list(rules) -> str:
    """SQL of the given signals of a row, those of no severity left out."""
    every = ", ".join(f"{{'v': {v}, 'q': {q}, 'n': '{n}'}}" for q, (v, n) in enumerate(rules))
    return f"list_filter([{every}], lambda s: s.v IS NOT NULL)"


_NAMED = [(v.format(script="kind <> 'text'"), n) for v, n in _BY_NAME]
_KINDS_SQL = f"{V.FILES}, k AS (SELECT *, page_id % 8 AS i, {_KIND} AS kind FROM x)"


@query(f"""WITH {_ADM.replace("size * 1000", "size")}, k AS (SELECT *, page_id % 8 AS i, CASE WHEN reason IS NULL THEN {_KIND} ELSE 'unknown' END AS kind FROM z),
s AS (SELECT email_id, file_path, kind, CASE WHEN reason IS NULL THEN {_list([*_SIGNALS, *_NAMED])} ELSE [] END AS l FROM k)
SELECT email_id, file_path, kind, coalesce(list_max(list_transform(l, lambda s: s.v)), 0)::INT AS risk,
       array_to_string(list_transform(list_sort(list_transform(l, lambda s: {{'v': -s.v, 'q': s.q, 'n': s.n}})), lambda s: s.n), ' ') AS signals FROM s""")
def attachment_report(spark: SparkSession, d: str) -> DataFrame:
    """The whole attachment job over the pages as files: admission, kinds, signals, risk."""
    f = V.files(spark, d).withColumns({"size": F.octet_length("data").cast("long"), "skipped_reason": F.lit("")})
    out = report.analyze_attachments(files.admit_analysis(f).select("email_id", "file_path", "name", "content_type", "data", "reason"))
    return out.select("email_id", "file_path", "kind", "risk", F.array_join(F.transform("signals", lambda s: s["signal"]), " ").alias("signals"))


@query(f"""WITH {_KINDS_SQL} SELECT page_id, array_to_string(list_transform({_list([(v.format(script='true'), n) for v, n in _BY_NAME])}, lambda s: s.v || ':' || s.n), ' ') AS signals FROM k""")
def extension_signals(spark: SparkSession, d: str) -> DataFrame:
    """Signals from the extension alone, for files of every kind."""
    f = V.files(spark, d)
    kind, ext = A.detect_kind(F.col("data"), F.col("name"), F.col("content_type")), A.file_extension(F.col("name"))
    rows = f.select("page_id", kind.alias("kind"), ext.alias("ext"))
    s = A.extension_signals(F.col("kind"), F.col("ext"))
    return rows.select("page_id", F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["severity"], x["signal"])), " ").alias("signals"))


@query(f"""WITH {V.FILES}, b AS (SELECT page_id, substr(h, 2 * unnest(range(0, length(h) // 2)) + 1, 2) AS c FROM (SELECT page_id, hex(encode(html)) AS h FROM x)),
n AS (SELECT page_id, c, count(*) AS n FROM b GROUP BY 1, 2), t AS (SELECT page_id, sum(n) AS t FROM n GROUP BY 1),
e AS (SELECT page_id, round(abs(-sum(n / t * log2(n / t))), 2) AS e FROM n JOIN t USING (page_id) GROUP BY 1)
SELECT page_id, coalesce(e, 0.0) AS entropy FROM x LEFT JOIN e USING (page_id)""")
def byte_entropy(spark: SparkSession, d: str) -> DataFrame:
    return V.files(spark, d).select("page_id", files.byte_entropy("data").alias("entropy"))


@query(r"SELECT doc_id, array_to_string(list_transform(string_split(substr(coalesce(text, ''), 1, 500), ''), lambda c: CASE WHEN regexp_matches(c, '[\p{Cc}\p{Cf}\p{Zl}\p{Zp}]') THEN '<U+' || printf('%04X', unicode(c)) || '>' ELSE c END), '') AS name FROM documents")
def safe_filename(spark: SparkSession, d: str) -> DataFrame:
    """Texts as if they were file names."""
    return V.table(spark, d, "documents").select("doc_id", A.safe_filename(F.col("text")).alias("name"))


_RISK = "(att_idx * 5 % 4)"


@query(f"""WITH {_ADM}, c AS (SELECT *, sha256(html) AS sha256, {_RISK} AS risk FROM z WHERE reason IS NULL),
o AS (SELECT email_id, sha256, min((3 - risk) * 1000 + CASE file_path WHEN '0' THEN 0 WHEN '1' THEN 1 WHEN '10' THEN 2 WHEN '11' THEN 3 ELSE att_idx + 2 END) AS k FROM c GROUP BY 1, 2),
p AS (SELECT email_id, sha256, row_number() OVER (PARTITION BY email_id ORDER BY k) <= 5 AS looked_up FROM o)
SELECT email_id, att_idx, CASE WHEN looked_up THEN sha256 < '8' END AS found, NOT looked_up AS skipped, CASE WHEN sha256 < '8' THEN att_idx END AS malicious
FROM c JOIN p USING (email_id, sha256)""")
def lookup_file_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Results of a feed on the files of looked-up hashes; the feed knows every hash below 8."""
    f = _admitted(spark, d).withColumns({"kind": F.lit("pdf"), "risk": (F.col("att_idx") * 5 % 4).cast("int")})
    feed = f.filter("sha256 < '8'").select(F.lit("hashes").alias("kind"), F.col("sha256").alias("indicator"), F.lit(True).alias("found")).distinct()
    out = files.lookup_file_hashes(f, feed)
    return out.select("email_id", "att_idx", "found", "skipped", F.when(F.col("sha256") < "8", F.col("att_idx")).alias("malicious"))


@query("""WITH u AS (SELECT 'm' || event_id // 200 AS email_id, event_id AS pos, 'https://h' || user_id % 60 || '.example/' AS url FROM events),
o AS (SELECT email_id, url, min(pos) AS pos FROM u GROUP BY 1, 2)
SELECT email_id, url, row_number() OVER (PARTITION BY email_id ORDER BY pos)::INT AS n FROM o QUALIFY n <= 25""")
def cap_file_urls(spark: SparkSession, d: str) -> DataFrame:
    e = V.table(spark, d, "events")
    rows = e.select(F.concat(F.lit("m"), F.expr("event_id div 200").cast("string")).alias("email_id"), F.lit("0").alias("file_path"), F.col("event_id").alias("pos"), F.concat(F.lit("https://h"), (F.col("user_id") % 60).cast("string"), F.lit(".example/")).alias("url"))
    return files.cap_file_urls(rows).drop("file_path")


_NO_BOILERPLATE = f"NOT (h IN ({', '.join(repr(x) for x in T.BOILERPLATE_HOSTS)}) OR ends_with(h, '.w3.org'))"


@query(f"""WITH {V.MAILS}, l AS (SELECT email_id, url, lower(regexp_extract(url, '//([^/:]*)', 1)) AS h FROM (SELECT email_id, unnest(urls) AS url FROM mails)),
g AS (SELECT email_id, list(url ORDER BY url)[1:25] AS urls FROM l WHERE {_NO_BOILERPLATE} GROUP BY 1)
SELECT email_id, coalesce(array_to_string(g.urls, ' '), '') AS urls FROM mails LEFT JOIN g USING (email_id)""")
def urls_from_text(spark: SparkSession, d: str) -> DataFrame:
    body = T.html_to_text(F.col("body_html"))
    return V.reports(spark, d).select("email_id", F.array_join(T.urls_from_text(body), " ").alias("urls"))


# --- enrichment ---


@query(f"""WITH {_LONG}, e AS (SELECT *, length(indicator) AS n FROM long)
SELECT email_id, kind, indicator, n % 3 <> 0 AS found, (n % 5)::INT AS malicious, CASE WHEN kind = 'ips' THEN n % 7 END::INT AS abuse_score,
       CASE WHEN kind = 'urls' AND pos < 2 THEN n % 9 END::INT AS scan_score FROM e""")
def enrich_mails(spark: SparkSession, d: str) -> DataFrame:
    """Maps of results per mail, with abuse data of addresses and scans of the first URLs, laid out as rows."""
    m = written(V.mail_iocs(spark, d).select("email_id", "iocs"), "indicators")
    long = written(enrich.explode_iocs(m), "long")
    known = enrich.distinct_iocs(long)
    n = F.char_length("indicator")
    abuse = known.filter("kind = 'ips'").select(F.col("indicator").alias("ip"), (n % 7).cast("int").alias("score"))
    scans = known.filter("kind = 'urls'").select(F.col("indicator").alias("url"), (n % 9).cast("int").alias("score"))
    out = enrich.enrich_mails(m, V.reputation_of(known), abuse, scans, long)
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.map_entries(F.col("enrichment")[k]).alias("l")) for k in enrich.KINDS])
    rows = out.select("email_id", F.explode(kinds).alias("k")).select("email_id", F.col("k.kind").alias("kind"), F.explode("k.l").alias("x"))
    v = F.col("x.value")
    return rows.select("email_id", "kind", F.col("x.key").alias("indicator"), v["found"].alias("found"), v["malicious"].alias("malicious"), v["abuse"]["score"].alias("abuse_score"), v["scan"]["score"].alias("scan_score"))


@query(f"""WITH {_LONG}, e AS (SELECT DISTINCT indicator, length(indicator) AS n FROM long)
SELECT indicator, n % 3 <> 0 AS found, CASE WHEN n % 3 <> 0 THEN n % 5 END::BIGINT AS malicious, CASE WHEN n % 3 <> 0 THEN 0 END::BIGINT AS harmless, CASE WHEN n % 3 <> 0 AND n % 2 = 0 THEN 'label' || n END AS threat_label FROM e""")
def read_reputation(spark: SparkSession, d: str) -> DataFrame:
    """Feed documents as JSON text, flattened; some lack counts, labels or a body."""
    known = enrich.explode_iocs(V.mail_iocs(spark, d)).select("indicator").distinct()
    n = F.char_length("indicator")
    stats = F.struct((n % 5).cast("long").alias("malicious"), (n % 2).cast("long").alias("suspicious"))
    label = F.struct(F.when(n % 2 == 0, F.concat(F.lit("label"), n.cast("string"))).alias("suggested_threat_label"))
    body = F.to_json(F.struct(F.struct(F.struct(stats.alias("last_analysis_stats"), label.alias("popular_threat_classification")).alias("attributes")).alias("data")))
    raw = known.select("indicator", F.when(n % 3 != 0, body).alias("body"))
    return enrich.read_reputation(raw, "reputation").select("indicator", "found", "malicious", "harmless", "threat_label")


@query("""WITH l AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'https://campaign.example/' ELSE 'https://h' || user_id || '.example/' || event_id % 4 END AS url FROM events),
feed AS (SELECT 'https://h' || o_custkey || '.example/' || o_orderkey % 4 AS url, max(o_orderkey % 6) AS malicious FROM orders GROUP BY 1 UNION ALL SELECT 'https://campaign.example/', 5)
SELECT event_id, url, feed.url IS NOT NULL AS found, malicious::INT AS malicious FROM l LEFT JOIN feed USING (url)""")
def enrich_hot(spark: SparkSession, d: str) -> DataFrame:
    """Look-ups of events, a third of which name one campaign's URL, in a feed of other URLs mostly."""
    e, o = V.table(spark, d, "events"), V.table(spark, d, "orders")
    url = lambda host, page: F.concat(F.lit("https://h"), F.col(host).cast("string"), F.lit(".example/"), (F.col(page) % 4).cast("string"))
    campaign = F.lit("https://campaign.example/")
    long = e.select(F.col("event_id").alias("email_id"), F.lit("urls").alias("kind"), F.lit(0).alias("pos"), F.when(F.col("event_id") % 3 == 0, campaign).otherwise(url("user_id", "event_id")).alias("indicator"))
    feed = o.groupBy(url("o_custkey", "o_orderkey").alias("indicator")).agg(F.max(F.col("o_orderkey") % 6).cast("int").alias("malicious"))
    feed = feed.unionByName(spark.range(1).select(campaign.alias("indicator"), F.lit(5).alias("malicious")))
    out = enrich.enrich_long(long, feed.select(F.lit("urls").alias("kind"), "indicator", F.lit(True).alias("found"), "malicious"))
    return out.select(F.col("email_id").alias("event_id"), F.col("indicator").alias("url"), "found", "malicious")


# --- readers, writers, tables ---


@query(f"WITH {V.MAILS} SELECT email_id, subject, sender, md5(body_text) AS body_md5, lower(regexp_extract(auth_header, '(?i)spf=([a-z]+)', 1)) AS spf, 'a' || page_id || '.pdf' AS attachments FROM mails")
def read_messages(spark: SparkSession, d: str) -> DataFrame:
    """Reports as provider messages with nested parts, written as JSON lines and read back."""
    r = V.reports(spark, d)
    data = F.translate(F.replace(F.base64(F.encode("body_html", "UTF-8")), F.lit("\r\n"), F.lit("")), "+/", "-_")
    head = F.array(*[F.struct(F.lit(k).alias("name"), F.col(c).alias("value")) for k, c in (("SUBJECT", "subject"), ("from", "sender"), ("Authentication-Results", "auth_header"))])
    html = F.struct(F.lit("text/html").alias("mimeType"), F.struct(data.alias("data")).alias("body"))
    part = html
    for _ in range(5):
        part = F.struct(F.lit("multipart/mixed").alias("mimeType"), F.array(part).alias("parts"))
    pdf = F.struct(F.lit("application/pdf").alias("mimeType"), F.concat(F.lit("a"), F.col("page_id").cast("string"), F.lit(".pdf")).alias("filename"))
    payload = F.struct(F.lit("multipart/mixed").alias("mimeType"), head.alias("headers"), F.array(F.to_json(part), F.to_json(pdf)).alias("p"))
    rows = r.select(F.struct(F.col("email_id").alias("id"), payload.alias("payload")).alias("m"))
    line = F.concat(F.lit('{"id":"'), F.col("m.id"), F.lit('","payload":{"headers":'), F.to_json("m.payload.headers"), F.lit(',"parts":['), F.array_join("m.payload.p", ","), F.lit("]}}"))
    path = scratch(spark, "messages")
    rows.select(line).write.text(path)
    m = messages.read_messages_json(spark, path)
    return m.select("email_id", "subject", "sender", F.md5(F.encode("body_text", "UTF-8")).alias("body_md5"), F.try_element_at("auth", F.lit("spf")).alias("spf"), F.array_join("attachment_names", " ").alias("attachments"))


@query(f"WITH {V.FINDINGS} SELECT email_id, source, CASE WHEN verdict = 'unknown' THEN 'unknown' ELSE verdict END AS verdict, category, '[\"' || confidence || '\"]' AS key_indicators, '{{}}' AS enrichment, '' AS summary FROM f")
def result_logs(spark: SparkSession, d: str) -> DataFrame:
    """Results as JSON logs, read back and normalised; unknown verdicts are left out of the logs."""
    f = V.findings(spark, d)
    path = scratch(spark, "logs")
    messages.write_result_logs(f.select("source", "email_id", F.when(F.col("verdict") != "unknown", F.col("verdict")).alias("verdict"), "category", F.array("confidence").alias("key_indicators")), path)
    back = messages.import_result_logs(spark, path)
    return back.select("email_id", "source", "verdict", "category", "key_indicators", "enrichment", "summary")


@query(f"WITH {V.FINDINGS} SELECT id, verdict, CASE WHEN id % 2 = 0 THEN mailbox END AS mailbox FROM f")
def evolving_tables(spark: SparkSession, d: str) -> DataFrame:
    """Rows appended to a table of today and to one of an older form, read as one."""
    f, old, new = V.findings(spark, d), scratch(spark, "old"), scratch(spark, "new")
    messages.append_rows(f.filter("id % 2 = 1").select("id", "verdict"), old)
    messages.append_rows(f.filter("id % 4 = 0").select("id", "verdict", "mailbox"), new)
    messages.append_rows(f.filter("id % 4 = 2").select("id", "verdict", "mailbox"), new)
    return messages.read_findings_evolving(spark, old, new).select("id", "verdict", "mailbox")


@query(f"WITH {V.REPORTS}, {V.BLOCKED} SELECT email_id, 'malicious' AS verdict, 'blocked_sender' AS category, 'high' AS confidence, lower(regexp_extract(auth_header, '(?i)spf=([a-z]+)', 1)) AS spf FROM r WHERE lower(regexp_extract(sender, '<([^<>]*)>', 1)) IN (SELECT address FROM b)")
def blocked_findings(spark: SparkSession, d: str) -> DataFrame:
    m = V.reports(spark, d).select("email_id", T.sender_address(F.col("sender")).alias("sender_address"), T.parse_auth_results(F.col("auth_header")).alias("auth"))
    hit, _ = findings.split_blocked(m, V.blocked_senders(spark, d))
    return findings.blocked_findings(hit).select("email_id", "verdict", "category", "confidence", F.try_element_at("auth", F.lit("spf")).alias("spf"))


@query(f"WITH {V.BLOCKED} SELECT address FROM b WHERE address NOT IN (SELECT lower(address) FROM b WHERE length(address) % 2 = 0)")
def unblock(spark: SparkSession, d: str) -> DataFrame:
    b = V.blocked_senders(spark, d)
    return findings.unblock(b, b.filter(F.char_length("address") % 2 == 0).select(F.upper("address").alias("address"))).select("address")


@query(f"WITH {V.FINDINGS} SELECT source, email_id FROM f QUALIFY row_number() OVER (PARTITION BY source ORDER BY id DESC, email_id) <= 300")
def select_messages(spark: SparkSession, d: str) -> DataFrame:
    """The newest 300 mails of each source, from the two sources put together."""
    f = V.findings(spark, d).withColumnRenamed("id", "pos")
    both = findings.union_sources(f.filter("source = 'gmail'").drop("uidvalidity"), f.filter("source = 'yahoo'"))
    return findings.select_messages(both, 300, newest=True).select("source", "email_id")


# --- streams: each runs over what is there now and gives what its batch twin gives ---


def _stream(spark: SparkSession, rows: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Rows as a stream of files, and a folder for what comes of it."""
    path = scratch(spark, name)
    rows.write.parquet(f"{path}/in")
    return spark.readStream.schema(rows.schema).parquet(f"{path}/in"), path


@query(f"WITH {V.REPORTS}, {V.BLOCKED} SELECT email_id, lower(regexp_extract(sender, '<([^<>]*)>', 1)) IN (SELECT address FROM b) AS bypassed FROM r")
def stream_route_blocked(spark: SparkSession, d: str) -> DataFrame:
    """Every mail arrives twice, is taken once, and goes its way by the block list."""
    m = V.reports(spark, d).select("source", "mailbox", "email_id", T.sender_address(F.col("sender")).alias("sender_address"), F.lit("2024-01-01").cast("timestamp").alias("received_at"))
    _, path = _stream(spark, m.unionAll(m), "mails")
    V.blocked_senders(spark, d).write.parquet(f"{path}/list")
    mails = mail.stream_emails(spark, f"{path}/in", m.schema)
    mail.to_batches(mails, f"{path}/checkpoint", mail.route_blocked(f"{path}/list", f"{path}/out")).awaitTermination()
    read = lambda part: spark.read.schema("email_id string, error string").parquet(f"{path}/out/{part}")
    return read("blocked").select("email_id", F.lit(True).alias("bypassed")).unionByName(read("analyse").select("email_id", F.lit(False).alias("bypassed")))


#: Entries of the never-block list in the stream queries: a domain and an address.
_NEVER = ("@d3.example", "S5@d5.example")
_OUTCOMES = f"""{V.FINDINGS}, t AS (
  SELECT *, CASE WHEN verdict = 'malicious' OR verdict = 'suspicious' AND category IN ('phishing', 'malware', 'scam') THEN 'block' WHEN category = 'spam' THEN 'spam' END AS a,
    CASE WHEN sender_address = lower(mailbox) THEN 'own address' WHEN ends_with(sender_address, '@d3.example') OR sender_address = 's5@d5.example' THEN 'protected address'
         WHEN dmarc = 'fail' OR spf = 'fail' AND dkim = 'fail' THEN 'sender looks forged' ELSE '' END AS why FROM f WHERE confidence = 'high')"""


@query(f"""WITH {_OUTCOMES}
SELECT 'findings' AS part, id, NULL::INT AS step, NULL AS action, NULL::INT AS success, NULL AS said FROM f
UNION ALL SELECT 'actions', id, 0, CASE WHEN a = 'spam' THEN 'spam' ELSE 'trash' END, 1, 'planned ' || CASE WHEN a = 'spam' THEN 'spam' ELSE 'trash' END FROM t WHERE a IS NOT NULL
UNION ALL SELECT 'actions', id, 1, 'block', (why = '')::INT, CASE WHEN why = '' THEN 'planned block' ELSE 'not blocked: ' || why END FROM t WHERE a = 'block'
UNION ALL SELECT 'blocked', id, NULL, NULL, NULL, sender_address FROM t WHERE a = 'block' AND why = ''""")
def stream_findings(spark: SparkSession, d: str) -> DataFrame:
    """Findings, actions and new block-list rows as a stream of three batches and a restart commits them, as rows."""
    f, path = V.findings(spark, d), scratch(spark, "findings")
    never = spark.createDataFrame([(x,) for x in _NEVER], "entry string")
    stream = lambda: spark.readStream.schema(f.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    for parts in ((0, 1), (2,)):
        for k in parts:
            f.filter(F.pmod(F.hash("id"), F.lit(3)) == k).coalesce(1).write.mode("append").parquet(f"{path}/in")
        mail.to_batches(stream(), f"{path}/checkpoint", mail.write_findings(f"{path}/out", never)).awaitTermination()
    log, no = CommitLog(spark, f"{path}/out"), lambda kind: F.lit(None).cast(kind)
    rows = log.read("findings").select(F.lit("findings").alias("part"), "id", no("int").alias("step"), no("string").alias("action"), no("int").alias("success"), no("string").alias("said"))
    rows = rows.unionAll(log.read("actions").select(F.lit("actions"), "finding_id", "step", "action", "success", "message"))
    return rows.unionAll(log.read("blocked").select(F.lit("blocked"), "finding_id", no("int"), no("string"), no("int"), "address"))


_TURNS = """e AS (SELECT event_id AS seq, CASE WHEN event_id % 3 = 0 THEN 'hot@x.example' ELSE 'u' || user_id || '@x.example' END AS address,
  event_type = 'error' AS blocks, event_type = 'purchase' AS unblocks, CASE WHEN event_type <> 'purchase' THEN 'm' || event_id END AS mail_id FROM events)"""


def _turns(spark: SparkSession, d: str) -> DataFrame:
    """Events as mails and changes of the block list in one order; a third of them concern one sender."""
    e = V.table(spark, d, "events")
    address = F.when(F.col("event_id") % 3 == 0, "hot@x.example").otherwise(F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("@x.example")))
    mail_id = F.when(F.col("event_type") != "purchase", F.concat(F.lit("m"), F.col("event_id").cast("string")))
    return e.select(address.alias("address"), F.col("event_id").alias("seq"), mail_id.alias("mail_id"), (F.col("event_type") == "error").alias("blocks"), (F.col("event_type") == "purchase").alias("unblocks"))


_ROUTED = f"""WITH {_TURNS}, s AS (SELECT *, last_value(CASE WHEN unblocks THEN 0 WHEN blocks THEN 1 END IGNORE NULLS) OVER (PARTITION BY address ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM e)
SELECT mail_id, address, coalesce(b, 0) = 1 AS bypassed FROM s WHERE mail_id IS NOT NULL"""


@query(_ROUTED)
def route_in_order(spark: SparkSession, d: str) -> DataFrame:
    """Mails routed by the blocks made before them in the same run."""
    return policy.route_in_order(_turns(spark, d)).select("mail_id", "address", "bypassed")


def _with_state(spark: SparkSession, run) -> None:
    """Runs a stream that needs the store of keyed state."""
    name, kept = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(name, None)
    spark.conf.set(name, kept)
    try:
        run()
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def _dealt_at_random(spark: SparkSession, rows: DataFrame, key: str, path: str, stream_of) -> DataFrame:
    """Last word on each key of a stream over rows that arrive in no order: three batches, the last after a restart."""
    stream = lambda: stream_of(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in"))
    for run, parts in enumerate(((2, 0), (1,))):
        for k in parts:
            rows.filter(F.pmod(F.hash(*rows.columns), F.lit(3)) == k).coalesce(1).write.mode("append").parquet(f"{path}/in")
        _last_batch(stream(), path, "update", f"run-{run}")
    out = spark.read.option("recursiveFileLookup", "true").parquet(f"{path}/out")
    return out.groupBy(key).agg(F.max_by(F.struct(*out.columns), "version").alias("r")).select("r.*")


@query(_ROUTED)
def stream_route_in_order(spark: SparkSession, d: str) -> DataFrame:
    """The same from a stream whose rows arrive in no order: three batches, each after a restart."""
    rows, path = _turns(spark, d), scratch(spark, "turns")
    for k in (2, 0, 1):
        rows.filter(F.pmod(F.hash(*rows.columns), F.lit(3)) == k).write.mode("append").parquet(f"{path}/in")
        mail.to_batches(spark.readStream.schema(rows.schema).parquet(f"{path}/in"), f"{path}/checkpoint", mail.route_in_order(f"{path}/out")).awaitTermination()
    return mail.last_routed(spark, f"{path}/out").select("mail_id", "address", "bypassed")


@query("""SELECT 'done' AS part, event_id, event_id % 5 + 1 AS attempts FROM events WHERE event_id % 5 < 3 UNION ALL SELECT 'given_up', event_id, 3 FROM events WHERE event_id % 5 >= 3""")
def stream_retries(spark: SparkSession, d: str) -> DataFrame:
    """Rows that fail nought to four times before they go through, with three attempts for each, over three batches and a restart."""
    e, path, hour = V.table(spark, d, "events").select("event_id"), scratch(spark, "retries"), iter(range(0, 10**9, 3600))
    step = lambda rows: rows.withColumn("error", F.when(F.col("attempts") < F.col("event_id") % 5, "service away"))
    now = lambda: F.timestamp_seconds(F.lit(next(hour)))
    stream = lambda: spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    for parts in ((0, 1), (2,)):
        for k in parts:
            e.filter(F.pmod(F.hash("event_id"), F.lit(3)) == k).coalesce(1).write.mode("append").parquet(f"{path}/in")
        mail.to_batches(stream(), f"{path}/checkpoint", mail.with_retries(step, f"{path}/out", 3, now)).awaitTermination()
    while mail.retry_waiting(spark, step, f"{path}/out", 3, now):
        pass
    log = CommitLog(spark, f"{path}/out")
    part = lambda name: log.read(name).select(F.lit(name).alias("part"), "event_id", F.col("attempts").cast("long").alias("attempts"))
    return part("done").unionAll(part("given_up"))


def _last_batch(stream: DataFrame, path: str, mode: str, run: str = "run") -> None:
    def each(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/{run}/batch={n}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(each).start().awaitTermination()


@query(f"WITH {V.FINDINGS} SELECT count_if(verdict = 'malicious') AS malicious, count_if(verdict = 'suspicious') AS suspicious, count_if(verdict = 'likely_benign') AS likely_benign, count_if(verdict = 'unknown') AS unknown, count(*) AS total FROM f WHERE deleted_at IS NULL")
def stream_verdict_stats(spark: SparkSession, d: str) -> DataFrame:
    """Live counts after the last batch."""
    stream, path = _stream(spark, V.findings(spark, d), "findings")
    _last_batch(mail.stream_verdict_stats(stream), path, "complete")
    out = spark.read.parquet(f"{path}/out/run")
    return out.join(out.agg(F.max("batch").alias("batch")), "batch").drop("batch")


_STATES = f"""{V.ACTIONS}, m AS (SELECT * FROM a WHERE success = 1 AND action IN ('spam', 'trash', 'restore')),
k AS (SELECT finding_id, coalesce(max(id) FILTER (action = 'restore'), -1) AS back FROM m GROUP BY 1),
s AS (SELECT m.finding_id, max(id) FILTER (action = 'trash') AS t, max(id) FILTER (action = 'spam') AS p, min(id) FILTER (action = 'trash') AS t0, min(id) FILTER (action = 'spam') AS p0 FROM m JOIN k USING (finding_id) WHERE id > back GROUP BY 1)"""


@query(f"WITH {_STATES} SELECT finding_id, CASE WHEN t IS NOT NULL THEN 'trash' WHEN p IS NOT NULL THEN 'spam' ELSE 'none' END AS mail_state, coalesce(p0 < t0, false) AS was_spam FROM k LEFT JOIN s USING (finding_id)")
def stream_mail_state(spark: SparkSession, d: str) -> DataFrame:
    """Where each finding's mail is after the last of several batches of actions, which arrive in no order."""
    found: list[DataFrame] = []
    _with_state(spark, lambda: found.append(_dealt_at_random(spark, V.mail_actions(spark, d), "finding_id", scratch(spark, "actions"), mail.stream_mail_state)))
    return found[0].select("finding_id", "mail_state", "was_spam")
