"""Registered queries over the derived mail views, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lurewatch.functions import attachments as A
from lurewatch.functions import policy
from lurewatch.functions import text as T
from lurewatch.jobs import views as V
from lurewatch.operators import enrich, files, findings, policy as plans
from lurewatch.sources.scratch import written

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
NOW = "TIMESTAMP '2024-02-05 00:00:00'"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- indicators ---


@query(f"WITH {V.MAILS} SELECT email_id, length(body_text)::BIGINT AS n_chars, md5(body_text) AS body_md5 FROM mails")
def html_to_text(spark: SparkSession, d: str) -> DataFrame:
    text = V.reports(spark, d).select("email_id", T.html_to_text(F.col("body_html")).alias("t"))
    return text.select("email_id", F.char_length("t").cast("long").alias("n_chars"), F.md5(F.encode("t", "UTF-8")).alias("body_md5"))


@query(f"WITH {V.MAILS} SELECT email_id, array_to_string(urls, ' ') AS urls FROM mails")
def refang_urls(spark: SparkSession, d: str) -> DataFrame:
    return V.mail_iocs(spark, d).select("email_id", F.array_join("iocs.urls", " ").alias("urls"))


@query(f"WITH {V.MAILS} SELECT email_id, array_to_string(domains, ' ') AS domains FROM mails")
def extract_domains(spark: SparkSession, d: str) -> DataFrame:
    return V.mail_iocs(spark, d).select("email_id", F.array_join("iocs.domains", " ").alias("domains"))


_DOC = V._GUARD.replace("§", V._REFANG.replace("§", "coalesce(text, '')"))


@query(f"SELECT doc_id, array_to_string({V._IPS.replace('§', 'g')}, ' ') AS ips FROM (SELECT doc_id, {_DOC} AS g FROM documents)")
def extract_ips(spark: SparkSession, d: str) -> DataFrame:
    return V.table(spark, d, "documents").select("doc_id", F.array_join(T.extract_ips(F.coalesce("text", F.lit(""))), " ").alias("ips"))


@query(f"SELECT doc_id, array_to_string({V._HASHES.replace('§', 'g')}, ' ') AS hashes FROM (SELECT doc_id, {_DOC} AS g FROM documents)")
def extract_hashes(spark: SparkSession, d: str) -> DataFrame:
    return V.table(spark, d, "documents").select("doc_id", F.array_join(T.extract_hashes(F.coalesce("text", F.lit(""))), " ").alias("hashes"))


@query(f"WITH {V.REPORTS} SELECT email_id, lower(regexp_extract(sender, '@([\\w.-]+)', 1)) AS sender_domain, lower(regexp_extract(sender, '<([^<>]*)>', 1)) AS sender_address FROM r")
def sender_parts(spark: SparkSession, d: str) -> DataFrame:
    return V.reports(spark, d).select("email_id", T.sender_domain(F.col("sender")).alias("sender_domain"), T.sender_address(F.col("sender")).alias("sender_address"))


@query(f"WITH {V.REPORTS} SELECT email_id, lower(regexp_extract(auth_header, '(?i)spf=([a-z]+)', 1)) AS spf, lower(regexp_extract(auth_header, '(?i)dkim=([a-z]+)', 1)) AS dkim, lower(regexp_extract(auth_header, '(?i)dmarc=([a-z]+)', 1)) AS dmarc FROM r")
def auth_results(spark: SparkSession, d: str) -> DataFrame:
    auth = T.parse_auth_results(F.col("auth_header"))
    return V.reports(spark, d).select("email_id", auth.alias("a")).select("email_id", *[F.try_element_at("a", F.lit(k)).alias(k) for k in ("spf", "dkim", "dmarc")])


# --- enrichment ---

_LONG = f"""{V.MAILS}, long AS (
  SELECT email_id, 'urls' AS kind, unnest(range(0, least(5, len(urls)))) AS pos, unnest(urls[1:5]) AS indicator FROM mails UNION ALL
  SELECT email_id, 'domains', unnest(range(0, least(5, len(domains)))), unnest(domains[1:5]) FROM mails UNION ALL
  SELECT email_id, 'ips', unnest(range(0, least(5, len(ips)))), unnest(ips[1:5]) FROM mails UNION ALL
  SELECT email_id, 'hashes', unnest(range(0, least(5, len(hashes)))), unnest(hashes[1:5]) FROM mails)"""
_FOUND = "length(indicator) % 3 <> 0"


@query(f"WITH {_LONG} SELECT email_id, kind, pos::INT AS pos, indicator FROM long")
def cap_per_kind(spark: SparkSession, d: str) -> DataFrame:
    return enrich.explode_iocs(V.mail_iocs(spark, d))


@query(f"WITH {_LONG} SELECT DISTINCT kind, indicator FROM long")
def distinct_iocs(spark: SparkSession, d: str) -> DataFrame:
    return enrich.distinct_iocs(enrich.explode_iocs(V.mail_iocs(spark, d)))


@query(f"WITH {_LONG} SELECT email_id, count(*) AS n_lookups, count_if({_FOUND}) AS n_found, count_if({_FOUND} AND length(indicator) % 5 > 0) AS n_malicious, count_if({_FOUND} AND length(indicator) % 2 > 0) AS n_suspicious FROM long GROUP BY email_id")
def enrich_email(spark: SparkSession, d: str) -> DataFrame:
    long = written(enrich.explode_iocs(V.mail_iocs(spark, d)), "indicators")
    return enrich.hit_counts(enrich.enrich_long(long, V.reputation_of(enrich.distinct_iocs(long))))


_FU = f"""{V.MAILS}, fu AS (SELECT email_id, urls, domains, ['https://h' || page_id % 5 || '.example/a', urls[1], 'https://h' || page_id % 7 || '.example/b'] AS n FROM mails),
fw AS (SELECT *, list_filter(n, lambda x, i: NOT list_contains(urls, x) AND list_position(n, x) = i) AS fresh FROM fu),
fx AS (SELECT *, list_transform(fresh, lambda u: lower(regexp_extract(u, '//([^/:]*)', 1))) AS h FROM fw)"""


@query(f"WITH {_FU} SELECT email_id, array_to_string(list_concat(fresh, urls), ' ') AS urls, array_to_string(list_concat(list_reverse(list_filter(h, lambda x, i: NOT list_contains(domains, x) AND list_position(h, x) = i)), domains), ' ') AS domains FROM fx")
def merge_file_urls(spark: SparkSession, d: str) -> DataFrame:
    m = written(V.mail_iocs(spark, d).select("email_id", "page_id", "iocs"), "indicators")
    near = lambda n, s: F.concat(F.lit("https://h"), (F.col("page_id") % n).cast("string"), F.lit(f".example/{s}"))
    new = m.select("email_id", F.posexplode(F.array(near(5, "a"), F.get("iocs.urls", 0), near(7, "b"))).alias("pos", "url"))
    out = enrich.merge_file_urls(m, new)
    return out.select("email_id", F.array_join("urls", " ").alias("urls"), F.array_join("domains", " ").alias("domains"))


# --- findings ---


@query(f"WITH {V.FINDINGS} SELECT count_if(verdict = 'malicious') AS malicious, count_if(verdict = 'suspicious') AS suspicious, count_if(verdict = 'likely_benign') AS likely_benign, count_if(verdict = 'unknown') AS unknown, count(*) AS total FROM f WHERE deleted_at IS NULL")
def verdict_stats(spark: SparkSession, d: str) -> DataFrame:
    return findings.verdict_stats(V.findings(spark, d))


@query(f"WITH {V.FINDINGS} SELECT count(deleted_at) AS n_deleted FROM f")
def count_deleted(spark: SparkSession, d: str) -> DataFrame:
    return findings.count_deleted(V.findings(spark, d))


@query(f"WITH {V.FINDINGS} SELECT DISTINCT source FROM f WHERE deleted_at IS NULL")
def list_sources(spark: SparkSession, d: str) -> DataFrame:
    return findings.list_sources(V.findings(spark, d))


@query(f"WITH {V.FINDINGS} SELECT id, verdict, processed_at FROM f WHERE deleted_at IS NULL ORDER BY CASE verdict WHEN 'likely_benign' THEN 0 WHEN 'unknown' THEN 1 WHEN 'suspicious' THEN 2 WHEN 'malicious' THEN 3 ELSE 4 END DESC, processed_at DESC, id LIMIT 200")
def list_findings(spark: SparkSession, d: str) -> DataFrame:
    return findings.list_findings(V.findings(spark, d), "verdict").select("id", "verdict", "processed_at")


@query(f"WITH {V.FINDINGS} SELECT id, subject FROM f WHERE deleted_at IS NULL AND source = 'gmail' AND (subject ILIKE '%the%' OR sender ILIKE '%the%')")
def search_findings(spark: SparkSession, d: str) -> DataFrame:
    return findings.filter_findings(V.findings(spark, d), source="gmail", search="the").select("id", "subject")


@query(f"WITH {V.FINDINGS} SELECT id, deleted_at FROM f WHERE deleted_at IS NOT NULL ORDER BY deleted_at DESC, id LIMIT 200")
def list_deleted(spark: SparkSession, d: str) -> DataFrame:
    return findings.list_deleted(V.findings(spark, d)).select("id", "deleted_at")


_NOTE = "CASE verdict WHEN 'malicious' THEN '🚨 *Phishing' WHEN 'suspicious' THEN '⚠️ *Suspicious' WHEN 'likely_benign' THEN '✅ *Legitimate' ELSE '❓ *Unknown' END || '* (confidence: ' || confidence || ')' || chr(10) || '*From:* ' || sender || chr(10) || '*Subject:* ' || coalesce(subject, '') || chr(10) || '*Summary:* No summary provided.' || chr(10) || '*Recommended action:* -'"


@query(f"WITH {V.FINDINGS} SELECT id, {_NOTE} AS note FROM f")
def notification_text(spark: SparkSession, d: str) -> DataFrame:
    none, c = F.lit(None).cast("string"), F.col
    return V.findings(spark, d).select("id", policy.notification_text(c("verdict"), c("confidence"), c("sender"), c("subject"), none, none).alias("note"))


@query("""WITH c AS (SELECT *, length(text) % 4 AS i, CASE WHEN length(text) % 3 = 0 THEN 'malicious' ELSE 'suspicious' END AS v FROM conversations WHERE text IS NOT NULL)
SELECT conv_id, turn, CASE WHEN i < 2 THEN v ELSE 'unknown' END AS verdict, CASE WHEN i < 2 THEN role ELSE 'unclear' END AS category, i < 2 AS parsed,
  md5(CASE WHEN i < 2 THEN text ELSE 'The reply could not be read.' END) AS summary, md5(CASE i WHEN 2 THEN text WHEN 3 THEN text || '{''verdict'': ''' || v || '''}' END) AS raw FROM c""")
def parse_reply(spark: SparkSession, d: str) -> DataFrame:
    """Turns of conversations as replies: an object that holds the text, one between sentences, the text alone, and the text with what is no JSON."""
    c = V.table(spark, d, "conversations").filter("text IS NOT NULL")
    i, v = F.char_length("text") % 4, F.when(F.char_length("text") % 3 == 0, "malicious").otherwise("suspicious")
    one = F.to_json(F.struct(v.alias("verdict"), F.col("role").alias("category"), F.col("text").alias("summary")))
    plain = F.regexp_replace("text", "[{}]", "")
    reply = F.when(i == 0, one).when(i == 1, F.concat(plain, one, plain)).when(i == 2, F.col("text")).otherwise(F.concat("text", F.lit("{'verdict': '"), v, F.lit("'}")))
    md5 = lambda x: F.md5(x.cast("binary"))
    r = F.col("r")
    return c.select("conv_id", "turn", findings.parse_triage_reply(reply).alias("r")).select("conv_id", "turn", "r.verdict", "r.category", "r.parsed", md5(r["summary"]).alias("summary"), md5(r["raw_response"]).alias("raw"))


def _payloads(spark: SparkSession, d: str) -> DataFrame:
    """Payloads of mails with looked-up indicators, authentication, and files with URLs and members derived from their ids."""
    m = V.mail_iocs(spark, d)
    enriched = enrich.enrich_mails(m, V.reputation_of(enrich.distinct_iocs(enrich.explode_iocs(m))))
    some = lambda n, f: F.transform(F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: i < F.col("page_id") % n), f)
    url = lambda i: F.concat(F.lit("https://h"), i.cast("string"), F.lit(".example"))
    member = lambda i: F.struct(F.concat(F.lit("part"), i.cast("string")).alias("filename"), F.lit("0").alias("md5"), F.transform(F.sequence(F.lit(0), i), url).alias("urls"))
    signals = F.array(F.struct(F.lit("low").alias("severity"), F.concat(F.lit("s"), F.col("page_id").cast("string")).alias("signal")))
    f = V.files(spark, d).select("email_id", "att_idx", F.struct("att_idx", F.col("name").alias("filename"), F.octet_length("data").alias("size"), F.md5("data").alias("md5"), F.sha2("data", 256).alias("sha256"), signals.alias("signals"), some(25, url).alias("urls"), some(40, member).alias("members")).alias("file"))
    of = f.groupBy("email_id").agg(F.array_sort(F.collect_list("file")).alias("files"))
    m = m.join(enriched, "email_id").join(of, "email_id", "left").withColumns({"date": F.lit(""), "attachment_names": F.transform("files", lambda x: x["filename"]), "auth": T.parse_auth_results(F.col("auth_header")), "signals": F.array(F.struct(F.lit("low").alias("severity"), F.lit("of_mail").alias("signal")))})
    return findings.build_triage_payload(m)


@query(f"WITH {V.MAILS} SELECT email_id, least(6000, length(body_text))::BIGINT AS body_chars, len(urls)::BIGINT AS n_urls FROM mails")
def build_payload(spark: SparkSession, d: str) -> DataFrame:
    p = _payloads(spark, d).select("email_id", F.from_json("payload", "email struct<body:string>, extracted_iocs struct<urls:array<string>>").alias("p"))
    return p.select("email_id", F.char_length("p.email.body").cast("long").alias("body_chars"), F.size("p.extracted_iocs.urls").cast("long").alias("n_urls"))


@query(f"WITH {V.MAILS} SELECT email_id, ['pass', 'fail', 'none'][page_id % 3 + 1] AS spf, least(5, len(urls))::BIGINT AS n_looked_up, len(list_filter(urls[1:5], lambda u: length(u) % 3 <> 0))::BIGINT AS n_found, 'of_mail' AS signal FROM mails")
def payload_enrichment(spark: SparkSession, d: str) -> DataFrame:
    """What the payloads hold besides mail, indicators and files."""
    p = _payloads(spark, d).select("email_id", F.from_json("payload", "enrichment struct<urls:map<string,struct<found:boolean>>,auth:struct<spf:string>,attachments:struct<signals:array<struct<signal:string>>>>").alias("p"))
    urls = F.map_values(F.coalesce("p.enrichment.urls", F.create_map().cast("map<string,struct<found:boolean>>")))
    return p.select("email_id", F.col("p.enrichment.auth.spf").alias("spf"), F.size(urls).cast("long").alias("n_looked_up"), F.size(F.filter(urls, lambda x: x["found"])).cast("long").alias("n_found"), F.get("p.enrichment.attachments.signals", 0)["signal"].alias("signal"))


@query(f"WITH {V.FILES} SELECT email_id, att_idx, name, size::BIGINT AS size, sha256(html) AS sha256, 's' || page_id AS signal, false AS has_md5, least(10, page_id % 25)::BIGINT AS n_urls, least(15, page_id % 40)::BIGINT AS n_members, CASE WHEN page_id % 40 > 15 THEN page_id % 40 - 15 END::BIGINT AS members_omitted, list_sum([least(10, i + 1) for i in range(0, least(15, page_id % 40))])::BIGINT AS n_member_urls FROM x WHERE email_id IN (SELECT 'm' || page_id FROM pages)")
def payload_files(spark: SparkSession, d: str) -> DataFrame:
    """The entries of files in the payloads, after trimming."""
    member = "struct<filename:string,md5:string,urls:array<string>>"
    p = _payloads(spark, d).select("email_id", F.from_json("payload", f"enrichment struct<attachments:struct<files:array<struct<att_idx:int,filename:string,size:bigint,md5:string,sha256:string,signals:array<struct<signal:string>>,urls:array<string>,members:array<{member}>,members_omitted:bigint>>>>").alias("p"))
    f = p.select("email_id", F.explode("p.enrichment.attachments.files").alias("f"))
    members = F.coalesce("f.members", F.array().cast(f"array<{member}>"))
    n_urls = F.when(F.size(members) > 0, F.aggregate(members, F.lit(0).cast("long"), lambda a, x: a + F.size(x["urls"])))
    any_md5 = F.col("f.md5").isNotNull() | F.exists(members, lambda x: x["md5"].isNotNull())
    return f.select("email_id", "f.att_idx", F.col("f.filename").alias("name"), "f.size", "f.sha256", F.get("f.signals", 0)["signal"].alias("signal"), any_md5.alias("has_md5"), F.size("f.urls").cast("long").alias("n_urls"), F.size(members).cast("long").alias("n_members"), "f.members_omitted", n_urls.alias("n_member_urls"))


@query(f"WITH {V.FINDINGS} SELECT coalesce(source, 'gmail') AS source, count(*) AS total, count_if(verdict <> 'unknown') AS processed, count_if(verdict = 'unknown') AS failed FROM f GROUP BY 1")
def run_summary(spark: SparkSession, d: str) -> DataFrame:
    return findings.run_summary(V.findings(spark, d).withColumn("error", F.when(F.col("verdict") == "unknown", "no verdict")))


# --- policy ---

_ACTION = "CASE WHEN verdict = 'malicious' OR (verdict = 'suspicious' AND category IN ('phishing', 'malware', 'scam')) THEN 'block_and_trash' WHEN category = 'spam' THEN 'spam' END"


@query(f"WITH {V.FINDINGS} SELECT id, {_ACTION} AS action FROM f")
def decide_action(spark: SparkSession, d: str) -> DataFrame:
    return V.findings(spark, d).select("id", policy.decide_action(F.col("verdict"), F.col("category")).alias("action"))


_REASON = "CASE WHEN mailbox = sender_address THEN 'own address' WHEN sender_address = 's3@d3.example' OR split_part(sender_address, '@', 2) = 'd5.example' THEN 'protected address' WHEN dmarc = 'fail' OR (spf = 'fail' AND dkim = 'fail') THEN 'sender looks forged' ELSE '' END"


def _never(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.explode(T.parse_never_block(F.lit("S3@d3.example, @D5.example,, "))).alias("entry"))


@query(f"WITH {V.FINDINGS} SELECT id, {_REASON} = '' AS allowed, {_REASON} = 'sender looks forged' AS overridable, {_REASON} AS reason FROM f")
def check_block(spark: SparkSession, d: str) -> DataFrame:
    return plans.check_blocks(V.findings(spark, d), _never(spark)).select("id", "block.*")


@query(f"WITH {V.FINDINGS}, s AS (SELECT id, {_ACTION} AS act FROM f WHERE confidence = 'high') SELECT id, 0 AS step, CASE act WHEN 'spam' THEN 'spam' ELSE 'trash' END AS action FROM s WHERE act IS NOT NULL UNION ALL SELECT id, 1, 'block' FROM s WHERE act = 'block_and_trash'")
def plan_auto(spark: SparkSession, d: str) -> DataFrame:
    return plans.plan_auto_actions(V.findings(spark, d))


_MAN = f"""{V.FINDINGS}, q AS (SELECT user_id * 3 AS finding_id, CASE event_type WHEN 'click' THEN 'spam' WHEN 'view' THEN 'trash' WHEN 'signup' THEN 'restore' WHEN 'error' THEN 'block' ELSE 'block_and_trash' END AS action, event_id % 2 = 0 AS force FROM events),
w AS (SELECT q.*, f.id, f.source, f.source = 'yahoo' AND f.message_id IS NULL AS old, {_REASON} AS reason FROM q LEFT JOIN f ON f.id = q.finding_id),
s AS (SELECT *, 0 AS step, CASE WHEN action = 'block_and_trash' AND id IS NOT NULL AND NOT old THEN 'trash' ELSE action END AS st FROM w UNION ALL SELECT *, 1, 'block' FROM w WHERE action = 'block_and_trash' AND id IS NOT NULL AND NOT old),
m AS (SELECT *, id IS NOT NULL AND NOT old AS able, reason = '' OR (reason = 'sender looks forged' AND force) AS may FROM s),
manual AS (SELECT finding_id, step, st AS action, able AND (st <> 'block' OR may) AS ok,
  CASE WHEN id IS NULL THEN 'finding not found' WHEN NOT able THEN 'older mail, act on it in the mailbox' WHEN st = 'block' AND NOT may THEN 'not blocked: ' || reason ELSE 'planned ' || st END AS message,
  coalesce(able AND st = 'block' AND NOT may AND reason = 'sender looks forged', false) AS needs_confirm FROM m)"""


def _requests(spark: SparkSession, d: str) -> DataFrame:
    e = V.table(spark, d, "events")
    action = F.when(F.col("event_type") == "click", "spam").when(F.col("event_type") == "view", "trash").when(F.col("event_type") == "signup", "restore").when(F.col("event_type") == "error", "block").otherwise("block_and_trash")
    return e.select((F.col("user_id") * 3).alias("finding_id"), action.alias("action"), (F.col("event_id") % 2 == 0).alias("force"))


@query(f"WITH {_MAN} SELECT finding_id, step, action, ok, message, needs_confirm FROM manual")
def plan_manual(spark: SparkSession, d: str) -> DataFrame:
    out = plans.plan_manual_actions(plans.check_blocks(V.findings(spark, d), _never(spark)), _requests(spark, d))
    return out.withColumn("needs_confirm", F.coalesce("needs_confirm", F.lit(False)))


@query(f"WITH {_MAN}, g AS (SELECT finding_id, bool_and(ok) AS ok FROM manual GROUP BY finding_id) SELECT count_if(ok) AS ok, count_if(NOT ok) AS failed FROM g")
def bulk_summary(spark: SparkSession, d: str) -> DataFrame:
    return findings.bulk_summary(plan_manual(spark, d).select("finding_id", "step", "ok", "message"))


_STATE = f"""{V.ACTIONS}, mv AS (SELECT * FROM a WHERE success = 1 AND action IN ('spam', 'trash', 'restore')),
bk AS (SELECT finding_id, max(id) AS back FROM mv WHERE action = 'restore' GROUP BY 1),
sn AS (SELECT mv.finding_id, min(id) FILTER (action = 'trash') AS t0, min(id) FILTER (action = 'spam') AS s0 FROM mv LEFT JOIN bk USING (finding_id) WHERE id > coalesce(back, -1) AND action <> 'restore' GROUP BY 1),
st AS (SELECT DISTINCT mv.finding_id, CASE WHEN t0 IS NOT NULL THEN 'trash' WHEN s0 IS NOT NULL THEN 'spam' ELSE 'none' END AS mail_state, coalesce(s0 < t0, false) AS was_spam FROM mv LEFT JOIN sn USING (finding_id))"""


@query(f"WITH {_STATE} SELECT finding_id, mail_state, was_spam FROM st")
def mail_state(spark: SparkSession, d: str) -> DataFrame:
    return plans.mail_state(V.mail_actions(spark, d))


@query(f"WITH {V.ACTIONS} SELECT finding_id, count(*) AS n, string_agg(id || ':' || action || ':' || success, ' ' ORDER BY id) AS history FROM a GROUP BY finding_id")
def action_history(spark: SparkSession, d: str) -> DataFrame:
    h = findings.action_history(V.mail_actions(spark, d))
    shown = F.transform("history", lambda x: F.concat_ws(":", x["id"], x["action"], x["success"]))
    return h.select("finding_id", F.size("history").cast("long").alias("n"), F.array_join(shown, " ").alias("history"))


@query(f"WITH {V.ACTIONS} SELECT 's' || finding_id || '@x.example' AS address, min_by(trigger, id) AS reason, min_by(created_at, id) AS created_at, max_by('f' || id, id) FILTER (id % 2 = 0) AS filter_id FROM a WHERE action = 'block' GROUP BY finding_id")
def blocked_upsert(spark: SparkSession, d: str) -> DataFrame:
    a = V.mail_actions(spark, d).filter("action = 'block'")
    return findings.blocked_upsert(a.select(F.concat(F.lit("S"), F.col("finding_id").cast("string"), F.lit("@x.example")).alias("address"), F.col("trigger").alias("reason"), "created_at", F.col("id").alias("seq"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("f"), F.col("id").cast("string"))).alias("filter_id")))


@query(f"WITH {V.BLOCKED} SELECT address, created_at FROM b")
def list_blocked(spark: SparkSession, d: str) -> DataFrame:
    return findings.list_blocked(V.blocked_senders(spark, d))


@query(f"""WITH {V.FINDINGS}, {V.BLOCKED}, h AS (SELECT finding_id, count(*) AS n FROM a GROUP BY 1)
SELECT f.id, b.address IS NOT NULL AS sender_blocked, coalesce(h.n, 0) AS n_actions, CASE WHEN confidence <> 'high' THEN {_ACTION} END AS suggested_action, NOT (source = 'yahoo' AND message_id IS NULL) AS actionable
FROM (SELECT * FROM f WHERE deleted_at IS NULL ORDER BY processed_at DESC, id LIMIT 200) f LEFT JOIN b ON b.address = f.sender_address LEFT JOIN h ON h.finding_id = f.id""")
def findings_view(spark: SparkSession, d: str) -> DataFrame:
    page = findings.list_findings(V.findings(spark, d)).withColumn("mail_state", F.lit(None).cast("string"))
    out = findings.findings_view(page, V.mail_actions(spark, d), V.blocked_senders(spark, d))
    return out.select("id", "sender_blocked", F.size("mail_history").cast("long").alias("n_actions"), "suggested_action", "actionable")


@query(f"WITH {V.REPORTS}, {V.BLOCKED} SELECT email_id, lower(regexp_extract(sender, '<([^<>]*)>', 1)) IN (SELECT address FROM b) AS bypassed FROM r")
def split_blocked(spark: SparkSession, d: str) -> DataFrame:
    m = V.reports(spark, d).select("email_id", T.sender_address(F.col("sender")).alias("sender_address"))
    hit, rest = findings.split_blocked(m, V.blocked_senders(spark, d))
    return hit.select("email_id", F.lit(True).alias("bypassed")).unionByName(rest.select("email_id", F.lit(False).alias("bypassed")))


@query(f"WITH {V.FINDINGS} SELECT id, greatest(0, floor(date_diff('second', {NOW}, deleted_at + INTERVAL 7 DAYS) / 86400))::BIGINT AS days_left FROM f WHERE deleted_at IS NOT NULL")
def days_until_purge(spark: SparkSession, d: str) -> DataFrame:
    f = V.findings(spark, d).filter("deleted_at IS NOT NULL")
    return f.select("id", policy.days_until_purge(F.col("deleted_at"), F.expr(NOW)).alias("days_left"))


@query(f"WITH {V.FINDINGS}, {V.ACTIONS}, g AS (SELECT id FROM f WHERE deleted_at <= {NOW} - INTERVAL 7 DAYS) SELECT (SELECT count(*) FROM f WHERE id NOT IN (SELECT id FROM g)) AS n_findings, (SELECT count(*) FROM a WHERE finding_id NOT IN (SELECT id FROM g)) AS n_actions, (SELECT count(*) FROM f WHERE id NOT IN (SELECT id FROM g)) AS n_logs")
def purge_expired(spark: SparkSession, d: str) -> DataFrame:
    f = V.findings(spark, d)
    kept, acts, logs = findings.purge_expired(f, V.mail_actions(spark, d), f.select("email_id"), F.expr(NOW))
    one = lambda x, n: x.agg(F.count(F.lit(1)).alias(n))
    return one(kept, "n_findings").join(one(acts, "n_actions"), F.lit(True)).join(one(logs, "n_logs"), F.lit(True))


@query(f"WITH {V.FINDINGS} SELECT id, CASE WHEN id % 3 = 0 AND deleted_at IS NULL THEN {NOW} ELSE deleted_at END AS deleted_at FROM f")
def soft_delete(spark: SparkSession, d: str) -> DataFrame:
    f = V.findings(spark, d)
    return findings.soft_delete(f, f.filter("id % 3 = 0").select("id"), F.expr(NOW)).select("id", "deleted_at")


@query(f"WITH {V.FINDINGS} SELECT id, CASE WHEN id % 20 <> 0 THEN deleted_at END AS deleted_at FROM f")
def restore_findings(spark: SparkSession, d: str) -> DataFrame:
    f = V.findings(spark, d)
    return findings.restore_findings(f, f.filter("id % 20 = 0").select("id")).select("id", "deleted_at")


@query("SELECT CASE WHEN toxic = 1 THEN 'marked_as_spam' WHEN quality = 1 THEN 'marked_as_not_spam' ELSE 'skipped' END AS label, count(*) AS n FROM labels GROUP BY 1")
def training_label(spark: SparkSession, d: str) -> DataFrame:
    v = F.when(F.col("toxic") == 1, "malicious").when(F.col("quality") == 1, "likely_benign").otherwise("unknown")
    return V.table(spark, d, "labels").groupBy(policy.training_label(v).alias("label")).agg(F.count(F.lit(1)).alias("n"))


# --- files ---


@query(f"WITH {V.FILES} SELECT page_id, sha256(html) AS sha256, sha1(html) AS sha1, md5(html) AS md5 FROM x")
def file_hashes(spark: SparkSession, d: str) -> DataFrame:
    return V.files(spark, d).select("page_id", A.file_hashes(F.col("data")).alias("h")).select("page_id", "h.*")


#: What a URL becomes a file name with, by its length.
_ENDS = (".pdf.exe", ".doc .js", ".doc   .scr", ". ", ".html", ".docx", ".txt_.HTML", "\u202egpj.exe")
_ENDS_SQL = "[" + ", ".join(f"'{x}'" for x in _ENDS) + "]"
_DOUBLE = rf"(?i)\.({'|'.join(sorted(A.DOC_LIKE_EXT))})[\s. _-]*\.([a-z0-9]{{2,8}})\s*$"
_OUTER = ", ".join(f"'{x}'" for x in (*A.RUNNABLE_EXT, *A.MACRO_OFFICE_EXT, *A.HTML_EXT))


@query(f"""WITH n AS (SELECT page_id, replace(url, '/', '_') || {_ENDS_SQL}[length(url) % 8 + 1] AS raw FROM pages), s AS (SELECT page_id, raw, regexp_replace(raw, '[{A._BIDI}]', '', 'g') AS seen FROM n)
SELECT page_id, concat_ws(' ', CASE WHEN regexp_matches(raw, '[{A._BIDI}]') THEN 'bidi_filename_trick' END, CASE WHEN lower(regexp_extract(seen, '{_DOUBLE}', 2)) IN ({_OUTER}) THEN 'double_extension' END,
  CASE WHEN regexp_matches(seen, '(?i)\\.[a-z0-9]{{2,5}}\\s{{3,}}\\.[a-z0-9]{{2,5}}$') THEN 'padded_extension' END, CASE WHEN seen <> rtrim(seen, '. ') THEN 'trailing_dots_or_spaces' END) AS signals FROM s""")
def filename_signals(spark: SparkSession, d: str) -> DataFrame:
    """Names made of the URLs of pages with ends of many kinds."""
    end = F.get(F.array(*map(F.lit, _ENDS)), (F.char_length("url") % 8).cast("int"))
    s = A.filename_signals(F.concat(F.replace("url", F.lit("/"), F.lit("_")), end))
    return V.table(spark, d, "pages").select("page_id", F.array_join(F.transform(s, lambda x: x["signal"]), " ").alias("signals"))


def _kinds(spark: SparkSession, d: str) -> DataFrame:
    f = V.files(spark, d)
    return f.select("*", A.detect_kind(F.col("data"), F.col("name"), F.col("content_type")).alias("kind"), A.file_extension(F.col("name")).alias("ext"))


_KIND = "CASE WHEN html = '' THEN 'empty' WHEN contains(lower(substr(html, 1, 2000)), '<svg') THEN 'svg' WHEN regexp_matches(lower(substr(html, 1, 8192)), '<html|<!doctype html|<script|<form|<body|<iframe|<meta ') THEN 'html' ELSE 'text' END"


@query(f"SELECT page_id, {_KIND} AS kind, ['html', 'pdf', 'exe', 'docm', 'txt', 'js', 'svg', 'html'][page_id % 8 + 1] AS ext FROM pages")
def detect_kind(spark: SparkSession, d: str) -> DataFrame:
    return _kinds(spark, d).select("page_id", "kind", "ext")


_FLAGS = {k: p.replace("'", "''") for k, p in A.HTML_RULES.items()}


@query(f"""SELECT page_id, concat_ws(' ', CASE WHEN regexp_matches(html, '{_FLAGS["password_field"]}') THEN 'credential_harvest_form' END,
 CASE WHEN regexp_matches(html, '{_FLAGS["obfuscation"]}') AND regexp_matches(html, '{_FLAGS["script_tag"]}') THEN 'obfuscated_script' END, CASE WHEN regexp_matches(html, '{_FLAGS["big_encoded_blob"]}') THEN 'large_encoded_blob' END,
 CASE WHEN regexp_matches(html, '{_FLAGS["meta_refresh"]}') THEN 'meta_refresh_redirect' END, CASE WHEN regexp_matches(html, '{_FLAGS["iframe"]}') THEN 'iframe' END, 'html_attachment') AS signals FROM pages""")
def html_signals(spark: SparkSession, d: str) -> DataFrame:
    s = A.html_signals(A.decode_text(F.col("data")), F.lit(False))
    return V.files(spark, d).select("page_id", F.array_join(F.transform(s, lambda x: x["signal"]), " ").alias("signals"))


_SCRIPT = {k: p.replace("'", "''") for k, p in A.SCRIPT_RULES.items()}


@query("SELECT page_id, concat_ws(' ', " + ", ".join(f"CASE WHEN regexp_matches(html, '{p}') THEN '{k}' END" for k, p in _SCRIPT.items()) + ") AS indicators, (length(html) - length(replace(html, chr(10), '')) + 1)::INT AS lines FROM pages")
def script_signals(spark: SparkSession, d: str) -> DataFrame:
    s = A.script_signals(A.decode_text(F.col("data")), F.lit("js"))
    return V.files(spark, d).select("page_id", s.alias("s")).select("page_id", F.array_join("s.indicators", " ").alias("indicators"), "s.lines")


_SIG = """g AS (SELECT 'm' || event_id // 12 AS email_id, CASE WHEN event_id % 2 = 0 THEN (event_id % 12)::VARCHAR ELSE (event_id % 12)::VARCHAR || '/' || event_id % 3 END AS file_path, event_id AS seq, (event_id * 7 % 4)::INT AS severity, event_type AS signal, 'd' || event_id AS detail FROM events),
g2 AS (SELECT email_id, split_part(file_path, '/', 1) AS file_path, seq, severity, signal, detail FROM g)"""


def _signals(spark: SparkSession, d: str) -> DataFrame:
    e = V.table(spark, d, "events")
    top = (F.col("event_id") % 12).cast("string")
    return e.select(F.concat(F.lit("m"), F.expr("event_id div 12").cast("string")).alias("email_id"), F.when(F.col("event_id") % 2 == 0, top).otherwise(F.concat_ws("/", top, (F.col("event_id") % 3).cast("string"))).alias("file_path"), F.col("event_id").alias("seq"), (F.col("event_id") * 7 % 4).cast("int").alias("severity"), F.col("event_type").alias("signal"), F.concat(F.lit("d"), F.col("event_id").cast("string")).alias("detail"))


@query(f"WITH {_SIG}, z AS (SELECT email_id, 'all' AS file_path, signal, min(seq) AS seq, max(severity) AS severity, arg_max(detail, severity::BIGINT * 1000000000 - seq) AS detail FROM g GROUP BY 1, 2, 3) SELECT email_id, signal, severity, detail, row_number() OVER (PARTITION BY email_id ORDER BY severity DESC, seq)::INT AS rank FROM z")
def dedupe_signals(spark: SparkSession, d: str) -> DataFrame:
    return files.dedupe_signals(_signals(spark, d).withColumn("file_path", F.lit("all"))).drop("file_path")


@query(f"WITH {_SIG}, al AS (SELECT email_id, file_path, severity FROM g UNION ALL SELECT email_id, split_part(file_path, '/', 1), severity FROM g WHERE contains(file_path, '/')), fl AS (SELECT DISTINCT email_id, file_path FROM al) SELECT fl.email_id, fl.file_path, max(severity)::INT AS risk FROM fl JOIN al USING (email_id, file_path) GROUP BY 1, 2")
def rollup_risk(spark: SparkSession, d: str) -> DataFrame:
    s = _signals(spark, d)
    rows = s.select("email_id", "file_path").union(s.select("email_id", F.substring_index("file_path", "/", 1))).distinct()
    return files.rollup_risk(rows, s)


_ADM = f"""{V.FILES}, y AS (SELECT *, sum(CASE WHEN att_idx < 10 THEN size * 1000 ELSE 0 END) OVER (PARTITION BY email_id ORDER BY att_idx) AS running FROM x),
z AS (SELECT *, CASE WHEN att_idx >= 10 THEN 'more than 10 attachments; not analysed' WHEN size = 0 THEN 'empty or not downloaded' WHEN running > 62914560 THEN 'total attachment size limit reached' END AS reason FROM y)"""


def _admitted(spark: SparkSession, d: str) -> DataFrame:
    f = V.files(spark, d).select("email_id", "att_idx", "file_path", "name", (F.octet_length("data") * 1000).cast("long").alias("size"), F.lit("").alias("skipped_reason"), F.sha2("data", 256).alias("sha256"))
    return files.admit_analysis(f)


@query(f"WITH {_ADM} SELECT email_id, att_idx, reason FROM z")
def admit_stage2(spark: SparkSession, d: str) -> DataFrame:
    return _admitted(spark, d).select("email_id", "att_idx", "reason")


@query(f"WITH {_ADM}, e AS (SELECT email_id, count(reason) AS n, arg_min(reason, att_idx) FILTER (reason IS NOT NULL) AS why FROM z GROUP BY 1) SELECT email_id, CASE WHEN n > 0 THEN 'attachments_not_analysed: ' || n || ' attachment(s) not analysed (' || why || ')' ELSE '' END AS signals FROM e")
def email_signals(spark: SparkSession, d: str) -> DataFrame:
    f = _admitted(spark, d)
    bodies = f.select("email_id").distinct().withColumn("body", F.lit("The password is 123"))
    out = files.email_signals(f, _signals(spark, d).filter("false"), bodies)
    return out.select("email_id", F.array_join(F.transform("signals", lambda x: F.concat_ws(": ", x["signal"], x["detail"])), " ").alias("signals"))


@query(f"WITH {_ADM}, l AS (SELECT DISTINCT 'm' || event_id // 12 AS email_id FROM events WHERE event_type = 'error'), e AS (SELECT email_id, min(page_id // 12) AS k, count(reason) AS n, arg_min(reason, att_idx) FILTER (reason IS NOT NULL) AS why FROM z GROUP BY 1) SELECT email_id, concat_ws(' ', CASE WHEN k % 3 = 0 AND email_id IN (SELECT email_id FROM l) THEN 'encrypted_attachment_with_password_in_body: Locked attachment, and the body names a password.' END, CASE WHEN n > 0 THEN 'attachments_not_analysed: ' || n || ' attachment(s) not analysed (' || why || ')' END) AS signals FROM e")
def email_signals_locked(spark: SparkSession, d: str) -> DataFrame:
    """Signals of mails with locked archives, whose bodies name a password, do not, or are missing."""
    f = _admitted(spark, d)
    k = F.substr("email_id", F.lit(2)).cast("long") % 3
    bodies = f.select("email_id").distinct().withColumn("body", F.when(k == 0, "The password is 123").when(k == 1, "Nothing about it"))
    signals = _signals(spark, d).withColumn("signal", F.when(F.col("signal") == "error", "encrypted_archive").otherwise(F.col("signal")))
    out = files.email_signals(f, signals, bodies)
    return out.select("email_id", F.array_join(F.transform("signals", lambda x: F.concat_ws(": ", x["signal"], x["detail"])), " ").alias("signals"))


@query(f"WITH {_ADM}, c AS (SELECT *, (att_idx * 5 % 4) AS risk FROM z WHERE reason IS NULL), o AS (SELECT email_id, sha256(html) AS sha256, min((3 - risk) * 1000 + CASE file_path WHEN '1' THEN 1 WHEN '10' THEN 2 WHEN '11' THEN 3 WHEN '0' THEN 0 ELSE att_idx + 2 END) AS k FROM c GROUP BY 1, 2), p AS (SELECT email_id, sha256, row_number() OVER (PARTITION BY email_id ORDER BY k) AS place FROM o) SELECT c.email_id, c.att_idx, p.place::INT AS place, p.place <= 5 AS looked_up FROM c JOIN p ON p.email_id = c.email_id AND p.sha256 = sha256(c.html)")
def rank_hash_lookups(spark: SparkSession, d: str) -> DataFrame:
    f = _admitted(spark, d).withColumns({"kind": F.lit("pdf"), "risk": (F.col("att_idx") * 5 % 4).cast("int")})
    return files.rank_hash_lookups(f).select("email_id", "att_idx", "place", "looked_up")


@query(f"WITH {V.FILES}, z AS (SELECT email_id, att_idx, size, row_number() OVER () AS rn FROM x) SELECT email_id, att_idx, CASE WHEN att_idx >= 10 THEN 'too many attachments' WHEN size > 6000 THEN 'larger than the limit' ELSE '' END AS skipped_reason FROM z")
def admit_stage1(spark: SparkSession, d: str) -> DataFrame:
    f = V.files(spark, d).select("email_id", "att_idx", F.octet_length("data").cast("long").alias("size"))
    return files.admit_downloads(f, 6000).select("email_id", "att_idx", "skipped_reason")
