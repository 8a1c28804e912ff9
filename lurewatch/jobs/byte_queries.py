"""Registered queries over bytes and texts made of the given tables: documents of several kinds, replies, result logs, tables by day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lurewatch.functions import attachments as A
from lurewatch.functions import text as T
from lurewatch.jobs import views as V
from lurewatch.jobs.queries import NOW, query
from lurewatch.operators import files, findings
from lurewatch.operators.ledger import Ledger
from lurewatch.sources.scratch import scratch

# --- documents whose parts depend on the length of a page ---


def _signals(s: Column) -> Column:
    return F.array_join(F.transform(s, lambda x: x["signal"]), " ").alias("signals")


_PDF = [(2, "/OpenAction "), (3, "/JavaScript "), (5, "/Launch "), (7, "/EmbeddedFile "), (11, "/RichMedia "), (13, "/GoToR "), (17, "/Encrypt ")]


def _has(key: str) -> str:
    return f"regexp_matches(doc, '/{key}([^A-Za-z0-9]|$)')"


def _any(*keys: str) -> str:
    return "(" + " OR ".join(map(_has, keys)) + ")"


_JS, _AUTO = _any("JavaScript", "JS"), _any("OpenAction", "AA", "Launch")
_PDF_DOC = " || ".join(f"CASE WHEN length(html) % {k} = 0 THEN '{p}' ELSE '' END" for k, p in _PDF)


@query(f"""WITH p AS (SELECT page_id, url, '%PDF-1.4 ' || {_PDF_DOC} || '/URI (' || url || ') ' || html AS doc FROM pages)
SELECT page_id, regexp_replace(url, '[.,;:!?)\\]}}>''"]+$', '') AS urls, concat_ws(' ', CASE WHEN {_has('Launch')} THEN 'pdf_launch_action' END, CASE WHEN {_JS} AND {_AUTO} THEN 'pdf_javascript_autorun' END,
  CASE WHEN {_JS} AND NOT {_AUTO} THEN 'pdf_javascript' END, CASE WHEN {_has('EmbeddedFile')} THEN 'pdf_embedded_file' END, CASE WHEN {_has('RichMedia')} THEN 'pdf_rich_media' END,
  CASE WHEN {_any('SubmitForm', 'ImportData', 'GoToR')} THEN 'pdf_remote_actions' END, CASE WHEN {_has('Encrypt')} THEN 'pdf_encrypted' END) AS signals FROM p""")
def pdf_signals(spark: SparkSession, d: str) -> DataFrame:
    """Pages inside PDF files that link to them: what the scan finds, and the link alone as URL, whatever the page holds."""
    p = V.table(spark, d, "pages")
    parts = F.concat(*[F.when(F.char_length("html") % k == 0, x).otherwise("") for k, x in _PDF])
    doc = F.concat(F.lit("%PDF-1.4 "), parts, F.lit("/URI ("), "url", F.lit(") "), "html")
    text = p.select("page_id", files.pdf_text(F.encode(doc, "UTF-8")).alias("pdf"))
    return text.select("page_id", F.array_join(T.urls_from_text(F.array_join(A.pdf_link_targets(F.col("pdf")), "\n")), " ").alias("urls"), _signals(A.pdf_features(F.col("pdf"))["signals"]))


_RTF = [(2, "\\objdata "), (3, "\\objupdate "), (5, "Equation.3 "), (7, "{\\*\\template http://t.example/x}")]
_RTF_DOC = " || ".join(f"CASE WHEN length(html) % {k} = 0 THEN '{p}' ELSE '' END" for k, p in _RTF)
_IN = lambda s: f"contains(lower(doc), '{s}')"


@query(f"""WITH p AS (SELECT page_id, '{{\\rtf1 ' || {_RTF_DOC} || html || '}}' AS doc FROM pages)
SELECT page_id, concat_ws(' ', CASE WHEN {_IN(chr(92) + 'objdata')} THEN 'rtf_embedded_object' END, CASE WHEN {_IN(chr(92) + 'objdata')} AND ({_IN(chr(92) + 'objupdate')} OR {_IN(chr(92) + 'objautlink')}) THEN 'rtf_auto_updating_object' END,
  CASE WHEN {_IN('equation.3')} THEN 'rtf_equation_editor' END, CASE WHEN regexp_matches(doc, '(?i)\\\\\\*\\\\template\\s+(https?:|file:)') THEN 'remote_template' END) AS signals FROM p""")
def rtf_signals(spark: SparkSession, d: str) -> DataFrame:
    """Pages inside RTF files with objects and templates."""
    p = V.table(spark, d, "pages")
    parts = F.concat(*[F.when(F.char_length("html") % k == 0, x).otherwise("") for k, x in _RTF])
    return p.select("page_id", _signals(A.rtf_signals(F.encode(F.concat(F.lit("{\\rtf1 "), parts, "html", F.lit("}")), "UTF-8"))))


_STARTS = ("AutoOpen()", "Document_Open()", "Main()", "workbook_open()")
_USES = ("", "Shell x", "CreateObject y", "x = Environ z", "powershell -nop")
_MACRO_DOC = f"""'Sub ' || [{', '.join(repr(x) for x in _STARTS)}][length(text) % 4 + 1] || chr(10) || [{', '.join(repr(x) for x in _USES)}][length(text) % 5 + 1] || chr(10) || replace(regexp_replace(text, '[^\\x00-\\x7F]', '_', 'g'), '://', ':')"""


@query(f"""WITH p AS (SELECT doc_id, {_MACRO_DOC} AS doc FROM documents), m AS (SELECT doc_id, regexp_matches(doc, '{A.AUTORUN}') AS a, {' OR '.join(f"regexp_matches(doc, '{r}')" for r in A.MACRO_RULES.values())} AS u, len(regexp_extract_all(doc, '(?i)\\bChrW?\\s*\\(')) > 30 AS c FROM p)
SELECT doc_id, concat_ws(' ', CASE WHEN a AND u THEN 'vba_autoexec_suspicious' WHEN a THEN 'vba_autoexec' WHEN u THEN 'vba_suspicious_keywords' END, CASE WHEN c THEN 'vba_obfuscated_strings' END) AS signals FROM m""")
def macro_source_signals(spark: SparkSession, d: str) -> DataFrame:
    """Documents as macro text that starts by itself or not and uses more or less of the machine."""
    n = F.char_length("text")
    pick = lambda items: F.get(F.array(*map(F.lit, items)), (n % len(items)).cast("int"))
    plain = F.replace(F.regexp_replace("text", r"[^\x00-\x7F]", "_"), F.lit("://"), F.lit(":"))
    doc = F.concat(F.lit("Sub "), pick(_STARTS), F.lit("\n"), pick(_USES), F.lit("\n"), plain)
    return V.table(spark, d, "documents").select("doc_id", _signals(A.macro_source_signals(doc)))


@query(r"SELECT doc_id, len(s)::INT AS n, md5(array_to_string(s, chr(10))) AS strings FROM (SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[\x20-\x7e]{6,}'), lambda x: x) AS s FROM documents)")
def binary_strings(spark: SparkSession, d: str) -> DataFrame:
    """Printable runs of documents as if they were binary files, between bytes that are none."""
    s = A.binary_strings(F.concat(F.unhex(F.lit("0001FF")), F.encode(F.coalesce("text", F.lit("")), "UTF-8"), F.unhex(F.lit("00"))))
    rows = V.table(spark, d, "documents").select("doc_id", s.alias("s"))
    return rows.select("doc_id", F.size("s").alias("n"), F.md5(F.array_join("s", "\n").cast("binary")).alias("strings"))


# --- result logs ---


@query(f"""WITH {V.FINDINGS}, logs AS (SELECT *, strftime(processed_at, '%Y%m%dT%H%M%SZ') || '_' || source || '_' || email_id AS log FROM f)
SELECT row_number() OVER (ORDER BY log) AS position, log, email_id, source, verdict, category, '["' || confidence || '"]' AS key_indicators, '{{}}' AS enrichment, '' AS summary FROM logs""")
def import_result_logs(spark: SparkSession, d: str) -> DataFrame:
    """Results as JSON logs, taken back in the order of their names with defaults; unknown verdicts and sources are not in the logs."""
    from lurewatch.sources import messages

    f, path = V.findings(spark, d), scratch(spark, "logs")
    known = F.when(F.col("verdict") != "unknown", F.col("verdict"))
    messages.write_result_logs(f.select("source", "email_id", "processed_at", known.alias("verdict"), "category", F.array("confidence").alias("key_indicators")), path)
    return messages.import_result_logs(spark, path).select("position", "log", "email_id", "source", "verdict", "category", "key_indicators", "enrichment", "summary")


# --- mails and findings ---


@query("SELECT source, email_id FROM (SELECT event_type AS source, event_id AS email_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) <= 2000)")
def select_messages_default(spark: SparkSession, d: str) -> DataFrame:
    """The newest mails of each source, as many as a run takes where no number is given."""
    e = V.table(spark, d, "events").select(F.col("event_type").alias("source"), F.col("event_id").alias("pos"), F.col("event_id").alias("email_id"))
    return findings.select_messages(e, newest=True).select("source", "email_id")


@query(f"""WITH {V.FINDINGS}, {V.ACTIONS}, g AS (SELECT id FROM f WHERE id % 10 = 0 AND id % 20 <> 0)
SELECT 'findings' AS part, id, CASE WHEN id % 7 = 0 AND id % 10 <> 0 THEN {NOW} - INTERVAL 1 DAY END AS deleted_at FROM f WHERE id NOT IN (SELECT id FROM g)
UNION ALL SELECT 'actions', a.id, NULL FROM a JOIN f ON a.finding_id = f.id WHERE f.id NOT IN (SELECT id FROM g)
UNION ALL SELECT 'logs', id, NULL FROM f WHERE id NOT IN (SELECT id FROM g)""")
def purge_by_day(spark: SparkSession, d: str) -> DataFrame:
    """Findings by day: some deleted long ago, some yesterday, some restored; what a purge leaves of all three tables."""
    f, t = V.findings(spark, d).drop("deleted_at"), Ledger(spark, scratch(spark, "ledger"))
    f = f.withColumn("processed_at", F.col("processed_at") + F.make_dt_interval((F.col("id") % 30).cast("int")))
    day = F.to_date("processed_at").alias("day")
    t.append("findings", f.coalesce(4))
    a = V.mail_actions(spark, d)
    t.append("actions", a.join(f.select(F.col("id").alias("finding_id"), day), "finding_id").coalesce(4))
    t.append("logs", f.select("email_id", "id", day).coalesce(4))
    ids = lambda k: f.filter(F.col("id") % k == 0).select("id")
    t.soft_delete(ids(10), F.expr(NOW) - F.expr("INTERVAL 8 DAYS"))
    t.soft_delete(ids(7), F.expr(NOW) - F.expr("INTERVAL 1 DAY"))
    t.restore(ids(20))
    t.purge(F.expr(NOW))
    none = F.lit(None).cast("timestamp")
    rows = t.findings().select(F.lit("findings").alias("part"), "id", "deleted_at")
    return rows.unionAll(t._raw("actions").select(F.lit("actions"), "id", none)).unionAll(t._raw("logs").select(F.lit("logs"), "id", none))
