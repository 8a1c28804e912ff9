"""Readers and writers of mails, attachments, result logs and the fixed tables."""

from __future__ import annotations

import email
import email.policy
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lurewatch.functions import text as T
from lurewatch.sources.scratch import written


def header(headers: Column, name: str) -> Column:
    """First header of a name, whatever its case; empty if there is none."""
    return F.coalesce(F.get(F.filter(headers, lambda h: F.lower(h["name"]) == name.lower()), 0)["value"], F.lit(""))


#: Levels of parts that one pass lays flat; messages with deeper ones take further passes.
LEVELS = 5
PART = "struct<mime:string,filename:string,data:string,size:bigint>"


def _inside(parts: Column) -> Column:
    """The parts held by an array of (path, p), each with its path: p is a VARIANT, a path the place at every level."""
    held = lambda x: F.coalesce(F.try_variant_get(x["p"], "$.parts", "array<variant>"), F.array().cast("array<variant>"))
    return F.flatten(F.transform(parts, lambda x: F.transform(held(x), lambda c, i: F.struct(F.concat(x["path"], F.array(i)).alias("path"), c.alias("p")))))


def _flat(parts: Column) -> Column:
    """(path, part) of parts."""
    get = lambda x, path, kind: F.try_variant_get(x["p"], path, kind)
    return F.transform(parts, lambda x: F.struct(x["path"].alias("path"), F.struct(get(x, "$.mimeType", "string").alias("mime"), get(x, "$.filename", "string").alias("filename"), get(x, "$.body.data", "string").alias("data"), get(x, "$.body.size", "bigint").alias("size")).alias("part")))


def _odd_parts(parts: Column) -> Column:
    """Whether a part says it holds parts that are no list."""
    said = lambda x: F.try_variant_get(x["p"], "$.parts", "variant")
    return F.exists(parts, lambda x: said(x).isNotNull() & ~F.is_variant_null(said(x)) & F.try_variant_get(x["p"], "$.parts", "array<variant>").isNull())


def _levels(rows: DataFrame, *keep: str) -> DataFrame:
    """From row, l0 (array of path, p) and the kept columns: these, row, parts (path, part of LEVELS levels), odd, deeper (what lies below them)."""
    for k in range(LEVELS):
        rows = rows.withColumn(f"l{k + 1}", _inside(F.col(f"l{k}")))
    own = [f"l{k}" for k in range(LEVELS)]
    odd = _odd_parts(F.col(own[0]))
    for c in own[1:]:
        odd = odd | _odd_parts(F.col(c))
    return rows.select("row", *keep, F.concat(*[_flat(F.col(c)) for c in own]).alias("parts"), odd.alias("odd"), F.col(f"l{LEVELS}").alias("deeper"))


def flat_parts(messages: DataFrame) -> DataFrame:
    """From row, v (VARIANT of a message) and m: row, m, parts (each before what it holds), odd. No part is too deep.

    Most messages are done in one projection without a shuffle. Parts below LEVELS levels go through the same
    projection pass after pass, until none is left, and only what was so deep meets its message again.
    """
    root = F.array(F.struct(F.array().cast("array<int>").alias("path"), F.try_variant_get("v", "$.payload", "variant").alias("p")))
    now = written(_levels(messages.select("row", "m", root.alias("l0")), "m"), "parts")
    found, more = now.filter(F.size("deeper") == 0).select("row", "m", "parts", "odd"), []
    deep = below = now.filter(F.size("deeper") > 0)
    while not below.isEmpty():
        more.append(below.select("row", "parts", "odd"))
        below = written(_levels(below.select("row", F.explode(F.transform("deeper", lambda x: F.array(x))).alias("l0"))), "parts")
        more.append(below.filter(F.size("deeper") == 0).select("row", "parts", "odd"))
        below = below.filter(F.size("deeper") > 0)
    if more:
        every = more[0]
        for m in more[1:]:
            every = every.unionByName(m)
        gathered = every.groupBy("row").agg(F.flatten(F.collect_list("parts")).alias("parts"), F.bool_or("odd").alias("odd"))
        found = found.unionByName(deep.select("row", "m").join(gathered, "row"))
    return found.select("row", "m", F.transform(F.array_sort("parts"), lambda x: x["part"]).alias("parts"), "odd")


def _b64url(data: Column) -> Column:
    plain = F.translate(data, "-_", "+/")
    return F.make_valid_utf8(F.unbase64(F.rpad(plain, (F.ceil(F.length(plain) / 4) * 4).cast("int"), "=")).cast("string"))


def read_messages_json(spark: SparkSession, path: str, source: str = "gmail") -> DataFrame:
    """Mails from exported provider messages, one JSON document a line; a line that is none stays, with an error.

    Documents are VARIANT values, whose parts may lie at any depth (see flat_parts()).
    """
    lines = spark.read.text(path).filter("trim(value) <> ''")
    m = written(lines.select(F.monotonically_increasing_id().alias("row"), F.try_parse_json("value").alias("v")), "messages")
    is_message = F.schema_of_variant("v").startswith("OBJECT")
    get = lambda p, kind="string": F.try_variant_get("v", p, kind)
    heads = F.coalesce(get("$.payload.headers", "array<struct<name:string,value:string>>"), F.array().cast("array<struct<name:string,value:string>>"))
    head = F.struct(get("$.id").alias("id"), get("$.threadId").alias("threadId"), heads.alias("headers"))
    of = flat_parts(m.filter(is_message).select("row", "v", head.alias("m"))).select("row", "m.*", "parts", "odd")
    good = of.filter(~F.coalesce("odd", F.lit(False))).select("id", "threadId", "headers", "parts", F.lit(None).cast("string").alias("error"))
    none = lambda kind: F.lit(None).cast(kind)
    bad = m.filter(~F.coalesce(is_message, F.lit(False))).select("row").unionByName(of.filter("odd").select("row"))
    bad = bad.select(none("string").alias("id"), none("string").alias("threadId"), F.array().cast("array<struct<name:string,value:string>>").alias("headers"), F.array().cast(f"array<{PART}>").alias("parts"), F.lit("not a message").alias("error"))
    m, h = good.unionByName(bad), F.col("headers")
    blank = lambda p: F.coalesce(p["filename"], F.lit("")) == ""
    texts = F.transform(F.filter("parts", lambda p: blank(p) & p["data"].isNotNull()), lambda p: F.struct(p["mime"].alias("mime"), _b64url(p["data"]).alias("text")))
    return m.select(
        F.col("id").alias("email_id"), F.col("threadId").alias("thread_id"), F.lit(source).alias("source"), header(h, "Subject").alias("subject"),
        header(h, "From").alias("sender"), header(h, "Date").alias("date"), header(h, "Message-ID").alias("message_id"),
        T.parse_auth_results(header(h, "Authentication-Results")).alias("auth"), T.select_body(texts).alias("body_text"),
        F.transform(F.filter("parts", lambda p: ~blank(p)), lambda p: p["filename"]).alias("attachment_names"), "error",
    )


EML = "path string, subject string, sender string, date string, message_id string, auth_header string, body_text string, attachments array<struct<att_idx:int,filename:string,content_type:string,data:binary,skipped_reason:string>>, error string"


def _clean(value: object) -> str:
    """Text without lone surrogates, which damaged headers can hold."""
    return str(value or "").encode("utf-8", "replace").decode()


def _mail(name: str, raw: bytes) -> tuple:
    """A row of EML; what is damaged is empty, with an error, and hides nothing else."""
    m, errors = email.message_from_bytes(raw or b"", policy=email.policy.default), []

    def attempt(what: str, f, default):
        try:
            return f()
        except Exception as e:  # noqa: BLE001 - damaged mails are common among reports
            errors.append(f"{what}: {type(e).__name__}")
            return default

    def body() -> str:
        part = m.get_body(preferencelist=("plain", "html"))
        text = _clean(part.get_content()) if part is not None else ""
        return "<html>" + text if part is not None and part.get_content_type() == "text/html" else text

    def attachment(i: int, p) -> dict:
        inner = p.get_content_type() == "message/rfc822"
        data = attempt("attachment", lambda: p.get_payload()[0].as_bytes() if inner else p.get_payload(decode=True) or b"", None)
        filename = attempt("file name", p.get_filename, None) or ("attached_message.eml" if inner else "unnamed_attachment")
        return {"att_idx": i, "filename": _clean(filename), "content_type": p.get_content_type(), "data": data, "skipped_reason": "could not be read" if data is None else ""}

    heads = [attempt(k, lambda k=k: _clean(m.get(k)), "") for k in ("subject", "from", "date", "message-id", "authentication-results")]
    text = attempt("body", body, "")
    parts = attempt("parts", lambda: list(m.iter_attachments()) if m.is_multipart() else [], [])
    return name, *heads, text, [attachment(i, p) for i, p in enumerate(parts)], "; ".join(errors) or None


def read_eml(spark: SparkSession, path: str, source: str = "yahoo") -> DataFrame:
    """Mails from raw RFC 822 files; a file that is no mail gives a row of empty fields, a damaged one says so in `error`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([_mail(r.path, r.content) for r in b.itertuples(index=False)], columns=["path", "subject", "sender", "date", "message_id", "auth_header", "body_text", "attachments", "error"])

    rows = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, EML)
    body = F.when(F.col("body_text").startswith("<html>"), T.html_to_text(F.substr("body_text", F.lit(7)))).otherwise(F.col("body_text"))
    return rows.select(
        F.regexp_extract("path", "([^/]*)$", 1).alias("email_id"), F.lit(source).alias("source"), "subject", "sender", "date", "message_id",
        T.parse_auth_results(F.col("auth_header")).alias("auth"), body.alias("body_text"), "attachments", "error",
    )


def read_attachments(spark: SparkSession, path: str) -> DataFrame:
    """Files `<mail>/<position>_<name>` as rows: email_id, att_idx, filename, size, data. Spark's reader leaves out files without bytes."""
    m = r"([^/]+)/(\d+)_([^/]*)$"
    part = lambda i: F.regexp_extract("path", m, i)
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).filter(F.col("path").rlike(m)).select(part(1).alias("email_id"), part(2).cast("int").alias("att_idx"), part(3).alias("filename"), F.col("length").alias("size"), F.col("content").alias("data"))


RESULT = "source string, mailbox string, email_id string, subject string, sender string, email_date string, verdict string, category string, confidence string, summary string, key_indicators array<string>, recommended_action string, processed_at string, log string"


def write_result_logs(results: DataFrame, path: str) -> None:
    """One JSON record per finding, named in `log` by time, source and id, in a folder per source; a folder's records in the order of their names."""
    time = F.coalesce(F.col("processed_at").cast("timestamp"), F.current_timestamp()) if "processed_at" in results.columns else F.current_timestamp()
    named = results.withColumn("log", F.concat_ws("_", F.date_format(time, "yyyyMMdd'T'HHmmss'Z'"), "source", "email_id"))
    named.sortWithinPartitions("source", "log").write.mode("append").partitionBy("source").json(path)


def import_result_logs(spark: SparkSession, path: str, whole_files: bool = False) -> DataFrame:
    """Findings (see findings.normalize_finding()) from result logs, with log and position (1, 2, ... in the order of the names).

    Reads what write_result_logs() wrote, or with whole_files files of one JSON document each, named by their file.
    The order is worked out range by range; only a count of each range reaches the driver.
    """
    from lurewatch.operators.findings import normalize_finding

    rows = spark.read.schema(RESULT).option("multiLine", whole_files).json(path)
    rows = rows.withColumn("log", F.coalesce("log", F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "")))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    held = written(rows.repartitionByRange(ranges, "log", "email_id").withColumn("range", F.spark_partition_id()), "logs")
    before, first = 0, []
    for r in sorted(held.groupBy("range").count().collect(), key=lambda r: r["range"]):
        first.append((r["range"], before))
        before += r["count"]
    starts = spark.createDataFrame(first, "range int, before bigint")
    place = F.row_number().over(Window.partitionBy("range").orderBy("log", "email_id"))
    numbered = held.withColumn("place", place).join(starts, "range")
    return normalize_finding(numbered, more=(F.col("log"), (F.col("before") + F.col("place")).alias("position")))


def append_rows(rows: DataFrame, path: str) -> None:
    """Appends findings or mail actions to their table."""
    rows.write.mode("append").parquet(path)


def read_findings_evolving(spark: SparkSession, *paths: str) -> DataFrame:
    """Tables of different age as one: columns that an old one lacks are null."""
    out = None
    for p in paths:
        t = spark.read.option("mergeSchema", "true").parquet(p)
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    return out
