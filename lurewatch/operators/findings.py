"""Findings: reply parsing, payloads, listings, aggregates, and changes of the tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lurewatch.functions import policy

VERDICTS = ("malicious", "suspicious", "likely_benign", "unknown")
REPLY = "verdict string, category string, confidence string, summary string, key_indicators array<string>, recommended_action string"
BODY_CHARS, MEMBERS, FILE_URLS = 6_000, 15, 10
#: What a payload leaves out of a file's entry.
NOT_IN_PAYLOAD = ("md5", "sha1", "declared_content_type", "members")
PAGE = 200


def parse_triage_reply(text: Column) -> Column:
    """Struct of the reply and parsed (boolean): strict JSON, else what lies between the first and the last brace, else fixed values."""
    strict = {"allowSingleQuotes": "false", "mode": "PERMISSIVE"}
    t = F.coalesce(text, F.lit(""))
    inner = F.regexp_extract(t, r"(?s)\{.*\}", 0)
    is_object = lambda x: F.try_parse_json(x).isNotNull() & F.trim(x).startswith("{")
    good = F.when(is_object(t), t).when(is_object(inner), inner)
    r = F.from_json(good, REPLY, strict)
    or_else = lambda c, v: F.when(good.isNotNull(), r[c]).otherwise(F.lit(v)).alias(c)
    return F.struct(
        or_else("verdict", "unknown"), or_else("category", "unclear"), or_else("confidence", "low"), or_else("summary", "The reply could not be read."),
        F.when(good.isNotNull(), r["key_indicators"]).otherwise(F.array().cast("array<string>")).alias("key_indicators"), or_else("recommended_action", "Review by hand."),
        F.when(good.isNull(), t).alias("raw_response"), good.isNotNull().alias("parsed"),
    )


def normalize_finding(results: DataFrame, more: tuple[Column, ...] = ()) -> DataFrame:
    """Findings rows with defaults from results (source, verdict, key_indicators, extracted_iocs, enrichment, ...), and further columns."""
    has = set(results.columns)
    text = lambda c, default="": (F.coalesce(F.col(c).cast("string"), F.lit(default)) if c in has else F.lit(default)).alias(c)
    nested = lambda c, empty: (F.coalesce(F.to_json(c), F.lit(empty)) if c in has else F.lit(empty)).alias(c)
    return results.select(
        text("source", "gmail"), text("mailbox"), text("email_id"), text("subject"), text("sender"), text("email_date"), text("verdict", "unknown"), text("category"), text("confidence"), text("summary"),
        nested("key_indicators", "[]"), text("recommended_action"), nested("extracted_iocs", "{}"), nested("enrichment", "{}"), text("processed_at"), text("message_id"), text("mail_folder"), text("uidvalidity"), *more,
    )


def _trimmed_entry(f: Column, kind: StructType) -> Column:
    """A file's entry with its lists cut; members that are entries themselves are trimmed alike. Nulls are not written."""
    out = [(F.slice(f["urls"], 1, FILE_URLS) if c == "urls" else f[c]).alias(c) for c in kind.names if c not in NOT_IN_PAYLOAD]
    if "members" in kind.names:
        inner, n = kind["members"].dataType.elementType, F.size(f["members"])
        head = F.slice(f["members"], 1, MEMBERS)
        head = F.transform(head, lambda m: _trimmed_entry(m, inner)) if isinstance(inner, StructType) else head
        out += [F.when(n > 0, head).alias("members"), F.when(n > MEMBERS, n - MEMBERS).alias("members_omitted")]
    return F.struct(*out)


def build_triage_payload(mails: DataFrame) -> DataFrame:
    """email_id, payload: JSON for the triage of a mail.

    Needs subject, sender, date, body_text, attachment_names, iocs, enrichment (struct, see enrich_mails()), auth (results
    of sender authentication), signals (those of the whole mail) and files (array of structs of any fields; urls and
    members are lists, members of names or of further entries). The payload holds all of it, but for a file's md5, sha1
    and declared content type. Bodies, URL lists and member lists are cut; the input is not changed.
    """
    kind = mails.schema["files"].dataType.elementType
    files = F.transform("files", lambda f: _trimmed_entry(f, kind))
    email = F.struct("subject", "sender", "date", F.substr("body_text", F.lit(1), F.lit(BODY_CHARS)).alias("body"), "attachment_names")
    found = [F.col("enrichment")[c].alias(c) for c in mails.schema["enrichment"].dataType.names]
    enrichment = F.struct(*found, "auth", F.struct("signals", files.alias("files")).alias("attachments"))
    return mails.select("email_id", F.to_json(F.struct(email.alias("email"), F.col("iocs").alias("extracted_iocs"), enrichment.alias("enrichment"))).alias("payload"))


# --- listings ---


def filter_findings(findings: DataFrame, verdict: str = "all", source: str = "all", search: str = "") -> DataFrame:
    """Live rows; `all` and an empty search filter nothing. `%` and `_` in a search are wild cards."""
    out = findings.filter("deleted_at IS NULL")
    if verdict != "all":
        out = out.filter(F.col("verdict") == verdict)
    if source != "all":
        out = out.filter(F.col("source") == source)
    if search:
        out = out.filter(F.col("subject").ilike(f"%{search}%") | F.col("sender").ilike(f"%{search}%"))
    return out


def list_findings(findings: DataFrame, sort: str = "processed_at", direction: str = "desc", limit: int = PAGE, **filters: str) -> DataFrame:
    """First page of the live rows; equal keys by processed_at, newest first, then by id."""
    by = {"verdict": policy.verdict_rank(F.col("verdict")), "confidence": policy.confidence_rank(F.col("confidence"))}.get(sort, F.col("processed_at"))
    return filter_findings(findings, **filters).orderBy(by.asc() if direction == "asc" else by.desc(), F.desc("processed_at"), "id").limit(limit)


def finding_by_id(findings: DataFrame, finding_id: int, enrichment: str = "map<string,string>") -> DataFrame:
    out = findings.filter(F.col("id") == finding_id)
    nested = {"key_indicators": "array<string>", "enrichment": enrichment}
    return out.withColumns({c: F.from_json(c, t) for c, t in nested.items() if dict(out.dtypes).get(c) == "string"})


def list_deleted(findings: DataFrame, limit: int = PAGE) -> DataFrame:
    return findings.filter("deleted_at IS NOT NULL").orderBy(F.desc("deleted_at"), "id").limit(limit)


def list_blocked(blocked: DataFrame) -> DataFrame:
    return blocked.orderBy(F.desc("created_at"), "address")


#: Messages of a source that a run takes at most.
MOST = 2_000


def _best_of_parts(keys: DataFrame, n: int, newest: bool) -> DataFrame:
    """source, pos, email_id of the first n (or newest n) rows of each source in each partition: no more is held or sent on."""
    order = [("source", "ascending"), ("pos", "descending" if newest else "ascending"), ("email_id", "ascending")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            new = pa.Table.from_batches([batch])
            rows = (new if held is None else pa.concat_tables([held, new])).sort_by(order)
            source = rows.column("source").combine_chunks().dictionary_encode(null_encoding="encode")
            source = source.indices.to_numpy(zero_copy_only=False) if isinstance(source, pa.DictionaryArray) else source.combine_chunks().indices.to_numpy(zero_copy_only=False)
            begin = np.r_[True, source[1:] != source[:-1]] if len(source) else np.zeros(0, bool)
            place = np.arange(len(source)) - np.flatnonzero(begin)[np.cumsum(begin) - 1] if len(source) else np.zeros(0, int)
            held = rows.filter(pa.array(place < n)).combine_chunks()
        if held is not None:
            yield from held.to_batches()

    return keys.mapInArrow(run, keys.schema)


def select_messages(mails: DataFrame, n: int | None = None, newest: bool = False) -> DataFrame:
    """First n of each source by pos, or the newest n; at most MOST in any case. Equal pos by email_id; rows without a pos come last.

    In two steps: each partition keeps its own first n places, and what is left is cut at the place of the nth; then
    the mails up to that place are numbered. No task sorts a source, however many mails it has.
    """
    most = min(n or MOST, MOST)
    place = F.struct(F.isnull("pos").alias("none"), (-F.col("pos") if newest else F.col("pos")).alias("pos"), "email_id")
    by = Window.partitionBy("source").orderBy("_place")
    best = _best_of_parts(mails.select("source", "pos", "email_id"), most, newest).withColumn("_place", place)
    last = best.withColumn("_n", F.row_number().over(by)).filter(F.col("_n") <= most)
    cut = last.groupBy(F.col("source").alias("_source")).agg(F.max("_place").alias("_cut"))
    some = mails.withColumn("_place", place).join(cut, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_place") <= F.col("_cut")))
    return some.withColumn("_n", F.row_number().over(by)).filter(F.col("_n") <= most).drop("_n", "_place", "_source", "_cut")


# --- aggregates ---


def verdict_stats(findings: DataFrame) -> DataFrame:
    """One row of live counts per verdict and in all; the total holds other verdicts too."""
    return findings.filter("deleted_at IS NULL").agg(*[F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS], F.count(F.lit(1)).alias("total"))


def count_deleted(findings: DataFrame) -> DataFrame:
    return findings.agg(F.count("deleted_at").alias("n_deleted"))


def list_sources(findings: DataFrame) -> DataFrame:
    return findings.filter("deleted_at IS NULL").select("source").distinct().orderBy("source")


def action_history(actions: DataFrame) -> DataFrame:
    """finding_id, history: actions of a finding, oldest first."""
    row = F.struct("id", "action", "trigger", "success", "created_at")
    return actions.filter("finding_id IS NOT NULL").groupBy("finding_id").agg(F.array_sort(F.collect_list(row)).alias("history"))


def run_summary(results: DataFrame) -> DataFrame:
    """source, total, processed, failed."""
    return results.groupBy("source").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("error").isNull()).alias("processed"), F.count("error").alias("failed"))


def failures(results: DataFrame) -> DataFrame:
    return results.filter("error IS NOT NULL").select("source", "message_id", "error")


def bulk_results(steps: DataFrame) -> DataFrame:
    """finding_id, ok, message: failed steps' messages, or all of them if none failed. steps: finding_id, step, ok, message."""
    rows = F.array_sort(F.collect_list(F.struct("step", "ok", "message")))
    out = steps.groupBy("finding_id").agg(rows.alias("s"))
    failed = F.filter("s", lambda x: ~x["ok"])
    said = F.when(F.size(failed) > 0, failed).otherwise(F.col("s"))
    return out.select("finding_id", (F.size(failed) == 0).alias("ok"), F.array_join(F.transform(said, lambda x: x["message"]), "; ").alias("message"))


def bulk_summary(steps: DataFrame) -> DataFrame:
    return bulk_results(steps).agg(F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("failed"))


def blocked_upsert(history: DataFrame) -> DataFrame:
    """One row per lower-cased address: the first row's fields, with the newest filter id that is not null."""
    fields = [c for c in history.columns if c not in ("address", "seq", "filter_id")]
    keyed = history.withColumn("address", F.lower("address"))
    return keyed.groupBy("address").agg(F.min_by(F.struct(*fields), "seq").alias("first"), F.max_by("filter_id", F.when(F.col("filter_id").isNotNull(), F.col("seq"))).alias("filter_id")).select("address", "first.*", "filter_id")


# --- joins ---


def split_blocked(mails: DataFrame, blocked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mails of blocked senders, and the others. Spark broadcasts the list only while its size allows."""
    keys = blocked.select(F.lower("address").alias("sender_address")).distinct()
    return mails.join(keys, "sender_address", "left_semi"), mails.join(keys, "sender_address", "left_anti")


def blocked_findings(mails: DataFrame) -> DataFrame:
    """Findings for mails of blocked senders: no analysis, authentication kept."""
    fixed = {"verdict": "malicious", "category": "blocked_sender", "confidence": "high", "summary": "Sender is on the block list.", "recommended_action": "None: already blocked."}
    return mails.withColumns({k: F.lit(v) for k, v in fixed.items()})


def findings_view(findings: DataFrame, actions: DataFrame, blocked: DataFrame) -> DataFrame:
    """Listed findings with sender_blocked, suggested_action, mail_history and actionable.

    Actions are cut to the listed findings before they are gathered, so a long table of them costs one scan.
    """
    listed = findings.select(F.col("id").alias("finding_id"))
    history = action_history(actions.join(listed, "finding_id", "left_semi"))
    keys = blocked.select(F.lower("address").alias("sender_address")).distinct().withColumn("sender_blocked", F.lit(True))
    out = findings.join(history.withColumnRenamed("finding_id", "id"), "id", "left").join(keys, "sender_address", "left")
    action = policy.decide_action(F.col("verdict"), F.col("category"))
    return out.withColumns({
        "sender_blocked": F.coalesce("sender_blocked", F.lit(False)),
        "mail_history": F.coalesce("history", F.array().cast(dict(history.dtypes)["history"])),
        "suggested_action": policy.suggested_action(action, F.col("mail_state"), F.col("confidence")),
        "actionable": policy.is_actionable(F.col("source"), F.col("message_id"), F.col("uidvalidity")),
    }).drop("history")


# --- table changes ---


def soft_delete(findings: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """Sets deleted_at of the named rows where it is null. ids: column id."""
    named = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    return findings.join(named, "id", "left").withColumn("deleted_at", F.when(F.col("_hit") & F.col("deleted_at").isNull(), now).otherwise(F.col("deleted_at"))).drop("_hit")


def restore_findings(findings: DataFrame, ids: DataFrame) -> DataFrame:
    named = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    return findings.join(named, "id", "left").withColumn("deleted_at", F.when(F.col("_hit").isNull(), F.col("deleted_at"))).drop("_hit")


def expired(findings: DataFrame, now: Column, days: int = policy.RETENTION_DAYS) -> DataFrame:
    return findings.filter(F.col("deleted_at") <= now - F.expr(f"INTERVAL {days} DAYS"))


def purge_expired(findings: DataFrame, actions: DataFrame, logs: DataFrame, now: Column, days: int = policy.RETENTION_DAYS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """findings, actions (finding_id) and logs (email_id) without what has been deleted for `days` days or more."""
    gone = expired(findings, now, days)
    kept = findings.filter(~F.coalesce(F.col("deleted_at") <= now - F.expr(f"INTERVAL {days} DAYS"), F.lit(False)))
    return kept, actions.join(gone.select(F.col("id").alias("finding_id")), "finding_id", "left_anti"), logs.join(gone.select("email_id"), "email_id", "left_anti")


def unblock(blocked: DataFrame, addresses: DataFrame) -> DataFrame:
    return blocked.join(addresses.select(F.lower("address").alias("address")), "address", "left_anti")


def union_sources(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b, allowMissingColumns=True)
