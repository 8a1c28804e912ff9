"""Column functions of the action policy."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RETENTION_DAYS = 7


def decide_action(verdict: Column, category: Column) -> Column:
    """block_and_trash, spam or null; case does not matter and nulls decide nothing."""
    v, c = F.lower(F.coalesce(verdict, F.lit(""))), F.lower(F.coalesce(category, F.lit("")))
    return F.when((v == "malicious") | ((v == "suspicious") & c.isin("phishing", "malware", "scam")), "block_and_trash").when(c == "spam", "spam")


def looks_forged(auth: Column) -> Column:
    """The domain's own check failed, or both others did."""
    failed = lambda k: F.coalesce(F.try_element_at(auth, F.lit(k)) == "fail", F.lit(False))
    return failed("dmarc") | (failed("spf") & failed("dkim"))


def check_block(address: Column, auth: Column, own: Column, protected: Column) -> Column:
    """Struct allowed, overridable, reason. own and protected are booleans; see operators.policy for the joins."""
    a = F.coalesce(address, F.lit(""))
    reason = (
        F.when(~F.contains(a, F.lit("@")), "no usable sender address")
        .when(F.coalesce(own, F.lit(False)), "own address")
        .when(F.coalesce(protected, F.lit(False)), "protected address")
        .when(looks_forged(auth), "sender looks forged")
        .otherwise("")
    )
    return F.struct((reason == "").alias("allowed"), (reason == "sender looks forged").alias("overridable"), reason.alias("reason"))


def is_actionable(source: Column, message_id: Column, uidvalidity: Column) -> Column:
    """Older rows of one source carry nothing by which their mail can be found again."""
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    return ~((source == "yahoo") & blank(message_id) & blank(uidvalidity))


def suggested_action(action: Column, mail_state: Column, confidence: Column) -> Column:
    moved = F.coalesce(mail_state, F.lit("")).isin("spam", "trash")
    return F.when(action.isNotNull() & ~moved & (F.lower(F.coalesce(confidence, F.lit(""))) != "high"), action)


def days_until_purge(deleted_at: Column, now: Column, days: int = RETENTION_DAYS) -> Column:
    left = F.unix_timestamp(deleted_at) + days * 86_400 - F.unix_timestamp(now)
    return F.greatest(F.lit(0), F.floor(left / 86_400)).cast("long")


def training_label(verdict: Column) -> Column:
    return F.when(verdict == "malicious", "marked_as_spam").when(verdict == "likely_benign", "marked_as_not_spam").otherwise("skipped")


def verdict_rank(verdict: Column) -> Column:
    return F.when(verdict == "likely_benign", 0).when(verdict == "unknown", 1).when(verdict == "suspicious", 2).when(verdict == "malicious", 3).otherwise(4)


def confidence_rank(confidence: Column) -> Column:
    return F.when(confidence == "high", 0).when(confidence == "medium", 1).when(confidence == "low", 2).otherwise(3)


def notification_text(verdict: Column, confidence: Column, sender: Column, subject: Column, summary: Column, action: Column) -> Column:
    """Five lines about a finding, with an icon and a label for its verdict."""
    v = F.coalesce(verdict, F.lit("unknown"))
    icon = F.when(v == "malicious", "🚨").when(v == "suspicious", "⚠️").when(v == "likely_benign", "✅").otherwise("❓")
    label = F.when(v == "malicious", "Phishing").when(v == "suspicious", "Suspicious").when(v == "likely_benign", "Legitimate").otherwise(F.initcap(F.replace(v, F.lit("_"), F.lit(" "))))
    line = lambda name, c, missing: F.concat(F.lit(f"*{name}:* "), F.coalesce(c, F.lit(missing)))
    head = F.concat(icon, F.lit(" *"), label, F.lit("* (confidence: "), F.coalesce(confidence, F.lit("unknown")), F.lit(")"))
    return F.concat_ws("\n", head, line("From", sender, ""), line("Subject", subject, ""), line("Summary", summary, "No summary provided."), line("Recommended action", action, "-"))
