"""Action plans: what may be blocked, what is done by itself, what people asked for, and where a mail is now."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lurewatch.functions import policy
from lurewatch.sources.scratch import written


def protected_senders(rows: DataFrame, never_block: DataFrame) -> DataFrame:
    """Adds is_own and is_protected to rows (sender_address, mailbox). never_block: column entry.

    Address and domain are joined one after the other by equality; neither join is an OR.
    """
    entries = never_block.select(F.ltrim(F.lower(F.trim("entry")), F.lit("@")).alias("entry")).filter("entry <> ''").distinct()
    out = rows.withColumn("_domain", F.when(F.contains("sender_address", F.lit("@")), F.substring_index("sender_address", "@", -1)).otherwise(""))
    out = out.join(entries.select(F.col("entry").alias("sender_address"), F.lit(True).alias("_a")), "sender_address", "left").join(entries.select(F.col("entry").alias("_domain"), F.lit(True).alias("_d")), "_domain", "left")
    flags = {"is_own": F.coalesce(F.lower("mailbox") == F.col("sender_address"), F.lit(False)), "is_protected": F.coalesce("_a", F.lit(False)) | F.coalesce("_d", F.lit(False))}
    return out.withColumns(flags).drop("_domain", "_a", "_d")


def check_blocks(rows: DataFrame, never_block: DataFrame) -> DataFrame:
    """Adds block: struct allowed, overridable, reason. Needs sender_address, mailbox, auth."""
    out = protected_senders(rows, never_block)
    return out.withColumn("block", policy.check_block(F.col("sender_address"), F.col("auth"), F.col("is_own"), F.col("is_protected")))


def plan_auto_actions(findings: DataFrame, enabled: bool = True) -> DataFrame:
    """id, step, action for findings of high confidence: spam alone, or trash and then block."""
    action = policy.decide_action(F.col("verdict"), F.col("category"))
    rows = findings.filter(F.lit(enabled) & (F.lower(F.coalesce("confidence", F.lit(""))) == "high") & action.isNotNull())
    steps = F.when(action == "spam", F.array(F.lit("spam"))).otherwise(F.array(F.lit("trash"), F.lit("block")))
    return rows.select("id", F.posexplode(steps).alias("step", "action"))


def auto_outcomes(findings: DataFrame, never_block: DataFrame, enabled: bool = True) -> DataFrame:
    """finding_id, step, action, trigger, success, message: automatic actions as they are logged. Needs what check_blocks() needs.

    A sender that must not be blocked gives a failed step with the reason; force is for people only.
    """
    planned = plan_auto_actions(findings, enabled)
    judged = check_blocks(findings.select("id", "sender_address", "mailbox", "auth"), never_block).select("id", "block")
    rows = planned.join(judged, "id")
    refused = (F.col("action") == "block") & ~F.col("block.allowed")
    message = F.when(refused, F.concat(F.lit("not blocked: "), F.col("block.reason"))).otherwise(F.concat(F.lit("planned "), F.col("action")))
    return rows.select(F.col("id").alias("finding_id"), "step", "action", F.lit("auto").alias("trigger"), F.when(refused, 0).otherwise(1).alias("success"), message.alias("message"))


#: Pieces, at least, into which mails and changes of the block list are cut in their order.
PIECES = 64


def route_in_order(rows: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """Mails with bypassed: whether their sender is blocked by what comes before them in one order of mails and changes.

    rows: address, seq, mail_id (null: no mail), blocks, unblocks (see streaming.mail.stream_route_in_order()); listed:
    address of senders blocked before all rows. Mails and changes are sorted by address and place and cut into pieces of
    about one size, so one sender may send any share of them. Inside a piece a mail finds the last change before it by a
    running value; where an address goes on from earlier pieces, its last change there comes in by a join (a row a piece
    at most). Of changes at one place an unblock counts; a mail does not see those at its own place.
    """
    placed = rows.filter("address IS NOT NULL AND seq IS NOT NULL")
    changes = placed.filter("blocks OR unblocks").select("address", "seq", F.coalesce("unblocks", F.lit(False)).alias("_undo"))
    if listed is not None:  # nulls come first in the order
        changes = changes.unionByName(listed.filter("address IS NOT NULL").select("address", F.lit(None).cast("long").alias("seq"), F.lit(False).alias("_undo")))
    turns = placed.filter("mail_id IS NOT NULL").withColumn("_undo", F.lit(None).cast("boolean")).unionByName(changes, allowMissingColumns=True)
    n = max(PIECES, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cut = written(turns.repartitionByRange(n, "address", "seq").withColumn("_piece", F.spark_partition_id()), "in-order")
    at = lambda undo, seq: F.max(F.when(F.col("_undo") == undo, seq))
    ends = cut.groupBy("address", "_piece").agg(at(True, F.col("seq")).alias("u"), at(False, F.coalesce("seq", F.lit(-(1 << 63)))).alias("b"))
    ends = ends.select("address", "_piece", F.when(F.coalesce("u", "b").isNotNull(), F.coalesce(F.col("u") >= F.col("b"), F.col("u").isNotNull())).alias("_end"))
    earlier = Window.partitionBy("address").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("address", "_piece", F.last("_end", True).over(earlier).alias("_carried")).filter("_carried IS NOT NULL").limit(n)
    so_far = Window.partitionBy("_piece", "address").orderBy("seq", F.col("_undo").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mails = cut.withColumn("_last", F.last("_undo", True).over(so_far)).filter("mail_id IS NOT NULL").join(F.broadcast(carried), ["address", "_piece"], "left")
    out = mails.select(*rows.columns, (~F.coalesce("_last", "_carried", F.lit(True))).alias("bypassed"))
    return out.unionByName(rows.filter("(address IS NULL OR seq IS NULL) AND mail_id IS NOT NULL").withColumn("bypassed", F.lit(False)))


def plan_manual_actions(findings: DataFrame, requests: DataFrame) -> DataFrame:
    """finding_id, step, action, ok, message, needs_confirm for requests (finding_id, action, force).

    Findings need id, source, message_id, uidvalidity and block (see check_blocks). Force counts only where the
    refusal may be overridden. An unknown finding and an older row fail with a message and no step is taken.
    """
    f = findings.select(F.col("id").alias("finding_id"), "source", "message_id", "uidvalidity", "block")
    rows = requests.join(f, "finding_id", "left")
    able = policy.is_actionable(F.col("source"), F.col("message_id"), F.col("uidvalidity"))
    steps = F.when(F.col("action") == "block_and_trash", F.array(F.lit("trash"), F.lit("block"))).otherwise(F.array("action"))
    out = rows.withColumn("_ok", F.col("source").isNotNull() & able).select("*", F.posexplode(F.when(F.col("_ok"), steps).otherwise(F.array("action"))).alias("step", "_step"))
    may = F.col("block.allowed") | (F.col("block.overridable") & F.coalesce("force", F.lit(False)))
    message = F.when(F.col("source").isNull(), "finding not found").when(~F.col("_ok"), "older mail, act on it in the mailbox").when((F.col("_step") == "block") & ~may, F.concat(F.lit("not blocked: "), F.col("block.reason"))).otherwise(F.concat(F.lit("planned "), F.col("_step")))
    ok = F.col("_ok") & ((F.col("_step") != "block") | may)
    return out.select("finding_id", "step", F.col("_step").alias("action"), ok.alias("ok"), message.alias("message"), (F.col("_ok") & (F.col("_step") == "block") & ~may & F.col("block.overridable")).alias("needs_confirm"))


def mail_state(actions: DataFrame) -> DataFrame:
    """finding_id, mail_state, was_spam: where a finding's mail is after all its successful moves.

    A closed form instead of a fold: a trash after the last restore wins over any spam after it. was_spam says
    that the mail had been in the spam folder when it went to the trash.
    """
    last = lambda kind: F.max(F.when(F.col("action") == kind, F.col("id")))
    moves = actions.filter((F.col("success") == 1) & F.col("action").isin("spam", "trash", "restore"))
    back = moves.filter("action = 'restore'").groupBy("finding_id").agg(F.max("id").alias("back"))
    since = moves.join(back, "finding_id", "left").filter("id > coalesce(back, -1) AND action <> 'restore'")
    first_trash = F.min(F.when(F.col("action") == "trash", F.col("id")))
    first_spam = F.min(F.when(F.col("action") == "spam", F.col("id")))
    state = since.groupBy("finding_id").agg(last("trash").alias("trash"), last("spam").alias("spam"), first_trash.alias("t0"), first_spam.alias("s0"))
    state = state.select("finding_id", F.when(F.col("trash").isNotNull(), "trash").when(F.col("spam").isNotNull(), "spam").alias("mail_state"), F.coalesce(F.col("s0") < F.col("t0"), F.lit(False)).alias("was_spam"))
    every = moves.select("finding_id").distinct()
    return every.join(state, "finding_id", "left").select("finding_id", F.coalesce("mail_state", F.lit("none")).alias("mail_state"), F.coalesce("was_spam", F.lit(False)).alias("was_spam"))
