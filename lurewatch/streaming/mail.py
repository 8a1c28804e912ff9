"""Streams: mails read once, routed by the block list, findings written once, mail state, live counts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from lurewatch.operators import findings as FO
from lurewatch.streaming.commits import CommitLog


def stream_emails(spark: SparkSession, path: str, schema: str, watermark: str = "7 days") -> DataFrame:
    """Mails of a folder, each (source, mailbox, email_id) once within the watermark on received_at.

    A row that lacks its id is kept, with an error, so that it can be tried again.
    """
    rows = spark.readStream.schema(schema).parquet(path).withWatermark("received_at", watermark)
    once = rows.filter("email_id IS NOT NULL").dropDuplicatesWithinWatermark(["source", "mailbox", "email_id"])
    without = rows.filter("email_id IS NULL")  # nulls are no common id: each row stays
    return once.withColumn("error", F.lit(None).cast("string")).unionByName(without.withColumn("error", F.lit("no id")))


def to_batches(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Runs `each` on every micro-batch of what is there now, then ends."""
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()


def route_blocked(blocked_path: str, out: str) -> Callable[[DataFrame, int], None]:
    """Batch function: mails of blocked senders and the others, by the list as it is when the batch starts."""

    def each(batch: DataFrame, n: int) -> None:
        blocked, rest = FO.split_blocked(batch, batch.sparkSession.read.parquet(blocked_path))
        blocked.write.mode("overwrite").parquet(f"{out}/blocked/batch={n}")
        rest.write.mode("overwrite").parquet(f"{out}/analyse/batch={n}")

    return each


_CHANGES = "address string, seq bigint, blocks boolean, unblocks boolean"
_ROUTED = "mail_id string, address string, seq bigint, bypassed boolean, version int"


def route_in_order(out: str) -> Callable[[DataFrame, int], None]:
    """Batch function: mails routed by the blocks that come before them, in any order of arrival, committed as one (see CommitLog).

    Rows are those of stream_route_in_order(), and last_routed() gives what it gives. There a sender's rows meet in one
    task; here one sender may send any share of them. The table `changes` holds the rows that change the block list,
    `routed` new mails and those of which a late change says something else, under a higher version. A batch works on all
    mails and changes of the senders in it (and on few others, which the filter of senders lets through).
    """
    from lurewatch.operators import policy, skew

    def each(batch: DataFrame, n: int) -> None:
        log = CommitLog(batch.sparkSession, out)
        rows = batch.select("address", "seq", "mail_id", "blocks", "unblocks")

        def routed(written: Callable[[str], DataFrame]) -> DataFrame:
            about = rows.agg(F.approx_count_distinct("address")).first()[0]
            earlier = lambda name, schema: skew.prefilter(log.read(name, schema).drop("batch"), rows.select("address").distinct(), ["address"], about)
            new = rows.filter("mail_id IS NOT NULL").select("mail_id", "address", "seq", F.lit(None).cast("boolean").alias("bypassed"), F.lit(0).alias("version"))
            mails = earlier("routed", _ROUTED).unionByName(new).groupBy("mail_id", "address", "seq").agg(F.max("version").alias("version"), F.max_by("bypassed", "version").alias("before"))
            changes = earlier("changes", _CHANGES).unionByName(written("changes"))
            judged = policy.route_in_order(mails.unionByName(changes, allowMissingColumns=True))
            return judged.filter(~F.col("bypassed").eqNullSafe(F.col("before"))).select("mail_id", "address", "seq", "bypassed", (F.col("version") + 1).alias("version"))

        log.write(f"batch-{n}", {"changes": rows.filter("blocks OR unblocks").select("address", "seq", "blocks", "unblocks"), "routed": routed})

    return each


def last_routed(spark: SparkSession, out: str) -> DataFrame:
    """mail_id, address, seq, bypassed: the last word on each mail of route_in_order()."""
    return CommitLog(spark, out).read("routed", _ROUTED).groupBy("mail_id", "address", "seq").agg(F.max_by("bypassed", "version").alias("bypassed"))


def write_findings(out: str, never_block: DataFrame | None = None) -> Callable[[DataFrame, int], None]:
    """Batch function: findings, actions taken on them and new block-list rows, committed as one (see CommitLog).

    Findings need what plan_auto_actions() and check_blocks() need. Senders that must not be blocked (own, protected,
    forged, without an address) get a failed action and no block row. Block-list rows (address, source, mailbox,
    finding_id, created_at, reason) are merged by findings.blocked_upsert(). A batch that runs again changes nothing.
    """
    from lurewatch.operators.policy import auto_outcomes

    def each(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        never = spark.createDataFrame([], "entry string") if never_block is None else never_block

        def actions(written: Callable[[str], DataFrame]) -> DataFrame:
            return auto_outcomes(written("findings"), never)

        def blocks(written: Callable[[str], DataFrame]) -> DataFrame:
            done = written("actions").filter("action = 'block' AND success = 1").select(F.col("finding_id").alias("id"))
            rows = written("findings").join(done, "id", "left_semi")
            return rows.select(F.col("sender_address").alias("address"), "source", "mailbox", F.col("id").alias("finding_id"), F.col("processed_at").alias("created_at"), F.lit("auto").alias("reason"))

        CommitLog(spark, out).write(f"batch-{n}", {"findings": batch, "actions": actions, "blocked": blocks})

    return each


# --- rows that are tried again ---

#: Attempts at a row, and seconds until the second one; each later one waits twice as long.
ATTEMPTS, WAIT = 5, 60


def _tried(log: CommitLog, key: str, fresh: DataFrame, step: Callable[[DataFrame], DataFrame], attempts: int, clock: Callable[[], Column]) -> bool:
    """One batch of with_retries(): new rows and those that wait and are due go through `step`. The clock is read once."""
    now = F.timestamp_micros(F.lit(log.spark.range(1).select(F.unix_micros(clock())).first()[0]))
    rows = fresh.withColumns({"attempts": F.lit(0), "due": now})
    waiting = log.read("waiting", rows.schema, last=True).drop("batch")
    is_due = F.col("due") <= now
    tried = step(rows.unionByName(waiting.filter(is_due))).withColumn("attempts", F.col("attempts") + 1)
    names = [*rows.columns, "error"]

    def part(of: Column) -> Callable:
        return lambda written: written("tried").filter(of)

    failed, left = F.col("error").isNotNull(), F.col("attempts") < attempts
    wait = F.make_dt_interval(secs=(F.lit(WAIT) * F.pow(F.lit(2), F.col("attempts") - 1)).cast("decimal(18,6)"))
    later = lambda written: written("tried").filter(failed & left).withColumn("due", now + wait).drop("error").unionByName(waiting.filter(~is_due))
    return log.write(key, {"tried": tried.select(*names), "done": part(~failed), "given_up": part(failed & ~left), "waiting": later})


def with_retries(step: Callable[[DataFrame], DataFrame], out: str, attempts: int = ATTEMPTS, now: Callable[[], Column] = F.current_timestamp) -> Callable[[DataFrame, int], None]:
    """Batch function: `step` over new rows and over those that failed before and are due again.

    step adds `error`, null where a row went through; it finds the number of earlier tries in `attempts`. Rows that went
    through go to the table `done`, those that failed `attempts` times to `given_up`; the others wait in `waiting`, of
    which the last batch's counts. All of them are committed as one with the batch.
    """

    def each(batch: DataFrame, n: int) -> None:
        _tried(CommitLog(batch.sparkSession, out), f"batch-{n}", batch, step, attempts, now)

    return each


def retry_waiting(spark: SparkSession, step: Callable[[DataFrame], DataFrame], out: str, attempts: int = ATTEMPTS, now: Callable[[], Column] = F.current_timestamp) -> bool:
    """Tries the waiting rows that are due without any new mail, as a run does at its start. False if none waits."""
    log = CommitLog(spark, out)
    if not log.commits():
        return False
    waiting = log.read("waiting", last=True).drop("batch")
    if waiting.filter(F.col("due") <= now()).isEmpty():
        return False
    return _tried(log, f"retry-{len(log.commits())}", waiting.drop("attempts", "due").limit(0), step, attempts, now)


# --- state by key, whatever the order of arrival ---


class _Route(StatefulProcessor):
    """Of one address: its blocks and unblocks by place, and its mails with what was said of them."""

    def __init__(self, keep_ms: int | None) -> None:
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.events = handle.getMapState("events", "seq bigint", "blocks boolean")
        self.mails = handle.getMapState("mails", "seq bigint", "mail_id string, bypassed boolean, version int", self.keep_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        said = {k[0]: v for k, v in self.mails.iterator()} if self.mails.exists() else {}
        events = {k[0]: v[0] for k, v in self.events.iterator()} if self.events.exists() else {}
        new = set()
        for part in rows:
            for seq, mail_id, blocks, unblocks in zip(part["seq"], part["mail_id"], part["blocks"], part["unblocks"], strict=True):
                seq = int(seq)
                if blocks or unblocks:
                    events[seq] = bool(blocks) and not unblocks
                    self.events.updateValue((seq,), (events[seq],))
                if mail_id is not None and seq not in said:
                    said[seq] = (mail_id, False, 0)
                    new.add(seq)
        out, places, at, blocked = [], sorted(events), 0, False
        for seq in sorted(said):
            while at < len(places) and places[at] < seq:
                blocked = events[places[at]]
                at += 1
            mail_id, before, version = said[seq]
            if seq in new or before != blocked:
                self.mails.updateValue((seq,), (mail_id, blocked, version + 1))
                out.append((mail_id, key[0], seq, blocked, version + 1))
        yield pd.DataFrame(out, columns=["mail_id", "address", "seq", "bypassed", "version"])

    def close(self) -> None:
        pass


def stream_route_in_order(rows: DataFrame, keep_ms: int | None = None) -> DataFrame:
    """mail_id, address, seq, bypassed, version: mails routed by the blocks that come before them (needs the RocksDB state store).

    rows: address, seq (place in one order of mails and changes of the block list), mail_id (null: no mail), blocks and
    unblocks (whether the row changes the list; a mail that gets its sender blocked is both). Arrival may be in any
    order: a block that arrives late gives the mails behind it a new row of a higher version; the highest one counts
    and equals operators.policy.route_in_order(). With keep_ms a mail is forgotten that long after it was last decided,
    which bounds the state; a block that arrives later than that no longer changes what was said of it. All rows of a
    sender meet in one task, one by one: where some send a large share, route_in_order() gives the same.
    """
    return rows.select("address", "seq", "mail_id", "blocks", "unblocks").groupBy("address").transformWithStateInPandas(_Route(keep_ms), "mail_id string, address string, seq bigint, bypassed boolean, version int", "Update", "ProcessingTime" if keep_ms else "None")


class _State(StatefulProcessor):
    """Where a finding's mail is: none, spam or trash, and whether it had been spam when it was trashed.

    Held are the moves after the last restore, so the order in which they arrive does not matter.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.moves = handle.getMapState("moves", "id bigint", "action string")
        self.back = handle.getValueState("back", "id bigint, version int")

    def _take(self, rows: Iterator[pd.DataFrame]) -> tuple[str, bool, int]:
        back, version = self.back.get() if self.back.exists() else (-1, 0)
        moves = {k[0]: v[0] for k, v in self.moves.iterator()} if self.moves.exists() else {}
        for part in rows:
            for i, action in zip(part["id"], part["action"], strict=True):
                i = int(i)
                if action == "restore":
                    back = max(back, i)
                elif i not in moves:
                    moves[i] = action
                    if i > back:
                        self.moves.updateValue((i,), (action,))
        for i in [i for i in moves if i <= back]:
            if self.moves.containsKey((i,)):
                self.moves.removeKey((i,))
            del moves[i]
        self.back.update((back, version + 1))
        first = {kind: min((i for i, a in moves.items() if a == kind), default=None) for kind in ("spam", "trash")}
        state = "trash" if first["trash"] is not None else "spam" if first["spam"] is not None else "none"
        return state, state == "trash" and first["spam"] is not None and first["spam"] < first["trash"], version + 1

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        state, was, version = self._take(rows)
        yield pd.DataFrame({"finding_id": [key[0]], "mail_state": [state], "was_spam": [was], "version": [version]})

    def handleInitialState(self, key: tuple, initial: pd.DataFrame, timer_values) -> None:
        self._take(iter([initial]))

    def close(self) -> None:
        pass


def stream_mail_state(actions: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """finding_id, mail_state, was_spam, version after each batch of actions (needs the RocksDB state store).

    The row of the highest version counts; it equals operators.policy.mail_state() over all actions so far, in whatever
    order they arrived. before: actions of an earlier time, from which the state starts; a finding gives no row until
    an action of it arrives.
    """
    of = lambda a: a.filter((F.col("success") == 1) & F.col("action").isin("spam", "trash", "restore")).select("finding_id", "id", "action")
    initial = None if before is None else of(before).groupBy("finding_id")
    return of(actions).groupBy("finding_id").transformWithStateInPandas(_State(), "finding_id bigint, mail_state string, was_spam boolean, version int", "Update", "None", initial)


def stream_verdict_stats(findings: DataFrame) -> DataFrame:
    """Live counts per verdict and in all, as FO.verdict_stats() has them: deleted rows do not count."""
    return FO.verdict_stats(findings)
