import json
import random
import threading
from contextlib import contextmanager

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from lurewatch import registry
from lurewatch.jobs import views as V
from lurewatch.operators import findings, policy
from lurewatch.sources import messages
from lurewatch.streaming import mail
from lurewatch.streaming.commits import CommitLog


def run(frame, path, name="q", mode="update"):
    """One run of a stream over what is there: all its batches, with a checkpoint that the next run goes on from."""

    def each(batch, n):
        batch.write.mode("overwrite").parquet(f"{path}/{name}/batch={n}")

    frame.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/{name}-cp").trigger(availableNow=True).foreachBatch(each).start().awaitTermination(300)


def last(spark, path, key, name="q"):
    rows = spark.read.parquet(f"{path}/{name}")
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), "version").alias("r")).select("r.*").drop("batch", "version")


def test_mail_state_equals_batch_over_random_batches_and_a_restart(spark, sf_dir, tmp_path):
    actions = V.mail_actions(spark, sf_dir)
    dealt = actions.withColumn("part", F.abs(F.hash("id")) % 4)
    stream = lambda: mail.stream_mail_state(spark.readStream.schema(actions.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"))
    for parts in ((2, 0), (3, 1)):
        for part in parts:
            dealt.filter(F.col("part") == part).drop("part").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        run(stream(), tmp_path)
    assert spark.read.parquet(f"{tmp_path}/q").select("batch").distinct().count() >= 4
    want = policy.mail_state(actions)
    got = last(spark, tmp_path, "finding_id").select(*want.columns)
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()


def test_mail_state_starts_from_earlier_actions(spark, sf_dir, tmp_path):
    actions = V.mail_actions(spark, sf_dir)
    old, new = actions.filter("id % 2 = 0"), actions.filter("id % 2 = 1")
    new.coalesce(1).write.parquet(f"{tmp_path}/in")
    run(mail.stream_mail_state(spark.readStream.schema(actions.schema).parquet(f"{tmp_path}/in"), old), tmp_path)
    want = policy.mail_state(actions).join(new.filter("success = 1 AND action IN ('spam', 'trash', 'restore')").select("finding_id").distinct(), "finding_id")
    got = last(spark, tmp_path, "finding_id").select(*want.columns)
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()


ROUTE = "address string, seq long, mail_id string, blocks boolean, unblocks boolean"


def by_hand(rows):
    blocked, out = set(), {}
    for address, seq, mail_id, blocks, unblocks in sorted(rows, key=lambda r: r[1]):
        if mail_id is not None:
            out[mail_id] = address in blocked
        if unblocks:
            blocked.discard(address)
        elif blocks:
            blocked.add(address)
    return out


def routed(seed, n=600):
    rng = random.Random(seed)
    rows = []
    for seq in range(n):
        address = "hot@x.y" if rng.random() < 0.4 else f"s{rng.randrange(25)}@x.y"
        kind = rng.random()
        rows.append((address, seq, f"m{seq}" if kind < 0.9 else None, kind < 0.2, kind >= 0.94))
    return rows


def test_a_block_acts_on_the_next_mail(spark):
    rows = routed(3)
    df = spark.createDataFrame(rows + [(None, 9999, "m9999", True, False)], ROUTE).repartition(4)
    got = {r["mail_id"]: r["bypassed"] for r in policy.route_in_order(df).collect()}
    assert got == by_hand(rows) | {"m9999": False} and 0 < sum(got.values()) < len(got)
    two = spark.createDataFrame([("a@b", 1, "x", True, False), ("a@b", 2, "y", False, False), ("c@d", 3, "z", False, False)], ROUTE)
    listed = spark.createDataFrame([("c@d",)], "address string")
    assert {r["mail_id"]: r["bypassed"] for r in policy.route_in_order(two, listed).collect()} == {"x": False, "y": True, "z": True}
    assert policy.route_in_order(two.limit(0)).count() == 0


@contextmanager
def in_time(spark, seconds):
    """Ends the session's jobs after that time, so that work which grows with the square fails instead of lasting."""
    timer = threading.Timer(seconds, spark.sparkContext.cancelAllJobs)
    timer.start()
    try:
        yield
    finally:
        timer.cancel()


def one_sender(spark, n=400_000):
    """Of each five rows of one sender the first unblocks and the third, a mail, blocks: the last two are bypassed."""
    k = F.col("id") % 5
    return spark.range(n).select(F.lit("a@b").alias("address"), F.col("id").alias("seq"), F.when(k != 0, F.concat(F.lit("m"), "id")).alias("mail_id"), (k == 2).alias("blocks"), (k == 0).alias("unblocks"))


def test_many_changes_of_one_sender_take_time_in_proportion(spark):
    with in_time(spark, 90):
        out = policy.route_in_order(one_sender(spark)).select("seq", "bypassed", (F.col("seq") % 5 > 2).alias("want"))
        assert [tuple(r) for r in out.agg(F.count("*"), F.count_if("bypassed"), F.count_if(F.col("bypassed") != F.col("want"))).collect()] == [(320_000, 160_000, 0)]


def test_few_changes_reach_over_many_pieces(spark):
    rng = random.Random(7)
    rows = [(rng.choice(["a@b", "a@b", "c@d"]), seq, f"m{seq}", rng.random() < 0.01, rng.random() < 0.01) for seq in range(-1000, 1000)]
    rows += [("e@f", -(1 << 63), "low", True, False), ("e@f", (1 << 63) - 1, "high", False, True), ("e@f", 0, "mid", None, None)]
    got = {r["mail_id"]: r["bypassed"] for r in policy.route_in_order(spark.createDataFrame(rows, ROUTE)).collect()}
    assert got == by_hand(rows) and got["mid"] and 0 < sum(got.values()) < len(got)


def test_changes_at_one_place_and_rows_without_a_place(spark):
    rows = [("a@b", 1, "x", True, False), ("a@b", 1, "y", False, True), ("a@b", 1, "z", False, False), ("a@b", 2, "u", True, False), ("a@b", 3, "v", False, False), ("a@b", None, "w", True, False), ("a@b", None, None, False, True)]
    got = {r["mail_id"]: r["bypassed"] for r in policy.route_in_order(spark.createDataFrame(rows, ROUTE)).collect()}
    assert got == {"x": False, "y": False, "z": False, "u": False, "v": True, "w": False}
    listed = spark.createDataFrame([("a@b",), (None,), ("a@b",)], "address string")
    got = {r["mail_id"]: r["bypassed"] for r in policy.route_in_order(spark.createDataFrame(rows, ROUTE), listed).collect()}
    assert got == {"x": True, "y": True, "z": True, "u": False, "v": True, "w": False}


def test_route_stream_equals_batch_over_shuffled_arrival_and_a_restart(spark, tmp_path):
    rows = routed(4)
    random.Random(1).shuffle(rows)
    stream = lambda: mail.stream_route_in_order(spark.readStream.schema(ROUTE).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"))
    for k in range(0, 600, 300):
        for j in (k, k + 150):
            spark.createDataFrame(rows[j : j + 150], ROUTE).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        run(stream(), tmp_path)
    got = {r["mail_id"]: r["bypassed"] for r in last(spark, tmp_path, "mail_id").collect()}
    assert got == by_hand(rows) and spark.read.parquet(f"{tmp_path}/q").agg(F.max("version")).first()[0] > 1


def test_route_batches_equal_batch_over_shuffled_arrival_repeats_and_restarts(spark, tmp_path):
    rows = routed(5)
    random.Random(2).shuffle(rows)
    each = mail.route_in_order(f"{tmp_path}/out")
    for k in range(0, 600, 200):
        part = rows[k : k + 200] + rows[max(0, k - 50) : k] + [(None, 9000 + k, f"m{9000 + k}", True, False)]
        spark.createDataFrame(part, ROUTE).write.mode("append").parquet(f"{tmp_path}/in")
        mail.to_batches(spark.readStream.schema(ROUTE).parquet(f"{tmp_path}/in"), f"{tmp_path}/cp", each).awaitTermination(300)
    got = mail.last_routed(spark, f"{tmp_path}/out").collect()
    assert {r["mail_id"]: r["bypassed"] for r in got} == by_hand(rows) | {f"m{9000 + k}": False for k in (0, 200, 400)} and len(got) == len({r["mail_id"] for r in got})
    log = CommitLog(spark, f"{tmp_path}/out")
    said = log.read("routed").groupBy("mail_id").agg(F.max("version").alias("v"), F.count("*").alias("n"), F.count_distinct("bypassed").alias("kinds")).collect()
    assert len(log.commits()) == 3 and max(r["v"] for r in said) > 1 and all(r["v"] == r["n"] and r["kinds"] == min(r["n"], 2) for r in said if r["mail_id"] < "m9000")
    each(spark.createDataFrame([("hot@x.y", 9999, "again", False, False)], ROUTE), 2)  # a batch that counts already
    assert len(log.commits()) == 3 and log.read("routed").filter("mail_id = 'again'").isEmpty()


def test_route_batches_look_at_the_senders_of_the_batch(spark, tmp_path):
    each, log = mail.route_in_order(f"{tmp_path}/out"), CommitLog(spark, f"{tmp_path}/out")
    said = lambda n: sorted((r["mail_id"], r["bypassed"], r["version"]) for r in log.read("routed").filter(F.col("batch") == n).collect())
    for n, rows in enumerate(([("a@b", 5, "x", False, False), ("c@d", 5, "y", True, False)], [("a@b", 1, None, True, False)], [("a@b", 3, None, False, True), ("c@d", 7, "z", False, False)])):
        each(spark.createDataFrame(rows, ROUTE), n)
    assert [said(n) for n in range(3)] == [[("x", False, 1), ("y", False, 1)], [("x", True, 2)], [("x", False, 3), ("z", True, 1)]]


def test_a_stream_of_one_sender_takes_time_in_proportion(spark, tmp_path):
    kinds = F.array(*map(F.lit, ("purchase", "view", "error", "click", "view")))
    spark.range(400_000).select((F.col("id") * 3).alias("event_id"), F.lit(1).cast("long").alias("user_id"), F.get(kinds, (F.col("id") % 5).cast("int")).alias("event_type")).write.parquet(f"{tmp_path}/events.parquet")
    with in_time(spark, 150):
        out = registry.queries()["stream_route_in_order"](spark, str(tmp_path)).select("bypassed", (F.substring("mail_id", 2, 20).cast("long") / 3 % 5 > 2).alias("want"))
        assert [tuple(r) for r in out.agg(F.count("*"), F.count_if("bypassed"), F.count_if(F.col("bypassed") != F.col("want"))).collect()] == [(320_000, 160_000, 0)]


def test_a_row_that_fails_twice_appears_once(spark, tmp_path):
    schema = "email_id string, fails int"
    asked = []

    def step(rows):
        asked.append(1)
        return rows.withColumn("error", F.when(F.col("attempts") < F.col("fails"), "service away"))

    clock = iter(range(0, 10**9, 10_000_000))
    now = lambda: F.timestamp_seconds(F.lit(next(clock)))
    each = mail.with_retries(step, f"{tmp_path}/out", 3, now)
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    for rows in ([("a", 2), ("b", 0)], [("c", 0), ("d", 9)], [("e", 1)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        if rows[0][0] != "a":  # the first run has two batches, the second goes on from its checkpoint
            mail.to_batches(stream(), f"{tmp_path}/cp", each).awaitTermination(120)
    while mail.retry_waiting(spark, step, f"{tmp_path}/out", 3, now):
        pass
    log = CommitLog(spark, f"{tmp_path}/out")
    done = {r["email_id"]: r["attempts"] for r in log.read("done").collect()}
    assert log.read("done").count() == 4 and done == {"a": 3, "b": 1, "c": 1, "e": 2}
    assert [(r["email_id"], r["attempts"], r["error"]) for r in log.read("given_up").collect()] == [("d", 3, "service away")]
    assert log.read("waiting", last=True).count() == 0 and not mail.retry_waiting(spark, step, f"{tmp_path}/out", 3, now)


def test_waiting_rows_are_not_tried_early(spark, tmp_path):
    log = CommitLog(spark, f"{tmp_path}/out")
    step = lambda rows: rows.withColumn("error", F.lit("no"))
    at = lambda s: lambda: F.timestamp_seconds(F.lit(s))
    mail.with_retries(step, f"{tmp_path}/out", 3, at(0))(spark.createDataFrame([("a",)], "email_id string"), 0)
    mail.with_retries(step, f"{tmp_path}/out", 3, at(mail.WAIT - 1))(spark.createDataFrame([("b",)], "email_id string"), 1)
    assert sorted((r["email_id"], r["attempts"]) for r in log.read("waiting", last=True).collect()) == [("a", 1), ("b", 1)]
    mail.with_retries(step, f"{tmp_path}/out", 3, at(mail.WAIT))(spark.createDataFrame([("b",)], "email_id string"), 1)  # a batch that counts already
    assert log.read("tried").count() == 2
    assert mail.retry_waiting(spark, step, f"{tmp_path}/out", 3, at(mail.WAIT)) and sorted((r["email_id"], r["attempts"]) for r in log.read("waiting", last=True).collect()) == [("a", 2), ("b", 1)]


def test_readers_see_a_batch_whole_or_not_at_all(spark, sf_dir, tmp_path, monkeypatch):
    f = V.findings(spark, sf_dir)
    planned = policy.plan_auto_actions(f).filter("action = 'block'").join(f, "id").orderBy("id").first()
    never = spark.createDataFrame([("@d3.example",), (planned["sender_address"].upper(),)], "entry string")
    each, log = mail.write_findings(f"{tmp_path}/out", never), CommitLog(spark, f"{tmp_path}/out")
    halves = [f.filter(F.col("id") % 2 == k) for k in (0, 1)]
    each(halves[0], 0)
    for table in ("actions", "blocked"):  # ends between two writes
        whole = DataFrameWriter.parquet

        def broken(self, path, *a, table=table, whole=whole, **k):
            if f"/{table}/" in path:
                raise OSError("lost")
            return whole(self, path, *a, **k)

        with monkeypatch.context() as m:
            m.setattr(DataFrameWriter, "parquet", broken)
            with pytest.raises(OSError, match="lost"):
                each(halves[1], 1)
        assert {t: log.read(t).select("batch").distinct().count() for t in ("findings", "actions", "blocked")} == {"findings": 1, "actions": 1, "blocked": 1}
    each(halves[1], 1)
    each(halves[1], 1)
    assert log.read("findings").count() == f.count() and len(log.commits()) == 2
    acts, blocked = log.read("actions").drop("batch"), log.read("blocked").drop("batch")
    assert acts.exceptAll(policy.auto_outcomes(f, never)).isEmpty() and acts.count() == policy.auto_outcomes(f, never).count()
    judged = policy.check_blocks(f, never)
    assert blocked.join(judged.filter("NOT block.allowed").select(F.col("id").alias("finding_id")), "finding_id").isEmpty()
    assert blocked.count() == acts.filter("action = 'block' AND success = 1").count() > 0 and acts.filter("success = 0").count() > 0
    assert log.vacuum("findings") == 2 and log.vacuum("findings") == 0 and log.read("findings").count() == f.count()


def test_once_and_routing(spark, tmp_path):
    schema = "source string, mailbox string, email_id string, sender_address string, received_at timestamp"
    rows = [("a", "m", "1", "x@y.z"), ("a", "m", "1", "x@y.z"), ("a", "m", "2", "ok@y.z"), ("a", "m", None, "ok@y.z"), ("a", "m", None, "ok@y.z")]
    df = spark.createDataFrame(rows, "source string, mailbox string, email_id string, sender_address string").withColumn("received_at", F.lit("2024-01-01").cast("timestamp"))
    df.write.parquet(f"{tmp_path}/in")
    spark.createDataFrame([("X@y.z",)], "address string").write.parquet(f"{tmp_path}/blocked")
    stream = mail.stream_emails(spark, f"{tmp_path}/in", schema)
    mail.to_batches(stream, f"{tmp_path}/cp", mail.route_blocked(f"{tmp_path}/blocked", f"{tmp_path}/out")).awaitTermination(120)
    assert [r["email_id"] for r in spark.read.parquet(f"{tmp_path}/out/blocked").collect()] == ["1"]
    assert sorted((r["email_id"] or "", r["error"] or "") for r in spark.read.parquet(f"{tmp_path}/out/analyse").collect()) == [("", "no id"), ("", "no id"), ("2", "")]


def test_findings_and_counts(spark, sf_dir, tmp_path):
    f = V.findings(spark, sf_dir)
    f.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(f.schema).parquet(f"{tmp_path}/in")
    mail.to_batches(stream, f"{tmp_path}/cp", mail.write_findings(f"{tmp_path}/out")).awaitTermination(120)
    log = CommitLog(spark, f"{tmp_path}/out")
    assert log.read("findings").count() == f.count() and log.read("actions").count() == policy.plan_auto_actions(f).count()
    q = mail.stream_verdict_stats(stream).writeStream.outputMode("complete").format("memory").queryName("stats").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp2").start()
    q.awaitTermination(120)
    assert [r.asDict() for r in spark.table("stats").collect()] == [r.asDict() for r in findings.verdict_stats(f).collect()]


def test_damaged_mails_never_end_a_read(spark, tmp_path):
    whole = b"From: a@b.c\nSubject: =?utf-8?q?S=C3=A9?=\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary=B\n\n--B\nContent-Type: text/plain\n\nbody\n--B\nContent-Type: message/rfc822\n\nSubject: in\n\n\xc3\xa9\xff inner\n--B\nContent-Type: application/octet-stream; name=x\nContent-Transfer-Encoding: base64\nContent-Disposition: attachment\n\neHg=\n--B--\n"
    rng = random.Random(7)
    (tmp_path / "e").mkdir()
    for i in range(300):
        raw = bytearray(whole)
        for _ in range(rng.randrange(0, 9)):
            raw[rng.randrange(len(raw))] = rng.randrange(256)
        (tmp_path / "e" / f"{i}.eml").write_bytes(bytes(raw))
    rows = messages.read_eml(spark, f"{tmp_path}/e").collect()
    assert len(rows) == 300 and sum(len(r["attachments"]) for r in rows) > 300


def test_parts_at_any_depth(spark, tmp_path):
    part = {"mimeType": "text/plain", "body": {"data": "aGVsbG8"}}
    for _ in range(40):
        part = {"mimeType": "multipart/mixed", "parts": [part, {"filename": "deep.pdf"}]}
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.json").write_text(json.dumps({"id": "1", "payload": part}) + "\nno message\n" + json.dumps({"id": "2", "payload": {"parts": 7}}))
    got = messages.read_messages_json(spark, f"{tmp_path}/m").collect()
    good = [r for r in got if r["error"] is None]
    assert [(r["body_text"], len(r["attachment_names"])) for r in good] == [("hello", 40)] and len(got) == 3


def test_readers(spark, tmp_path):
    (tmp_path / "m").mkdir()
    message = {"id": "1", "threadId": "t", "payload": {"mimeType": "multipart/mixed", "headers": [{"name": "SUBJECT", "value": "Hi"}, {"name": "from", "value": "a@b.c"}], "parts": [{"mimeType": "multipart/alternative", "parts": [{"mimeType": "text/plain", "body": {"data": "aGVsbG8", "size": 5}}, {"mimeType": "text/html", "body": {"data": "PGI-"}}]}, {"mimeType": "application/pdf", "filename": "a.pdf", "body": {"attachmentId": "x", "size": 9}}]}}
    (tmp_path / "m" / "a.json").write_text(json.dumps(message))
    r = messages.read_messages_json(spark, f"{tmp_path}/m").first()
    assert (r["subject"], r["sender"], r["body_text"], r["attachment_names"]) == ("Hi", "a@b.c", "hello", ["a.pdf"])
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "x.eml").write_bytes(b"From: a@b.c\nSubject: S\nAuthentication-Results: mx; spf=fail\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary=B\n\n--B\nContent-Type: text/plain\n\nbody\n--B\nContent-Type: application/octet-stream\nContent-Disposition: attachment\n\nxx\n--B--\n")
    e = messages.read_eml(spark, f"{tmp_path}/e").first()
    assert (e["subject"], e["auth"], e["attachments"][0]["filename"]) == ("S", {"spf": "fail"}, "unnamed_attachment")
    results = spark.createDataFrame([("gmail", "m1", "malicious")], "source string, email_id string, verdict string")
    messages.write_result_logs(results, f"{tmp_path}/logs")
    assert messages.import_result_logs(spark, f"{tmp_path}/logs").first()["verdict"] == "malicious"
