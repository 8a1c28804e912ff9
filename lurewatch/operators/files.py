"""Attachment jobs: admission, unpacking, signals of containers, risk, and hash look-ups.

Files are rows keyed (email_id, file_path); file_path is the position of each step from the mail down, like `2/0`.
Bytes never take part in a shuffle of their own accord: signals are drawn first, then the bytes are dropped.
"""

from __future__ import annotations

import email
import email.policy
import io
import re
import zipfile
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from lurewatch.functions import attachments as A
from lurewatch.sources.scratch import written

MAX_FILES, MAX_TOTAL, MAX_MEMBER, MAX_UNPACKED = 10, 60 << 20, 10 << 20, 50 << 20
MAX_LISTED, MAX_DEPTH, MAX_RATIO, MAX_LOOKUPS = 50, 2, 1000, 5
SKIPPED_KINDS = ("png", "jpeg", "gif", "webp", "tiff", "text", "empty")


@F.pandas_udf(DoubleType())
def byte_entropy(data: pd.Series) -> pd.Series:
    """Bits per byte over the first 4 MiB, two decimals; 0 for nothing."""

    def one(d: bytes | None) -> float:
        n = np.bincount(np.frombuffer(d[: 4 << 20], np.uint8)) if d else np.zeros(0)
        p = n[n > 0] / max(1, n.sum())
        return round(abs(float(-(p * np.log2(p)).sum())), 2)

    return data.map(one, na_action=None).astype(float)


@F.pandas_udf(StringType())
def pdf_text(data: pd.Series) -> pd.Series:
    """Text of a PDF for pattern scans: its bytes and its inflated streams (bounded), with escaped names undone."""
    begin = re.compile(rb"(?<!end)stream\r?\n")
    name = re.compile(r"/[^\s/\[\]<>()%]*#[0-9A-Fa-f]{2}[^\s/\[\]<>()%]*")

    def one(d: bytes | None) -> str:
        d = d or b""
        parts, used = [d], 0
        for k, m in enumerate(begin.finditer(d)):
            end = d.find(b"endstream", m.end())
            if k >= 300 or used > 16 << 20 or end < 0:
                break
            try:
                got = zlib.decompressobj().decompress(d[m.end() : end], 2 << 20)
            except zlib.error:
                continue
            used += len(got)
            parts.append(got)
        text = b"\n".join(parts).decode("latin-1")
        return name.sub(lambda m: re.sub("#([0-9A-Fa-f]{2})", lambda x: chr(int(x[1], 16)), m[0]), text)

    return data.map(one, na_action=None)


def admit_downloads(atts: DataFrame, cap: int) -> DataFrame:
    """Adds skipped_reason as a mailbox reader would: position, size, then the total of what was admitted before.

    Only admitted files add to the total, so the decision is a fold over a mail's list (at most MAX_FILES long).
    """
    first = atts.filter(F.col("att_idx") < MAX_FILES)
    listed = first.groupBy("email_id").agg(F.array_sort(F.collect_list(F.struct("att_idx", "size"))).alias("l"))
    start = F.struct(F.lit(0).cast("long").alias("total"), F.array().cast("array<struct<att_idx:bigint,why:string>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        why = F.when(x["size"] > cap, "larger than the limit").when(a["total"] + x["size"] > MAX_TOTAL, "total size limit reached")
        return F.struct((a["total"] + F.when(why.isNull(), x["size"]).otherwise(0)).cast("long").alias("total"), F.concat(a["out"], F.array(F.struct(x["att_idx"].cast("long").alias("att_idx"), why.alias("why")))).alias("out"))

    judged = listed.select("email_id", F.explode(F.aggregate("l", start, step, lambda a: a["out"])).alias("j")).select("email_id", F.col("j.att_idx").alias("att_idx"), F.col("j.why").alias("_why"))
    out = atts.join(judged, ["email_id", "att_idx"], "left")
    return out.withColumn("skipped_reason", F.when(F.col("att_idx") >= MAX_FILES, "too many attachments").otherwise(F.coalesce("_why", F.lit("")))).drop("_why")


def running_bytes(atts: DataFrame) -> DataFrame:
    """Adds running_bytes: bytes of a mail up to and including a file, skipped ones aside."""
    w = Window.partitionBy("email_id").orderBy("att_idx").rowsBetween(Window.unboundedPreceding, 0)
    counted = F.when((F.col("att_idx") < MAX_FILES) & (F.coalesce("skipped_reason", F.lit("")) == ""), F.col("size")).otherwise(0)
    return atts.withColumn("running_bytes", F.sum(counted).over(w))


def admit_analysis(atts: DataFrame) -> DataFrame:
    """Adds reason: why a file is not analysed, null if it is. Files over the total still add to it."""
    reason = (
        F.when(F.col("att_idx") >= MAX_FILES, f"more than {MAX_FILES} attachments; not analysed")
        .when(F.coalesce("skipped_reason", F.lit("")) != "", F.col("skipped_reason")).when(F.coalesce("size", F.lit(0)) == 0, "empty or not downloaded")
        .when(F.col("running_bytes") > MAX_TOTAL, "total attachment size limit reached")
    )
    return running_bytes(atts).withColumn("reason", reason)


# --- unpacking ---

MEMBER = "email_id string, parent_path string, parent_kind string, idx int, name string, content_type string, size bigint, compressed bigint, encrypted boolean, bomb boolean, reason string, entries int, data binary"
#: Parts of a package that signals are read from, and bytes of members that a task holds before it hands them on.
SIGNAL_PARTS = re.compile(r"^\[Content_Types\]\.xml$|\.rels$|^word/[^/]*\.xml$|^xl/workbook\.xml$|^xl/worksheets/.*\.xml$")
HELD = 8 << 20


def _zip_members(data: bytes) -> Iterator[tuple[dict, Callable[[], bytes] | None]]:
    """What is said of each member, and how to read it; None where it is not read for the reason given."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        infos = z.infolist()
        for i, m in enumerate(infos):
            if m.is_dir():
                continue
            encrypted = bool(m.flag_bits & 1)
            bomb = m.file_size > 1 << 20 and m.file_size / max(m.compress_size, 1) > MAX_RATIO
            reason = "not listed" if i >= MAX_LISTED else "encrypted" if encrypted else "too large or suspicious ratio" if bomb or m.file_size > MAX_MEMBER else None
            row = {"idx": i, "name": m.filename, "content_type": "", "size": m.file_size, "compressed": m.compress_size, "encrypted": encrypted, "bomb": bomb, "reason": reason, "entries": len(infos), "data": None}

            def read(m: zipfile.ZipInfo = m) -> bytes:
                with z.open(m) as f:
                    return f.read(MAX_MEMBER + 1)

            yield row, None if reason else read


def _mail_members(data: bytes) -> Iterator[tuple[dict, Callable[[], bytes] | None]]:
    parts = list(email.message_from_bytes(data, policy=email.policy.default).iter_attachments())
    for i, p in enumerate(parts[:MAX_LISTED]):
        try:
            inner = p.get_content_type() == "message/rfc822"
            raw = p.get_payload()[0].as_bytes() if inner else p.get_payload(decode=True) or b""
            name = p.get_filename() or "unnamed"
        except Exception:  # noqa: BLE001 - damaged parts are common in hostile mail
            continue
        yield {"idx": i, "name": name, "content_type": p.get_content_type(), "size": len(raw), "compressed": len(raw), "encrypted": False, "bomb": False, "reason": None, "entries": len(parts), "data": None}, lambda raw=raw: raw


def _members(kind: str, data: bytes | None) -> Iterator[tuple[dict, Callable[[], bytes] | None]]:
    """Members of a container; those before the place where it turns out to be damaged."""
    try:
        yield from (_zip_members if kind == "zip" else _mail_members)(data or b"")
    except Exception:  # noqa: BLE001 - damaged containers are common in hostile mail
        return


def _fill(row: dict, read: Callable[[], bytes]) -> None:
    try:
        row["data"] = read()
        row["size"] = len(row["data"])
    except Exception:  # noqa: BLE001 - damaged members are common in hostile mail
        row["reason"] = "could not be read"


def _in_parts(rows: Iterator[dict], names: list[str]) -> Iterator[pd.DataFrame]:
    """Frames of rows, handed on before more than HELD bytes have gathered."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row["data"] or b"") + 200
        if size >= HELD:
            yield pd.DataFrame(held)[names]
            held, size = [], 0
    if held:
        yield pd.DataFrame(held)[names]


def expand(files: DataFrame) -> DataFrame:
    """Members of ZIP files and attachments of mails as rows (MEMBER) for the signals of containers. Needs email_id, file_path, kind, data.

    Bytes are given for those parts of packages alone that signals are read from, MAX_UNPACKED of them for a container at most.
    A container that cannot be read gives no rows. A member that is encrypted, too large or too well compressed
    is listed with a reason.
    """
    names = [c.split()[0] for c in MEMBER.split(", ")]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[dict]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                used = 0
                for row, read in _members(r.kind, r.data):
                    if read and r.kind == "zip" and SIGNAL_PARTS.search(row["name"]) and used + row["size"] <= MAX_UNPACKED:
                        _fill(row, read)
                        used += row["size"]
                    yield {"email_id": r.email_id, "parent_path": r.file_path, "parent_kind": r.kind, **row}

    chosen = files.filter(F.col("kind").isin("zip", "eml")).select("email_id", "file_path", "kind", "data")
    return chosen.mapInPandas(lambda batches: _in_parts(rows(batches), names), MEMBER)


def inner_mail(files: DataFrame) -> DataFrame:
    """email_id, file_path, subject, sender, date, excerpt, body of attached mails; a mail that cannot be read has empty fields."""
    schema = "email_id string, file_path string, subject string, sender string, date string, excerpt string, body string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                m, body = email.message_from_bytes(r.data or b"", policy=email.policy.default), ""
                try:
                    part = m.get_body(preferencelist=("html", "plain"))
                    body = part.get_content() if part is not None else ""
                except Exception:  # noqa: BLE001 - damaged mails are common among reports
                    pass
                flat = " ".join(re.sub(r"<[^<>]{0,500}>", " ", body[:20_000]).split())[:300]
                out.append((r.email_id, r.file_path, str(m.get("subject", ""))[:200], str(m.get("from", ""))[:200], str(m.get("date", ""))[:80], flat, body))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    return files.filter("kind = 'eml'").select("email_id", "file_path", "data").mapInPandas(run, schema)


UNPACKED = "email_id string, file_path string, depth int, name string, content_type string, size bigint, data binary, reason string"


def unpack(containers: DataFrame, depth: int = MAX_DEPTH) -> DataFrame:
    """Members of a mail's containers and of theirs, down to `depth`, as rows (UNPACKED). Needs email_id, file_path, kind, data.

    The containers of a mail go to one task (no other bytes are shuffled) and are walked in order, each member before
    the next and with all below it, under one budget of MAX_UNPACKED: a member beyond it is not unpacked, and at no time
    more than one member of each level is held. A member beyond the budget stays as a row with a reason and takes none of it.
    """
    names = [c.split()[0] for c in UNPACKED.split(", ")]

    def walk(mail: str, kind: str, data: bytes, path: str, level: int, used: list[int]) -> Iterator[dict]:
        for row, read in _members(kind, data):
            if read and used[0] + row["size"] > MAX_UNPACKED:
                row["reason"], read = "unpack limit reached", None
            if read:
                _fill(row, read)
            if row["data"] is not None and (row["size"] > MAX_MEMBER or used[0] + row["size"] > MAX_UNPACKED):
                row["data"], row["reason"] = None, "too large or suspicious ratio" if row["size"] > MAX_MEMBER else "unpack limit reached"
            used[0] += len(row["data"] or b"")
            at = f"{path}/{row['idx']:03d}"
            yield {"email_id": mail, "file_path": at, "depth": level, **row}
            inner = A.container_kind(row["data"], row["name"], row["content_type"]) if row["data"] and level < depth else None
            if inner:
                yield from walk(mail, inner, row["data"], at, level + 1, used)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[dict]:
        now, used = None, [0]
        for batch in batches:
            for r in batch.itertuples(index=False):
                if r.email_id != now:
                    now, used = r.email_id, [0]
                yield from walk(r.email_id, r.kind, r.data, r.file_path, 1, used)

    chosen = containers.filter(F.col("kind").isin("zip", "eml")).select("email_id", "file_path", "kind", "data")
    by_mail = chosen.repartition("email_id").sortWithinPartitions("email_id", "file_path")
    return by_mail.mapInPandas(lambda batches: _in_parts(rows(batches), names), UNPACKED)


def analyze_nested(files: DataFrame, depth: int = MAX_DEPTH) -> DataFrame:
    """All files down to `depth`: email_id, file_path, depth, name, kind, size, data, reason.

    What a mail's containers hold is unpacked once, in walk order and within its budget (see unpack()), and written to
    the shared folder. Needs email_id, file_path, name, content_type, data.
    """
    kind = A.detect_kind(F.col("data"), F.col("name"), F.col("content_type"))
    top = files.select("email_id", "file_path", F.lit(0).alias("depth"), "name", kind.alias("kind"), F.octet_length("data").cast("long").alias("size"), "data", F.lit(None).cast("string").alias("reason"))
    if depth < 1:
        return top
    members = written(unpack(top, depth), "members")
    below = members.select("email_id", "file_path", "depth", "name", F.when(F.col("data").isNotNull(), kind).otherwise("unknown").alias("kind"), "size", "data", "reason")
    return top.unionByName(below)


# --- signals of containers ---


def archive_signals(members: DataFrame) -> DataFrame:
    """email_id, parent_path, package, signals of plain archives and Java or Android packages. members: expand().

    What the name of a member of a plain archive gives is given as `member_...`, once, with the first such name.
    """
    ext = A.file_extension(F.col("name"))
    rows = members.filter("parent_kind = 'zip'").withColumns({"ext": ext, "runs": ext.isin(A.RUNNABLE_EXT + A.DISK_IMAGE_EXT), "nested": ext.isin("zip", "rar", "7z", "cab", "gz", "iso", "img")})
    named = lambda c: F.array_sort(F.collect_list(F.when(F.col(c), F.struct("idx", A.safe_filename(F.col("name")).alias("n")))))
    has = lambda cond: F.coalesce(F.bool_or(cond), F.lit(False))
    g = rows.groupBy("email_id", "parent_path").agg(
        F.count_if("encrypted").alias("enc"), F.first("entries").alias("entries"), has(F.col("bomb")).alias("bomb"), F.slice(F.transform(named("runs"), lambda x: x["n"]), 1, 5).alias("runs"), F.count_if("nested").alias("nested"),
        has((F.col("name") == "[Content_Types].xml")).alias("ct"), has(F.col("name").rlike("^(word|xl|ppt|visio)/")).alias("office"), has(F.col("name") == "META-INF/MANIFEST.MF").alias("jar"), has(F.col("name") == "AndroidManifest.xml").alias("apk"),
    )
    package = F.when(F.col("ct") & F.col("office"), "ooxml").when(F.col("jar"), "jar").when(F.col("apk"), "apk").otherwise("zip")
    named = rows.select("email_id", "parent_path", "idx", A.safe_filename(F.col("name")).alias("shown"), F.explode(A.filename_signals(F.col("name"))).alias("s"))
    tricks = named.groupBy("email_id", "parent_path", "s.signal").agg(F.max("s.severity").alias("severity"), F.min(F.struct("idx", F.concat_ws(": ", "shown", "s.detail").alias("detail"))).alias("first"))
    trick = F.struct("severity", F.concat(F.lit("member_"), F.col("signal")).alias("signal"), F.col("first.detail").alias("detail"))
    tricks = tricks.groupBy("email_id", "parent_path").agg(F.array_sort(F.collect_list(F.struct("first.idx", trick.alias("s")))).alias("tricks"))
    g = g.withColumn("package", package).join(tricks, ["email_id", "parent_path"], "left")
    plain = F.col("package") == "zip"
    of_members = F.when(plain, F.transform("tricks", lambda x: x["s"].cast(A.SIGNAL)))
    return g.select("email_id", "parent_path", "package", F.concat(F.coalesce(of_members, F.array().cast(f"array<{A.SIGNAL}>")), A._found(
        (F.col("package") == "jar", A.signal("high", "java_archive", "Runs code when opened.")), (F.col("package") == "apk", A.signal("medium", "android_package", "Android application.")),
        (plain & (F.col("enc") > 0), A.signal("medium", "encrypted_archive", F.concat(F.col("enc").cast("string"), F.lit(" of "), F.col("entries").cast("string"), F.lit(" encrypted")))),
        (plain & F.col("bomb"), A.signal("high", "compression_bomb", "Expands like a bomb; not unpacked.")), (plain & (F.size("runs") > 0), A.signal("high", "archive_contains_runnable", F.array_join("runs", ", "))),
        (plain & (F.col("nested") > 0), A.signal("low", "nested_archive", F.concat(F.col("nested").cast("string"), F.lit(" nested")))),
    )).alias("signals"))


_REL = r"(?i)<Relationship\b([^<>]{0,2000})>"


def _attr(x: Column, name: str) -> Column:
    return F.regexp_extract(x, rf'(?i)\b{name}\s*=\s*"([^"]*)"', 1)


def ooxml_signals(members: DataFrame, names: DataFrame) -> DataFrame:
    """email_id, parent_path, signals, link_urls (targets of outside links) of Office packages. names: email_id, parent_path, ext (of the package's own name)."""
    text = F.make_valid_utf8(F.col("data").cast("string"))
    rels = F.transform(F.when(F.col("name").endswith(".rels"), F.regexp_extract_all(text, F.lit(_REL), F.lit(1))), lambda x: F.struct(F.lower(_attr(x, "TargetMode")).alias("mode"), F.substring_index(_attr(x, "Type"), "/", -1).alias("type"), _attr(x, "Target").alias("target")))
    outside = F.filter(rels, lambda r: r["mode"] == "external")
    instr = r'(?i)<w:instrText[^<>]{0,200}>[^<]{0,2000}?\bDDE(?:AUTO)?\b|w:instr="[^"]{0,2000}?\bDDE(?:AUTO)?\b'
    cell = r"(?i)<f(?:\s[^<>]{0,200})?>[^<]{0,2000}?(?:cmd|powershell|mshta|regsvr32)[^<]{0,2000}?\|"
    name = F.col("name")
    has = lambda cond: F.coalesce(F.bool_or(cond), F.lit(False))
    runs = A.file_extension(name).isin(A.RUNNABLE_EXT)
    g = members.filter("parent_kind = 'zip'").groupBy("email_id", "parent_path").agg(
        has(name == "[Content_Types].xml").alias("ct"), has(name.rlike("^(word|xl|ppt|visio)/")).alias("office"), has(F.lower(name).endswith("vbaproject.bin")).alias("vba"),
        has((name == "[Content_Types].xml") & text.rlike("macroEnabled|vbaProject")).alias("macro_ct"), has(name.startswith("xl/macrosheets/")).alias("xlm"), has((name == "xl/workbook.xml") & F.contains(text, F.lit("veryHidden"))).alias("hidden"),
        has(F.contains(name, F.lit("/embeddings/")) & runs).alias("bad_embed"), F.count_if(F.contains(name, F.lit("/embeddings/"))).alias("embeds"), has(F.contains(name, F.lit("/activeX/"))).alias("activex"),
        F.flatten(F.collect_list(outside)).alias("rels"), has(name.rlike(r"^word/[^/]*\.xml$") & text.rlike(instr)).alias("dde_field"), has(name.rlike(r"^xl/worksheets/.*\.xml$") & text.rlike(cell)).alias("dde_cell"),
    ).filter("ct AND office").join(names, ["email_id", "parent_path"], "left")
    local = lambda r: r["target"].startswith("\\\\") | F.lower(r["target"]).rlike("^(file:|//)")
    any_rel = lambda cond: F.exists("rels", cond)
    of = lambda *t: lambda r: ~local(r) & r["type"].isin(*t)
    macro, plain = F.col("vba") | F.col("macro_ct"), F.coalesce(F.col("ext"), F.lit("")).isin("docx", "xlsx", "pptx", "dotx", "xltx", "potx", "ppsx")
    return g.select("email_id", "parent_path", A._found(
        (macro & plain, A.signal("high", "macros_hidden_behind_plain_extension", F.concat(F.lit("Macros in a ."), "ext"))), (macro & ~plain, A.signal("medium", "vba_macros", "Package with macros.")),
        (F.col("xlm") & F.col("hidden"), A.signal("high", "excel4_macro_sheet_hidden", "Hidden macro sheet.")), (F.col("xlm") & ~F.col("hidden"), A.signal("medium", "excel4_macro_sheet", "Macro sheet.")),
        (F.col("bad_embed"), A.signal("high", "embedded_executable", "Embeds a runnable file.")), (~F.col("bad_embed") & (F.col("embeds") > 0), A.signal("medium", "embedded_objects", "Embeds objects.")), (F.col("activex"), A.signal("medium", "activex_controls", "Holds controls.")),
        (any_rel(local), A.signal("high", "unc_or_file_link", "Link to a file or network path.")), (any_rel(of("attachedTemplate", "oleObject", "subDocument", "mailMerge")), A.signal("high", "remote_content_link", "Content from a remote place.")),
        (any_rel(of("externalLink", "frame", "externalLinkPath")), A.signal("medium", "external_data_link", "Data from outside.")), (any_rel(of("image")), A.signal("low", "remote_image", "Remote picture.")),
        (F.col("dde_field"), A.signal("high", "dde_field", "Field starts a command.")), (F.col("dde_cell"), A.signal("high", "dde_cell_formula", "Formula starts a command.")),
    ).alias("signals"), F.array_distinct(F.filter(F.transform("rels", lambda r: r["target"]), lambda t: F.lower(t).rlike("^(https?://|hxxp)"))).alias("link_urls"))


# --- report ---


def dedupe_signals(signals: DataFrame) -> DataFrame:
    """One row per (email_id, file_path, signal): the highest severity, its first detail; rank lists a file's by severity, then by first sight."""
    key = ["email_id", "file_path", "signal"]
    best = signals.groupBy(*key).agg(F.min("seq").alias("seq"), F.max("severity").alias("severity"), F.max_by("detail", F.struct("severity", (-F.col("seq")).alias("s"))).alias("detail"))
    w = Window.partitionBy("email_id", "file_path").orderBy(F.desc("severity"), "seq")
    return best.select(*key, "severity", "detail", F.row_number().over(w).alias("rank"))


def cap_file_urls(urls: DataFrame, n: int = 25) -> DataFrame:
    """First n distinct URLs of a file in the order in which they were found. urls: email_id, file_path, pos, url."""
    first = urls.groupBy("email_id", "file_path", "url").agg(F.min("pos").alias("pos"))
    w = Window.partitionBy("email_id", "file_path").orderBy("pos", "url")
    return first.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= n).select("email_id", "file_path", "url", "n")


def rollup_risk(files: DataFrame, signals: DataFrame) -> DataFrame:
    """email_id, file_path, risk: the highest severity of a file's own signals and of all below it."""
    parts = F.split("file_path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    up = signals.select("email_id", F.explode(above).alias("file_path"), "severity").groupBy("email_id", "file_path").agg(F.max("severity").alias("risk"))
    return files.select("email_id", "file_path").join(up, ["email_id", "file_path"], "left").select("email_id", "file_path", F.coalesce("risk", F.lit(0)).alias("risk"))


def email_signals(files: DataFrame, signals: DataFrame, bodies: DataFrame) -> DataFrame:
    """email_id, signals of the whole mail. files: email_id, file_path, reason; bodies: email_id, body."""
    locked = signals.filter(F.col("signal").isin("encrypted_archive", "password_protected_office")).select("email_id").distinct().withColumn("locked", F.lit(True))
    top = files.filter(~F.contains("file_path", F.lit("/"))).groupBy("email_id").agg(F.count("reason").alias("n"), F.min_by("reason", F.when(F.col("reason").isNotNull(), F.col("file_path").cast("int"))).alias("why"))
    out = bodies.join(top, "email_id", "left").join(locked, "email_id", "left")
    hint = F.coalesce("body", F.lit("")).rlike(r"(?iU)\b(pass(?:word|code|phrase)?|pwd)\b") & F.coalesce("locked", F.lit(False))
    told = F.concat(F.col("n").cast("string"), F.lit(" attachment(s) not analysed ("), "why", F.lit(")"))
    return out.select("email_id", A._found((hint, A.signal("high", "encrypted_attachment_with_password_in_body", "Locked attachment, and the body names a password.")), (F.coalesce("n", F.lit(0)) > 0, A.signal("low", "attachments_not_analysed", told))).alias("signals"))


def rank_hash_lookups(files: DataFrame, n: int = MAX_LOOKUPS) -> DataFrame:
    """Candidates with place (of their hash among the mail's distinct ones) and looked_up: the riskiest files first, then walk order."""
    dull = F.col("kind").isin(*SKIPPED_KINDS) & (F.col("risk") == 0)
    c = files.filter(F.col("sha256").isNotNull() & F.col("reason").isNull() & (F.col("size") > 0) & ~dull)
    order = F.struct((-F.col("risk")).alias("r"), "file_path")
    first = c.groupBy("email_id", "sha256").agg(F.min(order).alias("o"))
    place = first.select("email_id", "sha256", F.row_number().over(Window.partitionBy("email_id").orderBy("o")).alias("place"))
    return c.join(place, ["email_id", "sha256"]).withColumn("looked_up", F.col("place") <= n)


def lookup_file_hashes(files: DataFrame, reputation: DataFrame, n: int = MAX_LOOKUPS) -> DataFrame:
    """Attaches the feed (kind `hashes`) to every file of a looked-up hash; the others are marked as skipped."""
    feed = reputation.filter("kind = 'hashes'").drop("kind").withColumnRenamed("indicator", "sha256")
    out = rank_hash_lookups(files, n).join(feed, "sha256", "left")
    return out.withColumns({"found": F.when(F.col("looked_up"), F.coalesce("found", F.lit(False))), "skipped": ~F.col("looked_up")})
