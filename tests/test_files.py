import email.message
import io
import random
import time
import zipfile
import zlib

from pyspark.sql import functions as F

from lurewatch.functions import attachments as A
from lurewatch.operators import files, report


def names(spark, value, f, kind="string"):
    return [s["signal"] for s in spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]]


def zipped(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for k, v in members.items():
            z.writestr(k, v)
    return out.getvalue()


def kinds(spark, rows):
    df = spark.createDataFrame(rows, "data binary, name string, ct string")
    return [r["k"] for r in df.select(A.detect_kind(F.col("data"), F.col("name"), F.col("ct")).alias("k")).collect()]


def test_kinds(spark):
    pe = b"MZ" + b"\0" * 58 + (64).to_bytes(4, "little") + b"PE\0\0" + b"\0" * 20
    cases = [
        (b"", "empty"), (None, "empty"), (pe, "pe"), (b"MZ short", "dos_exe"), (b"\x7fELF\x01", "elf"), (b"junk %PDF-1.4", "pdf"), (zipped({"a": "b"}), "zip"), (bytes.fromhex("D0CF11E0A1B11AE1"), "ole"), (b"Rar!\x1a\x07\x00", "rar"),
        (b"\x1f\x8b\x08", "gzip"), (b"\x89PNG\r\n\x1a\n", "png"), (b"\xff\xd8\xff\xe0", "jpeg"), (b"RIFF\x00\x00\x00\x00WEBPxx", "webp"), (b"\xef\xbb\xbf {\\rtf1", "rtf"), (b"From: a\nSubject: b\n\nhi", "eml"),
        (b"<SVG xmlns>", "svg"), (b"<p><Script>", "html"), (b"plain text", "text"), (b"\x00\x01\x02\x03", "unknown"), (b"\x00" * 0x8001 + b"CD001", "iso"), ("<html>".encode("utf-16"), "html"),
    ]
    assert kinds(spark, [(d, "f", "") for d, _ in cases]) == [k for _, k in cases]
    assert kinds(spark, [(b"\x00\x01\x02", "f", "message/RFC822")]) == ["eml"]


def test_filenames(spark):
    assert names(spark, "invoice.pdf.exe", A.filename_signals) == ["double_extension"]
    assert names(spark, "a\u202efdp.exe", A.filename_signals) == ["bidi_filename_trick"]
    assert "padded_extension" in names(spark, "a.pdf      .exe", A.filename_signals)
    assert names(spark, "x.txt. ", A.filename_signals) == ["trailing_dots_or_spaces"]
    assert names(spark, "report.pdf", A.filename_signals) == [] and names(spark, None, A.filename_signals) == []
    shown = spark.createDataFrame([("a\u202eb\x01",)], "x string").select(A.safe_filename(F.col("x")).alias("y")).first()["y"]
    assert shown == "a<U+202E>b<U+0001>"


def test_html_script_macro_rtf_pdf(spark):
    html = '<form action="https://x.example/p"><input type=password></form><script>eval(atob("x")); new Blob(); a.download = 1</script><iframe><meta http-equiv="refresh">' + "A" * 2000
    got = names(spark, html, lambda c: A.html_signals(c, F.lit(False)))
    assert got == ["credential_harvest_form", "html_smuggling", "obfuscated_script", "large_encoded_blob", "meta_refresh_redirect", "iframe", "html_attachment"]
    assert names(spark, "<svg onload=x>", lambda c: A.html_signals(c, F.lit(True))) == ["svg_script"]
    s = spark.createDataFrame([("powershell -enc AAAAAAAAAAAAAAAAAAAAAAAA\nIEX",)], "x string").select(A.script_signals(F.col("x"), F.lit("ps1")).alias("s")).first()["s"]
    assert s["indicators"] == ["encoded_powershell", "runs_commands"] and s["lines"] == 2
    assert names(spark, "Sub AutoOpen()\nShell x\nEnd Sub", A.macro_source_signals) == ["vba_autoexec_suspicious"]
    assert names(spark, "Sub Document_Open()", A.macro_source_signals) == ["vba_autoexec"]
    assert names(spark, b"{\\rtf \\objdata \\objupdate Equation.3 {\\*\\template http://x.example/t}}", A.rtf_signals, "binary") == ["rtf_embedded_object", "rtf_auto_updating_object", "rtf_equation_editor", "remote_template"]
    pdf = b"%PDF-1.4 /Type /Page /OpenAction /Java#53cript /URI (http://x.example/a\\)b) stream\n" + zlib.compress(b"/Launch /EmbeddedFile") + b"\nendstream"
    r = spark.createDataFrame([(pdf,)], "x binary").select(A.pdf_features(files.pdf_text("x")).alias("p")).first()["p"]
    assert r["counts"]["JavaScript"] == 1 and r["counts"]["Launch"] == 1 and r["pages"] == 1 and r["links"] == 1
    assert [s["signal"] for s in r["signals"]] == ["pdf_launch_action", "pdf_javascript_autorun", "pdf_embedded_file"]


def test_strings_and_entropy(spark):
    data = b"\x00\x01cmd.exe /c x\x00\x02" + "powershell".encode("utf-16-le") + b"\x00\xff"
    df = spark.createDataFrame([(data,), (b"",), (bytes(range(256)),), (None,)], "x binary")
    rows = df.select(A.binary_strings(F.col("x")).alias("s"), files.byte_entropy("x").alias("e"), A.file_hashes(F.col("x")).alias("h")).collect()
    assert rows[0]["s"] == ["cmd.exe /c x", "powershell"] and [r["e"] for r in rows[1:]] == [0.0, 8.0, 0.0]
    assert rows[1]["h"]["md5"] == "d41d8cd98f00b204e9800998ecf8427e"
    hits = spark.createDataFrame([("run C:\\t\\setup.exe now",)], "x string").select(A.runnable_names(F.col("x")).alias("y")).first()["y"]
    assert len(hits) == 1 and hits[0].endswith("setup.exe")


def _files(spark, rows):
    return spark.createDataFrame(rows, "email_id string, file_path string, name string, content_type string, data binary")


def test_archives_nested(spark):
    inner = zipped({"b.js": "x", "c.txt": "y"})
    mail = email.message.EmailMessage()
    mail["Subject"] = "inner"
    mail.set_content("see http://x.example")
    mail.add_attachment(b"MZ", maintype="application", subtype="octet-stream", filename="setup.exe")
    df = _files(spark, [("m1", "0", "a.zip", "", zipped({"d/": "", "in.zip": inner, "x.pdf.exe": "MZ"})), ("m1", "1", "m.eml", "message/rfc822", b"From: a\n" + mail.as_bytes()), ("m2", "0", "bad.zip", "", b"PK\x03\x04broken")])
    got = {(r["email_id"], r["file_path"]): r for r in files.analyze_nested(df).collect()}
    assert {k[1] for k in got if k[0] == "m1"} == {"0", "1", "0/001", "0/002", "0/001/000", "0/001/001", "1/000"}
    assert got["m1", "0/001"]["kind"] == "zip" and got["m1", "1/000"]["name"] == "setup.exe" and ("m2", "0") in got
    members = files.expand(df.withColumn("kind", A.detect_kind(F.col("data"), F.col("name"), F.col("content_type"))))
    signals = {r["parent_path"]: [s["signal"] for s in r["signals"]] for r in files.archive_signals(members).collect()}
    assert signals == {"0": ["member_double_extension", "archive_contains_runnable", "nested_archive"]}
    assert files.inner_mail(df.withColumn("kind", F.lit("eml")).filter("file_path = '1'")).first()["subject"] == "inner"


def test_member_names_are_judged(spark):
    df = _files(spark, [("m", "0", "a.zip", "", zipped({"invoice.pdf.exe": "MZ", "b\u202efdp.exe": "x", "other.doc.js": "y", "plain.txt": "z"}))])
    members = files.expand(df.withColumn("kind", F.lit("zip")))
    got = {s["signal"]: (s["severity"], s["detail"]) for s in files.archive_signals(members).first()["signals"]}
    assert set(got) == {"member_double_extension", "member_bidi_filename_trick", "archive_contains_runnable"}
    assert got["member_double_extension"][0] == 3 and got["member_double_extension"][1].startswith("invoice.pdf.exe: ") and "<U+202E>" in got["member_bidi_filename_trick"][1]


def test_unpacking_stays_within_the_budget_of_a_mail(spark):
    mib = 1 << 20
    block = random.Random(1).randbytes(9000)
    bomb = zipped({f"{i:02}.bin": block * (9 * mib // 9000) for i in range(30)})  # 30 members of 9 MiB, each well below the ratio of a bomb
    assert len(bomb) < 4 * mib and 9 * mib / (len(bomb) / 30) < files.MAX_RATIO
    rows = [("m", str(k), f"{k}.zip", "", bomb) for k in range(10)] + [("n", "0", "n.zip", "", zipped({"in.zip": bomb, "small.txt": "s"}))]
    df = _files(spark, rows)
    began = time.time()
    out = files.unpack(df.withColumn("kind", F.lit("zip"))).select("email_id", "file_path", "size", "reason", F.octet_length("data").alias("held")).collect()
    assert time.time() - began < 60
    by_mail = {m: [r for r in out if r["email_id"] == m] for m in ("m", "n")}
    assert {m: sum(r["held"] or 0 for r in rs) <= files.MAX_UNPACKED for m, rs in by_mail.items()} == {"m": True, "n": True}
    assert [r["file_path"] for r in by_mail["m"] if r["held"]] == [f"0/{i:03}" for i in range(5)] and len(by_mail["m"]) == 300
    assert all((r["held"] is None) == (r["reason"] == "unpack limit reached") for r in out)
    inner = [r["file_path"] for r in by_mail["n"] if r["held"]]
    assert inner == ["0/000", *(f"0/000/{i:03}" for i in range(5)), "0/001"]  # what is small still fits after what is not


def test_parts_for_signals_are_handed_on_in_parts(spark):
    doc = zipped({"[Content_Types].xml": "x", "word/document.xml": "y" * 100, "word/media/a.png": "z" * 100, "xl/worksheets/s1.xml": "w"})
    got = {r["name"]: r["data"] for r in files.expand(_files(spark, [("m", "0", "a.docx", "", doc)]).withColumn("kind", F.lit("zip"))).collect()}
    assert {k for k, v in got.items() if v} == {"[Content_Types].xml", "word/document.xml", "xl/worksheets/s1.xml"} and len(got) == 4


def test_kind_of_containers_in_a_task_is_that_of_the_column(spark):
    rng = random.Random(11)
    seeds = [zipped({"a": "b"}), b"From: a\nSubject: b\n\nhi", b"X-Thing: 1\nno", b"\xef\xbb\xbf {\\rtf1 From: x", b"%PDF PK", b"MZ From:", "From: a\nSubject: b".encode("utf-16"), b"From:\x00\x01", b"RIFF    WEBPFrom:", b"PK\x05\x06", b"subject: x", b"", b" \x1cFrom: a\nFrom: b", b"\xa0From: a\nFrom: b", b"Date: 1" + b"\x01" * 9]
    rows = []
    for k in range(600):
        d = bytearray(rng.choice(seeds))
        for _ in range(rng.choice((0, 0, 1, 2))):
            if d:
                d[rng.randrange(len(d))] = rng.choice(b"PK\x00\x01\nF:%a")
        rows.append((bytes(d), rng.choice(("a.eml", "b.EML. ", "c", "", "eml")), rng.choice(("", "message/rfc822"))))
    want = [k if k in ("zip", "eml") else None for k in kinds(spark, rows)]
    assert [A.container_kind(*r) if r[0] else None for r in rows] == want and {"zip", "eml", None} <= set(want)


def test_links_of_pdf_files_and_packages(spark):
    pdf = b"%PDF-1.4 <x xmlns='http://www.w3.example/ns'> /URI (https://real.example/a\\(1\\)b) stream\n" + zlib.compress(b"/URI(http://deep.example/z)") + b"\nendstream"
    rels = '<Relationships><Relationship Type="x/hyperlink" Target="https://lure.example/login" TargetMode="External"/><Relationship Type="x/hyperlink" Target="hxxp://defanged.example" TargetMode="External"/><Relationship Type="x/image" Target="media/a.png"/></Relationships>'
    doc = zipped({"[Content_Types].xml": "x", "word/document.xml": "y", "word/_rels/document.xml.rels": rels})
    df = _files(spark, [("m", "0", "a.pdf", "", pdf), ("m", "1", "b.docx", "", doc), ("m", "2", "c.zip", "", zipped({"in.docx": doc, "x.pdf.exe": "MZ"}))]).withColumn("reason", F.lit(None).cast("string"))
    got = {r["file_path"]: r for r in report.analyze_attachments(df).collect()}
    assert sorted(got["0"]["urls"]) == ["http://deep.example/z", "https://real.example/a(1)b"]
    assert got["1"]["urls"] == ["https://lure.example/login", "hxxp://defanged.example"] and got["2/000"]["urls"] == got["1"]["urls"]
    assert "member_double_extension" in [s["signal"] for s in got["2"]["signals"]] and got["2"]["risk"] == 3


def test_office_packages(spark):
    rels = '<Relationships><Relationship Type="http://x/attachedTemplate" Target="http://t.example/a" TargetMode="External"/><Relationship Type="x/image" Target="file:///c" TargetMode="External"/></Relationships>'
    doc = zipped({"[Content_Types].xml": "macroEnabled", "word/document.xml": '<w:instrText a="b">DDEAUTO c</w:instrText>', "word/vbaProject.bin": "x", "word/_rels/document.xml.rels": rels, "word/embeddings/a.exe": "x"})
    df = _files(spark, [("m", "0", "a.docx", "", doc)]).withColumn("kind", F.lit("zip"))
    own = df.select("email_id", F.col("file_path").alias("parent_path"), A.file_extension(F.col("name")).alias("ext"))
    got = [s["signal"] for s in files.ooxml_signals(files.expand(df), own).first()["signals"]]
    assert got == ["macros_hidden_behind_plain_extension", "embedded_executable", "unc_or_file_link", "remote_content_link", "dde_field"]


def test_admission(spark):
    mib = 1 << 20
    df = spark.createDataFrame([("m", i, s * mib, "") for i, s in enumerate([20, 90, 30, 20, 5, 1, 1, 1, 1, 1, 1])], "email_id string, att_idx int, size long, skipped_reason string")
    got = {r["att_idx"]: r["skipped_reason"] for r in files.admit_downloads(df, 25 * mib).collect()}
    assert got[0] == "" and got[1] == "larger than the limit" and got[10] == "too many attachments" and got[3] == ""
    late = {r["att_idx"]: r["reason"] for r in files.admit_analysis(df.withColumn("skipped_reason", F.lit(""))).collect()}
    assert late[0] is None and late[1] == "total attachment size limit reached" and late[10].startswith("more than")


def test_urls_per_file(spark):
    df = spark.createDataFrame([("m", "0", i, f"http://h{i % 40}.example") for i in range(100)], "email_id string, file_path string, pos int, url string")
    assert [r["url"] for r in files.cap_file_urls(df).orderBy("n").collect()] == [f"http://h{i}.example" for i in range(25)]


def test_mutated_bytes_never_fail(spark):
    rng, seeds = random.Random(7), [zipped({"a.js": "x" * 50}), b"%PDF-1.4 stream\n" + zlib.compress(b"x") + b"endstream", b"From: a\nSubject: b\n\nhi", b"{\\rtf1 \\objdata}", b"MZ" + b"\0" * 90]
    rows = []
    for k in range(100):
        d = bytearray(seeds[k % 5])
        for _ in range(5):
            d[rng.randrange(len(d))] = rng.randrange(256)
        rows.append((f"m{k}", "0", "f.bin", "", bytes(d)))
    df = _files(spark, rows)
    assert files.analyze_nested(df).count() >= 100
    kind = A.detect_kind(F.col("data"), F.col("name"), F.col("content_type"))
    assert len(df.select(kind, A.rtf_signals(F.col("data")), A.pdf_features(files.pdf_text("data")), A.html_signals(A.decode_text(F.col("data")), F.lit(False)), files.byte_entropy("data")).collect()) == 100
