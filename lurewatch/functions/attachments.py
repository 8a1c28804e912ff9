"""Column functions over attachments: names, kinds and static red flags. Built-in expressions only.

A signal is a struct severity (0 none to 3 high), signal, detail; a list of them may hold a signal once.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SEVERITIES = ("none", "low", "medium", "high")
SIGNAL = "struct<severity:int,signal:string,detail:string>"

# Groups of file extensions.
EXEC_EXT = "exe scr com pif dll cpl msi msp sys ocx drv xll wll".split()
SCRIPT_EXT = "js jse vbs vbe wsf wsh ws vb ps1 psm1 psd1 ps1xml bat cmd hta sh jar reg msc gadget inf sct chm".split()
SHORTCUT_EXT = "lnk url scf appref-ms settingcontent-ms library-ms search-ms".split()
DISK_IMAGE_EXT = "iso img vhd vhdx udf".split()
MACRO_OFFICE_EXT = "docm xlsm pptm dotm xltm potm xlam ppam sldm xlsb".split()
OFFICE_EXT = "doc docx dot dotx xls xlsx xlt xltx ppt pptx pps ppsx pot potx".split() + MACRO_OFFICE_EXT
ARCHIVE_EXT = "zip rar 7z gz tgz tar bz2 xz cab z arj ace lzh lha".split()
HTML_EXT = "html htm xhtml shtml svg mht mhtml hta".split()
INSTALLER_EXT = "appx msix msixbundle appxbundle appinstaller application deploy mst".split()
DOC_LIKE_EXT = "pdf doc docx xls xlsx ppt pptx txt rtf csv jpg jpeg png gif zip htm html msg eml".split()
RUNNABLE_EXT = EXEC_EXT + SCRIPT_EXT + SHORTCUT_EXT + INSTALLER_EXT
RUNNABLE_KINDS = ("pe", "dos_exe", "elf", "macho", "lnk", "iso", "vhd")

# What an extension should hold.
EXPECTED_KINDS = {
    "pdf": ("pdf",), "jpg": ("jpeg",), "jpeg": ("jpeg",), "png": ("png",), "gif": ("gif",), "webp": ("webp",), "zip": ("zip",), "rar": ("rar",), "7z": ("7z",), "gz": ("gzip",), "cab": ("cab",), "rtf": ("rtf",),
    "exe": ("pe", "dos_exe"), "dll": ("pe",), "scr": ("pe", "dos_exe"), "lnk": ("lnk",), "iso": ("iso",), "eml": ("eml",), "one": ("onenote",),
    "txt": ("text",), "csv": ("text",), "log": ("text",), "html": ("html", "text"), "htm": ("html", "text"), "svg": ("svg",),
} | {e: ("zip",) for e in OFFICE_EXT if e.endswith(("x", "m")) or e == "xlsb"} | {e: ("ole", "zip", "rtf", "html", "text") for e in ("doc", "dot", "xls", "xlt", "ppt", "pps", "pot")}

_BIDI = "\u202a-\u202e\u2066-\u2069"
MAX_TEXT = 4 << 20


def signal(severity: str, name: str, detail: Column | str) -> Column:
    text = F.lit(detail) if isinstance(detail, str) else detail
    return F.struct(F.lit(SEVERITIES.index(severity)).alias("severity"), F.lit(name).alias("signal"), text.alias("detail"))


def _found(*pairs: tuple[Column, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(when, what) for when, what in pairs])).cast(f"array<{SIGNAL}>")


def file_hashes(data: Column) -> Column:
    return F.struct(F.sha2(data, 256).alias("sha256"), F.sha1(data).alias("sha1"), F.md5(data).alias("md5"))


def file_extension(name: Column) -> Column:
    """What follows the last dot of the first 500 characters, trailing dots and spaces aside; empty if there is none."""
    clean = F.lower(F.rtrim(F.trim(F.substr(F.coalesce(name, F.lit("")), F.lit(1), F.lit(500))), F.lit(". ")))
    return F.regexp_extract(clean, r"(?s)\.([^.]*)$", 1)


def safe_filename(name: Column) -> Column:
    """Control, format and line-separator characters shown by their code point."""
    short = F.substr(F.coalesce(name, F.lit("")), F.lit(1), F.lit(500))
    shown = lambda c: F.when(c.rlike(r"[\p{Cc}\p{Cf}\p{Zl}\p{Zp}]"), F.concat(F.lit("<U+"), F.lpad(F.hex(_code_point(c)), 4, "0"), F.lit(">"))).otherwise(c)
    return F.array_join(F.transform(F.split(short, ""), shown), "")


def _code_point(c: Column) -> Column:
    """Code point of one character, from its UTF-32 form."""
    return F.conv(F.hex(F.encode(c, "UTF-32")), 16, 10).cast("bigint")


def filename_signals(name: Column) -> Column:
    raw = F.substr(F.coalesce(name, F.lit("")), F.lit(1), F.lit(500))
    seen = F.regexp_replace(raw, f"[{_BIDI}]", "")
    double = rf"(?i)\.({'|'.join(sorted(DOC_LIKE_EXT))})[\s. _-]*\.([a-z0-9]{{2,8}})\s*$"
    inner, outer = F.lower(F.regexp_extract(seen, double, 1)), F.lower(F.regexp_extract(seen, double, 2))
    return _found(
        (raw.rlike(f"[{_BIDI}]"), signal("high", "bidi_filename_trick", "The name holds a character that turns the reading direction.")),
        (outer.isin(RUNNABLE_EXT + MACRO_OFFICE_EXT + HTML_EXT), signal("high", "double_extension", F.concat(F.lit("Looks like ."), inner, F.lit(" and ends in ."), outer))),
        (seen.rlike(r"(?i)\.[a-z0-9]{2,5}\s{3,}\.[a-z0-9]{2,5}$"), signal("high", "padded_extension", "Spaces hide the extension.")),
        (seen != F.rtrim(seen, F.lit(". ")), signal("medium", "trailing_dots_or_spaces", "The name ends in dots or spaces.")),
    )


def latin(data: Column) -> Column:
    """Bytes as characters of the same numbers, for patterns over binary data."""
    return F.decode(data, "ISO-8859-1")


def decode_text(data: Column) -> Column:
    """Text of the first 4 MiB: UTF-16 after a byte-order mark, else UTF-8; what cannot be decoded is replaced."""
    part = F.substring(data, 1, MAX_TEXT)
    wide = F.hex(F.substring(part, 1, 2)).isin("FFFE", "FEFF")
    even = F.substring(part, F.lit(1), (F.octet_length(part) - F.octet_length(part) % 2).cast("int"))
    return F.when(wide, F.decode(even, "UTF-16")).otherwise(F.make_valid_utf8(part.cast("string")))


#: Kind, offset of its mark from 1, mark in hexadecimal digits; in the order in which they are tried (fixed values).
_MAGIC = (
    ("elf", 1, ("7F454C46",)), ("macho", 1, ("CFFAEDFE", "FEEDFACF", "CEFAEDFE", "FEEDFACE")), ("pdf", 0, ()), ("zip", 1, ("504B0304", "504B0506", "504B0708")), ("ole", 1, ("D0CF11E0A1B11AE1",)),
    ("lnk", 1, ("4C0000000114020000000000C000000000000046",)), ("onenote", 1, ("E4525C7B8CD8A74DAEB15378D02996D3",)), ("rar", 1, ("526172211A07",)), ("7z", 1, ("377ABCAF271C",)), ("gzip", 1, ("1F8B",)),
    ("bzip2", 1, ("425A68",)), ("xz", 1, ("FD377A585A00",)), ("cab", 1, ("4D534346",)), ("vhd", 1, ("636F6E6563746978", "7668647866696C65")), ("iso", 0x8002, ("4344303031", "4245413031")),
    ("png", 1, ("89504E470D0A1A0A",)), ("jpeg", 1, ("FFD8FF",)), ("gif", 1, ("47494638",)), ("tiff", 1, ("49492A00", "4D4D002A")),
)
#: How a mail begins (fixed value).
_MAIL_START = r"(?i)\A\s*(?:Received|From|Date|Subject|MIME-Version|Return-Path|Message-ID|To|Delivered-To|X-[\w-]+|Content-Type):"


def detect_kind(data: Column, filename: Column, content_type: Column) -> Column:
    """What the bytes are, whatever the name says; one of 29 kinds, `unknown` and `empty` among them."""
    head = F.substring(data, 1, 8192)
    h = F.hex(F.substring(head, 1, 32))
    text = latin(head)
    at = _little_endian(F.hex(F.substring(data, 0x3D, 4)))
    size = F.octet_length(data)
    is_pe = (size >= 0x40) & (at > 0) & (at < size - 4) & (F.hex(F.substring(data, (at + 1).cast("int"), F.lit(4))) == "50450000")
    kind = F.when(data.isNull() | (size == 0), "empty").when(h.startswith("4D5A"), F.when(is_pe, "pe").otherwise("dos_exe"))
    for name, offset, marks in _MAGIC:
        if name == "pdf":
            hit = F.contains(F.substr(text, F.lit(1), F.lit(1024)), F.lit("%PDF-"))
        else:
            hit = F.lit(False)
            for m in marks:
                hit = hit | (F.hex(F.substring(data, offset, len(m) // 2)) == m)
        kind = kind.when(hit, name)
    kind = kind.when(h.startswith("52494646") & (F.substring(h, 17, 8) == "57454250"), "webp")
    kind = kind.when(F.ltrim(text, F.lit("\u00ef\u00bb\u00bf \t\r\n")).startswith("{\\rt"), "rtf")
    wide = h.rlike("^(FFFE|FEFF)")
    sample = F.substr(text, F.lit(1), F.lit(4096))
    odd = F.regexp_count(sample, F.lit(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"))
    is_text = wide | (~F.contains(text, F.lit("\x00")) & (F.char_length(sample) - odd >= 0.95 * F.char_length(sample)))
    plain = F.when(wide, F.replace(text, F.lit("\x00"), F.lit(""))).otherwise(text)
    low, typed = F.lower(plain), F.contains(F.lower(F.coalesce(content_type, F.lit(""))), F.lit("rfc822"))
    mail = text.rlike(_MAIL_START) & (
        (file_extension(filename) == "eml") | typed | F.contains(text, F.lit("\nSubject:")) | F.contains(text, F.lit("\nFrom:"))
    )
    kind = kind.when(is_text & mail, "eml").when(is_text & F.contains(F.substr(low, F.lit(1), F.lit(2000)), F.lit("<svg")), "svg")
    kind = kind.when(is_text & low.rlike("<html|<!doctype html|<script|<form|<body|<iframe|<meta "), "html").when(is_text, "text").when(typed, "eml")
    return kind.otherwise("unknown")


def container_kind(data: bytes, filename: str, content_type: str) -> str | None:
    """zip or eml where detect_kind() says so, for bytes that are unpacked within a task."""
    head = data[:8192]
    if head[:2] == b"MZ":
        return None
    for name, offset, marks in _MAGIC:
        if b"%PDF-" in head[:1024] if name == "pdf" else any(data[offset - 1 : offset + 31].startswith(bytes.fromhex(m)) for m in marks):
            return "zip" if name == "zip" else None
    text = head.decode("latin-1")
    if head[:4] == b"RIFF" and head[8:12] == b"WEBP" or text.lstrip("\u00ef\u00bb\u00bf \t\r\n").startswith("{\\rt"):
        return None
    typed, sample = "rfc822" in (content_type or "").lower(), text[:4096]
    odd = sum(c < "\t" or "\x0b" <= c <= "\x0c" or "\x0e" <= c < " " or c == "\x7f" for c in sample)
    is_text = head[:2] in (b"\xff\xfe", b"\xfe\xff") or "\0" not in text and len(sample) - odd >= 0.95 * len(sample)
    named = (filename or "")[:500].strip(" ").rstrip(". ").lower().rpartition(".")
    mail = re.search(_MAIL_START, text, re.ASCII) and ((named[1] and named[2] == "eml") or typed or "\nSubject:" in text or "\nFrom:" in text)
    if is_text:
        return "eml" if mail else None
    return "eml" if typed else None


def _little_endian(digits: Column) -> Column:
    turned = F.concat(*[F.substring(digits, i, 2) for i in (7, 5, 3, 1)])
    return F.coalesce(F.conv(F.when(F.length(digits) == 8, turned), 16, 10).cast("bigint"), F.lit(0))


def kind_signals(kind: Column) -> Column:
    """Signals that a kind alone gives."""
    archive = kind.isin("rar", "7z", "gzip", "bzip2", "xz", "cab")
    return _found(
        (kind.isin("pe", "dos_exe"), signal("high", "windows_executable", "Windows or DOS program.")), (kind.isin("elf", "macho"), signal("high", "native_executable", "Program of another system.")),
        (kind == "lnk", signal("high", "shortcut_file", "Shortcut; such files often run scripts.")), (kind == "onenote", signal("medium", "onenote_attachment", "Notebook; can hide launchers behind pictures.")),
        (kind.isin("iso", "vhd"), signal("high", "disk_image_attachment", "Disk image; not inspected.")), (archive, signal("low", "archive_not_inspected", "Archive; not unpacked.")),
    )


def extension_signals(kind: Column, ext: Column, has_script: Column | None = None, has_macro: Column | None = None) -> Column:
    """Signals from the extension, where the content did not already give them."""
    no = F.lit(False)
    script, macro = (no if has_script is None else has_script), (no if has_macro is None else has_macro)
    apart = ~kind.isin(*RUNNABLE_KINDS)
    by_name = (
        F.when(apart & ext.isin(EXEC_EXT + SHORTCUT_EXT + INSTALLER_EXT), signal("high", "dangerous_extension", F.concat(F.lit("Runs code: ."), ext)))
        .when(apart & ext.isin(DISK_IMAGE_EXT), signal("high", "dangerous_extension", F.concat(F.lit("Disk image: ."), ext)))
        .when(apart & ext.isin(SCRIPT_EXT) & (ext != "jar") & ~script, signal("high", "dangerous_extension", F.concat(F.lit("Script: ."), ext)))
        .when(apart & ext.isin(MACRO_OFFICE_EXT) & ~macro, signal("medium", "macro_enabled_extension", F.concat(F.lit("Can hold macros: ."), ext)))
    )
    wrong = no
    for e, kinds in EXPECTED_KINDS.items():
        wrong = wrong | ((ext == e) & ~kind.isin(*kinds))
    wrong = wrong & (kind != "empty")
    told = F.concat(F.lit("Named ."), ext, F.lit(", holds "), kind)
    loud = kind.isin("rtf", "html", "svg", "ole", "zip", "pdf", "eml", "pe") & ~ext.isin(ARCHIVE_EXT + HTML_EXT)
    by_content = (
        F.when(wrong & kind.isin(*RUNNABLE_KINDS) & ~ext.isin(RUNNABLE_EXT), signal("high", "disguised_executable", told))
        .when(wrong & loud, signal("medium", "type_mismatch", told)).when(wrong, signal("low", "type_mismatch", told))
    )
    return F.array_compact(F.array(by_name, by_content)).cast(f"array<{SIGNAL}>")


# Patterns of HTML red flags. The encoded block stands as two runs because the engine of the SQL in the
# tests repeats 1000 times at most; 2000 such characters or more match either way.
HTML_RULES = {
    "password_field": r"""(?i)type\s*=\s*["']?password|autocomplete\s*=\s*["']?(?:current|new)-password""", "form_tag": r"(?i)<form\b",
    "obfuscation": r"(?i)\batob\s*\(|fromCharCode|\bunescape\s*\(|\beval\s*\(|document\.write\s*\(", "blob_download": r"(?i)new\s+Blob\b",
    "blob_save": r"(?i)msSaveOrOpenBlob|createObjectURL|\.download\s*=", "big_encoded_blob": r"[A-Za-z0-9+/=]{1000}[A-Za-z0-9+/=]{1000}",
    "meta_refresh": r"""(?i)<meta[^<>]{0,300}http-equiv\s*=\s*["']?refresh""", "iframe": r"(?i)<iframe\b", "script_tag": r"(?i)<script\b", "svg_event": r"(?i)\bon(?:load|error|click)\s*=",
}
SOURCES = r"""(?i)\b(?:src|action|data-url)\s*=\s*["'](https?://[^"'\s>]+)"""
FORM_ACTION = r"""(?i)<form[^<>]{0,500}?action\s*=\s*["']?(https?://[^\s"'>]+)"""


def html_signals(text: Column, is_svg: Column) -> Column:
    hit = {k: text.rlike(p) for k, p in HTML_RULES.items()}
    target = F.substr(F.regexp_extract(text, FORM_ACTION, 1), F.lit(1), F.lit(100))
    remote = target != ""
    form = F.concat(F.lit("Password entry form"), F.when(remote, F.concat(F.lit(" that submits to "), target)).otherwise(""))
    return _found(
        (hit["password_field"], signal("high", "credential_harvest_form", form)), (~hit["password_field"] & remote, signal("medium", "form_posts_remote", F.concat(F.lit("Form posts to "), target))),
        (hit["blob_download"] & hit["blob_save"], signal("high", "html_smuggling", "A file is built and saved in the browser.")), (hit["obfuscation"] & hit["script_tag"], signal("medium", "obfuscated_script", "Script hides its text.")),
        (hit["big_encoded_blob"], signal("medium", "large_encoded_blob", "Large encoded block.")), (hit["meta_refresh"], signal("medium", "meta_refresh_redirect", "Page redirects by itself.")), (hit["iframe"], signal("low", "iframe", "Page embeds another.")),
        (is_svg & (hit["script_tag"] | hit["svg_event"]), signal("high", "svg_script", "Picture holds script.")), (~is_svg, signal("low", "html_attachment", "HTML file.")),
    )


# Patterns of script red flags.
SCRIPT_RULES = {
    "encoded_powershell": r"(?i)-e(?:nc|ncodedcommand)?\s+[A-Za-z0-9+/=]{20,}|FromBase64String",
    "download_cradle": r"(?i)DownloadString|DownloadFile|Net\.WebClient|Invoke-WebRequest|\biwr\b|XMLHTTP|URLDownloadToFile|bitsadmin|certutil[^\n]{0,200}-urlcache",
    "runs_commands": r"(?i)powershell|cmd(?:\.exe)?\s*/c|WScript\.Shell|\bShell\b|Start-Process|Invoke-Expression|\bIEX\b|mshta|regsvr32|rundll32",
    "obfuscation": r"(?i)\beval\s*\(|fromCharCode|\bChr\w?\s*\(|\bunescape\s*\(",
    "persistence_or_defense_evasion": r"(?i)schtasks|CurrentVersion\\Run|Set-MpPreference|DisableRealtimeMonitoring|Add-MpPreference",
}


def script_signals(text: Column, ext: Column) -> Column:
    """Struct of indicators, lines and signals (one, always high)."""
    from lurewatch.functions.text import keyword_hits

    hits = keyword_hits(text, SCRIPT_RULES)
    detail = F.concat(F.lit("Script ."), ext, F.when(F.size(hits) > 0, F.concat(F.lit(": "), F.array_join(hits, ", "))).otherwise(""))
    return F.struct(hits.alias("indicators"), (F.regexp_count(text, F.lit("\n")) + 1).alias("lines"), F.array(signal("high", "script_attachment", detail)).alias("signals"))


# Names that a PDF scan counts.
PDF_KEYS = "JavaScript JS OpenAction AA Launch EmbeddedFile RichMedia XFA AcroForm Encrypt URI SubmitForm GoToR GoToE ImportData ObjStm".split()


#: Target of a link in a PDF, escaped brackets included (fixed value).
PDF_URI = r"/URI\s*\(([^()\\]*+(?:\\.[^()\\]*+)*+)\)"


def pdf_link_targets(corpus: Column) -> Column:
    """Targets of the links of a PDF's text (see operators.files.pdf_text), brackets without their escapes."""
    undone = lambda t: F.replace(F.replace(t, F.lit("\\("), F.lit("(")), F.lit("\\)"), F.lit(")"))
    return F.transform(F.regexp_extract_all(corpus, F.lit(PDF_URI), F.lit(1)), undone)


def pdf_features(corpus: Column) -> Column:
    """Struct of counts (map), pages, links, signals over text of a PDF (see operators.files.pdf_text)."""
    counts = {k: F.regexp_count(corpus, F.lit(f"/{k}(?![A-Za-z0-9])")) for k in PDF_KEYS}
    some = lambda *ks: sum((counts[k] for k in ks[1:]), counts[ks[0]]) > 0
    js, auto = some("JavaScript", "JS"), some("OpenAction", "AA", "Launch")
    pairs = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), n.alias("value")) for k, n in counts.items()]), lambda p: p["value"] > 0)
    return F.struct(
        F.map_from_entries(pairs).alias("counts"), F.regexp_count(corpus, F.lit(r"/Type\s*/Page(?![A-Za-z])")).alias("pages"), F.regexp_count(corpus, F.lit(PDF_URI)).alias("links"),
        _found(
            (some("Launch"), signal("high", "pdf_launch_action", "Can launch a program.")), (js & auto, signal("high", "pdf_javascript_autorun", "Script runs on opening.")), (js & ~auto, signal("medium", "pdf_javascript", "Holds script.")),
            (some("EmbeddedFile"), signal("medium", "pdf_embedded_file", "Carries a file.")), (some("RichMedia"), signal("medium", "pdf_rich_media", "Embeds media.")),
            (some("SubmitForm", "ImportData", "GoToR"), signal("medium", "pdf_remote_actions", "Talks to a remote place.")), (some("Encrypt"), signal("low", "pdf_encrypted", "Encrypted; scan is limited.")),
        ).alias("signals"),
    )


def rtf_signals(data: Column) -> Column:
    text = latin(F.substring(data, 1, 8 << 20))
    low = F.lower(text)
    has = lambda s: F.contains(low, F.lit(s))
    target = F.trim(F.regexp_extract(text, r"(?i)\\\*\\template\s+([^}]+)", 1))
    return _found(
        (has("\\objdata"), signal("medium", "rtf_embedded_object", "Embeds an object.")), (has("\\objdata") & (has("\\objupdate") | has("\\objautlink")), signal("high", "rtf_auto_updating_object", "Object updates by itself.")),
        (low.rlike(r"\\objclass\s+equation") | has("equation.3"), signal("high", "rtf_equation_editor", "Refers to the equation editor.")),
        (target.rlike(r"(?i)^(https?:|\\\\|file:)"), signal("high", "remote_template", F.concat(F.lit("Loads a template: "), F.substr(target, F.lit(1), F.lit(100))))),
        ((F.regexp_count(low, F.lit(r"\{")) > 5000) & has("\\bin"), signal("medium", "rtf_obfuscation", "Dense groups with raw data.")),
    )


# Patterns over strings of binary files.
BINARY_RULES = {
    "powershell": r"(?i)powershell", "command_shell": r"(?i)cmd(?:\.exe)?\s*/c|%comspec%", "script_hosts": r"(?i)mshta|wscript|cscript|regsvr32|rundll32",
    "download_tools": r"(?i)certutil|bitsadmin|DownloadString|DownloadFile|URLDownloadToFile|WinHttp|InternetOpen", "encoded_command": r"(?i)-e(?:nc|ncodedcommand)\b|FromBase64String",
    "persistence": r"(?i)CurrentVersion\\Run|schtasks|\\Startup\\",
}
MAX_STRINGS = 20_000


def binary_strings(data: Column) -> Column:
    """Printable runs of six characters or more in the first 8 MiB, narrow ones first, then wide ones."""
    text = latin(F.substring(data, 1, 8 << 20))
    narrow = F.slice(F.regexp_extract_all(text, F.lit(r"[\x20-\x7e]{6,}"), F.lit(0)), 1, MAX_STRINGS)
    wide = F.transform(F.regexp_extract_all(text, F.lit(r"(?:[\x20-\x7e]\x00){6,}+"), F.lit(0)), lambda s: F.replace(s, F.lit("\x00"), F.lit("")))
    return F.when(F.size(narrow) >= MAX_STRINGS, narrow).otherwise(F.slice(F.concat(narrow, wide), 1, 2 * MAX_STRINGS))


def runnable_names(text: Column, limit: int = 20) -> Column:
    """File names with a runnable extension, with at most 80 characters before it."""
    pattern = r"(?i)[\w\\:. $~-]{0,80}?\.(?:exe|scr|js|jse|vbs|vbe|bat|cmd|ps1|hta|lnk|jar|dll|wsf|cpl|msi|pif)\b"
    return F.slice(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), 1, limit)


# Names and patterns of macro source.
AUTORUN = (
    r"(?i)\b(AutoOpen|AutoExec|AutoClose|AutoNew|Auto_Open|Auto_Close|Auto_Activate|Document_Open|DocumentOpen|Document_New|Document_Close|"
    r"Workbook_Open|Workbook_Activate|Workbook_BeforeClose|Worksheet_Activate|Presentation_Open)\b"
)
MACRO_RULES = {
    "runs_programs": r"(?i)\bShell\b|WScript\.Shell|\.Run\b|\.Exec\b|ShellExecute|Win32_Process|CreateProcess", "creates_objects": r"(?i)\bCreateObject\b|\bGetObject\b",
    "downloads_files": r"(?i)URLDownloadToFile|XMLHTTP|WinHttp|MSXML2|ADODB\.Stream|InternetOpen|DownloadFile|DownloadString|Net\.WebClient|\bBITS\b",
    "command_line_tools": r"(?i)powershell|cmd(?:\.exe)?\s*/c|mshta|wscript|cscript|regsvr32|rundll32|certutil|bitsadmin", "reads_environment": r"(?i)\bEnviron\b",
    "native_api_or_shellcode": r"(?i)VirtualAlloc|RtlMoveMemory|CreateThread|WriteProcessMemory|CallWindowProc|EnumSystemLocales",
}


def macro_source_signals(source: Column) -> Column:
    """Signals of decoded macro text."""
    from lurewatch.functions.text import keyword_hits, urls_from_text

    auto = F.array_sort(F.array_distinct(F.regexp_extract_all(source, F.lit(AUTORUN), F.lit(1))))
    bad = keyword_hits(source, MACRO_RULES)
    urls = F.size(urls_from_text(source)) > 0
    starts, uses = F.size(auto) > 0, F.size(bad) > 0
    listed, used = F.array_join(auto, ", "), F.when(uses, F.array_join(bad, ", ")).otherwise("embedded URLs")
    return _found(
        (starts & (uses | urls), signal("high", "vba_autoexec_suspicious", F.concat(F.lit("Runs on opening ("), listed, F.lit(") and uses "), used))), (starts & ~uses & ~urls, signal("medium", "vba_autoexec", F.concat(F.lit("Runs on opening: "), listed))),
        (~starts & uses, signal("medium", "vba_suspicious_keywords", F.concat(F.lit("Uses "), used))), (F.regexp_count(source, F.lit(r"(?i)\bChrW?\s*\(")) > 30, signal("medium", "vba_obfuscated_strings", "Builds text from many character codes.")),
    )
