"""The attachment job: from files to kinds, signals, members, URLs and risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurewatch.functions import attachments as A
from lurewatch.functions import text as T
from lurewatch.operators import files as O
from lurewatch.sources.scratch import written

BINARY_KINDS = ("pe", "elf", "macho", "lnk", "onenote")
SIGNALS = f"array<{A.SIGNAL}>"


def _none() -> Column:
    return F.array().cast(SIGNALS)


def own_findings(files: DataFrame) -> DataFrame:
    """email_id, file_path, ext, found, urls: what the bytes and the name of each file give by themselves.

    Needs email_id, file_path, name, kind, data. Bytes go no further than this projection.
    """
    kind, ext = F.col("kind"), F.col("ext")
    rows = files.select("email_id", "file_path", "name", "kind", "data", A.file_extension(F.col("name")).alias("ext"))
    is_script = kind.isin("text", "unknown") & ext.isin([*A.SCRIPT_EXT, "hta"])
    is_page = kind.isin("html", "svg")
    is_binary = kind.isin(*BINARY_KINDS) | ((kind == "unknown") & ~is_script)
    rows = rows.select(
        "email_id", "file_path", "name", "kind", "ext", F.when(is_page | is_script, A.decode_text(F.col("data"))).alias("text"),
        F.when(is_binary, F.array_join(A.binary_strings(F.col("data")), "\n")).alias("strings"),
        O.pdf_text(F.when(kind == "pdf", F.col("data"))).alias("pdf"), F.when(kind == "rtf", A.rtf_signals(F.col("data"))).alias("rtf"), is_script.alias("is_script"),
    )
    text, strings = F.col("text"), F.col("strings")
    hits = F.coalesce(T.keyword_hits(strings, A.BINARY_RULES), F.array().cast("array<string>"))
    told = F.array_join(hits, ", ")
    commands = A._found(
        ((kind == "lnk") & (F.size(hits) > 0), A.signal("high", "shortcut_runs_commands", F.concat(F.lit("Shortcut names "), told))),
        ((kind == "onenote") & ((F.size(hits) > 0) | (F.size(A.runnable_names(strings)) > 0)), A.signal("high", "onenote_embedded_launcher", "Notebook names runnable files or command-line tools.")),
    )
    harvested = F.concat(F.regexp_extract_all(text, F.lit(A.FORM_ACTION), F.lit(1)), F.regexp_extract_all(text, F.lit(A.SOURCES), F.lit(1)), T.urls_from_text(text))
    urls = F.when(is_page, T.urls_from_text(F.array_join(harvested, "\n"))).when(F.col("is_script"), T.urls_from_text(text)).when(kind == "pdf", T.urls_from_text(F.array_join(A.pdf_link_targets(F.col("pdf")), "\n"))).otherwise(T.urls_from_text(strings))
    by_content = F.when(is_page, A.html_signals(text, kind == "svg")).when(F.col("is_script"), A.script_signals(text, ext)["signals"].cast(SIGNALS)).when(kind == "pdf", A.pdf_features(F.col("pdf"))["signals"]).when(kind == "rtf", F.col("rtf")).otherwise(_none())
    found = F.concat(A.filename_signals(F.col("name")), A.kind_signals(kind), by_content, commands)
    return rows.select("email_id", "file_path", "kind", "ext", found.alias("found"), F.coalesce(urls, F.array().cast("array<string>")).alias("urls"))


def container_findings(files: DataFrame) -> DataFrame:
    """email_id, file_path, of_container, inner_urls, package of ZIP files, packages and attached mails. Needs email_id, file_path, name, kind, data."""
    members = O.expand(files)
    names = files.select("email_id", F.col("file_path").alias("parent_path"), A.file_extension(F.col("name")).alias("ext"))
    by_zip = O.archive_signals(members).unionByName(O.ooxml_signals(members, names), allowMissingColumns=True)
    by_zip = by_zip.groupBy("email_id", F.col("parent_path").alias("file_path")).agg(F.flatten(F.collect_list("signals")).alias("of_zip"), F.flatten(F.collect_list("link_urls")).alias("link_urls"), F.max("package").alias("package"))
    mails = O.inner_mail(files).select("email_id", "file_path", T.urls_from_text(F.col("body")).alias("inner_urls"))
    of = files.filter(F.col("kind").isin("zip", "eml")).select("email_id", "file_path", "kind")
    out = of.join(by_zip, ["email_id", "file_path"], "left").join(mails, ["email_id", "file_path"], "left")
    unread = A._found(((F.col("kind") == "zip") & F.col("of_zip").isNull(), A.signal("low", "unparseable_zip", "Looks like an archive that could not be read, or holds nothing.")))
    urls = F.coalesce("link_urls", "inner_urls")
    return out.select("email_id", "file_path", F.concat(F.coalesce("of_zip", _none()), unread).alias("of_container"), F.when(F.size(urls) > 0, urls).otherwise(F.col("inner_urls")).alias("inner_urls"), "package")


def analyze_attachments(files: DataFrame, depth: int = O.MAX_DEPTH) -> DataFrame:
    """One row per file, members included: email_id, file_path, depth, name, kind, ext, size, sha256, reason, risk, signals, urls.

    files: email_id, file_path, name, content_type, data, and reason (see files.admit_analysis()), which may be null. A
    file with a reason is listed and not analysed. signals is ordered by severity, then by first sight, each name
    once; risk is the highest severity of a file and of all below it; urls are those of its content, at most 25. What
    Office, Java and Android packages hold is judged with the package and not listed. Unpacked files are written to the
    shared folder once, so that no archive is opened for each use of them.
    """
    kept = files.filter("reason IS NULL")
    every = written(O.analyze_nested(kept, depth), "unpacked")
    left = files.filter("reason IS NOT NULL").select("email_id", "file_path", F.lit(0).alias("depth"), "name", F.lit("unknown").alias("kind"), F.octet_length("data").cast("long").alias("size"), F.lit(None).cast("binary").alias("data"), "reason")
    rows = every.filter("reason IS NULL AND data IS NOT NULL")
    key = ["email_id", "file_path"]
    containers = written(container_findings(rows), "containers")
    found = own_findings(rows).join(containers, key, "left")
    content = F.concat("found", F.coalesce("of_container", _none()))
    macro = F.exists("so_far", lambda s: F.contains(s["signal"], F.lit("macro")) | s["signal"].startswith("vba"))
    script = F.exists("so_far", lambda s: s["signal"] == "script_attachment")
    found = found.select(*key, "kind", "ext", content.alias("so_far"), F.slice(F.array_distinct(F.concat("urls", F.coalesce("inner_urls", F.array().cast("array<string>")))), 1, T.MAX_URLS).alias("urls"))
    found = written(found.select(*key, "ext", "urls", F.concat("so_far", A.extension_signals(F.col("kind"), F.col("ext"), script, macro)).alias("signals")), "found")
    steps = F.split("file_path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(steps) - 1), lambda k: F.array_join(F.slice(steps, F.lit(1), k), "/"))
    packed = containers.filter("package <> 'zip'").select("email_id", F.col("file_path").alias("above"))
    hidden = every.filter("depth > 0").select(*key, F.explode(above).alias("above")).join(packed, ["email_id", "above"]).select(*key).distinct()
    found = found.join(hidden, key, "left_anti")
    long = found.select(*key, F.posexplode("signals").alias("seq", "s")).select(*key, "seq", "s.severity", "s.signal", "s.detail")
    best = O.dedupe_signals(long)
    listed = best.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("rank", "severity", "signal", "detail"))).alias("l"))
    listed = listed.select(*key, F.transform("l", lambda x: F.struct(x["severity"].alias("severity"), x["signal"].alias("signal"), x["detail"].alias("detail"))).alias("signals"))
    base = every.unionByName(left).select(*key, "depth", A.safe_filename(F.col("name")).alias("name"), "kind", "size", F.sha2("data", 256).alias("sha256"), "reason")
    base = base.join(hidden, key, "left_anti")
    risk = O.rollup_risk(base, best)
    out = base.join(found.select(*key, "ext", "urls"), key, "left").join(listed, key, "left").join(risk, key, "left")
    return out.select(*key, "depth", "name", "kind", "ext", "size", "sha256", "reason", "risk", F.coalesce("signals", _none()).alias("signals"), F.coalesce("urls", F.array().cast("array<string>")).alias("urls"))
