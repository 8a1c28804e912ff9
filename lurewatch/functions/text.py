"""Column functions over mail text: indicators, addresses, authentication results. Built-in expressions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hosts, suffixes and prefixes that are not indicators.
COMMON_DOMAINS = ("gmail.com", "google.com", "googlemail.com", "w3.org")
FILE_SUFFIXES = "exe doc docx pdf xls xlsx ppt pptx zip rar js vbs bat scr jar png jpg jpeg gif txt csv html htm msi dll ps1 hta lnk iso 7z".split()
PRIVATE_PREFIXES = ("10.", "172.16.", "172.17.", "172.18.", "172.19.", "172.2", "172.30.", "172.31.", "192.168.", "127.")
BOILERPLATE_HOSTS = (
    "schemas.openxmlformats.org schemas.microsoft.com purl.org www.w3.org w3.org ns.adobe.com www.adobe.com schemas.xmlsoap.org "
    "www.openoffice.org openoffice.org xmlns.com www.xmlsoap.org docs.oasis-open.org relaxng.org www.iana.org schemas.android.com "
    "ns.useplus.org www.npes.org purl.oclc.org"
).split()

URL = r"""(?iU)\bh(?:xx|tt)ps?://[^\s\[\]<>"']+"""
IPV4 = r"(?U)\b(?:\d{1,3}\.){3}\d{1,3}\b"
#: Labels are counted, so that a long run of them cannot exhaust the stack of the regex engine.
DOMAIN = r"(?U)\b(?:[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?\.){1,126}[a-zA-Z]{2,}\b"
MAX_SCAN, MAX_URLS = 4 << 20, 25


def bind(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with the value worked out once for all its uses: a lambda over a one-element array names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def html_to_text(html: Column) -> Column:
    """Tags become a space; quoted link targets follow under a heading, if there are any."""
    links = _all(html, r"""(?i)href\s*=\s*["']([^"']+)["']""", 1)
    tail = F.when(F.size(links) > 0, F.concat(F.lit("\n\nLinks:\n"), F.array_join(links, "\n"))).otherwise("")
    return F.concat(F.regexp_replace(html, "<[^<>]+>", " "), tail)


def select_body(parts: Column) -> Column:
    """Body of a mail from its parts (array of structs mime, text): all plain parts, else all HTML parts as text."""
    of = lambda mime: F.transform(F.filter(parts, lambda p: p["mime"] == mime), lambda p: p["text"])
    plain = of("text/plain")
    return F.when(F.size(plain) > 0, F.array_join(plain, "\n")).otherwise(F.array_join(F.transform(of("text/html"), html_to_text), "\n"))


def refang(text: Column) -> Column:
    """Undoes defanging; only a lower-case `xx` becomes `tt`."""
    out = F.regexp_replace(text, r"([hH])xx([pP][sS]?://)", "$1tt$2")
    for a, b in (("[.]", "."), ("(.)", "."), ("[:]", ":"), ("[@]", "@")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def strip_trailing(url: Column) -> Column:
    """Drops closing punctuation, but not a bracket that the URL itself opened."""
    tail = F.split(F.reverse(F.regexp_extract(url, r"""[.,;:!?)\]}>'"]*$""", 0)), "")
    opened, closed = F.regexp_count(url, F.lit(r"\(")), F.regexp_count(url, F.lit(r"\)"))
    start = F.struct(closed.alias("closed"), F.lit(0).alias("cut"), F.lit(False).alias("done"))

    def step(a: Column, c: Column) -> Column:
        stop = a["done"] | (c == "") | ((c == ")") & (opened > a["closed"]))
        return F.struct((a["closed"] - F.when(~stop & (c == ")"), 1).otherwise(0)).alias("closed"), (a["cut"] + F.when(stop, 0).otherwise(1)).alias("cut"), stop.alias("done"))

    return F.substr(url, F.lit(1), F.char_length(url) - F.aggregate(tail, start, step, lambda a: a["cut"]))


def _urls(clean: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(_all(clean, URL), strip_trailing)))


def extract_urls(text: Column) -> Column:
    """Distinct URLs of a text, defanged ones included, sorted by code point."""
    return _urls(refang(text))


def url_host(url: Column) -> Column:
    """Authority up to the first colon, lower-cased: user info before a host is taken for the host, as given."""
    return F.lower(F.regexp_extract(url, r"^[^:/?#]+://([^/?#:]*)", 1))


def _domains(clean: Column, urls: Column) -> Column:
    """Hosts of the URLs and dotted names in the text, without common hosts, addresses and plain file names."""
    names = F.transform(_all(clean, DOMAIN), lambda d: F.lower(d))
    names = F.filter(names, lambda d: ~(F.regexp_count(d, F.lit(r"\.")).eqNullSafe(1) & F.substring_index(d, ".", -1).isin(FILE_SUFFIXES)))
    both = F.array_union(F.transform(urls, url_host), names)
    return F.array_sort(F.filter(both, lambda d: (d != "") & ~d.isin(*COMMON_DOMAINS) & ~d.rlike(r"^(?:\d{1,3}\.){3}\d{1,3}$")))


def extract_domains(text: Column, urls: Column) -> Column:
    """Hosts of the URLs, and dotted names of the whole text that are no file names; sorted distinct."""
    return _domains(refang(text), urls)


def _ips(clean: Column) -> Column:
    def public(ip: Column) -> Column:
        hit = F.lit(False)
        for prefix in PRIVATE_PREFIXES:
            hit = hit | ip.startswith(prefix)
        return ~hit

    return F.array_sort(F.array_distinct(F.filter(_all(clean, IPV4), public)))


def extract_ips(text: Column) -> Column:
    """Dotted quads outside the private prefixes, whatever their numbers; sorted distinct."""
    return _ips(refang(text))


def _hashes(clean: Column) -> Column:
    found = F.array_union(_all(clean, r"(?U)\b[a-fA-F0-9]{64}\b"), _all(clean, r"(?U)\b[a-fA-F0-9]{40}\b"))
    return F.array_sort(F.array_union(found, _all(clean, r"(?U)\b[a-fA-F0-9]{32}\b")))


def extract_hashes(text: Column) -> Column:
    """Whole words of 64, 40 or 32 hexadecimal digits, case kept; sorted distinct."""
    return bind(refang(text), _hashes)


def sender_domain(sender: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(sender, F.lit("")), r"(?U)@([\w.-]+)", 1))


#: A quoted string, and a comment (comments in it to a depth of three); possessive, so long headers stay linear.
_QUOTED = r'"(?:[^"\\]|\\.)*+"'
_COMMENT = r"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*+\))*+\))*+\)"


def sender_address(sender: Column) -> Column:
    """The address of a sender, lower-cased: of `Name <address>`, `address (Name)` or the address alone; empty for null.

    Quoted strings may hold any character, comments are left out, and space around dots and the at sign is. Several
    addresses, or text behind the brackets, give an empty one; text without an at sign gives its first word.
    """
    s = F.regexp_replace(F.coalesce(sender, F.lit("")), rf"(?s)(\\.|{_QUOTED})|{_COMMENT}", "$1")  # an escape as one, so that no quote is tried twice
    within = lambda chars: rf"(?:[^\"{chars}]|{_QUOTED})*+"
    named = rf"(?s)^{within('<>,;@')}<({within('<>,;')})>?\s*$"
    bare = rf"(?s)^\s*({within('<>,;')}),?\s*$"
    tight = lambda a: F.regexp_replace(F.trim(a), r"(?<!\s)\s*+([.@])\s*+", "$1")
    routed = F.regexp_replace(F.regexp_extract(s, named, 1), r"^\s*@[^:]*+:", "")
    alone = F.trim(F.regexp_extract(s, bare, 1))
    alone = F.when(F.contains(alone, F.lit("@")), tight(alone)).otherwise(F.regexp_extract(alone, r"^\S*+", 0))
    return F.lower(F.when(s.rlike(named), tight(routed)).otherwise(alone))


def extract_iocs(body: Column, sender: Column) -> Column:
    """Struct of urls, domains, ips, hashes, sender_domain. The text is refanged once, and its URLs are drawn once."""

    def lists(clean: Column, urls: Column) -> Column:
        return F.struct(urls.alias("urls"), _domains(clean, urls).alias("domains"), _ips(clean).alias("ips"), _hashes(clean).alias("hashes"), sender_domain(sender).alias("sender_domain"))

    return bind(refang(body), lambda clean: bind(_urls(clean), lambda urls: lists(clean, urls)))


def is_empty(iocs: Column) -> Column:
    """No indicator at all; the sender's domain does not count."""
    return (F.size(iocs["urls"]) + F.size(iocs["domains"]) + F.size(iocs["ips"]) + F.size(iocs["hashes"])) == 0


def parse_auth_results(header: Column) -> Column:
    """Map of the first spf, dkim and dmarc result; a check that is not named stays absent."""
    h = F.coalesce(header, F.lit(""))
    pattern = r"(?i)\b(spf|dkim|dmarc)=([a-z]+)"
    keys, values = F.transform(_all(h, pattern, 1), lambda k: F.lower(k)), F.transform(_all(h, pattern, 2), lambda v: F.lower(v))
    first = F.array_distinct(keys)
    return F.map_from_arrays(first, F.transform(first, lambda k: F.get(values, (F.array_position(keys, k) - 1).cast("int"))))


def urls_from_text(text: Column) -> Column:
    """The first 25 URLs (sorted) of the first 4 Mi characters of a file's text, without boilerplate hosts."""
    def host(u: Column) -> Column:
        return F.lower(F.substring_index(F.substring_index(F.regexp_replace(u, "^.*?//", ""), "/", 1), ":", 1))

    urls = F.filter(_urls(refang(F.substr(text, F.lit(1), F.lit(MAX_SCAN)))), lambda u: ~host(u).isin(BOILERPLATE_HOSTS) & ~host(u).endswith(".w3.org"))
    return F.slice(urls, 1, MAX_URLS)


def keyword_hits(text: Column, rules: dict[str, str]) -> Column:
    """Labels of the rules (label -> pattern) that match, in the order of the rules."""
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(label)) for label, p in rules.items()]))


def parse_never_block(csv: Column) -> Column:
    parts = F.transform(F.split(F.coalesce(csv, F.lit("")), ","), lambda p: F.ltrim(F.lower(F.trim(p)), F.lit("@")))
    return F.filter(parts, lambda p: p != "")
