"""Indicators of mails joined with reputation feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurewatch.operators import skew
from lurewatch.sources.scratch import written

KINDS = ("urls", "domains", "ips", "hashes")
#: Look-ups per mail and kind; URLs that also get a scan.
PER_KIND, SCANNED = 5, 2


def explode_iocs(mails: DataFrame, cap: int | None = PER_KIND) -> DataFrame:
    """email_id, kind, pos, indicator: the first `cap` of each list, cut before the lists are exploded."""
    lists = [F.struct(F.lit(k).alias("kind"), (F.slice(f"iocs.{k}", 1, cap) if cap else F.col(f"iocs.{k}")).alias("items")) for k in KINDS]
    kinds = mails.select("email_id", F.explode(F.array(*lists)).alias("l"))
    return kinds.select("email_id", F.col("l.kind").alias("kind"), F.posexplode("l.items").alias("pos", "indicator"))


def distinct_iocs(long: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """kind, indicator: one look-up each over the whole batch, without those a feed knows already."""
    out = long.select("kind", "indicator").distinct()
    return out.join(known, ["kind", "indicator"], "left_anti") if known is not None else out


def look_ups(known: DataFrame, about: int, reputation: DataFrame, ip_abuse: DataFrame | None = None, url_scan: DataFrame | None = None) -> DataFrame:
    """kind, indicator and what the feeds know, a row for each distinct indicator. Each feed has a row per indicator.

    A feed may be far larger than the batch: it is cut to what the batch may ask for (see skew.prefilter()) before it
    is shuffled. about: number of indicators, as a guess.
    """
    keys = ["kind", "indicator"]
    out = known.join(skew.prefilter(reputation, known, keys, about), keys, "left")
    if ip_abuse is not None:
        abuse = ip_abuse.select(F.lit("ips").alias("kind"), F.col("ip").alias("indicator"), F.struct("*").alias("abuse"))
        out = out.join(skew.prefilter(abuse, known, keys, about), keys, "left")
    if url_scan is not None:
        scan = url_scan.select(F.lit("urls").alias("kind"), F.col("url").alias("indicator"), F.struct("*").alias("scan"))
        out = out.join(skew.prefilter(scan, known, keys, about), keys, "left")
    return out.withColumn("found", F.coalesce("found", F.lit(False)))


def enrich_long(long: DataFrame, reputation: DataFrame, ip_abuse: DataFrame | None = None, url_scan: DataFrame | None = None) -> DataFrame:
    """Adds the feeds' columns to each indicator (struct columns abuse and scan for the other two feeds); one that the feed lacks has found = false.

    Feeds are met once for each distinct indicator, and the results come back to the mails. A campaign's URL may stand
    in very many mails: indicators of a large share of all look-ups are found by a sketch and their rows are not
    shuffled. Reads `long` several times: hand in a written table.
    """
    keys = ["kind", "indicator"]
    profile = skew.Profile(long, keys)
    found = look_ups(distinct_iocs(long), profile.distinct, reputation, ip_abuse, url_scan)
    out = skew.join_keyed(long, found, profile).withColumn("found", F.coalesce("found", F.lit(False)))
    return out if url_scan is None else out.withColumn("scan", F.when(F.col("pos") < SCANNED, F.col("scan")))


def enrich_mails(mails: DataFrame, reputation: DataFrame, ip_abuse: DataFrame | None = None, url_scan: DataFrame | None = None, long: DataFrame | None = None) -> DataFrame:
    """email_id, enrichment: per kind a map from indicator to result; a mail without indicators has a null map for each kind.

    long: the mails' indicators (see explode_iocs()), where they are at hand already.
    """
    rows = enrich_long(written(explode_iocs(mails), "long") if long is None else long, reputation, ip_abuse, url_scan)
    value = F.struct(*[c for c in rows.columns if c not in ("email_id", "kind", "pos", "indicator")])
    maps = [F.map_from_entries(F.collect_list(F.when(F.col("kind") == k, F.struct("indicator", value.alias("value"))))).alias(k) for k in KINDS]
    grouped = rows.groupBy("email_id").agg(*maps)
    return mails.select("email_id").join(grouped, "email_id", "left").select("email_id", F.struct(*KINDS).alias("enrichment"))


def hit_counts(long: DataFrame) -> DataFrame:
    """email_id, n_lookups, n_found, n_malicious, n_suspicious."""
    positive = lambda c: F.count_if(F.col("found") & (F.col(c) > 0)).alias(f"n_{c}")
    return long.groupBy("email_id").agg(F.count(F.lit(1)).alias("n_lookups"), F.count_if("found").alias("n_found"), positive("malicious"), positive("suspicious"))


def merge_file_urls(mails: DataFrame, file_urls: DataFrame) -> DataFrame:
    """email_id, urls, domains with what attachments hold in front.

    file_urls: email_id, pos (walk order), url. New URLs come first in walk order; the host of each new one goes to
    the front of the domains, so that the last comes first. Doing it twice changes nothing.
    """
    first = file_urls.groupBy("email_id", "url").agg(F.min("pos").alias("pos"))
    new = first.groupBy("email_id").agg(F.array_sort(F.collect_list(F.struct("pos", "url"))).alias("new"))
    out = mails.select("email_id", F.col("iocs.urls").alias("urls"), F.col("iocs.domains").alias("domains")).join(new, "email_id", "left")
    fresh = F.filter(F.coalesce(F.transform("new", lambda x: x["url"]), F.array().cast("array<string>")), lambda u: ~F.array_contains("urls", u))
    host = lambda u: F.lower(F.substring_index(F.substring_index(F.regexp_replace(u, "^.*?//", ""), "/", 1), ":", 1))
    out = out.withColumn("fresh", fresh)
    hosts = F.array_except(F.filter(F.transform("fresh", host), lambda h: h != ""), F.col("domains"))
    return out.select("email_id", F.concat("fresh", "urls").alias("urls"), F.concat(F.reverse(hosts), F.col("domains")).alias("domains"))


# --- raw feed documents ---

_STATS = "malicious bigint, suspicious bigint, harmless bigint, undetected bigint"
_SCHEMAS = {
    "reputation": f"data struct<attributes:struct<last_analysis_stats:struct<{_STATS.replace(' ', ':').replace(',:', ',')}>,reputation:bigint,popular_threat_classification:struct<suggested_threat_label:string>,type_description:string>>",
    "ip_abuse": "data struct<abuseConfidenceScore:bigint,totalReports:bigint,countryCode:string,isp:string,isTor:boolean>",
    "url_scan": "verdicts struct<overall:struct<malicious:boolean,score:bigint,categories:array<string>>>, page struct<url:string,domain:string>",
}


def read_reputation(raw: DataFrame, kind: str) -> DataFrame:
    """Flattens raw feed documents (columns indicator, body: JSON or null); a missing body is not found."""
    d = raw.withColumn("d", F.from_json("body", _SCHEMAS[kind]))
    c = F.col
    if kind == "reputation":
        stats = [F.when(c("found"), F.coalesce(c(f"d.data.attributes.last_analysis_stats.{k}"), F.lit(0))).alias(k) for k in ("malicious", "suspicious", "harmless", "undetected")]
        rest = [*stats, c("d.data.attributes.reputation").alias("reputation"), c("d.data.attributes.popular_threat_classification.suggested_threat_label").alias("threat_label"), c("d.data.attributes.type_description").alias("file_type")]
    elif kind == "ip_abuse":
        rest = [c("d.data.abuseConfidenceScore").alias("abuse_confidence_score"), c("d.data.totalReports").alias("total_reports"), c("d.data.countryCode").alias("country_code"), c("d.data.isp").alias("isp"), c("d.data.isTor").alias("is_tor")]
    else:
        rest = [F.coalesce("d.verdicts.overall.malicious", F.lit(False)).alias("malicious"), F.coalesce("d.verdicts.overall.score", F.lit(0)).alias("score"), F.coalesce("d.verdicts.overall.categories", F.array().cast("array<string>")).alias("categories"), c("d.page.url").alias("final_url"), c("d.page.domain").alias("final_domain")]
    return d.withColumn("found", c("body").isNotNull() & c("d").isNotNull()).select("indicator", "found", *rest)
