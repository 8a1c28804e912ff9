"""Secret scan: pattern spans, told apart by how many owners share a value, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lurewatch.llm.common import before_each, bind, materialize, table
from lurewatch.llm.graph import join_spread

#: kind, pattern, group that holds the value, fewest characters of the value, base kind. Order breaks ties of start.
KINDS = (
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    ("access", r"AKIA[A-Z0-9]+", 0, 18, True),
    ("hex", r"[0-9a-f]{16,}", 0, 16, True),
    ("prefixed", r"\b(gh[pousr]_|xox[abprs]-|sk_live_|glpat-)[A-Za-z0-9_-]{16,}", 0, 20, False),
    ("userinfo", r"[a-z][a-z0-9+.-]{1,15}://[^\x20\x09-\x0D/:@]{1,64}:([^\x20\x09-\x0D/@]{6,128})@", 1, 6, False),
    ("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", 0, 20, False),
)
#: A value that so many owners share is a copied example.
EXAMPLE_OWNERS = 3
#: A value looks live if it has so many different characters, with digits among them.
LIVE_VARIETY = 8
#: Fewest different characters of a value that is hidden, by kind; of the kinds not listed every value is.
#: Of a password in a URL it is a quarter of its length, from 2 to LIVE_VARIETY.
HIDE_VARIETY = {"hex": 2, "userinfo": None}
_FOUND = "array<struct<start:bigint,rank:int,end:bigint,kind:string,base:boolean,value_hash:string,looks_live:boolean,to_hide:boolean>>"


def _sum(items: Column) -> Column:
    return F.aggregate(items, F.lit(0).cast("long"), lambda a, x: a + x)


def find(text: Column) -> Column:
    """All spans of one text (whole matches; code points, end exclusive), by start, then kind as listed.

    Leftmost non-overlapping matches per kind. A null text has none. Positions come from the text between the
    matches, so that no user function is needed; lengths are summed block by block, so that very many hits stay cheap.
    """
    t = F.coalesce(text, F.lit(""))
    per_kind = []
    for rank, (kind, pattern, group, least, base) in enumerate(KINDS):
        hits = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
        values = F.regexp_extract_all(t, F.lit(pattern), F.lit(group)) if group else hits
        row = F.struct(hits.alias("hits"), values.alias("values"), F.split(t, pattern, -1).alias("gaps"))
        found = bind(row, _spans_of(rank, kind, least, base))
        per_kind.append(F.when(t.rlike(pattern), found).otherwise(F.array().cast(_FOUND)))
    return F.array_sort(F.concat(*per_kind))


def _spans_of(rank: int, kind: str, least: int, base: bool):
    def one(x: Column, before: Column, hit: Column, i: Column) -> Column:
        start = F.get(before, i) + F.char_length(F.get(x["gaps"], i))
        value = F.get(x["values"], i)
        variety = F.size(F.array_distinct(F.split(value, "")))
        live = (variety >= LIVE_VARIETY) & value.rlike("[0-9]") | F.lit(kind == "pem")
        quarter = F.least(F.greatest(F.ceil(F.char_length(value) / 4), F.lit(2)), F.lit(LIVE_VARIETY))
        hide = variety >= (HIDE_VARIETY[kind] or quarter) if kind in HIDE_VARIETY else F.lit(True)
        return F.struct(
            start.alias("start"), F.lit(rank).alias("rank"), (start + F.char_length(hit)).alias("end"), F.lit(kind).alias("kind"), F.lit(base).alias("base"),
            F.sha2(value, 256).alias("value_hash"), live.alias("looks_live"), hide.alias("to_hide"), F.char_length(value).alias("n"),
        )

    def spans(x: Column) -> Column:
        pairs = F.zip_with(F.slice(x["gaps"], F.lit(1), F.size(x["hits"])), x["hits"], lambda g, h: (F.char_length(g) + F.char_length(h)).cast("long"))
        every = bind(before_each(pairs, _sum), lambda before: F.transform(x["hits"], lambda hit, i: one(x, before, hit, i)))
        found = F.filter(every, lambda s: s["n"] >= least)
        return F.transform(found, lambda s: F.struct(*[s[c].alias(c) for c in ("start", "rank", "end", "kind", "base", "value_hash", "looks_live", "to_hide")]))

    return spans


def ownership(found: DataFrame) -> DataFrame:
    """value_hash, n_repos, n_owners over the whole corpus; from columns value_hash, owner, repo.

    Distinct pairs are formed first, so a value that a third of all rows hold is reduced before each shuffle.
    """
    pairs = found.select("value_hash", "owner", "repo").distinct()
    owners = pairs.groupBy("value_hash", "owner").agg(F.count(F.lit(1)).alias("n"))
    return owners.groupBy("value_hash").agg(F.sum("n").alias("n_repos"), F.count(F.lit(1)).alias("n_owners"))


def copies_as_one(found: DataFrame) -> DataFrame:
    """value_hash, owner, repo with one row per value and text (column copy): a text copied word for word has one owner, its least."""
    one = found.groupBy("value_hash", "copy").agg(F.min("owner").alias("owner"), F.min("repo").alias("repo"))
    return one.select("value_hash", "owner", "repo")


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", repo: str = "doc_id", owner: str = "source", whole: bool = False, one_of_copies: bool = False) -> DataFrame:
    """One row per input row: key, found (find()) and secrets: found with n_repos, n_owners, class and hide.

    Rows are told apart by place, so spans of one never meet another's. class is `example` if EXAMPLE_OWNERS owners or more share the value, else `live` if it looks live, else
    `weak`. hide is set for all but examples and, of kinds that match much else, values of too little variety
    (HIDE_VARIETY). A null owner or repository counts as one of its own. Rows that share a key keep their own spans and
    share the counts. A text without spans has empty arrays; an empty table gives an empty table. With `whole`, a
    struct `row` holds all columns of the input row. With `one_of_copies`, equal texts count as one repository of one
    owner.
    """
    more = [F.xxhash64(text).alias("copy")] if one_of_copies else []
    more += [F.struct(*docs.columns).alias("row")] if whole else []
    rows = docs.select(F.col(key).alias("key"), F.col(repo).alias("repo"), F.col(owner).alias("owner"), find(F.col(text)).alias("found"), *more)
    rows = materialize(rows.withColumn("place", F.monotonically_increasing_id()), "secrets")
    some = rows.filter(F.size("found") > 0)
    values = F.transform("found", lambda s: s["value_hash"])
    hits = some.select("place", "repo", "owner", *(["copy"] if one_of_copies else []), F.posexplode(values).alias("pos", "value_hash"))
    shared = ownership(copies_as_one(hits) if one_of_copies else hits)
    counted = join_spread(hits.select("place", "pos", "value_hash"), shared, "value_hash", "place")
    of_row = counted.groupBy("place").agg(F.array_sort(F.collect_list(F.struct("pos", "n_repos", "n_owners"))).alias("shared"))

    def judged(s: Column, i: Column) -> Column:
        of = F.get("shared", i)
        kind = F.when(of["n_owners"] >= EXAMPLE_OWNERS, "example").when(s["looks_live"], "live").otherwise("weak")
        hide = (of["n_owners"] < EXAMPLE_OWNERS) & s["to_hide"]
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["base"].alias("base"), of["n_repos"].alias("n_repos"), of["n_owners"].alias("n_owners"), kind.alias("class"), hide.alias("hide"))

    # Only rows with spans meet the counts; the others need no shuffle.
    none = F.array().cast("array<struct<pos:int,n_repos:bigint,n_owners:bigint>>")
    out = some.join(of_row, "place").unionByName(rows.filter(F.size("found") == 0).withColumn("shared", none))
    return out.select(F.col("key").alias(key), "found", F.transform("found", judged).alias("secrets"), *(["row"] if whole else []))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _count(field: str, value: str) -> Column:
    return F.size(F.filter("secrets", lambda s: s[field] == value)).cast("long").alias(f"n_{value}")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans and counts of every document. A text copied word for word into several sources has one owner."""
    out = scan(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), one_of_copies=True)
    kinds = [_count("kind", k) for k in ("assign", "access", "hex")]
    classes = [_count("class", k) for k in ("live", "example")]
    return out.select("doc_id", *kinds, F.sha2(_joined(F.filter("secrets", lambda s: s["base"])), 256).alias("base_sha256"), _joined(F.col("secrets")).alias("spans"), *classes)


def redact(text: Column, spans: Column, mark: str = "<SECRET>") -> Column:
    """Replaces the spans (sorted by start, overlaps allowed) of a text by a mark."""
    most = lambda x: F.coalesce(F.array_max(x), F.lit(0).cast("long"))

    def cut(chars: Column, ends: Column, reached: Column) -> Column:
        part = lambda a, b: F.array_join(F.slice(chars, (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int")), "")
        pieces = F.transform(spans, lambda s, i: F.when(s["start"] >= F.get(reached, i), F.concat(part(F.get(reached, i), s["start"]), F.lit(mark))).otherwise(""))
        return F.concat(F.array_join(pieces, ""), part(most(ends), F.size(chars)))

    ends = F.transform(spans, lambda s: s["end"])
    return bind(F.split(text, ""), lambda chars: bind(ends, lambda e: bind(before_each(e, most), lambda reached: cut(chars, e, reached))))


def hide_live_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: values of few owners are replaced by a mark (see `hide` of scan()); all documents stay.

    Every row is cut by its own spans, whatever its id. A text copied into many sources is no example. All columns stay,
    whatever their names; only `text`, and `n_chars` where there is one, change. An empty table gives an empty one.
    """
    out = scan(docs, whole=True, one_of_copies=True).select("row", F.filter("secrets", lambda s: s["hide"]).alias("_hide"))
    hidden = F.size("_hide") > 0
    new = {"text": F.when(hidden, redact(F.col("row.text"), F.col("_hide"))).otherwise(F.col("row.text")).alias("text")}
    out = out.select(F.struct(*[new.get(c, F.col("row")[c].alias(c)) for c in docs.columns]).alias("row"), hidden.alias("hidden"))
    chars = F.when(F.col("hidden"), F.char_length("row.text").cast("long")).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None
    return out.select(*[(chars if c == "n_chars" else F.col("row")[c]).alias(c) for c in docs.columns])


def _sql() -> str:
    parts = []
    for rank, (kind, pattern, group, least, base) in enumerate(KINDS):
        p = pattern.replace("'", "''")
        parts.append(f"""
  SELECT r, doc_id, source, copy, {rank} AS rank, '{kind}' AS kind, {str(base).lower()} AS base, v[i] AS value,
         list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: length(x))), 0) AS s, length(h[i]) AS n, {least} AS least
  FROM (SELECT r, doc_id, source, copy, h, v, g, unnest(range(1, len(h) + 1)) AS i FROM (
    SELECT r, doc_id, source, copy, regexp_extract_all(text, '{p}', 0) AS h, regexp_extract_all(text, '{p}', {group}) AS v, string_split_regex(text, '{p}') AS g FROM d))""")
    one = "kind || ':' || s::BIGINT || ':' || (s + n)::BIGINT"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text, md5(coalesce(text, '')) AS copy FROM documents),
f AS (SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE length(value) >= least),
o AS (SELECT value, count(DISTINCT coalesce(source, chr(0))) AS owners FROM (SELECT value, copy, min(source) AS source FROM f GROUP BY value, copy) GROUP BY value),
j AS (SELECT f.*, owners, len(list_distinct(string_split(value, ''))) >= {LIVE_VARIETY} AND regexp_matches(value, '[0-9]') OR kind = 'pem' AS live FROM f JOIN o USING (value)),
a AS (SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
             string_agg({one}, ',' ORDER BY s, rank) FILTER (base) AS base_spans, string_agg({one}, ',' ORDER BY s, rank) AS spans,
             count(*) FILTER (owners < {EXAMPLE_OWNERS} AND live) AS n_live, count(*) FILTER (owners >= {EXAMPLE_OWNERS}) AS n_example FROM j GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base_spans, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
FROM d LEFT JOIN a USING (r)
"""


QUERIES = {"op8_secret_scan": op8_secret_scan}
ORACLES = {"op8_secret_scan": _sql()}
