"""MinHash near-duplicates: one-permutation hashing, optimal densification, banded buckets, star-shaped candidates."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lurewatch.llm.common import materialize, table
from lurewatch.llm.graph import connected_components, join_spread
from lurewatch.llm.tokens import powers

#: Words of a shingle for general use, and least similarity in per cent.
WIDTH, PERCENT = 5, 80
#: Bands and rows of a band: a pair of similarity 0.8 meets in no bucket with a chance of 3 in a million.
BANDS, ROWS = 32, 5
BINS = BANDS * ROWS
#: A candidate edge holds from this estimated similarity on, and a pair is compared if its estimate is not further than
#: SLACK below the limit; sets under SURE shingles always pass both.
LOOSE, SLACK, SURE = 0.5, 0.16, 64
#: Documents of a block in which links are confirmed.
BLOCK = 256
#: Bands from whose buckets the centre of a star is chosen.
RANKING_BANDS = 8
#: Bytes of text that are hashed at a time; a longer text is hashed alone.
CHUNK = 1 << 17
#: Hashes that are sketched at a time.
PIECE = 1 << 16

_P = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes(data: bytes | np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of several texts laid end to end, and the number of words of each text."""
    raw = np.frombuffer(data, np.uint8) if isinstance(data, bytes) else data
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(ends), np.int64)
    inside = ~_SPACE[raw]
    cut = np.zeros(len(raw) + 1, bool)
    cut[0], cut[ends] = True, True
    begin = np.flatnonzero(inside & (cut[:-1] | ~np.r_[False, inside[:-1]]))
    stop = np.flatnonzero(inside & (cut[1:] | ~np.r_[inside[1:], False])) + 1
    up, down = powers(len(raw))
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((_LOWER[raw] + np.uint64(1)) * up[: len(raw)], out=total[1:])
    h = _mix((total[stop] - total[begin]) * down[begin])
    counts = np.diff(np.r_[0, np.searchsorted(begin, ends, "left")])
    return h, counts


def _new(x: np.ndarray) -> np.ndarray:
    """Where sorted values differ from those before them."""
    out = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=out[1:])
    return out


def shingle_sets(texts: list[bytes], width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer words has its whole sequence as one, one without words none."""
    at = 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and (stop == at or size + len(texts[stop]) <= CHUNK):
            size += len(texts[stop])
            stop += 1
        ends = np.cumsum([len(t) for t in texts[at:stop]])
        h, counts = word_hashes(b"".join(texts[at:stop]), ends)
        rolled = np.zeros(max(0, len(h) - width + 1), np.uint64)
        for k in range(width):
            rolled = rolled * np.uint64(_P) + h[k : k + len(rolled)]
        rolled = _mix(rolled)
        first, parts = 0, []
        fresh_from = np.zeros(len(rolled), bool)
        for n in counts.tolist():
            if n >= width:
                rolled[first : first + n - width + 1].sort()
                fresh_from[first] = True
            parts.append((first, n))
            first += n
        fresh = _new(rolled) | fresh_from
        for first, n in parts:
            if n >= width:
                own = slice(first, first + n - width + 1)
                yield rolled[own][fresh[own]]
            elif n:
                whole = np.uint64(n)
                for x in h[first : first + n]:
                    whole = whole * np.uint64(_P) + x
                yield _mix(np.array([whole]))
            else:
                yield np.zeros(0, np.uint64)
        at = stop


@cache
def _probes(attempts: int = 2048) -> np.ndarray:
    """The bin that an empty bin asks at each attempt: the same for every text."""
    x = _mix(np.arange(attempts * BINS, dtype=np.uint64) * np.uint64(_P) + np.uint64(7))
    return (x % np.uint64(BINS)).astype(np.int64).reshape(attempts, BINS)


def _pieces(sets: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Sets laid end to end, PIECE hashes or so at a time: the number of the first, which of the piece's sets each hash is of, the hashes."""
    at = 0
    while at < len(sets):
        stop, size = at, 0
        while stop < len(sets) and (stop == at or size + len(sets[stop]) <= PIECE):
            size += len(sets[stop])
            stop += 1
        yield at, np.repeat(np.arange(stop - at), [len(s) for s in sets[at:stop]]), np.concatenate(sets[at:stop])
        at = stop


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Densified one-permutation sketches (rows of BINS values) of non-empty sets.

    Hashes of a set are mixed and sorted: their upper halves name bins in rising order, and the first of a bin is its least.
    """
    out, empty = np.zeros((len(sets), BINS), np.uint32), np.ones((len(sets), BINS), bool)
    for i, row, s in _pieces(sets):
        at = (((s >> np.uint64(32)) * np.uint64(BINS)) >> np.uint64(32)).astype(np.int64) + (row + i) * BINS
        new = _new(at)
        out.ravel()[at[new]] = (s[new] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        empty.ravel()[at[new]] = False
    row, col = np.nonzero(empty)
    for probe in _probes():
        if not len(row):
            return out
        asked = probe[col]
        hit = ~empty[row, asked]
        out[row[hit], col[hit]] = out[row[hit], asked[hit]]
        row, col = row[~hit], col[~hit]
    for r, c in zip(row, col, strict=True):  # hardly ever: the next filled bin
        full = np.flatnonzero(~empty[r])
        out[r, c] = out[r, full[np.searchsorted(full, c) % len(full)]]
    return out


def _bytes(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def _digests(sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """Two digests of each non-empty set: sums of its hashes mixed once more, and of their squares."""
    for _, row, s in _pieces(sets):
        m, first = _mix(s ^ np.uint64(1)), np.flatnonzero(_new(row))
        yield from zip(*(np.add.reduceat(x, first).view(np.int64).tolist() for x in (m, m * m)), strict=True)


def signatures(docs: DataFrame, width: int = WIDTH, also: tuple[str, Callable[[], Callable[[list[bytes]], list[int]]]] | None = None) -> DataFrame:
    """From doc_id, text: doc_id, n (set size), d1, d2 (digest of the set), bands (bucket keys), sketch (a byte per bin).

    Further columns go along behind these; `also` names a last one (bigint) and makes, once a task, the function that
    draws it from texts.
    """
    more = [(f.name, f.dataType.simpleString()) for f in docs.schema.fields[2:]] + ([(also[0], "bigint")] if also else [])
    schema = ", ".join(["doc_id bigint, n bigint, d1 bigint, d2 bigint, bands array<bigint>, sketch binary", *(f"`{a}` {b}" for a, b in more)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        draw = also[1]() if also else None
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                texts = _bytes(batch.column(1))
                drawn = [pa.array(draw(texts), pa.int64())] if draw else []
                sets = list(shingle_sets(texts, width))
                full = [i for i, s in enumerate(sets) if len(s)]
                sk = sketches([sets[i] for i in full])
                key = np.zeros((len(full), BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
                for r in range(ROWS):
                    key = key * np.uint64(_P) + sk.reshape(-1, BANDS, ROWS)[:, :, r]
                key = _mix(key).view(np.int64)
                bands, small = [None] * len(sets), [None] * len(sets)
                for i, k, s in zip(full, key, sk.astype(np.uint8), strict=True):
                    bands[i], small[i] = k, s.tobytes()
                of = iter(_digests([sets[i] for i in full]))
                digest = list(zip(*[next(of) if len(s) else (None, None) for s in sets], strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), *[pa.array(d, pa.int64()) for d in digest], pa.array(bands, pa.list_(pa.int64())), pa.array(small, pa.binary()), *batch.columns[2:], *drawn], names=["doc_id", "n", "d1", "d2", "bands", "sketch", *(a for a, _ in more)])

    return docs.mapInArrow(run, schema)


def _stars(classes: DataFrame) -> DataFrame:
    """a, b: the members of every bucket joined to its centre, each pair once."""
    rows = classes.select("id", "rank", F.explode("bands").alias("key"))
    centres = rows.groupBy("key").agg(F.max(F.struct("rank", (-F.col("id")).alias("id"))).alias("c"), F.count(F.lit(1)).alias("size")).filter("size > 1").select("key", (-F.col("c.id")).alias("a"))
    return rows.join(centres, "key").filter("id <> a").select("a", F.col("id").alias("b")).distinct()


def _ranked(classes: DataFrame) -> DataFrame:
    """Adds rank: how many share buckets with a document. The text that others were made from shares most."""
    some = classes.select("id", F.explode(F.slice("bands", 1, RANKING_BANDS)).alias("key"))
    sizes = some.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    rank = some.join(sizes, "key").groupBy("id").agg(F.sum("size").alias("rank"))
    return classes.join(rank, "id", "left").withColumn("rank", F.coalesce("rank", F.lit(0)))


def _likely(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs whose sketches agree in LOOSE of the bins at least, or of which one set is small."""
    of = lambda c: classes.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}"))
    both = pairs.join(of("b"), "b").join(of("a"), "a").filter("2 * least(n_a, n_b) >= greatest(n_a, n_b)")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            a, b = (np.frombuffer(b"".join(x.column(c).to_pylist()), np.uint8).reshape(-1, BINS) for c in ("s_a", "s_b"))
            small = np.minimum(x.column("n_a").to_numpy(), x.column("n_b").to_numpy()) < SURE
            yield pa.RecordBatch.from_arrays([x.column("a"), x.column("b")], names=["a", "b"]).filter(pa.array(((a == b).mean(1) >= LOOSE) | small))

    return both.select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(run, "a bigint, b bigint")


def links_of(ids: list[int], sets: list[np.ndarray], labels: list[int], first: int | None, percent: int) -> list[tuple[int, int]]:
    """Exact links that join whatever is linked; pairs that are joined already (at first: of one label) are not compared."""
    place: dict[int, int] = {}
    root = [place.setdefault(x, i) for i, x in enumerate(labels)]

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out: list[tuple[int, int]] = []
    sizes = np.array([len(s) for s in sets])

    def compare(i: int, others: np.ndarray) -> None:
        a = sets[i]
        for j in others:
            if top(i) == top(j):
                continue
            b = sets[j]
            same = 0 if not len(a) else int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum())
            if 100 * same >= percent * (len(a) + len(b) - same):
                root[top(j)] = top(i)
                out.append((ids[i], ids[j]))

    def near(i: int, js: np.ndarray) -> np.ndarray:
        low, high = np.minimum(sizes[i], sizes[js]), np.maximum(sizes[i], sizes[js])
        return js[100 * low >= percent * high]

    everyone = np.arange(len(ids))
    if first is not None:
        compare(first, near(first, everyone[everyone != first]))
    sk = sketches(sets).astype(np.uint8) if len(ids) > 32 else None
    for i in everyone:
        tops = np.array([top(j) for j in everyone[i:]])
        if i == first or (tops == tops[0]).all():
            continue
        js = near(i, everyone[i:][tops != tops[0]])
        if sk is not None and len(js):
            js = js[((sk[js] == sk[i]).mean(1) >= percent / 100 - SLACK) | (np.minimum(sizes[js], sizes[i]) < SURE)]
        compare(i, js)
    return out


def _compared(texts: DataFrame, places: DataFrame, width: int, percent: int) -> DataFrame:
    """a, b: exact links among the documents that meet in a place.

    places: at (array of longs), part (of the place, array of longs), id, d1 (digest of the document's set), label, is_hub.
    texts: id, text. Where rows share an id, the digest tells which text is meant.
    """
    texts = texts.join(places.hint("merge"), "id")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        np.seterr(over="ignore")
        found: list[tuple[int, int]] = []
        for _, part in rows.groupby("part", sort=False):
            sets = list(shingle_sets([t.encode("utf-8", "surrogatepass") for t in part["text"]], width))
            of = iter(_digests([s for s in sets if len(s)]))
            meant = [len(s) > 0 and next(of)[0] == d for s, d in zip(sets, part["d1"], strict=True)]
            part = part[meant]
            part, sets = part.assign(k=range(len(part))).drop_duplicates(["id", "d1"]), [s for s, m in zip(sets, meant, strict=True) if m]
            hub = part["is_hub"].to_numpy()
            found += links_of(part["id"].tolist(), [sets[k] for k in part["k"]], part["label"].tolist(), int(hub.argmax()) if hub.any() else None, percent)
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return texts.select("at", F.concat_ws(":", "part").alias("part"), "id", "d1", "label", "is_hub", "text").groupBy("at").applyInPandas(run, "a bigint, b bigint")


def _longs(*values: Column | int) -> Column:
    return F.array(*[F.lit(v).cast("long") if isinstance(v, int) else v.cast("long") for v in values])


def _own_place(part: Column, n: int) -> Column:
    """A place for a part with fewer than BLOCK documents, beside other small ones."""
    return _longs(-1, F.pmod(F.xxhash64(part), F.lit(max(1, n // BLOCK))))


def _first_links(texts: DataFrame, of: DataFrame, width: int, percent: int) -> DataFrame:
    """Links inside the groups of candidates, each cut into blocks of about BLOCK; its best-connected document meets every block.

    of: id, d1, g, blocks, hub. A text is compared in one block, whatever the size of its group.
    """
    n = of.count()
    block = F.pmod(F.xxhash64("id"), F.col("blocks"))
    is_hub = F.col("id") == F.col("hub")
    rows = of.select("id", "d1", F.col("id").alias("label"), is_hub.alias("is_hub"), F.explode(F.when(is_hub, F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: _longs(F.col("g"), k))).otherwise(F.array(_longs(F.col("g"), block)))).alias("part"), "blocks")
    places = rows.select("id", "d1", "label", "is_hub", "part", F.when(F.col("blocks") == 1, _own_place(F.col("part"), n)).otherwise(F.col("part")).alias("at"))
    return _compared(texts, places, width, percent)


def _further_links(texts: DataFrame, large: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """Links between documents of large groups that the first links left in several components.

    large: id, g (group), label (component after the first links). The members of a group's main component meet all
    others, and the others one another, in blocks; members of the main component do not meet. Where this would copy
    texts more often than they have buckets, the same is done bucket by bucket, and only in buckets with several components.
    """
    def parts(rows: DataFrame, by: str) -> DataFrame:
        """by, main (label of the largest component), most (its size), rest (documents of the others); only where there are several."""
        per = rows.groupBy(by, "label").agg(F.count(F.lit(1)).alias("n"))
        out = per.groupBy(by).agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.max("n").alias("most"), (F.sum("n") - F.max("n")).alias("rest"))
        return out.filter("rest > 0").withColumns({"m": F.ceil(F.col("most") / BLOCK).cast("int"), "r": F.ceil(F.col("rest") / BLOCK).cast("int")})

    copies = F.col("most") * F.col("r") + F.col("rest") * (F.col("m") + F.col("r"))
    whole = parts(large, "g").select("g", (copies <= BANDS * (F.col("most") + F.col("rest"))).alias("whole"))
    rows = classes.select("id", "d1", "bands").join(join_spread(large, whole, "g", "id"), "id")
    rows = rows.select("id", "d1", "label", F.explode(F.when(F.col("whole"), F.array("g")).otherwise(F.col("bands"))).alias("key"))
    rows = materialize(join_spread(rows, parts(rows, "key").drop("most", "rest"), "key", "id"), "buckets")
    n = rows.count()
    m, r, h = F.col("m"), F.col("r"), F.xxhash64("id")
    pair = lambda i, j: _longs(F.col("key"), i, j)
    own = m + F.pmod(h, r).cast("int")
    of_main = F.transform(F.sequence(m, m + r - 1), lambda j: pair(F.pmod(h, m), j))
    of_rest = F.transform(F.filter(F.sequence(F.lit(0), m + r - 1), lambda k: k != own), lambda k: pair(F.least(k, own), F.greatest(k, own)))
    places = rows.select("id", "d1", "label", F.lit(False).alias("is_hub"), F.explode(F.when(F.col("label") == F.col("main"), of_main).otherwise(of_rest)).alias("part"), (m + r).alias("blocks"))
    places = places.select("id", "d1", "label", "is_hub", "part", F.when(F.col("blocks") == 2, _own_place(F.col("part"), n)).otherwise(F.col("part")).alias("at"))
    return _compared(texts, places, width, percent)


def _confirmed(docs: DataFrame, groups: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """a, b: links of similarity `percent` or more between documents that share a bucket, confirmed on full sets."""
    of = groups.select(F.col("node").alias("id"), F.col("component").alias("g")).join(classes.select("id", "d1", "rank"), "id")
    sizes = of.groupBy("g").agg(F.count(F.lit(1)).alias("size"), F.max(F.struct("rank", (-F.col("id")).alias("id"))).alias("c"))
    sizes = sizes.select("g", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"), (-F.col("c.id")).alias("hub"))
    of = materialize(join_spread(of, sizes, "g", "id").select("id", "d1", "g", "blocks", "hub"), "groups")
    # All texts are shuffled once, for those of candidates. Both sides grow with the data, so neither is ever broadcast.
    texts = docs.select(F.col("doc_id").alias("id"), "text").filter("text IS NOT NULL")
    texts = materialize(texts.join(of.select("id").distinct().hint("merge"), "id"), "candidates")
    links = materialize(_first_links(texts, of, width, percent), "links")
    large = of.filter("blocks > 1").select("id", "g").distinct()
    if large.isEmpty():
        return links
    joined = connected_components(links.join(large.select(F.col("id").alias("a")), "a", "left_semi")).withColumnRenamed("node", "id")
    large = materialize(large.join(joined, "id", "left").select("id", "g", F.coalesce("component", "id").alias("label")), "large")
    return links.unionByName(_further_links(texts, large, classes, width, percent))


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (smallest id reachable), kept (its own smallest).

    A set holds the distinct shingles of `width` words of the whole text with A to Z lower-cased; a shorter text
    is one shingle, one without words (or null) has none and is linked with nothing. Texts with equal sets are
    joined before any bucket is formed. Rows that share an id are one document, linked by any of their texts;
    a row without an id gets the component of its equals if one has an id (else null) and is never kept. An empty
    table gives an empty table. Only the sketches can miss a link (see BANDS, LOOSE and SLACK); none is made without
    comparing full sets. A text is compared in one block of its group; only in large groups that this leaves in several
    parts is it copied further (see _further_links()).
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    out = with_components(docs, materialize(signatures(docs, width), "signatures"), width, percent)
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def with_components(docs: DataFrame, sig: DataFrame, width: int, percent: int) -> DataFrame:
    """component_id beside doc_id, n and further columns of a written table of signatures, one row per row of it."""
    full = sig.filter("n > 0")
    same = full.groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep"))
    classes = full.withColumnRenamed("doc_id", "id").join(same.select("n", "d1", F.col("rep").alias("id")), ["id", "n", "d1"]).select("id", "n", "d1", "bands", "sketch")
    classes = materialize(_ranked(classes), "classes")
    groups = connected_components(_likely(_stars(classes), classes))
    # Rows that share an id are one document, whichever sets they hold.
    several = full.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("d1").alias("lo"), F.max("d1").alias("hi")).filter("lo <> hi").select("doc_id")
    one = full.select("doc_id", "n", "d1", "d2").join(several, "doc_id").join(same, ["n", "d1", "d2"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    found = connected_components(_confirmed(docs, groups, classes, width, percent).union(one)).withColumnRenamed("node", "rep")
    named = same.join(found, "rep", "left").select("n", "d1", "d2", F.coalesce("component", "rep").alias("component_id"))
    out = sig.drop("bands", "sketch").join(named, ["n", "d1", "d2"], "left")
    return out.withColumn("component_id", F.coalesce("component_id", "doc_id")).drop("d1", "d2")


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of every document, on shingles of four words."""
    return near_duplicates(table(spark, sf_dir, "documents"), width=4)


#: Rows without an id get one from their text, beyond this number, while near copies are sought.
NO_ID = 1 << 62


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of every group of near-duplicates the document with the smallest id stays.

    Rows without an id stay if no document with an id is near them, one of each group; those without words all stay.
    Rows that share an id stay or go together.
    """
    own = F.lit(NO_ID) + F.xxhash64(F.coalesce("text", F.lit(""))).bitwiseAND((1 << 61) - 1)
    keyed = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_row"), F.coalesce(F.col("doc_id").cast("long"), own).alias("_key"), "text")
    kept = near_duplicates(keyed, doc_id="_key").filter("kept").select(F.col("doc_id").alias("_key")).distinct()
    out = keyed.join(kept, "_key", "left_semi")
    by_id = F.col("_row.doc_id").isNotNull() | ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    return out.filter(by_id).select("_row.*").unionByName(out.filter(~by_id).dropDuplicates(["_key"]).select("_row.*"))


QUERIES = {"op3_near_dedup": op3_near_dedup}
ORACLES = {}
