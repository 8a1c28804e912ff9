"""Removal of repeated passages by prefix-free parsing: triggers cut texts into phrases, sorted suffixes of the phrases find what repeats.

A string of `length` bytes belongs to the trigger in it: the 16 bytes of least hash. Strings next to one another that
share a trigger make a phrase, so phrases overlap by `length` - 1 bytes, every string lies in one phrase, and equal
strings lie in phrases of one trigger at the same distance from it. Distinct phrases are the dictionary, and their
places the parse. All occurrences of a phrase but its first repeat it as a whole. Phrases that share a trigger with
another phrase go to one task, which sorts their suffixes to a depth of `length` bytes (corpus order need go no deeper);
among equal suffixes, the parse says which comes first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lurewatch.llm.common import materialize, table

#: Bytes of a string that counts as repeated; bytes of a trigger.
LENGTH, TRIGGER = 100, 16
#: Bytes of text that are parsed at a time; a longer text is cut into pieces that overlap.
CHUNK = 4 << 20
#: Distinct phrases of one trigger, in a chunk or in all, beyond which its strings are compared one by one, each under a hash of its own.
HOT_HERE, HOT = 64, 4_096
#: Phrases whose suffixes are sorted together; strings of hot triggers that a task holds before it sends them on.
GROUP, SINGLES = 16_384, 100_000
#: Kinds of what a task finds: a phrase, one of a hot trigger, a mark of a hot trigger, strings that are known to repeat.
PHRASE, OF_HOT, MARK, REPEATED = range(4)

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(32))


def _words(raw: np.ndarray, order: str = "<") -> np.ndarray:
    """The 8 bytes from every place on as one number."""
    return np.ndarray((max(0, len(raw) - 7),), f"{order}u8", raw.data, strides=(1,))


def _least(v: np.ndarray, width: int) -> np.ndarray:
    """Least of every `width` neighbours: running minima of blocks from both ends."""
    n = len(v) - width + 1
    whole = np.full(-(-len(v) // width) * width, np.iinfo(v.dtype).max, v.dtype)
    whole[: len(v)] = v
    blocks = whole.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def parse(raw: np.ndarray, ends: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Phrases of texts laid end to end: text, place of the first string, number of strings, hash of the trigger."""
    none = np.zeros(0, np.int64)
    if len(raw) < length:
        return none, none, none, none.astype(np.uint64)
    with np.errstate(over="ignore"):
        w = _words(raw)
        h = _mix(w[: len(raw) - TRIGGER + 1] * _A ^ _mix(w[8 : len(raw) - TRIGGER + 9] * _B))
    # The place below the hash: of equal hashes the first is the least.
    v = h & np.uint64(0xFFFFFFFF00000000) | np.arange(len(h), dtype=np.uint64)
    anchor = (_least(v, length - TRIGGER + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    sizes = np.diff(np.r_[0, ends])
    text = np.repeat(np.arange(len(ends), dtype=np.int32), np.maximum(sizes - length + 1, 0))
    counts = np.maximum(sizes - length + 1, 0)
    at = np.arange(len(text)) + np.repeat(ends - sizes - (np.cumsum(counts) - counts), counts)
    if not len(at):
        return none, none, none, none.astype(np.uint64)
    anchor = anchor[at]
    cut = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    return text[cut].astype(np.int64), at[cut], np.diff(np.r_[cut, len(at)]), h[anchor[cut]]


def _firsts(keys: tuple[np.ndarray, ...], place: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Order by keys, then place; and in that order, whether a row stands at the first place of its keys."""
    order = np.lexsort((*place[::-1], *keys[::-1]))
    change = lambda xs: np.logical_or.reduce([x[order][1:] != x[order][:-1] for x in xs])
    if not len(order):
        return order, np.zeros(0, bool)
    new = np.r_[True, change(keys)]
    begin = np.flatnonzero(new)[np.cumsum(new) - 1]
    return order, np.logical_and.reduce([x[order] == x[order][begin] for x in place])


def _runs(text: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of strings that follow one another in a text, as one; given in any order."""
    order = np.lexsort((start, text))
    text, start, n = text[order], start[order], n[order]
    if not len(text):
        return text, start, n
    new = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (start[1:] != start[:-1] + n[:-1])])
    return text[new], start[new], np.add.reduceat(n, new)


def _pieces(batch: pa.RecordBatch, length: int) -> Iterator[tuple[list[int], list[int], list[memoryview]]]:
    """Rows of a batch, each once, with the place of a piece in its text and its bytes: CHUNK bytes or so at a time."""
    seen, rows, bases, parts, size = set(), [], [], [], 0
    data = batch.column("text")
    for k, of in enumerate(zip(batch.column("o").to_pylist(), batch.column("d").to_pylist(), strict=True)):
        whole = memoryview(data[k].as_buffer()) if of not in seen else memoryview(b"")
        seen.add(of)
        for base in range(0, len(whole) - length + 1, CHUNK):
            piece = whole[base : base + CHUNK + length - 1]
            if rows and size + len(piece) > CHUNK:
                yield rows, bases, parts
                rows, bases, parts, size = [], [], [], 0
            rows.append(k)
            bases.append(base)
            parts.append(piece)
            size += len(piece)
    if rows:
        yield rows, bases, parts


UNITS = "key bigint, h bigint, o bigint, d bigint, place bigint"


def _place(start: np.ndarray, n: np.ndarray, kind: np.ndarray | int) -> np.ndarray:
    """Start, number of strings (REPEATED: of any size, in `h`) and kind as one number that grows with the start."""
    return (start << 10) | (n << 2) | kind


def phrases(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """key, h, o, d, place (see _place()): the phrases of texts (o, d, text), each once for a chunk, and what repeats within a chunk.

    key and h tell phrases apart: the trigger's hash and the phrase's. A trigger that has many phrases in a chunk gives
    each a key of its own and leaves a mark under its own key.
    """

    def one(batch: pa.RecordBatch, rows: list[int], bases: list[int], parts: list[memoryview]) -> pa.RecordBatch:
        joined = b"".join(parts)
        raw, row, base = np.frombuffer(joined, np.uint8), np.array(rows), np.array(bases, np.int64)
        ends = np.cumsum([len(p) for p in parts])
        text, at, n, trigger = parse(raw, ends, length)
        view = memoryview(joined)
        h = np.fromiter((xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(at.tolist(), (at + n + length - 1).tolist(), strict=True)), np.uint64, len(at))
        start = at - (ends - np.diff(np.r_[0, ends]))[text] + base[text]
        o, d = (batch.column(c).to_numpy()[row[text]] for c in ("o", "d"))
        order, first = _firsts((trigger, h), (o, d, start))
        text, n, trigger, h, start, o, d = (x[order] for x in (text, n, trigger, h, start, o, d))
        same, s, m = _runs(row[text[~first]], start[~first], n[~first])
        done_o, done_d = (batch.column(c).to_numpy()[same] for c in ("o", "d"))
        trigger, h, start, n, o, d = (x[first] for x in (trigger, h, start, n, o, d))
        _, of, many = np.unique(trigger, return_inverse=True, return_counts=True)
        hot = many[of] > HOT_HERE if len(of) else np.zeros(0, bool)
        with np.errstate(over="ignore"):
            marks = np.unique(trigger[hot])
            key = np.where(hot, _mix(trigger * _A ^ h), trigger)
            spread = _mix(done_d.astype(np.uint64) * _B ^ s.astype(np.uint64))
        none = np.zeros(len(marks), np.int64)
        columns = (
            np.r_[key, marks, spread].view(np.int64), np.r_[h.view(np.int64), none, m], np.r_[o, none, done_o], np.r_[d, none, done_d],
            np.r_[_place(start, n, np.where(hot, OF_HOT, PHRASE)), none + MARK, _place(s, 0, REPEATED)],
        )
        return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64, copy=False)) for c in columns], names=["key", "h", "o", "d", "place"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, bases, parts in _pieces(batch, length):
                yield one(batch, rows, bases, parts)

    return texts.select("o", "d", "text").mapInArrow(run, UNITS)


def occurrences(units: DataFrame) -> DataFrame:
    """o, d, start, n, key, kind: strings that are known to repeat (REPEATED), and first phrases that share their trigger (PHRASE, or OF_HOT if many do).

    One shuffle by trigger. A chunk sends a phrase once, and a hot trigger's phrases have keys of their own, so no key
    holds more than some share of a chunk.
    """
    by_phrase, by_key = Window.partitionBy("key", "h"), Window.partitionBy("key")
    kind = F.col("kind")
    rows = units.repartition("key").withColumn("kind", F.col("place").bitwiseAND(3).cast("int"))
    lives = kind.isin(PHRASE, OF_HOT)
    at = F.struct("o", "d", "place")
    rows = rows.withColumn("first", F.when(lives, F.min(F.when(lives, at)).over(by_phrase)))
    repeats = lives & ((F.col("o") != F.col("first.o")) | (F.col("d") != F.col("first.d")) | (F.shiftright("place", 10) != F.shiftright("first.place", 10)))
    least, most = F.min(F.when(lives, F.col("h"))).over(by_key), F.max(F.when(lives, F.col("h"))).over(by_key)
    marked, many = F.max(kind == MARK).over(by_key), F.count_if(lives & ~repeats).over(by_key)
    rows = rows.select("*", repeats.alias("repeats"), least.alias("least"), most.alias("most"), marked.alias("marked"), many.alias("many"))
    hot = (kind == OF_HOT) | F.col("marked") | (F.col("many") > HOT)
    as_kind = F.when((kind == REPEATED) | F.col("repeats"), REPEATED).when(lives & hot, OF_HOT).when(lives & (F.col("least") != F.col("most")), PHRASE)
    n = F.when(kind == REPEATED, F.col("h")).otherwise(F.shiftright("place", 2).bitwiseAND(255))
    return rows.select("o", "d", F.shiftright("place", 10).alias("start"), n.alias("n"), "key", as_kind.alias("kind")).filter("kind IS NOT NULL")


def extracted(texts: DataFrame, wanted: DataFrame, groups: int, length: int = LENGTH) -> DataFrame:
    """bucket, o, d, start, n, data: the bytes of phrases (PHRASE), and of each string of those of hot triggers (OF_HOT); n = 0: it repeats one of the same chunk."""
    lists = wanted.groupBy("o", "d").agg(F.collect_list(F.struct("start", "n", "key", "kind")).alias("wanted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            at = 0
            sizes = pc.binary_length(whole.column("text")).to_pylist()
            while at < len(sizes):
                stop, size = at, 0
                while stop < len(sizes) and (stop == at or size + sizes[stop] <= CHUNK):
                    size += sizes[stop]
                    stop += 1
                yield from one(whole.slice(at, stop - at))
                at = stop

    def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []  # bucket, o, d, start, n, data
        singles: dict[bytes, list[tuple]] = {}
        held = 0

        def settle() -> None:
            """Of strings that stand alone: the first place of each goes on with its bytes, the others repeat it."""
            nonlocal held
            for data, places in singles.items():
                first = min(places)
                found.append((xxhash.xxh3_64_intdigest(data) % groups, *first, 1, data))
                found.extend((hash(p) % groups, *p, 0, b"") for p in set(places) - {first})
            singles.clear()
            held = 0

        def sent() -> Iterator[pa.RecordBatch]:
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            for k in range(0, len(found), GROUP):
                columns = list(zip(*found[k : k + GROUP], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["bucket", "o", "d", "start", "n", "data"])
            found.clear()

        for o, d, text, items in zip(*(batch.column(c).to_pylist() for c in ("o", "d", "text", "wanted")), strict=True):
            hot = {i["start"] for i in items if i["kind"] == OF_HOT}
            for start, n, key, kind in dict.fromkeys((i["start"], i["n"], i["key"], i["kind"]) for i in items):
                if kind == OF_HOT:
                    for k in range(start, start + n):
                        singles.setdefault(text[k : k + length], []).append((o, d, k))
                    held += n
                    if held >= SINGLES:
                        settle()
                elif start not in hot:
                    found.append((key % groups, o, d, start, n, text[start : start + n + length - 1]))
                if len(found) >= GROUP:
                    yield from sent()
        settle()
        yield from sent()

    rows = texts.join(lists, ["o", "d"]).select("o", "d", "doc_id", "text", "copies", "wanted")
    return rows.mapInArrow(run, "bucket int, o bigint, d bigint, start bigint, n int, data binary")


def sorted_suffixes(raw: np.ndarray, at: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes (places `at`) that share their first `length` bytes with another one, in the order of these bytes, and the class of each.

    Sorted word by word; a suffix that stands alone after a word is left out of the next.
    """
    words, which, group = _words(raw, ">"), np.arange(len(at)), np.zeros(len(at), np.int64)
    for skip in [*range(0, length - 8, 8), length - 8]:
        if not len(which):
            break
        w = words[at[which] + skip].astype(np.uint64)
        order = np.lexsort((w, group))
        which, w, group = which[order], w[order], group[order]
        group = np.cumsum(np.r_[True, (w[1:] != w[:-1]) | (group[1:] != group[:-1])]) - 1
        alone = np.bincount(group)[group] == 1
        which, group = which[~alone], group[~alone]
    return which, group


def repeats(found: DataFrame, length: int = LENGTH) -> DataFrame:
    """o, d, start, n: runs of strings of the extracted phrases that an earlier one equals, by the sorted suffixes of each bucket."""

    def run(rows: pa.Table) -> pa.Table:
        o, d, start, n = (rows.column(c).to_numpy().astype(np.int64) for c in ("o", "d", "start", "n"))
        known, live = np.flatnonzero(n == 0), np.flatnonzero(n)
        data = rows.column("data").combine_chunks()
        data = pa.concat_arrays(data.chunks) if isinstance(data, pa.ChunkedArray) else data
        data = data.take(pa.array(live))
        raw = np.frombuffer(b"".join(data.to_pylist()) or bytes(8), np.uint8)
        sizes = n[live] + length - 1
        count = n[live]
        within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        at = np.repeat(np.cumsum(sizes) - sizes, count) + within
        of = np.repeat(live, count)
        which, group = sorted_suffixes(raw, at, length)
        where = (o[of[which]], d[of[which]], start[of[which]] + within[which])
        order, first = _firsts((group,), where)
        later = [x[order][~first] for x in where]
        o, d, s = (np.r_[x[known], y] for x, y in zip((o, d, start), later, strict=True))
        _, text = np.unique(np.stack([o, d], 1), axis=0, return_inverse=True) if len(o) else (o, o)
        text = text.ravel()
        owner = dict(zip(text.tolist(), zip(o.tolist(), d.tolist(), strict=True), strict=True))
        text, s, m = _runs(text, s, np.ones(len(s), np.int64))
        both = [owner[t] for t in text.tolist()]
        return pa.table([pa.array([b[0] for b in both], pa.int64()), pa.array([b[1] for b in both], pa.int64()), pa.array(s, pa.int64()), pa.array(m, pa.int64())], names=["o", "d", "start", "n"])

    return found.groupBy("bucket").applyInArrow(run, "o bigint, d bigint, start bigint, n bigint")


def without_repeats(docs: DataFrame, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, spans (array of start and end: the maximal removed runs), kept (the other bytes): a row per input row.

    A byte goes if it is covered by a string of `length` bytes that also starts earlier: in a text of a smaller doc_id
    or earlier in its own. Strings are those of the input, whatever is removed, and never cross texts. A null text is
    empty; texts under `length` bytes stay whole. Rows that share an id come in the order of a hash of their texts;
    of equal rows with one id the first is the original and the others repeat it. Rows without an id come last. An empty
    table gives an empty table. Other columns are not read.

    No phrase is sent more than once a chunk, no group is larger than GROUP phrases or so, and texts are shuffled once,
    by id and hash, for the extraction of phrases and for the removal.
    """
    assert 2 * TRIGGER <= length < 256, "strings of 32 to 255 bytes"
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    keyed = plain.select("doc_id", F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("o"), F.xxhash64(F.isnull("doc_id"), "text").alias("d"), "text")
    found = materialize(occurrences(phrases(keyed, length)), "occurrences")
    size = found.filter(F.col("kind") != REPEATED).agg(F.sum(F.when(F.col("kind") == OF_HOT, F.col("n")).otherwise(1))).first()[0] or 0
    groups = max(1, -(-size // GROUP))
    texts = keyed.groupBy("o", "d").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    wanted = found.filter(F.col("kind") != REPEATED)
    gone = repeats(extracted(texts, wanted, groups, length), length).unionByName(found.filter(F.col("kind") == REPEATED).select("o", "d", "start", "n"))
    lists = gone.groupBy("o", "d").agg(F.collect_list(F.struct("start", "n")).alias("gone"))
    rows = texts.join(lists, ["o", "d"], "left").select("doc_id", "text", "copies", "gone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for i, t, copies, gone in (row for k in range(0, batch.num_rows, 64) for row in zip(*(batch.slice(k, 64).column(c).to_pylist() for c in ("doc_id", "text", "copies", "gone")), strict=True)):
                out.append((i, len(t), *_removed(t, gone or [], length)))
                size += len(t)
                whole = (i, len(t), [{"start": 0, "end": len(t)}], b"") if len(t) >= length else out[-1]
                for _ in range(copies - 1):
                    out.append(whole)
                    if len(out) >= 10_000:
                        yield _batch(out)
                        out = []
                if size >= CHUNK:
                    yield _batch(out)
                    out, size = [], 0
            yield _batch(out)

    return rows.mapInArrow(run, "doc_id bigint, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["doc_id", "n_bytes", "spans", "kept"])


def _removed(text: bytes, gone: list[dict], length: int) -> tuple[list[dict], bytes]:
    """Maximal removed runs of a text and what stays."""
    spans: list[list[int]] = []
    for start, end in sorted((g["start"], g["start"] + g["n"] + length - 1) for g in gone):
        if spans and start <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], end)
        else:
            spans.append([start, end])
    kept = [text[a:b] for a, b in zip([0, *(e for _, e in spans)], [*(s for s, _ in spans), len(text)], strict=True)]
    return [{"start": s, "end": e} for s, e in spans], b"".join(kept)


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is removed from every document, and a digest of what stays."""
    out = without_repeats(table(spark, sf_dir, "documents"))
    n = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", n.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op12_suffix_dedup": op12_suffix_dedup}
ORACLES = {}
