"""BPE encoding and decoding through a table of distinct words.

Words are split in Spark, every distinct common word is encoded once, and the ids come back to the texts by position. The
table has a bounded number of words at every size of the corpus; a rarer word is encoded where it stands, once for a
task while that remembers it, since bringing its ids back would shuffle every text. Decoding joins ids to the pieces
of the vocabulary. The file of the tokenizer is a parameter.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lurewatch.llm.common import materialize, table

#: The special token of the vocabulary; in a text it stands for its own id.
SPECIAL = "<|endoftext|>"
#: What byte-level tokenizers cut a text into (fixed value), with Unicode classes.
PATTERN = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words of the table that goes to every worker, and the longest of them in bytes: 15 MB at most, about 4 in fact.
TABLE_WORDS, LONGEST = 200_000, 32
#: Other words that a task remembers.
REMEMBERED = 50_000


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@cache
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@cache
def pieces(path: str) -> list[bytes]:
    """The bytes of every id: the id-to-piece table, as large as the vocabulary."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    of = {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(kept)))}
    data = json.load(open(path, encoding="utf-8"))
    words = dict(data["model"]["vocab"])
    out = [b""] * (1 + max([*words.values(), *(t["id"] for t in data["added_tokens"])]))
    for word, i in words.items():
        out[i] = bytes(of[c] for c in word) if all(c in of for c in word) else word.encode()
    for t in data["added_tokens"]:
        out[t["id"]] = t["content"].encode()
    return out


def split_words(text: Column) -> Column:
    """Words of a text in order; joined they give the text. A null text has none."""
    t = F.coalesce(text, F.lit(""))
    cut = lambda x: F.regexp_extract_all(x, F.lit(PATTERN), F.lit(0))
    parts = F.split(t, r"<\|endoftext\|>", -1)
    apart = F.slice(F.flatten(F.transform(parts, lambda x: F.concat(F.array(F.lit(SPECIAL)), cut(x)))), 2, 1 << 30)
    return F.when(F.contains(t, F.lit(SPECIAL)), apart).otherwise(cut(t))


@cache
def _laid_out(path: str) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], ...]:
    """Bytes, starts and lengths of the pieces, and of the ids as decimal numbers with a comma behind."""

    def laid(items: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = np.array([len(x) for x in items], np.int64)
        return np.frombuffer(b"".join(items), np.uint8), np.cumsum(n) - n, n

    of = pieces(path)
    return laid(of), laid([b"%d," % i for i in range(len(of))])


def common_words(texts: DataFrame, most: int) -> DataFrame:
    """word, n (texts that hold it) of the commonest words of the `words` column: `most` at most, each in two texts or more.

    Words are counted over all texts; counts that cannot be held whole are left out whole.
    """
    counted = texts.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    counted = materialize(counted.filter((F.col("n") > 1) & (F.octet_length("word") <= LONGEST)), "word-counts")
    return counted.filter(F.col("n") > _least_count(counted, F.lit(1), most))


def word_table(words: DataFrame, path: str) -> DataFrame:
    """word, n, ids: every word encoded once."""

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([e.ids for e in _tokenizer(path).encode_batch(batch.tolist(), add_special_tokens=False)])

    return words.withColumn("ids", encode("word"))


def spell(rows: DataFrame, keys: list[str], path: str) -> DataFrame:
    """`keys` (which tell rows apart), ids and data: their bytes in hexadecimal digits, by a join with the id-to-piece table.

    Ids that the vocabulary lacks give nothing; null or empty ids give no bytes.
    """
    table_of = rows.sparkSession.createDataFrame([(i, x.hex()) for i, x in enumerate(pieces(path))], "id int, piece string")
    each = rows.select(*keys, F.posexplode_outer("ids").alias("pos", "id"))
    spelt = each.join(F.broadcast(table_of), "id", "left").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "id", "piece"))).alias("p"))
    ids = F.filter(F.transform("p", lambda s: s["id"]), lambda x: x.isNotNull())
    return spelt.select(*keys, ids.alias("ids"), F.array_join(F.transform("p", lambda s: F.coalesce(s["piece"], F.lit(""))), "").alias("data"))


def spelt_table(words: DataFrame, path: str) -> DataFrame:
    """word, n, h (hash), ids of a word table and spelt: what the ids decode to, null where that is the word itself.

    The pieces of a word come together again in one shuffle of the table of distinct words.
    """
    rows = spell(words, ["word", "n"], path)
    return rows.select("word", "n", F.xxhash64("word").alias("h"), "ids", F.when(F.lower(F.hex(F.encode("word", "UTF-8"))) != F.col("data"), F.unhex("data")).alias("spelt"))


class _Table:
    """Ids of the commonest words, in the order of their hashes."""

    def __init__(self, h: np.ndarray, ends: np.ndarray, ids: np.ndarray) -> None:
        self.h, self.ends, self.ids = h, ends, ids

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which hashes are held, where their ids begin, and how many they are."""
        if not len(self.h):
            none = np.zeros(len(h), np.int64)
            return none.astype(bool), none, none
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        first = np.where(at > 0, self.ends[at - 1], 0).astype(np.int64)
        hit = self.h[at] == h
        return hit, np.where(hit, first, 0), np.where(hit, self.ends[at] - first, 0)


def _least_count(words: DataFrame, size: Column, most: int) -> int:
    """The smallest count such that the words of higher counts take `most` at most; 0 if all do.

    Counts are summed in bins that grow finer where the bound is crossed, so a few rows reach the driver each time.
    """
    total, high = words.agg(F.sum(size), F.max("n")).first()
    if (total or 0) <= most:
        return 0
    above, low, high = 0, 0, high + 1  # size of counts from `high` on; the bound is crossed in low..high
    while high - low > 1:
        step = -(-(high - low) // 1_000)
        bins = words.filter((F.col("n") > low) & (F.col("n") < high)).groupBy(F.expr(f"(n - {low}) div {step}").alias("k")).agg(F.sum(size).alias("b")).collect()
        for row in sorted(bins, key=lambda r: -r["k"]):
            if above + row["b"] > most:
                low, high = max(low, low + row["k"] * step - 1), min(high, low + (row["k"] + 1) * step)
                break
            above += row["b"]
        else:
            return low
        if step == 1:
            return high - 1
    return low


def _held(spelt: DataFrame) -> _Table:
    """The table as arrays, from words of a spelt_table() that decode to themselves: as many as common_words() gives at most."""
    rows = spelt.filter("spelt IS NULL").select("h", "ids").toArrow()
    h = rows.column("h").to_numpy()
    order = np.argsort(h, kind="stable")
    ids = rows.column("ids").combine_chunks()
    ids = ids.take(pa.array(order)) if len(order) else ids
    ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
    ends = np.cumsum(pc.list_value_length(ids).to_numpy(zero_copy_only=False)).astype(np.int64) if len(order) else np.zeros(0, np.int64)
    return _Table(h[order], ends.astype(np.uint32), pc.list_flatten(ids).to_numpy().astype(np.uint16) if len(order) else np.zeros(0, np.uint16))


def _gather(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of data laid end to end, and where each of them ends."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    narrow = np.int32 if max(total, len(data)) < 1 << 31 else np.int64  # index arrays are the largest of all
    return data[np.arange(total, dtype=narrow) + np.repeat((starts - (ends - sizes)).astype(narrow), sizes)], ends


def encode(docs: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text", table_words: int = TABLE_WORDS, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (with_ids), decoded (with_ids), ids_sha256, decoded_sha256: one row per input row.

    Ids are those of the whole text without added special tokens; a special token's own text gives its id. A
    null or empty text has no ids. The `table_words` commonest words are encoded once and go to the workers; other
    words are encoded in the task that meets them. No text is shuffled, whatever its id. Rows that share a doc_id are
    encoded one by one; an empty table gives an empty table. Other columns are not read. The vocabulary must have fewer
    than 65,536 ids.

    Decoded text is made of what the words' ids give in the id-to-piece table (a join for the table of words, see
    spelt_table()). A word that comes back as itself needs no second copy of its bytes.
    """
    path = path or vocabulary()
    assert len(pieces(path)) < 1 << 16, "ids are held in 16 bits"
    spark = docs.sparkSession
    texts = docs.select(F.col(doc_id).alias("doc_id"), split_words(F.col(text)).alias("words"))
    hot = spark.sparkContext.broadcast(_held(spelt_table(word_table(common_words(texts, table_words), path), path)))
    texts = texts.withColumn("h", F.transform("words", lambda w: F.xxhash64(w)))
    kind = next(f.dataType.simpleString() for f in texts.schema if f.name == "doc_id")
    schema = f"doc_id {kind}, n_tokens bigint, " + ("ids array<int>, decoded binary, " if with_ids else "") + "ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                yield one(whole.slice(start, 256))

    known: dict[str, tuple[list[int], bytes | None]] = {}

    def others(words: list[str]) -> list[tuple[list[int], bytes | None]]:
        """Ids, and decoded bytes where they are not the word's own, of words that the table lacks."""
        if len(known) > REMEMBERED:
            known.clear()
        new = [w for w in words if w not in known]
        for w, e in zip(new, _tokenizer(path).encode_batch(new, add_special_tokens=False) if new else (), strict=True):
            data = b"".join([pieces(path)[i] for i in e.ids])
            known[w] = (e.ids, None if data == w.encode() else data)
        return [known[w] for w in words]

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists, piece_of, number_of = batch.column("words"), *_laid_out(path)
        flat, h = lists.flatten(), batch.column("h").flatten().to_numpy()
        if len(flat):
            begin = np.frombuffer(flat.buffers()[1], np.int32)[flat.offset : flat.offset + len(flat) + 1].astype(np.int64)
            raw = np.frombuffer(flat.buffers()[2] or b"", np.uint8)
        else:
            begin, raw = np.zeros(1, np.int64), np.zeros(0, np.uint8)
        length = np.diff(begin)
        distinct, at, place = np.unique(h, return_index=True, return_inverse=True)
        hit, starts, sizes = hot.value.find(distinct)
        # Ids from the table are taken only if their pieces spell the word, whatever the hash says.
        spelt, ends = _gather(hot.value.ids, starts[place], sizes[place])
        plain, last = _gather(piece_of[0], piece_of[1][spelt], piece_of[2][spelt])
        stop = np.r_[0, last][ends] if len(ends) else ends
        true = hit[place] & (np.diff(np.r_[0, stop]) == length)
        if true.all() and np.array_equal(plain, raw[begin[0] : begin[-1]]):
            ids, counts, odd = spelt, sizes[place], {}
        else:
            held = np.flatnonzero(true)
            mine, _ = _gather(raw, begin[held], length[held])
            theirs, _ = _gather(plain, stop[held] - length[held], length[held])
            true[np.repeat(held, length[held])[mine != theirs]] = False
            left = np.flatnonzero(~true)
            coded = flat.take(pa.array(left)).dictionary_encode()
            new = others(coded.dictionary.to_pylist())
            which = coded.indices.to_numpy()
            n = np.array([len(x) for x, _ in new], np.int64)
            more = np.array([i for x, _ in new for i in x], np.uint16)
            pool, where, counts = np.r_[spelt, more], ends - sizes[place], sizes[place].copy()
            where[left], counts[left] = len(spelt) + (np.cumsum(n) - n)[which], n[which]
            ids, _ = _gather(pool, where, counts)
            odd = {int(k): new[w][1] for k, w in zip(left, which, strict=True) if new[w][1] is not None}
        numbers, number_end = _gather(number_of[0], number_of[1][ids], number_of[2][ids])
        numbers, number_end = numbers.tobytes(), np.r_[0, number_end]
        token_end = np.r_[0, np.cumsum(counts)]
        doc_end = np.r_[0, np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))].astype(int)
        odd_at = np.array(sorted(odd), int)
        columns: list[list] = [[], [], [], []]
        for a, b in zip(doc_end[:-1], doc_end[1:], strict=True):
            t0, t1 = token_end[a], token_end[b]
            data = raw[begin[a] : begin[b]].tobytes()
            if len(mine := odd_at[np.searchsorted(odd_at, a) : np.searchsorted(odd_at, b)]):
                parts, done = [], a
                for k in mine:
                    parts += [raw[begin[done] : begin[k]].tobytes(), odd[int(k)]]
                    done = k + 1
                data = b"".join([*parts, raw[begin[done] : begin[b]].tobytes()]).decode("utf-8", "replace").encode()
            if with_ids:
                columns[0].append(ids[t0:t1].astype(np.int32))
                columns[1].append(data)
            columns[2].append(hashlib.sha256(numbers[number_end[t0] : max(number_end[t0], number_end[t1] - 1)]).hexdigest())
            columns[3].append(hashlib.sha256(data).hexdigest())
        kept = [batch.column("doc_id"), pa.array(token_end[doc_end[1:]] - token_end[doc_end[:-1]], pa.int64())]
        if with_ids:
            kept += [pa.array(columns[0], pa.list_(pa.int32())), pa.array(columns[1], pa.binary())]
        kept += [pa.array(columns[2], pa.string()), pa.array(columns[3], pa.string())]
        names = ["doc_id", "n_tokens", *(["ids", "decoded"] if with_ids else []), "ids_sha256", "decoded_sha256"]
        return pa.RecordBatch.from_arrays(kept, names=names)

    return texts.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text: ids back to text by a join with the id-to-piece table, one row per input row.

    Ids that the vocabulary lacks give nothing; null or empty ids give an empty text; bytes that are no UTF-8 (an id
    can hold part of a character) are replaced. Rows get a key of their own, which is written before the join.
    """
    rows = materialize(encoded.select("doc_id", "ids", F.monotonically_increasing_id().alias("_r")), "encoded")
    spelt = spell(rows, ["doc_id", "_r"], path or vocabulary())
    return spelt.select("doc_id", F.make_valid_utf8(F.unhex("data").cast("string")).alias("text"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text of every document."""
    return encode(table(spark, sf_dir, "documents"), with_ids=False)


QUERIES = {"op10_bpe": op10_bpe}
ORACLES = {}
