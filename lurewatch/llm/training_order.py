"""Training-order materialisation: a keyed permutation gives every sequence a slot; shards hold slots at a fixed stride."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lurewatch.llm.common import scratch, table
from lurewatch.llm.tokens import Encoder, ranks

#: Tokens of a sequence, sequences of a shard, rounds of the Feistel network, id between texts.
SEQUENCE, SHARD, ROUNDS, END = 1_024, 4_096, 6, 50_256
#: Bytes of shards that a task sorts and writes, however large the corpus; compression level of what is kept or shuffled.
TASK_BYTES, PACK_LEVEL, TABLE_LEVEL = 128 << 20, 6, 9
#: Sequences from which a dictionary for the shuffled ones is made, and its bytes. It changes their size on the way, nothing else.
SAMPLED, DICT_BYTES = 500, 100 << 10


def permute(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """Keyed permutation of 0..n-1: a Feistel network on the next even power of two, walked until it lands inside."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = [np.uint64(int.from_bytes(hashlib.sha256(f"{key}:{r}".encode()).digest()[:8], "little")) for r in range(ROUNDS)]

    def network(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            f = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((f ^ (f >> np.uint64(32))) & mask)
        return left << np.uint64(half) | right

    with np.errstate(over="ignore"):
        out = network(np.asarray(index, np.uint64))
        while (far := out >= np.uint64(n)).any():
            out[far] = network(out[far])
    return out.astype(np.int64)


def cut_sequences(docs: DataFrame, path: str, sequence: int) -> DataFrame:
    """partition, k (place in the partition), doc_ids (of the texts in it, in order), tokens (16-bit ids, `sequence` of them).

    Texts of a partition of the scan follow one another, each with the end id behind it; only the last sequence
    of a partition is filled up with end ids.
    """
    rows, stride = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), 2 * sequence
    end = np.array([END], "<u2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, p, made = Encoder(path), TaskContext.get().partitionId(), 0
        held, owners = b"", []  # bytes not yet in a sequence; the texts they belong to, with where each ends

        def cut(last: bool) -> pa.RecordBatch:
            nonlocal held, owners, made
            if last and len(held) % stride:
                held += end * ((stride - len(held) % stride) // 2)
            n = len(held) // stride
            ids: list[list] = [[] for _ in range(n)]
            begin, later = 0, []
            for doc, stop in owners:
                for k in range(begin // stride, min(n, -(-stop // stride))):
                    ids[k].append(doc)
                if stop > n * stride:
                    later.append((doc, stop - n * stride))
                begin = stop
            tokens = [held[k * stride : (k + 1) * stride] for k in range(n)]
            held, owners = held[n * stride :], later
            made += n
            return pa.RecordBatch.from_arrays([pa.array([p] * n, pa.int32()), pa.array(range(made - n, made), pa.int64()), pa.array(ids, pa.list_(pa.int64())), pa.array(tokens, pa.binary())], names=["partition", "k", "doc_ids", "tokens"])

        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                x = whole.slice(start, 1024)
                parts, size = [held], len(held)
                for doc, ids in zip(x.column("doc_id").to_pylist(), encoder.encode(x.column("text").to_pylist()), strict=True):
                    parts += (ids, end)
                    size += len(ids) + 2
                    owners.append((doc, size))
                held = b"".join(parts)
                yield cut(False)
        yield cut(True)

    return rows.mapInArrow(run, "partition int, k bigint, doc_ids array<bigint>, tokens binary")


def dictionary(cut: DataFrame) -> bytes:
    """A dictionary made from a few sequences; empty if they are too few."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, [bytes(r["tokens"]) for r in cut.select("tokens").limit(SAMPLED).collect()]).as_bytes()
    except zstandard.ZstdError:
        return b""


def _dict_of(data: bytes) -> dict:
    return {"dict_data": zstandard.ZstdCompressionDict(data)} if data else {}


def numbered(cut: DataFrame, key: int, shared: bytes) -> tuple[DataFrame, int]:
    """slot, doc_ids, packed (tokens compressed with the dictionary); and the number of slots. Only a count per partition reaches the driver."""
    counts = {r["partition"]: r["count"] for r in cut.groupBy("partition").count().collect()}
    total, first, at = sum(counts.values()), {}, 0
    for p in sorted(counts):
        first[p], at = at, at + counts[p]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=PACK_LEVEL, write_content_size=True, write_dict_id=False, **_dict_of(shared))
        for x in batches:
            index = np.array([first[p] for p in x.column("partition").to_pylist()], np.int64) + x.column("k").to_numpy()
            packed = [pack.compress(t) for t in x.column("tokens").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(permute(index, total, key), pa.int64()), x.column("doc_ids"), pa.array(packed, pa.binary())], names=["slot", "doc_ids", "packed"])

    return cut.mapInArrow(run, "slot bigint, doc_ids array<bigint>, packed binary"), total


def fingerprint(docs: DataFrame) -> list[int]:
    """Number of rows and two sums over their hashes: equal for equal rows in any order, repeated ones included."""
    h = docs.select(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.coalesce("text", F.lit(""))).alias("h"))
    found = h.agg(F.count(F.lit(1)), F.sum(F.shiftright("h", 32)), F.sum(F.col("h").bitwiseAND(0xFFFFFFFF))).first()
    return [x or 0 for x in found]


def sequences_of(docs: DataFrame, out: str, path: str, sequence: int) -> DataFrame:
    """The table of sequences under `out`: cut anew unless its manifest says that it is whole and of the same texts.

    The manifest (`out`/sequences.json) is taken away before the table is cut and written after it is complete.
    """
    from pyarrow import fs

    spark = docs.sparkSession
    system, root = fs.FileSystem.from_uri(out)
    name = f"{root}/sequences.json"
    with open(path, "rb") as f:
        want = {"texts": fingerprint(docs), "sequence": sequence, "vocabulary": hashlib.sha256(f.read()).hexdigest()}
    found = None
    if system.get_file_info(name).type == fs.FileType.File:
        with system.open_input_stream(name) as f:
            found = json.loads(f.read() or b"null")
    if found != want:
        if found is not None:
            system.delete_file(name)
        tight = {"compression": "zstd", "parquet.compression.codec.zstd.level": TABLE_LEVEL, "parquet.page.size": 16 << 20}
        cut_sequences(docs, path, sequence).write.mode("overwrite").options(**tight).parquet(f"{out}/sequences")
        with system.open_output_stream(name) as f:
            f.write(json.dumps(want).encode())
    return spark.read.parquet(f"{out}/sequences")


def drop_shards(out: str, first: int) -> None:
    """Deletes shards from number `first` on, which an earlier run over more sequences left."""
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(out)
    for x in system.get_file_info(fs.FileSelector(f"{root}/shards", allow_not_found=True)):
        stem, _, end = x.base_name.partition(".")
        if end == "bin" and stem.isdigit() and int(stem) >= first:
            system.delete_file(x.path)


def write_shards(docs: DataFrame, out: str, key: int = 20_240_229, path: str | None = None, sequence: int = SEQUENCE, shard: int = SHARD) -> DataFrame:
    """Writes `out`/shards/NNNNNNNN.bin and returns the index: slot, shard, row, doc_ids, tokens_sha256.

    Slot s lies in shard s div `shard`, at byte (s mod `shard`) * 2 * `sequence`: a reader resumes anywhere without an
    index. Slots are dealt to tasks by range, TASK_BYTES of shards to each at most; a task sorts its slots and writes its shards one after another, each
    under a name of its own first and then moved into place, so that a task that runs again leaves the same
    files. Texts are encoded once, into a table of sequences in the shared folder that numbering reads again; a run
    over the same texts into the same folder goes on with that table (see sequences_of()). A shard already in place
    is not written again if its digest is that of what belongs there; shards beyond the last are deleted. Null texts
    count as empty; a repeated row is written each time; an empty table gives no shard and an empty index.
    """
    spark = docs.sparkSession
    cut = sequences_of(docs, out, path or ranks(), sequence)
    shared = dictionary(cut)
    rows, total = numbered(cut, key, shared)
    shards, stride = -(-total // shard), 2 * sequence
    parts = max(1, min(shards, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total * stride // TASK_BYTES))))
    rows = rows.withColumn("shard", F.expr(f"slot div {shard}"))
    dealt = rows.repartitionById(parts, F.expr(f"cast(shard * {parts} div {max(1, shards)} as int)")).sortWithinPartitions("slot")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(out)
        system.create_dir(f"{root}/shards", recursive=True)
        unpack = zstandard.ZstdDecompressor(**_dict_of(shared))
        now, held = -1, []

        def same(name: str) -> bool:
            there, here = hashlib.sha256(), hashlib.sha256()
            with system.open_input_stream(name) as f:
                while part := f.read(1 << 20):
                    there.update(part)
            for x in held:
                here.update(x)
            return there.digest() == here.digest()

        def close() -> None:
            if not held:
                return
            name, size = f"{root}/shards/{now:08d}.bin", len(held) * stride
            if system.get_file_info(name).size == size and same(name):
                return
            own = f"{root}/shards/_{now:08d}.{TaskContext.get().taskAttemptId()}"
            with system.open_output_stream(own) as f:
                for x in held:
                    f.write(x)
            system.move(own, name)

        for batch in batches:
            tokens = [unpack.decompress(t) for t in batch.column("packed").to_pylist()]
            for n, x in zip(batch.column("shard").to_pylist(), tokens, strict=True):
                if n != now:
                    close()
                    now, held = n, []
                held.append(x)
            digests = pa.array([hashlib.sha256(x).hexdigest() for x in tokens], pa.string())
            row = pa.array(batch.column("slot").to_numpy() % shard, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("slot"), batch.column("shard"), row, batch.column("doc_ids"), digests], names=["slot", "shard", "row", "doc_ids", "tokens_sha256"])
        close()

    schema = "slot bigint, shard bigint, row bigint, doc_ids array<bigint>, tokens_sha256 string"
    dealt.mapInArrow(run, schema).write.mode("overwrite").parquet(f"{out}/index")
    drop_shards(out, shards)
    return spark.read.schema(schema).parquet(f"{out}/index")


def read_from(spark: SparkSession, out: str, slot: int, sequence: int = SEQUENCE, shard: int = SHARD) -> DataFrame:
    """slot, tokens (array of ids) from a slot onwards, read from the shards alone."""
    name = F.regexp_extract("path", r"(\d+)\.bin$", 1).cast("long")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(f"{out}/shards").select(name.alias("shard"), "content").filter(F.col("shard") >= slot // shard)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, data in zip(batch.column("shard").to_pylist(), batch.column("content").to_pylist(), strict=True):
                ids = np.frombuffer(data, "<u2").reshape(-1, sequence).astype(np.int32)
                slots = n * shard + np.arange(len(ids))
                kept = slots >= slot
                yield pa.RecordBatch.from_arrays([pa.array(slots[kept], pa.int64()), pa.array(list(ids[kept]), pa.list_(pa.int32()))], names=["slot", "tokens"])

    return files.mapInArrow(run, "slot bigint, tokens array<int>")


def op9_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index of the shards of all documents."""
    return write_shards(table(spark, sf_dir, "documents").select("doc_id", "text"), scratch(spark, "training-order"))


QUERIES = {"op9_training_order": op9_training_order}
ORACLES = {}
