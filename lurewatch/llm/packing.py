"""Best-fit packing of token sequences under conflicts of source and duplicate cluster."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lurewatch.llm.common import materialize, table
from lurewatch.llm.near_dedup import PERCENT, WIDTH, signatures, with_components
from lurewatch.llm.tokens import Encoder, counter, ranks

#: Tokens of a bin, and pieces that are packed together: a group this large fills its bins nearly as well as all would.
CAPACITY, GROUP = 2_048, 4_096


def best_fit(sizes: list[int], sources: list, clusters: list, capacity: int = CAPACITY) -> list[int]:
    """Bin of each piece, pieces given in the order in which they are to be placed.

    Bins stand in order of the room they have left and carry a bitmap of their sources and one of their duplicate
    clusters. A piece goes to the tightest bin with room whose bitmaps lack both; the search goes on from
    successor to successor until there is one, and a new bin is opened if there is none.
    """
    source_bit = {s: 1 << i for i, s in enumerate(dict.fromkeys(sources))}
    repeated = (c for c, n in Counter(clusters).items() if n > 1)
    cluster_bit = {c: 1 << i for i, c in enumerate(repeated)}
    room_of: list[list[int]] = [[] for _ in range(capacity + 1)]
    filled = 0  # bit r: some bin has room r
    has_source: list[int] = []
    has_cluster: list[int] = []
    out = []
    for n, s, c in zip(sizes, sources, clusters, strict=True):
        sb, cb = source_bit[s], cluster_bit.get(c, 0)
        room, found = n, -1
        while found < 0 and (above := filled >> room):
            room += (above & -above).bit_length() - 1
            found = next((k for k, b in enumerate(room_of[room]) if not (has_source[b] & sb or has_cluster[b] & cb)), -1)
            room += found < 0
        if found < 0:
            b, room = len(has_source), capacity
            has_source.append(0)
            has_cluster.append(0)
        else:
            b = room_of[room].pop(found)
            if not room_of[room]:
                filled &= ~(1 << room)
        has_source[b] |= sb
        has_cluster[b] |= cb
        room_of[room - n].append(b)
        filled |= 1 << room - n
        out.append(b)
    return out


def _rows(docs: DataFrame, cluster: str | None) -> DataFrame:
    of = F.col(cluster).cast("long") if cluster else F.lit(None).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("source").cast("string").alias("source"), of.alias("cluster"))


def token_counts(docs: DataFrame, path: str, cluster: str | None = None) -> DataFrame:
    """doc_id, source, cluster, n_tokens. Without a cluster column, equal words in equal order make a cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = counter(path)
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                x = whole.slice(start, 1024)
                texts = x.column("text").to_pylist()
                counts = pa.array(encoder.count(texts), pa.int64())
                key = x.column("cluster") if cluster else pa.array([xxhash.xxh64_intdigest(" ".join((t or "").lower().split()).encode("utf-8", "replace")) - (1 << 63) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([x.column("doc_id"), x.column("source"), key, counts], names=["doc_id", "source", "cluster", "n_tokens"])

    return _rows(docs, cluster).mapInArrow(run, "doc_id bigint, source string, cluster bigint, n_tokens bigint")


def near_copy_counts(docs: DataFrame, path: str) -> DataFrame:
    """token_counts() with the classes of near_duplicates() as clusters: one row per input row, no join on ids.

    A row without an id or an equal that has one has a null cluster. Tokens are counted where sets are drawn, so
    that texts are read once for both.
    """
    rows = _rows(docs, None).drop("cluster")

    def draw():
        encoder = counter(path)
        return lambda texts: encoder.count([t.decode("utf-8", "surrogatepass") for t in texts])

    sig = materialize(signatures(rows, WIDTH, ("n_tokens", draw)), "signatures")
    out = with_components(rows, sig, WIDTH, PERCENT)
    return out.select("doc_id", "source", F.col("component_id").alias("cluster"), "n_tokens")


def pack(docs: DataFrame, capacity: int = CAPACITY, group: int = GROUP, cluster: str | None = None, path: str | None = None, near: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, n_tokens, bin, offset.

    Needs doc_id, text and source. A text over the capacity is cut into pieces of it; a text without tokens (or
    null) is a piece of none. No bin holds two pieces of one source or of one duplicate cluster (a null source or
    cluster counts as one like any other). Pieces are dealt by hash into groups of about `group`, which are packed apart, largest first;
    bins belong to one group, so conflicts hold everywhere. Repeated rows are packed each for itself; an empty
    table gives an empty table. With `near`, near copies make a cluster (see near_copy_counts()).
    """
    path = path or ranks()
    counts = materialize(near_copy_counts(docs, path) if near else token_counts(docs, path, cluster), "token-counts")
    # Rows are told apart by their place in the written counts: those without an id, or of one id, are dealt like any others.
    counts = counts.withColumn("_row", F.monotonically_increasing_id())
    pieces = counts.select("_row", "doc_id", "source", "cluster", "n_tokens", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n_tokens") / capacity) - 1, F.lit(0)).cast("int"))).alias("piece"))
    start = F.col("piece") * F.lit(capacity).cast("long")
    pieces = pieces.select("_row", "doc_id", "source", "cluster", "piece", start.alias("start"), F.least(F.col("n_tokens") - start, F.lit(capacity)).alias("n"))
    groups = max(1, -(-pieces.count() // group))
    dealt = pieces.withColumn("g", F.pmod(F.xxhash64("_row", "piece"), F.lit(groups))).drop("_row")

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("n", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("cluster", "ascending")])
        sizes, g = rows.column("n").to_pylist(), rows.column("g")[0].as_py()
        bins = best_fit(sizes, rows.column("source").to_pylist(), rows.column("cluster").to_pylist(), capacity)
        used: Counter[int] = Counter()
        offsets = []
        for b, n in zip(bins, sizes, strict=True):
            offsets.append(used[b])
            used[b] += n
        return pa.table({"doc_id": rows.column("doc_id"), "piece": rows.column("piece"), "start": rows.column("start"), "n_tokens": rows.column("n"), "bin": pa.array([(g << 32) + b for b in bins], pa.int64()), "offset": pa.array(offsets, pa.int64())})

    return dealt.groupBy("g").applyInArrow(run, "doc_id bigint, piece int, start bigint, n_tokens bigint, bin bigint, offset bigint")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every piece of every document; near copies never share a bin."""
    return pack(table(spark, sf_dir, "documents"), near=True)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the places of all pieces. Of near copies an earlier stage has kept one.

    A row per piece as pack() has it; repeated rows and rows without an id or a text are packed each for itself, other
    columns are not read, an empty table gives an empty one.
    """
    return pack(docs)


QUERIES = {"op7_packing": op7_packing}
ORACLES = {}
