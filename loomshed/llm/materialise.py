"""Training order on disk: every token sequence gets a global slot by a keyed Feistel permutation.

1. Texts are tokenised once, where they lie, and their ids staged in the shared
   folder, bucketed by the partition that made them. Only headers (partition,
   row, doc_id, tie, number of ids) are shuffled: sorted by document and summed
   in two levels, by range and inside a range, they give each document the
   place of its first id in the stream of all documents, in id order. The
   places go back to the staged ids by a join on the bucketed key, which moves
   the headers alone.
2. The stream is cut every ``length`` ids, through documents, each of which ends
   with an ``end`` mark, so that no sequence but the last is padded. A
   sequence's index depends on the documents alone, not on how many tasks there were.
3. A keyed Feistel network permutes [0, 2^(2h)); walking its cycle until the
   value is below N makes it a permutation of [0, N), so every index has one
   slot and no table of a shuffle is kept anywhere.
4. Each task packs the pieces it holds of one shard into one compressed row.
   These rows are shuffled once, to the partition that a range of shards has by
   arithmetic, and each shard is one file of fixed-stride records: ids as
   little-endian 16-bit words, then a newline byte, which Spark's text writer
   puts at the end of every record. Record r of shard s is slot
   s * shard_size + r, at byte r * stride: a reader resumes by arithmetic.

On disk at once are the staged ids, the shuffled pieces (both compressed) and
the shards. A writer holds one shard in memory; a shard with a missing or a
doubled piece raises.

Defined results: null and empty texts have no ids and no mark; the last
sequence is padded with ``pad``; repeated rows are documents of their own, in
an order fixed by their text; null ids come first; ids that do not fit below
``end`` raise; an empty table writes no shard.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from loomshed.llm.bpe import encode, encoder
from loomshed.llm.common import drop_path, free, scratch, settings, shuffles_dropped, stored


@dataclass(frozen=True)
class Layout:
    """Ids a sequence, sequences a shard, the ids that pad and end a document, the permutation's key and rounds."""

    length: int = 256
    shard: int = 16_384
    pad: int = 65_535
    end: int = 65_534
    key: int = 20_240_601
    rounds: int = 6

    @property
    def stride(self) -> int:
        return 2 * self.length + 1


#: Bytes of pieces that a task gathers before it packs them by shard.
GATHERED = 24 << 20
#: Partitions that shards are dealt to, at most.
MOST_PARTITIONS = 100_000


def half_bits(n: int) -> int:
    """Bits of a Feistel half for a domain of ``n``: 2^(2h) is at least n, less than 4n for n over 1."""
    h = 1
    while 1 << (2 * h) < n:
        h += 1
    return h


def _round_keys(layout: Layout) -> list[int]:
    return [int.from_bytes(hashlib.sha256(f"{layout.key}:{r}".encode()).digest()[:8], "little") for r in range(layout.rounds)]


def permute(index, n: int, layout: Layout = Layout()):
    """Slots of an array of indexes in [0, n): Feistel passes, walked until below n."""
    import numpy as np

    h = half_bits(n)
    mask, keys = np.uint64((1 << h) - 1), _round_keys(layout)

    def once(x):
        left, right = x >> np.uint64(h), x & mask
        for k in keys:
            f = (right + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)
            f = (f ^ (f >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            f ^= f >> np.uint64(32)
            left, right = right, (left ^ f) & mask
        return (left << np.uint64(h)) | right

    x = once(np.asarray(index).astype(np.uint64))
    while (over := np.flatnonzero(x >= np.uint64(n))).size:
        x[over] = once(x[over])
    return x.astype(np.int64)


STAGED = "pid int, r long, doc_id long, tie long, n long, ids binary"


def tokenised(docs: DataFrame, tokenise: Callable[[], Callable[[str], bytes]], layout: Layout) -> DataFrame:
    """(pid, r, doc_id, tie, n, ids) of every row that has ids: where it lies, and its ids with the end mark.

    ``tokenise`` is called once in each worker task; what it returns gives a text's ids as 16-bit words.
    """
    mark = layout.end.to_bytes(2, "little")

    def run(batches):
        import numpy as np

        ids_of, pid, r = tokenise(), TaskContext.get().partitionId(), 0
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                rows: list[tuple] = []
                for doc, text, tie in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    data = ids_of(text or "")
                    if not data:
                        continue
                    words = np.frombuffer(data, "<u2")
                    if ((words == layout.end) | (words == layout.pad)).any():
                        raise ValueError(f"document {doc} has an id that marks the end or pads")
                    rows.append((pid, r, doc, tie, len(words) + 1, data + mark))
                    r += 1
                columns = list(zip(*rows, strict=True)) if rows else [()] * 6
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["pid", "r", "doc_id", "tie", "n", "ids"]
                )

    rows = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text", "xxhash64(text) tie")
    return rows.mapInArrow(run, STAGED)


def places(headers: DataFrame) -> tuple[DataFrame, int]:
    """(pid, r, place) of every header (pid, r, doc_id, tie, n), and the number of all ids.

    ``place`` is the sum of n before a row in the order of (doc_id, tie): summed inside ranges of
    that order, then over ranges, of which one number each is gathered.
    """

    def run(batches):
        import numpy as np

        part, total = TaskContext.get().partitionId(), 0
        for b in batches:
            n = b.column(2).to_numpy()
            ends = np.cumsum(n) + total
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(ends - n), b.column(2), pa.array(np.full(len(n), part), pa.int32())],
                names=["pid", "r", "local", "n", "part"],
            )
            total = int(ends[-1]) if len(ends) else total

    order = [F.col("doc_id").asc_nulls_first(), "tie", "pid", "r"]
    ranged = headers.repartitionByRange(*order).sortWithinPartitions(*order).select("pid", "r", "n")
    local = stored(ranged.mapInArrow(run, "pid int, r long, local long, n long, part int"), "places")
    sums = local.groupBy("part").agg(F.sum("n").alias("n"))
    total = sums.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    ahead = F.sum("n").over(Window.orderBy("part")) - F.col("n")
    rows = local.join(F.broadcast(sums.select("part", ahead.alias("ahead"))), "part").select(
        "pid", "r", (F.col("ahead") + F.col("local")).alias("place")
    )
    rows._scratch_path = local._scratch_path
    return rows, total


def _pack(pieces: list[tuple[int, bytes]]) -> bytes:
    """Pieces (first id in the shard, ids) of one shard as one compressed block."""
    import numpy as np
    import zstandard

    at = np.array([p[0] for p in pieces], "<u4").tobytes()
    sizes = np.array([len(p[1]) // 2 for p in pieces], "<u4").tobytes()
    data = len(pieces).to_bytes(4, "little") + at + sizes + b"".join(p[1] for p in pieces)
    return zstandard.ZstdCompressor(level=3).compress(data)


def _unpack(block: bytes) -> Iterator[tuple[int, bytes]]:
    import numpy as np
    import zstandard

    data = zstandard.ZstdDecompressor().decompress(block)
    n = int.from_bytes(data[:4], "little")
    at, sizes = np.frombuffer(data, "<u4", n, 4), np.frombuffer(data, "<u4", n, 4 + 4 * n)
    ends = 4 + 8 * n + 2 * np.cumsum(sizes, dtype=np.int64)
    for a, start, end in zip(at.tolist(), (ends - 2 * sizes.astype(np.int64)).tolist(), ends.tolist(), strict=True):
        yield a, data[start:end]


def packed(rows: DataFrame, n: int, layout: Layout) -> DataFrame:
    """(shard, block): the pieces of the ``n`` sequences that each task holds of (place, ids), packed by shard."""
    length = layout.length

    def run(batches):
        import numpy as np

        held: dict[int, list] = defaultdict(list)
        size = 0

        def flush() -> pa.RecordBatch:
            shards = sorted(held)
            out = pa.RecordBatch.from_arrays(
                [pa.array(shards, pa.int64()), pa.array([_pack(held[s]) for s in shards], pa.binary())], names=["shard", "block"]
            )
            held.clear()
            return out

        for batch in batches:
            first = batch.column(0).to_numpy()
            ids = batch.column(1).to_pylist()
            counts = np.array([len(d) // 2 for d in ids], np.int64)
            # Sequences that each document touches, all in one array.
            low, high = first // length, (first + counts - 1) // length
            each = high - low + 1
            owner = np.repeat(np.arange(len(ids)), each)
            seq = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + low[owner]
            start = np.maximum(seq * length, first[owner])
            stop = np.minimum((seq + 1) * length, (first + counts)[owner])
            slot = permute(seq, n, layout)
            shard = slot // layout.shard
            at = slot % layout.shard * length + start - seq * length
            for o, k, a, b, e in zip(
                owner.tolist(),
                shard.tolist(),
                at.tolist(),
                (2 * (start - first[owner])).tolist(),
                (2 * (stop - first[owner])).tolist(),
                strict=True,
            ):
                held[k].append((a, ids[o][b:e]))
                size += e - b
                if size >= GATHERED:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return rows.select("place", "ids").mapInArrow(run, "shard long, block binary")


def _records(blocks: DataFrame, total: int, layout: Layout) -> DataFrame:
    """(shard, value) of every record, in order, from blocks that are partitioned and sorted by shard."""
    whole, n = layout.shard * layout.length, -(-total // layout.length)
    short = int(permute([n - 1], n, layout)[0]) // layout.shard  # the shard of the last sequence, the only one that is padded

    def run(batches):
        import numpy as np

        now, ids, filled = None, None, 0

        def records() -> pa.RecordBatch:
            rows = min(layout.shard, n - now * layout.shard)
            want = rows * layout.length - (n * layout.length - total if now == short else 0)
            if filled != want:
                raise ValueError(f"shard {now} has {filled} ids of {want}")
            data, width = ids.tobytes(), 2 * layout.length
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([now] * rows, pa.int64()),
                    pa.array([data[a * width : (a + 1) * width] for a in range(rows)], pa.binary()),
                ],
                names=["shard", "value"],
            )

        for batch in batches:
            for k, block in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if k != now:
                    if now is not None:
                        yield records()
                    now, ids, filled = k, np.full(whole, layout.pad, "<u2"), 0
                for at, piece in _unpack(block.as_py()):
                    ids[at : at + len(piece) // 2] = np.frombuffer(piece, "<u2")
                    filled += len(piece) // 2
        if now is not None:
            yield records()

    return blocks.mapInArrow(run, "shard long, value binary")


#: Rows that go to a Python worker at once: a row may be a long text, or a packed block.
BATCH_ROWS = 1000
#: How staged ids are held: well packed, for they lie beside the shards, and in row groups that take little memory.
_STAGED_AS = {
    "compression": "zstd",
    "parquet.compression.codec.zstd.level": "9",
    "parquet.page.size": str(4 << 20),
    "parquet.block.size": str(32 << 20),
}


def write_shards(docs: DataFrame, path: str, tokenise: Callable[[], Callable[[str], bytes]], layout: Layout = Layout()) -> int:
    """Write every sequence below ``path`` as shard=<k>/ files; returns how many sequences there are."""
    spark = docs.sparkSession
    stage, name = scratch(spark, "token-ids"), f"loomshed_{uuid.uuid4().hex}"
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    with settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch=str(BATCH_ROWS)):
        try:
            staged = tokenised(docs, tokenise, layout).write.bucketBy(buckets, "pid").format("parquet")
            staged.options(path=stage, **_STAGED_AS).saveAsTable(name)
            return _write_staged(spark.table(name), path, layout)
        finally:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
            drop_path(spark, stage)


def _write_staged(ids: DataFrame, path: str, layout: Layout) -> int:
    """Shards of staged ids (as ``tokenised``, bucketed by pid)."""
    spark = ids.sparkSession
    placed, total = places(ids.select("pid", "r", "doc_id", "tie", "n"))
    n = -(-total // layout.length)
    if n:
        shards = -(-n // layout.shard)
        parts = min(shards, MOST_PARTITIONS)
        part = F.expr(f"cast(shard * {parts} div {shards} as int)")
        # Staged rows stay in their buckets; only the places are shuffled to them.
        with settings(spark, spark__sql__requireAllClusterKeysForCoPartition="false"), shuffles_dropped(spark):
            rows = ids.select("pid", "r", "ids").join(placed.hint("shuffle_hash"), ["pid", "r"])
            blocks = packed(rows, n, layout).repartitionById(parts, part).sortWithinPartitions("shard")
            values = _records(blocks, total, layout).select("shard", F.col("value").cast("string").alias("value"))
            values.write.partitionBy("shard").option("lineSep", "\n").text(path)
    free(placed)
    return n


def read_shards(spark: SparkSession, path: str, layout: Layout = Layout(), start: int = 0) -> DataFrame:
    """(slot, ids) from slot ``start`` on; whole shards before it are never opened."""
    width, stride, shard = 2 * layout.length, layout.stride, layout.shard

    def run(batches):
        for batch in batches:
            for k, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = content.as_py()
                if len(data) % stride:
                    raise ValueError(f"shard {k} is cut short")
                first = max(0, start - k * shard)
                at = range(first * stride, len(data), stride)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(range(k * shard + first, k * shard + len(data) // stride), pa.int64()),
                        pa.array([data[a : a + width] for a in at], pa.binary()),
                    ],
                    names=["slot", "ids"],
                )

    files = spark.read.format("binaryFile").load(path)
    return files.filter(F.col("shard") >= start // shard).select(F.col("shard").cast("long"), "content").mapInArrow(
        run, "slot long, ids binary"
    )


def byte_pair_tokeniser(ranks: bytes, pattern: str) -> Callable[[], Callable[[str], bytes]]:
    """Tokeniser factory for ``tokenised``: byte-level BPE by a rank file."""

    def make() -> Callable[[str], bytes]:
        import numpy as np

        enc = encoder(ranks, pattern)
        if enc.n_vocab > 1 << 16:
            raise ValueError(f"{enc.n_vocab} ids do not fit 16 bits")
        return lambda text: np.array(encode(enc, text), "<u2").tobytes()

    return make
