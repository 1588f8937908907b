"""Content-defined chunking of media payloads, deduplicated, with verified reconstruction.

A payload is stored as a binary greyscale picture (PGM, 8-bit samples, 576 a
row). The picture's bytes are cut where a rolling gear hash of the last 32
bytes has zeros under a mask, so equal passages give equal chunks wherever they
stand. Chunks seen more than once are kept once, in a chunk table; chunks seen
once stay inside their picture's ordered chunk list, where keeping them apart
would only add a shuffle of the whole corpus.

Which chunks are shared is counted by digest (headers only, map-side sums), and
a Bloom filter of the shared digests goes to the tasks that write. This departs
from deduplicating by joins alone: a join of all digests back to the texts would
shuffle the whole corpus, and so more disk than it takes itself. The filter is of
bounded size (``Chunking.bloom_bits``, 16 bits a shared digest serve well), and a
false positive merely sends a chunk the shared way: with a filter that is too
small, or full, all chunks go there, more slowly and with the same result. A task
writes the data of a shared chunk beside the first picture that holds it, and one
grouping by digest of what tasks have written makes the chunk table, so each
picture is cut twice, to count and to write. Reading back joins the shared references to the chunk
table: the few digests that hold a large share of all references (at most
``Chunking.heavy``, a bounded table) by broadcast, the rest by a shuffle of the
references. Pictures without shared chunks are rebuilt where they lie. Every
rebuilt picture is checked against its recorded digest.

Defined results: null and empty texts are one row of 576 bytes 255; rows with
one doc_id and equal texts are rebuilt each; null ids are kept; an empty table
gives an empty one. Results depend on the text alone.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loomshed.llm.common import stored

WIDTH = 576


@dataclass(frozen=True)
class Chunking:
    """Least, typical and most bytes of a chunk (typical: a power of two), and the bounds of what is broadcast."""

    least: int = 256
    typical: int = 1024
    most: int = 8192
    bloom_bits: int = 1 << 26
    heavy: int = 400


def _gear():
    """256 fixed pseudo-random 32-bit words, one a byte value."""
    import numpy as np

    return np.random.default_rng(7919).integers(0, 1 << 32, 256, np.uint32)


_table: list = []


def gear_hashes(data: bytes):
    """Rolling gear hash after every byte: h = (h << 1) + gear[byte], in 32 bits, so of the last 32 bytes.

    The sum over a window is built by doubling: windows of 1, 2, 4, ... 32 bytes.
    """
    import numpy as np

    if not _table:
        _table.append(_gear())
    h = _table[0][np.frombuffer(data, np.uint8)]
    for width in (1, 2, 4, 8, 16):
        nxt = h.copy()
        nxt[width:] += h[:-width] << np.uint32(width)
        h = nxt
    return h


def cuts(data: bytes, spec: Chunking = Chunking()) -> list[int]:
    """Ends of the chunks of ``data``, the last its length."""
    import numpy as np

    n = len(data)
    if n <= spec.least:
        return [n]
    # High bits of the hash mix the whole window.
    mask = np.uint32((spec.typical - 1) << (32 - spec.typical.bit_length() + 1))
    marks = np.flatnonzero((gear_hashes(data) & mask) == 0) + 1
    out, start, at = [], 0, 0
    while n - start > spec.least:
        at = int(np.searchsorted(marks, start + spec.least))
        end = int(marks[at]) if at < len(marks) else n
        end = min(end, start + spec.most, n)
        out.append(end)
        start = end
    if start < n:
        out.append(n)
    return out


def chunks(data: bytes, spec: Chunking = Chunking()) -> list[bytes]:
    ends = cuts(data, spec)
    return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def payload_of(text: str | None) -> bytes:
    """UTF-8, then bytes 255 up to a positive multiple of a row."""
    raw = (text or "").encode()
    return raw + b"\xff" * (WIDTH - len(raw) % WIDTH if len(raw) % WIDTH or not raw else 0)


def to_picture(payload: bytes) -> bytes:
    return b"P5\n%d %d\n255\n" % (WIDTH, len(payload) // WIDTH) + payload


def from_picture(data: bytes) -> bytes:
    """The payload of a picture, its header checked."""
    magic, size, depth, payload = data.split(b"\n", 3)
    width, height = map(int, size.split())
    if magic != b"P5" or depth != b"255" or width != WIDTH or len(payload) != width * height:
        raise ValueError("not a picture of this store")
    return payload


class Bloom:
    """Membership of digests; bits are taken from the digest itself."""

    PROBES = 4

    def __init__(self, bits: int, words: bytes):
        import numpy as np

        self.bits, self.words = bits, np.frombuffer(words, np.uint64)

    def __contains__(self, digest: bytes) -> bool:
        for i in range(self.PROBES):
            at = int.from_bytes(digest[4 * i : 4 * i + 4], "big") % self.bits
            if not int(self.words[at >> 6]) >> (at & 63) & 1:
                return False
        return True


def bloom_of(digests: DataFrame, count: int, most_bits: int) -> Bloom:
    """Bloom filter of a (digest) table. Words are or-ed by Spark; at most ``most_bits`` / 64 of them reach the driver."""
    import numpy as np

    bits = 64
    while bits < min(most_bits, 16 * max(count, 1)):
        bits *= 2
    at = [F.conv(F.hex(F.substring("digest", 4 * i + 1, 4)), 16, 10).cast("long") % bits for i in range(Bloom.PROBES)]
    rows = digests.select(F.explode(F.array(*at)).alias("at")).groupBy(F.shiftright("at", 6).alias("w")).agg(
        F.expr("bit_or(shiftleft(1L, cast(at % 64 as int)))").alias("m")
    )
    words = np.zeros(max(bits // 64, 1), np.int64)
    for batch in rows.toArrow().to_batches():
        words[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    return Bloom(bits, words.tobytes())


def _pictures(batch) -> list[bytes]:
    return [to_picture(payload_of(t)) for t in batch.column(1).to_pylist()]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")


def shared_digests(docs: DataFrame, spec: Chunking) -> DataFrame:
    """(digest, n) of the chunks that occur more than once."""

    def run(batches):
        for batch in batches:
            seen: dict[bytes, int] = {}
            for picture in _pictures(batch):
                for c in chunks(picture, spec):
                    d = hashlib.sha256(c).digest()
                    seen[d] = seen.get(d, 0) + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["digest", "n"]
            )

    return _texts(docs).mapInArrow(run, "digest binary, n long").groupBy("digest").agg(F.sum("n").alias("n")).filter("n > 1")


_CARRIED = pa.list_(pa.struct([("digest", pa.binary()), ("data", pa.binary())]))


@dataclass
class Store:
    """``recipes``: (doc_id, media_sha256, digests, inline), where inline is null for shared chunks; ``shared``: (digest, data)."""

    recipes: DataFrame
    shared: DataFrame
    heavy: DataFrame


def write_store(docs: DataFrame, spec: Chunking = Chunking()) -> Store:
    """Chunk every text of ``docs`` (doc_id, text) into the shared folder."""
    spark = docs.sparkSession
    counts = stored(shared_digests(docs, spec), "shared-digests")
    told = counts.agg(F.count(F.lit(1)).alias("c"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    bloom = spark.sparkContext.broadcast(bloom_of(counts.select("digest"), told["c"], spec.bloom_bits))

    def recipes(batches):
        sent: set[bytes] = set()
        known = bloom.value
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for at in range(0, len(ids), 500):
                part = batch.slice(at, 500)
                shas, digests, inline, carried = [], [], [], []
                for picture in _pictures(part):
                    cs = chunks(picture, spec)
                    ds = [hashlib.sha256(c).digest() for c in cs]
                    away = [d in known for d in ds]
                    new = {d: c for c, d, a in zip(cs, ds, away, strict=True) if a and d not in sent}
                    sent.update(new)
                    if len(sent) > 200_000:  # a chunk written twice meets itself in the chunk table
                        sent.clear()
                    shas.append(hashlib.sha256(picture).hexdigest())
                    digests.append(ds)
                    inline.append([None if a else c for c, a in zip(cs, away, strict=True)])
                    carried.append([{"digest": d, "data": c} for d, c in new.items()])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(shas, pa.string()),
                        pa.array(digests, pa.list_(pa.binary())),
                        pa.array(inline, pa.list_(pa.binary())),
                        pa.array(carried, _CARRIED),
                    ],
                    names=["doc_id", "media_sha256", "digests", "inline", "carried"],
                )

    kept = stored(
        _texts(docs).mapInArrow(
            recipes,
            "doc_id long, media_sha256 string, digests array<binary>, inline array<binary>, carried array<struct<digest:binary,data:binary>>",
        ),
        "recipes",
    )
    bloom.destroy()
    carried_ = kept.select(F.explode("carried").alias("c")).select("c.digest", "c.data")
    table = stored(carried_.groupBy("digest").agg(F.first("data").alias("data")), "chunks")
    kept, carried_path = kept.drop("carried"), kept._scratch_path
    kept._scratch_path = carried_path
    heavy = counts.filter(F.col("n") > told["n"] / spec.heavy).select("digest")
    return Store(kept, table, heavy)


_BUILT = "doc_id long, media_sha256 string, data binary"


def _build(rows: DataFrame, then, schema: str) -> DataFrame:
    """Apply ``then(picture, n_chunks)`` to each rebuilt picture of (doc_id, media_sha256, inline, parts)."""

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                found = {p["seq"]: p["data"] for p in row["parts"] or ()}
                picture = b"".join(found[i] if c is None else c for i, c in enumerate(row["inline"]))
                if hashlib.sha256(picture).hexdigest() != row["media_sha256"]:
                    raise ValueError(f"document {row['doc_id']} was not rebuilt as it was stored")
                out.append({"doc_id": row["doc_id"], **then(picture, len(row["inline"]))})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[t]) for n, t in (f.split() for f in schema.split(", "))]))

    return rows.mapInArrow(run, schema)


def describe(picture: bytes, n_chunks: int) -> dict:
    """Features of a picture, all from the bytes read back."""
    import numpy as np

    payload = from_picture(picture)
    samples = np.frombuffer(payload, np.uint8)
    coarse = np.bincount(samples >> 5, minlength=8)
    return {
        "n_bytes": len(payload.rstrip(b"\xff")),
        "payload_bytes": len(payload),
        "payload_sha256": hashlib.sha256(payload).hexdigest(),
        "tail_crc32": zlib.crc32(payload[-32:]),
        "media_bytes": len(picture),
        "media_sha256": hashlib.sha256(picture).hexdigest(),
        "feature": f"rows={len(payload) // WIDTH};chunks={n_chunks};sum={int(samples.sum(dtype=np.int64))};hist=" + ",".join(map(str, coarse.tolist())),
    }


DESCRIBED = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def rebuild(store: Store, then=describe, schema: str = DESCRIBED) -> DataFrame:
    """Rebuild every picture from its ordered chunk list and apply ``then``."""
    rows = store.recipes.withColumn("shared", F.exists("inline", lambda c: c.isNull()))
    whole = rows.filter(~F.col("shared")).select(
        "doc_id", "media_sha256", "inline", F.lit(None).cast("array<struct<seq:int,data:binary>>").alias("parts")
    )
    part = rows.filter("shared").withColumn("key", F.concat_ws(":", F.col("doc_id").cast("string"), "media_sha256"))
    lists = part.select(
        "key",
        F.filter(
            F.transform(
                "digests",
                lambda d, i: F.struct(i.alias("seq"), d.alias("digest"), F.element_at("inline", i + 1).isNull().alias("away")),
            ),
            lambda s: s["away"],
        ).alias("away"),
    ).dropDuplicates(["key"])
    refs = lists.select("key", F.explode("away").alias("r")).select("key", "r.seq", "r.digest")
    heavy = F.broadcast(store.shared.join(F.broadcast(store.heavy), "digest"))  # at most spec.heavy chunks of spec.most bytes
    light = refs.join(F.broadcast(store.heavy), "digest", "left_anti").join(store.shared, "digest")
    parts = refs.join(heavy, "digest").select("key", "seq", "data").unionByName(light.select("key", "seq", "data"))
    gathered = parts.groupBy("key").agg(F.collect_list(F.struct("seq", "data")).alias("parts"))
    joined = part.join(gathered, "key").select("doc_id", "media_sha256", "inline", "parts")
    return _build(whole, then, schema).unionByName(_build(joined, then, schema))


def identity(picture: bytes, n_chunks: int) -> dict:
    """For readers who want the bytes."""
    return {"media_sha256": hashlib.sha256(picture).hexdigest(), "data": picture}


def read_media(store: Store) -> DataFrame:
    """(doc_id, media_sha256, data) of every picture, verified."""
    return rebuild(store, identity, _BUILT)
