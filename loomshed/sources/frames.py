"""Frame files: scans of trees, and their TIFF facts."""

from __future__ import annotations

import functools
import hashlib
import posixpath
import re
import struct

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from loomshed.functions.hashing import crc32c_many
from loomshed.scratch import many
from loomshed.sources import tiff, trees


_FRAME = r"(?i)\.dng$"


#: Bytes of files whose digests are made together, about.
TOGETHER = 8 << 20


@functools.lru_cache(64)
def _opened(root: str):
    return trees.opened(root)


@functools.partial(F.udf, returnType=T.BinaryType(), useArrow=False)
def _content(root: str, rel: str) -> bytes:
    fs, path = _opened(root)
    with fs.open_input_stream(posixpath.join(path, rel)) as f:
        return f.read()


def files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(rel, clip, name, stem, length, modified, root, content) of all files below ``root``, shadow files left out.

    Executors list the tree when this is called. Content is read only if used; ``digests`` and ``seen`` read files
    where they lie instead. A root that only Spark's readers can open is listed by them, on the driver, and has no ``root``.
    """
    try:
        trees.opened(root)
    except pa.ArrowInvalid:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
        rel = F.regexp_replace("path", "^.*?" + re.escape(root.rstrip("/").split("/")[-1]) + "/", "")
        found = found.select(rel.alias("rel"), "length", F.col("modificationTime").alias("modified"), "content")
        last = []
    else:
        found = trees.dealt(trees.listed(spark, root, glob)).withColumn("root", F.lit(root))
        found, last = found.withColumn("content", _content("root", "rel")), ["root"]
    name = F.substring_index("rel", "/", -1)
    return many(
        found.filter(~name.startswith("._")).select(
            "rel",
            F.regexp_extract("rel", "^(.*)/[^/]*$", 1).alias("clip"),
            name.alias("name"),
            F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"),
            "length",
            "modified",
            *last,
            "content",
        )
    )


def digests(found: DataFrame, crc: bool = False) -> DataFrame:
    """(rel, clip, stem, d_size, d_sha256) of scanned files, and with ``crc`` d_crc32c, a number; read where they lie, once."""
    if "root" not in found.columns:
        from loomshed.functions import hashing

        more = [hashing.crc32c("content").alias("d_crc32c")] if crc else []
        return found.select(
            "rel", "clip", "stem", F.col("length").alias("d_size"), hashing.sha256(F.col("content")).alias("d_sha256"), *more
        )
    schema = "rel string, clip string, stem string, d_size long, d_sha256 string" + ", d_crc32c long" * crc

    def run(batches):
        for batch in batches:
            told, data, size = [], [], 0

            def out():
                columns = [*zip(*told, strict=True)] if told else [[]] * 5
                arrays = [pa.array(list(c), pa.int64() if i == 3 else pa.string()) for i, c in enumerate(columns)]
                names = ["rel", "clip", "stem", "d_size", "d_sha256"]
                if crc:
                    arrays, names = [*arrays, pa.array(crc32c_many(data), pa.int64())], [*names, "d_crc32c"]
                return pa.RecordBatch.from_arrays(arrays, names=names)

            for root, rel, clip, stem in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, path = _opened(root)
                h, n = hashlib.sha256(), 0
                with fs.open_input_stream(posixpath.join(path, rel)) as f:
                    if crc:
                        data.append(f.read())
                        h.update(data[-1])
                        n = len(data[-1])
                    else:
                        while chunk := f.read(trees.CHUNK):
                            h.update(chunk)
                            n += len(chunk)
                told.append((rel, clip, stem, n, h.hexdigest()))
                size += n
                if size >= TOGETHER:
                    yield out()
                    told, data, size = [], [], 0
            yield out()

    return found.select("root", "rel", "clip", "stem").mapInArrow(run, schema)


def seen(found: DataFrame, sha: bool = False) -> DataFrame:
    """(rel, clip, stem, facts, src_sha) of scanned frames; facts are read by ranges, and without ``sha`` the rest is not."""
    if "root" not in found.columns:
        digest = F.sha2("content", 256) if sha else F.lit(None).cast("string")
        return found.select("rel", "clip", "stem", facts("content").alias("facts"), digest.alias("src_sha"))
    texts = [("rel", pa.string()), ("clip", pa.string()), ("stem", pa.string())]
    out = pa.schema([*texts, ("facts", pa.struct(list(trees.arrow(FACTS)))), ("src_sha", pa.string())])

    def run(batches):
        for batch in batches:
            told = []
            for row in batch.to_pylist():
                fs, path = _opened(row["root"])
                where, h = posixpath.join(path, row["rel"]), hashlib.sha256()
                with fs.open_input_file(where) as f:
                    told_of = facts_of(trees.Ranges(f, f.size()))
                    if sha:
                        f.seek(0)
                        while chunk := f.read(trees.CHUNK):
                            h.update(chunk)
                names = {k: row[k] for k in ("rel", "clip", "stem")}
                told.append(names | {"facts": told_of, "src_sha": h.hexdigest() if sha else None})
            yield pa.RecordBatch.from_pylist(told, schema=out)

    kinds = T.StructType([*[T.StructField(n, T.StringType()) for n, _ in texts], T.StructField("facts", FACTS), T.StructField("src_sha", T.StringType())])
    return found.select("root", "rel", "clip", "stem").mapInArrow(run, kinds)


def scan(spark: SparkSession, root: str, glob: str = "*.[dD][nN][gG]") -> DataFrame:
    """Frames below ``root``, as ``files``."""
    return files(spark, root, glob).drop("name")


def split_members(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(frames, other files) of a scan of everything."""
    frame = F.col("name").rlike(_FRAME)
    return found.filter(frame), found.filter(~frame)


def encoded(found: DataFrame) -> DataFrame:
    """The encoded frames of a scan of everything; raises where there are none but planes of another codec."""
    frames, others = split_members(found)
    if not frames.limit(1).count() and others.filter(F.lower("name").endswith(".jxl")).limit(1).count():
        raise ValueError("only planes of the other codec are here")
    return frames


def sidecars(found: DataFrame) -> DataFrame:
    """(rel, clip, kind) of the checksum records of a scan: checksums, jxl-checksums or bake."""
    kind = F.when(
        F.col("name").endswith(".jxl-checksums.tsv"), "jxl-checksums"
    ).when(F.col("name").endswith(".checksums.tsv"), "checksums").when(F.col("name").endswith(".bake-manifest.tsv"), "bake")
    return found.select("rel", "clip", kind.alias("kind")).filter("kind is not null")


def mirror_records(found: DataFrame) -> DataFrame:
    """(rel, clip, kind) of offload manifests of a scan and of the records beside them: offload, ingest, members, sources."""
    kind = F.regexp_extract("name", r"\.(offload|ingest)-manifest\.tsv$|\.(members|sources)\.tsv$", 0)
    return found.select(
        "rel", "clip", F.regexp_extract(kind, "(offload|ingest|members|sources)", 1).alias("kind")
    ).filter("kind <> ''")


def top_folders(found: DataFrame) -> DataFrame:
    """(folder, files): first folders of a scan whose root holds no record, to be judged one by one."""
    return found.filter(F.col("clip") != "").groupBy(F.split_part("rel", F.lit("/"), F.lit(1)).alias("folder")).agg(
        F.count(F.lit(1)).alias("files")
    )


def totals(files: DataFrame) -> DataFrame:
    """Count and bytes, without reading content."""
    return files.agg(F.count(F.lit(1)).alias("frames"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def plane_groups(files: DataFrame) -> DataFrame:
    """Frames stored as four planes <stem>_p2_<nn>: which planes are missing, and their bytes together."""
    parts = files.select(
        "clip",
        F.regexp_extract("stem", r"^(.*)_p2_(00|01|10|11)$", 1).alias("stem"),
        F.regexp_extract("stem", r"_p2_(00|01|10|11)$", 1).alias("plane"),
        "length",
    ).filter("plane <> ''")
    want = F.array(*[F.lit(p) for p in ("00", "01", "10", "11")])
    return parts.groupBy("clip", "stem").agg(F.collect_set("plane").alias("have"), F.sum("length").alias("bytes")).select(
        "clip", "stem", "bytes", F.array_except(want, "have").alias("missing")
    )


_NUMBERS = {
    "width": 256, "height": 257, "bits": 258, "compression": 259, "photometric": 262, "tile_width": 322, "tile_height": 323
}
_TEXTS = {"make": 271, "model": 272}
_RATIOS = {"framerate": 51044, "exposure": 33434}
_ISO, _TIMECODE = 34855, 51043
FACTS = T.StructType(
    [
        *[T.StructField(n, T.IntegerType()) for n in _NUMBERS],
        *[T.StructField(n, T.StringType()) for n in (*_TEXTS, *_RATIOS, "iso")],
        T.StructField("timecode", T.BinaryType()),
        T.StructField("error", T.StringType()),
    ]
)


def facts_of(data) -> dict:
    """Facts of one frame's bytes, or of anything that is cut like them; a broken one gives its error."""
    row: dict = dict.fromkeys(FACTS.names)
    try:
        t = tiff.read(data)
        row |= {n: t.number(tag) for n, tag in _NUMBERS.items()} | {n: t.text(tag) for n, tag in _TEXTS.items()}
        row |= {n: "{}/{}".format(*r) for n, tag in _RATIOS.items() if (r := t.ratio(tag))}
        iso = t.number(_ISO)
        row |= {"iso": None if iso is None else str(iso), "timecode": t.raw(_TIMECODE)}
    except tiff.Broken as e:
        row["error"] = str(e)
    return row


@F.pandas_udf(FACTS)
def facts(content: pd.Series) -> pd.DataFrame:
    """Facts of each frame, from any of its directories; a broken file gives its error, never an exception.

    Rationals are ``n/d`` as they stand, not divided.
    """
    rows = [facts_of(bytes(data)) for data in content]
    return pd.DataFrame(rows, columns=FACTS.names).astype(dict.fromkeys(_NUMBERS, "Int32"))


RAW = T.StructType([*[T.StructField(n, T.LongType()) for n in tiff.NEEDED.values()], T.StructField("error", T.StringType())])


@F.pandas_udf(RAW)
def raw_frame(content: pd.Series) -> pd.DataFrame:
    """Numbers of frames that obey the strict rules; of others, the first rule broken."""
    rows = []
    for data in content:
        try:
            rows.append({**dict.fromkeys(RAW.names), **tiff.raw_frame(bytes(data))})
        except tiff.Broken as e:
            rows.append({**dict.fromkeys(RAW.names), "error": str(e)})
    return pd.DataFrame(rows, columns=RAW.names).astype(dict.fromkeys(tiff.NEEDED.values(), "Int64"))


def metadata_columns(f: str = "facts", timecode: Column | None = None) -> list[Column]:
    """Timecode text, framerate, iso and exposure as strings, '' for what a frame does not say."""

    def c(n):
        return F.col(f"{f}.{n}")

    parts = (timecode if timecode is not None else F.lit(None).cast("string"), c("framerate"), c("iso"), c("exposure"))
    return [F.coalesce(p, F.lit("")).alias(n) for p, n in zip(parts, ("timecode", "framerate", "iso", "exposure"), strict=True)]


# Frame width, height and depth (null: any), then tile width and height. All others have the default.
GRIDS = (
    (3024, 2010, None, 252, 252),
    (1936, 1090, 8, 242, 274),
    (1936, 1090, 10, 484, 274),
    (1936, 1090, 12, 242, 274),
    (2016, 1344, None, 252, 336),
    (3856, 2170, 10, 964, 272),
)
DEFAULT_GRID = (482, 272)
# Frame sizes of archives, at 8, 10 and 12 bits.
ARCHIVE_SIZES = ((3856, 2170), (1936, 1090), (2016, 1344), (3024, 2010))


def tile_dims(w: Column, h: Column, depth: Column) -> Column:
    """struct(tw, th) of a frame size and depth."""

    def pair(a, b):
        return F.struct(F.lit(a).alias("tw"), F.lit(b).alias("th"))

    out = F
    for fw, fh, d, tw, th in GRIDS:
        out = out.when((w == fw) & (h == fh) & (F.lit(True) if d is None else depth == d), pair(tw, th))
    return out.otherwise(pair(*DEFAULT_GRID))


def expected_tiles(w: Column, h: Column, tw: Column, th: Column) -> Column:
    """ceil(w/tw) ceil(h/th) in whole numbers; 0 for an empty tile."""

    def up(a, b):
        return F.floor((a + b - 1) / F.nullif(b, F.lit(0)))

    return F.when((tw > 0) & (th > 0), up(w, tw) * up(h, th)).otherwise(F.lit(0)).cast("long")


def archive_geometry(w: Column, h: Column, depth: Column) -> Column:
    size = F.lit(False)
    for a, b in ARCHIVE_SIZES:
        size = size | ((w == a) & (h == b))
    return F.coalesce(size & depth.isin(8, 10, 12), F.lit(False))


def frame_class(f: str = "facts"):
    """raw, camera-lossless, archive or unknown, from a facts column."""

    def c(n):
        return F.col(f"{f}.{n}")

    tiled = c("tile_width").isNotNull()
    camera = (c("width") == 3856) & (c("height") == 2170) & (c("tile_width") == 512) & (c("tile_height") == 368) & (
        c("bits") == 12
    )
    return F.coalesce(
        F.when((c("compression") == 1) & ~tiled, "raw").when(
            (c("compression") == 7) & tiled, F.when(camera, "camera-lossless").otherwise("archive")
        ),
        F.lit("unknown"),
    )


def parse_pam(data: bytes) -> tuple[int, int, list[int]]:
    """(width, height, samples) of a 12-bit grey P7 image with big-endian 16-bit samples; anything else raises."""
    head, mark, payload = data.partition(b"ENDHDR\n")
    words = head.decode("ascii").split()
    if not mark or words[:1] != ["P7"] or len(words) % 2 == 0:
        raise ValueError("not a P7 image")
    keys = dict(zip(words[1::2], words[2::2], strict=True))
    if set(keys) != {"WIDTH", "HEIGHT", "DEPTH", "MAXVAL", "TUPLTYPE"}:
        raise ValueError(f"keys {sorted(keys)}")
    if (keys["DEPTH"], keys["MAXVAL"], keys["TUPLTYPE"]) != ("1", "4095", "GRAYSCALE"):
        raise ValueError("not 12-bit grey")
    w, h = int(keys["WIDTH"]), int(keys["HEIGHT"])
    if w < 1 or h < 1 or len(payload) != 2 * w * h:
        raise ValueError(f"{len(payload)} bytes for {w}x{h}")
    return w, h, list(struct.unpack(f">{w * h}H", payload))


def render_pam(w: int, h: int, samples: list[int]) -> bytes:
    return f"P7\nWIDTH {w}\nHEIGHT {h}\nDEPTH 1\nMAXVAL 4095\nTUPLTYPE GRAYSCALE\nENDHDR\n".encode() + struct.pack(
        f">{w * h}H", *samples
    )


_PLANE = T.StructType(
    [
        T.StructField("width", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("plane", T.ArrayType(T.IntegerType())),
    ]
)


@F.pandas_udf(_PLANE)
def pam(content: pd.Series) -> pd.DataFrame:
    """Planes of P7 files."""
    return pd.DataFrame([parse_pam(bytes(d)) for d in content], columns=_PLANE.names)


def render_pam_column(w: int, h: int):
    """A function of a plane column that gives P7 images."""

    @F.pandas_udf(T.BinaryType())
    def run(planes: pd.Series) -> pd.Series:
        return planes.map(lambda p: render_pam(w, h, [int(v) for v in p]))

    return run
