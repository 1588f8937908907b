"""Readers and writers of the tab-separated records.

``spark.read.csv`` cannot read them: the files mix a magic line, a header block,
rows of several arities and per-record policies for torn tails. They are read as
lines, split and checked by arity; what is not a row is a relation of its own,
with the reason. Files of any size are read in splits: a line's number comes from
the counts of the splits before it, and a torn tail is known from the bytes of all
lines against the file's size.

A record names itself in its first line, which begins with ``#``; which words
stand there is the caller's.
"""

from __future__ import annotations

import re
import urllib.parse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from loomshed.scratch import file_system, hadoop_path
from loomshed.sources import trees

TAB = "\t"
#: Splits whose counts are broadcast, at most; those of more are joined.
MOST_SPLITS = 200_000
#: First lines of a ledger's records that an append looks at.
MOST_VERSIONS = 1000
#: Rows and bytes of a file that a record is written to; a larger record is several files, in order.
FILE_ROWS, FILE_BYTES = 1_000_000, 64 << 20


#: Bytes of a file that one task reads of records that are found by their names, and lines that it holds.
RANGE, LINES = 64 << 20, 10_000


def _found(spark: SparkSession, root: str, glob: str) -> DataFrame | None:
    """(file, block, size, id, value) of the lines of all files below ``root`` whose names match, listed and read by executors.

    ``id`` is a line's place in its block. None where only Spark's readers can open the root.
    """
    try:
        trees.opened(root)
    except pa.ArrowInvalid:
        return None
    found = trees.dealt(trees.listed(spark, root, glob).select("rel", "length"))
    blocks = found.select("rel", "length", F.explode(F.sequence(F.lit(0), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(RANGE))).alias("block"))
    top = re.sub(r"^(file:)?/+", "file:/", root).rstrip("/")  # as Spark's readers name it
    kinds = pa.schema([("file", pa.string()), ("block", pa.int64()), ("size", pa.int64()), ("id", pa.int64()), ("value", pa.binary())])

    def read(fs, path, rel, size, block):
        """The lines that begin in a block."""
        with fs.open_input_file(f"{path}/{rel}") as f:
            at, rest = max(block - 1, 0), b""
            f.seek(at)
            behind = block == 0  # else the first line is the block's before
            while at < min(block + RANGE, size):
                data = f.read(trees.CHUNK)
                if not data:
                    lines = [rest] if rest else []
                else:
                    *lines, rest = (rest + data).split(b"\n")
                for line in lines:
                    if at >= block + RANGE:
                        return
                    if behind:
                        yield line.removeprefix(b"\xef\xbb\xbf") if at == 0 else line
                    behind, at = True, at + len(line) + 1
                if not data:
                    return

    def run(batches):
        fs, path = trees.opened(root)
        for batch in batches:
            held = []
            for rel, size, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                file = f"{top}/{urllib.parse.quote(rel)}"
                for i, line in enumerate(read(fs, path, rel, size, block)):
                    held.append((file, block, size, i, line))
                    if len(held) == LINES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], schema=kinds)
                        held = []
            columns = zip(*held, strict=True) if held else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(columns, kinds, strict=True)], schema=kinds)

    lines = blocks.select("rel", "length", "block").mapInArrow(run, "file string, block long, size long, id long, value binary")
    return lines.withColumn("value", F.col("value").cast("string"))


#: A part of what one job of Spark has written to a folder: number, job, file of the task.
_PART = r"^(.*/part-)[0-9]+(-[0-9a-f-]{36}-c)[0-9]+([^/]*)$"


def text_lines(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(manifest, n, line, torn, head) of every line below ``path``, or of the files at any depth whose names match ``glob``.

    ``manifest`` is the file's path, ``n`` counts from 0 in each file, ``head`` is its first line, and ``torn`` marks a
    last line without an end. Files must not be compressed. The files that one job has written to a folder are one
    record, in the order of their numbers: it goes by the path of the first, its lines are counted through, and its
    head is that of the first file.
    """
    raw = _found(spark, path, glob) if glob else None
    if raw is None:
        raw = spark.read.text(path, lineSep="\n", **({"pathGlobFilter": glob, "recursiveFileLookup": True} if glob else {})).select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.col("_metadata.file_size").alias("size"),
            F.monotonically_increasing_id().alias("id"),
            "value",
        )
    splits = raw.groupBy("file", "block").agg(
        F.min("id").alias("first"),
        F.count(F.lit(1)).alias("c"),
        F.sum(F.octet_length("value") + 1).alias("bytes"),
        F.max("size").alias("size"),
        F.min_by("value", "id").alias("top"),
    )
    splits = splits.withColumn("record", F.regexp_replace("file", _PART, "$1*$2*$3"))
    splits = splits.withColumn("open", F.sum("bytes").over(Window.partitionBy("file")) > F.col("size"))
    whole = Window.partitionBy("record")
    order = whole.orderBy("file", "block")
    ahead = F.sum("c").over(order) - F.col("c")
    last = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    splits = splits.select(
        "file",
        "block",
        "first",
        ahead.alias("ahead"),
        (F.sum("c").over(whole) - 1).alias("last"),
        F.last("open").over(last).alias("open"),
        F.first("top").over(order).alias("head"),
        F.first("file").over(order).alias("manifest"),
    )
    if splits.limit(MOST_SPLITS + 1).count() <= MOST_SPLITS:
        splits = F.broadcast(splits)
    n = F.col("ahead") + F.col("id") - F.col("first")

    def clean(c):
        return F.rtrim(F.col(c), F.lit("\r"))

    lines = raw.drop("size").join(splits, ["file", "block"])
    name = F.url_decode(F.replace("manifest", F.lit("+"), F.lit("%2B")))  # the reader gives paths as URIs
    return lines.select(
        name.alias("manifest"),
        n.alias("n"),
        clean("value").alias("line"),
        (F.col("open") & (n == F.col("last"))).alias("torn"),
        clean("head").alias("head"),
    )


def parse_rows(
    lines: DataFrame,
    columns: list[str],
    kinds: list[str],
    arities: list[int] | None = None,
    null: str | None = None,
    tolerate_torn: bool = False,
    arity: Column | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of tab-separated lines; rejects are (manifest, n, line, reason).

    A line is a row if it has one of the ``arities`` (or the ``arity`` that its file
    wants) and its values convert; missing trailing columns are ''. ``null`` is the
    spelling of a null. With ``tolerate_torn`` a bad torn last line is dropped, not rejected.
    """
    parts = F.split("line", TAB)

    def text(i):
        return F.try_element_at(parts, F.lit(i + 1))

    def value(i: int, kind: str) -> Column:
        if kind != "string":
            return text(i).try_cast(kind)
        found = F.coalesce(text(i), F.lit(""))
        return found if null is None else F.nullif(found, F.lit(null))

    typed = lines.withColumns(
        {"_arity": F.size(parts), **{c: value(i, k) for i, (c, k) in enumerate(zip(columns, kinds, strict=True))}}
    )
    fits = F.col("_arity").isin(*(arities or [len(columns)])) if arity is None else F.col("_arity") == arity
    reason = F.when(~fits, F.concat(F.col("_arity").cast("string"), F.lit(" columns")))
    for c, k in zip(columns, kinds, strict=True):
        if k != "string":
            reason = F.coalesce(reason, F.when(F.col(c).isNull(), F.lit(f"bad {c}")))
    typed = typed.withColumn("reason", reason)
    bad = typed.filter("reason is not null")
    return typed.filter("reason is null").select("manifest", "n", *columns), (
        bad.filter(~F.col("torn")) if tolerate_torn else bad
    ).select("manifest", "n", "line", "reason")


_KEY = r"^([A-Za-z_]+): ?(.*)$"


def body(lines: DataFrame, header: str) -> DataFrame:
    """Lines that are neither a first line with ``#``, nor ``key: value``, nor the column line, nor empty."""
    return lines.filter(
        (F.col("line") != "") & ~F.col("line").startswith("#") & (F.col("line") != header) & (
            F.contains("line", F.lit(TAB)) | ~F.col("line").rlike(_KEY)
        )
    )


def records(
    spark: SparkSession, path: str, columns: list[str], kinds: list[str], glob: str | None = None, **how
) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of files with a first line, ``key: value`` lines, a column line and rows."""
    rows, bad = parse_rows(body(text_lines(spark, path, glob), TAB.join(columns)), columns, kinds, **how)
    return rows.drop("n"), bad


def header_values(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(manifest, n, key, value) of the ``key: value`` lines."""
    found = text_lines(spark, path, glob).filter(~F.contains("line", F.lit(TAB)) & F.col("line").rlike(_KEY))
    return found.select(
        "manifest", "n", F.regexp_extract("line", _KEY, 1).alias("key"), F.trim(F.regexp_extract("line", _KEY, 2)).alias("value")
    )


def headers(spark: SparkSession, path: str, keys: list[str], glob: str | None = None) -> DataFrame:
    """One row a file: the value of each key, of the last line if it is held twice."""
    return header_values(spark, path, glob).groupBy("manifest").agg(
        *[F.max_by(F.when(F.col("key") == k, F.col("value")), F.when(F.col("key") == k, F.col("n"))).alias(k) for k in keys]
    )


# Columns of the records.
CHECKSUMS = (
    ["file", "size", "crc32c", "sha256", "timecode", "framerate", "iso", "exposure"],
    ["string", "bigint", "string", "string", "string", "string", "string", "string"],
)
PLANES = (
    ["file", "size", "sha256", "crc32c", "plane", "src_frame", "src_frame_sha256", "jxl_version", "effort"],
    ["string", "bigint"] + ["string"] * 7,
)
BAKE = (["relpath", "size", "sha256"], ["string", "bigint", "string"])
QC = (
    ["file", "bps", "raw_min", "raw_max", "raw_mean", "range", "variance", "black"],
    ["string", "int", "int", "int", "string", "int", "string", "int"],
)
INGEST = (
    ["clip", "frames", "manifest_declared", "frame_range", "tc_start", "tc_end"],
    ["string", "bigint", "string", "string", "string", "string"],
)
OFFLOAD = (["file", "size", "source_sha256", "dest_sha256", "verdict"], ["string", "bigint", "string", "string", "string"])
SOURCES = (["file", "size", "sha256"], ["string", "bigint", "string"])
MEMBERS = (["file", "size", "sha256", "verdict"], ["string", "bigint", "string", "string"])
REEL = (["clip", "codec", "archive", "archive_sha256", "manifest_name", "manifest_sha256", "frames"], ["string"] * 6 + ["bigint"])
REEL_HEADER = TAB.join(["clip", "codec", "archive", "archive_sha256", "manifest", "manifest_sha256", "frames"])
LEDGER = (
    [
        "created",
        "command",
        "tool_version",
        "input",
        "output",
        "codec",
        "frames",
        "verdict",
        "duration_s",
        "dest",
        "selection",
        "context",
    ],
    ["bigint"] + ["string"] * 11,
)
PINS = (["component", "expected", "probe", "note"], ["string"] * 4)

_CRC = "^[0-9A-Fa-f]{8}$"
_SHA = "^[0-9A-Fa-f]{64}$"


def _also(rows: DataFrame, bad: DataFrame, rule: Column, reason: str) -> tuple[DataFrame, DataFrame]:
    """Rows that break a further rule join the rejects, as their own columns joined again."""
    broken = ~F.coalesce(rule, F.lit(False))
    line = F.concat_ws(TAB, *[F.col(c).cast("string") for c in rows.columns if c not in ("manifest", "n")])
    return rows.filter(~broken), bad.unionByName(
        rows.filter(broken).select("manifest", "n", line.alias("line"), F.lit(reason).alias("reason"))
    )


def read_checksums(
    spark: SparkSession, path: str, tolerate_torn: bool = False, glob: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Checksum sidecars: eight columns in files with a first line, four in older ones; three are older still and rejected."""
    lines = body(text_lines(spark, path, glob), TAB.join(CHECKSUMS[0])).filter(F.col("line") != TAB.join(CHECKSUMS[0][:4]))
    arity = F.when(F.col("head").startswith("#"), 8).otherwise(4)
    rows, bad = parse_rows(lines, *CHECKSUMS, tolerate_torn=tolerate_torn, arity=arity)
    bad = bad.withColumn(
        "reason", F.when((F.col("reason") == "3 columns"), "predates the sha256 column").otherwise(F.col("reason"))
    )
    rows, bad = _also(rows, bad, F.col("crc32c").rlike(_CRC), "bad crc32c")
    return rows.drop("n"), bad


def read_plane_checksums(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Sidecars of planes: five columns at least, the digest before the checksum."""
    lines = body(text_lines(spark, path), TAB.join(PLANES[0]))
    rows, bad = parse_rows(lines, *PLANES, arities=list(range(5, len(PLANES[0]) + 1)))
    rows, bad = _also(rows, bad, F.col("crc32c").rlike(_CRC), "bad crc32c")
    return rows.drop("n"), bad


def read_resume(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Sidecars for a resumed run: a bad torn tail is dropped, and every row of a file name held twice is a reject."""
    rows, bad = read_checksums(spark, path, tolerate_torn=True)
    twice = rows.groupBy("manifest", "file").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("manifest", "file")
    again = twice.select(
        "manifest", F.lit(None).cast("bigint").alias("n"), F.col("file").alias("line"), F.lit("held twice").alias("reason")
    )
    return rows.join(twice, ["manifest", "file"], "left_anti"), bad.unionByName(again)


def torn_tails(spark: SparkSession, path: str) -> DataFrame:
    """(manifest, n, line) of last lines without an end."""
    return text_lines(spark, path).filter("torn").select("manifest", "n", "line")


def read_bake(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(headers, rows, rejects) of bake manifests; headers (manifest, clip, container, file_count, parts, error).

    ``error`` names the first of: no clip, no container, no file_count, empty part list, file_count, no rows.
    """
    rows, bad = parse_rows(body(text_lines(spark, path), TAB.join(BAKE[0])), *BAKE)
    head = headers(spark, path, ["clip", "container", "file_count", "archive"])
    held = rows.groupBy("manifest").agg(F.count(F.lit(1)).alias("rows"))
    parts = F.filter(F.transform(F.split("archive", ","), lambda p: F.trim(p)), lambda p: p != "")
    count = F.col("file_count").try_cast("bigint")
    error = (
        F.when(F.col("clip").isNull(), "no clip")
        .when(F.col("container").isNull(), "no container")
        .when(count.isNull(), "no file_count")
        .when(F.col("archive").isNotNull() & (F.size(parts) == 0), "empty part list")
        .when(count != F.coalesce("rows", F.lit(0)), "file_count")
        .when(F.col("rows").isNull(), "no rows")
    )
    told = head.join(held, "manifest", "left").select(
        "manifest",
        "clip",
        "container",
        count.alias("file_count"),
        F.when(F.col("archive").isNotNull(), parts).alias("parts"),
        error.alias("error"),
    )
    return told, rows.drop("n"), bad


def read_qc(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Frame statistics; a bad torn tail is dropped."""
    return records(spark, path, *QC, tolerate_torn=True)


def read_ingest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Ingest manifests; '-' is null and a range is ``a..b``."""
    rows, bad = records(spark, path, *INGEST, null="-")
    ends = F.split("frame_range", r"\.\.")
    return rows.withColumns(
        {
            "first": F.try_element_at(ends, F.lit(1)).try_cast("bigint"),
            "last": F.try_element_at(ends, F.lit(2)).try_cast("bigint"),
        }
    ), bad


def read_offload(spark: SparkSession, path: str, glob: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows of offload manifests, with the destination that each manifest records."""
    rows, bad = records(spark, path, *OFFLOAD, glob=glob)
    return rows.join(headers(spark, path, ["dest"], glob), "manifest", "left"), bad


def read_sources(spark: SparkSession, path: str, glob: str | None = None) -> tuple[DataFrame, DataFrame]:
    return records(spark, path, *SOURCES, glob=glob)


def read_members(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Rows of member records, with the ``verdict:`` line of each record."""
    rows, bad = records(spark, path, *MEMBERS)
    return rows.join(headers(spark, path, ["verdict"]).withColumnRenamed("verdict", "record_verdict"), "manifest", "left"), bad


def read_reels(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(headers, rows, rejects) of reel manifests; archives and their digests are arrays of equal length.

    headers: (manifest, created, clips, frames, error); ``error`` names a header that the rows belie.
    """
    rows, bad = parse_rows(body(text_lines(spark, path), REEL_HEADER), *REEL)

    def listed(c):
        return F.transform(F.split(c, ","), lambda p: F.trim(p))

    rows, bad = _also(rows, bad, F.size(listed("archive")) == F.size(listed("archive_sha256")), "archive lists differ in length")
    rows, bad = _also(
        rows,
        bad,
        F.forall(listed("archive_sha256"), lambda s: s.rlike(_SHA)) & F.col("manifest_sha256").rlike(_SHA),
        "bad digest",
    )
    rows = rows.withColumns({"archive": listed("archive"), "archive_sha256": listed("archive_sha256")}).drop("n")
    held = rows.groupBy("manifest").agg(F.count(F.lit(1)).alias("_c"), F.sum("frames").alias("_f"))

    def number(c):
        return F.split_part(c, F.lit(" "), F.lit(1)).try_cast("bigint")

    error = (
        F.when(F.col("_c").isNull(), "no rows")
        .when(F.col("clips").isNotNull() & ~number(F.col("clips")).eqNullSafe(F.col("_c")), "clips")
        .when(F.col("frames").isNotNull() & ~number(F.col("frames")).eqNullSafe(F.col("_f")), "frames")
    )
    head = headers(spark, path, ["created", "clips", "frames"]).join(held, "manifest", "left")
    return head.select(
        "manifest", *[number(F.col(c)).alias(c) for c in ("created", "clips", "frames")], error.alias("error")
    ), rows, bad


# The first lines of ledgers that are read, with the columns that the second line names.
LEDGER_VERSIONS = {"version: 1": 10, "version: 2": 11, "version: 3": 12}


def _of_version(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The lines of ledgers of a known version below their two header lines, and the rejects that name the others.

    A ledger of an unknown version, or of none, is one reject and none of its lines is read; a second line
    that is not the version's column line is a reject, too, and is passed over.
    """
    known = F.col("head").isin(*LEDGER_VERSIONS)
    names = F.create_map(*[x for v, k in LEDGER_VERSIONS.items() for x in (F.lit(v), F.lit(TAB.join(LEDGER[0][:k])))])
    why = (
        F.when(~known & (F.col("n") == 0), F.when(F.col("head").startswith("version: "), "unknown version").otherwise("no version"))
        .when(known & (F.col("n") == 1) & (F.col("line") != F.try_element_at(names, "head")), "unexpected columns")
    )
    told = lines.withColumn("reason", why)
    bad = told.filter("reason is not null").select("manifest", "n", "line", "reason")
    return lines.filter(known & (F.col("n") > 1) & (F.trim("line") != "")), bad


def read_ledger(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Ledger rows of 10, 11 or 12 columns, in ledgers of any known version; what is not read is named by the rejects.

    A torn last line that is no row is dropped.
    """
    return ledger_rows(text_lines(spark, path))


def ledger_rows(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of a ledger's lines, as ``text_lines`` gives them, or as a stream of them."""
    kept, unread = _of_version(lines)
    rows, bad = parse_rows(kept, *LEDGER, arities=[10, 11, 12], tolerate_torn=True)
    return rows.drop("n"), bad.unionByName(unread)


def read_pins(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return records(spark, path, *PINS)


def read_anchors(spark: SparkSession, path: str, values: list[str]) -> DataFrame:
    """(file, values...) of anchor tables: the first row of each file name that has enough columns; a value that is no number raises."""
    parts = F.split("line", TAB)
    rows = text_lines(spark, path).filter(F.size(parts) > len(values)).withColumn("parts", parts)
    first = rows.groupBy(parts.getItem(0).alias("file")).agg(F.min_by("parts", F.struct("manifest", "n")).alias("p"))

    def number(i: int, name: str) -> Column:
        text = F.col("p").getItem(i)
        return F.coalesce(
            text.try_cast("double"), F.raise_error(F.concat(F.lit(f"bad {name} of "), "file")).cast("double")
        ).alias(name)

    return first.select("file", *[number(i, v) for i, v in enumerate(values, 1)])


def anchored(frames: DataFrame, anchors: DataFrame, key: str) -> DataFrame:
    """Frames with their anchors; a frame without one raises when its row is computed."""
    found = frames.join(anchors.withColumnRenamed("file", key).withColumn("_held", F.lit(True)), key, "left")
    checked = F.when(
        F.col("_held").isNull(), F.raise_error(F.concat(F.lit("no anchor for "), F.col(key).cast("string"))).cast("boolean")
    ).otherwise(F.lit(True))
    return found.filter(checked).drop("_held")


def declared_counts(spark: SparkSession, path: str) -> DataFrame:
    """(clip, declared): rows of a declared-frame manifest by parent folder; titles and column lines are passed over."""
    first = F.substring_index("line", TAB, 1)
    rows = text_lines(spark, path).select(first.alias("rel")).filter(F.lower("rel").endswith(".dng"))
    return rows.groupBy(F.regexp_extract("rel", "^(.*)/[^/]*$", 1).alias("clip")).agg(F.count(F.lit(1)).alias("declared"))


def source_sha_map(rows: DataFrame) -> DataFrame:
    """(member, sha) over all offload manifests: 64 hex digits only, lower-cased, the last manifest by name wins."""
    fine = rows.filter(F.col("source_sha256").rlike(_SHA))
    return fine.groupBy(F.col("file").alias("member")).agg(F.max_by(F.lower("source_sha256"), "manifest").alias("sha"))


def reel_archives(reels: DataFrame) -> DataFrame:
    """(clip, archive, sha256): the parallel lists of reel rows, place by place; unequal lists raise. Lists may be arrays or joined by ', '."""

    def listed(c):
        return F.split(c, ", ") if dict(reels.dtypes)[c] == "string" else F.col(c)

    a, s = listed("archive"), listed("archive_sha256")
    both = F.when(F.size(a) == F.size(s), F.arrays_zip(a.alias("a"), s.alias("s"))).otherwise(
        F.raise_error(F.lit("archive lists differ in length"))
    )
    return reels.select("clip", F.explode(both).alias("x")).select(
        "clip", F.col("x.a").alias("archive"), F.col("x.s").alias("sha256")
    )


def camera_profile(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(headers, geometries) of profiles: ``key: value`` lines, and ``geometry: W H BITS predicates`` rows."""
    values = header_values(spark, path)
    head = values.filter("key <> 'geometry'").groupBy("manifest").agg(
        F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("profile")
    )
    part = F.split("value", r"\s+")

    def number(i):
        return part.getItem(i).try_cast("int")

    geo = values.filter("key = 'geometry'").select(
        "manifest",
        number(0).alias("w"),
        number(1).alias("h"),
        number(2).alias("bits"),
        part.getItem(3).alias("predicates"),
        (F.size(part) == 4).alias("fine"),
    )
    return head, geo.withColumn(
        "fine", F.coalesce(F.col("fine") & (F.col("w") > 0) & (F.col("h") > 0) & (F.col("bits") > 0), F.lit(False))
    )


def profile_set(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(headers, geometries) of a folder of profiles; a camera id, or a make and model, that two claim raises."""
    head, geo = camera_profile(spark, path)
    named = head.select("manifest", *[F.col("profile")[k].alias(k) for k in ("camera", "make", "model", "photometric", "naming")])
    unique_or_raise(named.filter("camera is not null"), ["camera"], "camera")
    unique_or_raise(named.filter("make is not null"), ["make", "model"], "make and model")
    return named, geo


def unique_or_raise(rows: DataFrame, key: list[str], what: str) -> DataFrame:
    """The rows, or an error that names a key held twice; checked before any sink."""
    twice = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("c")).filter("c > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{what} claimed twice: {tuple(twice[0][k] for k in key)}")
    return rows


def write_record(
    rows: DataFrame,
    path: str,
    magic: str,
    columns: list[str],
    order: str,
    heads: dict[str, object] | None = None,
    feet: dict[str, object] | None = None,
    header: str | None = None,
    mode: str = "overwrite",
) -> None:
    """A record: magic, header lines, columns, then rows sorted by ``order``, then closing lines; the same rows give the same bytes.

    Up to ``FILE_ROWS`` rows of ``FILE_BYTES`` are one file. More are several, whose order is that of their names, so no task holds
    more; the first lines stand in the first of them and the closing lines in the last, and ``text_lines`` reads
    all of them as one record.
    """
    line: Column = F.concat_ws(TAB, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    n, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(line)), F.lit(0))).first()
    top = [magic, *[f"{k}: {v}" for k, v in (heads or {}).items()], header or TAB.join(columns)]
    last = [f"{k}: {v}" for k, v in (feet or {}).items()]
    ends = [(0, i, "", t) for i, t in enumerate(top)] + [(2, i, "", t) for i, t in enumerate(last)]
    frame = rows.sparkSession.createDataFrame(ends, "a int, i int, b string, value string")
    body_ = rows.select(F.lit(1).alias("a"), F.lit(0).alias("i"), F.col(order).cast("string").alias("b"), line.alias("value"))
    sort = ["a", "i", "b", "value"]
    frame.unionByName(body_).repartitionByRange(
        max(1, -(-n // FILE_ROWS), -(-size // FILE_BYTES)), *sort
    ).sortWithinPartitions(*sort).select("value").write.mode(mode).text(path)


def write_checksums(rows: DataFrame, path: str, magic: str, tool: str) -> None:
    """A checksum sidecar of (file, size, crc32c, sha256, timecode, framerate, iso, exposure); the checksum may be a number."""
    if dict(rows.dtypes)["crc32c"] != "string":
        rows = rows.withColumn("crc32c", F.lower(F.lpad(F.hex("crc32c"), 8, "0")))
    write_record(rows, path, magic, CHECKSUMS[0], "file", {"version": 3, "tool_version": tool})


def write_qc(rows: DataFrame, path: str, magic: str, total: int, partial: list[str]) -> None:
    """A statistics record: its header says how many frames it covers, and names the partial ones."""
    held = rows.count()
    heads = {
        "black_range_below": 32,
        "black_variance_below": 256,
        "coverage": f"{held} of {total}",
        **({"partial": ", ".join(sorted(partial))} if partial else {}),
    }
    write_record(rows, path, magic, QC[0], "file", heads)


def write_ingest(rows: DataFrame, path: str, magic: str) -> None:
    """An ingest manifest of (clip, frames, manifest_declared, first, last, tc_start, tc_end); nulls are '-'."""
    text = rows.select(
        "clip",
        "frames",
        F.coalesce(F.col("manifest_declared").cast("string"), F.lit("-")).alias("manifest_declared"),
        F.concat_ws("..", F.col("first").cast("string"), F.col("last").cast("string")).alias("frame_range"),
        *[F.coalesce(c, F.lit("-")).alias(c) for c in ("tc_start", "tc_end")],
    )
    told = rows.agg(F.count(F.lit(1)).alias("c"), F.coalesce(F.sum("frames"), F.lit(0)).alias("f")).first()
    write_record(text, path, magic, INGEST[0], "clip", {"verdict": "PASS", "clips": told["c"], "frames": told["f"]})


def write_offload(rows: DataFrame, path: str, magic: str, dest: str) -> None:
    """An offload manifest of (file, size, source_sha256, dest_sha256, verdict), with the count of good rows and the verdict of all."""
    told = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("verdict") == "OK").alias("ok")).first()
    write_record(
        rows,
        path,
        magic,
        OFFLOAD[0],
        "file",
        {"dest": dest, "rows": f"{told['ok']}/{told['n']}", "overall": "PASS" if told["ok"] == told["n"] else "FAIL"},
    )


def rewrite_offload(manifest: DataFrame, repaired: DataFrame, path: str, magic: str, dest: str) -> None:
    """An offload manifest again, with the verdicts and digests of repaired rows (file, dest_sha256, verdict) over its own."""
    fresh = repaired.select("file", F.col("dest_sha256").alias("_d"), F.col("verdict").alias("_v"))
    rows = manifest.join(fresh, "file", "left").withColumns(
        {"dest_sha256": F.coalesce("_d", "dest_sha256"), "verdict": F.coalesce("_v", "verdict")}
    ).select(*OFFLOAD[0])
    write_offload(rows, path, magic, dest)


def write_sources(rows: DataFrame, path: str, magic: str) -> None:
    write_record(rows, path, magic, SOURCES[0], "file", {"count": rows.count()})


def write_members(rows: DataFrame, path: str, magic: str) -> None:
    """A member record; its last line is the verdict of all rows."""
    told = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("verdict") == "OK").alias("ok")).first()
    bad = told["n"] - told["ok"]
    write_record(
        rows,
        path,
        magic,
        MEMBERS[0],
        "file",
        feet={"verdict": f"REFUSE {bad} named row(s)" if bad else f"OK {told['ok']}/{told['n']}"},
    )


def write_reels(rows: DataFrame, path: str, magic: str, created: int, tool: str) -> None:
    """A reel manifest of rows whose archives and digests are arrays; the header's counts are those of the rows."""
    told = rows.agg(F.count(F.lit(1)).alias("c"), F.coalesce(F.sum("frames"), F.lit(0)).alias("f")).first()
    text = rows.withColumns({c: F.array_join(c, ", ") for c in ("archive", "archive_sha256")})
    heads = {
        "version": 1, "created": f"{created} (unix seconds, UTC)", "tool_version": tool, "clips": told["c"], "frames": told["f"]
    }
    write_record(text, path, magic, REEL[0], "clip", heads, header=REEL_HEADER)


def append_ledger(rows: DataFrame, path: str) -> None:
    """Rows added to a ledger: a record of the newest version beside those that are there; none is rewritten or left half written.

    The whole append is one job, whose files are one record with a version and a column line; readers take
    records of any version. Where the folder holds a record of an unknown version, the append is refused.
    """
    spark = rows.sparkSession
    folder = hadoop_path(spark, path)
    if file_system(spark, path).exists(folder):
        heads = text_lines(spark, path).filter("n = 0").select("head").distinct().limit(MOST_VERSIONS).collect()
        if strange := sorted({r["head"] for r in heads} - LEDGER_VERSIONS.keys()):
            raise ValueError(f"the ledger holds records of an unknown version: {strange}")
    version, n = list(LEDGER_VERSIONS.items())[-1]
    write_record(rows, path, version, LEDGER[0][:n], "created", mode="append")


def render_profile(identity: dict[str, str], geometries: list[tuple[int, int, int, str]], magic: str) -> str:
    """A measured camera as a profile; refused without an identity, a naming and confirmed geometries."""
    for needed in ("camera", "make", "model", "naming"):
        if not identity.get(needed):
            raise ValueError(f"no {needed} was measured")
    if not geometries:
        raise ValueError("no geometry is confirmed")
    rows = [f"geometry: {w} {h} {bits} {predicates}" for w, h, bits, predicates in sorted(geometries)]
    return "\n".join([magic, *(f"{k}: {identity[k]}" for k in sorted(identity)), *rows, ""])
