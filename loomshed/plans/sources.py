"""Queries of readers and writers: records written and read back, frames and their facts, hash lists, signatures, reports."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from loomshed.functions import keys
from loomshed.operators import reconcile as rc
from loomshed.plans.registry import register
from loomshed.scratch import scratch, spread, stored
from loomshed.session import table
from loomshed.sources import frames, hashlists, records, reports, signatures, tiff, trees

MAGIC = "# a record"


def _lines(rows: DataFrame, line: Column, order: Column, path: str, top: list[str] = (), torn: bool = False) -> None:
    """Raw text of a record, for readers to judge: given first lines, then lines in order, in as many files as there are ranges."""
    spark = rows.sparkSession
    head = spark.createDataFrame([(i - len(top), t) for i, t in enumerate(top)], "o long, value string") if top else None
    body = rows.select(order.cast("long").alias("o"), line.alias("value"))
    whole = head.unionByName(body) if head is not None else body
    whole.repartitionByRange("o").sortWithinPartitions("o").select("value").write.text(path)


# Scans. A tree of small files stands for a card.

_TREE = """SELECT doc_id AS k, '/' || source || '/' || CASE WHEN doc_id % 7 = 3 THEN '._' ELSE '' END || 'd' || doc_id || CASE doc_id % 5 WHEN 0 THEN '.dng' WHEN 1 THEN '.DNG' WHEN 2 THEN '.txt'
  WHEN 3 THEN '.checksums.tsv' ELSE '.offload-manifest.tsv' END AS path, strlen(coalesce(text, '')) AS length FROM documents WHERE source IS NOT NULL"""
_SEEN = f"""SELECT path[2:] AS rel, split_part(path, '/', 2) AS clip, split_part(path, '/', 3) AS name, length FROM ({_TREE}) WHERE NOT starts_with(split_part(path, '/', 3), '._')"""


def _tree(spark: SparkSession, sf: str) -> str:
    """The documents as files of their sources, written by executors."""
    root, k = scratch(spark, "card"), F.col("doc_id")
    ends = F.array(*map(F.lit, (".dng", ".DNG", ".txt", ".checksums.tsv", ".offload-manifest.tsv")))
    name = F.concat(
        F.when(k % 7 == 3, "._").otherwise(""), F.lit("d"), k.cast("string"), F.element_at(ends, (k % 5 + 1).cast("int"))
    )
    rows = table(spark, sf, "documents").filter("source is not null")
    content = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    trees.write_files(rows.select(F.concat("source", F.lit("/"), name).alias("rel"), content.alias("content")), root)
    return root


@register(
    "frame_scan",
    f"SELECT rel, clip, regexp_replace(name, '\\.[^.]*$', '') AS stem, length FROM ({_SEEN}) WHERE lower(name) LIKE '%.dng'",
)
def frame_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Frames below a folder, shadow files left out; no file is opened."""
    return trees.frame_files(spark, _tree(spark, sf), ["rel", "clip", "stem", "length"])


@register("member_scan", f"SELECT rel, clip, length, lower(name) LIKE '%.dng' AS frame FROM ({_SEEN})")
def member_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Every file of a tree, frames and others."""
    mine, others = frames.split_members(frames.files(spark, _tree(spark, sf)))
    both = mine.withColumn("frame", F.lit(True)).unionByName(others.withColumn("frame", F.lit(False)))
    return both.select("rel", "clip", "length", "frame")


@register(
    "record_discovery",
    f"""SELECT rel, clip, CASE WHEN name LIKE '%.checksums.tsv' THEN 'checksums' ELSE 'offload' END AS kind, f.files FROM ({_SEEN}) JOIN (SELECT split_part(rel, '/', 1) AS folder, count(*) AS files FROM ({_SEEN}) GROUP BY 1) f ON f.folder = clip
    WHERE name LIKE '%.checksums.tsv' OR name LIKE '%.offload-manifest.tsv'""",
)
def record_discovery(spark: SparkSession, sf: str) -> DataFrame:
    """The records of a tree, and the folders to judge one by one."""
    found = frames.files(spark, _tree(spark, sf))
    both = frames.sidecars(found).unionByName(frames.mirror_records(found))
    return both.join(frames.top_folders(found), F.col("clip") == F.col("folder")).drop("folder")


@register(
    "plane_groups",
    """WITH f AS (SELECT l_orderkey % 100 AS clip, l_linenumber AS stem, ['00', '01', '10', '11'][l_suppkey % 4 + 1] AS plane, l_partkey AS length FROM lineitem)
    SELECT clip::VARCHAR AS clip, 's' || stem AS stem, sum(length)::BIGINT AS bytes, array_to_string(list_filter(['00', '01', '10', '11'], lambda p: NOT list_contains(list(plane), p)), ',') AS missing FROM f GROUP BY clip, stem""",
)
def plane_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Frames of four planes, and the planes that are missing."""
    plane = F.element_at(F.array(*[F.lit(p) for p in ("00", "01", "10", "11")]), (F.col("l_suppkey") % 4 + 1).cast("int"))
    stem = F.concat(F.lit("s"), F.col("l_linenumber").cast("string"), F.lit("_p2_"), plane)
    rows = table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") % 100).cast("string").alias("clip"), stem.alias("stem"), F.col("l_partkey").alias("length")
    )
    return frames.plane_groups(rows).withColumn("missing", F.array_join("missing", ","))


@F.pandas_udf(T.BinaryType())
def _tiffs(key: pd.Series, size: pd.Series, maker: pd.Series) -> pd.Series:
    """A small frame a row: its depth, order, directories and faults follow from its key."""

    def one(k: int, s: int, m: str) -> bytes:
        bits, order = (8, 10, 12, 14)[k % 4], "big" if k % 5 == 4 else "little"
        w, h = 4 * (s + 1), 2
        top = [
            (256, 4, [w]),
            (257, 4, [h]),
            (258, 3, [bits]),
            (259, 3, [7 if k % 11 == 5 else 1]),
            (262, 3, [32803]),
            (271, 2, [*m.encode(), 0]),
            (273, 4, [0]),
            (277, 3, [1]),
            (279, 4, [w * h * bits // 8]),
        ]
        if k % 13 == 6:
            top = [t for t in top if t[0] != 277]
        lower = [(33434, 5, [(1, s + 1)]), (34855, 3, [100 * s])] if k % 3 == 0 else []
        top += [(51044, 10, [(24000, 1001)])] if k % 2 == 0 else []
        data = tiff.write([top, *([lower] if lower else [])], order, b"\1" * (w * h * bits // 8))
        return data[:20] if k % 17 == 8 else data + (b"\0\1" if k % 19 == 9 else b"\0\0")

    return pd.Series([one(int(k), int(s), m) for k, s, m in zip(key, size, maker, strict=True)])


def _part_files(spark: SparkSession, sf: str) -> DataFrame:
    p = spread(table(spark, sf, "part").select("p_partkey", "p_size", "p_brand"), "p_partkey")
    return p.select("p_partkey", _tiffs(p["p_partkey"], p["p_size"], p["p_brand"]).alias("content"))


def _part_tree(spark: SparkSession, sf: str) -> str:
    """The parts as frames of a tree, written by executors."""
    root = scratch(spark, "frames")
    rel = F.format_string("c%d/p%d.dng", F.col("p_partkey") % 10, F.col("p_partkey"))
    trees.write_files(_part_files(spark, sf).select(rel.alias("rel"), "content"), root)
    return root


@register(
    "frame_facts",
    """WITH f AS (SELECT *, p_partkey % 17 = 8 AS torn FROM part)
    SELECT p_partkey, CASE WHEN NOT torn THEN 4 * (p_size + 1) END AS width, CASE WHEN NOT torn THEN [8, 10, 12, 14][p_partkey % 4 + 1] END AS bits, CASE WHEN NOT torn THEN p_brand END AS make,
      CASE WHEN NOT torn AND p_partkey % 2 = 0 THEN '24000/1001' ELSE '' END AS framerate, CASE WHEN NOT torn AND p_partkey % 3 = 0 THEN (100 * p_size)::VARCHAR ELSE '' END AS iso,
      CASE WHEN NOT torn AND p_partkey % 3 = 0 THEN '1/' || (p_size + 1) ELSE '' END AS exposure, CASE WHEN torn THEN 'unknown' WHEN p_partkey % 11 = 5 THEN 'unknown' ELSE 'raw' END AS class,
      CASE WHEN torn THEN 'tag 256 points outside the file' END AS error FROM f""",
)
def frame_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Facts of a tree's frames of either byte order, read by ranges, from directories below the first too; broken ones say why."""
    found = trees.frame_files(spark, _part_tree(spark, sf), ["stem", *frames.FACTS.names], window=1024)
    rows = found.select(F.substring("stem", 2, 20).cast("long").alias("p_partkey"), F.struct(*frames.FACTS.names).alias("facts"))
    _, *meta = frames.metadata_columns("facts")
    return rows.select(
        "p_partkey", "facts.width", "facts.bits", "facts.make", *meta, frames.frame_class().alias("class"), "facts.error"
    )


@register(
    "raw_frames",
    """SELECT p_partkey, CASE WHEN p_partkey % 17 = 8 THEN 'tag 256 points outside the file' WHEN p_partkey % 5 = 4 THEN 'big-endian' WHEN p_partkey % 13 = 6 THEN 'no samples' WHEN p_partkey % 11 = 5 THEN 'compressed' WHEN p_partkey % 4 = 3 THEN 'depth' WHEN p_partkey % 19 = 9 THEN 'tail' END AS error FROM part""",
)
def raw_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Frames under the strict rules, broken ones among them, with the first rule that each breaks."""
    return _part_files(spark, sf).select("p_partkey", frames.raw_frame("content")["error"].alias("error"))


@register(
    "pam_round_trip",
    "SELECT vec_id, 8 AS width, 8 AS height, array_to_string(list_transform(embedding, lambda x: greatest(0, least(4095, floor((x::DOUBLE + 0.5) * 4000)::INT))), ',') AS plane FROM embeddings",
)
def pam_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Planes written as images and read again."""
    from loomshed.plans.planes import sampled

    images = sampled(spark, sf).select("vec_id", frames.render_pam_column(8, 8)("p").alias("image"))
    return images.select("vec_id", frames.pam("image").alias("p")).select(
        "vec_id", "p.width", "p.height", F.array_join(F.transform("p.plane", lambda v: v.cast("string")), ",").alias("plane")
    )


# Records.


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("doc_id")
    return table(spark, sf, "documents").select(
        k,
        F.concat(F.lit("d"), k.cast("string"), F.lit(".dng")).alias("file"),
        F.col("n_chars").alias("size"),
        F.sha2(F.col("text").cast("binary"), 256).alias("sha256"),
        "source",
        "lang",
    )


_FILES = "SELECT doc_id, 'd' || doc_id || '.dng' AS file, n_chars AS size, sha256(text) AS sha256, source, lang FROM documents"


@register(
    "checksum_records",
    f"SELECT file, size, lpad(lower(hex(doc_id * 7919)), 8, '0') AS crc32c, sha256, lang AS timecode, '' AS framerate, '' AS iso, source AS exposure FROM ({_FILES})",
)
def checksum_records(spark: SparkSession, sf: str) -> DataFrame:
    """A checksum sidecar written, sorted by name, and read back."""
    rows = _documents(spark, sf).select(
        "file",
        "size",
        (F.col("doc_id") * 7919).alias("crc32c"),
        "sha256",
        F.col("lang").alias("timecode"),
        F.lit("").alias("framerate"),
        F.lit("").alias("iso"),
        F.col("source").alias("exposure"),
    )
    path = scratch(spark, "checksums")
    records.write_checksums(rows, path, MAGIC, "1")
    found, _ = records.read_checksums(spark, path)
    return found.select(*records.CHECKSUMS[0])


_RAW = "CASE doc_id % 6 WHEN 0 THEN 3 WHEN 1 THEN 5 ELSE 4 END"


def _odd_lines(spark: SparkSession, sf: str) -> Column:
    """Sidecar lines of several arities, some with a bad size or checksum."""
    k = F.col("doc_id")
    size = F.when(k % 7 == 2, "many").otherwise(F.col("size").cast("string"))
    crc = F.when(k % 11 == 3, "xyz").otherwise(F.lpad(F.lower(F.hex(k)), 8, "0"))
    return F.concat_ws("\t", "file", size, crc, F.when(k % 6 != 0, F.col("sha256")), F.when(k % 6 == 1, "extra"))


@register(
    "checksum_rejects",
    f"""SELECT file AS file, CASE WHEN {_RAW} = 3 THEN 'predates the sha256 column' WHEN {_RAW} = 5 THEN '5 columns' WHEN doc_id % 7 = 2 THEN 'bad size' WHEN doc_id % 11 = 3 THEN 'bad crc32c' END AS reason FROM ({_FILES})
    WHERE {_RAW} <> 4 OR doc_id % 7 = 2 OR doc_id % 11 = 3""",
)
def checksum_rejects(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of an older sidecar that are no rows, each with the reason."""
    path = scratch(spark, "odd-checksums")
    _lines(_documents(spark, sf), _odd_lines(spark, sf), F.col("doc_id"), path, ["\t".join(records.CHECKSUMS[0][:4])])
    _, bad = records.read_checksums(spark, path)
    return bad.select(F.split_part("line", F.lit("\t"), F.lit(1)).alias("file"), "reason")


@register(
    "plane_checksums",
    f"SELECT file, size, sha256, lpad(lower(hex(doc_id)), 8, '0') AS crc32c, '0' || doc_id % 2 AS plane FROM ({_FILES}) WHERE doc_id % 4 <> 1",
)
def plane_checksums(spark: SparkSession, sf: str) -> DataFrame:
    """Sidecars of planes, five columns at least."""
    k = F.col("doc_id")
    line = F.concat_ws(
        "\t",
        "file",
        F.col("size").cast("string"),
        "sha256",
        F.lpad(F.lower(F.hex(k)), 8, "0"),
        F.when(k % 4 != 1, F.concat(F.lit("0"), (k % 2).cast("string"))),
        F.when(k % 4 == 2, "frame"),
    )
    path = scratch(spark, "planes")
    _lines(_documents(spark, sf), line, k, path, [MAGIC, "\t".join(records.PLANES[0])])
    found, _ = records.read_plane_checksums(spark, path)
    return found.select("file", "size", "sha256", "crc32c", "plane")


@register("resume_records", f"SELECT file, size, sha256 FROM ({_FILES}) WHERE doc_id % 9 <> 4")
def resume_records(spark: SparkSession, sf: str) -> DataFrame:
    """A sidecar with files held twice and a torn tail, for a resumed run."""
    spark_rows, k = _documents(spark, sf), F.col("doc_id")
    twice = spark_rows.unionByName(spark_rows.filter(k % 9 == 4))
    path = scratch(spark, "resume")
    line = F.concat_ws("\t", "file", F.col("size").cast("string"), F.lpad(F.lower(F.hex(k)), 8, "0"), "sha256")
    _lines(twice, line, k, path)
    found, _ = records.read_resume(spark, path)
    return found.select("file", "size", "sha256")


@register(
    "bake_records",
    """WITH r AS (SELECT source AS clip, count(*) AS n FROM documents GROUP BY 1)
    SELECT clip, n + CASE WHEN clip LIKE '%3%' THEN 1 ELSE 0 END AS file_count, CASE WHEN clip LIKE '%5%' THEN 'no container' WHEN clip LIKE '%3%' THEN 'file_count' END AS error, n AS rows FROM r""",
)
def bake_records(spark: SparkSession, sf: str) -> DataFrame:
    """Bake manifests, one a clip, with what is wrong in their headers."""
    root = scratch(spark, "bakes")
    rows = _documents(spark, sf).groupBy(F.col("source").alias("clip")).agg(F.count(F.lit(1)).alias("n"))
    heads = rows.select("clip", F.explode(F.array(
        F.concat(F.lit("0"), F.lit(MAGIC)),
        F.concat(F.lit("1clip: "), "clip"),
        F.when(~F.contains("clip", F.lit("5")), "2container: tar"),
        F.concat(F.lit("3file_count: "), (F.col("n") + F.when(F.contains("clip", F.lit("3")), 1).otherwise(0)).cast("string")), F.lit("4relpath\tsize\tsha256"))).alias("v")).filter("v is not null")
    body = _documents(spark, sf).select(
        F.col("source").alias("clip"),
        F.concat(F.lit("5"), F.concat_ws("\t", "file", F.col("size").cast("string"), "sha256")).alias("v"),
    )
    both = heads.unionByName(body).repartition("clip").sortWithinPartitions("clip", "v")
    both.select("clip", F.substring("v", 2, 1 << 30).alias("value")).write.partitionBy("clip").text(root)
    head, found, _ = records.read_bake(spark, f"{root}/*")
    held = found.groupBy("manifest").agg(F.count(F.lit(1)).alias("rows"))
    return head.join(held, "manifest", "left").select("clip", "file_count", "error", "rows")


_CLIPS = "SELECT source AS clip, count(*) AS frames, CASE WHEN source LIKE '%1%' THEN count(*) END AS declared, min(doc_id) AS first, max(doc_id) AS last, CASE WHEN source LIKE '%2%' THEN min(lang) END AS tc FROM documents GROUP BY 1"


@register(
    "ingest_records", f"SELECT clip, frames, declared::VARCHAR AS manifest_declared, first, last, tc AS tc_start FROM ({_CLIPS})"
)
def ingest_records(spark: SparkSession, sf: str) -> DataFrame:
    """An ingest manifest written and read back; '-' is null."""
    d = table(spark, sf, "documents").groupBy(F.col("source").alias("clip")).agg(
        F.count(F.lit(1)).alias("frames"),
        F.min("doc_id").alias("first"),
        F.max("doc_id").alias("last"),
        F.min("lang").alias("tc"),
    )
    rows = d.select(
        "clip",
        "frames",
        F.when(F.contains("clip", F.lit("1")), F.col("frames")).alias("manifest_declared"),
        "first",
        "last",
        F.when(F.contains("clip", F.lit("2")), F.col("tc")).alias("tc_start"),
        F.lit(None).cast("string").alias("tc_end"),
    )
    path = scratch(spark, "ingest")
    records.write_ingest(rows, path, MAGIC)
    found, _ = records.read_ingest(spark, path)
    return found.select("clip", "frames", "manifest_declared", "first", "last", "tc_start")


@register(
    "offload_records",
    f"""WITH f AS (SELECT doc_id, file, size, sha256, CASE WHEN doc_id % 10 = 1 AND doc_id % 20 <> 1 THEN 'FAIL' ELSE 'OK' END AS verdict FROM ({_FILES}))
    SELECT file, size, sha256 AS source_sha256, CASE WHEN doc_id % 20 = 1 THEN 'fixed' ELSE md5(file) END AS dest_sha256, verdict, '/mnt/a' AS dest FROM f""",
)
def offload_records(spark: SparkSession, sf: str) -> DataFrame:
    """An offload manifest written, read, rewritten with repaired rows, and read again."""
    k = F.col("doc_id")
    rows = _documents(spark, sf).select(
        k,
        "file",
        "size",
        F.col("sha256").alias("source_sha256"),
        F.md5(F.col("file").cast("binary")).alias("dest_sha256"),
        F.when(k % 10 == 1, "FAIL").otherwise("OK").alias("verdict"),
    )
    first, second = scratch(spark, "offload"), scratch(spark, "offload-repaired")
    records.write_offload(rows, first, MAGIC, "/mnt/a")
    found, _ = records.read_offload(spark, first)
    fixed = rows.filter(k % 20 == 1).select("file", F.lit("fixed").alias("dest_sha256"), F.lit("OK").alias("verdict"))
    records.rewrite_offload(found, fixed, second, MAGIC, "/mnt/a")
    again, _ = records.read_offload(spark, second)
    return again.select(*records.OFFLOAD[0], "dest")


@register(
    "member_records",
    f"SELECT file, size, sha256, CASE WHEN doc_id % 50 = 7 THEN 'SHA' ELSE 'OK' END AS verdict, 'REFUSE ' || (SELECT count(*) FROM documents WHERE doc_id % 50 = 7) || ' named row(s)' AS record_verdict FROM ({_FILES})",
)
def member_records(spark: SparkSession, sf: str) -> DataFrame:
    """A member record, whose last line is the verdict of all rows."""
    rows = _documents(spark, sf).withColumn("verdict", F.when(F.col("doc_id") % 50 == 7, "SHA").otherwise("OK"))
    path = scratch(spark, "members")
    records.write_members(rows, path, MAGIC)
    found, _ = records.read_members(spark, path)
    return found.select(*records.MEMBERS[0], "record_verdict")


@register(
    "reel_records",
    """WITH o AS (SELECT o_custkey AS clip, 'a' || o_orderkey AS a, sha256(o_orderkey::VARCHAR) AS s, o_orderkey % 50 AS f FROM orders)
    SELECT 'c' || clip AS clip, count(*) AS archives, min(s) AS least, sha256(clip::VARCHAR) AS manifest_sha256, sum(f)::BIGINT AS frames, (SELECT count(DISTINCT clip) FROM o) AS clips FROM o GROUP BY clip""",
)
def reel_records(spark: SparkSession, sf: str) -> DataFrame:
    """A reel manifest written and read back, its header held against its rows."""

    def sha(c):
        return F.sha2(c.cast("string").cast("binary"), 256)

    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k")).agg(
        F.array_sort(F.collect_list("o_orderkey")).alias("o"), F.sum(F.col("o_orderkey") % 50).alias("frames")
    )
    rows = o.select(
        F.concat(F.lit("c"), F.col("k").cast("string")).alias("clip"),
        F.lit("x").alias("codec"),
        F.transform("o", lambda x: F.concat(F.lit("a"), x.cast("string"))).alias("archive"),
        F.transform("o", sha).alias("archive_sha256"),
        F.concat(F.lit("m"), F.col("k").cast("string")).alias("manifest_name"),
        sha(F.col("k")).alias("manifest_sha256"),
        "frames",
    )
    path = scratch(spark, "reels")
    records.write_reels(rows, path, MAGIC, 1_700_000_000, "1")
    head, found, _ = records.read_reels(spark, path)
    both = found.join(head.filter("error is null").select("manifest", "clips"), "manifest")
    return both.select(
        "clip",
        F.size("archive").cast("long").alias("archives"),
        F.array_min("archive_sha256").alias("least"),
        "manifest_sha256",
        "frames",
        "clips",
    )


@register(
    "qc_records",
    f"SELECT file, 12 AS bps, (size % 100)::INT AS raw_min, (size % 4000)::INT AS raw_max, printf('%.3f', size / 7.0::DOUBLE) AS raw_mean, CASE WHEN doc_id % 8 = 0 THEN 1 ELSE 0 END AS black FROM ({_FILES})",
)
def qc_records(spark: SparkSession, sf: str) -> DataFrame:
    """A statistics record of three decimals, written and read back."""
    from loomshed.operators.stats import three_places

    s = F.col("size")
    rows = _documents(spark, sf).select(
        "file",
        F.lit(12).alias("bps"),
        (s % 100).alias("raw_min"),
        (s % 4000).alias("raw_max"),
        three_places(s / 7.0).alias("raw_mean"),
        F.lit(0).alias("range"),
        F.lit("0.000").alias("variance"),
        (F.col("doc_id") % 8 == 0).cast("int").alias("black"),
    )
    path = scratch(spark, "qc")
    records.write_qc(rows, path, MAGIC, 10**6, ["b", "a"])
    found, _ = records.read_qc(spark, path)
    return found.select("file", "bps", "raw_min", "raw_max", "raw_mean", "black")


@register(
    "pin_records",
    """SELECT string_agg(c || '=' || e, '; ' ORDER BY c || '=' || e) AS pins FROM (
      SELECT replace(p_name, ' ', '_') || p_partkey AS c, replace(p_type, ' ', '_') AS e FROM part WHERE p_size % 3 <> 2 UNION ALL SELECT 'tool', '9' FROM part WHERE p_size % 3 = 2)""",
)
def pin_records(spark: SparkSession, sf: str) -> DataFrame:
    """A pin table read, and its versions as one line."""
    s = F.col("p_size")

    def under(c):
        return F.replace(c, F.lit(" "), F.lit("_"))

    probe = F.when(s % 3 == 0, "version-contains --version").when(s % 3 == 1, "lock-grep x").otherwise("toml-grep version")
    line = F.concat_ws(
        "\t", F.concat(under(F.col("p_name")), F.col("p_partkey").cast("string")), under(F.col("p_type")), probe, F.lit("note")
    )
    path = scratch(spark, "pins")
    _lines(table(spark, sf, "part"), line, F.col("p_partkey"), path, ["\t".join(records.PINS[0])])
    rows, _ = records.read_pins(spark, path)
    return reports.canonical_pins(rows, "9")


@F.pandas_udf(T.BinaryType())
def _profiles(key: pd.Series, make: pd.Series) -> pd.Series:
    """A measured camera a row; of every fourth the geometry lacks its predicates."""

    def one(k: int, m: str) -> bytes:
        text = records.render_profile(
            {"camera": f"cam{k}", "make": m, "model": f"m{k}", "naming": "A_*"}, [(k + 1, k + 2, 12, "raw")], MAGIC
        )
        return (text.replace(" raw", "") if k % 4 == 3 else text).encode()

    return pd.Series([one(int(k), m) for k, m in zip(key, make, strict=True)])


@register(
    "profile_records",
    """SELECT 'cam' || s_suppkey AS camera, s_name AS make, 'm' || s_suppkey AS model, (s_suppkey + 1)::INT AS w, (s_suppkey + 2)::INT AS h, 12 AS bits, s_suppkey % 4 <> 3 AS fine FROM supplier""",
)
def profile_records(spark: SparkSession, sf: str) -> DataFrame:
    """Measured cameras, each written as a profile by an executor, and loaded as a set."""
    root, cameras = scratch(spark, "profiles"), table(spark, sf, "supplier")
    rel = F.format_string("%d.profile", F.col("s_suppkey"))
    trees.write_files(cameras.select(rel.alias("rel"), _profiles("s_suppkey", "s_name").alias("content")), root)
    head, geo = records.profile_set(spark, root)
    return head.join(geo, "manifest").select("camera", "make", "model", "w", "h", "bits", "fine")


@register(
    "declared_records",
    "SELECT source || '/' || lang AS clip, count(*) FILTER (WHERE doc_id % 4 <> 3) AS declared FROM documents GROUP BY 1 HAVING count(*) FILTER (WHERE doc_id % 4 <> 3) > 0",
)
def declared_records(spark: SparkSession, sf: str) -> DataFrame:
    """Declared frames by folder, from a listing with a title."""
    k = F.col("doc_id")
    rel = F.concat_ws(
        "/", "source", "lang", F.concat(k.cast("string"), F.when(k % 4 == 3, ".wav").when(k % 4 == 2, ".DNG").otherwise(".dng"))
    )
    path = scratch(spark, "listing")
    _lines(table(spark, sf, "documents"), F.concat_ws("\t", rel, F.lit("1")), k, path, ["a title", "relpath\tsize"])
    return records.declared_counts(spark, path)


@register(
    "source_digests",
    f"SELECT file AS member, CASE WHEN doc_id % 3 = 0 THEN sha256(sha256) ELSE sha256 END AS sha FROM ({_FILES}) WHERE doc_id % 5 <> 2 OR doc_id % 3 = 0",
)
def source_digests(spark: SparkSession, sf: str) -> DataFrame:
    """Digests of all offload manifests of a folder; the last manifest by name wins, bad digests count not."""
    d, k = _documents(spark, sf), F.col("doc_id")

    def row(sha):
        return F.concat_ws("\t", "file", F.col("size").cast("string"), sha, F.lit("-"), F.lit("OK"))

    root = scratch(spark, "manifests")
    one = row(F.when(k % 5 == 2, "none").otherwise(F.upper("sha256")))
    two = row(F.sha2(F.col("sha256").cast("binary"), 256))
    both = d.select(F.lit("a").alias("of"), one.alias("value")).unionByName(
        d.filter(k % 3 == 0).select(F.lit("b").alias("of"), two.alias("value"))
    )
    both.write.partitionBy("of").text(root)
    lines = records.text_lines(spark, f"{root}/of=a").withColumn("manifest", F.lit("a")).unionByName(
        records.text_lines(spark, f"{root}/of=b").withColumn("manifest", F.lit("b"))
    )
    rows, _ = records.parse_rows(lines, *records.OFFLOAD)
    return records.source_sha_map(rows)


@register("anchors", "SELECT doc_id, (doc_id % 100) / 8.0::DOUBLE AS mae, (doc_id % 7) / 4.0::DOUBLE AS h FROM documents")
def anchors(spark: SparkSession, sf: str) -> DataFrame:
    """Anchors of frames; of several rows of a frame the first counts."""
    d, k = table(spark, sf, "documents").select("doc_id"), F.col("doc_id")

    def row(again):
        return F.concat_ws(
            "\t", k.cast("string"), ((k % 100) / 8.0 + again).cast("string"), ((k % 7) / 4.0).cast("string")
        )

    path = scratch(spark, "anchors")
    lines = d.select(k.alias("o"), row(0).alias("line")).unionByName(d.select((k + 10**12).alias("o"), row(1).alias("line")))
    _lines(lines, F.col("line"), F.col("o"), path, ["a line without values"])
    found = records.read_anchors(spark, path, ["mae", "h"])
    return records.anchored(d.withColumn("frame", k.cast("string")), found, "frame").drop("frame")


_EVENTS = "SELECT floor(epoch(ts))::BIGINT AS created, event_type AS command, event_id::VARCHAR AS input, 'reel' || user_id AS output, CASE WHEN event_id % 2 = 0 THEN props ELSE '' END AS context FROM events"


@register("ledger_append", f"SELECT * FROM ({_EVENTS})")
def ledger_append(spark: SparkSession, sf: str) -> DataFrame:
    """A ledger of two appends, read as one."""
    e = table(spark, sf, "events")
    blank = [F.lit("").alias(c) for c in ("tool_version", "codec", "frames", "verdict", "duration_s", "dest", "selection")]
    rows = e.select(
        F.unix_timestamp(F.col("ts").cast("timestamp")).alias("created"),
        F.col("event_type").alias("command"),
        F.col("event_id").cast("string").alias("input"),
        F.concat(F.lit("reel"), F.col("user_id").cast("string")).alias("output"),
        F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise("").alias("context"),
        *blank,
        "event_id",
    )
    path = scratch(spark, "ledger-appended")
    for part in (0, 1):
        records.append_ledger(rows.filter(F.col("event_id") % 2 == part), path)
    found, _ = records.read_ledger(spark, path)
    return found.select("created", "command", "input", "output", "context")


# Hash lists, signatures, reports.


@F.pandas_udf(T.StringType())
def _chains(keys_: pd.Series, sizes: pd.Series) -> pd.Series:
    from loomshed.functions.hashing import c4_of_digest

    def id_(k, n):
        return c4_of_digest(bytes([k % 256, n % 256]) * 32)

    return pd.Series([hashlists.render_chain([(n, f"{n}.mhl", id_(int(k), n)) for n in range(1, int(s) % 5 + 1)]) for k, s in zip(keys_, sizes, strict=True)])


@register(
    "hash_chains", "SELECT p_partkey, n::INT AS sequence, n || '.mhl' AS path FROM part, range(1, 6) t(n) WHERE n <= p_size % 5"
)
def hash_chains(spark: SparkSession, sf: str) -> DataFrame:
    """Records of hash-list chains."""
    p = spread(table(spark, sf, "part").select("p_partkey", "p_size"), "p_partkey")
    texts = p.select("p_partkey", _chains(p["p_partkey"], p["p_size"]).alias("text"))
    return texts.select("p_partkey", F.explode(hashlists.chain("text")).alias("e")).select("p_partkey", "e.sequence", "e.path")


@register(
    "hash_list_audit",
    "SELECT 'd' || doc_id AS path, CASE WHEN doc_id % 10 = 3 THEN 'MISSING' WHEN doc_id % 7 = 2 THEN 'SIZE' WHEN doc_id % 11 = 5 THEN 'C4' ELSE 'OK' END AS verdict FROM documents",
)
def hash_list_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Hash lists rendered, one a source, parsed again and held against disk."""
    from loomshed.functions.hashing import c4_id

    d, k = table(spark, sf, "documents"), F.col("doc_id")
    content = F.col("text").cast("binary")
    rows = stored(
        d.select(
            "source",
            F.concat(F.lit("d"), k.cast("string")).alias("path"),
            F.col("n_chars").alias("size"),
            c4_id(content).alias("c4"),
            k,
        ),
        "listed",
    )
    texts = hashlists.render_lists(rows, "source")
    listed = texts.select(F.explode(hashlists.entries("text")).alias("e")).select("e.*")
    other = F.when(k % 11 == 5, F.reverse(F.substring("c4", 3, 88))).otherwise(F.substring("c4", 3, 88))
    disk = rows.filter(k % 10 != 3).select(
        "path", (F.col("size") + F.when(k % 7 == 2, 1).otherwise(0)).alias("d_size"), F.concat(F.lit("c4"), other).alias("d_c4")
    )
    return hashlists.verify(listed, disk)


@register(
    "signatures",
    """SELECT n_nationkey, CASE WHEN n_nationkey % 6 = 1 THEN 'manifest' WHEN n_nationkey % 6 = 2 THEN 'signature' WHEN n_nationkey % 6 = 3 THEN 'envelope' WHEN n_nationkey % 6 = 4 THEN 'no manifest' ELSE 'OK' END AS finding FROM nation""",
)
def signed_manifests(spark: SparkSession, sf: str) -> DataFrame:
    """Manifests signed with a key from its file, tampered with, and verified."""
    key = signatures.parse_key(signatures.render_key(signatures.key_of(bytes(range(32)))))
    k = F.col("n_nationkey")
    rows = signatures.signed(
        table(spark, sf, "nation").withColumn("content", F.col("n_name")),
        "n_name",
        "content",
        key,
        1_700_000_000,
        "a=1; b=2",
        "9",
    )
    content = F.when(k % 6 == 1, F.concat("content", F.lit("!"))).when(k % 6 != 4, F.col("content"))
    envelope = F.when(
        k % 6 == 2, F.replace("envelope", F.lit("pin_set: a=1"), F.lit("pin_set: a=2"))
    ).when(k % 6 == 3, F.replace("envelope", F.lit("manifest_bytes"), F.lit("bytes"))).otherwise(F.col("envelope"))
    public = signatures.Key(key.public)
    return rows.select(k, content.alias("content"), envelope.alias("envelope")).select(
        k, signatures.finding(F.col("content"), F.col("envelope"), public).alias("finding")
    )


_JOB = "SELECT doc_id, source AS clip, 'd' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '&<\"' ELSE '' END AS file, n_chars AS size_bytes, md5(text) AS source_sha256, 'OK' AS verdict, doc_id % 100 AS copied_ms FROM documents"


def _job(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("doc_id")
    file = F.concat(F.lit("d"), k.cast("string"), F.when(k % 3 == 0, '&<"').otherwise(""))
    return table(spark, sf, "documents").select(
        k,
        F.col("source").alias("clip"),
        file.alias("file"),
        F.col("n_chars").alias("size_bytes"),
        F.md5(F.col("text").cast("binary")).alias("source_sha256"),
        F.lit(None).cast("string").alias("dest_sha256"),
        F.lit("OK").alias("verdict"),
        F.lit(False).alias("skipped"),
        (k % 100).alias("copied_ms"),
        F.concat(F.lit("/s,"), "lang").alias("source"),
        F.lit("/d").alias("dest"),
    )


@register(
    "job_reports",
    f"""WITH j AS ({_JOB}) SELECT clip, file, '| `' || file || '` | ' || size_bytes || ' | ' || source_sha256 || ' |  | OK | 0 | ' || copied_ms || ' |' AS markdown,
      '<tr><td>' || replace(replace(replace(file, '&', '&amp;'), '<', '&lt;'), '"', '&quot;') || '</td><td>' || size_bytes || '</td><td>' || source_sha256 || '</td><td></td><td>OK</td><td>0</td><td>' || copied_ms || '</td></tr>' AS html,
      '"/s,' || lang || '",/d,' || clip || ',' || CASE WHEN contains(file, '"') THEN '"' || replace(file, '"', '""') || '"' ELSE file END || ',' || size_bytes || ',' || source_sha256 || ',,OK,0,' || copied_ms AS csv
    FROM j JOIN documents USING (doc_id)""",
)
def job_reports(spark: SparkSession, sf: str) -> DataFrame:
    """A job report's lines as Markdown, HTML and, over several sources, CSV."""
    j = _job(spark, sf)

    def line(f, name):
        return f.withColumnRenamed("line", name)

    one = line(reports.markdown_lines(j), "markdown").join(line(reports.html_lines(j), "html"), ["clip", "file"])
    return one.join(line(reports.csv_lines(j, ("source", "dest")), "csv"), ["clip", "file"])


@register(
    "json_lines",
    """SELECT event_id, '{"event_id":' || event_id || ',"event_type":"' || event_type || '","user_id":' || user_id || ',"note":"a\\"b\\\\c"}' AS line FROM events""",
)
def json_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Rows as JSON objects, escaped."""
    rows = table(spark, sf, "events").select("event_id", "event_type", "user_id", F.lit('a"b\\c').alias("note"))
    return reports.json_rows(rows).select(
        F.regexp_extract("line", '"event_id":([0-9]+)', 1).cast("long").alias("event_id"), "line"
    )


@register(
    "run_reports",
    """SELECT source AS clip, '| ' || source || ' | ' || count(*) || ' | ' || sum(n_chars) || ' | ' || sum(n_chars // 2) || ' | ' || printf('%.2f', sum(n_chars)::DOUBLE / sum(n_chars // 2)) || ' | ' || CASE WHEN min(doc_id % 40) = 0 THEN 'FAIL' ELSE 'PASS' END || ' |' AS line FROM documents GROUP BY 1""",
)
def run_reports(spark: SparkSession, sf: str) -> DataFrame:
    """The lines of a run's report, one a clip."""
    d = table(spark, sf, "documents")
    clips = d.groupBy(F.col("source").alias("clip")).agg(
        F.count(F.lit(1)).alias("frames"),
        F.sum("n_chars").alias("in_bytes"),
        F.sum(F.expr("n_chars div 2")).alias("out_bytes"),
        F.bool_and(F.col("doc_id") % 40 != 0).alias("fine"),
    )
    return reports.run_lines(clips)


@register(
    "scalar_texts",
    r"""SELECT event_id, strftime(to_timestamp(floor(epoch(ts))::BIGINT) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S UTC') AS at, strftime(DATE '1970-01-01' + (event_id % 30000)::INT, '%Y-%m-%d') AS day, 'a' || event_id % 3 || '+' || event_type AS pair,
      CASE WHEN user_id % 4 = 0 THEN event_type ELSE 'c' || user_id || '/' || event_type END AS key, event_type IN ('click', 'view') AS fatal, event_type LIKE 'c%' OR user_id % 4 = 1 AS ignored FROM events""",
)
def scalar_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Dates, pairs, display keys and membership."""
    e, u, kind = F.col("event_id"), F.col("user_id"), F.col("event_type")
    clip = F.when(u % 4 == 0, "").otherwise(F.concat(F.lit("c"), u.cast("string")))
    path = F.concat_ws("/", F.when(u % 4 == 1, "x.tmp").otherwise("y"), kind)
    return table(spark, sf, "events").select(
        e,
        keys.utc_text(F.unix_timestamp(F.col("ts").cast("timestamp"))).alias("at"),
        keys.civil_date(e % 30000).cast("string").alias("day"),
        keys.codec_pair(F.concat(F.lit("a"), (e % 3).cast("string")), kind).alias("pair"),
        keys.display_key(clip, kind).alias("key"),
        keys.fatal_in(kind, ("click", "view")).alias("fatal"),
        keys.is_ignored(path, ["*.tmp", "c*"]).alias("ignored"),
    )


@register("selection_text", "SELECT lang, string_agg(DISTINCT source, ',' ORDER BY source) AS chosen FROM documents GROUP BY 1")
def selection_text(spark: SparkSession, sf: str) -> DataFrame:
    """A selection as a sorted list."""
    return table(spark, sf, "documents").groupBy("lang").agg(keys.selection_text(F.collect_set("source")).alias("chosen"))


_CRC_TABLE = "list_transform(range(0, 256), lambda i: list_reduce([i::BIGINT] || range(0, 8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 2197175160) ELSE c >> 1 END))"


@register(
    "combined_digests",
    f"""WITH t AS MATERIALIZED (SELECT {_CRC_TABLE} AS t), b AS (SELECT page_id, strlen(url) AS size, sha256(url) AS sha256, hex(encode(url)) AS x, url FROM pages WHERE url IS NOT NULL)
    SELECT page_id, size, sha256, xor(list_reduce([4294967295] || list_transform(range(0, size), lambda i: ('0x' || x[2 * i + 1:2 * i + 2])::BIGINT), lambda c, v: xor(t[xor(c & 255, v) + 1], c >> 8)), 4294967295) AS crc32c FROM b, t""",
)
def combined_digests(spark: SparkSession, sf: str) -> DataFrame:
    """Size, SHA-256 and CRC-32C of contents."""
    from loomshed.functions.hashing import combined_digest

    d = table(spark, sf, "pages").filter("url is not null").select(
        "page_id", combined_digest(F.col("url").cast("binary")).alias("d")
    )
    return d.select("page_id", "d.*")


@register(
    "tile_digests",
    "SELECT doc_id, md5(unhex(md5(coalesce(source, '')) || md5(coalesce(lang, '')) || md5(coalesce(text, '')))) AS digest FROM documents",
)
def tile_digests(spark: SparkSession, sf: str) -> DataFrame:
    """A digest over the digests of tiles, in their order."""
    from loomshed.functions.hashing import tile_set_digest

    tiles = F.array(*[F.coalesce(c, F.lit("")).cast("binary") for c in ("source", "lang", "text")])
    return table(spark, sf, "documents").select("doc_id", tile_set_digest(tiles).alias("digest"))


@register("c4_round_trip")
def c4_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """C4 ids decoded to the digest that they came from; every row must say so."""
    from loomshed.functions.hashing import c4_digest, c4_id

    content = F.col("text").cast("binary")
    rows = table(spark, sf, "documents").filter("text is not null").select(
        "doc_id", c4_id(content).alias("c4"), F.sha2(content, 512).alias("sha512")
    )
    return rows.select("doc_id", "c4", (F.lower(F.hex(c4_digest("c4"))) == F.col("sha512")).alias("same"))


@register(
    "archive_audit",
    f"""WITH m AS ({_FILES}), held AS (SELECT file, 'p' || doc_id % 4 AS part, size + CASE WHEN doc_id % 9 = 1 THEN 1 ELSE 0 END AS d_size, CASE WHEN doc_id % 13 <> 2 THEN CASE WHEN doc_id % 8 = 3 THEN 'x' ELSE sha256 END END AS d FROM m WHERE doc_id % 7 <> 3)
    SELECT file, CASE WHEN part IS NULL THEN 'not found' WHEN part = 'p3' THEN 'missing part' WHEN d IS NULL THEN 'unreadable' WHEN size <> d_size THEN 'size' WHEN sha256 <> d THEN 'sha256' ELSE 'ok' END AS verdict FROM m LEFT JOIN held USING (file)""",
)
def archive_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Manifest rows against the members of archive parts, of which one is away."""
    m, k = _documents(spark, sf), F.col("doc_id")
    digest = F.when(k % 13 != 2, F.when(k % 8 == 3, "x").otherwise(F.col("sha256")))
    members = m.filter(k % 7 != 3).select(
        "file",
        F.concat(F.lit("p"), (k % 4).cast("string")).alias("part"),
        (F.col("size") + F.when(k % 9 == 1, 1).otherwise(0)).alias("d_size"),
        digest.alias("d_sha256"),
    )
    parts = members.select("part").distinct().filter("part <> 'p3'")
    return rc.archive_audit(m.select("file", "size", "sha256"), members, parts, "file")


@register(
    "repair_rows",
    f"""WITH m AS (SELECT doc_id, 'd' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.dng' ELSE '.wav' END AS file, size, sha256 FROM ({_FILES})),
    s AS (SELECT *, 'dest' AS side FROM m UNION ALL SELECT *, 'workspace' FROM m WHERE doc_id % 2 = 1),
    v AS (SELECT file, side, doc_id % 5 = 1 AND side = 'dest' OR doc_id % 3 = 0 AND side = 'workspace' AS gone, doc_id % 7 = 2 AS sized, doc_id % 9 = 4 AS changed, doc_id FROM s)
    SELECT file, side, CASE WHEN gone THEN 'Missing' WHEN sized THEN 'SizeMismatch' WHEN changed THEN 'ShaMismatch' ELSE 'Clean' END AS verdict, file IN ('d1.wav', 'd2.dng') AS in_scope, doc_id % 10 = 6 AS drifted FROM v""",
)
def repair_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Both sides of a manifest against the fresh source, within a scope."""
    k = F.col("doc_id")
    m = _documents(spark, sf).withColumn(
        "file", F.concat(F.lit("d"), k.cast("string"), F.when(k % 2 == 0, ".dng").otherwise(".wav"))
    )
    recorded = m.select("file", "size", F.when(k % 10 == 6, "old").otherwise(F.col("sha256")).alias("sha256"))
    fresh = m.select("file", F.col("size").alias("f_size"), F.col("sha256").alias("f_sha256"))
    side = m.select(
        k,
        "file",
        (F.col("size") + F.when(k % 7 == 2, 1).otherwise(0)).alias("d_size"),
        F.when(k % 9 == 4, "x").otherwise(F.col("sha256")).alias("d_sha256"),
    )
    scope = ["d1.wav", "d2.dng"]
    rc.repair_scope(recorded, "file", scope)
    return rc.repair_rows(
        recorded, side.filter(k % 5 != 1).drop("doc_id"), side.filter(k % 3 != 0).drop("doc_id"), fresh, "file", scope
    )


@register(
    "completion",
    """WITH r AS (SELECT source AS clip, count(*) AS n, sum(doc_id) % 7 AS h FROM documents GROUP BY 1)
    SELECT clip, CASE h WHEN 0 THEN 'no object' WHEN 1 THEN 'no sidecar' WHEN 2 THEN 'no manifest' WHEN 3 THEN 'sha256' WHEN 4 THEN 'no count' WHEN 5 THEN 'stale' ELSE 'complete' END AS verdict FROM r""",
)
def completion(spark: SparkSession, sf: str) -> DataFrame:
    """Which clips' archives are complete, and what the others lack first."""
    r = table(spark, sf, "documents").groupBy(F.col("source").alias("clip")).agg(
        F.count(F.lit(1)).alias("n"), (F.sum("doc_id") % 7).alias("h")
    )
    h = F.col("h")
    objects = r.select(
        "clip",
        F.when(h != 0, "s").alias("object_sha"),
        F.when(h != 1, F.when(h == 3, "t").otherwise("s")).alias("sidecar_sha"),
        (h != 2).alias("has_manifest"),
        F.when(h != 4, F.col("n") + F.when(h == 5, 1).otherwise(0)).alias("file_count"),
    )
    return rc.completion(objects, r.select("clip", F.col("n").alias("rows")), "clip")


@register(
    "neighbour_frames",
    """WITH f AS (SELECT conv_id AS clip, turn AS o, bool_or(role = 'assistant' OR turn = 0) AS v, min(length(text)) AS size FROM conversations GROUP BY ALL),
    c AS (SELECT a.clip, a.o, b.o AS n, b.size, CASE WHEN (a.o - b.o) % 2 = 0 THEN abs(a.o - b.o) ELSE a.o + 1 END AS d, CASE WHEN b.o < a.o THEN 0 ELSE 1 END AS side
          FROM f a JOIN f b ON a.clip = b.clip AND a.o <> b.o AND b.v AND ((a.o - b.o) % 2 = 0 OR b.o = 0 AND a.o % 2 = 1)),
    r AS (SELECT *, row_number() OVER (PARTITION BY clip, o ORDER BY d, side, n) AS k FROM c)
    SELECT f.clip, f.o, r.n AS neighbour, r.size FROM f LEFT JOIN r ON r.clip = f.clip AND r.o = f.o AND k = 1""",
)
def neighbour_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Each frame's verified neighbour, with the neighbour's facts."""
    t = F.col("turn")
    f = table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("clip"), t.alias("o")).agg(
        F.bool_or((F.col("role") == "assistant") | (t == 0)).alias("v"), F.min(F.length("text")).cast("long").alias("size")
    )
    near = rc.nearest_verified(f, "clip", "o", "v")
    return rc.neighbour_frames(near, f.select("clip", "o", "size"), "clip", "o").select("clip", "o", "neighbour", "size")


@register(
    "camera_line",
    """WITH first AS (SELECT p_brand, p_type FROM part ORDER BY p_partkey LIMIT 1), known AS (SELECT DISTINCT p_brand, p_type FROM part WHERE p_partkey % 2 = 0)
    SELECT CASE WHEN NOT EXISTS (SELECT 1 FROM first) THEN 'ABSENT' WHEN EXISTS (SELECT 1 FROM first JOIN known USING (p_brand, p_type)) THEN 'OK' ELSE 'UNKNOWN' END AS verdict""",
)
def camera_line(spark: SparkSession, sf: str) -> DataFrame:
    """A clip's camera by its first frame."""
    p = table(spark, sf, "part")
    verdict = rc.camera_line(p, p.filter("p_partkey % 2 = 0"), "p_partkey", [["p_brand"], ["p_type"]])
    return spark.createDataFrame([(verdict,)], "verdict string")
