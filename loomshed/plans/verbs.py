"""Queries of the one-call jobs, over trees of files that executors write of the documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loomshed import verbs
from loomshed.functions import hashing
from loomshed.plans.registry import register
from loomshed.scratch import many, scratch
from loomshed.session import table
from loomshed.sources import records, trees

CLIPS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
_K = """SELECT k, clip, clip || '/A_' || lpad(k::VARCHAR, 6, '0') || '.dng' AS rel, 'A_' || lpad(k::VARCHAR, 6, '0') AS stem, strlen(n_name) AS size, n_name
  FROM (SELECT doc_id AS k, ['AFRICA', 'AMERICA', 'ASIA', 'EUROPE', 'MIDDLE EAST'][doc_id // 7 % 5 + 1] AS clip, coalesce(text, '') AS n_name FROM documents)"""
#: Rows of a record that a folder holds beside its files.
BATCH = 1000


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    """(k, clip, rel, data): every document as a file of one of five folders."""
    k = F.col("doc_id")
    number = k.cast("string")
    clip = F.element_at(F.array(*map(F.lit, CLIPS)), F.expr("cast(doc_id div 7 % 5 + 1 as int)"))
    return table(spark, sf, "documents").select(
        k.alias("k"),
        clip.alias("clip"),
        # To six places at least: lpad cuts what is longer, and files would share names.
        F.concat(clip, F.lit("/A_"), F.lpad(number, F.greatest(F.lit(6), F.length(number)), "0"), F.lit(".dng")).alias("rel"),
        F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("data"),
    )


def _cut(rows: DataFrame, name: str = "rel") -> DataFrame:
    """The rows with the numbers of names cut to six places, as the queries give them; files keep whole ones."""
    return rows.withColumn(name, F.regexp_replace(name, "A_(.{6})[^./]*", "A_$1"))


def _put(rows: DataFrame, name: str, data: Column | None = None) -> str:
    """A folder of the rows as files, with ``data`` in place of their own."""
    root = scratch(rows.sparkSession, name)
    trees.write_files(rows.select("rel", (F.col("data") if data is None else data).alias("content")), root)
    return root


def _add(rows: DataFrame, root: str, name: Column, top: str, line: Column, *by: Column) -> None:
    """Records beside files: one of every ``BATCH`` keys of a group, named by the group and the batch."""
    batch = F.expr(f"cast(k div {BATCH} as string)").alias("batch")
    body = F.array_join(F.array_sort(F.collect_list("line")), "\n")  # at most BATCH lines
    told = rows.select(name.alias("name"), batch, line.alias("line"), *by).groupBy("name", "batch").agg(body.alias("body"))
    rel = F.format_string("%s", F.replace("name", F.lit("*"), F.col("batch")))
    trees.write_files(told.select(rel.alias("rel"), F.concat(F.lit(top), "body", F.lit("\n")).cast("binary").alias("content")), root)


def _plus(mark: Column, data: str = "data") -> Column:
    """The data, with one more byte where ``mark`` holds."""
    return F.when(mark, F.concat(F.col(data), F.lit(b"!"))).otherwise(F.col(data))


def _turned(mark: Column) -> Column:
    """The data, with another first byte where ``mark`` holds."""
    other = F.concat(F.lit(b"\0"), F.expr("substring(data, 2)"))
    return F.when(mark & (F.octet_length("data") > 0), other).otherwise(F.col("data"))


def _sha(data: Column) -> Column:
    return F.sha2(data, 256)


def _size() -> Column:
    return F.octet_length("data")


def _checked(spark: SparkSession, sf: str) -> str:
    """A folder with sidecars that its files belie: k % 5 gives a good row, a wrong size, digest, file or checksum."""
    rows, k = _documents(spark, sf), F.col("k")
    root = _put(rows.filter("k % 5 <> 3"), "checked")
    crc = hashing.crc32c("data").bitwiseXOR((k % 5 == 4).cast("long"))
    line = F.concat_ws(
        "\t",
        F.substring_index("rel", "/", -1),
        (_size() + (k % 5 == 1).cast("int")).cast("string"),
        F.lower(F.lpad(F.hex(crc), 8, "0")),
        _sha(_plus(k % 5 == 2)),
    )
    _add(rows, root, F.concat("clip", F.lit("/x*.checksums.tsv")), "\t".join(records.CHECKSUMS[0][:4]) + "\n", line)
    return root


_VERDICT = "CASE k % 5 WHEN 0 THEN 'ok' WHEN 1 THEN 'size' WHEN 2 THEN 'sha256' WHEN 3 THEN 'missing' ELSE 'crc32c' END"


@register("verb_verify_checksums", f"SELECT rel, {_VERDICT} AS verdict FROM ({_K})")
def verify_checksums(spark: SparkSession, sf: str) -> DataFrame:
    """Files of a folder against its sidecars."""
    return _cut(verbs.verify_checksums(spark, _checked(spark, sf)).rows)


@register(
    "verb_audit",
    f"""SELECT 'checksums' AS record, rel, {_VERDICT} AS verdict FROM ({_K}) UNION ALL
    SELECT 'offload', rel, CASE WHEN k % 2 = 0 THEN 'DEST_MISSING' WHEN k % 3 = 0 THEN 'MISSING' WHEN k % 3 = 1 AND size > 0 THEN 'SHA' ELSE 'OK' END FROM ({_K}) UNION ALL
    SELECT 'sources', rel, CASE WHEN k % 4 = 0 THEN 'MISSING' WHEN k % 4 = 1 THEN 'SIZE' ELSE 'OK' END FROM ({_K})""",
)
def audit(spark: SparkSession, sf: str) -> DataFrame:
    """Every record of a folder against disk."""
    root, rows, k = _checked(spark, sf), _documents(spark, sf), F.col("k")
    for n in (0, 1):
        line = F.concat_ws("\t", "rel", _size().cast("string"), _sha(F.col("data")), F.lit("-"), F.lit("OK"))
        top = f"# m\ndest: /{n}\n" + "\t".join(records.OFFLOAD[0]) + "\n"
        _add(rows.filter(k % 2 == n), root, F.lit(f"{n}-*.offload-manifest.tsv"), top, line)
    line = F.concat_ws("\t", "rel", (_size() + (k % 4 == 1).cast("int")).cast("string"), _sha(F.col("data")))
    _add(rows, root, F.lit("s*.sources.tsv"), "# m\n" + "\t".join(records.SOURCES[0]) + "\n", line)
    dest = _put(rows.filter(k % 3 != 0), "dest", _turned(k % 3 == 1))
    card = _put(rows.filter(k % 4 != 0), "card")
    return _cut(verbs.audit(spark, root, card, {"/1": dest}).rows)


@register(
    "verb_diff",
    f"SELECT clip, stem, CASE WHEN k % 5 IN (3, 4) THEN 'MISSING' WHEN k % 5 = 1 THEN 'DELTA' ELSE 'IDENTICAL' END AS verdict FROM ({_K})",
)
def diff(spark: SparkSession, sf: str) -> DataFrame:
    """Two folders' frames against each other."""
    rows, k = _documents(spark, sf), F.col("k")
    a = _put(rows.filter(k % 5 != 4), "a")
    b = _put(rows.filter(k % 5 != 3), "b", _plus(k % 5 == 1))
    return _cut(verbs.diff(spark, a, b).rows.select("clip", "stem", "verdict"), "stem")


def _card(spark: SparkSession, sf: str) -> tuple[str, dict[str, str]]:
    """A source, and two destinations: one holds half of the files, some in another form, the other something else."""
    rows, k = _documents(spark, sf), F.col("k")
    other = spark.range(1).select(F.lit("other/file").alias("rel"), F.lit(b"1").alias("data"))
    x = _put(rows.filter(k % 2 == 0), "x", _plus(k % 3 == 0))
    return _put(rows, "source"), {"x": x, "y": _put(other, "y")}


@register(
    "verb_offload",
    f"SELECT rel, dest, CASE WHEN dest = 'x' AND k % 2 = 0 AND k % 3 <> 0 THEN 'skip' ELSE 'copy' END AS action FROM ({_K}), (VALUES ('x'), ('y')) d(dest)",
)
def offload(spark: SparkSession, sf: str) -> DataFrame:
    """What a copy to two destinations has to do."""
    source, dests = _card(spark, sf)
    return _cut(verbs.offload_plan(spark, source, dests).rows)


@register(
    "verb_offload_copy",
    f"SELECT rel AS file, dest, size, sha256(n_name) AS source_sha256, sha256(n_name) AS dest_sha256, 'OK' AS verdict FROM ({_K}), (VALUES ('x'), ('y')) d(dest)",
)
def offload_copy(spark: SparkSession, sf: str) -> DataFrame:
    """Files copied by executors to two destinations, of which one held some in another form, and judged by their digests."""
    source, dests = _card(spark, sf)
    found = verbs.offload(spark, source, dests, scratch(spark, "manifests"), "# m").rows
    return _cut(found.select("file", "dest", "size", "source_sha256", "dest_sha256", "verdict"), "file")


@register(
    "copied_files",
    f"SELECT rel, dest, size, sha256(n_name) AS sha256, 'COPIED' AS verdict FROM ({_K}), (VALUES ('x'), ('y')) d(dest)",
)
def copied_files(spark: SparkSession, sf: str) -> DataFrame:
    """The record of a copy to two folders, digested while it went on; what arrived is read back."""
    source = _put(_documents(spark, sf), "source")
    folders = {scratch(spark, d): d for d in ("x", "y")}
    rows = _documents(spark, sf).select("rel", F.array(*map(F.lit, folders)).alias("dests"))
    name = F.create_map(*[F.lit(x) for pair in folders.items() for x in pair])
    told = trees.copy_files(source, rows).withColumn("dest", F.try_element_at(name, "dest"))
    there = None
    for folder, d in folders.items():
        one = verbs.hashed(verbs.frames.files(spark, folder)).select("rel", F.lit(d).alias("dest"), F.col("d_sha256").alias("there"))
        there = one if there is None else there.unionByName(one)
    verdict = F.when(F.col("there").eqNullSafe(F.col("sha256")), F.col("verdict")).otherwise("differs")
    return _cut(told.join(many(there), ["rel", "dest"], "left").select("rel", "dest", "size", "sha256", verdict.alias("verdict")))


@register(
    "verb_measure",
    f"SELECT CASE WHEN k % 4 <> 3 THEN k % 2 + 4 END AS width, CASE WHEN k % 4 = 3 THEN 'unknown' ELSE 'raw' END AS class, 2 * count(*) AS frames, 2 * count(DISTINCT clip) AS clips FROM ({_K}) GROUP BY 1, 2",
)
def measure(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes and classes of the frames of two roots, counts added."""
    from loomshed.sources import tiff

    def make(w):
        return tiff.write([[(256, 4, [w]), (257, 4, [2]), (258, 3, [8]), (259, 3, [1])]], payload=b"\1" * 2 * w)

    k = F.col("k")
    frame = F.when(k % 4 == 3, F.lit(b"broken")).when(k % 2 == 0, F.lit(make(4))).otherwise(F.lit(make(5)))
    root = _put(_documents(spark, sf), "card", frame)
    return verbs.measure(spark, [root, root]).rows.select("width", "class", "frames", "clips")


@register(
    "verb_derive",
    "WITH p AS (SELECT vec_id, array_to_string(list_transform(embedding, lambda x: greatest(0, least(4095, floor((x::DOUBLE + 0.5) * 4000)::INT)) >> 4), ',') AS plane FROM embeddings) SELECT vec_id, plane, sha256(plane) AS sha256 FROM p",
)
def derive(spark: SparkSession, sf: str) -> DataFrame:
    """Planes at eight bits, with their digests."""
    from loomshed.plans.planes import _show, sampled

    rows = verbs.derive(sampled(spark, sf).withColumnRenamed("p", "plane"), "vec_id", "plane", 8).rows
    return rows.select("vec_id", _show(F.col("plane")).alias("plane"), "sha256")


@register(
    "verb_repair",
    f"""WITH s AS (SELECT *, k % 3 = 1 AND size > 0 AS bad FROM ({_K})) SELECT rel, 'dest' AS side, CASE WHEN bad THEN 'ShaMismatch' WHEN k % 3 = 2 THEN 'Missing' ELSE 'Clean' END AS verdict,
      CASE WHEN k % 3 <> 2 AND NOT bad THEN 'none' WHEN k IN (1, 2) THEN 'copy' ELSE 'stays dirty' END AS action FROM s""",
)
def repair(spark: SparkSession, sf: str) -> DataFrame:
    """What a repair of two rows would do."""
    rows, k = _documents(spark, sf), F.col("k")
    source = _put(rows, "source")
    dest = _put(rows.filter(k % 3 != 2), "dest", _turned(k % 3 == 1))
    manifest = scratch(spark, "manifest")
    listed = rows.select(
        F.col("rel").alias("file"),
        _size().cast("long").alias("size"),
        _sha(F.col("data")).alias("source_sha256"),
        F.lit("-").alias("dest_sha256"),
        F.lit("OK").alias("verdict"),
    )
    records.write_offload(listed, manifest, "# m", "/d")
    scope = [r["rel"] for r in rows.filter("k in (1, 2)").select("rel").collect()]  # two names, as typed by hand
    return _cut(verbs.repair(spark, manifest, source, source, dest, scope).rows.select("rel", "side", "verdict", "action"))


@register(
    "verb_restore",
    f"SELECT clip, rel, row_number() OVER (PARTITION BY clip ORDER BY rel) AS n, CASE WHEN k % 5 = 0 THEN 'restore' ELSE 'master bad' END AS action FROM ({_K}) WHERE k % 2 = 1",
)
def restore(spark: SparkSession, sf: str) -> DataFrame:
    """Offenders against a master that must verify itself."""
    offenders = _documents(spark, sf).filter("k % 2 = 1").select("clip", "rel")
    return _cut(verbs.restore(spark, offenders, _checked(spark, sf)).rows.select("clip", "rel", "n", "action"))


@register(
    "verb_dry_run",
    f"SELECT clip, count(*) AS frames, sum(size)::BIGINT AS bytes, round(sum(size) / 2.5::DOUBLE)::BIGINT AS projected, count(*) * 0.5::DOUBLE AS minutes FROM ({_K}) WHERE clip NOT IN ('ASIA', 'EUROPE') GROUP BY 1",
)
def dry_run(spark: SparkSession, sf: str) -> DataFrame:
    """What a run of the chosen clips is expected to take."""
    root = _put(_documents(spark, sf), "card")
    return verbs.dry_run(spark, root, 2.5, 30_000.0, skip=["ASIA", "EUROPE"]).rows


@register(
    "verb_bake_plan",
    f"""WITH RECURSIVE f AS (SELECT clip, rel, size, row_number() OVER (PARTITION BY clip ORDER BY rel) AS i FROM ({_K})),
    p AS (SELECT clip, rel, i, size AS cur, 0 AS part FROM f WHERE i = 1 UNION ALL
      SELECT f.clip, f.rel, f.i, CASE WHEN p.cur + f.size > 20000 THEN f.size ELSE p.cur + f.size END, CASE WHEN p.cur + f.size > 20000 THEN p.part + 1 ELSE p.part END FROM p JOIN f ON f.clip = p.clip AND f.i = p.i + 1)
    SELECT clip, rel, part FROM p""",
)
def bake_plan(spark: SparkSession, sf: str) -> DataFrame:
    """Parts of each clip's archive."""
    root = _put(_documents(spark, sf), "card")
    return _cut(verbs.bake_plan(spark, root, 20_000, 1_000_000_000).rows.select("clip", "rel", "part"))


@register("verb_run_plan", f"SELECT rel, CASE WHEN k % 3 = 0 THEN 'refuse' ELSE 'encode' END AS action FROM ({_K})")
def run_plan(spark: SparkSession, sf: str) -> DataFrame:
    """What a run will do to each frame."""
    from loomshed.sources import tiff

    frame = tiff.write([[(256, 4, [4]), (257, 4, [2]), (258, 3, [8]), (259, 3, [1])]], payload=b"\1" * 8)
    k = F.col("k")
    root = _put(_documents(spark, sf), "card", F.when(k % 3 == 0, F.lit(b"broken")).otherwise(F.lit(frame)))
    side = "\t".join(records.CHECKSUMS[0][:4]) + f"\nnothing\t1\t00000000\t{'0' * 64}\n"
    out = _put(spark.range(1).select(F.lit("x.checksums.tsv").alias("rel"), F.lit(side.encode()).alias("data")), "out")
    return _cut(verbs.run_plan(spark, root, out).rows.select("rel", "action"))


@register(
    "verb_ingest_gate",
    f"WITH s AS (SELECT clip, k, lag(k) OVER (PARTITION BY clip ORDER BY k) AS p FROM ({_K})) SELECT clip, count(*) AS frames, coalesce(sum(CASE WHEN k > p + 1 THEN k - p - 1 END), 0)::BIGINT AS n_missing, CASE WHEN max(CASE WHEN k > p + 1 THEN 1 ELSE 0 END) = 1 THEN 'FAIL' ELSE 'PASS' END AS verdict FROM s GROUP BY 1",
)
def ingest_gate(spark: SparkSession, sf: str) -> DataFrame:
    """The numbers of a folder's frames."""
    root = _put(_documents(spark, sf), "card")
    return verbs.ingest_gate(spark, root).rows.select("clip", "frames", "n_missing", "verdict")


@register(
    "verb_ledger",
    "SELECT floor(epoch(ts))::BIGINT AS created, event_type AS command FROM events WHERE floor(epoch(ts)) >= (SELECT max(floor(epoch(ts))) FROM events) - 86400",
)
def ledger(spark: SparkSession, sf: str) -> DataFrame:
    """A ledger's rows of the last day."""
    e = table(spark, sf, "events")
    created = F.unix_timestamp(F.col("ts").cast("timestamp"))
    blank = [F.lit("").alias(c) for c in records.LEDGER[0][2:]]
    path = scratch(spark, "ledger")
    records.append_ledger(e.select(created.alias("created"), F.col("event_type").alias("command"), *blank), path)
    since = (e.agg(F.max(created)).first()[0] or 0) - 86400
    return verbs.ledger(spark, path, since).rows.select("created", "command")
